"""Grades, licences, personal data, page text and fingerprints."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from plantpulse.llm import extraction, fingerprints, licences, personal, quality

# --- grades ---------------------------------------------------------------------

GOOD = "a calm and plain sentence about rivers, hills and the people who live there number {}."
RUDE = "you idiot clown, this is a worthless sentence about rivers and moron people number {}."
JUNK = "CLICK!! HERE!! $$$ &&& WIN!! ### {} %%% BUY!! *** NOW!!"


@pytest.fixture(scope="module")
def rated(spark):
    rows = [(i, (JUNK, RUDE, GOOD)[i % 3].format(i)) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, int(i % 3 > 0), int(i % 3 == 1)) for i in range(0, 180)] + [(1, None, 1), (None, 1, 0), (999, 1, None)],
        "doc_id long, quality int, toxic int",
    )
    return docs, labels


def test_grades_on_held_out_documents(rated):
    docs, labels = rated
    model = quality.train(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    rows = [r for r in quality.grades(docs, model).collect() if r.doc_id >= 180]
    assert all(r.kept == (r.doc_id % 3 > 0) for r in rows)
    mean = {g: np.mean([r.expected_grade for r in rows if r.doc_id % 3 == g]) for g in range(3)}
    assert mean[0] < mean[1] < mean[2]
    assert all(r.p_best <= r.p_good for r in rows)
    assert {r.doc_id % 3 for r in quality.keep_good(docs, model).collect()} == {1, 2}


def test_grades_of_odd_rows(docs, no_docs, rated, texts):
    model = quality.train(*rated)
    rows = quality.grades(docs, model).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in texts)
    assert len({(r.expected_grade) for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert quality.grades(no_docs, model).collect() == []
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert quality.train(docs, rated[1].limit(0)) is None
    assert all(r.kept and r.p_good is None for r in quality.grades(docs, None).collect())


# --- licences -------------------------------------------------------------------

def test_licences_by_sequences(spark):
    s = licences.SENTENCES
    texts = {
        1: "Text.\nReleased under the MIT License.\nMore text.",
        2: " ".join([s["MIT_GRANT"], s["MIT_NOTICE"], s["MIT_WARRANTY"]]),
        3: "\n".join([s["BSD_GRANT"], s["BSD_SOURCE"], s["BSD_BINARY"], "unknown line", s["BSD_NAME"]]),
        4: "\n".join([s["BSD_GRANT"], s["BSD_SOURCE"], s["BSD_BINARY"]]),
        5: "licensed   UNDER the apache license, version 2.0. Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0.",
        6: "the license of nobody", 7: None, 8: s["MIT_NOTICE"],
    }
    rows = {r.doc_id: r for r in licences.licences(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {i: r.licences for i, r in rows.items()} == {
        1: "MIT", 2: "MIT", 3: "BSD-3-Clause", 4: "BSD-2-Clause", 5: "Apache-2.0 CC-BY-NC-4.0", 6: "", 7: "", 8: "",
    }
    assert rows[8].sentence_ids == "MIT_NOTICE" and rows[5].n_licences == 2


def test_every_known_sentence_has_a_cue():
    known = licences.known()
    assert len(known) == len(licences.SENTENCES)
    assert all(re.search(licences.CUES, k) for k in known)
    assert {i for _, ids in licences.RULES for i in ids} <= set(licences.SENTENCES)


def test_licences_of_odd_rows(docs, no_docs, texts):
    assert Counter(r.doc_id for r in licences.licences(docs).collect()) == Counter(i for i, _ in texts)
    assert licences.licences(no_docs).collect() == []


# --- personal data --------------------------------------------------------------

PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    every = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in every) % 10 == 0


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 10 <= len(digits) <= 15
            ):
                out.append((m.start(), order, m.end()))
    return [(PLAIN[o][0], a, b) for a, o, b in sorted(out)]


TRICKY = [
    (101, "a@b.c_d@e.f x@y.z.w. +1 (755) 555-3798x 4111 1111 1111 1111 1 0300.1.2.3 001.002.003.004.5.6.7.8"),
    (102, "é😀 x@é.com q@mail.example.com 😀 4111-1111-1111-1111 12 34 +49 (0)30.1234567-"),
    (103, "1.2.3 4.5.6.7 256.1.1.1 1.1.1.99999999999999999999 +12 +123456789012345678 5500005555555559"),
    (104, "1 " * 30_000), (105, "1.1." * 20_000), (106, "a.b@" * 10_000 + "c.d"), (107, "x@y.z " * 3_000),
    (108, "call (755) 555-3798 or jo (at) mail (dot) org"),
    (109, "call +1 2 3 4 5 6 7 8 9 0 now"), (110, "x +1-2-3-4-5-6-7-8-9-0-1"), (111, "1.2.3.4 +1(2)3(4)5(6)7(8)9(0)"),
    (112, "4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1"),
]


def scattered(seed):
    """Digits, separators and what makes the kinds, at random."""
    import random

    rng = random.Random(seed)
    return "".join(rng.choice(["0", "1", "7", "9", "255", " ", " ", "-", ".", "+", "(", ")", "@", "a", "b.c", "\n", "é"]) for _ in range(400))


TRICKY += [(2000 + i, scattered(i)) for i in range(150)]


@pytest.mark.parametrize("patterns, needs", [(personal.BASE, personal.BASE_NEEDS), (personal.WIDE, personal.WIDE_NEEDS)])
def test_every_match_holds_what_its_pattern_needs(patterns, needs):
    texts = [scattered(i) for i in range(300)] + [t for _, t in TRICKY if len(t) < 5000]
    texts += ["jo (at) mail (dot) org", "jo[at]x.y", "jo at mail dot org", "1[.]2[.]3[.]4", "5500/0055/5555/5559 12345678901234"]
    for kind, pattern in patterns.items():
        found = [m[0] for t in texts for m in re.finditer(pattern, t)]
        assert found and all(re.search(needs[kind], f) for f in found)


@pytest.fixture(scope="module")
def private(spark, docs):
    return docs.select("doc_id", "text").unionByName(spark.createDataFrame(TRICKY, "doc_id long, text string"))


@pytest.fixture(scope="module")
def spans(private):
    model = personal.train(private)
    return model, personal.personal_data(private, model).collect()


def test_base_spans_match_brute_force(private, spans):
    texts = {r.doc_id: r.text or "" for r in private.collect()}
    for r in spans[1]:
        want = base_spans(texts[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest(), (r.doc_id, line[:200], r.spans[:200])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k, _ in PLAIN]
        every = [s for s in r.spans.split(",") if s]
        assert {s for s in line.split(",") if s} <= set(every) and len(every) == len(want) + r.n_added


def test_scores_are_the_same_in_sql(spark, spans):
    from pyspark.sql import functions as F

    model = spans[0]
    names = list(personal.LEVELS)
    rows = [{n: (i * 7 + j) % personal.LEVELS[n] for j, n in enumerate(names)} for i in range(40)]
    frame = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], names)
    got = [r.s for r in frame.select(model.column({n: F.col(n) for n in names}).alias("s")).collect()]
    assert got == pytest.approx([model.score(r) for r in rows])


def test_boosting_learns_format():
    table = [
        ({n: 0 for n in personal.LEVELS} | {"kind": 2, "digits": d, "cue": c}, yes, no)
        for d, c, yes, no in ((5, 0, 90, 10), (5, 1, 100, 0), (3, 0, 0, 100), (3, 1, 2, 98))
    ]
    model = personal.boost(table)
    scores = [model.score(r) for r, _, _ in table]
    assert scores[1] > scores[0] > 0 > max(scores[2:])
    assert set(model.thresholds) == {"card"} and personal.boost([]) == personal.SpanModel()


def test_trees_use_format_and_context(spark):
    """Numbers like phones, some of them within addresses of hosts: the places of dots and what stands around tell them apart."""
    rows = []
    for i in range(60):
        rows.append((3 * i, f"call +1 (755) 555-{1000 + i} or (755) 555-{1000 + i}"))
        rows.append((3 * i + 1, f"card 4111 1111 1111 1111 of {i}"))
        rows.append((3 * i + 2, f"mail a{i}@b.org from 10.0.0.{i}"))
    model = personal.train(spark.createDataFrame(rows, "doc_id long, text string"))

    def used(tree):
        return {tree.feature} | used(tree.low) | used(tree.high) if tree.feature else set()

    assert len(set().union(*map(used, model.trees))) >= 2 and len(set(model.thresholds.values())) >= 2
    found = personal.personal_data(spark.createDataFrame([(1, "or (755) 555-2000 then")], "doc_id long, text string"), model).first()
    assert found.spans == "phone:3:17" and found.n_added == 1 and found.n_phone == 0


def test_generators_add_spans(spark):
    """With a model that takes everything, spelled-out addresses and national numbers are added, base spans stay."""
    model = personal.SpanModel(trees=(), thresholds={k: 0.0 for k in personal.KINDS})
    text = "jo (at) mail (dot) org, (755) 555-3798, a@b.org"
    row = personal.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    found = [text[int(a) : int(b)] for _, a, b in (s.split(":") for s in row.spans.split(","))]
    assert found == ["jo (at) mail (dot) org", "(755) 555-3798", "a@b.org"] and row.n_added == 2


def test_redaction_keeps_the_rest(private, spans):
    done = {r.doc_id: r.text for r in personal.redacted(private, spans[0]).collect()}
    for r in private.collect():
        want, at, text = "", 0, r.text
        places = []
        for a, b, k in sorted(
            ((int(a), int(b), k) for k, a, b in (s.split(":") for x in spans[1] if x.doc_id == r.doc_id for s in x.spans.split(",") if s)),
            key=lambda p: (p[0], personal.KINDS.index(p[2]), p[1]),
        ):
            if places and a < places[-1][1]:
                places[-1][1] = max(places[-1][1], b)
            elif not places or (a, b) != tuple(places[-1][:2]):
                places.append([a, b, k])
        if text is None:
            assert done[r.doc_id] is None
            continue
        for a, b, k in places:
            want, at = want + text[at:a] + f"[{k.upper()}]", b
        assert done[r.doc_id] == want + text[at:]


def test_personal_data_of_nothing(no_docs, docs):
    model = personal.train(no_docs)
    assert model == personal.SpanModel() and personal.personal_data(no_docs, model).collect() == []
    assert personal.redacted(docs, model).columns == docs.columns


def test_personal_data_runs_no_python(private, spans, plan_of):
    assert not re.search("Python|Arrow|Pandas", plan_of(personal.personal_data(private, spans[0])))


# --- pages ----------------------------------------------------------------------

PAGE = (
    "<!DOCTYPE html><html><head><title>no</title><script>var t='</p>'</script></head><body><header>Site</header>"
    "<nav><ul><li><a href=/a>menu</a></ul></nav><div class='cookie-notice'>cookies</div>{before}"
    "<article><h1>Title &amp; more</h1><p><b>First<br>line<p>Second   <i>in</i>line&nbsp;x</p><!-- no --><p>{body}"
    "<form><input name=q><button>go</button></form><div class=comments><p>nice!</div></article><aside>side</aside>"
    "<footer>&copy; foot</footer></body></html>"
)


def test_article_of_a_page():
    rows = extraction.blocks(PAGE.format(before="<div>teaser</div>", body="3 &lt; 4"))
    assert [t for _, main, t in rows if main] == ["Title & more", "First line", "Second inline x", "3 < 4"]


def test_names_tell_noise_from_articles():
    page = (
        "<body class='page with-sidebar'><main class='content has-sidebar'><article class='post'><p>kept</p>"
        "<div class='post-comments'>gone</div><section id=comments>gone</section><article class=comment>gone</article>"
        "<p hidden>gone</p><p class='lead'>kept too</p><div role=search>gone</div></article></main></body>"
    )
    assert [t for _, _, t in extraction.blocks(page)] == ["kept", "kept too"]


def test_repeated_branches_go_and_articles_stay(spark):
    shell = "<html><body><div class=top>Same everywhere</div><div class=story><p>Own text {0}</p><p>Shared passage</p><p>More {0}</p></div></body></html>"
    rows = [(i, f"http://a.example/{i}", shell.format(i)) for i in range(12)] + [(99, "http://b.example/", shell.format(99))]
    got = {r.page_id: r for r in extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].text == "Own text 3\nShared passage\nMore 3" and got[3].n_chars == len(got[3].text)
    assert got[99].text.startswith("Same everywhere\n")  # one page tells nothing about its site


def test_odd_pages(spark):
    rows = [
        (1, None, None), (2, "x", ""), (None, "http://a.example", "<p>a<p>b"), (3, None, "no tags &amp; none"), (3, None, "no tags &amp; none"),
        (4, "http://a.example", "<article>cut <b>off"), (5, "http://a.example", "<div><article>x</div>y</article><!-- open"), (6, "u", "<" * 500),
        (7, "u", "<div>" * 3000 + "deep"),
    ]
    frame = spark.createDataFrame([(*r, "low") for r in rows], "page_id long, url string, html string, low string")
    got = Counter((r.page_id, r.text) for r in extraction.main_text(frame).collect())
    assert got[1, ""] == 1 and got[2, ""] == 1 and got[None, "a\nb"] == 1 and got[3, "no tags & none"] == 2
    assert got[4, "cut off"] == 1 and sum(got.values()) == len(rows) and got[7, "deep"] == 1
    assert extraction.main_text(frame.limit(0)).collect() == []


# --- fingerprints ---------------------------------------------------------------

def test_fingerprints_match_brute_force(docs, texts):
    rows = fingerprints.fingerprints(docs, range_bytes=100_000).collect()
    by_id = {}
    for i, t in texts:
        by_id[i] = t or ""
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0))
    want = Counter()
    for (i, t), (_, following) in zip(order, order[1:] + order[:1]):
        t, following = t or "", following or ""
        cut = len(t) // 4
        changed = t[: len(t) - cut] + following[:cut] if cut else t
        common = next((k for k, (a, b) in enumerate(zip(t, following)) if a != b), min(len(t), len(following)))
        want[i, len(t), hashlib.sha256(changed.encode()).hexdigest(), common] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.common_next) for r in rows) == want
    prints = {}
    for r in rows:
        assert prints.setdefault(by_id[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert len(set(prints.values())) == len(prints)


def test_spans_and_extensions():
    a, b = fingerprints.Prefixes("abcabcabx" * 50), fingerprints.Prefixes("zabcabcabx" * 50)
    assert fingerprints.same_span(a, 0, b, 1, 9) and not fingerprints.same_span(a, 0, b, 0, 3)
    assert fingerprints.longest_common_extension(a, 0, b, 1) == 9
    assert fingerprints.longest_common_extension(a, 0, a, 9) == 441
    assert a.windows(4)[7] == a.span(7, 11)


def test_one_row_follows_itself(spark, no_docs):
    row = fingerprints.fingerprints(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and row.near_next == 1.0
    assert fingerprints.fingerprints(no_docs).collect() == []


# --- pages that are not well made -------------------------------------------------

@pytest.mark.parametrize("page, want", [
    ("<p it's>Hello world don't go</p>", ["Hello world don't go"]),
    ("<p>one</p><!--><p>two</p><!---><p>three</p>", ["one", "two", "three"]),
    ("<p title='a>b' x=\"c>d\">q</p>", ["q"]), ("<p>x</p><!-- c --><p>y</p><!-- open <p>z</p>", ["x", "y"]),
    ("a<b c", ["a<b c"]), ("1 < 2 and 3 > 2", ["1 < 2 and 3 > 2"]), ("<p>a<p>b<div>c", ["a", "b", "c"]),
    ("<script>x</script foo><p>after</p>", ["after"]), ("</div></b><p>x</i></p>y", ["x", "y"]),
])
def test_malformed_markup_keeps_its_text(page, want):
    assert [text for _, _, text in extraction.blocks(page)] == want


def test_one_word_of_a_name_is_not_enough():
    """Names that could mean anything are left to the tree; boxes of noise go at once."""
    kept = ["market-share", "popular-science", "post-header", "search-for-life", "AdaLovelace", "commentary"]
    gone = ["ad", "related-posts", "comment-list", "share_buttons", "siteFooter", "newsletter box"]
    page = "<article>" + "".join(f'<div class="{c}" id="x{i}"><p>text {c}</p></div>' for i, c in enumerate(kept + gone)) + "</article>"
    assert [text for _, _, text in extraction.blocks(page)] == [f"text {c}" for c in kept]


HOSTILE = [
    "<a ", "<a b='", "<", "<!--", "<div>", "<div>x</span>", "<b>", "<li>x<div>", "<dt>x<b>", "<td>x", "<p>a < b ", "<a b=\"x' c='y\">z</a>",
    "<a b='\"><a c=\"'>", "<script>", "</div>", "<b><p>", "<ul><li><i>", "&amp;", "<a b='x>",
]


def test_a_hostile_page_takes_time_by_its_length():
    import time

    for unit in HOSTILE:
        for tail in ("", ">", "'>", "\">x</p>"):
            page = unit * (250_000 // len(unit)) + tail
            began = time.process_time()
            extraction.page_blocks(page)
            assert time.process_time() - began < 4, (unit, tail)
