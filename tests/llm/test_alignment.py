"""Alignments against whole texts encoded in one call and compared byte by byte."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from plantpulse.llm import alignment

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def files(byte_file):
    import public_tokenizers

    return byte_file, str(public_tokenizers.path("piece_bpe_32k.model"))


def plain(files, text):
    """Links and groups of one text from the tokens' bytes alone; None without tokens."""
    if not text:
        return None
    a_tok, a_bytes = alignment.first_tokenizer(files[0])[:2]
    b_tok, b_bytes = alignment.second_tokenizer(files[1])[:2]
    a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
    data = (" " + text).encode()
    if b"".join(a_bytes[i] for i in a) != data or b"".join(b_bytes[i] for i in b) != data:
        return None
    owner_a = [k for k, i in enumerate(a) for _ in a_bytes[i]]
    owner_b = [k for k, i in enumerate(b) for _ in b_bytes[i]]
    links = sorted(set(zip(owner_a, owner_b)))
    groups, i, j = [], 0, 0
    for x in range(len(data)):
        if x + 1 == len(data) or (owner_a[x] != owner_a[x + 1] and owner_b[x] != owner_b[x + 1]):
            groups.append(",".join(map(str, a[i : owner_a[x] + 1])) + "|" + ",".join(map(str, b[j : owner_b[x] + 1])))
            i, j = owner_a[x] + 1, owner_b[x] + 1
    return a, b, groups, [(a[x], b[y]) for x, y in links]


def plain_rows(files, rows):
    found = [(i, plain(files, t)) for i, t in rows]
    total = Counter(pair for _, f in found if f for pair in f[3])
    most = {}
    for (_, b), n in total.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for i, f in found:
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links = f
            out.append((
                i, len(a), len(b), len(groups), len(links), sum(total[p] == most[p[1]] for p in links),
                sum(total[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest(),
            ))
    return sorted(map(repr, out))


ODD = [
    (20, "▁ is not given back"), (21, " lead"), (22, "tail "), (23, "a  b   c\n\nd\te"), (24, "\U0001F9EC \U0001F469‍\U0001F469 ①ﬁ Å ́x"),
    (25, "<|endoftext|> <s> </s> <0x41> <unk>"), (26, "don't we'll\x00 zero"), (27, "a\x1cb \x85 c d　e ​ f"),
    (28, "fine words and ▁"), (29, "中国 的 文字 中国的文字"), (30, " "), (31, "\n"), (32, "x\n y \n z"),
]


def test_every_text_against_whole_encodings(spark, docs, texts, files):
    more = spark.createDataFrame([(i, t, "s", 1, "x", 2, "b", 0.5) for i, t in ODD], docs.schema)
    got = alignment.alignments(docs.unionByName(more), *files, part_rows=4)
    assert got.columns == COLUMNS
    assert sorted(map(repr, map(tuple, got.collect()))) == plain_rows(files, texts + ODD)


def test_given_documents(spark, files):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = alignment.alignments(docs, *files)
    assert sorted(map(repr, map(tuple, got.collect()))) == plain_rows(files, rows)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab é\n\t.'s1中\U0001F9EC▁  é<|>")), max_size=40))
def test_units_say_what_the_whole_text_does(files, text):
    table, want = alignment.Units(*files), plain(files, text)
    n_a, n_b, n_groups, n_links, sha, codes, counts = next(table.texts([text]))
    if want is None:
        assert (n_a, n_b, n_groups, n_links, sha, len(codes)) == (0, 0, 0, 0, "", 0)
    else:
        a, b, groups, links = want
        assert (n_a, n_b, n_groups, n_links) == (len(a), len(b), len(groups), len(links))
        assert sha == hashlib.sha256(";".join(groups).encode()).hexdigest()
        assert dict(zip(codes.tolist(), counts.tolist())) == Counter((x << 32) + y for x, y in links)


@settings(max_examples=100, deadline=None)
@given(st.text(min_size=1, max_size=30))
def test_spans_are_refined_to_decoded_bytes(files, text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    found = alignment.token_ends(*files, text)
    if found is not None:
        a_ids, a_ends, b_ids, b_ends = found
        sizes_a = [len(alignment.first_tokenizer(files[0])[1][i]) for i in a_ids]
        sizes_b = [len(alignment.second_tokenizer(files[1])[1][i]) for i in b_ids]
        assert a_ends.tolist() == np.cumsum(sizes_a).tolist() and b_ends.tolist() == np.cumsum(sizes_b).tolist()


def test_long_texts_in_windows(files, monkeypatch):
    text = " ".join(f"word{i % 31} naïve中 x{i}" for i in range(3000))
    whole = next(alignment.Units(*files).texts([text]))
    monkeypatch.setattr(alignment, "_WINDOW", 500)
    cut = next(alignment.Units(*files).texts([text]))
    assert whole[:5] == cut[:5] and (whole[5] == cut[5]).all() and (whole[6] == cut[6]).all()


def test_no_rows(no_docs, files):
    assert alignment.alignments(no_docs, *files).collect() == []
