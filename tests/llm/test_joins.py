"""The Jaccard join, components and neighbours against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from plantpulse.llm import graph, jaccard_join, neighbours
from plantpulse.llm.jaccard_join import bands, scheme, signatures


def plain_sets(rows, words):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({65 + j: 97 + j for j in range(26)}))
        out.append(frozenset(tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))) if w else frozenset())
    return out


def plain_components(rows, words, num, den):
    sets = plain_sets(rows, words)
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return Counter((rows[i][0], len(sets[i]), least.get(find(i)), links[i]) for i in range(len(rows)))


def near_copies(seed, families=12, copies=9):
    """Families of texts with a few words changed, of sizes from a few words to some hundreds."""
    draw = random.Random(seed)
    rows = []
    for _ in range(families):
        words = [f"w{draw.randrange(4000)}" for _ in range(draw.choice([3, 5, 8, 14, 30, 60, 150, 400]))]
        for _ in range(copies):
            changed = list(words)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3, 5])):
                changed[draw.randrange(len(changed))] = f"x{draw.randrange(10**6)}"
            rows.append((len(rows) * 3 % 331, " ".join(changed)))
    return rows


@pytest.mark.parametrize("words,num,den", [(3, 90, 100), (5, 80, 100), (1, 80, 100)])
def test_components_match_brute_force(spark, words, num, den, monkeypatch):
    rows = near_copies(words)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.jaccard_components(frame, words, num, den, bucket_bytes=20_000, slice_chars=20_000)
    assert Counter(map(tuple, got.collect())) == plain_components(rows, words, num, den)


def test_large_families_are_compared_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    draw = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(draw.choice([0, 1, 1, 2, 3])):
            words[draw.randrange(60)] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100)
    assert Counter(map(tuple, got.collect())) == plain_components(rows, 3, 90, 100)


def test_join_of_odd_rows(docs, no_docs, texts):
    rows = [(i, t) for i, t in texts]
    assert Counter(map(tuple, jaccard_join.jaccard_components(docs).collect())) == plain_components(rows, 3, 90, 100)
    assert jaccard_join.jaccard_components(no_docs).collect() == []


def test_one_document_of_each_group(docs, no_docs, texts):
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    # 7 is a copy of 6 but for its case; 10 is 9 with a word more; 6 stands twice.
    assert Counter(r.doc_id for r in kept.collect()) == Counter(
        i for i in [1, 2, 3, 4, 5, 6, None, 9, 11, 12, 13, 14, 15]
    )
    assert jaccard_join.one_of_each(no_docs).collect() == []


def test_unique_texts_under_one_id_stay(spark):
    """An id that stands three times: a near copy of a smaller id goes, a repeated row goes, unique texts stay."""
    other = " ".join(f"tree{i}" for i in range(40))
    first = " ".join(f"word{i}" for i in range(40))
    rows = [(1, first), (2, first + " more"), (2, other), (2, other), (2, "short and unique"), (3, ""), (3, ""), (None, first), (4, other + " x")]
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted(
        [(1, first), (2, other), (2, "short and unique"), (3, ""), (None, first)], key=str
    )


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100)])
def test_similar_sets_share_a_signature(num, den):
    """At the very limit of similarity, for many sizes: the promise of the partition."""
    draw = np.random.default_rng(2)
    for size in (1, 2, 4, 5, 9, 10, 11, 19, 20, 37, 80, 200, 421):
        for _ in range(6):
            a = draw.integers(0, 2**63, size=size, dtype=np.uint64)
            # |b| >= |a|: drop d of a and add e, as long as the pair still links.
            d = int(draw.integers(0, max(1, size // 8) + 1))
            e = max((x for x in range(0, size) if den * (size - d) >= num * (size + x)), default=None)
            if e is None:
                continue
            b = np.concatenate([a[d:], draw.integers(0, 2**63, size=e, dtype=np.uint64)])
            found = [{(band, s) for band, _, some in signatures(x, len(x), num, den) for s in some.tolist()} for x in (a, b)]
            assert found[0] & found[1], (size, d, e)


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100)])
def test_sketches_lose_no_linked_pair(num, den):
    draw = np.random.default_rng(3)
    for size in (1, 5, 10, 30, 64, 65, 200, 700):
        a = draw.integers(0, 2**63, size=size, dtype=np.uint64)
        for words in (1, 4, 16):
            for drop in range(0, size, max(1, size // 10)):
                for add in (0, size // 12, size // 5):
                    b = np.concatenate([a[drop:], draw.integers(0, 2**63, size=add, dtype=np.uint64)])
                    if not len(b):
                        continue
                    rows = np.stack([jaccard_join.folded(jaccard_join.sketch(x, 32), words) for x in (a, b)])
                    assert (rows == np.stack([jaccard_join.sketch(x, words) for x in (a, b)])).all()
                    sizes = np.array([len(a), len(b)])
                    ok = jaccard_join.near_enough(np.array([0]), np.array([1]), sizes, sizes, rows, num, den)[0]
                    assert ok or den * (size - drop) < num * (size + add)


def test_bands_and_schemes_hold_their_promise():
    for num, den in ((90, 100), (80, 100)):
        table = bands(num, den, 5000)
        for (low, high), (after, _) in zip(table, table[1:]):
            assert after == high + 1 and den * low >= num * high
        for low, high in table[:40]:
            n1, n2, k2, subsets = scheme(num, den, low, high)
            k = (den - num) * (high + high * den // num) // (den + num)
            assert n1 * (k2 + 1) > k and n2 > k2 and (subsets.sum(axis=0) == n2 - k2).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(300, 200), (200, 300), (5, 5)]
    draw = random.Random(4)
    draw.shuffle(edges)
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 300: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- neighbours -----------------------------------------------------------------

def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, part string, rank int")


def exact(rows, every, k):
    ids = np.array([i for i, _ in rows])
    values = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        apart = np.sqrt(((values - values[q]) ** 2).sum(axis=1))
        keep = np.flatnonzero(ids != ids[q])
        order = keep[np.lexsort((ids[keep], apart[keep]))][:k]
        out[int(ids[q])] = [(int(ids[i]), float(apart[i])) for i in order]
    return out


def answers(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_against_brute_force(spark):
    draw = np.random.default_rng(0)
    centres = draw.normal(size=(8, 16))
    rows = [(i, (centres[i % 8] + 0.5 * draw.normal(size=16)).tolist()) for i in range(3000)]
    want = exact(rows, 100, 10)
    got = answers(neighbours.nearest_neighbours(vectors(spark, rows), shard_rows=512))
    assert got.keys() == want.keys() and all(len(g) == 10 for g in got.values())
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found >= 0.9 * 10 * len(want)
    scores = {q: dict(w) for q, w in exact(rows, 100, 3000).items()}
    assert all(s == pytest.approx(scores[q][i], abs=1e-12) for q, g in got.items() for i, s in g)


def test_hot_vectors_and_ties(spark):
    """A third of all rows are equal: ties go to the smaller ids, and the bucket is spread over parts."""
    draw = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else (5 * draw.normal(size=4)).round(3).tolist()) for i in range(900)]
    got = answers(neighbours.nearest_neighbours(vectors(spark, rows), shard_rows=64))
    want = exact(rows, 100, 10)
    for q in (0, 300, 600):
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert all(s == 0 for _, s in got[q])


def test_few_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(400, None), (500, []), (600, [0.0, 0.0]), (700, [1.0, nan]), (800, [inf, 1.0]), (900, [None, 1.0]), (1000, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [5.0, 5.0]), (4, [5.0, 5.0])]
    got = answers(neighbours.nearest_neighbours(vectors(spark, rows + odd)))
    assert {q: [i for i, _ in g] for q, g in got.items()} == {0: [3, 100, 4], 100: [3, 0, 4]}
    assert neighbours.nearest_neighbours(vectors(spark, odd[:6])).collect() == []
    assert neighbours.nearest_neighbours(vectors(spark, [(0, [1.0, 1.0])])).collect() == []
