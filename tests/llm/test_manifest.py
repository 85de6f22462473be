"""The manifest against a plain tree built in memory."""

import hashlib
import random
import zlib

import pytest

from plantpulse.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, size int, lo string, kids string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(digests):
    """The root, and for each leaf the digests (left, right) beside its ancestors."""
    sides, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for leaf, place in enumerate(at):
            run, k = runs[place // 16], place % 16
            sides[leaf].append((run[:k], run[k + 1 :]))
            at[leaf] = place // 16
        level = [h(*run) for run in runs]
    return level[0], sides


def plain(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append((row, h(*map(enc, row[:5]))))
    trees = {}
    for source, held in by_source.items():
        held.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[source] = (held, *climb([d for _, d in held]))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    root, over = climb([trees[s][1] for s in order])
    out = []
    for source, above in zip(order, over):
        held, subroot, sides = trees[source]
        for rank, ((row, leaf), own) in enumerate(zip(held, sides)):
            path = own + above
            text = row[4]
            folded = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and text is not None:
                low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
                folded = h(*map(enc, (*row[:4], low)))
            for left, right in path:
                folded = h(*left, folded, *right)
            out.append((row[0], leaf, subroot, root, h(*(d for l, r in path for d in l + r)), folded, rank, folded == root))
    return out


def rows_of(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["hot", "hot", "hot", "hot", None, "", "é", "z", f"s{rng.randrange(40)}"])
        text = rng.choice([None, "", "Some Text", "lower only", "ÄÖ É", "x" * 5000 + "Y", "日本 A"])
        rows.append((rng.choice([i, i, i, 7, None, -i]), source, rng.choice(["en", None]), rng.choice([None, i]), text, "t", 1, "lo", "k"))
    return rows


@pytest.mark.parametrize("n", [1, 2, 16, 17, 700])
def test_every_row_against_a_plain_tree(spark, n):
    rows = rows_of(n, n)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = manifest.proofs(docs, manifest.every_fifth(docs["doc_id"]))
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "leaf_rank", "verified"]
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, plain(rows)))


def test_tampering_is_found_and_only_tampering(spark):
    docs = spark.createDataFrame([(i, "one" if i % 3 else "two", "en", i, f"Text {i}") for i in range(60)], SCHEMA.split(", tree")[0])
    for row in manifest.proofs(docs, manifest.every_fifth(docs["doc_id"])).collect():
        assert row.verified == (zlib.crc32(str(row.doc_id).encode()) % 5 != 0)
    assert all(r.verified for r in manifest.proofs(docs).collect())


def test_nodes_cover_their_trees(spark):
    rows = rows_of(5, 400)
    nodes = manifest.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    by_level = {}
    for n in nodes:
        by_level.setdefault((n.tree, n.level), []).append((n.lo, n.hi))
    for spans in by_level.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    changed = [(*r[:4], "other", *r[5:]) if i == 11 else r for i, r in enumerate(rows)]
    again = manifest.manifest(spark.createDataFrame(changed, SCHEMA)).collect()
    assert {n.tree for n in set(again) - set(nodes)} == {manifest_tree(rows[11][1])}


def manifest_tree(source):
    return enc(source)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert manifest.proofs(none, manifest.every_fifth(none["doc_id"])).collect() == []
    assert manifest.manifest(none).collect() == []
