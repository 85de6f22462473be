"""Exact Jaccard join of word shingles by PartEnum signatures."""

from __future__ import annotations

import zlib
from functools import lru_cache
from itertools import combinations
from math import comb, exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from plantpulse.llm.common import parts, settled, ship, text_bytes, unlisted, whole_text
from plantpulse.llm.graph import components, local_components, merged
from plantpulse.llm.manifest import ranked
from plantpulse.llm.memo import Memo

#: Elements that a signature should hold on average at least, so that unrelated sets seldom share one.
INFORMATIVE = 4.0
#: Bytes of a shingle's hash. Two sets of n and m shingles meet by chance with n * m / 2**48.
BYTES = 6
#: Bytes of a signature within its bucket; what meets by chance is checked anyway.
SIGNATURE_BYTES = 5
#: Sets compared in one task; larger families are compared block by block.
BLOCK = 512

_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters near ones (public splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(Memo):
    """64-bit hashes of words seen lately."""

    def __missing__(self, word: bytes) -> int:
        self.make_room()
        made = self[word] = xxhash.xxh3_64_intdigest(word)
        return made


HASHES = WordHashes(150_000)


def shortened(values: np.ndarray, width: int) -> bytes:
    """The upper `width` bytes of 64-bit numbers."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :]).tobytes()


def lengthened(data: bytes, width: int) -> np.ndarray:
    """Numbers of which shortened() gave the upper bytes; the lower ones are zero."""
    out = np.zeros((len(data) // width, 8), dtype=np.uint8)
    out[:, 8 - width :] = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def shingles(text: str, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of `words` words, A-Z in lower case.

    With fewer words the whole sequence is the only one; without words there is
    none. Hashes have BYTES bytes, in the upper end of 64-bit numbers.
    """
    found = text.encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, dtype=_U)
    codes = np.array(list(map(hashes.__getitem__, found)), dtype=_U)
    width = min(words, len(codes))
    out = np.full(len(codes) - width + 1, width, dtype=_U)
    for i in range(width):
        out = mixed(out + codes[i : len(codes) - width + 1 + i] * _U(2 * i + 3))
    return np.unique(out & ~_U((1 << 64 - 8 * BYTES) - 1))


# --- the domain: shared features and those of one document --------------------

_SLICED = "bucket int, slice long, docs boolean, counts binary, hashes binary"
_SHARED = "slice long, bucket int, docs boolean, counts binary, hashes binary"
_SETS = "doc_id long, size int, c1 long, c2 long, shared binary"


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(values).tobytes(), 1)


def _unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=kind)


def _sliced(words: int, buckets: int, slice_chars: int):
    """Shingles of a slice of documents, dealt into buckets by hash; one row for each bucket."""

    def rows_of(number: int, ids: list, sets: list[np.ndarray]):
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        every = np.concatenate(sets)
        doc = np.repeat(np.arange(len(sets)), sizes)
        # The upper bits choose the bucket: hashes of a document are in order, so are its buckets.
        bucket = ((every >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        every, doc, bucket = every[order], doc[order], bucket[order]
        cut = np.searchsorted(bucket, np.arange(buckets + 1))
        out = []
        for b in range(buckets):
            part = slice(cut[b], cut[b + 1])
            if cut[b] < cut[b + 1]:
                counts = np.bincount(doc[part], minlength=len(sets)).astype("<u4")
                out.append((b, number, False, _packed(counts), shortened(every[part], BYTES)))
        valid = np.array([i is not None for i in ids], dtype=np.uint8)
        keys = np.array([i if i is not None else 0 for i in ids], dtype="<i8")
        c1 = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype="<u8")
        c2 = np.array([xxhash.xxh3_64_intdigest(s.tobytes(), seed=1) for s in sets], dtype="<u8")
        info = keys.tobytes() + c1.tobytes() + c2.tobytes() + sizes.astype("<i8").tobytes() + valid.tobytes()
        out.append((number % buckets, number, True, _packed(sizes.astype("<u4")), zlib.compress(info, 1)))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int64()),
                pa.array([r[2] for r in out], pa.bool_()), pa.array([r[3] for r in out], pa.binary()),
                pa.array([r[4] for r in out], pa.binary()),
            ],
            names=["bucket", "slice", "docs", "counts", "hashes"],
        )

    def run(batches):
        hashes = HASHES.claim()
        number = TaskContext.get().partitionId() << 32
        ids, sets, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc)
                sets.append(shingles(text, words, hashes))
                size += len(text)
                if size >= slice_chars:
                    yield rows_of(number, ids, sets)
                    ids, sets, size, number = [], [], 0, number + 1
        if ids:
            yield rows_of(number, ids, sets)

    return run


def _held_twice(key, rows):
    """Of the features in a bucket, those in at least two documents; the documents' own rows pass through."""
    docs, counts, hashes = (rows[c].to_pylist() for c in ("docs", "counts", "hashes"))
    parts_ = [lengthened(h, BYTES) for d, h in zip(docs, hashes) if not d]
    keep = np.zeros(0, dtype=bool)
    if parts_:
        every = np.concatenate(parts_)
        order = np.argsort(every)
        same = np.diff(every[order]) == 0
        twice = np.zeros(len(every), dtype=bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        keep = twice
    out_counts, out_hashes, at = [], [], 0
    for d, c, h in zip(docs, counts, hashes):
        if d:
            out_counts.append(c)
            out_hashes.append(h)
            continue
        values, sizes = np.frombuffer(h, dtype=np.uint8).reshape(-1, BYTES), _unpacked(c, "<u4")
        mask = keep[at : at + len(values)]
        at += len(values)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        out_counts.append(_packed(np.bincount(owner[mask], minlength=len(sizes)).astype("<u4")))
        out_hashes.append(values[mask].tobytes())
    return pa.table({
        "slice": rows["slice"].combine_chunks(), "bucket": rows["bucket"].combine_chunks(),
        "docs": rows["docs"].combine_chunks(),
        "counts": pa.array(out_counts, pa.binary()), "hashes": pa.array(out_hashes, pa.binary()),
    })


def _gathered(num: int, den: int):
    """Each document of a slice with its shared features, if they are enough for any link."""

    def run(key, rows):
        docs, counts, hashes, buckets = (rows[c].to_pylist() for c in ("docs", "counts", "hashes", "bucket"))
        info = zlib.decompress(next(h for d, h in zip(docs, hashes) if d))
        n = len(info) // 33
        ids, c1, c2, sizes = (np.frombuffer(info, "<i8", n, 8 * n * i) for i in range(4))
        valid = np.frombuffer(info, np.uint8, n, 32 * n).astype(bool)
        shared: list[list[bytes]] = [[] for _ in range(n)]
        have = np.zeros(n, dtype=np.int64)
        for _, d, c, h in sorted(zip(buckets, docs, counts, hashes), key=lambda r: r[0]):
            if d:
                continue
            some = _unpacked(c, "<u4").astype(np.int64)
            have += some
            ends = (BYTES * np.cumsum(some)).tolist()
            for i in np.flatnonzero(some).tolist():
                shared[i].append(h[ends[i] - BYTES * int(some[i]) : ends[i]])
        may = (sizes > 0) & (den * have >= num * sizes)
        return pa.table({
            "doc_id": pa.array(ids, mask=~valid), "size": pa.array(sizes, pa.int32()),
            "c1": pa.array(c1), "c2": pa.array(c2),
            "shared": pa.array([b"".join(s) if ok else None for s, ok in zip(shared, may.tolist())], pa.binary()),
        })

    return run


# --- signatures ---------------------------------------------------------------

@lru_cache(maxsize=None)
def bands(num: int, den: int, upto: int) -> tuple[tuple[int, int], ...]:
    """Size bands [l, r] so that a set and any set similar enough lie in the same or in neighbouring bands."""
    out, low = [], 1
    while True:
        high = low * den // num
        out.append((low, high))
        if high >= upto:
            return tuple(out)
        low = high + 1


@lru_cache(maxsize=None)
def scheme(num: int, den: int, low: int, high: int) -> tuple[int, int, int, np.ndarray]:
    """First-level parts, second-level parts, parts that may differ, and the subsets that are left, for a band.

    Sets of which the smaller one is in the band and which are similar enough differ
    in at most k elements. In one of n1 parts of the domain they differ in at most k2,
    as n1 * (k2 + 1) > k; of its n2 parts then at least n2 - k2 agree, and the
    subsets of n2 - k2 parts are enumerated. Of the choices whose signatures hold
    enough elements the one with the fewest is taken; empty ones, which are replaced
    by as many as there are in all, count with their chance.
    """
    k = (den - num) * (high + high * den // num) // (den + num)
    best = None
    for k2 in range(0, min(k, 5) + 1):
        n1 = k // (k2 + 1) + 1
        for n2 in range(k2 + 1, k2 + 9) if k2 else (1,):
            cost, held = n1 * comb(n2, k2), low * (n2 - k2) / (n1 * n2)
            if cost > max(64, 4 * high):
                continue
            expected = cost + cost * cost * exp(-held)
            rank = (held < INFORMATIVE, expected if held >= INFORMATIVE else -held, expected)
            if best is None or rank < best[0]:
                best = (rank, n1, n2, k2)
    _, n1, n2, k2 = best
    subsets = np.zeros((n2, comb(n2, k2)), dtype=_U)
    for j, left in enumerate(combinations(range(n2), n2 - k2)):
        subsets[list(left), j] = 1
    return n1, n2, k2, subsets


def _cells(elements: np.ndarray, n1: int, n2: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum of scattered hashes, and number of elements, in each of n1 x n2 parts of the domain."""
    placed = mixed(elements + _U(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    part = ((placed >> _U(32)) * _U(n1 * n2) >> _U(32)).astype(np.int64)
    sums = np.zeros(n1 * n2, dtype=_U)
    np.add.at(sums, part, mixed(placed))
    return sums.reshape(n1, n2), np.bincount(part, minlength=n1 * n2).reshape(n1, n2).astype(_U)


def _enumerated(elements: np.ndarray, band: int, made, seed: int) -> tuple[np.ndarray, np.ndarray]:
    n1, n2, _, subsets = made
    sums, counts = _cells(elements, n1, n2, seed)
    slots = np.arange(n1 * subsets.shape[1], dtype=_U).reshape(n1, -1)
    place = mixed(slots + _U((band + 1) * 0x632BE59BD9B4E019 + seed & (2**64 - 1)))
    return (mixed(sums @ subsets + place)).ravel(), (counts @ subsets).ravel()


def signatures(elements: np.ndarray, size: int, num: int, den: int) -> list[tuple[int, int, np.ndarray]]:
    """PartEnum signatures of a set: for its own band, and for the one below as the larger of a pair.

    A band's number, its largest size, and the signatures.

    A signature of empty parts says nothing. Sets that agree in it also agree in a
    signature of a second, independent partition, so it is replaced by its pairs
    with all of those.
    """
    table = bands(num, den, max(64, 1 << int(size).bit_length()))
    own = next(i for i, (low, high) in enumerate(table) if low <= size <= high)
    out = []
    for band in (own, own - 1) if own else (own,):
        made = scheme(num, den, *table[band])
        sigs, held = _enumerated(elements, band, made, 1)
        empty = sigs[held == 0]
        some = [sigs[held > 0]]
        if len(empty):
            # One part more than may differ: the fewest signatures that a second partition can do with.
            plain = (made[0] * (made[2] + 1), 1, 0, np.ones((1, 1), dtype=_U))
            second, _ = _enumerated(elements, band, plain, 2)
            some.append(mixed(empty[:, None] ^ (second[None, :] * _U(3))).ravel())
        out.append((band, table[band][1], np.concatenate(some)))
    return out


_SIGNED = "bucket int, sigs binary, runs binary, docs binary, sketches binary"


def sketch_words(high: int) -> int:
    """64-bit words of a sketch for sets of up to `high` elements: a power of two, a bit or more for each."""
    return 1 << max(0, (high - 1).bit_length() - 6)


def sketch(elements: np.ndarray, words: int) -> np.ndarray:
    """Parities of the elements that fall on each bit. Sketches of two sets differ in no more bits than the sets in elements."""
    bits = (mixed(elements ^ _U(0x5851F42D4C957F2D)) & _U(64 * words - 1)).astype(np.int64)
    odd = (np.bincount(bits, minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<u8")


def folded(rows: np.ndarray, words: int) -> np.ndarray:
    """Sketches of fewer words: halves laid on each other, as parities of half as many bits."""
    while rows.shape[-1] > words:
        half = rows.shape[-1] // 2
        rows = rows[..., :half] ^ rows[..., half:]
    return rows


def _signed(num: int, den: int, buckets: int, at_once: int = 1 << 20):
    """Signatures of a slice of sets, dealt into buckets; with each bucket the sketches of its sets."""

    def rows_of(docs: list[tuple], sigs: list[np.ndarray], owner: list[int], bands_: list[int]):
        every = np.concatenate(sigs)
        lengths = [len(s) for s in sigs]
        doc, band = np.repeat(np.array(owner, "<u4"), lengths), np.repeat(np.array(bands_, "<u4"), lengths)
        bucket = (every % _U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        every, doc, band = every[order], doc[order], band[order]
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out: tuple[list, ...] = ([], [], [], [], [])
        for b, (start, end) in enumerate(zip(cut, cut[1:])):
            if start == end:
                continue
            held, local = np.unique(doc[start:end], return_inverse=True)
            code = local.astype(np.int64) << 16 | band[start:end]
            first = np.flatnonzero(np.diff(code, prepend=-1))
            out[0].append(b)
            out[1].append(shortened(every[start:end], SIGNATURE_BYTES))
            out[2].append(_packed(np.stack([code[first], np.diff(np.append(first, end - start))]).astype("<i8")))
            out[3].append(b"".join(np.array(docs[d][:4], "<i8").tobytes() for d in held.tolist()))
            out[4].append(b"".join(docs[d][4] for d in held.tolist()))
        kinds = (pa.int32(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(out, kinds)], names=["bucket", "sigs", "runs", "docs", "sketches"]
        )

    def run(batches):
        docs, sigs, owner, bands_, size = [], [], [], [], 0
        for batch in batches:
            for node, n, shared in zip(*(c.to_pylist() for c in batch.columns)):
                elements = lengthened(shared, BYTES)
                words = 1
                for band, high, some in signatures(elements, n, num, den):
                    sigs.append(some)
                    owner.append(len(docs))
                    bands_.append(band)
                    size += len(some)
                    words = max(words, sketch_words(high))
                docs.append((node, n, len(elements), words, sketch(elements, words).tobytes()))
                if size >= at_once:
                    yield rows_of(docs, sigs, owner, bands_)
                    docs, sigs, owner, bands_, size = [], [], [], [], 0
        if docs:
            yield rows_of(docs, sigs, owner, bands_)

    return run


def near_enough(a: np.ndarray, b: np.ndarray, size: np.ndarray, held: np.ndarray, rows: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of sets may link, by what is known without their elements.

    Linked sets of sizes x and y differ in at most (den - num) (x + y) / (den + num)
    elements. Features of one document alone are among these, and sketches of the
    others differ in no more bits than the sets. So no linked pair is lost.
    """
    out = np.zeros(len(a), dtype=bool)
    step = max(1, (1 << 22) // max(1, rows.shape[1]))
    for at in range(0, len(a), step):
        x, y = a[at : at + step], b[at : at + step]
        total = size[x] + size[y]
        most = (den - num) * total // (den + num) - (total - held[x] - held[y])
        apart = np.bitwise_count(rows[x] ^ rows[y]).sum(axis=1, dtype=np.int64)
        out[at : at + step] = (apart <= most) & (den * np.minimum(size[x], size[y]) >= num * np.maximum(size[x], size[y]))
    return out


def _all_pairs(label: np.ndarray, some: np.ndarray, size, held, sketches: np.ndarray, num: int, den: int) -> np.ndarray:
    """Labels after all pairs of some sets that may link have been joined, a stretch of rows at a time."""
    for at in range(0, len(some), 64):
        rows = np.arange(at, min(at + 64, len(some)))
        a, b = np.repeat(rows, len(some)), np.tile(np.arange(len(some)), len(rows))
        open_ = (a < b) & (label[some[a]] != label[some[b]])
        a, b = a[open_], b[open_]
        ok = near_enough(a, b, size[some], held[some], sketches, num, den)
        label = merged(label, some[a[ok]], some[b[ok]])
    return label


def _sharing(num: int, den: int):
    """A forest over the sets that share a signature of a bucket and may link: at most one edge for each set.

    Members of a signature that are not yet in one tree are compared at growing
    steps of their order, so every pair that could join two trees is looked at and
    none that could not; the pairs stay in the task.
    """

    def run(key, rows):
        docs = [np.frombuffer(d, "<i8").reshape(-1, 4) for d in rows["docs"].to_pylist()]
        info = np.concatenate(docs)
        node, size, held, words = info.T
        starts = np.concatenate([[0], np.cumsum(words)])
        bits = np.frombuffer(b"".join(rows["sketches"].to_pylist()), "<u8")
        sigs = np.concatenate([lengthened(x, SIGNATURE_BYTES) for x in rows["sigs"].to_pylist()])
        owner, band, first = [], [], 0
        for runs, some in zip(rows["runs"].to_pylist(), docs):
            code, lengths = _unpacked(runs, "<i8").reshape(2, -1)
            owner.append(np.repeat((code >> 16) + first, lengths))
            band.append(np.repeat(code & 0xFFFF, lengths))
            first += len(some)
        owner, band = np.concatenate(owner), np.concatenate(band)
        order = np.lexsort((owner, sigs, band))
        owner, sigs, band = owner[order], sigs[order], band[order]
        # Only signatures of two sets or more.
        new = np.diff(sigs, prepend=sigs[:1] + _U(1)).astype(bool) | (np.diff(band, prepend=band[:1] - 1) != 0)
        group = np.cumsum(new) - 1
        counts = np.bincount(group)
        keep = counts[group] > 1
        owner, group, band = owner[keep], group[keep], band[keep]
        label = np.arange(len(node))
        table = bands(num, den, max(64, 1 << int(size.max()).bit_length()))
        cut = np.flatnonzero(np.diff(band, prepend=-1)).tolist() + [len(band)]
        for at, end in zip(cut, cut[1:]):
            members, groups = owner[at:end], group[at:end]
            width = sketch_words(table[int(band[at])][1])
            some, place = np.unique(members, return_inverse=True)
            sketches = np.stack([folded(bits[starts[d] : starts[d + 1]], width) for d in some.tolist()])
            step = 1
            while len(members) > step:
                # Few sets in many large signatures: every pair of the sets once is less work.
                every = np.unique(place)
                if len(every) ** 2 * max(1, width // 4) < (np.bincount(groups).astype(float) ** 2).sum():
                    label = _all_pairs(label, some[every], size, held, sketches[every], num, den)
                    break
                a, b = place[:-step], place[step:]
                open_ = (groups[:-step] == groups[step:]) & (label[members[:-step]] != label[members[step:]])
                if open_.any():
                    pairs = np.unique(a[open_].astype(np.int64) * len(some) + b[open_])
                    a, b = pairs // len(some), pairs % len(some)
                    ok = near_enough(a, b, size[some], held[some], sketches, num, den)
                    label = merged(label, some[a[ok]], some[b[ok]])
                # Go on with the signatures whose members are in several trees and reach further than this step.
                low, high = np.full(int(groups[-1]) + 1, len(node)), np.full(int(groups[-1]) + 1, -1)
                np.minimum.at(low, groups, label[members])
                np.maximum.at(high, groups, label[members])
                going = (low != high)[groups] & (np.bincount(groups)[groups] > step + 1)
                members, groups, place = members[going], groups[going], place[going]
                step += 1
        own = np.flatnonzero(label != np.arange(len(node)))
        return pa.table({"a": pa.array(node[own], pa.int64()), "b": pa.array(node[label[own]], pa.int64())})

    return run


# --- exact check --------------------------------------------------------------

def intersections(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of two lists of sets, from 0/1 matrices over the elements in at least two sets."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    names, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = np.cumsum(counts > 1) - 1
    keep = counts[place] > 1
    owner, place = owner[keep], often[place[keep]]
    out = np.zeros((len(rows), len(columns)), dtype=np.float32)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for start in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        part = slice(*np.searchsorted(place, (start, start + width)))
        held = np.zeros((len(sets), width), dtype=np.float32)
        held[owner[part], place[part] - start] = 1
        out += held[rows] @ held[columns].T
    return out.astype(np.int64)


_LINKED = "a long, b long, links long"


def _linked(num: int, den: int):
    """Exact links within the families of a group: a forest over linked sets, and each one's number of links."""

    def run(key, rows):
        fam, block, other, node, size, copies = (
            rows[c].to_numpy() for c in ("family", "block", "other", "node", "size", "copies")
        )
        shared = rows["shared"].to_pylist()
        order = np.lexsort((node, fam))
        cut = np.flatnonzero(np.diff(fam[order], prepend=fam[order][0] - 1 if len(order) else 0)).tolist() + [len(order)]
        out: tuple[list, list, list] = ([], [], [])
        for at, end in zip(cut, cut[1:]):
            some = order[at:end]
            sets = [lengthened(shared[i], BYTES) for i in some]
            within = block[some] == other[some]
            if within.all():
                left = right = np.arange(len(some))
            else:  # two blocks: only pairs across
                lower = block[some] < other[some]
                left, right = np.flatnonzero(lower), np.flatnonzero(~lower)
                if not len(left) or not len(right):
                    continue
            both = intersections(sets, left, right)
            union = size[some][left][:, None] + size[some][right][None, :] - both
            link = den * both >= num * union
            if within.all():
                np.fill_diagonal(link, False)
            i, j = np.nonzero(link)
            weight = copies[some]
            links = np.zeros(len(some), dtype=np.int64)
            np.add.at(links, left[i], weight[right[j]])
            if not within.all():
                np.add.at(links, right[j], weight[left[i]])
            label = local_components(len(some), left[i], right[j])
            for x in np.flatnonzero(links).tolist():
                out[0].append(int(node[some[x]]))
                out[1].append(int(node[some[label[x]]]))
                out[2].append(int(links[x]))
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("a", "b", "links"), out)})

    return run


def _families(classes: DataFrame, family: DataFrame, tasks: int) -> DataFrame:
    """Sets with their family, and once for each pair of blocks of a large one."""
    sizes = family.groupBy("label").agg(F.count("*").alias("members"))
    placed = (
        classes.join(family, "node").join(sizes, "label")
        .withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    )
    return placed.withColumn(
        "task",
        F.when(F.col("blocks") == 1, F.concat_ws("/", F.lit("small"), F.pmod(F.xxhash64("label"), F.lit(tasks))))
        .otherwise(F.concat_ws("/", "label", F.least("block", "other"), F.greatest("block", "other"))),
    ).select("task", F.col("label").alias("family"), "block", "other", "node", "size", "copies", "shared")


def jaccard_components(
    docs: DataFrame, words: int = 3, num: int = 90, den: int = 100,
    bucket_bytes: int = 4 << 20, slice_chars: int = 8 << 20,
) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every document.

    Two documents link if den * intersection >= num * union of their sets of
    `words`-word shingles; the component_id is the smallest doc_id reachable by
    links. The result is exact (up to 48-bit hashes of shingles):

    1. The domain is parted into features that one document holds and the rest.
       Features travel as packed blocks, one for a slice of documents and a bucket
       of hashes. Only sets of which `num`/`den` are shared features can link.
    2. Equal sets become one class. Classes get PartEnum signatures; those that
       share one, and may link by their sizes and sketches, are joined into families
       by a forest, never by pairs.
    3. Links within a family are computed exactly, in tasks of at most two blocks
       of 512 sets each, and only a forest of them and counts leave a task.

    A document without words is linked with nothing and its own component. Null
    text counts as empty. Rows with the same doc_id are separate documents with one
    id; a null id is nobody's smallest. An empty table gives no rows. Other columns
    are ignored. n_links counts linked documents, copies included.
    """
    ship(docs.sparkSession)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    buckets = parts(text_bytes(chosen), bucket_bytes)
    sets = settled(
        chosen.mapInArrow(_sliced(words, buckets, slice_chars), _SLICED)
        .groupBy("bucket").applyInArrow(_held_twice, _SHARED)
        .groupBy("slice").applyInArrow(_gathered(num, den), _SETS)
    )
    classes = settled(
        sets.filter("shared is not null").groupBy("c1", "c2")
        .agg(
            F.first("size").alias("size"), F.min("doc_id").alias("least"),
            F.count("*").alias("copies"), F.first("shared").alias("shared"),
        )
        .withColumnRenamed("c1", "node")
    )
    number, held = classes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    signed = classes.select("node", "size", "shared").mapInArrow(_signed(num, den, max(48, parts(held, 1 << 20))), _SIGNED)
    family = components(signed.groupBy("bucket").applyInArrow(_sharing(num, den), "a long, b long"))
    linked = settled(
        _families(classes.select("node", "size", "copies", "shared"), family, max(97, parts(number, BLOCK)))
        .groupBy("task").applyInArrow(_linked(num, den), _LINKED)
    )
    label = components(linked.select("a", "b"))
    counted = linked.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    whole = (
        classes.select("node", "c2", "least", "copies").join(label, "node", "left").join(counted, "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
    )
    least = whole.groupBy("label").agg(F.min("least").alias("component_id"))
    known = whole.join(least, "label").select(
        F.col("node").alias("c1"), "c2", "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    return sets.select("doc_id", "size", "c1", "c2").join(known, ["c1", "c2"], "left").select(
        "doc_id", F.col("size").cast("long").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents, all columns, without those that are near copies of one with a smaller id.

    The document whose id is its group's component_id stays. Where ids stand more
    than once, rows are told apart by their texts: every row is a document, of
    equal ids the shorter text (then the text that is first) counts as the
    smaller, and of rows equal in id and text one stays. Documents without an id
    cannot be told apart and stay.
    """
    again = docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null")
    if again.isEmpty():
        groups = settled(jaccard_components(docs, words, num, den).select("doc_id", "component_id"))
        return unlisted(docs, groups.filter("component_id < doc_id").select("doc_id"))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.filter("doc_id is not null").select(
        F.lit("").alias("tree"), "doc_id", F.length(whole_text()).alias("n"), whole_text().alias("text"), whole
    )
    numbered = settled(ranked(rows, ["doc_id", "n", "text"]))
    groups = jaccard_components(numbered.select(F.col("rank").alias("doc_id"), "text"), words, num, den)
    copies = settled(groups.filter("component_id < doc_id").select(F.col("doc_id").alias("rank")))
    kept = unlisted(numbered, copies, "rank").dropDuplicates(["doc_id", "text"]).select("row.*")
    return kept.unionByName(docs.filter("doc_id is null"))
