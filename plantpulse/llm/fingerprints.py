"""Document fingerprints from prefix polynomial hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plantpulse.llm.common import parts, ship, text_bytes, whole_text

#: Two prime moduli below 2**31, so that products fit 64 bits, with a base each.
MODULI = (2147483647, 2147483629)
BASES = (1103515245, 911382323)
#: Windows are this many code points; a sketch keeps this many of their least hashes.
WINDOW, SKETCH = 12, 64


def _powers(base: int, mod: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo mod, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    done, step = 1, base % mod
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step) % np.uint64(mod)
        step = step * step % mod
        done += more
    return out[:n]


class PowerTable:
    """Powers of the bases and of their inverses, grown when a longer text comes."""

    def __init__(self):
        self.n = 0
        self.up: list[np.ndarray] = []
        self.down: list[np.ndarray] = []

    def upto(self, n: int):
        if n > self.n:
            self.n = max(n, 2 * self.n, 4096)
            self.up = [_powers(b, m, self.n) for b, m in zip(BASES, MODULI)]
            self.down = [_powers(pow(b, -1, m), m, self.n) for b, m in zip(BASES, MODULI)]
        return self.up, self.down


POWERS = PowerTable()


class Prefixes:
    """Prefix arrays of a text: any span's hash in constant time.

    h[i] is the sum of code[j] * base**j over j < i, so (h[j] - h[i]) * base**-i
    depends only on the span's characters, wherever it stands.
    """

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        up, self.down = POWERS.upto(self.n + 1)
        self.h = []
        for power, mod in zip(up, MODULI):
            h = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(codes * power[: self.n] % np.uint64(mod), out=h[1:])
            self.h.append(h % np.uint64(mod))

    def span(self, start: int, end: int) -> int:
        """Hash of [start, end): 62 bits."""
        out = 0
        for h, down, mod in zip(self.h, self.down, MODULI):
            out = out << 31 | (int(h[end]) - int(h[start])) % mod * int(down[start]) % mod
        return out

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all spans of a width (of the whole text, if it is shorter)."""
        width = min(width, self.n)
        if not self.n:
            return np.zeros(0, dtype=np.uint64)
        out = np.zeros(self.n - width + 1, dtype=np.uint64)
        for h, down, mod in zip(self.h, self.down, MODULI):
            m = np.uint64(mod)
            out = (out << np.uint64(31)) | (h[width:] + m - h[: self.n - width + 1]) % m * down[: self.n - width + 1] % m
        return out


def same_span(a: Prefixes, i: int, b: Prefixes, j: int, length: int) -> bool:
    return a.span(i, i + length) == b.span(j, j + length)


def longest_common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """How many characters agree from a[i] and b[j] on, by binary search over span hashes."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if same_span(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters near ones (public splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(prefixes: Prefixes) -> np.ndarray:
    """The least distinct scattered window hashes, in order; all of them if there are fewer."""
    hashes = _mixed(prefixes.windows(WINDOW))
    if len(hashes) > 16 * SKETCH:
        least = np.unique(np.partition(hashes, 8 * SKETCH)[: 8 * SKETCH])
        if len(least) >= SKETCH:
            return least[:SKETCH]
    return np.unique(hashes)[:SKETCH]


def fingerprint_of(prefixes: Prefixes) -> tuple[str, np.ndarray]:
    """length-hash-sketch in hexadecimal; the same text always gives the same fingerprint."""
    least = sketch(prefixes)
    digits = "".join(f"{x >> 32:08x}" for x in least.tolist())
    return f"{prefixes.n:x}-{prefixes.span(0, prefixes.n):016x}-{digits}", least


def sketch_of(fingerprint: str) -> list[int]:
    digits = fingerprint.rsplit("-", 1)[1]
    return [int(digits[i : i + 8], 16) for i in range(0, len(digits), 8)]


def likeness(a: str, b: str) -> float:
    """Estimated share of windows in common (Dice) of two fingerprints: 1 for equal texts, 0 for foreign ones."""
    if a == b:
        return 1.0
    x, y = set(sketch_of(a)), set(sketch_of(b))
    if not x or not y:
        return 0.0
    union = sorted(x | y)[:SKETCH] if max(len(x), len(y)) >= SKETCH else sorted(x | y)
    both = sum(1 for u in union if u in x and u in y)
    jaccard = both / len(union)
    return 2 * jaccard / (1 + jaccard)


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by as much of the beginning of the following one."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut] if cut else text


_OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, common_edited long, common_next long"
)


def _rows(batches):
    """Rows come in order within a range; the last of a range is there only to be read by the one before it."""
    waiting, heads = None, {}
    cells: list[tuple] = []

    def made(row, following):
        (doc, text, prefixes, print_), (_, text2, prefixes2, print2) = row, following
        changed = edited(text, text2)
        p = Prefixes(changed)
        changed_print = fingerprint_of(p)[0]
        return (
            doc, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), print_, changed_print,
            likeness(print_, changed_print), likeness(print_, print2),
            longest_common_extension(prefixes, 0, p, 0), longest_common_extension(prefixes, 0, prefixes2, 0),
        )

    def batch_of(rows):
        schema = pa.schema([
            ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
            ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
            ("near_next", pa.float64()), ("common_edited", pa.int64()), ("common_next", pa.int64()),
        ])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        for range_, doc, text, borrowed in zip(*(c.to_pylist() for c in batch.columns)):
            if waiting and waiting[0] != range_:
                waiting = None
            prefixes = Prefixes(text)
            row = (doc, text, prefixes, fingerprint_of(prefixes)[0])
            if waiting:
                cells.append(made(waiting[1], row))
            waiting = None if borrowed else (range_, row)
            if len(cells) >= 512:
                yield batch_of(cells)
                cells = []
    if cells:
        yield batch_of(cells)


def _ranges(cuts: list[int], firsts: dict[tuple[int, int], int] | None):
    """Number each row's range; with `firsts`, send the first row of a range to the range before it as well."""
    edges = np.array(cuts, dtype=np.int64)

    def run(batches):
        for batch in batches:
            keys, hashes = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            number = np.searchsorted(edges, keys, side="right").astype(np.int32)
            if firsts is None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number), batch.column(1), batch.column(2)], names=["range", "key", "hash"]
                )
                continue
            doc, text = batch.column(0), batch.column(3)
            rows = [i for i, k in enumerate(zip(keys.tolist(), hashes.tolist())) if k in firsts]
            to = [firsts[int(keys[i]), int(hashes[i])] for i in rows]
            for at, where, lent in ((pa.array(range(len(keys))), number, False), (pa.array(rows, pa.int64()), to, True)):
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(where, pa.int32()), doc.take(at), batch.column(1).take(at),
                            batch.column(2).take(at), text.take(at), pa.array([lent] * len(at)),
                        ],
                        names=["range", "doc_id", "key", "hash", "text", "borrowed"],
                    )

    return run


def fingerprints(docs: DataFrame, range_bytes: int = 2 << 20) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how near they are.

    Documents are cut into ranges of doc_id of about `range_bytes` of text by
    quantiles. The first document of a range is also sent to the range before it,
    as the last one's successor; the first of all follows the last of all. So one
    shuffle of the texts is enough, a task streams its sorted range with two texts
    in memory, and no window sees the whole table. The driver holds one id and
    hash per range. Likeness compares fingerprints only: an estimate of the share
    of windows of 12 characters in common.

    Extra columns: common_edited and common_next, the longest common beginning
    with the edited and with the next text (binary search over span hashes).

    Null text is empty. Equal ids follow each other by the hash of their texts;
    null ids come first; a table of one row follows itself; an empty table gives
    no rows. Other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"),
        F.xxhash64(whole_text()).alias("hash"), whole_text().alias("text"),
    )
    count = parts(text_bytes(rows), range_bytes)
    cuts = rows.approxQuantile("key", [i / count for i in range(1, count)], 0.2 / count) if count > 1 else []
    cuts = sorted({int(c) for c in cuts})
    least = (
        rows.select("doc_id", "key", "hash").mapInArrow(_ranges(cuts, None), "range int, key long, hash long")
        .groupBy("range").agg(F.min(F.struct("key", "hash")).alias("first"))
        .orderBy("range").collect()
    )
    # The range before each; the first one's is the last.
    firsts = {(r.first.key, r.first.hash): least[i - 1].range for i, r in enumerate(least)}
    dealt = rows.mapInArrow(
        _ranges(cuts, firsts), "range int, doc_id long, key long, hash long, text string, borrowed boolean"
    )
    return (
        dealt.repartition(count, "range")
        .sortWithinPartitions("range", "borrowed", "key", "hash")
        .select("range", "doc_id", "text", "borrowed")
        .mapInArrow(_rows, _OUT)
    )
