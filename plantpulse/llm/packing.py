"""Packing documents into sequences: first-fit decreasing in randomised groups."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plantpulse.llm.codec import REMEMBERED, word_ids
from plantpulse.llm.common import parts, ship, whole_text

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
_DOCS = "doc_id long, doc_tokens long, crcs array<long>"


class BinTree:
    """A tournament tree over the room left in bins; a match is won by the larger room.

    `place(size)` goes down from the root to the leftmost bin with enough room,
    in a number of steps that is the logarithm of the number of bins.
    """

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < bins:
            self.leaves *= 2
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """The bin and how much of its room is left afterwards."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        room[node] -= size
        left, bin_ = room[node], node - self.leaves
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return bin_, left


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each size (none above the capacity, none zero), and the number of bins.

    Equal sizes go in the order given.
    """
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    tree = BinTree(max(1, len(sizes)), capacity)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        bins[i], left = tree.place(size)
        offsets[i] = capacity - left - size
    return bins, offsets, int(bins.max()) + 1 if len(sizes) else 0


def _tokenised(path: str, capacity: int, end_id: int, remembered: int):
    end, step = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity

    def run(batches):
        words = word_ids(path, remembered)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            tokens, crcs = [], []
            for ids in words.of_texts(texts):
                ids += end
                tokens.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[a : a + step]) for a in range(0, len(ids), step)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))],
                names=["doc_id", "doc_tokens", "crcs"],
            )

    return run


def _packed(capacity: int):
    def run(key, docs):
        group = key[0].as_py()
        tokens = docs["doc_tokens"].to_numpy()
        crcs = docs["crcs"].combine_chunks()
        full, rest = tokens // capacity, tokens % capacity
        order = np.flatnonzero(rest)
        bins, offsets, used = first_fit_decreasing(rest[order], capacity)
        bin_of, offset_of = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
        bin_of[order], offset_of[order] = bins, offsets
        # A document's full pieces are sequences of their own, numbered after the shared ones.
        count = full + (rest > 0)
        row = np.repeat(np.arange(len(tokens)), count)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        whole = piece < full[row]
        number = np.where(whole, used + (np.cumsum(full) - full)[row] + piece, bin_of[row])
        return pa.table({
            "doc_id": docs["doc_id"].combine_chunks().take(pa.array(row)),
            "start": piece * capacity,
            "length": np.where(whole, capacity, rest[row]),
            "ids_crc32": crcs.flatten(),
            "doc_tokens": tokens[row],
            "sequence_id": (np.int64(group) << np.int64(32)) + number,
            "offset": np.where(whole, 0, offset_of[row]),
        })

    return run


def pack(
    docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2,
    group_rows: int = 8192, seed: int = 17, remembered: int = REMEMBERED,
) -> DataFrame:
    """Documents cut and packed into sequences of at most `capacity` tokens, one row per piece.

    A document is the ids of its text (null: empty) with `end_id` behind them. It
    is cut at multiples of the capacity; full pieces fill a sequence each, and
    what is left over is packed by first-fit decreasing, in randomised groups of
    about `group_rows` documents, so that no task sees more than its group. The
    groups are drawn at random per row, hence even for repeated ids; each leaves
    about one sequence that is not full. Ids stay in the task that made them:
    only lengths and checksums are shuffled. A worker remembers the ids of at most
    `remembered` words: with fewer it takes less memory and encodes more often.

    Reads doc_id and text and ignores all other columns, whatever their names. An
    empty text is one piece with the end id only; an empty table gives no rows;
    rows with equal or null doc_id are packed as documents of their own. Sequence
    ids are unique, not dense.
    """
    ship(docs.sparkSession)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    groups = parts(docs.count(), group_rows)
    tokenised = chosen.mapInArrow(_tokenised(tokenizer_path, capacity, end_id, remembered), _DOCS)
    grouped = tokenised.withColumn("_group", F.floor(F.rand(seed) * groups).cast("long"))
    return grouped.groupBy("_group").applyInArrow(_packed(capacity), SCHEMA)
