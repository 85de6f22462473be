"""Token counts of whole texts; huge ones in overlapping chunks that are brought back in step."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plantpulse.llm.codec import tokenizer
from plantpulse.llm.common import settled, ship, whole_text
from plantpulse.llm.memo import Memo

_ODD_SPACE = re.compile(r"\s\s|[^\S \n]|^\s|\s\Z")
_BEFORE_UNIT = re.compile(r"(?<=\S)(?= \S)")
_CALL = 8192

_CHUNKS = "key string, chunk int, chunks int, start long, text string"
_EDGES = (
    "key string, chunk int, chunks int, tokens long, "
    "left_at array<long>, left_before array<long>, right_at array<long>, right_before array<long>"
)


class UnitCounts:
    """Token counts by parts of a text that never share a token with their neighbours.

    A byte-level tokenizer cuts before a space that stands between two visible
    characters, so the part from such a space to the next is counted by itself,
    and once however often it occurs. At most `limit` parts are remembered.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        self.path, self.known = path, Memo(limit)

    def learn(self, units: set[str]) -> dict[str, int]:
        """Counts of units that follow a space (not part of the key)."""
        self.known.claim().make_room(len(units))
        new = list(units - self.known.keys())
        for at in range(0, len(new), _CALL):
            some = new[at : at + _CALL]
            got = tokenizer(self.path).encode("".join(" " + u for u in some), add_special_tokens=False)
            starts = np.zeros(len(some) + 1, dtype=np.int64)
            np.cumsum([len(u) + 1 for u in some], out=starts[1:])
            cut = np.searchsorted(np.array([a for a, _ in got.offsets], dtype=np.int64), starts)
            self.known.update(zip(some, np.diff(cut).tolist()))
        return self.known

    def direct(self, text: str) -> int:
        return len(tokenizer(self.path).encode(text, add_special_tokens=False).ids)

    def of_texts(self, texts: list[str], together: int = 1 << 21) -> list[int]:
        counts, at, tails = [0] * len(texts), 0, {}
        while at < len(texts):
            size, split, heads = 0, [], []
            begin = at
            while at < len(texts) and (at == begin or size + len(texts[at]) <= together):
                size += len(texts[at])
                if _ODD_SPACE.search(texts[at]):
                    units = _BEFORE_UNIT.split(texts[at])
                    if len(units) > 1 and units[-1][-1].isspace():
                        tails[at] = units.pop()
                    split.append([u[1:] for u in units[1:]])
                    heads.append(units[0])
                else:
                    head, *rest = texts[at].split(" ")
                    split.append(rest)
                    heads.append(head)
                at += 1
            known = self.learn(set().union(*split))
            first = tokenizer(self.path).encode_batch(heads, add_special_tokens=False)
            for i, (head, units) in enumerate(zip(first, split)):
                counts[begin + i] = len(head.ids) + sum(map(known.__getitem__, units))
        for i, tail in tails.items():  # white space at the end of a text must meet nothing else
            counts[i] += self.direct(tail)
        return counts


@lru_cache(maxsize=4)
def unit_counts(path: str) -> UnitCounts:
    return UnitCounts(path)


def _counted(path: str):
    def run(batches):
        units = unit_counts(path)
        for batch in batches:
            counts = units.of_texts(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    return run


def cut(text: str, step: int, overlap: int) -> Iterator[tuple[int, str]]:
    """Start and text of each chunk: `step` characters of its own and `overlap` of the next one's."""
    start = 0
    while True:
        yield start, text[start : start + step + overlap]
        start += step
        if start + overlap >= len(text):
            return


def _chunked(step: int, overlap: int):
    def run(batches):
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pieces = list(cut(text, step, overlap))
                for at in range(0, len(pieces), 64):
                    some = pieces[at : at + 64]
                    yield pa.RecordBatch.from_pydict({
                        "key": [key] * len(some),
                        "chunk": pa.array(range(at, at + len(some)), pa.int32()),
                        "chunks": pa.array([len(pieces)] * len(some), pa.int32()),
                        "start": pa.array([s for s, _ in some], pa.int64()),
                        "text": [t for _, t in some],
                    })

    return run


def edges(path: str, text: str, start: int, overlap: int, step: int):
    """Tokens of a chunk, and the stable boundaries in the stretches it shares with its neighbours.

    A stable boundary is the start of a pre-token (never of a token inside one)
    that no cut can have moved: it is not the chunk's first, whose left context is
    missing, and text enough follows it to hold the longest special string.
    """
    tok = tokenizer(path)
    got = tok.encode(text, add_special_tokens=False)
    offsets, words = got.offsets, got.word_ids
    margin = 2 + max((len(t.content) for t in tok.get_added_tokens_decoder().values()), default=0)
    at = [i for i in range(1, len(words)) if words[i] is None or words[i] != words[i - 1]]
    left = [(start + offsets[i][0], i) for i in at if offsets[i][0] < overlap]
    right = [(start + offsets[i][0], i) for i in at if step <= offsets[i][0] <= len(text) - margin]
    return len(words), left, right


def _encoded(path: str, step: int, overlap: int):
    def run(batches):
        for batch in batches:
            rows = [
                edges(path, text, start, overlap, step)
                for start, text in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())
            ]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(2), pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([[x for x, _ in r[1]] for r in rows], longs),
                    pa.array([[n for _, n in r[1]] for r in rows], longs),
                    pa.array([[x for x, _ in r[2]] for r in rows], longs),
                    pa.array([[n for _, n in r[2]] for r in rows], longs),
                ],
                names=["key", "chunk", "chunks", "tokens", "left_at", "left_before", "right_at", "right_before"],
            )

    return run


def splice(chunks: list[dict]) -> int | None:
    """Tokens of the whole text from its chunks in order; None if two neighbours share no boundary."""
    total, taken = 0, 0
    for here, there in zip(chunks, chunks[1:]):
        before = dict(zip(there["left_at"], there["left_before"]))
        common = next(
            ((n, before[x]) for x, n in zip(here["right_at"], here["right_before"]) if x in before and n >= taken),
            None,
        )
        if common is None:
            return None
        total += common[0] - taken
        taken = common[1]
    return total + chunks[-1]["tokens"] - taken


def _spliced(key, chunks):
    rows = sorted(chunks.to_pylist(), key=lambda r: r["chunk"])
    return pa.table({"key": [key[0].as_py()], "n_tokens": pa.array([splice(rows)], pa.int64())})


def _resynchronised(texts: DataFrame, path: str, step: int, overlap: int) -> DataFrame:
    """key, n_tokens of each text; stretches that find no common boundary are widened until they do."""
    done = []
    while True:
        pieces = texts.mapInArrow(_chunked(step, overlap), _CHUNKS).repartition("key", "chunk")
        counted = settled(
            pieces.mapInArrow(_encoded(path, step, overlap), _EDGES)
            .groupBy("key").applyInArrow(_spliced, "key string, n_tokens long")
        )
        done.append(counted.filter("n_tokens is not null"))
        open_ = counted.filter("n_tokens is null").select("key")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, done)
        texts = texts.join(open_, "key", "left_semi")
        overlap *= 8
        step = max(step, 4 * overlap)


def token_counts(
    docs: DataFrame, tokenizer_path: str, limit: int = 1024, chunk: int = 32768, overlap: int = 256,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text.

    Texts of up to `chunk` characters are counted in one go. Longer ones are cut
    into chunks that overlap by `overlap` characters and are counted in different
    tasks; neighbours are joined at a boundary that is stable in both, and texts
    without one are cut again with eight times the overlap, in the end whole.
    Chunks carry their own text only, so no task holds more than a chunk and the
    row it was cut from.

    Null text counts as empty (0 bytes, 0 tokens). Repeated rows, equal or null
    ids give a row each; an empty table gives none. Other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.octet_length(whole_text()).cast("long").alias("n_bytes"), whole_text().alias("text"),
    )
    short = rows.filter(F.length("text") <= chunk).mapInArrow(
        _counted(tokenizer_path), "doc_id long, n_bytes long, n_tokens long"
    )
    # sha2 names a text, so that copies are counted once and a second look finds the same rows.
    long_ = rows.filter(F.length("text") > chunk).withColumn("key", F.sha2("text", 256))
    named = long_.select("doc_id", "n_bytes", "key")
    counted = _resynchronised(long_.select("key", "text").dropDuplicates(["key"]), tokenizer_path, chunk, overlap)
    whole = named.join(counted, "key").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(whole).withColumn("over_limit", F.col("n_tokens") > limit)
