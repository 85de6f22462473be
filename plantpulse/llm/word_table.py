"""Encoding and decoding by a table of distinct words."""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from plantpulse.llm.codec import encode_words, tokenizer, uncollected
from plantpulse.llm.common import parts, ship, spread, text_bytes, whole_text

_DOCS = "batch int, ids array<long>, sizes array<int>, blob binary"
_WORDS = "bucket int, batch int, words binary"
_CODES = "batch int, bucket int, counts binary, ids binary"
_OUT = "doc_id long, n_tokens long, ids string, decoded string"
_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=4)
def pieces(path: str) -> list[str]:
    """The id-to-piece table of a tokenizer, special tokens included; as long as the vocabulary."""
    tok = tokenizer(path)
    return [tok.id_to_token(i) or "" for i in range(tok.get_vocab_size(with_added_tokens=True))]


class Written:
    """What is written for every id, kept as bytes and their lengths."""

    def __init__(self, texts: list[bytes]):
        self.texts, self.sizes = texts, np.array([len(t) for t in texts], dtype=np.int64)

    def of_words(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The ids of many words in a row, written with a space between them, cut into words of `sizes` ids."""
        whole = b" ".join(map(self.texts.__getitem__, ids.tolist()))
        at = np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum(self.sizes[ids] + 1, out=at[1:])
        ends = np.cumsum(sizes, dtype=np.int64)
        starts = at[ends - sizes]
        stops = np.maximum(at[ends] - 1, starts)
        return [whole[a:b] for a, b in zip(starts.tolist(), stops.tolist())]


@lru_cache(maxsize=4)
def _written(path: str) -> tuple[Written, Written]:
    """Every id in decimal digits, and its piece in UTF-8."""
    known = pieces(path)
    return Written([str(i).encode() for i in range(len(known))]), Written([p.encode() for p in known])


def _gathered(batches):
    """Documents of one batch number, compressed together."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        rows: dict[int, tuple[list, list]] = {}
        for number, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
            ids, texts = rows.setdefault(number, ([], []))
            ids.append(doc)
            texts.append(text.encode("utf-8", "replace"))
        for number, (ids, texts) in rows.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int32()), pa.array([ids], pa.list_(pa.int64())),
                    pa.array([[len(t) for t in texts]], pa.list_(pa.int32())),
                    pa.array([squeeze.compress(b"".join(texts))], pa.binary()),
                ],
                names=["batch", "ids", "sizes", "blob"],
            )


def _texts(docs: pa.Table):
    """Id and text of each document of a batch."""
    open_ = zstandard.ZstdDecompressor()
    for ids, sizes, blob in zip(docs["ids"].to_pylist(), docs["sizes"].to_pylist(), docs["blob"].to_pylist()):
        data, at = open_.decompress(blob), 0
        for doc, size in zip(ids, sizes):
            yield doc, data[at : at + size]
            at += size


def _distinct(docs: pa.Table, buckets: int) -> list[list[bytes]]:
    """The distinct words of a batch by bucket, each list in order."""
    words: set[bytes] = set()
    for _, text in _texts(docs):
        words.update(text.split())
    out: list[list[bytes]] = [[] for _ in range(buckets)]
    for word in words:
        out[zlib.crc32(word) % buckets].append(word)
    for some in out:
        some.sort()
    return out


def _words_of(buckets: int):
    def run(key, docs):
        found = [(i, w) for i, w in enumerate(_distinct(docs, buckets)) if w]
        return pa.table({
            "bucket": pa.array([i for i, _ in found], pa.int32()),
            "batch": pa.array([key[0].as_py()] * len(found), pa.int32()),
            "words": pa.array([zlib.compress(b"\n".join(w), 1) for _, w in found], pa.binary()),
        })

    return run


def _encoded(path: str):
    """Each distinct word of a bucket is encoded once; batches get the ids of theirs in the order of the words."""

    def run(key, rows):
        asked = [zlib.decompress(w).split(b"\n") for w in rows["words"].to_pylist()]
        words = list(set().union(*asked))
        ids = dict(zip(words, encode_words(path, words)))
        counts, blobs = [], []
        for some in asked:
            got = [ids[w] for w in some]
            counts.append(zlib.compress(np.array([len(g) // 4 for g in got], dtype="<u4").tobytes(), 1))
            # Byte planes apart: the upper bytes of ids are nearly all zero.
            raw = np.frombuffer(b"".join(got), dtype=np.uint8).reshape(-1, 4)
            blobs.append(zlib.compress(np.ascontiguousarray(raw.T).tobytes(), 1))
        return pa.table({
            "batch": rows["batch"].combine_chunks(),
            "bucket": pa.array([key[0].as_py()] * len(asked), pa.int32()),
            "counts": pa.array(counts, pa.binary()), "ids": pa.array(blobs, pa.binary()),
        })

    return run


def _joined(path: str, buckets: int, digests: bool):
    """Ids go back to the words of a batch by position, pieces to the ids, and both to the documents."""

    def joined(docs, codes):
        by_bucket = _distinct(docs, buckets)
        digits, read = _written(path)
        table: dict[bytes, tuple[bytes, bytes]] = {}
        silent: set[bytes] = set()  # words without ids leave no space either
        for bucket, counts, blob in zip(
            codes["bucket"].to_pylist(), codes["counts"].to_pylist(), codes["ids"].to_pylist()
        ):
            sizes = np.frombuffer(zlib.decompress(counts), dtype="<u4")
            planes = np.frombuffer(zlib.decompress(blob), dtype=np.uint8).reshape(4, -1)
            ids = np.ascontiguousarray(planes.T).view("<u4").ravel()
            words = by_bucket[bucket]
            table.update(zip(words, zip(digits.of_words(ids, sizes), read.of_words(ids, sizes), strict=True), strict=True))
            silent.update(words[i] for i in np.flatnonzero(sizes == 0).tolist())
        out: tuple[list, list, list, list] = ([], [], [], [])
        for doc, text in _texts(docs):
            words = text.split()
            if silent:
                words = [w for w in words if w not in silent]
            found = [table[w] for w in words]
            numbers = b" ".join([x[0] for x in found])
            decoded = b" ".join([x[1] for x in found])
            out[0].append(doc)
            out[1].append(numbers.count(b" ") + 1 if numbers else 0)
            out[2].append(hashlib.sha256(numbers).hexdigest() if digests else numbers.decode())
            out[3].append(hashlib.sha256(decoded).hexdigest() if digests else decoded.decode())
        names = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256") if digests else ("doc_id", "n_tokens", "ids", "decoded")
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.table({n: pa.array(v, k) for n, v, k in zip(names, out, kinds)})

    def run(key, docs, codes):
        with uncollected():
            return joined(docs, codes)

    return run


def encode_decode(
    docs: DataFrame, tokenizer_path: str, digests: bool = False,
    batch_bytes: int = 4 << 20, bucket_bytes: int = 16 << 20,
) -> DataFrame:
    """Ids of every whole text and the text decoded from them, as text or as SHA-256 digests.

    For tokenizers that drop white space and whose words never meet over it, and
    whose decoder puts one space between pieces. Documents are dealt into batches
    of about `batch_bytes`; a batch sends each of its distinct words once, by the
    word's hash, to one of the buckets, where a word is encoded once for all
    batches; the ids come back in the order of the words, which both sides know,
    so that neither words nor positions travel again. Decoding looks ids up in
    the id-to-piece table, which is as long as the vocabulary. Tasks hold a batch
    or a bucket, both of a size that does not grow with the table; the number of
    both does. A very common word counts once in a batch.

    Null text is empty: 0 tokens, empty ids and text. Rows with equal or null ids
    give a row each; an empty table gives none; other columns are ignored.
    """
    ship(docs.sparkSession)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    total = text_bytes(chosen)
    batches, buckets = parts(total, batch_bytes), parts(total, bucket_bytes)
    dealt = (
        chosen.select(spread("doc_id", "text", over=batches).alias("batch"), "doc_id", "text")
        .mapInArrow(_gathered, _DOCS)
        .repartition(batches, "batch")
    )
    words = dealt.groupBy("batch").applyInArrow(_words_of(buckets), _WORDS)
    codes = words.groupBy("bucket").applyInArrow(_encoded(tokenizer_path), _CODES)
    return (
        dealt.groupBy("batch").cogroup(codes.groupBy("batch"))
        .applyInArrow(_joined(tokenizer_path, buckets, digests), _DIGESTS if digests else _OUT)
    )
