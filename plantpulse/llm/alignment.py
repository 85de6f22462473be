"""Tokens of a byte-level and a sentence-piece tokenizer aligned by the bytes they cover."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from plantpulse.llm.common import settled, ship
from plantpulse.llm.memo import Memo

_BEFORE_UNIT = re.compile(r"(?<=\S)(?= \S)")
_BETWEEN_UNITS = re.compile(r"\S \S")
#: Units in one call of the tokenizers; characters of a text that are looked at together.
_CALL = 4096
_WINDOW = 1 << 20

_PARTS = (
    "part long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "shas array<string>, sizes array<int>, codes binary, counts binary"
)
_OUT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


@lru_cache(maxsize=2)
def first_tokenizer(path: str):
    """The byte-level tokenizer, special strings being plain text, the bytes of each of its entries and their number."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    made.no_truncation()
    made.no_padding()
    # The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    entries = [made.id_to_token(i) or "" for i in range(made.get_vocab_size(with_added_tokens=True))]
    table = [bytes(letters[c] for c in e) if all(c in letters for c in e) else e.encode() for e in entries]
    return made, table, np.array([len(t) for t in table])


@lru_cache(maxsize=2)
def second_tokenizer(path: str):
    """The sentence-piece tokenizer, the bytes of each piece and their number, and whether no piece goes on after a space."""
    import sentencepiece

    made = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [made.id_to_piece(i) for i in range(made.get_piece_size())]
    table = [
        bytes([int(p[3:5], 16)]) if made.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
    ]
    return made, table, np.array([len(t) for t in table]), not any("▁" in p.lstrip("▁") for p in pieces)


def refined(starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where tokens end, in bytes, from the spans a tokenizer gives and the bytes its tokens decode to.

    A span is a sound cut where it is not empty and the next one does not begin
    before it ends. Tokens that share a character (several for a multibyte one,
    or byte fallbacks) lie between two such cuts, where their decoded bytes say
    how far each reaches.
    """
    sound = ends > starts
    sound[:-1] &= ends[:-1] <= starts[1:]
    first = np.concatenate([[True], sound[:-1]])
    run = np.cumsum(first) - 1
    reach = np.cumsum(sizes)
    base = starts[first] - (reach - sizes)[first]
    return np.where(sound, ends, base[run] + reach)


def token_ends(a_path: str, b_path: str, text: str):
    """Ids and byte ends of both tokenizers' tokens in space + text; None if either does not give those bytes back."""
    a_tok, a_bytes, a_sizes = first_tokenizer(a_path)
    b_tok, b_bytes, b_sizes, _ = second_tokenizer(b_path)
    full = " " + text
    data = full.encode("utf-8", "surrogatepass")
    a = a_tok.encode(full, add_special_tokens=False)
    b = [(p.id, p.begin, p.end) for p in b_tok.encode(text, return_type="proto").pieces]
    if b"".join(map(a_bytes.__getitem__, a.ids)) != data or b"".join([b_bytes[i] for i, _, _ in b]) != data:
        return None
    # Characters to bytes for the one, bytes of the text without the added space for the other.
    a_ids = np.array(a.ids, dtype=np.int64)
    spans = np.fromiter(chain.from_iterable(a.offsets), dtype=np.int64, count=2 * len(a_ids)).reshape(-1, 2)
    if len(data) > len(full):
        points = np.frombuffer(full.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        at = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])
        spans = at[spans]
    a_ends = refined(spans[:, 0], spans[:, 1], a_sizes[a_ids])
    lines = np.fromiter(chain.from_iterable(b), dtype=np.int64, count=3 * len(b)).reshape(-1, 3)
    starts = lines[:, 1] + 1
    starts[0] = 0
    b_ends = refined(starts, lines[:, 2] + 1, b_sizes[lines[:, 0]])
    return a_ids, a_ends, lines[:, 0], b_ends


def align(a_ids: np.ndarray, a_ends: np.ndarray, b_ids: np.ndarray, b_ends: np.ndarray):
    """Links (places in a and b), the bytes at which groups end, the text of all groups and where each ends in it.

    Every id of a group's text is followed by a comma, bar or semicolon, which
    ends its group; a group reaches to before its semicolon.
    """
    a_starts, b_starts = np.concatenate([[0], a_ends[:-1]]), np.concatenate([[0], b_ends[:-1]])
    first = np.searchsorted(b_ends, a_starts, "right")
    many = np.searchsorted(b_starts, a_ends, "left") - first
    left = np.repeat(np.arange(len(a_ids)), many)
    right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    places = np.searchsorted(b_ends, a_ends)
    common = a_ends[b_ends[np.minimum(places, len(b_ends) - 1)] == a_ends]
    # All ids in the order of group, tokenizer and place; a group's side ends where the next id is of another.
    sides = np.concatenate([2 * np.searchsorted(common, a_ends), 2 * np.searchsorted(common, b_ends) + 1])
    order = np.argsort(sides, kind="stable")
    ids, sides = np.concatenate([a_ids, b_ids])[order], sides[order]
    ends = np.append(sides[1:] != sides[:-1], True)
    mark = np.where(ends, 1 + (sides & 1), 0)
    signed = _written(1 << int(ids.max()).bit_length())
    text = "".join(map(signed.__getitem__, (3 * ids + mark).tolist())).encode()
    reach = np.cumsum(1 + np.searchsorted(_TENS, ids, "right"))
    return left, right, common, text, reach[mark == 2]


#: A number has one digit more from each of these on (and one at least).
_TENS = np.array([0, *(10**i for i in range(1, 10))])


@lru_cache(maxsize=4)
def _written(most: int) -> list[str]:
    """An id below `most` with the sign behind it, at 3 * id + sign."""
    return [f"{i}{sign}" for i in range(most) for sign in ",|;"]


class Units:
    """Alignments of the parts of texts at which both tokenizers cut, each part once.

    Both cut before a space between two visible characters: the one splits there
    before it merges, the other has no piece that goes on after a space (else
    texts are aligned whole). A unit's record: codes of its links, the text of
    its groups, tokens of the first. None for a unit that is not given back.
    """

    def __init__(self, a_path: str, b_path: str, limit: int = 1_200_000):
        self.paths, self.known = (a_path, b_path), Memo(limit)
        self.apart = second_tokenizer(b_path)[3]

    def alone(self, unit: str):
        return self.together([unit])[0] if unit else None

    def together(self, units: list[str]):
        """Records of units from one call; where that gives no cut between all of them, from two, down to single ones."""
        found = token_ends(*self.paths, " ".join(units))
        if found is not None:
            a_ids, a_ends, b_ids, b_ends = found
            left, right, common, text, reach = align(a_ids, a_ends, b_ids, b_ends)
            bounds = np.cumsum([(len(u) if u.isascii() else len(u.encode("utf-8", "surrogatepass"))) + 1 for u in units])
            place = np.searchsorted(common, bounds)
            if place[-1] < len(common) and (common[place] == bounds).all():
                codes = (a_ids[left].astype("<u8") << np.uint64(32) | b_ids[right].astype("<u8")).tobytes()
                tokens = np.searchsorted(a_ends, bounds, "right")
                links = 8 * np.searchsorted(left, tokens)
                out, link, char = [], 0, 0
                for to_link, to_char, many in zip(links.tolist(), reach[place].tolist(), np.diff(tokens, prepend=0).tolist()):
                    out.append((codes[link:to_link], text[char : to_char - 1], many))
                    link, char = to_link, to_char
                return out
        half = len(units) // 2
        return self.together(units[:half]) + self.together(units[half:]) if half else [None]

    def learn(self, units: set[str]) -> dict:
        known = self.known.claim()
        new = known.missing(units)
        plain = [u for u in new if u and not u[0].isspace() and not u[-1].isspace()]
        for at in range(0, len(plain), _CALL):
            some = plain[at : at + _CALL]
            known.update(zip(some, self.together(some)))
        for u in new:
            if u not in known:
                known[u] = self.alone(u)
        return known

    def split(self, text: str) -> list[str]:
        if not self.apart:
            return [text]
        words = text.split()
        gaps = len(words) - 1
        # One space or line end between each two words, nothing before, behind or beside them.
        if text.count(" ") + text.count("\n") == gaps == len(text) - sum(map(len, words)):
            return text.split(" ")
        head, *rest = _BEFORE_UNIT.split(text)
        return [head, *(u[1:] for u in rest)]

    def windows(self, text: str) -> Iterator[str]:
        """Cut before a unit into pieces of about _WINDOW characters."""
        start = 0
        while self.apart and len(text) - start > _WINDOW:
            found = _BETWEEN_UNITS.search(text, start + _WINDOW - 1)
            if found is None:
                break
            yield text[start : found.start() + 1]
            start = found.start() + 2
        yield text[start:]

    def texts(self, texts: list[str | None]) -> Iterator[tuple]:
        """n_a, n_b, n_groups, n_links, sha256 of the groups, distinct codes and their counts of each text."""
        at = 0
        while at < len(texts):
            size, begin = 0, at
            while at < len(texts) and (at == begin or size + len(texts[at] or "") <= 2 * _WINDOW):
                size += len(texts[at] or "")
                at += 1
            if at == begin + 1 and size > _WINDOW:
                yield self.long(texts[begin])
                continue
            split = [self.split(t) if t else [] for t in texts[begin:at]]
            known = self.learn(set().union(*split))
            for units in split:
                yield summed([[known[u] for u in units]])

    def long(self, text: str) -> tuple:
        def pieces():
            for window in self.windows(text):
                units = self.split(window)
                known = self.learn(set(units))
                yield [known[u] for u in units]

        return summed(pieces())


_NOTHING = (0, 0, 0, 0, "", np.zeros(0, "<u8"), np.zeros(0, "<u4"))


def summed(pieces) -> tuple:
    """What records of units say of their text; all zero if it has none or one of them was not given back."""
    n_a = n_ids = n_groups = n_links = 0
    sha, codes, counts = hashlib.sha256(), np.zeros(0, "<u8"), np.zeros(0, np.int64)
    for records in pieces:
        if not records or None in records:
            return _NOTHING
        groups = b";".join([r[1] for r in records])
        sha.update(b";" + groups if n_groups else groups)
        n_a += sum([r[2] for r in records])
        here = groups.count(b";") + 1
        n_groups += here
        n_ids += groups.count(b",") + 2 * here
        links = np.frombuffer(b"".join([r[0] for r in records]), dtype="<u8")
        n_links += len(links)
        some, often = np.unique(links, return_counts=True)
        if len(codes):
            some, place = np.unique(np.concatenate([codes, some]), return_inverse=True)
            often = np.bincount(place, weights=np.concatenate([counts, often])).astype(np.int64)
        codes, counts = some, often
    if not n_groups:
        return _NOTHING
    return n_a, n_ids - n_a, n_groups, n_links, sha.hexdigest(), codes, counts.astype("<u4")


@lru_cache(maxsize=2)
def units(a_path: str, b_path: str) -> Units:
    """One table of units for each worker and pair of tokenizers."""
    return Units(a_path, b_path)


def _pack(values: np.ndarray) -> bytes:
    """Byte planes apart, compressed: the upper bytes are nearly all zero."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _aligned(a_path: str, b_path: str, rows: int):
    """Documents in parts of at most `rows`, each with the distinct links of every one."""

    def run(batches):
        table, number = units(a_path, b_path), TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                ids = batch.column(0).slice(at, rows)
                found = list(table.texts(batch.column(1).slice(at, rows).to_pylist()))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()), pa.array([ids.to_pylist()], longs),
                        *(pa.array([[f[i] for f in found]], longs) for i in range(4)),
                        pa.array([[f[4] for f in found]]), pa.array([[len(f[5]) for f in found]], pa.list_(pa.int32())),
                        pa.array([_pack(np.concatenate([f[5] for f in found]))], pa.binary()),
                        pa.array([_pack(np.concatenate([f[6] for f in found]))], pa.binary()),
                    ],
                    names=["part", "ids", "n_a", "n_b", "n_groups", "n_links", "shas", "sizes", "codes", "counts"],
                )
                number += 1

    return run


def _links(batches):
    """The links of a part, each id pair once."""
    for batch in batches:
        for part, codes, counts in zip(*(c.to_pylist() for c in batch.columns)):
            pairs, place = np.unique(_unpack(codes, "<u8"), return_inverse=True)
            links = np.bincount(place, weights=_unpack(counts, "<u4"), minlength=len(pairs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(pairs), part)), pa.array(pairs.astype(np.int64)), pa.array(links)],
                names=["part", "pair", "links"],
            )


def _scored(key, docs, pairs):
    """The documents of a part with what their links count in all documents."""
    order = np.argsort(pair := np.asarray(pairs["pair"]).astype(np.int64))
    pair, total, best = pair[order], np.asarray(pairs["total"])[order], np.asarray(pairs["best"])[order]
    out = {c: docs[c].combine_chunks()[0].values for c in ("ids", "n_a", "n_b", "n_groups", "n_links", "shas")}
    place = np.searchsorted(pair, _unpack(docs["codes"][0].as_py(), "<u8").astype(np.int64))
    counts = _unpack(docs["counts"][0].as_py(), "<u4").astype(np.int64)
    ends = np.cumsum(np.array(docs["sizes"][0].as_py(), dtype=np.int64))

    def per_text(values):
        sums = np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], ends])]
        return pa.array(np.diff(sums), pa.int64())

    n_best = per_text(counts * best[place] if len(pair) else np.zeros(0, np.int64))
    count_sum = per_text(counts * total[place] if len(pair) else np.zeros(0, np.int64))
    return pa.table({
        "doc_id": out["ids"], "n_a": out["n_a"], "n_b": out["n_b"], "n_groups": out["n_groups"], "n_links": out["n_links"],
        "n_best": n_best, "count_sum": count_sum, "groups_sha256": out["shas"],
    })


def pair_counts(parts: DataFrame) -> DataFrame:
    """pair, total and best of every id pair: its links in all documents, and whether none of its second id has more."""
    links = parts.select("part", "codes", "counts").mapInArrow(_links, "part long, pair long, links long")
    totals = settled(links.groupBy("pair").agg(F.sum("links").alias("total")))
    second = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = totals.groupBy(second.alias("second")).agg(F.max("total").alias("most"))
    return (
        totals.withColumn("second", second).join(most, "second")
        .select("pair", "total", (F.col("total") == F.col("most")).cast("long").alias("best"))
    )


def alignments(docs: DataFrame, a_path: str, b_path: str, part_rows: int = 1000) -> DataFrame:
    """Tokens, groups and links of every whole text, with what the links count in all texts.

    doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. The
    first tokenizer sees space + text, the second, which adds it, the text.
    Character offsets of the one and byte spans of the other are coarse cuts;
    multibyte characters split over tokens, and byte fallbacks, are refined by
    the bytes the tokens decode to. Id pairs are counted per part of documents,
    then in all; parts ask only for the pairs they hold, so a pair that stands
    in every document is asked for once per part.

    Texts that are null, empty or not given back by a tokenizer have zeros and
    an empty groups_sha256, and their tokens count nowhere. Long texts are read
    in windows cut where both tokenizers cut. Repeated rows, equal and null ids
    give a row each and count each time; an empty table gives no rows. Other
    columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = settled(rows.mapInArrow(_aligned(a_path, b_path, part_rows), _PARTS))
    links = parts.select("part", "codes", "counts").mapInArrow(_links, "part long, pair long, links long")
    asked = links.select("part", "pair").join(pair_counts(parts), "pair")
    return parts.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(_scored, _OUT)
