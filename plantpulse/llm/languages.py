"""The language of whole texts: error-correcting output codes over hashed n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plantpulse.llm.common import settled, ship

#: Buckets of hashed n-grams, and how many bytes an n-gram has.
BITS = 16
ORDERS = (3, 4)
#: A text of more n-grams than this is no better evidence.
FULL = 256
#: Bytes that are looked at together.
PIECE = 1 << 20
#: Tasks that add up n-grams of the sample: a language's profile is put together from so many.
TASKS = 16
UNDETERMINED = "und"

# ASCII that is no letter separates words; bytes of other characters stay.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


@dataclass(frozen=True)
class Model:
    """Languages in order, their codewords (+1, -1), n-gram weights of each bit, and the bits' calibration.

    bits: one row for each bit, (slope, shift); trust: how often a bit was right
    for texts of a language, one row for each language.
    """

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bits: np.ndarray
    trust: np.ndarray


def codewords(k: int) -> np.ndarray:
    """Codewords of k languages, one row each, that lie far apart.

    Up to seven: every way to part them into two camps. More: of many random
    codes of about ten bits per doubling, the one whose nearest rows are farthest.
    """
    if k <= 7:
        columns = [[1] + [1 if (m >> i) & 1 else -1 for i in range(k - 1)] for m in range(2 ** max(0, k - 1) - 1)]
        return np.array(columns, dtype=np.int8).reshape(-1, k).T
    best, apart = None, -1
    for seed in range(64):
        code = np.random.RandomState(seed).choice(np.array([-1, 1], dtype=np.int8), (k, math.ceil(10 * math.log2(k))))
        code = code[:, np.abs(code.sum(axis=0)) < k]
        near = _nearest(code)
        if near > apart:
            best, apart = code, near
    return best


def _nearest(code: np.ndarray) -> int:
    """The least Hamming distance of two rows."""
    if len(code) < 2:
        return code.shape[1]
    same = code.astype(np.int32) @ code.T.astype(np.int32)
    np.fill_diagonal(same, -code.shape[1])
    return int((code.shape[1] - same.max()) // 2)


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all n-grams and the text each is of, in pieces of bounded size.

    Letters in lower case; everything between words is one space. Pieces of one
    text overlap, so that no n-gram is lost or seen twice.
    """
    held, owners, size = [], [], 0
    keep = max(ORDERS) - 1
    for owner, text in enumerate(texts):
        data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "
        for at in range(0, max(1, len(data) - keep), PIECE):
            some = data[at : at + PIECE + keep]
            held.append(some)
            owners.append((owner, len(some), at + PIECE + keep < len(data)))
            size += len(some)
            if size >= PIECE:
                yield _hashed(held, owners)
                held, owners, size = [], [], 0
    if held:
        yield _hashed(held, owners)


def _hashed(held: list[bytes], owners: list[tuple[int, int, bool]]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(held), dtype=np.uint8).astype(np.uint32)
    sizes = np.array([n for _, n, _ in owners])
    piece = np.repeat(np.arange(len(owners), dtype=np.int32), sizes)
    # A piece that goes on leaves the n-grams that begin in its overlap to the next one.
    last = np.cumsum(sizes) - np.array([max(ORDERS) - 1 if more else 0 for _, _, more in owners])
    inside = np.arange(len(data)) < last[piece]
    codes, whose = [], []
    for n in ORDERS:
        if len(data) < n:
            continue
        code = np.zeros(len(data) - n + 1, dtype=np.uint32)
        for i in range(n):
            code = (code << np.uint32(8)) | data[i : len(code) + i]
        code = (code * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(32 - BITS)
        fits = (piece[: len(code)] == piece[n - 1 :]) & inside[: len(code)]
        codes.append(code[fits])
        whose.append(piece[: len(code)][fits])
    owner = np.array([o for o, _, _ in owners], dtype=np.int64)
    if not codes:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(codes), owner[np.concatenate(whose)]


def margins(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """For each text and bit the mean weight of its n-grams, times the root of their number up to FULL."""
    sums, counts = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts))
    for codes, owner in grams(texts):
        counts += np.bincount(owner, minlength=len(texts))
        for bit in range(weights.shape[1]):
            sums[:, bit] += np.bincount(owner, weights=weights[codes, bit], minlength=len(texts))
    counts = np.maximum(counts, 1)[:, None]
    return sums / counts * np.sqrt(np.minimum(counts, FULL))


def decode(model: Model, found: np.ndarray, margin: float = 0.6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the nearest codeword, score and ambiguity of each row of margins.

    The loss of a language is that of its bits, log(1 + exp(-code * margin)),
    each weighted by how far the bit can be trusted for the language. The score
    is its share of exp(-loss); equal losses go to the language that is first in
    order. Ambiguous: a score below `margin`, or more wrong bits than the code
    can correct.
    """
    if not len(model.languages):
        return np.zeros(len(found), int), np.zeros(len(found)), np.ones(len(found), bool)
    z = found * model.bits[:, 0] + model.bits[:, 1]
    loss = np.zeros((len(found), len(model.languages)))
    for r in range(len(model.languages)):
        loss[:, r] = np.logaddexp(0, -model.code[r] * z) @ model.trust[r]
    best = loss.argmin(axis=1)
    share = np.exp(loss.min(axis=1, keepdims=True) - loss)
    score = 1 / share.sum(axis=1)
    wrong = (np.sign(z) * model.code[best] < 0).sum(axis=1)
    return best, score, (score < margin) | (wrong > max(0, (_nearest(model.code) - 1) // 2))


def learned_from(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def _profiles(batches):
    """One line per language: the n-gram shares of its texts in this task, added up, each text counting the same."""
    profiles: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = np.zeros(1 << BITS)
            for codes, _ in grams([text]):
                found += np.bincount(codes, minlength=1 << BITS)
            if found.any():
                profiles[lang] = profiles.get(lang, 0) + found / found.sum()
    for lang, profile in profiles.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang]), pa.array([profile.astype("<f8").tobytes()], pa.binary())], names=["lang", "profile"]
        )


def _added(key, rows):
    total = sum(np.frombuffer(p, dtype="<f8") for p in rows["profile"].to_pylist())
    return pa.table({"lang": [key[0].as_py()], "profile": pa.array([total.tobytes()], pa.binary())})


def _measured(weights: np.ndarray):
    def run(batches):
        for batch in batches:
            found = margins(batch.column(1).to_pylist(), weights)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.tolist(), pa.list_(pa.float64()))], names=["lang", "margins"]
            )

    return run


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 25) -> tuple[float, float]:
    """Slope and shift of P(y = 1) = 1 / (1 + exp(-(slope x + shift))), by Newton's method with a small ridge."""
    design, beta = np.stack([x, np.ones_like(x)], axis=1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (y - p)) - 1e-2 * (beta - [1.0, 0.0])
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        beta = beta + np.clip(step, -2, 2)
    return max(float(beta[0]), 1e-3), float(beta[1])


def train(docs: DataFrame, sample: int = 2000) -> Model:
    """Binary n-gram classifiers of the codewords' bits, from text and lang alone.

    About `sample` different texts of each language, chosen by a hash of the text,
    are learned from; copies count once. Three quarters give n-gram profiles, the
    weight of an n-gram for a bit being the log of how much likelier it is in the
    languages on the one side; one quarter calibrates the bits. Rows without text,
    language or doc_id, and those with crc32(doc_id) mod 4 = 2, are not used.
    What reaches the driver grows with the number of languages only. A language
    whose sample has no letters is not learned; with no rows there are no languages.
    """
    ship(docs.sparkSession)
    rows = docs.filter(learned_from(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("mark")
    )
    texts = rows.groupBy("lang").agg(F.approx_count_distinct("mark").alias("texts"))
    chosen = rows.join(F.broadcast(texts), "lang").filter(  # one row for each language
        F.pmod("mark", F.lit(1 << 20)) < F.ceil(F.lit(float(1 << 20) * sample) / F.col("texts"))
    )
    chosen = settled(
        chosen.groupBy("lang", "mark").agg(F.first("text").alias("text"))
        .select("lang", "text", (F.pmod(F.shiftright("mark", 20), F.lit(4)) == 0).alias("aside"))
    )
    profiles = (
        chosen.filter("not aside").select("lang", "text").coalesce(TASKS).mapInArrow(_profiles, "lang string, profile binary")
        .groupBy("lang").applyInArrow(_added, "lang string, profile binary").orderBy("lang").collect()
    )
    languages = [r.lang for r in profiles]
    if not languages:
        return Model([], np.zeros((0, 0), np.int8), np.zeros((1 << BITS, 0), np.float32), np.zeros((0, 2)), np.zeros((0, 0)))
    code = codewords(len(languages))
    shares = np.stack([np.frombuffer(r.profile, dtype="<f8") for r in profiles])
    shares = shares / shares.sum(axis=1, keepdims=True)
    weights = np.zeros((1 << BITS, code.shape[1]), dtype=np.float32)
    for bit in range(code.shape[1]):
        yes, no = (shares[code[:, bit] == side].mean(axis=0) + 1e-7 for side in (1, -1))
        weights[:, bit] = np.clip(np.log(yes / no), -4, 4)
    bits, trust = np.tile([1.0, 0.0], (code.shape[1], 1)), np.ones(code.shape)
    if code.shape[1]:
        aside = chosen.filter("aside").select("lang", "text").mapInArrow(_measured(weights), "lang string, margins array<double>").collect()
        place = {lang: i for i, lang in enumerate(languages)}
        of = np.array([place[r.lang] for r in aside if r.lang in place], dtype=np.int64)
        found = np.array([r.margins for r in aside if r.lang in place]).reshape(len(of), -1)
        each = 1 / np.bincount(of, minlength=len(languages))[of]  # languages count the same
        for bit in range(code.shape[1]):
            side = code[of, bit]
            if len(set(side.tolist())) == 2:
                bits[bit] = _logistic(found[:, bit], side > 0, each * len(of) / len(set(of.tolist())))
            right = (side * (found[:, bit] * bits[bit, 0] + bits[bit, 1]) > 0).astype(float)
            for r in set(of.tolist()):
                trust[r, bit] = (right[of == r].sum() + 1) / ((of == r).sum() + 2)
    return Model(languages, code, weights, bits, trust / trust.mean(axis=1, keepdims=True) if code.shape[1] else trust)


def _predicted(model: Model):
    names = [*model.languages, UNDETERMINED]

    def run(batches):
        for batch in batches:
            best, score, unsure = decode(model, margins(batch.column(2).to_pylist(), model.weights))
            known = np.array(batch.column(3).to_pylist(), dtype=bool) & bool(model.languages)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    pa.array([names[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist())]),
                    pa.array(np.where(known, score, 0.0)), pa.array(unsure | ~known),
                ],
                names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    return run


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1) and ambiguous of every whole text.

    Only the text is looked at. Null texts and those without a letter are `und`
    with score 0 and ambiguous, as all are if no language was learned. A null
    doc_id is not held out (nor learned from). Texts of any length are read in
    pieces of a megabyte; equal texts get equal answers; repeated rows give a row
    each, an empty table none. Other columns are ignored.
    """
    ship(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(~learned_from(F.col("doc_id")), F.lit(False)).alias("held_out"),
        F.coalesce(text, F.lit("")).alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )
    return rows.mapInArrow(_predicted(model), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
