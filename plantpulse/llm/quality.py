"""Quality grades of documents: ordinal regression with cumulative links on hashed text."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from plantpulse.llm.common import ship, whole_text
from plantpulse.llm.memo import Memo

FEATURES = 1 << 14
_LETTERS = re.compile(r"[^\W\d_]+")
_RUNS = re.compile(r"(.)\1+")


def _shape(word: str) -> str:
    """Letters by case, digits as one sign, everything else as it is; runs count once, up to three signs."""
    out = "".join(("U" if c.isupper() else "l") if c.isalpha() else "9" if c.isdigit() else c for c in word[:64])
    return _RUNS.sub(lambda m: m[1] if m[1] in "Ul9" else m[0][:3], out)[:12]


class WordFeatures(Memo):
    """Feature numbers of a word: of its letters in lower case, and of its shape."""

    def __missing__(self, word: str) -> tuple[int, int]:
        self.make_room()
        letters = "".join(_LETTERS.findall(word)).lower()
        made = self[word] = (
            xxhash.xxh3_64_intdigest(letters) % FEATURES, xxhash.xxh3_64_intdigest("shape " + _shape(word)) % FEATURES,
        )
        return made


WORDS = WordFeatures(150_000)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and weights of a text, of length one; an empty text has one feature of its own."""
    words = text.split()
    counts = np.zeros(0, dtype=np.int64)
    if words:
        numbers = np.array([n for pair in map(WORDS.__getitem__, words) for n in pair], dtype=np.int64)
        own, counts = np.unique(numbers, return_counts=True)
        lines = [x for x in text.split("\n") if x]
        whole = (
            f"varied {int(10 * len(set(words)) / len(words))}", f"lines {int(10 * len(set(lines)) / max(1, len(lines)))}",
            f"length {len(words).bit_length()}", f"letters {int(sum(map(len, words)) / len(words))}",
        )
    else:
        own, whole = np.zeros(0, dtype=np.int64), ("empty",)
    more = np.array([xxhash.xxh3_64_intdigest("text " + w) % FEATURES for w in whole], dtype=np.int64)
    index = np.concatenate([own, more])
    value = np.concatenate([np.log1p(counts), np.full(len(more), 1.0)])
    return index, value / np.sqrt((value * value).sum())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass(frozen=True)
class GradeModel:
    """One weight for each feature, shared by all grades, and ascending thresholds between the grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, texts: pa.Array) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ...: one row for each text."""
        WORDS.claim()
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            index, value = features(text.as_py())
            out[i] = self.weights[index] @ value
        return _sigmoid(out[:, None] - self.thresholds[None, :])


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, steps: int = 300, decay: float = 1e-4) -> GradeModel:
    """Least penalised negative log likelihood of P(grade >= j) = sigmoid(w.x - t_j) by Adam.

    Thresholds are a first one and positive gaps, so they stay in order.
    """
    grades = np.unique(grades, return_inverse=True)[1]
    levels = max(1, int(grades.max()))
    index = np.concatenate([i for i, _ in rows])
    value = np.concatenate([v for _, v in rows])
    owner = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    n = len(rows)
    w, t = np.zeros(FEATURES), np.concatenate([[0.0], np.zeros(levels - 1)])
    moments = [np.zeros(FEATURES), np.zeros(FEATURES), np.zeros(levels), np.zeros(levels)]
    for step in range(1, steps + 1):
        z = np.bincount(owner, weights=w[index] * value, minlength=n)
        limits = np.concatenate([[t[0]], t[0] + np.cumsum(np.exp(t[1:]))])
        tail = np.hstack([np.ones((n, 1)), _sigmoid(z[:, None] - limits[None, :]), np.zeros((n, 1))])
        slope = tail * (1 - tail)
        at = np.arange(n)
        p = np.maximum(tail[at, grades] - tail[at, grades + 1], 1e-9)
        dz = -(slope[at, grades] - slope[at, grades + 1]) / p / n
        d_limits = np.zeros(levels + 2)
        np.add.at(d_limits, grades, slope[at, grades] / p / n)
        np.add.at(d_limits, grades + 1, -slope[at, grades + 1] / p / n)
        d_limits = d_limits[1:-1]
        gw = np.bincount(index, weights=dz[owner] * value, minlength=FEATURES) + decay * w
        gt = np.concatenate([[d_limits.sum()], np.cumsum(d_limits[::-1])[::-1][1:] * np.exp(t[1:])])
        for x, g, m, v in ((w, gw, moments[0], moments[1]), (t, gt, moments[2], moments[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return GradeModel(w, np.concatenate([[t[0]], t[0] + np.cumsum(np.exp(t[1:]))]))


def _featured(batches):
    WORDS.claim()
    for batch in batches:
        made = [features(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array([i for i, _ in made], pa.list_(pa.int64())),
                pa.array([v for _, v in made], pa.list_(pa.float64())),
            ],
            names=["grade", "numbers", "weights"],
        )


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> GradeModel | None:
    """A model from at most `sample` rated documents, those of the least id hashes.

    A rating is 0 for low quality, 1 for good quality that is toxic, 2 for good
    quality that is not; ratings without a quality are left out, those without a
    toxicity count as not toxic. None if no document is rated or all are rated alike.
    """
    ship(docs.sparkSession)
    rated = (
        labels.filter("quality is not null and doc_id is not null")
        .select(
            F.col("doc_id").alias("_rated"),
            F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).cast("long").alias("grade"),
        )
        .orderBy(F.xxhash64("_rated"), "grade").limit(sample)
    )
    found = (
        docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(rated), F.col("doc_id") == F.col("_rated"))
        .select("grade", "text").mapInArrow(_featured, "grade long, numbers array<long>, weights array<double>")
        .toArrow()
    )
    grades = found["grade"].to_numpy()
    if len(set(grades.tolist())) < 2:
        return None
    numbers, weights = found["numbers"].combine_chunks(), found["weights"].combine_chunks()
    rows = [(numbers[i].values.to_numpy(), weights[i].values.to_numpy()) for i in range(len(grades))]
    # The rows come in any order; a fixed one keeps the sums, and so the model, the same.
    order = sorted(range(len(rows)), key=lambda i: (int(grades[i]), rows[i][0].tobytes(), rows[i][1].tobytes()))
    return fit([rows[i] for i in order], grades[order])


def graded(model: GradeModel | None, text: Column) -> Column:
    """A struct of expected_grade, p_good (grade >= 1), p_best (the highest grade) for a text; nulls without a model."""
    kind = "expected_grade double, p_good double, p_best double"
    if model is None:
        return F.lit(None).cast(f"struct<{kind.replace(' ', ':').replace(',:', ',')}>")

    @F.arrow_udf(kind)
    def score(texts: pa.Array) -> pa.Array:
        tails = model.tails(texts)
        columns = [tails.sum(axis=1), tails[:, 0], tails[:, -1]]
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], ["expected_grade", "p_good", "p_best"])

    return score(text)


def grades(docs: DataFrame, model: GradeModel | None, least: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, p_good, p_best, kept of every document.

    A document is kept if P(grade >= 1) is at least `least`. Null text is empty;
    without a model probabilities are null and everything is kept; rows with equal
    or null ids give a row each; an empty table gives none; other columns are ignored.
    """
    ship(docs.sparkSession)
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), graded(model, whole_text()).alias("g"))
        .select("doc_id", "g.expected_grade", "g.p_good", "g.p_best")
        .withColumn("kept", F.coalesce(F.col("p_good") >= least, F.lit(True)))
    )


def keep_good(docs: DataFrame, model: GradeModel | None, least: float = 0.5) -> DataFrame:
    """The documents that are kept, with all their columns."""
    ship(docs.sparkSession)
    own = "_graded"
    while own in docs.columns:
        own = "_" + own
    return (
        docs.withColumn(own, graded(model, whole_text()))
        .filter(F.coalesce(F.col(own)["p_good"] >= least, F.lit(True))).drop(own)
    )
