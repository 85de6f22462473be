"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from plantpulse.llm.common import parts, settled, ship


@dataclass(frozen=True)
class HashTables:
    """Several tables of projections cut into cells: floor((a.x + b) / width)."""

    planes: np.ndarray  # tables x functions x dimensions
    shifts: np.ndarray  # tables x functions
    width: float
    distance: float

    def projected(self, vectors: np.ndarray) -> np.ndarray:
        return np.einsum("nd,tfd->ntf", vectors, self.planes) + self.shifts[None]

    def codes(self, cells: np.ndarray) -> np.ndarray:
        """One number for the cells of a bucket (last axis)."""
        out = np.zeros(cells.shape[:-1], dtype=np.int64)
        for f in range(cells.shape[-1]):
            out = out * np.int64(1000003) + cells[..., f]
        return out

    def probes(self, vector: np.ndarray, success: float) -> list[np.ndarray]:
        """For each table the buckets to visit, by falling chance of holding a neighbour at `distance`.

        The difference of the projections of two vectors at a distance d is normal
        with that deviation, so the chance of a perturbed bucket is a product over
        its cells. Buckets are visited until their chances add up to `success`.
        """
        at = self.projected(vector[None])[0]
        cell = np.floor(at / self.width).astype(np.int64)
        steps = np.arange(-1, 2)
        out = []
        for places, cells in zip(at, cell):
            low = (cells[:, None] + steps) * self.width - places[:, None]
            chance = _normal((low + self.width) / self.distance) - _normal(low / self.distance)
            joint, moves = chance[0], steps[:, None]
            for row in chance[1:]:
                joint = np.multiply.outer(joint, row).ravel()
                moves = np.hstack([np.repeat(moves, len(steps), axis=0), np.tile(steps[:, None], (len(moves), 1))])
            order = np.argsort(-joint, kind="stable")
            visited = int(np.searchsorted(np.cumsum(joint[order]), success)) + 1
            out.append(self.codes(cells[None, :] + moves[order[:visited]]))
        return out


_ERF = np.vectorize(math.erf, otypes=[float])


def _normal(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _ERF(x / math.sqrt(2)))


def fit(sample: np.ndarray, rank: int = 1, tables: int = 8, functions: int = 8, seed: int = 5) -> HashTables:
    """Tables whose cells are twice as wide as the median distance to the rank-th nearest other vector of a sample.

    With the wanted number of neighbours times the sample's share of all vectors,
    rounded up, as the rank, that distance is not below the one to be found.
    """
    square = (sample * sample).sum(axis=1)
    apart = square[:, None] + square[None, :] - 2 * sample @ sample.T
    np.fill_diagonal(apart, np.inf)
    rank = min(rank, len(sample) - 1)
    nearest = np.sqrt(np.maximum(np.partition(apart, rank - 1, axis=1)[:, rank - 1], 0)) if rank else np.ones(1)
    distance = float(np.median(nearest)) or float(nearest.max()) or 1.0
    rng = np.random.default_rng(seed)
    planes = rng.normal(size=(tables, functions, sample.shape[1]))
    width = 2 * distance
    return HashTables(planes, rng.uniform(0, width, size=(tables, functions)), width, distance)


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


_INDEX = "part int, code long, vec_id long, vector array<double>"
_ASKED = "part int, codes array<long>, query_id long, vector array<double>"


def _coded(hashes: HashTables):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = hashes.codes(np.floor(hashes.projected(_matrix(batch.column(1))) / hashes.width).astype(np.int64))
            for t in range(codes.shape[1]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(codes), t, np.int32)), pa.array(codes[:, t]), batch.column(0), batch.column(1)],
                    names=["part", "code", "vec_id", "vector"],
                )

    return run


def _shard(codes: np.ndarray, shards: int) -> np.ndarray:
    return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def _dealt(shards: int, hot: dict[tuple[int, int], int]):
    """Give index rows their part: table and shard of the bucket; rows of a hot bucket go to several shards."""

    def run(batches):
        for batch in batches:
            table, codes, ids = (batch.column(i).to_numpy() for i in range(3))
            shard = _shard(codes, shards)
            if hot:
                spread = np.array([hot.get(k, 1) for k in zip(table.tolist(), codes.tolist())])
                shard = (shard + _shard(ids, 1 << 20) % spread) % shards
            yield pa.RecordBatch.from_arrays(
                [pa.array((table * shards + shard).astype(np.int32)), *batch.columns[1:]],
                names=["part", "code", "vec_id", "vector"],
            )

    return run


def _asking(hashes: HashTables, success: float, shards: int, hot: dict[tuple[int, int], int]):
    """The parts that a query goes to, with the buckets it visits there."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            part, codes, rows = [], [], []
            for i, vector in enumerate(_matrix(batch.column(1))):
                for t, visited in enumerate(hashes.probes(vector, success)):
                    shard = _shard(visited, shards)
                    if hot:
                        spread = np.array([hot.get((t, c), 1) for c in visited.tolist()])
                        more = np.arange(len(visited)).repeat(spread)
                        step = np.arange(len(more)) - np.repeat(np.cumsum(spread) - spread, spread)
                        visited, shard = visited[more], (shard[more] + step) % shards
                    for s in np.unique(shard).tolist():
                        part.append(t * shards + s)
                        codes.append(visited[shard == s])
                        rows.append(i)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part, pa.int32()), pa.array(codes, pa.list_(pa.int64())),
                    batch.column(0).take(take), batch.column(1).take(take),
                ],
                names=["part", "codes", "query_id", "vector"],
            )

    return run


def nearest(ids: np.ndarray, distances: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least distances, ties by smaller id."""
    if len(distances) > k:
        limit = np.partition(distances, k - 1)[k - 1]
        some = np.flatnonzero(distances <= limit)
    else:
        some = np.arange(len(distances))
    return some[np.lexsort((ids[some], distances[some]))][:k]


def _reranked(k: int):
    """The nearest among the vectors of the visited buckets (of all, without buckets), by exact distance."""

    def run(key, index, asked):
        out: tuple[list, list, list] = ([], [], [])
        if index.num_rows and asked.num_rows:
            order = np.argsort(index["code"].to_numpy(), kind="stable")
            codes, ids = index["code"].to_numpy()[order], index["vec_id"].to_numpy()[order]
            vectors = _matrix(index["vector"])[order]
            for query, visited, vector in zip(
                asked["query_id"].to_pylist(), asked["codes"].to_pylist(), _matrix(asked["vector"])
            ):
                if visited is None:
                    some = np.arange(len(ids))
                else:
                    visited = np.unique(np.array(visited, dtype=np.int64))
                    low, high = np.searchsorted(codes, visited), np.searchsorted(codes, visited, side="right")
                    size = high - low
                    some = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
                some = some[ids[some] != query]
                apart = vectors[some] - vector
                distances = np.sqrt((apart * apart).sum(axis=1))
                for i in nearest(ids[some], distances, k).tolist():
                    out[0].append(query)
                    out[1].append(int(ids[some[i]]))
                    out[2].append(float(distances[i]))
        return pa.table({
            "query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()),
            "score": pa.array(out[2], pa.float64()),
        })

    return run


def taking_part(rows: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that can be compared: not null, finite, not zero, of the usual length.

    The usual length is the most frequent one (the longer of two). A vec_id stands
    for one vector: of several, the least in order of components.
    """
    vector = F.col("embedding").cast("array<double>")
    valid = (
        rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
        .filter("vec_id is not null and vector is not null and size(vector) > 0")
        .filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        .filter(F.exists("vector", lambda x: x != 0))
    )
    usual = valid.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = usual.n if usual else 0
    return valid.filter(F.size("vector") == length).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def nearest_neighbours(
    rows: DataFrame, every: int = 100, k: int = 10, success: float = 0.35,
    sample: int = 2000, shard_rows: int = 8192, tables: int = 8, functions: int = 8,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each vec_id divisible by `every`.

    Every row is hashed into each table; a query visits buckets in order of their
    estimated chance until these add up to `success` in a table, and the candidates
    of all tables are ranked by their exact distance. Buckets share parts of about
    `shard_rows` rows; one that holds more is spread over several parts, and its
    queries with it, so that no task gets a whole hot bucket. Of equal vectors only
    the k + 1 smallest ids stay in the index: ties go to the smaller id, so others
    can never be among the k. Queries that find fewer than k are compared with all.

    The tables are fitted on a sample of at most `sample` rows (those of the least
    id hashes); the index holds every row. Vectors that are null, zero, of another
    length than most, or have null or non-finite components take no part. With k or
    fewer others, all are returned. An empty table gives no rows; other columns are
    ignored.
    """
    spark = rows.sparkSession
    ship(spark)
    valid = taking_part(rows)
    chosen = valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    result = "query_id long, rank int, vec_id long, score double"
    if not chosen.num_rows:
        return spark.createDataFrame([], result)
    count = valid.count()
    hashes = fit(_matrix(chosen["vector"]), math.ceil(k * min(1.0, chosen.num_rows / count)), tables, functions)
    same = Window.partitionBy("vector").orderBy("vec_id")
    kept = valid.withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= k + 1).drop("_n")
    queries = valid.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector")
    shards = parts(count, shard_rows)
    coded = kept.mapInArrow(_coded(hashes), _INDEX)
    # Each table has at most 1000 of these, whatever the size of the data.
    limit = max(shard_rows // 4, count // 1000)
    hot = {
        (r.part, r.code): min(shards, parts(r.n, limit))
        for r in coded.groupBy("part", "code").agg(F.count("*").alias("n")).filter(F.col("n") > limit).collect()
    }
    index = coded.mapInArrow(_dealt(shards, hot), _INDEX)
    asked = queries.mapInArrow(_asking(hashes, success, shards, hot), _ASKED)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def ranked(index: DataFrame, asked: DataFrame) -> DataFrame:
        found = index.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(
            _reranked(k), "query_id long, vec_id long, score double"
        )
        return (
            found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
            .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score")
        )

    first = settled(ranked(index, asked))
    few = queries.join(first.filter(F.col("rank") == k).select("query_id"), "query_id", "left_anti")
    if few.isEmpty():
        return first
    everywhere = few.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("part"),
        F.lit(None).cast("array<long>").alias("codes"), "query_id", "vector",
    )
    rest = ranked(index.filter(F.col("part") < shards), everywhere)
    return first.join(few.select("query_id"), "query_id", "left_anti").unionByName(rest)
