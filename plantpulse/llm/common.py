"""What the operators of this subpackage share."""

from __future__ import annotations

import math
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plantpulse.operators.durable import durable

_SHIPPED = "plantpulse.llm.shipped"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a batch between the JVM and Python; whole texts make batches of the default 10 000 rows too large.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Make a session ready for Python on the executors.

    The package's code goes to them once, through Spark's own file server, and
    Arrow batches are held to BATCH_ROWS rows (a smaller setting is left alone).
    """
    context, rows = spark.sparkContext, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if getattr(context, "_plantpulse_shipped", None) == _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="plantpulse-code-"), "plantpulse_code.zip")
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, str(Path(root.name) / file.relative_to(root)))
    context.addPyFile(target)
    context._plantpulse_shipped = _SHIPPED


def whole_text(name: str = "text") -> Column:
    """The text of a row; a null one is empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_bytes(df: DataFrame, name: str = "text") -> int:
    """Bytes of all texts: one pass that reads a single column."""
    return df.agg(F.sum(F.octet_length(F.col(name).cast("string")))).first()[0] or 0


def parts(total: int, each: int) -> int:
    """How many parts of about `each` make up `total`; at least one."""
    return max(1, math.ceil(total / each))


def spread(*columns: str | Column, over: int) -> Column:
    """An even assignment of rows to 0 .. over - 1 by the values of columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(over)).cast("int")


def settled(df: DataFrame) -> DataFrame:
    """The rows on the checkpoint folder, as durable() puts them, without the shuffle files that led there.

    Spark removes an execution's shuffle files at its end if a session setting
    asks for it; it is set for this one execution only. Later readers use the
    checkpoint, so nothing needs those files any more.
    """
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        return durable(df.select("*"))
    finally:
        conf.set(name, before)


def unlisted(docs: DataFrame, ids: DataFrame, key: str = "doc_id", small: int = 1_000_000) -> DataFrame:
    """The rows of docs whose key is not in ids.

    The list is broadcast only if counting shows at most `small` keys (8 MB of
    longs); a longer one is met by a shuffled anti join. Both give the same rows.
    """
    listed = ids.select(F.col(key).alias("_listed"))
    few = listed.count() <= small
    return docs.join(F.broadcast(listed) if few else listed, F.col(key) == F.col("_listed"), "left_anti")
