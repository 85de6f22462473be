"""Similar repairs by their words: an exact set-similarity join with a top k for each case.

Records with the same words are one class, and classes are joined, never records.
A class looks for partners under its rarest words only: two sets of similarity
t or more share a word among the first n - ceil(t n) + 1 of each, if all words
stand in one order (rare ones first). Sizes and places of the shared word then
bound what two sets can have in common before they are compared in full.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window, functions as F

from plantpulse.operators.durable import durable

#: No more keys than this hold more than a HOT_KEYS-th of all rows; their side of a join is broadcast.
HOT_KEYS = 100_000
#: Classes under one word and size that are compared in one task.
BLOCK = 2_000

REPAIR_TEXT = ("failure_mode", "root_cause", "action_taken", "parts_replaced", "notes")


def words_of(df: DataFrame, columns: tuple[str, ...] = REPAIR_TEXT) -> Column:
    """The distinct words of some text columns in alphabetical order; columns the frame lacks are left out."""
    text = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns if c in df.columns]))
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"))))


def _met(rows: DataFrame, looked_up: DataFrame, key: str, total: int, size: str) -> DataFrame:
    """rows joined with one line per key; lines of keys that many rows hold are broadcast.

    ``looked_up`` says in ``size`` how many rows hold its key. At most HOT_KEYS
    keys can hold more than a HOT_KEYS-th of all rows, so that list is bounded at
    any size; no other key brings more than that share to one task.
    """
    limit = max(1, total // HOT_KEYS)
    hot = looked_up.where(F.col(size) > limit)
    cold = looked_up.where(F.col(size) <= limit)
    marked = rows.join(F.broadcast(hot.select(key, F.lit(True).alias("_hot"))), key, "left")
    return (
        marked.where("_hot").drop("_hot").join(F.broadcast(hot), key)
        .unionByName(marked.where("_hot is null").drop("_hot").join(cold, key))
    )


def similar_classes(classes: DataFrame, *, num: int, den: int) -> DataFrame:
    """a, b, common, united of all pairs of classes (class, words) whose words overlap to num / den or more.

    Every pair stands once, with a < b. Words are put in order of how many
    classes hold them. Classes that share a word of their prefixes meet under
    that word and the size of the larger one, in blocks of BLOCK classes.
    """
    words = classes.select("class", F.size("words").alias("n"), F.explode("words").alias("word"))
    held = words.groupBy("word").agg(F.count("*").alias("holders"))
    total = held.select(F.coalesce(F.sum("holders"), F.lit(0))).first()[0]
    ordered = (
        _met(words, held, "word", total, "holders").groupBy("class", "n")
        .agg(F.array_sort(F.collect_list(F.struct("holders", "word"))).alias("ranked"))
    )
    n = F.col("n")
    first = n - F.ceil(n * num / den).cast("int") + 1
    prefix = ordered.select(
        "class", "n", F.posexplode(F.slice("ranked", 1, first)).alias("place", "ranked")
    ).select("class", "n", "place", F.col("ranked.word").alias("word"))

    # The smaller set looks up every size that is not too large for it.
    largest = F.floor(n * den / num).cast("int")
    sizes = prefix.groupBy("word", "n").agg(F.count("*").alias("_count")).select(
        "word", F.col("n").alias("size"), F.ceil(F.col("_count") / BLOCK).cast("int").alias("blocks")
    )
    asking = prefix.select(
        "word", F.col("class").alias("_a"), F.col("n").alias("_na"), F.col("place").alias("_pa"),
        F.explode(F.sequence(n, largest)).alias("size"),
    ).join(sizes, ["word", "size"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    given = prefix.withColumnRenamed("n", "size").join(sizes, ["word", "size"]).withColumn(
        "block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    ).drop("blocks")
    left = F.least(F.col("_na") - F.col("_pa"), F.col("size") - F.col("place"))  # at most so many words in common
    once = (F.col("_na") < F.col("size")) | (F.col("_a") < F.col("class"))
    pairs = (
        asking.join(given, ["word", "size", "block"])
        .where(once & (left * (num + den) >= (F.col("_na") + F.col("size")) * num))
        .select(F.least("_a", "class").alias("a"), F.greatest("_a", "class").alias("b")).distinct()
    )
    compared = (
        pairs.join(classes.select(F.col("class").alias("a"), F.col("words").alias("_x")), "a")
        .join(classes.select(F.col("class").alias("b"), F.col("words").alias("_y")), "b")
        .select("a", "b", F.size(F.array_intersect("_x", "_y")).alias("common"), (F.size("_x") + F.size("_y")).alias("_both"))
    )
    return compared.select("a", "b", "common", (F.col("_both") - F.col("common")).alias("united")).where(
        F.col("common") * den >= F.col("united") * num
    )


def similar_repairs(
    history: DataFrame, *, keep: int = 10, at_least: tuple[int, int] = (7, 10), columns: tuple[str, ...] = REPAIR_TEXT,
) -> DataFrame:
    """For every repair record its most similar other records, best first.

    maintenance_id, case_rank, similar_id, similarity (Jaccard of the words of
    ``columns``, at least ``at_least``); equal ones go by the newest completion
    (open ones first), then by the larger id. Records without words have no
    similar ones; a record that stands twice is one case. Each class keeps only
    its ``keep`` + 1 newest records, which is all that any case can ask for.
    """
    num, den = (x // gcd(*at_least) for x in at_least)
    cases = history.select(
        "maintenance_id", "completed_at", words_of(history, columns).alias("words")
    ).where(F.size("words") > 0).dropDuplicates(["maintenance_id"])
    named = cases.withColumn("class", F.md5(F.array_join("words", " ")))
    order = [F.desc_nulls_first("completed_at"), F.desc("maintenance_id")]
    newest = (
        named.withColumn("_rn", F.row_number().over(Window.partitionBy("class").orderBy(*order)))
        .where(F.col("_rn") <= keep + 1)
        .select(F.col("class").alias("other"), F.col("maintenance_id").alias("similar_id"), "completed_at")
    )
    classes = durable(named.groupBy("class").agg(F.first("words").alias("words"), F.count("*").alias("members")))
    similarity = F.col("common") / F.col("united")
    both_ways = F.explode(F.array(
        F.struct(F.col("a"), F.col("b").alias("other")), F.struct(F.col("b").alias("a"), F.col("a").alias("other"))
    ))
    links = (
        similar_classes(classes, num=num, den=den)
        .select(both_ways.alias("_link"), similarity.alias("similarity")).select("_link.*", "similarity")
        .unionByName(classes.select(F.col("class").alias("a"), F.col("class").alias("other"), F.lit(1.0).alias("similarity")))
    )
    best = Window.partitionBy("a").orderBy(F.desc("similarity"), *[F.desc_nulls_first("completed_at"), F.desc("similar_id")])
    listed = (
        links.join(newest, "other").withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= keep + 1)
        .groupBy("a").agg(F.array_sort(F.collect_list(F.struct("_rn", "similar_id", "similarity"))).alias("_listed"))
        .withColumnRenamed("a", "class")
        .join(classes.select("class", "members"), "class")
    )
    total = classes.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    found = _met(named.select("class", "maintenance_id"), listed, "class", total, "members")
    others = F.slice(F.filter("_listed", lambda x: x["similar_id"] != F.col("maintenance_id")), 1, keep)
    return found.select("maintenance_id", F.posexplode(others).alias("_place", "_one")).select(
        "maintenance_id", (F.col("_place") + 1).cast("long").alias("case_rank"),
        F.col("_one.similar_id").alias("similar_id"), F.col("_one.similarity").alias("similarity"),
    )
