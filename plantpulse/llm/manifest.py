"""A Merkle manifest of documents whose nodes are labelled with the leaf ranks they cover."""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window, functions as F

from plantpulse.llm.common import parts, settled

#: Consecutive nodes that become one node of the next level.
FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value as `length:value` in UTF-8 bytes, `-` if null: no two lists of fields read the same."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def every_fifth(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def ranked(rows: DataFrame, order: list[str], task_rows: int = 1 << 20) -> DataFrame:
    """The rows with their `rank` from 0 within `tree`, and the `size` of their tree.

    Rows are range-partitioned on the whole order, so a tree that holds a third
    of all rows lies in many tasks; ties are told apart by a row number. A tree
    has one line per task it lies in, and the lines before it are added up.
    """
    spark = rows.sparkSession
    rows = settled(rows.withColumn("_row", F.monotonically_increasing_id()))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts(rows.count(), task_rows))
    whole = ["tree", *order, "_row"]
    placed = settled(
        rows.repartitionByRange(tasks, *whole).sortWithinPartitions(*whole)
        .withColumn("_place", F.monotonically_increasing_id())  # task in the upper bits, place in it below
        .withColumn("_task", F.shiftright("_place", 33))
    )
    before = Window.partitionBy("tree").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    lines = placed.groupBy("tree", "_task").agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    lines = lines.select(
        "tree", "_task", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy("tree")).alias("size"),
    )
    rank = F.col("_place") - F.col("_first") + F.col("_before")
    return placed.join(lines, ["tree", "_task"]).withColumn("rank", rank).drop("_row", "_place", "_task", "_first", "_before")


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """tree, size, lo, hi, digest and load (doc_id, bad) of every document: the lowest level of the manifest.

    `tree` is the field of the source. Where `tampered` holds, `bad` is the leaf
    of the document with the capitals A-Z of its text in lower case.
    """
    known = [F.col(c) for c in FIELDS]
    rows = docs.select(
        field(F.col("source")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        digest(*map(field, known)).alias("leaf"),
        F.when(
            F.lit(False) if tampered is None else tampered,
            digest(*map(field, known[:-1]), field(lower_ascii(F.col("text").cast("string")))),
        ).alias("bad"),
    )
    return ranked(rows, ["doc_id", "leaf"]).select(
        "tree", "size", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), F.col("leaf").alias("digest"),
        F.struct("doc_id", "source", "bad").alias("load"),
    )


def _bucket(level: int) -> Column:
    """The intervals of a level start at multiples of their width: the bucket in which a containment join looks."""
    return F.floor(F.col("lo") / F.lit(FAN**level)).cast("long")


def _runs(nodes: DataFrame, level: int) -> DataFrame:
    """Nodes of `level` + 1 with the intervals and digests of the nodes they are made of."""
    load = ["load"] if "load" in nodes.columns else []
    made = nodes.groupBy("tree", "size", _bucket(level + 1).alias("bucket")).agg(
        F.sort_array(F.collect_list(F.struct("lo", "hi", "digest", *load))).alias("kids")
    )
    return made.select(
        "tree", "size", F.expr("kids[0].lo").alias("lo"), F.element_at("kids", -1)["hi"].alias("hi"),
        F.sha2(F.array_join(F.col("kids.digest"), ""), 256).alias("digest"), "kids",
    )


def grow(lowest: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level, and tree, level, lo, hi, digest of the roots of all trees.

    A tree is done at the level where it has one node. Each level has a sixteenth
    of the rows of the one below and is written to the checkpoint folder.
    """
    biggest = lowest.agg(F.max("size")).first()[0] or 0
    runs, roots, nodes, level = [], [], lowest, 0
    while True:
        roots.append(nodes.filter(F.col("size") <= FAN**level).select("tree", F.lit(level).alias("level"), "lo", "hi", "digest"))
        if biggest <= FAN**level:
            return runs, reduce(DataFrame.unionByName, roots)
        runs.append(settled(_runs(nodes.filter(F.col("size") > FAN**level), level)))
        nodes, level = runs[-1].select("tree", "size", "lo", "hi", "digest"), level + 1


def attach(lowest: DataFrame, runs: list[DataFrame], crowns: DataFrame) -> DataFrame:
    """The lowest nodes with the path from them up to the root of roots: what stands left and right of each ancestor.

    crowns: tree, level, lo, hi, subroot and path of the root of every tree. From
    the top down, the nodes of a level join the runs whose interval they contain,
    looked up by tree and level bucket; within a run the siblings of a node are
    the run's interval without its own. A run carries its path once for all its nodes.
    """
    above = crowns.filter(F.col("level") == len(runs))
    for level in reversed(range(len(runs))):
        outer = above.select("tree", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), _bucket(level + 1).alias("_bucket"), "subroot", "path")
        run = runs[level].withColumn("_bucket", _bucket(level + 1)).join(outer, ["tree", "_bucket"])
        kids = run.filter("_lo <= lo and hi <= _hi").select("tree", "subroot", "path", "kids", F.explode("kids").alias("node"))

        def beside(holds):
            return F.array_join(F.transform(F.filter("kids", holds), lambda k: k["digest"]), "")

        side = F.struct(
            beside(lambda k: k["hi"] <= F.col("node.lo")).alias("left"), beside(lambda k: k["lo"] >= F.col("node.hi")).alias("right")
        )
        nodes = kids.select("tree", "subroot", F.concat(F.array(side), "path").alias("path"), "node.*")
        if level == 0:
            below = nodes
        else:
            nodes = nodes.withColumn("level", F.lit(level)).select("tree", "level", "lo", "hi", "subroot", "path")
            above = crowns.filter(F.col("level") == level).select(nodes.columns).unionByName(nodes)
    single = lowest.filter("size = 1").join(crowns.filter("level = 0").select("tree", "subroot", "path"), "tree").drop("size")
    return single.unionByName(below.select(single.columns)) if runs else single


def _join_sides(path: str) -> Column:
    return F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), "")


def _fold(start: Column, path: str) -> Column:
    """The root that a leaf and the digests beside its ancestors give."""
    return F.aggregate(path, start, lambda so_far, p: F.sha2(F.concat(p["left"], so_far, p["right"]), 256))


def _crowned(lowest: DataFrame, runs: list[DataFrame], roots: DataFrame) -> tuple[DataFrame, str | None]:
    """The roots of all trees with their paths in the tree of sources, ordered by source; and its root."""
    subroots = roots.join(lowest.filter("lo = 0").select("tree", F.col("load.source").alias("source")), "tree")
    top = ranked(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("held"), "source", "digest"), ["source"]).select(
        "tree", "size", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest", F.struct("held").alias("load")
    )
    top = settled(top)
    over, root = grow(top)
    found = root.select("digest").first()
    crown = root.select("tree", "level", "lo", "hi", F.lit("").alias("subroot"), F.array().cast(_PATH).alias("path"))
    paths = attach(top, over, crown).select(F.col("load.held").alias("tree"), "path")
    return settled(roots.withColumnRenamed("digest", "subroot").join(paths, "tree")), found and found[0]


def manifest(docs: DataFrame) -> DataFrame:
    """The nodes of the trees of all sources: tree, level, lo, hi, digest; level 0 are the documents.

    A node covers the ranks lo to hi (exclusive) of its tree's documents. What
    lies within an interval is below a node, and two manifests differ exactly
    under the intervals whose digests differ. Sources of one document have one
    node. An empty table gives no rows.
    """
    lowest = settled(leaves(docs))
    runs, _ = grow(lowest)
    nodes = [lowest, *runs]
    rows = [n.select("tree", F.lit(level).alias("level"), "lo", "hi", "digest") for level, n in enumerate(nodes)]
    return reduce(DataFrame.unionByName, rows)


def proofs(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Leaf, roots, proof and check of every document.

    doc_id, leaf, subroot (of its source), root (of all), proof_sha256 (of the
    digests beside its ancestors, from the leaf up, left to right),
    folded_root (what the tampered leaf gives with the original proof; the own
    one where `tampered` does not hold), verified.

    Null in a column is a value of its own (`-`), a null source a source, before
    all others. Documents of one source stand in order of doc_id, null first;
    equal ids by their leaf, and repeated rows give equal leaves at neighbouring
    ranks. Empty and very long texts are hashed whole in the JVM. An empty table
    gives no rows. Other columns are ignored.
    """
    lowest = settled(leaves(docs, tampered))
    runs, roots = grow(lowest)
    crowns, root = _crowned(lowest, runs, roots)
    rows = attach(lowest, runs, crowns)
    folded = _fold(F.coalesce("load.bad", "digest"), "path")
    return rows.select(
        F.col("load.doc_id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"),
        F.sha2(_join_sides("path"), 256).alias("proof_sha256"), folded.alias("folded_root"), F.col("lo").alias("leaf_rank"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(levels: int = 8) -> str:
    """The same in SQL, for sources of up to 16 ** levels documents and as many sources.

    Every level is a table of its own: tree, position, digest, and the run it is
    made of (none where the tree was done below). crc32 goes bit by bit, since
    the other engine has no such function.
    """

    def enc(value: str) -> str:
        return f"coalesce(strlen({value})::varchar || ':' || {value}, '-')"

    head = " || ".join(map(enc, ["doc_id::varchar", "source", "lang", "n_chars::varchar"]))
    low = f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')"
    bits = "flatten([[((ascii(c) >> i) & 1)::bigint for i in range(8)] for c in string_split(doc_id::varchar, '')])"
    crc = (
        f"xor(list_reduce(list_prepend(4294967295::bigint, {bits}), lambda c, b: "
        "xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"
    )
    steps = [
        f"leaf as (select doc_id, coalesce('+' || source, '-') tree, source, sha256({head} || {enc('text')}) digest, "
        f"case when doc_id is not null and {crc} % 5 = 0 then sha256({head} || {enc(low)}) end bad from documents)",
        "s0 as (select tree, source, doc_id, bad, digest, count(*) over (partition by tree) n, "
        "row_number() over (partition by tree order by doc_id nulls first, digest) - 1 p from leaf)",
    ]

    def climb(name: str) -> None:
        for level in range(levels):
            steps.append(
                f"{name}r{level} as (select tree, p // {FAN} p, any_value(n) n, list(digest order by p) kids "
                f"from {name}{level} group by tree, p // {FAN})"
            )
            steps.append(
                f"{name}{level + 1} as (select tree, p, (n + {FAN - 1}) // {FAN} n, case when n > 1 then kids end kids, "
                f"case when n > 1 then sha256(array_to_string(kids, '')) else kids[1] end digest from {name}r{level})"
            )

    def beside(name: str, keep: str, first: int) -> str:
        """The lowest nodes with l, r, g of every level: the digests left and right, and whether a run was hashed."""
        joins, sides = "", ""
        for level in range(levels):
            at, i = f"(z.p // {FAN**level}) % {FAN}", first + level
            joins += f" join {name}{level + 1} a{level} on a{level}.tree = z.tree and a{level}.p = z.p // {FAN ** (level + 1)}"
            sides += (
                f", coalesce(array_to_string(a{level}.kids[:{at}], ''), '') l{i}, "
                f"coalesce(array_to_string(a{level}.kids[{at} + 2:], ''), '') r{i}, a{level}.kids is not null g{i}"
            )
        return f"select {keep}{sides} from {name}0 z{joins}"

    climb("s")
    steps.append(
        "t0 as (select 'all' tree, s.tree held, s.digest, count(*) over () n, row_number() over (order by l.source nulls first) - 1 p "
        f"from s{levels} s join (select distinct tree, source from leaf) l using (tree))"
    )
    climb("t")
    steps.append(f"sp as ({beside('s', 'z.tree, z.doc_id, z.digest leaf, z.bad, z.p leaf_rank', 0)})")
    steps.append(f"tp as ({beside('t', 'z.held, z.digest subroot', levels)})")
    proof = " || ".join(f"l{i} || r{i}" for i in range(2 * levels))
    steps.append(
        f"f0 as (select *, coalesce(bad, leaf) h, sha256({proof}) proof_sha256 from sp join tp on tp.held = sp.tree)"
    )
    for i in range(2 * levels):
        steps.append(f"f{i + 1} as (select * replace (case when g{i} then sha256(l{i} || h || r{i}) else h end as h) from f{i})")
    return (
        "with " + ",\n".join(steps)
        + "\nselect f.doc_id, f.leaf, f.subroot, t.digest root, f.proof_sha256, f.h folded_root, f.leaf_rank, "
        f"f.h = t.digest verified from f{2 * levels} f, t{levels} t"
    )
