"""Merkle manifest of a dataset: one tree per source, and a tree over the sources' roots.

Every level is a table of nodes (tree, n, idx, digest), ``idx`` gapless from 0 in each tree.  A
node's run is ``idx div arity`` and its slot ``idx mod arity``.  Nodes meet their siblings in an
equijoin of the level with itself: the siblings of slot s are those at the shifted slots
(s + k) mod arity, k from 1 to arity - 1, and s XOR 1 in a binary tree.  The joined rows of slot
zero then emit the run's parent, until each tree has one node left.

Going down again, a node's path is its own siblings followed by the path of its parent, so a leaf
only meets the path of its run.  Folding a leaf along it gives the root that a reader of the
manifest would compute.

No tree is gathered in one task: leaves are numbered by range partitions and the counts of these,
and joins are keyed by runs, which hold ``arity`` rows at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import saved

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<before:string,after:string>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def stated(value: Column) -> Column:
    """A value with its UTF-8 byte count in front, or ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``idx``, gapless from 0 by ``order`` (nulls first) in each ``tree``, and the tree's row count ``n``.

    Rows that agree in all of ``order`` follow each other as they are read.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = saved(rows.withColumn("at", F.monotonically_increasing_id())
                   .repartitionByRange(width, "tree", *order, "at").withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows"))
    of_tree = Window.partitionBy("tree")
    first = F.coalesce(F.sum("rows").over(of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chained = counts.select("tree", "part", first.alias("first"), F.sum("rows").over(of_tree).alias("n"))
    within = Window.partitionBy("tree", "part").orderBy(*order, "at")
    return (ranged.withColumn("k", F.row_number().over(within) - 1).join(chained, ["tree", "part"])
            .select(*rows.columns, "n", (F.col("first") + F.col("k")).alias("idx")))


def with_siblings(nodes: DataFrame, level: DataFrame, arity: int) -> DataFrame:
    """``nodes`` with ``before`` and ``after``: the joined digests of their siblings in ``level`` at lower and at higher slots."""
    run, slot = F.floor(F.col("idx") / arity), (F.col("idx") % arity).cast("int")
    own = nodes.withColumns({"run": run, "slot": slot})
    other = level.select(F.col("tree").alias("s_tree"), run.alias("s_run"), slot.alias("s_slot"), F.col("digest").alias("s_digest"))
    if arity == 2:
        shifted = F.col("s_slot").bitwiseXOR(F.col("slot")) == 1
    else:
        shifted = F.pmod(F.col("s_slot") - F.col("slot"), F.lit(arity)) > 0
    joined = own.join(other, (F.col("tree") == F.col("s_tree")) & (F.col("run") == F.col("s_run")) & shifted, "left")
    found = F.array_sort(F.collect_list(F.when(F.col("s_slot").isNotNull(), F.struct("s_slot", "s_digest"))))
    grouped = joined.groupBy("tree", "run", "slot").agg(F.first(F.struct(*nodes.columns)).alias("node"), found.alias("s"))

    def side(low: bool) -> Column:
        kept = F.filter("s", lambda x: x["s_slot"] < F.col("slot") if low else x["s_slot"] > F.col("slot"))
        return F.array_join(F.transform(kept, lambda x: x["s_digest"]), "")

    return grouped.select("node.*", side(True).alias("before"), side(False).alias("after"))


def levels(nodes: DataFrame, arity: int = ARITY) -> list[DataFrame]:
    """The tables of nodes (tree, n, idx, digest) from ``nodes`` up; the last node of a tree goes no further.

    ``n`` is the number of nodes that the tree has in the level.
    """
    if arity < 2:
        raise ValueError("a run has two nodes at least")
    out = [nodes.select("tree", "n", "idx", "digest")]
    while not (rising := out[-1].where("n > 1")).isEmpty():
        first = with_siblings(rising.where(F.col("idx") % arity == 0), rising, arity)
        out.append(saved(first.select("tree", F.ceil(F.col("n") / arity).alias("n"), F.floor(F.col("idx") / arity).alias("idx"),
                                      digest("before", "digest", "after").alias("digest"))))
    return out


def roots(tables: list[DataFrame]) -> DataFrame:
    """tree and digest of the node that remains of each tree."""
    out = None
    for table in tables:
        last = table.where("n = 1").select("tree", "digest")
        out = last if out is None else out.unionByName(last)
    return out


def run_paths(tables: list[DataFrame], above: DataFrame, arity: int = ARITY) -> DataFrame:
    """tree, run, subroot, and the siblings that a leaf still meets above its run: ``path``, structs (before, after) upwards.

    ``above`` has the columns tree, subroot and ``path`` of a tree's root, which its paths end with.
    A lone leaf counts as a run of its own.
    """
    def top(k: int) -> DataFrame:
        return tables[k].where("n = 1").join(above, "tree").select("tree", "idx", "subroot", "path")

    paths = None
    for k in reversed(range(1, len(tables))):
        here = top(k)
        if paths is not None:
            rising = tables[k].where("n > 1")
            met = with_siblings(rising, rising, arity)
            parents = paths.select(F.col("tree").alias("p_tree"), F.col("idx").alias("p_idx"), "subroot", "path")
            joined = met.join(parents, (F.col("tree") == F.col("p_tree")) & (F.floor(F.col("idx") / arity) == F.col("p_idx")))
            here = here.unionByName(joined.select("tree", "idx", "subroot", F.concat(
                F.array(F.struct("before", "after")), F.col("path")).alias("path")))
        paths = here
    lone = top(0).select("tree", F.col("idx").alias("run"), "subroot", "path")
    if paths is None:
        return lone
    return saved(lone.unionByName(paths.select("tree", F.col("idx").alias("run"), "subroot", "path")))


def folded(start: Column, path: Column) -> Column:
    """The root that ``start`` leads to by the siblings of ``path``."""
    return F.aggregate(path, start, lambda node, x: digest(x["before"], node, x["after"]))


def lower_case(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def crc_divisible(column: str, by: int) -> Column:
    """Whether ``by`` divides the unsigned CRC-32 of the decimal value; false for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % by == 0, F.lit(False))


def manifest(docs: DataFrame, changed: Column | None = None, arity: int = ARITY) -> DataFrame:
    """doc_id, source, idx, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs``.

    ``docs`` has the columns FIELDS, others are ignored.  ``changed`` says which rows are held
    against the manifest in a changed form, with A-Z of their text lower-cased; without it all
    are held as they are.  ``folded_root`` is computed from that form and the siblings of the
    manifest.

    Null values enter a leaf as ``-``; a null source is a source of its own, ordered first.  Rows with the
    same source and doc_id are ordered by their leaf; repeated rows are leaves each.  A null id
    counts as lowest.  A lone leaf is its source's subroot, a lone subroot the root, and a leaf
    without any sibling has the digest of the empty string as its proof.  An empty table gives no rows.
    """
    held = F.col("text") if changed is None else F.when(changed, lower_case(F.col("text"))).otherwise(F.col("text"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                      F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"),
                      F.col("text").cast("string").alias("text"))
    leaf = digest(*[stated(F.col(c)) for c in FIELDS])
    other = digest(*[stated(held if c == "text" else F.col(c)) for c in FIELDS])
    leaves = own.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree"), "doc_id", leaf.alias("digest"),
                        F.when(held != F.col("text"), other).alias("held"))
    leaves = saved(numbered(leaves, ["doc_id", "digest"]))
    tables = levels(leaves, arity)
    subroots = saved(roots(tables).withColumnRenamed("tree", "name").withColumn("tree", F.lit("")))
    heads = saved(numbered(subroots, ["name"]))
    upper = levels(heads, arity)
    root = roots(upper).first()  # one digest
    over = run_paths(upper, roots(upper).select("tree", F.col("digest").alias("subroot"), F.array().cast(_PATH).alias("path")), arity)
    above = _meet(heads, over, arity).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "path")
    paths = run_paths(tables, saved(above), arity)
    met = _meet(leaves, paths, arity)
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), "")
    value = F.lit(root["digest"] if root else None).cast("string")
    out = met.select("doc_id", F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).alias("source"), "idx",
                     F.col("digest").alias("leaf"), "subroot", value.alias("root"), F.sha2(siblings, 256).alias("proof_sha256"),
                     folded(F.coalesce("held", "digest"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _meet(nodes: DataFrame, paths: DataFrame, arity: int) -> DataFrame:
    """``nodes`` of the lowest level with subroot and their whole ``path``.

    Siblings and paths are joined by tree and run, so the nodes are shuffled once, before they
    carry any siblings.
    """
    met = with_siblings(nodes, nodes, arity).withColumn("run", F.floor(F.col("idx") / arity))
    own = F.when(F.col("n") == 1, F.array().cast(_PATH)).otherwise(F.array(F.struct("before", "after")))
    return met.join(paths, ["tree", "run"]).select(*nodes.columns, "subroot", F.concat(own, F.col("path")).alias("path"))
