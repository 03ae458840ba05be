"""Sharding by sampled splitters, with DataFrame functions only.

Records are ordered by (hash of the text, doc_id), so equal texts lie together and a group of
copies of any size can still be cut.  A size-weighted sample of keys gives quantile boundaries;
records are range-partitioned by them, and ranges that turn out overfull are cut again by
splitters from inside them.  Ranges then hold bounded work: each is numbered and its running
size taken on its own, and the ranges' totals, one row each, chain them to the exact position
of every record, from which the shard follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import saved

SHARDS = 16
#: Ranges a shard is cut into at least, and records that a range should not exceed by much.
RANGES, RANGE_ROWS = 64, 1_000_000
#: Sampled keys per range, and how many times its even share makes a range overfull.
OVERSAMPLE, OVERFULL = 12, 4


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the range key ``k`` of each row; a null text counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("k"))


def _order() -> Column:
    """The records' order as one value; a null doc_id comes first."""
    return F.struct(F.col("k").alias("k"), F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("d"))


def _splitters(sample: DataFrame, step: float) -> list[tuple[int, int]]:
    """Keys where the sample's running weight passes multiples of ``step``; ``sample`` is bounded by its callers."""
    running = F.sum("weight").over(Window.orderBy("o").rowsBetween(Window.unboundedPreceding, 0))
    rows = (sample.withColumn("q", F.floor(running / step)).groupBy("q").agg(F.min("o").alias("o"))
            .where("q > 0").select("o.k", "o.d").distinct().orderBy("k", "d").collect())
    return [(r["k"], r["d"]) for r in rows]


def _sampled(rows: DataFrame, step: float) -> DataFrame:
    """Each record with a chance of size / step: about total / step keys, each weighing what it stands for."""
    chance = F.least(F.lit(1.0), F.col("size") / F.lit(float(step)))
    draw = F.pmod(F.xxhash64("doc_id", "k", F.lit(7)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return rows.where(draw < chance).select(_order().alias("o"), (F.col("size") / chance).alias("weight"))


def _range_of(splitters: list[tuple[int, int]]) -> Column:
    """How many splitters are at most the record's key: a binary search in a constant array."""
    def constant(values):
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")

    if not splitters:
        return F.lit(0)
    ks, ds = constant([k for k, _ in splitters]), constant([d for _, d in splitters])
    bits = [F.lit(1 << b) for b in reversed(range(len(splitters).bit_length()))]
    own = _order()

    def step(at, bit):
        i = at + bit - 1
        passed = (F.get(ks, i) < own["k"]) | ((F.get(ks, i) == own["k"]) & (F.get(ds, i) <= own["d"]))
        return F.when((at + bit <= len(splitters)) & passed, at + bit).otherwise(at)

    return F.aggregate(F.array(*bits), F.lit(0), step)


def shard_by_size(docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs`` (doc_id, text).

    The law is ``bytes``: a shard is the sixteenth, say, of all bytes in which the middle of the
    record falls, so sizes differ by less than about two records.  Repeated rows and null ids
    are placed like any other row; an empty table gives no rows; other columns are ignored.
    """
    rows = saved(keyed(docs))
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(1))).first()
    pieces = max(shards * ranges, n // RANGE_ROWS)
    splitters = _splitters(_sampled(rows, total / (pieces * OVERSAMPLE)), total / pieces)
    first = rows.withColumn("r", _range_of(splitters))
    # ranges beyond their share get splitters of their own, drawn from inside them
    full = [r["r"] for r in first.groupBy("r").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("c"))
            .where((F.col("s") > OVERFULL * total / pieces) | (F.col("c") > OVERFULL * max(n / pieces, 64)))
            .select("r").collect()]
    if full:
        inside = first.where(F.col("r").isin(full))
        splitters = sorted({*splitters, *_splitters(_sampled(inside, total / (pieces * OVERSAMPLE * OVERFULL)),
                                                   total / (pieces * OVERFULL))})
    ranged = rows.withColumn("r", _range_of(splitters))
    # one row per range, chained in order
    chain = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("r").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("c")).select(
        "r", F.coalesce(F.sum("s").over(chain), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("c").over(chain), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("r").orderBy("k", "doc_id")
    placed = saved(
        ranged.withColumn("row", F.row_number().over(inside))
        .withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .join(starts, "r").select(
            "doc_id", "size", "text_crc32",
            F.expr(f"least({shards - 1}, (2 * (bytes_before + upto) - size) * {shards} div {2 * total})").cast("int").alias("shard"),
            (F.col("rows_before") + F.col("row") - 1).alias("position")))
    opening = placed.groupBy("shard").agg(F.min("position").alias("opening"))  # one row per shard
    return placed.join(F.broadcast(opening), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("position") - F.col("opening")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
