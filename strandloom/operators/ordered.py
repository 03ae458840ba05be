"""Order-dependent operators that never put a whole chromosome in one task.

A plain ``Window.partitionBy("chrom").orderBy("pos")`` sends every row of a chromosome to
one task.  Here rows are first reduced to one row per coordinate, cut into coordinate bins
that are window partitions of bounded size, and the bins are stitched with a second window
that sees one row per bin (genome length / bin width rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import saved, shuffles_dropped, tasks_for

DEFAULT_WIDTH = 1 << 16
#: Parts of no more rows are swept whole.
PART_ROWS = DEFAULT_WIDTH // 4

_TOTAL = {"sum": F.sum, "max": F.max, "min": F.min}


def log_bin(value: Column) -> Column:
    """Monotone bin of a real-valued score: fine near zero, a bounded number of bins overall."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * 1024)


def _bin(pos: str, width: int, bin_expr: Column | None) -> Column:
    return bin_expr if bin_expr is not None else F.floor(F.col(pos) / F.lit(width))


def running(df: DataFrame, part: list[str], pos: str, outputs: dict[str, tuple],
            width: int = DEFAULT_WIDTH, bin_expr: Column | None = None,
            descending: bool = False) -> DataFrame:
    """Running aggregates over ``pos`` within ``part``.

    ``df`` holds at most one row per (part, pos).  ``outputs`` maps a new column to
    ``(kind, column, inclusive)`` with kind ``sum``, ``max``, ``min``, ``last`` (last non-null)
    or ``next`` (the following non-null value).
    """
    rows = df.withColumn("_bin", _bin(pos, width, bin_expr)).repartition(*part, "_bin")
    order = F.col(pos).desc() if descending else F.col(pos).asc()
    bin_order = F.col("_bin").desc() if descending else F.col("_bin").asc()
    inner = Window.partitionBy(*part, "_bin").orderBy(order)
    totals, carries, finals = [], [], []
    across = Window.partitionBy(*part).orderBy(bin_order)
    for name, (kind, col, inclusive) in outputs.items():
        local, total, carry = f"_l_{name}", f"_t_{name}", f"_c_{name}"
        if kind == "next":
            # looking ahead is a running "last" in the opposite order; a frame that ends at
            # "unbounded following" would be re-evaluated for every row
            turned = Window.partitionBy(*part, "_bin").orderBy(F.col(pos).asc() if descending else F.col(pos).desc())
            frame = turned.rowsBetween(Window.unboundedPreceding, -1)
            rows = rows.withColumn(local, F.last(col, ignorenulls=True).over(frame))
            pick = F.max_by if descending else F.min_by
            totals.append(pick(col, F.when(F.col(col).isNotNull(), F.col(pos))).alias(total))
            back = Window.partitionBy(*part).orderBy(F.col("_bin").asc() if descending else F.col("_bin").desc())
            carries.append(F.last(total, ignorenulls=True)
                           .over(back.rowsBetween(Window.unboundedPreceding, -1)).alias(carry))
            finals.append(F.coalesce(local, carry).alias(name))
            continue
        frame = inner.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        before = across.rowsBetween(Window.unboundedPreceding, -1)
        if kind == "last":
            rows = rows.withColumn(local, F.last(col, ignorenulls=True).over(frame))
            pick = F.min_by if descending else F.max_by
            totals.append(pick(col, F.when(F.col(col).isNotNull(), F.col(pos))).alias(total))
            carries.append(F.last(total, ignorenulls=True).over(before).alias(carry))
            finals.append(F.coalesce(local, carry).alias(name))
            continue
        agg = _TOTAL[kind]
        rows = rows.withColumn(local, agg(col).over(frame))
        totals.append(agg(col).alias(total))
        carries.append(agg(total).over(before).alias(carry))
        if kind == "sum":
            finals.append((F.coalesce(F.col(local), F.lit(0))
                           + F.coalesce(F.col(carry), F.lit(0))).alias(name))
        else:
            merge = F.greatest if kind == "max" else F.least
            finals.append(merge(local, carry).alias(name))
    carry_table = (rows.groupBy(*part, "_bin").agg(*totals)
                   .select(*part, "_bin", *carries))
    return (rows.join(carry_table, [*part, "_bin"])
            .select(*[F.col(c) for c in df.columns], *finals))


def numbered(rows: DataFrame, part: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``, gapless from 0 by ``order`` within ``part``; a part may be spread over many tasks.

    The rows are cut into ranges of (part, order); each range numbers its own rows, and the
    counts of a part's ranges are chained.  Rows equal in all of ``order`` come in any order.
    """
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = saved(rows.repartitionByRange(width, *part, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(*part, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*[F.col(c).alias(f"_p_{c}") for c in part], F.col("_range").alias("_p_range"),
                          F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    on = [F.col(c).eqNullSafe(F.col(f"_p_{c}")) for c in part] + [F.col("_range") == F.col("_p_range")]
    within = Window.partitionBy(*part, "_range").orderBy(*order)
    return (ranged.withColumn("_k", F.row_number().over(within) - 1).join(first, on)
            .select(*rows.columns, (F.col("_first") + F.col("_k")).alias(name)))


def part_tasks(df: DataFrame, part: list[str], most: int = PART_ROWS) -> int:
    """Among how many tasks to deal the parts as whole window partitions; 0 if one has more than ``most`` rows."""
    with shuffles_dropped(df.sparkSession):
        sizes = df.groupBy(*part).agg(F.count(F.lit(1)).alias("_rows")).agg(F.max("_rows"), F.sum("_rows")).first()
    return 0 if (sizes[0] or 0) > most else tasks_for(sizes[1] or 0)


def part_islands(df: DataFrame, part: list[str], lo: str, hi: str, distance: int | Column) -> DataFrame:
    """``df`` with ``_island``, the smallest ``lo`` of each row's island; every part is one window partition."""
    gap = F.lit(distance) if isinstance(distance, int) else distance
    line = Window.partitionBy(*part).orderBy(lo)
    seen = df.withColumn("_prev", F.max(hi).over(line.rowsBetween(Window.unboundedPreceding, -1)))
    # rows equal in lo may come in any order: those that begin an island name the same one
    begins = F.when(F.col("_prev").isNull() | (F.col(lo) - F.col("_prev") > gap), F.col(lo))
    seen = seen.withColumn("_begins", begins)
    return seen.withColumn("_island", F.last("_begins", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))).drop("_prev", "_begins")


def _bin_islands(df: DataFrame, part: list[str], lo: str, hi: str, distance: int | Column, width: int) -> tuple[DataFrame, DataFrame, Column]:
    """Rows with their start of an island as far as their bin shows, what earlier bins add, and the island from both.

    Of the starts inside a bin those within ``distance`` of the farthest earlier ``hi`` are none,
    and what follows them belongs to the island that the bin before ends with.
    """
    gap = F.lit(distance) if isinstance(distance, int) else distance
    dense = df.groupBy(*part, lo).agg(F.max(hi).alias("_far")).withColumn("_bin", _bin(lo, width, None)).repartition(*part, "_bin")
    within = Window.partitionBy(*part, "_bin").orderBy(lo)
    seen = dense.withColumn("_prev", F.max("_far").over(within.rowsBetween(Window.unboundedPreceding, -1)))
    begins = F.when(F.col("_prev").isNull() | (F.col(lo) - F.col("_prev") > gap), F.col(lo))
    seen = seen.withColumn("_start", F.last(begins, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy(*part).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    stands = F.col("_reach").isNull() | (F.col("_start") - F.col("_reach") > gap)
    carry = seen.groupBy(*part, "_bin").agg(F.max("_far").alias("_most"), F.max("_start").alias("_start"))
    carry = carry.withColumn("_reach", F.max("_most").over(before))
    carry = carry.select(*part, "_bin", "_reach", F.last(F.when(stands, F.col("_start")), ignorenulls=True).over(before).alias("_open"))
    return seen, carry, F.when(stands, F.col("_start")).otherwise(F.col("_open"))


def islands(df: DataFrame, part: list[str], lo: str, hi: str, distance: int | Column = 0,
            width: int = DEFAULT_WIDTH) -> DataFrame:
    """Gaps and islands over closed intervals.

    Returns one row per (part, lo): the largest ``hi`` starting there and ``island``, the
    smallest ``lo`` of its island.  A new island starts where ``lo`` exceeds the running
    maximum of the earlier ``hi`` by more than ``distance``, a number or a column of ``part``.
    """
    seen, carry, island = _bin_islands(df, part, lo, hi, distance, width)
    out = seen.join(carry, [*part, "_bin"]).withColumn("island", island)
    return out.select(*part, lo, *([] if hi == lo else [F.col("_far").alias(hi)]), "island")


def island_spans(df: DataFrame, part: list[str], lo: str, hi: str, distance: int | Column = 0,
                 width: int = DEFAULT_WIDTH) -> DataFrame:
    """One row per island: ``lo`` and ``hi`` of the merged interval.

    Parts of no more rows than a quarter of a bin's positions are swept whole, after a single shuffle.
    """
    tasks = part_tasks(df, part, width // 4)
    if tasks:
        return (part_islands(df.select(*part, lo, F.col(hi).alias("_far")).repartition(tasks, *part), part, lo, "_far", distance)
                .groupBy(*part, "_island").agg(F.max("_far").alias("_hi"))
                .select(*part, F.col("_island").alias(lo), F.col("_hi").alias(hi)))
    seen, carry, island = _bin_islands(df, part, lo, hi, distance, width)
    # a bin's islands first: only those that reach over its edges meet others
    own = seen.groupBy(*part, "_bin", "_start").agg(F.max("_far").alias("_far"))
    return (own.join(carry, [*part, "_bin"]).withColumn("_island", island)
            .groupBy(*part, "_island").agg(F.max("_far").alias("_hi"))
            .select(*part, F.col("_island").alias(lo), F.col("_hi").alias(hi)))


def assign_islands(df: DataFrame, part: list[str], lo: str, hi: str,
                   distance: int | Column = 0, width: int = DEFAULT_WIDTH) -> DataFrame:
    """``df`` with its ``island``; the lookup side has one row per coordinate."""
    lookup = islands(df, part, lo, hi, distance, width).select(*part, lo, "island")
    return df.join(lookup, [*part, lo])


def merge_nearby(df: DataFrame, part: list[str], lo: str, hi: str, distance: int | Column,
                 aggs: list[Column], width: int = DEFAULT_WIDTH) -> DataFrame:
    """Islands reduced with user aggregates, the DataFrame form of a merge function."""
    return assign_islands(df, part, lo, hi, distance, width).groupBy(*part, "island").agg(*aggs)


def centered_window(df: DataFrame, part: list[str], pos: str, value: str, window: int,
                    width: int = DEFAULT_WIDTH) -> DataFrame:
    """Sum, count and mean of ``value`` over [pos - ceil((w-1)/2), pos + floor((w-1)/2)].

    Positions near a bin edge are also sent to the neighbouring bins, so every window is
    complete inside one bounded partition.
    """
    left, right = -(-(window - 1) // 2), (window - 1) // 2
    dense = df.groupBy(*part, pos).agg(F.sum(value).alias("_v"), F.count(value).alias("_n"))
    own = F.floor(F.col(pos) / width)
    spread = dense.withColumn("_own", own).withColumn(
        "_bin", F.explode(F.sequence(F.floor((F.col(pos) - right) / width),
                                     F.floor((F.col(pos) + left) / width))))
    frame = Window.partitionBy(*part, "_bin").orderBy(pos).rangeBetween(-left, right)
    return (spread.withColumn("window_sum", F.sum("_v").over(frame))
            .withColumn("window_count", F.sum("_n").over(frame))
            .where("_bin = _own")
            .select(*part, pos, "window_sum", "window_count",
                    (F.col("window_sum") / F.col("window_count")).alias("window_mean")))


def add_tracks(*tracks: DataFrame, part: list[str], pos: str, value: str) -> DataFrame:
    """Pointwise sum of signal tracks."""
    merged = tracks[0]
    for track in tracks[1:]:
        merged = merged.unionByName(track)
    return merged.groupBy(*part, pos).agg(F.sum(value).alias(value))
