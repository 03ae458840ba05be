"""Interval joins and interval-set algebra on half-open integer intervals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.ordered import DEFAULT_WIDTH, running


def overlaps(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Half-open overlap test."""
    return (lo1 < hi2) & (lo2 < hi1)


def interval_distance(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """0 when the closed intervals touch, else the gap between them."""
    return F.greatest(lo1 - hi2, lo2 - hi1, F.lit(0))


def _bins(lo: Column, last: Column, width: int) -> Column:
    return F.sequence(F.floor(lo / width), F.floor(F.greatest(lo, last) / width))


def overlap_join(left: DataFrame, right: DataFrame, part: list[str],
                 left_span: tuple[str, str], right_span: tuple[str, str],
                 width: int = 1 << 14, how: str = "inner") -> DataFrame:
    """All overlapping (left, right) rows as an equi-join on (part, bin).

    Both sides are expanded to the bins they touch and a match is kept only in the bin that
    holds the start of the overlap, so each pair appears once.  Catalyst broadcasts the
    smaller side only when its estimated size is under the session threshold.
    """
    (llo, lhi), (rlo, rhi) = left_span, right_span
    a = left.withColumn("_bin", F.explode(_bins(F.col(llo), F.col(lhi) - 1, width)))
    b = _prefixed(right.withColumn("_bin", F.explode(_bins(F.col(rlo), F.col(rhi) - 1, width))))
    r_lo, r_hi = F.col(f"_r_{rlo}"), F.col(f"_r_{rhi}")
    cond = (_same(part) & overlaps(F.col(llo), F.col(lhi), r_lo, r_hi)
            & (F.floor(F.greatest(F.col(llo), r_lo) / width) == F.col("_bin")))
    return _restore(a.join(b, cond, how), left, right, part)


def _prefixed(df: DataFrame) -> DataFrame:
    # distinct names keep self-joins unambiguous
    return df.select(*[F.col(c).alias(f"_r_{c}") for c in df.columns])


def _same(part: list[str]) -> Column:
    cond = F.col("_bin") == F.col("_r__bin")
    for p in part:
        cond = cond & (F.col(p) == F.col(f"_r_{p}"))
    return cond


def _restore(joined: DataFrame, left: DataFrame, right: DataFrame, part: list[str]) -> DataFrame:
    return joined.select(*left.columns, *[F.col(f"_r_{c}").alias(c) for c in right.columns if c not in part])


def overlap_anti(left: DataFrame, right: DataFrame, part: list[str],
                 left_span: tuple[str, str], right_span: tuple[str, str],
                 row_id: list[str], width: int = 1 << 14) -> DataFrame:
    """Rows of ``left`` (identified by ``row_id``) overlapping no row of ``right``."""
    hits = overlap_join(left, right, part, left_span, right_span, width).select(*row_id).distinct()
    return left.join(hits, row_id, "left_anti")


def point_join(points: DataFrame, intervals: DataFrame, part: list[str], pos: str,
               span: tuple[str, str], width: int = 1 << 14, how: str = "inner") -> DataFrame:
    """Each point with the intervals that hold it.  Only the interval side is expanded."""
    lo, hi = span
    a = points.withColumn("_bin", F.floor(F.col(pos) / width))
    b = _prefixed(intervals.withColumn("_bin", F.explode(_bins(F.col(lo), F.col(hi) - 1, width))))
    cond = _same(part) & (F.col(pos) >= F.col(f"_r_{lo}")) & (F.col(pos) < F.col(f"_r_{hi}"))
    return _restore(a.join(b, cond, how), points, intervals, part)


def band_join(left: DataFrame, right: DataFrame, part: list[str], a: str, b: str,
              distance: int) -> DataFrame:
    """Pairs with |a - b| <= distance; the right side is copied to three bins."""
    width = max(1, distance)
    lhs = left.withColumn("_bin", F.floor(F.col(a) / width))
    own = F.floor(F.col(b) / width)
    rhs = _prefixed(right.withColumn("_bin", F.explode(F.sequence(own - 1, own + 1))))
    cond = _same(part) & (F.abs(F.col(a) - F.col(f"_r_{b}")) <= distance)
    return _restore(lhs.join(rhs, cond), left, right, part)


def _steps(sets: dict[str, DataFrame], part: list[str], lo: str, hi: str) -> DataFrame:
    """One row per position where a set's depth changes, with ``_d_<name>``: by how much."""
    names = list(sets)
    events = None
    for name, df in sets.items():
        ends = df.where(F.col(hi) > F.col(lo)).select(
            *part, F.explode(F.array(F.struct(F.col(lo).alias("pos"), F.lit(1).alias("d")),
                                     F.struct(F.col(hi).alias("pos"), F.lit(-1).alias("d"))))
            .alias("e"))
        ends = ends.select(*part, F.col("e.pos").cast("bigint").alias("pos"),
                           *[(F.col("e.d") if n == name else F.lit(0)).cast("bigint").alias(f"_d_{n}")
                             for n in names])
        events = ends if events is None else events.unionByName(ends)
    return events.groupBy(*part, "pos").agg(*[F.sum(f"_d_{n}").alias(f"_d_{n}") for n in names])


def sweep(sets: dict[str, DataFrame], part: list[str], lo: str, hi: str,
          width: int = DEFAULT_WIDTH) -> DataFrame:
    """Elementary segments [pos, end) with the depth of every named set on them."""
    names = list(sets)
    dense = _steps(sets, part, lo, hi).withColumn("_pos", F.col("pos"))
    outputs = {f"depth_{n}": ("sum", f"_d_{n}", True) for n in names}
    outputs["end"] = ("next", "_pos", False)
    return (running(dense, part, "pos", outputs, width).where(F.col("end").isNotNull())
            .select(*part, "pos", "end", *[f"depth_{n}" for n in names]))


def _combine(left, right, part, lo, hi, keep: Callable[[Column, Column], Column], width) -> DataFrame:
    """Maximal stretches where the depths satisfy ``keep``, which is false where both are 0.

    Only positions where it turns true or false are looked at again: they alternate, so a
    stretch ends at the next one.
    """
    depths = running(_steps({"a": left, "b": right}, part, lo, hi), part, "pos",
                     {"depth_a": ("sum", "_d_a", True), "depth_b": ("sum", "_d_b", True)}, width)
    now = keep(F.col("depth_a"), F.col("depth_b"))
    before = keep(F.col("depth_a") - F.col("_d_a"), F.col("depth_b") - F.col("_d_b"))
    turns = depths.where(now != before).select(*part, F.col("pos").alias("_lo"), F.col("pos").alias("_at"), now.alias("_on"))
    return (running(turns, part, "_lo", {"_hi": ("next", "_at", False)}, width).where("_on")
            .select(*part, F.col("_lo").alias(lo), F.col("_hi").alias(hi)))


def interval_union(left, right, part, lo="lo", hi="hi", width=DEFAULT_WIDTH) -> DataFrame:
    return _combine(left, right, part, lo, hi, lambda a, b: (a > 0) | (b > 0), width)


def interval_intersect(left, right, part, lo="lo", hi="hi", width=DEFAULT_WIDTH) -> DataFrame:
    return _combine(left, right, part, lo, hi, lambda a, b: (a > 0) & (b > 0), width)


def interval_except(left, right, part, lo="lo", hi="hi", width=DEFAULT_WIDTH) -> DataFrame:
    return _combine(left, right, part, lo, hi, lambda a, b: (a > 0) & (b == 0), width)


def coverage(df: DataFrame, part: list[str], lo: str, hi: str,
             width: int = DEFAULT_WIDTH) -> DataFrame:
    """Depth segments: [pos, end) with a positive number of covering intervals."""
    return (sweep({"reads": df}, part, lo, hi, width)
            .where("depth_reads > 0").withColumnRenamed("depth_reads", "depth"))


def length_without_gaps(regions: DataFrame, gaps: DataFrame, part: list[str],
                        lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Bases of each part's region that no gap covers."""
    segments = sweep({"a": regions, "b": gaps}, part, lo, hi).where("depth_a > 0 and depth_b = 0")
    free = segments.groupBy(*part).agg(F.sum(F.col("end") - F.col("pos")).alias("free"))
    return (regions.select(*part).distinct().join(free, part, "left")
            .select(*part, F.coalesce("free", F.lit(0)).cast("bigint").alias("free_len")))


def segment_boundaries(df: DataFrame, group: list[str], lo: str, hi: str) -> DataFrame:
    """Distinct sorted interval ends of each group."""
    return (df.select(*group, F.explode(F.array(lo, hi)).alias("boundary")).distinct())
