"""Merging clip, split and discordant evidence into breakpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.config import CallConfig
from strandloom.operators.interval import band_join, overlap_join
from strandloom.operators.ordered import PART_ROWS, assign_islands, island_spans, part_islands, part_tasks
from strandloom.session import TASK_ROWS, checkpoint, saved


def softclip_clusters(clips: DataFrame, cfg: CallConfig, most: int = PART_ROWS) -> DataFrame:
    """Soft clips of one orientation merged over nearby positions and all libraries.

    The first aggregation leaves one row per position, so a position holding any share of all
    clips is combined map-side and never regrouped row by row.  It is written out, as islands read it
    more than once.  Where no contig has more than ``most`` positions, each is swept as a whole.
    """
    part = ["chrom", "is_right"]
    by_pos = saved(clips.groupBy(*part, "pos").agg(
        F.count(F.lit(1)).alias("n"), F.sum("mapq").alias("mapq"),
        F.max("bases_clipped").alias("clip"), F.max("bases_mapped").alias("mapped"),
        F.sum(F.col("is_reverse").cast("int")).alias("minus"),
        F.collect_set("lib").alias("libs")))
    tasks = part_tasks(by_pos, part, most)
    if tasks:
        grouped = part_islands(by_pos.repartition(tasks, *part), part, "pos", "pos", cfg.max_softclip_merge_distance)
        grouped = grouped.withColumnRenamed("_island", "island")
    else:
        grouped = assign_islands(by_pos, part, "pos", "pos", cfg.max_softclip_merge_distance)
    best = F.max_by(F.struct("pos", "n", "mapq"), F.struct(F.col("n"), -F.col("pos")))
    merged = grouped.groupBy(*part, "island").agg(
        best.alias("_b"), F.sum("n").alias("num_reads"), F.sum("minus").alias("num_minus"),
        F.max(F.col("pos") + F.col("clip")).alias("_c_hi"), F.min(F.col("pos") - F.col("clip")).alias("_c_lo"),
        F.max(F.col("pos") + F.col("mapped")).alias("_m_hi"),
        F.min(F.col("pos") - F.col("mapped")).alias("_m_lo"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("libs")))).alias("libs"))
    right, pos = F.col("is_right"), F.col("_b.pos")
    return merged.where(F.col("num_reads") >= cfg.min_softclip_support).select(
        *part, pos.alias("pos"), F.col("num_reads"), F.col("_b.n").alias("num_reads_exact"),
        F.col("_b.mapq").alias("sum_mapq"),
        F.when(right, F.col("_c_hi") - pos).otherwise(pos - F.col("_c_lo")).alias("bases_clipped"),
        F.when(right, pos - F.col("_m_lo")).otherwise(F.col("_m_hi") - pos).alias("bases_mapped"),
        "num_minus", (F.col("num_reads") - F.col("num_minus")).alias("num_plus"), "libs")


def microhomology_candidates(clusters: DataFrame, cfg: CallConfig) -> DataFrame:
    """Left- and right-clip clusters that overlap like an insertion or inversion junction."""
    pick = lambda right, tag: clusters.where(F.col("is_right") == right).select(
        "chrom", F.col("pos").alias(f"{tag}_pos"), F.col("bases_mapped").alias(f"{tag}_mapped"),
        F.col("num_reads").alias(f"{tag}_reads"))
    near = band_join(pick(False, "l"), pick(True, "r"), ["chrom"], "l_pos", "r_pos",
                     cfg.max_insertion_inversion_mh)
    diff = F.col("r_pos") - F.col("l_pos")
    return near.where((diff > 0) & (F.col("l_mapped") > diff) & (F.col("r_mapped") > diff))


#: Positions whose pairs are matched in one go.
MATCH_WIDTH = 4096


def _first_free(bins: list[str], left: str, right: str, columns: list[str]) -> Callable:
    """Takes sorted pairs in order while both ends are free, each bin for itself.

    A bin starts with the right ends in ``_taken`` lost.  Only those that a later left end can still meet are held.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, used, room, last, pick = None, set(), 0, None, None
        for batch in batches:
            kept = []
            lost = batch.column("_taken") if "_taken" in batch.schema.names else None
            for i, (*key, a, b) in enumerate(zip(*[batch.column(c).to_pylist() for c in [*bins, left, right]])):
                if key != current:
                    current, used, room, last, pick = key, set(lost[i].as_py() if lost is not None else ()), 1024, None, None
                if a != last:
                    last, pick = a, None
                    if len(used) > room:
                        used = {x for x in used if x >= a}
                        room = 1024 + 2 * len(used)
                if pick is None and b not in used:
                    pick = b
                    used.add(b)
                kept.append(b == pick)
            yield batch.select(columns).filter(pa.array(kept, pa.bool_()))
    return scan


def greedy_matching(pairs: DataFrame, part: list[str], left: str, right: str, width: int = MATCH_WIDTH,
                    most: int = TASK_ROWS) -> DataFrame:
    """One-to-one matching that takes pairs in (left, right) order, with right >= left.

    Where no part has more than ``most`` pairs, each is sorted and scanned as a whole, many in a task call.

    Else the pairs of ``width`` left positions are a bin, and all bins are matched at the same time,
    first as if no right end were lost to the bin before.  Bins for which that turns out wrong are
    matched again with what the bin before took, until nothing changes.  A bin is right as soon
    as the one before it is; in most data the second round already settles all.  Rounds never exceed the
    number of bins that one chain of conflicts runs through.
    """
    pairs = saved(pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull()))
    tasks = part_tasks(pairs, part, most)
    if tasks:
        line = pairs.repartition(tasks, *part).sortWithinPartitions(*part, left, right)
        return line.mapInArrow(_first_free(part, left, right, pairs.columns), pairs.schema)
    keys = pairs.select(*part, F.col(left).cast("long").alias("_l"), F.col(right).cast("long").alias("_r")).distinct()
    longest = keys.agg(F.max(F.col("_r") - F.col("_l"))).first()[0]
    width = max(width, 1 + (longest or 0))  # so that a bin only bears on the next one
    keys = saved(keys.withColumn("_bin", F.floor(F.col("_l") / width)))
    bins = [*part, "_bin"]
    none = F.array().cast("array<bigint>")
    schema = keys.withColumn("_round", F.lit(0)).select(*bins, "_l", "_r", "_round").schema

    def same(prefix: str) -> list[Column]:
        return [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in bins]

    todo = saved(keys.select(*bins).distinct().withColumn("_taken", none).withColumn("_round", F.lit(0)))
    state = todo  # what each bin was last matched with
    rows, k = None, 0
    while True:
        named = todo.select(*[F.col(c).alias(f"t_{c}") for c in bins], "_taken", "_round")
        fresh = saved(keys.join(named, same("t_")).select(*bins, "_l", "_r", "_taken", "_round")
                      .repartition(*bins).sortWithinPartitions(*bins, "_l", "_r")
                      .mapInArrow(_first_free(bins, "_l", "_r", schema.names), schema))
        rows = fresh if rows is None else saved(_without(rows, todo, bins).unionByName(fresh))
        lost = rows.where(F.col("_r") >= (F.col("_bin") + 1) * width).groupBy(*bins).agg(F.array_sort(F.collect_list("_r")).alias("_lost"))
        lost = lost.select(*[F.col(c).alias(f"o_{c}") for c in part], (F.col("_bin") + 1).alias("o__bin"), "_lost")
        k += 1
        found = state.join(lost, same("o_"), "left").select(*bins, "_taken", F.coalesce("_lost", none).alias("_now"))
        todo = saved(found.where("_taken <> _now").select(*bins, F.col("_now").alias("_taken"), F.lit(k).alias("_round")))
        if todo.isEmpty():
            break
        state = saved(_without(state, todo, bins).unionByName(todo))
    chosen = rows.select(*[F.col(c).alias(f"m_{c}") for c in part], F.col("_l").alias("m_l"), F.col("_r").alias("m_r"))
    on = [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in part] + [F.col(left) == F.col("m_l"), F.col(right) == F.col("m_r")]
    return pairs.join(chosen, on, "left_semi")


def _without(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    named = other.select(*[F.col(c).alias(f"w_{c}") for c in keys])
    return rows.join(named, [F.col(c).eqNullSafe(F.col(f"w_{c}")) for c in keys], "left_anti")


EVIDENCE = ["chrom", "lo", "hi", "level", "clip_left", "clip_right", "kind", "member", "mtype"]


def clip_breakpoints(clusters: DataFrame, cfg: CallConfig) -> DataFrame:
    """Matched clip pairs as intervals, the rest as points."""
    pairs = greedy_matching(microhomology_candidates(clusters, cfg), ["chrom"], "l_pos", "r_pos")
    joint = pairs.select("chrom", F.col("l_pos").alias("lo"), F.col("r_pos").alias("hi"),
                         F.col("l_reads").alias("clip_left"), F.col("r_reads").alias("clip_right"))
    used = pairs.select("chrom", F.lit(False).alias("is_right"), F.col("l_pos").alias("pos")).unionByName(
        pairs.select("chrom", F.lit(True).alias("is_right"), F.col("r_pos").alias("pos")))
    rest = clusters.join(used, ["chrom", "is_right", "pos"], "left_anti")
    n = F.col("num_reads")
    single = rest.select("chrom", F.col("pos").alias("lo"), F.col("pos").alias("hi"),
                         F.when(F.col("is_right"), 0).otherwise(n).alias("clip_left"),
                         F.when(F.col("is_right"), n).otherwise(0).alias("clip_right"))
    return joint.unionByName(single)


def union_evidence(clips: DataFrame, splits: DataFrame, pe: DataFrame) -> DataFrame:
    """All evidence as breakpoint rows.

    ``clips`` from :func:`clip_breakpoints`; ``splits`` one row per split read;
    ``pe`` one row per (passing cluster member, side): chrom, lo, hi, qname, dtype.
    """
    null = F.lit(None).cast("string")
    c = clips.select("chrom", F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"),
                     F.lit(2).alias("level"), F.col("clip_left").cast("bigint").alias("clip_left"),
                     F.col("clip_right").cast("bigint").alias("clip_right"),
                     F.lit("clip").alias("kind"), null.alias("member"), null.alias("mtype"))
    zero = F.lit(0).cast("bigint")
    s = splits.select("chrom", F.explode(F.array(
        F.struct(F.col("bp1_lo").alias("lo"), F.col("bp1_hi").alias("hi")),
        F.struct(F.col("bp2_lo").alias("lo"), F.col("bp2_hi").alias("hi")))).alias("b"),
        "split_id", "split_type")
    s = s.select("chrom", F.col("b.lo").cast("bigint").alias("lo"), F.col("b.hi").cast("bigint").alias("hi"),
                 F.lit(2).alias("level"), zero.alias("clip_left"), zero.alias("clip_right"),
                 F.lit("split").alias("kind"), F.col("split_id").alias("member"),
                 F.col("split_type").alias("mtype"))
    p = pe.select("chrom", F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"),
                  F.lit(1).alias("level"), zero.alias("clip_left"), zero.alias("clip_right"),
                  F.lit("pe").alias("kind"), F.col("qname").alias("member"), F.col("dtype").alias("mtype"))
    return c.unionByName(s).unionByName(p)


def _touching(low: DataFrame, high: DataFrame) -> DataFrame:
    """``low`` rows with ``bp_lo`` and ``bp_hi`` of each of the ``high`` hulls that they touch."""
    closed = lambda df, lo, hi: df.withColumn("_lo", F.col(lo)).withColumn("_hi", F.col(hi) + 1)
    return overlap_join(closed(low, "lo", "hi"), closed(high, "bp_lo", "bp_hi")
                        .withColumnsRenamed({"_lo": "_blo", "_hi": "_bhi"}), ["chrom"],
                        ("_lo", "_hi"), ("_blo", "_bhi")).select(*low.columns, "bp_lo", "bp_hi")


def _in_contigs(evidence: DataFrame) -> DataFrame:
    """``evidence`` with ``bp_lo``, where the hull of each row begins, by one sort of every contig.

    A level-1 row that touches a level-2 hull has no hull of its own, so its ``bp_lo`` is null.
    """
    line = Window.partitionBy("chrom").orderBy("lo", F.col("level").desc())
    before, upto = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(Window.unboundedPreceding, 0)
    lo, hi, high, low = F.col("lo"), F.col("hi"), F.col("level") == 2, F.col("level") == 1
    rows = evidence.where(high | low).withColumns({
        "_reach": F.max(F.when(high, hi)).over(before),
        "_next": F.expr("lead(if(level = 2, lo, null)) ignore nulls over (partition by chrom order by lo, level desc)")})
    # beyond the reach of the rows before, a level-2 row starts another hull, which is touched if it starts in time
    alone = low & ~(F.coalesce(F.col("_reach") >= lo, F.lit(False)) | F.coalesce(F.col("_next") <= hi, F.lit(False)))
    rows = rows.withColumn("_alone", alone)
    rows = rows.withColumn("_far", F.when(high, F.col("_reach")).otherwise(F.max(F.when(F.col("_alone"), hi)).over(before)))
    rows = rows.withColumn("_begins", F.when((high | F.col("_alone")) & (F.col("_far").isNull() | (lo > F.col("_far"))), lo))
    begun = lambda which: F.when(which, F.last(F.when(which, F.col("_begins")), ignorenulls=True).over(upto))
    return rows.withColumn("bp_lo", F.coalesce(begun(high), begun(F.col("_alone")))).select(*evidence.columns, "bp_lo")


def _contig_hulls(placed: DataFrame) -> DataFrame:
    return placed.where("bp_lo is not null").groupBy("chrom", "level", "bp_lo").agg(F.max("hi").alias("bp_hi"))


def _linked_in_contigs(evidence: DataFrame, has_low: bool = True) -> DataFrame:
    """``evidence`` with ``bp_lo`` and ``bp_hi`` of the hulls it belongs to; ``has_low`` tells whether it has level-1 rows."""
    placed = _in_contigs(evidence)
    linked = placed.where("bp_lo is not null").withColumn("bp_hi", F.max("hi").over(Window.partitionBy("chrom", "level", "bp_lo")))
    if not has_low:
        return linked
    high = _contig_hulls(_in_contigs(evidence.where("level = 2").select("chrom", "level", "lo", "hi"))).select("chrom", "bp_lo", "bp_hi")
    return linked.unionByName(_touching(placed.where("level = 1 and bp_lo is null").drop("bp_lo"), high))


def precedence_hulls(evidence: DataFrame, most: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """(hulls, links): merged intervals and the evidence interval -> hull mapping.

    Level-2 evidence (clips and splits) is merged on its own; a level-1 interval touching such
    hulls adds its support to each of them without widening it, and the remaining level-1
    intervals are merged among themselves.

    Where no contig has more than ``most`` rows, each is sorted once as a whole.
    """
    tasks = part_tasks(evidence, ["chrom"], most)
    if tasks:
        rows = evidence.select("chrom", "level", "lo", "hi").repartition(tasks, "chrom")
        return _contig_hulls(_in_contigs(rows)).select("chrom", "bp_lo", "bp_hi"), _linked_in_contigs(rows).distinct()
    spans = evidence.groupBy("chrom", "level", "lo").agg(F.max("hi").alias("hi"))
    intervals = evidence.select("chrom", "level", "lo", "hi").distinct()
    high = checkpoint(island_spans(spans.where("level = 2"), ["chrom"], "lo", "hi").select(
        "chrom", F.col("lo").alias("bp_lo"), F.col("hi").alias("bp_hi")))
    low = intervals.where("level = 1")
    links_low = checkpoint(_touching(low.select("chrom", "level", "lo", "hi"), high))
    left = checkpoint(low.join(links_low.select("chrom", "lo", "hi").distinct(), ["chrom", "lo", "hi"], "left_anti"))
    own = _own_hulls(left.select("chrom", "level", "lo", "hi"))
    links_high = _own_hulls(intervals.where("level = 2"))
    links = checkpoint(links_high.unionByName(links_low).unionByName(own))
    hulls = links.select("chrom", "bp_lo", "bp_hi").distinct()
    return hulls, links


def _own_hulls(intervals: DataFrame) -> DataFrame:
    tagged = assign_islands(intervals.withColumnRenamed("hi", "_hi").withColumn("hi", F.col("_hi")),
                            ["chrom"], "lo", "hi").select("chrom", "level", "lo", F.col("_hi").alias("hi"), "island")
    ends = tagged.groupBy("chrom", "island").agg(F.max("hi").alias("bp_hi"))
    return tagged.join(ends, ["chrom", "island"]).select(
        "chrom", "level", "lo", "hi", F.col("island").alias("bp_lo"), "bp_hi")


def merge_breakpoints(evidence: DataFrame, cfg: CallConfig, most: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """(breakpoints, members) after merging and the minimum support filter.

    Members (split reads, discordant pairs) stay rows keyed by their breakpoint, so a
    breakpoint with any number of supporting reads never becomes one wide row.
    """
    evidence = saved(evidence)
    tasks = part_tasks(evidence, ["chrom"], most)
    if tasks:
        linked = _linked_in_contigs(evidence.repartition(tasks, "chrom"), not evidence.where("level = 1").isEmpty())
    else:
        linked = evidence.join(precedence_hulls(evidence, most)[1], ["chrom", "level", "lo", "hi"])
    is_kind = lambda k: F.sum((F.col("kind") == k).cast("int"))
    bps = linked.groupBy("chrom", "bp_lo", "bp_hi").agg(
        F.sum("clip_left").alias("clip_left"), F.sum("clip_right").alias("clip_right"),
        is_kind("split").alias("n_split"), is_kind("pe").alias("n_pe"),
        F.max((F.col("mtype") == "Ins") & (F.col("kind") == "pe")).alias("has_ins"))
    bps = checkpoint(bps.where(support_filter(cfg)).na.fill(False, ["has_ins"]))
    members = (linked.where("member is not null")
               .join(bps.select("chrom", "bp_lo", "bp_hi"), ["chrom", "bp_lo", "bp_hi"], "left_semi")
               .select("chrom", "bp_lo", "bp_hi", "kind", "member", "mtype"))
    return bps, members


def support_filter(cfg: CallConfig) -> Column:
    """Keep discordant-pair support, or enough splits and clips."""
    return (F.col("n_pe") > 0) | (
        F.col("n_split") + F.col("clip_left") + F.col("clip_right") >= cfg.min_bp_support)


def shared_members(members: DataFrame, ends: DataFrame) -> DataFrame:
    """Distinct members of the expected class found at both breakpoints of each adjacency.

    ``ends``: adj_id, chrom, a_lo, a_hi, b_lo, b_hi, want (class without strand).
    """
    distinct = members.select("chrom", "bp_lo", "bp_hi", "kind", "member", "mtype").distinct()
    side = lambda tag: (distinct.join(
        ends.select("adj_id", "chrom", F.col(f"{tag}_lo").alias("bp_lo"), F.col(f"{tag}_hi").alias("bp_hi"),
                    "want").distinct(), ["chrom", "bp_lo", "bp_hi"])
        .where(F.regexp_replace("mtype", "[+-]$", "") == F.col("want"))
        .select("adj_id", "want", "kind", "member", "mtype"))
    return side("a").join(side("b"), ["adj_id", "want", "kind", "member", "mtype"], "left_semi")
