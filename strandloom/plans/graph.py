"""Blocks between breakpoints, reads on blocks, the adjacency graph and its decomposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.config import CallConfig
from strandloom.functions import align as A
from strandloom.functions.paths import flip, node_adjacencies, node_sequence_to_path
from strandloom.operators.interval import overlap_join, sweep
from strandloom.operators.ordered import PART_ROWS, island_spans, part_tasks, running
from strandloom.plans.evidence import is_read_through
from strandloom.session import checkpoint

BLOCK_COLUMNS = ["chrom", "idx", "lo", "hi", "seg", "left_lo", "left_hi", "right_lo", "right_hi",
                 "gap_left", "gap_right"]


def create_blocks(breakpoints: DataFrame, gaps: DataFrame, regions: DataFrame, most: int = PART_ROWS) -> DataFrame:
    """Reference blocks between consecutive breakpoints, minus assembly gaps.

    ``breakpoints``: chrom, bp_lo, bp_hi (disjoint); ``gaps``: chrom, lo, hi; ``regions``:
    chrom, lo, hi (disjoint, any number on a contig; each has segments of its own).  A gap edge starts a new segment (``seg``); left/right columns hold the
    bordering breakpoint interval, or the gap edge as a point.  ``gap_left``/``gap_right`` are
    the distances to the neighbouring blocks.

    Where no contig has more than ``most`` breakpoints, gaps and regions, each is swept whole after one shuffle.
    """
    parts = breakpoints.select("chrom").unionByName(gaps.select("chrom")).unionByName(regions.select("chrom"))
    tasks = part_tasks(parts, ["chrom"], most)
    if tasks:
        return _blocks_by_contig(breakpoints, gaps, regions, tasks)
    reg = regions.select("chrom", F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi"))
    inside = (breakpoints.join(reg, "chrom").where((F.col("bp_lo") > F.col("r_lo"))
                                                   & (F.col("bp_hi") <= F.col("r_hi")))
              .select("chrom", "r_lo", "bp_lo", "bp_hi"))
    ends = inside.unionByName(reg.select("chrom", "r_lo", F.col("r_hi").alias("bp_lo"), F.col("r_hi").alias("bp_hi")))
    ends = ends.groupBy("chrom", "r_lo", "bp_lo").agg(F.max("bp_hi").alias("bp_hi"))
    prior = running(ends.withColumn("_pair", F.struct("bp_lo", "bp_hi")), ["chrom", "r_lo"], "bp_lo",
                    {"_prev": ("last", "_pair", False)})
    whole = (prior
             .withColumn("_prev", F.coalesce("_prev", F.struct(F.col("r_lo").alias("bp_lo"), F.col("r_lo").alias("bp_hi"))))
             .select("chrom", F.col("_prev.bp_hi").alias("lo"), F.col("bp_lo").alias("hi"),
                     F.col("_prev.bp_lo").alias("p_lo"), F.col("bp_hi").alias("n_hi"))
             .where("hi > lo"))
    whole = checkpoint(whole)
    pieces = sweep({"b": whole.select("chrom", "lo", "hi"), "g": gaps.select("chrom", "lo", "hi")},
                   ["chrom"], "lo", "hi").where("depth_b > 0 and depth_g = 0")
    pieces = pieces.select("chrom", F.col("pos").alias("lo"), F.col("end").alias("hi")).join(reg, "chrom").where(
        "lo >= r_lo and hi <= r_hi").drop("r_hi")
    starts = whole.select("chrom", "lo", F.col("p_lo"))
    stops = whole.select("chrom", "hi", F.col("n_hi"))
    framed = (pieces.join(starts, ["chrom", "lo"], "left").join(stops, ["chrom", "hi"], "left")
              .withColumn("cut_l", F.col("p_lo").isNull()).withColumn("cut_r", F.col("n_hi").isNull())
              .withColumn("left_lo", F.coalesce("p_lo", "lo")).withColumn("left_hi", F.col("lo"))
              .withColumn("right_lo", F.col("hi")).withColumn("right_hi", F.coalesce("n_hi", "hi"))
              .withColumn("one", F.lit(1).cast("bigint")).withColumn("_me", F.struct("hi", "cut_r", "left_hi", "r_lo")))
    framed = checkpoint(framed)
    seen = running(framed, ["chrom"], "lo", {"_p": ("last", "_me", False), "idx": ("sum", "one", False)})
    seen = seen.withColumn("brk", (F.col("cut_l") | (F.col("_p.r_lo") != F.col("r_lo")) | F.coalesce(F.col("_p.cut_r"), F.lit(False))
                                   | (F.col("lo") - F.col("_p.hi") > F.col("lo") - F.col("left_lo"))
                                   ).cast("bigint"))
    seen = seen.withColumn("brk", F.when(F.col("_p").isNull(), 0).otherwise(F.col("brk"))).withColumn(
        "_lo", F.struct("lo", "r_lo"))
    seen = checkpoint(seen)
    out = running(seen, ["chrom"], "lo", {"seg": ("sum", "brk", True), "_nlo": ("next", "_lo", False)})
    return out.select(
        "chrom", F.col("idx").cast("int").alias("idx"), "lo", "hi", F.col("seg").cast("int").alias("seg"),
        "left_lo", "left_hi", "right_lo", "right_hi",
        F.when(F.col("_p.r_lo") == F.col("r_lo"), F.col("lo") - F.col("_p.hi")).otherwise(0).cast("bigint").alias("gap_left"),
        F.when(F.col("_nlo.r_lo") == F.col("r_lo"), F.col("_nlo.lo") - F.col("hi")).otherwise(0).cast("bigint").alias("gap_right"))


def _blocks_by_contig(breakpoints: DataFrame, gaps: DataFrame, regions: DataFrame, tasks: int) -> DataFrame:
    """``create_blocks`` with a contig's breakpoints, gaps and regions in one window partition."""
    long = lambda c: F.col(c).cast("bigint")
    # at a position breakpoints (0, also a region's end) come before regions (1) that start there
    rows = breakpoints.select("chrom", F.lit(0).alias("kind"), long("bp_lo").alias("at"), long("bp_hi").alias("to"))
    ends = F.array(F.struct(F.lit(1).alias("kind"), long("lo").alias("at"), long("hi").alias("to")),
                   F.struct(F.lit(0).alias("kind"), long("hi").alias("at"), long("hi").alias("to")))
    rows = rows.unionByName(regions.where("hi > lo").select("chrom", F.inline(ends)))
    rows = rows.unionByName(gaps.where("hi > lo").select("chrom", F.lit(2).alias("kind"), long("lo").alias("at"), long("hi").alias("to"))).repartition(tasks, "chrom")
    before = Window.partitionBy("chrom").orderBy("at", "kind", F.col("to").desc()).rowsBetween(Window.unboundedPreceding, -1)
    latest = lambda when, c: F.last(F.when(when, F.col(c)), ignorenulls=True).over(before)
    rows = rows.withColumns({"r_lo": latest(F.col("kind") == 1, "at"), "r_hi": latest(F.col("kind") == 1, "to")})
    rows = rows.withColumn("cuts", (F.col("kind") == 0) & F.coalesce(F.col("to") <= F.col("r_hi"), F.lit(False)))
    rows = rows.withColumns({"p_lo": latest(F.col("cuts"), "at"), "p_hi": latest(F.col("cuts"), "to"), "p_r": latest(F.col("cuts"), "r_lo")})
    same = F.coalesce(F.col("p_r") == F.col("r_lo"), F.lit(False))
    first = F.when(same, F.col("p_hi")).otherwise(F.col("r_lo"))
    event = lambda pos, b, g, p_lo, n_hi, r_lo: F.struct(pos.alias("pos"), F.lit(b).alias("b"), F.lit(g).alias("g"), p_lo.alias("p_lo"),
                                                         n_hi.alias("n_hi"), r_lo.alias("r_lo"))
    none, at, to = F.lit(None).cast("bigint"), F.col("at"), F.col("to")
    whole = F.array(event(first, 1, 0, F.when(same, F.col("p_lo")).otherwise(F.col("r_lo")), none, F.col("r_lo")), event(at, -1, 0, none, to, none))
    gap = F.array(event(at, 0, 1, none, none, none), event(to, 0, -1, none, none, none))
    events = rows.select("chrom", F.inline(F.when(F.col("cuts") & (first < at), whole).when(F.col("kind") == 2, gap)))
    steps = events.groupBy("chrom", "pos").agg(*[F.sum(c).alias(c) for c in ("b", "g")], *[F.max(c).alias(c) for c in ("p_lo", "n_hi", "r_lo")])
    line = Window.partitionBy("chrom").orderBy("pos")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select("chrom", F.col("pos").alias("lo"), "p_lo", F.lead("pos").over(line).alias("hi"), F.lead("n_hi").over(line).alias("n_hi"),
                         F.last("r_lo", ignorenulls=True).over(upto).alias("r_lo"), F.sum("b").over(upto).alias("b"), F.sum("g").over(upto).alias("g"))
    pieces = steps.where("hi is not null and b > 0 and g = 0").drop("b", "g").withColumns(
        {"left_lo": F.coalesce("p_lo", "lo"), "cut_l": F.col("p_lo").isNull(), "cut_r": F.col("n_hi").isNull()})
    line = Window.partitionBy("chrom").orderBy("lo")
    last, near = lambda c: F.lag(c).over(line), lambda c: F.lead(c).over(line)
    pieces = pieces.withColumns({"idx": F.row_number().over(line) - 1, "_hi": last("hi"), "_cut_r": last("cut_r"), "_r": last("r_lo"), "_nlo": near("lo"), "_nr": near("r_lo")})
    brk = F.col("cut_l") | (F.col("_r") != F.col("r_lo")) | F.col("_cut_r") | (F.col("_hi") < F.col("left_lo"))
    seg = F.sum(F.when(F.col("_hi").isNotNull() & brk, 1).otherwise(0)).over(line.rowsBetween(Window.unboundedPreceding, 0))
    return pieces.select(
        "chrom", F.col("idx").cast("int").alias("idx"), "lo", "hi", seg.cast("int").alias("seg"),
        "left_lo", F.col("lo").alias("left_hi"), F.col("hi").alias("right_lo"), F.coalesce("n_hi", "hi").alias("right_hi"),
        F.when(F.col("_r") == F.col("r_lo"), F.col("lo") - F.col("_hi")).otherwise(0).cast("bigint").alias("gap_left"),
        F.when(F.col("_nr") == F.col("r_lo"), F.col("_nlo") - F.col("hi")).otherwise(0).cast("bigint").alias("gap_right"))


# --- reads on blocks -------------------------------------------------------------------

def _attach_blocks(pieces: DataFrame, blocks: DataFrame, width: int) -> DataFrame:
    """Adds ``near``: the sorted blocks around each piece.

    Blocks are listed per coordinate bin with a margin as long as the longest piece, so every
    piece finds all its blocks with one equi-join on (chrom, bin) and is never duplicated.
    """
    reach = pieces.agg(F.max(F.col("end") - F.col("pos"))).first()[0] or 1
    item = F.struct("idx", F.col("lo").alias("start"), F.col("hi").alias("end"), "gap_left", "gap_right")
    listed = (blocks.withColumn("_bin", F.explode(F.sequence(
        F.floor((F.col("lo") - int(reach)) / width), F.floor((F.col("hi") - 1) / width))))
        .groupBy("chrom", "_bin").agg(F.array_sort(F.collect_list(item)).alias("near")))
    return (pieces.withColumn("_bin", F.floor(F.col("pos") / width))
            .join(listed, ["chrom", "_bin"], "left").drop("_bin"))


def _touch(x: Column, b: Column) -> Column:
    return (x["start"] < b["end"]) & (b["start"] < x["end"])


def place_piece(df: DataFrame, tag: str, near: str, mb: str, rev: Column) -> DataFrame:
    """Blocks under one alignment piece: ``<tag>_hits`` (coordinate order), ``_nodes``, ``_offset``.

    ``mb`` holds the match blocks and query gaps.  One column per step keeps the plan linear.
    """
    m, gaps = F.col(f"{mb}.blocks"), F.col(f"{mb}.gaps")
    hits, f, l = f"{tag}_hits", f"{tag}_f", f"{tag}_l"
    df = df.withColumn(hits, F.filter(near, lambda b: F.exists(m, lambda x: _touch(x, b))))
    df = df.withColumn(hits, F.when(F.size(hits) > 0, F.col(hits)))
    df = df.withColumn(f"{tag}_b0", F.get(hits, F.lit(0))).withColumn(f"{tag}_b1", F.try_element_at(hits, F.lit(-1)))
    index = lambda b: F.array_min(F.transform(m, lambda x, i: F.when(_touch(x, F.col(b)), i)))
    df = df.withColumn(f, index(f"{tag}_b0")).withColumn(l, index(f"{tag}_b1"))
    zero = F.lit(0).cast("bigint")
    span = lambda arr, keep, size: F.aggregate(
        F.transform(arr, lambda x, i: F.when(keep(i), size(x)).otherwise(0)), zero, lambda a, x: a + x)
    length, same = (lambda x: x["end"] - x["start"]), (lambda x: x)
    forward = (span(m, lambda i: i < F.col(f), length) + span(gaps, lambda i: i <= F.col(f), same)
               - F.get(m, F.col(f))["start"] + F.col(f"{tag}_b0.start"))
    backward = (span(m, lambda i: i >= F.col(l), length) + span(gaps, lambda i: i > F.col(l), same)
                + F.get(m, F.col(l))["start"] - F.col(f"{tag}_b1.start"))
    df = df.withColumn(f"{tag}_offset", F.when(rev, backward).otherwise(forward))
    nodes = F.transform(hits, lambda b: b["idx"] * 2 + F.when(rev, 0).otherwise(1))
    return (df.withColumn(f"{tag}_nodes", F.when(rev, F.reverse(nodes)).otherwise(nodes))
              .withColumn(hits, F.when(rev, F.reverse(hits)).otherwise(F.col(hits)))
              .drop(f, l, f"{tag}_b0", f"{tag}_b1"))


def _summarise(df: DataFrame, true_len: Column) -> DataFrame:
    """Adds ``on`` from ``nodes``, ``hits`` and ``offset``.

    ``d``: length along the read's blocks, ``g``: gap credit, and the share of the last node
    alone (``last_len``, ``last_gap``).
    """
    both = lambda h: h["gap_left"] + h["gap_right"]
    length = lambda h: h["end"] - h["start"]
    zero = F.lit(0).cast("bigint")
    sized = F.when(F.size("nodes") > 0, F.slice("hits", F.lit(2), F.size("hits")))
    df = df.withColumn("_rest", sized).withColumn("_h0", F.get("hits", F.lit(0))).withColumn(
        "_tip", F.try_element_at("hits", F.lit(-1)))
    odd = F.get("nodes", F.lit(0)) % 2 == 1
    tip = F.col("_tip")
    on = F.struct(
        F.col("nodes"), (F.col("offset") + true_len).alias("offset"),
        (F.when(odd, length(F.col("_h0"))).otherwise(0)
         + F.aggregate("_rest", zero, lambda a, h: a + length(h))).alias("d"),
        (F.when(odd, F.col("_h0.gap_right")).otherwise(F.col("_h0.gap_left"))
         + F.aggregate("_rest", zero, lambda a, h: a + both(h))).alias("g"),
        length(tip).alias("last_len"), both(tip).alias("last_gap"))
    return df.withColumn("on", F.when(F.size("nodes") > 0, on))


def reads_on_blocks(reads: DataFrame, blocks: DataFrame, cfg: CallConfig, read_len: int = 0,
                    width: int = 1 << 14) -> DataFrame:
    """``reads`` (with geometry) plus ``on``: node list, offset and extent; NULL if unusable.

    A split read contributes the nodes of both pieces when each piece ends at a block edge.
    """
    rf = cfg.library_is_rf
    turn = (lambda c: ~c) if rf else (lambda c: c)
    sa = F.col("_sas")[0]
    ok = (F.lit(cfg.do_splits) & (F.size("_sas") == 1) & (sa["mapq"] >= cfg.min_mapq_reads)
          & (sa["rname"] == F.col("rname")) & (F.abs(sa["pos"] + 1 - F.col("pos")) <= cfg.max_pair_distance))
    base = (reads.withColumn("chrom", F.col("rname")).withColumn("_sas", A.parse_sa(F.col("sa")))
            .withColumn("_sa", F.when(ok, sa)).withColumn("_mb", A.match_blocks(F.col("ops"), F.col("pos"))))
    main = _attach_blocks(base, blocks, width)
    true_len = F.lit(read_len) - F.col("qlen") if read_len else F.lit(0)
    keep = [*reads.columns, "chrom", "on"]

    plain = place_piece(main.where("_sa is null"), "p", "near", "_mb", turn(F.col("is_reverse")))
    plain = plain.withColumnsRenamed({"p_nodes": "nodes", "p_hits": "hits", "p_offset": "offset"})
    plain = _summarise(plain, true_len).select(*keep)

    split = place_piece(main.where("_sa is not null"), "m", "near", "_mb", turn(F.col("is_reverse"))).drop("near")
    split = (split.withColumn("_sops", A.cigar_ops(F.col("_sa.cigar"))).withColumn("_own", F.struct("pos", "end"))
             .withColumn("pos", F.col("_sa.pos")).withColumn("end", F.col("pos") + A.reference_length(F.col("_sops")))
             .withColumn("_mb2", A.match_blocks(F.col("_sops"), F.col("pos"))))
    split = place_piece(_attach_blocks(split, blocks, width), "s", "near", "_mb2", turn(F.col("_sa.is_reverse")))
    side = lambda pos, end, rev, tag: F.struct(
        pos.alias("pos"), end.alias("end"), rev.alias("rev"), F.col(f"{tag}_nodes").alias("nodes"),
        F.col(f"{tag}_hits").alias("hits"), F.col(f"{tag}_offset").alias("offset"))
    start = lambda o, r: F.when(r, A.clip_right(o)).otherwise(A.clip_left(o))
    split = (split.withColumn("_one", side(F.col("_own.pos"), F.col("_own.end"), turn(F.col("is_reverse")), "m"))
                  .withColumn("_two", side(F.col("pos"), F.col("end"), turn(F.col("_sa.is_reverse")), "s"))
                  .withColumn("_q1", start(F.col("ops"), F.col("is_reverse")))
                  .withColumn("_q2", start(F.col("_sops"), F.col("_sa.is_reverse")))
                  .withColumn("pos", F.col("_own.pos")).withColumn("end", F.col("_own.end")))
    main_first = (F.col("_q1") < F.col("_q2")) if not rf else (F.col("_q1") > F.col("_q2"))
    split = (split.withColumn("_1", F.when(main_first, F.col("_one")).otherwise(F.col("_two")))
                  .withColumn("_2", F.when(main_first, F.col("_two")).otherwise(F.col("_one")))
                  .withColumn("_edge1", F.try_element_at("_1.hits", F.lit(-1))).withColumn("_edge2", F.get("_2.hits", F.lit(0))))

    def at_edge(p: str, edge: str, at_end: Column) -> Column:
        # the junction side of a piece must lie within the leeway of its block edge
        fits = F.when(at_end, F.col(f"{edge}.end") - F.col(f"{p}.end") <= cfg.split_read_leeway).otherwise(
            F.col(f"{p}.pos") - F.col(f"{edge}.start") <= cfg.split_read_leeway)
        return F.coalesce(fits, F.lit(True))

    usable = ((F.col("_q1") != F.col("_q2")) & at_edge("_1", "_edge1", ~F.col("_1.rev"))
              & at_edge("_2", "_edge2", F.col("_2.rev")))
    cat = lambda f: F.when(F.col(f"_1.{f}").isNull(), F.col(f"_2.{f}")).when(
        F.col(f"_2.{f}").isNull(), F.col(f"_1.{f}")).otherwise(F.concat(f"_1.{f}", f"_2.{f}"))
    split = (split.withColumn("nodes", F.when(usable, cat("nodes"))).withColumn("hits", cat("hits"))
                  .withColumn("offset", F.coalesce("_1.offset", "_2.offset")))
    return plain.unionByName(_summarise(split, true_len).select(*keep))


# --- pairs to observations -------------------------------------------------------------

PAIR_FIELDS = ["pos", "end", "mapq", "flag", "qlen", "clip_l", "clip_r", "sa", "on"]


def pair_observations(pairs: DataFrame, ranges: DataFrame, cfg: CallConfig) -> DataFrame:
    """Graph observations of mate pairs and hanging reads.

    Columns: lib, chrom, v1, v2, offset, adj1, adj2, hanging (NULL, 'unmapped', 'distant'),
    rlen, is_out, and ``support``, the adjacency steps the observation adds.
    """
    if cfg.filter_read_through:
        pairs = pairs.where(F.col("b").isNull() | ~is_read_through(cfg))
    ok = lambda s: F.col(f"{s}.on").isNotNull() & (F.col(f"{s}.mapq") >= cfg.min_mapq_reads)
    far = F.abs(F.col("a.pos") - F.col("b.pos")) > cfg.max_pair_distance
    ready = pairs.withColumn("chrom", F.col("rname")).join(F.broadcast(ranges), "lib")
    near = _near_pairs(ready.where(F.col("b").isNotNull() & ~far & ok("a") & ok("b")))

    mate_unmapped = A.has_flag(F.col("a.flag"), A.MATE_UNMAPPED)
    other = F.col("rname") != F.col("mrname")
    lone_far = F.abs(F.col("a.pos") - F.col("mpos")) > cfg.max_pair_distance
    distant = ready.where(F.col("b").isNotNull() & far)
    hang = lambda df, s, mate, kind: df.where(ok(s)).select(
        "lib", "chrom", F.col(f"{s}.on").alias("on"), F.col(mate).alias("rlen"), kind.alias("hanging"))
    lone = ready.where(F.col("b").isNull() & (mate_unmapped | other | lone_far))
    hanging = (hang(distant, "a", "b.qlen", F.lit("distant"))
               .unionByName(hang(distant, "b", "a.qlen", F.lit("distant")))
               .unionByName(hang(lone, "a", "a.qlen",
                                 F.when(mate_unmapped, "unmapped").otherwise("distant"))))
    node = F.col("on.nodes")[0]
    path = node_sequence_to_path(F.col("on.nodes"))
    solo = hanging.select(
        "lib", "chrom", (node - node % 2).alias("v1"), (node - node % 2 + 1).alias("v2"),
        F.col("on.offset").alias("offset"), F.when(F.size("on.nodes") > 1, path).alias("adj1"),
        F.lit(None).cast("array<int>").alias("adj2"), "hanging", "rlen", (node % 2 == 1).alias("is_out"),
        node_adjacencies(F.col("on.nodes")).alias("support"))
    return near.unionByName(solo)


def _near_pairs(pairs: DataFrame) -> DataFrame:
    a, b = F.col("b.on"), F.col("a.on")  # read 1 is the one seen later
    sm, tn = F.element_at(a["nodes"], -1), F.element_at(b["nodes"], -1)
    offset = a["offset"] + b["offset"]
    dist = a["d"] + b["d"] + F.floor((a["g"] + b["g"]) / 2) + offset
    alt = (a["d"] + b["d"] - a["last_len"]
           + F.floor((a["g"] + b["g"] - a["last_gap"]) / 2) + offset)
    duplicate_like = (tn == flip(sm)) & (alt >= F.col("range_lo"))
    between = (dist >= F.col("range_lo")) & (dist <= F.col("range_hi")) & ~duplicate_like
    step = F.when(between, F.array(F.struct(sm.alias("a"), tn.alias("b")))).otherwise(
        F.array().cast("array<struct<a:int,b:int>>"))
    support = F.concat(node_adjacencies(a["nodes"]), node_adjacencies(b["nodes"]), step)
    adj = lambda on: F.when(F.size(on["nodes"]) > 1, node_sequence_to_path(on["nodes"]))
    v1, v2 = a["nodes"][0], b["nodes"][0]
    swap = v1 > v2
    return pairs.select(
        "lib", "chrom", F.least(v1, v2).alias("v1"), F.greatest(v1, v2).alias("v2"),
        offset.alias("offset"), F.when(swap, adj(b)).otherwise(adj(a)).alias("adj1"),
        F.when(swap, adj(a)).otherwise(adj(b)).alias("adj2"), F.lit(None).cast("string").alias("hanging"),
        F.lit(None).cast("int").alias("rlen"), F.lit(None).cast("boolean").alias("is_out"),
        support.alias("support"))


def edge_support(observations: DataFrame, blocks: DataFrame, reference_support: int = 9999) -> DataFrame:
    """Support per undirected edge; reference adjacencies get a large constant."""
    steps = observations.select("chrom", F.explode("support").alias("s"))
    seen = steps.groupBy("chrom", F.least("s.a", "s.b").alias("v1"), F.greatest("s.a", "s.b").alias("v2")).agg(
        F.count(F.lit(1)).alias("support"))
    tops = blocks.groupBy("chrom").agg(F.max("idx").alias("_n"))
    ref = (blocks.join(F.broadcast(tops), "chrom").where(F.col("idx") < F.col("_n"))
           .select("chrom", (F.col("idx") * 2 + 1).alias("v1"), (F.col("idx") * 2 + 2).alias("v2"),
                   F.lit(reference_support).cast("bigint").alias("support")))
    return seen.unionByName(ref).groupBy("chrom", "v1", "v2").agg(F.sum("support").alias("support"))


def compact_observations(observations: DataFrame) -> DataFrame:
    """Identical observations folded into one row with ``cnt``.

    Everything a likelihood needs is in these columns, so a subgraph that holds a third of all
    reads still costs only its distinct (edge, offset, constraint) combinations.
    """
    keys = ["lib", "chrom", "v1", "v2", "offset", "adj1", "adj2", "hanging", "rlen", "is_out"]
    return observations.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))


def neighbors(edges: DataFrame, min_support: int) -> DataFrame:
    """Directed (node, neighbor) rows of sufficiently supported edges."""
    strong = edges.where(F.col("support") >= min_support)
    return strong.select("chrom", F.col("v1").alias("node"), F.col("v2").alias("neighbor"), "support").unionByName(
        strong.where("v1 <> v2").select("chrom", F.col("v2").alias("node"), F.col("v1").alias("neighbor"), "support"))


def edge_color(v1: Column, v2: Column, support: Column, min_support: int, n_genome_blocks: Column) -> Column:
    """Drawing colour by block/insertion edge and support."""
    block = v1.bitwiseXOR(F.lit(1)) == v2
    return (F.when(block & (v1 >= 2 * n_genome_blocks), "blue")
            .when(block & (support >= min_support), "green").when(block, "black")
            .when(support >= min_support, "red").otherwise("white"))


# --- decomposition -----------------------------------------------------------------------

def segments_of(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("chrom", "seg").agg(F.min("idx").alias("seg_lo"), F.max("idx").alias("seg_hi"))


def cut_points(edges: DataFrame, blocks: DataFrame, min_support: int) -> DataFrame:
    """Unspanned cut blocks of every segment.

    A segment end is always a cut block; an interior block is one when its entry only has
    smaller neighbours and its exit only larger ones.  Blocks jumped over by an edge of an
    interior block are spanned.
    """
    seg = segments_of(blocks)
    home = blocks.select("chrom", "idx", "seg").join(seg, ["chrom", "seg"])
    nb = neighbors(edges, min_support).withColumn("idx", F.floor(F.col("node") / 2).cast("int"))
    here = (nb.join(home, ["chrom", "idx"])
            .where((F.col("idx") > F.col("seg_lo")) & (F.col("idx") < F.col("seg_hi")))
            .where((F.col("neighbor") >= 2 * F.col("seg_lo")) & (F.col("neighbor") <= 2 * F.col("seg_hi") + 1)))
    wrong = here.where(((F.col("node") % 2 == 0) & (F.col("neighbor") >= F.col("node")))
                       | ((F.col("node") % 2 == 1) & (F.col("neighbor") <= F.col("node"))))
    wrong = wrong.select("chrom", "idx").distinct()
    other = F.floor(F.col("neighbor") / 2)
    jumps = here.withColumn("_o", other).select(
        "chrom", F.when(F.col("neighbor") > 2 * F.col("idx") + 3, F.col("idx") + 1)
        .when(F.col("neighbor") < 2 * F.col("idx") - 2, F.col("_o") + 1).cast("bigint").alias("lo"),
        F.when(F.col("neighbor") > 2 * F.col("idx") + 3, F.col("_o"))
        .when(F.col("neighbor") < 2 * F.col("idx") - 2, F.col("idx")).cast("bigint").alias("hi"))
    spans = checkpoint(island_spans(checkpoint(jumps.where("hi > lo")), ["chrom"], "lo", "hi"))
    spanned = spans.select("chrom", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("idx"))
    return (home.join(wrong, ["chrom", "idx"], "left_anti")
            .join(spanned.withColumn("idx", F.col("idx").cast("int")).distinct(), ["chrom", "idx"], "left_anti")
            .select("chrom", "seg", "idx"))


def decompose(edges: DataFrame, blocks: DataFrame, min_support: int) -> DataFrame:
    """Minimal subgraphs: from the end of one run of cut blocks to the start of the next."""
    cuts = checkpoint(cut_points(edges, blocks, min_support))
    runs = island_spans(cuts.select("chrom", "seg", F.col("idx").alias("lo"), F.col("idx").alias("hi")),
                        ["chrom", "seg"], "lo", "hi", 1)
    return (running(checkpoint(runs), ["chrom", "seg"], "lo", {"_prev": ("last", "hi", False)})
            .where("_prev is not null").select("chrom", "seg", F.col("_prev").alias("start"), F.col("lo").alias("end")))


def expand_subgraphs(subgraphs: DataFrame, blocks: DataFrame, width: float) -> DataFrame:
    """Subgraphs widened by ``width`` bases on both flanks, within their segment, and merged.

    Expanded subgraphs that share only an end block stay separate.
    """
    ends = blocks.select("chrom", "seg", "idx", "lo", "hi")
    s = (subgraphs.join(ends.select("chrom", "seg", F.col("idx").alias("start"), F.col("hi").alias("s_pos")),
                        ["chrom", "seg", "start"])
         .join(ends.select("chrom", "seg", F.col("idx").alias("end"), F.col("lo").alias("e_pos")),
               ["chrom", "seg", "end"]))
    w = int(-(-width // 1))
    probe = lambda side, pos: s.select("chrom", "seg", "start", "end", F.lit(side).alias("side"), F.col(pos).alias("pos"),
                                       (F.col(pos) - w).alias("_lo"), (F.col(pos) + w).alias("_hi"))
    near = overlap_join(probe("s", "s_pos").unionByName(probe("e", "e_pos")),
                        ends.select("chrom", F.col("seg").alias("seg2"), "idx", "lo", "hi"),
                        ["chrom"], ("_lo", "_hi"), ("lo", "hi")).where("seg = seg2")
    left = F.when((F.col("side") == "s") & (F.col("hi") > F.col("pos") - width), F.col("idx"))
    right = F.when((F.col("side") == "e") & (F.col("lo") < F.col("pos") + width), F.col("idx"))
    wide = near.groupBy("chrom", "seg", "start", "end").agg(F.min(left).alias("_l"), F.max(right).alias("_r"))
    wide = wide.select("chrom", "seg", F.least("start", F.coalesce("_l", "start")).alias("lo"),
                       F.greatest("end", F.coalesce("_r", "end")).alias("hi"))
    merged = island_spans(checkpoint(wide), ["chrom", "seg"], "lo", "hi", -1)
    return merged.select("chrom", "seg", F.col("lo").cast("int").alias("start"), F.col("hi").cast("int").alias("end"),
                         F.xxhash64("chrom", "seg", "lo").alias("sub"))
