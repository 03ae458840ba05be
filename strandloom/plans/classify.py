"""From called genotypes to typed events, support counts and output rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from strandloom.config import CallConfig
from strandloom.functions import rearrange as R
from strandloom.functions.paths import complex_type, is_reference_path, path_to_string
from strandloom.session import spread_groups

_INT, _STR = T.LongType(), T.StringType()
EVENT_FIELDS = [
    ("type", _STR), ("start", _INT), ("end", _INT), ("length", _INT), ("copynumber", _INT),
    ("bp1_lo", _INT), ("bp1_hi", _INT), ("bp2_lo", _INT), ("bp2_hi", _INT), ("a_lo", _INT), ("a_hi", _INT),
    ("b_lo", _INT), ("b_hi", _INT), ("want", T.ArrayType(_STR)), ("orient1", _STR), ("orient2", _STR),
    ("bnd_ins", _INT), ("gap", _INT), ("event_id", _STR), ("genotype", _STR), ("complex", T.BooleanType())]
EVENT = T.StructType([T.StructField(n, t) for n, t in EVENT_FIELDS])
SIMPLE_BLOCK = T.StructType([T.StructField("lo", _INT), T.StructField("hi", _INT), T.StructField("novel", T.BooleanType())])
PIECE = T.StructType([T.StructField("stretch", T.IntegerType()), T.StructField("no", T.IntegerType()),
                      T.StructField("start", _INT), T.StructField("end", _INT),
                      T.StructField("inverted", T.BooleanType()), T.StructField("deleted", _INT)])
HAPLOTYPE = T.StructType([
    T.StructField("path", T.ArrayType(T.IntegerType())), T.StructField("affected", _INT),
    T.StructField("flank_path", T.ArrayType(T.IntegerType())), T.StructField("flank_novel", T.BooleanType()),
    T.StructField("pieces", T.ArrayType(PIECE)), T.StructField("inserted", T.ArrayType(_INT)),
    T.StructField("left_flank", T.BooleanType()), T.StructField("right_flank", T.BooleanType())])
CALL = T.StructType([
    T.StructField("blocks", T.ArrayType(SIMPLE_BLOCK)), T.StructField("cuts", T.ArrayType(_INT)),
    T.StructField("events", T.ArrayType(EVENT)), T.StructField("hap1", HAPLOTYPE), T.StructField("hap2", HAPLOTYPE)])


def _each_once(fn: Callable, key: pa.Array, given: list[pa.Array], made: pa.DataType) -> pa.Array:
    """``fn`` of each row of ``given``; rows of one ``key`` that are equal, not just in their hashes, are worked out once."""
    _, first, code = np.unique(key.to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
    if not all(c.take(pa.array(first[code])).equals(c) for c in given):
        first = code = np.arange(len(key))
    rows = zip(*[c.take(pa.array(first)).to_pylist() for c in given], strict=True)
    return pa.array([fn(*r) for r in rows], made).take(pa.array(code))


def describe_udf(cfg: CallConfig):
    flank = cfg.altered_flank_size

    def haplotype(own, simple_path, blocks, simple, mid):
        fb, fp, _, _ = R.with_flanks(blocks, own, 100)
        made = R.haplotype_pieces(own, blocks, flank)
        stretches, inserted, left, right = made or ([], [], False, False)
        pieces = [dict(stretch=s, no=i, start=p[0], end=p[1], inverted=p[2], deleted=p[3])
                  for s, st in enumerate(stretches) for i, p in enumerate(st)]
        return dict(path=simple_path, affected=R.affected_length(simple_path, mid), flank_path=fp,
                    flank_novel=any(b["novel"] for b in fb), pieces=pieces, inserted=inserted,
                    left_flank=left, right_flank=right)

    def row(path1, path2, blocks, n_genome, chrom):
        table = {b["idx"]: b for b in blocks}
        span = (table[path1[0] // 2]["lo"], table[path1[-1] // 2]["hi"])
        simple, (sp, sq) = R.simplify(table, [path1, path2])
        cuts, mid = R.midpoint_blocks(simple)
        first = haplotype(path1, sp, table, simple, mid)
        second = first if path1 == path2 else haplotype(path2, sq, table, simple, mid)
        return dict(blocks=simple, cuts=cuts, events=R.diploid_events(path1, path2, table, n_genome, chrom, span), hap1=first, hap2=second)

    made = to_arrow_type(CALL)

    @F.arrow_udf(CALL)
    def describe(key: pa.Array, path1: pa.Array, path2: pa.Array, blocks: pa.Array, n_genome: pa.Array, chrom: pa.Array) -> pa.Array:
        return _each_once(row, key, [path1, path2, blocks, n_genome, chrom], made)

    return lambda *columns: describe(F.xxhash64(*columns), *columns)


def describe_calls(calls: DataFrame, blocks: DataFrame, cfg: CallConfig) -> DataFrame:
    """Variant calls with their simplified blocks, events and haplotypes.

    ``blocks``: block table with bordering breakpoints and ``novel`` rows appended.
    """
    n = F.col("n_genome")
    variant = calls.where(~(is_reference_path(F.col("path1"), n) & is_reference_path(F.col("path2"), n)))
    inside = variant.select("sub", "chrom", F.explode(F.array_distinct(F.concat(
        F.sequence("start", "end"), F.transform(F.concat("path1", "path2"), lambda x: F.floor(x / 2).cast("int"))))).alias("idx"))
    item = F.struct("idx", "lo", "hi", "gap_left", "gap_right", "novel", F.col("left_lo").alias("ll"),
                    F.col("left_hi").alias("lh"), F.col("right_lo").alias("rl"), F.col("right_hi").alias("rh"))
    table = (inside.join(blocks, ["chrom", "idx"]).groupBy("sub").agg(F.collect_list(item).alias("bs")))
    return spread_groups(variant.join(table, "sub"), "sub").withColumn(
        "c", describe_udf(cfg)("path1", "path2", "bs", "n_genome", "chrom")).drop("bs")


def event_rows(described: DataFrame) -> DataFrame:
    return (described.select("sub", "chrom", F.posexplode("c.events").alias("ev", "e"))
            .select("sub", "chrom", "ev", "e.*").withColumn("adj_id", F.xxhash64("sub", "ev")))


def event_support(events: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(counts, splits): support per event, and the split reads behind it.

    A read counts when it belongs to both breakpoints of the event with the expected class.
    An insertion counts the insertion-type pairs of its one breakpoint.
    """
    pairs = events.where("b_lo is not null").select(
        "adj_id", "sub", "ev", "chrom", "a_lo", "a_hi", "b_lo", "b_hi", F.explode("want").alias("want"))
    distinct = members.select("chrom", "bp_lo", "bp_hi", "kind", "member", "mtype").distinct()
    kls = F.regexp_replace("mtype", "[+-]$", "")
    left = (pairs.join(distinct, (pairs.chrom == distinct.chrom) & (pairs.a_lo == distinct.bp_lo)
                       & (pairs.a_hi == distinct.bp_hi) & (pairs.want == kls))
            .select("adj_id", pairs.chrom, "b_lo", "b_hi", "kind", "member", "mtype"))
    right = distinct.withColumnsRenamed({"bp_lo": "b_lo", "bp_hi": "b_hi"})
    both = left.join(right, ["chrom", "b_lo", "b_hi", "kind", "member", "mtype"], "left_semi")
    ins = events.where("type = 'INS'").select("adj_id", "chrom", F.col("a_lo").alias("bp_lo"), F.col("a_hi").alias("bp_hi"))
    ins = (members.where("kind = 'pe' and mtype = 'Ins'").join(ins, ["chrom", "bp_lo", "bp_hi"])
           .select("adj_id", "kind", "member", "mtype"))
    hits = both.select("adj_id", "kind", "member", "mtype").unionByName(ins)
    counts = hits.groupBy("adj_id").agg(F.sum((F.col("kind") == "split").cast("int")).alias("sr"),
                                        F.sum((F.col("kind") == "pe").cast("int")).alias("pe"))
    return counts, hits.where("kind = 'split'").select("adj_id", F.col("member").alias("split_id"), "mtype")


# --- formatting of breakpoints ------------------------------------------------------------

def bp_point(lo: Column, hi: Column) -> Column:
    return F.floor((lo + hi) / 2)


def bp_width(lo: Column, hi: Column) -> Column:
    return hi - lo - 2


def bp_ci(lo: Column, hi: Column) -> tuple[Column, Column]:
    w = bp_width(lo, hi)
    return -F.floor(w / 2), F.ceil(w / 2)


def inserted_length(kind: Column, length: Column, bnd_ins: Column) -> Column:
    return F.when(kind == "INS", length).when(kind == "BND", bnd_ins).otherwise(0)


def event_filter(kind: Column, bnd_ins: Column, criteria: tuple) -> Column:
    """Sorted filter tags that are in force, else PASS."""
    tags = F.when((kind == "INS") | ((kind == "BND") & (bnd_ins > 0)), F.array(F.lit("INSERTION"))).otherwise(
        F.array().cast("array<string>"))
    kept = F.array_sort(F.array_intersect(tags, F.array(*[F.lit(c) for c in criteria]).cast("array<string>")))
    return F.when(F.size(kept) > 0, F.array_join(kept, ",")).otherwise("PASS")


def call_filter(filters: Column) -> Column:
    """Union of the non-PASS filters of all events of a call."""
    bad = F.array_sort(F.array_distinct(F.filter(filters, lambda f: f != "PASS")))
    return F.when(F.size(bad) > 0, F.array_join(bad, ",")).otherwise("PASS")


def haplotype_events(described: DataFrame, support: DataFrame, cfg: CallConfig) -> DataFrame:
    """One row per (call, haplotype, event), with support and formatted fields.

    A homozygous call has one haplotype row; haplotypes without events are left out.
    """
    ev = event_rows(described).join(support, "adj_id", "left").na.fill(0, ["sr", "pe"])
    haps = described.select("sub", (F.col("c.hap1.path") == F.col("c.hap2.path")).alias("same"))
    ev = ev.join(haps, "sub")
    hap = F.when(F.col("genotype") == "1/1", F.when(F.col("same"), F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))) \
        .when(F.col("genotype") == "1/0", F.array(F.lit(1))).otherwise(F.array(F.lit(2)))
    ev = ev.withColumn("hap", F.explode(hap))
    p1, p2 = bp_point(F.col("bp1_lo"), F.col("bp1_hi")), bp_point(F.col("bp2_lo"), F.col("bp2_hi"))
    w1, w2 = bp_width(F.col("bp1_lo"), F.col("bp1_hi")), bp_width(F.col("bp2_lo"), F.col("bp2_hi"))
    one = F.col("type") == "INS"
    return (ev.withColumn("p1", p1).withColumn("p2", p2)
            .withColumn("bp_text", F.when(one, p1.cast("string")).otherwise(F.concat_ws(",", p1, p2)))
            .withColumn("width_text", F.when(one, w1.cast("string")).otherwise(F.concat_ws(",", w1, w2)))
            .withColumn("short_type", F.split("type", ":")[0])
            .withColumn("ins_len", inserted_length(F.col("type"), F.col("length"), F.col("bnd_ins")))
            .withColumn("filter", event_filter(F.col("type"), F.col("bnd_ins"), cfg.filter_criteria)))


def call_table(described: DataFrame, hap_events: DataFrame) -> DataFrame:
    """The 24-column call table plus ``sub`` and ``hap`` (one row per altered haplotype)."""
    sorted_list = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ev", F.col(c).alias("x")))), lambda s: s["x"])
    agg = hap_events.groupBy("sub", "hap").agg(
        sorted_list("short_type").alias("types"), sorted_list("bp_text").alias("bps"),
        sorted_list("width_text").alias("widths"), sorted_list("ins_len").alias("ins"),
        sorted_list("sr").alias("sr"), sorted_list("pe").alias("pe"), F.collect_list("filter").alias("filters"),
        F.min(F.least("p1", "p2")).alias("minbp"), F.max(F.greatest("p1", "p2")).alias("maxbp"),
        F.min_by("event_id", "ev").alias("first_id"), F.max("complex").alias("complex"), F.count(F.lit(1)).alias("num_sv"))
    n_haps = agg.groupBy("sub").agg(F.count(F.lit(1)).alias("_haps"))
    rows = agg.join(n_haps, "sub").join(described, "sub")
    hap = F.when(F.col("hap") == 1, F.col("c.hap1")).otherwise(F.col("c.hap2"))
    ref_blocks = F.filter("c.blocks", lambda b: ~b["novel"])
    n_ref = F.size(ref_blocks)
    inner_gaps = F.transform(F.sequence(F.lit(1), n_ref - 1), lambda i: F.get("c.blocks", i)["lo"] - F.get("c.blocks", i - 1)["hi"])
    gaps = F.concat(F.array(F.lit(0).cast("bigint")), F.when(n_ref > 1, inner_gaps).otherwise(F.array().cast("array<bigint>")),
                    F.array(F.lit(0).cast("bigint")))
    het = F.col("c.hap1.path") != F.col("c.hap2.path")
    text = lambda arr: F.array_join(arr.cast("array<string>"), ",")
    zero = F.lit(0)
    novel_from = F.col("n_genome")
    nxt = lambda p: F.coalesce(path_to_string(F.col(p), F.col("start"), novel_from), F.lit("."))
    ins = F.filter("ins", lambda x: x > 0)
    ident = F.array_join(F.slice(F.split("first_id", ","), 1, 2), "_")
    return rows.withColumn("h", hap).select(
        "sub", "hap", "chrom", "minbp", "maxbp",
        F.when(het & (F.col("_haps") > 1), F.concat(ident, F.lit("_"), F.col("hap"))).otherwise(ident).alias("id"),
        text(F.col("types")).alias("svtype"),
        F.when(F.col("complex"), complex_type(F.col("h.flank_path"), F.col("h.flank_novel"))).otherwise("NA").alias("complextype"),
        F.col("num_sv").cast("int").alias("num_sv"), text(F.col("c.cuts")).alias("bp"), text(gaps).alias("bp_uncertainty"),
        path_to_string(F.sequence(F.lit(0), 2 * n_ref - 1), zero, n_ref).alias("reference"),
        path_to_string(F.col("h.path"), zero, n_ref).alias("rearrangement"),
        F.col("h.affected").alias("len_affected"), call_filter(F.col("filters")).alias("filter"),
        F.array_join("bps", ";").alias("sv_bp"), F.array_join("widths", ";").alias("sv_bp_uncertainty"),
        F.when(het, "HET").otherwise("HOM").alias("gt"),
        F.when(F.col("hap") == 1, F.col("frac1")).otherwise(F.col("frac2")).alias("af"),
        F.when(F.size(ins) > 0, text(ins)).otherwise("NA").alias("inslen"),
        text(F.col("sr")).alias("sr_support"), text(F.col("pe")).alias("pe_support"),
        (F.col("best_lh") - F.col("ref_lh")).alias("score_vs_ref"),
        (F.col("best_lh") - F.coalesce("next_lh", F.lit(float("-inf")))).alias("score_vs_next"),
        F.concat_ws("/", nxt("next_path1"), nxt("next_path2")).alias("rearrangement_next"),
        F.when(F.col("extra") > 0, -F.col("n_paths")).otherwise(F.col("n_paths")).alias("num_paths"))


def altered_pieces(described: DataFrame, calls: DataFrame) -> DataFrame:
    """Sequence pieces of every altered haplotype with the FASTA name of its call."""
    hap = F.when(F.col("hap") == 1, F.col("c.hap1")).otherwise(F.col("c.hap2"))
    name = F.concat_ws(":", F.regexp_replace("id", "_", ","), "rearrangement", F.regexp_replace("svtype", ",", ":"))
    return (calls.select("sub", "hap", "id", "rearrangement", "svtype").join(described.select("sub", "chrom", "c"), "sub")
            .withColumn("h", hap).withColumn("name", name)
            .select("sub", "hap", "chrom", "name", F.explode("h.pieces").alias("p"))
            .select("sub", "hap", "chrom", "name", "p.*"))


def altered_metadata(described: DataFrame, calls: DataFrame) -> DataFrame:
    """Per altered haplotype: block positions, inserted and deleted sizes, flanks, path."""
    hap = F.when(F.col("hap") == 1, F.col("c.hap1")).otherwise(F.col("c.hap2"))
    return (calls.select("sub", "hap", "id").join(described.select("sub", "chrom", "c"), "sub").withColumn("h", hap)
            .select("id", "chrom", "hap", F.col("h.pieces").alias("pieces"), F.col("h.inserted").alias("insertion_sizes"),
                    F.col("h.flank_path").alias("simplified_path"), F.col("h.left_flank").alias("has_left_flank"),
                    F.col("h.right_flank").alias("has_right_flank")))


# fixed values: breakend orientations of each split class
SPLIT_ORIENT = {"Del": "-,+", "Dup": "+,-", "InvL": "-,-", "InvR": "+,+"}


def split_support_table(calls: DataFrame, hap_events: DataFrame, support_splits: DataFrame,
                        splits: DataFrame, reads: DataFrame) -> DataFrame:
    """One row per supporting split read; read sequences are joined back by read id."""
    order = Window.partitionBy("sub", "hap").orderBy("ev")
    ev = hap_events.withColumn("bp_idx", F.row_number().over(order))
    kls = F.regexp_replace("mtype", "[+-]$", "")
    orient = F.create_map(*[F.lit(x) for kv in SPLIT_ORIENT.items() for x in kv])
    seqs = reads.select("read_id", "seq")
    own = splits.select("split_id", "qname", "mapq", "mate_id", "mate_mapq")
    return (support_splits.join(ev.select("adj_id", "sub", "hap", "bp_idx", "p1", "p2"), "adj_id")
            .join(own, "split_id").join(calls.select("sub", "hap", "id", "bp", "reference", "rearrangement", "sv_bp"), ["sub", "hap"])
            .join(seqs.withColumnRenamed("read_id", "split_id"), "split_id")
            .join(seqs.select(F.col("read_id").alias("mate_id"), F.col("seq").alias("mate_seq")), "mate_id", "left")
            .select(F.col("id").alias("sv_id"), "bp", "reference", "rearrangement", "sv_bp", F.lit("split").alias("support_type"),
                    "qname", "bp_idx", F.col("p1").alias("bp1"), F.col("p2").alias("bp2"),
                    F.try_element_at(orient, kls).alias("bp_orientation"), F.col("qname").alias("qname2"),
                    F.right("mtype", F.lit(1)).alias("strand"), "seq", "mapq",
                    F.coalesce("mate_seq", F.lit("NA")).alias("mate_seq"),
                    F.coalesce(F.col("mate_mapq").cast("string"), F.lit("NA")).alias("mate_mapq"),
                    F.when(F.col("mate_id").isNull(), "NA").otherwise("False").alias("mate_has_split")))
