"""First pass: mates, insert lengths, discordant pairs, splits, soft clips, mappability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.config import CallConfig
from strandloom.functions import align as A
from strandloom.operators.ordered import running
from strandloom.schemas import SPLIT

READ_FIELDS = ["pos", "end", "mapq", "flag", "qlen", "clip_l", "clip_r", "sa", "split", "has_s",
               "read_id"]


def with_geometry(alignments: DataFrame) -> DataFrame:
    """Alignments with parsed CIGAR, reference end, query length and clips."""
    ops = F.col("ops")
    return (alignments.withColumn("ops", A.cigar_ops(F.col("cigar")))
            .withColumn("end", F.col("pos") + A.reference_length(ops))
            .withColumn("qlen", A.query_length(ops))
            .withColumn("clip_l", A.clip_left(ops)).withColumn("clip_r", A.clip_right(ops))
            .withColumn("has_s", F.exists(ops, lambda o: o["op"] == "S"))
            .withColumn("is_reverse", A.has_flag("flag", A.REVERSE))
            .withColumn("sa", F.try_element_at("tags", F.lit("SA")))
            .withColumn("read_id", F.concat("qname", F.when(A.has_flag("flag", A.READ1), "_1").otherwise("_2"))))


def with_splits(reads: DataFrame, cfg: CallConfig) -> DataFrame:
    """Adds ``split``: class and two breakpoint intervals of a split read, else NULL.

    A read qualifies with one supplementary piece on its contig, both pieces well mapped.  The
    steps are separate columns so that each is planned and evaluated once; persist or write the
    result before filtering on ``split``, or the filter is pushed down through all of them.
    """
    if not cfg.do_splits:
        return reads.withColumn("split", F.lit(None).cast(SPLIT))
    sa = F.col("_sas")[0]
    df = reads.withColumn("_sas", F.when(F.col("mapq") >= cfg.min_mapq_reads, A.parse_sa(F.col("sa"))))
    df = df.withColumn("_sa", F.when((F.size("_sas") == 1) & (sa["mapq"] >= cfg.min_mapq_reads)
                                     & (sa["rname"] == F.col("rname")), sa))
    df = df.withColumn("_sops", A.cigar_ops(F.col("_sa.cigar")))
    has = F.col("_sa").isNotNull()
    df = df.withColumn("_r1", F.when(has, A.reference_positions(F.col("ops"), F.col("pos"))))
    df = df.withColumn("_r2", F.when(has, A.reference_positions(F.col("_sops"), F.col("_sa.pos"))))

    def piece(pos, end, rev, ops, refs):
        return F.when(has, F.struct(
            pos.alias("pos"), end.alias("end"), rev.alias("rev"), A.query_coords(ops, rev)["start"].alias("q"),
            F.when(rev, F.reverse(refs)).otherwise(refs).alias("refs")))

    c = F.col
    df = (df.withColumn("_own", piece(c("pos"), c("end"), c("is_reverse"), c("ops"), c("_r1")))
            .withColumn("_oth", piece(c("_sa.pos"), c("_sa.pos") + A.reference_length(c("_sops")),
                                      c("_sa.is_reverse"), c("_sops"), c("_r2"))))
    left_own = c("_own.pos") <= c("_oth.pos")
    df = (df.withColumn("_left", F.when(left_own, c("_own")).otherwise(c("_oth")))
            .withColumn("_right", F.when(left_own, c("_oth")).otherwise(c("_own"))))
    lf = c("_left.q") < c("_right.q")
    df = (df.withColumn("_lf", lf).withColumn("_first", F.when(lf, c("_left")).otherwise(c("_right")))
            .withColumn("_last", F.when(lf, c("_right")).otherwise(c("_left"))))
    df = (df.withColumn("_fi", A.aligned_indices(c("_first.refs"))).withColumn("_li", A.aligned_indices(c("_last.refs"))))
    df = df.withColumn("_e", F.array_max("_fi")).withColumn("_s", F.array_min("_li"))
    df = (df.withColumn("_b0", F.array_min(F.filter("_fi", lambda i: i >= F.least(c("_e"), c("_s") - 1))))
            .withColumn("_b1", F.array_max(F.filter("_li", lambda i: i <= F.greatest(c("_s"), c("_e") + 1)))))
    df = (df.withColumn("_bf", A.junction_interval(c("_first.refs"), c("_b0"), c("_e"), ~c("_first.rev")))
            .withColumn("_bl", A.junction_interval(c("_last.refs"), c("_s"), c("_b1"), c("_last.rev"))))
    df = (df.withColumn("_lbp", F.when(c("_lf"), c("_bf")).otherwise(c("_bl")))
            .withColumn("_rbp", F.when(c("_lf"), c("_bl")).otherwise(c("_bf"))))
    plus1, plus2 = ~c("_first.rev"), ~c("_last.rev")
    overlap = F.when(plus1, ~(c("_first.end") < c("_last.pos"))).otherwise(~(c("_last.end") < c("_first.pos")))
    n_left = F.when(c("_lf"), F.size("_fi")).otherwise(F.size("_li"))
    n_right = F.when(c("_lf"), F.size("_li")).otherwise(F.size("_fi"))
    ok = (has & (c("_left.q") != c("_right.q")) & (n_left > 0) & (n_right > 0)
          & (c("_lbp.hi") - c("_lbp.lo") < n_left) & (c("_rbp.hi") - c("_rbp.lo") < n_right))
    lo_first = c("_lbp.lo") <= c("_rbp.lo")
    one = lambda f: F.when(lo_first, c(f"_lbp.{f}")).otherwise(c(f"_rbp.{f}"))
    two = lambda f: F.when(lo_first, c(f"_rbp.{f}")).otherwise(c(f"_lbp.{f}"))
    df = df.withColumn("split", F.when(ok, F.struct(
        one("lo").alias("bp1_lo"), one("hi").alias("bp1_hi"), two("lo").alias("bp2_lo"), two("hi").alias("bp2_hi"),
        A.split_type(plus1, plus2, overlap, c("_lf")).alias("split_type"))))
    return df.select(*reads.columns, "split")


def pair_numbers(reads: DataFrame, keys: list[str]) -> DataFrame:
    """Running pair number inside each of the names that more than two reads have.

    A malformed header can give one name to a third of the file, so reads are ordered by
    coordinate in bounded bins and no task holds all rows of a name.
    """
    plain = [f.name for f in reads.schema.fields if f.dataType.typeName() not in ("map", "array")]
    # equal rows are folded with a count and unfolded again by rank
    busy = reads.withColumn("_k", F.struct("pos", F.xxhash64(*plain).alias("h")))
    others = [c for c in reads.columns if c not in keys]
    dense = busy.groupBy(*keys, "_k").agg(F.count(F.lit(1)).alias("_c"),
                                          *[F.first(c).alias(c) for c in others])
    ranked = running(dense, keys, "_k", {"_before": ("sum", "_c", False)},
                     bin_expr=F.floor(F.col("_k.pos") / 4096))
    numbered = ranked.withColumn("_rank", F.explode(F.sequence(
        F.col("_before"), F.col("_before") + F.col("_c") - 1)))
    return numbered.select(*reads.columns, F.floor(F.col("_rank") / 2).alias("pair_no"))


def mates(reads: DataFrame, keys: tuple[str, ...] = ("lib", "rname", "qname"),
          fields: list[str] | None = None) -> DataFrame:
    """One row per template and contig: ``a`` (earlier read) and ``b`` (later read or NULL).

    Reads whose mate is unmapped or on another contig are unpaired from the start and skip
    the shuffle.  All others are grouped by name once; only names of more than two reads are
    looked at again.
    """
    fields = fields or READ_FIELDS
    keys = list(keys)
    alone = A.has_flag("flag", A.MATE_UNMAPPED) | (F.col("rname") != F.col("mrname"))
    packed = F.struct(*[F.col(f) for f in fields]).alias("r")
    mate_cols = ["mrname", "mpos"]
    solo = (reads.where(alone)
            .select(*keys, packed.alias("a"), F.lit(None).alias("b"), *mate_cols))
    waiting = reads.where(~alone)

    def grouped(rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.min("r").alias("a"), F.max("r").alias("b"), F.count(F.lit(1)).alias("_n"),
                                     F.min("mrname").alias("mrname"), F.min_by("mpos", "r").alias("mpos"))

    names = grouped(waiting.select(*keys, *mate_cols, packed), *keys)
    busy = pair_numbers(waiting.join(names.where("_n > 2").select(*keys), keys, "left_semi"), keys)
    pairs = names.where("_n <= 2").unionByName(
        grouped(busy.select(*keys, "pair_no", *mate_cols, packed), *keys, "pair_no").select(*names.columns))
    joined = pairs.select(*keys, "a", F.when(F.col("_n") > 1, F.col("b")).alias("b"), *mate_cols)
    return joined.unionByName(solo.withColumn("b", F.lit(None).cast(joined.schema["b"].dataType)))


def is_rev(side: str) -> Column:
    return A.has_flag(F.col(f"{side}.flag"), A.REVERSE)


def insert_length(cfg: CallConfig, read_len: int = 0) -> Column:
    """Insert length of a pair (a, b), NULL for same-strand or poorly mapped pairs."""
    b_rev = is_rev("b")
    forward_first = b_rev if not cfg.library_is_rf else ~b_rev
    pick = lambda yes, field: F.when(yes, F.col(f"a.{field}")).otherwise(F.col(f"b.{field}"))
    first = lambda field: pick(forward_first, field)
    last = lambda field: pick(~forward_first, field)
    span = (last("pos") - first("end")) if cfg.inner_insert else (last("end") - first("pos"))
    if read_len:
        span = span + 2 * read_len - F.col("a.qlen") - F.col("b.qlen")
    return F.when(F.col("b").isNotNull() & (is_rev("a") != b_rev)
                  & (F.least("a.mapq", "b.mapq") >= cfg.min_mapq_reads),
                  span + first("clip_l") + last("clip_r"))


def read_lengths() -> list[Column]:
    return [F.least("a.qlen", "b.qlen").alias("shorter"), F.greatest("a.qlen", "b.qlen").alias("longer")]


def is_read_through(cfg: CallConfig) -> Column:
    """Opposite-strand mates covering the same bases, both clipped at their 3' ends."""
    slop = cfg.read_through_slop
    b_rev = is_rev("b")
    plus_clip = F.when(b_rev, F.col("a.clip_r")).otherwise(F.col("b.clip_r"))
    minus_clip = F.when(b_rev, F.col("b.clip_l")).otherwise(F.col("a.clip_l"))
    test = ((is_rev("a") != b_rev) & F.col("a.sa").isNull() & F.col("b.sa").isNull()
            & (F.abs(F.col("a.pos") - F.col("b.pos")) <= slop)
            & (F.abs(F.col("a.end") - F.col("b.end")) <= slop) & (plus_clip > 0) & (minus_clip > 0))
    return F.coalesce(test, F.lit(False))


def discordant_type(cfg: CallConfig, ilen: Column, lo: Column, hi: Column) -> Column:
    """``struct<dtype,pos1,pos2>`` of a pair, NULL when concordant, unusable or unclassified."""
    a_rev, b_rev = is_rev("a"), is_rev("b")
    if cfg.library_is_rf:
        a_rev, b_rev = ~a_rev, ~b_rev
    opposite = is_rev("a") != is_rev("b")
    pick = lambda want_rev, f: F.when(b_rev == want_rev, F.col(f"b.{f}")).otherwise(F.col(f"a.{f}"))
    fs, fe = pick(F.lit(False), "pos"), pick(F.lit(False), "end")
    ss, se = pick(F.lit(True), "pos"), pick(F.lit(True), "end")
    good = (F.col("a.mapq") >= cfg.min_mapq_reads) & (F.col("b.mapq") >= cfg.min_mapq_reads)
    out = lambda name, p1, p2: F.struct(F.lit(name).alias("dtype"), p1.cast("bigint").alias("pos1"),
                                        p2.cast("bigint").alias("pos2"))
    ends = [F.col("a.end"), F.col("b.end")]
    starts = [F.col("a.pos"), F.col("b.pos")]
    return (F.when(F.col("b").isNull() | ~good, None)
            .when(opposite & (ilen >= lo) & (ilen <= hi), None)
            .when(opposite & (ilen > hi) & (fe < ss), out("Del", fe, ss))
            .when(opposite & ((fs > ss) | (fe > se)), out("Dup", ss, fe))
            .when(opposite & (ilen < lo), out("Ins", fe, ss))
            .when(~opposite & a_rev, out("InvR", F.least(*starts), F.greatest(*starts)))
            .when(~opposite, out("InvL", F.least(*ends), F.greatest(*ends))))


def discordant_pairs(pairs: DataFrame, bounds: DataFrame, cfg: CallConfig, read_len: int = 0) -> DataFrame:
    """Discordant pairs with class and loci; ``bounds`` has one row per library."""
    return (pairs.where("b is not null").withColumn("ilen", insert_length(cfg, read_len))
            .join(F.broadcast(bounds.select("lib", "min_insert", "max_insert")), "lib")
            .withColumn("_d", discordant_type(cfg, F.col("ilen"), F.col("min_insert"), F.col("max_insert")))
            .where("_d is not null")
            .select("lib", F.col("rname").alias("chrom"), "_d.dtype", "_d.pos1", "_d.pos2", "ilen", "qname"))


def splits_are_mirrored(s1: Column, s2: Column) -> Column:
    """Same breakpoints and the same class up to strand."""
    same = [s1[f] == s2[f] for f in ("bp1_lo", "bp1_hi", "bp2_lo", "bp2_hi")]
    cls = lambda s: F.regexp_replace(s["split_type"], "[+-]$", "")
    test = same[0] & same[1] & same[2] & same[3] & (cls(s1) == cls(s2))
    return F.coalesce(test, F.lit(False))


def split_evidence(pairs: DataFrame) -> DataFrame:
    """One row per split read; a mirrored split of the earlier mate is dropped."""
    clipped = F.col("a.has_s") | F.coalesce(F.col("b.has_s"), F.lit(False))
    side = lambda own, other, keep: F.when(
        F.col(f"{own}.split").isNotNull() & keep,
        F.struct(F.col(f"{own}.split").alias("s"), F.col(f"{own}.read_id").alias("split_id"),
                 F.col(f"{own}.mapq").alias("mapq"), F.col(f"{other}.read_id").alias("mate_id"),
                 F.col(f"{other}.mapq").alias("mate_mapq")))
    mirrored = splits_are_mirrored(F.col("a.split"), F.col("b.split"))
    return (pairs.where(clipped)
            .select("lib", F.col("rname").alias("chrom"), "qname",
                    F.explode(F.array(side("b", "a", F.lit(True)), side("a", "b", ~mirrored))).alias("e"))
            .where("e is not null")
            .select("lib", "chrom", "qname", "e.split_id", "e.mapq", "e.mate_id", "e.mate_mapq", "e.s.*"))


#: What clip evidence needs of a read.
CLIP_FIELDS = ["lib", "rname", "pos", "end", "mapq", "flag", "qlen", "clip_l", "clip_r", "qual", "split"]


def may_clip(cfg: CallConfig) -> Column:
    """Reads that clip evidence can come from, as far as is known before they are split."""
    return (F.col("mapq") >= cfg.min_mapq_softclip) & ((F.col("clip_l") > 0) | (F.col("clip_r") > 0))


def softclip_evidence(reads: DataFrame, cfg: CallConfig) -> DataFrame:
    """One row per clipped side with enough good-quality bases on reads without a split."""
    sides = []
    for right in (False, True):
        low = A.lowqual_run(F.col("qual"), not right, cfg.lowqual_trim_extra)
        raw = F.col("clip_r" if right else "clip_l")
        n = F.greatest(F.lit(0), raw - low)
        start = (F.length("qual") - low - n) if right else low
        sides.append(F.struct(
            F.lit(right).alias("is_right"), F.col("end" if right else "pos").alias("pos"),
            n.alias("bases_clipped"),
            F.when(n >= cfg.min_clipped_bases, A.median_quality(F.col("qual"), start, n)).alias("quality")))
    return (reads.where(may_clip(cfg) & F.col("split").isNull())
            .withColumn("c", F.explode(F.array(*sides)))
            .where((F.col("c.bases_clipped") >= cfg.min_clipped_bases)
                   & (F.col("c.quality") >= cfg.min_clipped_qual))
            .select("lib", F.col("rname").alias("chrom"), "c.is_right",
                    F.col("c.pos").cast("bigint").alias("pos"), "c.bases_clipped",
                    (F.col("qlen") - F.col("clip_l") - F.col("clip_r")).alias("bases_mapped"),
                    "mapq", A.has_flag("flag", A.REVERSE).alias("is_reverse")))


# fixed values: pair mappability classes (1 mapped, 0 unmapped, -1 distant), mate order
PAIR_CLASSES = ["1,1", "1,0", "0,1", "1,-1", "-1,1"]
_MIRROR = [0, 2, 1, 4, 3]


def mappability_labels(cfg: CallConfig) -> Column:
    """Class labels a pair adds to: an intra-contig distant pair adds both orders."""
    later = F.when(F.col("b").isNotNull(), F.col("b")).otherwise(F.col("a"))
    p_later, p_earlier = later["mapq"] >= cfg.min_mapq_reads, F.col("a.mapq") >= cfg.min_mapq_reads
    far = F.abs(F.col("a.pos") - F.col("b.pos")) > cfg.max_pair_distance
    both = (F.when(far & p_later, F.array(F.lit(3), F.lit(4)))
            .when(far & p_earlier, F.array(F.lit(4), F.lit(3)))
            .when(~far & p_later & p_earlier, F.array(F.lit(0))))
    lone_far = (F.col("rname") != F.col("mrname")) | (
        F.abs(F.col("a.pos") - F.col("mpos")) > cfg.max_pair_distance)
    lone = (F.when(p_earlier & A.has_flag(F.col("a.flag"), A.MATE_UNMAPPED), F.array(F.lit(1)))
            .when(p_earlier & lone_far, F.array(F.lit(3))))
    return F.when(F.col("b").isNotNull(), both).otherwise(lone)


def mappability_model(pairs: DataFrame, cfg: CallConfig) -> DataFrame:
    """Symmetrised class probabilities per library: ``struct`` of label and probability."""
    counts = (pairs.select("lib", F.explode(mappability_labels(cfg)).alias("label"))
              .groupBy("lib", "label").agg(F.count(F.lit(1)).alias("n")))
    mirror = F.array(*[F.lit(i) for i in _MIRROR])[F.col("label")]
    both = counts.unionByName(counts.select("lib", mirror.alias("label"), "n"))
    total = both.groupBy("lib", "label").agg(F.sum("n").alias("n"))
    whole = total.groupBy("lib").agg(F.sum("n").alias("_all"))
    return total.join(F.broadcast(whole), "lib").select("lib", "label", "n", (F.col("n") / F.col("_all")).alias("prob"))


def inverted_pairs(pairs: DataFrame) -> DataFrame:
    """Same-strand pairs, left read first."""
    return (pairs.where("b is not null").where(is_rev("a") == is_rev("b"))
            .select(F.col("rname").alias("chrom"), "qname", is_rev("a").alias("is_reverse"),
                    F.col("a.pos").alias("pos1"), F.col("a.end").alias("end1"),
                    F.col("b.pos").alias("pos2"), F.col("b.end").alias("end2")))


def hanging_anchors(reads: DataFrame, cfg: CallConfig) -> DataFrame:
    """Anchor position by strand of reads whose mate hangs."""
    kind = A.hanging_class(F.col("rname"), F.col("mrname"), F.col("pos"), F.col("mpos"),
                           A.has_flag("flag", A.UNMAPPED), A.has_flag("flag", A.MATE_UNMAPPED),
                           cfg.max_pair_distance)
    return (reads.withColumn("hanging", kind).where("hanging is not null")
            .select("qname", F.col("rname").alias("chrom"), "hanging", "is_reverse",
                    F.when(F.col("is_reverse"), F.col("end")).otherwise(F.col("pos")).alias("anchor")))
