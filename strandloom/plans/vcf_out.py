"""VCF rows of a call set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.plans.classify import bp_ci


def bnd_alt(orient: Column, other_orient: Column, chrom: Column, other_pos: Column, base: Column) -> Column:
    """Breakend ALT text."""
    place = F.concat(chrom, F.lit(":"), other_pos.cast("string"))
    place = F.when(other_orient == "-", F.concat(F.lit("]"), place, F.lit("]"))).otherwise(
        F.concat(F.lit("["), place, F.lit("[")))
    return F.when(orient == "-", F.concat(base, place)).otherwise(F.concat(place, base))


def _info(tags: list[tuple[str, Column]]) -> Column:
    """Present tags in the given order."""
    parts = F.array(*[F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), v.cast("string"))) for k, v in tags])
    return F.array_join(F.filter(parts, lambda x: x.isNotNull()), ";")


def vcf_rows(calls: DataFrame, hap_events: DataFrame, bases) -> DataFrame:
    """(chrom, pos, id, ref, alt, qual, filter, info, format, sample) of every event.

    Simple events give one row, breakends two mate rows.  ``bases`` adds the reference base:
    a function (DataFrame, chrom column, 1-based position column, output name) -> DataFrame.
    """
    ev = hap_events.drop("filter").join(calls.drop("chrom"), ["sub", "hap"])
    order = F.row_number().over(Window.partitionBy("sub", "hap").orderBy("ev"))
    ident = F.when(F.col("num_sv") > 1, F.concat(F.col("id"), F.lit("_"), order)).otherwise(F.col("id"))
    ev = ev.withColumn("vid", ident)
    bnd = F.col("type") == "BND"
    sides = F.when(bnd, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    ev = ev.withColumn("side", F.explode(sides))
    flip = F.col("side") == 1
    own = F.when(flip, F.col("orient2")).otherwise(F.col("orient1"))
    oth = F.when(flip, F.col("orient1")).otherwise(F.col("orient2"))
    at = lambda p, o: F.col(p) + 1 - F.when(bnd & (o == "-"), 1).otherwise(0)
    first, second = at("p1", F.col("orient1")), at("p2", F.col("orient2"))
    ev = (ev.withColumn("pos", F.when(flip, second).otherwise(first))
            .withColumn("other_pos", F.when(flip, first).otherwise(second)).withColumn("own", own).withColumn("oth", oth))
    ev = bases(ev, "chrom", "pos", "ref")
    lo1, hi1 = bp_ci(F.col("bp1_lo"), F.col("bp1_hi"))
    lo2, hi2 = bp_ci(F.col("bp2_lo"), F.col("bp2_hi"))
    text = lambda a, b: F.when((a != 0) | (b != 0), F.concat_ws(",", a, b))
    ci1, ci2 = text(lo1, hi1), text(lo2, hi2)
    score = lambda c: F.format_string("%.2f", F.col(c))
    plus1 = F.array_join(F.transform(F.split("bp", ","), lambda x: (x.cast("bigint") + 1).cast("string")), ",")
    kind, ins = F.col("short_type"), F.col("type") == "INS"
    mate = F.concat(F.col("vid"), F.when(flip, "A").otherwise("B"))
    only = lambda cond, value: F.when(cond, value)
    tags = [
        ("SV_TYPE", kind), ("HAPLOID_CN", only(kind == "DUP", F.col("copynumber"))),
        ("COMPLEX_TYPE", only(bnd, F.translate(F.upper("complextype"), ".", "_"))), ("MATE_ID", only(bnd, mate)),
        ("END", only(~bnd, F.col("p2") + 1)), ("CI_POS", F.when(bnd & flip, ci2).otherwise(ci1)),
        ("CI_END", only(~bnd & ~ins, ci2)), ("INS_LEN", only(bnd & (F.col("bnd_ins") > 0), F.col("bnd_ins"))),
        ("SR", F.col("sr")), ("PE", F.col("pe")),
        ("SV_SPAN", only(~bnd, F.when(ins, F.col("length")).otherwise(F.col("p2") - F.col("p1")))),
        ("EVENT_SPAN", F.col("maxbp") - F.col("minbp")), ("EVENT_START", F.col("minbp") + 1), ("EVENT_END", F.col("maxbp")),
        ("EVENT_AFFECTED_LEN", F.col("len_affected")), ("EVENT_NUM_SV", F.col("num_sv")), ("REF_STRUCTURE", F.col("reference")),
        ("ALT_STRUCTURE", F.col("rearrangement")), ("SEGMENT_ENDPTS", plus1), ("SEGMENT_ENDPTS_CIWIDTH", F.col("bp_uncertainty")),
        ("AF", F.format_string("%.3f", F.col("af"))), ("SCORE_VS_REF", score("score_vs_ref")),
        ("SCORE_VS_NEXT", score("score_vs_next")), ("NEXT_BEST_STRUCTURE", F.col("rearrangement_next")),
        ("NUM_PATHS", F.col("num_paths"))]
    alt = F.when(bnd, bnd_alt(F.col("own"), F.col("oth"), F.col("chrom"), F.col("other_pos"), F.col("ref"))).otherwise(
        F.concat(F.lit("<"), F.col("type"), F.lit(">")))
    vid = F.when(bnd, F.concat(F.col("vid"), F.when(flip, "B").otherwise("A"))).otherwise(F.col("vid"))
    return ev.select("chrom", "pos", vid.alias("id"), "ref", alt.alias("alt"), F.lit(".").alias("qual"), "filter",
                     _info(tags).alias("info"), F.lit("GT").alias("format"), F.col("genotype").alias("sample"))


def vcf_lines(rows: DataFrame) -> DataFrame:
    cols = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "sample"]
    return rows.select("chrom", "pos", F.concat_ws("\t", *[F.col(c).cast("string") for c in cols]).alias("line"))


# fixed values: descriptions of the VCF header
_ALT = [("DEL", "Deletion"), ("DUP", "Duplication"), ("INV", "Inversion"), ("DUP:TANDEM", "Tandem duplication"),
        ("INS", "Insertion of novel sequence")]
_INFO = [
    ("AF", "1", "Float", "Alternate allele fraction"),
    ("ALT_STRUCTURE", "1", "String", "Order of genomic segments in the called haplotype; quote marks inversion, underscore novel sequence"),
    ("CI_END", "2", "Integer", "Confidence interval around END"), ("CI_POS", "2", "Integer", "Confidence interval around POS"),
    ("COMPLEX_TYPE", "1", "String", "Complex event class"), ("END", "1", "Integer", "End position of the event"),
    ("EVENT_AFFECTED_LEN", "1", "Integer", "Reference bases affected plus inserted bases"),
    ("EVENT_END", "1", "Integer", "Right end of the affected region"), ("EVENT_SPAN", "1", "Integer", "Span of the affected region"),
    ("EVENT_START", "1", "Integer", "Left end of the affected region"),
    ("EVENT_NUM_SV", "1", "String", "Events and adjacencies in this rearrangement"),
    ("HAPLOID_CN", "1", "Integer", "Haploid copy number of a duplication"), ("INS_LEN", "1", "Integer", "Inserted bases at a breakend"),
    ("MATE_ID", ".", "String", "ID of the mate breakend"), ("NEXT_BEST_STRUCTURE", "1", "String", "Second-best diploid structure"),
    ("NUM_PATHS", "1", "Integer", "Candidate haplotypes considered"), ("PE", "1", "Integer", "Supporting discordant pairs"),
    ("REF_STRUCTURE", "1", "String", "Order of genomic segments in the reference"),
    ("SCORE_VS_NEXT", "1", "Float", "Log likelihood ratio to the second-best genotype"),
    ("SCORE_VS_REF", "1", "Float", "Log likelihood ratio to the reference genotype"),
    ("SEGMENT_ENDPTS", ".", "Integer", "Segment end points"), ("SEGMENT_ENDPTS_CIWIDTH", ".", "Integer", "Widths of their confidence intervals"),
    ("SR", "1", "Integer", "Supporting split reads"), ("SV_SPAN", "1", "Integer", "Span of this event"),
    ("SV_TYPE", "1", "String", "Event type")]


def vcf_header(reference: str, contigs: list[tuple[str, int]], date: str, sample: str = "sample1") -> str:
    lines = ["##fileformat=VCFv4.2", f"##fileDate={date}", "##source=strandloom", f"##reference={reference}"]
    lines += [f"##contig=<ID={n},length={l}>" for n, l in contigs]
    lines += [f'##ALT=<ID={i},Description="{d}">' for i, d in _ALT]
    lines += [f'##INFO=<ID={i},Number={n},Type={t},Description="{d}">' for i, n, t, d in _INFO]
    lines += ['##FILTER=<ID=INSERTION,Description="Event contains an insertion call">',
              '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
              "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample])]
    return "\n".join(lines) + "\n"
