"""Sinks.  Text outputs are ordinary partitioned writes; ``single`` asks for one file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.align import ucsc_name
from strandloom.plans.filter_merge import sort_calls
from strandloom.plans.vcf_out import vcf_lines
from strandloom.schemas import CALL_COLUMNS, SPLIT_COLUMNS


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "error"


def format_calls(calls: DataFrame) -> DataFrame:
    """Call table with the fixed number formats of the text file."""
    score = lambda c: F.format_string("%.2f", F.col(c).cast("double")).alias(c)
    fmt = {"af": F.format_string("%.3f", F.col("af").cast("double")).alias("af"),
           "score_vs_ref": score("score_vs_ref"), "score_vs_next": score("score_vs_next")}
    return calls.select(*[fmt.get(c, F.col(c)) for c in CALL_COLUMNS])


def write_tsv(df: DataFrame, path: str, header: bool = True, overwrite: bool = False, single: bool = False) -> None:
    out = df.coalesce(1) if single else df
    out.write.mode(_mode(overwrite)).csv(path, sep="\t", header=header, quote="", escape="", emptyValue="")


def write_calls(calls: DataFrame, path: str, overwrite: bool = False, single: bool = False) -> None:
    """Sorted call table: parts in order, each with the header, or one file on request."""
    write_tsv(format_calls(sort_calls(calls)), path, True, overwrite, single)


def write_vcf(spark: SparkSession, rows: DataFrame, header: str, path: str, overwrite: bool = False,
              single: bool = False) -> None:
    """Header rows first, then the body sorted by (contig, position, text): parts in order, or one file on request."""
    head = spark.createDataFrame([(0, i, "", l) for i, l in enumerate(header.rstrip("\n").split("\n"))],
                                 "k int, pos bigint, chrom string, line string")
    body = vcf_lines(rows).select(F.lit(1).alias("k"), F.col("pos").cast("bigint").alias("pos"), "chrom", "line")
    rows = head.unionByName(body).orderBy("k", "chrom", "pos", "line").select("line")
    (rows.coalesce(1) if single else rows).write.mode(_mode(overwrite)).text(path)


def write_split_support(table: DataFrame, path: str, overwrite: bool = False) -> None:
    write_tsv(table.select(*SPLIT_COLUMNS), path, True, overwrite)


def altered_fasta(pieces: DataFrame, sequences: DataFrame) -> DataFrame:
    """FASTA text per altered stretch: pieces in order, one record per stretch."""
    keys = ["sub", "hap", "stretch", "name"]
    joined = pieces.join(sequences, ["sub", "hap", "stretch", "no"])
    seq = joined.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "seq"))),
                                                            lambda x: x["seq"]), "").alias("seq"))
    return seq.select(*keys, F.concat(F.lit(">"), "name", F.lit(":"), (F.col("stretch") + 1).cast("string"),
                                      F.lit("\n"), "seq").alias("value"))


def softclip_bedgraph(clips: DataFrame) -> DataFrame:
    """Clip counts per orientation and position as bedGraph rows."""
    return clips.groupBy("chrom", "is_right", "pos").agg(F.count(F.lit(1)).alias("n")).select(
        ucsc_name(F.col("chrom")).alias("chrom"), "is_right", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "n")


# fixed values: display colours of the split classes
SPLIT_COLORS = {"Del+": "180,30,0", "Del-": "180,30,0", "Dup+": "80,170,0", "Dup-": "80,170,0",
                "InvL": "0,100,190", "InvR": "0,190,190"}


def _bed12(chrom, name, score, strand, color, lo1, hi1, lo2, hi2, apart: Column) -> Column:
    """BED12 lines: one two-block line, or two one-block lines when the blocks touch."""
    line = lambda a, b, n, sizes, starts: F.concat_ws("\t", chrom, a, b, name, score, strand, a, b, color, F.lit(n), sizes, starts)
    two = line(lo1, hi2, "2", F.concat((hi1 - lo1).cast("string"), F.lit(","), (hi2 - lo2).cast("string"), F.lit(",")),
               F.concat(F.lit("0,"), (lo2 - lo1).cast("string")))
    one = lambda a, b: line(a, b, "1", (b - a).cast("string"), F.lit("0"))
    return F.when(apart, F.array(two)).otherwise(F.array(one(lo1, hi1), one(lo2, hi2)))


def splits_bed12(splits: DataFrame) -> DataFrame:
    colors = F.create_map(*[F.lit(x) for kv in SPLIT_COLORS.items() for x in kv])
    hi1, hi2 = F.col("bp1_hi") + 1, F.col("bp2_hi") + 1
    lines = _bed12(ucsc_name(F.col("chrom")), F.concat_ws("_", "split_type", "lib", "split_id"), F.col("mapq").cast("string"),
                   F.lit("+"), F.try_element_at(colors, F.substring("split_type", 1, 4)), F.col("bp1_lo"), hi1,
                   F.col("bp2_lo"), hi2, hi1 < F.col("bp2_lo") + 1)
    return splits.select("chrom", F.explode(lines).alias("value"))


def inverted_bed12(pairs: DataFrame) -> DataFrame:
    s = F.when(F.col("is_reverse"), "-").otherwise("+")
    lines = _bed12(ucsc_name(F.col("chrom")), F.concat_ws("/", s, s), F.lit("0"), s, F.lit("0"), F.col("pos1"),
                   F.col("end1") + 1, F.col("pos2"), F.col("end2") + 1, F.col("end1") < F.col("pos2"))
    return pairs.select("chrom", F.explode(lines).alias("value"))


def signal_bed(windows: DataFrame, column: str = "window_mean") -> DataFrame:
    return windows.select(ucsc_name(F.col("chrom")).alias("chrom"), F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), column)


def track_line(track: str, lib: str, extension: str, kind: str, rgb: bool = False, height: int | None = None,
               color: str | None = None) -> str:
    """One track stanza of a browser hub."""
    lines = [f"track {track}_{lib}", f"bigDataUrl {track}_{lib}.{extension}", f"shortLabel {track} {lib}",
             f"longLabel {track} {lib}", f"type {kind}"]
    lines += ["itemRgb on"] if rgb else []
    lines += [f"maxHeightPixels 500:{height}:1"] if height else []
    lines += [f"color {color}"] if color else []
    return "\n".join(lines) + "\n\n"


def pmf_table(pmf: DataFrame) -> DataFrame:
    """Insert-length density rows; the data behind the insert-size plot."""
    return pmf.select("lib", "x", "pmf").orderBy("lib", "x")


def softclip_dump(clips: DataFrame) -> DataFrame:
    return clips.select("chrom", "pos", F.when(F.col("is_reverse"), "-").otherwise("+").alias("strand"), "mapq",
                        F.col("bases_clipped").alias("nclip"), F.col("is_right").cast("int").alias("isright"))
