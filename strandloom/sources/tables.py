"""BED, FASTA, call-table and foreign-caller sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions.align import reverse_complement
from strandloom.operators.interval import overlap_anti
from strandloom.schemas import BED, CALL_COLUMNS, FAI


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths that exist, on whatever file system they name."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            out.append(p)
    return out


def read_bed(spark: SparkSession, path: str, chrom: str | None = None) -> DataFrame:
    df = spark.read.csv(path, sep="\t", schema=BED)
    return df if chrom is None else df.where(F.col("chrom") == chrom)


def read_fai(spark: SparkSession, fasta: str) -> DataFrame:
    return spark.read.csv(fasta + ".fai", sep="\t", schema=FAI)


# --- FASTA -----------------------------------------------------------------------------------

def fasta_chunks(spark: SparkSession, fasta: str, chunk: int = 1 << 16) -> DataFrame:
    """(chrom, chunk, seq): upper-case sequence in fixed-size chunks.

    The index gives the byte range of every chunk, so tasks read only their own ranges.
    """
    fai = read_fai(spark, fasta)
    ranges = fai.select("name", "length", "offset", "linebases", "linewidth", F.explode(F.sequence(
        F.lit(0), F.floor((F.col("length") - 1) / chunk))).alias("chunk"))
    at = lambda base: F.col("offset") + F.floor(base / F.col("linebases")) * F.col("linewidth") + base % F.col("linebases")
    first = F.col("chunk") * chunk
    last = F.least(F.col("length"), first + chunk)
    ranges = ranges.select("name", "chunk", at(first).alias("lo"), (at(last - 1) + 1).alias("hi")).repartition("name", "chunk")

    def load(batches):
        with open(fasta, "rb") as f:
            for pdf in batches:
                seqs = []
                for lo, hi in zip(pdf["lo"], pdf["hi"]):
                    f.seek(int(lo))
                    seqs.append(f.read(int(hi) - int(lo)).translate(None, b"\r\n").decode().upper())
                yield pdf[["name", "chunk"]].rename(columns={"name": "chrom"}).assign(seq=seqs)

    return ranges.mapInPandas(load, "chrom string, chunk bigint, seq string")


def fetch_sequences(regions: DataFrame, chunks: DataFrame, fai: DataFrame, row_id: list[str], pad: bool = True,
                    truncate: bool = False, chunk: int = 1 << 16) -> DataFrame:
    """``row_id`` and ``seq`` of each (chrom, start, end[, inverted]) region.

    Positions outside the contig become N (``pad``) or are cut off (``truncate``).
    """
    r = regions if "inverted" in regions.columns else regions.withColumn("inverted", F.lit(False))
    r = r.join(fai.select(F.col("name").alias("chrom"), "length"), "chrom")
    clamp = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), F.col("length"))
    r = r.withColumn("_s", clamp("start")).withColumn("_e", clamp("end"))
    parts = r.where("_e > _s").select(*row_id, "chrom", "_s", "_e", F.explode(F.sequence(
        F.floor(F.col("_s") / chunk), F.floor((F.col("_e") - 1) / chunk))).alias("chunk"))
    lo = F.greatest(F.col("_s") - F.col("chunk") * chunk, F.lit(0))
    hi = F.least(F.col("_e") - F.col("chunk") * chunk, F.lit(chunk))
    cut = parts.join(chunks, ["chrom", "chunk"]).select(
        *row_id, "chunk", F.substring("seq", lo.cast("int") + 1, (hi - lo).cast("int")).alias("piece"))
    # a region is a haplotype piece or one base, so its chunks are few
    whole = cut.groupBy(*row_id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "piece"))),
                                                             lambda x: x["piece"]), "").alias("seq"))
    out = r.join(whole, row_id, "left").withColumn("seq", F.coalesce("seq", F.lit("")))
    if pad and not truncate:
        left = F.greatest(F.lit(0), F.least(F.col("end") - F.col("start"), -F.col("start")))
        right = F.greatest(F.lit(0), F.least(F.col("end") - F.col("start"), F.col("end") - F.col("length")))
        out = out.withColumn("seq", F.concat(F.repeat(F.lit("N"), left.cast("int")), "seq",
                                             F.repeat(F.lit("N"), right.cast("int"))))
    return out.select(*row_id, F.when(F.col("inverted"), reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))


def base_lookup(chunks: DataFrame, chunk: int = 1 << 16):
    """Adds the reference base at a 1-based position column."""
    def add(df: DataFrame, chrom: str, pos: str, name: str) -> DataFrame:
        zero = F.col(pos) - 1
        keyed = df.withColumn("_chunk", F.floor(zero / chunk))
        c = chunks.select(F.col("chrom").alias(chrom), F.col("chunk").alias("_chunk"), F.col("seq").alias("_chunk_seq"))
        return (keyed.join(c, [chrom, "_chunk"], "left")
                .withColumn(name, F.coalesce(F.substring("_chunk_seq", (zero % chunk).cast("int") + 1, F.lit(1)), F.lit("N")))
                .drop("_chunk", "_chunk_seq"))
    return add


# --- call tables ------------------------------------------------------------------------------

def read_calls(spark: SparkSession, directories: list[str], name: str = "calls.tab") -> DataFrame:
    """Call tables of many run directories; directories without one are skipped."""
    paths = existing(spark, [f"{d.rstrip('/')}/{name}" for d in directories])
    if not paths:
        raise FileNotFoundError(f"no {name} in the given directories")
    df = spark.read.csv(paths, sep="\t", header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
                        schema=", ".join(f"`{c}` string" for c in CALL_COLUMNS), enforceSchema=False, quote="")
    ints = ["minbp", "maxbp", "num_sv", "len_affected", "num_paths"]
    return df.select(*[F.col(c).cast("bigint").alias(c) if c in ints else F.col(c) for c in CALL_COLUMNS])


# --- other callers -------------------------------------------------------------------------------

def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """VCF body lines with parsed INFO (``info``), sample fields (``fmt``) and flag tags."""
    f = F.split("value", "\t")
    info, keys = F.split(f[7], ";"), F.split(f[8], ":")
    pairs = F.filter(info, lambda x: x.contains("="))
    cut = lambda x: F.struct(F.split(x, "=", 2)[0].alias("key"), F.split(x, "=", 2)[1].alias("value"))
    return spark.read.text(path).where(~F.col("value").startswith("#")).select(
        f[0].alias("chrom"), f[1].cast("bigint").alias("pos"), f[2].alias("id"), f[3].alias("ref"), f[4].alias("alt"),
        f[6].alias("filter"), F.map_from_entries(F.transform(pairs, cut)).alias("info"),
        F.filter(info, lambda x: ~x.contains("=")).alias("flags"),
        F.map_from_arrays(keys, F.slice(F.split(f[9], ":"), F.lit(1), F.size(keys))).alias("fmt"))


def convert_vcf(vcf: DataFrame, caller: str | None = None, gaps: DataFrame | None = None,
                flank: int = 1000) -> DataFrame:
    """Other callers' DEL, INV, DUP and INS records as two-haplotype block paths.

    Output: chrom, lo, hi (region with flanks), bp array<struct<lo,hi>>, path1, path2, inslen,
    sr, pe, want (support class), filter, id_extra, extra (tags not used otherwise).
    """
    tag = lambda k: F.try_element_at("info", F.lit(k))
    two = lambda k: F.transform(F.split(tag(k), ","), lambda x: x.cast("bigint"))
    num = lambda c, d: F.coalesce(c.try_cast("bigint"), F.lit(d).cast("bigint"))
    zero2 = F.array(F.lit(0), F.lit(0)).cast("array<bigint>")
    kind = tag("SVTYPE")
    df = vcf.withColumn("svtype", kind).withColumn("stop", num(tag("END"), -99999))
    known = F.col("svtype").isin("DEL", "INV", "DUP", "DUP:TANDEM", "INS")
    df = df.where(known)
    is_ins = F.col("svtype") == "INS"
    if caller == "pindel":
        hom = num(tag("HOMLEN"), 0)
        ci = F.when((F.col("pos") + hom > F.col("stop")) | is_ins, zero2).otherwise(F.array(F.lit(0).cast("bigint"), hom))
        df = df.withColumn("cipos", ci).withColumn("ciend", ci)
        df = df.withColumn("inslen", F.when(is_ins, num(tag("SVLEN"), 0)).otherwise(num(tag("INSLEN"), 0)))
    else:
        df = (df.withColumn("cipos", F.coalesce(two("CIPOS95"), two("CIPOS"), zero2))
                .withColumn("ciend", F.coalesce(two("CIEND95"), two("CIEND"), zero2))
                .withColumn("inslen", num(tag("INSLEN"), 0)))
    gt = F.translate(F.try_element_at("fmt", F.lit("GT")), "|", "/")
    flags = F.col("flags")
    lumpy_inv = (F.col("svtype") == "INV") if caller == "lumpy" else F.lit(False)
    strand = lambda s: F.when(lumpy_inv, F.regexp_extract(tag("STRANDS"), s + r":(\d+)", 1))
    precise = (F.when(F.array_contains(flags, "PRECISE"), ":PRECISE").when(F.array_contains(flags, "IMPRECISE"), ":IMPRECISE")
               .otherwise(":PRECISE" if caller == "lumpy" else ""))
    mark = F.concat("filter", precise, F.when(gt == "./.", ":NOGT").when(gt == "0/0", ":ZEROGT").otherwise(""))
    ad = F.split(F.try_element_at("fmt", F.lit("AD")), ",")
    if gaps is not None:
        spans = df.withColumn("_rid", F.concat_ws("|", "chrom", "pos", "id", "stop", "svtype"))
        free = overlap_anti(spans.where("stop > pos").withColumn("_lo", F.col("pos")).withColumn("_hi", F.col("stop")),
                            gaps.withColumnsRenamed({"lo": "g_lo", "hi": "g_hi"}), ["chrom"], ("_lo", "_hi"), ("g_lo", "g_hi"), ["_rid"])
        df = free.drop("_lo", "_hi").unionByName(spans.where("stop <= pos")).drop("_rid")
    p, e = F.col("pos"), F.col("stop")
    c0, c1, e0, e1 = F.col("cipos")[0], F.col("cipos")[1], F.col("ciend")[0], F.col("ciend")[1]
    iv = lambda a, b: F.struct(a.alias("lo"), b.alias("hi"))
    exact = F.array(iv(p, p), iv(e, e))
    fits = p + c1 < e + e0
    wide = exact if caller == "lumpy" else F.when(fits, F.array(iv(p + c0, p + c1), iv(e + e0, e + e1))).otherwise(exact)
    bp = F.when(is_ins, F.array(F.when(c1 > c0, iv(p + c0, p + c1)).otherwise(iv(p, p)))).otherwise(wide)
    arr = lambda xs: F.array(*[F.lit(x) for x in xs])
    alt = (F.when(F.col("svtype") == "DEL", arr([0, 1, 4, 5])).when(F.col("svtype") == "INV", arr([0, 1, 3, 2, 4, 5]))
           .when(is_ins, arr([0, 1, 4, 5, 2, 3])).otherwise(arr([0, 1, 2, 3, 2, 3, 4, 5])))
    ref = F.when(is_ins, arr([0, 1, 2, 3])).otherwise(arr([0, 1, 2, 3, 4, 5]))
    want = (F.when(F.col("svtype") == "DEL", "Del").when(F.col("svtype") == "INV", "InvL").when(is_ins, "Ins").otherwise("Dup"))
    # fixed values: tags that are used above and not copied to the side table
    used = ["SR", "PE", "SVTYPE", "SVMETHOD", "END", "STRANDS", "SVLEN", "HOMSEQ", "CONSENSUS", "CHR2"]
    used_fmt = ["AD", "SR", "PE", "SU"]
    overlap_note = F.lit("") if caller == "lumpy" else F.when(~is_ins & ~fits, ":BPOVERLAP").otherwise("")
    out = df.select(
        "chrom", "pos", "id", "svtype", "stop", "inslen", bp.alias("bp"), alt.alias("path1"),
        F.when(gt.isin("0/1", "1/0"), ref).otherwise(alt).alias("path2"), want.alias("want"),
        F.coalesce(ad[1].try_cast("bigint"), num(tag("SR"), 0)).alias("sr"), num(tag("PE"), 0).alias("pe"),
        F.concat(mark, overlap_note).alias("filter"), strand(r"\+\+").alias("inv_plus"), strand("--").alias("inv_minus"),
        F.map_filter("info", lambda k, v: ~k.isin(used)).alias("info_extra"),
        F.map_filter("fmt", lambda k, v: ~k.isin(used_fmt)).alias("format_extra"))
    out = (out.withColumn("lo", F.col("bp")[0]["lo"] - flank).withColumn("hi", F.element_at("bp", -1)["hi"] + flank))
    return numbered_repeats(out, ["chrom", "lo", "hi"], ["pos", "id", "svtype", "stop"],
                            lambda n: F.when(n == 0, "").otherwise(F.char(n + 97)))


def numbered_repeats(df: DataFrame, same: list[str], order: list[str], label) -> DataFrame:
    """``id_extra`` for the second and later record of equal ``same`` columns."""
    n = F.row_number().over(Window.partitionBy(*same).orderBy(*order)) - 1
    return df.withColumn("id_extra", label(n))


def extra_lines(converted: DataFrame, ids: DataFrame) -> DataFrame:
    """Side rows: call id with the unused INFO and FORMAT tags."""
    join = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return converted.join(ids, ["chrom", "pos", "id"]).select("call_id", join("info_extra").alias("info"), join("format_extra").alias("format"))


def svelter_path(text: Column, n_blocks: Column) -> Column:
    """Block path of a rearrangement string such as ``ab^a``; flanking blocks are added."""
    tokens = F.regexp_extract_all(text, F.lit(r"([a-z]\^?)"), F.lit(1))
    inner = F.flatten(F.transform(tokens, lambda t: F.transform(
        F.when(t.endswith("^"), F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))),
        lambda side: 2 * (F.ascii(t) - 96) + side)))
    return F.concat(F.array(F.lit(0), F.lit(1)), inner, F.array(2 * n_blocks - 2, 2 * n_blocks - 1))


def read_svelter(spark: SparkSession, path: str, gaps: DataFrame | None = None, flank: int = 1000) -> DataFrame:
    """Block-string calls: zero scores and repeats of the first six columns are dropped."""
    f = F.split("value", "\t")
    raw = spark.read.text(path).where(~F.col("value").startswith("chr\tstart")).select(
        f[0].alias("chrom"), f[1].alias("c1"), f[2].alias("c2"), f[3].alias("id"), f[4].alias("ref"), f[5].alias("alt"),
        f[6].cast("double").alias("score"))
    df = raw.where("score <> 0").groupBy("chrom", "c1", "c2", "id", "ref", "alt").agg(F.max("score").alias("score"))
    bps = F.transform(F.slice(F.split("id", ":"), 2, 1 << 20), lambda x: x.cast("bigint"))
    df = df.withColumn("bps", bps).withColumn("_s", F.col("bps")[0]).withColumn("_e", F.element_at("bps", -1))
    if gaps is not None:
        df = overlap_anti(df, gaps.withColumnsRenamed({"lo": "g_lo", "hi": "g_hi"}), ["chrom"], ("_s", "_e"), ("g_lo", "g_hi"), ["id"])
    n = F.size("bps") + 1
    alts = F.split("alt", "/")
    out = df.select("chrom", "id", "ref", "alt", "score", F.transform("bps", lambda x: F.struct(x.alias("lo"), x.alias("hi"))).alias("bp"),
                    (F.col("_s") - flank).alias("lo"), (F.col("_e") + flank).alias("hi"),
                    svelter_path(alts[0], n).alias("path1"), svelter_path(F.coalesce(F.get(alts, 1), alts[0]), n).alias("path2"))
    return numbered_repeats(out, ["chrom", "id"], ["ref", "alt"], lambda k: F.when(k == 0, "").otherwise(F.concat(F.lit(";"), (k + 1).cast("string"))))
