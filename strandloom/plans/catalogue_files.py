"""Registered queries that write a file format and read it again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandloom.plans.catalogue import big, query
from strandloom.plans.derived import table
from strandloom.schemas import CALL_COLUMNS
from strandloom.session import shared_folder
from strandloom.sources import tables as S
from strandloom.sources import writers as K


def folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def text(c):
    return F.col(c).cast("string")


# --- call tables ----------------------------------------------------------------------------

@query("call_table_round_trip", """SELECT CASE o_custkey % 3 WHEN 0 THEN 'X' ELSE CAST(o_custkey % 22 + 1 AS VARCHAR) END AS chrom, o_custkey * 100 AS minbp, o_custkey * 100 + o_orderkey % 700 AS maxbp,
    'c' || o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'DEL' WHEN 1 THEN 'BND,BND' ELSE 'DUP' END AS svtype, CASE o_orderkey % 4 WHEN 0 THEN '' ELSE 'ABC' END AS reference,
    o_orderkey % 900 AS len_affected, CASE o_orderkey % 7 WHEN 0 THEN 'INSERTION' ELSE 'PASS' END AS filter, printf('%.3f', (o_orderkey % 1000) / 1000.0) AS af,
    printf('%.2f', o_orderkey * 0.25) AS score_vs_ref, o_orderkey % 50 AS num_paths FROM orders""")
def _(spark, sf):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    made = {"chrom": F.when(cust % 3 == 0, "X").otherwise((cust % 22 + 1).cast("string")), "minbp": cust * 100, "maxbp": cust * 100 + key % 700,
            "id": F.concat(F.lit("c"), text("o_orderkey")), "svtype": F.when(key % 3 == 0, "DEL").when(key % 3 == 1, "BND,BND").otherwise("DUP"),
            "reference": F.when(key % 4 == 0, "").otherwise("ABC"), "len_affected": key % 900, "filter": F.when(key % 7 == 0, "INSERTION").otherwise("PASS"),
            "af": (key % 1000) / 1000, "score_vs_ref": key * 0.25, "score_vs_next": key * 0.5, "num_sv": F.lit(1), "num_paths": key % 50}
    calls = table(spark, sf, "orders").select(*[made.get(c, F.lit("x")).alias(c) for c in CALL_COLUMNS], (key % 2).alias("run"))
    at = folder(spark)
    for run in (0, 1):
        K.write_calls(calls.where(F.col("run") == run), f"{at}/run{run}/calls.tab")
    back = S.read_calls(spark, [f"{at}/run0", f"{at}/run1/", f"{at}/no-such-run"])
    return back.select("chrom", "minbp", "maxbp", "id", "svtype", F.coalesce("reference", F.lit("")).alias("reference"), "len_affected", "filter", "af",
                       "score_vs_ref", "num_paths")


# --- VCF ------------------------------------------------------------------------------------

VCF = """WITH vc AS (SELECT 'k' || (o_custkey % 30) AS chrom, o_custkey * 50 + o_orderkey % 50 AS pos, 'v' || o_orderkey AS id, o_orderkey % 5 AS kind,
    CASE o_orderkey % 5 WHEN 0 THEN 'DEL' WHEN 1 THEN 'INV' WHEN 2 THEN 'DUP' WHEN 3 THEN 'INS' ELSE 'BND' END AS svtype,
    o_custkey * 50 + o_orderkey % 50 + CASE o_orderkey % 5 WHEN 3 THEN 0 ELSE 20 + o_orderkey % 600 END AS stop, o_orderkey % 40 AS w, o_custkey % 4 AS g, o_orderkey AS k FROM orders)"""


def vcf_of(spark, sf):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    pos = cust * 50 + key % 50
    kind = F.when(key % 5 == 0, "DEL").when(key % 5 == 1, "INV").when(key % 5 == 2, "DUP").when(key % 5 == 3, "INS").otherwise("BND")
    stop = pos + F.when(key % 5 == 3, 0).otherwise(20 + key % 600)
    s = lambda c: c.cast("string")
    w = key % 40
    info = F.concat(F.lit("SVTYPE="), kind, F.lit(";END="), s(stop), F.lit(";CIPOS=-"), s(w), F.lit(","), s(w), F.lit(";CIEND=-"), s(w), F.lit(","), s(w),
                    F.lit(";PE="), s(key % 9), F.when(key % 2 == 0, ";IMPRECISE").otherwise(""))
    gt = F.when(cust % 4 == 0, "0/1").when(cust % 4 == 1, "1|1").when(cust % 4 == 2, "./.").otherwise("0/0")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("k"), s(cust % 30)).alias("chrom"), pos.alias("pos"), F.concat(F.lit("v"), s(key)).alias("id"), F.lit("N").alias("ref"),
        F.concat(F.lit("<"), kind, F.lit(">")).alias("alt"), F.lit(".").alias("qual"), F.lit("PASS").alias("filter"), info.alias("info"),
        F.lit("GT:AD").alias("format"), F.concat(gt, F.lit(":3,"), s(key % 11)).alias("sample"))


def vcf_read_back(spark, sf):
    path = folder(spark)
    K.write_vcf(spark, vcf_of(spark, sf), "##fileformat=VCFv4.2\n#CHROM\tPOS\n", path)
    return S.read_vcf(spark, path)


@query("vcf_round_trip", VCF + """ SELECT chrom, pos, id, 'N' AS ref, '<' || svtype || '>' AS alt, 'PASS' AS filter, CAST(stop AS VARCHAR) AS info_end,
    CASE WHEN k % 2 = 0 THEN 'IMPRECISE' ELSE '' END AS flags, CASE g WHEN 0 THEN '0/1' WHEN 1 THEN '1|1' WHEN 2 THEN './.' ELSE '0/0' END AS gt, '3,' || (k % 11) AS ad FROM vc""")
def _(spark, sf):
    return vcf_read_back(spark, sf).select("chrom", "pos", "id", "ref", "alt", "filter", F.col("info")["END"].alias("info_end"),
                                           F.array_join("flags", ",").alias("flags"), F.col("fmt")["GT"].alias("gt"), F.col("fmt")["AD"].alias("ad"))


@query("vcf_conversion", VCF + """, bp AS (SELECT *, pos + w < stop - w AS fits FROM vc WHERE svtype <> 'BND')
  SELECT chrom, pos, id, CASE WHEN kind = 3 THEN CASE WHEN w > 0 THEN pos - w ELSE pos END WHEN fits THEN pos - w ELSE pos END - 1000 AS lo,
    CASE WHEN kind = 3 THEN CASE WHEN w > 0 THEN pos + w ELSE pos END WHEN fits THEN stop + w ELSE stop END + 1000 AS hi,
    CASE kind WHEN 0 THEN '0,1,4,5' WHEN 1 THEN '0,1,3,2,4,5' WHEN 3 THEN '0,1,4,5,2,3' ELSE '0,1,2,3,2,3,4,5' END AS path1,
    CASE WHEN g = 0 THEN CASE kind WHEN 3 THEN '0,1,2,3' ELSE '0,1,2,3,4,5' END ELSE CASE kind WHEN 0 THEN '0,1,4,5' WHEN 1 THEN '0,1,3,2,4,5' WHEN 3 THEN '0,1,4,5,2,3' ELSE '0,1,2,3,2,3,4,5' END END AS path2,
    CASE kind WHEN 0 THEN 'Del' WHEN 1 THEN 'InvL' WHEN 3 THEN 'Ins' ELSE 'Dup' END AS want, k % 11 AS sr, k % 9 AS pe,
    'PASS' || CASE WHEN k % 2 = 0 THEN ':IMPRECISE' ELSE '' END || CASE g WHEN 2 THEN ':NOGT' WHEN 3 THEN ':ZEROGT' ELSE '' END || CASE WHEN kind <> 3 AND NOT fits THEN ':BPOVERLAP' ELSE '' END AS filter FROM bp""")
def _(spark, sf):
    out = S.convert_vcf(vcf_read_back(spark, sf))
    path = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return out.select("chrom", "pos", "id", "lo", "hi", path("path1"), path("path2"), "want", *big("sr", "pe"), "filter")


# --- BED and block strings ----------------------------------------------------------------------

@query("bed_round_trip", "SELECT 'k' || (l_suppkey % 9) AS chrom, l_partkey * 10 AS lo, l_partkey * 10 + l_orderkey % 300 AS hi FROM lineitem")
def _(spark, sf):
    path = folder(spark)
    lo = F.col("l_partkey") * 10
    rows = table(spark, sf, "lineitem").select(F.concat(F.lit("k"), (F.col("l_suppkey") % 9).cast("string")).alias("chrom"), lo.alias("lo"),
                                               (lo + F.col("l_orderkey") % 300).alias("hi"))
    K.write_tsv(rows, path, header=False)
    return S.read_bed(spark, path)


@query("block_string_import", """WITH sv AS (SELECT o_orderkey AS k, 'k' || (o_custkey % 9) AS chrom, o_custkey * 10 AS s, o_custkey * 10 + 100 + o_orderkey % 90 AS m, o_custkey * 10 + 400 + o_orderkey % 90 AS e FROM orders)
  SELECT chrom, chrom || ':' || s || ':' || m || ':' || e || ':' || k AS id, s - 1000 AS lo, k + 1000 AS hi, CASE k % 3 WHEN 0 THEN '0,1,4,5,3,2,8,9' WHEN 1 THEN '0,1,2,3,2,3,4,5,6,7,8,9' ELSE '0,1,6,7,8,9' END AS path1,
    CASE WHEN k % 3 = 1 THEN '0,1,2,3,4,5,6,7,8,9' WHEN k % 3 = 0 THEN '0,1,4,5,3,2,8,9' ELSE '0,1,6,7,8,9' END AS path2, CAST(0.5 + k % 4 AS DOUBLE) AS score FROM sv WHERE k % 7 > 0""")
def _(spark, sf):
    key, cust, s = F.col("o_orderkey"), F.col("o_custkey"), lambda c: c.cast("string")
    chrom = F.concat(F.lit("k"), s(cust % 9))
    ident = F.concat_ws(":", chrom, s(cust * 10), s(cust * 10 + 100 + key % 90), s(cust * 10 + 400 + key % 90), s(key))
    alt = F.when(key % 3 == 0, "ba^").when(key % 3 == 1, "aabc/abc").otherwise("c/c")
    score = F.when(key % 7 == 0, 0.0).otherwise(0.5 + key % 4)
    line = F.concat_ws("\t", chrom, s(cust * 10), s(key), ident, F.lit("abc"), alt, s(score))
    path = folder(spark)
    # about every second line stands twice, and a header comes first
    lines = table(spark, sf, "orders").select(line.alias("value"), F.explode(F.sequence(F.lit(1), 1 + F.abs(F.hash(ident)) % 2)))
    head = spark.createDataFrame([("chr\tstart\tend",)], "value string")
    head.unionByName(lines.select("value")).write.text(path)
    out = S.read_svelter(spark, path)
    text_of = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return out.select("chrom", "id", "lo", "hi", text_of("path1"), text_of("path2"), "score")
