"""Alignments derived from the ``events`` table by integer arithmetic.

Consecutive events are the two mates of a template; 1,250 templates share a contig, so the
number of contigs grows with the table while local density stays the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIRS_PER_CONTIG, SPAN = 1250, 60000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as alignments in the ALIGNMENT schema (sequence omitted)."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    p, i = F.col("p"), lambda e: F.expr(f"cast({e} as bigint)")
    df = ev.withColumn("p", F.expr("event_id div 2")).withColumn("mate", i("event_id % 2"))
    df = df.withColumn("idx", F.expr(f"p div {PAIRS_PER_CONTIG}")).withColumn("base", i(f"(p * 7919) % {SPAN}"))
    snapped = F.expr("1000 + (base div 600) * 600")
    # discordant templates gather at ten loci a contig
    locus = F.expr("1000 + (base div 6000) * 6000 + (p * 37) % 500")
    df = (df.withColumn("kind", p % 20)
            .withColumn("a", F.when(p % 5 == 2, snapped + p % 4).when(p % 5 == 3, snapped - 97 + p % 3)
                        .when(F.col("kind") < 5, locus).otherwise(1000 + F.col("base")))
            .withColumn("size", 270 + (p * 31) % 61 + F.when(F.col("kind") == 0, 700).when(F.col("kind") == 2, -150).otherwise(0)))
    rev = lambda m: F.when(F.col("kind") == 1, m == 0).when(F.col("kind") == 3, False).when(F.col("kind") == 4, True).otherwise(m == 1)
    at = lambda m: F.when(m == 0, F.col("a")).otherwise(F.col("a") + F.col("size") - 100)
    m, o = F.col("mate"), 1 - F.col("mate")
    clip, lone = 12 + p % 9, p % 97 == 0
    left, right = (m == 0) & (p % 5 == 2), (m == 0) & (p % 5 == 3)
    split = (m == 0) & (p % 5 == 4)
    s = lambda c: c.cast("string")
    cigar = (F.when(left, F.concat(s(clip), F.lit("S100M"))).when(right, F.concat(F.lit("100M"), s(clip), F.lit("S")))
             .when(split, "60M40S").otherwise("100M"))
    qlen = F.when(left | right, 100 + clip).otherwise(100)
    good = F.char(36 + (p * 3) % 37)
    low = F.repeat(F.lit("#"), (p % 4).cast("int"))
    body = F.repeat(good, (qlen - p % 4).cast("int"))
    flag = (1 + F.when(m == 0, 64).otherwise(128) + F.when(rev(m), 16).otherwise(0) + F.when(rev(o), 32).otherwise(0)
            + F.when((F.col("event_type") == "error") & (F.col("user_id") % 10 == 0), 1024).otherwise(0)
            + F.when(lone & (m == 1), 4).otherwise(0) + F.when(lone & (m == 0), 8).otherwise(0))
    chrom = F.concat(F.lit("c"), s(F.col("idx")))
    sa_pos = F.col("a") + 161 + (p % 7) * 100
    sa = F.concat_ws(",", chrom, s(sa_pos), F.when(p % 3 == 0, "-").otherwise("+"),
                     F.when(rev(m) == (p % 3 == 0), "60S40M").otherwise("40M60S"), F.lit("40"), F.lit("0;"))
    return df.select(
        s(p).alias("qname"), flag.cast("int").alias("flag"), chrom.alias("rname"), at(m).cast("int").alias("pos"),
        F.expr("cast((user_id * 7) % 61 as int)").alias("mapq"), cigar.alias("cigar"), chrom.alias("mrname"), at(o).cast("int").alias("mpos"),
        F.lit(None).cast("string").alias("seq"),
        F.when(right, F.concat(body, low)).otherwise(F.concat(low, body)).alias("qual"),
        F.when(split, F.create_map(F.lit("SA"), sa)).otherwise(F.create_map().cast("map<string,string>")).alias("tags"),
        F.concat(F.lit("lib"), s(1 + F.col("idx") % 2)).alias("lib"))


# The same rows for a SQL engine: r has one row per read, u the usable ones, pr the pairs.
READS_SQL = """
WITH e0 AS (SELECT event_id, user_id, event_type, event_id // 2 AS p, event_id % 2 AS mate FROM events),
e1 AS (SELECT *, p // 1250 AS idx, (p * 7919) % 60000 AS base, p % 20 AS kind FROM e0),
e2 AS (SELECT *, CASE WHEN p % 5 = 2 THEN 1000 + (base // 600) * 600 + p % 4
                      WHEN p % 5 = 3 THEN 1000 + (base // 600) * 600 - 97 + p % 3 WHEN kind < 5 THEN 1000 + (base // 6000) * 6000 + (p * 37) % 500 ELSE 1000 + base END AS a,
              270 + (p * 31) % 61 + CASE WHEN kind = 0 THEN 700 WHEN kind = 2 THEN -150 ELSE 0 END AS size FROM e1),
r AS (SELECT 'lib' || (1 + idx % 2) AS lib, 'c' || idx AS chrom, p, CAST(p AS VARCHAR) AS qname, mate, (user_id * 7) % 61 AS mapq,
             CASE WHEN mate = 0 THEN a ELSE a + size - 100 END AS pos,
             CASE WHEN mate = 0 THEN a + CASE WHEN p % 5 = 4 THEN 60 ELSE 100 END ELSE a + size END AS ref_end,
             CASE WHEN kind = 1 THEN mate = 0 WHEN kind = 3 THEN false WHEN kind = 4 THEN true ELSE mate = 1 END AS rev,
             CASE WHEN mate = 0 AND p % 5 = 2 THEN 12 + p % 9 ELSE 0 END AS cl,
             CASE WHEN mate = 0 AND p % 5 = 3 THEN 12 + p % 9 WHEN mate = 0 AND p % 5 = 4 THEN 40 ELSE 0 END AS cr,
             event_type = 'error' AND user_id % 10 = 0 AS dup, p % 97 = 0 AS lone, a FROM e2),
u AS (SELECT * FROM r WHERE NOT dup AND NOT (lone AND mate = 1)),
pr AS (SELECT x.lib, x.chrom, x.p, x.qname, x.mapq AS mq0, y.mapq AS mq1, x.pos AS pos0, x.ref_end AS end0, x.rev AS rev0,
              x.cl AS cl0, x.cr AS cr0, y.pos AS pos1, y.ref_end AS end1, y.rev AS rev1, y.cl AS cl1, y.cr AS cr1
       FROM u x JOIN u y ON x.p = y.p AND x.mate = 0 AND y.mate = 1),
il AS (SELECT *, CASE WHEN rev0 <> rev1 AND LEAST(mq0, mq1) >= 20 THEN
              CASE WHEN rev1 THEN end1 - pos0 + cl0 + cr1 ELSE end0 - pos1 + cl1 + cr0 END END AS ilen FROM pr),
ds AS (SELECT lib, chrom, qname, ilen, CASE
         WHEN mq0 < 20 OR mq1 < 20 THEN NULL
         WHEN rev0 <> rev1 AND ilen BETWEEN 255 AND 345 THEN NULL
         WHEN rev0 <> rev1 AND ilen > 345 AND fe < ss THEN 'Del'
         WHEN rev0 <> rev1 AND (fs > ss OR fe > se) THEN 'Dup'
         WHEN rev0 <> rev1 AND ilen < 255 THEN 'Ins'
         WHEN rev0 AND rev1 THEN 'InvR' WHEN NOT rev0 AND NOT rev1 THEN 'InvL' END AS dtype, fs, fe, ss, se, pos0, pos1, end0, end1
       FROM (SELECT *, CASE WHEN rev1 THEN pos0 ELSE pos1 END AS fs, CASE WHEN rev1 THEN end0 ELSE end1 END AS fe,
                    CASE WHEN rev1 THEN pos1 ELSE pos0 END AS ss, CASE WHEN rev1 THEN end1 ELSE end0 END AS se FROM il)),
dp AS (SELECT lib, chrom, qname, ilen, dtype,
              CASE dtype WHEN 'Del' THEN fe WHEN 'Ins' THEN fe WHEN 'Dup' THEN ss WHEN 'InvR' THEN LEAST(pos0, pos1) ELSE LEAST(end0, end1) END AS pos1,
              CASE dtype WHEN 'Del' THEN ss WHEN 'Ins' THEN ss WHEN 'Dup' THEN fe WHEN 'InvR' THEN GREATEST(pos0, pos1) ELSE GREATEST(end0, end1) END AS pos2
       FROM ds WHERE dtype IS NOT NULL)
"""
