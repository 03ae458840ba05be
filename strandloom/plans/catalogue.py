"""Registered queries over the driver's tables, each with an equivalent SQL text where one exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.config import CallConfig
from strandloom.functions import align as A
from strandloom.functions import paths as P
from strandloom.operators import interval as I
from strandloom.operators import ordered as O
from strandloom.plans import breakpoints as B
from strandloom.plans import discordant as D
from strandloom.plans import evidence as E
from strandloom.plans import filter_merge as M
from strandloom.plans import graph as G
from strandloom.plans import inference as N
from strandloom.plans import library as L
from strandloom.plans.derived import READS_SQL, event_alignments, table
from strandloom.session import checkpoint, saved, spread_groups, spread_rows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
CFG = CallConfig()


def query(name: str, sql: str | None = None, reads: bool = False, recursive: bool = False):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            # reads=True: the SQL continues the WITH list of the derived alignments
            text = (READS_SQL + sql) if reads else sql
            ORACLES[name] = text.replace("WITH", "WITH RECURSIVE", 1) if recursive else text
        return fn
    return add


def reads_of(spark, sf, cfg: CallConfig = CFG) -> DataFrame:
    # written out once: a filter on a derived column would otherwise be pushed down through the
    # whole chain of split columns and copy their expressions
    raw = event_alignments(spark, sf)
    return checkpoint(E.with_splits(E.with_geometry(raw.where(A.usable())), cfg).drop("tags", "seq"))


def pairs_of(spark, sf, splits: bool = False) -> DataFrame:
    return E.mates(reads_of(spark, sf, CFG.with_options(do_splits=splits)).drop("ops", "qual"))


def big(*cols):
    return [F.col(c).cast("bigint").alias(c) for c in cols]


def fixed_bounds(spark) -> DataFrame:
    return spark.createDataFrame([("lib1", 255, 345), ("lib2", 255, 345)], "lib string, min_insert int, max_insert int")


# --- scans, filters, mates ----------------------------------------------------------------

@query("read_filter", "SELECT lib, chrom, qname, mate, pos, ref_end AS stop, mapq FROM u", reads=True)
def _(spark, sf):
    return E.with_geometry(event_alignments(spark, sf).where(A.usable())).select(
        "lib", F.col("rname").alias("chrom"), "qname", F.when(A.has_flag("flag", A.READ1), 0).otherwise(1).cast("bigint").alias("mate"),
        *big("pos"), F.col("end").cast("bigint").alias("stop"), *big("mapq"))


@query("region_scan", """SELECT qname, mate, pos FROM r WHERE chrom = 'c1' AND pos < 30000 AND
       pos + CASE WHEN p % 5 = 4 AND mate = 0 THEN 60 ELSE 100 END > 20000""", reads=True)
def _(spark, sf):
    from strandloom.config import parse_region
    from strandloom.sources.alignments import in_region
    return in_region(event_alignments(spark, sf), parse_region("c1:20000-30000")).select(
        "qname", F.when(A.has_flag("flag", A.READ1), 0).otherwise(1).cast("bigint").alias("mate"), *big("pos"))


@query("contig_summary", """SELECT chrom, CAST(count(*) AS BIGINT) AS n_reads, max(ref_end) AS last_end FROM u GROUP BY chrom""", reads=True)
def _(spark, sf):
    return E.with_geometry(event_alignments(spark, sf).where(A.usable())).groupBy(F.col("rname").alias("chrom")).agg(
        F.count(F.lit(1)).alias("n_reads"), F.max("end").cast("bigint").alias("last_end"))


@query("mate_join", """SELECT lib, chrom, qname, LEAST(pos0, pos1) AS a_pos, GREATEST(pos0, pos1) AS b_pos FROM pr""", reads=True)
def _(spark, sf):
    return pairs_of(spark, sf).where("b is not null").select(
        "lib", F.col("rname").alias("chrom"), "qname", F.col("a.pos").cast("bigint").alias("a_pos"), F.col("b.pos").cast("bigint").alias("b_pos"))


@query("unpaired_reads", """SELECT lib, chrom, qname, pos, mate = 0 AND lone AS mate_unmapped FROM u
       WHERE p NOT IN (SELECT p FROM pr)""", reads=True)
def _(spark, sf):
    return pairs_of(spark, sf).where("b is null").select(
        "lib", F.col("rname").alias("chrom"), "qname", F.col("a.pos").cast("bigint").alias("pos"),
        A.has_flag(F.col("a.flag"), A.MATE_UNMAPPED).alias("mate_unmapped"))


@query("hanging_anchors", """SELECT qname, chrom, 'unmapped' AS hanging, rev AS is_reverse,
       CASE WHEN rev THEN ref_end ELSE pos END AS anchor FROM u WHERE lone AND mate = 0""", reads=True)
def _(spark, sf):
    return E.hanging_anchors(reads_of(spark, sf), CFG).withColumn("anchor", F.col("anchor").cast("bigint"))


# the derived clips, with clips at the other ends of both mates besides
@query("read_through_pairs", """SELECT qname, p % 5 <> 4 AND rev0 <> rev1 AND abs(pos0 - pos1) <= 60 AND abs(end0 - end1) <= 60
       AND CASE WHEN rev1 THEN cr0 + p % 3 ELSE p % 2 END > 0 AND CASE WHEN rev1 THEN p % 4 ELSE cl0 END > 0 AS read_through FROM pr""", reads=True)
def _(spark, sf):
    p = F.col("qname").cast("bigint")
    n = lambda c: c.cast("int")
    pairs = pairs_of(spark, sf).where("b is not null")
    pairs = pairs.withColumn("a", F.col("a").withField("clip_r", n(F.col("a.clip_r") + p % 3)))
    pairs = pairs.withColumn("b", F.col("b").withField("clip_l", n(p % 4)).withField("clip_r", n(p % 2)))
    return pairs.select("qname", E.is_read_through(CFG.with_options(read_through_slop=60)).alias("read_through"))


# --- library statistics ---------------------------------------------------------------------

HIST = ", h AS (SELECT lib, ilen, count(*) AS n FROM il WHERE ilen >= 0 GROUP BY lib, ilen) "


@query("insert_length", "SELECT lib, qname, ilen FROM il WHERE ilen IS NOT NULL", reads=True)
def _(spark, sf):
    return pairs_of(spark, sf).select("lib", "qname", E.insert_length(CFG).cast("bigint").alias("ilen")).where("ilen is not null")


@query("insert_histogram", HIST + "SELECT lib, ilen, CAST(n AS BIGINT) AS n FROM h", reads=True)
def insert_histogram(spark, sf):
    return L.insert_histogram(pairs_of(spark, sf), CFG)


STATS = """, st AS (SELECT lib, count(*) AS n_pairs, quantile_cont(ilen, 0.0015) AS q_low, quantile_cont(ilen, 0.25) AS q25,
  quantile_cont(ilen, 0.5) AS median, quantile_cont(ilen, 0.75) AS q75, quantile_cont(ilen, 0.9985) AS q_high FROM il WHERE ilen >= 0 GROUP BY lib) """


@query("insert_percentiles", STATS + """SELECT lib, CAST(n_pairs AS BIGINT) AS n_pairs, round(q_low, 4) AS q_low, round(q25, 4) AS q25,
  round(median, 4) AS median, round(q75, 4) AS q75, round(q_high, 4) AS q_high, round((q75 - q25) / 1.35, 4) AS robust_sd FROM st""", reads=True)
def _(spark, sf):
    out = L.insert_percentiles(insert_histogram(spark, sf))
    return out.select("lib", "n_pairs", *[F.round(c, 4).alias(c) for c in ("q_low", "q25", "median", "q75", "q_high", "robust_sd")])


def pmf_of(spark, sf):
    hist = checkpoint(insert_histogram(spark, sf))
    stats = checkpoint(L.insert_percentiles(hist))
    return L.insert_pmf(hist, stats, CFG)


PMF = HIST + STATS + """, inn AS (SELECT h.*, 3 * median AS xmax FROM h JOIN st USING (lib) WHERE ilen <= 3 * median),
  bwt AS (SELECT i.lib, GREATEST(1.0, 0.785 * (quantile_cont(i.ilen, 0.75) - quantile_cont(i.ilen, 0.25)) / pow(count(*), 0.2)) AS bw
          FROM il i JOIN st USING (lib) WHERE i.ilen >= 0 AND i.ilen <= 3 * median GROUP BY i.lib),
  grid AS (SELECT lib, unnest(generate_series(0, CAST(ceil(3 * median) AS BIGINT))) AS x, 3 * median / ceil(3 * median) AS step FROM st),
  den AS (SELECT g.lib, g.x, sum(inn.n * exp(-0.5 * pow((g.x * g.step - inn.ilen) / bwt.bw, 2))) AS d
          FROM grid g JOIN inn USING (lib) JOIN bwt USING (lib) GROUP BY g.lib, g.x),
  pm AS (SELECT lib, x, d / sum(d) OVER (PARTITION BY lib) AS pmf FROM den),
  cu AS (SELECT *, sum(pmf) OVER (PARTITION BY lib ORDER BY x) AS cdf FROM pm) """


@query("insert_pmf_kde", PMF + "SELECT lib, CAST(x AS BIGINT) AS x, round(pmf, 8) AS pmf FROM pm", reads=True)
def _(spark, sf):
    return pmf_of(spark, sf).select("lib", *big("x"), F.round("pmf", 8).alias("pmf"))


@query("insert_cdf_sums", PMF + """SELECT lib, CAST(x AS BIGINT) AS x, round(cdf, 6) AS cdf,
  round(sum(cdf) OVER (PARTITION BY lib ORDER BY x), 4) AS cdf_sum FROM cu""", reads=True)
def _(spark, sf):
    return L.pmf_sums(pmf_of(spark, sf)).select("lib", *big("x"), F.round("cdf", 6).alias("cdf"), F.round("cdf_sum", 4).alias("cdf_sum"))


@query("concordance_bounds", PMF + """SELECT lib, CAST(min(x) FILTER (WHERE x >= 1) - 1 AS BIGINT) AS min_insert,
  CAST(max(x) FILTER (WHERE x < last) + 1 AS BIGINT) AS max_insert FROM (SELECT *, max(pmf) OVER (PARTITION BY lib) AS mode,
  max(x) OVER (PARTITION BY lib) AS last FROM pm) WHERE pmf > 0 AND ln(mode) - ln(pmf) < 4.5 GROUP BY lib""", reads=True)
def _(spark, sf):
    return L.concordance_bounds(checkpoint(pmf_of(spark, sf)), CFG).select("lib", *big("min_insert", "max_insert"))


@query("insert_quantiles", PMF + """SELECT lib, CAST(min(x) FILTER (WHERE cdf >= 0.01) AS BIGINT) AS q01, CAST(min(x) FILTER (WHERE cdf >= 0.025) AS BIGINT) AS range_lo,
  CAST(min(x) FILTER (WHERE cdf >= 0.975) AS BIGINT) AS range_hi, CAST(min(x) FILTER (WHERE cdf >= 0.99) AS BIGINT) AS q99 FROM cu GROUP BY lib""", reads=True)
def _(spark, sf):
    q = L.pmf_quantiles(L.pmf_sums(pmf_of(spark, sf)), {"q01": .01, "range_lo": .025, "range_hi": .975, "q99": .99})
    return q.select("lib", *big("q01", "range_lo", "range_hi", "q99"))


@query("pi_robust", PMF + """SELECT round(quantile_cont(pi, 0.5) * 1e6, 3) AS pi_millionths FROM (SELECT lib, max(pmf) AS pi FROM (SELECT *,
  sum(pmf) OVER (PARTITION BY lib ORDER BY pmf DESC, x ROWS UNBOUNDED PRECEDING) AS c FROM pm) WHERE c >= 1 - 1e-4 GROUP BY lib)""", reads=True)
def _(spark, sf):
    return L.pi_robust(pmf_of(spark, sf), 1e-4).select(F.round(F.col("pi_robust") * 1e6, 3).alias("pi_millionths"))


@query("read_length_medians", """SELECT lib, CAST(round_even(quantile_cont(LEAST(q0, q1), 0.5), 0) AS BIGINT) AS rlen_short,
  CAST(round_even(quantile_cont(GREATEST(q0, q1), 0.5), 0) AS BIGINT) AS rlen_long FROM (SELECT lib, end0 - pos0 + cl0 + cr0 AS q0, end1 - pos1 + cl1 + cr1 AS q1 FROM pr) GROUP BY lib""", reads=True)
def _(spark, sf):
    return L.read_length_medians(pairs_of(spark, sf)).select("lib", *big("rlen_short", "rlen_long"))


@query("mapstats_symmetric", """, lab AS (SELECT lib, 0 AS label FROM pr WHERE mq0 >= 20 AND mq1 >= 20
   UNION ALL SELECT lib, 1 FROM u WHERE lone AND mate = 0 AND mapq >= 20),
  cn AS (SELECT lib, label, count(*) AS n FROM lab GROUP BY lib, label),
  sy AS (SELECT lib, label, sum(n) AS n FROM (SELECT * FROM cn UNION ALL SELECT lib, CASE label WHEN 1 THEN 2 ELSE 0 END, n FROM cn) GROUP BY lib, label)
  SELECT lib, CAST(label AS BIGINT) AS label, CAST(n AS BIGINT) AS n, round(n / sum(n) OVER (PARTITION BY lib), 8) AS prob FROM sy""", reads=True)
def _(spark, sf):
    return E.mappability_model(pairs_of(spark, sf), CFG).select("lib", *big("label", "n"), F.round("prob", 8).alias("prob"))


@query("coverage_stats", STATS + """, nr AS (SELECT lib, chrom, count(*) AS n_reads FROM u GROUP BY lib, chrom),
  np AS (SELECT lib, chrom, count(*) AS n_pairs FROM pr GROUP BY lib, chrom)
  SELECT lib, chrom, CAST(n_reads AS BIGINT) AS n_reads, CAST(np.n_pairs AS BIGINT) AS n_pairs, round(n_reads * 100 / 62000.0, 6) AS seq_coverage,
  round(np.n_pairs * median / 62000.0, 6) AS phys_coverage FROM nr JOIN np USING (lib, chrom) JOIN st USING (lib)""", reads=True)
def _(spark, sf):
    reads = reads_of(spark, sf)
    pairs = checkpoint(E.mates(reads))
    free = reads.groupBy(F.col("rname").alias("chrom")).agg(F.lit(62000).alias("free_len"))
    stats = L.insert_percentiles(L.insert_histogram(pairs, CFG))
    out = L.coverage_stats(reads, pairs, stats, free, F.lit(100))
    return out.select("lib", "chrom", "n_reads", "n_pairs", F.round("seq_coverage", 6).alias("seq_coverage"), F.round("phys_coverage", 6).alias("phys_coverage"))


# --- discordant pairs --------------------------------------------------------------------------

def discordant_of(spark, sf):
    return E.discordant_pairs(pairs_of(spark, sf), fixed_bounds(spark), CFG)


@query("discordant_type", "SELECT lib, chrom, qname, dtype, pos1, pos2 FROM dp", reads=True)
def _(spark, sf):
    return discordant_of(spark, sf).select("lib", "chrom", "qname", "dtype", "pos1", "pos2")


@query("discordant_counts", "SELECT chrom, dtype, CAST(count(*) AS BIGINT) AS n FROM dp GROUP BY chrom, dtype", reads=True)
def _(spark, sf):
    return discordant_of(spark, sf).groupBy("chrom", "dtype").agg(F.count(F.lit(1)).alias("n"))


@query("inverted_pairs", """SELECT chrom, qname, rev0 AS is_reverse, LEAST(pos0, pos1) AS left_pos FROM pr WHERE rev0 = rev1""", reads=True)
def _(spark, sf):
    return E.inverted_pairs(pairs_of(spark, sf)).select("chrom", "qname", "is_reverse", F.col("pos1").cast("bigint").alias("left_pos"))


def spaced_pairs(spark, sf):
    """Discordant pairs with distance 430 and class slop, as used by the clustering queries."""
    return (discordant_of(spark, sf).withColumn("rep", F.lit(-1)).withColumn("mu", F.lit(300.0)).withColumn("sigma", F.lit(20.0))
            .withColumn("d", F.lit(430).cast("bigint")).withColumn("slop", D.slop_of(CFG)))


COMPONENTS = """, pt AS (SELECT DISTINCT lib, chrom, dtype, pos1, pos2, CASE WHEN dtype = 'Ins' THEN 20 ELSE -1 END AS slop FROM dp),
  lk AS (SELECT a.lib, a.chrom, a.dtype, a.pos1 AS a1, a.pos2 AS a2, b.pos1 AS b1, b.pos2 AS b2 FROM pt a JOIN pt b
         ON a.lib = b.lib AND a.chrom = b.chrom AND a.dtype = b.dtype AND abs(a.pos1 - b.pos1) <= 430 AND abs(a.pos2 - b.pos2) <= 430
         AND GREATEST(a.pos1, b.pos1) - LEAST(a.pos2, b.pos2) <= a.slop),
  rc AS (SELECT lib, chrom, dtype, pos1, pos2, pos1 AS r1, pos2 AS r2 FROM pt
         UNION SELECT rc.lib, rc.chrom, rc.dtype, rc.pos1, rc.pos2, lk.b1, lk.b2 FROM rc JOIN lk
         ON rc.lib = lk.lib AND rc.chrom = lk.chrom AND rc.dtype = lk.dtype AND rc.r1 = lk.a1 AND rc.r2 = lk.a2),
  cp AS (SELECT lib, chrom, dtype, pos1, pos2, min((r1, r2)) AS root FROM rc GROUP BY lib, chrom, dtype, pos1, pos2) """
COMPONENTS_WITH = READS_SQL.replace("WITH e0", "WITH RECURSIVE e0", 1) + COMPONENTS


@query("pe_components", COMPONENTS_WITH + """SELECT lib, chrom, dtype, CAST(count(*) AS BIGINT) AS n, min(pos1) AS min_pos1, max(pos1) AS max_pos1,
  min(pos2) AS min_pos2, max(pos2) AS max_pos2 FROM dp JOIN cp USING (lib, chrom, dtype, pos1, pos2) GROUP BY lib, chrom, dtype, root""")
def _(spark, sf):
    from strandloom.operators.components import pair_components
    comp = pair_components(checkpoint(spaced_pairs(spark, sf)), D.KEYS, "d", "slop")
    return comp.groupBy("lib", "chrom", "dtype", "component").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos1").alias("min_pos1"), F.max("pos1").alias("max_pos1"),
        F.min("pos2").alias("min_pos2"), F.max("pos2").alias("max_pos2")).drop("component")


CLIQUES = COMPONENTS_WITH + """, mb AS (SELECT dp.*, root, CASE WHEN dtype = 'Ins' THEN 20 ELSE -1 END AS slop FROM dp JOIN cp USING (lib, chrom, dtype, pos1, pos2)),
  sz AS (SELECT lib, chrom, dtype, root, count(*) AS n, max(pos1) - min(pos1) <= 430 AND max(pos2) - min(pos2) <= 430
              AND max(pos1) - min(pos2) <= max(slop) AS mutual FROM mb GROUP BY lib, chrom, dtype, root),
  win AS (SELECT x.lib, x.chrom, x.dtype, x.root, x.pos1 AS x0, y.pos2 AS y0, list(m.qname ORDER BY m.pos1, m.pos2, m.qname) AS members, count(*) AS k
          FROM (SELECT DISTINCT lib, chrom, dtype, root, pos1 FROM mb) x JOIN (SELECT DISTINCT lib, chrom, dtype, root, pos2 FROM mb) y
          USING (lib, chrom, dtype, root) JOIN sz USING (lib, chrom, dtype, root) JOIN mb m USING (lib, chrom, dtype, root)
          WHERE sz.n > 1 AND m.pos1 BETWEEN x.pos1 AND x.pos1 + 430 AND m.pos2 BETWEEN y.pos2 AND y.pos2 + 430 AND m.pos1 <= y.pos2 + m.slop
          GROUP BY x.lib, x.chrom, x.dtype, x.root, x.pos1, y.pos2),
  cl AS (SELECT DISTINCT lib, chrom, dtype, root, members FROM win WHERE k = (SELECT max(k) FROM win w WHERE w.lib = win.lib AND w.chrom = win.chrom
         AND w.dtype = win.dtype AND w.root = win.root)),
  ca AS (SELECT cl.lib, cl.chrom, cl.dtype, cl.root, cl.members, count(*) AS n, min(mb.pos1) AS min_pos1, max(mb.pos1) AS max_pos1, min(mb.pos2) AS min_pos2,
                max(mb.pos2) AS max_pos2, sum(mb.ilen) AS s FROM cl JOIN mb USING (lib, chrom, dtype, root) WHERE list_contains(cl.members, mb.qname)
         GROUP BY cl.lib, cl.chrom, cl.dtype, cl.root, cl.members),
  sc AS (SELECT *, CASE dtype WHEN 'Del' THEN (2 * LEAST(min_pos2 - max_pos1, (s - n * 300.0) / n) * (s - n * 300.0) - n * pow(LEAST(min_pos2 - max_pos1, (s - n * 300.0) / n), 2)) / 800.0
           WHEN 'Ins' THEN (-2 * GREATEST(GREATEST(0, max_pos1 - min_pos2), (n * 300.0 - s) / n) * (s - n * 300.0) - n * pow(GREATEST(GREATEST(0, max_pos1 - min_pos2), (n * 300.0 - s) / n), 2)) / 800.0
           ELSE n END AS lr FROM ca) """


def clusters_of(spark, sf):
    pairs = checkpoint(spaced_pairs(spark, sf))
    return D.score_clusters(D.cluster_pairs(pairs, CFG), CFG)


@query("pe_max_cliques", CLIQUES + "SELECT lib, chrom, dtype, CAST(n AS BIGINT) AS n, min_pos1, max_pos1, min_pos2, max_pos2 FROM sc")
def _(spark, sf):
    return clusters_of(spark, sf).select("lib", "chrom", "dtype", "n", "min_pos1", "max_pos1", "min_pos2", "max_pos2")


@query("pe_likelihood_ratio", CLIQUES + "SELECT lib, chrom, dtype, min_pos1, min_pos2, round(lr, 2) AS lr FROM sc")
def _(spark, sf):
    return clusters_of(spark, sf).select("lib", "chrom", "dtype", "min_pos1", "min_pos2", F.round("lr", 2).alias("lr"))


CI = """, q AS (SELECT *, pow(20.0, 1.0 / (n - 1)) AS q FROM sc), ci AS (SELECT *,
  CASE WHEN dtype IN ('Del', 'Ins', 'InvL') THEN max_pos1 - 5 ELSE CAST(floor((1 - q) * (max_pos1 - min_pos1) + min_pos1) AS BIGINT) END AS left_lo,
  CASE WHEN dtype IN ('Del', 'Ins', 'InvL') THEN CAST(ceil(q * (max_pos1 - min_pos1) + min_pos1) AS BIGINT) ELSE min_pos1 + 5 END AS left_hi,
  CASE WHEN dtype IN ('Del', 'Ins', 'InvR') THEN CAST(floor((1 - q) * (max_pos2 - min_pos2) + min_pos2) AS BIGINT) ELSE max_pos2 - 5 END AS right_lo,
  CASE WHEN dtype IN ('Del', 'Ins', 'InvR') THEN min_pos2 + 5 ELSE CAST(ceil(q * (max_pos2 - min_pos2) + min_pos2) AS BIGINT) END AS right_hi FROM q) """


@query("pe_breakpoint_ci", CLIQUES + CI + "SELECT lib, chrom, dtype, CAST(n AS BIGINT) AS n, left_lo, left_hi, right_lo, right_hi FROM ci")
def _(spark, sf):
    out = D.cluster_breakpoints(clusters_of(spark, sf), CFG)
    return out.select("lib", "chrom", "dtype", "n", F.col("left_ci.lo").alias("left_lo"), F.col("left_ci.hi").alias("left_hi"),
                      F.col("right_ci.lo").alias("right_lo"), F.col("right_ci.hi").alias("right_hi"))


@query("null_pairs", """, nl AS (SELECT dp.*, rep, pos2 - pos1 AS span, CAST('0x' || substr(md5(concat_ws('|', lib, dtype, qname, pos1, pos2, rep, 204178949)), 1, 15) AS BIGINT) AS draw
  FROM dp, (SELECT unnest([0, 1, 2, 3]) AS rep) WHERE (dtype <> 'Del' OR ilen <= 900) AND abs(pos2 - pos1) < 60000)
  SELECT lib, chrom, dtype, qname, CAST(rep AS BIGINT) AS rep, GREATEST(0, -span) + draw % (60000 - GREATEST(0, span) - GREATEST(0, -span) + 1) AS pos1,
  GREATEST(0, -span) + draw % (60000 - GREATEST(0, span) - GREATEST(0, -span) + 1) + span AS pos2 FROM nl""", reads=True)
def _(spark, sf):
    pairs = spaced_pairs(spark, sf)
    free = pairs.select("chrom").distinct().withColumn("free_len", F.lit(60000).cast("bigint"))
    # the hash key names the null replicate
    return D.null_pairs(pairs, free, CFG).select("lib", "chrom", "dtype", "qname", *big("rep", "pos1", "pos2"))


@query("fdr_select", """WITH s AS (SELECT l_shipmode AS k, q AS lr, r, z FROM (SELECT l_suppkey % 7 AS l_shipmode, round(l_quantity + 3 * (l_linenumber % 4) - CASE WHEN l_linestatus = 'O' THEN 0 ELSE 9 END, 0) AS q,
    CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS r, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS z FROM lineitem) WHERE r + z > 0),
  t AS (SELECT k, sum(r) AS m, sum(z) AS n0 FROM s GROUP BY k),
  d AS (SELECT k, lr, sum(r) AS r, sum(z) AS z FROM s GROUP BY k, lr),
  c AS (SELECT *, coalesce(sum(r) OVER w, 0) AS r_lt, coalesce(sum(z) OVER w, 0) AS z_lt FROM d WINDOW w AS (PARTITION BY k ORDER BY lr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  b AS (SELECT c.k, min(c.lr) AS cutoff FROM c JOIN t USING (k) WHERE c.r > 0 AND m * LEAST(1.0, n0 / 4.0 / m) * (n0 - z_lt) / n0 / (m - r_lt) <= 0.1 GROUP BY c.k)
  SELECT k, CAST(m AS BIGINT) AS n_clusters, CAST(n0 AS BIGINT) AS n_null, coalesce(cutoff, CAST('infinity' AS DOUBLE)) AS cutoff FROM t LEFT JOIN b USING (k)""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 7).alias("k"), F.round(
            F.col("l_quantity") + 3 * (F.col("l_linenumber") % 4) - F.when(F.col("l_linestatus") == "O", 0).otherwise(9), 0).alias("lr"),
        (F.col("l_linestatus") == "O").alias("real"))
    return D.fdr_cutoffs(li.where("real"), li.where("not real"), ["k"], CFG)


# --- splits and soft clips -----------------------------------------------------------------------

# mate 0 of p % 5 = 4: 60 bases at a, then 40 bases at a + 160 + 100 (p % 7); the read may be reversed
SPLITS = """, sp AS (SELECT lib, chrom, qname, p, mapq, rev, pos, ref_end, a + 160 + (p % 7) * 100 AS pos2, p % 3 = 0 AS rev2 FROM u WHERE mate = 0 AND p % 5 = 4 AND mapq >= 20)"""


@query("split_reads", SPLITS + """ SELECT lib, chrom, qname, CASE WHEN NOT rev AND NOT rev2 THEN 'Del+' WHEN rev AND rev2 THEN 'Del-' WHEN rev2 THEN 'InvL+' ELSE 'InvL-' END AS split_type,
    ref_end AS bp1_lo, ref_end AS bp1_hi, pos2 + CASE WHEN rev <> rev2 THEN 40 ELSE 0 END AS bp2_lo, pos2 + CASE WHEN rev <> rev2 THEN 40 ELSE 0 END AS bp2_hi FROM sp""", reads=True)
def _(spark, sf):
    r = reads_of(spark, sf).where("split is not null")
    return r.select("lib", F.col("rname").alias("chrom"), "qname", "split.split_type", *[
        F.col(f"split.{c}").cast("bigint").alias(c) for c in ("bp1_lo", "bp1_hi", "bp2_lo", "bp2_hi")])


@query("split_evidence", SPLITS + """ SELECT sp.lib, sp.chrom, sp.qname, sp.qname || '_1' AS split_id, sp.mapq, CASE WHEN m.p IS NOT NULL THEN sp.qname || '_2' END AS mate_id,
    m.mapq AS mate_mapq, CASE WHEN NOT sp.rev AND NOT rev2 THEN 'Del+' WHEN sp.rev AND rev2 THEN 'Del-' WHEN rev2 THEN 'InvL+' ELSE 'InvL-' END AS split_type, sp.ref_end AS bp1_lo,
    sp.ref_end AS bp1_hi, pos2 + CASE WHEN sp.rev <> rev2 THEN 40 ELSE 0 END AS bp2_lo, pos2 + CASE WHEN sp.rev <> rev2 THEN 40 ELSE 0 END AS bp2_hi
    FROM sp LEFT JOIN u m ON m.p = sp.p AND m.mate = 1""", reads=True)
def _(spark, sf):
    out = E.split_evidence(pairs_of(spark, sf, splits=True))
    return out.select("lib", "chrom", "qname", "split_id", *big("mapq"), "mate_id", *big("mate_mapq"), "split_type", *big("bp1_lo", "bp1_hi", "bp2_lo", "bp2_hi"))


# reads aligned in two parts (p % 5 = 4) are soft-clip evidence only where their quality is too low for a split
CLIPS = """, cb AS (SELECT lib, chrom, p, mapq, rev, cl > 0 AS is_left, CASE WHEN cl > 0 THEN pos ELSE ref_end END AS pos,
    CASE WHEN p % 5 = 4 THEN cr ELSE GREATEST(0, cl + cr - CASE WHEN p % 4 > 0 THEN p % 4 + 5 ELSE 0 END) END AS clipped, 3 + (p * 3) % 37 AS q,
    CASE WHEN p % 5 = 4 THEN 60 ELSE 100 END AS mapped FROM u
    WHERE mate = 0 AND (p % 5 IN (2, 3) OR p % 5 = 4 AND mapq < 20)),
  sc0 AS (SELECT lib, chrom, NOT is_left AS is_right, pos, clipped, mapped, mapq, rev FROM cb WHERE mapq >= 10 AND clipped >= 5 AND q >= 15)"""


@query("softclip_evidence", CLIPS + " SELECT lib, chrom, is_right, pos, clipped AS bases_clipped, mapq, rev AS is_reverse FROM sc0", reads=True)
def softclip_evidence(spark, sf):
    clips = clips_of(spark, sf)
    return clips.select("lib", "chrom", "is_right", "pos", *big("bases_clipped", "mapq"), "is_reverse")


def clips_of(spark, sf):
    # written out as in reads_of, but only clipped reads are split, and only what evidence needs is kept
    reads = E.with_geometry(event_alignments(spark, sf).where(A.usable())).where(E.may_clip(CFG))
    return E.softclip_evidence(saved(E.with_splits(reads, CFG).select(*E.CLIP_FIELDS)), CFG)


@query("softclip_clusters", CLIPS + """, ps AS (SELECT chrom, is_right, pos, count(*) AS n, sum(mapq) AS mq, max(clipped) AS clip FROM sc0 GROUP BY chrom, is_right, pos),
  br AS (SELECT *, CASE WHEN pos - lag(pos) OVER w > 5 THEN 1 ELSE 0 END AS b FROM ps WINDOW w AS (PARTITION BY chrom, is_right ORDER BY pos)),
  gr AS (SELECT *, sum(b) OVER (PARTITION BY chrom, is_right ORDER BY pos) AS g FROM br),
  best AS (SELECT *, row_number() OVER (PARTITION BY chrom, is_right, g ORDER BY n DESC, pos) AS k FROM gr)
  SELECT chrom, is_right, max(pos) FILTER (WHERE k = 1) AS pos, CAST(sum(n) AS BIGINT) AS num_reads, CAST(max(n) FILTER (WHERE k = 1) AS BIGINT) AS num_reads_exact,
    CAST(max(mq) FILTER (WHERE k = 1) AS BIGINT) AS sum_mapq,
    CASE WHEN is_right THEN max(pos + clip) - max(pos) FILTER (WHERE k = 1) ELSE max(pos) FILTER (WHERE k = 1) - min(pos - clip) END AS bases_clipped
  FROM best GROUP BY chrom, is_right, g HAVING sum(n) >= 2""", reads=True)
def _(spark, sf):
    return B.softclip_clusters(clips_of(spark, sf), CFG).select(
        "chrom", "is_right", *big("pos", "num_reads", "num_reads_exact", "sum_mapq", "bases_clipped"))


@query("softclip_bedgraph", CLIPS + """ SELECT 'chr' || chrom AS chrom, is_right, pos AS start, pos + 1 AS "end", CAST(count(*) AS BIGINT) AS n FROM sc0 GROUP BY chrom, is_right, pos""", reads=True)
def _(spark, sf):
    from strandloom.sources.writers import softclip_bedgraph
    return softclip_bedgraph(clips_of(spark, sf))


@query("microhomology_matching", CLIPS + """, ps AS (SELECT chrom, is_right, pos, count(*) AS n, max(mapped) AS mapped FROM sc0 GROUP BY chrom, is_right, pos),
  br AS (SELECT *, CASE WHEN pos - lag(pos) OVER w > 5 THEN 1 ELSE 0 END AS b FROM ps WINDOW w AS (PARTITION BY chrom, is_right ORDER BY pos)),
  gr AS (SELECT *, sum(b) OVER (PARTITION BY chrom, is_right ORDER BY pos) AS g FROM br),
  best AS (SELECT *, row_number() OVER (PARTITION BY chrom, is_right, g ORDER BY n DESC, pos) AS k FROM gr),
  cl AS (SELECT chrom, is_right, max(pos) FILTER (WHERE k = 1) AS pos, CAST(sum(n) AS BIGINT) AS reads,
    CASE WHEN is_right THEN max(pos) FILTER (WHERE k = 1) - min(pos - mapped) ELSE max(pos + mapped) - max(pos) FILTER (WHERE k = 1) END AS mapped FROM best GROUP BY chrom, is_right, g),
  pc AS (SELECT l.chrom, l.pos AS l_pos, l.mapped AS l_mapped, l.reads AS l_reads, r.pos AS r_pos, r.mapped AS r_mapped, r.reads AS r_reads FROM cl l JOIN cl r ON l.chrom = r.chrom
    AND NOT l.is_right AND r.is_right AND r.pos - l.pos BETWEEN 1 AND 25 AND l.mapped > r.pos - l.pos AND r.mapped > r.pos - l.pos),
  ls AS (SELECT chrom, l_pos, list(r_pos ORDER BY r_pos) AS rs, row_number() OVER (PARTITION BY chrom ORDER BY l_pos) AS k FROM pc GROUP BY chrom, l_pos),
  gm AS (SELECT chrom, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS l_pos, CAST(NULL AS BIGINT) AS r_pos, CAST([] AS BIGINT[]) AS used FROM (SELECT DISTINCT chrom FROM ls)
    UNION ALL SELECT chrom, k, l_pos, pick, list_append(list_filter(used, lambda x: x > l_pos), pick) FROM (SELECT ls.chrom, ls.k, ls.l_pos, gm.used,
      list_filter(ls.rs, lambda x: NOT list_contains(gm.used, x))[1] AS pick FROM gm JOIN ls ON ls.chrom = gm.chrom AND ls.k = gm.k + 1))
  SELECT pc.* FROM pc JOIN gm ON gm.chrom = pc.chrom AND gm.l_pos = pc.l_pos AND gm.r_pos = pc.r_pos""", reads=True, recursive=True)
def _(spark, sf):
    clusters = saved(B.softclip_clusters(clips_of(spark, sf), CFG.with_options(min_softclip_support=1)))
    return B.greedy_matching(B.microhomology_candidates(clusters, CFG), ["chrom"], "l_pos", "r_pos")


# --- intervals over lineitem --------------------------------------------------------------------------

# one interval per line: a contig for each thousand orders, start by part, length by quantity
IV = """WITH iv AS (SELECT 's' || (l_orderkey // 1000) AS chrom, (l_partkey * 7919 + l_suppkey * 613) % 200000 AS lo,
    (l_partkey * 7919 + l_suppkey * 613) % 200000 + CAST(l_quantity AS BIGINT) AS hi, l_linenumber AS ln FROM lineitem) """


def intervals_of(spark, sf) -> DataFrame:
    start = (F.col("l_partkey") * 7919 + F.col("l_suppkey") * 613) % 200000
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("s"), F.expr("l_orderkey div 1000").cast("string")).alias("chrom"), start.alias("lo"),
        (start + F.col("l_quantity").cast("bigint")).alias("hi"), F.col("l_linenumber").alias("ln"))


@query("interval_islands", IV + """, o AS (SELECT chrom, lo, hi, max(hi) OVER (PARTITION BY chrom ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM iv),
  g AS (SELECT *, sum(CASE WHEN prev IS NULL OR lo - prev > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM o)
  SELECT chrom, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY chrom, k""")
def _(spark, sf):
    return O.island_spans(intervals_of(spark, sf), ["chrom"], "lo", "hi", 5)


SETS = IV + """, ev AS (SELECT chrom, lo AS pos, CASE WHEN ln <= 3 THEN 1 ELSE 0 END AS a, CASE WHEN ln > 3 THEN 1 ELSE 0 END AS b FROM iv
    UNION ALL SELECT chrom, hi, CASE WHEN ln <= 3 THEN -1 ELSE 0 END, CASE WHEN ln > 3 THEN -1 ELSE 0 END FROM iv),
  dn AS (SELECT chrom, pos, sum(a) AS a, sum(b) AS b FROM ev GROUP BY chrom, pos),
  sg AS (SELECT chrom, pos, lead(pos) OVER w AS stop, sum(a) OVER w AS da, sum(b) OVER w AS db FROM dn WINDOW w AS (PARTITION BY chrom ORDER BY pos)),
  kp AS (SELECT *, CASE WHEN lag(stop) OVER (PARTITION BY chrom ORDER BY pos) = pos THEN 0 ELSE 1 END AS brk FROM sg WHERE stop IS NOT NULL AND {cond}),
  gp AS (SELECT *, sum(brk) OVER (PARTITION BY chrom ORDER BY pos) AS k FROM kp)
  SELECT chrom, min(pos) AS lo, max(stop) AS hi FROM gp GROUP BY chrom, k"""


def two_sets(spark, sf):
    iv = intervals_of(spark, sf)
    return iv.where("ln <= 3").select("chrom", "lo", "hi"), iv.where("ln > 3").select("chrom", "lo", "hi")


@query("interval_union", SETS.format(cond="(da > 0 OR db > 0)"))
def _(spark, sf):
    return I.interval_union(*two_sets(spark, sf), ["chrom"])


@query("interval_intersect", SETS.format(cond="da > 0 AND db > 0"))
def _(spark, sf):
    return I.interval_intersect(*two_sets(spark, sf), ["chrom"])


@query("interval_except", SETS.format(cond="da > 0 AND db = 0"))
def _(spark, sf):
    return I.interval_except(*two_sets(spark, sf), ["chrom"])


@query("len_without_gaps", SETS.split("kp AS")[0].rstrip().rstrip(",") + """ SELECT chrom, CAST(200100 - sum(stop - pos) AS BIGINT) AS free_len FROM sg
    WHERE stop IS NOT NULL AND db > 0 GROUP BY chrom""")
def _(spark, sf):
    a, b = two_sets(spark, sf)
    regions = b.select("chrom").distinct().select("chrom", F.lit(0).alias("lo"), F.lit(200100).alias("hi"))
    return I.length_without_gaps(regions, b, ["chrom"])


@query("coverage_sweep", """, ev AS (SELECT chrom, pos, 1 AS d FROM u UNION ALL SELECT chrom, ref_end, -1 FROM u),
  dn AS (SELECT chrom, pos, sum(d) AS d FROM ev GROUP BY chrom, pos),
  sg AS (SELECT chrom, pos, lead(pos) OVER w AS stop, sum(d) OVER w AS depth FROM dn WINDOW w AS (PARTITION BY chrom ORDER BY pos))
  SELECT chrom, pos, stop, CAST(depth AS BIGINT) AS depth FROM sg WHERE depth > 0""", reads=True)
def _(spark, sf):
    r = E.with_geometry(event_alignments(spark, sf).where(A.usable())).select(F.col("rname").alias("chrom"), "pos", "end")
    return I.coverage(r, ["chrom"], "pos", "end").select("chrom", "pos", F.col("end").alias("stop"), "depth")


@query("signal_window_mean", IV + """, p AS (SELECT chrom, lo AS pos, sum(hi - lo) AS v, count(*) AS n FROM iv GROUP BY chrom, lo)
  SELECT chrom, pos, CAST(sum(v) OVER w AS BIGINT) AS window_sum, CAST(sum(n) OVER w AS BIGINT) AS window_count, round(sum(v) OVER w / sum(n) OVER w, 6) AS window_mean
  FROM p WINDOW w AS (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 50 PRECEDING AND 49 FOLLOWING)""")
def _(spark, sf):
    iv = intervals_of(spark, sf).withColumn("v", F.col("hi") - F.col("lo"))
    out = O.centered_window(iv, ["chrom"], "lo", "v", 100)
    return out.select("chrom", F.col("lo").alias("pos"), "window_sum", "window_count", F.round("window_mean", 6).alias("window_mean"))


@query("band_join_closeby", IV + """SELECT a.chrom, a.lo AS a, b.lo AS b FROM (SELECT DISTINCT chrom, lo FROM iv WHERE ln <= 3) a
    JOIN (SELECT DISTINCT chrom, lo FROM iv WHERE ln > 3) b ON a.chrom = b.chrom AND abs(a.lo - b.lo) <= 5""")
def _(spark, sf):
    a, b = two_sets(spark, sf)
    return I.band_join(a.select("chrom", F.col("lo").alias("a")).distinct(), b.select("chrom", F.col("lo").alias("b")).distinct(),
                       ["chrom"], "a", "b", 5)


@query("interval_overlap_join", IV + """SELECT a.chrom, CAST(count(*) AS BIGINT) AS n, CAST(sum(LEAST(a.hi, b.hi) - GREATEST(a.lo, b.lo)) AS BIGINT) AS bases
    FROM (SELECT * FROM iv WHERE ln <= 3) a JOIN (SELECT * FROM iv WHERE ln > 3) b ON a.chrom = b.chrom AND a.lo < b.hi AND b.lo < a.hi GROUP BY a.chrom""")
def _(spark, sf):
    a, b = two_sets(spark, sf)
    j = I.overlap_join(a, b.withColumnsRenamed({"lo": "lo2", "hi": "hi2"}), ["chrom"], ("lo", "hi"), ("lo2", "hi2"), 1024)
    return j.groupBy("chrom").agg(F.count(F.lit(1)).alias("n"), F.sum(F.least("hi", "hi2") - F.greatest("lo", "lo2")).alias("bases"))


# gaps: one per order, on the contig of its lines
GAPS = """, gaps AS (SELECT 's' || (o_orderkey // 1000) AS chrom, (o_orderkey * 1237) % 200000 AS lo, (o_orderkey * 1237) % 200000 + 30 AS hi FROM orders) """


def gaps_of(spark, sf):
    lo = (F.col("o_orderkey") * 1237) % 200000
    return table(spark, sf, "orders").select(F.concat(F.lit("s"), F.expr("o_orderkey div 1000").cast("string")).alias("chrom"),
                                             lo.alias("lo"), (lo + 30).alias("hi"))


@query("gap_anti_join", IV + GAPS + """SELECT DISTINCT chrom, lo, hi FROM iv WHERE hi > lo AND NOT EXISTS
    (SELECT 1 FROM gaps g WHERE g.chrom = iv.chrom AND iv.lo < g.hi AND g.lo < iv.hi)""")
def _(spark, sf):
    iv = intervals_of(spark, sf).select("chrom", "lo", "hi").distinct().where("hi > lo")
    g = gaps_of(spark, sf).withColumnsRenamed({"lo": "g_lo", "hi": "g_hi"})
    return I.overlap_anti(iv, g, ["chrom"], ("lo", "hi"), ("g_lo", "g_hi"), ["chrom", "lo", "hi"]).select("chrom", "lo", "hi")


# breakpoints: every start position, as short closed intervals of two evidence levels
EVI = IV + """, bp AS (SELECT DISTINCT chrom, lo, lo + ln AS hi, CASE WHEN ln <= 2 THEN 2 ELSE 1 END AS level FROM iv) """


def evidence_of(spark, sf):
    iv = intervals_of(spark, sf)
    return iv.select("chrom", "lo", (F.col("lo") + F.col("ln")).alias("hi"), F.when(F.col("ln") <= 2, 2).otherwise(1).alias("level"))


def _isl(src: str, out: str) -> str:
    return f""", {out}_o AS (SELECT chrom, lo, hi, max(hi) OVER (PARTITION BY chrom ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM {src}),
  {out}_g AS (SELECT *, sum(CASE WHEN prev IS NULL OR lo > prev THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM {out}_o),
  {out} AS (SELECT chrom, min(lo) AS bp_lo, max(hi) AS bp_hi FROM {out}_g GROUP BY chrom, k)"""


@query("precedence_merge", EVI + ", l2 AS (SELECT * FROM bp WHERE level = 2), l1 AS (SELECT * FROM bp WHERE level = 1)" + _isl("l2", "h2")
       + ", rest AS (SELECT * FROM l1 WHERE NOT EXISTS (SELECT 1 FROM h2 WHERE h2.chrom = l1.chrom AND l1.lo <= h2.bp_hi AND h2.bp_lo <= l1.hi))" + _isl("rest", "h1")
       + " SELECT chrom, bp_lo, bp_hi FROM h2 UNION ALL SELECT chrom, bp_lo, bp_hi FROM h1")
def _(spark, sf):
    return B.precedence_hulls(evidence_of(spark, sf))[0]


@query("breakpoint_support", EVI + ", h_in AS (SELECT DISTINCT chrom, lo, hi FROM bp)" + _isl("h_in", "h") + """,
  ws AS (SELECT h.chrom, bp_lo, bp_hi, count(*) AS n FROM h JOIN (SELECT chrom, lo, lo + ln AS hi FROM iv) e
         ON h.chrom = e.chrom AND e.lo BETWEEN h.bp_lo AND h.bp_hi GROUP BY h.chrom, bp_lo, bp_hi)
  SELECT chrom, bp_lo, bp_hi, CAST(n AS BIGINT) AS n_split FROM ws WHERE n >= 2""")
def _(spark, sf):
    ev = evidence_of(spark, sf)
    zero, text = F.lit(0).cast("bigint"), F.lit("x")
    ready = ev.select("chrom", "lo", "hi", F.lit(2).alias("level"), zero.alias("clip_left"), zero.alias("clip_right"),
                      F.lit("split").alias("kind"), text.alias("member"), F.lit("Del+").alias("mtype"))
    bps, _ = B.merge_breakpoints(ready, CFG)
    return bps.select("chrom", "bp_lo", "bp_hi", "n_split")


BLOCKS = EVI + GAPS + ", h_in AS (SELECT DISTINCT chrom, lo, hi FROM bp WHERE lo > 0)" + _isl("h_in", "h") + """,
  ends AS (SELECT chrom, bp_lo, bp_hi FROM h WHERE bp_hi <= 200100 UNION ALL SELECT DISTINCT chrom, 200100, 200100 FROM h),
  bk AS (SELECT chrom, coalesce(lag(bp_hi) OVER (PARTITION BY chrom ORDER BY bp_lo), 0) AS lo, bp_lo AS hi FROM ends),
  ge AS (SELECT chrom, lo AS pos, 0 AS b, 1 AS g FROM gaps UNION ALL SELECT chrom, hi, 0, -1 FROM gaps
         UNION ALL SELECT chrom, lo, 1, 0 FROM bk WHERE hi > lo UNION ALL SELECT chrom, hi, -1, 0 FROM bk WHERE hi > lo),
  dn AS (SELECT chrom, pos, sum(b) AS b, sum(g) AS g FROM ge GROUP BY chrom, pos),
  sg AS (SELECT chrom, pos, lead(pos) OVER w AS stop, sum(b) OVER w AS db, sum(g) OVER w AS dg FROM dn WINDOW w AS (PARTITION BY chrom ORDER BY pos)),
  bl AS (SELECT chrom, pos AS lo, stop AS hi, row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1 AS idx FROM sg WHERE stop IS NOT NULL AND db > 0 AND dg = 0
         AND chrom IN (SELECT chrom FROM bk)) """


def blocks_of(spark, sf):
    hulls = O.island_spans(evidence_of(spark, sf).where("lo > 0"), ["chrom"], "lo", "hi").select(
        "chrom", F.col("lo").alias("bp_lo"), F.col("hi").alias("bp_hi"))
    hulls = saved(hulls)
    regions = hulls.select("chrom").distinct().select("chrom", F.lit(0).cast("bigint").alias("lo"), F.lit(200100).cast("bigint").alias("hi"))
    return G.create_blocks(hulls, gaps_of(spark, sf), regions)


@query("blocks_minus_gaps", BLOCKS + "SELECT chrom, idx, lo, hi FROM bl")
def _(spark, sf):
    return blocks_of(spark, sf).select("chrom", *big("idx", "lo", "hi"))


@query("point_to_block", BLOCKS + """SELECT chrom, idx, CAST(count(*) AS BIGINT) AS n FROM (SELECT b.chrom, b.idx FROM iv JOIN bl b
    ON iv.chrom = b.chrom AND iv.hi >= b.lo AND iv.hi < b.hi) GROUP BY chrom, idx""")
def _(spark, sf):
    blocks = blocks_of(spark, sf).select("chrom", "idx", F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    hit = I.point_join(intervals_of(spark, sf).select("chrom", "hi"), blocks, ["chrom"], "hi", ("b_lo", "b_hi"))
    return hit.groupBy("chrom", "idx").agg(F.count(F.lit(1)).alias("n")).select("chrom", *big("idx"), "n")


# --- adjacency graph over orders -------------------------------------------------------------------------

# 300 orders make a contig of 40 blocks: an edge joins a block side to a nearby block side
EDGES = """WITH st AS (SELECT 'g' || (o_orderkey // 300) AS chrom, 2 * (o_orderkey % 40) + 1 AS a,
    CASE WHEN o_custkey % 11 = 0 THEN 2 * LEAST(39, o_orderkey % 40 + 3) WHEN o_custkey % 13 = 0 THEN 2 * (o_orderkey % 40) ELSE 2 * LEAST(39, o_orderkey % 40 + 1) END AS b FROM orders),
  ed AS (SELECT chrom, LEAST(a, b) AS v1, GREATEST(a, b) AS v2, count(*) AS n FROM st GROUP BY chrom, LEAST(a, b), GREATEST(a, b)),
  rf AS (SELECT chrom, 2 * k + 1 AS v1, 2 * k + 2 AS v2, 9999 AS n FROM (SELECT DISTINCT chrom FROM st), (SELECT unnest(generate_series(0, 38)) AS k)),
  es AS (SELECT chrom, v1, v2, CAST(sum(n) AS BIGINT) AS support FROM (SELECT * FROM ed UNION ALL SELECT * FROM rf) GROUP BY chrom, v1, v2) """


def graph_of(spark, sf):
    k = F.col("o_orderkey") % 40
    b = (F.when(F.col("o_custkey") % 11 == 0, 2 * F.least(F.lit(39), k + 3)).when(F.col("o_custkey") % 13 == 0, 2 * k)
         .otherwise(2 * F.least(F.lit(39), k + 1)))
    obs = table(spark, sf, "orders").select(
        F.concat(F.lit("g"), F.expr("o_orderkey div 300").cast("string")).alias("chrom"),
        F.array(F.struct((2 * k + 1).cast("int").alias("a"), b.cast("int").alias("b"))).alias("support"))
    blocks = obs.select("chrom").distinct().select("chrom", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("idx"))
    blocks = blocks.withColumn("seg", F.when(F.col("idx") < 20, 0).otherwise(1)).withColumn(
        "lo", (F.col("idx") * 1000).cast("bigint")).withColumn("hi", (F.col("idx") * 1000 + 990).cast("bigint"))
    return G.edge_support(obs, blocks), blocks


@query("edge_support", EDGES + "SELECT chrom, v1, v2, support FROM es")
def _(spark, sf):
    return graph_of(spark, sf)[0].select("chrom", *big("v1", "v2"), "support")


NB = EDGES + """, nb AS (SELECT chrom, v1 AS node, v2 AS neighbor FROM es WHERE support >= 2 UNION ALL SELECT chrom, v2, v1 FROM es WHERE support >= 2 AND v1 <> v2)"""


@query("supported_neighbors", NB + " SELECT chrom, node, CAST(count(*) AS BIGINT) AS degree, CAST(sum(neighbor) AS BIGINT) AS total FROM nb GROUP BY chrom, node")
def _(spark, sf):
    return G.neighbors(graph_of(spark, sf)[0], 2).groupBy("chrom", "node").agg(
        F.count(F.lit(1)).alias("degree"), F.sum("neighbor").alias("total")).select("chrom", *big("node"), "degree", "total")


CUTS = NB + """, hr AS (SELECT *, node // 2 AS idx, CASE WHEN node // 2 < 20 THEN 0 ELSE 1 END AS seg FROM nb),
  inr AS (SELECT * FROM hr WHERE idx > seg * 20 AND idx < seg * 20 + 19 AND neighbor BETWEEN 40 * seg AND 40 * seg + 39),
  wr AS (SELECT DISTINCT chrom, idx FROM inr WHERE (node % 2 = 0 AND neighbor >= node) OR (node % 2 = 1 AND neighbor <= node)),
  jm AS (SELECT chrom, CASE WHEN neighbor > 2 * idx + 3 THEN idx + 1 ELSE neighbor // 2 + 1 END AS lo, CASE WHEN neighbor > 2 * idx + 3 THEN neighbor // 2 ELSE idx END AS hi
         FROM inr WHERE neighbor > 2 * idx + 3 OR neighbor < 2 * idx - 2),
  al AS (SELECT chrom, k AS idx, CASE WHEN k < 20 THEN 0 ELSE 1 END AS seg FROM (SELECT DISTINCT chrom FROM st), (SELECT unnest(generate_series(0, 39)) AS k)),
  ct AS (SELECT * FROM al WHERE NOT EXISTS (SELECT 1 FROM wr WHERE wr.chrom = al.chrom AND wr.idx = al.idx)
         AND NOT EXISTS (SELECT 1 FROM jm WHERE jm.chrom = al.chrom AND al.idx >= jm.lo AND al.idx < jm.hi))"""


@query("decompose_cutpoints", CUTS + " SELECT chrom, CAST(seg AS BIGINT) AS seg, idx FROM ct")
def _(spark, sf):
    edges, blocks = graph_of(spark, sf)
    return G.cut_points(checkpoint(edges), blocks, 2).select("chrom", *big("seg", "idx"))


@query("decompose_subgraphs", CUTS + """, rn AS (SELECT *, idx - row_number() OVER (PARTITION BY chrom, seg ORDER BY idx) AS k FROM ct),
  ru AS (SELECT chrom, seg, min(idx) AS lo, max(idx) AS hi FROM rn GROUP BY chrom, seg, k),
  pv AS (SELECT chrom, seg, lag(hi) OVER (PARTITION BY chrom, seg ORDER BY lo) AS start, lo AS stop FROM ru)
  SELECT chrom, CAST(seg AS BIGINT) AS seg, start, stop FROM pv WHERE start IS NOT NULL""")
def _(spark, sf):
    edges, blocks = graph_of(spark, sf)
    return G.decompose(checkpoint(edges), blocks, 2).select("chrom", *big("seg", "start"), F.col("end").cast("bigint").alias("stop"))


# each block is 990 bases of 1,000, so widening by 500 leaves the subgraphs as they are
SUBS = CUTS + """, rn AS (SELECT *, idx - row_number() OVER (PARTITION BY chrom, seg ORDER BY idx) AS k FROM ct),
  ru AS (SELECT chrom, seg, min(idx) AS lo, max(idx) AS hi FROM rn GROUP BY chrom, seg, k),
  su AS (SELECT * FROM (SELECT chrom, seg, lag(hi) OVER (PARTITION BY chrom, seg ORDER BY lo) AS s, lo AS e FROM ru) WHERE s IS NOT NULL),
  bk AS (SELECT chrom, node AS a, neighbor AS b, list_filter([CASE WHEN (node % 2 = 1 AND neighbor <= node) OR (node % 2 = 0 AND node <= neighbor) THEN node END,
      CASE WHEN (neighbor % 2 = 1 AND node <= neighbor) OR (neighbor % 2 = 0 AND neighbor <= node) THEN neighbor END], lambda x: x IS NOT NULL) AS back FROM nb),
  wk AS (SELECT chrom, s, e, [2 * s] AS entries, CAST([] AS BIGINT[]) AS back, 2 * s + 1 AS out FROM su UNION ALL
    SELECT w.chrom, w.s, w.e, list_append(w.entries, k.b), list_concat(w.back, k.back), xor(k.b, 1) FROM wk w JOIN bk k ON k.chrom = w.chrom AND k.a = w.out AND k.b BETWEEN 2 * w.s AND 2 * w.e + 1
      AND len(list_filter(k.back, lambda u: len(list_filter(w.back, lambda x: x = u)) >= 2)) = 0)"""


@query("path_enumeration", SUBS + """ SELECT chrom, s AS start, e AS stop, row_number() OVER (PARTITION BY chrom, s, e ORDER BY list_transform(entries, lambda x: -x)) - 1 AS path_id,
    count(*) OVER (PARTITION BY chrom, s, e) AS n_paths, array_to_string(list_transform(entries, lambda x: x || '-' || xor(x, 1)), ',') AS path FROM wk WHERE out = 2 * e + 1""", recursive=True)
def _(spark, sf):
    edges, blocks = graph_of(spark, sf)
    edges = checkpoint(edges)
    subs = checkpoint(G.expand_subgraphs(G.decompose(edges, blocks, 2), blocks, 500.0))
    n = blocks.groupBy("chrom").agg((F.max("idx") + 1).alias("n_genome"))
    _, paths = N.enumerate_paths(subs, edges, n, CFG)
    text = F.transform(F.filter("path", lambda x, i: i % 2 == 0), lambda x: F.concat_ws("-", x, x.bitwiseXOR(1)))
    return paths.select("chrom", *big("start"), F.col("end").cast("bigint").alias("stop"), *big("path_id"), "n_paths", F.array_join(text, ",").alias("path"))


# --- likelihoods over lineitem ------------------------------------------------------------------------------

# subgraph = supplier, path = line number 0..3, signature = part
LIK = """WITH lk AS (SELECT l_suppkey AS sub, l_linenumber % 4 AS path_id, l_partkey AS sig, max(l_tax + 0.01) AS l FROM lineitem GROUP BY l_suppkey, l_linenumber % 4, l_partkey),
  ct AS (SELECT sub, sig, 1 + sig % 3 AS cnt, path_id, l FROM lk), nn AS (SELECT sub, sum(cnt) AS n FROM (SELECT DISTINCT sub, sig, cnt FROM ct) GROUP BY sub),
  pa AS (SELECT s_suppkey AS sub, k AS path_id, 100.0 + 10 * k + s_suppkey % 5 AS nc FROM supplier, (SELECT unnest([0, 1, 2, 3]) AS k)),
  gn AS (SELECT sub, path_id, sum(cnt * (ln(0.001 + 0.999 * l) - ln(0.001))) AS g FROM ct GROUP BY sub, path_id),
  hm AS (SELECT pa.sub, pa.path_id, -n * ln(nc + 1e-10) + n * ln(0.001) + coalesce(g, 0) AS hom FROM pa JOIN nn USING (sub) LEFT JOIN gn USING (sub, path_id)),
  mx AS (SELECT sub, path_id, sig, cnt, sum(w) AS w FROM (SELECT sub, path_id, sig, cnt, 0.5 * l AS w FROM ct
         UNION ALL SELECT pa.sub, pa.path_id, ct.sig, ct.cnt, 0.5 * ct.l FROM pa JOIN ct ON pa.sub = ct.sub AND ct.path_id = 0) GROUP BY sub, path_id, sig, cnt),
  gh AS (SELECT sub, path_id, sum(cnt * (ln(0.001 + 0.999 * w) - ln(0.001))) AS g FROM mx GROUP BY sub, path_id),
  ht AS (SELECT pa.sub, pa.path_id, -n * ln(0.5 * nc + 0.5 * (100.0 + pa.sub % 5) + 2e-10) + n * ln(0.001) + coalesce(g, 0) AS het FROM pa JOIN nn USING (sub) LEFT JOIN gh USING (sub, path_id)) """


def likelihood_of(spark, sf):
    # dealt by signature: few lines share one, so little could be combined ahead of the shuffle
    lines = spread_rows(table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("sub"), (F.col("l_linenumber") % 4).alias("path_id"), F.col("l_partkey").alias("sig"), "l_tax"), "sub", "sig")
    lik = lines.groupBy("sub", "path_id", "sig").agg(F.max(F.col("l_tax") + 0.01).alias("l")).withColumn("cnt", 1 + F.col("sig") % 3)
    paths = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sub"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("path_id"))
    constants = paths.withColumn("lib", F.lit("lib1")).withColumn("nc", 100.0 + 10 * F.col("path_id") + F.col("sub") % 5)
    counts = lik.select("sub", "sig", "cnt").distinct().groupBy("sub").agg(F.sum("cnt").alias("n")).withColumn("lib", F.lit("lib1"))
    ref = paths.select("sub", F.lit(0).alias("ref_id")).distinct()
    return lik, paths, counts, constants, ref


@query("haploid_loglik", LIK + "SELECT sub, CAST(path_id AS BIGINT) AS path_id, round(hom, 4) AS hom FROM hm")
def _(spark, sf):
    lik, paths, counts, constants, _ = likelihood_of(spark, sf)
    return N.haploid_loglik(lik, paths, counts, constants, 0.001).select("sub", *big("path_id"), F.round("hom", 4).alias("hom"))


@query("diploid_loglik", LIK + "SELECT sub, CAST(path_id AS BIGINT) AS path_id, round(het, 4) AS het FROM ht")
def _(spark, sf):
    lik, paths, counts, constants, ref = likelihood_of(spark, sf)
    return N.against_reference(lik, paths, counts, constants, ref, 0.001).select("sub", *big("path_id"), F.round("het", 4).alias("het"))


@query("topk_paths", LIK + """, bs AS (SELECT sub, path_id, max(s) AS s FROM (SELECT sub, path_id, hom AS s FROM hm UNION ALL SELECT sub, path_id, het FROM ht WHERE path_id <> 0) GROUP BY sub, path_id),
  rk AS (SELECT *, row_number() OVER (PARTITION BY sub ORDER BY s DESC) AS k FROM bs) SELECT sub, CAST(path_id AS BIGINT) AS path_id, CAST(LEAST(k, 3) AS BIGINT) AS rank FROM rk WHERE k <= 2 OR path_id = 0""")
def _(spark, sf):
    lik, paths, counts, constants, ref = likelihood_of(spark, sf)
    top = N.top_paths(N.haploid_loglik(lik, paths, counts, constants, 0.001),
                      N.against_reference(lik, paths, counts, constants, ref, 0.001), ref, 2)
    return top.select("sub", *big("path_id", "rank"))


@query("informative_reads", LIK + "SELECT sub, sig FROM ct GROUP BY sub, sig HAVING count(*) < 4 OR min(l) <> max(l)")
def _(spark, sf):
    lik, paths, *_ = likelihood_of(spark, sf)
    return N.informative(lik, paths.groupBy("sub").agg(F.count(F.lit(1)).alias("n_paths")))


GT = LIK + """, sg AS (SELECT sub, sig, max(cnt) AS cnt FROM ct GROUP BY sub, sig HAVING count(*) < 4 OR min(l) <> max(l)),
  mt AS (SELECT sg.sub, sg.sig, sg.cnt, pa.path_id, coalesce(ct.l, 0) AS l, nc FROM sg JOIN pa USING (sub) LEFT JOIN ct ON ct.sub = sg.sub AND ct.sig = sg.sig AND ct.path_id = pa.path_id),
  gt AS (SELECT a.sub, a.path_id AS id1, b.path_id AS id2, -any_value(nn.n) * ln(CASE WHEN a.path_id = b.path_id THEN any_value(a.nc) ELSE 0.5 * any_value(a.nc) + 0.5 * any_value(b.nc) END + 2e-10)
         + sum(a.cnt * ln(0.001 + 0.999 * (0.5 * a.l + 0.5 * b.l))) AS lh FROM mt a JOIN mt b ON a.sub = b.sub AND a.sig = b.sig AND a.path_id >= b.path_id JOIN nn ON nn.sub = a.sub GROUP BY a.sub, a.path_id, b.path_id),
  rk AS (SELECT *, row_number() OVER (PARTITION BY sub ORDER BY lh DESC) AS k FROM gt) """


@query("best_genotype_top2", GT + """SELECT sub, CAST(max(id1) FILTER (WHERE k = 1) AS BIGINT) AS id1, CAST(max(id2) FILTER (WHERE k = 1) AS BIGINT) AS id2,
  round(max(lh) FILTER (WHERE k = 1), 3) AS best_lh, round(max(lh) FILTER (WHERE k = 2), 3) AS next_lh FROM rk GROUP BY sub""")
def _(spark, sf):
    lik, paths, counts, constants, ref = likelihood_of(spark, sf)
    info = paths.select("sub", "path_id", F.array(F.lit(0), F.lit(1)).alias("path"), F.lit("c").alias("chrom"), F.lit(0).alias("start"),
                        F.lit(1).alias("end"), F.lit(2).alias("n_genome"), F.lit(0).alias("extra"), F.lit(4).alias("n_paths"))
    out = N.genotypes(info, checkpoint(lik), counts, constants, ref, CFG.with_options(top_paths=None), 0.001)
    return out.select("sub", *big("id1", "id2"), F.round("best_lh", 3).alias("best_lh"), F.round("next_lh", 3).alias("next_lh"))


# --- text and path functions --------------------------------------------------------------------------------

@query("reverse_complement", """SELECT doc_id, translate(reverse(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'ATCGNRYWSMKBVDHatcgnrywsmkbvdh', 'TAGCNYRWSKMVBHDtagcnyrwskmvbhd') AS seq FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", A.reverse_complement(F.regexp_replace("text", "[^A-Za-z]", "")).alias("seq"))


CIG = """WITH c AS (SELECT DISTINCT l_linenumber AS a, l_partkey % 30 + 1 AS b, l_suppkey % 7 + 1 AS d, l_orderkey % 1000 AS pos FROM lineitem) """


@query("cigar_parse", CIG + """SELECT a, b, d, pos, b + 40 + d AS ref_len, a + b + 3 + 40 + 6 AS query_len, a AS clip_l, 6 AS clip_r, a + 1 AS q_start, a + b + 43 AS q_end, 7 AS r_start,
    pos || '-' || (pos + b) || ',' || (pos + b + d) || '-' || (pos + b + d + 40) AS blocks, a || ',3,6' AS gaps FROM c""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_linenumber").cast("bigint").alias("a"), (F.col("l_partkey") % 30 + 1).alias("b"), (F.col("l_suppkey") % 7 + 1).alias("d"),
        (F.col("l_orderkey") % 1000).alias("pos")).distinct()
    li = li.withColumn("ops", A.cigar_ops(F.format_string("%dS%dM3I%dD40M6S", "a", "b", "d")))
    ops = F.col("ops")
    li = li.withColumn("mb", A.match_blocks(ops, F.col("pos"))).withColumn("qc", A.query_coords(ops, F.lit(False)))
    text = F.array_join(F.transform("mb.blocks", lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    return li.select("a", "b", "d", "pos", A.reference_length(ops).cast("bigint").alias("ref_len"), A.query_length(ops).cast("bigint").alias("query_len"),
                     A.clip_left(ops).cast("bigint").alias("clip_l"), A.clip_right(ops).cast("bigint").alias("clip_r"),
                     F.col("qc.start").cast("bigint").alias("q_start"), F.col("qc.end").cast("bigint").alias("q_end"),
                     A.query_coords(ops, F.lit(True))["start"].cast("bigint").alias("r_start"), text.alias("blocks"),
                     F.array_join("mb.gaps", ",").alias("gaps"))


@query("md_tokenize", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, a || ' A ' || b || ' ^' || del || ' 5 G' AS tokens, a || ',' || (a + b + 6) AS mismatches
    FROM (SELECT *, 1 + l_partkey % 97 AS a, 1 + l_suppkey % 89 AS b, substr('ACGTACGT', CAST(l_orderkey % 4 + 1 AS BIGINT), CAST(l_linenumber AS BIGINT)) AS del FROM lineitem)""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (1 + F.col("l_partkey") % 97).alias("a"), (1 + F.col("l_suppkey") % 89).alias("b"),
                                             F.expr("substr('ACGTACGT', cast(l_orderkey % 4 + 1 as int), l_linenumber)").alias("del"))
    md = F.format_string("%dA%d^%s5G0", "a", "b", "del")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(A.md_tokens(md), " ").alias("tokens"),
                     F.array_join(A.md_mismatch_offsets(md), ",").alias("mismatches"))


def block_name_sql(k: str) -> str:
    return (f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', CAST(({k}) % 52 + 1 AS BIGINT), 1) || "
            f"CASE WHEN {k} >= 52 THEN CAST(({k}) // 52 AS VARCHAR) ELSE '' END")


@query("block_names", f"SELECT o_orderkey AS k, {block_name_sql('o_orderkey')} AS name, o_orderkey AS back FROM orders")
def _(spark, sf):
    k = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    k = k.withColumn("name", P.block_name(F.col("k")))
    return k.select("k", "name", P.block_index(F.col("name")).cast("bigint").alias("back"))


@query("path_strings", f"""SELECT k, {block_name_sql('k')} || {block_name_sql('k + 1')} || '''' || {block_name_sql('k + 2')} || '_' AS path,
    k * 2 || ',' || (k * 2 + 3) || ',' || (k * 2 + 4) || ',2000000000,2000000000' AS entries FROM (SELECT o_orderkey AS k FROM orders)""")
def _(spark, sf):
    k = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    n, novel = F.col("k").cast("int") * 2, 2_000_000_000
    path = F.array(n, n + 1, n + 3, n + 2, n + 4, n + 5, F.lit(novel), F.lit(novel + 1))
    return k.select("k", P.path_to_string(path, F.lit(0), F.lit(novel // 2)).alias("path"), F.array_join(P.path_to_block_path(path), ",").alias("entries"))


@query("read_adjacencies", """SELECT event_id, 2 * b + 1 AS s0, (2 * b + 1) || ',' || (2 * b + 2) || ',' || (2 * b + 3) || ',' || (2 * b + 6) AS adj, (2 * b + 1) || '-' || (2 * b + 2) || ',' || (2 * b + 3) || '-' || (2 * b + 6) AS steps
    FROM (SELECT event_id, user_id AS b FROM events)""")
def _(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.col("user_id").cast("int").alias("b"))
    nodes = F.array(2 * F.col("b") + 1, 2 * F.col("b") + 3, 2 * F.col("b") + 7)
    steps = F.transform(P.node_adjacencies(nodes), lambda s: F.concat_ws("-", s["a"], s["b"]))
    return ev.select("event_id", (2 * F.col("b") + 1).cast("bigint").alias("s0"), F.array_join(P.node_sequence_to_path(nodes), ",").alias("adj"),
                     F.array_join(steps, ",").alias("steps"))


# --- events of haplotypes -------------------------------------------------------------------------------------

HAPS = {"DEL": [0, 1, 4, 5, 6, 7], "INV": [0, 1, 3, 2, 4, 5, 6, 7], "DUP:TANDEM": [0, 1, 2, 3, 2, 3, 4, 5, 6, 7], "BND": [0, 1, 4, 5, 2, 3, 4, 5, 6, 7]}


@query("classify_path", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'DEL' WHEN 1 THEN 'INV' WHEN 2 THEN 'DUP:TANDEM' ELSE 'BND,BND' END AS types,
    CASE o_orderkey % 4 WHEN 0 THEN 'AC' WHEN 1 THEN 'AB''C' WHEN 2 THEN 'ABBC' ELSE 'ACBCD' END AS rearrangement,
    CASE o_orderkey % 4 WHEN 3 THEN 100 ELSE 100 + o_custkey % 50 END AS affected FROM orders""")
def _(spark, sf):
    from strandloom.plans import classify as C
    o = spread_groups(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    arr = lambda xs: F.array(*[F.lit(x) for x in xs])
    names = list(HAPS)
    path = F.when(F.col("o_orderkey") % 4 == 0, arr(HAPS[names[0]])).when(F.col("o_orderkey") % 4 == 1, arr(HAPS[names[1]])).when(
        F.col("o_orderkey") % 4 == 2, arr(HAPS[names[2]])).otherwise(arr(HAPS[names[3]]))
    w = 100 + F.col("o_custkey") % 50
    cuts = [F.lit(0).cast("bigint"), F.lit(1000).cast("bigint"), 1000 + w, 1100 + w, 2100 + w]
    blk = lambda i: F.struct(F.lit(i).alias("idx"), cuts[i].alias("lo"), cuts[i + 1].alias("hi"), F.lit(0).alias("gap_left"), F.lit(0).alias("gap_right"),
                             F.lit(False).alias("novel"), cuts[i].alias("ll"), cuts[i].alias("lh"), cuts[i + 1].alias("rl"), cuts[i + 1].alias("rh"))
    c = o.withColumn("c", C.describe_udf(CFG)(path, path, F.array(*[blk(i) for i in range(4)]), F.lit(4), F.lit("x")))
    return c.select("o_orderkey", F.array_join(F.transform("c.events", lambda e: e["type"]), ",").alias("types"),
                    P.path_to_string(F.col("c.hap1.path"), F.lit(0), F.lit(99)).alias("rearrangement"), F.col("c.hap1.affected").alias("affected"))


# every form, from both sides, with and without a novel block
@query("complex_types", """SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'other' ELSE ['inv.del', 'inv.2del', 'trans', 'trans.inv', 'ddup', 'invddup', 'ddup.del', 'invddup.del',
    'invddup.inv', 'invddup.del.inv', 'dup.del', 'invdup', 'dup.dup', 'other'][o_orderkey % 14 + 1] END AS complextype FROM orders""")
def _(spark, sf):
    forms = [*P.COMPLEX_TYPES.values(), (0, 1, 2, 3)]
    path = F.element_at(F.array(*[F.array(*[F.lit(x) for x in form]) for form in forms]), (F.col("o_orderkey") % 14 + 1).cast("int"))
    seen = F.when(F.col("o_custkey") % 2 == 0, P.reverse_path(path)).otherwise(path)
    return table(spark, sf, "orders").select("o_orderkey", P.complex_type(seen, F.col("o_custkey") % 5 == 0).alias("complextype"))


# --- call tables ------------------------------------------------------------------------------------------------

CALLS = """WITH calls AS (SELECT CASE WHEN l_suppkey % 24 < 22 THEN CAST(l_suppkey % 24 + 1 AS VARCHAR) ELSE 'X' END AS chrom, l_partkey * 10 AS minbp,
    l_partkey * 10 + CAST(l_quantity AS BIGINT) AS maxbp, l_orderkey || '-' || l_linenumber || CASE WHEN l_linenumber = 5 THEN '_1' ELSE '' END AS id,
    CASE l_linenumber WHEN 1 THEN 'DEL' WHEN 2 THEN 'INV' WHEN 3 THEN 'DUP' WHEN 4 THEN 'INS' ELSE 'BND,BND' END AS svtype,
    CASE WHEN l_partkey % 9 = 0 THEN 'AB_C' ELSE 'ABC' END AS rearrangement, CAST(l_quantity * 2 AS BIGINT) AS len_affected,
    l_partkey % 7 AS s1, l_suppkey % 6 AS s2, l_orderkey % 5 AS p1, l_discount * 10 AS af FROM lineitem) """


def calls_of(spark, sf):
    n, s = F.col("l_linenumber"), lambda c: c.cast("string")
    kind = F.when(n == 1, "DEL").when(n == 2, "INV").when(n == 3, "DUP").when(n == 4, "INS").otherwise("BND,BND")
    return table(spark, sf, "lineitem").select(
        F.when(F.col("l_suppkey") % 24 < 22, s(F.col("l_suppkey") % 24 + 1)).otherwise("X").alias("chrom"), (F.col("l_partkey") * 10).alias("minbp"),
        (F.col("l_partkey") * 10 + F.col("l_quantity").cast("bigint")).alias("maxbp"),
        F.concat(s(F.col("l_orderkey")), F.lit("-"), s(n), F.when(n == 5, "_1").otherwise("")).alias("id"), kind.alias("svtype"),
        F.when(F.col("l_partkey") % 9 == 0, "AB_C").otherwise("ABC").alias("rearrangement"), (F.col("l_quantity") * 2).cast("bigint").alias("len_affected"),
        F.concat_ws(",", s(F.col("l_partkey") % 7), s(F.col("l_suppkey") % 6)).alias("sr_support"), s(F.col("l_orderkey") % 5).alias("pe_support"),
        (F.col("l_discount") * 10).alias("af"))


@query("filter_merge", CALLS + """SELECT chrom, minbp, maxbp, id, svtype FROM calls WHERE maxbp - minbp >= 10 AND len_affected >= 30 AND LEAST(s1, s2) >= 1 AND GREATEST(s1, s2) <= 5
    AND p1 >= 1 AND af BETWEEN 0.1 AND 0.9 AND svtype NOT IN ('INV', 'INS') AND rearrangement <> 'AB_C' AND id NOT LIKE '%\\_1' ESCAPE '\\'""")
def _(spark, sf):
    opts = M.FilterOptions(min_span=10, min_size=30, min_sr_support=1, max_sr_support=5, min_pe_support=1, min_allele_fraction=0.1,
                           max_allele_fraction=0.9, exclude=("inversions", "insertions", "compoundhet"))
    return M.sort_calls(M.filter_calls(calls_of(spark, sf), opts)).select("chrom", "minbp", "maxbp", "id", "svtype")


@query("filter_no_simple", CALLS + "SELECT chrom, id FROM calls WHERE svtype = 'BND,BND' AND rearrangement <> 'AB_C'")
def _(spark, sf):
    return M.filter_calls(calls_of(spark, sf), M.FilterOptions(exclude=("simple",))).select("chrom", "id")


@query("event_filters", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 4 OR (l_linenumber > 4 AND l_suppkey % 3 > 0) THEN 'INSERTION' ELSE 'PASS' END AS filter,
    l_partkey + CAST(floor(l_linenumber / 2) AS BIGINT) AS point, l_linenumber - 2 AS width FROM lineitem""")
def _(spark, sf):
    from strandloom.plans import classify as C
    li = table(spark, sf, "lineitem")
    kind = F.when(F.col("l_linenumber") == 4, "INS").when(F.col("l_linenumber") > 4, "BND").otherwise("DEL")
    lo, hi = F.col("l_partkey"), F.col("l_partkey") + F.col("l_linenumber")
    return li.select("l_orderkey", *big("l_linenumber"), "l_partkey", C.event_filter(kind, F.col("l_suppkey") % 3, ("INSERTION",)).alias("filter"),
                     C.bp_point(lo, hi).cast("bigint").alias("point"), C.bp_width(lo, hi).cast("bigint").alias("width"))


@query("breakend_alt", """SELECT DISTINCT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'N]c:' || o_custkey || ']' WHEN 1 THEN 'N[c:' || o_custkey || '['
    WHEN 2 THEN ']c:' || o_custkey || ']N' ELSE '[c:' || o_custkey || '[N' END AS alt FROM orders""")
def _(spark, sf):
    from strandloom.plans.vcf_out import bnd_alt
    k = F.col("o_orderkey") % 4
    return table(spark, sf, "orders").select("o_orderkey", bnd_alt(
        F.when(k < 2, "-").otherwise("+"), F.when(k % 2 == 0, "-").otherwise("+"), F.lit("c"), F.col("o_custkey"), F.lit("N")).alias("alt"))
