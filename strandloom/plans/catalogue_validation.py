"""Registered queries of the validation of altered haplotypes."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.plans import validation as V
from strandloom.plans.catalogue import big, query
from strandloom.plans.derived import table
from strandloom.session import spread_rows

PART = ["qname", "strand", "cluster"]

# eight orders make a haplotype, their lines its segments; one line in seven lies off the diagonal
SEGMENTS = """WITH RECURSIVE li AS (SELECT l_orderkey // 8 AS qname, CASE WHEN l_partkey % 3 = 0 THEN '-' ELSE '+' END AS strand, (l_partkey * 13) % 5000 AS q0,
    CASE WHEN l_partkey % 7 = 0 THEN (l_suppkey * 331) % 9000 ELSE (l_partkey * 13) % 5000 + (l_suppkey * 37) % 90 END AS r0,
    30 + CAST(l_quantity AS BIGINT) * 8 AS len, l_linenumber % 4 AS mm, l_suppkey % 2 AS ni, (l_suppkey % 2) * (1 + l_partkey % 5) AS nb FROM lineitem),
  sg AS (SELECT qname, strand, q0, r0, q0 * 10000 + r0 AS seg, max(len) AS len, CAST(max((len - mm - nb) - 9 * mm - 16 * ni - (nb - ni)) AS BIGINT) AS score FROM li GROUP BY qname, strand, q0, r0),
  sb AS (SELECT *, q0 + len AS q1, r0 + len AS r1, max(r0 + len) OVER (PARTITION BY qname, strand ORDER BY r0, seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM sg),
  sc AS (SELECT *, max(CASE WHEN far IS NULL OR r0 - far > 250 THEN r0 END) OVER (PARTITION BY qname, strand ORDER BY r0, seg) AS cluster FROM sb)"""


def segments_of(spark, sf):
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    # dealt by haplotype and strand: few lines share a place, so little could be combined ahead of the shuffle
    li = spread_rows(table(spark, sf, "lineitem").select(
        F.expr("l_orderkey div 8").alias("qname"), F.when(part % 3 == 0, "-").otherwise("+").alias("strand"), ((part * 13) % 5000).alias("q0"),
        F.when(part % 7 == 0, (supp * 331) % 9000).otherwise((part * 13) % 5000 + (supp * 37) % 90).alias("r0"),
        (30 + F.col("l_quantity").cast("long") * 8).alias("len"), (F.col("l_linenumber") % 4).cast("long").alias("mm"),
        (supp % 2).alias("ni"), ((supp % 2) * (1 + part % 5)).alias("nb")), "qname", "strand")
    score = V.segment_score(F.col("len") - F.col("mm") - F.col("nb"), F.col("mm"), F.col("ni"), F.col("nb"))
    sg = li.withColumn("score", score).groupBy("qname", "strand", "q0", "r0").agg(F.max("len").alias("len"), F.max("score").alias("score"))
    return sg.withColumns({"seg": F.col("q0") * 10000 + F.col("r0"), "q1": F.col("q0") + F.col("len"), "r1": F.col("r0") + F.col("len")})


@query("segment_clusters", SEGMENTS + """ SELECT qname, strand, cluster, count(*) AS n, CAST(sum(len) AS BIGINT) AS bases, CAST(max(r1) AS BIGINT) AS last_end
    FROM sc GROUP BY qname, strand, cluster""")
def _(spark, sf):
    return V.segment_clusters(segments_of(spark, sf), ["qname", "strand"], 250).groupBy(*PART).agg(
        F.count(F.lit(1)).alias("n"), F.sum("len").alias("bases"), F.max("r1").alias("last_end"))


CHAINS = SEGMENTS + """,
  sk AS (SELECT *, row_number() OVER (PARTITION BY qname, strand, cluster ORDER BY q0, q1, r0, r1, seg) AS k FROM sc),
  dp AS (SELECT qname, strand, cluster, 0 AS k, CAST([] AS STRUCT(k BIGINT, seg BIGINT, q1 BIGINT, r1 BIGINT, c BIGINT, parent BIGINT)[]) AS st FROM (SELECT DISTINCT qname, strand, cluster FROM sk)
    UNION ALL SELECT qname, strand, cluster, k, list_append(st, {'k': k, 'seg': seg, 'q1': q1, 'r1': r1, 'c': CASE WHEN best.c > score THEN best.c ELSE score END,
      'parent': CASE WHEN best.c > score THEN best.seg ELSE seg END})
    FROM (SELECT s.*, d.st, list_max(list_transform(list_filter(d.st, lambda x: x.q1 <= s.q0 AND x.r1 <= s.r0), lambda x: {
        'c': x.c + s.score - CASE WHEN s.q0 > x.q1 THEN 15 + s.q0 - x.q1 ELSE 0 END - CASE WHEN s.r0 > x.r1 THEN 15 + s.r0 - x.r1 ELSE 0 END, 'first': -x.k, 'seg': x.seg})) AS best
      FROM dp d JOIN sk s ON s.qname = d.qname AND s.strand = d.strand AND s.cluster = d.cluster AND s.k = d.k + 1)),
  fin AS (SELECT qname, strand, cluster, unnest(st) AS x FROM (SELECT *, row_number() OVER (PARTITION BY qname, strand, cluster ORDER BY k DESC) AS last FROM dp) WHERE last = 1),
  cs AS (SELECT qname, strand, cluster, x.k AS k, x.seg AS seg, x.c AS chain, x.parent AS parent FROM fin)"""


@query("segment_chain_scores", CHAINS + " SELECT qname, strand, cluster, seg, parent, CAST(chain AS BIGINT) AS chain FROM cs")
def _(spark, sf):
    segments = V.segment_clusters(segments_of(spark, sf), ["qname", "strand"], 250)
    return V.chain_scores(segments, PART).select(*PART, "seg", "parent", "chain")


@query("best_segment_chains", CHAINS + """,
  en AS (SELECT *, row_number() OVER (PARTITION BY qname, strand, cluster ORDER BY chain DESC, k) AS best FROM cs),
  bt AS (SELECT qname, strand, cluster, CAST(0 AS BIGINT) AS step, seg, parent, chain FROM en WHERE best = 1 UNION ALL
    SELECT b.qname, b.strand, b.cluster, b.step + 1, c.seg, c.parent, c.chain FROM bt b JOIN cs c ON c.qname = b.qname AND c.strand = b.strand AND c.cluster = b.cluster AND c.seg = b.parent WHERE b.parent <> b.seg)
  SELECT qname, strand, cluster, step, seg, CAST(chain AS BIGINT) AS chain FROM bt""")
def _(spark, sf):
    segments = V.segment_clusters(segments_of(spark, sf), ["qname", "strand"], 250)
    return V.best_chains(V.chain_scores(segments, PART), PART).select(*PART, "step", "seg", "chain")


PIECES = """WITH pc AS (SELECT l_orderkey AS qname, l_partkey AS p, l_suppkey AS s, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS idx,
    50 + l_partkey % 400 AS length, CASE WHEN l_suppkey % 3 = 0 THEN 1 + l_partkey % 60 ELSE 0 END AS deleted FROM lineitem),
  pt AS (SELECT *, idx = 0 AS is_flank, sum(length) OVER (PARTITION BY qname) AS total, count(*) OVER (PARTITION BY qname) AS n_all, sum(length) OVER (PARTITION BY qname ORDER BY idx) AS q1 FROM pc)"""


def pieces_of(spark, sf):
    from pyspark.sql import Window
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = spread_rows(table(spark, sf, "lineitem"), "l_orderkey").withColumn("idx", (F.row_number().over(line) - 1).cast("long"))
    return rows.select(F.col("l_orderkey").alias("qname"), "idx", (50 + F.col("l_partkey") % 400).alias("length"), (F.col("idx") == 0).alias("is_flank"),
                       F.when(F.col("l_suppkey") % 3 == 0, 1 + F.col("l_partkey") % 60).otherwise(0).alias("deleted"))


@query("query_blocks", PIECES + """ SELECT qname, '+' AS strand, idx, CAST(q1 - length AS BIGINT) AS q0, CAST(q1 AS BIGINT) AS q1, is_flank FROM pt UNION ALL
    SELECT qname, '-', n_all - 1 - idx, CAST(total - q1 AS BIGINT), CAST(total - q1 + length AS BIGINT), is_flank FROM pt""")
def _(spark, sf):
    return V.query_blocks(pieces_of(spark, sf))


@query("deletion_positions", PIECES + """, dl AS (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY q1) - 1 AS k, count(*) OVER (PARTITION BY qname) AS nd FROM pt WHERE deleted > 0)
    SELECT qname, '+' AS strand, k AS idx, CAST(q1 AS BIGINT) AS pos, deleted AS length FROM dl UNION ALL SELECT qname, '-', nd - 1 - k, CAST(total - q1 AS BIGINT), deleted FROM dl""")
def _(spark, sf):
    return V.deletion_positions(pieces_of(spark, sf)).select("qname", "strand", "idx", *big("pos", "length"))


# one indel in the middle of two segments of three
SPLIT = SEGMENTS + """,
  sn AS (SELECT qname, strand, cluster, seg, q0, q1, r0, r1 - CASE WHEN seg % 3 = 1 THEN 7 ELSE 0 END + CASE WHEN seg % 3 = 2 THEN 5 ELSE 0 END AS r1, q0 + len // 2 AS ipos,
    CASE WHEN seg % 3 = 1 THEN 7 ELSE 0 END AS ins, CASE WHEN seg % 3 = 2 THEN 5 ELSE 0 END AS del, seg % 3 > 0 AS has FROM sc),
  qp AS (SELECT qname, strand, cluster, q0 AS p FROM sn UNION SELECT qname, strand, cluster, q1 FROM sn),
  rp AS (SELECT qname, strand, cluster, r0 AS p FROM sn UNION SELECT qname, strand, cluster, r1 FROM sn),
  rn AS (SELECT *, 0 AS run, q0 AS a, CASE WHEN has THEN ipos ELSE q1 END AS b, r0 - q0 AS d FROM sn UNION ALL SELECT *, 1, ipos + ins, q1, r0 - q0 - ins + del FROM sn WHERE has),
  ct AS (SELECT rn.qname, rn.strand, rn.cluster, rn.seg, run, p, d FROM rn JOIN qp USING (qname, strand, cluster) WHERE p > a AND p < b UNION
    SELECT rn.qname, rn.strand, rn.cluster, rn.seg, run, p - d, d FROM rn JOIN rp USING (qname, strand, cluster) WHERE p > a + d AND p < b + d),
  gs AS (SELECT sn.qname, sn.strand, sn.cluster, seg FROM sn JOIN qp USING (qname, strand, cluster) WHERE has AND p BETWEEN ipos AND ipos + ins AND p > q0 AND p < q1 UNION
    SELECT sn.qname, sn.strand, sn.cluster, seg FROM sn JOIN rp USING (qname, strand, cluster) WHERE has AND p BETWEEN ipos + r0 - q0 AND ipos + r0 - q0 + del AND p > r0 AND p < r1),
  mk AS (SELECT qname, strand, cluster, seg, run * 2 AS o, p AS lq, p + d AS lr, p AS rq, p + d AS rr FROM ct UNION ALL
    SELECT sn.qname, sn.strand, sn.cluster, sn.seg, 1, ipos, ipos + r0 - q0, ipos + ins, ipos + r0 - q0 + del FROM sn JOIN gs USING (qname, strand, cluster, seg) UNION ALL
    SELECT qname, strand, cluster, seg, 9, q1, r1, q1, r1 FROM sn),
  sp AS (SELECT *, lag(rq) OVER w AS pq, lag(rr) OVER w AS pr, row_number() OVER w - 1 AS sub FROM mk WINDOW w AS (PARTITION BY qname, strand, cluster, seg ORDER BY o, lq)),
  su AS (SELECT sp.qname, sp.strand, sp.cluster, sp.seg, sub, coalesce(pq, q0) AS q0, lq AS q1, coalesce(pr, r0) AS r0, lr AS r1, ipos, ins, del, has, gs.seg IS NOT NULL AS gone
    FROM sp JOIN sn USING (qname, strand, cluster, seg) LEFT JOIN gs USING (qname, strand, cluster, seg))"""


@query("split_segments", SPLIT + """ SELECT qname, strand, cluster, seg, sub, CAST(q0 AS BIGINT) AS q0, CAST(q1 AS BIGINT) AS q1, CAST(r0 AS BIGINT) AS r0, CAST(r1 AS BIGINT) AS r1,
    CASE WHEN has AND NOT gone AND ipos BETWEEN q0 AND q1 - ins THEN 1 ELSE 0 END AS n_indels,
    CASE WHEN has AND NOT gone AND ipos BETWEEN q0 AND q1 - ins THEN ins + del ELSE 0 END AS indel_bases FROM su WHERE q1 > q0 AND r1 > r0""")
def _(spark, sf):
    from strandloom.session import saved
    kind = F.col("seg") % 3
    inserted, deleted = F.when(kind == 1, 7).otherwise(0).cast("long"), F.when(kind == 2, 5).otherwise(0).cast("long")
    rows = V.segment_clusters(segments_of(spark, sf), ["qname", "strand"], 250)
    rows = saved(rows.withColumns({"inserted": inserted, "deleted": deleted, "at": F.expr("q0 + len div 2")}).withColumn("r1", F.col("r1") - F.col("inserted") + F.col("deleted")))
    indels = rows.where("seg % 3 > 0").select(*PART, "seg", "at", "inserted", "deleted")
    return V.split_segments(rows.select(*PART, "seg", "q0", "q1", "r0", "r1"), indels, None, None, PART).select(
        *PART, "seg", *big("sub"), "q0", "q1", "r0", "r1", *big("n_indels", "indel_bases"))


@query("query_block_positions", PIECES + """, ps AS (SELECT qname, '+' AS strand, (p * 7 + s) % CAST(total AS BIGINT) AS pos FROM pt UNION SELECT qname, '-', (p * 11 + s) % CAST(total AS BIGINT) FROM pt),
  bl AS (SELECT qname, '+' AS strand, idx, q1 - length AS q0, q1 FROM pt UNION ALL SELECT qname, '-', n_all - 1 - idx, total - q1, total - q1 + length FROM pt)
  SELECT ps.qname, ps.strand, ps.pos, bl.idx, CAST(ps.pos - bl.q0 AS BIGINT) AS "offset", ps.pos AS back FROM ps JOIN bl ON bl.qname = ps.qname AND bl.strand = ps.strand AND ps.pos >= bl.q0 AND ps.pos < bl.q1""")
def _(spark, sf):
    from pyspark.sql import Window
    pieces = pieces_of(spark, sf)
    blocks = V.query_blocks(pieces)
    line = spread_rows(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("qname"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")), "qname")
    total = F.sum(50 + F.col("p") % 400).over(Window.partitionBy("qname"))
    pos = lambda strand, k: line.select("qname", F.lit(strand).alias("strand"), ((F.col("p") * k + F.col("s")) % total).alias("pos"))
    found = V.block_positions(pos("+", 7).unionByName(pos("-", 11)).distinct(), blocks)
    back = V.query_positions(found.select("qname", "strand", "idx", "offset", F.col("pos").alias("was")), blocks)
    return back.select("qname", "strand", F.col("was").alias("pos"), "idx", "offset", F.col("pos").alias("back"))


# gaps anywhere along the query, some over all of its inner blocks
GAP_ERRORS = PIECES + """, dl AS (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY q1) - 1 AS k FROM pt WHERE deleted > 0),
  gp AS (SELECT DISTINCT qname, p * 100 + s AS g, CASE WHEN p % 2 = 0 THEN 'ref' ELSE 'query' END AS side, (p * 7) % CAST(total AS BIGINT) AS lo,
    CASE WHEN p % 2 = 0 THEN (p * 7) % CAST(total AS BIGINT) ELSE (p * 7) % CAST(total AS BIGINT) + 1 + s * 9 END AS hi, 1 + s * 9 AS error FROM pt),
  inr AS (SELECT qname, idx, q1 - length AS q0, q1, length, LEAST(length, 50) AS slop, idx = 1 AS fst, idx = n_all - 1 AS lst FROM pt WHERE NOT is_flank),
  ed AS (SELECT qname, min(q0) AS a, max(q1) AS b FROM inr GROUP BY qname),
  ev AS (SELECT qname, g, side, 0 AS piece, lo, hi, error FROM gp LEFT JOIN ed USING (qname) WHERE side = 'ref' OR a IS NULL OR (lo > a AND hi < b) UNION ALL
    SELECT qname, g, side, 0, lo, LEAST(a, hi), LEAST(a, hi) - lo FROM gp JOIN ed USING (qname) WHERE side = 'query' AND lo <= a UNION ALL
    SELECT qname, g, side, CASE WHEN lo <= a THEN 1 ELSE 0 END, GREATEST(b, lo), hi, hi - GREATEST(b, lo) FROM gp JOIN ed USING (qname) WHERE side = 'query' AND hi >= b),
  tg AS (SELECT qname, 'block' AS target, idx, length AS cap, 'ref' AS side, CASE WHEN fst THEN q0 - slop ELSE q0 END AS x, CASE WHEN lst THEN q1 + slop ELSE q1 END AS y FROM inr UNION ALL
    SELECT qname, 'block', idx, length, 'query', q0 - slop, q0 FROM inr WHERE fst UNION ALL SELECT qname, 'block', idx, length, 'query', q1, q1 + slop FROM inr WHERE lst UNION ALL
    SELECT qname, 'deletion', k, deleted, sd, q1 - LEAST(deleted, 50), q1 + LEAST(deleted, 50) FROM dl, (SELECT unnest(['ref', 'query']) AS sd)),
  al AS (SELECT ev.*, target, idx, error / cap AS share, row_number() OVER (PARTITION BY ev.qname, g, ev.side, piece ORDER BY error / cap DESC, target, idx) AS k
    FROM ev JOIN tg ON tg.qname = ev.qname AND tg.side = ev.side AND GREATEST(lo - y, x - hi, 0) <= 1 WHERE error > 0)"""


@query("gap_errors", GAP_ERRORS + """
  SELECT qname, g, side, CAST(piece AS BIGINT) AS piece, target, idx, round(CAST(share AS DOUBLE), 9) AS share, CAST(error AS BIGINT) AS bases FROM al WHERE k = 1""")
def _(spark, sf):
    return errors_of(spark, sf, pieces_of(spark, sf)).select("qname", "g", "side", *big("piece"), "target", "idx", F.round("share", 9).alias("share"), "bases")


def errors_of(spark, sf, pieces):
    from pyspark.sql import Window
    line = spread_rows(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("qname"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")), "qname")
    lo = (F.col("p") * 7) % F.sum(50 + F.col("p") % 400).over(Window.partitionBy("qname"))
    size = 1 + F.col("s") * 9
    gaps = line.select("qname", (F.col("p") * 100 + F.col("s")).alias("g"), F.when(F.col("p") % 2 == 0, "ref").otherwise("query").alias("side"), lo.alias("lo"),
                       (lo + F.when(F.col("p") % 2 == 0, 0).otherwise(size)).alias("hi"), size.alias("error")).distinct()
    forward = F.col("strand") == "+"
    return V.gap_errors(gaps, V.query_blocks(pieces).where(forward), V.deletion_positions(pieces).where(forward), ["qname"], "g")


SCORES = GAP_ERRORS + """,
  ls AS (SELECT qname, target, idx, sum(share) AS lost FROM al WHERE k = 1 GROUP BY qname, target, idx),
  bs AS (SELECT pt.qname, 'block' AS target, pt.idx, is_flank, (length - length % 3) / length AS gained FROM pt UNION ALL
    SELECT qname, 'deletion', k, false, CASE WHEN q1 >= 60 + 50 AND total - 40 >= q1 + 50 THEN 1.0 ELSE 0.0 END FROM dl),
  so AS (SELECT bs.qname, bs.target, bs.idx, is_flank, GREATEST(0.0, gained - coalesce(lost, 0.0)) AS score FROM bs LEFT JOIN ls ON ls.qname = bs.qname AND ls.target = bs.target AND ls.idx = bs.idx)"""


def scores_of(spark, sf):
    pieces = pieces_of(spark, sf)
    forward = F.col("strand") == "+"
    blocks, deletions = V.query_blocks(pieces).where(forward), V.deletion_positions(pieces).where(forward)
    matches = pieces.select("qname", "idx", (F.col("length") - F.col("length") % 3).alias("matches"))
    extents = pieces.groupBy("qname").agg(F.lit(60).alias("q_lo"), (F.sum("length") - 40).alias("q_hi"))
    return V.block_scores(matches, errors_of(spark, sf, pieces), blocks, deletions, extents, ["qname"])


@query("block_scores", SCORES + " SELECT qname, target, idx, is_flank, round(CAST(score AS DOUBLE), 9) AS score FROM so")
def _(spark, sf):
    return scores_of(spark, sf).select("qname", "target", "idx", "is_flank", F.round("score", 9).alias("score"))


@query("query_scores", SCORES + " SELECT qname, round(CAST(min(score) AS DOUBLE), 9) AS worst, round(CAST(avg(score) AS DOUBLE), 9) AS average FROM so WHERE NOT is_flank GROUP BY qname")
def _(spark, sf):
    return V.query_scores(scores_of(spark, sf), ["qname"]).select("qname", F.round("worst", 9).alias("worst"), F.round("average", 9).alias("average"))


@query("chain_gaps", CHAINS + """,
  en AS (SELECT *, row_number() OVER (PARTITION BY qname, strand, cluster ORDER BY chain DESC, k) AS best FROM cs),
  bt AS (SELECT qname, strand, cluster, 0 AS step, seg, parent FROM en WHERE best = 1 UNION ALL
    SELECT b.qname, b.strand, b.cluster, b.step + 1, c.seg, c.parent FROM bt b JOIN cs c ON c.qname = b.qname AND c.strand = b.strand AND c.cluster = b.cluster AND c.seg = b.parent WHERE b.parent <> b.seg),
  gp AS (SELECT bt.qname, bt.strand, bt.cluster, bt.seg, v.q0, v.r0, w.q1, w.r1 FROM bt JOIN sc v USING (qname, strand, seg) JOIN sc w ON w.qname = bt.qname AND w.strand = bt.strand AND w.seg = bt.parent WHERE bt.parent <> bt.seg)
  SELECT qname, strand, cluster, seg, 'query' AS side, q1 AS lo, q0 AS hi, q0 - q1 AS error FROM gp WHERE q0 > q1 UNION ALL SELECT qname, strand, cluster, seg, 'ref', q1, q0, r0 - r1 FROM gp WHERE r0 > r1""")
def _(spark, sf):
    segments = V.segment_clusters(segments_of(spark, sf), ["qname", "strand"], 250)
    return V.chain_gaps(V.best_chains(V.chain_scores(segments, PART), PART), PART).select(*PART, "seg", "side", "lo", "hi", "error")
