"""Connected components and maximum cliques of box-compatible point pairs.

Two discordant pairs (p1, p2) and (q1, q2) are compatible when |p1-q1| <= d, |p2-q2| <= d and
the intervals [p1, p2+slop] and [q1, q2+slop] overlap.  Listing all compatible pairs of a hot
locus is quadratic, so components are found without it:

* equal points are folded into one row with a weight,
* points fall into lattice cells of d+1 positions a side (at most (d+1)^2 points), inside
  which compatibility is interval overlap, i.e. islands,
* neighbouring cells are linked through one running extreme per point,
* the remaining graph of cell islands is contracted with min-label stars.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.session import checkpoint


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) from an (a, b) edge list; the label is the smallest node.

    Alternates large-star and small-star steps, which converge in a logarithmic number of
    rounds whatever the diameter, and cuts the lineage every round.  Every round lowers labels
    or changes nothing, so the loop ends without a limit on rounds.
    """
    cur = checkpoint(edges.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    def star(df: DataFrame, large: bool) -> DataFrame:
        both = df.select("a", "b").unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = df.select(F.col("b").alias("a"), F.col("a").alias("b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        linked = both.join(low, "a")
        if large:
            linked = linked.where("b > a")
            out = linked.select(F.col("m").alias("a"), "b")
        else:
            out = linked.select(F.col("m").alias("a"), "b").unionByName(
                low.select(F.col("m").alias("a"), F.col("a").alias("b")))
        return (out.where("a <> b")
                .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())

    def digest(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    before = digest(cur)
    while True:
        cur = checkpoint(star(star(cur, True), False))
        after = digest(cur)
        if after == before:
            break
        before = after
    return cur.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).unionByName(
        cur.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def pair_components(points: DataFrame, part: list[str], d: str, slop: str) -> DataFrame:
    """``points`` (part, pos1, pos2 and per-row ``d``, ``slop``) with their ``component``.

    ``d`` is constant inside one part.  The component label is stable: a hash of the part and
    the smallest member cell island.
    """
    keys = [*part, "pos1", "pos2"]
    pts = points.groupBy(*keys).agg(F.first(d).alias("_d"), F.first(slop).alias("_s"))
    side = F.col("_d") + 1
    pts = (pts.withColumn("_i", F.floor(F.col("pos1") / side))
              .withColumn("_j", F.floor(F.col("pos2") / side))
              .withColumn("_own", F.col("pos1") <= F.col("pos2") + F.col("_s")))
    # a point whose own ends already violate the slop is compatible with nothing
    good = pts.where("_own")
    lonely = pts.where("not _own").withColumn("node", F.xxhash64(*part, "pos1", "pos2", F.lit("x")))
    cell = Window.partitionBy(*part, "_i", "_j").orderBy("pos1", "pos2")
    prev_good = F.max(F.col("pos2") + F.col("_s")).over(
        cell.rowsBetween(Window.unboundedPreceding, -1))
    good = good.withColumn("_prev", prev_good).withColumn(
        "_new", (F.col("_prev").isNull() | (F.col("pos1") > F.col("_prev"))).cast("int"))
    good = good.withColumn("_isl", F.sum("_new").over(
        cell.rowsBetween(Window.unboundedPreceding, 0)))
    good = checkpoint(good.withColumn("node", F.xxhash64(*part, "_i", "_j", "_isl"))
                      .select(*keys, "_d", "_s", "_i", "_j", "node"))

    edges = _cell_edges(good, part)
    comp = connected_components(edges)
    labelled = good.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    out = labelled.select(*keys, "component").unionByName(
        lonely.select(*keys, F.col("node").alias("component")))
    return points.join(out, keys)


def _cell_edges(good: DataFrame, part: list[str]) -> DataFrame:
    """Links between neighbouring cells that keep exactly the true connectivity.

    For a cell B and a neighbour A the rows of both are put in one bounded partition.  Left
    neighbours need pos1 >= q1-d, so a running extreme in descending pos1 finds the best
    partner of every point q of B.
    """
    cols = [*part, "_i", "_j"]
    # (name, di, dj): offset from A to the cell B that looks at it
    kinds = {"left_down": (1, 1), "left": (1, 0), "left_up": (1, -1), "down": (0, 1)}
    seeker = good.select(*cols, F.explode(F.array(*[F.lit(k) for k in kinds])).alias("_kind"),
                         "pos1", "pos2", "_d", "_s", "node", F.lit(1).alias("_is_b"))
    target = None
    for kind, (di, dj) in kinds.items():
        t = good.select(*part, (F.col("_i") + di).alias("_i"), (F.col("_j") + dj).alias("_j"),
                        F.lit(kind).alias("_kind"), "pos1", "pos2", "_d", "_s", "node",
                        F.lit(0).alias("_is_b"))
        target = t if target is None else target.unionByName(t)
    rows = seeker.unionByName(target)
    is_b = F.col("_is_b") == 1
    # order key: A at pos1, B at q1-d; at equal keys A comes first
    rows = rows.withColumn("_key", F.when(is_b & (F.col("_kind") != "down"), F.col("pos1") - F.col("_d"))
                           .otherwise(F.col("pos1")))
    group = Window.partitionBy(*cols, "_kind")
    suffix = group.orderBy(F.col("_key").desc(), "_is_b").rowsBetween(Window.unboundedPreceding, 0)
    a_high = F.when(~is_b, F.struct(F.col("pos2"), F.col("node")))
    rows = (rows.withColumn("_hi", F.max(a_high).over(suffix))
                .withColumn("_lo", F.min(a_high).over(suffix))
                .withColumn("_all", F.max(a_high).over(group)))
    need = F.greatest(F.col("pos2") - F.col("_d"), F.col("pos1") - F.col("_s"))
    hit = (F.when(F.col("_kind").isin("left", "left_down") & (F.col("_hi.pos2") >= need), F.col("_hi.node"))
           .when((F.col("_kind") == "left_up") & (F.col("_lo.pos2") <= F.col("pos2") + F.col("_d")),
                 F.col("_lo.node"))
           .when((F.col("_kind") == "down") & (F.col("_all.pos2") >= need), F.col("_all.node")))
    direct = rows.where(is_b).select(F.col("node").alias("a"), hit.alias("b")).where("b is not null")

    # same column: every island of A with the lowest q it can reach
    down = rows.where("_kind = 'down'").select(*cols, "pos1", "pos2", "_d", "_s", "node", "_is_b")
    tops = down.where("_is_b = 0").groupBy(*cols, "node").agg(
        F.max("pos2").alias("_m"), F.first("_d").alias("_d"), F.first("_s").alias("_s"))
    probe = (tops.select(*cols, (F.col("_m") + F.col("_s")).alias("_key"), F.lit(1).alias("_is_t"),
                         F.col("_m"), F.col("_d"), "node", F.lit(None).cast("bigint").alias("pos2"))
             .unionByName(down.where("_is_b = 1").select(
                 *cols, F.col("pos1").alias("_key"), F.lit(0).alias("_is_t"),
                 F.lit(None).cast("bigint").alias("_m"), "_d", "node", F.col("pos2").cast("bigint").alias("pos2"))))
    upto = (Window.partitionBy(*cols).orderBy("_key", "_is_t")
            .rowsBetween(Window.unboundedPreceding, 0))
    reach = F.min(F.when(F.col("_is_t") == 0, F.struct("pos2", "node"))).over(upto)
    upward = (probe.withColumn("_r", reach).where("_is_t = 1")
              .where(F.col("_r.pos2") <= F.col("_m") + F.col("_d"))
              .select(F.col("node").alias("a"), F.col("_r.node").alias("b")))
    return direct.unionByName(upward).distinct()


_WINDOW = T.StructType([T.StructField("k", T.LongType()), T.StructField("x", T.LongType()), T.StructField("y", T.LongType()),
                        T.StructField("members", T.LongType())])


@F.pandas_udf(T.ArrayType(_WINDOW))
def fullest_windows(p1: pd.Series, p2: pd.Series, weight: pd.Series, own1: pd.Series, own2: pd.Series,
                    d: pd.Series, slop: pd.Series) -> pd.Series:
    """Of the windows [x, x+d] x [y, y+d] with pos1 <= y+slop that start at an own x and an own y: the fullest of each group.

    ``members`` tells different member sets apart.
    """
    out = []
    for a, b, w, o1, o2, width, s in zip(p1, p2, weight, own1, own2, d, slop):
        order = np.argsort(a, kind="stable")
        a, b, w, o1, o2 = (np.asarray(v)[order] for v in (a, b, w, o1, o2))
        mark = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        mark ^= mark >> np.uint64(29)
        xs, best, found = np.unique(a[o1]), 1, {}
        for y in np.unique(b[o2]):
            row = np.flatnonzero((b >= y) & (b <= y + width) & (a <= y + s))
            full, marks = np.r_[0, np.cumsum(w[row])], np.r_[np.uint64(0), np.cumsum(mark[row])]
            lo, hi = np.searchsorted(a[row], xs), np.searchsorted(a[row], xs + width, "right")
            k = full[hi] - full[lo]
            top = int(k.max(initial=0))
            if top < 2 or top < best:
                continue
            if top > best:
                best, found = top, {}
            for i in np.flatnonzero(k == top):
                found.setdefault(int((marks[hi[i]] - marks[lo[i]]).astype(np.int64)), (int(xs[i]), int(y)))
        out.append([{"k": best, "x": x, "y": y, "members": m} for m, (x, y) in sorted(found.items())])
    return pd.Series(out)


def largest_cliques(points: DataFrame, group: list[str]) -> DataFrame:
    """(group, clique, x, y): every largest set of compatible points of each group that has a pair of them.

    ``points``: group, pos1, pos2, d, slop.  A set is what a window starting at members'
    coordinates holds, and a window lies in two by two lattice cells of side d + 1.  So the search
    runs for each such square on its own, on distinct points with weights: its work and memory are
    bounded by the square, whatever the size of a group.
    """
    side = F.col("d") + 1
    dense = (points.groupBy(*group, "pos1", "pos2", "d", "slop").agg(F.count(F.lit(1)).alias("w"))
             .withColumn("_i", F.floor(F.col("pos1") / side)).withColumn("_j", F.floor(F.col("pos2") / side)))
    squares = F.array(*[F.struct((F.col("_i") - i).alias("i"), (F.col("_j") - j).alias("j")) for i in (0, 1) for j in (0, 1)])
    placed = dense.withColumn("q", F.explode(squares))
    packed = placed.groupBy(*group, "q", "d", "slop").agg(F.collect_list(F.struct(
        "pos1", "pos2", "w", (F.col("_i") == F.col("q.i")).alias("o1"), (F.col("_j") == F.col("q.j")).alias("o2"))).alias("m"))
    windows = packed.select(*group, F.explode(fullest_windows("m.pos1", "m.pos2", "m.w", "m.o1", "m.o2", "d", "slop")).alias("v")).select(*group, "v.*")
    top = Window.partitionBy(*group)
    return (windows.withColumn("_top", F.max("k").over(top)).where("k = _top").dropDuplicates([*group, "members"])
            .select(*group, F.col("members").alias("clique"), "x", "y"))
