import random

import pytest

from strandloom.operators import interval as I
from strandloom.operators import ordered as O
from strandloom.operators.components import connected_components, largest_cliques, pair_components


def brute_islands(rows, d):
    out, cur, end = {}, None, None
    for lo, hi in sorted(rows):
        if cur is None or lo - end > d:
            cur, end = lo, hi
        else:
            end = max(end, hi)
        out[lo] = cur
    return out


@pytest.mark.parametrize("seed,width,d", [(1, 10, 0), (2, 64, 5), (3, 7, 2)])
def test_islands_match_brute_force(spark, seed, width, d):
    rng = random.Random(seed)
    rows = [(lo := rng.randrange(-50, 900), lo + rng.choice([0, 1, 3, 40])) for _ in range(120)]
    df = spark.createDataFrame([("a", *r) for r in rows], "p string, lo bigint, hi bigint")
    got = {r.lo: r.island for r in O.islands(df, ["p"], "lo", "hi", d, width).collect()}
    assert got == brute_islands(rows, d)


def test_running_kinds(spark):
    rng = random.Random(5)
    pos = sorted(rng.sample(range(500), 60))
    val = [rng.randrange(100) if rng.random() < .7 else None for _ in pos]
    df = spark.createDataFrame([("a", p, v) for p, v in zip(pos, val)], "p string, pos bigint, v bigint")
    out = O.running(df, ["p"], "pos", {"s": ("sum", "v", False), "m": ("max", "v", True),
                                       "l": ("last", "v", False), "n": ("next", "v", False)}, width=17)
    got = {r.pos: (r.s, r.m, r.l, r.n) for r in out.collect()}
    for i, p in enumerate(pos):
        before = [v for v in val[:i] if v is not None]
        upto = [v for v in val[:i + 1] if v is not None]
        after = [v for v in val[i + 1:] if v is not None]
        assert got[p] == (sum(before), max(upto) if upto else None, before[-1] if before else None,
                          after[0] if after else None)


def test_centered_window(spark):
    rng = random.Random(6)
    pts = [(rng.randrange(200), rng.randrange(9)) for _ in range(80)]
    df = spark.createDataFrame([("a", *p) for p in pts], "p string, pos bigint, v bigint")
    got = {r.pos: (r.window_sum, r.window_count) for r in O.centered_window(df, ["p"], "pos", "v", 10, 16).collect()}
    for x in {p for p, _ in pts}:
        sel = [v for p, v in pts if x - 5 <= p <= x + 4]
        assert got[x] == (sum(sel), len(sel))


def points(intervals):
    return {x for lo, hi in intervals for x in range(lo, hi)}


def test_interval_algebra(spark):
    rng = random.Random(7)
    mk = lambda: [(lo := rng.randrange(300), lo + rng.randrange(0, 25)) for _ in range(25)]
    a, b = mk(), mk()
    da = spark.createDataFrame([("c", *r) for r in a], "chrom string, lo bigint, hi bigint")
    db = spark.createDataFrame([("c", *r) for r in b], "chrom string, lo bigint, hi bigint")
    for fn, want in ((I.interval_union, points(a) | points(b)), (I.interval_except, points(a) - points(b)),
                     (I.interval_intersect, points(a) & points(b))):
        rows = [(r.lo, r.hi) for r in fn(da, db, ["chrom"], width=20).collect()]
        assert points(rows) == want
        assert sum(hi - lo for lo, hi in rows) == len(want)


def test_overlap_and_band_joins(spark):
    rng = random.Random(8)
    a = [(i, (lo := rng.randrange(400)), lo + rng.randrange(1, 60)) for i in range(60)]
    b = [(i, (lo := rng.randrange(400)), lo + rng.randrange(1, 60)) for i in range(60)]
    da = spark.createDataFrame([("c", *r) for r in a], "chrom string, i int, lo int, hi int")
    db = spark.createDataFrame([("c", *r) for r in b], "chrom string, j int, lo2 int, hi2 int")
    got = sorted((r.i, r.j) for r in I.overlap_join(da, db, ["chrom"], ("lo", "hi"), ("lo2", "hi2"), 16).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2])
    got = sorted((r.i, r.j) for r in I.point_join(da, db, ["chrom"], "lo", ("lo2", "hi2"), 16).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if y[1] <= x[1] < y[2])
    got = sorted((r.i, r.j) for r in I.band_join(da, db, ["chrom"], "lo", "lo2", 5).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if abs(x[1] - y[1]) <= 5)


def test_close_pairs(spark):
    rng = random.Random(12)
    for spread in (9, 60, 4000):  # all close, some close, hardly any
        a, b = ([rng.randrange(spread) for _ in range(25)] for _ in range(2))
        da = spark.createDataFrame([("c", x) for x in a], "chrom string, a int")
        db = spark.createDataFrame([("c", x) for x in b], "chrom string, b int")
        got = sorted((r.a, r.b) for r in I.band_join(da, db, ["chrom"], "a", "b", 7).collect())
        assert got == sorted((x, y) for x in a for y in b if abs(x - y) <= 7)


def groups(labels):
    out = {}
    for k, v in labels.items():
        out.setdefault(v, set()).add(k)
    return sorted(map(sorted, out.values()))


def brute_components(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                parent[find(i)] = find(j)
    return {i: find(i) for i in range(n)}


def test_connected_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(55)] + [(100 + i, 101 + i) for i in range(40)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(df).collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    es = set(edges)
    want = brute_components(len(nodes), lambda i, j: (nodes[i], nodes[j]) in es or (nodes[j], nodes[i]) in es)
    assert groups(got) == groups({nodes[i]: v for i, v in want.items()})


@pytest.mark.parametrize("seed,slop,span", [(1, -1, 30), (2, -1, 300), (3, 20, 15), (4, 20, 120), (5, -1, 8)])
def test_pair_components(spark, seed, slop, span):
    rng = random.Random(seed)
    d = 12
    pts = set()
    while len(pts) < 150:
        p1 = rng.randrange(260)
        p2 = p1 + rng.randrange(-25 if slop > 0 else 0, span)
        pts.add((p1, p2))
    pts = sorted(pts)
    df = spark.createDataFrame([("L", *p, d, slop) for p in pts], "lib string, pos1 bigint, pos2 bigint, d int, slop int")
    got = {(r.pos1, r.pos2): r.component for r in pair_components(df, ["lib"], "d", "slop").collect()}

    def linked(i, j):
        (a, b), (e, f) = pts[i], pts[j]
        return abs(a - e) <= d and abs(b - f) <= d and max(a, e) - min(b, f) <= slop
    want = brute_components(len(pts), linked)
    assert groups(got) == groups({pts[i]: v for i, v in want.items()})


def test_largest_cliques_exhaustive(spark):
    rng = random.Random(10)
    import itertools
    for d, slop in ((6, -1), (8, 4)):
        pts = [(rng.randrange(20), 10 + rng.randrange(20)) for _ in range(10)]
        df = spark.createDataFrame([("g", *p, d, slop) for p in pts], "g string, pos1 bigint, pos2 bigint, d int, slop int")
        got = {tuple(i for i, (a, b) in enumerate(pts) if w.x <= a <= w.x + d and w.y <= b <= w.y + d and a <= w.y + slop)
               for w in largest_cliques(df, ["g"]).collect()}
        ok = lambda i, j: (abs(pts[i][0] - pts[j][0]) <= d and abs(pts[i][1] - pts[j][1]) <= d
                           and max(pts[i][0], pts[j][0]) - min(pts[i][1], pts[j][1]) <= slop)
        for size in range(10, 1, -1):
            want = [list(c) for c in itertools.combinations(range(10), size)
                    if all(ok(i, j) for i, j in itertools.combinations(c, 2))]
            # a member whose own ends break the slop cannot be in a clique
            want = [c for c in want if all(pts[i][0] - pts[i][1] <= slop for i in c)]
            if want:
                break
        assert sorted(map(list, got)) == sorted(want)


def test_largest_cliques_of_a_large_component(spark):
    """A chain of 12,000 pairs with one dense spot: the spot is found, in bounded squares."""
    df = spark.range(12000).selectExpr("'g' AS g", "id * 7 AS pos1", "id * 7 + 40 AS pos2", "30 AS d", "-1 AS slop")
    dense = spark.range(50).selectExpr("'g' AS g", "21003 + id % 5 AS pos1", "21060 + id % 3 AS pos2", "30 AS d", "-1 AS slop")
    points = [(r.pos1, r.pos2) for r in df.unionByName(dense).collect()]
    inside = lambda x, y: sum(x <= a <= x + 30 and y <= b <= y + 30 and a <= y - 1 for a, b in points)
    near = [p for p in points if 20900 < p[0] < 21100]
    best = max(inside(x, y) for x, _ in near for _, y in near)
    found = largest_cliques(df.unionByName(dense), ["g"]).collect()
    assert found and all(inside(w.x, w.y) == best for w in found)


def joins_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join Inner")


def test_islands_and_sets_pass_over_the_rows_once(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 5, 9), ("a", 70, 80), ("a", 9, 71), ("b", 3, 4)], "p string, lo bigint, hi bigint")
    spans = O.island_spans(df, ["p"], "lo", "hi", 0, 8)
    assert joins_of(spans) == 1 and sorted(tuple(r) for r in spans.collect()) == [("a", 1, 80), ("b", 3, 4)]
    union = I.interval_union(df.where("lo < 9"), df.where("lo >= 9"), ["p"], width=8)
    assert joins_of(union) <= 3 and sorted(tuple(r) for r in union.collect()) == [("a", 1, 80), ("b", 3, 4)]
