"""Greedy matching, path search and genotypes against sequential forms."""

import math
import random

import pytest

from strandloom.config import CallConfig
from strandloom.plans import breakpoints as B
from strandloom.plans import inference as N


def scanned(pairs):
    left, right, out = set(), set(), []
    for a, b in sorted(set(pairs)):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.append((a, b))
    return out


@pytest.mark.parametrize("width", [5, 40, 4096])
def test_matching_equals_the_scan(spark, width):
    rng = random.Random(width)
    parts = {name: [(a, a + rng.randrange(0, reach)) for a in (rng.randrange(span) for _ in range(n))]
             for name, n, span, reach in (("x", 400, 300, 12), ("y", 50, 1000, 30), (None, 90, 60, 4))}
    rows = [(name, a, b, k) for name, p in parts.items() for k, (a, b) in enumerate(dict.fromkeys(p))]
    df = spark.createDataFrame(rows, "c string, a long, b long, k long")
    found = {}
    for r in B.greedy_matching(df, ["c"], "a", "b", width).collect():
        found.setdefault(r["c"], []).append((r["a"], r["b"]))
    assert {c: sorted(v) for c, v in found.items()} == {c: scanned(p) for c, p in parts.items()}


def test_a_chain_of_ten_thousand_links(spark):
    """Every left end but the first loses its first choice to the one before."""
    df = spark.range(10_000).selectExpr("'c' AS c", "2 * id AS a", "explode(array(2 * id + 1, 2 * id + 3)) AS b").unionByName(
        spark.createDataFrame([("c", -1, 1)], "c string, a long, b long").selectExpr("c", "a", "b"))
    rows = [(r["a"], r["b"]) for r in df.collect()]
    assert sorted((r["a"], r["b"]) for r in B.greedy_matching(df, ["c"], "a", "b").collect()) == scanned(rows)


def test_nothing_to_match(spark):
    assert B.greedy_matching(spark.createDataFrame([], "c string, a long, b long"), ["c"], "a", "b").count() == 0


@pytest.mark.parametrize("width", [5, 40, 4096])
def test_parts_scanned_whole_or_in_bins(spark, width):
    """Repeated pairs share the verdict of their pair; a pair without an end is none."""
    rng = random.Random(width)
    rows = [(c, a, None if rng.random() < 0.02 else a + rng.randrange(9), k % 7) for k in range(900)
            for c, a in [(rng.choice(["x", "y", None]), rng.randrange(250))]] + [("z", None, 4, 0)]
    df = spark.createDataFrame(rows, "c string, a int, b int, k long")
    whole, bins = B.greedy_matching(df, ["c"], "a", "b"), B.greedy_matching(df, ["c"], "a", "b", width, most=0)
    assert whole.schema == bins.schema == df.schema
    got = sorted(map(repr, whole.collect()))
    assert got == sorted(map(repr, bins.collect()))
    chosen = {(c, *x) for c in ("x", "y", None) for x in scanned([(a, b) for d, a, b, _ in rows if d == c and b is not None])}
    assert got == sorted(map(repr, df.where("b is not null and a is not null").rdd.filter(lambda r: (r["c"], r["a"], r["b"]) in chosen).collect()))


def test_a_chain_over_bins(spark):
    df = spark.range(2_000).selectExpr("'c' AS c", "2 * id AS a", "explode(array(2 * id + 1, 2 * id + 3)) AS b").unionByName(
        spark.createDataFrame([("c", -1, 1)], "c string, a long, b long"))
    rows = [(r["a"], r["b"]) for r in df.collect()]
    assert sorted((r["a"], r["b"]) for r in B.greedy_matching(df, ["c"], "a", "b", 1000, most=0).collect()) == scanned(rows)


def test_parts_that_fit_need_one_shuffle_and_no_rounds(spark, monkeypatch):
    """Pairs are written once, whatever the chains, and no group is handed to Python by itself."""
    written, keep = [], B.saved
    monkeypatch.setattr(B, "saved", lambda df: written.append(df) or keep(df))
    df = spark.range(500).selectExpr("cast(id % 50 AS string) AS c", "2 * id AS a", "explode(array(2 * id + 1, 2 * id + 101)) AS b")
    out = B.greedy_matching(df, ["c"], "a", "b", 40)
    assert out.count() == 500 and len(written) == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "FlatMapGroupsInPandas" not in plan


def plain_walks(edges, start, end, n_genome, most):
    """Walks by depth first, larger sides first."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def back(a, b):
        if max(a, b) >= 2 * n_genome:
            return []
        return [n for n, m in ((a, b), (b, a)) if (m <= n if n % 2 else n <= m)]

    def go(path, used):
        if path[-1] == end:
            yield path
        for n in sorted(near.get(path[-1], ()), reverse=True):
            if (start <= n <= end or n >= 2 * n_genome) and all(used.count(u) < most for u in back(path[-1], n)):
                yield from go([*path, n, n ^ 1], used + back(path[-1], n))

    yield from go([start, start ^ 1], [])


@pytest.mark.parametrize(("most", "cap"), [(1, 2000), (2, 3)])
def test_walks_equal_depth_first(spark, most, cap):
    rng = random.Random(most)
    edges = {(0, 1), (2, 3)}
    for chrom in "ab":
        edges |= {(chrom, 2 * k + 1, 2 * k + 2) for k in range(5)} if chrom == "a" else {(chrom, 1, 2), (chrom, 3, 4), (chrom, 3, 10), (chrom, 4, 11)}
    edges = {e for e in edges if len(e) == 3}
    for _ in range(4):
        a, b = sorted(rng.randrange(12) for _ in range(2))
        edges.add(("a", a, b))
    e = spark.createDataFrame([(*x, 5) for x in edges], "chrom string, v1 int, v2 int, support long")
    subs = spark.createDataFrame([(1, "a", 0, 5), (2, "b", 0, 2), (3, "b", 3, 4)], "sub long, chrom string, start int, end int")
    n = spark.createDataFrame([("a", 6), ("b", 5)], "chrom string, n_genome int")
    summary, paths = N.enumerate_paths(subs, e, n, CallConfig(max_back_edges=most, max_paths=cap))
    want = {1: list(plain_walks([x[1:] for x in edges if x[0] == "a"], 0, 11, 6, most)),
            2: list(plain_walks([x[1:] for x in edges if x[0] == "b"], 0, 5, 5, most))}
    got = {}
    for r in paths.orderBy("sub", "path_id").collect():
        got.setdefault(r["sub"], []).append(list(r["path"]))
    assert got == {k: v for k, v in want.items() if v}
    info = {r["sub"]: (r["status"], r["n_paths"]) for r in summary.collect()}
    assert info == {k: ("ok" if len(v) <= cap else "npaths", len(v)) for k, v in want.items()}
    assert len(want[2]) > 0


def test_genotypes_equal_all_pairs(spark):
    rng, pi, fractions = random.Random(8), 1e-3, [0.3, 0.5, 0.7]
    paths, sigs, libs = range(6), range(40), ["l1", "l2"]
    like = {(p, s): rng.choice([0, 0, 0.1, 0.4, 0.9]) for p in paths for s in sigs}
    cnt = {s: rng.randrange(1, 5) for s in sigs}
    nc = {(p, b): rng.choice([90.0, 100.0, 120.0]) for p in paths for b in libs}
    n = {"l1": 50, "l2": 31}
    lik = spark.createDataFrame([(7, p, s, cnt[s], float(v)) for (p, s), v in like.items() if v], "sub long, path_id int, sig long, cnt int, l double")
    info = spark.createDataFrame([(7, p, [0, 1], "c", 0, 1, 2, 0, len(paths)) for p in paths],
                                 "sub long, path_id int, path array<int>, chrom string, start int, end int, n_genome int, extra int, n_paths int")
    counts = spark.createDataFrame([(7, b, c) for b, c in n.items()], "sub long, lib string, n long")
    constants = spark.createDataFrame([(7, p, b, v) for (p, b), v in nc.items()], "sub long, path_id int, lib string, nc double")
    ref = spark.createDataFrame([(7, 2)], "sub long, ref_id int")
    told = {s for s in sigs if len({like[p, s] for p in paths}) > 1}

    def score(i, j, f):
        mix = lambda x, y: x if i == j else (1 - f) * x + f * y
        return (sum(-n[b] * math.log(mix(nc[i, b], nc[j, b]) + 2e-10) for b in libs)
                + sum(cnt[s] * math.log(pi + (1 - pi) * mix(like[i, s], like[j, s])) for s in told))

    scores = sorted(((score(i, j, f), i, j) for i in paths for j in range(i + 1) for f in ([1.0] if i == j else fractions)), reverse=True)
    for most in (None, 50):
        cfg = CallConfig(allele_fractions=(0.3, 0.5), top_paths=most)
        row = N.genotypes(info, lik, counts, constants, ref, cfg, pi).first()
        assert math.isclose(row["best_lh"], scores[0][0], rel_tol=1e-9) and (row["id1"], row["id2"]) == scores[0][1:]
        assert math.isclose(row["next_lh"], scores[1][0], rel_tol=1e-9) and (row["next1"], row["next2"]) == scores[1][1:]
        of_ref = (sum(-n[b] * math.log(nc[2, b] + 1e-10) for b in libs) + sum(cnt[s] * math.log(pi + (1 - pi) * like[2, s]) for s in told))
        assert math.isclose(row["ref_lh"], of_ref, rel_tol=1e-9)
