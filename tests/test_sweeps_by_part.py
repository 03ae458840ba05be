"""Parts that fit a bin are swept whole, in one shuffle; larger ones in bins, with the same rows."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.config import CallConfig
from strandloom.operators import ordered as O
from strandloom.plans import breakpoints as B
from strandloom.plans import catalogue as C
from strandloom.plans import evidence as E
from strandloom.plans import graph as G


def shuffles(df):
    """Shuffles of the plan, counted without those that are read again."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition")


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("seed,d", [(1, 0), (2, 4)])
def test_island_spans_whole_or_in_bins(spark, seed, d):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), lo := rng.randrange(-50, 900), lo + rng.choice([0, 1, 3, 40])) for _ in range(300)]
    df = spark.createDataFrame(rows, "p string, lo bigint, hi bigint").where("p is not null")
    whole, bins = (O.island_spans(df, ["p"], "lo", "hi", d, width) for width in (1000, 16))
    assert rows_of(whole) == rows_of(bins)
    assert shuffles(whole) == 1


def test_blocks_whole_or_in_bins(spark):
    rng = random.Random(7)
    regions = [(c, lo, hi) for c in "ab" for lo, hi in ((0, 300), (300, 520), (700, 701), (800, 1500))] + [("c", 10, 90)]
    cuts = []
    for c in "abd":
        at = -5
        while at < 1550:
            size = rng.choice([0, 0, 1, 9])
            cuts.append((c, at, at + size))
            at += size + rng.choice([1, 2, 30, 80])
    cuts = [x for x in cuts if x[1] != x[2] or x[1] != 300]
    gaps = [(c, lo := rng.randrange(-10, 1500), lo + rng.choice([0, 5, 60])) for c in "abcd" for _ in range(25)]
    b = spark.createDataFrame(cuts, "chrom string, bp_lo bigint, bp_hi bigint")
    g = spark.createDataFrame(gaps, "chrom string, lo bigint, hi bigint")
    r = spark.createDataFrame(regions, "chrom string, lo bigint, hi bigint")
    whole, bins = G.create_blocks(b, g, r), G.create_blocks(b, g, r, most=0)
    assert whole.columns == bins.columns == G.BLOCK_COLUMNS and whole.dtypes == bins.dtypes
    assert rows_of(whole) == rows_of(bins) and whole.count() > 50
    assert shuffles(whole) == 1


def test_hulls_by_contig_or_in_bins(spark):
    rng = random.Random(9)
    ev = [(c, lo := rng.randrange(0, 1500), lo + rng.choice([0, 1, 4, 30]), rng.choice([1, 2]), rng.choice(["clip", "split", "pe"]), rng.choice([None, "m", "n"]))
          for c in "ab" for _ in range(90)] + [("a", 500, 1100, 1, "pe", "wide"), ("a", 1600, 1600, 3, "pe", "x"), ("c", 4, 9, 1, "pe", "y")]
    df = spark.createDataFrame(ev, "chrom string, lo bigint, hi bigint, level int, kind string, member string").withColumns(
        {"clip_left": F.col("lo") % 3, "clip_right": F.lit(1).cast("bigint"), "mtype": F.lit("Ins")})
    whole, bins = B.precedence_hulls(df), B.precedence_hulls(df, most=0)
    assert rows_of(whole[0]) == rows_of(bins[0]) and whole[0].count() > 20
    columns = ["chrom", "level", "lo", "hi", "bp_lo", "bp_hi"]
    assert rows_of(whole[1].select(columns)) == rows_of(bins[1].select(columns))
    assert shuffles(whole[0]) == 1
    for rows in (df, df.where("level = 2")):
        for one, other in zip(B.merge_breakpoints(rows, CallConfig()), B.merge_breakpoints(rows, CallConfig(), most=0)):
            assert rows_of(one.select(sorted(one.columns))) == rows_of(other.select(sorted(one.columns))) and one.count() > 5


def test_clip_clusters_by_contig_or_in_bins(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["l1", "l2"]), rng.choice("ab"), rng.random() < 0.5, rng.randrange(900), rng.randrange(5, 40), 60 + rng.randrange(40),
             rng.randrange(60), rng.random() < 0.5) for _ in range(500)]
    clips = spark.createDataFrame(rows, "lib string, chrom string, is_right boolean, pos bigint, bases_clipped int, bases_mapped int, mapq int, is_reverse boolean")
    whole, bins = B.softclip_clusters(clips, CallConfig()), B.softclip_clusters(clips, CallConfig(), most=0)
    assert whole.dtypes == bins.dtypes and rows_of(whole) == rows_of(bins) and whole.count() > 20
    assert shuffles(whole) == 1


def test_only_clipped_reads_are_written(spark, monkeypatch):
    written, keep = [], C.saved
    monkeypatch.setattr(C, "saved", lambda df: written.append(keep(df)) or written[-1])
    monkeypatch.setattr(C, "checkpoint", lambda df: written.append(keep(df)) or written[-1])
    sf = "/root/testdata/sf0.001"
    clips = C.clips_of(spark, sf)
    assert len(written) == 1 and written[0].where("clip_l = 0 and clip_r = 0").isEmpty() and set(written[0].columns) == set(E.CLIP_FIELDS)
    assert rows_of(clips) == rows_of(E.softclip_evidence(C.reads_of(spark, sf), CallConfig())) and clips.count() > 20
