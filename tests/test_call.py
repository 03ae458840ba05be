import pytest
from simulate import haplotype, simulate

from strandloom.config import CallConfig
from strandloom.plans.call import call
from strandloom.schemas import ALIGNMENT

N = 60000


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    # homozygous deletion, inversion; heterozygous tandem duplication
    base = [(0, 10000, 1), (10800, 20000, 1), (20000, 21500, -1), (21500, 30000, 1)]
    h1 = haplotype(base + [(30000, 45000, 1), (44000, N, 1)])
    h2 = haplotype(base + [(30000, N, 1)])
    rows = simulate([h1, h2], coverage=30)
    path = str(tmp_path_factory.mktemp("aln") / "reads")
    spark.createDataFrame(rows, ALIGNMENT).write.parquet(path)
    aln = spark.read.parquet(path)
    regions = spark.createDataFrame([("c1", 0, N)], "chrom string, lo bigint, hi bigint")
    gaps = spark.createDataFrame([("c1", 50000, 50200)], "chrom string, lo bigint, hi bigint")
    return call(aln, regions, gaps, CallConfig())


def test_planted_events_are_called(result):
    rows = {r.svtype: r for r in result.calls.collect()}
    assert set(rows) == {"DEL", "INV", "DUP"}, rows
    d = rows["DEL"]
    assert (d.minbp, d.maxbp, d.gt, d.rearrangement, d.len_affected) == (10000, 10800, "HOM", "AC", 800)
    assert rows["INV"].minbp == 20000 and rows["INV"].maxbp == 21500 and rows["INV"].rearrangement == "AB'C"
    u = rows["DUP"]
    assert (u.minbp, u.maxbp, u.gt, u.rearrangement) == (44000, 45000, "HET", "ABBC")
    assert all(r.score_vs_ref > 10 and r.score_vs_next > 0 for r in rows.values())
    assert int(d.sr_support) > 5


def test_vcf_and_support(spark, result):
    from pyspark.sql import functions as F
    rows = result.vcf(lambda df, c, p, name: df.withColumn(name, F.lit("N"))).collect()
    assert sorted(r.alt for r in rows) == ["<DEL>", "<DUP:TANDEM>", "<INV>"]
    deletion = next(r for r in rows if r.alt == "<DEL>")
    assert deletion.pos == 10001 and "END=10801" in deletion.info and deletion.sample == "1/1"
    assert result.split_support.count() > 5
    assert {r.name.split(":")[-1] for r in result.altered.select("name").distinct().collect()} == {"DEL", "INV", "DUP"}
    assert result.graph_log.count() >= 3
