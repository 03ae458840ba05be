import pytest

from strandloom.__main__ import _given, main, parser, regions_of
from strandloom.config import CallConfig, preset
from strandloom.schemas import CALL_COLUMNS
from strandloom.sources import writers as W


def call_row(**change):
    row = dict.fromkeys(CALL_COLUMNS, "0")
    row.update(chrom="4", minbp=1200, maxbp=1900, id="4_1000-2000", svtype="DEL", complextype=".", num_bp=1, reference="ABC",
               rearrangement="AC", len_affected=700, filter="PASS", gt="HET", af="0.500", inslen="NA", sr_support="5,6", pe_support="3",
               score_vs_ref="12.00", score_vs_next="7.50", num_paths=4)
    row.update(change)
    return [row[c] for c in CALL_COLUMNS]


def test_options_reach_the_settings():
    args = parser().parse_args(["call", "-i", "a.bam", "-r", "c1:5-90", "c2", "-G", "g.bed", "-o", "out", "--cutoffs", "high",
                                "--min-bp-support", "7", "--no-do-splits", "--allele-fractions", "0.5", "1.0"])
    cfg = preset(args.cutoffs, **_given(args, CallConfig))
    assert (cfg.min_bp_support, cfg.do_splits, cfg.allele_fractions, cfg.min_edge_support) == (7, False, (0.5, 1.0), 3)
    with pytest.raises(SystemExit):
        parser().parse_args(["call", "-i", "a.bam"])


def test_regions(spark):
    contigs = spark.createDataFrame([("c1", 100), ("c2", 70)], "rname string, length int")
    got = sorted(tuple(r) for r in regions_of(spark, ["c1:20-400", "c2", "c1:0-10"], contigs).collect())
    assert got == [("c1", 0, 10), ("c1", 20, 100), ("c2", 0, 70)]


def test_filter_merge_command(spark, tmp_path):
    rows = {"a": [call_row(), call_row(id="4_3000-4000", minbp=3100, maxbp=3150, len_affected=50)],
            "b": [call_row(chrom="2", id="2_1-9"), call_row(id="4_5-6", svtype="INV", sr_support="1,9")]}
    for name, table in rows.items():
        kinds = ", ".join(f"`{c}` {'bigint' if isinstance(v, int) else 'string'}" for c, v in zip(CALL_COLUMNS, table[0]))
        W.write_calls(spark.createDataFrame(table, kinds), str(tmp_path / name / "calls.tab"))
    inputs = [str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "absent")]

    def merged(*options):
        main(["filter-merge", *inputs, "-o", str(tmp_path / "out"), "--overwrite", *options])
        return [(r.chrom, r.id) for r in spark.read.csv(str(tmp_path / "out"), sep="\t", header=True).collect()]

    assert sorted(merged()) == [("2", "2_1-9"), ("4", "4_1000-2000"), ("4", "4_3000-4000"), ("4", "4_5-6")]
    assert sorted(merged("--min-size", "100", "--no-inversions")) == [("2", "2_1-9"), ("4", "4_1000-2000")]
    assert sorted(merged("--min-sr-support", "5", "--min-span", "60")) == [("2", "2_1-9"), ("4", "4_1000-2000")]
