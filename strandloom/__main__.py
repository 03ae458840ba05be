"""Commands: ``python -m strandloom call ...`` and ``python -m strandloom filter-merge ...``.

Run them with spark-submit on a cluster; without one a local session is started.
"""

from __future__ import annotations

import argparse
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.config import PRESETS, CallConfig, parse_region, preset
from strandloom.plans.call import call
from strandloom.plans.filter_merge import SIMPLE, TYPE_NAMES, FilterOptions, filter_merge
from strandloom.schemas import CALL_COLUMNS
from strandloom.sources import writers
from strandloom.sources.alignments import bam_contigs, read_bam, read_sam, sam_contigs
from strandloom.sources.tables import read_bed, read_calls


def _options(parser: argparse.ArgumentParser, cls, skip: tuple[str, ...] = ()) -> None:
    """One option for each field of a settings class, with its default."""
    for f in fields(cls):
        if f.name in skip:
            continue
        name, default = "--" + f.name.replace("_", "-"), f.default
        if isinstance(default, bool):
            parser.add_argument(name, action=argparse.BooleanOptionalAction, default=None, help=f"default {default}")
        elif isinstance(default, tuple):
            kind = float if default and isinstance(default[0], float) else str
            parser.add_argument(name, nargs="*", type=kind, default=None, help=f"default {' '.join(map(str, default)) or 'none'}")
        else:
            parser.add_argument(name, type=int if default is None else type(default), default=None, help=f"default {default}")


def _given(args: argparse.Namespace, cls) -> dict:
    values = {f.name: getattr(args, f.name, None) for f in fields(cls)}
    return {k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if v is not None}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandloom")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("call", help="call rearrangements from alignments")
    one.add_argument("-i", "--input", required=True, help="BAM or SAM files of one library, separated by commas")
    one.add_argument("-r", "--region", required=True, nargs="+", help="contig or contig:start-end")
    one.add_argument("-G", "--gaps", required=True, help="BED file of assembly gaps")
    one.add_argument("-o", "--output", required=True, help="folder for the results")
    one.add_argument("--overwrite", action="store_true")
    one.add_argument("--cutoffs", choices=sorted(PRESETS), default="low", help="thresholds that the other options start from")
    _options(one, CallConfig)
    two = commands.add_parser("filter-merge", help="filter call tables and merge them into one")
    two.add_argument("inputs", nargs="+", help="output folders of call")
    two.add_argument("-o", "--output", required=True, help="folder for the merged table")
    two.add_argument("--input-name", default="calls.tab")
    two.add_argument("--overwrite", action="store_true")
    _options(two, FilterOptions, skip=("exclude",))
    for name in sorted({*TYPE_NAMES.values(), *SIMPLE, "simple", "compoundhet"}):
        two.add_argument(f"--no-{name}", dest="exclude", action="append_const", const=name)
    return top


def regions_of(spark: SparkSession, texts: list[str], contigs: DataFrame) -> DataFrame:
    """chrom, lo, hi of the named regions; a contig without a span counts whole."""
    asked = spark.createDataFrame([(r.chrom, r.start, r.end) for r in map(parse_region, texts)], "chrom string, lo bigint, hi bigint")
    return asked.join(contigs.select(F.col("rname").alias("chrom"), F.col("length").cast("bigint").alias("length")), "chrom", "left").select(
        "chrom", F.coalesce("lo", F.lit(0)).alias("lo"), F.least(F.coalesce("hi", "length"), F.coalesce("length", "hi")).alias("hi")).where("hi > lo")


def run_call(spark: SparkSession, args: argparse.Namespace) -> None:
    paths = args.input.split(",")
    if all(p.endswith(".sam") for p in paths):
        reads, contigs = read_sam(spark, paths), sam_contigs(spark, paths)
    else:
        reads, contigs = read_bam(spark, paths), bam_contigs(spark, paths[0])
    found = call(reads, regions_of(spark, args.region, contigs), read_bed(spark, args.gaps),
                 preset(args.cutoffs, **_given(args, CallConfig)))
    writers.write_calls(found.calls.select(*CALL_COLUMNS), f"{args.output}/calls.tab", args.overwrite)
    writers.write_split_support(found.split_support, f"{args.output}/split_support.tab", args.overwrite)


def run_filter_merge(spark: SparkSession, args: argparse.Namespace) -> None:
    options = FilterOptions(**{**_given(args, FilterOptions), "exclude": tuple(args.exclude or ())})
    merged = filter_merge(read_calls(spark, args.inputs, args.input_name), options)
    writers.write_calls(merged, args.output, args.overwrite)


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = SparkSession.builder.appName(f"strandloom {args.command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    {"call": run_call, "filter-merge": run_filter_merge}[args.command](spark, args)


if __name__ == "__main__":
    main()
