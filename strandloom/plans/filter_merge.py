"""Filtering and merging of call tables: one lazy plan of built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.schemas import CALL_COLUMNS

# fixed values: option names of the event types
TYPE_NAMES = {"DEL": "deletions", "INV": "inversions", "DUP": "tandemdups", "INS": "insertions", "BND": "complex"}
SIMPLE = ("deletions", "tandemdups", "inversions", "insertions")


@dataclass(frozen=True)
class FilterOptions:
    min_size: int = 0
    min_span: int = 0
    min_sr_support: int = 0
    max_sr_support: int | None = None
    min_pe_support: int = 0
    max_pe_support: int | None = None
    min_allele_fraction: float = 0.0
    max_allele_fraction: float = 1.0
    exclude: tuple = ()  # of TYPE_NAMES values, "simple" and "compoundhet"

    @property
    def excluded(self) -> list[str]:
        out = set(self.exclude)
        return sorted((out | set(SIMPLE)) - {"simple"} if "simple" in out else out)


def chrom_key(chrom: Column) -> list[Column]:
    """Numbered contigs in numeric order, then named ones, then anything else."""
    bare = F.regexp_replace(chrom, "^chr", "")
    number = F.regexp_extract(bare, "^([0-9]+)$", 1).try_cast("bigint")
    return [F.when(number.isNotNull(), 0).when(bare.rlike("^[a-zA-Z]"), 1).otherwise(2), number, bare]


def allowed_types(svtype: Column, rearrangement: Column, ident: Column, excluded: list[str]) -> Column:
    """Whether a call has known types only and none of the ``excluded`` (not empty); plain predicates, no array for each row."""
    left = "|".join(code for code, name in TYPE_NAMES.items() if name not in excluded)
    keep = svtype.rlike(f"^(?:{left})(?:,(?:{left}))*\\z") if left else F.lit(False)
    if "insertions" in excluded:
        keep = keep & ~F.coalesce(rearrangement.contains("_"), F.lit(False))
    if "compoundhet" in excluded:
        keep = keep & ~F.coalesce(ident.rlike("_[12]$"), F.lit(False))
    return keep


def _ints(col: str) -> Column:
    return F.split(col, ",").cast("array<bigint>")


def filter_calls(calls: DataFrame, options: FilterOptions) -> DataFrame:
    o = options
    sr, pe = _ints("sr_support"), _ints("pe_support")
    af = F.col("af").cast("double")
    keep = ((F.col("maxbp") - F.col("minbp") >= o.min_span) & (F.col("len_affected") >= o.min_size)
            & (af >= o.min_allele_fraction) & (af <= o.max_allele_fraction))
    if o.excluded:
        keep = keep & allowed_types(F.col("svtype"), F.col("rearrangement"), F.col("id"), o.excluded)
    # the lists are taken apart last, for rows that the cheap tests leave
    keep = keep & (F.array_min(sr) >= o.min_sr_support) & (F.array_min(pe) >= o.min_pe_support)
    if o.max_sr_support is not None:
        keep = keep & (F.array_max(sr) <= o.max_sr_support)
    if o.max_pe_support is not None:
        keep = keep & (F.array_max(pe) <= o.max_pe_support)
    return calls.where(keep)


def sort_calls(calls: DataFrame) -> DataFrame:
    # the keys as columns: a sort evaluates expressions anew in every comparison
    keys = {f"_key{i}": k for i, k in enumerate(chrom_key(F.col("chrom")))}
    return calls.withColumns(keys).orderBy(*keys, "minbp", "maxbp", "id").drop(*keys)


def filter_merge(calls: DataFrame, options: FilterOptions) -> DataFrame:
    return sort_calls(filter_calls(calls, options)).select(*CALL_COLUMNS)
