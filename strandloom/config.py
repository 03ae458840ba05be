"""Run parameters and presets."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class CallConfig:
    # reads and library
    min_mapq_reads: int = 20
    max_pair_distance: int = 2_000_000
    read_through_slop: int = 5
    filter_read_through: bool = False
    library_is_rf: bool = False
    inner_insert: bool = False
    random_seed: int = 204178949
    insert_max_mu_multiple: int = 3
    do_splits: bool = True
    do_pecluster: bool = True
    # soft clips and breakpoints
    max_softclip_merge_distance: int = 5
    min_softclip_support: int = 2
    min_bp_support: int = 2
    min_mapq_softclip: int = 10
    min_clipped_bases: int = 5
    min_clipped_qual: int = 15
    lowqual_trim_extra: int = 5
    max_insertion_inversion_mh: int = 25
    # discordant pairs
    insert_cutoff: float = 3.0
    cluster_max_distance_sd: int = 3
    max_ins_pair_slop: int = 20
    max_ins_cluster_slop: int = 25
    pecluster_null_reps: int = 4
    pecluster_target_fdr: float = 0.1
    bp_confidence: float = 0.95
    # graph
    min_edge_support: int = 2
    split_read_leeway: int = 2
    insert_qlow: float = 0.025
    insert_qhigh: float = 0.975
    max_back_edges: int = 2
    max_paths: int = 2000
    max_mes_extra: int = 0
    top_paths: int | None = 50  # paths compared as genotypes beside the reference; None: all
    # inference
    robustness_parameter: float = 1e-4
    allele_fractions: tuple = (0.5,)
    min_mappable: int = 20
    # output
    filter_criteria: tuple = ("INSERTION",)
    altered_flank_size: int = 1000
    min_simplesv_size: int = 50
    max_size_altered: int = 2_000_000

    @property
    def symmetric_fractions(self) -> list[float]:
        """Allele fractions f and 1-f, without the homozygous ends."""
        both = {round(f, 12) for f in self.allele_fractions}
        both |= {round(1 - f, 12) for f in self.allele_fractions}
        return sorted(both - {0.0, 1.0})

    def with_options(self, **options) -> "CallConfig":
        return replace(self, **options)


# fixed values: evidence thresholds of the named presets
PRESETS = {
    "low": {},
    "high": dict(min_softclip_support=2, min_bp_support=4, min_edge_support=3),
    "vhigh": dict(min_softclip_support=4, min_bp_support=4, min_edge_support=4),
    "highsplit": dict(max_softclip_merge_distance=2, min_softclip_support=10,
                      min_bp_support=10, min_edge_support=3),
}


def preset(name: str = "low", **options) -> CallConfig:
    return CallConfig(**{**PRESETS[name], **options})


@dataclass(frozen=True)
class Region:
    chrom: str
    start: int | None = None
    end: int | None = None
    extra: dict = field(default_factory=dict, compare=False)


def parse_region(text: str) -> Region:
    """``chrom`` or ``chrom:start-end``."""
    chrom, _, span = text.partition(":")
    if not span:
        return Region(chrom)
    lo, dash, hi = span.replace(",", "").partition("-")
    if not dash or not lo.isdigit() or not hi.isdigit():
        raise ValueError(f"region must look like chrom:start-end, got {text!r}")
    return Region(chrom, int(lo), int(hi))
