"""The whole analysis: alignments in, call tables out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.config import CallConfig
from strandloom.functions.align import usable
from strandloom.functions.paths import is_reference_path
from strandloom.operators.interval import interval_union, length_without_gaps
from strandloom.plans import breakpoints as B
from strandloom.plans import classify as C
from strandloom.plans import discordant as D
from strandloom.plans import evidence as E
from strandloom.plans import graph as G
from strandloom.plans import inference as N
from strandloom.plans import library as L
from strandloom.plans.vcf_out import vcf_rows
from strandloom.session import checkpoint


@dataclass
class CallResult:
    calls: DataFrame
    hap_events: DataFrame
    described: DataFrame
    split_support: DataFrame
    altered: DataFrame
    altered_metadata: DataFrame
    breakpoints: DataFrame
    blocks: DataFrame
    edges: DataFrame
    clusters: DataFrame
    cluster_members: DataFrame
    graph_log: DataFrame
    library: DataFrame
    pmf: DataFrame
    coverage: DataFrame

    def vcf(self, bases) -> DataFrame:
        return vcf_rows(self.calls, self.hap_events, bases)


def merged_regions(regions: DataFrame) -> DataFrame:
    """The same bases as disjoint regions that do not touch."""
    return interval_union(regions, regions, ["chrom"]).select("chrom", "lo", "hi")


def prepare_reads(alignments: DataFrame, regions: DataFrame, cfg: CallConfig) -> DataFrame:
    """Usable alignments that overlap a region, each once, with geometry and splits, without other tags."""
    reg = regions.select(F.col("chrom").alias("rname"), F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi"))
    reads = E.with_splits(E.with_geometry(alignments.where(usable())), cfg)
    return reads.join(reg, (reads["rname"] == reg["rname"]) & (reads["pos"] < reg["r_hi"]) & (reads["end"] > reg["r_lo"]),
                      "left_semi").drop("tags")


@dataclass
class Library:
    stats: DataFrame
    pmf: DataFrame
    bounds: DataFrame
    dists: DataFrame
    ranges: DataFrame
    read_len: int
    pi: float
    search_width: float


def library_model(reads: DataFrame, pairs: DataFrame, cfg: CallConfig) -> Library:
    """Insert model and mappability of each library; every table has grid-bounded size."""
    read_len = L.read_length(reads).first()[0] or 0
    hist = checkpoint(L.insert_histogram(pairs, cfg, read_len))
    stats = checkpoint(L.insert_percentiles(hist))
    pmf = checkpoint(L.insert_pmf(hist, stats, cfg))
    if stats.isEmpty():
        raise ValueError("the regions hold no usable read pairs")
    sums = L.pmf_sums(pmf)
    q = checkpoint(L.pmf_quantiles(sums, {"range_lo": cfg.insert_qlow, "range_hi": cfg.insert_qhigh, "q99": 0.99}))
    probs = (E.mappability_model(pairs, cfg).groupBy("lib")
             .agg(F.map_from_entries(F.collect_list(F.struct("label", "prob"))).alias("_m")))
    probs = probs.select("lib", F.array(*[F.coalesce(F.try_element_at("_m", F.lit(i)), F.lit(0.0)) for i in range(5)]).alias("class_prob"))
    arrays = sums.groupBy("lib").agg(F.array_sort(F.collect_list(F.struct("x", "pmf", "cdf", "cdf_sum"))).alias("g"))
    dists = (arrays.select("lib", F.col("g.pmf").alias("pmf"), F.col("g.cdf").alias("cdf"), F.col("g.cdf_sum").alias("cdf_sum"))
             .join(probs, "lib").join(L.read_length_medians(pairs), "lib"))
    pi = L.pi_robust(pmf, cfg.robustness_parameter).first()[0]
    width = 1.1 * q.agg(F.max("q99")).first()[0]
    return Library(stats, pmf, checkpoint(L.concordance_bounds(pmf, cfg)), checkpoint(dists),
                   q.select("lib", "range_lo", "range_hi"), int(read_len), float(pi), float(width))


def call(alignments: DataFrame, regions: DataFrame, gaps: DataFrame, cfg: CallConfig = CallConfig()) -> CallResult:
    """Call rearrangements.  ``regions`` and ``gaps``: chrom, lo, hi."""
    return infer(collect_evidence(alignments, regions, gaps, cfg), regions, gaps, cfg)


@dataclass
class Evidence:
    reads: DataFrame
    lib: Library
    coverage: DataFrame
    clusters: DataFrame
    cluster_members: DataFrame
    splits: DataFrame
    breakpoints: DataFrame
    members: DataFrame


def collect_evidence(alignments: DataFrame, regions: DataFrame, gaps: DataFrame, cfg: CallConfig) -> Evidence:
    """First pass: library model, discordant clusters, splits, clips and merged breakpoints."""
    regions = checkpoint(merged_regions(regions))
    reads = prepare_reads(alignments, regions, cfg).persist(StorageLevel.MEMORY_AND_DISK)
    pairs = E.mates(reads).persist(StorageLevel.MEMORY_AND_DISK)
    lib = library_model(reads, pairs, cfg)
    if cfg.filter_read_through:
        dropped = pairs.where(F.col("b").isNotNull() & E.is_read_through(cfg)).select("lib", "rname", "qname")
        pairs = pairs.where(F.col("b").isNull() | ~E.is_read_through(cfg))
        clip_reads = reads.join(dropped, ["lib", "rname", "qname"], "left_anti")
    else:
        clip_reads = reads

    free = checkpoint(length_without_gaps(regions, gaps, ["chrom"]))
    cover = checkpoint(L.coverage_stats(reads, pairs, lib.stats, free, F.lit(lib.read_len)))
    disc = E.discordant_pairs(pairs, lib.bounds, cfg, lib.read_len)
    if not cfg.do_pecluster:
        disc = disc.limit(0)
    clusters, members = D.discordant_clusters(disc, lib.stats, free, cfg)
    clusters = checkpoint(clusters)
    passing = clusters.where("passing")
    pe = (members.join(passing.select(*D.KEYS, "cluster_id", F.explode(F.array("left_ci", "right_ci")).alias("ci")),
                       [*D.KEYS, "cluster_id"]).select("chrom", "ci.lo", "ci.hi", "qname", "dtype"))
    splits = checkpoint(E.split_evidence(pairs))
    clip_clusters = checkpoint(B.softclip_clusters(E.softclip_evidence(clip_reads, cfg), cfg))
    evidence = B.union_evidence(B.clip_breakpoints(clip_clusters, cfg), splits, pe)
    bps, bp_members = B.merge_breakpoints(evidence, cfg)
    bp_members = checkpoint(bp_members)
    return Evidence(reads, lib, cover, clusters, members, splits, bps, bp_members)


def infer(ev: Evidence, regions: DataFrame, gaps: DataFrame, cfg: CallConfig) -> CallResult:
    """Second pass: blocks, adjacency graph, candidate haplotypes, genotypes and calls."""
    reads, lib, bps = ev.reads, ev.lib, ev.breakpoints
    blocks = checkpoint(G.create_blocks(bps, gaps, checkpoint(merged_regions(regions))))
    placed = G.reads_on_blocks(reads, blocks, cfg, lib.read_len).select(
        "lib", "rname", "qname", "mrname", "mpos", *G.PAIR_FIELDS, "read_id").persist(StorageLevel.MEMORY_AND_DISK)
    again = E.mates(placed, fields=G.PAIR_FIELDS).persist(StorageLevel.MEMORY_AND_DISK)
    raw = G.pair_observations(again, lib.ranges, cfg).persist(StorageLevel.MEMORY_AND_DISK)
    edges = checkpoint(G.edge_support(raw, blocks))
    observations = checkpoint(G.compact_observations(raw))
    for used in (raw, again, placed):
        used.unpersist()

    n_blocks = checkpoint(blocks.groupBy("chrom").agg((F.max("idx") + 1).alias("n_genome")))
    geometry = blocks.select("chrom", "idx", (F.col("hi") - F.col("lo")).alias("len"), "gap_left", "gap_right",
                             F.lit(False).alias("novel"))
    subs = G.decompose(edges, blocks, cfg.min_edge_support)
    candidates = checkpoint(N.insertion_candidates(blocks, bps))
    all_blocks = blocks.withColumn("novel", F.lit(False))
    if not candidates.isEmpty():
        found = checkpoint(N.insertion_tests(candidates, blocks, geometry, n_blocks, observations, lib.dists,
                                             lib.search_width, lib.pi, cfg))
        edges, geometry, all_blocks, subs = add_insertions(found, edges, geometry, all_blocks, subs, n_blocks, cfg)
    subs = checkpoint(G.expand_subgraphs(subs, blocks, lib.search_width))

    found_paths, paths = N.enumerate_paths(subs, edges, n_blocks, cfg)
    paths = checkpoint(paths)
    lik, counts, constants = N.score_paths(paths, subs, geometry, observations, lib.dists, cfg)
    ref = paths.where(is_reference_path(F.col("path"), F.col("n_genome"))).select("sub", F.col("path_id").alias("ref_id"))
    typed = N.genotypes(paths, lik, counts, constants, checkpoint(ref), cfg, lib.pi)
    described = checkpoint(C.describe_calls(typed, all_blocks, cfg))
    support, split_hits = C.event_support(C.event_rows(described), ev.members)
    hap_events = checkpoint(C.haplotype_events(described, support, cfg))
    calls = checkpoint(C.call_table(described, hap_events))
    return CallResult(
        calls=calls, hap_events=hap_events, described=described,
        split_support=C.split_support_table(calls, hap_events, split_hits, ev.splits, reads),
        altered=C.altered_pieces(described, calls), altered_metadata=C.altered_metadata(described, calls),
        breakpoints=bps, blocks=blocks, edges=edges, clusters=ev.clusters, cluster_members=ev.cluster_members,
        graph_log=N.graph_log(found_paths, blocks), library=lib.stats, pmf=lib.pmf, coverage=ev.coverage)


def add_insertions(found: DataFrame, edges: DataFrame, geometry: DataFrame, all_blocks: DataFrame, subs: DataFrame,
                   n_blocks: DataFrame, cfg: CallConfig):
    """Novel blocks, their two edges and a subgraph per accepted insertion."""
    from strandloom.operators.ordered import running
    numbered = running(found.withColumn("_one", F.lit(1)), ["chrom"], "idx", {"_no": ("sum", "_one", False)})
    new = checkpoint(numbered.join(F.broadcast(n_blocks), "chrom").withColumn(
        "new_idx", (F.col("n_genome") + F.col("_no")).cast("int")))
    k = F.lit(cfg.min_edge_support).cast("bigint")
    extra = new.select("chrom", F.explode(F.array(
        F.struct((2 * F.col("idx") + 1).alias("v1"), (2 * F.col("new_idx")).alias("v2")),
        F.struct((2 * F.col("idx") + 2).alias("v1"), (2 * F.col("new_idx") + 1).alias("v2")))).alias("e")).select(
        "chrom", "e.v1", "e.v2", k.alias("support"))
    zero = F.lit(0).cast("bigint")
    geo = new.select("chrom", F.col("new_idx").alias("idx"), F.col("size").cast("bigint").alias("len"),
                     zero.alias("gap_left"), zero.alias("gap_right"), F.lit(True).alias("novel"))
    blk = new.select("chrom", F.col("new_idx").alias("idx"), zero.alias("lo"), F.col("size").cast("bigint").alias("hi"),
                     F.lit(-1).alias("seg"), *[zero.alias(c) for c in ("left_lo", "left_hi", "right_lo", "right_hi", "gap_left", "gap_right")],
                     F.lit(True).alias("novel"))
    sub = new.select("chrom", "seg", F.col("idx").cast("bigint").alias("start"), (F.col("idx") + 1).cast("bigint").alias("end"))
    return (edges.unionByName(extra), geometry.unionByName(geo), all_blocks.unionByName(blk),
            subs.withColumn("start", F.col("start").cast("bigint")).withColumn("end", F.col("end").cast("bigint")).unionByName(sub))
