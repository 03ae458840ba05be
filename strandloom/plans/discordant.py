"""Discordant pair clusters, their null distribution, FDR selection and breakpoint intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.config import CallConfig
from strandloom.operators.components import largest_cliques, pair_components
from strandloom.operators.ordered import log_bin, running
from strandloom.session import checkpoint

KEYS = ["lib", "chrom", "dtype", "rep"]


def compatible(p: str, q: str, d: Column, slop: Column) -> Column:
    """Pairwise compatibility of two discordant pairs of one class."""
    c = lambda side, f: F.col(f"{side}.{f}")
    return ((F.abs(c(p, "pos1") - c(q, "pos1")) <= d) & (F.abs(c(p, "pos2") - c(q, "pos2")) <= d)
            & (F.greatest(c(p, "pos1"), c(q, "pos1")) - F.least(c(p, "pos2"), c(q, "pos2")) <= slop))


def slop_of(cfg: CallConfig) -> Column:
    """Insertion pairs may overlap a little; every other class must not touch."""
    return F.when(F.col("dtype") == "Ins", cfg.max_ins_pair_slop).otherwise(-1)


def with_distance(pairs: DataFrame, stats: DataFrame, cfg: CallConfig) -> DataFrame:
    """Adds mu, sigma, the compatibility distance ``d`` and ``slop``."""
    lib = stats.select("lib", F.col("median").alias("mu"), F.col("robust_sd").alias("sigma"))
    return (pairs.join(F.broadcast(lib), "lib")
            .withColumn("d", F.floor(F.col("mu") + cfg.cluster_max_distance_sd * F.col("sigma")))
            .withColumn("slop", slop_of(cfg)))


def cluster_pairs(pairs: DataFrame, cfg: CallConfig) -> DataFrame:
    """Cluster members.  A component that is compatible as a whole is one cluster; any other one,
    whatever its size, yields all its largest cliques.  Pairs without a partner are in none.
    """
    comp = checkpoint(pair_components(checkpoint(pairs), KEYS, "d", "slop"))
    sizes = (comp.groupBy(*KEYS, "component").agg(
        F.count(F.lit(1)).alias("n"), F.first("d").alias("_d"), F.first("slop").alias("_s"),
        F.min("pos1").alias("_a"), F.max("pos1").alias("_b"),
        F.min("pos2").alias("_e"), F.max("pos2").alias("_f"))
        .withColumn("_fate", F.when(F.col("n") == 1, "single")
                    .when((F.col("_b") - F.col("_a") <= F.col("_d"))
                          & (F.col("_f") - F.col("_e") <= F.col("_d"))
                          & (F.col("_b") - F.col("_e") <= F.col("_s")), "whole")
                    .otherwise("cliques"))
        .select(*KEYS, "component", "_fate"))
    tagged = comp.join(sizes, [*KEYS, "component"])
    base = [*KEYS, "pos1", "pos2", "ilen", "qname", "mu", "sigma"]
    whole = tagged.where("_fate = 'whole'").select(
        *base, F.xxhash64(*KEYS, "component", F.lit(0)).alias("cluster_id"))
    mixed = checkpoint(tagged.where("_fate = 'cliques'"))
    windows = largest_cliques(mixed, [*KEYS, "component"])
    cliques = (mixed.join(windows, [*KEYS, "component"])
               .where((F.col("pos1") >= F.col("x")) & (F.col("pos1") <= F.col("x") + F.col("d")) & (F.col("pos2") >= F.col("y"))
                      & (F.col("pos2") <= F.col("y") + F.col("d")) & (F.col("pos1") <= F.col("y") + F.col("slop")))
               .select(*base, F.xxhash64(*KEYS, "component", "clique").alias("cluster_id")))
    return checkpoint(whole.unionByName(cliques))


def score_clusters(members: DataFrame, cfg: CallConfig) -> DataFrame:
    """Per cluster: extent, size and likelihood ratio ``lr``."""
    agg = members.groupBy(*KEYS, "cluster_id", "mu", "sigma").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos1").alias("min_pos1"), F.max("pos1").alias("max_pos1"),
        F.min("pos2").alias("min_pos2"), F.max("pos2").alias("max_pos2"), F.sum("ilen").alias("_sum"))
    return (agg.withColumn("lr", likelihood_ratio())
            .where(~((F.col("dtype") == "Ins")
                     & (F.col("max_pos1") - F.col("min_pos2") > cfg.max_ins_cluster_slop)))
            .drop("_sum"))


def likelihood_ratio() -> Column:
    """Closed form of the normal log likelihood ratio from n, the insert sum and the extents."""
    n, mu, sigma = F.col("n"), F.col("mu"), F.col("sigma")
    excess = F.col("_sum") - n * mu
    gap = F.col("min_pos2") - F.col("max_pos1")
    shift_del = F.least(gap.cast("double"), excess / n)
    shift_ins = F.greatest(F.greatest(F.lit(0), -gap).cast("double"), -excess / n)
    two_var = 2 * sigma * sigma
    return (F.when(F.col("dtype") == "Del", (2 * shift_del * excess - n * shift_del * shift_del) / two_var)
            .when(F.col("dtype") == "Ins", (-2 * shift_ins * excess - n * shift_ins * shift_ins) / two_var)
            .otherwise(n.cast("double")))


def null_pairs(kept: DataFrame, free_len: DataFrame, cfg: CallConfig) -> DataFrame:
    """Pairs moved to uniform positions on the gap-free length with their span preserved.

    The position is a hash of the pair, the replicate and the seed, so it does not depend on
    row order, partitioning or retries.
    """
    span = F.col("pos2") - F.col("pos1")
    length = F.col("free_len")
    key = F.concat_ws("|", "lib", "dtype", "qname", "pos1", "pos2", "rep", F.lit(cfg.random_seed))
    draw = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")
    low = F.greatest(F.lit(0), -span)
    room = length - F.greatest(F.lit(0), span) - low + 1
    return (kept.join(free_len.select("chrom", "free_len"), "chrom")
            .where((F.col("dtype") != "Del")
                   | (F.col("ilen") <= F.col("mu") * cfg.insert_max_mu_multiple))
            .where(F.abs(span) < length)
            .withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(cfg.pecluster_null_reps - 1))))
            .withColumn("_span", span).withColumn("pos1", low + F.pmod(draw, room))
            .withColumn("pos2", F.col("pos1") + F.col("_span"))
            .select(*kept.columns))


def fdr_cutoffs(real: DataFrame, null: DataFrame, keys: list[str], cfg: CallConfig) -> DataFrame:
    """Lowest score per key whose estimated false discovery rate meets the target.

    Scores are reduced to one row per distinct value before any ordering; without null
    clusters everything passes (cutoff -inf), without a passing score nothing does (+inf).
    """
    reps, target = cfg.pecluster_null_reps, cfg.pecluster_target_fdr
    both = real.select(*keys, "lr", F.lit(1).alias("r"), F.lit(0).alias("z")).unionByName(
        null.select(*keys, "lr", F.lit(0).alias("r"), F.lit(1).alias("z")))
    dense = both.groupBy(*keys, "lr").agg(F.sum("r").alias("r"), F.sum("z").alias("z"))
    ranked = running(dense, keys, "lr", {"r_lt": ("sum", "r", False), "z_lt": ("sum", "z", False)},
                     bin_expr=log_bin(F.col("lr")))
    total = dense.groupBy(*keys).agg(F.sum("r").alias("m"), F.sum("z").alias("n0"))
    pi0 = F.least(F.lit(1.0), F.col("n0") / reps / F.col("m"))
    fdr = (F.col("m") * pi0 * (F.col("n0") - F.col("z_lt")) / F.col("n0")) / (F.col("m") - F.col("r_lt"))
    best = (ranked.where("r > 0").join(total, keys).where("n0 > 0").where(fdr <= target)
            .groupBy(*keys).agg(F.min("lr").alias("cutoff")))
    return (total.join(best, keys, "left")
            .select(*keys, F.col("m").alias("n_clusters"), F.col("n0").alias("n_null"),
                    F.when(F.col("n0") == 0, F.lit(float("-inf")))
                    .otherwise(F.coalesce("cutoff", F.lit(float("inf")))).alias("cutoff")))


def select_clusters(real: DataFrame, cutoffs: DataFrame, keys: list[str]) -> DataFrame:
    """Clusters with their ``passing`` flag; the cutoff table has one row per key."""
    return (real.join(cutoffs.select(*keys, "cutoff"), keys)
            .withColumn("passing", F.col("lr") >= F.col("cutoff")).drop("cutoff"))


def quantile_factor(n: Column, confidence: float) -> Column:
    """Widening factor of a uniform end point interval: (1/(1-c))^(1/(n-1))."""
    return F.pow(F.lit(1 / (1 - confidence)), 1 / (n - 1))


def uniform_ci(lo: Column, hi: Column, n: Column, confidence: float, slop: int = 5) -> tuple[Column, Column]:
    """(lower end, upper end) closed intervals for the true ends behind observed extremes."""
    q = quantile_factor(n, confidence)
    lower = F.struct(F.floor((1 - q) * (hi - lo) + lo).cast("bigint").alias("lo"), (lo + slop).alias("hi"))
    upper = F.struct((hi - slop).alias("lo"), F.ceil(q * (hi - lo) + lo).cast("bigint").alias("hi"))
    return lower, upper


def cluster_breakpoints(clusters: DataFrame, cfg: CallConfig) -> DataFrame:
    """Two breakpoint intervals per cluster, chosen by class."""
    low1, up1 = uniform_ci(F.col("min_pos1"), F.col("max_pos1"), F.col("n"), cfg.bp_confidence)
    low2, up2 = uniform_ci(F.col("min_pos2"), F.col("max_pos2"), F.col("n"), cfg.bp_confidence)
    dtype = F.col("dtype")
    left = F.when(dtype.isin("Del", "Ins", "InvL"), up1).otherwise(low1)
    right = F.when(dtype.isin("Del", "Ins", "InvR"), low2).otherwise(up2)
    return clusters.withColumn("left_ci", left).withColumn("right_ci", right)


def cluster_log(members: DataFrame, clusters: DataFrame) -> DataFrame:
    """Log rows: one for each member, with the figures of its cluster (real or null)."""
    return members.select(*KEYS, "cluster_id", "qname").join(clusters, [*KEYS, "cluster_id"]).select(
        *KEYS, "cluster_id", "min_pos1", "max_pos1", "min_pos2", "max_pos2", "n", "lr", "passing", "qname")


def discordant_clusters(pairs: DataFrame, stats: DataFrame, free_len: DataFrame,
                        cfg: CallConfig) -> tuple[DataFrame, DataFrame]:
    """(clusters with lr, passing and intervals; members) over all libraries and classes."""
    ready = with_distance(pairs.withColumn("rep", F.lit(-1)), stats, cfg)
    members = cluster_pairs(ready, cfg)
    shuffled = cluster_pairs(null_pairs(ready, free_len, cfg), cfg)
    real, null = score_clusters(members, cfg), score_clusters(shuffled, cfg)
    keys = ["lib", "chrom", "dtype"]
    cut = fdr_cutoffs(real, null, keys, cfg)
    return cluster_breakpoints(select_clusters(real, cut, keys), cfg), members
