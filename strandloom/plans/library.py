"""Library statistics: insert-length histogram, density, concordance bounds, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.config import CallConfig
from strandloom.plans.evidence import insert_length


def insert_histogram(pairs: DataFrame, cfg: CallConfig, read_len: int = 0) -> DataFrame:
    """(lib, ilen, n) over non-negative insert lengths; every statistic starts from here."""
    return (pairs.where("b is not null")
            .select("lib", insert_length(cfg, read_len).cast("bigint").alias("ilen"))
            .where("ilen >= 0").groupBy("lib", "ilen").agg(F.count(F.lit(1)).alias("n")))


def insert_percentiles(hist: DataFrame) -> DataFrame:
    """Exact, linearly interpolated percentiles per library and the robust sd (IQR / 1.35)."""
    marks = [0.0015, 0.25, 0.5, 0.75, 0.9985]
    q = hist.groupBy("lib").agg(
        F.percentile("ilen", F.array(*[F.lit(m) for m in marks]), F.col("n")).alias("_q"),
        F.sum("n").alias("n_pairs"))
    return q.select("lib", "n_pairs", F.col("_q")[0].alias("q_low"), F.col("_q")[1].alias("q25"),
                    F.col("_q")[2].alias("median"), F.col("_q")[3].alias("q75"),
                    F.col("_q")[4].alias("q_high"),
                    ((F.col("_q")[3] - F.col("_q")[1]) / 1.35).alias("robust_sd"))


def insert_pmf(hist: DataFrame, stats: DataFrame, cfg: CallConfig) -> DataFrame:
    """Gaussian kernel density on the grid 0 .. 3 * median, normalised to 1.

    The bandwidth is max(1, 0.785 IQR n^(-1/5)) over the lengths inside the grid.  Each
    histogram bar is spread over the grid points within 40 bandwidths, beyond which the kernel
    underflows, so no grid-by-data product is formed.
    """
    top = stats.select("lib", (F.col("median") * cfg.insert_max_mu_multiple).alias("xmax"))
    inside = hist.join(F.broadcast(top), "lib").where("ilen <= xmax")
    shape = inside.groupBy("lib").agg(
        F.percentile("ilen", F.array(F.lit(0.25), F.lit(0.75)), F.col("n")).alias("_q"),
        F.sum("n").alias("_n"))
    shape = shape.select("lib", F.greatest(F.lit(1.0), F.lit(0.785) * (F.col("_q")[1] - F.col("_q")[0])
                                           / F.pow(F.col("_n").cast("double"), F.lit(0.2))).alias("bw"))
    last = F.ceil(F.col("xmax")).cast("int")
    step = F.col("xmax") / last
    near = lambda sign: (F.col("ilen") + sign * 40 * F.col("bw")) / step
    bars = (inside.join(F.broadcast(shape), "lib")
            .withColumn("x", F.explode(F.sequence(
                F.greatest(F.lit(0), F.floor(near(-1)).cast("int")),
                F.least(last, F.ceil(near(1)).cast("int")))))
            .withColumn("_z", (F.col("x") * step - F.col("ilen")) / F.col("bw")))
    dens = bars.groupBy("lib", "x").agg(F.sum(F.col("n") * F.exp(-0.5 * F.col("_z") * F.col("_z"))).alias("dens"))
    grid = (top.select("lib", F.explode(F.sequence(F.lit(0), F.ceil("xmax").cast("int"))).alias("x"))
            .join(dens, ["lib", "x"], "left").na.fill(0.0, ["dens"]))
    # one row per grid point and library: at most 3 * median + 1 rows in a partition
    return grid.select("lib", "x", (F.col("dens") / F.sum("dens").over(Window.partitionBy("lib"))).alias("pmf"))


def pmf_sums(pmf: DataFrame) -> DataFrame:
    """Cumulative and double cumulative sums of the density (grid-sized partitions)."""
    upto = Window.partitionBy("lib").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    cdf = pmf.withColumn("cdf", F.sum("pmf").over(upto))
    return cdf.withColumn("cdf_sum", F.sum("cdf").over(upto))


def concordance_bounds(pmf: DataFrame, cfg: CallConfig) -> DataFrame:
    """Outermost lengths whose log density is within C^2/2 of the mode, one step further out."""
    limit = cfg.insert_cutoff ** 2 / 2
    mode = pmf.groupBy("lib").agg(F.max("pmf").alias("_mode"), F.max("x").alias("_last"))
    near = (pmf.join(F.broadcast(mode), "lib")
            .where((F.col("pmf") > 0) & (F.log("_mode") - F.log("pmf") < limit)))
    return near.groupBy("lib").agg(
        (F.min(F.when(F.col("x") >= 1, F.col("x"))) - 1).alias("min_insert"),
        (F.max(F.when(F.col("x") < F.col("_last"), F.col("x"))) + 1).alias("max_insert"))


def pmf_quantiles(sums: DataFrame, marks: dict[str, float]) -> DataFrame:
    """Smallest length whose cumulative density reaches each mark."""
    return sums.groupBy("lib").agg(*[
        F.min(F.when(F.col("cdf") >= q, F.col("x"))).alias(name) for name, q in marks.items()])


def pi_robust(pmf: DataFrame, p: float) -> DataFrame:
    """Density at which the most likely lengths hold 1-p of the mass; median over libraries."""
    down = Window.partitionBy("lib").orderBy(F.col("pmf").desc(), "x").rowsBetween(
        Window.unboundedPreceding, 0)
    reached = pmf.withColumn("_c", F.sum("pmf").over(down)).where(F.col("_c") >= 1 - p)
    return (reached.groupBy("lib").agg(F.max("pmf").alias("_pi"))
            .agg(F.percentile("_pi", F.lit(0.5)).alias("pi_robust")))


def read_length_medians(pairs: DataFrame) -> DataFrame:
    """Rounded medians of the shorter and longer read of a pair."""
    lens = (pairs.where("b is not null")
            .select("lib", F.least("a.qlen", "b.qlen").alias("s"), F.greatest("a.qlen", "b.qlen").alias("l"))
            .groupBy("lib", "s", "l").agg(F.count(F.lit(1)).alias("n")))
    return lens.groupBy("lib").agg(
        F.bround(F.percentile("s", F.lit(0.5), F.col("n"))).cast("int").alias("rlen_short"),
        F.bround(F.percentile("l", F.lit(0.5), F.col("n"))).cast("int").alias("rlen_long"))


def read_length(reads: DataFrame) -> DataFrame:
    """Longest mapped, not hard-clipped read."""
    return reads.where(~F.col("cigar").contains("H")).agg(F.max("qlen").alias("read_len"))


def coverage_stats(reads: DataFrame, pairs: DataFrame, stats: DataFrame, free_len: DataFrame, read_len: Column) -> DataFrame:
    """Sequence and physical coverage per library and contig."""
    n_reads = reads.groupBy("lib", F.col("rname").alias("chrom")).agg(F.count(F.lit(1)).alias("n_reads"))
    n_pairs = (pairs.where("b is not null").groupBy("lib", F.col("rname").alias("chrom"))
               .agg(F.count(F.lit(1)).alias("n_pairs")))
    return (n_reads.join(n_pairs, ["lib", "chrom"], "left").na.fill(0, ["n_pairs"])
            .join(free_len, "chrom").join(F.broadcast(stats.select("lib", "median")), "lib")
            .select("lib", "chrom", "n_reads", "n_pairs", "free_len",
                    (F.col("n_reads") * read_len / F.col("free_len")).alias("seq_coverage"),
                    (F.col("n_pairs") * F.col("median") / F.col("free_len")).alias("phys_coverage")))


def normal_log_density(x: Column, mu: Column, sigma: Column) -> Column:
    z = (x - mu) / sigma
    return -0.5 * z * z - F.log(sigma) - 0.5 * F.log(2 * F.pi())


def zscore(mean: Column, mu: Column, sigma: Column, n: Column) -> Column:
    return (mean - mu) / (sigma / F.sqrt(n))
