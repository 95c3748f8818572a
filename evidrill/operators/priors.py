"""Global hyper-parameters of the models, as aggregates over measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidrill.functions.dist import fit_gamma


def precision_by_protein(m: DataFrame, least: int = 3) -> DataFrame:
    """(protein, variance, precision): the mean over protocols and arms of the variance of at least `least` values; null without any."""
    arms = m.groupBy("protein", "protocol", "sample_type").agg(F.count("value").alias("n"), F.var_samp("value").alias("v"))
    per = arms.groupBy("protein").agg(F.avg(F.when(F.col("n") >= least, F.col("v"))).alias("variance"))
    return per.withColumn("precision", F.when(F.col("variance") > 0, 1 / F.col("variance")))


def mean_prior(m: DataFrame) -> DataFrame:
    """One row (mu0, sigma0): the median of the proteins' means and the largest of their variances."""
    means = m.groupBy("protein").agg(F.avg("value").alias("mean"))
    variances = precision_by_protein(m).agg(F.max("variance").alias("sigma0"))
    return means.agg(F.percentile("mean", 0.5).alias("mu0")).crossJoin(variances)


def precision_prior(m: DataFrame, cells: int = 4000) -> tuple[float, float]:
    """(shape, scale) of a gamma distribution over the proteins' precisions, by maximum likelihood.

    The likelihood needs the mean and the mean logarithm alone, so two aggregates reach the driver.
    """
    p = precision_by_protein(m).where("precision is not null")
    n, mean, log_mean = p.agg(F.count("*"), F.avg("precision"), F.avg(F.log("precision"))).first()
    if not n:
        return 1.0, 1.0
    import math

    from evidrill.functions.dist import digamma, trigamma

    s = math.log(mean) - log_mean
    if n < 2 or s <= 1e-12:
        return fit_gamma([mean])  # type: ignore[arg-type]
    k = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(50):
        k = max(k - (math.log(k) - digamma(k) - s) / (1 / k - trigamma(k)), 1e-6)
    return k, mean / k


def with_bait(m: DataFrame, bait) -> DataFrame:
    """(protein, protocol, experiment, sample_type, replicate, x, y): the bait's value beside each value, both there.

    The bait's rows are one protein's cells: their number is that of the input files' columns.
    """
    cell = ["protocol", "experiment", "sample_type", "replicate"]
    x = m.where((F.col("protein") == F.lit(bait)) & F.col("value").isNotNull()).select(*cell, F.col("value").alias("x"))
    return m.where(F.col("value").isNotNull()).join(F.broadcast(x), cell).select("protein", *cell, "x", F.col("value").alias("y"))


def bait_lines(m: DataFrame, bait) -> DataFrame:
    """(protein, n, slope, intercept, r2): least squares of each protein on the bait; null slopes for fewer than 3 pairs."""
    xy = with_bait(m, bait).groupBy("protein")
    fit = xy.agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))
    return fit.select("protein", "n", *[F.when(F.col("n") >= 3, F.col(c)).alias(c) for c in ("slope", "intercept", "r2")])


def residual_precision(m: DataFrame, bait) -> DataFrame:
    """One row (n, variance, tau_base): the pooled residual variance around bait_lines(), its inverse (1 where unknown)."""
    xy = with_bait(m, bait).where(F.col("protein") != F.lit(bait))
    r = xy.join(bait_lines(m, bait).select("protein", "slope", "intercept"), "protein").where("slope is not null")
    r = r.select((F.col("y") - F.col("intercept") - F.col("slope") * F.col("x")).alias("e"))
    out = r.agg(F.count("e").alias("n"), F.var_samp("e").alias("variance"))
    return out.withColumn("tau_base", F.coalesce(F.when(F.col("variance") > 0, 1 / F.col("variance")), F.lit(1.0)))


def parameter_positions(m: DataFrame) -> DataFrame:
    """(protocol, experiment, position): places of the hierarchy's parameters; 1 is the global one, then each protocol and its experiments.

    experiment is null in a protocol's own row.
    """
    shape = m.groupBy("protocol").agg(F.countDistinct("experiment").alias("n"))
    before = Window.orderBy("protocol").rowsBetween(Window.unboundedPreceding, -1)
    own = shape.select("protocol", (F.lit(2) + F.coalesce(F.sum(F.col("n") + 1).over(before), F.lit(0))).alias("position"))
    experiments = m.select("protocol", "experiment").distinct().withColumn("i", F.row_number().over(Window.partitionBy("protocol").orderBy("experiment")))
    inner = experiments.join(own, "protocol").select("protocol", "experiment", (F.col("position") + F.col("i")).alias("position"))
    return own.select("protocol", F.lit(None).cast("int").alias("experiment"), "position").unionByName(inner)
