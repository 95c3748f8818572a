"""Plots as the tables they would show."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidrill.functions.columns import EPS, clamp


def axis_limits(rows: DataFrame, value: str, low: float = 0.001, high: float = 0.999) -> DataFrame:
    """One row (lo, hi): quantiles that leave the outermost values out."""
    return rows.agg(F.percentile(value, low).alias("lo"), F.percentile(value, high).alias("hi"))


def evidence_points(r: DataFrame) -> DataFrame:
    """(protein, minus_log10_q, log10 of the three factors); rows that lack one are left out."""
    logs = [F.log10(F.col(f"bf_{x}")).alias(f"log10_{x}") for x in ("enrichment", "correlation", "detected")]
    kept = r.where("q is not null and bf_enrichment > 0 and bf_correlation > 0 and bf_detected > 0")
    return kept.select("protein", (-F.log10(clamp(F.col("q"), EPS, 1.0))).alias("minus_log10_q"), *logs)


def tornado(s: DataFrame, n: int = 20) -> DataFrame:
    """The n proteins of the widest range of sensitivity_summary(), with their ends."""
    return s.orderBy(F.col("range").desc(), "protein").limit(n).select("protein", "baseline", "min", "max", "range")


def histogram(rows: DataFrame, value: str, bins: int = 20, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(bin, n) over equal bins of low .. high, the last one closed; values outside are left out, empty bins have 0."""
    b = F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    seen = rows.where((F.col(value) >= low) & (F.col(value) <= high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(seen, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def quantile_pairs(rows: DataFrame, value: str, points: int = 99) -> DataFrame:
    """(share, sample, normal): sample quantiles at evenly spread shares beside those of the standard normal distribution."""
    from statistics import NormalDist

    shares = [(i + 1) / (points + 1) for i in range(points)]
    got = rows.agg(F.percentile(value, F.array(*[F.lit(s) for s in shares])).alias("q"))
    theory = F.array(*[F.lit(NormalDist().inv_cdf(s)) for s in shares])
    return got.select(F.explode(F.arrays_zip(F.array(*[F.lit(s) for s in shares]).alias("share"), F.col("q").alias("sample"), theory.alias("normal"))).alias("z")).select("z.share", "z.sample", "z.normal")


def scale_location(r: DataFrame, fitted: str = "fitted", residual: str = "z", bins: int = 10) -> DataFrame:
    """(bin, fitted, root): means of sqrt |residual| over bins of equal width of the fitted values."""
    w = Window.partitionBy()
    lo, hi = F.min(fitted).over(w), F.max(fitted).over(w)
    b = F.when(hi > lo, F.least(F.floor((F.col(fitted) - lo) / (hi - lo) * bins), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    return r.withColumn("bin", b).groupBy("bin").agg(F.avg(fitted).alias("fitted"), F.avg(F.sqrt(F.abs(residual))).alias("root"))


def rank_bands(ranks: DataFrame, level: float = 0.95) -> DataFrame:
    """(entity, median, lo, hi) of the ranks over draws."""
    tail = (1 - level) / 2
    return ranks.groupBy("entity").agg(F.percentile("rank", 0.5).alias("median"), F.percentile("rank", tail).alias("lo"), F.percentile("rank", 1 - tail).alias("hi"))


def scatter(d: DataFrame, metric: str = "posterior") -> DataFrame:
    """(protein, a, b, class) of shared proteins by posterior, log10 factor or fold change."""
    f = {"posterior": lambda x: F.col(f"posterior_{x}"), "bf": lambda x: F.when(F.col(f"bf_{x}") > 0, F.log10(f"bf_{x}")), "log2fc": lambda x: F.col(f"mean_log2fc_{x}")}[metric]
    return d.select("protein", f("a").alias("a"), f("b").alias("b"), "class").where("a is not null and b is not null")


def factor_curve(means: DataFrame, low: float = -10.0, high: float = 10.0, step: float = 0.1, prior_sd: float = 1.0) -> DataFrame:
    """(protein, threshold, probability, bf) of normal posteriors (protein, mean, sd) over a grid of thresholds, against a centred normal prior."""
    from evidrill.functions.columns import normal_cdf

    n = int(round((high - low) / step)) + 1
    grid = means.select("protein", "mean", "sd", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).withColumn("threshold", F.lit(low) + F.col("i") * step)
    p = 1 - normal_cdf((F.col("threshold") - F.col("mean")) / F.col("sd"))
    p0 = 1 - normal_cdf(F.col("threshold") / prior_sd)
    odds = lambda x: x / F.greatest(1 - x, F.lit(EPS))
    return grid.select("protein", "threshold", p.alias("probability"), (odds(p) / F.greatest(odds(p0), F.lit(EPS))).alias("bf"))
