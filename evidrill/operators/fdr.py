"""Bayesian false-discovery rates and posterior updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidrill.operators.iterate import cut


def with_q(rows: DataFrame, p: str, q: str = "q", key: str | None = None) -> DataFrame:
    """rows with q: the mean of 1 - p over all rows with a p at least as high, in falling order (ties by key).

    Null p has a null q and no rank; p = 0 has q = 1. Running sums go in two steps, so that no task sorts the table: rows are dealt out in ranges of
    (p, key) of like size, wherever p piles up; one running sum runs over the ranges' totals, one within each range. The ranges are cut, so that a
    task that runs again can't draw others.
    """
    order = [F.col(p).desc_nulls_last()] + ([F.col(key)] if key else [])
    ranked = cut(rows.repartitionByRange(*order).withColumn("__cell", F.spark_partition_id()))
    totals = ranked.where(F.col(p).isNotNull()).groupBy("__cell").agg(F.count("*").alias("__n"), F.sum(1 - F.col(p)).alias("__s"))
    before = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    totals = totals.select(F.col("__cell").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__s").over(before), F.lit(0.0)).alias("__s0"))
    within = Window.partitionBy("__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = ranked.withColumn("__n1", F.count("*").over(within)).withColumn("__s1", F.sum(1 - F.col(p)).over(within))
    joined = run.join(F.broadcast(totals), run["__cell"] == totals["__c"], "left")  # as many rows as ranges
    value = (F.col("__s0") + F.col("__s1")) / (F.col("__n0") + F.col("__n1"))
    out = joined.withColumn(q, F.when(F.col(p).isNull(), F.lit(None).cast("double")).when(F.col(p) == 0, F.lit(1.0)).otherwise(value))
    return out.select(*rows.columns, q) if q not in rows.columns else out.select(*rows.columns)


def q_from_bf(rows: DataFrame, bf: str, q: str = "q", key: str | None = None) -> DataFrame:
    """with_q() of bf / (1 + bf)."""
    return with_q(rows.withColumn("__p", F.col(bf) / (1 + F.col(bf))), "__p", q, key).drop("__p")


def updated_posterior(rows: DataFrame, prior: DataFrame, bf: str = "bf", key: str = "protein", probability: str = "prior") -> DataFrame:
    """rows with posterior and q from the prior odds of a left-joined prior times the Bayes factor.

    Rows without a prior have a null posterior and q; a Bayes factor of 0 gives posterior 0, a prior of 1 posterior 1.
    """
    p = prior.select(F.col(key).alias("__key"), F.col(probability).alias("__prior"))
    j = rows.join(p, rows[key] == p["__key"], "left").drop("__key")
    odds = F.col("__prior") / (1 - F.col("__prior")) * F.col(bf)
    posterior = F.when(F.col("__prior").isNull() | F.col(bf).isNull(), None).when(F.col(bf) == 0, F.lit(0.0)).when(F.col("__prior") >= 1, F.lit(1.0)).otherwise(odds / (1 + odds))
    j = j.withColumn("posterior", posterior).withColumn("prior", F.col("__prior")).drop("__prior")
    return with_q(j, "posterior", "q", key)


def bic(log_likelihood: Column | float, parameters: Column | int, n: Column | int) -> Column:
    """-2 * log-likelihood + parameters * ln n."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return -2 * as_column(log_likelihood) + as_column(parameters) * F.log(as_column(n))


def model_weights(models: DataFrame, criterion: str = "bic") -> DataFrame:
    """models with weight, in proportion to exp(-criterion / 2) relative to the best. One row a model."""
    everything = Window.partitionBy()
    raw = F.exp(-(F.col(criterion) - F.min(criterion).over(everything)) / 2)
    return models.withColumn("__w", raw).withColumn("weight", F.col("__w") / F.sum("__w").over(everything)).drop("__w")
