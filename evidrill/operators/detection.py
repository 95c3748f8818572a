"""Detection model: beta-binomial evidence from counts of values that are there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidrill.functions.columns import prob_beta_greater


def counts(m: DataFrame, n_samples: int | Column | None = None, n_controls: int | Column | None = None) -> DataFrame:
    """(protein, k_sample, f_sample, k_control, f_control): values that are there, and the rest of n.

    n is the number of the arm's cells of the protein unless the caller gives it, as whole files may miss a protein.
    """
    arm = lambda name: F.col("sample_type") == name
    agg = m.groupBy("protein").agg(
        F.count(F.when(arm("Sample"), F.col("value"))).alias("k_sample"),
        F.count(F.when(arm("Sample"), F.lit(1))).alias("n_sample"),
        F.count(F.when(arm("Control"), F.col("value"))).alias("k_control"),
        F.count(F.when(arm("Control"), F.lit(1))).alias("n_control"),
    )
    given = lambda n, own: F.col(own) if n is None else n if isinstance(n, Column) else F.lit(n)
    return agg.select("protein", "k_sample", (given(n_samples, "n_sample") - F.col("k_sample")).alias("f_sample"), "k_control", (given(n_controls, "n_control") - F.col("k_control")).alias("f_control"))


def detection(c: DataFrame, alpha: int | Column = 3, beta: int | Column = 3) -> DataFrame:
    """c with p_detected = P(rate in samples > rate in controls) and bf_detected = p / (1 - p); null where a count of
    failures is negative. Prior: Beta(alpha, beta) with whole numbers. p = 1 to machine precision gives a null factor."""
    alpha, beta = (x if isinstance(x, Column) else F.lit(x) for x in (alpha, beta))
    p = prob_beta_greater(alpha + F.col("k_sample"), beta + F.col("f_sample"), alpha + F.col("k_control"), beta + F.col("f_control"))
    valid = (F.col("f_sample") >= 0) & (F.col("f_control") >= 0)
    out = c.withColumn("p_detected", F.when(valid, p))
    return out.withColumn("bf_detected", F.when(F.col("p_detected") < 1, F.col("p_detected") / (1 - F.col("p_detected"))))


def prior_sweep(c: DataFrame, priors: list[tuple[int, int]]) -> DataFrame:
    """detection() under each prior (columns alpha, beta)."""
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta")) for a, b in priors])).alias("g")
    rows = c.select("*", grid).select(*c.columns, "g.alpha", "g.beta")
    return detection(rows, F.col("alpha"), F.col("beta"))
