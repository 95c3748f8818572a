"""Comparing two conditions' result tables (protein, bf, posterior, mean_log2fc, bf_enrichment, bf_correlation, bf_detected)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidrill.functions.columns import clamp, safe_log10, safe_ratio
from evidrill.operators.fdr import with_q
from evidrill.operators.prep import keep_first

FIELDS = ("bf", "posterior", "mean_log2fc", "bf_enrichment", "bf_correlation", "bf_detected")
CLASSES = ("GAINED", "REDUCED", "UNCHANGED", "BOTH_NEGATIVE", "CONDITION_A_SPECIFIC", "CONDITION_B_SPECIFIC")


@dataclass(frozen=True)
class Thresholds:
    posterior: float = 0.8
    q: float = 0.05
    log2fc: float = 1.0
    dbf: float = 1.0
    method: str = "posterior"

    def __post_init__(self) -> None:
        if not 0 <= self.posterior <= 1 or not 0 <= self.q <= 1 or self.log2fc < 0 or self.dbf < 0:
            raise ValueError("thresholds out of range")
        if self.method not in ("posterior", "dbf", "combined"):
            raise ValueError("method is 'posterior', 'dbf' or 'combined'")


def deduplicated(r: DataFrame) -> DataFrame:
    """One row a protein: of repeated ones that of the largest factor."""
    return keep_first(r, "protein", F.col("bf").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in FIELDS if c != "bf"])


def _side(r: DataFrame, name: str) -> DataFrame:
    return r.select("protein", *[F.col(c).alias(f"{c}_{name}") for c in FIELDS])


def shared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Proteins of both conditions with their differences: log10_dbf (held to +-8), ratios of the evidence, delta_log2fc, delta_posterior."""
    j = _side(a, "a").join(_side(b, "b"), "protein")
    j = j.withColumn("log10_dbf", clamp(safe_log10(F.col("bf_a")) - safe_log10(F.col("bf_b")), -8.0, 8.0))
    for c in ("bf_enrichment", "bf_correlation", "bf_detected"):
        j = j.withColumn(f"d{c}", safe_ratio(F.col(f"{c}_a"), F.col(f"{c}_b")))
    return j.withColumn("delta_log2fc", F.col("mean_log2fc_a") - F.col("mean_log2fc_b")).withColumn("delta_posterior", F.col("posterior_a") - F.col("posterior_b"))


def with_differential_q(j: DataFrame) -> DataFrame:
    """shared() with differential_posterior = dbf / (1 + dbf) and its differential_q, which is one-sided: it is small for proteins of condition A."""
    dbf = F.pow(F.lit(10.0), F.col("log10_dbf"))
    return with_q(j.withColumn("differential_posterior", dbf / (1 + dbf)), "differential_posterior", "differential_q", key="protein")


def classified(j: DataFrame, t: Thresholds) -> DataFrame:
    """with class by the method's truth table; nothing but UNCHANGED without a small differential_q."""
    sig = F.coalesce("differential_q", F.lit(1.0)) < t.q
    ia, ib = F.coalesce("posterior_a", F.lit(0.0)) > t.posterior, F.coalesce("posterior_b", F.lit(0.0)) > t.posterior
    fc, dbf = F.col("delta_log2fc"), F.col("log10_dbf")
    if t.method == "posterior":
        c = F.when(sig & ia & ~ib & (fc >= 0), "GAINED").when(sig & ~ia & ib & (fc <= 0), "REDUCED").when(sig & ia & ib & (fc > t.log2fc), "GAINED").when(sig & ia & ib & (fc < -t.log2fc), "REDUCED").when(sig & ~ia & ~ib, "BOTH_NEGATIVE")
    elif t.method == "dbf":
        c = F.when(sig & (dbf > t.dbf), "GAINED").when(sig & (dbf < -t.dbf), "REDUCED")
    else:
        far = sig & (F.abs(dbf) > t.dbf)
        c = F.when(far & ia & ~ib & (dbf > 0), "GAINED").when(far & ~ia & ib & (dbf < 0), "REDUCED")
        c = c.when(far & ia & ib & (dbf > 0) & (fc > t.log2fc), "GAINED").when(far & ia & ib & (dbf < 0) & (fc < -t.log2fc), "REDUCED")
    return j.withColumn("class", c.otherwise("UNCHANGED"))


def specific(a: DataFrame, b: DataFrame) -> DataFrame:
    """Proteins of one condition only, with its fields and their class."""
    only_a = _side(a, "a").join(b.select("protein"), "protein", "left_anti").withColumn("class", F.lit("CONDITION_A_SPECIFIC"))
    only_b = _side(b, "b").join(a.select("protein"), "protein", "left_anti").withColumn("class", F.lit("CONDITION_B_SPECIFIC"))
    return only_a.unionByName(only_b, allowMissingColumns=True)


def differential(a: DataFrame, b: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """All proteins of either condition; fields that one lacks are null."""
    a, b = deduplicated(a), deduplicated(b)
    return classified(with_differential_q(shared(a, b)), t).unionByName(specific(a, b), allowMissingColumns=True)


def class_counts(d: DataFrame) -> DataFrame:
    """(class, n) of all six classes, zeros included."""
    names = d.sparkSession.createDataFrame([(c,) for c in CLASSES], "class string")
    return names.join(d.groupBy("class").agg(F.count("*").alias("n")), "class", "left").select("class", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def volcano(r: DataFrame, log2fc: float = 1.0, q: float = 0.01) -> DataFrame:
    """(protein, mean_log2fc, minus_log10_q, significant): log2fc at least and q below its threshold."""
    y = -F.log10(clamp(F.col("q"), 2.220446049250313e-16, 1.0))
    return r.where("mean_log2fc is not null and q is not null").select("protein", "mean_log2fc", y.alias("minus_log10_q"), ((F.col("mean_log2fc") >= log2fc) & (F.col("q") < q)).alias("significant"))


def ma_points(d: DataFrame) -> DataFrame:
    """(protein, average, difference) of the fold changes of shared proteins."""
    return d.where("mean_log2fc_a is not null and mean_log2fc_b is not null").select("protein", ((F.col("mean_log2fc_a") + F.col("mean_log2fc_b")) / 2).alias("average"), (F.col("mean_log2fc_a") - F.col("mean_log2fc_b")).alias("difference"))


def summary_rows(d: DataFrame) -> DataFrame:
    """Per class: proteins, mean log10_dbf, mean delta_log2fc."""
    return d.groupBy("class").agg(F.count("*").alias("n"), F.avg("log10_dbf").alias("mean_log10_dbf"), F.avg("delta_log2fc").alias("mean_delta_log2fc"))
