"""The whole analysis: measurements in, one ranked row a protein out."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidrill.operators import detection, fdr, inference, mixture, prep

#: Permuted proteins of the null set, as in the reference.
NULL_SIZE = 25_000


def evidence_of(m: DataFrame, bait, prior: inference.Priors, nu: float | None = None, missing_detection: float = 0.0, bait_rows=None) -> DataFrame:
    """(protein, three Bayes factors, mean_log2fc, sd_log2fc) from one map over proteins and one aggregate."""
    scores = inference.score_proteins(m, bait, prior, nu, bait_rows).select("protein", "bf_enrichment", "bf_correlation", "mean_log2fc", "sd_log2fc")
    found = detection.detection(detection.counts(m)).select("protein", F.coalesce("bf_detected", F.lit(missing_detection)).alias("bf_detected"))
    return scores.join(found, "protein").where("bf_enrichment is not null and bf_correlation is not null")


def null_evidence(m: DataFrame, bait, prior: inference.Priors, copies: int, nu: float | None = None, seed: int = 0) -> DataFrame:
    """Evidence of proteins under permuted labels, the bait's pinned; the bait itself is left out. All copies go through one plan."""
    p = prep.permuted(m, bait, copies, seed).where(F.col("protein") != F.lit(bait))
    key = F.concat_ws("_perm", F.col("protein").cast("string"), F.col("copy").cast("string"))
    found = evidence_of(p.withColumn("protein", key).drop("copy"), bait, prior, nu, 1.0, inference.bait_frame(m, bait))
    return found.where(F.col("bf_correlation") != 0)


def copies_for(proteins: int) -> int:
    """How many permuted copies of so many proteins make a null set of NULL_SIZE."""
    return math.ceil(NULL_SIZE / max(proteins, 1))


def analyse(m: DataFrame, bait, method: str = "average", normalise: bool = False, null_copies: int | None = None, nu: float | None = None, share_prior: str = "default", prior_table: DataFrame | None = None) -> DataFrame:
    """The result table: protein, bf, posterior, q, mean_log2fc, the three factors; ordered by q, then falling fold change.

    null_copies: permuted copies of the data for the null set; by default as many as bring it to NULL_SIZE proteins.
    prior_table (protein, prior): a learned prior that replaces the mixture's share where given.
    """
    if normalise:
        m = prep.normalized(m)
    prior = inference.estimate_priors(m, bait)
    e = evidence_of(m, bait, prior, nu).cache()
    if null_copies is None and method != "latent":
        null_copies = copies_for(m.select("protein").distinct().count())
    null = null_evidence(m, bait, prior, null_copies, nu).cache() if null_copies and method != "latent" else None
    fused = mixture.combined(e, null, method, bait, share_prior)
    r = fused.join(e, "protein")
    r = fdr.updated_posterior(r.drop("posterior"), prior_table).drop("prior") if prior_table is not None else fdr.with_q(r, "posterior", "q", key="protein")
    columns = ["protein", "bf", "posterior", "q", "mean_log2fc", "bf_enrichment", "bf_correlation", "bf_detected"]
    return r.select(*columns).orderBy(F.col("q").asc_nulls_last(), F.col("mean_log2fc").desc_nulls_last(), "protein")
