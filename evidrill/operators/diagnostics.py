"""Calibration, residuals, predictive checks, prior sensitivity, ranks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidrill.operators.fdr import with_q

PRIORS = ((1, 1), (2, 2), (3, 3), (5, 5), (10, 10))


def positive(rule: str) -> Column:
    """What counts as an interaction: 'strict' all three factors above 1, 'relaxed' two of them, 'enrichment' the first above 3."""
    above = [F.coalesce(F.col(c) > 1, F.lit(False)).cast("int") for c in ("bf_enrichment", "bf_correlation", "bf_detected")]
    n = above[0] + above[1] + above[2]
    rules = {"strict": n == 3, "relaxed": n >= 2, "enrichment": F.coalesce(F.col("bf_enrichment") > 3, F.lit(False))}
    return rules[rule]


def calibration(r: DataFrame, rule: str = "strict", bins: int = 10, p: str = "posterior") -> DataFrame:
    """(bin, n, predicted, observed): equal bins of the predicted probability, the last one closed; empty ones with their middle and 0."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    seen = r.where(F.col(p).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(positive(rule).cast("double")).alias("observed"))
    every = r.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(seen, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("predicted", (F.col("bin") + 0.5) / bins).alias("predicted"), F.coalesce("observed", F.lit(0.0)).alias("observed"))


def calibration_errors(c: DataFrame) -> DataFrame:
    """One row (ece, mce): mean gap weighted by rows, and the largest gap."""
    gap = F.abs(F.col("predicted") - F.col("observed"))
    return c.agg((F.sum(gap * F.col("n")) / F.greatest(F.sum("n"), F.lit(1))).alias("ece"), F.max(gap).alias("mce"))


def residuals(xy: DataFrame, lines: DataFrame) -> DataFrame:
    """(protein, e, z): residuals of pairs (protein, x, y) around lines (protein, slope, intercept), standardised by protein."""
    j = xy.join(lines.select("protein", "slope", "intercept"), "protein").where("slope is not null")
    e = j.select("protein", (F.col("y") - F.col("intercept") - F.col("slope") * F.col("x")).alias("e"))
    return e.withColumn("z", F.col("e") / F.stddev_samp("e").over(Window.partitionBy("protein")))


def moments(r: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, n, mean, sd, skewness, kurtosis): adjusted skewness (null below 3 values), excess kurtosis with the sample sd (null below 4)."""
    n = F.count(value)
    g = r.groupBy(*by).agg(n.alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.skewness(value).alias("g1"), F.kurtosis(value).alias("g2"))
    skew = F.when((F.col("n") >= 3) & (F.col("sd") > 0), F.col("g1") * F.sqrt(F.col("n") * (F.col("n") - 1)) / (F.col("n") - 2))
    kurt = F.when((F.col("n") >= 4) & (F.col("sd") > 0), (F.col("g2") + 3) * F.pow((F.col("n") - 1) / F.col("n"), F.lit(2.0)) - 3)
    return g.select(*by, "n", "mean", "sd", skew.alias("skewness"), kurt.alias("kurtosis"))


def protein_flags(m: DataFrame, mean_residual: DataFrame, least: int = 4, outlier: float = 2.0) -> DataFrame:
    """(protein, n_obs, low_data, outlier, flag): few sample values; |mean residual| above the limit; both: fail, one: warning, else ok."""
    obs = m.groupBy("protein").agg(F.count(F.when(F.col("sample_type") == "Sample", F.col("value"))).alias("n_obs"))
    j = obs.join(mean_residual.select("protein", "mean_residual"), "protein", "left")
    low, out = F.col("n_obs") < least, F.coalesce(F.abs("mean_residual") > outlier, F.lit(False))
    return j.select("protein", "n_obs", low.alias("low_data"), out.alias("outlier"), F.when(low & out, "fail").when(low | out, "warning").otherwise("ok").alias("flag"))


def ks_uniform(r: DataFrame, p: str) -> DataFrame:
    """One row (n, d): the largest excess of the empirical distribution of p over the uniform one.

    Positions come from counts of equal values, then one running sum over the distinct values of a column that is rounded to 1e-6: at most a million rows.
    """
    cells = r.where(F.col(p).isNotNull()).groupBy(F.round(p, 6).alias("x")).agg(F.count("*").alias("c"))
    up = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    s = cells.select("x", "c", F.sum("c").over(up).alias("upto"))
    total = cells.agg(F.sum("c").alias("n"))
    return s.crossJoin(F.broadcast(total)).groupBy("n").agg(F.max(F.col("upto") / F.col("n") - F.col("x")).alias("d"))


def stratified_pick(r: DataFrame, n: int, seed: int = 42, p: str = "posterior") -> DataFrame:
    """n / 4 proteins of each quarter of p (ntile by p, then protein), by the order of a hash of (seed, protein)."""
    q = r.where(F.col(p).isNotNull()).withColumn("quartile", F.ntile(4).over(Window.orderBy(p, "protein")))
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("protein").cast("string")))
    return q.withColumn("pick", F.row_number().over(Window.partitionBy("quartile").orderBy(h, "protein"))).where(F.col("pick") <= n // 4)


def top_and_random(r: DataFrame, n: int, seed: int = 42, bf: str = "bf") -> DataFrame:
    """n / 2 proteins of the largest factor, and as many of the others by the order of a hash."""
    top = r.orderBy(F.col(bf).desc_nulls_last(), "protein").limit(n // 2)
    rest = r.join(top.select("protein"), "protein", "left_anti").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("protein").cast("string"))), "protein").limit(n - n // 2)
    return top.unionByName(rest)


def predictive_checks(m: DataFrame, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(protein, p_mean, p_sd, p_range): posterior predictive p-values of a normal model of the sample values.

    Replicates come from the conjugate posterior under a flat prior; seeds hang on the protein.
    """
    kind = dict(m.dtypes)["protein"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf["value"].dropna().to_numpy()
        row: dict[str, object] = {"protein": pdf["protein"].iloc[0], "p_mean": None, "p_sd": None, "p_range": None}
        n = len(y)
        if n >= 4 and y.std() > 0:
            rng = np.random.default_rng([seed, int(pdf["h"].iloc[0]) & 0x7FFFFFFF])
            var = (n - 1) * y.var(ddof=1) / rng.chisquare(n - 1, draws)
            mu = rng.normal(y.mean(), np.sqrt(var / n))
            rep = rng.normal(mu[:, None], np.sqrt(var)[:, None], (draws, n))
            row |= {"p_mean": float((rep.mean(axis=1) >= y.mean()).mean()), "p_sd": float((rep.std(axis=1) >= y.std()).mean()), "p_range": float((np.ptp(rep, axis=1) >= np.ptp(y)).mean())}
        return pd.DataFrame([row])

    rows = m.where("sample_type = 'Sample'").select("protein", "value", F.xxhash64("protein").alias("h"))
    return rows.groupBy("protein").applyInPandas(run, f"protein {kind}, p_mean double, p_sd double, p_range double")


def count_checks(c: DataFrame, alpha: int = 3, beta: int = 3, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(protein, observed, p_difference): predictive p-value of k_sample - k_control under the beta-binomial posteriors."""
    kind = dict(c.dtypes)["protein"]

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                rng = np.random.default_rng([seed, int(row.h) & 0x7FFFFFFF])
                ns, nc = row.k_sample + row.f_sample, row.k_control + row.f_control
                s = rng.binomial(ns, rng.beta(alpha + row.k_sample, beta + row.f_sample, draws))
                k = rng.binomial(nc, rng.beta(alpha + row.k_control, beta + row.f_control, draws))
                d = row.k_sample - row.k_control
                out.append((row.protein, d, float((s - k >= d).mean())))
            yield pd.DataFrame(out, columns=["protein", "observed", "p_difference"])

    rows = c.where("f_sample >= 0 and f_control >= 0").select("protein", "k_sample", "f_sample", "k_control", "f_control", F.xxhash64("protein").alias("h"))
    return rows.mapInPandas(run, f"protein {kind}, observed long, p_difference double")


def pit_values(r: DataFrame, z: str = "z") -> DataFrame:
    """r with pit, the normal distribution function of the standardised residual."""
    from evidrill.functions.columns import normal_cdf

    return r.withColumn("pit", normal_cdf(F.col(z)))


def regression_checks(m: DataFrame, bait, nu: float | None = None, draws: int = 500, seed: int = 42, tau_base: float = 1.0) -> DataFrame:
    """(protein, p_mean, p_sd): posterior predictive p-values of the bait regression's responses, Normal or Student-t."""
    from evidrill.operators.inference import fit_regression
    from evidrill.operators.priors import with_bait

    kind = dict(m.dtypes)["protein"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["protocol", "experiment", "sample_type", "replicate"])
        y = pdf["y"].to_numpy()
        row: dict[str, object] = {"protein": pdf["protein"].iloc[0], "p_mean": None, "p_sd": None}
        if len(y) >= 4:
            fit = fit_regression(pdf["x"].to_numpy(), y, pdf["protocol"].to_numpy(), tau_base, nu)
            rng = np.random.default_rng([seed, int(pdf["h"].iloc[0]) & 0x7FFFFFFF])
            line = rng.multivariate_normal(fit["mean"], fit["cov"], draws, method="cholesky") @ fit["design"].T
            noise = rng.standard_t(nu, line.shape) / math.sqrt(tau_base) if nu else rng.normal(size=line.shape) / np.sqrt(fit["weights"])
            rep = line + noise
            row |= {"p_mean": float((rep.mean(axis=1) >= y.mean()).mean()), "p_sd": float((rep.std(axis=1) >= y.std()).mean())}
        return pd.DataFrame([row])

    pairs = with_bait(m, bait).withColumn("h", F.xxhash64("protein"))
    return pairs.groupBy("protein").applyInPandas(run, f"protein {kind}, p_mean double, p_sd double")


# --- sensitivity ----------------------------------------------------------------------------------------------------


def sensitivity(evidence: DataFrame, counts: DataFrame, priors: tuple[tuple[int, int], ...] = PRIORS, share: float = 0.1) -> DataFrame:
    """(protein, setting, posterior, q): the detection factor recomputed under each prior, the others as they are, prior odds share / (1 - share)."""
    from evidrill.operators.detection import prior_sweep

    sweep = prior_sweep(counts, list(priors)).select("protein", F.concat_ws("-", "alpha", "beta").alias("setting"), F.coalesce("bf_detected", F.lit(0.0)).alias("bf_d"))
    j = sweep.join(evidence.select("protein", "bf_enrichment", "bf_correlation"), "protein")
    odds = F.col("bf_d") * F.col("bf_enrichment") * F.col("bf_correlation") * (share / (1 - share))
    rows = j.select("protein", "setting", (odds / (1 + odds)).alias("posterior"))
    out = None
    for a, b in priors:
        one = with_q(rows.where(F.col("setting") == f"{a}-{b}"), "posterior", "q", key="protein")
        out = one if out is None else out.unionByName(one)
    return out


def share_sensitivity(evidence: DataFrame, priors: tuple[str, ...] = ("default", "permissive", "stringent"), method: str = "copula") -> DataFrame:
    """(protein, setting, posterior, q): the evidence combined anew under each named prior of the share of interactions."""
    from evidrill.operators.mixture import combined

    out = None
    for name in priors:
        one = with_q(combined(evidence, method=method, prior=name).select("protein", F.lit(name).alias("setting"), "posterior"), "posterior", "q", key="protein")
        out = one if out is None else out.unionByName(one)
    return out


def sensitivity_summary(s: DataFrame, baseline: str) -> DataFrame:
    """(protein, baseline, mean, sd, min, max, range) of the posterior over settings."""
    base = F.max(F.when(F.col("setting") == baseline, F.col("posterior")))
    return s.groupBy("protein").agg(base.alias("baseline"), F.avg("posterior").alias("mean"), F.stddev_samp("posterior").alias("sd"), F.min("posterior").alias("min"), F.max("posterior").alias("max"), (F.max("posterior") - F.min("posterior")).alias("range"))


def classification_stability(s: DataFrame) -> DataFrame:
    """Shares of settings with posterior above .5, .8, .95 and q below .05, .01."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return s.groupBy("protein").agg(share(F.col("posterior") > 0.5).alias("p50"), share(F.col("posterior") > 0.8).alias("p80"), share(F.col("posterior") > 0.95).alias("p95"), share(F.col("q") < 0.05).alias("q05"), share(F.col("q") < 0.01).alias("q01"))


def rank_correlations(s: DataFrame) -> DataFrame:
    """(a, b, rho): Spearman correlation of the posterior between settings."""
    r = s.withColumn("rank", F.rank().over(Window.partitionBy("setting").orderBy("posterior")) + (F.count("*").over(Window.partitionBy("setting", "posterior")) - 1) / 2)
    x, y = r.select("protein", F.col("setting").alias("a"), F.col("rank").alias("ra")), r.select("protein", F.col("setting").alias("b"), F.col("rank").alias("rb"))
    return x.join(y, "protein").where("a < b").groupBy("a", "b").agg(F.corr("ra", "rb").alias("rho"))


# --- ranks and intervals --------------------------------------------------------------------------------------------


def ranks(draws: DataFrame, value: str = "value") -> DataFrame:
    """(entity, draw, value) with rank: 1 for a draw's largest, ties by entity."""
    return draws.withColumn("rank", F.row_number().over(Window.partitionBy("draw").orderBy(F.col(value).desc_nulls_last(), "entity")))


def mean_ranks(r: DataFrame) -> DataFrame:
    return r.groupBy("entity").agg(F.avg("rank").alias("mean_rank"), F.percentile("rank", 0.5).alias("median_rank"))


def rank_frequency(r: DataFrame) -> DataFrame:
    """(entity, rank, share) of draws."""
    n = F.sum(F.count("*")).over(Window.partitionBy("entity"))
    return r.groupBy("entity", "rank").agg(F.count("*").alias("c"), (F.count("*") / n).alias("share")).select("entity", "rank", "share")


def hpdi(draws: DataFrame, mass: float = 0.95, value: str = "value") -> DataFrame:
    """(entity, lo, hi): the shortest interval that holds the mass of an entity's draws; of equal ones the lowest."""
    by = Window.partitionBy("entity")
    s = draws.where(F.col(value).isNotNull()).select("entity", F.col(value).alias("lo"), F.count("*").over(by).alias("n"), F.row_number().over(by.orderBy(value)).alias("i"))
    k = F.greatest(F.lit(1), F.ceil(F.lit(mass) * F.col("n"))).cast("int")
    # the upper end is the value k - 1 ranks on: each draw meets one other, no row carries the others
    ends = s.select(F.col("entity").alias("__e"), (F.col("i") - k + 1).alias("__i"), F.col("lo").alias("hi")).where("__i >= 1")
    s = s.join(ends, (F.col("entity") == F.col("__e")) & (F.col("i") == F.col("__i")))
    return s.groupBy("entity").agg(F.min(F.struct((F.col("hi") - F.col("lo")).alias("w"), "lo", "hi")).alias("b")).select("entity", "b.lo", "b.hi")


def power_curve(simulate, sizes: tuple[int, ...], runs: int, threshold: float, spark, seed: int = 0) -> DataFrame:
    """(size, power): the share of simulated runs whose factor exceeds the threshold. simulate(size, rng) gives a factor; runs are dealt out as rows."""
    rows = spark.range(len(sizes) * runs).select((F.col("id") % runs).alias("run"), F.element_at(F.array(*[F.lit(s) for s in sizes]), (F.floor(F.col("id") / runs) + 1).cast("int")).alias("size"))

    def run(batches):
        for pdf in batches:
            pdf["bf"] = [float(simulate(int(r.size), np.random.default_rng([seed, int(r.size), int(r.run)]))) for r in pdf.rename(columns={"size": "size"}).itertuples(index=False)]
            yield pdf[["size", "run", "bf"]]

    return rows.mapInPandas(run, "size int, run long, bf double").groupBy("size").agg(F.avg((F.col("bf") > threshold).cast("double")).alias("power"))


def detection_power(threshold: float, p_sample: float, p_control: float, prior: int = 3):
    """A simulator for power_curve(): counts of size replicates in each arm, scored by the detection model."""
    from evidrill.functions.dist import prob_beta_greater

    def simulate(size: int, rng: np.random.Generator) -> float:
        k, c = rng.binomial(size, p_sample), rng.binomial(size, p_control)
        p = prob_beta_greater(prior + k, prior + size - k, prior + c, prior + size - c)
        return p / max(1 - p, 1e-16)

    return simulate


def normal_quantile_pairs(n: int) -> list[float]:
    """Theoretical quantiles at (i - 1/2) / n."""
    from evidrill.functions.dist import normal_quantile

    return [normal_quantile((i - 0.5) / n) for i in range(1, n + 1)]


def cosine_annealing(step: int, total: int, high: float, low: float = 0.0, warmup: int = 0) -> float:
    if step < warmup:
        return high * (step + 1) / warmup
    share = (step - warmup) / max(1, total - warmup)
    return low + 0.5 * (high - low) * (1 + math.cos(math.pi * share))
