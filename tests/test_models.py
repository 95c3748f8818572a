from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidrill.operators import diagnostics, inference, mixture, prep, priors
from evidrill.plans.analyse import analyse


def hierarchy(spark, n=8, fold=None, seed=1, missing=0.0):
    """n proteins, 2 protocols of 2 experiments of 3 replicates; fold: protein -> shift of its samples."""
    rng = np.random.default_rng(seed)
    rows = []
    for p in range(1, n + 1):
        for protocol in (1, 2):
            for e in (1, 2):
                for kind in ("Sample", "Control"):
                    for r in (1, 2, 3):
                        v = 20 + 0.05 * p + 0.4 * rng.normal() + ((fold or {}).get(p, 0.0) if kind == "Sample" else 0.0)
                        rows.append((protocol, e, p, kind, r, None if rng.random() < missing else float(v)))
    return spark.createDataFrame(rows, "protocol int, experiment int, protein long, sample_type string, replicate int, value double")


def test_enrichment_finds_shifts_and_leaves_others(spark):
    m = hierarchy(spark, 6, {2: 3.0, 5: -2.0}, missing=0.1)
    got = {r["protein"]: r for r in inference.score_proteins(m).collect()}
    assert 1 < got[2]["mean_log2fc"] < 3.5 and got[2]["bf_enrichment"] > 10 and got[2]["direction"] == "+"
    assert got[5]["direction"] == "-" and got[5]["bf_enrichment"] < 0.2
    assert abs(got[1]["mean_log2fc"]) < 0.5 and all(r["error"] is None for r in got.values())
    assert len(got[2]["bf_by_threshold"]) == 6 and got[2]["bf_by_threshold"][0] == got[2]["bf_enrichment"]


def test_hierarchy_of_no_data_is_the_prior():
    prior = inference.Priors(5.0, 2.0, 2.0, 1.0)
    f = inference.fit_hierarchy({1: {1: np.empty(0)}}, prior)
    assert f["global"] == (pytest.approx(5.0), pytest.approx(2.0))


@pytest.mark.parametrize("nu", [None, 5.0])
def test_regression_recovers_a_slope(nu):
    rng = np.random.default_rng(3)
    x = rng.normal(size=400)
    p = np.repeat([1, 2], 200)
    y = 0.8 * x + np.where(p == 1, 1.0, 3.0) + 0.2 * rng.normal(size=400)
    if nu:
        y[::50] += 8
    fit = inference.fit_regression(x, y, p, 25.0, nu)
    for k, slope in enumerate(fit["mean"][1:3]):
        assert slope == pytest.approx(0.8, abs=0.1), k
    assert inference.slope_bayes_factor(fit) > 1


def test_waic_prefers_the_robust_model_under_outliers():
    rng = np.random.default_rng(4)
    x = rng.normal(size=200)
    y = 0.5 * x + 0.1 * rng.normal(size=200)
    y[::20] += 5
    p = np.ones(200, int)
    normal = inference.waic(inference.fit_regression(x, y, p, 100.0), y)
    robust = inference.waic(inference.fit_regression(x, y, p, 100.0, 3.0), y)
    assert robust[0] < normal[0]


def test_direction_and_p_values():
    assert inference.summary(2.0, 0.5)["direction"] == "+" and inference.summary(-1.0, 0.3)["direction"] == "-"
    assert inference.pd_to_p_value(0.975) == pytest.approx(0.05)
    with pytest.raises(ValueError):
        inference.pd_to_p_value(0.3)


def test_bayes_factor_against_the_prior():
    assert inference.bayes_factor(0, 1, 0, 1, 0) == pytest.approx(1)
    assert inference.bayes_factor(2, 1, 0, 1, 0) > 1 > inference.bayes_factor(-2, 1, 0, 1, 0)


def test_permutation_keeps_values_counts_and_the_bait(spark):
    m = hierarchy(spark, 4, missing=0.1)
    p = prep.permuted(m, bait=1, copies=2, seed=9)
    key = ["protocol", "experiment", "protein"]
    before = {tuple(r[k] for k in key): sorted(x for x in r["v"]) for r in m.groupBy(*key).agg(F.collect_list("value").alias("v")).collect()}
    for copy in (1, 2):
        one = p.where(F.col("copy") == copy)
        after = {tuple(r[k] for k in key): sorted(r["v"]) for r in one.groupBy(*key).agg(F.collect_list("value").alias("v")).collect()}
        assert before == after
        assert one.where("protein = 1").drop("copy").exceptAll(m.where("protein = 1").select(*one.drop("copy").columns)).isEmpty()
        counts = one.groupBy(*key, "sample_type").count().select("count").distinct().collect()
        assert [r[0] for r in counts] == [3]


def test_normalisation_centres_cells(spark):
    got = prep.normalized(hierarchy(spark, 3)).groupBy("protocol", "experiment", "protein").agg(F.avg("value").alias("a")).collect()
    assert all(abs(r["a"]) < 1e-9 for r in got)


def test_imputation_fills_and_repeats(spark):
    m = hierarchy(spark, 3, missing=0.3)
    a = prep.imputed(m, copies=2, seed=1)
    assert a.where("value is null").isEmpty() and a.count() == 2 * m.count()
    assert a.exceptAll(prep.imputed(m, copies=2, seed=1)).isEmpty()


def test_parameter_positions(spark):
    rows = [(1, e, 1, "Sample", 1, 1.0) for e in (1, 2, 3)] + [(2, e, 1, "Sample", 1, 1.0) for e in (1, 2)]
    m = spark.createDataFrame(rows, "protocol int, experiment int, protein long, sample_type string, replicate int, value double")
    got = {(r["protocol"], r["experiment"]): r["position"] for r in priors.parameter_positions(m).collect()}
    assert got == {(1, None): 2, (1, 1): 3, (1, 2): 4, (1, 3): 5, (2, None): 6, (2, 1): 7, (2, 2): 8}


@pytest.mark.parametrize("family", ["Clayton", "Frank", "Gumbel", "Joe", "Gaussian"])
def test_copula_densities_integrate_to_one(family):
    theta = {"Clayton": 1.5, "Frank": 3.0, "Gumbel": 1.4, "Joe": 1.5, "Gaussian": 0.4}[family]
    n = 60
    g = (np.arange(n) + 0.5) / n
    u = np.array(np.meshgrid(g, g, g)).reshape(3, -1).T
    assert np.exp(mixture.copula_logpdf(family, u, theta)).mean() == pytest.approx(1.0, abs=0.05)


def two_classes(spark, background=180, interactions=20, seed=5):
    rng = np.random.default_rng(seed)
    b = rng.normal(0, [1.2, 1.0, 1.1], (background, 3))
    i = rng.normal([4, 3, 3.5], [0.8, 0.9, 0.7], (interactions, 3))
    rows = [(k, *map(float, np.exp(x))) for k, x in enumerate(np.vstack([b, i]))]
    return spark.createDataFrame(rows, "protein long, bf_enrichment double, bf_correlation double, bf_detected double")


def test_latent_classes_separate(spark):
    e = two_classes(spark)
    s = mixture.scores(e).cache()
    c = mixture.fit_classes(s)
    assert c.means[1][0] > c.means[0][0] and 0.05 < c.shares[1] < 0.25
    got = {r["protein"]: r["posterior"] for r in mixture.class_posteriors(s, c).collect()}
    assert np.mean([got[k] > 0.5 for k in range(180, 200)]) > 0.9 and np.mean([got[k] < 0.5 for k in range(180)]) > 0.9


def test_average_of_both_mixtures_ranks_interactions_first(spark):
    got = mixture.combined(two_classes(spark, 80, 20), method="average").collect()
    p = {r["protein"]: r["posterior"] for r in got}
    assert all(0 <= x <= 1 for x in p.values())
    assert np.median([p[k] for k in range(80, 100)]) > np.median([p[k] for k in range(80)])


def test_share_priors_and_beta_fits():
    assert mixture.share_prior("APMS") == (20, 180) and mixture.share_prior("unknown") == (25, 175)
    assert mixture.beta_by_moments(0.5, 0.05) == (pytest.approx(2.0), pytest.approx(2.0))
    assert mixture.weighted_beta(0.0, 0.5, 0.05) == (2.0, 2.0)
    assert sum(mixture.bic_weights((-100, -100), (5, 5), 50)) == pytest.approx(1)


def test_whole_analysis(spark):
    fold = {1: 3.0, 5: 2.5, 7: 2.0}
    m = hierarchy(spark, 12, fold)
    r = analyse(m, bait=1, method="latent").collect()
    assert len(r) == 12 and [x["q"] for x in r] == sorted(x["q"] for x in r)
    by = {x["protein"]: x for x in r}
    assert by[5]["bf_enrichment"] > np.median([x["bf_enrichment"] for x in r])


def test_flags_moments_and_calibration(spark):
    rows = [(p, "Sample", float(i)) for p, n in ((1, 5), (2, 2), (3, 3)) for i in range(n)]
    m = spark.createDataFrame(rows, "protein long, sample_type string, value double")
    res = spark.createDataFrame([(1, 0.1), (2, 3.0), (3, 0.0)], "protein long, mean_residual double")
    got = {r["protein"]: r["flag"] for r in diagnostics.protein_flags(m, res).collect()}
    assert got == {1: "ok", 2: "fail", 3: "warning"}
    few = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    one = diagnostics.moments(few, "v").first()
    assert one["skewness"] is None and one["kurtosis"] is None
    c = spark.createDataFrame([(0, 50, 0.2, 0.3), (1, 50, 0.8, 0.7)], "bin int, n long, predicted double, observed double")
    e = diagnostics.calibration_errors(c).first()
    assert e["ece"] == pytest.approx(0.1) and e["mce"] == pytest.approx(0.1)


def test_sensitivity_summary_and_stability(spark):
    p = {"High": [0.9, 0.85, 0.95, 0.88], "Low": [0.1, 0.15, 0.12, 0.08], "Mid": [0.5, 0.6, 0.55, 0.45]}
    q = {"High": [0.001, 0.002, 0.003, 0.005], "Low": [0.2] * 4, "Mid": [0.03] * 4}
    s = spark.createDataFrame([(k, str(i), x, q[k][i]) for k, v in p.items() for i, x in enumerate(v)], "protein string, setting string, posterior double, q double")
    r = {x["protein"]: x for x in diagnostics.sensitivity_summary(s, "0").collect()}
    assert [round(r[k]["range"], 6) for k in ("High", "Low", "Mid")] == [0.10, 0.07, 0.15]
    st = {x["protein"]: x for x in diagnostics.classification_stability(s).collect()}
    assert st["High"]["q01"] == 1.0 and st["Low"]["p50"] == 0.0 and st["Mid"]["q05"] == 1.0


def test_ranks_and_intervals(spark):
    d = spark.createDataFrame([(e, k, float(v)) for e, vs in (("a", [1, 5, 9]), ("b", [2, 4, 8])) for k, v in enumerate(vs)], "entity string, draw int, value double")
    r = {(x["entity"], x["draw"]): x["rank"] for x in diagnostics.ranks(d).collect()}
    assert r["a", 0] == 2 and r["b", 0] == 1 and r["a", 2] == 1
    rng = np.random.default_rng(0)
    one = spark.createDataFrame([("x", float(v)) for v in rng.normal(size=400)], "entity string, value double")
    h = diagnostics.hpdi(one, 0.9).first()
    assert h["hi"] - h["lo"] == pytest.approx(2 * 1.645, abs=0.4)


def test_power_grows_with_size(spark):
    got = {r["size"]: r["power"] for r in diagnostics.power_curve(diagnostics.detection_power(3.0, 0.9, 0.2), (3, 12), 60, 3.0, spark).collect()}
    assert got[12] > got[3]


def test_math_of_cosine_annealing():
    assert diagnostics.cosine_annealing(0, 10, 1.0) == 1.0 and diagnostics.cosine_annealing(10, 10, 1.0) == pytest.approx(0.0)
    assert math.isclose(diagnostics.cosine_annealing(0, 10, 1.0, warmup=2), 0.5)


@pytest.mark.parametrize("nu", [None, 5.0])
def test_batches_equal_proteins_one_by_one(nu):
    rng = np.random.default_rng(0)
    rows = []
    for r in range(40):
        for p, e in ((1, 1), (1, 2), (2, 1), (3, 1), (3, 2)):
            if rng.random() < 0.15 and r:
                continue
            for arm in ("Sample", "Control"):
                rows += [(r, p, e, arm, k, rng.normal(20 + 2 * (arm == "Sample" and r % 3 == 0)) if rng.random() > 0.25 else np.nan) for k in range(4)]
    pdf = pd.DataFrame(rows, columns=["row", "protocol", "experiment", "sample_type", "replicate", "value"])
    bait = pdf[pdf["row"] == 0].rename(columns={"value": "x"}).drop(columns="row")
    prior = inference.Priors(20.0, 1.5, 2.0, 0.8, 1.3)
    got = inference._scored(pdf, 40, prior, bait, nu)
    one = inference.scorer("protein", prior, bait, nu)
    want = pd.concat([one(pdf[pdf["row"] == k].assign(protein=k)) for k in range(40)])
    for f in ("bf_enrichment", "mean_log2fc", "sd_log2fc", "pd_log2fc", "ci_lo", "ci_hi", "bf_correlation", "mean_slope", "sd_slope", "n_pairs"):
        assert np.asarray(got[f], float) == pytest.approx(want[f].to_numpy(float), rel=1e-7, nan_ok=True)
    assert list(got["direction"]) == list(want["direction"])


def test_runs_from_several_starts_end_where_one_alone_does(spark):
    p = mixture.triplets(two_classes(spark, 300, 60))
    h0 = mixture.fit_joint(mixture.triplets(two_classes(spark, 300, 0)))
    together = mixture.fit_mixtures(p, h0, (0.7, 0.9), steps=200, family="Frank")
    alone = mixture.fit_mixture(p, h0, share=0.9, steps=200, family="Frank")
    assert np.array(together[1].log) == pytest.approx(np.array(alone.log)) and all(m.converged for m in together)
    assert together[0].shares[1] == pytest.approx(together[1].shares[1], abs=0.03)
