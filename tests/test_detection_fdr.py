from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from evidrill.functions import columns as C
from evidrill.functions import dist
from evidrill.operators import detection, fdr


@pytest.mark.parametrize(("a", "b", "c", "d", "p"), [(13, 4, 5, 12, 0.998076202), (3, 13, 3, 13, 0.5), (18, 3, 3, 18, 0.999999735), (4, 9, 9, 4, 0.019562851)])
def test_beta_comparison_by_sum_and_by_quadrature(spark, a, b, c, d, p):
    got = spark.range(1).select(C.prob_beta_greater(*[F.lit(x) for x in (a, b, c, d)]).alias("p")).first()["p"]
    assert got == pytest.approx(p, abs=1e-8)
    assert dist.prob_beta_greater(a, b, c, d) == pytest.approx(p, abs=1e-6)


def measurements(spark, sample, control):
    rows = [("P", "Sample", i, v) for i, v in enumerate(sample)] + [("P", "Control", i, v) for i, v in enumerate(control)]
    return spark.createDataFrame(rows, "protein string, sample_type string, replicate int, value double")


def test_detection_counts_and_direction(spark):
    up = detection.detection(detection.counts(measurements(spark, [1.0] * 8 + [None], [None] * 4 + [5.0, 6.0]))).first()
    assert (up["k_sample"], up["f_sample"], up["k_control"], up["f_control"]) == (8, 1, 2, 4)
    assert up["bf_detected"] > 1 and up["p_detected"] > 0.5
    down = detection.detection(detection.counts(measurements(spark, [None] * 6 + [7.0] * 3, [1.0] * 5 + [None]))).first()
    assert down["bf_detected"] < 1


def test_negative_failures_give_null(spark):
    got = detection.detection(detection.counts(measurements(spark, [1.0, 2.0, 3.0], [1.0, 2.0]), 1, 2)).first()
    assert got["p_detected"] is None and got["bf_detected"] is None


def test_prior_sweep_has_a_row_a_prior(spark):
    c = detection.counts(measurements(spark, [1.0, 2.0], [None, None]))
    got = {(r["alpha"], r["beta"]): r["p_detected"] for r in detection.prior_sweep(c, [(1, 1), (3, 3)]).collect()}
    assert got[1, 1] > got[3, 3] > 0.5


@pytest.mark.parametrize(("p", "q"), [([0.8, 0.5, 0.3, 0.1, 0.05], [0.2, 0.35, 0.466667, 0.575, 0.65]), ([None, None], [None, None]), ([], [])])
def test_q_of_probabilities(spark, p, q):
    rows = spark.createDataFrame(list(enumerate(p)), "k int, p double")
    got = [r["q"] for r in fdr.with_q(rows, "p", key="k").orderBy("k").collect()]
    assert got == [None if x is None else pytest.approx(x, abs=1e-6) for x in q]


def test_q_of_factors_with_null_and_zero(spark):
    q = lambda bf: [r["q"] for r in fdr.q_from_bf(spark.createDataFrame(list(enumerate(bf)), "k int, bf double"), "bf", key="k").orderBy("k").collect()]
    assert q([10.0, 5.0, 2.0, 0.5, 0.1]) == [pytest.approx(x, abs=1e-6) for x in (0.090909, 0.128788, 0.196970, 0.314394, 0.433333)]
    got = q([10.0, None, 5.0, None, 2.0])
    assert got[1] is None and got[3] is None and got[0] < got[2] < got[4]
    assert q([10.0, 0.0, 5.0])[1] == 1.0


def test_q_does_not_hang_on_cells(spark):
    n = 500
    rows = spark.range(n).select("id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("p"))
    got = {r["id"]: r["q"] for r in fdr.with_q(rows, "p", key="id").collect()}
    ranked = sorted(((r["p"], r["id"]) for r in rows.collect()), key=lambda x: (-x[0], x[1]))
    total = 0.0
    for i, (p, k) in enumerate(ranked, 1):
        total += 1 - p
        assert got[k] == pytest.approx(1.0 if p == 0 else total / i, abs=1e-9)


def test_probabilities_of_factors(spark):
    rows = spark.createDataFrame([(1, 3.0), (2, 9.0), (3, 0.0), (4, float("inf")), (5, float("-inf")), (6, float("nan")), (7, None)], "k int, bf double")
    got = [r["p"] for r in rows.select("k", C.probability_of(F.col("bf")).alias("p")).orderBy("k").collect()]
    assert got == [0.75, 0.9, 0.0, 1.0, 0.0, 0.5, None]


def test_updated_posterior(spark):
    rows = spark.createDataFrame([("a", 10.0), ("b", 10.0), ("c", 0.0)], "protein string, bf double")
    prior = spark.createDataFrame([("a", 0.5), ("c", 0.5)], "protein string, prior double")
    got = {r["protein"]: r for r in fdr.updated_posterior(rows, prior).collect()}
    assert got["a"]["posterior"] == pytest.approx(10 / 11) and got["b"]["posterior"] is None and got["b"]["q"] is None
    assert got["c"]["posterior"] == 0 and got["c"]["q"] == 1


def test_model_weights_and_bic(spark):
    rows = spark.createDataFrame([(1, 100.0), (2, 100.0)], "model int, bic double")
    assert [r["weight"] for r in fdr.model_weights(rows).collect()] == [0.5, 0.5]
    assert spark.range(1).select(fdr.bic(-100.0, 7, 100).alias("b")).first()["b"] == pytest.approx(200 + 7 * math.log(100))


@pytest.mark.parametrize(("s", "w"), [(0.1, 0.744776), (0.3, 0.918405), (0.5, 0.963320), (0.7, 0.983944), (0.9, 0.995787), (0.001, 0.025616), (0.999, 0.999962)])
def test_association_weight(spark, s, w):
    assert spark.range(1).select(C.association_weight(F.lit(s)).alias("w")).first()["w"] == pytest.approx(w, abs=1e-6)


def test_channels_without_evidence_keep_the_prior(spark):
    assert spark.range(1).select(C.channel_weight([F.lit(0.0), F.lit(None).cast("double")]).alias("w")).first()["w"] == pytest.approx(0.05)


def test_distribution_functions():
    assert dist.normal_cdf(1.96) == pytest.approx(0.9750021, abs=1e-6)
    assert dist.beta_cdf([0.3], 2, 5)[0] == pytest.approx(1 - sum(math.comb(6, k) * 0.3**k * 0.7 ** (6 - k) for k in range(2)), abs=1e-10)
    assert dist.digamma(1.0) == pytest.approx(-0.5772156649, abs=1e-9)
