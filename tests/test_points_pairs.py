from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidrill.operators import mixture, network, prep
from evidrill.plans import points
from evidrill.sources import pairs


def test_histogram_has_empty_bins(spark):
    rows = spark.createDataFrame([(0.0,), (0.05,), (1.0,), (1.5,), (None,)], "p double")
    got = {r["bin"]: r["n"] for r in points.histogram(rows, "p", 10).collect()}
    assert got[0] == 2 and got[9] == 1 and sum(got.values()) == 3 and len(got) == 10


def test_quantile_pairs_of_a_normal_sample(spark):
    z = np.random.default_rng(0).normal(size=3000)
    got = points.quantile_pairs(spark.createDataFrame([(float(x),) for x in z], "z double"), "z", 9).collect()
    assert all(abs(r["sample"] - r["normal"]) < 0.15 for r in got)


def test_factor_curve_falls_with_the_threshold(spark):
    got = points.factor_curve(spark.createDataFrame([("a", 1.0, 0.5)], "protein string, mean double, sd double"), -1, 1, 1.0).orderBy("threshold").collect()
    p = [r["probability"] for r in got]
    assert p == sorted(p, reverse=True) and p[2] == pytest.approx(0.5, abs=1e-6)


def test_other_points(spark):
    r = spark.createDataFrame([("a", 0.01, 10.0, 1.0, 100.0), ("b", None, 1.0, 1.0, 1.0)], "protein string, q double, bf_enrichment double, bf_correlation double, bf_detected double")
    one = points.evidence_points(r).collect()
    assert len(one) == 1 and one[0]["log10_detected"] == pytest.approx(2) and one[0]["minus_log10_q"] == pytest.approx(2)
    fitted = spark.createDataFrame([(0.0, 1.0), (1.0, 4.0)], "fitted double, z double")
    assert {x["bin"]: x["root"] for x in points.scale_location(fitted, bins=2).collect()} == {0: 1.0, 1: 2.0}
    d = spark.createDataFrame([("a", 0.5, None, "UNCHANGED"), ("b", 0.5, 0.7, "GAINED")], "protein string, posterior_a double, posterior_b double, class string")
    assert [x["protein"] for x in points.scatter(d).collect()] == ["b"]


def test_pair_files(spark, tmp_path):
    (tmp_path / "n.csv").write_text("protein1,protein2\nx,y\nx,z\n")
    (tmp_path / "t.tsv").write_text("a\tb\n1\t2\n")
    names = spark.createDataFrame([("x", "PX"), ("y", "PY")], "id string, protein string")
    assert [tuple(r) for r in pairs.negatives(spark, [str(tmp_path / "n.csv")], names).collect()] == [("PX", "PY", 0)]
    assert pairs.read_tsv(spark, str(tmp_path / "t.tsv"), "a int, b int").first()["b"] == 2
    p = spark.createDataFrame([("9606.A", "10090.B", 500, None)], "protein1 string, protein2 string, nscore int, fscore int")
    assert {r["species"] for r in pairs.species_ids(p).collect()} == {"9606", "10090"}
    assert p.select(pairs.without_species("protein1").alias("x")).first()["x"] == "A"
    s = pairs.scaled_channels(p, ("nscore", "fscore")).first()
    assert (s["nscore"], s["fscore"]) == (0.5, 0.0)
    t = pairs.training_table(spark.createDataFrame([("B", "A", 1)], "a string, b string, label int"), spark.createDataFrame([("A", "B", 0.4)], "a string, b string, nscore double"), spark.createDataFrame([("A", "B", 0.9)], "a string, b string, dnn double"), ("nscore",)).first()
    assert t["nscore"] == 0.4 and t["dnn"] == 0.9


def test_seeds_restarts_and_steps(spark):
    rows = [(i, 0.1, 0.2, 0.15) for i in range(30)] + [(100 + i, 0.9, 0.8, 0.95) for i in range(10)]
    p = spark.createDataFrame(rows, "protein long, p1 double, p2 double, p3 double")
    w = {r["protein"]: r["w"] for r in mixture.seed_by_clusters(p).collect()}
    assert all(w[100 + i] == 1 for i in range(10)) and all(w[i] == 0 for i in range(30))
    h0 = mixture.Joint(((2.0, 20.0),) * 3)
    a, b = mixture.estimate_share_prior(p, h0, (10, 50), (50, 150))
    assert (a, b) in {(10, 50), (10, 150), (50, 50), (50, 150)}
    s = mixture.restart_summary([{"share": 0.1, "loglik": -10.0, "converged": True}, {"share": 0.11, "loglik": -11.0, "converged": False}])
    assert s["robust"] and s["converged"] == 1
    n = mixture.null_enrichment(20_000, 0.05, 3.0)
    assert np.median(n) == pytest.approx(1, abs=0.05) and (n > 3).mean() == pytest.approx(0.05, abs=0.01)
    # a linear iteration: the squared step lands nearer to the fixed point than the plain one
    x0 = np.array([1.0, 1.0])
    f = lambda x: 0.9 * x
    assert np.abs(mixture.accelerated(x0, f(x0), f(f(x0)))).max() < np.abs(f(f(x0))).max()


def test_nested_coverage_and_layouts(spark):
    m = spark.createDataFrame([(1, 1, "A", "Sample", 1, 2.0), (1, 1, "A", "Control", 1, None), (1, 1, "B", "Sample", 1, 1.0)], "protocol int, experiment int, protein string, sample_type string, replicate int, value double")
    assert {r["protein"]: len(r["cells"]) for r in prep.nested(m).collect()} == {"A": 2, "B": 1}
    c = prep.coverage(m).first()
    assert (c["proteins"], c["cells"], c["n_values"]) == (2, 3, 2)
    edges = spark.createDataFrame([("A", "B", 1.0), ("B", "C", 1.0)], "source string, target string, weight double")
    assert network.spring_layout(edges, 3).count() == 3
    assert network.scaled_sizes(network.degrees(edges)).agg(F.max("size")).first()[0] == 3.0


def test_network_run(spark):
    r = spark.createDataFrame([("bait", 1.0, 9.0, 0.0, 1.0), ("x", 0.9, 5.0, 0.01, 2.0), ("y", 0.8, 4.0, 0.02, 1.5), ("z", 0.1, 0.1, 0.5, 0.0)], "protein string, posterior double, bf double, q double, mean_log2fc double")
    pairs_ = spark.createDataFrame([("x", "y", 0.9)], "a string, b string, score double")
    got = network.run(r, "bait", pairs_)
    assert got["nodes"].count() == 3 and got["edges"].count() == 4
    s = got["statistics"].first()
    assert (s["nodes"], s["edges"]) == (3, 3) and s["density"] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        network.run(r.where("protein = 'bait'"), "bait")


def test_boosting_and_tuning(spark):
    from evidrill.operators import embeddings

    rows = spark.range(200).select(F.col("id").alias("pair"), (F.pmod(F.xxhash64("id"), F.lit(100)) / 100.0).alias("x")).withColumn("label", (F.abs(F.col("x") - 0.5) < 0.2).cast("int"))
    p = embeddings.predict_boosting(rows, embeddings.fit_boosting(rows, ["x"], trees=3))
    assert p.columns == [*rows.columns, "prior"] and embeddings.auc(p, "prior").first()["auc"] > 0.95
    ways = {"lr": (embeddings.fit_logistic, embeddings.predict_logistic), "nb": (embeddings.fit_naive_bayes, embeddings.predict_naive_bayes)}
    assert embeddings.tuned(rows, ["x"], "label", "pair", ways, folds=2)[0][0] == "nb"  # the middle of x isn't linear


def test_pit_and_regression_checks(spark):
    from evidrill.operators import diagnostics

    z = spark.createDataFrame([(0.0,), (1.959964,)], "z double")
    assert [round(r["pit"], 4) for r in diagnostics.pit_values(z).collect()] == [0.5, 0.975]
    rng = np.random.default_rng(1)
    rows = [(1, 1, p, "Sample", r, float(20 + x + (0.1 * rng.normal() if p == 2 else 0))) for r, x in enumerate(rng.normal(size=12)) for p in (1, 2)]
    m = spark.createDataFrame(rows, "protocol int, experiment int, protein long, sample_type string, replicate int, value double")
    got = {r["protein"]: r for r in diagnostics.regression_checks(m, 1, draws=100, tau_base=50.0).collect()}
    assert 0 <= got[2]["p_mean"] <= 1 and 0 <= got[2]["p_sd"] <= 1


def test_shares_splits_and_communities(spark):
    from evidrill.operators import curate, diagnostics, embeddings

    rng = np.random.default_rng(8)
    x = np.exp(np.vstack([rng.normal(0, 1, (60, 3)), rng.normal(4, 0.7, (12, 3))]))
    e = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "protein long, bf_enrichment double, bf_correlation double, bf_detected double")
    s = diagnostics.share_sensitivity(e, ("default", "stringent"), method="latent")
    assert s.count() == 2 * 72 and s.select("setting").distinct().count() == 2
    vec = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=4)]) for i in range(60)], "protein long, embedding array<double>")
    seed, value = embeddings.best_split(vec, "protein", tries=2, ratios=(0.5, 0.25, 0.25))
    assert seed in (0, 1) and -3 <= value <= 3
    c = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "protein string, community int")
    assert {r["community"]: r["n"] for r in network.community_sizes(c).collect()} == {1: 2, 2: 1}
    assert {r["protein"] for r in network.community_members(c, 1).collect()} == {"a", "b"}
    assert curate.mapping_cache_key(["b", "a", "a"], 9606) == curate.mapping_cache_key(["a", "b"], 9606)
    assert diagnostics.normal_quantile_pairs(3)[1] == pytest.approx(0)
