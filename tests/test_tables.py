from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evidrill.functions import columns as C
from evidrill.operators import curate, differential, embeddings, network
from evidrill.sources import wide

FIELDS = "protein string, bf double, posterior double, mean_log2fc double, bf_enrichment double, bf_correlation double, bf_detected double"


def condition(spark, rows):
    return spark.createDataFrame([(p, bf, post, fc, bf, bf, bf) for p, bf, post, fc in rows], FIELDS)


def test_identical_conditions_are_unchanged(spark):
    a = condition(spark, [(f"P{i}", 5.0 + i, 0.9, 1.0) for i in range(10)])
    d = differential.differential(a, a).collect()
    assert {r["class"] for r in d} == {"UNCHANGED"} and all(r["log10_dbf"] == 0 for r in d)


def test_specific_and_shared_proteins(spark):
    a = condition(spark, [(p, 1.0, 0.5, 0.0) for p in ("P1", "P2", "P3")])
    b = condition(spark, [(p, 1.0, 0.5, 0.0) for p in ("P2", "P3", "P4")])
    got = {r["protein"]: r["class"] for r in differential.differential(a, b).collect()}
    assert got["P1"] == "CONDITION_A_SPECIFIC" and got["P4"] == "CONDITION_B_SPECIFIC" and len(got) == 4
    assert sum(r["n"] for r in differential.class_counts(differential.differential(a, b)).collect()) == 4


def test_classes_by_posterior_and_by_factor(spark):
    a = condition(spark, [("gained", 100.0, 0.99, 3.0), ("reduced", 0.5, 0.1, 0.2), ("same", 50.0, 0.95, 2.0)])
    b = condition(spark, [("gained", 0.5, 0.1, 0.2), ("reduced", 100.0, 0.99, 3.0), ("same", 50.0, 0.95, 2.0)])
    got = {r["protein"]: r["class"] for r in differential.differential(a, b, differential.Thresholds(q=1.0)).collect()}
    assert got == {"gained": "GAINED", "reduced": "REDUCED", "same": "UNCHANGED"}
    a, b = condition(spark, [("x", 1000.0, 0.9, 1.0), ("y", 2.0, 0.5, 0.0)]), condition(spark, [("x", 1.0, 0.5, 0.0), ("y", 1.0, 0.5, 0.0)])
    got = {r["protein"]: r["class"] for r in differential.differential(a, b, differential.Thresholds(q=1.0, method="dbf")).collect()}
    assert got == {"x": "GAINED", "y": "UNCHANGED"}
    with pytest.raises(ValueError):
        differential.Thresholds(posterior=2)


def test_network_filter_and_star(spark):
    rows = [("A", 0.95, 100.0, 0.001, 3.5), ("B", 0.85, 50.0, 0.01, 2.8), ("C", 0.75, 20.0, 0.02, 2.1), ("D", 0.45, 2.0, 0.08, 1.2), ("E", 0.30, 0.5, 0.15, 0.5), ("F", 0.9, 5.0, None, 1.0)]
    r = spark.createDataFrame(rows, "protein string, posterior double, bf double, q double, mean_log2fc double")
    kept = network.filtered(r)
    assert {x["protein"] for x in kept.collect()} == {"A", "B", "C"}
    star = network.star(kept, "A")
    assert {x["target"] for x in star.collect()} == {"B", "C"}
    pairs = spark.createDataFrame([("C", "B", 0.7), ("B", "C", 0.5), ("B", "Z", 0.9), ("B", "B", 0.9)], "a string, b string, score double")
    e = network.enriched(star, pairs, kept)
    assert e.where("edge_source = 'database'").count() == 2


def graph(spark):
    edges = [(1, 2), (2, 3), (1, 3), (3, 4), (5, 6), (2, 1)]
    return spark.createDataFrame([(a, b, 1.0) for a, b in edges], "source long, target long, weight double")


def test_graph_measures(spark):
    g = graph(spark)
    assert {r["protein"]: r["degree"] for r in network.degrees(g).collect()} == {1: 2, 2: 2, 3: 3, 4: 1, 5: 1, 6: 1}
    assert {r["protein"]: r["component"] for r in network.components(g).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5}
    assert {r["protein"]: round(r["clustering"], 3) for r in network.clustering(g).collect()} == {1: 1.0, 2: 1.0, 3: 0.333, 4: 0.0, 5: 0.0, 6: 0.0}
    s = network.statistics(g).first()
    assert (s["nodes"], s["edges"], s["components"]) == (6, 5, 2)
    assert sum(r["pagerank"] for r in network.pagerank(g).collect()) == pytest.approx(1.0)
    b = {r["protein"]: r["betweenness"] for r in network.betweenness(g).collect()}
    assert b[3] == pytest.approx(2 / 10) and b[1] == 0
    c = {r["protein"]: r["closeness"] for r in network.closeness(g).collect()}
    assert c[3] == pytest.approx(3 / 3 * 3 / 5) and c[5] == pytest.approx(1 / 5)
    lp = {r["protein"]: r["community"] for r in network.label_propagation(g).collect()}
    assert lp[5] == lp[6] and lp[1] == lp[2] and lp[1] != lp[5]
    parts = network.greedy_modularity(g)
    assert network.modularity(g, parts).first()["modularity"] >= network.modularity(g, parts.withColumn("community", F.lit(1))).first()["modularity"]


@pytest.mark.parametrize(("raw", "parsed"), [("sp|P12345|ACTB_HUMAN", "ACTB_HUMAN"), ("tr|Q9XYZ1|", "Q9XYZ1"), ("P12345-2", "P12345"), ("HTT", "HTT"), ("x|y|z", "z"), ("ABC-1", "ABC-1")])
def test_parsed_ids(spark, raw, parsed):
    assert spark.createDataFrame([(raw,)], "id string").select(C.parsed_id(F.col("id")).alias("p")).first()["p"] == parsed


def test_curation(spark):
    ids = ["CON__P1", "rev__X", "sp|P12345|ACTB_HUMAN", "A;B; C", ";A;", "HTT", "htt", None]
    rows = spark.createDataFrame([(i, x, float(i)) for i, x in enumerate(ids)], "row long, id string, v double")
    kept = curate.without_contaminants(rows)
    assert kept.count() == 6
    parts = curate.split_groups(kept)
    assert [r["id"] for r in parts.where("row = 3").orderBy("id").collect()] == ["A", "B", "C"]
    assert parts.where("row = 4").first()["id"] == ";A;"  # a single member stays as it is
    mapping = spark.createDataFrame([("A", "S1", "ALPHA"), ("AB", "S1", "ALPHA"), ("HTT", "S2", "HTT")], "name string, string_id string, preferred_name string")
    final, log = curate.curate(rows.where("id is not null"), mapping, ["v"])
    got = {r["id"]: r["v"] for r in final.collect()}
    assert got["ALPHA"] == 3.0 and "CON__P1" not in got
    actions = {r["original"]: r["action"] for r in log.collect()}
    assert actions["A"] == "RENAME" and actions["HTT"] == "KEEP" and actions["B"] == "UNMAPPED" and actions["CON__P1"] == "REMOVE"
    assert curate.find_bait(rows, "htt").first()["row"] == 6 and curate.find_bait(rows, "Htt").first()["row"] == 5


def test_merges_by_maximum_and_mean(spark):
    rows = spark.createDataFrame([(0, "GENA", "S1", "G", 1.0), (1, "GENB", "S1", "G", None), (2, "GENC", "S1", "G", 5.0), (3, "X", None, None, 2.0)], "row long, id string, string_id string, preferred_name string, v double")
    d = curate.auto_decisions(curate.merge_candidates(rows))
    assert d.first()["approved"]
    for strategy, v in (("max", 5.0), ("mean", 3.0)):
        got = {r["id"]: r for r in curate.merge_approved(rows, d, ["v"], strategy).collect()}
        assert got["GENA"]["v"] == v and got["GENA"]["merged"] and got["X"]["v"] == 2.0
    replay = spark.createDataFrame([("S9", True, "Z")], "string_id string, approved boolean, chosen string")
    assert not curate.replayed(curate.merge_candidates(rows), replay).first()["approved"]


def test_wide_files(spark, tmp_path):
    header = ["id", *[f"c{i}" for i in range(1, 5)]]
    data = [["P1", 1.0, 2.0, 3.0, 4.0], ["P2", 5.0, None, 7.0, 8.0], ["P3", 0.5, 1.5, None, 3.5]]
    csv = tmp_path / "a.csv"
    csv.write_text("\n".join(",".join("" if x is None else str(x) for x in r) for r in [header, *data]))
    wide.write_xlsx(str(tmp_path / "b.xlsx"), {"Sheet1": [header, *data]})
    m = wide.load(spark, [str(csv), str(tmp_path / "b.xlsx")], [{1: [2, 3]}] * 2, [{1: [4, 5]}] * 2, bait="P1")
    assert m.count() == 2 * 3 * 4
    a, b = (m.where(F.col("protocol") == k).drop("protocol") for k in (1, 2))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert m.where("protocol = 2 and protein = 'P2' and sample_type = 'Sample' and replicate = 2").first()["value"] is None
    with pytest.raises(ValueError):
        wide.load(spark, [str(csv)], [{1: [2]}], [{2: [4]}])
    with pytest.raises(ValueError):
        wide.load(spark, [str(csv)], [{1: [2]}], [{1: [4]}], bait="none")
    with pytest.raises(ValueError):
        wide.read_wide(spark, "x.txt")


def test_pairs_and_classifiers(spark):
    pairs = spark.createDataFrame([("a", "b", 7.0), ("b", "a", 4.0), ("a", "c", 9.0)], "a string, b string, distance double")
    got = {r["pair"]: (r["distance"], r["label"]) for r in embeddings.pair_minimum(pairs).collect()}
    assert got == {"a_b": (4.0, 1), "a_c": (9.0, 0)}
    vec = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 0.0])], "protein string, embedding array<double>")
    e = {(r["a"], r["b"]): r for r in embeddings.embedded_pairs(pairs, vec).collect()}
    assert e["a", "b"]["similarity"] == pytest.approx(0.5**0.5) and e["a", "c"]["similarity"] == 0.0
    assert e["a", "b"]["features"] == [1.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0, -1.0]
    rows = spark.range(300).select(F.col("id").alias("pair"), (F.pmod(F.xxhash64("id"), F.lit(100)) / 100.0).alias("x"), F.lit(1.0).alias("y")).withColumn("label", (F.col("x") > 0.5).cast("int"))
    p = embeddings.predict_ensemble(rows, embeddings.fit_ensemble(rows, ["x", "y"], folds=3))
    assert embeddings.auc(p, "prior").first()["auc"] > 0.98
    c = embeddings.confusion(p, "prior").first()
    assert c["tp"] + c["fp"] + c["fn"] + c["tn"] == 300 and c["accuracy"] > 0.9
    mean, axes, values = embeddings.principal_components(vec, 2)
    assert list(mean) == [pytest.approx(2 / 3), pytest.approx(1 / 3)] and values[0] >= values[-1]
