from __future__ import annotations

import json
from xml.etree import ElementTree

import pytest

import __spark_entry__
from evidrill.plans import cache, report
from evidrill.sources import wide

RESULT = "protein string, bf double, posterior double, q double, mean_log2fc double, sd_log2fc double"
ROWS = [("ACTB", 200.0, 0.99, 0.001, 4.0, 0.3), ("TP53", 50.0, 0.97, 0.005, 2.5, 0.4), ("BRCA1", 15.0, 0.85, 0.04, 1.8, 0.5), ("EGFR", 3.0, 0.60, 0.12, 0.8, 0.6), ("MYC", 0.8, 0.35, 0.5, -0.2, 0.7)]


def test_report_rows(spark):
    r = spark.createDataFrame(ROWS, RESULT)
    rows = {x["protein"]: x for x in json.loads(report.to_json(report.protein_rows(r)))}
    assert [rows[p]["label"] for p in ("ACTB", "TP53", "BRCA1", "EGFR", "MYC")] == ["Strong", "Strong", "Moderate", "Weak", "None"]
    assert rows["ACTB"]["fold_change"] == 16 and rows["ACTB"]["fold_lo"] < 16 < rows["ACTB"]["fold_hi"]
    assert report.counts(r) == {"n": 5, "q05": 3, "q01": 2}
    assert "3 pass" in report.methods_text(r, {"bait": "X"}) and "ACTB" in report.html_report(r, "a <b>")
    with pytest.raises(ValueError):
        report.to_json(r, 2)
    assert report.json_value(float("inf")) is None


def test_exports(spark, tmp_path):
    nodes = spark.createDataFrame([("A", True, 0.9), ("B<", False, None)], "protein string, is_bait boolean, posterior double")
    edges = spark.createDataFrame([("A", "B<", 0.5, "bait")], "source string, target string, weight double, edge_source string")
    root = ElementTree.fromstring(report.graphml(nodes, edges).encode())
    assert len(root.findall(".//{*}node")) == 2 and root.find(".//{*}edge").get("target") == "B<"
    report.export_tables(str(tmp_path), nodes=nodes, edges=edges)
    assert spark.read.csv(f"{tmp_path}/edges", header=True).count() == 1
    report.export_workbook(str(tmp_path / "x.xlsx"), edges=edges, nodes=nodes)
    assert wide.read_xlsx(str(tmp_path / "x.xlsx"), "edges")[1][:2] == ["A", "B<"]
    assert "| A |" in report.markdown_table(nodes) and "Warnings" in report.network_report(nodes, nodes, nodes, ["w"])


def test_cache_states(spark, tmp_path):
    data = spark.createDataFrame(ROWS, RESULT)
    path = str(tmp_path / "c")
    assert cache.check(spark, path, {"a": 1}, data)[0] == "MISS_NO_FILE"
    out = cache.cached(spark, path, {"a": 1}, data, lambda d: d.where("q < 0.1"))
    assert out.count() == 3
    assert cache.check(spark, path, {"a": 1}, data.repartition(3))[0] == "HIT"
    assert cache.check(spark, path, {"a": 2}, data)[0] == "MISS_CONFIG"
    assert cache.check(spark, path, {"a": 1}, data.limit(4))[0] == "MISS_DATA"
    assert cache.clear(spark, path) and not cache.clear(spark, path)


def test_entry_names():
    q, s = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(s) <= set(q) and len(q) > 90
