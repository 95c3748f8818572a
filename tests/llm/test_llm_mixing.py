from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import clashing

from evidrill.llm import mixing


def brute_targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = float(sum(sizes.values())), set()
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        target = {s: 3.0 * sizes[s] for s in full} | {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if target[s] > 3 * sizes[s]]
        if not over:
            return target
        full.update(over)


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    size, pi = rng.integers(1, 5000, 300), rng.random(300)
    out = mixing.flight(size, pi, np.random.default_rng(1))
    assert out.sum() == pytest.approx(pi.sum()) and out @ size == pytest.approx(pi @ size)
    assert ((out > 0) & (out < 1)).sum() <= 2


def test_flight_is_unbiased():
    size, pi = np.array([3, 5, 9, 1, 7]), np.array([0.2, 0.5, 0.7, 0.4, 0.6])
    mean = np.mean([mixing.flight(size, pi, np.random.default_rng(k)) for k in range(4000)], axis=0)
    assert np.abs(mean - pi).max() < 0.03


def test_landing_tries_all():
    size, pi = np.array([10, 20, 40, 80]), np.full(4, 0.5)
    assert abs(mixing.landing(size, pi) @ size - 75) == 5


@pytest.mark.parametrize("seed", range(5))
def test_targets_by_resharing(spark, seed):
    rnd = random.Random(seed)
    sizes = {f"s{i}": int(10 ** rnd.uniform(0, 4)) for i in range(7)} | {None: 50, "zero": 0}
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}
    assert got == {s: pytest.approx(t) for s, t in brute_targets(sizes).items()}


def corpus(make_docs, n=3000, seed=3):
    rnd = random.Random(seed)
    return make_docs([(i, "w " * int(2 ** rnd.uniform(0, 9)), "en", rnd.choice(["a", "a", "a", "b", "c", None])) for i in range(n)])


def test_mix_comes_near_its_targets_and_repeats(spark, make_docs):
    docs = corpus(make_docs)
    mix = mixing.mix_sources(docs, block_rows=256).cache()
    assert mix.count() == docs.count()
    for r in mix.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("t"), F.max("copies").alias("c")).collect():
        assert abs(r["taken"] - r["t"]) <= max(5, 0.002 * r["t"]) and r["c"] <= 3
    again = mixing.mix_sources(docs.repartition(7), block_rows=256)
    assert mix.exceptAll(again).isEmpty() and again.exceptAll(mix).isEmpty()


def test_mix_of_odd_rows(spark, make_docs):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "x y z", "en", "a"), (3, "x y z", "en", "a"), (None, "q", "en", None), (None, "q", "en", None), (7, "w " * 5000, "en", "b")]
    mix = mixing.mix_sources(clashing(make_docs(rows))).collect()
    assert len(mix) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in mix)
    assert {r["taken"] for r in mix if r["size"] == 0} == {0}
    assert mixing.mix_sources(make_docs(rows).limit(0)).collect() == []
    assert [r["taken"] for r in mixing.mix_sources(make_docs([(1, None), (2, "")])).collect()] == [0, 0]


def test_mixed_documents_repeat_the_plan(spark, make_docs):
    docs = clashing(corpus(make_docs, 400))
    out = mixing.mixed_documents(docs)
    plan = mixing.mix_sources(docs).where("copies > 0")
    assert out.count() == plan.count() and out.agg(F.sum("taken")).first()[0] == plan.agg(F.sum("taken")).first()[0]
    assert set(docs.columns) <= set(out.columns)
