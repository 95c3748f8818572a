from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evidrill.llm import crf, decontam, mixing, neardup, quality_rules

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture
def folder(spark, make_docs, tmp_path):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randrange(3, 9)))
    prose = lambda n: "\n".join(" ".join(word() for _ in range(12)) + "." for _ in range(n))
    passage = " ".join(word() for _ in range(30))
    rows, labels = [], []
    for i in range(240):
        text, good = prose(rnd.randrange(6, 15)), 1
        if i % 8 == 0:
            text, good = " ".join(w + "###" for w in text.split()), 0
        elif i % 8 == 1 and i > 8:
            text = rows[i - 6][1] + " extra"
        elif i % 24 == 2:
            text += "\n" + passage
        rows.append((i, text, "en", f"s{i % 5}"))
        labels.append((i, good, 0))
    make_docs([*rows, (500, None), (501, "")]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    steps = dict(pipeline.STAGES)
    assert list(steps) == ["quality_rules", "quality_classifier", "near_dedup", "decontamination", "mixing"]
    before = docs
    want = {
        "quality_rules": lambda d: ids(quality_rules.judge(d).where("kept")),
        "quality_classifier": lambda d: ids(crf.classify(d, labels).where("predicted = 1")),
        "near_dedup": lambda d: ids(neardup.near_duplicates(d).where("kept")),
        "decontamination": lambda d: ids(decontam.scan(d, benchmark).where("not contaminated")),
        "mixing": lambda d: ids(mixing.mix_sources(d).where("copies > 0")),
    }
    for name, stage in pipeline.STAGES:
        after = stage(spark, before, folder).cache()
        assert ids(after) == want[name](before) and after.count() == len(ids(after))
        if name != "mixing":
            assert after.columns == docs.columns
        before = after
    out = pipeline.run(spark, folder)
    assert ids(out) == ids(before)
    kept = ids(out)
    assert not any(i % 8 == 0 for i in kept) and not any(i % 24 == 2 for i in kept)
    assert out.agg(F.max("copies")).first()[0] <= 3
