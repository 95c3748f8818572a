from __future__ import annotations

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark: SparkSession):
    """A documents table from texts, or (id, text) or (id, text, lang, source) rows."""

    def make(rows) -> DataFrame:
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            lang, source = (r[2], r[3]) if len(r) > 2 else ("en", "s")
            full.append((r[0], r[1], lang, source, None if r[1] is None else len(r[1])))
        return spark.createDataFrame(full, DOCS)

    return make


def clashing(df: DataFrame) -> DataFrame:
    """df with columns whose names the operators use."""
    names = ("size", "target", "taken", "copies", "key", "label", "cls", "node", "spans", "text_key", "n_words", "n_hit", "x", "centre", "g", "kept", "score", "digest", "host", "path", "rule", "component", "row", "bucket", "large", "root")
    return df.select("*", *[F.lit("clash").alias(n) for n in names if n not in df.columns])
