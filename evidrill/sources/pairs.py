"""Pair tables of interaction databases, as files that were fetched before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidrill.operators.embeddings import CHANNELS


def read_tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A tab-separated table with a header, gzipped or not; columns are strings without a schema."""
    reader = spark.read.option("sep", "\t").option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def species_ids(pairs: DataFrame, a: str = "protein1", b: str = "protein2") -> DataFrame:
    """(species): the distinct prefixes before the first dot of both columns."""
    both = pairs.select(F.explode(F.array(a, b)).alias("id"))
    return both.where(F.col("id").contains(".")).select(F.substring_index("id", ".", 1).alias("species")).distinct()


def without_species(column: str):
    """The identifier after the species prefix."""
    return F.regexp_replace(F.col(column), r"^[^.]*\.", "")


def scaled_channels(pairs: DataFrame, channels: tuple[str, ...] = CHANNELS, most: float = 1000.0) -> DataFrame:
    """pairs with whole-number scores brought to 0 .. 1; missing ones are 0."""
    return pairs.select(*[c for c in pairs.columns if c not in channels], *[(F.coalesce(F.col(c), F.lit(0)) / most).alias(c) for c in channels if c in pairs.columns])


def training_table(pairs: DataFrame, scores: DataFrame, predictions: DataFrame | None = None, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """pairs (a, b[, label]) with channel scores and a network's prediction (a, b, dnn), where there are any."""
    from evidrill.functions.columns import unordered_key
    from evidrill.operators.embeddings import with_channels

    out = with_channels(pairs, scores, channels)
    if predictions is None:
        return out
    p = predictions.groupBy(unordered_key(F.col("a"), F.col("b")).alias("__k")).agg(F.max("dnn").alias("dnn"))
    return out.withColumn("__k", unordered_key(F.col("a"), F.col("b"))).join(p, "__k", "left").drop("__k")


def prediction_table(bait, proteins: DataFrame, scores: DataFrame, vectors: DataFrame, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """The bait against each other protein that has a vector, with channel scores (0 where missing)."""
    from evidrill.operators.embeddings import with_channels

    kept = proteins.where(F.col("protein") != F.lit(bait)).join(vectors.select("protein"), "protein", "left_semi")
    return with_channels(kept.select(F.lit(bait).alias("a"), F.col("protein").alias("b")), scores, channels)


def negatives(spark: SparkSession, paths: list[str], names: DataFrame, seed: int = 0) -> DataFrame:
    """Negative pairs (a, b, label 0) of several csv files (protein1, protein2), both ends translated by names (id, protein), in a hashed order."""
    raw = None
    for p in paths:
        one = spark.read.csv(p, header=True).select(F.col("protein1").alias("x"), F.col("protein2").alias("y"))
        raw = one if raw is None else raw.unionByName(one)
    if raw is None:
        raise ValueError("no files")
    a, b = names.select(F.col("id").alias("x"), F.col("protein").alias("a")), names.select(F.col("id").alias("y"), F.col("protein").alias("b"))
    return raw.join(a, "x").join(b, "y").select("a", "b", F.lit(0).alias("label")).orderBy(F.xxhash64(F.lit(seed), "a", "b"), "a", "b")
