"""Mixing sources to target weights by the cube method (balanced sampling).

A source that needs `ratio` times its words takes every document floor(ratio) times and once
more with the fractional probability that is left. The cube method settles those extra copies: the
flight moves the vector of probabilities along the null space of the balancing constraints (tokens
and documents of the source) until it reaches the border, so that both totals stay as they are.
A landing problem of at most LANDING + 2 documents a source is left, which is solved by trying every rounding.

The flight runs in blocks of bounded size. At most LANDING + 2 documents of a block stay undecided; these
go on to the next round of blocks, until a source has one block left, which lands. Each
round reads a small fraction of the one before, so neither a hot source nor the driver
gathers documents.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidrill.llm.common import cut, small

#: Documents in one flight. A block is one pandas group of two numbers a row.
BLOCK_ROWS = 4096
#: Weights by the rank of the source, repeating.
WEIGHTS = (5, 2, 1)
#: No source is taken more than so many times.
MAX_REPEATS = 3

#: Documents of each block, of all sizes, that stay out of its flight, so that the landing has something to choose from.
LANDING = 16

EPS = 1e-9


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and the controls tab to carriage return; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    The targets are min(cap, level * weight), cap = max_repeats * source_size, at the level at
    which they add up to the sum of all sizes: what repeated resharing of the excess ends in. Sources that reach
    their cap first are found by sorting on cap / weight. The windows run over the one-row-a-source table.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("w", weight)
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_repeats))).withColumn("full_at", F.col("cap") / F.col("w"))
    up = Window.orderBy("full_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    on = Window.orderBy("full_at", "rank").rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy("full_at", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    ranked = ranked.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / F.sum("w").over(on))
    # the first source that the level reached with all before it at their caps doesn't fill
    ranked = ranked.withColumn("stop", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "rank", "level"))).over(everything))
    return ranked.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("stop.level"), F.lit(math.inf)) * F.col("w")).alias("target"))


def _direction(size: np.ndarray) -> np.ndarray:
    """A vector of the null space of the rows (size, 1), over three documents or over two of one size."""
    if len(size) == 2:
        return np.array([1.0, -1.0])
    a, b, c = size
    u = np.array([b - c, c - a, a - b])
    return u if np.any(u) else np.array([1.0, -1.0, 0.0])


def _step(pi: np.ndarray, u: np.ndarray, draw: float) -> np.ndarray:
    """Moves pi along u or against it to the border, with the chances that keep its mean."""
    with np.errstate(divide="ignore", invalid="ignore"):
        ahead = np.min(np.where(u > 0, (1 - pi) / u, np.where(u < 0, -pi / u, np.inf)))
        back = np.min(np.where(u > 0, pi / u, np.where(u < 0, (pi - 1) / u, np.inf)))
    moved = pi + ahead * u if draw * (ahead + back) < back else pi - back * u
    moved[moved < EPS] = 0.0
    moved[moved > 1 - EPS] = 1.0
    return moved


def flight(size: np.ndarray, pi: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The probabilities after the flight: 0 or 1 but for two at most. Sums of pi and of pi * size stay."""
    pi, size = pi.astype(float).copy(), size.astype(float)
    draws = rng.random(len(pi) + 2)
    live: list[int] = []
    n = 0
    for k in range(len(pi)):
        if EPS < pi[k] < 1 - EPS:
            live.append(k)
            if len(live) == 3:
                pi[live] = _step(pi[live], _direction(size[live]), draws[n])
                n += 1
                live = [i for i in live if EPS < pi[i] < 1 - EPS]
    if len(live) == 2 and size[live[0]] == size[live[1]]:
        pi[live] = _step(pi[live], np.array([1.0, -1.0]), draws[n])
    return np.where(pi > 1 - EPS, 1.0, np.where(pi < EPS, 0.0, pi))


def landing(size: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """The rounding of a few probabilities whose tokens come nearest to sum(pi * size), then whose documents
    come nearest to sum(pi); of all 2 ** n."""
    pi, size = pi.astype(float).copy(), size.astype(float)
    live = np.flatnonzero((pi > EPS) & (pi < 1 - EPS))
    if len(live):
        subsets = (np.arange(2 ** len(live))[:, None] >> np.arange(len(live))) & 1
        tokens = np.abs(subsets @ size[live] - pi[live] @ size[live])
        documents = np.abs(subsets.sum(axis=1) - pi[live].sum())
        pi[live] = subsets[np.lexsort((documents, tokens.round(6)))[0]]
    return pi


def _fly(land: bool, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True], kind="stable")
        rng = np.random.default_rng([seed, len(pdf), int(pdf["key"].iloc[0]) & 0xFFFFFFFF])
        size, pi = pdf["size"].to_numpy(), pdf["pi"].to_numpy(dtype=float).copy()
        kept_out = np.unique(np.linspace(0, len(pi) - 1, LANDING).astype(int))
        flown = np.setdiff1d(np.arange(len(pi)), kept_out)
        pi[flown] = flight(size[flown], pi[flown], rng)
        pdf["pi"] = landing(size, pi) if land else pi
        return pdf[["source", "key", "size", "pi", "n"]]

    return run


def _blocks(units: DataFrame, counts: DataFrame, block_rows: int) -> DataFrame:
    """units with their block: as many blocks a source as its undecided documents need."""
    counts = counts.withColumnRenamed("source", "__source")
    joined = units.join(counts, units["source"].eqNullSafe(counts["__source"])).drop("__source")
    return joined.withColumn("block", F.pmod(F.xxhash64("key", "left"), F.greatest(F.lit(1), F.ceil(F.col("left") / F.lit(block_rows)))))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, source, size, copy, source_size, target, copies, taken), one row for each row of docs.

    docs: doc_id, text, source; other columns are ignored, whatever their names. copies says how often the mix has
    the document, taken = copies * size. Null texts and texts without words have size 0 and take 0 words; null
    sources form one source, the last. Rows with the same doc_id and size are alike for the mix: each is settled
    on its own, told apart by its number among them (copy, from 1). The draws hang on seed, doc_id and size alone,
    so reruns agree. An empty input gives an empty result.
    """
    base = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(sizes, weights, max_repeats))
    t = targets.select(F.col("source").alias("__source"), "source_size", "target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # rows that agree in all that counts are one row with a number, so that repeated rows need no order of their own
    alike = base.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    units = alike.join(t, F.col("source").eqNullSafe(F.col("__source"))).withColumn("ratio", ratio)
    whole = F.least(F.floor(F.col("ratio") + F.lit(EPS)), F.lit(max_repeats))
    units = cut(units.select("doc_id", "source", "size", "n", "source_size", "target", whole.alias("whole"), F.greatest(F.lit(0.0), F.col("ratio") - whole).alias("part"), F.xxhash64(F.lit(seed), "doc_id", "size", "source").alias("key")))
    schema = "source string, key long, size long, pi double, n long"
    # all rows of a repeated row but one have no fraction of their own: their whole number is settled below
    todo = units.where(F.col("part") > EPS).select("source", "key", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"), "size", F.col("part").alias("pi"))
    todo = todo.select("source", F.xxhash64("key", "copy").alias("key"), "size", "pi", F.col("key").alias("n"))
    settled: list[DataFrame] = []
    while True:
        counts = cut(todo.groupBy("source").agg(F.count("*").alias("left")))
        most = counts.agg(F.max("left")).first()[0] or 0
        if not most:
            break
        land = most <= block_rows
        moved = cut(_blocks(todo, counts, block_rows).groupBy("source", "block").applyInPandas(_fly(land, seed), schema))
        settled.append(moved.where("pi = 1"))
        if land:
            break
        todo = moved.where("pi > 0 and pi < 1")
    if settled:
        won = settled[0]
        for more in settled[1:]:
            won = won.unionByName(more)
        won = won.groupBy(F.col("n").alias("key")).agg(F.count("*").alias("won"))
        units = units.join(won, "key", "left")
    else:
        units = units.withColumn("won", F.lit(0).cast("long"))
    won = F.coalesce(F.col("won"), F.lit(0))
    rows = units.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("copies", F.col("whole") + F.when(F.col("copy") <= won, 1).otherwise(0))
    return rows.select("doc_id", "source", "size", "copy", "source_size", "target", F.col("copies").cast("long").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))


MIX_COLUMNS = ("size", "source_size", "target", "copies", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs that it takes, with their columns and MIX_COLUMNS (which replace columns of docs of
    these names); copies says how often a row stands in the mix."""
    plan = cut(mix_sources(docs, **options))
    mix = cut(plan.where("copies > 0").select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__n"), F.col("copy").alias("__c"), *[F.col(c).alias(f"__{c}") for c in MIX_COLUMNS]))
    rows = docs.withColumn("__words", word_count(F.col("text")))
    if plan.where("copy > 1").isEmpty():
        rows = rows.withColumn("__copy", F.lit(1))
    else:  # rows that agree in id, source and size are told apart by their number, for which they have to meet
        rows = rows.withColumn("__copy", F.row_number().over(Window.partitionBy("doc_id", "source", "__words").orderBy("text")))
    on = rows["doc_id"].eqNullSafe(mix["__d"]) & rows["source"].eqNullSafe(mix["__s"]) & (rows["__words"] == mix["__n"]) & (rows["__copy"] == mix["__c"])
    joined = rows.join(small(mix), on)
    return joined.select(*[docs[c] for c in docs.columns if c not in MIX_COLUMNS], *[F.col(f"__{c}").alias(c) for c in MIX_COLUMNS])
