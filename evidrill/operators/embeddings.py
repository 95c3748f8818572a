"""Pairs, embeddings and learned priors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidrill.functions.columns import cosine, pair_features, unordered_key

CHANNELS = ("nscore", "fscore", "pscore", "ascore", "escore", "dscore", "tscore")


def pair_minimum(pairs: DataFrame, limit: float = 5.0) -> DataFrame:
    """(pair, a, b, distance, label) of pairs (a, b, distance) in any order: the least distance, and whether it is within the limit."""
    return pairs.groupBy(unordered_key(F.col("a"), F.col("b")).alias("pair")).agg(F.min(F.least("a", "b")).alias("a"), F.max(F.greatest("a", "b")).alias("b"), F.min("distance").alias("distance")).withColumn("label", (F.col("distance") <= limit).cast("int"))


def with_channels(pairs: DataFrame, scores: DataFrame, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """pairs with the channel scores of the unordered pair; missing ones are 0."""
    s = scores.withColumn("__k", unordered_key(F.col("a"), F.col("b"))).groupBy("__k").agg(*[F.max(c).alias(c) for c in channels])
    j = pairs.withColumn("__k", unordered_key(F.col("a"), F.col("b"))).join(s, "__k", "left").drop("__k")
    return j.na.fill(0.0, list(channels))


def touching(pairs: DataFrame, protein) -> DataFrame:
    """Pairs with the protein at either end."""
    return pairs.where((F.col("a") == F.lit(protein)) | (F.col("b") == F.lit(protein)))


def embedded_pairs(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs (a, b, ...) whose ends both have a vector (protein, embedding): va, vb, similarity, features."""
    va = vectors.select(F.col("protein").alias("a"), F.col("embedding").alias("va"))
    vb = vectors.select(F.col("protein").alias("b"), F.col("embedding").alias("vb"))
    j = pairs.join(va, "a").join(vb, "b")
    return j.withColumn("similarity", cosine(F.col("va"), F.col("vb"))).withColumn("features", pair_features(F.col("va"), F.col("vb")))


def combined_embeddings(x: DataFrame, y: DataFrame) -> DataFrame:
    """(protein, embedding): both vectors of proteins that have both, one after the other."""
    return x.select("protein", F.col("embedding").alias("__x")).join(y.select("protein", F.col("embedding").alias("__y")), "protein").select("protein", F.concat("__x", "__y").alias("embedding"))


def mean_vector(vectors: DataFrame, *by: str) -> DataFrame:
    """(by, mean): the coordinates' means, as an array."""
    cells = vectors.select(*by, F.posexplode("embedding").alias("i", "v")).groupBy(*by, "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return cells.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))


def split_similarity(vectors: DataFrame) -> DataFrame:
    """(a, b, similarity) of the mean vectors of splits (column split)."""
    m = mean_vector(vectors, "split")
    return m.select(F.col("split").alias("a"), F.col("mean").alias("ma")).join(m.select(F.col("split").alias("b"), F.col("mean").alias("mb")), F.col("a") < F.col("b")).select("a", "b", cosine(F.col("ma"), F.col("mb")).alias("similarity"))


def split(rows: DataFrame, key: str, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 0) -> DataFrame:
    """rows with split 'train', 'validation' or 'test' by a hash of the key."""
    if abs(sum(ratios) - 1) > 1e-9 or min(ratios) < 0:
        raise ValueError("ratios must add up to 1")
    u = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) / 1_000_000
    return rows.withColumn("split", F.when(u < ratios[0], "train").when(u < ratios[0] + ratios[1], "validation").otherwise("test"))


def best_split(vectors: DataFrame, key: str, tries: int = 20, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> tuple[int, float]:
    """(seed, similarity): of some splits the one whose mean vectors are least alike."""
    found = [(split_similarity(split(vectors, key, ratios, s)).agg(F.sum("similarity")).first()[0] or 0.0, s) for s in range(tries)]
    value, seed = min(found)
    return seed, value


def confusion(p: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """One row: tp, fp, fn, tn, accuracy, precision, recall, balanced_accuracy, mcc, brier."""
    yes, real = F.col(score) >= threshold, F.col(label) == 1
    n = lambda c: F.sum(c.cast("long"))
    r = p.where(F.col(score).isNotNull() & F.col(label).isNotNull()).agg(n(yes & real).alias("tp"), n(yes & ~real).alias("fp"), n(~yes & real).alias("fn"), n(~yes & ~real).alias("tn"), F.avg((F.col(score) - F.col(label)) ** 2).alias("brier"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    product = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return r.select("tp", "fp", "fn", "tn", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ((ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2).alias("balanced_accuracy"), ratio(tp * tn - fp * fn, F.sqrt(product)).alias("mcc"), "brier")


def roc_points(p: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(score, fpr, tpr) at each distinct score, from the highest; running sums over the distinct scores (rounded to 1e-6)."""
    g = p.where(F.col(score).isNotNull()).groupBy(F.round(score, 6).alias("score")).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    up = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    total = g.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    s = g.select("score", F.sum("pos").over(up).alias("tp"), F.sum("neg").over(up).alias("fp"))
    return s.crossJoin(F.broadcast(total)).select("score", (F.col("fp") / F.greatest("N", F.lit(1))).alias("fpr"), (F.col("tp") / F.greatest("P", F.lit(1))).alias("tpr"))


def auc(p: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row (auc): the chance that a positive scores above a negative, ties a half."""
    g = p.groupBy(F.round(score, 6).alias("s")).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    below = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    w = g.select("pos", "neg", F.coalesce(F.sum("neg").over(below), F.lit(0)).alias("lower"))
    return w.agg((F.sum(F.col("pos") * (F.col("lower") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def principal_components(vectors: DataFrame, k: int = 2, share: float = 0.99) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components, variances): the leading ones, up to k or the share of variance. Sums of products come back from
    the executors: dimensions squared, whatever the number of rows. Missing coordinates count as 0."""
    d = vectors.select(F.max(F.size("embedding"))).first()[0] or 0
    if not d:
        return np.zeros(0), np.zeros((0, 0)), np.zeros(0)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q = 0, np.zeros(d), np.zeros((d, d))
        for b in batches:
            if len(b):
                x = np.nan_to_num(np.array(b["embedding"].tolist(), float))
                n, s, q = n + len(x), s + x.sum(axis=0), q + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s.tolist()], "q": [q.ravel().tolist()]})

    parts = vectors.where(F.size("embedding") == d).select("embedding").mapInPandas(sums, "n long, s array<double>, q array<double>")
    cells = parts.select(F.lit(0).alias("g"), "n", F.concat("s", "q").alias("v"))
    n = cells.agg(F.sum("n")).first()[0]
    total = cells.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()  # d + d * d numbers
    flat = np.zeros(d + d * d)
    for r in total:
        flat[r["i"]] = r["x"]
    mean = flat[:d] / n
    cov = flat[d:].reshape(d, d) / n - np.outer(mean, mean)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    values, axes = np.maximum(values[order], 0), axes[:, order]
    enough = int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), share) + 1)
    k = max(1, min(k, enough))
    axes = axes[:, :k]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(k)] < 0, -1, 1)  # a sign that doesn't hang on the solver
    return mean, axes.T, values[:k]


def projected(vectors: DataFrame, mean: np.ndarray, components: np.ndarray) -> DataFrame:
    """vectors with pc, the coordinates along the components; one expression, no Python."""
    shift = F.array(*[F.lit(float(x)) for x in mean])
    centred = F.zip_with(F.transform("embedding", lambda v: v.cast("double")), shift, lambda a, b: F.coalesce(a, F.lit(0.0)) - b)
    pc = [F.aggregate(F.zip_with(centred, F.array(*[F.lit(float(x)) for x in row]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for row in components]
    return vectors.withColumn("pc", F.array(*pc))


# --- learned priors -------------------------------------------------------------------------------------------------


def _sums_of(features: list[str], weights: np.ndarray, shift: np.ndarray, scale: np.ndarray, label: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(features) + 1
        g, h, ll, n = np.zeros(k), np.zeros((k, k)), 0.0, 0
        for b in batches:
            if len(b):
                x = np.column_stack([np.ones(len(b)), (b[features].to_numpy(float) - shift) / scale])
                y = b[label].to_numpy(float)
                p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
                g += x.T @ (y - p)
                h += x.T @ (x * (p * (1 - p))[:, None])
                ll += float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum())
                n += len(b)
        yield pd.DataFrame({"v": [[*g, *h.ravel(), ll, float(n)]]})

    return run


def fit_logistic(rows: DataFrame, features: list[str], label: str = "label", ridge: float = 1.0, steps: int = 15, tol: float = 1e-8) -> dict[str, list[float]]:
    """Logistic regression by Newton's method: a pass a step, a few sums a task. Features are standardised; the penalty spares the intercept."""
    f = [c for c in features]
    stats = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(f)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(f)]).first()
    shift = np.array([stats[f"m{i}"] or 0.0 for i in range(len(f))])
    scale = np.array([stats[f"s{i}"] or 1.0 for i in range(len(f))])
    scale[scale == 0] = 1.0
    w = np.zeros(len(f) + 1)
    penalty = np.diag([0.0, *[ridge] * len(f)])
    k = len(w)
    for _ in range(steps):
        parts = rows.select(*f, label).mapInPandas(_sums_of(f, w, shift, scale, label), "v array<double>")
        got = parts.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
        flat = np.zeros(k + k * k + 2)
        for r in got:
            flat[r["i"]] = r["x"]
        if not flat[-1]:
            break
        step = np.linalg.solve(flat[k : k + k * k].reshape(k, k) + penalty + 1e-9 * np.eye(k), flat[:k] - penalty @ w)
        w = w + step
        if np.abs(step).max() < tol:
            break
    return {"features": f, "weights": w.tolist(), "shift": shift.tolist(), "scale": scale.tolist()}


def predict_logistic(rows: DataFrame, model: dict[str, list[float]], name: str = "prior") -> DataFrame:
    z = F.lit(model["weights"][0])
    for c, w, m, s in zip(model["features"], model["weights"][1:], model["shift"], model["scale"], strict=True):
        z = z + F.lit(w) * (F.col(c) - m) / s
    return rows.withColumn(name, 1 / (1 + F.exp(-z)))


def fit_naive_bayes(rows: DataFrame, features: list[str], label: str = "label", smoothing: float = 1e-9) -> dict[str, object]:
    """Gaussian naive Bayes: one aggregate."""
    agg = [F.count("*").alias("n")] + [x for c in features for x in (F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}"))]
    found = {r[label]: r.asDict() for r in rows.groupBy(label).agg(*agg).collect()}  # one row a label
    largest = max((r[f"v_{c}"] or 0.0 for r in found.values() for c in features), default=1.0) or 1.0
    n = sum(r["n"] for r in found.values())
    return {"features": features, "classes": {k: {"share": r["n"] / n, "mean": [r[f"m_{c}"] for c in features], "var": [(r[f"v_{c}"] or 0.0) + smoothing * largest for c in features]} for k, r in found.items()}}


def predict_naive_bayes(rows: DataFrame, model: dict[str, object], name: str = "prior") -> DataFrame:
    def log_density(c: dict[str, object]):
        z = F.lit(math.log(c["share"]))
        for f, m, v in zip(model["features"], c["mean"], c["var"], strict=True):
            z = z - F.lit(0.5 * math.log(2 * math.pi * v)) - (F.col(f) - m) ** 2 / (2 * v)
        return z

    if 1 not in model["classes"] or 0 not in model["classes"]:
        return rows.withColumn(name, F.lit(1.0 if 1 in model["classes"] else 0.0))
    return rows.withColumn(name, 1 / (1 + F.exp(F.least(F.lit(700.0), log_density(model["classes"][0]) - log_density(model["classes"][1])))))


def fit_ensemble(rows: DataFrame, features: list[str], label: str = "label", key: str = "pair", folds: int = 5) -> dict[str, object]:
    """Logistic regression and naive Bayes stacked by a logistic model on out-of-fold predictions."""
    r = rows.withColumn("__fold", F.pmod(F.xxhash64(key), F.lit(folds)))
    parts = None
    for k in range(folds):
        train, rest = r.where(F.col("__fold") != k), r.where(F.col("__fold") == k)
        one = predict_naive_bayes(predict_logistic(rest, fit_logistic(train, features, label), "p_lr"), fit_naive_bayes(train, features, label), "p_nb").select("p_lr", "p_nb", label)
        parts = one if parts is None else parts.unionByName(one)
    return {"lr": fit_logistic(rows, features, label), "nb": fit_naive_bayes(rows, features, label), "meta": fit_logistic(parts, ["p_lr", "p_nb"], label)}


def predict_ensemble(rows: DataFrame, model: dict[str, object], name: str = "prior") -> DataFrame:
    p = predict_naive_bayes(predict_logistic(rows, model["lr"], "p_lr"), model["nb"], "p_nb")
    return predict_logistic(p, model["meta"], name).drop("p_lr", "p_nb")


def fit_boosting(rows: DataFrame, features: list[str], label: str = "label", trees: int = 20, depth: int = 3, seed: int = 0):
    """Gradient-boosted trees on histogram splits, by Spark's own library."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    assembler = VectorAssembler(inputCols=features, outputCol="__features", handleInvalid="keep")
    return Pipeline(stages=[assembler, GBTClassifier(featuresCol="__features", labelCol=label, maxIter=trees, maxDepth=depth, seed=seed)]).fit(rows)


def predict_boosting(rows: DataFrame, model, name: str = "prior") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).withColumn(name, F.get(vector_to_array("probability"), F.lit(1))).select(*rows.columns, name)


def tuned(rows: DataFrame, features: list[str], label: str, key: str, fits: dict[str, tuple], folds: int = 5) -> list[tuple[str, float]]:
    """(name, Brier score) of each way to fit and predict, by cross-validation over hashed folds; the best first."""
    r = rows.withColumn("__fold", F.pmod(F.xxhash64(key), F.lit(folds))).cache()
    out = []
    for name, (fit, predict) in fits.items():
        total, n = 0.0, 0
        for k in range(folds):
            rest = predict(r.where(F.col("__fold") == k), fit(r.where(F.col("__fold") != k), features, label), "__p")
            s, c = rest.agg(F.sum((F.col("__p") - F.col(label)) ** 2), F.count("*")).first()
            total, n = total + (s or 0.0), n + c
        out.append((name, total / max(n, 1)))
    r.unpersist()
    return sorted(out, key=lambda x: x[1])
