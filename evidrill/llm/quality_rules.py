"""Quality rules: counts of a text, fixed rules on them, and robust multivariate outliers per language and source.

For every group (language, source) the minimum covariance determinant method finds the half of the documents whose
transformed statistics have the tightest covariance; documents far from it in Mahalanobis distance, on any side, are outliers.
Random starts are tried on a sample of bounded size of each group; the best ones then take concentration steps over all rows of all groups at
once, as aggregations: distances under the current estimate, a histogram of them for each group's median, then sums over the nearer half. The start of
least determinant wins and is reweighted. Partial sums meet map-side, so a hot group costs no more than any other, and no documents are
gathered anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidrill.llm.common import cut, small

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
#: The printable ASCII characters that are neither letters nor digits.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Bytes from which a word's length counts no further, so that a single key or address in a text doesn't move its mean; bytes of a short word.
LONG, SHORT = 12, 3

#: Transformed statistics. The first is the text's length, which the others hang on: the distance is that of the others given the length.
STATISTICS = ("length", "word_length", "short_words", "marks", "capitals", "distinct")
#: Words of ordinary prose that each text is taken to have besides its own: rates of short texts vary less that way.
PRIOR_WORDS = 100
#: Share of a group that the estimate rests on, and concentration steps over all rows.
CORE = 0.5
STEPS = 3
#: Rows (expected) of a group on which starts are tried, random starts, and those that go on to all rows.
SAMPLE_ROWS, STARTS, FINALISTS = 600, 40, 2
#: A group of so many different vectors (beyond the least for an estimate) and its language have the same weight in the group's estimate; likewise a language and all.
SHRINK = 100
#: Added to variances: a hundredth or less of those seen. It only keeps a covariance regular.
RIDGE = 4e-6
#: Share of normal data inside the reweighting's limit, and the probability behind the cutoff, of chi-squared with the degrees of the other statistics.
INSIDE = 0.975
PROBABILITY = 0.99999
#: Groups up to which the estimates (some 400 bytes a group) are broadcast to the documents; above, the join shuffles.
MAX_BROADCAST_GROUPS = 20_000
#: Bins of a factor of two in the histogram of squared distances.
BINS = 32


def text_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of a text. n_repeat_words: words in 3-word windows found twice or more."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, SPACE))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeats = 0
    n = len(words)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    if n > 3 and len(number) < n:  # with no word twice no window is found twice
        base = len(number)
        code = (ids[:-2] * base + ids[1:-1]) * base + ids[2:] if base < 2_000_000 else _numbered(ids, base)
        order = np.sort(code)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            inside = np.isin(code, twice)
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= inside
            repeats = int(covered.sum())
    size = np.fromiter(map(len, words), np.int64, n)
    without = lambda kind: len(raw) - len(raw.translate(None, kind))
    return (n, len(text) - spaces, without(SYMBOLS), len(lines) - len(set(lines)), repeats, int(np.minimum(size, LONG).sum()), int((size <= SHORT).sum()), without(MARKS), without(UPPER), len(number))


def _numbered(ids: np.ndarray, base: int) -> np.ndarray:
    """The windows' numbers where three word numbers don't fit 64 bits together."""
    pairs = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)[1]
    return pairs[:-1] * np.int64(base) + ids[2:]


#: The contract's counts; then held lengths of words, short words, marks, A-Z, different words.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_held", "n_short", "n_marks", "n_upper", "n_distinct")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [text_counts(x.as_py()) for x in batch.column(3)]
        columns = zip(*rows, strict=True) if rows else [()] * len(COUNTS)
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "lang", "source", *COUNTS])


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, counts) of each row."""
    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "text").mapInArrow(_count, schema)


def transformed() -> Column:
    """The vector of STATISTICS, of a text with words: logarithms of rates, each with PRIOR_WORDS of prose (words of five letters,
    two in five of them short, 3 % marks, 2 % capitals, no word twice) added."""
    k = float(PRIOR_WORDS)
    chars = 5 * k
    n = F.col("n_words") + F.lit(k)
    per_char = lambda c, share: F.log((F.col(c) + F.lit(share * chars)) / (F.col("word_chars") + F.lit(chars)))
    short = F.log((F.col("n_short") + F.lit(0.4 * k)) / (F.col("n_words") - F.col("n_short") + F.lit(0.6 * k)))
    return F.array(F.log(n), F.log((F.col("n_held") + F.lit(chars)) / n), short, per_char("n_marks", 0.03), per_char("n_upper", 0.02), F.log((F.col("n_distinct") + F.lit(k)) / n))


def chi_squared_cdf(x: float, k: int) -> float:
    """By the series of the regularised lower incomplete gamma function."""
    a, h = k / 2, x / 2
    term = total = 1 / a
    for i in range(1, 2000):
        term *= h / (a + i)
        total += term
        if term < total * 1e-17:
            break
    return total * math.exp(-h + a * math.log(h) - math.lgamma(a))


def chi_squared_quantile(share: float, k: int) -> float:
    low, high = 1e-9, 300.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_squared_cdf(mid, k) < share else (low, mid)
    return low


def consistency(p: int, share: float) -> float:
    """share / P(chi2 with p + 2 degrees < the share's quantile with p): makes a core's covariance that of normal data."""
    return share / chi_squared_cdf(chi_squared_quantile(share, p), p + 2)


#: Squared distance, given the length, beyond which a document is an outlier.
CUTOFF = chi_squared_quantile(PROBABILITY, len(STATISTICS) - 1)


def _distance() -> Column:
    """The quadratic form of x less centre with the symmetric matrix `inverse`; without higher-order functions, so that it is compiled."""
    p = len(STATISTICS)
    d = [F.get("x", F.lit(i)) - F.get("centre", F.lit(i)) for i in range(p)]
    terms = [(1.0 if i == j else 2.0) * F.get("inverse", F.lit(i * p + j)) * d[i] * d[j] for i in range(p) for j in range(i, p)]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, sums, squares): one row a group, of rows (keys, x)."""
    p = len(STATISTICS)
    x = [F.get("x", F.lit(i)) for i in range(p)]
    agg = [F.sum(x[i]).alias(f"s{i}") for i in range(p)] + [F.sum(x[i] * x[j]).alias(f"q{i}{j}") for i in range(p) for j in range(i, p)]
    g = rows.groupBy(*keys).agg(F.count("*").alias("n"), *agg)
    return g.select(*keys, "n", F.array(*[F.col(f"s{i}") for i in range(p)]).alias("sums"), F.array(*[F.col(f"q{min(i, j)}{max(i, j)}") for i in range(p) for j in range(p)]).alias("squares"))


def _estimates(share: float):
    """From a group's sums over its share of nearest rows: centre, covariance and its inverse, and the logarithm of the determinant."""
    factor = consistency(len(STATISTICS), share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, kind = len(STATISTICS), pa.list_(pa.float64())
        for batch in batches:
            centres, covs, inverses, dets = [], [], [], []
            for n, sums, squares in zip(*(batch.column(c).to_pylist() for c in ("n", "sums", "squares")), strict=True):
                centre = np.array(sums) / n
                cov = np.array(squares).reshape(p, p) / n - np.outer(centre, centre)
                cov = factor * (cov + cov.T) / 2
                # cancellation can leave a variance a little below 0
                cov += (RIDGE + max(0.0, -float(np.linalg.eigvalsh(cov)[0]))) * np.eye(p)
                centres.append(centre.tolist())
                covs.append(cov.ravel().tolist())
                inverses.append(np.linalg.inv(cov).ravel().tolist())
                dets.append(float(np.linalg.slogdet(cov)[1]))
            keys = [batch.column(c) for c in ("level", "g", "start")]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(v, kind) for v in (centres, covs, inverses)), pa.array(dets, pa.float64())], names=["level", "g", "start", "centre", "cov", "inverse", "logdet"])

    return run


ESTIMATE = "level int, g string, start int, centre array<double>, cov array<double>, inverse array<double>, logdet double"
#: Different vectors below which there is nothing to estimate.
LEAST = 2 * (len(STATISTICS) + 1)


def fast_starts(x: np.ndarray, starts: int = STARTS, finalists: int = FINALISTS, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(centre, covariance, log determinant) of the `finalists` best random starts on the rows of x, after concentration to a standstill.

    Each start is the mean and covariance of one row more than there are columns; a concentration step takes those of the nearer half.
    """
    n, p = x.shape
    half = (n + p + 1) // 2
    rng = np.random.default_rng([seed, n])

    def of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = rows.mean(axis=0)
        d = rows - c
        return c, d.T @ d / len(rows) + RIDGE * np.eye(p)

    def step(c: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = x - c
        return of(x[np.argsort(np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d), kind="stable")[:half]])

    tried = []
    for _ in range(starts):
        c, s = of(x[rng.choice(n, p + 1, replace=False)])
        for _ in range(2):
            c, s = step(c, s)
        tried.append((float(np.linalg.slogdet(s)[1]), len(tried), c, s))
    out: list[tuple[np.ndarray, np.ndarray, float]] = []
    for det, _, c, s in sorted(tried, key=lambda t: t[:2])[: 3 * finalists]:
        for _ in range(50):
            c, s = step(c, s)
            now = float(np.linalg.slogdet(s)[1])
            if now >= det - 1e-12:
                break
            det = now
        if all(abs(det - other[2]) > 1e-9 for other in out):
            out.append((c, s, det))
    return sorted(out, key=lambda t: t[2])[:finalists]


def _starts(starts: int, finalists: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(sorted(pdf["x"].map(list)))
        found = fast_starts(x, starts, finalists)
        factor = consistency(x.shape[1], CORE)
        rows = [(pdf["level"].iloc[0], pdf["g"].iloc[0], k, c.tolist(), (factor * s).ravel().tolist(), np.linalg.inv(factor * s).ravel().tolist(), det) for k, (c, s, det) in enumerate(found)]
        return pd.DataFrame(rows, columns=["level", "g", "start", "centre", "cov", "inverse", "logdet"])

    return run


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(d2 + F.lit(1e-9)) * F.lit(BINS))


def group_key(*columns: str) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in columns]))


def _far(rows: DataFrame, now: DataFrame) -> DataFrame:
    """(level, g, start, x, d2): each row under each estimate of its groups."""
    return rows.join(small(now.select("level", "g", "start", "centre", "inverse"), MAX_BROADCAST_GROUPS), ["level", "g"]).select("level", "g", "start", "x", _distance().alias("d2"))


def _concentrated(rows: DataFrame, now: DataFrame, sizes: DataFrame) -> DataFrame:
    """The estimates (level, g, start, ...) after a concentration step over all rows."""
    keys = ["level", "g", "start"]
    far = _far(rows, now)
    bins = far.groupBy(*keys, _bin(F.col("d2")).alias("bin")).agg(F.count("*").alias("n"))
    lists = bins.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins")).join(sizes, ["level", "g"])
    core = F.aggregate("bins", F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("bin")), lambda s, b: F.struct((s["n"] + b["n"]).alias("n"), F.coalesce(s["bin"], F.when(s["n"] + b["n"] >= F.lit(CORE) * F.col("size"), b["bin"])).alias("bin")), lambda s: s["bin"])
    edge = cut(lists.select(*keys, core.alias("edge")))
    near = far.join(small(edge, MAX_BROADCAST_GROUPS), keys).where(_bin(F.col("d2")) <= F.col("edge"))
    return cut(_sums(near, *keys).mapInArrow(_estimates(CORE), ESTIMATE))


def fit_groups(vectors: DataFrame, steps: int = STEPS, starts: int = STARTS, finalists: int = FINALISTS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(level, g, size, centre, cov): the robust estimate of each group (lang, source; level 2), of each language (1), and of all (0).

    vectors: lang, source, x. Equal vectors of a group count once, so that copies of a text can't make up its core; size is the number of
    different ones. Groups of fewer than LEAST have no estimate. A concentration step never raises the determinant.
    """
    levels = F.array(F.struct(F.lit(0).alias("level"), F.lit("").alias("g")), F.struct(F.lit(1).alias("level"), group_key("lang").alias("g")), F.struct(F.lit(2).alias("level"), group_key("lang", "source").alias("g")))
    rows = vectors.select("lang", "source", "x").distinct().select(F.explode(levels).alias("l"), "x").select("l.level", "l.g", "x")
    rows = cut(rows)
    sizes = cut(rows.groupBy("level", "g").agg(F.count("*").alias("size")).where(F.col("size") >= LEAST))
    known = rows.join(small(sizes, MAX_BROADCAST_GROUPS), ["level", "g"])
    # the same vectors are drawn in any order of rows; a group's number of them is near sample_rows
    draw = F.pmod(F.xxhash64("x"), F.lit(1 << 30)) < F.lit(float(1 << 30) * sample_rows) / F.col("size")
    least = F.pmod(F.xxhash64("x"), F.lit(1 << 30)) < F.lit(float(1 << 30) * 4 * LEAST) / F.col("size")
    drawn = known.where(draw | least).select("level", "g", "x")
    now = cut(drawn.groupBy("level", "g").applyInPandas(_starts(starts, finalists), ESTIMATE))
    rows = known.select("level", "g", "x")
    now = _concentrated(rows, now, sizes)
    best = now.groupBy("level", "g").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    now = cut(now.join(best, ["level", "g", "start"]))
    for _ in range(steps - 1):
        now = _concentrated(rows, now, sizes)
    inside = _far(rows, now).where(F.col("d2") <= chi_squared_quantile(INSIDE, len(STATISTICS)))
    found = _sums(inside, "level", "g", "start").mapInArrow(_estimates(INSIDE), ESTIMATE)
    return cut(found.join(sizes, ["level", "g"]).select("level", "g", "size", "centre", "cov"))


def _shrunk(shrink: float):
    """(g, centre, inverse) of groups from their own estimate (size2, centre2, cov2), their language's and that of all; inverse is the matrix of the
    distance given the length: the inverse covariance less the length's own part."""

    def toward(parent, size, centre, cov):
        if centre is None:
            return parent
        own = (np.array(centre), np.array(cov).reshape(len(centre), -1))
        if parent is None:
            return own
        w = (size - LEAST) / (size - LEAST + shrink)
        return w * own[0] + (1 - w) * parent[0], w * own[1] + (1 - w) * parent[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.float64())
        for batch in batches:
            keys, centres, inverses = [], [], []
            for r in batch.to_pylist():
                found = None
                for level in (0, 1, 2):
                    found = toward(found, r[f"size{level}"], r[f"centre{level}"], r[f"cov{level}"])
                if found is None:
                    continue
                inverse = np.linalg.inv(found[1])
                inverse[0, 0] -= 1 / found[1][0, 0]
                keys.append(r["g2"])
                centres.append(found[0].tolist())
                inverses.append(((inverse + inverse.T) / 2).ravel().tolist())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(centres, kind), pa.array(inverses, kind)], names=["g", "centre", "inverse"])

    return run


def shrunk_groups(vectors: DataFrame, fits: DataFrame, shrink: float = SHRINK) -> DataFrame:
    """(g, centre, inverse) of each group (lang, source) of vectors: the smaller it is, the nearer to the estimate of its language and of all."""
    out = vectors.select("lang", "source").distinct().select(group_key("lang", "source").alias("g2"), group_key("lang").alias("g1"), F.lit("").alias("g0"))
    for level in (2, 1, 0):
        out = out.join(fits.where(F.col("level") == level).select(F.col("g").alias(f"g{level}"), *[F.col(c).alias(f"{c}{level}") for c in ("size", "centre", "cov")]), f"g{level}", "left")
    return cut(out.mapInArrow(_shrunk(shrink), "g string, centre array<double>, inverse array<double>"))


def judge(docs: DataFrame, cutoff: float = CUTOFF, shrink: float = SHRINK, steps: int = STEPS) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept), a row each.

    docs: doc_id, text, lang, source. base_failed: n_words < 50 or 100 * n_repeat_words > 50 * n_words. distance is the squared
    Mahalanobis distance of the statistics, given the text's length, from the robust estimate of the document's group, null where the base rules fail; a larger one
    than cutoff rejects, on whichever side it lies. The estimates are made of the documents that pass the base rules.

    Null and empty texts have no words and fail the base rules. Null languages and sources are groups of their own. Small groups lean on the estimate
    of their language, and small languages on that of all documents, by their sizes; with fewer than LEAST different documents in all there is no
    estimate, the distance is null and the base rules alone decide. Repeated rows each give a row and equal texts count once in a group's estimate; extra columns are
    ignored; an empty table gives an empty result.
    """
    base = cut(counted(docs))
    own = _judged(base, _fits(base, shrink, steps), cutoff)
    return own.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _fits(base: DataFrame, shrink: float, steps: int) -> DataFrame:
    vectors = cut(base.where(~_base_failed()).select("lang", "source", transformed().alias("x")))
    return shrunk_groups(vectors, fit_groups(vectors, steps), shrink)


def _judged(rows: DataFrame, fits: DataFrame, cutoff: float) -> DataFrame:
    """rows (lang, source, counts) with base_failed, distance and kept. The estimates have a row a group."""
    own = rows.withColumn("base_failed", _base_failed())
    own = own.withColumn("x", F.when(~F.col("base_failed"), transformed())).withColumn("__key", group_key("lang", "source"))
    own = own.join(small(fits, MAX_BROADCAST_GROUPS), F.col("__key") == F.col("g"), "left").drop("__key")
    own = own.withColumn("distance", F.when(F.col("x").isNotNull() & F.col("centre").isNotNull(), _distance()))
    return own.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff))


def _with_counts(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_counts(x.as_py()) for x in batch.column(at)]
            columns = zip(*rows, strict=True) if rows else [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in columns)], names=[*batch.schema.names, *COUNTS])

    return run


def reject_outliers(docs: DataFrame, cutoff: float = CUTOFF, shrink: float = SHRINK, steps: int = STEPS) -> DataFrame:
    """The rows of docs, with all their columns, that judge() keeps; texts are counted where they lie and not shuffled."""
    fits = _fits(cut(counted(docs)), shrink, steps)
    row = docs.select(F.struct("*").alias("row"), "text", "lang", "source")
    schema = T.StructType([*row.schema.fields, *(T.StructField(c, T.LongType()) for c in COUNTS)])
    judged = _judged(row.mapInArrow(_with_counts(1), schema), fits, cutoff).where("kept")
    return judged.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
