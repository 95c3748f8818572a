"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is good or bad. Its features are its own and those of the lines around it; neighbouring labels are
tied by transition weights. Forward-backward gives each line's marginal probability to be good, and a document's score is
their mean, weighted by the lines' lengths. The field is trained by conditional likelihood on lines that take the label of
their document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents of each label in the training sample, and lines of a document that may be in it.
SAMPLE_DOCS = 1500
SAMPLE_LINES = 400
#: Score from which a document is predicted good.
THRESHOLD = 0.7

SPACE = b" \t\n\r\x0b\x0c"
#: Own features of a line, all between 0 and 1 or near.
OWN = ("words", "word_length", "symbols", "capitals", "digits", "stutter", "distinct", "shouts", "closed", "seen")
_SYMBOLS, _UPPER, _DIGITS = b"#*$%&|<>", bytes(range(65, 91)), b"0123456789"


def line_features(line: bytes, seen: bool) -> tuple[float, ...]:
    """OWN of a line that has a word; seen: an earlier line is the same."""
    words = line.split()
    n = len(words)
    chars = sum(map(len, words))
    part = lambda kind: (len(line) - len(line.translate(None, kind))) / chars
    stutter = sum(map(bytes.__eq__, words, words[1:])) / (n - 1) if n > 1 else 0.0
    # a text of n words has fewer distinct ones the longer it is, so only short repeats count
    distinct = min(1.0, len(set(words)) / min(n, 50))
    last = line.rstrip()[-1:]
    return (min(1.0, np.log1p(n) / 6), min(1.0, chars / n / 12), min(1.0, 5 * part(_SYMBOLS)), part(_UPPER), part(_DIGITS), stutter, distinct, min(1.0, 5 * part(b"!")), float(last in (b".", b"!", b"?", b":", b'"')), float(seen))


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features, line lengths) of the lines with a word: own features, those of the line before and after, 1."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    known: set[bytes] = set()
    rows, lengths = [], []
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            rows.append(line_features(line, line in known))
            known.add(line)
            lengths.append(len(line))
    k = len(OWN)
    if not rows:
        return np.empty((0, 3 * k + 1)), np.empty(0)
    own = np.array(rows)
    x = np.zeros((len(rows), 3 * k + 1))
    x[:, :k] = own
    x[1:, k : 2 * k] = own[:-1]
    x[:-1, 2 * k : 3 * k] = own[1:]
    x[:, -1] = 1
    return x, np.array(lengths, float)


@dataclass
class LineField:
    """weights: the log-odds of good by feature; ties: [[bad-bad, bad-good], [good-bad, good-good]]."""

    weights: np.ndarray
    ties: np.ndarray

    def marginals(self, x: np.ndarray) -> np.ndarray:
        """Each line's probability to be good."""
        lines = x @ self.weights
        (bb, bg), (gb, gg) = np.exp(self.ties).tolist()
        good = (1 / (1 + np.exp(-np.clip(lines, -30, 30)))).tolist()
        ahead: list[tuple[float, float]] = []
        b = g = 0.5
        for p in good:
            b, g = ((b * bb + g * gb) * (1 - p), (b * bg + g * gg) * p) if ahead else (1 - p, p)
            total = b + g
            b, g = b / total, g / total
            ahead.append((b, g))
        out = [0.0] * len(good)
        rb = rg = 1.0
        for i in range(len(good) - 1, -1, -1):
            fb, fg = ahead[i]
            total = fb * rb + fg * rg
            out[i] = fg * rg / total
            p = good[i]
            rb, rg = bb * (1 - p) * rb + bg * p * rg, gb * (1 - p) * rb + gg * p * rg
            total = rb + rg
            rb, rg = rb / total, rg / total
        return np.array(out)

    def score(self, text: str | None) -> float:
        """The length-weighted mean of the marginals; 0 for a text without words."""
        x, lengths = document_features(text)
        if not len(x):
            return 0.0
        return float(np.clip(self.marginals(x) @ lengths / lengths.sum(), 0, 1))


def train(documents: list[tuple[np.ndarray, int]], steps: int = 300, rate: float = 0.15, decay: float = 1e-3) -> LineField:
    """Maximises the mean conditional log-likelihood of the documents' lines by Adam; the same documents, in the
    same order, give the same field. Documents of one line count like others. Without documents of both labels there is nothing to
    learn: the field then gives every line the share of good documents (1/2 without any).
    """
    documents = [(x, y) for x, y in documents if len(x)]
    k = 3 * len(OWN) + 1
    weights, ties = np.zeros(k), np.zeros((2, 2))
    labels = {y for _, y in documents}
    if len(labels) < 2:
        weights[-1] = 0.0 if not labels else 4.0 if labels == {1} else -4.0
        return LineField(weights, ties)
    documents = sorted(documents, key=lambda d: -len(d[0]))  # so that at any step the ones still running come first
    n, longest = len(documents), len(documents[0][0])
    lengths = np.array([len(x) for x, _ in documents])
    running = np.array([(lengths > t).sum() for t in range(longest)])
    y = np.array([y for _, y in documents])
    flat = np.concatenate([x for x, _ in documents])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    share = 1.0 / lengths  # each document weighs the same
    where = [starts[: running[t]] + t for t in range(longest)]
    m = v = np.zeros(k + 4)
    for step in range(1, steps + 1):
        odds = np.clip(flat @ weights, -30, 30)
        good = 1 / (1 + np.exp(-odds))
        e = np.exp(ties)
        ahead, back = np.empty((len(flat), 2)), np.empty((len(flat), 2))
        last = None
        for t in range(longest):
            p = good[where[t]]
            emit = np.column_stack([1 - p, p])
            a = emit if t == 0 else (last[: running[t]] @ e) * emit
            last = a / a.sum(axis=1, keepdims=True)
            ahead[where[t]] = last
        later = np.ones((n, 2))
        both = np.zeros((2, 2))
        for t in range(longest - 1, -1, -1):
            r = running[t]
            after = running[t + 1] if t + 1 < longest else 0
            beta = np.ones((r, 2))
            if after:
                p = good[where[t + 1]]
                ahead_of = np.column_stack([1 - p, p]) * later[:after]
                beta[:after] = ahead_of @ e.T
                pair = ahead[where[t][:after]][:, :, None] * e[None] * ahead_of[:, None, :]
                pair /= pair.sum(axis=(1, 2), keepdims=True)
                both += (pair * share[:after, None, None]).sum(axis=0)
            later = beta / beta.sum(axis=1, keepdims=True)
            back[where[t]] = later
        marginal = ahead * back
        marginal /= marginal.sum(axis=1, keepdims=True)
        line_y, line_share = np.repeat(y, lengths), np.repeat(share, lengths)
        grad_w = flat.T @ ((line_y - marginal[:, 1]) * line_share) / n - decay * weights
        seen = np.zeros((2, 2))
        for c in (0, 1):
            seen[c, c] = ((lengths - 1) * share)[y == c].sum()
        grad_t = (seen - both) / n - decay * ties
        grad = np.concatenate([grad_w, grad_t.ravel()])
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights, ties = weights + move[:k], ties + move[k:].reshape(2, 2)
    return LineField(weights, ties)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 modulo 4; false for null ids."""
    return F.coalesce(remainder(doc_id) == 2, F.lit(False))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [document_features(x.as_py())[0] for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.astype(np.float32).tobytes() if len(x) <= SAMPLE_LINES else None for x in found], pa.binary())], names=["doc_id", "quality", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LineField:
    """The field trained on sample_docs labelled documents of each label, none of them held out.

    The sample is the ids with the smallest hashes, so it doesn't hang on the order of rows; documents of more than
    SAMPLE_LINES lines are left out of it. Its bound makes it fit the driver: at most 2 * sample_docs * SAMPLE_LINES lines of
    31 four-byte numbers, on average a fortieth of that. Ids with labels that differ take the smaller one. Labels other than 0 and 1,
    null ids and labels without a document are ignored.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("quality = 0").orderBy(*by_hash).limit(sample_docs).unionByName(known.where("quality = 1").orderBy(*by_hash).limit(sample_docs))
    sample = sample.select(F.col("doc_id").alias("__id"), "quality")
    chosen = docs.join(F.broadcast(sample), docs["doc_id"] == F.col("__id"))  # 2 * sample_docs rows of two numbers at most
    rows = chosen.select(F.col("__id").alias("doc_id"), F.col("quality").cast("int").alias("quality"), "text").mapInArrow(_sampled, "doc_id long, quality int, x binary")
    got = sorted((r["doc_id"], r["quality"], bytes(r["x"])) for r in rows.where("x is not null").collect())
    k = 3 * len(OWN) + 1
    return train([(np.frombuffer(x, np.float32).reshape(-1, k).astype(float), q) for _, q, x in got])


def _score(field: LineField):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [field.score(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def score_documents(docs: DataFrame, field: LineField, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of docs; only the text makes the score.

    Null and empty texts have score 0. Null ids come back null, and aren't held out. Repeated rows each give a row, extra columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = rows.mapInArrow(_score(field), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """score_documents() by a field that fit() trains."""
    return score_documents(docs, fit(docs.select("doc_id", "text"), labels, sample_docs), threshold)


def _good(field: LineField, at: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([field.score(x.as_py()) >= threshold for x in batch.column(at)], pa.bool_()))

    return run


def reject_bad(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of docs, with all their columns, whose text is predicted good."""
    field = fit(docs.select("doc_id", "text"), labels, sample_docs)
    return docs.mapInArrow(_good(field, docs.columns.index("text"), threshold), docs.schema)
