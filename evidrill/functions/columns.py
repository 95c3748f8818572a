"""Column expressions of the evidence model; all run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def prob_beta_greater(a: Column, b: Column, c: Column, d: Column) -> Column:
    """P(X > Y) of X ~ Beta(a, b), Y ~ Beta(c, d) with whole parameters, by a finite sum.

    The sum's first term is prod (d + j) / (c + d + j) over j < b, each next one the last times
    (c + i) / (c + d + b + i) * (b + i) / (1 + i): no gamma function is needed.
    """
    a, b, c, d = (x.cast("int") for x in (a, b, c, d))
    first = F.aggregate(F.sequence(F.lit(0), b - 1), F.lit(1.0), lambda p, j: p * (d + j) / (c + d + j))
    start = F.struct(F.lit(0.0).alias("sum"), first.alias("term"))
    step: Callable[[Column, Column], Column] = lambda s, i: F.struct((s["sum"] + s["term"]).alias("sum"), (s["term"] * (c + i) / (c + d + b + i) * (b + i) / (i + 1)).alias("term"))
    return F.aggregate(F.sequence(F.lit(0), a - 1), start, step, lambda s: s["sum"])


def probability_of(bf: Column) -> Column:
    """The probability bf / (1 + bf); NaN gives 1/2, infinities 1 and 0, null stays."""
    return F.when(F.isnan(bf), F.lit(0.5)).when(bf == F.lit(float("inf")), F.lit(1.0)).when(bf == F.lit(float("-inf")), F.lit(0.0)).when(bf.isNotNull(), bf / (1 + bf))


def squeezed(p: Column, eps: float = EPS) -> Column:
    """p moved off 0 and 1 by eps; NaN becomes 1/2, infinities count as 1 and 0."""
    inside = F.when(F.isnan(p), F.lit(0.5)).when(p == F.lit(float("inf")), F.lit(1.0)).when(p == F.lit(float("-inf")), F.lit(0.0)).otherwise(p)
    return inside * (1 - 2 * eps) + eps


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function by the rational approximation of Abramowitz and Stegun 7.1.26 (error 1.5e-7)."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * z)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    erf = 1 - poly * F.exp(-z * z)
    return F.when(x >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def safe_log10(x: Column) -> Column:
    """log10 held to +-8; null and values up to 0 give -8."""
    return F.when(x > 0, clamp(F.log10(x), -8.0, 8.0)).otherwise(F.lit(-8.0))


def safe_ratio(a: Column, b: Column) -> Column:
    """a / max(b, eps) held to 1e-8 .. 1e8; a missing numerator gives 1e-8, a missing denominator counts as eps, both give 1."""
    full = clamp(a / F.greatest(b, F.lit(EPS)), 1e-8, 1e8)
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull(), F.lit(1e-8)).when(b.isNull(), F.least(a / EPS, F.lit(1e8))).otherwise(full)


def evidence_label(p: Column, q: Column) -> Column:
    """Strong at p >= .95 and q <= .01, Moderate at p >= .8 and q <= .05, Weak at p >= .5, else None."""
    return F.when((p >= 0.95) & (q <= 0.01), "Strong").when((p >= 0.8) & (q <= 0.05), "Moderate").when(p >= 0.5, "Weak").otherwise("None")


def association_weight(score: Column, copurified: float = 0.05, prior: float = 0.002) -> Column:
    """The probability of an association with a database score (held to .001 .. .999), given a prior for pairs that copurify."""
    s = clamp(score, 0.001, 0.999)
    bf = s * (1 - prior) / ((1 - s) * prior)
    return bf * copurified / (bf * copurified + 1 - copurified)


def channel_weight(channels: list[Column], copurified: float = 0.05, prior: float = 0.002) -> Column:
    """association_weight by the product over channels; missing channels and channels at 0 say nothing."""
    odds = F.lit(1.0)
    for c in channels:
        s = clamp(c, 0.001, 0.999)
        odds = odds * F.when(c.isNull() | F.isnan(c) | (c <= 0), F.lit(1.0)).otherwise(s * (1 - prior) / ((1 - s) * prior))
    return odds * copurified / (odds * copurified + 1 - copurified)


def unordered_key(a: Column, b: Column) -> Column:
    """The key of a pair that doesn't hang on its order."""
    return F.concat_ws("_", F.array_sort(F.array(a.cast("string"), b.cast("string"))))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if one of the vectors has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def pair_features(a: Column, b: Column) -> Column:
    """a, b, their products and their differences, one after the other."""
    return F.concat(a, b, F.zip_with(a, b, lambda x, y: x * y), F.zip_with(a, b, lambda x, y: x - y))


def parsed_id(raw: Column) -> Column:
    """The entry name of an accession line (sp|acc|name, tr|acc|name; its accession if the name is empty), else the last part
    that isn't empty; isoform suffixes of accessions go."""
    parts = F.split(raw, r"\|")
    database = F.lower(F.get(parts, F.lit(0))).isin("sp", "tr") & (F.size(parts) >= 3)
    named = F.when(F.trim(F.get(parts, F.lit(2))) != "", F.trim(F.get(parts, F.lit(2)))).otherwise(F.trim(F.get(parts, F.lit(1))))
    filled = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    plain = F.when(F.size(filled) > 0, F.element_at(filled, -1)).otherwise(F.trim(raw))
    name = F.when(database, named).otherwise(plain)
    # accessions: six characters, or ten, as the database defines them
    accession = r"^([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2})-[0-9]+$"
    return F.regexp_replace(name, accession, "$1")


def is_contaminant(raw: Column) -> Column:
    return F.upper(raw).startswith("CON__") | F.upper(raw).startswith("REV__")
