"""Curation of identifiers: contaminants, groups, synonyms, merges, renames, with a log of what was done.

rows: row (position), id, and any numeric columns. mapping: name, string_id, preferred_name.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidrill.functions.columns import is_contaminant, parsed_id


def without_contaminants(rows: DataFrame) -> DataFrame:
    """rows without ids that start with CON__ or REV__ in any case. Null ids stay."""
    return rows.where(~F.coalesce(is_contaminant(F.col("id")), F.lit(False)))


def split_groups(rows: DataFrame, delimiter: str = ";") -> DataFrame:
    """rows with members: a group of two or more gives a row for each parsed member, lead marking the first; a single id stays
    as it is. Empty members are dropped; column original keeps the id."""
    quoted = "\\Q" + delimiter + "\\E"
    members = F.filter(F.transform(F.split("id", quoted), lambda x: F.trim(x)), lambda x: x != "")
    members = F.when(F.size(members) >= 2, F.transform(members, parsed_id)).otherwise(F.array(F.col("id")))
    others = [c for c in rows.columns if c != "id"]
    return rows.select(*others, F.col("id").alias("original"), F.posexplode(members).alias("place", "id")).select(*others, "original", "id", (F.col("place") == 0).alias("lead"))


def resolved(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """rows with string_id and preferred_name of the first mapping of the id (by string_id); null for unmapped ones."""
    first = mapping.groupBy(F.col("name").alias("__name")).agg(F.min(F.struct("string_id", "preferred_name")).alias("__m"))
    j = rows.join(first, rows["id"] == first["__name"], "left")
    return j.select(*rows.columns, F.col("__m.string_id").alias("string_id"), F.col("__m.preferred_name").alias("preferred_name"))


def merge_candidates(r: DataFrame) -> DataFrame:
    """(string_id, names, n): database ids of two or more distinct names, names in order."""
    return r.where("string_id is not null").groupBy("string_id").agg(F.array_sort(F.collect_set("id")).alias("names"), F.countDistinct("id").alias("n")).where("n >= 2")


def auto_decisions(candidates: DataFrame, prefix: int = 3) -> DataFrame:
    """candidates with approved (their names share a prefix, case aside) and chosen, the first name."""
    heads = F.array_distinct(F.transform("names", lambda x: F.upper(F.substring(x, 1, prefix))))
    return candidates.withColumn("approved", F.size(heads) == 1).withColumn("chosen", F.get("names", F.lit(0)))


def replayed(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """candidates with earlier decisions (string_id, approved, chosen); unseen ones are rejected."""
    d = decisions.select("string_id", F.col("approved").alias("__ok"), F.col("chosen").alias("__name"))
    return candidates.select("string_id", "names", "n").join(d, "string_id", "left").select("string_id", "names", "n", F.coalesce("__ok", F.lit(False)).alias("approved"), F.coalesce("__name", F.get("names", F.lit(0))).alias("chosen"))


def merged(rows: DataFrame, by: str, name: str, values: list[str], strategy: str = "max") -> DataFrame:
    """One row for each value of `by`: lowest row, the name of that row, values by max or mean of those that are there."""
    f = {"max": F.max, "mean": F.avg}[strategy]
    return rows.groupBy(by).agg(F.min("row").alias("row"), F.min_by(name, "row").alias(name) if name != by else F.count("*").alias("__n"), *[f(v).alias(v) for v in values]).drop("__n")


def merge_approved(r: DataFrame, decisions: DataFrame, values: list[str], strategy: str = "max") -> DataFrame:
    """resolved rows in which the rows of an approved database id are one, under the chosen name; column merged says so."""
    d = decisions.where("approved").select("string_id", F.col("chosen").alias("__chosen"))
    j = r.join(d, "string_id", "left")
    key = F.coalesce(F.when(F.col("__chosen").isNotNull(), F.concat(F.lit("s:"), "string_id")), F.concat(F.lit("r:"), F.col("row").cast("string"), F.lit(":"), F.col("id")))
    f = {"max": F.max, "mean": F.avg}[strategy]
    return j.groupBy(key.alias("__k")).agg(F.min("row").alias("row"), F.coalesce(F.max("__chosen"), F.min_by("id", "row")).alias("id"), F.min("string_id").alias("string_id"), F.min_by("preferred_name", "row").alias("preferred_name"), F.max(F.col("__chosen").isNotNull()).alias("merged"), *[f(v).alias(v) for v in values]).drop("__k")


def renamed(r: DataFrame) -> DataFrame:
    """rows with the preferred name as id unless merged already; action KEEP, RENAME, MERGE or UNMAPPED."""
    action = F.when(F.col("merged"), "MERGE").when(F.col("preferred_name").isNull(), "UNMAPPED").when(F.col("preferred_name") == F.col("id"), "KEEP").otherwise("RENAME")
    return r.withColumn("action", action).withColumn("original", F.col("id")).withColumn("id", F.when(F.col("action") == "RENAME", F.col("preferred_name")).otherwise(F.col("id")))


def lookup(log: DataFrame) -> DataFrame:
    """(id, originals, string_id): per name its distinct original names joined by ';' in order and the first database id; removed rows left out."""
    kept = log.where("action <> 'REMOVE'")
    return kept.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("original")), ";").alias("originals"), F.min("string_id").alias("string_id"))


def find_bait(rows: DataFrame, bait: str) -> DataFrame:
    """The first row whose id is the bait, or else is it in another case."""
    exact = F.when(F.col("id") == bait, 0).when(F.lower("id") == bait.lower(), 1)
    return rows.withColumn("__e", exact).where("__e is not null").orderBy("__e", "row").limit(1).drop("__e")


LOG = T.StructType([T.StructField(n, t) for n, t in (("original", T.StringType()), ("id", T.StringType()), ("string_id", T.StringType()), ("action", T.StringType()))])


def curate(rows: DataFrame, mapping: DataFrame, values: list[str], decisions: DataFrame | None = None, strategy: str = "max", delimiter: str = ";", prefix: int = 3) -> tuple[DataFrame, DataFrame]:
    """(curated rows, log): contaminants, groups, resolution, merges, renames, then rows that share a final name merged."""
    removed = rows.where(F.coalesce(is_contaminant(F.col("id")), F.lit(False))).select(F.col("id").alias("original"), "id", F.lit(None).cast("string").alias("string_id"), F.lit("REMOVE").alias("action"))
    parts = split_groups(without_contaminants(rows), delimiter)
    r = resolved(parts, mapping)
    candidates = merge_candidates(r)
    d = replayed(candidates, decisions) if decisions is not None else auto_decisions(candidates, prefix)
    named = renamed(merge_approved(r, d, values, strategy))
    f = {"max": F.max, "mean": F.avg}[strategy]
    final = named.groupBy("id").agg(F.min("row").alias("row"), *[f(v).alias(v) for v in values])
    return final.select("row", "id", *values), named.select("original", "id", "string_id", "action").unionByName(removed)


def mapping_cache_key(names: list[str], species: int) -> str:
    """The digest of the sorted distinct names and the species."""
    import hashlib

    return hashlib.sha256(json.dumps([sorted(set(names)), species]).encode()).hexdigest()
