"""The engine's input views over star-schema tables, as DataFrames and as the same in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidrill.session import table


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(protocol, experiment, protein, sample_type, replicate, value): the canonical long table.

    A supplier stands for a protein, return flag and line status for protocol and experiment, the line number for the
    replicate. value is the log2 of the cell's mean price, missing by a fixed rule.
    """
    li = table(spark, sf_dir, "lineitem")
    cells = li.groupBy("l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber").agg(F.avg("l_extendedprice").alias("price"))
    missing = (F.col("l_suppkey") * 31 + F.col("l_linenumber") * 7 + F.ascii("l_returnflag")) % 5 == 0
    return cells.select(
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3).alias("protocol"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("experiment"),
        F.col("l_suppkey").alias("protein"),
        F.when(F.col("l_linenumber") % 2 == 0, "Sample").otherwise("Control").alias("sample_type"),
        F.col("l_linenumber").alias("replicate"),
        F.when(~missing, F.log2("price")).alias("value"),
    )


MEASUREMENTS = """m as (
  select case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end as protocol, case l_linestatus when 'F' then 1 else 2 end as experiment,
    l_suppkey as protein, case when l_linenumber % 2 = 0 then 'Sample' else 'Control' end as sample_type, l_linenumber as replicate,
    case when (l_suppkey * 31 + l_linenumber * 7 + ascii(l_returnflag)) % 5 <> 0 then log2(avg(l_extendedprice)) end as value
  from lineitem group by l_suppkey, l_returnflag, l_linestatus, l_linenumber)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(protein, bf_enrichment, bf_correlation, bf_detected, mean_log2fc): three Bayes factors for each part."""
    li = table(spark, sf_dir, "lineitem")
    odd = F.col("l_linenumber") % 2
    return li.groupBy(F.col("l_partkey").alias("protein")).agg(
        F.round(F.exp((F.avg("l_quantity") - 25.5) / 3), 6).alias("bf_enrichment"),
        F.round(F.exp((F.avg("l_discount") - 0.05) * 80), 6).alias("bf_correlation"),
        F.round((F.sum(odd) + 1.0) / (F.sum(1 - odd) + 1.0), 6).alias("bf_detected"),
        F.round(F.log2(F.avg("l_extendedprice")) - 15, 6).alias("mean_log2fc"),
    )


EVIDENCE = """ev as (
  select l_partkey as protein, round(exp((avg(l_quantity) - 25.5) / 3), 6) as bf_enrichment, round(exp((avg(l_discount) - 0.05) * 80), 6) as bf_correlation,
    round((sum(l_linenumber % 2) + 1.0::double) / (sum(1 - l_linenumber % 2) + 1.0::double), 6) as bf_detected, round(log2(avg(l_extendedprice)) - 15, 6) as mean_log2fc
  from lineitem group by l_partkey)"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """evidence with a combined Bayes factor, a posterior and q: the shape of the engine's result table."""
    from evidrill.operators.fdr import with_q

    ev = evidence(spark, sf_dir)
    bf = F.round(F.col("bf_enrichment") * F.col("bf_correlation") * F.col("bf_detected"), 6)
    p = F.round(F.col("bf") / (1 + F.col("bf")), 6)
    return with_q(ev.withColumn("bf", bf).withColumn("posterior", p), "posterior", "q", key="protein")


RESULTS = (
    EVIDENCE
    + """,
rp as (select *, round(bf / (1 + bf), 6) as posterior from (select *, round(bf_enrichment * bf_correlation * bf_detected, 6) as bf from ev)),
rs as (select *, case when posterior = 0 then 1.0 else avg(1 - posterior) over (order by posterior desc, protein rows between unbounded preceding and current row) end as q from rp)"""
)


def conditions(spark: SparkSession, sf_dir: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Two result tables of one domain: parts sold before 1998-06-01 and from then on, each with fields of a result.

    Unless whole, parts whose number of lines on a side is divisible by 5 are left out of it, as in CONDITIONS.
    """
    li = table(spark, sf_dir, "lineitem")

    def side(rows: DataFrame) -> DataFrame:
        odd = F.col("l_linenumber") % 2
        r = rows.groupBy(F.col("l_partkey").alias("protein")).agg(
            F.count("*").alias("n"),
            F.round(F.exp((F.avg("l_quantity") - 25.5) / 3), 6).alias("bf_enrichment"),
            F.round(F.exp((F.avg("l_discount") - 0.05) * 80), 6).alias("bf_correlation"),
            F.round((F.sum(odd) + 1.0) / (F.sum(1 - odd) + 1.0), 6).alias("bf_detected"),
            F.round(F.log2(F.avg("l_extendedprice")) - 15, 6).alias("mean_log2fc"),
        )
        r = r.where("true" if whole else "n % 5 <> 0").drop("n")
        r = r.withColumn("bf", F.round(F.col("bf_enrichment") * F.col("bf_correlation") * F.col("bf_detected"), 6))
        return r.withColumn("posterior", F.round(F.col("bf") / (1 + F.col("bf")), 6))

    cut = F.lit("1998-06-01").cast("timestamp")
    return side(li.where(F.col("l_shipdate") < cut)), side(li.where(F.col("l_shipdate") >= cut))


def _side_sql(name: str, where: str) -> str:
    return f"""{name} as (select protein, bf_enrichment, bf_correlation, bf_detected, mean_log2fc, bf, round(bf / (1 + bf), 6) as posterior from (
  select *, round(bf_enrichment * bf_correlation * bf_detected, 6) as bf from (
  select l_partkey as protein, count(*) as n, round(exp((avg(l_quantity) - 25.5) / 3), 6) as bf_enrichment, round(exp((avg(l_discount) - 0.05) * 80), 6) as bf_correlation,
    round((sum(l_linenumber % 2) + 1.0::double) / (sum(1 - l_linenumber % 2) + 1.0::double), 6) as bf_detected, round(log2(avg(l_extendedprice)) - 15, 6) as mean_log2fc
  from lineitem where {where} group by l_partkey) where n % 5 <> 0))"""


CONDITIONS = _side_sql("ca", "l_shipdate < timestamp '1998-06-01'") + ",\n" + _side_sql("cb", "l_shipdate >= timestamp '1998-06-01'")
#: The same with all parts.
WHOLE_CONDITIONS = CONDITIONS.replace(" where n % 5 <> 0", "")
