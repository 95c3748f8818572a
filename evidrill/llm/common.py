"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch that carries whole texts: a batch of the longest texts still fits a worker.
TEXT_BATCH_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir that all executors share.

    Where the setting is absent on one machine (tests, a notebook) a temporary folder takes its place; on a cluster that raises.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if current is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="evidrill-"))
        current = sc.getCheckpointDir()
    return current.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder, which survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Narrow rows in a partition of a packed table.
PACKED_ROWS = 20_000


def packed(df: DataFrame) -> tuple[DataFrame, int]:
    """cut(df) in as few partitions as its rows need, and the number of rows.

    Iterative operators end with small tables; without this each of their shuffles would still write files for as many tasks as the
    first one had partitions.
    """
    out = cut(df)
    rows = out.count()
    need = max(1, -(-rows // PACKED_ROWS))
    return (out.coalesce(need) if need < out.rdd.getNumPartitions() else out), rows


def settled(spark: SparkSession) -> None:
    """Lets the driver collect its garbage between rounds.

    Each task leaves its metrics there, so that the heap would grow to its limit with the number of tasks; and what nothing refers to
    any more (broadcasts, shuffle files, checkpoints) is dropped only when the driver's references to it are collected.
    """
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet below the shared folder and reads it back."""
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_batches(spark: SparkSession) -> None:
    """Small Arrow batches, so that a batch of very long texts stays within a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def same(a: Column, b: Column) -> Column:
    """Equality under which nulls are equal; still an equi-join key."""
    return a.eqNullSafe(b)


#: Rows up to which a table of a few numbers a row is broadcast; above, the join shuffles.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if counting shows that it has at most `rows` rows. df should be cut or stored."""
    return F.broadcast(df) if df.count() <= rows else df


def drop_rows(docs: DataFrame, dropped: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs, all their columns, whose key isn't among dropped's keys; null keys match nulls."""
    ids = cut(dropped.select(F.col(key).alias("__drop_id")).distinct())
    return docs.join(small(ids), same(docs[key], F.col("__drop_id")), "left_anti")
