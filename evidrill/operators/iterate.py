"""Cutting lineage in iterative operators, and joins with small tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a table of a few numbers a row is broadcast; above, the join shuffles.
BROADCAST_ROWS = 200_000


def _folder(df: DataFrame) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, on one machine (tests), a temporary one; on a cluster it raises."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="evidrill-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    _folder(df)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder: of tables with many rows of few values it takes a tenth of a checkpoint's disk."""
    path = f"{_folder(df)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """df, which is cut, marked for broadcast if counting shows few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
