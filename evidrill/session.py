"""Session settings and table access."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A session for one machine; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, where their Python wouldn't find it: it does by the folder that a
    session on one machine starts in, or by PYTHONPATH."""
    root = Path(__file__).resolve().parents[1]
    known = {os.path.realpath(p) for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p}
    if str(root) in known or any(os.path.realpath(os.path.join(p, "evidrill")) == str(root / "evidrill") for p in known):
        return
    sc = spark.sparkContext
    if getattr(sc, "_evidrill_shipped", False):
        return
    # the file has to stay while the session runs: the driver hands it out
    path = os.path.join(tempfile.mkdtemp(prefix="evidrill-"), "evidrill.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted((root / "evidrill").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(path)
    sc._evidrill_shipped = True
