"""Results kept on disk under digests of configuration and data."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

FORMAT = 1


def config_digest(config: object) -> str:
    """The digest of all options, whatever their order."""
    plain = asdict(config) if is_dataclass(config) else config
    return hashlib.sha256(json.dumps(plain, sort_keys=True, default=str).encode()).hexdigest()


def data_digest(df: DataFrame) -> str:
    """A digest of the rows and the schema that doesn't hang on the rows' order; one aggregate."""
    columns = sorted(df.columns)
    a, b = F.xxhash64(*columns), F.hash(*columns)
    n, s, t = df.agg(F.count("*"), F.sum(a.cast("decimal(38,0)")), F.sum(b.cast("long") * F.pmod(a, F.lit(1 << 20)))).first()
    return hashlib.sha256(json.dumps([columns, [t_ for _, t_ in sorted(df.dtypes)], n, str(s), str(t)]).encode()).hexdigest()


def save(result: DataFrame, path: str, config: object, data: DataFrame) -> None:
    """The result with a manifest of one row beside it; the manifest comes last, so a broken write is a miss."""
    spark = result.sparkSession
    result.write.mode("overwrite").parquet(f"{path}/result")
    row = [(FORMAT, config_digest(config), data_digest(data))]
    spark.createDataFrame(row, "format int, config string, data string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def check(spark: SparkSession, path: str, config: object, data: DataFrame) -> tuple[str, DataFrame | None]:
    """('HIT', result), or 'MISS_NO_FILE', 'MISS_CONFIG', 'MISS_DATA' and nothing."""
    try:
        row = spark.read.parquet(f"{path}/manifest").first()
    except AnalysisException:
        return "MISS_NO_FILE", None
    if row is None or row["format"] != FORMAT:
        return "MISS_NO_FILE", None
    if row["config"] != config_digest(config):
        return "MISS_CONFIG", None
    if row["data"] != data_digest(data):
        return "MISS_DATA", None
    return "HIT", spark.read.parquet(f"{path}/result")


def cached(spark: SparkSession, path: str, config: object, data: DataFrame, compute) -> DataFrame:
    """The kept result of compute(data), computed and kept on a miss."""
    state, found = check(spark, path, config, data)
    if found is None:
        save(compute(data), path, config, data)
        found = spark.read.parquet(f"{path}/result")
    return found


def clear(spark: SparkSession, path: str) -> bool:
    """Deletes a kept result; says whether there was one."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True))
