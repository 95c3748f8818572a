"""Normalisation, imputation, permutation and summaries of measurements.

measurements: protocol, experiment, protein, sample_type ('Sample' or 'Control'), replicate, value (null where missing).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL = ["protocol", "experiment", "protein"]


def normalized(m: DataFrame) -> DataFrame:
    """m with value less the mean of the values of its (protocol, experiment, protein), samples and controls together."""
    return m.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy(*CELL)))


def protocol_means(m: DataFrame) -> DataFrame:
    """(protocol, experiment, protein, mean); null without a value."""
    return m.groupBy(*CELL).agg(F.avg("value").alias("mean"))


def imputed(m: DataFrame, copies: int = 1, seed: int = 0, fallback_variance: float = 3.0) -> DataFrame:
    """copies completed versions of m (column copy): a missing value is drawn from a normal with the mean and standard deviation of the
    protein's values in its arm and protocol, or the overall mean and fallback_variance where these are unknown.

    Draws hang on seed, copy and the cell's key alone: two hashes make a normal deviate by Box and Muller.
    """
    row = Window.partitionBy("protocol", "protein", "sample_type")
    overall = m.agg(F.avg("value").alias("__all"))
    key = [F.lit(seed), F.col("copy"), *(F.col(c) for c in [*CELL, "sample_type", "replicate"])]

    def uniform(tag: str):
        return (F.pmod(F.xxhash64(F.lit(tag), *key), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    z = F.sqrt(-2 * F.log(uniform("r"))) * F.cos(2 * F.pi() * uniform("a"))
    full = m.withColumn("__mean", F.avg("value").over(row)).withColumn("__sd", F.stddev_samp("value").over(row)).crossJoin(F.broadcast(overall))  # one row
    full = full.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    draw = F.coalesce("__mean", "__all") + z * F.coalesce("__sd", F.sqrt(F.lit(fallback_variance)))
    return full.withColumn("value", F.coalesce("value", draw)).drop("__mean", "__sd", "__all")


def permuted(m: DataFrame, bait=None, copies: int = 1, seed: int = 0) -> DataFrame:
    """copies of m (column copy) whose values are dealt to the labels of their (protocol, experiment) anew.

    The permutation is one of the columns: it is the same for all proteins of an experiment, as labels are. Counts of
    samples and controls and each protein's values stay. The bait keeps its labels.
    """
    columns = m.select("protocol", "experiment", "sample_type", "replicate").distinct().withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    part = Window.partitionBy("copy", "protocol", "experiment")
    place = columns.withColumn("i", F.row_number().over(part.orderBy("sample_type", "replicate"))).withColumn("j", F.row_number().over(part.orderBy(F.xxhash64(F.lit(seed), "copy", "protocol", "experiment", "sample_type", "replicate"), "sample_type", "replicate")))
    to = place.select("copy", "protocol", "experiment", "i", F.col("sample_type").alias("new_type"), F.col("replicate").alias("new_replicate"))
    moves = place.drop("i").withColumnRenamed("j", "i").join(to, ["copy", "protocol", "experiment", "i"]).drop("i")
    out = m.join(F.broadcast(moves), ["protocol", "experiment", "sample_type", "replicate"])  # one row a column of the input files and copy
    pinned = F.col("protein") == F.lit(bait) if bait is not None else F.lit(False)
    return out.select("copy", "protocol", "experiment", "protein", F.when(pinned, F.col("sample_type")).otherwise(F.col("new_type")).alias("sample_type"), F.when(pinned, F.col("replicate")).otherwise(F.col("new_replicate")).alias("replicate"), "value")


def appended(a: DataFrame, b: DataFrame, suffix: str = "_perm2") -> DataFrame:
    """a and b, whose proteins take the suffix. Both must have the same protocols and experiments."""
    shape = lambda x: {tuple(r) for r in x.select("protocol", "experiment").distinct().collect()}
    if shape(a) != shape(b):
        raise ValueError("the tables differ in protocols or experiments")
    return a.withColumn("protein", F.col("protein").cast("string")).unionByName(b.withColumn("protein", F.concat(F.col("protein").cast("string"), F.lit(suffix))))


def empirical_log2fc(m: DataFrame) -> DataFrame:
    """(protein, protocol, experiment, log2fc): differences of means, sample less control; protocol null: the mean over protocols,
    experiment null: over experiments. Cells without one of the arms have none."""
    cells = m.groupBy(*CELL).agg(F.avg(F.when(F.col("sample_type") == "Sample", F.col("value"))).alias("s"), F.avg(F.when(F.col("sample_type") == "Control", F.col("value"))).alias("c"))
    cells = cells.select("protein", "protocol", "experiment", (F.col("s") - F.col("c")).alias("log2fc"))
    by_protocol = cells.groupBy("protein", "protocol").agg(F.avg("log2fc").alias("log2fc"))
    overall = by_protocol.groupBy("protein").agg(F.avg("log2fc").alias("log2fc"))
    return cells.unionByName(by_protocol, allowMissingColumns=True).unionByName(overall, allowMissingColumns=True)


def complete_cases(rows: DataFrame, *columns: str) -> DataFrame:
    """rows whose columns are neither null nor NaN."""
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).isNotNull() & ~F.isnan(F.col(c))
    return rows.where(cond)


def keep_first(rows: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key, in an explicit order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__i", F.row_number().over(w)).where("__i = 1").drop("__i")


def nested(m: DataFrame) -> DataFrame:
    """(protein, cells): one row a protein with its cells as an array of structs, ordered by the design."""
    cell = F.struct("protocol", "experiment", "sample_type", "replicate", "value")
    return m.groupBy("protein").agg(F.array_sort(F.collect_list(cell)).alias("cells"))


def coverage(m: DataFrame) -> DataFrame:
    """(protocol, experiment, proteins, cells, values): what each experiment holds; uneven numbers of proteins show files that differ."""
    return m.groupBy("protocol", "experiment").agg(F.countDistinct("protein").alias("proteins"), F.count("*").alias("cells"), F.count("value").alias("n_values"))
