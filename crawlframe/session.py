"""Sessions with the settings the library is tested with."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def show_workers(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package wherever the driver was started; a cluster gets it by --py-files."""
    root, held = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in held.get("PYTHONPATH", "").split(":"):
        held["PYTHONPATH"] = ":".join(filter(None, [root, held.get("PYTHONPATH", "")]))


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.pyspark.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where its scan has fewer partitions than the cluster has cores: for rows that cost much each, as pages to parse do. A large table stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df
