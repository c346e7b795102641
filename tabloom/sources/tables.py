"""Table sources and sinks, and saved models."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema=None) -> DataFrame:
    """CSV with a header row, parquet, ORC or JSON.

    Without ``schema`` a CSV needs one extra pass to infer its types; pass the schema for large inputs.
    """
    fmt = fmt or next((f for f in ("csv", "parquet", "orc", "json") if path.rstrip("/").endswith("." + f)), "parquet")
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", True)
        reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    elif schema:
        reader = reader.schema(schema)
    return reader.format(fmt).load(path)


def spread(df: DataFrame) -> DataFrame:
    """Use every core on a scan that arrives as fewer tasks than there are cores (one small file).

    Scans of many files are left alone.  Filters and column pruning still reach the scan.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of one task at most, and rows from which one more core is worth a task.
TASK_ROWS, CORE_ROWS = 500_000, 50_000


def bounded_tasks(df: DataFrame) -> DataFrame:
    """Deal many rows to tasks of at most TASK_ROWS rows, and to every core from CORE_ROWS rows a core on.

    For rows that are kept and read many times; frames that arrive in enough tasks are left alone.
    """
    rows, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    tasks = max(-(-rows // TASK_ROWS), min(cores, rows // CORE_ROWS))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists", partition_by=()) -> None:
    """Write in parallel, one file per partition; CSV files carry a header."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def save_model(model: PipelineModel, path: str, **metadata) -> None:
    """Save a fitted model and a one-row metadata table next to it."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "metadata string").write.mode("overwrite").json(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    meta = spark.read.json(f"{path}/metadata").first()["metadata"]
    return PipelineModel.load(f"{path}/model"), json.loads(meta)
