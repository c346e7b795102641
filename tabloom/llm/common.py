"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.session import cut_lineage, _ensure_checkpoint_dir

#: Rows per Arrow batch: bounds what a Python worker holds, whatever the length of the texts beside it.
BATCH_ROWS = 1000

#: What separates words in the contracts: space and the bytes 9 to 13.
SPACES = "\\x20\\x09-\\x0D"

__all__ = ["BATCH_ROWS", "SPACES", "all_columns", "batched", "cut_lineage", "lower_az", "read", "shared_folder", "short_batches", "skewed_join", "written"]

_ROOT = str(Path(__file__).resolve().parents[2])
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_az(c) -> Column:
    """Lower-case A-Z only; a null text counts as empty."""
    return F.translate(F.coalesce(c, F.lit("")), _UPPER, _LOWER)


def all_columns(df: DataFrame) -> list[Column]:
    """All columns, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def short_batches(spark: SparkSession) -> None:
    """Short Arrow batches, and this package on the workers' path where the job wasn't submitted with it."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(":")
    if _ROOT not in paths:
        environment["PYTHONPATH"] = ":".join([_ROOT, *filter(None, paths)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def batched(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` with short batches."""
    short_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors reach, below the one for checkpoints."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by a table in the shared folder; readers then read only the columns they need."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def skewed_join(rows: DataFrame, keyed: DataFrame, on: dict[str, str], weight: str, how: str = "inner", share: int = 1000) -> DataFrame:
    """Join ``rows`` with ``keyed``, which holds each key once and, in ``weight``, how many rows have it.

    Keys of more than one in ``share`` rows are fewer than ``share``, so they are broadcast and their rows
    stay where they are; all others meet by a shuffle in which no key is large.  ``on`` maps columns of
    ``rows`` to those of ``keyed``; both frames are read twice and should be tables.
    """
    total = keyed.agg(F.sum(weight)).first()[0] or 0
    hot, cold = keyed.where(F.col(weight) * share > total), keyed.where(F.col(weight) * share <= total)
    same = reduce(Column.__and__, [F.col(a) == F.col(b) for a, b in on.items()])
    near = rows.join(F.broadcast(hot), same)
    # tables are sized by their compressed files, so the others would be broadcast while they are large
    far = rows.join(F.broadcast(hot.select(*on.values())), same, "left_anti").join(cold.hint("merge"), same, how)
    return near.unionByName(far)
