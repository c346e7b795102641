"""Session helpers: a local session for tests and the one place that cuts lineage."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parents[1])


def local_session(cpus: str = "*", app: str = "tabloom", **conf) -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tabloom-ckpt-"))
    else:
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder every executor can reach; "
            "iterative and ordered operators keep their intermediate rows there"
        )


def reach_workers(spark: SparkSession) -> None:
    """This package on the workers' path where the job wasn't submitted with it; for functions that run in tasks."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(":")
    if _ROOT not in paths:
        environment["PYTHONPATH"] = ":".join([_ROOT, *filter(None, paths)])


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder, which every executor can reach."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}_{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: rows survive the loss of any executor."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame) -> DataFrame:
    """Cut lineage by a table in the shared folder: smaller than a checkpoint, and readers take the columns they need."""
    folder = shared_path(df.sparkSession, "saved")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
