"""Register a query next to the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.sources.tables import read_table, spread

QUERIES: dict = {}
ORACLES: dict = {}


class Tables:
    """``t.orders`` reads the parquet table of that name.

    The texts are heavy to process, so a scan of few tasks is spread over the cores; ``wide`` does the
    same for other tables.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self._dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        df = read_table(self.spark, f"{self._dir}/{name}.parquet")
        return spread(df) if name == "documents" else df

    def wide(self, name: str) -> DataFrame:
        return spread(getattr(self, name))


def _names(rnd):
    return [(c, d) for d, cols in (rnd or {}).items() for c in cols.split()]


def query(name: str, sql: str | None = None, rnd: dict | None = None):
    """``rnd`` maps digits to the names of the float columns rounded on both sides."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Tables(spark, sf_dir))
            if rnd:
                df = df.withColumns(
                    {c: F.round(F.col(f"`{c}`").cast("double"), d) + F.lit(0.0) for c, d in _names(rnd)}
                )
            return df

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            if rnd:
                rep = ", ".join(f'round(CAST("{c}" AS DOUBLE), {d}) + 0.0 AS "{c}"' for c, d in _names(rnd))
                ORACLES[name] = f"SELECT * REPLACE ({rep}) FROM ({sql}) q"
            else:
                ORACLES[name] = sql
        return fn

    return register


def union_all(parts) -> str:
    return " UNION ALL ".join(parts)
