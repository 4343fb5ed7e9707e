"""Snapshots and dated model paths.

The reference writes the normalised table with ``write_csv`` and reads it
back with ``read_csv``; here the same round trip goes through Spark's CSV
source with an explicit schema (no inference), into the shared folder.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def write_snapshot(df: DataFrame, path: str, fmt: str = "csv") -> None:
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def read_snapshot(spark: SparkSession, path: str, schema: StructType, fmt: str = "csv") -> DataFrame:
    r = spark.read.schema(schema)
    if fmt == "csv":
        return r.option("header", True).option("mode", "FAILFAST").csv(path)
    return r.format(fmt).load(path)


def dated_path(base: str, name: str, day: _dt.date | None = None) -> str:
    """``<base>/<name>_<yyyy-mm-dd>`` like the reference's model folders."""
    day = day or _dt.date.today()
    return f"{base.rstrip('/')}/{name}_{day.isoformat()}"


def export_scores(scores: DataFrame, path: str, as_of: _dt.date) -> None:
    """Append scored customers under ``as_of=<date>`` (one folder per scoring
    day; re-running a day replaces only that day's partition)."""
    from pyspark.sql import functions as F
    (scores.withColumn("as_of", F.lit(as_of))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("as_of").parquet(path))
