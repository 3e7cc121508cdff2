"""Writers: Spark's commit protocol replaces temp-file renames and hand-made shards."""

from __future__ import annotations

import hashlib
import json
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.ranking import keep_last
from .sources.tables import exists


def write_catalog(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet sorted by start inside each file; partitions prune later reads."""
    out = df.sortWithinPartitions("start_datetime") if "start_datetime" in df.columns else df
    out.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_windows(df: DataFrame, path: str, shard_rows: int = 200_000) -> None:
    """Append classifier windows in files of at most ``shard_rows`` rows, uniquely named."""
    df.write.mode("append").option("maxRecordsPerFile", shard_rows).parquet(path)


def step_path(root: str, name: str, params: dict) -> str:
    """Folder of a stored step, keyed by its parameters: other arguments, other folder."""
    digest = hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]
    return f"{root.rstrip('/')}/{name}-{digest}"


def stored(df: DataFrame, root: str, name: str, params: dict, force: bool = False) -> DataFrame:
    """Write a step once and read it back; later runs with the same parameters reuse it."""
    spark, path = df.sparkSession, step_path(root, name, params)
    if force or not exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_run(df: DataFrame, path: str, run_id: int) -> None:
    """Append results under a run number."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(path)


def newest_rows(runs: DataFrame, key: str = "event_id", then: tuple[str, ...] = ()) -> DataFrame:
    """Newest row per key of stacked runs; the columns ``then``, largest first, settle rows of one run."""
    return keep_last(runs, [key], ["run_id", *then])


def consolidated(spark: SparkSession, path: str, key: str = "event_id", then: tuple[str, ...] = ()) -> DataFrame:
    """``newest_rows`` of all stored runs."""
    return newest_rows(spark.read.option("mergeSchema", True).parquet(path), key, then)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_manifest(files: DataFrame, path: str) -> None:
    """Append processed files; the next run skips them with an anti join."""
    files.select("file").distinct().write.mode("append").json(path)


def record_invocation(spark: SparkSession, path: str, **extra) -> None:
    """Arguments and time of a run, next to its output."""
    row = json.dumps({"argv": sys.argv, "time": datetime.now(timezone.utc).isoformat(), **extra}, default=str)
    spark.createDataFrame([(row,)], "value string").write.mode("append").text(path)
