"""Incremental runs as file streams: the stream's checkpoint is the processed-files manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.detections import explode_windows, join_catalog
from ..schemas import WINDOW_SIDECAR


def new_windows(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Sidecar files as they appear; each is read exactly once per checkpoint."""
    reader = spark.readStream.schema(WINDOW_SIDECAR).option("pathGlobFilter", "emb_*.parquet").option("recursiveFileLookup", True)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def detect_incrementally(windows: DataFrame, labels: DataFrame, catalog: DataFrame, zone: str, out: str, checkpoint: str,
                         available_now: bool = True) -> StreamingQuery:
    """Append joined detections of new windows, partitioned by day."""
    det = join_catalog(explode_windows(windows).join(labels, "class_idx", "left"), catalog, zone)
    day = det.withColumn("day", F.to_date("call_datetime"))
    writer = (day.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
              .partitionBy("day").outputMode("append"))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
