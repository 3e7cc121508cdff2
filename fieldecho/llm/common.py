"""What the operators share: stored intermediate tables, gapless numbering, ASCII lower case."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldecho.session import use_checkpoint_dir


#: Rows of whole texts that one Arrow batch holds at most.
BATCH = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEAN_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def text_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH`` rows unless they are smaller: a batch of texts is held several times
    over, by the JVM and by its Python worker. The setting stays, since results are computed after the call returns."""
    rows = int(spark.conf.get(_BATCH_CONF))
    if rows <= 0 or rows > BATCH:
        spark.conf.set(_BATCH_CONF, str(BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: the lineage ends there,
    so a lost executor costs no recomputation, and the planner knows the table's size. What was shuffled on the way is deleted
    once the table is written. ``options`` go to the Parquet writer."""
    spark = df.sparkSession
    path = f"{use_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_CONF, None)
    spark.conf.set(_CLEAN_CONF, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_CONF)
        else:
            spark.conf.set(_CLEAN_CONF, before)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def numbered(df: DataFrame, group: list[str], order: list[str], bucket: Column, into: str) -> DataFrame:
    """Number the rows of each group from 0 without a gap.

    A group may hold any share of the rows, so it is cut into buckets: rows are ranked inside one
    (group, bucket), and each bucket starts where the counts of the earlier ones end. ``bucket``
    must be a function of the row's values. Columns whose names start with ``_n_`` are taken.
    """
    df = df.withColumn("_n_bucket", bucket)
    keys = [*group, "_n_bucket"]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n_count"))
    before = Window.partitionBy(*group).orderBy("_n_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_n_{k}") for k in keys],
                           F.coalesce(F.sum("_n_count").over(before), F.lit(0)).alias("_n_start"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    same = [F.col(k).eqNullSafe(F.col(f"_n_{k}")) for k in keys]
    out = df.withColumn("_n_rank", rank).join(starts, same, "left")
    return (out.withColumn(into, (F.col("_n_start") + F.col("_n_rank") - 1).cast("long"))
            .drop("_n_bucket", "_n_rank", "_n_start", *[f"_n_{k}" for k in keys]))
