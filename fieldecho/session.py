"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "fieldecho", master: str | None = None,
                shuffle_partitions: int | None = None) -> SparkSession:
    """Build a session. On a cluster leave ``master`` and the partition count to
    the submitter: AQE coalesces small shuffle partitions and splits skewed ones."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def use_checkpoint_dir(spark: SparkSession) -> str:
    """Point the session at the shared folder named by ``spark.checkpoint.dir``.

    Only a local master with the setting unset (tests) gets a temporary folder; a
    cluster without the setting is an error, since a machine-local folder would
    not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        path = tempfile.mkdtemp(prefix="fieldecho-ckpt-")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never a local one), so a lost executor costs no recompute."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
