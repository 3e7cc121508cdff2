"""Commands run end to end on small files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldecho import cli
from test_files import archive_dir  # noqa: F401  (fixture)


def test_catalog_and_sun_commands(spark, archive_dir, tmp_path):  # noqa: F811
    conf = tmp_path / "site.toml"
    conf.write_text(f'[site]\ntimezone="America/Chicago"\nlat=33.7\nlon=-93.3\n[audio]\ntopdirs=["{archive_dir}"]\nsample_rate=2000\n')
    base = ["--config", str(conf)]
    for _ in range(2):  # the second run indexes nothing new
        cli.main([*base, "catalog", "--drafts", str(tmp_path / "d"), "--out", str(tmp_path / "c")])
    assert spark.read.parquet(str(tmp_path / "d")).count() == 5
    assert spark.read.parquet(str(tmp_path / "c")).where(F.col("duration") == 10).count() == 5
    cli.main([*base, "sun", "--out", str(tmp_path / "s"), "--date-start", "2024-01-01", "--date-end", "2024-01-11"])
    assert spark.read.parquet(str(tmp_path / "s")).count() == 10


def scorer(x, rate):
    """Loudness of each window as its only class."""
    return x[:, :3], 20 * np.abs(x).max(axis=1, keepdims=True) - 2


def test_infer_and_prepare_commands(spark, archive_dir, tmp_path):  # noqa: F811
    conf = tmp_path / "site.toml"
    conf.write_text(f'[site]\ntimezone="America/Chicago"\nlat=33.7\nlon=-93.3\n[audio]\ntopdirs=["{archive_dir}"]\nsample_rate=2000\n')
    base, out = ["--config", str(conf)], lambda n: str(tmp_path / n)
    for _ in range(2):  # the second run finds nothing new
        cli.main([*base, "infer", "--scorer", "test_cli:scorer", "--out", out("w"), "--manifest", out("m"), "--rate", "2000", "--low", "0", "--mode", "file-peak"])
    win = spark.read.parquet(out("w"))
    files = win.select("file").distinct().count()
    assert files == spark.read.json(out("m")).count() > 0 and win.where("error IS NULL").count() > 0
    hit = win.where("size(probs) > 0").select("file", "win_start").limit(5)
    det = hit.withColumn("start_datetime", F.to_timestamp(F.lit("2024-01-01 00:00:00"))).withColumn("call_datetime", F.timestamp_micros(F.unix_micros("start_datetime") + F.round(F.col("win_start") * 1e6).cast("bigint")))
    det.select("*", F.lit("Wren").alias("common_name"), F.lit(0.95).alias("prob"), F.lit(2000).alias("rate")).write.parquet(out("d"))
    det.select(F.lit("e").alias("event_id"), "call_datetime").limit(1).write.parquet(out("c"))
    hours = spark.createDataFrame([("2024-01-01 00:00:00", 20.0, 50.0, 20.0, 343.5, "x")], "t string, temp_c double, rh double, temp_c_raw double, speed double, source string")
    hours.select(F.to_timestamp("t").alias("dt"), "temp_c", "rh", "temp_c_raw", "speed", "source").write.parquet(out("h"))
    cli.main([*base, "prepare", "--candidates", out("c"), "--detections", out("d"), "--out-dir", out("p"), "--weather", out("h")])
    assert spark.read.parquet(out("p/profiles")).first()["n_clips"] == det.count() and spark.read.parquet(out("p/candidates")).first()["speed"] > 300


def test_unknown_command():
    with pytest.raises(SystemExit):
        cli.main(["nope"])
