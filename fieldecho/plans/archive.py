"""Archive audit as queries: where each deployment folder should live, and card ingest plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators.ranking import deepest_first, keep_first
from ..operators.relate import under_folder
from ..operators.stats import exact_percentiles, majority
from ..session import cut_lineage

DEFAULT_GROUP = "RecorderData"


def _hierarchy(dirs: DataFrame) -> DataFrame:
    """Collection date (parent or grandparent), its folder, and the group between."""
    p1, p2 = text.dirname(F.col("dir")), text.dirname(text.dirname(F.col("dir")))
    d1, d2 = text.is_collection_date(text.basename(p1)), text.is_collection_date(text.basename(p2))
    return (dirs.where(d1 | d2)
            .withColumn("collection", F.when(d1, text.basename(p1)).otherwise(text.basename(p2)))
            .withColumn("date_dir", F.when(d1, p1).otherwise(p2))
            .withColumn("current_group", F.when(~d1, text.basename(p1))))


def all_dirs(files: DataFrame) -> DataFrame:
    return files.select(F.explode(text.ancestors(F.col("file"))).alias("dir")).distinct().where("dir <> ''")


def _candidates(files: DataFrame, known_groups: DataFrame | None) -> DataFrame:
    """Folders to judge: (dir, recorder, pass), in the order of the three passes."""
    dirs = all_dirs(files).withColumn("name", text.basename(F.col("dir")))
    parent, grand = text.dirname(F.col("dir")), text.dirname(text.dirname(F.col("dir")))
    inner = dirs.where(text.is_recorder_dir(F.col("name"))).withColumn("pname", text.basename(parent))
    if known_groups is not None:
        known = known_groups.select(F.col("recorder_group").alias("pname"), F.lit(True).alias("known")).distinct()
        inner = inner.join(known, "pname", "left")
    else:
        inner = inner.withColumn("known", F.lit(None).cast("boolean"))
    itself = (F.coalesce("known", F.lit(False)) | text.is_collection_date(F.col("pname"))
              | (text.is_collection_date(text.basename(grand)) & ~text.is_recorder_dir(F.col("pname"))))
    first = inner.select(F.when(itself, F.col("dir")).otherwise(parent).alias("dir"), F.col("name").alias("recorder"),
                         F.col("dir").alias("seen"), F.lit(1).alias("pass"))
    waves = files.where(text.is_wave(F.col("name"))).withColumn("recorder", text.parse_filename(F.col("file"))["recorder"])
    cards = dirs.where(text.looks_like_card_id(F.col("name"))).select("dir")
    second = (majority(under_folder(waves.where("recorder <> ''").select("file", "recorder"), cards), ["dir"], "recorder")
              .select("dir", "recorder", F.col("dir").alias("seen"), F.lit(2).alias("pass")))
    canon = dirs.where(text.is_canonical_dir(F.col("name")))
    third = canon.select("dir", F.regexp_extract("name", r"^(BARLT_\d{8}|S4A\d{5}[^_]*)", 1).alias("recorder"),
                         F.col("dir").alias("seen"), F.lit(3).alias("pass"))
    return keep_first(first.unionByName(second).unionByName(third), ["dir"], [F.col("pass"), F.col("seen")]).drop("seen")


def scan(files: DataFrame, catalog: DataFrame | None = None, zones: DataFrame | None = None) -> DataFrame:
    """Proposed renames: current, proposed, recorder, start, end, collection, current_group, target_group, status.

    The target group is the catalog's majority below the folder, else the recorder's
    majority, else the zone of the median file position, else the current group, else
    a default. Folders that would collide get a running suffix.
    """
    # read several times below, so it is stored once
    todo = cut_lineage(_hierarchy(_candidates(files, catalog.select("recorder_group") if catalog is not None else None)))
    waves = under_folder(files.where(text.is_wave(F.col("name"))).withColumn("p", text.parse_filename(F.col("file")))
                         .select("file", "p.start_datetime", "p.latitude", "p.longitude"), todo)
    spans = waves.groupBy("dir").agg(F.min(F.to_date("start_datetime")).alias("start"), F.max(F.to_date("start_datetime")).alias("end"))
    df = todo.join(spans, "dir", "left")
    picks: list[Column] = []
    if catalog is not None:
        df = df.join(majority(under_folder(catalog.select("file", "recorder_group"), todo), ["dir"], "recorder_group")
                     .withColumnRenamed("recorder_group", "g_path"), "dir", "left")
        df = df.join(majority(catalog, ["recorder"], "recorder_group").withColumnRenamed("recorder_group", "g_rec"), "recorder", "left")
        picks += [F.col("g_path"), F.col("g_rec")]
    if zones is not None:
        axes = waves.select("dir", F.inline(F.array(F.struct(F.lit("y").alias("a"), F.col("latitude").alias("v")),
                                                    F.struct(F.lit("x").alias("a"), F.col("longitude").alias("v")))))
        mid = (exact_percentiles(axes, ["dir", "a"], "v", {"m": 0.5}).groupBy("dir")
               .agg(F.max(F.when(F.col("a") == "x", F.col("m"))).alias("longitude"), F.max(F.when(F.col("a") == "y", F.col("m"))).alias("latitude")))
        df = df.join(geo.join_zones(mid, zones).select("dir", F.col("recorder_group").alias("g_zone")), "dir", "left")
        picks.append(F.col("g_zone"))
    own = F.when(~text.looks_like_card_id(F.col("current_group")), F.col("current_group"))
    df = df.withColumn("target_group", F.coalesce(*picks, own, F.lit(DEFAULT_GROUP)))
    name, same = text.basename(F.col("dir")), F.coalesce(F.col("current_group") == F.col("target_group"), F.lit(False))
    settled = text.is_canonical_dir(name) & same
    df = df.where(~((F.col("pass") == 3) & same))
    base = F.concat_ws("/", "date_dir", "target_group", F.when(F.col("pass") == 3, name).otherwise(
        text.canonical_dir(F.col("recorder"), F.col("start"), F.col("end"))))
    moves = ~settled & ((F.col("pass") == 3) | F.col("start").isNotNull())
    df = df.withColumn("base", F.when(moves, base))
    # folders without a proposal are told apart by their own name, so they do not meet in one task
    alone = F.when(F.col("base").isNull(), F.col("dir"))
    k = F.row_number().over(Window.partitionBy("base", alone).orderBy("pass", "dir"))
    df = df.withColumn("k", F.when(F.col("base").isNotNull(), k))
    proposed = F.when(settled, F.col("dir")).when(F.col("k") == 1, F.col("base")).when(F.col("k") > 1, F.concat_ws("_", "base", "k"))
    df = df.withColumn("proposed", proposed)
    status = (F.when(settled, "already_canonical").when(F.col("base").isNull(), "no_wavs").when(F.col("k") > 1, "conflict")
              .when(F.col("proposed") == F.col("dir"), "already_canonical").otherwise("ok"))
    return df.select(F.col("dir").alias("current"), "proposed", "recorder", F.when(moves, F.col("start")).alias("start"),
                     F.when(moves, F.col("end")).alias("end"), "collection",
                     F.coalesce("current_group", F.lit("(none)")).alias("current_group"), "target_group", status.alias("status"))


def report(proposals: DataFrame) -> DataFrame:
    """Counts per status and how many change group."""
    moved = (F.col("current_group") != F.col("target_group")) & (F.col("current_group") != "(none)")
    return proposals.groupBy("status").agg(F.count("*").alias("n"), F.count_if(moved).alias("n_group_changes"))


def move_list(proposals: DataFrame) -> DataFrame:
    """Renames to run, deepest folder first."""
    return deepest_first(proposals.where(F.col("status").isin("ok", "conflict") & (F.col("current") != F.col("proposed"))), "current")


# What a recorder card holds besides audio.
CARD_META = ("reclog.csv", "gps_log.csv", "gps_log.gpx", "loclog.txt", "wavfiles.parquet")
CARD_SKIP = (".Spotlight-V100", ".Trashes", ".fseventsd", "System Volume Information")


def card_identity(files: DataFrame) -> DataFrame:
    """Recorder id and kind per card (``card``, ``file``): a recorder folder, else the ids in file names."""
    rel = F.expr("substring(file, length(card) + 2)")
    top = F.when(F.size(F.split(rel, "/")) > 1, F.split(rel, "/")[0])
    solar = F.when(top.rlike(r"^BARLT_\d{8}$"), top)
    seg = F.nullif(F.regexp_extract(text.basename(F.col("file")), r"^(S4A\d{5})", 1), F.lit(""))
    got = files.groupBy("card").agg(F.min(solar).alias("a"), F.min_by(seg, F.when(seg.isNotNull(), F.col("file"))).alias("b"))
    return got.select("card", F.coalesce("a", "b").alias("recorder"), F.when(F.col("a").isNotNull(), "BARLT").when(F.col("b").isNotNull(), "S4A").alias("kind"))


def card_dates(files: DataFrame) -> DataFrame:
    """First and last recording day per card from its file names."""
    name = text.basename(F.col("file"))
    stamp = F.coalesce(F.nullif(F.regexp_extract(name, r"S(\d{8})T\d{6}", 1), F.lit("")),
                       F.nullif(F.regexp_extract(name, r"_(\d{8})_\d{6}_\d{3}\.wav$", 1), F.lit("")))
    return (files.where(text.is_wave(name)).withColumn("day", F.try_to_date(stamp, "yyyyMMdd"))
            .groupBy("card").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day")))


def card_plan(files: DataFrame, dest: str) -> DataFrame:
    """Copy list: audio, logs and text files; hidden and system files stay. ``dest`` names the target column."""
    name, low = text.basename(F.col("file")), F.lower(text.basename(F.col("file")))
    rel = F.expr("substring(file, length(card) + 2)")
    system = F.exists(F.split(rel, "/"), lambda p: p.isin(*CARD_SKIP))
    keep = low.endswith(".wav") | low.isin(*CARD_META) | low.startswith("logfile_") | low.endswith(".txt")
    return (files.where(keep & ~name.startswith(".") & ~system)
            .withColumn("target", F.concat_ws("/", F.col(dest), rel)))


def card_totals(jobs: DataFrame) -> DataFrame:
    """Files, audio files and bytes per card."""
    return jobs.groupBy("card").agg(F.count("*").alias("n_files"), F.count_if(text.is_wave(F.col("file"))).alias("n_audio"),
                                    F.sum("length").alias("bytes"))
