"""Equi-join idioms of the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ancestors, basename
from .ranking import keep_first
from .stats import majority

#: Folders that are sent to the tasks instead of joined by key, and how many are counted to find them.
CROWDED, TRACKED = 256, 16_384


def attach_labels(det: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join class index -> species, common name, site flag.

    Left unhinted: Catalyst broadcasts the labels when their measured size is under its threshold.
    """
    return det.join(labels, "class_idx", "left")


def join_by_basename(det: DataFrame, catalog: DataFrame) -> DataFrame:
    """Detections x catalog on the bare file name; one catalog row per name, the first by path.

    Survives a renamed archive: the detection's own path is replaced by the catalog's.
    """
    first = keep_first(catalog.withColumn("__name", basename(F.col("file"))), ["__name"], [F.col("file")])
    return (det.withColumn("__name", basename(F.col("file"))).drop("file")
            .join(first, "__name", "left").drop("__name"))


def missing_from_catalog(det: DataFrame, catalog: DataFrame) -> DataFrame:
    """Distinct file names of detections absent from the catalog."""
    name = lambda df: df.select(basename(F.col("file")).alias("basename")).distinct()
    return name(det).join(name(catalog), "basename", "left_anti")


def event_pairs(df: DataFrame, event: str, item: str) -> DataFrame:
    """Unordered pairs within an event, ``item_i`` < ``item_j``.

    A self join on the event key (an event holds the recorders of one array). Both
    sides are the same plan, so the exchange is computed once and reused.
    """
    rest = [c for c in df.columns if c != event]
    a = df.select(event, *[F.col(c).alias(f"{c}_i") for c in rest])
    b = df.select(event, *[F.col(c).alias(f"{c}_j") for c in rest])
    return a.join(b, event).where(F.col(f"{item}_i") < F.col(f"{item}_j"))


def triangles(pairs: DataFrame, event: str, i: str = "i", j: str = "j") -> DataFrame:
    """Recorder triples whose three pairs all survived: two equi joins on the pair table."""
    ab = pairs.select(event, F.col(i).alias("a"), F.col(j).alias("b"))
    bc = pairs.select(event, F.col(i).alias("b"), F.col(j).alias("c"))
    ac = pairs.select(event, F.col(i).alias("a"), F.col(j).alias("c"))
    return ab.join(bc, [event, "b"]).join(ac, [event, "a", "c"], "left_semi").select(event, "a", "b", "c")


def merge_fill(primary: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """All of ``primary`` plus the rows of ``fallback`` whose key it lacks."""
    return primary.unionByName(fallback.join(primary.select(key), key, "left_anti"), allowMissingColumns=True)


def pending(candidates: DataFrame, results: DataFrame, errors: DataFrame | None, key: str = "event_id",
            retry_errors: bool = False) -> DataFrame:
    """Candidates not yet in results, nor (unless retried) in errors."""
    done = results.select(key)
    if errors is not None and not retry_errors:
        done = done.unionByName(errors.select(key))
    return candidates.join(done.distinct(), key, "left_anti")


def used_flag(table: DataFrame, events: DataFrame, group: str, recorder: str, recorders: str,
              name: str = "used") -> DataFrame:
    """Flag (group, recorder) rows that occur in any event's recorder array."""
    used = events.select(group, F.explode(recorders).alias(recorder)).distinct().withColumn("__u", F.lit(True))
    return table.join(used, [group, recorder], "left").withColumn(name, F.col("__u").isNotNull()).drop("__u")


def under_folder(files: DataFrame, folders: DataFrame, path: str = "file", folder: str = "dir") -> DataFrame:
    """Files below each folder: equi join on the file's own ancestors instead of a prefix test."""
    return (files.withColumn(folder, F.explode(ancestors(F.col(path))))
            .join(folders.select(folder).distinct(), folder))


def group_by_majority(files: DataFrame, folders: DataFrame, group: str = "recorder_group") -> DataFrame:
    """Majority group of the catalog rows below each folder."""
    return majority(under_folder(files, folders), ["dir"], group)


def nearest_ancestor(dirs: DataFrame, marked: DataFrame, dir_col: str = "dir") -> DataFrame:
    """For each folder the closest folder at or above it listed in ``marked`` (column ``at``).

    Folders near the root stand above a large share of all others. Whatever stands above the most is settled in the tasks that hold the folders
    below it, only the rest is joined by key. Counts of those may be rough: each folder takes one of the two ways, and both are exact.
    """
    own, dirs, marks = F.col(dir_col), dirs.select(dir_col).distinct(), marked.select("at").distinct()
    depth = F.length(own) - F.length(F.replace(own, F.lit("/"), F.lit(""))) + 1
    begin = F.call_function("substring_index", own, F.lit("/"), F.col("__n"))
    up = dirs.withColumn("__n", F.explode(F.sequence(F.lit(1), depth))).withColumn("at", begin)
    most = up.where(F.col("__n") < depth).agg(F.call_function("approx_top_k", F.col("at"), F.lit(CROWDED), F.lit(TRACKED)).alias("t")).select(F.inline("t")).select(F.col("item").alias("at"))
    crowded = most.join(marks.select(F.col("at").alias("__at")), F.col("at") == F.col("__at"), "left").select("at", F.col("__at").isNotNull().alias("__marked"))
    met = up.join(F.broadcast(crowded), "at", "left")
    hits = met.where("__marked").select(dir_col, "__n").unionByName(met.where("__marked IS NULL").join(marks, "at").select(dir_col, "__n"))
    return hits.groupBy(dir_col).agg(F.max("__n").alias("__n")).select(dir_col, begin.alias("at"))


def latest_row(df: DataFrame, by: list[str], time: str, order: str) -> DataFrame:
    """Newest row per key, later row on ties."""
    return keep_first(df, by, [F.col(time).desc_nulls_last(), F.col(order).desc()])

