"""K-d tree partitioning of documents into shards of near-equal bytes, in DataFrame operations only.

Texts that are equal form one unit and stay together. A node that is to hold ``parts`` shards is
split along the metadata dimension in which its units spread widest, at the weighted quantile that
gives each side its share of shards: the median, wherever ``parts`` is even. The cut is found from
histograms of a sort key, one digit of the key at a time, so no node is ever sorted or held in one
task. Units that weigh more than a small share of a shard come first in the order of their node,
so that the cut falls between light units. Splitting goes on until every node is one shard, which
is when it has reached the target bytes.

Size is the UTF-8 bytes of the text plus 1, 1 for a null text. Null metadata counts as an empty
string or the smallest number. An empty table gives no rows; repeated rows get slots of their own.
All columns pass through; a column called ``size``, ``shard`` or ``slot`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, stored

#: The sort key has three digits of so many bits.
DIGIT, DIGITS = 13, 3
HALF, TIE = DIGIT * DIGITS - 1, (DIGIT * DIGITS - 1) // 2
#: A unit is heavy if it weighs more than a shard's bytes over this.
HEAVY = 32
#: Rows of a shard that one numbering task sorts, about.
PER_TASK = 100_000
#: Tables with a row per node are broadcast up to this many shards.
BROADCAST_NODES = 100_000

NODE = ["first", "parts"]


def byte_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _unit(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def dimensions(docs: DataFrame) -> dict[str, Column]:
    """Metadata of a document as numbers: size on a log scale, and every other column but the text."""
    dims = {"bytes": F.log2(byte_size(F.col("text")))}
    for name, kind in docs.dtypes:
        if name == "text":
            continue
        if kind in ("bigint", "int", "smallint", "tinyint", "double", "float") or kind.startswith("decimal"):
            number = F.col(name).cast("double")
            dims[name] = F.when(F.isnan(number), 0.0).otherwise(number)
        elif kind == "string":
            dims[name] = F.crc32(F.coalesce(F.col(name), F.lit("")).cast("binary")).cast("double")
    return dims


def units_of(docs: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """One row per distinct text: (unit, w, n, d), with the smallest value of each dimension in ``d``."""
    rows = docs.select(_unit(F.col("text")).alias("unit"), byte_size(F.col("text")).alias("size"), *[c.alias(f"d{i}") for i, c in enumerate(dims.values())])
    grouped = rows.groupBy("unit").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n"), *[F.min(f"d{i}").alias(f"d{i}") for i in range(len(dims))])
    return grouped.select("unit", "w", "n", F.array(*[F.coalesce(f"d{i}", F.lit(0.0)) for i in range(len(dims))]).alias("d"))


def _few(df: DataFrame, shards: int) -> DataFrame:
    return F.broadcast(df) if shards <= BROADCAST_NODES else df


def _cut(keyed: DataFrame, shards: int) -> DataFrame:
    """(first, parts, cut): units whose key is smaller go left. Digit by digit, the bin is found in which the goal lies."""
    so_far = None
    for r in range(DIGITS):
        shift = DIGIT * (DIGITS - 1 - r)
        rows = keyed.select(*NODE, "goal", "w", F.shiftright("key", shift).alias("prefix"))
        before = F.lit(0).cast("long")
        if so_far is not None:
            rows = rows.join(_few(so_far.select(*NODE, F.col("prefix").alias("_prefix"), F.col("before").alias("_before")), shards), NODE)
            rows, before = rows.filter(F.shiftright("prefix", DIGIT) == F.col("_prefix")), F.col("_before")
        bins = rows.groupBy(*NODE, "prefix").agg(F.sum("w").alias("w"), F.first("goal").alias("goal"), F.first(before).alias("base"))
        upto = F.col("base") + F.sum("w").over(Window.partitionBy(*NODE).orderBy("prefix"))
        so_far = (bins.withColumn("upto", upto).filter((F.col("upto") >= F.col("goal")) & (F.col("upto") - F.col("w") < F.col("goal")))
                  .select(*NODE, "prefix", (F.col("upto") - F.col("w")).alias("before"), "w", "goal"))
    inside = (F.col("goal") - F.col("before") >= F.col("w") / 2).cast("long")
    return so_far.select(*NODE, (F.col("prefix") + inside).alias("cut"))


def _split(placed: DataFrame, ranges: list[tuple[float, float]], shards: int) -> DataFrame:
    """Split every node of more than one part."""
    n = len(ranges)
    nodes = placed.filter("parts > 1")
    stats = nodes.groupBy(*NODE).agg(F.sum("w").alias("total"), F.array(*[F.min(F.col("d")[i]) for i in range(n)]).alias("lo"),
                                     F.array(*[F.max(F.col("d")[i]) for i in range(n)]).alias("hi"))
    spread = F.array(*[(F.col("hi")[i] - F.col("lo")[i]) / ((b - a) or 1.0) for i, (a, b) in enumerate(ranges)])
    stats = stats.withColumn("axis", F.array_position(spread, F.array_max(spread)).cast("int") - 1)
    at = F.col("axis")
    stats = stats.select(*NODE, "total", "axis", F.col("lo")[at].alias("lo"), F.greatest(F.col("hi")[at] - F.col("lo")[at], F.lit(1e-300)).alias("width"),
                         (F.col("total") * F.floor(F.col("parts") / 2) / F.col("parts")).alias("goal"))
    keyed = nodes.join(_few(stats, shards), NODE)
    most = (1 << (HALF - TIE)) - 1
    light = F.least(F.floor((F.col("d")[F.col("axis")] - F.col("lo")) / F.col("width") * most), F.lit(most)) + (1 << (HALF - TIE))
    heavy = F.floor((1 - F.col("w") / F.col("total")) * most)
    place = F.when(F.col("w") * F.col("parts") * HEAVY > F.col("total"), heavy).otherwise(light)
    tie = F.pmod(F.xxhash64("unit"), F.lit(1 << TIE))
    keyed = keyed.withColumn("key", F.shiftleft(place.cast("long"), TIE) + tie)
    moved = keyed.join(_few(_cut(keyed, shards), shards), NODE)
    right, half = F.col("key") >= F.col("cut"), F.floor(F.col("parts") / 2).cast("int")
    moved = moved.select("unit", "w", "n", "d", (F.col("first") + F.when(right, half).otherwise(0)).cast("int").alias("first"),
                         F.when(right, F.col("parts") - half).otherwise(half).cast("int").alias("parts"))
    return moved.unionByName(placed.filter("parts = 1"))


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, by: list[str] | None = None) -> DataFrame:
    """``docs`` with ``size``, ``shard`` and ``slot`` (from 0 without a gap in each shard). Give the number of shards or the
    bytes of one. ``by`` names the metadata columns to split along, all but the text if not given. Columns that are not
    selected from the result, the text among them, are not moved."""
    dims = dimensions(docs.select("text", *(by if by is not None else [c for c in docs.columns if c != "text"])))
    units = stored(units_of(docs, dims), "units")
    ends = [f(F.col("d")[i]) for i in range(len(dims)) for f in (F.min, F.max)]
    total, rows, *bounds = units.agg(F.sum("w"), F.sum("n"), *ends).first()
    if shards is None:
        shards = max(1, -(-(total or 0) // target_bytes))
    ranges = [(a or 0.0, b or 0.0) for a, b in zip(bounds[::2], bounds[1::2])]
    placed = units.withColumn("first", F.lit(0)).withColumn("parts", F.lit(shards))
    for _ in range((shards - 1).bit_length()):
        placed = stored(_split(placed, ranges, shards), "kd-level")
    where = placed.select("unit", F.col("first").alias("shard"))
    kept = docs.drop("size", "shard", "slot")
    out = (kept.withColumn("size", byte_size(F.col("text"))).withColumn("_unit", _unit(F.col("text")))
           .join(where.withColumnRenamed("unit", "_unit"), "_unit"))
    buckets = max(4, -(-(rows or 0) // (shards * PER_TASK)))
    out = numbered(out, ["shard"], ["doc_id", "_unit"], F.pmod(F.xxhash64("doc_id", "_unit"), F.lit(buckets)), "slot")
    return out.select(*kept.columns, "size", "shard", "slot")
