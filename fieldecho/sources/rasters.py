"""Elevation rasters as packed tiles: one row per tile with its values in an array.

A raster file is opened twice. ``raster_blocks`` reads only its directory and lists the tiles or strips, ``raster_tiles`` then
seeks to each of them in tasks of their own, so a file of many gigabytes is spread over the cluster and never held whole. Points
meet tiles in an equi join by tile and pick their value by position (``deployments.add_elevation``).

Read are single-band files, plain or large (64-bit offsets), in either byte order, uncompressed or deflated, with or without
horizontal differencing. What cannot be read is in ``raster_problems``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Numbers of the directory's entries in the TIFF 6.0 and GeoTIFF formats, and the sizes of their types.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, BANDS, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, NODATA = 33550, 33922, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
PLAIN, DEFLATE, OLD_DEFLATE = 1, 8, 32946

BLOCK = ("file string, tile_row int, tile_col int, tile_height int, tile_width int, height int, width int, west double, north double, step_x double, "
         "step_y double, nodata double, offset bigint, bytes bigint, dtype string, compression int, predictor int, reason string")
TILE = "file string, tile_row int, tile_col int, values array<double>, reason string"


def directory(fh) -> tuple[str, dict[int, tuple]]:
    """Byte order and entries (number to values) of the first image of an open file."""
    head = fh.read(16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    magic = struct.unpack(order + "H", head[2:4])[0] if order and len(head) >= 8 else None
    if magic not in (42, 43):
        raise ValueError("not a raster file")
    at, count, entry, word = ((struct.unpack(order + "I", head[4:8])[0], "H", "HHI", 4) if magic == 42
                              else (struct.unpack(order + "Q", head[8:16])[0], "Q", "HHQ", 8))

    def take(fmt: str) -> tuple:
        return struct.unpack(order + fmt, fh.read(struct.calcsize(order + fmt)))
    fh.seek(at)
    heads = [(take(entry), fh.read(word)) for _ in range(take(count)[0])]
    out = {}
    for (number, kind, n), raw in heads:
        if kind not in TYPES:
            continue
        fmt = order + (f"{n}s" if kind == 2 else TYPES[kind] * n)
        size = struct.calcsize(fmt)
        if size > word:
            fh.seek(struct.unpack(order + ("I" if word == 4 else "Q"), raw)[0])
            raw = fh.read(size)
        out[number] = struct.unpack(fmt, raw[:size])
    return order, out


def _blocks(path: str) -> list[tuple]:
    """One row per tile or strip of a file."""
    with open(path, "rb") as fh:
        order, d = directory(fh)
    one = lambda k, default: d.get(k, (default,))[0]
    width, height, bits, form = one(WIDTH, 0), one(HEIGHT, 0), one(BITS, 1), one(FORMAT, 1)
    if one(BANDS, 1) != 1:
        raise ValueError("more than one band")
    if one(COMPRESSION, PLAIN) not in (PLAIN, DEFLATE, OLD_DEFLATE):
        raise ValueError(f"compression {one(COMPRESSION, PLAIN)} is not read")
    if bits % 8 or form not in (1, 2, 3) or one(PREDICTOR, 1) not in (1, 2) or one(PREDICTOR, 1) == 2 and form == 3:
        raise ValueError(f"values of {bits} bits, format {form}, predictor {one(PREDICTOR, 1)} are not read")
    dtype = np.dtype(f"{order}{'uif'[form - 1]}{bits // 8}").str
    tiled = TILES in d
    tw, th = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(one(STRIP_ROWS, height), height))
    scale, tie = d[PIXEL_SCALE], d[TIE_POINT]
    west, north = tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]
    nodata = float(d[NODATA][0].split(b"\0")[0]) if NODATA in d else None
    across, at, size = -(-width // tw), d[TILES if tiled else STRIPS], d[TILE_BYTES if tiled else STRIP_BYTES]
    return [(path, k // across, k % across, th, tw, height, width, west, north, scale[0], scale[1], nodata, a, n, dtype, one(COMPRESSION, PLAIN), one(PREDICTOR, 1), None)
            for k, (a, n) in enumerate(zip(at, size))]


def _listed(files: DataFrame) -> DataFrame:
    names = [c.split()[0] for c in BLOCK.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["file"]:
                try:
                    rows = _blocks(path)
                except Exception as e:  # a bad file becomes a row, never a failed job
                    rows = [(path, *[None] * (len(names) - 2), f"{type(e).__name__}: {e}")]
                out = pd.DataFrame(rows, columns=names, dtype=object)
                yield out
    return files.select("file").mapInPandas(work, BLOCK)


def raster_blocks(files: DataFrame) -> DataFrame:
    """Where the tiles or strips of each raster (column ``file``) lie, with the raster's corner, steps and no-data value."""
    return _listed(files).where("reason IS NULL").drop("reason")


def _decoded(raw: bytes, b) -> np.ndarray:
    """Values of one block as float64, rows by columns; the last strip may hold fewer rows than the others."""
    if b.compression != PLAIN:
        raw = zlib.decompress(raw)
    a = np.frombuffer(raw, np.dtype(b.dtype))
    a = a[:len(a) // b.tile_width * b.tile_width].reshape(-1, b.tile_width)[:b.tile_height]
    if b.predictor == 2:
        a = np.cumsum(a, axis=1, dtype=a.dtype)
    inside = min(b.tile_height, b.height - b.tile_row * b.tile_height)
    if len(a) < inside:
        raise ValueError("block is too short")
    out = np.full((b.tile_height, b.tile_width), np.nan)
    out[:len(a)] = a
    out[inside:] = np.nan
    out[:, max(0, b.width - b.tile_col * b.tile_width):] = np.nan
    return out


def _read(blocks: DataFrame) -> DataFrame:
    n = max(blocks.sparkSession.sparkContext.defaultParallelism, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b in pdf.itertuples(index=False):
                values, reason = None, None
                try:
                    with open(b.file, "rb") as fh:
                        fh.seek(int(b.offset))
                        a = _decoded(fh.read(int(b.bytes)), b)
                    values = [None if np.isnan(v) else v for v in a.ravel().tolist()]
                except Exception as e:
                    reason = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"file": [b.file], "tile_row": [b.tile_row], "tile_col": [b.tile_col], "values": [values], "reason": [reason]})
    return blocks.repartition(n, "file", "offset").mapInPandas(work, TILE)


def raster_tiles(blocks: DataFrame) -> DataFrame:
    """(file, tile_row, tile_col, values): values row by row; places beyond the raster's edge are null."""
    return _read(blocks).where("reason IS NULL").drop("reason")


def raster_problems(files: DataFrame) -> DataFrame:
    """Rasters that cannot be listed and blocks that cannot be read: source, path, reason."""
    bad = _listed(files).where("reason IS NOT NULL").select("file", "reason")
    return (bad.unionByName(_read(raster_blocks(files)).where("reason IS NOT NULL").select("file", "reason"))
            .select(F.lit("raster").alias("source"), F.col("file").alias("path"), "reason"))


def pack_tiles(cells: DataFrame, size: int = 64) -> DataFrame:
    """Cells (row, col, value) as tiles (tile_row, tile_col, values) of ``size`` by ``size``; cells that are not there are null,
    of cells that repeat the largest value counts. A tile gathers at most ``size`` squared cells."""
    @F.pandas_udf("array<double>")
    def dense(places: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for p, v in zip(places, values):
            row = np.full(size * size, None, dtype=object)
            row[np.asarray(p, int)] = np.asarray(v, dtype=object)
            out.append(row)
        return pd.Series(out)

    here = lambda c: F.floor(F.col(c) / size).cast("int")
    within = lambda c: F.pmod(F.col(c), F.lit(size)).cast("int")
    keyed = (cells.where("row IS NOT NULL AND col IS NOT NULL AND value IS NOT NULL")
             .groupBy(here("row").alias("tile_row"), here("col").alias("tile_col"), (within("row") * size + within("col")).alias("p"))
             .agg(F.max(F.col("value").cast("double")).alias("v")))
    per = keyed.groupBy("tile_row", "tile_col").agg(F.collect_list(F.struct("p", "v")).alias("c"))
    return per.select("tile_row", "tile_col", dense(F.col("c.p"), F.col("c.v")).alias("values"))


def sample_tiles(points: DataFrame, tiles: DataFrame, row: Column, col: Column, tile_height: int, tile_width: int, into: str) -> DataFrame:
    """Add the value at (row, col) of the raster as ``into``; null where there is none. Only the tiles' keys are joined against."""
    at = (points.withColumn("__row", row.cast("long")).withColumn("__col", col.cast("long"))
          .withColumn("__tr", F.floor(F.col("__row") / tile_height).cast("int")).withColumn("__tc", F.floor(F.col("__col") / tile_width).cast("int")))
    packed = tiles.select(F.col("tile_row").alias("__tr"), F.col("tile_col").alias("__tc"), F.col("values").alias("__values"))
    place = F.pmod(F.col("__row"), F.lit(tile_height)) * tile_width + F.pmod(F.col("__col"), F.lit(tile_width))
    met = at.join(packed, ["__tr", "__tc"], "left")
    return met.withColumn(into, F.get("__values", place.cast("int"))).drop("__tr", "__tc", "__row", "__col", "__values")
