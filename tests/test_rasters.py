"""Raster files as packed tiles: every layout reads like the array it was written from."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldecho.plans.deployments import add_elevation, add_elevation_of
from fieldecho.sources import rasters


def write_raster(path, a, tile=None, strip=None, order="<", big=False, deflate=False, predictor=1, nodata=None, west=-94.0, north=34.0, step=0.025, overview=False):
    """A raster file of array ``a`` in tiles (height, width) or strips of so many rows."""
    h, w = a.shape
    th, tw = tile or (strip, w)
    blocks = []
    for r in range(0, h, th):
        for c in range(0, w, tw):
            part = a[r:r + th, c:c + tw]
            if tile:
                part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1])))
            if predictor == 2:
                part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1).astype(a.dtype)
            raw = part.astype(a.dtype.newbyteorder(order)).tobytes()
            blocks.append(zlib.compress(raw) if deflate else raw)
    form = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    word = "Q" if big else "I"
    at, offsets = (16 if big else 8), []
    for b in blocks:
        offsets.append(at)
        at += len(b)
    entries = [(256, 4, (w,)), (257, 4, (h,)), (258, 3, (a.dtype.itemsize * 8,)), (259, 3, (8 if deflate else 1,)), (277, 3, (1,)), (317, 3, (predictor,)), (339, 3, (form,)),
               (33550, 12, (step, step, 0.0)), (33922, 12, (0.0, 0.0, 0.0, west, north, 0.0))]
    sizes = tuple(len(b) for b in blocks)
    entries += [(322, 3, (tw,)), (323, 3, (th,)), (324, 4, tuple(offsets)), (325, 4, sizes)] if tile else [(278, 3, (th,)), (273, 4, tuple(offsets)), (279, 4, sizes)]
    if nodata is not None:
        entries.append((42113, 2, (f"{nodata}".encode() + b"\0",)))
    entries.sort()
    extra_at = at + (8 + 20 * len(entries) + 8 if big else 2 + 12 * len(entries) + 4)
    rows, extra = b"", b""
    for number, kind, values in entries:
        raw = values[0] if kind == 2 else struct.pack(order + {3: "H", 4: "I", 12: "d"}[kind] * len(values), *values)
        n = len(raw) if kind == 2 else len(values)
        if len(raw) > struct.calcsize(word):
            field, extra = struct.pack(order + word, extra_at + len(extra)), extra + raw
        else:
            field = raw.ljust(struct.calcsize(word), b"\0")
        rows += struct.pack(order + "HH" + word, number, kind, n) + field
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at))
    count = struct.pack(order + ("Q" if big else "H"), len(entries))
    with open(path, "wb") as fh:
        fh.write(head + b"".join(blocks) + count + rows + struct.pack(order + word, 0) + extra)


def _array(dtype, h=37, w=53):
    rng = np.random.default_rng(7)
    return rng.integers(0, 200, (h, w)).astype(dtype)


@pytest.mark.parametrize("dtype, how", [
    ("float32", {"tile": (16, 16)}), ("float64", {"strip": 8, "order": ">"}), ("int16", {"tile": (16, 32), "deflate": True, "predictor": 2}),
    ("uint8", {"strip": 37, "deflate": True}), ("int32", {"tile": (64, 64), "big": True}), ("uint16", {"strip": 5, "order": ">", "predictor": 2, "deflate": True})])
def test_every_layout_reads_like_its_array(spark, tmp_path, dtype, how):
    a = _array(dtype)
    path = str(tmp_path / "dem.tif")
    write_raster(path, a, nodata=50, **how)
    blocks = rasters.raster_blocks(spark.createDataFrame([(path,)], "file string"))
    first = blocks.first()
    assert (first.west, first.north, first.step_x, first.nodata, first.height, first.width) == (-94.0, 34.0, 0.025, 50.0, 37, 53)
    got = np.full((37, 53), np.nan)
    for t in rasters.raster_tiles(blocks).collect():
        block = np.array([np.nan if v is None else v for v in t["values"]]).reshape(first.tile_height, first.tile_width)
        r, c = t["tile_row"] * first.tile_height, t["tile_col"] * first.tile_width
        part = got[r:r + first.tile_height, c:c + first.tile_width]
        part[:] = block[:part.shape[0], :part.shape[1]]
        assert np.isnan(block[part.shape[0]:]).all() and np.isnan(block[:, part.shape[1]:]).all()
    np.testing.assert_array_equal(got, a.astype(float))


def _recorders(spark):
    k = F.col("id")
    return spark.range(400).select("id", (34.1 - (k % 45) * 0.025 + 0.01).alias("latitude"), (-94.1 + (k % 61) * 0.025 + 0.01).alias("longitude"),
                                   F.when(k % 3 != 0, (k % 3).cast("string")).alias("height_above_ground"))


def test_file_and_cells_give_what_the_array_holds(spark, tmp_path):
    a = _array("int16")
    path = str(tmp_path / "dem.tif")
    write_raster(path, a, tile=(16, 16), nodata=50)
    dep = _recorders(spark)
    cells = spark.createDataFrame([(r, c, float(a[r, c])) for r in range(37) for c in range(53)], "row long, col long, value double")
    want = {}
    for p in dep.collect():
        r, c = int(np.floor((34.0 - p.latitude) / 0.025)), int(np.floor((p.longitude + 94.0) / 0.025))
        v = float(a[r, c]) if 0 <= r < 37 and 0 <= c < 53 and abs(a[r, c] - 50) >= 1 else None
        want[p.id] = (v, None if v is None else v + float(p.height_above_ground or 0))
    assert any(v[0] is None for v in want.values()) and any(v[0] is not None for v in want.values())
    by_file = add_elevation_of(dep, path)
    assert {r.id: (r.elevation_m, r.z) for r in by_file.collect()} == want
    by_cells = add_elevation(dep.withColumn("elevation_m", F.lit(1.0)), cells, -94.0, 34.0, 0.025, nodata=50.0, size=16)
    assert {r.id: (r.elevation_m, r.z) for r in by_cells.collect()} == want
    none = add_elevation(dep.limit(3), cells.limit(0), -94.0, 34.0, 0.025)
    assert [r.z for r in none.collect()] == [None] * 3


def test_tiles_hold_a_cell_for_each_place(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (3, 5, 7.0), (-1, 0, 9.0), (None, 1, 4.0), (1, 1, None)], "row long, col long, value double")
    tiles = {(t.tile_row, t.tile_col): t["values"] for t in rasters.pack_tiles(cells, 4).collect()}
    assert set(tiles) == {(0, 0), (0, 1), (-1, 0)}
    assert tiles[0, 0] == [2.0] + [None] * 15 and tiles[0, 1][3 * 4 + 1] == 7.0 and tiles[-1, 0][12] == 9.0


def test_problems_are_listed(spark, tmp_path):
    good, bad, cut, odd = (str(tmp_path / f"{n}.tif") for n in ("good", "bad", "cut", "odd"))
    a = _array("float32")
    write_raster(good, a, strip=8)
    open(bad, "wb").write(b"not a raster at all")
    write_raster(cut, a, tile=(16, 16), deflate=True)
    raw = bytearray(open(cut, "rb").read())
    raw[8:40] = bytes(32)  # the first tile can no longer be inflated
    open(cut, "wb").write(raw)
    files = spark.createDataFrame([(p,) for p in (good, bad, cut, odd)], "file string")
    found = {(r.path, r.reason.split(":")[0]) for r in rasters.raster_problems(files).collect()}
    assert found == {(bad, "ValueError"), (odd, "FileNotFoundError"), (cut, "error")}
    assert rasters.raster_tiles(rasters.raster_blocks(files)).where(F.col("file") == cut).count() == 11
    with pytest.raises(ValueError):
        add_elevation_of(_recorders(spark), bad)
