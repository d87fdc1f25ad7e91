"""Images read by ranges of bytes, and files that appear all at once."""

import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from selenite.sources import formats, ranged, rasters
from tests.test_sources import tiff

LABEL = "PDS_VERSION_ID = PDS3\r\nRECORD_BYTES = 1000\r\n^IMAGE = 2\r\n LINES = {}\r\n LINE_SAMPLES = {}\r\n SAMPLE_BITS = 16\r\n SAMPLE_TYPE = MSB_UNSIGNED_INTEGER\r\n BANDS = {}\r\nEND\r\n"


def pds(path, a, bands=1):
    path.write_bytes(LABEL.format(*a.shape, bands).encode().ljust(1000) + b"".join((a + k).astype(">u2").tobytes() for k in range(bands)))


def rows_of(batches):
    out = {}
    for b in batches:
        for path, band, x, y, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
            assert (band, x, y) not in out
            out[band, x, y] = v
    return out


@pytest.fixture
def counted(monkeypatch):
    read = []
    plain = ranged.RangedFile.read

    def watched(self, start, n):
        read.append(n)
        return plain(self, start, n)

    monkeypatch.setattr(ranged.RangedFile, "read", watched)
    return read


def scan(reader):
    return rows_of(b for p in reader.partitions() for b in reader.read(p))


def test_a_window_reads_its_rows_only(tmp_path, counted):
    a = np.arange(2000 * 500).reshape(2000, 500) % 60_000
    pds(tmp_path / "a.img", a, 3)
    window = {"x": "40", "y": "1500", "width": "7", "height": "20"}
    reader = ranged.ImageReader({"path": str(tmp_path / "a.img"), "partition_bytes": "20000", **window}, ranged.pds_plan)
    got = scan(reader)
    assert got == {(k, x, y): a[y, x] + k for k in range(3) for x in range(40, 47) for y in range(1500, 1520)}
    rows = 3 * 20 * 500 * 2
    assert sum(counted) <= rows + ranged.PAGE and len(reader.partitions()) == 3


def test_filters_reach_the_bytes(tmp_path, counted):
    a = np.arange(3000 * 100).reshape(3000, 100) % 60_000
    pds(tmp_path / "a.img", a, 3)
    pds(tmp_path / "b.img", a)
    reader = ranged.FilteredReader({"path": str(tmp_path), "partition_bytes": "5000"}, ranged.pds_plan)
    filters = [ranged.GreaterThan(("y",), 99), ranged.LessThanOrEqual(("y",), 102), ranged.In(("band",), (1, 2)), ranged.LessThan(("v",), 9.0)]
    filters.append(ranged.EqualTo(("path",), f"file://{tmp_path}/a.img"))
    assert list(reader.pushFilters(filters)) == filters
    assert scan(reader) == {(k, x, y): a[y, x] + k for k in (1, 2) for x in range(100) for y in (100, 101, 102)}
    assert sum(counted) == 2 * 3 * 200 + ranged.PAGE


def test_strips_are_cut_and_tiles_left_out(tmp_path, counted):
    a = np.arange(400 * 300).reshape(400, 300)
    (tmp_path / "one.tif").write_bytes(tiff("<", 300, 400, 32, 3, [a.astype("<f4").tobytes()], {"strip": 400}))
    reader = ranged.ImageReader({"path": str(tmp_path / "one.tif"), "partition_bytes": "12000", "x": "5", "y": "30", "width": "2", "height": "50"}, ranged.tiff_plan)
    assert scan(reader) == {(0, x, y): a[y, x] for x in (5, 6) for y in range(30, 80)}
    assert sum(counted) <= 50 * 300 * 4 + 2 * ranged.PAGE and len(reader.partitions()) >= 5
    counted.clear()
    tiles = [zlib.compress(a[y : y + 100, x : x + 100].astype("<f4").tobytes()) for y in range(0, 400, 100) for x in range(0, 300, 100)]
    (tmp_path / "two.tif").write_bytes(tiff("<", 300, 400, 32, 3, tiles, {"tile": 100, "compression": 8}))
    reader = ranged.ImageReader({"path": str(tmp_path / "two.tif"), "x": "150", "y": "120", "width": "60", "height": "10"}, ranged.tiff_plan)
    assert scan(reader) == {(0, x, y): a[y, x] for x in range(150, 210) for y in range(120, 130)}
    assert sum(counted) <= len(tiles[4]) + len(tiles[5]) + 2 * ranged.PAGE


def large_tiff(path, width, height, rows):
    """A large-offset TIFF of one strip of bytes, over 2 GB, with holes but for ``rows``."""
    entries = [(256, 4, width), (257, 4, height), (258, 3, 8), (259, 3, 1), (273, 16, 512), (277, 3, 1), (278, 4, height), (279, 16, width * height), (339, 3, 1)]
    table = b"".join(struct.pack("<HHQQ", t, k, 1, v) for t, k, v in entries)
    with path.open("wb") as f:
        f.write(b"II" + struct.pack("<HHHQ", 43, 8, 0, 16) + struct.pack("<Q", len(entries)) + table + b"\0" * 8)
        for y, row in rows.items():
            f.seek(512 + y * width)
            f.write(row)
        f.truncate(512 + width * height)


def test_rasters_beyond_two_gigabytes(spark, tmp_path):
    width, height = 50_000, 60_000
    row = bytes(range(250)) * 200
    large_tiff(tmp_path / "big.tif", width, height, {59_990: row})
    assert (tmp_path / "big.tif").stat().st_size > 2**31
    got = rasters.read_rasters(spark, str(tmp_path / "big.tif"), x=1000, y=59_989, width=3, height=3).collect()
    assert {(r.x, r.y): r.v for r in got} == {(x, y): float(row[x]) if y == 59_990 else 0.0 for x in (1000, 1001, 1002) for y in (59_989, 59_990, 59_991)}
    (head,) = rasters.raster_headers(spark, str(tmp_path / "big.tif")).collect()
    assert (head.width, head.height, head.bands) == (width, height, 1)


def test_session_filters_and_broken_files(spark, tmp_path):
    a = np.arange(60 * 30).reshape(60, 30)
    pds(tmp_path / "a.img", a)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = rasters.read_pds(spark, str(tmp_path / "*.img"), partition_bytes=200).where("y = 7 and x < 3 and band = 0").collect()
        assert {(r.x, r.y): r.v for r in got} == {(x, 7): a[7, x] for x in range(3)}
        assert rasters.read_pds(spark, str(tmp_path)).where("y > 70").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    raw = (tmp_path / "a.img").read_bytes()
    (tmp_path / "a.img").write_bytes(raw[:-100])
    with pytest.raises(Exception, match="a.img: the file is cut short"):
        rasters.read_pds(spark, str(tmp_path)).count()
    (tmp_path / "a.img").write_bytes(b"nothing")
    with pytest.raises(Exception, match="a.img: not a planetary image"):
        rasters.read_pds(spark, str(tmp_path)).count()
    with pytest.raises(Exception, match="no such file"):
        rasters.read_pds(spark, str(tmp_path / "none*")).count()


def test_long_labels():
    long = ("NOTE = x\r\n" * 30_000 + LABEL.format(2, 3, 1)).encode()
    assert formats.pds_layout(long) == (">u2", 1000, 3, 2, 1)


def test_files_appear_all_or_none(spark, tmp_path):
    out = tmp_path / "out"
    files = spark.createDataFrame([(f"d{i % 3}/{i}", bytes([i])) for i in range(9)], "name string, content binary").repartition(3)
    ranged.save_files(files, f"file://{out}")
    names = lambda: sorted(str(p.relative_to(out)) for p in out.rglob("*") if p.is_file())
    assert names() == sorted(f"d{i % 3}/{i}" for i in range(9)) and not (out / "_temporary").exists()
    broken = files.withColumn("content", F.when(F.col("name") == "d2/5", F.raise_error(F.lit("lost"))).otherwise(F.col("content"))).withColumn("name", F.concat(F.lit("new/"), "name"))
    for bad in (broken, files.withColumn("name", F.lit("same")), files.withColumn("name", F.lit("../x"))):
        with pytest.raises(Exception):
            ranged.save_files(bad, f"file://{out}", overwrite=True)
        assert names() == sorted(f"d{i % 3}/{i}" for i in range(9)) and not (out / "_temporary").exists()
    ranged.save_files(files.where("name = 'd0/3'").withColumn("name", F.lit("three")), str(out), overwrite=True)
    assert names() == ["three"] and (out / "three").read_bytes() == b"\x03"
    ranged.save_files(files.where("false"), str(out))
    assert names() == ["three"]


def test_an_attempt_that_fails_leaves_nothing(tmp_path, monkeypatch):
    class Context:
        def __init__(self, attempt):
            self.taskAttemptId, self.partitionId = (lambda: attempt), (lambda: 0)

    writer = ranged.FileWriter({"path": str(tmp_path / "out")}, False)
    batch = pa.record_batch({"name": ["a", "b"], "content": [b"1", b"2"]})

    def lost():
        yield batch
        raise RuntimeError

    monkeypatch.setattr(ranged.TaskContext, "get", lambda: Context(1))
    with pytest.raises(RuntimeError):
        writer.write(lost())
    monkeypatch.setattr(ranged.TaskContext, "get", lambda: Context(2))
    writer.commit([writer.write(iter([batch])), None])
    assert sorted(p.name for p in (tmp_path / "out").rglob("*")) == ["a", "b"]


def test_quad_tiles_round_trip(spark, tmp_path):
    rows = [(k, x, y, float(x * 100 + y) / 3 + k) for k in range(3) for x in range(4 * 2**k) for y in range(4 * 2**k) if (x, y) != (1, 2)]
    df = spark.createDataFrame(rows, "level int, x int, y int, v double")
    rasters.write_quad_tiles(df, f"file://{tmp_path}/dem", 4, -1.0)
    raw = np.frombuffer((tmp_path / "dem/2/3/2/0").read_bytes(), ">f4").reshape(4, 4)  # tile x 1 = 0b01, y 2 = 0b10
    assert raw[1, 2] == np.float32((6 * 100 + 9) / 3 + 2)
    got = {(r.level, r.x, r.y): r.v for r in rasters.read_quad_tiles(spark, f"{tmp_path}/dem", 4).collect()}
    want = {(k, x, y): np.float32(v) for k, x, y, v in rows} | {(k, 1, 2): -1.0 for k in range(3)}
    assert got == want
    rasters.write_quad_tiles(df, f"file://{tmp_path}/drg", 4, 0.0, elevation=False)
    got = {(r.level, r.x, r.y): r.v for r in rasters.read_quad_tiles(spark, f"{tmp_path}/drg", 4, elevation=False).collect()}
    assert got == {(k, x, y): float(min(255, int(v))) for k, x, y, v in rows} | {(k, 1, 2): 0.0 for k in range(3)}


def test_mosaic_tiles(spark, tmp_path):
    rows = [(0, 0, 7.9, 1.5, 2.0, 3.25), (1, 0, 300.0, 1e7, 0.0, -1.0), (5, 6, 20.0, None, None, None)]
    rasters.write_mosaic_tiles(spark.createDataFrame(rows, "x int, y int, v double, px double, py double, pz double"), f"file://{tmp_path}/m", 4)
    assert sorted(p.name for p in (tmp_path / "m").iterdir()) == ["tile_0_0.tif", "tile_0_0_point_cloud.txt", "tile_1_1.tif"]
    assert (tmp_path / "m/tile_0_0_point_cloud.txt").read_text() == "1.500000 2.000000 3.250000 7 7 7\n10000000.000000 0.000000 -1.000000 255 255 255\n"
    got = {(r.x, r.y): r.v for r in rasters.read_rasters(spark, f"{tmp_path}/m/tile_0_0.tif").collect()}
    assert got == {(x, y): {(0, 0): 7.0, (1, 0): 255.0}.get((x, y), 0.0) for x in range(4) for y in range(4)}


@pytest.mark.parametrize("kind, base, multiplier", [("Real", 0.0, 1.0), ("SignedWord", 10.0, 0.5), ("UnsignedByte", 0.0, 2.0)])
def test_cubes_round_trip(spark, tmp_path, counted, kind, base, multiplier):
    a = np.arange(2 * 50 * 70).reshape(2, 50, 70) % 120 * multiplier + base + multiplier
    a[0, 3, 4] = a[1, 49, 69] = np.nan
    (tmp_path / "a.cub").write_bytes(formats.encode_cube(a, (32, 16), kind, base, multiplier))
    want = {(k, x, y): None if np.isnan(a[k, y, x]) else a[k, y, x] for k in range(2) for x in range(70) for y in range(50)}
    assert {(r.band, r.x, r.y): r.v for r in rasters.read_cubes(spark, str(tmp_path / "a.cub"), partition_bytes=2000).collect()} == want
    counted.clear()
    reader = ranged.FilteredReader({"path": str(tmp_path / "a.cub"), "x": "60", "y": "40", "width": "10", "height": "10"}, ranged.cube_plan)
    list(reader.pushFilters([ranged.EqualTo(("band",), 1)]))
    assert scan(reader) == {k: v for k, v in want.items() if k[0] == 1 and k[1] >= 60 and k[2] >= 40}
    size = np.dtype(formats.CUBE_TYPES[kind][0]).itemsize
    assert sum(counted) <= 3 * 32 * 16 * size + ranged.PAGE


def test_cubes_by_rows_and_special_pixels(spark, tmp_path):
    label = formats.encode_cube(np.zeros((1, 1, 1)), (1, 1))[:4096].decode().rstrip("\0")
    label = label.replace("Format = Tile", "Format = BandSequential").replace("Samples = 1\n      Lines = 1", "Samples = 5\n      Lines = 2").replace("Type = Real", "Type = SignedWord").replace("Lsb", "Msb")
    data = np.array([[-32768, -32767, -32764, -32752, 7], [0, 1, 2, 32767, -32753]], ">i2")
    (tmp_path / "b.cub").write_bytes(label.encode().ljust(4096, b"\0") + data.tobytes())
    got = {(r.x, r.y): r.v for r in rasters.read_cubes(spark, str(tmp_path / "b.cub")).collect()}
    assert got == {(x, y): float(data[y, x]) if data[y, x] >= -32752 else None for x in range(5) for y in range(2)}
    with pytest.raises(Exception, match="not a camera cube"):
        (tmp_path / "b.cub").write_bytes(b"nothing")
        rasters.read_cubes(spark, str(tmp_path / "b.cub")).count()
