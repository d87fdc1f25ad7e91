"""Sources and sinks: round trips and small files written by hand."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from selenite.sources import rasters, settings


def test_rasters_round_trip(spark, tmp_path):
    rows = [(x, y, None if (x, y) == (3, 2) else float(x * 100 + y) / 7) for x in range(13) for y in range(9)]
    df = spark.createDataFrame(rows, "x int, y int, v double")
    place = (3.5, 27.5, 0.25, -0.5)
    rasters.write_rasters(df, f"file://{tmp_path}/out", 8, place, -9999.0)
    assert sorted(x.name for x in (tmp_path / "out").iterdir()) == ["0_0.tif", "0_1.tif", "1_0.tif", "1_1.tif"]
    heads = {r.path.rsplit("/", 1)[1]: r for r in rasters.raster_headers(spark, f"{tmp_path}/out").collect()}
    assert set(heads) == {"0_0.tif", "1_0.tif", "0_1.tif", "1_1.tif"}
    r = heads["1_1.tif"]
    assert (r.width, r.height, r.bands, r.nodata, r.x0, r.y0, r.dx, r.dy) == (5, 1, 1, -9999.0, 5.5, 23.5, 0.25, -0.5)
    tile = F.split(F.element_at(F.split("path", "/"), -1), "[_.]")
    back = rasters.read_rasters(spark, f"{tmp_path}/out").select((F.col("x") + 8 * tile[0].cast("int")).alias("x"), (F.col("y") + 8 * tile[1].cast("int")).alias("y"), "v")
    got = {(r.x, r.y): r.v for r in back.collect()}
    assert len(got) == 13 * 9 and all(got[x, y] == np.float32(-9999.0 if v is None else v) for x, y, v in rows)


def tiff(order, width, height, bits, fmt, blocks, extra):
    """A file with one block a strip or tile, big or little endian."""
    data, offsets = b"", []
    for b in blocks:
        offsets.append(8 + len(data))
        data += b
    tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [bits]), (259, 3, [extra.get("compression", 1)]), (277, 3, [extra.get("bands", 1)]), (339, 3, [fmt])]
    if "tile" in extra:
        tags += [(322, 4, [extra["tile"]]), (323, 4, [extra["tile"]]), (324, 4, offsets), (325, 4, [len(b) for b in blocks])]
    else:
        tags += [(273, 4, offsets), (278, 4, [extra["strip"]]), (279, 4, [len(b) for b in blocks])]
    tags.sort()
    start = 8 + len(data)
    behind, table, tail = start + 2 + 12 * len(tags) + 4, b"", b""
    for tag, kind, values in tags:
        raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
        table += struct.pack(order + "HHI", tag, kind, len(values))
        if len(raw) > 4:
            table += struct.pack(order + "I", behind + len(tail))
            tail += raw
        else:
            table += raw.ljust(4, b"\0")
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, start) + data + struct.pack(order + "H", len(tags)) + table + b"\0" * 4 + tail


def test_tiff_strips_tiles_orders_and_bands(spark, tmp_path):
    a = np.arange(35).reshape(5, 7)
    (tmp_path / "strips.tif").write_bytes(tiff(">", 7, 5, 16, 1, [a[i : i + 2].astype(">u2").tobytes() for i in (0, 2, 4)], {"strip": 2}))
    padded = np.zeros((6, 9), "<f4")
    padded[:5, :7] = a
    tiles = [zlib.compress(padded[y : y + 3, x : x + 3].tobytes()) for y in (0, 3) for x in (0, 3, 6)]
    (tmp_path / "tiles.tif").write_bytes(tiff("<", 7, 5, 32, 3, tiles, {"tile": 3, "compression": 8}))
    rgb = np.stack([a, a + 50, a + 100], 2).astype("u1")
    (tmp_path / "bands.tif").write_bytes(tiff("<", 7, 5, 8, 1, [rgb.tobytes()], {"strip": 5, "bands": 3}))
    got = {}
    for r in rasters.read_rasters(spark, str(tmp_path)).collect():
        got[r.path.rsplit("/", 1)[1], r.band, r.x, r.y] = r.v
    assert len(got) == 35 * 5
    for (name, band, x, y), v in got.items():
        assert v == a[y, x] + 50 * band, (name, band, x, y)
    (tmp_path / "bands.tif").write_bytes(b"no raster")
    with pytest.raises(Exception, match="not a TIFF"):
        rasters.read_rasters(spark, str(tmp_path)).count()


def test_planetary_images(spark, tmp_path):
    a = np.arange(24).reshape(4, 6)
    label = "PDS_VERSION_ID = PDS3\r\nRECORD_BYTES = 400\r\n^IMAGE = 2\r\nOBJECT = IMAGE\r\n LINES = 4\r\n LINE_SAMPLES = 6\r\n SAMPLE_BITS = {}\r\n SAMPLE_TYPE = {}\r\n BANDS = {}\r\nEND\r\n"
    for name, bits, kind, bands, code in (("a.img", 16, "MSB_UNSIGNED_INTEGER", 3, ">u2"), ("b.img", 8, "UNSIGNED_INTEGER", 1, "u1"), ("c.img", 32, "PC_REAL", 2, "<f4")):
        data = b"".join((a + 10 * k).astype(code).tobytes() for k in range(bands))
        (tmp_path / name).write_bytes(label.format(bits, kind, bands).encode().ljust(400) + data)
    for name, bands in (("a.img", 3), ("b.img", 1), ("c.img", 2)):
        got = {(r.band, r.x, r.y): r.v for r in rasters.read_pds(spark, str(tmp_path / name)).collect()}
        assert got == {(k, x, y): a[y, x] + 10 * k for k in range(bands) for x in range(6) for y in range(4)}
    tile = {(r.band, r.x, r.y): r.v for r in rasters.read_pds(spark, str(tmp_path / "a.img"), (2, 1, 3, 2)).collect()}
    assert tile == {(k, x, y): a[y, x] + 10 * k for k in range(3) for x in (2, 3, 4) for y in (1, 2)}
    for bad, name in (((4, 0, 3, 1), "a.img"), ((0, 0, 1, 1), "c.img")):
        with pytest.raises(Exception, match="tile|bands"):
            rasters.read_pds(spark, str(tmp_path / name), bad).count()
    small = {(r.band, r.x, r.y): r.v for r in rasters.eight_bits(rasters.read_pds(spark, str(tmp_path / "a.img")), 16).collect()}
    assert small == {(2 - k, x, y): min(255, int((a[y, x] + 10 * k) * (256 / 43))) for k in range(3) for x in range(6) for y in range(4)}


def test_settings(tmp_path):
    defaults = {"MAX_ITER": 10, "THRESHOLD": 0.01, "WINDOW": [5, 5], "ROTATE": True, "NAME": "x"}
    assert settings.keyed_settings(str(tmp_path / "none"), defaults) == defaults == settings.positional_settings(str(tmp_path / "none"), defaults)
    (tmp_path / "k").write_text("# all\nMAX_ITER 3\nTHRESHOLD = 0.5 # half\nWINDOW: 7 9\nROTATE 0\nOTHER 1\nNAME\n")
    keyed = settings.keyed_settings(str(tmp_path / "k"), defaults)
    assert keyed == {"MAX_ITER": 3, "THRESHOLD": 0.5, "WINDOW": [7, 9], "ROTATE": False, "NAME": "x"}
    (tmp_path / "p").write_text("4\nTHRESHOLD 0.25\n\n3 3\n")
    assert settings.positional_settings(str(tmp_path / "p"), defaults) == defaults | {"MAX_ITER": 4, "THRESHOLD": 0.25, "WINDOW": [3, 3]}
    (tmp_path / "w").write_text("\n".join(settings.settings_lines(keyed)))
    assert settings.keyed_settings(str(tmp_path / "w"), defaults) == keyed


def test_settings_that_want_no_matching():
    wanted = lambda n, *w: settings.matching_wanted({"MAX_ITER": n, "WINDOW": list(w)})
    assert [wanted(0, 1, 1), wanted(1, 1, 1), wanted(0, 1, 2), wanted(0, 5, 5)] == [False, True, True, True]


def test_settings_in_shared_storage(spark, tmp_path):
    defaults = {"MAX_ITER": 10, "WINDOW": [5, 5]}
    (tmp_path / "k").write_text("MAX_ITER 3\nWINDOW 7 9 # wide\n")
    assert settings.keyed_settings(f"file://{tmp_path}/k", defaults) == {"MAX_ITER": 3, "WINDOW": [7, 9]}
    assert settings.keyed_settings(f"file://{tmp_path}/none", defaults) == defaults
    (tmp_path / "l").write_text("a.tif\nb.tif\n")
    assert settings.try_list(f"file://{tmp_path}/l") == (1, ["a.tif", "b.tif"]) and settings.try_list(f"file://{tmp_path}/x") == (0, [])
    (tmp_path / "c").write_text("K 1 2 3 4")
    assert settings.calibration(f"file://{tmp_path}/c", {"K": (2, 2)})["K"].tolist() == [[1, 2], [3, 4]]


def test_calibration_and_lists(tmp_path):
    (tmp_path / "c").write_text("K = [700 0 320;\n 0 700 240;\n 0 0 1]\nD: 0.1 0.2\nsize 640 480\n")
    got = settings.calibration(str(tmp_path / "c"), {"K": (3, 3), "D": (2,), "size": (2,)})
    assert got["K"].tolist() == [[700, 0, 320], [0, 700, 240], [0, 0, 1]] and got["size"].tolist() == [640, 480]
    with pytest.raises(ValueError, match="T is missing"):
        settings.calibration(str(tmp_path / "c"), {"T": (3,)})
    (tmp_path / "l").write_text("a.tif\n\n# no\nb.tif\n")
    assert settings.try_list(str(tmp_path / "l")) == (1, ["a.tif", "b.tif"]) and settings.try_list(str(tmp_path / "x")) == (0, [])
    assert settings.camera_model_lines({"C": (1, 2, 3), "x": ()}) == ["C = (1.000000, 2.000000, 3.000000)"]
    assert settings.tile_box_line((2, 3, 10, 20)) == "2 3 12 23"
