"""The bytes of georeferenced rasters (TIFF) and planetary images (PDS).

Headers are taken from bytes or from anything that gives the bytes of a slice, so that a
large file need not be read for them.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np

#: TIFF's field types (format, bytes) and the tags that are read.
FIELDS = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
TAGS = {
    256: "width", 257: "height", 258: "bits", 259: "compression", 273: "offsets", 277: "bands", 278: "strip", 279: "sizes", 284: "planar", 317: "predictor",
    322: "tile_w", 323: "tile_h", 324: "offsets", 325: "sizes", 339: "format", 33550: "scale", 33922: "tie", 42113: "nodata",
}
DEFLATE = (8, 32946)
HEADER = "path string, width int, height int, bands int, nodata double, x0 double, y0 double, dx double, dy double"
PIXELS = "path string, band int, x int, y int, v double"


def tiff_tags(raw) -> dict:
    """The first image's tags, by name; offsets of 32 or, in large files, of 64 bits."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    version = struct.unpack(order + "H", raw[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    wide = version == 43
    place, number, entry = ("Q", "Q", 20) if wide else ("I", "H", 12)
    word, first = struct.calcsize(place), struct.calcsize("=" + number)
    (at,) = struct.unpack(order + place, raw[word : 2 * word] if not wide else raw[8:16])
    (n,) = struct.unpack(order + number, raw[at : at + first])
    out = {"order": order, "compression": (1,), "bands": (1,), "planar": (1,), "format": (1,), "predictor": (1,), "bits": (1,)}
    table = raw[at + first : at + first + entry * n]
    for i in range(n):
        tag, kind, count = struct.unpack(order + "HH" + place, table[entry * i : entry * i + 4 + word])
        if tag not in TAGS or kind not in FIELDS:
            continue
        letter, size = FIELDS[kind]
        value = table[entry * i + 4 + word : entry * (i + 1)]
        if size * count > word:
            (start,) = struct.unpack(order + place, value)
            value = raw[start : start + size * count]
        out[TAGS[tag]] = struct.unpack(f"{order}{count}{letter}", value[: size * count])
    return out


def tiff_type(t: dict) -> str:
    """The samples' type; forms that are not read raise."""
    letter = {1: "u", 2: "i", 3: "f"}.get(t["format"][0])
    if t["predictor"][0] != 1 or t["compression"][0] not in (1, *DEFLATE) or letter is None or t["bits"][0] % 8:
        raise ValueError("a TIFF form that is not read")
    return f"{t['order']}{letter}{t['bits'][0] // 8}"


def tiff_header(raw) -> tuple:
    """(width, height, bands, nodata, x0, y0, dx, dy); null where the file does not say."""
    t = tiff_tags(raw)
    nodata = t["nodata"][0].rstrip(b"\0 ").decode() if "nodata" in t else ""
    place = (None,) * 4
    if "scale" in t and "tie" in t:
        dx, dy = t["scale"][0], -t["scale"][1]
        place = (t["tie"][3] - t["tie"][0] * dx, t["tie"][4] - t["tie"][1] * dy, dx, dy)
    return t["width"][0], t["height"][0], t["bands"][0], float(nodata) if nodata else None, *place


def encode_tiff(pixels: np.ndarray, x0: float, y0: float, dx: float, dy: float, nodata: float | None) -> bytes:
    """One band of 32-bit reals, a deflated strip, with its place and no-data value."""
    data = zlib.compress(np.ascontiguousarray(pixels, "<f4").tobytes(), 6)
    height, width = pixels.shape
    doubles = struct.pack("<3d", dx, -dy, 0.0), struct.pack("<6d", 0, 0, 0, x0, y0, 0)
    mark = (f"{nodata:.17g}" if nodata is not None else "").encode() + b"\0"
    entries = [
        (256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, 32), (259, 3, 1, 8), (262, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 1), (278, 4, 1, height),
        (279, 4, 1, len(data)), (284, 3, 1, 1), (339, 3, 1, 3), (33550, 12, 3, doubles[0]), (33922, 12, 6, doubles[1]), (42113, 2, len(mark), mark),
    ]
    start = 8 + len(data) + len(data) % 2
    extra, table, behind = b"", b"", start + 2 + 12 * len(entries) + 4
    for tag, kind, count, value in entries:
        if isinstance(value, bytes) and len(value) > 4:
            table += struct.pack("<HHII", tag, kind, count, behind + len(extra))
            extra += value + b"\0" * (len(value) % 2)
        elif isinstance(value, bytes):
            table += struct.pack("<HHI", tag, kind, count) + value.ljust(4, b"\0")
        else:
            table += struct.pack("<HHI", tag, kind, count) + struct.pack("<I", value)
    return b"II*\0" + struct.pack("<I", start) + data + b"\0" * (len(data) % 2) + struct.pack("<H", len(entries)) + table + b"\0" * 4 + extra


def pds_label(raw) -> dict[str, str]:
    """The label's keywords and values, up to its end; of repeated ones the first counts."""
    n, end = 65_536, None
    while end is None:
        text = raw[:n]
        end = re.search(rb"(?m)^\s*END\s*$", text)
        if len(text) < n or n > 1 << 24:
            break
        n *= 4
    text = (text[: end.end()] if end else text[:65_536]).decode("latin-1")
    out: dict[str, str] = {}
    for m in re.finditer(r"(?m)^\s*(\^?[A-Z_:0-9]+)\s*=\s*(.*?)\s*$", text):
        out.setdefault(m[1], m[2].strip('"'))
    return out


def pds_layout(raw) -> tuple[str, int, int, int, int]:
    """(type, first byte, width, height, bands) of an image of 8, 16 or 32 bits, band after band."""
    label = pds_label(raw)
    number = lambda k, d=None: int(re.match(r"-?\d+", label.get(k, str(d)))[0])
    if not {"LINES", "LINE_SAMPLES", "SAMPLE_BITS"} <= set(label):
        raise ValueError("not a planetary image")
    bits = number("SAMPLE_BITS")
    if bits not in (8, 16, 32):
        raise ValueError(f"{bits} bits a sample")
    at = label.get("^IMAGE", "1")
    start = int(re.search(r"\d+", at)[0]) - 1
    if "BYTES" not in at.upper():
        start *= number("RECORD_BYTES", 1)
    kind = label.get("SAMPLE_TYPE", "")
    order = "<" if kind.startswith(("LSB", "PC")) else ">"
    letter = "f" if bits == 32 and "REAL" in kind else "i" if "UNSIGNED" not in kind and "INTEGER" in kind else "u"
    return f"{order}{letter}{bits // 8}", start, number("LINE_SAMPLES"), number("LINES"), number("BANDS", 1)


def encode_pds(pixels: np.ndarray) -> bytes:
    """An image of one band of unsigned 16-bit samples, held to their range, behind a label of whole records."""
    height, width = pixels.shape
    record = 2 * width
    text = ["PDS_VERSION_ID = PDS3", "RECORD_TYPE = FIXED_LENGTH", f"RECORD_BYTES = {record}", "^IMAGE = {}", "OBJECT = IMAGE", f"  LINES = {height}"]
    text += [f"  LINE_SAMPLES = {width}", "  BANDS = 1", "  SAMPLE_BITS = 16", "  SAMPLE_TYPE = MSB_UNSIGNED_INTEGER", "END_OBJECT = IMAGE", "END", ""]
    label = "\r\n".join(text)
    records = -(-(len(label) + 20) // record)
    data = np.clip(np.trunc(pixels), 0, 65_535).astype(">u2").tobytes()
    return label.format(records + 1).encode().ljust(records * record) + data


#: Sample types of camera cubes: name, type, the least and the largest value that is no special pixel, the null pixel.
#: Special pixels (null, and saturation low and high, of instrument or representation) lie outside.
CUBE_TYPES = {
    "UnsignedByte": ("u1", 1, 254, 0),
    "SignedWord": ("i2", -32752, 32767, -32768),
    "Real": ("f4", float(np.uint32(0xFF7FFFFA).view(np.float32)), float(np.finfo(np.float32).max), float(np.uint32(0xFF7FFFFB).view(np.float32))),
}


def cube_label(raw) -> dict[str, str]:
    """The keywords of a camera cube's core, by ``object or group.keyword``."""
    text = raw[:1 << 16].split(b"\0")[0].decode("latin-1")
    out: dict[str, str] = {}
    within: list[str] = []
    for line in text.splitlines():
        m = re.match(r"\s*([A-Za-z_]+)\s*(?:=\s*(.*?)\s*)?$", line)
        if not m:
            continue
        key, value = m[1], (m[2] or "").strip('"')
        if key.lower() in ("object", "group"):
            within.append(value)
        elif key.lower() in ("end_object", "end_group"):
            within = within[:-1]
        elif key.lower() == "end":
            break
        elif "Core" in within:
            out.setdefault(f"{within[-1]}.{key}", value)
    if not out:
        raise ValueError("not a camera cube")
    return out


def cube_layout(raw) -> dict:
    """Where a cube's pixels are and what they mean: type, start, width, height, bands, tile (None: rows of a band), base, multiplier, low, high."""
    label = cube_label(raw)
    kind = label["Pixels.Type"]
    if kind not in CUBE_TYPES:
        raise ValueError(f"pixels of type {kind}")
    code, low, high, _ = CUBE_TYPES[kind]
    order = "<" if label.get("Pixels.ByteOrder", "Lsb").lower() == "lsb" else ">"
    tile = (int(label["Core.TileSamples"]), int(label["Core.TileLines"])) if label.get("Core.Format") == "Tile" else None
    size = {n: int(label[f"Dimensions.{k}"]) for n, k in (("width", "Samples"), ("height", "Lines"), ("bands", "Bands"))}
    scale = {n: float(label.get(f"Pixels.{k}", d)) for n, k, d in (("base", "Base", 0), ("multiplier", "Multiplier", 1))}
    return {"dtype": order + code, "start": int(label["Core.StartByte"]) - 1, "tile": tile, "low": low, "high": high, **size, **scale}


def encode_cube(bands: np.ndarray, tile: tuple[int, int], kind: str = "Real", base: float = 0.0, multiplier: float = 1.0) -> bytes:
    """A tiled cube of (bands, rows, columns); not-a-number becomes the null pixel, tiles are padded with it."""
    code, low, high, null = CUBE_TYPES[kind]
    n, height, width = bands.shape
    w, h = tile
    raw = (bands - base) / multiplier
    raw = np.where(np.isnan(raw), null, np.clip(raw if kind == "Real" else np.rint(raw), low, high))
    padded = np.full((n, -(-height // h) * h, -(-width // w) * w), null, "<" + code)
    padded[:, :height, :width] = raw
    data = padded.reshape(n, padded.shape[1] // h, h, padded.shape[2] // w, w).transpose(0, 1, 3, 2, 4).tobytes()
    rows = [
        "Object = IsisCube", "  Object = Core", "    StartByte = 4097", "    Format = Tile", f"    TileSamples = {w}", f"    TileLines = {h}", "    Group = Dimensions",
        f"      Samples = {width}", f"      Lines = {height}", f"      Bands = {n}", "    End_Group", "    Group = Pixels", f"      Type = {kind}", "      ByteOrder = Lsb",
        f"      Base = {base!r}", f"      Multiplier = {multiplier!r}", "    End_Group", "  End_Object", "End_Object", "End", "",
    ]
    return "\n".join(rows).encode().ljust(4096, b"\0") + data
