"""Data sources for images read by ranges of bytes, and for files that appear only when all are written.

``selenite_tiff``, ``selenite_pds`` and ``selenite_cube`` read georeferenced rasters, planetary images and camera cubes as
(path, band, x, y, v); special pixels of a cube are null. A partition is a range of rows, strips or tiles of one file, some
``partition_bytes`` long, so a large file spreads over many tasks and no task holds more than a block.
The options x, y, width and height, and filters on ``x``, ``y``, ``band`` and ``path`` where the session pushes
filters into such sources, keep the bytes of other rows from being read at all.

``selenite_files`` writes rows (name, content) as files. Tasks write into a folder of their own
attempt; when all have ended the files are moved to their names, and if any fails
nothing is left. With ``overwrite`` the folder's earlier files go when the new ones are there to be moved.

Defined results: a file of another kind, or one that is cut short, raises ``ValueError`` with its path; a window that
is not inside a planetary image, or of one with neither one nor three bands, raises; names
that lead out of the folder or appear twice raise; an empty table writes no file.
"""

from __future__ import annotations

import fnmatch
import os
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from selenite.sources.formats import DEFLATE, PIXELS, cube_layout, pds_layout, tiff_tags, tiff_type

#: Bytes of a partition, pixels of a batch, bytes around a small read that are read with it.
PARTITION = 16 << 20
BATCH = 1 << 19
PAGE = 1 << 16
EVERYTHING = (0, 0, 2**31 - 1, 2**31 - 1)


def address(path: str) -> str:
    """A path of this machine as an address; one way to write it, so that paths can be joined."""
    if path.startswith("file:") and not path.startswith("file://"):
        return "file://" + path[5:]
    return path if "://" in path else "file://" + os.path.abspath(path)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or address, and the place in it."""
    return fs.FileSystem.from_uri(address(path))


def listed(path: str) -> list[tuple[str, int]]:
    """(address, bytes) of a file, the files of a folder or those that fit a pattern; hidden ones are left out."""
    path = address(path)
    head, _, pattern = path.rpartition("/") if any(c in path for c in "*?[") else (path, "", "*")
    store, at = opened(head)
    info = store.get_file_info(at)
    prefix = head[: len(head) - len(at)] if head.endswith(at) else head.partition("://")[0] + "://"
    if info.type == fs.FileType.File:
        return [(prefix + info.path, info.size)]
    found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
    found = [f for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._" and fnmatch.fnmatch(f.base_name, pattern)]
    if not found:
        raise ValueError(f"{path}: no such file")
    return sorted((prefix + f.path, f.size) for f in found)


class RangedFile:
    """A file of which only the slices asked for are read; small ones by whole pages."""

    def __init__(self, path: str):
        store, at = opened(path)
        self.file = store.open_input_file(at)
        self.size = self.file.size()
        self.bytes_read = 0
        self.pages: dict[int, bytes] = {}

    def __len__(self) -> int:
        return self.size

    def read(self, start: int, n: int) -> bytes:
        self.bytes_read += n
        return self.file.read_at(n, start)

    def __getitem__(self, part: slice) -> bytes:
        start, stop, _ = part.indices(self.size)
        n = max(0, stop - start)
        page = start // PAGE
        if n > PAGE // 4 or start + n > (page + 1) * PAGE:
            return self.read(start, n)
        if page not in self.pages:
            self.pages[page] = self.read(page * PAGE, min(PAGE, self.size - page * PAGE))
        return self.pages[page][start - page * PAGE : start - page * PAGE + n]


@dataclass(frozen=True)
class Block:
    """Pixels (x, y, w, h) that lie in ``n`` bytes at ``at``: rows of ``stride`` pixels of ``samples`` values from ``band`` on."""

    at: int
    n: int
    band: int
    samples: int
    x: int
    y: int
    w: int
    h: int
    stride: int
    packed: bool


@dataclass
class Piece(InputPartition):
    path: str
    dtype: str
    blocks: list[Block]
    window: tuple[int, int, int, int]
    #: What samples mean: base, multiplier, least and largest value that is one; nothing: they stand for themselves.
    meaning: tuple[float, float, float, float] | None = None


def cube_plan(raw, longest: int) -> tuple[str, list[Block], tuple[float, float, float, float]]:
    """The tiles of a camera cube, band after band, or its rows cut to about ``longest`` bytes."""
    c = cube_layout(raw)
    size = np.dtype(c["dtype"]).itemsize
    w, h = c["tile"] or (c["width"], max(1, longest // (c["width"] * size)))
    across, down = -(-c["width"] // w), -(-c["height"] // h)
    out, at = [], c["start"]
    for band in range(c["bands"]):
        for k in range(across * down):
            x, y = k % across * w, k // across * h
            rows = min(h, c["height"] - y)
            out.append(Block(at, rows * w * size, band, 1, x, y, min(w, c["width"] - x), rows, w, False))
            at += (h if c["tile"] else rows) * w * size
    return c["dtype"], out, (c["base"], c["multiplier"], c["low"], c["high"])


def tiff_plan(raw, longest: int) -> tuple[str, list[Block]]:
    """The blocks of a TIFF file; strips that are not packed are cut by rows to about ``longest`` bytes."""
    t = tiff_tags(raw)
    kind = tiff_type(t)
    width, height, bands = t["width"][0], t["height"][0], t["bands"][0]
    tiled, packed = "tile_w" in t, t["compression"][0] in DEFLATE
    w, h = (t["tile_w"][0], t["tile_h"][0]) if tiled else (width, min(t.get("strip", (height,))[0], height))
    across, down = -(-width // w), -(-height // h)
    samples = bands if t["planar"][0] == 1 else 1
    out = []
    for i, (at, n) in enumerate(zip(t["offsets"], t["sizes"], strict=True)):
        band, k = (0, i) if samples > 1 else divmod(i, across * down)
        x, y = k % across * w, k // across * h
        rows = min(h, height - y)
        row = w * samples * np.dtype(kind).itemsize
        step = rows if packed or tiled else max(1, longest // row)
        for first in range(0, rows, step):
            some = min(step, rows - first)
            size = n if packed or tiled else some * row
            out.append(Block(at + first * row * (not packed and not tiled), size, band, samples, x, y + first, min(w, width - x), some, w, packed))
    return kind, out


def pds_plan(raw, longest: int, window: tuple[int, int, int, int] | None = None) -> tuple[str, list[Block]]:
    """The rows of a planetary image, band after band, cut to about ``longest`` bytes; of a window only its rows."""
    kind, start, width, height, bands = pds_layout(raw)
    x, y, w, h = window or (0, 0, width, height)
    if window and (x < 0 or y < 0 or w <= 0 or h <= 0 or x + w > width or y + h > height):
        raise ValueError("the tile is not inside the image")
    if window and bands not in (1, 3):
        raise ValueError(f"{bands} bands")
    row = width * np.dtype(kind).itemsize
    step = max(1, longest // row)
    return kind, [
        Block(start + (band * height + first) * row, min(step, y + h - first) * row, band, 1, 0, first, width, min(step, y + h - first), width, False)
        for band in range(bands)
        for first in range(y, y + h, step)
    ]


def inside(block: Block, window: tuple[int, int, int, int]) -> Block | None:
    """The block's rows in the window; columns are cut when it is read."""
    x, y, w, h = window
    top, bottom = max(block.y, y), min(block.y + block.h, y + h)
    if top >= bottom or block.x >= x + w or block.x + block.w <= x:
        return None
    whole = block.packed or block.stride != block.w
    if whole or block.h == 0:
        return block
    row = block.n // block.h
    return replace(block, at=block.at + (top - block.y) * row, n=(bottom - top) * row, y=top, h=bottom - top)


def pixel_batches(piece: Piece, block: Block, data: bytes) -> Iterator[pa.RecordBatch]:
    """The block's pixels in the piece's window, some BATCH a batch."""
    path, dtype, window = piece.path, piece.dtype, piece.window
    if block.packed:
        data = zlib.decompress(data)
    kind = np.dtype(dtype)
    if len(data) < block.h * block.stride * block.samples * kind.itemsize:
        raise ValueError("the file is cut short")
    cube = np.frombuffer(data, kind, block.h * block.stride * block.samples).reshape(block.h, block.stride, block.samples)
    x0, x1 = max(block.x, window[0]), min(block.x + block.w, window[0] + window[2])
    y0, y1 = max(block.y, window[1]), min(block.y + block.h, window[1] + window[3])
    step = max(1, BATCH // max(1, x1 - x0))
    for k in range(block.samples):
        for top in range(y0, y1, step):
            part = cube[top - block.y : min(top + step, y1) - block.y, x0 - block.x : x1 - block.x, k]
            ys, xs = np.divmod(np.arange(part.size, dtype=np.int32), np.int32(max(1, x1 - x0)))
            v = np.ascontiguousarray(part).astype(np.float64).ravel()
            if piece.meaning:
                base, multiplier, low, high = piece.meaning
                v = np.where((v >= low) & (v <= high), base + multiplier * v, np.nan)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([path] * part.size, pa.string()), pa.array(np.full(part.size, block.band + k, np.int32)), pa.array(xs + np.int32(x0)),
                    pa.array(ys + np.int32(top)), pa.array(v, from_pandas=piece.meaning is not None),
                ],
                ["path", "band", "x", "y", "v"],
            )


class ImageReader(DataSourceReader):
    """``plan`` tells the blocks of a file."""

    def __init__(self, options: dict, plan):
        self.options, self.plan = options, plan
        names = ("x", "y", "width", "height")
        self.asked = tuple(int(options[c]) for c in names) if all(c in options for c in names) else None
        self.window, self.bands, self.paths = EVERYTHING, None, None

    def partitions(self) -> list[Piece]:
        size = int(self.options.get("partition_bytes", PARTITION))
        out = []
        for path, _ in listed(self.options["path"]):
            if self.paths is not None and path not in self.paths:
                continue
            try:
                raw = RangedFile(path)
                dtype, blocks, *meaning = self.plan(raw, size, self.asked) if self.asked and self.plan is pds_plan else self.plan(raw, size)
            except (ValueError, KeyError, struct.error) as e:
                raise ValueError(f"{path}: {e}") from e
            window = self.window
            if self.asked:
                x, y = max(window[0], self.asked[0]), max(window[1], self.asked[1])
                window = (x, y, min(window[0] + window[2], self.asked[0] + self.asked[2]) - x, min(window[1] + window[3], self.asked[1] + self.asked[3]) - y)
            held, n = [], 0
            for block in (inside(b, window) for b in blocks):
                if block is None or (self.bands is not None and not self.bands & set(range(block.band, block.band + block.samples))):
                    continue
                if held and n + block.n > size:
                    out.append(Piece(path, dtype, held, window, *meaning))
                    held, n = [], 0
                held.append(block)
                n += block.n
            if held:
                out.append(Piece(path, dtype, held, window, *meaning))
        return out or [Piece("", "<u1", [], EVERYTHING)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if not piece.blocks:
            return
        raw = RangedFile(piece.path)
        for block in piece.blocks:
            try:
                yield from pixel_batches(piece, block, raw.read(block.at, block.n))
            except (ValueError, zlib.error) as e:
                raise ValueError(f"{piece.path}: {e}") from e


class FilteredReader(ImageReader):
    """Also takes filters; Spark applies them to the rows again."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        x, y, w, h = self.window
        low, high = {"x": x, "y": y}, {"x": x + w - 1, "y": y + h - 1}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in low and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) and isinstance(f.value, int):
                low[column] = max(low[column], f.value + isinstance(f, GreaterThan))
            if column in low and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)) and isinstance(f.value, int):
                high[column] = min(high[column], f.value - isinstance(f, LessThan))
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if column == "band" and values is not None:
                self.bands = values if self.bands is None else self.bands & values
            if column == "path" and values is not None:
                self.paths = values if self.paths is None else self.paths & values
            yield f
        self.window = (low["x"], low["y"], high["x"] - low["x"] + 1, high["y"] - low["y"] + 1)


class TiffSource(DataSource):
    plan = staticmethod(tiff_plan)

    @classmethod
    def name(cls) -> str:
        return "selenite_tiff"

    def schema(self) -> str:
        return PIXELS

    def reader(self, schema) -> DataSourceReader:
        kind = FilteredReader if self.options.get("push") == "true" else ImageReader
        return kind(dict(self.options), type(self).plan)


class PdsSource(TiffSource):
    plan = staticmethod(pds_plan)

    @classmethod
    def name(cls) -> str:
        return "selenite_pds"


class CubeSource(TiffSource):
    plan = staticmethod(cube_plan)

    @classmethod
    def name(cls) -> str:
        return "selenite_cube"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class FileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.store_path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.job = uuid.uuid4().hex
        store, _, stage = self.base()
        store.create_dir(stage, recursive=True)

    def base(self) -> tuple[fs.FileSystem, str, str]:
        store, at = opened(self.store_path)
        return store, at, f"{at}/_temporary/{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, _, stage = self.base()
        context = TaskContext.get()
        folder = f"{stage}/{context.partitionId()}_{context.taskAttemptId()}"
        out = []
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                if not name or name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"no name for a file: {name!r}")
                part = f"{folder}/{len(out)}"
                if not out:  # fails where the job was given up and its folder is gone
                    store.create_dir(folder, recursive=False)
                with store.open_output_stream(part) as stream:
                    stream.write(content.as_buffer() if content.is_valid else b"")
                out.append((part, name))
        return Written(out)

    def commit(self, messages: list[Written]) -> None:
        store, at, stage = self.base()
        files = [f for m in messages if m for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("a name appears twice")
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
                if info.base_name != "_temporary":
                    (store.delete_dir if info.type == fs.FileType.Directory else store.delete_file)(info.path)
        store.create_dir(at, recursive=True)
        for folder in {name.rpartition("/")[0] for name in names} - {""}:
            store.create_dir(f"{at}/{folder}", recursive=True)
        for part, name in files:
            store.move(part, f"{at}/{name}")
        self.clear(store, at, stage)

    def abort(self, messages: list[Written]) -> None:
        self.clear(*self.base())

    def clear(self, store: fs.FileSystem, at: str, stage: str) -> None:
        for wait in (0.05, 0.2, 0.5, None):
            try:
                if store.get_file_info(stage).type == fs.FileType.Directory:
                    store.delete_dir(stage)
                break
            except OSError:  # a task that has not yet been told still writes
                if wait is None:
                    raise
                time.sleep(wait)
        if not store.get_file_info(fs.FileSelector(f"{at}/_temporary", allow_not_found=True)):
            if store.get_file_info(f"{at}/_temporary").type == fs.FileType.Directory:
                store.delete_dir(f"{at}/_temporary")


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "selenite_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(dict(self.options), overwrite)


def read_images(spark: SparkSession, source: type[DataSource], path: str, **options) -> DataFrame:
    """(path, band, x, y, v) of the files of a path, folder or pattern."""
    spark.dataSource.register(source)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format(source.name()).option("push", push)
    return reader.options(**{k: str(v) for k, v in options.items()}).load(path)


def save_files(files: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Write rows (name, content) as files of ``folder``, all or none."""
    files.sparkSession.dataSource.register(FileSink)
    files.select("name", "content").write.format("selenite_files").mode("overwrite" if overwrite else "append").save(folder)
