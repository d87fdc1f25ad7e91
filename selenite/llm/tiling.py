"""Benchmark decontamination by greedy string tiling.

A text and a benchmark item are compared as sequences of words. Seeds are runs of
``min_tile`` words that both share, found by a rolling Karp-Rabin hash of word
numbers over the whole text. Neighbouring seeds on a diagonal make maximal
matches; the longest match is marked again and again, matches that overlap
marked words being cut back, so the tiles of an item never overlap whatever order
they stand in. The share of an item's words under tiles is its coverage: an item
whose sentences were reordered is covered like a copy.

The benchmark is the stated query set. It is dealt into blocks of at most
``BLOCK_BYTES`` of text, each small enough to hand to every task, and the texts
are read once for each block (one block for usual test sets), so no side is
broadcast whatever its size, and no pairs are shuffled.

Defined results: null texts and items count as empty; items without words match
nothing; an item with fewer than ``min_tile`` words is one seed as a whole; equal
items are compared once each, ties of coverage go to the smaller item id; ids may be
null or repeated; repeated rows get equal results; an empty benchmark leaves
every text with coverage 0; other columns pass through where kept.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selenite.llm.common import giving_way, slices, spare, text_bytes

MIN_TILE = 5
THRESHOLD = 0.6
BLOCK_BYTES = 8_000_000
SLICE_BYTES = 8_000_000
#: A-Z to a-z; other ASCII that is neither letter nor digit to blanks.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)
BASE = np.uint64(0x9E3779B97F4A7C15)


def word_list(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def rolling(numbers: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``width`` numbers, modulo 2**64."""
    if len(numbers) < width:
        return np.zeros(0, np.uint64)
    n = len(numbers) - width + 1
    out = numbers[:n].copy()
    for j in range(1, width):
        out = out * BASE + numbers[j : j + n]
    return out


class Bench:
    """A block of benchmark items, ready to be searched for in texts."""

    def __init__(self, items: list[tuple[int | None, bytes]], min_tile: int):
        self.ids = [i for i, _ in items]
        self.words: dict[bytes, int] = {}
        numbers = [[self.words.setdefault(w, len(self.words) + 1) for w in word_list(t)] for _, t in items]
        self.items = [np.array(x, np.uint64) for x in numbers]
        self.seeds: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, x in enumerate(self.items):
            width = min(min_tile, len(x))
            if width:
                for q, h in enumerate(rolling(x, width).tolist()):
                    self.seeds[width][h].append((k, q))
        self.seeds = {w: dict(s) for w, s in self.seeds.items()}
        self.known = {w: np.sort(np.fromiter(s, np.uint64, len(s))) for w, s in self.seeds.items()}

    def numbers(self, words: list[bytes]) -> np.ndarray:
        look = self.words.get
        return np.array([look(w, 0) for w in words], np.uint64)

    def hits(self, numbers: np.ndarray) -> dict[int, dict[tuple[int, int], int]]:
        """For each item, the seeds it shares with the text: (place in text, place in item) to width."""
        found: dict[int, dict[tuple[int, int], int]] = defaultdict(dict)
        for width, known in self.known.items():
            if len(numbers) < width:
                continue
            gaps = np.cumsum(np.concatenate([[0], numbers == 0]))
            at = np.flatnonzero(gaps[width:] == gaps[:-width])  # runs of words of the benchmark only
            if not len(at):
                continue
            h = rolling(numbers, width)[at]
            place = np.minimum(np.searchsorted(known, h), len(known) - 1)
            for p, x in zip(at[known[place] == h].tolist(), h[known[place] == h].tolist(), strict=True):
                for k, q in self.seeds[width][x]:
                    if np.array_equal(numbers[p : p + width], self.items[k][q : q + width]):
                        found[k][p, q] = width
        return found

    def best(self, text: bytes) -> tuple[float, int | None, int, int]:
        """(highest coverage, its item's id, tiles of that item, items that share a tile)."""
        found = self.hits(self.numbers(word_list(text)))
        out = (0.0, None, 0)
        for k, seeds in found.items():
            tiles = tile(seeds)
            share = sum(n for _, _, n in tiles) / len(self.items[k])
            rank = (-share, self.ids[k] is None, self.ids[k] or 0)
            if rank < (-out[0], out[1] is None, out[1] or 0):
                out = (share, self.ids[k], len(tiles))
        return (*out, len(found))


def tile(seeds: dict[tuple[int, int], int]) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in text, place in item, words) from the seeds of one text and item.

    Longest first, ties to the earlier place in the text, then in the item.
    """
    matches = []
    for (p, q), width in seeds.items():
        if (p - 1, q - 1) not in seeds:
            n = 0
            while (p + n, q + n) in seeds:
                n += 1
            matches.append((-(n - 1 + width), p, q, width))
    heapq.heapify(matches)
    in_text: set[int] = set()
    in_item: set[int] = set()
    out = []
    while matches:
        n, p, q, width = heapq.heappop(matches)
        n = -n
        free = [i for i in range(n) if p + i not in in_text and q + i not in in_item]
        if len(free) == n:
            in_text.update(range(p, p + n))
            in_item.update(range(q, q + n))
            out.append((p, q, n))
            continue
        start = None
        for i, j in zip([*free, None], [None, *free], strict=True):  # unmarked stretches, long enough, come again
            if start is not None and (i is None or i != j + 1):
                if j - start + 1 >= width:
                    heapq.heappush(matches, (-(j - start + 1), p + start, q + start, width))
                start = i
            elif start is None:
                start = i
    return out


def blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items with text, dealt by hash into blocks of about ``BLOCK_BYTES``."""
    some = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).where("t is not null")
    size = some.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = int(size // BLOCK_BYTES) + 1
    for k in range(n):
        part = some.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).orderBy("i", "t")
        yield [(r["i"], r["t"].encode()) for r in part.collect()]


def coverage(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    keep: list[str] = (),
    item: str = "item_id",
    item_text: str = "text",
    min_tile: int = MIN_TILE,
) -> DataFrame:
    """Columns ``keep``, then ``coverage``, ``item_id``, ``n_tiles`` (of the best covered item) and ``n_items``.

    ``n_items`` counts the items that share at least one seed.
    """
    keep = giving_way(keep, "coverage", "item_id", "n_tiles", "n_items")
    own = spare("selenite_text", keep)
    found = docs.select(
        *keep,
        F.col(text).alias(own),
        F.lit(0.0).alias("coverage"),
        F.lit(None).cast("long").alias("item_id"),
        F.lit(0).cast("long").alias("n_tiles"),
        F.lit(0).cast("long").alias("n_items"),
    )
    for block in blocks(benchmark, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # at most about BLOCK_BYTES
        found = found.mapInArrow(search(shared, min_tile, found.columns, own), found.schema)
    return found.drop(own)


def search(shared, min_tile: int, columns: list[str], own: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Bench(shared.value, min_tile)
        for batch in slices(batches, own, SLICE_BYTES):
            rows = batch.select(columns[-4:]).to_pylist()
            for i, text in enumerate(text_bytes(batch.column(own))):
                share, item, tiles, items = bench.best(text)
                old, held = rows[i], rows[i]["item_id"]
                if items and (-share, item is None, item or 0) < (-old["coverage"], held is None, held or 0):
                    old |= {"coverage": share, "item_id": item, "n_tiles": tiles}
                old["n_items"] += items
            types = [pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            new = [pa.array([r[c] for r in rows], t) for c, t in zip(columns[-4:], types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns[:-4]), *new], columns)

    return run


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose coverage of every item is below ``threshold``; the columns stay as they are."""
    keep = [F.col(c).alias(f"selenite_{i}") for i, c in enumerate(docs.columns)]
    named = docs.select(*keep, F.col(text).alias("selenite_of"))
    found = coverage(named, benchmark, "selenite_of", [f"selenite_{i}" for i in range(len(docs.columns))])
    return found.where(F.col("coverage") < threshold).select(
        *(F.col(f"selenite_{i}").alias(c) for i, c in enumerate(docs.columns))
    )
