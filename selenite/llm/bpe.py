"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

The lexicon of frequent words (the most frequent of the whole corpus, at most
``LEXICON_WORDS``) is compiled on the driver into a minimal acyclic automaton: equal
suffixes share states, and each arc carries the number of words that sort before
those behind it, so the outputs along a path add up to the word's rank, which
names its ids. The tables are plain arrays in files that Spark distributes to
every executor, the new ones too, and that the workers memory-map. Words the
lexicon lacks are merged exactly, many at a time.

A text is white-space separated units; no token of the vocabulary's pattern
crosses white space, so each distinct unit of a slice is split and encoded once
and the ids of the occurrences are gathered.

Defined results: a null text counts as empty; an empty text has no ids and the
empty decoding; texts of any length are encoded whole (a single word of
thousands of characters is merged with a heap); repeated rows each get a result;
columns of the input other than the named ones are passed through untouched when
asked for with ``keep``. An empty table gives an empty table.
"""

from __future__ import annotations

import gc
import heapq
import json
import os
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selenite.llm.common import concat_column, giving_way, materialize, release, slices, spare

LEXICON_WORDS = 65_536
#: Marks that the pattern sets apart from a word before them.
MARKS = frozenset(".,;:!?")
#: Steps of the histogram of word counts in an octave.
STEPS = 16
SLICE_BYTES = 3_000_000
#: Units that a worker remembers between slices; encoding one anew gives the same ids.
HELD_UNITS = 220_000
COUNT_BYTES = 8_000_000
#: A longer word is merged with a heap; shorter ones many at a time, by width.
WIDTHS = (8, 16, 32, 64)
NONE = np.int32(2**31 - 1)
#: Fixed value: the pattern of the vocabulary's pre-tokenizer.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters that Python splits at although they are no white space in Unicode.
ODD_SPACE = regex.compile("[\x1c-\x1f]")
SPACE = regex.compile(r"[\p{White_Space}]+")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in shown}
    hidden = (b for b in range(256) if b not in table)
    table |= {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


def gather(offsets: np.ndarray, values: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ragged rows (offsets, values), those of ``index``, again as (offsets, values)."""
    starts, sizes = offsets[index], offsets[index + 1] - offsets[index]
    out = np.zeros(len(index) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    at = np.arange(out[-1]) + np.repeat(starts - out[:-1], sizes)
    return out, values[at]


def ragged(lists: list) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    return offsets, np.fromiter((y for x in lists for y in x), np.int32, offsets[-1])


class Merges:
    """A vocabulary's merges as arrays, and exact merging of words."""

    def __init__(self, tables: dict[str, np.ndarray]):
        self.tables = tables
        self.keys, self.rank, self.made = tables["pair_key"], tables["pair_rank"], tables["pair_made"]

    @staticmethod
    def load(path: str) -> Merges:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        alphabet = byte_alphabet()
        pairs = sorted(
            ((vocab[a] << 32) | vocab[b], i, vocab[a + b]) for i, (a, b) in enumerate(map(tuple, model["merges"]))
        )
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        names = {i: t for t, i in (vocab | special).items()}
        pieces = [names.get(i, "").encode() for i in range(max(names) + 1)]
        offsets = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum([len(p) for p in pieces], out=offsets[1:])
        columns = [np.array(c) for c in zip(*pairs, strict=True)]
        return Merges(
            {
                "pair_key": columns[0].astype(np.int64),
                "pair_rank": columns[1].astype(np.int32),
                "pair_made": columns[2].astype(np.int32),
                "inner": np.array([vocab[c] for c in alphabet], np.int32),
                "final": np.array([vocab[c + suffix] for c in alphabet], np.int32),
                "piece_at": offsets,
                "piece": np.frombuffer(b"".join(pieces), np.uint8),
                "special_id": np.array(list(special.values()), np.int32),
                "special": np.array([*special, ""], dtype=str)[:-1] if special else np.array([], "<U1"),
            }
        )

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where there is no merge) and place in the table of each pair."""
        key = (a.astype(np.int64) << 32) | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (b >= 0), self.rank[at], NONE), at

    def symbols(self, word: bytes) -> np.ndarray:
        ids = self.tables["inner"][np.frombuffer(word, np.uint8)]
        ids[-1] = self.tables["final"][word[-1]]
        return ids

    def merge_one(self, word: bytes) -> list[int]:
        """The lowest rank first, the leftmost of equals: with a heap over a linked list."""
        ids = self.symbols(word).tolist()
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        rank, _ = self.pair(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(rank) if r != NONE]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            _, at = self.pair(np.array([a], np.int32), np.array([b], np.int32))
            ids[i], ids[j] = int(self.made[at[0]]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if right >= 0:
                    r, _ = self.pair(np.array([ids[left]], np.int32), np.array([ids[right]], np.int32))
                    if r[0] != NONE:
                        heapq.heappush(heap, (int(r[0]), left, ids[left], ids[right]))
        return [i for i in ids if i >= 0]

    def merge_many(self, words: list[bytes], width: int) -> list[np.ndarray]:
        """As merge_one, for words of at most ``width`` bytes, one merge of every word at a time."""
        n = len(words)
        flat = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, n)
        inside = np.arange(width) < sizes[:, None]
        ids = np.full((n, width + 1), -1, np.int32)
        ids[:, :width][inside] = self.tables["inner"][flat]
        ids[np.arange(n), sizes - 1] = self.tables["final"][flat[np.cumsum(sizes) - 1]]
        ranks = np.full((n, width), NONE, np.int32)
        both = ids[:, 1:] >= 0
        ranks[both], _ = self.pair(ids[:, :-1][both], ids[:, 1:][both])
        done: list = [None] * n
        rows, columns = np.arange(n), np.arange(width + 1)
        while len(rows):
            j = ranks.argmin(1)
            live = ranks[np.arange(len(rows)), j] != NONE
            for k in np.flatnonzero(~live):
                done[rows[k]] = ids[k][ids[k] >= 0]
            rows, ids, ranks, j = rows[live], ids[live], ranks[live], j[live]
            if not len(rows):
                break
            k = np.arange(len(rows))
            _, at = self.pair(ids[k, j], ids[k, j + 1])
            shift = np.minimum(columns + (columns > j[:, None]), width)
            ids = np.take_along_axis(ids, shift, 1)
            ids[:, width] = -1
            ids[k, j] = self.made[at]
            ranks = np.take_along_axis(ranks, np.minimum(shift[:, :width], width - 1), 1)
            ranks[:, width - 1] = NONE
            ranks[k, j], _ = self.pair(ids[k, j], ids[k, j + 1])
            left = j > 0
            ranks[k[left], j[left] - 1], _ = self.pair(ids[k[left], j[left] - 1], ids[k[left], j[left]])
        return done

    def merge(self, words: list[bytes]) -> list:
        out: list = [()] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for width in WIDTHS:
            for part in np.array_split(at := np.flatnonzero((sizes > low) & (sizes <= width)), len(at) // 20_000 + 1):
                if len(part):
                    for i, ids in zip(part, self.merge_many([words[i] for i in part], width), strict=True):
                        out[i] = ids
            low = width
        for i in np.flatnonzero(sizes > low):
            out[i] = self.merge_one(words[i])
        return out


def compile_lexicon(words: list[bytes], ids: list) -> dict[str, np.ndarray]:
    """A minimal acyclic transducer: arcs to states, outputs that add up to a word's rank.

    Built from sorted words; a state is shared as soon as no later word can
    change it (same finality, same arcs), so equal suffixes are stored once.
    """
    order = sorted(range(len(words)), key=words.__getitem__)
    register: dict = {}
    kept: list[tuple[bool, tuple]] = []

    def share(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(kept)
            kept.append(key)
        return register[key]

    path: list[list] = [[False, []]]  # finality and closed arcs of the states on the last word's path
    last = b""
    for i in order:
        word = words[i]
        common = len(os.path.commonprefix([last, word]))
        for depth in range(len(last), common, -1):
            path[depth - 1][1].append((last[depth - 1], share(path.pop())))
        path += [[False, []] for _ in range(len(word) - common)]
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        path[depth - 1][1].append((last[depth - 1], share(path.pop())))
    root = share(path[0])

    used = sorted({b for w in words for b in w})
    classes = np.full(256, len(used), np.int32)
    classes[used] = np.arange(len(used))
    dead = len(kept)
    go = np.full((dead + 1, len(used) + 1), dead, np.int32)
    out = np.zeros((dead + 1, len(used) + 1), np.int32)
    below = np.zeros(dead + 1, np.int64)
    for state, (final, arcs) in enumerate(kept):  # children come before their parents
        n = int(final)
        for byte, to in arcs:
            go[state, classes[byte]], out[state, classes[byte]] = to, n
            n += below[to]
        below[state] = n
    at, values = ragged([ids[i] for i in order])
    final = np.array([k[0] for k in kept] + [False])
    limits = np.array([root, max(map(len, words), default=0)], np.int64)
    return {"go": go, "out": out, "final": final, "class": classes, "ids_at": at, "ids": values, "limits": limits}


class Codec:
    """What a worker holds: the memory-mapped lexicon and the merges."""

    def __init__(self, merges: Merges, lexicon: dict[str, np.ndarray]):
        self.merges, self.lexicon = merges, lexicon
        t = merges.tables
        self.special = dict(zip(t["special"].tolist(), t["special_id"].tolist(), strict=True))
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        at, whole = t["piece_at"].tolist(), t["piece"].tobytes()
        self.pieces = [whole[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        self.forget()

    def forget(self) -> None:
        self.units = {s: int(i).to_bytes(4, "little") for s, i in self.special.items()}

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """Each word's rank in the lexicon, or -1: all words take a step of the automaton at once."""
        x, n = self.lexicon, len(words)
        root, longest = x["limits"]
        sizes = np.fromiter(map(len, words), np.int64, n)
        rank = np.full(n, -1, np.int64)
        rows = np.flatnonzero((sizes > 0) & (sizes <= longest))
        rows = rows[np.argsort(-sizes[rows], kind="stable")]
        sizes = sizes[rows]
        flat = x["class"][np.frombuffer(b"".join([words[i] for i in rows]), np.uint8)]
        starts = np.cumsum(sizes) - sizes
        state, total = np.full(len(rows), root, np.int32), np.zeros(len(rows), np.int64)
        for j in range(int(sizes[0]) if len(sizes) else 0):
            m = int(np.searchsorted(-sizes, -j, side="left"))  # words longer than j come first
            symbol = flat[starts[:m] + j]
            total[:m] += x["out"][state[:m], symbol]
            state[:m] = x["go"][state[:m], symbol]
        rank[rows] = np.where(x["final"][state], total, -1)
        return rank

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        rank = self.ranks(words)
        known = rank >= 0
        at, ids = gather(self.lexicon["ids_at"], self.lexicon["ids"], rank[known])
        unseen = np.flatnonzero(~known)
        more_at, more = ragged(self.merges.merge([words[i] for i in unseen]))
        joined = np.concatenate([at, more_at[1:] + at[-1]])
        place = np.empty(len(words), np.int64)
        place[known], place[unseen] = np.arange(known.sum()), known.sum() + np.arange(len(unseen))
        return gather(joined, np.concatenate([ids, more]), place)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers.

        A unit is encoded when it is first met; the worker remembers up to about
        ``HELD_UNITS`` of them between slices, then those of the slice at hand.
        """
        per_text = [split_units(t, self.split) for t in texts]
        distinct = set().union(*per_text)
        new = list(distinct.difference(self.units))
        if len(self.units) + len(new) > HELD_UNITS:
            held = self.units
            self.forget()
            self.units.update((u, held[u]) for u in distinct.intersection(held))
            del held
        found = list(map(unit_words, normalized(new)))
        words = list(set().union(*found)) if found else []
        at, ids = self.encode_words([w.encode() for w in words])
        raw, at = ids.astype("<u4").tobytes(), (4 * at).tolist()
        ids_of = {w: raw[a:b] for w, a, b in zip(words, at[:-1], at[1:], strict=True)}
        self.units.update((u, b"".join([ids_of[w] for w in x])) for u, x in zip(new, found, strict=True))
        look = self.units.__getitem__
        return [b"".join(map(look, x)) for x in per_text]

    def decode(self, rows: list[bytes]) -> list[bytes]:
        """The tokens of each row of ids, joined by one space: the vocabulary names no decoder."""
        look = self.pieces.__getitem__
        return [b" ".join(map(look, np.frombuffer(x, "<u4").tolist())) for x in rows]


def split_units(text: str, special: regex.Pattern | None) -> list[str]:
    if "<|" in text and special is not None and special.search(text):
        out, at = [], 0
        for m in special.finditer(text):
            out += [*split_units(text[at : m.start()], None), m[0]]
            at = m.end()
        return out + split_units(text[at:], None)
    if ODD_SPACE.search(text):
        return [u for u in SPACE.split(text) if u]
    return text.split()


def unit_words(unit: str) -> list[str]:
    """The pattern's words of a normalized unit; plain letters, and these before one mark, need no search."""
    if unit.isascii():
        if unit.isalpha():
            return [unit]
        if unit[-1:] in MARKS and unit[:-1].isalpha():
            return [unit[:-1], unit[-1]]
    return WORD.findall(unit)


@contextmanager
def without_collector() -> Iterator[None]:
    """Many small lists and no cycles: the collector would only walk them."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def normalized(units: list[str]) -> list[str]:
    """NFC and each character's own lower case, as the vocabulary's normalizer does."""
    joined = unicodedata.normalize("NFC", "\n".join(units))
    return joined.replace("Σ", "σ").lower().split("\n") if units else []


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) over all texts. Tasks count slices first, so few rows are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, COUNT_BYTES):
            units: Counter = Counter()
            words: Counter = Counter()
            with without_collector():
                for t in concat_column(batch.column(text)).to_pylist():
                    units.update(t.split() if t else ())
                for n, u in zip(units.values(), normalized(list(units)), strict=True):
                    for w in unit_words(u):
                        words[w.encode()] += n
            rows = list(words.items())
            for i in range(0, len(rows), 100_000):
                part = rows[i : i + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w for w, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64())], ["word", "n"]
                )
            del units, words, rows
        release()

    return docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def distribute(spark: SparkSession, tables: dict[str, dict[str, np.ndarray]]) -> dict[str, list[str]]:
    """Hand arrays to every executor as files; a replacement executor fetches them anew."""
    folder, run = tempfile.mkdtemp(prefix="selenite-"), uuid.uuid4().hex[:12]
    names = {}
    for group, arrays in tables.items():
        names[group] = list(arrays)
        for name, array in arrays.items():
            path = os.path.join(folder, f"{run}-{group}-{name}.npy")
            np.save(path, array)
            spark.sparkContext.addFile(path)
    return {"run": run, **names}


HELD: dict[str, Codec] = {}


def held_codec(names: dict) -> Codec:
    """The worker's codec, memory-mapped once for all tasks of a run."""
    run = names["run"]
    if run not in HELD:
        HELD.clear()
        mapped = {
            group: {n: np.load(SparkFiles.get(f"{run}-{group}-{n}.npy"), mmap_mode="r") for n in names[group]}
            for group in ("merges", "lexicon")
        }
        HELD[run] = Codec(Merges(mapped["merges"]), mapped["lexicon"])
    return HELD[run]


def prepare(docs: DataFrame, vocabulary: str, text: str = "text", lexicon_words: int = LEXICON_WORDS) -> dict:
    """Learn the frequent words of the corpus, compile and distribute; the handle is for encode and decode.

    A histogram of the counts (at most ``STEPS`` rows an octave) gives the least step of which
    no more than ``lexicon_words`` words are left at or above; these alone come to the driver.
    Words that occur once are never frequent.
    """
    merges = Merges.load(vocabulary)
    step = F.floor(F.log2("n") * STEPS).cast("int")
    counts = materialize(word_counts(docs, text).where("n > 1").select("word", step.alias("step")))
    least, held = None, 0
    for r in sorted(counts.groupBy("step").count().collect(), key=lambda r: -r["step"]):
        held += r["count"]
        if held > lexicon_words:
            break
        least = r["step"]
    frequent = counts.where(F.col("step") >= least) if least is not None else counts.limit(0)
    words = sorted(bytes(r["word"]) for r in frequent.select("word").collect())
    lexicon = compile_lexicon(words, merges.merge(words))
    return distribute(docs.sparkSession, {"merges": merges.tables, "lexicon": lexicon})


def encode(docs: DataFrame, handle: dict, text: str = "text", keep: list[str] = (), decoded: bool = False) -> DataFrame:
    """Columns ``keep``, then ``ids`` (little-endian unsigned 32-bit) and, if asked for, ``decoded``."""
    keep = giving_way(keep, "ids", *["decoded"] * decoded)
    own = spare("selenite_text", keep)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("ids", T.BinaryType())])
    if decoded:
        schema = schema.add("decoded", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held_codec(handle)
        for batch in slices(batches, own, SLICE_BYTES):
            texts = [t or "" for t in concat_column(batch.column(own)).to_pylist()]
            with without_collector():
                rows = codec.encode(texts)
            out = [*(batch.column(c) for c in keep), pa.array(rows, pa.binary())]
            if decoded:
                out.append(pa.array(codec.decode(rows), pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(out, schema.names)
        codec.forget()
        release()

    return docs.select(*keep, F.col(text).alias(own)).mapInArrow(run, schema)


def decode(encoded: DataFrame, handle: dict, ids: str = "ids", keep: list[str] = ()) -> DataFrame:
    """Columns ``keep``, then ``decoded``. Null ids decode to the empty text."""
    keep = giving_way(keep, "decoded")
    own = spare("selenite_ids", keep)
    schema = T.StructType([encoded.schema[c] for c in keep] + [T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held_codec(handle)
        for batch in slices(batches, own, SLICE_BYTES):
            rows = [x or b"" for x in concat_column(batch.column(own)).to_pylist()]
            text = codec.decode(rows)
            out = [*(batch.column(c) for c in keep), pa.array(text, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(out, schema.names)

    return encoded.select(*keep, F.col(ids).alias(own)).mapInArrow(run, schema)
