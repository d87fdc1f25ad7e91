"""Substring dedup by content-defined chunks under a gear rolling hash.

A gear hash (shift by one, add the byte's random number, 16 bits, so the last 16
bytes count) runs over the UTF-8 of a text. A chunk ends after a white-space
byte where the hash's two leading bits are zero, at least ``MIN_CHUNK`` bytes
after the last cut. Where the ``BARE`` bytes before a place hold no white space, it ends
before any character where the hash's five leading bits are zero, so scripts without
blanks are cut too; a chunk of ``MAX_CHUNK`` bytes ends before the next character. The cuts
depend only on the bytes nearby, so an insertion moves them and changes at most the chunks
around it. Chunks are compared by a 128-bit digest; the first in the order of (id, text
key, place) stays.

A single chunk of some words may repeat by chance, so only runs of neighbouring
repeated chunks with at least ``MIN_WORDS`` words or ``MIN_CHARACTERS`` characters are cut
out of a text. Cuts fall between characters, so the rest keeps its characters whole.

Defined results: null texts have no chunks and stay null; rows with equal id and
text are one row (none repeats the other) and get equal results; ids may be null
(they sort first); a column of the input named ``spans`` gives way where spans are added and
stays where they are cut out; other columns pass through; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selenite.llm.common import concat_column, giving_way, materialize, release, slices, spare, text_bytes, text_key

SLICE_BYTES = 4_000_000
MIN_CHUNK = 24
MAX_CHUNK = 4096
BARE = 64
MIN_WORDS = 20
MIN_CHARACTERS = 160
#: Parts into which a digest is dealt that more than a share of 1 in 4 x partitions of the repeated chunks have.
SALTS = 64
#: The gear table is drawn from this seed.
SEED = 20_240_607
GEAR = np.random.default_rng(SEED).integers(0, 1 << 16, 256, dtype=np.uint16)
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = (h[i-1] << 1) + GEAR[data[i]] in 16 bits, for all places at once by doubling."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint16(step))
    return h


def places(data: np.ndarray) -> np.ndarray:
    """Where a chunk may end, ascending: behind white space, and between characters far from any."""
    h, space = gear_hash(data), SPACES[data]
    behind = space & (h < 1 << 14)
    blanks = np.flatnonzero(np.concatenate([[True], space, [True]]))
    if np.diff(blanks).max() > BARE:
        since = np.arange(1, len(data) + 1) - np.maximum.accumulate(np.where(space, np.arange(1, len(data) + 1), 0))
        starts = np.append((data[1:] & 0xC0) != 0x80, True)  # the next byte begins a character
        behind |= (since >= BARE) & starts & (h < 1 << 11)
    return np.flatnonzero(behind) + 1


def cuts(text: bytes) -> list[int]:
    """Ends of the chunks of a text; the last is its length. An empty text has none."""
    if not text:
        return []
    data = np.frombuffer(text, np.uint8)
    out, last = [], 0
    for at in [*places(data).tolist(), len(text)]:
        while at - last > MAX_CHUNK:
            last += MAX_CHUNK
            while text[last] & 0xC0 == 0x80:
                last -= 1
            out.append(last)
        if at - last >= MIN_CHUNK or (at == len(text) and at > last):
            out.append(at)
            last = at
    return out


def chunks(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_key, d1, d2, place, start, stop, words, characters): the chunks of all texts, digests and byte offsets."""
    schema = T.StructType(
        [T.StructField("id", docs.schema[id_column].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("text_key", "d1", "d2")]
        + [T.StructField(c, T.IntegerType()) for c in ("place", "start", "stop", "words", "characters")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "selenite_text", SLICE_BYTES):
            rows, place, start, stop, words, characters, digests = [], [], [], [], [], [], []
            for i, raw in enumerate(text_bytes(batch.column("selenite_text"))):
                ends = cuts(raw)
                begins = [0, *ends[:-1]]
                parts = [raw[a:b] for a, b in zip(begins, ends, strict=True)] if ends else []
                rows += [i] * len(ends)
                place += range(len(ends))
                start += begins if ends else []
                stop += ends
                words += [len(p.split()) for p in parts]
                if ends:
                    lead = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[np.array(ends) - 1]
                    characters += np.diff(lead, prepend=0).tolist()
                digests += map(xxhash.xxh3_128_digest, parts)
            pair = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            index = pa.array(rows, pa.int32())
            numbers = [pa.array(x, pa.int32()) for x in (place, start, stop, words, characters)]
            yield pa.RecordBatch.from_arrays(
                [
                    concat_column(batch.column("selenite_id")).take(index),
                    concat_column(batch.column("text_key")).take(index),
                    pa.array(np.ascontiguousarray(pair[:, 0])),
                    pa.array(np.ascontiguousarray(pair[:, 1])),
                    *numbers,
                ],
                schema.names,
            )
        release()

    return docs.select(
        F.col(id_column).alias("selenite_id"), text_key(text).alias("text_key"), F.col(text).alias("selenite_text")
    ).mapInArrow(run, schema)


def salted(rows: DataFrame, hot: DataFrame, salt: F.Column) -> DataFrame:
    """``rows`` with a ``salt``: 0 unless their digest is hot."""
    return rows.join(F.broadcast(hot), ["d1", "d2"], "left").withColumn("salt", F.when(F.col("hot"), salt).otherwise(0)).drop("hot")


def duplicate_spans(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, text_key, spans): the byte spans to cut, ascending; only of texts that have any.

    Digests are counted with partial sums first; only the chunks that repeat at all go on. A
    digest is hot if it has more than 1 in 4 x partitions of these, so at most 4 x partitions
    are; their list is broadcast, and their rows are dealt over ``SALTS`` parts.
    """
    spark = docs.sparkSession
    parts = chunks(docs, id_column, text)
    repeated = materialize(parts.groupBy("d1", "d2").count().where("count > 1"))
    share = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = (repeated.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]) // share
    hot = repeated.where(F.col("count") > limit).select("d1", "d2", F.lit(True).alias("hot"))
    every = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))

    def by_digest(rows: DataFrame, of: DataFrame) -> DataFrame:
        own = salted(rows, hot, F.pmod(F.xxhash64("id", "text_key", "place"), F.lit(SALTS)).cast("int"))
        of = of.join(F.broadcast(hot), ["d1", "d2"], "left").withColumn("salt", every).drop("hot")
        return own.join(of, ["d1", "d2", "salt"]).drop("salt")

    some = materialize(by_digest(parts, repeated.select("d1", "d2")))
    first = some.groupBy("d1", "d2").agg(F.min(F.struct("id", "text_key", "place")).alias("first"))
    later = by_digest(some, first).where(~F.struct("id", "text_key", "place").eqNullSafe(F.col("first")))
    columns = ["place", "start", "stop", "words", "characters"]
    later = later.select("id", "text_key", *columns).distinct()
    return runs(later.groupBy("id", "text_key").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("c")), min_words)


def runs(lists: DataFrame, min_words: int) -> DataFrame:
    """Join neighbouring chunks of each text's sorted list and keep the long runs."""
    schema = T.StructType([lists.schema["id"], lists.schema["text_key"]])
    schema = schema.add("spans", T.ArrayType(T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for chunk_list in batch.column("c").to_pylist():
                spans, sizes = [], []
                for c in chunk_list:
                    if spans and spans[-1][1] == c["start"]:
                        spans[-1][1] = c["stop"]
                        sizes[-1] = (sizes[-1][0] + c["words"], sizes[-1][1] + c["characters"])
                    else:
                        spans.append([c["start"], c["stop"]])
                        sizes.append((c["words"], c["characters"]))
                out.append([s for s, (w, n) in zip(spans, sizes, strict=True) if w >= min_words or n >= MIN_CHARACTERS])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_key"), pa.array(out, pa.list_(pa.list_(pa.int32())))], schema.names
            )

    return lists.mapInArrow(run, schema).where(F.size("spans") > 0)


def with_spans(docs: DataFrame, spans: DataFrame, id_column: str = "doc_id", text: str = "text", key: str | None = None, name: str = "spans") -> DataFrame:
    """The rows of ``docs`` with their spans in a column ``name`` (null: none)."""
    new = [spare(c, [*docs.columns, name]) for c in ("selenite_id", "selenite_key", "selenite_own")]
    spans = spans.select(F.col("id").alias(new[0]), F.col("text_key").alias(new[1]), F.col("spans").alias(name))
    left = docs.select(*giving_way(docs.columns, name)).withColumn(new[2], F.col(key) if key else text_key(text))
    on = left[id_column].eqNullSafe(spans[new[0]]) & (left[new[2]] == spans[new[1]])
    return left.join(spans, on, "left").drop(*new)


def remove_spans(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated spans cut out of ``text``; the columns stay as they are."""
    names = docs.columns
    own = spare("selenite_spans", names)
    joined = with_spans(docs, duplicate_spans(docs, id_column, text, min_words), id_column, text, name=own)
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = concat_column(batch.column(text)).cast(pa.binary()).to_pylist()
            for i, spans in enumerate(batch.column(own).to_pylist()):
                if spans and raw[i] is not None:
                    edges = [0, *(x for s in spans for x in s), len(raw[i])]
                    raw[i] = b"".join(raw[i][a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            columns = [batch.column(c) for c in names]
            columns[place] = pa.array(raw, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)
        release()

    return joined.mapInArrow(run, docs.schema)
