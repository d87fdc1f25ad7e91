"""SimHash near-duplicates through deletion-variant signatures.

Fingerprints that differ in at most ``d`` bits are cut into ``d // 2 + 1``
segments: at least one segment then differs in at most one bit. Each segment is
indexed as it is and once for each of its bits left out. Since so short a key
is shared by chance, the other bits are cut into as many pieces as leave one of
them equal (``d + 1`` beside an equal segment, ``d`` beside one with a bit left
out), and each piece in turn joins the key. Two fingerprints within ``d`` bits so
share a key, and an equality join finds them. Every candidate pair is verified on
the whole fingerprints.

Equal fingerprints are collapsed first, so exact copies cost one signature. A key
that many fingerprints share is cut into blocks, each pair of blocks is compared
in its own group, and only a spanning forest of the links found there is
emitted: links grow with the rows, and none between different groups is lost.

Defined results: null texts count as empty; a text without words has fingerprint
zero and links like any other; ids may be null, repeated or tied (a component's
id is its least non-null id); equal rows get equal results; a column of the
input with a result's name gives way to it; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selenite.llm import minhash
from selenite.llm.common import components, giving_way, materialize, release, slices, spare, text_bytes, text_key, whole_groups

SLICE_BYTES = 4_000_000
#: A key with more fingerprints is cut into blocks of about as many.
BLOCK = 1024
BITS = 64


def fingerprint(text: bytes, words: int) -> bytes:
    """64 bits, most significant first: the majority over the shingles' XXH64 (seed 42)."""
    tokens = text.lower().split()
    if not tokens:
        return bytes(8)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(tokens))
    digest = xxhash.xxh64_digest
    spans = zip(starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in spans]), np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 100_000):
        ones += np.unpackbits(hashes[at : at + 100_000], axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] = (), words: int = 4) -> DataFrame:
    """Columns ``keep``, then ``fingerprint`` (64 bits as a signed long)."""
    keep = giving_way(keep, "fingerprint")
    own = spare("selenite_text", keep)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, own, SLICE_BYTES):
            raw = b"".join(fingerprint(t, words) for t in text_bytes(batch.column(own)))
            marks = np.frombuffer(raw, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(marks)], schema.names)
        release()

    return docs.select(*keep, F.col(text).alias(own)).mapInArrow(run, schema)


def key_table(distance: int) -> list[tuple[int, ...]]:
    """One row for each key of a fingerprint: a segment, whole or without one of its bits, and a piece of the other bits.

    (low, mask, gap, piece, piece_mask, piece_bits, tag): the fingerprint is turned so
    that the segment's ``low`` bit comes first; ``gap`` is the bit left out, or -1.
    """
    segments = distance // 2 + 1
    cuts = [BITS * i // segments for i in range(segments + 1)]
    rows: list[tuple[int, ...]] = []
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        width = high - low
        for gap in range(-1, width):
            n = max(1, distance + 1 if gap < 0 else distance)
            ends = [width + (BITS - width) * i // n for i in range(n + 1)]
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                rows.append((low, (1 << width) - 1, gap, a, (1 << (b - a)) - 1, b - a, len(rows) << 44))
    return rows


def variant_keys(marks: DataFrame, distance: int) -> DataFrame:
    """(mark, key): each fingerprint with each of its keys."""
    names = ["low", "mask", "gap", "piece", "piece_mask", "piece_bits", "tag"]
    long = {"mask", "piece_mask", "tag"}
    table = F.array(
        *(F.struct(*(F.lit(v).cast("long" if n in long else "int").alias(n) for n, v in zip(names, r, strict=True))) for r in key_table(distance))
    )
    turned = marks.select("mark", F.inline(table)).withColumn("t", F.expr("shiftleft(mark, 64 - low) | shiftrightunsigned(mark, low)"))
    part = turned.withColumn("p", F.expr("t & mask"))
    whole = "if(gap < 0, p, shiftleft(shiftright(p, gap + 1), gap) | (p & (shiftleft(1L, gap) - 1)))"
    return part.select("mark", F.expr(f"tag | shiftleft({whole}, piece_bits) | (shiftrightunsigned(t, piece) & piece_mask)").alias("key"))


def forest(marks: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links between a group's fingerprints, as two lists of places."""
    near = np.bitwise_count(marks[:, None] ^ marks[None, :]) <= distance
    left, right, unseen = [], [], np.ones(len(marks), bool)
    for i in range(len(marks)):
        if not unseen[i]:
            continue
        unseen[i] = False
        queue = [i]
        while queue:
            j = queue.pop()
            more = np.flatnonzero(near[j] & unseen)
            unseen[more] = False
            left += [j] * len(more)
            right += more.tolist()
            queue += more.tolist()
    return left, right


def group_edges(key: np.ndarray, found: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of all groups of equal keys in sorted arrays: pairs at once, larger groups by their forests."""
    starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    sizes = np.diff(np.concatenate([starts, [len(found)]]))
    two = starts[sizes == 2]
    two = two[np.bitwise_count(found[two] ^ found[two + 1]) <= distance]
    left, right = [found[two]], [found[two + 1]]
    for at, size in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
        own = found[at : at + size]
        i, j = forest(own, distance)
        left.append(own[i])
        right.append(own[j])
    return np.concatenate(left), np.concatenate(right)


def links(marks: DataFrame, distance: int, mark: str = "fingerprint") -> DataFrame:
    """Edges (u, v) that connect exactly the distinct fingerprints linked at ``distance`` bits or fewer.

    The keys are exchanged once and compared in sorted partitions. A group of more than
    ``BLOCK`` fingerprints is not held there: its rows go on in blocks, and every pair
    of its blocks is compared in a group of its own.
    """
    parts = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = materialize(marks.select(F.col(mark).alias("mark")).distinct()).repartition(parts)
    rows = variant_keys(keys, distance).repartition("key").sortWithinPartitions("key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(u=(), v=(), key=(), block=(), mark=()) -> pa.RecordBatch:
            n, m = len(u), len(key)
            pad = lambda x, before, after: pa.concat_arrays([pa.nulls(before, pa.int64()), pa.array(x, pa.int64()), pa.nulls(after, pa.int64())])
            columns = [pad(np.asarray(x).view(np.int64) if len(x) else [], 0, m) for x in (u, v)]
            columns += [pad(x, n, 0) for x in (key, block, mark)]
            return pa.RecordBatch.from_arrays(columns, ["u", "v", "key", "block", "mark"])

        key, found, block = np.zeros(0, np.int64), np.zeros(0, np.int64), 0  # the open group's rows; blocks it has given away
        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy()])
            found = np.concatenate([found, batch.column("mark").to_numpy()])
            while len(key):
                if block:  # a large group is open
                    n = int(np.searchsorted(key, key[0], side="right"))
                    ends = n < len(key)
                    if not ends and n < BLOCK:
                        break
                    take = min(n, BLOCK)
                    yield out(key=key[:take], block=np.full(take, block), mark=found[:take])
                    block = 0 if ends and take == n else block + 1
                    key, found = key[take:], found[take:]
                    continue
                last = int(np.searchsorted(key, key[-1], side="left"))
                starts = np.concatenate([[0], np.flatnonzero(key[1:last] != key[: last - 1]) + 1]) if last else np.zeros(0, np.int64)
                sizes = np.diff(np.append(starts, last))
                large = starts[sizes > BLOCK]
                stop = int(large[0]) if len(large) else last
                if stop:
                    u, v = group_edges(key[:stop], found[:stop].view(np.uint64), distance)
                    if len(u):
                        yield out(u, v)
                    key, found = key[stop:], found[stop:]
                if len(large) or len(key) > BLOCK:
                    yield out(key=key[:BLOCK], block=np.zeros(BLOCK, np.int64), mark=found[:BLOCK])
                    key, found, block = key[BLOCK:], found[BLOCK:], 1
                    continue
                break
        if len(key):
            if block:
                yield out(key=key, block=np.full(len(key), block), mark=found)
            else:
                u, v = group_edges(key, found.view(np.uint64), distance)
                if len(u):
                    yield out(u, v)
        release()

    first = materialize(rows.mapInArrow(compare, "u long, v long, key long, block long, mark long"))
    large = first.where("key is not null").select("key", "block", "mark")
    blocks = large.groupBy("key").agg(F.max("block").alias("last"))
    paired = large.join(blocks, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    paired = paired.select("key", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "mark")
    group = ["key", "a", "b"]

    def compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, group):
            columns = [table.column(c).to_numpy() for c in group]
            number = np.zeros(table.num_rows, np.int64)
            for c in columns:
                number[1:] |= c[1:] != c[:-1]
            u, v = group_edges(np.cumsum(number), table.column("mark").to_numpy().view(np.uint64), distance)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (u, v)], ["u", "v"])
        release()

    more = paired.repartition(*group).sortWithinPartitions(*group).mapInArrow(compare_blocks, "u long, v long")
    return first.where("u is not null").select("u", "v").unionByName(more).distinct()


def near_duplicates(marks: DataFrame, id_column: str, distance: int = 4, mark: str = "fingerprint") -> DataFrame:
    """The rows of ``marks`` with ``component_id``, the least id reachable by links."""
    own = marks.groupBy(F.col(mark).alias("mark")).agg(F.min(id_column).alias("least"))
    root = components(links(marks, distance, mark)).select(F.col("node").alias("mark"), "root")
    own = own.join(root, "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    least = own.groupBy("root").agg(F.min("least").alias("component_id"))
    name = spare("selenite_mark", marks.columns)
    found = own.select(F.col("mark").alias(name), "root").join(least, "root").select(name, "component_id")
    rows = marks.select(*giving_way(marks.columns, "component_id"))
    return rows.join(found, rows[mark] == found[name]).drop(name)


def keep_first(docs: DataFrame, id_column: str = "doc_id", text: str = "text", distance: int = 4, words: int = 4, jaccard: float | None = None) -> DataFrame:
    """The row of each component with the least id (then text key); the columns stay as they are.

    With ``jaccard``, texts whose sets of five-word shingles are that much alike are linked too.
    Null ids come last. Of rows with equal id and text one stays.
    """
    named = docs.select(F.col(id_column).alias("selenite_id"), text_key(text).alias("text_key"), F.col(text).alias("selenite_of"))
    marks = materialize(fingerprints(named, "selenite_of", ["selenite_id", "text_key"], words))
    rank = F.struct(F.col("selenite_id").isNull().alias("none"), F.col("selenite_id").alias("id"), F.col("text_key").alias("key"))
    own = marks.groupBy("fingerprint").agg(F.min(rank).alias("first"))
    root = components(links(marks, distance)).withColumnRenamed("node", "fingerprint")
    own = own.join(root, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    if jaccard is not None:
        own = materialize(own)
        of = marks.select("fingerprint", "text_key").distinct().join(own.select("fingerprint", "root"), "fingerprint").select("text_key", "root")
        wider = components(minhash.links(docs, of, jaccard, text)).select(F.col("node").alias("root"), F.col("root").alias("wider"))
        own = own.join(wider, "root", "left").withColumn("root", F.coalesce("wider", "root")).drop("wider")
    kept = own.groupBy("root").agg(F.min("first").alias("first")).select("first.id", "first.key")
    copies = marks.groupBy("selenite_id", "text_key").agg(F.count("*").alias("copies")).where("copies > 1")
    kept = materialize(
        kept.join(copies, kept["id"].eqNullSafe(copies["selenite_id"]) & (kept["key"] == copies["text_key"]), "left").select("id", "key", "copies")
    )
    own_key = spare("selenite_key", docs.columns)
    left = docs.withColumn(own_key, text_key(text))

    def rows(some: DataFrame) -> DataFrame:
        some = some.select(F.col("id").alias("selenite_id"), F.col("key").alias("selenite_other"))
        on = left[id_column].eqNullSafe(some["selenite_id"]) & (left[own_key] == some["selenite_other"])
        return left.join(some, on, "left_semi")

    repeated = kept.where("copies is not null")
    out = rows(kept.where("copies is null")).drop(own_key)
    if repeated.isEmpty():
        return out
    return out.unionByName(rows(repeated).dropDuplicates([id_column, own_key]).drop(own_key))
