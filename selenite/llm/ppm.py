"""Language-model scores by prediction with partial matching over bytes.

The model is a byte-context trie. Its dense part holds what followed every context of up
to ``ORDER`` bytes in the training texts, start and end included. Its deep part holds
contexts of ``DEEP`` bytes behind a blank (one of ``SPARSE`` of them, by hash); an edge
there is the whole word, or the end, that follows, so a path that occurs once costs one
hashed entry. A text is coded as its words, A-Z lowered, each with one blank after it,
and then an end; a score is the sum of log10 probabilities in double precision.

A word behind a known deep context is predicted there as a whole or escapes to its bytes;
the discount that goes to the escape is estimated from the counts of counts of the deep
entries (Ney: once / (once + 2 twice)). A byte is predicted by its longest dense context;
a context in which it has not been seen passes on its escape probability (method D: half
of the distinct symbols), and the next shorter context excludes what the longer ones have
ruled out. Below the longest order a symbol counts once for each longer context that holds
it (update exclusion). The last resort is uniform over the bytes never seen at all.

Texts are packed into blocks of about ``BLOCK_BYTES`` in the shared folder. A block sorts
its distinct grams, deep entries and words into buckets by hash and sends each bucket one
packed row; buckets sum the counts of all blocks, and send each block one row back, in the
block's own order. Buckets grow in number with the text, so no task holds the whole model.
Dense contexts are nested, so predictions need sums over a context and its suffix alone:
grams with the same last three context bytes are worked out together, and only sums for
contexts of two bytes or fewer, at most 2**16 rows, are handed to all tasks.

The base score is a unigram model over words with additive smoothing; its counts
come and go the same way.

Defined results: null texts count as empty (their end is still coded); training rows
are those whose id's checksum is not 0 modulo ``FOLDS``, null ids included; repeated
rows are learned from and scored each; texts of any length are scored whole; other
columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selenite.llm.common import concat_column, materialize, release, slices, text_bytes

ORDER = 5
DEEP = 16
SPARSE = 1
FOLDS = 10
BLOCK_BYTES = 20_000_000
#: Text for each bucket, about; a key's bucket takes 16 bits, so there are 65,536 at most.
BUCKET_BYTES = 32_000_000
LEAST_BUCKETS, MOST_BUCKETS = 16, 1 << 16
PIECE_BYTES = 2_000_000
#: Bytes that no UTF-8 text holds mark the start and the end; the start is never predicted.
START, END = b"\xff" * ORDER, b"\xfe"
SYMBOLS = 255
SMOOTHING = 0.1
TABLE_BITS = 22
#: Grams that a task works out at a time, about.
GROUP_GRAMS = 200_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)
LOW48 = np.uint64((1 << 48) - 1)
DOC, GRAM, ENTRY, WORD = range(4)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(texts: list[bytes]) -> np.ndarray:
    """The grams that end in each byte (and the end) of coded texts."""
    data = np.frombuffer(b"".join(START + t + END for t in texts), np.uint8)
    code = np.zeros(len(data), np.int64)
    for back in range(ORDER + 1):
        code[ORDER:] |= data[ORDER - back : len(data) - back].astype(np.int64) << (8 * back)
    return code[data != 0xFF]


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words and ends of coded texts.

    (offset of each among all bytes, each text's first, their hashes, numbers of those with
    a deep context, hashes of these contexts).
    """
    data = np.frombuffer(b"".join(t + END for t in texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begin = np.cumsum(sizes) - sizes
    starts = np.flatnonzero(np.concatenate([[True], (data[:-1] == 0x20) | (data[:-1] == 0xFE)]))
    first = np.searchsorted(starts, begin)
    # a word's polynomial is a difference of running sums, divided by the power at its start
    inverse = np.uint64(pow(int(FACTOR), -1, 1 << 64))
    up, down = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data) - 1, f)])) for f in (FACTOR, inverse))
    up *= data.astype(np.uint64) + np.uint64(1)
    word = mixed(np.add.reduceat(up, starts) * down[starts])
    del up, down
    inside = starts - np.repeat(begin, np.diff(np.append(first, len(starts))))
    at = np.flatnonzero(inside >= DEEP)
    if not len(at):
        return starts, first, word, at, np.zeros(0, np.uint64)
    windows = np.lib.stride_tricks.sliding_window_view(data, DEEP)[starts[at] - DEEP]
    halves = np.ascontiguousarray(windows).view("<u8")
    context = mixed(halves[:, 0] * FACTOR + mixed(halves[:, 1] + FACTOR))
    if SPARSE > 1:
        chosen = (context >> np.uint64(1)) % np.uint64(SPARSE) == 0
        at, context = at[chosen], context[chosen]
    return starts, first, word, at, context


def placed(context: np.ndarray, word: np.ndarray, buckets: int) -> np.ndarray:
    """Deep entries as sort keys: bucket in the top 16 bits, then 32 bits of the context, 16 of the symbol."""
    bucket = ((context >> np.uint64(8)) & np.uint64(0xFFFFFF)) % np.uint64(buckets)
    return (bucket << np.uint64(48)) | ((context >> np.uint64(32)) << np.uint64(16)) | (word >> np.uint64(48))


def placed_words(word: np.ndarray, buckets: int) -> np.ndarray:
    """Words as sort keys: bucket in the top 16 bits, then 48 bits of the hash."""
    return ((word & np.uint64(0xFFFFFF)) % np.uint64(buckets) << np.uint64(48)) | (word >> np.uint64(16))


def placed_grams(key: np.ndarray, buckets: int) -> np.ndarray:
    key = key.astype(np.uint64)
    return ((mixed(key + FACTOR) >> np.uint64(8)) % np.uint64(buckets) << np.uint64(48)) | key


def coded(text: bytes) -> bytes:
    """A-Z lowered, each word with one blank after it."""
    words = text.lower().split()
    return b" ".join([*words, b""]) if words else b""


def pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about PIECE_BYTES."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > PIECE_BYTES:
            yield first, i
            first, size = i, 0
        size += len(t) + ORDER + 1
    if first < len(texts):
        yield first, len(texts)


def counted(texts: list[bytes], train: list[bool], keys) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``keys`` of a block, ascending, and their counts in training texts (0 where only others hold them)."""
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for a, b in pieces(texts):
        for learn in (True, False):
            chosen = [t for t, x in zip(texts[a:b], train[a:b], strict=True) if x is learn]
            if chosen:
                k, n = np.unique(keys(chosen), return_counts=True)
                found.append((k, n if learn else np.zeros(len(k), np.int64)))
    return summed(*map(np.concatenate, zip(*found, strict=True)))


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(n, first) if len(first) else n[:0]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 8-byte numbers of one length, byte by byte of their places, compressed."""
    n = len(arrays[0])
    planes = b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(n, 8).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(n.to_bytes(8, "little") + planes)


def unpack(raw: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(raw, np.uint8, offset=8).reshape(len(kinds), 8, n)
    return [np.ascontiguousarray(p.T).view(k).reshape(n) for p, k in zip(planes, kinds, strict=True)]


def steps(key: np.ndarray) -> np.ndarray:
    return np.diff(key, prepend=key.dtype.type(0))


def sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(group, weights=values, minlength=n)


def predictions(key: np.ndarray, count: np.ndarray, after_two: np.ndarray, short: dict[str, np.ndarray]) -> np.ndarray:
    """log10 probability of each gram's last byte after its context.

    ``key``: all grams of some last three context bytes, ``count``: theirs in
    training, ``after_two``: counts of the last byte after two bytes. ``short``: for
    contexts of two bytes the sum, kinds and what they rule out of the shorter
    context (``n2``, ``d2``, ``x1``), counts after one byte (``one``). All counts of shorter
    contexts are numbers of longer contexts.
    """
    two, symbol = (key >> 8) & 0xFFFF, key & 255
    last, one = two & 255, short["one"]
    zero = (one > 0).sum(0)
    count = count.astype(np.float64)
    # per order: the contexts, and the (context, symbol) pairs one order below the longest
    c5, c4, c3 = (np.unique((key >> 8) & m, return_inverse=True)[1] for m in (0xFFFFFFFFFF, 0xFFFFFFFF, 0xFFFFFF))
    n5, n4, n3 = c5.max() + 1, c4.max() + 1, c3.max() + 1
    (_, first4, p4), (_, first3, p3) = (
        np.unique(key & m, return_index=True, return_inverse=True) for m in (0xFFFFFFFFFF, 0xFFFFFFFF)
    )
    seen5 = count > 0
    k4 = sums(seen5, p4, len(first4))
    seen4 = k4 > 0
    k3 = sums(seen4, p3[first4], len(first3))
    seen3 = k3 > 0
    own4, own3 = c4[first4], c3[first3]
    total = [
        zero.sum(), one.sum(1)[last], short["n2"][two],
        sums(k3, own3, n3)[c3], sums(k4, own4, n4)[c4], sums(count, c5, n5)[c5],
    ]
    kinds = [
        (zero > 0).sum(), (one > 0).sum(1)[last], short["d2"][two],
        sums(seen3, own3, n3)[c3], sums(seen4, own4, n4)[c4], sums(seen5, c5, n5)[c5],
    ]
    # what the next longer context rules out, in counts of this one
    out = [
        ((one > 0) @ zero)[last], short["x1"][two],
        sums(np.where(seen3, after_two[first3], 0), own3, n3)[c3],
        sums(np.where(seen4, k3[p3[first4]], 0), own4, n4)[c4],
        sums(np.where(seen5, k4[p4], 0), c5, n5)[c5],
        0.0,
    ]
    have = [zero[symbol], one[last, symbol], after_two, k3[p3], k4[p4], count]
    p, done = np.ones(len(key)), np.zeros(len(key), bool)
    for order in range(ORDER, -1, -1):
        n = np.broadcast_to(total[order] - out[order], len(key))
        d = np.broadcast_to(kinds[order] - (kinds[order + 1] if order < ORDER else 0), len(key)).astype(np.float64)
        if order == 0 and kinds[0] >= SYMBOLS:
            d = np.zeros(len(key))
        live = ~done & (n > 0)
        now = live & (have[order] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = (have[order] - (0.5 if d.any() else 0)) / n
            p = np.where(now, p * hit, np.where(live, p * d / (2 * n), p))
        done |= now
    p = np.where(done, p, p / max(1, SYMBOLS - int(kinds[0])))
    return np.log10(p)


class Lookup:
    """Values by gram: one multiplicative probe, a search for the few that collide."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        order = np.argsort(key)
        self.key, self.value = key[order], value[order]
        self.table = np.zeros(1 << TABLE_BITS, np.int32)
        self.table[self.slot(self.key)] = np.arange(len(key), dtype=np.int32)

    @staticmethod
    def slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * FACTOR) >> np.uint64(64 - TABLE_BITS)).astype(np.int32)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        at = self.table[self.slot(key)]
        wrong = np.flatnonzero(self.key[at] != key)
        at[wrong] = np.searchsorted(self.key, key[wrong])
        return self.value[at]


def packed_texts(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(block, ids, train, packed, tokens): the coded texts in blocks, in the shared folder."""
    id_type = docs.schema[id_column].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_type))])
    schema = schema.add("train", T.ArrayType(T.BooleanType())).add("packed", T.BinaryType()).add("tokens", T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        compress = zstandard.ZstdCompressor(level=4).compress
        size = 0
        for batch in slices(batches, "text", PIECE_BYTES):
            n = batch.column("text").nbytes
            if size and size + n > BLOCK_BYTES:
                block, size = block + 1, 0
            size += n
            own, learn = [coded(t) for t in text_bytes(batch.column("text"))], batch.column("train").to_pylist()
            tokens = sum(t.count(b" ") + 1 for t, x in zip(own, learn, strict=True) if x)
            ids = concat_column(batch.column("id"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([learn]),
                    pa.array([compress(b"\n".join(own))], pa.binary()), pa.array([tokens]),
                ],
                schema.names,
            )
        release()

    train = F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % FOLDS != 0, F.lit(True))
    wanted = docs.select(F.col(id_column).alias("id"), train.alias("train"), F.col(text).alias("text"))
    return materialize(wanted.mapInArrow(run, schema))


def unpacked(rows: pa.Table | pa.RecordBatch) -> tuple[list[bytes], list[bool]]:
    """The coded texts of some rows, and which are learned from."""
    decompress = zstandard.ZstdDecompressor().decompress
    texts, train = [], []
    for packed, learn in zip(rows.column("packed").to_pylist(), rows.column("train").to_pylist(), strict=True):
        texts += decompress(packed).split(b"\n") if learn else []
        train += learn
    return texts, train


PARTS = "block long, kind int, bucket int, payload binary"


def parts(texts: DataFrame, kinds: tuple[int, ...], buckets: int) -> DataFrame:
    """One row of packed keys and counts for each block, kind and bucket."""

    def rows(block: int, kind: int, raw: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        for bucket, payload in raw:
            columns = [pa.array([block]), pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([payload], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "kind", "bucket", "payload"])

    def dealt(key: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, bytes]]:
        edges = np.searchsorted(key >> np.uint64(48), np.arange(buckets + 1, dtype=np.uint64))
        for bucket, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            if b > a:
                yield bucket, pack(steps(key[a:b] & LOW48), n[a:b])

    def entries(texts: list[bytes]) -> np.ndarray:
        _, _, word, at, context = symbols(texts)
        return placed(context, word[at], buckets)

    keys = {
        GRAM: lambda x: placed_grams(grams(x), buckets),
        ENTRY: entries,
        WORD: lambda x: placed_words(symbols(x)[2], buckets),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, own in blocks(batches):
            texts, train = unpacked(own)
            for kind in kinds:
                yield from rows(block, kind, dealt(*counted(texts, train, keys[kind])))
            del texts
        release()

    return texts.select("block", "train", "packed").mapInArrow(run, PARTS)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of a block stand together in its partition."""
    held, now = [], None
    for batch in batches:
        ids = batch.column("block").to_pylist()
        start = 0
        for i in range(len(ids) + 1):
            if i == len(ids) or ids[i] != now:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if i < len(ids):
                    if held:
                        yield now, pa.Table.from_batches(held)
                    held, now = [], ids[i]
                start = i
    if held:
        yield now, pa.Table.from_batches(held)


def packed_keys(rows: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The sorted keys and counts of each row of a bucket."""
    found = [unpack(p, np.uint64, np.int64) for p in rows.column("payload").to_pylist()]
    return [np.cumsum(k) for k, _ in found], [n for _, n in found]


def dense(parts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gram, log10p): the predictions for all grams of the corpus, learned from the training counts."""

    def merge(rows: pa.Table) -> pa.Table:
        key, n = summed(*map(np.concatenate, packed_keys(rows)))
        return pa.table({"gram": key.astype(np.int64), "n": n})

    total = materialize(parts.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(merge, "gram long, n long"))
    tail = lambda c, bits: F.col(c).bitwiseAND(F.lit((1 << bits) - 1))
    three = total.where("n > 0").select(tail("gram", 32).alias("g4")).distinct()
    three = materialize(three.groupBy(tail("g4", 24).alias("g3")).agg(F.count("*").alias("k2")))
    two = materialize(three.groupBy(tail("g3", 16).alias("g2")).agg(F.count("*").alias("k1")))
    pairs = three.withColumn("g2", tail("g3", 16)).join(two, "g2")
    pairs = pairs.groupBy(F.shiftright("g3", 8).alias("two")).agg(F.sum("k2").alias("n2"), F.count("*").alias("d2"), F.sum("k1").alias("x1"))
    short = {"one": np.zeros((256, 256))} | {c: np.zeros(1 << 16) for c in ("n2", "d2", "x1")}
    for r in two.collect():  # at most 2**16 rows, like the next
        short["one"][r["g2"] >> 8, r["g2"] & 255] = r["k1"]
    for r in pairs.collect():
        for c in ("n2", "d2", "x1"):
            short[c][r["two"]] = r[c]

    def run(group: pa.Table) -> pa.Table:
        key, count, after_two = (group.column(c).to_numpy() for c in ("gram", "n", "k2"))
        bucket = (placed_grams(key, buckets) >> np.uint64(48)).astype(np.int32)
        return pa.table({"bucket": bucket, "gram": key, "log10p": predictions(key, count, after_two, short)})

    groups = total.count() // GROUP_GRAMS + 1
    context = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFFFF))
    rows = total.withColumn("g3", tail("gram", 24)).join(three, "g3", "left").drop("g3").withColumn("k2", F.coalesce("k2", F.lit(0)))
    return rows.groupBy(F.pmod(F.xxhash64(context), F.lit(groups)).alias("group")).applyInArrow(run, "bucket int, gram long, log10p double")


def answers(rows: pa.Table, payloads: list[bytes]) -> list[pa.Array]:
    return [*(concat_column(rows.column(c)) for c in ("block", "kind", "bucket")), pa.array(payloads, pa.binary())]


def dense_answers(parts: DataFrame, model: DataFrame, buckets: int) -> DataFrame:
    """The predictions for the grams of each block, in the block's order."""

    def run(rows: pa.Table, model: pa.Table) -> pa.Table:
        gram, value = model.column("gram").to_numpy(), model.column("log10p").to_numpy()
        order = np.argsort(gram)
        gram, value = gram[order].astype(np.uint64), value[order]
        return pa.table(answers(rows, [pack(value[np.searchsorted(gram, k)]) for k in packed_keys(rows)[0]]), ["block", "kind", "bucket", "payload"])

    parts, model = (x.repartition(buckets, "bucket").groupBy("bucket") for x in (parts, model))
    return parts.cogroup(model).applyInArrow(run, PARTS)


def count_answers(parts: DataFrame, buckets: int) -> DataFrame:
    """Counts for the words and deep entries of each block, in the block's order.

    With each bucket's first row: the distinct words (and the end) learned from, the entries seen once and twice.
    """

    def words(rows: pa.Table) -> tuple[list[bytes], tuple[int, int, int]]:
        keys, counts = packed_keys(rows)
        key, n = summed(np.concatenate(keys), np.concatenate(counts))
        return [pack(n[np.searchsorted(key, k)]) for k in keys], (int((n > 0).sum()), 0, 0)

    def entries(rows: pa.Table) -> tuple[list[bytes], tuple[int, int, int]]:
        keys, counts = packed_keys(rows)
        key, n = summed(np.concatenate(keys), np.concatenate(counts))
        starts = np.flatnonzero(np.concatenate([[True], key[1:] >> np.uint64(16) != key[:-1] >> np.uint64(16)]))
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
        total, kinds = np.add.reduceat(n, starts)[group], np.add.reduceat((n > 0).astype(np.int64), starts)[group]
        at = [np.searchsorted(key, k) for k in keys]
        return [pack(n[i], total[i], kinds[i]) for i in at], (0, int((n == 1).sum()), int((n == 2).sum()))

    def run(rows: pa.Table) -> pa.Table:
        kind = rows.column("kind")[0].as_py()
        payloads, stats = (words if kind == WORD else entries)(rows)
        extra = [pa.array([s] + [0] * (rows.num_rows - 1), pa.int64()) for s in stats]
        return pa.table([*answers(rows, payloads), *extra], ["block", "kind", "bucket", "payload", "vocabulary", "once", "twice"])

    parts = parts.repartition(2 * buckets, "kind", "bucket")
    return materialize(parts.groupBy("kind", "bucket").applyInArrow(run, PARTS + ", vocabulary long, once long, twice long"))


def score(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row for each row of ``docs``."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, int(size) // BUCKET_BYTES))
    texts = packed_texts(docs, id_column, text)
    counts = count_answers(parts(texts, (ENTRY, WORD), buckets), buckets)
    none = F.lit(0)
    v, once, twice = counts.agg(*(F.coalesce(F.sum(c), none) for c in ("vocabulary", "once", "twice"))).first()
    n, n_blocks = texts.agg(F.coalesce(F.sum("tokens"), none), F.countDistinct("block")).first()
    unit = math.log10(n + SMOOTHING * (v + 1))
    discount = (once + 1) / (once + 2 * twice + 2)
    own_grams = materialize(parts(texts, (GRAM,), buckets))
    given = dense_answers(own_grams, dense(own_grams, buckets), buckets).unionByName(counts.select("block", "kind", "bucket", "payload"))
    schema = T.StructType([T.StructField(id_column, docs.schema[id_column].dataType), T.StructField("held_out", T.BooleanType())])
    schema = schema.add("n_tokens", T.LongType()).add("n_known", T.LongType()).add("train_tokens", T.LongType())
    schema = schema.add("base_score", T.DoubleType()).add("score", T.DoubleType())

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        raw, train = unpacked(own)
        found = found.sort_by("bucket")

        def of(kind: int, *kinds: type) -> list[np.ndarray]:
            rows = [unpack(p, *kinds) for p, k in zip(found.column("payload").to_pylist(), found.column("kind").to_pylist(), strict=True) if k == kind]
            return [np.concatenate([np.zeros(0, t), *c]) for t, c in zip(kinds, zip(*rows, strict=True) if rows else [()] * len(kinds), strict=True)]

        key = counted(raw, train, lambda x: placed_grams(grams(x), buckets))[0]
        ppm = Lookup((key & LOW48).astype(np.int64), of(GRAM, np.float64)[0])
        del key
        found_in = [symbols(raw[a:b]) for a, b in pieces(raw)]
        edges = np.cumsum([0, *(len(x[2]) for x in found_in)])
        deep_edges = np.cumsum([0, *(len(x[3]) for x in found_in)])
        entry = np.unique(np.concatenate([placed(c, word[at], buckets) for _, _, word, at, c in found_in]), return_inverse=True)[1].astype(np.int32)
        of_word = np.unique(np.concatenate([placed_words(x[2], buckets) for x in found_in]), return_inverse=True)[1].astype(np.int32)
        seen, total, kinds = of(ENTRY, np.int64, np.int64, np.int64)
        with np.errstate(divide="ignore", invalid="ignore"):
            deep = np.where(seen > 0, np.log10((seen - discount) / total), np.where(total > 0, np.log10(discount * kinds / total), 0.0))
        c = of(WORD, np.int64)[0]
        logs, known_word = np.log10(c + SMOOTHING) - unit, (c > 0).astype(np.int64)
        tokens, known, base, scores = [], [], [], []
        for i, (a, b) in enumerate(pieces(raw)):
            starts, first, _, at, _ = found_in[i]
            each = np.add.reduceat(ppm(grams(raw[a:b])), starts)
            place = entry[deep_edges[i] : deep_edges[i + 1]]
            each[at] = np.where(seen[place] > 0, 0.0, each[at]) + deep[place]
            scores.append(np.add.reduceat(each, first))
            place = of_word[edges[i] : edges[i + 1]]
            base.append(np.add.reduceat(logs[place], first))
            known.append(np.add.reduceat(known_word[place], first))
            tokens.append(np.diff(np.append(first, len(starts))))
            found_in[i] = None
        ids = concat_column(own.column("ids")).flatten()
        del logs, ppm, raw, entry, of_word
        release()
        tokens, known, base, scores = map(np.concatenate, (tokens, known, base, scores))
        train_tokens = np.full(len(tokens), n, np.int64)
        return pa.table([ids, pa.array([not x for x in train]), *map(pa.array, (tokens, known, train_tokens, base, scores))], schema.names)

    # partitions follow the blocks, twice as many so that few hold two
    texts, given = (x.repartition(2 * n_blocks + 1, "block").groupBy("block") for x in (texts, given))
    return texts.cogroup(given).applyInArrow(run, schema)
