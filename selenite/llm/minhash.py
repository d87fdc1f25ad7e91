"""Links between texts whose sets of five-word shingles are alike (Jaccard).

Candidates share one of ``BANDS`` keys, each made of ``ROWS`` min-hashes of the
shingles; a pair at similarity 0.8 shares none with a chance of 0.0004, a more alike
one with less. Every link is verified on the whole sets (64-bit hashes of the
shingles). Texts that are linked already (``root``) are not compared again.

Defined results: equal texts are one; texts without words have no keys and no
links; an empty table gives no links. A text of fewer words is one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from selenite.llm.common import components, materialize, release, slices, text_bytes, text_key, whole_groups

WORDS = 5
BANDS, ROWS = 20, 5
SLICE_BYTES = 4_000_000
STEP = 5_000
#: Shingles whose sets a task compares at a time, about.
PART_SHINGLES = 400_000
_rng = np.random.default_rng(20_240_608)
#: Drawn from the seed: odd factors and offsets of the min-hashes.
FACTOR = _rng.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSET = _rng.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)


def shingles(text: bytes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(WORDS, len(tokens))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.unique(np.array([digest(joined[a:b]) for a, b in spans], np.uint64))


def band_keys(found: np.ndarray) -> list[int]:
    """One key a band of a set's min-hashes; none of an empty set."""
    if not len(found):
        return []
    low = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(found), STEP):
        low = np.minimum(low, (FACTOR * found[None, at : at + STEP] + OFFSET).min(1))
    rows = low.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(r.tobytes(), i) - (1 << 63) for i, r in enumerate(rows)]


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """(text_key, n, keys): the number of shingles and the band keys of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "selenite_text", SLICE_BYTES):
            found = [shingles(t) for t in text_bytes(batch.column("selenite_text"))]
            sizes, keys = pa.array([len(x) for x in found], pa.int64()), pa.array(list(map(band_keys, found)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), sizes, keys], ["text_key", "n", "keys"])
        release()

    return docs.select(text_key(text).alias("text_key"), F.col(text).alias("selenite_text")).mapInArrow(run, "text_key long, n long, keys array<long>")


def forest(roots: np.ndarray, sets: list[np.ndarray], jaccard: float) -> list[tuple[int, int]]:
    """Pairs of roots that join all of a group's alike texts."""
    sizes = np.array([len(s) for s in sets])
    unseen, edges = np.ones(len(sets), bool), []
    while unseen.any():
        queue = [int(np.flatnonzero(unseen)[0])]
        unseen[queue[0]] = False
        while queue:
            j = queue.pop()
            same = np.flatnonzero(unseen & (roots == roots[j]))
            unseen[same] = False
            queue += same.tolist()
            # sets whose sizes alone rule the similarity out are not looked at
            rest = np.flatnonzero(unseen & (np.minimum(sizes, sizes[j]) >= jaccard * np.maximum(sizes, sizes[j]) - 1e-9))
            for i in rest.tolist():
                at = np.minimum(np.searchsorted(sets[j], sets[i]), sizes[j] - 1)
                both = int((sets[j][at] == sets[i]).sum())
                if both >= jaccard * (sizes[i] + sizes[j] - both) - 1e-9:
                    unseen[i] = False
                    queue.append(i)
                    edges.append((int(roots[j]), int(roots[i])))
    return edges


def shingle_sets(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """(text_key, set): the sets of the texts in ``wanted``, in the shared folder."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "selenite_text", SLICE_BYTES):
            found = [shingles(t).tobytes() for t in text_bytes(batch.column("selenite_text"))]
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(found, pa.binary())], ["text_key", "set"])
        release()

    own = docs.select(text_key(text).alias("text_key"), F.col(text).alias("selenite_text")).join(wanted, "text_key", "left_semi")
    return materialize(own.dropDuplicates(["text_key"]).mapInArrow(sets, "text_key long, set binary"))


def compared(rows: DataFrame, group: list[str], jaccard: float) -> DataFrame:
    """Edges (u, v) between the roots of alike texts of a group; ``rows`` hold ``root`` and ``set``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, group):
            columns, root = [table.column(c).to_numpy() for c in group], table.column("root").to_numpy()
            found = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
            changed = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), len(root)]
            edges = [e for a, b in zip(cuts[:-1], cuts[1:], strict=True) for e in forest(root[a:b], found[a:b], jaccard)]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["u", "v"])
        release()

    rows = rows.select(*group, "root", "set").repartition(*group).sortWithinPartitions(*group)
    return materialize(rows.mapInArrow(compare, "u long, v long").distinct())


def links(docs: DataFrame, roots: DataFrame, jaccard: float, text: str = "text") -> DataFrame:
    """Edges (u, v) of roots that hold texts at ``jaccard`` or more. ``roots``: distinct (text_key, root).

    Keys whose texts have one root end here; equal groups of several keys are compared once,
    and only the texts of such groups are read for their sets. A group is dealt by hash into
    parts of about ``PART_SHINGLES``, each with the group's least text, and compared within
    them. Where that leaves a group of several parts with several components, every text
    outside its largest component is compared with all of the group, again in parts.
    """
    rows = materialize(keyed(docs, text).select("text_key", "n", F.explode("keys").alias("key")).distinct().join(roots, "text_key"))
    groups = rows.groupBy("key").agg(
        F.count("*").alias("members"), F.sum(F.xxhash64("text_key").cast("decimal(38,0)")).alias("sign"), F.sum("n").alias("shingles"),
        F.min("text_key").alias("lead"), F.min("root").alias("lo"), F.max("root").alias("hi"),
    )
    parts = F.ceil(F.col("shingles") / PART_SHINGLES).cast("int")
    groups = groups.where("lo <> hi").groupBy("members", "sign", "lead").agg(F.min("key").alias("key"), F.max(parts).alias("parts"))
    groups = materialize(groups.select("key", "lead", "parts"))
    members = materialize(rows.join(groups, "key").withColumn("part", F.pmod(F.xxhash64("text_key"), F.col("parts")).cast("int")))
    sets = shingle_sets(docs, members.select("text_key").distinct(), text)
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = members.withColumn("part", F.explode(F.when(F.col("text_key") == F.col("lead"), every("parts")).otherwise(F.array("part"))))
    edges = compared(dealt.join(sets, "text_key"), ["key", "part"], jaccard)
    large = members.where("parts > 1")
    if large.isEmpty():
        return edges
    now = components(edges)
    large = large.join(now.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").withColumn("root", F.coalesce("to", "root"))
    large = materialize(large.select("key", "text_key", "n", "part", "parts", "root"))
    sizes = large.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "root"))["root"].alias("major"))
    minor = large.join(sizes, "key").where("root <> major")
    counts = minor.groupBy("key").agg(F.ceil(F.sum("n") / PART_SHINGLES).cast("int").alias("blocks"))
    left = minor.join(counts, "key").withColumn("block", F.pmod(F.xxhash64("text_key"), F.col("blocks")).cast("int")).withColumn("part", F.explode(every("parts")))
    right = large.join(counts, "key").withColumn("block", F.explode(every("blocks")))
    both = left.select("key", "block", "part", "text_key", "root").unionByName(right.select("key", "block", "part", "text_key", "root")).distinct()
    return edges.unionByName(compared(both.join(sets, "text_key"), ["key", "block", "part"], jaccard))
