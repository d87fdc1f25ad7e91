"""Document quality from a linear-chain conditional random field over lines.

Every line of a text is a step of a chain with the states bad and good. A
step's score is linear in features of the line and of its neighbours; pairs of
neighbouring states, the first and the last state have weights of their own.
The chain is trained on documents whose lines all carry the document's label. A
document's quality is the mean of its lines' forward-backward marginals, weighted
by length, put on the scale of probabilities by a logistic fit.

Defined results: a null or empty text is one empty line and gets a score; texts of
any length are read whole; repeated rows get equal scores; labels that are null
are not learned from; other columns are never inputs. Without any label of either
kind every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from selenite.llm.common import giving_way, release, slices, spare, text_bytes

#: Most documents that are learned from; a stable hash of the id picks them.
TRAIN_DOCS = 4_000
TRAIN_SLICE = 1_000_000
STEPS = 150
RIDGE = 1e-3
SLICE_BYTES = 1_500_000

UPPER, LOWER, DIGIT, BLANK, STOP, BANG, SYMBOL, OTHER = range(8)
CLASS = np.full(256, OTHER, np.uint8)
for kind, members in (
    (UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (LOWER, b"abcdefghijklmnopqrstuvwxyz"),
    (DIGIT, b"0123456789"),
    (BLANK, b" \t\r\x0b\x0c\n"),
    (STOP, b".,;:'\"()-"),
    (BANG, b"!?"),
    (SYMBOL, b"#$%&*|<>{}[]=+_/\\@^~`"),
):
    CLASS[list(members)] = kind
MIX = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def own_features(lines: list[bytes]) -> np.ndarray:
    """A row of numbers for each line, from its bytes and words alone."""
    n = len(lines)
    data = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    sizes = np.fromiter(map(len, lines), np.int64, n)
    begin = np.cumsum(sizes + 1) - sizes - 1
    kinds = CLASS[data]
    shares = np.stack([np.add.reduceat((kinds == k).astype(np.int32), begin) for k in range(8)], 1).astype(np.float64)
    shares[:, BLANK] -= 1  # the line's end
    shares /= np.maximum(sizes, 1)[:, None]

    blank = kinds == BLANK
    edge = np.flatnonzero(np.diff(blank.astype(np.int8), prepend=np.int8(1)))
    first, stop = edge[::2], edge[1::2]  # words; the last byte is always blank
    line = np.searchsorted(begin, first, side="right") - 1
    size = (stop - first).astype(np.float64)
    per_line = lambda x: np.bincount(line, weights=x, minlength=n)
    words = per_line(np.ones(len(first)))
    upper = np.cumsum(kinds == UPPER)
    uppers = upper[stop - 1] - upper[first] + (kinds[first] == UPPER) if len(first) else np.zeros(0)
    tail, head = kinds[stop - 1], kinds[first]
    # a word's mark: the sum of its bytes' numbers, each by its place, so that equal words agree
    word = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(data))))
    data_in = data[first[0] :] if len(first) else data[:0]
    place = (np.arange(len(data) - len(data_in), len(data)) - first[word] + 1).astype(np.uint64) if len(first) else word
    blanked = np.where(blank[len(data) - len(data_in) :], np.uint64(0), MIX[data_in] * place)
    mark = np.add.reduceat(blanked, first - first[0]) if len(first) else np.zeros(0, np.uint64)
    same = np.zeros(len(first))
    same[1:] = (mark[1:] == mark[:-1]) & (line[1:] == line[:-1])
    count = np.maximum(words, 1)
    ends = np.zeros(n)
    starts = np.zeros(n)
    if len(first):
        at_last = np.flatnonzero(np.append(line[1:] != line[:-1], True))
        ends[line[at_last]] = np.isin(data[stop[at_last] - 1], list(b".!?"))
        at_first = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        starts[line[at_first]] = head[at_first] == UPPER
    return np.column_stack(
        [
            np.log1p(words) / 4,
            np.log1p(sizes) / 6,
            np.minimum(per_line(size) / count / 10, 3),
            shares * 3,
            per_line((uppers == size) & (size > 1)) / count,
            per_line(tail == BANG) / count,
            per_line(tail == SYMBOL) / count,
            per_line((size == 1) & (head == SYMBOL)) / count,
            per_line(tail == STOP) / count * 3,
            same_share := per_line(same) / count,
            same_share > 0.2,
            per_line(size <= 3) / count,
            per_line(size >= 12) / count,
            ends,
            starts,
            words < 4,
            words == 0,
        ]
    )


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, offsets of the texts, weights): each line's own features and its neighbours'."""
    per_text = [t.split(b"\n") for t in texts]
    at = np.cumsum([0, *map(len, per_text)])
    lines = [x for p in per_text for x in p]
    own = own_features(lines)
    repeat = np.zeros(len(lines))
    repeat[1:] = [len(a) > 20 and a == b for a, b in zip(lines[1:], lines[:-1], strict=True)]
    own = np.column_stack([own, repeat])
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[at[:-1]], after[at[1:] - 1] = 0, 0
    weights = np.maximum(np.fromiter(map(len, lines), np.float64, len(lines)), 1)
    return np.column_stack([own, before, after, np.ones(len(own))]), at, weights


def sliced_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As features, in single precision and a slice of the texts at a time."""
    parts, first, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > TRAIN_SLICE:
            parts.append(features(texts[first:i]))
            parts[-1] = (parts[-1][0].astype(np.float32), *parts[-1][1:])
            first, size = i, 0
        size += len(t) + 1
    rows, at, weights = features(texts[first:])
    parts.append((rows.astype(np.float32), at, weights))
    counts = np.concatenate([np.diff(p[1]) for p in parts])
    return np.concatenate([p[0] for p in parts]), np.concatenate([[0], np.cumsum(counts)]), np.concatenate([p[2] for p in parts])


def marginals(emission: np.ndarray, at: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every step, and the expected counts of (first good, last good, 4 pairs).

    ``chain``: weights of a good first state, a good last state and of the pairs
    bad-bad, bad-good, good-bad, good-good. All texts take a step at once.
    """
    sizes = np.diff(at)
    order = np.argsort(-sizes, kind="stable")
    start, sizes = at[:-1][order], sizes[order]
    longest = int(sizes[0]) if len(sizes) else 0
    pair = chain[2:].reshape(2, 2)
    score = np.zeros((len(emission), 2))
    score[:, 1] = emission
    score[at[:-1], 1] += chain[0]
    score[at[1:] - 1, 1] += chain[1]
    forward, backward = score.copy(), np.zeros_like(score)
    live = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(longest)]
    for t in range(1, longest):
        i = start[: live[t]] + t
        a = forward[i - 1]
        forward[i] += np.logaddexp(a[:, :1] + pair[0], a[:, 1:] + pair[1])
    for t in range(longest - 1, 0, -1):
        i = start[: live[t]] + t
        b = score[i] + backward[i]
        backward[i - 1] = np.logaddexp(b[:, :1] + pair[:, 0], b[:, 1:] + pair[:, 1])
    both = forward + backward
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    inner = np.ones(len(emission), bool)
    inner[at[:-1]] = False
    j = np.flatnonzero(inner)
    total = np.logaddexp(both[:, 0], both[:, 1])[j]
    counts = [good[at[:-1]].sum(), good[at[1:] - 1].sum()]
    for x in (0, 1):
        for y in (0, 1):
            counts.append(np.exp(forward[j - 1, x] + pair[x, y] + score[j, y] + backward[j, y] - total).sum())
    return good, np.array(counts)


def mean_good(good: np.ndarray, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.add.reduceat(good * weights, at[:-1]) / np.add.reduceat(weights, at[:-1])


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def train(texts: list[bytes], labels: np.ndarray) -> dict:
    """Maximum likelihood with a ridge, by Adam over the whole sample; then the logistic fit."""
    if not len(labels) or labels.min() == labels.max():
        return {"constant": float(labels.mean()) if len(labels) else 0.5}
    rows, at, weights = sliced_features(texts)
    mean, spread = rows.mean(0, dtype=np.float64), rows.std(0, dtype=np.float64)
    mean[-1], spread[-1] = 0, 1
    spread[spread == 0] = 1
    rows -= mean.astype(np.float32)
    rows /= spread.astype(np.float32)
    sizes = np.diff(at)
    y = np.repeat(labels.astype(np.float64), sizes)
    seen = np.array([labels.sum(), labels.sum(), ((1 - labels) * (sizes - 1)).sum(), 0, 0, (labels * (sizes - 1)).sum()], float)
    w, c = np.zeros(rows.shape[1]), np.zeros(6)
    state = [np.zeros(len(w) + 6), np.zeros(len(w) + 6)]
    for step in range(1, STEPS + 1):
        good, counts = marginals(rows @ w.astype(np.float32), at, c)
        up = np.concatenate([rows.T @ (y - good).astype(np.float32), seen - counts]) / len(labels)
        up -= RIDGE * np.concatenate([w, c])
        state[0] = 0.9 * state[0] + 0.1 * up
        state[1] = 0.99 * state[1] + 0.01 * up**2
        move = 0.1 * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w, c = w + move[: len(w)], c + move[len(w) :]
    good, _ = marginals(rows @ w.astype(np.float32), at, c)
    x = logit(mean_good(good, at, weights)) / 4
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-(a * x + b)))
        g = np.array([((labels - p) * x).sum() - a * 0.5, (labels - p).sum() - b * 0.01])
        v = p * (1 - p)
        h = np.array([[(v * x * x).sum() + 0.5, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
        a, b = np.array([a, b]) + np.clip(np.linalg.solve(h, g), -1, 1)
    return {"w": w / spread, "shift": float(-(mean / spread) @ w), "chain": c, "scale": (float(a) / 4, float(b))}


def line_marginals(texts: list[bytes], model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P(good) of each line, offsets of the texts, line weights)."""
    rows, at, weights = features(texts)
    return marginals(rows @ model["w"] + model["shift"], at, model["chain"])[0], at, weights


def scores(texts: list[bytes], model: dict) -> np.ndarray:
    if "constant" in model:
        return np.full(len(texts), model["constant"])
    good, at, weights = line_marginals(texts, model)
    a, b = model["scale"]
    return 1 / (1 + np.exp(-(a * logit(mean_good(good, at, weights)) + b)))


def held_out(id_column: str = "doc_id", folds: int = 5) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "quality", train_docs: int = TRAIN_DOCS) -> dict:
    """Learn from at most ``train_docs`` labelled documents outside the held-out fold."""
    known = labels.where(F.col(label).isNotNull()).groupBy(id_column).agg(F.max(label).alias("label"))
    known = known.where(~held_out(id_column)).orderBy(F.xxhash64(id_column), id_column).limit(train_docs)
    rows = docs.select(id_column, F.col(text).alias("text")).join(F.broadcast(known), id_column)
    rows = rows.orderBy(F.xxhash64(id_column), F.xxhash64("text")).limit(train_docs).collect()
    texts = [(r["text"] or "").encode() for r in rows]
    return train(texts, np.array([int(r["label"] > 0) for r in rows]))


def score(docs: DataFrame, model: dict, text: str = "text", keep: list[str] = ()) -> DataFrame:
    """Columns ``keep``, then ``score``, the probability of label 1."""
    keep = giving_way(keep, "score")
    own = spare("selenite_text", keep)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, own, SLICE_BYTES):
            found = scores(text_bytes(batch.column(own)), model)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found)], schema.names)
        release()

    return docs.select(*keep, F.col(text).alias(own)).mapInArrow(run, schema)


def filter_good(docs: DataFrame, model: dict, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``; the columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE_BYTES):
            yield batch.filter(pa.array(scores(text_bytes(batch.column(text)), model) >= threshold))
        release()

    return docs.mapInArrow(run, docs.schema)
