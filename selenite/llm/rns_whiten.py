"""Whitening of vectors from an exact scatter matrix in residue numbers.

Entries become integers x = floor(256 c). The fit list holds each distinct x vector
once. Every partition multiplies its part of the list, with a column of ones, by
itself modulo several primes: residues are centred and blocks bounded, so each
product of matrices is exact in doubles. The residues are added up, and the
Chinese remainder theorem gives n, the sums S and the sums of products G as exact
integers, however large. n G - S S' is n squared times the covariance, without
rounding; it is divided once, and its eigenvectors are taken in doubles.

What comes to the driver is one matrix a prime; the number of primes follows from
the largest entry and the length of the list.

Defined results: a vector that is null or holds null or non-finite entries gives no
row, nor does one without entries; vectors of each length are a fit of their own; ids may be
null or repeated, every row gets its results; a component whose eigenvalue is zero
up to rounding has ``whitened`` null, and ``explained`` is null where all vectors
are equal; entries beyond 64 bits after scaling are held at the ends of that
range; ``deviation`` is a decimal string of the exact integer; other columns are not read,
and an id column with a result's name comes back as ``vec_id``; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from selenite.llm.common import concat_column, materialize

SCALE = 256
COMPONENTS = 4
#: Primes lie below this; centred residues then reach 2 ** 19, and BLOCK rows of products 2 ** 53.
PRIME_LIMIT = 2**20
BLOCK = 2**15
OUT = "vec_id long, component int, n long, deviation string, whitened double, explained double"


def primes() -> Iterator[int]:
    """Primes below PRIME_LIMIT, falling."""
    for p in range(PRIME_LIMIT - 1, 2, -1):
        if all(p % q for q in range(2, isqrt(p) + 1)):
            yield p


def enough_primes(largest: int, rows: int) -> list[int]:
    """So many primes that every sum of ``rows`` products of entries up to ``largest`` has its own residues."""
    need, product, chosen = 2 * max(rows, 1) * max(largest, 1) ** 2 + 1, 1, []
    for p in primes():
        if product >= need:
            return chosen
        chosen.append(p)
        product *= p
    raise ValueError("no primes left")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long integer lists as a matrix."""
    column = concat_column(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def residue_scatter(x: np.ndarray, p: int) -> np.ndarray:
    """[x 1]' [x 1] modulo ``p``."""
    total = np.zeros((x.shape[1] + 1, x.shape[1] + 1), np.int64)
    for at in range(0, len(x), BLOCK):
        r = x[at : at + BLOCK] % p
        r = np.where(r > p // 2, r - p, r).astype(np.float64)
        r = np.hstack([r, np.ones((len(r), 1))])
        total = (total + (r.T @ r).astype(np.int64)) % p
    return total


def from_residues(residues: list[int], moduli: list[int]) -> int:
    """The integer of least size with these residues."""
    value, product = 0, 1
    for r, p in zip(residues, moduli, strict=True):
        value += product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return value if 2 * value <= product else value - product


def exact_scatter(vectors: DataFrame, size: int) -> tuple[int, list[int], list[list[int]]]:
    """n, S and n G - S S' of the integer lists in column ``x``, exact."""
    ends = vectors.agg(F.count("*"), F.max(F.array_max("x")), F.min(F.array_min("x"))).first()
    moduli = enough_primes(max(abs(ends[1]), abs(ends[2])), ends[0])
    upper = np.triu_indices(size + 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(moduli), size + 1, size + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"))
                for k, p in enumerate(moduli):
                    totals[k] = (totals[k] + residue_scatter(x, p)) % p
        flat = np.concatenate([t[upper] for t in totals])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "v"])

    rows = vectors.select("x").mapInArrow(sums, "i long, v long").groupBy("i").agg(F.sum("v").alias("v")).collect()
    width = len(upper[0])
    found = [[0] * width for _ in moduli]
    for r in rows:  # a matrix for each prime, whatever the number of vectors
        found[r["i"] // width][r["i"] % width] = r["v"]
    g = [[0] * (size + 1) for _ in range(size + 1)]
    for k, (i, j) in enumerate(zip(*upper, strict=True)):
        g[i][j] = g[j][i] = from_residues([found[m][k] % p for m, p in enumerate(moduli)], moduli)
    n, s = g[size][size], g[size][:size]
    return n, s, [[n * g[i][j] - s[i] * s[j] for j in range(size)] for i in range(size)]


def leading_components(n: int, scatter: list[list[int]], count: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvectors (columns) and eigenvalues of the covariance, falling, and its trace; zero where only rounding is left."""
    covariance = np.array([[a / (n * n) for a in row] for row in scatter])
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:count], axes[:, ::-1][:, :count]
    trace = sum(row[i] for i, row in enumerate(scatter)) / (n * n)
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    return axes, np.where(values > trace * len(scatter) * 1e-15, values, 0.0), trace


def deviations(x: np.ndarray, n: int, s: list[int]) -> list[int]:
    """Sums over dimensions of (n x - S) squared, exact."""
    reach = max((n * abs(int(v)) + abs(t) for v, t in zip(np.abs(x.astype(object)).max(0), s, strict=True)), default=0)
    kind = np.int64 if reach * reach * max(len(s), 1) < 2**63 else object
    d = x.astype(kind) * kind(n) - np.array(s, kind) if kind is np.int64 else x.astype(object) * n - np.array(s, object)
    return [int(v) for v in (d * d).sum(1)]


def projector(s: list[int], n: int, axes: np.ndarray, values: np.ndarray):
    """x vectors to whitened coordinates; nan where the eigenvalue is zero.

    x - S / n is split into a whole part and a fraction, so large entries lose nothing to rounding.
    """
    whole = np.array([t // n for t in s], object)
    part = np.array([(t % n) / n for t in s])

    def project(x: np.ndarray) -> np.ndarray:
        centred = (x.astype(object) - whole).astype(np.float64) if np.abs(x.astype(np.float64)).max(initial=0) > 2**52 else (x - whole.astype(np.int64)).astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (centred - part) @ axes / np.sqrt(values)
        return np.where(values > 0, out, np.nan)

    return project


def integers(vector: str) -> Column:
    """floor(256 c) of each entry; null for a vector that takes no part."""
    v = F.col(vector).cast("array<double>")
    whole = F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))
    return F.when(whole, F.transform(v, lambda c: F.floor(c * SCALE).cast("long")))


def whiten(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: (id, component, n, deviation, whitened, explained, identity_error)."""
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), integers(vector).alias("x")).where("x is not null")
    distinct = materialize(rows.select("x").distinct().withColumn("size", F.size("x")))
    out = None
    for size in sorted(r[0] for r in distinct.select("size").distinct().collect()):
        part = whiten_size(rows.where(F.size("x") == size), distinct.where(F.col("size") == size), size, min(size, components))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = table.sparkSession.createDataFrame([], OUT + ", identity_error double")
    return out if id_column in out.columns else out.withColumnRenamed("vec_id", id_column)


def whiten_size(rows: DataFrame, distinct: DataFrame, size: int, count: int) -> DataFrame:
    """The vectors of one length."""
    n, s, scatter = exact_scatter(distinct, size)
    axes, values, trace = leading_components(n, scatter, count)
    project = projector(s, n, axes, values)
    explained = [float(v) / trace if trace > 0 else None for v in values]

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = project(matrix(batch.column("x")))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in w.T], [f"w{k}" for k in range(count)])

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"))
            w, m = project(x), len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), count))),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * count, n)),
                    pa.array([str(d) for d in deviations(x, n, s) for _ in range(count)], pa.string()),
                    pa.array(w.ravel(), from_pandas=True),
                    pa.array(explained * m, pa.float64()),
                ],
                [f.split()[0] for f in OUT.split(", ")],
            )

    some = [k for k in range(count) if values[k] > 0]
    pairs = [(i, j) for i in some for j in some if i <= j]
    fit = distinct.select("x").mapInArrow(whitened, ", ".join(f"w{k} double" for k in range(count)))
    found = fit.agg(*(F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs)).first() if pairs else []
    error = max((abs(c - (i == j)) for c, (i, j) in zip(found, pairs, strict=True)), default=0.0)
    return rows.mapInArrow(results, OUT).withColumn("identity_error", F.lit(float(error)))
