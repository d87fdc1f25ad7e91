"""Whitening by residues against whole numbers and plain covariances."""

from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from selenite.llm import queries, rns_whiten
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<double>, label int, x string, n string, whitened string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "old", "old", "old") for i, v in rows], SCHEMA)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**62), 2**62), min_size=3, max_size=3), min_size=1, max_size=9))
def test_residues_give_the_exact_products(rows):
    x = np.array(rows, np.int64)
    moduli = rns_whiten.enough_primes(max(abs(v) for r in rows for v in r), len(rows))
    parts = [rns_whiten.residue_scatter(x, p) for p in moduli]
    full = [[*r, 1] for r in rows]
    for i in range(4):
        for j in range(4):
            got = rns_whiten.from_residues([int(g[i, j]) for g in parts], moduli)
            assert got == sum(r[i] * r[j] for r in full)


def test_blocks_add_up_without_rounding(monkeypatch):
    monkeypatch.setattr(rns_whiten, "BLOCK", 7)
    x = np.random.default_rng(3).integers(-(10**9), 10**9, (50, 5))
    p = next(rns_whiten.primes())
    full = np.hstack([x, np.ones((50, 1), int)]).astype(object)
    assert (rns_whiten.residue_scatter(x, p) == full.T @ full % p).all()
    assert (rns_whiten.PRIME_LIMIT // 2) ** 2 * 2**15 <= 2**53


def brute(rows, count=4):
    """(vec_id, component) -> (n, deviation, whitened without sign, explained)."""
    kept = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(x, s)] for x in fit])
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    out = []
    for i, x in kept:
        d = np.array([float(Fraction(n * c - t, n)) for c, t in zip(x, s)])
        for k in range(min(count, len(s))):
            out.append((i, k + 1, n, sum((n * c - t) ** 2 for c, t in zip(x, s)), abs(d @ axes[:, k]) / np.sqrt(e[k]), e[k] / e.sum()))
    return out


def check(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    got = sorted(((r.vec_id, r.component, r.n, int(r.deviation), abs(r.whitened), r.explained) for r in got), key=key)
    want = sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-6, abs=1e-7) and a[5] == pytest.approx(b[5], rel=1e-9)


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = queries.QUERIES["op13_residue_whitening"](spark, d)
    assert dict(got.dtypes) | {"deviation": "bigint"} == dict(got.dtypes)
    found = got.collect()
    check(found, brute(rows))
    assert {r.identity_error for r in found} == {found[0].identity_error} and 0 <= found[0].identity_error < 1e-9


def test_edge_cases(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(size=5)]) for i in range(40)]
    rows += [(3, rows[0][1]), (None, rows[1][1]), (41, None), (42, []), (43, [1.0, None, 0.0, 0.0, 0.0]), (44, [float("nan")] * 5), (45, [float("inf")] * 5), (7, rows[7][1])]
    check(rns_whiten.whiten(table(spark, rows)).collect(), brute(rows))
    large = [(i, [1e15 * c for c in v]) for i, v in rows[:40]]
    check(rns_whiten.whiten(table(spark, large)).collect(), brute(large))
    mixed = rns_whiten.whiten(table(spark, [*rows, (50, [1.0, 2.0]), (51, [3.0, 2.0]), (52, [1e300, -1e300])])).collect()
    assert sum(r.vec_id in (50, 51, 52) for r in mixed) == 6 and len(mixed) == 4 * 43 + 6
    assert rns_whiten.whiten(table(spark, rows).where("false")).count() == 0
    assert rns_whiten.whiten(table(spark, [(1, None)])).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_equal_vectors_have_no_direction(spark):
    got = rns_whiten.whiten(table(spark, [(1, [0.5, -0.25]), (2, [0.5, -0.25])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(1, "0", None, None, 0.0)] * 4
    line = rns_whiten.whiten(table(spark, [(i, [float(i), 2.0 * i]) for i in range(5)])).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in line) and line[0].identity_error < 1e-9


def test_other_columns_and_names(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("component"), F.col("embedding").alias("n"))
    got = rns_whiten.whiten(rows.where("component < 20"), "component", "n")
    assert got.count() == 80 and got.columns[:3] == ["vec_id", "component", "n"]
