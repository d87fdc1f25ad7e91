"""The projection forest against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from selenite.llm import queries, rp_forest
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<double>, score string, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "old", "old") for i, v in rows], SCHEMA)


def brute(rows, k=20, every=20):
    """(query_id, rank, vec_id, score) of all candidates."""
    ok = {}
    for i, v in rows:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            ok[i] = min(ok.get(i, v), v)
    out = []
    for i in ok:
        if i % every == 0:
            scores = []
            for j, v in ok.items():
                if j != i and len(v) == len(ok[i]):
                    s = 0.0
                    for a, b in zip(ok[i], v, strict=True):
                        s += a * b
                    scores.append((-s, j))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def results(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def test_query_recall_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got, want = results(queries.QUERIES["op11_projection_forest"](spark, d)), brute(rows)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    score = {(q, j): s for q, _, j, s in brute(rows, k=len(rows))}
    assert all(score[q, j] == s for q, _, j, s in got)
    assert len({r[::2] for r in got} & {r[::2] for r in want}) >= 0.9 * len(want)


@pytest.fixture
def small_leaves(monkeypatch):
    for name, value in {"LEAF": 8, "SAMPLE": 600, "ROWS": 60, "QUERIES": 50, "FIRST": 2}.items():
        monkeypatch.setattr(rp_forest, name, value)


def test_recall_with_many_leaves_and_parts(spark, small_leaves):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 6)) * 3
    rows = [(i, [float(c) for c in centres[i % 20] + rng.normal(size=6) * 0.3]) for i in range(800)]
    got, want = results(rp_forest.neighbours(table(spark, rows), F.col("vec_id") % 5 == 0, k=4)), brute(rows, 4, 5)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert len({r[::2] for r in got} & {r[::2] for r in want}) >= 0.9 * len(want)
    everything = results(rp_forest.neighbours(table(spark, rows), F.col("vec_id") % 5 == 0, k=4, recall=1.0))
    assert len(set(everything) & set(want)) >= 0.98 * len(want)


def test_copies_ties_and_broken_rows(spark, small_leaves):
    rows = [(i, [1.0, 0.0]) for i in range(0, 90, 2)] + [(i, [float(i % 3), 1.0]) for i in range(1, 30, 2)]
    rows += [(100, None), (120, []), (140, [0.0, 0.0]), (160, [1.0, None]), (180, [float("nan"), 1.0]), (200, [1.0, float("inf")]), (None, [9.0, 9.0])]
    rows += [(4, [1.0, 0.0]), (3, [7.0, 7.0]), (220, [1.0, 2.0, 3.0]), (240, [5.0, 5.0, 5.0]), (260, [1e200, 1.0, 0.0])]
    got = results(rp_forest.neighbours(table(spark, rows), F.col("vec_id") % 20 == 0, recall=1.0))
    assert got == brute(rows)
    assert len([r for r in got if r[0] == 220]) == 2


def test_few_and_no_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (7, [3.0, 3.0])]
    ask = F.col("vec_id") % 20 == 0
    assert results(rp_forest.neighbours(table(spark, rows), ask)) == brute(rows) and len(brute(rows)) == 2
    assert rp_forest.neighbours(table(spark, rows[:1]), ask).count() == 0
    assert rp_forest.neighbours(table(spark, rows[1:]), ask).count() == 0
    empty = rp_forest.neighbours(table(spark, rows).where("false"), ask)
    assert empty.count() == 0 and empty.columns == ["query_id", "rank", "vec_id", "score"]
    named = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("rank"), F.col("embedding").alias("leaf"))
    assert rp_forest.neighbours(named, F.col("rank") == 0, 3, "rank", "leaf").count() == 3


def test_every_row_is_in_one_leaf_of_each_tree():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(300, 5)), np.ones((200, 5))])
    tree = rp_forest.grow(x, 20, rng)
    leaves = rp_forest.leaf_of(tree, x)
    assert set(leaves) == set(range(tree["leaves"]))
    assert np.bincount(leaves[:300]).max() <= 40 and len(set(leaves[300:])) == 1
    orders = [list(o) for o in rp_forest.openings([tree, tree], x[:3])]
    assert all(sorted(o) == [(t, n) for t in (0, 1) for n in range(tree["leaves"])] and o[0][1] == leaves[i] for i, o in enumerate(orders))
