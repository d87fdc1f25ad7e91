"""Layouts of files and late rows against a plain reading."""

import hashlib
import zlib
from datetime import datetime, timedelta
from math import floor
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from selenite.llm import late_overwrite, queries
from tests.conftest import SF

ZERO = datetime(1970, 1, 1)
CUT = datetime(2024, 4, 10)


def micros(t):
    return None if t is None else (t - ZERO) // timedelta(microseconds=1)


def day(t):
    return -1 if t is None else (t - ZERO).days


def plain_layout(rows, size):
    """{day: lists of rows of each file}; rows are (sale_id, total, sold_at, arrived_at), newest of each id."""
    newest = {}
    for r in rows:
        old = newest.get(r[0])
        if old is None or (r[3] or datetime.min) > (old[3] or datetime.min):
            newest[r[0]] = r
    days = {}
    for r in newest.values():
        days.setdefault(day(r[2]), []).append(r)
    order = lambda r: (r[2] or datetime.min, -1 if r[0] is None else r[0])
    return {d: [sorted(x, key=order)[i : i + size] for i in range(0, len(x), size)] for d, x in days.items()}, newest


def expected(sales):
    size = 1 + len(sales) // 700
    rows = list(sales)
    for i, total, sold, arrived in sales:
        h = zlib.crc32(str(i).encode())
        if h % 3 == 0 and day(sold) % 7 == 0:
            rows.append((i, None if total is None else total + 1, sold + timedelta(days=h % 2), arrived + timedelta(days=1 + h % 97)))
    start, before = plain_layout([r for r in rows if r[3] and r[3] < CUT], size)
    end, after = plain_layout(rows, size)
    late = [r for r in after.values() if not (r[3] and r[3] < CUT)]
    touched = {day(r[2]) for r in late} | {day(before[r[0]][2]) for r in late if r[0] in before}
    out = {}
    for d, files in end.items():
        for k, f in enumerate(files):
            none = lambda x: "" if x is None else str(x)
            out[d, k] = (
                len(f), sum(0 if r[1] is None else floor(100 * r[1] + 0.5) for r in f),
                sum(zlib.crc32(f"{none(r[0])}:{none(micros(r[2]))}:{none(micros(r[3]))}".encode()) for r in f),
                hashlib.sha256(",".join(none(r[0]) for r in f).encode()).hexdigest(), d in touched,
            )
    return out, start


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_query_equals_plain_reading(spark, monkeypatch, zone):
    kept = {}
    plain = late_overwrite.overwrite_late

    def watched(session, late, layout):
        kept.update({p: p.read_bytes() for p in Path(layout.path.removeprefix("file://")).rglob("*.parquet")})
        return plain(session, late, layout)

    monkeypatch.setattr(late_overwrite, "overwrite_late", watched)
    sf = "/root/testdata/sf0.01" if zone == "UTC" else SF
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = queries.QUERIES["op12_late_arrival_overwrite"](spark, sf).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    sales = pq.read_table(f"{sf}/sales.parquet")
    want, start = expected(list(zip(*(sales.column(c).to_pylist() for c in ("sale_id", "total", "sold_at", "arrived_at")))))
    assert {(r.day, r.file_no): (r.n_rows, r.cents, r.rows_crc, r.ids_sha256, r.rewritten) for r in got} == want
    assert len(got) == len(want) and {r.columns for r in got} == {",".join(sales.schema.names)}
    paths = {Path(r.path.removeprefix("file://")): r for r in got}
    assert set(next(iter(paths)).parents[2].rglob("*.parquet")) == set(paths)
    assert {p for p in paths if p in kept} == {p for p, r in paths.items() if not r.rewritten}
    assert len(kept) == sum(map(len, start.values())) and all(p.read_bytes() == kept[p] for p in paths if p in kept)
    assert all(pq.read_schema(p).names == sales.schema.names for p in paths) and {r.rewritten for r in got} == {True, False}


SCHEMA = "layout_day string, id long, t timestamp_ntz, a timestamp_ntz, row string, kind int, LAYOUT_FILE int"


def small(spark, rows):
    return spark.createDataFrame([("old", i, t, a, "r", 9, k) for k, (i, t, a) in enumerate(rows)], SCHEMA)


def contents(spark, layout):
    at = Path(layout.path.removeprefix("file://"))
    out = {}
    for p in at.rglob("*.parquet"):
        d, k = (int(x.name.rpartition("=")[2]) for x in (p.parents[1], p.parents[0]))
        t = pq.ParquetFile(p).read()
        assert t.schema.names == [c.split()[0] for c in SCHEMA.split(", ")] and (d, k) not in out
        out[d, k] = list(zip(t.column("id").to_pylist(), t.column("t").to_pylist(), t.column("a").to_pylist()))
    return out


@pytest.mark.parametrize("share", [1000, 4])
def test_hot_times_nulls_ties_and_days_that_empty(spark, tmp_path, monkeypatch, share):
    monkeypatch.setattr(late_overwrite, "SHARE", share)
    d = lambda n, s=0: ZERO + timedelta(days=n, seconds=s)
    first = [(i, d(3), d(3, i)) for i in range(50)] + [(100 + i, d(3, 60 * i), d(4)) for i in range(30)]
    first += [(200 + i, None, d(4)) for i in range(20)] + [(300, d(9), d(9)), (None, d(3), d(4)), (301, d(-2, 5), None), (400, d(5), d(5)), (400, d(5), d(5))]
    late = [(i, d(4 + i % 2, i), d(9)) for i in range(0, 50, 3)] + [(300, d(3, 7), d(10)), (None, d(3, 1), d(11)), (201, d(3), d(8)), (102, d(3), d(3)), (500, None, None)]
    late += [(103, d(3, 180), d(12)), (103, d(3, 180), d(12))]
    layout = late_overwrite.Layout(f"file://{tmp_path}/x", small(spark, first).schema, "id", "t", "a", 4)
    late_overwrite.create(small(spark, first), layout)
    plain = lambda rows: {(d, k): [(i, t, a) for i, _, t, a in f] for d, x in plain_layout([(i, 0, t, a) for i, t, a in rows], 4)[0].items() for k, f in enumerate(x)}
    assert contents(spark, layout) == plain(first)
    before = {p: p.read_bytes() for p in Path(f"{tmp_path}/x").rglob("*.parquet")}
    days = late_overwrite.overwrite_late(spark, small(spark, late), layout)
    assert days == [-1, 3, 4, 5, 9] and contents(spark, layout) == plain([*first, *late])
    after = set(Path(f"{tmp_path}/x").rglob("*.parquet"))
    assert {p.parents[1].name for p in after & set(before)} == {"layout_day_=-2"} and not (tmp_path / "x" / "layout_day_=9").exists()
    assert late_overwrite.overwrite_late(spark, small(spark, late), layout) == []
    assert late_overwrite.overwrite_late(spark, small(spark, []), layout) == [] and contents(spark, layout) == plain([*first, *late])


def test_empty_tables(spark, tmp_path):
    layout = late_overwrite.Layout(f"file://{tmp_path}/x", small(spark, []).schema, "id", "t", "a", 3)
    late_overwrite.create(small(spark, []), layout)
    assert late_overwrite.file_report(spark, layout, {"n": F.lit(1)}).count() == 0
    assert late_overwrite.overwrite_late(spark, small(spark, [(1, ZERO, ZERO)]), layout) == [0]
    (r,) = late_overwrite.file_report(spark, layout, {"n": F.lit(1)}).collect()
    assert (r.day, r.file_no, r.n_rows, r.n, r.ids_sha256) == (0, 0, 1, 1, hashlib.sha256(b"1").hexdigest())
