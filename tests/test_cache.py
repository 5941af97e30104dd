"""The feature cache: by rows, repaired, safe against writers at the same time; epoch units."""

from __future__ import annotations

import datetime as dt
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from basketrank.operators import basic  # noqa: F401  features register themselves
from basketrank.plans import cache
from basketrank.sources.interactions import epoch_to_timestamp

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "idx long, user_id long, product_id long, action_type string, ts timestamp_ntz"


def log(spark, products):
    rows = [(i, 1, p, "AT_View", T0 + dt.timedelta(hours=min(i, 3))) for i, p in enumerate(products)]
    return spark.createDataFrame(rows, SCHEMA)


def of(spark, folder, h, t):
    return sorted((r.idx, r.user_unique_products) for r in cache.cached(str(folder), "user_stats", h, t).collect())


@pytest.fixture
def frames(spark):
    return log(spark, [5, 5, 5, 5, 5]), log(spark, [7])


def entries(folder):
    return sorted(p for p in Path(folder).iterdir())


def test_other_rows_of_one_range_and_count_are_another_entry(spark, tmp_path, frames):
    h, t = frames
    other = log(spark, [5, 6, 5, 5, 5])
    assert of(spark, tmp_path, h, t) == [(0, 1)] and of(spark, tmp_path, other, t) == [(0, 2)]
    assert len(entries(tmp_path)) == 2
    # order and partitions do not matter, repeats do
    assert of(spark, tmp_path, other.repartition(4).orderBy(F.desc("idx")), t) == [(0, 2)] and len(entries(tmp_path)) == 2
    assert cache.fingerprint(other.union(other)) != cache.fingerprint(other)
    assert cache.fingerprint(other.limit(0)) != cache.fingerprint(other)


def test_fingerprint_tells_where_nulls_are(spark):
    one = spark.createDataFrame([(1, None), (None, 2)], "a long, b long")
    other = spark.createDataFrame([(None, 1), (None, 2)], "a long, b long")
    assert cache.fingerprint(one) != cache.fingerprint(other)
    odd = spark.createDataFrame([(1, [1.0, None])], "`a.b` long, `c` array<double>")
    assert cache.fingerprint(odd) == cache.fingerprint(odd.select("c", "`a.b`"))


def test_tables_of_the_configuration_count(spark, frames):
    h, t = frames
    one, other = (spark.createDataFrame([(1, x)], "product_id long, v double") for x in (0.5, 0.6))
    assert cache.key("user_stats", h, t, {"vectors": one}) != cache.key("user_stats", h, t, {"vectors": other})
    assert cache.key("user_stats", h, t, {"vectors": one}) == cache.key("user_stats", h, t, {"vectors": one.repartition(2)})


@pytest.mark.parametrize("damage", ["cut", "gone", "bytes", "manifest", "half"])
def test_a_damaged_entry_is_made_again(spark, tmp_path, frames, damage):
    h, t = frames
    want = of(spark, tmp_path, h, t)
    (entry,) = entries(tmp_path)
    (part,) = [p for p in entry.glob("data-*/part-*.parquet") if p.stat().st_size > 0][:1]
    if damage == "cut":
        part.write_bytes(part.read_bytes()[:-20])
    elif damage == "gone":
        part.unlink()
    elif damage == "bytes":
        raw = bytearray(part.read_bytes())
        raw[4:60] = bytes(56)
        part.write_bytes(bytes(raw))
        part.with_name(f".{part.name}.crc").unlink(missing_ok=True)
    elif damage == "manifest":
        (entry / "manifest").write_text("{")
        (entry / ".manifest.crc").unlink(missing_ok=True)
    else:  # a writer died before its manifest
        (entry / "manifest").unlink()
    assert of(spark, tmp_path, h, t) == want
    before = {p: p.stat().st_mtime_ns for p in entry.glob("data-*/part-*")}
    assert of(spark, tmp_path, h, t) == want and before == {p: p.stat().st_mtime_ns for p in entry.glob("data-*/part-*")}


def test_two_writers_at_once(spark, tmp_path, frames):
    h, t = frames
    got: list = []
    threads = [threading.Thread(target=lambda: got.append(of(spark, tmp_path, h, t))) for _ in range(3)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert got == [[(0, 1)]] * 3 and of(spark, tmp_path, h, t) == [(0, 1)]
    assert not [p for e in entries(tmp_path) for p in e.iterdir() if p.name.startswith(".manifest-")]


def test_epoch_unit_is_that_of_the_largest_value(spark):
    ms = 1_700_000_000_000
    for first in (None, 5, ms):
        df = spark.createDataFrame([(first,), (ms,), (None,)], "timestamp long").coalesce(1)
        got = [r[0] for r in epoch_to_timestamp(df).select(F.date_format("timestamp", "yyyy-MM-dd")).collect()]
        assert got[1] == "2023-11-14" and got[2] is None
    sec = spark.createDataFrame([(None,), (1_700_000_000,)], "timestamp long")
    assert epoch_to_timestamp(sec).select(F.date_format("timestamp", "yyyy")).collect()[1][0] == "2023"
    assert epoch_to_timestamp(sec.limit(0)).count() == 0 and epoch_to_timestamp(sec.toDF("x")).columns == ["x"]
