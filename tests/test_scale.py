"""Hot users, exact order statistics, files side by side, plans that read no more than they need."""

from __future__ import annotations

import datetime as dt
import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketrank import queries
from basketrank.operators import basic, cf, exploration
from basketrank.sources import interactions, shared

SF = "/root/testdata/sf0.001"
T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("block", [None, 60_000_000, 1_800_000_000])
def test_sessions_of_a_user_with_most_of_the_log(spark, block):
    """Ties, repeats, nulls and rows exactly a span apart, over many time blocks."""
    r = random.Random(1)
    span = 1_800_000_000
    rows = []
    for _ in range(900):
        user = 1 if r.random() < 0.8 else r.choice([2, 3, None])
        second = r.choice([0, 1800, 3600, r.randrange(40_000), r.randrange(400)])
        rows.append((user, r.choice([1, 2, 3, 4, None]), r.choice([7, 8, None]), T0 + dt.timedelta(seconds=second, microseconds=r.choice([0, 0, 1, 999_999]))))
    df = spark.createDataFrame(rows, "user_id long, product_id long, store_id long, ts timestamp_ntz").repartition(4)
    got = {(x.user_id, x.ts): tuple(x[c] for c in basic.SESSION) for x in basic.sessions(df, df, span, block).collect()}
    micros = lambda t: round((t - T0).total_seconds() * 1_000_000)
    want = {}
    for user, _, _, at in rows:
        if user is None:
            continue
        inside = [(micros(t), p, s) for u, p, s, t in rows if u == user and micros(at) - span <= micros(t) < micros(at)]
        times = [t for t, _, _ in inside]
        want[user, at] = (len(inside), len({p for _, p, _ in inside} - {None}), len({s for _, _, s in inside} - {None}), (max(times) - min(times)) // 1_000_000 if times else None)
    assert got == want
    assert basic.sessions(df.limit(0), df.limit(0), span).collect() == []


def test_order_statistics_are_exact(spark):
    r = random.Random(2)
    columns = {
        "small": [r.randrange(5) for _ in range(3000)], "wide": [r.choice([-1, 1]) * 10 ** r.uniform(-300, 300) for _ in range(3000)], "hot": [7.0] * 2000 + [r.random() for _ in range(1000)],
        "ends": [-1.7e308, 1.7e308] * 500 + [r.gauss(0, 1) for _ in range(2000)], "near": [1 + k * 2.0**-52 for k in range(3000)],
    }
    for name, values in columns.items():
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "`a.b` double").repartition(3)
        ranks = sorted({0, 1, 7, 1499, 1500, 2250, 2999})
        assert exploration.order_statistics(df, "a.b", ranks, bins=16, small=20) == {k: sorted(values)[k] for k in ranks}, name
        got = exploration.quantiles(df, "a.b", (0.1, 0.5))
        assert all(math.isclose(g, w, rel_tol=1e-12) for g, w in zip(got, np.quantile(np.array(values), [0.1, 0.5]), strict=True)) or name in ("wide", "ends")
    assert exploration.quantiles(spark.createDataFrame([(None,)], "v double"), "v", (0.5,)) == [None]
    one = exploration.described(spark.createDataFrame([(3,)], "v long"), "v").first()
    assert (one.n, one.p25, one.p50, one.largest) == (1, 3.0, 3.0, 3)


def test_submission_is_joined_from_ranges(spark, tmp_path):
    rows = [(i, i % 7, float((i * 37) % 1000)) for i in range(5000)]
    df = spark.createDataFrame(rows, "index long, request_id long, score double").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        interactions.write_submission(df.orderBy(F.desc("score"), "index"), path := str(tmp_path / "out.csv"))
        interactions.write_submission(df.orderBy(F.desc("score"), "index"), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    lines = Path(path).read_text().splitlines()
    want = [f"{i},{q}" for i, q, _ in sorted(rows, key=lambda x: (-x[2], x[0]))]
    assert lines == ["index,request_id", *want]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["out.csv"]
    interactions.write_submission(df.limit(0), path)
    assert Path(path).read_text() == "index,request_id\n"


def test_plain_features_write_nothing_and_filter_the_scan(spark, monkeypatch):
    made = []
    monkeypatch.setattr(shared, "kept", lambda df, name: made.append(name) or df)
    plan = queries.QUERIES["fg_source_type"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert made == [] and "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in plan and "Window" not in plan
    plan = queries.QUERIES["fg_user_stats"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert made == [] and "LessThan(ts," in plan and "p_name" not in plan.split("ReadSchema")[1]


def test_logs_that_are_written_hold_the_declared_columns(spark, monkeypatch):
    seen = []
    keep = shared.kept
    monkeypatch.setattr(shared, "kept", lambda df, name: seen.append((name, df.columns)) or keep(df, name))
    queries.QUERIES["fg_product_trend"](spark, SF)
    queries.QUERIES["fg_recency_u_s"](spark, SF)
    assert seen == [("log", ["ts", "product_id", "action_type"]), ("log", ["idx", "ts", "user_id", "store_id"])]


@pytest.mark.parametrize("cell", [1000, 4])
def test_a_round_of_pairwise_ranking_is_one_table(spark, monkeypatch, cell):
    """However many blocks there are: the tables of things done and of their places, then one a round; each user in one block only."""
    made = []
    keep = cf.kept
    monkeypatch.setattr(cf, "kept", lambda df, name: made.append(name) or keep(df, name))
    df = spark.createDataFrame([(u, p) for u in range(30) for p in range(u % 5, 12, 2)], "user_id long, product_id long")
    users, items = cf.bpr_factors(df, size=4, rounds=3, passes=1, cell=cell)
    assert made == ["bpr-seen", "bpr-places", *["bpr-factors"] * 3]
    assert users.count() == users.select("user_id").distinct().count() == 30 and items.count() == items.select("product_id").distinct().count() == 12
    assert all(len(r.v) == 5 for r in items.collect())
