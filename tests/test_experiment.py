from __future__ import annotations

import datetime as dt
import json
import logging
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketrank import queries
from basketrank.operators import basic, cf, exploration, metrics, models, selection, text
from basketrank.plans import experiment, logs, split
from basketrank.plans.config import Config
from basketrank.sources import interactions, shared
from basketrank.streaming.counts import hourly_counts

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark):
    return shared.kept(interactions.event_log(spark, SF), "log")


def test_run_and_submission(spark, log, tmp_path):
    folder = f"file://{tmp_path}"
    config = Config({
        "features": ["user_stats", "product_stats", "source_type"], "target": "Weighted", "model": {"type": "ranker", "config": {"iterations": 2, "depth": 2}}, "output": {"folder": folder},
        "feature_selection": {"importance": {"product_total_views": 2.0, "user_total_views": 1.0}, "threshold": 0.9, "cache": folder},
    })
    one = experiment.Experiment(config, "one")
    found = one.run(log)
    assert 0 <= found["ndcg"] <= 1 and 0 <= found["auc"] <= 1 and found["logloss"] > 0
    results = experiment.read_json(spark, f"{folder}/one_results")
    assert results["metrics"] == found and set(results["importance"]) == set(one.columns)
    assert experiment.read_json(spark, f"{folder}/one_config") == json.loads(json.dumps(config.as_dict()))
    # what selection kept is read again
    assert len(list(tmp_path.glob("selected-*"))) == 1
    assert experiment.Experiment(config, "two").run(log) == found and len(list(tmp_path.glob("selected-*"))) == 1
    history, test = split.timewise(log, 7)
    out = [tuple(r) for r in one.submission(history, test).collect()]
    assert len(out) == test.count() and {i for i, _ in out} == {r.idx for r in test.select("idx").collect()}
    assert spark.read.csv(f"{folder}/one_submission", header=True).count() == len(out)
    assert experiment.compared({"a": 1.5, "b": 0.0, "c": 1}, {"a": 1.0, "b": 0.0}) == [("a", 1.5, 1.0, 50.0), ("b", 0.0, 0.0, None)]


def test_logging(tmp_path):
    logs.setup_logging(str(tmp_path / "x.log"), "ERROR")
    logs.logger("part").debug("seen")
    log = logs.setup_logging(console="ERROR")
    assert len(log.handlers) == 1 and "basketrank.part DEBUG seen" in (tmp_path / "x.log").read_text()
    with pytest.raises(ValueError):
        logs.setup_logging(console="LOUD")
    logging.getLogger(logs.NAME).handlers.clear()


def test_single_feature_model_is_read_back(spark, tmp_path):
    models.SingleFeatureModel("x", False).save(str(tmp_path / "m"))
    again = models.SingleFeatureModel.load(str(tmp_path / "m"))
    assert (again.feature, again.desc) == ("x", False)
    assert models.top_importance(again) == [("x", 1.0)]


def test_cut_reaches_the_scan(spark):
    h, t = queries.split_events(spark, SF)
    assert h.count() + t.count() == 1000
    plan = h._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(ts" in plan and "Join" not in plan
    empty, none = split.timewise(h.limit(0), 3)
    assert (empty.count(), none.count()) == (0, 0)


def test_svd_is_the_truncated_one(spark):
    r = np.random.default_rng(5)
    dense = (r.random((40, 25)) < 0.3) * r.integers(1, 5, (40, 25))
    rows = [(int(u), int(p), float(dense[u, p])) for u, p in zip(*np.nonzero(dense), strict=True)]
    weights = spark.createDataFrame(rows, "user_id long, product_id long, w double")
    wanted = spark.createDataFrame([(u, p) for u in range(40) for p in range(25)], "user_id long, product_id long")
    u, s, v = np.linalg.svd(dense.astype(float))
    for rank in (3, 24):
        best = (u[:, :rank] * s[:rank]) @ v[:rank]
        got = np.zeros((40, 25))
        for x in cf.svd_scores(weights, wanted, rank, passes=8).collect():
            got[x.user_id, x.product_id] = x.score
        assert np.abs(got - best).max() < 0.05 and abs(np.linalg.norm(dense - got) - np.linalg.norm(dense - best)) < 1e-3


def test_pairwise_ranking_learns_groups(spark):
    r = np.random.default_rng(1)
    pairs = {(f"u{u}", int(p)) for u in range(40) for p in r.choice(np.arange(0, 15) + 15 * (u % 2), 8, replace=False)}
    df = spark.createDataFrame(sorted(pairs), "user_id string, product_id long")
    for cell in (100_000, 16):
        users, items = cf.bpr_factors(df, size=8, rounds=3, passes=10, cell=cell)
        x, y = {u.user_id: np.array(u.v) for u in users.collect()}, {i.product_id: np.array(i.v) for i in items.collect()}
        assert len(x) == 40 and len(y) == 30
        score = {(u, p): x[u] @ y[p][:-1] + y[p][-1] for u in x for p in y}
        ours = [score[u, p] > score[u, q] for u in x for p in y for q in y if p % 30 // 15 == int(u[1:]) % 2 and q // 15 != int(u[1:]) % 2]
        assert np.mean(ours) > 0.95


def test_similarities_of_wanted_pairs(spark):
    # everybody bought product 0, so all users meet
    rows = [(u, 0) for u in range(30)] + [(u, 1 + (u * k) % 9) for u in range(30) for k in (1, 2, 5)]
    m = spark.createDataFrame(sorted(set(rows)), "user_id long, product_id long")
    sets = {u: {p for v, p in rows if v == u} for u in range(30)}
    pairs = spark.createDataFrame([(a, b) for a in range(5) for b in range(30)], "a long, b long")
    got = {(r.a, r.b): r.sim for r in cf.jaccard_of(pairs, m).collect()}
    assert got == {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in range(5) for b in range(30)}
    every = {(r.a, r.b): r.npmi for r in cf.npmi(m).collect()}
    some = sorted(k for k in every if k[0] < k[1])[::2]
    found = {(r.a, r.b): r.npmi for r in cf.npmi_of(spark.createDataFrame(some, "a long, b long"), m).collect()}
    assert found.keys() == set(some) and all(abs(found[k] - every[k]) < 1e-9 for k in some)
    blocks = cf.item_blocks(m, 2).collect()
    assert len(blocks) > 30 and {(b.user_id, p) for b in blocks for p in b["items"]} == set(rows)


def test_few_items_lose_nothing(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(6, 64))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "product_id long, vector array<double>")
    out = {x.product_id: np.array(x.vector) for x in text.reduce(df, "product_id").collect()}
    assert all(len(x) == 20 for x in out.values())
    for i in range(6):
        for j in range(6):
            assert abs(np.linalg.norm(out[i] - out[j]) - np.linalg.norm(v[i] - v[j])) < 1e-6
    assert text.reduce(df.limit(1), "product_id").first().vector == [0.0] * 20


def test_components_keep_the_most_variance(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(200, 32)) * np.linspace(3, 0.1, 32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "product_id long, vector array<double>")
    out = np.array([x.vector for x in text.reduce(df, "product_id", 5).orderBy("product_id").collect()])
    values = np.sort(np.linalg.eigvalsh(np.cov(v.T)))[::-1]
    assert np.allclose(out.var(axis=0, ddof=1), values[:5], rtol=1e-6)


def test_correlations_with_gaps(spark):
    r = np.random.default_rng(4)
    x = r.normal(1e6, 1, (300, 4))
    x[:, 1] = -x[:, 0] + r.normal(0, 0.1, 300)
    rows = [tuple(None if r.random() < 0.2 else float(y) for y in row) for row in x]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").withColumn("e", F.lit(None).cast("double"))
    got = {(k.a, k.b): k["corr"] for k in selection.correlations(df, list("abcde")).collect()}
    for i, a in enumerate("abcd"):
        for j, b in enumerate("abcd"):
            if i < j:
                both = [(p[i], p[j]) for p in rows if p[i] is not None and p[j] is not None]
                assert abs(got[a, b] - abs(np.corrcoef(np.array(both).T)[0, 1])) < 1e-6
    assert got["a", "e"] is None and len(got) == 10


def test_ranks_and_area_over_many_partitions(spark):
    r = np.random.default_rng(6)
    rows = [(float(s), float(y)) for s, y in zip(r.integers(0, 50, 400) / 7, r.integers(0, 2, 400), strict=True)]
    df = spark.createDataFrame(rows, "score double, label double")
    won = [(p > n) + (p == n) / 2 for p, y in rows if y for n, z in rows if not z]
    assert abs(metrics.auc(df, "label", "score").first()[0] - np.mean(won)) < 1e-9
    assert metrics.auc(df.limit(0), "label", "score").first()[0] is None


def test_stream(spark, tmp_path):
    rows = [(u, f"2024-01-01 {h:02d}:{m:02d}:00", a) for u in (1, 2) for h in range(6) for m, a in ((5, "AT_View"), (40, "AT_Purchase"))]
    df = spark.createDataFrame(rows, "user_id long, ts string, action_type string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"file://{tmp_path}/in")
    out = hourly_counts(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in"))
    run = out.writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {tuple(r)[:1] + (r.hour.hour, r.interactions, r.views, r.purchases) for r in spark.table("hours").collect()}
    # hours that the watermark has passed
    assert got == {(u, h, 2, 1, 1) for u in (1, 2) for h in range(5)} - {(u, h, 2, 1, 1) for u in (1, 2) for h in (4,)} or got >= {(u, h, 2, 1, 1) for u in (1, 2) for h in range(4)}


def test_exploration_of_odd_logs(spark):
    df = spark.createDataFrame([(None, None, "AT_View"), (1, 2, None), (1, 3, "AT_View"), (4, 2, "AT_Click")], "user_id long, request_id long, action_type string")
    assert tuple(exploration.view_only_users(df).first()) == (1, 1 / 3)
    assert tuple(exploration.single_action_users(df).first()) == (1, 1 / 3)
    assert exploration.one_to_many(df, "user_id", "request_id").first()[0] and not exploration.one_to_many(df.limit(0), "user_id", "request_id").first()[0]
    assert exploration.histogram(df.limit(0), "user_id", 5).count() == 0
    assert [tuple(r) for r in exploration.histogram(df.select(F.lit(3).alias("k")), "k", 5).collect()] == [(0, 3.0, 4)]
    assert tuple(exploration.duplicates(df.union(df), ["request_id"]).first()) == (8, 1.0)


def test_folders(spark):
    path = shared.place(spark, "x")
    spark.range(3).write.parquet(path)
    assert shared.clear(spark) >= 1
    with pytest.raises(Exception):
        spark.read.parquet(path)


def test_moved_holidays(spark):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(["2024-01-07", "2024-05-10", "2024-05-11", None])], "idx long, ts string").withColumn("ts", F.to_timestamp("ts"))
    flags = lambda config: [r.is_russian_holiday for r in basic.russian_holiday(df, df, config).orderBy("idx").collect()]
    assert flags({}) == [1, 0, 0, 0] and flags({"holiday_dates": ["2024-05-10"]}) == [1, 1, 0, 0]
    assert flags({"holidays": [(5, 11)]}) == [0, 0, 1, 0]


def test_folder_off_local_masters():
    none = SimpleNamespace(isDefined=lambda: False)
    context = lambda master: SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared.place(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context(master)), "x")
    given = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: "hdfs://shared/folder/"), sparkContext=context("yarn"))
    assert shared.place(given, "x").startswith("hdfs://shared/folder/x-")
    shared._made.pop()


def test_transfers_of_holidays(spark):
    days = ["2023-02-24", "2024-05-10", "2024-05-13", "2025-12-31", "2026-02-24", "2024-01-03"]
    df = spark.createDataFrame([(i, dt.datetime.fromisoformat(x)) for i, x in enumerate(days)], "idx int, ts timestamp_ntz")
    flags = lambda config: [r.is_russian_holiday for r in basic.russian_holiday(df, df, config).orderBy("idx").collect()]
    assert flags({"holiday_transfers": True}) == [1, 1, 0, 1, 0, 1]
    assert flags({"holiday_transfers": True, "holiday_dates": ["2026-02-24"]}) == [1, 1, 0, 1, 1, 1]


def test_a_frame_is_let_go_when_training_fails(spark, log):
    one = experiment.Experiment(Config({"features": ["user_stats"], "model": {"type": "single_feature", "config": {"feature": "none"}}}), "fails")
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    with pytest.raises(ValueError):
        one.train(log, log)
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before
