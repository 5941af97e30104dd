"""Trees by pairwise gradients, ordered target statistics and importances against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketrank.operators import boosting, encoding, metrics, models


def test_gradients_of_pairs():
    dice = np.random.default_rng(1)
    sizes = [1, 2, 5, 5, 9, 2]
    starts = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    y, s = dice.choice([0.0, 0.3, 0.85, 1.0], starts[-1]), dice.normal(size=starts[-1])
    g, h = boosting.pair_gradients(y, s, starts)
    want_g, want_h = np.zeros(len(y)), np.zeros(len(y))
    weight = lambda i, j, lo, hi: (y[i] - y[j]) / max(y[lo:hi].max() - y[lo:hi].min(), 1e-12) / (hi - lo - 1)
    for lo, hi in zip(starts[:-1], starts[1:], strict=True):
        for i in range(lo, hi):
            for j in range(lo, hi):
                if y[i] > y[j]:
                    w, r = weight(i, j, lo, hi), 1 / (1 + math.exp(s[i] - s[j]))
                    want_g[i] += w * r
                    want_g[j] -= w * r
                    want_h[i] += w * r * (1 - r)
                    want_h[j] += w * r * (1 - r)
    assert np.allclose(g, want_g) and np.allclose(h, want_h)

    # the gradient is that of the loss, by differences
    def loss(x):
        return sum(weight(i, j, lo, hi) * math.log(1 + math.exp(x[j] - x[i])) for lo, hi in zip(starts[:-1], starts[1:], strict=True) for i in range(lo, hi) for j in range(lo, hi) if y[i] > y[j])

    for k in range(len(y)):
        step = np.zeros(len(y))
        step[k] = 1e-5
        assert abs((loss(s + step) - loss(s - step)) / 2e-5 + g[k]) < 1e-6


def _requests(dice, n, size=6):
    """Requests with levels of their own; within one, x decides. rows: idx, request_id, label, x, noise."""
    rows = []
    for r in range(n):
        level = dice.normal(scale=5)
        for _ in range(size):
            x = dice.normal()
            rows.append((len(rows), r, float(1 / (1 + np.exp(-(level + x + 0.3 * dice.normal())))), float(x), float(dice.normal())))
    return rows


def test_first_split_by_brute_force(spark):
    dice = np.random.default_rng(2)
    rows = _requests(dice, 40) + [(9000, None, 1.0, 3.0, 3.0), (9001, 5, None, 1.0, 1.0)]
    rows += [(9100 + k, 1, 0.5, None, float("nan")) for k in range(3)]
    df = spark.createDataFrame(rows, "idx long, request_id long, label double, x double, noise double").repartition(3)
    model = boosting.GroupRanker(iterations=1, depth=2, rate=1.0).train(df, ["x", "noise"], [])
    some = sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[1], r[0]))
    y, request = np.array([r[2] for r in some]), np.array([r[1] for r in some])
    starts = np.r_[np.flatnonzero(np.r_[True, request[1:] != request[:-1]]), len(some)]
    g, h = boosting.pair_gradients(y, np.zeros(len(y)), starts)
    x = np.array([[np.nan if v is None else v for v in r[3:]] for r in some], float)
    bins = boosting.binned(x, model.edges)
    value = lambda mask: g[mask].sum() ** 2 / (h[mask].sum() + 1)
    # rows without curvature carry no gradient either and form no bin of a histogram
    gains = {(c, b): value(bins[:, c] <= b) + value(bins[:, c] > b) - value(bins[:, c] < 99) for c in range(2) for b in np.unique(bins[h > 0, c])}
    best = max(gains, key=lambda k: (round(gains[k], 9), -k[0], -k[1]))
    tree = model.trees[0]
    assert (tree.column[0], tree.cut[0]) == best and abs(gains[best] - gains[tree.column[0], tree.cut[0]]) < 1e-9
    for leaf in np.unique(tree.nodes(bins)):
        mask = tree.nodes(bins) == leaf
        assert abs(tree.value[leaf] - g[mask].sum() / (h[mask].sum() + 1)) < 1e-9
    got = {r.idx: r.score for r in model.predict(df).collect()}
    assert all(abs(got[r[0]] - s) < 1e-9 for r, s in zip(some, boosting.bounded(tree.score(bins)), strict=True)) and 9000 in got


def _ndcg(df):
    return metrics.ndcg(df, "request_id", "label", "score").first()[0]


def test_ranks_within_requests_better_than_pointwise(spark, tmp_path):
    """Most of a label is the level of its request, which no column tells: noise to a pointwise model, nothing to pairs within requests."""
    dice = np.random.default_rng(3)
    rows = _requests(dice, 300)
    both = spark.createDataFrame(rows, "idx long, request_id long, label double, x double, noise double").repartition(4).cache()
    df, check = both.filter("request_id < 150"), both.filter("request_id >= 150")
    config = {"iterations": 8, "depth": 3}
    ranker = models.create({"type": "ranker", "config": config}).train(df, ["x", "noise"], [])
    point = models.create({"type": "pointwise_ranker", "config": config}).train(df, ["x", "noise"], [])
    ours, theirs = _ndcg(ranker.predict(check)), _ndcg(point.predict(check))
    assert ours > theirs + 0.01 and ours > 0.98
    # importances: of the gain, and of the loss by shuffling within requests
    lost, gain = ranker.loss_importance(), ranker.importance()
    assert gain["x"] > 90 and abs(sum(gain.values()) - 100) < 1e-6
    assert lost["x"] > 0.05 and abs(lost["noise"]) < 0.005
    ranker.save(str(tmp_path / "m"))
    again = boosting.GroupRanker.load(str(tmp_path / "m"))
    pairs = ranker.predict(check).select("idx", "score").join(again.predict(check).select("idx", F.col("score").alias("other")), "idx")
    assert pairs.filter("score <> other").isEmpty() and again.importance() == gain
    with pytest.raises(ValueError):
        ranker.predict(df.drop("x"))
    # no request, no rows
    alone = boosting.GroupRanker(iterations=2, depth=2).train(df.withColumn("request_id", F.lit(None).cast("long")), ["x"], [])
    assert alone.trees == [] and alone.predict(check).agg(F.max("score")).first()[0] == 0.5


def test_large_requests_are_split(spark, monkeypatch):
    """A request with most rows is compared within parts of bounded size; the order is still found."""
    monkeypatch.setattr(boosting, "GROUP", 16)
    monkeypatch.setattr(boosting, "BLOCK", 64)
    dice = np.random.default_rng(4)
    rows = [(k, 1 if k % 3 else k, float(x > 0), float(x)) for k, x in enumerate(dice.normal(size=900))]
    df = spark.createDataFrame(rows, "idx long, request_id long, label double, x double").repartition(3)
    model = boosting.GroupRanker(iterations=2, depth=2).train(df, ["x"], [])
    assert model.blocks.agg(F.max("n"), F.count("*")).first()[0] < 200
    for row in model.blocks.select("groups").collect():
        assert np.diff(np.frombuffer(row["groups"], np.int32)).max() < 60
    auc = metrics.auc(model.predict(df), "label", "score").first()[0]
    assert auc > 0.95


def test_ordered_statistics_equal_a_sequential_version(spark):
    r = random.Random(5)
    rows = [(k, r.choice(["hot"] * 6 + ["a", "b", None]), r.choice([1, 2]), r.choice([0.0, 1.0, 0.3])) for k in range(700)]
    df = spark.createDataFrame(rows, "idx long, c string, d int, label double").repartition(5)
    mean = sum(x[3] for x in rows) / len(rows)
    place = {x.idx: x.p for x in df.select("idx", F.xxhash64(F.lit(42), "idx").alias("p")).collect()}
    want, seen = {}, {}
    for k, c, d, y in sorted(rows, key=lambda x: place[x[0]]):
        values = []
        for name in (("c", "NA" if c is None else c), ("d", str(d))):
            total, n = seen.get(name, (0.0, 0))
            values.append((total + mean) / (n + 1))
            seen[name] = (total + y, n + 1)
        want[k] = values
    got = {x.idx: (x.c__stat, x.d__stat) for x in encoding.ordered(df, ["c", "d"], "label", mean).collect()}
    assert len(got) == 700 and all(np.allclose(got[k], want[k]) for k in want)
    found = encoding.statistics(df, ["c", "d"], "label")
    new = spark.createDataFrame([(1, "hot", 2), (2, None, 3), (3, "new", None)], "idx long, c string, d int")
    shown = {x.idx: (x.c__stat, x.d__stat) for x in encoding.encoded(new, ["c", "d"], found, mean).collect()}
    of = lambda name: (seen[name][0] + mean) / (seen[name][1] + 1)
    assert np.allclose(shown[1], (of(("c", "hot")), of(("d", "2")))) and np.allclose(shown[2], (of(("c", "NA")), mean)) and np.allclose(shown[3], (mean, mean))


@pytest.mark.parametrize("kind", ["classifier", "ranker", "pointwise_ranker"])
def test_many_categories_train_and_leak_nothing(spark, kind):
    """More values than a tree of MLlib has bins, each rare, labels by chance: what is learnt must not show on new rows."""
    r = random.Random(6)
    rows = [(k, k // 8, f"v{r.randrange(400)}", float(r.random() > 0.5)) for k in range(2400)]
    df = spark.createDataFrame(rows, "idx long, request_id long, c string, label double")
    train, new = df.filter("idx < 1200"), df.filter("idx >= 1200")
    model = models.create({"type": kind, "config": {"iterations": 3, "depth": 3}}).train(train, [], ["c"])
    seen, fresh = (metrics.auc(model.predict(x), "label", "score").first()[0] for x in (train, new))
    assert 0.4 < fresh < 0.6
    assert model.predict(new.withColumn("c", F.lit("never seen"))).select("score").distinct().count() == 1
