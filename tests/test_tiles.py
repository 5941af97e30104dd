"""Similarities of users in tiles: the same numbers as plain sets, no row of a pair written or shuffled, equal baskets met once."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest

from basketrank.operators import cf


def _sets(seed=1, users=70, products=90):
    """Users of a few common products and some rare ones; some with the same products."""
    r = random.Random(seed)
    out = {u: {p for p in range(6) if r.random() < 0.5} | {r.randrange(6, products) for _ in range(r.randrange(4))} for u in range(users)}
    out = {u: s or {products + u} for u, s in out.items()}
    return out | {users + k: set(out[k % 5]) for k in range(20)}


def _similar(sets):
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if sets[a] & sets[b]}


@pytest.mark.parametrize("words", [16, 0])
@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("digits", [None, 6])
def test_jaccard(spark, monkeypatch, words, kind, digits):
    monkeypatch.setattr(cf, "WORDS", words)
    monkeypatch.setattr(cf, "ROWS", 16)
    monkeypatch.setattr(cf, "PIECE", (5, 7))
    made = []
    keep = cf.kept
    monkeypatch.setattr(cf, "kept", lambda df, name: made.append(out := keep(df, name)) or out)
    name = (lambda u: f"ü{u}") if kind == "string" else (lambda u: u)
    sets = {name(u): s for u, s in _sets().items()}
    rows = [(u, p, 1) for u, s in sets.items() for p in s]
    df = cf.jaccard(spark.createDataFrame(rows, f"user_id {kind}, product_id long, cnt long"), 10, digits)
    got, want = df.collect(), _similar(sets)
    assert len(got) == len(want)
    assert {(x.a, x.b): x.sim for x in got} == {k: v if digits is None else np.floor(v * 10.0**digits + 0.5) / 10.0**digits for k, v in want.items()}
    # what is written grows with the log, not with the pairs; the last join makes the result
    assert len(want) > 4 * len(rows) and all(x.count() <= len(rows) for x in made)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join")[0]


@pytest.mark.parametrize("pairs", [0, 1, 20, 10**9])
def test_shared_items_of_blocks(monkeypatch, pairs):
    """Whether items are columns or lists."""
    monkeypatch.setattr(cf, "PAIRS", pairs)
    monkeypatch.setattr(cf, "PIECE", (8, 16))
    sets = [list(_sets(k).values()) for k in (2, 3)]
    sides = []
    for x in sets:
        size = np.array([len(s) for s in x])
        sides.append((size, np.repeat(np.arange(len(x)), size), np.array([p for s in x for p in sorted(s)], np.int32)))
    got = {}
    for left, right, both, near in cf._shared(*sides):
        got |= {(left + i, right + j): (both[i, j], near[i, j]) for i, j in zip(*np.nonzero(both), strict=True)}
    assert got == {(i, j): (len(a & b), len(a & b) / len(a | b)) for i, a in enumerate(sets[0]) for j, b in enumerate(sets[1]) if a & b}


@pytest.mark.parametrize("step", [256, 3])
def test_memory_scores_of_baskets(spark, monkeypatch, step):
    """Without a threshold given: users with the same products meet the others once; names are text; ids without a partner; null ids."""
    monkeypatch.setattr(cf, "ROWS", 16)
    monkeypatch.setattr(cf, "PIECE", (5, 7))
    weighted = cf._weighted
    monkeypatch.setattr(cf, "_weighted", lambda *x: weighted(*x, step))
    made = []
    keep = cf.kept
    monkeypatch.setattr(cf, "kept", lambda df, name: made.append((name, out := keep(df, name))) or out)
    sets = {f"u{u}": {f"p{p}" for p in s} for u, s in _sets(4).items()}
    r = random.Random(5)
    count = {(u, p): r.randint(1, 3) for u in sorted(sets) for p in sorted(sets[u])}
    at = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(u, p, "AT_Purchase", at) for (u, p), n in count.items() for _ in range(n)], "user_id string, product_id string, action_type string, ts timestamp_ntz")
    pairs = [(u, p) for u in [*sorted(sets)[::3], "new", None] for p in ("p0", "p1", "p7", "p30", "p95", "new", None)]
    got = {(x.user_id, x.product_id): x.cf_score for x in cf.memory_cf(log, spark.createDataFrame(pairs, "user_id string, product_id string"), {}).collect()}
    assert got.keys() == set(pairs)
    products = {p for s in sets.values() for p in s}
    for u, p in pairs:
        if u not in sets or p not in products:
            assert got[u, p] is None
        else:
            assert got[u, p] == pytest.approx(sum(len(sets[u] & s) / len(sets[u] | s) * count[v, p] for v, s in sets.items() if p in s), rel=1e-12)
    frames = dict(made)
    assert "counts" not in frames
    assert frames["baskets"].count() == len({frozenset(s) for s in sets.values()}) < len(sets)
