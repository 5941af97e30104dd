"""Popular products and users of very many: the same numbers as plain sets, with bounded rows."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from basketrank.operators import cf


def _matrix(seed=1, users=60, products=40):
    r = random.Random(seed)
    rows = {(u, 0) for u in range(users)} | {(u, 1) for u in range(0, users, 2)} | {(3, p) for p in range(products)}
    rows |= {(r.randrange(users), r.randrange(2, products)) for _ in range(250)}
    return [(u, p, r.randint(1, 4)) for u, p in sorted(rows)]


@pytest.mark.parametrize("popular", [0, 10, 10**6])
@pytest.mark.parametrize("rows", [512, 7])
def test_overlaps(spark, monkeypatch, popular, rows):
    monkeypatch.setattr(cf, "ROWS", rows)
    monkeypatch.setattr(cf, "STRIPE", 2)
    m = _matrix()
    df = spark.createDataFrame(m, "user_id long, product_id long, cnt long")
    sets = {}
    for u, p, _ in m:
        sets.setdefault(u, set()).add(p)
    got = {(x.a, x.b): x.sim for x in cf.jaccard(df, popular).collect()}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if sets[a] & sets[b]}
    assert got == want
    every = {(x.a, x.b): x.npmi for x in cf.npmi(df, 10**6).collect()}
    some = {(x.a, x.b): x.npmi for x in cf.npmi(df, popular).collect()}
    assert every.keys() == some.keys() and all(abs(every[k] - some[k]) < 1e-12 for k in every)


def test_keys_as_text_and_many_bits(spark, monkeypatch):
    monkeypatch.setattr(cf, "BITS", 64)
    m = [(f"u{u}", f"p{p}") for u in range(12) for p in range(150) if (u * p) % 3 == 0]
    got = {(x.a, x.b): x.both for x in cf.overlaps(spark.createDataFrame(m, "u string, p string"), "u", "p", popular=2).collect()}
    sets = {}
    for u, p in m:
        sets.setdefault(u, set()).add(p)
    assert got == {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets}
    assert cf.overlaps(spark.createDataFrame([], "u string, p string"), "u", "p").collect() == []


@pytest.mark.parametrize(("popular", "rows"), [(0, 512), (10, 8), (25, 16), (10**6, 512)])
def test_memory_scores(spark, monkeypatch, popular, rows):
    """A product that all have bought among the wanted; unknown users and products; any threshold gives the same sums."""
    monkeypatch.setattr(cf, "ROWS", rows)
    m = _matrix(2)
    at = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(u, p, "AT_Purchase", at) for u, p, n in m for _ in range(n)], "user_id long, product_id long, action_type string, ts timestamp_ntz")
    pairs = sorted({(u, p) for u in [*range(0, 60, 4), 999] for p in (0, 1, 5, 9, 777)})
    t = spark.createDataFrame(pairs, "user_id long, product_id long")
    sets, count = {}, {}
    for u, p, n in m:
        sets.setdefault(u, set()).add(p)
        count[u, p] = n
    made = []
    keep = cf.kept
    monkeypatch.setattr(cf, "kept", lambda df, name: made.append((name, out := keep(df, name))) or out)
    got = {(x.user_id, x.product_id): x.cf_score for x in cf.memory_cf(log, t, {"popular": popular}).collect()}
    products = {p for _, p, _ in m}
    for u, p in pairs:
        if u not in sets or p not in products:
            assert got[u, p] is None
        else:
            want = sum(len(sets[u] & sets[v]) / len(sets[u] | sets[v]) * count[v, p] for v in sets if p in sets[v])
            assert got[u, p] == pytest.approx(want, rel=1e-5)
    # what the join of wanted pairs and buyers makes is bounded by the threshold
    (counts,) = [df for name, df in made if name == "counts"]
    assert counts.count() <= popular * len(pairs)
    if popular == 10:
        assert counts.filter("product_id in (0, 1)").isEmpty()
