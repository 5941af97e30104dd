"""Odd column names, stores by their schemes, the network against plain sums, targets by another way, what the limits on repeats catch."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from data import rows
from pyspark.sql import functions as F

from llm import common, language, line_dedup, mixing, quality, warc, wavelet


def odd(spark):
    some = [(i, t, 1, "x", [1], i) for i, t, *_ in rows()]
    return spark.createDataFrame(some, "doc_id long, text string, `a.b` int, `c``d` string, `e f` array<int>, n_words long").repartition(2)


def test_columns_of_any_name(spark):
    df = odd(spark)
    names = ["doc_id", "text", "a.b", "c`d", "e f"]
    got = quality.judged(df)
    assert got.columns == [*names, *quality.FIELDS, "base_failed", "kept"]
    plain = quality.judged(df.select("doc_id", "text"))
    same = lambda x: sorted(map(repr, x.select("doc_id", *quality.FIELDS, "kept").collect()))
    assert same(got) == same(plain) and {(r["a.b"], r["c`d"], tuple(r["e f"])) for r in got.collect()} == {(1, "x", (1,))}
    lines = line_dedup.deduplicated(df.drop("n_words"))
    assert lines.columns == [*names, "n_lines", "n_removed"]
    bare = line_dedup.deduplicated(df.select("doc_id", "text"))
    key = lambda x: sorted(map(repr, x.select("doc_id", "text", "n_lines", "n_removed").collect()))
    assert key(lines) == key(bare) and {r["c`d"] for r in lines.collect()} == {"x"}


@pytest.mark.parametrize(("uri", "asked"), [("s3a://bucket/a/b", "s3://bucket/a/b"), ("file:///tmp/x", "file:///tmp/x"), ("hdfs://name:8020/x", "hdfs://name:8020/x")])
def test_schemes_of_stores(monkeypatch, uri, asked):
    seen = []
    monkeypatch.setattr(common.pafs, "FileSystem", type("Fake", (), {"from_uri": staticmethod(lambda u: seen.append(u) or ("fs", u))}))
    assert common.store(uri) == ("fs", asked) and seen == [asked]


def test_stores_that_do_not_open_are_refused_before_any_job(spark, monkeypatch):
    monkeypatch.setattr(common, "shared_folder", lambda spark, name: f"strange://host/{name}")
    pages = spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string")
    with pytest.raises(ValueError, match="strange"):
        warc.archived(pages)
    with pytest.raises(ValueError, match="strange"):
        wavelet.shards(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "no file is read")


# ---- language
def small_network(x, y, seed=0):
    net = language.Network(["a", "b", "c"])
    r = np.random.default_rng(seed)
    for p in [net.bias, net.offset]:
        p += r.normal(0, 0.2, p.shape).astype(np.float32)
    return net


def plain_scores(net, x):
    """Each filter at each place, its largest sum, a dense layer: loops over windows, widths and places."""
    out = []
    for row in x:
        hidden = []
        for k, (w, table) in enumerate(zip(language.WIDTHS, net.filters, strict=True)):
            sums = np.array([sum(table[j, row[i + j]].astype(float) for j in range(w)) for i in range(language.WINDOW)])
            hidden.append(np.maximum(sums.max(axis=0) + net.bias[k * language.FILTERS : (k + 1) * language.FILTERS], 0))
        z = np.concatenate(hidden) @ net.dense + net.offset
        e = np.exp(z - z.max())
        out.append(e / e.sum())
    return np.array(out)


def test_scores_equal_a_plain_convolution():
    x = np.random.default_rng(1).integers(0, 256, (7, language.LOOK)).astype(np.uint8)
    x[0] = 32
    net = small_network(x, None)
    assert np.abs(net.scores(x, net.pairs()) - plain_scores(net, x)).max() < 1e-5


def test_gradients_equal_differences():
    r = np.random.default_rng(2)
    x, y = r.integers(60, 70, (5, language.LOOK)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    net = small_network(x, y)
    for name in ("bias", "dense", "offset"):
        setattr(net, name, getattr(net, name).astype(float))
    net.filters = [f.astype(float) for f in net.filters]
    loss = lambda: -np.log(plain_scores(net, x)[np.arange(5), y]).mean()
    grads = net._gradients(x, y)
    for p, g in zip([*net.filters, net.bias, net.dense, net.offset], grads, strict=True):
        places = [np.unravel_index(np.abs(g).argmax(), g.shape), *[tuple(r.integers(0, n) for n in g.shape) for _ in range(2)]]
        for at in places:
            before = p[at]
            p[at] = before + 1e-6
            up = loss()
            p[at] = before - 1e-6
            down = loss()
            p[at] = before
            assert abs((up - down) / 2e-6 - g[at]) < 1e-6


def test_training_does_not_depend_on_the_order_of_rows(spark):
    """Two texts under one id and language: the sample is in one order whatever comes first."""
    r = random.Random(3)
    word = lambda letters: "".join(r.choice(letters) for _ in range(5))
    some = [(i // 2, " ".join(word("abc" if i % 3 else "xyz") for _ in range(80)), "l1" if i % 3 else "l2") for i in range(60)]
    one, other = (language.learn(spark.createDataFrame(x, "doc_id long, text string, lang string").coalesce(1), epochs=1) for x in (some, some[::-1]))
    assert all(np.array_equal(a, b) for a, b in zip(one.filters, other.filters, strict=True)) and np.array_equal(one.dense, other.dense)


# ---- mixing
def poured(sizes, share, weights, most):
    """Targets by pouring: the level rises until all is shared, sources fill in proportion to their weights up to their limits."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = min(share, most) * sum(sizes.values())
    lo, hi = 0.0, 1e12
    for _ in range(300):
        level = (lo + hi) / 2
        lo, hi = (lo, level) if sum(min(most * sizes[s], level * weight[s]) for s in names) > total else (level, hi)
    return {s: min(most * sizes[s], hi * weight[s]) for s in names}


def test_targets_by_pouring():
    r = random.Random(4)
    for _ in range(200):
        names = r.sample(["a", "b", "B", "é", "zz", "Z", "0", "\U0001f600", "\uffff", None], r.randint(1, 8))
        sizes = {s: r.choice([0, 1, 10, 1000, 10**6]) for s in names}
        got, want = mixing.targets(sizes, 1.5, (5, 2, 1), 2.0), poured(sizes, 1.5, (5, 2, 1), 2.0)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-3 for s in sizes)


# ---- quality
def test_limits_on_repeats_catch_pasted_paragraphs(spark):
    """One paragraph pasted into clean text so that its copies cover a share of it. The base rule sees a share over a half only."""
    r = random.Random(5)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    cases, docs = [], []
    for size in (12, 25, 40, 120):
        for share in (0.05, 0.15, 0.22, 0.3, 0.45, 0.6):
            copies = max(2, round(share * 1000 / size))
            paragraph, rest = words(size), words(1000 - size * copies) if size * copies < 1000 else words(100)
            parts = [rest[k :: copies] for k in range(copies)]
            cases.append((size, copies * size / (copies * size + len(rest))))
            docs.append((len(docs), " ".join(w for p in parts for w in [*p, *paragraph])))
    got = {x.doc_id: x for x in quality.judged(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, (size, share) in enumerate(cases):
        much, long = share > quality.MAX_COVERED, size > quality.MAX_REPEAT and size > quality.MAX_REPEAT_SHARE * got[i].n_words
        assert abs(got[i].covered_words / got[i].n_words - share) < 0.02
        if abs(share - quality.MAX_COVERED) > 0.01 and abs(share - 0.5) > 0.02:
            assert got[i].kept == (not (share > 0.5 or much or long)), (size, share, got[i])
    caught = [c for i, c in enumerate(cases) if not got[i].kept and not got[i].base_failed]
    assert len(caught) >= 8 and any(share < quality.MAX_COVERED for _, share in caught)


def test_odd_arrow_names():
    assert common.quoted("a`b") == "`a``b`" and pa.schema([("a.b", pa.int32())]).names == ["a.b"] and F.col(common.quoted("a.b")) is not None


def test_components_of_edges_held_in_parts(spark, monkeypatch):
    """Partitions of more edges than a task holds: long chains, stars and repeated edges."""
    from llm import components as parts

    monkeypatch.setattr(parts, "HELD", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        r = random.Random(8)
        name = {i: r.getrandbits(60) for i in range(300)}
        edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 90)] + [(200 + i, 200 + r.randrange(90)) for i in range(60)] * 2
        df = spark.createDataFrame([(name[a], name[b]) for a, b in edges], "a long, b long").coalesce(2)
        got = {x.node: x.root for x in parts.components(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    label = {i: i for i in range(300)}
    for _ in range(300):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    for a, b in edges:
        assert (got.get(name[a]) == got.get(name[b])) and (a == b or name[a] in got)
    pairs = {label[a]: got.get(name[a]) for a, b in edges if a != b}
    assert len(set(pairs.values())) == len(pairs)


def test_one_text_far_beyond_a_slice(spark):
    """Some 6 MB in one row, beside short ones: op4's fingerprint and op5's counts of the whole text, by plain loops."""
    import xxhash

    from llm import simhash

    r = random.Random(9)
    vocabulary = [f"W{k}é" if k % 7 == 0 else f"w{k}" for k in range(50_000)]
    lines = [" ".join(r.choice(vocabulary) for _ in range(40)) for _ in range(20_000)]
    lines[500:700] = lines[:200]
    long = "\n".join(lines)
    assert len(long.encode()) > 3 * (3 << 19)
    df = spark.createDataFrame([(1, "short text of words"), (2, long), (3, None)], "doc_id long, text string").coalesce(1)
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in long.split()]
    bits = np.zeros(64, np.int64)
    n = len(words) - 2
    for k in range(0, n, 1 << 16):
        h = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(k, min(n, k + (1 << 16)))], np.uint64)
        bits += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    want = sum(1 << b for b in range(64) if 2 * bits[b] > n)
    got = {x.doc_id: x for x in simhash.near_duplicates(df).select("doc_id", simhash.hex_digits().alias("f")).collect()}
    assert got[2].f == f"{want:016x}" and got[3].f == "0" * 16
    seen = {x.doc_id: x for x in quality.judged(df).collect()}[2]
    whole = long.split()
    triples = {}
    for i in range(n):
        triples.setdefault((whole[i], whole[i + 1], whole[i + 2]), []).append(i)
    repeated = {x for at in triples.values() if len(at) > 1 for i in at for x in (i, i + 1, i + 2)}
    assert (seen.n_words, seen.word_chars, seen.n_dup_lines, seen.n_repeat_words) == (len(whole), sum(map(len, whole)), 200, len(repeated))
    assert seen.longest_repeat >= 200 * 40 and seen.kept == (not seen.base_failed and not seen.longest_repeat > quality.MAX_REPEAT_SHARE * len(whole) and seen.covered_words <= quality.MAX_COVERED * len(whole))
