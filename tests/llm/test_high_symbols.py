"""op1: high symbols settle the inside of long repeats, and the result stays that of brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from llm import substring_dedup
from llm.substring_dedup import Words


def removed(docs, window=13):
    first = {}
    for i, text in docs:
        w = text.split(" ")
        for k in range(len(w) - window + 1):
            first[tuple(w[k : k + window])] = min(i, first.get(tuple(w[k : k + window]), i))
    out = Counter()
    for i, text in docs:
        w, gone = text.split(" "), set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()] += 1
    return out


def copies(seed, letters=10**6, lengths=(40, 90, 300), docs=40):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(letters)}"
    passages = [[word() for _ in range(n)] for n in lengths for _ in range(3)]
    out = []
    for i in range(docs):
        text = [word() for _ in range(r.randint(5, 60))]
        for p in r.sample(passages, 3):
            lo, hi = sorted(r.sample(range(len(p) + 1), 2)) if r.random() < 0.3 else (0, len(p))
            text += p[lo:hi] + [word() for _ in range(r.randint(1, 30))]
        out.append((i, " ".join(text)))
    return out


@pytest.mark.parametrize(("seed", "letters"), [(1, 10**6), (2, 3), (3, 1), (4, 30)])
def test_long_repeats_by_brute_force(spark, seed, letters):
    docs = copies(seed, letters)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = Counter(tuple(x) for x in substring_dedup.remove_repeats(df).collect())
    assert got == removed(docs)


def test_symbols_settle_most_windows():
    """The three questions by hand, over all documents at once: names asked about against words covered."""
    docs = copies(7)
    batch = pa.RecordBatch.from_pydict({"text": [t for _, t in docs]})
    w = Words(batch, 13)
    names, row = w.phrases()
    where = {}
    for n, i in zip(names.tolist(), row.tolist(), strict=True):
        where.setdefault(n, set()).add(i)
    at = w.candidates(np.array([len(where[n]) > 1 for n in names.tolist()]))
    high, first, size = w.high(at)
    # equal names are equal words
    texts = {}
    words = [x for _, t in docs for x in t.split(" ")]
    for n, a, k in zip(high.tolist(), first.tolist(), size.tolist(), strict=True):
        assert texts.setdefault(n, words[a : a + k]) == words[a : a + k] and w.row[a] == w.row[a + k - 1]
    assert size.min() >= 13 and size.max() > 60
    low = {}
    for n, i in zip(high.tolist(), w.row[first].tolist(), strict=True):
        low[n] = min(i, low.get(n, i))
    known = np.array([low[n] < i for n, i in zip(high.tolist(), w.row[first].tolist(), strict=True)])
    done = w.settled(at, first[known], size[known])
    seen = {}
    for a in range(len(words) - 12):
        if w.row[a] == w.row[a + 12]:
            seen.setdefault(tuple(words[a : a + 13]), int(w.row[a]))
    assert all(seen[tuple(words[a : a + 13])] < w.row[a] for a in at[done].tolist())
    covered = sum(k[2] for k in removed(docs))
    later = [a for a in at[~done].tolist() if seen[tuple(words[a : a + 13])] < w.row[a]]
    # of the windows that lie in earlier documents few are named; the rest are first places
    print(len(later), known.sum(), done.sum(), covered)
    assert len(later) < 0.4 * (len(later) + done.sum()) and len(later) + known.sum() < 0.6 * covered


def test_a_passage_in_every_slice_is_asked_about_a_few_times(spark, monkeypatch):
    """Slices of some documents each; one passage stands in all of them. Tasks remember it, and results stay right."""
    import llm.membership as membership
    import llm.textarrays as textarrays
    from pyspark.sql import functions as F

    r = random.Random(11)
    word = lambda: f"w{r.randrange(10**6)}"
    passage = [word() for _ in range(40)]
    docs = [(i, " ".join([word() for _ in range(30)] + (passage if i % 3 else []) + [word() for _ in range(20)])) for i in range(400)]
    monkeypatch.setattr(textarrays, "SLICE_BYTES", 2000)
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)
    sent = []
    real = membership.map_slices

    def counted(frame, f, schema, *columns, **options):
        out = real(frame, f, schema, *columns, **options)
        if schema.startswith("kind int, bucket int, slice long"):
            asked = Counter(n for x in out.filter("kind = 0").select("names").collect() for n in np.frombuffer(x.names, np.uint64).tolist())
            extra = Counter(n for x in out.filter("kind = 0").select("extra").collect() for n in np.frombuffer(x.extra, np.uint64).tolist())
            slices = out.filter("kind = 1").select("slice").distinct().count()
            sent.append((max(asked.values()), max(extra.values(), default=0), slices, out.rdd.getNumPartitions()))
        return out

    monkeypatch.setattr(membership, "map_slices", counted)
    got = Counter(tuple(x) for x in substring_dedup.remove_repeats(df).collect())
    assert got == removed(docs)
    # phrases, symbols, windows: no name comes from every slice, but from a task until it is met again or with ever smaller ids
    assert len(sent) == 3
    for asked, extra, slices, tasks in sent:
        assert slices > 90 and asked <= 12 * tasks and extra <= 2 * tasks, sent
    known = membership.Returning()
    total = 0
    for slice_ in range(50):
        names = np.sort(np.array([5, 10**6 + slice_, 10**7 + slice_], np.uint64))
        ids = np.full(3, slice_, np.int64)
        low, high, fresh = known.meet(names, ids, ids)
        total += int(fresh.sum()) + int((low == high).sum() - 2 >= 1)
        assert (low[0], high[0]) == (0, slice_) and fresh[0] == (slice_ == 1)
    assert len(known.names) == 1
