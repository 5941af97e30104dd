"""op11, op12 and op13 against brute force, and what their methods promise."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from data import SF, frame, rows

from llm import hard_negatives as hard
from llm import pii, variants
from llm.common import table
from llm.queries import queries


# ---- spelling variants
def small(run: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)


def counted(texts, misspell=97):
    out = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = small(run)
            h = zlib.crc32(f"{doc_id}:{word}".encode()) if doc_id is not None else 1
            if misspell and h % misspell == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            out[word] += 1
    return out


def one_apart(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(counts, least=3, length=5, ratio=2):
    words = {w: n for w, n in counts.items() if n >= least and len(w) >= length}
    by = defaultdict(list)
    for w in words:
        by[len(w)].append(w)
    near = {w: [x for d in (-1, 0, 1) for x in by[len(w) + d] if one_apart(w, x)] for w in words}
    form = {}
    for w in words:
        top = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = top if top is not None and words[top] >= ratio * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return Counter((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def test_variants_of_the_small_table(spark):
    got = Counter(map(tuple, queries()["op11_variants"](spark, SF).collect()))
    texts = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert got == expected(counted(texts))
    assert sum(1 for r in got if r[1]) > 100


@pytest.mark.parametrize("letters", ["ab", "abcdé", "abcdefghijklmnopqrstuvwxyz"])
def test_variants_of_random_words(spark, letters):
    """Few letters give repeated bigrams and ties in the order; many give rare ones."""
    r = random.Random(len(letters))
    words = set()
    while len(words) < 400:
        w = [r.choice(letters) for _ in range(r.randint(4, 9))]
        words.add("".join(w))
        for _ in range(2):
            x = list(w)
            k = r.randrange(len(x))
            x[k : k + r.randint(0, 1)] = r.choice(["", r.choice(letters), r.choice(letters)])
            words.add("".join(x))
        if letters == "ab" and len(words) > 300:
            break
    counts = {w: r.randint(1, 40) for w in words if len(w) >= 4}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = Counter(map(tuple, variants.forms(df, variants.near_pairs(df)).collect()))
    assert got == expected(counts, least=1, length=4)


def test_variants_of_odd_rows(spark):
    texts = [(i, t) for i, t, *_ in rows()] + [(1, "Straße STRASSE Straßen straße × ÷÷÷÷÷ ÀÀÀÀÀ ààààà"), (2, "straße Straße straßen straßen" * 2), (None, "straße " * 97)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = Counter(map(tuple, variants.variants(df, least=2, misspell=3).collect()))
    assert got == expected(counted(texts, 3), least=2)
    assert variants.variants(df.limit(0)).collect() == []
    assert Counter(map(tuple, variants.variants(frame(spark)).collect())) == expected(counted([(i, t) for i, t, *_ in rows()], None))
    with pytest.raises(ValueError):
        variants.variants(df, length=3)


def test_pivots_are_the_cheapest_disjoint_bigrams():
    r = random.Random(1)
    for _ in range(300):
        places = sorted(r.sample(range(12), r.randint(2, 6)))
        costs = [r.randint(1, 9) for _ in places]
        pairs = [(costs[i] + costs[j], [places[i], places[j]]) for i in range(len(places)) for j in range(i + 1, len(places)) if places[j] - places[i] >= 2]
        got = variants.disjoint(places, costs)
        assert (not pairs and not got) or (sum(costs[places.index(p)] for p in got) == min(pairs)[0] and got[1] - got[0] >= 2)


# ---- hard negatives
def brute(vectors, every=100, k=5):
    some = {(i, lab, tuple(float(np.floor(256 * np.float64(x))) for x in v)) for i, lab, v in vectors if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    some = [(i, lab, [int(x) for x in v]) for i, lab, v in some]
    out = Counter()
    last = 1 << 63
    for i, lab, v in some:
        if i is None or i % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), j if j is not None else last, m == lab) for j, m, w in some if j != i)
        for s, p in [(-s, j) for s, j, same in scores if same][:k]:
            fit = [(-t, j) for t, j, same in scores if not same and 80 * s <= -100 * t <= 100 * s][:k]
            for rank, (t, j) in enumerate(fit, 1):
                out[(i, p if p != last else None, rank, j if j != last else None, s, t)] += 1
    return out


def of(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id long, label int, embedding array<double>")
    from pyspark.sql import functions as F

    return Counter(tuple(r) for r in hard.hard_negatives(df.withColumn("key", F.lit(1)), "vec_id", F.col("label"), "embedding").collect())


@pytest.mark.parametrize("block", [1024, 8])
def test_hard_negatives(spark, monkeypatch, block):
    """Clusters, ties and equal vectors; small blocks make a deep tree with many leaves, stripes and chunks."""
    monkeypatch.setattr(hard, "BLOCK", block)
    monkeypatch.setattr(hard, "CHUNK", 1024 if block > 8 else 3)
    dice = np.random.default_rng(block)
    centres = dice.normal(size=(6, 5))
    vectors = [(n, int(dice.integers(3)), (centres[n % 6] + 0.05 * dice.normal(size=5) * (n % 4)).round(2).tolist()) for n in range(900)]
    vectors += [(5, 1, [0.5] * 5), (5, 1, [0.5] * 5), (5, 2, [0.25] * 5), (None, 1, [0.5, 1.0, 0.0, 0.0, 0.0]), (100, 0, [1.0, 2.0]), (1000, 1, [0.0] * 5), (1100, None, [1.0] * 5)]
    vectors += [(1200, 1, None), (1300, 2, [1.0, None, 2.0, 3.0, 4.0]), (1400, 2, [float("nan")] * 5), (1500, 0, [float("inf")] * 5), (1600, 2, []), (1700, 0, [-0.0] * 5)]
    full = [(i, lab, None if v is None else [*v, *[0.0] * (5 - len(v))]) for i, lab, v in vectors]
    got = of(spark, vectors)
    assert got == brute(full) and len(got) > 50


def test_hard_negatives_of_few_rows(spark):
    assert of(spark, [(1, 1, [1.0])][:0]) == Counter()
    assert of(spark, [(1, 1, [1.0])]) == Counter()
    assert of(spark, [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9])]) == brute([(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9])])
    same = [(n, n % 2, [1.0, 1.0]) for n in range(300)]
    assert of(spark, same) == brute(same)


def test_scores_beyond_doubles():
    a = np.array([[2.0**40, 1.0], [3.0, -(2.0**39)]])
    b = np.array([[2.0**30, 1.0], [3.0, -(2.0**30)]])
    want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b.tolist()] for r in b.tolist()]
    assert hard.products(b, b).tolist() == want
    with pytest.raises(OverflowError):
        hard.products(a, a)


def test_tree_passes_over_siblings(spark):
    """Clustered rows: anchors reach few leaves, and every row that a window holds lies in one that is reached."""
    dice = np.random.default_rng(5)
    centres = dice.normal(size=(40, 8))
    v = np.floor(256 * (centres[np.arange(4000) % 40] + 0.02 * dice.normal(size=(4000, 8))))
    square = (v * v).sum(axis=1).max() * (1 + 1e-12)
    tree = hard.Tree(v[::4], square, 2)
    leaf = tree.leaves(v)
    low, high = ([np.full((16**k, 16, 16), np.nan) for k in range(2)] for _ in range(2))
    points = hard.longer(v, square)
    for k in range(2):
        child = leaf // 16 ** (1 - k)
        for c in np.unique(child):
            d = tree.apart(points[child == c], k, np.full((child == c).sum(), c // 16))
            low[k][c // 16, c % 16], high[k][c // 16, c % 16] = d.min(axis=0), d.max(axis=0)
    import pyarrow as pa

    anchors = v[:50]
    score = hard.products(anchors, v)
    top = np.sort(score, axis=1)[:, -20]
    batch = pa.RecordBatch.from_pydict({"key": np.arange(50), "v": anchors.tolist(), "lo": top[:, None].tolist(), "hi": (top[:, None] * 0 + hard.HIGH).tolist()})
    visits = [tuple(x) for b in hard.search(batch, tree, low, high, 8) for x in zip(b.column("key").to_pylist(), b.column("leaf").to_pylist())]
    reached = set(visits)
    assert len(reached) == len(visits) < 0.3 * 50 * len(np.unique(leaf))
    for i, j in zip(*np.nonzero(score >= top[:, None])):
        assert (i, leaf[j]) in reached


# ---- personal data
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, text):
    digits = [int(c) for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


def check_base(got, docs):
    want = []
    for doc_id, text in docs:
        spans = plain_spans(text)
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((doc_id, *[sum(s[0] == k for s in spans) for k in BASE], hashlib.sha256(shown.encode()).hexdigest()))
    assert Counter(tuple(r)[:6] for r in got) == Counter(want)


def test_base_spans(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    got = queries()["op13_personal_data"](spark, SF).collect()
    check_base(got, docs)
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) > 5
    odd = [
        "", None, "a@b.c_d@e.f@g.h", "x@y", "@a.b", "a@@b.c", "é.a@b.co.uk.", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.004 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1111", "4111111111111112",
        "+1 (017) 555-7713 +49 30 1234567+1 234 567 8901", "++1 23456789 +1 23", "9" * 3000, "1." * 500, "a" * 5000 + "@", "x" * 3000 + "@y.z", "0000 0000 0000 0000", "ü+12 345 678 90é", "1" * 13 + " " + "1" * 13, "+1" + " " * 900 + "2",
    ]
    r = random.Random(2)
    odd += ["".join(r.choice("a1.@+-( )9 0:é\n") for _ in range(60)) for _ in range(300)]
    texts = list(enumerate(odd)) + [(3, odd[6]), (None, odd[6])]
    check_base(pii.found(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect(), texts)
    check_base(pii.found(frame(spark)).collect(), [(i, t) for i, t, *_ in rows()])
    assert pii.found(frame(spark).limit(0)).collect() == []


def test_contexts_find_unseen_identifiers(spark):
    """Seeds teach "reach me:", whose finds teach "ring"; chance contexts, and rare shapes without context, stay out."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    filler = lambda n: " ".join(r.choice(["of", "the", word()]) for _ in range(n))
    number = lambda: f"({r.randint(100, 999)}) 555-{r.randint(1000, 9999)}"
    docs, wanted = [], {}
    for i in range(60):
        docs.append(f"{filler(20)} reach me: +1 {number()} {filler(20)}")
    shared = [number() for _ in range(12)]
    for n in shared:
        docs.append(f"{filler(9)} Reach me: {n} {filler(9)}")
        wanted[len(docs) - 1] = n
    for n in shared:
        docs.append(f"{filler(9)} ring {n}, {filler(9)}")
        wanted[len(docs) - 1] = n
    for _ in range(2):
        n = number()
        docs.append(f"{filler(9)} ring {n} {filler(9)}")
        wanted[len(docs) - 1] = n
    clean = len(docs)
    for _ in range(60):
        docs.append(f"{filler(30)} of {number()} the {filler(30)}")
    for _ in range(40):
        docs.append(f"{filler(30)} of +1 {number()} the {filler(30)}")
    docs.append(None)
    got = {x.doc_id: x for x in pii.found(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)).collect()}
    assert len(got) == len(docs)
    check_base(got.values(), list(enumerate(docs)))
    for i, n in wanted.items():
        at = docs[i].index(n)
        assert got[i].spans == f"phone:{at}:{at + len(n)}", (i, docs[i], got[i])
    assert all(got[i].n_added == 0 for i in range(clean, len(docs)))
    for i in range(60):
        assert got[i].n_added == 0 and got[i].n_phone == 1


def test_spelt_addresses(spark):
    r = random.Random(9)
    name = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    docs = [f"please {name()} write to: {name()}@{name()}.org or not" for _ in range(20)]
    docs += [f"please {name()} write to: {name()} at {name()} dot org or not" for _ in range(5)]
    docs += [f"we met at {name()} dot org" for _ in range(3)]
    got = {x.doc_id: x for x in pii.found(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    for i in range(20, 25):
        a = docs[i].index("to: ") + 4
        assert got[i].spans == f"email:{a}:{docs[i].index(' or not')}"
    assert all(got[i].spans == "" for i in range(25, 28))


def test_scores_of_patterns_by_hand(spark):
    """One round: confidence is known instances over all and one more, an instance doubts by the product."""
    edges = [(3, 7, i, True, 1) for i in range(6)] + [(3, 7, 90, False, 2), (3, 8, 90, False, 1)] + [(3, 8, i, True, 1) for i in range(10, 15)] + [(3, 9, 91, False, 1)] + [(3, 9, i, True, 1) for i in range(5)]
    e = spark.createDataFrame(edges, "kind int, name long, instance long, known boolean, n long")
    occurs = spark.createDataFrame([(7, 9), (8, 12), (9, 1000)], "name long, places long")
    got = pii.accepted(e, occurs, rounds=1, accept=0.5).collect()
    assert [(x.kind, x.instance) for x in got] == [(3, 90)] and abs(got[0].score - (1 - (1 - 6 / 8) * (1 - 5 / 7))) < 1e-9
