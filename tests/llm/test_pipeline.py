from __future__ import annotations

import random

from data import SF, WORD, frame

import corpus_pipeline
from llm import mixing, quality, simhash


def test_stages(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    docs = [df]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs[-1], SF)
        docs.append(spark.createDataFrame(out.collect(), out.schema))
        if name != "pack":
            assert docs[-1].columns == df.columns
    n = [d.count() for d in docs]
    assert n[0] > n[1] >= n[2] >= n[3]
    assert {r.doc_id for r in docs[1].collect()} == {r.doc_id for r in quality.judged(df).filter("kept").collect()}
    # one document of each component is left
    left = simhash.near_duplicates(docs[2]).select("component_id").distinct().count()
    assert n[3] == left
    assert docs[5].agg({"length": "sum"}).first()[0] > 0
    copies = docs[4].groupBy("doc_id").count().agg({"count": "max"}).first()[0]
    assert copies <= 2


def test_pipeline_on_odd_rows(spark):
    docs = frame(spark)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        docs = spark.createDataFrame(out.collect(), out.schema)
    empty = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SF)
        empty = spark.createDataFrame(out.collect(), out.schema)
    assert empty.count() == 0


def test_near_dedup_finds_what_is_alike_by_shingles_of_five_words(spark):
    r = random.Random(6)
    sets = lambda t: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(max(1, len(w) - 4))}
    docs = []
    for i in range(60):
        words = [f"w{r.randrange(3000)}" for _ in range(r.randint(120, 300))]
        docs.append((2 * i, " ".join(words)))
        # up to about one word in 25, so that pairs lie on both sides of 0.8
        for at in r.sample(range(len(words)), r.randint(1, len(words) // 25)):
            words[at] = "other"
        docs.append((2 * i + 1, " ".join(words)))
    alike = [len(sets(a[1]) & sets(b[1])) >= 0.8 * len(sets(a[1]) | sets(b[1])) for a, b in zip(docs[::2], docs[1::2], strict=True)]
    assert 10 < sum(alike) < 55
    docs += [(200, docs[0][1]), (201, None), (202, " "), (203, "ab"), (204, "AB")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    left = {x.doc_id for x in corpus_pipeline.near_dedup(spark, df, SF).collect()}
    assert {*range(0, 120, 2), 201, 203} <= left and not left & {200, 202, 204}
    assert sum((2 * i + 1 in left) == a for i, a in enumerate(alike)) <= 1 and all(2 * i + 1 in left for i, a in enumerate(alike) if not a)  # MinHash may miss a pair


def test_near_dedup_takes_candidates_from_fingerprints(spark, monkeypatch):
    from llm import near_dedup

    r = random.Random(12)
    docs = []
    for i in range(40):
        words = [f"w{r.randrange(3000)}" for _ in range(400)]
        docs.append((2 * i, " ".join(words)))
        docs.append((2 * i + 1, " ".join([*words[:-1], "other"])))  # one shingle of 396 is another
    # fingerprints that a repeated phrase decides, of sets that are not alike
    phrase = [f"p{k}" for k in range(11)] * 60
    docs += [(100 + k, " ".join(phrase + [f"{k}q{x}" for x in range(30)])) for k in range(2)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    fp = {x.doc_id: x.fp for x in simhash.fingerprints(df, 5).collect()}
    apart = lambda a, b: ((fp[a] ^ fp[b]) & (1 << 64) - 1).bit_count()
    near = {2 * i + 1 for i in range(40) if apart(2 * i, 2 * i + 1) <= 3}
    assert len(near) > 20 and apart(100, 101) <= 3
    # no bands: what goes is found by fingerprints alone
    none = spark.createDataFrame([], "kind int, a long, b long")
    monkeypatch.setattr(near_dedup, "meetings", lambda *_: none)
    left = {x.doc_id for x in corpus_pipeline.near_dedup(spark, df, SF).collect()}
    assert left == {i for i, _ in docs} - near


def _united(items, alike):
    parent = {x: x for x in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(items):
        for b in items[k + 1 :]:
            if alike(a, b):
                parent[find(b)] = find(a)
    return {x: find(x) for x in items}


def test_dedup_stages_against_brute_force(spark):
    r = random.Random(9)
    vocabulary = [f"{r.choice('abcdefg')}{r.randrange(400)}{r.choice('xyz')}" for _ in range(500)]
    line = lambda: [r.choice(vocabulary) for _ in range(r.randint(8, 30))]
    shared, docs = [line() for _ in range(12)], []
    for i in range(50):
        lines = []
        for _ in range(r.randint(1, 6)):
            words = list(r.choice(shared) if r.random() < 0.4 else line())
            if r.random() < 0.3:
                words[r.randrange(len(words))] = r.choice(vocabulary)
            lines.append(" ".join(words))
        docs.append((i, "\n".join(lines)))
    for i in range(50, 60):
        words = docs[i - 50][1].split(" ")
        words[r.randrange(len(words))] = "other"
        docs.append((i, " ".join(words)))
    docs += [(60, docs[3][1]), docs[4]]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    jaccard = lambda a, b: len(a & b) >= 0.8 * len(a | b)

    grams = {x: {x[k : k + 5] for k in range(len(x) - 4)} or {x} for _, t in docs for x in t.split("\n")}
    root = _united(sorted(grams), lambda a, b: jaccard(grams[a], grams[b]))
    seen, want = set(), {}
    for i, t in sorted(set(docs)):
        kept = []
        for x in t.split("\n"):
            if root[x] not in seen:
                kept.append(x)
            seen.add(root[x])
        if kept:
            want[i] = "\n".join(kept)
    got = {x.doc_id: x.text for x in corpus_pipeline.dedup_lines(spark, df, SF).collect()}
    assert got == want

    words = {t: (lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})(t.lower().split()) for _, t in docs}
    root = _united(sorted(words), lambda a, b: jaccard(words[a], words[b]))
    first = {}
    for i, t in sorted(docs):
        first.setdefault(root[t], i)
    left = [x.doc_id for x in corpus_pipeline.near_dedup(spark, df, SF).collect()]
    assert sorted(left) == sorted(first.values())


def test_mix_and_pack_stages(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    df = frame(spark)
    mixed = corpus_pipeline.mix_sources(spark, df, SF)
    rows = mixed.collect()
    taken = {}
    for x in rows:
        taken[x.source] = taken.get(x.source, 0) + len(WORD.findall(x.text or ""))
    made = {}
    for x in mixing.mix(df).collect():
        target, most = made.get(x.source, (x.target, 0))
        made[x.source] = target, max(most, x["size"])
    assert all(abs(taken.get(s, 0) - target) <= most for s, (target, most) in made.items())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    n = sum(len(tokenizer.encode(x.text or "", add_special_tokens=False).ids) + 1 for x in rows)
    packed = corpus_pipeline.pack(spark, spark.createDataFrame(rows, mixed.schema), SF).collect()
    assert sum(x.length for x in packed) == n
    assert len({x.sequence_id for x in packed}) <= -(-n // 4096) + 1
