"""Inputs that make linear names modulo 2^64 collide: words, lines and word sequences in the pattern of Thue and Morse."""

from __future__ import annotations

import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from test_operators import removed, words_of
from tokenizers import Tokenizer

from llm import common, line_dedup, packing, quality, substring_dedup, wavelet
from llm.textarrays import Ranges, Texts, times
from llm.tokens import Encoder

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
SIZES = [10, 11, 12, 14]


def thue_morse(k: int, one="a", two="b") -> tuple[list[str], list[str]]:
    """2^k symbols, and the same with the two symbols swapped."""
    bits = [i.bit_count() & 1 for i in range(1 << k)]
    return [(one, two)[b] for b in bits], [(two, one)[b] for b in bits]


def word_pair(k: int) -> tuple[str, str]:
    return tuple("".join(x) for x in thue_morse(k))


@pytest.mark.parametrize("k", SIZES)
def test_names_differ(k):
    a, b = word_pair(k)
    x = Texts.of([a, b, a, a + "c", b[:-1]])
    first, end = x.words()
    names = x.names(first, end)
    assert names[0] == names[2] and len(set(names.tolist())) == 4
    sequences = [np.array([ord(c) for c in s], np.uint64) for s in (a, b)]
    both = Ranges(np.concatenate(sequences))
    assert not both.equal(np.array([0]), np.array([1 << k]), np.array([1 << k]))[0]


def test_names_of_all_lengths():
    r = np.random.default_rng(3)
    texts = ["".join(r.choice(list("ab"), n)) for n in list(range(40)) * 6]
    x = Texts.of(texts)
    names = x.names(x.starts[:-1], x.starts[1:]).tolist()
    assert len(set(names)) == len(set(texts)) and {t: n for t, n in zip(texts, names, strict=True)} == dict(zip(texts, names, strict=True))


def test_products_and_ranges():
    r = np.random.default_rng(0)
    p = (1 << 61) - 1
    a, b = r.integers(0, p, 2000).astype(np.uint64), r.integers(0, p, 2000).astype(np.uint64)
    a[:3], b[:3] = [p - 1, 0, 1], [p - 1] * 3
    assert times(a, b).tolist() == [int(x) * int(y) % p for x, y in zip(a, b, strict=True)]
    s = r.integers(0, 3, 3000).astype(np.uint64)
    i = r.integers(0, 1400, 2000)
    j, n = i + r.integers(0, 1400, 2000), r.integers(0, 12, 2000)
    assert Ranges(s).equal(i, j, n).tolist() == [bool((s[x : x + k] == s[y : y + k]).all()) for x, y, k in zip(i, j, n, strict=True)]


@pytest.mark.parametrize("k", SIZES)
@pytest.mark.parametrize(("path", "words"), [(WORDS, True), (BYTES, False)])
def test_token_ids(k, path, words):
    a, b = word_pair(k)
    tokenizer = Tokenizer.from_file(path)
    texts = [a + " " + b, a, b, b + ". " + a]
    ids, counts = Encoder(path, words).encode(pa.array(texts))
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_packing_and_wavelet(spark):
    texts = [t for k in SIZES for t in word_pair(k)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for path, end, found in ((WORDS, 1, packing.pack(df, WORDS)), (BYTES, 2, wavelet.documents(wavelet.shards(df, BYTES)))):
        tokenizer, want = Tokenizer.from_file(path), Counter()
        for i, t in enumerate(texts):
            ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, end], "<u4")
            step = 4096 if end == 1 else len(ids)
            want.update((i, zlib.crc32(ids[k : k + step].tobytes())) for k in range(0, len(ids), step))
        assert Counter((r.doc_id, r.ids_crc32) for r in found.collect()) == want


def test_substring_dedup(spark):
    docs = []
    for k in SIZES[:3]:
        a, b = word_pair(k)
        docs += [f"{k} 1 2 3 4 5 {w} 6 7 8 9 10 11" for w in (a, b)]
        docs += [" ".join(x) for x in thue_morse(k, "yes", "no")]
    pairs = list(enumerate(docs))
    got = substring_dedup.remove_repeats(spark.createDataFrame(pairs, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == removed(pairs)
    assert [r.n_removed for r in sorted(got, key=lambda r: r.doc_id)[:2]] == [0, 0]


def test_quality():
    for k in SIZES:
        a, b = word_pair(k)
        assert quality.measure(Texts.of([a + "\n" + b]), 10)["n_dup_lines"].tolist() == [0]
        one, two = thue_morse(k, "yes", "no")
        head, tail = [f"h{i}" for i in range(12)], [f"t{i}" for i in range(3000)]
        w = head + one + tail + ["|"] + head + two + tail
        x = Texts.of([" ".join(w)])
        row = np.zeros(len(w), np.int64)
        found = quality.longest_repeats(x.names(*x.words()), row, 10)
        # the blocks differ in their first word and in their last
        assert found[0] == 12 and found[12 + len(one)] == 3000 and found[12:].max() == max(3000, 1 << (k - 1))


def test_line_dedup(spark):
    docs = [(10 * k + j, "\n".join([w, f"other line of {k} {j}"])) for k in SIZES[:3] for j, w in enumerate(word_pair(k))]
    names = sorted({x for _, t in docs for x in t.split("\n")})
    sets = {x: {x[k : k + 5] for k in range(len(x) - 4)} or {x} for x in names}
    alike = {(a, b) for a in names for b in names if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string"), shingle=5).collect()}
    seen, kept = [], {}
    for i, t in docs:
        lines = []
        for x in t.split("\n"):
            if not any((x, y) in alike for y in seen):
                lines.append(x)
            seen.append(x)
        kept[i] = "\n".join(lines)
    assert got == kept and all(words_of(t) or not t for t in got.values())


def test_recall_of_the_bands(spark):
    # every pair of lines of the table and of changed copies of them, by brute force
    import random

    r = random.Random(2)
    texts = [t for (t,) in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if t]
    lines = sorted({x for t in texts for x in t.split("\n") if len(x) > 30})[:700]
    for x in list(lines):
        w = list(x)
        for at in r.sample(range(len(w)), max(1, len(w) // 55)):
            w[at] = "#"
        lines.append("".join(w))
    x = Texts.of(lines)
    names, starts, n = line_dedup.shingles(x, x.starts[:-1], x.starts[1:], 5)
    bands = line_dedup.bands(names, starts, n)
    sets = [{t[k : k + 5] for k in range(len(t) - 4)} for t in lines]
    assert [set(names[a : a + k].tolist()) for a, k in zip(starts, n, strict=True)][0] and all(len(set(names[a : a + k].tolist())) == len(s) for a, k, s in zip(starts, n, sets, strict=True))
    where: dict[str, list[int]] = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    common = Counter((i, j) for some in where.values() for k, i in enumerate(some) for j in some[k + 1 :])
    alike = [(i, j) for (i, j), k in common.items() if k >= 0.8 * (len(sets[i]) + len(sets[j]) - k)]
    found = sum(bool((bands[i] == bands[j]).any()) for i, j in alike)
    assert len(alike) > 400 and found >= 0.99 * len(alike)


def test_folder_off_local_masters():
    none = SimpleNamespace(isDefined=lambda: False)
    context = lambda master: SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.shared_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=context(master)), "x")
    given = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: "hdfs://shared/folder/"), sparkContext=context("yarn"))
    assert common.shared_folder(given, "x").startswith("hdfs://shared/folder/x-")
    common._made.pop()
