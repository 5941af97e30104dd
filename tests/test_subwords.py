"""Vectors from character n-grams: gradients, pairs, misspelt names, several tasks."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketrank.operators import subwords, text


def test_pairs_of_words(spark):
    texts = ["a b c", "b", "", "x x y x z q r s t", None]
    df = spark.createDataFrame([(i, t.split(" ") if t is not None else None) for i, t in enumerate(texts)], "id int, words array<string>")
    want = Counter()
    for t in texts:
        w = t.split(" ") if t else []
        for i in range(len(w)):
            for j in range(max(0, i - subwords.NEAR), min(len(w), i + subwords.NEAR + 1)):
                if w[i] != w[j]:
                    want[w[i], w[j]] += 1
    assert {(r.word, r.context): r.n for r in subwords.pairs_of(df, "words").collect()} == dict(want)


def test_a_step_is_the_gradient_of_its_loss():
    dice = np.random.default_rng(0)
    t = subwords.Tables.start(4, 1)
    t.outer[:] = dice.normal(size=t.outer.shape)
    t.inner[:] = dice.normal(size=t.inner.shape)
    before = subwords.Tables(t.inner.astype(float).copy(), t.outer.astype(float).copy())

    def loss(tables):
        return -np.log(1 / (1 + np.exp(-_mean(tables, "milk") @ tables.outer[subwords.context("fresh")])))

    t.learn(["milk"], ["fresh"], np.array([1]), 1, 1e-3, np.random.default_rng(1))
    for row in subwords.grams("milk")[:3]:
        for d in range(2):
            up, down = (subwords.Tables(before.inner.copy(), before.outer) for _ in range(2))
            up.inner[row, d] += 1e-5
            down.inner[row, d] -= 1e-5
            # each n-gram takes the step of the whole word
            slope = (loss(up) - loss(down)) / 2e-5 * len(subwords.grams("milk"))
            assert abs((t.inner[row, d] - before.inner[row, d]) / 1e-3 + slope) < 2e-2 * max(1, abs(slope))


def _mean(tables, word):
    return np.mean([tables.inner[g] for g in subwords.grams(word)], axis=0)


def _names(seed, n=150):
    r = random.Random(seed)
    syllable = lambda: r.choice("bcdfghklmnprstvz") + r.choice("aeiou")
    word = lambda k: "".join(syllable() for _ in range(k))
    kinds = [[word(3) for _ in range(6)] for _ in range(8)]
    names = {" ".join([word(r.randint(3, 4)), *r.sample(kinds[i % 8], 2)]) for i in range(n)}
    return sorted(names), r


def _misspelt(name, r):
    k = r.randrange(len(name))
    while name[k] == " ":
        k = r.randrange(len(name))
    c = r.choice("abcdefghijklmnopqrstuvwxyz")
    return r.choice([name[:k] + name[k + 1 :], name[:k] + c + name[k:], name[:k] + c + name[k + 1 :]])


@pytest.mark.parametrize("share", [10**6, 300])
def test_misspelt_names_are_near_their_own(spark, share):
    """One letter dropped, added or replaced somewhere in a product's name: its vector is nearest to that of the name meant. Whole
    words hashed find far fewer."""
    names, r = _names(3)
    wrong = [_misspelt(n, r) for n in names]
    cut = lambda rows: spark.createDataFrame(rows, "id int, name string").select("id", F.split("name", " ").alias("words"))
    right = cut(list(enumerate(names))).repartition(3)
    tables = subwords.trained(right, "words", size=32, share=share)
    of = lambda df: np.array([x.vector for x in sorted(subwords.text_vectors(df, "id", "words", tables).collect(), key=lambda x: x.id)])
    a, b = of(right), of(cut(list(enumerate(wrong))))
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    rate = float(np.mean((b @ a.T).argmax(axis=1) == np.arange(len(names))))
    print("rate", rate)
    assert rate > 0.9
    # words of one kind, which stand together, are nearer than words of others
    kinds = [n.split(" ")[1:] for n in names]
    v = {w: x / np.linalg.norm(x) for w, x in zip(*(lambda ws: (ws, tables.words(ws)))(sorted({w for k in kinds for w in k})), strict=True)}
    same = np.mean([v[k[0]] @ v[k[1]] for k in kinds])
    other = np.mean([v[k[0]] @ v[q[1]] for k, q in zip(kinds, kinds[1:], strict=False) if not set(k) & set(q)])
    assert same > other + 0.1
    again = subwords.trained(right, "words", size=32, share=share)
    assert np.allclose(again.inner, tables.inner, atol=1e-5)


def test_texts_without_words(spark):
    df = spark.createDataFrame([(1, "Milk fresh"), (2, " "), (3, None), (4, "x" * 5000), (5, "milk Fresh"), (6, "milk fresh")], "k int, t string")
    got = {x.k: np.array(x.vector) for x in text.embed(df, "k", "t", "subwords", 8).collect()}
    assert len(got) == 6 and all(len(v) == 8 for v in got.values())
    assert not got[2].any() and not got[3].any() and np.allclose(got[1], got[6]) and np.allclose(got[1], got[5])
    assert text.embed(df.limit(0), "k", "t", "subwords", 8).collect() == []
