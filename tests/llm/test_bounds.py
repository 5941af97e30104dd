from __future__ import annotations

import random

import numpy as np

from llm import line_dedup
from llm.textarrays import Texts


def test_bounds_lose_no_similar_pair_and_spare_most_others():
    r = random.Random(4)
    lines = ["a", "abcd", "a" * 9000]
    for _ in range(60):
        base = [r.choice("abcdefghijé ") for _ in range(r.choice([3, 8, 40, 300, 9000]))]
        lines.append("".join(base))
        for _ in range(3):
            for at in r.sample(range(len(base)), max(1, len(base) // r.choice([20, 40, 60]))):
                base[at] = r.choice("klmn")
            lines.append("".join(base))
    x = Texts.of(lines)
    cut = line_dedup.shingles(x, x.starts[:-1], x.starts[1:], 5)
    i, j = (k.astype(np.int64) for k in np.triu_indices(len(lines), 1))
    sets = [{t[k : k + 5] for k in range(len(t) - 4)} or {t} for t in lines]
    want = np.array([len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)])
    bits = line_dedup.marks(cut)
    may = line_dedup.possible(bits, cut[2], i, j, 0.8)
    assert want.sum() > 30 and not (want & ~may).any()
    # lines of a few hundred characters that are nearly alike enough cost no exact comparison
    close = np.array([200 < min(len(sets[a]), len(sets[b])) < 400 and 0.5 < len(sets[a] & sets[b]) / len(sets[a] | sets[b]) < 0.7 for a, b in zip(i.tolist(), j.tolist(), strict=True)])
    assert close.sum() >= 5 and may[close].sum() == 0
    got = np.zeros(len(i), bool)
    got[line_dedup.alike(cut, bits, i, j, 0.8)] = True
    assert (got == want).all()


def test_short_lines_that_end_otherwise_stay(spark):
    docs = [(i, f"ab{i}\nx{i}\n{'cd' * 2}") for i in range(1, 9)]
    got = {x.doc_id: x.text for x in line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string"), shingle=line_dedup.FINE).collect()}
    assert got == {i: f"ab{i}\nx{i}" + ("\ncdcd" if i == 1 else "") for i in range(1, 9)}


def test_bands_of_up_to_three_lines_are_settled_by_pairs(spark):
    r = random.Random(7)
    lines = []
    for size in (1, 2, 3, 4, 5, 9) * 6:
        base = [r.choice("abcdefghijklmnopq ") for _ in range(200)]
        for _ in range(size):
            lines.append("".join(base))
            base = list(lines[-1])
            base[r.randrange(200)] = r.choice("rstuvw")
    docs = spark.createDataFrame([(line,) for line in lines], "text string").repartition(5)
    x = Texts.of(lines)
    names = x.names(x.starts[:-1], x.starts[1:]).view(np.int64).tolist()
    bands: dict[int, set[int]] = {}
    for name, own in zip(names, line_dedup.bands(*line_dedup.shingles(x, x.starts[:-1], x.starts[1:], 5)).tolist(), strict=True):
        for band in own:
            bands.setdefault(band, set()).add(name)
    met = line_dedup.meetings(docs, len(lines), 5).collect()
    pairs = {(m.a, m.b) for m in met if m.kind == line_dedup.PAIR}
    small = [s for s in bands.values() if 1 < len(s) <= 3]
    assert sum(len(s) == 3 for s in small) > 20 and all((a, b) in pairs for s in small for a in s for b in s if a < b)
    members: dict[int, set[int]] = {}
    for m in met:
        if m.kind == line_dedup.MEMBER:
            members.setdefault(m.a, set()).add(m.b)
    # larger bands are there whole, smaller ones are not
    large = sorted(sorted(s) for s in bands.values() if len(s) > 3)
    assert len(large) > 20 and sorted(map(sorted, members.values())) == large
    assert {b for s in bands.values() if len(s) > 1 for b in s} == {n for p in pairs for n in p}


def test_places_of_values_that_occur_more_than_once():
    r = np.random.default_rng(3)
    for n, top in ((0, 1), (1, 1), (2, 1), (1000, 700), (5000, 1 << line_dedup.KEPT)):
        values = r.integers(0, top, n, dtype=np.uint64)
        found, count = np.unique(values, return_counts=True)
        assert sorted(line_dedup._several(values).tolist()) == np.flatnonzero(np.isin(values, found[count > 1])).tolist()


def test_signatures_are_least_values_of_each_line():
    lines = ["abcdefg", "x", "a longer line é of it", "y" * 50, "a longer line of it"]
    x = Texts.of(["".join(lines)])
    end = np.cumsum([len(t.encode()) for t in lines])
    names, starts, n = line_dedup.shingles(x, np.r_[0, end[:-1]], end, 5)
    got = line_dedup.signatures(names, starts, n)
    for k in range(line_dedup.PERMUTATIONS):
        flip, odd = line_dedup._FLIPS[k % len(line_dedup._FLIPS)], line_dedup._ODD[k]
        assert got[k].tolist() == [min(((int(v) >> 32) ^ int(flip)) * int(odd) & 0xFFFFFFFF for v in names[a : a + c]) for a, c in zip(starts, n, strict=True)]


def test_blank_lines_are_no_lines(spark):
    docs = [(1, " \t\x0b\x0c\r\n\n a\n\u00a0\n\u2003\n \u3000 \n\t"), (2, None), (3, ""), (4, "\n")]
    got = {x.doc_id: x.n_lines for x in line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string"), shingle=line_dedup.FINE).collect()}
    assert got == {1: 4, 2: 0, 3: 0, 4: 0}
