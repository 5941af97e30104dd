"""Small tables with nulls, empty and long texts, ties, repeated rows and extra columns of clashing names."""

from __future__ import annotations

import random
import re
from pathlib import Path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, row int, kept string, n_words int, name string, `group` int"


def rows(seed: int = 3) -> list[tuple]:
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(60)]
    line = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared = [line(20) for _ in range(4)]
    texts: list[str | None] = [None, "", " \n\t ", "one", "one two", "Ünder  the\ttable\n\nlast line", "a " * 40, "a b " * 30, "\n\n", "日本 語\n日本 語", "x" * 5000]
    for i in range(40):
        parts = [line(r.randint(1, 40)) for _ in range(r.randint(1, 6))]
        if i % 2:
            parts.insert(r.randint(0, len(parts)), r.choice(shared))
        texts.append("\n".join(parts))
    texts += [texts[12], texts[13], texts[14] + " more", line(9000)]
    words = texts[15].split(" ")
    words[3:4] = ["changed"]
    texts.append(" ".join(words))
    ids: list[int | None] = [*range(5, 5 + len(texts))]
    r.shuffle(ids)
    ids[20] = None
    out = [(i, t, r.choice(["en", "fr", None]), r.choice(["s1", "s2", "S3", None]), len(t) if t else None, 7, 1, "k", 2, "n", 3) for i, t in zip(ids, texts, strict=True)]
    return out + [out[15], out[30]]


def frame(spark, values: list[tuple] | None = None):
    return spark.createDataFrame(rows() if values is None else values, SCHEMA).repartition(3)


def root() -> Path:
    return Path(__file__).resolve().parent.parent.parent
