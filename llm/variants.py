"""Spelling variants: words one edit apart, found by pivotal grams, and the commoner form of each.

The bigrams of a word are ordered from the rarest among all words to the commonest. Its prefix is the three
rarest (and any that equal the last of them); its two pivots are the cheapest two of them that share no letter,
chosen by dynamic programming over their places. One edit spoils one pivot at most, and the other then stands in the other
word, one place further at most. It is in that word's prefix if the prefix reaches at least as far in the order
as the own one; of two words one reaches as far as the other, so pivots against prefixes find every pair. The
edit lies behind the first pivot or before the second one, so either all up to the end of the first pivot or all from the
start of the second is the same in both words, and of what remains one half too: places, lengths and those parts
are the key of the join, so that words which merely share a bigram do not meet. An exact comparison follows.

A null text has no words. Repeated rows count twice, as do rows that share an id; a null id deletes nothing
(its hash is null). Ties between forms go to the first in code-point order. A table without words gives
an empty result, other columns are left out, and a very long text is held whole by one task as the array of its runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import importable, written

#: A run of letters: Latin ones up to U+00FF.
RUN = r"[A-Za-zÀ-ÿ]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bigrams in a prefix for one edit: as many as one edit can touch, and one more.
PREFIX = 3


def runs(docs: DataFrame, misspell: int | None = None) -> DataFrame:
    """word for every run of letters, A-Z in lower case; misspell: in one of so many (by a hash of id and run) a letter is missing."""
    run = docs.select(F.col("doc_id").alias("d"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    # lower() knows more capitals than A-Z, but not in ASCII
    low = F.when(F.octet_length("run") == F.char_length("run"), F.lower("run")).otherwise(F.translate("run", CAPITALS, SMALL))
    run = run.select("d", low.alias("word"))
    if misspell is None:
        return run.select("word")
    h = F.crc32(F.encode(F.concat(F.col("d").cast("string"), F.lit(":"), F.col("word")), "utf-8"))
    run = run.select("word", h.alias("h"))
    at = (F.col("h") % F.char_length("word")).cast("int")
    shorter = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
    return run.select(F.when(F.col("h") % misspell == 0, shorter).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, least: int = 3, length: int = 5) -> DataFrame:
    """word and n of the words that are long enough and frequent enough."""
    return words.filter(F.char_length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def gram_costs(words: DataFrame) -> dict[str, int]:
    """How many places in words each bigram has; of two letters from RUN there are at most 90 * 90."""
    gram = F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))
    return dict(map(tuple, words.filter(F.char_length("word") > 1).select(F.explode(gram).alias("g")).groupBy("g").count().collect()))


def disjoint(places: list[int], costs: list[int], size: int = 2, wanted: int = 2) -> list[int]:
    """The cheapest so many of some places (ascending) at least size apart; of equal sums the first.

    best[j] holds the cheapest choice of j places among those so far; a new place adds to what ended before it.
    """
    table: list[list[tuple[int, tuple[int, ...]] | None]] = [[(0, ())] + [None] * wanted]
    for k, (place, cost) in enumerate(zip(places, costs, strict=True)):
        row = list(table[-1])
        before = next((b for b in range(k, 0, -1) if places[b - 1] <= place - size), 0)
        for j in range(1, wanted + 1):
            if (left := table[before][j - 1]) is not None and (row[j] is None or left[0] + cost < row[j][0]):
                row[j] = (left[0] + cost, (*left[1], place))
        table.append(row)
    return list(table[-1][wanted][1]) if table[-1][wanted] is not None else []


def grams_of(word: str, rank: dict[str, int], cost: dict[str, int]) -> tuple[int, list[int], list[int]]:
    """Rank of the last bigram of a word's prefix, places of the prefix, places of the two pivots."""
    order = sorted((rank[word[i : i + 2]], i) for i in range(len(word) - 1))
    last = order[min(PREFIX, len(order)) - 1][0]
    prefix = sorted(i for r, i in order if r <= last)
    some = sorted(i for _, i in order[:PREFIX])
    return last, prefix, disjoint(some, [cost[word[i : i + 2]] for i in some])


def marked(words: DataFrame) -> DataFrame:
    """word, n, last, prefix and pivots of every word (4 letters at least)."""
    cost = gram_costs(words)
    rank = {g: k for k, g in enumerate(sorted(cost, key=lambda g: (cost[g], g)))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, prefix, pivots = zip(*(grams_of(w, rank, cost) for w in batch.column("word").to_pylist()), strict=True) if len(batch) else ((), (), ())
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(last, pa.int32()), pa.array(prefix, ints), pa.array(pivots, ints)], ["word", "n", "last", "prefix", "pivots"])

    importable(words.sparkSession)
    return words.select("word", "n").mapInArrow(run, "word string, n long, last int, prefix array<int>, pivots array<int>")


def _keys(side: str, shared: Column, rest: Column, own: Column) -> Column:
    """What a word shares with one whose edit is behind (L) or before (R) a bigram that both have.

    shared: letters from the word's start (L) or end (R) through the bigram; rest: letters of the shorter of the two words
    on the other side, where the edit is; own: whether the word itself has so many there. The edit spares the far half of the rest or the near one.
    """
    near, far = (F.left, F.right) if side == "L" else (F.right, F.left)
    half = F.floor(rest / 2).cast("int")
    spared = [F.xxhash64(F.lit(f"{side} far"), rest, near("word", shared), far("word", rest - half)), F.xxhash64(F.lit(f"{side} near"), rest, near("word", shared + half))]
    return F.when(rest >= 0, F.array(*[F.struct(k.alias("key"), own.alias("own")) for k in spared]))


def _all_keys(sides: list[tuple[str, Column]]) -> Column:
    """The keys of bigrams at some places, each for a partner that is as long or longer and for one that is shorter."""
    size = F.char_length("word")
    out = []
    for side, place in sides:
        shared = place + 2 if side == "L" else size - place
        out += [_keys(side, shared, size - shared, F.lit(True)), _keys(side, shared, size - shared - 1, F.lit(False))]
    return F.flatten(F.filter(F.array(*out), lambda x: x.isNotNull()))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, na, b, nb (a < b) of all words (word, n; 4 letters at least) exactly one inserted, deleted or replaced letter apart."""
    marks = written(marked(words), "grams")
    pivots = _all_keys([("L", F.element_at("pivots", 1)), ("R", F.element_at("pivots", 2))])
    asks = marks.select("word", "n", "last", F.inline(pivots))
    index = F.flatten(F.transform("prefix", lambda p: _all_keys([("L", p), ("R", p)])))
    has = marks.select("word", "n", "last", F.inline(F.array_distinct(index))).toDF("other", "other_n", "other_last", "key", "other_own")
    met = asks.join(has, "key").filter((F.col("own") | F.col("other_own")) & (F.col("other_last") >= F.col("last")))
    met = met.filter(F.levenshtein("word", "other", 1) == 1)
    first = F.col("word") < F.col("other")
    of = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    return met.select(of("word", "other", "a"), of("n", "other_n", "na"), of("other", "word", "b"), of("other_n", "n", "nb")).distinct()


def forms(words: DataFrame, pairs: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n: the commonest near word if it is ratio times as frequent, and where the chain of forms ends.

    Frequencies grow by the ratio along a chain, so it has no more steps than the logarithm of the largest; each
    round of joins doubles how far a word sees.
    """
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m"))
    both = both.union(pairs.select("b", "a", "na"))
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("minus"), "other")).alias("best"))
    known = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("best.minus")).alias("m"), "best.other")
    chosen = F.col("m") >= ratio * F.col("n")
    known = written(known.select("word", "n", "n_near", F.when(chosen, F.col("other")).alias("form"), F.when(chosen, F.col("m")).alias("form_n")), "forms")
    links = known.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        following = links.toDF("root", "next")
        far = written(links.join(following, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        links = far.select("word", "root")
        if far.filter("moved").isEmpty():
            break
    out = known.join(links, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, least: int = 3, length: int = 5, ratio: int = 2, misspell: int | None = None) -> DataFrame:
    """The frequent words of docs (doc_id, text), each with its form; see forms. length: 4 at least."""
    if length < 4:
        raise ValueError("words of fewer than four letters have no two pivots in a prefix")
    words = written(vocabulary(runs(docs, misspell), least, length), "vocabulary")
    # read from both ends
    return forms(words, written(near_pairs(words), "pairs"), ratio)
