r"""Quality rules: base counts, and repetition by suffix arrays.

A document's words are its symbols. The suffixes of all documents of a slice (a suffix ends with its
document) are sorted by prefix doubling in numpy, which leaves out all that is far from any run
of MIN_REPEAT words found twice. The
longest-common-prefix array of neighbours then gives the maximal repeated substrings as its
intervals: the longest repeat from a position is the larger of the common prefixes with its two
neighbours. The spans of repeats are united. A document is rejected if the spans cover more than MAX_COVERED of its words, or if
the longest repeat exceeds MAX_REPEAT words and makes up more than MAX_REPEAT_SHARE of them. Words in repeats
are in repeated triples too, so MAX_COVERED lies well below the half that the base rule allows. The limits are
calibrated on labels: of 3,243 good documents that pass the base rule none has more than 0.182 of its words
covered or a repeat of more than 13 words.

A null or empty text has no words, all counts are zero and it is rejected by the base rule. Rows are
judged alone, so ties and repeated rows cannot matter. An empty table gives an empty result. Columns of docs come
through, but for those named like a count, which are replaced. A very long text is held whole by one task, with some
100 bytes a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import map_slices
from .textarrays import Ranges, Texts, combine, plain

#: Words of a repeat that counts, covered share of words allowed, longest repeat allowed outright and as a share.
MIN_REPEAT, MAX_COVERED, MAX_REPEAT, MAX_REPEAT_SHARE = 10, 0.25, 30, 0.1
MIN_WORDS, MAX_TRIPLES = 50, 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]


def twice(names: np.ndarray) -> np.ndarray:
    """Whether the name of each position is found at another one too."""
    order = np.argsort(names)
    ordered = names[order]
    same = ordered[1:] == ordered[:-1]
    out = np.zeros(len(names), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def windows(symbols: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the runs of ``size`` symbols within a row, and their first positions."""
    n = len(symbols) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:n] == row[size - 1 :])
    names = row[at].astype(np.uint64)
    for k in range(size):
        names = combine(names, symbols[at + k])
    return names, at


def covered(at: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Positions in the union of the spans at..at+length."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:-1]) > 0


def longest_repeats(symbols: np.ndarray, row: np.ndarray, shortest: int) -> np.ndarray:
    """For each position the longest run of symbols from there that starts elsewhere in its row too (0: under shortest)."""
    n = len(symbols)
    out = np.zeros(n, np.int64)
    names, at = windows(symbols, row, shortest)
    at = at[twice(names)]
    if not len(at):
        return out
    # those positions and, so that order by symbols is exact for them, what follows closely
    margin = 4 << shortest.bit_length()
    at = np.flatnonzero(covered(at, np.minimum(margin, n - at), n))
    end_of = np.searchsorted(row, row, "right")
    # suffixes in order; the rank of one is where its group of equals starts
    array = at[np.lexsort((symbols[at], row[at]))]
    group = np.r_[True, (symbols[array[1:]] != symbols[array[:-1]]) | (row[array[1:]] != row[array[:-1]])]
    rank = -2 - np.arange(n + 1)  # others are unlike any
    rank[array] = np.flatnonzero(group)[np.cumsum(group) - 1]
    width = 1
    while True:
        mine = rank[array]
        equal = mine[1:] == mine[:-1]
        live = np.flatnonzero(np.r_[False, equal] | np.r_[equal, False])
        if not len(live):
            break
        some = array[live]
        follow = some + width
        second = np.where(follow < end_of[some], rank[np.minimum(follow, n)], -1)
        order = np.lexsort((second, rank[some]))
        some, first, second = some[order], rank[some][order], second[order]
        array[live] = some
        head = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        rank[some] = live[np.flatnonzero(head)][np.cumsum(head) - 1]
        width *= 2
    # common prefixes of neighbours
    ranges = Ranges(symbols)
    a, b = np.minimum(array[1:], array[:-1]), np.maximum(array[1:], array[:-1])
    room = np.where(end_of[a] == end_of[b], end_of[b] - b, 0)
    common = np.zeros(len(a), np.int64)
    step = 1 << int(room.max(initial=1)).bit_length()
    while step:
        ok = np.flatnonzero(common + step <= room)
        alike = ok[ranges.equal(a[ok] + common[ok], b[ok] + common[ok], np.full(len(ok), step))]
        common[alike] += step
        step //= 2
    np.maximum.at(out, array[1:], common)
    np.maximum.at(out, array[:-1], common)
    out[out < shortest] = 0
    return out


def measure(x: Texts, shortest: int) -> dict[str, np.ndarray]:
    """The counts of FIELDS for each row."""
    first, end = x.words()
    row = x.row_of(first)
    per = lambda positions: np.bincount(positions, minlength=x.rows)
    n_words = per(row)
    # code points inside words: bytes that don't continue one
    points = np.zeros(len(x.data) + 1, np.int64)
    np.cumsum((x.data & 0xC0) != 0x80, out=points[1:])
    chars = np.bincount(row, points[end] - points[first], minlength=x.rows).astype(np.int64)
    symbols = per(x.row_of(np.flatnonzero(_SYMBOL[x.data])))
    lo, hi = x.lines()
    words_before = np.searchsorted(first, lo), np.searchsorted(first, hi)
    full = words_before[1] > words_before[0]
    lo, hi = lo[full], hi[full]
    of = x.row_of(lo)
    distinct = np.unique(combine(of.astype(np.uint64), x.names(lo, hi)), return_index=True)[1]
    dup_lines = per(of) - per(of[distinct])
    names = x.names(first, end)
    triples, at = windows(names, row, 3)
    at = at[twice(triples)]
    repeated = covered(at, np.full(len(at), 3), len(names))
    longest = longest_repeats(names, row, shortest)
    spans = np.flatnonzero(longest)
    most = np.zeros(x.rows, np.int64)
    np.maximum.at(most, row[spans], longest[spans])
    return dict(zip(FIELDS, [n_words, chars, symbols, dup_lines, per(row[repeated]), per(row[covered(spans, longest[spans], len(names))]), most], strict=True))


def judged(docs: DataFrame, shortest: int = MIN_REPEAT) -> DataFrame:
    """All columns of docs, the counts of FIELDS, base_failed and kept."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = measure(Texts(plain(batch.column("text"))), shortest)
        columns = [batch.column(i) for i in range(batch.num_columns)] + [pa.array(found[k], pa.int64()) for k in FIELDS]
        return pa.RecordBatch.from_arrays(columns, batch.schema.names + FIELDS)

    docs = docs.drop(*FIELDS, "base_failed", "kept")
    # numbered, as names may have dots and backticks in them
    names = ["text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    plain_docs = docs.toDF(*names)
    schema = StructType([*plain_docs.schema.fields, *[StructField(k, LongType()) for k in FIELDS]])
    out = map_slices(plain_docs, run, schema, *names)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_TRIPLES * F.col("n_words"))
    much = F.col("covered_words") > MAX_COVERED * F.col("n_words")
    long = (F.col("longest_repeat") > MAX_REPEAT) & (F.col("longest_repeat") > MAX_REPEAT_SHARE * F.col("n_words"))
    return out.withColumn("base_failed", base).withColumn("kept", ~(base | much | long)).toDF(*docs.columns, *FIELDS, "base_failed", "kept")
