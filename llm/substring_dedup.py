"""Removal of long repeats across documents by recompression.

Words are the first symbols. A round of recompression names runs of one symbol, then pairs: symbols are
split into left and right ones by a bit of their name, and a left one before a right one becomes a new
symbol. A name is a 64-bit hash of its parts, so all tasks name alike without a common dictionary. What
the round does to a symbol depends on its neighbours only, so equal passages get equal symbols inside.

How far inside: in another text the run of words that a passage begins with may reach back further, so its
name is unknown, and with it whether it has taken the next run as its partner. The run after that one meets
a neighbour that is the same in both texts, so from there on symbols are equal; and likewise back from the
end. Symbols that begin after the first run of a passage and not with the second, and end before the
last but one run does, are the same in every text that has the passage. That is seen from the passage alone.

Rounds on Spark, each with a question about names (see membership): (1) which phrases, that is PHRASE
neighbouring symbols, are in another document too. Half of the phrases, chosen by their names, are asked
about. (2) Where all phrases are shared, recompression goes on for up to ROUNDS rounds, and of the symbols that span a
window or more, which are in a document with a smaller doc_id. Equal symbols are equal words, so such a symbol settles every window in
it: a long repeat is verified by a few high symbols, and only the windows at its rims, and those of the first document that has it,
remain. (3) Of these, which are in a document with a smaller doc_id. A window is named by the symbols within it and the words at
its two rims, so equal windows have one name in all texts. The first document with a window is never settled, so
all others find it.

Names of 64 bits stand for words, symbols and windows; unequal ones agree with odds of 2^-64 a pair, whatever their
form. Null texts have no words. A null doc_id counts as larger than all others. Rows with equal doc_id and text count
as one document and give equal rows. Words of a shorter text than the window are never covered. An empty table gives
an empty result; other columns of docs are left out. A very long text is held whole by one task, with some 60 bytes a
word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_slices, written
from .membership import answers, buckets_of, entries, keyed, with_answers
from .textarrays import Texts, combine, mix, plain

#: Neighbouring symbols of a phrase, and rounds for high symbols: each leaves some three quarters of the symbols.
PHRASE, ROUNDS = 3, 24


def recompress(names: np.ndarray, row: np.ndarray, round_: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the names after a round: their names and first places, and the first places of runs. No symbol reaches from one row into the next."""
    if not len(names):
        return names, np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]) | (row[1:] != row[:-1])])
    length = np.diff(np.r_[at, len(names)])
    symbol, of = np.where(length > 1, combine(names[at], length.astype(np.uint64), 1), names[at]), row[at]
    right = (mix(symbol + np.uint64(round_)) & np.uint64(1)).astype(bool)
    pair = np.flatnonzero(~right[:-1] & right[1:] & (of[1:] == of[:-1]))
    symbol[pair] = combine(symbol[pair], symbol[pair + 1], 2)
    keep = np.ones(len(symbol), bool)
    keep[pair + 1] = False
    return symbol[keep], at[keep], at


class Words:
    """Words of a batch, their names and rows, and the symbols above them."""

    def __init__(self, batch: pa.RecordBatch, window: int):
        self.texts = Texts(plain(batch.column("text")))
        self.first, self.end = self.texts.words()
        self.names = self.texts.names(self.first, self.end)
        self.row = self.texts.row_of(self.first)
        self.window = window
        self.symbol, self.place, runs = recompress(self.names, self.row)
        self.stop = np.r_[self.place[1:], len(self.names)]
        # where the run that each word is in begins and ends
        length = np.diff(np.r_[runs, len(self.names)])
        self.run_first, self.run_end = np.repeat(runs, length), np.repeat(runs + length, length)

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that are asked about: name and row; their first words and ends are kept."""
        n = max(0, len(self.symbol) - PHRASE + 1)
        of = self.row[self.place] if len(self.place) else self.place
        at = np.flatnonzero(of[:n] == of[PHRASE - 1 :]) if n else np.zeros(0, np.int64)
        name = self.symbol[at]
        for k in range(1, PHRASE):
            name = combine(name, self.symbol[at + k], 98 + k)
        asked = (mix(name) & np.uint64(1)).astype(bool)
        at = at[asked]
        self.phrase_first, self.phrase_end = self.place[at], self.stop[at + PHRASE - 1]
        return name[asked], of[at]

    def inner(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least first place and largest end of the symbols that windows have in every text."""
        return self.run_end[at] + 1, self.run_first[at + self.window - 1] - 1

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """First words of the windows to ask about, given whether each phrase is shared."""
        n, w = len(self.names), self.window
        if n < w:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(self.row[: n - w + 1] == self.row[w - 1 :])
        # phrases inside, by ascending first word and end
        low, high = self.inner(at)
        lo = np.searchsorted(self.phrase_first, low)
        hi = np.searchsorted(self.phrase_end, high, "right")
        alone = np.zeros(len(shared) + 1, np.int64)
        np.cumsum(~shared, out=alone[1:])
        return at[(hi <= lo) | (alone[np.maximum(hi, lo)] == alone[lo])]

    def high(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names, first words and lengths of the symbols of a window or more, by rounds over the words that some windows (their first words) cover.

        Neighbouring words of these windows make a passage; inside of it symbols depend on its words alone.
        """
        cover = np.zeros(len(self.names) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + self.window, -1)
        words = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        of = np.cumsum(np.r_[0, (np.diff(words) != 1) | (np.diff(self.row[words]) != 0)]) if len(words) else words
        symbol, place, out = self.names[words], np.arange(len(words)), [(np.zeros(0, np.uint64), words[:0], words[:0])]
        for round_ in range(1, ROUNDS + 1):
            before = len(symbol)
            new, cut, _ = recompress(symbol, of, round_)
            made = new != symbol[cut]
            symbol, place, of = new, place[cut], of[cut]
            size = np.diff(np.r_[place, len(words)])
            tall = made & (size >= self.window)
            out.append((symbol[tall], words[place[tall]], size[tall]))
            if not before or len(symbol) == of[-1] + 1:
                break
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def settled(self, at: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which windows lie within one of some symbols."""
        edge = np.zeros(len(self.names) + 1, np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + size - self.window + 1, -1)
        return np.cumsum(edge)[at] > 0

    def window_names(self, at: np.ndarray) -> np.ndarray:
        """Names of windows from the symbols inside and the words before and after them."""
        inside = np.full(len(self.names), len(self.names) + 1)  # where a symbol that begins here ends
        inside[self.place] = self.stop
        symbol = np.zeros(len(self.names), np.uint64)
        symbol[self.place] = self.symbol
        out, live, place = np.zeros(len(at), np.uint64), np.arange(len(at)), at.copy()
        last, (low, high) = at + self.window, self.inner(at)
        while len(live):
            whole = (place >= low[live]) & (inside[place] <= high[live])
            out[live] = combine(out[live], np.where(whole, symbol[place], self.names[place]), 7)
            place = np.where(whole, inside[place], place + 1)
            on = place < last[live]
            live, place = live[on], place[on]
        return out


def _flags(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(x or b"" for x in batch.column(column).to_pylist()), np.uint8).astype(bool)


def remove_repeats(docs: DataFrame, window: int = 13, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by one space); with texts also kept."""
    if window < PHRASE + 4:
        raise ValueError("the window is too short for phrases")
    buckets = buckets_of(docs)
    docs = keyed(docs).select("doc_id", "key", "text")

    def phrase_names(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        names, row = Words(batch, window).phrases()
        return row, names

    def passages(batch: pa.RecordBatch) -> tuple[Words, np.ndarray]:
        w = Words(batch, window)
        names, row = w.phrases()
        _, place = entries(row, names, buckets)
        return w, w.candidates(_flags(batch, "shared")[place])

    def symbol_names(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        w, at = passages(batch)
        names, first, _ = w.high(at)
        return w.row[first], names

    def open_windows(batch: pa.RecordBatch) -> tuple[Words, np.ndarray, np.ndarray]:
        """Words, first words of the windows that high symbols settle, and of those that are still to be asked about."""
        w, at = passages(batch)
        names, first, size = w.high(at)
        _, place = entries(w.row[first], names, buckets)
        known = _flags(batch, "long")[place]
        done = w.settled(at, first[known], size[known])
        return w, at[done], at[~done]

    def window_names(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        w, _, at = open_windows(batch)
        return w.row[at], w.window_names(at)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        w, done, at = open_windows(batch)
        _, place = entries(w.row[at], w.window_names(at), buckets)
        at = np.r_[done, at[_flags(batch, "earlier")[place]]]
        edge = np.zeros(len(w.names) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        n_words = np.bincount(w.row, minlength=batch.num_rows)
        # the bytes of kept words, each with a space before it but for the first of a row
        keep = np.flatnonzero(~gone)
        size = w.end[keep] - w.first[keep] + 1
        ends = np.cumsum(size)
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(w.first[keep] - 1, size)
        data = w.texts.data[np.maximum(place, 0)] if len(place) else np.zeros(0, np.uint8)
        data[ends - size] = 32
        raw, per = data.tobytes(), np.bincount(w.row[keep], size, minlength=batch.num_rows).astype(np.int64)
        stop = np.cumsum(per)
        kept = [raw[b - n + 1 : b] for b, n in zip(stop.tolist(), per.tolist(), strict=True)]
        columns = [batch.column("doc_id"), pa.array(n_words), pa.array(np.bincount(w.row[gone], minlength=batch.num_rows)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        names_ = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if texts:
            columns, names_ = [*columns, pa.array([k.decode() for k in kept], pa.string())], [*names_, "kept"]
        return pa.RecordBatch.from_arrays(columns, names_)

    shared = written(answers(docs, buckets, phrase_names, False), "shared")
    asked = with_answers(docs, shared, "shared")
    high = written(answers(asked, buckets, symbol_names, True, "shared"), "high")
    asked = with_answers(asked, high, "long")
    earlier = answers(asked, buckets, window_names, True, "shared", "long")
    out = with_answers(asked, earlier, "earlier")
    return map_slices(out, cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts, "doc_id", "text", "shared", "long", "earlier")
