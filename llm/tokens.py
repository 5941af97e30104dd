"""Token ids of whole texts by the tokenizers library, each distinct piece of text encoded once a worker.

A text is cut where the tokenizer's own pre-tokenisation always cuts, so the ids of a text are the
ids of its pieces in a row. Pieces get 64-bit names in numpy; a worker keeps the ids of the pieces it
has met in flat arrays (bounded by CACHE pieces) and asks the library for new ones only.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .common import release
from .textarrays import Texts, ragged

#: Pieces whose ids a worker keeps.
CACHE = 700_000
_TAIL = np.zeros(256, bool)
_TAIL[list(b".,;:!?")] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Encoder:
    """Ids of texts for one tokenizer file. ``words``: the vocabulary drops white space and case."""

    def __init__(self, path: str, words: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.words = words
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        if words:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        else:
            self.line = self.one("\n")
        self.forget()

    def forget(self) -> None:
        self.name, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint16), 0

    def one(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)

    def pieces(self, x: Texts) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of each piece, in order."""
        first, end = x.words()
        if not len(first):
            spaces = x.starts[:-1][np.diff(x.starts) > 0], x.starts[1:][np.diff(x.starts) > 0]
            return (first, end) if self.words else spaces
        # a run of .,;:!? at the end of a word is a piece of its own
        tail = end.copy()
        live = np.flatnonzero(_TAIL[x.data[end - 1]])
        while len(live):
            tail[live] -= 1
            live = live[tail[live] > first[live]]
            live = live[_TAIL[x.data[tail[live] - 1]]]
        cut = (tail > first) & (tail < end)
        if self.words:
            # an apostrophe may join what stands beside it
            quotes = np.zeros(len(x.data) + 1, np.int64)
            np.cumsum(x.data == 39, out=quotes[1:])
            cut &= quotes[end] == quotes[first]
            cut &= _ALNUM[x.data[np.maximum(tail - 1, 0)]]
            a, b = np.concatenate([first, tail[cut]]), np.concatenate([np.where(cut, tail, end), end[cut]])
            order = np.argsort(a, kind="stable")
            return a[order], b[order]
        cut &= _ALNUM[x.data[np.maximum(tail - 1, 0)]]
        # the last character of white space before a word: a space belongs to the word, any other stands alone
        led = first[first > x.starts[x.row_of(first)]]
        space = x.data[led - 1] == 0x20
        nonempty = x.starts[:-1][np.diff(x.starts) > 0]
        mark = np.zeros(len(x.data) + 1, bool)
        for places in (nonempty, led - 1, led[~space], end, tail[cut], x.starts[-1:]):
            mark[places] = True
        cuts = np.flatnonzero(mark)
        return cuts[:-1], cuts[1:]

    def learn(self, data: np.ndarray, names: np.ndarray, first: np.ndarray, end: np.ndarray) -> None:
        """Keeps the ids of new pieces."""
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(first.tolist(), end.tolist(), strict=True)]
        if self.words:
            easy = [t.isalpha() for t in texts]
            joined, before = " ", ""
        else:
            easy = ["\n" not in t and not t.isspace() for t in texts]
            joined, before = "\n", "\n"
        simple, alone = np.flatnonzero(easy).tolist(), np.flatnonzero(~np.array(easy, bool)).tolist()
        # many pieces at a time, told apart again by the ends of words or by the breaks between them
        order, sizes, flat = [], [], []
        groups = [simple[i : i + 256] for i in range(0, len(simple), 256)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([before + joined.join(texts[i] for i in g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.uint16)
            if self.words:
                last = np.flatnonzero(self.ends[ids]) + 1
                fits = len(last) == len(group) and last[-1] == len(ids)
                size = np.diff(last, prepend=0)
            else:
                breaks = np.flatnonzero(ids == self.line[0])
                fits = len(self.line) == 1 and len(breaks) == len(group)
                size = np.diff(breaks, append=len(ids)) - 1
                ids = np.delete(ids, breaks)
            if not fits:
                alone += group
                continue
            order += group
            sizes.append(size)
            flat.append(ids)
        for i in alone:
            flat.append(self.one(texts[i]))
            sizes.append(np.array([len(flat[-1])]))
        order += alone
        flat = np.concatenate(flat) if flat else np.zeros(0, np.uint16)
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(flat), len(self.ids)), np.uint16)])
        self.ids[self.used : self.used + len(flat)] = flat
        size, at = np.zeros(len(texts), np.int32), np.zeros(len(texts), np.int64)
        size[order] = np.concatenate(sizes) if sizes else 0
        at[order] = self.used + np.cumsum(size[order]) - size[order]
        self.used += len(flat)
        where = np.searchsorted(self.name, names)
        self.name, self.at, self.size = np.insert(self.name, where, names), np.insert(self.at, where, at), np.insert(self.size, where, size)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string array without nulls as uint16, and how many each text has."""
        x = Texts(texts)
        odd = [] if self.words else np.unique(x.row_of(_other_spaces(x.data))).tolist()
        if self.words:
            x.data = _LOWER[x.data]
        first, end = self.pieces(x)
        names, where, back = np.unique(x.names(first, end), return_index=True, return_inverse=True)
        if len(self.name) + len(names) > CACHE:
            self.forget()
        found = np.searchsorted(self.name, names)
        new = np.ones(len(names), bool)
        inside = found < len(self.name)
        new[inside] = self.name[found[inside]] != names[inside]
        if new.any():
            self.learn(x.data, names[new], first[where[new]], end[where[new]])
            found = np.searchsorted(self.name, names)
        at, size = self.at[found][back], self.size[found][back].astype(np.int64)
        ids = self.ids[np.repeat(at, size) + ragged(size)]
        held = np.zeros(len(first) + 1, np.int64)
        np.cumsum(size, out=held[1:])
        counts = np.diff(held[np.searchsorted(first, x.starts)])
        if odd:  # other white space than the six bytes may change how its neighbours are cut
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i in odd:
                parts[i] = self.one(texts[i].as_py())
            counts, ids = np.array([len(p) for p in parts], np.int64), np.concatenate(parts)
        return ids, counts


def _other_spaces(data: np.ndarray) -> np.ndarray:
    """Where white space beyond the six bytes may stand."""
    found = [np.flatnonzero((data >= 0x1C) & (data <= 0x1F))]
    lead = np.flatnonzero(data[:-1] >= 0xC2)
    a, b = data[lead], data[lead + 1]
    found.append(lead[(a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) | (a == 0xE2) & ((b == 0x80) | (b == 0x81)) | (a == 0xE3) & (b == 0x80)])
    return np.concatenate(found)


def ended(ids: np.ndarray, counts: np.ndarray, end_id: int) -> np.ndarray:
    """The ids of texts of some counts, each followed by the end id."""
    out = np.full(len(ids) + len(counts), end_id, ids.dtype)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(counts + 1) - 1] = False
    out[inside] = ids
    return out


_encoders: dict[tuple[str, bool], Encoder] = {}


def drop() -> None:
    """Forgets this worker's encoders; workers live on between stages."""
    _encoders.clear()
    release()


def encoder(path: str, words: bool) -> Encoder:
    """This worker's encoder of a file."""
    if (path, words) not in _encoders:
        _encoders[path, words] = Encoder(path, words)
    return _encoders[path, words]
