"""Language identification by a byte convolutional network in numpy.

Filters of widths 2, 3 and 4 slide over the bytes of fixed-length windows (a filter is a table of
weights by position and byte), max pooling takes each filter's best place, and a softmax layer scores
the languages; a text's scores are the means over all of its windows, first byte to last. Training is
by Adam on windows of a bounded sample of labelled rows: about ``per_label`` rows of each label, drawn
by a hash of id and text, equal rows once, and ``per_text`` windows of each, evenly spread. All texts are predicted.

A null text, or one without a letter, is ``und`` with score 0. Rows without label or id are never
learned from. If there is nothing to learn from, every prediction is ``und``. Repeated rows get the
same prediction each. An empty table gives an empty result; other columns of docs are left out. A very long text is cut
into windows whole, by one task, with some 2 bytes for each of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices
from .textarrays import Texts, plain

WINDOW, WIDTHS, FILTERS = 192, (2, 3, 4), 8
LOOK = WINDOW + max(WIDTHS) - 1
PER_LABEL, PER_TEXT, EPOCHS, BATCH = 600, 3, 6, 64


def windows(x: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Windows of LOOK bytes (the last ones overlap the next window; spaces after the text) and the row of each."""
    size = np.diff(x.starts)
    n = -(-size // WINDOW)
    row = np.repeat(np.arange(x.rows), n)
    start = x.starts[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    padded = np.concatenate([x.data, np.full(LOOK, 32, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, LOOK)[start] if len(start) else np.zeros((0, LOOK), np.uint8)
    short = np.flatnonzero(start + LOOK > x.starts[row + 1])
    if len(short):
        keep = np.arange(LOOK)[None, :] < (x.starts[row[short] + 1] - start[short])[:, None]
        out[short] = np.where(keep, out[short], 32)
    return out, row


class Network:
    def __init__(self, labels: list[str], seed: int = 5):
        r = np.random.default_rng(seed)
        self.labels = labels
        self.filters = [r.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.dense = r.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(labels))).astype(np.float32)
        self.offset = np.zeros(len(labels), np.float32)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> None:
        r, parameters = np.random.default_rng(seed), [*self.filters, self.bias, self.dense, self.offset]
        first, second, step = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters], 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for lo in range(0, len(x), BATCH):
                some = order[lo : lo + BATCH]
                grads = self._gradients(x[some], y[some])
                step += 1
                for p, g, m, v in zip(parameters, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n, pooled, places = len(x), [], []
        for w, table in zip(WIDTHS, self.filters, strict=True):
            total = sum(table[j][x[:, j : j + WINDOW]] for j in range(w))
            at = total.argmax(axis=1)
            places.append(at)
            pooled.append(np.take_along_axis(total, at[:, None, :], axis=1)[:, 0])
        raw = np.concatenate(pooled, axis=1) + self.bias
        hidden = np.maximum(raw, 0)
        p = softmax(hidden @ self.dense + self.offset)
        p[np.arange(n), y] -= 1
        p /= n
        back = (p @ self.dense.T) * (raw > 0)
        out = []
        for k, (w, table) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            g, part = np.zeros_like(table), back[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(w):
                np.add.at(g[j], (np.take_along_axis(x, places[k] + j, axis=1), np.arange(FILTERS)[None, :]), part)
            out.append(g)
        return [*out, back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]

    def pairs(self) -> list[tuple[list[tuple[int, np.ndarray]], ...]]:
        """Each width's filters as tables over two bytes or one, with their places."""
        out = []
        for w, t in zip(WIDTHS, self.filters, strict=True):
            tables = []
            for j in range(0, w, 2):
                tables.append((j, (t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, FILTERS) if j + 1 < w else t[j]))
            out.append(tables)
        return out

    def scores(self, x: np.ndarray, tables: list) -> np.ndarray:
        """Softmax of each window."""
        columns = np.ascontiguousarray(x.T)
        two = columns[:-1].astype(np.uint16) << 8 | columns[1:]
        best = [np.full((len(x), FILTERS), -np.inf, np.float32) for _ in WIDTHS]
        total, more = np.empty((len(x), FILTERS), np.float32), np.empty((len(x), FILTERS), np.float32)
        for i in range(WINDOW):
            for top, parts in zip(best, tables, strict=True):
                for k, (j, table) in enumerate(parts):
                    np.take(table, two[i + j] if len(table) > 256 else columns[i + j], axis=0, out=more if k else total, mode="clip")
                    if k:
                        total += more
                np.maximum(top, total, out=top)
        return softmax(np.maximum(np.concatenate(best, axis=1) + self.bias, 0) @ self.dense + self.offset)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def held_out(doc_id="doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, per_label: int = PER_LABEL, per_text: int = PER_TEXT, epochs: int = EPOCHS) -> Network | None:
    """A network trained on a bounded sample of the rows that have doc_id, lang and text and are not held out."""
    usable = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    labels = sorted(counts)
    rate = F.coalesce(F.create_map(*[x for k in labels for x in (F.lit(k), F.lit(min(1.0, per_label / counts[k])))])[F.col("lang")], F.lit(0.0))
    # equal rows throw equal dice, and one of them is enough
    dice = F.pmod(F.xxhash64(F.lit(11), "doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = usable.filter(dice < rate).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").dropDuplicates(["doc_id", "lang", "text"])

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = Texts(plain(batch.column("text")))
        w, row = windows(x)
        n = np.bincount(row, minlength=x.rows)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        # the windows nearest to evenly spread places
        keep = (at * per_text // n[row]) != ((at - 1) * per_text // n[row])
        keep &= w.any(axis=1)
        some = np.flatnonzero(keep)
        data = pa.array([bytes(v) for v in w[some]], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row[some])), batch.column("lang").take(pa.array(row[some])), pa.array(at[some]), data], ["doc_id", "lang", "at", "bytes"])

    sample = map_slices(drawn, cut, "doc_id long, lang string, at long, bytes binary", "doc_id", "lang", "text").toPandas()
    sample = sample.sort_values(["doc_id", "lang", "at", "bytes"], kind="stable")
    if not len(sample):
        return None
    x = np.frombuffer(b"".join(sample["bytes"]), np.uint8).reshape(-1, LOOK)
    y = sample["lang"].map({k: i for i, k in enumerate(labels)}).to_numpy()
    network = Network(labels)
    network.train(x, y, epochs)
    return network


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of docs."""
    labels = pa.array(network.labels if network else ["und"], pa.string())
    shared = docs.sparkSession.sparkContext.broadcast(network)
    tables: list = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        net = shared.value
        x = Texts(plain(batch.column("text")))
        total = np.zeros((x.rows, len(labels)))
        if net is not None and len(x.data):
            if not tables:
                tables.extend(net.pairs())
            w, row = windows(x)
            p = np.concatenate([net.scores(w[i : i + 4096], tables) for i in range(0, len(w), 4096)]).astype(float)
            heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            total[row[heads]] = np.add.reduceat(p, heads, axis=0) / np.diff(np.r_[heads, len(row)])[:, None]
        best = total.argmax(axis=1)
        known = batch.column("letters").to_numpy(zero_copy_only=False) & (total.max(axis=1) > 0)
        names = pa.array(np.where(known, best, len(labels)))
        score = np.where(known, np.clip(total.max(axis=1), 0, 1), 0.0)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.concat_arrays([labels, pa.array(["und"])]).take(names), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    marked = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("held_out", held_out()).withColumn("letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return map_slices(marked, run, "doc_id long, held_out boolean, lang_pred string, score double", "doc_id", "held_out", "letters", "text")
