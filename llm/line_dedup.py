r"""Removal of lines that repeat, exactly or nearly, anywhere in the corpus.

Lines are what stands between \n; lines without a word are left alone. A line's shingles are its runs of ``shingle`` characters (a shorter line is one
shingle). MinHash signatures of PERMUTATIONS values go into BANDS bands; lines that agree on a band are
candidates of each other, and their shingle sets are then compared exactly: a Jaccard similarity of 0.8 or
more links them. That takes two steps. In the first, agreeing lines are tested against the first of their
band in the order of their names and against the one before them, which joins nearly every group of like
lines. In the second, every two lines of a band that are in different components still are looked at too,
so no link between lines that share a band is lost. Bands with all lines in one component need no more tests,
and the first step has compared all lines of bands with up to three.
The second step first bounds the similarity from above by bits that stand for shingles (``possible``), and compares
exactly what the bound lets pass; most pairs of the first are alike and are compared at once.
Large bands meet in tiles of bounded size, so no task holds a whole band. Components of the links are
found by distributed union-find, and of each component, with all its exact copies, the occurrence with the
smallest (doc_id, text hash, line number) is kept.

At similarity 0.8 a pair agrees on one band at least with a chance of 0.995, at 0.85 of 0.9997; unlike lines
(0.2 and less) do with odds of 4e-4 at most. Null texts have no lines. A null doc_id is larger than others. Rows with equal doc_id and
text count as one document and stay alike. An empty table gives an empty result. A very long text or line
is held whole by one task, with some 40 bytes a character; no other task holds more than a few MB of text.
Columns of docs come through whatever their names; n_lines and n_removed are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, partitions, quoted, releasing, written
from .components import components, local_components
from .membership import absent, keyed
from .textarrays import SEPARATOR, Texts, mix, plain, ragged, slices

#: A slice sends so many lines of a band to the band's bucket; of the others it tells only that they are in the band.
KEEP = 4
#: Lines for each bucket of bands, about.
BUCKET = 1 << 17
#: Characters of a shingle of the query and the pipeline.
FINE = 5
#: Names of lines that a task remembers to have signed, so that a line in every slice comes from each task a few times.
SENT = 1 << 18
SHINGLE, SIMILARITY = 8, 0.8
#: Values of a signature; bands, and values that each one takes. Long bands keep chance meetings rare however many lines there are.
PERMUTATIONS, BANDS, ROWS = 75, 32, 7
#: Bits that stand for the shingles of a line where similarities are bounded.
MARKS = 1 << 12
#: Shingles that are hashed, and pairs that are compared, at a time.
BLOCK, PAIRS = 1 << 15, 1 << 16
#: Shingles of pairs that are sorted at a time.
HELD = 1 << 17
#: Bits of a band's name that travel, beside its bucket.
KEPT = 40
#: Lines of a band of which every two are paired: each with the first one and with the one before it.
SETTLED = 3
#: Kinds of rows that travel: lines of bands still to meet, pairs to compare, lines of bands with more than SETTLED.
OPEN, PAIR, MEMBER = 0, 1, 2
_FACTORS = mix(np.arange(1001, 1065, dtype=np.uint64)) | np.uint64(1)
_SEEDS = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FLIPS = [np.uint32(a >> np.uint64(32)) for a in _SEEDS[:5]]
_ODD = [np.uint32(b >> np.uint64(32)) | np.uint32(1) for b in _SEEDS[PERMUTATIONS:]]


def _taken() -> list[list[int]]:
    """Which values each band takes: as different ones as can be, all about equally often."""
    dice, pool, out = np.random.default_rng(1), [], []
    for _ in range(BANDS):
        band: list[int] = []
        while len(band) < ROWS:
            if not (free := [x for x in pool if x not in band]):
                pool += dice.permutation(PERMUTATIONS).tolist()
                continue
            band.append(free[0])
            pool.remove(free[0])
        out.append(band)
    return out


_TAKEN = _taken()


def shingles(x: Texts, first: np.ndarray, end: np.ndarray, shingle: int | Callable = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit names of shingles, and for ascending ranges of UTF-8 bytes where each one's begin in them and how many it has.

    shingle: how many characters, or a function that cuts the ranges otherwise.
    """
    if callable(shingle):
        return shingle(x.data, first, end)
    if x.data.max(initial=0) < 128:
        points, at, chars = x.data, first, end - first
    else:
        points = np.frombuffer(x.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        before = np.zeros(len(x.data) + 1, np.int32)  # characters before each byte
        np.cumsum((x.data & 0xC0) != 0x80, out=before[1:])
        at, chars = before[first].astype(np.int64), (before[end] - before[first]).astype(np.int64)
    # runs from every character on, a block that fits a cache at a time
    names = np.zeros(len(points) + 1, np.uint64)
    for lo in range(0, len(points), BLOCK):
        n = min(BLOCK, len(points) - lo)
        some, term = np.ones(n + shingle, np.uint64), np.empty(n, np.uint64)
        some[: min(n + shingle - 1, len(points) - lo)] += points[lo : lo + n + shingle - 1]
        out = np.multiply(some[:n], _FACTORS[0])
        for k in range(1, shingle):
            out += np.multiply(some[k : k + n], _FACTORS[k], out=term)
        # a bijection that carries every character to the high bits, which signatures and marks take
        out ^= np.right_shift(out, np.uint64(32), out=term)
        out *= _FACTORS[63]
        np.bitwise_xor(out, np.right_shift(out, np.uint64(32), out=term), out=names[lo : lo + n])
    # those of shorter lines end with the line
    short = np.flatnonzero(chars < shingle)
    for i in short.tolist():
        name = int(chars[i])
        for c in points[at[i] : at[i] + chars[i]].tolist():
            name = (name * 0x9E3779B97F4A7C15 + c + 1) & 0xFFFFFFFFFFFFFFFF
            name ^= name >> 31
        names[at[i]] = name
    # the last character reaches all bits; signatures and sets(...) leave the low ones out
    names[at[short]] = mix(names[at[short]])
    return names, at, np.maximum(chars - shingle + 1, 1)


def _places(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """starts, starts + 1, ... of ranges of n places, one after another."""
    ends = np.cumsum(n)
    out = np.repeat(starts - (ends - n), n)
    out += np.arange(len(out))
    return out


def signatures(names: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(PERMUTATIONS, lines) least hash values of each line's shingles (ascending), a block of lines that fits a cache at a time."""
    out = np.empty((PERMUTATIONS, len(starts)), np.uint32)
    ends, lo = starts + n, 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + BLOCK, "right")))
        # one line after another, without what lies between them
        first = np.cumsum(n[lo:hi]) - n[lo:hi]
        some = np.append(names[_places(starts[lo:hi], n[lo:hi])] >> np.uint64(32), np.uint64(0)).astype(np.uint32)
        flipped, hashed = np.empty_like(some), np.empty_like(some)
        for r, flip in enumerate(_FLIPS):
            np.bitwise_xor(some, flip, out=flipped)
            for k in range(r, PERMUTATIONS, len(_FLIPS)):
                # the last value is nobody's
                np.minimum.reduceat(np.multiply(flipped, _ODD[k], out=hashed)[:-1], first, out=out[k, lo:hi])
        lo = hi
    return out


def bands(names: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(lines, BANDS) names of the bands of MinHash signatures."""
    low, out = signatures(names, starts, n).astype(np.uint64), np.empty((BANDS, len(starts)), np.uint64)
    for b, values in enumerate(_TAKEN):
        out[b] = b
        for k, factor in zip(values, _FACTORS, strict=False):
            out[b] += low[k] * factor
    return mix(out).T


def lines(batch: pa.RecordBatch) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines with a word: first byte, end, name, row and number in the text."""
    x = Texts(plain(batch.column("text")))
    lo, hi = x.lines()
    # empty texts have an empty line at a place that the next row has too
    count = 1 + x.per_row(np.flatnonzero(x.data == 10))
    row = np.repeat(np.arange(x.rows), count)
    number = ragged(count)
    # nearly all lines begin with a word
    full = hi > lo
    full[full] = ~SEPARATOR[x.data[lo[full]]]
    rest = np.flatnonzero(~full & (hi > lo))
    size = hi[rest] - lo[rest]
    inside = ~SEPARATOR[x.data[np.repeat(lo[rest], size) + ragged(size)]]
    full[np.repeat(rest, size)[inside]] = True
    lo, hi = lo[full], hi[full]
    return x, lo, hi, x.names(lo, hi), row[full], number[full]


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, key, line (its number from 0) and name (of the whole line) of every line with a word."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, _, _, names, row, number = lines(batch)
        at = pa.array(row)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("key").take(at), pa.array(number, pa.int32()), pa.array(names.view(np.int64))], ["doc_id", "key", "line", "name"])

    return map_slices(docs, run, "doc_id long, key long, line int, name long", "doc_id", "key", "text")


def _starred(band: np.ndarray, name: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs to test first among lines of equal bands, which places go on to the bucket (the first ``keep``) and which don't."""
    order = np.lexsort((name, band))
    band, name = band[order], name[order]
    head = np.r_[True, band[1:] != band[:-1]] if len(band) else np.zeros(0, bool)
    of = np.maximum.accumulate(np.where(head, np.arange(len(band)), 0)) if len(band) else np.zeros(0, np.int64)
    place = np.arange(len(band)) - of
    later = np.flatnonzero(place >= max(keep, 1))
    a = np.concatenate([name[of[later]], name[later - 1]])
    b = np.concatenate([name[later], name[later]])
    return np.minimum(a, b), np.maximum(a, b), order[place < keep], order[place >= keep]


def _several(short: np.ndarray) -> np.ndarray:
    """Places of the values (of KEPT bits) that occur more than once."""
    if len(short) > 1 << 64 - KEPT:
        order = np.argsort(short)
        ordered = short[order]
    else:
        # one sort of values with their places, some times as fast as one of places
        order = np.sort(short << np.uint64(64 - KEPT) | np.arange(len(short), dtype=np.uint64))
        ordered = order >> np.uint64(64 - KEPT)
        order = (order & np.uint64((1 << 64 - KEPT) - 1)).view(np.int64)
    same = ordered[1:] == ordered[:-1]
    return order[np.r_[same, False][: len(order)] | np.r_[False, same][: len(order)]]


def _meeting(kind: int, one: np.ndarray, two: np.ndarray) -> pa.RecordBatch:
    a, b = one.view(np.int64), two.view(np.int64)
    if kind == PAIR:
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
        a, b = a[first], b[first]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], ["kind", "a", "b"])


def meetings(docs: DataFrame, units: int, shingle: int | Callable = SHINGLE, of: Callable = lines, *columns: str) -> DataFrame:
    """What shares a band among the lines of docs, or among the (about so many) units that of(batch) finds, given text and columns.

    Rows of kind PAIR, pairs a < b of names to compare first, among them every line that shares a band, and of kind MEMBER,
    a band a with more than SETTLED lines and a line b of it. All lines of smaller bands are paired.
    """
    buckets = max(partitions(docs.sparkSession), -(-units // BUCKET))
    fields = ["bucket", "bands", "names", "kind"]

    sent = [np.zeros(0, np.uint64)]

    def sign(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x, lo, hi, names, *_ = of(batch)
        distinct, at = np.unique(names, return_index=True)
        # what this task has sent already would only be sent again
        place, new = absent(sent[0], distinct)
        distinct, at = distinct[new], np.sort(at[new])
        sent[0] = np.insert(sent[0], place[new], distinct) if len(sent[0]) + len(distinct) <= SENT else distinct
        if not len(at):
            return
        names = names[at]
        # of a band's name its bucket and KEPT bits stay
        band, name = bands(*shingles(x, lo[at], hi[at], shingle)).ravel(), np.repeat(names, BANDS)
        short = band // np.uint64(buckets)
        bucket = band - short * np.uint64(buckets)
        short &= np.uint64((1 << KEPT) - 1)
        band = short * np.uint64(buckets) + bucket
        # lines of bands that are crowded here: the others all go on
        ordered = np.sort(band)
        crowd = ordered[KEEP:][ordered[KEEP:] == ordered[:-KEEP]]
        here, out = int(names[0] % np.uint64(buckets)), []
        # small numbers are sorted by their digits
        bucket = bucket.astype(np.uint16 if buckets <= 1 << 16 else np.int32)
        if len(crowd):
            # what is settled here goes to any bucket
            many = np.flatnonzero(np.isin(band, crowd))
            a, b, _, rest = _starred(band[many], name[many], KEEP)
            out.append((here, a.tobytes(), b.tobytes(), PAIR))
            out.append((here, band[many[rest]].tobytes(), name[many[rest]].tobytes(), MEMBER))
            stays = np.ones(len(band), bool)
            stays[many[rest]] = False
            bucket, short, name = bucket[stays], short[stays], name[stays]
        order = np.argsort(bucket, kind="stable")
        edge = np.r_[0, np.cumsum(np.bincount(bucket, minlength=buckets))]
        short, name = short[order].view(np.uint8).reshape(-1, 8)[:, : KEPT // 8], name[order]
        for k in np.flatnonzero(np.diff(edge)).tolist():
            out.append((k, short[edge[k] : edge[k + 1]].tobytes(), name[edge[k] : edge[k + 1]].tobytes(), OPEN))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32(), pa.binary(), pa.binary(), pa.int32()], strict=True)], fields)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for bucket, b, n, kind in zip(batch.column("bucket").to_pylist(), batch.column("bands"), batch.column("names"), batch.column("kind").to_pylist(), strict=True):
                two = np.frombuffer(n.as_buffer(), np.uint64)
                if kind == OPEN:
                    wide = np.zeros((len(two), 8), np.uint8)
                    wide[:, : KEPT // 8] = np.frombuffer(b.as_buffer(), np.uint8).reshape(len(two), -1)
                    held.setdefault(bucket, []).append((wide.view(np.uint64).ravel(), two))
                else:
                    yield _meeting(kind, np.frombuffer(b.as_buffer(), np.uint64), two)
        for bucket in list(held):
            short, name = (np.concatenate(c) for c in zip(*held.pop(bucket), strict=True))
            many = _several(short)
            # equal lines come from several slices
            one, two = short[many], name[many]
            order = np.lexsort((two, one))
            one, two = one[order], two[order]
            new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])][: len(one)]
            one, two = one[new] * np.uint64(buckets) + np.uint64(bucket), two[new]
            a, b, _, _ = _starred(one, two, 1)
            yield _meeting(PAIR, a, b)
            # bands side by side
            size = np.diff(np.flatnonzero(np.r_[True, one[1:] != one[:-1], True])) if len(one) else np.zeros(0, np.int64)
            large = np.repeat(size > SETTLED, size)
            yield _meeting(MEMBER, one[large], two[large])

    dealt = map_slices(docs, sign, "bucket int, bands binary, names binary, kind int", "text", *columns).repartitionById(buckets, F.col("bucket"))
    return dealt.mapInArrow(releasing(meet), "kind int, a long, b long")


def marks(cut: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """(lines, MARKS / 64) bits of the shingles of lines that shingles(...) has cut, a block of lines that fits a cache at a time."""
    names, starts, n = cut
    out, rows = np.empty((len(starts), MARKS // 8), np.uint8), (1 << 21) // MARKS
    shift = np.uint64(64 - (MARKS.bit_length() - 1))
    for lo in range(0, len(starts), rows):
        first, size = starts[lo : lo + rows], n[lo : lo + rows]
        bits = np.zeros((len(first), MARKS), bool)
        place = (names[_places(first, size)] >> shift).view(np.int64)
        bits.ravel()[np.repeat(np.arange(len(first)) * MARKS, size) + place] = True
        out[lo : lo + rows] = np.packbits(bits, axis=1)
    return out.view(np.uint64)


def possible(bits: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of lines may be similar enough, by their marks and numbers of shingles; none that is gets lost.

    Each bit of one line only stands for a shingle at least that the other does not have.
    """
    out = np.empty(len(i), bool)
    for lo in range(0, len(i), 1 << 12):
        a, b = i[lo : lo + (1 << 12)], j[lo : lo + (1 << 12)]
        one, two = bits[a], bits[b]
        both = one & two
        less, more = (np.bitwise_count(x ^ both).sum(axis=1, dtype=np.int64) for x in (one, two))
        common = np.minimum(n[a] - less, n[b] - more)
        out[lo : lo + (1 << 12)] = common >= similarity * (common + less + more) - 1e-9
    return out


def alike(cut: tuple[np.ndarray, np.ndarray, np.ndarray], bits: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Places of the pairs of lines that are similar enough. cut: of shingles(...); bits: their marks."""
    able = np.flatnonzero(possible(bits, cut[2], i, j, similarity))
    return able[similar(cut, i[able], j[able], similarity)]


def similar(cut: tuple[np.ndarray, np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of lines that shingles(...) has cut are similar enough, compared exactly."""
    names, starts, n = cut
    out = np.zeros(len(i), bool)
    work = np.cumsum(n[i] + n[j])
    for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(work // HELD)) + 1) if len(i) else []:
        both = np.concatenate([i[part], j[part]])
        size, wide = n[both], max(1, len(part) - 1).bit_length()
        # pair, shingle, side; one sort brings both sides of a pair together
        pair, rest = np.tile(np.arange(len(part), dtype=np.uint64), 2) << np.uint64(64 - wide), np.uint64(((1 << 64 - wide) - 1) & ~1)
        pair[len(part) :] |= np.uint64(1)
        key = names[_places(starts[both], size)]
        key >>= np.uint64(wide)
        key &= rest
        key |= np.repeat(pair, size)
        key.sort()
        # shingles of a line count once
        key = key[np.r_[True, key[1:] != key[:-1]]]
        of = (key >> np.uint64(64 - wide)).view(np.int64)
        total = np.bincount(of, minlength=len(part))
        common = np.bincount(of[1:][key[1:] ^ key[:-1] == 1], minlength=len(part))
        out[part] = common >= similarity * (total - common) - 1e-9
    return out


def _tile_links(batch: pa.RecordBatch, similarity: float, shingle: int | Callable) -> tuple[np.ndarray, np.ndarray]:
    """Links a, b among the lines of each tile of a batch (in tile order) that are in different components."""
    tile, name, root, part = (batch.column(c).to_numpy() for c in ("tile", "name", "root", "part"))
    apart, ours = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("apart", "ours"))
    texts, edge = batch.column("text"), np.r_[np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]]), len(tile)]
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first, last in slices(texts):
        # the tiles that begin in this slice
        of = edge[:-1][(edge[:-1] >= first) & (edge[:-1] < last)]
        if not len(of):
            continue
        end = int(edge[np.searchsorted(edge, of[-1]) + 1])
        base, size = int(of[0]), np.diff(np.r_[of, end])
        x = Texts(plain(texts.slice(base, end - base)))
        cut = shingles(x, x.starts[:-1], x.starts[1:], shingle)
        bits = marks(cut)
        # lines of a band's largest component first; each other line meets those before it in its tile
        order = np.lexsort((~ours[base:end], np.repeat(np.arange(len(of)), size)))
        before = np.where(ours[base:end][order], 0, ragged(size))
        done = np.cumsum(before)
        for some in np.split(np.arange(len(before)), np.flatnonzero(np.diff(done // PAIRS)) + 1):
            i = np.repeat(some, before[some])
            j = order[i - 1 - ragged(before[some])]
            i = order[i]
            r, p = root[base:end], part[base:end]
            fits = (r[i] != r[j]) & ~(apart[base:end][i] & (p[i] == p[j]))
            i, j = i[fits], j[fits]
            for c in range(0, len(i), PAIRS):
                a, b = i[c : c + PAIRS], j[c : c + PAIRS]
                ok = alike(cut, bits, a, b, similarity)
                found_a.append(name[base:end][a[ok]])
                found_b.append(name[base:end][b[ok]])
    return np.concatenate(found_a), np.concatenate(found_b)


def remaining(members: DataFrame, roots: DataFrame, texts: DataFrame, similarity: float, lines: int = 256, chars: int = 1 << 16, shingle: int | Callable = SHINGLE) -> DataFrame:
    """Links a, b of lines that share a band (members: band, name) in different components (roots: node, root).

    texts: name, text and, if known, chars. Large bands are cut into parts of about so many lines or characters, and every
    two parts meet in a tile. The lines of a band's largest component meet the others only, not each
    other, so the work grows with a band's lines times those outside of its largest component.
    """
    placed = members.toDF("band", "member").join(roots, F.col("member") == F.col("node"), "left").select("band", "member", F.coalesce("root", "member").alias("root"))
    placed = written(placed, "placed")
    # bands in which components meet; written so that the joins see their size
    mixed = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("band")
    long = F.col("chars") if "chars" in texts.columns else F.char_length("text")
    placed = written(placed.join(written(mixed, "open_bands"), "band").join(texts.select(F.col("name").alias("member"), long.alias("chars")), "member"), "placed")
    sizes = placed.groupBy("band", "root").agg(F.count("*").alias("k"), F.sum("chars").alias("n")).groupBy("band")
    sizes = sizes.agg(F.max_by(F.struct("root", "k", "n"), F.struct("k", "root")).alias("main"), F.sum("k").alias("k"), F.sum("n").alias("n"))
    parts = lambda k, n: F.greatest(F.ceil(k / lines), F.ceil(n / chars)).cast("int")
    sizes = sizes.select("band", F.col("main.root").alias("main"), parts(F.col("main.k"), F.col("main.n")).alias("ours"), parts(F.col("k") - F.col("main.k"), F.col("n") - F.col("main.n")).alias("others"))
    rows = placed.join(written(sizes, "sizes"), "band").join(texts.select(F.col("name").alias("member"), "text"), "member")
    ours, part = F.col("root") == F.col("main"), F.col("part")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("member"), F.when(ours, F.col("ours")).otherwise(F.col("others"))).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # apart: only lines of different parts are compared there, as those of one part meet in their own tile
    spot = lambda kind, p, q, apart: F.struct(F.xxhash64("band", F.lit(kind), p, q).alias("tile"), apart.alias("apart"))
    tiles = F.when(ours, F.transform(every("others"), lambda o: spot("ours", part, o, F.lit(False)))).otherwise(
        F.concat(F.transform(every("ours"), lambda o: spot("ours", o, part, F.lit(False))), F.transform(every("others"), lambda o: spot("others", F.least(o, part), F.greatest(o, part), o != part)))
    )
    rows = rows.select("member", "root", "part", ours.alias("ours"), "text", F.explode(tiles).alias("at")).select("at.tile", "at.apart", F.col("member").alias("name"), "root", "part", "ours", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None

        def found(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            node, low = local_components(*_tile_links(rows, similarity, shingle))
            yield pa.RecordBatch.from_arrays([pa.array(node[node != low]), pa.array(low[node != low])], ["a", "b"])

        for batch in batches:
            batch = pa.RecordBatch.from_arrays([plain(c) if f == "text" else c for f, c in zip(batch.schema.names, batch.columns, strict=True)], batch.schema.names)
            tail = batch if tail is None else pa.concat_batches([tail, batch])
            if tail.num_rows:
                tile = tail.column("tile").to_numpy()
                whole = int(np.searchsorted(tile, tile[-1]))
                yield from found(tail.slice(0, whole))
                tail = tail.slice(whole)
        if tail is not None:
            yield from found(tail)

    return rows.repartition(partitions(members.sparkSession), "tile").sortWithinPartitions("tile").mapInArrow(releasing(compare), "a long, b long")


def verified(pairs: DataFrame, similarity: float, shingle: int | Callable = SHINGLE) -> DataFrame:
    """The rows a, b of pairs (a, b, text_a, text_b) whose shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo, hi in slices(plain(whole.column("text_a"))):
                for at in range(lo, hi, 1024):
                    batch = whole.slice(at, min(1024, hi - at))
                    texts = pa.concat_arrays([plain(batch.column("text_a")), plain(batch.column("text_b"))])
                    x, every, n = Texts(texts), np.arange(len(texts)), batch.num_rows
                    # most of these pairs are alike, so bounds would spare little
                    ok = similar(shingles(x, x.starts[:-1], x.starts[1:], shingle), every[:n], every[n:], similarity)
                    yield batch.select(["a", "b"]).filter(pa.array(ok))

    return pairs.mapInArrow(releasing(run), "a long, b long")


def paired(met: DataFrame, also: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The distinct pairs a < b of meetings(...) and of also, and the names of their lines."""
    pairs = met.filter(F.col("kind") == PAIR).select("a", "b")
    pairs = written((pairs if also is None else pairs.union(also)).distinct(), "pairs")
    return pairs, pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct()


def linked(met: DataFrame, pairs: DataFrame, texts: DataFrame, similarity: float, shingle: int | Callable = SHINGLE) -> DataFrame:
    """node, root of all lines that are linked to others. met: of meetings; pairs: of paired(...); texts: name, chars, text of the lines in pairs."""
    of = lambda x: texts.select(F.col("name").alias(x), F.col("text").alias(f"text_{x}"))
    full = pairs.join(of("a"), "a").join(of("b"), "b")
    links = written(verified(full.select("a", "b", "text_a", "text_b"), similarity, shingle), "links")
    roots = written(components(links), "roots")
    members = met.filter(F.col("kind") == MEMBER).select(F.col("a").alias("band"), F.col("b").alias("name"))
    more = written(remaining(members, roots, texts, similarity, shingle=shingle), "remaining")
    return roots if more.isEmpty() else components(links.union(more))


def drops(docs: DataFrame, similarity: float = SIMILARITY, shingle: int | Callable = SHINGLE) -> DataFrame:
    """k, d (key and doc_id) and lines, the numbers of the lines that go, for each document that loses any. docs: keyed."""
    found = written(occurrences(docs), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "line")
    firsts = written(found.groupBy("name").agg(F.min(place).alias("first"), F.count("*").alias("n")), "names")
    met = written(meetings(docs, firsts.count(), shingle), "meetings")
    # the texts of candidates, each from its first occurrence
    pairs, wanted = paired(met)
    homes = written(firsts.join(wanted.hint("shuffle_hash"), "name").select("name", F.col("first.doc_id").alias("d"), F.col("first.key").alias("k"), F.col("first.line").alias("line")), "homes")
    per_doc = homes.groupBy("k", "d").agg(F.collect_list(F.struct("line", "name")).alias("want"))
    held = docs.join(per_doc, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")))
    cut = F.transform("want", lambda w: F.struct(w["name"].alias("name"), F.get(F.col("lines"), w["line"]).alias("text")))
    texts = held.select(F.split("text", "\n").alias("lines"), "want").select(F.inline(cut))
    texts = written(texts.select("name", F.char_length("text").alias("chars"), "text"), "texts")
    # only repeated rows bring a line twice
    if texts.count() > homes.count():
        texts = written(texts.dropDuplicates(["name"]), "texts")
    roots = linked(met, pairs, texts, similarity, shingle)
    # of a component the first occurrence of all its lines stays, of any other line that occurs twice or more its own
    some = firsts.select(F.col("name").alias("node"), "first", "n").join(roots, "node", "left").filter(F.col("root").isNotNull() | (F.col("n") > 1))
    named = written(some.select("node", "root", "first"), "named")
    # written, so that the join sees its size and adaptive execution can split a large component
    least = written(named.filter("root is not null").groupBy("root").agg(F.min("first").alias("stays")), "least")
    keep = named.join(least, "root").select("node", "stays").union(named.filter("root is null").select("node", F.col("first").alias("stays")))
    gone = found.select("doc_id", "key", "line", F.col("name").alias("node")).join(keep.hint("shuffle_hash"), "node").filter(place != F.col("stays"))
    return gone.groupBy(F.col("key").alias("k"), F.col("doc_id").alias("d")).agg(F.collect_set("line").alias("lines"))


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, shingle: int | Callable = SHINGLE) -> DataFrame:
    """All columns of docs with n_lines, n_removed and the text of the kept lines."""
    columns = docs.columns
    others = [c for c in columns if c != "text"]
    plain_docs = docs.select(F.struct(*[F.col(quoted(c)) for c in others]).alias("whole"), "doc_id", "text")
    docs = keyed(plain_docs)
    gone = drops(docs.select("doc_id", "key", "text"), similarity, shingle)
    out = docs.join(gone, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")), "left")
    parts = F.split("text", "\n")
    # the numbers of the lines that stay; cut lines are bound once for each text
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("lines"))
    kept = F.element_at(F.transform(F.array(parts), lambda p: F.array_join(F.transform(stay, lambda i: F.get(p, i)), "\n")), 1)
    full = F.size(F.filter(parts, lambda x: F.ltrim(x, F.lit(" \t\n\x0b\x0c\r")) != ""))
    text = F.when(F.col("lines").isNull(), F.col("text")).otherwise(kept).alias("text")
    fields = [F.col("whole")[c].alias(c) for c in others if c not in ("n_lines", "n_removed")]
    out = out.select(*fields, text, F.coalesce(full, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"))
    return out.select(*[F.col(quoted(c)) for c in columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")
