"""Personal data: fixed forms, and identifiers that the contexts of these betray.

Base spans are the fixed forms (email, ip, card, phone). Around them lie contexts: the token before, the two
before, the token behind. Tokens are runs without white space, cut after ``:`` and ``=``; a context has a
letter and at most CONTEXT bytes. Things shaped like identifiers that are no base span (numbers that fail
Luhn's sum or lack a plus sign, addresses spelt with "at" and "dot" or with gaps, dotted numbers with brackets, colon-separated
hexadecimals) are candidates, and stand in contexts too.

Patterns (contexts by kind) and instances (the text found, without its separators) form a graph, scored in rounds of Spark joins.
A pattern's confidence is the sum of its instances' scores over their number and one more; a known instance counts one, a
candidate what its patterns gave it in the round before. Only patterns with SUPPORT different known or accepted instances
count, and only if at least SPECIFIC of all places of the context in the corpus hold something of the kind: "of" before a number is chance, "fax:" is
none. An instance's score is one less the product of its patterns' doubts; with ACCEPT or more it is accepted, all its
places become spans, and the patterns around these may be confident in the next round. The places of contexts are counted
over all texts, in a second scan that names only contexts which a bitmap of fixed size lets pass; the join after it is exact.

A null text is empty. Repeated rows are judged alike and give repeated rows (each counts as a place, none as another
instance). Added spans never overlap base ones; of candidates with the same place the best scored kind stays, of equal ones the first
as listed. An empty table gives an empty result; other columns are left out. A very long text is held whole by one task.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, written
from .textarrays import SEPARATOR, Texts, combine, plain

KINDS = ("email", "ip", "card", "phone")
#: Known or accepted instances that a pattern needs, share of its context's places, score of an instance, rounds.
SUPPORT, SPECIFIC, ACCEPT, ROUNDS = 5, 0.25, 0.75, 4
#: Bytes of a context at most, and bits of the bitmap of contexts.
CONTEXT, BITS = 64, 1 << 23
LEFT, RIGHT = 1, 2

_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(rb"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = np.zeros(256, bool)
_LOCAL[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"]] = True
# candidates
_AT = re.compile(rb"(?: at | ?[\[({<] ?at ?[\])}>] ?| ?@ ?)([A-Za-z0-9-]{1,63}(?:(?: dot | ?[\[({<] ?dot ?[\])}>] ?| ?\. ?)[A-Za-z0-9-]{1,63})+)", re.I)
_COLONS = re.compile(rb"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Za-z:])")
_DOTTED = re.compile(rb"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| ?\. ?|_)[0-9]{1,3}){3}(?![0-9])")
_NUMBER = re.compile(rb"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().\-/*#x]{0,3}[0-9])+(?![0-9A-Za-z])")


def emails(raw: bytes, data: np.ndarray) -> list[tuple[int, int]]:
    """Base emails: every @ with a domain behind it, its local part as far left as it goes or the one before ends."""
    out, end = [], 0
    for at in np.flatnonzero(data == 64).tolist():
        if at < end or not (m := _DOMAIN.match(raw, at + 1)):
            continue
        start = at
        while start > end and _LOCAL[data[start - 1]]:
            start -= 1
        if start < at:
            out.append((start, end := m.end()))
    return out


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = (c - 48) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(text: bytes) -> bytes:
    return bytes(c for c in text if 48 <= c <= 57)


def base_spans(raw: bytes, data: np.ndarray) -> list[list[tuple[int, int]]]:
    """Byte spans by kind."""
    ips = [m.span() for m in _IP.finditer(raw) if all(len(p.lstrip(b"0")) < 4 and int(p.lstrip(b"0") or b"0") <= 255 for p in m[0].split(b"."))]
    cards = [m.span() for m in _CARD.finditer(raw) if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    phones = [m.span() for m in _PHONE.finditer(raw) if 9 <= len(digits_of(m[0])) <= 15]
    return [emails(raw, data), ips, cards, phones]


def candidates(raw: bytes, data: np.ndarray, base: list[list[tuple[int, int]]]) -> list[tuple[int, int, int, bytes]]:
    """kind, start, end and instance of what is shaped like an identifier and touches no base span."""
    taken = sorted(x for spans in base for x in spans)
    starts, ends = np.array([a for a, _ in taken]), np.maximum.accumulate(np.array([b for _, b in taken] or [0]))

    def free(a: int, b: int) -> bool:
        k = int(np.searchsorted(starts, b)) - 1 if len(starts) else -1
        return k < 0 or ends[k] <= a

    out, spelt = [], 0
    for m in _AT.finditer(raw):
        start = m.start()
        while start > spelt and m.start() - start < 64 and _LOCAL[data[start - 1]]:
            start -= 1
        if start < m.start() and free(start, m.end()):
            domain = re.sub(rb"(?i)[\s\[\](){}<>.]+(?:dot)?[\s\[\](){}<>.]*", b".", m[1])
            out.append((0, start, spelt := m.end(), raw[start : m.start()].lower() + b"@" + domain.lower()))
    for form in (_COLONS, _DOTTED):
        for m in form.finditer(raw):
            if free(*m.span()) and digits_of(m[0]):
                out.append((1, *m.span(), re.sub(rb"[^0-9A-Fa-f]+", b".", m[0]).lower()))
    for m in _NUMBER.finditer(raw):
        if m.end() - m.start() >= 7 and free(*m.span()):
            n = len(d := digits_of(m[0]))
            if 13 <= n <= 19:
                out.append((2, *m.span(), d))
            if 7 <= n <= 15:
                out.append((3, *m.span(), d))
    return out


class Tokens(Texts):
    """Some texts in one buffer, A-Z in lower case and a line feed behind each, and the byte ranges of their tokens."""

    def __init__(self, x: Texts):
        rows = np.repeat(np.arange(x.rows), np.diff(x.starts))
        self.plain = np.full(len(x.data) + x.rows, 10, np.uint8)
        self.plain[np.arange(len(x.data)) + rows] = x.data
        self.rows, self.starts = x.rows, x.starts + np.arange(x.rows + 1)
        self.data = low = self.plain.copy()
        low[(low >= 65) & (low <= 90)] += 32
        inside, cut = ~SEPARATOR[low], (low == 58) | (low == 61)
        begins = inside & ~(np.r_[False, inside[:-1]] & ~np.r_[False, cut[:-1]])
        ends = inside & ~(np.r_[inside[1:], False] & ~np.r_[begins[1:], False])
        self.begin, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        letters = np.r_[0, np.cumsum(((low >= 97) & (low <= 122)) | (low >= 128))]
        self.lettered = letters[self.end] > letters[self.begin]
        self.size = self.end - self.begin
        self.name = self.names(self.begin, self.end)

    def single(self, k: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Names of contexts of one token, and which of them count."""
        return combine(self.name[k], np.full(len(k), side, np.uint64)).view(np.int64), self.lettered[k] & (self.size[k] <= CONTEXT)

    def pair(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names of contexts of the tokens k and k + 1."""
        return combine(self.name[k], self.name[k + 1], 1).view(np.int64), (self.lettered[k] | self.lettered[k + 1]) & (self.size[k] + self.size[k + 1] <= CONTEXT)

    def around(self, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> list[list[int]]:
        """The names of the contexts of spans: the whole token before each, the two before it, the one behind it, all of its text."""
        out: list[list[int]] = [[] for _ in start]
        if not len(start) or not len(self.begin):
            return out
        last = np.searchsorted(self.end, start, "right") - 1
        following = np.searchsorted(self.begin, end)

        def add(k: np.ndarray, there: np.ndarray, of) -> None:
            who = np.flatnonzero(there)
            name, good = of(k[who])
            for i, n in zip(who[good].tolist(), name[good].tolist(), strict=True):
                out[i].append(n)

        first = np.maximum(last, 0)
        before = (last >= 0) & (self.begin[first] >= self.starts[row])
        add(last, before, lambda k: self.single(k, LEFT))
        add(last - 1, before & (last >= 1) & (self.begin[np.maximum(first - 1, 0)] >= self.starts[row]), self.pair)
        behind = np.minimum(following, len(self.begin) - 1)
        add(following, (following < len(self.begin)) & (self.begin[behind] < self.starts[row + 1]), lambda k: self.single(k, RIGHT))
        return out


def marks(docs: DataFrame) -> DataFrame:
    """row, doc_id and seen (kind, start, end in code points, known, instance, names of contexts) of each row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = Tokens(Texts(plain(batch.column("text"))))
        raw = t.plain.tobytes()
        points = np.r_[0, np.cumsum((t.plain & 0xC0) != 0x80)]
        base = base_spans(raw, t.plain)
        spans = [(k, a, b, True, digits_of(raw[a:b]) if k > 1 else raw[a:b].lower()) for k, some in enumerate(base) for a, b in some]
        spans += [(k, a, b, False, i) for k, a, b, i in candidates(raw, t.plain, base)]
        start, end = np.array([x[1] for x in spans], np.int64), np.array([x[2] for x in spans], np.int64)
        row = np.searchsorted(t.starts, start, "right") - 1
        seen: list[list[dict]] = [[] for _ in range(t.rows)]
        for (kind, a, b, known, instance), r, names in zip(spans, row.tolist(), t.around(start, end, row), strict=True):
            at = points[t.starts[r]]
            seen[r].append({"kind": kind, "start": int(points[a] - at), "end": int(points[b] - at), "known": known, "instance": xxhash.xxh64_intdigest(instance) - (1 << 63), "contexts": names})
        return pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(seen, _SEEN)], ["row", "doc_id", "seen"])

    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "row long, doc_id long, seen array<struct<kind:int,start:int,end:int,known:boolean,instance:bigint,contexts:array<bigint>>>"
    return map_slices(named, run, schema, "row", "doc_id", "text")


_SEEN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("known", pa.bool_()), ("instance", pa.int64()), ("contexts", pa.list_(pa.int64()))]))


def bitmap(names: DataFrame) -> np.ndarray:
    """BITS bits, those of the names (column name, long) set: at most BITS / 64 words come to the driver."""
    bit = F.pmod("name", F.lit(BITS))
    words = names.groupBy(F.floor(bit / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def places(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """name and places of the contexts that the bitmap lets pass, over all texts; what it lets pass by chance goes in the join that follows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = Tokens(Texts(plain(batch.column("text"))))
        every = np.arange(len(t.begin))
        row = np.searchsorted(t.starts, t.begin, "right")
        passed = []
        for name, good in (t.single(every, LEFT), t.single(every, RIGHT), t.pair(np.flatnonzero(row[1:] == row[:-1]))):
            passed.append(name[good & wanted[name % BITS]])
        name, n = np.unique(np.concatenate(passed), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(name), pa.array(n.astype(np.int64))], ["name", "n"])

    return map_slices(docs, run, "name long, n long", "text").groupBy("name").agg(F.sum("n").alias("places"))


def accepted(edges: DataFrame, occurs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, specific: float = SPECIFIC, accept: float = ACCEPT) -> DataFrame:
    """kind, instance and score of the candidates that confident patterns vouch for.

    edges: kind, name (of the context), instance, known, n (places); occurs: name, places. Each round is a written table, so
    lineage stays short; sums are made before they are shuffled, so a context or instance of very many rows is one row a task.
    """
    edges = edges.join(occurs, "name")
    total = edges.groupBy("kind", "name").agg(F.sum("n").alias("held"), F.max("places").alias("places"))
    edges = written(edges.join(total.filter(F.col("held") >= specific * F.col("places")).select("kind", "name"), ["kind", "name"]).select("kind", "name", "instance", "known"), "edges")
    scores = None
    for _ in range(rounds):
        value = F.when(F.col("known"), 1.0)
        judged = edges.withColumn("score", value.otherwise(0.0)) if scores is None else edges.join(scores, ["kind", "instance"], "left").withColumn("score", value.otherwise(F.coalesce("score", F.lit(0.0))))
        sure = F.count(F.when(F.col("score") >= accept, 1))
        patterns = judged.groupBy("kind", "name").agg((F.sum("score") / (F.count("*") + 1)).alias("confidence"), sure.alias("sure")).filter(F.col("sure") >= support)
        doubt = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))))
        new = edges.filter(~F.col("known")).join(patterns.select("kind", "name", "confidence"), ["kind", "name"]).groupBy("kind", "instance").agg((1 - F.exp(doubt)).alias("score"))
        scores = written(new, "scores")
    return scores.filter(F.col("score") >= accept)


def found(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base spans), spans (all of them), n_added; see accepted for limits.

    Spans are kind:start:end in code points, end exclusive, by kind as listed, then start, joined by commas.
    """
    docs = docs.select("doc_id", "text")
    seen = written(marks(docs), "marks")
    each = seen.select("row", F.inline("seen")).withColumnsRenamed({"start": "begin", "end": "stop"})
    edges = each.select("kind", "instance", "known", F.explode("contexts").alias("name")).groupBy("kind", "name", "instance").agg(F.max("known").alias("known"), F.count("*").alias("n"))
    support = limits.get("support", SUPPORT)
    edges = written(edges, "contexts")
    # a pattern needs so many instances, whether they are known now or later
    enough = edges.groupBy("kind", "name").agg(F.count("*").alias("instances")).filter(F.col("instances") >= support).select("kind", "name")
    edges = written(edges.join(enough, ["kind", "name"]), "edges")
    rows = seen
    if not edges.isEmpty():
        occurs = written(places(docs, bitmap(edges.select("name").distinct())), "places")
        good = accepted(edges, occurs, **limits)
        added = each.filter(~F.col("known")).join(good, ["kind", "instance"]).groupBy("row", "begin", "stop").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
        added = added.groupBy("row").agg(F.collect_list(F.struct("kind", F.col("begin").alias("start"), F.col("stop").alias("end"))).alias("added"))
        rows = seen.join(added, "row", "left")
    else:
        rows = rows.withColumn("added", F.lit(None).cast("array<struct<kind:int,start:int,end:int>>"))
    nothing = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    base = F.transform(F.filter("seen", lambda s: s["known"]), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    names = F.array(*map(F.lit, KINDS))
    text = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    rows = rows.select("doc_id", base.alias("base"), F.coalesce("added", nothing).alias("added"))
    return rows.select("doc_id", *[number(k) for k in range(4)], F.sha2(text("base"), 256).alias("base_sha256"), text(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
