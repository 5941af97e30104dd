from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from data import SF, WORD, frame, rows
from tokenizers import Tokenizer

from llm import components, jpeg, language, line_dedup, media, mixing, packing, quality, simhash, substring_dedup, warc, wavelet
from llm.queries import queries

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
words_of = lambda t: WORD.findall(t or "")


def bag(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def sf_rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


# 1: substring dedup


def removed(pairs, window=13):
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, t in pairs:
        w = words_of(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, (True, 2**70)), order(i))
    out = Counter()
    for i, t in pairs:
        w, gone = words_of(t), set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < order(i):
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("window", [13, 8])
def test_substring_dedup(spark, window):
    for pairs, df in ((sf_rows(spark), spark.read.parquet(f"{SF}/documents.parquet")), ([r[:2] for r in rows()], frame(spark))):
        got = bag(substring_dedup.remove_repeats(df, window), "doc_id", "n_words", "n_removed", "kept_sha256")
        assert got == removed(pairs, window)
        assert sum(k[2] for k in got)


def test_substring_dedup_runs_and_empty(spark):
    r = random.Random(4)
    some = [(i, " ".join(r.choice("ab") * r.randint(1, 3) if r.random() < 0.1 else r.choice(["a", "a", "b", "c d"]) for _ in range(r.randint(0, 60)))) for i in range(150)]
    df = spark.createDataFrame(some, "doc_id long, text string")
    assert bag(substring_dedup.remove_repeats(df), "doc_id", "n_words", "n_removed", "kept_sha256") == removed(some)
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.remove_repeats(df, 6)


# 2: packing


def test_packing(spark):
    df, tokenizer = frame(spark), Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    got = packing.pack(df, WORDS, group=20).collect()
    want = Counter()
    for r in rows():
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            want[r[0], k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    full = defaultdict(list)
    for r in got:
        full[r.sequence_id].append((r.offset, r.length))
    for parts in full.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0, *[n for _, n in parts]])[:-1])
        assert sum(n for _, n in parts) <= 4096
    assert packing.pack(df.limit(0), WORDS).count() == 0


def least_bins(items, capacity):
    best = [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + items[k] <= capacity:
                bins[b] += items[k]
                go(k + 1, bins)
                bins[b] -= items[k]
        go(k + 1, [*bins, items[k]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    r = random.Random(1)
    for _ in range(150):
        capacity = r.randint(5, 30)
        items = sorted((r.randint(1, capacity) for _ in range(r.randint(1, 9))), reverse=True)
        lengths = np.array(items)
        fixed, left = packing.reduce_instance(lengths, capacity)
        assert sorted([i for f in fixed for i in f] + left) == list(range(len(items)))
        assert all(lengths[f].sum() <= capacity for f in fixed)
        assert least_bins(items, capacity) == len(fixed) + least_bins([items[i] for i in left], capacity)
        assert max(packing.pack_group(lengths, capacity)[0]) + 1 <= 1.5 * least_bins(items, capacity) + 1


# 3: mixing


def test_mix(spark):
    for values, df in ((rows(), frame(spark)), (None, spark.read.parquet(f"{SF}/documents.parquet"))):
        values = values or [tuple(r) for r in df.collect()]
        got = mixing.mix(df).collect()
        assert len(got) == len(values)
        size = Counter()
        for r in values:
            size[r[3]] += len(words_of(r[1]))
        aims = mixing.targets(dict(size), 1.5, (5, 2, 1), 2.0)
        assert abs(sum(aims.values()) - 1.5 * sum(size.values())) < 1e-6
        taken = Counter()
        for r in got:
            assert r.taken == r.copies * r.size and 0 <= r.taken <= 2 * r.size
            assert abs(r.target - aims[r.source]) < 1e-6 and r.source_size == size[r.source]
            taken[r.source] += r.taken
        largest = Counter()
        for r in got:
            largest[r.source] = max(largest[r.source], r["size"])
        for s in size:
            assert abs(taken[s] - aims[s]) <= largest[s]
        assert sum(abs(taken[s] - aims[s]) for s in size) < 0.02 * sum(size.values()) + max(largest.values())
        again = mixing.mix(df.repartition(2))
        assert bag(again, "doc_id", "taken") == Counter((r.doc_id, r.taken) for r in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_targets_and_flight():
    assert mixing.targets({"a": 10, "b": 1000, "c": 1000, None: 0}, 1.5, (5, 2, 1), 2.0) == {"a": 20.0, "b": 1996.6666666666667, "c": 998.3333333333334, None: 0.0}
    p, sizes = np.random.default_rng(0).random(500), np.random.default_rng(1).integers(0, 900, 500)
    q = mixing.flight(p, sizes, np.random.default_rng(2))
    assert ((q > 0) & (q < 1)).sum() <= 2 and abs(q.sum() - p.sum()) < 1e-6 and abs((q * sizes).sum() - (p * sizes).sum()) < 1e-3
    # unbiased: every probability is the mean of its outcomes
    mean = np.mean([mixing.flight(p[:6], sizes[:6], np.random.default_rng(s)) for s in range(3000)], axis=0)
    assert np.abs(mean - p[:6]).max() < 0.05


# 4: SimHash


def fingerprint(text):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in words_of(text)]
    parts = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps, radius=2):
    parent = {f: f for f in fps}
    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= radius:
                parent[max(find(parent, a), find(parent, b))] = min(find(parent, a), find(parent, b))
    return {f: find(parent, f) for f in fps}


def test_simhash(spark):
    for values, df in ((rows(), frame(spark)), (sf_rows(spark), spark.read.parquet(f"{SF}/documents.parquet"))):
        fp = [fingerprint(r[1]) for r in values]
        root = linked(set(fp))
        least = defaultdict(list)
        for r, f in zip(values, fp, strict=True):
            least[root[f]].append(r[0])
        want = Counter((r[0], f"{f:016x}", min((i for i in least[root[f]] if i is not None), default=None)) for r, f in zip(values, fp, strict=True))
        got = simhash.near_duplicates(df)
        assert bag(got.select("doc_id", simhash.hex_digits().alias("f"), "component_id"), "doc_id", "f", "component_id") == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [4, 512])
def test_links_are_exact_for_crowded_tiles(spark, tile):
    r = random.Random(tile)
    seeds = [r.getrandbits(64) for _ in range(3)]
    fps = {s ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 4))) & (2**64 - 1) for s in seeds for _ in range(120)} | {r.getrandbits(21) for _ in range(200)}
    signed = lambda f: f - 2**64 if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = {r.node: r.root for r in components.components(simhash.links(df, 2, tile)).collect()}
    groups, want = defaultdict(set), defaultdict(set)
    for f, root in linked(fps).items():
        groups[found.get(signed(f), signed(f))].add(f)
        want[root].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components(spark):
    r = random.Random(0)
    ids = [r.getrandbits(62) for _ in range(400)]
    edges = [(ids[i], ids[i + 1]) for i in range(120)] + [(r.choice(ids[150:]), r.choice(ids[150:])) for _ in range(120)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    parent = {i: i for e in edges for i in e}
    for a, b in edges:
        parent[find(parent, a)] = find(parent, b)
    assert len({got[n] for n in got}) == len({find(parent, n) for n in parent})
    assert all(got[a] == got[b] for a, b in edges)


# 5: quality


def longest(w):
    out = [0] * len(w)
    for i in range(len(w)):
        for j in range(len(w)):
            k = 0
            while i != j and max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def test_quality(spark):
    values = [r for r in rows() if len(words_of(r[1])) < 400]
    got = quality.judged(frame(spark, values), 4)
    want = Counter()
    for r in values:
        text, w = r[1] or "", words_of(r[1])
        found = defaultdict(list)
        for k in range(len(w) - 2):
            found[tuple(w[k : k + 3])].append(k)
        triples = {x for v in found.values() if len(v) > 1 for k in v for x in range(k, k + 3)}
        seen, same = set(), 0
        for line in text.split("\n"):
            if words_of(line):
                same += line in seen
                seen.add(line)
        spans = [(k, n) for k, n in enumerate(longest(w)) if n >= 4]
        covered = {x for k, n in spans for x in range(k, k + n)}
        base = len(w) < 50 or 100 * len(triples) > 50 * len(w)
        most = max((n for _, n in spans), default=0)
        kept = not (base or len(covered) > 0.5 * len(w) or most > 100 and most > 0.2 * len(w))
        want[r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), same, len(triples), len(covered), most, base, kept] += 1
    assert bag(got, "doc_id", *quality.FIELDS, "base_failed", "kept") == want
    assert quality.judged(frame(spark, [])).count() == 0


def test_quality_keeps_good_documents(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    seen = quality.judged(docs).join(labels, "doc_id").collect()
    good = [r.kept for r in seen if r.quality == 1 and not r.base_failed]
    assert sum(good) >= 0.99 * len(good)


# 6: language


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    network = language.learn(docs, per_label=200)
    got = {r.doc_id: r for r in language.identify(docs, network).collect()}
    true = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in got if got[i].held_out]
    assert set(held) == {i for i in true if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([got[i].lang_pred == true[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = {tuple(r)[0]: r for r in language.identify(frame(spark, [(1, None, *[None] * 9), (2, "", *[None] * 9), (3, "12 ?!", *[None] * 9), (None, "the", *[None] * 9)]), network).collect()}
    assert [odd[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and odd[None].lang_pred in network.labels
    assert language.learn(docs.limit(0)) is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}


def test_windows_cover_whole_texts():
    from llm.textarrays import Texts

    texts = ["", "ab", "é" * 500, "x" * 192, "y" * 193]
    w, row = language.windows(Texts.of(texts))
    for k, t in enumerate(texts):
        raw = t.encode()
        mine = w[row == k]
        assert b"".join(v[:192].tobytes() for v in mine).rstrip(b" ") == raw
        assert all(v.tobytes() == raw[i * 192 : i * 192 + language.LOOK].ljust(language.LOOK) for i, v in enumerate(mine))


# 7: media


def test_media(spark):
    got = media.media(frame(spark), files=True, tensors=True).collect()
    by_text = defaultdict(set)
    texts = {r[0]: r[1] for r in rows()}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(bytes(r.media)).hexdigest())
        assert len(r.rgb) == r.height * r.width * 3
        by_text[raw].add((r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values())
    assert media.media(frame(spark, [])).count() == 0


def test_media_any_bytes():
    for payload in (bytes(range(256)) * 3, b"\xff" * 192, b"\x00" * 384, b"?" * 192, b"x" * (192 * 9000)):
        assert media.load(media.store(payload))[0] == payload


def general(values, sampling, height, width):
    """A progressive file of any coefficients, written plainly: DC, AC in two bands, each with one bit left for a second pass."""
    import struct

    size = lambda v: abs(v).bit_length()
    bits_of = lambda v: format(v if v > 0 else v + (1 << size(v)) - 1, f"0{size(v)}b") if v else ""
    symbols = [*range(0, 12), *[r << 4 | s for r in range(16) for s in range(1, 11)], *[r << 4 for r in range(1, 16)]]
    symbols = sorted(set(symbols))
    table, codes = jpeg._table(0x00, symbols)
    out = [b"\xff\xd8", jpeg._segment(0xDB, b"\0" + b"\x01" * 64), table, jpeg._table(0x10, symbols)[0]]
    out.append(jpeg._segment(0xC2, struct.pack(">BHHB", 8, height, width, 3) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(sampling))))
    emit = lambda s: format(codes[s][0], f"0{codes[s][1]}b")
    image = jpeg.Image(height, width, sampling, values, [], b"")

    def scan(head, text):
        out.append(jpeg._segment(0xDA, head))
        out.append(jpeg._stuffed(np.frombuffer(text.encode(), np.uint8) - 48))

    places = jpeg._places(image, [(c, 0) for c in range(3)])
    flat, last, text = [v.reshape(-1, 64) for v in values], [0] * 3, []
    for u in range(len(places[0])):
        for c in range(3):
            for b in places[c][u]:
                v = int(flat[c][b, 0]) >> 1
                text.append(emit(size(v - last[c])) + bits_of(v - last[c]))
                last[c] = v
    scan(bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 1]), "".join(text))
    scan(bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 0x10]), "".join(str(int(flat[c][b, 0]) & 1) for u in range(len(places[0])) for c in range(3) for b in places[c][u]))
    shift = lambda v: int(v) >> 1 if v >= 0 else -(-int(v) >> 1)
    for c in range(3):
        order = jpeg._places(image, [(c, 0)])[0][:, 0]
        for lo, hi in ((1, 5), (6, 63)):
            text = []
            for b in order:
                run = 0
                for k in range(lo, hi + 1):
                    v = shift(flat[c][b, k])
                    if not v:
                        run += 1
                        continue
                    while run > 15:
                        text.append(emit(0xF0))
                        run -= 16
                    text.append(emit(run << 4 | size(v)) + bits_of(v))
                    run = 0
                if run:
                    text.append(emit(0))
            scan(bytes([1, c + 1, 0, lo, hi, 1]), "".join(text))
        text = []
        for b in order:
            run, fixes = 0, ""
            for k in range(1, 64):
                v, was = int(flat[c][b, k]), shift(flat[c][b, k])
                if was:
                    fixes += str(abs(v) & 1)
                elif v:
                    text.append(emit(run << 4 | 1) + ("1" if v > 0 else "0") + fixes)
                    run, fixes = 0, ""
                else:
                    run += 1
                    if run == 16:
                        # sixteen zeros, if something new follows
                        if any(shift(x) == 0 and x for x in flat[c][b, k + 1 :]):
                            text.append(emit(0xF0) + fixes)
                            run, fixes = 0, ""
                        else:
                            run = 15
            if run or fixes:
                text.append(emit(0) + fixes)
        scan(bytes([1, c + 1, 0, 1, 63, 0x10]), "".join(text))
    return b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize("sampling", [[(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
def test_general_progressive_files(sampling):
    r = np.random.default_rng(len(sampling) + sampling[0][0] * 2 + sampling[0][1])
    height, width = 43, 37
    wide, tall = sampling[0]
    units = -(-height // (8 * tall)), -(-width // (8 * wide))
    values = []
    for h, v in sampling:
        some = r.integers(-60, 60, (units[0] * v, units[1] * h, 64)) * (r.random((units[0] * v, units[1] * h, 64)) < 0.2)
        some[..., 0] = r.integers(-300, 300, some.shape[:2])
        values.append(some.astype(np.int32))
    image = jpeg.decode(general(values, sampling, height, width))
    for c, (a, b) in enumerate(zip(image.blocks, values, strict=True)):
        # blocks beyond the image are coded in the DC scan only
        order = jpeg._places(image, [(c, 0)])[0][:, 0]
        assert (a.reshape(-1, 64)[order] == b.reshape(-1, 64)[order]).all()
    rgb = jpeg.pixels(image)
    assert rgb.shape == (height, width, 3)
    # the inverse transform against its definition, at the middle of the first plane
    plane = image.blocks[0][0, 0]
    natural = np.zeros(64)
    natural[jpeg.ZIGZAG] = plane
    n = natural.reshape(8, 8)
    c = [np.sqrt(0.125)] + [0.5] * 7
    y = sum(c[u] * c[v] * n[u, v] * np.cos((2 * 3 + 1) * u * np.pi / 16) * np.cos((2 * 4 + 1) * v * np.pi / 16) for u in range(8) for v in range(8))
    whole = jpeg.Image(height, width, [(1, 1)] * 3, [image.blocks[0]] + [np.zeros_like(image.blocks[0])] * 2, [np.ones(64)] * 3, b"")
    assert abs(int(jpeg.pixels(whole)[3, 4, 0]) - np.clip(y + 128, 0, 255)) <= 1


# 8: WARC


def test_warc(spark, tmp_path):
    r = random.Random(5)
    big = ["<p>" + "é" * n + "</p>" for n in (600, 700, 498)]
    pages = [(i, f"http://x/{i}", r.choice([*big, "", None, "small", "z" * 300_000 if i == 3 else "y"]), "t") for i in range(60)] + [(None, None, big[0], "t"), (7, "again", "y", "t")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest string").repartition(3)
    path = warc.archived(df, f"file://{tmp_path}/a")
    archive = lambda: warc.opened(spark, path)
    groups = defaultdict(list)
    for p in pages:
        if len((p[2] or "").encode()) >= 1000:
            groups[p[2]].append(p[0])
    want = Counter()
    for p in pages:
        last = max((i for i in groups[p[2]] if i is not None), default=None) if p[2] in groups else None
        revisit = last is not None and last != p[0]
        raw = (p[2] or "").encode()
        want[p[0], len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", last if revisit else None] += 1
    assert bag(warc.digests(spark, path), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    full = {x.page_id: bytes(x.payload) for x in archive().filter("warc_type = 'response'").collect()}
    assert all(full[p[0]] == (p[2] or "").encode() for p in pages if p[0] in full and p[0] != 7)
    some = warc.opened(spark, path, False).filter("warc_type = 'revisit'").select("page_id")
    assert "Filter" not in some._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
    assert some.count() == sum(n for k, n in want.items() if k[3] == "revisit")
    assert archive().filter("refers_to is null and digest = '%s'" % hashlib.sha1(b"small").hexdigest()).count() == sum(p[2] == "small" for p in pages)
    assert warc.digests(spark, warc.archived(df.limit(0), f"file://{tmp_path}/b")).count() == 0


def test_warc_members_are_gzip():
    import gzip

    raw = warc.record(1, "response", "http://a/\r\nb", "d", 3, None, b"abc")
    assert gzip.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and gzip.decompress(raw).endswith(b"\r\n\r\nabc\r\n\r\n")
    assert gzip.decompress(raw + raw) == gzip.decompress(raw) * 2


def test_warc_of_other_writers(spark, tmp_path):
    import gzip

    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>" + b"long " * 40_000
    one = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nwarc-target-uri: http://a/\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n" % len(block)
    two = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:2>\r\nContent-Length: 3\r\n\r\n"
    plain = [one + block + b"\r\n\r\n", two + b"a:b\r\n\r\n"]
    named = tmp_path / "made.gz"
    with gzip.GzipFile(filename="with a name", mode="wb", fileobj=named.open("wb")) as f:  # a header with a name
        f.write(plain[0])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.warc.gz").write_bytes(named.read_bytes() + gzip.compress(plain[1]) + gzip.compress(plain[0]))
    (tmp_path / "in" / "y.warc").write_bytes(b"".join(plain))
    got = Counter((r.record_id, r.warc_type, r.target_uri, bytes(r.payload)) for r in warc.opened(spark, f"file://{tmp_path}/in").collect())
    assert got == {("<urn:uuid:1>", "response", "http://a/", block.partition(b"\r\n\r\n")[2]): 3, ("<urn:uuid:2>", "warcinfo", None, b"a:b"): 2}
    assert warc.opened(spark, f"file://{tmp_path}/in", False).filter("warc_type = 'warcinfo'").count() == 2


@pytest.mark.parametrize("payload", [True, False])
def test_damaged_warc(spark, tmp_path, payload):
    import gzip

    whole = warc.record(1, "response", "http://a/", "d", 3, None, b"abc" * 9000)
    plain = gzip.decompress(whole)
    for k, raw in enumerate([whole + whole[: len(whole) // 2], whole + gzip.compress(plain)[:-20], b"no member", whole + gzip.compress(b"WARC/1.1\r\nContent-Length: 9"), gzip.compress(b"HTML\r\n\r\n")]):
        (tmp_path / str(k)).mkdir()
        (tmp_path / str(k) / "x.warc.gz").write_bytes(raw)
        with pytest.raises(Exception, match="ValueError"):
            warc.opened(spark, f"file://{tmp_path}/{k}", payload).collect()


def test_warc_headers():
    import gzip

    text = gzip.decompress(warc.record(5, "revisit", "http://b/", "d", 3, 7, b"", "http://a/", "2024-01-02T03:04:05Z")).decode()
    lines = text.split("\r\n")
    assert {"WARC-Date: 2024-01-02T03:04:05Z", f"WARC-Profile: {warc.PROFILE}", "WARC-Refers-To-Target-URI: http://a/", "Content-Length: 0"} <= set(lines)
    ids = {next(x for x in gzip.decompress(warc.record(5, "response", None, "d", 0, None, b"")).split(b"\r\n") if x.startswith(b"WARC-Record-ID")) for _ in range(2)}
    assert len(ids) == 2


# 9: wavelet


def test_wavelet(spark):
    df, tokenizer = frame(spark), Tokenizer.from_file(BYTES)
    tokenizer.encode_special_tokens = True
    files = wavelet.shards(df, BYTES, size=500)
    assert files.count() > 1
    made = []
    for r in rows():
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        made.append(((r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()), r[0], ids))
    made.sort(key=lambda x: x[0])
    want, at = Counter(), 0
    for _, i, ids in made:
        want[i, at, len(ids), zlib.crc32(ids.tobytes())] += 1
        at += len(ids)
    assert bag(wavelet.documents(files), "doc_id", "start", "n_tokens", "ids_crc32") == want
    flat = np.concatenate([ids for _, _, ids in made])
    base = 0
    for f in files.orderBy("part", "number").collect()[:4]:
        m, mine = wavelet.opened(f.file), flat[base : base + f.n_tokens]
        assert (m.all() == mine).all() and [m.access(i) for i in range(0, m.n, 37)] == mine[::37].tolist()
        for t in {*mine[:9].tolist(), 2, 60000, 70000}:
            assert m.count(t) == (mine == t).sum() and m.locate(t) == np.flatnonzero(mine == t).tolist()
            assert m.count(t, 100, 300) == (mine[100:300] == t).sum() and m.select(t, m.n) == -1
        base += f.n_tokens
    assert wavelet.documents(wavelet.shards(df.limit(0), BYTES)).count() == 0


# 10: line dedup


def grams(line):
    return {line[k : k + 8] for k in range(len(line) - 7)} or {line}


def test_line_dedup(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefgé") for _ in range(r.randint(2, 8))) for _ in range(300)]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 40))) for _ in range(60)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(r.randint(0, 8)):
            words = r.choice(base).split(" ")
            if r.random() < 0.5:
                words[r.randrange(len(words))] = r.choice(vocabulary)
            lines.append(r.choice(["", "", " ", "."]) + " ".join(words) if r.random() < 0.9 else "")
        docs.append((i, "\n".join(lines)))
    docs += [(60, None), (61, ""), (62, "ab"), (63, "ab\nab\nabc"), (None, docs[5][1]), docs[9]]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    names = sorted({x for _, t in docs for x in (t or "").split("\n") if words_of(x)})
    parent = {n: n for n in names}
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            x, y = grams(a), grams(b)
            if len(x & y) >= 0.8 * len(x | y):
                parent[find(parent, a)] = find(parent, b)
    seen, kept = set(), {}
    for i, t in sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0)):
        lines = []
        for x in (t or "").split("\n"):
            if words_of(x) and find(parent, x) in seen:
                continue
            if words_of(x):
                seen.add(find(parent, x))
            lines.append(x)
        kept[i] = None if t is None else "\n".join(lines)
    got = line_dedup.deduplicated(df).collect()
    assert len(got) == len(docs)
    assert sum(x.text != kept[x.doc_id] for x in got) <= 2  # MinHash may miss a pair
    assert {x.doc_id: x.n_removed for x in got}[63] >= 1
    assert line_dedup.deduplicated(df.limit(0)).count() == 0


def test_line_dedup_of_the_small_table(spark):
    docs = frame(spark)
    out = line_dedup.deduplicated(docs)
    assert set(docs.columns) | {"n_lines", "n_removed"} == set(out.columns) and out.count() == len(rows())


# all


@pytest.mark.parametrize("name", list(queries()))
def test_query_runs(spark, name):
    df = queries()[name](spark, SF)
    assert df.count() == spark.read.parquet(f"{SF}/{'pages' if 'warc' in name else 'documents'}.parquet").count() or name.startswith("op2_")


def test_mix_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * (i % 37), "abcd"[i % 4]) for i in range(600)], "doc_id long, text string, source string")
    one, two = (
        sorted(map(tuple, mixing.mix(d, part=32).select("doc_id", "size", "target", "taken").collect()))
        for d in (docs.repartition(1), docs.repartition(7, "text"))
    )
    assert one == two


def test_mix_of_many_repeats(spark):
    docs = spark.createDataFrame([(None if i < 300 else i, "a b c" if i < 300 else "x " * (i % 9), "s") for i in range(500)], "doc_id long, text string, source string")
    found = mixing.mix(docs, part=16, weights=(1,)).toPandas()
    assert len(found) == 500 and set(found["copies"]) <= {1, 2}
    assert abs(found["taken"].sum() - 1.5 * found["size"].sum()) <= found["size"].max()


@pytest.mark.parametrize("chars", [1 << 16, 300])
def test_every_link_of_a_band_is_found(spark, chars):
    r = random.Random(5)
    lines = []
    for g in range(6):
        base = [r.choice("abcdefgh") * r.randint(1, 3) + str(g) for _ in range(24)]
        for _ in range(20):
            words = list(base)
            for _ in range(r.randint(0, 6)):
                words[r.randrange(24)] = r.choice("abcdefgh") + str(g)
            lines.append((" ".join(words), g))
    lines.append(("x", 0))
    rows = [(i, t, g) for i, (t, g) in enumerate(lines)]
    texts = spark.createDataFrame([(i, t) for i, t, _ in rows], "name long, text string")
    members = spark.createDataFrame([(b, i) for i, _, g in rows for b in (g, 10 + i % 3)], "band long, name long")
    # some lines are in components already
    root = {i: i - i % 3 for i, _, g in rows if i % 20 < 9}
    roots = spark.createDataFrame(list(root.items()), "node long, root long")
    got = line_dedup.remaining(members, roots, texts, 0.8, lines=7, chars=chars).collect()
    links = [(a, b) for a, x, g in rows for b, y, h in rows if a < b and (g == h or a % 3 == b % 3) and root.get(a, a) != root.get(b, b) and len(grams(x) & grams(y)) >= 0.8 * len(grams(x) | grams(y))]
    joined = lambda pairs: {n: find(p, n) for p in [_united(pairs, range(len(rows)), root)] for n in p}
    one, two = joined(links), joined([(x.a, x.b) for x in got])
    assert len(links) > 50 and {(one[a] == one[b]) == (two[a] == two[b]) for a in one for b in one} == {True}


def _united(pairs, nodes, root):
    parent = {n: n for n in nodes}
    for a, b in [*pairs, *root.items()]:
        parent[find(parent, a)] = find(parent, b)
    return parent


def test_line_dedup_of_the_query_compares_shingles_of_five(spark, tmp_path):
    r = random.Random(11)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    fine = lambda x: {x[k : k + 5] for k in range(len(x) - 4)}
    docs, pairs = [], 120
    for i in range(pairs):
        line = " ".join(word(7) for _ in range(8))  # 63 characters
        docs += [(i, line), (1000 + i, line[:30] + "#" + line[31:])]
    for a, b in zip(docs[::2], docs[1::2], strict=True):
        x, y = (fine(a[1]), fine(b[1]))
        assert len(x & y) >= 0.8 * len(x | y) and len(grams(a[1]) & grams(b[1])) < 0.8 * len(grams(a[1]) | grams(b[1]))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x.n_removed for x in queries()["op10_line_dedup"](spark, str(tmp_path)).collect()}
    assert all(got[i] == 0 for i in range(pairs)) and sum(got[1000 + i] == 0 for i in range(pairs)) <= 3  # MinHash may miss a pair


def test_line_dedup_with_shingles_of_five(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefgé") for _ in range(r.randint(2, 8))) for _ in range(300)]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 40))) for _ in range(60)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(r.randint(0, 8)):
            words = r.choice(base).split(" ")
            if r.random() < 0.5:
                words[r.randrange(len(words))] = r.choice(vocabulary)
            lines.append(" ".join(words))
        docs.append((i, "\n".join(lines)))
    names = sorted({x for _, t in docs for x in t.split("\n") if words_of(x)})
    sets = {x: {x[k : k + 5] for k in range(len(x) - 4)} or {x} for x in names}
    parent = {n: n for n in names}
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[find(parent, a)] = find(parent, b)
    seen, kept = set(), {}
    for i, t in docs:
        lines = []
        for x in t.split("\n"):
            if words_of(x) and find(parent, x) in seen:
                continue
            if words_of(x):
                seen.add(find(parent, x))
            lines.append(x)
        kept[i] = "\n".join(lines)
    got = line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), shingle=line_dedup.FINE).collect()
    assert sum(x.text != kept[x.doc_id] for x in got) <= 1  # MinHash may miss a pair


def test_quality_rejects_by_repeats_alone(spark):
    fresh = iter(range(10**6))
    words = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    twice = lambda n, k: (lambda x: x + words(n - 2 * k) + x)(words(k))
    loop = lambda n, period, k: words(n - k) + (words(period) * k)[:k]
    docs = [twice(267, 60), twice(1000, 150), twice(260, 31), loop(150, 6, 37), twice(260, 12), words(200)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    got = {x.doc_id: x for x in quality.judged(df).collect()}
    assert not any(x.base_failed for x in got.values())
    assert [got[i].kept for i in range(6)] == [False, False, False, False, True, True]
    assert got[0].covered_words == 120 and (got[3].n_words, got[3].covered_words, got[3].longest_repeat) == (150, 37, 31)


def test_quality_rejects_no_good_document_of_the_larger_table(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    good = quality.judged(docs).join(labels.filter("quality = 1"), "doc_id").filter("not base_failed").select("kept").collect()
    assert len(good) > 3000 and all(x.kept for x in good)
