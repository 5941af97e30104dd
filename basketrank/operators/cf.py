"""Collaborative filtering on long-form interactions: no index maps, no dense matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.common import CART, CLICK, PURCHASE, running
from ..plans.registry import REGISTRY
from ..sources.shared import kept, small_batches

_BUY, _ACT = (CART, PURCHASE), (CART, PURCHASE, CLICK)


def interaction_matrix(h: DataFrame, actions=_BUY, binary: bool = False) -> DataFrame:
    """user_id, product_id and cnt of the actions; null ids are left out."""
    some = h.filter(F.col("action_type").isin(*actions) & F.col("user_id").isNotNull() & F.col("product_id").isNotNull())
    out = some.groupBy("user_id", "product_id").agg(F.count("*").alias("cnt"))
    return out.withColumn("cnt", F.lit(1).cast("long")) if binary else out


#: A key (product, user) with more rows than this is popular: its pairs are counted in bit blocks instead of by a join.
POPULAR = 1000
#: Popular keys of a bit block, rows of a block on either side, blocks under one key of a join.
BITS, ROWS, STRIPE = 4096, 512, 8
#: A row of a join costs as much as so many pairs of users in a tile, or of their places in a dense product.
PAIRS = 256
#: Blocks on a side of the tiles, as far as each has ROWS users; most users and items of a block; users of a piece of a tile, ours and theirs.
SIDE, MOST, ITEMS, PIECE = 24, 1 << 15, 1 << 20, (128, 2048)
#: Longs that may hold all items as bits of a row.
WORDS = 16


def _blocks(df: DataFrame, by: list[str], name: Column, rows: int, values: Column) -> DataFrame:
    """``by``, block, stripe, rows: values in lists of about ``rows``, dealt by a hash of their name; blocks of a group are numbered from 0."""
    parts = F.ceil(F.count("*") / rows).cast("int").alias("parts")
    if by:
        dealt = df.join(df.groupBy(*by).agg(parts), by)
    else:
        dealt = df.withColumn("parts", F.lit(df.agg(parts).first()[0]))
    block = F.pmod(F.xxhash64(name), F.greatest("parts", F.lit(1))).cast("int")
    packed = dealt.withColumn("block", block).groupBy(*by, "block", "parts").agg(F.collect_list(values).alias("rows"))
    return packed.withColumn("stripe", F.floor(F.col("block") / STRIPE).cast("int"))


def _stripes() -> Column:
    return F.explode(F.sequence(F.lit(0), F.floor((F.col("parts") - 1) / STRIPE).cast("int"))).alias("stripe")


def overlaps(pairs: DataFrame, left: str, key: str, popular: int = POPULAR) -> DataFrame:
    """a, b, both: how many keys any two values of ``left`` share (a and b in both orders, and each with itself), none left out that share one.

    pairs: distinct rows. Keys with few rows meet in a join. Popular ones are bits: rows of ``left`` in blocks, whose bits are intersected and
    counted by numpy, so a key that all have makes no rows but those of the result. Blocks of bits keep a row small
    however many keys are popular.
    """
    pairs = kept(pairs.select(F.col(left).alias("a"), F.col(key).alias("k")), "overlaps")
    kind = pairs.schema["a"].dataType.simpleString()
    many = kept(pairs.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > popular).select("k"), "popular")
    few = pairs.join(many, "k", "left_anti")
    common = few.join(few.select(F.col("a").alias("b"), "k"), "k").groupBy("a", "b").agg(F.count("*").alias("both"))
    if many.isEmpty():
        return common
    number = numbered(many, "k", "number")
    bits = pairs.join(number, "k").select("a", F.floor(F.col("number") / BITS).cast("int").alias("part"), (F.col("number") % BITS).cast("int").alias("bit"))
    rows = kept(bits.groupBy("part", "a").agg(F.collect_list("bit").alias("bits")), "bits")
    packed = kept(_blocks(rows, ["part"], F.col("a"), ROWS, F.struct("a", "bits")), "blocks")
    ours = packed.select("part", F.col("rows").alias("ours"), _stripes())
    met = ours.join(packed.select("part", "stripe", F.col("rows").alias("theirs")), ["part", "stripe"])

    def of(rows) -> tuple[pa.Array, np.ndarray]:
        lists = rows.values.field("bits")
        out = np.zeros((len(lists), BITS), bool)
        out[np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = True
        return rows.values.field("a"), np.packbits(out, axis=1).view(np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("ours"), batch.column("theirs"), strict=True):
                (a, mine), (b, other) = of(x), of(y)
                for lo in range(0, len(a), 64):
                    both = np.bitwise_count(mine[lo : lo + 64, None, :] & other[None, :, :]).sum(axis=2, dtype=np.int64)
                    i, j = np.nonzero(both)
                    yield pa.RecordBatch.from_arrays([a.take(pa.array(i + lo)), b.take(pa.array(j)), pa.array(both[i, j])], ["a", "b", "both"])

    with small_batches(pairs.sparkSession):
        heavy = kept(met.select("ours", "theirs").mapInArrow(count, f"a {kind}, b {kind}, both long"), "heavy")
    return common.union(heavy).groupBy("a", "b").agg(F.sum("both").alias("both"))


def _parts(users: DataFrame, entries: Column) -> int:
    """How many blocks users are dealt to, of a bounded number of users and items each."""
    n = users.agg(F.count("*").alias("users"), F.coalesce(F.sum(entries), F.lit(0)).alias("items")).first()
    return max(1, min(SIDE, -(-n.users // ROWS)), -(-n.users // MOST), -(-n["items"] // ITEMS))


def _tiles(ours: DataFrame, n: int, theirs: DataFrame, m: int) -> DataFrame:
    """Rows of every two blocks (home, away), dealt to as many tasks."""
    every = lambda k, name: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(name)
    left, right = ours.select("*", every(m, "away")).repartition(n * m, "home", "away"), theirs.select("*", every(n, "home")).repartition(n * m, "home", "away")
    return left.join(right.hint("merge"), ["home", "away"])


def _block(name: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(parts)).cast("int")


def _packed(users: DataFrame, name: str, values: list[str], side: str, rows: str) -> tuple[DataFrame, int]:
    """side, rows: users (their items in a list) as one row a block; how many blocks."""
    parts = _parts(users, F.size("items"))
    return users.groupBy(_block(name, parts).alias(side)).agg(F.collect_list(F.struct(*values)).alias(rows)), parts


def _flat(rows: pa.Scalar, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lists in a block: their lengths, and the row and value of each element."""
    lists = rows.values.field(name)
    size = lists.value_lengths().to_numpy().astype(np.int64)
    return size, np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy()


def _places(rows: np.ndarray, values: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements whose value is among sorted columns: row and place of the value; which they are."""
    place = np.searchsorted(columns, values)
    there = np.flatnonzero(columns[np.minimum(place, len(columns) - 1)] == values) if len(columns) else np.zeros(0, np.int64)
    return rows[there], place[there], there


def _shared(ours: tuple, theirs: tuple) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """How many items users of two blocks share, in pieces: the first row on either side, counts of each with each, and their similarities.

    Pieces without any are left out; a piece holds until the next one is made.

    Items that many on both sides have are columns of 0/1 matrices that are multiplied; of others, those who have them are listed.
    """
    (n_u, u, mine), (n_v, v, other) = ours, theirs
    (own, a), (their, b) = np.unique(mine, return_counts=True), np.unique(other, return_counts=True)
    common, i, j = np.intersect1d(own, their, assume_unique=True, return_indices=True)
    often = a[i] * b[j] * PAIRS > len(n_u) * len(n_v)
    columns, rest = common[often], common[~often]
    (u_often, c_often, _), (v_often, d_often, _) = _places(u, mine, columns), _places(v, other, columns)
    (u_rest, c_rest, _), (v_rest, d_rest, _) = _places(u, mine, rest), _places(v, other, rest)
    high, wide = PIECE[0], max(min(PIECE), min(PIECE[1], (1 << 23) // max(1, len(columns))))

    def matrix(rows, at, lo, n) -> np.ndarray:
        here = slice(*np.searchsorted(rows, [lo, lo + n]))
        out = np.zeros((n, len(columns)), np.float32)
        out[rows[here] - lo, at[here]] = 1
        return out

    sizes, others, room = n_u.astype(float)[:, None], n_v.astype(float), (np.empty(high * wide, np.float32), np.empty(high * wide))
    for right in range(0, len(n_v), wide):
        w = min(wide, len(n_v) - right)
        theirs_often = matrix(v_often, d_often, right, w).T
        here = slice(*np.searchsorted(v_rest, [right, right + w]))
        order = np.argsort(d_rest[here], kind="stable")
        who = v_rest[here][order] - right
        first = np.concatenate([[0], np.cumsum(np.bincount(d_rest[here], minlength=len(rest)))])
        for left in range(0, len(n_u), high):
            h = min(high, len(n_u) - left)
            here = slice(*np.searchsorted(u_rest, [left, left + h]))
            at, row = c_rest[here], u_rest[here] - left
            n = first[at + 1] - first[at]
            if not len(columns) and not n.any():
                continue
            both, near = (x[: h * w].reshape(h, w) for x in room)
            if len(columns):
                np.matmul(matrix(u_often, c_often, left, h), theirs_often, out=both)
            else:
                both[:] = 0
            ends, lo = np.cumsum(n), 0
            while lo < len(n):
                # about a million meetings at once
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - n[lo] + (1 << 20), side="right")))
                some, start = n[lo:hi], ends[lo] - n[lo]
                met = who[np.repeat(first[at[lo:hi]] - (ends[lo:hi] - some - start), some) + np.arange(ends[hi - 1] - start)]
                both += np.bincount(np.repeat(row[lo:hi], some) * w + met, minlength=h * w).reshape(h, w)
                lo = hi
            np.add(sizes[left : left + h], others[right : right + w], out=near)
            near -= both
            yield left, right, both, np.divide(both, near, out=near)


def jaccard(matrix: DataFrame, popular: int = POPULAR, digits: int | None = None) -> DataFrame:
    """a, b, sim of users with a common item (itself included), rounded to so many digits if asked for.

    Where a join of the users of each item would make more rows than there are pairs of users by a factor of 1 / PAIRS, blocks of
    users with all their items meet in tiles, which make the rows of the result: no row of a pair is written or shuffled.
    """
    pairs = kept(matrix.select("user_id", "product_id"), "overlaps")
    users = pairs.agg(F.countDistinct("user_id")).first()[0]
    size = pairs.groupBy("product_id").agg(F.count("*").cast("double").alias("n"))
    items, joined = size.agg(F.count("*"), F.coalesce(F.sum(F.col("n") * F.col("n")), F.lit(0.0))).first()
    if users * users <= joined * PAIRS:
        numbers = pairs.join(numbered(pairs, "product_id", "number"), "product_id").select("user_id", F.col("number").cast("int").alias("number"))
        return _jaccard_bits(numbers, -(-items // 64), digits) if items <= 64 * WORDS else _jaccard_lists(numbers, digits)
    size = pairs.groupBy("user_id").agg(F.count("*").alias("n"))
    common = overlaps(pairs, "user_id", "product_id", popular)
    sim = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    return common.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b").select("a", "b", (sim if digits is None else F.round(sim, digits)).alias("sim"))


def _jaccard_bits(numbers: DataFrame, words: int, digits: int | None) -> DataFrame:
    """Users of few items: a row of either block has all of a user's items as bits of some longs."""
    bit = F.expr("shiftleft(1L, number % 64)")
    bits = [F.bit_or(F.when(F.floor(F.col("number") / 64) == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{i}") for i in range(words)]
    users = kept(numbers.groupBy("user_id").agg(F.count("*").alias("n"), *bits), "users")
    parts = _parts(users, F.lit(words))
    side = lambda u, x: users.select(F.col("user_id").alias(u), F.col("n").alias(f"n{u}"), *[F.col(f"w{i}").alias(f"{u}{i}") for i in range(words)], _block("user_id", parts).alias(x))
    both = sum((F.bit_count(F.col(f"a{i}").bitwiseAND(F.col(f"b{i}"))) for i in range(1, words)), F.bit_count(F.col("a0").bitwiseAND(F.col("b0"))))
    sim = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    if digits is not None:
        sim = F.floor(sim * 10.0**digits + 0.5) / 10.0**digits
    return _tiles(side("a", "home"), parts, side("b", "away"), parts).select("a", "b", "na", "nb", both.alias("both")).filter("both > 0").select("a", "b", sim.alias("sim"))


def _jaccard_lists(numbers: DataFrame, digits: int | None) -> DataFrame:
    """Users of any number of items: a row is a block of users with lists of their items."""
    kind = numbers.schema["user_id"].dataType
    users = kept(numbers.groupBy("user_id").agg(F.collect_list("number").alias("items")), "users")
    ours, parts = _packed(users, "user_id", ["user_id", "items"], "home", "ours")
    ours = kept(ours, "blocks")
    schema = to_arrow_schema(StructType([StructField(c, k) for c, k in (("a", kind), ("b", kind), ("sim", DoubleType()))]))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("ours"), batch.column("theirs"), strict=True):
                a, b = (z.values.field("user_id").to_numpy(zero_copy_only=False) for z in (x, y))
                ours, theirs = _flat(x, "items"), _flat(y, "items")
                for left, right, both, near in _shared(ours, theirs):
                    if digits is not None:
                        near *= 10.0**digits
                        near += 0.5
                        np.floor(near, out=near)
                        near /= 10.0**digits
                    some, others = a[left : left + len(both)], b[right : right + both.shape[1]]
                    if 2 * np.count_nonzero(both) > both.size:
                        good = both.ravel() > 0
                        columns = np.repeat(some, len(others))[good], np.tile(others, len(some))[good], near.ravel()[good]
                    else:
                        i, j = np.nonzero(both)
                        columns = some[i], others[j], near[i, j]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)

    met = _tiles(ours, parts, ours.select(F.col("home").alias("away"), F.col("ours").alias("theirs")), parts)
    return met.select("ours", "theirs").mapInArrow(similar, f"a {kind.simpleString()}, b {kind.simpleString()}, sim double")


def item_blocks(matrix: DataFrame, size: int = 1024) -> DataFrame:
    """user_id, block and items: the distinct products of each user in blocks of about so many."""
    most = matrix.groupBy("user_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    block = F.pmod(F.xxhash64("product_id"), F.lit(-(-most // size) or 1))
    return matrix.groupBy("user_id", block.alias("block")).agg(F.collect_list("product_id").alias("items"))


def jaccard_of(pairs: DataFrame, matrix: DataFrame) -> DataFrame:
    """a, b, sim of given distinct pairs of users, from their items in blocks of a bounded size; pairs without a common item are left out."""
    size = matrix.groupBy("user_id").agg(F.count("*").alias("n"))
    blocks = kept(item_blocks(matrix), "blocks")
    met = pairs.join(blocks.toDF("a", "block", "ours"), "a").join(blocks.toDF("b", "block", "theirs"), ["b", "block"])
    common = met.groupBy("a", "b").agg(F.sum(F.size(F.array_intersect("ours", "theirs"))).alias("both")).filter("both > 0")
    return common.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b").select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("sim"))


def _known(t: DataFrame, matrix: DataFrame, scores: DataFrame, column: str) -> DataFrame:
    """Scores of target pairs: 0 for known ids without a score, null if the user or the product is unknown."""
    users = matrix.select("user_id").distinct().withColumn("u_known", F.lit(True))
    items = matrix.select("product_id").distinct().withColumn("p_known", F.lit(True))
    out = t.join(scores, ["user_id", "product_id"], "left").join(users, "user_id", "left").join(items, "product_id", "left")
    value = F.when(F.col("u_known") & F.col("p_known"), F.coalesce(column, F.lit(0.0)))
    return out.withColumn(column, value).drop("u_known", "p_known")


def popular_scores(matrix: DataFrame, wanted: DataFrame) -> DataFrame:
    """user_id, product_id, cf_score of wanted pairs, summed by blocks of users against blocks of all users.

    Users with the same products are one basket, whose counts are sums. A row of the join is a block of wanted baskets and one of
    others, each with its products. Numpy counts what they share, which gives all similarities of the two blocks, and adds these up by
    product times counts. No pair of users and no list of a product's buyers is ever a row.
    """
    number = numbered(matrix, "product_id", "number")
    entries = F.sort_array(F.collect_list(F.struct(F.col("number").cast("int").alias("item"), "cnt"))).alias("entries")
    users = matrix.join(number, "product_id").groupBy("user_id").agg(entries)
    users = kept(users.withColumn("name", F.unhex(F.sha2(F.array_join(F.col("entries.item").cast("array<string>"), ","), 256))), "users")
    sums = users.select("name", F.inline("entries")).groupBy("name", "item").agg(F.sum(F.col("cnt").cast("double")).alias("cnt"))
    baskets = sums.groupBy("name").agg(F.collect_list("item").alias("items"), F.collect_list("cnt").alias("counts"))
    # written with their numbers, which stay
    baskets = kept(baskets.withColumn("basket", F.monotonically_increasing_id()), "baskets")
    names = users.select("user_id", "name").join(baskets.select("name", "basket"), "name").select("user_id", "basket")
    open_pairs = kept(wanted.join(number, "product_id").join(names, "user_id").select("user_id", "product_id", "basket", F.col("number").cast("int").alias("item")), "open")
    asks = baskets.select("basket", "items").join(open_pairs.groupBy("basket").agg(F.collect_set("item").alias("wanted")), "basket")
    ours, n = _packed(asks, "basket", ["basket", "items", "wanted"], "home", "ours")
    theirs, m = _packed(baskets, "basket", ["items", "counts"], "away", "theirs")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("ours"), batch.column("theirs"), strict=True):
                mine, other, (_, who, asked) = _flat(x, "items"), _flat(y, "items"), _flat(x, "wanted")
                total = _weighted(mine, other, y.values.field("counts").flatten().to_numpy(), who, asked)
                good = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([x.values.field("basket").take(pa.array(who[good])), pa.array(asked[good]), pa.array(total[good])], ["basket", "item", "score"])

    with small_batches(matrix.sparkSession):
        parts = kept(_tiles(ours, n, theirs, m).select("ours", "theirs").mapInArrow(score, "basket long, item int, score double"), "parts")
    return open_pairs.join(parts.groupBy("basket", "item").agg(F.sum("score").alias("cf_score")), ["basket", "item"]).select("user_id", "product_id", "cf_score")


def _weighted(ours: tuple, theirs: tuple, counts: np.ndarray, who: np.ndarray, asked: np.ndarray, step: int = 256) -> np.ndarray:
    """For each asked item of a row of ours: similarities to the rows of theirs times their counts of it, summed."""
    products, column = np.unique(asked, return_inverse=True)
    v, at, there = _places(theirs[1], theirs[2], products)
    counts, total, known = counts[there], np.zeros(len(asked)), {}

    def amount(lo: int, n: int, some: np.ndarray) -> np.ndarray:
        here = slice(*np.searchsorted(v, [lo, lo + n]))
        row, place, which = _places(v[here], at[here], some)
        out = np.zeros((n, len(some)))
        out[row - lo, place] = counts[here][which]
        return out

    for left, right, _, near in _shared(ours, theirs):
        h, w = near.shape
        here = slice(*np.searchsorted(who, [left, left + h]))
        few = len(products) <= step
        names = np.arange(len(products)) if few else np.unique(column[here])
        for lo in range(0, len(names), step):
            some = names[lo : lo + step]
            if few and known.get("right") != right:
                known = {"right": right, "amount": amount(right, w, some)}
            row, place, which = _places(who[here] - left, column[here], some)
            total[here.start + which] += (near @ (known["amount"] if few else amount(right, w, some)))[row, place]
    return total


@REGISTRY.feature("memory-based-cf", ["cf_score"], reads=["user_id", "product_id", "action_type"], passes=2)
def memory_cf(h: DataFrame, t: DataFrame, config: dict) -> DataFrame:
    """Sum over users of Jaccard similarity times their count of the product.

    Products with few buyers: those buyers of each wanted pair, and similarities of the pairs of users that meet. Popular ones
    (config popular; if it is not given, all of them where the join would make more rows than there are pairs of users by a factor of
    1 / PAIRS): blocks of users.
    """
    popular = config.get("popular")
    m = kept(interaction_matrix(h), "matrix")
    wanted = kept(t.select("user_id", "product_id").distinct(), "wanted")
    size = m.groupBy("product_id").agg(F.count("*").alias("n"))
    if popular is None:
        joined = wanted.join(size, "product_id").agg(F.countDistinct("user_id").alias("users"), F.coalesce(F.sum(F.col("n").cast("double")), F.lit(0.0)).alias("rows")).first()
        if joined.users * m.agg(F.countDistinct("user_id")).first()[0] <= joined["rows"] * PAIRS:
            return _known(t, m, popular_scores(m, wanted), "cf_score")
        popular = POPULAR
    many = kept(size.filter(F.col("n") > popular).select("product_id"), "popular")
    counts = kept(wanted.join(many, "product_id", "left_anti").withColumnRenamed("user_id", "a").join(m.withColumnRenamed("user_id", "b"), "product_id"), "counts")
    near = jaccard_of(counts.select("a", "b").distinct(), m)
    scores = counts.join(near, ["a", "b"]).groupBy(F.col("a").alias("user_id"), "product_id").agg(F.sum(F.col("sim") * F.col("cnt")).alias("cf_score"))
    if not many.isEmpty():
        scores = scores.union(popular_scores(m, wanted.join(many, "product_id", "left_semi")))
    return _known(t, m, scores, "cf_score")


def npmi(matrix: DataFrame, popular: int = POPULAR) -> DataFrame:
    """a, b, npmi of different products with common users; 0 where all users have both. Users of very many products are bits of blocks."""
    pairs = matrix.select("user_id", "product_id")
    users = pairs.agg(F.countDistinct("user_id")).first()[0]
    size = pairs.groupBy("product_id").agg(F.count("*").alias("n"))
    both = overlaps(pairs, "product_id", "user_id", popular).filter("a <> b")
    return both.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b").select("a", "b", _npmi(F.lit(users)).alias("npmi"))


def _npmi(users: Column) -> Column:
    p = F.col("both") / users
    value = F.try_divide(F.ln(p / (F.col("na") / users * F.col("nb") / users)), -F.ln(p))
    return F.when(F.col("both") == users, 0.0).otherwise(value)


def npmi_of(pairs: DataFrame, matrix: DataFrame) -> DataFrame:
    """a, b, npmi of given distinct pairs of different products with common users.

    Of each pair the buyers of the rarer product are looked up among those of the other, so a product that all
    have bought costs no more than its rare partners have buyers.
    """
    users = matrix.agg(F.countDistinct("user_id")).first()[0]
    own = matrix.select("user_id", "product_id")
    size = own.groupBy("product_id").agg(F.count("*").alias("n"))
    sized = pairs.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
    first = F.col("na") <= F.col("nb")
    sized = sized.select("a", "b", "na", "nb", F.when(first, F.col("a")).otherwise(F.col("b")).alias("rare"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("other"))
    met = sized.join(own.toDF("user", "rare"), "rare").join(own.toDF("user", "other"), ["user", "other"], "left_semi")
    return met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("both")).select("a", "b", _npmi(F.lit(users)).alias("npmi"))


@REGISTRY.feature("npmi-cf", ["npmi_cf_score"], reads=["user_id", "product_id", "action_type"], passes=2)
def npmi_cf(h: DataFrame, t: DataFrame, config: dict) -> DataFrame:
    """Sum of NPMI from a product to the user's products; 0 for those bought already."""
    m, wanted = kept(interaction_matrix(h), "matrix"), kept(t.select("user_id", "product_id").distinct(), "wanted")
    open_pairs = wanted.join(m, ["user_id", "product_id"], "left_anti")
    met = open_pairs.withColumnRenamed("product_id", "open").join(m.select("user_id", F.col("product_id").alias("owned")), "user_id")
    met = met.select("user_id", "open", F.least("open", "owned").alias("a"), F.greatest("open", "owned").alias("b"))
    scores = met.join(npmi_of(met.select("a", "b").distinct(), m), ["a", "b"])
    return _known(t, m, scores.groupBy("user_id", F.col("open").alias("product_id")).agg(F.sum("npmi").alias("npmi_cf_score")), "npmi_cf_score")


def idf(matrix: DataFrame) -> DataFrame:
    """product_id, idf = ln(users / (buyers + 1))."""
    users = matrix.agg(F.countDistinct("user_id")).first()[0]
    return matrix.groupBy("product_id").agg(F.count("*").alias("n")).select("product_id", F.ln(F.lit(users) / (F.col("n") + 1)).alias("idf"))


def svd_scores(weights: DataFrame, wanted: DataFrame, rank: int = 50, passes: int = 4, seed: int = 42) -> DataFrame:
    """Rank-k reconstruction of (user_id, product_id, w) at wanted pairs.

    Randomised subspace iteration: only the item basis (items x k) is orthonormalised, by a Gram matrix of
    k x k that is summed on Spark and comes to the driver once; the products with the matrix are joins and sums on Spark. A score is
    x V V^T, x the user's row.
    """
    bounds = weights.agg(F.countDistinct("user_id").alias("u"), F.countDistinct("product_id").alias("p")).first()
    k = max(1, min(rank, min(bounds.u, bounds.p) - 1))
    weights = kept(weights.select("user_id", "product_id", "w"), "svd-weights")
    wide = min(k + 8, bounds.p)
    basis = weights.select("product_id").distinct().select("product_id", F.transform(F.sequence(F.lit(1), F.lit(wide)), lambda i: (F.xxhash64(F.lit(seed), "product_id", i) % 2001) / 1000.0).alias("v"))

    def orthonormal(items: DataFrame, keep: int) -> DataFrame:
        i, j = np.triu_indices(wide)

        def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((wide, wide))
            for b in batches:
                v = np.array(b["v"].tolist()).reshape(-1, wide)
                total += v.T @ v
            yield pd.DataFrame({"i": i, "j": j, "s": total[i, j]})

        sums = items.select("v").mapInPandas(gram, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
        whole = np.zeros((wide, wide))
        for r in sums:
            whole[r.i, r.j] = whole[r.j, r.i] = r.s
        values, vectors = np.linalg.eigh(whole)
        order = np.argsort(-values)[:keep]
        good = values[order] > max(values.max(), 1e-300) * 1e-12
        change = vectors[:, order[good]] / np.sqrt(values[order[good]])
        rotate = [F.array(*[F.lit(float(x)) for x in c]) for c in change.T]
        dot = lambda c: F.aggregate(F.zip_with("v", c, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return items.select("product_id", F.array(*[dot(c) for c in rotate], *[F.lit(0.0)] * (wide - len(rotate))).alias("v"))

    def summed(df: DataFrame, key: str) -> DataFrame:
        return df.groupBy(key).agg(F.array(*[F.sum(F.col("w") * F.col("v")[i]) for i in range(wide)]).alias("v"))

    for n in range(passes + 1):
        rows = summed(weights.join(basis, "product_id"), "user_id")
        items = kept(summed(weights.join(rows, "user_id"), "product_id"), "svd-items")
        basis = kept(orthonormal(items, k if n == passes else wide), "svd-basis")
    users = summed(weights.join(basis, "product_id").join(wanted.select("user_id").distinct(), "user_id", "left_semi"), "user_id")
    dot = F.aggregate(F.zip_with("x", "v", lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y)
    return wanted.join(users.withColumnRenamed("v", "x"), "user_id").join(basis, "product_id").select("user_id", "product_id", dot.alias("score"))


@REGISTRY.feature("svd-cf", ["svd_cf_score"], reads=["user_id", "product_id", "action_type"], passes=2)
def svd_cf(h: DataFrame, t: DataFrame, config: dict) -> DataFrame:
    m, wanted = kept(interaction_matrix(h), "matrix"), t.select("user_id", "product_id").distinct()
    scores = svd_scores(m.withColumn("w", F.col("cnt").cast("double")), wanted, config.get("svd_rank", 50))
    return _known(t, m, scores.withColumnRenamed("score", "svd_cf_score"), "svd_cf_score")


@REGISTRY.feature("puresvd-cf", ["puresvd_cf_score"], reads=["user_id", "product_id", "action_type"], passes=2)
def puresvd_cf(h: DataFrame, t: DataFrame, config: dict) -> DataFrame:
    m, wanted = kept(interaction_matrix(h, _ACT, binary=True), "matrix"), t.select("user_id", "product_id").distinct()
    weights = m.join(idf(m), "product_id").select("user_id", "product_id", F.col("idf").alias("w"))
    if config.get("normalize_users"):
        norm = weights.groupBy("user_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        weights = weights.join(norm, "user_id").select("user_id", "product_id", F.coalesce(F.try_divide("w", "norm"), F.lit(0.0)).alias("w"))
    return _known(t, m, svd_scores(weights, wanted, config.get("svd_rank", 50)).withColumnRenamed("score", "puresvd_cf_score"), "puresvd_cf_score")


def numbered(ids: DataFrame, key: str, number: str) -> DataFrame:
    """Distinct keys with numbers from 0 without gaps, in their order: their places among range partitions."""
    return running(ids.select(key).distinct(), [key], F.lit(1), number)


def _descend(rows: pd.DataFrame, seed: list[int], passes: int, rate: float, decay: float) -> pd.DataFrame:
    """Stochastic gradient steps of the pairwise ranking loss over one cell of users, items and what they did."""
    users, items, seen = (rows[rows["kind"] == k] for k in (0, 1, 2))
    users, items = users.sort_values("user_id", kind="stable"), items.sort_values("product_id", kind="stable")
    out = pd.concat([users, items])
    if not len(seen) or len(items) < 2:
        return out
    u, v = np.array(users["v"].tolist()), np.array(items["v"].tolist())
    of_user, of_item = ({x: i for i, x in enumerate(f[c])} for f, c in ((users, "user_id"), (items, "product_id")))
    known = np.unique(seen["user_id"].map(of_user).to_numpy(np.int64) * len(items) + seen["product_id"].map(of_item).to_numpy(np.int64))
    dice = np.random.default_rng(seed)
    for _ in range(passes):
        order = dice.permutation(known)
        for lo in range(0, len(order), 256):
            who, liked = np.divmod(order[lo : lo + 256], len(items))
            other = dice.integers(0, len(items), len(who))
            code = who * len(items) + other
            fresh = known[np.minimum(np.searchsorted(known, code), len(known) - 1)] != code
            who, liked, other = who[fresh], liked[fresh], other[fresh]
            # the last place of an item is its bias, which meets a one
            mine = u[who]
            apart = v[liked] - v[other]
            pull = 1 / (1 + np.exp(np.clip((mine * apart[:, :-1]).sum(axis=1) + apart[:, -1], -50, 50)))[:, None]
            wide = np.concatenate([mine, np.ones((len(who), 1))], axis=1)
            np.add.at(u, who, rate * (pull * apart[:, :-1] - decay * mine))
            np.add.at(v, liked, rate * (pull * wide - decay * v[liked]))
            np.add.at(v, other, rate * (-pull * wide - decay * v[other]))
    out["v"] = [*u.tolist(), *v.tolist()]
    return out


def _visit(seed: int, step: int, passes: int, rate: float, decay: float) -> Callable:
    def visit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _descend(rows, [seed, step, int(key[0])], passes, rate, decay)

    return visit


def bpr_factors(matrix: DataFrame, size: int = 100, rounds: int = 5, passes: int = 20, rate: float = 0.05, decay: float = 0.01, seed: int = 42, cell: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """user_id, v and product_id, v (the last place a bias) by Bayesian personalised ranking: what a user has done ranks above what not.

    Users are dealt to blocks of about ``cell``, and of ten times as many things done at most, so a block meets no more products than
    that, and a user's factors are written by one task only. A round is one job: all blocks take steps with the products that their users know (others of them
    are the negative samples), and a product's factors become the mean of what the blocks made of them, by how often
    it stands in each.
    """
    n = matrix.agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("u")).first()
    blocks = max(1, -(-n.u // cell), -(-n.n // (10 * cell)))
    start = lambda c, k: F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: (F.pmod(F.xxhash64(F.lit(seed), c, i), F.lit(2001)) - 1000) / (1000.0 * size))
    kinds = {f.name: f.dataType.simpleString() for f in matrix.schema}
    schema = f"cell int, kind int, user_id {kinds['user_id']}, product_id {kinds['product_id']}, v array<double>"
    block = F.pmod(F.xxhash64(F.lit(seed), "user_id"), F.lit(blocks)).cast("int")
    seen = kept(matrix.select(block.alias("cell"), "user_id", "product_id"), "bpr-seen")
    often = kept(seen.groupBy("cell", "product_id").agg(F.count("*").alias("n")), "bpr-places")
    users = seen.select("cell", "user_id").distinct().withColumn("v", start("user_id", size))
    items = seen.select("product_id").distinct().withColumn("v", F.concat(start("product_id", size), F.array(F.lit(0.0))))
    none = lambda c: F.lit(None).cast(kinds.get(c, "array<double>")).alias(c)
    for step in range(rounds):
        rows = users.select("cell", F.lit(0).alias("kind"), "user_id", none("product_id"), "v")
        rows = rows.union(often.join(items, "product_id").select("cell", F.lit(1), none("user_id"), "product_id", "v"))
        rows = rows.union(seen.select("cell", F.lit(2), "user_id", "product_id", none("v")))

        moved = kept(rows.groupBy("cell").applyInPandas(_visit(seed, step, passes, rate, decay), schema), "bpr-factors")
        users = moved.filter("kind = 0").select("cell", "user_id", "v")
        if blocks == 1:
            items = moved.filter("kind = 1").select("product_id", "v")
        else:
            made = moved.filter("kind = 1").select("cell", "product_id", "v").join(often, ["cell", "product_id"])
            items = made.groupBy("product_id").agg(F.array(*[F.sum(F.col("n") * F.get("v", F.lit(i))) / F.sum("n") for i in range(size + 1)]).alias("v"))
    return users.select("user_id", "v"), items


@REGISTRY.feature("bpr-popular", ["bpr_popular_score"], reads=["user_id", "product_id", "action_type"], passes=2)
def bpr(h: DataFrame, t: DataFrame, config: dict) -> DataFrame:
    """Score of a user and a product by factors of pairwise ranking; null for users or products without any."""
    users, items = bpr_factors(kept(interaction_matrix(h, _ACT, binary=True), "matrix"), config.get("factors", 100), config.get("rounds", 5), config.get("passes", 20))
    wanted = t.select("user_id", "product_id").distinct()
    size = F.size("x")
    dot = F.aggregate(F.zip_with("x", F.slice("y", F.lit(1), size), lambda a, b: a * b), F.lit(0.0), lambda s, z: s + z) + F.element_at("y", -1)
    scored = wanted.join(users.withColumnRenamed("v", "x"), "user_id").join(items.withColumnRenamed("v", "y"), "product_id")
    return t.join(scored.select("user_id", "product_id", dot.alias("bpr_popular_score")), ["user_id", "product_id"], "left")
