"""Counts, recency, statistics, times, frequency, sessions, trends, crosses and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import CART, CLICK, DAY, PURCHASE, VIEW, attach, distinct, is_buy, is_cart, is_click, is_view, micros, number, with_bounds
from ..plans.registry import REGISTRY

WINDOWS = {"7d": 7, "30d": 30, "90d": 90, "180d": 180, "365d": 365}
PAIRS = {
    "u_p": ["user_id", "product_id"], "u_c": ["user_id", "product_category"], "u_c_source": ["user_id", "product_category", "source_type"],
    "u_s": ["user_id", "store_id"], "u_p_source": ["user_id", "product_id", "source_type"],
}
_KEYS = [*dict.fromkeys(c for keys in PAIRS.values() for c in keys), "action_type"]
KINDS = ["views", "clicks", "purchases", "interactions", "ctr", "purchases_view_ratio"]


@REGISTRY.feature("random_noise", ["random_noise"], reads=(), passes=0)
def random_noise(h: DataFrame, t: DataFrame, config: dict) -> DataFrame:
    return t.withColumn("random_noise", F.rand(config.get("seed", 42)))


@REGISTRY.feature("source_type", categorical=["source_type"], reads=["source_type"], passes=0)
def source_type(h: DataFrame, t: DataFrame, config: dict) -> DataFrame:
    return t


def time_window_stats(h: DataFrame, pair: str) -> DataFrame:
    """One row for each key of a pair: all windows from one aggregation, a window without rows being null."""
    keys = PAIRS[pair]
    h = with_bounds(h.select(*keys, "action_type", "ts")).withColumn("age", F.col("t_max") - micros())
    flags = {"views": is_view(), "clicks": is_click(), "purchases": is_buy(), "interactions": F.lit(True)}
    aggs = [number(c & (F.col("age") < d * DAY)).alias(f"{k}_{pair}_{w}") for w, d in WINDOWS.items() for k, c in flags.items()]
    out = h.filter(F.col("age") < max(WINDOWS.values()) * DAY).groupBy(*keys).agg(*aggs)
    columns = []
    for w in WINDOWS:
        there = F.col(f"interactions_{pair}_{w}") > 0
        of = lambda k, w=w: F.col(f"{k}_{pair}_{w}")
        values = {k: of(k) for k in flags} | {"ctr": of("clicks") / (of("views") + 1), "purchases_view_ratio": of("purchases") / (of("views") + 1)}
        columns += [F.when(there, values[k]).alias(f"{k}_{pair}_{w}") for k in KINDS]
    return out.select(*keys, *columns)


@REGISTRY.feature("time_windows", [f"{k}_{p}_{w}" for p in PAIRS for w in WINDOWS for k in KINDS], reads=_KEYS, passes=2 * len(PAIRS))
def time_windows(h: DataFrame, t: DataFrame, config: dict) -> DataFrame:
    for pair, keys in PAIRS.items():
        t = attach(t, time_window_stats(h, pair), keys)
    return t


def _count(name: str, keys: list[str]):
    column = f"count_purchase_{name}"

    def make(h: DataFrame, t: DataFrame, config: dict) -> DataFrame:
        out = attach(t, h.filter(is_cart()).groupBy(*keys).agg(F.count("*").alias(column)), keys)
        if config.get("fill_scope") == "frame":
            return out.fillna(0)
        return out.withColumn(column, F.coalesce(column, F.lit(0)))

    return column, make


def _recency(name: str, keys: list[str]):
    column = f"days_since_interaction_{name}"

    def make(h: DataFrame, t: DataFrame, config: dict) -> DataFrame:
        last = with_bounds(h.select(*keys, "ts")).groupBy(*keys).agg(F.expr(f"(max(t_max) - max({_MICROS})) div {DAY}").alias(column))
        return attach(t, last, keys)

    return column, make


_MICROS = "unix_micros(to_utc_timestamp(ts, 'UTC'))"
for _long, _name in (("user_product", "u_p"), ("user_category", "u_c"), ("user_store", "u_s")):
    _column, _make = _count(_name, PAIRS[_name])
    REGISTRY.feature(f"count_purchase_{_long}", [_column], reads=[*PAIRS[_name], "action_type"])(_make)
    _column, _make = _recency(_name, PAIRS[_name])
    REGISTRY.feature(f"recency_{_long}", [_column], reads=PAIRS[_name], passes=2)(_make)


def entity_stats(h: DataFrame, key: str, prefix: str, other: str, bought) -> DataFrame:
    return h.groupBy(key).agg(
        F.count("*").alias(f"{prefix}_total_interactions"), number(bought).alias(f"{prefix}_total_purchases"), number(is_view()).alias(f"{prefix}_total_views"),
        distinct(other[1]).alias(f"{prefix}_unique_{other[0]}"),
    )


STATS = {
    "user": ("user_id", ("products", "product_id"), is_cart), "product": ("product_id", ("users", "user_id"), is_buy),
    "store": ("store_id", ("products", "product_id"), is_cart), "city": ("city_name", ("stores", "store_id"), is_cart),
}


def _stats(prefix: str):
    key, other, bought = STATS[prefix]

    def make(h: DataFrame, t: DataFrame, config: dict) -> DataFrame:
        found = entity_stats(h, key, prefix, other, bought())
        if prefix == "city" and config.get("city_ratios"):
            found = found.withColumn("city_purchase_view_ratio", F.try_divide("city_total_purchases", "city_total_views")).withColumn("city_purchase_interaction_ratio", F.try_divide("city_total_purchases", "city_total_interactions"))
        return attach(t, found, [key])

    return [f"{prefix}_total_{k}" for k in ("interactions", "purchases", "views")] + [f"{prefix}_unique_{other[0]}"], make


for _prefix in STATS:
    _columns, _make = _stats(_prefix)
    REGISTRY.feature(f"{_prefix}_stats", _columns, ["city_name"] if _prefix == "city" else [], reads=[STATS[_prefix][0], STATS[_prefix][1][1], "action_type"])(_make)


@REGISTRY.feature("time_features_cycl_v2", [f"{k}_{f}_v2" for k in ("hour_of_day", "day_of_week", "month") for f in ("sin", "cos")], ["is_weekend_v2"], reads=(), passes=0)
def time_cycle(h: DataFrame, t: DataFrame, config: dict) -> DataFrame:
    parts = {"hour_of_day": (F.hour("ts"), 24), "day_of_week": (F.weekday("ts") + 1, 7), "month": (F.month("ts"), 12)}
    for name, (value, period) in parts.items():
        for f in ("sin", "cos"):
            t = t.withColumn(f"{name}_{f}_v2", getattr(F, f)(value * F.lit(2 * 3.141592653589793) / period))
    return t.withColumn("is_weekend_v2", F.weekday("ts") >= 5)


#: Public holidays of Russia by month and day (fixed values).
HOLIDAYS = [(1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (1, 7), (1, 8), (2, 23), (3, 8), (5, 1), (5, 9), (6, 12), (11, 4)]


#: Days off that holidays on weekends were moved to, by year: by decree, and to the next working day (fixed values).
TRANSFERS = {
    2020: [(2, 24), (3, 9), (5, 4), (5, 5), (5, 11)],
    2021: [(2, 22), (5, 3), (5, 10), (6, 14), (11, 5), (12, 31)],
    2022: [(3, 7), (5, 2), (5, 3), (5, 10), (6, 13)],
    2023: [(2, 24), (5, 8), (11, 6)],
    2024: [(4, 29), (4, 30), (5, 10), (12, 30), (12, 31)],
    2025: [(5, 2), (5, 8), (6, 13), (11, 3), (12, 31)],
}


@REGISTRY.feature("russian_holiday", categorical=["is_russian_holiday"], reads=(), passes=0)
def russian_holiday(h: DataFrame, t: DataFrame, config: dict) -> DataFrame:
    """Days of the year (holidays), and single dates: those given as text (holiday_dates), and with holiday_transfers those of TRANSFERS."""
    days = [m * 100 + d for m, d in config.get("holidays", HOLIDAYS)]
    fixed = (F.month("ts") * 100 + F.dayofmonth("ts")).isin(days)
    moved = list(config.get("holiday_dates", ()))
    if config.get("holiday_transfers"):
        moved += [f"{y}-{m:02d}-{d:02d}" for y, some in TRANSFERS.items() for m, d in some]
    if moved:
        fixed = fixed | F.date_format("ts", "yyyy-MM-dd").isin(moved)
    return t.withColumn("is_russian_holiday", F.coalesce(fixed, F.lit(False)).cast("tinyint"))


def temporal_patterns(h: DataFrame, key: str, prefix: str) -> DataFrame:
    """Mean and deviation of purchase hours and the commonest weekday (the earliest of equals), from rows by weekday and hour."""
    cells = h.groupBy(key, "day", "hour").agg(F.count("*").alias("n"))
    by = cells.groupBy(key, "day").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("hour")).alias("sum"), F.sum(F.col("n") * F.col("hour") * F.col("hour")).alias("squares"))
    n = F.sum("n")
    spread = F.when(n > 1, F.sqrt(F.greatest((n * F.sum("squares") - F.sum("sum") * F.sum("sum")) / (n * (n - 1)), F.lit(0.0))))
    mean = F.sum("sum") / n
    return by.groupBy(key).agg(mean.alias(f"{prefix}avg_purchase_hour"), spread.alias(f"{prefix}std_purchase_hour"), F.max_by("day", F.struct("n", -F.col("day"))).alias(f"{prefix}most_common_purchase_day"))


def _temporal(key: str, prefix: str, bought):
    def make(h: DataFrame, t: DataFrame, config: dict) -> DataFrame:
        some = h.filter(bought()).select(key, F.hour("ts").alias("hour"), (F.weekday("ts") + 1).alias("day"))
        t = attach(t, temporal_patterns(some, key, prefix), [key])
        hour = F.abs(F.hour("ts") - F.col(f"{prefix}avg_purchase_hour"))
        day = F.abs(F.weekday("ts") + 1 - F.col(f"{prefix}most_common_purchase_day"))
        return t.withColumn(f"{prefix}hour_relevance", 1 - F.least(hour, 24 - hour) / 12).withColumn(f"{prefix}day_of_week_relevance", 1 - F.least(day, 7 - day) / 3.5)

    return [f"{prefix}{c}" for c in ("avg_purchase_hour", "std_purchase_hour", "most_common_purchase_day", "hour_relevance", "day_of_week_relevance")], make


TEMPORAL = {"product": ("product_id", "", is_cart), "category": ("product_category", "cat_", is_buy), "store": ("store_id", "store_", is_buy)}
for _name, _of in TEMPORAL.items():
    _columns, _make = _temporal(*_of)
    REGISTRY.feature(f"{_name}_temporal_patterns", _columns, reads=[_of[0], "action_type"])(_make)


@REGISTRY.feature("frequency_features", ["mean_interval_days"], reads=["user_id", "product_id", "action_type"])
def frequency(h: DataFrame, t: DataFrame, config: dict) -> DataFrame:
    """Mean gap of a user's events but views with a product: gaps add up to last - first."""
    span = (F.max(micros()) - F.min(micros())) / (F.count("*") - 1) / DAY
    found = h.filter(~is_view()).groupBy("user_id", "product_id").agg(F.when(F.count("*") > 1, span).alias("mean_interval_days"))
    return attach(t, found, ["user_id", "product_id"]).withColumn("mean_interval_days", F.coalesce("mean_interval_days", F.lit(-1.0)))


SESSION = ["session_length_v2", "session_unique_products_v2", "session_unique_stores_v2", "session_duration_seconds_v2"]


def sessions(rows: DataFrame, wanted: DataFrame, span: int, block: int | None = None) -> DataFrame:
    """user_id, ts and SESSION of wanted instants (user_id, ts): a user's rows (user_id, product_id, store_id, ts) in the span
    (microseconds) before each, that instant excluded.

    Time is cut into blocks, and rows less than a span before a block also belong to it, so a user's rows are dealt to as many tasks as
    there are blocks. In a block nothing is collected per row: a row counts from its instant until a span later, a product until then or until it
    comes again, and the oldest row of a window is the one after the last to leave it. All are running sums and
    maxima of changes by instant.
    """
    block = block or 16 * span
    at = micros()
    rows = rows.filter(F.col("user_id").isNotNull()).select("user_id", "product_id", "store_id", at.alias("at"))
    of = F.floor(F.col("at") / block)
    rows = rows.withColumn("block", F.explode(F.sequence(of, F.floor((F.col("at") + span) / block))))
    times = rows.groupBy("user_id", "block", "at").agg(F.count("*").alias("n"))
    by = Window.partitionBy("user_id", "block").orderBy("at")
    times = times.select("user_id", "block", "at", "n", F.lead("at").over(by).alias("next"), F.row_number().over(by).alias("place"))
    change = lambda at, **x: F.struct(at.alias("at"), *[x.get(c, F.lit(None)).cast("long").alias(c) for c in ("n", "products", "stores", "seen", "oldest")])
    here, gone = F.col("at"), F.col("at") + span
    moves = [change(here, n=F.col("n"), seen=here, oldest=F.when(F.col("place") == 1, here)), change(gone, n=-F.col("n"), oldest=F.col("next"))]
    changes = times.select("user_id", "block", F.inline(F.array(*moves)))
    for key, name in (("product_id", "products"), ("store_id", "stores")):
        again = F.lead("at").over(Window.partitionBy("user_id", "block", key).orderBy("at"))
        ones = rows.filter(F.col(key).isNotNull()).select("user_id", "block", key, "at").distinct().withColumn("again", again)
        moves = [change(here, **{name: F.lit(1)}), change(F.least(gone, "again"), **{name: F.lit(-1)})]
        changes = changes.union(ones.select("user_id", "block", F.inline(F.array(*moves))))
    asked = wanted.filter(F.col("user_id").isNotNull()).select("user_id", "ts").distinct().withColumn("at", at)
    asks = asked.select("user_id", of.alias("block"), "at", *[F.lit(None).cast("long").alias(c) for c in ("n", "products", "stores", "seen", "oldest")], "ts")
    every = changes.withColumn("ts", F.lit(None).cast(wanted.schema["ts"].dataType)).union(asks)
    one = every.groupBy("user_id", "block", "at").agg(*[F.sum(c).alias(c) for c in ("n", "products", "stores")], F.max("seen").alias("seen"), F.max("oldest").alias("oldest"), F.max("ts").alias("ts"))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    out = one.select("user_id", "ts", total("n").alias(SESSION[0]), total("products").alias(SESSION[1]), total("stores").alias(SESSION[2]), (F.max("seen").over(before) - F.max("oldest").over(before)).alias("long"))
    return out.filter("ts is not null").withColumn(SESSION[3], F.when(F.col(SESSION[0]) > 0, F.floor(F.col("long") / 1_000_000))).drop("long")


@REGISTRY.feature("session_features_v2", SESSION, reads=["user_id", "product_id", "store_id"], passes=2)
def session(h: DataFrame, t: DataFrame, config: dict) -> DataFrame:
    """A user's rows in the minutes before a row, that instant excluded, over history and target."""
    span = config.get("session_minutes", 30) * 60_000_000
    columns = ["user_id", "product_id", "store_id", "ts"]
    return attach(t, sessions(h.select(*columns).unionByName(t.select(*columns)), t, span), ["user_id", "ts"])


def trend(h: DataFrame, key: str, prefix: str, bought, days: int | None) -> DataFrame:
    """Growth of a key's rows from the first half of the time to the second, as a share of the first."""
    h = with_bounds(h.select(key, "action_type", "ts")).withColumn("at", micros())
    if days is None:
        middle = F.col("t_min") + F.expr("(t_max - t_min) div 2")
    else:
        middle = F.col("t_max") - days * DAY // 2
        h = h.filter(F.col("at") >= F.col("t_max") - days * DAY)
    early = F.col("at") < middle
    value = lambda c: (number(~early & c) - number(early & c)) / F.greatest(F.lit(1), number(early & c))
    return h.groupBy(key).agg(value(F.lit(True)).alias(f"{prefix}interaction_trend"), value(bought).alias(f"{prefix}purchase_trend"))


TRENDS = {"product": ("product_id", "", lambda: F.col("action_type") == PURCHASE, None), "category": ("product_category", "cat_", is_buy, 60), "store": ("store_id", "store_", is_buy, 60)}


def _trend(key: str, prefix: str, bought, days):
    return [f"{prefix}interaction_trend", f"{prefix}purchase_trend"], lambda h, t, config: attach(t, trend(h, key, prefix, bought(), days), [key])


for _name, _of in TRENDS.items():
    _columns, _make = _trend(*_of)
    REGISTRY.feature(f"{_name}_popularity_trend", _columns, reads=[_of[0], "action_type"], passes=2)(_make)


@REGISTRY.feature("cross_features", ["user_product_purchase_cross", "user_store_purchase_cross", "user_product_store_cross"], depends_on=["user_stats", "product_stats", "store_stats", "city_stats"], reads=(), passes=0)
def cross(h: DataFrame, t: DataFrame, config: dict) -> DataFrame:
    u, p, s = (F.col(f"{x}_total_purchases").cast("double") for x in ("user", "product", "store"))
    return t.withColumns({"user_product_purchase_cross": u * p, "user_store_purchase_cross": u * s, "user_product_store_cross": u * p * s})


@REGISTRY.feature("user_segments", categorical=["user_segment"], reads=["user_id", "action_type"])
def segments(h: DataFrame, t: DataFrame, config: dict) -> DataFrame:
    found = h.groupBy("user_id").agg(F.count("*").alias("n"), (number(F.col("action_type") == PURCHASE) / F.greatest(F.lit(1), number(is_view()))).alias("rate"), (F.max(micros()) - F.min(micros())).alias("span"))
    rule = F.when(F.col("n") < 5, "new_user").when(F.col("rate") > 0.2, "high_converter").when(F.col("n") > 20, "power_user").when(F.col("span") > 30 * DAY, "loyal_user").otherwise("average_user")
    return attach(t, found.select("user_id", rule.alias("user_segment")), ["user_id"]).withColumn("user_segment", F.coalesce("user_segment", F.lit("unknown_user")))


ACTIONS = (VIEW, CLICK, CART, PURCHASE)
