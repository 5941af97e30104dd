"""Registered queries and their DuckDB equivalents, pair by pair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.common import micros, running
from .operators import basic, cf, encoding, metrics, models, selection, targets, text
from .plans import cache, split
from .plans.registry import REGISTRY
from .sources import interactions as logs
from .sources import shared
from .streaming import counts

DAYS = 7
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# ---- the DuckDB side: F the event log, H and T history and target, O the order log, each a CTE
EVENTS_SQL = logs.EVENT_LOG.format(json="json_extract_string(props, '$.k')", events="events", part="part", supplier="supplier", nation="nation").strip()
ORDERS_SQL = logs.ORDER_LOG.format(lineitem="lineitem", orders="orders", part="part", supplier="supplier", nation="nation").strip()
SPLIT_SQL = f"""WITH f AS ({EVENTS_SQL}),
h AS (SELECT * FROM f WHERE ts < (SELECT max(ts) FROM f) - INTERVAL {DAYS} DAY),
t AS (SELECT * FROM f WHERE ts >= (SELECT max(ts) FROM f) - INTERVAL {DAYS} DAY)"""
ORDER_SPLIT_SQL = f"""WITH o AS ({ORDERS_SQL}),
h AS (SELECT * FROM o WHERE ts < (SELECT max(ts) FROM o) - INTERVAL 90 DAY),
t AS (SELECT * FROM o WHERE ts >= (SELECT max(ts) FROM o) - INTERVAL 90 DAY)"""


def split_events(spark, sf_dir, columns: list[str] | None = None, once: bool = False):
    """History and target of the event log, of the columns named.

    Written once (those columns only) if a query reads it several times; once: read where it is, the cut in time as a filter of the scan.
    """
    log = logs.event_log(spark, sf_dir)
    log = log if columns is None else log.select(*dict.fromkeys(["idx", "ts", *columns]))
    return split.timewise(log if once else shared.kept(log, "log"), DAYS)


def split_orders(spark, sf_dir, columns: list[str]):
    return split.timewise(shared.kept(logs.order_log(spark, sf_dir).select(*dict.fromkeys(["ts", *columns])), "log"), 90)


def features(spark, sf_dir, names: list[str], config: dict | None = None) -> DataFrame:
    """Features on the event log, which is read where it is if they read history no more than once."""
    return REGISTRY.features_of(*split_events(spark, sf_dir, REGISTRY.log_columns(names), REGISTRY.passes(names) < 2), names, config)


def _same_types(df: DataFrame, rounded: tuple[str, ...] = ()) -> DataFrame:
    """Whole numbers as long, others rounded (some are already), instants as microseconds: what the oracle compares."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("tinyint", "smallint", "int", "bigint"):
            c = c.cast("long")
        elif (kind in ("float", "double") and name not in rounded) or kind.startswith("decimal"):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif kind.startswith("timestamp"):
            c = micros(c)
        out.append(c.alias(name))
    return df.select(*out)


def query(name: str, sql: str | None = None, rounded: tuple[str, ...] = ()):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: _same_types(f(spark, sf_dir), rounded)
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def feature(name: str, generator: str, columns: list[str], values: str | None, cte: str = "", config: dict | None = None):
    """A feature on the event log: idx and its columns. values: the SELECT over h and t, its columns named."""

    def run(spark, sf_dir):
        return features(spark, sf_dir, [generator], config).select("idx", *columns)

    query(name, None if values is None else f"{SPLIT_SQL}{cte}\n{values}")(run)


as_rounded = lambda x, a: f"round(CAST({x} AS DOUBLE), 6) + 0.0 AS {a}"
as_long = lambda x, a: f"CAST({x} AS BIGINT) AS {a}"

# ---- sources and splits
query("scan_interactions", f"""{SPLIT_SQL} SELECT idx, request_id, user_id, product_id, product_category, product_name, store_id, city_name, source_type, action_type, position_in_request, epoch_us(ts) AS ts
FROM f""")(lambda s, d: logs.event_log(s, d))
query("scan_orders", f"""WITH o AS ({ORDERS_SQL}) SELECT user_id, {as_long('count(*)', 'n')}, {as_long('sum(position_in_request)', 'positions')}, epoch_us(max(ts)) AS last_ts
FROM o GROUP BY user_id""")(
    lambda s, d: logs.order_log(s, d).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("position_in_request").cast("long").alias("positions"), F.max("ts").alias("last_ts"))
)


@query("preprocess_epoch", "SELECT event_id AS idx, epoch_us(ts) // 1000 * 1000 AS ms, epoch_us(ts) // 1000000 * 1000000 AS sec FROM events")
def _epoch(s, d):
    e = logs.scan(s, f"{d}/events.parquet").select(F.col("event_id").alias("idx"), F.floor(micros() / 1000).alias("ms"), F.floor(micros() / 1_000_000).alias("sec"))
    return logs.epoch_to_timestamp(logs.epoch_to_timestamp(e, "ms"), "sec")


query("split_timewise", f"{SPLIT_SQL} SELECT 'history' AS part, idx FROM h UNION ALL SELECT 'target', idx FROM t")(
    lambda s, d: (lambda p: p[0].select(F.lit("history").alias("part"), "idx").union(p[1].select(F.lit("target"), "idx")))(split_events(s, d, [], once=True))
)
query("split_train", f"""{SPLIT_SQL}, c AS (SELECT max(ts) AS m FROM h)
SELECT CASE WHEN ts < m - INTERVAL {DAYS} DAY THEN 'train_history' ELSE 'train_target' END AS part, idx FROM h, c
UNION ALL SELECT 'validation_history', idx FROM h UNION ALL SELECT 'validation', idx FROM t""")(
    lambda s, d: (lambda p: p[0].select(F.lit("train_history").alias("part"), "idx").union(p[1].select(F.lit("train_target"), "idx"))
    .union(p[2].select(F.lit("validation_history"), "idx")).union(p[3].select(F.lit("validation"), "idx")))(split.train(logs.event_log(s, d).select("idx", "ts"), DAYS))
)
query("split_holdout", f"{SPLIT_SQL} SELECT idx, ts >= (SELECT max(ts) FROM f) - INTERVAL 3 DAY AS held FROM f")(
    lambda s, d: (lambda p: p[0].select("idx", F.lit(False).alias("held")).union(p[1].select("idx", F.lit(True))))(split.holdout(logs.event_log(s, d).select("idx", "ts"), 3))
)
query("split_final", f"""{SPLIT_SQL} SELECT 'history' AS part, count(*) AS n, epoch_us(max(ts)) AS last_ts FROM h
UNION ALL SELECT 'target', count(*), epoch_us(max(ts)) FROM t""")(
    lambda s, d: (lambda p: p[0].agg(F.lit("history").alias("part"), F.count("*").alias("n"), F.max("ts").alias("last_ts")).union(p[1].agg(F.lit("target"), F.count("*"), F.max("ts"))))(split.final(*split.holdout(logs.event_log(s, d).select("idx", "ts"), 3), DAYS))
)
query("split_profile", f"""{SPLIT_SQL} SELECT epoch_us(min(ts)) AS first_ts, epoch_us(max(ts)) AS last_ts, count(*) AS n, CAST(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS BIGINT) AS days
FROM f""")(lambda s, d: split.profile(logs.event_log(s, d)))

# ---- features
feature("fg_random_noise", "random_noise", ["random_noise"], None)
feature("fg_source_type", "source_type", ["source_type"], "SELECT idx, source_type FROM t")
_BUY = "action_type IN ('AT_CartUpdate','AT_Purchase')"
_window_ctes = []
for _pair, _keys in basic.PAIRS.items():
    _flags = {"views": "action_type = 'AT_View'", "clicks": "action_type = 'AT_Click'", "purchases": _BUY, "interactions": "true"}
    _parts = []
    for _w, _d in basic.WINDOWS.items():
        _in = f"ts > (SELECT max(ts) FROM h) - INTERVAL {_d} DAY"
        _c = {k: f"count(*) FILTER ({v} AND {_in})" for k, v in _flags.items()}
        _null = lambda x, n=_c["interactions"]: f"CASE WHEN {n} > 0 THEN {x} END"
        _parts += [as_long(_null(_c[k]), f"{k}_{_pair}_{_w}") for k in _flags]
        _parts += [as_rounded(_null(f"{_c[k]} / ({_c['views']} + 1)"), f"{a}_{_pair}_{_w}") for k, a in (("clicks", "ctr"), ("purchases", "purchases_view_ratio"))]
    _k = ", ".join(_keys)
    _kinds = [f"{k}_{_pair}_{w}" for w in basic.WINDOWS for k in basic.KINDS]

    _window_ctes.append(f", a_{_pair} AS (SELECT {_k}, {', '.join(_parts)} FROM h WHERE ts > (SELECT max(ts) FROM h) - INTERVAL 365 DAY GROUP BY {_k})")

    def _windows(s, d, pair=_pair, keys=_keys):
        h, t = split_orders(s, d, [*keys, "action_type"])
        return t.select(*keys).distinct().join(basic.time_window_stats(h, pair), keys, "left")

    query(f"fg_time_windows_{_pair}", f"""{ORDER_SPLIT_SQL}, a AS (SELECT {_k}, {', '.join(_parts)} FROM h WHERE ts > (SELECT max(ts) FROM h) - INTERVAL 365 DAY
GROUP BY {_k}) SELECT {', '.join(f't.{k}' for k in _keys)}, {', '.join(_kinds)} FROM (SELECT DISTINCT {_k} FROM t) t
LEFT JOIN a USING ({_k})""")(_windows)
_all = [f"{k}_{p}_{w}" for p in basic.PAIRS for w in basic.WINDOWS for k in basic.KINDS]
feature("fg_time_windows", "time_windows", _all, "SELECT idx, " + ", ".join(_all) + " FROM t " + " ".join(f"LEFT JOIN a_{p} USING ({', '.join(k)})" for p, k in basic.PAIRS.items()), "".join(_window_ctes))

for _long, _s in (("user_product", "u_p"), ("user_category", "u_c"), ("user_store", "u_s")):
    _k = ", ".join(basic.PAIRS[_s])
    feature(f"fg_count_purchase_{_s}", f"count_purchase_{_long}", [f"count_purchase_{_s}"], f"""SELECT idx, coalesce(n, 0) AS count_purchase_{_s} FROM t LEFT JOIN (SELECT {_k}, count(*) AS n FROM h
WHERE action_type = 'AT_CartUpdate' GROUP BY {_k}) USING ({_k})""")
    feature(f"fg_recency_{_s}", f"recency_{_long}", [f"days_since_interaction_{_s}"], f"""SELECT idx, days_since_interaction_{_s} FROM t LEFT JOIN (SELECT {_k}, (epoch_us((SELECT max(ts)
FROM h)) - epoch_us(max(ts))) // 86400000000 AS days_since_interaction_{_s} FROM h GROUP BY {_k}) USING ({_k})""")

for _p, (_key, (_many, _col), _fn) in basic.STATS.items():
    _buy = _BUY if _p == "product" else "action_type = 'AT_CartUpdate'"
    _cols = [f"{_p}_total_interactions", f"{_p}_total_purchases", f"{_p}_total_views", f"{_p}_unique_{_many}"]
    feature(f"fg_{_p}_stats", f"{_p}_stats", _cols, f"""SELECT idx, {', '.join(_cols)} FROM t LEFT
JOIN (SELECT {_key}, count(*) AS {_cols[0]}, count(*) FILTER ({_buy}) AS {_cols[1]}, count(*) FILTER (action_type = 'AT_View') AS {_cols[2]}, count(DISTINCT {_col}) AS {_cols[3]}
FROM h GROUP BY {_key}) USING ({_key})""")

_cyc = [("hour_of_day", "hour(ts)", 24), ("day_of_week", "isodow(ts)", 7), ("month", "month(ts)", 12)]
feature("fg_time_cycl", "time_features_cycl_v2", [f"{n}_{f}_v2" for n, _, _ in _cyc for f in ("sin", "cos")] + ["is_weekend_v2"], "SELECT idx, " + ", ".join(as_rounded(f"{f}({e} * 2 * pi() / {p})", f"{n}_{f}_v2") for n, e, p in _cyc for f in ("sin", "cos")) + ", isodow(ts) >= 6 AS is_weekend_v2 FROM t")
feature("fg_russian_holiday", "russian_holiday", ["is_russian_holiday"], "SELECT idx, CAST(month(ts) * 100 + day(ts) IN (" + ", ".join(str(m * 100 + d) for m, d in basic.HOLIDAYS) + ") OR strftime(ts, '%Y-%m-%d') IN (" + ", ".join(f"'{y}-{m:02d}-{d:02d}'" for y, days in basic.TRANSFERS.items() for m, d in days) + ") AS BIGINT) AS is_russian_holiday FROM t", config={"holiday_transfers": True})
for _name, (_key, _p, _fn) in basic.TEMPORAL.items():
    _buy = "action_type = 'AT_CartUpdate'" if _name == "product" else _BUY
    _cols = [f"{_p}{c}" for c in ("avg_purchase_hour", "std_purchase_hour", "most_common_purchase_day", "hour_relevance", "day_of_week_relevance")]
    feature(f"fg_{_name}_temporal", f"{_name}_temporal_patterns", _cols, f"""SELECT idx, {as_rounded('a', _cols[0])}, {as_rounded('s', _cols[1])}, {as_long('d', _cols[2])},
{as_rounded('1 - least(abs(hour(ts) - a), 24 - abs(hour(ts) - a)) / 12', _cols[3])}, {as_rounded('1 - least(abs(isodow(ts) - d), 7 - abs(isodow(ts) - d)) / 3.5', _cols[4])}
FROM t LEFT JOIN (SELECT {_key}, avg(hour(ts)) AS a, stddev_samp(hour(ts)) AS s FROM h WHERE {_buy} GROUP BY {_key}) USING ({_key})
LEFT JOIN (SELECT {_key}, isodow(ts) AS d FROM h WHERE {_buy} GROUP BY {_key}, d
QUALIFY row_number() OVER (PARTITION BY {_key} ORDER BY count(*) DESC, d) = 1) USING ({_key})""")
feature("fg_frequency", "frequency_features", ["mean_interval_days"], f"""SELECT idx, {as_rounded('coalesce(m, -1)', 'mean_interval_days')} FROM t LEFT
JOIN (SELECT user_id, product_id, CASE WHEN count(*) > 1 THEN (epoch_us(max(ts)) - epoch_us(min(ts))) / (count(*) - 1) / 86400000000 END AS m
FROM h WHERE action_type <> 'AT_View' GROUP BY user_id, product_id) USING (user_id, product_id)""")
feature("fg_session", "session_features_v2", basic.SESSION, """SELECT idx, n AS session_length_v2, p AS session_unique_products_v2, s AS session_unique_stores_v2, sec AS session_duration_seconds_v2
FROM t JOIN (SELECT DISTINCT user_id, ts, n, p, s, sec
FROM (SELECT user_id, ts, count(*) OVER w AS n, CAST(len(list_distinct(coalesce(list(product_id) OVER w, []))) AS BIGINT) AS p, CAST(len(list_distinct(coalesce(list(store_id) OVER w, []))) AS BIGINT) AS s,
CAST(floor((max(epoch_us(ts)) OVER w - min(epoch_us(ts)) OVER w) / 1000000) AS BIGINT) AS sec FROM (SELECT user_id, product_id, store_id, ts FROM h
UNION ALL SELECT user_id, product_id, store_id, ts FROM t)
WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 1800000000 PRECEDING AND 1 PRECEDING))) USING (user_id, ts)""")
for _name, (_key, _p, _fn, _days) in basic.TRENDS.items():
    _mid = "(SELECT epoch_us(min(ts)) + (epoch_us(max(ts)) - epoch_us(min(ts))) // 2 FROM h)" if _days is None else f"(SELECT epoch_us(max(ts)) - {_days} * 43200000000 FROM h)"
    _where = "" if _days is None else f" WHERE epoch_us(ts) >= (SELECT epoch_us(max(ts)) - {_days} * 86400000000 FROM h)"
    _buy = "action_type = 'AT_Purchase'" if _name == "product" else _BUY
    _v = lambda c, a, mid=_mid: as_rounded(f"(count(*) FILTER ({c} AND epoch_us(ts) >= {mid}) - count(*) FILTER ({c} AND epoch_us(ts) < {mid})) / greatest(1, count(*) FILTER ({c} AND epoch_us(ts) < {mid}))", a)

    def _tr(s, d, key=_key, p=_p, fn=_fn, days=_days):
        return basic.trend(split_orders(s, d, [key, "action_type"])[0], key, p, fn(), days)

    query(f"fg_{_name}_trend", f"""{ORDER_SPLIT_SQL} SELECT {_key}, {_v('true', f'{_p}interaction_trend')}, {_v(_buy, f'{_p}purchase_trend')}
FROM h{_where} GROUP BY {_key}""")(_tr)
_tot = lambda k, b: f"(SELECT {k}, count(*) FILTER ({b}) AS n FROM h GROUP BY {k})"
feature("fg_cross", "cross_features", ["user_product_purchase_cross", "user_store_purchase_cross", "user_product_store_cross"], f"""SELECT idx, {as_rounded('u.n * p.n', 'user_product_purchase_cross')}, {as_rounded('u.n * s.n', 'user_store_purchase_cross')}, {as_rounded('u.n * p.n * s.n', 'user_product_store_cross')}
FROM t LEFT JOIN {_tot('user_id', "action_type = 'AT_CartUpdate'")} u USING (user_id) LEFT JOIN {_tot('product_id', _BUY)} p USING (product_id) LEFT
JOIN {_tot('store_id', "action_type = 'AT_CartUpdate'")} s USING (store_id)""")
feature("fg_user_segments", "user_segments", ["user_segment"], """SELECT idx, coalesce(g, 'unknown_user') AS user_segment FROM t LEFT JOIN (SELECT user_id, CASE WHEN count(*) < 5 THEN 'new_user'
WHEN count(*) FILTER (action_type = 'AT_Purchase') / greatest(1, count(*) FILTER (action_type = 'AT_View')) > 0.2 THEN 'high_converter' WHEN count(*) > 20 THEN 'power_user'
WHEN epoch_us(max(ts)) - epoch_us(min(ts)) > 30 * 86400000000 THEN 'loyal_user' ELSE 'average_user' END AS g FROM h GROUP BY user_id) USING (user_id)""")

# ---- collaborative filtering
_ACTS = ["user_id", "product_id", "action_type"]
_M = f", m AS (SELECT user_id, product_id, count(*) AS cnt FROM h WHERE {_BUY} GROUP BY ALL)"
_J = ", z AS (SELECT user_id, count(*) AS n FROM m GROUP BY ALL), j AS (SELECT x.user_id AS a, y.user_id AS b, count(*) AS c FROM m x JOIN m y USING (product_id) GROUP BY ALL), js AS (SELECT a, b, c / (za.n + zb.n - c) AS sim FROM j JOIN z za ON za.user_id = a JOIN z zb ON zb.user_id = b)"
_N = ", z AS (SELECT product_id, count(*) AS n FROM m GROUP BY ALL), uu AS (SELECT count(DISTINCT user_id) AS u FROM m), j AS (SELECT x.product_id AS a, y.product_id AS b, count(*) AS c FROM m x JOIN m y USING (user_id) WHERE x.product_id <> y.product_id GROUP BY ALL), np AS (SELECT a, b, CASE WHEN c = u THEN 0 ELSE ln((c / u) / ((za.n / u) * (zb.n / u))) / -ln(c / u) END AS npmi FROM j JOIN z za ON za.product_id = a JOIN z zb ON zb.product_id = b, uu)"
_KNOWN = "t LEFT JOIN (SELECT DISTINCT user_id, 1 AS ku FROM m) USING (user_id) LEFT JOIN (SELECT DISTINCT product_id, 1 AS kp FROM m) USING (product_id)"
query("interaction_matrix", f"{ORDER_SPLIT_SQL}{_M} SELECT user_id, product_id, cnt FROM m")(lambda s, d: cf.interaction_matrix(split_orders(s, d, _ACTS)[0]))
query("cf_jaccard", f"{SPLIT_SQL}{_M}{_J} SELECT a, b, {as_rounded('sim', 'sim')} FROM js", ("sim",))(lambda s, d: cf.jaccard(cf.interaction_matrix(split_events(s, d, _ACTS)[0]), digits=6))
query("cf_npmi", f"{SPLIT_SQL}{_M}{_N} SELECT a, b, {as_rounded('npmi', 'npmi')} FROM np")(lambda s, d: cf.npmi(cf.interaction_matrix(split_events(s, d, _ACTS)[0])))
query("cf_idf", f"""{ORDER_SPLIT_SQL}, m AS (SELECT DISTINCT user_id, product_id FROM h
WHERE action_type IN ('AT_CartUpdate','AT_Purchase','AT_Click')) SELECT product_id, {as_rounded('ln((SELECT count(DISTINCT user_id) FROM m) / (count(*) + 1))', 'idf')}
FROM m GROUP BY product_id""")(lambda s, d: cf.idf(cf.interaction_matrix(split_orders(s, d, _ACTS)[0], cf._ACT, True)))
feature("fg_memory_cf", "memory-based-cf", ["cf_score"], f"""SELECT idx, {as_rounded('CASE WHEN ku = 1 AND kp = 1 THEN coalesce(v, 0) END', 'cf_score')} FROM {_KNOWN} LEFT
JOIN (SELECT a AS user_id, product_id, sum(sim * cnt) AS v FROM js JOIN m ON m.user_id = b
GROUP BY ALL) USING (user_id, product_id)""", _M + _J)
feature("fg_npmi_cf", "npmi-cf", ["npmi_cf_score"], f"""SELECT idx, {as_rounded('CASE WHEN ku = 1 AND kp = 1 THEN CASE WHEN cnt IS NULL THEN coalesce(v, 0) ELSE 0 END END', 'npmi_cf_score')}
FROM {_KNOWN} LEFT JOIN m USING (user_id, product_id) LEFT JOIN (SELECT user_id, a AS product_id, sum(npmi) AS v FROM m
JOIN np ON b = m.product_id GROUP BY ALL) USING (user_id, product_id)""", _M + _N)
feature("fg_svd_cf", "svd-cf", ["svd_cf_score"], None)
feature("fg_puresvd_cf", "puresvd-cf", ["puresvd_cf_score"], None)
feature("fg_bpr", "bpr-popular", ["bpr_popular_score"], None)


# ---- text and vectors
def _vectors(s, d):
    return logs.scan(s, f"{d}/embeddings.parquet").select(F.col("vec_id").alias("product_id"), F.col("embedding").alias("vector"))


def _given(generator, columns):
    def run(s, d):
        h, t = split_events(s, d, REGISTRY.log_columns([generator]))
        labels = logs.scan(s, f"{d}/embeddings.parquet").select(F.col("vec_id").alias("product_id"), F.col("label").alias("cluster"))
        return REGISTRY.features_of(h, t, [generator], {"vectors": _vectors(s, d), "labels": labels}).select("idx", *columns)

    return run


feature("fg_product_embeddings", "product_embeddings", [f"product_embed_{i}" for i in range(text.DIMENSIONS)], None)
feature("fg_category_embeddings", "category_embeddings", [f"cat_embed_{i}" for i in range(text.DIMENSIONS)], None)
_dots = lambda a, b: f"list_dot_product({a}, {b})"
_COS = lambda a, b: f"CASE WHEN sqrt({_dots(a, a)}) < 1e-9 OR sqrt({_dots(b, b)}) < 1e-9 THEN 0 ELSE {_dots(a, b)} / (sqrt({_dots(a, a)}) * sqrt({_dots(b, b)})) END"
_V = ", v AS (SELECT vec_id AS product_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


def _user_vectors(where):
    return f"""SELECT user_id, list(x ORDER BY i) AS e FROM (SELECT user_id, i, sum(n * x) / sum(n) AS x
FROM (SELECT user_id, n, unnest(range(1, len(e) + 1)) AS i, unnest(e) AS x
FROM (SELECT user_id, product_id, count(*) AS n FROM h WHERE {where} GROUP BY ALL) JOIN v USING (product_id)) GROUP BY user_id, i) GROUP BY user_id"""


query("fg_user_product_sim", f"""{SPLIT_SQL}{_V}, cp AS ({_user_vectors("action_type = 'AT_Purchase'")}), cc AS ({_user_vectors("action_type = 'AT_CartUpdate'")}),
k AS (SELECT DISTINCT user_id, product_id, e FROM t JOIN v USING (product_id)),
past AS (SELECT DISTINCT user_id, action_type, e FROM h JOIN v USING (product_id) WHERE action_type IN ('AT_Purchase', 'AT_CartUpdate')),
mx AS (SELECT k.user_id, k.product_id, past.action_type, max({_COS('k.e', 'past.e')}) AS c FROM k JOIN past ON past.user_id = k.user_id GROUP BY ALL)
SELECT idx, {as_rounded(f"coalesce({_COS('k.e', 'cp.e')}, 0)", text.SIMILARITY[0])}, {as_rounded(f"coalesce({_COS('k.e', 'cc.e')}, 0)", text.SIMILARITY[1])}, {as_rounded('coalesce(m1.c, 0)', text.SIMILARITY[2])}, {as_rounded('coalesce(m2.c, 0)', text.SIMILARITY[3])}
FROM t LEFT JOIN k USING (user_id, product_id) LEFT JOIN cp USING (user_id) LEFT JOIN cc USING (user_id)
LEFT JOIN mx m1 ON m1.user_id = t.user_id AND m1.product_id = t.product_id AND m1.action_type = 'AT_Purchase' LEFT
JOIN mx m2 ON m2.user_id = t.user_id AND m2.product_id = t.product_id AND m2.action_type = 'AT_CartUpdate'""")(_given("user_product_similarity", text.SIMILARITY))
_ratio = lambda a, c: as_rounded(f"coalesce(count(*) FILTER (action_type = '{a}') / nullif(sum(count(*) FILTER (action_type = '{a}')) OVER (PARTITION BY user_id), 0), 0)", c)
query("fg_text_cluster", f"""{SPLIT_SQL}, l AS (SELECT vec_id AS product_id, CAST(label AS BIGINT) AS cl FROM embeddings),
c AS (SELECT user_id, cl, {_ratio('AT_Purchase', text.CLUSTER[0])}, {_ratio('AT_CartUpdate', text.CLUSTER[1])}, {_ratio('AT_View', text.CLUSTER[2])}
FROM h JOIN l USING (product_id) GROUP BY user_id, cl)
SELECT idx, coalesce(cl, -1) AS product_text_cluster, {', '.join(f'coalesce({x}, 0.0) AS {x}' for x in text.CLUSTER)} FROM t LEFT
JOIN l USING (product_id) LEFT JOIN c USING (user_id, cl)""")(_given("text_similarity_cluster", ["product_text_cluster", *text.CLUSTER]))
query("fg_text_diversity", f"""{SPLIT_SQL}{_V}, c AS ({_user_vectors("action_type IN ('AT_Purchase', 'AT_View')")}),
s AS (SELECT h.user_id, avg(list_distance(v.e, c.e)) AS sp FROM h JOIN v USING (product_id) JOIN c ON c.user_id = h.user_id
WHERE action_type IN ('AT_Purchase', 'AT_View') GROUP BY ALL),
x AS (SELECT idx, list_distance(v.e, c.e) AS dist, sp FROM t JOIN v USING (product_id) JOIN c ON c.user_id = t.user_id
JOIN s ON s.user_id = t.user_id)
SELECT t.idx, {as_rounded('coalesce(dist, 0)', 'distance_from_centroid')}, {as_rounded('coalesce(CASE WHEN sp > 1e-9 THEN dist / sp WHEN dist > 1e-9 THEN dist ELSE 0 END, 0)', 'relative_diversity')}
FROM t LEFT JOIN x USING (idx)""")(_given("text_diversity_features", ["distance_from_centroid", "relative_diversity"]))
def _places(vector):
    """A vector as rows of place and value."""
    return F.transform(vector, lambda x, i: F.struct(i.alias("place"), x.alias("value")))


query("text_clusters")(lambda s, d: text.clusters(_vectors(s, d)))
query("text_items")(lambda s, d: text.item_vectors(*split_events(s, d, ["product_id", "product_name"]), "product_id", "product_name", {}).select("product_id", F.inline(_places("vector"))))
query("text_embed")(lambda s, d: text.embed(logs.scan(s, f"{d}/part.parquet"), "p_partkey", "p_name", "word2vec", 16).select("p_partkey", F.inline(_places("vector"))))
query("text_subwords")(lambda s, d: text.embed(logs.scan(s, f"{d}/part.parquet"), "p_partkey", "p_name", "subwords", 16).select("p_partkey", F.inline(_places("vector"))))
query("text_pca")(lambda s, d: text.reduce(_vectors(s, d), "product_id").select("product_id", F.inline(_places("vector"))))

# ---- labels
_pair = "CASE WHEN request_id IS NOT NULL THEN max({}) OVER (PARTITION BY request_id, product_id) END"
_grade = "CASE action_type WHEN 'AT_View' THEN 0.0 WHEN 'AT_CartUpdate' THEN 0.85 WHEN 'AT_Purchase' THEN 1.0 WHEN 'AT_Click' THEN 0.3 ELSE 0.0 END"
_act = "action_type IN ('AT_CartUpdate','AT_Purchase','AT_Click')"
for _key, _target, _sql in [
    ("tg_cart_vs_view", "CartUpdate_vs_View", "CASE action_type WHEN 'AT_View' THEN 0 WHEN 'AT_CartUpdate' THEN 1 END"),
    ("tg_cart_purchase_vs_view", "CartUpdate_Purchase_vs_View", f"CASE WHEN action_type = 'AT_View' THEN 0 WHEN {_BUY} THEN 1 END"),
    ("tg_weighted", "Weighted", _pair.format(_grade)),
    ("tg_conversion_aware", "CartUpdate_conversion_aware", f"CASE WHEN {_act} THEN 1 WHEN action_type = 'AT_View' AND NOT bool_or({_act}) OVER (PARTITION BY request_id, product_id) THEN 0 END"),
    ("tg_interaction_aware", "Weighted_InteractionAware", _pair.format("g")),
    ("tg_pos_aware", "Weighted_pos_in_req_aware", _pair.format(f"({_grade}) * coalesce(1 / log2(position_in_request + 1), 0)")),
]:
    _from = f"""(SELECT *, CASE WHEN action_type = 'AT_View' THEN CASE WHEN bool_or({_act}) OVER (PARTITION BY request_id) THEN 0.05 ELSE 0.15 END ELSE {_grade} END AS g
FROM f)""" if "interaction" in _key else "f"
    query(_key, f"{SPLIT_SQL} SELECT idx, {as_rounded(_sql, 'label')} FROM {_from}")(lambda s, d, target=_target: REGISTRY.labelled(logs.event_log(s, d), target).select("idx", "label"))
_CLEAN = {"min_unique_products": 3, "require_action": True, "accepted_sources": ["ST_1", "ST_2"], "clean_target": True}
_MASK = "ok AS (SELECT request_id FROM f WHERE request_id IS NOT NULL GROUP BY request_id HAVING count(DISTINCT product_id) >= 3 AND bool_or(action_type <> 'AT_View'))"
_OK = "coalesce(request_id IN (SELECT request_id FROM ok), false) AND source_type IN ('ST_1', 'ST_2')"
query("tg_clean_mask", f"{SPLIT_SQL}, {_MASK} SELECT idx, {_OK} AS accepted FROM f")(lambda s, d: targets.clean_mask(logs.event_log(s, d), _CLEAN).select("idx", "accepted"))

# ---- framework
_LABELLED = ["request_id", "user_id", "product_id", "action_type"]
query("pipeline_batch", f"""{SPLIT_SQL}, {_MASK.replace('FROM f', 'FROM t')} SELECT idx, request_id, {as_rounded('label', 'label')}, coalesce(n, 0) AS count_purchase_u_p
FROM (SELECT *, {_pair.format(_grade)} AS label FROM t)
LEFT JOIN (SELECT user_id, product_id, count(*) AS n FROM h WHERE action_type = 'AT_CartUpdate' GROUP BY ALL) USING (user_id, product_id)
WHERE label IS NOT NULL AND {_OK}""")(
    lambda s, d: REGISTRY.batch(*split_events(s, d, [*_LABELLED, "source_type"]), ["count_purchase_user_product"], {"name": "Weighted"}, _CLEAN).select("idx", "request_id", "label", "count_purchase_u_p")
)
_SOME = ["user_total_interactions", "user_total_purchases", "user_total_views", "user_unique_products", "product_total_interactions", "product_total_views"]
query("pipeline_features", f"""{SPLIT_SQL} SELECT idx, user_total_interactions, user_unique_products, product_total_interactions FROM t LEFT
JOIN (SELECT user_id, count(*) AS user_total_interactions, count(DISTINCT product_id) AS user_unique_products FROM h GROUP BY ALL) USING (user_id)
LEFT JOIN (SELECT product_id, count(*) AS product_total_interactions FROM h GROUP BY ALL) USING (product_id)""")(
    lambda s, d: features(s, d, ["user_stats", "product_stats"]).select("idx", "user_total_interactions", "user_unique_products", "product_total_interactions")
)


@query("cache_roundtrip", f"""{SPLIT_SQL} SELECT idx, user_total_interactions, user_unique_products FROM t LEFT
JOIN (SELECT user_id, count(*) AS user_total_interactions, count(DISTINCT product_id) AS user_unique_products FROM h
GROUP BY ALL) USING (user_id)""")
def _cached(s, d):
    (h, t), folder = split_events(s, d, REGISTRY.log_columns(["user_stats"])), shared.place(s, "features")
    cache.cached(folder, "user_stats", h, t)
    return cache.cached(folder, "user_stats", h, t).select("idx", "user_total_interactions", "user_unique_products")


_UP = f"""{SPLIT_SQL}, x AS (SELECT idx, {', '.join(_SOME)} FROM t LEFT
JOIN (SELECT user_id, count(*) AS user_total_interactions, count(*) FILTER (action_type = 'AT_CartUpdate') AS user_total_purchases, count(*) FILTER (action_type = 'AT_View') AS user_total_views, count(DISTINCT product_id) AS user_unique_products
FROM h GROUP BY ALL) USING (user_id)
LEFT JOIN (SELECT product_id, count(*) AS product_total_interactions, count(*) FILTER (action_type = 'AT_View') AS product_total_views FROM h
GROUP BY ALL) USING (product_id))"""
query("corr_matrix", _UP + "\n" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {as_rounded(f'abs(corr({a}, {b}))', 'corr')} FROM x" for i, a in enumerate(_SOME) for b in _SOME[i + 1 :]))(
    lambda s, d: selection.correlations(features(s, d, ["user_stats", "product_stats"]), _SOME)
)


@query("feature_select")
def _select(s, d):
    df = features(s, d, ["user_stats", "product_stats"])
    found = {(r.a, r.b): r["corr"] for r in selection.correlations(df, _SOME).collect()}
    return df.select("idx", *selection.select(_SOME, found, {"user_total_interactions": 1.0}))


def _scored(s, d):
    h, t = split_events(s, d, _LABELLED)
    t = REGISTRY.labelled(t, "Weighted").filter("label is not null")
    featured = shared.kept(REGISTRY.features_of(h, t, ["product_stats"]), "scored")
    return models.SingleFeatureModel("product_total_purchases").train(featured, [], []).predict(featured)


_SCORED = f""", y AS (SELECT *, {_pair.format(_grade)} AS label
FROM t), q AS (SELECT y.*, coalesce(CAST(n AS DOUBLE), CAST(min(n) OVER () AS DOUBLE)) AS score FROM y LEFT
JOIN (SELECT product_id, count(*) FILTER ({_BUY}) AS n FROM h GROUP BY ALL) USING (product_id) WHERE label IS NOT NULL)"""
query("model_single_feature", f"{SPLIT_SQL}{_SCORED} SELECT idx, {as_rounded('score', 'score')} FROM q")(lambda s, d: _scored(s, d).select("idx", "score"))
query("submission", f"{SPLIT_SQL}{_SCORED} SELECT row_number() OVER (ORDER BY score DESC, idx) AS place, idx AS \"index\", request_id FROM q")(
    lambda s, d: running(_scored(s, d).select("score", "idx", "request_id"), [F.desc("score"), F.col("idx")], F.lit(1), "before").select((F.col("before") + 1).alias("place"), F.col("idx").alias("index"), "request_id")
)
query("eval_binarize", f"{SPLIT_SQL}{_SCORED} SELECT idx, {as_rounded('CASE WHEN label = (SELECT max(label) FROM q) THEN 1 ELSE 0 END', 'label')} FROM q")(lambda s, d: metrics.binarize(_scored(s, d), "label").select("idx", "label"))


# ---- metrics
def _graded(s, d):
    docs, labels = logs.scan(s, f"{d}/documents.parquet"), logs.scan(s, f"{d}/labels.parquet")
    return docs.join(labels, "doc_id").select("doc_id", "lang", "quality", (F.col("n_chars") % 50 / 50).alias("score"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


_G = "WITH g AS (SELECT doc_id, lang, quality, (n_chars % 50) / 50 AS score FROM documents JOIN labels USING (doc_id))"
query("metric_ndcg", f"""{SPLIT_SQL}{_SCORED}, a AS (SELECT request_id, label, score, idx, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, idx) AS r FROM q
WHERE request_id IN (SELECT request_id FROM q GROUP BY request_id HAVING sum(label) > 0)),
b AS (SELECT request_id, label, score FROM a WHERE r <= 10), p AS (SELECT * FROM b UNION ALL SELECT request_id, 0, 0
FROM (SELECT request_id, unnest(range(0, 10 - count(*))) FROM b GROUP BY request_id)),
r AS (SELECT *, 1 / log2(1 + row_number() OVER (PARTITION BY request_id ORDER BY score DESC)) AS d, row_number() OVER (PARTITION BY request_id ORDER BY label DESC) AS i
FROM p),
e AS (SELECT request_id, sum(gain) AS dcg FROM (SELECT request_id, avg(label) * sum(d) AS gain FROM r GROUP BY request_id, score)
GROUP BY ALL), z AS (SELECT request_id, sum(label / log2(i + 1)) AS ideal FROM r GROUP BY ALL)
SELECT {as_rounded('coalesce(avg(coalesce(dcg / nullif(ideal, 0), 0)), 0)', 'ndcg')} FROM e JOIN z USING (request_id)""")(lambda s, d: metrics.ndcg(_scored(s, d), "request_id", "label", "score"))
query("metric_map", f"""{SPLIT_SQL}{_SCORED}, a AS (SELECT request_id, CASE WHEN label > 0 THEN 1 ELSE 0 END AS hit, row_number() OVER w AS r, sum(CASE WHEN label > 0 THEN 1 ELSE 0 END) OVER w AS hits
FROM q WHERE request_id IS NOT NULL WINDOW w AS (PARTITION BY request_id ORDER BY score DESC, idx ROWS UNBOUNDED PRECEDING))
SELECT {as_rounded('coalesce(avg(s / n), 0)', 'map')} FROM (SELECT sum(CASE WHEN r <= 10 AND hit = 1 THEN hits / r ELSE 0 END) AS s, sum(hit) AS n
FROM a GROUP BY request_id HAVING sum(hit) > 0)""")(lambda s, d: metrics.mean_average_precision(_scored(s, d), "request_id", "label", "score"))


def _users(s, d):
    h, t = split_events(s, d, ["user_id", "product_id", "action_type"])
    bought = cf.interaction_matrix(h).select("user_id", "product_id", F.lit(1).alias("b"))
    one = t.groupBy("user_id", "product_id").agg((F.count("*") / 10).alias("score"))
    return h, one.join(bought, ["user_id", "product_id"], "left").select("user_id", "product_id", "score", F.coalesce("b", F.lit(0)).alias("has_purchased"))


def _novelty(s, d):
    h, one = _users(s, d)
    n = h.select(F.count("*").alias("all"))
    popularity = h.groupBy("product_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n)).select("product_id", (F.col("n") / F.col("all")).alias("popularity"))
    return metrics.novelty(one, popularity)


_TOP = f"""{_M}, k AS (SELECT user_id, product_id, count(*) / 10 AS score FROM t
GROUP BY ALL), r AS (SELECT k.*, CASE WHEN cnt IS NULL THEN 0 ELSE 1 END AS b FROM k LEFT
JOIN m USING (user_id, product_id)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, product_id) <= 10)"""
query("metric_novelty", f"""{SPLIT_SQL}{_TOP} SELECT {as_rounded('avg(x)', 'novelty')} FROM (SELECT avg(1 - coalesce(p, 0)) AS x FROM r LEFT
JOIN (SELECT product_id, count(*) / (SELECT count(*) FROM h) AS p FROM h GROUP BY ALL) USING (product_id)
GROUP BY user_id)""")(_novelty)
query("metric_serendipity", f"{SPLIT_SQL}{_TOP} SELECT {as_rounded('avg(x)', 'serendipity')} FROM (SELECT avg(score * (1 - b)) AS x FROM r GROUP BY user_id)")(lambda s, d: metrics.serendipity(_users(s, d)[1]))
query("metric_auc", f"""{_G} SELECT {as_rounded('(sum(CASE WHEN quality > 0 THEN rk END) - count(*) FILTER (quality > 0) * (count(*) FILTER (quality > 0) + 1) / 2) / (count(*) FILTER (quality > 0) * count(*) FILTER (quality <= 0))', 'auc')}
FROM (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM g)""")(lambda s, d: metrics.auc(_graded(s, d), "quality", "score"))
query("metric_logloss", f"""{_G} SELECT {as_rounded('avg(-(quality * ln(p) + (1 - quality) * ln(1 - p)))', 'logloss')}
FROM (SELECT quality, least(greatest(score, 1e-15), 1 - 1e-15) AS p FROM g)""")(lambda s, d: metrics.log_loss(_graded(s, d), "quality", "score"))
query("top_interactions", f"{SPLIT_SQL} SELECT product_id, count(*) AS n FROM f GROUP BY ALL ORDER BY n DESC, product_id LIMIT 20")(lambda s, d: logs.event_log(s, d).groupBy("product_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "product_id").limit(20))


_MODEL_FEATURES = ["user_stats", "product_stats", "count_purchase_user_product"]
_MODEL_COLUMNS = [c for n in _MODEL_FEATURES for c in REGISTRY.features[n].numeric]
_MODEL_CATEGORIES = ["source_type", "product_category", "city_name"]


def _batch(s, d, label):
    h, t = split_events(s, d, [*_LABELLED, *_MODEL_CATEGORIES])
    return shared.kept(REGISTRY.batch(h, t, _MODEL_FEATURES, label), "batch")


def _ranked(s, d):
    batch = _batch(s, d, "Weighted")
    return batch, models.create({"type": "ranker"}).train(batch, _MODEL_COLUMNS, _MODEL_CATEGORIES)


@query("leaderboard")
def _leaderboard(s, d):
    """NDCG and MAP of two models on the last days, and by how many percent the first is ahead: popularity by purchases against that by views."""
    from .plans.experiment import compared

    h, t = split_events(s, d, _LABELLED)
    batch = shared.kept(REGISTRY.batch(h, t, ["product_stats"], "Weighted"), "batch")

    def metrics_of(feature):
        scored = models.SingleFeatureModel(feature).train(batch, [], []).predict(batch)
        return {"ndcg": metrics.ndcg(scored, "request_id", "label", "score").first()[0], "map": metrics.mean_average_precision(scored, "request_id", "label", "score").first()[0]}

    return s.createDataFrame(compared(metrics_of("product_total_purchases"), metrics_of("product_total_views")), "metric string, one double, other double, change double")


@query("model_ranker")
def _ranker(s, d):
    """Trees by pairwise gradients within requests."""
    batch, model = _ranked(s, d)
    return model.predict(batch).select("idx", "score")


@query("model_pointwise_ranker")
def _pointwise(s, d):
    batch = _batch(s, d, "Weighted")
    return models.create({"type": "pointwise_ranker"}).train(batch, _MODEL_COLUMNS, _MODEL_CATEGORIES).predict(batch).select("idx", "score")


@query("model_classifier")
def _classifier(s, d):
    batch = _batch(s, d, "CartUpdate_Purchase_vs_View")
    return models.create({"type": "classifier"}).train(batch, _MODEL_COLUMNS, _MODEL_CATEGORIES).predict(batch).select("idx", "score")


@query("model_importance")
def _importance(s, d):
    """The 20 columns that matter most to the ranker: their share of the gain, and what NDCG loses when they are shuffled."""
    _, model = _ranked(s, d)
    lost = model.loss_importance()
    return s.createDataFrame([(c, x, lost[c]) for c, x in models.top_importance(model)], "column string, importance double, ndcg_lost double")


# target statistics: the label of rows of the category that come before in a fixed order (here that of idx)
query("target_statistics", f"""{SPLIT_SQL}, y AS (SELECT *, {_pair.format(_grade)} AS label FROM t), m AS (SELECT avg(label) AS mean FROM y WHERE label IS NOT NULL)
SELECT coalesce(product_category, 'NA') AS value, {as_rounded('(sum(label) + (SELECT mean FROM m)) / (count(label) + 1)', 'stat')}, count(label) AS n
FROM y WHERE label IS NOT NULL GROUP BY ALL""")(lambda s, d: _statistics(s, d))


def _statistics(s, d):
    batch = REGISTRY.labelled(split_events(s, d, [*_LABELLED, "product_category"])[1], "Weighted").filter("label is not null")
    mean = batch.agg(F.avg("label")).first()[0] or 0.0
    found = encoding.statistics(batch, ["product_category"], "label")
    return found.select("value", ((F.col("total") + mean) / (F.col("n") + 1)).alias("stat"), "n")


query("stream_hourly_counts", f"""{SPLIT_SQL} SELECT user_id, epoch_us(date_trunc('hour', ts)) AS hour, count(*) AS interactions, count(*) FILTER (action_type = 'AT_View') AS views, count(*) FILTER ({_BUY}) AS purchases
FROM f GROUP BY ALL""")(
    lambda s, d: counts.hourly_counts(logs.event_log(s, d))
)

from . import exploration_queries  # noqa: E402,F401  they register themselves
