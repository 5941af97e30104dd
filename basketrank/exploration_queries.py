"""Exploratory queries over both logs beside their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import exploration as look
from .queries import EVENTS_SQL, ORDERS_SQL, SPLIT_SQL, as_long, as_rounded, features, query
from .sources.interactions import event_log, order_log

_LOG = f"WITH f AS ({EVENTS_SQL})"
_ORDERS = f"WITH f AS ({ORDERS_SQL})"


def _described(inner: str) -> str:
    return f"""
SELECT count(n) AS n, {as_rounded('avg(n)', 'mean')}, {as_rounded('stddev_samp(n)', 'std')}, {as_long('min(n)', 'least')},
       {as_rounded('quantile_cont(n, 0.25)', 'p25')}, {as_rounded('quantile_cont(n, 0.5)', 'p50')}, {as_rounded('quantile_cont(n, 0.75)', 'p75')},
       {as_long('max(n)', 'largest')}
FROM ({inner})"""


query("eda_distinct_users", f"{_LOG} SELECT count(DISTINCT user_id) AS n FROM f")(lambda s, d: look.distinct_values(event_log(s, d), "user_id"))

query("eda_time_range", f"""{_LOG}
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS earliest, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest,
       {as_rounded('(epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000', 'days')}
FROM f""")(lambda s, d: look.time_range(event_log(s, d)))

query("eda_source_types", f"{_LOG} SELECT DISTINCT source_type FROM f")(lambda s, d: event_log(s, d).select("source_type").distinct())

query("eda_source_types_per_request", f"{_LOG}{_described('SELECT count(DISTINCT source_type) AS n FROM f GROUP BY request_id')}")(
    lambda s, d: look.described(look.distinct_per(event_log(s, d), "request_id", "source_type"), "n")
)

query("eda_users_per_request", f"{_LOG}{_described('SELECT count(DISTINCT user_id) AS n FROM f WHERE request_id IS NOT NULL GROUP BY request_id')}")(
    lambda s, d: look.described(look.distinct_per(event_log(s, d), "request_id", "user_id", nulls=False), "n")
)

query("eda_keys_of_many", f"""{_ORDERS}
SELECT request_id, count(DISTINCT product_id) AS n FROM f WHERE request_id IS NOT NULL
GROUP BY request_id HAVING count(DISTINCT product_id) <> 1""")(lambda s, d: look.keys_of_many(order_log(s, d), "request_id", "product_id"))

_MANY = [("request_id", "user_id"), ("product_id", "request_id"), ("request_id", "product_id")]


@query("eda_one_to_many", f"{_LOG} " + " UNION ALL ".join(f"""
SELECT '{a}' AS one, '{b}' AS other, coalesce(bool_or(n > 1), false) AS many
FROM (SELECT count(DISTINCT {b}) AS n FROM f WHERE {a} IS NOT NULL GROUP BY {a})""" for a, b in _MANY))  # fmt: skip
def _one_to_many(s, d):
    log = event_log(s, d)
    parts = [look.one_to_many(log, a, b).select(F.lit(a).alias("one"), F.lit(b).alias("other"), "many") for a, b in _MANY]
    return parts[0].union(parts[1]).union(parts[2])


def _single(wanted: str) -> str:
    return f"""
SELECT count(*) FILTER (sole AND {wanted}) AS users, {as_rounded(f'count(*) FILTER (sole AND {wanted}) / count(*)', 'share')}
FROM (SELECT user_id, count(DISTINCT action_type) = 1 AND count(action_type) = count(*) AS sole, min(action_type) AS a FROM f GROUP BY user_id)"""


query("eda_view_only_users", f"""{_LOG}{_single("a = 'AT_View'")}""")(lambda s, d: look.view_only_users(event_log(s, d)))
query("eda_single_action_users", f"""{_LOG}{_single("a <> 'AT_View'")}""")(lambda s, d: look.single_action_users(event_log(s, d)))

_IGNORED = ["idx", "request_id", "position_in_request", "ts"]
query("eda_duplicates", f"""{_LOG},
k AS (SELECT count(*) AS k FROM f GROUP BY user_id, product_id, product_category, product_name, store_id, city_name, source_type, action_type)
SELECT {as_long('coalesce(sum(k) FILTER (k > 1), 0)', 'n')}, {as_rounded('coalesce(sum(k) FILTER (k > 1), 0) / sum(k)', 'share')} FROM k""")(
    lambda s, d: look.duplicates(event_log(s, d), _IGNORED)
)

_COLUMNS = ["idx", "request_id", "user_id", "product_id", "product_category", "product_name", "store_id", "city_name", "source_type", "action_type", "ts"]
query("eda_nulls", f"{_LOG} " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls FROM f" for c in _COLUMNS))(
    lambda s, d: look.null_counts(event_log(s, d).select(_COLUMNS))
)

query("eda_repeats", f"""{_LOG}
SELECT product_id, request_id, count(*) AS n_repeats, string_agg(DISTINCT action_type, ',' ORDER BY action_type) AS actions,
       count(DISTINCT action_type) AS n_actions
FROM f GROUP BY product_id, request_id HAVING count(*) > 1""")(lambda s, d: look.repeats(event_log(s, d)).filter("n_repeats > 1"))

query("eda_action_types", f"{_LOG} SELECT DISTINCT action_type FROM f")(lambda s, d: event_log(s, d).select("action_type").distinct())
query("eda_city_counts", f"{_LOG} SELECT city_name, count(*) AS actions_count FROM f GROUP BY city_name")(lambda s, d: look.counts(event_log(s, d), "city_name"))
query("eda_action_counts", f"{_LOG} SELECT action_type, count(*) AS actions_count FROM f GROUP BY action_type")(lambda s, d: look.counts(event_log(s, d), "action_type"))

query("eda_top_products", f"""{_LOG}
SELECT product_name, count(*) AS total_purchase, min(product_id) AS product_id FROM f WHERE action_type = 'AT_Purchase'
GROUP BY product_name ORDER BY total_purchase DESC, product_name LIMIT 10""")(lambda s, d: look.top_products(event_log(s, d)))

query("eda_user_activity", f"""{_LOG},
u AS (SELECT count(*) AS k FROM f GROUP BY user_id), r AS (SELECT min(k) AS a, (max(k) - min(k)) / 50 AS w FROM u)
SELECT {as_long('b', 'bin')}, {as_rounded('b * w + a', 'low')}, count(*) AS n
FROM (SELECT least(floor((k - a) / w), 49) AS b, w, a FROM u, r) GROUP BY b, w, a""")(lambda s, d: look.user_activity(event_log(s, d)))

query("eda_rows_per_day", f"{_LOG} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM f GROUP BY day")(lambda s, d: look.rows_per_day(event_log(s, d)))


# what a made feature looks like: distinct values of categories, a description of a number
query("eda_feature_categories", f"""{SPLIT_SQL}
SELECT count(DISTINCT source_type) AS source_type, count(DISTINCT g) AS user_segment FROM (SELECT source_type,
  coalesce(CASE WHEN n < 5 THEN 'new_user' WHEN buys / greatest(1, views) > 0.2 THEN 'high_converter' WHEN n > 20 THEN 'power_user'
                WHEN span > 30 * 86400000000 THEN 'loyal_user' WHEN n IS NOT NULL THEN 'average_user' END, 'unknown_user') AS g
  FROM t LEFT JOIN (SELECT user_id, count(*) AS n, count(*) FILTER (action_type = 'AT_Purchase') AS buys,
                           count(*) FILTER (action_type = 'AT_View') AS views, epoch_us(max(ts)) - epoch_us(min(ts)) AS span
                    FROM h GROUP BY user_id) USING (user_id))""")(
    lambda s, d: features(s, d, ["source_type", "user_segments"]).agg(*[F.countDistinct(c).alias(c) for c in ("source_type", "user_segment")])
)
query("eda_feature_described", f"{SPLIT_SQL}{_described('SELECT n FROM t LEFT JOIN (SELECT user_id, count(*) AS n FROM h GROUP BY user_id) USING (user_id)')}")(
    lambda s, d: look.described(features(s, d, ["user_stats"]).select(F.col("user_total_interactions").alias("n")), "n")
)
