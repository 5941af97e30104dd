"""Reading interaction logs, and the two logs that the given tables make."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .files import Folder

EVENT_LOG = """
WITH e AS (
  SELECT event_id, ts, user_id, event_type, CAST({json} AS BIGINT) AS product_id, event_id % 10 AS store_id,
         CASE WHEN event_id % 50 = 0 THEN NULL ELSE user_id * 1000 + dayofyear(ts) END AS request_id
  FROM {events})
SELECT e.event_id AS idx, CAST(e.request_id AS BIGINT) AS request_id, e.user_id, e.product_id,
       CASE WHEN e.product_id % 37 = 0 THEN NULL ELSE p.p_type END AS product_category,
       p.p_name AS product_name, CAST(e.store_id AS BIGINT) AS store_id, n.n_name AS city_name,
       concat('ST_', CAST(e.event_id % 4 AS STRING)) AS source_type,
       CASE e.event_type WHEN 'view' THEN 'AT_View' WHEN 'click' THEN 'AT_Click'
                         WHEN 'signup' THEN 'AT_CartUpdate' WHEN 'purchase' THEN 'AT_Purchase' ELSE 'AT_Other' END AS action_type,
       CASE WHEN e.request_id IS NOT NULL THEN CAST(row_number() OVER (
         PARTITION BY e.request_id, CASE WHEN e.request_id IS NULL THEN e.event_id END ORDER BY e.ts, e.event_id) AS DOUBLE) END AS position_in_request, e.ts AS ts
FROM e JOIN {part} p ON p.p_partkey = e.product_id
       JOIN {supplier} s ON s.s_suppkey = e.store_id
       JOIN {nation} n ON n.n_nationkey = s.s_nationkey"""

ORDER_LOG = """
SELECT l_orderkey AS request_id, o_custkey AS user_id, l_partkey AS product_id, p_type AS product_category,
       p_name AS product_name, l_suppkey AS store_id, n_name AS city_name, o_orderpriority AS source_type,
       CASE WHEN l_returnflag = 'R' THEN 'AT_Purchase' WHEN l_returnflag = 'A' THEN 'AT_CartUpdate'
            WHEN l_quantity < 10 THEN 'AT_Click' ELSE 'AT_View' END AS action_type,
       CAST(l_linenumber AS DOUBLE) AS position_in_request, l_shipdate AS ts
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey
              JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey"""


def scan(spark: SparkSession, path: str) -> DataFrame:
    """A parquet log; FileNotFoundError if there is none at the path."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise


def _named(spark: SparkSession, sf_dir: str, *tables: str) -> dict[str, DataFrame]:
    return {t: scan(spark, f"{sf_dir}/{t}.parquet") for t in tables}


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as interactions: time of day, sessions, nullable request and category, a unique idx. Without a request there is no position in it."""
    return spark.sql(EVENT_LOG.format(json="get_json_object(props, '$.k')", events="{events}", part="{part}", supplier="{supplier}", nation="{nation}"), **_named(spark, sf_dir, "events", "part", "supplier", "nation"))


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as interactions over years; rows may repeat."""
    return spark.sql(ORDER_LOG, **_named(spark, sf_dir, "lineitem", "orders", "part", "supplier", "nation"))


def epoch_to_timestamp(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """An epoch column as a timestamp; a largest value over 10^12 means milliseconds. Nulls stay null; without the column: unchanged."""
    if column not in df.columns:
        return df
    largest = df.agg(F.max(F.abs(F.col(f"`{column}`")))).first()[0]
    at = F.col(f"`{column}`")
    return df.withColumn(column, F.timestamp_millis(at) if largest is not None and largest > 1e12 else F.timestamp_seconds(at))


def write_submission(df: DataFrame, path: str) -> None:
    """index and request_id as one CSV file with a header, in the order of df.

    A globally sorted df has its ranges in the order of its partitions; tasks write them side by side, and the files are joined.
    """
    base, _, name = path.rstrip("/").rpartition("/")
    parts = f"{name}-{uuid.uuid4().hex}"
    df.select("index", "request_id").write.csv(f"{base}/{parts}", header=False)
    folder = Folder(df.sparkSession, base or ".")
    folder.remove(name)
    # a part's name begins with the number of its partition
    folder.whole(name, [f"{parts}/{p}" for p in sorted(folder.lengths(parts)) if p.startswith("part-")], "index,request_id\n")
    folder.remove(parts)
