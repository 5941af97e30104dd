"""Labels for ranking, and the choice of requests to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import CART, CLICK, PURCHASE, VIEW
from ..plans.registry import REGISTRY


def _case(values: dict[str, float], other: float | None = None) -> Column:
    out = None
    for action, value in values.items():
        out = (F if out is None else out).when(F.col("action_type") == action, F.lit(value))
    return out if other is None else out.otherwise(F.lit(other))


# rows without a request belong to none, so they need not meet in one task
_apart = lambda: F.when(F.col("request_id").isNull(), F.xxhash64("user_id", "product_id", "ts"))
_in_pair = lambda x: F.when(F.col("request_id").isNotNull(), F.max(x).over(Window.partitionBy("request_id", "product_id", _apart())))
_GRADES = {VIEW: 0.0, CART: 0.85, PURCHASE: 1.0, CLICK: 0.3}


def accepted_requests(df: DataFrame, config: dict) -> DataFrame:
    """Requests with enough products, something but views, and rows of accepted sources."""
    some = df.filter(F.col("request_id").isNotNull()).groupBy("request_id").agg(F.countDistinct("product_id").alias("n"), F.max(F.when(F.col("action_type") != VIEW, 1).otherwise(0)).alias("acted"))
    return some.filter((F.col("n") >= config.get("min_unique_products", 3)) & ((F.col("acted") == 1) | F.lit(not config.get("require_action", True)))).select("request_id")


def clean_mask(df: DataFrame, config: dict) -> DataFrame:
    """df with accepted (boolean); rows without a request are not."""
    ok = accepted_requests(df, config).withColumn("request_ok", F.lit(True))
    sources = config.get("accepted_sources")
    source = F.lit(True) if not sources else F.coalesce(F.col("source_type").isin(sources), F.lit(False))
    return df.join(ok, "request_id", "left").withColumn("accepted", F.coalesce("request_ok", F.lit(False)) & source).drop("request_ok")


def cleaned(df: DataFrame, config: dict) -> DataFrame:
    """Nulls labels by the mask: those of rejected rows (keep_accepted, the default), or of accepted ones (reference)."""
    if not config.get("clean_target"):
        return df
    keep = F.col("accepted") if config.get("cleaning_mode", "keep_accepted") == "keep_accepted" else ~F.col("accepted")
    return clean_mask(df, config).withColumn("label", F.when(keep, F.col("label"))).drop("accepted")


@REGISTRY.target("CartUpdate_vs_View")
def cart_vs_view(df: DataFrame, config: dict) -> DataFrame:
    return cleaned(df.withColumn("label", _case({VIEW: 0.0, CART: 1.0})), config)


@REGISTRY.target("CartUpdate_Purchase_vs_View")
def cart_purchase_vs_view(df: DataFrame, config: dict) -> DataFrame:
    return cleaned(df.withColumn("label", _case({VIEW: 0.0, CART: 1.0, PURCHASE: 1.0})), config)


@REGISTRY.target("Weighted")
def weighted(df: DataFrame, config: dict) -> DataFrame:
    return cleaned(df.withColumn("label", _in_pair(_case(_GRADES, 0.0))), config)


@REGISTRY.target("CartUpdate_conversion_aware")
def conversion_aware(df: DataFrame, config: dict) -> DataFrame:
    """Rows without a request are a request of their own here: a product's converted flag is counted, then joined."""
    act = F.col("action_type").isin(CART, PURCHASE, CLICK)
    loose = df.filter(F.col("request_id").isNull()).groupBy("product_id").agg(F.max(act).alias("loose")).toDF("loose_id", "loose")
    joined = df.join(loose, F.col("request_id").isNull() & F.col("product_id").eqNullSafe(F.col("loose_id")), "left")
    converted = F.coalesce("loose", F.max(act).over(Window.partitionBy("request_id", "product_id", _apart())))
    return cleaned(joined.withColumn("label", F.when(act, 1.0).when((F.col("action_type") == VIEW) & ~converted, 0.0)).drop("loose_id", "loose"), config)


@REGISTRY.target("Weighted_InteractionAware")
def interaction_aware(df: DataFrame, config: dict) -> DataFrame:
    positive = F.max(F.col("action_type").isin(CART, PURCHASE, CLICK)).over(Window.partitionBy("request_id", _apart()))
    view = F.when(positive, 0.05).otherwise(0.15)
    value = F.when(F.col("action_type") == VIEW, view).otherwise(_case({CART: 0.85, PURCHASE: 1.0, CLICK: 0.3}, 0.0))
    df = df.withColumn("graded", value)
    return cleaned(df.withColumn("label", _in_pair(F.col("graded"))).drop("graded"), config)


@REGISTRY.target("Weighted_pos_in_req_aware")
def position_aware(df: DataFrame, config: dict) -> DataFrame:
    if "position_in_request" not in df.columns:
        return weighted(df, config)
    weight = F.coalesce(F.try_divide(F.lit(1.0), F.log2(F.col("position_in_request") + 1)), F.lit(0.0))
    return cleaned(df.withColumn("label", _in_pair(_case(_GRADES, 0.0) * weight)), config)
