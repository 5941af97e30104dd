"""Item vectors: embedders, reduction, and what users' histories say about items by their vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import CART, PURCHASE, VIEW
from ..plans.registry import REGISTRY
from ..sources.shared import kept
from . import subwords

DIMENSIONS = 20
_READS = ["user_id", "product_id", "product_name", "action_type"]


def embed(items: DataFrame, key: str, text: str, backend: str = "hashing", size: int = 64) -> DataFrame:
    """key and vector (array of doubles): means of word vectors from character n-grams (subwords) or of whole words
    (word2vec), both trained on the items, or hashed word counts (hashing); blank texts give zeros."""
    from pyspark.ml.feature import HashingTF, Word2Vec
    from pyspark.ml.functions import vector_to_array

    words = items.select(key, F.split(F.lower(F.trim(F.coalesce(F.col(text), F.lit("")))), r"\s+").alias("words"))
    if backend == "subwords":
        words = kept(words, "words")
        return subwords.text_vectors(words, key, "words", subwords.trained(words, "words", size))
    if backend == "word2vec":
        model = Word2Vec(vectorSize=size, minCount=1, seed=42, inputCol="words", outputCol="features").fit(words)
        return model.transform(words).select(key, vector_to_array("features").alias("vector"))
    return HashingTF(numFeatures=size, inputCol="words", outputCol="features").transform(words).select(key, vector_to_array("features").alias("vector"))


def reduce(vectors: DataFrame, key: str, size: int = DIMENSIONS) -> DataFrame:
    """The first principal components of centred vectors, all of which they are if there are not more items than that.

    Vectors that are short enough stay as they are. One item alone is its own mean: zeros.
    """
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    first = vectors.head(1)
    if not first or len(first[0]["vector"]) <= size:
        return vectors
    if len(vectors.head(2)) < 2:
        return vectors.select(key, F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.lit(0.0)).alias("vector"))
    dense = vectors.select(key, array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("raw"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="centred").fit(dense).transform(dense)
    return PCA(k=size, inputCol="centred", outputCol="pc").fit(centred).transform(centred).select(key, vector_to_array("pc").alias("vector"))


def item_vectors(h: DataFrame, t: DataFrame, key: str, text: str, config: dict) -> DataFrame:
    """Vectors of all items of both frames; given ones (config["vectors"]) come first."""
    if "vectors" in config and key == "product_id":
        return config["vectors"]
    unknown = "UNKNOWN_CATEGORY" if key == "product_category" else "UNKNOWN_PRODUCT"
    both = h.select(key, F.col(text).alias("text")).union(t.select(key, F.col(text).alias("text")))
    items = both.groupBy(key).agg(F.coalesce(F.min("text"), F.lit(unknown)).alias("text")).filter(F.col(key).isNotNull())
    return reduce(embed(items, key, "text", config.get("embedder", "subwords")), key, config.get("dimensions", DIMENSIONS))


def _embeddings(key: str, text: str, prefix: str):
    columns = [f"{prefix}_embed_{i}" for i in range(DIMENSIONS)]

    def make(h: DataFrame, t: DataFrame, config: dict) -> DataFrame:
        v = item_vectors(h, t, key, text, config)
        out = t.join(v, key, "left")
        return out.withColumns({c: F.coalesce(F.get("vector", F.lit(i)).cast("double"), F.lit(0.0)) for i, c in enumerate(columns)}).drop("vector")

    return columns, make


for _name, _of in {"product_embeddings": ("product_id", "product_name", "product"), "category_embeddings": ("product_category", "product_category", "cat")}.items():
    _columns, _make = _embeddings(*_of)
    REGISTRY.feature(_name, _columns, reads=_of[:2], passes=2)(_make)

_dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
_norm = lambda a: F.sqrt(_dot(a, a))


def unit(a: Column) -> Column:
    """A vector over its length; of one that is next to nothing zeros."""
    return F.transform(F.array(F.struct(a.alias("v"), _norm(a).alias("n"))), lambda x: F.transform(x["v"], lambda y: F.when(x["n"] < 1e-9, 0.0).otherwise(y.cast("double") / x["n"])))[0]


def centres(past: DataFrame, weights: list[str]) -> DataFrame:
    """user_id and for each weight the mean of the user's vectors by it (null without any): sums by place."""
    first = past.select("vector").head(1)
    places = range(len(first[0]["vector"]) if first else 0)
    total = lambda w: F.when(F.sum(w) > 0, F.array(*[F.sum(F.col(w) * F.col("vector")[i].cast("double")) / F.sum(w) for i in places]).cast("array<double>"))
    return past.groupBy("user_id").agg(*[total(w).alias(f"centre_{w}") for w in weights])


SIMILARITY = ["purchase_weighted_similarity", "cart_weighted_similarity", "max_purchase_similarity_history", "max_cart_similarity_history"]


@REGISTRY.feature("user_product_similarity", SIMILARITY, reads=_READS, passes=2)
def user_product_similarity(h: DataFrame, t: DataFrame, config: dict) -> DataFrame:
    """Cosine of an item to the user's weighted mean vector, and the largest to one of the user's items, by purchases and by carts.

    Vectors are brought to unit length once; which items meet is found by their ids, and each pair of items is compared once.
    """
    v = item_vectors(h, t, "product_id", "product_name", config)
    v = kept(v.select("product_id", "vector", unit(F.col("vector")).alias("unit")), "vectors")
    wanted = kept(t.select("user_id", "product_id").distinct().join(v.select("product_id"), "product_id"), "wanted")
    acts = [F.count(F.when(F.col("action_type") == a, 1)).alias(w) for a, w in ((PURCHASE, "buys"), (CART, "carts"))]
    past = h.filter(F.col("action_type").isin(PURCHASE, CART)).groupBy("user_id", "product_id").agg(*acts).join(v.select("product_id"), "product_id")
    past = kept(past, "past")
    met = wanted.join(past.withColumnRenamed("product_id", "past"), "user_id").withColumns({"a": F.least("product_id", "past"), "b": F.greatest("product_id", "past")})
    side = lambda x: v.select(F.col("product_id").alias(x), F.col("unit").alias(f"unit_{x}"))
    pairs = met.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", _dot(F.col("unit_a"), F.col("unit_b")).alias("c"))
    most = lambda w, name: F.max(F.when(F.col(w) > 0, F.col("c"))).alias(name)
    largest = met.join(pairs, ["a", "b"]).groupBy("user_id", "product_id").agg(most("buys", SIMILARITY[2]), most("carts", SIMILARITY[3]))
    centre = centres(past.join(v, "product_id"), ["buys", "carts"])
    near = lambda w, name: _dot(F.col("unit"), unit(F.col(f"centre_{w}"))).alias(name)
    means = wanted.join(centre, "user_id").join(v, "product_id").select("user_id", "product_id", near("buys", SIMILARITY[0]), near("carts", SIMILARITY[1]))
    found = means.join(largest, ["user_id", "product_id"], "left").fillna(0.0, SIMILARITY)
    return t.join(found, ["user_id", "product_id"], "left").fillna(0.0, SIMILARITY)


CLUSTER = ["cluster_purchase_ratio", "cluster_cart_ratio", "cluster_view_ratio"]


def clusters(v: DataFrame, k: int = 15) -> DataFrame:
    """product_id and cluster by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = v.count()
    if not n:
        return v.select("product_id", F.lit(-1).alias("cluster"))
    dense = v.select("product_id", array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("features"))
    if n < 2:
        return v.select("product_id", F.lit(0).alias("cluster"))
    return KMeans(k=min(k, n), seed=42).fit(dense).transform(dense).select("product_id", F.col("prediction").alias("cluster"))


def cluster_ratios(h: DataFrame, labels: DataFrame) -> DataFrame:
    """user_id, cluster and the shares of a user's purchases, carts and views that fall into it."""
    acts = h.join(labels, "product_id")
    aggs = [F.count(F.when(F.col("action_type") == a, 1)).alias(c) for a, c in zip((PURCHASE, CART, VIEW), CLUSTER, strict=True)]
    counts = acts.groupBy("user_id", "cluster").agg(*aggs)
    totals = Window.partitionBy("user_id")
    return counts.select("user_id", "cluster", *[F.coalesce(F.try_divide(F.col(c), F.sum(c).over(totals)), F.lit(0.0)).alias(c) for c in CLUSTER])


@REGISTRY.feature("text_similarity_cluster", CLUSTER, ["product_text_cluster"], reads=_READS, passes=2)
def text_cluster(h: DataFrame, t: DataFrame, config: dict) -> DataFrame:
    labels = config.get("labels") or clusters(item_vectors(h, t, "product_id", "product_name", config))
    out = t.join(labels, "product_id", "left").join(cluster_ratios(h, labels), ["user_id", "cluster"], "left").fillna(0.0, CLUSTER)
    return out.withColumn("product_text_cluster", F.coalesce("cluster", F.lit(-1))).drop("cluster")


@REGISTRY.feature("text_diversity_features", ["distance_from_centroid", "relative_diversity"], reads=_READS, passes=2)
def text_diversity(h: DataFrame, t: DataFrame, config: dict) -> DataFrame:
    """Distance of an item to the centroid of the user's purchases and views, and that over their mean distance."""
    v = item_vectors(h, t, "product_id", "product_name", config)
    past = h.filter(F.col("action_type").isin(PURCHASE, VIEW)).groupBy("user_id", "product_id").agg(F.count("*").alias("n")).join(v, "product_id")
    past = kept(past, "past")
    centre = centres(past, ["n"]).withColumnRenamed("centre_n", "centre")
    apart = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))
    spread = past.join(centre, "user_id").groupBy("user_id").agg(F.try_divide(F.sum(F.col("n") * apart(F.col("vector"), F.col("centre"))), F.sum("n")).alias("diversity"))
    wanted = t.select("user_id", "product_id").distinct().join(v, "product_id").join(centre, "user_id").join(spread, "user_id")
    d = apart(F.col("vector"), F.col("centre"))
    value = F.when(F.col("diversity") > 1e-9, F.try_divide("distance_from_centroid", "diversity")).when(F.col("distance_from_centroid") > 1e-9, F.col("distance_from_centroid")).otherwise(0.0)
    found = wanted.select("user_id", "product_id", "diversity", d.alias("distance_from_centroid")).withColumn("relative_diversity", value).drop("diversity")
    return t.join(found, ["user_id", "product_id"], "left").fillna(0.0, ["distance_from_centroid", "relative_diversity"])
