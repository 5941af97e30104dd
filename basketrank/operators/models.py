"""Models that score rows: MLlib trees, trees that rank within requests, and baselines."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import kept
from .base import Model
from .boosting import GroupRanker
from .encoding import encoded, ordered, statistics


def _write_line(values: dict, path: str) -> None:
    """One JSON line as a text file at a path that Spark can write."""
    SparkSession.active().createDataFrame([(json.dumps(values),)], "value string").coalesce(1).write.mode("overwrite").text(path)


class RandomModel(Model):
    def __init__(self, seed: int = 42):
        self.seed = seed

    def train(self, df, numeric, categorical):
        return self

    def predict(self, df):
        return df.withColumn("score", F.rand(self.seed))


class SingleFeatureModel(Model):
    """The score is a feature; missing values get the smallest one."""

    def __init__(self, feature: str, desc: bool = True):
        self.feature, self.desc, self.least = feature, desc, None

    def train(self, df, numeric, categorical):
        if self.feature not in df.columns:
            raise ValueError(f"no column {self.feature}")
        self.least = df.agg(F.min(self._value())).first()[0]
        return self

    def _value(self):
        value = F.col(f"`{self.feature}`").cast("double")
        return F.when(~F.isnan(value), value)

    def predict(self, df):
        score = F.coalesce(self._value(), F.lit(self.least))
        return df.withColumn("score", score if self.desc else -score)

    def importance(self):
        return {self.feature: 1.0}

    def save(self, path: str) -> None:
        _write_line({"feature": self.feature, "desc": self.desc, "least": self.least}, f"{path}/feature")

    @staticmethod
    def load(path: str) -> SingleFeatureModel:
        made = json.loads(SparkSession.active().read.text(f"{path}/feature").first()[0])
        model = SingleFeatureModel(made["feature"], made["desc"])
        model.least = made["least"]
        return model


class TreeModel(Model):
    """Gradient-boosted trees of MLlib: a classifier of labels over a half, or (rank) a pointwise regressor on graded labels.

    Categories of any number of values become ordered target statistics, in an order of the unique idx if df has one.
    """

    def __init__(self, rank: bool = False, iterations: int = 20, depth: int = 5, seed: int = 42):
        self.rank, self.iterations, self.depth, self.seed, self.fitted = rank, iterations, depth, seed, None

    def _ready(self, df):
        columns = [*self.numeric, *[f"{c}__stat" for c in self.categorical]]
        return df.withColumns({f"x{i}__filled": F.nanvl(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(-1e9)), F.lit(-1e9)) for i, c in enumerate(columns)})

    def train(self, df, numeric, categorical):
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import GBTRegressor

        self.numeric, self.categorical = list(numeric), list(categorical)
        kind = GBTRegressor if self.rank else GBTClassifier
        tree = kind(maxIter=self.iterations, maxDepth=self.depth, maxBins=128, seed=self.seed, featuresCol="features", labelCol="y")
        label = F.col("label").cast("double") if self.rank else (F.col("label") > 0.5).cast("double")
        df = df.withColumn("y", label)
        self.mean, self.found = 0.0, None
        if self.categorical:
            self.mean = df.agg(F.avg("y")).first()[0] or 0.0
            self.found = kept(statistics(df, self.categorical, "y"), "statistics")
            # without an idx rows are in the order in which they are written
            df = df if "idx" in df.columns else kept(df.withColumn("idx", F.monotonically_increasing_id()), "numbered")
            df = ordered(df, self.categorical, "y", self.mean, seed=self.seed)
        assembled = VectorAssembler(inputCols=[f"x{i}__filled" for i in range(len(self.numeric + self.categorical))], outputCol="features")
        self.fitted = Pipeline(stages=[assembled, tree]).fit(self._ready(df))
        return self

    def predict(self, df):
        from pyspark.ml.functions import vector_to_array

        missing = [c for c in self.numeric + self.categorical if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns {missing}")
        out = self.fitted.transform(self._ready(encoded(df, self.categorical, self.found, self.mean)))
        score = F.col("prediction") if self.rank else vector_to_array("probability")[1]
        return out.select(*df.columns, score.alias("score"))

    def importance(self):
        values = self.fitted.stages[-1].featureImportances.toArray()
        return dict(zip(self.numeric + self.categorical, map(float, values), strict=True))

    def save(self, path: str) -> None:
        """The fitted stages, and beside them what they were fitted with."""
        made = {k: getattr(self, k) for k in ("rank", "iterations", "depth", "seed", "numeric", "categorical", "mean")}
        self.fitted.write().overwrite().save(f"{path}/stages")
        _write_line(made, f"{path}/columns")
        _write_line(self.importance(), f"{path}/importance")
        if self.found is not None:
            self.found.write.mode("overwrite").parquet(f"{path}/statistics")

    @staticmethod
    def load(path: str) -> TreeModel:
        from pyspark.ml import PipelineModel

        made = json.loads(SparkSession.active().read.text(f"{path}/columns").first()[0])
        model = TreeModel(made["rank"], made["iterations"], made["depth"], made["seed"])
        model.numeric, model.categorical, model.mean = made["numeric"], made["categorical"], made["mean"]
        model.found = SparkSession.active().read.parquet(f"{path}/statistics") if model.categorical else None
        model.fitted = PipelineModel.load(f"{path}/stages")
        return model


def top_importance(model: Model, n: int = 20) -> list[tuple[str, float]]:
    """The columns that matter most to a model, most first; of equals the first by name."""
    return sorted(model.importance().items(), key=lambda x: (-x[1], x[0]))[:n]


MODELS = {
    "random": RandomModel, "single_feature": SingleFeatureModel, "classifier": TreeModel,
    "ranker": GroupRanker, "pointwise_ranker": lambda **x: TreeModel(rank=True, **x),
}


def create(config: dict) -> Model:
    kind = config["type"]
    if kind not in MODELS:
        raise ValueError(f"unknown model {kind}")
    return MODELS[kind](**config.get("config", {}))
