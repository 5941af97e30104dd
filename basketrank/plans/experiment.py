"""Train, evaluate and submit from one configuration."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import basic, cf, metrics, models, selection, targets, text  # noqa: F401  they register themselves
from ..sources.interactions import epoch_to_timestamp, write_submission
from . import split
from .config import Config
from .logs import logger
from .registry import REGISTRY


def write_json(spark: SparkSession, values: dict, path: str) -> None:
    """One JSON document at a path that Spark can write."""
    spark.createDataFrame([(json.dumps(values),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """The document at a path, None if there is none."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    return json.loads(spark.read.text(path).first()[0])


def compared(one: dict[str, float], other: dict[str, float]) -> list[tuple[str, float, float, float | None]]:
    """Metrics that two runs share, by name, with the change from the other to the one in percent (None from zero)."""
    rows = [(k, one[k], other[k]) for k in sorted(one.keys() & other.keys()) if one[k] is not None and other[k] is not None]
    return [(k, a, b, 100 * (a - b) / abs(b) if b else None) for k, a, b in rows]


class Experiment:
    """preprocess: what is done to the log before it is split (epoch columns become instants by default)."""

    def __init__(self, config: Config, name: str = "experiment", preprocess: Callable[[DataFrame], DataFrame] = lambda df: epoch_to_timestamp(df, "ts") if dict(df.dtypes).get("ts") in ("bigint", "double") else df):
        self.config, self.name, self.preprocess = config, name, preprocess
        self.model, self.columns, self.log = None, [], logger(name)

    def _names(self) -> list[str]:
        return self.config.get("features")

    def _declared(self) -> tuple[list[str], list[str]]:
        some = [REGISTRY.features[n] for n in self._names()]
        return list(dict.fromkeys(c for f in some for c in f.numeric)), list(dict.fromkeys(c for f in some for c in f.categorical))

    def _selected(self, batch: DataFrame, numeric: list[str], importance: dict[str, float]) -> list[str]:
        """Columns that selection keeps; looked up by what they depend on if feature_selection.cache names a folder."""
        threshold, folder = self.config.get("feature_selection.threshold"), self.config.get("feature_selection.cache")
        if folder:
            key = Config({"columns": numeric, "importance": importance, "threshold": threshold, "features": self._names(), "generators": self.config.get("generators", {}), "rows": batch.count()}).hash()
            path = f"{folder}/selected-{key}"
            if (found := read_json(batch.sparkSession, path)) is not None:
                return found["columns"]
        corr = {(r.a, r.b): r["corr"] for r in selection.correlations(batch, numeric).collect()}
        kept = selection.select(numeric, corr, importance, threshold)
        if folder:
            write_json(batch.sparkSession, {"columns": kept}, path)
        return kept

    def train(self, history: DataFrame, target: DataFrame) -> None:
        batch = REGISTRY.batch(history, target, self._names(), self.config.get("target"), self.config.get("generators", {})).persist()
        try:
            self._fit(batch)
        finally:
            batch.unpersist()

    def _fit(self, batch: DataFrame) -> None:
        numeric, categorical = self._declared()
        if importance := self.config.get("feature_selection.importance"):
            kept = self._selected(batch, numeric, importance)
            self.log.info("%d of %d columns are kept", len(kept), len(numeric))
            numeric = kept
        self.columns = numeric + categorical
        self.model = models.create(self.config.get("model")).train(batch, numeric, categorical)

    def evaluate(self, history: DataFrame, target: DataFrame, k: int = 10) -> dict[str, float]:
        batch = REGISTRY.batch(history, target, self._names(), self.config.get("target"), self.config.get("generators", {}))
        scored = self.model.predict(batch).persist()
        try:
            two = metrics.binarize(scored, "label")
            return {
                "ndcg": metrics.ndcg(scored, "request_id", "label", "score", k).first()[0], "auc": metrics.auc(two, "label", "score").first()[0],
                "logloss": metrics.log_loss(two, "label", "score").first()[0],
            }
        finally:
            scored.unpersist()

    def run(self, log: DataFrame) -> dict[str, float]:
        """Metrics on the holdout if there is one, else on the last days; with output.folder also written there with the importances and the configuration."""
        log = self.preprocess(log)
        days, held = self.config.get("data.target_days"), self.config.get("data.holdout_days")
        rest, last = split.holdout(log, held) if held else (log, None)
        history, target, before, validation = split.train(rest, days)
        self.train(history, target)
        found = self.evaluate(rest, last) if held else self.evaluate(before, validation)
        self.log.info("metrics %s", found)
        if folder := self.config.get("output.folder"):
            spark = log.sparkSession
            write_json(spark, {"name": self.name, "config": self.config.hash(), "metrics": found, "importance": dict(models.top_importance(self.model))}, f"{folder}/{self.name}_results")
            write_json(spark, self.config.as_dict(), f"{folder}/{self.name}_config")
        return found

    def submission(self, log: DataFrame, test: DataFrame) -> DataFrame:
        """index and request_id of test rows, best score first; with output.folder also written there with the model and the configuration."""
        log, test = self.preprocess(log), self.preprocess(test)
        history, target = split.timewise(log, self.config.get("data.target_days"))
        self.train(history, target)
        scored = self.model.predict(REGISTRY.features_of(log, test, self._names(), self.config.get("generators", {})))
        out = scored.orderBy(F.desc("score"), "idx").select(F.col("idx").alias("index"), "request_id")
        if folder := self.config.get("output.folder"):
            write_submission(out, f"{folder}/{self.name}_submission")
            self.model.save(f"{folder}/{self.name}_model")
            write_json(log.sparkSession, self.config.as_dict(), f"{folder}/{self.name}_submission_config")
        return out
