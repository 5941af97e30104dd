"""What every model does."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame


class Model(ABC):
    @abstractmethod
    def train(self, df: DataFrame, numeric: list[str], categorical: list[str]) -> Model: ...

    @abstractmethod
    def predict(self, df: DataFrame) -> DataFrame:
        """df with score."""

    def importance(self) -> dict[str, float]:
        return {}
