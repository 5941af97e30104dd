"""Feature and target generators by name, with their columns and dependencies."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Generator = Callable[[DataFrame, DataFrame, dict], DataFrame]


@dataclass(frozen=True)
class Feature:
    name: str
    make: Generator
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    depends_on: tuple[str, ...] = ()
    #: columns of the log that the generator reads (None: any); how often it reads history
    reads: tuple[str, ...] | None = None
    passes: int = 1


@dataclass
class Registry:
    features: dict[str, Feature] = field(default_factory=dict)
    targets: dict[str, Callable[[DataFrame, dict], DataFrame]] = field(default_factory=dict)

    def feature(self, name: str, numeric=(), categorical=(), depends_on=(), reads=None, passes=1):
        def add(make: Generator) -> Generator:
            if name in self.features:
                raise ValueError(f"feature {name} is registered already")
            columns = {c for f in self.features.values() for c in f.numeric + f.categorical}
            if clash := columns & ({*numeric, *categorical} - {"source_type", "city_name"}):
                raise ValueError(f"columns {sorted(clash)} belong to another feature")
            self.features[name] = Feature(name, make, tuple(numeric), tuple(categorical), tuple(depends_on), None if reads is None else tuple(reads), passes)
            return make

        return add

    def target(self, name: str):
        def add(make):
            if name in self.targets:
                raise ValueError(f"target {name} is registered already")
            self.targets[name] = make
            return make

        return add

    def order(self, names: list[str]) -> list[str]:
        """Names with what they depend on before them, each once; cycles and unknown names raise."""
        out: list[str] = []

        def visit(name: str, above: tuple[str, ...]) -> None:
            if name in above:
                raise ValueError("cycle: " + " -> ".join([*above, name]))
            if name not in self.features:
                raise ValueError(f"unknown feature {name}")
            if name not in out:
                for d in self.features[name].depends_on:
                    visit(d, (*above, name))
                out.append(name)

        for n in names:
            visit(n, ())
        return out

    def log_columns(self, names: list[str]) -> list[str] | None:
        """The columns of the log that the named features and those they depend on read, ts first; None if one may read any."""
        some = [self.features[n].reads for n in self.order(names)]
        return None if None in some else list(dict.fromkeys(["ts", *[c for reads in some for c in reads]]))

    def passes(self, names: list[str]) -> int:
        """How often the named features and those they depend on read history."""
        return sum(self.features[n].passes for n in self.order(names))

    def features_of(self, history: DataFrame, target: DataFrame, names: list[str], config: dict | None = None) -> DataFrame:
        """The target's columns and those that the named features declare, in the order asked for."""
        if len(set(names)) < len(names):
            raise ValueError("a feature is asked for twice")
        out = target
        for name in self.order(names):
            out = self.features[name].make(history, out, config or {})
        columns = [c for n in names for c in self.features[n].numeric + self.features[n].categorical]
        return out.select(*target.columns, *[c for c in dict.fromkeys(columns) if c not in target.columns])

    def batch(self, history: DataFrame, target: DataFrame, names: list[str], label: str | dict, config: dict | None = None) -> DataFrame:
        """Features with the label; rows whose label is null or NaN are left out."""
        labelled = self.labelled(target, label, config)
        return self.features_of(history, labelled, names, config).filter(F.col("label").isNotNull() & ~F.isnan("label"))

    def labelled(self, target: DataFrame, label: str | dict, config: dict | None = None) -> DataFrame:
        name = label["name"] if isinstance(label, dict) else label
        if name not in self.targets:
            raise ValueError(f"unknown target {name}")
        return self.targets[name](target, config or {})


REGISTRY = Registry()
