"""A model: an immutable bag of named tables and parameters, saved as Parquet and JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Model:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    params: dict[str, Any] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    def with_tables(self, **tables: DataFrame) -> Model:
        return Model({**self.tables, **tables}, self.params)

    def with_params(self, **params: Any) -> Model:
        return Model(self.tables, {**self.params, **params})

    def without(self, *names: str) -> Model:
        return Model({k: v for k, v in self.tables.items() if k not in names}, self.params)

    def merged(self, other: Model) -> Model:
        """Tables of both; those that both have are united over the columns that they share."""
        out = dict(self.tables)
        for k, v in other.tables.items():
            if k in out:
                both = [c for c in out[k].columns if c in v.columns]
                v = out[k].select(both).unionByName(v.select(both))
            out[k] = v
        return Model(out, {**self.params, **other.params})

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{path}/tables/{name}")
        meta = json.dumps({"tables": sorted(self.tables), "params": self.params})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str, only: list[str] | None = None) -> Model:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        names = [n for n in meta["tables"] if only is None or n in only]
        return Model({n: spark.read.parquet(f"{path}/tables/{n}") for n in names}, meta["params"])
