"""Finished runs by their id, below the shared folder: their tables, and what they found as JSON. A run that is kept leaves no other table behind."""

from __future__ import annotations

import dataclasses
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfspan.sources import shared


class Catalogue:
    """Runs of a dataclass whose fields are frames (or None) and values that JSON holds.

    A run is visible once its last file, the facts, is written; an id that is kept again replaces the earlier run. Ids are letters, digits, `-` and `_`.
    """

    def __init__(self, spark: SparkSession, kind: type, folder: str | None = None):
        self.spark, self.kind = spark, kind
        self.folder = folder or f"{shared.shared_folder(spark)}/runs"

    def _path(self, run_id: str) -> str:
        if not re.fullmatch("[A-Za-z0-9_-]+", run_id):
            raise ValueError(f"not a run id: {run_id!r}")
        return f"{self.folder}/{run_id}"

    def keep(self, run_id: str, make: Callable[[], object]) -> object:
        """Makes a run, writes its frames and facts, deletes what was stored on the way and returns the run as it is read back."""
        path = self._path(run_id)
        with shared.working(self.spark):
            run = make()
            shared.delete(self.spark, path)
            facts = {}
            for f in dataclasses.fields(run):
                value = getattr(run, f.name)
                if isinstance(value, DataFrame):
                    value.write.parquet(f"{path}/{f.name}")
                    facts[f.name] = {"table": value.schema.jsonValue()}
                else:
                    facts[f.name] = {"value": dataclasses.asdict(value) if dataclasses.is_dataclass(value) else value}
            self.spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.text(f"{path}/facts")
        return self.get(run_id)

    def get(self, run_id: str) -> object | None:
        """A run, or None if there is none of this id."""
        path = self._path(run_id)
        if not shared.exists(self.spark, f"{path}/facts/_SUCCESS"):
            return None
        from pyspark.sql import types as T

        facts = json.loads(self.spark.read.text(f"{path}/facts").first()[0])
        values = {n: self.spark.read.schema(T.StructType.fromJson(f["table"])).parquet(f"{path}/{n}") if "table" in f else f["value"] for n, f in facts.items()}
        run = self.kind(**values)
        for f in dataclasses.fields(run):
            if dataclasses.is_dataclass(default := f.default_factory() if f.default_factory is not dataclasses.MISSING else f.default) and isinstance(values.get(f.name), dict):
                setattr(run, f.name, type(default)(**values[f.name]))
        return run

    def ids(self) -> list[str]:
        return [i for i in shared.children(self.spark, self.folder) if shared.exists(self.spark, f"{self.folder}/{i}/facts/_SUCCESS")]

    def expire(self, run_id: str) -> None:
        shared.delete(self.spark, self._path(run_id))
