"""Versioned state of micro-batches in the shared folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from editwake import session


class VersionedState:
    """Tables and small values after each micro-batch; the highest published mark names the valid version.

    A batch that is delivered again after a failure finds its number there and is left out, so each batch counts once.
    The last two versions are kept, the others removed.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        said = session.published(spark, self.path)
        self.meta: dict = json.loads(said[1]) if said else {"version": 0, "batch": -1}

    def has(self, batch: int) -> bool:
        return batch <= self.meta["batch"]

    def folder(self, name: str) -> str:
        """Where a table of the valid version lies."""
        return f"{self.path}/v{self.meta['version']}/{name}"

    def table(self, name: str, schema) -> DataFrame:
        if not self.meta["version"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.folder(name))

    def commit(self, batch: int, tables: dict[str, DataFrame], **values) -> None:
        version = self.meta["version"] + 1
        base = f"{self.path}/v{version}"
        session.remove(self.spark, base)  # what a batch that died half-way left
        for name, df in tables.items():
            df.write.parquet(f"{base}/{name}")
        meta = {"version": version, "batch": batch, **values}
        session.publish(self.spark, self.path, version, json.dumps(meta))
        self.meta = meta
        session.remove(self.spark, f"{self.path}/v{version - 2}")

    def append(self, batch: int, names: dict[str, str]) -> None:
        """Copies tables of batch `batch`, the last one committed, to <folder>/batch=<batch>, as often as asked.

        Called again for a batch delivered again, so that a failure between the commit and the copy loses nothing.
        """
        if batch != self.meta["batch"]:
            return
        for name, folder in names.items():
            self.spark.read.parquet(self.folder(name)).write.mode("overwrite").parquet(f"{folder}/batch={batch}")
