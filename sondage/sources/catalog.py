"""Datasets as Parquet folders with a small table of what they are: lineage, not pickles."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "dataset_id string, filename string, source string, parent_id string, journal array<string>, created_at double, n_rows long, n_columns int, names map<string,string>"


class UnknownDataset(KeyError):
    """An identifier that the catalog doesn't hold."""


class Catalog:
    """Datasets below one folder. Writing is by the output committer, so a dataset is there whole or not at all."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, dataset_id: str) -> str:
        return f"{self.root}/data/{dataset_id}"

    def _entries(self) -> DataFrame:
        path = f"{self.root}/entries"
        if not self._exists(path):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).json(path)

    def _exists(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def save(self, df: DataFrame, filename: str, parent_id: str | None = None, journal: list[str] = (), names: dict[str, str] | None = None) -> str:
        dataset_id = uuid.uuid4().hex
        df.write.parquet(self._path(dataset_id))
        n = self.spark.read.parquet(self._path(dataset_id)).count()
        row = (dataset_id, filename, "derived" if parent_id else "upload", parent_id, list(journal), time.time(), n, len(df.columns), names or {})
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.json(f"{self.root}/entries/{dataset_id}")
        return dataset_id

    def exists(self, dataset_id: str) -> bool:
        return self._exists(self._path(dataset_id))

    def load(self, dataset_id: str) -> DataFrame:
        if not self.exists(dataset_id):
            raise UnknownDataset(dataset_id)
        return self.spark.read.parquet(self._path(dataset_id))

    def describe(self, dataset_id: str) -> dict:
        if not self.exists(dataset_id):
            raise UnknownDataset(dataset_id)
        return json.loads(self.spark.read.schema(SCHEMA).json(f"{self.root}/entries/{dataset_id}").toJSON().first())

    def entries(self) -> DataFrame:
        """All datasets, the newest first."""
        path = f"{self.root}/entries/*" if self._exists(f"{self.root}/entries") else None
        found = self.spark.read.schema(SCHEMA).json(path) if path else self._entries()
        return found.orderBy(F.desc("created_at"))

    def lineage(self, dataset_id: str) -> list[str]:
        """The dataset and its ancestors, the nearest first."""
        out = []
        while dataset_id:
            out.append(dataset_id)
            dataset_id = self.describe(dataset_id).get("parent_id")
        return out

    def delete(self, dataset_id: str) -> None:
        if not self.exists(dataset_id):
            raise UnknownDataset(dataset_id)
        self._delete(self._path(dataset_id))
        self._delete(f"{self.root}/entries/{dataset_id}")

    def save_keys(self, keys: DataFrame, dataset_id: str) -> None:
        """Pseudonym keys of one dataset, apart from those of others."""
        keys.withColumn("dataset_id", F.lit(dataset_id)).write.mode("append").partitionBy("dataset_id").parquet(f"{self.root}/keys")

    def keys(self, dataset_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/keys").where(F.col("dataset_id") == dataset_id).drop("dataset_id")
