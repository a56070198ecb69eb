"""Stage results as keyed Parquet tables, and small artifacts as JSON, in a work folder that all executors reach."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        path, fs = self._path(name)
        return fs.exists(path)

    def save(self, name: str, df: DataFrame, by: str | None = None) -> DataFrame:
        w = df.write.mode("overwrite").option("compression", "zstd")
        (w.partitionBy(by) if by else w).parquet(f"{self.folder}/{name}")
        return self.load(name)

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def gather(self, name: str, keys: DataFrame) -> DataFrame:
        """Rows of a table whose key columns are among keys."""
        return self.load(name).join(keys, list(keys.columns), "left_semi")

    def save_json(self, name: str, value) -> None:
        path, fs = self._path(name)
        out = fs.create(path, True)
        try:
            out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=1, sort_keys=True).encode()))
        finally:
            out.close()

    def load_json(self, name: str, default=None):
        if not self.has(name):
            return default
        path, fs = self._path(name)
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def report(self, **entries) -> None:
        """Adds entries to report.json."""
        self.save_json("report.json", {**self.load_json("report.json", {}), **entries})
