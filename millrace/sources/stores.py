"""Small keyed stores (runs, experiments, history) as parquet tables replaced as a whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reporting import upsert


class KeyedStore:
    """Rows by key under one path; each change writes a new version and then drops the old one."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, order: str):
        self.spark, self.path, self.schema, self.key, self.order = spark, path.rstrip("/"), schema, key, order

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[str]:
        _, p, fs = self._fs()
        if not fs.exists(p):
            return []
        found = [str(s.getPath().getName()) for s in fs.listStatus(p)]
        done = [n for n in found if n.startswith("v") and fs.exists(p.suffix(f"/{n}/_SUCCESS"))]
        return sorted(done)

    def read(self) -> DataFrame:
        """All rows; a store that is not there or can't be read is empty."""
        have = self._versions()
        if not have:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{have[-1]}")

    def _replace(self, df: DataFrame) -> None:
        jvm, p, fs = self._fs()
        old = self._versions()
        number = int(old[-1][1:13]) + 1 if old else 0
        df.write.parquet(f"{self.path}/v{number:012d}-{uuid.uuid4().hex[:8]}")
        for name in old:
            fs.delete(p.suffix(f"/{name}"), True)

    def record(self, rows: DataFrame) -> None:
        """Insert, or replace rows of the same key."""
        self._replace(upsert(self.read(), rows, self.key))

    def list(self, limit: int | None = None) -> DataFrame:
        """Newest first; at most ``limit`` rows if given."""
        out = self.read().orderBy(F.desc_nulls_last(self.order), self.key)
        return out if limit is None else out.limit(limit)

    def get(self, key) -> DataFrame:
        return self.read().where(F.col(self.key) == key)

    def delete(self, key) -> bool:
        """Remove a row; whether there was one."""
        if self.get(key).isEmpty():
            return False
        self._replace(self.read().where(F.col(self.key) != key))
        return True
