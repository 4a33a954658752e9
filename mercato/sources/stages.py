"""Stage store (S4, S6): versioned stage tables and models with an atomic
publish step.

A stage is written to a folder of its own version; publishing replaces the
small file ``_current`` that names it, by a rename that overwrites, so a
reader sees the old version or the new one and a job that dies leaves the old
one in place. Stages with a key are bucketed and sorted by it, all with the
same number of buckets, so joins and group-bys on the key need no exchange.
The catalogue entry is made from ``_current`` (schema, key, buckets), so any
later session reads the same buckets.

The fact stage is partitioned by month: ``refresh_months`` rewrites only the
months of the rows given, and readers with a date filter prune the others.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpoint_dir

BUCKET_BYTES = 128 << 20
LEAST_BUCKETS = 8


class StageStore:
    """The stages under one folder of a file system that all executors see."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = LEAST_BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # files ---------------------------------------------------------------------
    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def _read_text(self, path: str) -> str | None:
        fs = self._fs(path)
        if not fs.exists(self._path(path)):
            return None
        stream = fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _replace_text(self, path: str, text: str) -> None:
        """Write beside ``path``, then rename over it in one step."""
        beside = f"{path}.{uuid.uuid4().hex}"
        stream = self._fs(path).create(self._path(beside), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        hadoop = self._jvm.org.apache.hadoop.fs
        options = self._jvm.java.lang.reflect.Array.newInstance(hadoop.Options.Rename.OVERWRITE.getClass(), 1)
        options[0] = hadoop.Options.Rename.OVERWRITE
        source = self._fs(path).makeQualified(self._path(beside))
        hadoop.FileContext.getFileContext(source.toUri(), self._conf).rename(source, self._fs(path).makeQualified(self._path(path)), options)

    # versions --------------------------------------------------------------------
    def current(self, name: str) -> dict | None:
        text = self._read_text(f"{self.root}/{name}/_current")
        return json.loads(text) if text else None

    def _publish(self, name: str, entry: dict) -> None:
        self._replace_text(f"{self.root}/{name}/_current", json.dumps(entry))

    def versions(self, name: str) -> list[str]:
        fs, folder = self._fs(self.root), self._path(f"{self.root}/{name}")
        if not fs.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory())

    def prune(self, name: str) -> None:
        """Delete all versions but the current one."""
        entry = self.current(name) or {}
        for version in self.versions(name):
            if version != entry.get("version"):
                self._fs(self.root).delete(self._path(f"{self.root}/{name}/{version}"), True)

    # tables ------------------------------------------------------------------------
    def write(self, name: str, df: DataFrame, key: str | None = None, source: str = "", partition_by: str | None = None) -> DataFrame:
        """Write a version of ``name``, publish it, read it back. With ``key``
        the table is bucketed and sorted by it; ``source`` says what it was
        made from."""
        version = f"v{uuid.uuid4().hex}"
        path = f"{self.root}/{name}/{version}"
        if key:
            # one task per bucket: the same hash deals the rows and names the bucket
            (df.repartition(self.buckets, key).write.format("parquet").option("path", path)
             .bucketBy(self.buckets, key).sortBy(key).saveAsTable(self._table(name, version)))
        elif partition_by:
            df.hint("rebalance", partition_by).write.partitionBy(partition_by).parquet(path)
        else:
            df.write.parquet(path)
        self._publish(name, {"version": version, "key": key, "buckets": self.buckets if key else 0, "source": source,
                             "partition": partition_by, "schema": df.schema.json()})
        return self.read(name)

    @staticmethod
    def _table(name: str, version: str) -> str:
        return f"stage_{name}_{version}"

    def read(self, name: str) -> DataFrame:
        """The published version."""
        entry = self.current(name)
        if entry is None:
            raise FileNotFoundError(f"stage {name!r} is not published under {self.root}")
        path = f"{self.root}/{name}/{entry['version']}"
        if not entry["key"]:
            return self.spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).parquet(path)
        table = self._table(name, entry["version"])
        if not self.spark.catalog.tableExists(table):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(entry["schema"])))
            key, n = entry["key"], entry["buckets"]
            self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
                           f"INTO {n} BUCKETS LOCATION '{path}'")
        return self.spark.table(table)

    def refresh_months(self, name: str, rows: DataFrame, column: str = "month") -> DataFrame:
        """Replace the months that ``rows`` has in a month-partitioned stage
        (``rows`` holds those months whole); other months' files stay."""
        entry = self.current(name)
        path = f"{self.root}/{name}/{entry['version']}"
        (rows.hint("rebalance", column).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(column).parquet(path))
        self.spark.catalog.refreshByPath(path)
        return self.read(name)

    # models ------------------------------------------------------------------------
    def write_model(self, name: str, model: PipelineModel, source: str = "") -> PipelineModel:
        version = f"v{uuid.uuid4().hex}"
        model.write().save(f"{self.root}/{name}/{version}")
        self._publish(name, {"version": version, "source": source})
        return self.read_model(name)

    def read_model(self, name: str) -> PipelineModel:
        entry = self.current(name)
        if entry is None:
            raise FileNotFoundError(f"model {name!r} is not published under {self.root}")
        return PipelineModel.load(f"{self.root}/{name}/{entry['version']}")

    # built once ------------------------------------------------------------------
    def ensure(self, name: str, source: str, build: Callable[[], DataFrame], key: str | None = None,
               partition_by: str | None = None) -> DataFrame:
        """The stage, written first unless the published one was made from
        the same ``source``."""
        entry = self.current(name)
        if entry is None or entry["source"] != source or entry.get("buckets") not in (0, self.buckets):
            return self.write(name, build(), key, source, partition_by)
        return self.read(name)

    def ensure_model(self, name: str, source: str, fit: Callable[[], PipelineModel]) -> PipelineModel:
        entry = self.current(name)
        if entry is None or entry["source"] != source:
            return self.write_model(name, fit(), source)
        return self.read_model(name)


def input_state(spark: SparkSession, sf_dir: str, tables: list[str]) -> tuple[str, int]:
    """A digest of the files of the input tables (path, length, time of
    change) and their bytes: stages made from other files are rebuilt."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen, size = [], 0
    for name in tables:
        for file in sorted(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").inputFiles()):
            path = jvm.org.apache.hadoop.fs.Path(file)
            status = path.getFileSystem(conf).getFileStatus(path)
            seen.append(f"{file}:{status.getLen()}:{status.getModificationTime()}")
            size += status.getLen()
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()[:16], size


def store_for(spark: SparkSession, sf_dir: str, tables: list[str], root: str | None = None) -> tuple[StageStore, str]:
    """The store of an input folder, under the shared checkpoint folder unless
    ``root`` names another, and the state of the input. Buckets hold about
    ``BUCKET_BYTES`` of the input each."""
    state, size = input_state(spark, sf_dir, tables)
    folder = hashlib.sha256(sf_dir.rstrip("/").encode()).hexdigest()[:16]
    buckets = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))
    return StageStore(spark, root or f"{checkpoint_dir(spark).rstrip('/')}/stages/{folder}", buckets), state


def with_month(df: DataFrame, date: str) -> DataFrame:
    return df.withColumn("month", F.trunc(date, "MM"))
