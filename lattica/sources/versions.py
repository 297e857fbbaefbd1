"""Cells and connections as sets of live files: a version is a table of files, and the next one takes its place at once.

Writers add files and say which older ones still count; nothing that a reader may be reading is changed, and a job that
dies leaves the version before it. Rows lie along a Z-order curve of their chunks, cells by one and connections by both of
theirs, and each file's bounds on all coordinates stand in the version. So scans from either side, and what is cleared
by chunk, open only files whose bounds hold a chunk that is asked for. The driver sees a row a file that is read, never a row of theirs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lattica.functions.chunks import chunk_coordinates, curve
from lattica.operators.spatial import any_box_join
from lattica.sources.cuts import cut, dropped

#: Of each table, the column that groups its rows, and those that hold chunks.
TABLES = {"cells": ("cell_type", ["chunk_id"]), "connections": ("tag", ["pre_chunk", "post_chunk"])}
_FILES = "table string, path string, rows long, first string, last string, low array<int>, high array<int>, columns string"


#: Files that one write makes at most.
MOST_FILES = 1000


class Versions:
    """The live files under a root. file_rows is about how many rows a file gets; more, where that would make over MOST_FILES files of a write."""

    def __init__(self, spark: SparkSession, root: str, file_rows: int = 1_000_000):
        self.spark, self.root, self.file_rows = spark, root, file_rows
        self._staged: str | None = None
        self._open = False

    def _at(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}" if path else self.root)

    def _fs(self):
        return self._at("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        if not self._fs().exists(self._at("live")):
            return []
        return sorted(int(f.getPath().getName()[2:]) for f in self._fs().listStatus(self._at("live")) if f.getPath().getName().startswith("v-"))

    def files(self, table: str) -> DataFrame:
        """The live files of a table."""
        path = self._staged or next((f"live/v-{n:09d}" for n in reversed(self._numbers())), None)
        live = self.spark.read.schema(_FILES).parquet(f"{self.root}/{path}") if path else self.spark.createDataFrame([], _FILES)
        return live.where(F.col("table") == table)

    def _commit(self, table: str, files: DataFrame) -> None:
        """files become the live ones of a table: at once, or when the transaction ends."""
        every = files
        for other in TABLES:
            if other != table:
                every = every.unionByName(self.files(other))
        staged = f"live/staged-{uuid.uuid4().hex}"
        every.coalesce(1).write.parquet(f"{self.root}/{staged}")
        self._staged = staged
        if not self._open:
            self._publish()

    def _publish(self) -> None:
        target = self._at(f"live/v-{max(self._numbers(), default=0) + 1:09d}")
        if self._fs().exists(target) or not self._fs().rename(self._at(self._staged), target):
            raise RuntimeError("another writer was first")
        self._staged = None

    @contextmanager
    def transaction(self) -> Iterator[None]:
        """All writes within become one version at its end; if it fails, none counts. Reads within see them."""
        if self._open:
            yield
            return
        before, self._open = self._numbers(), True
        try:
            yield
            if self._staged:
                if self._numbers() != before:
                    raise RuntimeError("another writer was first")
                self._publish()
        finally:
            self._open, self._staged = False, None

    def _written(self, table: str, rows: DataFrame) -> DataFrame:
        """New files of rows, laid out along the curve, as rows of a version."""
        group, chunks = TABLES[table]
        raw = cut(rows, "incoming")
        n = raw.count()
        folder = f"{table}/{uuid.uuid4().hex}"
        if not n:
            return self.spark.createDataFrame([], _FILES)
        order = [F.col(group), curve(*(F.col(c) for c in chunks))]
        raw.repartitionByRange(min(n // self.file_rows + 1, MOST_FILES), *order).sortWithinPartitions(*order).write.parquet(f"{self.root}/{folder}")
        at = [v for c in chunks for v in chunk_coordinates(F.col(c))]
        stored = self.spark.read.schema(raw.schema).parquet(f"{self.root}/{folder}").select("*", F.col("_metadata.file_name").alias("_file"))
        stats = stored.groupBy("_file").agg(F.count(F.lit(1)).alias("rows"), F.min(group).alias("first"), F.max(group).alias("last"), F.array(*map(F.min, at)).alias("low"), F.array(*map(F.max, at)).alias("high"))
        out = stats.select(F.lit(table).alias("table"), F.concat(F.lit(f"{folder}/"), "_file").alias("path"), "rows", "first", "last", "low", "high", F.lit(raw.schema.json()).alias("columns"))
        out = cut(out, "file-bounds")
        dropped(raw)
        return out

    def append(self, table: str, rows: DataFrame) -> None:
        self._commit(table, self.files(table).unionByName(self._written(table, rows)))

    def touched(self, table: str, keys: dict[str, list | DataFrame]) -> DataFrame:
        """The live files that may have rows with the keys: lists of values, or for chunks also a DataFrame of one column."""
        group, chunks = TABLES[table]
        files = self.files(table)
        for key, values in keys.items():
            if key == group:
                asked = self.spark.createDataFrame([(v,) for v in values], "v string")
                files = files.join(F.broadcast(asked), F.col("v").between(F.col("first"), F.col("last")), "left_semi")
            elif key in chunks:
                asked = values.toDF("v") if isinstance(values, DataFrame) else self.spark.createDataFrame([(v,) for v in values], "v long")
                at, k = chunk_coordinates(F.col("v")), 3 * chunks.index(key)
                asked = asked.distinct().select(*(a.cast("double").alias(f"{side}{c}") for a, c in zip(at, "xyz", strict=True) for side in "lh"))
                boxes = files.where(F.col("low")[k].isNotNull()).select("path", *(F.col(name)[k + i].cast("double").alias(f"{side}{c}") for i, c in enumerate("xyz") for side, name in (("l", "low"), ("h", "high"))))
                files = files.join(any_box_join(boxes, asked, 1.0).select("a.path").distinct(), "path", "left_semi")
            else:
                raise ValueError(f"{table} has no key {key}")
        return files

    @staticmethod
    def match(keys: dict[str, list | DataFrame]) -> Column:
        out = F.lit(True)
        for key, values in keys.items():
            if not isinstance(values, DataFrame):
                out = out & F.col(key).isin(values)
        return out

    def read(self, table: str, **keys: object) -> DataFrame:
        """The rows that have the keys; files whose bounds exclude these are not opened."""
        keys = {k: v if isinstance(v, (list, DataFrame)) else [v] for k, v in keys.items() if v is not None}
        files = self.touched(table, keys).select("path", "columns").collect()  # a row a file
        if not files:
            known = self.files(table).select("columns").first()
            if known is None:
                raise FileNotFoundError(f"{self.root} has no {table}")
            return self.spark.createDataFrame([], StructType.fromJson(_json(known[0])))
        rows = self._opened([f.path for f in files], {f.columns for f in files}).where(self.match(keys))
        for key, values in keys.items():
            if isinstance(values, DataFrame):
                rows = rows.join(values.toDF(key).distinct(), key, "left_semi").select(rows.columns)
        return rows

    def _opened(self, paths: list[str], columns: set[str]) -> DataFrame:
        schema = StructType()
        for one in sorted(columns, key=len, reverse=True):
            for field in StructType.fromJson(_json(one)).fields:
                if field.name not in schema.names:
                    schema = schema.add(field.name, field.dataType)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{p}" for p in paths))

    def clear(self, table: str, **keys: object) -> None:
        """Drops a table's rows that have the keys, all without any. Files that hold others too are written anew without these."""
        keys = {k: v if isinstance(v, list) else [v] for k, v in keys.items()}
        gone = cut(self.touched(table, keys), "touched")
        rest = self.files(table).join(F.broadcast(gone.select("path")), "path", "left_anti").select(self.files(table).columns)
        files = gone.select("path", "columns").collect() if keys else []
        if files:
            kept = self._opened([f.path for f in files], {f.columns for f in files}).where(~F.coalesce(self.match(keys), F.lit(False)))
            rest = rest.unionByName(self._written(table, kept))
        self._commit(table, rest)

    def rewrite(self, table: str, rows: DataFrame, **keys: object) -> None:
        """rows in place of those that have the keys, in one version."""
        new = self._written(table, rows)
        with self.transaction():
            self.clear(table, **keys)
            self._commit(table, self.files(table).unionByName(new))

    def vacuum(self) -> None:
        """Deletes older versions, and files that are not live. Not while others read these."""
        fs, numbers = self._fs(), self._numbers()
        for table in TABLES:
            live = {r.path.rsplit("/", 1)[0] for r in self.files(table).select("path").collect()}
            for folder in fs.listStatus(self._at(table)) if fs.exists(self._at(table)) else []:
                if f"{table}/{folder.getPath().getName()}" not in live:
                    fs.delete(folder.getPath(), True)
        for f in fs.listStatus(self._at("live")) if numbers else []:
            if f.getPath().getName() != f"v-{numbers[-1]:09d}":
                fs.delete(f.getPath(), True)


def _json(text: str) -> dict:
    import json

    return json.loads(text)
