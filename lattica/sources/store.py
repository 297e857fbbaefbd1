"""A network on disk: cells and connections in versions of live files, morphologies and files as Parquet, partitioned as they are read."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lattica.sources.versions import TABLES, Versions

PARTITIONS = {"morpho_points": ["morph_name"], "morpho_branches": ["morph_name"], "files": ["id"], "spikes": [], "signals": []}


class NetworkStore:
    """Tables under a root folder. Scans of one type, chunk, tag or name open only the files that may hold it."""

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False, file_rows: int = 1_000_000):
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only
        self.versions = Versions(spark, self.root, file_rows)

    def _path(self, table: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}" if table else self.root)

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _writable(self) -> None:
        if self.read_only:
            raise PermissionError("this network is open for reading only")

    def transaction(self):
        """Writes of cells and connections within it count together, at its end, or, if it fails, not at all."""
        return self.versions.transaction()

    def exists(self, table: str = "") -> bool:
        if table in TABLES:
            return not self.versions.files(table).isEmpty()
        return self._fs().exists(self._path(table))

    def holds(self, table: str) -> bool:
        """Whether a table has any partition or file."""
        if table in TABLES:
            return self.exists(table)
        return self.exists(table) and any(not f.getPath().getName().startswith(("_", ".")) for f in self._fs().listStatus(self._path(table)))

    def read(self, table: str, **keys: object) -> DataFrame:
        """A table; of cells and connections the rows with some keys, as cell_type="a" or post_chunk=[0, 1]."""
        if table in TABLES:
            return self.versions.read(table, **keys)
        if not self.exists(table):
            raise FileNotFoundError(f"{self.root} has no {table}")
        path = f"{self.root}/{table}"
        found = self.spark.read.parquet(path).schema
        names = {"morph_name", *PARTITIONS.get(table, [])}  # these are text, whatever a folder's name looks like
        kinds = StructType([StructField(f.name, StringType() if f.name in names else f.dataType) for f in found.fields])
        return self.spark.read.schema(kinds).parquet(path)

    def append(self, table: str, rows: DataFrame) -> None:
        self._writable()
        if table in TABLES:
            self.versions.append(table, rows)
            return
        keys = PARTITIONS[table]
        # One task a partition folder, or several where it is large: AQE splits what is skewed.
        (rows.hint("rebalance", *keys) if keys else rows).write.mode("append").partitionBy(*keys).parquet(f"{self.root}/{table}")

    def replace(self, table: str, rows: DataFrame) -> None:
        """Overwrites the partitions that rows has, and no others."""
        self._writable()
        keys = PARTITIONS[table]
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{self.root}/{table}")

    def clear(self, table: str, **keys: object) -> None:
        """Drops a table, or the rows with these keys: of cells and connections any of type, tag and chunks, as
        post_chunk=[0, 1]; of other tables leading ones."""
        self._writable()
        if table in TABLES:
            self.versions.clear(table, **keys)
            return
        path = "/".join([table, *(f"{k}={keys[k]}" for k in PARTITIONS[table] if k in keys)])
        self._fs().delete(self._path(path), True)

    def tags(self) -> list[str]:
        return sorted(r.tag for r in self.read("connections").select("tag").distinct().collect()) if self.exists("connections") else []

    def connections(self, tag: str, local: list[int] | None = None, remote: list[int] | None = None, incoming: bool = False) -> DataFrame:
        """Connections of a tag, those of some local and remote chunks: local ones are of the pre side or, with incoming, the post side.

        Either way only files are opened whose bounds on the side asked for hold one of the chunks.
        """
        own, other = ("post_chunk", "pre_chunk") if incoming else ("pre_chunk", "post_chunk")
        return self.read("connections", tag=tag, **{own: local, other: remote})

    def connections_between(self, pre_type: str, post_type: str) -> str:
        """The tag of the one connectivity set between two cell types; none or several raise."""
        found = self.read("connections").where((F.col("pre_type") == pre_type) & (F.col("post_type") == post_type)) if self.exists("connections") else None
        tags = [] if found is None else sorted(r.tag for r in found.select("tag").distinct().collect())
        if len(tags) != 1:
            raise LookupError(f"{len(tags)} connectivity sets from {pre_type} to {post_type}")
        return tags[0]

    def append_additional(self, cell_type: str, name: str, values: DataFrame) -> None:
        """A further column of a type's cells, from (chunk_id, local_id, value). Each cell needs one value; others raise, and nothing changes."""
        self._writable()
        cells = self.read("cells", cell_type=cell_type)
        if name in cells.columns:
            cells = cells.drop(name)
        given = values.select("chunk_id", "local_id", F.col("value").alias(name), F.lit(True).alias("_given"))
        n, lost = cells.count(), cells.select("chunk_id", "local_id").join(given, ["chunk_id", "local_id"], "left_anti").count()
        if lost or given.count() != n:
            raise ValueError(f"{name} needs one value for each of {n} cells of {cell_type}")
        self.versions.rewrite("cells", cells.join(given, ["chunk_id", "local_id"]).drop("_given"), cell_type=cell_type)

    def remove(self) -> None:
        self._writable()
        self._fs().delete(self._path(""), True)

    def copy(self, to: str) -> NetworkStore:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(to)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        jvm.org.apache.hadoop.fs.FileUtil.copy(self._fs(), self._path(""), target.getFileSystem(conf), target, False, conf)
        return NetworkStore(self.spark, to)

    def move(self, to: str) -> NetworkStore:
        self._writable()
        self._fs().rename(self._path(""), self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to))
        return NetworkStore(self.spark, to)

    # Files: small named contents with metadata.

    def put_file(self, name: str, content: bytes, meta: dict[str, str] | None = None, encoding: str | None = None) -> None:
        """Stores or replaces a file. Each has a folder of its own, so no other is read or written."""
        self._writable()
        row = self.spark.createDataFrame([(name, bytearray(content), meta or {}, time.time(), encoding)], "id string, content binary, meta map<string,string>, mtime double, encoding string")
        self.replace("files", row)

    def has_file(self, name: str) -> bool:
        return self.exists("files") and not self.read("files").where(F.col("id") == name).isEmpty()

    def get_file(self, name: str) -> Row:
        """A file's id, content, meta, mtime and encoding."""
        row = self.read("files").where(F.col("id") == name).first() if self.exists("files") else None
        if row is None:
            raise FileNotFoundError(name)
        return row

    def remove_file(self, name: str) -> None:
        self._writable()
        if not self.has_file(name):
            raise FileNotFoundError(name)
        for path in self.read("files").where(F.col("id") == name).inputFiles():
            self._fs().delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent(), True)

    def clear_type(self, cell_type: str) -> None:
        """Drops a cell type's cells, and all connections that have it on a side, together."""
        self._writable()
        with self.transaction():
            if self.holds("connections"):
                has = self.read("connections").where((F.col("pre_type") == cell_type) | (F.col("post_type") == cell_type))
                tags = [r.tag for r in has.select("tag").distinct().collect()]  # a tag has one pair of types
                if tags:
                    self.clear("connections", tag=tags)
            self.clear("cells", cell_type=cell_type)

    def find_files(self, **meta: str) -> DataFrame:
        files = self.read("files")
        for k, v in meta.items():
            files = files.where(F.element_at("meta", k) == v)
        return files

    def save_configuration(self, tree: dict) -> None:
        self.put_file("configuration", json.dumps(tree).encode(), {"active_config": "true"}, "utf-8")

    def load_configuration(self) -> dict:
        row = self.find_files(active_config="true").select("content").first()
        if row is None:
            raise FileNotFoundError("no configuration is stored")
        return json.loads(bytes(row.content))


def open_store(spark: SparkSession, root: str, read_only: bool = False) -> NetworkStore:
    """The network at root; raises if there is none, or if what is there is no network."""
    store = NetworkStore(spark, root, read_only)
    if not store.exists():
        raise FileNotFoundError(root)
    if not any(store.exists(t) for t in ("live", *PARTITIONS)):
        raise ValueError(f"{root} is no network")
    return store
