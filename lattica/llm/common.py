"""What the operators share: the tables, the shared folder, and joins that broadcast only behind a size check."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is broadcast when it has at most so many rows of a few numbers each; beyond it, Spark shuffles.
BROADCAST_ROWS = 1_000_000
#: The part of all rows, as a divisor, from which on a key is hot.
HOT = 1000
#: Rows go to Python workers in batches of so many bytes: texts are long. Small ones are for the pipeline's stages, which share the
#: executors' memory: both sides hold a batch and its copies, and the JVM keeps the room of the largest it has had.
BATCH_BYTES, SMALL_BATCH_BYTES = 1 << 22, 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_cuts: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for held in _cuts:
        held.append(path)
    return path


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Writes df to the shared folder, in folders by some columns, and reads it back: a cut in the lineage that outlives any executor."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_in_buckets(df: DataFrame, name: str, key: str) -> DataFrame:
    """As materialize, in as many buckets by key as there are shuffle partitions: what meets other rows by key is not shuffled again.

    Only tables of the catalog have buckets. The entry goes as soon as the table is resolved; its files are a cut as others are.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    entry = path.rpartition("/")[2].replace("-", "_")
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(entry)
    out = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")
    return out


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders, wherever Spark can reach them."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def cuts_removed(spark: SparkSession):
    """Deletes, at the end, what operators wrote to the shared folder within: for callers that have written the results.

    The driver also collects its garbage, as it does now and then by itself: Spark deletes the shuffle files of plans that are gone.
    """
    held: list[str] = []
    _cuts.append(held)
    try:
        yield
    finally:
        _cuts[:] = [x for x in _cuts if x is not held]
        remove(spark, held)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def released() -> None:
    """Gives memory that is free in this process back to the machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def releasing(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rows; after the work on each, what it freed goes back to the machine."""
    for batch in rows:
        yield batch
        released()


def in_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object, most: int = BATCH_BYTES) -> DataFrame:
    """df.mapInArrow(f, schema) in batches of at most so many bytes, unless the session's own bound is less. What follows in the session keeps that.

    At the end of a task, what it freed goes back to the machine: Python workers outlive their tasks.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(rows)
        finally:
            released()

    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", conf.get(name))) > most:
        conf.set(name, str(most))
    return df.mapInArrow(run, schema)


def sized(df: DataFrame, size: Column | None = None) -> DataFrame:
    """df with a broadcast hint if its counted rows are at most BROADCAST_ROWS, else as it is.

    df should be cheap to count: a written table, or a few columns of one. Where rows hold arrays, size says how many
    values a row has, and their sum is held against the bound.
    """
    if size is None:
        return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_ROWS else df


#: The unique key of a row, where operators carry one.
ROW = "row_key"
#: Bits of the key for the place in a file; those above are for the number of the file.
_PLACE_BITS = 36


def free_name(name: str, taken: list[str]) -> str:
    """name, or it with underscores behind it: none of the taken names, in whatever case."""
    lowered = {c.lower() for c in taken}
    while name.lower() in lowered:
        name += "_"
    return name


def with_row(docs: DataFrame, *columns: Column | str, name: str = ROW) -> DataFrame:
    """The columns of docs (all by default) and `name`, a long that is unique and the same whenever the result is read.

    Rows of Parquet files are named by file and place, which no later read changes. What isn't just such files, such as a
    table in memory or the result of a query, is written to the shared folder with its keys. Columns of any names are kept;
    only `name` itself must be free (see free_name).
    """
    columns = columns or ("*",)
    taken = [*docs.select(*columns).columns, name]
    if free_name(name, taken[:-1]) != name:
        raise ValueError(f"there is a column {name}")
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":
        path, place, file, number = (free_name(x, taken) for x in ("row_file", "row_place", "file", "number"))
        try:
            meta = docs.metadataColumn("_metadata")
            placed = docs.select(*columns, meta["file_path"].alias(path), meta["row_index"].alias(place))
            files = docs.select(meta["file_path"].alias(file)).distinct()
        except AnalysisException:  # not Parquet
            pass
        else:
            numbered = materialize(files.select(file, (F.row_number().over(Window.orderBy(file)) - 1).cast("long").alias(number)), "files")  # a row a file
            rows = placed.join(sized(numbered), F.col(path) == F.col(file))
            return rows.withColumn(name, F.shiftleft(number, _PLACE_BITS) + F.col(place)).drop(path, place, file, number)
    return materialize(docs.select(*columns, F.monotonically_increasing_id().alias(name)), "rows")


def text_or_empty(column: str):
    return F.coalesce(F.col(column), F.lit(""))


def join_hot(left: DataFrame, right: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """left joined with right on key, where right has a row a key and in `size` how many rows of left have it.

    A key is hot if it has more than one HOT-th of the total rows, or, where a row has several keys, of that number; the
    hot ones, HOT times the keys of a row at most, are broadcast, and no key of the other join, which shuffles, is hot.
    """
    hot, rest = right.where(F.col(size) * HOT > total), right.where(F.col(size) * HOT <= total)
    hot_keys = F.broadcast(hot.select(key))
    return left.join(F.broadcast(hot), key).unionByName(left.join(hot_keys, key, "left_anti").join(rest, key))
