"""Points and edges from CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.chunks import chunk_of
from lattica.operators.connectivity import edges_of


def read_csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """All columns as text, their names without white space around and in lower case."""
    df = spark.read.csv(path, header=True, sep=delimiter)
    return df.toDF(*(c.strip().lower() for c in df.columns))


def number(column: str):
    """A DOUBLE; NaN for what is none."""
    return F.coalesce(F.trim(F.col(f"`{column}`")).try_cast("double"), F.lit(float("nan")))


def points_from_csv(raw: DataFrame, chunk_size: float, cell_type: str | None = None) -> DataFrame:
    """cell_type, chunk_id, x, y, z and `extra`, a map of the other columns as numbers, from columns x, y, z[, type].

    Rows without a usable place are in no chunk (null). With cell_type given, only its rows are taken if there is a type.
    """
    others = [c for c in raw.columns if c not in ("x", "y", "z", "type")]
    extra = F.map_from_arrays(F.array(*(F.lit(c) for c in others)), F.array(*(number(c) for c in others))) if others else F.create_map().cast("map<string,double>")
    kind = F.trim("type") if "type" in raw.columns else F.lit(cell_type)
    out = raw.select(kind.alias("cell_type"), *(number(c).alias(c) for c in "xyz"), extra.alias("extra"))
    if cell_type is not None:
        out = out.where(F.col("cell_type") == cell_type)
    placed = ~F.isnan(F.col("x") + F.col("y") + F.col("z"))
    return out.withColumn("chunk_id", F.when(placed, chunk_of(*(F.when(placed, F.col(c)).otherwise(0.0) for c in "xyz"), chunk_size)))


def _id(column: str):
    """A whole number from a number's text; -1 for what is none."""
    return F.coalesce(F.floor(F.trim(F.col(column)).try_cast("double")).try_cast("long"), F.lit(-1).cast("long"))


def edges_from_csv(raw: DataFrame, pre: DataFrame | None = None, post: DataFrame | None = None) -> DataFrame:
    """Edges between whole cells from columns pre and post; rows with a bad or negative number are left out.

    With pre and post given (tables of `id` and `key`), the numbers are keys that are looked up; unknown keys are
    left out too.
    """
    ids = raw.select(_id("pre").alias("a"), _id("post").alias("b")).where("a >= 0 and b >= 0")
    for side, cells in (("a", pre), ("b", post)):
        if cells is not None:
            known = cells.select(F.col("key").cast("long").alias("_k"), F.col("id").alias("_id"))
            ids = ids.join(known, F.col(side) == F.col("_k")).withColumn(side, F.col("_id")).drop("_k", "_id")
    return edges_of(ids, F.col("a"), F.col("b"))


def read_swc(spark: SparkSession, path: str) -> DataFrame:
    """The rows of SWC files, named by file: morph_name, sample, tag, x, y, z, radius, parent. `#` starts a comment."""
    raw = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("morph_name"), F.split(F.trim(F.regexp_replace("value", "#.*$", "")), r"\s+").alias("f"))
    names = [("sample", "int"), ("tag", "int"), ("x", "double"), ("y", "double"), ("z", "double"), ("radius", "double"), ("parent", "int")]
    return raw.where(F.size("f") >= 7).select("morph_name", *(F.col("f")[i].cast(t).alias(n) for i, (n, t) in enumerate(names)))
