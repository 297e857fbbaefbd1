"""Trees of named structures as tables (id, parent_id, name, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.trees import along


def subtree(nodes: DataFrame, root: object) -> DataFrame:
    """id and depth of a structure and all below it. An empty result if there is none; a node that is above itself raises.

    A structure has one parent, and the root asked for ends all ways that reach it (see trees.along).
    """
    known = nodes.select("id", F.col("parent_id").alias("above")).distinct()
    is_root = F.col("id") == root
    ways = known.select("id", F.when(~is_root, F.col("above")).alias("up"), F.when(~is_root, 1).otherwise(0).alias("depth"), F.when(is_root, True).alias("hit"))
    found = along(ways, ["id"], "up", sums=["depth"], nearest=["hit"]).where("hit").select("id", "depth").distinct()
    if not known.where(is_root).select(F.col("above").alias("id")).join(found, "id", "left_semi").isEmpty():
        raise ValueError("a node is above itself")
    return found


def find_structure(nodes: DataFrame, name: str | None = None, acronym: str | None = None) -> DataFrame:
    if name is not None:
        return nodes.where(F.lower("name") == name.lower())
    return nodes.where(F.lower("acronym") == (acronym or "").lower())
