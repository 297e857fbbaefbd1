"""Batches of edits of branches: a log of them is applied to all trees at once, and what is left is numbered anew.

An edit is a row (morph_name, op, branch_id, point_id, other, part) by the numbers before any edit:

| op | what it does |
|-|-|
| insert | a point between point_id and the next, at `part` of the way; radius between, labels of the point before |
| split | the branch ends at point_id; what comes after is a branch that hangs on it and starts with a copy of the point |
| detach | the branch becomes a root |
| attach | the branch hangs on branch `other`, in place of where it hung |

Points are inserted before branches are split; a split at a branch's first or last point does nothing. Children of a split branch, and
branches attached to it, hang on its last part. Attaching a branch below itself raises where trees are walked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.morphology import KEYS
from lattica.operators.spatial import AXES

LOG = "morph_name string, op string, branch_id int, point_id int, other int, part double"


def edited(points: DataFrame, branches: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """points and branches after a log of edits. Branches are numbered by their old number and part; rows that repeat an edit count once.

    Cost: a window along branches, and joins by branch; the log may name any number of trees.
    """
    log = log.distinct()
    along = Window.partitionBy(*KEYS).orderBy("point_id")
    inserts = log.where("op = 'insert'").select(*KEYS, "point_id", "part")
    after = {c: F.lead(c).over(along) for c in (*AXES, "radius")}
    new = points.withColumns({f"_n{c}": v for c, v in after.items()}).join(inserts, [*KEYS, "point_id"]).where(F.col("_nx").isNotNull())
    between = {c: F.col(c) + F.col("part") * (F.col(f"_n{c}") - F.col(c)) for c in (*AXES, "radius")}
    new = new.withColumns(between).select(*KEYS, "point_id", "part", *AXES, "radius", "labels")
    every = points.select(*KEYS, "point_id", F.lit(0.0).alias("part"), *AXES, "radius", "labels").unionByName(new)
    # A cut lies on an old point; what stands before it in the branch, and whether any follows, says if it does anything.
    cuts = log.where("op = 'split'").select(*KEYS, "point_id", F.lit(0.0).alias("part"), F.lit(1).alias("_cut"))
    order = Window.partitionBy(*KEYS).orderBy("point_id", "part")
    every = every.join(cuts, [*KEYS, "point_id", "part"], "left").withColumns({"_nth": F.row_number().over(order), "_of": F.count(F.lit(1)).over(Window.partitionBy(*KEYS))})
    every = every.withColumn("_cut", F.when((F.col("_nth") > 1) & (F.col("_nth") < F.col("_of")), F.coalesce("_cut", F.lit(0))).otherwise(0))
    before = F.coalesce(F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = every.withColumn("_section", before)
    copies = every.where("_cut = 1").withColumn("_section", F.col("_section") + 1).withColumn("_copy", F.lit(0))
    every = every.withColumn("_copy", F.lit(1)).unionByName(copies)
    sections = every.groupBy(*KEYS).agg((F.max("_section") + 1).alias("sections"))
    base = F.coalesce(F.sum("sections").over(Window.partitionBy("morph_name").orderBy("branch_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbers = sections.withColumn("base", base)
    inside = Window.partitionBy(*KEYS, "_section").orderBy("_copy", "point_id", "part")
    out = every.join(numbers, KEYS).withColumns({"_point": (F.row_number().over(inside) - 1).cast("int"), "_branch": (F.col("base") + F.col("_section")).cast("int")})
    out = out.select("morph_name", F.col("_branch").alias("branch_id"), F.col("_point").alias("point_id"), *AXES, "radius", "labels", F.col("branch_id").alias("src_branch"))
    moved = log.where("op in ('detach', 'attach')").select(*KEYS, F.lit(True).alias("_moved"), F.when(F.col("op") == "attach", F.col("other")).alias("_to"))
    moved = moved.groupBy(*KEYS).agg(F.max("_moved").alias("_moved"), F.max("_to").alias("_to"))
    tree = branches.select(*KEYS, "parent_branch").join(moved, KEYS, "left").withColumn("parent_branch", F.when(F.col("_moved"), F.col("_to")).otherwise(F.col("parent_branch")))
    last = numbers.select("morph_name", F.col("branch_id").alias("parent_branch"), (F.col("base") + F.col("sections") - 1).cast("int").alias("_last"))
    tree = tree.join(numbers, KEYS).join(last, ["morph_name", "parent_branch"], "left").withColumn("_section", F.explode(F.sequence(F.lit(0), (F.col("sections") - 1).cast("int"))))
    above = F.when(F.col("_section") > 0, F.col("base") + F.col("_section") - 1).otherwise(F.col("_last")).cast("int")
    return out, tree.select("morph_name", (F.col("base") + F.col("_section")).cast("int").alias("branch_id"), above.alias("parent_branch"))
