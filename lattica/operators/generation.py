"""Morphologies that are grown: a keyed branching process, a generation a round, each written before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.keyed import keyed_uniform
from lattica.operators.derived import contents
from lattica.operators.spatial import AXES
from lattica.sources.cuts import cut, dropped


def grow(keys: DataFrame, generations: int, points: int = 4, step: float = 10.0, split: float = 0.7, thinner: float = 0.8, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Points and branches (see operators.morphology) of one tree for each `key`; morph_name is the key as text.

    A branch goes `points` - 1 steps of a keyed direction from its parent's end, a root from 0. It then splits in two, thinner ones, with the
    probability `split`, until there are so many generations. Branches are numbered like a binary heap: the children of i are 2 i + 1 and 2 i + 2.
    Every choice is a hash of seed, key and branch, so a tree is the same wherever and whenever it is grown.
    """
    if not 0 < generations <= 30 or points < 2:
        raise ValueError("between 1 and 30 generations, of branches of two points or more")
    name = keys.select(F.col("key").cast("string").alias("morph_name")).distinct()
    tips = name.select("morph_name", F.lit(0).alias("branch_id"), F.lit(None).cast("int").alias("parent_branch"), *(F.lit(0.0).alias(c) for c in AXES), F.lit(1.0).alias("radius"))
    grown = []
    for generation in range(generations):
        tips = tips.withColumns({f"d{c}": (2 * keyed_uniform(f"{seed}-{c}", "morph_name", "branch_id") - 1) * F.lit(float(step)) for c in AXES})
        tips = cut(tips, "generation")
        grown.append(tips)
        if generation + 1 < generations:
            on = tips.where(keyed_uniform(f"{seed}-split", "morph_name", "branch_id") < split)
            ends = {c: F.col(c) + (points - 1) * F.col(f"d{c}") for c in AXES}
            kids = on.withColumns(ends).withColumn("kid", F.explode(F.array(F.lit(1), F.lit(2))))
            tips = kids.select("morph_name", (2 * F.col("branch_id") + F.col("kid")).alias("branch_id"), F.col("branch_id").alias("parent_branch"), *AXES, (F.col("radius") * thinner).alias("radius"))
    every = grown[0]
    for part in grown[1:]:
        every = every.unionByName(part)
    every = cut(every, "grown")
    for part in grown:
        dropped(part)
    on = every.withColumn("point_id", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    label = F.when(F.col("parent_branch").isNull(), "soma").otherwise("dendrites")
    out = on.select("morph_name", "branch_id", "point_id", *((F.col(c) + F.col("point_id") * F.col(f"d{c}")).alias(c) for c in AXES), "radius", F.array(label).alias("labels"))
    return out, every.select("morph_name", "branch_id", "parent_branch")


def generated(cells: DataFrame, key: str, prefix: str, **growth: object) -> tuple[DataFrame, DataFrame, DataFrame]:
    """cells with morph_name, and the points and branches of the morphologies grown for them, each content once.

    Cells of one key have one tree; trees of the same content are one morphology. They are numbered by their least key: prefix-0, prefix-1 and so on.
    """
    points, branches = grow(cells.select(F.col(key).alias("key")), **growth)
    same = contents(points, branches)
    first = same.where("morph_name = same").select("same", F.concat(F.lit(f"{prefix}-"), (F.row_number().over(Window.orderBy("same")) - 1).cast("string")).alias("name"))  # a row a morphology
    names = cut(same.join(first, "same").select(F.col("morph_name").alias("_key"), "name", (F.col("morph_name") == F.col("same")).alias("first")), "generated-names")
    kept = names.where("first").select(F.col("_key").alias("morph_name"), "name")
    renamed = lambda df: df.join(kept, "morph_name").withColumn("morph_name", F.col("name")).drop("name")
    named = cells.join(names.select("_key", F.col("name").alias("morph_name")), F.col(key).cast("string") == F.col("_key")).drop("_key")
    return named, renamed(points), renamed(branches)
