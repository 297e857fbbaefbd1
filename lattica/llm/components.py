"""Connected components of a table of edges, by labels that spread to neighbours and jump to their labels' labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import materialize, remove, sized


def connected_components(edges: DataFrame) -> DataFrame:
    """id and comp, the least id of the component, for every end of an edge (a, b).

    A round costs three shuffles of ids; hubs are combined before them. Rounds grow with the logarithm of a
    component's longest chain, and each is written to the shared folder.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).where("u != v")
    both = materialize(both.distinct(), "links")
    labels = materialize(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("comp")), "labels")
    while True:
        near = both.join(sized(labels), F.col("u") == F.col("id")).groupBy("v").agg(F.min("comp").alias("near"))
        new = labels.join(near, F.col("id") == F.col("v")).select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("to"))
        jump = labels.select(F.col("id").alias("to"), F.col("comp").alias("beyond"))
        new = new.join(sized(jump), "to").select("id", "old", F.least("to", "beyond").alias("comp"))
        new, before = materialize(new, "labels"), labels
        labels = new.select("id", "comp")
        remove(edges.sparkSession, before.inputFiles())
        if new.where("comp != old").isEmpty():
            return labels
