"""Tables of cells and connections: chunk statistics, identifiers, filters and set operations on them.

cells: cell_type, chunk_id, local_id, x, y, z, ... ; connections: tag, pre_type, post_type, pre_chunk, pre_local,
pre_branch, pre_point and the same for post. -1 as branch and point stands for a cell as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.labels import has_any

NONE = -1
#: The columns of stored connections.
CONNECTION = ["tag", *(f"{s}_{c}" for s in ("pre", "post") for c in ("type", "chunk", "local", "branch", "point"))]


def with_local_ids(cells: DataFrame, order: list[str], stored: DataFrame | None = None) -> DataFrame:
    """cells with local_id, the rank from 0 in their type's chunk, after the cells that `stored` statistics count there."""
    w = Window.partitionBy("cell_type", "chunk_id").orderBy(*order)
    out = cells.withColumn("local_id", (F.row_number().over(w) - 1).cast("int"))
    if stored is None:
        return out
    before = stored.select("cell_type", "chunk_id", F.col("n").alias("_before"))
    out = out.join(before, ["cell_type", "chunk_id"], "left")
    return out.withColumn("local_id", (F.col("local_id") + F.coalesce("_before", F.lit(0))).cast("int")).drop("_before")


def chunk_stats(cells: DataFrame) -> DataFrame:
    return cells.groupBy("cell_type", "chunk_id").agg(F.count(F.lit(1)).alias("n"))


def chunk_offsets(stats: DataFrame, only: list[int] | None = None) -> DataFrame:
    """The rows before each chunk in order of chunk number; with `only`, as if there were no other chunks.

    stats has a row a chunk, so the window is small however many cells there are.
    """
    if only is not None:
        stats = stats.where(F.col("chunk_id").isin(only))
    w = Window.partitionBy("cell_type").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    return stats.withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0)))


def with_global_ids(cells: DataFrame, only: list[int] | None = None) -> DataFrame:
    """cells with cell_id, their rank in their type over all (or the chosen) chunks."""
    offsets = chunk_offsets(chunk_stats(cells), only).select("cell_type", "chunk_id", "offset")
    return cells.join(offsets, ["cell_type", "chunk_id"]).withColumn("cell_id", F.col("offset") + F.col("local_id")).drop("offset")


def placement(cells: DataFrame, cell_type: str | None = None, chunks: list[int] | None = None, labels: list[str] | None = None) -> DataFrame:
    """A scan with the three filters of a placement set; type and chunk prune partitions."""
    if cell_type is not None:
        cells = cells.where(F.col("cell_type") == cell_type)
    if chunks is not None:
        cells = cells.where(F.col("chunk_id").isin(chunks))
    return cells if labels is None else cells.where(has_any(F.col("labels"), labels))


def connections(edges: DataFrame, tag: str | None = None, from_chunks: list[int] | None = None, to_chunks: list[int] | None = None, incoming: bool = False) -> DataFrame:
    """A scan of edges. Local chunks are those of the pre side, or with incoming=True those of the post side."""
    local, remote = ("post_chunk", "pre_chunk") if incoming else ("pre_chunk", "post_chunk")
    if tag is not None:
        edges = edges.where(F.col("tag") == tag)
    if from_chunks is not None:
        edges = edges.where(F.col(local).isin(from_chunks))
    return edges if to_chunks is None else edges.where(F.col(remote).isin(to_chunks))


def global_connections(edges: DataFrame, pre_stats: DataFrame, post_stats: DataFrame) -> DataFrame:
    """edges with pre_id and post_id, ranks over all chunks, from the chunks' statistics."""
    for side, stats in (("pre", pre_stats), ("post", post_stats)):
        offsets = chunk_offsets(stats).select(F.col("cell_type").alias(f"{side}_type"), F.col("chunk_id").alias(f"{side}_chunk"), "offset")
        edges = edges.join(offsets, [f"{side}_type", f"{side}_chunk"]).withColumn(f"{side}_id", F.col("offset") + F.col(f"{side}_local")).drop("offset")
    return edges


def scoped_connections(edges: DataFrame, pre_stats: DataFrame, post_stats: DataFrame, pre_chunks: list[int] | None = None, post_chunks: list[int] | None = None) -> DataFrame:
    """The edges between the chosen chunks, with pre_id and post_id, ranks over the chosen chunks alone."""
    for side, chunks in (("pre", pre_chunks), ("post", post_chunks)):
        if chunks is not None:
            edges = edges.where(F.col(f"{side}_chunk").isin(chunks))
    within = lambda stats, chunks: stats if chunks is None else stats.where(F.col("chunk_id").isin(chunks))
    return global_connections(edges, within(pre_stats, pre_chunks), within(post_stats, post_chunks))


def connected(edges: DataFrame, cells: DataFrame, tag: str, pre_type: str, post_type: str) -> DataFrame:
    """Connections to store of edges whose pre_id and post_id are ranks in the cell types (cell_id of with_global_ids).

    Each rank becomes a chunk and a place in it, by an equi-join a side; a rank that the type doesn't have raises.
    """
    out = edges.withColumns({"tag": F.lit(tag), "pre_type": F.lit(pre_type), "post_type": F.lit(post_type)})
    ranked = with_global_ids(cells.select("cell_type", "chunk_id", "local_id"))
    for side, kind in (("pre", pre_type), ("post", post_type)):
        own = ranked.where(F.col("cell_type") == kind).select(F.col("cell_id").alias(f"{side}_id"), F.col("chunk_id").alias(f"{side}_chunk"), F.col("local_id").alias(f"{side}_local"))
        lost = F.raise_error(F.lit(f"an edge's {side} side is no cell of {kind}")).cast("long")
        out = out.join(own, f"{side}_id", "left").withColumn(f"{side}_chunk", F.coalesce(f"{side}_chunk", lost))
    return out.select(*CONNECTION)


def chunk_connected(edges: DataFrame, tag: str, pre_type: str, post_type: str, pre_chunk: int, post_chunk: int) -> DataFrame:
    """Connections to store of edges whose pre_id and post_id are places in one pre and one post chunk."""
    fixed = {"tag": F.lit(tag), "pre_type": F.lit(pre_type), "post_type": F.lit(post_type), "pre_chunk": F.lit(pre_chunk).cast("long"), "post_chunk": F.lit(post_chunk).cast("long")}
    return edges.withColumns(fixed | {"pre_local": F.col("pre_id").cast("int"), "post_local": F.col("post_id").cast("int")}).select(*CONNECTION)


def directed(edges: DataFrame, direction: str | None = None, local: int | None = None, remote: int | None = None) -> DataFrame:
    """Edges by direction ('out' with the pre side as local, 'inc' with the post side), local_chunk and global_chunk.

    Given values fix an axis. Sorted by all three, the rows come block by block, as loops over directions, local and
    global chunks would give them; grouped by them, a block is a group.
    """
    if direction not in (None, "inc", "out"):
        raise ValueError("a direction is 'inc' or 'out'")
    out = None
    for name, (own, other) in (("inc", ("post", "pre")), ("out", ("pre", "post"))):
        if direction in (None, name):
            part = edges.select(F.lit(name).alias("direction"), F.col(f"{own}_chunk").alias("local_chunk"), F.col(f"{other}_chunk").alias("global_chunk"), "*")
            out = part if out is None else out.unionByName(part)
    for column, value in (("local_chunk", local), ("global_chunk", remote)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out


def block_stats(edges: DataFrame) -> DataFrame:
    """Edges in each block of a pre and a post chunk."""
    return edges.groupBy("tag", "pre_chunk", "post_chunk").agg(F.count(F.lit(1)).alias("n"))


def bidirectional(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse."""
    swap = {**{c: "post" + c[3:] for c in edges.columns if c.startswith("pre_")}, **{c: "pre" + c[4:] for c in edges.columns if c.startswith("post_")}}
    return edges.unionByName(edges.select(*(F.col(swap.get(c, c)).alias(c) for c in edges.columns)))


def redo_closure(uses: list[tuple[str, str]], chosen: set[str]) -> set[str]:
    """The strategies to run again with the chosen ones: those that share a cell type with one of them, and so on.

    uses has a (strategy, cell type) for each pair of a configuration, so it is small.
    """
    done = set(chosen)
    while True:
        types = {t for s, t in uses if s in done}
        more = {s for s, t in uses if t in types} - done
        if not more:
            return done
        done |= more
