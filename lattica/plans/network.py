"""A network plan: placement and connectivity strategies, run in order into a store, each as one lazy DataFrame and one write."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.chunks import chunk_of
from lattica.operators.connectivity import output_tags
from lattica.operators.network import chunk_stats, connected, redo_closure, with_local_ids
from lattica.plans.configuration import in_order
from lattica.plans.topology import Box, chunks_of, topology_of
from lattica.sources.store import NetworkStore


@dataclass
class Strategy:
    """make(plan) -> DataFrame; `cell_types` are those that it places or connects, `after` the strategies it needs."""

    name: str
    make: Callable[[Plan], DataFrame]
    cell_types: list[str]
    after: list[str] = field(default_factory=list)
    pre: list[str] = field(default_factory=list)
    post: list[str] = field(default_factory=list)


def placement_of(strategies: list[Strategy], cell_types: list[str]) -> list[Strategy]:
    """The strategies that place one of the types."""
    return [s for s in strategies if set(s.cell_types) & set(cell_types)]


def connectivity_of(strategies: list[Strategy], anywhere: list[str] | None = None, presynaptic: list[str] | None = None, postsynaptic: list[str] | None = None) -> list[Strategy]:
    """The strategies with one of the types on the side asked for; without any question, all."""
    if anywhere is None and presynaptic is None and postsynaptic is None:
        return list(strategies)
    asked = lambda s: bool(set(s.pre) & {*(anywhere or ()), *(presynaptic or ())} or set(s.post) & {*(anywhere or ()), *(postsynaptic or ())})
    return [s for s in strategies if asked(s)]


def guess_cell_count(counts: DataFrame) -> dict[str, float]:
    """The expected cells of each type, from rows (cell_type, estimate), without placing any."""
    return {r.cell_type: r.estimate for r in counts.groupBy("cell_type").agg(F.sum("estimate").alias("estimate")).collect()}


@dataclass
class Plan:
    store: NetworkStore
    chunk_size: float = 100.0
    placement: list[Strategy] = field(default_factory=list)
    connectivity: list[Strategy] = field(default_factory=list)
    after_placement: list[Callable[[Plan], None]] = field(default_factory=list)
    after_connectivity: list[Callable[[Plan], None]] = field(default_factory=list)
    regions: list = field(default_factory=list)
    origin: tuple[float, float, float] = (0.0, 0.0, 0.0)
    size: tuple[float, float, float] = (200.0, 200.0, 200.0)

    def layout(self) -> list[Box]:
        """The boxes of all partitions of the regions, in a space of the plan's size at its origin."""
        return topology_of(self.regions).layout(Box("network", self.origin, tuple(o + s for o, s in zip(self.origin, self.size, strict=True))))

    def chunks(self) -> DataFrame:
        """The chunks of all partitions (see topology.chunks_of)."""
        return chunks_of(self.store.spark, self.layout(), self.chunk_size)

    def resize(self, x: float | None = None, y: float | None = None, z: float | None = None) -> None:
        """Another size for what is laid out from now on; what is stored stays as it is."""
        self.size = tuple(old if new is None else float(new) for old, new in zip(self.size, (x, y, z), strict=True))

    def _chosen(self, strategies: list[Strategy], only: list[str] | None, skip: list[str] | None) -> list[Strategy]:
        by_name = {s.name: s for s in strategies}
        order = in_order({s.name: s.after for s in strategies})
        return [by_name[n] for n in order if (only is None or n in only) and n not in (skip or [])]

    def place(self, strategy: Strategy) -> None:
        """Points of a strategy (cell_type, x, y, z, ...) into their chunks."""
        cells = strategy.make(self)
        if "chunk_id" not in cells.columns:
            cells = cells.withColumn("chunk_id", chunk_of(F.col("x"), F.col("y"), F.col("z"), self.chunk_size))
        if "local_id" not in cells.columns:
            stored = chunk_stats(self.store.read("cells")) if self.store.holds("cells") else None
            cells = with_local_ids(cells, ["x", "y", "z"], stored)
        self.store.append("cells", cells)

    def tags(self, strategy: Strategy) -> dict[tuple[str, str], str | None]:
        """The tag of each pair of cell types that a strategy connects."""
        return output_tags(strategy.name, [(a, b) for a in strategy.pre for b in strategy.post])

    def connect(self, strategy: Strategy) -> None:
        """Stores a strategy's edges: as they are if they have chunks, else from ranks in the cell types, a pair of types at a time.

        With several pairs of types, edges name theirs in pre_type and post_type. A tag whose stored edges have other types raises.
        """
        edges = strategy.make(self)
        if "pre_chunk" in edges.columns:
            self.store.append("connections", edges)
            return
        if not strategy.pre or not strategy.post:
            raise ValueError(f"{strategy.name} must name the cell types that its edges have ranks in")
        cells, tags = self.store.read("cells"), self.tags(strategy)
        for (pre, post), tag in tags.items():
            if tag is None:
                continue
            if self.store.holds("connections"):
                other = self.store.read("connections", tag=tag).where((F.col("pre_type") != pre) | (F.col("post_type") != post)).first()
                if other is not None:
                    raise ValueError(f"{tag} connects {other.pre_type} to {other.post_type}, not {pre} to {post}")
            part = edges if len(tags) == 1 else edges.where((F.col("pre_type") == pre) & (F.col("post_type") == post))
            self.store.append("connections", connected(part, cells, tag, pre, post))

    def compile(self, only: list[str] | None = None, skip: list[str] | None = None, clear: bool = False, append: bool = False, redo: bool = False, skip_placement: bool = False, skip_connectivity: bool = False) -> None:
        """Runs placement, then connectivity, and the hooks after each.

        A store that has cells needs one of: clear (start anew), append, or redo (run `only` again, with all that
        shares its cell types; their cells go first). All of it becomes one version of the store at the end: if a strategy or
        a hook fails, the store is as it was.
        """
        if sum((clear, append, redo)) > 1:
            raise ValueError("clear, append and redo exclude each other")
        if self.store.exists("cells") and not (clear or append or redo):
            raise FileExistsError("the store has cells: clear, append or redo")
        with self.store.transaction():
            self._run(only, skip, clear, redo, skip_placement, skip_connectivity)

    def _run(self, only: list[str] | None, skip: list[str] | None, clear: bool, redo: bool, skip_placement: bool, skip_connectivity: bool) -> None:
        if clear:
            for t in ("cells", "connections"):
                self.store.clear(t)
        if redo:
            uses = [(s.name, t) for s in (*self.placement, *self.connectivity) for t in s.cell_types]
            only = sorted(redo_closure(uses, set(only or [n for n, _ in uses])))
            self.store.clear("cells", cell_type=sorted({t for n, t in uses if n in only}))
            tags = {tag for s in self.connectivity if s.name in only for tag in {s.name, *self.tags(s).values()} - {None}}
            if tags:
                self.store.clear("connections", tag=sorted(tags))
        if not skip_placement:
            for s in self._chosen(self.placement, only, skip):
                self.place(s)
            for hook in self.after_placement:
                hook(self)
        if not skip_connectivity:
            for s in self._chosen(self.connectivity, only, skip):
                self.connect(s)
            for hook in self.after_connectivity:
                hook(self)

    def diagram(self) -> str:
        """The network's tables as a Graphviz graph with counts."""
        cells = {r.cell_type: r["count"] for r in self.store.read("cells").groupBy("cell_type").count().collect()}
        edges = self.store.read("connections").groupBy("tag", "pre_type", "post_type").count().collect() if self.store.exists("connections") else []
        lines = [f'  "{t}" [label="{t} ({n})"]' for t, n in sorted(cells.items())]
        lines += [f'  "{r.pre_type}" -> "{r.post_type}" [label="{r.tag} ({r["count"]})"]' for r in sorted(edges, key=lambda r: r.tag)]
        return "digraph network {\n" + "\n".join(lines) + "\n}"
