"""A repository of morphologies in a network store: points, branches and metadata by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.labels import name_matches
from lattica.operators.spatial import AXES
from lattica.sources.cuts import cut, dropped
from lattica.sources.store import PARTITIONS, NetworkStore

PARTITIONS.setdefault("morpho_meta", ["morph_name"])


class MorphologyRepository:
    def __init__(self, store: NetworkStore):
        self.store = store

    def names(self) -> list[str]:
        if not self.store.exists("morpho_meta"):
            return []
        return sorted(r.morph_name for r in self.store.read("morpho_meta").select("morph_name").distinct().collect())

    def has(self, name: str) -> bool:
        return not self._missing([name])

    def _missing(self, names: list[str]) -> list[str]:
        """Which of a few names aren't there; only these are looked up."""
        if not self.store.exists("morpho_meta"):
            return sorted(set(names))
        there = self.store.read("morpho_meta").where(F.col("morph_name").isin(*names)).select("morph_name").distinct().collect()
        return sorted(set(names) - {r.morph_name for r in there})

    def save(self, points: DataFrame, branches: DataFrame, meta: dict[str, str] | None = None, overwrite: bool = False) -> None:
        """All morphologies of points and branches, by their morph_name. Names that are there raise unless overwritten."""
        if not overwrite and self.store.exists("morpho_meta"):
            known = points.select("morph_name").distinct().join(self.store.read("morpho_meta").select("morph_name"), "morph_name", "left_semi")
            some = sorted(r.morph_name for r in known.limit(5).collect())
            if some:
                raise FileExistsError(f"morphologies {some} are there")
        low, high = F.array(*(F.min(c) for c in AXES)), F.array(*(F.max(c) for c in AXES))
        pairs = [x for k, v in (meta or {}).items() for x in (F.lit(k), F.lit(v))]
        about = points.groupBy("morph_name").agg(low.alias("ldc"), high.alias("mdc")).withColumn("meta", F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>"))
        for table, rows in (("morpho_points", points), ("morpho_branches", branches), ("morpho_meta", about)):
            self.store.replace(table, rows)

    def load(self, *names: str) -> tuple[DataFrame, DataFrame]:
        missing = self._missing(list(names))
        if missing:
            raise FileNotFoundError(f"no morphologies {missing}")
        return tuple(self.store.read(t).where(F.col("morph_name").isin(*names)) for t in ("morpho_points", "morpho_branches"))

    def get_meta(self, name: str) -> dict[str, str]:
        row = self.store.read("morpho_meta").where(F.col("morph_name") == name).select("meta").first()
        if row is None:
            raise FileNotFoundError(name)
        return dict(row["meta"])

    def get_all_meta(self) -> dict[str, dict[str, str]]:
        return {r.morph_name: dict(r["meta"]) for r in self.store.read("morpho_meta").select("morph_name", "meta").collect()}

    def update_all_meta(self, meta: dict[str, dict[str, str]]) -> None:
        """Adds to, or replaces in, the metadata of each named morphology; a name that isn't there raises."""
        self._put_meta(meta, F.map_concat(F.map_filter("meta", lambda k, _: ~F.map_contains_key("more", k)), "more"))

    def set_all_meta(self, meta: dict[str, dict[str, str]]) -> None:
        """The metadata of each named morphology, in place of what it had."""
        self._put_meta(meta, F.col("more"))

    def _put_meta(self, meta: dict[str, dict[str, str]], value: Column) -> None:
        lost = self._missing(list(meta))
        if lost:
            raise FileNotFoundError(f"no morphologies {lost}")
        new = self.store.spark.createDataFrame(list(meta.items()), "morph_name string, more map<string,string>")
        rows = self.store.read("morpho_meta").join(F.broadcast(new), "morph_name").withColumn("meta", value).drop("more")  # a row a name given
        rows = cut(rows, "morpho-meta")  # read before what it comes from is replaced
        self.store.replace("morpho_meta", rows)
        dropped(rows)

    def select(self, *selectors: list[str]) -> list[str]:
        """Names that one of the selectors, lists of patterns, picks; a selector that picks nothing raises."""
        table = self.store.read("morpho_meta").select("morph_name")
        for s in selectors:
            if s and table.where(name_matches(F.col("morph_name"), s)).isEmpty():
                raise LookupError(f"no morphology fits {s}")
        wanted = reduce(lambda a, b: a | b, [name_matches(F.col("morph_name"), s) for s in selectors], F.lit(False))
        return sorted(r.morph_name for r in table.where(wanted).collect())
