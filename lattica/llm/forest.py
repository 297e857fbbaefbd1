"""Nearest neighbours by largest inner product: a hash-prefix forest.

A tree gives each vector a long string of symbols and keeps the strings sorted, in blocks of bounded bytes. A symbol is the
signed axis that a random rotation turns the vector nearest to, so vectors of small angle often share it; vectors are first given one
more component that makes all equally long, so that the smallest angle to a query is the largest inner product.

A query descends every tree to the longest prefix that its string shares with others, and then ascends in all trees at once, to
shorter prefixes, until the cells it stands in hold enough candidates. A cell, the vectors of one prefix, is a range of neighbouring
blocks; the counts of cells say where to stop, and each block that a query then visits scores its part of the cell and keeps
the best. At the empty prefix a query visits all blocks of one tree, which is an exact search. How many candidates are enough is
fitted on SAMPLE queries, whose true neighbours are found exactly in one pass over all vectors.

Equal vectors are one class, known by its least id: copies can't fill cells or blocks, and of each class no more than
k + 1 ids can be among the k nearest of a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import in_arrow, materialize, sized, table

TREES, SYMBOLS, AXES_A_TREE = 32, 6, 32
#: Bits of a symbol: one of AXES_A_TREE axes, and a sign.
BITS = 6
SAMPLE, TARGET = 64, 0.95
BLOCK_BYTES, PACK = 1 << 19, 512
#: Bytes of blocks that a task sorts.
TASK_BYTES = 1 << 24


@dataclass(frozen=True)
class Space:
    """What hashing must know of all vectors: dimensions, largest component, largest norm after division by that, and numpy's type."""

    dim: int
    scale: float
    norm: float
    dtype: str

    def vectors(self, column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, self.dim)

    def codes(self, x: np.ndarray, queries: bool = False) -> np.ndarray:
        """TREES strings of SYMBOLS symbols for each vector, packed into longs."""
        x = x.astype(np.float64) / self.scale
        norms = np.sqrt((x * x).sum(1, keepdims=True))
        if queries:
            x = np.hstack([x / np.maximum(norms, 1e-300), np.zeros_like(norms)])
        else:
            x = np.hstack([x / self.norm, np.sqrt(np.maximum(0.0, 1 - (norms / self.norm) ** 2))])
        x, out = x.astype(np.float32), np.zeros((len(x), TREES), np.int64)
        for tree in range(TREES):
            for symbol in range(SYMBOLS):
                p = x @ _rotation(self.dim + 1, tree * SYMBOLS + symbol)
                at = np.abs(p).argmax(1)
                out[:, tree] = (out[:, tree] << BITS) | (2 * at + (p[np.arange(len(p)), at] > 0))
        return out


_rotations: dict[tuple[int, int], np.ndarray] = {}


def _rotation(dim: int, number: int) -> np.ndarray:
    """Orthonormal columns as far as there are dimensions, the same in every worker; kept while they are small."""
    if (dim, number) in _rotations:
        return _rotations[dim, number]
    raw = np.random.default_rng((12, dim, number)).standard_normal((dim, AXES_A_TREE))
    made = (np.linalg.qr(raw)[0] if dim >= AXES_A_TREE else raw).astype(np.float32)
    if dim <= 1024:
        _rotations[dim, number] = made
    return made


def best(scores: np.ndarray, ids: np.ndarray, x: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best of x for q, ties to the smaller id; scores summed anew, alike wherever a pair is met."""
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        slack = 1e-10 * np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(1).max())
        chosen = np.flatnonzero(~(scores < least - slack))
        ids, x = ids[chosen], x[chosen]
    exact = (x * q).sum(1)
    order = np.lexsort((ids, -exact))[:k]
    return ids[order], exact[order]


def rows_of(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and vec, each id once, of the vectors that take part.

    Null, empty and zero vectors and those with a null, infinite or NaN component take no part, nor do rows without an id. Of the
    rows of one id the one with the least vector counts. Other columns are not read.
    """
    single = dict(embeddings.dtypes)[vector_col] == "array<float>"
    value = lambda v: v + F.lit(0.0).cast("float" if single else "double")  # no negative zeros
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col).cast("array<float>" if single else "array<double>"), value).alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & finite & F.exists("vec", lambda v: v != 0)).groupBy("vec_id").agg(F.min("vec").alias("vec"))


class Forest:
    """The index of (vec_id, vec) rows: `members` (vec_id, class), `classes` (class, vec), blocks and the cells that they hold.

    Shorter vectors count as filled up with zeros.
    """

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        rows = materialize(rows, "vectors")
        single = dict(rows.dtypes)["vec"] == "array<float>"
        dim, scale = rows.agg(F.max(F.size("vec")), F.max(F.array_max(F.transform("vec", F.abs)))).first()
        self.empty = dim is None
        if self.empty:
            return
        padded = F.concat("vec", F.array_repeat(F.lit(0.0).cast("float" if single else "double"), F.lit(dim) - F.size("vec")))
        rows = rows.select("vec_id", padded.alias("vec"))
        norm = rows.agg(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + (v / F.lit(float(scale))) * (v / F.lit(float(scale))))))).first()[0]
        self.space = Space(dim, float(scale), float(norm), "<f4" if single else "<f8")
        grouped = materialize(rows.groupBy("vec").agg(F.min("vec_id").alias("class"), F.count(F.lit(1)).alias("n")), "vector-classes")
        self.classes = grouped.select("class", "vec")
        self.total = grouped.count()
        copies = grouped.where("n > 1").select("vec", "class")
        self.members = materialize(rows.join(sized(copies, size=F.size("vec")), "vec", "left").select("vec_id", F.coalesce("class", "vec_id").alias("class")), "members")
        self.codes = materialize(self._coded(self.classes, False), "codes")
        self._blocks()

    def _coded(self, classes: DataFrame, queries: bool) -> DataFrame:
        """class, vec and codes."""
        space = self.space

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                if batch.num_rows:
                    codes = space.codes(space.vectors(batch.column(1)), queries)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, TREES), pa.int32()), pa.array(codes.ravel()))], names=["class", "vec", "codes"])

        return in_arrow(classes.select("class", "vec"), run, f"class long, vec {dict(classes.dtypes)['vec']}, codes array<long>")

    def _blocks(self) -> None:
        """The sorted arrays, a row a block, and the cells: for each prefix of two or more vectors, how many, and its first and last block."""
        space = self.space
        row_bytes = space.dim * int(space.dtype[2]) + 16
        most = max(16, BLOCK_BYTES // row_bytes)
        parts = TREES * self.total * row_bytes // TASK_BYTES + 1

        def pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, made, held = TaskContext.get().partitionId(), 0, []

            def block(tree: int, codes: np.ndarray, ids: np.ndarray, vecs: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([(part << 32) + made]), *(pa.array([x.tobytes()], pa.binary()) for x in (codes, ids, vecs))], names=["tree", "place", "codes", "ids", "vecs"])

            def joined() -> tuple[np.ndarray, ...]:
                return tuple(np.concatenate([h[i] for h in held]) for i in range(4))

            for batch in rows:
                if not batch.num_rows:
                    continue
                trees, codes, ids = (batch.column(i).to_numpy() for i in range(3))
                held.append((trees, codes, ids, space.vectors(batch.column(3)).astype(space.dtype)))
                trees, codes, ids, vecs = joined()
                a = 0
                while len(trees) - a >= most or trees[-1] != trees[a]:
                    b = min(a + most, int(np.searchsorted(trees, trees[a], side="right")))
                    yield block(int(trees[a]), codes[a:b], ids[a:b], vecs[a:b])
                    made, a = made + 1, b
                    if a == len(trees):
                        break
                held = [(trees[a:], codes[a:], ids[a:], vecs[a:].copy())] if a < len(trees) else []
            if held:
                trees, codes, ids, vecs = joined()
                yield block(int(trees[0]), codes, ids, vecs)

        entries = self.codes.select(F.posexplode("codes").alias("tree", "code"), "class", "vec").select("tree", "code", "class", "vec")
        entries = entries.repartitionByRange(parts, "tree", "code", "class").sortWithinPartitions("tree", "code", "class")
        blocks = materialize(in_arrow(entries, pack, "tree int, place long, codes binary, ids binary, vecs binary"), "blocks")
        numbered = blocks.select("tree", "place").withColumn("block", F.row_number().over(Window.partitionBy("tree").orderBy("place")) - 1)  # a row a block
        numbered = materialize(numbered, "block-numbers")
        self.blocks = blocks.join(sized(numbered.select("place", "block")), "place")
        self.blocks_a_tree = numbered.where("tree = 0").count()

        def cells(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                for tree, codes, block in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                    codes = np.frombuffer(codes.as_buffer(), "<i8")
                    for level in range(1, SYMBOLS + 1):
                        prefix, n = np.unique(codes >> (BITS * (SYMBOLS - level)), return_counts=True)
                        some = n > 1
                        some[[0, -1]] = True  # these may go on in the next block
                        prefix, n = prefix[some], n[some]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), x), t) for x, t in ((tree, pa.int32()), (level, pa.int32()))] + [pa.array(prefix), pa.array(n.astype(np.int64)), pa.array(np.full(len(n), block), pa.int32())], names=["tree", "level", "prefix", "n", "block"])

        found = in_arrow(self.blocks.select("tree", "codes", "block"), cells, "tree int, level int, prefix long, n long, block int")
        self.cells = materialize(found.groupBy("tree", "level", "prefix").agg(F.sum("n").alias("n"), F.min("block").alias("lo"), F.max("block").alias("hi")), "cells")

    def nearest_exactly(self, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
        """class and near, the k nearest other classes of a few (class, vec) queries: all vectors are scored, a batch at a time."""
        space, ids = self.space, np.array([c for c, _ in queries])
        vecs = np.array([v for _, v in queries], np.float64)

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                if batch.num_rows:
                    own, x = batch.column(0).to_numpy(), space.vectors(batch.column(1)).astype(np.float64)
                    out = []
                    for scores, c, q in zip(vecs @ x.T, ids, vecs, strict=True):
                        out.append((c, *best(np.where(own == c, -np.inf, scores), own, x, q, k + 1)))
                    near, score = (np.concatenate([o[i] for o in out]) for i in (1, 2))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([o[0] for o in out], [len(o[1]) for o in out])), pa.array(near), pa.array(score)], names=["class", "near", "score"])

        found = in_arrow(self.classes, run, "class long, near long, score double").where("class != near")
        first = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("score"), "near"))
        return found.withColumn("r", first).where(F.col("r") <= k).select("class", "near")

    def profile(self, queries: DataFrame) -> DataFrame:
        """class, tree, level, n, lo, hi for every cell that a query (class, codes) stands in."""
        levels = F.array(*(F.struct(F.lit(x).alias("level"), F.shiftright("code", BITS * (SYMBOLS - x)).alias("prefix")) for x in range(1, SYMBOLS + 1)))
        at = queries.select("class", F.posexplode("codes").alias("tree", "code")).select("class", "tree", F.explode(levels).alias("l")).select("class", "tree", "l.level", "l.prefix")
        return at.join(sized(self.cells), ["tree", "level", "prefix"])

    def enough(self, queries: DataFrame, profile: DataFrame, k: int) -> float:
        """The least number of candidates, counted over all trees, at which a sample of queries finds TARGET of its true neighbours.

        Never below (k + 1) * TREES, so that k different ones other than the query's own are among them. Infinite if only the exact search is good enough.
        """
        sample = queries.orderBy(F.xxhash64("class"), "class").limit(SAMPLE).select("class", "vec", "codes").collect()
        if not sample:
            return float("inf")
        true = self.nearest_exactly([(r["class"], r.vec) for r in sample], k)
        true = true.join(self.codes.select(F.col("class").alias("near"), "codes"), "near").select("class", "codes").collect()  # SAMPLE * k at most
        own = {r["class"]: np.array(r.codes) for r in sample}
        depth = {c: [] for c in own}  # the longest prefix that a true neighbour shares in any tree
        for r in true:
            shared = [(own[r["class"]] >> (BITS * (SYMBOLS - x)) == np.array(r.codes) >> (BITS * (SYMBOLS - x))).any() for x in range(1, SYMBOLS + 1)]
            depth[r["class"]].append(sum(shared))
        counts = {c: [0] * (SYMBOLS + 1) for c in own}
        mine = self.spark.createDataFrame([(c,) for c in own], "class long")
        for r in profile.join(F.broadcast(mine), "class").groupBy("class", "level").agg(F.sum("n").alias("n")).collect():
            counts[r["class"]][r.level] = r.n
        for m in sorted({(k + 1) * TREES, *(n for ns in counts.values() for n in ns if n > (k + 1) * TREES)}):
            level = {c: max((x for x in range(1, SYMBOLS + 1) if ns[x] >= m), default=0) for c, ns in counts.items()}
            if np.mean([np.mean(np.array(d) >= level[c]) if d else 1.0 for c, d in depth.items()]) >= TARGET:
                return float(m)
        return float("inf")

    def search(self, ids: Column, k: int) -> DataFrame:
        """The k nearest of every member whose vec_id satisfies `ids`: query_id, rank, vec_id, score."""
        if self.empty:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        asked = materialize(self.members.where(ids), "asked")
        queries = self.classes.join(sized(asked.select("class").distinct()), "class", "left_semi")
        queries = materialize(self._coded(queries, True), "queries")
        profile = materialize(self.profile(queries), "profile")
        m = self.enough(queries, profile, k)
        # Ascending in all trees at once: the longest prefix whose cells together hold enough.
        level = profile.groupBy("class", "level").agg(F.sum("n").alias("n")).where(F.col("n") >= m).groupBy("class").agg(F.max("level").alias("at"))
        inside = profile.join(level, "class").where("level = at")
        shift = F.lit(BITS) * (SYMBOLS - F.col("level"))
        low = F.expr(f"shiftleft(prefix, {BITS} * ({SYMBOLS} - level))")
        high = low + F.expr(f"shiftleft(1L, {BITS} * ({SYMBOLS} - level))") - 1
        inside = inside.select("class", "tree", low.alias("low"), high.alias("high"), F.explode(F.sequence("lo", "hi")).alias("block"))
        rest = queries.join(level, "class", "left_anti").select("class", F.lit(0).alias("tree"), F.lit(0).cast("long").alias("low"), F.lit((1 << 62) - 1).alias("high"), F.explode(F.sequence(F.lit(0), F.lit(self.blocks_a_tree - 1))).alias("block"))
        visits = materialize(inside.unionByName(rest), "visits")
        return self._ranked(asked, self._scored(visits, queries, k), k)

    def _scored(self, visits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """class, near, score: the best k + 1 classes that each visit finds. A block meets its visitors PACK at a time, wherever these are many."""
        space = self.space
        packs = materialize(visits.groupBy("tree", "block").agg(F.ceil(F.count(F.lit(1)) / F.lit(PACK)).cast("int").alias("packs")), "packs")
        seen = visits.join(sized(packs), ["tree", "block"]).withColumn("pack", F.pmod(F.xxhash64("class"), F.col("packs")).cast("int")).drop("packs")
        seen = seen.join(sized(queries.select("class", "vec"), size=F.size("vec")), "class")
        blocks = self.blocks.join(sized(packs), ["tree", "block"]).withColumn("pack", F.explode(F.sequence(F.lit(0), F.col("packs") - 1)))
        key = ["tree", "block", "pack"]

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            none = pa.table({"class": pa.array([], pa.int64()), "near": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            if not left.num_rows or not right.num_rows:
                return none
            codes, ids = (np.frombuffer(left.column(c)[0].as_buffer(), "<i8") for c in ("codes", "ids"))
            x = np.frombuffer(left.column("vecs")[0].as_buffer(), space.dtype).reshape(-1, space.dim).astype(np.float64)
            classes = right.column("class").to_numpy()
            q = space.vectors(right.column("vec").combine_chunks()).astype(np.float64)
            a = np.searchsorted(codes, right.column("low").to_numpy(), side="left")
            b = np.searchsorted(codes, right.column("high").to_numpy(), side="right")
            out = []
            for lo, hi in sorted(set(zip(a.tolist(), b.tolist(), strict=True))):
                if lo < hi:
                    chosen = np.flatnonzero((a == lo) & (b == hi))
                    for scores, i in zip(q[chosen] @ x[lo:hi].T, chosen, strict=True):
                        out.append((classes[i], *best(scores, ids[lo:hi], x[lo:hi], q[i], k + 1)))
            if not out:
                return none
            return pa.table({"class": np.repeat([o[0] for o in out], [len(o[1]) for o in out]), "near": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})

        return blocks.select(*key, "codes", "ids", "vecs").groupBy(*key).cogroup(seen.select(*key, "class", "low", "high", "vec").groupBy(*key)).applyInArrow(run, "class long, near long, score double")

    def _ranked(self, asked: DataFrame, scored: DataFrame, k: int) -> DataFrame:
        """From the classes found to the k nearest rows of each query."""
        found = scored.groupBy("class", "near").agg(F.max("score").alias("score"))  # met in several trees
        first = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("score"), "near"))
        found = materialize(found.withColumn("r", first).where(F.col("r") <= k + 1).drop("r"), "found")
        # The k + 1 least ids of each class: no other row of it can be among the k nearest of any row.
        place = F.row_number().over(Window.partitionBy("class").orderBy("vec_id"))
        more = self.members.where("vec_id != class").withColumn("place", place).where(F.col("place") <= k)
        more = materialize(more.groupBy(F.col("class").alias("near")).agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "copies")
        pairs = found.join(sized(more, size=F.size("ids")), "near", "left")
        ids = F.concat(F.array("near"), F.coalesce("ids", F.array().cast("array<long>")))
        near = F.transform(ids, lambda i: F.struct((-F.col("score")).alias("less"), i.alias("vec_id")))
        lists = pairs.groupBy("class").agg(F.slice(F.sort_array(F.flatten(F.collect_list(near))), 1, k + 1).alias("near"))
        out = asked.join(sized(materialize(lists, "lists"), size=F.size("near")), "class")
        own = F.slice(F.filter("near", lambda p: p["vec_id"] != F.col("vec_id")), 1, k)
        out = out.select(F.col("vec_id").alias("query_id"), F.posexplode(own).alias("r", "p"))
        return out.select("query_id", (F.col("r") + 1).cast("int").alias("rank"), "p.vec_id", (-F.col("p.less") + 0.0).alias("score"))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Forest(rows_of(table(spark, sf_dir, "embeddings"))).search(F.col("vec_id") % 20 == 0, 20)
