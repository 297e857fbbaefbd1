"""Strategies that make edges from two sets of cells.

Sides are DataFrames of cells with an `id` that is unique on its side. Edges are (pre_id, pre_branch, pre_point, post_id,
post_branch, post_point).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.keyed import keyed_bits, keyed_uniform, stochastic_round
from lattica.functions.labels import has_any
from lattica.functions.rotation import euler_matrix, times
from lattica.functions.shapes import EPSILON, Composition, Shape
from lattica.operators.network import NONE
from lattica.operators.spatial import AXES, any_box_join, distance_join, points_in_boxes


def edges_of(pairs: DataFrame, pre: Column, post: Column, pre_at: tuple[Column, Column] | None = None, post_at: tuple[Column, Column] | None = None) -> DataFrame:
    whole = (F.lit(NONE), F.lit(NONE))
    columns = []
    for side, key, (branch, point) in (("pre", pre, pre_at or whole), ("post", post, post_at or whole)):
        columns += [key.alias(f"{side}_id"), branch.cast("int").alias(f"{side}_branch"), point.cast("int").alias(f"{side}_point")]
    return pairs.select(*columns)


def all_to_all(pre: DataFrame, post: DataFrame) -> DataFrame:
    """Every pre cell to every post cell, a cell to itself too: the output is the product, so that is its cost."""
    return edges_of(pre.select(F.col("id").alias("a")).crossJoin(post.select(F.col("id").alias("b"))), F.col("a"), F.col("b"))


def fixed_degree(fixed: DataFrame, pool: DataFrame, degree: int, seed: int = 0) -> DataFrame:
    """(fixed_id, pool_id): for each fixed row `degree` different pool rows. Raises if the pool is smaller than the degree.

    From a large pool places are drawn (sampled_degree); one of fewer than 4 * degree rows is ranked as a whole for each fixed
    row (ranked_degree), which makes less than four candidates for each edge.
    """
    return (sampled_degree if pool.limit(4 * degree).count() == 4 * degree else ranked_degree)(fixed, pool, degree, seed)


def ranked_degree(fixed: DataFrame, pool: DataFrame, degree: int, seed: int = 0) -> DataFrame:
    """(fixed_id, pool_id): for each fixed row the `degree` pool rows with the least keyed numbers. For small pools: it makes all pairs."""
    n = pool.limit(degree).count()
    if n < degree:
        raise ValueError(f"a degree of {degree} needs as many candidates; there are {n}")
    pairs = fixed.select(F.col("id").alias("fixed_id")).crossJoin(pool.select(F.col("id").alias("pool_id")))
    w = Window.partitionBy("fixed_id").orderBy(keyed_bits(seed, "fixed_id", "pool_id"), "pool_id")
    return pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= degree).select("fixed_id", "pool_id")


def ranked(pool: DataFrame, seed: int = 0) -> DataFrame:
    """pool's `id` with a place `rank` from 0 without gaps, in an order that the keyed numbers of the ids give.

    Places are counted in 256 blocks of that order, so no task sorts the whole pool.
    """
    rows = pool.select("id").withColumn("bits", keyed_bits(f"{seed}-rank", "id")).withColumn("block", F.shiftright("bits", 44))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("block").orderBy("bits", "id")) - 1
    return rows.withColumn("own", own).join(F.broadcast(sizes), "block").select("id", (F.col("before") + F.col("own")).alias("rank"))  # 256 rows


#: Draws that a row makes beyond twice its degree.
SPARE = 32


def sampled_degree(fixed: DataFrame, pool: DataFrame, degree: int, seed: int = 0) -> DataFrame:
    """(fixed_id, pool_id) by drawing places in the pool: its cost is that of its result.

    Each fixed row makes 2 * degree + SPARE draws with replacement and keeps the first `degree` different ones; one that happens to have fewer
    goes on with the places that follow a place drawn for it. Needs a pool of 4 * degree rows or more.
    """
    places = ranked(pool, seed)
    n = pool.count()
    if n < 4 * degree:
        raise ValueError("the pool is too small to draw from; rank it with ranked_degree")
    most = 2 * degree + SPARE
    draws = fixed.select(F.col("id").alias("fixed_id"), F.explode(F.sequence(F.lit(1), F.lit(most))).alias("draw"))
    draws = draws.withColumn("rank", F.pmod(keyed_bits(seed, "fixed_id", "draw"), F.lit(n))).groupBy("fixed_id", "rank").agg(F.min("draw").alias("draw"))
    w = Window.partitionBy("fixed_id")
    first = lambda rows: rows.withColumn("r", F.row_number().over(w.orderBy("draw"))).where(F.col("r") <= degree)
    counted = draws.withColumn("of", F.count(F.lit(1)).over(w))
    few = counted.where(F.col("of") < degree)
    # Of 2 * degree places in a row, no more than those drawn are taken already.
    more = few.select("fixed_id").distinct().withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(2 * degree))))
    more = more.select("fixed_id", F.pmod(keyed_bits(f"{seed}-more", "fixed_id") + F.col("step"), F.lit(n)).alias("rank"), (F.col("step") + most).alias("draw"))
    completed = few.drop("of").unionByName(more).groupBy("fixed_id", "rank").agg(F.min("draw").alias("draw"))
    kept = first(counted.where(F.col("of") >= degree).drop("of")).unionByName(first(completed))
    return kept.join(places, "rank").select("fixed_id", F.col("id").alias("pool_id"))


def fixed_indegree(pre: DataFrame, post: DataFrame, degree: int, seed: int = 0) -> DataFrame:
    return edges_of(fixed_degree(post, pre, degree, seed), F.col("pool_id"), F.col("fixed_id"))


def fixed_outdegree(pre: DataFrame, post: DataFrame, degree: int, seed: int = 0) -> DataFrame:
    return edges_of(fixed_degree(pre, post, degree, seed), F.col("fixed_id"), F.col("pool_id"))


def within_distance(pre: DataFrame, post: DataFrame, radius: float, least: float = 0.0) -> DataFrame:
    """Cells at a distance in [least, radius]; both sides need x, y, z."""
    return edges_of(distance_join(pre, post, radius, least), F.col("a.id"), F.col("b.id"))


def region_of_interest(pre_chunks: DataFrame, post_chunks: DataFrame, reach: tuple[int, int, int]) -> DataFrame:
    """Pairs (pre_chunk, post_chunk) of occupied chunks (cx, cy, cz, chunk_id) at most `reach` chunks apart on each axis."""
    near = pre_chunks.select(F.col("chunk_id").alias("pre_chunk"), "cx", "cy", "cz")
    for c, r in zip(("cx", "cy", "cz"), reach, strict=True):
        near = near.withColumn(c, F.explode(F.sequence(F.col(c) - r, F.col(c) + r)))
    return near.join(post_chunks.select(F.col("chunk_id").alias("post_chunk"), "cx", "cy", "cz"), ["cx", "cy", "cz"]).select("pre_chunk", "post_chunk")


def keep_affinity(candidates: DataFrame, target: str, key: list[str], affinity: float, seed: int = 0) -> DataFrame:
    """Of each target's n candidates floor(n * affinity), or one more by chance, without replacement."""
    w = Window.partitionBy(target)
    ranked = candidates.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_r", F.row_number().over(w.orderBy(keyed_bits(seed, target, *key), *key)))
    return ranked.where(F.col("_r") <= stochastic_round(F.col("_n") * affinity, keyed_uniform(f"{seed}-round", target))).drop("_n", "_r")


def side(cells: DataFrame, cell_types: list[str] | None = None, labels: list[str] | None = None) -> DataFrame:
    """One side of a strategy: the cells of some types, together, that have one of the labels. Edges of several types are told
    apart again by a join with the cells' types."""
    if cell_types is not None:
        cells = cells.where(F.col("cell_type").isin(cell_types))
    return cells if labels is None else cells.where(has_any(F.col("labels"), labels))


def world_points(cells: DataFrame, points: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """The morphology points (branch_id, point_id, x, y, z) of each cell, turned by its rx, ry and rz if it has these, and moved to it.

    Cells have morph_name. With labels, only points with one of them count.
    """
    if labels is not None:
        points = points.where(has_any(F.col("labels"), labels))
    turns = [c for c in ("rx", "ry", "rz") if c in cells.columns]
    at = cells.select(F.col("id"), "morph_name", *turns, *(F.col(c).alias(f"o{c}") for c in AXES))
    place = [F.col(c) for c in AXES]
    if len(turns) == 3:
        place = times(euler_matrix(*(F.col(c) for c in turns)), place)
    return at.join(points, "morph_name").select("id", "branch_id", "point_id", *((p + F.col(f"o{c}")).alias(c) for p, c in zip(place, AXES, strict=True)))


def voxelized(points: DataFrame, size: float, keys: list[str]) -> DataFrame:
    """Grid voxels that hold points: keys, ix, iy, iz, the number of points, and the (branch, point) list."""
    cells = [F.floor(F.col(c) / size).alias(f"i{c}") for c in AXES]
    return points.select(*keys, *cells, F.struct("branch_id", "point_id").alias("at")).groupBy(*keys, "ix", "iy", "iz").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("at")).alias("at"))


def voxel_intersection(pre: DataFrame, post: DataFrame, size: float, contacts: int = 1, seed: int = 0, affinity: float = 1.0) -> DataFrame:
    """Edges where two cells' morphologies share voxels of one grid; sides are world points (id, branch_id, ...).

    Each pair of cells gets `contacts` draws, with replacement, of a shared voxel by the product of its points on
    either side, and in it of one point each. A pair without a shared voxel has none; contacts < 1 means none. With an
    affinity below 1, each pre cell keeps that part of its post cells (see keep_affinity).

    A row of the join on voxels holds all voxels of both cells, so the first that a pair shares tells the whole pair, and nothing
    but the sides is shuffled.
    """
    key = _voxel_key([pre] if pre is post else [pre, post], size)
    a, b = (_by_voxel(points, key, name) for points, name in ((pre, "pre"), (post, "post")))
    a, b = (side.repartition(_partitions(side), "key") for side in (a, b))
    shared = a.join(b, "key").withColumn("common", F.array_intersect("pre_keys", "post_keys")).where(F.get("common", F.lit(0)) == F.col("key"))
    start = lambda side, k, after=0: F.element_at(f"{side}_starts", (F.array_position(f"{side}_keys", k) + after).cast("int"))
    held = lambda side, k: start(side, k, 1) - start(side, k)
    one = F.array((F.col("pre_n") * F.col("post_n")).cast("long"))
    weights = F.when(F.size("common") == 1, one).otherwise(F.transform("common", lambda k: (held("pre", k) * held("post", k)).cast("long")))
    drawn = _drawn(shared.withColumn("weights", weights), contacts, seed).withColumn("at", F.element_at("common", F.col("draw.place")))
    n = F.when(F.col("at") == F.col("key"), F.col("post_n")).otherwise(held("post", F.col("at")))
    place = {side: (start(side, F.col("at")) + k).cast("int") for side, k in (("pre", F.floor(F.col("draw.rest") / n)), ("post", F.pmod(F.col("draw.rest"), n)))}
    where = {side: (F.element_at(f"{side}_branches", k), F.element_at(f"{side}_points", k)) for side, k in place.items()}
    return _of_affinity(edges_of(drawn, F.col("pre_id"), F.col("post_id"), where["pre"], where["post"]), affinity, seed)


def _partitions(df: DataFrame) -> int:
    """As many as a shuffle has, for joins whose few rows make many: AQE goes by what is read when it merges partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _voxel_key(sides: list[DataFrame], size: float) -> Column:
    """A number for each voxel of a grid, in the order of ix, iy, iz; text in that order if the points reach over too many voxels."""
    at = [F.floor(F.col(c) / size) for c in AXES]
    ends = [p.agg(*(f(v).alias(f"{n}{i}") for i, v in enumerate(at) for n, f in (("l", F.min), ("h", F.max)))).first() for p in sides]
    ends = [e for e in ends if None not in e]
    if not ends:
        return sum((v * 0 for v in at), F.lit(0).cast("long"))
    low, high = ([f(e[f"{n}{i}"] for e in ends) for i in range(3)] for n, f in (("l", min), ("h", max)))
    spans = [h - k + 1 for k, h in zip(low, high, strict=True)]
    if spans[0] * spans[1] * spans[2] < 2**63:
        x, y, z = (v - F.lit(k) for v, k in zip(at, low, strict=True))
        return (x * F.lit(spans[1]) + y) * F.lit(spans[2]) + z
    digits = [F.lpad((v.cast("decimal(20,0)") - F.lit(k).cast("decimal(20,0)")).cast("string"), 20, "0") for v, k in zip(at, low, strict=True)]
    return F.concat(*digits)


def _by_voxel(points: DataFrame, key: Column, side: str) -> DataFrame:
    """A row for each voxel (key) of each cell, with n, its number of points there, and all that the cell has: keys, its voxels in order; the
    branches and points in order of voxels and, in each, of their own; and starts, where each voxel's begin, from 1, and where the last ends."""
    rows = points.select("id", F.struct(key.alias("key"), F.col("branch_id").cast("int").alias("branch"), F.col("point_id").cast("int").alias("point")).alias("p")).where(F.col("p.key").isNotNull())
    cells = rows.groupBy("id").agg(F.array_sort(F.collect_list("p")).alias("p")).withColumn("keys", F.array_distinct("p.key"))
    starts = F.concat(F.transform("keys", lambda k: F.array_position("p.key", k).cast("int")), F.array(F.size("p") + 1))
    cells = cells.select(F.col("id").alias(f"{side}_id"), F.col("keys").alias(f"{side}_keys"), starts.alias(f"{side}_starts"), F.col("p.branch").alias(f"{side}_branches"), F.col("p.point").alias(f"{side}_points"))
    out = cells.select("*", F.posexplode(f"{side}_keys").alias("k", "key"))
    return out.withColumn(f"{side}_n", F.element_at(f"{side}_starts", F.col("k") + 2) - F.element_at(f"{side}_starts", F.col("k") + 1)).drop("k")


def _drawn(pairs: DataFrame, contacts: int, seed: int) -> DataFrame:
    """`contacts` draws for each row (pre_id, post_id, weights): place, from 1, by the weights, and rest, a number from 0 below that place's weight."""
    one = F.size("weights") == 1
    total = F.when(one, F.element_at("weights", 1)).otherwise(F.aggregate("weights", F.lit(0).cast("long"), lambda t, w: t + w))
    rows = pairs.withColumn("total", total).withColumn("contact", F.explode(F.sequence(F.lit(1), F.lit(max(1, contacts))))).where(F.lit(contacts) >= F.col("contact"))
    rows = rows.withColumn("pick", F.pmod(keyed_bits(seed, "pre_id", "post_id", "contact"), F.col("total")))
    state = lambda rest, place, done: F.struct(rest.alias("rest"), place.alias("place"), F.lit(done).alias("done"))
    step = lambda s, w: F.when(s["done"], s).when(s["rest"] < w, state(s["rest"], s["place"], True)).otherwise(state(s["rest"] - w, s["place"] + 1, False))
    return rows.withColumn("draw", F.when(one, state(F.col("pick"), F.lit(1), True)).otherwise(F.aggregate("weights", state(F.col("pick"), F.lit(1), False), step)))


def _of_affinity(edges: DataFrame, affinity: float, seed: int) -> DataFrame:
    if affinity >= 1:
        return edges
    pairs = keep_affinity(edges.select("pre_id", "post_id").distinct(), "pre_id", ["post_id"], affinity, seed)
    return edges.join(pairs, ["pre_id", "post_id"], "left_semi").select(edges.columns)


def voxel_box_intersection(pre: DataFrame, post: DataFrame, base: float, contacts: int = 1, seed: int = 0, affinity: float = 1.0) -> DataFrame:
    """The same for voxels of any sizes, each side's its own: rows of voxels.voxel_boxes or numbered_voxels with an id.

    Voxels that touch count as overlapping. base is about the size of the least of them. Pairs of cells come from a join of the boxes
    around all their voxels, each with all voxels of both, so here too nothing but the sides is shuffled.
    """
    both = any_box_join(_with_voxels(pre), _with_voxels(post), base, 0.5, _partitions(pre))
    box = lambda s: {f"{e}{c}": F.col(f"{s}.{e}{c}") for e in "lh" for c in AXES}
    meet = lambda p, q: reduce(lambda x, y: x & y, [(p[f"l{c}"] <= q[f"h{c}"]) & (q[f"l{c}"] <= p[f"h{c}"]) for c in AXES])
    own, others = F.filter("a.voxels", lambda p: meet(p, box("b"))), F.filter("b.voxels", lambda q: meet(q, box("a")))
    found = lambda p, near: F.transform(F.filter(near, lambda q: meet(p, q)), lambda q: F.struct(p["at"].alias("pre"), q["at"].alias("post")))
    # Transforms of arrays of one element name what is used again, and what is exploded isn't made once more for the filter.
    shared = F.element_at(F.transform(F.array(others), lambda near: F.flatten(F.transform(own, lambda p: found(p, near)))), 1)
    pairs = both.select(F.col("a.id").alias("pre_id"), F.col("b.id").alias("post_id"), F.explode(F.array(shared)).alias("shared")).where(F.size("shared") > 0)
    weights = F.transform("shared", lambda x: (F.size(x["pre"]) * F.size(x["post"])).cast("long"))
    drawn = _drawn(pairs.withColumn("weights", weights), contacts, seed).withColumn("at", F.element_at("shared", F.col("draw.place")))
    n = F.size("at.post")
    p = F.element_at("at.pre", (F.floor(F.col("draw.rest") / n) + 1).cast("int"))
    q = F.element_at("at.post", (F.pmod(F.col("draw.rest"), n) + 1).cast("int"))
    return _of_affinity(edges_of(drawn, F.col("pre_id"), F.col("post_id"), (p["branch_id"], p["point_id"]), (q["branch_id"], q["point_id"])), affinity, seed)


def _with_voxels(boxes: DataFrame) -> DataFrame:
    """id, the voxels of each cell in the order of ix, iy, iz, and the box around them."""
    ends = [f"{e}{c}" for e in "lh" for c in AXES]
    places = boxes.where(F.col("ix").isNotNull() & F.col("iy").isNotNull() & F.col("iz").isNotNull())
    cells = places.groupBy("id").agg(*(F.min(e).alias(e) if e[0] == "l" else F.max(e).alias(e) for e in ends), F.array_sort(F.collect_list(F.struct("ix", "iy", "iz", *ends, "at"))).alias("voxels"))
    return cells.withColumn("voxels", F.transform("voxels", lambda v: F.struct(*(v[e].alias(e) for e in ends), v["at"].alias("at"))))


def points_in_shapes(points: DataFrame, cells: DataFrame, size: float, shape: Shape | Composition | None = None) -> DataFrame:
    """Pairs of world points a and cells b whose solid holds them: boxes of all that counts as inside first, then the solid.

    The solid is `shape`, given about the cell's place, or without it a sphere with the cell's `radius`. size is about the solid's width; they
    meet on a grid half as wide, where a point meets fewer solids that don't hold it and no cell of the grid has much of the work.
    """
    if shape is None:
        low, high = [-F.col("radius") - EPSILON] * 3, [F.col("radius") + EPSILON] * 3
        inside = sum((F.pow(F.col(f"a.{c}") - F.col(f"b.{c}"), F.lit(2.0)) for c in AXES), F.lit(0.0)) <= F.col("b.radius") * F.col("b.radius")
    else:
        low, high = ([F.lit(float(v)) for v in corner] for corner in shape.reach())
        inside = shape.inside([F.col(f"a.{c}") - F.col(f"b.{c}") for c in AXES])
    boxed = cells.select("*", *((F.col(c) + v).alias(f"l{c}") for c, v in zip(AXES, low, strict=True)), *((F.col(c) + v).alias(f"h{c}") for c, v in zip(AXES, high, strict=True)))
    return points_in_boxes(points, boxed, size / 2, _partitions(points)).where(inside)


def shape_cloud(cells: DataFrame, shape: Composition, voxel: float, seed: int = 0) -> DataFrame:
    """id, point_id and places of random points in each cell's solids: as many in each as its volume has voxels."""
    out, first = None, 0
    for k, solid in enumerate(shape.shapes):
        n = solid.n_points(voxel)
        rows = cells.select("id", *AXES, F.explode(F.sequence(F.lit(first), F.lit(first + n - 1))).alias("point_id")) if n else None
        first += n
        if rows is not None:
            at = solid.point([keyed_uniform(f"{seed}-{k}-{i}", "id", "point_id") for i in range(3)])
            part = rows.select("id", "point_id", *((F.col(c) + p).alias(c) for c, p in zip(AXES, at, strict=True)))
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("the voxels are larger than the solids")
    return out


def shape_to_morphology(pre_cells: DataFrame, post_points: DataFrame, size: float, affinity: float = 1.0, seed: int = 0, shape: Shape | Composition | None = None) -> DataFrame:
    """Edges from cells with a solid (see points_in_shapes) to the morphology points inside it; each pair of cells keeps max(1, floor(a n))."""
    hits = points_in_shapes(post_points, pre_cells, size, shape).select(F.col("b.id").alias("pre"), F.col("a.id").alias("post"), F.col("a.branch_id").alias("branch"), F.col("a.point_id").alias("point"))
    if affinity >= 1:  # all are kept, so none is counted or moved
        return edges_of(hits, F.col("pre"), F.col("post"), None, (F.col("branch"), F.col("point")))
    w = Window.partitionBy("pre", "post")
    ranked = hits.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy(keyed_bits(seed, "pre", "post", "branch", "point"), "branch", "point")))
    kept = ranked.where(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") * affinity)))
    return edges_of(kept, F.col("pre"), F.col("post"), None, (F.col("branch"), F.col("point")))


def morphology_to_shape(pre_points: DataFrame, post_cells: DataFrame, size: float, affinity: float = 1.0, seed: int = 0, shape: Shape | Composition | None = None) -> DataFrame:
    """The mirror image; the pre side keeps its branch and point."""
    e = shape_to_morphology(post_cells, pre_points, size, affinity, seed, shape)
    return e.select(*(F.col(("post" if c.startswith("pre") else "pre") + c[c.index("_"):]).alias(c) for c in e.columns))


def pruned(edges: DataFrame, ratio: float, key: list[str], seed: int = 0) -> DataFrame:
    """floor(ratio * n) of all n edges: those with the least keyed numbers.

    Counted in 4096 blocks, by a hash of seed and key. Whole blocks stay or go where they are; only the edges of the one block in
    which the limit falls are moved, and ranked in it by keyed_bits, which take most of the time where all rows need them.
    """
    rows = edges.withColumn("_block", F.shiftrightunsigned(F.xxhash64(F.lit(f"{seed}-prune"), *key), 52))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_block").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    sizes = sizes.withColumn("_keep", F.floor(F.sum("_n").over(Window.partitionBy()) * ratio)).where(F.col("_before") < F.col("_keep"))  # 4096 rows
    held = rows.join(F.broadcast(sizes), "_block")
    whole = F.col("_before") + F.col("_n") <= F.col("_keep")
    own = F.row_number().over(Window.partitionBy("_block").orderBy(keyed_bits(f"{seed}-prune", *key), *key))
    part = held.where(~whole).withColumn("_own", own).where(F.col("_before") + F.col("_own") <= F.col("_keep"))
    return held.where(whole).select(edges.columns).unionByName(part.select(edges.columns))


def shape_to_shape(pre_cloud: DataFrame, post_cells: DataFrame, size: float, affinity: float = 1.0, pruning: float = 1.0, seed: int = 0, shape: Shape | Composition | None = None) -> DataFrame:
    """Edges from the cloud points (id, point_id, x, y, z) of cells to other cells whose solid (see points_in_shapes) holds them.

    Of a pair's n points, n * affinity are drawn with replacement, a fraction by chance; all if the affinity is 1. Of all edges
    pruning then keeps its part, rounded down.
    """
    hits = points_in_shapes(pre_cloud, post_cells, size, shape).select(F.col("a.id").alias("pre"), F.col("b.id").alias("post"), F.col("a.point_id").alias("point"))
    if affinity < 1:
        pairs = hits.groupBy("pre", "post").agg(F.count(F.lit(1)).alias("n")).withColumn("draws", stochastic_round(F.col("n") * affinity, keyed_uniform(f"{seed}-round", "pre", "post")))
        draws = pairs.where("draws > 0").select("pre", "post", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("draws"))).alias("draw"))
        draws = draws.withColumn("nth", F.pmod(keyed_bits(seed, "pre", "post", "draw"), F.col("n")) + 1)
        nth = hits.withColumn("nth", F.row_number().over(Window.partitionBy("pre", "post").orderBy("point")).cast("long"))
        hits = draws.join(nth, ["pre", "post", "nth"]).select("pre", "post", F.col("draw").alias("point"))
    if pruning < 1:
        hits = pruned(hits, pruning, ["pre", "post", "point"], seed)
    return edges_of(hits, F.col("pre"), F.col("post"))


def map_back(edges: DataFrame, mapping: DataFrame, side: str) -> DataFrame:
    """Locations on filtered morphologies as those on the originals.

    mapping: id, new_branch, new_point, branch_id, point_id. (-1, -1) stays; other locations that are not mapped raise.
    """
    m = mapping.select(F.col("id").alias(f"{side}_id"), F.col("new_branch").alias(f"{side}_branch"), F.col("new_point").alias(f"{side}_point"), F.col("branch_id").alias("_b"), F.col("point_id").alias("_p"))
    whole = (F.col(f"{side}_branch") == NONE) & (F.col(f"{side}_point") == NONE)
    out = edges.join(m, [f"{side}_id", f"{side}_branch", f"{side}_point"], "left")
    lost = F.raise_error(F.lit("a location is not on the filtered morphology")).cast("int")
    return out.withColumn(f"{side}_branch", F.when(whole, NONE).when(F.col("_b").isNotNull(), F.col("_b")).otherwise(lost)).withColumn(f"{side}_point", F.when(whole, NONE).when(F.col("_p").isNotNull(), F.col("_p")).otherwise(lost)).select(edges.columns)


def random_locations(edges: DataFrame, points: DataFrame, side: str, seed: int = 0) -> DataFrame:
    """Edges between whole cells with a keyed random point of the side's morphology (id, branch_id, point_id)."""
    ranked = points.select("id", "branch_id", "point_id").withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("branch_id", "point_id")) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("id")))
    sizes = ranked.where("k = 0").select(F.col("id").alias(f"{side}_id"), "n")
    drawn = edges.join(sizes, f"{side}_id").withColumn("k", F.pmod(keyed_bits(seed, "pre_id", "post_id"), F.col("n")))
    at = ranked.select(F.col("id").alias(f"{side}_id"), "k", "branch_id", "point_id")
    out = drawn.join(at, [f"{side}_id", "k"]).withColumn(f"{side}_branch", F.col("branch_id")).withColumn(f"{side}_point", F.col("point_id"))
    return out.select(edges.columns)


def output_tags(name: str, pairs: list[tuple[str, str]], tags: dict[tuple[str, str], str | None] | None = None) -> dict[tuple[str, str], str | None]:
    """The tag of each pair of cell types: the name alone for one pair, else name_pre_to_post; given tags win, None disables."""
    plain = {p: name if len(pairs) == 1 else f"{name}_{p[0]}_to_{p[1]}" for p in pairs}
    return plain | (tags or {})
