"""Tree-shaped geometries: points (morph_name, branch_id, point_id, x, y, z, radius, labels) and branches
(morph_name, branch_id, parent_branch, null for a root)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.keyed import keyed_bits
from lattica.functions.labels import has_any
from lattica.functions.rotation import euler_matrix, times
from lattica.operators.spatial import AXES
from lattica.operators.trees import along, tour

KEYS = ["morph_name", "branch_id"]


def _along():
    """The window along a branch."""
    return Window.partitionBy(*KEYS).orderBy("point_id")


def segments(points: DataFrame) -> DataFrame:
    """points with dx, dy, dz and length of the step to each from the point before it, null at a branch's start."""
    out = points.withColumns({f"d{c}": F.col(c) - F.lag(c).over(_along()) for c in AXES})
    return out.withColumn("length", F.sqrt(sum((F.col(f"d{c}") * F.col(f"d{c}") for c in AXES), F.lit(0.0))))


def arcs(points: DataFrame) -> DataFrame:
    """points with path (length from the branch's start) and arc, path as a part of the whole, 0 for a branch of no length."""
    out = segments(points).withColumn("path", F.coalesce(F.sum("length").over(_along().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    whole = F.max("path").over(Window.partitionBy(*KEYS))
    return out.withColumn("arc", F.when(whole > 0, F.col("path") / whole).otherwise(0.0)).drop("dx", "dy", "dz")


def morphometry(points: DataFrame) -> DataFrame:
    """Per branch: n, path_length, euclidean, max_displacement, fractal_dim, start, end, vector (from start to end) and versor.

    max_displacement is the largest distance of a point from the axis between start and end; it and the versor are null where
    these are one place. fractal_dim is the slope of log path length over log distance from the start, where both
    are above 0; 1 if that leaves fewer than two points.
    """
    whole = _along().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = [e(c).over(whole).alias(f"{k}{c}") for k, e in (("o", F.first), ("e", F.last)) for c in AXES]
    p = arcs(points).select("*", *ends).withColumn("away", F.sqrt(sum((F.pow(F.col(c) - F.col(f"o{c}"), F.lit(2.0)) for c in AXES), F.lit(0.0))))
    v, d = [F.col(f"e{c}") - F.col(f"o{c}") for c in AXES], [F.col(c) - F.col(f"o{c}") for c in AXES]
    across = [v[1] * d[2] - v[2] * d[1], v[2] * d[0] - v[0] * d[2], v[0] * d[1] - v[1] * d[0]]
    axis = F.sqrt(sum((c * c for c in v), F.lit(0.0)))
    p = p.withColumn("beside", F.when(axis > 0, F.sqrt(sum((c * c for c in across), F.lit(0.0))) / axis))
    both = (F.col("away") > 0) & (F.col("path") > 0)
    slope = F.regr_slope(F.when(both, F.log("path")), F.when(both, F.log("away")))
    last = F.max_by(F.struct(*AXES, "away"), "point_id")
    out = p.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.max("path").alias("path_length"), F.max("beside").alias("max_displacement"), F.min_by(F.struct(*AXES), "point_id").alias("start"), slope.alias("fractal_dim"), F.count(F.when(both, 1)).alias("usable"), last.alias("end"))
    return out.select(*KEYS, "n", "path_length", F.col("end.away").alias("euclidean"), "max_displacement", F.when(F.col("usable") < 2, 1.0).otherwise(F.col("fractal_dim")).alias("fractal_dim"), *(F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in ("start", "end") for c in AXES)).withColumns({f"v{c}": F.col(f"end_{c}") - F.col(f"start_{c}") for c in AXES}).withColumns({f"u{c}": F.when(F.col("euclidean") > 0, F.col(f"v{c}") / F.col("euclidean")) for c in AXES})


def bounds(points: DataFrame) -> DataFrame:
    return points.groupBy("morph_name").agg(*(F.min(c).alias(f"l{c}") for c in AXES), *(F.max(c).alias(f"h{c}") for c in AXES))


def origin(points: DataFrame, branches: DataFrame) -> DataFrame:
    """The mean of the roots' first points."""
    roots = branches.where("parent_branch is null").select(*KEYS)
    starts = points.join(roots, KEYS).where("point_id = 0")
    return starts.groupBy("morph_name").agg(*(F.avg(c).alias(c) for c in AXES))


def adjacency(branches: DataFrame) -> DataFrame:
    """The children of each branch, sorted; leaves have none."""
    kids = branches.where("parent_branch is not null").groupBy("morph_name", F.col("parent_branch").alias("branch_id")).agg(F.array_sort(F.collect_list("branch_id")).alias("children"))
    return branches.select(*KEYS).join(kids, KEYS, "left").withColumn("children", F.coalesce("children", F.array().cast("array<int>")))


def terminal(branches: DataFrame) -> DataFrame:
    """Branches without children."""
    parents = branches.where("parent_branch is not null").select("morph_name", F.col("parent_branch").alias("branch_id")).distinct()
    return branches.join(parents, KEYS, "left_anti")


def labelled_branches(points: DataFrame, labels: list[str]) -> DataFrame:
    """Branches with a point that has one of the labels."""
    return points.groupBy(*KEYS).agg(F.bool_or(has_any(F.col("labels"), labels)).alias("has")).where("has").select(*KEYS)


def list_labels(points: DataFrame) -> DataFrame:
    return points.select("morph_name", F.explode("labels").alias("label")).groupBy("morph_name").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def content_hash(points: DataFrame) -> DataFrame:
    """A hash of each morphology's points, radii and labels, of all branches, equal for equal ones whatever their names.

    Folded commutatively. Morphologies that differ in radii or inner branches alone count as different here.
    """
    h = F.xxhash64("branch_id", "point_id", *AXES, "radius", F.array_join("labels", ","))
    return points.groupBy("morph_name").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("hash"))


def rotate(points: DataFrame, rx: float, ry: float, rz: float, about: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    m = euler_matrix(F.lit(rx), F.lit(ry), F.lit(rz))
    moved = times(m, [F.col(c) - o for c, o in zip(AXES, about, strict=True)])
    return points.withColumns({c: v + o for c, v, o in zip(AXES, moved, about, strict=True)})


def translate(points: DataFrame, by: tuple[float, float, float]) -> DataFrame:
    return points.withColumns({c: F.col(c) + d for c, d in zip(AXES, by, strict=True)})


def swap_axes(points: DataFrame, a: str, b: str) -> DataFrame:
    return points.withColumns({a: F.col(b), b: F.col(a)})


def center(points: DataFrame, branches: DataFrame) -> DataFrame:
    """Moved so that the origin is 0."""
    at = origin(points, branches).select("morph_name", *(F.col(c).alias(f"o{c}") for c in AXES))
    return points.join(at, "morph_name").withColumns({c: F.col(c) - F.col(f"o{c}") for c in AXES}).select(points.columns)


def root_points(points: DataFrame, branches: DataFrame) -> DataFrame:
    """(morph_name, branch_id, root) of every branch: the root branch that it hangs on; a root hangs on itself."""
    own = branches.select(*KEYS, F.col("parent_branch").alias("up"), F.when(F.col("parent_branch").isNull(), F.col("branch_id")).alias("root"))
    return along(own, KEYS, "up", nearest=["root"]).drop("up")


def collapse(points: DataFrame, branches: DataFrame, on: tuple[float, float, float] | None = None) -> DataFrame:
    """Each tree moved as a whole, so that its root starts at one point for all: `on`, or else the origin."""
    starts = points.groupBy(*KEYS).agg(F.min_by(F.struct(*AXES), "point_id").alias("s"))
    at = root_points(points, branches).join(starts.select("morph_name", F.col("branch_id").alias("root"), "s"), ["morph_name", "root"]).select(*KEYS, "s")
    if on is None:
        to = origin(points, branches).select("morph_name", F.struct(*AXES).alias("to"))
        at = at.join(to, "morph_name")
    else:
        at = at.withColumn("to", F.struct(*(F.lit(float(o)).alias(c) for o, c in zip(on, AXES, strict=True))))
    return points.join(at, KEYS).withColumns({c: F.col(c) + F.col(f"to.{c}") - F.col(f"s.{c}") for c in AXES}).select(points.columns)


def root_rotate(points: DataFrame, branches: DataFrame, rx: float, ry: float, rz: float, downstream_of: int = 0) -> DataFrame:
    """Each tree turned about the start of its root; with downstream_of, about that point of the root, points before it left alone.

    The latter needs a single root a morphology: rows of others raise.
    """
    roots = root_points(points, branches)
    about = points.where(F.col("point_id") == downstream_of).select("morph_name", F.col("branch_id").alias("root"), F.struct(*AXES).alias("about"))
    alone = branches.where("parent_branch is null").groupBy("morph_name").agg(F.count(F.lit(1)).alias("roots"))
    p = points.join(roots, KEYS).join(about, ["morph_name", "root"]).join(alone, "morph_name")
    turned = times(euler_matrix(F.lit(rx), F.lit(ry), F.lit(rz)), [F.col(c) - F.col(f"about.{c}") for c in AXES])
    stays = (F.col("branch_id") == F.col("root")) & (F.col("point_id") < downstream_of)
    lost = F.raise_error(F.lit("several roots can't be turned from within a branch")).cast("double")
    new = {c: F.when(stays, F.col(c)).otherwise(t + F.col(f"about.{c}")) for c, t in zip(AXES, turned, strict=True)}
    if downstream_of:
        new = {c: F.when(F.col("roots") > 1, lost).otherwise(v) for c, v in new.items()}
    return p.withColumns(new).select(points.columns)


def ancestors(branches: DataFrame) -> DataFrame:
    """(morph_name, branch_id, ancestor, distance) for all branches above each: as many rows as there are such pairs.

    Where the order of branches or the ones below some are enough, trees.tour and trees.below give them without pairs.
    """
    up = branches.select(*KEYS, F.col("parent_branch").alias("up"), F.array_compact(F.array("parent_branch")).alias("path"))
    paths = along(up, KEYS, "up", lists=["path"])
    return paths.select(*KEYS, F.posexplode("path").alias("place", "ancestor")).select(*KEYS, "ancestor", (F.col("place") + 1).alias("distance"))


def close_gaps(points: DataFrame, branches: DataFrame) -> DataFrame:
    """Branches moved, with all below them, so that each starts where its parent ends; roots stay."""
    ends = points.groupBy(*KEYS).agg(F.min_by(F.struct(*AXES), "point_id").alias("start"), F.max_by(F.struct(*AXES), "point_id").alias("end"))
    above = ends.select("morph_name", F.col("branch_id").alias("parent_branch"), "end")
    gap = branches.select(*KEYS, "parent_branch").join(ends.select(*KEYS, "start"), KEYS, "left").join(above, ["morph_name", "parent_branch"], "left")
    own = gap.select(*KEYS, F.col("parent_branch").alias("up"), *(F.coalesce(F.col(f"end.{c}") - F.col(f"start.{c}"), F.lit(0.0)).alias(f"g{c}") for c in AXES))
    total = along(own, KEYS, "up", sums=[f"g{c}" for c in AXES]).drop("up")
    return points.join(total, KEYS, "left").withColumns({c: F.col(c) + F.coalesce(F.col(f"g{c}"), F.lit(0.0)) for c in AXES}).select(points.columns)


def filtered(points: DataFrame, branches: DataFrame, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """Only labelled points: each run of them becomes a branch of its own.

    Points get new branch and point numbers and keep the old ones as src_branch and src_point. The first run of a
    branch hangs on the last run of the nearest branch above it that has one; later runs hang on the run before.
    """
    keep = points.withColumn("keep", has_any(F.col("labels"), labels))
    starts = keep.withColumn("new", (F.col("keep") & ~F.coalesce(F.lag("keep").over(_along()), F.lit(False))).cast("int"))
    runs = starts.withColumn("run", F.sum("new").over(_along())).where("keep")
    order = Window.partitionBy("morph_name").orderBy("branch_id", "run")
    table = runs.select(*KEYS, "run").distinct().withColumn("id", (F.row_number().over(order) - 1).cast("int"))
    last = table.groupBy(*KEYS).agg(F.max("id").alias("last"))
    up = branches.select(*KEYS, F.col("parent_branch").alias("up")).join(last, KEYS, "left")
    held = along(up, KEYS, "up", nearest=["last"]).select("morph_name", F.col("branch_id").alias("parent_branch"), F.col("last").alias("above"))
    parent = branches.select(*KEYS, "parent_branch").join(held, ["morph_name", "parent_branch"]).select(*KEYS, "above")
    before = table.select(*KEYS, (F.col("run") + 1).alias("run"), F.col("id").alias("before"))
    tree = table.join(before, [*KEYS, "run"], "left").join(parent, KEYS, "left")
    tree = tree.select("morph_name", F.col("id").alias("branch_id"), F.when(F.col("run") == 1, F.col("above")).otherwise(F.col("before")).alias("parent_branch"))
    inner = Window.partitionBy("morph_name", "id").orderBy("point_id")
    out = runs.join(table, [*KEYS, "run"]).withColumn("n", (F.row_number().over(inner) - 1).cast("int"))
    return out.select("morph_name", F.col("id").alias("branch_id"), F.col("n").alias("point_id"), *AXES, "radius", "labels", F.col("branch_id").alias("src_branch"), F.col("point_id").alias("src_point")), tree


def simplify(points: DataFrame, epsilon: float) -> DataFrame:
    """Points of each branch that Ramer, Douglas and Peucker's rule keeps: both ends, and what lies further than
    epsilon from the line of its stretch. A batch takes many branches, one after another. A negative epsilon raises."""
    if epsilon < 0:
        raise ValueError("the tolerance must not be negative")

    def keep(p: np.ndarray) -> np.ndarray:
        on, stack = np.zeros(len(p), bool), [(0, len(p) - 1)]
        on[[0, -1]] = True
        while stack:
            a, b = stack.pop()
            if b - a < 2:
                continue
            line = p[b] - p[a]
            rest = p[a + 1 : b] - p[a]
            n = np.linalg.norm(line)
            d = np.linalg.norm(rest, axis=1) if n == 0 else np.linalg.norm(np.cross(rest, line), axis=1) / n
            k = int(d.argmax())
            if d[k] > epsilon:
                on[a + 1 + k] = True
                stack += [(a, a + 1 + k), (a + 1 + k, b)]
        return on

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in rows:
            table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            names, ids = table.column("morph_name").to_pylist(), table.column("branch_id").to_pylist()
            starts = [i for i in range(len(names)) if not i or names[i] != names[i - 1] or ids[i] != ids[i - 1]]
            if not starts:
                continue
            held = table.slice(starts[-1])  # its branch may go on in the next batch
            yield from kept(table, starts)
        if held is not None:
            yield from kept(held, [0, held.num_rows])

    def kept(table: pa.Table, starts: list[int]) -> Iterator[pa.RecordBatch]:
        at = np.stack([table.column(c).to_numpy() for c in AXES], 1)
        masks = [keep(at[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
        if masks:
            yield from table.slice(0, starts[-1]).filter(pa.array(np.concatenate(masks))).to_batches()

    ordered = points.repartition(*KEYS).sortWithinPartitions(*KEYS, "point_id")
    return ordered.mapInArrow(run, points.schema)


def closest_point(points: DataFrame, to: tuple[float, float, float]) -> DataFrame:
    d2 = sum((F.pow(F.col(c) - o, F.lit(2.0)) for c, o in zip(AXES, to, strict=True)), F.lit(0.0))
    return points.groupBy("morph_name").agg(F.min_by(F.struct("branch_id", "point_id"), F.struct(d2, "branch_id", "point_id")).alias("at"), F.sqrt(F.min(d2)).alias("distance")).select("morph_name", "at.branch_id", "at.point_id", "distance")


def random_point(points: DataFrame, seed: int = 0) -> DataFrame:
    return points.groupBy("morph_name").agg(F.min_by(F.struct("branch_id", "point_id"), keyed_bits(seed, "morph_name", "branch_id", "point_id")).alias("at")).select("morph_name", "at.*")


#: SWC type numbers.
TAGS = {"soma": 1, "axon": 2, "dendrites": 3}


def to_swc(points: DataFrame, branches: DataFrame) -> DataFrame:
    """SWC rows: morph_name, sample, tag, x, y, z, radius, parent (-1 for a root's first point).

    Points are numbered by branch and place; a branch's first point has its parent branch's last as parent. Labels
    other than soma, axon and dendrites have no SWC type: 0.
    """
    order = Window.partitionBy("morph_name").orderBy("branch_id", "point_id")
    p = points.withColumn("sample", F.row_number().over(order))
    tag = F.lit(0)
    for label, number in reversed(TAGS.items()):
        tag = F.when(has_any(F.col("labels"), [label]), number).otherwise(tag)
    last = p.groupBy(*KEYS).agg(F.max_by("sample", "point_id").alias("above")).withColumnRenamed("branch_id", "parent_branch")
    tree = branches.join(last, ["morph_name", "parent_branch"], "left").select(*KEYS, "above")
    p = p.withColumn("before", F.lag("sample").over(_along())).join(tree, KEYS, "left")
    return p.select("morph_name", "sample", tag.alias("tag"), *AXES, "radius", F.coalesce("before", "above", F.lit(-1)).alias("parent"))


def parse_swc(rows: DataFrame, skip_boundary_labels: list[str] | None = None, tags: dict[int, list[str]] | None = None, labels_of_next: bool = False) -> DataFrame:
    """points of SWC rows (morph_name, sample, tag, x, y, z, radius, parent), with parent_branch on each.

    A branch ends where a sample has other than one child; its children start with a copy of it, with its own labels or,
    with labels_of_next, those of the point after it. `tags` adds or replaces labels of type numbers; others are called tag_<number>. Samples all of whose labels are in
    skip_boundary_labels are a boundary: a child of another type starts a branch there, and no child gets the copy.
    Branches are numbered depth first, children in the order of samples. A parent that is no sample raises.

    Samples that follow each other without a branch are drawn together by pointer jumping, all files at once.
    """
    names = {number: [label] for label, number in TAGS.items()} | (tags or {})
    edge = [number for number, labels in names.items() if set(labels) <= set(skip_boundary_labels or [])]
    labels = F.array(F.concat(F.lit("tag_"), F.col("tag").cast("string")))
    for number, own in names.items():
        labels = F.when(F.col("tag") == number, F.array(*(F.lit(x) for x in own))).otherwise(labels)
    s = rows.select("morph_name", F.col("sample").cast("int").alias("sample"), F.col("tag").cast("int").alias("tag"), *AXES, "radius", F.col("parent").cast("int").alias("parent"))
    s = s.withColumn("labels", labels)
    kids = s.groupBy("morph_name", "parent").agg(F.count(F.lit(1)).alias("kids"))
    above = s.select("morph_name", F.col("sample").alias("parent"), F.struct("tag", "labels", *AXES, "radius").alias("above"))
    s = s.join(kids, ["morph_name", "parent"]).join(above, ["morph_name", "parent"], "left")
    lost = F.raise_error(F.concat(F.lit("no sample "), F.col("parent").cast("string"))).cast("boolean")
    root, is_edge, above_edge = F.col("parent") == -1, F.col("tag").isin(edge), F.col("above.tag").isin(edge)
    head = F.when(root, True).when(F.col("above").isNull(), lost).otherwise((F.col("kids") != 1) | (above_edge & ~is_edge))
    s = s.withColumn("is_head", head).withColumn("copies", (F.col("is_head") & ~root & ~above_edge).cast("int"))
    way = s.select("*", F.when(~F.col("is_head"), F.col("parent")).alias("up"), F.when(F.col("is_head"), F.struct("sample", "copies")).alias("head"), (~F.col("is_head")).cast("int").alias("steps"))
    s = along(way, ["morph_name", "sample"], "up", sums=["steps"], nearest=["head"])
    of = s.select("morph_name", F.col("sample").alias("parent"), F.col("head.sample").alias("on"))
    heads = s.where("is_head").select("morph_name", "sample", "parent").join(of, ["morph_name", "parent"], "left")
    toured = tour(heads, node="sample", parent="on").select("morph_name", F.col("sample").alias("head_sample"), "on", F.col("preorder").cast("int").alias("branch_id"))
    parents = toured.select("morph_name", F.col("head_sample").alias("on"), F.col("branch_id").alias("parent_branch"))
    numbered = toured.join(parents, ["morph_name", "on"], "left").select("morph_name", "head_sample", "branch_id", "parent_branch")
    s = s.withColumn("head_sample", F.col("head.sample")).join(numbered, ["morph_name", "head_sample"])
    out = ["morph_name", "branch_id", "point_id", *AXES, "radius", "labels", "parent_branch"]
    own = s.withColumn("point_id", (F.col("steps") + F.col("head.copies")).cast("int")).select(out)
    copied = s.where("copies = 1").select("morph_name", "branch_id", F.lit(0).alias("point_id"), *(F.col(f"above.{c}").alias(c) for c in (*AXES, "radius")), F.col("labels" if labels_of_next else "above.labels").alias("labels"), "parent_branch")
    return own.unionByName(copied)
