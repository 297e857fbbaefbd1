"""Connectivity operators: what is at the edge of solids, and that what is moved between machines goes with the input, not with the edges."""

import math
import random

import pytest
from helpers import DATA
from pyspark.sql import functions as F

from lattica.functions import shapes as S
from lattica.operators import connectivity as C
from lattica.operators import voxels as V
from lattica.queries import QUERIES, block_edges


def test_points_in_the_margin_of_solids_are_found(spark):
    """Just beyond the surface of a sphere, and beyond the caps and the side of cylinders, thin ones too: inside by the solids' own margin."""
    cells = spark.createDataFrame([(1, 100.0, 0.0, 0.0)], "id long, x double, y double, z double")
    drum = S.Cylinder((0.0, 0.0, -30.0), 25.0, (0.0, 0.0, 30.0)).rotated(90.0, 0.0, 0.0)
    thin = S.Cylinder((0.0, 0.0, 0.0), 0.001, (0.0, 0.0, 10.0))
    for solid, inside, outside in (
        (drum, [(0.0, 30.0005, 0.0), (25.00001, 0.0, 0.0), (0.0, -30.0005, 3.0)], [(0.0, 30.0015, 0.0), (25.0001, 0.0, 0.0)]),
        (thin, [(0.03, 0.0, 5.0), (0.0, 0.0, -0.0005)], [(0.04, 0.0, 5.0)]),
        (S.Sphere((5.0, 0.0, 0.0), 30.0), [(35.0005, 0.0, 0.0)], [(35.0015, 0.0, 0.0)]),
    ):
        rows = [(k, 0, 0, 100 + p[0], p[1], p[2]) for k, p in enumerate(inside + outside)]
        points = spark.createDataFrame(rows, "id long, branch_id int, point_id int, x double, y double, z double")
        got = C.shape_to_morphology(cells, points, 60.0, shape=solid)
        assert sorted(r.post_id for r in got.collect()) == list(range(len(inside)))


def test_margin_on_the_post_side(spark):
    """The mirror image: the pre side keeps branch and point."""
    cells = spark.createDataFrame([(1, 100.0, 0.0, 0.0)], "id long, x double, y double, z double")
    drum = S.Cylinder((0.0, 0.0, -30.0), 25.0, (0.0, 0.0, 30.0)).rotated(90.0, 0.0, 0.0)
    points = spark.createDataFrame([(7, 2, 4, 100.0, 30.0005, 0.0), (8, 2, 4, 100.0, 30.0015, 0.0)], "id long, branch_id int, point_id int, x double, y double, z double")
    got = C.morphology_to_shape(points, cells, 60.0, shape=drum).collect()
    assert [(r.pre_id, r.pre_branch, r.pre_point, r.post_id) for r in got] == [(7, 2, 4, 1)]


def _plain_contacts(pre, post, boxes_of, meet, contacts, seed):
    """Draws of voxel_intersection one by one: {(pre, post): [(branch, point, branch, point), ...]} of two lists of points."""
    import hashlib

    def voxels(rows, side):
        out = {}
        for i, b, p, *at in rows:
            out.setdefault(i, {}).setdefault(boxes_of(at, side), []).append((b, p))
        return out

    found, a, b = [], voxels(pre, 0), voxels(post, 1)
    for i in a:
        for j in b:
            shared = [(sorted(a[i][v]), sorted(b[j][w])) for v in sorted(a[i]) for w in sorted(b[j]) if meet(v, w)]
            pairs = [(*p, *q) for ps, qs in shared for p in ps for q in qs]
            for k in range(1, contacts + 1) if pairs else ():
                pick = int(hashlib.md5(f"{seed}|{i}|{j}|{k}".encode()).hexdigest()[:13], 16) % len(pairs)
                found.append((i, pairs[pick][:2], j, pairs[pick][2:]))
    return sorted(found)


def _clouds(seed, n, far=()):
    rng = random.Random(seed)
    return [(i, b, p, *(rng.gauss(0, 30) + (far[i] if i < len(far) else 0.0) for _ in range(3))) for i in range(n) for b in range(2) for p in range(6)]


_POINTS = "id long, branch_id int, point_id int, x double, y double, z double"


def _found(edges):
    return sorted((r.pre_id, (r.pre_branch, r.pre_point), r.post_id, (r.post_branch, r.post_point)) for r in edges.collect())


@pytest.mark.parametrize("far", [(), (1e16, 1e16, -1e16)])
def test_voxel_intersection_draws(spark, far):
    """Against draws one by one, also where voxels have no number of 63 bits."""
    pre, post = _clouds(1, 12, far), _clouds(2, 9, far)
    grid = lambda at, _: tuple(math.floor(v / 25.0) for v in at)
    a, b = (spark.createDataFrame(x, _POINTS) for x in (pre, post))
    want = _plain_contacts(pre, post, grid, lambda v, w: v == w, 3, 4)
    assert want and _found(C.voxel_intersection(a, b, 25.0, contacts=3, seed=4)) == want
    assert C.voxel_intersection(a, b, 25.0, contacts=0).count() == 0


def test_voxel_box_intersection_draws(spark):
    pre, post = _clouds(3, 9), _clouds(4, 7)
    grid = lambda at, side: tuple(math.floor(v / (20.0, 45.0)[side]) for v in at)
    meet = lambda v, w: all(i * 20 <= j * 45 + 45 and j * 45 <= i * 20 + 20 for i, j in zip(v, w, strict=True))
    a, b = (V.voxel_boxes(spark.createDataFrame(x, _POINTS), ["id"], s) for x, s in ((pre, 20.0), (post, 45.0)))
    want = _plain_contacts(pre, post, grid, meet, 2, 9)
    assert want and _found(C.voxel_box_intersection(a, b, 20.0, contacts=2, seed=9)) == want


def test_part_of_the_post_cells(spark):
    a = spark.createDataFrame(_clouds(5, 20), _POINTS)
    every = C.voxel_intersection(a, a, 25.0, contacts=2, seed=1)
    kept = C.voxel_intersection(a, a, 25.0, contacts=2, seed=1, affinity=0.5)
    want = {(r.pre_id, r.post_id) for r in C.keep_affinity(every.select("pre_id", "post_id").distinct(), "pre_id", ["post_id"], 0.5, 1).collect()}
    assert want and _found(kept) == [e for e in _found(every) if (e[0], e[2]) in want]


@pytest.mark.parametrize("name", ["voxel_intersection", "voxel_intersection_turned", "voxel_intersection_sizes", "labelled_sides"])
def test_pairs_of_cells_are_neither_shuffled_nor_written(spark, name):
    """The topmost join makes the pairs: all exchanges of the plan are below it, and it reads no written edges."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Join ") < plan.index("Exchange ") and "/edges-" not in plan


@pytest.mark.parametrize("name", [
    "cone_to_morphology",
    "morphology_to_ellipsoid",
    "morphology_to_shape",
    "morphology_to_sphere",
    "cuboid_to_morphology",
    "sphere_to_morphology",
    "morphology_to_parallelepiped",
    "parallelepiped_to_morphology",
])
def test_points_in_solids_are_not_shuffled(spark, name):
    """All hits are kept, so no exchange stands above the join that makes them."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Join ") < plan.index("Exchange ")


def test_a_write_makes_a_bounded_number_of_files(spark, tmp_path, monkeypatch):
    """However few rows a file should get; all rows are there, and scans still open only some files."""
    from lattica.sources import versions
    from lattica.sources.store import NetworkStore

    monkeypatch.setattr(versions, "MOST_FILES", 8)
    store = NetworkStore(spark, str(tmp_path / "net"), file_rows=5)
    store.append("connections", block_edges(spark, DATA))
    files = store.versions.files("connections")
    assert 4 <= files.count() <= 8 and files.agg({"rows": "sum"}).first()[0] == store.read("connections").count() == block_edges(spark, DATA).count()
    assert len(store.read("connections", post_chunk=[0]).inputFiles()) < files.count()


def test_block_edges_come_from_one_join(spark):
    """Cells bring their type, chunk and place into the join; no edge looks them up."""
    plan = block_edges(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join ") == 1


@pytest.mark.parametrize("ratio", [0.0, 0.25, 0.3333, 0.9999])
def test_pruning_ranks_one_block(spark, ratio):
    """Exactly the part asked for, the same however rows lie; whole blocks are no part of the window."""
    edges = spark.range(20_000).select((F.col("id") % 77).alias("pre"), F.col("id").alias("post"))
    kept = C.pruned(edges, ratio, ["pre", "post"], 2)
    rows = {r.post for r in kept.collect()}
    assert len(rows) == kept.count() == math.floor(20_000 * ratio)
    assert rows == {r.post for r in C.pruned(edges.repartition(7, "pre"), ratio, ["pre", "post"], 2).collect()}
    if ratio == 0.25:
        assert rows != {r.post for r in C.pruned(edges, ratio, ["pre", "post"], 3).collect()}
        assert 0.2 < sum(p < 10_000 for p in rows) / 10_000 < 0.3
        assert kept._jdf.queryExecution().optimizedPlan().toString().startswith("Union")
