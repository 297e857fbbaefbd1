"""Fixed values and invariants that no table query covers."""

import gzip
import json
import math

import numpy as np
import pytest
from helpers import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.functions import keyed, shapes
from lattica.functions.chunks import chunk_coordinates, chunk_id
from lattica.operators import connectivity, morphology, network, ontology, placement, spatial, trees, voxels
from lattica.plans import configuration, topology
from lattica.plans.network import Plan, Strategy
from lattica.sources import imports, nrrd
from lattica.sources.store import NetworkStore, open_store
from lattica.streaming.windows import time_slices, windowed_counts

#: Chunk coordinates and their packed numbers.
CHUNK_IDS = [
    ((0, 0, 0), 0), ((1, 0, 0), 1), ((0, 1, 0), 65536), ((0, 0, 1), 4294967296), ((-1, 0, 0), 65535), ((0, -1, 0), 4294901760),
    ((0, 0, -1), 281470681743360), ((2, -3, -9), 281440616775682), ((-32768, 0, 0), 32768), ((-32768, 1, 0), 98304), ((-32768, -1, 0), 4294934528),
]


def test_chunk_ids(spark):
    df = spark.createDataFrame([(*c, i) for c, i in CHUNK_IDS], "x int, y int, z int, id long")
    got = df.select("x", "y", "z", "id", chunk_id(F.col("x"), F.col("y"), F.col("z")).alias("packed"), *(v.alias(n) for v, n in zip(chunk_coordinates(F.col("id")), "abc", strict=True))).collect()
    assert all(r.packed == r.id and (r.a, r.b, r.c) == (r.x, r.y, r.z) for r in got)
    with pytest.raises(Exception, match="16 bits"):
        spark.range(1).select(chunk_id(F.lit(40000), F.lit(0), F.lit(0))).collect()


def test_chunk_round_trip(spark):
    rng = np.random.default_rng(1)
    rows = [tuple(int(v) for v in r) for r in rng.integers(-32768, 32768, (10_000, 3))]
    df = spark.createDataFrame(rows, "x int, y int, z int").withColumn("c", chunk_id(F.col("x"), F.col("y"), F.col("z")))
    back = chunk_coordinates(F.col("c"))
    assert df.where((back[0] != F.col("x")) | (back[1] != F.col("y")) | (back[2] != F.col("z"))).isEmpty()


def test_box_query(spark):
    columns = "id int, lx double, ly double, lz double, hx double, hy double, hz double"
    boxes = spark.createDataFrame([(i, 2.0 * i, 0.0, 0.0, 2.0 * i + 2, 2.0, 2.0) for i in range(3)], columns)
    queries = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 3.0, 0.0, 0.0), (1, 300.0, 0.0, 0.0, 300.0, 0.0, 0.0), (2, 4.0, 0.0, 0.0, 6.0, 0.0, 0.0)], columns)
    hits = spatial.box_query(boxes, queries, 3.0).collect()
    assert sorted((r.query_id, r.box_id) for r in hits) == [(0, 0), (0, 1), (2, 1), (2, 2)]
    assert sorted(r.box_id for r in spatial.box_query(boxes, queries, 3.0, unique=True).collect()) == [0, 1, 2]


def test_all_to_all_counts(spark):
    c = spark.range(100)
    assert connectivity.all_to_all(c, c).count() == 10_000


def test_degrees_are_exact(spark):
    e = connectivity.fixed_indegree(spark.range(90), spark.range(30), 50)
    assert {r["count"] for r in e.groupBy("post_id").count().collect()} == {50}
    assert e.distinct().count() == e.count()
    with pytest.raises(ValueError):
        connectivity.fixed_indegree(spark.range(10), spark.range(3), 50)


def test_colliding(spark):
    s = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 2.0), (1, 3.0, 0.0, 0.0, 2.0), (2, 30.0, 0.0, 0.0, 2.0)], "id int, x double, y double, z double, radius double")
    assert [(r.a.id, r.b.id, r.overlap) for r in spatial.colliding(s, 2.0).collect()] == [(0, 1, 1.0)]


def test_shapes():
    assert shapes.Sphere((0, 0, 0), 2.0).volume() == pytest.approx(4 / 3 * math.pi * 8)
    assert shapes.Ellipsoid((0, 0, 0), (50.0, 100.0, 10.0)).box() == ((-50, -100, -10), (50, 100, 10))
    assert shapes.Ellipsoid((0, 0, 0), (1.0, 2.0, 3.0)).volume() == pytest.approx(6 * math.pi)
    assert shapes.cuboid((0, 0, 0), (0, 0, 20), 5.0, 10.0).box() == ((-2.5, -5, 0), (2.5, 5, 20))
    assert shapes.Sphere((0, 0, 0), 10.0).n_points(5.0) == 33


def test_stack_and_layers(spark):
    region = topology.Box("r", (0.0, 0.0, 0.0), (100.0, 100.0, 100.0))
    stack = topology.Stack("s", (topology.Layer("a", 150.0), topology.Layer("b", 150.0)))
    assert stack.height(region) == 300
    anchored = topology.Stack("s", (topology.Layer("a", 150.0), topology.Layer("b", 150.0)), anchor="b").layout(region)
    assert [b.low[2] for b in anchored] == [-150, 0]
    layer = topology.Layer("l", 150.0).layout(region)
    ids = lambda b: sorted(r.chunk_id for r in topology.chunks_of(spark, b, 100.0).collect())
    assert ids(layer) == [0, 4294967296]
    assert ids([b.translate((100.0, 0.0, 0.0)) for b in layer]) == [1, 4294967297]
    assert len(ids([b.translate((101.0, 0.0, 0.0)) for b in layer])) == 4


def test_indicators(spark):
    with pytest.raises(placement.IndicatorError):
        placement.Indicator().estimate(F.lit(1.0), F.lit(1.0), F.lit(1.0))
    with pytest.raises(placement.IndicatorError):
        placement.Indicator(relative_to=placement.Indicator(count=3)).estimate(F.lit(1.0), F.lit(1.0), F.lit(1.0))
    both = placement.Indicator(count=1, density=2.0).over(placement.Indicator(radius=3.0))
    assert both.radius == 3.0 and spark.range(1).select(both.estimate(F.lit(5.0), F.lit(1.0), F.lit(10.0)).alias("e")).first().e == 10.0


def test_packing_states(spark):
    state = lambda n: placement.packing_factor(spark.createDataFrame([(1.0, n)], "radius double, n int"), 1000.0).first().state
    assert [state(n) for n in (10, 60, 110, 200)] == ["ok", "dense", "too dense", "impossible"]


def test_lattice_refuses(spark):
    for angle, density in ((90.0, 0.001), (10.0, 1.0)):
        with pytest.raises(ValueError):
            placement.lattice_points(spark, (0, 0, 0), (100, 100, 10), 20.0, angle, 5.0, density)


def test_equal_sides():
    assert voxels.equal_sides((10.0, 10.0, 10.0), 27) == (3, 3, 3)
    assert voxels.equal_sides((10.0, 0.0, 10.0), 16) == (4, 1, 4)


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.lists(st.sampled_from("abcdefxyz"), max_size=3)))
def test_order_respects_dependencies(depends):
    try:
        order = configuration.in_order(depends)
    except Exception as e:
        assert "Cycle" in type(e).__name__
        return
    assert sorted(order) == sorted(depends)
    assert all(order.index(d) < order.index(k) for k, v in depends.items() for d in v if d in depends)


def test_configuration_references(tmp_path):
    (tmp_path / "base.json").write_text(json.dumps({"a": {"x": 1, "y": {"z": 2}}, "b": 3}))
    tree = configuration.parse(json.dumps({"here": {"k": 5}, "one": {"$ref": "base.json#/a", "y": {"w": 4}}, "two": {"$ref": "base.json#/", "$import": ["b"]}, "three": {"$ref": "#/here"}}), str(tmp_path))
    assert tree == {"here": {"k": 5}, "one": {"x": 1, "y": {"z": 2, "w": 4}}, "two": {"b": 3}, "three": {"k": 5}}
    with pytest.raises(configuration.ReferenceError_):
        configuration.parse('{"a": {"$ref": "#/nowhere"}}')
    with pytest.raises(configuration.ReferenceError_):
        configuration.parse('{"a": {"$ref": "#/a"}}')
    assert configuration.with_defaults({"network": {"x": 1.0}})["network"]["y"] == 200.0


def test_csv_imports(spark, tmp_path):
    (tmp_path / "p.csv").write_text(" X ;y;Z;Type;size\n1;2;3;a;7\n150;bad;3;a;\n5;5;5;b;1\n")
    p = imports.points_from_csv(imports.read_csv(spark, str(tmp_path / "p.csv"), ";"), 100.0, "a").collect()
    assert [(r.x, r.chunk_id, r.extra["size"]) for r in p][0] == (1.0, 0, 7.0) and p[1].chunk_id is None and math.isnan(p[1].y)
    (tmp_path / "e.csv").write_text("pre,post,w\n1,2,5\n3.0,4,1\nx,1,1\n-1,2,2\n")
    assert sorted((r.pre_id, r.post_id) for r in imports.edges_from_csv(imports.read_csv(spark, str(tmp_path / "e.csv"))).collect()) == [(1, 2), (3, 4)]


def test_nrrd(spark, tmp_path):
    data = np.arange(24, dtype="<i2").reshape(2, 3, 4)
    head = "NRRD0004\ntype: int16\ndimension: 3\nsizes: 2 3 4\nencoding: gzip\nendian: little\n\n"
    (tmp_path / "v.nrrd").write_bytes(head.encode() + gzip.compress(data.tobytes(order="F")))
    got = nrrd.read_nrrd(spark, str(tmp_path / "v.nrrd")).collect()
    assert len(got) == 24 and all(data[r.ix, r.iy, r.iz] == r.value for r in got)


def test_swc_file(spark, tmp_path):
    (tmp_path / "m.swc").write_text("# a cell\n1 1 0 0 0 2 -1\n2 3 0 1 0 1 1\n3 3 0 2 0 1 2\n4 2 1 2 0 1 3\n5 3 -1 2 0 1 3\n")
    p = morphology.parse_swc(imports.read_swc(spark, str(tmp_path / "m.swc")))
    by = {}
    for r in p.orderBy("branch_id", "point_id").collect():
        by.setdefault(r.branch_id, []).append((r.x, r.y, r.labels[0], r.parent_branch))
    assert [len(by[b]) for b in sorted(by)] == [3, 2, 2]
    assert by[1] == [(0.0, 2.0, "dendrites", 0), (1.0, 2.0, "axon", 0)]


def test_simplify(spark):
    rows = [("m", 0, i, float(i), 0.01 if i == 2 else 3.0 if i == 4 else 0.0, 0.0, 1.0, []) for i in range(6)]
    p = spark.createDataFrame(rows, "morph_name string, branch_id int, point_id int, x double, y double, z double, radius double, labels array<string>")
    assert sorted(r.point_id for r in morphology.simplify(p, 0.5).collect()) == [0, 3, 4, 5]


def test_distributions(spark):
    u = keyed.keyed_uniform(3, "id")
    df = spark.range(4000).select(*(keyed.inverse_cdf(n, u, **k).alias(n) for n, k in (("norm", {}), ("expon", {}), ("logistic", {}), ("weibull_min", {"c": 2.0}), ("uniform", {}), ("constant", {"constant": 2.0})))).toPandas()
    for name, k in (("norm", {}), ("expon", {}), ("logistic", {}), ("weibull_min", {"c": 2.0}), ("uniform", {})):
        for x in (0.2, 0.7):
            assert abs((df[name] <= x).mean() - keyed.cdf(name, x, **k)) < 0.03
    assert set(df.constant) == {2.0}
    with pytest.raises(ValueError):
        keyed.cdf("nothing", 1.0)


def test_store_and_plan(spark, tmp_path):
    store = NetworkStore(spark, str(tmp_path / "net"))
    points = lambda kind, n: lambda plan: spark.range(n).select(F.lit(kind).alias("cell_type"), *((F.col("id") * 30.0).alias(c) for c in "xyz"))

    def connect(plan):
        c = plan.store.read("cells")
        side = lambda t, s: c.where(F.col("cell_type") == t).select(F.col("cell_type").alias(f"{s}_type"), F.col("chunk_id").alias(f"{s}_chunk"), F.col("local_id").alias(f"{s}_local"))
        return side("a", "pre").crossJoin(side("b", "post")).withColumn("tag", F.lit("a_to_b"))

    seen = []
    plan = Plan(store, placement=[Strategy("pb", points("b", 5), ["b"], ["pa"]), Strategy("pa", points("a", 4), ["a"])], connectivity=[Strategy("a_to_b", connect, ["a", "b"])], after_placement=[lambda p: seen.append(p.store.read("cells").count())])
    plan.compile()
    assert seen == [9] and store.read("connections").count() == 20 and store.tags() == ["a_to_b"]
    with pytest.raises(FileExistsError):
        plan.compile()
    with pytest.raises(ValueError):
        plan.compile(clear=True, append=True)
    plan.compile(append=True, only=["pa"])
    assert store.read("cells").count() == 13
    plan.compile(redo=True, only=["pa"])
    assert store.read("cells").count() == 9 and store.read("connections").count() == 20
    assert '"a" -> "b" [label="a_to_b (20)"]' in plan.diagram()
    store.save_configuration({"x": 1})
    assert open_store(spark, store.root).load_configuration() == {"x": 1}
    copied = store.copy(str(tmp_path / "copy"))
    copied.clear("cells", cell_type="a")
    assert copied.read("cells").count() == 5
    with pytest.raises(PermissionError):
        open_store(spark, store.root, read_only=True).clear("cells")
    with pytest.raises(FileNotFoundError):
        open_store(spark, str(tmp_path / "none"))


def test_redo_closure():
    assert network.redo_closure([("p1", "a"), ("p2", "b"), ("c", "a"), ("c", "b"), ("p3", "z")], {"p1"}) == {"p1", "c", "p2"}


def test_output_tags():
    assert connectivity.output_tags("s", [("a", "b")]) == {("a", "b"): "s"}
    assert connectivity.output_tags("s", [("a", "b"), ("a", "c")], {("a", "c"): None}) == {("a", "b"): "s_a_to_b", ("a", "c"): None}


def test_time_slices():
    assert time_slices(10.0, 4.0) == [(0.0, 4.0), (4.0, 8.0), (8.0, 10.0)]


def test_windows_on_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").orderBy("ts")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "1 hour")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windowed").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("windowed").agg(F.sum("n")).first()[0] == events.count()


def test_morphology_repository(spark, tmp_path):
    from lattica.queries import branches, points
    from lattica.sources.morphologies import MorphologyRepository

    repo = MorphologyRepository(NetworkStore(spark, str(tmp_path / "net")))
    p, b = (f(spark, DATA).where("morph_name in ('1', '11', '2')") for f in (points, branches))
    repo.save(p, b, {"species": "none"})
    assert repo.names() == ["1", "11", "2"] and repo.select(["1*"]) == ["1", "11"] and repo.select([]) == []
    assert repo.get_meta("2") == {"species": "none"} and repo.load("1")[0].count() == 21
    with pytest.raises(FileExistsError):
        repo.save(p, b)
    with pytest.raises(LookupError):
        repo.select(["zebra*"])
    repo.save(p.where("morph_name = '2'"), b.where("morph_name = '2'"), {"species": "new"}, overwrite=True)
    assert repo.get_meta("2") == {"species": "new"} and repo.get_meta("1") == {"species": "none"}


def test_files(spark, tmp_path):
    from lattica.sources import files

    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "b.txt").write_text("two")
    f = files.read_files(spark, str(tmp_path))
    cache = files.pipe(f, lambda d: d.where("id like '%a.txt'"), lambda d: d.select("id", "mtime"))
    assert [bytes(r.content) for r in files.stale(f, cache).collect()] == [b"two"]


def test_strategy_choice():
    from lattica.plans.network import connectivity_of, placement_of

    s = [Strategy("x", None, ["a", "b"], pre=["a"], post=["b"]), Strategy("y", None, ["b", "c"], pre=["b"], post=["c"])]
    names = lambda r: [x.name for x in r]
    assert names(connectivity_of(s)) == ["x", "y"] and names(connectivity_of(s, presynaptic=["b"])) == ["y"]
    assert names(connectivity_of(s, anywhere=["b"])) == ["x", "y"] and names(connectivity_of(s, postsynaptic=["a"])) == []
    assert names(placement_of(s, ["c"])) == ["y"]


def test_make_config(tmp_path):
    from lattica.__main__ import main

    assert main(["make-config", str(tmp_path / "c.json")]) == 0
    assert configuration.parse((tmp_path / "c.json").read_text()) == configuration.DEFAULT


def test_appended_cells_keep_their_own_ids(spark, tmp_path):
    """Two strategies of one type, and one that is appended, never give a place in a chunk twice."""
    store = NetworkStore(spark, str(tmp_path / "net"))
    made = lambda k: lambda plan: spark.range(5).select(F.lit("a").alias("cell_type"), (F.col("id") * 1.0 + k).alias("x"), F.lit(1.0).alias("y"), F.lit(1.0).alias("z"))
    plan = Plan(store, placement=[Strategy(f"p{k}", made(k), ["a"]) for k in (0, 10)])
    plan.compile()
    Plan(store, placement=[Strategy("p20", made(20), ["a"])]).compile(append=True)
    cells = store.read("cells")
    assert cells.count() == 15 and sorted(r.local_id for r in cells.select("local_id").collect()) == list(range(15))


def test_edges_are_stored_by_place(spark, tmp_path):
    store = NetworkStore(spark, str(tmp_path / "net"))
    cells = lambda plan: spark.range(40).select(F.when(F.col("id") < 10, "a").otherwise("b").alias("cell_type"), (F.col("id") * 30.0).alias("x"), F.lit(1.0).alias("y"), F.lit(1.0).alias("z"))

    def edges(plan):
        ids = spark.range(10).select(F.col("id").alias("pre_id"), (F.col("id") + 20).alias("post_id"))
        return ids.withColumns({c: F.lit(-1) for c in ("pre_branch", "pre_point", "post_branch", "post_point")})

    plan = Plan(store, placement=[Strategy("place", cells, ["a", "b"])], connectivity=[Strategy("join", edges, ["a", "b"], pre=["a"], post=["b"])])
    plan.compile()
    assert store.tags() == ["join"] and store.read("connections").count() == 10
    stats = network.chunk_stats(store.read("cells"))
    back = network.global_connections(store.read("connections"), stats, stats).select("pre_id", "post_id").collect()
    assert sorted(map(tuple, back)) == [(i, i + 20) for i in range(10)]
    plan.compile(redo=True)
    assert store.read("connections").count() == 10
    with pytest.raises(ValueError):
        plan.connect(Strategy("join", edges, ["a", "b"], pre=["b"], post=["a"]))
    with pytest.raises(Exception, match="no cell of a"):
        plan.connect(Strategy("lost", edges, ["a"], pre=["a"], post=["a"]))
    several = Strategy("both", lambda p: edges(p).withColumns({"pre_type": F.lit("a"), "post_type": F.lit("b")}), ["a", "b"], pre=["a", "b"], post=["b"])
    plan.connectivity.append(several)
    plan.connect(several)
    assert "both_a_to_b" in store.tags()
    plan.compile(redo=True, only=["both"])
    assert store.read("connections").where("tag = 'both_a_to_b'").count() == 10
    store.clear_type("a")
    assert store.read("cells").select("cell_type").distinct().count() == 1 and not store.holds("connections")


def test_files_are_kept_apart(spark, tmp_path):
    store = NetworkStore(spark, str(tmp_path / "net"))
    for name, content in (("a b/c", b"1"), ("007", b"2"), ("a b/c", b"3")):
        store.put_file(name, content, {"k": name})
    assert bytes(store.get_file("a b/c").content) == b"3" and bytes(store.get_file("007").content) == b"2" and store.has_file("007")
    store.remove_file("007")
    assert not store.has_file("007") and store.has_file("a b/c")
    with pytest.raises(FileNotFoundError):
        store.remove_file("007")


def test_refusals(spark):
    p = spark.createDataFrame([("m", 0, 0, 0.0, 0.0, 0.0)], "morph_name string, branch_id int, point_id int, x double, y double, z double")
    with pytest.raises(ValueError):
        morphology.simplify(p, -1.0)
    voxels = spark.createDataFrame([(1, 8.0, {"a": 1.0})], "voxel_id long, volume double, data map<string,double>")
    with pytest.raises(Exception, match="no density b"):
        placement.voxel_counts(voxels, {"t": placement.Indicator(density_key="b")}).collect()
    loop = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent_id string")
    with pytest.raises(ValueError):
        ontology.subtree(loop, "a")


def test_long_chains(spark):
    """Deep trees take rounds of doubling, not levels."""
    n = 300
    nodes = spark.range(n).select(F.col("id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    assert {(r.id, r.depth) for r in ontology.subtree(nodes, 100).collect()} == {(i, i - 100) for i in range(100, n)}
    chain = spark.createDataFrame([("m", i, i - 1 if i else None) for i in range(40)], "morph_name string, branch_id int, parent_branch int")
    got = {(r.branch_id, r.ancestor, r.distance) for r in morphology.ancestors(chain).collect()}
    assert got == {(i, j, i - j) for i in range(40) for j in range(i)}


def test_moved_solids():
    c = shapes.Cylinder((0.0, 0.0, 0.0), 1.0, (0.0, 0.0, 5.0)).translated((1.0, 0.0, 0.0)).rotated(0.0, 90.0, 0.0, (1.0, 0.0, 0.0))
    assert [round(x, 9) for x in c.top] == [6.0, 0.0, 0.0] and [round(x, 9) for x in c.bottom] == [1.0, 0.0, 0.0]
    e = shapes.Ellipsoid((0.0, 0.0, 0.0), (3.0, 2.0, 1.0)).rotated(0.0, 0.0, 90.0)
    assert [round(x, 9) for x in e.box()[1]] == [2.0, 3.0, 1.0] and round(e.volume(), 9) == round(shapes.Ellipsoid((0.0, 0.0, 0.0), (3.0, 2.0, 1.0)).volume(), 9)


def test_tours_of_random_forests(spark):
    """Preorder, size and depth of forests of many shapes, and the nodes below chosen ones, against a plain walk."""
    rng, rows, expected = np.random.default_rng(3), [], {}
    for t, n in enumerate((1, 2, 5, 30, 200)):
        above = [None if i == 0 or rng.random() < 0.1 else int(rng.integers(i)) for i in range(n)]
        pre, size, depth = {}, dict.fromkeys(range(n), 1), {}
        stack = [(i, 0) for i in reversed(range(n)) if above[i] is None]
        while stack:
            v, d = stack.pop()
            pre[v], depth[v] = len(pre), d
            stack += [(c, d + 1) for c in reversed(range(n)) if above[c] == v]
        for v in sorted(range(n), key=lambda v: -depth[v]):
            if above[v] is not None:
                size[above[v]] += size[v]
        rows += [(f"t{t}", i, above[i]) for i in range(n)]
        expected |= {(f"t{t}", i): (pre[i], size[i], depth[i]) for i in range(n)}
    forest = spark.createDataFrame(rows, "morph_name string, branch_id int, parent_branch int")
    toured = trees.tour(forest)
    assert {(r.morph_name, r.branch_id): (r.preorder, r.size, r.depth) for r in toured.collect()} == expected
    above = {(t, i): None if p is None else (t, p) for t, i, p in rows}
    chosen = {("t3", 3), ("t4", 7), ("t4", 50), ("t2", 1)}

    def hit(v):
        return v in chosen or above[v] is not None and hit(above[v])

    got = trees.below(toured, spark.createDataFrame(sorted(chosen), "morph_name string, branch_id int"))
    assert sorted((r.morph_name, r.branch_id) for r in got.collect()) == sorted(v for v in above if hit(v))


def test_a_chain_of_a_thousand(spark):
    chain = spark.createDataFrame([("c", i, i - 1 if i else None) for i in range(1000)], "morph_name string, branch_id int, parent_branch int")
    r = trees.tour(chain).agg(F.max("depth").alias("d"), F.sum("size").alias("s")).first()
    assert (r.d, r.s) == (999, 500_500)
    with pytest.raises(ValueError):
        trees.along(spark.createDataFrame([("a", "b"), ("b", "a")], "id string, up string"), ["id"], "up")


def test_swc_boundaries_and_tags(spark):
    """A soma of one sample with two branches; the branches start without a copy of it, and own tags have own labels."""
    rows = [("m", 10, 1, 0.0, 0.0, 0.0, 5.0, -1), ("m", 11, 7, 1.0, 0.0, 0.0, 1.0, 10), ("m", 12, 7, 2.0, 0.0, 0.0, 1.0, 11), ("m", 20, 2, 0.0, 1.0, 0.0, 1.0, 10)]
    swc = spark.createDataFrame(rows, "morph_name string, sample int, tag int, x double, y double, z double, radius double, parent int")
    got = [(r.branch_id, r.point_id, r.x, r.y, r.labels, r.parent_branch) for r in morphology.parse_swc(swc, ["soma"], {7: ["basal", "dendrites"]}).orderBy("branch_id", "point_id").collect()]
    b = ["basal", "dendrites"]
    assert got == [(0, 0, 0.0, 0.0, ["soma"], None), (1, 0, 1.0, 0.0, b, 0), (1, 1, 2.0, 0.0, b, 0), (2, 0, 0.0, 1.0, ["axon"], 0)]
    copied = morphology.parse_swc(swc, labels_of_next=True).where("branch_id = 2").orderBy("point_id").collect()
    assert [(r.y, r.radius, r.labels) for r in copied] == [(0.0, 5.0, ["axon"]), (1.0, 1.0, ["axon"])]
    with pytest.raises(Exception, match="no sample 9"):
        morphology.parse_swc(swc.withColumn("parent", F.when(F.col("sample") == 20, 9).otherwise(F.col("parent")))).collect()


def test_any_box_join_takes_boxes_of_any_size(spark):
    """Against all pairs, for sizes over ten doublings; one huge box lies in eight cells at most."""
    rng, rows = np.random.default_rng(5), []
    for i in range(120):
        low, side = rng.uniform(-300, 300, 3), 2.0 ** rng.uniform(-2, 8, 3)
        rows.append((i, *map(float, low), *map(float, low + side)))
    rows += [(200, -1e6, -1e6, -1e6, 1e6, 1e6, 1e6), (201, 5.0, 5.0, 5.0, 5.0, 5.0, 5.0), (202, 4.0, 4.0, 4.0, 5.0, 6.0, 6.0)]
    boxes = spark.createDataFrame(rows, "id int, lx double, ly double, lz double, hx double, hy double, hz double")
    got = sorted((r.a.id, r.b.id) for r in spatial.any_box_join(boxes, boxes, 1.0).collect())
    meet = lambda p, q: all(p[1 + i] <= q[4 + i] and q[1 + i] <= p[4 + i] for i in range(3))
    assert got == sorted((p[0], q[0]) for p in rows for q in rows if meet(p, q))
    assert spatial._levelled(boxes.where("id = 200"), "a", 1.0, [1], [], 1).count() <= 8


def _edges(spark, n=400):
    from lattica.functions.chunks import chunk_of

    at = lambda s, shift: chunk_of(*(F.pmod(F.floor(F.col("id") * p / 7) + shift, F.lit(9)).cast("double") for p in (1, 3, 5)), 1.0).alias(f"{s}_chunk")
    rows = spark.range(n).select(F.when(F.col("id") % 4 == 0, "t").otherwise("u").alias("tag"), F.lit("a").alias("pre_type"), F.lit("b").alias("post_type"), at("pre", 0), at("post", 1), F.col("id").cast("int").alias("pre_local"), F.col("id").cast("int").alias("post_local"))
    return rows.withColumns({c: F.lit(-1) for c in ("pre_branch", "pre_point", "post_branch", "post_point")})


def test_scans_from_either_side_open_few_files(spark, tmp_path):
    store = NetworkStore(spark, str(tmp_path / "net"), file_rows=20)
    edges = _edges(spark)
    store.append("connections", edges)
    every = len(store.read("connections").inputFiles())
    for side, incoming in (("pre", False), ("post", True)):
        chunk = edges.where("tag = 'u'").groupBy(f"{side}_chunk").count().orderBy(F.desc("count")).first()[0]
        got = store.connections("u", [chunk], incoming=incoming)
        want = edges.where((F.col("tag") == "u") & (F.col(f"{side}_chunk") == chunk))
        assert sorted(r.pre_local for r in got.collect()) == sorted(r.pre_local for r in want.collect())
        assert len(got.inputFiles()) <= every // 3
    before = {r.pre_local for r in edges.collect()}
    some = [r[0] for r in edges.select("post_chunk").distinct().orderBy("post_chunk").limit(5).collect()]
    store.clear("connections", post_chunk=some)
    assert {r.pre_local for r in store.read("connections").collect()} == before - {r.pre_local for r in edges.where(F.col("post_chunk").isin(some)).collect()}
    store.versions.vacuum()
    assert store.read("connections").count() == len(store.read("connections").collect())
    assert store.connections_between("a", "b") if store.tags() == ["t"] else True
    with pytest.raises(LookupError):
        store.connections_between("b", "a")
    store.clear("connections")
    assert store.tags() == [] and not store.exists("connections")


def test_a_failed_job_leaves_the_old_network(spark, tmp_path):
    store = NetworkStore(spark, str(tmp_path / "net"))
    cells = lambda plan: spark.range(40).select(F.lit("a").alias("cell_type"), (F.col("id") * 30.0).alias("x"), F.lit(1.0).alias("y"), F.lit(1.0).alias("z"))
    fails = []

    def connect(plan):
        if fails:
            raise RuntimeError("half way")
        return _edges(spark, 10).withColumn("tag", F.lit("join"))

    plan = Plan(store, placement=[Strategy("place", cells, ["a"])], connectivity=[Strategy("join", connect, ["a"], pre=["a"], post=["a"])])
    plan.compile()
    fails.append(1)
    for options in ({"redo": True}, {"clear": True}, {"append": True}):
        with pytest.raises(RuntimeError, match="half way"):
            plan.compile(**options)
        again = open_store(spark, store.root)
        assert again.read("cells").count() == 40 and again.read("connections").count() == 10
    fails.clear()
    plan.compile(redo=True)
    assert store.read("cells").count() == 40 and store.read("connections").count() == 10


def test_additional_columns(spark, tmp_path):
    store = NetworkStore(spark, str(tmp_path / "net"))
    rows = spark.range(6).select(F.when(F.col("id") < 4, "a").otherwise("b").alias("cell_type"), F.lit(0).cast("long").alias("chunk_id"), F.col("id").cast("int").alias("local_id"))
    store.append("cells", rows)
    values = spark.range(4).select(F.lit(0).cast("long").alias("chunk_id"), F.col("id").cast("int").alias("local_id"), (F.col("id") * 2).alias("value"))
    store.append_additional("a", "twice", values)
    assert sorted((r.cell_type, r.local_id, r.twice) for r in store.read("cells").collect()) == [("a", i, 2 * i) for i in range(4)] + [("b", 4, None), ("b", 5, None)]
    with pytest.raises(ValueError):
        store.append_additional("a", "less", values.where("local_id > 0"))
    assert "less" not in store.read("cells").columns


def test_regions_prune_and_change_nothing(spark, tmp_path):
    """The pairs are the same with and without a region, and a scan by region opens fewer files."""
    from lattica.functions.chunks import chunk_of
    from lattica.operators import extents

    at = {c: F.pmod(F.col("id") * p, F.lit(97)) * 10.0 for c, p in (("x", 13), ("y", 29), ("z", 41))}
    cells = spark.range(300).withColumns(at).withColumn("chunk_id", chunk_of(F.col("x"), F.col("y"), F.col("z"), 100.0)).withColumn("cell_type", F.when(F.col("id") < 12, "a").otherwise("b"))
    store = NetworkStore(spark, str(tmp_path / "net"), file_rows=10)
    store.append("cells", cells.withColumn("local_id", F.col("id").cast("int")))
    ball = shapes.Sphere((0.0, 0.0, 0.0), 40.0)
    pre, post = (extents.solid_extents(cells.where(F.col("cell_type") == t), ball) for t in "ab")
    region = extents.region_of_extents(extents.chunk_extents(pre), extents.chunk_extents(post), 100.0)
    with_it, without = ({(r.pre_id, r.post_id) for r in extents.meeting_cells(pre, post, g, 40.0).collect()} for g in (region, None))
    assert with_it == without and with_it
    pruned = store.read("cells", cell_type="b", chunk_id=region.select("post_chunk"))
    assert len(pruned.inputFiles()) < len(store.read("cells", cell_type="b").inputFiles())


def test_derived_morphologies_are_shared(spark):
    """Two names of one content have one derived morphology; one without labelled points has none; locations come back."""
    from lattica.operators.derived import derived

    rows = [(m, 0, i, float(i), 0.0, 0.0, 1.0, ["axon"] if i in (1, 2, 4) and m != "n" else ["soma"]) for m in ("a", "b", "n") for i in range(5)]
    p = spark.createDataFrame(rows, "morph_name string, branch_id int, point_id int, x double, y double, z double, radius double, labels array<string>")
    b = spark.createDataFrame([(m, 0, None) for m in ("a", "b", "n")], "morph_name string, branch_id int, parent_branch int")
    d = derived(p, b, ["axon"])
    assert {r.morph_name: r.derived for r in d.names.collect()} == {"a": "axon@a", "b": "axon@a"} and d.points.count() == 3
    cells = d.of(spark.createDataFrame([(1, "a"), (2, "b"), (3, "n")], "id long, morph_name string"))
    assert {r.id: r.morph_name for r in cells.collect()} == {1: "axon@a", 2: "axon@a", 3: None}
    edges = spark.createDataFrame([(2, 1, 0, 9), (1, 0, 1, 9), (3, -1, -1, 9)], "pre_id long, pre_branch int, pre_point int, post_id long")
    assert {(r.pre_id, r.pre_branch, r.pre_point) for r in d.back(edges, cells, "pre").collect()} == {(2, 0, 4), (1, 0, 2), (3, -1, -1)}
    with pytest.raises(Exception, match="not on the filtered"):
        d.back(edges.withColumn("pre_branch", F.lit(7)), cells, "pre").collect()


def test_grown_trees_are_deduplicated(spark):
    """Without splits all trees of a seed differ by key alone; cells of one key share one."""
    from lattica.operators.generation import generated

    cells = spark.range(30).withColumn("kind", F.col("id") % 3)
    named, points, branches = generated(cells, "kind", "g", generations=3, points=3, split=0.0, seed=1)
    assert named.count() == 30 and {r.morph_name for r in named.select("morph_name").distinct().collect()} == {"g-0", "g-1", "g-2"}
    assert points.count() == 9 and branches.count() == 3
    assert generated(cells, "kind", "g", generations=3, points=3, split=1.0)[2].count() == 3 * 7


def test_split_nrrd(spark, tmp_path):
    """Attached and detached raw data, read in many ranges, are the array; others and short files are refused."""
    data = np.arange(2 * 7 * 5 * 3, dtype="<i2").reshape(2, 7, 5, 3)
    head = "NRRD0004\ntype: short\ndimension: 4\nsizes: 2 7 5 3\nendian: little\nencoding: raw\n"
    folder = tmp_path / "volumes"
    folder.mkdir()
    (folder / "a.nrrd").write_bytes(head.encode() + b"\n" + data.tobytes(order="F"))
    (folder / "b.raw").write_bytes(b"skip" + data[0].tobytes(order="F"))
    (folder / "b.nhdr").write_text(head.replace("dimension: 4", "dimension: 3").replace("2 7 5 3", "7 5 3") + "byte skip: 4\ndata file: b.raw\n\n")
    got = nrrd.read_nrrd_split(spark, str(folder), 26)
    assert got.rdd.getNumPartitions() == -(-420 // 26) + -(-210 // 26)
    rows = {(r.path[-6:-5] if r.path.endswith("nrrd") else r.path[-6:-5], r.component, r.ix, r.iy, r.iz): r.value for r in got.collect()}
    assert rows == {("a", *i): float(v) for i, v in np.ndenumerate(data)} | {("b", 0, *i): float(v) for i, v in np.ndenumerate(data[0])}
    (folder / "b.raw").write_bytes(b"skip")
    with pytest.raises(Exception, match="shorter"):
        nrrd.read_nrrd_split(spark, str(folder / "b.nhdr")).count()
    (folder / "c.nrrd").write_text(head.replace("raw", "gzip") + "\n")
    with pytest.raises(Exception, match="not raw"):
        nrrd.read_nrrd_split(spark, str(folder / "c.nrrd")).count()


def test_tabulated_distributions(spark):
    """Against closed forms and known values; the stated error holds; draws follow the distribution."""
    from lattica.functions.distributions import Tabulated

    expon = Tabulated.of("gamma", a=1.0, scale=3.0)
    assert all(abs(expon.cdf(x) - (1 - math.exp(-x / 3))) < 1.1 * expon.error for x in (0.01, 0.5, 3.0, 20.0)) and expon.error < 5e-5
    assert abs(Tabulated.of("beta", a=2.0, b=1.0).cdf(0.3) - 0.09) < 5e-5 and abs(Tabulated.of("chi2", df=2).sf(4.0) - math.exp(-2)) < 5e-5
    assert abs(Tabulated.of("t", df=1).cdf(1.0) - 0.75) < 5e-5 and abs(Tabulated.of("lognorm", s=0.5).cdf(1.0) - 0.5) < 5e-5
    arcsine = Tabulated.of("beta", a=0.5, b=0.5, loc=1.0, scale=2.0)
    assert arcsine.definition_interval() == (1.0, 3.0) and all(abs(v - w) < 1e-3 for v, w in zip(arcsine.definition_interval(0.25), (1.2929, 2.7071), strict=True))
    gamma = Tabulated.of("gamma", a=0.3)
    drawn = np.sort(spark.range(4000).select(gamma.draw(1, "id").alias("x")).toPandas().x.to_numpy())
    assert np.abs(np.array([gamma.cdf(x) for x in drawn]) - np.arange(4000) / 4000).max() < 0.03
    for bad in (lambda: Tabulated.of("nothing"), lambda: Tabulated.of("gamma"), lambda: Tabulated.of("gamma", a=1.0, scale=0.0), lambda: expon.definition_interval(2.0)):
        with pytest.raises(ValueError):
            bad()
    assert all(math.isfinite(v) for v in spark.range(1).select(gamma.quantile(F.lit(0.0)).alias("a"), gamma.quantile(F.lit(1.0)).alias("b")).first())


def test_surfaces_are_even(spark):
    """Areas of parts of each surface, by counts of many points."""
    from lattica.functions.surfaces import surface_point

    u = [keyed.keyed_uniform(i, "id") for i in range(3)]
    p = lambda s: np.array(spark.range(20_000).select(*(c.alias(n) for c, n in zip(surface_point(s, u), "xyz", strict=True))).toPandas())
    ball = p(shapes.Sphere((1.0, 0.0, 0.0), 2.0))
    assert np.allclose(np.linalg.norm(ball - [1, 0, 0], axis=1), 2) and all(abs((ball[:, 2] < z).mean() - (z + 2) / 4) < 0.015 for z in (-1.5, 0.0, 1.0))
    drum = p(shapes.Cylinder((0.0, 0.0, 0.0), 1.0, (0.0, 0.0, 3.0)))
    assert abs(((drum[:, 2] > 1e-9) & (drum[:, 2] < 3 - 1e-9)).mean() - 6 / 8) < 0.015 and abs((drum[:, 2] < 1e-9).mean() - 1 / 8) < 0.01
    cone = p(shapes.Cone((0.0, 0.0, 4.0), (0.0, 0.0, 0.0), 3.0))
    side = cone[cone[:, 2] > 1e-9]
    assert abs(len(side) / 20_000 - 5 / 8) < 0.015 and abs((side[:, 2] > 2).mean() - 0.25) < 0.015
    block = p(shapes.Parallelepiped((0.0, 0.0, 0.0), ((1.0, 0.0, 0.0), (0.0, 2.0, 0.0), (0.0, 0.0, 4.0))))
    assert abs((block[:, 0] < 1e-9).mean() - 8 / 28) < 0.015 and abs((block[:, 2] > 4 - 1e-9).mean() - 2 / 28) < 0.01
    oval = p(shapes.Ellipsoid((0.0, 0.0, 0.0), (1.0, 1.0, 5.0)))
    z, step = np.linspace(-5, 5, 20_001), 10 / 20_000
    area = 2 * np.pi * np.sqrt(1 - z**2 / 25 + (z / 25) ** 2) * step
    assert all(abs((oval[:, 2] < c).mean() - area[z < c].sum() / area.sum()) < 0.02 for c in (-4.5, -3.0, 0.0, 4.0))


def test_stacks_of_a_table_are_stacks(spark):
    boxes = [("a", 1, 10.0), ("b", 2, 30.0), ("c", 3, 5.0)]
    plain = topology.Stack("s", tuple(topology.Layer(n, t) for n, _, t in boxes), anchor="b").layout(topology.Box("r", (0.0, 0.0, -7.0), (9.0, 9.0, 9.0)))
    rows = spark.createDataFrame([("s", n, k, 0.0, 0.0, -7.0, 9.0, 9.0, -7.0 + t) for n, k, t in boxes], "stack string, name string, k int, lx double, ly double, lz double, hx double, hy double, hz double")
    got = {r.name: (r.lz, r.hz) for r in topology.stacked(rows, ["stack"], ["k"], anchor=F.col("name") == "b").collect()}
    assert got == {b.name: (b.low[2], b.high[2]) for b in plain}


def test_edits_of_branches(spark):
    from lattica.operators.edits import LOG, edited

    p = spark.createDataFrame([("m", b, k, float(10 * b + k), 0.0, 0.0, 1.0 + k, ["soma"]) for b in range(2) for k in range(4)] + [("n", 0, 0, 0.0, 0.0, 0.0, 1.0, ["soma"])], "morph_name string, branch_id int, point_id int, x double, y double, z double, radius double, labels array<string>")
    b = spark.createDataFrame([("m", 0, None), ("m", 1, 0), ("n", 0, None)], "morph_name string, branch_id int, parent_branch int")
    log = spark.createDataFrame([("m", "split", 0, 1, None, None), ("m", "split", 0, 2, None, None), ("m", "split", 0, 2, None, None), ("m", "insert", 0, 1, None, 0.5), ("n", "split", 0, 0, None, None)], LOG)
    q, t = edited(p, b, log)
    by = {}
    for r in q.orderBy("morph_name", "branch_id", "point_id").collect():
        by.setdefault((r.morph_name, r.branch_id), []).append((r.x, r.radius))
    assert by == {("m", 0): [(0.0, 1.0), (1.0, 2.0)], ("m", 1): [(1.0, 2.0), (1.5, 2.5), (2.0, 3.0)], ("m", 2): [(2.0, 3.0), (3.0, 4.0)], ("m", 3): [(10.0, 1.0), (11.0, 2.0), (12.0, 3.0), (13.0, 4.0)], ("n", 0): [(0.0, 1.0)]}
    assert {(r.morph_name, r.branch_id): r.parent_branch for r in t.collect()} == {("m", 0): None, ("m", 1): 0, ("m", 2): 1, ("m", 3): 2, ("n", 0): None}


def test_topologies(spark, tmp_path):
    """Roots, partitions and the group that stands for several roots; another size moves what fills its region."""
    a, b, c = topology.Layer("a", 20.0), topology.Rhomboid("b", (5.0, 5.0, 5.0)), topology.Layer("c", 30.0)
    inner = topology.Group("inner", (b,))
    outer = topology.Stack("outer", (a, inner))
    other = topology.Group("other", (c, b))
    assert topology.root_regions([inner, outer]) == [outer] and topology.topology_of([inner, outer]) is outer
    assert topology.partitions_of([outer, other]) == [a, b, c] and topology.topology_of([]).layout(topology.Box("r", (0.0,) * 3, (1.0,) * 3)) == []
    plan = Plan(NetworkStore(spark, str(tmp_path / "net")), regions=[outer, inner, other])
    assert [x.name for x in plan.layout()] == ["a", "b", "c", "b"] and plan.layout()[0].high == (200.0, 200.0, 20.0)
    before = plan.chunks().where("partition = 'a'").count()
    plan.resize(x=400.0, z=50.0)
    assert plan.layout()[0].high == (400.0, 200.0, 20.0) and plan.size == (400.0, 200.0, 50.0) and plan.chunks().where("partition = 'a'").count() == 2 * before


def test_metadata_of_many_morphologies(spark, tmp_path):
    from lattica.queries import branches, points
    from lattica.sources.morphologies import MorphologyRepository

    repo = MorphologyRepository(NetworkStore(spark, str(tmp_path / "net")))
    assert not repo.has("1")
    p, b = (f(spark, DATA).where("morph_name in ('1', '2')") for f in (points, branches))
    repo.save(p, b, {"a": "0"})
    repo.update_all_meta({"1": {"b": "1"}, "2": {"a": "2"}})
    assert repo.get_all_meta() == {"1": {"a": "0", "b": "1"}, "2": {"a": "2"}}
    repo.set_all_meta({"1": {"c": "3"}})
    assert repo.get_all_meta() == {"1": {"c": "3"}, "2": {"a": "2"}} and repo.has("2") and not repo.has("3")
    with pytest.raises(FileNotFoundError):
        repo.update_all_meta({"3": {}})


def test_cells_without_a_morphology(spark):
    from lattica.operators.derived import load_morphologies

    p = spark.createDataFrame([("m", 0, i, float(i), 0.0, 0.0, 1.0, ["axon"] if i else ["soma"]) for i in range(3)], "morph_name string, branch_id int, point_id int, x double, y double, z double, radius double, labels array<string>")
    b = spark.createDataFrame([("m", 0, None)], "morph_name string, branch_id int, parent_branch int")
    cells = spark.createDataFrame([(1, "m"), (2, "gone"), (3, None)], "id long, morph_name string")
    assert sorted((r.id, r.x) for r in load_morphologies(cells, p, b, ["axon"], allow_empty=True).collect()) == [(1, 1.0), (1, 2.0)]
    assert load_morphologies(cells.where("id = 1"), p, b).count() == 3
    with pytest.raises(Exception, match="no morphology of cell"):
        load_morphologies(cells, p, b).collect()


def test_degrees_are_completed(spark, monkeypatch):
    """With hardly more draws than edges, many rows draw a place twice; each still has its degree, of different places."""
    monkeypatch.setattr(connectivity, "SPARE", -5)
    got = connectivity.sampled_degree(spark.range(300), spark.range(24), 6, 1)
    assert all((r.n, r.d) == (6, 6) for r in got.groupBy("fixed_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pool_id").alias("d")).collect()) and got.count() == 1800
