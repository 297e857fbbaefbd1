"""Queries over the test tables, one or more for each operator, with the SQL that says the same.

`embeddings` serves as cells: the first three numbers of a vector, times 500, are a place and its label a cell type.
As morphologies, its 64 numbers are 4 branches, three of 5 points and the last of 6, and a radius.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import shapes as S
from lattica.functions.chunks import chunk_box, chunk_coordinates, chunk_of
from lattica.functions.keyed import bits_sql, inverse_cdf, keyed_bits, keyed_uniform, uniform_sql
from lattica.functions.distributions import KNOTS, Tabulated
from lattica.functions.labels import has_all, has_any, name_matches, with_labels
from lattica.functions.rotation import aligning_matrix, euler_matrix, matrix_euler, product, times
from lattica.functions.surfaces import BANDS, surface_point
from lattica.operators import connectivity as C
from lattica.operators import extents as X
from lattica.operators import generation as G
from lattica.operators import morphology as M
from lattica.operators import network as N
from lattica.operators import ontology as O
from lattica.operators import placement as P
from lattica.operators import spatial as J
from lattica.operators import targeting as T
from lattica.operators import voxels as V
from lattica.operators.derived import derived, load_morphologies
from lattica.operators.edits import edited
from lattica.operators.trees import below, tour
from lattica.plans import topology as L
from lattica.plans.network import Plan, Strategy
from lattica.sources import imports as I
from lattica.sources.cuts import cut, new_path
from lattica.sources.store import NetworkStore
from lattica.streaming.windows import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SIZE = 100.0


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = "WITH RECURSIVE " + _COMMON + sql.strip()
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cells(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    df = e.select(F.col("vec_id").alias("id"), F.concat(F.lit("type_"), F.col("label")).alias("cell_type"), *((F.col("embedding")[i].cast("double") * 500).alias(c) for i, c in enumerate("xyz")))
    labels = F.array_compact(F.array(F.when(F.col("id") % 2 == 0, "even"), F.when(F.col("id") % 3 == 0, "third")))
    return df.withColumn("chunk_id", chunk_of(F.col("x"), F.col("y"), F.col("z"), SIZE)).withColumn("labels", labels)


def numbered(spark: SparkSession, d: str) -> DataFrame:
    return N.with_local_ids(cells(spark, d), ["id"])


def points(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("morph_name"), "embedding")
    rows = e.withColumn("branch_id", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("point_id", F.explode(F.sequence(F.lit(0), F.when(F.col("branch_id") == 3, 5).otherwise(4))))
    at = [(F.element_at("embedding", (3 * (5 * F.col("branch_id") + F.col("point_id")) + i + 1).cast("int")).cast("double") * 100).alias(c) for i, c in enumerate("xyz")]
    label = F.when((F.col("branch_id") == 0) & (F.col("point_id") < 2), "soma").when(F.col("branch_id") % 2 == 1, "axon").otherwise("dendrites")
    return rows.select("morph_name", "branch_id", "point_id", *at, (F.abs(F.col("embedding")[63].cast("double")) + 0.5).alias("radius"), F.array(label).alias("labels"))


def branches(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("morph_name")).withColumn("branch_id", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return e.withColumn("parent_branch", F.when(F.col("branch_id").isin(1, 2), 0).when(F.col("branch_id") == 3, 1).cast("int"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in columns})


_COMMON = """
cells0 AS (SELECT vec_id AS id, 'type_' || label AS cell_type, embedding[1]::DOUBLE * 500 AS x, embedding[2]::DOUBLE * 500 AS y,
  embedding[3]::DOUBLE * 500 AS z FROM embeddings),
cells1 AS (SELECT *, floor(x / 100)::BIGINT AS cx, floor(y / 100)::BIGINT AS cy, floor(z / 100)::BIGINT AS cz FROM cells0),
cells AS (SELECT *, (cx & 65535) + ((cy & 65535) << 16) + ((cz & 65535) << 32) AS chunk_id,
  list_filter([CASE WHEN id % 2 = 0 THEN 'even' END, CASE WHEN id % 3 = 0 THEN 'third' END], lambda v: v IS NOT NULL) AS labels FROM cells1),
numbered AS (SELECT *, row_number() OVER (PARTITION BY cell_type, chunk_id ORDER BY id) - 1 AS local_id FROM cells),
stats AS (SELECT cell_type, chunk_id, count(*) AS n FROM cells GROUP BY ALL),
offs AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY cell_type ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM stats),
pts AS (SELECT vec_id::VARCHAR AS morph_name, b AS branch_id, k AS point_id, embedding[3 * (5 * b + k) + 1]::DOUBLE * 100 AS x,
  embedding[3 * (5 * b + k) + 2]::DOUBLE * 100 AS y, embedding[3 * (5 * b + k) + 3]::DOUBLE * 100 AS z,
  CASE WHEN b = 0 AND k < 2 THEN 'soma' WHEN b % 2 = 1 THEN 'axon' ELSE 'dendrites' END AS label, abs(embedding[64]::DOUBLE) + 0.5 AS radius
  FROM embeddings, range(4) bb(b), range(6) kk(k) WHERE k < 5 OR b = 3),
brs AS (SELECT vec_id::VARCHAR AS morph_name, b AS branch_id, CASE WHEN b IN (1, 2) THEN 0 WHEN b = 3 THEN 1 END AS parent_branch FROM embeddings, range(4) bb(b)),
seg AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2) AS length FROM pts WINDOW w AS (PARTITION BY morph_name, branch_id ORDER BY point_id)),
arc0 AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY morph_name, branch_id ORDER BY point_id), 0) AS path FROM seg),
arcs AS (SELECT *, path / max(path) OVER (PARTITION BY morph_name, branch_id) AS arc FROM arc0),
world AS (SELECT c.id, branch_id, point_id, p.x + c.x AS x, p.y + c.y AS y, p.z + c.z AS z FROM cells c JOIN pts p ON p.morph_name = c.id::VARCHAR)
"""


# Space, chunks and identifiers.


@query("SELECT id, chunk_id, cx, cy, cz FROM cells")
def chunk_ids(spark, d):
    c = cells(spark, d)
    return c.select("id", "chunk_id", *(v.cast("long").alias(n) for v, n in zip(chunk_coordinates(F.col("chunk_id")), ("cx", "cy", "cz"), strict=True)))


@query("SELECT DISTINCT chunk_id, cx * 100.0::DOUBLE AS lx, (cz + 1) * 100.0::DOUBLE AS hz FROM cells")
def chunk_boxes(spark, d):
    low, high = chunk_box(F.col("chunk_id"), SIZE)
    return cells(spark, d).select("chunk_id").distinct().select("chunk_id", low[0].alias("lx"), high[2].alias("hz"))


@query("SELECT * FROM stats")
def chunk_stats(spark, d):
    return N.chunk_stats(cells(spark, d))


@query("SELECT * FROM offs")
def chunk_offsets(spark, d):
    return N.chunk_offsets(N.chunk_stats(cells(spark, d)))


@query('SELECT id, cell_type, local_id, "offset" + local_id AS cell_id FROM numbered JOIN offs USING (cell_type, chunk_id)')
def global_ids(spark, d):
    return N.with_global_ids(numbered(spark, d)).select("id", "cell_type", "local_id", "cell_id")


@query("SELECT id, x, y, z FROM cells WHERE cell_type = 'type_3' AND list_has_any(labels, ['third'])")
def placement_scan(spark, d):
    return N.placement(cells(spark, d), "type_3", labels=["third"]).select("id", "x", "y", "z")


@query("SELECT id, list_has_any(labels, ['even', 'third']) AS some, list_has_all(labels, ['even', 'third']) AS every, array_to_string(list_sort(list_distinct(list_concat(labels, ['all']))), ',') AS more FROM cells")
def label_sets(spark, d):
    return cells(spark, d).select("id", has_any(F.col("labels"), ["even", "third"]).alias("some"), has_all(F.col("labels"), ["even", "third"]).alias("every"), F.array_join(with_labels(F.col("labels"), ["all"]), ",").alias("more"))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_full_match(p_name, '(.*e.*|part.*1)')")
def name_selector(spark, d):
    return table(spark, d, "part").where(name_matches(F.col("p_name"), ["*e*", "part*1"])).select("p_partkey", "p_name")


# Joins.


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: cells of any types that are at most 20 apart."""
    c = cells(spark, d).select("id", "x", "y", "z")
    return J.distance_join(c, c, 20.0).where("a.id < b.id").select(F.col("a.id").alias("pre_id"), F.col("b.id").alias("post_id"), (F.round("distance", 6) + 0.0).alias("distance"))


_NEAR = "SELECT a.id AS pre_id, b.id AS post_id, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) + 0.0 AS distance FROM cells a JOIN cells b ON a.id < b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 400"


@query(_NEAR)
def distance_join(spark, d):
    return neighbours(spark, d)


@query("SELECT a.id AS pre_id, b.id AS post_id FROM cells a JOIN cells b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 BETWEEN 100 AND 900")
def distance_ring(spark, d):
    c = cells(spark, d)
    return C.within_distance(c, c, 30.0, 10.0).select("pre_id", "post_id")


def boxes(df: DataFrame, half: float) -> DataFrame:
    return df.select("id", *((F.col(c) - half).alias(f"l{c}") for c in "xyz"), *((F.col(c) + half).alias(f"h{c}") for c in "xyz"))


@query("SELECT a.id AS a, b.id AS b FROM cells a JOIN cells b ON a.x - 15 <= b.x + 25 AND b.x - 25 <= a.x + 15 AND a.y - 15 <= b.y + 25 AND b.y - 25 <= a.y + 15 AND a.z - 15 <= b.z + 25 AND b.z - 25 <= a.z + 15")
def box_join(spark, d):
    c = cells(spark, d)
    return J.box_join(boxes(c, 15.0), boxes(c, 25.0), 50.0).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


@query("SELECT DISTINCT b.id AS box_id FROM cells a JOIN cells b ON a.cell_type = 'type_1' AND abs(a.x - b.x) <= 30 AND abs(a.y - b.y) <= 30 AND abs(a.z - b.z) <= 30")
def box_query_unique(spark, d):
    c = cells(spark, d)
    return J.box_query(boxes(c, 10.0), boxes(c.where("cell_type = 'type_1'"), 20.0), 40.0, unique=True)


@query("SELECT n_nationkey AS pre_id, -1 AS pre_branch, r_regionkey AS post_id, -1 AS post_branch FROM nation, region")
def all_to_all(spark, d):
    return C.all_to_all(table(spark, d, "nation").select(F.col("n_nationkey").alias("id")), table(spark, d, "region").select(F.col("r_regionkey").alias("id"))).select("pre_id", "pre_branch", "post_id", "post_branch")


def _degree_sql(fixed: str, pool: str, k: int, seed: int) -> str:
    return f"SELECT f AS fixed_id, p AS pool_id FROM (SELECT f.id AS f, p.id AS p, row_number() OVER (PARTITION BY f.id ORDER BY {bits_sql(seed, 'f.id', 'p.id')}, p.id) AS r FROM ({fixed}) f, ({pool}) p) WHERE r <= {k}"


def _sampled_sql(fixed: str, pool: str, k: int, seed: int) -> str:
    """SQL of sampled_degree: places in the pool by keyed draws, the first k different ones."""
    return f"""SELECT o AS fixed_id, id AS pool_id FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY t) AS r FROM (
      SELECT o, rank, min(t) AS t FROM (SELECT f.id AS o, t, {bits_sql(seed, 'f.id', 't')} % (SELECT count(*) FROM ({pool}) c) AS rank FROM ({fixed}) f, range(1, {2 * k + 33}) tt(t)) GROUP BY o, rank))
      JOIN (SELECT id, row_number() OVER (ORDER BY {bits_sql(f'{seed}-rank', 'id')}, id) - 1 AS rank FROM ({pool}) c) USING (rank) WHERE r <= {k}"""


_CUSTOMERS, _NATIONS = "SELECT c_custkey AS id FROM customer", "SELECT n_nationkey AS id FROM nation"


@query(f"SELECT pool_id AS pre_id, fixed_id AS post_id FROM ({_sampled_sql('SELECT id FROM cells', _CUSTOMERS, 5, 1)})")
def fixed_indegree(spark, d):
    return C.fixed_indegree(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), cells(spark, d).select("id"), 5, 1).select("pre_id", "post_id")


@query(f"SELECT fixed_id AS pre_id, pool_id AS post_id FROM ({_sampled_sql('SELECT id FROM cells', _CUSTOMERS, 3, 2)})")
def fixed_outdegree(spark, d):
    return C.fixed_outdegree(cells(spark, d).select("id"), table(spark, d, "customer").select(F.col("c_custkey").alias("id")), 3, 2).select("pre_id", "post_id")


@query(f"SELECT fixed_id, pool_id FROM ({_degree_sql('SELECT c_custkey AS id FROM customer', _NATIONS, 7, 3)})")
def ranked_degree(spark, d):
    """A pool of 25 for a degree of 7: all pairs are ranked."""
    return C.fixed_degree(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), table(spark, d, "nation").select(F.col("n_nationkey").alias("id")), 7, 3)


@query(f"""SELECT o AS fixed_id, id AS pool_id FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY t) AS r FROM (
  SELECT o, rank, min(t) AS t FROM (SELECT id AS o, t, {bits_sql(4, 'id', 't')} % (SELECT count(*) FROM customer) AS rank FROM cells, range(1, 43) tt(t)) GROUP BY o, rank))
  JOIN (SELECT c_custkey AS id, row_number() OVER (ORDER BY {bits_sql('4-rank', 'c_custkey')}, c_custkey) - 1 AS rank FROM customer) USING (rank) WHERE r <= 5""")
def sampled_degree(spark, d):
    return C.sampled_degree(cells(spark, d).select("id"), table(spark, d, "customer").select(F.col("c_custkey").alias("id")), 5, 4)


@query("SELECT a.chunk_id AS pre_chunk, b.chunk_id AS post_chunk FROM (SELECT DISTINCT chunk_id, cx, cy, cz FROM cells) a JOIN (SELECT DISTINCT chunk_id, cx, cy, cz FROM cells) b ON abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 AND abs(a.cz - b.cz) <= 1")
def region_of_interest(spark, d):
    own = cells(spark, d).select("chunk_id", *(v.alias(n) for v, n in zip(chunk_coordinates(F.col("chunk_id")), ("cx", "cy", "cz"), strict=True))).distinct()
    return C.region_of_interest(own, own, (1, 1, 1))


@query(f"""SELECT pre_id, post_id FROM (SELECT *, count(*) OVER (PARTITION BY post_id) * 0.5 AS e,
  row_number() OVER (PARTITION BY post_id ORDER BY {bits_sql(3, 'post_id', 'pre_id')}, pre_id) AS r FROM ({_NEAR}))
  WHERE r <= floor(e) + (CASE WHEN {uniform_sql('3-round', 'post_id')} < e - floor(e) THEN 1 ELSE 0 END)""")
def affinity(spark, d):
    return C.keep_affinity(neighbours(spark, d), "post_id", ["pre_id"], 0.5, 3).select("pre_id", "post_id")


@query("SELECT pre_id, post_id FROM (" + _NEAR + ") UNION ALL SELECT post_id, pre_id FROM (" + _NEAR + ")")
def bidirectional_edges(spark, d):
    return N.bidirectional(neighbours(spark, d).select("pre_id", "post_id"))


def block_edges(spark, d):
    c = numbered(spark, d).select("id", "cell_type", "chunk_id", "local_id", "x", "y", "z")
    pairs = J.distance_join(c, c, 20.0).where("a.id < b.id")
    side = lambda s, n: [F.col(f"{n}.cell_type").alias(f"{s}_type"), F.col(f"{n}.chunk_id").alias(f"{s}_chunk"), F.col(f"{n}.local_id").alias(f"{s}_local")]
    return pairs.select(*side("pre", "a"), *side("post", "b"), F.lit("near").alias("tag"))


@query("SELECT 'near' AS tag, a.chunk_id AS pre_chunk, b.chunk_id AS post_chunk, count(*) AS n FROM (" + _NEAR + ") e JOIN cells a ON a.id = pre_id JOIN cells b ON b.id = post_id GROUP BY ALL")
def block_stats(spark, d):
    return N.block_stats(block_edges(spark, d))


@query('SELECT a.cell_type AS pre_type, oa."offset" + a.local_id AS pre_id, b.cell_type AS post_type, ob."offset" + b.local_id AS post_id FROM (' + _NEAR + ") e JOIN numbered a ON a.id = pre_id JOIN numbered b ON b.id = post_id JOIN offs oa ON oa.cell_type = a.cell_type AND oa.chunk_id = a.chunk_id JOIN offs ob ON ob.cell_type = b.cell_type AND ob.chunk_id = b.chunk_id")
def global_connections(spark, d):
    stats = N.chunk_stats(cells(spark, d))
    return N.global_connections(block_edges(spark, d), stats, stats).select("pre_type", "pre_id", "post_type", "post_id")


def _scratch_store(spark: SparkSession, file_rows: int = 1_000_000) -> NetworkStore:
    return NetworkStore(spark, new_path(spark, "network"), file_rows=file_rows)


@query("""SELECT a.cell_type AS pre_type, a.id AS pre_cell, b.cell_type AS post_type, b.id AS post_cell FROM cells a JOIN cells b ON a.cell_type = 'type_1' AND b.cell_type = 'type_2' AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 3600""")
def edge_storage(spark, d):
    """Two placements of each type, the second appended; edges by rank, stored by chunk and place, and read back as the cells they join."""
    c, store = cells(spark, d).select("id", "cell_type", "x", "y", "z", "chunk_id"), _scratch_store(spark)
    parts = [Strategy(f"place_{k}", lambda plan, k=k: c.where(F.col("id") % 2 == k), ["type_1", "type_2"]) for k in (0, 1)]

    def near(plan: Plan) -> DataFrame:
        own = N.with_global_ids(plan.store.read("cells")).select(F.col("cell_id").alias("id"), "cell_type", "x", "y", "z")
        return C.within_distance(C.side(own, ["type_1"]), C.side(own, ["type_2"]), 60.0)

    Plan(store, SIZE, placement=parts[:1]).compile()
    Plan(store, SIZE, placement=parts[1:], connectivity=[Strategy("near", near, ["type_1", "type_2"], pre=["type_1"], post=["type_2"])]).compile(append=True)
    edges, held = store.read("connections"), store.read("cells").select("cell_type", "chunk_id", "local_id", "id")
    for s in ("pre", "post"):
        edges = edges.join(held.select(*(F.col(x).alias(f"{s}_{y}") for x, y in (("cell_type", "type"), ("chunk_id", "chunk"), ("local_id", "local"), ("id", "cell")))), [f"{s}_type", f"{s}_chunk", f"{s}_local"])
    return edges.select("pre_type", "pre_cell", "post_type", "post_cell")


@query("SELECT direction, local_chunk, global_chunk, count(*) AS n FROM (SELECT 'out' AS direction, a.chunk_id AS local_chunk, b.chunk_id AS global_chunk FROM (" + _NEAR + ") e JOIN cells a ON a.id = pre_id JOIN cells b ON b.id = post_id UNION ALL SELECT 'inc', b.chunk_id, a.chunk_id FROM (" + _NEAR + ") e JOIN cells a ON a.id = pre_id JOIN cells b ON b.id = post_id) GROUP BY ALL")
def directed_blocks(spark, d):
    return N.directed(block_edges(spark, d)).groupBy("direction", "local_chunk", "global_chunk").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT a.chunk_id AS pre_chunk, b.chunk_id AS post_chunk, a.local_id AS pre_local, b.local_id AS post_local FROM (" + _NEAR + ") e JOIN numbered a ON a.id = pre_id JOIN numbered b ON b.id = post_id WHERE b.chunk_id IN (0, 65536, 4295032831) OR a.chunk_id = 65535")
def incoming_scan(spark, d):
    """Edges that are stored, then read by their post chunks; and those of one pre chunk, without any twice."""
    store = _scratch_store(spark, 200)
    store.append("connections", block_edges(spark, d))
    into, out = store.connections("near", [0, 65536, 4295032831], incoming=True), store.connections("near", [65535])
    both = into.unionByName(out.where(~F.col("post_chunk").isin(0, 65536, 4295032831)))
    return both.select("pre_chunk", "post_chunk", F.col("pre_local").cast("long").alias("pre_local"), F.col("post_local").cast("long").alias("post_local"))


@query("SELECT a.chunk_id AS pre_chunk, b.chunk_id AS post_chunk, count(*) AS n FROM (" + _NEAR + ") e JOIN numbered a ON a.id = pre_id JOIN numbered b ON b.id = post_id WHERE b.cx <> 0 GROUP BY ALL")
def cleared_edges(spark, d):
    """What is left when the connections into all chunks of one slab are cleared."""
    store = _scratch_store(spark, 50)
    store.append("connections", block_edges(spark, d))
    slab = store.read("connections").select("post_chunk").distinct().where(chunk_coordinates(F.col("post_chunk"))[0] == 0)
    store.clear("connections", tag="near", post_chunk=[r[0] for r in slab.collect()])
    return store.read("connections").groupBy("pre_chunk", "post_chunk").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT a.chunk_id AS pre_chunk, b.chunk_id AS post_chunk, a.local_id AS pre_local, b.local_id AS post_local FROM (" + _NEAR + ") e JOIN numbered a ON a.id = pre_id AND a.chunk_id = 0 JOIN numbered b ON b.id = post_id AND b.chunk_id IN (0, 1, 65535)")
def connection_scan(spark, d):
    return N.connections(block_edges(spark, d), "near", [0], [0, 1, 65535]).select("pre_chunk", "post_chunk", F.col("pre_local").cast("long").alias("pre_local"), F.col("post_local").cast("long").alias("post_local"))


@query("""SELECT a.cell_type AS pre_type, a.local_id AS pre_id, b.cell_type AS post_type, coalesce((SELECT sum(n) FROM stats s WHERE s.cell_type = b.cell_type AND s.chunk_id IN (0, 1) AND s.chunk_id < b.chunk_id), 0)::BIGINT + b.local_id AS post_id
 FROM (""" + _NEAR + ") e JOIN numbered a ON a.id = pre_id AND a.chunk_id = 0 JOIN numbered b ON b.id = post_id AND b.chunk_id IN (0, 1)")
def scoped_connections(spark, d):
    stats = N.chunk_stats(cells(spark, d))
    return N.scoped_connections(block_edges(spark, d), stats, stats, [0], [0, 1]).select("pre_type", F.col("pre_id").cast("long").alias("pre_id"), "post_type", F.col("post_id").cast("long").alias("post_id"))


@query("SELECT a.id AS a, b.id AS b, round(5 + a.id % 3 + 5 + b.id % 3 - sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) AS overlap FROM cells a JOIN cells b ON a.id < b.id AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 < (10 + a.id % 3 + b.id % 3) ** 2")
def colliding(spark, d):
    c = cells(spark, d).withColumn("radius", 5.0 + F.col("id") % 3)
    return J.colliding(c, 7.0).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.round("overlap", 6).alias("overlap"))


def world(spark, d):
    return C.world_points(cells(spark, d).withColumn("morph_name", F.col("id").cast("string")), points(spark, d))


_VOX = "vox AS (SELECT id, floor(x / 20)::BIGINT AS ix, floor(y / 20)::BIGINT AS iy, floor(z / 20)::BIGINT AS iz, list(struct_pack(b := branch_id, p := point_id) ORDER BY branch_id, point_id) AS pa FROM world GROUP BY ALL)"


@query(f""", {_VOX},
sh AS (SELECT a.id AS pre_id, b.id AS post_id, a.pa AS pa, b.pa AS pb, ix, iy, iz, len(a.pa) * len(b.pa) AS weight FROM vox a JOIN vox b USING (ix, iy, iz) WHERE a.id < b.id),
cu AS (SELECT *, sum(weight) OVER (PARTITION BY pre_id, post_id ORDER BY ix, iy, iz)::BIGINT AS upto, sum(weight) OVER (PARTITION BY pre_id, post_id)::BIGINT AS total FROM sh),
dr AS (SELECT *, {bits_sql(5, 'pre_id', 'post_id', 'contact')} % total AS pick FROM cu, (SELECT unnest(range(1, 3)) AS contact)),
ok AS (SELECT *, pick - (upto - weight) AS i FROM dr WHERE pick < upto AND pick >= upto - weight)
SELECT pre_id, pa[(i // len(pb)) + 1].b AS pre_branch, pa[(i // len(pb)) + 1].p AS pre_point, post_id, pb[(i % len(pb)) + 1].b AS post_branch, pb[(i % len(pb)) + 1].p AS post_point FROM ok""")
def voxel_intersection(spark, d):
    w = world(spark, d)
    return C.voxel_intersection(w, w, 20.0, contacts=2, seed=5).where("pre_id < post_id")


@query(""", tw AS (SELECT c.id, branch_id, point_id, c.x - p.y AS x, c.y + p.x AS y, c.z + p.z AS z FROM cells c JOIN pts p ON p.morph_name = c.id::VARCHAR AND label = 'axon'),
tv AS (SELECT DISTINCT id, floor(x / 20) AS ix, floor(y / 20) AS iy, floor(z / 20) AS iz FROM tw), wv AS (SELECT DISTINCT id, floor(x / 20) AS ix, floor(y / 20) AS iy, floor(z / 20) AS iz FROM world)
SELECT DISTINCT a.id AS pre_id, b.id AS post_id FROM tv a JOIN wv b USING (ix, iy, iz)""")
def voxel_intersection_turned(spark, d):
    """Cells turned by a quarter about z, of whose morphologies the axons count, against cells that are not."""
    c = cells(spark, d).withColumn("morph_name", F.col("id").cast("string"))
    turned = c.withColumns({"rx": F.lit(0.0), "ry": F.lit(0.0), "rz": F.lit(90.0)})
    return C.voxel_intersection(C.world_points(turned, points(spark, d), ["axon"]), world(spark, d), 20.0).select("pre_id", "post_id")


_EXTENTS = """, mb AS (SELECT morph_name, min(x) AS lx, min(y) AS ly, min(z) AS lz, max(x) AS hx, max(y) AS hy, max(z) AS hz FROM pts GROUP BY ALL),
xa AS (SELECT c.id, chunk_id, c.x + lx AS lx, c.y + ly AS ly, c.z + lz AS lz, c.x + hx AS hx, c.y + hy AS hy, c.z + hz AS hz FROM cells c JOIN mb ON morph_name = c.id::VARCHAR WHERE cell_type = 'type_1'),
xb AS (SELECT id, chunk_id, x + 5 - 30 AS lx, y - 30 AS ly, z - 30 AS lz, x + 5 + 30 AS hx, y + 30 AS hy, z + 30 AS hz FROM cells WHERE cell_type = 'type_2'),
ka AS (SELECT chunk_id, min(lx) AS lx, min(ly) AS ly, min(lz) AS lz, max(hx) AS hx, max(hy) AS hy, max(hz) AS hz FROM xa GROUP BY ALL),
kb AS (SELECT chunk_id, min(lx) AS lx, min(ly) AS ly, min(lz) AS lz, max(hx) AS hx, max(hy) AS hy, max(hz) AS hz FROM xb GROUP BY ALL)
"""
_MEET = "a.lx <= b.hx AND b.lx <= a.hx AND a.ly <= b.hy AND b.ly <= a.hy AND a.lz <= b.hz AND b.lz <= a.hz"


def _sides(spark: SparkSession, d: str, c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boxes of the morphologies of type 1, and of spheres about cells of type 2."""
    named = c.withColumn("morph_name", F.col("id").cast("string"))
    return X.morphology_extents(named.where("cell_type = 'type_1'"), points(spark, d)), X.solid_extents(c.where("cell_type = 'type_2'"), SOLIDS["sphere"][0])


@query(_EXTENTS + f"SELECT a.chunk_id AS pre_chunk, b.chunk_id AS post_chunk FROM ka a JOIN kb b ON {_MEET}")
def extent_region(spark, d):
    pre, post = _sides(spark, d, cells(spark, d))
    return X.region_of_extents(X.chunk_extents(pre), X.chunk_extents(post), SIZE)


@query(_EXTENTS + f"SELECT a.id AS pre_id, b.id AS post_id FROM xa a JOIN xb b ON {_MEET}")
def extent_edges(spark, d):
    """Cells are stored, the region of interest says which chunks of either side to read again, and only files that hold these are opened."""
    store = _scratch_store(spark, 50)
    store.append("cells", numbered(spark, d).drop("labels"))
    pre, post = _sides(spark, d, store.read("cells"))
    region = cut(X.region_of_extents(X.chunk_extents(pre), X.chunk_extents(post), SIZE), "region")
    a = store.read("cells", cell_type="type_1", chunk_id=region.select("pre_chunk"))
    b = store.read("cells", cell_type="type_2", chunk_id=region.select("post_chunk"))
    return X.meeting_cells(_sides(spark, d, a)[0], _sides(spark, d, b)[1], None, 60.0)


_SIZED = f""", va AS (SELECT id, floor(x / 20)::BIGINT AS ix, floor(y / 20)::BIGINT AS iy, floor(z / 20)::BIGINT AS iz, list(struct_pack(b := branch_id, p := point_id) ORDER BY branch_id, point_id) AS pa FROM world GROUP BY ALL),
vb AS (SELECT id, floor(x / 45)::BIGINT AS jx, floor(y / 45)::BIGINT AS jy, floor(z / 45)::BIGINT AS jz, list(struct_pack(b := branch_id, p := point_id) ORDER BY branch_id, point_id) AS pb FROM world GROUP BY ALL),
sh AS (SELECT a.id AS pre_id, b.id AS post_id, pa, pb, ix, iy, iz, jx, jy, jz, len(pa) * len(pb) AS weight FROM va a JOIN vb b ON ix * 20 <= jx * 45 + 45 AND jx * 45 <= ix * 20 + 20 AND iy * 20 <= jy * 45 + 45 AND jy * 45 <= iy * 20 + 20 AND iz * 20 <= jz * 45 + 45 AND jz * 45 <= iz * 20 + 20),
cu AS (SELECT *, sum(weight) OVER (PARTITION BY pre_id, post_id ORDER BY ix, iy, iz, jx, jy, jz)::BIGINT AS upto, sum(weight) OVER (PARTITION BY pre_id, post_id)::BIGINT AS total FROM sh),
dr AS (SELECT *, {bits_sql(9, 'pre_id', 'post_id', '1')} % total AS pick FROM cu),
ok AS (SELECT *, pick - (upto - weight) AS i FROM dr WHERE pick < upto AND pick >= upto - weight)
SELECT pre_id, pa[(i // len(pb)) + 1].b AS pre_branch, pa[(i // len(pb)) + 1].p AS pre_point, post_id, pb[(i % len(pb)) + 1].b AS post_branch, pb[(i % len(pb)) + 1].p AS post_point FROM ok"""


@query(_SIZED)
def voxel_intersection_sizes(spark, d):
    """Voxels of 20 on one side and of 45 on the other."""
    w = world(spark, d)
    return C.voxel_box_intersection(V.voxel_boxes(w, ["id"], 20.0), V.voxel_boxes(w, ["id"], 45.0), 20.0, seed=9)


_SIDES_SQL = """, wb AS (SELECT id, max(x) - min(x) AS x, max(y) - min(y) AS y, max(z) - min(z) AS z FROM world GROUP BY ALL),
so AS (SELECT id, x, y, z, least(x, y, z) AS a, greatest(x, y, z) AS c, x + y + z - least(x, y, z) - greatest(x, y, z) AS m0 FROM wb),
md AS (SELECT *, list_sort([x, y, z])[2] AS m FROM so),
pa AS (SELECT *, greatest(1, floor(a / c * (50 / (a / c * (m / c))) ** (1 / 3.0::DOUBLE))) AS na FROM md), pb AS (SELECT *, greatest(1, floor(m / c * sqrt(50 / na / (m / c)))) AS nb FROM pa),
pc AS (SELECT *, round_even(50 / na / nb, 0) AS nc FROM pb),
di AS (SELECT id, x / CASE x WHEN a THEN na WHEN m THEN nb ELSE nc END AS sx, y / CASE y WHEN a THEN na WHEN m THEN nb ELSE nc END AS sy, z / CASE z WHEN a THEN na WHEN m THEN nb ELSE nc END AS sz FROM pc)
"""


@query(_SIDES_SQL + "SELECT w.id, count(*) AS n_points, count(DISTINCT (floor(x / sx), floor(y / sy), floor(z / sz))) AS n_voxels, round(any_value(sx), 6) AS sx, round(any_value(sz), 6) AS sz FROM world w JOIN di USING (id) GROUP BY ALL")
def voxels_by_number(spark, d):
    """Fifty voxels, or about so many, for the box of each cell; those that hold points."""
    v = V.numbered_voxels(world(spark, d), 50, ["id"])
    return v.groupBy("id").agg(F.sum(F.size("at")).alias("n_points"), F.count(F.lit(1)).alias("n_voxels"), F.round(F.min(F.col("hx") - F.col("lx")), 6).alias("sx"), F.round(F.min(F.col("hz") - F.col("lz")), 6).alias("sz"))


_LABELLED = _VOX.replace("vox AS", "vp AS").replace("FROM world", "FROM (SELECT w.* FROM world w JOIN pts p ON p.morph_name = w.id::VARCHAR AND p.branch_id = w.branch_id AND p.point_id = w.point_id WHERE label = 'axon')") + ", " + _VOX.replace("vox AS", "vq AS").replace("FROM world", "FROM (SELECT w.* FROM world w JOIN pts p ON p.morph_name = w.id::VARCHAR AND p.branch_id = w.branch_id AND p.point_id = w.point_id WHERE label IN ('dendrites', 'soma'))")


@query(f""", {_LABELLED},
sh AS (SELECT a.id AS pre_id, b.id AS post_id, a.pa AS pa, b.pa AS pb, ix, iy, iz, len(a.pa) * len(b.pa) AS weight FROM vp a JOIN vq b USING (ix, iy, iz)),
cu AS (SELECT *, sum(weight) OVER (PARTITION BY pre_id, post_id ORDER BY ix, iy, iz)::BIGINT AS upto, sum(weight) OVER (PARTITION BY pre_id, post_id)::BIGINT AS total FROM sh),
dr AS (SELECT *, {bits_sql(5, 'pre_id', 'post_id', '1')} % total AS pick FROM cu),
ok AS (SELECT *, pick - (upto - weight) AS i FROM dr WHERE pick < upto AND pick >= upto - weight)
SELECT pre_id, pa[(i // len(pb)) + 1].b AS pre_branch, pa[(i // len(pb)) + 1].p AS pre_point, post_id, pb[(i % len(pb)) + 1].b AS post_branch, pb[(i % len(pb)) + 1].p AS post_point FROM ok""")
def labelled_sides(spark, d):
    """Axons of one side against dendrites and somata of the other: edges are found on morphologies cut down to these, and come back on the original points."""
    c = cells(spark, d).withColumn("morph_name", F.col("id").cast("string"))
    p, b = points(spark, d), branches(spark, d)
    pre, post = derived(p, b, ["axon"]), derived(p, b, ["dendrites", "soma"])
    a, z = pre.of(c), post.of(c)
    return C.voxel_intersection(C.world_points(a, pre.on_originals()), C.world_points(z, post.on_originals()), 20.0, seed=5)


@query("""SELECT c.id, CASE branch_id WHEN 0 THEN 0 WHEN 2 THEN 1 END AS branch_id, CASE WHEN branch_id = 0 THEN point_id - 2 ELSE point_id END AS point_id, p.x, round(radius, 6) AS radius
  FROM cells c JOIN pts p ON p.morph_name = (c.id - c.id % 3)::VARCHAR WHERE label = 'dendrites'""")
def cell_morphologies(spark, d):
    """Three cells share a morphology; of each, the dendrites."""
    c = cells(spark, d).select("id", (F.col("id") - F.col("id") % 3).cast("string").alias("morph_name"))
    p = load_morphologies(c, points(spark, d), branches(spark, d), ["dendrites"])
    return p.select("id", "branch_id", F.col("point_id").cast("int").alias("point_id"), "x", F.round("radius", 6).alias("radius"))


_GROW = f""", ke AS (SELECT DISTINCT p_size::VARCHAR AS k FROM part),
gr AS (SELECT k, 0 AS b, NULL::INTEGER AS up, 0.0::DOUBLE AS x, 0.0::DOUBLE AS z, 1.0::DOUBLE AS r, 1 AS g FROM ke UNION ALL
  SELECT k, 2 * b + c, b, x + 3 * (2 * {uniform_sql('4-x', 'k', 'b')} - 1) * 10, z + 3 * (2 * {uniform_sql('4-z', 'k', 'b')} - 1) * 10, r * 0.8::DOUBLE, g + 1 FROM gr, (VALUES (1), (2)) v(c) WHERE g < 4 AND {uniform_sql('4-split', 'k', 'b')} < 0.7),
nm AS (SELECT k, 'grown-' || (row_number() OVER (ORDER BY k) - 1) AS name FROM ke)
"""


@query(_GROW + f"""SELECT name AS morph_name, b AS branch_id, up AS parent_branch, i AS point_id, round(x + i * (2 * {uniform_sql('4-x', 'k', 'b')} - 1) * 10, 6) + 0.0 AS x, round(z + i * (2 * {uniform_sql('4-z', 'k', 'b')} - 1) * 10, 6) + 0.0 AS z, round(r, 6) AS radius,
  (SELECT count(*) FROM part WHERE p_size::VARCHAR = k) AS cells FROM gr JOIN nm USING (k), range(4) ii(i)""")
def grown_morphologies(spark, d):
    """A tree for each size of parts, of up to four generations; parts of one size share theirs."""
    parts = table(spark, d, "part").select("p_partkey", "p_size")
    c, p, b = G.generated(parts, "p_size", "grown", generations=4, seed=4)
    p = p.join(b, ["morph_name", "branch_id"]).join(c.groupBy("morph_name").agg(F.count(F.lit(1)).alias("cells")), "morph_name")
    return rounded(p, "x", "z").select("morph_name", "branch_id", "parent_branch", F.col("point_id").cast("long").alias("point_id"), "x", "z", F.round("radius", 6).alias("radius"), "cells")


@query("SELECT s.id AS pre_id, -1 AS pre_branch, -1 AS pre_point, w.id AS post_id, branch_id AS post_branch, point_id AS post_point FROM world w JOIN cells s ON s.cell_type = 'type_0' AND (w.x - s.x) ** 2 + (w.y - s.y) ** 2 + (w.z - s.z) ** 2 <= 900")
def shape_to_morphology(spark, d):
    spheres = cells(spark, d).where("cell_type = 'type_0'").select("id", "x", "y", "z", F.lit(30.0).alias("radius"))
    return C.shape_to_morphology(spheres, world(spark, d), 60.0)


@query("SELECT w.id AS pre_id, branch_id AS pre_branch, point_id AS pre_point, s.id AS post_id, -1 AS post_branch, -1 AS post_point FROM world w JOIN cells s ON s.cell_type = 'type_1' AND (w.x - s.x) ** 2 + (w.y - s.y) ** 2 + (w.z - s.z) ** 2 <= 900")
def morphology_to_shape(spark, d):
    spheres = cells(spark, d).where("cell_type = 'type_1'").select("id", "x", "y", "z", F.lit(30.0).alias("radius"))
    return C.morphology_to_shape(world(spark, d), spheres, 60.0)


@query("SELECT w.id AS pre_id, s.id AS post_id FROM world w JOIN cells s ON s.cell_type = 'type_2' AND (w.x - s.x) ** 2 + (w.y - s.y) ** 2 + (w.z - s.z) ** 2 <= 625")
def shape_to_shape(spark, d):
    spheres = cells(spark, d).where("cell_type = 'type_2'").select("id", "x", "y", "z", F.lit(25.0).alias("radius"))
    cloud = world(spark, d).select("id", (F.col("branch_id") * 5 + F.col("point_id")).alias("point_id"), "x", "y", "z")
    return C.shape_to_shape(cloud, spheres, 50.0).select("pre_id", "post_id")


@query(f""", k AS (SELECT id, branch_id, point_id, row_number() OVER (PARTITION BY id ORDER BY branch_id, point_id) - 1 AS k, count(*) OVER (PARTITION BY id) AS n FROM world)
SELECT e.pre_id, branch_id AS pre_branch, point_id AS pre_point, e.post_id FROM ({_NEAR}) e JOIN k ON k.id = e.pre_id AND k.k = {bits_sql(8, 'e.pre_id', 'e.post_id')} % k.n""")
def random_locations(spark, d):
    e = C.edges_of(neighbours(spark, d), F.col("pre_id"), F.col("post_id"))
    return C.random_locations(e, world(spark, d), "pre", 8).select("pre_id", "pre_branch", "pre_point", "post_id")


@query("SELECT c_custkey AS pre_id, o_orderkey AS post_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey % 7 <> 0")
def edge_import(spark, d):
    raw = table(spark, d, "orders").select(F.when(F.col("o_custkey") % 7 == 0, "none").otherwise(F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).alias("pre"), F.col("o_orderkey").cast("string").alias("post"))
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").cast("double").alias("key"))
    return I.edges_from_csv(raw, pre=known).select("pre_id", "post_id")


@query("SELECT c_mktsegment AS cell_type, count(*) AS n, count(*) FILTER (c_custkey % 5 = 0) AS lost, round(sum(CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END), 2) AS total FROM customer GROUP BY ALL")
def point_import(spark, d):
    raw = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 5 == 0, "?").otherwise(F.col("c_custkey").cast("string")).alias("x"), F.lit("1").alias("y"), F.lit(" 2 ").alias("z"), F.col("c_mktsegment").alias("type"), F.col("c_acctbal").cast("string").alias("balance"))
    p = I.points_from_csv(raw, SIZE)
    return p.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.isnan("x") & F.col("chunk_id").isNull()).alias("lost"), F.round(F.sum(F.when(F.col("chunk_id").isNotNull(), F.element_at("extra", "balance"))), 2).alias("total"))


# Shapes.

SPHERE, ELLIPSOID = S.Sphere((0.0, 0.0, 0.0), 90.0), S.Ellipsoid((10.0, 0.0, 0.0), (120.0, 60.0, 90.0))
CYLINDER, CONE = S.Cylinder((0.0, 0.0, -80.0), 70.0, (0.0, 0.0, 90.0)), S.Cone((0.0, 0.0, 100.0), (0.0, 0.0, -100.0), 100.0)
CUBOID = S.cuboid((0.0, 0.0, -50.0), (0.0, 0.0, 60.0), 160.0, 100.0)
SLANTED = S.Parallelepiped((-60.0, -60.0, -60.0), ((120.0, 0.0, 0.0), (40.0, 120.0, 0.0), (0.0, 30.0, 110.0)))


@query("""SELECT id, sqrt(x * x + y * y + z * z) < 90.001 AS sphere, ((x - 10) / 120) ** 2 + (y / 60) ** 2 + (z / 90) ** 2 < 1 AS ellipsoid,
  x * x + y * y < 4900.001 AND z > -80.001 AND z < 90.001 AS cylinder, z <= 100 AND z >= -100 AND x * x + y * y <= ((100 - z) / 2) ** 2 AS cone,
  abs(x) < 80 AND abs(y) < 50 AND z > -50 AND z < 60 AS cuboid,
  (z + 60) / 110 BETWEEN 0 AND 1 AND ((y + 60) - 30 * (z + 60) / 110) / 120 BETWEEN 0 AND 1 AND ((x + 60) - 40 * ((y + 60) - 30 * (z + 60) / 110) / 120) / 120 BETWEEN 0 AND 1 AS slanted FROM cells""")
def shape_containment(spark, d):
    p = [F.col(c) for c in "xyz"]
    named = {"sphere": SPHERE, "ellipsoid": ELLIPSOID, "cylinder": CYLINDER, "cone": CONE, "cuboid": CUBOID, "slanted": SLANTED}
    return cells(spark, d).select("id", *(s.inside(p).alias(n) for n, s in named.items()))


#: Each solid about a cell's place, and when it holds a point at (x, y, z) from there.
SOLIDS: dict[str, tuple[S.Shape, str]] = {
    "sphere": (S.Sphere((5.0, 0.0, 0.0), 30.0), "sqrt((x - 5) ** 2 + y ** 2 + z ** 2) < 30.001"),
    "ellipsoid": (S.Ellipsoid((0.0, 0.0, 5.0), (40.0, 20.0, 30.0)).rotated(0.0, 0.0, 90.0), "(y / 40) ** 2 + (x / 20) ** 2 + ((z - 5) / 30) ** 2 < 1"),
    "cylinder": (S.Cylinder((0.0, 0.0, -30.0), 25.0, (0.0, 0.0, 30.0)).rotated(90.0, 0.0, 0.0), "x ** 2 + z ** 2 < 625.001 AND abs(y) < 30.001"),
    "cone": (S.Cone((0.0, 0.0, 40.0), (0.0, 0.0, -40.0), 40.0).translated((0.0, 0.0, 10.0)), "z <= 50 AND z >= -30 AND x * x + y * y <= ((50 - z) / 2) ** 2"),
    "cuboid": (S.cuboid((0.0, 0.0, -20.0), (0.0, 0.0, 30.0), 50.0, 40.0), "abs(x) < 25 AND abs(y) < 20 AND z > -20 AND z < 30"),
    "parallelepiped": (S.Parallelepiped((-20.0, -20.0, -20.0), ((40.0, 0.0, 0.0), (10.0, 40.0, 0.0), (0.0, 0.0, 40.0))), "abs(z) < 20 AND abs(y) < 20 AND (x + 20 - (y + 20) / 4) / 40 > 0 AND (x + 20 - (y + 20) / 4) / 40 < 1"),
}


def _solid_queries(name: str, solid: S.Shape, holds: str) -> None:
    near = f"(SELECT s.id AS sid, w.id AS wid, branch_id, point_id, w.x - s.x AS x, w.y - s.y AS y, w.z - s.z AS z FROM world w JOIN cells s ON s.cell_type = 'type_3') WHERE {holds}"

    def to_morphology(spark, d):
        return C.shape_to_morphology(cells(spark, d).where("cell_type = 'type_3'"), world(spark, d), 60.0, shape=solid)

    def to_shape(spark, d):
        return C.morphology_to_shape(world(spark, d), cells(spark, d).where("cell_type = 'type_3'"), 60.0, shape=solid).select("pre_id", "pre_branch", "pre_point", "post_id")

    to_morphology.__name__, to_shape.__name__ = f"{name}_to_morphology", f"morphology_to_{name}"
    query(f"SELECT sid AS pre_id, -1 AS pre_branch, -1 AS pre_point, wid AS post_id, branch_id AS post_branch, point_id AS post_point FROM {near}")(to_morphology)
    query(f"SELECT wid AS pre_id, branch_id AS pre_branch, point_id AS pre_point, sid AS post_id FROM {near}")(to_shape)


for _name, (_solid, _holds) in SOLIDS.items():
    _solid_queries(_name, _solid, _holds)


@query(f"""SELECT p.id AS pre_id, s.id AS post_id, count(*) AS n FROM (SELECT id, x + (-25 + 50 * {uniform_sql('6-0-0', 'id', 'k')}) AS x, y + (-20 + 40 * {uniform_sql('6-0-1', 'id', 'k')}) AS y, z + (-20 + 50 * {uniform_sql('6-0-2', 'id', 'k')}) AS z
  FROM cells, range(12) r(k) WHERE cell_type = 'type_4') p JOIN cells s ON s.cell_type = 'type_5' AND abs(p.x - s.x) < 25 AND abs(p.y - s.y) < 20 AND p.z - s.z > -20 AND p.z - s.z < 30 GROUP BY ALL""")
def composition_to_shape(spark, d):
    """Twelve random points in the cuboid of each pre cell, against those of the post cells."""
    both = S.Composition((SOLIDS["cuboid"][0],), (("soma",),))
    cloud = C.shape_cloud(cells(spark, d).where("cell_type = 'type_4'"), both, 20.0, 6)
    return C.shape_to_shape(cloud, cells(spark, d).where("cell_type = 'type_5'"), 60.0, shape=both).groupBy("pre_id", "post_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT least(floor(count(*) * 0.25::DOUBLE), count(*))::BIGINT AS n, 0::BIGINT AS n_others FROM world w JOIN cells s ON s.cell_type = 'type_2' AND (w.x - s.x) ** 2 + (w.y - s.y) ** 2 + (w.z - s.z) ** 2 <= 625""")
def shape_pruning(spark, d):
    """Exactly a quarter of all edges stays, rounded down; none is new."""
    spheres = cells(spark, d).where("cell_type = 'type_2'").select("id", "x", "y", "z", F.lit(25.0).alias("radius"))
    cloud = world(spark, d).select("id", (F.col("branch_id") * 5 + F.col("point_id")).alias("point_id"), "x", "y", "z")
    kept, every = C.shape_to_shape(cloud, spheres, 50.0, pruning=0.25, seed=2), C.shape_to_shape(cloud, spheres, 50.0)
    others = kept.join(every.select("pre_id", "post_id").distinct().withColumn("known", F.lit(1)), ["pre_id", "post_id"], "left")
    return others.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("known").isNull()).alias("n_others"))


@query("SELECT id FROM cells WHERE (abs(x) < 90 AND abs(y) < 90 AND abs(z) < 90 AND sqrt(x * x + y * y + z * z) < 90.001) OR (abs(x) < 80 AND abs(y) < 50 AND z > -50 AND z < 60)")
def shape_composition(spark, d):
    both = S.Composition((SPHERE, CUBOID, CONE), (("a",), ("b", "a"), ("c",))).only(["a"])
    return cells(spark, d).where(both.inside([F.col(c) for c in "xyz"])).select("id")


@query("""SELECT p_partkey, round(4.0 / 3 * pi() * p_size ** 3, 4) AS sphere, round(pi() * p_size * 20 * (p_size + 1), 4) AS ellipsoid, round(pi() * p_size ** 2 * 50, 4) AS cylinder,
  round(pi() * p_size ** 2 * 50 / 3, 4) AS cone, round(abs(p_size * 30.0 * 7), 4) AS slanted FROM part""")
def shape_volumes(spark, d):
    """Solids whose sides are columns: one of each for every part."""
    r = F.col("p_size").cast("double")
    solids = {
        "sphere": S.Sphere((0.0, 0.0, 0.0), r), "ellipsoid": S.Ellipsoid((0.0, 0.0, 0.0), (r, 20.0, r + 1)), "cylinder": S.Cylinder((0.0, 0.0, 0.0), r, (0.0, 30.0, 40.0)),
        "cone": S.Cone((0.0, 0.0, 0.0), (30.0, 0.0, 40.0), r), "slanted": S.Parallelepiped((0.0, 0.0, 0.0), ((r, 0.0, 0.0), (5.0, 30.0, 0.0), (1.0, 2.0, -7.0))),
    }
    return table(spark, d, "part").select("p_partkey", *(F.round(s.volume(), 4).alias(n) for n, s in solids.items()))


@query(f"""SELECT id, k, round(90 * cbrt(u) * sqrt(1 - (2 * v - 1) ** 2) * cos(2 * pi() * w), 5) + 0.0 AS x, round(90 * cbrt(u) * (2 * v - 1), 5) + 0.0 AS z, true AS inside
FROM (SELECT id, k, {uniform_sql(0, 'id', 'k')} AS u, {uniform_sql(1, 'id', 'k')} AS v, {uniform_sql(2, 'id', 'k')} AS w FROM cells, (SELECT unnest(range(1, 11)) AS k))""")
def shape_clouds(spark, d):
    """Ten points of a sphere at each cell; all are inside it, and so are those of the other solids."""
    rows = cells(spark, d).select("id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long"))).alias("k"))
    p = SPHERE.point([keyed_uniform(i, "id", "k") for i in range(3)])
    others = {"q": CONE, "e": ELLIPSOID, "c": CYLINDER, "b": CUBOID, "s": SLANTED}
    made = [c.alias(f"{n}{i}") for n, s in others.items() for i, c in enumerate(s.point([keyed_uniform(i, "id", "k") for i in range(3)]))]
    at = rows.select("id", "k", *(c.alias(f"p{i}") for i, c in enumerate(p)), *made)
    inside = SPHERE.inside([F.col(f"p{i}") for i in range(3)])
    for n, s in others.items():
        inside = inside & s.inside([F.col(f"{n}{i}") for i in range(3)])
    return at.select("id", "k", (F.round("p0", 5) + 0.0).alias("x"), (F.round("p2", 5) + 0.0).alias("z"), inside.alias("inside"))


_OVAL = S.Ellipsoid((0.0, 0.0, 0.0), (40.0, 20.0, 30.0))


@query(f""", ar AS (SELECT i, j, sqrt((600 * sin(f) ** 2 * cos(t)) ** 2 + (1200 * sin(f) ** 2 * sin(t)) ** 2 + (800 * sin(f) * cos(f)) ** 2) AS a
  FROM (SELECT i, j, pi() * (i + 0.5) / {BANDS} AS f, 2 * pi() * (j + 0.5) / {BANDS} AS t FROM range({BANDS}) ii(i), range({BANDS}) jj(j))),
ba AS (SELECT i, sum(a) AS a FROM ar GROUP BY i), bc AS (SELECT i, a, sum(a) OVER (ORDER BY i) - a AS low, sum(a) OVER () AS total FROM ba),
dr AS (SELECT id, k, {uniform_sql('12-0', 'id', 'k')} AS u FROM cells, range(8) kk(k)),
on_e AS (SELECT id, k, i, cos(i * pi() / {BANDS}) + (cos((i + 1) * pi() / {BANDS}) - cos(i * pi() / {BANDS})) * (u * total - low) / a AS c FROM dr JOIN bc ON u * total >= low AND u * total < low + a)
SELECT id, k, round(30 * c, 5) + 0.0 AS z, true AS on_oval, true AS on_drum, true AS on_cone, true AS on_block FROM on_e""")
def surface_points(spark, d):
    """Eight points on the surface of solids at each cell: their heights on an ellipsoid, and whether each is where it should be."""
    rows = cells(spark, d).select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("k"))
    u = [keyed_uniform(f"12-{i}", "id", "k") for i in range(3)]
    solids = {"e": _OVAL, "c": S.Cylinder((0.0, 0.0, -30.0), 25.0, (0.0, 0.0, 30.0)), "q": S.Cone((0.0, 0.0, 40.0), (0.0, 0.0, -40.0), 20.0), "b": S.Parallelepiped((0.0, 0.0, 0.0), ((40.0, 0.0, 0.0), (0.0, 30.0, 0.0), (0.0, 0.0, 20.0)))}
    at = rows.select("id", "k", *(c.alias(f"{n}{v}") for n, s in solids.items() for c, v in zip(surface_point(s, u), "xyz", strict=True)))
    flat = lambda n: F.sqrt(F.col(f"{n}x") * F.col(f"{n}x") + F.col(f"{n}y") * F.col(f"{n}y"))
    near = lambda a, b: F.abs(a - b) < 1e-6
    oval = near(F.pow(F.col("ex") / 40, F.lit(2.0)) + F.pow(F.col("ey") / 20, F.lit(2.0)) + F.pow(F.col("ez") / 30, F.lit(2.0)), 1.0)
    drum = (near(flat("c"), 25.0) & (F.abs("cz") <= 30)) | (near(F.abs("cz"), 30.0) & (flat("c") <= 25))
    cone = (near(flat("q"), (40 - F.col("qz")) / 4) & (F.abs("qz") <= 40 + 1e-6)) | (near(F.col("qz"), -40.0) & (flat("q") <= 20))
    block = reduce(lambda a, b: a | b, [near(F.col(f"b{v}"), x) for v, m in (("x", 40.0), ("y", 30.0), ("z", 20.0)) for x in (0.0, m)])
    return at.select("id", "k", (F.round("ez", 5) + 0.0).alias("z"), oval.alias("on_oval"), drum.alias("on_drum"), cone.alias("on_cone"), block.alias("on_block"))


_GAMMA, _BETA = Tabulated.of("gamma", a=2.5, scale=2.0), Tabulated.of("beta", a=0.5, b=1.5, loc=1.0)


def _table_sql(t: Tabulated, u: str) -> str:
    """The place in a table at the quantile u."""
    at = f"least({KNOTS}, greatest(0, (ln({u}) - ln(1 - {u}) - {t.first!r}::DOUBLE) * {KNOTS / (t.last - t.first)!r}::DOUBLE))"
    i = f"least({KNOTS - 1}, floor({at}))::INTEGER"
    return f"(tab[{i} + 1] + ({at} - {i}) * (tab[{i} + 2] - tab[{i} + 1]))"


@query(f""", g AS (SELECT id, {uniform_sql('g', 'id')} AS u, {list(_GAMMA.places)!r}::DOUBLE[] AS tab FROM cells), b AS (SELECT id, {uniform_sql('b', 'id')} AS u, {list(_BETA.places)!r}::DOUBLE[] AS tab FROM cells)
SELECT g.id, round(2 * exp({_table_sql(_GAMMA, 'g.u').replace('tab', 'g.tab')}), 6) AS gamma, round(1 + 1 / (1 + exp(-{_table_sql(_BETA, 'b.u').replace('tab', 'b.tab')})), 6) AS beta FROM g JOIN b USING (id)""")
def tabulated_draws(spark, d):
    """Draws from distributions whose quantile functions have no closed form."""
    return cells(spark, d).select("id", F.round(_GAMMA.draw("g", "id"), 6).alias("gamma"), F.round(_BETA.draw("b", "id"), 6).alias("beta"))


# Placement.



def partitions(spark: SparkSession, d: str) -> DataFrame:
    """A stack of layers for each region, a layer a nation; the nation with a 3 as its last digit starts at the region's floor."""
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("stack"), F.col("n_nationkey").alias("place"), F.concat(F.lit("n"), "n_nationkey").alias("partition"), (-100.0 - 10 * F.col("n_regionkey")).alias("lx"), F.lit(-100.0).alias("ly"), (50.0 * F.col("n_regionkey") - 100).alias("lz"), F.lit(150.0).alias("hx"), F.lit(100.0).alias("hy"))
    return L.stacked(n.withColumn("hz", F.col("lz") + 10.0 + 3 * F.col("place")), ["stack"], ["place"], anchor=F.col("place") % 10 == 3)


_STACKED = """pt0 AS (SELECT n_regionkey AS stack, n_nationkey AS place, 'n' || n_nationkey AS partition, (-100 - 10 * n_regionkey)::DOUBLE AS lx, -100.0::DOUBLE AS ly, (50 * n_regionkey - 100)::DOUBLE AS base, 150.0::DOUBLE AS hx, 100.0::DOUBLE AS hy, (10 + 3 * n_nationkey)::DOUBLE AS thick FROM nation),
pt1 AS (SELECT *, coalesce(sum(thick) OVER (PARTITION BY stack ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM pt0),
pt2 AS (SELECT *, base + start - coalesce(max(CASE WHEN place % 10 = 3 THEN start END) OVER (PARTITION BY stack), 0) AS lz FROM pt1),
pt AS (SELECT *, lz + thick AS hz FROM pt2)"""


@query(f", {_STACKED} SELECT stack, partition, lz, hz FROM pt")
def stack_layout(spark, d):
    return partitions(spark, d).select("stack", "partition", "lz", "hz")


_CHUNKED = _STACKED + """, ch AS (SELECT p.partition, cx, cy, cz, greatest(lx, cx * 100) AS lx, greatest(ly, cy * 100) AS ly, greatest(lz, cz * 100) AS lz,
  least(hx, cx * 100 + 100) AS hx, least(hy, cy * 100 + 100) AS hy, least(hz, cz * 100 + 100) AS hz
  FROM pt p, range(-2, 2) a(cx), range(-1, 1) b(cy), range(-8, 9) c(cz) WHERE cx * 100 < hx AND cx * 100 + 100 > lx AND cy * 100 < hy AND cy * 100 + 100 > ly AND cz * 100 < hz AND cz * 100 + 100 > lz),
chv AS (SELECT partition, ((cx & 65535) + ((cy & 65535) << 16) + ((cz & 65535) << 32))::BIGINT AS chunk_id, ((hx - lx) * (hy - ly) * (hz - lz))::DOUBLE AS volume, ((hx - lx) * (hy - ly))::DOUBLE AS area FROM ch)"""


@query(f", {_CHUNKED} SELECT * FROM chv")
def partition_chunks(spark, d):
    return V.box_chunks(partitions(spark, d), SIZE).select("partition", "chunk_id", "volume", "area")


def _indicated(spark, d):
    per_chunk = V.box_chunks(partitions(spark, d), SIZE).groupBy("chunk_id").agg(F.sum("volume").alias("volume"), F.sum("area").alias("area"))
    dense = P.Indicator(density=1e-5)
    kinds = {"counted": P.Indicator(count=500), "dense": dense, "planar": P.Indicator(planar_density=1e-3, count=7), "related": P.Indicator(relative_to=dense, density_ratio=0.3), "ratio": P.Indicator(relative_to=P.Indicator(count=500), count_ratio=0.5)}
    return P.chunk_counts(per_chunk, kinds, 4)


_INDICATED = f""", {_CHUNKED},
pc AS (SELECT chunk_id, sum(volume) AS volume, sum(area) AS area FROM chv GROUP BY ALL),
es AS (SELECT k AS cell_type, chunk_id, CASE k WHEN 'counted' THEN 500.0::DOUBLE * volume / total WHEN 'dense' THEN 1e-5 * volume WHEN 'planar' THEN 1e-3 * area
  WHEN 'related' THEN 1e-5 * volume * 0.3 ELSE 500.0::DOUBLE * volume / total * 0.5 END AS estimate FROM pc, (SELECT sum(volume) AS total FROM pc), (VALUES ('counted'), ('dense'), ('planar'), ('related'), ('ratio')) kk(k)),
ind AS (SELECT *, (floor(estimate) + CASE WHEN {uniform_sql(4, 'cell_type', 'chunk_id')} < estimate - floor(estimate) THEN 1 ELSE 0 END)::BIGINT AS n FROM es)"""


@query(_INDICATED + " SELECT cell_type, chunk_id, round(estimate, 6) AS estimate, n FROM ind")
def indicator_counts(spark, d):
    return _indicated(spark, d).withColumn("estimate", F.round("estimate", 6))


_PLACED = _INDICATED + f""", bx AS (SELECT i.*, {", ".join(f"(((chunk_id >> {16 * i}) & 65535) - CASE WHEN ((chunk_id >> {16 * i}) & 65535) >= 32768 THEN 65536 ELSE 0 END) * 100.0::DOUBLE AS l{c}" for i, c in enumerate("xyz"))} FROM ind i),
pn AS (SELECT *, unnest(range(1, n + 1)) AS k FROM bx WHERE n > 0)"""


@query(_PLACED + " SELECT cell_type, chunk_id, k, " + ", ".join(f"round(l{c} + {uniform_sql(f'6{c}', 'cell_type', 'chunk_id', 'k')} * 100, 6) + 0.0 AS {c}" for c in "xyz") + " FROM pn")
def random_placement(spark, d):
    made = P.random_points(V.chunk_corners(_indicated(spark, d), SIZE), ["cell_type", "chunk_id"], 6)
    return rounded(made, "x", "y", "z").select("cell_type", "chunk_id", "k", "x", "y", "z")


@query(_PLACED + f" SELECT cell_type, chunk_id, k, round(lz - 30 * ln(1 - {uniform_sql('6dz', 'cell_type', 'chunk_id', 'k')} * (1 - exp(-100 / 30.0::DOUBLE))), 6) + 0.0 AS z FROM pn")
def distributed_placement(spark, d):
    """Depths from an exponential distribution, cut off at the chunk's end."""
    made = P.distributed_points(V.chunk_corners(_indicated(spark, d), SIZE), ["cell_type", "chunk_id"], "z", "expon", 6, scale=30.0)
    return rounded(made, "z").select("cell_type", "chunk_id", "k", "z")


@query(f"SELECT voxel_id, k, round(voxel_id * 10 + {uniform_sql('9x', 'k')} * 10, 6) + 0.0 AS x, round(voxel_id * 10 + {uniform_sql('9z', 'k')} * 10, 6) + 0.0 AS z FROM (SELECT k, {bits_sql('9v', 'k')} % (SELECT count(*) FROM part) AS r FROM (SELECT unnest(range(1, 5001)) AS k)) JOIN (SELECT p_partkey AS voxel_id, row_number() OVER (ORDER BY {bits_sql('9-rank', 'p_partkey')}, p_partkey) - 1 AS r FROM part) USING (r)")
def random_voxel_placement(spark, d):
    low = F.col("p_partkey") * 10.0
    v = table(spark, d, "part").select(F.col("p_partkey").alias("voxel_id"), *(low.alias(f"l{c}") for c in "xyz"), *((low + 10).alias(f"h{c}") for c in "xyz"))
    return rounded(P.random_points_in_voxels(v, 5000, 9), "x", "z").select("voxel_id", "k", "x", "z")


@query(f"SELECT * FROM (SELECT 'part' AS cell_type, p_partkey AS voxel_id, p_size * 0.01 * 8 AS estimate, (floor(p_size * 0.01 * 8) + CASE WHEN {uniform_sql(2, chr(39) + 'part' + chr(39), 'p_partkey')} < p_size * 0.01 * 8 - floor(p_size * 0.01 * 8) THEN 1 ELSE 0 END)::BIGINT AS n FROM part)")
def voxel_density_counts(spark, d):
    v = table(spark, d, "part").select(F.col("p_partkey").alias("voxel_id"), F.lit(8.0).alias("volume"), F.create_map(F.lit("inhib"), F.col("p_size") * 0.01).alias("data"))
    return P.voxel_counts(v, {"part": P.Indicator(density_key="inhib", density=3.0)}, 2)


@query(f""", {_STACKED},
lt AS (SELECT p.*, r AS "row", c AS "column", (r * 50.0::DOUBLE + c * (20.0 * tan(radians(20.0)))) AS y0 FROM pt p, range(4) a(r), range(20) b(c) WHERE c < floor((hx - lx) / 20))
SELECT partition, "row", "column", round(lx + 20.0 * "column", 6) AS x, round(ly + y0 - 200.0 * floor(y0 / 200.0), 6) AS y, round(lz + {uniform_sql('0z', 'partition', '"row"', '"column"')} * (hz - lz), 6) AS z
FROM lt WHERE lx + 20.0 * "column" <= hx - 5 AND ly + y0 - 200.0 * floor(y0 / 200.0) <= 95""")
def lattice_placement(spark, d):
    made = P.lattice_in_boxes(partitions(spark, d), ["partition"], spacing=20.0, angle=20.0, radius=5.0, density=0.001)
    return rounded(made, "x", "y", "z").select("partition", "row", "column", "x", "y", "z")


@query("SELECT cell_type, s_suppkey::BIGINT AS k, s_acctbal / 10 AS x, s_nationkey * 7.0::DOUBLE AS y, (floor(s_acctbal / 1000)::BIGINT & 65535) + ((floor(s_nationkey * 7 / 100.0)::BIGINT & 65535) << 16) AS chunk_id FROM supplier, (VALUES ('a'), ('b')) t(cell_type)")
def fixed_placement(spark, d):
    at = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), (F.col("s_acctbal") / 10).alias("x"), (F.col("s_nationkey") * 7.0).alias("y"), F.lit(1.0).alias("z"))
    return P.fixed_points(spark, at, ["a", "b"], SIZE).select("cell_type", "k", "x", "y", "chunk_id")


@query("SELECT c_mktsegment AS cell_type, unnest(range(n))::INTEGER AS local_id, 0::BIGINT AS chunk_id FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)")
def entity_placement(spark, d):
    """As many entities of each type as a market segment has customers."""
    n = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("cell_type")).agg(F.count(F.lit(1)).alias("n"))
    return P.entities_of(n).select("cell_type", "local_id", "chunk_id")


@query("SELECT round(sum(4.0 / 3 * pi() * (p_size / 10.0) ** 3) / 1e6, 9) AS factor FROM part")
def packing(spark, d):
    p = table(spark, d, "part").select((F.col("p_size") / 10).alias("radius"), F.lit(1).alias("n"))
    return P.packing_factor(p, 1e6).select(F.round("factor", 9).alias("factor"))


@query(f"SELECT id, ['m0', 'm1', 'm2'][({bits_sql(1, 'cell_type', 'id')} % 3) + 1] AS by_chance, ['m0', 'm1', 'm2'][(local_id % 3) + 1] AS in_turn FROM numbered")
def morphology_choice(spark, d):
    n = numbered(spark, d)
    a = P.choose_morphology(n, ["m0", "m1", "m2"], ["cell_type", "id"], seed=1).withColumnRenamed("morph_name", "by_chance")
    return P.choose_morphology(a, ["m0", "m1", "m2"], [], "round_robin").select("id", "by_chance", F.col("morph_name").alias("in_turn"))


@query(f"SELECT id, round({uniform_sql('3rx', 'id')} * 360, 6) AS rx, round({uniform_sql('3rz', 'id')} * 360, 6) AS rz FROM cells")
def random_rotations(spark, d):
    return rounded(P.random_rotations(cells(spark, d), ["id"], 3), "rx", "rz").select("id", "rx", "rz")


@query("SELECT id, CASE WHEN id % 5 = 0 THEN 0.0 ELSE 1.0 END AS turned FROM cells")
def orientation_field(spark, d):
    """Directions along a field: the default direction, turned by the angles, is the field's; voxels without one aren't turned."""
    c = cells(spark, d).select("id", F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    field = c.select(F.floor("x").alias("ix"), F.lit(0).cast("long").alias("iy"), F.lit(0).cast("long").alias("iz"), F.when(F.col("id") % 5 == 0, 0.0).otherwise(F.sin("x") + 2).alias("vx"), F.when(F.col("id") % 5 == 0, 0.0).otherwise(F.cos("x")).alias("vy"), F.when(F.col("id") % 5 == 0, 0.0).otherwise(F.lit(0.5)).alias("vz"))
    v = [F.col(k) for k in ("vx", "vy", "vz")]
    out = P.field_rotations(c, field, 1.0).join(field.withColumnRenamed("ix", "fx"), F.floor("x") == F.col("fx"))
    to = times(euler_matrix(F.col("rx"), F.col("ry"), F.col("rz")), [F.lit(0.0), F.lit(-1.0), F.lit(0.0)])
    norm = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    along = (to[0] * v[0] + to[1] * v[1] + to[2] * v[2]) / F.when(norm > 0, norm)
    return out.select("id", F.round(F.coalesce(along, F.abs(F.col("rx")) + F.abs(F.col("ry")) + F.abs(F.col("rz"))), 6).alias("turned"))


@query("SELECT 0.0 AS error, (SELECT count(*) FROM cells) AS n")
def euler_round_trip(spark, d):
    """Angles to a matrix, to angles and to a matrix again, twice composed."""
    r = [keyed_uniform(i, "id") * 360 for i in range(3)]
    c = cells(spark, d).select("id", *(a.alias(n) for a, n in zip(r, ("rx", "ry", "rz"), strict=True)))
    m = euler_matrix(F.col("rx"), F.col("ry"), F.col("rz"))
    c = c.select("*", *(a.alias(n) for a, n in zip(matrix_euler(m), ("sx", "sy", "sz"), strict=True)))
    k = euler_matrix(F.col("sx"), F.col("sy"), F.col("sz"))
    one = product(m, [list(x) for x in zip(*k, strict=True)])
    off = sum((F.abs(one[i][j] - (1.0 if i == j else 0.0)) for i in range(3) for j in range(3)), F.lit(0.0))
    return c.agg((F.round(F.max(off), 6) + 0.0).alias("error"), F.count(F.lit(1)).alias("n"))


@query("SELECT id, round(x / n, 6) + 0.0 AS x, round(y / n, 6) + 0.0 AS y, round(z / n, 6) + 0.0 AS z FROM (SELECT *, sqrt(x * x + y * y + z * z) AS n FROM cells)")
def aligning_rotation(spark, d):
    """The upward direction, turned by the angles that take it to a cell's, points there."""
    c = cells(spark, d).select("id", "x", "y", "z")
    up = [F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    angles = matrix_euler(aligning_matrix(up, [F.col(v) for v in "xyz"]))
    c = c.select("id", *(a.alias(n) for a, n in zip(angles, ("rx", "ry", "rz"), strict=True)))
    turned = times(euler_matrix(F.col("rx"), F.col("ry"), F.col("rz")), up)
    return rounded(c.select("id", *(t.alias(v) for t, v in zip(turned, "xyz", strict=True))), "x", "y", "z")


@query(f"SELECT p_partkey, round(5 - 2 * ln(1 - {uniform_sql(0, 'p_partkey')}), 6) AS e, round(1 + 3 * {uniform_sql(1, 'p_partkey')}, 6) AS u FROM part")
def distributions(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(inverse_cdf("expon", keyed_uniform(0, "p_partkey"), loc=5, scale=2), 6).alias("e"), F.round(inverse_cdf("uniform", keyed_uniform(1, "p_partkey"), loc=1, scale=3), 6).alias("u"))


# Voxels.


def voxels(spark, d):
    c = cells(spark, d)
    return c.select(F.col("id").alias("voxel_id"), *(F.col(v).alias(f"l{v}") for v in "xyz"), F.lit(10.0).alias("sx"), F.lit(-20.0).alias("sy"), (F.col("id") % 3 * 5.0).alias("sz"))


@query("SELECT DISTINCT floor(x / 40)::BIGINT AS ix, floor(y / 40)::BIGINT AS iy, floor(z / 40)::BIGINT AS iz FROM cells")
def voxel_fill(spark, d):
    return V.fill(cells(spark, d), 40.0)


@query("SELECT min(id) AS voxel_id, floor(x / 40)::BIGINT AS ix, floor(y / 40)::BIGINT AS iy, floor(z / 40)::BIGINT AS iz FROM cells GROUP BY ix, iy, iz")
def voxel_snap(spark, d):
    return V.snap_to_grid(voxels(spark, d), 40.0, unique=True).select("voxel_id", "ix", "iy", "iz")


@query("SELECT id AS voxel_id FROM cells WHERE x >= -50 AND x < 100 AND y >= -50 AND y < 100 AND z >= -50 AND z < 100")
def voxel_crop(spark, d):
    return V.crop(voxels(spark, d), (-50.0,) * 3, (100.0,) * 3).select("voxel_id")


@query("SELECT id AS voxel_id FROM cells WHERE chunk_id = 65535")
def voxel_crop_chunk(spark, d):
    return V.crop_chunk(voxels(spark, d), 65535, SIZE).select("voxel_id")


@query("SELECT count(*) AS n, sum(abs(10.0::DOUBLE * -20 * (id % 3 * 5))) AS volume, false AS of_equal_size, false AS equilateral FROM cells")
def voxel_flags(spark, d):
    return V.size_flags(voxels(spark, d))


@query("SELECT min(x) AS lx, min(y - 20) AS ly, min(z) AS lz, max(x + 10) AS hx, max(y) AS hy, max(z + id % 3 * 5) AS hz FROM cells")
def voxel_bounds(spark, d):
    return V.bounds(V.as_boxes(voxels(spark, d)))


@query("SELECT id FROM cells p WHERE EXISTS (SELECT 1 FROM cells v WHERE v.cell_type = 'type_4' AND p.x >= v.x AND p.x < v.x + 10 AND p.y >= v.y - 20 AND p.y < v.y AND p.z >= v.z AND p.z < v.z + v.id % 3 * 5)")
def voxel_inside(spark, d):
    v = voxels(spark, d).join(cells(spark, d).where("cell_type = 'type_4'").select(F.col("id").alias("voxel_id")), "voxel_id", "left_semi")
    return V.inside(cells(spark, d), v, 25.0).select("id")


@query("SELECT c.id, v.voxel_id FROM cells c LEFT JOIN (SELECT min(id) AS voxel_id, floor(x / 40) AS ix, floor(y / 40) AS iy, floor(z / 40) AS iz FROM cells WHERE cell_type = 'type_0' GROUP BY 2, 3, 4) v ON floor(x / 40) = ix AND floor(y / 40) = iy AND floor(z / 40) = iz")
def voxel_index_of(spark, d):
    own = cells(spark, d).where("cell_type = 'type_0'").select(F.col("id").alias("voxel_id"), *(F.col(c).alias(f"l{c}") for c in "xyz"))
    return V.index_of(cells(spark, d), V.snap_to_grid(own, 40.0, unique=True), 40.0).select("id", "voxel_id")


@query("SELECT count(*) AS n, count(extra) AS n_extra FROM (SELECT id, NULL AS extra FROM cells UNION ALL SELECT id, id FROM cells WHERE id % 2 = 0)")
def voxel_concatenate(spark, d):
    v = voxels(spark, d)
    return V.concatenate(v, v.where("voxel_id % 2 = 0").withColumn("extra", F.col("voxel_id"))).agg(F.count(F.lit(1)).alias("n"), F.count("extra").alias("n_extra"))


@query("SELECT id, floor(x / 25)::BIGINT AS ix, floor(y / 25)::BIGINT AS iy, floor(z / 25)::BIGINT AS iz, count(*) AS n, string_agg(branch_id || ':' || point_id, ',' ORDER BY branch_id, point_id) AS at FROM world GROUP BY ALL")
def voxelize(spark, d):
    at = F.array_join(F.transform("at", lambda p: F.concat_ws(":", p["branch_id"].cast("string"), p["point_id"].cast("string"))), ",")
    return C.voxelized(world(spark, d), 25.0, ["id"]).withColumn("at", at)


@query("SELECT ix, 0 AS iy, 0 AS iz, ix % 4 AS a FROM (SELECT DISTINCT o_orderkey AS ix FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 3 <> 0)")
def voxel_masks(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("ix"), F.lit(0).alias("iy"), F.lit(0).alias("iz"))
    a, b = o.withColumn("value", F.col("ix") % 4), o.withColumn("value", F.col("ix") % 3)
    return V.with_sources(V.concatenate(V.mask_union([a], 0), V.mask_union([b])).distinct(), {"a": a})


@query("SELECT p.id, round(min(lx), 4) + 0.0 AS lx, round(max(hz), 4) + 0.0 AS hz FROM (SELECT c.id, c.x + (CASE WHEN i < 2 THEN -5 ELSE 7 END) * cos(radians(30)) - (CASE WHEN i % 2 = 0 THEN -2 ELSE 3 END) * sin(radians(30)) AS lx, c.z + 4 AS hz FROM cells c, range(4) r(i)) p GROUP BY ALL")
def cell_boxes(spark, d):
    c = cells(spark, d).select("id", "x", "y", "z", F.lit(0.0).alias("rx"), F.lit(0.0).alias("ry"), F.lit(30.0).alias("rz"), F.lit("m").alias("morph_name"))
    b = spark.createDataFrame([("m", -5.0, -2.0, -1.0, 7.0, 3.0, 4.0)], "morph_name string, lx double, ly double, lz double, hx double, hy double, hz double")
    out = V.rotated_boxes(c, b).select("id", "lx", "hz")
    return out.withColumns({k: F.round(k, 4) + 0.0 for k in ("lx", "hz")})


# Targeting.


@query("SELECT id FROM cells WHERE x * x + y * y + z * z < 10000")
def target_sphere(spark, d):
    return T.in_sphere(cells(spark, d), (0.0, 0.0, 0.0), 100.0).select("id")


@query("SELECT id FROM cells WHERE (x - 10) ** 2 + (z - 20) ** 2 < 4900")
def target_cylinder(spark, d):
    return T.in_cylinder(cells(spark, d), (10.0, 20.0), 70.0).select("id")


@query(f"SELECT cell_type, id FROM (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY {bits_sql(5, 'cell_type', 'id')}, id) AS r FROM cells) WHERE r <= 4")
def target_representatives(spark, d):
    return T.sample(cells(spark, d), count=4, seed=5).select("cell_type", "id")


@query(f"SELECT cell_type, id FROM (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY {bits_sql(6, 'cell_type', 'id')}, id) AS r, count(*) OVER (PARTITION BY cell_type) AS n FROM cells) WHERE r <= floor(n * 0.25::DOUBLE)")
def target_fraction(spark, d):
    return T.sample(cells(spark, d), fraction=0.25, seed=6).select("cell_type", "id")


@query("SELECT id FROM cells WHERE (cell_type = 'type_1' AND id IN (1, 2, 3, 11, 12, 13)) OR (cell_type = 'type_2' AND id IN (2, 22))")
def target_ids(spark, d):
    return T.by_id(cells(spark, d), {"type_1": [1, 2, 3, 11, 12, 13], "type_2": [2, 22]}).select("id")


@query("SELECT id FROM cells WHERE cell_type IN ('type_5', 'type_6') AND list_has_any(labels, ['even'])")
def target_labels(spark, d):
    return T.by_label(T.by_type(cells(spark, d), ["type_5", "type_6"]), ["even"]).select("id")


@query("SELECT morph_name, branch_id, max(point_id) AS point_id FROM arcs WHERE arc <= 0.5 GROUP BY ALL")
def target_branch_locations(spark, d):
    return T.branch_locations(M.arcs(points(spark, d)), 0.5, ["morph_name"]).select("morph_name", F.col("branch_id").cast("long").alias("branch_id"), F.col("point_id").cast("long").alias("point_id"))


@query("SELECT morph_name, point_id FROM pts WHERE label = 'soma'")
def target_somata(spark, d):
    return T.somata(points(spark, d)).select("morph_name", F.col("point_id").cast("long").alias("point_id"))


# Morphologies.


@query("SELECT morph_name, branch_id, point_id, round(path, 6) AS path, round(arc, 6) AS arc FROM arcs")
def morphology_arcs(spark, d):
    return rounded(M.arcs(points(spark, d)), "path", "arc").select("morph_name", F.col("branch_id").cast("long").alias("branch_id"), F.col("point_id").cast("long").alias("point_id"), "path", "arc")


@query(""", o AS (SELECT *, first(x) OVER w AS ox, first(y) OVER w AS oy, first(z) OVER w AS oz, last(x) OVER w AS ex, last(y) OVER w AS ey, last(z) OVER w AS ez
 FROM arcs WINDOW w AS (PARTITION BY morph_name, branch_id ORDER BY point_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
v AS (SELECT *, ex - ox AS vx, ey - oy AS vy, ez - oz AS vz, x - ox AS dx, y - oy AS dy, z - oz AS dz FROM o),
a AS (SELECT *, sqrt(dx ** 2 + dy ** 2 + dz ** 2) AS away, sqrt((vy * dz - vz * dy) ** 2 + (vz * dx - vx * dz) ** 2 + (vx * dy - vy * dx) ** 2) / sqrt(vx ** 2 + vy ** 2 + vz ** 2) AS beside FROM v)
SELECT morph_name, branch_id, count(*) AS n, round(max(path), 6) AS path_length, round(arg_max(away, point_id), 6) AS euclidean, round(max(beside), 6) AS max_displacement,
 round(any_value(vx), 6) + 0.0 AS vx, round(any_value(vz) / arg_max(away, point_id), 6) + 0.0 AS uz, round(regr_slope(ln(path), ln(away)) FILTER (away > 0), 5) AS fractal_dim FROM a GROUP BY ALL""")
def morphometry(spark, d):
    m = rounded(M.morphometry(points(spark, d)), "path_length", "euclidean", "max_displacement", "vx", "uz")
    return m.select("morph_name", F.col("branch_id").cast("long").alias("branch_id"), "n", "path_length", "euclidean", "max_displacement", "vx", "uz", F.round("fractal_dim", 5).alias("fractal_dim"))


@query("SELECT morph_name, branch_id, min(point_id) AS point_id FROM arcs WHERE arc >= 0.5 GROUP BY ALL")
def target_branch_locations_above(spark, d):
    return T.branch_locations(M.arcs(points(spark, d)), 0.5, ["morph_name"], above=True).select("morph_name", F.col("branch_id").cast("long").alias("branch_id"), F.col("point_id").cast("long").alias("point_id"))


@query("SELECT p.morph_name, p.branch_id, p.point_id, round(p.x - o.x + 1, 6) + 0.0 AS x, round(p.z - o.z + 3, 6) + 0.0 AS z FROM pts p JOIN pts o ON o.morph_name = p.morph_name AND o.branch_id = 0 AND o.point_id = 0")
def morphology_collapse(spark, d):
    p = rounded(M.collapse(points(spark, d), branches(spark, d), (1.0, 2.0, 3.0)), "x", "z")
    return p.select("morph_name", F.col("branch_id").cast("long").alias("branch_id"), F.col("point_id").cast("long").alias("point_id"), "x", "z")


@query("""SELECT p.morph_name, p.branch_id, p.point_id, round(CASE WHEN p.branch_id = 0 AND p.point_id < 2 THEN p.x ELSE o.x - (p.y - o.y) END, 6) + 0.0 AS x,
 round(CASE WHEN p.branch_id = 0 AND p.point_id < 2 THEN p.y ELSE o.y + (p.x - o.x) END, 6) + 0.0 AS y FROM pts p JOIN pts o ON o.morph_name = p.morph_name AND o.branch_id = 0 AND o.point_id = 2""")
def morphology_root_rotate(spark, d):
    """A quarter turn about z from the root's third point on."""
    p = rounded(M.root_rotate(points(spark, d), branches(spark, d), 0.0, 0.0, 90.0, 2), "x", "y")
    return p.select("morph_name", F.col("branch_id").cast("long").alias("branch_id"), F.col("point_id").cast("long").alias("point_id"), "x", "y")


@query("SELECT b.morph_name, b.branch_id, array_to_string(list_sort(list(c.branch_id) FILTER (c.branch_id IS NOT NULL)), ',') AS children FROM brs b LEFT JOIN brs c ON c.morph_name = b.morph_name AND c.parent_branch = b.branch_id GROUP BY ALL")
def branch_adjacency(spark, d):
    a = M.adjacency(branches(spark, d))
    return a.select("morph_name", F.col("branch_id").cast("long").alias("branch_id"), F.when(F.size("children") > 0, F.array_join(F.transform("children", lambda c: c.cast("string")), ",")).alias("children"))


@query("SELECT morph_name, branch_id FROM brs WHERE branch_id IN (2, 3)")
def terminal_branches(spark, d):
    return M.terminal(branches(spark, d)).select("morph_name", F.col("branch_id").cast("long").alias("branch_id"))


@query("SELECT DISTINCT morph_name, branch_id FROM pts WHERE label IN ('soma', 'axon')")
def labelled_branches(spark, d):
    return M.labelled_branches(points(spark, d), ["soma", "axon"]).select("morph_name", F.col("branch_id").cast("long").alias("branch_id"))


@query("SELECT morph_name, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM pts GROUP BY ALL")
def morphology_labels(spark, d):
    return M.list_labels(points(spark, d)).select("morph_name", F.array_join("labels", ",").alias("labels"))


@query("SELECT morph_name, min(x) AS lx, max(z) AS hz FROM pts GROUP BY ALL")
def morphology_bounds(spark, d):
    return M.bounds(points(spark, d)).select("morph_name", "lx", "hz")


@query("SELECT p.morph_name, round(p.x - o.x, 6) + 0.0 AS x FROM pts p JOIN pts o ON o.morph_name = p.morph_name AND o.branch_id = 0 AND o.point_id = 0")
def morphology_center(spark, d):
    return rounded(M.center(points(spark, d), branches(spark, d)), "x").select("morph_name", "x")


@query("SELECT morph_name, branch_id, point_id, round(z, 5) + 0.0 AS x, round(-y + 1, 5) + 0.0 AS y FROM pts")
def morphology_transforms(spark, d):
    p = M.swap_axes(M.translate(M.rotate(points(spark, d), 180.0, 0.0, 0.0), (0.0, 1.0, 0.0)), "x", "z")
    p = p.withColumns({"x": F.round(-F.col("x"), 5) + 0.0, "y": F.round("y", 5) + 0.0})
    return p.select("morph_name", F.col("branch_id").cast("long").alias("branch_id"), F.col("point_id").cast("long").alias("point_id"), "x", "y")


@query(""", ends AS (SELECT morph_name, branch_id, arg_min(x, point_id) AS sx, arg_max(x, point_id) AS ex FROM pts GROUP BY ALL),
gap AS (SELECT b.morph_name, b.branch_id, e.ex - s.sx AS g FROM brs b JOIN ends s ON s.morph_name = b.morph_name AND s.branch_id = b.branch_id JOIN ends e ON e.morph_name = b.morph_name AND e.branch_id = b.parent_branch),
up AS (SELECT branch_id, a FROM (VALUES (1, 1), (2, 2), (3, 3), (3, 1)) v(branch_id, a)),
mv AS (SELECT g.morph_name, u.branch_id, sum(g) AS g FROM up u JOIN gap g ON g.branch_id = u.a GROUP BY ALL)
SELECT p.morph_name, p.branch_id, p.point_id, round(p.x + coalesce(g, 0), 6) + 0.0 AS x FROM pts p LEFT JOIN mv USING (morph_name, branch_id)""")
def morphology_close_gaps(spark, d):
    p = rounded(M.close_gaps(points(spark, d), branches(spark, d)), "x")
    return p.select("morph_name", F.col("branch_id").cast("long").alias("branch_id"), F.col("point_id").cast("long").alias("point_id"), "x")


@query("""SELECT morph_name, branch_id, point_id, src_branch, src_point, parent_branch FROM (
  SELECT morph_name, CASE branch_id WHEN 0 THEN 0 WHEN 2 THEN 1 END AS branch_id, CASE WHEN branch_id = 0 THEN point_id - 2 ELSE point_id END AS point_id,
  branch_id AS src_branch, point_id AS src_point, CASE branch_id WHEN 2 THEN 0 END AS parent_branch FROM pts WHERE label = 'dendrites')""")
def morphology_filtered(spark, d):
    p, tree = M.filtered(points(spark, d), branches(spark, d), ["dendrites"])
    long = lambda *c: [F.col(x).cast("long").alias(x) for x in c]
    return p.join(tree, ["morph_name", "branch_id"]).select("morph_name", *long("branch_id", "point_id", "src_branch", "src_point", "parent_branch"))


@query("""SELECT morph_name, branch_id * 5 + point_id + 1 AS sample, CASE label WHEN 'soma' THEN 1 WHEN 'axon' THEN 2 ELSE 3 END AS tag,
  CASE WHEN point_id > 0 THEN branch_id * 5 + point_id WHEN branch_id = 0 THEN -1 WHEN branch_id = 3 THEN 10 ELSE 5 END AS parent FROM pts""")
def swc_rows(spark, d):
    s = M.to_swc(points(spark, d), branches(spark, d))
    return s.select("morph_name", F.col("sample").cast("long").alias("sample"), "tag", F.col("parent").cast("long").alias("parent"))


@query("SELECT morph_name, arg_min(branch_id * 5 + point_id, (x - 1) ** 2 + y ** 2 + z ** 2) AS nearest FROM pts GROUP BY ALL")
def closest_points(spark, d):
    return M.closest_point(points(spark, d), (1.0, 0.0, 0.0)).select("morph_name", (F.col("branch_id") * 5 + F.col("point_id")).cast("long").alias("nearest"))


@query("SELECT count(*) AS n, 0 AS moved FROM pts")
def swc_round_trip(spark, d):
    """Points written as SWC rows and parsed again are where they were; a branch's copied first points aside."""
    rows = M.to_swc(points(spark, d), branches(spark, d))
    back = M.parse_swc(rows).where("parent_branch is null or point_id > 0").select("morph_name", "x", "y", "z", F.lit(1).alias("back"))
    both = points(spark, d).select("morph_name", "x", "y", "z").join(back, ["morph_name", "x", "y", "z"], "left")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("back").isNull()).cast("int").alias("moved"))


_SWC = """, s0 AS (SELECT morph_name, branch_id AS b, point_id AS k, x, z, label, CASE branch_id WHEN 3 THEN 1 ELSE branch_id END AS br,
  CASE branch_id WHEN 0 THEN point_id WHEN 3 THEN 6 + point_id ELSE 1 + point_id END AS pt FROM pts),
w AS (SELECT morph_name, br, pt, x, z, label FROM s0 UNION ALL SELECT e.morph_name, n.br, 0, e.x, e.z, n.label FROM s0 e JOIN s0 n ON n.morph_name = e.morph_name AND n.b IN (1, 2) AND n.k = 0 WHERE e.b = 0 AND e.k = 4)
"""


@query(_SWC + "SELECT morph_name, br AS branch_id, pt AS point_id, x, z, label, CASE WHEN br > 0 THEN 0 END AS parent_branch FROM w")
def swc_tree(spark, d):
    """SWC rows parsed again: branches that follow each other without another are one, and children start with a copy of the branch point."""
    p = M.parse_swc(M.to_swc(points(spark, d), branches(spark, d)), labels_of_next=True)
    return p.select("morph_name", "branch_id", "point_id", "x", "z", F.col("labels")[0].alias("label"), "parent_branch")


@query(_SWC + """SELECT morph_name, CASE WHEN br = 0 THEN CASE WHEN pt < 2 THEN 0 ELSE 1 END ELSE br + 1 END AS branch_id, CASE WHEN br = 0 AND pt >= 2 THEN pt - 2 ELSE pt END AS point_id,
  x, z, label, CASE WHEN br > 0 THEN 1 WHEN pt >= 2 THEN 0 END AS parent_branch FROM w""")
def swc_boundaries(spark, d):
    """The same with a gap where the soma ends: the branch after it starts without a copy."""
    p = M.parse_swc(M.to_swc(points(spark, d), branches(spark, d)), ["soma"], labels_of_next=True)
    return p.select("morph_name", "branch_id", "point_id", "x", "z", F.col("labels")[0].alias("label"), "parent_branch")


def order_trees(spark: SparkSession, d: str) -> DataFrame:
    """A tree a customer: each order hangs on one of the customer's earlier ones, or is a root."""
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("morph_name"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("branch_id"))
    pick = F.pmod(keyed_bits(11, "morph_name", "branch_id"), F.col("branch_id") + 1).cast("int")
    return o.withColumn("parent_branch", F.when(pick < F.col("branch_id"), pick))


_TREES = f""", ot AS (SELECT o_custkey::VARCHAR AS morph_name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS branch_id FROM orders),
op AS (SELECT *, {bits_sql(11, 'morph_name', 'branch_id')} % (branch_id + 1) AS pick FROM ot),
tr AS (SELECT morph_name, branch_id, CASE WHEN pick < branch_id THEN pick END AS parent_branch FROM op),
up AS (SELECT morph_name, branch_id, [branch_id] AS path, parent_branch AS above FROM tr UNION ALL SELECT u.morph_name, u.branch_id, list_prepend(t.branch_id, path), t.parent_branch FROM up u JOIN tr t ON t.morph_name = u.morph_name AND t.branch_id = u.above),
pa AS (SELECT morph_name, branch_id, path FROM up WHERE above IS NULL)
"""


@query(_TREES + """SELECT p.morph_name, p.branch_id, row_number() OVER (PARTITION BY p.morph_name ORDER BY p.path) - 1 AS preorder, len(p.path) - 1 AS depth, q.n AS size
 FROM pa p JOIN (SELECT a.morph_name, a.branch_id, count(*) AS n FROM pa a JOIN pa b ON b.morph_name = a.morph_name AND b.path[1:len(a.path)] = a.path GROUP BY ALL) q USING (morph_name, branch_id)""")
def tree_preorder(spark, d):
    return tour(order_trees(spark, d)).select("morph_name", F.col("branch_id").cast("long").alias("branch_id"), "preorder", "depth", "size")


@query(_TREES + "SELECT DISTINCT b.morph_name, b.branch_id FROM pa a JOIN pa b ON b.morph_name = a.morph_name AND b.path[1:len(a.path)] = a.path WHERE (a.branch_id % 5) = 3")
def tree_subtrees(spark, d):
    """Every fourth of five branches, with all below it, each once."""
    t = order_trees(spark, d)
    return below(tour(t), t.where("branch_id % 5 = 3")).select("morph_name", F.col("branch_id").cast("long").alias("branch_id"))


@query("SELECT morph_name, branch_id, CASE branch_id WHEN 3 THEN 6 ELSE 5 END AS n FROM brs")
def morphology_simplify_all(spark, d):
    """With a tolerance of nothing every point of these jagged branches stays."""
    s = M.simplify(points(spark, d), 0.0).groupBy("morph_name", "branch_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return s.withColumn("branch_id", F.col("branch_id").cast("long"))


@query(""", sg AS (SELECT morph_name AS m, branch_id AS br, 0 AS a, max(point_id)::INTEGER AS b FROM pts GROUP BY ALL
  UNION ALL SELECT m, br, CASE half WHEN 0 THEN a ELSE k END, CASE half WHEN 0 THEN k ELSE b END FROM (
    SELECT g.m, g.br, g.a, g.b, arg_max(p.point_id, sqrt(((p.y - u.y) * (v.z - u.z) - (p.z - u.z) * (v.y - u.y)) ** 2 + ((p.z - u.z) * (v.x - u.x) - (p.x - u.x) * (v.z - u.z)) ** 2 + ((p.x - u.x) * (v.y - u.y) - (p.y - u.y) * (v.x - u.x)) ** 2)
      / sqrt((v.x - u.x) ** 2 + (v.y - u.y) ** 2 + (v.z - u.z) ** 2))::INTEGER AS k,
    max(sqrt(((p.y - u.y) * (v.z - u.z) - (p.z - u.z) * (v.y - u.y)) ** 2 + ((p.z - u.z) * (v.x - u.x) - (p.x - u.x) * (v.z - u.z)) ** 2 + ((p.x - u.x) * (v.y - u.y) - (p.y - u.y) * (v.x - u.x)) ** 2)
      / sqrt((v.x - u.x) ** 2 + (v.y - u.y) ** 2 + (v.z - u.z) ** 2)) AS far
    FROM sg g JOIN pts u ON u.morph_name = m AND u.branch_id = br AND u.point_id = a JOIN pts v ON v.morph_name = m AND v.branch_id = br AND v.point_id = b
    JOIN pts p ON p.morph_name = m AND p.branch_id = br AND p.point_id > a AND p.point_id < b GROUP BY ALL), (VALUES (0), (1)) h(half) WHERE far > 10)
SELECT morph_name, branch_id, count(*) AS n, sum(point_id)::BIGINT AS places FROM (SELECT m AS morph_name, br AS branch_id, a AS point_id FROM sg UNION SELECT m, br, b FROM sg) GROUP BY ALL""")
def morphology_simplify(spark, d):
    s = M.simplify(points(spark, d), 10.0)
    return s.groupBy("morph_name", F.col("branch_id").cast("long").alias("branch_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("point_id").cast("long").alias("places"))


@query("SELECT count(DISTINCT embedding) AS n FROM embeddings")
def unique_morphologies(spark, d):
    return M.content_hash(points(spark, d)).agg(F.count_distinct("hash", "n").alias("n"))


@query(f"SELECT morph_name, arg_min(branch_id * 5 + point_id, {bits_sql(0, 'morph_name', 'branch_id', 'point_id')}) AS picked FROM pts GROUP BY ALL")
def random_morphology_points(spark, d):
    return M.random_point(points(spark, d)).select("morph_name", (F.col("branch_id") * 5 + F.col("point_id")).cast("long").alias("picked"))


@query("SELECT e.pre_id, CASE WHEN e.pre_id % 2 = 0 THEN -1 ELSE 2 END AS pre_branch, CASE WHEN e.pre_id % 2 = 0 THEN -1 ELSE 3 END AS pre_point FROM (" + _NEAR + ") e")
def mapped_back(spark, d):
    """Every other edge ends on point 3 of a filtered morphology's branch 1, which was branch 2."""
    p, _ = M.filtered(points(spark, d), branches(spark, d), ["dendrites"])
    m = p.select(F.col("morph_name").cast("long").alias("id"), F.col("branch_id").alias("new_branch"), F.col("point_id").alias("new_point"), F.col("src_branch").alias("branch_id"), F.col("src_point").alias("point_id"))
    on = lambda v: F.when(F.col("pre_id") % 2 == 0, -1).otherwise(v)
    e = C.edges_of(neighbours(spark, d), F.col("pre_id"), F.col("post_id"), (on(1), on(3)))
    return C.map_back(e, m, "pre").select("pre_id", "pre_branch", "pre_point")


@query(""", nx AS (SELECT *, branch_id AS b, point_id AS k, lead(x) OVER (PARTITION BY morph_name, branch_id ORDER BY point_id) AS x1 FROM pts),
ins AS (SELECT morph_name, b, k, 0.0 AS part, x FROM nx UNION ALL SELECT morph_name, b, k, 0.25, x + 0.25::DOUBLE * (x1 - x) FROM nx WHERE b = 0 AND k = 1),
sec AS (SELECT morph_name, b, k, part, x, CASE WHEN b = 1 AND k > 2 THEN 1 ELSE 0 END AS s, 1 AS c FROM ins UNION ALL SELECT morph_name, b, k, part, x, 1, 0 FROM ins WHERE b = 1 AND k = 2)
SELECT morph_name, CASE b WHEN 0 THEN 0 WHEN 1 THEN 1 + s ELSE b + 1 END AS branch_id, row_number() OVER (PARTITION BY morph_name, b, s ORDER BY c, k, part) - 1 AS point_id, round(x, 6) + 0.0 AS x,
  CASE WHEN b = 0 THEN NULL WHEN b = 1 AND s = 0 THEN NULL WHEN b = 1 THEN 1 WHEN b = 2 THEN 2 ELSE 2 END AS parent_branch FROM sec""")
def branch_edits(spark, d):
    """On every tree: a point put into the root, the first child detached and split, the second child hung on that; a split at an end does nothing."""
    names = points(spark, d).select("morph_name").distinct()
    log = [("insert", 0, 1, None, 0.25), ("insert", 0, 4, None, 0.5), ("detach", 1, None, None, None), ("split", 1, 2, None, None), ("split", 2, 0, None, None), ("attach", 2, None, 1, None)]
    edits = names.withColumn("e", F.explode(F.array(*(F.struct(F.lit(o).alias("op"), F.lit(b).alias("branch_id"), F.lit(k).cast("int").alias("point_id"), F.lit(t).cast("int").alias("other"), F.lit(f).cast("double").alias("part")) for o, b, k, t, f in log)))).select("morph_name", "e.*")
    p, b = edited(points(spark, d), branches(spark, d), edits)
    return rounded(p.join(b, ["morph_name", "branch_id"]), "x").select("morph_name", "branch_id", F.col("point_id").cast("long").alias("point_id"), "x", "parent_branch")


# Trees of structures, and time.


@query("""SELECT 'r0' AS id, 0 AS depth UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation WHERE n_regionkey = 0
  UNION ALL SELECT 'c' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 0""")
def ontology_subtree(spark, d):
    r = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"))
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"))
    return O.subtree(r.union(n).union(c), "r0")


@query("SELECT n_nationkey AS id FROM nation WHERE lower(n_name) = lower((SELECT min(n_name) FROM nation))")
def structure_by_name(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.upper("n_name").alias("acronym"))
    wanted = n.agg(F.min("name")).first()[0]
    return O.find_structure(n, name=wanted.swapcase()).intersect(O.find_structure(n, acronym=wanted)).select("id")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    return windowed_counts(table(spark, d, "events"), "1 hour").withColumn("total", F.round("total", 4))
