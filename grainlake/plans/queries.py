"""Registered queries over the driver's tables, and the SQL that says what they return.

The grid has 24 by 16 by 8 voxels; a voxel's value is how many lines of ``lineitem`` fall into it, modulo 4.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainlake.functions import box, lattice, vectors
from grainlake.functions.box import AXES, BoxMeta
from grainlake.operators import clustering, grains, graphtables, matrix, optimum, segments, sparse, topology
from grainlake.sources import grids, vtk
from grainlake.sources.shared import materialise, new_path

BOX = BoxMeta((24, 16, 8), world=(1.0, -2.0, 0.5), spacing=(0.5, 0.25, 2.0))
INNER = BoxMeta((10, 8, 4), (4, 4, 2))
QUERIES, ORACLE_SQL = {}, {}


def _xyz() -> tuple:
    return tuple(F.col(a) for a in AXES)


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = (F.col("l_orderkey") % 24, F.col("l_partkey") % 16, F.col("l_suppkey") % 8)
    return grids.from_table(_table(spark, sf_dir, "lineitem"), BOX, *place, (F.count("*") % 4).cast("int"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grains.find_grains(materialise(_grid(spark, sf_dir), "grid"))


# SQL that the queries below share

V = """v AS (
  SELECT x + 24 * y + 384 * z AS vid, x, y, z, value FROM (
    SELECT (l_orderkey % 24)::INT AS x, (l_partkey % 16)::INT AS y, (l_suppkey % 8)::INT AS z, (count(*) % 4)::INT AS value
    FROM lineitem GROUP BY 1, 2, 3)),
near AS (
  SELECT a.vid AS vid, a.value AS value, k AS axis, b.vid AS vid2, b.value AS value2
  FROM v a CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) s
  JOIN v b ON b.x = a.x + (k = 0)::INT AND b.y = a.y + (k = 1)::INT AND b.z = a.z + (k = 2)::INT)"""
L = f"""{V},
joined AS (SELECT vid AS p, vid2 AS q FROM near WHERE value = value2 UNION ALL SELECT vid2, vid FROM near WHERE value = value2),
reach(vid, other) AS (SELECT vid, vid FROM v UNION SELECT r.vid, j.q FROM reach r JOIN joined j ON r.other = j.p),
labels AS (SELECT vid, min(other) AS label FROM reach GROUP BY vid),
grid AS (SELECT v.*, label FROM v JOIN labels USING (vid))"""
U = f"""{L},
units AS (
  SELECT b.x * 2 - (axis = 0)::INT AS hx, b.y * 2 - (axis = 1)::INT AS hy, b.z * 2 - (axis = 2)::INT AS hz, axis,
    greatest(la.label, lb.label) AS hi, least(la.label, lb.label) AS lo
  FROM near JOIN labels la ON la.vid = near.vid JOIN labels lb ON lb.vid = near.vid2 JOIN v b ON b.vid = near.vid2
  WHERE la.label <> lb.label),
unit_faces AS (SELECT *, hx + 47 * hy + 47 * 31 * hz AS key FROM units)"""
STEPS = "steps AS (SELECT k, s, (k = 0)::INT * s AS sx, (k = 1)::INT * s AS sy, (k = 2)::INT * s AS sz FROM (SELECT unnest([0, 1, 2]) AS k) CROSS JOIN (SELECT unnest([1, -1]) AS s))"
E_ = f"""{U}, {STEPS},
face_spots AS (SELECT f.*, hx + sx AS ex, hy + sy AS ey, hz + sz AS ez FROM unit_faces f JOIN steps ON k <> axis),
face_links AS (
  SELECT DISTINCT a.key AS p, b.key AS q FROM face_spots a JOIN face_spots b
  ON a.ex = b.ex AND a.ey = b.ey AND a.ez = b.ez AND a.hi = b.hi AND a.lo = b.lo AND a.key <> b.key),
face_reach(key, other) AS (SELECT key, key FROM unit_faces UNION SELECT r.key, l.q FROM face_reach r JOIN face_links l ON r.other = l.p),
face_parts AS (SELECT key, min(other) AS entity FROM face_reach GROUP BY key),
face_alter AS (
  SELECT hi, lo, entity, CASE WHEN n > 1 THEN n + 1 END AS alter FROM (
    SELECT hi, lo, entity, row_number() OVER (PARTITION BY hi, lo ORDER BY entity) AS n
    FROM (SELECT DISTINCT hi, lo, entity FROM unit_faces JOIN face_parts USING (key)))),
faces AS (SELECT f.*, p.entity, a.alter FROM unit_faces f JOIN face_parts p USING (key) JOIN face_alter a USING (entity))"""
G = f"""{E_},
edge_met AS (
  SELECT ex AS hx, ey AS hy, ez AS hz, list(s.entity) AS es
  FROM (SELECT s.*, f.entity FROM face_spots s JOIN faces f USING (key)) s GROUP BY ALL),
unit_edges AS (
  SELECT hx, hy, hz, CASE WHEN hx % 2 = 0 THEN 0 WHEN hy % 2 = 0 THEN 1 ELSE 2 END AS axis, len(es) > 3 AS multi,
    list_sort(list_distinct(es)) AS es, hx + 47 * hy + 47 * 31 * hz AS key
  FROM edge_met WHERE len(es) >= 3 AND len(list_distinct(es)) >= 3),
edge_spots AS (SELECT e.*, hx + sx AS cx, hy + sy AS cy, hz + sz AS cz FROM unit_edges e JOIN steps ON k = axis),
edge_links AS (
  SELECT DISTINCT a.key AS p, b.key AS q FROM edge_spots a JOIN edge_spots b
  ON a.cx = b.cx AND a.cy = b.cy AND a.cz = b.cz AND a.es = b.es AND a.multi = b.multi AND a.key <> b.key),
edge_reach(key, other) AS (SELECT key, key FROM unit_edges UNION SELECT r.key, l.q FROM edge_reach r JOIN edge_links l ON r.other = l.p),
edge_parts AS (SELECT key, min(other) AS entity FROM edge_reach GROUP BY key),
edge_alter AS (
  SELECT entity, CASE WHEN n > 1 THEN n + 331 END AS alter FROM (
    SELECT entity, row_number() OVER (PARTITION BY multi, es ORDER BY entity) AS n
    FROM (SELECT DISTINCT multi, es, entity FROM unit_edges JOIN edge_parts USING (key)))),
edges AS (SELECT e.*, p.entity, a.alter FROM unit_edges e JOIN edge_parts p USING (key) JOIN edge_alter a USING (entity)),
corner_grains AS (
  SELECT x + a AS x, y + b AS y, z + c AS z, list_sort(list_distinct(list(label))) AS gs
  FROM grid CROSS JOIN (SELECT unnest([0, 1]) AS a) CROSS JOIN (SELECT unnest([0, 1]) AS b) CROSS JOIN (SELECT unnest([0, 1]) AS c)
  GROUP BY ALL),
corner_edges AS (
  SELECT (cx + 1) // 2 AS x, (cy + 1) // 2 AS y, (cz + 1) // 2 AS z, list(entity) AS incident
  FROM edge_spots JOIN edge_parts USING (key) GROUP BY ALL),
found AS (
  SELECT x + 24 * y + 384 * z AS vid, x, y, z, gs, incident
  FROM corner_grains JOIN corner_edges USING (x, y, z)
  WHERE len(gs) > 3 AND len(incident) >= 3 AND len(list_distinct(incident)) >= 3 AND x < 24 AND y < 16 AND z < 8),
vertices AS (
  SELECT *, CASE WHEN n > 1 THEN n + 664 END AS alter
  FROM (SELECT *, row_number() OVER (PARTITION BY gs ORDER BY vid DESC) AS n FROM found))"""


# Addressing, filters and geometry


@query(f"WITH {V} SELECT vid::BIGINT AS vid, x, y, z, value FROM v")
def voxel_address(spark, sf_dir):
    return _grid(spark, sf_dir).select("vid", *AXES, "value")


@query("SELECT vid, (vid % 24)::INT AS x, ((vid // 24) % 16)::INT AS y, (vid // 384)::INT AS z FROM (SELECT unnest(range(3072)) AS vid)")
def voxel_roundtrip(spark, sf_dir):
    all_ = grids.positions(spark, BOX)
    return all_.where(BOX.vid(*_xyz()) == F.col("vid"))


@query(
    "SELECT p_partkey, CASE WHEN p_partkey < 320 THEN (4 + p_partkey % 10)::INT END AS x, CASE WHEN p_partkey < 320 THEN (4 + (p_partkey // 10) % 8)::INT END AS y,"
    " CASE WHEN p_partkey < 320 THEN (2 + p_partkey // 80)::INT END AS z FROM part"
)
def voxel_position_checked(spark, sf_dir):
    x, y, z = INNER.checked_position(F.col("p_partkey"))
    return _table(spark, sf_dir, "part").select("p_partkey", x.alias("x"), y.alias("y"), z.alias("z"))


@query(
    f"WITH {V} SELECT vid::BIGINT AS vid, 1.0 + 0.5 * (x - 0.5::DOUBLE) AS bx, -2.0 + 0.25 * (y - 0.5::DOUBLE) AS by, 0.5 + 2.0 * (z - 0.5::DOUBLE) AS bz,"
    " (1.0 + 0.5 * x)::DOUBLE AS cx, (-2.0 + 0.25 * y)::DOUBLE AS cy, (0.5 + 2.0 * z)::DOUBLE AS cz, (0.75 + 0.5 * x)::DOUBLE AS lx, 0.5 + 2.0 * (z - 0.5::DOUBLE) + CASE WHEN value = 2 THEN 2.0 ELSE 0.0 END::DOUBLE AS dz FROM v"
)
def voxel_world_pos(spark, sf_dir):
    b, c, d = BOX.base(*_xyz()), BOX.centre(*_xyz()), BOX.displaced(F.col("value"), *_xyz())
    named = [v.alias(f"{n}{a}") for n, t in (("b", b), ("c", c)) for v, a in zip(t, AXES)]
    return _grid(spark, sf_dir).select("vid", *named, BOX.linear(0, F.col("x")).alias("lx"), d[2].alias("dz"))


@query(f"WITH {V} SELECT value, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM v GROUP BY value")
def bounding_box(spark, sf_dir):
    found = grains.grain_boxes(_grid(spark, sf_dir).withColumn("label", F.col("value")))
    return found.withColumnRenamed("label", "value")


@query(
    f"WITH {V} SELECT vid::BIGINT AS vid, x BETWEEN 4 AND 13 AND y BETWEEN 4 AND 11 AND z BETWEEN 2 AND 5 AS inside,"
    " x IN (4, 13) OR y IN (4, 11) OR z IN (2, 5) AS on_border FROM v"
)
def in_box_filter(spark, sf_dir):
    return _grid(spark, sf_dir).select("vid", INNER.inside(*_xyz()).alias("inside"), INNER.on_border(*_xyz()).alias("on_border"))


@query(
    f"WITH {V}, p AS (SELECT p_partkey, (p_partkey % 30)::INT AS x, (p_partkey % 20 - 2)::INT AS y, (p_partkey % 9)::INT AS z FROM part)"
    " SELECT p_partkey, p.x, p.y, p.z, value FROM p LEFT JOIN v ON v.x = p.x AND v.y = p.y AND v.z = p.z"
)
def point_lookup(spark, sf_dir):
    key = F.col("p_partkey")
    points = _table(spark, sf_dir, "part").select("p_partkey", (key % 30).cast("int").alias("x"), (key % 20 - 2).cast("int").alias("y"), (key % 9).cast("int").alias("z"))
    return grains.lookup(_grid(spark, sf_dir), points, BOX)


@query(f"WITH {V} SELECT vid::BIGINT AS vid, value, axis, vid2::BIGINT AS vid2, value2 FROM near")
def neighbour_pairs(spark, sf_dir):
    return grains.neighbour_pairs(_grid(spark, sf_dir))


@query(
    f"WITH {V}, f AS (SELECT vid, k AS axis, x * 2 - (k = 0)::INT AS fx, y * 2 - (k = 1)::INT AS fy, z * 2 - (k = 2)::INT AS fz,"
    " x * 2 - (k <> 0)::INT AS ex, y * 2 - (k <> 1)::INT AS ey, z * 2 - (k <> 2)::INT AS ez, x AS vx, y AS vy, z AS vz FROM v CROSS JOIN (SELECT unnest([0, 1, 2]) AS k))"
    " SELECT vid::BIGINT AS vid, axis, fx, fy, fz, ex, ey, ez, axis AS face_axis, axis AS edge_axis, vx, vy, vz FROM f"
)
def lattice_places(spark, sf_dir):
    rows = _grid(spark, sf_dir).select("vid", *AXES, F.explode(F.array(*map(F.lit, range(3)))).alias("axis"))
    f, e = lattice.face_place(F.col("axis"), *_xyz()), lattice.edge_place(F.col("axis"), *_xyz())
    back = lattice.voxel_of(*f)
    named = [v.cast("int").alias(f"{n}{a}") for n, t in (("f", f), ("e", e), ("v", back)) for v, a in zip(t, AXES)]
    return rows.select("vid", "axis", *named, lattice.face_axis(*f).alias("face_axis"), lattice.edge_axis(*e).alias("edge_axis"))


@query(
    f"WITH {V}, c AS (SELECT vid, k AS axis, x, y, z, x + 25 * y + 425 * z AS o FROM v CROSS JOIN (SELECT unnest([0, 1, 2]) AS k))"
    " SELECT vid::BIGINT AS vid, axis, CASE axis WHEN 0 THEN [o, o + 25, o + 450, o + 425] WHEN 1 THEN [o, o + 1, o + 426, o + 425] ELSE [o, o + 1, o + 26, o + 25] END::BIGINT[] AS corners,"
    " [o, o + CASE axis WHEN 0 THEN 1 WHEN 1 THEN 25 ELSE 425 END]::BIGINT[] AS ends, o::BIGINT AS point FROM c"
)
def vtk_corner_ids(spark, sf_dir):
    rows = _grid(spark, sf_dir).select("vid", *AXES, F.explode(F.array(*map(F.lit, range(3)))).alias("axis"))
    k = F.col("axis")
    return rows.select("vid", "axis", lattice.cell_corners(BOX, k, *_xyz()).alias("corners"), lattice.cell_ends(BOX, k, *_xyz()).alias("ends"), BOX.extended().vid(*_xyz()).alias("point"))


@query(
    f"WITH {V}, c AS (SELECT vid, k AS axis, 1.0 + 0.5 * (x - 0.5::DOUBLE) AS b0, -2.0 + 0.25 * (y - 0.5::DOUBLE) AS b1, 0.5 + 2.0 * (z - 0.5::DOUBLE) AS b2 FROM v CROSS JOIN (SELECT unnest([0, 1, 2]) AS k))"
    " SELECT vid::BIGINT AS vid, axis, b0 + CASE axis WHEN 0 THEN 0 ELSE 0.25::DOUBLE END AS px, b1 + CASE axis WHEN 1 THEN 0 ELSE 0.125::DOUBLE END AS py, b2 + CASE axis WHEN 2 THEN 0 ELSE 1::DOUBLE END AS pz,"
    " (axis = 0)::INT::DOUBLE AS nx, (axis = 1)::INT::DOUBLE AS ny, (axis = 2)::INT::DOUBLE AS nz,"
    " CASE WHEN axis = 0 THEN b0 END AS meets_x FROM c"
)
def face_planes(spark, sf_dir):
    rows = _grid(spark, sf_dir).select("vid", *AXES, F.explode(F.array(*map(F.lit, range(3)))).alias("axis"))
    p, n = lattice.face_plane(BOX, F.col("axis"), *_xyz())
    zero, one = F.lit(0.0), F.lit(1.0)
    met = lattice.intersection(p, n, (zero, zero, zero), (one, zero, zero))
    return rows.select("vid", "axis", *(v.alias(f"{m}{a}") for m, t in (("p", p), ("n", n)) for v, a in zip(t, AXES)), met[0].alias("meets_x"))


@query(f"WITH {V}, a AS (SELECT unnest(range(3072)) AS vid) SELECT a.vid, (a.vid % 24)::INT AS x, ((a.vid // 24) % 16)::INT AS y, (a.vid // 384)::INT AS z, value FROM a LEFT JOIN v ON v.vid = a.vid AND value <> 3")
def dense_grid(spark, sf_dir):
    return grids.complete(spark, _grid(spark, sf_dir).where("value <> 3"), BOX)


# Grains


@query(f"WITH RECURSIVE {L} SELECT vid::BIGINT AS vid, value, label::BIGINT AS label FROM grid")
def grain_labels(spark, sf_dir):
    return _labels(spark, sf_dir).select("vid", "value", "label")


@query(
    f"WITH RECURSIVE {V}, joined AS (SELECT vid AS p, vid2 AS q FROM near WHERE abs(value - value2) = 2 UNION ALL SELECT vid2, vid FROM near WHERE abs(value - value2) = 2),"
    " reach(vid, other) AS (SELECT vid, vid FROM v UNION SELECT r.vid, j.q FROM reach r JOIN joined j ON r.other = j.p)"
    " SELECT vid::BIGINT AS vid, min(other)::BIGINT AS label FROM reach GROUP BY vid"
)
def grain_labels_by_predicate(spark, sf_dir):
    return grains.find_grains(_grid(spark, sf_dir), lambda a, b: F.abs(a - b) == 2).select("vid", "label")


@query(f"WITH RECURSIVE {L} SELECT label::BIGINT AS label, count(*) AS n FROM grid GROUP BY label")
def grain_sizes(spark, sf_dir):
    return grains.grain_sizes(_labels(spark, sf_dir))


@query(f"WITH RECURSIVE {L} SELECT label::BIGINT AS label, list_sort(list(vid::BIGINT)) AS voxels FROM grid GROUP BY label")
def grain_members(spark, sf_dir):
    return grains.grain_members(_labels(spark, sf_dir))


@query(f"WITH RECURSIVE {L} SELECT label::BIGINT AS label, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM grid GROUP BY label")
def grain_bbox(spark, sf_dir):
    return grains.grain_boxes(_labels(spark, sf_dir))


@query(f"WITH RECURSIVE {L}, s AS (SELECT label, count(*) AS n FROM grid GROUP BY label) SELECT count(*) AS grains, 0::BIGINT AS low, (count(*) - 1)::BIGINT AS high, sum(n)::BIGINT AS voxels FROM s")
def grain_reset_count(spark, sf_dir):
    new = grains.reset_grain_ids(_labels(spark, sf_dir), seed=7)
    return new.agg(F.countDistinct("label").alias("grains"), F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("voxels"))


# Topology


def _built(spark, sf_dir) -> topology.Topology:
    return topology.build(_labels(spark, sf_dir), BOX)


def _units(spark, sf_dir) -> DataFrame:
    return topology.unit_faces(materialise(_labels(spark, sf_dir), "labels"), BOX)


@query(f"WITH RECURSIVE {U} SELECT key::BIGINT AS key, axis, hx, hy, hz, hi::BIGINT AS hi, lo::BIGINT AS lo FROM unit_faces")
def unit_faces(spark, sf_dir):
    return _units(spark, sf_dir)


@query(f"WITH RECURSIVE {U} SELECT hi::BIGINT AS hi, lo::BIGINT AS lo, count(*) AS area FROM unit_faces GROUP BY hi, lo")
def face_adjacency_area(spark, sf_dir):
    return _units(spark, sf_dir).groupBy("hi", "lo").agg(F.count("*").alias("area"))


@query(f"WITH RECURSIVE {E_} SELECT hi::BIGINT AS hi, lo::BIGINT AS lo, alter::INT AS alter, entity::BIGINT AS entity, count(*) AS area FROM faces GROUP BY ALL")
def face_entities(spark, sf_dir):
    found = topology.face_entities(materialise(_units(spark, sf_dir), "units"))
    return found.groupBy("hi", "lo", "alter", "entity").agg(F.count("*").alias("area"))


@query(f"WITH RECURSIVE {E_}, d AS (SELECT hi AS g, entity FROM faces UNION SELECT lo, entity FROM faces) SELECT label::BIGINT AS grain_id, count(entity) AS faces FROM (SELECT DISTINCT label FROM labels) LEFT JOIN d ON g = label GROUP BY label")
def grain_face_degree(spark, sf_dir):
    return _built(spark, sf_dir).nested()[0].select("grain_id", F.size("faces").cast("long").alias("faces"))


@query(f"WITH RECURSIVE {G} SELECT key::BIGINT AS key, axis, hx, hy, hz, multi, len(es) AS n_faces FROM unit_edges")
def unit_edges(spark, sf_dir):
    units = _built(spark, sf_dir).unit_edges
    return units.select("key", "axis", *topology.H, "multi", F.size("faces").cast("long").alias("n_faces"))


@query(f"WITH RECURSIVE {G} SELECT entity::BIGINT AS entity, multi, alter::INT AS alter, count(*) AS length FROM edges GROUP BY ALL")
def edge_entities(spark, sf_dir):
    return _built(spark, sf_dir).unit_edges.groupBy("entity", "multi", "alter").agg(F.count("*").alias("length"))


@query(f"WITH RECURSIVE {G} SELECT vid::BIGINT AS vid, x, y, z, list_reverse_sort(gs)::BIGINT[] AS grains, alter::INT AS alter, len(incident) AS incident FROM vertices")
def vertices(spark, sf_dir):
    found = _built(spark, sf_dir).vertices
    return found.select("vid", *AXES, "vertex.grains", "vertex.alter", F.size("incident").cast("long").alias("incident"))


@query(
    f"WITH RECURSIVE {G}, m AS (SELECT unnest(incident) AS entity FROM vertices), c AS (SELECT e.entity, count(m.entity) AS n FROM (SELECT DISTINCT entity FROM edges) e LEFT JOIN m ON m.entity = e.entity GROUP BY e.entity)"
    " SELECT CASE n WHEN 0 THEN 'dummy' WHEN 1 THEN 'half' WHEN 2 THEN 'full' ELSE 'bad' END AS state, n AS vertices, count(*) AS edges FROM c GROUP BY ALL"
)
def edge_states(spark, sf_dir):
    return _built(spark, sf_dir).edges.groupBy("state", F.col("n_vertices").alias("vertices")).agg(F.count("*").alias("edges"))


@query(
    f"WITH RECURSIVE {G}, ended AS (SELECT DISTINCT s.key, s.entity FROM (SELECT s.*, p.entity FROM edge_spots s JOIN edge_parts p USING (key)) s JOIN vertices v ON s.cx = 2 * v.x - 1 AND s.cy = 2 * v.y - 1 AND s.cz = 2 * v.z - 1),"
    " links AS (SELECT DISTINCT f.entity AS face, d.entity AS edge FROM ended d JOIN unit_edges u USING (key) JOIN face_spots s ON s.ex = u.hx AND s.ey = u.hy AND s.ez = u.hz JOIN faces f ON f.key = s.key)"
    " SELECT hi::BIGINT AS hi, lo::BIGINT AS lo, alter::INT AS alter, count(l.edge) AS edges FROM (SELECT DISTINCT entity, hi, lo, alter FROM faces) f LEFT JOIN links l ON l.face = f.entity GROUP BY hi, lo, alter"
)
def face_edge_links(spark, sf_dir):
    return _built(spark, sf_dir).nested()[1].select("face.hi", "face.lo", "face.alter", F.size("edges").cast("long").alias("edges"))


@query(
    f"WITH RECURSIVE {U}, conn AS (SELECT hi AS id, lo AS other FROM unit_faces UNION SELECT lo, hi FROM unit_faces)"
    " SELECT id::BIGINT AS id, CASE WHEN id % 2 = 0 THEN 'p' || id END AS prop, list_sort(list(other::BIGINT)) AS conn FROM conn GROUP BY id"
)
def graph_upserts(spark, sf_dir):
    units = materialise(_units(spark, sf_dir), "units")
    ends = F.array(F.struct(F.col("hi").alias("id"), F.col("lo").alias("other")), F.struct(F.col("lo").alias("id"), F.col("hi").alias("other")))
    links = units.select(F.inline(ends)).distinct()
    level = graphtables.connect(graphtables.empty_level(spark), links)
    return graphtables.upsert(level, level.where("id % 2 = 0").select("id", F.concat(F.lit("p"), "id").alias("prop")))


# Sparse boxes


@query(f"WITH {V} SELECT l_orderkey, l_linenumber, x, y, z, value FROM (SELECT l_orderkey, l_linenumber, (l_orderkey % 24)::INT AS x, (l_linenumber % 16)::INT AS y, (l_suppkey % 8)::INT AS z FROM lineitem) p LEFT JOIN (SELECT * FROM v WHERE value > 0) v USING (x, y, z)")
def sparse_lookup(spark, sf_dir):
    points = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 24).cast("int").alias("x"), (F.col("l_linenumber") % 16).alias("y"), (F.col("l_suppkey") % 8).cast("int").alias("z"))
    return sparse.lookup(sparse.make(_grid(spark, sf_dir).where("value > 0"), BOX), points)


@query(
    f"WITH {V}, u AS (SELECT (o_orderkey % 24)::INT AS x, (o_custkey % 16)::INT AS y, (o_orderkey % 7)::INT AS z, max_by((o_custkey % 100)::INT, o_orderkey) AS new FROM orders GROUP BY 1, 2, 3)"
    " SELECT x, y, z, coalesce(new, value) AS value FROM v LEFT JOIN u USING (x, y, z) WHERE v.value > 0"
)
def sparse_adjust(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    updates = _table(spark, sf_dir, "orders").select(o.alias("seq"), (o % 24).cast("int").alias("x"), (c % 16).cast("int").alias("y"), (o % 7).cast("int").alias("z"), (c % 100).cast("int").alias("value"))
    return sparse.adjust(sparse.make(_grid(spark, sf_dir).where("value > 0"), BOX), updates)


@query(f"WITH {V} SELECT x, y, z, value FROM v WHERE value <> 1")
def sparse_merge(spark, sf_dir):
    cells = materialise(_grid(spark, sf_dir).where("value <> 1"), "cells")
    first, second = BOX.split()
    return sparse.merge(sparse.make(cells, first), first, sparse.make(cells, second), second)[0]


# Matrices and vectors

M = "m AS (SELECT (l_partkey % 40)::INT AS i, (l_suppkey % 30)::INT AS j, sum(l_linenumber)::DOUBLE AS val FROM lineitem GROUP BY 1, 2), w AS (SELECT (l_suppkey % 30)::INT AS i, (l_orderkey % 25)::INT AS j, sum(l_linenumber)::DOUBLE AS val FROM lineitem GROUP BY 1, 2)"


def _matrix(spark, sf_dir, i: str, n: int, j: str, m: int) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select((F.col(i) % n).cast("int").alias("i"), (F.col(j) % m).cast("int").alias("j"), "l_linenumber")
    return rows.groupBy("i", "j").agg(F.sum("l_linenumber").cast("double").alias("val"))


@query(f"WITH {M} SELECT i, j, sum(val) AS val FROM (SELECT * FROM m UNION ALL SELECT j, i, -2 * val FROM m) GROUP BY i, j")
def matrix_add(spark, sf_dir):
    m = _matrix(spark, sf_dir, "l_partkey", 40, "l_suppkey", 30)
    return matrix.combine(m, matrix.scale(matrix.transpose(m), 2), -1)


@query(f"WITH {M} SELECT m.i, w.j, sum(m.val * w.val) AS val FROM m JOIN w ON m.j = w.i GROUP BY m.i, w.j")
def matrix_mul(spark, sf_dir):
    return matrix.multiply(_matrix(spark, sf_dir, "l_partkey", 40, "l_suppkey", 30), _matrix(spark, sf_dir, "l_suppkey", 30, "l_orderkey", 25), ((40, 30), (30, 25)))


@query(f"WITH {M} SELECT j AS i, i AS j, val FROM m")
def matrix_transpose(spark, sf_dir):
    return matrix.transpose(_matrix(spark, sf_dir, "l_partkey", 40, "l_suppkey", 30))


@query(f"WITH {M} SELECT 'right' AS side, i, sum(val * (j + 1)) AS val FROM m GROUP BY i UNION ALL SELECT 'left', j, sum(val * (i + 1)) FROM m GROUP BY j")
def matrix_vec(spark, sf_dir):
    m = _matrix(spark, sf_dir, "l_partkey", 40, "l_suppkey", 30)
    v = spark.range(40).select(F.col("id").cast("int").alias("i"), (F.col("id") + 1.0).alias("val"))
    right, left = matrix.times_vector(m, v), matrix.vector_times(v, m)
    return right.select(F.lit("right").alias("side"), "i", "val").unionByName(left.select(F.lit("left").alias("side"), "i", "val"))


@query(f"WITH {M} SELECT i, j, val FROM m WHERE i = j")
def matrix_diag(spark, sf_dir):
    return matrix.from_diagonal(matrix.diagonal(_matrix(spark, sf_dir, "l_partkey", 40, "l_suppkey", 30)))


@query(f"WITH {M} SELECT j, list(val ORDER BY i) AS vals FROM m GROUP BY j")
def matrix_columns(spark, sf_dir):
    return matrix.columns(_matrix(spark, sf_dir, "l_partkey", 40, "l_suppkey", 30))


@query("SELECT (k % 12)::INT AS i, (k // 12)::INT AS j, (CASE WHEN k % 12 = k // 12 THEN 3 ELSE 0 END)::DOUBLE AS val FROM (SELECT unnest(range(144)) AS k)")
def matrix_identity(spark, sf_dir):
    return matrix.scale(matrix.identity(spark, 12), 3.0)


@query(
    "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: round(x * 100)::DOUBLE) AS v FROM embeddings)"
    " SELECT vec_id, list_dot_product(v, list_reverse(v)) AS dot, list_sum(list_transform(v, lambda x: 3 * x + 1)) AS scaled FROM e"
)
def vector_ops(spark, sf_dir):
    # As in SQL, the product is a 32-bit number, too: what is half there may lie beside it in 64 bits.
    v = _table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x * F.lit(100).cast("float")).cast("double")).alias("v"))
    ones = F.transform("v", lambda x: F.lit(1.0))
    moved = vectors.add(vectors.scale(F.col("v"), 3.0), ones)
    # A sum of nothing is null, a product of nothing 0.
    return v.select("vec_id", vectors.dot(F.col("v"), F.reverse("v")).alias("dot"), F.when(F.size("v") > 0, vectors.dot(moved, ones)).alias("scaled"))


@query("SELECT o_orderkey, least(len(list_filter(a, lambda v: v < o_custkey)), len(a) - 1)::INT AS found FROM (SELECT o_orderkey, o_custkey, list_transform(range(0, (o_orderkey % 50 + 1)::BIGINT), lambda k: k * 37) AS a FROM orders)")
def binary_search(spark, sf_dir):
    values = F.transform(F.sequence(F.lit(0), (F.col("o_orderkey") % 50).cast("long")), lambda k: k * 37)
    return _table(spark, sf_dir, "orders").select("o_orderkey", vectors.binary_search(values, F.col("o_custkey")).alias("found"))


# Segments, clusters, optima

S = """s AS (SELECT o_orderkey AS idx, o_orderkey AS head, CASE WHEN o_orderkey % 9 = 8 THEN o_orderkey - 8 ELSE o_orderkey + 1 END AS tail
  FROM orders WHERE o_orderkey % 9 <> 8 OR (o_orderkey // 9) % 2 = 0)"""


@query(f"WITH {S}, c AS (SELECT idx // 9 AS g, count(*) AS n, min(idx) AS seq FROM s GROUP BY 1), full_ AS (SELECT * FROM c WHERE n = 8 + ((g % 2) = 0)::INT) SELECT seq, CASE WHEN n = 9 THEN 'loop' ELSE 'open' END AS kind, n AS segments FROM full_")
def segments_kind(spark, sf_dir):
    k = F.col("o_orderkey")
    made = _table(spark, sf_dir, "orders").where((k % 9 != 8) | (F.floor(k / 9) % 2 == 0)).select(k.alias("idx"), k.alias("head"), F.when(k % 9 == 8, k - 8).otherwise(k + 1).alias("tail"))
    whole = made.join(made.groupBy(F.floor(F.col("idx") / 9).alias("g")).agg(F.count("*").alias("n")).where(F.col("n") == 8 + (F.col("g") % 2 == 0).cast("int")), F.floor(F.col("idx") / 9) == F.col("g")).drop("g", "n")
    return segments.sort_segments(whole).groupBy("seq", "kind").agg(F.count("*").alias("segments"))


@query(
    "WITH m AS (SELECT l_linenumber::DOUBLE AS x, l_quantity AS y FROM lineitem) SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS constant FROM m"
)
def bfgs_least_squares(spark, sf_dir):
    slope, constant = optimum.least_squares(_table(spark, sf_dir, "lineitem"), ["l_linenumber"], "l_quantity")
    return spark.createDataFrame([(float(slope), float(constant))], "slope double, constant double").select(F.round("slope", 6).alias("slope"), F.round("constant", 6).alias("constant"))


@query(
    "WITH e AS (SELECT DISTINCT s_suppkey AS src, (s_suppkey * 7 + 3) % 50 AS dst FROM supplier),"
    " b AS (SELECT src AS i, dst AS j FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst),"
    " g AS (SELECT i, j, 1.0::DOUBLE AS val FROM b UNION ALL SELECT DISTINCT i, i, 1.0::DOUBLE FROM b),"
    " n AS (SELECT i, j, val / sum(val) OVER (PARTITION BY j) AS val FROM g),"
    " x AS (SELECT a.i, b.j, pow(sum(a.val * b.val), 2) AS val FROM n a JOIN n b ON a.j = b.i GROUP BY a.i, b.j),"
    " p AS (SELECT i, j, val FROM (SELECT i, j, val / sum(val) OVER (PARTITION BY j) AS val FROM x) WHERE val > 1e-5),"
    " o AS (SELECT i, j, val / sum(val) OVER (PARTITION BY j) AS val FROM p) SELECT i::BIGINT AS i, j::BIGINT AS j, round(val, 9) AS val FROM o"
)
def mcl_one_round(spark, sf_dir):
    k = F.col("s_suppkey")
    edges = _table(spark, sf_dir, "supplier").select(k.alias("src"), ((k * 7 + 3) % 50).alias("dst"))
    return clustering.step(clustering.normalise(clustering.from_edges(edges))).withColumn("val", F.round("val", 9))


@query(
    "WITH e AS (SELECT DISTINCT s_suppkey AS src, s_suppkey // 5 * 5 AS dst FROM supplier WHERE s_suppkey % 5 <> 0)"
    " SELECT id::BIGINT AS id, (id // 5 * 5)::BIGINT AS cluster FROM (SELECT src AS id FROM e UNION SELECT dst FROM e)"
)
def mcl_clusters(spark, sf_dir):
    k = F.col("s_suppkey")
    edges = _table(spark, sf_dir, "supplier").select(k.alias("src"), (F.floor(k / 5) * 5).cast("long").alias("dst"))
    return clustering.markov_cluster(edges)


@query("SELECT 0.2::DOUBLE AS downhill, 1.0::DOUBLE AS uphill")
def line_search_steps(spark, sf_dir):
    bowl = lambda v: (float(v @ v), 2 * v)
    at = np.array([1.0, 0.0])
    down, up = (optimum.line_search(bowl, at, np.array(d)) for d in ([-4.0, -2.0], [1.0, 0.0]))
    return spark.createDataFrame([(round(down, 9), up)], "downhill double, uphill double")


def _numbered_segments(spark, sf_dir) -> DataFrame:
    """Segments k to k+1 in nines, every third one turned; in even nines a ninth one closes the loop."""
    k = F.col("o_orderkey")
    kept = _table(spark, sf_dir, "orders").where((k % 9 != 8) | (F.floor(k / 9) % 2 == 0))
    ends = (k, F.when(k % 9 == 8, k - 8).otherwise(k + 1))
    turned = k % 3 == 1
    made = kept.select(k.alias("idx"), F.when(turned, ends[1]).otherwise(ends[0]).alias("head"), F.when(turned, ends[0]).otherwise(ends[1]).alias("tail"))
    full = made.groupBy(F.floor(F.col("idx") / 9).alias("g")).agg(F.count("*").alias("n")).where(F.col("n") == 8 + (F.col("g") % 2 == 0).cast("int"))
    return made.join(full, F.floor(F.col("idx") / 9) == F.col("g")).drop("g", "n")


ORDERED = f"""WITH {S}, c AS (SELECT idx // 9 AS g, count(*) AS n FROM s GROUP BY 1), o AS (
  SELECT (g * 9)::BIGINT AS seq, CASE WHEN n = 9 THEN 'loop' ELSE 'open' END AS kind, (idx - g * 9)::INT AS pos, idx, head, tail
  FROM s JOIN c ON idx // 9 = g WHERE n = 8 + ((g % 2) = 0)::INT)"""


@query(f"{ORDERED} SELECT * FROM o")
def segments_order(spark, sf_dir):
    return segments.sort_segments(_numbered_segments(spark, sf_dir))


@query(f"{ORDERED} SELECT seq, idx FROM o WHERE kind = 'open'")
def segments_open(spark, sf_dir):
    return segments.opens(segments.sort_segments(_numbered_segments(spark, sf_dir))).select("seq", "idx")


@query(f"{ORDERED} SELECT seq, idx FROM o WHERE kind = 'loop'")
def segments_loops(spark, sf_dir):
    return segments.loops(segments.sort_segments(_numbered_segments(spark, sf_dir))).select("seq", "idx")


@query(f"{ORDERED} SELECT * FROM o")
def segments_tolerance(spark, sf_dir):
    # The ends of turned segments lie a little below the others'.
    moved = lambda c: F.col(c) - F.when(F.col("idx") % 3 == 1, 0.009).otherwise(0.0)
    made = _numbered_segments(spark, sf_dir).select("idx", moved("head").alias("head"), moved("tail").alias("tail"))
    return segments.sort_segments(made, tolerance=0.01).withColumns({c: F.round(c).cast("long") for c in ("head", "tail")})


# Export


FACE_CELL_SQL = "CASE axis WHEN 0 THEN [o, o + 25, o + 450, o + 425] WHEN 1 THEN [o, o + 1, o + 426, o + 425] ELSE [o, o + 1, o + 26, o + 25] END::BIGINT[]"
PLACE_SQL = "(hx + 1) // 2 + 25 * ((hy + 1) // 2) + 425 * ((hz + 1) // 2) AS o"


@query(f"WITH RECURSIVE {E_}, c AS (SELECT *, {PLACE_SQL}, dense_rank() OVER (ORDER BY hi, lo, alter NULLS FIRST) AS color FROM faces) SELECT color, key::BIGINT AS key, {FACE_CELL_SQL} AS corners FROM c")
def vtk_face_cells(spark, sf_dir):
    return vtk.cells(vtk.element_rows(_built(spark, sf_dir).unit_faces, "face"), BOX, "face")


@query(
    f"WITH RECURSIVE {G}, c AS (SELECT *, {PLACE_SQL}, row_number() OVER (ORDER BY key) - 1 AS color FROM unit_edges)"
    " SELECT color, key::BIGINT AS key, [o, o + CASE axis WHEN 0 THEN 1 WHEN 1 THEN 25 ELSE 425 END]::BIGINT[] AS corners FROM c"
)
def vtk_edge_list(spark, sf_dir):
    return vtk.cells(vtk.element_list_rows(_built(spark, sf_dir).unit_edges), BOX, "edge")


@query(f"WITH RECURSIVE {L} SELECT dense_rank() OVER (ORDER BY label) AS color, vid::BIGINT AS key, [x + 25 * y + 425 * z]::BIGINT[] AS corners FROM grid")
def vtk_grain_points(spark, sf_dir):
    return vtk.cells(vtk.grain_rows(_labels(spark, sf_dir)), BOX, "voxel")


@query(f"WITH RECURSIVE {G} SELECT row_number() OVER (ORDER BY vid) - 1 AS color, vid::BIGINT AS key, [x + 25 * y + 425 * z]::BIGINT[] AS corners FROM vertices")
def vtk_vertex_points(spark, sf_dir):
    return vtk.cells(vtk.vertex_rows(_built(spark, sf_dir).vertices), BOX, "voxel")


@query(
    "WITH a AS (SELECT unnest(range(25 * 17 * 9)) AS vid) SELECT vid, 1.0 + 0.5 * (vid % 25 - 0.5::DOUBLE) AS px, -2.0 + 0.25 * ((vid // 25) % 17 - 0.5::DOUBLE) AS py,"
    " 0.5 + 2.0 * (vid // 425 - 0.5::DOUBLE) AS pz FROM a"
)
def vtk_corner_points(spark, sf_dir):
    return vtk.corner_points(spark, BOX)


@query(f"WITH {V} SELECT vid::BIGINT AS vid, x, y, z, value FROM v")
def codec_round_trip(spark, sf_dir):
    path = new_path(spark, "codec")
    grids.write_tables(path, grid=_grid(spark, sf_dir))
    return grids.read_tables(spark, path, "grid")["grid"]


# Positions, boxes and ids


@query(
    f"WITH {V}, d AS (SELECT * FROM (VALUES (0, 'XYplus', 1, 1, 0), (1, 'XYminus', 1, -1, 0), (2, 'XZplus', 1, 0, 1), (3, 'XZminus', 1, 0, -1), (4, 'YXplus', 1, 1, 0), (5, 'YXminus', -1, 1, 0),"
    " (6, 'YZplus', 0, 1, 1), (7, 'YZminus', 0, 1, -1), (8, 'ZXplus', 1, 0, 1), (9, 'ZXminus', -1, 0, 1), (10, 'ZYplus', 0, 1, 1), (11, 'ZYminus', 0, -1, 1)) t(code, name, dx, dy, dz))"
    " SELECT vid::BIGINT AS vid, code::INT AS code, name, (x + dx)::INT AS x, (y + dy)::INT AS y, (z + dz)::INT AS z FROM v CROSS JOIN d"
)
def crossing_positions(spark, sf_dir):
    steps = F.concat(*(lattice.crossings(axis, *_xyz()) for axis in range(3)))
    return _grid(spark, sf_dir).select("vid", F.inline(steps)).withColumn("name", lattice.crossing_name(F.col("code"))).where(lattice.crossing_code(F.col("name")) == F.col("code"))


@query(
    f"WITH {V}, t AS (SELECT vid, x, y, z, x - 7 AS p, y - 5 AS q, z - 3 AS r FROM v) SELECT vid::BIGINT AS vid, x + p AS ax, y - q AS sy, z * 3 AS mz,"
    " CASE WHEN p <> 0 THEN trunc(x / p)::BIGINT END AS qx, CASE WHEN q <> 0 THEN trunc((y - 9) / q)::BIGINT END AS qy, CASE WHEN p <> 0 THEN (x % p)::BIGINT END AS rx, CASE WHEN q <> 0 THEN ((y - 9) % q)::BIGINT END AS ry FROM t"
)
def position_algebra(spark, sf_dir):
    x, y, z = _xyz()
    other = (x - 7, y - 5, z - 3)
    sums, less, times = box.add((x, y, z), other), box.subtract((x, y, z), other), box.scale((x, y, z), 3)
    quotients, rests = box.divide((x, y - 9, z), other)
    return _grid(spark, sf_dir).select("vid", sums[0].alias("ax"), less[1].alias("sy"), times[2].alias("mz"), quotients[0].alias("qx"), quotients[1].alias("qy"), rests[0].alias("rx"), rests[1].alias("ry"))


@query(
    f"WITH {V}, b AS (SELECT vid, 1.0 + 0.5 * (x - 0.5::DOUBLE) AS bx, -2.0 + 0.25 * (y - 0.5::DOUBLE) AS y0, 0.5 + 2.0 * (z - 0.5::DOUBLE) AS bz FROM v)"
    " SELECT vid::BIGINT AS vid, [bx, bx, bx + 0.5, bx + 0.5] AS face_x, [bz, bz + 2, bz + 2, bz] AS face_z, y0 + 0.25 AS end_y, bx AS start_x FROM b"
)
def face_loop_corners(spark, sf_dir):
    corners = lattice.face_corners(BOX, 1, *_xyz())
    start, end = lattice.edge_ends(BOX, F.lit(1), *_xyz())
    base = BOX.base_of(F.col("vid"))
    return _grid(spark, sf_dir).select("vid", F.array(*(c[0] for c in corners)).alias("face_x"), F.array(*(c[2] for c in corners)).alias("face_z"), end[1].alias("end_y"), base[0].alias("start_x")).where(start[0] == base[0])


@query(
    "SELECT * FROM (VALUES ('around', 0, 19, 0, 15, 0, 8), ('empty', 0, 0, 0, 0, 0, 0), ('first', 0, 11, 0, 15, 0, 7), ('second', 12, 23, 0, 15, 0, 7), ('merged', 0, 23, 0, 15, 0, 7), ('wall', 11, 12, 0, 15, 0, 7),"
    " ('spanning', -3, 2, 1, 4, 0, 5), ('extended', 0, 24, 0, 16, 0, 8), ('lattice', 0, 46, 0, 30, 0, 14), ('z', 0, 3, 0, 3, 2, 3), ('minimal', 5, 5, 5, 5, 5, 5)) t(name, lx, ux, ly, uy, lz, uz)"
)
def box_algebra(spark, sf_dir):
    """Boxes and their inclusive bounds."""
    key = F.col("p_partkey")
    points = _table(spark, sf_dir, "part").select((key % 20).cast("int").alias("x"), (key % 16).cast("int").alias("y"), (key % 9).cast("int").alias("z"))
    first, second = BOX.split()
    merged, _, wall = second.merge(first)
    minimal = BoxMeta.spanning((5, 5, 5), (5, 5, 5))
    boxes = {
        "around": BoxMeta.around(points), "empty": BoxMeta.around(points.limit(0)), "first": first, "second": second, "merged": merged, "wall": wall,
        "spanning": BoxMeta.spanning((2, 1, 5), (-3, 4, 0)), "extended": BOX.extended(), "lattice": BOX.lattice(), "z": BoxMeta((4, 4, 4)).split()[1],
    } | ({"minimal": minimal} if minimal.minimal and minimal.split() is None else {})
    return spark.createDataFrame([(n, *b.bounds) for n, b in boxes.items()], "name string, lx int, ux int, ly int, uy int, lz int, uz int")


@query(
    f"WITH RECURSIVE {V}, d AS (SELECT * FROM (VALUES (1, 1, 0), (0, 0, 1)) t(dx, dy, dz)),"
    " joined AS (SELECT a.vid AS p, b.vid AS q FROM v a CROSS JOIN d JOIN v b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz AND a.value = b.value),"
    " ways AS (SELECT p, q FROM joined UNION ALL SELECT q, p FROM joined),"
    " reach(vid, other) AS (SELECT vid, vid FROM v UNION SELECT r.vid, j.q FROM reach r JOIN ways j ON r.other = j.p)"
    " SELECT vid::BIGINT AS vid, min(other)::BIGINT AS label FROM reach GROUP BY vid"
)
def grain_labels_by_steps(spark, sf_dir):
    return grains.find_grains(_grid(spark, sf_dir), steps=((1, 1, 0), (0, 0, 1))).select("vid", "label")


@query(
    f"WITH RECURSIVE {G}, e AS (SELECT key, unnest(es) AS entity FROM unit_edges), f AS (SELECT DISTINCT entity, hi, lo, alter FROM faces)"
    " SELECT key::BIGINT AS key, (row_number() OVER (PARTITION BY key ORDER BY coalesce(alter, -1) DESC, hi DESC, lo DESC) - 1)::INT AS pos, hi::BIGINT AS hi, lo::BIGINT AS lo, alter::INT AS alter FROM e JOIN f USING (entity)"
)
def face_order(spark, sf_dir):
    """The faces of each unit edge in the order of its id: alternatives first, then by index and pair, descending."""
    return _built(spark, sf_dir).unit_edges.select("key", F.posexplode("faces").alias("pos", "face")).select("key", "pos", "face.*")


@query(
    "WITH m AS (SELECT o_orderkey, list_distinct([o_custkey % 5, o_orderkey % 5, o_custkey % 3, o_orderkey % 7]) AS g FROM orders)"
    " SELECT o_orderkey, CASE WHEN len(g) >= 3 THEN list_reverse_sort(g)::BIGINT[] END AS members, CASE WHEN len(g) >= 3 THEN len(g) > 3 END AS multi, CASE WHEN o_orderkey % 9 = 0 THEN 333 ELSE (o_orderkey % 9 + 1)::INT END AS next FROM m"
)
def entity_ids(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    made = topology.make_id(F.array(c % 5, o % 5, c % 3, o % 7), 3)
    after = topology.next_alter(F.when(o % 9 != 0, (o % 9).cast("int")), "edge")
    return _table(spark, sf_dir, "orders").select("o_orderkey", made.alias("id"), after.alias("next")).select("o_orderkey", "id.members", "id.multi", "next")


# Graph tables

I_ = "i AS (SELECT o_orderkey AS seq, 10 + o_custkey % 7 AS hi, o_custkey % 5 AS lo, row_number() OVER (PARTITION BY o_custkey % 7, o_custkey % 5 ORDER BY o_orderkey % 10 <> 0, o_orderkey) AS n FROM orders)"


def _inserted(spark, sf_dir) -> dict[str, DataFrame]:
    """A graph of faces, a row of ``orders`` each, put in by two inserts."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    face = F.struct((10 + c % 7).alias("hi"), (c % 5).alias("lo"), F.lit(None).cast("int").alias("alter"))
    rows = _table(spark, sf_dir, "orders").select(face.alias("id"), F.concat(F.lit("p"), o).alias("prop"), o.alias("seq"))
    graph = graphtables.insert_new(graphtables.empty_graph(spark), "face", rows.where("seq % 10 = 0"))
    return graphtables.insert_new(graph | {"face": materialise(graph["face"], "faces")}, "face", rows.where("seq % 10 <> 0"))


@query(f"WITH {I_} SELECT hi, lo, CASE WHEN n > 1 THEN n + 1 END::INT AS alter, 'p' || seq AS prop FROM i")
def graph_insert_faces(spark, sf_dir):
    return _inserted(spark, sf_dir)["face"].select("id.*", "prop")


@query(f"WITH {I_} SELECT id, count(*) AS faces, NULL::VARCHAR AS prop FROM (SELECT hi AS id FROM i UNION ALL SELECT lo FROM i) GROUP BY id")
def graph_insert_links(spark, sf_dir):
    return _inserted(spark, sf_dir)["grain"].select("id", F.size("conn").cast("long").alias("faces"), "prop")


def _level(spark, sf_dir) -> DataFrame:
    """Customers as elements, every third without a property, linked to their orders."""
    c = F.col("c_custkey")
    rows = _table(spark, sf_dir, "customer").select(c.alias("id"), F.when(c % 3 != 0, F.concat(F.lit("c"), c)).alias("prop"))
    return graphtables.connect(graphtables.new_elements(rows), _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("other")))


LEVEL = "l AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN 'c' || c_custkey END AS prop, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey)"


@query(f"WITH {LEVEL} SELECT id, CASE WHEN id % 4 = 0 THEN coalesce(prop, '') || '!' ELSE prop END AS prop, n FROM l WHERE NOT (id % 4 = 2 AND id % 8 = 2)")
def graph_alter(spark, sf_dir):
    level = _level(spark, sf_dir)
    rows = level.where("id % 4 = 0 or id % 8 = 2").select("id", F.when(F.col("id") % 4 == 0, F.lit("!")).alias("prop"))
    changed = graphtables.alter(level, rows, lambda old, new: F.when(new.isNotNull(), F.concat(F.coalesce(old, F.lit("")), new)))
    return changed.select("id", "prop", F.size("conn").cast("long").alias("n"))


@query(f"WITH {LEVEL} SELECT id, n, prop FROM l WHERE id % 5 = 0 AND prop IS NOT NULL")
def graph_get_both(spark, sf_dir):
    level = _level(spark, sf_dir)
    return graphtables.get_both(level, graphtables.ids(level).where("id % 5 = 0")).select("id", F.size("conn").cast("long").alias("n"), "prop")


@query(f"WITH {LEVEL} SELECT id, n FROM l WHERE id % 5 = 0")
def graph_get_links(spark, sf_dir):
    level = _level(spark, sf_dir)
    return graphtables.get_links(level, graphtables.ids(level).where("id % 5 = 0")).select("id", F.size("conn").cast("long").alias("n"))


@query(f"WITH {LEVEL} SELECT id, CASE WHEN id % 2 = 1 THEN upper(prop) END AS prop FROM l")
def graph_unset_adjust(spark, sf_dir):
    level = _level(spark, sf_dir)
    return graphtables.adjust(graphtables.unset(level, level.where("id % 2 = 0").select("id")), F.upper).select("id", "prop")


@query(f"WITH {LEVEL} SELECT id, CASE WHEN id % 6 = 0 THEN 'new' ELSE prop END AS prop, CASE WHEN id % 6 = 0 THEN 0 ELSE n END AS n FROM l")
def graph_new_grains(spark, sf_dir):
    level = _level(spark, sf_dir)
    graph = graphtables.insert_new({"grain": level}, "grain", level.where("id % 6 = 0").select("id", F.lit("new").alias("prop")))
    return graph["grain"].select("id", "prop", F.size("conn").cast("long").alias("n"))


# More of boxes, matrices and vectors


def _merged(spark, sf_dir, axis: int) -> DataFrame:
    cells = materialise(_grid(spark, sf_dir).where("value <> 1"), "cells")
    half = BOX.dim[axis] // 2
    dim = tuple(half if k == axis else d for k, d in enumerate(BOX.dim))
    first, second = BoxMeta(dim), BoxMeta(dim, tuple(half if k == axis else 0 for k in range(3)))
    both, whole = sparse.merge(sparse.make(cells, first), first, sparse.make(cells, second), second)
    return both.where(whole.inside(*_xyz()))


@query(f"WITH {V} SELECT x, y, z, value FROM v WHERE value <> 1")
def sparse_merge_y(spark, sf_dir):
    return _merged(spark, sf_dir, 1)


@query(f"WITH {V} SELECT x, y, z, value FROM v WHERE value <> 1")
def sparse_merge_z(spark, sf_dir):
    return _merged(spark, sf_dir, 2)


@query(f"WITH {V} SELECT x - 4 AS x, y - 4 AS y, z - 2 AS z, value FROM v WHERE x BETWEEN 4 AND 13 AND y BETWEEN 4 AND 11 AND z BETWEEN 2 AND 5")
def sparse_shifted(spark, sf_dir):
    return sparse.shifted(sparse.make(_grid(spark, sf_dir), INNER), INNER)


@query("SELECT * FROM (VALUES ('empty', 0, NULL::INT), ('single', 1, 7)) t(name, n, value)")
def sparse_small(spark, sf_dir):
    none, one = sparse.empty(spark, (1, 2, 3))[0], sparse.singleton(spark, (1, 2, 3), 7)[0]
    count = lambda df, name: df.agg(F.lit(name).alias("name"), F.count("*").cast("int").alias("n"), F.max("value").alias("value"))
    return count(none, "empty").unionByName(count(one, "single"))


@query("SELECT pos, (pos % 4)::INT AS i, ((pos // 4) % 5)::INT AS j, (pos // 20)::INT AS k, pos AS back FROM (SELECT unnest(range(120)) AS pos)")
def array_places(spark, sf_dir):
    return matrix.places(spark, (4, 5, 6)).withColumn("back", matrix.position((4, 5, 6), F.col("i"), F.col("j"), F.col("k")))


@query(f"WITH {M}, p AS (SELECT o_orderkey, (o_orderkey % 40)::INT AS i, (o_custkey % 30)::INT AS j FROM orders) SELECT o_orderkey, p.i, p.j, coalesce(val, 0) AS val FROM p LEFT JOIN m ON m.i = p.i AND m.j = p.j")
def matrix_at(spark, sf_dir):
    points = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 40).cast("int").alias("i"), (F.col("o_custkey") % 30).cast("int").alias("j"))
    return matrix.at(_matrix(spark, sf_dir, "l_partkey", 40, "l_suppkey", 30), points, (40, 30))


@query(f"WITH {M} SELECT i, string_agg(printf('%.3e', val), ' ' ORDER BY j) AS text FROM m GROUP BY i")
def matrix_text(spark, sf_dir):
    return matrix.pretty(_matrix(spark, sf_dir, "l_partkey", 40, "l_suppkey", 30))


@query(f"WITH {M} SELECT i, list(val ORDER BY j) AS vals FROM m GROUP BY i")
def matrix_rows(spark, sf_dir):
    return matrix.rows(_matrix(spark, sf_dir, "l_partkey", 40, "l_suppkey", 30))


@query("SELECT (k % 3)::INT AS i, (k // 3)::INT AS j, (k * k)::DOUBLE AS val FROM (SELECT unnest(range(12)) AS k)")
def matrix_from_list(spark, sf_dir):
    return matrix.from_list(spark, (3, 4), [k * k for k in range(12)])


@query("SELECT o_orderkey, list_reverse_sort([o_orderkey % 7, o_custkey % 7, o_orderkey % 3, o_custkey % 5]) AS down, range(0, o_orderkey % 9 + 1) AS mixed FROM orders")
def vector_sorts(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    mixed = vectors.shuffle(F.sequence(F.lit(0).cast("long"), o % 9), 5)
    return _table(spark, sf_dir, "orders").select("o_orderkey", vectors.sort_down(o % 7, c % 7, o % 3, c % 5).alias("down"), F.array_sort(mixed).alias("mixed"))


@query("SELECT i, i + 1 AS j, 10.0::DOUBLE AS val FROM (SELECT unnest([0, 1]) AS i) UNION ALL SELECT 0, 0, 89.0 WHERE false")
def graph_power(spark, sf_dir):
    # A chain with weights 10: its first power is itself, its third is empty.
    chain = spark.createDataFrame([(0, 1, 10.0), (1, 2, 10.0)], "i int, j int, val double")
    return clustering.power(chain, 1).unionByName(clustering.power(chain, 3))
