"""The topology of a labelled grid: grains, faces between two, edges where three or more faces meet, and vertices.

Ids: a face is (hi, lo) of its grains and ``alter``, null for the first face of a pair of grains and 3, 4, ... for
others; an edge is its sorted faces and ``alter`` (333, 334, ...), a vertex its sorted grains and ``alter``
(666, 667, ...). Lattice places are relative to the box's origin, whatever that is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainlake.functions import lattice
from grainlake.functions.box import AXES, BoxMeta
from grainlake.operators.components import connected_components
from grainlake.operators.grains import neighbour_pairs
from grainlake.sources.shared import materialise

H = ("hx", "hy", "hz")
#: The first alternative index of each kind of id.
FIRST_ALTER = {"face": 3, "edge": 333, "vertex": 666}


@dataclass
class Topology:
    """Tables of the four levels, of the links from each to the one above, and of the lattice units.

    ``grains(grain_id)``, ``faces(face, area)``, ``edges(edge, state, n_vertices)``, ``vertices(vid, x, y, z, vertex,
    incident)``; ``grain_faces(grain_id, face)``, ``face_edges(face, edge)``, ``edge_vertices(edge, vid, vertex)``, a row
    a link; ``unit_faces`` and ``unit_edges``, a row a lattice place with the entity that it belongs to. A face between
    two large grains is many rows and never one.
    """

    grains: DataFrame
    faces: DataFrame
    edges: DataFrame
    vertices: DataFrame
    grain_faces: DataFrame
    face_edges: DataFrame
    edge_vertices: DataFrame
    unit_faces: DataFrame
    unit_edges: DataFrame

    def nested(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Grains, faces and edges with their links as sorted arrays, for levels whose elements have few."""
        faces = _with_links(self.grains, self.grain_faces, "grain_id", "face", "faces")
        edges = _with_links(self.faces, self.face_edges, "face", "edge", "edges")
        return faces, edges, _with_links(self.edges, self.edge_vertices, "edge", "vertex", "vertices")


def _with_links(level: DataFrame, links: DataFrame, key: str, other: str, name: str) -> DataFrame:
    listed = links.groupBy(key).agg(F.array_sort(F.collect_list(other)).alias(name))
    none = F.array().cast(listed.schema[name].dataType)
    return _join_on(level, listed, key).withColumn(name, F.coalesce(name, none))


def lattice_key(box: BoxMeta) -> Column:
    """The serial number of a doubled-lattice place."""
    return box.lattice().vid(*(F.col(h) for h in H))


def unit_faces(labels: DataFrame, box: BoxMeta) -> DataFrame:
    """``key, axis, hx, hy, hz, hi, lo``: one row for each pair of neighbouring voxels with different labels."""
    pairs = neighbour_pairs(labels.drop("value").withColumnRenamed("label", "value")).where("value <> value2")
    upper = BoxMeta(box.dim).position(F.col("vid2"))
    place = lattice.face_place(F.col("axis"), *upper)
    rows = pairs.select("axis", *(p.cast("int").alias(h) for p, h in zip(place, H)), F.greatest("value", "value2").alias("hi"), F.least("value", "value2").alias("lo"))
    return rows.withColumn("key", lattice_key(box))


def _steps_around(axis: Column, kind: str) -> Column:
    """Places next to one: the four edges of a face, or the two ends of an edge."""
    at = tuple(F.col(h) for h in H)
    near = lambda k: F.array(*(lattice.moved(at, s) for s in lattice.steps(tuple(j for j in range(3) if (j != k) == (kind == "face")))))
    return F.when(axis == 0, near(0)).when(axis == 1, near(1)).otherwise(near(2))


def _entities(units: DataFrame, kind: str, same: list[str]) -> DataFrame:
    """``units`` with ``entity`` (the smallest key of units connected to it) and ``alter``.

    Units with equal ids that share a place next to them are connected: each place links its units in a chain, so
    there are no more links than units and places.
    """
    spots = units.select("key", *same, F.explode(_steps_around(F.col("axis"), kind)).alias("spot"))
    chain = Window.partitionBy(*same, "spot").orderBy("key")
    links = spots.withColumn("dst", F.lag("key").over(chain)).where("dst is not null").select(F.col("key").alias("src"), "dst")
    parts = connected_components(links).select(F.col("id").alias("key"), F.col("label").alias("entity"))
    placed = units.join(parts, "key", "left").withColumn("entity", F.coalesce("entity", "key"))
    first = FIRST_ALTER[kind]
    turn = F.row_number().over(Window.partitionBy(*same).orderBy("entity"))
    alter = placed.select(*same, "entity").distinct().withColumn("alter", F.when(turn > 1, turn + (first - 2))).select("entity", "alter")
    return placed.join(alter, "entity")


def face_entities(units: DataFrame) -> DataFrame:
    """``unit_faces`` with ``entity``, ``alter`` and the struct ``face``; alternatives in the order of smallest places."""
    placed = _entities(units, "face", ["hi", "lo"])
    return placed.withColumn("face", F.struct("hi", "lo", "alter"))


def _face_order(face: Column) -> Column:
    """Plain faces before alternatives, then by index and pair."""
    return F.struct(F.coalesce(face["alter"], F.lit(-1)).alias("rank"), face["hi"].alias("hi"), face["lo"].alias("lo"))


def _faces_down(faces: Column) -> Column:
    """Faces in descending order of their ids."""
    keyed = F.sort_array(F.transform(faces, _face_order), asc=False)
    return F.transform(keyed, lambda k: F.struct(k["hi"].alias("hi"), k["lo"].alias("lo"), F.when(k["rank"] >= 0, k["rank"]).alias("alter")))


def unit_edges(faces: DataFrame, box: BoxMeta) -> DataFrame:
    """``key, axis, hx, hy, hz, multi, faces``: lattice edges on which three or more unit faces of three or more faces lie.

    Faces offer themselves to their four edges, so nothing is looked up. Three faces make a simple id, four the set.
    """
    spots = faces.select("face", F.explode(_steps_around(F.col("axis"), "face")).alias("spot")).select("face", "spot.*")
    met = spots.groupBy(*H).agg(F.collect_list("face").alias("all")).withColumn("once", F.array_distinct("all"))
    kept = met.where((F.size("all") >= 3) & (F.size("once") >= 3))
    axis = lattice.edge_axis(*(F.col(h) for h in H))
    out = kept.select(*H, axis.cast("int").alias("axis"), (F.size("all") > 3).alias("multi"), _faces_down(F.col("once")).alias("faces"))
    return out.withColumn("key", lattice_key(box))


def make_id(members: Column, least: int) -> Column:
    """The id of an edge (of at least 3 faces) or a vertex (of at least 4 grains): the distinct members in descending
    order, whether there are more than needed (``multi``), and no alternative index; null of too few."""
    once = F.array_distinct(members)
    made = F.struct((F.size(once) > least).alias("multi"), F.sort_array(once, asc=False).alias("members"), F.lit(None).cast("int").alias("alter"))
    return F.when(F.size(once) >= least, made)


def next_alter(alter: Column, kind: str) -> Column:
    """The alternative index that follows one; of none the first of its kind."""
    return F.when(alter.isNull(), F.lit(FIRST_ALTER[kind])).otherwise(alter + 1)


def edge_entities(units: DataFrame) -> DataFrame:
    """``unit_edges`` with ``entity``, ``alter`` and the struct ``edge``."""
    return _entities(units, "edge", ["multi", "faces"]).withColumn("edge", F.struct("multi", "faces", "alter"))


def vertices(labels: DataFrame, edges: DataFrame, box: BoxMeta) -> DataFrame:
    """``vid, x, y, z, vertex, incident``: corners where over three grains and three or more edges of three or more
    ids meet. ``incident`` has the edges there, one for each unit edge.

    A vertex lies at the lower corner of voxel ``vid``. Alternatives count from the largest ``vid`` down.
    """
    x, y, z = BoxMeta(box.dim).position(F.col("vid"))
    corners = F.array(*(F.struct((x + a).alias("x"), (y + b).alias("y"), (z + c).alias("z")) for a in (0, 1) for b in (0, 1) for c in (0, 1)))
    grains = labels.select("label", F.explode(corners).alias("c")).select("label", "c.*").groupBy(*AXES).agg(F.collect_set("label").alias("grains")).where(F.size("grains") > 3)
    ends = edges.select("edge", F.explode(_steps_around(F.col("axis"), "edge")).alias("spot")).select("edge", *(F.col(f"spot.{h}") for h in H))
    at = lattice.voxel_of(*(F.col(h) for h in H))
    meeting = ends.select("edge", *(p.alias(a) for p, a in zip(at, AXES))).groupBy(*AXES).agg(F.collect_list("edge").alias("incident"))
    meeting = meeting.where((F.size("incident") >= 3) & (F.size(F.array_distinct("incident")) >= 3))
    zero = BoxMeta(box.dim)
    found = grains.join(meeting, list(AXES)).where(zero.inside(*(F.col(a) for a in AXES))).withColumn("vid", zero.vid(*(F.col(a) for a in AXES)))
    found = found.withColumn("grains", F.sort_array("grains", asc=False))
    turn = F.row_number().over(Window.partitionBy("grains").orderBy(F.desc("vid")))
    found = found.withColumn("alter", F.when(turn > 1, turn + (FIRST_ALTER["vertex"] - 2)))
    return found.select("vid", *AXES, F.struct((F.size("grains") > 4).alias("multi"), "grains", "alter").alias("vertex"), "incident")


#: What an edge is by how many vertices it meets, with repetition.
STATES = ("dummy", "half", "full")


def edge_states(edges: DataFrame, met: DataFrame) -> DataFrame:
    """``edge, state, n_vertices`` of every edge entity, by its rows in ``met(edge, vid, vertex)``: dummy, half, full or,
    from three vertices on, bad."""
    counts = met.groupBy("edge").agg(F.count("*").alias("n_vertices"))
    joined = _join_on(edges.select("edge").distinct(), counts, "edge").withColumn("n_vertices", F.coalesce("n_vertices", F.lit(0)).cast("long"))
    state = F.when(F.col("n_vertices") > 2, F.lit("bad"))
    for k, name in enumerate(STATES):
        state = state.when(F.col("n_vertices") == k, F.lit(name))
    return joined.select("edge", state.alias("state"), "n_vertices")


def _join_on(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join on an id, whose alternative index may be null: as null-safe equality does for whole structs."""
    other = right.withColumnRenamed(key, "_key")
    return left.join(other, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def face_edge_links(faces: DataFrame, edges: DataFrame, found: DataFrame, everywhere: bool = False) -> DataFrame:
    """Distinct ``face, edge`` links, from the unit edges that end at a vertex; ``everywhere`` takes all unit edges, so
    that closed lines have links too."""
    units = edges.select("edge", "axis", *H)
    if not everywhere:
        corners = found.select(*((F.col(a) * 2 - 1).alias(f"_{h}") for a, h in zip(AXES, H)))
        ends = units.select("*", F.explode(_steps_around(F.col("axis"), "edge")).alias("spot"))
        units = ends.join(corners, [F.col(f"spot.{h}") == F.col(f"_{h}") for h in H], "left_semi").select("edge", "axis", *H).distinct()
    # A face lies at an edge if the edge is one of its four.
    around = faces.select("face", F.explode(_steps_around(F.col("axis"), "face")).alias("spot")).select("face", *(F.col(f"spot.{h}").alias(f"_{h}") for h in H))
    return units.join(around, [F.col(h) == F.col(f"_{h}") for h in H]).select("face", "edge").distinct()


def build(labels: DataFrame, box: BoxMeta, everywhere: bool = False) -> Topology:
    """All four levels of a labelled grid. A grid with another origin is shifted to 0 first."""
    if box.origin != (0, 0, 0):
        moved = [(F.col(a) - o).alias(a) for a, o in zip(AXES, box.origin)]
        labels, box = labels.select("vid", *moved, "label"), BoxMeta(box.dim, (0, 0, 0), box.world, box.spacing)
        labels = labels.withColumn("vid", box.vid(*(F.col(a) for a in AXES)))
    labels = materialise(labels.select("vid", *AXES, "label"), "labels")
    units = materialise(face_entities(unit_faces(labels, box)), "unit-faces")
    lines = materialise(edge_entities(unit_edges(units, box)), "unit-edges")
    points = materialise(vertices(labels, lines, box), "vertices")
    of_grain = units.select("face", F.explode(F.array("hi", "lo")).alias("grain_id")).distinct()
    met = points.select("vid", "vertex", F.explode("incident").alias("edge")).select("edge", "vid", "vertex")
    grains = labels.select(F.col("label").alias("grain_id")).distinct()
    faces = units.groupBy("face").agg(F.count("*").alias("area"))
    return Topology(grains, faces, edge_states(lines, met), points, of_grain, face_edge_links(units, lines, points, everywhere), met, units, lines)
