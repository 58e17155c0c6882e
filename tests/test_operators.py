import itertools
import random
import time
import xml.etree.ElementTree as ET
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainlake.functions import vectors
from grainlake.functions.box import BoxMeta
from grainlake.operators import clustering, components, grains, graphtables, matrix, optimum, segments, sparse, topology
from grainlake.sources import grids, shared, vtk


def union_find(n, edges):
    parent = list(range(n))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def brute_labels(box, values, same):
    dx, dy, dz = box.dim
    at = lambda x, y, z: x + dx * y + dx * dy * z
    edges = []
    for x, y, z in itertools.product(range(dx), range(dy), range(dz)):
        for a, b, c in ((x + 1, y, z), (x, y + 1, z), (x, y, z + 1)):
            if a < dx and b < dy and c < dz and same(values[at(x, y, z)], values[at(a, b, c)]):
                edges.append((at(x, y, z), at(a, b, c)))
    return union_find(box.size, edges)


def labels_of(df):
    return [r.label for r in df.orderBy("vid").collect()]


@pytest.mark.parametrize("at_once", [20, 1000])
def test_components(spark, at_once):
    r = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 60)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(300, 300)]
    got = {r.id: r.label for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long"), at_once=at_once).collect()}
    want = union_find(301, edges)
    assert got == {k: want[k] for e in edges if e[0] != e[1] for k in e}
    assert components.connected_components(spark.createDataFrame([(1, None), (4, 4)], "src long, dst long")).count() == 0
    words = spark.createDataFrame([("b", "c"), ("é", "b"), ("x", "y")], "src string, dst string")
    assert {r.id: r.label for r in components.connected_components(words, at_once=at_once).collect()} == {"b": "b", "c": "b", "é": "b", "x": "x", "y": "x"}
    star = [(0, k) for k in range(1, 90)] + [(200, 199)] + [(k, k + 100) for k in range(200, 260)]
    got = {r.id: r.label for r in components.connected_components(spark.createDataFrame(star, "src long, dst long"), at_once=at_once).collect()}
    want = union_find(400, star)
    assert got == {k: want[k] for e in star for k in e}


def test_small_grids(spark):
    two = grains.find_grains(grids.from_values(spark, BoxMeta((2, 2, 1)), [1, 1, 0, 0]))
    assert labels_of(two) == [0, 0, 2, 2]
    three = grains.find_grains(grids.from_values(spark, BoxMeta((3, 3, 1)), [1, 0, 1, 1, 0, 1, 1, 1, 1]))
    assert len(set(labels_of(three))) == 2


@pytest.mark.parametrize("seed", range(3))
def test_random_grids(spark, seed):
    r = random.Random(seed)
    box = BoxMeta((4, 5, 3), (seed, -seed, 2))
    values = [r.randrange(3 + seed) for _ in range(box.size)]
    grid = grids.from_values(spark, box, values)
    assert labels_of(grains.find_grains(grid)) == brute_labels(box, values, lambda a, b: a == b)
    close = grains.find_grains(grid, lambda a, b: F.abs(a - b) <= 1)
    assert labels_of(close) == brute_labels(box, values, lambda a, b: abs(a - b) <= 1)


def test_missing_and_odd_values(spark):
    grid = grids.from_values(spark, BoxMeta((4, 1, 1)), [float("nan"), float("nan"), 1.0, 1.0])
    assert labels_of(grains.find_grains(grid)) == [0, 1, 2, 2]
    holes = grid.withColumn("value", F.when(F.col("vid") < 2, F.col("value").cast("int")))
    holes = holes.withColumn("value", F.when(F.col("vid") == 3, F.lit(7)))
    assert labels_of(grains.find_grains(holes)) == [3] and labels_of(grains.find_grains(holes, dense=True)) == [0, 1, 2, 3]


def test_reset_ids_are_a_permutation(spark):
    labels = spark.createDataFrame([(k, k // 3 * 10) for k in range(30)] + [(99, None)], "vid long, label long")
    got = grains.reset_grain_ids(labels, 3).collect()
    assert sorted({r.label for r in got if r.vid != 99}) == list(range(10)) and next(r.label for r in got if r.vid == 99) is None
    assert len({(r.vid // 3, r.label) for r in got}) == 11


def test_topology_of_eight_grains(spark, tmp_path):
    # Eight cubes around one corner: 12 faces, 6 edges that end there, 1 vertex.
    for origin in ((0, 0, 0), (3, -1, 5)):
        box = BoxMeta((2, 2, 2), origin)
        labels = grains.find_grains(grids.from_values(spark, box, list(range(8))))
        t = topology.build(labels, box)
        assert (t.grains.count(), t.faces.count(), t.edges.count(), t.vertices.count()) == (8, 12, 6, 1)
        assert {r.state for r in t.edges.collect()} == {"half"} and {len(r.edges) for r in t.nested()[1].collect()} == {2}
        vertex = t.vertices.first()
        assert vertex.vertex.multi and vertex.vertex.grains == list(range(7, -1, -1)) and vertex.vertex.alter is None
        assert {len(r.faces) for r in t.nested()[0].collect()} == {3} and {len(r.vertices) for r in t.nested()[2].collect()} == {1}
    for name, df in (("faces", t.nested()[1]), ("edges", t.nested()[2])):
        grids.write_tables(str(tmp_path), **{name: df})
        back = grids.read_tables(spark, str(tmp_path), name)[name]
        assert sorted(map(str, back.collect())) == sorted(map(str, df.collect())) and back.dtypes == df.dtypes


def test_flat_grids_have_triple_lines_but_no_vertices(spark):
    box = BoxMeta((2, 2, 1))
    t = topology.build(grains.find_grains(grids.from_values(spark, box, [1, 2, 3, 4])), box)
    edge = t.edges.first()
    assert t.edges.count() == 1 and edge.state == "dummy" and edge.edge.multi and t.vertices.count() == 0
    assert {len(r.edges) for r in t.nested()[1].collect()} == {0}
    full = topology.build(grains.find_grains(grids.from_values(spark, box, [1, 2, 3, 4])), box, everywhere=True)
    assert {len(r.edges) for r in full.nested()[1].collect()} == {1}


def test_same_pair_of_grains_meets_twice(spark):
    # A bar between two parts of the other grain: two faces of the same pair.
    box = BoxMeta((3, 3, 1))
    labels = grains.find_grains(grids.from_values(spark, box, [1, 0, 1, 1, 0, 1, 1, 1, 1]))
    assert [r.alter for r in topology.build(labels, box).faces.select("face.alter").collect()] == [None]
    ring = grains.find_grains(grids.from_values(spark, BoxMeta((5, 1, 1)), [1, 0, 0, 0, 1])).withColumn("label", F.when(F.col("vid") == 4, 0).otherwise(F.col("label")))
    faces = topology.build(ring, BoxMeta((5, 1, 1))).faces.select("face.*").collect()
    assert sorted((r.hi, r.lo, r.alter or 0) for r in faces) == [(1, 0, 0), (1, 0, 3)]


def test_graph_tables(spark):
    level = graphtables.empty_level(spark)
    level = graphtables.connect(level, spark.createDataFrame([(1, 7), (2, 7), (1, 8)], "id long, other long"))
    assert {r.id: (r.prop, r.conn) for r in level.collect()} == {1: (None, [7, 8]), 2: (None, [7])}
    level = graphtables.upsert(level, spark.createDataFrame([(1, "a"), (3, "c")], "id long, prop string"))
    level = graphtables.upsert(level, spark.createDataFrame([(1, "b")], "id long, prop string"), lambda old, new: F.concat(old, new))
    assert {r.id: (r.prop, r.conn) for r in level.collect()} == {1: ("ab", [7, 8]), 2: (None, [7]), 3: ("c", [])}
    assert {r.id for r in graphtables.with_prop(level).collect()} == {1, 3}
    assert {r.prop for r in graphtables.adjust(level, F.upper).collect()} == {"AB", None, "C"}
    gone = graphtables.unset(level, spark.createDataFrame([(1,)], "id long"))
    assert {r.id: (r.prop, r.conn) for r in gone.collect()}[1] == (None, [7, 8])
    fresh = graphtables.replace_elements(level, spark.createDataFrame([(1, "z")], "id long, prop string"))
    assert {r.id: (r.prop, r.conn) for r in fresh.collect()}[1] == ("z", [])
    assert graphtables.get(level, spark.createDataFrame([(2,), (9,)], "id long")).count() == 1


def test_sparse_boxes(spark):
    a, b = BoxMeta((3, 3, 3)), BoxMeta((3, 3, 3), (3, 0, 0))
    cells = lambda rows: spark.createDataFrame(rows, "x int, y int, z int, value int")
    left, right = sparse.make(cells([(0, 0, 0, 1), (9, 0, 0, 2)]), a), sparse.make(cells([(3, 1, 1, 5)]), b)
    merged, box = sparse.merge(left, a, right, b)
    assert box == BoxMeta((6, 3, 3)) and merged.count() == 2 and sparse.merge(left, a, right, BoxMeta((3, 3, 3), (3, 1, 0))) is None
    new = sparse.adjust(merged, spark.createDataFrame([(1, 0, 0, 0, 10), (2, 0, 0, 0, 20), (3, 2, 2, 2, 7)], "seq int, x int, y int, z int, value int"))
    got = {(r.x, r.y, r.z): r.value for r in new.collect()}
    assert got == {(0, 0, 0): 20, (3, 1, 1): 5}
    assert sparse.lookup(new, spark.createDataFrame([(2, 2, 2)], "x int, y int, z int")).first().value is None
    assert sparse.shifted(right, b).first().x == 0


def test_matrices(spark):
    a, b = matrix.from_list(spark, (2, 3), range(6)), matrix.from_list(spark, (3, 2), range(6))
    dense = lambda df, shape: np.array([[{(r.i, r.j): r.val for r in df.collect()}.get((i, j), 0) for j in range(shape[1])] for i in range(shape[0])])
    na, nb = np.arange(6.0).reshape(3, 2).T, np.arange(6.0).reshape(2, 3).T
    assert (dense(a, (2, 3)) == na).all() and (dense(matrix.multiply(a, b), (2, 2)) == na @ nb).all()
    assert (dense(matrix.combine(a, matrix.transpose(b), -1), (2, 3)) == na - nb.T).all()
    assert [r.vals for r in matrix.columns(a).orderBy("j").collect()] == na.T.tolist() and [r.vals for r in matrix.rows(a).orderBy("i").collect()] == na.tolist()
    assert matrix.pretty(matrix.identity(spark, 2)).orderBy("i").first().text == "1.000e+00 0.000e+00"
    # Ties go to the even digit, and by the exact value: 2.0005 lies above it, 1.0005 below.
    odd = [12345.0, 12355.0, -12345.0, 1.0005, 2.0005, float("inf"), float("nan"), None]
    cells = spark.createDataFrame([(0, j, v) for j, v in enumerate(odd)] + [(1, 0, None)], "i int, j int, val double")
    assert [r.text for r in matrix.pretty(cells).orderBy("i").collect()] == ["1.234e+04 1.236e+04 -1.234e+04 1.000e+00 2.001e+00 inf nan", None]
    assert dense(matrix.apply(matrix.zeros(spark, (2, 2)), lambda v: v + 1), (2, 2)).sum() == 4
    for wrong in (lambda: matrix.combine(a, b, 1, ((2, 3), (3, 2))), lambda: matrix.multiply(a, a, ((2, 3), (2, 3))), lambda: matrix.from_list(spark, (2, 2), [1]), lambda: matrix.diagonal(a, (2, 3))):
        with pytest.raises(ValueError):
            wrong()


def test_vectors(spark):
    row = spark.createDataFrame([([1, 3, 5, 7, 9], [1.0, 2.0], [3.0, 4.0])], "s array<int>, a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    assert list(row.select(*(vectors.binary_search(F.col("s"), F.lit(x)) for x in (5, 1, 9, 0, 10))).first()) == [2, 0, 4, 0, 4]
    got = row.select(vectors.add(a, b), vectors.subtract(a, b), vectors.pointwise(a, b), vectors.neg(a), vectors.dot(a, b), vectors.zeros(2), vectors.sort_down(F.lit(1), F.lit(3), F.lit(2))).first()
    assert list(got) == [[4, 6], [-2, -2], [3, 8], [-1, -2], 11.0, [0.0, 0.0], [3, 2, 1]]
    mixed = row.select(vectors.shuffle(F.sequence(F.lit(0), F.lit(20)), 4)).first()[0]
    assert sorted(mixed) == list(range(21)) != mixed
    with pytest.raises(Exception, match="different lengths"):
        row.select(vectors.add(a, F.lit([1.0]))).collect()


def test_segments(spark):
    def sort(pairs, **kw):
        got = segments.sort_segments(spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "idx long, head long, tail long"), **kw)
        return [(k, [(r.head, r.tail) for r in sorted(rs, key=lambda r: r.pos)]) for (_, k), rs in ((key, list(v)) for key, v in itertools.groupby(sorted(got.collect(), key=lambda r: (r.seq, r.kind)), key=lambda r: (r.seq, r.kind)))]

    assert sort([(1, 2), (2, 3), (3, 1)]) == [("loop", [(1, 2), (2, 3), (3, 1)])]
    assert sort([(1, 2), (2, 3), (3, 4)]) == [("open", [(1, 2), (2, 3), (3, 4)])]
    (kind, chain), = sort([(2, 1), (2, 3), (4, 3)])
    assert kind == "open" and chain in ([(1, 2), (2, 3), (3, 4)], [(4, 3), (3, 2), (2, 1)])
    assert sort([(5, 5), (1, 2)]) == [("loop", [(5, 5)]), ("open", [(1, 2)])]
    r = random.Random(1)
    for _ in range(3):
        loop = [(k, (k + 1) % 30) for k in range(30)]
        mixed = [p if r.random() < 0.5 else p[::-1] for p in r.sample(loop, 30)]
        (kind, chain), = sort(mixed)
        assert kind == "loop" and all(a[1] == b[0] for a, b in zip(chain, [*chain[1:], chain[0]]))
        assert Counter(map(frozenset, chain)) == Counter(map(frozenset, loop))
    branch = segments.chain([(1, 2), (2, 3), (2, 4), (2, 5)])
    assert sorted(k for _, s in branch for k, _ in s) == [0, 1, 2, 3]
    near = spark.createDataFrame([(0, 0.0, 1.0), (1, 1.0001, 2.0)], "idx long, head double, tail double")
    close = spark.createDataFrame([(0, 0.0, 1.0149), (1, 1.0151, 2.0), (2, 2.011, 3.0)], "idx long, head double, tail double")
    assert [(r.seq, r.idx) for r in segments.sort_segments(close, tolerance=0.01).orderBy("idx").collect()] == [(0, 0), (0, 1), (2, 2)]
    many = [(k, k // 40 * 100 + k % 40, k // 40 * 100 + k % 40 + 1) for k in range(4000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        sizes = Counter(r.seq for r in segments.sort_segments(spark.createDataFrame(many, "idx long, head long, tail long")).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sizes == {40 * k: 40 for k in range(100)}
    found = segments.sort_segments(near, tolerance=0.01)
    assert found.select("seq").distinct().count() == 1 and segments.only(found, "open") is not None and segments.only(found, "loop") is None
    assert segments.opens(found).count() == 2 and segments.loops(found).count() == 0


def test_minima():
    bowl = lambda v: (float(v @ v), 2 * v)
    assert 0.1 < optimum.line_search(bowl, np.array([1.0, 0.0]), np.array([-4.0, -2.0])) < 0.3
    assert optimum.line_search(bowl, np.array([1.0, 0.0]), np.array([1.0, 0.0])) == 1.0
    quad = lambda v: (float((v[0] - 2) ** 2 + 3 * (v[1] + 1) ** 2), np.array([2 * (v[0] - 2), 6 * (v[1] + 1)]))
    assert np.allclose(optimum.bfgs(quad, np.array([100.0, 431.0])), [2, -1], atol=1e-6)


def test_steps_meet_the_wolfe_conditions():
    rng = np.random.default_rng(0)
    shapes = [lambda v: (float(np.cos(v).sum() + 0.1 * v @ v), -np.sin(v) + 0.2 * v), lambda v: (float((v**4).sum() - v.sum()), 4 * v**3 - 1), lambda v: (float(np.log1p(v @ v)), 2 * v / (1 + v @ v))]
    for f in shapes:
        for _ in range(40):
            x = rng.normal(0, 3, 3)
            down = -f(x)[1] * 10 ** rng.uniform(-4, 2)
            a, slope = optimum.line_search(f, x, down), float(down @ f(x)[1])
            value, gradient = f(x + a * down)
            assert value <= f(x)[0] + optimum.DECREASE * a * slope and abs(gradient @ down) <= -optimum.CURVATURE * slope + 1e-9
    banana = lambda v: (float(100 * (v[1] - v[0] ** 2) ** 2 + (1 - v[0]) ** 2), np.array([-400 * v[0] * (v[1] - v[0] ** 2) - 2 * (1 - v[0]), 200 * (v[1] - v[0] ** 2)]))
    assert np.allclose(optimum.bfgs(banana, np.array([-1.2, 1.0]), optimum.Stop(rounds=300)), [1, 1], atol=1e-5)
    other = lambda v: (float(2 * v[0] ** 2 + 2 * v[0] * v[1] + 2 * v[1] ** 2 - 6 * v[0]), np.array([4 * v[0] + 2 * v[1] - 6, 2 * v[0] + 4 * v[1]]))
    assert np.allclose(optimum.bfgs(other, np.array([100.0, 431.0])), [2, -1], atol=1e-6)


def test_clusters(spark):
    cliques = [(a, b) for k in (0, 10, 20) for a in range(k, k + 5) for b in range(k, a)] + [(0, 10)]
    got = {r.id: r.cluster for r in clustering.markov_cluster(spark.createDataFrame(cliques, "src long, dst long")).collect()}
    assert got == {k + j: k for k in (0, 10, 20) for j in range(5)}
    m = matrix.from_list(spark, (2, 2), [1, 1, 1, 0])
    table = shared.materialise(m, "caller")
    assert {(r.i, r.j): r.val for r in clustering.power(table, 11).collect()} == {(0, 0): 144, (0, 1): 89, (1, 0): 89, (1, 1): 55}
    assert table.count() == 3 + 1  # what the caller made stays
    assert {(r.i, r.j): r.val for r in clustering.power(m, 10).collect()} == {(0, 0): 89, (0, 1): 55, (1, 0): 55, (1, 1): 34}


def test_exports(spark, tmp_path):
    box = BoxMeta((3, 2, 2), spacing=(0.5, 1.0, 1.0))
    grid = grids.from_values(spark, box, list(range(12)))
    vtk.write_rectilinear(tmp_path / "g.vtr", grid, box, ["value"])
    arrays = {a.get("Name"): a.text.split() for a in ET.parse(tmp_path / "g.vtr").iter("DataArray")}
    assert arrays["value"] == [str(k) for k in range(12)] and arrays["x"] == ["-0.25", "0.25", "0.75"]
    t = topology.build(grains.find_grains(grids.from_values(spark, box, [1, 2, 3] * 4)), box)
    vtk.write_unstructured(tmp_path / "f.vtu", vtk.element_rows(t.unit_faces, "face"), box, "face")
    arrays = {a.get("Name"): a.text.split() for a in ET.parse(tmp_path / "f.vtu").iter("DataArray")}
    assert arrays["color"] == ["1"] * 4 + ["2"] * 4 and arrays["offsets"][-1] == "32" and set(arrays["types"]) == {"9"}
    assert len(arrays["Points"]) == 3 * 4 * 3 * 3 and max(map(int, arrays["connectivity"])) < 36


def test_attributes_of_several_components(spark, tmp_path):
    box = BoxMeta((2, 1, 1))
    grid = grids.from_values(spark, box, [1, 2]).withColumns({"v": F.array(F.lit(1.0), F.lit(2.0)), "n": F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)), "m": F.array(*(F.lit(float(k)) for k in range(9)))})
    vtk.write_rectilinear(tmp_path / "g.vtr", grid, box, ["v", "n", "m"], normals="n")
    tree = ET.parse(tmp_path / "g.vtr")
    arrays = {a.get("Name"): (a.get("NumberOfComponents"), a.text.split()) for a in tree.iter("DataArray")}
    assert arrays["v"] == ("3", ["1", "2", "0"] * 2) and arrays["n"][0] == "3" and arrays["m"][0] == "9" and next(tree.iter("PointData")).get("Normals") == "n"
    vtk.write_unstructured(tmp_path / "v.vtu", vtk.grain_rows(grid.withColumn("label", F.col("vid")), "v"), box, "voxel", ("v",))
    arrays = {a.get("Name"): a.text.split() for a in ET.parse(tmp_path / "v.vtu").iter("DataArray")}
    assert arrays["color"] == ["1", "2"] and arrays["v"] == ["1", "2", "0"] * 2 and set(arrays["types"]) == {"1"}
    with pytest.raises(ValueError):
        vtk.write_rectilinear(tmp_path / "x.vtr", grid.withColumn("v", F.array(*map(F.lit, range(5)))), box, ["v"])


def test_new_elements_of_a_graph(spark):
    graph = graphtables.empty_graph(spark)
    assert graphtables.ids(graph["grain"]).count() == 0
    graph = graphtables.insert_new(graph, "grain", spark.createDataFrame([(1, "10", 0)], "id long, prop string, seq int"))
    assert [(r.id, r.prop) for r in graph["grain"].collect()] == [(1, "10")]
    rows = spark.createDataFrame([((2, 1, None), "a", 0), ((2, 1, None), "b", 1), ((3, 1, None), "c", 2)], f"id {graphtables.FACE_ID}, prop string, seq int")
    graph = graphtables.insert_new(graph, "face", rows)
    assert {(*r.id, r.prop) for r in graph["face"].collect()} == {(2, 1, None, "a"), (2, 1, 3, "b"), (3, 1, None, "c")}
    assert {r.id: len(r.conn) for r in graph["grain"].collect()} == {1: 3, 2: 2, 3: 1}
    # A free number between taken ones is found.
    gap = graph["face"].where("id.alter is null or id.hi = 3").unionByName(spark.createDataFrame([((2, 1, 4), "x", [])], graph["face"].schema))
    more = spark.createDataFrame([((2, 1, None), str(k), k) for k in range(3)], f"id {graphtables.FACE_ID}, prop string, seq int")
    assert [r.id.alter for r in graphtables.unique_ids(gap, more, "face").orderBy("seq").collect()] == [3, 5, 6]
    edge = (False, [(3, 1, None), (2, 1, None), (3, 2, None)], None)
    graph = graphtables.insert_new(graph, "edge", spark.createDataFrame([(edge, "e", 0, edge[1])], f"id {graphtables.EDGE_ID}, prop string, seq int, below array<{graphtables.FACE_ID}>"))
    assert {(*r.id, r.prop, len(r.conn)) for r in graph["face"].collect()} == {(2, 1, None, "a", 1), (2, 1, 3, "b", 0), (3, 1, None, "c", 1), (3, 2, None, None, 1)}
    graph = graphtables.insert_new(graph, "vertex", spark.createDataFrame([((False, [4, 3, 2, 1], None), "v", 0, [edge])], f"id {graphtables.VERTEX_ID}, prop string, seq int, below array<{graphtables.EDGE_ID}>"))
    assert graph["vertex"].first().prop == "v" and len(graph["edge"].first().conn) == 1
    level = graphtables.new_elements(spark.createDataFrame([(1, "a"), (2, None)], "id long, prop string"))
    gone = graphtables.alter(level, spark.createDataFrame([(1, "x"), (3, "y")], "id long, prop string"), lambda old, new: F.when(old.isNull(), new))
    assert {(r.id, r.prop) for r in gone.collect()} == {(2, None), (3, "y")}
    assert graphtables.get_both(level, graphtables.ids(level)).count() == 1 and graphtables.get_links(level, graphtables.ids(level)).count() == 2


def test_many_rows_of_one_id(spark):
    """Free numbers as if rows were inserted one after another, in a time that doesn't grow with rows times taken numbers."""
    r = random.Random(3)
    taken = sorted({0, *r.sample(range(1, 90_000), 40_000)})
    face = lambda alter: F.struct(F.lit(2).cast("long").alias("hi"), F.lit(1).cast("long").alias("lo"), alter.alias("alter"))
    known = spark.createDataFrame([(k,) for k in taken], "n int").select(face(F.when(F.col("n") > 0, F.col("n") + 2)).alias("id"))
    level = graphtables.new_elements(known.withColumn("prop", F.lit("x")))
    rows = spark.range(100_000).select(face(F.lit(None).cast("int")).alias("id"), F.lit("y").alias("prop"), (-F.col("id")).alias("seq"))
    before = time.monotonic()
    got = [n.alter for n in graphtables.unique_ids(level, rows, "face").orderBy("seq").select("id.alter").collect()]
    assert time.monotonic() - before < 60
    used, free = set(taken), itertools.count()
    assert got == [n + 2 for n in itertools.islice((n for n in free if n not in used), 100_000)]


def test_many_links_of_one_element(spark):
    """Links are a set, however many an element has, in a time that doesn't grow with their square."""
    face = F.struct(F.col("k").alias("hi"), F.lit(1).cast("long").alias("lo"), F.lit(None).cast("int").alias("alter"))
    some = lambda a, b: spark.range(a, b).withColumnRenamed("id", "k").select(F.lit(1).cast("long").alias("id"), face.alias("other"))
    before = time.monotonic()
    level = graphtables.connect(graphtables.empty_graph(spark)["grain"], some(0, 90_000))
    level = graphtables.connect(level, some(60_000, 150_000).unionByName(some(60_000, 70_000)).unionByName(spark.sql("select 2L as id, null as other")))
    got = {r.id: r for r in level.select("id", "prop", F.size("conn").alias("n"), F.transform("conn", lambda c: c["hi"]).alias("hi")).collect()}
    assert time.monotonic() - before < 60
    assert got.keys() == {1, 2} and got[1].hi == list(range(150_000)) and got[2].n == 0 and got[1].prop is None


def test_edges_of_matrices(spark):
    with pytest.raises(Exception, match="outside"):
        matrix.at(matrix.identity(spark, 2), spark.createDataFrame([(2, 0)], "i int, j int"), (2, 2)).collect()
    for wrong in (matrix.zero, matrix.one):
        with pytest.raises(ValueError):
            wrong()
    cells, box = sparse.singleton(spark, (1, 2, 3), 7)
    assert sparse.lookup(cells, spark.createDataFrame([(1, 2, 3)], "x int, y int, z int")).first().value == 7 and box.size == 1
    assert sparse.empty(spark, (0, 0, 0))[0].count() == 0


def test_a_label_column_is_replaced(spark):
    grid = grids.from_values(spark, BoxMeta((2, 2, 1)), [1, 1, 0, 0]).withColumn("label", F.lit("old"))
    assert labels_of(grains.find_grains(grid)) == [0, 0, 2, 2]


def test_tables_are_taken_away(spark):
    table = shared.materialise(spark.range(3), "some")
    assert table.count() == 3
    shared.discard(table)
    with pytest.raises(Exception, match="(?i)exist"):
        spark.read.parquet(table._table_path)
