"""Polygons against plain Python: bytes, areas, outlines, borders and places, over random maps."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from landcompare.functions import geometry as G
from landcompare.operators import coverage as C

SHAPES = f"zone BIGINT, `group` STRING, geometry {G.GEOMETRY}"


def wkb(polygons, order="<", srid=None, single=False):
    mark = b"\x01" if order == "<" else b"\x00"

    def polygon(rings, flag=False):
        head = mark + struct.pack(order + "I", 3 | (0x20000000 if flag else 0)) + (struct.pack(order + "I", srid) if flag else b"")
        return head + struct.pack(order + "I", len(rings)) + b"".join(struct.pack(order + "I", len(r)) + b"".join(struct.pack(order + "dd", *p) for p in r) for r in rings)

    if single:
        return polygon(polygons[0], srid is not None)
    head = mark + struct.pack(order + "I", 6 | (0x20000000 if srid else 0)) + (struct.pack(order + "I", srid) if srid else b"")
    return head + struct.pack(order + "I", len(polygons)) + b"".join(map(polygon, polygons))


def plain(geometry):
    return None if geometry is None else [[[tuple(p) for p in ring] for ring in polygon] for polygon in geometry]


def any_double(own):
    return own.choice([own.uniform(-180, 180), 0.0, 5e-324, -(2.0**-1022), 1.7976931348623157e308, -1 / 3, 2.0 ** own.randint(-1074, 1023), own.random() * 2.0 ** own.randint(-1060, 1000), 1 - 2.0**-53])


def test_bytes_both_ways(spark):
    own, rows = random.Random(1), []
    for k in range(120):
        shape = [[[(any_double(own), any_double(own)) for _ in range(own.randrange(6))] for _ in range(own.randrange(4))] for _ in range(1 if k % 3 == 0 else own.randrange(4))]
        data = wkb(shape, own.choice("<>"), own.choice([None, 4326, 1]), single=k % 3 == 0)
        rows.append((k, data, shape))
    frame = spark.createDataFrame([r[:2] for r in rows], "k INT, wkb BINARY").select("k", G.read_wkb(F.col("wkb")).alias("g"))
    found = {r.k: (plain(r.g), bytes(r.back)) for r in frame.select("*", G.write_wkb(F.col("g")).alias("back")).collect()}
    for k, _, shape in rows:
        assert found[k] == (shape, wkb(shape, ">")), k


def test_bad_bytes_are_null(spark):
    square = [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]]
    good = wkb(square)
    bad = [None, b"", b"\x01", good[:-1], good + b"\x00", b"\x02" + good[1:], good[:1] + b"\x01" + good[2:], good[:5] + b"\xff" * 4 + good[9:], good[:1] + b"\xeb\x03\x00\x00" + good[5:]]
    bad += [good[:k] for k in range(2, len(good), 7)]
    bad += [wkb([[[(x, 0.0)]]]) for x in (math.nan, math.inf, -math.inf)]
    bad += [wkb(square, ">")[:18] + b"\x7f\xff\xff\xff", b"\x00" * 40, b"\xff" * 40]
    frame = spark.createDataFrame([(k, b) for k, b in enumerate(bad)], "k INT, wkb BINARY")
    assert [r.k for r in frame.where(G.read_wkb(F.col("wkb")).isNotNull()).collect()] == []
    shapes = spark.createDataFrame([(1, "a", None), (2, "a", [[[(math.nan, 0.0)]]]), (3, "a", [[[(math.inf, 0.0)]]]), (4, "a", [[[(None, 0.0)]]])], SHAPES)
    assert {r[0] for r in shapes.select(G.write_wkb(F.col("geometry"))).collect()} == {None}


def test_areas(spark):
    own, rows = random.Random(2), []
    for k in range(40):
        n, size, hole = own.randint(3, 30), own.uniform(1, 5), own.uniform(0, 0.9)
        ring = [(3 + size * math.cos(2 * math.pi * i / n), -7 + size * math.sin(2 * math.pi * i / n)) for i in range(n)]
        inner = [(3 + hole * (x - 3), -7 + hole * (y + 7)) for x, y in ring]
        ring, inner = [*ring, ring[0]], [*inner, inner[0]][:: own.choice([1, -1])]
        rows.append((k, "x", [[ring[:: own.choice([1, -1])], inner], [ring]]))
        rows[-1] += (n / 2 * size * size * math.sin(2 * math.pi / n) * (2 - hole * hole),)
    # An octant of the sphere, a lune, a cap's polygon of many sides, and nothing.
    octant = [[[(0.0, 0.0), (90.0, 0.0), (90.0, 90.0), (0.0, 90.0), (0.0, 0.0)]]]
    frame = spark.createDataFrame([r[:3] for r in rows] + [(100, "x", octant), (101, "x", []), (102, "x", [[]])], SHAPES)
    found = {r.zone: r for r in frame.select("zone", G.area(F.col("geometry")).alias("a"), G.area(F.col("geometry"), G.ring_excess).alias("e"), G.acres(F.col("geometry")).alias("acres")).collect()}
    for k, _, _, want in rows:
        assert found[k].a == pytest.approx(want)
    assert found[100].e == pytest.approx(math.pi / 2) and found[100].acres == pytest.approx(4 * math.pi * G.EARTH**2 / 8 / G.ACRE)
    assert found[101].a == found[102].a == 0
    small = [(10.0, 50.0), (10.01, 50.0), (10.01, 50.01), (10.0, 50.01), (10.0, 50.0)]
    frame = spark.createDataFrame([(1, "x", [[small]])], SHAPES)
    flat = math.radians(0.01) ** 2 * math.cos(math.radians(50.005)) * G.EARTH**2 / G.ACRE
    assert frame.select(G.acres(F.col("geometry"))).first()[0] == pytest.approx(flat, rel=1e-6)


# Maps of cells


def cell_ring(x, y, own=None):
    jitter = (lambda: own.uniform(-0.4, 0.4)) if own else (lambda: 0)
    corners = [(x + jitter() * C.GRID, y + jitter() * C.GRID) for x, y in ((x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1))]
    return [*map(lambda p: (float(p[0]), float(p[1])), corners), tuple(map(float, corners[0]))]


def random_map(own, side, groups, holes=True):
    """Zones of one cell each, some with a lake, in groups; cells left out."""
    rows, lakes = [], set()
    for x in range(side):
        for y in range(side):
            if own.random() < 0.15:
                continue
            shape = [cell_ring(x, y, own)]
            if holes and own.random() < 0.2:
                lakes.add((x, y))
                shape.append([(x + 0.25, y + 0.25), (x + 0.25, y + 0.75), (x + 0.75, y + 0.75), (x + 0.25, y + 0.25)])
            rows.append((len(rows), own.choice(groups), [shape[0][:: own.choice([1, -1])], *shape[1:]], x, y))
    return [(z, g, [s]) for z, g, s, _, _ in rows], {(x, y): g for _, g, _, x, y in rows}, lakes


def steps(ring):
    return [(round(x / C.GRID), round(y / C.GRID)) for x, y in ring]


def signed(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:], strict=False)) / 2


def within(point, ring):
    x, y, odd = *point, False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
        if (y1 > y) != (y2 > y) and x < x1 + (x2 - x1) * (y - y1) / (y2 - y1):
            odd = not odd
    return odd


def pieces_of(cells):
    left, found = set(cells), []
    while left:
        todo, piece = [left.pop()], set()
        while todo:
            x, y = todo.pop()
            piece.add((x, y))
            for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if n in left:
                    left.remove(n)
                    todo.append(n)
        found.append(piece)
    return found


@pytest.mark.parametrize("seed", range(2))
def test_dissolve_by_brute_force(spark, seed):
    """Outlines of scattered cells with holes: the right edges, in simple rings, each hole in its shell."""
    own = random.Random(seed)
    zones, cells, lakes = random_map(own, 14, ["a", "b", None])
    zones += [(900, "a", None), (901, "c", None), (902, "c", []), (903, "c", [[[(50.0, 50.0), (51.0, 50.0), (50.00001, 50.0), (50.0, 50.0)]]])]
    found = {r.group: r for r in C.dissolve(spark.createDataFrame(zones, SHAPES)).collect()}
    assert set(found) == {"a", "b", None}
    for group, row in found.items():
        mine = {c for c, g in cells.items() if g == group}
        want, area = {}, 0
        for x, y in mine:
            ring = [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y)]
            for p, q in zip(ring, ring[1:], strict=False):
                p, q = (tuple(round(v / C.GRID) for v in e) for e in (p, q))
                if (q, p) in want:
                    del want[q, p]
                else:
                    want[p, q] = (x, y)
            area += 1 - (0.125 if (x, y) in lakes else 0)
            if (x, y) in lakes:
                hole = steps([(x + 0.25, y + 0.25), (x + 0.25, y + 0.75), (x + 0.75, y + 0.75), (x + 0.25, y + 0.25)])
                want |= {e: (x, y) for e in zip(hole, hole[1:], strict=False)}
        shape = [[steps(r) for r in polygon] for polygon in plain(row.geometry)]
        edges = [e for polygon in shape for ring in polygon for e in zip(ring, ring[1:], strict=False)]
        assert sorted(edges) == sorted(want) and row.n_edges == len(want)
        pieces = pieces_of(mine)
        assert len(shape) == row.n_pieces == len(pieces)
        for polygon in shape:
            assert signed(polygon[0]) > 0 and all(signed(r) < 0 for r in polygon[1:])
            assert all(ring[0] == ring[-1] == min(ring) and len(set(ring)) == len(ring) - 1 for ring in polygon)
            owners = {want[e] for ring in polygon for e in zip(ring, ring[1:], strict=False)}
            assert len([p for p in pieces if owners & p]) == 1
            for hole in polygon[1:]:
                middle = (hole[0][0] + hole[1][0] + 0.1) / 2, (hole[0][1] + hole[1][1] + 0.1) / 2
                assert within(middle, polygon[0])
        assert sum(signed(r) for polygon in shape for r in polygon) * C.GRID**2 == pytest.approx(area)


def test_overlapping_zones_have_no_outline(spark):
    zones = [(1, "a", [[cell_ring(0, 0)]]), (2, "a", [[cell_ring(0, 0)]]), (3, "b", [[cell_ring(0, 0)]])]
    with pytest.raises(C.Overlap):
        C.dissolve(spark.createDataFrame(zones, SHAPES))
    assert C.dissolve(spark.createDataFrame(zones[1:], SHAPES)).count() == 2
    assert C.dissolve(spark.createDataFrame([], SHAPES)).count() == 0


def test_long_rings_in_few_rounds(spark, monkeypatch):
    n, rounds = 20_000, []
    stored = C.stored
    monkeypatch.setattr(C, "stored", lambda f, name: rounds.append(name) or stored(f, name))
    own = random.Random(3)
    ids = list(range(n))
    own.shuffle(ids)
    cut = [0, 1, 3, 10, 5000, n]
    following = [(ids[k], ids[k + 1 if k + 1 < e else s]) for s, e in zip(cut, cut[1:], strict=False) for k in range(s, e)]
    found = {r.id: (r.ring, r.steps) for r in C.ranked(spark.createDataFrame(following, "id BIGINT, following BIGINT")).collect()}
    assert len(rounds) <= 20
    for s, e in zip(cut, cut[1:], strict=False):
        ring = ids[s:e]
        least = min(ring)
        at = ring.index(least)
        assert all(found[i] == (least, (at - k) % len(ring)) for k, i in enumerate(ring))


def test_borders_by_brute_force(spark):
    own = random.Random(5)
    zones, cells, _ = random_map(own, 9, ["x"])
    names = {}
    for k, c in enumerate(cells):
        names[c] = own.randrange(12)
        zones[k] = (names[c], "x", zones[k][2])
    want = {}
    for x, y in cells:
        for n in ((x + 1, y), (x, y + 1)):
            if n in cells and names[n] != names[x, y]:
                pair = tuple(sorted((names[x, y], names[n])))
                want[pair] = want.get(pair, 0) + 1
    found = C.borders(spark.createDataFrame(zones, SHAPES)).collect()
    assert {(r.zone, r.neighbour): (r.n_edges, round(r.length, 6)) for r in found} == {p: (n, float(n)) for p, n in want.items()}
    assert C.borders(spark.createDataFrame([], SHAPES)).count() == 0


def star(own, x, y, reach):
    n = own.randint(3, 12)
    angles = sorted(own.uniform(0, 2 * math.pi) for _ in range(n))
    ring = [(round(x + own.uniform(0.3, 1) * reach * math.cos(t), 3), round(y + own.uniform(0.3, 1) * reach * math.sin(t), 3)) for t in angles]
    return [*ring, ring[0]]


@pytest.mark.parametrize("cell", [0.3, 1.7, 40.0])
def test_zones_of_points_by_brute_force(spark, cell):
    """Random stars apart from each other, with holes, larger and smaller than the cells; most points in one crowded place."""
    own, zones = random.Random(7), []
    for k in range(25):
        x, y = 8.0 * (k % 5), 8.0 * (k // 5) - 20
        shell = star(own, x, y, 3.9)
        hole = [(round(x + (px - x) * 0.5, 3), round(y + (py - y) * 0.5, 3)) for px, py in shell]
        zones.append((k, "x", [[shell, hole] if k % 3 == 0 else [shell]]))
    zones.append((77, "x", None))
    points = [(i, own.uniform(-6, 40), own.uniform(-26, 20)) for i in range(1500)] + [(2000 + i, own.uniform(0, 1), own.uniform(-20, -19)) for i in range(1500)]
    points += [(5000 + i, px, py) for i, (px, py) in enumerate(zones[4][2][0][0])] + [(6000, None, 1.0), (6001, 1.0, None), (6002, 1e9, -1e9)]
    cells = C.cover(spark.createDataFrame(zones, SHAPES), cell)
    frame = spark.createDataFrame(points, "id INT, x DOUBLE, y DOUBLE").withColumn("lines", F.lit("clashes")).withColumn("row", F.lit(1))
    found = C.zones_of_points(frame, cells, cell)
    assert found.columns == [*frame.columns, "zone"]
    got = {r.id: r.zone for r in found.collect()}
    assert found.count() == len(points)
    for i, x, y in points:
        want = [z for z, _, g in zones if g and x is not None and y is not None and sum(within((x / C.GRID, y / C.GRID), steps(r)) for r in g[0]) % 2]
        assert got[i] == (want[0] if want else None), (i, x, y)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_points_on_borders_have_one_zone(spark):
    zones = [(k, "x", [[cell_ring(k % 4, k // 4)]]) for k in range(16)]
    points = [(i, x / 2, y / 2) for i, (x, y) in enumerate((x, y) for x in range(8) for y in range(8))]
    found = C.zones_of_points(spark.createDataFrame(points, "id INT, x DOUBLE, y DOUBLE"), C.cover(spark.createDataFrame(zones, SHAPES), 0.7), 0.7).collect()
    assert {r.id: r.zone for r in found} == {i: int(x) + 4 * int(y) for i, x, y in points} and len(found) == 64


def test_off_areas(spark):
    square = [[cell_ring(0, 0)]]
    rows = [(1, square, 1.0), (2, square, 1.02), (3, square, None), (4, square, -1.0), (5, None, 1.0), (6, square, 0.995), (7, square, math.nan), (8, [], 0.0)]
    frame = spark.createDataFrame(rows, f"zone INT, geometry {G.GEOMETRY}, acres DOUBLE")
    assert sorted(r.zone for r in C.off_areas(frame, G.area(F.col("geometry")), F.col("acres")).collect()) == [2, 3, 4, 5, 7, 8]


def test_snapped_edges_cancel_only_within_a_group(spark):
    """Two halves of a square in two groups keep their common border, in opposite directions."""
    halves = [(1, "a", [[[(0.0, 0.0), (0.5, 0.0), (0.5, 1.0), (0.0, 1.0), (0.0, 0.0)]]]), (2, "b", [[[(0.50001, 0.0), (1.0, 0.0), (1.0, 1.0), (0.49999, 1.0), (0.50001, 0.0)]]])]
    found = {}
    for r in C.edges(spark.createDataFrame(halves, SHAPES)).collect():
        found.setdefault(r.zone, set()).add((r.x1, r.y1, r.x2, r.y2))
    assert {(c, d, a, b) for a, b, c, d in found[1]} & found[2] == {(5000, 10000, 5000, 0)}


def counted(spark, kind):
    """A UDF that gives back its argument, and how often it was called."""
    calls = spark.sparkContext.accumulator(0)

    def same(x):
        calls.add(1)
        return x

    return F.udf(same, kind), calls


def test_geometries_are_computed_once(spark):
    """No filter that Spark infers or pushes down computes them anew."""
    rows = [(k, "x", [[cell_ring(k, 0)]]) for k in range(40)] + [(90, "x", None), (91, "x", [])]
    frame = spark.createDataFrame(rows, SHAPES)
    once, calls = counted(spark, G.GEOMETRY)
    assert len(C.edges(frame.withColumn("geometry", once("geometry"))).collect()) == 160
    assert calls.value == len(rows)
    once, calls = counted(spark, "double")
    areas = spark.createDataFrame([(k, 1.0 if k % 4 else 3.0, 1.0) for k in range(40)] + [(90, None, 1.0)], "zone INT, area DOUBLE, acres DOUBLE")
    found = C.off_areas(areas, once("area"), F.col("acres")).collect()
    assert sorted(r.zone for r in found) == [*range(0, 40, 4), 90] and calls.value == 41


def test_long_ring_has_its_edges(spark):
    n = 3000
    ring = [(round(math.cos(2 * math.pi * k / n) * 50, 4), round(math.sin(2 * math.pi * k / n) * 50, 4)) for k in range(n)]
    ring = [*ring, ring[0]]
    found = C.edges(spark.createDataFrame([(1, "x", [[ring[::-1]]])], SHAPES)).collect()
    assert sorted((r.x1, r.y1, r.x2, r.y2) for r in found) == sorted((*a, *b) for a, b in zip(steps(ring), steps(ring)[1:], strict=False))


def test_small_files_are_dealt_over_tasks(spark, tmp_path):
    from landcompare.sources import testmap

    spark.range(12_000).selectExpr("id AS c_custkey", "CAST(id % 3 AS INT) AS c_nationkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(3).selectExpr("CAST(id AS INT) AS n_nationkey", "CAST(id AS INT) AS n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    zones = testmap.counties(spark, str(tmp_path)).select("zone")
    assert zones.rdd.getNumPartitions() == 3 and zones.distinct().count() == 12_000


def test_only_crowded_cells_are_copied(spark, monkeypatch):
    monkeypatch.setattr(C, "CROWDED", 100, raising=False)
    kept, stored = {}, C.stored
    monkeypatch.setattr(C, "stored", lambda f, name: kept.setdefault(name, stored(f, name)))
    zones = [(k, "x", [[cell_ring(k % 4, k // 4)]]) for k in range(16)]
    points = [(k, 1.25, 1.25) for k in range(2000)] + [(2000 + k, 0.3 + k % 4, 0.3 + k // 4) for k in range(16)] + [(3000 + k, None, 1.0) for k in range(500)]
    frame = spark.createDataFrame(points, "id INT, x DOUBLE, y DOUBLE").withColumn("more", F.create_map(F.lit("a"), F.col("id")))
    found = C.zones_of_points(frame, C.cover(spark.createDataFrame(zones, SHAPES), 0.5), 0.5)
    assert found.columns == frame.columns + ["zone"]
    want = {k: 5 for k in range(2000)} | {2000 + k: k for k in range(16)} | {3000 + k: None for k in range(500)}
    rows = found.collect()
    assert {r.id: r.zone for r in rows} == want and len(rows) == len(points)
    assert [(r.crowd_row, r.crowd_column, r.parts) for r in kept["crowds"].collect()] == [(2, 2, 21)]


@pytest.mark.parametrize(("cell", "chunk"), [(1, 1), (2, 7), (128, 50)])
def test_rings_over_many_chunks(spark, monkeypatch, cell, chunk):
    """Rings that touch themselves, larger than a chunk, come out as from one."""
    own = random.Random(11)
    zones, _, _ = random_map(own, 12, ["a", "b"])
    frame = spark.createDataFrame(zones, SHAPES)
    want = sorted(map(repr, C.dissolve(frame).collect()))
    monkeypatch.setattr(C, "CELL", cell)
    monkeypatch.setattr(C, "CHUNK", chunk)
    assert sorted(map(repr, C.dissolve(frame).collect())) == want


def test_rings_of_a_chunk_need_no_rounds(spark, monkeypatch):
    """A thousand squares: no list ranking over all their edges."""
    names, stored = [], C.stored
    monkeypatch.setattr(C, "stored", lambda f, name: names.append(name) or stored(f, name))
    zones = [(k, "x", [[cell_ring(2 * (k % 32), 2 * (k // 32))]]) for k in range(1000)]
    row = C.dissolve(spark.createDataFrame(zones, SHAPES)).first()
    assert (row.n_pieces, row.n_edges) == (1000, 4000) and "rings" not in names


def test_bytes_are_read_on_arrays(spark):
    """Not digit by digit of their hex text, which took most of the time of queries on geometry."""
    frame = spark.range(1).select(G.read_wkb(F.lit(wkb([[[(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]]]))).alias("g"))
    assert "conv(" not in frame._jdf.queryExecution().optimizedPlan().toString()
    assert G.wkb_module.__name__ in __import__("pyspark.cloudpickle", fromlist=["x"]).list_registry_pickle_by_value()
