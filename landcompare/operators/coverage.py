"""Zones as a coverage: snapped edges, borders, and zones dissolved into larger ones.

Coordinates are snapped to a grid and counted in its steps, so edges of neighbours are equal
as whole numbers. Every ring runs with its polygon on the left; an edge that occurs in both
directions within a group is inner and goes, the others are the group's outline. Borders
have to meet in the same vertices after snapping, and polygons of one group must not overlap.

The outline is put together without taking a ring into one task. Each edge knows the next
one. Edges are dealt by squares; within a chunk of these, rings that lie there are finished and
of the others chains are made (``rings``). A chain's ring and place come from list ranking by
pointer doubling, in rounds that grow with the logarithm of the chains in a ring. Where several edges leave a vertex the leftmost
turn follows, which keeps pieces apart that only touch; a ring that then passes a vertex
twice is cut there, and ranked again. Holes need no search for their shell: pieces are
the connected components of polygons over inner edges, and a piece has one shell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landcompare.functions.geometry import let, ring_area
from landcompare.operators.components import connected_components
from landcompare.operators.rings import CHAINS, CHUNK, chains, chunks
from landcompare.sources.shared import stored

GRID = 0.0001
EDGE = ["x1", "y1", "x2", "y2"]


class Overlap(ValueError):
    """Polygons of one group overlap, so they have no common outline."""


# Edges


def snap(ring: Column, grid: float = GRID) -> Column:
    """The ring in whole steps of the grid, array<struct<x:bigint,y:bigint>>, repeated points once; points halfway go to the even step."""
    points = F.transform(ring, lambda p: F.struct(F.rint(p["x"] / grid).cast("bigint").alias("x"), F.rint(p["y"] / grid).cast("bigint").alias("y")))
    fresh = let(points, lambda all_: F.filter(all_, lambda p, k: (k == 0) | (F.get(all_, k - 1) != p)))
    return let(fresh, lambda kept: F.when(F.size(kept) > 3, kept).otherwise(F.array().cast("array<struct<x:bigint,y:bigint>>")))


def edges(zones: DataFrame, grid: float = GRID) -> DataFrame:
    """(zone, polygon, x1, y1, x2, y2) of (zone, geometry): every directed edge, its polygon on the left. Rings that snap to a line vanish."""
    # Outer, as Spark would filter by an inner one's array further down, and compute geometries there as well.
    polygons = zones.select("zone", F.posexplode_outer("geometry").alias("polygon", "rings")).where("polygon IS NOT NULL")
    rings = polygons.select("zone", "polygon", F.posexplode("rings").alias("place", "ring")).withColumn("ring", snap(F.col("ring"), grid))
    along = F.when((ring_area(_plain(F.col("ring"))) > 0) == (F.col("place") == 0), F.col("ring")).otherwise(F.reverse("ring"))
    rings = rings.select("zone", "polygon", along.alias("ring"))
    pairs = F.transform(
        F.slice("ring", 2, F.greatest(F.size("ring"), F.lit(1))),
        lambda p, k: F.struct(F.get("ring", k)["x"].alias("x1"), F.get("ring", k)["y"].alias("y1"), p["x"].alias("x2"), p["y"].alias("y2")),
    )
    return rings.select("zone", "polygon", F.inline(pairs))


def _plain(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))


def _undirected() -> list[Column]:
    """The edge from its smaller end, and whether it ran that way."""
    swap = (F.col("x1") > F.col("x2")) | (F.col("x1") == F.col("x2")) & (F.col("y1") > F.col("y2"))
    ends = [F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))]
    return [*ends, F.when(swap, -1).otherwise(1).alias("way")]


def borders(zones: DataFrame, grid: float = GRID) -> DataFrame:
    """(zone, neighbour, n_edges, length): each pair of zones that share edges, once, the smaller first; length on the plane.

    ``zones`` has (zone, geometry). An edge that more than two zones claim counts for each pair of them.
    """
    lines = edges(zones, grid).select("zone", *_undirected())
    # Few zones meet in an edge, so the array is short.
    held = lines.groupBy(*EDGE).agg(F.sort_array(F.collect_set("zone")).alias("zones")).where(F.size("zones") > 1)
    pairs = F.flatten(
        F.transform("zones", lambda a, k: F.transform(F.slice("zones", k + 2, F.size("zones")), lambda b: F.struct(a.alias("zone"), b.alias("neighbour"))))
    )
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2)) * grid
    found = held.select(*EDGE, F.inline(pairs)).withColumn("length", length)
    return found.groupBy("zone", "neighbour").agg(F.count("*").alias("n_edges"), F.sum("length").alias("length"))


# Rings


def ranked(following: DataFrame) -> DataFrame:
    """(id, ring, steps) of (id, following), a permutation: the cycle's least id, and how many steps lead to it.

    Windows of 1, 2, 4, ... successors are joined until no least id changes; then every window holds its whole cycle.
    """
    state, reach = stored(following.select("id", F.col("following").alias("jump"), F.col("id").alias("ring"), F.lit(0).cast("bigint").alias("steps")), "rings"), 1
    while True:
        ahead = state.select(F.col("id").alias("jump"), F.col("jump").alias("next"), F.col("ring").alias("ahead"), F.col("steps").alias("more"))
        nearer = F.col("ring") <= F.col("ahead")
        moved = state.join(ahead, "jump").select(
            "id",
            F.col("next").alias("jump"),
            F.least("ring", "ahead").alias("ring"),
            F.when(nearer, F.col("steps")).otherwise(F.col("more") + reach).alias("steps"),
            (~nearer).alias("moved"),
        )
        moved = stored(moved, "rings")
        state, reach = moved.drop("moved"), reach * 2
        if not moved.where("moved").take(1):
            return state.select("id", "ring", "steps")


CELL = 128  # times the median length of edges is the side of the squares that are kept together
ENDS = "owner BIGINT, row BIGINT, column BIGINT, x BIGINT, y BIGINT, leaves BOOLEAN, id BIGINT, part BIGINT, dx BIGINT, dy BIGINT, following BIGINT"


def _contracted(outline: DataFrame, side: int, cut: bool) -> DataFrame:
    """Chains of outline edges (owner, id, part, x1, y1, dx, dy, and following where it is known): CHAINS, and a row for each link between chains.

    Both ends of every edge go to the square they lie in, where vertices are whole, so any number of vertices makes a chunk. Rings within a
    chunk are finished there; of the others the chunk has chains, whose ``ring`` is the last edge, with ``back`` to it. An edge that ends in
    another chunk has its following one in a row without a ``ring``.
    """
    begin = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(True).alias("leaves"))
    end = F.struct((F.col("x1") + F.col("dx")).alias("x"), (F.col("y1") + F.col("dy")).alias("y"), F.lit(False).alias("leaves"))
    ends = outline.select("*", F.inline(F.array(begin, end)))
    ends = ends.withColumns({"row": F.floor(F.col("y") / side).cast("bigint"), "column": F.floor(F.col("x") / side).cast("bigint")})
    ends = ends.select(*(c.split()[0] for c in ENDS.split(", ")))

    most = CHUNK

    def run(batches):
        for ends in chunks(batches, most):
            yield chains(ends, cut)

    # A square's vertices stay together even where a chunk is full, as rows are sorted by them.
    return ends.repartition("owner", "row", "column").sortWithinPartitions("owner", "row", "column", "x", "y").mapInArrow(run, CHAINS)


def assemble(outline: DataFrame, side: int) -> DataFrame:
    """(owner, ring, id, place, x1, y1, part) of outline edges (owner, id, part, x1, y1, dx, dy): simple rings, sorted by place."""
    parts = stored(_contracted(outline.withColumn("following", F.lit(None).cast("bigint")), side, True), "chains")
    found, open_ = _finished(parts)
    if open_ is None:
        return found
    # Passes of one ring through one vertex: the edge into a pass goes on where the pass before left.
    visit = Window.partitionBy("owner", "ring", "x1", "y1")
    passes = open_.groupBy("owner", "ring", "x1", "y1").agg(F.count("*").alias("passes")).where("passes > 1").drop("passes")
    again = open_.join(passes, ["owner", "ring", "x1", "y1"]).select(
        "ring", F.col("id").alias("following"), F.coalesce(F.lag("id").over(visit.orderBy("place")), F.max_by("id", "place").over(visit)).alias("instead")
    )
    again = stored(again, "cut-rings")
    if not again.take(1):
        return found.unionByName(open_.select(found.columns))
    rings = again.select("ring").distinct()
    cut = open_.join(rings, "ring", "left_semi").join(again.drop("ring"), "following", "left")
    cut = cut.select("owner", "id", "part", "x1", "y1", "dx", "dy", F.coalesce("instead", "following").alias("following"))
    rest = open_.join(rings, "ring", "left_anti")
    closed, long = _finished(stored(_contracted(cut, side, False), "cut-chains"))
    whole = found.unionByName(rest.select(found.columns)).unionByName(closed)
    return whole if long is None else whole.unionByName(long.select(found.columns))


def _finished(chains: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rings that lie within chunks, and, where there are any, those that are put together of chains."""
    kept = ["owner", "ring", "id", F.struct("behind", "back", F.lit(0).cast("bigint").alias("within")).alias("place"), "x1", "y1", "part"]
    closed = chains.where("closed").select(*kept)
    links = chains.where("ring IS NULL").select("id", "following")
    if not links.take(1):
        return closed, None
    parts = chains.where("ring IS NOT NULL AND NOT closed")
    starts = parts.select(F.col("id").alias("following"), F.col("ring").alias("next"))
    order = ranked(links.join(starts, "following").select("id", F.col("next").alias("following")))
    order = order.select(F.col("id").alias("chain"), F.col("ring").alias("whole"), "steps")
    parts = parts.withColumnRenamed("ring", "chain").join(order, "chain").join(links.withColumnsRenamed({"following": "beyond"}), "id", "left")
    place = F.struct((F.col("steps") > 0).alias("behind"), (-F.col("steps")).alias("back"), F.col("back").alias("within"))
    following = F.coalesce("following", "beyond").alias("following")
    return closed, stored(parts.select("owner", F.col("whole").alias("ring"), "id", place.alias("place"), "x1", "y1", "part", "dx", "dy", following), "placed")


def dissolve(zones: DataFrame, grid: float = GRID) -> DataFrame:
    """(group, geometry, n_edges, n_pieces): the union of each group's zones, from (zone, group, geometry).

    Shells run against the clock, holes with it, each from its smallest vertex; touching holes are apart, and so are pieces that only
    touch. Zones whose geometry is NULL or empty add nothing; groups without any edge have no row; a NULL group is one of its own.
    Raises ``Overlap`` where polygons of a group overlap along an edge.
    """
    parts = zones.select(F.monotonically_increasing_id().alias("zone"), "group", "geometry")
    parts = stored(parts.withColumn("group", F.to_json(F.struct("group"))), "dissolve-zones")
    lines = edges(parts.select(F.struct("zone", "group").alias("zone"), "geometry"), grid)
    lines = lines.select("zone.group", F.xxhash64("zone.zone", "polygon").alias("part"), *_undirected())
    met = lines.groupBy("group", *EDGE).agg(F.sum("way").alias("way"), F.min("part").alias("part"), F.max("part").alias("other"), F.count("*").alias("claims"))
    met = stored(met.withColumn("id", F.monotonically_increasing_id()), "dissolve-edges")
    length = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))
    over, median = met.agg(F.count_if(F.abs("way") > 1), F.percentile_approx(length, 0.5)).first()
    if over:
        raise Overlap(f"{over} edges belong to several polygons of one group on the same side")
    back = F.col("way") < 0
    ends = [F.when(back, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))]
    outline = met.where("way <> 0").select(F.xxhash64("group").alias("owner"), "id", "part", *ends)
    outline = outline.select("owner", "id", "part", "x1", "y1", (F.col("x2") - F.col("x1")).alias("dx"), (F.col("y2") - F.col("y1")).alias("dy"))
    names = parts.groupBy("group").agg(F.xxhash64("group").alias("owner"))
    pieces = connected_components(met.where("claims > 1").select(F.col("part").alias("a"), F.col("other").alias("b")))
    rings = assemble(outline, CELL * max(1, median or 1)).groupBy("owner", "ring").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "x1", "y1"))), lambda p: F.struct(p["x1"].alias("x"), p["y1"].alias("y"))).alias("points"),
        F.min("part").alias("node"),
    )
    first = F.array_position("points", F.array_min("points")).cast("int")
    turned = F.concat(F.slice("points", first, F.size("points")), F.slice("points", 1, first))  # closed by its first point
    rings = rings.join(pieces, "node", "left").select("owner", F.coalesce("component", "node").alias("piece"), turned.alias("points"))
    rings = rings.withColumn("hole", ring_area(_plain(F.col("points"))) < 0)
    scaled = F.transform("points", lambda p: F.struct((p["x"] * grid).alias("x"), (p["y"] * grid).alias("y")))
    rings = rings.select("owner", "piece", "hole", F.col("points")[0].alias("start"), (F.size("points") - 1).alias("n"), scaled.alias("points"))
    piece = F.sort_array(F.collect_list(F.struct("hole", "start", "points")))
    polygons = rings.groupBy("owner", "piece").agg(F.transform(piece, lambda r: r["points"]).alias("rings"), F.sum("n").alias("n"))
    whole = F.sort_array(F.collect_list("rings"))
    found = polygons.groupBy("owner").agg(whole.alias("geometry"), F.sum("n").alias("n_edges"), F.count("*").alias("n_pieces")).join(names, "owner")
    kind = zones.schema["group"].dataType.simpleString()
    return found.select(F.from_json("group", f"group {kind}")["group"].alias("group"), "geometry", "n_edges", "n_pieces")


# Areas that are stored


def off_areas(zones: DataFrame, computed: Column, stored_area: Column, tolerance: float = 0.01) -> DataFrame:
    """(zone, stored, computed): zones whose stored area is missing, not above zero, or differs from that of their geometry by more than a share.

    Zones without a readable geometry count as off too.
    """
    # Spark pushes no filter past the number of a row, so areas are computed once, and where the rows are.
    found = zones.select("zone", stored_area.cast("double").alias("stored"), computed.alias("computed"), F.monotonically_increasing_id().alias("number"))
    near = F.abs(F.col("stored") - F.col("computed")) <= F.col("computed") * tolerance
    return found.where(~F.coalesce((F.col("stored") > 0) & near, F.lit(False)) & (F.col("number") >= 0)).drop("number")


# Zones of points


def cover(zones: DataFrame, cell: float, grid: float = GRID) -> DataFrame:
    """(zone, row, column, border, lines): the cells of a grid that a zone touches, from (zone, geometry).

    A cell without a border lies inside as a whole and has no lines; a border cell has the zone's edges in its row, horizontal ones
    excepted, each from its smaller end, so that both neighbours of an edge compute the same crossings.
    """
    step = round(cell / grid)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    found = edges(zones, grid).select("zone", *_undirected()).drop("way")
    found = found.select("*", F.explode(F.sequence(_cell(low, step), _cell(high, step))).alias("row"))
    # What the edge spans within the row.
    bottom, top = F.greatest(F.col("row") * step, low), F.least((F.col("row") + 1) * step, high)
    ends = F.when(F.col("y1") == F.col("y2"), F.array(F.col("x1").cast("double"), F.col("x2").cast("double"))).otherwise(F.array(_crossing(bottom), _crossing(top)))
    found = stored(found.withColumn("ends", ends), "cover-lines")
    strips = found.where("y1 <> y2").groupBy("zone", "row").agg(F.collect_list(F.struct(*EDGE)).alias("lines"))
    # A step more at both sides, against the last bit of a crossing.
    columns = F.sequence(_cell(F.floor(F.array_min("ends")) - 1, step), _cell(F.ceil(F.array_max("ends")) + 1, step))
    border = stored(found.select("zone", "row", F.explode(columns).alias("column")).distinct(), "cover-border")
    spans = border.groupBy("zone", "row").agg(F.sequence(F.min("column"), F.max("column")).alias("columns"))
    inner = spans.select("zone", "row", F.explode("columns").alias("column")).join(border, ["zone", "row", "column"], "left_anti")
    middle = [((F.col(c) + 0.5) * step) for c in ("column", "row")]
    inner = inner.join(strips, ["zone", "row"]).where(_inside("lines", *middle)).withColumns({"border": F.lit(False), "lines": F.lit(None).cast(LINES)})
    outer = border.join(strips, ["zone", "row"], "left").withColumn("border", F.lit(True))
    return inner.select("zone", "row", "column", "border", "lines").unionByName(outer.select("zone", "row", "column", "border", "lines"))


CROWDED = 100_000  # points of a cell that one task takes
UNHASHED = ("map<", "variant")

LINES = "array<struct<x1:bigint,y1:bigint,x2:bigint,y2:bigint>>"


def _cell(at: Column, step: int) -> Column:
    return F.floor(at / step).cast("bigint")


def _crossing(y: Column, line: Column | None = None) -> Column:
    """Where an edge that isn't horizontal has that height."""
    x1, y1, x2, y2 = (F.col(c) if line is None else line[c] for c in EDGE)
    return x1 + (x2 - x1) * ((y - y1) / F.nullif(y2 - y1, F.lit(0)))


def _inside(lines: str, x: Column, y: Column) -> Column:
    """Whether a ray to the right crosses an odd number of edges."""
    crossed = F.filter(lines, lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < _crossing(y, e)))
    return F.size(crossed) % 2 == 1


def zones_of_points(points: DataFrame, cells: DataFrame, cell: float, grid: float = GRID, salts: int = 8) -> DataFrame:
    """The rows of ``points`` (with x and y) and the ``zone`` each lies in, NULL if it lies in none, from the ``cover`` of the same cell size.

    An equal join by cells; edges are looked at in border cells only. Of two zones with a common border the one to its right or
    above it has the points on it. Points of a crowded cell are dealt over ``salts`` tasks, or one per ``CROWDED`` points if these are
    more, for which that cell's few rows are copied; the other cells' rows stay single. Overlapping zones give a point a row each; a
    point without both coordinates lies in none.
    """
    step = round(cell / grid)
    x, y = (F.col(f"row.{c}").cast("double") / grid for c in ("x", "y"))
    rows = points.select(F.struct("*").alias("row")).withColumns({"px": x, "py": y})
    rows = rows.select("row", "px", "py", _cell(F.col("py"), step).alias("py_row"), _cell(F.col("px"), step).alias("px_column"))
    # At most one cell per CROWDED points, so few rows to broadcast.
    crowds = rows.groupBy("py_row", "px_column").count().where((F.col("count") > CROWDED) & F.col("py_row").isNotNull() & F.col("px_column").isNotNull())
    crowds = crowds.select(F.col("py_row").alias("crowd_row"), F.col("px_column").alias("crowd_column"), F.greatest(F.lit(salts), F.ceil(F.col("count") / CROWDED)).alias("parts"))
    crowds = F.broadcast(stored(crowds, "crowds"))
    # Points at one place differ in other columns, as far as these can be hashed.
    told = [f"row.`{f.name}`" for f in points.schema if not any(kind in f.dataType.simpleString() for kind in UNHASHED)]
    some = F.xxhash64(*told)
    rows = rows.join(crowds, (F.col("py_row") == F.col("crowd_row")) & (F.col("px_column") == F.col("crowd_column")), "left")
    nowhere = F.col("py_row").isNull() | F.col("px_column").isNull()
    rows = rows.select("row", "px", "py", "py_row", "px_column", F.pmod(some, F.when(nowhere, salts).otherwise(F.coalesce("parts", F.lit(1)))).alias("dealt"))
    copies = cells.withColumnsRenamed({"row": "cell_row", "column": "cell_column"})
    copies = copies.join(crowds, (F.col("cell_row") == F.col("crowd_row")) & (F.col("cell_column") == F.col("crowd_column")), "left")
    copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("crowd_row", "crowd_column", "parts")
    same = (F.col("py_row") == F.col("cell_row")) & (F.col("px_column") == F.col("cell_column")) & (F.col("dealt") == F.col("salt"))
    within = ~F.col("border") | F.coalesce(_inside("lines", F.col("px"), F.col("py")), F.lit(False))
    return rows.join(copies, same & within, "left").select("row.*", "zone")
