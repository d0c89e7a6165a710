"""DuckDB twins of the registered queries, in the plainest form of each: classes
joined with themselves, dimensions joined before sums, one SELECT per dataset."""

from __future__ import annotations

# The logical tables from the given ones.
TABLES = """
WITH o AS (
  SELECT CAST(o_custkey AS VARCHAR) AS atlas_stco, o_orderkey, o_orderstatus, o_orderpriority,
         CAST(o_totalprice AS DECIMAL(18,2)) AS price
  FROM orders
), li AS (
  SELECT o.atlas_stco, l_returnflag, l_linestatus, l_discount,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS price
  FROM lineitem JOIN o ON l_orderkey = o_orderkey
), counties AS (
  SELECT CAST(c_custkey AS VARCHAR) AS atlas_stco, c_name AS atlas_name, r_name AS state_name,
         CAST(r_regionkey AS VARCHAR) AS st_abbrev, 4 * a.price AS acres_calc, hex(encode(c_name)) AS geom
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  JOIN (SELECT atlas_stco, sum(price) AS price FROM o GROUP BY ALL) a
    ON a.atlas_stco = CAST(c_custkey AS VARCHAR)
), county_states AS (
  SELECT atlas_stco, state_name FROM counties
), states AS (
  SELECT r_name AS atlas_name, CAST(r_regionkey AS VARCHAR) AS st_abbrev,
         CAST(sum(acres_calc) AS DOUBLE) AS acres_calc, hex(encode(r_name)) AS geom
  FROM region JOIN counties ON r_name = state_name GROUP BY r_name, r_regionkey
), district_lookup AS (
  SELECT CAST(c_custkey AS VARCHAR) AS fips, CAST(c_nationkey AS VARCHAR) AS district_unique FROM customer
), district_areas AS (
  SELECT district_unique, CAST(sum(acres_calc) AS DOUBLE) AS acres, hex(encode(district_unique)) AS geom
  FROM counties JOIN district_lookup ON atlas_stco = fips GROUP BY district_unique
), study AS (
  SELECT atlas_stco, o_orderstatus AS label, sum(price) AS acres FROM o GROUP BY ALL
), nlcd AS (
  SELECT atlas_stco, l_returnflag AS label, sum(price) AS acres FROM li GROUP BY ALL
), nri AS (
  SELECT li.atlas_stco, st_abbrev,
         CASE WHEN count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND l_discount <= 0.01) > 0
              THEN sum(price) FILTER (WHERE l_returnflag = 'A') END AS expansion
  FROM li JOIN counties ON li.atlas_stco = counties.atlas_stco GROUP BY li.atlas_stco, st_abbrev
), nass AS (
  SELECT atlas_stco,
         CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') > 0
               AND count(*) FILTER (WHERE o_orderstatus = 'P' AND o_orderpriority = '5-LOW') > 0
              THEN sum(price) FILTER (WHERE o_orderstatus = 'F') - sum(price) FILTER (WHERE o_orderstatus = 'O') END AS diff
  FROM o GROUP BY atlas_stco
), study_states AS (
  SELECT state_name AS atlas_name, sum(acres) AS expansion
  FROM study JOIN counties USING (atlas_stco) WHERE label = 'F' GROUP BY state_name
), net AS (
  SELECT g.atlas_stco, g.acres - l.acres AS acres
  FROM (SELECT * FROM study WHERE label = 'F') g JOIN (SELECT * FROM study WHERE label = 'P') l USING (atlas_stco)
)"""

# Per county: relation, amount, condition, years.
_SOURCES = {
    "exp": ("study", "acres", "label = 'F'", 8),
    "net": ("net", "acres", "true", 8),
    "nlcd": ("nlcd", "acres", "label = 'R'", 8),
    "nri": ("nri", "expansion", "expansion IS NOT NULL", 8),
    "nass": ("nass", "diff", "true", 10),
}
_STUDY = {"NRI": "exp", "NLCD": "exp", "NASS": "net"}
_KEYS = {"counties": "atlas_stco", "districts": "district_unique", "states": "atlas_name"}
_MAPS = {
    "counties": {"map1": ("study_share", 1.0), "map2": ("share", 1.0), "map3": ("diff_acres", 0.2)},
    "districts": {
        "map1": ("study_share", 1.0),
        "map2": ("share", 1.0),
        "map3_diff_acres": ("diff_acres", 1.0),
        "map3_diff_ratio": ("diff_ratio", 20.0),
    },
    "states": {"map1": ("study_share", 1.0), "map2": ("share", 1.0), "map3": ("diff_acres", 1.0)},
}
_DRAWN = {
    "counties": ("map2", "map3"),
    "districts": ("map2", "map3_diff_acres"),
    "states": ("map2", "map3"),
}


def _names(source: str) -> tuple[str, str]:
    rate = "acres_study_per_year" if source in ("exp", "net") else "acres_per_year"
    return rate, f"{rate}_per_eu"


def _county(source: str) -> str:
    relation, amount, condition, years = _SOURCES[source]
    rate, share = _names(source)
    columns = [
        "c.atlas_stco",
        "c.atlas_name",
        f"CAST({amount} AS DOUBLE) / {years} AS {rate}",
        f"CAST({amount} AS DOUBLE) / {years} / CAST(c.acres_calc AS DOUBLE) * 100 AS {share}",
    ]
    if source in ("nlcd", "nri"):
        columns.append(f"CAST({amount} AS DOUBLE) AS acres")
    if rate == "acres_per_year":
        columns += ["CAST(c.acres_calc AS DOUBLE) AS acres_calc", "c.geom"]
    return f"SELECT {', '.join(columns)} FROM {relation} a JOIN counties c USING (atlas_stco) WHERE {condition}"


def _district(source: str) -> str:
    relation, amount, condition, years = _SOURCES[source]
    if source == "nri":
        condition = "true"  # missing values stay and count as nothing
    return (
        f"SELECT district_unique, state_name, CAST(sum({amount}) AS DOUBLE) / {years} AS {_names(source)[0]} "
        f"FROM {relation} a JOIN counties c USING (atlas_stco) JOIN district_lookup d ON c.atlas_stco = d.fips "
        f"WHERE {condition} GROUP BY state_name, district_unique"
    )


def _state(source: str) -> str:
    rate, share = _names(source)
    totals = {
        "exp": "SELECT atlas_name, expansion AS acres FROM study_states",
        "net": "SELECT state_name AS atlas_name, sum(acres) AS acres FROM net "
        "JOIN county_states USING (atlas_stco) GROUP BY state_name",
        "nlcd": "SELECT s.atlas_name, sum(a.acres) AS acres FROM nlcd a JOIN counties c USING (atlas_stco) "
        "JOIN states s ON s.atlas_name = c.state_name WHERE label = 'R' GROUP BY s.atlas_name",
        "nri": "SELECT s.atlas_name, sum(expansion) AS acres FROM nri a JOIN states s USING (st_abbrev) "
        "GROUP BY s.atlas_name",
        "nass": "SELECT s.atlas_name, sum(diff) AS acres FROM nass a JOIN counties c USING (atlas_stco) "
        "JOIN states s ON s.st_abbrev = c.st_abbrev WHERE diff IS NOT NULL GROUP BY s.atlas_name",
    }[source]
    years = _SOURCES[source][3]
    columns = [
        "s.atlas_name",
        f"CAST(acres AS DOUBLE) / {years} AS {rate}",
        f"CAST(acres AS DOUBLE) / {years} / s.acres_calc * 100 AS {share}",
    ]
    if source == "exp":
        columns.append("CAST(acres AS DOUBLE) AS acres_study")
    if source in ("nlcd", "nri"):
        columns.append("CAST(acres AS DOUBLE) AS acres")
    if rate == "acres_per_year":
        columns.append("s.geom")
    return f"SELECT {', '.join(columns)} FROM ({totals}) t JOIN states s USING (atlas_name)"


_QUERY = {"counties": _county, "districts": _district, "states": _state}


def _district_study(kind: str) -> str:
    return (
        f"SELECT d.*, a.acres, a.geom, acres_study_per_year / a.acres * 100 AS acres_study_per_year_per_eu "
        f"FROM ({_district(kind)}) d JOIN district_areas a USING (district_unique)"
    )


def _clamp(x: str, sat: float) -> str:
    return f"CASE WHEN {x} <= -{sat} THEN -{sat} WHEN {x} >= {sat} THEN {sat} ELSE {x} END"


def _log1p(x: str) -> str:
    return (
        f"CASE WHEN {x} > -1 THEN ln(1 + {x}) WHEN {x} = -1 THEN -CAST('inf' AS DOUBLE) "
        f"WHEN {x} < -1 THEN CAST('nan' AS DOUBLE) END"
    )


def _compare(level: str, dataset: str, key: str | None = None) -> str:
    """Every column of a comparison; shares by the names of the output."""
    kind, source = _STUDY[dataset], dataset.lower()
    key = key or _KEYS[level]
    if level == "districts":
        inner = (
            f"SELECT s.*, c.acres_per_year, c.acres_per_year / s.acres * 100 AS acres_per_year_per_eu "
            f"FROM ({_district_study(kind)}) s JOIN ({_district(source)}) c USING (district_unique)"
        )
        logs = ", ".join(
            f"round({_log1p(x)}, 9) AS {name}"
            for x, name in (("acres_study_per_year", "x_log1p"), ("acres_per_year", "y_log1p"))
        )
        logs = ", " + logs
    else:
        study = _QUERY[level](kind)
        other = _QUERY[level](source)
        if level == "counties":
            keep = "c.* EXCLUDE (atlas_stco, atlas_name)"
            if key == "atlas_name":
                keep = "c.* EXCLUDE (atlas_stco, atlas_name), c.atlas_stco AS atlas_stco_comparison"
        else:
            keep = "c.* EXCLUDE (atlas_name)"
        inner = f"SELECT s.*, {keep} FROM ({study}) s JOIN ({other}) c ON s.{key} = c.{key}"
        logs = ""
    diff = "(acres_per_year_per_eu - acres_study_per_year_per_eu)"
    return (
        f"SELECT *, {diff} AS diff_acres, {diff} / acres_study_per_year_per_eu AS diff_ratio{logs} "
        f"FROM ({inner}) j"
    )


def _long(level: str) -> str:
    logs = ", x_log1p, y_log1p" if level == "districts" else ""
    return " UNION ALL ".join(
        f"SELECT '{level}' AS level, '{d}' AS dataset, {_KEYS[level]} AS zone, acres_study_per_year, "
        f"acres_study_per_year_per_eu, acres_per_year, acres_per_year_per_eu, diff_acres, diff_ratio{logs}, geom "
        f"FROM ({_compare(level, d)}) x"
        for d in _STUDY
    )


def _column(name: str) -> str:
    return {"study_share": "acres_study_per_year_per_eu", "share": "acres_per_year_per_eu"}.get(name, name)


def _by_map(level: str) -> str:
    return " UNION ALL ".join(
        f"SELECT *, '{m}' AS map, CAST({sat} AS DOUBLE) AS sat, {_clamp(_column(c), sat)} AS col_sat FROM long"
        for m, (c, sat) in _MAPS[level].items()
        if m in _DRAWN[level]
    )


def _choropleth(level: str) -> str:
    return " UNION ALL ".join(
        f"SELECT level, dataset, '{m}' AS map, zone, {_clamp(_column(c), sat)} AS col_sat, "
        f"({_clamp(_column(c), sat)} + {sat}) / (2 * {sat}) AS fill_pos, geom FROM long"
        for m, (c, sat) in _MAPS[level].items()
    )


_POINTS = f"""
    SELECT level, dataset, acres_study_per_year AS x, acres_per_year AS y,
           CASE WHEN dataset = 'NASS' THEN 'identity' ELSE 'log1p' END AS transform,
           CASE WHEN dataset = 'NASS' THEN acres_study_per_year ELSE {_log1p('acres_study_per_year')} END AS tx,
           CASE WHEN dataset = 'NASS' THEN acres_per_year ELSE {_log1p('acres_per_year')} END AS ty
    FROM long"""


def _log10(x: str) -> str:
    return (
        f"CASE WHEN {x} > 0 THEN log10({x}) WHEN {x} = 0 THEN -CAST('inf' AS DOUBLE) "
        f"WHEN {x} < 0 THEN CAST('nan' AS DOUBLE) END"
    )


def _scatter_fits() -> str:
    acres, share = ("acres_study_per_year", "acres_per_year"), ("acres_study_per_year_per_eu", "acres_per_year_per_eu")
    kinds = [
        ("raw_acres", "identity", acres, "{}"),
        ("perc_eu", "identity", share, "{}"),
        ("perc_eu", "log10", share, _log10("{}")),
        ("perc_eu", "log10_plus1", share, _log10("({} + 1)")),
    ]
    points = " UNION ALL ".join(
        f"SELECT level, dataset, '{name}' AS scatter, '{t}' AS transform, {x} AS x, {y} AS y, "
        f"{change.replace('{}', x)} AS tx, {change.replace('{}', y)} AS ty FROM long"
        for name, t, (x, y), change in kinds
    )
    return f"SELECT * EXCLUDE (min_label, max_label) FROM ({_fits(points, 'scatter, ')}) s"


def _fits(points: str = _POINTS, more: str = "") -> str:
    finite = "isfinite(tx) AND isfinite(ty)"
    return f"""
SELECT level, dataset, {more}n, n_dropped, min_val, max_val,
       round(CASE WHEN spread THEN slope END, 6) AS slope,
       round(CASE WHEN spread THEN intercept END, 3) AS intercept,
       round(CASE WHEN spread AND min_y < max_y THEN r2 END, 8) AS r2, transform,
       format('{{:,}}', CAST(round_even(min_val, 0) AS BIGINT)) AS min_label,
       format('{{:,}}', CAST(round_even(max_val, 0) AS BIGINT)) AS max_label
FROM (
  SELECT level, dataset, {more}transform,
         count(*) FILTER (WHERE coalesce({finite}, false)) AS n,
         count(*) FILTER (WHERE NOT coalesce({finite}, false)) AS n_dropped,
         least(min(x), min(y)) AS min_val, greatest(max(x), max(y)) AS max_val,
         regr_slope(ty, tx) FILTER (WHERE {finite}) AS slope,
         regr_intercept(ty, tx) FILTER (WHERE {finite}) AS intercept,
         regr_r2(ty, tx) FILTER (WHERE {finite}) AS r2,
         min(tx) FILTER (WHERE {finite}) < max(tx) FILTER (WHERE {finite}) AS spread,
         min(ty) FILTER (WHERE {finite}) AS min_y, max(ty) FILTER (WHERE {finite}) AS max_y
  FROM ({points}
  ) p GROUP BY ALL
) f"""


def _profiles(level: str) -> str:
    columns = ["acres_study_per_year_per_eu", "acres_per_year_per_eu", "diff_acres", "diff_ratio"]
    if level == "districts":
        columns += ["x_log1p", "y_log1p"]
    ok = " AND ".join(f"coalesce(isfinite({c}), false)" for c in columns)
    return " UNION ALL ".join(
        f"SELECT level, dataset, '{c}' AS \"column\", "
        f"CASE WHEN bool_and({c} IS NOT NULL AND NOT isnan({c})) THEN min({c}) END AS min_all, "
        f"CASE WHEN bool_and({c} IS NOT NULL AND NOT isnan({c})) THEN max({c}) END AS max_all, "
        f"min({c}) FILTER (WHERE {ok}) AS min_finite, max({c}) FILTER (WHERE {ok}) AS max_finite "
        f"FROM long GROUP BY level, dataset"
        for c in columns
    )


def _hexbins() -> str:
    near = [f"CAST(floor(({c} + 1000000000) / 2000000000.0::DOUBLE) AS BIGINT)" for c in ("cq", "cr", "cs")]
    return f"""
SELECT level, dataset, q, r, count(*) AS n, round(any_value(low) + (q + r / 2) * (any_value(width) / 35), 6) AS x,
       round(any_value(low) + r * sqrt(3.0::DOUBLE) / 2 * (any_value(width) / 35), 6) AS y
FROM (
  SELECT *, CASE WHEN mq >= mr AND mq = ms THEN least(nq, -nr - ns) WHEN mq >= mr AND mq >= ms THEN -nr - ns ELSE nq END AS q,
         CASE WHEN NOT (mq >= mr AND mq >= ms) AND mr >= ms THEN -nq - ns ELSE nr END AS r
  FROM (SELECT *, abs(nq * 2000000000 - cq) AS mq, abs(nr * 2000000000 - cr) AS mr, abs(ns * 2000000000 - cs) AS ms
  FROM (SELECT *, {near[0]} AS nq, {near[1]} AS nr, {near[2]} AS ns
  FROM (SELECT *, 2 * u - v AS cq, 2 * v AS cr, -2 * u - v AS cs
  FROM (SELECT level, dataset, low, width,
          CASE WHEN width > 0 THEN CAST(round((tx - low) / width * 35 * 1000000000) AS BIGINT) ELSE 0 END AS u,
          CASE WHEN width > 0 THEN CAST(round((ty - low) / width * 35 / (sqrt(3.0::DOUBLE) / 2) * 1000000000) AS BIGINT) ELSE 0 END AS v
  FROM (SELECT *, least(min(tx) FILTER (WHERE isfinite(tx)) OVER w, min(ty) FILTER (WHERE isfinite(ty)) OVER w) AS low,
          greatest(max(tx) FILTER (WHERE isfinite(tx)) OVER w, max(ty) FILTER (WHERE isfinite(ty)) OVER w) - low AS width
        FROM ({_POINTS}) p WINDOW w AS (PARTITION BY level, dataset)) l
  WHERE isfinite(tx) AND isfinite(ty)) a) b) c) d
) e GROUP BY level, dataset, q, r"""


# Colours between the knots of the ramp, by way of Lab space.
_RAMP = """knots AS (
  SELECT k, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS b FROM (
    SELECT k, """ + ", ".join(f"CASE WHEN {t} > 216.0 / 24389 THEN pow({t}, 1.0 / 3) ELSE {t} * 841 / 108 + 4.0 / 29 END AS f{t}" for t in "xyz") + """ FROM (
      SELECT k, (0.4124564 * r + 0.3575761 * g + 0.1804375 * u) / 0.95047 AS x, 0.2126729 * r + 0.7151522 * g + 0.0721750 * u AS y,
        (0.0193339 * r + 0.1191920 * g + 0.9503041 * u) / 1.08883 AS z FROM (
        SELECT k, """ + ", ".join(f"CASE WHEN {c} <= 0.04045 * 255 THEN {c} / 255 / 12.92 ELSE pow(({c} / 255 + 0.055) / 1.055, 2.4) END AS {c}" for c in "rgu") + """
        FROM (VALUES (0, 0::DOUBLE, 60::DOUBLE, 48::DOUBLE), (1, 1, 102, 94), (2, 53, 151, 143), (3, 128, 205, 193), (4, 199, 234, 229),
          (5, 253, 219, 199), (6, 244, 165, 130), (7, 214, 96, 77), (8, 178, 24, 43), (9, 103, 0, 31)) v(k, r, g, u)))))"""


def _colours(level: str) -> str:
    cube = ", ".join(f"CASE WHEN {t} > 6.0 / 29 THEN {t} * {t} * {t} ELSE ({t} - 4.0 / 29) * 108 / 841 END * {w} AS {t}" for t, w in zip("xyz", (0.95047, 1, 1.08883), strict=True))
    rows = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
    light = ", ".join(f"{m[0]} * x + {m[1]} * y + {m[2]} * z AS {c}" for m, c in zip(rows, "rgu", strict=True))
    levels = ", ".join(
        f"CAST(floor(least(greatest(CASE WHEN {c} <= 0.0031308 THEN 12.92 * {c} ELSE 1.055 * pow(greatest({c}, 0), 1 / 2.4) - 0.055 END, 0), 1) * 255 + 0.5) AS INT)"
        for c in "rgu"
    )
    return f"""
SELECT level, dataset, zone, map, CASE WHEN place IS NULL THEN '#7f7f7f' ELSE printf('#%02x%02x%02x', {levels}) END AS colour
FROM (SELECT *, {light} FROM (SELECT * EXCLUDE (x, y, z), {cube}
FROM (SELECT p.*, (f.l * (1 - part) + t.l * part + 16) / 116 AS y, y + (f.a * (1 - part) + t.a * part) / 500 AS x, y - (f.b * (1 - part) + t.b * part) / 200 AS z
FROM (SELECT level, dataset, zone, map, CASE WHEN isfinite(fill_pos) THEN round(fill_pos, 2) * 9 END AS place,
        least(CAST(floor(place) AS INT), 8) AS knot, place - knot AS part FROM ({_choropleth(level)}) c) p
LEFT JOIN knots f ON f.k = knot LEFT JOIN knots t ON t.k = knot + 1) lab) xyz) rgb"""


# Charges lie between 2**-20 and 2**40, so times 2**60 each is a whole number, as is their sum.
_EXACT = """
SELECT l_suppkey::BIGINT AS supplier, round(sum(CAST(charge * 1152921504606846976 AS HUGEINT))::DOUBLE / 1152921504606846976, 6) AS total
FROM (SELECT l_suppkey, l_extendedprice::DOUBLE * (1 - l_discount::DOUBLE) * (1 + l_tax::DOUBLE) AS charge FROM lineitem) c GROUP BY l_suppkey"""


def oracle_sql() -> dict[str, str]:
    twins: dict[str, str] = {}

    def add(name: str, body: str, *more: str) -> None:
        twins[name] = ", ".join([TABLES, *more]) + "\n" + body

    for level, build in _QUERY.items():
        for source in _SOURCES:
            label = f"study_{source}" if source in ("exp", "net") else source
            add(f"{level}_{label}", build(source))
    add("counties_study_net_self_join", _county("net"))
    for kind in ("exp", "net"):
        add(f"districts_study_{kind}_share", _district_study(kind))
    for level in _QUERY:
        for dataset in _STUDY:
            column, sat = _MAPS[level][_DRAWN[level][1]]
            add(
                f"compare_{level}_{dataset.lower()}",
                f"SELECT *, {_clamp(_column(column), sat)} AS col_sat FROM ({_compare(level, dataset)}) x",
            )
    add("compare_counties_nlcd_by_name", _compare("counties", "NLCD", "atlas_name"))
    add("raw_districts_nass", f"SELECT * EXCLUDE (geom) FROM ({_compare('districts', 'NASS')}) x")
    for level in ("counties", "states"):
        add(f"scatter_fits_{level}", _scatter_fits(), f"long AS ({_long(level)})")
    add("counties_nass_whole_acres", _county("nass").replace("FROM nass a", "FROM (SELECT atlas_stco, floor(diff) AS diff FROM nass) a"))
    add("counties_nass_from_text", _county("nass"))
    named = TABLES.replace("c_name AS atlas_name", "'n' || CAST(c_custkey // 2 AS VARCHAR) AS atlas_name")
    twins["compare_counties_nlcd_namesakes"] = f"{named}\n{_compare('counties', 'NLCD', 'atlas_name')}"
    plain = "SELECT atlas_stco, o_orderstatus AS label, sum(price) AS acres FROM o GROUP BY ALL"
    number = "CAST(atlas_stco AS BIGINT)"
    odd = (
        f"SELECT atlas_stco, label, CASE WHEN {number} % 3 = 0 THEN 0 WHEN {number} % 5 = 0 THEN CAST('nan' AS DOUBLE) "
        f"ELSE CAST(acres AS DOUBLE) END AS acres FROM ({plain}) p"
    )
    twins["compare_counties_nlcd_zero_and_nan"] = f"{TABLES.replace(plain, odd)}\n{_compare('counties', 'NLCD')}"
    for level in _QUERY:
        long = f"long AS ({_long(level)})"
        add(f"comparisons_{level}", _by_map(level), long)
        add(f"choropleth_{level}", _choropleth(level), long)
        add(f"fits_{level}", _fits(), long)
        add(f"profiles_{level}", _profiles(level), long)
        add(f"colours_{level}", _colours(level), long, _RAMP)
        add(f"hexbins_{level}", _hexbins(), long)
    twins["exact_charges"] = _EXACT
    twins.update(GEOMETRY)
    return twins


# The map of zones: unit squares, known by their column and row.
_MAP = """
WITH RECURSIVE zones AS (
  SELECT c_custkey AS zone, c_nationkey::BIGINT AS district, n_regionkey::BIGINT AS state, c_custkey % 10 = 0 AS lake, c_custkey % 7 = 0 AS far,
    1 - CASE WHEN c_custkey % 10 = 0 THEN 0.25 ELSE 0 END + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS size
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), squares AS (
  SELECT zone, district, state, lake, zone % 64 AS x, zone // 64 AS y FROM zones
  UNION ALL SELECT zone, district, state, false, zone % 64, zone // 64 + 100000 FROM zones WHERE far
), sides AS (
  SELECT a.*, b.zone AS zone_b, b.district AS district_b, b.state AS state_b, b.x AS xb, b.y AS yb
  FROM squares a JOIN squares b ON (a.x = b.x AND abs(a.y - b.y) = 1) OR (a.y = b.y AND abs(a.x - b.x) = 1)
)"""


def _dissolved(level: str) -> str:
    return f"""{_MAP}, joined AS (SELECT * FROM sides WHERE {level} = {level}_b
), reach AS (
  SELECT {level}, x, y, x + 64 * y AS piece FROM squares
), firsts AS (
  SELECT x, y, x AS rx, y AS ry FROM squares UNION SELECT f.x, f.y, j.xb, j.yb FROM firsts f JOIN joined j ON j.x = f.rx AND j.y = f.ry
), pieces AS (
  SELECT {level}, count(DISTINCT piece) AS n_pieces
  FROM (SELECT s.{level}, s.x, s.y, min(f.rx + 64 * f.ry) AS piece FROM squares s JOIN firsts f USING (x, y) GROUP BY ALL) GROUP BY {level}
), inner_sides AS (SELECT {level}, count(*) AS n FROM joined GROUP BY {level})
SELECT s.{level}, n_pieces, (sum(CASE WHEN lake THEN 8 ELSE 4 END) - coalesce(any_value(i.n), 0))::BIGINT AS n_edges,
  round(sum(CASE WHEN lake THEN 0.75::DOUBLE ELSE 1 END), 6) AS area
FROM squares s JOIN pieces p USING ({level}) LEFT JOIN inner_sides i USING ({level}) GROUP BY s.{level}, n_pieces"""


def _borders(level: str) -> str:
    return f"""{_MAP} SELECT {level} AS zone, {level}_b AS neighbour, count(*) AS n_edges, count(*)::DOUBLE AS length
FROM sides WHERE {level} < {level}_b GROUP BY ALL"""


GEOMETRY = {
    "geometry_counties": f"""{_MAP} SELECT zone, 1 + far::INT AS n_polygons, 1 + far::INT + lake::INT AS n_rings,
  (5 * (1 + far::INT + lake::INT))::INT AS n_points, size::DOUBLE AS area FROM zones""",
    "dissolve_districts": _dissolved("district"),
    "dissolve_states": _dissolved("state"),
    "borders_counties": _borders("zone"),
    "borders_states": _borders("state"),
    "areas_off": f"{_MAP} SELECT zone, 2 * size::DOUBLE AS stored, size::DOUBLE AS computed FROM zones WHERE zone % 13 = 0",
    "zones_of_points": f"""{_MAP}, places AS (
  SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 3 = 0 THEN 21 ELSE o_orderkey % 64 END + (o_orderkey % 16) / 16 + 1 / 64 AS x,
    CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_orderkey // 37 % 40 END + (o_orderkey % 11) / 16 + 1 / 64 AS y
  FROM orders
)
SELECT s.zone, count(*) AS n_orders, min(order_id) AS first_order
FROM places p LEFT JOIN squares s ON s.x = floor(p.x) AND s.y = floor(p.y)
  AND NOT (s.lake AND p.x - s.x BETWEEN 0.25 AND 0.75 AND p.y - s.y BETWEEN 0.25 AND 0.75)
GROUP BY s.zone""",
}
