"""The logical tables derived from order and line tables.

A customer plays the county, its nation the district, its region the state;
money plays acres. Sums are taken in whole cents, so they are exact whatever
the order of addition, and passed on as DECIMAL.

Every large sum is keyed by the county or the order alone, combined map-side and
then joined on the same key: one shuffle serves both, and a key that holds much
of the data has shrunk to one row per task before it moves. Nothing is broadcast
by hint, since counties grow with the data; Spark does so by measured size.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landcompare.config import Settings
from landcompare.operators.wide import study_sums
from landcompare.operators.wide import sums as wide_sums
from landcompare.sources.tables import Tables

# Codes of the test tables. F plays gain, P loss; R plays the NLCD class.
GAIN, LOSS, NLCD = "F", "P", "R"

SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_extendedprice DOUBLE, l_discount DOUBLE, l_returnflag STRING, "
    "l_linestatus STRING",
}

# What is summed per county: (the rows of a class; a mark; the class of the marked rows). A measure with a mark is
# missing where no row of the latter class has it.
CLASS_COLUMNS = {"orders": "o_orderstatus", "lineitem": "l_returnflag"}
AMOUNTS = {"orders": "o_totalprice", "lineitem": "l_extendedprice"}
SUMS = {
    "orders": {
        "grown": ("o_orderstatus = 'F'", "o_orderpriority = '1-URGENT'", "o_orderstatus = 'F'"),
        "shrunk": ("o_orderstatus = 'O'", "o_orderpriority = '5-LOW'", "o_orderstatus = 'P'"),
        "total": ("true", None, "true"),
    },
    "lineitem": {"clean": ("l_returnflag = 'A'", "l_linestatus = 'F' AND l_discount <= 0.01", "l_returnflag = 'A'")},
}
PLACE = ("atlas_stco", "atlas_name", "state_name", "st_abbrev", "wkb_geometry")
HISTOGRAM_OF = {"study_classes": "orders", "nlcd_classes": "lineitem"}


def settings() -> Settings:
    return Settings(gain_label=GAIN, loss_label=LOSS, nlcd_label=NLCD)


def tables(spark: SparkSession, sf_dir: str, one_pass: bool = True) -> Tables:
    """The logical tables as lazy plans over the Parquet files of ``sf_dir``.

    With ``one_pass`` comparisons are summed straight from the files; else they go through the logical tables, as with any other source.
    """
    found = _tables(_Raw(spark, sf_dir))
    if not one_pass:
        found.load_wide = None
    return found


class _Raw:
    """Sums per county, computed from the given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.read = cache(self._read)

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    def places(self) -> DataFrame:
        """Counties with their state and district, without area; nations know their region before customers join."""
        nations = self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return (
            self.read("customer")
            .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("c_custkey").cast("string").alias("atlas_stco"),
                F.col("c_name").alias("atlas_name"),
                F.col("r_name").alias("state_name"),
                F.col("r_regionkey").cast("string").alias("st_abbrev"),
                F.col("c_name").cast("binary").alias("wkb_geometry"),
                F.col("c_nationkey").cast("string").alias("district_unique"),
            )
        )

    def counties(self) -> DataFrame:
        # A left join: where the area is not asked for, Catalyst drops the orders.
        areas = self.sums("orders", "total")
        return self.places().join(areas, "atlas_stco", "left").select(*PLACE, _area())

    def districts(self) -> DataFrame:
        return self.read("customer").select(
            F.col("c_custkey").cast("string").alias("fips"),
            F.col("c_nationkey").cast("string").alias("district_unique"),
        )

    def sums(self, source: str, *names: str, only: bool = False) -> DataFrame:
        """(atlas_stco, the named sums in cents); ``only`` of counties with a row of one of the classes."""
        classes = dict.fromkeys(c for n in names for c in (SUMS[source][n][0], SUMS[source][n][2]))
        where = F.expr(" OR ".join(f"({c})" for c in classes)) if only else None
        found = self._totals(source, measure_sums(source, *names), where)
        return found.select("atlas_stco", *[measure(source, n).alias(n) for n in names])

    def classes(self, source: str, *labels: str) -> DataFrame:
        """(atlas_stco, label, acres); of some labels, by a filter that reaches the scan, or of all, NULL included."""
        column = CLASS_COLUMNS[source]
        if not labels:
            rows = self._totals(source, {"total": _cents(source, "true")}, None, F.col(column).alias("label"))
            return rows.select("atlas_stco", "label", _acres("total").alias("acres"))
        # Summed side by side and unfolded, so what follows finds rows dealt by county.
        where = F.col(column).isin(*labels)
        if len(labels) == 1:
            total = self._totals(source, {"total": _cents(source, "true")}, where)
            return total.select("atlas_stco", F.lit(labels[0]).alias("label"), _acres("total").alias("acres"))
        test = {k: f"{column} = '{label}'" for k, label in enumerate(labels)}
        sums = {f"sum_{k}": _cents(source, c) for k, c in test.items()} | {f"rows_{k}": F.count_if(F.expr(c)) for k, c in test.items()}
        kinds = [F.struct(F.lit(x).alias("label"), _acres(f"sum_{k}").alias("acres"), F.col(f"rows_{k}").alias("n")) for k, x in enumerate(labels)]
        return self._totals(source, sums, where).select("atlas_stco", F.inline(F.array(*kinds))).where("n > 0").select("atlas_stco", "label", "acres")

    def _totals(self, source: str, sums: dict[str, Column], where: Column | None = None, *by: Column) -> DataFrame:
        rows = self.read(source)
        rows = rows if where is None else rows.where(where)
        owner = F.col("o_custkey").cast("string").alias("atlas_stco")
        aggregates = [column.alias(name) for name, column in sums.items()]
        keys = ["label"] if by else []
        if source == "orders":
            return rows.select("*", owner, *by).groupBy("atlas_stco", *keys).agg(*aggregates)
        per_order = rows.select("*", *by).groupBy("l_orderkey", *keys).agg(*aggregates)
        owners = self.read("orders").select("o_orderkey", owner)
        return (
            per_order.join(owners, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("atlas_stco", *keys)
            .agg(*[F.sum(name).alias(name) for name in sums])
        )

    def wide(self, s: Settings, level: str, sources: Sequence[str]) -> DataFrame:
        """What ``operators.wide.wide`` gives, from one pass over the lines and two over the orders."""
        study = {"gain": s.gain_label, "loss": s.loss_label}
        labelled = {n: f"o_orderstatus = '{x}'" for n, x in study.items()}
        orders = {n: _cents("orders", c) for n, c in labelled.items()}
        orders |= {"gains": F.count_if(F.expr(labelled["gain"])), "losses": F.count_if(F.expr(labelled["loss"]))}
        orders |= measure_sums("orders", "grown", "shrunk", "total") | {"rows_nass": F.count(F.lit(1))}
        frame = self.places().join(self._totals("orders", orders), "atlas_stco")
        if {"nlcd", "nri"} & set(sources):
            nlcd = f"l_returnflag = '{s.nlcd_label}'"
            lines = {"nlcd": _cents("lineitem", nlcd), "rows_nlcd": F.count_if(F.expr(nlcd)), "rows_nri": F.count(F.lit(1))}
            frame = frame.join(self._totals("lineitem", lines | measure_sums("lineitem", "clean")), "atlas_stco", "left")
        totals = {
            "nass": lambda: _acres("grown", measure("orders", "grown")) - _acres("shrunk", measure("orders", "shrunk")),
            "nlcd": lambda: _acres("nlcd"),
            "nri": lambda: _acres("clean", measure("lineitem", "clean")),
        }
        frame = frame.withColumns({f"total_{x}": build() for x, build in totals.items() if x in sources} | {"gain": _acres("gain"), "loss": _acres("loss")})
        frame = study_sums(frame.withColumn("area", _acres("total") * 4), sources)
        figures = [f"{part}_{x}" for x in sources for part in ("total", "rows")]
        if level == "counties":
            return frame.select("atlas_stco", F.col("area").cast("double").alias("acres_calc"), F.col("wkb_geometry").alias("geom"), *figures)
        keys = ["district_unique", "state_name"] if level == "districts" else ["state_name", "st_abbrev"]
        rows = frame.groupBy(*keys).agg(*wide_sums(sources), F.sum("area").cast("double").alias("area"))
        if level == "districts":  # each lies in one state here
            return rows.select(*keys, F.col("area").alias("acres"), F.col("district_unique").cast("binary").alias("geom"), *figures)
        return rows.select(F.col("state_name").alias("atlas_name"), F.col("area").alias("acres_calc"), F.col("state_name").cast("binary").alias("geom"), *figures)


def measure_sums(source: str, *names: str) -> dict[str, Column]:
    """The sum of each named class, and how many rows have its mark, if there is one."""
    found: dict[str, Column] = {}
    for n in names:
        condition, mark, of = SUMS[source][n]
        found[n] = _cents(source, condition)
        if mark:
            found[f"{n}_marks"] = F.count_if(F.expr(f"({of}) AND ({mark})"))
    return found


def measure(source: str, name: str) -> Column:
    """A class's sum, missing without a marked row."""
    return F.when(F.col(f"{name}_marks") > 0, F.col(name)) if SUMS[source][name][1] else F.col(name)


def _cents(source: str, condition: str) -> Column:
    """Sum in whole cents over the rows that meet a condition."""
    cents = F.rint(F.col(AMOUNTS[source]) * 100).cast("bigint")
    return F.sum(F.when(F.expr(condition), cents))


def _acres(cents: str, value: Column | None = None) -> Column:
    return (F.col(cents) if value is None else value).cast("decimal(20,0)") * F.lit(Decimal("0.01"))


def _area() -> Column:
    return (_acres("total") * 4).alias("acres_calc")


def _tables(source: _Raw) -> Tables:
    read = source.read

    def classes(name: str, labels: Sequence[str]) -> DataFrame:
        return source.classes(HISTOGRAM_OF[name], *labels)

    counties, districts = cache(source.counties), cache(source.districts)

    def study_states() -> DataFrame:
        place = counties().select("atlas_stco", "state_name")
        return (
            classes("study_classes", [GAIN])
            .join(place, "atlas_stco")
            .groupBy(F.col("state_name").alias("atlas_name"))
            .agg(F.sum("acres").alias("expansion"))
        )

    def nri(only: bool = False) -> DataFrame:
        # A left join on a key made unique: where the state is not asked for, Catalyst drops it.
        place = source.places().groupBy("atlas_stco").agg(F.min("st_abbrev").alias("st_abbrev"))
        return (
            source.sums("lineitem", "clean", only=only)
            .join(place, "atlas_stco", "left")
            .select("atlas_stco", "st_abbrev", _acres("clean").alias("expansion"))
        )

    def nass(only: bool = False) -> DataFrame:
        return source.sums("orders", "grown", "shrunk", only=only).select(
            "atlas_stco", (_acres("grown") - _acres("shrunk")).alias("diff")
        )

    def states() -> DataFrame:
        area = counties().groupBy("state_name").agg(F.sum("acres_calc").alias("acres_calc"))
        return (
            read("region")
            .join(area, F.col("r_name") == F.col("state_name"))
            .select(
                F.col("r_name").alias("atlas_name"),
                F.col("r_regionkey").cast("string").alias("st_abbrev"),
                "acres_calc",
                F.col("r_name").cast("binary").alias("wkb_geometry"),
            )
        )

    def district_areas() -> DataFrame:
        return (
            counties()
            .select("atlas_stco", "acres_calc")
            .join(districts(), F.col("atlas_stco") == F.col("fips"))
            .groupBy(F.col("district_unique").alias("STASD_A"))
            .agg(F.sum("acres_calc").alias("acres"))
            .withColumn("geom", F.col("STASD_A").cast("binary"))
        )

    build = {
        "study_classes": lambda: source.classes("orders"),
        "study_states": study_states,
        "nlcd_classes": lambda: source.classes("lineitem"),
        "nri": nri,
        "nass": nass,
        "counties": counties,
        "county_states": lambda: counties().select("atlas_stco", "state_name"),
        "states": states,
        "district_lookup": districts,
        "district_areas": district_areas,
    }
    known = {"nri": nri, "nass": nass}
    return Tables(lambda name: build[name](), classes, lambda name: known[name](only=True), source.wide)
