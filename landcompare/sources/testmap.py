"""A map of the customers, who play the counties, with polygons whose measures are known.

Customer k owns the square at column k % 64 and row k / 64 of a field of unit squares. Every
tenth has a lake of half its width in the middle; every seventh owns a second square, 100,000
rows further up. Corners are off the true ones by less than half a step of the grid, each
customer's in its own way, so that borders only meet once they are snapped. Nations play the
districts, so a district's parts lie scattered, touch at corners and surround others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landcompare.functions.geometry import write_wkb
from landcompare.sources.shared import dealt

COLUMNS, FAR = 64, 100_000
JITTER = 0.00004  # below half of the grid of 0.0001


def _square(x: Column, y: Column, size: float, inward: float, key: Column) -> Column:
    corners = [(inward, inward), (inward + size, inward), (inward + size, inward + size), (inward, inward + size), (inward, inward)]

    def near(v: Column, k: int) -> Column:
        return v + (F.pmod(F.xxhash64(key, F.lit(k % 8)), F.lit(2001)) - 1000) * (JITTER / 1000)

    points = [F.struct(near(x + dx, 2 * k).alias("x"), near(y + dy, 2 * k + 1).alias("y")) for k, (dx, dy) in enumerate(corners)]
    return F.array(*points)


def counties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(zone, district, state, acres_calc, geom): geometry as WKB; every thirteenth has a wrong area on record."""
    customers = dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey"))
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    key = F.col("c_custkey").cast("bigint")
    x, y = (key % COLUMNS).cast("double"), F.floor(key / COLUMNS).cast("double")
    home = F.when(key % 10 == 0, F.array(_square(x, y, 1, 0, key), _square(x, y, 0.5, 0.25, key))).otherwise(F.array(_square(x, y, 1, 0, key)))
    geometry = F.when(key % 7 == 0, F.array(home, F.array(_square(x, y + FAR, 1, 0, key)))).otherwise(F.array(home))
    size = 1 - 0.25 * (key % 10 == 0).cast("double") + (key % 7 == 0).cast("double")
    found = customers.select("c_nationkey", key.alias("zone"), F.when(key % 13 == 0, size * 2).otherwise(size).alias("acres_calc"), write_wkb(geometry).alias("geom"))
    states = nations.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("bigint").alias("state"))
    return found.join(states, "c_nationkey").select("zone", F.col("c_nationkey").cast("bigint").alias("district"), "state", "acres_calc", "geom")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_id, x, y): a place for every order, a multiple of 1/16 and 1/64 off the corners of squares; a third of them in one square."""
    key = F.col("o_orderkey").cast("bigint")
    hot = key % 3 == 0
    x = F.when(hot, 21 + (key % 16) / 16 + 1 / 64).otherwise(key % COLUMNS + (key % 16) / 16 + 1 / 64)
    y = F.when(hot, 1 + (key % 11) / 16 + 1 / 64).otherwise(F.floor(key / 37) % 40 + (key % 11) / 16 + 1 / 64)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(key.alias("order_id"), x.cast("double").alias("x"), y.cast("double").alias("y"))
