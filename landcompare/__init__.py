"""Comparison of land-change estimates at county, district and state level, on Spark."""

from landcompare.config import Dataset, Level, MapSpec, Settings, load_settings
from landcompare.sources.tables import Tables

__all__ = ["Dataset", "Level", "MapSpec", "Settings", "Tables", "load_settings"]
