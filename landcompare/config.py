"""What is compared with what: levels, datasets, year spans, map limits."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

from landcompare.sources.query_text import whole_text


@dataclass(frozen=True)
class Dataset:
    """A comparison dataset and the study measure it is held against."""

    query: str  # nri, nlcd or nass
    study: str  # exp (expansion) or net
    transform: str = "log1p"  # space of the scatter fit: log1p or identity
    labels: tuple[str, ...] = ()


@dataclass(frozen=True)
class MapSpec:
    """The column a map shows and the limit it is clamped to."""

    column: str
    sat: float
    title: str = ""
    palette: str = ""


@dataclass(frozen=True)
class Scatter:
    x: str
    y: str
    log_trans: tuple[str, ...] = ()


@dataclass(frozen=True)
class Level:
    datasets: dict[str, Dataset]
    maps: dict[str, MapSpec]
    drawn: tuple[str, ...]  # the maps a report makes
    scatterplots: dict[str, Scatter] = field(default_factory=dict)
    log_columns: bool = False  # carry x_log1p / y_log1p


# Class labels, year spans, the datasets whose fit is in raw space,
# panel letters, and per level the mapped columns with their limits.
GAIN_LABEL = "3"
LOSS_LABEL = "4"
NLCD_LABEL = "4"
YEARS = {"exp": 8, "net": 8, "nlcd": 8, "nri": 8, "nass": 10}
IDENTITY_DATASETS = ("NASS",)
PANELS = {"NRI": ("a", "b", "c"), "NLCD": ("d", "e", "f"), "NASS": ("g", "h", "i")}
LEVELS = ("counties", "districts", "states")


def _datasets(panels: bool) -> dict[str, Dataset]:
    def one(name: str, study: str) -> Dataset:
        return Dataset(
            query=name.lower(),
            study=study,
            transform="identity" if name in IDENTITY_DATASETS else "log1p",
            labels=PANELS[name] if panels else (),
        )

    return {"NRI": one("NRI", "exp"), "NLCD": one("NLCD", "exp"), "NASS": one("NASS", "net")}


def _levels(tag: str) -> dict[str, Level]:
    study_rate = f"acres_{tag}_per_year"
    study_share = f"{study_rate}_per_eu"
    share = "acres_per_year_per_eu"
    scatter = {
        "raw_acres": Scatter(study_rate, "acres_per_year"),
        "perc_eu": Scatter(study_share, share, ("no_log", "log10", "log10_plus1")),
    }

    def maps(**third: MapSpec) -> dict[str, MapSpec]:
        return {"map1": MapSpec(study_share, 1.0), "map2": MapSpec(share, 1.0), **third}

    of_district = {"map3_diff_acres": MapSpec("diff_acres", 1.0), "map3_diff_ratio": MapSpec("diff_ratio", 20.0)}
    return {
        "states": Level(_datasets(True), maps(map3=MapSpec("diff_acres", 1.0)), ("map2", "map3"), scatter),
        "districts": Level(_datasets(True), maps(**of_district), ("map2", "map3_diff_acres"), log_columns=True),
        "counties": Level(_datasets(False), maps(map3=MapSpec("diff_acres", 0.2)), ("map2", "map3"), scatter),
    }


@dataclass(frozen=True)
class Settings:
    """``study_tag`` names the study in its column names (``acres_<tag>_per_year``)."""

    study_tag: str = "study"
    gain_label: str = GAIN_LABEL
    loss_label: str = LOSS_LABEL
    nlcd_label: str = NLCD_LABEL
    years: dict[str, int] = field(default_factory=lambda: dict(YEARS))
    levels: dict[str, Level] = field(default_factory=dict)

    def __post_init__(self):
        if not self.levels:
            object.__setattr__(self, "levels", _levels(self.study_tag))

    def level(self, name: str) -> Level:
        return _lookup(self.levels, name, "level")

    def dataset(self, level: str, name: str) -> Dataset:
        return _lookup(self.level(level).datasets, name, "dataset")

    def map(self, level: str, name: str) -> MapSpec:
        return _lookup(self.level(level).maps, name, "map")

    def rate(self, source: str) -> str:
        """Column name of the annual rate of a study measure or a dataset."""
        return f"acres_{self.study_tag}_per_year" if source in ("exp", "net") else "acres_per_year"

    def share(self, source: str) -> str:
        """Column name of the rate as percent of the zone's area."""
        return f"{self.rate(source)}_per_eu"


def _lookup(entries: dict, name: str, kind: str):
    if name not in entries:
        raise KeyError(f"unknown {kind} {name!r}; known: {', '.join(entries)}")
    return entries[name]


def load_settings(spark: SparkSession, path: str, study_tag: str = "study", **changes) -> Settings:
    """Read a JSON figure description: level -> datasets, maps, scatterplots.

    The file may lie on any file system Spark reads. ``changes`` override other
    fields of ``Settings``, such as class labels or year spans.
    """
    text = whole_text(spark, path)
    base = replace(Settings(study_tag=study_tag), **changes)
    levels = {name: _level_from_json(name, body, base) for name, body in json.loads(text).items()}
    return replace(base, levels=levels)


def _level_from_json(name: str, body: dict, base: Settings) -> Level:
    known = base.levels.get(name)
    datasets = {
        key: Dataset(
            query=d["query"].removeprefix("query_").removesuffix(".sql"),
            study=d[f"datasets_{base.study_tag}"],
            transform="identity" if key in IDENTITY_DATASETS else "log1p",
            labels=tuple(d.get("label", ())),
        )
        for key, d in body["datasets"].items()
    }
    maps = {
        key: MapSpec(m["current_col"], float(m["sat"]), m.get("legend.title", ""), m.get("palette", ""))
        for key, m in body["maps"].items()
    }
    scatter = {
        key: Scatter(s["x"], s["y"], tuple(s.get("log_trans", ())))
        for key, s in body.get("scatterplots", {}).items()
    }
    drawn = tuple(m for m in (known.drawn if known else maps) if m in maps)
    return Level(datasets, maps, drawn, scatter, known.log_columns if known else False)
