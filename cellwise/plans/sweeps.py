"""The profile's sweeps, from a configuration: radius, number of regions, number of centroids, and the stress run."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from cellwise.functions.arrays import linspace_values
from cellwise.operators.generators import Generator, Uniform, Voronoi
from cellwise.plans import profile
from cellwise.plans.api import Full, Splatter, generate, splat
from cellwise.schema import RegionfieldMeta

#: Ways to compute the exact shares, by the names that results carry, and shapes of the result.
SPLATTINGS: dict[str, Callable[[int], Splatter]] = {"F-": lambda r: Full(r, "scatter"), "F+": lambda r: Full(r, "tile")}
SHAPES = {"DD": "array", "DS": "sparse", "SS": "long"}


@dataclass(frozen=True)
class Span:
    """`count` whole numbers from `low` to `high`, evenly spaced and cut."""

    low: float
    high: float
    count: int

    @property
    def values(self) -> list[int]:
        return linspace_values(self.low, self.high, self.count, True)

    @classmethod
    def of(cls, given: Mapping) -> Span:
        if set(given) != {"from", "to", "count"}:
            raise ValueError(f"a span has from, to and count, not {sorted(given)}")
        return cls(given["from"], given["to"], int(given["count"]))


def pair(given: Iterable[int]) -> tuple[int, int]:
    """Two numbers of a sequence of two."""
    values = tuple(int(v) for v in given)
    if len(values) != 2:
        raise ValueError(f"two numbers are wanted, not {values}")
    return values


@dataclass(frozen=True)
class Config:
    """What the profile runs; the defaults are the published protocol."""

    seed: int = 9800185059250152198
    extent: tuple[int, int] = (192, 192)
    radius: int = 16
    regions: int = 5
    centroids: int = 5
    radii: Span = field(default=Span(2, 64, 15))
    region_counts: Span = field(default=Span(2, 30, 15))
    centroid_counts: Span = field(default=Span(1, 60, 15))
    stress_extent: tuple[int, int] = (512, 512)
    stress_regions: int = 15
    stress_radii: Span = field(default=Span(8, 256, 30))
    runs: int = 15

    @classmethod
    def of(cls, given: Mapping) -> Config:
        """From a mapping such as a parsed YAML file; unknown names are errors."""
        if unknown := set(given) - set(cls.__dataclass_fields__):
            raise ValueError(f"unknown: {sorted(unknown)}")
        convert = {Span: Span.of, tuple: pair, int: int}
        return cls(**{k: convert[type(cls.__dataclass_fields__[k].default)](v) for k, v in given.items()})


def parse_yaml(text: str):
    """Nested mappings, lists in brackets, numbers and words: the part of YAML that configurations of profiles use."""
    root: dict = {}
    open_: list[tuple[int, dict]] = [(-1, root)]
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#") or body.strip() in ("---", "..."):
            continue
        indent, (key, colon, value) = len(body) - len(body.lstrip()), body.strip().partition(":")
        if not colon:
            raise ValueError(f"neither a mapping nor a comment: {line!r}")
        while open_[-1][0] >= indent:
            open_.pop()
        if value.strip():
            open_[-1][1][key.strip()] = _scalar(value.strip())
        else:
            inner: dict = {}
            open_[-1][1][key.strip()] = inner
            open_.append((indent, inner))
    return root


def _scalar(text: str):
    if text[0] == "[" and text[-1] == "]":
        return [_scalar(x.strip()) for x in text[1:-1].split(",") if x.strip()]
    try:
        return int(text, 0)
    except ValueError:
        try:
            return float(text)
        except ValueError:
            return text.strip("'\"")


def config_from_yaml(text: str) -> Config:
    """A profile's configuration: seed, and a "parameter set" of "default" and "stress" with "fixed" and "variable" parts, whose
    spans have from, to and step (how many). Affinity masks have no meaning here."""
    given = parse_yaml(text)
    sets = given["parameter set"]
    fixed, variable, stress = sets["default"]["fixed"], sets["default"]["variable"], sets["stress"]
    span = lambda x: Span(x["from"], x["to"], int(x["step"]))
    return Config(
        seed=int(given["seed"]),
        extent=pair(fixed["extent"]),
        radius=int(fixed["radius"]),
        regions=int(fixed["region count"]),
        centroids=int(fixed["centroid count"]),
        radii=span(variable["radius"]),
        region_counts=span(variable["region count"]),
        centroid_counts=span(variable["centroid count"]),
        stress_extent=pair(stress["fixed"]["extent"]),
        stress_regions=int(stress["fixed"]["region count"]),
        stress_radii=span(stress["variable"]["radius"]),
    )


def _grid(extent: tuple[int, int], radius: int, regions: int) -> RegionfieldMeta:
    """A grid that has `extent` centres at the radius."""
    return RegionfieldMeta(extent[0] + 2 * radius, extent[1] + 2 * radius, regions)


@dataclass
class Jobs:
    """Runs jobs one after the other and keeps their index and results."""

    spark: SparkSession
    runs: int
    index: list[tuple] = field(default_factory=list)
    results: list[DataFrame] = field(default_factory=list)

    def run(self, title: str, generator: str, splatting: str, shape: str, tag: str, values: Iterable[int], plan: Callable[[int], DataFrame]) -> None:
        job = profile.FIRST_JOB + len(self.index)
        self.index.append((job, title, generator, splatting, shape, tag))
        self.results.append(profile.sweep(self.spark, job, values, plan, self.runs))

    def tables(self) -> tuple[DataFrame, DataFrame]:
        """(index, results)."""
        return self.spark.createDataFrame(self.index, profile.INDEX), reduce(DataFrame.unionByName, self.results)


def sweep_radius(jobs: Jobs, config: Config, generators: Mapping[str, Generator], splattings: Iterable[str], shapes: Iterable[str] = SHAPES, radii: Span | None = None, extent: tuple[int, int] | None = None, regions: int | None = None, tag: str = "Default") -> None:
    """One grid for each generator, large enough for the largest radius."""
    values = (radii or config.radii).values
    extent, regions = extent or config.extent, regions or config.regions
    meta = _grid(extent, max(values), regions)
    for (name, generator), way, shape in itertools.product(generators.items(), splattings, shapes):
        grid = generate(jobs.spark, meta, generator, config.seed).cache()
        offset = (max(values), max(values))
        jobs.run("Radius", name, way, shape, tag, values, lambda r: splat(grid, meta, SPLATTINGS[way](r), offset, extent, SHAPES[shape]))
        grid.unpersist()


def sweep_region_count(jobs: Jobs, config: Config, splattings: Iterable[str], shapes: Iterable[str] = SHAPES) -> None:
    """A new Voronoi grid for each number of regions."""
    for way, shape in itertools.product(splattings, shapes):

        def plan(regions: int) -> DataFrame:
            meta = _grid(config.extent, config.radius, regions)
            return splat(generate(jobs.spark, meta, Voronoi(config.centroids), config.seed), meta, SPLATTINGS[way](config.radius), shape=SHAPES[shape])

        jobs.run("GlobalRegionCount", "Voronoi", way, shape, "Default", config.region_counts.values, plan)


def sweep_centroid_count(jobs: Jobs, config: Config, splattings: Iterable[str], shapes: Iterable[str] = SHAPES) -> None:
    """A new Voronoi grid for each number of centroids: more of them make more regions in a neighbourhood."""
    for way, shape in itertools.product(splattings, shapes):

        def plan(centroids: int) -> DataFrame:
            meta = _grid(config.extent, config.radius, config.regions)
            return splat(generate(jobs.spark, meta, Voronoi(centroids), config.seed), meta, SPLATTINGS[way](config.radius), shape=SHAPES[shape])

        jobs.run("LocalRegionCount", "Voronoi", way, shape, "Default", config.centroid_counts.values, plan)


def run_profile(spark: SparkSession, config: Config) -> tuple[DataFrame, DataFrame]:
    """All sweeps: both ways on uniform and Voronoi grids, and the fast one under stress. Returns (index, results)."""
    jobs = Jobs(spark, config.runs)
    sweep_radius(jobs, config, {"Uniform": Uniform(), "Voronoi": Voronoi(config.centroids)}, SPLATTINGS)
    sweep_region_count(jobs, config, SPLATTINGS)
    sweep_centroid_count(jobs, config, SPLATTINGS)
    sweep_radius(jobs, config, {"Uniform": Uniform()}, ["F+"], SHAPES, config.stress_radii, config.stress_extent, config.stress_regions, "Stress")
    return jobs.tables()
