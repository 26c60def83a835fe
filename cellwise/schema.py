"""Schemas of grids and weights, and checks at the API's boundary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELD = "x int, y int, region int"
WEIGHTS = "x int, y int, region int, importance long, mask double"


@dataclass(frozen=True)
class RegionfieldMeta:
    """What is known of a grid besides its rows: extent and the number of regions, not all of which need occur."""

    width: int
    height: int
    region_count: int

    def __post_init__(self):
        if self.width < 1 or self.height < 1:
            raise ValueError(f"extent must be positive, not {self.width} x {self.height}")
        if not 1 <= self.region_count <= 256:
            raise ValueError(f"there must be 1 to 256 regions, not {self.region_count}")

    @property
    def transposed(self) -> RegionfieldMeta:
        return RegionfieldMeta(self.height, self.width, self.region_count)


def measure(field: DataFrame, region_count: int) -> RegionfieldMeta:
    """The extent of a complete grid: one aggregation, one row."""
    row = field.agg(F.max("x").alias("x"), F.max("y").alias("y")).first()
    if row["x"] is None:
        raise ValueError("the grid has no cells")
    return RegionfieldMeta(row["x"] + 1, row["y"] + 1, region_count)


def check_complete(field: DataFrame, meta: RegionfieldMeta) -> None:
    """Raises unless each cell of the extent has one row with a region below the count."""
    row = field.agg(F.count("*").alias("n"), F.countDistinct("x", "y").alias("cells"), F.coalesce(F.sum(F.when(F.col("region").between(0, meta.region_count - 1), 0).otherwise(1)), F.lit(0)).alias("bad")).first()
    if row["n"] != meta.width * meta.height or row["cells"] != row["n"] or row["bad"]:
        raise ValueError(f"{row['n']} rows, {row['cells']} cells and {row['bad']} regions out of range for {meta}")


@dataclass(frozen=True)
class Window:
    """The rectangle of cell centres asked for."""

    offset: tuple[int, int]
    extent: tuple[int, int]

    @property
    def last(self) -> tuple[int, int]:
        return self.offset[0] + self.extent[0] - 1, self.offset[1] + self.extent[1] - 1


def minimum_dimension(window: Window, radius: int) -> tuple[int, int]:
    return tuple(o + e + radius for o, e in zip(window.offset, window.extent, strict=True))


def minimum_offset(radius: int) -> tuple[int, int]:
    return radius, radius


def maximum_extent(meta: RegionfieldMeta, offset: tuple[int, int], radius: int) -> tuple[int, int]:
    room = meta.width - offset[0] - radius, meta.height - offset[1] - radius
    if min(room) < 0:
        raise ValueError(f"no extent fits at offset {offset} with radius {radius} in {meta.width} x {meta.height}")
    return room


def resolve_window(meta: RegionfieldMeta, radius: int, offset: tuple[int, int] | None = None, extent: tuple[int, int] | None = None) -> Window:
    """The window with defaults (smallest offset, largest extent); raises if neighbourhoods would leave the grid."""
    if radius < 0:
        raise ValueError(f"radius must not be negative: {radius}")
    offset = offset or minimum_offset(radius)
    if min(offset) < radius:
        raise ValueError(f"offset {offset} is less than the radius {radius}")
    extent = extent or maximum_extent(meta, offset, radius)
    window = Window(tuple(offset), tuple(extent))
    if min(extent) < 1:
        raise ValueError(f"extent {extent} is empty")
    if any(d > have for d, have in zip(minimum_dimension(window, radius), (meta.width, meta.height), strict=True)):
        raise ValueError(f"{window} with radius {radius} needs {minimum_dimension(window, radius)}; the grid has {meta.width} x {meta.height}")
    return window


def centred_window(meta: RegionfieldMeta, radius: int, extent: tuple[int, int]) -> Window:
    """A window of the extent in the middle of the grid."""
    return resolve_window(meta, radius, ((meta.width - extent[0]) // 2, (meta.height - extent[1]) // 2), extent)
