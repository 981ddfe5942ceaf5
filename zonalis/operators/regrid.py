"""Layers of different pixel size and origin on one lattice.

Where two lattices lie over each other, the pixels of one that a pixel of the other meets are an
interval per axis. Its ends and the overlaps follow from the indices in whole numbers, so a pixel is
sent to the target pixels that it meets by arithmetic: there is no join of pixels with pixels.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.functions.ranges import CHUNK, explode_range
from zonalis.schemas import Georef, exact

METHODS = ("nearest", "mean", "majority")


@dataclass(frozen=True)
class Axis:
    """One axis of a source and a target lattice: offset of the source, and both pixel sizes, in common whole units."""

    offset: int
    source: int
    target: int
    count: int

    @staticmethod
    def of(offset, source: float, target: float, count: int) -> Axis:
        step, into = exact(source), exact(target)
        unit = math.lcm(step.denominator, into.denominator, offset.denominator)
        return Axis(int(offset * unit), int(step * unit), int(into * unit), count)

    @property
    def nested(self) -> bool:
        """Whether every target pixel lies in a single source pixel."""
        return self.offset % self.target == 0 and self.source % self.target == 0

    @property
    def widest(self) -> int:
        """How many target pixels one source pixel can meet."""
        return -(-self.source // self.target) + 1

    def _start(self, index: str, step: int = 0) -> str:
        return f"({self.offset}L + ({index} + {step}L) * {self.source}L)"

    def met(self, index: str) -> tuple[Column, Column]:
        """First and last target pixel that a source pixel overlaps."""
        return self._within(floor_div(self._start(index), self.target), floor_div(f"({self._start(index, 1)} - 1L)", self.target))

    def centred(self, index: str) -> tuple[Column, Column]:
        """First and last target pixel whose centre lies in a source pixel, its near border included."""
        # Twice the centre of target j is (2 j + 1) * target; it is not below twice the source's start.
        first = lambda step: floor_div(f"(2L * {self._start(index, step)} - {self.target}L + {2 * self.target}L - 1L)", 2 * self.target)
        return self._within(first(0), first(1) - 1)

    def _within(self, low: Column, high: Column) -> tuple[Column, Column]:
        return F.greatest(low, F.lit(0)), F.least(high, F.lit(self.count - 1))

    def overlap(self, index: str, into: str) -> Column:
        """Length that a source and a target pixel share."""
        low = f"greatest({self._start(index)}, {into} * {self.target}L)"
        high = f"least({self._start(index, 1)}, ({into} + 1L) * {self.target}L)"
        return F.expr(f"cast({high} - {low} as double)")


def floor_div(x: str, by: int) -> Column:
    return F.expr(f"({x} - pmod({x}, {by}L)) div {by}L")


def axes(source: Georef, target: Georef) -> tuple[Axis, Axis]:
    """The row axis, which runs down from the upper edge, and the column axis."""
    return (
        Axis.of(exact(target.y_max) - exact(source.y_max), source.px_y, target.px_y, target.n_rows),
        Axis.of(exact(source.x_min) - exact(target.x_min), source.px_x, target.px_x, target.n_cols),
    )


def _spread(df: DataFrame, name: str, span: tuple[Column, Column], widest: int) -> DataFrame:
    """One row per target index of the span; no row carries a long array."""
    if widest > CHUNK:
        return explode_range(df, name, *span)
    return df.withColumns({"_lo": span[0], "_hi": span[1]}).where("_lo <= _hi").withColumn(
        name, F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")


def _sent(pixels: DataFrame, source: Georef, target: Georef, value: str, how: str) -> DataFrame:
    """(row_idx, col_idx, v, w): every source pixel at each target pixel that it counts for, with its weight."""
    if how not in METHODS:
        raise ValueError(f"how is one of {', '.join(METHODS)}")
    down, across = axes(source, target)
    rows = pixels.select(F.col("row_idx").alias("_r"), F.col("col_idx").alias("_c"), F.col(value).cast("double").alias("v"))
    near = how == "nearest"
    for axis, index, into in ((down, "_r", "row_idx"), (across, "_c", "col_idx")):
        rows = _spread(rows, into, axis.centred(index) if near else axis.met(index), axis.widest)
    weight = F.lit(1.0) if near else down.overlap("_r", "row_idx") * across.overlap("_c", "col_idx")
    return rows.select("row_idx", "col_idx", "v", weight.alias("w"))


def _most(sent: DataFrame) -> DataFrame:
    """(row_idx, col_idx, v) with the value of the greatest weight, the smallest on a tie."""
    shares = sent.groupBy("row_idx", "col_idx", "v").agg(F.sum("w").alias("w"))
    best = shares.groupBy("row_idx", "col_idx").agg(
        F.max(F.when(F.col("v").isNotNull(), F.struct("w", (-F.col("v")).alias("less")))).alias("b"))
    return best.select("row_idx", "col_idx", (-F.col("b.less")).alias("v"))


def regrid(
    pixels: DataFrame, source: Georef, target: Georef, value: str = "value", how: str = "nearest", least_cover: float = 0.0,
) -> DataFrame:
    """(row_idx, col_idx, ``value``) of a layer on the lattice of ``target``.

    ``nearest`` takes the source pixel that holds the target pixel's centre, the lower and right one
    where the centre lies on a border. ``mean`` weighs the pixels by the area that they share, and
    ``majority`` takes the value with the largest area, the smallest on a tie. NULL values do not
    count; a target pixel that meets only such has NULL, and one that meets no pixel has no row. With
    ``mean``, less than the share ``least_cover`` of known area gives NULL too.

    ``nearest`` and lattices whose target pixels lie in single source pixels need no shuffle; others
    combine before theirs.
    """
    sent = _sent(pixels, source, target, value, how)
    down, across = axes(source, target)
    if how == "nearest" or (down.nested and across.nested):
        return sent.select("row_idx", "col_idx", F.col("v").alias(value))
    if how == "majority":
        return _most(sent).withColumnRenamed("v", value)
    known = F.sum(F.when(F.col("v").isNotNull(), F.col("w")))
    mean = F.sum(F.col("v") * F.col("w")) / known
    enough = known >= F.lit(least_cover * down.target * across.target)
    return sent.groupBy("row_idx", "col_idx").agg(F.when(enough, mean).alias(value))


def align_regridded(
    layers: dict[str, tuple[DataFrame, Georef, str]], target: Georef, how: str = "inner", value: str = "value",
) -> DataFrame:
    """One row per pixel of ``target`` with a column per layer: (pixels, lattice, method) by name.

    What the layers send to a target pixel meets in one shuffle for all of them; only ``majority``
    counts its areas first. ``how='inner'`` keeps pixels that every layer meets, ``'outer'`` all.
    """
    parts = None
    for name, (pixels, source, method) in layers.items():
        sent = _sent(pixels, source, target, value, method)
        if method == "majority" and not all(axis.nested for axis in axes(source, target)):
            sent = _most(sent).withColumn("w", F.lit(1.0))
        sent = sent.select("row_idx", "col_idx", F.lit(name).alias("layer"), "v", "w")
        parts = sent if parts is None else parts.unionByName(sent)
    of = lambda name, x: F.when(F.col("layer") == name, x)
    wide = parts.groupBy("row_idx", "col_idx").agg(
        *[(F.sum(of(name, F.col("v") * F.col("w"))) / F.sum(of(name, F.when(F.col("v").isNotNull(), F.col("w"))))).alias(name) for name in layers],
        *[F.max(of(name, F.lit(True))).alias(f"_has_{name}") for name in layers],
    )
    if how == "inner":
        wide = wide.where(" AND ".join(f"`_has_{name}`" for name in layers))
    return wide.drop(*[f"_has_{name}" for name in layers])
