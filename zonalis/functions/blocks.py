"""Square blocks of pixels with a one-pixel border, for operators that look at neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256


def add_block(pixels: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add the block position (br, bc) of each pixel."""
    return pixels.withColumns({
        "br": F.expr(f"row_idx div {block}"), "bc": F.expr(f"col_idx div {block}")})


def with_halo(pixels: DataFrame, block: int = BLOCK) -> DataFrame:
    """Send every pixel to its block and border pixels also to the blocks next to it.

    ``core`` tells the owner's copy from the others. Rows end up partitioned by block, which serves
    every later window keyed by (br, bc, ...) without another shuffle, and no group is larger than
    a block with its border.
    """
    around = lambda c: F.explode(F.expr(f"sequence(greatest({c} - 1, 0) div {block}, ({c} + 1) div {block})"))
    return (
        pixels.withColumn("br", around("row_idx")).withColumn("bc", around("col_idx"))
        .withColumn("core", F.expr(f"br = row_idx div {block} AND bc = col_idx div {block}"))
        .repartition("br", "bc")
    )


class Line:
    """The neighbours of a pixel along its row or column within a block, absent ones as NULL."""

    def __init__(self, along: str):
        across = {"col_idx": "row_idx", "row_idx": "col_idx"}[along]
        # The key with the most values comes first: rows are sorted by it almost alone.
        self.window = Window.partitionBy(across, "br", "bc").orderBy(along)
        self.along = along

    def position(self, step: int) -> Column:
        """Index of the next stored pixel in that direction, adjacent or not."""
        shift = F.lead if step > 0 else F.lag
        return shift(self.along).over(self.window)

    def value(self, name: str, step: int) -> Column:
        """Value of the next stored pixel in that direction, adjacent or not."""
        shift = F.lead if step > 0 else F.lag
        return shift(name).over(self.window)

    def adjacent(self, name: str, step: int) -> Column:
        """Value of the pixel exactly one step away, NULL if there is none."""
        return F.when(self.position(step) == F.col(self.along) + step, self.value(name, step))
