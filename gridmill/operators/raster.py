"""Rasters as cell tables ``(cx, cy, v)``; a missing row is no data. Aligned joins, masks, logic, pyramids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.config import Grid
from gridmill.operators.blocks import with_cell

CELL = ["cx", "cy"]


def first_in_cell(points: DataFrame, grid: Grid, value: str, order: list[str]) -> DataFrame:
    """The value of each cell's first point in the given order."""
    return with_cell(points, grid).groupBy(*CELL).agg(F.min(F.struct(*order, value))[value].alias("v"))


def first_per_position(points: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each position ``(x, y)``, both parts of the key kept apart."""
    w = Window.partitionBy("x", "y").orderBy(*order)
    return points.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def with_precedence(*layers: DataFrame) -> DataFrame:
    """All layers, with their place as ``priority``, 1 first."""
    out = layers[0].withColumn("priority", F.lit(1))
    for i, layer in enumerate(layers[1:], 2):
        out = out.unionByName(layer.withColumn("priority", F.lit(i)))
    return out


def aligned(how: str = "full", **layers: DataFrame) -> DataFrame:
    """Layers of the same grid side by side, a column for each."""
    out = None
    for name, layer in layers.items():
        layer = layer.select(*CELL, F.col([c for c in layer.columns if c not in CELL][0]).alias(name))
        out = layer if out is None else out.join(layer, CELL, how)
    return out


def priority_merge(*layers: DataFrame, default: int | None = None) -> DataFrame:
    """The value of the topmost layer that has one; layers are given from the top."""
    names = [f"l{i}" for i in range(len(layers))]
    a = aligned("full", **dict(zip(names, layers)))
    fill = [F.lit(default)] if default is not None else []
    return a.select(*CELL, F.coalesce(*names, *fill).alias("v"))


def finite_mask(cells: DataFrame, raster: DataFrame) -> DataFrame:
    """1 where the raster has a value, over all given cells."""
    r = raster.select(*CELL, F.col("v").alias("_v"))
    return cells.join(r, CELL, "left").select(*CELL, F.col("_v").isNotNull().cast("int").alias("m"))


def not_static(rid: str) -> Column:
    """Cells of data, not of static topography (300 to 399, or 401)."""
    r = F.col(rid)
    return (r < 300) | (r == 400) | (r > 401)


def ice_mask(ice: str, rid: str) -> Column:
    return F.when((F.col(ice) > 0) & not_static(rid), 1).otherwise(0)


def ocean_mask(ice_m: str, rid: str) -> Column:
    return F.when((F.col(ice_m) == 0) & not_static(rid), 1).otherwise(0)


def corrected(elevation: str, ice_m: str, ocean_m: str) -> Column:
    """Elevation made to agree with the masks: no land in the ocean, no sea on bare land."""
    a = F.col(elevation)
    return F.when(F.col(ocean_m) == 1, F.least(a, F.lit(-1))).when((a < 0) & (F.col(ice_m) == 0), F.lit(1)).otherwise(a)


def substituted(bed: str, surface: str, ice_m: str) -> Column:
    return F.when(F.col(ice_m) == 0, F.col(bed)).when(F.col(ice_m) == 1, F.col(surface))


def within(value: str, mask: str) -> Column:
    return F.when(F.col(mask) == 1, F.col(value))


def spread(q25: str, q75: str) -> Column:
    """A standard deviation from the quartiles, as of a normal distribution."""
    return (F.col(q75) - F.col(q25)) / 1.35


def infill(mask: str, value: int) -> Column:
    return F.when(F.col(mask) == 1, F.lit(value))


def cells_per_rid(rids: DataFrame, lowest: int = 10_000, ocean: DataFrame | None = None) -> DataFrame:
    r = rids.filter(F.col("v") >= lowest)
    if ocean is not None:
        r = r.join(ocean.filter("m = 1").select(*CELL), CELL, "left_semi")
    return r.groupBy(F.col("v").alias("rid")).agg(F.count("*").alias("n_cells"))


def data_cells(rids: DataFrame, lowest: int = 10_000, ocean: DataFrame | None = None) -> DataFrame:
    """How many cells hold data, and of how many datasets."""
    c = cells_per_rid(rids, lowest, ocean)
    return c.agg(F.coalesce(F.sum("n_cells"), F.lit(0)).alias("n_cells"), F.count("*").alias("n_rids"))


def pyramid(raster: DataFrame, levels: int) -> DataFrame:
    """Means of 2 by 2, 4 by 4 and so on, each of the level below it."""
    out, level = None, raster.select(*CELL, F.col("v").cast("double").alias("v"))
    for k in range(1, levels + 1):
        level = level.groupBy(F.floor(F.col("cx") / 2).cast("int").alias("cx"), F.floor(F.col("cy") / 2).cast("int").alias("cy")).agg(F.avg("v").alias("v"))
        part = level.withColumn("level", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def coarse_median(raster: DataFrame, block: int) -> DataFrame:
    """The exact median of each block of cells."""
    at = lambda c: F.floor(F.col(c) / block).cast("int").alias(c)
    return raster.groupBy(at("cx"), at("cy")).agg(F.percentile("v", F.lit(0.5)).alias("v"))


def statistics(raster: DataFrame) -> DataFrame:
    v = F.col("v")
    return raster.agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"))


def cut(raster: DataFrame, x0: int, x1: int, y0: int, y1: int) -> DataFrame:
    """The cells of a window, ends included."""
    return raster.filter(F.col("cx").between(x0, x1) & F.col("cy").between(y0, y1))


def cell_tile(grid: Grid) -> Column:
    """The tile that holds a cell's centre."""
    per = grid.tile // grid.cell
    return (F.floor(F.col("cx") / per) + grid.tiles * F.floor(F.col("cy") / per) + 1).cast("int")


def in_area(raster: DataFrame, tiles: DataFrame, grid: Grid) -> DataFrame:
    """Cells in any of the tiles ``(tile_id)``."""
    return raster.withColumn("tile_id", cell_tile(grid)).join(tiles.select("tile_id"), "tile_id", "left_semi").drop("tile_id")


def factor(composite: str, background: str, mask: str, low: float = 0.5, high: float = 1.5) -> Column:
    """Composite over background where the mask is 1, held between low and high; null elsewhere or over 0."""
    c, b = F.col(composite), F.col(background)
    return F.when((F.col(mask) == 1) & (b != 0), F.least(F.greatest(c / F.when(b != 0, b), F.lit(low)), F.lit(high)))


def adjusted(background: str, by: str) -> Column:
    """The background times a factor, to whole metres toward zero; unchanged where there is no factor."""
    return (F.col(background) * F.coalesce(F.col(by), F.lit(1.0))).cast("int")


def inverted(mask: str) -> Column:
    return 1 - F.col(mask)
