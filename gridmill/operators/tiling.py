"""Points to tiles, and what is known by tile and by dataset.

The tile index is arithmetic on the coordinates, so the range join of points with boxes is a projection. Tiles are
open below and closed above, but the lowest edge belongs to the first tile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.config import Grid

LOWEST = -9_999


def _inside(c: Column, grid: Grid) -> Column:
    """Whether a place on an axis is in a tile."""
    steps = (c - grid.low) / F.lit(grid.tile)
    return ((steps > 0) | (c == grid.low)) & (steps <= grid.tiles)


def tile_index(c: Column, grid: Grid) -> Column:
    """The index along one axis; null outside the area."""
    i = F.ceil((c - grid.low) / F.lit(grid.tile)).cast("long") - 1
    return F.when(_inside(c, grid), F.greatest(i, F.lit(0)))


def with_tile(points: DataFrame, grid: Grid) -> DataFrame:
    """With ``tile_id`` and ``basic_tile``, null outside the area."""
    p = points.withColumn("_tx", tile_index(F.col("x"), grid)).withColumn("_ty", tile_index(F.col("y"), grid))
    tile = F.col("_tx") + grid.tiles * F.col("_ty") + 1
    basic = F.floor(F.col("_tx") / grid.basic) + grid.basics * F.floor(F.col("_ty") / grid.basic) + 1
    return p.withColumn("tile_id", tile.cast("int")).withColumn("basic_tile", basic.cast("int")).drop("_tx", "_ty")


def included(points: DataFrame, metadata: DataFrame) -> DataFrame:
    """Points of datasets that are marked for use; unknown datasets are out. The key set is small against the points, and the engine broadcasts it by its size."""
    keys = metadata.filter("include = 1").select(F.col("dataset_rid").alias("rid"))
    return points.join(keys, "rid", "left_semi")


def assigned(points: DataFrame, grid: Grid, tiles: DataFrame | None = None) -> DataFrame:
    """Every point with its tile and ``reason``: null, ``null``, ``outside``, ``no_tile`` (a gap in the given tiles) or ``depth``.

    The reason is said of the coordinates, not of the tile: a filter on it is pushed down with all it is made of, and
    made of the tile's number it is too much code for the JVM to compile.
    """
    p = with_tile(points, grid)
    if tiles is not None:
        known = tiles.select(F.col("ID").cast("int").alias("_id"))
        p = p.join(known, p["tile_id"] == known["_id"], "left")
        gap = F.col("_id").isNull()
    else:
        gap = F.lit(False)
    reason = (
        F.when(F.col("x").isNull() | F.col("y").isNull() | F.col("z").isNull(), "null")
        .when(~(_inside(F.col("x"), grid) & _inside(F.col("y"), grid)), "outside")
        .when(gap, "no_tile")
        .when(F.col("z") <= LOWEST, "depth")
    )
    return p.withColumn("reason", reason).drop("_id")


def tiled(points: DataFrame, grid: Grid, tiles: DataFrame | None = None) -> DataFrame:
    if tiles is not None:
        return assigned(points, grid, tiles).filter("reason IS NULL").drop("reason")
    here = _inside(F.col("x"), grid) & _inside(F.col("y"), grid) & ~(F.col("z") <= LOWEST)  # as assigned, null is not
    return with_tile(points.filter(here), grid)


def tile_rejects(points: DataFrame, grid: Grid, tiles: DataFrame | None = None) -> DataFrame:
    return assigned(points, grid, tiles).filter("reason IS NOT NULL")


def extents(points: DataFrame, *keys: str) -> DataFrame:
    return points.groupBy(*keys).agg(*(f(c).alias(f"{c}{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))


def extents_of_splits(splits: DataFrame) -> DataFrame:
    """The extents of each dataset from those of its splits, and the mean of the times at which they were tiled."""
    ends = [f(c + e).alias(c + e) for c in "xyz" for e, f in (("min", F.min), ("max", F.max))]
    return splits.groupBy("rid").agg(*ends, F.avg("time_tiling").alias("time_tiling"))


def rids_by_tile(points: DataFrame) -> DataFrame:
    """The datasets of each tile as a list in text, and how many they are. Partial sets are merged, so a shuffle row is a tile's set and not a point."""
    pairs = points.select("tile_id", "basic_tile", "rid").distinct()
    rids = F.array_sort(F.collect_list("rid"))
    return pairs.groupBy("tile_id", "basic_tile").agg(F.array_join(rids, ";").alias("cruises"), F.count("*").alias("n_cruises"))


def weights_by_tile(tiles: DataFrame, metadata: DataFrame) -> DataFrame:
    """Sum and mean of the weights of the datasets in each tile's list; 0 where none is known."""
    one = tiles.select("tile_id", F.explode_outer(F.split("cruises", ";")).alias("rid")).withColumn("rid", F.col("rid").try_cast("long"))
    w = metadata.select(F.col("dataset_rid").alias("rid"), "weight")
    got = one.join(w, "rid", "left").groupBy("tile_id").agg(F.sum("weight").alias("s"), F.avg("weight").alias("a"))
    return got.select("tile_id", F.coalesce("s", F.lit(0)).cast("long").alias("sum_weight"), F.round(F.coalesce("a", F.lit(0.0)), 6).alias("avg_weight"))


def unique_tiles(points: DataFrame) -> DataFrame:
    return points.select("tile_id", "basic_tile").distinct().orderBy("tile_id")
