"""Comparison of rasters: pairs, binned means, moving averages, distributions, discrepancies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions import text as X
from gridmill.operators import raster as R

CELL = ["cx", "cy"]


def pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells with a value in both, ``cx cy x y``."""
    return R.aligned("inner", x=a, y=b).dropna()


def ranged(p: DataFrame, column: str, parts: int | None = None) -> DataFrame:
    """With ``_part``, about as many equal shares of the rows as there are shuffle partitions, in order of a numeric column; equal values are in one."""
    parts = parts or int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = sorted({e for e in p.approxQuantile(column, [k / parts for k in range(1, parts)], 0.25 / parts)}) if parts > 1 else []
    part = F.lit(0)
    for e in edges:
        part = part + (F.col(column) > F.lit(e)).cast("int")
    return p.withColumn("_part", F.coalesce(part, F.lit(-1)))


def sequenced(p: DataFrame, *order: str, parts: int | None = None) -> DataFrame:
    """With ``seq`` from 0 in the given order, without a sort in one task.

    Rows are ranged on the first order column by its quantiles; each range numbers its own rows and adds the sizes of those before it.
    """
    p = ranged(p, order[0], parts)
    sizes = p.groupBy("_part").count().withColumn("_base", F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["_base"])
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return p.withColumn("_r", rank).join(F.broadcast(sizes), "_part").withColumn("seq", F.col("_base") + F.col("_r")).drop("_part", "_r", "_base", "count")


def binned(p: DataFrame, width: int) -> DataFrame:
    """Means of x and y and their difference in bins of rows; the first bin has one row less."""
    return _means(p, F.floor((F.col("seq") + 1) / width).cast("long"))


def chunked(p: DataFrame, width: int) -> DataFrame:
    return _means(p, F.floor(F.col("seq") / width).cast("long"))


def _means(p: DataFrame, at) -> DataFrame:
    m = p.groupBy(at.alias("bin")).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n"))
    return m.select("bin", F.round("mx", 6).alias("x"), F.round("my", 6).alias("y"), F.round(F.col("my") - F.col("mx"), 6).alias("diff"), "n")


def value_bins(p: DataFrame, step: int) -> DataFrame:
    """Means in bins of x of the given width."""
    b = F.floor(F.col("x") / step)
    return p.groupBy((b * step).cast("long").alias("bin")).agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"), F.count("*").alias("n"))


def moving(p: DataFrame, before: int, after: int, *keys: str) -> DataFrame:
    """The mean of y over the neighbours in order of seq, within each key."""
    w = Window.partitionBy(*keys).orderBy("seq").rowsBetween(-before, after)
    return p.withColumn("mean", F.round(F.avg("y").over(w), 6))


def histogram(p: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins numbered from 1; 0 and bins + 1 hold what is below and above."""
    b = F.width_bucket(F.col(column).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).cast("int")
    return p.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def ecdf(p: DataFrame, column: str) -> DataFrame:
    """The share of rows at or below each distinct value: counts first, then running sums within ranges of values, each from the sum of the ranges before it."""
    c = ranged(p.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")), "value")
    sizes = c.groupBy("_part").agg(F.sum("n").alias("m"))
    before = F.sum("m").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("base"), F.sum("m").over(Window.partitionBy(F.lit(1))).alias("t"))  # a row a range
    run = F.sum("n").over(Window.partitionBy("_part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    return c.withColumn("r", run).join(F.broadcast(sizes), "_part").select("value", F.round((F.col("base") + F.col("r")) / F.col("t"), 9).alias("share"))


def density(p: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """The density of a column in equal bins: the share of all rows by unit of the column, with the middle of each bin; empty bins have none."""
    c, width = F.col(column).cast("double"), (high - low) / bins
    total = p.agg(F.count(column).alias("t"))
    b = histogram(p.filter(c.isNotNull()), column, low, high, bins).filter(F.col("bin").between(1, bins)).crossJoin(F.broadcast(total))
    return b.select("bin", (low + (F.col("bin") - 0.5) * width).alias("middle"), F.round(F.col("n") / F.col("t") / width, 12).alias("density"))


def moving_sorted(p: DataFrame, before: int, after: int, *order: str) -> DataFrame:
    """``seq x mean``: the rows of the whole series in order of x, with the mean of y over a row and its neighbours.

    Each range of rows gets copies of the rows next to it, so no range waits for another.
    """
    s = sequenced(p, *(order or ("x", "y"))).select("seq", "x", "y")
    size = max(4096, before + after)
    own = F.floor(F.col("seq") / size)
    homes = F.sequence(F.floor((F.col("seq") - after) / size), F.floor((F.col("seq") + before) / size))
    s = s.select("*", own.alias("own"), F.explode(homes).alias("home"))
    w = Window.partitionBy("home").orderBy("seq").rowsBetween(-before, after)
    return s.withColumn("mean", F.round(F.avg("y").over(w), 6)).filter("own = home").select("seq", "x", "mean")


def summary(p: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return p.agg(F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.round(F.avg(c), 6).alias("mean"), F.round(F.percentile(c, F.lit(0.5)), 6).alias("median"))


def discrepancy(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(y - x) / mean(x, y)`` by cell; null where the mean is 0."""
    p = pairs(a, b)
    mean = (F.col("x") + F.col("y")) / 2
    return p.select(*CELL, F.round(F.when(mean != 0, (F.col("y") - F.col("x")) / mean), 9).alias("discrepancy"))


def area_tiles(areas: DataFrame) -> DataFrame:
    """Areas ``(name, tiles)`` as one row for each tile."""
    return areas.select("name", F.explode(X.tile_list(F.col("tiles"))).alias("tile_id"))


def area_discrepancy(a: DataFrame, b: DataFrame, areas: DataFrame, grid) -> DataFrame:
    """Cells and mean discrepancy of each area. The areas' tiles are few against the cells."""
    d = discrepancy(a, b).withColumn("tile_id", R.cell_tile(grid))
    j = d.join(area_tiles(areas), "tile_id")
    return j.groupBy("name").agg(F.count("*").alias("n"), F.round(F.avg("discrepancy"), 6).alias("mean"))
