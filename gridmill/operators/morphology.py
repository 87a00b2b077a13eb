"""Masks as sparse sets of cells ``(cx, cy)``: dilation, erosion, closing, transition zones, distances, convolution.

A footprint is a half-width for each row offset. Sets are handled as runs of cells in a row: a run grows to one span
for each row of the footprint, and overlapping spans of a row merge. A footprint of radius 20 thus costs 41 rows a
run instead of 1305 a cell, and there is no join with a table of offsets.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL = ["cx", "cy"]


def disc(b: int) -> dict[int, int]:
    """The disc ``x*x + y*y <= b*b + b//2``: half-width by row offset."""
    r = b * b + b // 2
    return {dy: isqrt(r - dy * dy) for dy in range(-isqrt(r), isqrt(r) + 1)}


def square(b: int) -> dict[int, int]:
    return {dy: b for dy in range(-b, b + 1)}


def offsets(spark, footprint: dict[int, int]) -> DataFrame:
    """The footprint as rows ``(dx, dy)``."""
    return spark.createDataFrame([(dx, dy) for dy, w in footprint.items() for dx in range(-w, w + 1)], "dx int, dy int")


def grid_cells(spark, n: int) -> DataFrame:
    return spark.range(n * n).select((F.col("id") % n).cast("int").alias("cx"), F.floor(F.col("id") / n).cast("int").alias("cy"))


def ones(mask: DataFrame) -> DataFrame:
    return mask.filter("m = 1").select(*CELL)


def _runs(cells: DataFrame) -> DataFrame:
    run = F.col("cx") - F.row_number().over(Window.partitionBy("cy").orderBy("cx"))
    return cells.withColumn("r", run).groupBy("cy", "r").agg(F.min("cx").alias("x0"), F.max("cx").alias("x1")).drop("r")


def _merged(spans: DataFrame) -> DataFrame:
    w = Window.partitionBy("cy").orderBy("x0", "x1")
    before = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = spans.withColumn("new", F.when(F.col("x0") <= before + 1, 0).otherwise(1))
    s = s.withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("cy", "g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("g")


def dilate(cells: DataFrame, footprint: dict[int, int], n: int) -> DataFrame:
    """The cells reached by the footprint from any cell of the set, inside an n by n grid."""
    arms = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(w).alias("w")) for dy, w in footprint.items()))
    spans = _runs(cells).withColumn("a", F.explode(arms)).select((F.col("cy") + F.col("a.dy")).alias("cy"), F.greatest(F.lit(0), F.col("x0") - F.col("a.w")).alias("x0"), F.least(F.lit(n - 1), F.col("x1") + F.col("a.w")).alias("x1"))
    spans = _merged(spans.filter(f"cy >= 0 AND cy < {n} AND x0 <= x1"))
    return spans.select(F.explode(F.sequence("x0", "x1")).alias("cx"), "cy").select(F.col("cx").cast("int").alias("cx"), F.col("cy").cast("int").alias("cy"))


def complement(cells: DataFrame, n: int) -> DataFrame:
    return grid_cells(cells.sparkSession, n).join(cells, CELL, "left_anti")


def erode(cells: DataFrame, footprint: dict[int, int], n: int, border: int) -> DataFrame:
    """The cells whose whole footprint is in the set; what lies outside the grid counts as ``border``."""
    out = complement(dilate(complement(cells, n), footprint, n), n)
    if border:
        return out
    bx, by = max(footprint.values()), max(footprint)
    return out.filter(F.col("cx").between(bx, n - 1 - bx) & F.col("cy").between(by, n - 1 - by))


def close(cells: DataFrame, buffer: int, n: int, divisor: int = 5) -> DataFrame:
    """Small holes filled: dilation, then erosion, by a disc of ``buffer // divisor`` or a square of 3 if that is 0."""
    b = buffer // divisor
    fp = disc(b) if b else square(1)
    return erode(dilate(cells, fp, n), fp, n, 1)


def smooth_radii(buffer: int, percentage: float) -> tuple[int, int]:
    """Radii of erosion and dilation of the smooth transition zone."""
    size = 2 * buffer + 1
    inner = max(3, int(np.rint(size * percentage)))
    outer = size - inner
    return inner, outer + (outer % 2 == 0)


def override(mask: DataFrame, allowed: DataFrame) -> DataFrame:
    """The mask set to 1 where the background must not be used (``allowed`` is 0)."""
    a = allowed.select(*CELL, F.col("m").alias("_a"))
    return mask.join(a, CELL, "left").select(*CELL, F.when(F.col("_a") == 0, 1).otherwise(F.col("m")).alias("m"))


def zones(mask: DataFrame, buffer: int, n: int, smooth: bool = False, percentage: float = 0.0, clean: bool = False) -> DataFrame:
    """``cx cy m grown shrunk zone`` over the whole grid: the mask, its dilation and erosion, and the transition zone."""
    data = ones(mask)
    if smooth:
        inner, outer = smooth_radii(buffer, percentage)
        grown, shrunk = dilate(data, disc(outer), n), erode(data, disc(inner), n, 1)
    else:
        grown, shrunk = dilate(data, disc(buffer), n), data
        if clean:
            grown = close(grown, buffer, n)
    z = grid_cells(mask.sparkSession, n)
    for name, cells in (("m", data), ("grown", grown), ("shrunk", shrunk)):
        z = z.join(cells.withColumn(name, F.lit(1)), CELL, "left")
    z = z.fillna(0, ["m", "grown", "shrunk"])
    inner = F.col("shrunk") if smooth else F.col("m")
    return z.withColumn("zone", F.when(F.col("grown") != inner, 1).otherwise(0))


def distance(mask: DataFrame, name: str = "d2") -> DataFrame:
    """For every cell of a complete mask the squared distance to the nearest cell with ``m = 0``; null if there is none.

    Exact and separable: nearest zero in the column by windows, then along the row the least of gap squared plus
    step squared. The row pass runs on numpy rows in groups, and looks no further than the distances found so far.
    """
    up = Window.partitionBy("cx").orderBy("cy").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("cx").orderBy("cy").rowsBetween(0, Window.unboundedFollowing)
    zero = F.when(F.col("m") == 0, F.col("cy"))
    g = F.least(F.col("cy") - F.last(zero, True).over(up), F.first(zero, True).over(down) - F.col("cy"))
    gaps = mask.select(*CELL, g.cast("long").alias("g")).withColumn("band", F.floor(F.col("cy") / 16))

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = pdf["cx"].min(), pdf["cy"].min()
        shape = (pdf["cy"].max() - y0 + 1, pdf["cx"].max() - x0 + 1)
        far = np.int64(1) << 50
        start = np.full(shape, far)
        g = pdf["g"].to_numpy(dtype=float)
        i, j = (pdf["cy"] - y0).to_numpy(), (pdf["cx"] - x0).to_numpy()
        start[i, j] = np.where(np.isnan(g), far, np.nan_to_num(g) ** 2).astype(np.int64)
        best = start.copy()
        for step in range(1, shape[1]):
            if step * step >= best.max():
                break
            np.minimum(best[:, step:], start[:, :-step] + step * step, out=best[:, step:])
            np.minimum(best[:, :-step], start[:, step:] + step * step, out=best[:, :-step])
        out = best[i, j]
        return pd.DataFrame({"cx": pdf["cx"], "cy": pdf["cy"], name: pd.Series(out).where(out < far).astype("Int64").to_numpy()})

    return gaps.groupBy("band").applyInPandas(rows, f"cx int, cy int, {name} long")


def convolve(raster: DataFrame, footprint: dict[int, int], n: int, value: str = "v") -> DataFrame:
    """The mean over the footprint at every cell, the grid mirrored at its edges.

    Row sums of each half-width come from range windows; a cell then adds one of them for each row of the footprint.
    """
    r = max(max(footprint.values()), max(footprint))
    image = lambda c: F.filter(F.array(F.col(c), -F.col(c) - 1, F.lit(2 * n - 1) - F.col(c)), lambda x: (x >= -r) & (x < n + r))
    wide = raster.filter(F.col(value).isNotNull()).select(F.explode(image("cx")).alias("cx"), "cy", F.col(value).alias("v"))
    wide = wide.select("cx", F.explode(image("cy")).alias("cy"), "v")
    sums = []
    for w in sorted(set(footprint.values())):
        row = Window.partitionBy("cy").orderBy("cx").rangeBetween(-w, w)
        sums += [F.sum("v").over(row).alias(f"s{w}"), F.count("v").over(row).alias(f"n{w}")]
    wide = wide.select("cx", "cy", *sums).filter(F.col("cx").between(0, n - 1))
    arms = F.array(*(F.struct((F.col("cy") - dy).alias("cy"), F.col(f"s{w}").cast("double").alias("s"), F.col(f"n{w}").alias("n")) for dy, w in footprint.items()))
    each = wide.select("cx", F.explode(arms).alias("a")).select("cx", "a.*").filter(F.col("cy").between(0, n - 1))
    return each.groupBy(*CELL).agg((F.sum("s") / F.sum("n")).alias("mean"))
