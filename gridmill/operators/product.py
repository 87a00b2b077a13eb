"""The products: rasters blended over a background, and gaps filled with an adjusted background."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.operators import gridding as G
from gridmill.operators import morphology as M
from gridmill.operators import raster as R

CELL = ["cx", "cy"]


def hyperbolic(d2: str) -> Column:
    """``1 / d**2`` of a squared distance; null at the cell itself."""
    return F.when(F.col(d2) > 0, 1 / F.col(d2))


def combined(inner: str, outer: str, data: str, background: str) -> Column:
    """The mean of data and background weighted by closeness to each; what has no weight or value counts as absent."""
    a, b = F.col(inner), F.col(outer)
    both = (a * F.col(data) + b * F.col(background)) / (a + b)
    return F.coalesce(both, F.when(b.isNull(), F.col(background)), F.col(data), F.col(background))


def weights(zones: DataFrame, smooth: bool) -> DataFrame:
    """With ``wi`` and ``wo``: closeness to the data and to the background."""
    inner = F.col("shrunk") if smooth else F.col("m")
    di = M.distance(zones.select(*CELL, (1 - inner).alias("m")), "di2")
    do = M.distance(zones.select(*CELL, F.col("grown").alias("m")), "do2")
    z = zones.join(di, CELL, "left").join(do, CELL, "left")
    return z.withColumn("wi", hyperbolic("di2")).withColumn("wo", hyperbolic("do2"))


def blended(zones: DataFrame, data: DataFrame, background: DataFrame, smooth: bool = False) -> DataFrame:
    """Background outside the coverage, data inside, and in the zone between them both by their weights."""
    z = weights(zones, smooth)
    z = z.join(data.select(*CELL, F.col("v").alias("_d")), CELL, "left").join(background.select(*CELL, F.col("v").alias("_b")), CELL, "left")
    return z.select(*CELL, _by_zone("_d", "_b").alias("v"))


def filled(zones: DataFrame, sharp: DataFrame, coarse: DataFrame, footprint: dict[int, int], n: int, smooth: bool = False) -> DataFrame:
    """The sharp raster on the mask and, elsewhere, the footprint's mean of the two merged."""
    z = zones.join(sharp.select(*CELL, F.col("v").alias("_s")), CELL, "left").join(coarse.select(*CELL, F.col("v").alias("_c")), CELL, "left")
    merged = z.select(*CELL, F.when(F.col("m") == 1, F.col("_s")).otherwise(F.col("_c")).cast("int").alias("v"))
    mean = M.convolve(merged, footprint, n)
    inner = F.col("shrunk") if smooth else F.col("m")
    return z.join(mean, CELL, "left").select(*CELL, F.when(inner == 1, F.col("_s").cast("double")).otherwise(F.col("mean")).alias("v"))


def blend(mask: DataFrame, sharp: DataFrame, coarse: DataFrame, buffer: int, n: int, smooth: bool = True, percentage: float = 0.2) -> DataFrame:
    """Nearest-neighbour data blended into an interpolated surface: zones, convolution fill, weights, combination."""
    z = M.zones(mask, buffer, n, smooth, percentage)
    data = filled(z, sharp, coarse, M.disc(buffer), n, smooth)
    return blended(z, data, coarse, smooth)


STATISTICS = ("median", "q25", "q75", "min", "max")


def blend_all(
    mask: DataFrame, sharp: DataFrame, coarse: DataFrame, buffer: int, n: int, smooth: bool = True, percentage: float = 0.2, statistics: tuple[str, ...] = STATISTICS
) -> DataFrame:
    """``cx cy`` and a column for each statistic, blended as ``blend`` does; the rasters have a column for each too.

    Zones and distances are the same for all and computed once.
    """
    z = M.zones(mask, buffer, n, smooth, percentage)
    out = weights(z, smooth)
    pick = lambda r, c: r.select(*CELL, F.col(c).alias("v"))
    for s in statistics:
        data = filled(z, pick(sharp, s), pick(coarse, s), M.disc(buffer), n, smooth)
        out = out.join(data.select(*CELL, F.col("v").alias(f"_d_{s}")), CELL, "left").join(coarse.select(*CELL, F.col(s).alias(f"_b_{s}")), CELL, "left")
    return out.select(*CELL, *(_by_zone(f"_d_{s}", f"_b_{s}").alias(s) for s in statistics))


def _by_zone(data: str, background: str) -> Column:
    v = F.when(F.col("zone") == 1, combined("wi", "wo", data, background)).when(F.col("grown") == 0, F.col(background)).otherwise(F.col(data))
    return v.cast("double")


def interpolated(
    cells: DataFrame, n: int, factor: int = 4, cell: float = 2000.0, tension: float = 0.35, convergence: float = 0.01, rounds: int = 5000, upper: float = 1420.0, width: float = 6_000.0,
    window: tuple[int, int, int, int] | None = None,
) -> DataFrame:
    """The interpolated product of medians on n by n cells: a surface, smoothed, on cells ``factor`` times finer, cut to a window ``(x0, x1, y0, y1)`` of these."""
    raw = G.surface(cells, n, tension, convergence, rounds, upper)
    fine = G.resample(G.cosine_filter(raw, width, cell, n), factor, n * factor)
    return fine if window is None else R.cut(fine, *window)


def gap_fill(
    composite: DataFrame, background: DataFrame, mask: DataFrame, n: int, cell: float = 500.0, block: int = 4, buffer: int = 20, allowed: DataFrame | None = None, clean: bool = True
) -> DataFrame:
    """``cx cy v infill``: the composite, with a background that is scaled to agree with it where it has no data.

    The ratio of composite to background is reduced to block medians, spread by a spline in tension, smoothed,
    resampled to cells, and multiplied onto the background, which is then blended in.
    """
    a = R.aligned("full", c=composite, b=background, m=mask)
    ratio = a.select(*CELL, R.factor("c", "b", "m").alias("v")).filter("v IS NOT NULL")
    coarse = R.coarse_median(ratio, block)
    m = -(-n // block)
    spread = G.surface(coarse, m, tension=0.35, convergence=0.001, data_limits=True)
    smooth = G.cosine_filter(spread, 2 * block * cell, block * cell, m)
    fine = G.resample(smooth, block, n)
    b = background.join(fine.select(*CELL, F.col("v").alias("_f")), CELL, "left").withColumn("_b", F.col("v")).select(*CELL, R.adjusted("_b", "_f").alias("v"))
    used = mask if allowed is None else M.override(mask, allowed)
    z = M.zones(used, buffer, n, clean=clean)
    out = blended(z, composite, b)
    return out.join(z.select(*CELL, R.inverted("grown").alias("infill")), CELL).select(*CELL, F.col("v").cast("int").alias("v"), "infill")
