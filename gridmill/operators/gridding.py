"""From points and coarse rasters to rasters: nearest neighbours, filters, resampling, reprojection, surfaces."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.config import Grid
from gridmill.sources.files import kept

CELL = ["cx", "cy"]


def _nearest(grid: Grid, radius: float, slots: int):
    """What ``mapInArrow`` needs to cut points down to the nearest of each cell and quadrant, as far as a table of so many slots holds them.

    A cell and quadrant has one slot, which it may share with others. A point goes on only if it beats what the slot
    has of the same cell and quadrant; what leaves a slot is handed out, and so is all at the end. So no candidate is
    lost, and memory doesn't grow with the points. Depths are compared as integers in the order of the doubles, null first.
    """
    none = np.iinfo(np.int64).min
    turned = lambda b: np.where(b < 0, b ^ np.iinfo(np.int64).max, b)

    def along(at):
        """For each place on an axis the cells whose centres may be within reach, a row for each, and the distances; None outside the grid."""
        first = np.ceil((at - radius - grid.low) / grid.cell - 0.5 - 1e-6).clip(-1e9, 1e9).astype(np.int64)
        for k in range(int(2 * radius / grid.cell) + 2):
            c = first + k
            yield c, at - (c * grid.cell + grid.low + grid.cell / 2), (c >= 0) & (c < grid.cells)

    def first_of(key, d2, z):
        """Of each key the nearest, of these the least z."""
        order = np.lexsort((z, d2, key))
        key = key[order]
        order = order[np.diff(key, prepend=-1) != 0]
        return order

    def handed(key, d2, z):
        cell = key // 4
        depth = turned(z).view(np.float64)
        return pa.RecordBatch.from_arrays([pa.array(cell % grid.cells), pa.array(cell // grid.cells), pa.array((key % 4).astype(np.int32)), pa.array(d2), pa.array(depth, mask=z == none)], ["cx", "cy", "s", "d2", "z"])

    def run(batches):
        keys, nearest, depths = np.full(slots, -1), np.full(slots, np.inf), np.full(slots, none)
        for batch in batches:
            x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            z = batch.column(2)
            depth = z.fill_null(0.0).to_numpy(zero_copy_only=False) + 0.0  # one zero
            depth = turned(np.where(np.isnan(depth), np.nan, depth).view(np.int64))
            depth[z.is_null().to_numpy(zero_copy_only=False)] = none
            rows = list(along(y))
            found = []
            for cx, dx, there in along(x):
                for cy, dy, here in rows:
                    d2 = dx * dx + dy * dy
                    i = np.flatnonzero(there & here & (d2 <= radius * radius))
                    quadrant = np.where(dx[i] >= 0, np.where(dy[i] >= 0, 0, 3), np.where(dy[i] >= 0, 1, 2))
                    key, d2, zi = (cy[i] * grid.cells + cx[i]) * 4 + quadrant, d2[i], depth[i]
                    at = key % slots
                    better = (keys[at] != key) | (d2 < nearest[at]) | ((d2 == nearest[at]) & (zi < depths[at]))
                    found.append((key[better], d2[better], zi[better]))
            key, d2, zi = (np.concatenate(c) for c in zip(*found))
            at = np.unique(key % slots)
            at = at[keys[at] >= 0]
            key, d2, zi = np.concatenate([key, keys[at]]), np.concatenate([d2, nearest[at]]), np.concatenate([zi, depths[at]])
            order = first_of(key, d2, zi)
            key, d2, zi = key[order], d2[order], zi[order]
            at, stays = np.unique(key % slots, return_index=True)
            keys[at], nearest[at], depths[at] = key[stays], d2[stays], zi[stays]
            leaves = np.ones(len(key), bool)
            leaves[stays] = False
            if leaves.any():
                yield handed(key[leaves], d2[leaves], zi[leaves])
        at = np.flatnonzero(keys >= 0)
        yield handed(keys[at], nearest[at], depths[at])

    return run


def nearest_neighbour(points: DataFrame, grid: Grid, radius: float = 1000.0, min_sectors: int = 4, slots: int = 1 << 20) -> DataFrame:
    """At each cell centre the weighted mean of the nearest point of each quadrant within the radius.

    Weights are ``1 / (1 + (3 d / radius)**2)``; cells with fewer than ``min_sectors`` quadrants have no value. A
    point belongs to the centres in its circle. Each task keeps the nearest of a cell and quadrant before anything is
    sorted or sent (Spark sorts rows for a minimum of structs), so what is sent grows with cells and tasks, not with
    points, on areas of up to ``slots / 4`` cells.
    """
    p = points.filter("x IS NOT NULL AND y IS NOT NULL").select(*(F.col(c).cast("double") for c in "xyz"))
    near = p.mapInArrow(_nearest(grid, float(radius), slots), "cx long, cy long, s int, d2 double, z double")
    best = near.groupBy("cx", "cy", "s").agg(F.min(F.struct("d2", "z")).alias("b"))
    w = 1 / (1 + 9 * F.col("b.d2") / (radius * radius))
    out = best.groupBy("cx", "cy").agg(F.count("*").alias("n"), (F.sum(w * F.col("b.z")) / F.sum(w)).alias("v")).filter(F.col("n") >= min_sectors)
    return out.select(F.col("cx").cast("int").alias("cx"), F.col("cy").cast("int").alias("cy"), "v")


def blockwise(raster: DataFrame, n: int, halo: int, run, block: int = 1024) -> DataFrame:
    """``run(data, x0, y0)`` for each block of an n by n raster that holds or borders on a value.

    ``data`` is the block with a halo around it, NaN where there is no value, and ``x0, y0`` its lowest cell; ``run``
    gives rows ``(cx, cy, v)`` as arrays. A cell is sent to its own block and to those it is in the halo of.
    """
    top = -(-n // block) - 1
    lo = lambda c: F.greatest(F.lit(0), F.floor((F.col(c) - halo) / block).cast("int"))
    hi = lambda c: F.least(F.lit(top), F.floor((F.col(c) + halo) / block).cast("int"))
    homes = raster.filter("v IS NOT NULL").select("cx", "cy", F.col("v").cast("double").alias("v"), F.explode(F.sequence(lo("cx"), hi("cx"))).alias("bx"), F.sequence(lo("cy"), hi("cy")).alias("bys"))
    homes = homes.select("cx", "cy", "v", "bx", F.explode("bys").alias("by"))

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(pdf["bx"].iloc[0]) * block, int(pdf["by"].iloc[0]) * block
        data = np.full((min(block, n - y0) + 2 * halo, min(block, n - x0) + 2 * halo), np.nan)
        data[pdf["cy"].to_numpy() - y0 + halo, pdf["cx"].to_numpy() - x0 + halo] = pdf["v"]
        cx, cy, v = run(data, x0, y0)
        return pd.DataFrame({"cx": cx.astype(np.int32), "cy": cy.astype(np.int32), "v": v})

    return homes.groupBy("bx", "by").applyInPandas(each, "cx int, cy int, v double")


def cosine_filter(raster: DataFrame, width: float, cell: float, n: int) -> DataFrame:
    """The mean over a disc of the given width, weighted ``1 + cos(pi d / r)``, over the cells that have a value."""
    r = width / 2
    k = int(r // cell)
    steps = [(dx, dy, 1 + math.cos(math.pi * math.hypot(dx, dy) * cell / r)) for dx in range(-k, k + 1) for dy in range(-k, k + 1) if math.hypot(dx, dy) * cell <= r]

    def run(data, x0, y0):
        rows, columns = data.shape[0] - 2 * k, data.shape[1] - 2 * k
        there = ~np.isnan(data)
        data = np.where(there, data, 0.0)
        s, total = np.zeros((rows, columns)), np.zeros((rows, columns))
        for dx, dy, w in steps:
            if w > 0:
                s += w * data[k + dy : k + dy + rows, k + dx : k + dx + columns]
                total += w * there[k + dy : k + dy + rows, k + dx : k + dx + columns]
        y, x = np.nonzero(total > 0)
        return x + x0, y + y0, s[y, x] / total[y, x]

    return blockwise(raster, n, k, run)


def _cubic(t):
    """Weights of the four neighbours of a place t beyond the second (cubic convolution, a = -1/2)."""
    t2, t3 = t * t, t * t * t
    return [(-t3 + 2 * t2 - t) / 2, (3 * t3 - 5 * t2 + 2) / 2, (-3 * t3 + 4 * t2 + t) / 2, (t3 - t2) / 2]


def resample(raster: DataFrame, factor: int, n: int) -> DataFrame:
    """A coarse raster on n by n cells ``factor`` times finer, by cubic convolution over the neighbours that have a value.

    A cell whose neighbours with a value have a quarter of the weights or less has none.
    """
    m = -(-n // factor)

    def along(first: int, cells: int):
        """Of fine cells the second of their four coarse neighbours and the weights of all."""
        u = (np.arange(first * factor, min(n, (first + cells) * factor)) + 0.5) / factor - 0.5
        base = np.floor(u).astype(int)
        return base, _cubic(u - base)

    def run(data, x0, y0):
        there = ~np.isnan(data)
        data = np.where(there, data, 0.0)
        (bx, wx), (by, wy) = along(x0, data.shape[1] - 4), along(y0, data.shape[0] - 4)
        s, total = np.zeros((len(by), len(bx))), np.zeros((len(by), len(bx)))
        for i in range(4):
            for j in range(4):
                at = np.ix_(by - y0 + 2 + i - 1, bx - x0 + 2 + j - 1)
                w = wy[i][:, None] * wx[j][None, :]
                s += w * data[at]
                total += w * there[at]
        y, x = np.nonzero(np.abs(total) > 0.25)
        return x + x0 * factor, y + y0 * factor, s[y, x] / total[y, x]

    return blockwise(raster, m, 2, run, max(4, 1024 // factor))


def polar_forward(lon, lat, standard: float = -65.0):
    """South polar stereographic of WGS 84: x and y in metres of longitudes and latitudes in degrees."""
    a, e = 6378137.0, 0.0818191908426215
    ts = math.radians(-standard)
    tc = math.tan(math.pi / 4 - ts / 2) / ((1 - e * math.sin(ts)) / (1 + e * math.sin(ts))) ** (e / 2)
    mc = math.cos(ts) / math.sqrt(1 - (e * math.sin(ts)) ** 2)
    phi, lam = F.radians(-lat), F.radians(lon)
    t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - e * F.sin(phi)) / (1 + e * F.sin(phi)), F.lit(e / 2))
    rho = F.lit(a * mc / tc) * t
    return rho * F.sin(lam), rho * F.cos(lam)


def reproject(raster: DataFrame, grid: Grid, west: float, east: float, south: float, north: float, dlon: float, dlat: float) -> DataFrame:
    """The raster at the centres of a geographic grid, from the cell each falls in; ``ix iy lon lat v``."""
    spark = raster.sparkSession
    nx, ny = round((east - west) / dlon), round((north - south) / dlat)
    t = spark.range(nx * ny).select((F.col("id") % nx).cast("int").alias("ix"), F.floor(F.col("id") / nx).cast("int").alias("iy"))
    t = t.withColumn("lon", west + (F.col("ix") + 0.5) * dlon).withColumn("lat", south + (F.col("iy") + 0.5) * dlat)
    x, y = polar_forward(F.col("lon"), F.col("lat"))
    t = t.withColumn("cx", F.floor((x - grid.low) / grid.cell).cast("int")).withColumn("cy", F.floor((y - grid.low) / grid.cell).cast("int"))
    return t.join(raster, CELL).select("ix", "iy", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "v")


def solve(data: np.ndarray, tension: float, convergence: float, rounds: int) -> np.ndarray:
    """The surface through the known cells that makes ``(1-T) |laplacian|^2 + T |gradient|^2`` least.

    Its equation is ``(1-T) grad^4 z - T grad^2 z = 0`` with natural edges; conjugate gradients on the unknown cells.
    """
    known = ~np.isnan(data)
    if not known.any():
        return data
    base = data[known].mean()
    scale = max(np.abs(data[known] - base).max(), 1e-12)
    z = np.where(known, (data - base) / scale, 0.0)
    free = ~known

    def second(z, axis):
        return np.diff(z, 2, axis=axis) if z.shape[axis] > 2 else np.zeros([max(0, s - 2 * (a == axis)) for a, s in enumerate(z.shape)])

    def energy_slope(z):
        out = np.zeros_like(z)
        for axis in (0, 1):
            n = z.shape[axis]
            at = lambda s: tuple(s if a == axis else slice(None) for a in (0, 1))
            if n > 1:
                d = tension * np.diff(z, axis=axis)
                out[at(slice(1, None))] += d
                out[at(slice(None, -1))] -= d
        lap = np.zeros_like(z)
        parts = []
        for axis in (0, 1):
            if z.shape[axis] > 2:
                at = tuple(slice(1, -1) if a == axis else slice(None) for a in (0, 1))
                lap[at] += second(z, axis)
                parts.append(axis)
        lap *= 1 - tension
        for axis in parts:
            at = lambda s: tuple(s if a == axis else slice(None) for a in (0, 1))
            mid = lap[at(slice(1, -1))]
            out[at(slice(None, -2))] += mid
            out[at(slice(1, -1))] -= 2 * mid
            out[at(slice(2, None))] += mid
        return out

    r = -energy_slope(z) * free
    p, rr = r.copy(), float((r * r).sum())
    goal = (convergence * 1e-3) ** 2 * max(rr, 1e-30)
    for _ in range(rounds):
        if rr <= goal:
            break
        q = energy_slope(p) * free
        pq = float((p * q).sum())
        if pq <= 0:
            break
        z += rr / pq * p
        r -= rr / pq * q
        new = float((r * r).sum())
        p = r + new / rr * p
        rr = new
    return z * scale + base


def _coarse(cells: DataFrame, n: int, factor: int, tension: float, convergence: float, rounds: int) -> np.ndarray | None:
    """The surface of the whole grid on cells ``factor`` times larger; None without data."""
    m = -(-n // factor)
    at = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    got = cells.filter("v IS NOT NULL").groupBy(at("cx"), at("cy")).agg(F.avg("v").alias("v")).toPandas()  # no more than m * m rows
    if not len(got):
        return None
    data = np.full((m, m), np.nan)
    data[got["cy"], got["cx"]] = got["v"].astype(float)
    t = tension * factor**2  # the gradient's weight grows with the cell against the laplacian's
    return solve(data, t / (1 - tension + t), convergence, rounds)


def _between(far: np.ndarray, ys: np.ndarray, xs: np.ndarray, factor: int) -> np.ndarray:
    """The coarse surface at fine cells, linear between the centres of coarse ones."""

    def weights(p):
        u = (p + 0.5) / factor - 0.5
        i = np.clip(np.floor(u).astype(int), 0, max(len(far) - 2, 0))
        return i, np.minimum(i + 1, len(far) - 1), u - i

    (i, i1, f), (j, j1, g) = weights(ys), weights(xs)
    rows = far[i] * (1 - f)[:, None] + far[i1] * f[:, None]
    return rows[:, j] * (1 - g) + rows[:, j1] * g


def surface(
    cells: DataFrame, n: int, tension: float = 0.35, convergence: float = 0.01, rounds: int = 5000, upper: float | None = None, data_limits: bool = False, block: int = 192, halo: int = 32,
    coarse: int = 512, sweeps: int = 10, settled: float = 1e-4,
) -> DataFrame:
    """A spline in tension through the cells ``(cx, cy, v)`` of an n by n grid, at every cell; no rows without data.

    A grid no larger than a block is solved as one. A larger one is solved whole on no more than ``coarse`` cells a side,
    its own or larger ones, then in blocks that overlap by a halo, so no group holds more than ``(block + 2 halo)**2``
    cells. The outer edge of the halo is held at the coarse surface first, and then at what the neighbours have found
    (alternating Schwarz), until no cell moves by more than ``settled`` times the range of the data, or ``sweeps`` times.
    So far data count and blocks without data are covered; the result is that of the whole on grids of up to ``coarse``
    cells a side, and nears it with each sweep beyond. ``upper`` and ``data_limits`` (those of all data) bound the result.
    """
    blocks, factor = -(-n // block), -(-n // coarse)
    spark = cells.sparkSession
    data = cells.filter("v IS NOT NULL").select("cx", "cy", F.col("v").cast("double").alias("v"))
    lo = lambda c: F.greatest(F.lit(0), F.floor((F.col(c) - halo) / block).cast("int"))
    hi = lambda c: F.least(F.lit(blocks - 1), F.floor((F.col(c) + halo) / block).cast("int"))

    def at_home(rows: DataFrame) -> DataFrame:
        """Cells in their own block and in those whose halo they are in."""
        return rows.withColumn("bx", F.explode(F.sequence(lo("cx"), hi("cx")))).withColumn("by", F.explode(F.sequence(lo("cy"), hi("cy"))))

    homes = at_home(data).withColumn("edge", F.lit(False))
    far = None
    if blocks > 1:
        data.persist()
        far = _coarse(data, n, factor, tension, convergence, rounds)
        if far is not None:
            every = spark.range(blocks * blocks).select((F.col("id") % blocks).cast("int").alias("bx"), F.floor(F.col("id") / blocks).cast("int").alias("by"), F.lit(False).alias("edge"))
            homes = homes.unionByName(every, allowMissingColumns=True)
    limits = data.agg(F.min("v"), F.max("v")).first() if data_limits or far is not None else (None, None)

    def bounds(b: int) -> tuple[int, int]:
        return max(0, b * block - halo), min(n, (b + 1) * block + halo)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bx, by = int(pdf["bx"].iloc[0]), int(pdf["by"].iloc[0])
        (x0, x1), (y0, y1) = bounds(bx), bounds(by)
        data = np.full((y1 - y0, x1 - x0), np.nan)

        def put(rows):
            data[rows["cy"].to_numpy(int) - y0, rows["cx"].to_numpy(int) - x0] = rows["v"]

        pdf = pdf[pdf["v"].notna()]
        edges = pdf["edge"].astype(bool)
        if edges.any():
            put(pdf[edges])
        elif far is not None:
            edge = np.zeros(data.shape, bool)  # two cells deep, but free where the grid ends
            edge[: 2 * (y0 > 0)] = edge[data.shape[0] - 2 * (y1 < n) :] = True
            edge[:, : 2 * (x0 > 0)] = edge[:, data.shape[1] - 2 * (x1 < n) :] = True
            data[edge] = _between(far, np.arange(y0, y1), np.arange(x0, x1), factor)[edge]
        put(pdf[~edges])
        z = solve(data, tension, convergence, rounds)
        ys, xs = np.mgrid[max(y0, by * block) : min(n, (by + 1) * block), max(x0, bx * block) : min(n, (bx + 1) * block)]
        return pd.DataFrame({"cx": xs.ravel().astype(np.int32), "cy": ys.ravel().astype(np.int32), "v": z[ys.ravel() - y0, xs.ravel() - x0]})

    def swept(rows: DataFrame) -> DataFrame:
        return rows.groupBy("bx", "by").applyInPandas(run, "cx int, cy int, v double")

    out = swept(homes)
    if far is not None:
        out = kept(out)
        low = lambda b: F.greatest(F.lit(0), F.col(b) * block - halo)
        high = lambda b: F.least(F.lit(n), (F.col(b) + 1) * block + halo)
        rim = lambda c, b: ((low(b) > 0) & (F.col(c) < low(b) + 2)) | ((high(b) < n) & (F.col(c) >= high(b) - 2))
        for _ in range(sweeps):
            edges = at_home(out).filter(rim("cx", "bx") | rim("cy", "by")).withColumn("edge", F.lit(True))
            new = kept(swept(homes.unionByName(edges)))
            moved = new.join(out.withColumnRenamed("v", "old"), CELL).agg(F.max(F.abs(F.col("v") - F.col("old")))).first()[0]
            out = new
            if moved <= settled * max(limits[1] - limits[0], 1e-12):
                break
        data.unpersist()
    v = F.col("v")
    if data_limits:
        v = F.least(F.greatest(v, F.lit(limits[0])), F.lit(limits[1])) if limits[0] is not None else v
    if upper is not None:
        v = F.least(v, F.lit(float(upper)))
    return out.withColumn("v", v)
