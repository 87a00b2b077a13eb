"""Weighted robust statistics by cell: the core operator.

Samples of a cell are ordered by depth, then position and dataset. A quantile is the depth of the first sample at
which the running weight reaches its share of the cell's weight; with ``average_ties`` an exact hit is averaged
with the next sample. The median sample also gives position and dataset. One shuffle on the cell serves the window
and the aggregate; statistics of a cell come from one pass and are never pasted together by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmill.config import HIGH_WEIGHTS, Grid


def with_cell(points: DataFrame, grid: Grid) -> DataFrame:
    """With the cell, closed below and open above; points outside the region are dropped."""
    cell = lambda c: F.floor((F.col(c) - grid.low) / F.lit(grid.cell)).cast("int")
    p = points.withColumn("cx", cell("x")).withColumn("cy", cell("y"))
    return p.filter(F.col("cx").between(0, grid.cells - 1) & F.col("cy").between(0, grid.cells - 1))


def cell_stats(points: DataFrame, grid: Grid, average_ties: bool = False) -> DataFrame:
    """``cx cy x y rid min q25 median q75 max sum_weight n`` for each cell with a sample of positive weight."""
    p = with_cell(points.filter("weight > 0 AND z IS NOT NULL"), grid).select("cx", "cy", "z", "x", "y", "rid", F.col("weight").cast("long").alias("w"))
    cell = Window.partitionBy("cx", "cy")
    order = cell.orderBy("z", "x", "y", "rid")
    p = p.withColumn("cw", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("tw", F.sum("w").over(cell))
    if average_ties:
        p = p.withColumn("zn", F.lead("z").over(order))

    def quantile(num: int, den: int):
        reached = F.col("cw") * den >= F.col("tw") * num
        if not average_ties:
            return F.min(F.when(reached, F.col("z")))
        exact = F.col("cw") * den == F.col("tw") * num
        value = F.when(exact, (F.col("z") + F.coalesce("zn", "z")) / 2).otherwise(F.col("z").cast("double"))
        return F.min(F.when(reached, F.struct("z", "cw", value.alias("v"))))["v"]

    middle = F.min(F.when(F.col("cw") * 2 >= F.col("tw"), F.struct("z", "x", "y", "rid")))
    s = p.groupBy("cx", "cy").agg(
        middle.alias("m"), F.min("z").alias("min"), quantile(1, 4).alias("q25"), quantile(1, 2).alias("median"), quantile(3, 4).alias("q75"), F.max("z").alias("max"), F.sum("w").alias("sum_weight"), F.count("*").alias("n")
    )
    return s.select("cx", "cy", F.col("m.x").alias("x"), F.col("m.y").alias("y"), F.col("m.rid").alias("rid"), "min", "q25", "median", "q75", "max", "sum_weight", "n")


def high_resolution(points: DataFrame) -> DataFrame:
    return points.filter(F.col("weight").isin(*HIGH_WEIGHTS))


def augmented(stats: DataFrame, metadata: DataFrame) -> DataFrame:
    """The thirteen columns of the product: statistics with what is known of the median sample's dataset, or '0' and 0."""
    m = metadata.groupBy(F.col("dataset_rid").alias("rid")).agg(F.min(F.struct("dataset_name", "dataset_tid", "contrib_org", "weight")).alias("m"))
    j = stats.join(m, "rid", "left")
    return j.select(
        "x", "y", "rid", "min", "q25", "median", "q75", "max", "sum_weight",
        F.coalesce("m.dataset_name", F.lit("0")).alias("data_name"), F.coalesce("m.dataset_tid", F.lit(0)).alias("tid"), F.coalesce("m.contrib_org", F.lit("0")).alias("contrib_org"), F.coalesce("m.weight", F.lit(0)).alias("dataset_weight"),
    )


def steering(lines: DataFrame, table: DataFrame) -> DataFrame:
    """``x y z rid tid`` of static points in lines ``(value, file)``, with the dataset that the file's name is in the table.

    Commas, tabs and blanks separate; numbers are rounded to whole ones, halves to the even one. Files that the table
    doesn't know are left out, and so are lines without three numbers.
    """
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    fields = F.split(F.trim(F.regexp_replace("value", r"[,\s]+", " ")), " ")
    read = lines.select(name.alias("dataset_name"), F.explode(F.array(fields)).alias("f"))
    numbers = (F.bround(F.try_element_at("f", F.lit(k)).try_cast("double"), 0).cast("long").alias(c) for k, c in enumerate("xyz", 1))
    named = table.groupBy("dataset_name").agg(F.min(F.struct(F.col("dataset_rid").alias("rid"), F.col("dataset_tid").alias("tid"))).alias("d"))
    return read.select("dataset_name", *numbers).dropna(subset=["x", "y", "z"]).join(named, "dataset_name").select("x", "y", "z", "d.rid", "d.tid")


def surface_points(points: DataFrame, limit: int = 1420) -> DataFrame:
    """Static points that a surface may have: those below its upper limit."""
    return points.filter(F.col("z") < limit)


def static_medians(points: DataFrame, grid: Grid) -> DataFrame:
    """``cx cy x y rid median n``: the unweighted median of the static points of each cell, with the position and dataset of the median point."""
    return cell_stats(points.withColumn("weight", F.lit(1)), grid).select("cx", "cy", "x", "y", "rid", "median", "n")


def with_files(summary: DataFrame, files: DataFrame) -> DataFrame:
    """Tile summaries with megabytes and time of the file of each tile and type, ``(tile_id, type, bytes, modified)``; null without a file."""
    f = files.select("tile_id", "type", (F.col("bytes") / 1024 / 1024).alias("mb"), "modified")
    return summary.join(f, ["tile_id", "type"], "left")


def by_tile(stats: DataFrame, grid: Grid, kind: str) -> DataFrame:
    """Cells, datasets and extents of each tile's statistics; the tile is that of the median sample."""
    from gridmill.operators.tiling import with_tile

    t = with_tile(stats, grid).filter("tile_id IS NOT NULL")
    z = F.col("median")
    return t.groupBy("tile_id", "basic_tile").agg(
        F.lit(kind).alias("type"), F.count("*").alias("bm_windows"), F.array_join(F.array_sort(F.collect_set("rid")), ";").alias("cruises"), F.countDistinct("rid").alias("n_cruises"),
        F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"), F.min(z).alias("zmin"), F.max(z).alias("zmax"),
    )


def column(product: DataFrame, name: str) -> DataFrame:
    """One value column of the product as ``x y value``."""
    return product.select("x", "y", F.col(name).alias("value"))


NUMBERS = ("rid", "min", "q25", "median", "q75", "max", "sum_weight", "tid", "dataset_weight")


TEXTS = ("data_name", "contrib_org")


def long_texts(product: DataFrame) -> DataFrame:
    """The two columns of text in long form, from one scan."""
    pairs = ", ".join(f"'{c}', `{c}`" for c in TEXTS)
    return product.selectExpr("x", "y", f"stack({len(TEXTS)}, {pairs}) AS (attribute, value)")


def long_columns(product: DataFrame) -> DataFrame:
    """All numeric columns in long form, from one scan."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS BIGINT)" for c in NUMBERS)
    return product.selectExpr("x", "y", f"stack({len(NUMBERS)}, {pairs}) AS (attribute, value)")
