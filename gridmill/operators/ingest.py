"""Lines of text to soundings: repair, checks, rejects and spans of bad lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions import text as T

MAX_DEPTH = 11_000


def parsed(lines: DataFrame) -> DataFrame:
    """Rows ``(file, line_no, value)`` with x, y, z and why a line is rejected (null for a good one).

    No shuffle. Fields and numbers pass through a Generate of one row each, so that a filter on what is made of them
    isn't pushed below and every pattern is matched once for a line. The depth limit is tested before z loses its
    fraction.
    """
    once = lambda c: F.explode(F.array(c))
    read = lines.select("file", "line_no", "value", once(T.fields(F.col("value"))).alias("_t"))
    numbers = F.struct(F.size("_t").alias("n"), *(T.number(F.try_element_at("_t", F.lit(i))).alias(c) for i, c in enumerate("xyz", 1)))
    read = read.select("file", "line_no", "value", once(numbers).alias("_n"))
    x, y, z = (F.col(f"_n.{c}") for c in "xyz")
    reason = F.when(F.col("_n.n") < 3, "fields").when(x.isNull() | y.isNull() | z.isNull(), "number").when(F.abs(z) > MAX_DEPTH, "depth")
    return read.select("file", "line_no", "value", *(F.when(reason.isNull(), v.cast("long")).alias(c) for c, v in zip("xyz", (x, y, -F.abs(z)))), reason.alias("reason"))


def soundings(lines: DataFrame) -> DataFrame:
    return parsed(lines).filter("reason IS NULL").select("file", "line_no", "x", "y", "z")


def rejects(lines: DataFrame) -> DataFrame:
    return parsed(lines).filter("reason IS NOT NULL").select("file", "line_no", "value", "reason")


def spans(lines: DataFrame) -> DataFrame:
    """Unbroken runs of rejected lines of a file as one row each, also at its end."""
    bad = rejects(lines)
    run = F.col("line_no") - F.row_number().over(Window.partitionBy("file").orderBy("line_no"))
    return bad.withColumn("run", run).groupBy("file", "run").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count("*").alias("n_lines")).drop("run")


def named(points: DataFrame) -> DataFrame:
    """With the dataset and weight that the file's name gives."""
    return points.withColumn("rid", T.name_field(F.col("file"), 1).cast("long")).withColumn("weight", T.name_field(F.col("file"), 2).cast("int"))


def distinct_points(points: DataFrame) -> DataFrame:
    return points.distinct()


def depth_rule(points: DataFrame) -> DataFrame:
    """Depths made negative, and those beyond the limit dropped, of points that come as numbers."""
    return points.withColumn("z", -F.abs("z")).filter(F.abs("z") <= MAX_DEPTH)
