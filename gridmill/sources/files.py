"""Readers and writers, all with given schemas."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "x BIGINT, y BIGINT, z BIGINT, weight INT, rid BIGINT"
METADATA = "dataset_rid BIGINT, dataset_name STRING, dataset_tid INT, contrib_org STRING, weight INT, include INT"


@lru_cache(1)
def _local_dir() -> str:
    """A folder for sessions without a shared one, as in tests; it goes when the process ends."""
    path = tempfile.mkdtemp(prefix="gridmill-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder the cluster names; a local one only in a local session where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_dir()
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def kept(table: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again, so that what follows doesn't compute them anew, whatever is lost."""
    path = scratch(table.sparkSession)
    table.write.parquet(path)
    return table.sparkSession.read.parquet(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text without carriage returns, with the file's name; order within a file is that of the split."""
    return spark.read.text(path).select(F.regexp_replace("value", "\r", "").alias("value"), F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1).alias("file"))


def read_points(spark: SparkSession, path: str, sep: str = " ", schema: str = POINTS) -> DataFrame:
    """Points separated by one character; lines that don't fit the schema are dropped. ``scan_points`` reports them."""
    return spark.read.csv(path, schema=schema, sep=sep, mode="DROPMALFORMED")


def scan_points(lines: DataFrame, names: tuple[str, ...] = ("x", "y", "z")) -> tuple[DataFrame, DataFrame]:
    """Points of 32-bit floats from lines ``(value, file)`` of mixed separators, and the lines that were skipped.

    Each comma, semicolon, tab, space or plus sign separates. A line with too many fields is skipped, and so is one of
    which a field is no number; missing and empty fields are null; blank lines count as none. Both results come from
    one projection, and no line is lost unseen.
    """
    f = F.split("value", r"[,;\t\s+]")
    read = lines.filter(F.trim("value") != "").select("file", "value", F.explode(F.array(f)).alias("_f"))
    text = [F.try_element_at("_f", F.lit(k)) for k in range(1, len(names) + 1)]
    number = [F.when(t != "", t).try_cast("float") for t in text]
    bad = F.size("_f") > len(names)
    for t, v in zip(text, number):
        bad = bad | ((t != "") & v.isNull())
    read = read.withColumn("_bad", F.coalesce(bad, F.lit(False)))
    return read.filter(~F.col("_bad")).select("file", *(v.alias(n) for v, n in zip(number, names))), read.filter("_bad").select("file", "value")


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The files under a path that match a pattern: ``file``, ``prefix`` (the name up to its first underscore), ``bytes``, ``modified``; none is no error."""
    kinds = "path string, modificationTime timestamp, length long"
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    except AnalysisException:
        found = spark.createDataFrame([], kinds)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(name.alias("file"), F.split(name, "_")[0].alias("prefix"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def sniffed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table with a header whose separator is found in that: of comma, tab and space the one it has most of, the first of equals. Quotes are text."""
    head = spark.read.text(path).first()
    head = head.value if head else ""
    return spark.read.csv(path, schema=schema, sep=max(",\t ", key=head.count), header=True, quote="")


def write_points(points: DataFrame, path: str, sep: str = " ") -> None:
    points.select("x", "y", "z", "weight", "rid").write.csv(path, sep=sep)


def read_table(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep, header=True)


def write_table(table: DataFrame, path: str, sep: str = "\t") -> None:
    table.write.csv(path, sep=sep, header=True)


def write_tiles(points: DataFrame, path: str) -> None:
    """One folder for each basic tile, the tile a column; rows meet on the basic tile first, so files stay few, but a hot tile is split by its size."""
    points.hint("rebalance", F.col("basic_tile")).write.partitionBy("basic_tile").parquet(path)


def read_tiles(spark: SparkSession, path: str, basic_tile: int | None = None) -> DataFrame:
    """The tile store, or one basic tile of it: the other folders are not opened."""
    t = spark.read.parquet(path)
    return t if basic_tile is None else t.filter(F.col("basic_tile") == basic_tile)


def write_raster(raster: DataFrame, path: str, block: int = 4800, **about: str) -> None:
    """A cell table in blocks of cells, with what is said about it as metadata of its value."""
    b = raster.withColumn("bx", F.floor(F.col("cx") / block).cast("int")).withColumn("by", F.floor(F.col("cy") / block).cast("int"))
    b = b.withMetadata("v", {k: str(v) for k, v in about.items()})
    b.hint("rebalance", F.col("bx"), F.col("by")).write.partitionBy("bx", "by").parquet(path)


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bx", "by")


def about(raster: DataFrame) -> DataFrame:
    """What is said about a raster that was read: ``name value``."""
    said = raster.schema["v"].metadata
    return raster.sparkSession.createDataFrame(sorted(said.items()), "name string, value string")


def write_rejects(rejects: DataFrame, path: str) -> None:
    """Points left out of the tiles, for later checks: one folder for each reason, numbers without fractions, separated by blanks.

    A point without a number has ``x y z rid``, any other also its tile and basic tile, if it lies in one.
    """
    whole = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.0f", F.col(c).cast("double"))).otherwise("")
    tile = F.when(F.col("reason") != "null", F.concat_ws(" ", whole("tile_id"), whole("basic_tile")))
    line = F.rtrim(F.concat_ws(" ", *(whole(c) for c in ("x", "y", "z", "rid")), tile))
    rejects.select("reason", line.alias("value")).hint("rebalance", F.col("reason")).write.mode("append").partitionBy("reason").text(path)


def write_numbers(table: DataFrame, path: str) -> None:
    """Whole numbers separated by blanks, without a header: extents by dataset, or lists of tiles."""
    table.select(*(F.col(f"`{c}`").cast("long") for c in table.columns)).write.csv(path, sep=" ")


def read_database(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table or a query of a database by JDBC; the driver's jar must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def columns(table: DataFrame) -> DataFrame:
    """The names and places of a table's columns."""
    return table.sparkSession.createDataFrame([(i, f.name) for i, f in enumerate(table.schema.fields)], "place int, name string")


def dense(raster: DataFrame, n: int, nodata: int = -32768):
    """The raster as an array on the driver, for export; meant for a window or a coarse level."""
    import numpy as np

    out = np.full((n, n), nodata, np.int32)
    for batch in raster.select("cx", "cy", F.col("v").cast("int").alias("v")).toArrow().to_batches():
        v = batch.column(2).to_numpy(zero_copy_only=False)
        out[batch.column(1).to_numpy(), batch.column(0).to_numpy()] = np.where(np.isnan(v), nodata, v) if v.dtype.kind == "f" else v
    return out
