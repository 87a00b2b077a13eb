"""Metadata: lookups, membership, drift, curation, refreshed dimensions, run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmill.functions import text as X


def known(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    return rows.join(metadata.select(F.col("dataset_rid").alias("rid")), "rid", "left_semi")


def unknown(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    return rows.join(metadata.select(F.col("dataset_rid").alias("rid")), "rid", "left_anti")


def drifted(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """Files ``(rid, weight)`` whose weight is not the one recorded, with both."""
    m = metadata.select(F.col("dataset_rid").alias("rid"), F.col("weight").alias("recorded"))
    return files.join(m, "rid").filter(~F.col("weight").eqNullSafe(F.col("recorded"))).select("rid", "weight", "recorded")


def looked_up(names: DataFrame, metadata: DataFrame) -> DataFrame:
    """Names matched without regard to case; the first of several matches counts, no match is null."""
    m = metadata.groupBy(F.lower("dataset_name").alias("_k")).agg(F.min("dataset_rid").alias("rid"))
    return names.join(m, F.lower(names["name"]) == m["_k"], "left").select("name", "rid")


def looked_up_static(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """``file rid tid``: the dataset that the name of a static file (without its folder and ending) is in the metadata, null if it isn't."""
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    m = metadata.groupBy(F.col("dataset_name").alias("_k")).agg(F.min(F.struct("dataset_rid", "dataset_tid")).alias("m"))
    return files.select("file", name.alias("_n")).join(m, F.col("_n") == F.col("_k"), "left").select("file", F.col("m.dataset_rid").alias("rid"), F.col("m.dataset_tid").alias("tid"))


def curated(table: DataFrame) -> DataFrame:
    """All text columns without tabs and line ends, trimmed, blank as null: one projection."""
    return table.select(*(X.curated(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in table.schema.fields))


def refreshed(metadata: DataFrame, extents: DataFrame) -> DataFrame:
    """The dimension with the extents that are new; a dataset that was not delivered keeps what it had."""
    new = extents.select(F.col("rid").alias("dataset_rid"), *(F.col(c).alias(f"_{c}") for c in extents.columns if c != "rid"))
    got = metadata.join(new, "dataset_rid", "left")
    values = [c for c in extents.columns if c != "rid"]
    old = [F.coalesce(f"_{c}", c) if c in metadata.columns else F.col(f"_{c}") for c in values]
    return got.select(*(c for c in metadata.columns if c not in values), *(o.alias(c) for o, c in zip(old, values)))


def redelivered(metadata: DataFrame, delivered: DataFrame, dates: tuple[str, ...] = ("date_harmonised", "date_tiled")) -> tuple[DataFrame, DataFrame]:
    """The metadata without the dates of the datasets whose files ``(file)`` were delivered again, and the files that no dataset has.

    A dataset's name is that of its file.
    """
    names = delivered.select(F.element_at(F.split("file", "/"), -1).alias("dataset_name")).distinct()
    again = F.col("_again").isNull()
    m = metadata.join(names.withColumn("_again", F.lit(True)), "dataset_name", "left")
    m = m.select(*(F.when(again, F.col(c)).alias(c) if c in dates else F.col(c) for c in metadata.columns))
    return m, names.join(metadata.select("dataset_name"), "dataset_name", "left_anti").withColumnRenamed("dataset_name", "file")


def replaced(table: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """The table with the rows in place of those with the same keys; rows with new keys are added."""
    return table.join(rows.select(*keys).distinct(), list(keys), "left_anti").select(*table.columns).unionByName(rows)


def usage(keys: DataFrame, metadata: DataFrame) -> DataFrame:
    """How many metadata rows each key has, 0 included."""
    m = metadata.groupBy(F.col("dataset_rid").alias("rid")).agg(F.count("*").alias("n"))
    return keys.select("rid").distinct().join(m, "rid", "left").select("rid", F.coalesce("n", F.lit(0)).alias("n"))


def run_report(lines: DataFrame) -> DataFrame:
    """By step: tasks, jobs, bytes and seconds, from report lines of nine fields that begin with CSVLINE."""
    f = F.split(F.regexp_replace("value", "^CSVLINE ", ""), " ")
    r = lines.filter(F.col("value").startswith("CSVLINE ")).select(f.alias("f")).filter(F.size("f") == 9)
    at = lambda i: F.element_at("f", i + 1)
    r = r.select(at(0).alias("step"), at(1).try_cast("long").alias("job_id"), at(6).try_cast("long").alias("bytes"), at(7).try_cast("long").alias("t0"), at(8).try_cast("long").alias("t1"))
    return r.groupBy("step").agg(
        F.count("*").alias("n_tasks"), F.countDistinct("job_id").alias("n_jobs"), F.round(X.megabytes(F.sum("bytes")), 6).alias("mb"), F.sum(F.col("t1") - F.col("t0")).alias("total_ms"), F.max(F.col("t1") - F.col("t0")).alias("longest_ms")
    )


def views(metadata: DataFrame, tiles: DataFrame, edits: DataFrame | None = None) -> dict[str, DataFrame]:
    """The named views that the stages read."""
    out = {
        "included": metadata.filter("include = 1").select("dataset_rid", "dataset_name", "dataset_tid", "contrib_org", "weight"),
        "rid_lookup": metadata.select("dataset_rid", "dataset_name", "dataset_tid", "contrib_org", "weight"),
        "steering": metadata.filter("dataset_rid < 10000").select("dataset_rid", "dataset_name", "dataset_tid"),
        "unique_tiles": tiles.select("ID", "basicTile").distinct(),
        "unique_basic_tiles": tiles.groupBy("basicTile").agg(F.count("*").alias("n_tiles")),
    }
    if edits is not None:
        out["tile_edits"] = tiles.join(edits, tiles["ID"] == edits["tileID"], "left").drop("tileID")
    return out


def newest(runs: DataFrame, keep: int) -> DataFrame:
    """Runs ``(name, created)`` with whether each is among the newest to keep."""
    top = runs.orderBy(F.desc("created"), F.desc("name")).limit(keep).select("name")
    return runs.join(top.withColumn("keep", F.lit(True)), "name", "left").fillna(False, ["keep"])
