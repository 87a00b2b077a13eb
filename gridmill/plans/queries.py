"""Named queries over the driver's tables, with the same queries in SQL.

A name begins with the stage it belongs to. ``SQL`` leaves out what SQL cannot express.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.config import SMALL
from gridmill.functions import text as X
from gridmill.operators import blocks, catalog, compare, gridding, ingest, morphology, product, raster, tiling
from gridmill.plans.fixtures import N, Inputs, sql
from gridmill.sources import files

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    """Registers a function of the inputs, with its SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Inputs(spark, sf_dir))

        QUERIES[f.__name__] = run
        if text:
            SQL[f.__name__] = sql(text)
        return f

    return add


_READ = r"""(SELECT file, line_no, value, len(t) n, CASE WHEN reason IS NULL THEN CAST(trunc(a) AS BIGINT) END x, CASE WHEN reason IS NULL THEN CAST(trunc(b) AS BIGINT) END y, CASE WHEN reason IS NULL THEN CAST(trunc(-abs(c)) AS BIGINT) END z, reason FROM (
  SELECT *, CASE WHEN len(t) < 3 THEN 'fields' WHEN a IS NULL OR b IS NULL OR c IS NULL THEN 'number' WHEN abs(c) > 11000 THEN 'depth' END reason FROM (
  SELECT *, try_cast(list_aggregate(string_split(regexp_replace(t[1], '[^-0-9.]', '', 'g'), '.')[1:2], 'string_agg', '.') AS DOUBLE) a,
    try_cast(list_aggregate(string_split(regexp_replace(t[2], '[^-0-9.]', '', 'g'), '.')[1:2], 'string_agg', '.') AS DOUBLE) b,
    try_cast(list_aggregate(string_split(regexp_replace(t[3], '[^-0-9.]', '', 'g'), '.')[1:2], 'string_agg', '.') AS DOUBLE) c FROM (
  SELECT *, string_split(regexp_replace(regexp_replace(regexp_replace(value, '^\s+|\s+$', '', 'g'), '[\t;\s,]+', ' ', 'g'), '-+', '-', 'g'), ' ') t FROM raw_lines))))"""


@query(f"SELECT file, line_no, x, y, z FROM {_READ} WHERE reason IS NULL")
def ingest_soundings(i):
    return ingest.soundings(i.raw_lines)


@query(f"SELECT file, line_no, value, reason FROM {_READ} WHERE reason IS NOT NULL")
def ingest_rejects(i):
    return ingest.rejects(i.raw_lines)


@query(f"SELECT file, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_lines FROM (SELECT file, line_no, line_no - row_number() OVER (PARTITION BY file ORDER BY line_no) g FROM {_READ} WHERE reason IS NOT NULL) GROUP BY file, g")
def ingest_error_spans(i):
    return ingest.spans(i.raw_lines)


@query("SELECT file, CAST(regexp_extract(file, '^([^_]+)_w([^#.]+)', 1) AS BIGINT) AS rid, CAST(regexp_extract(file, '^([^_]+)_w([^#.]+)', 2) AS INTEGER) AS weight, count(*) AS n_lines FROM raw_lines GROUP BY file")
def ingest_file_names(i):
    return ingest.named(i.raw_lines).groupBy("file", "rid", "weight").agg(F.count("*").alias("n_lines"))


@query(f"SELECT DISTINCT CAST(string_split(file, '_')[1] AS BIGINT) rid, x, y, z FROM {_READ} WHERE reason IS NULL")
def ingest_distinct(i):
    return ingest.distinct_points(ingest.named(ingest.soundings(i.raw_lines)).select("rid", "x", "y", "z"))


@query("SELECT value, count(*) AS n FROM raw_lines GROUP BY value")
def source_lines(i):
    path = files.scratch(i.spark)
    i.raw_lines.select(F.concat("value", F.lit("\r")).alias("value")).write.text(path)
    return files.read_lines(i.spark, path).groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT x, y, z, weight, rid FROM clean")
def source_points(i):
    path = files.scratch(i.spark)
    files.write_points(i.clean, path)
    return files.read_points(i.spark, path)


_MIXED = r"""(SELECT file, value, string_split_regex(value, '[,;\t\s+]') f FROM raw_lines WHERE trim(value) <> '')"""


@query(f"SELECT file, TRY_CAST(nullif(f[1], '') AS FLOAT) AS x, TRY_CAST(nullif(f[2], '') AS FLOAT) AS y, TRY_CAST(nullif(f[3], '') AS FLOAT) AS z FROM {_MIXED} WHERE len(f) <= 3 AND NOT coalesce(list_bool_or([x <> '' AND TRY_CAST(x AS FLOAT) IS NULL for x in f]), false)")
def source_mixed_points(i):
    return files.scan_points(i.raw_lines)[0]


@query(f"SELECT file, value FROM {_MIXED} WHERE len(f) > 3 OR coalesce(list_bool_or([x <> '' AND TRY_CAST(x AS FLOAT) IS NULL for x in f]), false)")
def source_skipped_lines(i):
    return files.scan_points(i.raw_lines)[1]


@query("SELECT * FROM metadata")
def source_sniffed(i):
    path = files.scratch(i.spark)
    files.write_table(i.metadata, path, ",")
    return files.sniffed(i.spark, path, files.METADATA)


@query("SELECT name, value FROM (VALUES ('nodata', '-32768'), ('title', 'bed'), ('units', 'm')) v(name, value)")
def source_raster_about(i):
    path = files.scratch(i.spark)
    files.write_raster(i.background, path, 48, units="m", title="bed", nodata=-32768)
    return files.about(files.read_raster(i.spark, path))


@query("SELECT * FROM metadata")
def source_table(i):
    path = files.scratch(i.spark)
    files.write_table(i.metadata, path)
    return files.read_table(i.spark, path, files.METADATA)


@query("SELECT tile_id, CAST(basic_tile AS INTEGER) AS basic_tile, count(*) AS n, CAST(sum(z) AS BIGINT) AS z FROM tiled WHERE basic_tile = 3 GROUP BY ALL")
def source_tile_store(i):
    path = files.scratch(i.spark)
    files.write_tiles(tiling.tiled(i.used, SMALL), path)
    return files.read_tiles(i.spark, path, 3).groupBy("tile_id", "basic_tile").agg(F.count("*").alias("n"), F.sum("z").alias("z"))


@query("SELECT cx, cy, v FROM background")
def source_raster(i):
    path = files.scratch(i.spark)
    files.write_raster(i.background, path, 48, units="m")
    return files.read_raster(i.spark, path)


@query("SELECT CAST(column_index - 1 AS INTEGER) AS place, column_name AS name FROM duckdb_columns() WHERE table_name = 'lineitem'")
def source_columns(i):
    return files.columns(i.table("lineitem"))


@query("SELECT dataset_tid, count(*) AS n, CAST(sum(weight) AS BIGINT) AS w FROM metadata WHERE include = 1 GROUP BY dataset_tid")
def source_sql(i):
    return i.spark.sql("SELECT dataset_tid, count(*) AS n, sum(weight) AS w FROM {m} WHERE include = 1 GROUP BY dataset_tid", m=i.metadata)


@query("SELECT x, y, z, rid, weight, tile_id, basic_tile FROM tiled")
def tile_points(i):
    return tiling.tiled(tiling.included(i.clean, i.metadata), SMALL).select("x", "y", "z", "rid", "weight", "tile_id", "basic_tile")


@query("""SELECT reason, count(*) AS n, CAST(sum(x) AS BIGINT) AS x, CAST(sum(z) AS BIGINT) AS z FROM (SELECT x, z, CASE WHEN NOT (x BETWEEN -24000 AND 24000 AND y BETWEEN -24000 AND 24000) THEN 'outside'
  WHEN x > 16000 AND y > 16000 THEN 'no_tile' WHEN z <= -9999 THEN 'depth' END reason FROM (SELECT x, y, -abs(z) z FROM soundings)) WHERE reason IS NOT NULL GROUP BY reason""")
def tile_rejects(i):
    points = i.soundings.withColumn("z", -F.abs("z"))
    return tiling.tile_rejects(points, SMALL, i.tiles.filter("ID < 36")).groupBy("reason").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("z").alias("z"))


@query("SELECT rid, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(z) AS zmin, max(z) AS zmax FROM tiled GROUP BY rid")
def tile_extents(i):
    return tiling.extents(tiling.tiled(i.used, SMALL), "rid")


@query("SELECT rid, min(xmin) AS xmin, max(xmax) AS xmax, min(ymin) AS ymin, max(ymax) AS ymax, min(zmin) AS zmin, max(zmax) AS zmax, round(avg(CAST(time_tiling AS DOUBLE)), 6) AS time_tiling FROM splits GROUP BY rid")
def tile_extents_of_splits(i):
    return tiling.extents_of_splits(i.splits.withColumn("time_tiling", F.col("time_tiling").cast("double"))).withColumn("time_tiling", F.round("time_tiling", 6))


@query("""SELECT value, count(*) AS n FROM (SELECT concat_ws(' ', x, y, z, rid, CASE WHEN tx BETWEEN 0 AND 5 AND ty BETWEEN 0 AND 5 THEN concat_ws(' ', 1 + tx + 6 * ty, 1 + tx // 3 + 2 * (ty // 3)) END) AS value FROM
  (SELECT *, CAST(CASE WHEN x = -24000 THEN 0 ELSE ceil((x + 24000) / 8000.0) - 1 END AS BIGINT) tx, CAST(CASE WHEN y = -24000 THEN 0 ELSE ceil((y + 24000) / 8000.0) - 1 END AS BIGINT) ty FROM (SELECT x, y, -abs(z) z, rid FROM soundings))
  WHERE NOT (tx BETWEEN 0 AND 5 AND ty BETWEEN 0 AND 5) OR z <= -9999) GROUP BY value""")
def tile_reject_files(i):
    path = files.scratch(i.spark)
    files.write_rejects(tiling.tile_rejects(i.soundings.withColumn("z", -F.abs("z")), SMALL), path)
    return i.spark.read.text(path).groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT CAST(tile_id AS BIGINT) AS tile_id FROM tiled")
def tile_unique_files(i):
    path = files.scratch(i.spark)
    files.write_numbers(tiling.unique_tiles(tiling.tiled(i.used, SMALL)).select("tile_id"), path)
    return i.spark.read.csv(path, schema="tile_id long")


_RIDS = "(SELECT tile_id, basic_tile, string_agg(rid, ';' ORDER BY rid) AS cruises, count(*) AS n_cruises FROM (SELECT DISTINCT tile_id, basic_tile, rid FROM tiled) GROUP BY tile_id, basic_tile)"


@query(f"SELECT * FROM {_RIDS}")
def tile_cruises(i):
    return tiling.rids_by_tile(tiling.tiled(i.used, SMALL))


@query("SELECT tile_id, CAST(sum(weight) AS BIGINT) AS sum_weight, round(avg(weight), 6) AS avg_weight FROM (SELECT DISTINCT tile_id, rid FROM tiled) JOIN metadata ON rid = dataset_rid GROUP BY tile_id")
def tile_weights(i):
    return tiling.weights_by_tile(tiling.rids_by_tile(tiling.tiled(i.used, SMALL)), i.metadata)


@query("SELECT DISTINCT tile_id, basic_tile FROM tiled")
def tile_unique(i):
    return tiling.unique_tiles(tiling.tiled(i.used, SMALL))


_STATS = 'cx, cy, x, y, rid, mn AS "min", q25, med AS "median", q75, mx AS "max", sw AS sum_weight, n'


@query(f"SELECT {_STATS} FROM stats")
def block_stats(i):
    return blocks.cell_stats(i.used, SMALL)


@query(f"SELECT {_STATS} FROM (SELECT cx, cy, m.x AS x, m.y AS y, m.rid AS rid, mn, q25, med, q75, mx, sw, n FROM (SELECT cx, cy, min({{'z': z, 'x': x, 'y': y, 'rid': rid}}) FILTER (WHERE cw * 2 >= tw) m, min(z) mn, min(z) FILTER (WHERE cw * 4 >= tw) q25, min(z) FILTER (WHERE cw * 2 >= tw) med, min(z) FILTER (WHERE cw * 4 >= tw * 3) q75, max(z) mx, CAST(sum(weight) AS BIGINT) sw, count(*) n FROM (SELECT *, sum(weight) OVER (PARTITION BY cx, cy ORDER BY z, x, y, rid ROWS UNBOUNDED PRECEDING) cw, sum(weight) OVER (PARTITION BY cx, cy) tw FROM celled WHERE weight IN (15, 20, 25, 30)) GROUP BY cx, cy))")
def block_stats_high(i):
    return blocks.cell_stats(blocks.high_resolution(i.used), SMALL)


@query("""SELECT cx, cy, arg_min(CASE WHEN cw * 4 = tw THEN (z + coalesce(zn, z)) / 2.0 ELSE z END, cw) FILTER (WHERE cw * 4 >= tw) AS q25, arg_min(CASE WHEN cw * 2 = tw THEN (z + coalesce(zn, z)) / 2.0 ELSE z END, cw) FILTER (WHERE cw * 2 >= tw) AS "median",
  arg_min(CASE WHEN cw * 4 = tw * 3 THEN (z + coalesce(zn, z)) / 2.0 ELSE z END, cw) FILTER (WHERE cw * 4 >= tw * 3) AS q75 FROM running GROUP BY cx, cy""")
def block_stats_ties(i):
    return blocks.cell_stats(i.used, SMALL, average_ties=True).select("cx", "cy", "q25", "median", "q75")


@query("SELECT * FROM product")
def block_product(i):
    """The flagship: repaired, included points to statistics by cell with what is known of their dataset."""
    points = tiling.included(ingest.depth_rule(i.soundings), i.metadata)
    return blocks.augmented(blocks.cell_stats(points, SMALL), i.metadata)


@query("""SELECT tile_id, basic_tile, 'low' AS type, count(*) AS bm_windows, string_agg(DISTINCT rid, ';' ORDER BY rid) AS cruises, count(DISTINCT rid) AS n_cruises, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(med) AS zmin, max(med) AS zmax
  FROM (SELECT *, CAST(1 + tx + 6 * ty AS INT) tile_id, CAST(1 + tx // 3 + 2 * (ty // 3) AS INT) basic_tile FROM (SELECT *, CAST(CASE WHEN x = -24000 THEN 0 ELSE ceil((x + 24000) / 8000.0) - 1 END AS BIGINT) tx, CAST(CASE WHEN y = -24000 THEN 0 ELSE ceil((y + 24000) / 8000.0) - 1 END AS BIGINT) ty FROM stats)) GROUP BY tile_id, basic_tile""")
def block_tile_summary(i):
    return blocks.by_tile(i.stats, SMALL, "low")


@query('SELECT x, y, "median" AS "value" FROM product')
def block_column(i):
    return blocks.column(blocks.augmented(i.stats, i.metadata), "median")


@query("""SELECT x, y, attribute, CAST("value" AS BIGINT) AS "value" FROM (SELECT x, y, unnest(['rid', 'min', 'q25', 'median', 'q75', 'max', 'sum_weight', 'tid', 'dataset_weight']) attribute, unnest([rid, "min", q25, "median", q75, "max", sum_weight, tid, dataset_weight]) "value" FROM product)""")
def block_long_columns(i):
    return blocks.long_columns(blocks.augmented(i.stats, i.metadata))


@query("SELECT x, y, z, rid, tid FROM static_points")
def block_steering(i):
    """Static points from their files: separators, rounding, and the dataset of the file's name."""
    return blocks.steering(i.static_lines, i.steering_table)


@query("""SELECT cx, cy, m.x AS x, m.y AS y, m.rid AS rid, m.z AS "median", n FROM (SELECT cx, cy, min({'z': z, 'x': x, 'y': y, 'rid': rid}) FILTER (WHERE cw * 2 >= tw) m, count(*) AS n FROM (SELECT *, count(*) OVER (PARTITION BY cx, cy ORDER BY z, x, y, rid ROWS UNBOUNDED PRECEDING) cw, count(*) OVER (PARTITION BY cx, cy) tw
  FROM (SELECT *, CAST(floor((x + 24000) / 500.0) AS INT) cx, CAST(floor((y + 24000) / 500.0) AS INT) cy FROM static_points WHERE z < 1420 AND x >= -24000 AND x < 24000 AND y >= -24000 AND y < 24000)) GROUP BY cx, cy)""")
def block_static(i):
    """Static points below the surface limit, unweighted medians."""
    return blocks.static_medians(blocks.surface_points(blocks.steering(i.static_lines, i.steering_table)), SMALL)


@query("""SELECT s.x, s.y, s.rid, mn AS "min", q25, med AS "median", q75, mx AS "max", sw AS sum_weight, coalesce(dataset_name, '0') AS data_name, coalesce(dataset_tid, 0) AS tid, coalesce(contrib_org, '0') AS contrib_org, coalesce(m.weight, 0) AS dataset_weight
  FROM (SELECT * REPLACE (CASE WHEN rid % 7 = 0 THEN 1 ELSE rid END AS rid) FROM stats) s LEFT JOIN metadata m ON s.rid = dataset_rid""")
def block_lookup_default(i):
    """Cells of unknown datasets get the defaults."""
    return blocks.augmented(i.stats.withColumn("rid", F.when(F.col("rid") % 7 == 0, 1).otherwise(F.col("rid"))), i.metadata)


def _summary(stats: str, kind: str) -> str:
    return f"""(SELECT tile_id, basic_tile, '{kind}' AS type, count(*) AS bm_windows, string_agg(DISTINCT rid, ';' ORDER BY rid) AS cruises, count(DISTINCT rid) AS n_cruises, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(med) AS zmin, max(med) AS zmax
  FROM (SELECT *, CAST(1 + tx + 6 * ty AS INT) tile_id, CAST(1 + tx // 3 + 2 * (ty // 3) AS INT) basic_tile FROM (SELECT *, CAST(CASE WHEN x = -24000 THEN 0 ELSE ceil((x + 24000) / 8000.0) - 1 END AS BIGINT) tx, CAST(CASE WHEN y = -24000 THEN 0 ELSE ceil((y + 24000) / 8000.0) - 1 END AS BIGINT) ty FROM {stats})) GROUP BY tile_id, basic_tile)"""


@query(f"SELECT * FROM {_summary('stats_high', 'high')}")
def block_tile_summary_high(i):
    return blocks.by_tile(blocks.cell_stats(blocks.high_resolution(i.used), SMALL), SMALL, "high")


@query(f"SELECT s.*, round(bytes / 1024 / 1024, 9) AS mb, CAST(modified AS DOUBLE) AS modified FROM {_summary('stats', 'low')} s LEFT JOIN tile_files USING (tile_id, type)")
def block_summary_files(i):
    s = blocks.with_files(blocks.by_tile(i.stats, SMALL, "low"), i.tile_files)
    return s.withColumn("mb", F.round("mb", 9)).withColumn("modified", F.col("modified").cast("double"))


@query("SELECT x, y, unnest(['data_name', 'contrib_org']) AS attribute, unnest([data_name, contrib_org]) AS value FROM product")
def block_long_texts(i):
    return blocks.long_texts(blocks.augmented(i.stats, i.metadata))


@query('SELECT x, y, q75 AS "value" FROM stats_high')
def block_column_high(i):
    return blocks.column(blocks.cell_stats(blocks.high_resolution(i.used), SMALL), "q75")


_FILES = "(SELECT rid, max(CASE WHEN rid % 8 = 3 THEN weight + 1 ELSE weight END) weight FROM soundings GROUP BY rid UNION ALL SELECT 7, 5)"


def _files(i):
    f = i.soundings.groupBy("rid").agg(F.max(F.when(F.col("rid") % 8 == 3, F.col("weight") + 1).otherwise(F.col("weight"))).cast("int").alias("weight"))
    return f.unionByName(i.spark.createDataFrame([(7, 5)], "rid long, weight int"))


@query(f"SELECT rid, weight FROM {_FILES} WHERE rid IN (SELECT dataset_rid FROM metadata)")
def catalog_known(i):
    return catalog.known(_files(i), i.metadata)


@query(f"SELECT rid, weight FROM {_FILES} WHERE rid NOT IN (SELECT dataset_rid FROM metadata)")
def catalog_unknown(i):
    return catalog.unknown(_files(i), i.metadata)


@query(f"SELECT rid, f.weight, m.weight AS recorded FROM {_FILES} f JOIN metadata m ON rid = dataset_rid WHERE f.weight IS DISTINCT FROM m.weight")
def catalog_drift(i):
    return catalog.drifted(_files(i), i.metadata)


@query(f"SELECT rid, count(dataset_rid) AS n FROM (SELECT DISTINCT rid FROM {_FILES}) LEFT JOIN metadata ON rid = dataset_rid GROUP BY rid")
def catalog_usage(i):
    return catalog.usage(_files(i), i.metadata)


@query("SELECT upper(s_name) || CASE WHEN s_suppkey % 5 = 0 THEN 'x' ELSE '' END AS name, CAST(CASE WHEN s_suppkey % 5 <> 0 THEN 10001 + s_suppkey END AS DOUBLE) AS rid FROM supplier")
def catalog_lookup(i):
    names = i.table("supplier").select(F.concat(F.upper("s_name"), F.when(F.col("s_suppkey") % 5 == 0, "x").otherwise("")).alias("name"))
    return catalog.looked_up(names, i.metadata).withColumn("rid", F.col("rid").cast("double"))


@query("SELECT file, CAST(dataset_rid AS DOUBLE) AS rid, CAST(dataset_tid AS DOUBLE) AS tid FROM (SELECT DISTINCT file FROM static_lines) LEFT JOIN steering_table ON regexp_replace(string_split(file, '/')[-1], '\\.[^.]*$', '') = dataset_name")
def catalog_lookup_static(i):
    got = catalog.looked_up_static(i.static_lines.select("file").distinct(), i.steering_table)
    return got.select("file", F.col("rid").cast("double").alias("rid"), F.col("tid").cast("double").alias("tid"))


_DELIVERED = "(SELECT 'in/' || dataset_name AS file FROM metadata WHERE dataset_rid % 3 = 0 UNION ALL SELECT 'in/stranger')"


def _delivered(i):
    return i.metadata.filter("dataset_rid % 3 = 0").select(F.concat(F.lit("in/"), "dataset_name").alias("file")).unionByName(i.spark.createDataFrame([("in/stranger",)], "file string"))


@query("SELECT dataset_rid, dataset_name, weight, CASE WHEN dataset_rid % 3 <> 0 THEN CAST(date_harmonised AS VARCHAR) END AS date_harmonised, CASE WHEN dataset_rid % 3 <> 0 THEN CAST(date_tiled AS VARCHAR) END AS date_tiled FROM dated")
def catalog_redelivered(i):
    return catalog.redelivered(i.dated, _delivered(i))[0].withColumns({c: F.col(c).cast("string") for c in ("date_harmonised", "date_tiled")})


@query("SELECT 'stranger' AS file")
def catalog_strangers(i):
    return catalog.redelivered(i.dated, _delivered(i))[1]


@query("SELECT dataset_rid, dataset_name, CAST(CASE WHEN dataset_rid % 4 = 0 THEN 99 ELSE weight END AS INTEGER) AS weight FROM metadata UNION ALL SELECT 7, 'new', 5")
def catalog_replaced(i):
    m = i.metadata.select("dataset_rid", "dataset_name", "weight")
    new = m.filter("dataset_rid % 4 = 0").withColumn("weight", F.lit(99)).unionByName(i.spark.createDataFrame([(7, "new", 5)], "dataset_rid long, dataset_name string, weight int"))
    return catalog.replaced(m, new, "dataset_rid")


@query("SELECT dataset_rid, dataset_name, dataset_tid, contrib_org, weight FROM metadata")
def catalog_rid_lookup(i):
    return catalog.views(i.metadata, i.tiles)["rid_lookup"]


@query("SELECT DISTINCT ID, basicTile FROM tiles")
def catalog_unique_tiles(i):
    return catalog.views(i.metadata, i.tiles)["unique_tiles"]


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN c_name END AS name, c_mktsegment AS segment FROM customer")
def catalog_curated(i):
    dirty = F.when(F.col("c_custkey") % 3 == 0, F.element_at(F.array(F.lit(" "), F.lit('""'), F.lit("''"), F.lit("\t")), (F.col("c_custkey") % 4 + 1).cast("int"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(" \t"), "c_name", F.lit("\r\n ")))
    return catalog.curated(i.table("customer").select("c_custkey", dirty.alias("name"), F.concat("c_mktsegment", F.lit(" ")).alias("segment")))


@query("SELECT doc_id, CASE WHEN trim(translate(text, chr(9) || chr(10) || chr(13), '')) NOT IN ('', '\"\"', '''''') THEN trim(translate(text, chr(9) || chr(10) || chr(13), '')) END AS text FROM documents")
def catalog_curated_documents(i):
    return catalog.curated(i.table("documents").select("doc_id", "text"))


@query("SELECT m.dataset_rid, dataset_name, dataset_tid, contrib_org, weight, include, CAST(xmin AS DOUBLE) AS xmin, CAST(xmax AS DOUBLE) AS xmax, CAST(ymin AS DOUBLE) AS ymin, CAST(ymax AS DOUBLE) AS ymax, CAST(zmin AS DOUBLE) AS zmin, CAST(zmax AS DOUBLE) AS zmax FROM metadata m LEFT JOIN (SELECT rid, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(z) AS zmin, max(z) AS zmax FROM tiled GROUP BY rid) e ON m.dataset_rid = e.rid")
def catalog_refreshed(i):
    r = catalog.refreshed(i.metadata, tiling.extents(tiling.tiled(i.used, SMALL), "rid"))
    return r.withColumns({c + e: F.col(c + e).cast("double") for c in "xyz" for e in ("min", "max")})


@query("""SELECT f[1] AS step, count(*) AS n_tasks, count(DISTINCT f[2]) AS n_jobs, round(sum(CAST(f[7] AS BIGINT)) / 1024 / 1024, 6) AS mb, CAST(sum(CAST(f[9] AS BIGINT) - CAST(f[8] AS BIGINT)) AS BIGINT) AS total_ms, max(CAST(f[9] AS BIGINT) - CAST(f[8] AS BIGINT)) AS longest_ms
  FROM (SELECT string_split(value[9:], ' ') f FROM report WHERE value LIKE 'CSVLINE %') GROUP BY f[1]""")
def catalog_run_report(i):
    return catalog.run_report(i.report)


@query("SELECT ID, basicTile, West, East, South, North, note FROM tiles LEFT JOIN (SELECT CAST(s_suppkey AS INT) t, s_name note FROM supplier) ON ID = t")
def catalog_tile_edits(i):
    edits = i.table("supplier").select(F.col("s_suppkey").cast("int").alias("tileID"), F.col("s_name").alias("note"))
    return catalog.views(i.metadata, i.tiles, edits)["tile_edits"]


@query("SELECT dataset_rid, dataset_name, dataset_tid, contrib_org, weight FROM metadata WHERE include = 1")
def catalog_included(i):
    return catalog.views(i.metadata, i.tiles)["included"]


@query("SELECT dataset_rid, dataset_name, dataset_tid FROM (SELECT dataset_rid - CASE WHEN dataset_rid % 5 = 0 THEN 10000 ELSE 0 END AS dataset_rid, dataset_name, dataset_tid FROM metadata) WHERE dataset_rid < 10000")
def catalog_steering(i):
    m = i.metadata.withColumn("dataset_rid", F.col("dataset_rid") - F.when(F.col("dataset_rid") % 5 == 0, 10000).otherwise(0))
    return catalog.views(m, i.tiles)["steering"]


@query("SELECT basicTile, count(*) AS n_tiles FROM tiles GROUP BY basicTile")
def catalog_basic_tiles(i):
    return catalog.views(i.metadata, i.tiles)["unique_basic_tiles"]


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS label, ts AS parsed, strftime(make_timestamp(event_id * 1000000), '%Y-%m-%d %H:%M:%S') AS from_epoch FROM (SELECT event_id, date_trunc('second', ts) ts FROM events)")
def catalog_times(i):
    e = i.table("events").select("event_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"))
    label = X.stamp_text(F.col("ts"))
    return e.select("event_id", label.alias("label"), X.stamp(label).alias("parsed"), X.stamp_text(X.epoch(F.col("event_id"))).alias("from_epoch"))


@query("SELECT name, unnest(CASE WHEN contains(t, '-') THEN range(CAST(string_split(t, '-')[1] AS INT), CAST(string_split(t, '-')[2] AS INT) + 1) ELSE CAST(string_split(t, ';') AS BIGINT[]) END)::INTEGER AS tile_id FROM (VALUES ('a', '3-9'), ('b', '1;7;30'), ('c', '36')) v(name, t)")
def catalog_area_tiles(i):
    return compare.area_tiles(_areas(i))


def _areas(i):
    return i.spark.createDataFrame([("a", "3-9"), ("b", "1;7;30"), ("c", "36")], "name string, tiles string")


@query(f"SELECT tile_id, CAST(len(string_split(cruises, ';')) AS INTEGER) AS n FROM {_RIDS}")
def catalog_list_length(i):
    return tiling.rids_by_tile(tiling.tiled(i.used, SMALL)).select("tile_id", X.list_length(F.col("cruises")).alias("n"))


@query("SELECT cx, cy, arg_min(rid, (l_orderkey, l_linenumber, z, rid)) AS v FROM celled GROUP BY cx, cy")
def raster_first_in_cell(i):
    return raster.first_in_cell(i.used, SMALL, "rid", ["l_orderkey", "l_linenumber", "z"])


@query("SELECT x, y, z, priority FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY priority, l_orderkey, l_linenumber, z) k FROM (SELECT floor(x / 900.0)::BIGINT x, floor(y / 900.0)::BIGINT y, z, l_orderkey, l_linenumber, CASE WHEN rid % 10 = 9 THEN 2 ELSE 1 END AS priority FROM clean)) WHERE k = 1")
def raster_first_per_position(i):
    p = i.clean.withColumn("x", F.floor(F.col("x") / 900)).withColumn("y", F.floor(F.col("y") / 900))
    both = raster.with_precedence(p.filter("rid % 10 <> 9"), p.filter("rid % 10 = 9"))
    return raster.first_per_position(both, ["priority", "l_orderkey", "l_linenumber", "z"]).select("x", "y", "z", "priority")


@query("SELECT c.cx, c.cy, CASE WHEN v IS NULL THEN 0 ELSE 1 END AS m FROM cells c LEFT JOIN composite USING (cx, cy)")
def raster_finite_mask(i):
    return raster.finite_mask(i.cells, i.composite)


_LOGIC = """(SELECT cx, cy, e, r, i, ice_m, CASE WHEN ice_m = 0 AND (r < 300 OR r = 400 OR r > 401) THEN 1 ELSE 0 END ocean_m FROM
  (SELECT *, CASE WHEN i > 0 AND (r < 300 OR r = 400 OR r > 401) THEN 1 ELSE 0 END ice_m FROM
  (SELECT cx, cy, med + 3000 AS e, CASE WHEN cx % 5 = 0 THEN 350 ELSE rid END AS r, v AS i FROM stats JOIN ice USING (cx, cy))))"""


def _logic(i):
    a = i.stats.join(i.ice, ["cx", "cy"]).select("cx", "cy", (F.col("median") + 3000).alias("e"), F.when(F.col("cx") % 5 == 0, 350).otherwise(F.col("rid")).alias("r"), F.col("v").alias("i"))
    a = a.withColumn("ice_m", raster.ice_mask("i", "r"))
    return a.withColumn("ocean_m", raster.ocean_mask("ice_m", "r"))


@query(f"""SELECT cx, cy, ice_m, ocean_m, CASE WHEN ocean_m = 1 AND e <= -1 THEN e WHEN ocean_m = 1 THEN -1 WHEN ice_m = 0 AND e < 0 THEN 1 ELSE e END AS bed,
  CASE WHEN ice_m = 0 THEN e ELSE i END AS surface, CAST(CASE WHEN ocean_m = 1 THEN e END AS DOUBLE) AS sea FROM {_LOGIC}""")
def raster_logic(i):
    return _logic(i).select("cx", "cy", "ice_m", "ocean_m", raster.corrected("e", "ice_m", "ocean_m").alias("bed"), raster.substituted("e", "i", "ice_m").alias("surface"), raster.within("e", "ocean_m").cast("double").alias("sea"))


@query("SELECT cx, cy, round((q75 - q25) / 1.35, 6) AS std FROM stats")
def raster_spread(i):
    return i.stats.select("cx", "cy", F.round(raster.spread("q25", "q75"), 6).alias("std"))


@query("SELECT cx, cy, CAST(CASE WHEN m = 1 THEN 500 END AS DOUBLE) AS rid, CAST(CASE WHEN m = 1 THEN 40 END AS DOUBLE) AS tid, 1 - m AS inverse FROM mask")
def raster_infill(i):
    return i.mask.select("cx", "cy", raster.infill("m", 500).cast("double").alias("rid"), raster.infill("m", 40).cast("double").alias("tid"), raster.inverted("m").alias("inverse"))


@query("SELECT c.cx, c.cy, coalesce(t.v, b.v, 41) AS v FROM cells c LEFT JOIN (SELECT * FROM composite WHERE cx % 2 = 0) t USING (cx, cy) LEFT JOIN (SELECT * FROM background WHERE cy % 3 = 0) b USING (cx, cy) ")
def raster_priority_merge(i):
    empty = i.cells.withColumn("v", F.lit(None).cast("long"))
    return raster.priority_merge(i.composite.filter("cx % 2 = 0"), i.background.filter("cy % 3 = 0"), empty, default=41)


@query("SELECT v AS rid, count(*) AS n_cells FROM rids WHERE v >= 10000 GROUP BY v")
def raster_cells_per_rid(i):
    return raster.cells_per_rid(i.rids)


@query("SELECT v AS rid, count(*) AS n_cells FROM rids JOIN mask USING (cx, cy) WHERE v >= 10000 AND m = 1 GROUP BY v")
def raster_cells_per_rid_ocean(i):
    return raster.cells_per_rid(i.rids, ocean=i.mask)


@query("SELECT count(*) AS n_cells, count(DISTINCT v) AS n_rids FROM rids WHERE v >= 10000")
def raster_data_cells(i):
    return raster.data_cells(i.rids)


@query("""SELECT cx, cy, round(v, 6) AS v, CAST(level AS INTEGER) AS level FROM (WITH a AS (SELECT cx // 2 cx, cy // 2 cy, avg(CAST(v AS DOUBLE)) v FROM composite GROUP BY ALL), b AS (SELECT cx // 2 cx, cy // 2 cy, avg(v) v FROM a GROUP BY ALL)
  SELECT *, 1 AS level FROM a UNION ALL SELECT *, 2 FROM b UNION ALL SELECT cx // 2, cy // 2, avg(v), 3 FROM b GROUP BY ALL)""")
def raster_pyramid(i):
    return raster.pyramid(i.composite, 3).withColumn("v", F.round("v", 6))


@query("SELECT cx // 4 AS cx, cy // 4 AS cy, round(quantile_cont(v, 0.5), 6) AS v FROM composite GROUP BY ALL")
def raster_coarse_median(i):
    return raster.coarse_median(i.composite, 4).withColumn("v", F.round("v", 6))


@query('SELECT count(v) AS n, min(v) AS "min", max(v) AS "max", round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM composite')
def raster_statistics(i):
    return raster.statistics(i.composite)


@query("SELECT * FROM composite WHERE cx BETWEEN 10 AND 40 AND cy BETWEEN 5 AND 60")
def raster_cut(i):
    return raster.cut(i.composite, 10, 40, 5, 60)


@query("SELECT * FROM composite WHERE 1 + cx // 16 + 6 * (cy // 16) IN (3, 4, 5, 6, 7, 8, 9, 1, 30, 36)")
def raster_in_area(i):
    return raster.in_area(i.composite, compare.area_tiles(_areas(i)), SMALL)


@query("SELECT cx, cy, CASE WHEN m = 1 AND b.v <> 0 THEN round(least(greatest(c.v / b.v, 0.5), 1.5), 6) END AS factor, CAST(trunc(b.v * coalesce(least(greatest(c.v / b.v, 0.5), 1.5), 1)) AS INTEGER) AS adjusted FROM composite c JOIN background b USING (cx, cy) JOIN mask USING (cx, cy)")
def raster_factor(i):
    a = raster.aligned("inner", c=i.composite, b=i.background, m=i.mask)
    a = a.withColumn("f", raster.factor("c", "b", "m")).withColumn("g", F.least(F.greatest(F.col("c") / F.col("b"), F.lit(0.5)), F.lit(1.5)))
    return a.select("cx", "cy", F.round("f", 6).alias("factor"), raster.adjusted("b", "g").alias("adjusted"))


@query("SELECT cx, cy, b.v AS x, c.v AS y FROM background b JOIN composite c USING (cx, cy) WHERE b.v IS NOT NULL AND c.v IS NOT NULL")
def compare_pairs(i):
    return compare.pairs(i.background, i.composite)


_PAIR = "(SELECT b.cx, b.cy, CAST(b.v AS DOUBLE) x, CAST(c.v AS DOUBLE) y, row_number() OVER (ORDER BY b.cy, b.cx) - 1 AS seq FROM background b JOIN composite c USING (cx, cy))"


def _pair(i):
    return compare.sequenced(compare.pairs(i.background, i.composite), "cy", "cx")


@query(f"SELECT (seq + 1) // 100 AS bin, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(y) - avg(x), 6) AS diff, count(*) AS n FROM {_PAIR} GROUP BY 1")
def compare_binned_100(i):
    return compare.binned(_pair(i), 100)


@query(f"SELECT (seq + 1) // 500 AS bin, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(y) - avg(x), 6) AS diff, count(*) AS n FROM {_PAIR} GROUP BY 1")
def compare_binned_500(i):
    return compare.binned(_pair(i), 500)


@query(f"SELECT seq // 100 AS bin, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(y) - avg(x), 6) AS diff, count(*) AS n FROM {_PAIR} GROUP BY 1")
def compare_chunked(i):
    return compare.chunked(_pair(i), 100)


@query(f"SELECT CAST(floor(x / 250) * 250 AS BIGINT) AS bin, round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(*) AS n FROM {_PAIR} GROUP BY 1")
def compare_value_bins(i):
    return compare.value_bins(_pair(i), 250)


@query(f"SELECT cx, cy, round(avg(y) OVER (PARTITION BY cy ORDER BY seq ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS mean FROM {_PAIR}")
def compare_moving(i):
    return compare.moving(_pair(i), 5, 5, "cy").select("cx", "cy", "mean")


@query("SELECT row_number() OVER (ORDER BY x, y) - 1 AS seq, x, round(avg(y) OVER (ORDER BY x, y ROWS BETWEEN 50 PRECEDING AND 50 FOLLOWING), 6) AS mean FROM (SELECT b.v AS x, c.v AS y FROM background b JOIN composite c USING (cx, cy))")
def compare_moving_sorted(i):
    return compare.moving_sorted(compare.pairs(i.background, i.composite), 50, 50)


@query(f"SELECT CAST(b AS INTEGER) AS bin, -6000 + (b - 0.5) * 300.0 AS middle, round(n / (SELECT count(*) FROM {_PAIR}) / 300.0, 12) AS density FROM (SELECT floor((y + 6000) / 300) + 1 AS b, count(*) AS n FROM {_PAIR} WHERE y >= -6000 AND y < 0 GROUP BY 1)")
def compare_density(i):
    return compare.density(_pair(i), "y", -6000, 0, 20)


@query(f"SELECT CAST(CASE WHEN y < -6000 THEN 0 WHEN y >= 0 THEN 21 ELSE floor((y + 6000) / 300) + 1 END AS INTEGER) AS bin, count(*) AS n FROM {_PAIR} GROUP BY 1")
def compare_histogram(i):
    return compare.histogram(_pair(i), "y", -6000, 0, 20)


@query("SELECT DISTINCT v AS value, round(cume_dist() OVER (ORDER BY v), 9) AS share FROM composite")
def compare_ecdf(i):
    return compare.ecdf(i.composite, "v")


@query('SELECT count(v) AS n, min(v) AS "min", max(v) AS "max", round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS "median" FROM composite')
def compare_summary(i):
    return compare.summary(i.composite, "v")


_DISC = "(SELECT cx, cy, round(CASE WHEN b.v + c.v <> 0 THEN (c.v - b.v) / ((b.v + c.v) / 2) END, 9) AS discrepancy FROM background b JOIN composite c USING (cx, cy))"


@query(f"SELECT * FROM {_DISC}")
def compare_discrepancy(i):
    return compare.discrepancy(i.background, i.composite)


@query(f"SELECT name, count(*) AS n, round(avg(discrepancy), 6) AS mean FROM {_DISC} d JOIN (SELECT name, unnest(t) tile FROM (VALUES ('a', [3, 4, 5, 6, 7, 8, 9]), ('b', [1, 7, 30]), ('c', [36])) v(name, t)) ON 1 + cx // 16 + 6 * (cy // 16) = tile GROUP BY name")
def compare_areas(i):
    return compare.area_discrepancy(i.background, i.composite, _areas(i), SMALL)


@query("SELECT CAST(b AS INTEGER) AS b, CAST(x - 22 AS INTEGER) AS dx, CAST(y - 22 AS INTEGER) AS dy FROM (VALUES (1), (3), (4), (5), (20)) v(b), range(45) p(x), range(45) q(y) WHERE (x - 22) ** 2 + (y - 22) ** 2 <= b * b + b // 2")
def morph_footprints(i):
    out = None
    for b in (1, 3, 4, 5, 20):
        part = morphology.offsets(i.spark, morphology.disc(b)).select(F.lit(b).alias("b"), "dx", "dy")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT * FROM grown3")
def morph_dilation(i):
    return morphology.dilate(morphology.ones(i.mask), morphology.disc(3), N)


@query("SELECT * FROM eroded3")
def morph_erosion(i):
    return morphology.erode(morphology.ones(i.mask), morphology.disc(3), N, 1)


@query("SELECT * FROM eroded3 WHERE cx BETWEEN 3 AND 92 AND cy BETWEEN 3 AND 92")
def morph_erosion_edge(i):
    return morphology.erode(morphology.ones(i.mask), morphology.disc(3), N, 0)


_CLOSED = """(SELECT c.cx, c.cy FROM cells c WHERE NOT EXISTS (SELECT 1 FROM (SELECT cx, cy FROM cells EXCEPT SELECT DISTINCT m.cx + dx, m.cy + dy FROM mask m, square1 WHERE m = 1) z, square1 d WHERE z.cx = c.cx + dx AND z.cy = c.cy + dy))"""


@query(f"SELECT * FROM {_CLOSED}")
def morph_closing(i):
    return morphology.close(morphology.ones(i.mask), 3, N)


@query("SELECT c.cx, c.cy, m.m, CASE WHEN g.cx IS NULL THEN 0 ELSE 1 END AS grown, m.m AS shrunk, CASE WHEN (g.cx IS NOT NULL) <> (m.m = 1) THEN 1 ELSE 0 END AS zone FROM cells c JOIN mask m USING (cx, cy) LEFT JOIN grown3 g USING (cx, cy)")
def morph_zones(i):
    return morphology.zones(i.mask, 3, N)


@query("SELECT cx, cy, m, grown, shrunk, CASE WHEN grown <> shrunk THEN 1 ELSE 0 END AS zone FROM zones3")
def morph_zones_smooth(i):
    return morphology.zones(i.mask, 3, N, smooth=True, percentage=0.2)


@query("SELECT cx, cy, CASE WHEN a.m = 0 THEN 1 ELSE b.m END AS m FROM mask b JOIN allowed a USING (cx, cy)")
def morph_override(i):
    return morphology.override(i.mask, i.allowed)


@query("SELECT a.cx, a.cy, CAST(min((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) AS BIGINT) AS d2 FROM mask a, mask b WHERE b.m = 0 GROUP BY ALL")
def morph_distance(i):
    return morphology.distance(i.mask)


@query("SELECT cx, cy, round(mean, 6) AS mean FROM mean3")
def morph_convolution(i):
    merged = raster.aligned("inner", m=i.mask, s=i.sharp, c=i.background).select("cx", "cy", F.when(F.col("m") == 1, F.col("s")).otherwise(F.col("c")).alias("v"))
    return morphology.convolve(merged, morphology.disc(3), N).withColumn("mean", F.round("mean", 6))


@query("""SELECT cx, cy, round(CAST(CASE WHEN grown <> shrunk THEN coalesce((d / nullif(di2, 0) + coarse / nullif(do2, 0)) / (1 / nullif(di2, 0) + 1 / nullif(do2, 0)), CASE WHEN do2 IS NULL OR do2 = 0 THEN coarse END, d)
  WHEN grown = 0 THEN coarse ELSE d END AS DOUBLE), 4) AS v FROM (SELECT z.*, di2, do2, coarse, CASE WHEN shrunk = 1 THEN sharp ELSE mean END d FROM zones3 z LEFT JOIN di USING (cx, cy) LEFT JOIN dout USING (cx, cy) JOIN merged USING (cx, cy) JOIN mean3 USING (cx, cy))""")
def product_blend(i):
    return product.blend(i.mask, i.sharp, i.background, 3, N, smooth=True, percentage=0.2).withColumn("v", F.round("v", 4))


def _all_statistics() -> str:
    """The blend's SQL for each statistic in turn, side by side."""
    parts = []
    for name, column in (("median", "med"), ("q25", "q25"), ("q75", "q75"), ("min", "mn"), ("max", "mx")):
        one = SQL["product_blend"].replace("composite AS (SELECT cx, cy, med AS v FROM stats)", f"composite AS (SELECT cx, cy, {column} AS v FROM stats)")
        parts.append(f"SELECT '{name}' AS statistic, * FROM ({one})")
    return " UNION ALL ".join(parts)


@query()
def product_blend_all(i):
    """All five statistics over one set of zones and distances."""
    sharp = i.background.select("cx", "cy", F.col("v").alias("b")).join(i.stats.select("cx", "cy", *product.STATISTICS), ["cx", "cy"], "left").select("cx", "cy", *(F.coalesce(c, "b").alias(c) for c in product.STATISTICS))
    coarse = i.background.select("cx", "cy", *(F.col("v").alias(c) for c in product.STATISTICS))
    b = product.blend_all(i.mask, sharp, coarse, 3, N)
    return b.unpivot(["cx", "cy"], list(product.STATISTICS), "statistic", "v").withColumn("v", F.round("v", 4))


SQL["product_blend_all"] = _all_statistics()


@query("""SELECT cx, cy, round(v, 6) AS v FROM (SELECT cx, cy, count(*) n, sum(z / (1 + 9 * d2 / 1e6)) / sum(1 / (1 + 9 * d2 / 1e6)) v FROM (SELECT cx, cy, s, min({'d2': d2, 'z': z}).d2 d2, min({'d2': d2, 'z': z}).z z FROM (
  SELECT cx, cy, z, (x - px) ** 2 + (y - py) ** 2 d2, CASE WHEN x >= px THEN CASE WHEN y >= py THEN 0 ELSE 3 END WHEN y >= py THEN 1 ELSE 2 END s FROM (SELECT cx, cy, cx * 500 - 23750 px, cy * 500 - 23750 py FROM cells) JOIN used ON x BETWEEN px - 1000 AND px + 1000 AND y BETWEEN py - 1000 AND py + 1000)
  WHERE d2 <= 1e6 GROUP BY cx, cy, s) GROUP BY cx, cy) WHERE n >= 4""")
def grid_nearest_neighbour(i):
    return gridding.nearest_neighbour(i.used, SMALL).withColumn("v", F.round("v", 6))


@query("""SELECT a.cx, a.cy, round(sum(w * v) / sum(w), 6) AS v FROM cells a, (SELECT CAST(p - 6 AS INT) dx, CAST(q - 6 AS INT) dy, 1 + cos(pi() * sqrt((p - 6) ** 2 + (q - 6) ** 2) * 500 / 3000) w FROM range(13) x(p), range(13) y(q) WHERE (p - 6) ** 2 + (q - 6) ** 2 <= 36) d
  JOIN composite b ON b.cx = a.cx + dx AND b.cy = a.cy + dy WHERE w > 0 GROUP BY a.cx, a.cy""")
def grid_cosine_filter(i):
    return gridding.cosine_filter(i.composite, 6000.0, 500.0, N).withColumn("v", F.round("v", 6))


_CUBIC = "CASE k WHEN 0 THEN (-t*t*t + 2*t*t - t) / 2 WHEN 1 THEN (3*t*t*t - 5*t*t + 2) / 2 WHEN 2 THEN (-3*t*t*t + 4*t*t + t) / 2 ELSE (t*t*t - t*t) / 2 END"


@query(f"""SELECT fx AS cx, fy AS cy, round(s / w, 6) AS v FROM (SELECT fx, fy, sum(a.w * b.w * v) s, sum(a.w * b.w) w FROM (SELECT f fx, i + k - 1 cx, {_CUBIC} w FROM (SELECT f, CAST(floor((f + 0.5) / 4 - 0.5) AS INT) i, (f + 0.5) / 4 - 0.5 - floor((f + 0.5) / 4 - 0.5) t FROM (SELECT CAST(r AS INT) f FROM range(96) q(r))), (SELECT CAST(r AS INT) k FROM range(4) q(r))) a,
  (SELECT f fy, i + k - 1 cy, {_CUBIC} w FROM (SELECT f, CAST(floor((f + 0.5) / 4 - 0.5) AS INT) i, (f + 0.5) / 4 - 0.5 - floor((f + 0.5) / 4 - 0.5) t FROM (SELECT CAST(r AS INT) f FROM range(96) q(r))), (SELECT CAST(r AS INT) k FROM range(4) q(r))) b
  JOIN (SELECT cx // 4 AS cx, cy // 4 AS cy, quantile_cont(v, 0.5) AS v FROM composite GROUP BY ALL) c ON c.cx = a.cx AND c.cy = b.cy GROUP BY fx, fy) WHERE abs(w) > 0.25""")
def grid_resample(i):
    return gridding.resample(raster.coarse_median(i.composite, 4), 4, N).withColumn("v", F.round("v", 6))


@query("""SELECT ix, iy, round(lon, 6) AS lon, round(lat, 6) AS lat, v FROM (SELECT *, CAST(floor((rho * sin(radians(lon)) + 24000) / 500) AS INT) cx, CAST(floor((rho * cos(radians(lon)) + 24000) / 500) AS INT) cy FROM (SELECT *, 6378137.0 * mc / tc * tan(pi() / 4 - radians(-lat) / 2) / pow((1 - e * sin(radians(-lat))) / (1 + e * sin(radians(-lat))), e / 2) rho FROM (
  SELECT *, tan(pi() / 4 - radians(65) / 2) / pow((1 - e * sin(radians(65))) / (1 + e * sin(radians(65))), e / 2) tc, cos(radians(65)) / sqrt(1 - (e * sin(radians(65))) ** 2) mc FROM (
  SELECT CAST(r % 360 AS INT) ix, CAST(r // 360 AS INT) iy, CAST(-180 + (r % 360 + 0.5) * 1.0 AS DOUBLE) lon, CAST(-90 AS DOUBLE) + (r // 360 + 0.5) * 0.01 lat, CAST(0.0818191908426215 AS DOUBLE) e FROM range(360 * 20) t(r))))) JOIN composite USING (cx, cy)""")
def grid_reproject(i):
    return gridding.reproject(i.composite, SMALL, -180.0, 180.0, -90.0, -89.8, 1.0, 0.01)


@query()
def grid_surface(i):
    return gridding.surface(raster.coarse_median(i.composite, 4), N // 4, upper=1420).withColumn("v", F.round("v", 3))


@query()
def product_interpolated(i):
    """The interpolated product: surface, filter, finer cells, cut."""
    return product.interpolated(raster.coarse_median(i.composite, 4), N // 4, window=(8, 87, 8, 87)).withColumn("v", F.round("v", 3))


@query()
def product_gap_fill(i):
    masked = raster.aligned("inner", v=i.composite, m=i.mask).filter("m = 1").select("cx", "cy", "v")
    return product.gap_fill(masked, i.background, raster.finite_mask(i.cells, masked), N, buffer=5, allowed=i.allowed)
