"""Inputs derived from the driver's tables, in SQL that both engines read, and the rasters built on them."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.config import SMALL

N = SMALL.cells

#: Each name in SQL over the tables and the names before it.
BASE = {
    "metadata": """SELECT 10001 + s_suppkey AS dataset_rid, s_name AS dataset_name,
        CASE s_suppkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 11 WHEN 2 THEN 17 ELSE 41 END AS dataset_tid, n_name AS contrib_org,
        CAST(5 * (1 + s_suppkey % 6) AS INT) AS weight, CASE WHEN s_suppkey % 10 = 9 THEN 0 ELSE 1 END AS include
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "soundings": """SELECT (l_partkey*7919 + l_orderkey*31 + l_linenumber*104729) % 48501 - 24250 AS x,
        (l_partkey*6007 + l_orderkey*977 + l_linenumber*15485863) % 48501 - 24250 AS y,
        CASE WHEN l_linenumber = 7 AND l_orderkey % 50 = 0 THEN 12000
          WHEN l_returnflag = 'R' THEN CAST(floor(l_extendedprice) AS BIGINT) % 6000
          ELSE -(CAST(floor(l_extendedprice) AS BIGINT) % 6000) END AS z,
        10001 + l_suppkey AS rid, CAST(5 * (1 + l_suppkey % 6) AS INT) AS weight, l_orderkey, l_linenumber FROM lineitem""",
    "raw_lines": """SELECT concat(CAST(rid AS STRING), '_w', CAST(weight AS STRING), '#', CAST(l_orderkey % 3 AS STRING), '.txt') AS file,
        CAST(row_number() OVER (PARTITION BY rid, l_orderkey % 3 ORDER BY l_orderkey, l_linenumber, x, y, z) AS BIGINT) AS line_no,
        CASE WHEN l_orderkey % 97 = 0 THEN 'bad' WHEN l_orderkey % 89 = 0 THEN concat(' ', CAST(x AS STRING), '.75,,', CAST(y AS STRING), '; --', CAST(abs(z) AS STRING), '.9.1 extra')
          WHEN l_orderkey % 83 = 0 THEN concat('m', CAST(x AS STRING), ' . ', CAST(z AS STRING))
          WHEN l_linenumber % 4 = 0 THEN concat(CAST(x AS STRING), ' ', CAST(y AS STRING), ' ', CAST(z AS STRING))
          WHEN l_linenumber % 4 = 1 THEN concat(CAST(x AS STRING), ';', CAST(y AS STRING), ';', CAST(z AS STRING))
          WHEN l_linenumber % 4 = 2 THEN concat(CAST(x AS STRING), ',', CAST(y AS STRING), ',', CAST(z AS STRING))
          ELSE concat(CAST(x AS STRING), chr(9), CAST(y AS STRING), chr(9), CAST(z AS STRING)) END AS value FROM soundings""",
    "tiles": """SELECT CAST(1 + id AS INT) AS ID, CAST(1 + floor((id % 6) / 3.0) + 2 * floor(floor(id / 6.0) / 3.0) AS INT) AS basicTile,
        CAST(-24000 + 8000 * (id % 6) AS DOUBLE) AS West, CAST(-16000 + 8000 * (id % 6) AS DOUBLE) AS East,
        CAST(-24000 + 8000 * floor(id / 6.0) AS DOUBLE) AS South, CAST(-16000 + 8000 * floor(id / 6.0) AS DOUBLE) AS North FROM range(36) AS t(id)""",
    "cells": "SELECT CAST(id % 96 AS INT) AS cx, CAST(floor(id / 96.0) AS INT) AS cy FROM range(9216) AS t(id)",
    "background": "SELECT cx, cy, -(1000 + (cx*37 + cy*53) % 3000) AS v FROM cells",
    "allowed": "SELECT cx, cy, CASE WHEN (floor(cx / 16.0) + floor(cy / 16.0)) % 5 = 0 THEN 0 ELSE 1 END AS m FROM cells",
    "ice": "SELECT cx, cy, CASE WHEN cx < 20 AND cy < 20 THEN 100 + cx + cy ELSE 0 END AS v FROM cells",
    "report": """SELECT CASE WHEN event_id % 11 = 0 THEN 'noise' ELSE concat('CSVLINE ', event_type, ' ', CAST(user_id AS STRING), ' ', CAST(event_id AS STRING), ' 9 me mini ',
        CAST(1000 * event_id AS STRING), ' ', CAST(7 * event_id AS STRING), ' ', CAST(7 * event_id + CAST(floor(value) AS BIGINT) AS STRING)) END AS value FROM events""",
    "static_lines": """SELECT concat('static/', CASE WHEN rid % 5 = 0 THEN 'unknown' ELSE dataset_name END, '.xyz') AS file,
        concat(CAST(x AS STRING), CASE WHEN l_orderkey % 3 = 0 THEN '.5,' ELSE ' ' END, CAST(y AS STRING), chr(9), CAST(z AS STRING), CASE WHEN l_orderkey % 2 = 0 THEN '.5' ELSE '.25' END, CASE WHEN l_orderkey % 101 = 0 THEN 'x' ELSE '' END) AS value
        FROM soundings JOIN metadata ON rid = dataset_rid WHERE l_linenumber = 1""",
    "steering_table": "SELECT dataset_rid - 9000 AS dataset_rid, dataset_name, dataset_tid FROM metadata WHERE dataset_rid - 9000 < 10000",
    "splits": """SELECT rid, l_orderkey % 3 AS part, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(z) AS zmin, max(z) AS zmax, max(l_orderkey) + 0.5 AS time_tiling FROM soundings GROUP BY rid, l_orderkey % 3""",
    "tile_files": "SELECT ID AS tile_id, 'low' AS type, CAST(1000 * ID + 24 AS BIGINT) AS bytes, CAST(7 * ID AS BIGINT) AS modified FROM tiles WHERE ID % 5 <> 0",
    "dated": """SELECT dataset_rid, dataset_name, weight, CAST('2020-01-02' AS DATE) AS date_harmonised, CASE WHEN dataset_rid % 2 = 0 THEN CAST('2021-03-04' AS DATE) END AS date_tiled FROM metadata""",
    "clean": "SELECT x, y, -abs(z) AS z, rid, weight, l_orderkey, l_linenumber FROM soundings WHERE abs(z) <= 11000",
    "used": "SELECT clean.* FROM clean WHERE rid IN (SELECT dataset_rid FROM metadata WHERE include = 1)",
}

#: What the operators make of them, in the other engine's SQL; the queries' own SQL builds on these.
DUCK = {
    "tiled": """SELECT x, y, z, rid, weight, l_orderkey, l_linenumber, CAST(1 + tx + 6 * ty AS INT) AS tile_id, CAST(1 + tx // 3 + 2 * (ty // 3) AS INT) AS basic_tile
        FROM (SELECT *, CAST(CASE WHEN x = -24000 THEN 0 ELSE ceil((x + 24000) / 8000.0) - 1 END AS BIGINT) tx, CAST(CASE WHEN y = -24000 THEN 0 ELSE ceil((y + 24000) / 8000.0) - 1 END AS BIGINT) ty FROM used)
        WHERE tx BETWEEN 0 AND 5 AND ty BETWEEN 0 AND 5 AND z > -9999""",
    "celled": "SELECT *, CAST(floor((x + 24000) / 500.0) AS INT) cx, CAST(floor((y + 24000) / 500.0) AS INT) cy FROM used WHERE x >= -24000 AND x < 24000 AND y >= -24000 AND y < 24000",
    "running": "SELECT *, sum(weight) OVER (PARTITION BY cx, cy ORDER BY z, x, y, rid ROWS UNBOUNDED PRECEDING) cw, sum(weight) OVER (PARTITION BY cx, cy) tw, lead(z) OVER (PARTITION BY cx, cy ORDER BY z, x, y, rid) zn FROM celled",
    "stats": """SELECT cx, cy, m.x AS x, m.y AS y, m.rid AS rid, mn, q25, med, q75, mx, sw, n FROM (SELECT cx, cy, min({'z': z, 'x': x, 'y': y, 'rid': rid}) FILTER (WHERE cw * 2 >= tw) m, min(z) mn, min(z) FILTER (WHERE cw * 4 >= tw) q25,
        min(z) FILTER (WHERE cw * 2 >= tw) med, min(z) FILTER (WHERE cw * 4 >= tw * 3) q75, max(z) mx, CAST(sum(weight) AS BIGINT) sw, count(*) n FROM running GROUP BY cx, cy)""",
    "product": """SELECT s.x, s.y, s.rid, mn AS "min", q25, med AS "median", q75, mx AS "max", sw AS sum_weight, coalesce(dataset_name, '0') AS data_name, coalesce(dataset_tid, 0) AS tid, coalesce(contrib_org, '0') AS contrib_org,
        coalesce(m.weight, 0) AS dataset_weight FROM stats s LEFT JOIN metadata m ON s.rid = m.dataset_rid""",
    "running_high": "SELECT *, sum(weight) OVER (PARTITION BY cx, cy ORDER BY z, x, y, rid ROWS UNBOUNDED PRECEDING) cw, sum(weight) OVER (PARTITION BY cx, cy) tw FROM celled WHERE weight IN (15, 20, 25, 30)",
    "stats_high": """SELECT cx, cy, m.x AS x, m.y AS y, m.rid AS rid, mn, q25, med, q75, mx, sw, n FROM (SELECT cx, cy, min({'z': z, 'x': x, 'y': y, 'rid': rid}) FILTER (WHERE cw * 2 >= tw) m, min(z) mn, min(z) FILTER (WHERE cw * 4 >= tw) q25,
        min(z) FILTER (WHERE cw * 2 >= tw) med, min(z) FILTER (WHERE cw * 4 >= tw * 3) q75, max(z) mx, CAST(sum(weight) AS BIGINT) sw, count(*) n FROM running_high GROUP BY cx, cy)""",
    "static_points": """SELECT x, y, z, rid, tid FROM (SELECT CAST(round_even(TRY_CAST(f[1] AS DOUBLE), 0) AS BIGINT) x, CAST(round_even(TRY_CAST(f[2] AS DOUBLE), 0) AS BIGINT) y, CAST(round_even(TRY_CAST(f[3] AS DOUBLE), 0) AS BIGINT) z, dataset_rid AS rid, dataset_tid AS tid
        FROM (SELECT string_split(trim(regexp_replace(value, '[,\\s]+', ' ', 'g')), ' ') f, regexp_replace(string_split(file, '/')[-1], '\\.[^.]*$', '') AS dataset_name FROM static_lines) JOIN steering_table USING (dataset_name)) WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL""",
    "composite": "SELECT cx, cy, med AS v FROM stats",
    "rids": "SELECT cx, cy, rid AS v FROM stats",
    "mask": "SELECT cx, cy, CASE WHEN cx % 24 < 14 AND cy % 24 < 15 AND NOT (cx % 24 = 5 AND cy % 24 = 5) AND (cx + cy) % 31 <> 0 THEN 1 ELSE 0 END AS m FROM cells",
    "disc3": "SELECT CAST(a - 3 AS INT) dx, CAST(b - 3 AS INT) dy FROM range(7) x(a), range(7) y(b) WHERE (a - 3) ** 2 + (b - 3) ** 2 <= 10",
    "disc5": "SELECT CAST(a - 6 AS INT) dx, CAST(b - 6 AS INT) dy FROM range(13) x(a), range(13) y(b) WHERE (a - 6) ** 2 + (b - 6) ** 2 <= 27",
    "square1": "SELECT CAST(a - 1 AS INT) dx, CAST(b - 1 AS INT) dy FROM range(3) x(a), range(3) y(b)",
    "grown3": "SELECT DISTINCT m.cx + dx AS cx, m.cy + dy AS cy FROM mask m, disc3 WHERE m = 1 AND m.cx + dx BETWEEN 0 AND 95 AND m.cy + dy BETWEEN 0 AND 95",
    "grown5": "SELECT DISTINCT m.cx + dx AS cx, m.cy + dy AS cy FROM mask m, disc5 WHERE m = 1 AND m.cx + dx BETWEEN 0 AND 95 AND m.cy + dy BETWEEN 0 AND 95",
    "eroded3": "SELECT c.cx, c.cy FROM cells c WHERE NOT EXISTS (SELECT 1 FROM mask m, disc3 d WHERE m.m = 0 AND m.cx = c.cx + dx AND m.cy = c.cy + dy)",
    "zones3": """SELECT c.cx, c.cy, m.m, CASE WHEN g.cx IS NULL THEN 0 ELSE 1 END grown, CASE WHEN e.cx IS NULL THEN 0 ELSE 1 END shrunk FROM cells c JOIN mask m USING (cx, cy) LEFT JOIN grown5 g USING (cx, cy) LEFT JOIN eroded3 e USING (cx, cy)""",
    "di": "SELECT a.cx, a.cy, min((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) di2 FROM zones3 a, zones3 b WHERE b.shrunk = 1 GROUP BY ALL",
    "dout": "SELECT a.cx, a.cy, min((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) do2 FROM zones3 a, zones3 b WHERE b.grown = 0 GROUP BY ALL",
    "merged": "SELECT c.cx, c.cy, CAST(CASE WHEN m = 1 THEN coalesce(p.v, b.v) ELSE b.v END AS INT) v, coalesce(p.v, b.v) sharp, b.v coarse FROM mask c LEFT JOIN composite p USING (cx, cy) JOIN background b USING (cx, cy)",
    "mirror": """SELECT CASE WHEN i < 0 THEN -i - 1 WHEN i > 95 THEN 191 - i ELSE i END j, i FROM (SELECT CAST(r - 6 AS INT) i FROM range(108) t(r))""",
    "mean3": """SELECT c.cx, c.cy, avg(CAST(m.v AS DOUBLE)) mean FROM cells c, disc3 d JOIN mirror mx ON mx.i = c.cx + dx JOIN mirror my ON my.i = c.cy + dy JOIN merged m ON m.cx = mx.j AND m.cy = my.j GROUP BY ALL""",
}


def sql(query: str) -> str:
    """A query with the definitions it needs in front, for the other engine."""
    known = BASE | DUCK
    need: list[str] = []

    def add(text: str) -> None:
        for word in re.findall(r"\b[a-z_0-9]+\b", text):
            if word in known and word not in need:
                add(known[word])
                if word not in need:
                    need.append(word)

    add(query)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({known[n].replace('STRING', 'VARCHAR')})" for n in need) + "\n" + query if need else query


class Inputs:
    """The tables of a folder and the inputs derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in BASE:
            raise AttributeError(name)
        text = BASE[name]
        words = set(re.findall(r"\b[a-z_]+\b", text))
        given = {n: getattr(self, n) for n in BASE if n in words and n != name}
        given |= {t: self.table(t) for t in ("lineitem", "supplier", "nation", "events") if t in words}
        for n in given:
            text = re.sub(rf"\b(FROM|JOIN) {n}\b(?! AS)", rf"\1 {{{n}}} AS {n}", text)
        return self.spark.sql(text, **given) if given else self.spark.sql(text)

    @cached_property
    def stats(self) -> DataFrame:
        """Written once for the query: most read it several times, and each would sort all points again."""
        from gridmill.operators.blocks import cell_stats
        from gridmill.sources.files import kept

        return kept(cell_stats(self.used, SMALL))

    @property
    def composite(self) -> DataFrame:
        return self.stats.select("cx", "cy", F.col("median").alias("v"))

    @property
    def rids(self) -> DataFrame:
        return self.stats.select("cx", "cy", F.col("rid").alias("v"))

    @property
    def mask(self) -> DataFrame:
        return self.cells.selectExpr("cx", "cy", "CASE WHEN cx % 24 < 14 AND cy % 24 < 15 AND NOT (cx % 24 = 5 AND cy % 24 = 5) AND (cx + cy) % 31 <> 0 THEN 1 ELSE 0 END AS m")

    @property
    def sharp(self) -> DataFrame:
        """The composite over the background where it has no value."""
        from gridmill.operators.raster import priority_merge

        return priority_merge(self.composite, self.background)
