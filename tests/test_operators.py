"""Edge cases with known results, and properties."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmill.config import SMALL, Grid
from gridmill.operators import blocks, catalog, compare, gridding, ingest, morphology, product, raster, tiling
from gridmill.plans.fixtures import N, Inputs
from gridmill.sources import files

from .conftest import SF


def lines(spark, *values):
    return spark.createDataFrame([("1_w5#0.txt", i + 1, v) for i, v in enumerate(values)], "file string, line_no long, value string")


@pytest.mark.parametrize(
    "text, want",
    [
        ("1.9 -2.9 3.9", (1, -2, -3)), ("1;2;-5", (1, 2, -5)), ("1,5 2 -5", (1, 5, -2)), ("1e5 +7 --8", (15, 7, -8)), ("1.2.3 0 0", (1, 0, 0)), ("  4\t5  -6  extra", (4, 5, -6)),
        ("1 2 12000", None), ("1 2 -11000.9", None), ("1 2 -11000", (1, 2, -11000)), ("1 2", None), ("a b c", None), ("", None), ("- . 1", None),
    ],
)
def test_repair(spark, text, want):
    got = [(r.x, r.y, r.z) for r in ingest.soundings(lines(spark, text)).collect()]
    assert got == ([want] if want else [])


def test_spans(spark):
    got = ingest.spans(lines(spark, "1 2 -3", "bad", "worse", "4 5 -6", "bad")).orderBy("first_line").collect()
    assert [(r.first_line, r.last_line, r.n_lines) for r in got] == [(2, 3, 2), (5, 5, 1)]
    assert ingest.spans(lines(spark)).count() == 0 and ingest.soundings(lines(spark, None)).count() == 0


def test_tile_edges(spark):
    g = Grid(low=-10, high=10, cell=1, tile=10, basic=1)
    xs = [-10.0, -5.0, 0.0, 5.0, 5.1, 10.0, 10.1]
    p = spark.createDataFrame([(x, -5.0) for x in xs], "x double, y double")
    got = {r.x: r.tile_id for r in tiling.with_tile(p, g).collect()}
    assert [got[x] for x in xs] == [1, 1, 1, 2, 2, 2, None]


def test_tile_reasons(spark):
    p = spark.createDataFrame([(0, 0, -5), (None, 0, -5), (99_999, 0, -5), (0, 0, -9999)], "x long, y long, z long")
    assert sorted(r.reason or "" for r in tiling.assigned(p, SMALL).collect()) == ["", "depth", "null", "outside"]


def test_extents(spark):
    p = spark.createDataFrame([(1, 0, 0, z) for z in (-10, -100, -500, -900)], "rid long, x long, y long, z long")
    r = tiling.extents(p, "rid").first()
    assert (r.zmin, r.zmax) == (-900, -10)


@pytest.mark.parametrize("ties, want", [(False, 2), (True, 6)])
def test_weighted_median(spark, ties, want):
    p = spark.createDataFrame([(0, 0, 1, 1, 1), (0, 0, 2, 2, 1), (0, 0, 10, 3, 2)], "x long, y long, z long, rid long, weight int")
    assert blocks.cell_stats(p, SMALL, average_ties=ties).first()["median"] == want


def test_block_properties(spark):
    i = Inputs(spark, SF)
    s = i.stats.cache()
    assert s.filter("NOT (min <= q25 AND q25 <= median AND median <= q75 AND q75 <= max)").count() == 0
    inside = blocks.with_cell(i.used, SMALL)
    assert s.agg(F.sum("sum_weight")).first()[0] == inside.agg(F.sum("weight")).first()[0]
    assert s.groupBy("cx", "cy").count().filter("count > 1").count() == 0


def test_partition_invariance(spark):
    i = Inputs(spark, SF)
    want = None
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in (1, 4, 32):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = sorted(map(tuple, blocks.augmented(i.stats, i.metadata).collect()))
        want = want or got
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_empty_points(spark):
    p = spark.createDataFrame([], "x long, y long, z long, rid long, weight int")
    assert blocks.cell_stats(p, SMALL).count() == 0 and tiling.rids_by_tile(tiling.with_tile(p, SMALL)).count() == 0
    assert gridding.nearest_neighbour(p, SMALL).count() == 0


@pytest.mark.parametrize("b, size", [(1, 5), (3, 37), (4, 61), (5, 89), (20, 1305)])
def test_footprints(b, size):
    assert sum(2 * w + 1 for w in morphology.disc(b).values()) == size


def test_smooth_radii():
    assert morphology.smooth_radii(3, 0.2) == (3, 5)


def dense(df, n, value=None):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r.cy, r.cx] = 1 if value is None else r[value]
    return out


def test_morphology_by_brute_force(spark):
    n, fp = 17, morphology.disc(2)
    m = np.random.default_rng(5).random((n, n)) < 0.2
    cells = spark.createDataFrame([(int(x), int(y)) for y, x in zip(*np.nonzero(m))], "cx int, cy int")
    steps = [(dx, dy) for dy, w in fp.items() for dx in range(-w, w + 1)]
    grown = np.zeros((n, n), bool)
    shrunk = {0: np.ones((n, n), bool), 1: np.ones((n, n), bool)}
    for y, x in itertools.product(range(n), range(n)):
        for dx, dy in steps:
            inside = 0 <= x + dx < n and 0 <= y + dy < n
            grown[y, x] |= inside and m[y + dy, x + dx]
            for border in (0, 1):
                shrunk[border][y, x] &= bool(m[y + dy, x + dx]) if inside else bool(border)
    assert (dense(morphology.dilate(cells, fp, n), n) == grown).all()
    big = spark.createDataFrame([(int(x), int(y)) for y, x in zip(*np.nonzero(grown))], "cx int, cy int")
    assert morphology.complement(cells, n).count() == n * n - m.sum()
    for border in (0, 1):
        assert (dense(morphology.erode(cells, fp, n, border), n) == shrunk[border]).all()
    again = morphology.erode(big, fp, n, 1)
    assert cells.join(again, ["cx", "cy"], "left_anti").count() == 0  # a closing holds its set


def test_distance_by_brute_force(spark):
    h, w = 37, 40
    m = np.random.default_rng(1).random((h, w)) < 0.9
    df = spark.createDataFrame([(x, y, int(m[y, x])) for y in range(h) for x in range(w)], "cx int, cy int, m int")
    zero = np.argwhere(~m)
    for r in morphology.distance(df).collect():
        assert r.d2 == ((zero - [r.cy, r.cx]) ** 2).sum(1).min()
    full = morphology.distance(df.withColumn("m", F.lit(1)))
    assert full.filter("d2 IS NOT NULL").count() == 0


def test_blend_lies_between(spark):
    i = Inputs(spark, SF)
    a = i.cells.withColumn("v", F.lit(-100))
    b = i.cells.withColumn("v", F.lit(-300))
    out = product.blend(i.mask, a, b, 3, N)
    assert out.filter("v IS NULL OR v < -300.000001 OR v > -99.999999").count() == 0


def test_surface_honours_data():
    data = np.full((24, 24), np.nan)
    y, x = np.mgrid[0:24:5, 0:24:5]
    data[y, x] = 3.0 * x - 2.0 * y
    z = gridding.solve(data, 0.0, 0.001, 5000)
    assert np.abs(z[y, x] - data[y, x]).max() < 1e-9
    yy, xx = np.mgrid[0:24, 0:24]
    assert np.abs(z - (3.0 * xx - 2.0 * yy)).max() < 0.05  # a plane has no curvature


def surfaces(spark, n, points, *sizes, **how):
    cells = spark.createDataFrame([(x, y, v) for (x, y), v in {(x, y): v for x, y, v in points}.items()], "cx int, cy int, v double")
    for size in sizes:
        got = gridding.surface(cells, n, **size, **how).toPandas().set_index(["cx", "cy"])["v"]
        assert len(got) == n * n and got.index.is_unique
        yield got


def test_surface_does_not_depend_on_blocks(spark):
    rng = np.random.default_rng(1)
    points = [(int(x), int(y), float(rng.normal() * 20)) for x, y in rng.integers(0, 20, (60, 2))]  # all in one corner
    whole, cut = surfaces(spark, 64, points, {"block": 64}, {"block": 16, "halo": 4}, convergence=1e-4)
    assert (whole - cut).abs().max() < 1e-3


def test_surface_in_blocks(spark):
    n = 200
    points = [(int(x), int(y), float(50 * math.sin(x / 30) + y / 2)) for x, y in np.random.default_rng(3).integers(0, [100, n], (300, 2))]
    whole, cut, swept = surfaces(spark, n, points, {"block": n}, {"block": 64, "coarse": 50, "sweeps": 0}, {"block": 64, "coarse": 50, "sweeps": 6}, data_limits=True)
    off = [(x - whole).abs().max() for x in (cut, swept)]  # the values span more than 100
    assert off[0] < 1.5 and off[1] < 0.5 * off[0]


def test_gap_fill_keeps_the_composite(spark):
    i = Inputs(spark, SF)
    have = i.composite.filter("cx < 40")
    out = product.gap_fill(have, i.background, raster.finite_mask(i.cells, have), N, buffer=3, clean=False)
    assert out.count() == N * N
    j = out.join(have.withColumnRenamed("v", "c"), ["cx", "cy"])
    assert j.filter("v <> c").count() == 0 and out.filter("v IS NULL").count() == 0


def test_polar_forward(spark):
    lon, lat = F.col("lon"), F.col("lat")
    x, y = gridding.polar_forward(lon, lat)
    r = spark.createDataFrame([(0.0, -90.0), (90.0, -65.0), (0.0, -65.0)], "lon double, lat double").select(x.alias("x"), y.alias("y")).collect()
    assert abs(r[0].x) < 1e-6 and abs(r[0].y) < 1e-6
    rho = 6378137.0 * math.cos(math.radians(65)) / math.sqrt(1 - (0.0818191908426215 * math.sin(math.radians(65))) ** 2)
    assert abs(r[1].x - rho) < 1e-3 and abs(r[2].y - rho) < 1e-3


def test_first_bin_is_short(spark):
    p = spark.range(1000).select("id", F.col("id").alias("x"), F.col("id").alias("y"))
    seq = compare.sequenced(p, "id")
    assert seq.filter("seq <> id").count() == 0
    n = [r.n for r in compare.binned(seq, 100).orderBy("bin").collect()]
    assert n == [99, *[100] * 9, 1]


def test_first_position_key_is_whole(spark):
    p = spark.createDataFrame([(1, 23, 1), (12, 3, 2)], "x long, y long, k int")
    assert raster.first_per_position(p, ["k"]).count() == 2


def test_unknown_weight_is_zero(spark):
    t = spark.createDataFrame([(1, 1, "5"), (2, 1, "")], "tile_id int, basic_tile int, cruises string")
    m = spark.createDataFrame([(9, 5)], "dataset_rid long, weight int")
    assert {(r.tile_id, r.sum_weight, r.avg_weight) for r in tiling.weights_by_tile(t, m).collect()} == {(1, 0, 0.0), (2, 0, 0.0)}


def test_scan_of_mixed_separators(spark):
    df = spark.createDataFrame([("f", v) for v in ("1,2;-3", "1\t2 3", "1.5+2 -3", "1 2 3 4", "1 x 3", "1 2", "", " ", "1,,3")] + [("f", None)], "file string, value string")
    points, skipped = files.scan_points(df)
    assert sorted(tuple(r)[1:] for r in points.collect() if r.y is not None and r.z is not None) == [(1.0, 2.0, -3.0), (1.0, 2.0, 3.0), (1.5, 2.0, -3.0)]
    assert points.filter("y IS NULL OR z IS NULL").count() == 2 and {r.value for r in skipped.collect()} == {"1 2 3 4", "1 x 3"}
    assert files.scan_points(df.limit(0))[0].count() == 0


def test_reject_files(spark, tmp_path):
    df = spark.createDataFrame([(1.6, 2.4, None, 7, None, None, "null"), (1.0, 2.0, -10000.0, 7, 3, 1, "depth"), (9e9, 2.0, -1.0, 7, None, None, "outside")], "x double, y double, z double, rid long, tile_id int, basic_tile int, reason string")
    files.write_rejects(df, str(tmp_path / "r"))
    got = {(r.reason, r.value) for r in spark.read.text(str(tmp_path / "r")).collect()}
    assert got == {("null", "2 2  7"), ("depth", "1 2 -10000 7 3 1"), ("outside", "9000000000 2 -1 7")}


def test_list_files(spark, tmp_path):
    for name in ("100_a.xyz", "100_b.xyz", "200_a.xyz", "notes.md"):
        (tmp_path / name).write_text("x")
    got = files.list_files(spark, str(tmp_path), "*.xyz")
    assert sorted((r.prefix, r.bytes) for r in got.collect()) == [("100", 1), ("100", 1), ("200", 1)]
    assert files.list_files(spark, str(tmp_path / "none")).count() == 0


def test_sniffed_separators(spark, tmp_path):
    for k, sep in enumerate(",\t "):
        (tmp_path / f"{k}.csv").write_text(sep.join("ab") + "\n" + sep.join(["1", '"x"']) + "\n")
        assert [tuple(r) for r in files.sniffed(spark, str(tmp_path / f"{k}.csv"), "a int, b string").collect()] == [(1, '"x"')]


def test_skewed_tiles_are_written_whole(spark, tmp_path):
    p = spark.range(20000).selectExpr("id AS x", "CAST(IF(id % 50 = 0, id % 7, 3) AS INT) AS basic_tile")
    files.write_tiles(p, str(tmp_path / "t"))
    assert files.read_tiles(spark, str(tmp_path / "t")).count() == 20000
    assert files.read_tiles(spark, str(tmp_path / "t"), 3).count() == p.filter("basic_tile = 3").count()


def test_dense(spark):
    r = spark.createDataFrame([(0, 0, 1.9), (1, 2, None), (2, 1, -3.2)], "cx int, cy int, v double")
    assert files.dense(r, 3).tolist() == [[1, -32768, -32768], [-32768, -32768, -3], [-32768, -32768, -32768]]


def test_steering_rounds_to_even(spark):
    table = spark.createDataFrame([(300, "rock", 41), (301, "rock", 9)], "dataset_rid long, dataset_name string, dataset_tid int")
    df = spark.createDataFrame([("a/rock.xyz", "0.5,1.5\t2.5"), ("a/rock.xyz", "-0.5 -1.5  x"), ("a/other.xyz", "1 2 3"), ("a/rock.xyz", None)], "file string, value string")
    assert [tuple(r) for r in blocks.steering(df, table).collect()] == [(0, 2, 2, 300, 41)]


def test_no_shared_folder_on_a_cluster(spark, monkeypatch):
    class Session:
        conf = type("", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        files.scratch(Session)


def test_ingest_matches_each_pattern_once(spark):
    for f in (ingest.soundings, ingest.rejects):
        plan = f(lines(spark, "1 2 3"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace") <= 6 and plan.count("regexp_extract") <= 3


def test_newest(spark):
    runs = spark.createDataFrame([(str(k), k) for k in range(12)], "name string, created int")
    assert catalog.newest(runs, 10).filter("keep").count() == 10


@pytest.mark.parametrize("slots", [5, 1 << 20])
def test_nearest_neighbour_sorts_no_candidates(spark, slots):
    """Points are cut down to the nearest before they are sorted, with ties, gaps and cells that share a slot as by brute force."""
    grid, r = Grid(low=-2000, high=2000), np.random.default_rng(7)
    given = [(int(x), int(y), None if k % 50 == 0 else int(z)) for k, (x, y, z) in enumerate(zip(r.integers(-60, 61, 900) * 50, r.integers(-60, 61, 900) * 50, r.integers(-9, 9, 900)))]
    given += [(None, 0, 1), (0, None, 1), (10**9, 0, 1)]
    got = gridding.nearest_neighbour(spark.createDataFrame(given, "x long, y long, z long").repartition(2), grid, slots=slots)
    best = {}
    for x, y, z in given:
        for cx, cy in itertools.product(range(8), repeat=2):
            if x is not None and y is not None and (d2 := (x + 1750 - 500 * cx) ** 2 + (y + 1750 - 500 * cy) ** 2) <= 1e6:
                key = cx, cy, x >= 500 * cx - 1750, y >= 500 * cy - 1750
                best[key] = min(best.get(key, (1e9,)), (d2, z is not None, z or 0))
    want = {}
    for (cx, cy, *_), (d2, there, z) in best.items():
        n, s, t = want.get((cx, cy), (0, 0, 0))
        w = 1 / (1 + 9 * d2 / 1e6)
        want[cx, cy] = n + 1, s + there * w * z, t + w
    want = {c: s / t for c, (n, s, t) in want.items() if n == 4}
    assert {(v.cx, v.cy): round(v.v, 9) for v in got.collect()} == {c: round(v, 9) for c, v in want.items()} and len(want) > 50
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()


def test_tile_filters_are_short(spark):
    """What is pushed down to the scan holds no tile number; edges, gaps and nulls as before."""
    at = [None, -24001, -24000, -23999, -16000, -15999, 0, 23999, 24000, 24001]
    p = spark.createDataFrame([(x, y, z) for x in at for y in at for z in (None, -9999, -9998)], "x long, y long, z long")
    for f in (tiling.tiled, tiling.tile_rejects):
        plan = f(p.selectExpr("x + 1 AS x", "y", "z"), SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert not [r for r in plan.splitlines() if "Filter" in r and "CEIL" in r]
    tile = {x: None if x is None or not -24000 <= x <= 24000 else max(0, -((-24000 - x) // 8000) - 1) for x in at}
    want = [(x, y, z, 1 + tile[x] + 6 * tile[y]) for x in at for y in at for z in (None, -9999, -9998) if tile[x] is not None and tile[y] is not None and z == -9998]
    got = [(r.x, r.y, r.z, r.tile_id) for r in tiling.tiled(p, SMALL).collect()]
    assert set(got) == set(want) and len(got) == len(want)
    assert tiling.tile_rejects(p, SMALL).count() == 300 - len(want)
