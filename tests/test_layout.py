"""Curve layout and box reads, tables that are built once, years in folders."""

import datetime as dt
import random
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from pitgauge.session import scratch_path
from pitgauge.sources import layout as L
from pitgauge.sources import publish as P
from pitgauge.sources import readers as RD
from pitgauge.sources import writers as WR


def _interleaved(cell, bits):
    return sum(((cell[0] >> i & 1) << 2 * i) | ((cell[1] >> i & 1) << 2 * i + 1) for i in range(bits))


def test_keys_interleave_cells_and_clip_what_lies_outside(spark):
    curve = L.Curve(-2.0, 10.0, 6.0, 11.0, bits=7, tile_bits=2)
    rng = random.Random(1)
    pts = [(rng.uniform(-3, 7), rng.uniform(9.5, 11.5)) for _ in range(300)] + [(-2.0, 10.0), (6.0, 11.0), (float("inf"), 10.5), (1.0, -1e300)]
    got = spark.createDataFrame(pts, "x double, y double").select("x", "y", curve.key(F.col("x"), F.col("y")).alias("k")).collect()
    assert all(r.k == _interleaved(curve.cell(r.x, r.y), 7) for r in got)
    none = spark.createDataFrame([(None, 1.0), (1.0, None)], "x double, y double").select(curve.key(F.col("x"), F.col("y")).alias("k")).collect()
    assert [r.k for r in none] == [None, None]


@pytest.mark.parametrize("most", [4, 16, 64])
def test_ranges_hold_every_cell_of_the_box(most):
    curve, rng = L.Curve(0.0, 0.0, 32.0, 32.0, bits=5, tile_bits=2), random.Random(most)
    for _ in range(60):
        (a, c), (b, d) = sorted(rng.choices(range(32), k=2)), sorted(rng.choices(range(32), k=2))
        spans = curve.ranges(a, b, c, d, most)
        assert len(spans) <= most and all(x <= y for x, y in spans) and all(p[1] + 1 < q[0] for p, q in zip(spans, spans[1:]))
        keys = {_interleaved((x, y), 5) for x in range(a, c + 1) for y in range(b, d + 1)}
        assert all(any(x <= k <= y for x, y in spans) for k in keys)
        assert sum(y - x + 1 for x, y in curve.ranges(a, b, c, d, most=10_000)) == len(keys)
    assert curve.ranges(3, 0, 2, 9) == [] and curve.ranges(-9.0, -9.0, 99.0, 99.0) == [(0, 1023)]


def _scan(df):
    """Files opened by the scan of a plan without exchanges, once it has run."""
    plan = df._jdf.queryExecution()
    plan.toRdd().count()
    return plan.executedPlan().collectLeaves().head().metrics().apply("numFiles").value()


def test_a_box_read_opens_few_files_and_returns_its_rows(spark):
    cells = spark.range(64 * 64).select((F.col("id") % 64).cast("double").alias("x"), F.floor(F.col("id") / 64).cast("double").alias("y"), F.col("id").alias("v"))
    cells = cells.unionByName(spark.createDataFrame([(None, 3.0, -1), (3.0, None, -2), (float("nan"), 3.0, -3), (3.0, 3.0, -4)], "x double, y double, v long"))
    path = scratch_path(spark, "curve")
    L.write_curve(cells, path, "x", "y", L.curve_of(cells, "x", "y", bits=6, tile_bits=3))
    box = L.read_box(spark, path, 3.0, 2.0, 9.0, 5.0)
    want = cells.where("x between 3 and 9 and y between 2 and 5")
    assert box.columns == ["x", "y", "v"] and sorted(r.v for r in box.collect()) == sorted(r.v for r in want.collect())
    text = box._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(_curve," in text.split("PushedFilters")[1] and "_tile" in text.split("PartitionFilters")[1].split("PushedFilters")[0]
    opened, whole = _scan(box), _scan(spark.read.parquet(path))
    assert opened * 8 <= whole
    assert spark.read.parquet(path).count() == cells.count()
    assert L.read_box(spark, path, 9.0, 2.0, 3.0, 5.0).count() == 0


def test_tables_of_one_point_and_of_none(spark):
    one = spark.createDataFrame([(5.0, 5.0, i) for i in range(20)], "x double, y double, v int")
    path = scratch_path(spark, "curve")
    L.write_curve(one, path, "x", "y", L.curve_of(one, "x", "y"))
    assert L.read_box(spark, path, 5.0, 5.0, 5.0, 5.0).count() == 20 and L.read_box(spark, path, 6.0, 5.0, 7.0, 5.0).count() == 0
    assert L.curve_of(one.limit(0), "x", "y") == L.Curve(0.0, 0.0, 1.0, 1.0)
    with pytest.raises(ValueError, match="bits"):
        L.Curve(0, 0, 1, 1, bits=40)


def test_builders_at_once_leave_one_whole_table(spark):
    path, both, built = scratch_path(spark, "built"), threading.Barrier(3), []

    def build():
        both.wait(60)  # every builder has seen that there is no table yet
        built.append(1)
        return spark.range(1000)

    with ThreadPoolExecutor(3) as pool:
        got = list(pool.map(lambda _: RD.read_or_build(spark, path, build).count(), range(3)))
    assert got == [1000] * 3 and len(built) == 3
    fs = P._open(spark, path)[1]
    names = [s.getPath().getName() for s in fs.listStatus(P._path(spark, path))]
    assert len(names) == 1 and not names[0].startswith(".")
    assert not any(s.getPath().getName().startswith(".building") for s in fs.listStatus(P._path(spark, f"{path}/{names[0]}")))


def test_a_changed_plan_or_input_builds_again(spark):
    path, source = scratch_path(spark, "built"), scratch_path(spark, "source")
    built = []

    def read(plan):
        return RD.read_or_build(spark, path, lambda: built.append(plan) or spark.read.parquet(source), plan, [source]).count()

    spark.range(5).write.parquet(source)
    assert [read("a"), read("a"), read("b"), read("a")] == [5] * 4 and built == ["a", "b"]
    spark.range(2).write.mode("append").parquet(source)
    assert read("a") == 7 and built == ["a", "b", "a"]


def test_a_failed_build_leaves_nothing(spark):
    path = scratch_path(spark, "built")

    def fail(aside):
        spark.range(3).write.parquet(aside)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        P.publish(spark, f"{path}/x", fail)
    assert not P.exists(spark, f"{path}/x") and P.publish(spark, f"{path}/x", lambda a: spark.range(3).write.parquet(a))
    assert not P.publish(spark, f"{path}/x", fail) and spark.read.parquet(f"{path}/x").count() == 3


def test_years_of_a_grid_are_folders_that_a_cell_read_skips(spark):
    rows = [(dt.date(y, 6, 1), 11.5 + c, 79.5, float(y + c)) for y in range(1990, 2010) if y != 2001 for c in (0, 1)]
    path = scratch_path(spark, "grid")
    WR.write_grid(spark.createDataFrame(rows, "day date, lat double, lon double, value double"), path)
    cell = RD.grid_cell(RD.read_grid(spark, path), 11.5, 79.5, 2000, 2003)
    assert sorted(r.value for r in cell.collect()) == [2000.0, 2002.0, 2003.0]
    assert _scan(cell) == 3
