"""Shuffles that follow the size of the input."""

import pytest
from pyspark.sql import functions as F

from strideflow import session
from strideflow.operators import frames as fr
from strideflow.operators import vmax_state as vs
from strideflow.params import PROD
from strideflow.plans import fixture

from conftest import frames_df, player_rows


@pytest.fixture
def plans(spark):
    """Physical plans as they are planned."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def _lines(spark, path, n=400, suppliers=3):
    """Lineitems in many order ranges; some quantities and orders are null."""
    i = F.col("id")
    rows = spark.range(n * suppliers).select(
        F.when(i % 191 != 5, F.floor(i / 2)).alias("l_orderkey"), (i * 7 % 90).alias("l_partkey"), (F.floor(i / 4) % suppliers).alias("l_suppkey"),
        (i % 2).cast("int").alias("l_linenumber"), F.when(i % 11 > 3, (i * 13 % 50).cast("double")).alias("l_quantity"), (i * 3.0).alias("l_extendedprice"),
    )
    rows.coalesce(1).write.parquet(f"{path}/lineitem.parquet")
    spark.range(suppliers).select(F.col("id").alias("s_suppkey"), (F.col("id") * 3).alias("s_nationkey")).coalesce(1).write.parquet(f"{path}/supplier.parquet")
    return str(path)


def test_partitions_follow_the_size_of_the_input(spark, tmp_path, monkeypatch, plans):
    """However large the input, a task sorts about as many frames."""
    frames_df(spark, [r for k in range(20) for r in player_rows(f"p{k}", [float(k + i % 7) for i in range(60)])]).coalesce(1).write.parquet(str(tmp_path / "f"))
    frames = spark.read.parquet(str(tmp_path / "f"))
    small = fr.compute_speed(frames, PROD)
    size = session.input_bytes(frames)
    assert size == sum(p.stat().st_size for p in (tmp_path / "f").glob("*.parquet"))
    monkeypatch.setattr(session, "FILE_BYTES", size // 30)
    large = fr.compute_speed(frames, PROD)
    assert large.rdd.getNumPartitions() == -(-size // (size // 30)) >= 30
    assert plans(large).count("Exchange hashpartitioning") == 1
    assert sorted(map(str, large.collect())) == sorted(map(str, small.collect()))


def test_fixture_shuffles_the_lineitems_once(spark, tmp_path, plans):
    plan = plans(fixture.tracking(spark, _lines(spark, tmp_path)))
    rows = [ln for ln in plan.split("Exchange hashpartitioning")[1:]]
    # the lineitems, once a branch of the plan (reused when it runs); else totals of ranges
    assert all("g#" not in ln.split("]")[0].split("\n")[0] for ln in rows)
    assert plan.count("REPARTITION_BY_COL") == 2


def test_positions_do_not_depend_on_the_ranges(spark, tmp_path, monkeypatch):
    path = _lines(spark, tmp_path, n=1900)
    one = sorted(map(str, fixture.tracking(spark, path).collect()))
    monkeypatch.setattr(fixture, "ORDER_RANGE", 16)
    assert sorted(map(str, fixture.tracking(spark, path).collect())) == one


def test_store_sums_its_histogram_from_its_values(spark):
    """A batch counts its speeds once."""
    rows = [r for k in range(6) for r in player_rows(f"p{k % 3}", [0.3, *[15.0 + (i * k) % 9 for i in range(50)]], game_id=f"g{k}")]
    speeds = fr.compute_speed(frames_df(spark, rows), PROD)
    one = sorted(map(tuple, vs.histogram(speeds).collect()))
    assert one and sorted(map(tuple, vs.histogram_of(vs.values(speeds)).collect())) == one
