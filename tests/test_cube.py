"""The measure cube against the views over runs, and distinct counts that merge."""

import random

import pytest
from pyspark.sql import functions as F

from strideflow.operators import distinct_state as ds
from strideflow.params import SWEEP_THRESHOLDS, FilterSpec
from strideflow.plans import cube as cb
from strideflow.plans import explore as ex

RUN = "player_id string, player_name string, team_name string, team_short string, pos string, game_id string, pct_of_vmax float, distance_m float, duration_sec float, peak_speed_kmh float, start_x float, start_y float"


@pytest.fixture(scope="module")
def runs(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        p = rng.randrange(12)
        team = None if p == 11 else f"T{p % 3}"
        x = rng.choice([None, -60.0, -52.5, -17.5, 17.5, 52.5, rng.uniform(-52, 52)])
        pct = rng.choice([None, 0.6, 0.8, 0.95, rng.uniform(0.5, 1.0)])
        rows.append((f"p{p}", f"P{p}", team, team, [None, "DEF", "MID", "GK", "UNK"][p % 5], f"g{rng.randrange(5)}", pct, rng.uniform(5, 90), rng.uniform(1, 9), rng.uniform(15, 36), x, rng.uniform(-34, 34)))
    return spark.createDataFrame(rows, RUN)


def lines(df):
    cols = [F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return sorted(str(tuple(r)) for r in df.select(*sorted(cols, key=str)).collect())


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns) and lines(a) == lines(b)


@pytest.mark.parametrize("spec", [FilterSpec(), FilterSpec(threshold_pct=0.6, teams=("T1",)), FilterSpec(threshold_pct=0.95, teams=("nobody",)), FilterSpec(threshold_pct=0.7, positions=("DEF",), game_id="g3")], ids=str)
def test_views_from_the_cube_equal_those_from_runs(spark, runs, spec):
    cube = cb.build(runs)
    q = ex.qualifying_runs(runs, spec)
    views = cb.CubeViews(cube, None, spec)
    same(views.dynamic_counts(), ex.dynamic_counts(q))
    same(views.zone9_heatmap(), ex.zone9_heatmap(ex.pitch_runs_fallback(q, spec)))
    same(views.pitch_thirds(), ex.pitch_thirds(runs))
    if spec.game_id is None:
        same(views.zone30_player(), ex.zone30_player(q))
        mr = ex.match_runs(runs, spec)
        same(views.match_top_performers(), ex.match_top_performers(mr))
        same(views.match_team_comparison(), ex.match_team_comparison(mr))
        same(views.match_position(), ex.match_position(mr))
        same(views.match_zone9(), ex.match_zone9(mr))


def test_every_slider_step_and_no_other(spark, runs):
    cube = cb.build(runs)
    for t in SWEEP_THRESHOLDS:
        spec = FilterSpec(threshold_pct=t)
        same(ex.dynamic_counts(cb.cells(cube, "player", spec), cb.CELLS), ex.dynamic_counts(ex.qualifying_runs(runs, spec)))
    with pytest.raises(ValueError, match="no step"):
        cb.cells(cube, "player", FilterSpec(threshold_pct=0.81))
    with pytest.raises(ValueError, match="all games"):
        cb.cells(cube, "zone30", FilterSpec(game_id="g1"))
    assert cb.build(runs.limit(0)).count() == 0


def test_views_read_the_cube_only(spark, runs, tmp_path):
    cb.build(runs).write.parquet(str(tmp_path / "cube"))
    stored = spark.read.parquet(str(tmp_path / "cube"))
    views = cb.CubeViews(stored, None)
    for view in ("dynamic_counts", "zone30_player", "zone9_heatmap", "pitch_thirds", "match_top_performers", "match_zone9"):
        out = getattr(views, view)()
        assert "distance_m" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert all("/cube/" in f for f in out.inputFiles())
    build = cb.build(runs)._jdf.queryExecution().executedPlan().toString()
    assert build.count("Exchange hashpartitioning") == 1  # all grains in one aggregation


def test_distinct_counts_merge_over_batches(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"p{rng.randrange(40)}", None if i % 50 == 0 else f"g{rng.randrange(300)}") for i in range(1500)]
    df = spark.createDataFrame(rows, "player_id string, game_id string")
    batches = [spark.createDataFrame(rows[i : i + 500], df.schema) for i in (0, 500, 1000)]
    kept = []

    def stage(part, name):
        path = str(tmp_path / f"{len(kept)}-{name}")
        part.write.parquet(path)
        kept.append(spark.read.parquet(path))
        return kept[-1]

    got = ds.counts_by_batches(batches, "player_id", "game_id", "games", stage)
    want = df.groupBy("player_id").agg(F.count_distinct("game_id").alias("games"))
    assert lines(got) == lines(want)
    assert all(str(tmp_path) in f for f in got.inputFiles())  # no batch is read again
    numbers = kept[-2]
    assert numbers.count() == numbers.select("number").distinct().count() == df.select("game_id").dropna().distinct().count()
    first = kept[0].join(numbers.withColumnRenamed("number", "later"), "game_id")
    assert first.filter("number <> later").isEmpty()
