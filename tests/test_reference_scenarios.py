"""The reference's 13 scenarios, as expectations on the Spark operators."""

import pytest
from pyspark.sql import functions as F

from strideflow.operators import frames as fr
from strideflow.operators import runs as ru
from strideflow.params import LIB
from strideflow.plans.pipeline import effort_pipeline
from strideflow.schema import TRACKING

from conftest import frames_df, player_rows


def speeds_of(spark, rows):
    df = fr.compute_speed(frames_df(spark, rows), LIB)
    return [r.speed_kmh for r in df.orderBy("frame_id").collect()]


def test_speed_value(spark):
    rows = [("g", i, 1, i * 40, "alive", "home", "home", "p", x, 0.0, 0.0) for i, x in enumerate([0.0, 0.4, 0.8])]
    s = speeds_of(spark, rows)
    assert s[0] is None
    assert s[1] == pytest.approx(36.0, abs=0.5) and s[2] == pytest.approx(36.0, abs=0.5)


def test_frame_gap_gives_null(spark):
    rows = [("g", f, 1, f * 40, "alive", "home", "home", "p", x, 0.0, 0.0) for f, x in [(0, 0.0), (1, 0.2), (10, 0.4)]]
    s = speeds_of(spark, rows)
    assert s[1] is not None and s[2] is None


def test_speed_clipped_at_45(spark):
    rows = [("g", f, 1, f * 40, "alive", "home", "home", "p", x, 0.0, 0.0) for f, x in [(0, 0.0), (1, 100.0)]]
    assert speeds_of(spark, rows)[1] == 45.0


def test_vmax_is_percentile_not_peak(spark):
    sp = fr.compute_speed(frames_df(spark, player_rows("p", [30.0] * 500 + [90.0])), LIB)
    v = fr.compute_vmax(sp, LIB).first()
    assert v.vmax_kmh < 35.0


def test_sparse_player_low_confidence(spark):
    sp = fr.compute_speed(frames_df(spark, player_rows("p", [25.0] * 50)), LIB)
    assert fr.compute_vmax(sp, LIB).first().low_confidence is True


def test_enough_frames_trusted(spark):
    sp = fr.compute_speed(frames_df(spark, player_rows("p", [25.0] * 300)), LIB)
    assert fr.compute_vmax(sp, LIB).first().low_confidence is False


def _two_players(spark):
    a = [5.0] * 50 + [34.0] * 300 + [5.0] * 50 + [22.0] * 50
    b = [5.0] * 50 + [26.0] * 300 + [5.0] * 50 + [22.0] * 50
    return frames_df(spark, player_rows("player_a", a) + player_rows("player_b", b))


def test_relative_definition_separates_players(spark):
    _, runs, _ = effort_pipeline(_two_players(spark), LIB.with_(threshold_pct=0.75))
    late = runs.filter(F.col("start_frame_id") >= 400)
    assert late.filter(F.col("player_id") == "player_a").count() == 0
    assert late.filter(F.col("player_id") == "player_b").count() >= 1


def test_absolute_definition_treats_players_equally(spark):
    sp = fr.compute_speed(_two_players(spark), LIB)
    runs = ru.extract_absolute_runs(sp, LIB).filter(F.col("start_frame_id") >= 400)
    a = runs.filter(F.col("player_id") == "player_a").count()
    b = runs.filter(F.col("player_id") == "player_b").count()
    assert a == b


def test_effort_below_20_counted_relative_only(spark):
    speeds = [18.0] * 300 + [5.0] * 25 + [14.5] * 35 + [5.0] * 10
    sp = fr.compute_speed(frames_df(spark, player_rows("slow", speeds)), LIB)
    vmax = fr.compute_vmax(sp, LIB)
    thr = vmax.first().vmax_kmh * 0.75
    assert thr < 20.0 and 14.5 >= thr
    rel = ru.extract_effort_runs(fr.tag_effort_frames(sp, vmax), LIB).filter(F.col("start_frame_id") >= 325)
    ab = ru.extract_absolute_runs(sp, LIB).filter(F.col("start_frame_id") >= 325)
    assert rel.count() >= 1 and ab.count() == 0


def test_short_burst_excluded(spark):
    df = frames_df(spark, player_rows("burst", [10.0] * 300 + [30.0] * 20 + [10.0] * 10))
    _, runs, _ = effort_pipeline(df, LIB)
    assert all(r.duration_sec >= 1.0 for r in runs.collect())


def test_sustained_run_included(spark):
    df = frames_df(spark, player_rows("p1", [30.0] * 300 + [5.0] * 25 + [30.0] * 60 + [5.0] * 10))
    _, runs, _ = effort_pipeline(df, LIB.with_(threshold_pct=0.75))
    assert runs.filter(F.col("duration_sec") >= 1.0).count() >= 1


def test_pipeline_outputs(spark):
    rows = player_rows("player_1", [30.0] * 400 + [5.0] * 25 + [28.0] * 50 + [5.0] * 25) + player_rows(
        "player_2", [25.0] * 400 + [5.0] * 25 + [22.0] * 50
    )
    vmax, runs, summary = effort_pipeline(frames_df(spark, rows), LIB)
    assert "vmax_kmh" in vmax.columns and "duration_sec" in runs.columns and "rate" in summary.columns
    assert runs.count() >= 1 and summary.count() >= 1


def test_ball_excluded(spark):
    rows = player_rows("p1", [30.0] * 400 + [28.0] * 50) + player_rows("ball", [40.0] * 450, team_id="ball")
    vmax, runs, summary = effort_pipeline(frames_df(spark, rows), LIB)
    for df in (vmax, runs, summary):
        assert df.filter(F.col("player_id") == "ball").count() == 0
    assert ru.extract_absolute_runs(fr.compute_speed(frames_df(spark, rows), LIB), LIB).filter(
        F.col("player_id") == "ball"
    ).count() == 0


def test_empty_input_keeps_schema(spark):
    empty = spark.createDataFrame([], TRACKING)
    vmax, runs, summary = effort_pipeline(empty, LIB)
    assert runs.count() == 0
    assert runs.columns == ru.RUN_COLUMNS
    assert dict(runs.dtypes)["duration_sec"] == "float"
