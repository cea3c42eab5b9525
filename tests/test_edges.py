"""Edge pins: period split, chunk boundaries, duplicates, nulls, zones,
exact percentile, zero denominators."""

import pytest
from pyspark.sql import functions as F

from strideflow.functions import zones
from strideflow.functions.positions import position_group
from strideflow.operators import frames as fr
from strideflow.operators import runs as ru
from strideflow.params import LIB, PROD

from conftest import frames_df, player_rows

P = LIB.with_(threshold_pct=0.75)


def test_run_across_period_change_splits_with_shared_run_id(spark):
    rows = player_rows("p", [20.0] * 300 + [5.0] * 10 + [19.0] * 80)
    # consecutive frame ids, period changes in the middle of the fast block
    rows = [r[:2] + ((1 if r[1] < 350 else 2),) + r[3:] for r in rows]
    sp = fr.compute_speed(frames_df(spark, rows), P)
    runs = ru.extract_effort_runs(fr.tag_effort_frames(sp, fr.compute_vmax(sp, P)), P)
    late = runs.filter(F.col("start_frame_id") >= 300).collect()
    assert sorted(r.period_id for r in late) == [1, 2]
    assert len({r.run_id for r in late}) == 1


def test_absolute_counts_do_not_split_on_period(spark):
    rows = player_rows("p", [5.0] * 5 + [25.0] * 40 + [5.0] * 5)
    rows = [r[:2] + ((1 if r[1] < 25 else 2),) + r[3:] for r in rows]
    sp = fr.compute_speed(frames_df(spark, rows), PROD)
    assert ru.extract_absolute_runs(sp, PROD).count() == 0  # 19 + 21 frames after the split
    assert ru.absolute_run_counts(sp, PROD).first().runs_absolute == 1


@pytest.mark.parametrize("chunk", [3, 7, 64])
def test_chunked_windows_equal_unchunked(spark, chunk):
    rows = []
    for g in range(2):
        rows += player_rows("a", ([30.0] * 40 + [5.0] * 13) * 4, game_id=f"g{g}", start_frame=g * 5)
        rows += player_rows("b", ([21.0] * 27 + [9.0] * 6) * 5, game_id=f"g{g}")
    rows = [r for r in rows if r[1] not in (17, 90)]  # gaps
    df = frames_df(spark, rows)
    big, small = P.with_(chunk_frames=1 << 20), P.with_(chunk_frames=chunk)
    s1, s2 = fr.compute_speed(df, big), fr.compute_speed(df, small)
    assert s1.exceptAll(s2).count() == 0 and s2.exceptAll(s1).count() == 0
    r1 = ru.extract_effort_runs(fr.tag_effort_frames(s1, fr.compute_vmax(s1, big)), big)
    r2 = ru.extract_effort_runs(fr.tag_effort_frames(s2, fr.compute_vmax(s2, small)), small)
    assert r1.count() > 0
    assert r1.exceptAll(r2).count() == 0 and r2.exceptAll(r1).count() == 0
    a1 = ru.absolute_run_counts(s1, big).collect()
    a2 = ru.absolute_run_counts(s2, small).collect()
    assert sorted(a1) == sorted(a2)


def test_duplicate_frame_ids_get_null_second_speed(spark):
    rows = player_rows("p", [20.0] * 5)
    rows.insert(3, rows[2][:8] + (rows[2][8] + 0.1,) + rows[2][9:])
    s = fr.compute_speed(frames_df(spark, rows), P).orderBy("frame_id", "x").collect()
    at2 = [r.speed_kmh for r in s if r.frame_id == 2]
    assert sum(v is None for v in at2) == 1


def test_null_x_breaks_speed(spark):
    rows = player_rows("p", [20.0] * 5)
    rows[2] = rows[2][:8] + (None,) + rows[2][9:]
    s = {r.frame_id: r.speed_kmh for r in fr.compute_speed(frames_df(spark, rows), P).collect()}
    assert s[3] is None and s[4] is not None


def test_exact_percentile_matches_spark_percentile(spark):
    import random

    rnd = random.Random(7)
    data = [(f"p{i % 5}", rnd.choice([0.0, rnd.uniform(0, 45), rnd.uniform(0, 1e-3), 32.0])) for i in range(3000)]
    df = spark.createDataFrame(data, "player_id string, v float")
    for p in (0.0, 0.5, 0.995, 0.999, 1.0):
        ours = {r.player_id: r.value for r in fr.exact_percentile(df, ["player_id"], "v", p).collect()}
        ref = {
            r.player_id: r.q
            for r in df.groupBy("player_id").agg(F.percentile(F.col("v").cast("double"), p).alias("q")).collect()
        }
        assert ours.keys() == ref.keys()
        for k in ref:
            assert ours[k] == ref[k]  # bit-identical



def test_exact_percentiles_share_one_pass(spark):
    import random

    rnd = random.Random(11)
    data = [(f"p{i % 4}", f"g{i % 3}", rnd.choice([rnd.uniform(-5, 45), 7.25, -0.0, 1e-30])) for i in range(4000)]
    df = spark.createDataFrame(data, "player_id string, game_id string, v float")
    ps = {"a": 0.0, "b": 0.37, "c": 0.995, "d": 0.999, "e": 1.0}
    ours = fr.exact_percentiles(df, ["player_id", "game_id"], "v", ps, "n").collect()
    ref = (
        df.groupBy("player_id", "game_id")
        .agg(*[F.percentile(F.col("v").cast("double"), p).alias(k) for k, p in ps.items()], F.count("v").alias("n"))
        .collect()
    )
    key = lambda r: (r.player_id, r.game_id)
    ref = {key(r): r for r in ref}
    assert {key(r) for r in ours} == ref.keys()
    for r in ours:
        assert r.n == ref[key(r)].n
        for k in ps:
            assert r[k] == ref[key(r)][k]  # bit-identical

def test_zone_borders(spark):
    xs = [-60.0, -52.5, -35.0, -17.5, -17.4, 0.0, 17.5, 17.6, 52.5, 60.0, None]
    df = spark.createDataFrame([(x,) for x in xs], "start_x double")
    out = df.select(
        zones.third_left_closed("start_x").alias("lc"),
        zones.third_right_closed("start_x").alias("rc"),
        zones.zone9_col("start_x").alias("z9"),
        zones.zone30_col("start_x").alias("z30"),
    ).collect()
    lc = [r.lc for r in out]
    assert lc[3] == "Middle third" and lc[2] == "Defensive third" and lc[6] == "Attacking third" and lc[-1] == "Attacking third"
    rc = [r.rc for r in out]
    assert rc[0] is None and rc[3] == "Defensive third" and rc[6] == "Middle third" and rc[9] is None and rc[-1] is None
    assert [r.z9 for r in out] == [0, 0, 0, 0, 1, 1, 1, 2, 2, 2, 2]
    assert [r.z30 for r in out] == [0, 0, 0, 1, 2, 2, 3, 4, 5, 5, 5]


def test_zone_rows_y_borders(spark):
    ys = [-40.0, -11.33, -6.8, 6.8, 11.33, 20.4, 34.0, 40.0]
    df = spark.createDataFrame([(y,) for y in ys], "start_y double")
    out = df.select(zones.zone9_row("start_y").alias("r9"), zones.zone30_row("start_y").alias("r30")).collect()
    assert [r.r9 for r in out] == [0, 0, 1, 1, 1, 2, 2, 2]
    assert [r.r30 for r in out] == [0, 1, 1, 2, 3, 3, 4, 4]


def test_position_rollup_unknowns(spark):
    df = spark.createDataFrame([("SW",), ("ST",), ("XX",), (None,), ("UNK",)], "position string")
    assert [r.g for r in df.select(position_group("position").alias("g")).collect()] == ["DEF", "FWD", "UNK", "UNK", "UNK"]


def test_team_outperformance_zero_denominator_is_null(spark):
    from strideflow.plans.gold import team_outperformance

    df = spark.createDataFrame(
        [("T", "T", 3, 0, 3, "gained")], "team_name string, team_short string, runs_relative long, runs_absolute long, delta long, category string"
    )
    assert team_outperformance(df).first().change_pct is None
