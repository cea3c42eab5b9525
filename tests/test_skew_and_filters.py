"""A hot (player, game) is spread over many tasks; dashboard filters with
non-default sidebar state; per-game v-max does not multiply rows."""

from pyspark.sql import functions as F

from strideflow.operators import frames as fr
from strideflow.operators import runs as ru
from strideflow.operators import tables as tb
from strideflow.params import LIB, PROD, FilterSpec
from strideflow.plans import explore as ex
from strideflow.plans.model import EffortModel

from conftest import frames_df, player_rows

SF = "/root/testdata/sf0.001"


def test_hot_key_is_split_across_tasks(spark):
    rows = player_rows("hot", ([30.0] * 60 + [5.0] * 20) * 250)  # 20,000 frames of one player-game
    df = frames_df(spark, rows)
    p = LIB.with_(chunk_frames=1000, threshold_pct=0.75)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sp = fr.compute_speed(df, p)
        parts = sp.select(F.spark_partition_id().alias("pid")).distinct().count()
        assert parts >= 4  # 20 chunks hashed over 8 shuffle partitions
        # run pieces of the one hot player-game stay spread by chunk as well
        pieces = ru.effort_run_pieces(fr.tag_effort_frames(sp, fr.compute_vmax(sp, p)), p)
        assert pieces.select(F.spark_partition_id()).distinct().count() >= 4
        assert pieces.count() > 250  # runs cut at chunk edges are several pieces
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    runs = ru.extract_effort_runs(fr.tag_effort_frames(sp, fr.compute_vmax(sp, p)), p)
    ref = ru.extract_effort_runs(fr.tag_effort_frames(sp, fr.compute_vmax(sp, p)), p.with_(chunk_frames=1 << 20))
    assert runs.count() == 250 and runs.exceptAll(ref).count() == 0
    assert sorted(r.run_id for r in runs.collect()) == list(range(1, 251))


def test_filters_teams_game_and_fallback(spark):
    m = EffortModel(spark, SF, PROD, materialized=True)
    teams = [r.team_short for r in ex.team_options(m.app_summary).collect()]
    one = FilterSpec(teams=(teams[0],))
    q = ex.qualifying_runs(m.app_runs, one)
    fb = ex.pitch_runs_fallback(q, one)
    assert fb.filter(F.col("team_short") != teams[0]).count() == 0
    # a filter that keeps nothing falls back to every qualifying run
    none = FilterSpec(teams=("nope",))
    assert ex.pitch_runs_fallback(q, none).count() == q.count()
    games = [r.game_id for r in m.app_runs.select("game_id").distinct().collect()]
    g = FilterSpec(game_id=games[0])
    assert ex.qualifying_runs(m.app_runs, g).filter(F.col("game_id") != games[0]).count() == 0
    fs = ex.filtered_summary(ex.summary_dynamic(m.app_summary, ex.dynamic_counts(ex.qualifying_runs(m.app_runs, one)), one), one)
    assert fs.filter(F.col("team_short") != teams[0]).count() == 0


def test_per_game_vmax_collapses_before_player_joins(spark):
    rows = player_rows("p", [25.0] * 300 + [5.0] * 5 + [24.0] * 40, game_id="g1") + player_rows(
        "p", [22.0] * 300 + [5.0] * 5 + [21.0] * 40, game_id="g2"
    )
    p = LIB.with_(vmax_per_game=True)
    sp = fr.compute_speed(frames_df(spark, rows), p)
    vmax = fr.compute_vmax(sp, p)
    assert vmax.count() == 2
    runs = ru.extract_effort_runs(fr.tag_effort_frames(sp, vmax), p)
    summary = tb.summarise_players_lib(runs, vmax)
    assert summary.count() == 1 and summary.first().runs == runs.count()


def test_vmax_hot_bucket_is_split_when_not_broadcast(spark):
    """Second v-max pass as a sort-merge join (bucket table not broadcast):
    AQE splits the hot player's bucket across tasks, results stay exact."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        hot = spark.range(200000).select(
            F.lit("hot").alias("player_id"), (F.lit(30.0) + (F.col("id") % 97) / 1000.0).cast("float").alias("v")
        )
        rest = spark.range(20000).select(
            (F.col("id") % 100).cast("string").alias("player_id"),
            ((F.col("id") * 7919) % 4500 / 100.0).cast("float").alias("v"),
        )
        df = hot.unionByName(rest).repartition(16)
        out = fr.exact_percentiles(df, ["player_id"], "v", {"p999": 0.999, "p995": 0.995}, "n")
        got = {r.player_id: (r.p999, r.p995) for r in out.collect()}
        assert "SortMergeJoin(skew=true)" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    ref = df.groupBy("player_id").agg(
        F.percentile(F.col("v").cast("double"), 0.999).alias("a"), F.percentile(F.col("v").cast("double"), 0.995).alias("b")
    )
    assert got == {r.player_id: (r.a, r.b) for r in ref.collect()}
