"""Plan shape, properties of runs and zones, the batch job, and the SQL
oracle on the smallest shared fixture."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as se
from strideflow.operators import frames as fr
from strideflow.operators import runs as ru
from strideflow.operators import tables as tb
from strideflow.params import PROD, FilterSpec
from strideflow.plans import explore as ex
from strideflow.plans import fixture, registry
from strideflow.plans.model import EffortModel
from strideflow.plans.pipeline import compare_from_frames, run_job
from strideflow.session import ensure_checkpoint_dir
from strideflow.sources import tables as io

SF = "/root/testdata/sf0.001"


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_speed_is_one_shuffle_of_frames(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frames = spark.read.parquet(f"{SF}/lineitem.parquet").select(
            F.lit("g").alias("game_id"), F.col("l_orderkey").alias("frame_id"), F.lit(1).alias("period_id"),
            F.col("l_orderkey").alias("timestamp"), F.col("l_suppkey").cast("string").alias("player_id"),
            F.col("l_quantity").cast("float").alias("x"), F.col("l_discount").cast("float").alias("y"),
        )
        sp = fr.compute_speed(frames, PROD)
        assert _exchanges(sp) == 1
        plan = sp._jdf.queryExecution().executedPlan().toString()
        assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_quantity:double,l_discount:double>" in plan
        assert plan.count("FileScan") == 1  # carry copies come from the same scan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_run_pieces_scan_and_shuffle_frames_once(spark):
    m = EffortModel(spark, SF, PROD, materialized=True)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for pieces in (ru.effort_run_pieces(m.tagged, m.params), ru.absolute_run_pieces(m.speeds, m.params)):
            plan = pieces._jdf.queryExecution().executedPlan().toString()
            speed_scans = [ln for ln in plan.splitlines() if "FileScan" in ln and "speed_kmh" in ln]
            assert len(speed_scans) == 1
            # the window and the piece aggregate share the one frame shuffle
            assert _exchanges(pieces) == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_fixture_keeps_every_lineitem(model):
    spark = model.spark
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    suppliers = spark.read.parquet(f"{SF}/supplier.parquet")
    joined = lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).count()
    assert se.queries()["scan_tracking"](spark, SF).count() == joined


def test_hot_supplier_is_spread_and_equals_the_oracle(spark, tmp_path):
    """One supplier holds a third of all lineitems."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    hot = lines.withColumn("l_suppkey", F.when(F.col("l_orderkey") % 3 == 0, F.lit(2)).otherwise(F.col("l_suppkey")))
    hot = hot.withColumn("l_orderkey", F.col("l_orderkey") * 97)
    hot.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    for t in ("supplier", "nation"):
        spark.read.parquet(f"{SF}/{t}.parquet").coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
    frames = fixture.tracking(spark, str(tmp_path))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        numbered = fixture._ranged_sums(
            hot.select(F.col("l_suppkey").alias("k"), "l_orderkey", "l_linenumber", fixture._idiv(F.col("l_orderkey"), fixture.ORDER_RANGE).alias("range")),
            ["k"], "range", ["l_orderkey", "l_linenumber"], {"rn": F.lit(1)},
        )
        parts = numbered.filter("k = 2").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max("rn").alias("last"))
        sizes = [r.n for r in parts.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    total = sum(sizes)
    assert total >= hot.count() / 3 and len(sizes) > 4 and max(sizes) < total / 2
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    sql = se.oracle_sql()["scan_tracking"]
    cols = ["player_id", "game_id", "frame_id", "x", "y"]
    want = sorted(con.execute(f"SELECT player_id, game_id, frame_id, x, y FROM ({sql})").fetchall())
    got = sorted(tuple(r) for r in frames.select("player_id", "game_id", "frame_id", F.round(F.col("x").cast("double"), 6), F.round(F.col("y").cast("double"), 6)).collect())
    assert len(got) == len(want) and got == want, cols


@pytest.fixture(scope="module")
def model(spark):
    return EffortModel(spark, SF, PROD, materialized=True)


def test_fixture_has_byes_and_untrusted_players(model):
    alone = model.matches.filter("away_team_id is null")
    assert alone.count() == 4 and alone.join(model.tracking, "game_id").count() > 0
    untrusted = model.vmax.filter("low_confidence")
    assert 0 < untrusted.count() < model.vmax.count()


def test_run_properties(model):
    runs = model.runs.collect()
    flagged = model.silver.filter("is_effort_frame").count()
    assert sum(r.end_frame_id - r.start_frame_id + 1 for r in runs) <= flagged
    assert all(r.duration_sec >= 1.0 for r in runs)
    by_key = {}
    for r in runs:
        by_key.setdefault((r.player_id, r.game_id), []).append((r.start_frame_id, r.end_frame_id))
    for spans in by_key.values():
        spans.sort()
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_zone_counts_sum_to_runs(model):
    q = ex.qualifying_runs(model.app_runs)
    z = ex.zone30_player(q).agg(F.sum("n_runs")).first()[0]
    assert z == q.count()
    z9 = ex.zone9_heatmap(q).agg(F.sum("n_runs")).first()[0]
    assert z9 == q.count()


def test_raising_threshold_never_adds_runs(model):
    counts = [ex.qualifying_runs(model.app_runs, FilterSpec(threshold_pct=t)).count() for t in (0.6, 0.8, 0.85, 0.9, 0.95)]
    assert counts == sorted(counts, reverse=True)


def test_sweep_matches_single_threshold(model):
    sweep = ex.threshold_sweep(model.app_runs, model.app_comparison, model.absolute_counts)
    at = sweep.filter(F.col("threshold_pct") == 0.85).agg(F.sum("runs_now")).first()[0]
    q = ex.qualifying_runs(model.app_runs, FilterSpec(threshold_pct=0.85))
    players = [r.player_id for r in model.app_comparison.select("player_id").collect()]
    assert at == q.filter(F.col("player_id").isin(players)).count()


def test_batch_job_end_to_end(spark, model, tmp_path):
    res = run_job(
        spark, model.tracking, model.players_bronze, model.matches, str(tmp_path / "lake"), PROD,
        ingested_at="t0", export_dir=str(tmp_path / "export"),
    )
    audit = {r.table: r.rows for r in res.gold_audit.collect()}
    assert audit["runs"] == model.runs.count()
    assert audit["comparison"] == model.comparison.count()
    assert res.bronze_audit.count() == model.tracking.select("game_id").distinct().count()
    assert (tmp_path / "export" / "player_summary").exists()
    # runs are exported by all tasks (not through one); the folder reads back whole
    exported = spark.read.option("header", "true").csv(str(tmp_path / "export" / "runs"))
    assert exported.count() == model.runs.count()


def test_oracle_matches_on_smallest_fixture(spark):
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    qs, os_ = se.queries(), se.oracle_sql()
    own = set(registry.QUERIES)
    assert set(os_) & own == own - {"vmax_approx"} and set(os_) <= set(qs)
    for key in ("relative_runs", "absolute_run_counts", "definition_comparison", "player_summary", "zone9_heatmap",
                "threshold_sweep", "round_summary", "topk_mean_speed", "vmax_per_game", "comparison_lib"):
        s = sorted(tuple(sorted(zip(r.asDict().keys(), map(str, r)))) for r in qs[key](spark, SF).collect())
        res = con.execute(os_[key])
        cols = [d[0] for d in res.description]
        d = sorted(
            tuple(sorted(zip(cols, [str(v) if not isinstance(v, float) else str(float(v)) for v in row])))
            for row in res.fetchall()
        )
        assert len(s) == len(d), key
        assert s == d, key


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert df.count() > 0 and "delta" in df.columns


def test_presets_share_vmax_pass_and_dimensions(model):
    lib = model.lib()
    assert lib.vmax_table is model.vmax_table  # one exact-percentile pass for both presets
    assert {"vmax_p99_5", "vmax_p99_9"} <= set(model.vmax_table.columns)
    assert lib.absolute_pieces is model.absolute_pieces
    assert lib.player_lookup is model.player_lookup and lib.matches is model.matches
    # each preset reads its own percentile from the shared table
    a = {r.player_id: r.vmax_kmh for r in lib.vmax.collect()}
    b = {r.player_id: r.vmax_p99_5 for r in model.vmax_table.collect()}
    assert a == b


def _tables(spark, res):
    names = ("tracking_bronze", "tracking_silver", "runs", "comparison", "player_summary", "absolute_runs")
    return {n: sorted(map(str, io.read_table(spark, res.tables[n]).drop("_ingested_at").collect())) for n in names}


def _job(spark, model, out, chosen, params=PROD, **options):
    tracking = model.tracking.filter(F.col("game_id").isin(chosen))
    return run_job(spark, tracking, model.players_bronze, model.matches, str(out), params, ingested_at="t0", **options)


def test_job_replaces_appends_and_reloads(spark, model, tmp_path):
    games = sorted(r.game_id for r in model.tracking.select("game_id").distinct().collect())
    few, more = games[:6], games[6:12]
    fresh = _tables(spark, _job(spark, model, tmp_path / "fresh", few))
    _job(spark, model, tmp_path / "a", games)
    assert _tables(spark, _job(spark, model, tmp_path / "a", few)) == fresh  # a run replaces all games
    strict = PROD.with_(min_duration_sec=1.35)
    again = _tables(spark, _job(spark, model, tmp_path / "a", few, strict))
    assert again == _tables(spark, _job(spark, model, tmp_path / "strict", few, strict))
    _job(spark, model, tmp_path / "b", few)
    both = _tables(spark, _job(spark, model, tmp_path / "b", more, overwrite=False))
    assert both == _tables(spark, _job(spark, model, tmp_path / "c", few + more))
    assert len(both["tracking_silver"]) == sum("player_id='ball'" not in r for r in both["tracking_bronze"])
    gone = few[0]  # listed, but without rows: its partition goes
    reload = _tables(spark, _job(spark, model, tmp_path / "b", few[1:2], games=few[:2]))
    assert reload == _tables(spark, _job(spark, model, tmp_path / "d", [g for g in few + more if g != gone]))


def test_job_without_runs_or_rows_keeps_schemas(spark, model, tmp_path):
    for games in ([sorted(r.game_id for r in model.tracking.select("game_id").distinct().collect())[0]], []):
        res = _job(spark, model, tmp_path / f"n{len(games)}", games, PROD.with_(min_frames_vmax=10**6))
        assert {r.table: r.rows for r in res.gold_audit.collect()} == {"runs": 0, "comparison": 0, "player_summary": 0}
        assert res.silver_audit.first().effort_frames == 0


def test_job_reads_silver_once_and_leaves_no_stage_folder(spark, model, tmp_path):
    model.tracking, model.players_bronze, model.matches  # staged by the model
    before = {p for p in Path(ensure_checkpoint_dir(spark)).glob("strideflow-tables/*/*")}
    res = _job(spark, model, tmp_path / "x", [r.game_id for r in model.tracking.select("game_id").distinct().limit(5).collect()])
    left = {p for p in Path(ensure_checkpoint_dir(spark)).glob("strideflow-tables/*/*")} - before
    assert not left
    silver = io.read_table(spark, res.tables["tracking_silver"])
    assert {"vmax_kmh", "speed_threshold_kmh", "low_confidence", "is_effort_frame"} <= set(silver.columns)
    files = list(Path(res.tables["tracking_silver"]).glob("game_id=*/*.parquet"))
    assert len(files) <= 2 * silver.select("game_id").distinct().count()
    plan = ru.both_run_pieces(silver, PROD)._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan" in line and "speed_kmh" in line for line in plan.splitlines()) == 1


def test_both_definitions_from_one_scan_equal_single_ones(spark, model):
    both = ru.both_run_pieces(model.tagged, model.params)
    pairs = (("relative", ru.effort_run_pieces(model.tagged, model.params)), ("absolute", ru.absolute_run_pieces(model.speeds, model.params)))
    for name, alone in pairs:
        a = ru.runs_from_pieces(ru.pieces_of(both, name), model.params, relative=name == "relative")
        b = ru.runs_from_pieces(alone, model.params, relative=name == "relative")
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_comparison_from_frames_with_and_without_speeds(model):
    lib = model.lib()
    want = sorted(map(str, tb.compare_definitions_lib(lib.vmax, lib.runs, lib.absolute_runs, lib.params.threshold_pct).collect()))
    for frames in (model.tracking, model.speeds):
        assert sorted(map(str, compare_from_frames(frames, lib.params).collect())) == want


def test_job_stores_periods(spark, model, tmp_path):
    periods = spark.createDataFrame([("1", 1, 0, 119)], "game_id string, period_id int, start_frame_id long, end_frame_id long")
    res = _job(spark, model, tmp_path / "p", [], periods=periods)
    assert io.read_table(spark, res.tables["periods_bronze"]).drop("_ingested_at").collect() == periods.collect()


def test_no_single_task_over_players(spark, model):
    plan = fr.topk_mean_speed(model.speeds)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan


def test_stage_folder_needs_a_shared_one_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session)


def test_stage_folder_does_not_nest(spark):
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)


def test_model_close_removes_its_stages(spark):
    m = EffortModel(spark, SF, PROD, materialized=True)
    folder = Path(m.vmax_table.inputFiles()[0].removeprefix("file://")).parent
    assert folder.exists()
    m.close()
    assert not folder.exists()
