"""The store of games, the mergeable v-max state and the threshold sweep."""

import os
import random
import re
from pathlib import Path

import pytest
from conftest import frames_df, player_rows
from pyspark.sql import functions as F

from strideflow.operators import frames as fr
from strideflow.operators import runs as ru
from strideflow.operators import sweep as sw
from strideflow.operators import vmax_state as vs
from strideflow.params import PROD, SWEEP_THRESHOLDS
from strideflow.plans import store as st
from strideflow.session import materialize

PARAMS = PROD.with_(min_frames_vmax=50, chunk_frames=64)


@pytest.fixture(autouse=True, scope="module")
def few_partitions(spark):
    """The tables are tiny and the jobs many."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def game_rows(game, players, seed, top=30.0, frames=160):
    rng = random.Random(seed)
    out = []
    for p in players:
        speeds, v = [], 0.0
        for _ in range(frames):
            v = max(0.0, min(top, v + rng.uniform(-2.0, 2.6)))
            speeds.append(v)
        out += player_rows(p, speeds, game_id=game)
    return out


def league(n=8):
    """Games of two players; each player plays in two neighbouring games."""
    return {f"g{i}": game_rows(f"g{i}", [f"p{i}", f"p{i + 1}"], seed=i) for i in range(n)}


def fresh(frames, params=PARAMS):
    speeds = materialize(fr.compute_speed(fr.drop_ball(frames), params), "speeds")
    vmax = materialize(fr.compute_vmax(speeds, params), "vmax")
    tagged = materialize(fr.tag_effort_frames(speeds, vmax), "tagged")
    return vmax, ru.extract_effort_runs(tagged, params), tagged, ru.absolute_run_counts(speeds, params)


def lines(df, columns=None):
    return sorted(str(tuple(r)) for r in df.select(*(columns or df.columns)).collect())


def same_as_fresh(store, frames, params=PARAMS):
    vmax, runs, tagged, absolute = fresh(frames, params)
    assert lines(store.vmax, vmax.columns) == lines(vmax)
    assert lines(store.table("runs"), runs.columns) == lines(runs)
    assert lines(store.table("silver"), tagged.columns) == lines(tagged)
    assert lines(store.absolute_counts, absolute.columns) == lines(absolute)
    pairs = tagged.filter("speed_kmh is not null").groupBy("player_id").agg(F.count_distinct("game_id").alias("n_games"))
    assert lines(store.games_per_player(), ["player_id", "n_games"]) == lines(pairs)


def files(root):
    return {p: os.stat(p).st_mtime_ns for p in Path(root).rglob("*.parquet") if "attempt=" in str(p)}


def rows_of(games):
    return [r for g in games.values() for r in g]


def test_an_append_rewrites_only_what_it_touches(spark, tmp_path):
    games = league()
    last = games.pop("g7")
    store = st.GameStore(spark, str(tmp_path / "lake"), PARAMS)
    store.apply(frames_df(spark, rows_of(games)))
    before = files(tmp_path)
    done = store.apply(frames_df(spark, last))
    after = files(tmp_path)
    assert {p: t for p, t in after.items() if p in before} == before  # nothing that was there is written again
    games["g7"] = last
    same_as_fresh(store, frames_df(spark, rows_of(games)))
    reflagged = {r.game_id for r in done["reflagged"].collect()}
    assert reflagged <= {"g6"}  # p7 plays in g6 too; nobody else is concerned
    new = {p for p in after if p not in before}
    written = {part.split("=")[1] for p in new if "/silver/" in str(p) for part in p.parts if part.startswith("game_id=")}
    assert written == {"g7"} | reflagged
    held = {(r.kind, r.game_id): r.attempt for r in store.ledger().collect()}
    assert held["state", "g0"] == held["flagged", "g0"] != held["state", "g7"]


def test_moved_vmax_reaches_the_player_s_other_games(spark, tmp_path):
    games = league(4)
    store = st.GameStore(spark, str(tmp_path / "lake"), PARAMS)
    store.apply(frames_df(spark, rows_of(games)))
    games["fast"] = game_rows("fast", ["p1"], seed=99, top=44.0, frames=400)
    done = store.apply(frames_df(spark, games["fast"]))
    assert [r.player_id for r in done["players"].collect()] == ["p1"]
    assert sorted(r.game_id for r in done["reflagged"].collect()) == ["g0", "g1"]
    same_as_fresh(store, frames_df(spark, rows_of(games)))


def test_reload_removal_and_readding(spark, tmp_path):
    games = league(4)
    store = st.GameStore(spark, str(tmp_path / "lake"), PARAMS)
    store.apply(frames_df(spark, rows_of(games)))
    games["g2"] = game_rows("g2", ["p2", "p9"], seed=77)
    store.apply(frames_df(spark, games["g2"]))
    same_as_fresh(store, frames_df(spark, rows_of(games)))
    gone = games.pop("g1")
    store.apply(removed=["g1", "never there"])
    same_as_fresh(store, frames_df(spark, rows_of(games)))
    games["g1"] = gone
    store.apply(frames_df(spark, gone))
    same_as_fresh(store, frames_df(spark, rows_of(games)))


def test_late_and_corrected_frames_are_merged_by_key(spark, tmp_path):
    games = league(3)
    early = [r for r in games["g1"] if r[1] % 10 < 7]
    late = [r for r in games["g1"] if r[1] % 10 >= 7]
    wrong = [(*r[:8], r[8] + 30.0, *r[9:]) for r in early[:20]]
    store = st.GameStore(spark, str(tmp_path / "lake"), PARAMS)
    store.apply(frames_df(spark, games["g0"] + games["g2"] + wrong + early[20:]))
    store.apply(frames_df(spark, late), merge_frames=True)
    store.apply(frames_df(spark, late), merge_frames=True)  # sent twice
    store.apply(frames_df(spark, early[:20]), merge_frames=True)  # a correction
    same_as_fresh(store, frames_df(spark, rows_of(games)))


def test_a_batch_that_fails_leaves_the_last_commit(spark, tmp_path):
    games = league(3)
    store = st.GameStore(spark, str(tmp_path / "lake"), PARAMS)
    store.apply(frames_df(spark, rows_of(games)))
    broken = frames_df(spark, game_rows("g1", ["p1"], seed=5)).withColumn("x", F.when(F.col("frame_id") == 100, F.raise_error(F.lit("stop")).cast("float")).otherwise(F.col("x")))
    with pytest.raises(Exception, match="stop"):
        store.apply(broken)
    assert store.head()[0] == 1
    same_as_fresh(store, frames_df(spark, rows_of(games)))
    more = game_rows("g9", ["p1"], seed=6)
    store.apply(frames_df(spark, more))
    same_as_fresh(store, frames_df(spark, rows_of(games) + more))


def test_of_two_writers_of_a_commit_one_fails(spark, tmp_path, monkeypatch):
    games = league(3)
    store, other = (st.GameStore(spark, str(tmp_path / "lake"), PARAMS) for _ in range(2))
    store.apply(frames_df(spark, games["g0"]))
    real = st.GameStore._commit

    def overtaken(self, number, attempt):
        monkeypatch.setattr(st.GameStore, "_commit", real)
        other.apply(frames_df(spark, games["g1"]))  # commits the same number first
        real(self, number, attempt)

    monkeypatch.setattr(st.GameStore, "_commit", overtaken)
    with pytest.raises(st.ConcurrentCommit):
        store.apply(frames_df(spark, games["g2"]))
    same_as_fresh(store, frames_df(spark, games["g0"] + games["g1"]))


def test_empty_batches_and_games_without_speeds(spark, tmp_path):
    store = st.GameStore(spark, str(tmp_path / "lake"), PARAMS)
    none = frames_df(spark, [])
    store.apply(none)
    same_as_fresh(store, none)
    one = [r for r in game_rows("g0", ["p0", "ball"], seed=1, frames=1)]
    store.apply(frames_df(spark, one))
    same_as_fresh(store, frames_df(spark, one))


def test_vacuum_keeps_the_last_commit_whole(spark, tmp_path):
    games = league(3)
    store = st.GameStore(spark, str(tmp_path / "lake"), PARAMS)
    store.apply(frames_df(spark, games["g0"]))
    first = store.head()[1]
    store.apply(frames_df(spark, rows_of(games)))  # g0 again: the first attempt holds nothing current
    before = len(files(tmp_path))
    assert store.vacuum() == [first] and store.vacuum() == []
    assert len(files(tmp_path)) < before
    same_as_fresh(store, frames_df(spark, rows_of(games)))
    games["g3"] = game_rows("g3", ["p1"], seed=8)
    store.apply(frames_df(spark, games["g3"]))
    same_as_fresh(store, frames_df(spark, rows_of(games)))


# --- v-max state ----------------------------------------------------------------


def test_state_gives_the_percentile_to_the_bit(spark):
    speeds = fr.compute_speed(frames_df(spark, rows_of(league())), PARAMS)
    for per_game in (False, True):
        keys = ["player_id", "game_id"] if per_game else ["player_id"]
        got = vs.vmax_from_state(vs.histogram(speeds), vs.values(speeds), [50.0, 99.5, 99.9], per_game)
        v = F.col("speed_kmh").cast("double")
        exact = speeds.filter("speed_kmh is not null").groupBy(*keys).agg(*[F.percentile(v, p / 100.0).alias(fr._pcol(p)) for p in (50.0, 99.5, 99.9)], F.count("speed_kmh").alias("frame_count"))
        assert lines(got, exact.columns) == lines(exact)


def test_only_the_needed_bands_of_old_games_are_read(spark, tmp_path):
    store = st.GameStore(spark, str(tmp_path / "lake"), PARAMS)
    store.apply(frames_df(spark, rows_of(league())))
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        state = vs.vmax_from_state(store.table("histogram"), store.table("values"), [99.9])
        plan = state._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    (scan,) = [x for x in plan.split("\n") if "FileScan" in x and "/values" in x]
    chosen = re.search(r"PartitionFilters: \[.*?band#\d+ (?:IN \((.*?)\)|INSET ([\d, ]+)|= (\d+))", scan)
    assert chosen and "/silver" not in plan and "/bronze" not in plan
    picked = {int(b) for b in re.findall(r"\d+", next(g for g in chosen.groups() if g))}
    bands = {int(p.name.split("=")[1]) for p in Path(tmp_path).rglob("band=*")}
    assert picked < bands and min(picked) >= 10  # top speeds only, of 30 km/h and more bands


def test_sketches_merge_within_their_bound(spark):
    speeds = fr.compute_speed(frames_df(spark, rows_of(league())), PARAMS)
    stored = vs.sketches(speeds, 64)
    found = vs.rank_errors(vs.vmax_from_sketches(stored, 90.0, k=64), vs.values(speeds), 90.0, bound=0.1)
    rows = found.collect()
    assert len(rows) == 9 and all(r.within_bound and r.frame_count > 100 for r in rows)
    assert not all(r.within_bound for r in vs.rank_errors(vs.vmax_from_sketches(stored, 50.0, k=64), vs.values(speeds), 95.0, bound=0.01).collect())


# --- sweep ----------------------------------------------------------------------


def test_sweep_equals_an_extraction_for_each_threshold(spark):
    rows = rows_of(league(3))
    rows += [(*r[:8], r[8] + 0.3, *r[9:]) for r in rows[40:60]]  # repeated frame ids
    rows = [r for r in rows if r[1] % 37 != 5]  # gaps
    speeds = fr.compute_speed(frames_df(spark, rows), PARAMS).withColumn("period_id", F.when(F.col("frame_id") < 80, 1).otherwise(2))
    params = PARAMS.with_(min_duration_sec=0.2, chunk_frames=13)
    speeds = materialize(speeds, "speeds")
    table = materialize(fr.vmax_percentiles(speeds, [params.vmax_percentile]), "vmax")
    got = materialize(sw.sweep_runs(sw.sweep_pieces(speeds, fr.vmax_from_table(table, params), params=params), params=params), "sweep")
    seen = 0
    for t in SWEEP_THRESHOLDS:
        at = params.with_(threshold_pct=t)
        one = ru.extract_effort_runs(fr.tag_effort_frames(speeds, fr.vmax_from_table(table, at)), at)
        want = lines(one)
        seen += len(want)
        assert lines(got.filter(F.col("threshold_pct") == t), one.columns) == want
    assert seen > 20


def test_sweep_scans_and_shuffles_the_frames_once(spark, tmp_path):
    speeds = fr.compute_speed(frames_df(spark, rows_of(league(3))), PARAMS)
    speeds.write.parquet(str(tmp_path / "speeds"))
    vmax = fr.compute_vmax(speeds, PARAMS)
    vmax.write.parquet(str(tmp_path / "vmax"))
    pieces = sw.sweep_pieces(spark.read.parquet(str(tmp_path / "speeds")), spark.read.parquet(str(tmp_path / "vmax")), params=PARAMS)
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert plan.count("frame_id") and sum("FileScan" in x and "frame_id#" in x for x in plan.split("\n")) == 1
    assert plan.count("Exchange hashpartitioning") == 1


def test_topk_window_runs_once(spark):
    """The statistics read the stored means; no plan after them has the window."""
    speeds = fr.compute_speed(frames_df(spark, rows_of(league(3))), PARAMS)
    plan = fr.topk_mean_speed(speeds)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "speed_kmh" not in plan


# --- safe replace ---------------------------------------------------------------


def test_a_replace_that_fails_leaves_the_old_table(spark, tmp_path):
    from strideflow.sources import tables as io

    for by in (None, ["g"]):
        path = str(tmp_path / f"t{bool(by)}")
        io.write_table(spark.createDataFrame([("a", 1), ("b", 2)], "g string, n int"), path, partition_by=by)
        bad = spark.range(100).select(F.lit("c").alias("g"), F.when(F.col("id") == 99, F.raise_error(F.lit("stop")).cast("int")).otherwise(1).alias("n"))
        with pytest.raises(Exception, match="stop"):
            io.write_table(bad, path, partition_by=by)
        assert lines(spark.read.parquet(path), ["g", "n"]) == ["('a', 1)", "('b', 2)"]
        io.write_table(spark.read.parquet(path).filter("n = 2"), path, partition_by=by)  # over what it reads
        assert lines(spark.read.parquet(path), ["g", "n"]) == ["('b', 2)"]
        assert [p.name for p in tmp_path.iterdir() if "new-" in p.name or "old-" in p.name] == []


def test_pipeline_reads_the_frames_once(spark, tmp_path):
    from strideflow.params import LIB
    from strideflow.plans.pipeline import compare_from_frames, effort_pipeline

    frames = frames_df(spark, rows_of(league(3)))
    params = LIB.with_(min_frames_vmax=50)
    vmax, runs, summary = effort_pipeline(frames, params)
    for df in (vmax, runs, summary):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "frame_id" not in plan.replace("start_frame_id", "").replace("end_frame_id", "") and "lag(" not in plan
    lazy = effort_pipeline(frames, params, stage=None)
    assert [lines(df) for df in (vmax, runs, summary)] == [lines(df) for df in lazy]
    assert lines(compare_from_frames(frames, params)) == lines(compare_from_frames(frames, params, stage=None))
