"""Sources and sinks round trips (temporary folders from pytest)."""

import bz2
import json

from pyspark.sql import functions as F

from strideflow.plans.pipeline import run_job_from_files
from strideflow.schema import MATCH_CSV, PLAYERS, TRACKING
from strideflow.sources import tables as io
from strideflow.sources.metadata import read_match_metadata, with_round
from strideflow.sources.tracking import game_ids_from_files, normalise_tracking, read_tracking_json, scan_tracking

from conftest import frames_df, player_rows

DOC = {
    "id": 3814,
    "date": "2022-11-20T16:00:00",
    "season": "2022",
    "competition": {"id": "1", "name": "Cup"},
    "stadium": {"name": "Main", "pitches": [{"length": 105.0, "width": 68.0}]},
    "homeTeam": {"id": "h", "name": "Home", "shortName": "HOM"},
    "awayTeam": {"id": "a", "name": "Away", "shortName": "AWY"},
    "fps": 25.0,
    "week": 1,
}


def test_metadata_list_object_and_missing_keys(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([DOC]))
    (tmp_path / "b.json").write_text(json.dumps({**DOC, "id": 3815, "week": 4}))
    partial = {k: v for k, v in DOC.items() if k not in ("stadium",)}
    (tmp_path / "c.json").write_text(json.dumps({**partial, "id": 3816}))
    m = with_round(read_match_metadata(spark, str(tmp_path))).orderBy("game_id").collect()
    assert [r.game_id for r in m] == ["3814", "3815", "3816"]
    assert m[0].home_team_short == "HOM" and m[0].pitch_length == 105.0 and m[0].Round == "Group Stage"
    assert m[1].Round == "Knockout"
    assert m[2].stadium_name is None and m[2].pitch_width is None


def test_partitioned_write_replaces_all_or_the_listed_games(spark, tmp_path):
    out = str(tmp_path / "bronze")

    def rows(**sizes):
        found = [r for g, n in sizes.items() for r in player_rows("p", [10.0] * n, game_id=g)]
        return normalise_tracking(frames_df(spark, found), "t0")

    def counts():
        return {r.game_id: r.n for r in io.read_table(spark, out).groupBy("game_id").agg(F.count(F.lit(1)).alias("n")).collect()}

    io.write_table(rows(g1=10, g2=5, g3=4), out, partition_by=["game_id"])
    io.write_table(rows(g2=3), out, partition_by=["game_id"], only=["g2", "g3"])
    assert counts() == {"g1": 10, "g2": 3}
    pruned = io.read_table(spark, out).filter(F.col("game_id") == "g1")
    assert "PartitionFilters: [isnotnull(game_id" in pruned._jdf.queryExecution().executedPlan().toString()
    io.write_table(rows(g3=2), out, partition_by=["game_id"])
    assert counts() == {"g3": 2}


def test_scan_tracking_explicit_schema(spark, tmp_path):
    out = str(tmp_path / "t")
    frames_df(spark, player_rows("p", [10.0] * 4)).write.parquet(out)
    df = scan_tracking(spark, out)
    assert df.schema == TRACKING and df.count() == 4


def test_csv_round_trip_and_optional(spark, tmp_path):
    m = spark.createDataFrame(
        [("1", "2022-11-20T00:00:00", "A", "AA", "B", "BB", "S", 1, "C", "Group Stage")], MATCH_CSV
    )
    io.export_csv(m, str(tmp_path / "meta"), order_by=["date"])
    back = io.read_csv(spark, str(tmp_path / "meta"), MATCH_CSV)
    assert back.collect() == m.collect()
    missing = io.read_csv(spark, str(tmp_path / "nope"), MATCH_CSV, optional=True)
    assert missing.count() == 0 and missing.schema == MATCH_CSV


def test_game_ids_from_file_names(spark, tmp_path):
    for g in ("3815", "3814"):
        (tmp_path / f"{g}.jsonl.bz2").write_bytes(b"x")
    assert [r.game_id for r in game_ids_from_files(spark, str(tmp_path)).collect()] == ["3814", "3815"]


def test_unreadable_game_reported_others_continue(spark, tmp_path):
    good = {"game_id": "g1", "frame_id": 1, "period_id": 1, "timestamp": 40, "ball_state": "alive",
            "ball_owning_team_id": "h", "team_id": "h", "player_id": "p", "x": 1.0, "y": 2.0, "z": 0.0}
    (tmp_path / "g1.json").write_text(json.dumps(good) + "\n")
    (tmp_path / "g2.json").write_text("{not json\n")
    rows, rejects = read_tracking_json(spark, str(tmp_path))
    assert rows.count() == 1
    rej = rejects.collect()
    assert len(rej) == 1 and rej[0].game_id == "g2" and rej[0].bad_rows == 1


def test_truncated_game_is_rejected_whole_and_the_job_runs_from_files(spark, tmp_path):
    raw, docs = tmp_path / "raw", tmp_path / "docs"
    raw.mkdir()
    docs.mkdir()
    keys = TRACKING.fieldNames()
    for g in ("g1", "g2"):
        rows = player_rows("p", [30.0] * 300, game_id=g)
        text = "".join(json.dumps(dict(zip(keys, r))) + "\n" for r in rows).encode()
        packed = bz2.compress(text)
        (raw / f"{g}.jsonl.bz2").write_bytes(packed if g == "g1" else packed[: len(packed) // 2])
        (docs / f"{g}.json").write_text(json.dumps({**DOC, "id": g}))
    spark.createDataFrame([("p", "P", "h", 1, "ST", True)], PLAYERS).write.parquet(str(tmp_path / "players"))
    res = run_job_from_files(spark, f"{raw}/*", str(docs), str(tmp_path / "players"), str(tmp_path / "lake"), ingested_at="t0")
    assert [(r.game_id, r.n_frames) for r in res.bronze_audit.collect()] == [("g1", 300)]
    (bad,) = res.rejects.collect()
    assert bad.game_id == "g2" and bad.bad_rows is None and bad.error
    assert io.read_table(spark, res.tables["runs"]).first().home_team_name == "Home"


def test_plain_file_that_fails_midway_is_rejected_by_its_full_path(spark, tmp_path):
    keys = TRACKING.fieldNames()
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.FileSystem.getLocal(spark._jsc.hadoopConfiguration())
    for folder in ("a", "b c"):
        for g in ("g1", "g2"):
            rows = player_rows("p", [30.0] * 300, game_id=f"{folder}-{g}")
            (tmp_path / "made.json").write_text("".join(json.dumps(dict(zip(keys, r))) + "\n" for r in rows))
            to = tmp_path / "raw" / folder / f"{g}.json"
            fs.copyFromLocalFile(jvm.org.apache.hadoop.fs.Path(str(tmp_path / "made.json")), jvm.org.apache.hadoop.fs.Path(str(to)))
    broken = tmp_path / "raw" / "b c" / "g1.json"
    raw = broken.read_bytes()
    broken.write_bytes(raw[: len(raw) // 2] + b"~" * 9 + raw[len(raw) // 2 + 9 :])  # its checksum fails in the middle
    (tmp_path / "raw" / "a" / "g3.jsonl.gz").write_bytes(b"\x1f\x8b\x08broken")
    (tmp_path / "raw" / "a" / "empty.json").write_bytes(b"")
    rows, rejects = read_tracking_json(spark, str(tmp_path / "raw"))
    assert {r.game_id: r["count"] for r in rows.groupBy("game_id").count().collect()} == {"a-g1": 300, "a-g2": 300, "b c-g2": 300}
    assert sorted((r.game_id, r.bad_rows) for r in rejects.collect()) == [("g1", None), ("g3", None)]
    assert all(r.error for r in rejects.collect())


def test_raw_files_are_opened_once_and_broken_ones_stay_a_table(spark, tmp_path):
    """Rows and rejects read the stored lines; 300 broken files among good
    ones are neither collected nor named in the plan."""
    keys, raw = TRACKING.fieldNames(), tmp_path / "raw"
    (raw / "x").mkdir(parents=True)
    for i in range(300):
        (raw / f"b{i:03}.jsonl.gz").write_bytes(b"\x1f\x8b\x08 broken")
    good = "".join(json.dumps(dict(zip(keys, r))) + "\n" for r in player_rows("p", [30.0] * 50, game_id="g"))
    (raw / "good.json").write_text(good + "\n \n" + good.rstrip("\n"))
    (raw / "x" / "packed.jsonl.bz2").write_bytes(bz2.compress(good.encode()) + bz2.compress(good.encode()))
    (raw / "x" / "b000.jsonl.gz").write_bytes(b"")
    rows, rejects = read_tracking_json(spark, str(raw))
    assert rows.count() == 200
    found = rejects.collect()
    assert len(found) == 300 and all(r.bad_rows is None and r.error and r.path.endswith(f"/raw/{r.game_id}.jsonl.gz") for r in found)
    for df in (rows, rejects):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "b001" not in plan and all("/raw/" not in f or "/strideflow-tables/" in f for f in df.inputFiles())


def test_a_clustered_table_reads_little_for_one_player(spark, tmp_path, monkeypatch):
    """Rows that the scan hands on for one player of 40, by statistics alone."""
    monkeypatch.setattr(io, "ROW_GROUP_BYTES", 16 << 10)
    rows = [r for i in range(40) for r in player_rows(f"p{i:02}", [20.0] * 500, game_id=f"g{i % 2}")]
    mixed = frames_df(spark, rows).orderBy(F.rand(3))
    read = {}
    for name, cluster in (("plain", None), ("clustered", ["player_id", "frame_id"])):
        path = str(tmp_path / name)
        io.write_table(mixed, path, partition_by=["game_id"], cluster_by=cluster)
        one = io.read_table(spark, path, TRACKING).filter(F.col("player_id") == "p07")
        assert len(one.collect()) == 500
        leaves = one._jdf.queryExecution().executedPlan().collectLeaves()
        read[name] = leaves.apply(0).metrics().apply("numOutputRows").value()
    assert read["plain"] >= 10000 and read["clustered"] <= 2000, read
