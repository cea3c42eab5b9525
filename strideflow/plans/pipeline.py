"""End-to-end plans.

* ``effort_pipeline`` (G9): frames -> (v-max, runs, player summary), the
  library entry point.
* ``run_job``: the bronze -> silver -> gold batch job.  Each layer is written
  once (Parquet by default; any format on the class path via ``fmt``) and
  read back by the next, which cuts lineage at the layer boundary: a lost
  executor re-reads the layer instead of recomputing the frame windows.
  A run replaces its tables whole; appending or reloading games changes
  bronze only, and silver and gold are derived anew from all of bronze.
* ``run_job_from_files``: the same from raw files, with a reject table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideflow.functions.numeric import rnd, safe_ratio
from strideflow.operators import frames as fr
from strideflow.operators import runs as ru
from strideflow.operators import tables as tb
from strideflow.params import LIB, PROD, EffortParams
from strideflow.schema import PLAYERS
from strideflow.session import drop_stages, materialize
from strideflow.sources import tables as io
from strideflow.sources.metadata import read_match_metadata, with_round
from strideflow.sources.tracking import normalise_tracking, read_tracking_json, scan_tracking

TABLES = (
    "tracking_bronze", "players_bronze", "periods_bronze", "match_metadata", "tracking_silver", "vmax_per_player",
    "runs", "comparison", "player_summary", "absolute_runs",
)
EXPORTED_MATCH = (
    "game_id", "date", "home_team_name", "home_team_short", "away_team_name", "away_team_short",
    "stadium_name", "week", "competition_name", "Round",
)


def effort_pipeline(tracking: DataFrame, params: EffortParams = LIB, stage=materialize) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Speed -> v-max -> tag -> runs -> library summary.  Speeds, v-max
    and run pieces are read by several branches, so each is a stage table;
    with ``stage=None`` the plan is lazy and derives the speeds in each."""
    keep = stage or (lambda df, name: df)
    speeds = keep(fr.compute_speed(tracking, params), "speeds")
    vmax = keep(fr.compute_vmax(speeds, params), "vmax")
    pieces = keep(ru.effort_run_pieces(fr.tag_effort_frames(speeds, vmax), params), "run_pieces")
    runs = ru.runs_from_pieces(pieces, params, relative=True)
    return vmax, runs, tb.summarise_players_lib(runs, vmax)


def compare_from_frames(frames: DataFrame, params: EffortParams = LIB, stage=materialize) -> DataFrame:
    """G3 straight from frames; speeds are computed if they are absent."""
    keep = stage or (lambda df, name: df)
    speeds = frames if "speed_kmh" in frames.columns else keep(fr.compute_speed(frames, params), "speeds")
    vmax = keep(fr.compute_vmax(speeds, params), "vmax")
    pieces = keep(ru.both_run_pieces(fr.tag_effort_frames(speeds, vmax), params), "run_pieces")
    relative = ru.runs_from_pieces(ru.pieces_of(pieces, "relative"), params, relative=True)
    absolute = ru.runs_from_pieces(ru.pieces_of(pieces, "absolute"), params, relative=False)
    return tb.compare_definitions_lib(vmax, relative, absolute, params.threshold_pct)


@dataclass
class JobResult:
    tables: dict[str, str]
    bronze_audit: DataFrame
    silver_audit: DataFrame
    gold_audit: DataFrame
    rejects: DataFrame | None = None


def run_job(
    spark: SparkSession,
    tracking: DataFrame,
    players: DataFrame,
    matches: DataFrame,
    out_dir: str,
    params: EffortParams = PROD,
    *,
    overwrite: bool = True,
    games: list[str] | None = None,
    fmt: str = "parquet",
    ingested_at: str | None = None,
    export_dir: str | None = None,
    export_single: bool = False,
    periods: DataFrame | None = None,
) -> JobResult:
    """``periods`` (a game's period bounds) is stored as it comes.
    ``overwrite=False`` appends the given games to bronze; ``games``
    reloads the listed ones there (a listed game without rows goes).  Empty
    inputs give empty tables with their full schemas."""
    paths = {name: f"{out_dir.rstrip('/')}/{name}" for name in TABLES}
    per_game = {"partition_by": ["game_id"], "fmt": fmt}

    def store(name: str, df: DataFrame, **options) -> DataFrame:
        io.write_table(df, paths[name], fmt=fmt, **options)
        return io.read_table(spark, paths[name], schema=df.schema, fmt=fmt)

    # bronze
    raw = normalise_tracking(tracking, ingested_at)
    io.write_table(raw, paths["tracking_bronze"], overwrite=overwrite, only=games, **per_game)
    bronze = io.read_table(spark, paths["tracking_bronze"], schema=raw.schema, fmt=fmt)
    stamp = F.lit(ingested_at) if ingested_at else F.current_timestamp().cast("string")
    players_b = store("players_bronze", players.withColumn("_ingested_at", stamp), overwrite=overwrite and games is None)
    if periods is not None:
        store("periods_bronze", periods.withColumn("_ingested_at", stamp), overwrite=overwrite and games is None)
    matches_b = store("match_metadata", matches)

    # silver: the frame window runs once, into a stage table that v-max is
    # taken from; the stored frames have their flag
    stages = []

    def staged(df: DataFrame, name: str) -> DataFrame:
        stages.append(materialize(df, name))
        return stages[-1]

    try:
        speeds = staged(fr.compute_speed(fr.drop_ball(bronze), params), "speeds")
        vmax = store("vmax_per_player", fr.compute_vmax(speeds, params))
        tagged = fr.tag_effort_frames(speeds, vmax)
        io.write_table(tagged, paths["tracking_silver"], cluster_by=["player_id", "frame_id"], **per_game)
        silver = io.read_table(spark, paths["tracking_silver"], schema=tagged.schema, fmt=fmt)

        # gold: one scan of silver gives the run pieces of both definitions
        plk = tb.player_lookup(players_b, tb.team_lookup(matches_b))
        pieces = staged(ru.both_run_pieces(silver, params), "run_pieces")
        runs = ru.runs_from_pieces(ru.pieces_of(pieces, "relative"), params, relative=True)
        runs_g = store("runs", tb.enrich_runs(runs, plk, matches_b), partition_by=["game_id"])
        abs_counts = store("absolute_runs", ru.run_counts_from_pieces(ru.pieces_of(pieces, "absolute"), params))
        gold = {
            "runs": runs_g,
            "comparison": store("comparison", tb.compare_definitions(vmax, runs_g, abs_counts, plk)),
            "player_summary": store("player_summary", tb.summarise_players(runs_g, vmax, plk)),
        }
    finally:
        drop_stages(*stages)

    if export_dir:
        target = export_dir.rstrip("/")
        for name, df in {**gold, "absolute_runs": abs_counts}.items():
            io.export_csv(df, f"{target}/{name}", single_file=export_single)
        io.export_csv(matches_b.select(*EXPORTED_MATCH), f"{target}/match_metadata", order_by=["date", "game_id"], single_file=export_single)

    bronze_audit = bronze.groupBy("game_id").agg(F.count(F.lit(1)).alias("n_frames"), F.count_distinct("player_id").alias("n_players"))
    # counted from the written table, where a repeated task has left its rows once
    found = silver.agg(F.count(F.lit(1)).alias("total_frames"), F.count_if("is_effort_frame").alias("effort_frames"))
    silver_audit = found.withColumn("effort_pct", rnd(safe_ratio(F.col("effort_frames"), F.col("total_frames")) * 100, 2))
    rows = [df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows")) for name, df in gold.items()]
    gold_audit = rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumn("audited_at", F.current_timestamp())
    return JobResult(paths, bronze_audit, silver_audit, gold_audit)


def run_job_from_files(
    spark: SparkSession,
    tracking_path: str,
    metadata_path: str,
    players_path: str,
    out_dir: str,
    params: EffortParams = PROD,
    **options,
) -> JobResult:
    """The job from raw files: tracking as Parquet, or as JSON lines (a path
    that ends in json, jsonl, bz2 or gz, or ``*``) whose broken games go to
    the reject table; match documents as JSON, with the round derived;
    players as Parquet."""
    rejects = None
    if tracking_path.rstrip("/").endswith(("json", "jsonl", "bz2", "gz", "*")):
        tracking, rejects = read_tracking_json(spark, tracking_path)
    else:
        tracking = scan_tracking(spark, tracking_path)
    matches = with_round(read_match_metadata(spark, metadata_path))
    players = spark.read.schema(PLAYERS).parquet(players_path)
    result = run_job(spark, tracking, players, matches, out_dir, params, **options)
    result.rejects = rejects
    return result
