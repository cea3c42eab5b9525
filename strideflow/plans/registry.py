"""Query registry: one callable per SURVEY section-2 key, each ``(spark,
sf_dir) -> DataFrame`` over the derived fixture of the given folder.

Outputs are normalised for comparison with the SQL oracle: integral columns
as bigint, float/double columns rounded to 6 dp as double.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideflow.functions.numeric import rnd
from pyspark.sql import types as T

from strideflow.functions.positions import with_position_columns
from strideflow.operators import distinct_state as ds
from strideflow.operators import frames as fr
from strideflow.operators import runs as ru
from strideflow.operators import sweep as sw
from strideflow.operators import tables as tb
from strideflow.operators import vmax_state as vs
from strideflow.params import LIB, PROD, FilterSpec
from strideflow.plans import explore as ex
from strideflow.plans import gold, phases
from strideflow.plans.model import EffortModel
from strideflow.plans.pipeline import effort_pipeline
from strideflow.plans.store import GameStore
from strideflow.session import delete_folder, ensure_checkpoint_dir
from strideflow.sources import tables as io
from strideflow.sources import tracking as src
from strideflow.sources.metadata import read_match_metadata, with_round

INGEST_STAMP = "2022-12-18T00:00:00+00:00"


def normalise(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = rnd(c.cast("double"), 6)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


_MODELS: dict[tuple, EffortModel] = {}


def _m(spark: SparkSession, sf_dir: str) -> EffortModel:
    """One materialised bronze/silver/gold graph per session and folder:
    speeds, v-max and run tables are written once (Parquet in the shared
    checkpoint folder) and every query reads them, like the dashboard reads
    the gold export."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        for old in [k for k in _MODELS if k[0] != key[0]]:
            del _MODELS[old]  # of a session that has ended
        _MODELS[key] = EffortModel(spark, sf_dir, PROD, materialized=True)
    return _MODELS[key]


def close_models() -> None:
    """Remove all stage tables that the queries have written."""
    while _STORES:
        store = _STORES.popitem()[1]
        delete_folder(store.spark, store.root.rsplit("/", 1)[0])
    while _MODELS:
        _MODELS.popitem()[1].close()


_STORES: dict[int, GameStore] = {}


def _store(m: EffortModel) -> GameStore:
    """A store of the folder's games that has got them in batches: four games
    in five, then the rest, these again frame by frame, and one game removed
    and brought back."""
    if id(m) not in _STORES:
        store = GameStore(m.spark, f"{ensure_checkpoint_dir(m.spark)}/strideflow-tables/{uuid.uuid4().hex}/store", m.params)
        frames = m.tracking
        late = F.pmod(F.xxhash64("game_id"), F.lit(5)) == 0
        store.apply(frames.filter(~late))
        store.apply(frames.filter(late))
        store.apply(frames.filter(late), merge_frames=True)
        some = frames.agg(F.min("game_id")).head()[0]
        store.apply(removed=[some])
        store.apply(frames.filter(F.col("game_id") == some))
        _STORES[id(m)] = store
    return _STORES[id(m)]


def _folder(m: EffortModel, name: str) -> str:
    return f"{ensure_checkpoint_dir(m.spark)}/strideflow-tables/{uuid.uuid4().hex}/{name}"


def _json_frames(m: EffortModel) -> DataFrame:
    """The frames as packed JSON lines, and read back."""
    path = _folder(m, "raw")
    m.tracking.write.option("compression", "gzip").json(path)
    rows, _ = src.read_tracking_json(m.spark, path)
    return rows


def _match_documents(m: EffortModel) -> DataFrame:
    """A JSON document a match, nested and without its missing keys, and read
    back flat."""

    def team(side: str):
        return F.struct(*[F.col(f"{side}_team_{c}").alias(name) for c, name in (("id", "id"), ("name", "name"), ("short", "shortName"))])

    pitch = F.struct(F.col("pitch_length").alias("length"), F.col("pitch_width").alias("width"))
    doc = F.struct(
        F.col("game_id").alias("id"), "date", "season", "fps", "week", team("home").alias("homeTeam"), team("away").alias("awayTeam"),
        F.struct(F.col("competition_id").alias("id"), F.col("competition_name").alias("name")).alias("competition"),
        F.struct(F.col("stadium_name").alias("name"), F.array(pitch).alias("pitches")).alias("stadium"),
    )
    path = _folder(m, "documents")
    m.matches.select("game_id", F.to_json(doc).alias("value")).write.partitionBy("game_id").text(path)
    return with_round(read_match_metadata(m.spark, path))


def _written_runs(m: EffortModel) -> DataFrame:
    """The runs in a table a game: replaced, its games reloaded, one half
    replaced by appending, and read back."""
    path, runs = _folder(m, "runs"), m.runs
    half = F.pmod(F.xxhash64("game_id"), F.lit(2)) == 0
    io.write_table(runs.limit(5), path, partition_by=["game_id"])
    io.write_table(runs.filter(half), path, partition_by=["game_id"])
    io.write_table(runs.filter(~half), path, partition_by=["game_id"], overwrite=False, cluster_by=["player_id"])
    some = [r.game_id for r in runs.select("game_id").distinct().orderBy("game_id").limit(3).collect()]
    io.write_table(runs, path, partition_by=["game_id"], only=some)
    return io.read_table(m.spark, path, runs.schema)


def _csv_comparison(m: EffortModel) -> DataFrame:
    """The comparison as exported CSV, and read back."""
    path = _folder(m, "comparison")
    io.export_csv(m.comparison, path, order_by=["player_id"])
    return io.read_csv(m.spark, path, m.comparison.schema)


def _by_batches(m: EffortModel, group: str, column: str, name: str) -> DataFrame:
    """Distinct counts over the runs, taken in as three batches of games."""
    batch = F.pmod(F.xxhash64("game_id"), F.lit(3))
    return ds.counts_by_batches([m.runs.filter(batch == i) for i in range(3)], group, column, name, m._stage)


def _scanned(m: EffortModel) -> DataFrame:
    """The stored frames, scanned by path."""
    m.tracking  # noqa: B018  (stored by its first use)
    return src.scan_tracking(m.spark, m.paths["tracking"])


def _dyn(m: EffortModel, spec: FilterSpec = ex.DEFAULT):
    q = ex.qualifying_runs(m.app_runs, spec)
    d = ex.dynamic_counts(q)
    sdyn = ex.summary_dynamic(m.app_summary, d, spec)
    cdyn = ex.comparison_dynamic(m.app_comparison, m.absolute_counts, q, spec)
    return q, d, sdyn, cdyn


def _fs(m: EffortModel):
    return ex.filtered_summary(_dyn(m)[2])


def _fc(m: EffortModel):
    return ex.filtered_comparison(_dyn(m)[3])


TRACKING_COLS = ["game_id", "frame_id", "period_id", "timestamp", "team_id", "player_id", "x", "y"]

_Q: dict[str, Callable[[EffortModel], DataFrame]] = {
    # --- sources ---------------------------------------------------------------
    "scan_tracking": _scanned,
    "normalise_tracking": lambda m: src.normalise_tracking(m.tracking, INGEST_STAMP),
    "json_frames": _json_frames,
    "match_documents": _match_documents,
    "written_runs": _written_runs,
    "csv_comparison": _csv_comparison,
    # --- projection / filter -----------------------------------------------------
    "ball_filter": lambda m: fr.drop_ball(m.tracking).select(*TRACKING_COLS),
    "absolute_frames": lambda m: fr.absolute_frames(m.speeds, m.params).select(
        "player_id", "game_id", "frame_id", "speed_kmh"
    ),
    "position_rollup": lambda m: with_position_columns(m.player_lookup).select(
        "player_id", "position", "pos", "pos_detail"
    ),
    "qualifying_runs": lambda m: ex.qualifying_runs(m.app_runs).select(
        "player_id", "game_id", "period_id", "run_id", "pct_of_vmax", "team_short", "pos"
    ),
    "filtered_summary": lambda m: _fs(m).select(
        "player_id", "team_short", "pos", "games", "rate_now", "runs_now",
        "peak_per_run_now", "threshold_at_pct",
    ),
    "filtered_comparison": lambda m: _fc(m).select(
        "player_id", "team_short", "pos", "games", "runs_absolute_now", "runs_relative_now", "delta",
        "change_pct", "category",
    ),
    "pitch_runs_fallback": lambda m: ex.pitch_runs_fallback(ex.qualifying_runs(m.app_runs)).select(
        "player_id", "game_id", "period_id", "run_id", "team_short", "pos"
    ),
    "match_labels": lambda m: ex.match_labels(m.matches),
    "team_options": lambda m: ex.team_options(m.app_summary),
    "threshold_columns": lambda m: ex.threshold_columns(m.app_comparison).select(
        "player_id", "vmax_kmh", "threshold_at_pct", "above_absolute", "new_threshold_vs_20", "breakeven_vmax_kmh"
    ),
    # --- frame features -----------------------------------------------------------
    "frame_speed": lambda m: m.speeds.select("player_id", "game_id", "frame_id", "period_id", "speed_kmh"),
    "vmax_exact": lambda m: m.vmax,
    "vmax_per_game": lambda m: fr.compute_vmax(m.speeds, m.params.with_(vmax_per_game=True)),
    "vmax_approx": lambda m: fr.compute_vmax_approx(m.speeds, m.params),
    "vmax_sketch": lambda m: vs.rank_errors(
        vs.vmax_from_sketches(vs.sketches(m.speeds), m.params.vmax_percentile), vs.values(m.speeds), m.params.vmax_percentile
    ).select("player_id", "frame_count", "within_bound"),
    "vmax_approx_bound": lambda m: vs.rank_errors(
        fr.compute_vmax_approx(m.speeds, m.params).select("player_id", "vmax_kmh", "frame_count"), vs.values(m.speeds), m.params.vmax_percentile,
        bound=1.0 / m.params.approx_accuracy,
    ).select("player_id", "frame_count", "within_bound"),
    "relative_threshold": lambda m: m.vmax.select("player_id", "vmax_kmh", "speed_threshold_kmh"),
    "tagged_frames": lambda m: m.silver.select(
        "player_id", "game_id", "frame_id", "speed_kmh", "speed_threshold_kmh", "low_confidence", "is_effort_frame"
    ),
    "definition_preview": lambda m: fr.definition_preview(m.tagged, m.params),
    "topk_mean_speed": lambda m: fr.topk_mean_speed(m.speeds),
    # --- runs --------------------------------------------------------------------
    "relative_runs": lambda m: m.runs,
    "absolute_runs": lambda m: m.absolute_runs,
    "absolute_run_counts": lambda m: m.absolute_counts,
    "runs_min_duration": lambda m: ru.runs_from_pieces(m.run_pieces, m.params.with_(min_duration_sec=0.8))
    .withColumn("min_duration_sec", F.lit(0.8))
    .unionByName(
        ru.runs_from_pieces(m.run_pieces, m.params.with_(min_duration_sec=1.2)).withColumn(
            "min_duration_sec", F.lit(1.2)
        )
    ),
    "runs_enriched": lambda m: m.runs_enriched,
    "sweep_runs": lambda m: sw.sweep_runs(m.sweep_pieces, params=m.params),
    # --- tables --------------------------------------------------------------------
    "player_summary_lib": lambda m: (lambda l: tb.summarise_players_lib(l.runs, l.vmax))(m.lib()),
    "player_summary": lambda m: m.summary,
    "comparison_lib": lambda m: (
        lambda l: tb.compare_definitions_lib(l.vmax, l.runs, l.absolute_runs, l.params.threshold_pct)
    )(m.lib()),
    "definition_comparison": lambda m: m.comparison,
    "category_counts": lambda m: tb.category_counts(m.comparison),
    "games_per_player": lambda m: tb.games_per_player(m.runs),
    "distinct_games": lambda m: _by_batches(m, "player_id", "game_id", "games"),
    "distinct_players": lambda m: _by_batches(m, "game_id", "player_id", "players"),
    "team_lookup": lambda m: m.teams,
    "player_lookup": lambda m: m.player_lookup,
    # --- the store, after several batches -------------------------------------------
    "store_runs": lambda m: _store(m).table("runs"),
    "store_vmax": lambda m: _store(m).vmax,
    "store_tagged_frames": lambda m: _store(m).table("silver").select(
        "player_id", "game_id", "frame_id", "speed_kmh", "speed_threshold_kmh", "low_confidence", "is_effort_frame"
    ),
    "store_comparison": lambda m: _store(m).gold(m.players_bronze, m.matches)["comparison"],
    "store_summary": lambda m: _store(m).gold(m.players_bronze, m.matches)["player_summary"],
    "effort_pipeline": lambda m: effort_pipeline(m.tracking, LIB)[2],
    "bronze_audit": lambda m: m.tracking.groupBy("game_id").agg(
        F.count(F.lit(1)).alias("n_frames"), F.count_distinct("player_id").alias("n_players")
    ),
    "silver_audit": lambda m: m.silver.agg(
        F.count(F.lit(1)).alias("total_frames"),
        F.count_if("is_effort_frame").alias("effort_frames"),
        rnd(F.count_if("is_effort_frame") / F.nullif(F.count(F.lit(1)), F.lit(0)) * 100, 2).alias("effort_pct"),
    ),
    "gold_audit": lambda m: (
        m.runs_enriched.agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("table", F.lit("runs"))
        .unionByName(m.comparison.agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit("comparison")))
        .unionByName(m.summary.agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit("player_summary")))
    ),
    # --- gold analysis ---------------------------------------------------------------
    "q_position": lambda m: gold.by_position(m.summary),
    "q_team": lambda m: gold.by_team(m.summary),
    "team_outperformance": lambda m: gold.team_outperformance(m.comparison),
    "top20_players": lambda m: gold.top_by_rate(m.summary, 20),
    "most_affected": lambda m: gold.most_affected(m.comparison, 30),
    "pitch_thirds_by_position": lambda m: gold.pitch_thirds_by_position(m.runs_enriched),
    "fastest_players": lambda m: gold.fastest_players(m.vmax, 20),
    "fewest_absolute": lambda m: gold.fewest_absolute(m.absolute_counts, 10),
    # --- dashboard -------------------------------------------------------------------
    "dynamic_counts": lambda m: _dyn(m)[1],
    "summary_dynamic": lambda m: _dyn(m)[2].select(
        "player_id", "runs", "runs_now", "games_now", "rate_now",
        "peak_per_run_now", "effort_pct_now", "threshold_at_pct",
    ),
    "comparison_dynamic": lambda m: _dyn(m)[3].select(
        "player_id", "runs_relative", "runs_absolute", "runs_absolute_now", "runs_relative_now", "delta",
        "change_pct", "category", "threshold_at_pct", "above_absolute",
    ),
    "kpis": lambda m: ex.kpis(_fs(m)),
    "top_players": lambda m: ex.top_players(_fs(m), 20),
    "zone30_player": lambda m: ex.zone30_player(ex.qualifying_runs(m.app_runs)),
    "zone30_top3": lambda m: ex.zone30_top3(ex.zone30_player(ex.qualifying_runs(m.app_runs))),
    "player_table": lambda m: ex.player_table(_fs(m)),
    "team_profile": lambda m: ex.team_profile(_fs(m)),
    "team_distance_top16": lambda m: ex.team_distance_top(ex.team_profile(_fs(m)), 16),
    "position_profile": lambda m: ex.position_profile(_fs(m)),
    "position_radar": lambda m: ex.position_radar(ex.position_profile(_fs(m))),
    "run_delta_histogram": lambda m: ex.run_delta_histogram(_fc(m), 30),
    "team_outperformance_dynamic": lambda m: ex.team_outperformance_dynamic(_fc(m)),
    "most_affected_dynamic": lambda m: ex.most_affected_dynamic(_fc(m)),
    "pitch_thirds": lambda m: ex.pitch_thirds(m.app_runs),
    "pitch_thirds_by_group": lambda m: ex.pitch_thirds_by_group(m.app_runs),
    "zone9_heatmap": lambda m: ex.zone9_heatmap(ex.pitch_runs_fallback(ex.qualifying_runs(m.app_runs))),
    "match_runs": lambda m: ex.match_runs(m.app_runs).select("game_id", "player_id", "period_id", "run_id", "pct_of_vmax"),
    "match_top_performers": lambda m: ex.match_top_performers(ex.match_runs(m.app_runs)),
    "match_team_comparison": lambda m: ex.match_team_comparison(ex.match_runs(m.app_runs)),
    "match_position": lambda m: ex.match_position(ex.match_runs(m.app_runs)),
    "match_zone9": lambda m: ex.match_zone9(ex.match_runs(m.app_runs)),
    "match_header": lambda m: ex.match_header(m.matches),
    "threshold_sweep": lambda m: ex.threshold_sweep(m.app_runs, m.app_comparison, m.absolute_counts),
    # --- the same from the measure cube ---------------------------------------------
    "cube_dynamic_counts": lambda m: m.cube_views.dynamic_counts(),
    "cube_kpis": lambda m: m.cube_views.kpis(),
    "cube_zone30_player": lambda m: m.cube_views.zone30_player(),
    "cube_team_profile": lambda m: m.cube_views.team_profile(),
    "cube_pitch_thirds": lambda m: m.cube_views.pitch_thirds(),
    "cube_zone9_heatmap": lambda m: m.cube_views.zone9_heatmap(),
    "cube_match_top_performers": lambda m: m.cube_views.match_top_performers(),
    "cube_match_team_comparison": lambda m: m.cube_views.match_team_comparison(),
    "cube_match_position": lambda m: m.cube_views.match_position(),
    "cube_match_zone9": lambda m: m.cube_views.match_zone9(),
    # --- phases --------------------------------------------------------------------
    "round_summary": lambda m: phases.round_summary(m.app_runs, m.matches),
    "week_trend": lambda m: phases.week_trend(m.app_runs, m.matches),
    "position_by_round": lambda m: phases.position_by_round(m.app_runs, m.matches),
    "games_per_round": lambda m: phases.games_per_round(m.matches),
}


def _wrap(fn: Callable[[EffortModel], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return normalise(fn(_m(spark, sf_dir)))

    run.__doc__ = fn.__doc__
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _wrap(v) for k, v in _Q.items()}

# keys with no SQL oracle (approximate sketch -> rows-only check)
NO_ORACLE = {"vmax_approx"}
