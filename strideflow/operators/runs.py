"""Run extraction (gaps-and-islands): R1-R5, R7.

A run is a maximal sequence of flagged frames of one (player, game) whose
frame ids are consecutive.  ``run_id`` is the running count of run starts in
that (player, game), counting short runs too; the gate ``n_frames >= min``
is applied after grouping by (player, game, period, run_id), so a run that
crosses a period change with consecutive ids yields two rows sharing a
``run_id`` (the reference's behaviour).

Plan
----
Only flagged frames are shuffled (a few % of all frames).  They are
partitioned by (player, game, frame chunk); each chunk also receives a copy
of the previous chunk's last frame id when it is flagged, so a run start is a
local test (``no flagged frame at f-1``) and a window task never holds more
than one chunk of one key.

The window output is reduced at once, in the same partitioning, to *run
pieces*: partial run aggregates per (player, game, period, chunk, chunk-local
run number).  A run that crosses a chunk edge or a period change is several
pieces.  The global ``run_id`` is the piece's local number plus the number of
run starts in all earlier chunks of that (player, game) (a prefix sum over
one row per chunk), and pieces of one run are merged by a second, small
aggregation.  Everything after the window works on pieces (about one row per
run), so when the pieces are stored once (``EffortModel(materialized=True)``)
the frames are scanned and shuffled once for all run tables of a
definition: the absolute runs and the absolute run counts share one set of
pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideflow.operators.frames import CHUNK_KEYS, absolute_frames, drop_ball, with_chunks
from strideflow.params import PROD, EffortParams

RUN_COLUMNS = [
    "player_id",
    "game_id",
    "period_id",
    "run_id",
    "start_frame_id",
    "end_frame_id",
    "duration_sec",
    "peak_speed_kmh",
    "mean_speed_kmh",
    "vmax_kmh",
    "pct_of_vmax",
    "distance_m",
    "start_x",
    "start_y",
    "end_x",
    "end_y",
]


PIECE_KEYS = ["player_id", "game_id", "period_id", "_chunk", "_local"]


def piece_measures() -> list[Column]:
    """Partial aggregates of the frames of a run."""
    return [
        F.min("frame_id").alias("start_frame_id"),
        F.max("frame_id").alias("end_frame_id"),
        F.count(F.lit(1)).alias("n_frames"),
        F.max("speed_kmh").alias("peak_speed_kmh"),
        F.sum(F.col("speed_kmh").cast("double")).alias("speed_sum"),
        F.max("vmax_kmh").alias("vmax_kmh"),
        F.min_by("x", "frame_id").alias("start_x"),
        F.min_by("y", "frame_id").alias("start_y"),
        F.max_by("x", "frame_id").alias("end_x"),
        F.max_by("y", "frame_id").alias("end_y"),
    ]


def run_pieces(flagged: DataFrame, chunk_frames: int) -> DataFrame:
    """Partial run aggregates per (player, game, period, chunk, chunk-local
    run number ``_local``); ``_local`` = 0 marks frames that continue a run
    begun in an earlier chunk.  The grouping keys contain the partitioning
    key ``_part`` of ``with_chunks``, so no shuffle is planned between the
    window and this aggregate."""
    chunked = with_chunks(flagged, chunk_frames)
    w = Window.partitionBy(*CHUNK_KEYS).orderBy("frame_id", F.col("_carry").desc(), "timestamp")
    prev = F.lag("frame_id").over(w)
    start = (~F.col("_carry")) & (prev.isNull() | ((F.col("frame_id") - prev) > 1))
    local = (
        chunked.withColumn("_start", start.cast("long"))
        .withColumn("_local", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .filter(~F.col("_carry"))
    )
    return local.groupBy("_part", *PIECE_KEYS).agg(*piece_measures()).drop("_part")


def merge_pieces(pieces: DataFrame, by_period: bool) -> DataFrame:
    """Global ``run_id`` for every piece and one row per run (per period
    when ``by_period``), before the minimum-duration gate."""
    per_chunk = pieces.groupBy("player_id", "game_id", "_chunk").agg(F.max("_local").alias("_starts"))
    wc = Window.partitionBy("player_id", "game_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select(
        "player_id", "game_id", "_chunk", F.coalesce(F.sum("_starts").over(wc), F.lit(0)).alias("_offset")
    )
    ided = pieces.join(offsets, ["player_id", "game_id", "_chunk"]).withColumn(
        "run_id", (F.col("_offset") + F.col("_local")).cast("long")
    )
    keys = ["player_id", "game_id"] + (["period_id"] if by_period else []) + ["run_id"]
    return ided.groupBy(*keys).agg(
        F.min("start_frame_id").alias("start_frame_id"),
        F.max("end_frame_id").alias("end_frame_id"),
        F.sum("n_frames").alias("n_frames"),
        F.max("peak_speed_kmh").alias("peak_speed_kmh"),
        (F.sum("speed_sum") / F.sum("n_frames")).alias("mean_speed_kmh"),
        F.max("vmax_kmh").alias("vmax_kmh"),
        F.min_by("start_x", "start_frame_id").alias("start_x"),
        F.min_by("start_y", "start_frame_id").alias("start_y"),
        F.max_by("end_x", "end_frame_id").alias("end_x"),
        F.max_by("end_y", "end_frame_id").alias("end_y"),
    )


def _finish(runs: DataFrame, params: EffortParams, relative: bool) -> DataFrame:
    n = F.col("n_frames")
    gated = runs.filter(n >= params.min_run_frames)
    pct = (F.col("peak_speed_kmh").cast("double") / F.col("vmax_kmh")) if relative else F.lit(None)
    return gated.select(
        "player_id",
        "game_id",
        F.col("period_id").cast("int").alias("period_id"),
        "run_id",
        "start_frame_id",
        "end_frame_id",
        (n / F.lit(params.frame_rate_hz)).cast("float").alias("duration_sec"),
        F.col("peak_speed_kmh").cast("float").alias("peak_speed_kmh"),
        F.col("mean_speed_kmh").cast("float").alias("mean_speed_kmh"),
        (F.col("vmax_kmh") if relative else F.lit(None)).cast("float").alias("vmax_kmh"),
        pct.cast("float").alias("pct_of_vmax"),
        (F.col("mean_speed_kmh") * n / F.lit(params.frame_rate_hz) / F.lit(params.kmh_per_ms))
        .cast("float")
        .alias("distance_m"),
        F.col("start_x").cast("float").alias("start_x"),
        F.col("start_y").cast("float").alias("start_y"),
        F.col("end_x").cast("float").alias("end_x"),
        F.col("end_y").cast("float").alias("end_y"),
    )


def _flagged_projection(df: DataFrame, with_vmax: bool, *more: str) -> DataFrame:
    return df.select(
        "player_id",
        "game_id",
        "period_id",
        "frame_id",
        "timestamp",
        "speed_kmh",
        (F.col("vmax_kmh") if with_vmax else F.lit(None).cast("double")).alias("vmax_kmh"),
        "x",
        "y",
        *more,
    )


def effort_run_pieces(tagged: DataFrame, params: EffortParams = PROD) -> DataFrame:
    """Run pieces of relative-effort frames (``is_effort_frame``)."""
    flagged = _flagged_projection(drop_ball(tagged).filter(F.col("is_effort_frame")), True)
    return run_pieces(flagged, params.chunk_frames)


def absolute_run_pieces(speeds: DataFrame, params: EffortParams = PROD) -> DataFrame:
    """Run pieces of frames at or above the flat km/h limit."""
    return run_pieces(_flagged_projection(absolute_frames(speeds, params), False), params.chunk_frames)


DEFINITIONS = ("relative", "absolute")


def both_run_pieces(tagged: DataFrame, params: EffortParams = PROD) -> DataFrame:
    """Run pieces of both definitions from one scan: each frame goes to the
    definitions it meets, and ``definition`` takes part in the key."""
    fast = F.col("speed_kmh").cast("double") >= F.lit(float(params.absolute_kmh))
    meets = F.array(F.when(F.col("is_effort_frame"), F.lit("relative")), F.when(fast, F.lit("absolute")))
    frames = drop_ball(tagged).filter(F.col("speed_kmh").isNotNull()).withColumn("definition", F.explode(F.array_compact(meets)))
    vmax = F.when(F.col("definition") == "relative", F.col("vmax_kmh"))
    keyed = _flagged_projection(frames.withColumns({"vmax_kmh": vmax, "player_id": F.concat_ws("|", "definition", "player_id")}), True)
    split = F.split("player_id", r"\|", 2)
    return run_pieces(keyed, params.chunk_frames).withColumns({"definition": split[0], "player_id": split[1]})


def pieces_of(pieces: DataFrame, definition: str) -> DataFrame:
    """One definition's part of ``both_run_pieces``."""
    return pieces.filter(F.col("definition") == definition).drop("definition")


def runs_from_pieces(pieces: DataFrame, params: EffortParams = PROD, relative: bool = True) -> DataFrame:
    """R1/R2 rows (16 columns) from run pieces, gated on minimum duration."""
    return _finish(merge_pieces(pieces, by_period=True), params, relative=relative)


def run_counts_from_pieces(pieces: DataFrame, params: EffortParams = PROD) -> DataFrame:
    """R3 from run pieces: per player, runs grouped by (player, game, run)
    without the period split, and distinct games."""
    runs = merge_pieces(pieces, by_period=False)
    return (
        runs.filter(F.col("n_frames") >= params.min_run_frames)
        .groupBy("player_id")
        .agg(
            F.count(F.lit(1)).alias("runs_absolute"),
            F.count_distinct("game_id").alias("n_games_absolute"),
        )
    )


def run_counts_by_game(pieces: DataFrame, params: EffortParams = PROD) -> DataFrame:
    """Runs per (player, game) without the period split: R3's state, which
    sums over games."""
    runs = merge_pieces(pieces, by_period=False).filter(F.col("n_frames") >= params.min_run_frames)
    return runs.groupBy("player_id", "game_id").agg(F.count(F.lit(1)).alias("runs_absolute"))


def run_counts_from_games(by_game: DataFrame) -> DataFrame:
    """R3 from ``run_counts_by_game``."""
    return by_game.groupBy("player_id").agg(F.sum("runs_absolute").alias("runs_absolute"), F.count(F.lit(1)).alias("n_games_absolute"))


def extract_effort_runs(tagged: DataFrame, params: EffortParams = PROD) -> DataFrame:
    """Runs of relative-effort frames (``is_effort_frame``)."""
    return runs_from_pieces(effort_run_pieces(tagged, params), params, relative=True)


def extract_absolute_runs(speeds: DataFrame, params: EffortParams = PROD) -> DataFrame:
    """R2: runs above the flat km/h limit; ``pct_of_vmax``/``vmax_kmh`` null."""
    return runs_from_pieces(absolute_run_pieces(speeds, params), params, relative=False)


def absolute_run_counts(speeds: DataFrame, params: EffortParams = PROD) -> DataFrame:
    """Per player, absolute runs and distinct games, runs grouped by
    (player, game, run) without the period split (gold notebook form)."""
    return run_counts_from_pieces(absolute_run_pieces(speeds, params), params)
