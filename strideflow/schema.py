"""Explicit schemas for every table (no inference anywhere)."""

from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _s(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


TRACKING = _s(
    ("game_id", StringType()),
    ("frame_id", LongType()),
    ("period_id", IntegerType()),
    ("timestamp", LongType()),
    ("ball_state", StringType()),
    ("ball_owning_team_id", StringType()),
    ("team_id", StringType()),
    ("player_id", StringType()),
    ("x", FloatType()),
    ("y", FloatType()),
    ("z", FloatType()),
)

TRACKING_BRONZE = StructType(TRACKING.fields + [StructField("_ingested_at", StringType(), True)])

PLAYERS = _s(
    ("player_id", StringType()),
    ("name", StringType()),
    ("team_id", StringType()),
    ("jersey_number", IntegerType()),
    ("position", StringType()),
    ("is_starter", BooleanType()),
)

MATCHES = _s(
    ("game_id", StringType()),
    ("date", StringType()),
    ("season", StringType()),
    ("competition_id", StringType()),
    ("competition_name", StringType()),
    ("stadium_name", StringType()),
    ("home_team_id", StringType()),
    ("home_team_name", StringType()),
    ("home_team_short", StringType()),
    ("away_team_id", StringType()),
    ("away_team_name", StringType()),
    ("away_team_short", StringType()),
    ("pitch_length", DoubleType()),
    ("pitch_width", DoubleType()),
    ("fps", DoubleType()),
    ("week", IntegerType()),
)

# the app's match_metadata.csv: 9 exported columns + Round
MATCH_CSV = _s(
    ("game_id", StringType()),
    ("date", StringType()),
    ("home_team_name", StringType()),
    ("home_team_short", StringType()),
    ("away_team_name", StringType()),
    ("away_team_short", StringType()),
    ("stadium_name", StringType()),
    ("week", IntegerType()),
    ("competition_name", StringType()),
    ("Round", StringType()),
)

VMAX = _s(
    ("player_id", StringType()),
    ("vmax_kmh", DoubleType()),
    ("frame_count", LongType()),
    ("low_confidence", BooleanType()),
    ("speed_threshold_kmh", DoubleType()),
)

RUNS = _s(
    ("player_id", StringType()),
    ("game_id", StringType()),
    ("period_id", IntegerType()),
    ("run_id", LongType()),
    ("start_frame_id", LongType()),
    ("end_frame_id", LongType()),
    ("duration_sec", FloatType()),
    ("peak_speed_kmh", FloatType()),
    ("mean_speed_kmh", FloatType()),
    ("vmax_kmh", FloatType()),
    ("pct_of_vmax", FloatType()),
    ("distance_m", FloatType()),
    ("start_x", FloatType()),
    ("start_y", FloatType()),
    ("end_x", FloatType()),
    ("end_y", FloatType()),
)

ABSOLUTE_COUNTS = _s(
    ("player_id", StringType()),
    ("runs_absolute", LongType()),
    ("n_games_absolute", LongType()),
)
