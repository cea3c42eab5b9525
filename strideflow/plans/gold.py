"""Gold analysis queries Q1-Q8: choices of keys, measures and order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideflow.functions.numeric import rnd
from strideflow.functions.zones import third_left_closed
from strideflow.operators.profiles import GOLD_DIGITS, PLAYERS, RUNS, STRICT, profile, team_comparison


def by_position(summary: DataFrame) -> DataFrame:
    """Q1 (null position kept as its own group), highest rate first."""
    out = profile(summary, ["position"], PLAYERS, "players rate metres_per_game effort_pct vmax_kmh limit_kmh", GOLD_DIGITS)
    return out.orderBy(F.desc("rate"), "position")


def by_team(summary: DataFrame) -> DataFrame:
    """Q2, highest rate first."""
    out = profile(summary, ["team_name", "team_short"], PLAYERS, "players runs rate metres_per_game peak_kmh vmax_kmh", GOLD_DIGITS)
    return out.orderBy(F.desc("rate"), "team_name")


def team_outperformance(comparison: DataFrame) -> DataFrame:
    """Q3: share of extra runs under the relative definition per team, largest
    first; null when the team has no absolute runs (no division by zero)."""
    return team_comparison(comparison, STRICT, "players").orderBy(F.desc_nulls_last("change_pct"), "team_name")


#: who a player is, in lists of players
_WHO = ("player_id", "player_name", "team_name", "position")


def top_by_rate(summary: DataFrame, n: int = 20) -> DataFrame:
    """Q4: top players by runs per game (player_id breaks ties): who they
    are, how fast, how often and how far."""
    speed, work = ("vmax_kmh", "limit_kmh", "peak_kmh"), ("games", "runs", "rate", "metres_per_game", "effort_pct")
    return summary.select(*_WHO, "jersey_number", *speed, *work).orderBy(F.desc("rate"), "player_id").limit(n)


def most_affected(comparison: DataFrame, n: int = 30) -> DataFrame:
    """Q5: players whose count changes most between definitions: who they
    are, their limit, both counts and the change."""
    change = ("runs_absolute", "runs_relative", "delta", "change_pct", "category")
    return comparison.select(*_WHO, "vmax_kmh", "limit_kmh", *change).orderBy(F.abs("delta").desc(), "player_id").limit(n)


def pitch_thirds_by_position(runs_enriched: DataFrame) -> DataFrame:
    """Q6: left-closed thirds of the run start (null x -> attacking)."""
    keys = [third_left_closed("start_x").alias("pitch_zone"), F.col("position")]
    out = profile(runs_enriched, keys, RUNS, "runs seconds_per_run metres_per_run peak_per_run effort_pct", GOLD_DIGITS)
    return out.orderBy("pitch_zone", F.desc("runs"), "position")


def fastest_players(vmax: DataFrame, n: int = 20) -> DataFrame:
    """Q7: trusted players with the highest v-max."""
    shown = {"vmax_kmh": rnd("vmax_kmh", 6), "speed_threshold_kmh": rnd("speed_threshold_kmh", 2)}
    return vmax.filter(~F.col("low_confidence")).withColumns(shown).drop("low_confidence").orderBy(F.desc("vmax_kmh"), "player_id").limit(n)


def fewest_absolute(absolute_counts: DataFrame, n: int = 10) -> DataFrame:
    """Q8: players with the fewest absolute runs."""
    return absolute_counts.orderBy("runs_absolute", "player_id").limit(n)
