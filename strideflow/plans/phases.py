"""Tournament phases (T1-T4): runs by round and week.

Group Stage / Knockout comes from the match table's ``Round``; runs are
joined to it on ``game_id`` compared as strings.  T1/T3 apply threshold,
team and position filters and divide by the number of games in the
metadata; T2 applies the threshold only and divides by games with runs.
Rates have one decimal place by round and week, two by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideflow.operators.profiles import GOLD_DIGITS, RUNS, having, profile, rate
from strideflow.params import FilterSpec
from strideflow.plans.explore import DEFAULT, _in

_DIGITS = {"effort_pct": GOLD_DIGITS["effort_pct"]}


def games_per_round(matches: DataFrame) -> DataFrame:
    """T4."""
    return having(matches, "Round").groupBy("Round").agg(F.count(F.lit(1)).alias("games"))


def _dated(runs: DataFrame, matches: DataFrame, spec: FilterSpec) -> DataFrame:
    """Runs at the threshold, with the week and round of their game in the
    metadata (which win over columns of the same name)."""
    when = matches.select(F.col("game_id").cast("string").alias("_game"), "week", "Round")
    quick = runs.filter(F.col("pct_of_vmax") >= F.lit(spec.threshold_pct)).drop("week", "Round")
    return quick.join(when, quick["game_id"].cast("string") == when["_game"], "left")


def _by_round(runs: DataFrame, matches: DataFrame, spec: FilterSpec, keys: list[str], measures: str, digits: int) -> DataFrame:
    """Profile of the filtered runs by round and further keys, per game of the
    round."""
    kept = _dated(runs, matches, spec).filter(_in("team_short", spec.teams) & F.col("pos").isin(list(spec.positions)))
    out = profile(having(kept, "Round"), ["Round", *keys], RUNS, measures, _DIGITS)
    return out.join(games_per_round(matches), "Round", "left").withColumn("rate", rate("runs", "games", digits))


def round_summary(runs: DataFrame, matches: DataFrame, spec: FilterSpec = DEFAULT) -> DataFrame:
    """T1."""
    return _by_round(runs, matches, spec, [], "runs seconds_per_run metres_per_run peak_per_run effort_pct", 1)


def week_trend(runs: DataFrame, matches: DataFrame, spec: FilterSpec = DEFAULT) -> DataFrame:
    """Week and Round from the metadata side of the join."""
    out = profile(having(_dated(runs, matches, spec), "week", "Round"), ["week", "Round"], RUNS, "runs games peak_per_run effort_pct", _DIGITS)
    return out.withColumn("rate", rate("runs", "games", 1)).orderBy("week")


def position_by_round(runs: DataFrame, matches: DataFrame, spec: FilterSpec = DEFAULT) -> DataFrame:
    """T3."""
    return _by_round(runs, matches, spec, ["pos"], "runs", 2)
