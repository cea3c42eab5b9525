"""Profiles and comparisons, from declared measures.

A *measure* names one output column: a statistic of one input column, with
its scale.  ``profile`` aggregates rows by any keys into any list of
measures; ``compare`` sets run counts of the two definitions side by side
under a policy.  The tables of the library, the gold layer, the dashboard
and the phase views are choices of keys, measures and policy.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideflow.functions.numeric import rnd, safe_ratio

_STATISTICS = {
    "rows": lambda c: F.count(F.lit(1)),
    "filled": F.count,
    "distinct": F.count_distinct,
    "mean": F.avg,
    "total": F.sum,
    "largest": F.max,
}


@dataclass(frozen=True)
class Measure:
    name: str
    statistic: str = "rows"
    column: str | None = None
    scale: float = 1.0

    def aggregate(self, digits: int | None = None) -> Column:
        value = _STATISTICS[self.statistic](F.col(self.column) if self.column else None)
        if self.scale != 1.0:
            value = value * self.scale
        return (value if digits is None else rnd(value, digits)).alias(self.name)


@dataclass(frozen=True)
class Mean:
    """A mean from its states: a sum, and the number of values in it."""

    name: str
    total: str
    values: str
    scale: float = 1.0

    def aggregate(self, digits: int | None = None) -> Column:
        value = safe_ratio(F.sum(self.total), F.sum(self.values))
        if self.scale != 1.0:
            value = value * self.scale
        return (value if digits is None else rnd(value, digits)).alias(self.name)


def catalogue(*measures: Measure | Mean) -> dict[str, Measure | Mean]:
    return {m.name: m for m in measures}


#: over rows of runs
RUNS = catalogue(
    Measure("runs"),
    Measure("games", "distinct", "game_id"),
    Measure("players", "distinct", "player_id"),
    Measure("metres", "total", "distance_m"),
    Measure("metres_per_run", "mean", "distance_m"),
    Measure("seconds_per_run", "mean", "duration_sec"),
    Measure("share_per_run", "mean", "pct_of_vmax"),
    Measure("effort_pct", "mean", "pct_of_vmax", 100.0),
    Measure("peak_per_run", "mean", "peak_speed_kmh"),
    Measure("peak_kmh", "largest", "peak_speed_kmh"),
)

#: over rows of the player summary; ``*_now`` follow the dashboard's slider
PLAYERS = catalogue(
    Measure("players"),
    Measure("named_players", "filled", "player_name"),
    Measure("runs", "total", "runs"),
    Measure("runs_now", "total", "runs_now"),
    Measure("rate", "mean", "rate"),
    Measure("rate_now", "mean", "rate_now"),
    Measure("vmax_kmh", "mean", "vmax_kmh"),
    Measure("limit_kmh", "mean", "limit_kmh"),
    Measure("metres_per_game", "mean", "metres_per_game"),
    Measure("effort_pct", "mean", "effort_pct"),
    Measure("peak_kmh", "mean", "peak_kmh"),
)

#: decimal places of the gold tables
GOLD_DIGITS = {
    "rate": 2, "vmax_kmh": 2, "limit_kmh": 2, "peak_kmh": 2, "peak_per_run": 2, "seconds_per_run": 2,
    "metres": 1, "metres_per_run": 1, "metres_per_game": 1, "effort_pct": 1,
}


def profile(
    rows: DataFrame,
    keys: Iterable[str | Column],
    known: Mapping[str, Measure | Mean],
    measures: str,
    digits: Mapping[str, int] | None = None,
) -> DataFrame:
    """``rows`` grouped by ``keys`` (names or aliased columns) into the named
    measures of a catalogue.  A null key is a group of its own."""
    digits = digits or {}
    return rows.groupBy(*keys).agg(*[known[m].aggregate(digits.get(m)) for m in measures.split()])


def having(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of the columns is null."""
    return rows.dropna(how="any", subset=list(columns))


def rate(amount: str | Column, games: str | Column, digits: int | None = None) -> Column:
    """Amount per game; no games count as one."""
    value = (F.col(amount) if isinstance(amount, str) else amount) / F.greatest(F.col(games) if isinstance(games, str) else games, F.lit(1))
    return value if digits is None else rnd(value, digits)


def category(delta: str = "delta") -> Column:
    """gained / lost / unchanged by the sign of the change."""
    names = F.array(F.lit("lost"), F.lit("unchanged"), F.lit("gained"))
    return F.element_at(names, (F.signum(F.coalesce(F.col(delta), F.lit(0)).cast("double")) + 2).cast("int"))


@dataclass(frozen=True)
class Policy:
    """How a change is set against the flat definition's runs: without any,
    the change has no percentage (``None``) or counts against ``floor``."""

    floor: int | None = None

    def percent(self, delta: Column, base: Column) -> Column:
        against = safe_ratio(delta, base) if self.floor is None else delta / F.greatest(base, F.lit(self.floor))
        return rnd(against * 100, 1)


STRICT, FLOORED = Policy(), Policy(floor=1)


def compare(rows: DataFrame, relative: str, flat: str, policy: Policy) -> DataFrame:
    """``rows`` with delta, change_pct and category of two count columns;
    missing counts are zero."""
    full = rows.fillna(0, subset=[relative, flat])
    full = full.withColumn("delta", F.col(relative) - F.col(flat))
    return full.withColumn("change_pct", policy.percent(F.col("delta"), F.col(flat))).withColumn("category", category())


def team_comparison(rows: DataFrame, policy: Policy, players: str) -> DataFrame:
    """Counts of both definitions and of players by category, per team.  The
    percentage sets the teams' totals against each other; ``players`` names
    the measure that counts a team's players."""
    relative, flat = F.sum("runs_relative"), F.sum("runs_absolute")
    counted = {name: F.count_if(F.col("category") == name) for name in ("gained", "lost")}
    return rows.groupBy("team_name", "team_short").agg(
        relative.alias("runs_relative"),
        flat.alias("runs_absolute"),
        F.sum("delta").alias("delta"),
        policy.percent(relative - flat, flat).alias("change_pct"),
        *[c.alias(name) for name, c in counted.items()],
        PLAYERS[players].aggregate(),
    )
