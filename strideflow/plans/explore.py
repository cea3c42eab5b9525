"""Dashboard computations (P4-P13, D1-D25) as DataFrame functions.

Inputs are the exported gold tables with position columns: ``summary``
(G2 + pos), ``comparison`` (G4 + pos), ``runs`` (enriched relative runs +
pos), ``matches`` (metadata with ``Round``) and ``absolute`` (R3 counts).
Per-player and per-match views are computed for all players / matches at
once, keyed by ``player_id`` / ``game_id``; a single view is a filter away.

The slider threshold filters the *stored* runs by their peak share of v-max
(``pct_of_vmax >= t``); it does not re-extract runs.  Rounding uses Spark's
half-away-from-zero ``round``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideflow.functions.numeric import rnd
from strideflow.functions.zones import (
    THIRD_NAMES,
    ZONE9_ROW_NAMES,
    ZONE30_CHANNEL_NAMES,
    ZONE30_THIRD_NAMES,
    third_right_closed,
    zone9_col,
    zone9_row,
    zone30_col,
    zone30_row,
)
from strideflow.operators.profiles import FLOORED, PLAYERS, RUNS, category, compare, having, profile, rate, team_comparison
from strideflow.params import SWEEP_THRESHOLDS, FilterSpec

DEFAULT = FilterSpec()


def _in(col: str, values) -> Column:
    """Membership; ``None`` = every non-null value (the all-teams default)."""
    return F.col(col).isNotNull() if values is None else F.col(col).isin(list(values))


def _scalar(agg: DataFrame) -> Column:
    """A one-row, one-column global aggregate used as a value: Spark runs it
    once as a scalar subquery and inlines the result, so the big side is
    neither joined nor moved onto a single key."""
    return agg.scalar()


# ---------------------------------------------------------------------------
# P4 / D1 / D2 / D3 / P5 / P6
# ---------------------------------------------------------------------------


def qualifying_runs(runs: DataFrame, spec: FilterSpec = DEFAULT) -> DataFrame:
    """Stored runs whose peak share of v-max reaches the threshold."""
    q = runs.filter(F.col("pct_of_vmax") >= F.lit(spec.threshold_pct))
    if spec.game_id is not None:
        q = q.filter(F.col("game_id").cast("string") == F.lit(str(spec.game_id)))
    return q


def dynamic_counts(qualifying: DataFrame, measures=RUNS) -> DataFrame:
    """Per-player recount at the slider threshold; ``*_now`` columns.
    Here and below ``measures`` says what the rows are: runs, or cells."""
    own = profile(qualifying, ["player_id"], measures, "runs games metres seconds_per_run peak_per_run effort_pct", {"effort_pct": 1})
    rated = own.withColumn("rate", rate("runs", "games", 2))
    return rated.select("player_id", *[F.col(c).alias(f"{c}_now") for c in rated.columns if c != "player_id"])


def summary_dynamic(summary: DataFrame, dyn: DataFrame, spec: FilterSpec = DEFAULT) -> DataFrame:
    """Summary + D1; nulls -> 0 for total runs, runs/game and mean peak."""
    full = summary.join(dyn, "player_id", "left").fillna(0, subset=["runs_now", "rate_now", "peak_per_run_now"])
    return full.withColumn("threshold_at_pct", F.col("vmax_kmh") * F.lit(spec.threshold_pct))


def threshold_columns(comparison: DataFrame, spec: FilterSpec = DEFAULT, absolute_kmh: float = 20.0) -> DataFrame:
    """Threshold at t, above/below the flat limit, break-even v-max."""
    t = F.col("vmax_kmh") * F.lit(spec.threshold_pct)
    return (
        comparison.withColumn("threshold_at_pct", t)
        .withColumn("above_absolute", t <= F.lit(absolute_kmh))
        .withColumn("new_threshold_vs_20", t - F.lit(absolute_kmh))
        .withColumn("breakeven_vmax_kmh", F.lit(absolute_kmh / spec.threshold_pct))
    )


def comparison_dynamic(
    comparison: DataFrame, absolute: DataFrame, qualifying: DataFrame, spec: FilterSpec = DEFAULT
) -> DataFrame:
    """D3: static absolute counts vs relative recount; % change over
    ``max(abs, 1)`` (the dashboard formula, unlike G4's null)."""
    now = profile(qualifying, ["player_id"], RUNS, "runs").withColumnRenamed("runs", "runs_relative_now")
    flat = absolute.select("player_id", F.col("runs_absolute").alias("runs_absolute_now"))
    rows = threshold_columns(comparison, spec).join(now, "player_id", "left").join(flat, "player_id", "left")
    return compare(rows, "runs_relative_now", "runs_absolute_now", FLOORED)


def filtered_summary(sdyn: DataFrame, spec: FilterSpec = DEFAULT) -> DataFrame:
    """P5: sidebar filters on the merged summary."""
    return sdyn.filter(
        _in("team_short", spec.teams)
        & F.col("pos").isin(list(spec.positions))
        & (F.col("games") >= spec.min_games)
        & ~F.col("low_confidence")
    ).withColumn("threshold_at_pct", F.col("vmax_kmh") * F.lit(spec.threshold_pct))


def filtered_comparison(cdyn: DataFrame, spec: FilterSpec = DEFAULT) -> DataFrame:
    """P6."""
    return cdyn.filter(
        _in("team_short", spec.teams) & F.col("pos").isin(list(spec.positions)) & (F.col("games") >= spec.min_games)
    )


def team_options(summary: DataFrame) -> DataFrame:
    """Sorted distinct non-null team codes."""
    return summary.select("team_short").dropna().distinct().orderBy("team_short")


def match_labels(matches: DataFrame) -> DataFrame:
    """P10: ``HOME vs AWAY  ·  W{week}  (RO)`` ordered by date."""
    label = F.concat(
        F.col("home_team_short"),
        F.lit(" vs "),
        F.coalesce(F.col("away_team_short"), F.lit("-")),
        F.lit("  ·  W"),
        F.col("week").cast("string"),
        F.lit("  ("),
        F.upper(F.substring("Round", 1, 2)),
        F.lit(")"),
    )
    return matches.select("game_id", "date", label.alias("label")).orderBy("date", "game_id")


# ---------------------------------------------------------------------------
# D4 - D15
# ---------------------------------------------------------------------------


def kpis(fs: DataFrame) -> DataFrame:
    """One KPI row over the filtered summary."""
    n = F.count(F.lit(1))
    below = F.count_if(F.col("threshold_at_pct") < 20.0)
    return fs.agg(
        n.alias("n_players"),
        F.avg("vmax_kmh").alias("avg_vmax"),
        F.avg("rate_now").alias("avg_runs"),
        F.max("peak_kmh").alias("top_speed"),
        below.alias("n_below_20"),
        F.when(n > 0, below / n * 100).otherwise(F.lit(0.0)).alias("pct_below"),
    )


def top_players(fs: DataFrame, n: int = 20) -> DataFrame:
    """Top N by dynamic runs per game (player_id breaks ties)."""
    return fs.select(
        "player_id", "player_name", "team_short", "pos", "rate_now", "vmax_kmh", "games"
    ).orderBy(F.col("rate_now").desc(), "player_id").limit(n)


def _dense_zone_grid(keys: DataFrame, n_zones: int) -> DataFrame:
    """Every key expanded to ``n_zones`` zone ids (fixed-size explode)."""
    return keys.withColumn("zone", F.explode(F.sequence(F.lit(0), F.lit(n_zones - 1))))


def zone30_player(qualifying: DataFrame) -> DataFrame:
    """6x5 grid per player: count, peak-speed sum, share, intensity."""
    placed = qualifying.withColumn("zone", zone30_row("start_y") * 6 + zone30_col("start_x"))
    return zone30_grid(placed, F.count(F.lit(1)), F.sum("peak_speed_kmh"))


def zone30_grid(placed: DataFrame, runs: Column, peaks: Column) -> DataFrame:
    """The dense grid of rows with a ``zone``."""
    counts = placed.groupBy("player_id", "zone").agg(runs.alias("n_runs"), peaks.alias("speed_sum"))
    keys = placed.select("player_id", "player_name").distinct()
    grid = _dense_zone_grid(keys, 30).join(counts, ["player_id", "zone"], "left")
    grid = grid.fillna(0, subset=["n_runs"]).fillna(0.0, subset=["speed_sum"])
    w = Window.partitionBy("player_id")
    total, mx = F.sum("n_runs").over(w), F.max("n_runs").over(w)
    return grid.select(
        "player_id",
        "player_name",
        "zone",
        (F.col("zone") / 6).cast("int").alias("row"),
        (F.col("zone") % 6).alias("col"),
        "n_runs",
        rnd("speed_sum", 4).alias("speed_sum"),
        F.when(total > 0, F.col("n_runs") / total * 100).otherwise(F.lit(0.0)).alias("pct"),
        (F.col("n_runs") / F.when(mx > 0, mx).otherwise(F.lit(1))).alias("intensity"),
    )


def zone30_top3(z30: DataFrame) -> DataFrame:
    """The three busiest non-empty zones per player with names."""
    w = Window.partitionBy("player_id").orderBy(F.col("n_runs").desc(), "row", "col")
    ch = F.create_map(*[x for i, nm in enumerate(ZONE30_CHANNEL_NAMES) for x in (F.lit(i), F.lit(nm))])
    th = F.create_map(*[x for i, nm in enumerate(ZONE30_THIRD_NAMES) for x in (F.lit(i), F.lit(nm))])
    return (
        z30.filter(F.col("n_runs") > 0)
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= 3)
        .select(
            "player_id",
            "player_name",
            "rank",
            "row",
            "col",
            "n_runs",
            "pct",
            ch[F.col("row")].alias("channel"),
            th[F.col("col")].alias("third"),
        )
    )


#: how columns are shown to a reader: decimal places, and the largest value
DIGITS = {"vmax_kmh": 1, "threshold_at_pct": 1, "metres_per_game": 0, "peak_per_run_now": 1, "peak_kmh": 1}
CAPS = {"effort_pct": 100.0}


def shown(df: DataFrame, columns: str, digits=DIGITS, caps=CAPS) -> DataFrame:
    """The named columns, rounded and capped for display."""

    def cell(name: str) -> Column:
        value = F.least(F.col(name), F.lit(caps[name])) if name in caps else F.col(name)
        return (rnd(value, digits[name]) if name in digits else value).alias(name)

    return df.select(*[cell(c) for c in columns.split()])


def player_table(fs: DataFrame) -> DataFrame:
    """The players' display table, highest rate first."""
    who, speed = "player_id player_name team_name pos pos_detail games", "vmax_kmh threshold_at_pct peak_kmh"
    out = shown(fs, f"{who} {speed} runs_now rate_now metres_per_game peak_per_run_now effort_pct")
    return out.orderBy(F.col("rate_now").desc(), "player_id")


def team_profile(fs: DataFrame) -> DataFrame:
    """Team aggregates (null team keys dropped, as pandas does)."""
    return profile(having(fs, "team_name", "team_short"), ["team_name", "team_short"], PLAYERS, "named_players runs_now rate_now metres_per_game effort_pct peak_kmh vmax_kmh")


def team_distance_top(tp: DataFrame, n: int = 16) -> DataFrame:
    """Teams with the most effort-run distance per game."""
    return tp.orderBy(F.desc("metres_per_game"), "team_name").limit(n)


def position_profile(fs: DataFrame) -> DataFrame:
    """Position-group aggregates."""
    keys = [F.col("pos").alias("position")]
    return profile(having(fs, "pos"), keys, PLAYERS, "named_players rate_now metres_per_game effort_pct peak_kmh vmax_kmh limit_kmh")


RADAR_METRICS = ("rate_now", "vmax_kmh", "metres_per_game", "effort_pct", "peak_kmh")


def position_radar(pp: DataFrame) -> DataFrame:
    """Min-max normalised metrics per group, long form.  The window
    runs over the handful of position groups only."""
    long = pp.select(
        "position",
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in RADAR_METRICS])
        ).alias("m"),
    ).select("position", "m.metric", "m.v")
    w = Window.partitionBy("metric")
    norm = (F.col("v") - F.min("v").over(w)) / (F.max("v").over(w) - F.min("v").over(w) + F.lit(1e-9))
    return long.select("position", "metric", rnd(norm * 100, 1).alias("value"))


def run_delta_histogram(fc: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width histogram of delta over [min, max] by category.
    The global bounds are scalar subqueries (computed once, no join)."""
    bounds = _scalar(fc.agg(F.struct(F.min("delta").alias("lo"), F.max("delta").alias("hi"))))
    with_b = fc.withColumn("_bounds", bounds)
    lo, hi = F.col("_bounds.lo"), F.col("_bounds.hi")
    width = F.when(hi > lo, (hi - lo) / F.lit(float(bins))).otherwise(F.lit(1.0))
    b = F.least(F.floor((F.col("delta") - lo) / width), F.lit(bins - 1)).cast("int")
    return (
        with_b.withColumn("bin", b)
        .groupBy("category", "bin")
        .agg(F.count(F.lit(1)).alias("n_players"), F.min(lo + F.col("bin") * width).alias("bin_start"))
        .withColumn("bin_start", rnd("bin_start", 6))
    )


def team_outperformance_dynamic(fc: DataFrame) -> DataFrame:
    """Static totals with the dynamic delta; denominator max(abs, 1)."""
    return team_comparison(having(fc, "team_name", "team_short"), FLOORED, "named_players")


def most_affected_dynamic(fc: DataFrame) -> DataFrame:
    """Largest change first, at full precision."""
    who, counts = "player_id player_name team_short pos pos_detail", "runs_absolute_now runs_relative_now delta change_pct category"
    return shown(fc, f"{who} vmax_kmh threshold_at_pct {counts}", {}, {}).orderBy(F.abs("delta").desc(), "player_id")


# ---------------------------------------------------------------------------
# D16 - D18 pitch zones
# ---------------------------------------------------------------------------


def pitch_thirds(runs: DataFrame) -> DataFrame:
    """Right-closed thirds over all stored runs; outside -> dropped."""
    return thirds(runs.withColumn("pitch_zone", third_right_closed("start_x")), RUNS)


def thirds(placed: DataFrame, measures) -> DataFrame:
    return profile(having(placed, "pitch_zone"), ["pitch_zone"], measures, "runs seconds_per_run metres_per_run peak_per_run effort_pct")


def pitch_thirds_by_group(runs: DataFrame) -> DataFrame:
    """D17."""
    z = runs.withColumn("pitch_zone", third_right_closed("start_x"))
    return (
        z.filter(F.col("pitch_zone").isNotNull() & F.col("pos").isNotNull())
        .groupBy("pitch_zone", "pos")
        .agg(F.count(F.lit(1)).alias("n_runs"))
    )


def pitch_runs_fallback(qualifying: DataFrame, spec: FilterSpec = DEFAULT) -> DataFrame:
    """team/position filter; if nothing survives, all qualifying runs.
    The "anything kept?" flag is a scalar subquery (computed once)."""
    keep = _in("team_short", spec.teams) & F.col("pos").isin(list(spec.positions))
    q = qualifying.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    any_kept = _scalar(q.agg(F.max(F.col("_keep").cast("int"))))
    return q.filter(F.col("_keep") | (F.coalesce(any_kept, F.lit(0)) == 0)).drop("_keep")


def _zone9(runs: DataFrame, keys: list[str]) -> DataFrame:
    placed = runs.withColumn("zone", zone9_row("start_y") * 3 + zone9_col("start_x"))
    return zone9_grid(placed, keys, F.count(F.lit(1)), F.sum("peak_speed_kmh"))


def zone9_grid(placed: DataFrame, keys: list[str], runs: Column, peaks: Column) -> DataFrame:
    """The dense 3x3 grid of rows with a ``zone``, for each key."""
    counts = placed.groupBy(*keys, "zone").agg(runs.alias("n_runs"), peaks.alias("_ss"))
    base = placed.select(*keys).distinct() if keys else placed.sparkSession.range(1).select(F.lit(0).alias("_all"))
    grid = _dense_zone_grid(base, 9).join(counts, [*keys, "zone"], "left").fillna(0, subset=["n_runs"])
    w = Window.partitionBy(*keys) if keys else Window.partitionBy()
    total, mx = F.sum("n_runs").over(w), F.max("n_runs").over(w)
    rows = F.create_map(*[x for i, nm in enumerate(ZONE9_ROW_NAMES) for x in (F.lit(i), F.lit(nm))])
    cols = F.create_map(*[x for i, nm in enumerate(THIRD_NAMES) for x in (F.lit(i), F.lit(nm))])
    r, c = (F.col("zone") / 3).cast("int"), F.col("zone") % 3
    return grid.select(
        *keys,
        "zone",
        rows[r].alias("channel"),
        cols[c].alias("third"),
        "n_runs",
        F.when(total > 0, F.col("n_runs") / total * 100).otherwise(F.lit(0.0)).alias("pct"),
        F.when(F.col("n_runs") > 0, F.col("_ss") / F.col("n_runs")).otherwise(F.lit(0.0)).alias("avg_peak_speed"),
        (F.col("n_runs") / F.when(mx > 0, mx).otherwise(F.lit(1))).alias("intensity"),
    )


def zone9_heatmap(pitch_runs: DataFrame) -> DataFrame:
    """3x3 grid over all (filtered) runs; nine rows always.  The grid
    total/max window spans exactly nine rows."""
    return _zone9(pitch_runs, [])


# ---------------------------------------------------------------------------
# D19 - D24 match views (all matches at once)
# ---------------------------------------------------------------------------


def match_runs(runs: DataFrame, spec: FilterSpec = DEFAULT) -> DataFrame:
    """Qualifying runs of every match.  The dashboard's fallback (the
    game's stored runs at the same threshold) selects the same rows when no
    sidebar game filter is set, so one filter serves both branches."""
    return runs.filter(F.col("pct_of_vmax") >= F.lit(spec.threshold_pct))


def match_top_performers(mr: DataFrame, measures=RUNS) -> DataFrame:
    """Per match, all performers ranked by runs (player_id breaks ties).
    A match's ranks take one task: its players are a bounded list."""
    who = ["game_id", "player_id", "player_name", "team_short", "pos"]
    digits = {"metres": 0, "peak_kmh": 1, "peak_per_run": 1, "effort_pct": 1}
    out = profile(having(mr, *who), who, measures, "runs metres peak_kmh peak_per_run effort_pct", digits)
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("game_id").orderBy(F.desc("runs"), "player_id")))


def match_team_comparison(mr: DataFrame, measures=RUNS) -> DataFrame:
    """D21."""
    return profile(having(mr, "team_short"), ["game_id", "team_short"], measures, "runs players metres peak_kmh peak_per_run effort_pct", {"effort_pct": 1})


def match_position(mr: DataFrame, measures=RUNS) -> DataFrame:
    """D22."""
    return profile(having(mr, "pos"), ["game_id", "pos"], measures, "runs peak_per_run effort_pct", {"effort_pct": 1})


def match_zone9(mr: DataFrame) -> DataFrame:
    """The 9-zone grid per match (nine rows per match with runs)."""
    return _zone9(mr, ["game_id"])


def match_header(matches: DataFrame) -> DataFrame:
    """D24."""
    days = matches.withColumn("date", F.substring("date", 1, 10))
    return shown(days, "game_id home_team_name away_team_name date stadium_name Round week")


# ---------------------------------------------------------------------------
# D25 threshold sweep
# ---------------------------------------------------------------------------


def threshold_sweep(
    runs: DataFrame, comparison: DataFrame, absolute: DataFrame, thresholds=SWEEP_THRESHOLDS
) -> DataFrame:
    """D1 + D3 for every slider position in one scan of the runs: each run
    is expanded only into the thresholds it qualifies for (at most 8)."""
    ts = F.array(*[F.lit(float(t)) for t in thresholds])
    per_run = runs.select(
        "player_id",
        "game_id",
        F.explode(F.filter(ts, lambda t: F.col("pct_of_vmax") >= t)).alias("threshold_pct"),
    )
    rel = per_run.groupBy("threshold_pct", "player_id").agg(
        F.count(F.lit(1)).alias("runs_now"), F.count_distinct("game_id").alias("games_now")
    )
    players = comparison.select("player_id").withColumn("threshold_pct", F.explode(ts))
    ab = absolute.select("player_id", F.col("runs_absolute").alias("runs_absolute_now"))
    out = (
        players.join(rel, ["threshold_pct", "player_id"], "left")
        .join(ab, "player_id", "left")
        .fillna(0, subset=["runs_now", "games_now", "runs_absolute_now"])
        .withColumn("delta", F.col("runs_now") - F.col("runs_absolute_now"))
    )
    return out.select(
        "threshold_pct",
        "player_id",
        "runs_now",
        "games_now",
        rnd(F.col("runs_now") / F.greatest(F.col("games_now"), F.lit(1)), 2).alias(
            "rate_now"
        ),
        "runs_absolute_now",
        "delta",
        rnd(F.col("delta") / F.greatest(F.col("runs_absolute_now"), F.lit(1)) * 100, 1).alias("change_pct"),
        category().alias("category"),
    )
