"""A measure cube for the dashboard's filters.

Every slider, team, position or game choice asks for the same few measures of
the runs, so these are added up once.  A cell holds *states*: counts, sums and
maxima that merge by adding, and the keys that distinct counts need.  The
slider's thresholds are nested, so a run belongs to one *step*, the number of
thresholds that its peak reaches, and a threshold's view adds the cells of its
step and of those above.

One aggregation over grouping sets builds the cells of four grains:

* ``player``: step, game, player with team and position
* ``zone30``: step, player, cell of the 6 x 5 grid
* ``zone9``: step, game, team, position, cell of the 3 x 3 grid
* ``third``: step, third of the pitch

The views then read the cube only; no plan of theirs scans the runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideflow.functions.zones import third_right_closed, zone9_col, zone9_row, zone30_col, zone30_row
from strideflow.operators.profiles import Mean, Measure, catalogue
from strideflow.params import SWEEP_THRESHOLDS, FilterSpec
from strideflow.plans import explore as ex

_PLAYER = ["player_id", "player_name", "team_short", "pos"]
GRAINS = {
    "player": ["step", "game_id", *_PLAYER],
    "zone30": ["step", "player_id", "player_name", "zone30"],
    "zone9": ["step", "game_id", "team_short", "pos", "zone9"],
    "third": ["step", "pitch_zone"],
}
_SUMMED = {"distance_m": "metres", "duration_sec": "seconds", "pct_of_vmax": "share", "peak_speed_kmh": "peak"}

#: the measures of runs, from the states of cells
CELLS = catalogue(
    Measure("runs", "total", "n"),
    Measure("games", "distinct", "game_id"),
    Measure("players", "distinct", "player_id"),
    Measure("metres", "total", "metres"),
    Mean("metres_per_run", "metres", "n_metres"),
    Mean("seconds_per_run", "seconds", "n_seconds"),
    Mean("effort_pct", "share", "n_share", 100.0),
    Mean("peak_per_run", "peak", "n_peak"),
    Measure("peak_kmh", "largest", "peak_max"),
)


def build(runs: DataFrame, thresholds=SWEEP_THRESHOLDS) -> DataFrame:
    """The cube over enriched runs with position columns (``app_runs``)."""
    reached = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])
    step = F.coalesce(F.size(F.filter(reached, lambda t: F.col("pct_of_vmax") >= t)), F.lit(0))
    placed = runs.withColumns(
        {
            "step": F.when(F.col("pct_of_vmax").isNull(), 0).otherwise(step),
            "zone30": zone30_row("start_y") * 6 + zone30_col("start_x"),
            "zone9": zone9_row("start_y") * 3 + zone9_col("start_x"),
            "pitch_zone": third_right_closed("start_x"),
        }
    )
    keys = list(dict.fromkeys(k for grain in GRAINS.values() for k in grain))
    states = [F.count(F.lit(1)).alias("n"), F.max("peak_speed_kmh").alias("peak_max")]
    for column, name in _SUMMED.items():
        states += [F.sum(F.col(column).cast("double")).alias(name), F.count(column).alias(f"n_{name}")]
    cells = placed.groupingSets(list(GRAINS.values()), *keys).agg(F.grouping_id().alias("_set"), *states)
    # the bit of a key in grouping_id is set where the grain lacks it
    ids = {sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in grain): name for name, grain in GRAINS.items()}
    names = F.create_map(*[x for i, name in ids.items() for x in (F.lit(i).cast("long"), F.lit(name))])
    return cells.withColumn("grain", names[F.col("_set").cast("long")]).drop("_set")


def cells(cube: DataFrame, grain: str, spec: FilterSpec | None = ex.DEFAULT, thresholds=SWEEP_THRESHOLDS) -> DataFrame:
    """A grain's cells at the slider's threshold (``spec=None``: of all runs)."""
    found = cube.filter(F.col("grain") == grain)
    if spec is None:
        return found
    steps = sorted(thresholds)
    if spec.threshold_pct not in steps:
        raise ValueError(f"the cube has no step {spec.threshold_pct}: build it with this threshold")
    found = found.filter(F.col("step") > steps.index(spec.threshold_pct))
    if spec.game_id is not None:
        if "game_id" not in GRAINS[grain]:
            raise ValueError(f"cells of {grain} hold all games")
        found = found.filter(F.col("game_id").cast("string") == F.lit(str(spec.game_id)))
    return found


class CubeViews:
    """The dashboard's views from the cube and the small per-player tables."""

    def __init__(self, cube: DataFrame, summary: DataFrame, spec: FilterSpec = ex.DEFAULT):
        self.cube, self.summary, self.spec = cube, summary, spec

    def _at(self, grain: str) -> DataFrame:
        return cells(self.cube, grain, self.spec)

    def dynamic_counts(self) -> DataFrame:
        """D1."""
        return ex.dynamic_counts(self._at("player"), CELLS)

    def filtered_summary(self) -> DataFrame:
        return ex.filtered_summary(ex.summary_dynamic(self.summary, self.dynamic_counts(), self.spec), self.spec)

    def kpis(self) -> DataFrame:
        """D4."""
        return ex.kpis(self.filtered_summary())

    def team_profile(self) -> DataFrame:
        """D9."""
        return ex.team_profile(self.filtered_summary())

    def zone30_player(self) -> DataFrame:
        """D6."""
        return ex.zone30_grid(self._at("zone30").withColumnsRenamed({"zone30": "zone"}), F.sum("n"), F.sum("peak"))

    def pitch_thirds(self) -> DataFrame:
        """Over all runs, whatever the slider."""
        return ex.thirds(cells(self.cube, "third", None), CELLS)

    def zone9_heatmap(self) -> DataFrame:
        """D18."""
        kept = ex.pitch_runs_fallback(self._at("zone9"), self.spec)
        return ex.zone9_grid(kept.withColumnsRenamed({"zone9": "zone"}), [], F.sum("n"), F.sum("peak"))

    def match_top_performers(self) -> DataFrame:
        """D20."""
        return ex.match_top_performers(self._at("player"), CELLS)

    def match_team_comparison(self) -> DataFrame:
        """D21."""
        return ex.match_team_comparison(self._at("player"), CELLS)

    def match_position(self) -> DataFrame:
        """D22."""
        return ex.match_position(self._at("player"), CELLS)

    def match_zone9(self) -> DataFrame:
        """D23."""
        return ex.zone9_grid(self._at("zone9").withColumnsRenamed({"zone9": "zone"}), ["game_id"], F.sum("n"), F.sum("peak"))
