"""Metric parameters and dashboard filter settings.

The reference ships two presets that differ by layer: the library form
(75 % of a p99.5 v-max, float32 threshold) and the production/notebook form
(80 % of a p99.9 v-max, threshold rounded to 2 dp).  Every number is an
argument here; ``LIB`` and ``PROD`` are the two presets.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class EffortParams:
    frame_rate_hz: float = 25.0
    kmh_per_ms: float = 3.6
    threshold_pct: float = 0.80
    vmax_percentile: float = 99.9
    min_duration_sec: float = 1.0
    min_frames_vmax: int = 250
    speed_ceiling_kmh: float = 45.0
    absolute_kmh: float = 20.0
    # notebook form rounds vmax*t to 2 dp; library form keeps a float32
    round_threshold: bool = True
    # v-max pooled over the tournament (False) or per (player, game) (True)
    vmax_per_game: bool = False
    # frames per window chunk: bounds the rows one window task sees for a
    # single (player, game) no matter how skewed the data is
    chunk_frames: int = 1 << 16
    # accuracy of the approximate v-max
    approx_accuracy: int = 10000

    @property
    def min_run_frames(self) -> int:
        return int(self.min_duration_sec * self.frame_rate_hz)

    def with_(self, **kw) -> "EffortParams":
        return replace(self, **kw)


# Fixed values that must equal the reference's presets.
LIB = EffortParams(threshold_pct=0.75, vmax_percentile=99.5, round_threshold=False)
PROD = EffortParams()

# Dashboard slider domain: 60 % .. 95 % in steps of 5.
SWEEP_THRESHOLDS = (0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)


@dataclass(frozen=True)
class FilterSpec:
    """Sidebar state of the dashboard, as plain values.

    ``teams=None`` means every team (the dashboard's default selection is all
    team codes); positions default to the four outfield groups plus GK, i.e.
    ``UNK`` is excluded, exactly as the sidebar default.
    """

    threshold_pct: float = 0.80
    teams: tuple[str, ...] | None = None
    positions: tuple[str, ...] = ("GK", "DEF", "MID", "FWD")
    min_games: int = 2
    game_id: str | None = None
    top_n: int = 20
