"""Pitch binning.  Coordinates are metres from the centre spot
(x in [-52.5, 52.5] along the length, y in [-34, 34]).

Three different edge rules exist in the reference and are kept apart:

* ``third_left_closed`` (gold Q6): ``x < -17.5`` defensive, ``x < 17.5``
  middle, anything else (including null) attacking; no outer bound.
* ``third_right_closed`` (dashboard D16): (-53,-17.5], (-17.5,17.5],
  (17.5,53]; outside or null -> null (the run is dropped).
* zone grids (D6/D18): index = number of *upper* edges strictly below the
  value, capped at the last zone, so bins are right-closed and values beyond
  the pitch clamp to the end zones; null sorts past every edge and lands in
  the last zone, as a sorted search does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference).
THIRD_NAMES = ("Defensive third", "Middle third", "Attacking third")
ZONE9_X_EDGES = (-52.5, -17.5, 17.5, 52.5)
ZONE9_Y_EDGES = (-34.0, -11.33, 11.33, 34.0)
ZONE9_ROW_NAMES = ("Right channel", "Central channel", "Left channel")
ZONE30_X_EDGES = (-52.5, -35.0, -17.5, 0.0, 17.5, 35.0, 52.5)
ZONE30_Y_EDGES = (-34.0, -20.4, -6.8, 6.8, 20.4, 34.0)
ZONE30_CHANNEL_NAMES = ("right channel", "right half-space", "central channel", "left half-space", "left channel")
ZONE30_THIRD_NAMES = ("defensive third", "defensive third", "middle third", "middle third", "attacking third", "attacking third")


def _c(v: Column | str) -> Column:
    return F.col(v) if isinstance(v, str) else v


def third_left_closed(x: Column | str = "start_x") -> Column:
    x = _c(x)
    return (
        F.when(x < -17.5, F.lit(THIRD_NAMES[0]))
        .when(x < 17.5, F.lit(THIRD_NAMES[1]))
        .otherwise(F.lit(THIRD_NAMES[2]))
    )


def third_right_closed(x: Column | str = "start_x") -> Column:
    x = _c(x)
    return (
        F.when((x > -53.0) & (x <= -17.5), F.lit(THIRD_NAMES[0]))
        .when((x > -17.5) & (x <= 17.5), F.lit(THIRD_NAMES[1]))
        .when((x > 17.5) & (x <= 53.0), F.lit(THIRD_NAMES[2]))
    )


def grid_index(v: Column | str, edges: Sequence[float]) -> Column:
    """Count of upper edges strictly below v, capped at len(edges)-2."""
    v = _c(v).cast("double")
    upper = edges[1:]
    last = len(edges) - 2
    idx = sum((F.when(v > F.lit(float(e)), 1).otherwise(0) for e in upper), F.lit(0))
    return F.when(v.isNull(), F.lit(last)).otherwise(F.least(idx, F.lit(last)))


def zone9_col(x: Column | str = "start_x") -> Column:
    return grid_index(x, ZONE9_X_EDGES)


def zone9_row(y: Column | str = "start_y") -> Column:
    return grid_index(y, ZONE9_Y_EDGES)


def zone30_col(x: Column | str = "start_x") -> Column:
    return grid_index(x, ZONE30_X_EDGES)


def zone30_row(y: Column | str = "start_y") -> Column:
    return grid_index(y, ZONE30_Y_EDGES)
