"""Column-level helpers (pure expressions, all JVM-side)."""

from strideflow.functions.numeric import safe_ratio, rnd
from strideflow.functions.positions import POSITION_GROUPS, position_group
from strideflow.functions.zones import (
    third_left_closed,
    third_right_closed,
    zone9_col,
    zone9_row,
    zone30_col,
    zone30_row,
)

__all__ = [
    "POSITION_GROUPS",
    "position_group",
    "rnd",
    "safe_ratio",
    "third_left_closed",
    "third_right_closed",
    "zone9_col",
    "zone9_row",
    "zone30_col",
    "zone30_row",
]
