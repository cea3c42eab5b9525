"""Position rollup (P8): detailed position code -> group."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference): the 25 position codes in their
# dashboard order and the group each rolls up to; anything else -> UNK.
POSITION_GROUPS: dict[str, str] = {
    "GK": "GK",
    "CB": "DEF", "LCB": "DEF", "RCB": "DEF", "LB": "DEF", "RB": "DEF",
    "LWB": "DEF", "RWB": "DEF", "SW": "DEF",
    "CDM": "MID", "CM": "MID", "LCM": "MID", "RCM": "MID", "CAM": "MID",
    "LAM": "MID", "RAM": "MID", "LM": "MID", "RM": "MID",
    "LW": "FWD", "RW": "FWD", "LF": "FWD", "RF": "FWD", "CF": "FWD",
    "SS": "FWD", "ST": "FWD",
    "UNK": "UNK",
}

POSITION_CODES: tuple[str, ...] = tuple(k for k in POSITION_GROUPS if k != "UNK")


def position_group(position: Column | str = "position") -> Column:
    """Map a detailed code to GK/DEF/MID/FWD; unknown or null -> UNK."""
    pos = F.col(position) if isinstance(position, str) else position
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(POSITION_GROUPS.items())])
    return F.coalesce(F.try_element_at(lookup, pos), F.lit("UNK"))


def with_position_columns(df, position: str = "position"):
    """Add ``pos`` (group) and ``pos_detail`` (original code)."""
    return df.withColumn("pos_detail", F.col(position)).withColumn("pos", position_group(position))
