"""strideflow — relative-effort run analytics on Spark.

Turns 25 Hz athlete position frames into per-frame speed, a robust personal
top speed (v-max), discrete high-effort runs (relative to v-max or above a flat
km/h limit) and the player / team / position / pitch-zone / match / phase
tables built on them.  Every operator is a lazy DataFrame -> DataFrame
function; the only actions live in the batch job (``plans.pipeline``).
"""

from strideflow.params import LIB, PROD, EffortParams, FilterSpec

__all__ = ["EffortParams", "FilterSpec", "LIB", "PROD"]
