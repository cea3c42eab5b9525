"""A mergeable, exact v-max state.

Two tables per game stand in for its frames:

* ``histogram``: frames per (game, player, bucket), the buckets being the
  monotone ones of the exact percentile;
* ``values``: frames per (game, player, speed), stored by *band*, the whole
  km/h of the speed.

Histograms merge by adding: those of any set of games give the bucket that
holds a needed rank, and its first rank.  Only the bands of these buckets are
then read from ``values``, so an append never reads the old games' frames, and
the result is that of the exact percentile over all of them, to the bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideflow.operators.frames import _clipped_bucket, _pcol, drop_ball, interpolated, needed_buckets
from strideflow.session import materialize


def _timed(speeds: DataFrame) -> DataFrame:
    v = F.col("speed_kmh").cast("float").cast("double")
    return drop_ball(speeds).filter(F.col("speed_kmh").isNotNull() & ~F.isnan("speed_kmh")).select("game_id", "player_id", v.alias("_v"))


def histogram(speeds: DataFrame) -> DataFrame:
    """(game_id, player_id, bucket, n)."""
    return _timed(speeds).groupBy("game_id", "player_id", _clipped_bucket(F.col("_v")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def values(speeds: DataFrame) -> DataFrame:
    """(game_id, player_id, speed, bucket, n, band)."""
    counted = _timed(speeds).groupBy("game_id", "player_id", F.col("_v").alias("speed")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("bucket", _clipped_bucket(F.col("speed"))).withColumn("band", F.floor("speed").cast("int"))


def histogram_of(vals: DataFrame) -> DataFrame:
    """``histogram`` from stored ``values``, without another pass over frames."""
    return vals.groupBy("game_id", "player_id", "bucket").agg(F.sum("n").alias("n"))


def vmax_from_state(hist: DataFrame, vals: DataFrame, percentiles: list[float], per_game: bool = False) -> DataFrame:
    """``vmax_percentiles`` from the two state tables of any set of games.

    The needed buckets (at most two a percentile and group) are stored, as
    their bands (at most one a km/h up to the speed ceiling) become a filter
    on the partitions of ``vals``.
    """
    groups = ["player_id", "game_id"] if per_game else ["player_id"]
    ps = {_pcol(p): p / 100.0 for p in sorted(set(percentiles))}
    merged = hist.groupBy(*groups, F.col("bucket").alias("_b")).agg(F.sum("n").alias("_c"))
    need = materialize(needed_buckets(merged, groups, list(ps.values())), "needed_buckets")
    # buckets from 1 km/h on are steps of 1/256; below, all are in band 0
    band = F.when(F.col("_b") >= 60256, F.floor((F.col("_b") - 60000) / 256)).otherwise(F.lit(0)).cast("int")
    bands = sorted(r[0] for r in need.select(band.alias("band")).distinct().collect())
    inside = vals.filter(F.col("band").isin(bands)).withColumnsRenamed({"bucket": "_b", "speed": "_v"}).join(need, [*groups, "_b"])
    return interpolated(inside, groups, ps, "frame_count", F.sum("n"))


# --- sketches (F4) ---------------------------------------------------------

SKETCH_K = 4096  # size of a sketch; its rank error falls as 1/k
RANK_ERROR = 0.002  # share of the frames by which a rank may be off at that size


def sketches(speeds: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """(game_id, player_id, sketch): a KLL sketch of the speeds of each player
    and game.  Sketches merge, so they serve any group of games."""
    v = F.col("_v").cast("float")
    return _timed(speeds).groupBy("game_id", "player_id").agg(F.kll_sketch_agg_float(v, k).alias("sketch"), F.count(F.lit(1)).alias("n"))


def vmax_from_sketches(stored: DataFrame, percentile: float, per_game: bool = False, k: int = SKETCH_K) -> DataFrame:
    """F4 from ``sketches``: approximate v-max and frame count a player (or
    player and game)."""
    groups = ["player_id", "game_id"] if per_game else ["player_id"]
    merged = stored.groupBy(*groups).agg(F.kll_merge_agg_float("sketch", k).alias("sketch"), F.sum("n").alias("frame_count"))
    return merged.select(*groups, F.kll_sketch_get_quantile_float("sketch", F.lit(percentile / 100.0)).alias("vmax_kmh"), "frame_count")


def rank_errors(approximate: DataFrame, vals: DataFrame, percentile: float, bound: float = RANK_ERROR) -> DataFrame:
    """``approximate`` with the share of frames between the asked rank and
    the nearest rank of the value, and whether it is within the bound (or one
    frame).  Exact ranks are counted over ``values``."""
    keys = [c for c in ("player_id", "game_id") if c in approximate.columns]
    v, p = F.col("vmax_kmh").cast("double"), F.lit(percentile / 100.0)
    share = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)) / F.sum("n")
    ranks = approximate.join(vals, keys).groupBy(*keys, "vmax_kmh", "frame_count").agg(share(F.col("speed") < v).alias("_lo"), share(F.col("speed") <= v).alias("_hi"))
    off = F.greatest(F.col("_lo") - p, p - F.col("_hi"), F.lit(0.0))
    return ranks.select(*keys, "vmax_kmh", "frame_count", off.alias("rank_error"), (off <= F.greatest(F.lit(bound), 1 / F.col("frame_count"))).alias("within_bound"))
