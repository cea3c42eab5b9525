"""Derived tracking fixture on the shared test tables (FIXTURES.md part 2).

Players are suppliers, their frames are their lineitems: ``n`` numbers a
supplier's lineitems in a fixed order, runs of 200 frames go to four games in
turn, and positions integrate a per-block target speed.  Every lineitem of a
supplier becomes a frame.  Everything is a DataFrame expression over
``lineitem``, ``supplier`` and ``nation``; the work grows with those tables.

Row numbers and running positions are summed on two levels: within ranges of
order keys, and over the ranges' totals.  A supplier that holds a third of all
lineitems is therefore spread over many tasks.  The lineitems are shuffled
once, by supplier and range: a supplier's frames of a game follow in the order
of its lineitems, so positions are summed where the rows have been numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strideflow.functions.positions import POSITION_CODES
from strideflow.session import spread, table_path

# Fixed values of the fixture formulas (FIXTURES.md).
FRAMES_PER_ROUND = 200
GAMES = 4
DENSE_FRAMES = 150
ORDER_RANGE = 4096  # order keys numbered together
BLOCK_FRAMES = 35
BALL_KEY = 7
BLOCK_SHARES = (30, 55, 70, 78, 85, 95, 100)
FIRST_DATE = "2022-11-20"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def _idiv(a, b: float):
    return F.floor(a / F.lit(float(b))).cast("long")


def _earlier(totals: DataFrame, keys: list[str], part: str, names: list[str]) -> DataFrame:
    """The sum of each total ``_name`` over a key's earlier parts, null before
    any."""
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, part, *[F.sum(f"_{name}").over(earlier).alias(f"_{name}") for name in names])


def _ranged_sums(df: DataFrame, keys: list[str], part: str, order: list[str], values: dict[str, Column], of_keys: DataFrame | None = None) -> DataFrame:
    """``df`` with a running sum of each value by ``keys`` in the order of
    (part, order): the sum within the part plus the totals of earlier parts.
    A part takes one task, so no key has to fit into one.  ``of_keys`` has
    columns of the keys; rows whose keys it lacks are left out.  It is joined to
    the parts' totals, so ``df`` is shuffled once, by keys and part."""
    inside = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = df.groupBy(*keys, part).agg(*[F.sum(v).alias(f"_{name}") for name, v in values.items()])
    before = _earlier(totals, keys, part, list(values)).fillna(0, [f"_{name}" for name in values])
    if of_keys is not None:
        before = before.join(of_keys, keys)
    local = spread(df, *keys, part).withColumns({name: F.sum(v).over(inside) for name, v in values.items()})
    sums = {name: (F.col(name) + F.col(f"_{name}")).cast("long") for name in values}
    # a merge join keeps the rows where they are and never broadcasts them
    joined = local.join(before.hint("shuffle_merge"), [*keys, part], "left" if of_keys is None else "inner")
    return joined.withColumns(sums).drop(*[f"_{name}" for name in values])


def _positions(df: DataFrame, moves: dict[str, Column]) -> DataFrame:
    """``df``, numbered and partitioned by (k, range), with a running sum of
    each move by (k, g) in the order of ``n``, which ranges follow."""
    inside = Window.partitionBy("k", "range", "g").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = [f"{name}{g}" for name in moves for g in range(GAMES)]
    of_game = {f"_{name}{g}": F.sum(F.when(F.col("g") == g, v)) for name, v in moves.items() for g in range(GAMES)}
    # a row a range for all games, so that the join's keys are the partitioning's
    totals = df.groupBy("k", "range").agg(*[v.alias(name) for name, v in of_game.items()])
    before = _earlier(totals, ["k"], "range", names)
    local = df.withColumns({name: F.sum(v).over(inside) for name, v in moves.items()})
    joined = local.join(before.hint("shuffle_merge"), ["k", "range"], "left")
    sums = {}
    for name in moves:
        earlier = F.get(F.array(*[f"_{name}{g}" for g in range(GAMES)]), F.col("g").cast("int"))
        sums[name] = F.coalesce(F.col(name) + F.coalesce(earlier, F.lit(0)), earlier).cast("long")
    return joined.withColumns(sums).drop(*[f"_{name}" for name in names])


def tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("k"),
        F.floor("l_quantity").cast("long").alias("q"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_extendedprice",
        # lineitems of no order come first and have no number
        F.coalesce(_idiv(F.col("l_orderkey"), ORDER_RANGE), F.lit(-(1 << 62))).alias("range"),
    )
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    sup = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("long").alias("t"))
    df = _ranged_sums(li, ["k"], "range", order, {"rn": F.lit(1)}, sup)
    df = df.withColumn("n", F.when(F.col("l_orderkey").isNotNull(), F.col("rn") - 1))
    lap = _idiv(F.col("n"), FRAMES_PER_ROUND)
    gf = F.col("n") % FRAMES_PER_ROUND + FRAMES_PER_ROUND * _idiv(lap, GAMES)
    df = df.withColumn("g", lap % GAMES).withColumn("gf", gf).withColumn("b", _idiv(F.col("gf"), BLOCK_FRAMES))
    df = df.withColumn("opp", ((F.col("g") * 11 + 50) - F.col("t")) % 25)
    v = 16 + (F.col("k") * 37) % 19
    shares = F.array(*[F.lit(s) for s in BLOCK_SHARES])
    f = F.element_at(shares, ((F.col("k") * 31 + (F.col("g") * 6 + F.col("b")) * 17) % 7 + 1).cast("int"))
    step = _idiv(v * f * (1000 + F.col("q") - 25), 9000)
    df = df.withColumn("step", step)
    df = _positions(df, {"sx": _idiv(F.col("step") * 4, 5), "sy": _idiv(F.col("step") * 3, 5)})
    cx = F.col("k") * 7717 + F.col("sx")
    cy = F.col("k") * 3331 + F.col("sy")
    x = F.abs(cx % 210000 - 105000) / F.lit(1000.0) - F.lit(52.5)
    y = F.abs(cy % 136000 - 68000) / F.lit(1000.0) - F.lit(34.0)
    frame = F.col("gf") + 5 * _idiv(F.col("gf"), 90)
    # every tenth player has a gap before each of its later frames
    frame = F.when((F.col("k") % 10 == 3) & (F.col("n") >= DENSE_FRAMES), frame * 2).otherwise(frame)
    return df.select(
        (F.col("g") * 1000 + F.least("t", "opp")).cast("string").alias("game_id"),
        frame.cast("long").alias("frame_id"),
        F.when(F.col("gf") < 120, 1).otherwise(2).cast("int").alias("period_id"),
        (F.col("gf") * 40).cast("long").alias("timestamp"),
        F.lit("alive").alias("ball_state"),
        F.col("t").cast("string").alias("ball_owning_team_id"),
        F.col("t").cast("string").alias("team_id"),
        F.when(F.col("k") == BALL_KEY, F.lit("ball")).otherwise(F.col("k").cast("string")).alias("player_id"),
        x.cast("float").alias("x"),
        y.cast("float").alias("y"),
        F.lit(0.0).cast("float").alias("z"),
    )


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per supplier: name, team, shirt number, position, starter."""
    sup = _read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    codes = F.array(*[F.lit(c) for c in POSITION_CODES], F.lit("XX"), F.lit(None).cast("string"))
    return sup.select(
        F.when(k == BALL_KEY, F.lit("ball")).otherwise(k.cast("string")).alias("player_id"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").cast("string").alias("team_id"),
        (k % 99 + 1).cast("int").alias("jersey_number"),
        F.get(codes, (k % 27).cast("int")).alias("position"),
        ((k % 3) != 0).alias("is_starter"),
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match metadata: rounds 0..3, nations paired t < opp, plus ``Round``.
    A nation that meets itself has a game without an away side."""
    nat = _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("t"), "n_name")
    # every nation once per round: a fixed 4-element expansion per nation
    rounds = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(GAMES - 1).cast("long")))
    pairs = nat.withColumn("g", rounds).withColumn("opp", ((F.col("g") * 11 + 50) - F.col("t")) % 25)
    pairs = pairs.filter(F.col("t") <= F.col("opp")).withColumn("opp", F.nullif("opp", "t"))
    away = nat.select(F.col("t").alias("opp"), F.col("n_name").alias("away_name"))
    m = pairs.join(away, "opp", "left")
    short = lambda c: F.concat(F.lit("N"), F.lpad(F.col(c).cast("string"), 2, "0"))
    week = (F.col("g") + 1).cast("int")
    return m.select(
        (F.col("g") * 1000 + F.col("t")).cast("string").alias("game_id"),
        F.concat(F.date_add(F.to_date(F.lit(FIRST_DATE)), F.col("g").cast("int")).cast("string"), F.lit("T00:00:00")).alias(
            "date"
        ),
        F.lit("2022").alias("season"),
        F.lit("1").alias("competition_id"),
        F.lit("Derived Cup").alias("competition_name"),
        F.col("n_name").alias("stadium_name"),
        F.col("t").cast("string").alias("home_team_id"),
        F.col("n_name").alias("home_team_name"),
        short("t").alias("home_team_short"),
        F.col("opp").cast("string").alias("away_team_id"),
        F.col("away_name").alias("away_team_name"),
        short("opp").alias("away_team_short"),
        F.lit(105.0).alias("pitch_length"),
        F.lit(68.0).alias("pitch_width"),
        F.lit(25.0).alias("fps"),
        week.alias("week"),
        F.when(week <= 3, F.lit("Group Stage")).otherwise(F.lit("Knockout")).alias("Round"),
    )
