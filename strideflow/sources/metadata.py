"""Match metadata JSON (S5): one document per file, either a list (the
match is element 0) or a single object; nested fields flattened to 16
columns, a missing key becomes null, pitch size from ``pitches[0]``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEAM = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("shortName", T.StringType()),
    ]
)
_PITCH = T.StructType([T.StructField("length", T.DoubleType()), T.StructField("width", T.DoubleType())])
MATCH_DOC = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("season", T.StringType()),
        T.StructField(
            "competition", T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType())])
        ),
        T.StructField(
            "stadium",
            T.StructType([T.StructField("name", T.StringType()), T.StructField("pitches", T.ArrayType(_PITCH))]),
        ),
        T.StructField("homeTeam", _TEAM),
        T.StructField("awayTeam", _TEAM),
        T.StructField("fps", T.DoubleType()),
        T.StructField("week", T.IntegerType()),
    ]
)


def read_match_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Flatten every ``*.json`` metadata document under ``path``.

    Each file is one row (``wholetext``); list and object documents are
    parsed with their own schema, chosen per row by the first character.
    """
    raw = spark.read.option("wholetext", "true").text(path).select(F.trim("value").alias("doc"))
    as_list = F.from_json("doc", T.ArrayType(MATCH_DOC))
    as_obj = F.from_json("doc", MATCH_DOC)
    m = raw.select(F.when(F.col("doc").startswith("["), F.get(as_list, 0)).otherwise(as_obj).alias("m"))
    pitch = F.get(F.col("m.stadium.pitches"), 0)
    return m.select(
        F.col("m.id").cast("string").alias("game_id"),
        F.col("m.date").alias("date"),
        F.col("m.season").alias("season"),
        F.col("m.competition.id").alias("competition_id"),
        F.col("m.competition.name").alias("competition_name"),
        F.col("m.stadium.name").alias("stadium_name"),
        F.col("m.homeTeam.id").alias("home_team_id"),
        F.col("m.homeTeam.name").alias("home_team_name"),
        F.col("m.homeTeam.shortName").alias("home_team_short"),
        F.col("m.awayTeam.id").alias("away_team_id"),
        F.col("m.awayTeam.name").alias("away_team_name"),
        F.col("m.awayTeam.shortName").alias("away_team_short"),
        pitch["length"].alias("pitch_length"),
        pitch["width"].alias("pitch_width"),
        F.col("m.fps").alias("fps"),
        F.col("m.week").alias("week"),
    )


def with_round(matches: DataFrame, group_weeks: int = 3) -> DataFrame:
    """``Round`` = Group Stage for week <= 3, else Knockout."""
    return matches.withColumn(
        "Round", F.when(F.col("week") <= group_weeks, F.lit("Group Stage")).otherwise(F.lit("Knockout"))
    )
