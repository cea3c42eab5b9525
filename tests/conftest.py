import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

from strideflow.schema import TRACKING  # noqa: E402
from strideflow.session import ensure_checkpoint_dir  # noqa: E402

FRAME_RATE = 25.0


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .appName("strideflow-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


def player_rows(player_id, speeds_kmh, game_id="game_1", period_id=1, start_frame=0, team_id="home", y=0.0):
    """Frames whose x integrates the wanted speeds: the speed seen at frame
    i is speeds[i-1]; frame 0 has none."""
    x = [0.0]
    for v in speeds_kmh[:-1]:
        x.append(x[-1] + v / 3.6 / FRAME_RATE)
    return [
        (game_id, start_frame + i, period_id, i * 40, "alive", "home", team_id, player_id, float(x[i]), float(y), 0.0)
        for i in range(len(speeds_kmh))
    ]


def frames_df(spark, rows):
    return spark.createDataFrame(rows, TRACKING)
