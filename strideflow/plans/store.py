"""A store of games that changes by batches, each at the cost of what it
touches.

``GameStore.apply`` takes new, corrected or removed games and follows what
depends on them::

    games of the batch -> their speeds and v-max state
                       -> players in them -> players whose v-max moved
                       -> games of those players -> flags and runs anew

All other games keep their files.  Each table is a folder with one subfolder
an attempt, ``attempt=<n>-<id>/game_id=<id>/``.  The ledger of a commit says
which attempt holds each game of each table.  A commit is one small file named
by its number, renamed into place (never over another) after everything else
is written.  So a batch that fails half way changes nothing: readers go on with
the last commit's ledger.  Of two writers of the same commit one fails.  The
file system has to rename a file in one step, as HDFS does.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideflow.operators import frames as fr
from strideflow.operators import runs as ru
from strideflow.operators import tables as tb
from strideflow.operators import vmax_state as vs
from strideflow.params import LIB, PROD, EffortParams
from strideflow.session import drop_stages, materialize, spread
from strideflow.sources.tables import read_table

FRAME_KEY = ["game_id", "player_id", "frame_id"]
TAGS = ["vmax_kmh", "speed_threshold_kmh", "low_confidence", "is_effort_frame"]
TABLES = ("bronze", "histogram", "values", "silver", "runs", "absolute")
STATE, FLAGGED = "state", "flagged"  # the two kinds of ledger entries
_LEDGER = "kind string, game_id string, attempt string"
_VMAX = ["player_id", "vmax_kmh", "speed_threshold_kmh", "low_confidence"]  # what silver and the runs carry


class ConcurrentCommit(RuntimeError):
    """Another writer has made this commit."""


class GameStore:
    """``merge_frames``: a batch's frames replace those of the same (game,
    player, frame) and leave the game's others; otherwise a batch brings whole
    games."""

    def __init__(self, spark: SparkSession, root: str, params: EffortParams = PROD):
        self.spark, self.root, self.params = spark, root.rstrip("/"), params
        self.percentiles = sorted({params.vmax_percentile, LIB.vmax_percentile, PROD.vmax_percentile})

    # --- commits ----------------------------------------------------------
    def _hadoop(self, path: str):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        return jvm, at.getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf), at

    def head(self) -> tuple[int, str | None]:
        """(number, attempt) of the last commit; (0, None) before the first."""
        _, fs, _, at = self._hadoop(f"{self.root}/commits")
        numbers = [int(f.getPath().getName()) for f in fs.listStatus(at)] if fs.exists(at) else []
        if not numbers:
            return 0, None
        return max(numbers), self.spark.read.text(f"{self.root}/commits/{max(numbers):08d}").head()[0]

    def _commit(self, number: int, attempt: str) -> None:
        jvm, fs, context, source = self._hadoop(f"{self.root}/pending/{attempt}")
        out = fs.create(source, False)
        out.write(bytearray(attempt.encode()))
        out.close()
        target = jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits/{number:08d}")
        fs.mkdirs(target.getParent())
        never_over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(source, target, never_over)
        except Exception as e:  # noqa: BLE001
            raise ConcurrentCommit(f"commit {number} of {self.root} exists") from e

    def ledger(self, attempt: str | None = None) -> DataFrame:
        """(kind, game_id, attempt) of a commit, by default of the last."""
        attempt = attempt or self.head()[1]
        if attempt is None:
            return self.spark.createDataFrame([], _LEDGER)
        return self.spark.read.schema(_LEDGER).parquet(f"{self.root}/ledger/{attempt}")

    # --- tables -----------------------------------------------------------
    def _write(self, df: DataFrame, name: str, attempt: str, by: str) -> DataFrame:
        path = f"{self.root}/{name}/attempt={attempt}"
        # sorted by player, so that reading some players skips most of a file
        order = [by, "player_id", *[c for c in ("frame_id",) if c in df.columns]]
        df.hint("rebalance", by).sortWithinPartitions(*order).write.mode("overwrite").partitionBy(by).parquet(path)
        rest = [c for c in df.columns if c != by]
        schema = df.select(*rest, by).schema
        self.spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.root}/schemas/{name}")
        return read_table(self.spark, path, schema)

    def _read(self, name: str, kind: str, ledger: DataFrame, by: str = "game_id") -> DataFrame:
        """The current rows of a table: files of other attempts are pruned by
        the ledger's (attempt, game)."""
        schema = self.spark.read.parquet(f"{self.root}/schemas/{name}").schema
        every = read_table(self.spark, f"{self.root}/{name}", schema.add("attempt", "string"))
        return every.join(ledger.filter(F.col("kind") == kind).select("game_id", "attempt"), ["game_id", "attempt"], "left_semi")

    def table(self, name: str) -> DataFrame:
        """``bronze``, ``silver``, ``histogram``, ``values``, ``runs`` or
        ``absolute`` (runs a player and game) of the last commit."""
        kind = STATE if name in ("bronze", "histogram", "values") else FLAGGED
        return self._read(name, kind, self.ledger()).drop("attempt")

    @property
    def vmax_table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/vmax/{self.head()[1]}")

    @property
    def vmax(self) -> DataFrame:
        return fr.vmax_from_table(self.vmax_table, self.params)

    @property
    def absolute_counts(self) -> DataFrame:
        return ru.run_counts_from_games(self.table("absolute"))

    def gold(self, players: DataFrame, matches: DataFrame) -> dict[str, DataFrame]:
        """The gold tables, from one row a run."""
        lookup = tb.player_lookup(players, tb.team_lookup(matches))
        runs = tb.enrich_runs(self.table("runs"), lookup, matches)
        return {
            "runs": runs,
            "comparison": tb.compare_definitions(self.vmax, runs, self.absolute_counts, lookup),
            "player_summary": tb.summarise_players(runs, self.vmax, lookup),
        }

    def games_per_player(self) -> DataFrame:
        """(player_id, n_games) with timed frames, from the state alone."""
        return self._pairs(self.table("histogram")).groupBy("player_id").agg(F.count(F.lit(1)).alias("n_games"))

    @staticmethod
    def _pairs(hist: DataFrame) -> DataFrame:
        return hist.select("player_id", "game_id").distinct()

    # --- a batch ----------------------------------------------------------
    def apply(self, tracking: DataFrame | None = None, *, removed: list[str] = (), merge_frames: bool = False) -> dict[str, DataFrame]:
        """Bring the store up to date with a batch: games of ``tracking``, new
        or in place of the stored ones, and games that go.  Returns what was
        touched: the batch's ``games``, ``players`` whose v-max moved, and
        ``reflagged`` games of theirs."""
        spark, params = self.spark, self.params
        number, before = self.head()
        number += 1
        attempt = f"{number:08d}-{uuid.uuid4().hex[:12]}"
        ledger = self.ledger(before) if before else self.ledger()
        gone = spark.createDataFrame([(g,) for g in removed], "game_id string")
        if tracking is None:
            tracking = spark.read.parquet(f"{self.root}/schemas/bronze").limit(0)
        if merge_frames and before:
            tracking = self._merged(tracking, ledger)
        bronze = self._write(tracking, "bronze", attempt, "game_id")
        games = materialize(bronze.select("game_id").distinct(), "games")
        touched = games.unionByName(gone).distinct()

        # speeds and state of the batch's games only: both are per game
        speeds = materialize(fr.compute_speed(fr.drop_ball(bronze), params), "speeds")
        new_hist = self._write(vs.histogram_of(self._write(vs.values(speeds), "values", attempt, "band")), "histogram", attempt, "game_id")
        rest = ledger.join(touched, "game_id", "left_anti")
        state = rest.filter(F.col("kind") == STATE).unionByName(games.select(F.lit(STATE).alias("kind"), "game_id", F.lit(attempt).alias("attempt")))
        state = materialize(state, "state_ledger")

        # players of the batch's games, before or after it, and their v-max
        players = new_hist.select("player_id")
        if before:
            old_hist = self._read("histogram", STATE, ledger).join(touched, "game_id", "left_semi")
            players = players.unionByName(old_hist.select("player_id"))
        players = materialize(players.distinct(), "players")
        hist = self._read("histogram", STATE, state).join(players, "player_id", "left_semi")
        vals = self._read("values", STATE, state).join(players, "player_id", "left_semi")
        now = vs.vmax_from_state(hist, vals, self.percentiles, params.vmax_per_game)
        if before:
            old = spark.read.parquet(f"{self.root}/vmax/{before}")
            now = old.join(players, "player_id", "left_anti").unionByName(now)
        now.write.parquet(f"{self.root}/vmax/{attempt}")
        vmax = fr.vmax_from_table(spark.read.parquet(f"{self.root}/vmax/{attempt}"), params)
        was = fr.vmax_from_table(spark.read.parquet(f"{self.root}/vmax/{before}"), params) if before else vmax.limit(0)
        keys = ["player_id", "game_id"] if params.vmax_per_game else ["player_id"]
        carried = list(dict.fromkeys([*keys, *_VMAX]))
        moved = vmax.select(carried).exceptAll(was.select(carried)).unionByName(was.select(carried).exceptAll(vmax.select(carried)))
        moved = materialize(moved.select("player_id").distinct(), "moved")

        # other games of players whose v-max moved: their flags change
        pairs = self._pairs(self._read("histogram", STATE, state))
        reflagged = materialize(pairs.join(moved, "player_id", "left_semi").select("game_id").distinct().join(touched, "game_id", "left_anti"), "reflagged")
        frames = speeds
        if before:
            old = self._read("silver", FLAGGED, ledger).join(reflagged, "game_id", "left_semi")
            frames = frames.unionByName(old.drop("attempt", *TAGS))
        silver = self._write(fr.tag_effort_frames(frames, vmax), "silver", attempt, "game_id")
        pieces = materialize(ru.both_run_pieces(silver, params), "run_pieces")
        self._write(ru.runs_from_pieces(ru.pieces_of(pieces, "relative"), params), "runs", attempt, "game_id")
        self._write(ru.run_counts_by_game(ru.pieces_of(pieces, "absolute"), params), "absolute", attempt, "game_id")

        mine = games.unionByName(reflagged).select(F.lit(FLAGGED).alias("kind"), "game_id", F.lit(attempt).alias("attempt"))
        flagged = rest.filter(F.col("kind") == FLAGGED).join(reflagged, "game_id", "left_anti").unionByName(mine)
        state.unionByName(flagged).write.parquet(f"{self.root}/ledger/{attempt}")
        self._commit(number, attempt)
        drop_stages(speeds, pieces, state, players)
        return {"games": games, "players": moved, "reflagged": reflagged}

    def vacuum(self) -> list[str]:
        """Remove what the last commit does not refer to: the folders of
        attempts that failed or that hold no current game.  To be called when
        no batch is being applied and no reader is on an older commit.
        Returns the attempts removed."""
        head = self.head()[1]
        if head is None:
            return []
        kept = {r[0] for r in self.ledger(head).select("attempt").distinct().collect()} | {head}  # one a batch
        gone = set()
        for name in (*TABLES, "vmax", "ledger"):
            _, fs, _, at = self._hadoop(f"{self.root}/{name}")
            for status in fs.listStatus(at) if fs.exists(at) else []:
                attempt = status.getPath().getName().removeprefix("attempt=")
                if attempt not in kept or (name in ("vmax", "ledger") and attempt != head):
                    fs.delete(status.getPath(), True)
                    gone.add(attempt)
        return sorted(gone - kept)

    def _merged(self, tracking: DataFrame, ledger: DataFrame) -> DataFrame:
        """The batch's games with their stored frames; of frames with the same
        key the batch's stays.  Frames that a batch itself repeats come once,
        the last in column order."""
        names = tracking.columns
        games = tracking.select("game_id").distinct()
        old = self._read("bronze", STATE, ledger).join(games, "game_id", "left_semi").select(*names)
        both = tracking.withColumn("_new", F.lit(1)).unionByName(old.withColumn("_new", F.lit(0)))
        row = F.struct("_new", *[c for c in names if c not in FRAME_KEY])
        return spread(both, *FRAME_KEY).groupBy(*FRAME_KEY).agg(F.max(row).alias("r")).select(*[c if c in FRAME_KEY else F.col(f"r.{c}") for c in names])
