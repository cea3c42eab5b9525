"""The lazy bronze -> silver -> gold graph for one input folder.

``EffortModel`` wires the operators together once; every attribute is a lazy
DataFrame.  With ``materialized=True`` the stage tables (speeds, v-max, runs,
absolute runs and counts) are written once as Parquet in the shared
checkpoint folder and read back, so each downstream query starts from the
stored silver/gold tables instead of re-planning the frame windows in every
branch of its plan (Spark plans are trees, not DAGs).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from strideflow.functions.positions import with_position_columns
from strideflow.operators import frames as fr
from strideflow.operators import runs as ru
from strideflow.operators import sweep as sw
from strideflow.operators import tables as tb
from strideflow.params import LIB, PROD, EffortParams
from strideflow.plans import cube, fixture
from strideflow.session import delete_folder, store_stage


class EffortModel:
    def __init__(
        self,
        spark: SparkSession,
        sf_dir: str | None = None,
        params: EffortParams = PROD,
        *,
        tracking: DataFrame | None = None,
        players: DataFrame | None = None,
        matches: DataFrame | None = None,
        materialized: bool = False,
    ):
        self.spark = spark
        self.materialized = materialized
        self.sf_dir = sf_dir
        self.params = params
        self._tracking = tracking
        self._players = players
        self._matches = matches
        self._dims: EffortModel | None = None
        self._staged: list[DataFrame] = []
        self.paths: dict[str, str] = {}  # folders of the stage tables

    # --- bronze -----------------------------------------------------------
    @cached_property
    def tracking(self) -> DataFrame:
        if self._tracking is not None:
            return self._tracking
        return self._stage(fixture.tracking(self.spark, self.sf_dir), "tracking")

    @cached_property
    def players_bronze(self) -> DataFrame:
        if self._players is not None:
            return self._players
        if self._dims is not None:
            return self._dims.players_bronze
        return self._stage(fixture.players(self.spark, self.sf_dir), "players")

    @cached_property
    def matches(self) -> DataFrame:
        """Match metadata including ``Round``."""
        if self._matches is not None:
            return self._matches
        if self._dims is not None:
            return self._dims.matches
        return self._stage(fixture.matches(self.spark, self.sf_dir), "matches")

    def _stage(self, df: DataFrame, name: str) -> DataFrame:
        if not self.materialized:
            return df
        self.paths[name] = store_stage(df, name)
        self._staged.append(self.spark.read.schema(df.schema).parquet(self.paths[name]))
        return self._staged[-1]

    def close(self) -> None:
        """Remove the stage tables of this model and of its presets."""
        if "_lib" in self.__dict__:
            self._lib.close()
        for path in self.paths.values():
            delete_folder(self.spark, path.rsplit("/", 1)[0])
        self.paths.clear()
        self._staged.clear()

    # --- silver -----------------------------------------------------------
    @cached_property
    def speeds(self) -> DataFrame:
        return self._stage(fr.compute_speed(self.tracking, self.params), "speeds")

    @cached_property
    def vmax_table(self) -> DataFrame:
        """Exact v-max at this model's percentile and at both presets' in one
        shared pass, stored once; every preset's ``vmax`` is a projection."""
        ps = sorted({self.params.vmax_percentile, LIB.vmax_percentile, PROD.vmax_percentile})
        return self._stage(fr.vmax_percentiles(self.speeds, ps, self.params.vmax_per_game), "vmax_table")

    @cached_property
    def vmax(self) -> DataFrame:
        return fr.vmax_from_table(self.vmax_table, self.params)

    @cached_property
    def tagged(self) -> DataFrame:
        return fr.tag_effort_frames(self.speeds, self.vmax)

    @cached_property
    def silver(self) -> DataFrame:
        """Tagged frames without the ball (the stored silver table)."""
        return fr.drop_ball(self.tagged)

    # --- gold -------------------------------------------------------------
    @cached_property
    def run_pieces(self) -> DataFrame:
        """Relative-run pieces: the one frame-level pass of the run tables."""
        return self._stage(ru.effort_run_pieces(self.tagged, self.params), "run_pieces")

    @cached_property
    def runs(self) -> DataFrame:
        return self._stage(ru.runs_from_pieces(self.run_pieces, self.params, relative=True), "runs")

    @cached_property
    def sweep_pieces(self) -> DataFrame:
        """Run pieces at every slider threshold, from one pass over frames."""
        return self._stage(sw.sweep_pieces(self.speeds, self.vmax, params=self.params), "sweep_pieces")

    @cached_property
    def absolute_pieces(self) -> DataFrame:
        """Flat-limit run pieces, shared by the absolute runs and counts."""
        return self._stage(ru.absolute_run_pieces(self.speeds, self.params), "absolute_pieces")

    @cached_property
    def absolute_runs(self) -> DataFrame:
        return self._stage(ru.runs_from_pieces(self.absolute_pieces, self.params, relative=False), "absolute_runs")

    @cached_property
    def absolute_counts(self) -> DataFrame:
        return self._stage(ru.run_counts_from_pieces(self.absolute_pieces, self.params), "absolute_counts")

    @cached_property
    def teams(self) -> DataFrame:
        return tb.team_lookup(self.matches)

    @cached_property
    def player_lookup(self) -> DataFrame:
        if self._dims is not None:
            return self._dims.player_lookup
        return self._stage(tb.player_lookup(self.players_bronze, self.teams), "player_lookup")

    @cached_property
    def runs_enriched(self) -> DataFrame:
        """The stored gold runs table (runs with player, team and match
        columns); every dashboard view reads it."""
        return self._stage(tb.enrich_runs(self.runs, self.player_lookup, self.matches), "runs_enriched")

    @cached_property
    def summary(self) -> DataFrame:
        """Stored once, like the job's gold table; so is ``comparison``."""
        return self._stage(tb.summarise_players(self.runs, self.vmax, self.player_lookup), "player_summary")

    @cached_property
    def comparison(self) -> DataFrame:
        return self._stage(tb.compare_definitions(self.vmax, self.runs, self.absolute_counts, self.player_lookup), "comparison")

    # --- dashboard inputs (the exported CSVs + position columns) ------------
    @cached_property
    def app_summary(self) -> DataFrame:
        return with_position_columns(self.summary)

    @cached_property
    def app_comparison(self) -> DataFrame:
        return with_position_columns(self.comparison)

    @cached_property
    def app_runs(self) -> DataFrame:
        return with_position_columns(self.runs_enriched)

    @cached_property
    def cube(self) -> DataFrame:
        """The dashboard's measure cube, from one scan of the runs."""
        return self._stage(cube.build(self.app_runs), "cube")

    @cached_property
    def cube_views(self) -> "cube.CubeViews":
        return cube.CubeViews(self.cube, self.app_summary)

    @cached_property
    def _lib(self) -> "EffortModel":
        return self._derived(LIB.with_(chunk_frames=self.params.chunk_frames))

    def lib(self) -> "EffortModel":
        """The same inputs under the library preset (speeds shared)."""
        return self._lib

    def with_params(self, params: EffortParams) -> "EffortModel":
        return self._derived(params)

    def _derived(self, params: EffortParams) -> "EffortModel":
        m = EffortModel(
            self.spark,
            self.sf_dir,
            params,
            tracking=self._tracking if self._tracking is not None else self.tracking,
            players=self._players,
            matches=self._matches,
            materialized=self.materialized,
        )
        same_speed = (params.frame_rate_hz, params.kmh_per_ms, params.speed_ceiling_kmh) == (
            self.params.frame_rate_hz,
            self.params.kmh_per_ms,
            self.params.speed_ceiling_kmh,
        )
        # dimension tables do not depend on the metric parameters: read them
        # from this model, lazily (staged once, when first used)
        m._dims = self._dims or self
        if same_speed:
            m.__dict__["speeds"] = self.speeds
            if params.vmax_per_game == self.params.vmax_per_game and params.vmax_percentile in (
                self.params.vmax_percentile,
                LIB.vmax_percentile,
                PROD.vmax_percentile,
            ):
                m.__dict__["vmax_table"] = self.vmax_table
            same_flat = (params.absolute_kmh, params.min_run_frames, params.frame_rate_hz) == (
                self.params.absolute_kmh,
                self.params.min_run_frames,
                self.params.frame_rate_hz,
            )
            if same_flat:
                # the flat-limit runs do not depend on the v-max preset
                m.__dict__["absolute_pieces"] = self.absolute_pieces
                m.__dict__["absolute_runs"] = self.absolute_runs
                m.__dict__["absolute_counts"] = self.absolute_counts
        return m
