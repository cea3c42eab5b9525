"""Benchmark: the whole batch job, the library pipeline, the model's stages
and the headline queries.

Runs on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) and prints ONE JSON line:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}``.

``run_job`` is bronze to gold from ready frames, all tables written;
``effort_pipeline`` is the library form from stored frames to the summary.
``store_*`` apply a first batch of games to a store and append a small one.
``stage_*`` are the materialisation steps of the query model, dimensions
included.  Query timings execute each registered plan on top of those tables
with the ``noop`` sink (full execution, no driver transfer).
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from strideflow.plans import registry  # noqa: E402
from strideflow.plans.pipeline import run_job  # noqa: E402
from strideflow.plans.store import GameStore  # noqa: E402
from strideflow.session import local_session  # noqa: E402

HEADLINE = [
    "definition_comparison",
    "player_summary",
    "comparison_lib",
    "effort_pipeline",
    "vmax_per_game",
    "topk_mean_speed",
    "definition_preview",
    "runs_enriched",
    "q_position",
    "q_team",
    "team_outperformance",
    "pitch_thirds_by_position",
    "zone30_player",
    "zone9_heatmap",
    "threshold_sweep",
    "sweep_runs",
    "cube_kpis",
    "match_top_performers",
    "match_zone9",
    "round_summary",
    "week_trend",
    "bronze_audit",
]


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="strideflow-bench")
    times: dict[str, float] = {}

    def job(model) -> None:
        run_job(spark, model.tracking, model.players_bronze, model.matches, tempfile.mkdtemp(prefix="bench-lake-"), model.params)

    # warm-up on the smallest folder (JIT and codegen caches), then measure
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir) and os.path.abspath(warm_dir) != os.path.abspath(sf_dir):
        wm = registry._m(spark, warm_dir)
        wm.speeds, wm.vmax, wm.runs, wm.absolute_runs, wm.absolute_counts  # noqa: B018
        job(wm)
        for key in HEADLINE:
            _run(registry.QUERIES[key](spark, warm_dir))

    model = registry._m(spark, sf_dir)

    store = GameStore(spark, tempfile.mkdtemp(prefix="bench-store-"), model.params)
    late = F.pmod(F.xxhash64("game_id"), F.lit(25)) == 0  # about one game in 25

    def timed(name: str, step) -> None:
        t = time.perf_counter()
        step()
        times[name] = round(time.perf_counter() - t, 3)

    timed("stage_tracking", lambda: model.tracking)
    timed("stage_dimensions", lambda: (model.matches, model.players_bronze, model.player_lookup))
    timed("run_job", lambda: job(model))
    for name in ("speeds", "vmax", "runs", "absolute_runs", "absolute_counts", "runs_enriched"):
        timed(f"stage_{name}", lambda name=name: getattr(model, name))
    timed("store_first_games", lambda: store.apply(model.tracking.filter(~late)))
    timed("store_append", lambda: store.apply(model.tracking.filter(late)))
    timed("stage_lib_vmax_runs", lambda: (model.lib().vmax, model.lib().runs))

    for key in HEADLINE:
        t = time.perf_counter()
        _run(registry.QUERIES[key](spark, sf_dir))
        times[key] = round(time.perf_counter() - t, 3)

    total = round(sum(times.values()), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "batch_job_stages_and_headline_queries",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": float(m.group(1)) if m else sf_dir,
                "cpus": cpus,
            }
        )
    )
    registry.close_models()
    spark.stop()


if __name__ == "__main__":
    main()
