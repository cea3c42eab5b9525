"""Speed and run extraction against a brute-force pure-Python reference on
random frame sequences (gaps, period changes, several players and games),
with chunk sizes small enough to cut every sequence many times."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strideflow.operators import frames as fr
from strideflow.operators import runs as ru
from strideflow.params import LIB

from conftest import frames_df


def brute_speeds(rows):
    """rows: (game, frame, period, ts, ..., player, x, y, z) -> {(player, game, frame): speed}"""
    out = {}
    by_key = {}
    for r in rows:
        by_key.setdefault((r[7], r[0]), []).append(r)
    for (p, g), rs in by_key.items():
        rs.sort(key=lambda r: r[1])
        prev = None
        for r in rs:
            s = None
            if prev is not None and r[1] - prev[1] == 1 and prev[8] is not None:
                dx, dy = r[8] - prev[8], r[9] - prev[9]
                s = min(max(math.sqrt(dx * dx + dy * dy) / 0.04 * 3.6, 0.0), 45.0)
            out[(p, g, r[1])] = s
            prev = r
    return out


def brute_runs(rows, speeds, threshold, min_frames):
    """Absolute-style runs: flagged = speed >= threshold; split by period."""
    runs = []
    by_key = {}
    for r in rows:
        by_key.setdefault((r[7], r[0]), []).append(r)
    for (p, g), rs in by_key.items():
        rs.sort(key=lambda r: r[1])
        run_id, last = 0, None
        groups = {}
        for r in rs:
            s = speeds[(p, g, r[1])]
            if s is None or s < threshold:
                continue
            if last is None or r[1] - last > 1:
                run_id += 1
            last = r[1]
            groups.setdefault((r[2], run_id), []).append(r[1])
        for (period, rid), fids in groups.items():
            if len(fids) >= min_frames:
                runs.append((p, g, period, rid, min(fids), max(fids), len(fids)))
    return sorted(runs)


seq = st.lists(st.tuples(st.floats(0, 1.6), st.booleans(), st.booleans()), min_size=5, max_size=120)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(players=st.lists(seq, min_size=1, max_size=3), chunk=st.sampled_from([2, 5, 13]))
def test_speed_and_runs_match_brute_force(spark, players, chunk):
    rows = []
    for i, steps in enumerate(players):
        x, fid = 0.0, 0
        for j, (dx, gap, new_period) in enumerate(steps):
            fid += 3 if gap and j else 1
            x += dx * 0.3
            period = 2 if new_period and j > len(steps) // 2 else 1
            rows.append((f"g{i % 2}", fid, period, fid * 40, "alive", "h", "h", f"p{i}", float(x), 0.0, 0.0))
    # float32 positions, exactly as stored
    import struct

    rows = [r[:8] + (struct.unpack("f", struct.pack("f", r[8]))[0],) + r[9:] for r in rows]
    p = LIB.with_(chunk_frames=chunk, absolute_kmh=20.0, min_duration_sec=0.12)  # 3 frames
    sp = fr.compute_speed(frames_df(spark, rows), p)
    got = {(r.player_id, r.game_id, r.frame_id): r.speed_kmh for r in sp.collect()}
    want = brute_speeds(rows)
    assert got.keys() == want.keys()
    for k, v in want.items():
        if v is None:
            assert got[k] is None, k
        else:
            assert got[k] == struct.unpack("f", struct.pack("f", v))[0], k
    fspeeds = {k: (None if v is None else float(v)) for k, v in got.items()}
    want_runs = brute_runs(rows, fspeeds, 20.0, p.min_run_frames)
    runs = ru.extract_absolute_runs(sp, p).collect()
    got_runs = sorted(
        (r.player_id, r.game_id, r.period_id, r.run_id, r.start_frame_id, r.end_frame_id, round(r.duration_sec * 25))
        for r in runs
    )
    assert got_runs == want_runs
