"""SQL oracle: for every registered key, an engine-neutral SQL query that
DuckDB runs on the same parquet tables (views ``lineitem``, ``supplier``,
``nation``...).  Written by hand as SQL, independently of the DataFrame

Engine-neutral rules: ``AS`` before every alias, float literals as ``1e0``
style doubles, integer division via ``floor(a / b)``, explicit casts of
floats to double before arithmetic, ``ROWS`` frames for running sums.
"""

from __future__ import annotations

# Position groups and pitch zone edges (as in functions/).
POS = (
    "CASE WHEN {c} = 'GK' THEN 'GK' "
    "WHEN {c} IN ('CB', 'LCB', 'RCB', 'LB', 'RB', 'LWB', 'RWB', 'SW') THEN 'DEF' "
    "WHEN {c} IN ('CDM', 'CM', 'LCM', 'RCM', 'CAM', 'LAM', 'RAM', 'LM', 'RM') THEN 'MID' "
    "WHEN {c} IN ('LW', 'RW', 'LF', 'RF', 'CF', 'SS', 'ST') THEN 'FWD' "
    "ELSE 'UNK' END"
)


def _grid(v: str, uppers: list[str], last: int) -> str:
    terms = " + ".join(f"(CASE WHEN CAST({v} AS DOUBLE) > {e} THEN 1 ELSE 0 END)" for e in uppers)
    return f"(CASE WHEN {v} IS NULL THEN {last} ELSE least({terms}, {last}) END)"


Z9_COL = _grid("start_x", ["-17.5e0", "17.5e0", "52.5e0"], 2)
Z9_ROW = _grid("start_y", ["-11.33e0", "11.33e0", "34e0"], 2)
Z30_COL = _grid("start_x", ["-35e0", "-17.5e0", "0e0", "17.5e0", "35e0", "52.5e0"], 5)
Z30_ROW = _grid("start_y", ["-20.4e0", "-6.8e0", "6.8e0", "20.4e0", "34e0"], 4)


def _run_chain(sfx: str, flagged_from: str, flag: str, vmax_col: str) -> str:
    """CTEs ``rf{sfx}`` .. ``runs_all{sfx}``: gaps-and-islands over flagged
    frames per (player, game), grouped by (player, game, period, run)."""
    return f"""
rf{sfx} AS (SELECT * FROM {flagged_from} WHERE player_id <> 'ball' AND {flag}),
rb{sfx} AS (
  SELECT *, CASE WHEN lag(frame_id) OVER w IS NULL OR frame_id - lag(frame_id) OVER w > 1 THEN 1 ELSE 0 END AS st
  FROM rf{sfx} WINDOW w AS (PARTITION BY player_id, game_id ORDER BY frame_id, timestamp)
),
ri{sfx} AS (
  SELECT *, CAST(sum(st) OVER (PARTITION BY player_id, game_id ORDER BY frame_id, timestamp
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run_id
  FROM rb{sfx}
),
ra{sfx} AS (
  SELECT player_id, game_id, period_id, run_id,
         min(frame_id) AS start_frame_id, max(frame_id) AS end_frame_id, count(*) AS n_frames,
         max(speed_kmh) AS peak, avg(CAST(speed_kmh AS DOUBLE)) AS mean, max({vmax_col}) AS vmax,
         arg_min(x, frame_id) AS sx, arg_min(y, frame_id) AS sy, arg_max(x, frame_id) AS ex, arg_max(y, frame_id) AS ey
  FROM ri{sfx} GROUP BY player_id, game_id, period_id, run_id
),
runs_all{sfx} AS (
  SELECT player_id, game_id, CAST(period_id AS INTEGER) AS period_id, run_id, start_frame_id, end_frame_id,
         CAST(n_frames / 25e0 AS FLOAT) AS duration_sec,
         CAST(peak AS FLOAT) AS peak_speed_kmh,
         CAST(mean AS FLOAT) AS mean_speed_kmh,
         CAST(vmax AS FLOAT) AS vmax_kmh,
         CAST(CAST(peak AS DOUBLE) / vmax AS FLOAT) AS pct_of_vmax,
         CAST(mean * n_frames / 25e0 / 3.6e0 AS FLOAT) AS distance_m,
         CAST(sx AS FLOAT) AS start_x, CAST(sy AS FLOAT) AS start_y,
         CAST(ex AS FLOAT) AS end_x, CAST(ey AS FLOAT) AS end_y,
         n_frames
  FROM ra{sfx}
),"""


RUN_COLS = (
    "player_id, game_id, period_id, run_id, start_frame_id, end_frame_id, duration_sec, peak_speed_kmh, "
    "mean_speed_kmh, vmax_kmh, pct_of_vmax, distance_m, start_x, start_y, end_x, end_y"
)

PREFIX = f"""WITH
li AS (
  SELECT l_suppkey AS k, CAST(floor(l_quantity) AS BIGINT) AS q,
         row_number() OVER (PARTITION BY l_suppkey
                            ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS n
  FROM lineitem
),
fx0 AS (
  SELECT li.k, li.q, li.n, CAST(s.s_nationkey AS BIGINT) AS t,
         CAST(floor(li.n / 200e0) AS BIGINT) % 4 AS g,
         li.n % 200 + 200 * CAST(floor(li.n / 800e0) AS BIGINT) AS gf
  FROM li JOIN supplier s ON s.s_suppkey = li.k
),
fx1 AS (SELECT *, CAST(floor(gf / 35e0) AS BIGINT) AS b, ((g * 11 + 50) - t) % 25 AS opp FROM fx0),
fx2 AS (
  SELECT *, CAST(floor((16 + (k * 37) % 19)
                       * (CASE (k * 31 + (g * 6 + b) * 17) % 7 WHEN 0 THEN 30 WHEN 1 THEN 55 WHEN 2 THEN 70
                               WHEN 3 THEN 78 WHEN 4 THEN 85 WHEN 5 THEN 95 ELSE 100 END)
                       * (1000 + q - 25) / 9000e0) AS BIGINT) AS step
  FROM fx1
),
fx3 AS (
  SELECT *,
    k * 7717 + CAST(sum(CAST(floor(step * 4 / 5e0) AS BIGINT)) OVER w AS BIGINT) AS cx,
    k * 3331 + CAST(sum(CAST(floor(step * 3 / 5e0) AS BIGINT)) OVER w AS BIGINT) AS cy
  FROM fx2 WINDOW w AS (PARTITION BY k, g ORDER BY gf ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
tracking AS (
  SELECT CAST(g * 1000 + least(t, opp) AS VARCHAR) AS game_id,
         CAST((gf + 5 * floor(gf / 90e0)) * CASE WHEN k % 10 = 3 AND n >= 150 THEN 2 ELSE 1 END AS BIGINT) AS frame_id,
         CAST(CASE WHEN gf < 120 THEN 1 ELSE 2 END AS INTEGER) AS period_id,
         CAST(gf * 40 AS BIGINT) AS timestamp,
         'alive' AS ball_state,
         CAST(t AS VARCHAR) AS ball_owning_team_id,
         CAST(t AS VARCHAR) AS team_id,
         CASE WHEN k = 7 THEN 'ball' ELSE CAST(k AS VARCHAR) END AS player_id,
         CAST(abs(cx % 210000 - 105000) / 1000e0 - 52.5e0 AS FLOAT) AS x,
         CAST(abs(cy % 136000 - 68000) / 1000e0 - 34e0 AS FLOAT) AS y,
         CAST(0 AS FLOAT) AS z
  FROM fx3
),
sp0 AS (
  SELECT *, lag(frame_id) OVER w AS pf, lag(CAST(x AS DOUBLE)) OVER w AS px, lag(CAST(y AS DOUBLE)) OVER w AS py
  FROM tracking WINDOW w AS (PARTITION BY player_id, game_id ORDER BY frame_id, timestamp, x, y)
),
speed AS (
  SELECT game_id, frame_id, period_id, timestamp, ball_state, ball_owning_team_id, team_id, player_id, x, y, z,
         CAST(CASE WHEN frame_id - pf = 1 AND px IS NOT NULL THEN
              greatest(least(sqrt((CAST(x AS DOUBLE) - px) * (CAST(x AS DOUBLE) - px)
                                  + (CAST(y AS DOUBLE) - py) * (CAST(y AS DOUBLE) - py)) / 0.04e0 * 3.6e0, 45e0), 0e0)
              END AS FLOAT) AS speed_kmh
  FROM sp0
),
vmax_raw AS (
  SELECT player_id, quantile_cont(CAST(speed_kmh AS DOUBLE), 99.9e0 / 100e0) AS vmax_kmh, count(speed_kmh) AS frame_count
  FROM speed WHERE speed_kmh IS NOT NULL AND player_id <> 'ball' GROUP BY player_id
),
vm AS (
  SELECT player_id, vmax_kmh, frame_count, frame_count < 250 AS low_confidence,
         round(vmax_kmh * 0.8e0, 2) AS speed_threshold_kmh
  FROM vmax_raw
),
tagged AS (
  SELECT s.*, v.vmax_kmh, v.speed_threshold_kmh, v.low_confidence,
         coalesce(s.speed_kmh IS NOT NULL AND CAST(s.speed_kmh AS DOUBLE) >= v.speed_threshold_kmh
                  AND NOT v.low_confidence, false) AS is_effort_frame
  FROM speed s LEFT JOIN vm v ON v.player_id = s.player_id
),
{_run_chain("", "tagged", "is_effort_frame", "vmax_kmh")}
runs AS (SELECT {RUN_COLS} FROM runs_all WHERE n_frames >= 25),
spa AS (SELECT *, CAST(NULL AS DOUBLE) AS no_vmax FROM speed),
{_run_chain("_abs", "spa", "speed_kmh IS NOT NULL AND CAST(speed_kmh AS DOUBLE) >= 20e0", "no_vmax")}
aruns AS (
  SELECT player_id, game_id, period_id, run_id, start_frame_id, end_frame_id, duration_sec, peak_speed_kmh,
         mean_speed_kmh, vmax_kmh, CAST(NULL AS FLOAT) AS pct_of_vmax, distance_m, start_x, start_y, end_x, end_y
  FROM runs_all_abs WHERE n_frames >= 25
),
abs_counts AS (
  SELECT player_id, count(*) AS runs_absolute, count(DISTINCT game_id) AS n_games_absolute
  FROM (SELECT player_id, game_id, run_id, count(*) AS nf FROM ri_abs GROUP BY player_id, game_id, run_id)
  WHERE nf >= 25 GROUP BY player_id
),
vmax_lib_raw AS (
  SELECT player_id, quantile_cont(CAST(speed_kmh AS DOUBLE), 99.5e0 / 100e0) AS vmax_kmh, count(speed_kmh) AS frame_count
  FROM speed WHERE speed_kmh IS NOT NULL AND player_id <> 'ball' GROUP BY player_id
),
vm_lib AS (
  SELECT player_id, vmax_kmh, frame_count, frame_count < 250 AS low_confidence,
         CAST(CAST(vmax_kmh * 0.75e0 AS FLOAT) AS DOUBLE) AS speed_threshold_kmh
  FROM vmax_lib_raw
),
tagged_lib AS (
  SELECT s.*, v.vmax_kmh, v.speed_threshold_kmh, v.low_confidence,
         coalesce(s.speed_kmh IS NOT NULL AND CAST(s.speed_kmh AS DOUBLE) >= v.speed_threshold_kmh
                  AND NOT v.low_confidence, false) AS is_effort_frame
  FROM speed s LEFT JOIN vm_lib v ON v.player_id = s.player_id
),
{_run_chain("_lib", "tagged_lib", "is_effort_frame", "vmax_kmh")}
runs_lib AS (SELECT {RUN_COLS} FROM runs_all_lib WHERE n_frames >= 25),
players AS (
  SELECT CASE WHEN s_suppkey = 7 THEN 'ball' ELSE CAST(s_suppkey AS VARCHAR) END AS player_id,
         s_name AS name,
         CAST(s_nationkey AS VARCHAR) AS team_id,
         CAST(s_suppkey % 99 + 1 AS INTEGER) AS jersey_number,
         (['GK', 'CB', 'LCB', 'RCB', 'LB', 'RB', 'LWB', 'RWB', 'SW', 'CDM', 'CM', 'LCM', 'RCM', 'CAM', 'LAM',
           'RAM', 'LM', 'RM', 'LW', 'RW', 'LF', 'RF', 'CF', 'SS', 'ST', 'XX', NULL])[CAST(s_suppkey % 27 AS INTEGER) + 1]
           AS position,
         s_suppkey % 3 <> 0 AS is_starter
  FROM supplier
),
mpairs AS (
  SELECT n.n_nationkey AS t, n.n_name, r.g, ((r.g * 11 + 50) - n.n_nationkey) % 25 AS opp
  FROM nation n, (VALUES (0), (1), (2), (3)) AS r(g)
),
matches AS (
  SELECT CAST(p.g * 1000 + p.t AS VARCHAR) AS game_id,
         CAST(DATE '2022-11-20' + CAST(p.g AS INTEGER) AS VARCHAR) || 'T00:00:00' AS date,
         '2022' AS season, '1' AS competition_id, 'Derived Cup' AS competition_name,
         p.n_name AS stadium_name,
         CAST(p.t AS VARCHAR) AS home_team_id, p.n_name AS home_team_name,
         'N' || lpad(CAST(p.t AS VARCHAR), 2, '0') AS home_team_short,
         CAST(a.n_nationkey AS VARCHAR) AS away_team_id, a.n_name AS away_team_name,
         'N' || lpad(CAST(a.n_nationkey AS VARCHAR), 2, '0') AS away_team_short,
         105e0 AS pitch_length, 68e0 AS pitch_width, 25e0 AS fps,
         CAST(p.g + 1 AS INTEGER) AS week,
         CASE WHEN p.g + 1 <= 3 THEN 'Group Stage' ELSE 'Knockout' END AS "Round"
  FROM mpairs p LEFT JOIN nation a ON a.n_nationkey = p.opp AND p.opp <> p.t
  WHERE p.t <= p.opp
),
teams_all AS (
  SELECT home_team_id AS team_id, home_team_name AS team_name, home_team_short AS team_short FROM matches
  UNION ALL
  SELECT away_team_id, away_team_name, away_team_short FROM matches WHERE away_team_id IS NOT NULL
),
teams AS (
  SELECT team_id, team_name, team_short FROM (
    SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY team_name, team_short) AS rn FROM teams_all
  ) WHERE rn = 1
),
plk AS (
  SELECT p.player_id, p.name AS player_name, p.team_id, t.team_name, t.team_short,
         p.jersey_number, p.position, p.is_starter
  FROM (SELECT *, row_number() OVER (PARTITION BY player_id
                                     ORDER BY name, team_id, jersey_number, position, is_starter) AS rn
        FROM players) p
  LEFT JOIN teams t ON t.team_id = p.team_id
  WHERE p.rn = 1
),
rx AS (
  SELECT r.*, l.player_name, l.team_name, l.team_short, l.position,
         m.date, m.home_team_name, m.away_team_name, m.competition_name, m.stadium_name, m.week
  FROM runs r
  LEFT JOIN plk l ON l.player_id = r.player_id
  LEFT JOIN matches m ON m.game_id = r.game_id
),
rsum AS (
  SELECT player_id, count(*) AS runs, count(DISTINCT game_id) AS games,
         sum(CAST(distance_m AS DOUBLE)) AS dist, avg(CAST(duration_sec AS DOUBLE)) AS dur,
         avg(CAST(pct_of_vmax AS DOUBLE)) AS pct, max(peak_speed_kmh) AS peak, avg(CAST(peak_speed_kmh AS DOUBLE)) AS mpeak
  FROM runs GROUP BY player_id
),
summary AS (
  SELECT s.player_id, l.player_name, l.team_name, l.team_short, l.position, l.jersey_number, l.is_starter,
         round(v.vmax_kmh, 2) AS vmax_kmh, round(v.speed_threshold_kmh, 2) AS limit_kmh, v.low_confidence,
         s.games, s.runs,
         round(s.runs / greatest(s.games, 1), 2) AS rate,
         round(s.dist, 1) AS metres,
         round(s.dist / greatest(s.games, 1), 1) AS metres_per_game,
         round(s.dur, 2) AS seconds_per_run,
         round(s.pct * 100, 1) AS effort_pct,
         round(CAST(s.peak AS DOUBLE), 2) AS peak_kmh,
         round(s.mpeak, 2) AS peak_per_run
  FROM rsum s
  LEFT JOIN vm v ON v.player_id = s.player_id
  LEFT JOIN plk l ON l.player_id = s.player_id
  WHERE NOT v.low_confidence
),
rcnt AS (SELECT player_id, count(*) AS runs_relative, count(DISTINCT game_id) AS games FROM runs GROUP BY player_id),
cmp0 AS (
  SELECT v.player_id, v.vmax_kmh, v.speed_threshold_kmh,
         coalesce(rc.games, 0) AS games,
         coalesce(ac.runs_absolute, 0) AS runs_absolute,
         coalesce(rc.runs_relative, 0) AS runs_relative
  FROM vm v
  LEFT JOIN rcnt rc ON rc.player_id = v.player_id
  LEFT JOIN abs_counts ac ON ac.player_id = v.player_id
  WHERE NOT v.low_confidence
),
comparison AS (
  SELECT c.player_id, l.player_name, l.team_name, l.team_short, l.position, l.jersey_number,
         round(c.vmax_kmh, 2) AS vmax_kmh, round(c.speed_threshold_kmh, 2) AS limit_kmh,
         c.games, c.runs_absolute, c.runs_relative,
         c.runs_relative - c.runs_absolute AS delta,
         CASE WHEN c.runs_absolute > 0
              THEN round((c.runs_relative - c.runs_absolute) / c.runs_absolute * 100, 1) END AS change_pct,
         CASE WHEN c.runs_relative - c.runs_absolute > 0 THEN 'gained'
              WHEN c.runs_relative - c.runs_absolute < 0 THEN 'lost' ELSE 'unchanged' END AS category,
         round(c.runs_absolute / greatest(c.games, 1), 2) AS rate_absolute,
         round(c.runs_relative / greatest(c.games, 1), 2) AS rate_relative
  FROM cmp0 c LEFT JOIN plk l ON l.player_id = c.player_id
),
app_summary AS (SELECT *, position AS pos_detail, {POS.format(c="position")} AS pos FROM summary),
app_comparison AS (SELECT *, position AS pos_detail, {POS.format(c="position")} AS pos FROM comparison),
app_runs AS (SELECT *, position AS pos_detail, {POS.format(c="position")} AS pos FROM rx),
qual AS (SELECT * FROM app_runs WHERE CAST(pct_of_vmax AS DOUBLE) >= 0.8e0),
dyn AS (
  SELECT player_id, count(*) AS runs_now, count(DISTINCT game_id) AS games_now,
         round(avg(CAST(pct_of_vmax AS DOUBLE)) * 100, 1) AS effort_pct_now,
         avg(CAST(duration_sec AS DOUBLE)) AS seconds_per_run_now,
         sum(CAST(distance_m AS DOUBLE)) AS metres_now,
         avg(CAST(peak_speed_kmh AS DOUBLE)) AS peak_per_run_now,
         round(count(run_id) / greatest(count(DISTINCT game_id), 1), 2) AS rate_now
  FROM qual GROUP BY player_id
),
sdyn AS (
  SELECT s.*, d.games_now, d.effort_pct_now, d.seconds_per_run_now, d.metres_now,
         coalesce(d.runs_now, 0) AS runs_now,
         coalesce(d.rate_now, 0e0) AS rate_now,
         coalesce(d.peak_per_run_now, 0e0) AS peak_per_run_now,
         s.vmax_kmh * 0.8e0 AS threshold_at_pct
  FROM app_summary s LEFT JOIN dyn d ON d.player_id = s.player_id
),
qcnt AS (SELECT player_id, count(*) AS runs_relative_now FROM qual GROUP BY player_id),
cdyn0 AS (
  SELECT c.* EXCLUDE (delta, change_pct, category),
         c.vmax_kmh * 0.8e0 AS threshold_at_pct,
         c.vmax_kmh * 0.8e0 <= 20e0 AS above_absolute,
         c.vmax_kmh * 0.8e0 - 20e0 AS new_threshold_vs_20,
         25e0 AS breakeven_vmax_kmh,
         coalesce(ac.runs_absolute, 0) AS runs_absolute_now,
         coalesce(q.runs_relative_now, 0) AS runs_relative_now
  FROM app_comparison c
  LEFT JOIN abs_counts ac ON ac.player_id = c.player_id
  LEFT JOIN qcnt q ON q.player_id = c.player_id
),
cdyn AS (
  SELECT *, runs_relative_now - runs_absolute_now AS delta,
         round((runs_relative_now - runs_absolute_now) / greatest(runs_absolute_now, 1) * 100, 1) AS change_pct,
         CASE WHEN runs_relative_now - runs_absolute_now > 0 THEN 'gained'
              WHEN runs_relative_now - runs_absolute_now < 0 THEN 'lost' ELSE 'unchanged' END AS category
  FROM cdyn0
),
fs AS (
  SELECT * REPLACE (vmax_kmh * 0.8e0 AS threshold_at_pct) FROM sdyn
  WHERE team_short IS NOT NULL AND pos IN ('GK', 'DEF', 'MID', 'FWD') AND games >= 2 AND NOT low_confidence
),
fc AS (
  SELECT * FROM cdyn
  WHERE team_short IS NOT NULL AND pos IN ('GK', 'DEF', 'MID', 'FWD') AND games >= 2
),
pr AS (SELECT *, coalesce(team_short IS NOT NULL AND pos IN ('GK', 'DEF', 'MID', 'FWD'), false) AS keep FROM qual),
pitch AS (SELECT * FROM pr WHERE keep OR NOT EXISTS (SELECT 1 FROM pr WHERE keep)),
z30c AS (
  SELECT player_id, zr * 6 + zc AS zone, count(*) AS n_runs, sum(CAST(peak_speed_kmh AS DOUBLE)) AS speed_sum
  FROM (SELECT player_id, {Z30_ROW} AS zr, {Z30_COL} AS zc, peak_speed_kmh FROM qual)
  GROUP BY player_id, zr * 6 + zc
),
z30g AS (
  SELECT k.player_id, k.player_name, z.zone, coalesce(c.n_runs, 0) AS n_runs, coalesce(c.speed_sum, 0e0) AS speed_sum
  FROM (SELECT DISTINCT player_id, player_name FROM qual) k
  CROSS JOIN (SELECT CAST(range AS INTEGER) AS zone FROM range(30)) z
  LEFT JOIN z30c c ON c.player_id = k.player_id AND c.zone = z.zone
),
z30 AS (
  SELECT player_id, player_name, zone, zone // 6 AS "row", zone % 6 AS col, n_runs, round(speed_sum, 4) AS speed_sum,
         CASE WHEN sum(n_runs) OVER (PARTITION BY player_id) > 0
              THEN n_runs / sum(n_runs) OVER (PARTITION BY player_id) * 100 ELSE 0e0 END AS pct,
         n_runs / CASE WHEN max(n_runs) OVER (PARTITION BY player_id) > 0
                       THEN max(n_runs) OVER (PARTITION BY player_id) ELSE 1 END AS intensity
  FROM z30g
),
tprof AS (
  SELECT team_name, team_short, count(player_name) AS named_players, sum(runs_now) AS runs_now, avg(rate_now) AS rate_now,
         avg(metres_per_game) AS metres_per_game, avg(effort_pct) AS effort_pct, avg(peak_kmh) AS peak_kmh, avg(vmax_kmh) AS vmax_kmh
  FROM fs WHERE team_name IS NOT NULL AND team_short IS NOT NULL GROUP BY team_name, team_short
),
pprof AS (
  SELECT pos AS position, count(player_name) AS named_players, avg(rate_now) AS rate_now, avg(metres_per_game) AS metres_per_game,
         avg(effort_pct) AS effort_pct, avg(peak_kmh) AS peak_kmh, avg(vmax_kmh) AS vmax_kmh, avg(limit_kmh) AS limit_kmh
  FROM fs WHERE pos IS NOT NULL GROUP BY pos
),
mruns AS (SELECT * FROM app_runs WHERE CAST(pct_of_vmax AS DOUBLE) >= 0.8e0),
gpr AS (SELECT "Round", count(*) AS games FROM matches WHERE "Round" IS NOT NULL GROUP BY "Round"),
phase AS (
  SELECT r.*, m."Round" AS m_round
  FROM app_runs r LEFT JOIN matches m ON m.game_id = CAST(r.game_id AS VARCHAR)
  WHERE CAST(r.pct_of_vmax AS DOUBLE) >= 0.8e0 AND r.team_short IS NOT NULL AND r.pos IN ('GK', 'DEF', 'MID', 'FWD')
),
sweep_t AS (SELECT * FROM (VALUES (0.6e0), (0.65e0), (0.7e0), (0.75e0), (0.8e0), (0.85e0), (0.9e0), (0.95e0)) AS t(threshold_pct))
"""


def _zone9_sql(src: str, keys: list[str]) -> str:
    k = ", ".join(keys)
    kc = "".join(f"{x}, " for x in keys)
    kd = f"SELECT DISTINCT {k} FROM {src}" if keys else "SELECT 1 AS _one"
    on = " AND ".join([f"c.{x} = g.{x}" for x in keys] + ["c.zone = g.zone"])
    part = f"PARTITION BY {', '.join('g.' + x for x in keys)}" if keys else ""
    gk = "".join(f"g.{x}, " for x in keys)
    return f"""
, zc AS (
  SELECT {kc}zr * 3 + zcol AS zone, count(*) AS n_runs, sum(CAST(peak_speed_kmh AS DOUBLE)) AS ss
  FROM (SELECT {kc}{Z9_ROW} AS zr, {Z9_COL} AS zcol, peak_speed_kmh FROM {src})
  GROUP BY {kc}zr * 3 + zcol
), zg AS (
  SELECT kk.*, CAST(z.range AS INTEGER) AS zone FROM ({kd}) kk CROSS JOIN range(9) z
)
SELECT {gk}g.zone,
       (['Right channel', 'Central channel', 'Left channel'])[g.zone // 3 + 1] AS channel,
       (['Defensive third', 'Middle third', 'Attacking third'])[g.zone % 3 + 1] AS third,
       coalesce(c.n_runs, 0) AS n_runs,
       CASE WHEN sum(coalesce(c.n_runs, 0)) OVER ({part}) > 0
            THEN coalesce(c.n_runs, 0) / sum(coalesce(c.n_runs, 0)) OVER ({part}) * 100 ELSE 0e0 END AS pct,
       CASE WHEN coalesce(c.n_runs, 0) > 0 THEN c.ss / c.n_runs ELSE 0e0 END AS avg_peak_speed,
       coalesce(c.n_runs, 0) / CASE WHEN max(coalesce(c.n_runs, 0)) OVER ({part}) > 0
                                    THEN max(coalesce(c.n_runs, 0)) OVER ({part}) ELSE 1 END AS intensity
FROM zg g LEFT JOIN zc c ON {on}"""


_RADAR = " UNION ALL ".join(
    f"SELECT position, '{m}' AS metric, CAST({m} AS DOUBLE) AS v FROM pprof"
    for m in ("rate_now", "vmax_kmh", "metres_per_game", "effort_pct", "peak_kmh")
)

# key -> final statement appended to PREFIX (a leading ", name AS (...)" adds CTEs)
BODIES: dict[str, str] = {
    "scan_tracking": "SELECT * FROM tracking",
    "normalise_tracking": "SELECT *, '2022-12-18T00:00:00+00:00' AS _ingested_at FROM tracking",
    "ball_filter": "SELECT game_id, frame_id, period_id, timestamp, team_id, player_id, x, y FROM tracking WHERE player_id <> 'ball'",
    "absolute_frames": """SELECT player_id, game_id, frame_id, speed_kmh FROM speed
        WHERE player_id <> 'ball' AND speed_kmh IS NOT NULL AND CAST(speed_kmh AS DOUBLE) >= 20e0""",
    "position_rollup": f"SELECT player_id, position, {POS.format(c='position')} AS pos, position AS pos_detail FROM plk",
    "qualifying_runs": "SELECT player_id, game_id, period_id, run_id, pct_of_vmax, team_short, pos FROM qual",
    "filtered_summary": """SELECT player_id, team_short, pos, games, rate_now, runs_now,
        peak_per_run_now, threshold_at_pct FROM fs""",
    "filtered_comparison": """SELECT player_id, team_short, pos, games, runs_absolute_now, runs_relative_now, delta, change_pct, category FROM fc""",
    "pitch_runs_fallback": "SELECT player_id, game_id, period_id, run_id, team_short, pos FROM pitch",
    "match_labels": """SELECT game_id, date, home_team_short || ' vs ' || coalesce(away_team_short, '-') || '  ·  W' || CAST(week AS VARCHAR)
        || '  (' || upper(substr("Round", 1, 2)) || ')' AS label FROM matches""",
    "team_options": "SELECT DISTINCT team_short FROM app_summary WHERE team_short IS NOT NULL",
    "threshold_columns": """SELECT player_id, vmax_kmh, vmax_kmh * 0.8e0 AS threshold_at_pct,
        vmax_kmh * 0.8e0 <= 20e0 AS above_absolute, vmax_kmh * 0.8e0 - 20e0 AS new_threshold_vs_20,
        25e0 AS breakeven_vmax_kmh FROM comparison""",
    "frame_speed": "SELECT player_id, game_id, frame_id, period_id, speed_kmh FROM speed",
    "vmax_exact": "SELECT player_id, vmax_kmh, frame_count, low_confidence, speed_threshold_kmh FROM vm",
    "vmax_per_game": """SELECT player_id, game_id, vmax_kmh, frame_count, frame_count < 250 AS low_confidence,
        round(vmax_kmh * 0.8e0, 2) AS speed_threshold_kmh
        FROM (SELECT player_id, game_id, quantile_cont(CAST(speed_kmh AS DOUBLE), 99.9e0 / 100e0) AS vmax_kmh,
                     count(speed_kmh) AS frame_count
              FROM speed WHERE speed_kmh IS NOT NULL AND player_id <> 'ball' GROUP BY player_id, game_id)""",
    "relative_threshold": "SELECT player_id, vmax_kmh, speed_threshold_kmh FROM vm",
    "tagged_frames": """SELECT player_id, game_id, frame_id, speed_kmh, speed_threshold_kmh, low_confidence, is_effort_frame
        FROM tagged WHERE player_id <> 'ball'""",
    "definition_preview": """SELECT *, round(absolute_frames / nullif(frames, 0) * 100, 2) AS absolute_pct,
        round(relative_frames / nullif(frames, 0) * 100, 2) AS relative_pct, relative_frames - absolute_frames AS extra_frames
        FROM (SELECT count(*) AS frames, count(*) FILTER (WHERE CAST(speed_kmh AS DOUBLE) >= 20e0) AS absolute_frames,
                     count(*) FILTER (WHERE is_effort_frame) AS relative_frames
              FROM tagged WHERE player_id <> 'ball' AND speed_kmh IS NOT NULL)""",
    "topk_mean_speed": """, tk AS (
          SELECT player_id, CAST(speed_kmh AS DOUBLE) AS s,
                 row_number() OVER (PARTITION BY player_id ORDER BY speed_kmh DESC) AS rn
          FROM speed WHERE player_id <> 'ball' AND speed_kmh IS NOT NULL
        ), tp AS (
          SELECT player_id,
                 CASE WHEN count(*) >= 5 THEN sum(s) FILTER (WHERE rn <= 5) / 5 END AS top5_avg,
                 CASE WHEN count(*) >= 10 THEN sum(s) FILTER (WHERE rn <= 10) / 10 END AS top10_avg,
                 sum(s) FILTER (WHERE rn <= 25) / 25e0 AS top25_avg
          FROM tk WHERE rn <= 25 GROUP BY player_id
        )
        SELECT round(avg(top5_avg), 2) AS avg_top5, round(quantile_cont(top5_avg, 0.5), 2) AS median_top5,
               round(max(top5_avg), 2) AS max_top5, round(min(top5_avg), 2) AS min_top5,
               round(avg(top10_avg), 2) AS avg_top10, round(quantile_cont(top10_avg, 0.5), 2) AS median_top10,
               round(max(top10_avg), 2) AS max_top10, round(min(top10_avg), 2) AS min_top10,
               round(avg(top25_avg), 2) AS avg_top25, round(quantile_cont(top25_avg, 0.5), 2) AS median_top25,
               round(max(top25_avg), 2) AS max_top25, round(min(top25_avg), 2) AS min_top25
        FROM tp""",
    "relative_runs": "SELECT * FROM runs",
    "absolute_runs": "SELECT * FROM aruns",
    "absolute_run_counts": "SELECT * FROM abs_counts",
    "runs_min_duration": f"""SELECT {RUN_COLS}, 0.8e0 AS min_duration_sec FROM runs_all WHERE n_frames >= 20
        UNION ALL SELECT {RUN_COLS}, 1.2e0 AS min_duration_sec FROM runs_all WHERE n_frames >= 30""",
    "runs_enriched": "SELECT * FROM rx",
    "player_summary_lib": """SELECT s.*, v.vmax_kmh, v.low_confidence, CAST(s.runs / s.games AS FLOAT) AS rate
        FROM (SELECT player_id, count(*) AS runs, sum(CAST(distance_m AS DOUBLE)) AS metres,
                     avg(CAST(duration_sec AS DOUBLE)) AS seconds_per_run, avg(CAST(pct_of_vmax AS DOUBLE)) AS share_per_run,
                     avg(CAST(peak_speed_kmh AS DOUBLE)) AS peak_per_run, count(DISTINCT game_id) AS games
              FROM runs_lib GROUP BY player_id) s
        LEFT JOIN vm_lib v ON v.player_id = s.player_id""",
    "player_summary": "SELECT * FROM summary",
    "comparison_lib": """SELECT player_id, vmax_kmh, low_confidence, runs_relative, runs_absolute,
          CAST(vmax_kmh * 0.75e0 AS FLOAT) AS limit_kmh,
          runs_relative - runs_absolute AS delta,
          CASE WHEN runs_absolute > 0 THEN round((runs_relative - runs_absolute) / runs_absolute * 100, 1) END AS change_pct,
          CASE WHEN runs_relative - runs_absolute > 0 THEN 'gained' WHEN runs_relative - runs_absolute < 0 THEN 'lost'
               ELSE 'unchanged' END AS category
        FROM (SELECT v.player_id, v.vmax_kmh, v.low_confidence,
                     coalesce(r.n, 0) AS runs_relative, coalesce(a.n, 0) AS runs_absolute
              FROM vm_lib v
              LEFT JOIN (SELECT player_id, count(*) AS n FROM runs_lib GROUP BY player_id) r ON r.player_id = v.player_id
              LEFT JOIN (SELECT player_id, count(*) AS n FROM aruns GROUP BY player_id) a ON a.player_id = v.player_id
              WHERE NOT v.low_confidence)""",
    "definition_comparison": "SELECT * FROM comparison",
    "category_counts": """SELECT category, count(*) AS players FROM comparison GROUP BY category""",
    "games_per_player": """SELECT player_id, count(DISTINCT game_id) AS games FROM runs GROUP BY player_id""",
    "team_lookup": "SELECT team_id, team_name, team_short FROM teams",
    "player_lookup": "SELECT * FROM plk",
    "bronze_audit": "SELECT game_id, count(*) AS n_frames, count(DISTINCT player_id) AS n_players FROM tracking GROUP BY game_id",
    "silver_audit": """SELECT count(*) AS total_frames, count(*) FILTER (WHERE is_effort_frame) AS effort_frames,
        round(count(*) FILTER (WHERE is_effort_frame) / nullif(count(*), 0) * 100, 2) AS effort_pct
        FROM tagged WHERE player_id <> 'ball'""",
    "gold_audit": """SELECT 'runs' AS "table", count(*) AS "rows" FROM rx
        UNION ALL SELECT 'comparison', count(*) FROM comparison
        UNION ALL SELECT 'player_summary', count(*) FROM summary""",
    "q_position": """SELECT position, count(*) AS players, round(avg(rate), 2) AS rate, round(avg(metres_per_game), 1) AS metres_per_game,
        round(avg(effort_pct), 1) AS effort_pct, round(avg(vmax_kmh), 2) AS vmax_kmh, round(avg(limit_kmh), 2) AS limit_kmh
        FROM summary GROUP BY position""",
    "q_team": """SELECT team_name, team_short, count(*) AS players, sum(runs) AS runs, round(avg(rate), 2) AS rate,
        round(avg(metres_per_game), 1) AS metres_per_game, round(avg(peak_kmh), 2) AS peak_kmh, round(avg(vmax_kmh), 2) AS vmax_kmh
        FROM summary GROUP BY team_name, team_short""",
    "team_outperformance": """SELECT team_name, team_short, sum(runs_relative) AS runs_relative, sum(runs_absolute) AS runs_absolute,
        sum(delta) AS delta, round((sum(runs_relative) - sum(runs_absolute)) / nullif(sum(runs_absolute), 0) * 100, 1) AS change_pct,
        count(*) FILTER (WHERE category = 'gained') AS gained, count(*) FILTER (WHERE category = 'lost') AS lost, count(*) AS players
        FROM comparison GROUP BY team_name, team_short""",
    "top20_players": """SELECT player_id, player_name, team_name, position, jersey_number, vmax_kmh, limit_kmh, games, runs, rate,
        metres_per_game, effort_pct, peak_kmh FROM summary ORDER BY rate DESC, player_id LIMIT 20""",
    "most_affected": """SELECT player_id, player_name, team_name, position, vmax_kmh, limit_kmh, runs_absolute,
        runs_relative, delta, change_pct, category FROM comparison ORDER BY abs(delta) DESC, player_id LIMIT 30""",
    "pitch_thirds_by_position": """SELECT pitch_zone, position, count(*) AS runs, round(avg(CAST(duration_sec AS DOUBLE)), 2) AS seconds_per_run,
        round(avg(CAST(distance_m AS DOUBLE)), 1) AS metres_per_run, round(avg(CAST(peak_speed_kmh AS DOUBLE)), 2) AS peak_per_run,
        round(avg(CAST(pct_of_vmax AS DOUBLE)) * 100, 1) AS effort_pct
        FROM (SELECT *, CASE WHEN start_x < -17.5e0 THEN 'Defensive third' WHEN start_x < 17.5e0 THEN 'Middle third'
                             ELSE 'Attacking third' END AS pitch_zone FROM rx)
        GROUP BY pitch_zone, position""",
    "fastest_players": """SELECT player_id, round(vmax_kmh, 6) AS vmax_kmh, frame_count,
        round(speed_threshold_kmh, 2) AS speed_threshold_kmh
        FROM vm WHERE NOT low_confidence ORDER BY round(vmax_kmh, 6) DESC, player_id LIMIT 20""",
    "fewest_absolute": "SELECT * FROM abs_counts ORDER BY runs_absolute, player_id LIMIT 10",
    "dynamic_counts": "SELECT * FROM dyn",
    "summary_dynamic": """SELECT player_id, runs, runs_now, games_now, rate_now, peak_per_run_now, effort_pct_now, threshold_at_pct FROM sdyn""",
    "comparison_dynamic": """SELECT player_id, runs_relative, runs_absolute, runs_absolute_now, runs_relative_now,
        delta, change_pct, category, threshold_at_pct, above_absolute FROM cdyn""",
    "kpis": """SELECT count(*) AS n_players, avg(vmax_kmh) AS avg_vmax, avg(rate_now) AS avg_runs,
        max(peak_kmh) AS top_speed, count(*) FILTER (WHERE threshold_at_pct < 20e0) AS n_below_20,
        CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE threshold_at_pct < 20e0) / count(*) * 100 ELSE 0e0 END AS pct_below
        FROM fs""",
    "top_players": """SELECT player_id, player_name, team_short, pos, rate_now, vmax_kmh, games
        FROM fs ORDER BY rate_now DESC, player_id LIMIT 20""",
    "zone30_player": "SELECT * FROM z30",
    "zone30_top3": """SELECT player_id, player_name, rank, "row", col, n_runs, pct,
        (['right channel', 'right half-space', 'central channel', 'left half-space', 'left channel'])["row" + 1] AS channel,
        (['defensive third', 'defensive third', 'middle third', 'middle third', 'attacking third', 'attacking third'])[col + 1]
          AS third
        FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY n_runs DESC, "row", col) AS rank
              FROM z30 WHERE n_runs > 0) WHERE rank <= 3""",
    "player_table": """SELECT player_id, player_name, team_name, pos, pos_detail, games, round(vmax_kmh, 1) AS vmax_kmh,
        round(threshold_at_pct, 1) AS threshold_at_pct, runs_now, rate_now,
        round(metres_per_game, 0) AS metres_per_game, round(peak_per_run_now, 1) AS peak_per_run_now,
        least(effort_pct, 100e0) AS effort_pct,
        round(peak_kmh, 1) AS peak_kmh FROM fs""",
    "team_profile": "SELECT * FROM tprof",
    "team_distance_top16": "SELECT * FROM tprof ORDER BY metres_per_game DESC, team_name LIMIT 16",
    "position_profile": "SELECT * FROM pprof",
    "position_radar": f""", rl AS ({_RADAR})
        SELECT position, metric,
               round((v - min(v) OVER (PARTITION BY metric))
                     / (max(v) OVER (PARTITION BY metric) - min(v) OVER (PARTITION BY metric) + 1e-9) * 100, 1) AS value
        FROM rl""",
    "run_delta_histogram": """, hb AS (
          SELECT lo, hi, CASE WHEN hi > lo THEN (hi - lo) / 30e0 ELSE 1e0 END AS w
          FROM (SELECT min(delta) AS lo, max(delta) AS hi FROM fc)
        ), hv AS (
          SELECT f.category, CAST(least(floor((f.delta - hb.lo) / hb.w), 29) AS INTEGER) AS bin, hb.lo, hb.w
          FROM fc f, hb
        )
        SELECT category, bin, count(*) AS n_players, round(min(lo + bin * w), 6) AS bin_start
        FROM hv GROUP BY category, bin""",
    "team_outperformance_dynamic": """SELECT team_name, team_short, sum(runs_relative) AS runs_relative, sum(runs_absolute) AS runs_absolute,
        sum(delta) AS delta, count(*) FILTER (WHERE category = 'gained') AS gained, count(*) FILTER (WHERE category = 'lost') AS lost,
        count(player_name) AS named_players,
        round((sum(runs_relative) - sum(runs_absolute)) / greatest(sum(runs_absolute), 1) * 100, 1) AS change_pct
        FROM fc WHERE team_name IS NOT NULL AND team_short IS NOT NULL GROUP BY team_name, team_short""",
    "most_affected_dynamic": """SELECT player_id, player_name, team_short, pos, pos_detail, vmax_kmh, threshold_at_pct,
        runs_absolute_now, runs_relative_now, delta, change_pct, category FROM fc""",
    "pitch_thirds": """SELECT pitch_zone, count(*) AS runs, avg(CAST(duration_sec AS DOUBLE)) AS seconds_per_run,
        avg(CAST(distance_m AS DOUBLE)) AS metres_per_run, avg(CAST(peak_speed_kmh AS DOUBLE)) AS peak_per_run,
        avg(CAST(pct_of_vmax AS DOUBLE)) * 100 AS effort_pct
        FROM (SELECT *, CASE WHEN start_x > -53e0 AND start_x <= -17.5e0 THEN 'Defensive third'
                             WHEN start_x > -17.5e0 AND start_x <= 17.5e0 THEN 'Middle third'
                             WHEN start_x > 17.5e0 AND start_x <= 53e0 THEN 'Attacking third' END AS pitch_zone
              FROM app_runs)
        WHERE pitch_zone IS NOT NULL GROUP BY pitch_zone""",
    "pitch_thirds_by_group": """SELECT pitch_zone, pos, count(*) AS n_runs
        FROM (SELECT *, CASE WHEN start_x > -53e0 AND start_x <= -17.5e0 THEN 'Defensive third'
                             WHEN start_x > -17.5e0 AND start_x <= 17.5e0 THEN 'Middle third'
                             WHEN start_x > 17.5e0 AND start_x <= 53e0 THEN 'Attacking third' END AS pitch_zone
              FROM app_runs)
        WHERE pitch_zone IS NOT NULL AND pos IS NOT NULL GROUP BY pitch_zone, pos""",
    "zone9_heatmap": _zone9_sql("pitch", []).replace("SELECT g.zone", "SELECT g.zone", 1),
    "match_runs": "SELECT game_id, player_id, period_id, run_id, pct_of_vmax FROM mruns",
    "match_top_performers": """SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY runs DESC, player_id) AS rank
        FROM (SELECT game_id, player_id, player_name, team_short, pos, count(*) AS runs,
                     round(sum(CAST(distance_m AS DOUBLE)), 0) AS metres, round(CAST(max(peak_speed_kmh) AS DOUBLE), 1) AS peak_kmh,
                     round(avg(CAST(peak_speed_kmh AS DOUBLE)), 1) AS peak_per_run,
                     round(avg(CAST(pct_of_vmax AS DOUBLE)) * 100, 1) AS effort_pct
              FROM mruns WHERE player_name IS NOT NULL AND team_short IS NOT NULL AND pos IS NOT NULL
              GROUP BY game_id, player_id, player_name, team_short, pos)""",
    "match_team_comparison": """SELECT game_id, team_short, count(*) AS runs, count(DISTINCT player_id) AS players,
        sum(CAST(distance_m AS DOUBLE)) AS metres, max(peak_speed_kmh) AS peak_kmh, avg(CAST(peak_speed_kmh AS DOUBLE)) AS peak_per_run,
        round(avg(CAST(pct_of_vmax AS DOUBLE)) * 100, 1) AS effort_pct
        FROM mruns WHERE team_short IS NOT NULL GROUP BY game_id, team_short""",
    "match_position": """SELECT game_id, pos, count(*) AS runs, avg(CAST(peak_speed_kmh AS DOUBLE)) AS peak_per_run,
        round(avg(CAST(pct_of_vmax AS DOUBLE)) * 100, 1) AS effort_pct
        FROM mruns WHERE pos IS NOT NULL GROUP BY game_id, pos""",
    "match_zone9": _zone9_sql("mruns", ["game_id"]),
    "match_header": """SELECT game_id, home_team_name, away_team_name, substr(date, 1, 10) AS date, stadium_name, "Round", week
        FROM matches""",
    "threshold_sweep": """, rel AS (
          SELECT t.threshold_pct, r.player_id, count(*) AS n, count(DISTINCT r.game_id) AS g
          FROM app_runs r JOIN sweep_t t ON CAST(r.pct_of_vmax AS DOUBLE) >= t.threshold_pct
          GROUP BY t.threshold_pct, r.player_id
        ), base AS (
          SELECT t.threshold_pct, c.player_id, coalesce(rel.n, 0) AS runs_now, coalesce(rel.g, 0) AS games_now,
                 coalesce(ac.runs_absolute, 0) AS runs_absolute_now
          FROM app_comparison c CROSS JOIN sweep_t t
          LEFT JOIN rel ON rel.threshold_pct = t.threshold_pct AND rel.player_id = c.player_id
          LEFT JOIN abs_counts ac ON ac.player_id = c.player_id
        )
        SELECT threshold_pct, player_id, runs_now, games_now,
               round(runs_now / greatest(games_now, 1), 2) AS rate_now,
               runs_absolute_now, runs_now - runs_absolute_now AS delta,
               round((runs_now - runs_absolute_now) / greatest(runs_absolute_now, 1) * 100, 1) AS change_pct,
               CASE WHEN runs_now - runs_absolute_now > 0 THEN 'gained'
                    WHEN runs_now - runs_absolute_now < 0 THEN 'lost' ELSE 'unchanged' END AS category
        FROM base""",
    "round_summary": """SELECT a.*, g.games, round(a.runs / greatest(g.games, 1), 1) AS rate
        FROM (SELECT m_round AS "Round", count(*) AS runs, avg(CAST(duration_sec AS DOUBLE)) AS seconds_per_run,
                     avg(CAST(distance_m AS DOUBLE)) AS metres_per_run, avg(CAST(peak_speed_kmh AS DOUBLE)) AS peak_per_run,
                     round(avg(CAST(pct_of_vmax AS DOUBLE)) * 100, 1) AS effort_pct
              FROM phase WHERE m_round IS NOT NULL GROUP BY m_round) a
        LEFT JOIN gpr g ON g."Round" = a."Round" """,
    "week_trend": """SELECT *, round(runs / greatest(games, 1), 1) AS rate
        FROM (SELECT m.week AS week, m."Round" AS "Round", count(*) AS runs, count(DISTINCT m.game_id) AS games,
                     avg(CAST(r.peak_speed_kmh AS DOUBLE)) AS peak_per_run,
                     round(avg(CAST(r.pct_of_vmax AS DOUBLE)) * 100, 1) AS effort_pct
              FROM app_runs r LEFT JOIN matches m ON m.game_id = CAST(r.game_id AS VARCHAR)
              WHERE CAST(r.pct_of_vmax AS DOUBLE) >= 0.8e0 AND m.week IS NOT NULL AND m."Round" IS NOT NULL
              GROUP BY m.week, m."Round")""",
    "position_by_round": """SELECT a.*, g.games, round(a.runs / greatest(g.games, 1), 2) AS rate
        FROM (SELECT m_round AS "Round", pos, count(*) AS runs FROM phase
              WHERE m_round IS NOT NULL AND pos IS NOT NULL GROUP BY m_round, pos) a
        LEFT JOIN gpr g ON g."Round" = a."Round" """,
    "games_per_round": "SELECT * FROM gpr",
}
BODIES["effort_pipeline"] = BODIES["player_summary_lib"]


_RUN = "s player_id game_id, l period_id run_id start_frame_id end_frame_id, d duration_sec peak_speed_kmh mean_speed_kmh vmax_kmh pct_of_vmax distance_m start_x start_y end_x end_y"
_FRAME = "s game_id team_id player_id, l frame_id period_id timestamp, d x y"
_SUMMARY = "s player_id player_name team_name team_short position, l jersey_number games runs, b is_starter low_confidence, d vmax_kmh limit_kmh rate metres metres_per_game seconds_per_run effort_pct peak_kmh peak_per_run"
_GRID = "s channel third, l zone n_runs, d pct avg_peak_speed intensity"

#: expected columns of each statement: s string, l bigint, d double (6 places), b boolean
COLUMNS: dict[str, str] = {
    "scan_tracking": _FRAME + " z, s ball_state ball_owning_team_id",
    "normalise_tracking": _FRAME + " z, s ball_state ball_owning_team_id _ingested_at",
    "ball_filter": _FRAME,
    "absolute_frames": "s player_id game_id, l frame_id, d speed_kmh",
    "position_rollup": "s player_id position pos pos_detail",
    "qualifying_runs": "s player_id game_id team_short pos, l period_id run_id, d pct_of_vmax",
    "filtered_summary": "s player_id team_short pos, l games runs_now, d rate_now peak_per_run_now threshold_at_pct",
    "filtered_comparison": "s player_id team_short pos category, l games runs_absolute_now runs_relative_now delta, d change_pct",
    "pitch_runs_fallback": "s player_id game_id team_short pos, l period_id run_id",
    "match_labels": "s game_id date label",
    "team_options": "s team_short",
    "threshold_columns": "s player_id, b above_absolute, d vmax_kmh threshold_at_pct new_threshold_vs_20 breakeven_vmax_kmh",
    "frame_speed": "s player_id game_id, l frame_id period_id, d speed_kmh",
    "vmax_exact": "s player_id, l frame_count, b low_confidence, d vmax_kmh speed_threshold_kmh",
    "vmax_per_game": "s player_id game_id, l frame_count, b low_confidence, d vmax_kmh speed_threshold_kmh",
    "relative_threshold": "s player_id, d vmax_kmh speed_threshold_kmh",
    "tagged_frames": "s player_id game_id, l frame_id, d speed_kmh speed_threshold_kmh, b low_confidence is_effort_frame",
    "definition_preview": "l frames absolute_frames relative_frames extra_frames, d absolute_pct relative_pct",
    "topk_mean_speed": "d avg_top5 median_top5 max_top5 min_top5 avg_top10 median_top10 max_top10 min_top10 avg_top25 median_top25 max_top25 min_top25",
    "relative_runs": _RUN,
    "absolute_runs": _RUN,
    "absolute_run_counts": "s player_id, l runs_absolute n_games_absolute",
    "runs_min_duration": _RUN + " min_duration_sec",
    "runs_enriched": _RUN + ", s player_name team_name team_short position date home_team_name away_team_name competition_name stadium_name, l week",
    "player_summary_lib": "s player_id, l runs games, b low_confidence, d metres seconds_per_run share_per_run peak_per_run vmax_kmh rate",
    "effort_pipeline": "s player_id, l runs games, b low_confidence, d metres seconds_per_run share_per_run peak_per_run vmax_kmh rate",
    "player_summary": _SUMMARY,
    "comparison_lib": "s player_id category, l runs_relative runs_absolute delta, b low_confidence, d vmax_kmh limit_kmh change_pct",
    "definition_comparison": "s player_id player_name team_name team_short position category, l jersey_number games runs_absolute runs_relative delta, d vmax_kmh limit_kmh change_pct rate_absolute rate_relative",
    "category_counts": "s category, l players",
    "games_per_player": "s player_id, l games",
    "team_lookup": "s team_id team_name team_short",
    "player_lookup": "s player_id player_name team_id team_name team_short position, l jersey_number, b is_starter",
    "bronze_audit": "s game_id, l n_frames n_players",
    "silver_audit": "l total_frames effort_frames, d effort_pct",
    "gold_audit": "s table, l rows",
    "q_position": "s position, l players, d rate metres_per_game effort_pct vmax_kmh limit_kmh",
    "q_team": "s team_name team_short, l players runs, d rate metres_per_game peak_kmh vmax_kmh",
    "team_outperformance": "s team_name team_short, l runs_relative runs_absolute delta gained lost players, d change_pct",
    "top20_players": "s player_id player_name team_name position, l jersey_number games runs, d vmax_kmh limit_kmh rate metres_per_game effort_pct peak_kmh",
    "most_affected": "s player_id player_name team_name position category, l runs_absolute runs_relative delta, d vmax_kmh limit_kmh change_pct",
    "pitch_thirds_by_position": "s pitch_zone position, l runs, d seconds_per_run metres_per_run peak_per_run effort_pct",
    "fastest_players": "s player_id, l frame_count, d vmax_kmh speed_threshold_kmh",
    "fewest_absolute": "s player_id, l runs_absolute n_games_absolute",
    "dynamic_counts": "s player_id, l runs_now games_now, d effort_pct_now seconds_per_run_now metres_now peak_per_run_now rate_now",
    "summary_dynamic": "s player_id, l runs runs_now games_now, d rate_now peak_per_run_now effort_pct_now threshold_at_pct",
    "comparison_dynamic": "s player_id category, l runs_relative runs_absolute runs_absolute_now runs_relative_now delta, b above_absolute, d change_pct threshold_at_pct",
    "kpis": "l n_players n_below_20, d avg_vmax avg_runs top_speed pct_below",
    "top_players": "s player_id player_name team_short pos, l games, d rate_now vmax_kmh",
    "zone30_player": "s player_id player_name, l zone row col n_runs, d speed_sum pct intensity",
    "zone30_top3": "s player_id player_name channel third, l rank row col n_runs, d pct",
    "player_table": "s player_id player_name team_name pos pos_detail, l games runs_now, d vmax_kmh threshold_at_pct rate_now metres_per_game peak_per_run_now effort_pct peak_kmh",
    "team_profile": "s team_name team_short, l named_players runs_now, d rate_now metres_per_game effort_pct peak_kmh vmax_kmh",
    "team_distance_top16": "s team_name team_short, l named_players runs_now, d rate_now metres_per_game effort_pct peak_kmh vmax_kmh",
    "position_profile": "s position, l named_players, d rate_now metres_per_game effort_pct peak_kmh vmax_kmh limit_kmh",
    "position_radar": "s position metric, d value",
    "run_delta_histogram": "s category, l bin n_players, d bin_start",
    "team_outperformance_dynamic": "s team_name team_short, l runs_relative runs_absolute delta gained lost named_players, d change_pct",
    "most_affected_dynamic": "s player_id player_name team_short pos pos_detail category, l runs_absolute_now runs_relative_now delta, d vmax_kmh threshold_at_pct change_pct",
    "pitch_thirds": "s pitch_zone, l runs, d seconds_per_run metres_per_run peak_per_run effort_pct",
    "pitch_thirds_by_group": "s pitch_zone pos, l n_runs",
    "zone9_heatmap": _GRID,
    "match_runs": "s game_id player_id, l period_id run_id, d pct_of_vmax",
    "match_top_performers": "s game_id player_id player_name team_short pos, l runs rank, d metres peak_kmh peak_per_run effort_pct",
    "match_team_comparison": "s game_id team_short, l runs players, d metres peak_kmh peak_per_run effort_pct",
    "match_position": "s game_id pos, l runs, d peak_per_run effort_pct",
    "match_zone9": _GRID + ", s game_id",
    "match_header": "s game_id home_team_name away_team_name date stadium_name Round, l week",
    "threshold_sweep": "s player_id category, l runs_now games_now runs_absolute_now delta, d threshold_pct rate_now change_pct",
    "round_summary": "s Round, l runs games, d seconds_per_run metres_per_run peak_per_run effort_pct rate",
    "week_trend": "s Round, l week runs games, d peak_per_run effort_pct rate",
    "position_by_round": "s Round pos, l runs games, d rate",
    "games_per_round": "s Round, l games",
}


def _schema(spec: str) -> list[tuple[str, str]]:
    return [(name, kind) for kind, *names in (part.split() for part in spec.split(",")) for name in names]


def _normalised(body: str, schema: list[tuple[str, str]]) -> str:
    """Wrap a statement so its output types/rounding match ``normalise``."""
    exprs = []
    for name, kind in schema:
        q = f'"{name}"'
        if kind == "d":
            exprs.append(f"round(CAST(q.{q} AS DOUBLE), 6) AS {q}")
        elif kind == "l":
            exprs.append(f"CAST(q.{q} AS BIGINT) AS {q}")
        elif kind == "s":
            exprs.append(f"CAST(q.{q} AS VARCHAR) AS {q}")
        else:
            exprs.append(f"q.{q}")
    if body.lstrip().startswith(","):
        ctes, final = _split_ctes(body)
        return f"{PREFIX}{ctes}\nSELECT {', '.join(exprs)} FROM ({final}) AS q"
    return f"{PREFIX}\nSELECT {', '.join(exprs)} FROM ({body}) AS q"


def _split_ctes(body: str) -> tuple[str, str]:
    """Split ", x AS (...), y AS (...) SELECT ..." before the first SELECT
    that is outside every parenthesis."""
    depth = 0
    upper = body.upper()
    for i, ch in enumerate(body):
        if ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif depth == 0 and upper.startswith("SELECT", i) and not body[i - 1].isalnum():
            return body[:i], body[i:]
    raise ValueError("no final SELECT")


def _args(sql: str, start: int) -> tuple[list[str], int]:
    """Top-level comma-separated arguments of the call whose "(" is at
    ``start``; returns (args, index after the closing parenthesis)."""
    depth, cur, out, i = 0, start + 1, [], start
    quote = False
    while True:
        ch = sql[i]
        if ch == "'":
            quote = not quote
        elif not quote and ch == "(":
            depth += 1
        elif not quote and ch == ")":
            depth -= 1
            if depth == 0:
                out.append(sql[cur:i])
                return out, i + 1
        elif not quote and ch == "," and depth == 1:
            out.append(sql[cur:i])
            cur = i + 1
        i += 1


def stable_round(sql: str) -> str:
    """Rewrite ``round(a, n)`` as rounding to 10 places first (through an
    exact decimal), then to ``n`` places, half away from zero: the same
    two-step rule as the Spark side, immune to float summation noise."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i : j + 6])
            i = j + 6
            continue
        args, end = _args(sql, j + 5)
        out.append(sql[i:j])
        if len(args) == 2:
            inner = stable_round(args[0])
            out.append(
                f"CAST(round(CAST(CAST({inner} AS DOUBLE) AS DECIMAL(38, 10)), {args[1].strip()}) AS DOUBLE)"
            )
        else:
            out.append(f"round({stable_round(','.join(args))})")
        i = end


BODIES["sweep_runs"] = f""", tsw AS (
  SELECT s.game_id, s.frame_id, s.period_id, s.timestamp, s.x, s.y, s.speed_kmh, s.vmax_kmh,
         CAST(t.threshold_pct AS VARCHAR) || '|' || s.player_id AS player_id
  FROM tagged s CROSS JOIN sweep_t t
  WHERE s.player_id <> 'ball' AND NOT s.low_confidence AND s.speed_kmh IS NOT NULL
    AND CAST(s.speed_kmh AS DOUBLE) >= round(s.vmax_kmh * t.threshold_pct, 2)
),
{_run_chain("_sw", "tsw", "true", "vmax_kmh")}
swr AS (SELECT {RUN_COLS} FROM runs_all_sw WHERE n_frames >= 25)
SELECT * REPLACE (split_part(player_id, '|', 2) AS player_id), CAST(split_part(player_id, '|', 1) AS DOUBLE) AS threshold_pct FROM swr"""
COLUMNS["sweep_runs"] = _RUN + " threshold_pct"
BODIES["vmax_sketch"] = "SELECT player_id, frame_count, true AS within_bound FROM vm"
COLUMNS["vmax_sketch"] = "s player_id, l frame_count, b within_bound"
BODIES["vmax_approx_bound"], COLUMNS["vmax_approx_bound"] = BODIES["vmax_sketch"], COLUMNS["vmax_sketch"]

BODIES["distinct_players"] = "SELECT game_id, count(DISTINCT player_id) AS players FROM runs GROUP BY game_id"
COLUMNS["distinct_players"] = "s game_id, l players"

BODIES["match_documents"] = "SELECT * FROM matches"
COLUMNS["match_documents"] = "s game_id date season competition_id competition_name stadium_name home_team_id home_team_name home_team_short away_team_id away_team_name away_team_short Round, d pitch_length pitch_width fps, l week"

# the store's tables after its batches are those of all games at once, and the
# cube's views those of the runs
_CUBE = "dynamic_counts kpis zone30_player team_profile pitch_thirds zone9_heatmap match_top_performers match_team_comparison match_position match_zone9"
for _key, _same in {
    **{f"cube_{view}": view for view in _CUBE.split()},
    "json_frames": "scan_tracking",
    "written_runs": "relative_runs",
    "csv_comparison": "definition_comparison",
    "distinct_games": "games_per_player",
    "store_runs": "relative_runs",
    "store_vmax": "vmax_exact",
    "store_tagged_frames": "tagged_frames",
    "store_comparison": "definition_comparison",
    "store_summary": "player_summary",
}.items():
    BODIES[_key], COLUMNS[_key] = BODIES[_same], COLUMNS[_same]


def oracle_sql() -> dict[str, str]:
    return {k: stable_round(_normalised(BODIES[k], _schema(COLUMNS[k]))) for k in BODIES}
