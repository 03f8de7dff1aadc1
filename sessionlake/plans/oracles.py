"""DuckDB SQL for the registered queries: common table expressions of their own, and a last SELECT for each query."""

from __future__ import annotations

from itertools import combinations

HORIZONS = (1, 3, 7)
ROLLING = (3, 5)
METRICS = ("state_entropy", "unique_states", "dominant_state_share", "self_transition_ratio")
NUMERIC = ("duration_minutes", "days_since_previous_session", "player_lifetime_days", "jobs_started", "jobs_resumed", "jobs_completed", "jobs_exited", "tasks_completed", "items_purchased", "job_completion_ratio", "job_exit_ratio", "progression_gain", "campaign_progression_gain", "mode_diversity")
ACTIVITY = ("jobs_started", "jobs_resumed", "jobs_completed", "jobs_exited", "tasks_completed", "items_purchased")
DISCOVERY = ("first_session", "no_started_or_resumed_job", "log_duration_minutes", "log_gap_days", "log_jobs_started", "log_jobs_resumed", "log_tasks_completed", "purchase_any", "job_completion_ratio_capped", "job_exit_ratio_capped", "progression_gain", "mode_diversity")


def r(x: str) -> str:
    return f"round({x}, 6)"


def q(x: str, p: float) -> str:
    return f"round(quantile_cont({x}, {p}), 6)"


def cols(*pairs: tuple[str, str]) -> str:
    return ", ".join(f"{a} AS {b}" for a, b in pairs)


def tagged(kind: str, values: tuple, make) -> str:
    return f" {kind} ".join(make(v) for v in values)


EVENTS_SUM = " + ".join(ACTIVITY)

_LABELS = ", ".join(f"(coalesce(gap <= {d}, false) OR left_days >= {d}) AS evaluable_{d}d, NOT (coalesce(gap <= {d}, false) OR left_days >= {d}) AS censored_{d}d, (left_days >= {d} AND NOT coalesce(gap <= {d}, false)) AS disengaged_{d}d" for d in HORIZONS)


def _rolling(w: int) -> str:
    n = f"len(l{w})"
    share = f"list_transform(list_distinct(l{w}), lambda s: len(list_filter(l{w}, lambda t: t = s)) / {n}::DOUBLE)"
    return (
        f"{n} AS window_n_w{w}, -list_sum(list_transform({share}, lambda p: p * log2(p))) AS state_entropy_w{w}, len(list_distinct(l{w})) AS unique_states_w{w}, "
        f"list_max({share}) AS dominant_state_share_w{w}, CASE WHEN {n} >= 2 THEN len(list_filter(range(1, {n}), lambda i: l{w}[i] = l{w}[i + 1])) / ({n} - 1)::DOUBLE END AS self_transition_ratio_w{w}"
    )


BASE = f"""
ev AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS pid, epoch_us(ts) AS t, value, event_type, TRY_CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
ev2 AS (
  SELECT *, CASE event_type WHEN 'view' THEN 'player_logged_in' WHEN 'error' THEN 'exited_game' WHEN 'purchase' THEN 'item_purchased'
    WHEN 'signup' THEN CASE WHEN k < 50 THEN 'job_started' ELSE 'job_resumed' END
    WHEN 'click' THEN CASE WHEN k < 70 THEN 'task_completed' WHEN k < 85 THEN 'job_completed' ELSE 'job_exited' END END AS event_table FROM ev),
tel AS (
  SELECT event_id, pid, t, event_table,
    CASE WHEN event_table IN ('job_started', 'job_resumed', 'job_exited', 'job_completed', 'exited_game') THEN CASE WHEN k % 10 = 0 THEN '' ELSE list_element(['Career', 'FreePlay', 'Special', 'Challenge'], k % 4 + 1) END END AS game_mode,
    CASE WHEN event_table IN ('job_resumed', 'job_exited', 'task_completed', 'exited_game') THEN value / 100.0 END AS level_progress,
    CASE WHEN event_table IN ('job_completed', 'item_purchased', 'exited_game') THEN k / 100.0 END AS campaign_progress
  FROM ev2 WHERE event_table IS NOT NULL),
marks AS (
  SELECT *, CASE WHEN event_table = 'exited_game' THEN 1 ELSE 0 END AS kind FROM tel WHERE event_table IN ('player_logged_in', 'exited_game')),
ahead AS (SELECT *, lead(kind) OVER w AS next_kind, lead(t) OVER w AS next_t FROM marks WINDOW w AS (PARTITION BY pid ORDER BY t, kind, event_id)),
sess0 AS (SELECT pid, t AS login, next_t AS exit_, row_number() OVER (PARTITION BY pid ORDER BY t, event_id) AS session_index FROM ahead WHERE kind = 0 AND next_kind = 1),
sess AS (
  SELECT pid || '_s' || CASE WHEN session_index < 10000 THEN lpad(session_index::VARCHAR, 4, '0') ELSE session_index::VARCHAR END AS session_id, pid, session_index, login, exit_,
    (exit_ - login) / 1e6 AS duration_seconds, (exit_ - login) / 1e6 / 60.0 AS duration_minutes,
    (login - lag(exit_) OVER (PARTITION BY pid ORDER BY session_index)) / 1e6 / 86400.0 AS days_since_previous_session,
    (login - min(login) OVER (PARTITION BY pid)) / 1e6 / 86400.0 AS player_lifetime_days, exit_ = login AS is_zero_duration, (exit_ - login) / 1e6 > 43200 AS is_long
  FROM sess0),
asg AS (
  SELECT tel.*, s.session_id, s.session_index FROM tel LEFT JOIN sess s ON tel.pid = s.pid AND tel.t BETWEEN s.login AND s.exit_ WHERE event_table <> 'player_logged_in'),
cnt AS (
  SELECT session_id, any_value(pid) AS pid, any_value(session_index) AS session_index, {", ".join(f"count(*) FILTER (event_table = '{t}') AS {c}" for t, c in (("job_started", "jobs_started"), ("job_resumed", "jobs_resumed"), ("job_completed", "jobs_completed"), ("job_exited", "jobs_exited"), ("task_completed", "tasks_completed"), ("item_purchased", "items_purchased"), ("exited_game", "exit_events_matched")))},
    count(DISTINCT nullif(game_mode, '')) AS mode_diversity, max(level_progress) - min(level_progress) AS progression_gain, max(campaign_progress) - min(campaign_progress) AS campaign_progression_gain
  FROM asg WHERE session_id IS NOT NULL GROUP BY session_id),
md AS (
  SELECT session_id, game_mode FROM (SELECT session_id, game_mode, row_number() OVER (PARTITION BY session_id ORDER BY count(*) DESC, game_mode) AS n FROM asg WHERE session_id IS NOT NULL AND game_mode <> '' GROUP BY session_id, game_mode) WHERE n = 1),
feat AS (
  SELECT s.*, {", ".join(f"coalesce(c.{x}, 0) AS {x}" for x in (*ACTIVITY, "exit_events_matched", "mode_diversity"))}, c.progression_gain, c.campaign_progression_gain, coalesce(md.game_mode, '') AS primary_game_mode,
    c.jobs_completed / nullif(c.jobs_started + c.jobs_resumed, 0)::DOUBLE AS job_completion_ratio, c.jobs_exited / nullif(c.jobs_started + c.jobs_resumed, 0)::DOUBLE AS job_exit_ratio
  FROM sess s LEFT JOIN cnt c USING (session_id) LEFT JOIN md USING (session_id)),
caps AS (SELECT {", ".join(f"quantile_cont({c}::DOUBLE, 0.99) AS {c}" for c in ("duration_minutes", "days_since_previous_session", "jobs_started", "jobs_resumed", "tasks_completed", "progression_gain"))} FROM feat),
disc AS (
  SELECT session_id, feat.pid, session_index, CASE WHEN feat.days_since_previous_session IS NULL THEN 1 ELSE 0 END AS first_session, CASE WHEN feat.jobs_started + feat.jobs_resumed = 0 THEN 1 ELSE 0 END AS no_started_or_resumed_job,
    {", ".join(f"ln(1 + coalesce(greatest(0.0, least(feat.{c}::DOUBLE, caps.{c})), 0.0) * (feat.{c} IS NOT NULL)::INT) AS {n}" for c, n in (("duration_minutes", "log_duration_minutes"), ("jobs_started", "log_jobs_started"), ("jobs_resumed", "log_jobs_resumed"), ("tasks_completed", "log_tasks_completed"), ("days_since_previous_session", "log_gap_days")))},
    CASE WHEN items_purchased > 0 THEN 1 ELSE 0 END AS purchase_any, CASE WHEN job_completion_ratio IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, job_completion_ratio)) END AS job_completion_ratio_capped,
    CASE WHEN job_exit_ratio IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, job_exit_ratio)) END AS job_exit_ratio_capped,
    CASE WHEN feat.progression_gain IS NULL THEN 0.0 ELSE greatest(0.0, least(feat.progression_gain, caps.progression_gain)) END AS progression_gain, mode_diversity::DOUBLE AS mode_diversity
  FROM feat, caps),
stt AS (
  SELECT *, CASE WHEN {EVENTS_SUM} = 0 THEN 4 WHEN session_index = 1 THEN 0 WHEN mode_diversity >= 2 THEN 3 WHEN tasks_completed + jobs_completed >= 1 THEN 1 ELSE 2 END AS state_id,
    items_purchased > 0 AND {" + ".join(ACTIVITY[:-1])} = 0 AS is_purchase_anomaly,
    CAST(make_timestamp(login) AS DATE) BETWEEN DATE '2024-01-14' AND DATE '2024-01-16' AS is_window, strftime(make_timestamp(login), '%Y-%m') AS month
  FROM feat),
st AS (
  SELECT *, lag(state_id) OVER w AS prev_state_id, lead(state_id) OVER w AS next_state_id, lead(session_id) OVER w AS next_session_id, lead(login) OVER w AS next_login, count(*) OVER (PARTITION BY pid) AS total_sessions
  FROM stt WINDOW w AS (PARTITION BY pid ORDER BY session_index)),
edg AS (SELECT pid, session_index, session_id AS from_session_id, next_session_id AS to_session_id, state_id AS from_state, next_state_id AS to_state, (next_login - exit_) / 1e6 / 86400.0 AS gap_days, is_window, is_purchase_anomaly FROM st WHERE next_session_id IS NOT NULL),
edw AS (SELECT pid, from_state, to_state FROM (SELECT pid, state_id AS from_state, lead(state_id) OVER (PARTITION BY pid ORDER BY session_index) AS to_state FROM stt WHERE NOT is_window) WHERE to_state IS NOT NULL),
grid AS (SELECT a.range AS from_state, b.range AS to_state FROM range(5) a, range(5) b),
mat AS (SELECT from_state, to_state, n, n / nullif(sum(n) OVER (PARTITION BY from_state), 0)::DOUBLE AS probability FROM (SELECT g.*, (SELECT count(*) FROM edg e WHERE e.from_state = g.from_state AND e.to_state = g.to_state) AS n FROM grid g)),
maw AS (SELECT from_state, to_state, n, n / nullif(sum(n) OVER (PARTITION BY from_state), 0)::DOUBLE AS probability FROM (SELECT g.*, (SELECT count(*) FROM edw e WHERE e.from_state = g.from_state AND e.to_state = g.to_state) AS n FROM grid g)),
own AS (SELECT pid, from_state, count(*) AS n FROM edg GROUP BY pid, from_state),
bal AS (
  SELECT from_state, to_state, count(p) AS players, avg(p) AS probability
  FROM (SELECT g.from_state, g.to_state, o.pid, CASE WHEN o.n IS NOT NULL THEN (SELECT count(*) FROM edg e WHERE e.pid = o.pid AND e.from_state = g.from_state AND e.to_state = g.to_state) / o.n::DOUBLE END AS p FROM grid g LEFT JOIN own o ON o.from_state = g.from_state)
  GROUP BY from_state, to_state),
mats AS (SELECT 'all' AS matrix, from_state, to_state, probability FROM mat UNION ALL SELECT 'without_window', from_state, to_state, probability FROM maw UNION ALL SELECT 'balanced', from_state, to_state, probability FROM bal),
lab0 AS (
  SELECT st.*, (next_login - exit_) / 1e6 / 86400.0 AS gap, ((SELECT max(exit_) FROM sess) - exit_) / 1e6 / 86400.0 AS left_days, next_session_id IS NULL AS is_last,
    sum(CASE WHEN state_id <> 4 THEN 1 ELSE 0 END) OVER (PARTITION BY pid ORDER BY session_index) AS cut FROM st),
lab AS (
  SELECT *, CASE WHEN state_id = 4 THEN count(*) FILTER (state_id = 4) OVER (PARTITION BY pid, cut ORDER BY session_index) ELSE 0 END AS focal_streak, {_LABELS} FROM lab0),
lng AS ({" UNION ALL ".join(f"SELECT *, {d} AS horizon_days, evaluable_{d}d AS evaluable, censored_{d}d AS censored, disengaged_{d}d AS disengaged FROM lab" for d in HORIZONS)}),
org AS (
  SELECT *, CASE WHEN next_state_id IS NULL THEN 'S4->end' ELSE 'S4->S' || next_state_id END AS path_exact, CASE WHEN next_state_id IN (1, 2) THEN 'S4->S1/S2' WHEN next_state_id IS NULL THEN 'S4->end' ELSE 'S4->S' || next_state_id END AS path_broad,
    session_index / max(session_index) OVER (PARTITION BY pid)::DOUBLE AS position_in_focal
  FROM (SELECT *, lead(state_id, 2) OVER (PARTITION BY pid ORDER BY session_index) AS state_plus_2 FROM lab) WHERE state_id = 4),
dst AS (SELECT *, 'S4->S' || state_id AS path_exact, CASE WHEN state_id IN (1, 2) THEN 'S4->S1/S2' ELSE 'S4->S' || state_id END AS path_broad FROM lab WHERE prev_state_id = 4),
rel AS (
  SELECT o.session_id AS origin_session_id, o.pid, o.session_index, o.next_session_id AS destination_session_id, o.path_exact, o.total_sessions - o.session_index - 1 AS sessions_after_destination, n.session_index AS ni, n.login AS nl, o.next_login
  FROM org o LEFT JOIN lab n ON n.pid = o.pid AND n.session_index = (SELECT min(x.session_index) FROM lab x WHERE x.pid = o.pid AND x.state_id = 4 AND x.session_index >= o.session_index + 2) WHERE o.next_state_id IN (1, 2)),
rlp AS (SELECT origin_session_id, pid, session_index, destination_session_id, path_exact, sessions_after_destination, ni IS NOT NULL AS relapses, ni - session_index - 1 AS sessions_until_relapse, (nl - next_login) / 1e6 / 86400.0 AS days_until_relapse FROM rel),
expo AS (
  SELECT lab.*, session_index - 1 AS prior_session_count, (SELECT count(*) FROM st x WHERE x.pid = lab.pid AND x.state_id = 4 AND x.session_index < lab.session_index) AS prior_focal_count,
    {", ".join(f"(SELECT count(*) FROM st x WHERE x.pid = lab.pid AND x.state_id = 4 AND x.session_index BETWEEN lab.session_index - {w} AND lab.session_index - 1) / least({w}, session_index)::DOUBLE AS density_prev{w}" for w in (3, 5, 10))}
  FROM lab),
cov AS (
  SELECT *, coalesce(prior_focal_count / nullif(prior_session_count, 0)::DOUBLE, 0.0) AS prior_focal_share, session_index / total_sessions::DOUBLE AS lifecycle_position, greatest(0.0, coalesce(days_since_previous_session, 0.0)) AS gap_before_days,
    ln(1 + greatest(0.0, coalesce(days_since_previous_session, 0.0))) AS log_gap_days, ln(1 + greatest(0.0, player_lifetime_days)) AS log_player_lifetime_days, ln(1 + prior_session_count) AS log_prior_session_count, ln(1 + prior_focal_count) AS log_prior_focal_count,
    ln(1 + duration_minutes) AS log_duration_minutes, ln(1 + session_index) AS log_session_index
  FROM expo),
foc AS (SELECT *, {", ".join(f"coalesce(next_state_id IN (1, 2) AND gap <= {d} AND evaluable_{d}d, false) AS recovered_{d}d, greatest(0.0, least({d}.0, coalesce(gap, {d}.0))) AS gap_after_{d}d_capped" for d in HORIZONS)} FROM cov WHERE state_id = 4),
scn AS ({" UNION ALL ".join(f"SELECT pid, recovered_7d AS recovered, '{v}' AS variable, {v}::DOUBLE AS value FROM foc WHERE evaluable_7d AND {v} IS NOT NULL" for v in ("gap_before_days", "gap_after_7d_capped", "density_prev5", "density_prev10", "prior_focal_share", "lifecycle_position", "player_lifetime_days", "prior_session_count"))}),
pts AS (SELECT DISTINCT variable, unnest(list_transform(quantile_cont(value, [{", ".join(str(k / 100) for k in range(10, 91, 5))}]), lambda x: x)) AS threshold FROM scn GROUP BY variable HAVING count(DISTINCT value) > 1),
thr AS (
  SELECT s.variable, threshold, count(*) FILTER (value < threshold) AS n_low, count(*) FILTER (value >= threshold) AS n_high, count(DISTINCT CASE WHEN value < threshold THEN pid END) AS players_low, count(DISTINCT CASE WHEN value >= threshold THEN pid END) AS players_high,
    avg(recovered::INT) FILTER (value < threshold) AS rate_low, avg(recovered::INT) FILTER (value >= threshold) AS rate_high
  FROM scn s JOIN pts USING (variable) GROUP BY s.variable, threshold HAVING n_low >= 20 AND n_high >= 20),
bst AS (SELECT * FROM (SELECT *, rate_low - rate_high AS drop_, row_number() OVER (PARTITION BY variable ORDER BY rate_low - rate_high DESC, threshold) AS n FROM thr) WHERE n = 1),
rl0 AS (SELECT *, {", ".join(f"list(state_id) OVER (PARTITION BY pid ORDER BY session_index ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS l{w}" for w in ROLLING)} FROM cov),
rol AS (SELECT *, {", ".join(_rolling(w) for w in ROLLING)} FROM rl0),
anc AS (SELECT pid, session_id AS anchor_session_id, session_index AS anchor_index, login AS anchor_login, state_id AS anchor_state_id FROM lab WHERE is_last AND evaluable_7d AND disengaged_7d),
bef AS (
  SELECT r.*, anchor_session_id, anchor_index, anchor_state_id, anchor_index - session_index AS session_lag, (anchor_login - login) / 1e6 / 86400.0 AS days_to_anchor,
    CASE WHEN (anchor_login - login) / 1e6 / 86400.0 <= 1 THEN '0-1d' WHEN (anchor_login - login) / 1e6 / 86400.0 <= 3 THEN '1-3d' WHEN (anchor_login - login) / 1e6 / 86400.0 <= 7 THEN '3-7d' WHEN (anchor_login - login) / 1e6 / 86400.0 <= 14 THEN '7-14d' WHEN (anchor_login - login) / 1e6 / 86400.0 <= 30 THEN '14-30d' WHEN (anchor_login - login) / 1e6 / 86400.0 <= 60 THEN '30-60d' WHEN (anchor_login - login) / 1e6 / 86400.0 <= 90 THEN '60-90d' ELSE '90d+' END AS day_bin,
    CASE WHEN anchor_index - session_index <= 2 THEN '0-2 sessions' WHEN anchor_index - session_index <= 5 THEN '3-5 sessions' WHEN anchor_index - session_index <= 10 THEN '6-10 sessions' WHEN anchor_index - session_index <= 20 THEN '11-20 sessions' ELSE '20+ sessions' END AS lag_period
  FROM rol r JOIN anc USING (pid) WHERE session_index <= anchor_index),
bfl AS ({" UNION ALL ".join(f"SELECT session_id, pid, session_lag, day_bin, anchor_state_id, '{m}' AS metric, {w} AS window_, {m}_w{w}::DOUBLE AS value FROM bef" for w in ROLLING for m in METRICS)}),
slp AS MATERIALIZED (
  SELECT session_id, count(*) OVER s AS slope_points, {", ".join(f"CASE WHEN count({m}_w{w}) OVER s >= 5 THEN {'-' if k < 2 else ''}regr_slope({m}_w{w}, session_index) OVER s END AS narrowing_{m}_w{w}" for w in ROLLING for k, m in enumerate(METRICS[:3]))}
  FROM rol WINDOW s AS (PARTITION BY pid ORDER BY session_index RANGE BETWEEN 10 PRECEDING AND CURRENT ROW) QUALIFY session_index >= 5),
fra AS MATERIALIZED (
  SELECT r.*, s.* EXCLUDE (session_id, slope_points), month || '|' || CASE WHEN session_index <= 5 THEN '1-5' WHEN session_index <= 10 THEN '6-10' WHEN session_index <= 20 THEN '11-20' WHEN session_index <= 50 THEN '21-50' WHEN session_index <= 100 THEN '51-100' ELSE '100+' END AS stratum,
    CASE WHEN {" AND ".join(f"narrowing_{m}_w{w} IS NOT NULL" for w in ROLLING for m in METRICS[:3])} THEN CASE WHEN is_last AND evaluable_7d AND disengaged_7d THEN 1 WHEN evaluable_7d AND NOT disengaged_7d AND NOT is_last THEN 0 END END AS terminal_case
  FROM rol r JOIN slp s USING (session_id)),
rnk AS (SELECT *, row_number() OVER (PARTITION BY stratum, terminal_case ORDER BY session_index, pid, session_id) AS number FROM fra WHERE terminal_case IS NOT NULL),
mch AS (SELECT a.stratum, a.number, a.pid AS case_pid, a.session_id AS case_session_id, a.session_index AS case_index, b.pid AS control_pid, b.session_id AS control_session_id, b.session_index AS control_index FROM rnk a JOIN rnk b ON a.stratum = b.stratum AND a.number = b.number AND a.terminal_case = 1 AND b.terminal_case = 0),
con AS (SELECT *, min(number) OVER (PARTITION BY stratum, run ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first, max(number) OVER (PARTITION BY stratum, run) + 1 AS behind
  FROM (SELECT *, sum(new) OVER (PARTITION BY stratum ORDER BY number) AS run FROM (SELECT stratum, number, pid, session_id, session_index, CASE WHEN lag(pid) OVER (PARTITION BY stratum ORDER BY number) = pid THEN 0 ELSE 1 END AS new FROM rnk WHERE terminal_case = 0))),
cas AS (SELECT stratum, number, pid, session_id, session_index FROM rnk WHERE terminal_case = 1),
gre AS (  -- each case takes the control behind the last one taken, or the first behind its own player's run of controls
  SELECT stratum, 0::BIGINT AS number, 0::BIGINT AS at FROM (SELECT DISTINCT stratum FROM cas)
  UNION ALL SELECT g.stratum, g.number + 1, CASE WHEN c.pid = k.pid THEN c.behind ELSE c.number END FROM gre g JOIN cas k ON k.stratum = g.stratum AND k.number = g.number + 1 JOIN con c ON c.stratum = g.stratum AND c.number = g.at + 1),
gmt AS (SELECT k.stratum, g.number, k.pid AS case_pid, k.session_id AS case_session_id, k.session_index AS case_index, c.pid AS control_pid, c.session_id AS control_session_id, c.session_index AS control_index
  FROM gre g JOIN cas k ON k.stratum = g.stratum AND k.number = g.number JOIN con c ON c.stratum = g.stratum AND c.number = g.at),
clu AS (SELECT *, state_id AS cluster, lag(state_id) OVER w AS prev_cluster, lead(state_id) OVER w AS next_cluster, count(*) OVER (PARTITION BY pid) AS total_n, (lead(login) OVER w - exit_) / 1e6 / 86400.0 AS days_to_next, {EVENTS_SUM} AS events, strftime(make_timestamp(login), '%Y-%m-%d') AS login_date FROM stt WINDOW w AS (PARTITION BY pid ORDER BY session_index)),
cl2 AS (SELECT *, CASE WHEN total_n > 1 THEN (session_index - 1) / (total_n - 1)::DOUBLE ELSE 0.0 END AS trajectory FROM clu),
emb AS (SELECT vec_id AS id, label AS known, embedding[1]::DOUBLE AS x0, embedding[2]::DOUBLE AS x1, embedding[3]::DOUBLE AS x2, embedding[4]::DOUBLE AS x3 FROM embeddings),
cen(label, c0, c1, c2, c3) AS (VALUES (0, 0.15, 0.0, 0.0, 0.0), (1, -0.15, 0.05, 0.0, 0.0), (2, 0.0, 0.15, -0.1, 0.0), (3, 0.0, -0.15, 0.1, 0.05), (4, 0.0, 0.0, 0.15, -0.15)),
dis AS (SELECT id, known, x0, x1, x2, x3, label, (x0 - c0) ** 2 + (x1 - c1) ** 2 + (x2 - c2) ** 2 + (x3 - c3) ** 2 AS distance FROM emb, cen),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, label) AS n FROM dis) WHERE n = 1),
lgd AS (SELECT *, ln(0.2) - 0.5 * 4 * ln(2 * pi() * 0.015) - 0.5 * distance / 0.015 AS lg FROM dis),
ll AS (SELECT id, max(lg) + ln(sum(exp(lg - m))) AS log_likelihood FROM (SELECT *, max(lg) OVER (PARTITION BY id) AS m FROM lgd) GROUP BY id),
pst AS (SELECT lgd.*, log_likelihood, exp(lg - log_likelihood) AS p FROM lgd JOIN ll USING (id)),
psc AS (SELECT id, arg_max(label, p) AS label, any_value(log_likelihood) AS log_likelihood, max(p) AS max_posterior, sum(-p * ln(p + 1e-15)) / ln(5) AS entropy FROM pst GROUP BY id)
"""


def add(name: str, sql: str) -> None:
    ORACLES[name] = f"WITH RECURSIVE {BASE.strip()}\n{sql}"


ORACLES: dict[str, str] = {}

add("telemetry_rows", f"SELECT event_id, pid, t AS event_time, event_table, game_mode, {r('level_progress')} AS level_progress, {r('campaign_progress')} AS campaign_progress FROM tel")
ORACLES["json_rows"] = ORACLES["telemetry_rows"]
add("event_csv_rows", f"SELECT pid, t AS event_time, 'events' AS event_table, event_id::DOUBLE AS event_id, coalesce(game_mode, '') AS game_mode, {r('level_progress')} AS level_progress, {r('campaign_progress')} AS campaign_progress FROM tel")
add("zip_event_rows", f"SELECT pid, t AS event_time, event_table, event_id::DOUBLE AS event_id, coalesce(game_mode, '') AS game_mode, {r('level_progress')} AS level_progress, {r('campaign_progress')} AS campaign_progress FROM tel")
add("text_csv_rows", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
add("telemetry_union", f"SELECT event_id, event_table, CASE WHEN event_table = 'job_started' THEN game_mode END AS game_mode, CASE WHEN event_table = 'task_completed' THEN {r('level_progress')} END AS level_progress, CASE WHEN event_table = 'item_purchased' THEN {r('campaign_progress')} END AS campaign_progress FROM tel WHERE event_table IN ('job_started', 'task_completed', 'item_purchased')")
add("sessions", f"SELECT session_id, pid, session_index, login AS login_time, exit_ AS exit_time, {r('duration_seconds')} AS duration_seconds, {r('duration_minutes')} AS duration_minutes, {r('days_since_previous_session')} AS days_since_previous_session, {r('player_lifetime_days')} AS player_lifetime_days, is_zero_duration, is_long FROM sess")
_PLAYERS = """
SELECT pid, count(*) FILTER (kind = 0) AS logins, count(*) FILTER (kind = 1) AS exits, count(*) FILTER (kind = 0 AND next_kind = 1) AS paired_sessions,
  count(*) FILTER (kind = 0 AND next_kind = 0 AND EXISTS (SELECT 1 FROM marks m WHERE m.pid = ahead.pid AND m.kind = 1 AND m.t >= ahead.t)) AS overlapping_logins,
  min(t) FILTER (kind = 0) AS first_login, max(t) FILTER (kind = 1) AS last_exit,
  count(*) FILTER (kind = 0) - count(*) FILTER (kind = 0 AND next_kind = 1) AS unmatched_logins, count(*) FILTER (kind = 1) - count(*) FILTER (kind = 0 AND next_kind = 1) AS unmatched_exits
FROM ahead GROUP BY pid"""
add("pairing_by_player", _PLAYERS)
add(
    "pairing_summary",
    f"SELECT p.*, s.*, {r('clean_players * 100.0 / players')} AS clean_player_pct FROM (SELECT count(*) AS players, {', '.join(f'sum({c})::BIGINT AS {c}' for c in ('logins', 'exits', 'paired_sessions', 'unmatched_logins', 'unmatched_exits', 'overlapping_logins'))}, count(*) FILTER (unmatched_logins = 0 AND unmatched_exits = 0 AND overlapping_logins = 0) AS clean_players FROM ({_PLAYERS})) p, (SELECT {q('duration_minutes', 0.5)} AS duration_minutes_p50, {q('duration_minutes', 0.95)} AS duration_minutes_p95, count(*) FILTER (is_long) AS long_sessions, count(*) FILTER (is_zero_duration) AS zero_sessions FROM sess) s",
)
add("event_assignment", "SELECT event_id, event_table, session_id FROM asg")
add("assignment_summary", f"SELECT event_table, count(*) AS valid_events, count(session_id) AS assigned_events, count(*) - count(session_id) AS unassigned_events, {r('count(session_id) * 100.0 / count(*)')} AS assigned_pct FROM asg GROUP BY event_table")
add("session_event_counts", f"SELECT pid, session_index, {', '.join((*ACTIVITY, 'exit_events_matched'))} FROM cnt")
_MISS = "count(*) FILTER ({c} IS NULL OR {c}::VARCHAR = '') * 100.0 / count(*)"
add("table_audit", f"SELECT event_table, count(*) AS rows, count(DISTINCT pid) AS players, min(t) AS first_time, max(t) AS last_time, {r('greatest(' + ', '.join(_MISS.format(c=c) for c in ('game_mode', 'level_progress', 'campaign_progress')) + ')')} AS max_missing_pct FROM tel GROUP BY event_table")
add("column_missingness", " UNION ALL ".join(f"SELECT event_table, count(*) AS rows, '{c}' AS \"column\", count(*) FILTER ({c} IS NULL OR {c}::VARCHAR = '') AS missing, {r(_MISS.format(c=c))} AS missing_pct FROM tel GROUP BY event_table" for c in ("game_mode", "level_progress", "campaign_progress")))
add("duplicate_excess", "SELECT event_table, sum(n - 1)::BIGINT AS duplicate_rows FROM (SELECT o_orderpriority AS event_table, count(*) AS n FROM orders GROUP BY o_orderpriority, o_custkey, o_orderdate) GROUP BY event_table")
add("player_coverage", "SELECT tables, count(*) AS players FROM (SELECT pid, count(DISTINCT event_table) AS tables FROM tel GROUP BY pid) GROUP BY tables")
add("event_name_counts", """SELECT event_table, '[' || string_agg('{"name":"' || game_mode || '","n":' || n || '}', ',' ORDER BY game_mode) || ']' AS event_names FROM (SELECT event_table, game_mode, count(*) AS n FROM tel WHERE game_mode IS NOT NULL GROUP BY event_table, game_mode) GROUP BY event_table""")

add("session_features", f"SELECT session_id, pid, session_index, login AS login_time, exit_ AS exit_time, {', '.join(f'{r(c)} AS {c}' for c in ('duration_minutes', 'days_since_previous_session', 'player_lifetime_days', 'job_completion_ratio', 'job_exit_ratio', 'progression_gain', 'campaign_progression_gain'))}, {', '.join(ACTIVITY)}, exit_events_matched, primary_game_mode, mode_diversity, is_zero_duration, is_long FROM feat")
add(
    "feature_sanity",
    f"SELECT count(*) AS sessions, count(*) FILTER (is_zero_duration) AS zero_duration_sessions, count(*) FILTER (is_long) AS long_sessions, count(*) FILTER (jobs_started + jobs_resumed = 0) AS sessions_without_job, count(*) FILTER (primary_game_mode = '') AS sessions_without_mode, count(*) FILTER (items_purchased > 0) AS sessions_with_purchase, count(*) FILTER (job_completion_ratio > 1) AS completion_ratio_above_1, count(*) FILTER (days_since_previous_session < 0) AS negative_gaps, {q('duration_minutes', 0.5)} AS duration_p50, {q('duration_minutes', 0.95)} AS duration_p95, {r('max(duration_minutes)')} AS duration_max, {q('days_since_previous_session', 0.5)} AS gap_days_p50, (SELECT count(DISTINCT pid) FROM feat) AS players, (SELECT max(n) FROM (SELECT count(*) AS n FROM feat GROUP BY pid)) AS max_sessions_per_player, (SELECT {q('n::DOUBLE', 0.95)} FROM (SELECT count(*) AS n FROM feat GROUP BY pid)) AS p95_sessions_per_player FROM feat",
)


def _numeric(source: str, columns: tuple[str, ...]) -> str:
    def one(c: str) -> str:
        v = f"{c}::DOUBLE"
        top = f"(SELECT sum(v) FROM (SELECT {v} AS v, row_number() OVER (ORDER BY {v} DESC) AS n FROM {source} WHERE {c} IS NOT NULL) WHERE n <= greatest(1, ceil((SELECT count(*) FROM {source}) * 0.01)))"
        quant = ", ".join(f"{q(v, p)} AS {n}" for n, p in (("p01", 0.01), ("p05", 0.05), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p95", 0.95), ("p99", 0.99)))
        return f"SELECT '{c}' AS feature, count({c}) AS non_null, {r(f'count(*) FILTER ({c} IS NULL) * 100.0 / count(*)')} AS missing_pct, {r(f'count(*) FILTER ({c} = 0) * 100.0 / count(*)')} AS zero_pct, count(*) FILTER ({c} < 0) AS negative_count, {r(f'avg({v})')} AS mean, {r(f'stddev_samp({v})')} AS std, {r(f'min({v})')} AS min, {quant}, {r(f'max({v})')} AS max, CASE WHEN sum({v}) > 0 THEN {r(f'{top} / sum({v})')} END AS top_share_of_sum, count(DISTINCT {c}) AS unique_values FROM {source}"

    return " UNION ALL ".join(one(c) for c in columns)


add("numeric_summary", _numeric("feat", NUMERIC))
add("lineitem_numeric_summary", _numeric("(SELECT *, round(l_discount * 100) AS discount_pct, round(l_tax * 100) AS tax_pct FROM lineitem)", ("l_quantity", "l_extendedprice", "discount_pct", "tax_pct")))
add("mode_share", f"SELECT CASE WHEN primary_game_mode = '' THEN '(missing)' ELSE primary_game_mode END AS primary_game_mode, count(*) AS sessions, {r('count(*) * 100.0 / (SELECT count(*) FROM feat)')} AS pct FROM feat GROUP BY 1")
_SPP = "(SELECT pid, count(*) AS sessions, row_number() OVER (ORDER BY count(*) DESC, pid) AS n FROM feat GROUP BY pid)"
add("player_influence", f"SELECT count(*) AS players, sum(sessions)::BIGINT AS sessions, max(sessions) AS max_sessions_per_player, {q('sessions::DOUBLE', 0.95)} AS p95_sessions_per_player, {', '.join(f'''{r(f'sum(sessions) FILTER (n <= greatest(1, ceil((SELECT count(DISTINCT pid) FROM feat) * {s}))) / sum(sessions)::DOUBLE')} AS "top_{s * 100:g}pct_players_session_share"''' for s in (0.01, 0.05))} FROM {_SPP}")
add("top_players", f"SELECT pid, sessions FROM {_SPP} WHERE n <= 50")
add("extreme_sessions", " UNION ALL ".join(f"SELECT '{m}' AS metric, session_id, pid, {r(f'{m}::DOUBLE')} AS value FROM (SELECT *, row_number() OVER (ORDER BY {m} DESC NULLS LAST, session_id) AS n FROM feat) WHERE n <= 25" for m in ("duration_minutes", "days_since_previous_session", "jobs_started", "tasks_completed", "items_purchased", "progression_gain", "campaign_progression_gain")))
_RANKED = "(SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb FROM feat WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
_CORR = "CASE WHEN isnan(corr(ra, rb)) THEN NULL ELSE corr(ra, rb) END"
add("spearman_pairs", " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, count(*) AS rows, {r(_CORR)} AS spearman, {r(f'abs({_CORR})')} AS abs_spearman FROM {_RANKED.format(a=a, b=b)}" for a, b in combinations(NUMERIC, 2)))
add("discovery_input", f"SELECT session_id, pid, session_index, {', '.join(f'{r(c)} AS {c}' if c not in ('first_session', 'no_started_or_resumed_job', 'purchase_any') else c for c in DISCOVERY)} FROM disc")
add("discovery_sidecar", f"SELECT session_id, pid, session_index, {r('player_lifetime_days')} AS player_lifetime_days, jobs_completed, jobs_exited, items_purchased, {r('campaign_progression_gain')} AS campaign_progression_gain, primary_game_mode, is_zero_duration, is_long, coalesce(job_completion_ratio > 1, false) AS job_completion_ratio_gt_1, coalesce(job_exit_ratio > 1, false) AS job_exit_ratio_gt_1 FROM feat")
add("transform_validation", " UNION ALL ".join(f"SELECT '{c}' AS \"check\", 0.0::DOUBLE AS value, true AS passed" for c in (*DISCOVERY, "repeated_sessions", "nulls", "out_of_bounds")))
add("key_alignment", "SELECT count(*) FILTER (c.session_id IS NOT NULL) AS in_both, count(*) FILTER (c.session_id IS NULL) AS left_only, (SELECT count(*) FROM cnt WHERE session_id NOT IN (SELECT session_id FROM sess)) AS right_only, 0 AS repeated, bool_and(c.session_id IS NOT NULL) AS aligned FROM sess LEFT JOIN cnt c USING (session_id)")
add("zscored_features", f"SELECT session_id, {', '.join(r(f'CASE WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} ELSE 0.0 END') + f' AS {c}' for c in DISCOVERY)} FROM disc, (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}' for c in DISCOVERY)} FROM disc)")
add("scatter_sample", f"SELECT session_id, {', '.join(r(f'greatest((SELECT quantile_cont({c}, 0.005) FROM feat), least((SELECT quantile_cont({c}, 0.995) FROM feat), {c}))') + f' AS {c}' for c in ('duration_minutes', 'player_lifetime_days'))} FROM feat")
ORACLES["feature_decisions"] = "SELECT * FROM (VALUES ('duration_minutes', 'use_log1p_winsorized', 'long tail'), ('days_since_previous_session', 'use_log1p_with_first_session_indicator', 'null is the first session'), ('player_lifetime_days', 'exclude_from_main_discovery_use_for_interpretation', 'describes the player, not the session'), ('jobs_started', 'use_log1p_winsorized', 'long tail'), ('jobs_resumed', 'use_log1p_winsorized', 'long tail'), ('jobs_completed', 'drop_or_keep_only_for_completion_variant', 'overlaps with tasks and the completion ratio'), ('jobs_exited', 'drop_or_keep_only_for_exit_variant', 'overlaps with the exit ratio'), ('tasks_completed', 'use_log1p_winsorized', 'long tail'), ('items_purchased', 'use_binary_or_log1p_winsorized', 'few sessions have any'), ('job_completion_ratio', 'use_with_no_job_indicator', 'null without jobs'), ('job_exit_ratio', 'use_with_no_job_indicator', 'null without jobs'), ('progression_gain', 'use_winsorized', 'long tail'), ('campaign_progression_gain', 'drop_initially', 'mostly missing'), ('primary_game_mode', 'exclude_from_unsupervised_numeric_state_discovery', 'a category'), ('mode_diversity', 'use', 'a small count')) t(feature, decision, reason)"

_PAIR = "coalesce('S' || prev_state_id, 'start') || '->' || coalesce('S' || state_id, 'end')"
add("state_assignments", f"SELECT session_id, pid, session_index, state_id, prev_state_id, next_state_id, next_session_id, total_sessions, is_window, is_purchase_anomaly, {_PAIR} AS pair FROM st")
add("state_sequences", "SELECT pid, count(*) AS sessions, string_agg(state_id::VARCHAR, ' ' ORDER BY session_index) AS state_sequence, string_agg(session_id, ' ' ORDER BY session_index) AS session_sequence FROM st GROUP BY pid")
add("player_ends", "SELECT pid, arg_min(state_id, session_index) AS first_state, arg_max(state_id, session_index) AS last_state, count(*) AS sessions FROM st GROUP BY pid")
add("trajectory_positions", f"SELECT session_id, {r('CASE WHEN total_sessions > 1 THEN (session_index - 1) / (total_sessions - 1)::DOUBLE ELSE 0.0 END')} AS from_first_to_last, {r('CASE WHEN state_id = 4 THEN session_index / lf::DOUBLE END')} AS within_focal, {r('session_index / total_sessions::DOUBLE')} AS of_all, {r('lf / total_sessions::DOUBLE')} AS player_last_focal FROM (SELECT *, max(session_index) FILTER (state_id = 4) OVER (PARTITION BY pid) AS lf FROM st)")
add("transition_edges", f"SELECT * REPLACE ({r('gap_days')} AS gap_days) FROM edg")
add("transition_matrix", f"SELECT from_state, to_state, n, {r('probability')} AS probability FROM mat")
add("transition_matrix_without_window", f"SELECT from_state, to_state, n, {r('probability')} AS probability FROM maw")
add("transition_matrix_wide", f"SELECT from_state, {', '.join(f'{r(f'max(probability) FILTER (to_state = {k})')} AS to_{k}' for k in range(5))} FROM mat GROUP BY from_state")
ORACLES["order_transition_matrix"] = """WITH s AS (SELECT o_custkey, o_orderdate, o_orderkey, CASE WHEN o_totalprice < 100000 THEN 0 WHEN o_totalprice < 200000 THEN 1 WHEN o_totalprice < 300000 THEN 2 WHEN o_totalprice < 400000 THEN 3 ELSE 4 END AS state FROM orders),
e AS (SELECT state AS from_state, lead(state) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS to_state FROM s),
g AS (SELECT a.range AS from_state, b.range AS to_state FROM range(5) a, range(5) b), c AS (SELECT g.*, (SELECT count(*) FROM e WHERE e.from_state = g.from_state AND e.to_state = g.to_state) AS n FROM g)
SELECT from_state, to_state, n, round(n / nullif(sum(n) OVER (PARTITION BY from_state), 0)::DOUBLE, 6) AS probability FROM c"""
add("balanced_matrix", f"SELECT from_state, to_state, players, {r('probability')} AS probability FROM bal")
add("players_with_outgoing", "SELECT pid, count(*) AS transitions, count(DISTINCT from_state) AS states_with_outgoing FROM edg GROUP BY pid")
add("matrix_comparison", f"SELECT a.matrix AS matrix_a, b.matrix AS matrix_b, {r('max(abs(a.probability - b.probability))')} AS max_abs_diff, {r('avg(abs(a.probability - b.probability))')} AS mean_abs_diff, {r('sqrt(sum((a.probability - b.probability) ** 2))')} AS frobenius_norm FROM mats a JOIN mats b USING (from_state, to_state) WHERE (a.matrix, b.matrix) IN (('all', 'without_window'), ('all', 'balanced'), ('without_window', 'balanced')) GROUP BY 1, 2")
add("transition_features", f"SELECT matrix, from_state AS state, {r('max(probability) FILTER (to_state = from_state)')} AS self_transition, arg_max(to_state, (probability, -to_state)) FILTER (probability IS NOT NULL) AS top_state, {r('max(probability)')} AS top_probability, {r('max(probability) FILTER (to_state = 1)')} AS to_s1, {r('max(probability) FILTER (to_state = 2)')} AS to_s2, {r('max(probability) FILTER (to_state = 1) + max(probability) FILTER (to_state = 2)')} AS to_recovery FROM mats GROUP BY matrix, from_state")
_CELL = "max(probability) FILTER (from_state = {0} AND to_state = {1})"
add(
    "robustness_gate",
    f"""SELECT *, s0_top_is_s1 AND s1_s2_exchange AND s3_returns AND s4_recovers AND s4_persists AS robust FROM (SELECT bool_and(t = 1) AS s0_top_is_s1, min(a) > 0.60 AS s1_s2_exchange, min(b) > 0.60 AS s3_returns, min(c) > 0.35 AS s4_recovers, min(d) > 0.25 AS s4_persists FROM (
  SELECT matrix, arg_max(to_state, (probability, -to_state)) FILTER (from_state = 0 AND probability IS NOT NULL) AS t, {_CELL.format(1, 2)} + {_CELL.format(2, 1)} AS a, {_CELL.format(3, 1)} + {_CELL.format(3, 2)} AS b, {_CELL.format(4, 1)} + {_CELL.format(4, 2)} AS c, {_CELL.format(4, 4)} AS d FROM mats GROUP BY matrix))""",
)
add("state_summary", f"SELECT state_id, count(*) AS sessions, count(DISTINCT pid) AS players, count(*) FILTER (prev_state_id IS NULL) AS starts, count(*) FILTER (next_state_id IS NULL) AS ends, count(prev_state_id) AS incoming, count(next_state_id) AS outgoing, count(*) FILTER (next_state_id = state_id) AS self_transitions, {r('count(*) FILTER (next_state_id = state_id) / nullif(count(next_state_id), 0)::DOUBLE')} AS self_probability, {q('duration_minutes', 0.5)} AS median_duration_minutes FROM st GROUP BY state_id")

add("disengagement_labels", f"SELECT session_id, {r('gap')} AS next_gap_days, {r('left_days')} AS days_to_cutoff, is_last, focal_streak, {', '.join(f'{k}_{d}d' for d in HORIZONS for k in ('evaluable', 'censored', 'disengaged'))} FROM lab")
add("gap_summary", f"SELECT count(gap) AS with_next, count(*) FILTER (gap IS NULL) AS without_next, {r('min(gap)')} AS min, {', '.join(f'{q('gap', p)} AS {n}' for n, p in (('p25', 0.25), ('p50', 0.5), ('p75', 0.75), ('p90', 0.9), ('p95', 0.95), ('p99', 0.99)))}, {r('max(gap)')} AS max FROM lab")
add("gap_histogram", f"SELECT CASE WHEN gap <= 0 THEN '<=0d' WHEN gap <= 1 / 24.0 THEN '0-1h' WHEN gap <= 1 THEN '1h-1d' WHEN gap <= 3 THEN '1-3d' WHEN gap <= 7 THEN '3-7d' WHEN gap <= 14 THEN '7-14d' WHEN gap <= 30 THEN '14-30d' WHEN gap <= 60 THEN '30-60d' WHEN gap <= 120 THEN '60-120d' ELSE '>120d' END AS gap_bin, count(*) AS sessions, {r('count(*) * 100.0 / (SELECT count(gap) FROM lab)')} AS pct FROM lab WHERE gap IS NOT NULL GROUP BY 1")
add("horizon_summary", f"SELECT horizon_days, count(*) AS sessions, count(*) FILTER (evaluable) AS evaluable_sessions, count(*) FILTER (censored) AS censored_sessions, {r('count(*) FILTER (censored) * 100.0 / count(*)')} AS censored_pct, count(*) FILTER (disengaged) AS disengaged_sessions, {r('count(*) FILTER (disengaged) * 100.0 / nullif(count(*) FILTER (evaluable), 0)')} AS disengaged_pct, count(*) FILTER (evaluable AND NOT disengaged) AS returned_sessions FROM lng GROUP BY horizon_days")


def _risk(groups: str, source: str = "lng", where: str = "true") -> str:
    name = groups.rpartition(" AS ")[2]
    return f"SELECT horizon_days, {name}, ev AS evaluable_sessions, dis AS disengaged_sessions, {r('dis * 100.0 / ev')} AS risk_pct, {r('(dis * 100.0 / ev) / nullif(overall, 0)')} AS lift FROM (SELECT horizon_days, {groups}, count(*) FILTER (evaluable) AS ev, count(*) FILTER (disengaged) AS dis FROM {source} GROUP BY ALL) JOIN (SELECT horizon_days, count(*) FILTER (disengaged) * 100.0 / nullif(count(*) FILTER (evaluable), 0) AS overall FROM {source} GROUP BY horizon_days) USING (horizon_days) WHERE ev >= 5 AND {where}"


add("risk_by_state", _risk("state_id"))
add("risk_by_state_pair", _risk("prev_state_id, state_id"))
_AFTER = f"(SELECT *, {_PAIR} AS transition_pair FROM lng WHERE prev_state_id IS NOT NULL)"
add("risk_by_transition", _risk("transition_pair", _AFTER))
ORACLES["sql_risk_by_transition"] = ORACLES["risk_by_transition"]
add("sql_transition_report", f"""SELECT m.from_state, m.to_state, m.n, {r('m.probability')} AS probability, k.evaluable_sessions, k.risk_pct, w.pct AS pct_of_state FROM mat m
LEFT JOIN ({_risk('transition_pair', _AFTER)}) k ON k.horizon_days = 7 AND k.transition_pair = 'S' || m.from_state || '->S' || m.to_state
LEFT JOIN (SELECT state_id, {r('count(*) FILTER (disengaged) * 100.0 / nullif(count(*) FILTER (evaluable), 0)')} AS pct FROM lng WHERE horizon_days = 7 GROUP BY state_id) w ON w.state_id = m.to_state""")
add("focused_pairs", _risk("transition_pair", _AFTER, "transition_pair IN ('S1->S4', 'S2->S4', 'S4->S1', 'S4->S4')"))
add("risk_by_streak", _risk("CASE WHEN focal_streak <= 0 THEN 'other' WHEN focal_streak <= 3 THEN 'x' || focal_streak ELSE 'x4plus' END AS streak_bucket"))
_RATE = "count(*) FILTER (disengaged AND ({c})) * 100.0 / nullif(count(*) FILTER (evaluable AND ({c})), 0)"
_C = {"overall_risk_pct": "true", "focal_risk_pct": "state_id = 4", "focal_after_focal_risk_pct": "state_id = 4 AND prev_state_id = 4", "streak_2plus_risk_pct": "focal_streak >= 2", "s1_to_focal_risk_pct": "state_id = 4 AND prev_state_id = 1", "s2_to_focal_risk_pct": "state_id = 4 AND prev_state_id = 2"}
add("focused_comparisons", f"SELECT horizon_days, {', '.join(f'{r(_RATE.format(c=c))} AS {n}' for n, c in _C.items())}, {r(f'({_RATE.format(c=_C['focal_risk_pct'])}) / nullif({_RATE.format(c='true')}, 0)')} AS focal_lift, {r(f'({_RATE.format(c=_C['streak_2plus_risk_pct'])}) / nullif({_RATE.format(c='true')}, 0)')} AS streak_2plus_lift, {r(f'{_RATE.format(c=_C['s2_to_focal_risk_pct'])} - {_RATE.format(c=_C['s1_to_focal_risk_pct'])}')} AS s2_minus_s1_pctpt FROM lng GROUP BY horizon_days")

add("focal_paths", f"SELECT path_broad, path_exact, count(*) AS sessions, count(DISTINCT pid) AS players, {q('duration_minutes', 0.5)} AS median_duration_minutes, {q('gap', 0.5)} AS median_next_gap_days, {q('position_in_focal', 0.5)} AS median_position, {r('avg(is_window::INT)')} AS window_share, {r('avg(is_purchase_anomaly::INT)')} AS purchase_anomaly_share, {r('count(*) / (SELECT count(*) FROM org)::DOUBLE')} AS share FROM org GROUP BY path_broad, path_exact")


def _numbers(x: str, prefix: str) -> str:
    return f"count({x}) AS {prefix}_n, {r(f'avg({x})')} AS {prefix}_mean, {', '.join(f'{q(f'{x}::DOUBLE', p)} AS {prefix}_{n}' for n, p in (('median', 0.5), ('p25', 0.25), ('p75', 0.75), ('p90', 0.9), ('p95', 0.95)))}, {r(f'max({x})') if prefix != 'sessions' else f'max({x})'} AS {prefix}_max"


add("focal_gap_summary", f"SELECT path_broad, count(*) AS rows, {_numbers('gap', 'gap_days')} FROM org GROUP BY path_broad")


def _outcome(source: str, group: str) -> str:
    wide = ", ".join(f"count(*) FILTER (evaluable_{d}d) AS evaluable_{d}d, count(*) FILTER (censored_{d}d) AS censored_{d}d, count(*) FILTER (disengaged_{d}d) AS disengaged_{d}d, {r(f'count(*) FILTER (disengaged_{d}d) / nullif(count(*) FILTER (evaluable_{d}d), 0)::DOUBLE')} AS risk_{d}d" for d in HORIZONS)
    return f"SELECT {group}, count(*) AS sessions, count(DISTINCT pid) AS players, {q('duration_minutes', 0.5)} AS median_duration_minutes, {r('avg(is_window::INT)')} AS window_share, {r('avg(is_purchase_anomaly::INT)')} AS purchase_anomaly_share, {q('gap', 0.5)} AS median_next_gap_days, {wide}, {r(f'count(*) / (SELECT count(*) FROM {source})::DOUBLE')} AS share FROM {source} GROUP BY {group}"


add("outcome_by_broad_path", _outcome("org", "path_broad"))
add("outcome_by_exact_path", _outcome("org", "path_exact"))
add("destination_outcome_by_broad_path", _outcome("dst", "path_broad"))
add("destination_outcome_by_exact_path", _outcome("dst", "path_exact"))
_NEXT = "CASE WHEN state_plus_2 IS NULL THEN 'end_after_recovery_session' WHEN state_plus_2 IN (1, 2) THEN 'stays_in_S1/S2' WHEN state_plus_2 = 4 THEN 'returns_to_S4' ELSE 'moves_to_S' || state_plus_2 END"
add("recovery_followup", f"SELECT path_exact, next_step, origins, players, median_gap_days, {r('origins / sum(origins) OVER (PARTITION BY path_exact)')} AS share_within_path, {r('origins / sum(origins) OVER ()')} AS share_of_all FROM (SELECT path_exact, {_NEXT} AS next_step, count(*)::DOUBLE AS o, count(*) AS origins, count(DISTINCT pid) AS players, {q('gap', 0.5)} AS median_gap_days FROM org WHERE next_state_id IN (1, 2) GROUP BY 1, 2)")
add("time_to_relapse", f"SELECT * REPLACE ({r('days_until_relapse')} AS days_until_relapse) FROM rlp")
add("relapse_summary", f"SELECT path_exact, count(*) AS rows, count(DISTINCT pid) AS players, count(*) FILTER (relapses) AS relapsed, {r('avg(relapses::INT)')} AS relapse_rate, {_numbers('sessions_until_relapse', 'sessions')}, {_numbers('days_until_relapse', 'days')} FROM rlp GROUP BY path_exact")
add("player_footprint", f"SELECT *, recoveries > 0 AS has_recovery, persistences > 0 AS has_persistence, {r('last_focal_index / total_sessions::DOUBLE')} AS last_focal_position FROM (SELECT pid, count(*) FILTER (state_id = 4) AS focal_sessions, count(*) FILTER (state_id = 4 AND next_state_id IN (1, 2)) AS recoveries, count(*) FILTER (state_id = 4 AND next_state_id = 4) AS persistences, count(*) FILTER (state_id = 4 AND next_state_id IS NULL) AS terminal, min(session_index) FILTER (state_id = 4) AS first_focal_index, max(session_index) FILTER (state_id = 4) AS last_focal_index, max(session_index) AS total_sessions FROM lab GROUP BY pid) WHERE focal_sessions > 0")
add("unadjusted_path_risk", f"SELECT horizon_days, CASE WHEN state_id IN (1, 2) THEN 'S4->S1/S2' ELSE 'S4->S4' END AS path_broad, count(*) AS sessions, count(DISTINCT pid) AS players, count(*) FILTER (disengaged) AS events, {r('count(*) FILTER (disengaged) / count(*)::DOUBLE')} AS risk, {q('duration_minutes', 0.5)} AS median_duration_minutes, {q('gap', 0.5)} AS median_next_gap_days FROM lng WHERE prev_state_id = 4 AND state_id IN (1, 2, 4) AND evaluable GROUP BY 1, 2")
add("focal_frame", f"SELECT session_id, prior_session_count, prior_focal_count, {', '.join(f'{r(c)} AS {c}' for c in ('prior_focal_share', 'density_prev3', 'density_prev5', 'density_prev10', 'lifecycle_position', 'gap_before_days', 'log_prior_focal_count', 'gap_after_7d_capped'))}, {r('log_gap_days')} AS log_gap_before_days, month, recovered_1d, recovered_3d, recovered_7d FROM foc")
_ODDS = "({0} + 1e-9) / (1 - {0} + 1e-9)"
add("threshold_scan", f"SELECT variable, {r('threshold')} AS threshold, n_low, n_high, players_low, players_high, {r('rate_low')} AS rate_low, {r('rate_high')} AS rate_high, {r('rate_low - rate_high')} AS \"drop\", {r(f'({_ODDS.format('rate_high')}) / ({_ODDS.format('rate_low')})')} AS odds_ratio FROM thr")
add("best_thresholds", f"SELECT variable, {r('threshold')} AS threshold, {r('drop_')} AS \"drop\", n_low, n_high FROM bst")
_STABLE = " UNION ALL ".join(f"SELECT {d} AS horizon_days, {str(out).lower()} AS without_window, pid, recovered_{d}d AS recovered, '{v}' AS variable, {v}::DOUBLE AS value FROM foc WHERE evaluable_{d}d{' AND NOT is_window' if out else ''}" for d in HORIZONS for out in (False, True) for v in ("gap_before_days", "gap_after_7d_capped", "density_prev5", "density_prev10", "prior_focal_share", "lifecycle_position", "player_lifetime_days", "prior_session_count"))
add("threshold_stability", f"SELECT horizon_days, without_window, variable, {r('threshold')} AS threshold, n_low, n_high, {r('rate_low')} AS rate_low, {r('rate_high')} AS rate_high, {r('rate_low - rate_high')} AS \"drop\", {r(f'({_ODDS.format('rate_high')}) / ({_ODDS.format('rate_low')})')} AS odds_ratio FROM (SELECT horizon_days, without_window, s.variable, threshold, count(*) FILTER (value < threshold) AS n_low, count(*) FILTER (value >= threshold) AS n_high, avg(recovered::INT) FILTER (value < threshold) AS rate_low, avg(recovered::INT) FILTER (value >= threshold) AS rate_high FROM ({_STABLE}) s JOIN (SELECT variable, threshold FROM bst) USING (variable) GROUP BY horizon_days, without_window, s.variable, threshold) WHERE n_low >= 20 AND n_high >= 20")
ORACLES["scan_variables"] = "SELECT * FROM (VALUES ('gap_before_days', 'ex_ante'), ('gap_after_7d_capped', 'outcome_proximal'), ('density_prev5', 'ex_ante'), ('density_prev10', 'ex_ante'), ('prior_focal_share', 'ex_ante'), ('lifecycle_position', 'descriptive_hindsight'), ('player_lifetime_days', 'ex_ante'), ('prior_session_count', 'ex_ante')) t(variable, timing)"


def _bins(source: str, bins: int) -> str:
    edges = f"SELECT variable, list_sort(list_distinct(quantile_cont(value, [{', '.join(str(k / bins) for k in range(bins + 1))}]))) AS e FROM {source} GROUP BY variable HAVING count(DISTINCT value) > 1"
    return f"SELECT variable, bin, count(*) AS sessions, count(DISTINCT pid) AS players, {r('min(value)')} AS value_min, {r('max(value)')} AS value_max, {q('value', 0.5)} AS value_median, {r('avg(recovered::INT)')} AS recovery_rate FROM (SELECT s.*, 1 + len(list_filter(e[2:], lambda x: x < value)) AS bin FROM {source} s JOIN ({edges}) USING (variable)) GROUP BY variable, bin"


add("quantile_bins", _bins("scn", 8))
add("density_bins", _bins("(SELECT * FROM scn WHERE variable = 'density_prev5')", 6))

_ROLL = ", ".join((f"{r(f'{m}_w{w}')} AS {m}_w{w}" if m != "unique_states" else f"{m}_w{w}") for w in ROLLING for m in METRICS)
add("rolling_metrics", f"SELECT session_id, {', '.join(f'window_n_w{w}' for w in ROLLING)}, {_ROLL} FROM rol")
_SLOPES = [f"narrowing_{m}_w{w}" for w in ROLLING for m in METRICS[:3]]
add("narrowing_slopes", f"SELECT session_id, slope_points, {', '.join(f'{r(c)} AS {c}' for c in _SLOPES)} FROM slp")
add("terminal_anchors", "SELECT pid, anchor_session_id, anchor_index, anchor_state_id FROM anc")
add("anchor_distribution", f"SELECT anchor_state_id, count(DISTINCT pid) AS players, count(*) AS anchors, {r('count(*) / (SELECT count(*) FROM anc)::DOUBLE')} AS share FROM anc GROUP BY anchor_state_id")


def _trend(groups: str, where: str = "true") -> str:
    parts = ", ".join(f"{r(f'avg({m}_w{w})')} AS {m}_w{w}_mean, {q(f'{m}_w{w}::DOUBLE', 0.5)} AS {m}_w{w}_median" for w in ROLLING for m in METRICS)
    return f"SELECT {groups}, count(*) AS sessions, count(DISTINCT pid) AS players, {parts} FROM bef WHERE {where} GROUP BY {groups}"


add("rigidity_by_lag", _trend("session_lag", "session_lag <= 20"))
add("rigidity_by_day", _trend("day_bin"))
add("rigidity_by_period", _trend("lag_period"))
add("rigidity_by_state_and_period", _trend("anchor_state_id, lag_period"))
add("rigidity_long", f"SELECT session_id, session_lag, day_bin, metric, window_ AS \"window\", {r('value')} AS value FROM bfl")
_NEAR, _FAR = "FILTER (session_lag <= 2)", "FILTER (session_lag BETWEEN 6 AND 10)"
_CONTRAST = f"window_ AS \"window\", metric, {r(f'avg(value) {_NEAR}')} AS near_mean, {r(f'avg(value) {_FAR}')} AS far_mean, {r(f'avg(value) {_NEAR} - avg(value) {_FAR}')} AS near_minus_far, count(value) {_NEAR} AS near_sessions, count(value) {_FAR} AS far_sessions"
add("near_far", f"SELECT {_CONTRAST} FROM bfl GROUP BY window_, metric")
add("near_far_by_state", f"SELECT anchor_state_id, {_CONTRAST} FROM bfl GROUP BY anchor_state_id, window_, metric")
add("player_contrast", f"SELECT pid, count(*) AS sessions, max(anchor_index) AS anchor_index, max(anchor_state_id) AS anchor_state_id, {r('max(days_to_anchor)')} AS days_observed, {', '.join(f'{r(f'avg({c}) {_NEAR}')} AS near_{c}, {r(f'avg({c}) {_FAR}')} AS far_{c}, {r(f'avg({c}) {_NEAR} - avg({c}) {_FAR}')} AS gap_{c}' for c in (f'{m}_w{w}' for w in ROLLING for m in ('state_entropy', 'self_transition_ratio')))} FROM bef GROUP BY pid")
add("player_slopes", f"SELECT pid, window_ AS \"window\", metric, count(*) AS points, {r('regr_slope(value, session_lag)')} AS slope FROM bfl WHERE value IS NOT NULL GROUP BY pid, window_, metric HAVING count(*) >= 3 AND count(DISTINCT session_lag) >= 2")
add("anchor_slopes", f"SELECT session_id, stratum, terminal_case, {', '.join(f'{r(c)} AS {c}' for c in _SLOPES)} FROM fra WHERE terminal_case IS NOT NULL")
add("rank_matches", "SELECT * FROM mch")
add("match_quality", f"SELECT count(*) AS matched_pairs, count(DISTINCT stratum) AS strata, {q('abs(case_index - control_index)::DOUBLE', 0.5)} AS median_index_gap FROM gmt")
add("greedy_matches", "SELECT stratum, number, case_pid, case_session_id, control_pid, control_session_id, case_index, control_index FROM gmt")
_P = "CASE WHEN z IS NOT NULL THEN greatest(0.0, 1 - 2 / sqrt(pi()) * x / 6000 * list_sum(list_transform(range(0, 2001), lambda k: CASE WHEN k IN (0, 2000) THEN 1.0 WHEN k % 2 = 1 THEN 4.0 ELSE 2.0 END * exp(-((x * k / 2000) ** 2))))) END"
_PAIRS = " UNION ALL ".join(f"SELECT '{c}' AS slope, x.{c} AS a, y.{c} AS b FROM gmt JOIN fra x ON x.session_id = case_session_id JOIN fra y ON y.session_id = control_session_id" for c in _SLOPES)
add("paired_comparison", f"""
SELECT slope, pairs, {r('case_mean')} AS case_mean, {r('control_mean')} AS control_mean, {r('mean_gap')} AS mean_gap, {r('se')} AS se, {r('z')} AS z, {r(_P)} AS p_value
FROM (SELECT *, least(abs(z) / sqrt(2), 10.0) AS x
  FROM (SELECT *, CASE WHEN se > 0 THEN mean_gap / se END AS z
    FROM (SELECT slope, count(*) AS pairs, avg(a) AS case_mean, avg(b) AS control_mean, avg(a - b) AS mean_gap, stddev_samp(a - b) / sqrt(count(*)) AS se FROM ({_PAIRS}) GROUP BY slope)))""")

add("squared_distances", f"SELECT id, label, {r('distance')} AS distance FROM near")
add("lloyd_step", f"SELECT label, count(*) AS size, {r('sum(distance)')} AS inertia, {', '.join(f'{r(f'avg(x{i})')} AS c{i}' for i in range(4))} FROM near GROUP BY label")
add("mixture_scores", f"SELECT id, label, {r('log_likelihood')} AS log_likelihood, {r('max_posterior')} AS max_posterior, {r('entropy')} AS entropy FROM psc")
add("em_step", f"SELECT p.label, {r('any_value(m) / (SELECT count(*) FROM emb)')} AS weight, {', '.join(f'{r(f'sum(p * x{i}) / any_value(m)')} AS mean{i}' for i in range(4))}, {', '.join(f'{r(f'greatest(1e-6, sum(p * (x{i} - u{i}) ** 2) / any_value(m))')} AS var{i}' for i in range(4))} FROM pst p JOIN (SELECT label, sum(p) AS m, {', '.join(f'sum(p * x{i}) / sum(p) AS u{i}' for i in range(4))} FROM pst GROUP BY label) USING (label) GROUP BY p.label")
add("posterior_summary", f"SELECT label, count(*) AS points, {r('avg(max_posterior)')} AS mean_max_posterior, {q('max_posterior', 0.5)} AS median_max_posterior, {q('max_posterior', 0.1)} AS p10_max_posterior, {r('count(*) FILTER (max_posterior < 0.6) * 100.0 / count(*)')} AS below_060_pct, {r('count(*) FILTER (max_posterior < 0.7) * 100.0 / count(*)')} AS below_070_pct, {r('avg(entropy)')} AS mean_entropy FROM psc GROUP BY label")
add("calinski_harabasz", f"SELECT {r('(b / (k - 1)) / (w / (n - k))')} AS calinski_harabasz FROM (SELECT sum(size * ({' + '.join(f'(c{i} - g{i}) ** 2' for i in range(4))})) AS b, count(*) AS k FROM (SELECT label, count(*) AS size FROM near GROUP BY label) JOIN cen USING (label), (SELECT {', '.join(f'avg(x{i}) AS g{i}' for i in range(4))} FROM emb)), (SELECT sum(distance) AS w, count(*) AS n FROM near)")
add("davies_bouldin", f"SELECT {r('avg(worst)')} AS davies_bouldin FROM (SELECT a.label, max((a.s + b.s) / sqrt({' + '.join(f'(ca.c{i} - cb.c{i}) ** 2' for i in range(4))})) AS worst FROM (SELECT label, avg(sqrt(distance)) AS s FROM near GROUP BY label) a JOIN (SELECT label, avg(sqrt(distance)) AS s FROM near GROUP BY label) b ON a.label <> b.label JOIN cen ca ON ca.label = a.label JOIN cen cb ON cb.label = b.label GROUP BY a.label)")
add("silhouette", f"SELECT {r('avg(CASE WHEN a IS NULL OR b IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END)')} AS silhouette FROM (SELECT id, max(CASE WHEN l1 = l2 THEN d END) AS a, min(CASE WHEN l1 <> l2 THEN d END) AS b FROM (SELECT p.id, p.label AS l1, q.label AS l2, avg(sqrt({' + '.join(f'(p.x{i} - q.x{i}) ** 2' for i in range(4))})) AS d FROM near p JOIN near q ON p.id <> q.id GROUP BY 1, 2, 3) GROUP BY id)")
add("adjusted_rand", f"SELECT {r('(ij - ai * bj / nn) / ((ai + bj) / 2 - ai * bj / nn)')} AS adjusted_rand FROM (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT count(*) AS n FROM near GROUP BY label, known)) AS ij, (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT count(*) AS n FROM near GROUP BY label)) AS ai, (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT count(*) AS n FROM near GROUP BY known)) AS bj, (SELECT count(*) * (count(*) - 1) / 2.0 FROM near) AS nn)")
add("cluster_sizes", f"SELECT label, count(*) AS size, {r('count(*) * 100.0 / (SELECT count(*) FROM near)')} AS pct FROM near GROUP BY label")
_MIX = "(SELECT cluster, CASE WHEN primary_game_mode = '' THEN '(missing)' ELSE primary_game_mode END AS primary_game_mode, count(*) AS sessions, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY cluster) AS pct FROM clu GROUP BY 1, 2)"
add("mode_mix", f"SELECT cluster, primary_game_mode, sessions, {r('pct')} AS pct FROM {_MIX}")
add(
    "cluster_profile",
    f"SELECT c.*, {r('c.size * 100.0 / (SELECT count(*) FROM clu)')} AS pct, m.primary_game_mode AS top_mode, {r('m.pct')} AS top_mode_pct FROM (SELECT cluster, count(*) AS size, count(DISTINCT pid) AS players, {r('avg(is_zero_duration::INT) * 100')} AS zero_duration_pct, {r('avg(is_long::INT) * 100')} AS long_pct, {', '.join(f'{r(f'avg({c})')} AS {c}_mean, {q(f'{c}::DOUBLE', 0.5)} AS {c}_median' for c in NUMERIC)} FROM clu GROUP BY cluster) c JOIN (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY sessions DESC, primary_game_mode) AS n FROM {_MIX}) m ON m.cluster = c.cluster AND m.n = 1",
)
add("minimal_cluster", f"SELECT cluster, size, {r('duration_median')} AS duration_median, {r('events_median')} AS events_median, {r('no_event_rate')} AS no_event_rate, {r('missing_mode_rate')} AS missing_mode_rate, minimal_score, row_number() OVER (ORDER BY minimal_score, duration_median, cluster) = 1 AS is_minimal FROM (SELECT *, rank() OVER (ORDER BY duration_median) + rank() OVER (ORDER BY events_median) + rank() OVER (ORDER BY no_event_rate DESC) + rank() OVER (ORDER BY missing_mode_rate DESC) AS minimal_score FROM (SELECT cluster, count(*) AS size, quantile_cont(duration_minutes, 0.5) AS duration_median, quantile_cont(events::DOUBLE, 0.5) AS events_median, count(*) FILTER (events = 0) / count(*)::DOUBLE AS no_event_rate, count(*) FILTER (primary_game_mode = '') / count(*)::DOUBLE AS missing_mode_rate FROM clu GROUP BY cluster))")
_KINDS = {
    "trajectory": "CASE WHEN trajectory <= 0 THEN 'first' WHEN trajectory <= 0.25 THEN 'early' WHEN trajectory <= 0.5 THEN 'middle' WHEN trajectory <= 0.75 THEN 'late' ELSE 'last' END",
    "previous": "coalesce(prev_cluster::VARCHAR, 'none')",
    "next": "coalesce(next_cluster::VARCHAR, 'none')",
    "month": "month",
}
_ROWS = " UNION ALL ".join(f"SELECT '{k}' AS kind, {v} AS value FROM cl2 WHERE cluster = 4" for k, v in _KINDS.items()) + " UNION ALL SELECT 'sessions_per_player', count(*)::VARCHAR FROM cl2 WHERE cluster = 4 GROUP BY pid"
add("audit_distributions", f"SELECT kind, value, n, {r('n * 100.0 / sum(n) OVER (PARTITION BY kind)')} AS pct FROM (SELECT kind, value, count(*) AS n FROM ({_ROWS}) GROUP BY kind, value)")
add("date_distribution", f"SELECT login_date, sessions, all_sessions, {r('sessions * 100.0 / sum(sessions) OVER ()')} AS pct, {r('sessions * 100.0 / all_sessions')} AS share_of_day_pct FROM (SELECT login_date, count(*) FILTER (cluster = 4) AS sessions, count(*) AS all_sessions FROM clu GROUP BY login_date) WHERE sessions > 0")
add("event_presence", " UNION ALL ".join(f"SELECT '{c}' AS event_feature, count(*) FILTER ({c} > 0) AS sessions_with_event, {r(f'count(*) FILTER ({c} > 0) * 100.0 / count(*)')} AS pct_with_event, sum({c})::BIGINT AS sum_events, {q(f'{c}::DOUBLE', 0.5)} AS median_events, max({c}) AS max_events FROM clu WHERE cluster = 1" for c in ACTIVITY))
_P = "count(*) FILTER (cluster = 4 AND ({c})) * 100.0 / nullif(count(*) FILTER (cluster = 4), 0)"


_OWN = "(SELECT count(*) AS n FROM cl2 WHERE cluster = 4 GROUP BY pid)"
_DAYS = "(SELECT login_date, count(*) AS n, sum(count(*)) OVER () AS t, row_number() OVER (ORDER BY count(*) DESC, login_date) AS d FROM cl2 WHERE cluster = 4 GROUP BY login_date)"
_PLACES = {"first": "trajectory <= 0", "early": "trajectory > 0 AND trajectory <= 0.25", "middle": "trajectory > 0.25 AND trajectory <= 0.5", "late": "trajectory > 0.5 AND trajectory <= 0.75", "last": "trajectory > 0.75"}


def _q4(x: str, p: float) -> str:
    return r(f"quantile_cont(({x})::DOUBLE, {p}) FILTER (cluster = 4)")


add(
    "audit_summary",
    f"SELECT count(*) FILTER (cluster = 4) AS sessions, {r('count(*) FILTER (cluster = 4) * 100.0 / count(*)')} AS pct_of_sessions, count(DISTINCT pid) FILTER (cluster = 4) AS players, {r('count(DISTINCT pid) FILTER (cluster = 4) * 100.0 / count(DISTINCT pid)')} AS pct_of_players, {r(_P.format(c='session_index = 1'))} AS first_session_pct, {r(_P.format(c='total_n = 1'))} AS single_session_player_pct, {_q4('session_index', 0.5)} AS median_session_index, {_q4('total_n', 0.5)} AS median_total_sessions, {_q4('trajectory', 0.5)} AS median_trajectory, {r(_P.format(c='prev_cluster IS NOT NULL'))} AS has_previous_pct, {r(_P.format(c='next_cluster IS NOT NULL'))} AS has_next_pct, {_q4('days_to_next', 0.5)} AS median_days_to_next, {_q4('days_to_next', 0.75)} AS p75_days_to_next, {r(_P.format(c='events > 0'))} AS any_event_pct, {_q4('events', 0.5)} AS median_events, max(events) FILTER (cluster = 4) AS max_events, {_q4('duration_minutes', 0.5)} AS duration_median, {_q4('duration_minutes', 0.95)} AS duration_p95, min(login_date) FILTER (cluster = 4) AS first_date, max(login_date) FILTER (cluster = 4) AS last_date, (SELECT {q('n::DOUBLE', 0.5)} FROM {_OWN}) AS median_sessions_per_player, (SELECT max(n) FROM {_OWN}) AS max_sessions_per_player, (SELECT login_date FROM {_DAYS} WHERE d = 1) AS top_date, (SELECT {r('n * 100.0 / t')} FROM {_DAYS} WHERE d = 1) AS top_date_pct, (SELECT {r('sum(n) * 100.0 / any_value(t)')} FROM {_DAYS} WHERE d <= 7) AS top_7_dates_pct FROM cl2",
)
_REGIMES = {"all": "true", "in_window": "is_window", "out_of_window": "NOT is_window", "before_window": "login_date < '2024-01-14'"}
_PROFILES = " UNION ALL ".join(
    f"SELECT '{k}' AS regime, count(*) AS regime_sessions, count(*) FILTER (cluster = 4) AS sessions, {r('count(*) FILTER (cluster = 4) * 100.0 / nullif(count(*), 0)')} AS pct_of_regime, count(DISTINCT pid) FILTER (cluster = 4) AS players, {_q4('duration_minutes', 0.5)} AS duration_median, {_q4('duration_minutes', 0.95)} AS duration_p95, {r(_P.format(c='events = 0'))} AS no_event_pct, {r(_P.format(c="primary_game_mode = ''"))} AS missing_mode_pct, {r(_P.format(c='next_cluster IS NOT NULL'))} AS has_next_pct, {_q4('days_to_next', 0.5)} AS median_days_to_next, {_q4('events', 0.5)} AS median_events, {r('count(DISTINCT pid) FILTER (cluster = 4) * 100.0 / nullif(count(DISTINCT pid), 0)')} AS pct_of_players, {r(_P.format(c='session_index = 1'))} AS first_session_pct, {_q4('trajectory', 0.5)} AS median_trajectory, {', '.join(f'{r(_P.format(c=v))} AS trajectory_{k2}_pct' for k2, v in _PLACES.items())}, (SELECT {q('n::DOUBLE', 0.5)} FROM (SELECT count(*) AS n FROM cl2 WHERE cluster = 4 AND {c} GROUP BY pid)) AS median_sessions_per_player, (SELECT max(n) FROM (SELECT count(*) AS n FROM cl2 WHERE cluster = 4 AND {c} GROUP BY pid)) AS max_sessions_per_player FROM cl2 WHERE {c}"
    for k, c in _REGIMES.items()
)
add("regime_profiles", _PROFILES)
add("all_cluster_profiles", f"SELECT cluster, count(*) AS size, count(DISTINCT pid) AS players, {q('duration_minutes', 0.5)} AS duration_median, {q('duration_minutes', 0.95)} AS duration_p95, {q('events::DOUBLE', 0.5)} AS events_median, {r('count(*) FILTER (events = 0) * 100.0 / count(*)')} AS no_event_pct, {r('avg((len(primary_game_mode) = 0)::INT) * 100')} AS missing_mode_pct, {r('avg((trajectory > 0.75)::INT) * 100')} AS trajectory_last_pct, {r('count(*) * 100.0 / (SELECT count(*) FROM cl2)')} AS pct FROM cl2 GROUP BY cluster")
add("minimal_gate", f"SELECT regime, coalesce(duration_median <= 2 AND no_event_pct >= 95 AND missing_mode_pct >= 90, false) AS minimal_found FROM ({_PROFILES})")
add("purchase_anomalies", f"SELECT login_date, count(*) AS sessions, count(DISTINCT pid) AS players, sum(items_purchased)::BIGINT AS items, {r('max(duration_minutes)')} AS longest_minutes FROM clu WHERE is_purchase_anomaly GROUP BY login_date")

_B = "coalesce({0}, false)::INT"
_STATES = ", ".join([f"(state_id = {s})::INT AS state_s{s}, {_B.format(f'prev_state_id = {s}')} AS prev_s{s}" for s in range(1, 5)] + [f"{_B.format(f'prev_state_id = {a} AND state_id = 4')} AS s{a}_to_s4" for a in (1, 2, 3)])
add("disengagement_frame", f"SELECT session_id, month, {_B.format('prev_state_id = 4 AND state_id = 4')} AS focal_persistence, {_STATES}, (session_index = 1)::INT AS first_session, {', '.join(f'{r(c)} AS {c}' for c in ('log_duration_minutes', 'log_gap_days', 'log_player_lifetime_days', 'log_prior_session_count', 'log_prior_focal_count'))}, {r('CASE WHEN job_completion_ratio IS NULL THEN 0 ELSE least(1.0, job_completion_ratio) END')} AS completion_ratio, {r('CASE WHEN job_exit_ratio IS NULL THEN 0 ELSE least(1.0, job_exit_ratio) END')} AS exit_ratio, mode_diversity, is_window, is_purchase_anomaly FROM cov")
add("path_frame", f"SELECT session_id, CASE WHEN state_id IN (1, 2) THEN 'S4->S1/S2' ELSE 'S4->S4' END AS path_label, month, (state_id IN (1, 2))::INT AS recovery_path, {', '.join(f'{r(c)} AS {c}' for c in ('log_gap_days', 'log_player_lifetime_days', 'log_prior_session_count', 'log_prior_focal_count', 'prior_focal_share'))}, is_window FROM cov WHERE prev_state_id = 4 AND state_id IN (1, 2, 4)")
_CUBE = "pow(greatest(density_prev5 - {0}, 0.0), 3)"
add("spline_basis", f"SELECT session_id, {r('density_prev5')} AS density_linear, {', '.join(r(f'{_CUBE.format(k)} - {_CUBE.format(0.5)} * {(1.0 - k) / 0.5!r} + {_CUBE.format(1.0)} * {(0.5 - k) / 0.5!r}') + f' AS density_rcs{i}' for i, k in ((1, 0.0), (2, 0.2)))} FROM foc")
add("model_samples", " UNION ALL ".join(f"SELECT '{name}' AS analysis, count(*) AS sessions, count(DISTINCT pid) AS players, count(*) FILTER (disengaged_{d}d) AS events, {r(f'count(*) FILTER (disengaged_{d}d) / nullif(count(*), 0)::DOUBLE')} AS event_rate, count(*) FILTER (state_id = 4) AS focal_sessions, {r(f'count(*) FILTER (state_id = 4 AND disengaged_{d}d) / nullif(count(*) FILTER (state_id = 4), 0)::DOUBLE')} AS focal_risk FROM lab WHERE evaluable_{d}d{' AND NOT is_window' if out else ''}" for name, d, out in (("1d", 1, False), ("3d", 3, False), ("7d", 7, False), ("7d_without_window", 7, True))))
