"""Queries of as-of and range joins."""

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import series, shape
from ..operators.frames import with_phase_attributes
from ..sources import views as V
from ..sources.views import K
from . import jobs
from .base import ORACLES, query, r6
from .series_queries import KEYS, MOVES, SPLIT, TS, VALLEYS, W, _movements

GOALS = "goals AS (SELECT *, sum((team = 'Home')::INT) OVER g AS home, sum((team = 'Away')::INT) OVER g AS away FROM event WHERE kind = 'purchase' WINDOW g AS (PARTITION BY match_id ORDER BY half, elapsed, event_id ROWS UNBOUNDED PRECEDING))"


def _events(spark, d, kind=None):
    e = V.match_events(spark, d)
    return e if kind is None else e.where(F.col("kind") == kind)


@query("w21_cumulative_score", f"WITH {V.EVENT}, {GOALS} SELECT event_id, match_id, home::BIGINT AS home, away::BIGINT AS away FROM goals")
def w21(spark, d):
    return I.cumulative_score(_events(spark, d, "purchase"), ["match_id"]).select("event_id", "match_id", "home", "away")


@query("w22_goals_and_shots", f"WITH {V.EVENT} SELECT match_id, half, team, count(*) FILTER (WHERE kind = 'purchase') AS n_goals, count(*) FILTER (WHERE kind = 'click') AS n_shots FROM event GROUP BY ALL")
def w22(spark, d):
    return _events(spark, d).groupBy("match_id", "half", "team").agg(F.count_if(F.col("kind") == "purchase").alias("n_goals"), F.count_if(F.col("kind") == "click").alias("n_shots"))


#: Tags by number: a shot stands in one of these, or, for None, on its own.
AROUND = ("FreeKick", "CornerKick", "Penalty", "ThrowIn", None, "KickOff", None)


def _event_xml(e):
    """events as Event elements: clicks and purchases are shots, purchases successful, in a set piece by the number in props."""
    shot = F.concat(F.lit('<ShotAtGoal Team="'), F.when(F.col("user_id") % 2 == 0, "Home").otherwise("Away"), F.lit('" Player="P'), "user_id", F.lit('">'), F.when(F.col("event_type") == "purchase", "<SuccessfulShot/>").otherwise(""), F.lit("</ShotAtGoal>"))
    k, held = F.from_json("props", "k INT")["k"] % len(AROUND), F.lit(None)
    for i, tag in enumerate(AROUND):
        held = F.when(k == i, F.concat(F.lit(f"<{tag}>"), shot, F.lit(f"</{tag}>")) if tag else shot).otherwise(held)
    play = F.concat(F.lit('<Play Player="P'), "user_id", F.lit('"/>'))
    body = F.when(F.col("event_type").isin("click", "purchase"), held).otherwise(play)
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return e.select(F.concat(F.lit('<Event EventTime="'), at, F.lit('" MatchId="M'), F.floor(F.col("user_id") / 22).cast("string"), F.lit('">'), body, F.lit("</Event>")).alias("xml"))


SHOTS = "shots AS (SELECT 'M' || (user_id // 22) AS match_id, CASE WHEN user_id % 2 = 0 THEN 'Home' ELSE 'Away' END AS team, 'P' || user_id AS player, event_type = 'purchase' AS goal, date_trunc('millisecond', ts) AS ts FROM events WHERE event_type IN ('click', 'purchase'))"


@query("w22_nested_shots", f"WITH {SHOTS} SELECT match_id, team, player, count(*) AS n_shots, count(*) FILTER (WHERE goal) AS n_goals, (max(epoch_ms(ts)) FILTER (WHERE goal))::BIGINT AS last_goal_ms FROM shots GROUP BY ALL")
def w22_nested(spark, d):
    """Shots and goals of event elements, nested in set pieces or not."""
    from ..sources import xml

    events = xml.parse_events(_event_xml(V.table(spark, d, "events")), "xml")
    by = ["match_id", "team", "player"]
    shots = xml.event_shots(events).groupBy(*by).agg(F.count(F.lit(1)).alias("n_shots"))
    goals = xml.event_goals(events).groupBy(*by).agg(F.count(F.lit(1)).alias("n_goals"), F.unix_millis(F.max("ts")).alias("last_goal_ms"))
    return shots.join(goals, by, "left").fillna(0, ["n_goals"])


@query("j4_scoreline_asof", f"""WITH {V.EVENT}, {GOALS}, p AS (SELECT * FROM event WHERE kind = 'view')
SELECT p.event_id, coalesce(g.home, 0)::BIGINT AS home, coalesce(g.away, 0)::BIGINT AS away, coalesce(g.home, 0)::BIGINT::VARCHAR || '-' || coalesce(g.away, 0)::BIGINT::VARCHAR AS scoreline
FROM p LEFT JOIN LATERAL (SELECT home, away FROM goals g WHERE g.match_id = p.match_id AND g.half = p.half AND g.elapsed <= p.elapsed ORDER BY g.elapsed DESC, g.event_id DESC LIMIT 1) g ON true""")
def j4(spark, d):
    goals = I.cumulative_score(_events(spark, d, "purchase"), ["match_id"])
    return I.score_at(_events(spark, d, "view"), goals).select("event_id", "home", "away", "scoreline")


@query("j4_scoreline_chunked", ORACLES["j4_scoreline_asof"])
def j4_chunked(spark, d):
    """The same over series cut into chunks of a quarter of an hour, which are scanned apart."""
    goals = I.cumulative_score(_events(spark, d, "purchase"), ["match_id"], width=900)
    return I.score_at(_events(spark, d, "view"), goals, width=900).select("event_id", "home", "away", "scoreline")


@query("j4_scoreline_carried", f"""WITH {V.EVENT}, {GOALS}, p AS (SELECT * FROM event WHERE kind = 'view'), f AS (SELECT match_id, max(home) AS fh, max(away) AS fa FROM goals WHERE half = 'F' GROUP BY match_id)
SELECT p.event_id, coalesce(g.home, CASE WHEN p.half = 'O' THEN fh END, 0)::BIGINT AS home, coalesce(g.away, CASE WHEN p.half = 'O' THEN fa END, 0)::BIGINT AS away
FROM p LEFT JOIN LATERAL (SELECT home, away FROM goals g WHERE g.match_id = p.match_id AND g.half = p.half AND g.elapsed <= p.elapsed ORDER BY g.elapsed DESC, g.event_id DESC LIMIT 1) g ON true LEFT JOIN f ON f.match_id = p.match_id""")
def j4_carried(spark, d):
    goals = I.cumulative_score(_events(spark, d, "purchase"), ["match_id"])
    return I.score_at(_events(spark, d, "view"), goals, carry_over=True).select("event_id", "home", "away")


BLACK = """black AS (SELECT match_id, half, event_id, CASE WHEN kick AND row_number() OVER (PARTITION BY match_id, half, kick ORDER BY elapsed, event_id) = 1 THEN 0 ELSE elapsed END::BIGINT AS b_start, elapsed + CASE WHEN kick THEN 150 ELSE 50 END AS b_end
  FROM (SELECT *, kind = 'signup' AS kick FROM event WHERE kind IN ('signup', 'click')))"""


def _set_pieces(spark, d):
    e = _events(spark, d).where(F.col("kind").isin("signup", "click"))
    return e.withColumns({"kind": F.when(F.col("kind") == "signup", "KickOff").otherwise("FreeKick"), "frame": F.col("elapsed")})


@query("w24_blackouts", f"WITH {V.EVENT}, {BLACK} SELECT match_id, half, b_start, b_end::BIGINT AS b_end FROM black")
def w24(spark, d):
    return I.blackouts(_set_pieces(spark, d))


@query("j5_blackout_exclusion", f"""WITH {V.EVENT}, {BLACK}, p AS (SELECT event_id, match_id, half, elapsed AS start_frame FROM event WHERE kind = 'view')
SELECT p.event_id, p.start_frame FROM p LEFT JOIN LATERAL (SELECT b_end FROM black b WHERE b.match_id = p.match_id AND b.half = p.half AND b.b_start <= p.start_frame ORDER BY b.b_start DESC, b_end DESC LIMIT 1) b ON true WHERE b_end IS NULL OR p.start_frame >= b_end""")
def j5(spark, d):
    p = _events(spark, d, "view").select("event_id", "match_id", "half", F.col("elapsed").alias("start_frame"))
    return I.outside_blackouts(p, I.blackouts(_set_pieces(spark, d))).select("event_id", "start_frame")


@query("j6_shot_follows", f"""WITH {V.EVENT}, p AS (SELECT * FROM event WHERE kind = 'view') SELECT event_id, EXISTS (SELECT 1 FROM event s WHERE s.kind = 'click' AND s.match_id = p.match_id AND s.half = p.half AND s.team = p.team AND s.elapsed BETWEEN p.elapsed AND p.elapsed + 600) AS shot_within FROM p""")
def j6(spark, d):
    p = _events(spark, d, "view").withColumn("end_s", F.col("elapsed").cast("double"))
    return I.shot_follows(p, _events(spark, d, "click"), 600).select("event_id", "shot_within")


@query("j6_shot_chunked", ORACLES["j6_shot_follows"])
def j6_chunked(spark, d):
    p = _events(spark, d, "view").withColumn("end_s", F.col("elapsed").cast("double"))
    return I.shot_follows(p, _events(spark, d, "click"), 600, width=900).select("event_id", "shot_within")


CONTACT = "ct AS (SELECT match_id, half, elapsed AS frame, player_id, event_id, 'passer' AS role FROM event WHERE kind IN ('view', 'click')), nx AS (SELECT *, coalesce(lead(frame) OVER (PARTITION BY match_id, half ORDER BY frame), frame + 250) AS end_frame FROM (SELECT DISTINCT match_id, half, frame FROM ct)), iv AS (SELECT match_id, half, ct.player_id, ct.frame + 5 AS start_frame, nx.end_frame FROM ct JOIN nx USING (match_id, half, frame) WHERE ct.frame + 5 < nx.end_frame)"


def _contacts(spark, d):
    return _events(spark, d).where(F.col("kind").isin("view", "click")).select("match_id", "half", F.col("elapsed").alias("frame"), "player_id", F.lit("passer").alias("role"))


@query("j7_possession_intervals", f"WITH {V.EVENT}, {CONTACT} SELECT match_id, half, player_id, start_frame, end_frame FROM iv")
def j7(spark, d):
    return I.possession_intervals(_contacts(spark, d), ["match_id", "half"], delay={"passer": 5}).drop("role")


@query("j8_paint_intervals", f"""WITH {V.TRACK}, {V.ANNOT}, {V.OWNED}, i AS (SELECT player_id, half, start_frame AS s, start_frame + (segment_id % 20) + 1 AS e, segment_id, team FROM owned),
t AS (SELECT player_id, half, frame, arg_max(i.team, [s, segment_id]) AS team FROM track JOIN i USING (player_id, half) WHERE frame >= s AND frame < e GROUP BY ALL)
SELECT k.player_id, k.half, k.frame, coalesce(t.team, CASE k.poss WHEN 1 THEN 'Home' WHEN 2 THEN 'Away' ELSE 'contest' END) AS painted FROM track k LEFT JOIN t USING (player_id, half, frame)""")
def j8(spark, d):
    from ..operators.predicates import possession_team

    i = V.owned(spark, d).select("player_id", "half", "start_frame", (F.col("start_frame") + F.col("segment_id") % 20 + 1).alias("end_frame"), "segment_id", F.col("team").alias("owner"))
    t = V.track(spark, d).withColumn("raw", possession_team(F.col("poss")))
    return I.paint(t, i, ["player_id", "half"], "owner", ["start_frame", "segment_id"], "raw").select("player_id", "half", "frame", "painted")


@query("j12_range_join", f"WITH {V.TRACK}, {V.ANNOT}, {V.OWNED} SELECT a.segment_id, count(*) AS n FROM owned a JOIN track t ON a.player_id = t.player_id AND a.half = t.half AND t.frame BETWEEN a.start_frame AND a.start_frame + 20 GROUP BY a.segment_id")
def j12_range(spark, d):
    a = V.owned(spark, d).select("segment_id", "player_id", "half", F.col("start_frame").alias("lo"))
    got = I.range_join(V.track(spark, d).select("player_id", "half", "frame"), a, ["player_id", "half"], F.col("frame"), F.col("lo"), F.col("lo") + 20, 32)
    return got.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n"))


@query("p17_contacts", f"WITH {V.EVENT} SELECT DISTINCT match_id, half, elapsed AS frame, player_id, CASE kind WHEN 'view' THEN 'passer' ELSE 'shooter' END AS role FROM event WHERE kind IN ('view', 'click') UNION SELECT DISTINCT match_id, half, elapsed, event_id % 50, 'recipient' FROM event WHERE event_id % 2 = 0")
def p17(spark, d):
    e = _events(spark, d).withColumns({"frame": F.col("elapsed"), "kind": F.when(F.col("kind") == "view", "Play").when(F.col("kind") == "click", "ShotAtGoal").otherwise(F.col("kind")), "recipient_id": F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 50)})
    return I.contacts(e).drop("tag")


@query("u2_deduped_contacts", f"WITH {V.EVENT}, c AS (SELECT DISTINCT match_id, half, elapsed, player_id, CASE kind WHEN 'view' THEN 'passer' ELSE 'shooter' END AS role FROM event WHERE kind IN ('view', 'click') UNION SELECT DISTINCT match_id, half, elapsed, event_id % 50, 'recipient' FROM event WHERE event_id % 2 = 0) SELECT match_id, role, count(*) AS n FROM c GROUP BY ALL")
def u2(spark, d):
    return p17(spark, d).groupBy("match_id", "role").agg(F.count(F.lit(1)).alias("n"))


@query("w23_anchors", f"WITH {V.EVENT} SELECT match_id, coalesce(min(elapsed) FILTER (WHERE kind = 'signup' AND elapsed <= 300000), 0) AS kickoff_frame_1, coalesce(min(elapsed) FILTER (WHERE kind = 'signup' AND elapsed > 300000), 300000) AS second_start, coalesce(min(elapsed) FILTER (WHERE kind = 'signup' AND half = 'O'), 67500) AS kickoff_frame_2 FROM event GROUP BY match_id")
def w23(spark, d):
    e = _events(spark, d).withColumns({"frame": F.col("elapsed"), "kind": F.when(F.col("kind") == "signup", "KickOff").otherwise(F.col("kind"))})
    return I.anchors(e, 300_000)


@query("j14_trajectory_lookup", f"""{TS}, {VALLEYS}, {MOVES}, own AS (SELECT {KEYS}, movement_id, 'trajectory' AS shape_method, row_number() OVER (PARTITION BY {KEYS}, movement_id ORDER BY frame) - 1 AS point, x::DOUBLE AS x, y::DOUBLE AS y FROM mov SEMI JOIN (SELECT * FROM movement WHERE duration_s >= 0.4) USING ({KEYS}, movement_id)),
three AS (SELECT {KEYS}, movement_id, 'summary' AS shape_method, p.point::BIGINT, p.x, p.y FROM (SELECT *, unnest([{{'point': 0, 'x': x_start::DOUBLE, 'y': y_start::DOUBLE}}, {{'point': 1, 'x': x_mid, 'y': y_mid}}, {{'point': 2, 'x': x_end::DOUBLE, 'y': y_end::DOUBLE}}]) AS p FROM movement WHERE duration_s < 0.4))
SELECT * FROM own UNION ALL SELECT * FROM three""")
def j14(spark, d):
    """Only movements of 0.4 s and more have stored trajectories, the others fall back to their summary's points."""
    moves = _movements(spark, d)
    df = series.number_movements(series.valley_segments(series.speed(V.track(spark, d), K, unit=0.1 / 25), K, parts=V.parts(spark, d)), K, ["segment_id"])
    stored = df.join(moves.where("duration_s >= 0.4").select(*K, "movement_id"), [*K, "movement_id"], "left_semi")
    return shape.trajectories(moves, stored, [*K, "movement_id"])


#: Goals and other events in frames, after `event`.
GAME = """ev AS (SELECT event_id, match_id, half, team, elapsed % 3000 AS frame, (elapsed % 3000) / 25.0::DOUBLE AS el, CASE kind WHEN 'purchase' THEN 'goal' WHEN 'click' THEN 'shot' WHEN 'signup' THEN 'FreeKick' ELSE 'view' END AS kind FROM event),
gl AS (SELECT *, sum((team = 'Home')::INT) OVER g AS home, sum((team = 'Away')::INT) OVER g AS away FROM ev WHERE kind = 'goal' WINDOW g AS (PARTITION BY match_id ORDER BY half, el, event_id ROWS UNBOUNDED PRECEDING))"""
#: The context of movements (start_frame, end_frame, team): score, shots and blackouts.
CONTEXT = GAME + """,
context AS (SELECT m.*, coalesce(g.home, 0)::BIGINT AS home, coalesce(g.away, 0)::BIGINT AS away, EXISTS (SELECT 1 FROM ev s WHERE s.kind = 'shot' AND s.match_id = m.match_id AND s.half = m.half AND s.team = m.team AND s.el BETWEEN m.end_frame / 25.0::DOUBLE AND m.end_frame / 25.0::DOUBLE + 10) AS shot_within
  FROM movement m LEFT JOIN LATERAL (SELECT home, away FROM gl WHERE gl.match_id = m.match_id AND gl.half = m.half AND gl.el <= m.start_frame / 25.0::DOUBLE ORDER BY gl.el DESC, gl.event_id DESC LIMIT 1) g ON true
  LEFT JOIN LATERAL (SELECT frame + 50 AS b_end FROM ev b WHERE b.kind = 'FreeKick' AND b.match_id = m.match_id AND b.half = m.half AND b.frame <= m.start_frame ORDER BY b.frame DESC LIMIT 1) b ON true WHERE b_end IS NULL OR m.start_frame >= b_end)"""
CONTEXT_OUT = "home::VARCHAR || '-' || away::VARCHAR AS scoreline, CASE WHEN team = 'Away' THEN away - home ELSE home - away END AS goal_indicator, shot_within"


def _match_frames(spark, d):
    at = F.col("elapsed") % 3000
    kinds = F.when(F.col("kind") == "purchase", "goal").when(F.col("kind") == "click", "shot").when(F.col("kind") == "signup", "FreeKick").otherwise("view")
    return _events(spark, d).withColumns({"frame": at, "elapsed": at / 25, "kind": kinds})


@query("g1_match_context", f"{TS}, {VALLEYS}, {MOVES}, {V.EVENT}, {CONTEXT} SELECT {KEYS}, movement_id, {CONTEXT_OUT} FROM context")
def g1_context(spark, d):
    return jobs.match_context(_movements(spark, d), _match_frames(spark, d)).select(*K, "movement_id", "scoreline", "goal_indicator", "shot_within")


#: The whole job: smoothed track and possession, power split, summary, context and the choice of runs.
SMOOTH = f"""{V.TRACK.replace("track AS", "raw AS", 1)}, pr AS (SELECT *, count(*) OVER (PARTITION BY {KEYS}, run) AS run_n FROM (SELECT *, sum(ch) OVER {W} AS run FROM (SELECT *, CASE WHEN lag(poss) OVER {W} <> poss THEN 1 ELSE 0 END AS ch FROM raw))),
track AS (SELECT {KEYS}, frame, {", ".join(f"CASE WHEN count(*) OVER (PARTITION BY {KEYS}) >= 4 THEN coalesce((lag({c}) OVER w + 2 * {c} + lead({c}) OVER w) / 4.0::DOUBLE, {c}) END AS {c}" for c in "xy")}, last_value(CASE WHEN run_n >= 3 OR run = 0 THEN poss END IGNORE NULLS) OVER w AS poss FROM pr WINDOW w AS (PARTITION BY {KEYS} ORDER BY frame)), {V.SPEED}"""
PIECES = MOVES.replace("ORDER BY segment_id) - 1 AS movement_id FROM seg)", "ORDER BY segment_id, piece) - 1 AS movement_id FROM pieces)").replace("arg_min(poss, frame) AS first_poss FROM stp", "arg_min(poss, frame) AS first_poss, sum(greatest(ec, 0) * v) / 25 AS energy FROM stp")


@query("g1_whole_job", f"""WITH {SMOOTH}, {VALLEYS}, {SPLIT}, {PIECES}, {V.EVENT}, {CONTEXT}
SELECT {KEYS}, movement_id, start_frame, end_frame, peak_frame, round(distance_m, 4) + 0.0 AS distance_m, round(peak_speed_kmh, 4) AS peak_speed_kmh, round(x_mid, 4) + 0.0 AS x_mid, round(energy, 3) + 0.0 AS total_energy_cost_J, possession, speed_category, {CONTEXT_OUT}
FROM context WHERE (possession = team OR possession_contested) AND speed_category IN ('running', 'sprinting') AND distance_m > 2.5 AND direction > 0.3""")
def g1_whole(spark, d):
    t = V.track(spark, d)
    runs = jobs.movement_job(t, jobs.directions_of(t), _match_frames(spark, d), unit=0.1 / 25, shortest_possession=3, parts=V.parts(spark, d))
    rounded = [(F.round(c, n) + 0.0).alias(c) for c, n in (("distance_m", 4), ("peak_speed_kmh", 4), ("x_mid", 4), ("total_energy_cost_J", 3))]
    return runs.select(*K, "movement_id", "start_frame", "end_frame", "peak_frame", *rounded, "possession", "speed_category", "scoreline", "goal_indicator", "shot_within")


ZONES = ", ".join(f"CASE WHEN x_{at} * s < -17.5 THEN 'D' WHEN x_{at} * s <= 17.5 THEN 'M' ELSE 'A' END || CASE WHEN y_{at} * s < -20.16 THEN 'R' WHEN y_{at} * s < -3.66 THEN 'HR' WHEN y_{at} * s < 3.66 THEN 'C' WHEN y_{at} * s < 20.16 THEN 'HL' ELSE 'L' END AS zone_{at}" for at in ("start", "mid", "end"))
#: Measures of the intervals in `owned`, after `speed`.
INDICATORS = f"""half_end AS (SELECT half, max(frame) AS e FROM track GROUP BY half), cl AS (SELECT segment_id, player_id, o.half, greatest(0, least(start_frame, e)) AS lo, greatest(0, least(end_frame, e)) AS hi, CASE segment_id % 3 WHEN 0 THEN 'left_to_right' WHEN 1 THEN 'right_to_left' END AS dir FROM owned o JOIN half_end h ON o.half = h.half),
ir AS (SELECT c.segment_id, c.lo, c.hi, c.dir, t.frame, t.x, t.y, t.v, t.poss, t.frame >= c.lo AS run FROM cl c JOIN speed t ON c.player_id = t.player_id AND c.half = t.half AND t.frame BETWEEN greatest(c.lo - 50, 0) AND c.hi WHERE c.lo < c.hi),
ia AS (SELECT *, coalesce((lead(v) OVER w - lag(v) OVER w) / (2 * 0.04::DOUBLE), (lead(v) OVER w - v) / 0.04::DOUBLE, (v - lag(v) OVER w) / 0.04::DOUBLE, 0) AS accel, sqrt(CAST((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w) AS DOUBLE)) AS st FROM ir WINDOW w AS (PARTITION BY segment_id, run ORDER BY frame)),
ie AS (SELECT *, (((((155.4 * i - 30.4) * i - 43.3) * i + 46.3) * i + 19.5) * i + 3.6) * 1.29 AS ec FROM (SELECT *, greatest(least(accel / 9.81, 0.5), -0.5) AS i FROM ia)),
ig AS (SELECT segment_id, any_value(lo) AS lo, any_value(hi) AS hi, any_value(dir) AS dir, count(*) FILTER (WHERE run) AS n_points, sum(st) FILTER (WHERE run) AS dist, avg(v) FILTER (WHERE run) AS mv, max(v) FILTER (WHERE run) AS pk, arg_min(frame, [-v, frame]) FILTER (WHERE run) AS peak_frame, sum(greatest(ec, 0) * v) FILTER (WHERE run) / 25 AS energy,
  avg(v) FILTER (WHERE NOT run) AS pm, max(v) FILTER (WHERE NOT run) AS pp, arg_min(x, frame) FILTER (WHERE run) AS x_start, median(x) FILTER (WHERE run) AS x_mid, arg_max(x, frame) FILTER (WHERE run) AS x_end, arg_min(y, frame) FILTER (WHERE run) AS y_start, median(y) FILTER (WHERE run) AS y_mid, arg_max(y, frame) FILTER (WHERE run) AS y_end, avg((poss = 1)::INT::DOUBLE) FILTER (WHERE run) AS ratio
  FROM ie GROUP BY segment_id HAVING count(*) FILTER (WHERE run) >= 2),
indicators AS (SELECT segment_id, n_points, round(dist, 2) AS distance_m, round((hi - lo) / 25.0::DOUBLE, 2) AS duration_s, round(mv, 3) AS mean_vel_ms, round(pk, 3) AS peak_vel_ms, peak_frame, CASE WHEN pk * 3.6 < 7 THEN 'walking' WHEN pk * 3.6 < 14 THEN 'jogging' WHEN pk * 3.6 < 21 THEN 'running' ELSE 'sprinting' END AS speed_category, round(energy, 2) + 0.0 AS total_energy_cost_J,
  round(pm, 3) AS pre_run_mean_vel_ms, round(pp, 3) AS pre_run_peak_vel_ms, CASE WHEN lo > 0 THEN round(least(lo, 50) / 25.0::DOUBLE, 2) END AS pre_run_window_s, x_start, x_mid, x_end, y_start, y_mid, y_end, {ZONES}, s AS attack_sign, round(CASE WHEN abs(x_end - x_start) + abs(y_end - y_start) = 0 THEN 0 ELSE (x_end - x_start)::DOUBLE / (abs(x_end - x_start) + abs(y_end - y_start)) END * s, 4) + 0.0 AS direction,
  CASE WHEN ratio >= 0.5 THEN 'Home' ELSE 'Away' END AS possession, round(ratio, 3) AS possession_ratio, ratio > 0.3 AND ratio < 0.7 AS possession_contested FROM (SELECT *, CASE dir WHEN 'right_to_left' THEN -1 ELSE 1 END AS s FROM ig))"""
INDICATOR_COLUMNS = ["n_points", "distance_m", "duration_s", "mean_vel_ms", "peak_vel_ms", "peak_frame", "speed_category", "total_energy_cost_J", "pre_run_mean_vel_ms", "pre_run_peak_vel_ms", "pre_run_window_s", "x_start", "x_mid", "x_end", "y_start", "y_mid", "y_end", "zone_start", "zone_mid", "zone_end", "attack_sign", "direction", "possession", "possession_ratio", "possession_contested"]


def _indicators(spark, d):
    from ..operators.indicators import interval_indicators

    turn = F.when(F.col("segment_id") % 3 == 0, "left_to_right").when(F.col("segment_id") % 3 == 1, "right_to_left")
    on = ["player_id", "half"]
    v = series.speed(V.track(spark, d, on, V.INTERVAL_PARTS), K, unit=0.1 / 25)
    return interval_indicators(V.owned(spark, d).withColumn("play_direction", turn), v, on, ["half"], parts=V.INTERVAL_PARTS * V.parts(spark, d), ends=V.last_frames(spark, d))


@query("a3_interval_indicators", f"{TS}, {V.ANNOT}, {V.OWNED}, {INDICATORS} SELECT segment_id, {', '.join(INDICATOR_COLUMNS)} FROM indicators")
def a3(spark, d):
    return _indicators(spark, d).withColumns({"total_energy_cost_J": F.col("total_energy_cost_J") + 0.0, "direction": F.col("direction") + 0.0}).select("segment_id", *INDICATOR_COLUMNS)


@query("a15_phase_positions", f"WITH {V.TRACK}, p AS (SELECT match_id, half, frame // 50 AS phase_id, player_id, avg(x) AS mx, avg(y) AS my, count(x) / count(*) AS cov FROM track GROUP BY ALL), q AS (SELECT *, count(*) OVER (PARTITION BY match_id, half, phase_id) AS n FROM p WHERE cov >= 0.5) SELECT match_id, half, phase_id, player_id, round(mx, 6) + 0.0 AS mean_x, round(my, 6) + 0.0 AS mean_y FROM q WHERE n >= 2")
def a15(spark, d):
    from ..operators.context import phase_positions

    t = V.track(spark, d).withColumn("phase_id", F.floor(F.col("frame") / 50))
    return phase_positions(t, ["match_id", "half", "phase_id"], players=2).select("match_id", "half", "phase_id", "player_id", r6("mean_x"), r6("mean_y"))


@query("j15_phase_attributes", f"WITH {V.TRACK}, p AS (SELECT {KEYS}, frame // 20 AS phase_id, count(*) FILTER (WHERE poss = 1) AS n_home FROM track GROUP BY ALL) SELECT t.player_id, t.half, t.frame, p.n_home FROM track t JOIN p ON t.frame // 20 = p.phase_id AND t.player_id = p.player_id AND t.half = p.half AND t.match_id = p.match_id AND t.team = p.team")
def j15(spark, d):
    t = V.track(spark, d).withColumn("phase_id", F.floor(F.col("frame") / 20))
    p = t.groupBy(*K, "phase_id").agg(F.count_if(F.col("poss") == 1).alias("n_home"))
    return with_phase_attributes(t, p, K).select("player_id", "half", "frame", "n_home")
