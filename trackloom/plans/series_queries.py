"""Queries over ordered series."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import frames, predicates, series, shape
from ..sources import views as V
from ..sources.views import K
from . import jobs
from .base import query, r6

KEYS = ", ".join(K)
W = f"(PARTITION BY {KEYS} ORDER BY frame)"
TS = f"WITH {V.TRACK}, {V.SPEED}"


def _speed(spark, d):
    return series.speed(V.track(spark, d), K, unit=0.1 / 25)


#: Candidate valleys, thinned and deep ones, and the segments between them, after `speed`.
def _valleys(distance: int, deep: bool) -> str:
    keep = f"drop_ >= 0.15 AND CASE WHEN peak > 0 THEN drop_ / peak ELSE 0 END >= 0.05" if deep else "true"  # noqa: F541
    return f"""
flat AS (SELECT *, sum(ch) OVER {W} AS fl FROM (SELECT *, CASE WHEN lag(v) OVER {W} IS DISTINCT FROM v AND lag(frame) OVER {W} IS NOT NULL THEN 1 ELSE 0 END AS ch FROM speed)),
fl1 AS (SELECT {KEYS}, fl, any_value(v) AS v, min(frame) AS a, max(frame) AS b FROM flat GROUP BY {KEYS}, fl),
cand AS (SELECT {KEYS}, (a + b) // 2 AS frame, v FROM (SELECT *, lag(v) OVER w AS pv, lead(v) OVER w AS nv FROM fl1 WINDOW w AS (PARTITION BY {KEYS} ORDER BY fl)) WHERE pv > v AND nv > v),
thin AS (SELECT {KEYS}, unnest(list_reduce(list_transform(list(frame ORDER BY v, frame DESC), lambda c: [c]), lambda a, c: CASE WHEN len(list_filter(a, lambda k: abs(k - c[1]) < {distance})) > 0 THEN a ELSE list_concat(a, c) END)) AS frame FROM cand GROUP BY {KEYS}),
peaks AS (SELECT *, peak - v AS drop_ FROM (SELECT *, max(v) OVER (PARTITION BY {KEYS} ORDER BY frame ROWS BETWEEN {distance} PRECEDING AND {distance - 1} FOLLOWING) AS peak FROM speed)),
marked AS (SELECT p.*, t.frame IS NOT NULL AND {keep} AS is_valley FROM peaks p LEFT JOIN thin t USING ({KEYS}, frame)),
seg0 AS (SELECT *, sum(is_valley::INT) OVER {W} AS segment_id, lead(frame) OVER {W} AS nxt FROM marked),
seg AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {KEYS}, segment_id) AS nn FROM seg0 WHERE nxt IS NOT NULL) WHERE nn >= 3)"""


VALLEYS, PLAIN = _valleys(15, True), _valleys(10, False)
MOVES = f"""
mov AS (SELECT *, dense_rank() OVER (PARTITION BY {KEYS} ORDER BY segment_id) - 1 AS movement_id FROM seg),
stp AS (SELECT *, sqrt(CAST((x - px) * (x - px) + (y - py) * (y - py) AS DOUBLE)) AS step FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM mov WINDOW w AS (PARTITION BY {KEYS}, movement_id ORDER BY frame))),
summ AS (SELECT {KEYS}, movement_id, min(frame) AS start_frame, max(frame) AS end_frame, arg_min(frame, [-v, frame]) AS peak_frame, arg_min(x, frame) AS x_start, arg_min(y, frame) AS y_start,
  median(x) AS x_mid, median(y) AS y_mid, arg_max(x, frame) AS x_end, arg_max(y, frame) AS y_end, max(v) * 3.6 AS peak_speed_kmh, avg(v) * 3.6 AS avg_velocity_kmh, coalesce(sum(step), 0) AS distance_m,
  count(*) / 25.0::DOUBLE AS duration_s, avg((poss = 1)::INT::DOUBLE) AS ratio, arg_min(poss, frame) AS first_poss FROM stp GROUP BY {KEYS}, movement_id),
dirs AS (SELECT *, CASE WHEN (match_id % 2 = 0) = (half = 'F') THEN 1 ELSE -1 END * CASE WHEN team = 'Home' THEN 1 ELSE -1 END AS attack_sign,
  CASE WHEN peak_speed_kmh < 7 THEN 'walking' WHEN peak_speed_kmh < 14 THEN 'jogging' WHEN peak_speed_kmh < 21 THEN 'running' ELSE 'sprinting' END AS speed_category,
  CASE WHEN ratio >= 0.5 THEN 'Home' ELSE 'Away' END AS possession, ratio > 0.3 AND ratio < 0.7 AS possession_contested FROM summ WHERE distance_m > 0),
movement AS (SELECT *, CASE WHEN abs(x_end - x_start) + abs(y_end - y_start) = 0 THEN 0 ELSE (x_end - x_start)::DOUBLE / (abs(x_end - x_start) + abs(y_end - y_start)) END * attack_sign AS direction FROM dirs)"""

OUT = [*K, "movement_id", "start_frame", "end_frame", "peak_frame", "x_start", "x_end", "speed_category", "possession"]
OUT_R = ["x_mid", "y_mid", "peak_speed_kmh", "avg_velocity_kmh", "distance_m", "duration_s", "direction"]
OUT_SQL = ", ".join(OUT) + ", " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in OUT_R)


def _movements(spark, d):
    t = V.track(spark, d)
    return jobs.extract_movements(t, jobs.directions_of(t), unit=0.1 / 25, parts=V.parts(spark, d))


@query("g1_movement_extraction", f"{TS}, {VALLEYS}, {MOVES} SELECT {OUT_SQL} FROM movement WHERE (possession = team OR possession_contested) AND speed_category IN ('running', 'sprinting') AND distance_m > 2.5 AND direction > 0.3")
def g1(spark, d):
    return predicates.run_candidates(_movements(spark, d)).select(*OUT, *[r6(c) for c in OUT_R])


@query("a1_movement_summary", f"{TS}, {VALLEYS}, {MOVES} SELECT {OUT_SQL} FROM movement")
def a1(spark, d):
    return _movements(spark, d).select(*OUT, *[r6(c) for c in OUT_R])


@query("a2_light_summary", f"{TS}, {PLAIN}, {MOVES} SELECT {KEYS}, movement_id, start_frame, end_frame, round(distance_m, 2) AS distance_m, ratio > 0.35 AND ratio < 0.65 AS possession_contested FROM summ")
def a2(spark, d):
    df = series.number_movements(series.plain_valley_segments(_speed(spark, d), K, parts=V.parts(spark, d)), K, ["segment_id"])
    return series.movement_summary(df, K, contested=(0.35, 0.65)).select(*K, "movement_id", "start_frame", "end_frame", F.round("distance_m", 2).alias("distance_m"), "possession_contested")


@query("a24_first_frame_possession", f"{TS}, {PLAIN}, {MOVES} SELECT {KEYS}, movement_id, first_poss, CASE WHEN first_poss = 1 THEN 'Home' WHEN first_poss = 2 THEN 'Away' ELSE 'contest' END AS possession FROM summ")
def a24(spark, d):
    df = series.number_movements(series.plain_valley_segments(_speed(spark, d), K, parts=V.parts(spark, d)), K, ["segment_id"])
    return series.movement_summary(df, K).select(*K, "movement_id", "first_poss", predicates.possession_team(F.col("first_poss")).alias("possession"))


@query("a4_total_distance", f"{TS}, {VALLEYS}, {MOVES} SELECT team, player_id, round(sum(distance_m), 4) AS total_distance_m, count(*) AS n_movements FROM movement GROUP BY team, player_id")
def a4(spark, d):
    return series.total_distance(_movements(spark, d), ["team", "player_id"]).withColumn("total_distance_m", F.round("total_distance_m", 4))


@query("p1_run_candidates", f"{TS}, {VALLEYS}, {MOVES} SELECT speed_category, count(*) AS n, count(*) FILTER (WHERE (possession = team OR possession_contested) AND speed_category IN ('running', 'sprinting') AND distance_m > 2.5 AND direction > 0.3) AS n_candidates FROM movement GROUP BY 1")
def p1(spark, d):
    m = _movements(spark, d)
    c = predicates.run_candidates(m).groupBy("speed_category").agg(F.count(F.lit(1)).alias("n_candidates"))
    return m.groupBy("speed_category").agg(F.count(F.lit(1)).alias("n")).join(c, "speed_category", "left").fillna(0, ["n_candidates"])


@query("p2_candidates_unknown_sign", f"{TS}, {VALLEYS}, {MOVES} SELECT {KEYS}, movement_id FROM movement WHERE (possession = team OR possession_contested) AND speed_category IN ('running', 'sprinting') AND distance_m > 2.5 AND -direction > 0.3")
def p2(spark, d):
    return predicates.run_candidates(_movements(spark, d), sign=predicates.attack_sign(F.lit(None).cast("string"), unknown=-1)).select(*K, "movement_id")


@query("p3_moving_only", f"{TS}, {VALLEYS}, {MOVES} SELECT team, count(*) AS n FROM summ WHERE distance_m > 0 GROUP BY team")
def p3(spark, d):
    return _movements(spark, d).groupBy("team").agg(F.count(F.lit(1)).alias("n"))


@query("p4_window_overlap", f"{TS}, {VALLEYS}, {MOVES} SELECT {KEYS}, movement_id, start_frame, end_frame FROM movement WHERE end_frame >= 50 AND start_frame <= 120")
def p4(spark, d):
    return predicates.overlapping(_movements(spark, d), 50, 120).select(*K, "movement_id", "start_frame", "end_frame")


@query("p5_legacy_criteria", f"{TS}, {VALLEYS}, {MOVES} SELECT {KEYS}, movement_id FROM movement WHERE possession = team AND speed_category <> 'walking' AND duration_s >= 0.6 AND direction > 0 AND x_start >= -20")
def p5(spark, d):
    return predicates.legacy_criteria(_movements(spark, d), min_duration=0.6, min_x=-20).select(*K, "movement_id")


ZONE = "CASE WHEN {x} * s < -17.5 THEN 'D' WHEN {x} * s <= 17.5 THEN 'M' ELSE 'A' END || CASE WHEN {y} * s < -20.16 THEN 'R' WHEN {y} * s < -3.66 THEN 'HR' WHEN {y} * s < 3.66 THEN 'C' WHEN {y} * s < 20.16 THEN 'HL' ELSE 'L' END"


@query("p10_zones", f"{TS}, {VALLEYS}, {MOVES} SELECT zone_start, zone_end, count(*) AS n FROM (SELECT {ZONE.format(x='x_start', y='y_start')} AS zone_start, {ZONE.format(x='x_end', y='y_end')} AS zone_end FROM (SELECT *, attack_sign AS s FROM movement)) GROUP BY ALL")
def p10(spark, d):
    return _movements(spark, d).groupBy("zone_start", "zone_end").agg(F.count(F.lit(1)).alias("n"))


@query("p9_speed_category", f"{TS} SELECT player_id, frame, CASE WHEN v * 3.6 < 7 THEN 'walking' WHEN v * 3.6 < 14 THEN 'jogging' WHEN v * 3.6 < 21 THEN 'running' ELSE 'sprinting' END AS category, half FROM speed")
def p9(spark, d):
    return _speed(spark, d).select("player_id", "half", "frame", predicates.speed_category(F.col("v") * 3.6).alias("category"))


@query("w1_low_pass", f"WITH {V.TRACK} SELECT {KEYS}, frame, CASE WHEN count(*) OVER (PARTITION BY {KEYS}) >= 4 THEN coalesce((lag(x) OVER w + 2 * x + lead(x) OVER w) / 4.0::DOUBLE, x) END AS x FROM track WINDOW w AS {W}")
def w1(spark, d):
    return series.low_pass(V.track(spark, d), K, ["x"]).select(*K, "frame", "x")


@query("w2_speed", f"{TS} SELECT {KEYS}, frame, v FROM speed")
def w2(spark, d):
    return _speed(spark, d).select(*K, "frame", "v")


@query("w3_backward_velocity", f"WITH {V.TRACK} SELECT {KEYS}, frame, coalesce((x - lag(x) OVER w) * 25.0::DOUBLE, 0) AS vx, coalesce((y - lag(y) OVER w) * 25.0::DOUBLE, 0) AS vy FROM track WINDOW w AS {W}")
def w3(spark, d):
    return series.backward_velocity(V.track(spark, d), K).select(*K, "frame", "vx", "vy")


@query("w4_ball_speed", f"WITH {V.TRACK}, b AS (SELECT {KEYS}, frame, sqrt(coalesce(x - lag(x) OVER w, 0)::DOUBLE * 25 * 25 * coalesce(x - lag(x) OVER w, 0) + coalesce(y - lag(y) OVER w, 0)::DOUBLE * 25 * 25 * coalesce(y - lag(y) OVER w, 0)) * 3.6 AS k, coalesce((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w), 0) AS dd FROM track WINDOW w AS {W}) SELECT {KEYS}, frame, round(k, 6) AS ball_speed_kmh, dd > 1600 AS radius_frozen FROM b")
def w4(spark, d):
    df = series.ball_speed(V.track(spark, d), K, freeze_above=3600)  # 40 units of place a frame
    return df.select(*K, "frame", r6("ball_speed_kmh"), "radius_frozen")


POWER = f"""pw AS (SELECT *, v * accel AS power, greatest(least(accel / 9.81, 0.5), -0.5) AS slope FROM (SELECT *, coalesce((lead(v) OVER w - lag(v) OVER w) / (2 * 0.04::DOUBLE), (lead(v) OVER w - v) / 0.04::DOUBLE, (v - lag(v) OVER w) / 0.04::DOUBLE, 0) AS accel FROM {{src}} WINDOW w AS ({{part}}))),
cost AS (SELECT *, (((((155.4 * slope - 30.4) * slope - 43.3) * slope + 46.3) * slope + 19.5) * slope + 3.6) * 1.29 AS ec FROM pw)"""


@query("w5_metabolic_power", f"{TS}, {POWER.format(src='speed', part=f'PARTITION BY {KEYS} ORDER BY frame')} SELECT {KEYS}, frame, round(accel, 6) + 0.0 AS accel, round(power, 6) + 0.0 AS power, round(ec, 6) AS ec FROM cost")
def w5(spark, d):
    return series.metabolic_power(_speed(spark, d), K).select(*K, "frame", r6("accel"), r6("power"), r6("ec"))


@query("w6_smooth_possession", f"""WITH {V.TRACK}, a AS (SELECT *, CASE WHEN lag(poss) OVER {W} <> poss THEN 1 ELSE 0 END AS ch FROM track), b AS (SELECT *, sum(ch) OVER {W} AS run FROM a), c AS (SELECT *, count(*) OVER (PARTITION BY {KEYS}, run) AS n FROM b)
SELECT {KEYS}, frame, last_value(CASE WHEN n >= 3 OR run = 0 THEN poss END IGNORE NULLS) OVER {W} AS smoothed FROM c""")
def w6(spark, d):
    return series.absorb_short(V.track(spark, d), K, "poss", 3).select(*K, "frame", "smoothed")


@query("w7_phase_ids", f"""WITH {V.TRACK}, a AS (SELECT *, CASE WHEN lag(poss) OVER {W} <> poss THEN 1 ELSE 0 END AS ch FROM track), b AS (SELECT *, sum(ch) OVER {W} AS run FROM a),
n AS (SELECT {KEYS}, max(run) + 1 AS n FROM b GROUP BY {KEYS}), o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY match_id, team, player_id ORDER BY half ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM n)
SELECT {KEYS}, frame, (ahead + run + 1)::BIGINT AS phase_id, count(*) OVER (PARTITION BY {KEYS}, run) AS phase_duration FROM b JOIN o USING ({KEYS})""")
def w7(spark, d):
    return series.phase_ids(V.track(spark, d), ["match_id", "team", "player_id"], "half", "poss").select(*K, "frame", "phase_id", "phase_duration")


def _frames(spark, d):
    t = V.track(spark, d)
    return t.select(*K, "frame", predicates.possession_team(F.col("poss")).alias("possession_team"), (F.col("x") > -40).alias("ball_live"))


PHASES = f"""fr AS (SELECT {KEYS}, frame, CASE poss WHEN 1 THEN 'Home' WHEN 2 THEN 'Away' ELSE 'contest' END AS possession_team, x > -40 AS ball_live FROM track),
ch AS (SELECT *, CASE WHEN lag(frame) OVER {W} IS NOT NULL AND (lag(possession_team) OVER {W} <> possession_team OR lag(ball_live) OVER {W} <> ball_live) THEN 1 ELSE 0 END AS c FROM fr),
ph AS (SELECT {KEYS}, (r + 1)::BIGINT AS phase_id, min(frame) AS start_frame, max(frame) AS end_frame, any_value(possession_team) AS possession_team, any_value(ball_live) AS ball_live, count(*) AS duration_frames, count(*) / 25.0::DOUBLE AS duration_s
  FROM (SELECT *, sum(c) OVER {W} AS r FROM ch) GROUP BY {KEYS}, r)"""


@query("w8_possession_phases", f"WITH {V.TRACK}, {PHASES} SELECT * FROM ph")
def w8(spark, d):
    return series.possession_phases(_frames(spark, d), K)


@query("w9_attack_type", f"""WITH {V.TRACK}, {PHASES}, p AS (SELECT *, lag(ball_live) OVER w AS pl, lag(possession_team) OVER w AS pt, lag(duration_s) OVER w AS ps FROM ph WINDOW w AS (PARTITION BY {KEYS} ORDER BY phase_id))
SELECT {KEYS}, phase_id, CASE WHEN NOT ball_live THEN 'dead_ball' WHEN possession_team = 'contest' THEN 'contest' WHEN pl = false THEN 'set_piece' WHEN pt IN ('Home', 'Away') AND pt <> possession_team AND ps < 5 THEN 'counter_attack' ELSE 'organized_attack' END AS attack_type FROM p""")
def w9(spark, d):
    return series.attack_type(series.possession_phases(_frames(spark, d), K), K).select(*K, "phase_id", "attack_type")


@query("p7_live_phases", f"WITH {V.TRACK}, {PHASES} SELECT {KEYS}, phase_id, duration_s FROM ph WHERE ball_live AND possession_team <> 'contest' AND duration_s >= 0.08")
def p7(spark, d):
    return predicates.live_phases(series.possession_phases(_frames(spark, d), K), 0.08).select(*K, "phase_id", "duration_s")


@query("p16_possession_team", f"WITH {V.TRACK} SELECT match_id, CASE poss WHEN 1 THEN 'Home' WHEN 2 THEN 'Away' ELSE 'contest' END AS possession_team, count(*) AS n FROM track GROUP BY ALL")
def p16(spark, d):
    return V.track(spark, d).groupBy("match_id", predicates.possession_team(F.col("poss")).alias("possession_team")).agg(F.count(F.lit(1)).alias("n"))


@query("w10_valley_candidates", f"{TS}, {VALLEYS} SELECT {KEYS}, frame FROM cand")
def w10(spark, d):
    return series.valley_candidates(_speed(spark, d), K).where("is_valley").select(*K, "frame")


@query("w11_distance_suppression", f"{TS}, {VALLEYS} SELECT {KEYS}, frame FROM thin")
def w11(spark, d):
    return series.suppress_near(series.valley_candidates(_speed(spark, d), K).where("is_valley"), K, 15)


@query("w12_deep_valleys", f"{TS}, {VALLEYS} SELECT c.match_id, c.half, c.team, c.player_id, c.frame FROM cand c JOIN peaks p USING ({KEYS}, frame) WHERE drop_ >= 0.15 AND CASE WHEN peak > 0 THEN drop_ / peak ELSE 0 END >= 0.05")
def w12(spark, d):
    return series.deep_valleys(series.valley_candidates(_speed(spark, d), K), K).where("is_valley").select(*K, "frame")


@query("w13_valley_segments", f"{TS}, {VALLEYS} SELECT {KEYS}, frame, segment_id::BIGINT AS segment_id FROM seg")
def w13(spark, d):
    return series.valley_segments(_speed(spark, d), K, parts=V.parts(spark, d)).select(*K, "frame", "segment_id")


@query("w15_movement_numbers", f"{TS}, {VALLEYS}, {MOVES} SELECT {KEYS}, frame, movement_id FROM mov")
def w15(spark, d):
    return series.number_movements(series.valley_segments(_speed(spark, d), K, parts=V.parts(spark, d)), K, ["segment_id"]).select(*K, "frame", "movement_id")


@query("w16_plain_segments", f"{TS}, {PLAIN} SELECT {KEYS}, frame, segment_id::BIGINT AS segment_id FROM seg")
def w16(spark, d):
    return series.plain_valley_segments(_speed(spark, d), K, parts=V.parts(spark, d)).select(*K, "frame", "segment_id")


@query("w17_method_comparison", f"""SELECT 'valley_power' AS method, team, count(DISTINCT (player_id, half, segment_id)) AS n_segments, count(*) AS n_frames FROM ({TS}, {VALLEYS} SELECT * FROM seg) GROUP BY team
UNION ALL SELECT 'plain' AS method, team, count(DISTINCT (player_id, half, segment_id)), count(*) FROM ({TS}, {PLAIN} SELECT * FROM seg) GROUP BY team""")
def w17(spark, d):
    v, n = _speed(spark, d), V.parts(spark, d)
    return frames.compare_segments({"valley_power": series.valley_segments(v, K, parts=n), "plain": series.plain_valley_segments(v, K, parts=n)}, K, ["team"])


SPLIT = f"""seg1 AS (SELECT *, row_number() OVER ws - 1 AS i, count(*) OVER (PARTITION BY {KEYS}, segment_id) AS n FROM seg WINDOW ws AS (PARTITION BY {KEYS}, segment_id ORDER BY frame)),
{POWER.format(src='seg1', part=f'PARTITION BY {KEYS}, segment_id ORDER BY frame')},
dp AS (SELECT *, coalesce((lead(power) OVER w - lag(power) OVER w) / 2, lead(power) OVER w - power, power - lag(power) OVER w, 0) AS dp, lag(power) OVER w AS pp FROM cost WINDOW w AS (PARTITION BY {KEYS}, segment_id ORDER BY frame)),
tn AS (SELECT *, min(CASE WHEN turn THEN i END) OVER (PARTITION BY {KEYS}, segment_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nt FROM (SELECT *, lag(dp) OVER w * dp < 0 AND i < n - 10 AS turn FROM dp WINDOW w AS (PARTITION BY {KEYS}, segment_id ORDER BY frame))),
ats AS (SELECT {KEYS}, segment_id, i AS c FROM tn WHERE i BETWEEN 10 AND n - 11 AND abs(dp) > 6 UNION SELECT {KEYS}, segment_id, coalesce(nt, i) FROM tn WHERE i BETWEEN 10 AND n - 11 AND pp * power < 0),
cuts AS (SELECT {KEYS}, segment_id, list_reduce(list_concat([[0::BIGINT]], list_transform(list(c ORDER BY c), lambda c: [c])), lambda a, c: CASE WHEN c[1] - a[len(a)] >= 10 THEN list_concat(a, c) ELSE a END) AS cs FROM ats GROUP BY {KEYS}, segment_id),
pieces AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY {KEYS}, segment_id, piece) AS m FROM (SELECT c.*, coalesce(len(list_filter(cs, lambda k: k <= i)), 1) - 1 AS piece FROM tn c LEFT JOIN cuts USING ({KEYS}, segment_id))) WHERE m >= 3)"""


@query("w14_power_split", f"{TS}, {VALLEYS}, {SPLIT} SELECT {KEYS}, frame, segment_id::BIGINT AS segment_id, piece::INT AS piece FROM pieces")
def w14(spark, d):
    n = V.parts(spark, d)
    return series.power_split(series.valley_segments(_speed(spark, d), K, parts=n), K, parts=n).select(*K, "frame", "segment_id", "piece")


SIG = "PARTITION BY player_id ORDER BY frame"


@query("w18_threshold_runs", f"""WITH {V.SIGNAL}, a AS (SELECT *, coalesce(avg(v) OVER ({SIG} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) > 45, false) AS fast FROM signal),
b AS (SELECT *, sum(ch) OVER ({SIG}) AS run FROM (SELECT *, CASE WHEN lag(fast) OVER ({SIG}) <> fast THEN 1 ELSE 0 END AS ch FROM a))
SELECT player_id, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n_frames, round(avg(v), 6) AS mean_v, max(v) AS peak_v FROM b WHERE fast GROUP BY player_id, run HAVING count(*) >= 5""")
def w18(spark, d):
    return series.threshold_runs(V.signal(spark, d), ["player_id"], F.col("v"), 45.0, 5).withColumn("mean_v", F.round("mean_v", 6))


@query("w19_trailing_mean", f"WITH {V.SIGNAL} SELECT player_id, frame, round(t, 6) AS trailing FROM (SELECT *, sum(coalesce(v, 0)) OVER ({SIG} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) / 5 AS t, row_number() OVER ({SIG}) AS i FROM signal) WHERE i >= 5")
def w19(spark, d):
    return series.trailing_mean(V.signal(spark, d), ["player_id"], "v", 5).select("player_id", "frame", r6("trailing"))


@query("a16_before_start", f"{TS} SELECT {KEYS}, frame, round(avg(v) OVER p * 3.6, 6) AS pre_run_mean_vel_kmh, round(max(v) OVER p * 3.6, 6) AS pre_run_peak_vel_kmh, CASE WHEN frame > 0 THEN round(least(frame, 50) / 25.0::DOUBLE, 2) END AS pre_run_window_s FROM speed WINDOW p AS (PARTITION BY {KEYS} ORDER BY frame ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)")
def a16(spark, d):
    return series.before_start(_speed(spark, d), K).select(*K, "frame", r6("pre_run_mean_vel_kmh"), r6("pre_run_peak_vel_kmh"), "pre_run_window_s")


@query("w25_snapshots", f"WITH {V.TRACK}, a AS (SELECT *, count(*) OVER (PARTITION BY {KEYS}) AS n FROM track) SELECT {KEYS}, frame, s AS snapshot FROM (SELECT *, unnest(['start', 'mid', 'end']) AS s FROM a) WHERE (s = 'start' AND frame = 0) OR (s = 'mid' AND frame = n // 2) OR (s = 'end' AND frame = n - 1)")
def w25(spark, d):
    return series.snapshots(V.track(spark, d), K).select(*K, "frame", "snapshot")


@query("w27_merged_intervals", f"""WITH {V.ANNOT}, a AS (SELECT half, jid, start_frame - 5 AS s, end_frame + 5 AS e FROM annot), b AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY half, jid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM a),
c AS (SELECT *, sum(n) OVER (PARTITION BY half, jid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM b), m AS (SELECT half, jid, min(s) AS start_frame, max(e) AS end_frame FROM c GROUP BY half, jid, g)
SELECT *, lead(start_frame) OVER (PARTITION BY half, jid ORDER BY start_frame) - end_frame AS gap FROM m""")
def w27(spark, d):
    return series.merged_intervals(V.annotation(spark, d), ["half", "jid"], 5)


@query("o1_peak_frame", f"{TS} SELECT {KEYS}, arg_min(frame, [-v, frame]) AS peak_frame, max(v) AS peak FROM speed GROUP BY {KEYS}")
def o1(spark, d):
    return _speed(spark, d).groupBy(*K).agg(F.max_by("frame", F.struct("v", -F.col("frame"))).alias("peak_frame"), F.max("v").alias("peak"))


@query("o4_earliest_movement", f"{TS}, {VALLEYS}, {MOVES} SELECT match_id, half, min(start_frame) AS start_frame, arg_min(player_id, [start_frame, player_id]) AS player_id FROM movement GROUP BY match_id, half")
def o4(spark, d):
    return frames.earliest(_movements(spark, d), ["match_id", "half"])


@query("f14_straightness", f"{TS}, {VALLEYS}, {MOVES}, q AS (SELECT {KEYS}, movement_id, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS c, arg_max(x, frame) - arg_min(x, frame) AS dx, arg_max(y, frame) - arg_min(y, frame) AS dy FROM mov GROUP BY {KEYS}, movement_id) SELECT {KEYS}, movement_id, round(sqrt(greatest((a + c) / 2 - sqrt(((a - c) / 2) * ((a - c) / 2) + b * b), 0)), 4) AS rmse, round(CASE WHEN abs(dx) + abs(dy) = 0 THEN 0 ELSE degrees(atan2(abs(dy), abs(dx))) END, 6) AS angle FROM q")
def f14(spark, d):
    from ..functions.scalar import attack_angle, straightness

    df = series.number_movements(series.valley_segments(_speed(spark, d), K, parts=V.parts(spark, d)), K, ["segment_id"])
    g = df.groupBy(*K, "movement_id").agg(straightness("x", "y").alias("rmse"), (F.max_by("x", "frame") - F.min_by("x", "frame")).alias("dx"), (F.max_by("y", "frame") - F.min_by("y", "frame")).alias("dy"))
    return g.select(*K, "movement_id", F.round("rmse", 4).alias("rmse"), F.round(attack_angle(F.col("dx"), F.col("dy")), 6).alias("angle"))


#: Points at equal steps of arc length on paths `pa` (path, frame, x, y), at most fifty.
RESAMPLED = """ps AS (SELECT *, coalesce(sqrt(CAST((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w) AS DOUBLE)), 0) AS st, row_number() OVER w - 1 AS i FROM pa WINDOW w AS (PARTITION BY path ORDER BY frame)),
pc AS (SELECT *, sum(st) OVER (PARTITION BY path ORDER BY frame ROWS UNBOUNDED PRECEDING) AS arc, sum(st) OVER (PARTITION BY path) AS total, count(*) OVER (PARTITION BY path) AS n FROM ps),
pt AS (SELECT path, n, total, unnest(range(least(n, 50))) AS point FROM (SELECT DISTINCT path, n, total FROM pc)),
rs AS (SELECT t.path, t.point, t.n, CASE WHEN t.total < 1e-6 THEN (SELECT x FROM pc q WHERE q.path = t.path AND q.i = t.point)::DOUBLE WHEN b.arc IS NULL OR b.arc <= a.arc THEN a.x ELSE a.x + (t.point * t.total / (least(t.n, 50) - 1) - a.arc) / (b.arc - a.arc) * (b.x - a.x) END AS rx,
  CASE WHEN t.total < 1e-6 THEN (SELECT y FROM pc q WHERE q.path = t.path AND q.i = t.point)::DOUBLE WHEN b.arc IS NULL OR b.arc <= a.arc THEN a.y ELSE a.y + (t.point * t.total / (least(t.n, 50) - 1) - a.arc) / (b.arc - a.arc) * (b.y - a.y) END AS ry
  FROM pt t JOIN LATERAL (SELECT * FROM pc q WHERE q.path = t.path AND q.arc <= t.point * t.total / greatest(least(t.n, 50) - 1, 1) + 1e-9 * t.total ORDER BY q.i DESC LIMIT 1) a ON true LEFT JOIN pc b ON b.path = t.path AND b.i = a.i + 1)"""


@query("w26_resample", f"""{TS}, {VALLEYS}, {MOVES}, pa AS (SELECT player_id || half AS path, frame, x, y FROM track UNION ALL SELECT player_id || half || '-' || movement_id, frame, x, y FROM mov), {RESAMPLED}
SELECT path, point, round(rx, 4) + 0.0 AS rx, round(ry, 4) + 0.0 AS ry FROM rs""")
def w26(spark, d):
    """Whole series, of more points than fifty, and their movements, of fewer."""
    df = series.number_movements(series.valley_segments(_speed(spark, d), K, parts=V.parts(spark, d)), K, ["segment_id"])
    name = F.concat(F.col("player_id").cast("string"), "half")
    paths = V.track(spark, d).select(name.alias("path"), "frame", "x", "y").unionByName(df.select(F.concat(name, F.lit("-"), F.col("movement_id").cast("string")).alias("path"), "frame", "x", "y"))
    return shape.resample(paths, ["path"]).select("path", F.col("point").cast("long").alias("point"), *[(F.round(c, 4) + 0.0).alias(c) for c in ("rx", "ry")])


#: Shapes of the movements in `mov`, after their points `rs`; straight pieces are a fold over moments.
_SUMS = ", ".join(f"'{c}': s.{c} + p.{c}" for c in ("n", "x", "y", "xx", "yy", "xy"))
_RMS = "sqrt(greatest(({xx} / {n} - {x} / {n} * {x} / {n} + {yy} / {n} - {y} / {n} * {y} / {n}) / 2 - sqrt(pow(({xx} / {n} - {x} / {n} * {x} / {n} - {yy} / {n} + {y} / {n} * {y} / {n}) / 2, 2) + pow({xy} / {n} - {x} / {n} * {y} / {n}, 2)), 0))".format(**{c: f"g.{c}" for c in ("n", "x", "y", "xx", "yy", "xy")})
SHAPES = f"""pa AS (SELECT player_id || half || '-' || movement_id AS path, frame, x, y FROM mov), {RESAMPLED},
rp AS (SELECT path, count(*) AS np, var_pop(rx) AS a, covar_pop(rx, ry) AS b, var_pop(ry) AS c, list({{'i': 1, 'pieces': 0, 'n': 1.0::DOUBLE, 'x': rx, 'y': ry, 'xx': rx * rx, 'yy': ry * ry, 'xy': rx * ry}} ORDER BY point) AS l FROM rs GROUP BY path),
rq AS (SELECT *, sqrt(greatest((a + c) / 2 - sqrt(((a - c) / 2) * ((a - c) / 2) + b * b), 0)) AS rms, greatest(4, np // 10) AS least_,
  list_concat([{{'i': 0, 'pieces': 1, 'n': 0.0::DOUBLE, 'x': 0.0::DOUBLE, 'y': 0.0::DOUBLE, 'xx': 0.0::DOUBLE, 'yy': 0.0::DOUBLE, 'xy': 0.0::DOUBLE}}], l) AS states FROM rp),
rf AS (SELECT path, rms, CASE WHEN np < 4 THEN 1 ELSE list_reduce(states, lambda s, p: list_transform([{{'i': s.i + 1, 'pieces': s.pieces, {_SUMS}}}], lambda g: CASE WHEN s.i >= least_ AND {_RMS} > 6 THEN {{'i': s.i + 1, 'pieces': s.pieces + 1, 'n': p.n, 'x': p.x, 'y': p.y, 'xx': p.xx, 'yy': p.yy, 'xy': p.xy}} ELSE g END)[1]).pieces END AS pieces FROM rq),
en AS (SELECT {KEYS}, movement_id, player_id || half || '-' || movement_id AS path, count(*) AS n, arg_max(x, frame) - arg_min(x, frame) AS dx, arg_max(y, frame) - arg_min(y, frame) AS dy FROM mov GROUP BY {KEYS}, movement_id),
shapes AS (SELECT {KEYS}, movement_id, CASE WHEN n < 5 THEN 'unknown' WHEN rms <= 6 THEN CASE WHEN angle <= 22.5 THEN 'straight' ELSE 'diagonal' END ELSE 'curvilinear' END AS shape, CASE WHEN n >= 5 THEN round(rms, 4) END AS linearity_rmse, CASE WHEN n >= 5 THEN round(angle, 2) END AS angle_deg, CASE WHEN n >= 5 THEN CASE WHEN rms <= 6 THEN 1 ELSE pieces END END::BIGINT AS n_segments
  FROM (SELECT *, CASE WHEN abs(dx) + abs(dy) = 0 THEN 0 ELSE degrees(atan2(abs(dy), abs(dx))) END AS angle FROM en) JOIN rf USING (path))"""


@query("g2_shape_classes", f"{TS}, {VALLEYS}, {MOVES}, {SHAPES} SELECT * FROM shapes")
def g2(spark, d):
    df = series.number_movements(series.valley_segments(_speed(spark, d), K, parts=V.parts(spark, d)), K, ["segment_id"])
    return shape.classify(df, [*K, "movement_id"], threshold=6.0)


@query("g3_segment_count", f"{TS}, {VALLEYS}, {MOVES}, {SHAPES} SELECT n_segments, count(*) AS n FROM shapes WHERE shape = 'curvilinear' GROUP BY n_segments")
def g3(spark, d):
    return g2(spark, d).where("shape = 'curvilinear'").groupBy("n_segments").agg(F.count(F.lit(1)).alias("n"))


@query("w20_ntile_lines", f"""WITH {V.FORMATION}, o AS (SELECT *, ntile(3) OVER (PARTITION BY frame, team ORDER BY x, player_id) AS t, count(*) OVER (PARTITION BY frame, team) AS n FROM formation WHERE position <> 'TW')
SELECT frame, team, {", ".join(f"round(avg(CASE WHEN t = {i} AND n >= 3 THEN x END), 6) AS def_line_{i}" for i in (1, 2, 3))} FROM o GROUP BY frame, team""")
def w20(spark, d):
    from ..operators.context import defensive_lines

    lines = defensive_lines(V.formation(spark, d), ["frame"], F.lit(1))
    return lines.select("frame", "team", *[r6(f"def_line_{i}") for i in (1, 2, 3)])


@query("o6_head", f"WITH {V.TRACK} SELECT player_id, half, frame FROM track ORDER BY player_id, half, frame LIMIT 10")
def o6(spark, d):
    return V.track(spark, d).select("player_id", "half", "frame").orderBy("player_id", "half", "frame").limit(10)


@query("p6_in_possession_runs", f"""WITH {V.SIGNAL}, a AS (SELECT *, coalesce(avg(v) OVER ({SIG} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) > 45, false) AS fast FROM signal),
b AS (SELECT *, sum(ch) OVER ({SIG}) AS run FROM (SELECT *, CASE WHEN lag(fast) OVER ({SIG}) <> fast THEN 1 ELSE 0 END AS ch FROM a)),
r AS (SELECT player_id, min(frame) AS start_frame, max(frame) AS end_frame, max(v) AS peak_v FROM b WHERE fast GROUP BY player_id, run HAVING count(*) >= 5)
SELECT r.*, row_number() OVER (PARTITION BY r.player_id ORDER BY r.start_frame) AS place FROM r JOIN signal s ON s.player_id = r.player_id AND s.frame = r.start_frame WHERE s.event_type IN ('purchase', 'click')""")
def p6(spark, d):
    """High-intensity runs whose first frame is in possession, in the order of their start."""
    s = V.signal(spark, d)
    runs = series.threshold_runs(s, ["player_id"], F.col("v"), 45.0, 5)
    got = predicates.in_possession(runs, s.select("player_id", "frame", F.col("event_type").isin("purchase", "click").alias("holds")), ["player_id"])
    place = F.row_number().over(Window.partitionBy("player_id").orderBy("start_frame")).cast("long")
    return got.select("player_id", "start_frame", "end_frame", "peak_v", place.alias("place"))


@query("p6_top_signals", f"WITH {V.SIGNAL}, s AS (SELECT player_id, frame, v, row_number() OVER (PARTITION BY player_id ORDER BY v DESC, frame) AS rank FROM signal WHERE event_type = 'purchase') SELECT player_id, frame, v, rank FROM s WHERE rank <= 3")
def p6_top(spark, d):
    top = Window.partitionBy("player_id").orderBy(F.col("v").desc(), "frame")
    return V.signal(spark, d).where("event_type = 'purchase'").withColumn("rank", F.row_number().over(top)).where("rank <= 3").select("player_id", "frame", "v", F.col("rank").cast("long").alias("rank")).orderBy("player_id", "rank")
