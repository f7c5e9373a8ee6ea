"""Queries of blocks, roles, zones and space control."""

from pyspark.sql import functions as F

from ..operators import context as C
from ..operators import control as S
from ..sources import views as V
from . import jobs
from .base import query, r6

FR = ["frame"]
NX, NY = S.NX, S.NY
#: A coarse grid, where a row for each frame and point is returned.
FEW_X, FEW_Y = 11, 9


def _team(spark, d):
    return V.formation(spark, d)


@query("a14_block_centroid", f"WITH {V.FORMATION} SELECT frame, team, round(avg(x), 6) + 0.0 AS block_cx, round(avg(y), 6) + 0.0 AS block_cy, count(*) AS n_outfield FROM formation WHERE position <> 'TW' GROUP BY frame, team")
def a14(spark, d):
    return C.block_centroid(_team(spark, d), FR).select("frame", "team", r6("block_cx"), r6("block_cy"), "n_outfield")


@query("g11_frame_context", f"""WITH {V.FORMATION}, o AS (SELECT *, ntile(3) OVER (PARTITION BY frame, team ORDER BY x, player_id) AS t, count(*) OVER (PARTITION BY frame, team) AS n FROM formation WHERE position <> 'TW')
SELECT frame, team, round(avg(x), 6) + 0.0 AS block_cx, CASE WHEN avg(x) > 0 THEN 'high_press' WHEN avg(x) > -15 THEN 'medium_block' ELSE 'low_block' END AS defense_type, round(avg(CASE WHEN t = 3 AND n >= 3 THEN x END), 6) + 0.0 AS def_line_3 FROM o GROUP BY frame, team""")
def g11(spark, d):
    return jobs.team_blocks(_team(spark, d), FR, F.lit(1)).select("frame", "team", r6("block_cx"), "defense_type", r6("def_line_3"))


MW = "(PARTITION BY match_id ORDER BY frame)"


@query("g11_whole_context", f"""WITH {V.FORMATION}, fr AS (SELECT o_custkey // 22 AS match_id, o_orderkey AS frame, CASE WHEN o_orderpriority < '2' THEN 'Home' WHEN o_orderpriority < '4' THEN 'Away' ELSE 'contest' END AS possession_team, o_orderstatus <> 'P' AS ball_live FROM orders),
c AS (SELECT *, sum(ch) OVER {MW} + 1 AS phase_id FROM (SELECT *, CASE WHEN lag(frame) OVER {MW} IS NOT NULL AND (lag(possession_team) OVER {MW} <> possession_team OR lag(ball_live) OVER {MW} <> ball_live) THEN 1 ELSE 0 END AS ch FROM fr)),
ph AS (SELECT match_id, phase_id, min(frame) AS phase_start, any_value(possession_team) AS possession_team, any_value(ball_live) AS ball_live, count(*) / 25.0::DOUBLE AS duration_s FROM c GROUP BY match_id, phase_id),
pa AS (SELECT *, CASE WHEN NOT ball_live THEN 'dead_ball' WHEN possession_team = 'contest' THEN 'contest' WHEN lag(ball_live) OVER w = false THEN 'set_piece' WHEN lag(possession_team) OVER w IN ('Home', 'Away') AND lag(possession_team) OVER w <> possession_team AND lag(duration_s) OVER w < 5 THEN 'counter_attack' ELSE 'organized_attack' END AS attack_type FROM ph WINDOW w AS (PARTITION BY match_id ORDER BY phase_id)),
o AS (SELECT *, ntile(3) OVER (PARTITION BY frame, team ORDER BY x, player_id) AS t, count(*) OVER (PARTITION BY frame, team) AS n FROM formation WHERE position <> 'TW'),
b AS (SELECT frame, team, avg(x) AS cx, avg(y) AS cy, count(*) AS n_outfield, {", ".join(f"avg(CASE WHEN t = {i} AND n >= 3 THEN x END) AS l{i}" for i in (1, 2, 3))} FROM o GROUP BY frame, team)
SELECT c.match_id, c.frame, team, c.phase_id::BIGINT AS phase_id, phase_start, duration_s, attack_type, round(cx, 6) + 0.0 AS block_cx, round(cy, 6) + 0.0 AS block_cy, n_outfield, {", ".join(f"round(l{i}, 6) + 0.0 AS def_line_{i}" for i in (1, 2, 3))}, CASE WHEN cx > 0 THEN 'high_press' WHEN cx > -15 THEN 'medium_block' ELSE 'low_block' END AS defense_type
FROM c JOIN pa USING (match_id, phase_id) JOIN b ON b.frame = c.frame""")
def g11_whole(spark, d):
    holder = F.when(F.col("o_orderpriority") < "2", "Home").when(F.col("o_orderpriority") < "4", "Away").otherwise("contest")
    frames = V.table(spark, d, "orders").select(F.floor(F.col("o_custkey") / 22).alias("match_id"), F.col("o_orderkey").alias("frame"), holder.alias("possession_team"), (F.col("o_orderstatus") != "P").alias("ball_live"))
    players = _team(spark, d).join(frames.select("match_id", "frame"), "frame")
    got = jobs.frame_context(players, frames, ["match_id"], F.lit(1))
    return got.select("match_id", "frame", "team", "phase_id", "phase_start", "duration_s", "attack_type", r6("block_cx"), r6("block_cy"), "n_outfield", *[r6(f"def_line_{i}") for i in (1, 2, 3)], "defense_type")


#: The subset recursion of assign_roles(): placed has, for each group, formation and set of taken slots, the best way there.
ROLES = f"""slots AS (SELECT * FROM (VALUES {", ".join(f"({k}, {i}, '{name}', {x}::DOUBLE, {y}::DOUBLE, '{role}')" for k, (name, held) in enumerate(C.FORMATIONS.items()) for i, (x, y, role) in enumerate(held))}) t(form, slot, formation, sx, sy, slot_role)),
pos AS (SELECT frame, team, player_id, (x + 52) / 104.0::DOUBLE AS nx, (y + 34) / 68.0::DOUBLE AS ny, row_number() OVER (PARTITION BY frame, team ORDER BY player_id) AS place, count(*) OVER (PARTITION BY frame, team) AS k FROM formation),
cost AS MATERIALIZED (SELECT frame, team, place, k, form, slot, round_even(sqrt((nx - sx) * (nx - sx) + (ny - sy) * (ny - sy)) * 1e9, 0)::BIGINT AS c FROM pos JOIN slots ON slot < k),
placed AS (SELECT frame, team, form, 0::BIGINT AS level, 0::BIGINT AS taken, 0::BIGINT AS total, []::BIGINT[] AS way FROM (SELECT DISTINCT frame, team, form FROM cost)
  UNION ALL SELECT frame, team, form, level, taken, least_[1], way FROM (SELECT p.frame, p.team, p.form, p.level + 1 AS level, p.taken + (1 << c.slot) AS taken, min([p.total + c.c, c.slot]) AS least_, arg_min(list_append(p.way, c.slot), [p.total + c.c, c.slot]) AS way
    FROM placed p JOIN cost c ON c.frame = p.frame AND c.team = p.team AND c.form = p.form AND c.place = p.level + 1 WHERE (p.taken >> c.slot) & 1 = 0 GROUP BY ALL)),
ends AS (SELECT frame, team, arg_min(form, [total, form]) AS form, arg_min(way, [total, form]) AS way FROM placed p JOIN (SELECT DISTINCT frame, team, k FROM pos) USING (frame, team) WHERE level = k GROUP BY frame, team),
roles AS (SELECT p.frame, p.team, p.player_id, s.formation, s.slot_role AS role FROM pos p JOIN ends e USING (frame, team) JOIN slots s ON s.form = e.form AND s.slot = e.way[p.place])"""


@query("g4_role_assignment", f"WITH RECURSIVE {V.FORMATION}, {ROLES} SELECT * FROM roles")
def g4(spark, d):
    t = _team(spark, d).select("frame", "team", "player_id", ((F.col("x") + 52) / 104).alias("norm_x"), ((F.col("y") + 34) / 68).alias("norm_y"))
    return C.assign_roles(t, ["frame", "team"])


@query("o3_best_formation", f"WITH RECURSIVE {V.FORMATION}, {ROLES} SELECT formation, role, count(*) AS n FROM roles GROUP BY ALL")
def o3(spark, d):
    return g4(spark, d).groupBy("formation", "role").agg(F.count(F.lit(1)).alias("n"))


@query("g7_zone_against_block", f"""WITH {V.FORMATION}, p AS (SELECT * FROM formation WHERE team = 'Home'), q AS (SELECT frame, x AS dx, y AS dy FROM formation WHERE team = 'Away'), s AS (SELECT frame, max(dx) AS line, count(*) AS n FROM q GROUP BY frame),
b AS (SELECT p.frame, p.player_id, atan2((dy - y)::DOUBLE, (dx - x)::DOUBLE) AS b FROM p JOIN q USING (frame)), g AS (SELECT frame, player_id, coalesce(lead(b) OVER w, min(b) OVER (PARTITION BY frame, player_id) + 2 * pi()) - b AS gap FROM b WINDOW w AS (PARTITION BY frame, player_id ORDER BY b)),
m AS (SELECT frame, player_id, max(gap) AS gap FROM g GROUP BY ALL)
SELECT p.frame, p.player_id, CASE WHEN n >= 3 THEN CASE WHEN x > line THEN 'Behind' WHEN gap <= pi() + 1e-9 THEN 'Inside' ELSE 'Wing' END END AS zone FROM p LEFT JOIN s USING (frame) LEFT JOIN m USING (frame, player_id)""")
def g7(spark, d):
    t = _team(spark, d)
    return C.zone_against_block(t.where("team = 'Home'").select("frame", "player_id", "x", "y"), t.where("team = 'Away'"), FR).select("frame", "player_id", "zone")


#: Roles of attackers in phases of fifty frames, between teams of four: q has mean places in the attackers' direction.
PHASED = f"""k AS (SELECT player_id // 8 AS match_id, half, frame // 50 AS phase_id, team, player_id, CASE WHEN player_id % 11 = 0 THEN 'TW' ELSE 'FP' END AS position, CASE WHEN (frame + player_id) % 6 > 0 THEN x END AS x, y FROM track),
live AS (SELECT DISTINCT match_id, half, phase_id, CASE WHEN phase_id % 2 = 0 THEN 'Home' ELSE 'Away' END AS possession_team FROM k WHERE phase_id % 3 > 0),
q AS (SELECT *, mx * sign AS x, my * sign AS y FROM (SELECT match_id, half, phase_id, team, player_id, position, team = possession_team AS own, avg(x) AS mx, avg(y) AS my, CASE WHEN (possession_team = 'Home') = (half = 'F') THEN 1 ELSE -1 END AS sign FROM k JOIN live USING (match_id, half, phase_id) GROUP BY ALL HAVING count(x) / count(*) >= 0.5)),
mine AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY match_id, half, phase_id) AS n, dense_rank() OVER (ORDER BY match_id, half, phase_id) AS frame FROM q WHERE own) WHERE n >= 4),
{ROLES.replace("FROM formation)", "FROM mine)").replace("(y + 34)", "(my + 34)")},
o AS (SELECT match_id, half, phase_id, x AS dx, y AS dy FROM q WHERE NOT own AND position <> 'TW'), ln AS (SELECT match_id, half, phase_id, min(dx) AS line, count(*) AS nd FROM o GROUP BY ALL),
br AS (SELECT match_id, half, phase_id, m.player_id, atan2(dy, dx - m.x) AS b FROM mine m JOIN o USING (match_id, half, phase_id)), gp AS (SELECT match_id, half, phase_id, player_id, coalesce(lead(b) OVER w, min(b) OVER (PARTITION BY match_id, half, phase_id, player_id) + 2 * pi()) - b AS gap FROM br WINDOW w AS (PARTITION BY match_id, half, phase_id, player_id ORDER BY b)),
gm AS (SELECT match_id, half, phase_id, player_id, max(gap) AS gap FROM gp GROUP BY ALL)"""


@query("g4_role_table", f"""WITH RECURSIVE {V.TRACK}, {PHASED} SELECT m.match_id, m.half, m.phase_id, m.team, m.player_id, role, formation, round(mx, 6) + 0.0 AS mean_x, round(my, 6) + 0.0 AS mean_y,
CASE WHEN nd >= 3 THEN CASE WHEN m.x > line THEN 'Behind' WHEN gap <= pi() + 1e-9 THEN 'Inside' ELSE 'Wing' END END AS zone FROM mine m JOIN roles r ON r.frame = m.frame AND r.player_id = m.player_id LEFT JOIN ln ON (ln.match_id, ln.half, ln.phase_id) = (m.match_id, m.half, m.phase_id) LEFT JOIN gm ON (gm.match_id, gm.half, gm.phase_id, gm.player_id) = (m.match_id, m.half, m.phase_id, m.player_id)""")
def g4_table(spark, d):
    """Roles, formations and zones of the attackers of each phase, as one table."""
    t, phase = V.track(spark, d), F.floor(F.col("frame") / 50)
    t = t.withColumns({"match_id": F.floor(F.col("player_id") / 8), "phase_id": phase, "position": F.when(F.col("player_id") % 11 == 0, "TW").otherwise("FP"), "x": F.when((F.col("frame") + F.col("player_id")) % 6 > 0, F.col("x"))})
    phases = t.select("match_id", "half", "phase_id").distinct().withColumns({"possession_team": F.when(F.col("phase_id") % 2 == 0, "Home").otherwise("Away"), "ball_live": F.col("phase_id") % 3 > 0, "duration_s": F.lit(2.0)})
    sign = F.when((F.col("team") == "Home") == (F.col("half") == "F"), 1).otherwise(-1)
    return jobs.role_table(t, phases, ["match_id", "half"], sign).select("match_id", "half", "phase_id", "team", "player_id", "role", "formation", r6("mean_x"), r6("mean_y"), "zone")


def _players(spark, d):
    t = _team(spark, d)
    return t.withColumns({"x": F.col("x") + 52.5, "y": F.col("y") + 34.0, "vx": F.col("vx").cast("double"), "vy": F.col("vy").cast("double"), "ball_x": F.lit(52.5), "ball_y": F.lit(34.0)})


def _home():
    return F.col("team") == "Home"



def _surface_sql(NX: int, NY: int) -> str:
    return f"""pl AS (SELECT frame, team, player_id, x + 52.5::DOUBLE AS x, y + 34.0::DOUBLE AS y, vx::DOUBLE AS vx, vy::DOUBLE AS vy FROM formation),
gr AS (SELECT i AS p, i // {NY} * (105.0::DOUBLE / {NX - 1}) AS gx, i % {NY} * (68.0::DOUBLE / {NY - 1}) AS gy FROM range({NX * NY}) t(i)),
el AS (SELECT *, sqrt(vx * vx + vy * vy) AS s, least(greatest(4 + 6 * (1 - exp(-sqrt((x - 52.5) * (x - 52.5) + (y - 34) * (y - 34)) / 10)), 4), 10) AS r FROM pl),
e2 AS (SELECT *, CASE WHEN s >= 1e-6 THEN vx / s ELSE 1 END AS ux, CASE WHEN s >= 1e-6 THEN vy / s ELSE 0 END AS uy, r * (1 + s * s / 169) / 2 AS sx, greatest(r * (1 - s * s / 169) / 2, 0.1) AS sy, CASE WHEN s >= 1e-6 THEN 0.5 ELSE 0 END AS sh FROM el),
e3 AS (SELECT frame, team, player_id, s, x + sh * ux AS mx, y + sh * uy AS my, ux / sx AS ax, uy / sx AS ay, ux / sy AS bx, uy / sy AS by_, (sh / sx) * (sh / sx) AS q FROM e2),
uv AS (SELECT frame, team, player_id, s, p, q, (gx - mx) * ax + (gy - my) * ay AS u, (gy - my) * bx - (gx - mx) * by_ AS v FROM e3 CROSS JOIN gr),
inf AS (SELECT frame, team, player_id, s, p, exp(-0.5 * (u * u + v * v - q)) AS i FROM uv),
ad AS (SELECT frame, p, sum(CASE WHEN team = 'Home' THEN i ELSE 0 END) AS a, sum(CASE WHEN team = 'Home' THEN 0 ELSE i END) AS d FROM inf GROUP BY frame, p),
pc AS (SELECT frame, p // {NY} AS ix, p % {NY} AS iy, gx, gy, 1 / (1 + exp(d - a)) AS pc, 1 / (1 + exp(-a)) AS pa FROM ad JOIN gr USING (p))"""


SURFACE = _surface_sql(NX, NY)


@query("g5_control_surface", f"WITH {V.FORMATION}, {SURFACE} SELECT ix, iy, count(*) AS n_frames, round(avg(pc), 6) + 0.0 AS mean_pc, round(avg(pa), 6) + 0.0 AS mean_att_only, round(min(pc), 6) + 0.0 AS least_pc, round(max(pc), 6) + 0.0 AS most_pc FROM pc GROUP BY ix, iy")
def g5(spark, d):
    """All frames on the full grid, by grid point."""
    return S.mean_surface(_players(spark, d), FR, _home()).select("ix", "iy", "n_frames", r6("mean_pc"), r6("mean_att_only"), r6("least_pc"), r6("most_pc"))


@query("g5_surface_points", f"WITH {V.FORMATION}, {_surface_sql(FEW_X, FEW_Y)} SELECT frame, ix, iy, round(pc, 6) + 0.0 AS pc, round(pa, 6) + 0.0 AS pc_att_only FROM pc")
def g5_points(spark, d):
    return S.surface(_players(spark, d), FR, _home(), nx=FEW_X, ny=FEW_Y).select("frame", "ix", "iy", r6("pc"), r6("pc_att_only"))


@query("j18_grid_cross_join", f"WITH {V.FORMATION}, {SURFACE} SELECT p // {NY} AS ix, p % {NY} AS iy, count(*) AS n, round(avg(i), 6) + 0.0 AS mean_influence FROM inf GROUP BY p")
def j18(spark, d):
    return S.mean_influence(_players(spark, d), NX, NY).select("ix", "iy", "n", r6("mean_influence"))


@query("a17_frame_metrics", f"WITH {V.FORMATION}, {SURFACE} SELECT frame, round(avg(pc), 6) + 0.0 AS pc_att_team, round(1 - avg(pc), 6) + 0.0 AS pc_def_team FROM pc GROUP BY frame")
def a17(spark, d):
    return S.frame_control(_players(spark, d), FR, _home(), alone=False).select("frame", r6("pc_att_team"), r6("pc_def_team"))


@query("a18_third_means", f"WITH {V.FORMATION}, {SURFACE} SELECT frame, " + ", ".join(f"round(avg(CASE WHEN floor(ix * 3 / {NX}::DOUBLE) = {i} THEN pc END), 6) + 0.0 AS pc_{n}_third" for i, n in enumerate(("def", "mid", "att"))) + " FROM pc GROUP BY frame")
def a18(spark, d):
    return S.frame_control(_players(spark, d), FR, _home(), alone=False).select("frame", *[r6(f"pc_{n}_third") for n in ("def", "mid", "att")])


@query("a19_zone_control", f"WITH {V.FORMATION}, {SURFACE}, c AS (SELECT frame, min(x) AS cx, min(y) AS cy FROM pl GROUP BY frame), z AS (SELECT *, (gx - cx) * (gx - cx) + (gy - cy) * (gy - cy) <= 225 AS near FROM pc JOIN c USING (frame)) SELECT frame, round(avg(CASE WHEN near THEN pc END), 6) + 0.0 AS zone_pc, count(*) FILTER (WHERE near) AS n_points FROM z GROUP BY frame")
def a19(spark, d):
    got = S.frame_control(_players(spark, d), FR, _home(), zones={"zone": (F.min("x"), F.min("y"), 15.0)}, alone=False)
    return got.select("frame", r6("zone_pc"), F.col("zone_points").alias("n_points"))


@query("a20_influence_summary", f"WITH {V.FORMATION}, {SURFACE}, p AS (SELECT frame, player_id, any_value(s) AS s, sum(i) / {NX * NY} AS m, max(i) AS t FROM inf GROUP BY ALL) SELECT player_id, count(*) AS n_frames, round(avg(m), 6) + 0.0 AS mean_influence, round(max(t), 6) + 0.0 AS max_influence, round(avg(s), 6) + 0.0 AS mean_speed, round(max(s), 6) + 0.0 AS max_speed FROM p GROUP BY player_id")
def a20(spark, d):
    players = _players(spark, d)
    rows = S.player_influence(players, FR, held=[F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")).alias("speed_ms")])
    s = S.influence_summary(rows, ["player_id"])
    return s.select("player_id", "n_frames", r6("mean_influence"), r6("max_influence"), r6("mean_speed"), r6("max_speed"))


@query("g6_control_report", f"""WITH {V.FORMATION}, {SURFACE}, f AS (SELECT frame, avg(pc) AS a, avg(pa) AS pa, {", ".join(f"avg(CASE WHEN floor(ix * 3 / {NX}::DOUBLE) = {i} THEN pc END) AS t{i}" for i in range(3))}, avg(CASE WHEN (gx - 52.5) * (gx - 52.5) + (gy - 34) * (gy - 34) <= 225 THEN pc END) AS z FROM pc GROUP BY frame),
w AS (SELECT *, frame // 1000 AS window_id, row_number() OVER (PARTITION BY frame // 1000 ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY frame // 1000) AS n FROM f), s AS (SELECT *, unnest(['start', 'mid', 'end']) AS snapshot FROM w)
SELECT window_id, frame, snapshot, round(a, 6) + 0.0 AS pc_att_team, CASE WHEN a >= 0.5 THEN 'attack' ELSE 'defence' END AS controlling, {", ".join(f"round(t{i}, 6) + 0.0 AS pc_{n}_third" for i, n in enumerate(("def", "mid", "att")))}, round(z, 6) + 0.0 AS zone_pc, round(pa, 6) + 0.0 AS mean_pc_att_only
FROM s WHERE (snapshot = 'start' AND i = 0) OR (snapshot = 'mid' AND i = n // 2) OR (snapshot = 'end' AND i = n - 1)""")
def g6(spark, d):
    """Snapshots of the whole job, over windows of a thousand frames."""
    players = _players(spark, d).withColumns({"match_id": F.lit(1), "ball_speed_kmh": F.lit(0.0)})
    windows = players.select("match_id", F.floor(F.col("frame") / 1000).alias("window_id")).distinct().withColumns({"start_frame": F.col("window_id") * 1000, "end_frame": F.col("window_id") * 1000 + 999})
    got = jobs.control_report(players, ["match_id"], _home(), windows=windows, tables=("snapshots",))["snapshots"]
    return got.select("window_id", "frame", "snapshot", r6("pc_att_team"), "controlling", *[r6(f"pc_{n}_third") for n in ("def", "mid", "att")], r6("ball_zone_pc", "zone_pc"), r6("mean_pc_att_only"))


#: Frames whose attackers, direction, ball and target player change from frame to frame; pc is Home's share.
SIDES = """own AS (SELECT frame, frame % 2 = 0 AS home, frame % 4 >= 2 AS turned, 52.5 + frame % 30 - 15 AS bx, 34.0::DOUBLE + frame % 20 - 10 AS by_ FROM (SELECT DISTINCT frame FROM formation)),
goal AS (SELECT frame, arg_min(x, player_id) AS tx, arg_min(y, player_id) AS ty, min(player_id) AS target_id FROM pl WHERE player_id % 10 = 3 GROUP BY frame),
seen AS (SELECT pc.*, home, CASE WHEN home THEN pc ELSE 1 - pc END AS att, CASE WHEN turned THEN 2 - floor(ix * 3 / {n}::DOUBLE) ELSE floor(ix * 3 / {n}::DOUBLE) END AS third, (gx - bx) * (gx - bx) + (gy - by_) * (gy - by_) <= 225 AS near, (gx - tx) * (gx - tx) + (gy - ty) * (gy - ty) <= 100 AS close, target_id FROM pc JOIN own USING (frame) LEFT JOIN goal USING (frame)),
sides AS (SELECT frame, home, any_value(target_id) AS target_id, avg(pc) AS h, avg(att) AS att, avg(pa) AS ho, avg(pd) AS ao, avg(CASE WHEN third = 0 THEN att END) AS t0, avg(CASE WHEN third = 2 THEN att END) AS t2, avg(CASE WHEN near THEN pc END) AS bz, avg(CASE WHEN close THEN pc END) AS pz FROM seen GROUP BY frame, home)"""
MOVED = _surface_sql(FEW_X, FEW_Y).replace("sqrt((x - 52.5) * (x - 52.5) + (y - 34) * (y - 34))", "sqrt((x - 37.5 - frame % 30) * (x - 37.5 - frame % 30) + (y - 24 - frame % 20) * (y - 24 - frame % 20))").replace("1 / (1 + exp(-a)) AS pa", "1 / (1 + exp(-a)) AS pa, 1 / (1 + exp(-d)) AS pd")


def _sides(spark, d, name):
    ball = {"ball_x": F.lit(37.5) + F.col("frame") % 30, "ball_y": F.lit(24.0) + F.col("frame") % 20, "ball_speed_kmh": F.lit(0.0), "possession_team": F.when(F.col("frame") % 3 > 0, F.when(F.col("frame") % 2 == 0, "Home").otherwise("Away"))}
    players, side = _players(spark, d).withColumns(ball), F.when(F.col("frame") % 2 == 0, "Home").otherwise("Away")
    return jobs.control_report(players, [], F.col("team") == side, mirrored=F.col("frame") % 4 >= 2, target=F.col("player_id") % 10 == 3, target_radius=10.0, nx=FEW_X, ny=FEW_Y, tables=(name,))[name]


@query("g6_home_and_away", f"""WITH {V.FORMATION}, {MOVED}, {SIDES.format(n=FEW_X)} SELECT frame, CASE WHEN home THEN 'Home' ELSE 'Away' END AS att_team, CASE WHEN frame % 3 > 0 THEN CASE WHEN home THEN 'Home' ELSE 'Away' END ELSE 'unknown' END AS possessing_team,
  CASE WHEN abs(att - 0.5) >= 1e-9 THEN CASE WHEN (att >= 0.5) = home THEN 'Home' ELSE 'Away' END END AS controlling_team, round(h, 6) + 0.0 AS pc_combined_home, round(1 - h, 6) + 0.0 AS pc_combined_away, round(ho, 6) + 0.0 AS pc_only_home, round(ao, 6) + 0.0 AS pc_only_away, round(t0, 6) + 0.0 AS pc_def_third, round(t2, 6) + 0.0 AS pc_att_third,
  round(bz, 6) + 0.0 AS ball_zone_home, round(1 - bz, 6) + 0.0 AS ball_zone_away, target_id, round(pz, 6) + 0.0 AS player_zone_home, round(1 - pz, 6) + 0.0 AS player_zone_away FROM sides""")
def g6_sides(spark, d):
    """Frames by home and away, with the zones of ball and target player, where the attackers change by turns.

    Who controls a frame is left open where no player reaches the grid, as sums in another order may fall to either side.
    """
    shares = ["pc_combined_home", "pc_combined_away", "pc_only_home", "pc_only_away", "pc_def_third", "pc_att_third", "ball_zone_home", "ball_zone_away", "player_zone_home", "player_zone_away"]
    told = F.when(F.abs(F.col("pc_att_team") - 0.5) >= 1e-9, F.col("controlling_team")).alias("controlling_team")
    return _sides(spark, d, "frames").select("frame", "att_team", "possessing_team", told, "target_id", *[r6(c) for c in shares])


@query("g6_player_rows", f"""WITH {V.FORMATION}, {MOVED}, {SIDES.format(n=FEW_X)}, p AS (SELECT frame, team, player_id, any_value(s) AS s, avg(i) AS m, max(i) AS t FROM inf GROUP BY ALL)
SELECT p.frame, player_id, team, round(s, 6) + 0.0 AS speed_ms, round(m, 6) + 0.0 AS mean_influence, round(t, 6) + 0.0 AS max_influence, round(CASE WHEN (team = 'Home') = home THEN att ELSE 1 - att END, 6) + 0.0 AS team_pc_mean, round(att, 6) + 0.0 AS pc_att_team, round(t0, 6) + 0.0 AS pc_def_third FROM p JOIN sides USING (frame)""")
def g6_players(spark, d):
    return _sides(spark, d, "players").select("frame", "player_id", "team", *[r6(c) for c in ("speed_ms", "mean_influence", "max_influence", "team_pc_mean", "pc_att_team", "pc_def_third")])


@query("g6_frozen_radii", f"""WITH {V.FORMATION}, {SURFACE.replace("least(greatest(4 + 6 *", "CASE WHEN frame % 3 = 0 THEN 10 ELSE least(greatest(4 + 6 *").replace("4), 10) AS r", "4), 10) END AS r")} SELECT frame, round(avg(pc), 6) + 0.0 AS pc_att_team FROM pc GROUP BY frame""")
def g6_frozen(spark, d):
    players = _players(spark, d).withColumn("ball_speed_kmh", F.when(F.col("frame") % 3 == 0, 40.0).otherwise(10.0))
    return jobs.control_report(players, [], F.col("team") == "Home", tables=("frames",))["frames"].select("frame", r6("pc_att_team"))
