"""Whole jobs: extraction of movements, match context, agreement, enrichment and control reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import context, control, indicators, intervals, matching, predicates, series
from ..operators import people as people_
from ..operators.lineage import checkpointed
from ..operators.predicates import attack_sign, direction_metric, playing_direction, zone
from ..sources.views import K


def with_directions(movements: DataFrame, directions: DataFrame) -> DataFrame:
    """attack_sign, direction and zones from (match_id, half, home_direction); unknown ones count as +1."""
    df = movements.join(directions, ["match_id", "half"], "left").withColumn("_dir", playing_direction(F.col("team"), F.col("home_direction")))
    df = df.withColumn("attack_sign", attack_sign(F.col("_dir")))
    dx, dy = F.col("x_end") - F.col("x_start"), F.col("y_end") - F.col("y_start")
    df = df.withColumn("direction", direction_metric(dx, dy, F.col("attack_sign")))
    for at in ("start", "mid", "end"):
        third, lane = zone(F.col(f"x_{at}"), F.col(f"y_{at}"), F.col("_dir"))
        df = df.withColumns({f"third_{at}": third, f"lane_{at}": lane, f"zone_{at}": F.concat(third, lane)})
    return df.drop("home_direction", "_dir")


def extract_movements(track: DataFrame, directions: DataFrame, unit: float = 1.0, keys: list[str] = K, power: bool = False, parts: int | None = None) -> DataFrame:
    """Movements of all players of all matches: speed, valleys, optional power split, summary, directions and zones.

    track has keys, frame, x, y, poss; parts is the number of tasks. Movements without distance are left out.
    """
    df = series.before_start(series.speed(track, keys, unit), keys)
    df = series.valley_segments(df, keys, parts=parts)
    order = ["segment_id"]
    if power:
        df, order = series.spread(series.power_split(df, keys, parts=parts), parts, *keys), ["segment_id", "piece"]
    df = series.number_movements(df, keys, order)
    return with_directions(series.movement_summary(df, keys).where("distance_m > 0"), directions)


def movement_job(track: DataFrame, directions: DataFrame, events: DataFrame, unit: float = 1.0, keys: list[str] = K, shortest_possession: int = 25, fps: int = 25, parts: int | None = None) -> DataFrame:
    """The whole extraction: smoothed places and possession, movements split by power, match context, and the choice of runs.

    track: keys, frame, x, y, poss; directions: match_id, half, home_direction; events as match_context() takes them.
    """
    df = series.low_pass(track, keys, ["x", "y"])
    df = series.absorb_short(df, keys, "poss", shortest_possession).drop("poss").withColumnRenamed("smoothed", "poss")
    movements = extract_movements(df, directions, unit, keys, power=True, parts=parts)
    return predicates.run_candidates(match_context(movements, events, fps))


def directions_of(track: DataFrame) -> DataFrame:
    """A playing direction for each match and half: home plays to the right in F of even matches, and so on by turns."""
    right = (F.col("match_id") % 2 == 0) == (F.col("half") == "F")
    return track.select("match_id", "half").distinct().withColumn("home_direction", F.when(right, predicates.RIGHT).otherwise(predicates.LEFT))


def with_score_and_shots(movements: DataFrame, events: DataFrame, fps: int = 25, parts: int | None = None) -> DataFrame:
    """The score at each movement's start, its goal indicator, and whether a shot follows its end."""
    goals = intervals.cumulative_score(events.where("kind = 'goal'"), ["match_id"])
    df = movements.withColumns({"elapsed": F.col("start_frame") / fps, "end_s": F.col("end_frame") / fps})
    df = intervals.score_at(df, goals.withColumn("elapsed", F.col("elapsed").cast("double")), parts=parts)
    df = df.withColumn("goal_indicator", predicates.goal_indicator(F.col("team"), F.col("home"), F.col("away")))
    return intervals.shot_follows(df, events.where("kind = 'shot'").withColumn("elapsed", F.col("elapsed").cast("double")), parts=parts)


def match_context(movements: DataFrame, events: DataFrame, fps: int = 25) -> DataFrame:
    """Movements with the score at their start and whether a shot follows, without those that start in a blackout."""
    df = with_score_and_shots(movements, events, fps)
    return intervals.outside_blackouts(df, intervals.blackouts(events.where("kind NOT IN ('goal', 'shot')"), fps))


def frame_context(players: DataFrame, frames: DataFrame, match: list[str], sign, fps: int = 25) -> DataFrame:
    """A row for each frame and team: possession phase and attack type, block centroid, the three lines and defence type.

    frames: match, frame, possession_team, ball_live; players: match, frame, team, player_id, position, x, y.
    """
    state = F.struct("possession_team", "ball_live")
    phases = series.attack_type(series.possession_phases(frames, match, fps), match)
    carried = series.islands(frames, match, state, into="phase_id").withColumn("phase_id", F.col("phase_id") + 1)
    carried = carried.join(phases.select(*match, "phase_id", F.col("start_frame").alias("phase_start"), "duration_s", "attack_type"), [*match, "phase_id"])
    at = [*match, "frame"]
    blocks = team_blocks(players, at, sign)
    return carried.join(blocks, at)


def team_blocks(players: DataFrame, keys: list[str], sign) -> DataFrame:
    """Block centroid, lines and defence type of each team in each frame."""
    blocks = context.block_centroid(players, keys).join(context.defensive_lines(players, keys, sign), [*keys, "team"])
    return blocks.withColumn("defense_type", predicates.defence_type(F.col("block_cx"), sign))


def role_table(track: DataFrame, phases: DataFrame, keys: list[str], sign, shortest_s: float = 2.0, coverage: float = 0.5, players: int = 4, keeper: str = "TW", length: float = 104.0, width: float = 68.0) -> DataFrame:
    """(keys, phase_id, team, player_id, role, formation, mean_x, mean_y, norm_x, norm_y, zone) of every attack.

    track: keys, phase_id, team, player_id, position, x, y, origin at the centre; phases: keys, phase_id, possession_team,
    ball_live, duration_s; sign: the attack sign of a row's team. Live phases of Home or Away of shortest_s and on count,
    in them players of known place in at least that share of frames, in teams of enough such players. Zones are against
    the mean places of the others' outfield players, the line being their hindmost in the attackers' direction, and the
    block tested on the pitch's long axis; with fewer than three of them a zone is NULL. norm_x runs in the attackers'
    direction, norm_y across the pitch as it is.
    """
    at = [*keys, "phase_id"]
    live = phases.where(F.col("ball_live") & F.col("possession_team").isin("Home", "Away") & (F.col("duration_s") >= shortest_s)).select(*at, "possession_team")
    rows = track.join(live, at).withColumns({"own": F.col("team") == F.col("possession_team"), "_sign": sign})
    rows = rows.withColumn("_sign", F.when(F.col("own"), F.col("_sign")).otherwise(-F.col("_sign")))
    means = context.phase_positions(rows, [*at, "team", "own", "position", "_sign"], coverage, 1)
    means = means.withColumns({"x": F.col("mean_x") * F.col("_sign"), "y": F.col("mean_y") * F.col("_sign")})
    mine = means.where("own").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*at))).where(F.col("_n") >= players)
    mine = mine.withColumns({"norm_x": (F.col("x") + length / 2) / length, "norm_y": (F.col("mean_y") + width / 2) / width})
    roles = context.assign_roles(mine.select(*at, "player_id", "norm_x", "norm_y"), at)
    others = means.where(~F.col("own") & (F.col("position") != keeper))
    zones = context.zone_against_block(mine.select(*at, "player_id", "x", "y"), others, at, "advanced", centre_y=True).select(*at, "player_id", "zone")
    found = mine.select(*at, "team", "player_id", "mean_x", "mean_y", "norm_x", "norm_y").join(roles, [*at, "player_id"]).join(zones, [*at, "player_id"], "left")
    return found.select(*at, "team", "player_id", "role", "formation", "mean_x", "mean_y", "norm_x", "norm_y", "zone")


def agreement(annotations: DataFrame, by: list[str], tolerance: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pair statistics, matches, isolated segments). A segment is known by by, annotator and segment_id together."""
    matches = matching.directed_matches(annotations, by, tolerance)
    return matching.pair_stats(annotations, matches, by), matches, matching.isolated(annotations, matching.undirected(matches, by), by)


def agreement_report(annotations: DataFrame, by: list[str], tolerance: int = 0) -> dict[str, DataFrame]:
    """All tables of agreement: pairs, kpis, matrix, distribution, counts, matches, isolated segments and match groups.

    annotations: by (match, half), annotator, segment_id, jid, start_frame, end_frame. Matches are made once and stored;
    the matrix is by the last column of by.
    """
    matches = checkpointed(matching.directed_matches(annotations, by, tolerance))
    pairs, linked = matching.pair_stats(annotations, matches, by), matching.undirected(matches, by)
    return {
        "pairs": pairs, "kpis": matching.global_kpis(pairs), "matrix": matching.match_matrix(matches, by[-1]), "distribution": matching.iou_distribution(matches, by),
        "counts": matching.matched_counts(annotations, matches, by), "matches": matches, "isolated": matching.isolated(annotations, linked, by), "groups": matching.match_groups(annotations, linked, by),
    }


def evaluate(predicted: DataFrame, truth: DataFrame, keys: list[str], by: list[str], total: list[str], tolerance: int = 25) -> dict[str, DataFrame]:
    """Tables of one-to-one matches, precision and recall, predicted segments without truth and truth that was missed."""
    matches = matching.tolerance_match(matching.intervals(predicted, keys), matching.intervals(truth, keys), keys, tolerance)
    turned = matches.select(*keys, F.col("b_id").alias("a_id"))
    return {"matches": matches, "scores": matching.evaluation(predicted, truth, matches, by, total), "surplus": matching.unmatched(predicted, matches, keys), "missed": matching.unmatched(truth, turned, keys)}


def enrich(annotations: DataFrame, movements: DataFrame, track: DataFrame, people: DataFrame, events: DataFrame, keys: list[str], half: list[str], fps: int = 25, parts: int | None = None, ends: DataFrame | None = None) -> DataFrame:
    """Annotations with the measures of their best matching movement, or else of their own interval, and their context.

    annotations: segment_id, keys, half, match_id, half, team, jid, start_frame, end_frame, play_direction and further
    columns, which stay behind the others; movements: keys, movement_id, start_frame, end_frame, distance_m, duration_s,
    peak_speed_kmh, avg_velocity_kmh; track and half as interval_indicators() takes them; people: person_id, team, jid,
    position; events as match_context() takes them; parts and ends as for interval_indicators(): matches, joins and context
    are dealt to parts tasks, too. The measures are all of one origin, which duration_source names.
    """
    kmh, names = 3.6, ["distance_m", "duration_s", "peak_vel_ms", "mean_vel_ms"]
    ids, at = indicators.interval_ids(keys, half), [*keys, "segment_id"]
    measures = F.struct("distance_m", "duration_s", (F.col("peak_speed_kmh") / kmh).alias("peak_vel_ms"), (F.col("avg_velocity_kmh") / kmh).alias("mean_vel_ms"))
    moves = matching.intervals(movements.withColumn("_m", measures), keys, "movement_id", ("_m",))
    found = matching.best_iou_segments(matching.intervals(annotations, keys), moves, keys, held=("_m",), parts=parts).withColumnsRenamed({"a_id": "segment_id", "b_id": "movement_id"})
    own = indicators.interval_indicators(annotations, track, keys, half, fps=fps, parts=parts, ends=ends)
    rest = [c for c in own.columns if c not in (*ids, *names, *annotations.columns)]
    own = own.select(*ids, F.struct(*names).alias("_r"), *rest)
    df = with_score_and_shots(annotations, events, fps, parts)
    late = [c for c in df.columns if c not in annotations.columns]
    df = series.spread(df, parts, *at).join(found, at, "left").join(series.spread(own, parts, *ids), ids, "left")
    df = predicates.with_provenance(df, {c: (F.col(f"_m.{c}"), F.col(f"_r.{c}")) for c in names}).drop("_m", "_r")
    df = people_.position_of(people_.person_by_shirt(df, people), people)
    df = df.select(*[c for c in df.columns if c not in late], *late)
    return predicates.ordered_columns(df, ["match_id", "half", "segment_id", "team", "jid", "person_id", "position", "start_frame", "end_frame", "movement_id", "iou", "duration_source", *names, "scoreline", "goal_indicator", "shot_within"])


def control_report(players: DataFrame, keys: list[str], attacking, radius: float = 15.0, mirrored=None, windows: DataFrame | None = None, freeze_above: float = control.FREEZE_KMH, target=None, target_radius: float = 15.0, nx: int = control.NX, ny: int = control.NY, tables: tuple[str, ...] = ("frames", "players", "snapshots", "summary")) -> dict[str, DataFrame]:
    """Tables of control by frame, player, snapshot and player summary, or those of them that tables names.

    players: keys, frame, team (Home or Away), player_id, x, y, vx, vy, ball_x, ball_y, ball_speed_kmh and, where it is
    known, possession_team. windows (keys, window_id, start_frame, end_frame) chooses frames and is a key of all tables
    then, all windows in one job; without it all frames are one window for each key. Radii are frozen where the ball is
    faster than freeze_above. ball_zone lies around the ball, player_zone around the player that target marks (the first by
    id, where there is one). Shares are given for attackers and others, and as home and away; frames are summed up once,
    with the means of their players, and stored if more than one table is made of them.
    """
    if windows is None:
        players, keys = players.withColumn("window_id", F.lit(0)), [*keys, "window_id"]
    else:
        spans = windows.select(*keys, "window_id", F.col("start_frame").alias("_from"), F.col("end_frame").alias("_to"))
        players, keys = intervals.range_join(players, spans, keys, F.col("frame"), F.col("_from"), F.col("_to"), 256).drop("_from", "_to"), [*keys, "window_id"]
    at, fast = [*keys, "frame"], F.col("ball_speed_kmh") > freeze_above
    held = [F.min("ball_x").alias("ball_x"), F.min("ball_y").alias("ball_y"), F.max("ball_speed_kmh").alias("ball_speed_kmh"), F.coalesce(F.bool_or(fast), F.lit(False)).alias("radius_frozen")]
    held += [F.max(F.when(attacking, F.col("team"))).alias("attackers"), F.max(F.when(~F.coalesce(attacking, F.lit(False)), F.col("team"))).alias("defenders")]
    if "possession_team" in players.columns:
        held.append(F.max("possession_team").alias("possessing"))
    zones = {"ball_zone": (F.min("ball_x"), F.min("ball_y"), radius)}
    if target is not None:
        first = F.min(F.when(target & F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct("player_id", "x", "y")))
        zones["player_zone"] = (first["x"], first["y"], target_radius)
        held.append(first["player_id"].alias("target_id"))
    speed = F.sqrt((F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")).cast("double"))
    shown = [*[F.col(c) for c in ("player_id", "team", "x", "y")], speed.alias("speed_ms")] if {"players", "summary"} & set(tables) else []
    frames = control.frame_control(players, at, attacking, fast, mirrored, zones, held, nx=nx, ny=ny, rows=shown)
    other = F.when(F.col("attackers") == "Home", "Away").when(F.col("attackers") == "Away", "Home")
    frames = frames.withColumns({"att_team": F.coalesce("attackers", F.when(F.col("defenders") == "Home", "Away").otherwise("Home")), "def_team": F.coalesce("defenders", other)})
    frames = frames.withColumn("controlling_team", F.when(F.col("controlling") == "attack", F.col("att_team")).otherwise(F.col("def_team")))
    frames = frames.withColumn("possessing_team", F.coalesce("possessing", F.lit("unknown")) if "possession_team" in players.columns else F.lit("unknown")).drop("attackers", "defenders", "possessing")
    shares = {"pc_combined": ("pc_att_team", F.col("pc_def_team")), "pc_only": ("mean_pc_att_only", F.col("mean_pc_def_only")), **{n: (f"{n}_pc", 1 - F.col(f"{n}_pc")) for n in zones}}
    made = control.by_side(frames, F.col("att_team") == "Home", shares)
    made = checkpointed(made) if len(tables) > 1 else made
    frames, out = made.drop("rows"), {}
    out |= {"frames": frames} if "frames" in tables else {}
    if shown:
        whole = ["possessing_team", "att_team", "pc_att_team", "pc_def_team", "controlling_team", "pc_def_third", "pc_mid_third", "pc_att_third"]
        named = reduce(Column.__and__, [F.col(c).isNotNull() for c in at])
        rows = made.where(named).select(*at, F.explode("rows").alias("_row"), *whole).where("_row.mean_influence IS NOT NULL").select(*at, "_row.*", *whole)
        rows = rows.withColumn("team_pc_mean", F.when(F.col("team") == F.col("att_team"), F.col("pc_att_team")).otherwise(F.col("pc_def_team")))
        out |= {"players": rows} if "players" in tables else {}
    out |= {"snapshots": series.snapshots(frames, keys)} if "snapshots" in tables else {}
    return out | ({"summary": control.influence_summary(rows, [*keys, "team", "player_id"])} if "summary" in tables else {})
