"""Row-wise columns and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds of speed categories in km/h, and the lines of pitch zones in metres.
SPEEDS = (("walking", 7), ("jogging", 14), ("running", 21))
THIRD_LINES = (-17.5, 17.5)
LANE_LINES = (-20.16, -3.66, 3.66, 20.16)
LANES = ("R", "HR", "C", "HL", "L")
LEFT, RIGHT = "right_to_left", "left_to_right"


def speed_category(kmh: Column) -> Column:
    out = reduce(lambda c, s: c.when(kmh < s[1], s[0]), SPEEDS[1:], F.when(kmh < SPEEDS[0][1], SPEEDS[0][0]))
    return F.when(kmh.isNotNull(), out.otherwise("sprinting"))


def zone(x: Column, y: Column, direction: Column, target: str = LEFT) -> tuple[Column, Column]:
    """(third, lane) of a point, mirrored where the team plays in the target direction; NULL where a coordinate is."""
    flip = F.when(direction == target, -1).otherwise(1)
    px, py = x * flip, y * flip
    third = F.when(px < THIRD_LINES[0], "D").when(px <= THIRD_LINES[1], "M").when(px.isNotNull(), "A")
    lane = reduce(lambda c, k: c.when(py < LANE_LINES[k], LANES[k]), range(1, 4), F.when(py < LANE_LINES[0], LANES[0])).when(py.isNotNull(), LANES[4])
    known = x.isNotNull() & y.isNotNull()
    return F.when(known, third), F.when(known, lane)


def playing_direction(team: Column, home_direction: Column, default: str | None = None) -> Column:
    """Home's stored direction, the other one for Away; default where none is stored."""
    other = F.when(home_direction == LEFT, RIGHT).when(home_direction == RIGHT, LEFT)
    got = F.when(team == "Home", home_direction).otherwise(other)
    return got if default is None else F.coalesce(got, F.lit(default))


def attack_sign(direction: Column, unknown: int = 1) -> Column:
    return F.when(direction == RIGHT, 1).when(direction == LEFT, -1).otherwise(unknown)


def direction_metric(dx: Column, dy: Column, sign: Column) -> Column:
    """Share of a movement that goes towards goal, -1 to 1; 0 without movement."""
    return F.coalesce(F.try_divide(dx, F.abs(dx) + F.abs(dy)), F.lit(0.0)) * sign


def run_candidates(movements: DataFrame, min_distance: float = 2.5, min_direction: float = 0.3, speeds: tuple[str, ...] = ("running", "sprinting"), sign: Column | None = None) -> DataFrame:
    """Movements of a team in (or contesting) possession that are fast, long and forward enough.

    sign, where given, multiplies direction first (for movements whose direction isn't signed yet).
    """
    forward = F.col("direction") if sign is None else F.col("direction") * sign
    holds = (F.col("possession") == F.col("team")) | F.col("possession_contested")
    return movements.where(holds & F.col("speed_category").isin(*speeds) & (F.col("distance_m") > min_distance) & (forward > min_direction))


def overlapping(df: DataFrame, start: int, end: int) -> DataFrame:
    return df.where((F.col("end_frame") >= start) & (F.col("start_frame") <= end))


def legacy_criteria(movements: DataFrame, min_duration: float = 1.0, min_x: float | None = None, min_direction: float = 0.0) -> DataFrame:
    """Older rule: in possession, at least jogging, long enough, forward, and from behind a line if one is given."""
    keep = (F.col("possession") == F.col("team")) & (F.col("speed_category") != "walking") & (F.col("duration_s") >= min_duration) & (F.col("direction") > min_direction)
    return movements.where(keep if min_x is None else keep & (F.col("x_start") >= min_x))


def live_phases(phases: DataFrame, min_seconds: float = 2.0) -> DataFrame:
    return phases.where(F.col("ball_live") & F.col("possession_team").isin("Home", "Away") & (F.col("duration_s") >= min_seconds))


def in_possession(runs: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """Runs whose first frame has holds in states (keys, frame, holds); an unknown state doesn't count."""
    at = states.where("holds").select(*keys, F.col("frame").alias("start_frame")).distinct()
    return runs.join(at, [*keys, "start_frame"], "left_semi")


def goal_indicator(team: Column, home: Column, away: Column) -> Column:
    return F.when(team == "Away", away - home).otherwise(home - away)


def defence_type(centroid_x: Column, sign: Column) -> Column:
    ahead = centroid_x * sign
    return F.when(ahead > 0, "high_press").when(ahead > -15, "medium_block").when(ahead.isNotNull(), "low_block")


def attack_coordinates(x: Column, y: Column, sign: Column) -> tuple[Column, Column]:
    return x * sign, y * sign


def unit_coordinates(x: Column, y: Column, sign: Column, length: float = 104.0, width: float = 68.0) -> tuple[Column, Column]:
    """Coordinates in [0, 1] in attacking direction; y keeps its side."""
    return (x * sign + length / 2) / length, (y + width / 2) / width


def possession_team(code: Column) -> Column:
    return F.when(code == 1, "Home").when(code == 2, "Away").otherwise("contest")


def attackers(possessing: Column, default: str = "Home") -> Column:
    return F.coalesce(F.when(possessing.isin("Home", "Away"), possessing), F.lit(default))


def elapsed_seconds(frame: Column, kickoff_frame: Column, half: Column, continuous: bool = False, fps: int = 25) -> Column:
    base = F.when(half == "O", 2700.0).otherwise(0.0) if continuous else F.lit(0.0)
    return F.greatest((frame - kickoff_frame) / fps + base, F.lit(0.0))


def clock_to_frame(ts: Column, kickoff: Column, second_start: Column, fps: int = 25) -> tuple[Column, Column]:
    """(half, frame) of a UTC time; NULL before kick-off. Halves round to even."""
    ts = ts.cast("timestamp")
    micros = F.unix_micros(ts) - F.when(ts < second_start, F.unix_micros(kickoff)).otherwise(F.unix_micros(second_start))
    late = ts >= kickoff
    return F.when(late, F.when(ts < second_start, "firstHalf").otherwise("secondHalf")), F.when(late, F.rint(micros / 1e6 * fps).cast("long"))


def clip_plan(runs: DataFrame, before: float = 3.0, after: float = 1.5, fps: int = 25) -> DataFrame:
    """Where to seek and how long to play for each run; offset_s is the half's place in the video."""
    start = F.greatest(F.col("offset_s") + F.col("start_frame") / fps - before, F.lit(0.0))
    end = F.col("offset_s") + F.col("end_frame") / fps + after
    return runs.withColumns({"seek_s": start, "play_s": end - start})


def ordered_columns(df: DataFrame, first: list[str]) -> DataFrame:
    """Named columns first, those that are there; all others behind them as they were."""
    return df.select(*[c for c in first if c in df.columns], *[c for c in df.columns if c not in first])


def filter_spec(spec: dict[str, dict]) -> Column:
    """A predicate from {column: {"min", "below", "any" (values), "is" (bool), "or": [...]}}; columns are and-ed."""

    def one(name: str, s: dict) -> Column:
        tests = []
        if "min" in s:
            tests.append(F.col(name) >= s["min"])
        if "below" in s:
            tests.append(F.col(name) < s["below"])
        if "any" in s:
            tests.append(F.col(name).isin(*s["any"]))
        if "is" in s:
            tests.append(F.col(name) == F.lit(s["is"]))
        own = reduce(lambda a, b: a & b, tests) if tests else None
        more = [one(name, x) for x in s.get("or", [])]
        return reduce(lambda a, b: a | b, [*([own] if own is not None else []), *more])

    return reduce(lambda a, b: a & b, [one(k, v) for k, v in spec.items()])


def with_provenance(df: DataFrame, metrics: dict[str, tuple[Column, Column]], into: str = "duration_source") -> DataFrame:
    """metrics: name to (matched value, recomputed value). All matched ones are taken where none is NULL, else all recomputed."""
    whole = reduce(lambda a, b: a & b, [m.isNotNull() for m, _ in metrics.values()])
    some = reduce(lambda a, b: a | b, [r.isNotNull() for _, r in metrics.values()])
    named = {k: F.when(whole, m).otherwise(r) for k, (m, r) in metrics.items()}
    return df.withColumns(named | {into: F.when(whole, "matched").when(some, "recomputed").otherwise("missing")})
