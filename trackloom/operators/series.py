"""Operators on ordered series: smoothing, speed, phases, valleys, segments and their summaries.

keys names the columns of one series (a player in one half, say); order the column that its rows go by. A series is
bounded by its nature (a half has 67,500 frames), so one window over it stays in one task, and all windows on the same
keys share one shuffle. parts, where an operator takes it, is the number of tasks that its own shuffles deal rows to;
without it the session's number holds, and tasks grow with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.scalar import FPS
from .predicates import speed_category


def over(keys: list[str], order: str | list[str] = "frame") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))


def descending(keys: list[str], order: str = "frame") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(F.col(order).desc())


def spread(df: DataFrame, parts: int | None, *by: str) -> DataFrame:
    """df dealt by columns to so many tasks; as it is without parts."""
    return df if parts is None else df.repartition(parts, *by)


def islands(df: DataFrame, keys: list[str], value: str | Column, order: str = "frame", into: str = "island") -> DataFrame:
    """Numbers the runs of one value, from 0 in each series."""
    w = over(keys, order)
    value = F.col(value) if isinstance(value, str) else value
    change = (F.row_number().over(w) > 1) & ~value.eqNullSafe(F.lag(value).over(w))
    return df.withColumn("_change", change.cast("long")).withColumn(into, F.sum("_change").over(w)).drop("_change")


def low_pass(df: DataFrame, keys: list[str], columns: list[str], order: str = "frame", shortest: int = 4) -> DataFrame:
    """Zero-phase smoothing with weights 1/4, 1/2, 1/4 over contiguous known samples.

    The ends of such a stretch stay as they are, and stretches shorter than shortest become NULL.
    """
    for c in columns:
        df = islands(df, keys, F.col(c).isNull(), order, "_run")
        w, whole = over([*keys, "_run"], order), Window.partitionBy(*keys, "_run")
        value = F.coalesce((F.lag(c).over(w) + 2 * F.col(c) + F.lead(c).over(w)) / 4, F.col(c).cast("double"))
        df = df.withColumn("_new", F.when(F.count(c).over(whole) >= shortest, value)).drop("_run", c).withColumnRenamed("_new", c)
    return df


def speed(df: DataFrame, keys: list[str], unit: float = 1.0, fps: int = FPS, into: str = "v") -> DataFrame:
    """Speed by central differences, one-sided at the ends; a series of one sample has 0."""
    w = over(keys)

    def step(c: str) -> Column:
        ahead = F.coalesce(F.lead(c).over(w), 2 * F.col(c) - F.lag(c).over(w), F.col(c))
        back = F.coalesce(F.lag(c).over(w), 2 * F.col(c) - F.lead(c).over(w), F.col(c))
        return ahead - back

    df = df.withColumns({"_dx": step("x"), "_dy": step("y")})
    length = F.sqrt((F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")).cast("double"))
    return df.withColumn(into, F.lit(unit * fps / 2) * length).drop("_dx", "_dy")


def backward_velocity(df: DataFrame, keys: list[str], fps: int = FPS) -> DataFrame:
    """(vx, vy) from the row before, whatever the gap; 0 at first sight."""
    w = over(keys)
    return df.withColumns({f"v{c}": F.coalesce((F.col(c) - F.lag(c).over(w)) * float(fps), F.lit(0.0)) for c in ("x", "y")})


def ball_speed(df: DataFrame, keys: list[str], freeze_above: float = 36.0, fps: int = FPS) -> DataFrame:
    """Speed in km/h against the row before, and whether it passes the bound that freezes radii."""
    df = backward_velocity(df, keys, fps)
    kmh = F.sqrt((F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")).cast("double")) * 3.6
    return df.withColumn("ball_speed_kmh", kmh).withColumn("radius_frozen", F.col("ball_speed_kmh") > freeze_above)


def gradient(c: str, w: WindowSpec, dt: float = 1.0) -> Column:
    """Central differences, one-sided at the ends of the window's series."""
    both = (F.lead(c).over(w) - F.lag(c).over(w)) / (2 * dt)
    return F.coalesce(both, (F.lead(c).over(w) - F.col(c)) / dt, (F.col(c) - F.lag(c).over(w)) / dt, F.lit(0.0))


def cost(slope):
    """Energy cost of running up an equivalent slope, of a column or of numbers."""
    #: Coefficients of the cost of transport by slope, from the fifth power down.
    out = 155.4
    for k in (-30.4, -43.3, 46.3, 19.5, 3.6):
        out = out * slope + k
    return out * 1.29


def metabolic_power(df: DataFrame, keys: list[str], fps: int = FPS) -> DataFrame:
    """accel, power (v * accel) and ec, the energy cost of the equivalent slope; unknown speed counts as 0."""
    df = df.withColumn("_v", F.coalesce("v", F.lit(0.0)))
    df = df.withColumn("accel", gradient("_v", over(keys), 1.0 / fps)).withColumn("power", F.col("_v") * F.col("accel"))
    i = F.greatest(F.least(F.col("accel") / 9.81, F.lit(0.5)), F.lit(-0.5))
    return df.withColumn("ec", cost(i)).drop("_v")


def absorb_short(df: DataFrame, keys: list[str], value: str, cutoff: int, into: str = "smoothed", order: str = "frame") -> DataFrame:
    """Runs shorter than cutoff take the value before them; a series' first run stays."""
    df = islands(df, keys, value, order, "_run")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_run"))
    df = df.withColumn("_own", F.when((n >= cutoff) | (F.col("_run") == 0), F.struct(F.col(value).alias("v"))))
    return df.withColumn(into, F.last("_own", ignorenulls=True).over(over(keys, order))["v"]).drop("_run", "_own")


def phase_ids(df: DataFrame, match: list[str], half: str, value: str, order: str = "frame") -> DataFrame:
    """phase_id (from 1, going on over halves) and phase_duration in rows, of runs of one value within a half."""
    keys = [*match, half]
    df = islands(df, keys, value, order, "_run")
    lasts = df.groupBy(*keys).agg((F.max("_run") + 1).alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy(*match).orderBy(half).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.join(lasts.withColumn("_ahead", ahead).drop("_n"), keys)
    df = df.withColumn("phase_duration", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_run")))
    return df.withColumn("phase_id", F.col("_ahead") + F.col("_run") + 1).drop("_run", "_ahead")


def possession_phases(frames: DataFrame, keys: list[str], fps: int = FPS, by_half: str | None = None) -> DataFrame:
    """A row for each run of one possession and ball status: phase_id, start_frame, end_frame, durations.

    Halves are no change unless by_half names their column.
    """
    state = [F.col("possession_team"), F.col("ball_live"), *([F.col(by_half)] if by_half else [])]
    df = islands(frames, keys, F.struct(*state), into="phase_id")
    out = df.groupBy(*keys, "phase_id").agg(
        F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.min_by("possession_team", "frame").alias("possession_team"),
        F.min_by("ball_live", "frame").alias("ball_live"), F.count(F.lit(1)).alias("duration_frames"),
    )
    return out.withColumn("phase_id", F.col("phase_id") + 1).withColumn("duration_s", F.col("duration_frames") / fps)


def attack_type(phases: DataFrame, keys: list[str], counter_seconds: float = 5.0) -> DataFrame:
    """dead_ball, contest, set_piece, counter_attack or organized_attack, from the phase itself and the one before."""
    w = over(keys, "phase_id")
    live, team, seconds = F.lag("ball_live").over(w), F.lag("possession_team").over(w), F.lag("duration_s").over(w)
    named = F.col("possession_team").isin("Home", "Away")
    turned = team.isin("Home", "Away") & (team != F.col("possession_team")) & (seconds < counter_seconds)
    kind = F.when(~F.col("ball_live"), "dead_ball").when(~named, "contest").when(live == F.lit(False), "set_piece").when(turned, "counter_attack").otherwise("organized_attack")
    return phases.withColumn("attack_type", kind)


def valley_candidates(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    """is_valley: local minima; a flat one counts at its middle row, and a series' ends never do. NULL counts as 0.

    A flat stretch's ends, and the speeds beyond them, are carried along by windows on keys, so nothing is joined. What
    lies ahead comes from a window in descending order: Spark computes a frame that runs to the end anew for each row.
    """
    w = over(keys)
    so_far = (Window.unboundedPreceding, 0)
    back, ahead = w.rowsBetween(*so_far), descending(keys).rowsBetween(*so_far)
    df = df.withColumn("_v", F.coalesce(v, F.lit(0.0)))
    first = ~F.coalesce(F.lag("_v").over(w) == F.col("_v"), F.lit(False))
    last = ~F.coalesce(F.lead("_v").over(w) == F.col("_v"), F.lit(False))
    df = df.withColumns({"_a": F.when(first, F.struct("frame", F.lag("_v").over(w).alias("v"))), "_b": F.when(last, F.struct("frame", F.lead("_v").over(w).alias("v")))})
    df = df.withColumns({"_a": F.last("_a", ignorenulls=True).over(back), "_b": F.last("_b", ignorenulls=True).over(ahead)})
    low = (F.col("_a.v") > F.col("_v")) & (F.col("_b.v") > F.col("_v")) & (F.col("frame") == F.floor((F.col("_a.frame") + F.col("_b.frame")) / 2))
    return df.withColumn("is_valley", F.coalesce(low, F.lit(False))).drop("_v", "_a", "_b")


def suppress_near(valleys: DataFrame, keys: list[str], distance: int, v: str = "v") -> DataFrame:
    """Of candidate rows, keeps the deepest first and drops those nearer than distance frames; later ones win ties.

    Chains of candidates with gaps below distance are decided on their own.
    """
    w = over(keys)
    far = (F.col("frame") - F.lag("frame").over(w) >= distance).cast("long")
    chains = valleys.withColumn("_chain", F.sum(F.coalesce(far, F.lit(0))).over(w))
    ranked = F.sort_array(F.collect_list(F.struct(F.col(v).alias("v"), (-F.col("frame")).alias("f"))))
    near = lambda kept, x: F.exists(kept, lambda k: F.abs(k - x) < distance)
    chosen = F.aggregate(ranked, F.array().cast("array<bigint>"), lambda a, c: F.when(near(a, -c["f"]), a).otherwise(F.concat(a, F.array(-c["f"]))))
    return chains.groupBy(*keys, "_chain").agg(chosen.alias("_kept")).select(*keys, F.explode("_kept").alias("frame"))


def deep_valleys(df: DataFrame, keys: list[str], distance: int = 15, absolute: float = 0.15, relative: float = 0.05, v: str = "v") -> DataFrame:
    """is_valley only where speed falls far enough below the local peak around it."""
    speed_ = F.coalesce(F.col(v), F.lit(0.0))
    peak = F.max(speed_).over(over(keys).rowsBetween(-distance, distance - 1))
    drop = peak - speed_
    deep = (drop >= absolute) & (F.when(peak > 0, drop / peak).otherwise(0.0) >= relative)
    return df.withColumn("_deep", deep).withColumn("is_valley", F.col("is_valley") & F.col("_deep")).drop("_deep")


def cut_at(df: DataFrame, keys: list[str], boundary: Column, shortest: int = 3, into: str = "segment_id") -> DataFrame:
    """Numbers the pieces between boundary rows; the last row of a series belongs to none, nor do pieces that are too short or unknown."""
    w = over(keys)
    df = df.withColumn("_cut", F.coalesce(boundary, F.lit(False)).cast("long")).withColumn(into, F.sum("_cut").over(w))
    df = df.withColumn("_last", F.lead("frame").over(w).isNull()).where("NOT _last")
    piece = Window.partitionBy(*keys, into)
    df = df.withColumns({"_n": F.count(F.lit(1)).over(piece), "_known": F.count("v").over(piece)})
    return df.where((F.col("_n") >= shortest) & (F.col("_known") > 0)).drop("_cut", "_last", "_n", "_known")


def _spaced(df: DataFrame, keys: list[str], distance: int, parts: int | None) -> DataFrame:
    """valley_candidates() with _kept, true for those that suppress_near() keeps and NULL elsewhere."""
    marked = valley_candidates(df, keys)
    kept = suppress_near(marked.where("is_valley"), keys, distance).withColumn("_kept", F.lit(True))
    at = [*keys, "frame"]
    return spread(spread(marked, parts, *at).join(spread(kept, parts, *at), at, "left"), parts, *keys)


def valley_segments(df: DataFrame, keys: list[str], distance: int = 15, absolute: float = 0.15, relative: float = 0.05, parts: int | None = None) -> DataFrame:
    """Pieces between deep, well-spaced valleys of speed; a valley opens its piece."""
    marked = _spaced(df, keys, distance, parts)
    marked = marked.withColumn("is_valley", F.coalesce("_kept", F.lit(False))).drop("_kept")
    return cut_at(deep_valleys(marked, keys, distance, absolute, relative), keys, F.col("is_valley"))


def plain_valley_segments(df: DataFrame, keys: list[str], distance: int = 10, parts: int | None = None) -> DataFrame:
    """The older method: every well-spaced valley cuts."""
    return cut_at(_spaced(df, keys, distance, parts), keys, F.col("_kept")).drop("_kept", "is_valley")


def power_split(df: DataFrame, keys: list[str], threshold: float = 6.0, shortest: int = 10, fps: int = FPS, parts: int | None = None) -> DataFrame:
    """Cuts segments (keys, segment_id) where power jumps, or at its first extremum behind a change of its sign.

    Cuts keep shortest rows from the last one and from both ends; pieces below 3 rows go. Adds accel, power, ec and piece.
    """
    own = [*keys, "segment_id"]
    w = over(own)
    df = metabolic_power(df, own, fps).withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*own))})
    df = df.withColumn("_dp", gradient("power", w))
    inner = F.col("_i").between(shortest, F.col("_n") - shortest - 1)
    turn = (F.lag("_dp").over(w) * F.col("_dp") < 0) & (F.col("_i") < F.col("_n") - shortest)
    next_turn = F.last(F.when(F.col("_turn"), F.col("_i")), ignorenulls=True).over(descending(own).rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_turn", turn).withColumn("_next", next_turn)
    crossing = inner & (F.lag("power").over(w) * F.col("power") < 0)
    df = df.withColumn("_at", F.array_compact(F.array(F.when(inner & (F.abs("_dp") > threshold), F.col("_i")), F.when(crossing, F.coalesce("_next", "_i")))))
    found = df.where(F.size("_at") > 0).select(*own, F.explode("_at").alias("_at")).groupBy(*own).agg(F.array_sort(F.collect_set("_at")).alias("_all"))
    start = F.array(F.lit(0))
    spaced = F.aggregate("_all", start, lambda a, c: F.when(c - F.element_at(a, -1) >= shortest, F.concat(a, F.array(c))).otherwise(a))
    df = spread(df.drop("_at", "_turn", "_next", "_dp"), parts, *own).join(spread(found.select(*own, spaced.alias("_cuts")), parts, *own), own, "left")
    piece = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("_i"))), F.lit(1)) - 1
    df = df.withColumn("piece", piece)
    return df.withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(*own, "piece"))).where("_m >= 3").drop("_i", "_n", "_m", "_cuts")


def number_movements(df: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """movement_id from 0 in each series, by the order of the named columns."""
    return df.withColumn("movement_id", (F.dense_rank().over(over(keys, parts)) - 1).cast("long"))


def before_start(df: DataFrame, keys: list[str], seconds: float = 2.0, fps: int = FPS) -> DataFrame:
    """pre_run_mean_vel_kmh, pre_run_peak_vel_kmh and pre_run_window_s of the rows just before each row."""
    n = round(seconds * fps)
    w = over(keys).rowsBetween(-n, -1)
    have = F.least(F.row_number().over(over(keys)) - 1, F.lit(n))
    return df.withColumns({
        "pre_run_mean_vel_kmh": F.avg("v").over(w) * 3.6, "pre_run_peak_vel_kmh": F.max("v").over(w) * 3.6,
        "pre_run_window_s": F.when(have > 0, F.round(have / fps, 2)),
    })


def movement_summary(df: DataFrame, keys: list[str], contested: tuple[float, float] = (0.30, 0.70), fps: int = FPS) -> DataFrame:
    """A row for each (keys, movement_id): kinematics, places, energy (where ec is there) and possession.

    Median places, first row on ties of peak speed; contested is the open range of home shares.
    """
    own = [*keys, "movement_id"]
    w = over(own)
    step = F.sqrt(((F.col("x") - F.lag("x").over(w)) * (F.col("x") - F.lag("x").over(w)) + (F.col("y") - F.lag("y").over(w)) * (F.col("y") - F.lag("y").over(w))).cast("double"))
    df = df.withColumn("_step", step).withColumn("_top", F.struct(F.coalesce("v", F.lit(-1.0)), -F.col("frame")))
    aggs = [
        F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.max_by("frame", "_top").alias("peak_frame"),
        F.min_by("x", "frame").alias("x_start"), F.min_by("y", "frame").alias("y_start"), F.median("x").alias("x_mid"), F.median("y").alias("y_mid"),
        F.max_by("x", "frame").alias("x_end"), F.max_by("y", "frame").alias("y_end"), F.max_by("x", "_top").alias("x_peak"), F.max_by("y", "_top").alias("y_peak"),
        (F.coalesce(F.max("v"), F.lit(0.0)) * 3.6).alias("peak_speed_kmh"), (F.avg("v") * 3.6).alias("avg_velocity_kmh"), F.coalesce(F.sum("_step"), F.lit(0.0)).alias("distance_m"),
        (F.count(F.lit(1)) / fps).alias("duration_s"), F.avg((F.col("poss") == 1).cast("double")).alias("possession_ratio"), F.min_by("poss", "frame").alias("first_poss"),
    ]
    if "ec" in df.columns:
        aggs.append((F.sum(F.greatest("ec", F.lit(0.0)) * F.coalesce("v", F.lit(0.0))) / fps).alias("total_energy_cost_J"))
    aggs += [F.min_by(c, "frame").alias(c) for c in ("pre_run_mean_vel_kmh", "pre_run_peak_vel_kmh", "pre_run_window_s") if c in df.columns]
    out = df.groupBy(*own).agg(*aggs)
    ratio = F.col("possession_ratio")
    return out.withColumns({
        "speed_category": speed_category(F.col("peak_speed_kmh")), "possession": F.when(ratio >= 0.5, "Home").otherwise("Away"),
        "possession_contested": (ratio > contested[0]) & (ratio < contested[1]), "possession_ratio": F.round(ratio, 3),
    })


def total_distance(movements: DataFrame, keys: list[str]) -> DataFrame:
    return movements.groupBy(*keys).agg(F.sum("distance_m").alias("total_distance_m"), F.count(F.lit(1)).alias("n_movements"))


def threshold_runs(df: DataFrame, keys: list[str], v: Column, above: float = 21.0, shortest: int = 25, half_width: int = 2) -> DataFrame:
    """Runs of so many rows or more whose centred mean passes a threshold: start, end, rows, mean and peak."""
    df = df.withColumn("_v", v)
    df = df.withColumn("_mean", F.avg("_v").over(over(keys).rowsBetween(-half_width, half_width))).withColumn("_fast", F.coalesce(F.col("_mean") > above, F.lit(False)))
    runs = islands(df, keys, "_fast", into="_run").where("_fast").groupBy(*keys, "_run")
    out = runs.agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count(F.lit(1)).alias("n_frames"), F.avg("_v").alias("mean_v"), F.max("_v").alias("peak_v"))
    return out.where(F.col("n_frames") >= shortest).drop("_run")


def trailing_mean(df: DataFrame, keys: list[str], v: str, n: int, into: str = "trailing") -> DataFrame:
    """Mean of the last n rows, NULL counting as 0; the first n - 1 rows of a series go."""
    w = over(keys)
    df = df.withColumn(into, F.sum(F.coalesce(v, F.lit(0.0))).over(w.rowsBetween(-(n - 1), 0)) / n)
    return df.withColumn("_i", F.row_number().over(w)).where(F.col("_i") >= n).drop("_i")


def snapshots(frames: DataFrame, keys: list[str]) -> DataFrame:
    """The first, middle and last row of each series, named in a column snapshot; a row may have more than one name."""
    i, n = F.row_number().over(over(keys)) - 1, F.count(F.lit(1)).over(Window.partitionBy(*keys))
    df = frames.withColumns({"_i": i, "_n": n})
    names = F.array_compact(F.array(F.when(F.col("_i") == 0, "start"), F.when(F.col("_i") == F.floor(F.col("_n") / 2), "mid"), F.when(F.col("_i") == F.col("_n") - 1, "end")))
    return df.withColumn("snapshot", F.explode(names)).drop("_i", "_n")


def merged_intervals(df: DataFrame, keys: list[str], pad: int = 0) -> DataFrame:
    """Padded union of intervals: start_frame, end_frame and the gap to the next one (NULL for the last)."""
    df = df.select(*keys, (F.col("start_frame") - pad).alias("s"), (F.col("end_frame") + pad).alias("e"))
    w = over(keys, ["s", "e"])
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_new", F.when(F.col("s") <= reach, 0).otherwise(1)).withColumn("_g", F.sum("_new").over(w))
    out = df.groupBy(*keys, "_g").agg(F.min("s").alias("start_frame"), F.max("e").alias("end_frame"))
    return out.withColumn("gap", F.lead("start_frame").over(over(keys, "start_frame")) - F.col("end_frame")).drop("_g")
