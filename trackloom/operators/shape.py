"""Shapes of movements: resampling by arc length, straightness, classes and counts of straight pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import attack_angle, straightness


def resample(df: DataFrame, keys: list[str], points: int = 50, held: tuple[str, ...] = ()) -> DataFrame:
    """(keys, point, rx, ry): at most so many points at equal steps of arc length; a path without length stays as it is.

    Points hold further columns under their names: those of the row that they follow.
    """
    w = Window.partitionBy(*keys).orderBy("frame")
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    df = df.select(*keys, "frame", "x", "y", *held, F.coalesce(F.sqrt((dx * dx + dy * dy).cast("double")), F.lit(0.0)).alias("_d"))
    whole = Window.partitionBy(*keys)
    df = df.withColumn("_arc", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumns({"_total": F.sum("_d").over(whole), "_n": F.count(F.lit(1)).over(whole), "_i": F.row_number().over(w) - 1})
    m = F.least(F.col("_n"), F.lit(points))
    df = df.withColumns({"_m": m, "_x2": F.lead("x").over(w), "_y2": F.lead("y").over(w), "_arc2": F.lead("_arc").over(w), "_last": F.col("_i") == F.col("_n") - 1})
    step = F.col("_total") / (F.col("_m") - 1)
    lo = F.ceil(F.col("_arc") / step - 1e-9)
    hi = F.when(F.col("_last"), F.col("_m") - 1).otherwise(F.ceil(F.col("_arc2") / step - 1e-9) - 1)
    ks = F.when(F.col("_total") < 1e-6, F.array(F.col("_i").cast("long"))).when(lo <= hi, F.sequence(lo.cast("long"), hi.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    out = df.withColumn("point", F.explode(ks))
    part = F.when((F.col("_total") < 1e-6) | F.col("_last") | (F.col("_arc2") <= F.col("_arc")), 0.0).otherwise((F.col("point") * step - F.col("_arc")) / (F.col("_arc2") - F.col("_arc")))
    return out.select(*keys, *held, "point", (F.col("x") + part * F.coalesce(F.col("_x2") - F.col("x"), F.lit(0))).alias("rx"), (F.col("y") + part * F.coalesce(F.col("_y2") - F.col("y"), F.lit(0))).alias("ry"))


def trajectories(movements: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, shape_method, point, x, y): each movement's stored path, or else the three points of its summary.

    movements: keys, x_start, y_start, x_mid, y_mid, x_end, y_end; stored: keys, frame, x, y. shape_method tells which.
    """
    w = Window.partitionBy(*keys).orderBy("frame")
    own = stored.join(movements.select(keys), keys, "left_semi").select(*keys, F.lit("trajectory").alias("shape_method"), (F.row_number().over(w) - 1).cast("long").alias("point"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    points = F.array(*[F.struct(*[F.col(f"{c}_{at}").cast("double").alias(c) for c in "xy"]) for at in ("start", "mid", "end")])
    rest = movements.join(stored.select(keys).distinct(), keys, "left_anti").select(*keys, F.lit("summary").alias("shape_method"), F.posexplode(points).alias("point", "p"))
    return own.unionByName(rest.select(*keys, "shape_method", F.col("point").cast("long").alias("point"), "p.x", "p.y"))


def _rms(s: Column) -> Column:
    n = s["n"].cast("double")
    a, c = s["xx"] / n - s["x"] / n * s["x"] / n, s["yy"] / n - s["y"] / n * s["y"] / n
    b = s["xy"] / n - s["x"] / n * s["y"] / n
    return F.sqrt(F.greatest((a + c) / 2 - F.sqrt(((a - c) / 2) * ((a - c) / 2) + b * b), F.lit(0.0)))


def straight_pieces(points: Column, threshold: float) -> Column:
    """How many straight pieces a path (an ordered array of x, y structs) takes; moments are carried, not fitted anew."""
    zero = F.lit(0.0)
    n = F.size(points)
    least = F.greatest(F.lit(4), F.floor(n / 10).cast("int"))
    start = F.struct(F.lit(0).alias("i"), F.lit(1).alias("pieces"), F.lit(0).alias("n"), *[zero.alias(c) for c in ("x", "y", "xx", "yy", "xy")])

    def add(s: Column, p: Column) -> Column:
        grown = F.struct((s["i"] + 1).alias("i"), s["pieces"].alias("pieces"), (s["n"] + 1).alias("n"), (s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y"), (s["xx"] + p["x"] * p["x"]).alias("xx"), (s["yy"] + p["y"] * p["y"]).alias("yy"), (s["xy"] + p["x"] * p["y"]).alias("xy"))
        alone = F.struct((s["i"] + 1).alias("i"), (s["pieces"] + 1).alias("pieces"), F.lit(1).alias("n"), p["x"].alias("x"), p["y"].alias("y"), (p["x"] * p["x"]).alias("xx"), (p["y"] * p["y"]).alias("yy"), (p["x"] * p["y"]).alias("xy"))
        return F.transform(F.array(grown), lambda g: F.when((s["i"] >= least) & (_rms(g) > threshold), alone).otherwise(g))[0]

    return F.when(n < 4, 1).otherwise(F.aggregate(points, start, add)["pieces"])


def classify(df: DataFrame, keys: list[str], sign: Column | None = None, threshold: float = 0.35, diagonal: float = 22.5, shortest: int = 5, points: int = 50) -> DataFrame:
    """(keys, shape, linearity_rmse, angle_deg, n_segments): straight, diagonal, curvilinear, or unknown if too short.

    A path's points hold its length and ends, so nothing is joined, and no path leaves the task that makes it.
    """
    w = Window.partitionBy(*keys).orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = {"n": F.count(F.lit(1)).over(w), "dx": F.last("x").over(w) - F.first("x").over(w), "dy": F.last("y").over(w) - F.first("y").over(w)}
    out = resample(df.withColumns(ends), keys, points, tuple(ends)).groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ends], straightness("rx", "ry").alias("rms"), F.array_sort(F.collect_list(F.struct("point", F.col("rx").alias("x"), F.col("ry").alias("y")))).alias("path")
    )
    out = out.withColumn("angle", attack_angle(F.col("dx"), F.col("dy")))
    known, line = F.col("n") >= shortest, F.col("rms") <= threshold
    shape = F.when(~known, "unknown").when(line, F.when(F.col("angle") <= diagonal, "straight").otherwise("diagonal")).otherwise("curvilinear")
    return out.select(
        *keys, shape.alias("shape"), F.when(known, F.bround("rms", 4)).alias("linearity_rmse"), F.when(known, F.bround("angle", 2)).alias("angle_deg"),
        F.when(known, F.when(line, 1).otherwise(straight_pieces(F.col("path"), threshold))).cast("long").alias("n_segments"),
    )
