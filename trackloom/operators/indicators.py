"""Kinematics of annotated intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .predicates import attack_sign, direction_metric, speed_category, zone
from .series import cost, spread

_DOUBLES = ["distance", "mean", "peak", "energy", "pre_mean", "pre_peak", "ratio", "x_mid", "y_mid"]
_PLACES = ["x_start", "x_end", "y_start", "y_end"]


def interval_ids(keys: list[str], half: list[str]) -> list[str]:
    """What names an annotated interval: its id, which may restart for each player and half, with both."""
    return [*dict.fromkeys([*keys, *half]), "segment_id"]


def _numbers(c: pa.Array, none: float = 0.0) -> np.ndarray:
    return c.cast(pa.float64(), safe=False).fill_null(none).to_numpy(zero_copy_only=False)


def _first(of: np.ndarray) -> np.ndarray:
    """Where each interval's rows begin; of, the interval of each row, ascends."""
    return np.flatnonzero(np.diff(of, prepend=-1))


def _tops(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out, at = np.full(n, -np.inf), _first(of)
    if len(at):
        out[of[at]] = np.maximum.reduceat(values, at)
    return out


def _sums(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Added up in the order of rows."""
    return np.bincount(of, values, n).astype(float)


def _mean(of: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Means, and where there is none."""
    count = np.bincount(of, minlength=n)
    return _sums(of, values, n) / np.maximum(count, 1), count == 0


def _energy(of: np.ndarray, v: np.ndarray, n: int, fps: int) -> np.ndarray:
    """Costs of the slopes that equal each row's acceleration, by central differences within the interval."""
    dt, first = 1.0 / fps, np.diff(of, prepend=-1) != 0
    last = np.roll(first, -1)
    ahead, back = np.roll(v, -1), np.roll(v, 1)
    accel = np.where(first, (ahead - v) / dt, np.where(last, (v - back) / dt, (ahead - back) / (2 * dt)))
    slope = np.maximum(np.fmin(np.where(first & last, 0.0, accel) / 9.81, 0.5), -0.5)
    return _sums(of, np.maximum(cost(slope), 0.0) * v, n) / fps


def _medians(at: np.ndarray, n: np.ndarray, of: np.ndarray, values: np.ndarray) -> np.ndarray:
    values = values[np.lexsort((values, of))]
    return 0.5 * values[at + (n - 1) // 2] + 0.5 * values[at + n // 2]


def _measured(batch: pa.RecordBatch, names: list[str], fps: int) -> pa.RecordBatch:
    """A row for each interval of two known places and more, of whole intervals in their order."""
    first, pieces = batch.column("_piece").to_numpy() == 1, batch.column("_rows")
    start, sizes = np.flatnonzero(first), pc.list_value_length(pieces).to_numpy()
    n, of, lo = len(start), np.repeat(np.cumsum(first) - 1, sizes), np.repeat(batch.column("_lo").to_numpy(), sizes)
    spots = pieces.flatten()
    at = pc.struct_field(spots, "frame").to_numpy()
    if ((np.diff(at) < 0) & (np.diff(of) == 0)).any():  # an id that repeats
        order = np.lexsort((at, of))
        spots, at, lo = spots.take(pa.array(order)), at[order], lo[order]
    frame, x, y, v, home = spots.flatten()
    run = at >= lo
    places = [x.is_valid().to_numpy(zero_copy_only=False), y.is_valid().to_numpy(zero_copy_only=False)]
    rows, sure = np.flatnonzero(run), v.is_valid().to_numpy(zero_copy_only=False)
    speed, told = _numbers(v), home.is_valid().to_numpy(zero_copy_only=False)

    own, pre = run & sure, ~run & sure
    mean, still = _mean(of[own], speed[own], n)
    pre_mean, no_pre = _mean(of[pre], speed[pre], n)
    ratio, untold = _mean(of[run & told], _numbers(home)[run & told], n)
    fastest = _numbers(v, -1.0)[rows]
    top = _tops(of[rows], fastest, n)[of[rows]]
    hits = rows[(fastest == top) | (np.isnan(fastest) & np.isnan(top))]
    at_peak = np.zeros(n, dtype=np.int64)
    at_peak[of[hits][_first(of[hits])]] = hits[_first(of[hits])]

    known = np.flatnonzero(run & places[0] & places[1])
    mine, px, py = of[known], _numbers(x)[known], _numbers(y)[known]
    same, steps = mine[1:] == mine[:-1], np.sqrt(np.diff(px) * np.diff(px) + np.diff(py) * np.diff(py))
    distance = _sums(mine[1:][same], steps[same], n)
    at = _first(mine)
    count = np.diff(at, append=len(mine))
    many = count >= 2
    keep, begin, end = mine[at[many]], known[at[many]], known[(at + count - 1)[many]]

    out = {c: batch.column(c).take(pa.array(start[keep])) for c in names[: names.index("n_points")]}
    out |= {"n_points": pa.array(count[many].astype(np.int64)), "peak_frame": frame.take(pa.array(at_peak[keep]))}
    peak, pre_peak = (np.where(e, 0.0, _tops(of[m], speed[m], n)) for m, e in ((own, still), (pre, no_pre)))
    energy = _energy(of[rows], speed[rows], n, fps)
    for name, value, none in (("distance", distance, None), ("mean", mean, still), ("peak", peak, None), ("energy", energy, None), ("pre_mean", pre_mean, no_pre), ("pre_peak", pre_peak, no_pre), ("ratio", ratio, untold)):
        out[f"_{name}"] = pa.array(value[keep], mask=None if none is None else none[keep])
    for c, column, p in (("x", x, px), ("y", y, py)):
        out |= {f"_{c}_start": column.take(pa.array(begin)), f"_{c}_end": column.take(pa.array(end)), f"_{c}_mid": pa.array(_medians(at, count, mine, p)[many])}
    return pa.RecordBatch.from_arrays([out[c] for c in names], names=names)


def _summed(names: list[str], fps: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            begins = np.flatnonzero(batch.column("_piece").to_numpy() == 1)
            if len(begins):
                whole = pa.Table.from_batches([*held, batch.slice(0, begins[-1])]).combine_chunks().to_batches()
                with np.errstate(all="ignore"):
                    yield from (_measured(b, names, fps) for b in whole if b.num_rows)
                held = [batch.slice(begins[-1])]
            elif batch.num_rows:
                held.append(batch)
        if held:
            with np.errstate(all="ignore"):
                yield from (_measured(b, names, fps) for b in pa.Table.from_batches(held).combine_chunks().to_batches())

    return run


def interval_indicators(annotations: DataFrame, track: DataFrame, keys: list[str], half: list[str], before_s: float = 2.0, fps: int = 25, bucket: int = 64, parts: int | None = None, ends: DataFrame | None = None) -> DataFrame:
    """The measures of a movement, by keys, half and segment_id, over the rows of track within each annotated interval, both ends in.

    annotations: segment_id, keys, half, start_frame, end_frame, play_direction (may be NULL: no mirroring, sign 1);
    track: keys, half, frame, x, y, v, poss. Intervals are clamped to their half, which ends with its last frame in
    track; ends (half, last_frame) names these where they are known. Those of no length or with fewer than two known places
    give no row; a run's energy comes from its own frames. Speeds are in m/s; pre_run columns are of the before_s seconds
    before the start.

    A series meets its annotations in blocks of bucket frames, a row each, by keys and half alone: a block is tested against
    an annotation's ends, and no row is made of a frame of an interval. With parts, annotations are dealt by keys and half
    to so many tasks; where track lies so already, it is not shuffled, and neither is what the join gives.
    """
    n_before, ids = round(before_s * fps), interval_ids(keys, half)
    on = ids[:-1]
    ends = track.groupBy(*half).agg(F.max("frame").alias("last_frame")) if ends is None else ends
    lo, hi = (F.greatest(F.lit(0), F.least(F.col(c), F.col("_end"))) for c in ("start_frame", "end_frame"))
    a = annotations.join(F.broadcast(ends.select(*half, F.col("last_frame").alias("_end"))), half)
    a = a.select(*ids, lo.alias("_lo"), hi.alias("_hi"), F.col("play_direction").alias("_dir")).where("_lo < _hi").withColumn("_from", F.greatest(F.col("_lo") - n_before, F.lit(0)))
    spot = F.struct("frame", "x", "y", F.col("v").cast("double").alias("v"), (F.col("poss") == 1).alias("home"))
    track = track.repartition(*on) if parts is None else track
    blocks = track.groupBy(*on, F.floor(F.col("frame") / bucket).alias("_bucket")).agg(F.sort_array(F.collect_list(spot)).alias("_rows"))
    met = spread(a, parts, *on).join(blocks, on).where(F.col("_bucket").between(F.floor(F.col("_from") / bucket), F.floor(F.col("_hi") / bucket)))
    met = met.withColumn("_rows", F.filter("_rows", lambda r: r["frame"].between(F.col("_from"), F.col("_hi"))))
    by = Window.partitionBy(*ids).orderBy("_bucket")
    met = met.withColumn("_piece", F.row_number().over(by)).sortWithinPartitions(*ids, "_bucket")
    place = {c: F.get("_rows", F.lit(0))[c[0]] for c in _PLACES}
    form = met.select(*ids, "_lo", "_hi", "_dir", F.lit(None).cast("long").alias("n_points"), F.get("_rows", F.lit(0))["frame"].alias("peak_frame"), *[F.lit(None).cast("double").alias(f"_{c}") for c in _DOUBLES], *[p.alias(f"_{c}") for c, p in place.items()]).schema
    out = met.select(*ids, "_lo", "_hi", "_dir", "_rows", "_piece").mapInArrow(_summed(form.names, fps), form)
    ratio, sign = F.col("_ratio"), attack_sign(F.col("_dir"))
    zones = {at: zone(F.col(f"_x_{at}"), F.col(f"_y_{at}"), F.col("_dir")) for at in ("start", "mid", "end")}
    return out.select(
        *ids, "n_points", F.round("_distance", 2).alias("distance_m"), F.round((F.col("_hi") - F.col("_lo")) / fps, 2).alias("duration_s"), F.round("_mean", 3).alias("mean_vel_ms"), F.round("_peak", 3).alias("peak_vel_ms"), "peak_frame",
        speed_category(F.col("_peak") * 3.6).alias("speed_category"), F.round("_energy", 2).alias("total_energy_cost_J"), F.round("_pre_mean", 3).alias("pre_run_mean_vel_ms"), F.round("_pre_peak", 3).alias("pre_run_peak_vel_ms"),
        F.when(F.col("_lo") > 0, F.round(F.least(F.col("_lo"), F.lit(n_before)) / fps, 2)).alias("pre_run_window_s"),
        *[F.round(f"_{c}_{at}", 2).alias(f"{c}_{at}") for c in "xy" for at in zones],
        *[c for at, (third, lane) in zones.items() for c in (F.concat(third, lane).alias(f"zone_{at}"), third.alias(f"third_{at}"), lane.alias(f"lane_{at}"))],
        F.round(direction_metric(F.col("_x_end") - F.col("_x_start"), F.col("_y_end") - F.col("_y_start"), sign), 4).alias("direction"), sign.alias("attack_sign"),
        F.when(ratio >= 0.5, "Home").when(ratio.isNotNull(), "Away").alias("possession"), F.round(ratio, 3).alias("possession_ratio"), ((ratio > 0.3) & (ratio < 0.7)).alias("possession_contested"),
    )
