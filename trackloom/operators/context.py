"""Team blocks, lines, roles and zones around the ball."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Formation slots in attack coordinates from 0 to 1, goalkeeper first.
FORMATIONS = {
    "4-4-2": [
        (0.04, 0.50, "GK"), (0.28, 0.20, "FB"), (0.28, 0.40, "CB"), (0.28, 0.60, "CB"), (0.28, 0.80, "FB"),
        (0.55, 0.20, "Winger"), (0.55, 0.40, "CM"), (0.55, 0.60, "CM"), (0.55, 0.80, "Winger"), (0.80, 0.40, "Striker"), (0.80, 0.60, "Striker"),
    ],
    "4-3-3": [
        (0.04, 0.50, "GK"), (0.28, 0.20, "FB"), (0.28, 0.40, "CB"), (0.28, 0.60, "CB"), (0.28, 0.80, "FB"),
        (0.50, 0.25, "CM"), (0.50, 0.50, "DM"), (0.50, 0.75, "CM"), (0.80, 0.20, "Winger"), (0.80, 0.50, "Striker"), (0.80, 0.80, "Winger"),
    ],
    "4-2-3-1": [
        (0.04, 0.50, "GK"), (0.28, 0.20, "FB"), (0.28, 0.40, "CB"), (0.28, 0.60, "CB"), (0.28, 0.80, "FB"),
        (0.45, 0.35, "DM"), (0.45, 0.65, "DM"), (0.65, 0.20, "Winger"), (0.65, 0.50, "CM"), (0.65, 0.80, "Winger"), (0.82, 0.50, "Striker"),
    ],
    "3-5-2": [
        (0.04, 0.50, "GK"), (0.28, 0.25, "CB"), (0.28, 0.50, "CB"), (0.28, 0.75, "CB"),
        (0.50, 0.10, "FB"), (0.50, 0.35, "CM"), (0.50, 0.50, "DM"), (0.50, 0.65, "CM"), (0.50, 0.90, "FB"), (0.80, 0.35, "Striker"), (0.80, 0.65, "Striker"),
    ],
}


def _outfield(players: DataFrame, keeper: str) -> DataFrame:
    """Players with a known place but keepers."""
    return players.where((F.col("position") != keeper) & F.col("x").isNotNull() & F.col("y").isNotNull())


def block_centroid(players: DataFrame, keys: list[str], keeper: str = "TW") -> DataFrame:
    """Mean place and number of each team's outfield players; those without a place don't count."""
    return _outfield(players, keeper).groupBy(*keys, "team").agg(F.avg("x").alias("block_cx"), F.avg("y").alias("block_cy"), F.count(F.lit(1)).alias("n_outfield"))


def defensive_lines(players: DataFrame, keys: list[str], sign: Column, keeper: str = "TW") -> DataFrame:
    """Mean x of the three near-equal groups of outfield players by attack-x; NULL with fewer than three.

    Players without a place take none in the groups.
    """
    out = _outfield(players, keeper).withColumn("_ax", F.col("x") * sign)
    own = Window.partitionBy(*keys, "team")
    out = out.withColumns({"_third": F.ntile(3).over(own.orderBy("_ax", "player_id")), "_n": F.count(F.lit(1)).over(own)})
    lines = [F.avg(F.when((F.col("_third") == i) & (F.col("_n") >= 3), F.col("x"))).alias(f"def_line_{i}") for i in (1, 2, 3)]
    return out.groupBy(*keys, "team").agg(*lines)


def phase_positions(track: DataFrame, keys: list[str], coverage: float = 0.5, players: int = 4) -> DataFrame:
    """Mean position of each player in each phase with enough known rows, in phases with enough such players."""
    got = track.groupBy(*keys, "player_id").agg(F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), (F.count("x") / F.count(F.lit(1))).alias("coverage"))
    got = got.where(F.col("coverage") >= coverage)
    return got.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("_n") >= players).drop("_n")


@lru_cache(maxsize=16)
def _steps(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each number of players placed: (set before, slot taken) of every way to each set of slots of that size.

    Sets are numbered in ascending order among those of their size; a row has the ways to one set, by slot.
    """
    sets = [[m for m in range(1 << n) if m.bit_count() == size] for size in range(n + 1)]
    steps = []
    for size in range(1, n + 1):
        at = {m: k for k, m in enumerate(sets[size - 1])}
        slots = [[s for s in range(n) if m >> s & 1] for m in sets[size]]
        steps.append((np.array([[at[m ^ 1 << s] for s in own] for m, own in zip(sets[size], slots, strict=True)]), np.array(slots)))
    return steps


def assignments(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least sums, slot of each player) of many square cost tables at once, by subsets of slots.

    cost has whole numbers by (group, player, slot), so ties are exact: the last player takes the lowest slot, then the
    one before. A dozen players at most.
    """
    groups, n = cost.shape[:2]
    best, taken = np.zeros((groups, 1), dtype=np.int64), []
    for player, (before, slot) in enumerate(_steps(n)):
        ways = best[:, before] + cost[:, player][:, slot]
        taken.append(ways.argmin(axis=2))
        best = ways.min(axis=2)
    out, at, row = np.zeros((groups, n), dtype=np.int64), np.zeros(groups, dtype=np.int64), np.arange(groups)
    for player in range(n - 1, -1, -1):
        before, slot = _steps(n)[player]
        way = taken[player][row, at]
        out[:, player], at = slot[at, way], before[at, way]
    return best[:, 0], out


#: Distances count in whole billionths, so that every engine adds them alike.
COST_UNIT = 1e9


def _roles(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best formation, and the roles in it, of many groups of equal size; at is (group, player, coordinate)."""
    k = at.shape[1]
    sums, slots = [], []
    for held in FORMATIONS.values():
        d = at[:, :, None, :] - np.array([s[:2] for s in held[:k]])
        total, chosen = assignments(np.rint(np.sqrt(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1]) * COST_UNIT).astype(np.int64))
        sums.append(total)
        slots.append(chosen)
    best = np.argmin(sums, axis=0)
    roles = np.array([[s[2] for s in held] for held in FORMATIONS.values()], dtype=object)
    return np.array(list(FORMATIONS), dtype=object)[best], roles[best[:, None], np.stack(slots)[best, np.arange(len(at))]]


def _solved(keys: list[str], together: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("_players")
            n, flat = np.asarray(pc.list_value_length(held), dtype=np.int64), held.flatten()
            first, group = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
            at = np.stack([np.asarray(pc.fill_null(flat.field(c), 0.0)) for c in ("norm_x", "norm_y")], axis=1)
            known = ~np.asarray(flat.field("unknown"))
            size = np.minimum(11, np.bincount(group[known], minlength=len(n)))
            formation, role = np.full(len(n), None, dtype=object), np.full(len(flat), "unknown", dtype=object)
            for k in np.unique(size[size > 0]):
                rows = np.flatnonzero(size == k)
                for part in np.split(rows, range(together, len(rows), together)):
                    where = first[part][:, None] + np.arange(k)
                    formation[part], role[where] = _roles(at[where])
            out = {c: batch.column(c).take(pa.array(group)) for c in keys} | {"player_id": flat.field("player_id")}
            yield pa.record_batch(out | {"formation": pa.array(formation[group], pa.string()), "role": pa.array(role, pa.string())})

    return run


def assign_roles(positions: DataFrame, keys: list[str], together: int = 256) -> DataFrame:
    """Roles of the players of each group (keys; player_id, norm_x, norm_y) by the formation of least total distance.

    The first as many slots of a formation as there are players take part, eleven at most; players beyond, by id, are
    'unknown', as are those with an unknown coordinate. Ties go to the formation listed first. A group is one phase of
    one team, gathered into one row; groups of one size are solved together.
    """
    player = F.struct(F.isnull(F.col("norm_x") + F.col("norm_y")).alias("unknown"), "player_id", F.col("norm_x").cast("double").alias("norm_x"), F.col("norm_y").cast("double").alias("norm_y"))
    groups = positions.groupBy(*keys).agg(F.array_sort(F.collect_list(player)).alias("_players"))
    kinds = {f.name: f.dataType.simpleString() for f in positions.schema.fields}
    form = ", ".join(f"{c} {kinds[c]}" for c in [*keys, "player_id"]) + ", formation string, role string"
    return groups.mapInArrow(_solved(keys, together), form)


def zone_against_block(points: DataFrame, defenders: DataFrame, keys: list[str], last_line: str = "deepest", centre_y: bool = False) -> DataFrame:
    """Behind, Inside or Wing of each point (keys, player_id, x, y) against the defenders (keys, x, y) of its frame.

    Behind: its attack-x lies past the last line, the defender of largest x ('deepest') or of smallest ('advanced').
    Inside: in the defenders' convex hull, which is so where bearings to them leave no gap above half a turn; centre_y
    tests the point at y = 0. Frames with fewer than three defenders give NULL. x is in attack coordinates.
    """
    line = (F.max if last_line == "deepest" else F.min)("dx")
    d = defenders.select(*keys, F.col("x").alias("dx"), F.col("y").alias("dy"))
    sums = d.groupBy(*keys).agg(line.alias("line"), F.count(F.lit(1)).alias("n_def"))
    both = points.join(d, keys)
    y = F.lit(0.0) if centre_y else F.col("y")
    both = both.withColumn("_b", F.atan2((F.col("dy") - y).cast("double"), (F.col("dx") - F.col("x")).cast("double")))
    own = Window.partitionBy(*keys, "player_id")
    gap = F.coalesce(F.lead("_b").over(own.orderBy("_b")), F.min("_b").over(own) + 2 * math.pi) - F.col("_b")
    gaps = both.withColumn("_gap", gap).groupBy(*keys, "player_id").agg(F.max("_gap").alias("gap"))
    out = points.join(sums, keys, "left").join(gaps, [*keys, "player_id"], "left")
    kind = F.when(F.col("x") > F.col("line"), "Behind").when(F.col("gap") <= math.pi + 1e-9, "Inside").otherwise("Wing")
    return out.withColumn("zone", F.when(F.col("n_def") >= 3, kind)).drop("line", "n_def", "gap")
