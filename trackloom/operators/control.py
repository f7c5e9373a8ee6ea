"""Space control: players' influence over a grid, the teams' surface and its summaries.

A frame's players are gathered into one row, with what its summary needs to know (ball, target player, direction): a shuffle
of players, not of players times grid points. Behind it each frame gives its surface in its own task, as sums over a small
matrix of players by grid points, and is summed up there: thirds and zones are masks over the matrix, and one row a frame
leaves the task, with its players' own means if they are asked for. Only surface() gives out the points themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import influence_radius

#: Pitch in metres, grid points along and across, top speed in m/s, least and most radius, least width.
LENGTH, WIDTH, NX, NY, TOP_SPEED, LEAST_RADIUS, MOST_RADIUS, LEAST_SY = 105.0, 68.0, 51, 45, 13.0, 4.0, 10.0, 0.1
#: Fixed value: ball speed in km/h above which radii don't follow the ball.
FREEZE_KMH = 36.0


def grid(spark: SparkSession, nx: int = NX, ny: int = NY) -> DataFrame:
    """(ix, iy, gx, gy), origin at a corner. Its size is fixed by nx and ny."""
    ids = spark.range(nx * ny)
    ix, iy = F.floor(F.col("id") / ny), F.col("id") % ny
    return ids.select(ix.alias("ix"), iy.alias("iy"), (ix * (LENGTH / (nx - 1))).alias("gx"), (iy * (WIDTH / (ny - 1))).alias("gy"))


def ellipses(players: DataFrame, frozen: Column | None = None) -> DataFrame:
    """Adds each player's influence ellipse: centre (mx, my), axes' direction (ux, uy), half-axes sx, sy and own level q0.

    players: x, y, vx, vy, ball_x, ball_y. A frozen row has the largest radius wherever the ball is.
    """
    norm = F.sqrt((F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")).cast("double"))
    ball = F.sqrt(((F.col("x") - F.col("ball_x")) * (F.col("x") - F.col("ball_x")) + (F.col("y") - F.col("ball_y")) * (F.col("y") - F.col("ball_y"))).cast("double"))
    df = players.withColumns({"_s": norm, "_r": influence_radius(ball, LEAST_RADIUS, MOST_RADIUS)})
    if frozen is not None:
        df = df.withColumn("_r", F.when(frozen, MOST_RADIUS).otherwise(F.col("_r")))
    moves = F.col("_s") >= 1e-6
    df = df.withColumns({"ux": F.when(moves, F.col("vx") / F.col("_s")).otherwise(1.0), "uy": F.when(moves, F.col("vy") / F.col("_s")).otherwise(0.0), "_q": F.col("_s") * F.col("_s") / (TOP_SPEED * TOP_SPEED)})
    df = df.withColumns({"sx": F.col("_r") * (1 + F.col("_q")) / 2, "sy": F.greatest(F.col("_r") * (1 - F.col("_q")) / 2, F.lit(LEAST_SY))})
    shift = F.when(moves, 0.5).otherwise(0.0)
    df = df.withColumns({"mx": F.col("x") + shift * F.col("ux"), "my": F.col("y") + shift * F.col("uy"), "q0": (shift / F.col("sx")) * (shift / F.col("sx"))})
    return df.drop("_s", "_r", "_q")


def influence(gx: Column, gy: Column) -> Column:
    """Of an ellipse row on a grid point, relative to the player's own place."""
    dx, dy = gx - F.col("mx"), gy - F.col("my")
    u, v = (dx * F.col("ux") + dy * F.col("uy")) / F.col("sx"), (dy * F.col("ux") - dx * F.col("uy")) / F.col("sy")
    return F.exp(-0.5 * (u * u + v * v - F.col("q0")))


_ELLIPSE = ("mx", "my", "ux", "uy", "sx", "sy", "q0")
#: What an ellipse is made of, and what of it hangs on the radius.
_PLACES, _FREE = ("x", "y", "vx", "vy", "ball_x", "ball_y"), ("sx", "sy", "q0")


def _grid_arrays(nx: int, ny: int) -> tuple[np.ndarray, ...]:
    ix, iy = np.divmod(np.arange(nx * ny), ny)
    return ix * (LENGTH / (nx - 1)), iy * (WIDTH / (ny - 1))


#: The largest exponent of the product of both distances that powers are multiplied up to, and a least one, whose
#: exponential (1e-304) is no part of any sum's digits; below it exponentials are slow.
MOST_CROSS, LEAST_EXPONENT = 300.0, -700.0


def _influences(held: dict[str, np.ndarray], nx: int, ny: int) -> np.ndarray:
    """influence() of many ellipses on all grid points, as a matrix.

    The exponent is a quadratic form of the distances along and across, which hang on a column or a row of the grid alone;
    that of their product grows evenly along a row. So a row is its first point times powers of one factor, made by
    doubling: exponentials are taken of columns and rows, not of points. Ellipses too thin for that take them of points.
    """
    col = {c: x[:, None] for c, x in held.items()}
    dx, dy = np.arange(nx) * (LENGTH / (nx - 1)) - col["mx"], np.arange(ny) * (WIDTH / (ny - 1)) - col["my"]
    along, across = 1 / (col["sx"] * col["sx"]), 1 / (col["sy"] * col["sy"])
    uu, vv, uv = col["ux"] * col["ux"], col["uy"] * col["uy"], col["ux"] * col["uy"]
    cross, by_col, by_row = (across - along) * uv * dy, -0.5 * (uu * along + vv * across) * dx * dx, 0.5 * (col["q0"] - (vv * along + uu * across) * dy * dy)
    out = np.empty((len(dx), nx, ny))
    with np.errstate(over="ignore", invalid="ignore"):  # of the thin ones, which are made anew
        out[:, 0] = np.exp(np.maximum(by_row + cross * dx[:, :1], LEAST_EXPONENT))
        power, made = np.exp(cross * (LENGTH / (nx - 1))), 1
        while made < nx:
            more = min(made, nx - made)
            np.multiply(out[:, :more], power[:, None, :], out=out[:, made : made + more])
            power, made = power * power, made + more
        out *= np.exp(np.maximum(by_col, LEAST_EXPONENT))[:, :, None]
    thin = ~(np.abs(cross).max(axis=1) * np.abs(dx).max(axis=1) <= MOST_CROSS)
    if thin.any():
        out[thin] = np.exp(cross[thin][:, None, :] * dx[thin][:, :, None] + by_col[thin][:, :, None] + by_row[thin][:, None, :])
    return out.reshape(len(out), nx * ny)


def _kinds(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in names)


#: Fixed value: grid points of the frames that are summed up at a time, so that their matrices stay in a processor's cache.
TOGETHER = 16 * NX * NY


def _frames_of(batch: pa.RecordBatch, nx: int, ny: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of some gathered frames at a time: their rows, who attacks, what attackers and defenders hold at each grid point, and each player.

    What they hold lies in the same memory each time, so it must be used up before the next ones are asked for.
    """
    together = max(1, TOGETHER // (nx * ny))
    players = batch.column("_players")
    n, flat = np.asarray(pc.list_value_length(players), dtype=np.int64), players.flatten()
    held, attacks = {c: np.asarray(flat.field(c)) for c in _ELLIPSE}, np.asarray(flat.field("attacks")).astype(np.int64)
    ends = np.cumsum(n)
    starts, attackers = ends - n, np.diff(np.concatenate([[0], np.cumsum(attacks)])[np.concatenate([[0], ends])])
    splits = ends - attackers  # defenders are gathered before attackers
    both = np.empty((2, together, nx * ny))
    for at in range(0, batch.num_rows, together):
        own = slice(at, at + together)
        low, frames = starts[at], len(ends[own])
        i = _influences({c: x[low : ends[own][-1]] for c, x in held.items()}, nx, ny)
        a, d = both[:, :frames]
        for f, (start, split, end) in enumerate(zip(starts[own] - low, splits[own] - low, ends[own] - low, strict=True)):
            np.add.reduce(i[start:split], axis=0, out=d[f])
            np.add.reduce(i[split:end], axis=0, out=a[f])
        yield batch.slice(at, together), attackers[own], a, d, i


def _share(a: np.ndarray, d: np.ndarray) -> np.ndarray:
    """What attackers hold against defenders, in d's memory."""
    with np.errstate(over="ignore"):
        x = np.exp(np.subtract(d, a, out=d), out=d)
    return np.divide(1.0, np.add(x, 1.0, out=x), out=x)


def _shares(a: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_share() and what either side would hold alone, from one exponential of either, mostly in the memory of both."""
    if not max(a.max(), d.max()) < MOST_CROSS:
        nobody = np.zeros_like(a)
        return _share(a, d.copy()), _share(a, nobody.copy()), _share(d, nobody)
    ea, ed = np.exp(np.negative(a, out=a), out=a), np.exp(np.negative(d, out=d), out=d)
    share = ea + ed
    np.divide(ed, share, out=share)
    return share, np.divide(1.0, np.add(ea, 1.0, out=ea), out=ea), np.divide(1.0, np.add(ed, 1.0, out=ed), out=ed)


def _surfaces(keys: list[str], nx: int, ny: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, a, d, _ in _frames_of(batch, nx, ny):
                frames = len(part)
                out = {c: part.column(c).take(pa.array(np.repeat(np.arange(frames), nx * ny))) for c in keys}
                out["point"] = pa.array(np.tile(np.arange(nx * ny, dtype=np.int32), frames))
                yield pa.record_batch(out | {c: pa.array(x.flatten()) for c, x in zip(("pc", "pc_att_only", "pc_def_only"), _shares(a, d), strict=True)})

    return run


def _gathered(players: DataFrame, keys: list[str], attacking: Column, frozen: Column | None, held: list[Column] = (), rows: list[Column] = ()) -> DataFrame:
    """(keys, held aggregates, _players): a row for each frame that has a player with known place and velocity, defenders first.

    With rows, each player has them in a struct shown, which is NULL if player_influence() has no row of it, and in free the
    half-axes and level that it has there, where a frozen radius gives it others.
    """
    players = players.withColumn("attacks", F.coalesce(attacking, F.lit(False)))
    shown = []
    if rows:
        places = [F.col(c).cast("double") for c in _PLACES]
        told = reduce(Column.__and__, [c.isNotNull() & ~F.isnan(c) for c in places])
        shown = [F.when(told, F.struct(*rows)).alias("shown")]
        if frozen is not None:
            free = [F.col(c).cast("double").alias(c) for c in _FREE]
            players = ellipses(players).withColumn("_free", F.when(frozen, F.struct(*free))).drop(*_ELLIPSE)
            shown.append(F.col("_free").alias("free"))
    own = ellipses(players, frozen)
    known = F.array_size(F.array_compact(F.array(*[F.col(c).cast("double") for c in _ELLIPSE]))) == len(_ELLIPSE)
    one = F.when(known, F.struct("attacks", *[F.col(c).cast("double").alias(c) for c in _ELLIPSE], *shown))
    return own.groupBy(*keys).agg(*held, F.sort_array(F.collect_list(one)).alias("_players")).where(F.size("_players") > 0)


def _places(nx: int, ny: int) -> list[Column]:
    ix, iy = F.floor(F.col("point") / ny), (F.col("point") % ny).cast("long")
    return [ix.alias("ix"), iy.alias("iy"), (ix * (LENGTH / (nx - 1))).alias("gx"), (iy * (WIDTH / (ny - 1))).alias("gy")]


def surface(players: DataFrame, keys: list[str], attacking: Column, frozen: Column | None = None, nx: int = NX, ny: int = NY) -> DataFrame:
    """(keys, ix, iy, gx, gy, pc, pc_att_only, pc_def_only): control of each grid point by the attacking side.

    pc_att_only and pc_def_only are what either side would hold alone. Players with an unknown place or velocity don't
    count, nor do frames without others; an unknown attacking is the defending side.
    """
    form = f"{_kinds(players, keys)}, point int, pc double, pc_att_only double, pc_def_only double"
    return _gathered(players, keys, attacking, frozen).mapInArrow(_surfaces(keys, nx, ny), form).select(*keys, *_places(nx, ny), "pc", "pc_att_only", "pc_def_only")


def _point_sums(nx: int, ny: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, alone = 0, np.zeros(nx * ny), np.zeros(nx * ny)
        least, most = np.full(nx * ny, np.inf), np.full(nx * ny, -np.inf)
        for batch in batches:
            for part, _, a, d, _ in _frames_of(batch, nx, ny):
                share, own, _ = _shares(a, d)
                n += len(part)
                total += share.sum(axis=0)
                alone += own.sum(axis=0)
                least, most = np.minimum(least, share.min(axis=0)), np.maximum(most, share.max(axis=0))
        if n:
            cols = {"point": np.arange(nx * ny, dtype=np.int32), "n": np.full(nx * ny, n), "total": total, "alone": alone, "least": least, "most": most}
            yield pa.record_batch({c: pa.array(x) for c, x in cols.items()})

    return run


def mean_surface(players: DataFrame, keys: list[str], attacking: Column, frozen: Column | None = None, nx: int = NX, ny: int = NY) -> DataFrame:
    """(ix, iy, gx, gy, n_frames, mean_pc, mean_att_only, least_pc, most_pc) over all frames; a task sums up its frames first."""
    form = "point int, n long, total double, alone double, least double, most double"
    sums = _gathered(players, keys, attacking, frozen).mapInArrow(_point_sums(nx, ny), form).groupBy("point")
    out = sums.agg(F.sum("n").alias("n_frames"), F.sum("total").alias("_t"), F.sum("alone").alias("_a"), F.min("least").alias("least_pc"), F.max("most").alias("most_pc"))
    return out.select(*_places(nx, ny), "n_frames", (F.col("_t") / F.col("n_frames")).alias("mean_pc"), (F.col("_a") / F.col("n_frames")).alias("mean_att_only"), "least_pc", "most_pc")


def _player_rows(players: pa.ListArray, means: np.ndarray, most: np.ndarray, nx: int, ny: int, together: int = 32) -> pa.ListArray:
    """What the players of each frame show, with their mean and largest influence; NULL for those that show nothing."""
    flat = players.flatten()
    shown = flat.field("shown")
    kind = players.type.value_type
    if kind.get_field_index("free") >= 0:
        free = flat.field("free")
        other = np.flatnonzero(np.asarray(free.is_valid()))
        for at in range(0, len(other), together):
            own = other[at : at + together]
            i = _influences({c: np.asarray(flat.field(c))[own] for c in _ELLIPSE} | {c: np.asarray(free.field(c).fill_null(np.nan))[own] for c in _FREE}, nx, ny)
            means[own], most[own] = i.sum(axis=1) / (nx * ny), i.max(axis=1)
    unknown = ~np.asarray(shown.is_valid()) | np.isnan(np.column_stack([np.asarray(flat.field(c)) for c in _ELLIPSE])).any(axis=1)
    fields = {f.name: shown.field(f.name) for f in shown.type} | {"mean_influence": pa.array(means, mask=unknown), "max_influence": pa.array(most, mask=unknown)}
    ends = np.cumsum(np.asarray(pc.list_value_length(players), dtype=np.int32), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([np.zeros(1, np.int32), ends])), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def _summaries(kept: list[str], zones: dict[str, float], alone: bool, nx: int, ny: int, rows: bool = False):
    shares = ["pc_att_team", "pc_def_third", "pc_mid_third", "pc_att_third", *(["mean_pc_att_only", "mean_pc_def_only"] if alone else [])]
    names = [*shares, "n_att_players", "n_def_players", *[f"{n}_{what}" for n in zones for what in ("pc", "points")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gx, gy = np.arange(nx) * (LENGTH / (nx - 1)), np.arange(ny) * (WIDTH / (ny - 1))
        thirds = (np.arange(nx) * 3 // nx)[:, None] == np.arange(3)
        thirds = [(t, max(1, t.sum() * ny)) for t in thirds.T]
        for batch in batches:
            made, means, most = [], [], []
            for part, attackers, a, d, i in _frames_of(batch, nx, ny):
                if rows:
                    means.append(i.sum(axis=1) / (nx * ny))
                    most.append(i.max(axis=1))
                share, *single = _shares(a, d) if alone else (_share(a, d),)
                columns = share.reshape(-1, nx, ny).sum(axis=2)
                by_third = np.stack([columns[:, t].sum(axis=1) / points for t, points in thirds], axis=1)
                turned = np.asarray(part.column("_mirrored"))
                by_third[turned] = by_third[turned][:, ::-1]
                out = {"pc_att_team": columns.sum(axis=1) / (nx * ny), **{f"pc_{n}_third": by_third[:, i] for i, n in enumerate(("def", "mid", "att"))}}
                out |= {f"mean_pc_{n}_only": x.mean(axis=1) for n, x in zip(("att", "def"), single, strict=False)}
                out["n_att_players"] = attackers
                for name, radius in zones.items():
                    cx, cy = (np.asarray(part.column(f"_{name}_{c}").fill_null(np.nan), dtype=float)[:, None] for c in "xy")
                    near = np.flatnonzero(((gx - cx) * (gx - cx))[:, :, None] + ((gy - cy) * (gy - cy))[:, None, :] <= radius * radius)
                    frame = near // (nx * ny)
                    out[f"{name}_points"] = points = np.bincount(frame, minlength=len(share))
                    out[f"{name}_pc"] = np.bincount(frame, share.reshape(-1)[near], len(share)) / np.maximum(1, points)
                made.append(out)
            if made:
                out = {c: np.concatenate([m[c] for m in made]) for c in made[0]}
                out["n_def_players"] = np.asarray(pc.list_value_length(batch.column("_players")), dtype=np.int64) - out["n_att_players"]
                for name in zones:
                    out[f"{name}_pc"] = pa.array(out[f"{name}_pc"], mask=out[f"{name}_points"] == 0)
                single = {"rows": _player_rows(batch.column("_players"), np.concatenate(means), np.concatenate(most), nx, ny)} if rows else {}
                yield pa.record_batch({c: batch.column(c) for c in kept} | {c: out[c] if isinstance(out[c], pa.Array) else pa.array(out[c]) for c in names} | single)

    return run


def frame_control(players: DataFrame, keys: list[str], attacking: Column, frozen: Column | None = None, mirrored: Column | None = None, zones: dict[str, tuple[Column, Column, float]] | None = None, held: list[Column] = (), alone: bool = True, nx: int = NX, ny: int = NY, rows: list[Column] = ()) -> DataFrame:
    """One row for each frame that surface() has points of, summed up where its surface is made.

    pc_att_team and pc_def_team, and controlling (attack or defence, who holds more); pc_def_third, pc_mid_third and
    pc_att_third over grid columns, turned where mirrored; mean_pc_att_only and mean_pc_def_only; n_att_players and
    n_def_players. zones: by name, the aggregates that give a frame's centre, and a radius; they add name_pc, the mean share
    of the attackers there, and name_points (NULL and 0 where there is no centre or no point). held: further aggregates of a
    frame's players, which are kept under their names. alone=False leaves mean_pc_att_only and mean_pc_def_only out.
    rows: columns of players; they add rows, an array of each player's with the mean_influence and max_influence that
    player_influence() has of it, which are NULL where it has no row.
    """
    zones = zones or {}
    centres = [c.cast("double").alias(f"_{name}_{axis}") for name, (x, y, _) in zones.items() for c, axis in ((x, "x"), (y, "y"))]
    turned = F.coalesce(F.lit(False) if mirrored is None else mirrored, F.lit(False))
    frames = _gathered(players.withColumn("_turned", turned), keys, attacking, frozen, [*held, F.bool_or("_turned").alias("_mirrored"), *centres], rows)
    kept = [c for c in frames.columns if not c.startswith("_")]
    shares = ["pc_att_team", "pc_def_third", "pc_mid_third", "pc_att_third", *(["mean_pc_att_only", "mean_pc_def_only"] if alone else [])]
    form = [_kinds(frames, kept), *[f"{c} double" for c in shares], "n_att_players long, n_def_players long", *[f"{n}_pc double, {n}_points long" for n in zones]]
    if rows:
        shown = frames.schema["_players"].dataType.elementType["shown"].dataType
        form.append(f"rows array<struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in shown)}, mean_influence: double, max_influence: double>>")
    out = frames.mapInArrow(_summaries(kept, {n: z[2] for n, z in zones.items()}, alone, nx, ny, bool(rows)), ", ".join(form))
    return out.withColumns({"pc_def_team": 1 - F.col("pc_att_team"), "controlling": F.when(F.col("pc_att_team") >= 0.5, "attack").otherwise("defence")})


def by_side(df: DataFrame, home_attacks: Column, names: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds {name}_home and {name}_away for shares of the attackers and of the others, given as name: (attackers', others')."""
    new = {}
    for name, (att, other) in names.items():
        new |= {f"{name}_home": F.when(home_attacks, F.col(att)).otherwise(other), f"{name}_away": F.when(home_attacks, other).otherwise(F.col(att))}
    return df.withColumns(new)


#: Ellipses whose mean and largest influence a task remembers.
MOST_KNOWN = 100_000


def _reaches(keep: list[str], nx: int, ny: int, together: int = 32):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for batch in batches:
            held = np.column_stack([np.asarray(batch.column(c)) for c in _ELLIPSE])
            finite = ~np.isnan(held).any(axis=1)  # an infinite speed has no direction
            batch, held = batch.filter(pa.array(finite)), held[finite]
            rows = held.view(f"V{held.itemsize * len(_ELLIPSE)}").ravel().tolist()
            known = known if len(known) < MOST_KNOWN else {}
            new = list({x: None for x in rows if x not in known})
            fresh = np.frombuffer(b"".join(new)).reshape(-1, len(_ELLIPSE))
            for at in range(0, len(new), together):
                i = _influences(dict(zip(_ELLIPSE, fresh[at : at + together].T, strict=True)), nx, ny)
                known.update(zip(new[at : at + together], zip((i.sum(axis=1) / (nx * ny)).tolist(), i.max(axis=1).tolist(), strict=True), strict=True))
            means, most = np.array([known[x] for x in rows]).reshape(-1, 2).T
            yield pa.record_batch({c: batch.column(c) for c in keep} | {"mean_influence": pa.array(means), "max_influence": pa.array(most)})

    return run


def player_influence(players: DataFrame, keys: list[str], nx: int = NX, ny: int = NY, held: list[Column] = ()) -> DataFrame:
    """Mean and largest influence of each player in each frame; the surface's radius freeze doesn't apply here.

    A row for each row of players with known place and velocity, with the columns held under their names; nothing is
    shuffled. An ellipse meets the grid once while its task remembers it.
    """
    # the filter asks for what an ellipse is made of: one on the ellipse would be pushed down with all its formulas, many times over
    own = ellipses(players.dropna(subset=list(_PLACES)))
    own = own.select(*keys, "player_id", *held, *[F.col(c).cast("double").alias(f"_{c}") for c in _ELLIPSE])
    keep = own.columns[: -len(_ELLIPSE)]
    return own.withColumnsRenamed({f"_{c}": c for c in _ELLIPSE}).mapInArrow(_reaches(keep, nx, ny), f"{_kinds(own, keep)}, mean_influence double, max_influence double")


def _weighted_sums(nx: int, ny: int, together: int = 16):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, known, total = 0, 0, np.zeros(nx * ny)
        for batch in batches:
            rows = np.asarray(batch.column("_rows"))
            n += int(rows.sum())
            batch = batch.filter(batch.column("_known"))
            for at in range(0, batch.num_rows, together):
                part = batch.slice(at, together)
                weight = np.asarray(part.column("_rows"))
                known += int(weight.sum())
                total += (_influences({c: np.asarray(part.column(c)) for c in _ELLIPSE}, nx, ny) * weight[:, None]).sum(axis=0)
        if n:
            yield pa.record_batch({"point": pa.array(np.arange(nx * ny, dtype=np.int32)), "n": pa.array(np.full(nx * ny, n)), "known": pa.array(np.full(nx * ny, known)), "total": pa.array(total)})

    return run


def mean_influence(players: DataFrame, nx: int = NX, ny: int = NY) -> DataFrame:
    """(ix, iy, gx, gy, n, mean_influence) of each grid point over all rows of players; rows without a known ellipse only count in n.

    Players of the same ellipse hold the same everywhere: they are counted first, and each ellipse meets the grid once, in a
    matrix that is summed up in its task. No row of a player and a point is made.
    """
    own = ellipses(players).select(*[F.col(c).cast("double").alias(c) for c in _ELLIPSE])
    known = F.array_size(F.array_compact(F.array(*_ELLIPSE))) == len(_ELLIPSE)
    own = own.groupBy(*_ELLIPSE).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_known", known)
    sums = own.mapInArrow(_weighted_sums(nx, ny), "point int, n long, known long, total double").groupBy("point").agg(*[F.sum(c).alias(c) for c in ("n", "known", "total")])
    return sums.select(*_places(nx, ny), "n", F.try_divide("total", "known").alias("mean_influence"))


def influence_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Frames, mean and largest influence and speed by player, the strongest first."""
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_frames"), F.avg("mean_influence").alias("mean_influence"), F.max("max_influence").alias("max_influence"), F.avg("speed_ms").alias("mean_speed"), F.max("speed_ms").alias("max_speed"))
    return out.orderBy(F.col("mean_influence").desc(), *by)
