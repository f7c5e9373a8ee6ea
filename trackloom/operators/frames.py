"""Frames and their rows: ranges, assembly with rosters and the ball, and small tables over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def between_frames(df: DataFrame, start: int, end: int) -> DataFrame:
    """The rows of frames start to end, both in; the bounds reach the scan where frame is a stored column."""
    return df.where(F.col("frame").between(start, end))


def frame_bounds(df: DataFrame, keys: list[str]) -> DataFrame:
    """First and last frame of each key; 0 where no frame is known."""
    return df.groupBy(*keys).agg(F.coalesce(F.min("frame"), F.lit(0)).alias("first_frame"), F.coalesce(F.max("frame"), F.lit(0)).alias("last_frame"))


def with_roster(track: DataFrame, people: DataFrame, player: str = "player_id", xid: str = "xid") -> DataFrame:
    """track with its players' roster columns; players that aren't in the roster go."""
    return track.join(people.withColumnRenamed(xid, player), player)


def assemble_frames(players: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """Players with the state of their frame (ball, possession); frames without one are left out."""
    return players.join(states, keys)


def with_phase_attributes(track: DataFrame, phases: DataFrame, keys: list[str]) -> DataFrame:
    """Attributes of each row's phase; phase_id is carried by track, so no interval is looked up."""
    return track.join(phases, [*keys, "phase_id"])


def stacked(*tables: DataFrame) -> DataFrame:
    """All rows of all tables by column name; columns that a table lacks are NULL there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def side_by_side(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both tables by key, NULL where one of them has none."""
    return left.join(right, keys, "full")


def counts_by(df: DataFrame, rows: list[str], column: str, values: list[str]) -> DataFrame:
    """How many rows of each kind there are, a column for each named value and 0 where there is none."""
    return df.groupBy(*rows).pivot(column, values).count().fillna(0, values)


def compare_segments(methods: dict[str, DataFrame], keys: list[str], by: list[str]) -> DataFrame:
    """(method, by, n_segments, n_frames) of segmentations (keys, segment_id) of the same frames."""
    each = stacked(*[df.select(*keys, "segment_id", F.lit(name).alias("method")) for name, df in methods.items()])
    sizes = each.groupBy("method", *keys, "segment_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("method", *by).agg(F.count(F.lit(1)).alias("n_segments"), F.sum("n").alias("n_frames"))


def earliest(df: DataFrame, keys: list[str], player: str = "player_id") -> DataFrame:
    """The start of each key's first interval and whose it is, the smallest player on ties."""
    return df.groupBy(*keys).agg(F.min("start_frame").alias("start_frame"), F.min_by(player, F.struct("start_frame", player)).alias(player))
