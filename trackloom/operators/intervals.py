"""As-of and range joins, and the event context that rests on them."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .series import spread

#: Roles of a contact by event tag.
ROLES = {
    "Play": "passer", "ThrowIn": "passer", "FreeKick": "passer", "GoalKick": "passer", "KickOff": "passer", "CornerKick": "passer", "RefereeBall": "passer",
    "OtherBallAction": "ball_action", "BallClaiming": "ball_claim", "ShotAtGoal": "shooter", "SuccessfulShot": "shooter", "ShotWide": "shooter", "SavedShot": "shooter",
    "BlockedShot": "shooter", "ShotWoodWork": "shooter", "ChanceWithoutShot": "shooter", "Foul": "fouled",
}
#: Seconds that a set piece blacks out from its event on.
SET_PIECE_SECONDS = {"ThrowIn": 2.0, "FreeKick": 2.0, "GoalKick": 2.0, "KickOff": 6.0, "CornerKick": 2.0}


def _before(chunks: DataFrame, keys: list[str], carried: dict[str, Column]) -> DataFrame:
    """(_key0 and on, _of, names): over the chunks of a series before each one, the values that carried gives of its window.

    chunks: keys, _chunk and what carried needs, a row for each chunk.
    """
    ahead = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_of"), *[c.over(ahead).alias(n) for n, c in carried.items()])


def _beside(df: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    same = df["_chunk"].eqNullSafe(before["_of"])
    for i, k in enumerate(keys):
        same = same & df[k].eqNullSafe(before[f"_key{i}"])
    return df.join(before, same).drop("_of", "_chunk", *[f"_key{i}" for i in range(len(keys))])


def last_known(df: DataFrame, keys: list[str], order: list[str], value: str, into: str, chunk: Column | None = None) -> DataFrame:
    """Adds the last value that isn't NULL at or before each row of its series, by order (ascending, NULLs first).

    chunk, which must not fall along order, cuts long series: each chunk is scanned in a task of its own, ends of chunks,
    a row each, are scanned by series, and what they carry fills the starts. A series may then be of any length.
    """
    def last(by: list[str]) -> Column:
        return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))

    if chunk is None:
        return df.withColumn(into, last(keys))
    df = df.withColumn("_chunk", chunk)
    ends = df.groupBy(*keys, "_chunk").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end"))
    before = _before(ends, keys, {"_carried": F.last("_end", ignorenulls=True)})
    out = _beside(df.withColumn(into, last([*keys, "_chunk"])), before, keys)
    return out.withColumn(into, F.coalesce(into, "_carried")).drop("_carried")


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], chunk: Column | None = None) -> DataFrame:
    """Adds sums over each row and those before it in its series; chunk as for last_known()."""
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: F.sum(c).over(w) for n, c in sums.items()})
    df = df.withColumn("_chunk", chunk)
    ends = df.groupBy(*keys, "_chunk").agg(*[F.sum(c).alias(f"_end_{n}") for n, c in sums.items()])
    before = _before(ends, keys, {f"_carried_{n}": F.sum(f"_end_{n}") for n in sums})
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = _beside(df.withColumns({n: F.sum(c).over(w) for n, c in sums.items()}), before, keys)
    return out.withColumns({n: F.col(n) + F.coalesce(f"_carried_{n}", F.lit(0)) for n in sums}).drop(*[f"_carried_{n}" for n in sums])


def asof_join(probes: DataFrame, events: DataFrame, keys: list[str], probe_time: str, event_time: str, values: list[str], inclusive: bool = True, width: float | None = None, parts: int | None = None) -> DataFrame:
    """probes with values of the last event (by event_time, then all values) at or before each; NULL where there is none.

    One shuffle on keys and one window, whatever the number of events; events go before probes of the same time, or
    behind them if not inclusive. Probes with a NULL time get NULLs. width cuts series that outgrow a task into chunks of
    so much time, as last_known() has it; parts is the number of tasks that keys are dealt to, else the session's.
    """
    held = F.struct(*values)
    left = probes.withColumns({"_t": F.col(probe_time), "_kind": F.lit(1 if inclusive else 0), "_value": F.lit(None)})
    right = events.where(F.col(event_time).isNotNull()).select(*keys, F.col(event_time).alias("_t"), F.lit(0 if inclusive else 1).alias("_kind"), held.alias("_value")).withColumn("_event", F.lit(True))
    both = spread(left.drop("_value").withColumn("_event", F.lit(False)).unionByName(right, allowMissingColumns=True), parts, *keys)
    out = last_known(both, keys, ["_t", "_kind", "_value"], "_value", "_last", None if width is None else F.floor(F.col("_t") / width)).where("NOT _event")
    names = {v: F.when(F.col(probe_time).isNotNull(), F.col(f"_last.{v}")) for v in values}
    return out.withColumns({f"_new_{v}": c for v, c in names.items()}).select(*probes.columns, *[F.col(f"_new_{v}").alias(v) for v in values])


def range_join(left: DataFrame, right: DataFrame, keys: list[str], point: Column, start: Column, end: Column, width: int, how: str = "inner") -> DataFrame:
    """left rows whose point lies in right's [start, end]: an equi join on keys and buckets of that width, then the exact test.

    A right row goes to each bucket it touches, so width should be near the usual length; a point has one bucket, so no
    pair comes twice. how is inner, left or left_semi. Columns of both sides but for keys should differ.
    """
    a = left.withColumns({"_p": point, "_bucket": F.floor(point / width)})
    b = right.withColumns({"_s": start, "_e": end}).where("_s <= _e")
    b = b.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_s") / width), F.floor(F.col("_e") / width))))
    b = b.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_kb"), *[c for c in b.columns if c not in (*keys, "_bucket")])
    on = (F.col("_bucket") == F.col("_kb")) & (F.col("_p") >= F.col("_s")) & (F.col("_p") <= F.col("_e"))
    for i, k in enumerate(keys):
        on = on & (a[k] == F.col(f"_k{i}"))
    return a.join(b, on, how).drop("_p", "_bucket", "_kb", "_s", "_e", *[f"_k{i}" for i in range(len(keys))])


def cumulative_score(goals: DataFrame, keys: list[str], width: float | None = None) -> DataFrame:
    """home and away after each goal, in the order of keys' match, time and id."""
    sums = {c: (F.col("team") == t).cast("long") for c, t in (("home", "Home"), ("away", "Away"))}
    return running_sums(goals, keys, ["half", "elapsed", "event_id"], sums, None if width is None else F.struct("half", F.floor(F.col("elapsed") / width)))


def score_at(probes: DataFrame, scores: DataFrame, carry_over: bool = False, width: float | None = None, parts: int | None = None) -> DataFrame:
    """Adds home and away in effect at (match_id, half, elapsed): the last goal's, 0-0 before the half's first goal.

    carry_over lets the first half's score stand in the second until its first goal.
    """
    at = {"_score": F.struct("event_id", "home", "away")}
    own = scores.withColumns(at)
    got = asof_join(probes, own, ["match_id", "half"], "elapsed", "elapsed", ["_score"], width=width, parts=parts)
    first = F.lit(0).cast("long")
    if carry_over:
        last = own.where("half = 'F'").groupBy("match_id").agg(F.max(F.struct("elapsed", "_score"))["_score"].alias("_first"))
        got = got.join(last, "match_id", "left")
        home, away = (F.coalesce(F.when(F.col("half") != "F", F.col(f"_first.{c}")), first) for c in ("home", "away"))
    else:
        home = away = first
    out = got.withColumns({"home": F.coalesce("_score.home", home), "away": F.coalesce("_score.away", away)})
    return out.drop("_score", "_first").withColumn("scoreline", F.concat_ws("-", F.col("home").cast("string"), F.col("away").cast("string")))


def shot_follows(movements: DataFrame, shots: DataFrame, seconds: float = 10.0, width: float | None = None, parts: int | None = None) -> DataFrame:
    """shot_within: whether the same team shoots within so many seconds behind a movement's end, in the half."""
    return next_within(movements, shots, ["match_id", "half", "team"], "end_s", "elapsed", seconds, "shot_within", width, parts)


def next_within(left: DataFrame, events: DataFrame, keys: list[str], start: str, time: str, reach: float, into: str, width: float | None = None, parts: int | None = None) -> DataFrame:
    """Flags rows with an event in [start, start + reach], by the first event at or after start: a window, not pairs.

    The window runs backwards in time, so that each row adds to the one before it; width and parts are asof_join()'s.
    """
    right = events.select(*keys, F.col(time).alias("_t")).withColumn("_event", F.col("_t"))
    both = left.withColumns({"_t": F.col(start), "_event": F.lit(None).cast("double")}).unionByName(right.withColumn("_event", F.col("_event").cast("double")).withColumn("_probe", F.lit(False)), allowMissingColumns=True)
    both = spread(both, parts, *keys).withColumns({"_back": -F.col("_t"), "_late": F.col("_event").isNull()})  # of one time, events go first
    out = last_known(both, keys, ["_back", "_late"], "_event", "_next", None if width is None else F.floor(F.col("_back") / width)).where("_probe IS NULL")
    return out.withColumn(into, F.coalesce(F.col("_next") <= F.col(start) + reach, F.lit(False))).select(*left.columns, into)


def possession_intervals(contacts: DataFrame, keys: list[str], tail: int = 250, delay: dict[str, int] | None = None) -> DataFrame:
    """(keys, player_id, start_frame, end_frame): from each carrier's contact to the next later event frame."""
    later = contacts.select(*keys, "frame").distinct()
    later = later.withColumn("end_frame", F.coalesce(F.lead("frame").over(Window.partitionBy(*keys).orderBy("frame")), F.col("frame") + tail))
    shift = F.lit(0)
    for role, n in (delay or {}).items():
        shift = F.when(F.col("role") == role, n).otherwise(shift)
    out = contacts.join(later, [*keys, "frame"]).withColumn("start_frame", F.col("frame") + shift)
    return out.where("start_frame < end_frame").select(*keys, "player_id", "role", "start_frame", "end_frame")


def _swept(keys: list[str], value: str, kinds: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, active, out = None, None, [], []

        def upto(end: float) -> None:
            nonlocal at
            while active and at < end:
                _, stop, held = active[0]
                if stop <= at:
                    heapq.heappop(active)
                else:
                    out.append((*key, at, min(stop, end), held))
                    at = min(stop, end)

        def given() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in out], schema=kinds)
            out.clear()
            return rows

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in (*keys, "start_frame", "end_frame", "_rank", value)]
            for row in zip(*cols, strict=True):
                own, (start, end, rank, held) = row[: len(keys)], row[len(keys) :]
                if own != key:
                    upto(math.inf)
                    key, at, active = own, start, []
                upto(start)
                at = start
                heapq.heappush(active, (-rank, end, held))
            yield given()
        upto(math.inf)
        yield given()

    return run


def painted_segments(intervals: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """(keys, start_frame, end_frame, value): stretches on which the same interval is the last by order of those that cover them.

    Ends are exclusive; intervals of no length don't count. Each key's intervals pass once in the order of their starts, by a
    sweep that holds those still open: at most two stretches an interval, however long intervals are.
    """
    rows = intervals.where("start_frame < end_frame").select(*keys, F.col("start_frame").cast("long").alias("start_frame"), F.col("end_frame").cast("long").alias("end_frame"), value, *[c for c in order if c not in (*keys, "start_frame", "end_frame", value)])
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).select(*keys, "start_frame", "end_frame", "_rank", value)
    ranked = ranked.repartition(*keys).sortWithinPartitions(*keys, "start_frame", "_rank")
    form = ranked.drop("_rank")
    return ranked.mapInArrow(_swept(keys, value, to_arrow_schema(form.schema)), form.schema)


def paint(frames: DataFrame, intervals: DataFrame, keys: list[str], value: str, order: list[str], raw: str, into: str = "painted") -> DataFrame:
    """frames with the value of the last interval (by order) that covers them, or else the raw one.

    Intervals are cut into stretches that don't overlap, and each frame takes the one that starts last before it.
    """
    held = painted_segments(intervals, keys, value, order).select(*keys, F.col("start_frame").alias("_from"), F.col("end_frame").alias("_to"), F.col(value).alias("_value"))
    got = asof_join(frames, held, keys, "frame", "_from", ["_to", "_value"])
    return got.withColumn(into, F.when(F.col("frame") < F.col("_to"), F.coalesce("_value", raw)).otherwise(F.col(raw))).drop("_to", "_value")


def blackouts(events: DataFrame, fps: int = 25) -> DataFrame:
    """(match_id, half, b_start, b_end) of set pieces; a half's first kick-off reaches back to frame 0."""
    seconds = F.create_map(*[F.lit(x) for p in SET_PIECE_SECONDS.items() for x in p])
    own = events.where(F.col("kind").isin(*SET_PIECE_SECONDS))
    rank = F.row_number().over(Window.partitionBy("match_id", "half", "kind").orderBy("frame", "event_id"))
    first = (F.col("kind") == "KickOff") & (rank == 1)
    return own.select("match_id", "half", F.when(first, 0).otherwise(F.col("frame")).cast("long").alias("b_start"), (F.col("frame") + F.rint(F.element_at(seconds, F.col("kind")) * fps)).cast("long").alias("b_end"))


def outside_blackouts(movements: DataFrame, intervals: DataFrame, width: float | None = None) -> DataFrame:
    """Movements whose start isn't inside the latest-starting blackout at or before it; earlier, longer ones aren't asked."""
    held = intervals.withColumn("_end", F.col("b_end"))
    got = asof_join(movements, held, ["match_id", "half"], "start_frame", "b_start", ["_end"], width=width)
    return got.where(F.col("_end").isNull() | (F.col("start_frame") >= F.col("_end"))).drop("_end")


def contacts(events: DataFrame, recipient: str = "recipient_id") -> DataFrame:
    """(match_id, half, frame, player_id, role, tag): players that an event names, once for each frame and role."""
    roles = F.create_map(*[F.lit(x) for p in ROLES.items() for x in p])
    base = ["match_id", "half", "frame"]
    active = events.select(*base, "player_id", F.element_at(roles, F.col("kind")).alias("role"), F.col("kind").alias("tag")).where("role IS NOT NULL")
    if recipient in events.columns:
        got = events.where(F.col(recipient).isNotNull()).select(*base, F.col(recipient).alias("player_id"), F.lit("recipient").alias("role"), F.col("kind").alias("tag"))
        active = active.unionByName(got)
    return first_of(active, [*base, "player_id", "role"], ["tag"])


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first by order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def anchors(events: DataFrame, first_half_end: int, fallback: int = 67_500) -> DataFrame:
    """(match_id, kickoff_frame_1, second_start, kickoff_frame_2): the first kick-offs, with defaults where there are none."""
    kick = F.col("kind") == "KickOff"
    return events.groupBy("match_id").agg(
        F.coalesce(F.min(F.when(kick & (F.col("frame") <= first_half_end), F.col("frame"))), F.lit(0)).alias("kickoff_frame_1"),
        F.coalesce(F.min(F.when(kick & (F.col("frame") > first_half_end), F.col("frame"))), F.lit(first_half_end)).alias("second_start"),
        F.coalesce(F.min(F.when(kick & (F.col("half") == "O"), F.col("frame"))), F.lit(fallback)).alias("kickoff_frame_2"),
    )
