"""What a run over larger tables found about intervals: their rows were shuffled and spilled once annotations were no longer broadcast."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from trackloom.operators import indicators
from trackloom.plans import jobs, registry
from trackloom.sources import views as V


@pytest.fixture
def wide(spark):
    """A session that broadcasts no table by its size, as with large ones."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


@pytest.mark.parametrize("name", ["a3_interval_indicators"])
def test_intervals_meet_their_series_where_it_lies(wide, data, monkeypatch, name):
    """a join by buckets dealt frames, and then the rows of intervals, to the session's number of tasks."""
    monkeypatch.setattr(V, "TASK_ROWS", 200)
    n = V.INTERVAL_PARTS * V.parts(wide, data)
    plan = registry.QUERIES[name](wide, data)._jdf.queryExecution().executedPlan().toString().splitlines()
    joined = next(i for i, line in enumerate(plan) if "SortMergeJoin" in line and "_bucket" in line)
    dealt = [line for line in plan if "Exchange hashpartitioning(" in line and "player_id" in line]
    assert not [line for line in plan[:joined] if "Exchange" in line]
    assert len(dealt) == 2 and all("hashpartitioning(player_id#" in line and f", {n}), REPARTITION_BY_NUM" in line for line in dealt)


def test_enriched_annotations_go_to_tasks_that_follow_the_track(wide, data, monkeypatch):
    """matches, measures and context of annotations were joined in the session's number of tasks, with an exchange for each of them."""
    monkeypatch.setattr(V, "TASK_ROWS", 200)
    n = V.INTERVAL_PARTS * V.parts(wide, data)
    plan = registry.QUERIES["g9_enrichment"](wide, data)._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = [line for line in plan if "Exchange hashpartitioning(" in line and any(f"{c}#" in line for c in ("player_id", "team"))]
    many = [line for line in dealt if f", {n}), REPARTITION_BY_NUM" in line]
    assert len(many) == 8 and all("REPARTITION_BY_NUM" in line for line in dealt if "jid#" not in line)
    assert not [line for line in plan if "Exchange" in line and "movement_id#" in line]


@pytest.mark.parametrize("parts", [None, 5])
def test_enriched_annotations_keep_their_rows_and_columns(spark, parts):
    """passed before; annotations with a movement, with their own measures only, and with neither, where ids repeat for each player."""
    track = spark.createDataFrame([(p, "F", f, float(f * p), 0.0, float(p), 1) for p in (1, 2) for f in range(100)], "player_id long, half string, frame long, x double, y double, v double, poss long")
    notes = spark.createDataFrame([(0, 1, "F", 5, "Home", 9, 10, 20, "a"), (0, 2, "F", 5, "Home", 8, 10, 20, "b"), (1, 2, "F", 5, "Away", 9, 30, 30, None), (2, None, "F", None, None, None, 4, 9, "d")], "segment_id long, player_id long, half string, match_id long, team string, jid long, start_frame long, end_frame long, remark string").withColumn("play_direction", F.lit("right_to_left"))
    moves = spark.createDataFrame([(1, "F", m, s, e, 10.0 + m, 0.4, 36.0, 18.0) for m, s, e in ((0, 0, 15), (1, 11, 20), (2, 11, 20), (3, 20, 30))], "player_id long, half string, movement_id long, start_frame long, end_frame long, distance_m double, duration_s double, peak_speed_kmh double, avg_velocity_kmh double")
    people = spark.createDataFrame([(70, "Home", 9, "FP"), (71, "Away", 9, "TW"), (72, "Away", 8, "TW")], "person_id long, team string, jid long, position string")
    events = spark.createDataFrame([(1, 5, "F", "Home", "goal", 0.5), (2, 5, "F", "Home", "shot", 3.0), (3, 5, "F", "Away", "goal", 0.3)], "event_id long, match_id long, half string, team string, kind string, elapsed double")
    df = jobs.enrich(notes, moves, track, people, events, ["player_id", "half"], ["half"], parts=parts)
    first = ["match_id", "half", "segment_id", "team", "jid", "person_id", "position", "start_frame", "end_frame", "movement_id", "iou", "duration_source", "distance_m", "duration_s", "peak_vel_ms", "mean_vel_ms", "scoreline", "goal_indicator", "shot_within"]
    assert df.columns[:22] == [*first, "player_id", "remark", "play_direction"] and df.columns[-4:] == ["elapsed", "end_s", "home", "away"] and len(df.columns) == len(set(df.columns)) == 53
    got = {r["remark"]: (r["movement_id"], r["duration_source"], r["distance_m"], r["peak_vel_ms"], r["mean_vel_ms"], r["person_id"], r["position"], r["scoreline"], r["goal_indicator"], r["shot_within"], r["n_points"], r["attack_sign"]) for r in df.collect()}
    assert got == {
        "a": (1, "matched", 11.0, 10.0, 5.0, 70, "FP", "0-1", -1, True, 11, -1), "b": (None, "recomputed", 20.0, 2.0, 2.0, 72, "TW", "0-1", -1, True, 11, -1),
        None: (None, "missing", None, None, None, 71, "TW", "1-1", 0, False, None, None), "d": (None, "missing", None, None, None, None, None, "0-0", 0, False, None, None),
    }


def test_last_frames_are_those_of_the_track(spark, data):
    """they were taken from a track that was made and shuffled for them alone."""
    want = V.track(spark, data).groupBy("half").agg(F.max("frame")).collect()
    assert sorted(map(tuple, V.last_frames(spark, data).collect())) == sorted(map(tuple, want))


def _plain(rows, lo, hi, fps=25):
    """(n_points, distance, mean, peak frame, energy, mean before, middle x, home share) of (frame, x, y, v, poss)."""
    run, before = [r for r in rows if lo <= r[0] <= hi], [r[3] for r in rows if max(lo - 50, 0) <= r[0] < lo and r[3] is not None]
    known, v, e = [r for r in run if r[1] is not None and r[2] is not None], [r[3] or 0.0 for r in run], 0.0
    if len(known) < 2:
        return None
    for i, s in enumerate(v):
        a, b = max(i - 1, 0), min(i + 1, len(v) - 1)
        k = max(min(((v[b] - v[a]) / (b - a) * fps if b > a else 0.0) / 9.81, 0.5), -0.5)
        e += max((((((155.4 * k - 30.4) * k - 43.3) * k + 46.3) * k + 19.5) * k + 3.6) * 1.29, 0) * s
    own, home = [r[3] for r in run if r[3] is not None], [r[4] == 1 for r in run if r[4] is not None]
    far = sum(((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) ** 0.5 for p, q in zip(known, known[1:], strict=False))
    top = min((r for r in run), key=lambda r: (-(r[3] if r[3] is not None else -1.0), r[0]))[0]
    return (len(known), far, statistics.fmean(own) if own else None, top, e / fps, statistics.fmean(before) if before else None, statistics.median(r[1] for r in known), sum(home) / len(home) if home else None)


@pytest.mark.parametrize("records", [3, 10_000])
def test_indicators_of_gaps_unknowns_and_long_intervals(spark, records):
    """passed before; intervals whose blocks come in several batches, and rows of unknown place, speed or possession."""
    draw = random.Random(4)
    some = lambda value: None if draw.random() < 0.2 else value
    track = {(p, h): [(f, some(draw.uniform(-50, 50)), some(draw.uniform(-30, 30)), some(draw.choice([1.0, 4.0, draw.random()])), some(draw.randrange(3))) for f in range(700) if draw.random() < 0.9] for p in (1, 2) for h in "FO"}
    notes = [(i, draw.choice([1, 2, 3]), draw.choice("FO"), s, s + draw.choice([0, 1, 5, 30, 400, 2000])) for i, s in enumerate(draw.randrange(-20, 720) for _ in range(60))]
    notes += [(90, 1, "F", 0, 5000), (91, 2, "O", None, 9), (92, 2, "O", 40, None), (93, None, "O", 4, 9)]
    rows = spark.createDataFrame([(*k, *r) for k, own in track.items() for r in own], "player_id long, half string, frame long, x double, y double, v double, poss long")
    a = spark.createDataFrame(notes, "segment_id long, player_id long, half string, start_frame long, end_frame long").withColumn("play_direction", F.lit("left_to_right"))
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    try:
        cols = ["n_points", "distance_m", "mean_vel_ms", "peak_frame", "total_energy_cost_J", "pre_run_mean_vel_ms", "x_mid", "possession_ratio"]
        got = {(r[0], r[1], r[2]): tuple(r)[3:] for parts in (None, 6) for r in indicators.interval_indicators(a, rows, ["player_id"], ["half"], parts=parts).select("player_id", "half", "segment_id", *cols).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    want = {}
    for i, p, h, s, e in notes:
        end = max(r[0] for q in (1, 2) for r in track[(q, h)])
        lo, hi = (max(0, min(end if t is None else t, end)) for t in (s, e))
        w = _plain(track[(p, h)], lo, hi) if p in (1, 2) and lo < hi else None
        if w is not None:
            want[(p, h, i)] = w
    assert len(want) > 25 and set(got) == set(want)
    for k, w in want.items():
        assert got[k] == pytest.approx(w, abs=0.006, nan_ok=True), k


def test_indicators_of_ids_that_repeat_for_one_player(spark):
    """passed before; the rows of all intervals of one id count together, in the order of their frames, as in SQL."""
    rows = spark.createDataFrame([(7, "F", f, float(f * f), 0.0, 1.0, 1) for f in range(300)], "player_id long, half string, frame long, x double, y double, v double, poss long")
    a = spark.createDataFrame([(0, 7, "F", 200, 220, None), (0, 7, "F", 10, 100, None)], "segment_id long, player_id long, half string, start_frame long, end_frame long, play_direction string")
    got = indicators.interval_indicators(a, rows, ["player_id"], ["half"]).select("n_points", "distance_m", "x_start", "x_end", "x_mid").collect()
    assert [tuple(r) for r in got] == [(112, 220.0**2 - 100, 100.0, 220.0**2, (65**2 + 66**2) / 2)]
