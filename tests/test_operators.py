"""Operators against plain loops over small series, and properties that hold for any input."""

import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.functions import scalar as S
from trackloom.operators import context, control, indicators, intervals, matching, predicates, profiles, series, shape
from trackloom.plans import jobs


def frame(spark, values, name="v", keys=("a",)):
    rows = [(k, i, None if x is None else float(x)) for k, own in zip(keys, values, strict=True) for i, x in enumerate(own)]
    return spark.createDataFrame(rows, f"k string, frame long, {name} double")


def by_key(df, column):
    out = {}
    for r in df.orderBy("k", "frame").collect():
        out.setdefault(r["k"], []).append(r[column])
    return out


def absorb(values, cutoff):
    out, i = list(values), 0
    while i < len(out):
        j = i + 1
        while j < len(out) and out[j] == out[i]:
            j += 1
        if j - i < cutoff and i:
            out[i:j] = [out[i - 1]] * (j - i)
        i = j
    return out


def test_absorb_short_equals_loop(spark):
    draw = random.Random(4)
    values = [[float(draw.choice((0, 1, 1, 2))) for _ in range(draw.randrange(1, 60))] for _ in range(40)]
    keys = [f"k{i}" for i in range(40)]
    got = by_key(series.absorb_short(frame(spark, values, keys=keys), ["k"], "v", 3), "smoothed")
    assert got == {k: absorb(v, 3) for k, v in zip(keys, values, strict=True)}


def thinned(speeds, distance):
    v = [x or 0.0 for x in speeds]
    found, i = [], 1
    while i < len(v) - 1:
        j = i
        while j + 1 < len(v) and v[j + 1] == v[i]:
            j += 1
        if j < len(v) - 1 and v[i - 1] > v[i] < v[j + 1]:
            found.append((i + j) // 2)
        i = j + 1
    kept = []
    for c in sorted(found, key=lambda c: (v[c], -c)):
        if all(abs(c - k) >= distance for k in kept):
            kept.append(c)
    return sorted(kept)


def test_valleys_equal_loop(spark):
    draw = random.Random(9)
    values = [[draw.choice([None, 1.0, 2.0, 2.0, 3.0, 5.0]) for _ in range(draw.randrange(1, 90))] for _ in range(30)]
    keys = [f"k{i}" for i in range(30)]
    marked = series.valley_candidates(frame(spark, values, keys=keys), ["k"]).where("is_valley")
    got = by_key(series.suppress_near(marked, ["k"], 6), "frame")
    assert got == {k: t for k, v in zip(keys, values, strict=True) if (t := thinned(v, 6))}


def test_segments_cover_and_edges(spark):
    flat = frame(spark, [[1.0] * 9, [None] * 9, [1.0], [3, 1, 3, 1, 3, 1, 3]], keys=["flat", "unknown", "one", "zig"])
    got = by_key(series.plain_valley_segments(flat, ["k"], 1), "segment_id")
    assert got == {"flat": [0] * 8}
    assert series.valley_segments(flat.where("false"), ["k"]).count() == 0


def test_power_split_equals_loop(spark):
    draw = np.random.default_rng(7)
    v = np.abs(np.cumsum(draw.normal(0, 0.5, 160))) + 0.5
    df = frame(spark, [v.tolist()]).withColumn("segment_id", F.lit(0))
    got = series.power_split(df, ["k"], 3.0, 10).orderBy("frame").collect()
    accel = np.gradient(v, 1 / 25)
    power = v * accel
    dp = np.gradient(power)
    cuts, n = set(), len(v)
    for i in range(10, n - 10):
        if abs(dp[i]) > 3.0:
            cuts.add(i)
        if power[i - 1] * power[i] < 0:
            cuts.add(next((k for k in range(i + 1, n - 10) if dp[k - 1] * dp[k] < 0), i))
    at = [0]
    for c in sorted(cuts):
        if c - at[-1] >= 10:
            at.append(c)
    want = [int(np.searchsorted(at, i, side="right")) - 1 for i in range(n)]
    assert [r["piece"] for r in got] == want and np.allclose([r["power"] for r in got], power)
    slope = np.clip(accel / 9.81, -0.5, 0.5)
    assert np.allclose([r["ec"] for r in got], 1.29 * (155.4 * slope**5 - 30.4 * slope**4 - 43.3 * slope**3 + 46.3 * slope**2 + 19.5 * slope + 3.6))


def test_low_pass_islands(spark):
    got = by_key(series.low_pass(frame(spark, [[4, 8, 0, 4, None, 1, 2]]), ["k"], ["v"]), "v")["a"]
    assert got == [4.0, 5.0, 3.0, 4.0, None, None, None]


def greedy(a, b, ok, rank):
    used, out = set(), []
    for i, s, e in sorted(a, key=lambda r: (r[1], r[0])):
        free = sorted((rank(s, e, t, u), t, j) for j, t, u in b if j not in used and ok(s, e, t, u))
        if free:
            used.add(free[0][2])
            out.append((i, free[0][2]))
    return sorted(out)


@pytest.mark.parametrize("kind", ["tolerance", "overlap"])
def test_matches_equal_greedy(spark, kind):
    draw = random.Random(3)
    rows = [(i, draw.randrange(0, 300), side) for i, side in enumerate("ab" * 40)]
    a, b = ([(i, s, s + 5 + i % 40) for i, s, x in rows if x == y] for y in "ab")
    left, right = (spark.createDataFrame([("k", *r) for r in x], "k string, id long, start long, end long") for x in (a, b))
    if kind == "tolerance":
        got = matching.tolerance_match(left, right, ["k"], 5)
        want = greedy(a, b, lambda s, e, t, u: t - 5 <= s <= u + 5 or s - 5 <= t <= e + 5, lambda *x: 0)
    else:
        got = matching.overlap_match(left, right, ["k"], 2)
        want = greedy(a, b, lambda s, e, t, u: s - 2 <= t <= e + 2, lambda s, e, t, u: max(s, t) - min(e, u))
    pairs = sorted((r["a_id"], r["b_id"]) for r in got.collect())
    assert pairs == want and len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs)


def test_iou_is_bounded_and_symmetric(spark):
    rows = [(a, a + b, c, c + d) for a, b, c, d in itertools.product((0, 3, 9), (0, 4, 10), (1, 5), (0, 2, 20))]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    got = df.select(S.temporal_iou(*map(F.col, "abcd")).alias("x"), S.temporal_iou(*map(F.col, "cdab")).alias("y")).collect()
    assert all(0 <= r["x"] <= 1 and r["x"] == r["y"] for r in got)


def test_match_groups(spark):
    draw = random.Random(8)
    edges = [("h", *sorted(draw.sample(range(60), 2))) for _ in range(35)] + [("h", i, i + 1) for i in range(100, 140)]
    nodes = [("h", i) for i in [*range(60), *range(100, 141)]]
    held = spark.createDataFrame([(h, "a", i) for h, i in nodes], "half string, annotator string, segment_id long")
    pairs = spark.createDataFrame([(h, "a", u, "a", v) for h, u, v in edges], "half string, annotator_u string, u long, annotator_v string, v long")
    got = {r["segment_id"]: r["group_id"] for r in matching.match_groups(held, pairs, ["half"]).collect()}
    label = {i: i for _, i in nodes}
    for _ in nodes:
        for _, u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    assert got == label


FILE_FORM = "match_id string, half string, annotator string, segment_id long, jid long, team string, start_frame long, end_frame long"


def test_agreement_where_every_file_counts_from_0(spark):
    """Ids restart by match, half and annotator; matches stay within a match and half, and join only through their own segments."""
    rows = [(m, h, a, i, 7 + i % 2, "Home", 100 * i + d, 100 * i + 50 + d) for m in "MN" for h in "FO" for d, a in enumerate("abc") for i in range(4) if (m, h, a, i) not in {("M", "F", "c", 1), ("N", "O", "a", 3)}]
    rows.append(("M", "F", "c", 1, 9, "Home", 900, 950))  # of a player that no one else has
    notes = spark.createDataFrame(rows, FILE_FORM).repartition(3)
    by = ["match_id", "half"]
    report = jobs.agreement_report(notes, by)
    groups = {tuple(r)[:4]: (r["group_annotator"], r["group_id"]) for r in report["groups"].collect()}
    want = {(m, h, a, i): ("b" if (m, h, i) == ("N", "O", 3) else "a", i) for m, h, a, i, *_ in rows}
    want["M", "F", "c", 1] = ("c", 1)
    assert groups == want
    alone = report["isolated"].collect()
    assert [(r["match_id"], r["half"], r["annotator"], r["segment_id"], r["start_timecode"], r["duration_frames"], r["duration_tc"]) for r in alone] == [("M", "F", "c", 1, "00:00:36", 50, "00:00:02")]
    pairs = matching.undirected(report["matches"], by).collect()
    assert len(pairs) == len({tuple(r) for r in pairs}) and all(r["annotator_u"] < r["annotator_v"] and r["u"] == r["v"] for r in pairs)
    assert len(pairs) == 4 * 4 * 3 - 2 - 2
    counts = {(r["match_id"], r["half"]): (r["n_matched"], r["n_unmatched"]) for r in report["counts"].collect()}
    assert sum(sum(x) for x in counts.values()) == len(rows)


def test_components_of_any_shape(spark):
    draw = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(1_000, 1_000 + i) for i in range(1, 300)] + [(2_000 + draw.randrange(90), 2_000 + draw.randrange(90)) for _ in range(70)] + [(5, 5), (None, 3), (0, 1)]
    got = {r["node"]: r["root"] for r in matching.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in range(210):
        for u, v in edges:
            if u is not None and u != v:
                label[u] = label[v] = min(label[u], label[v])
    assert got == label
    assert matching.components(spark.createDataFrame([], "u long, v long")).collect() == []


def plain_greedy(a, b, near, rank):
    """Each a by start and id takes the best free b."""
    used, out = set(), set()
    for i, s, e in sorted(a, key=lambda x: (x[1], x[0])):
        free = sorted((rank((i, s, e), x), x[1], x[0]) for x in b if near((i, s, e), x) and x[0] not in used)
        if free:
            used.add(free[0][2])
            out.add((i, free[0][2]))
    return out


def test_matches_are_greedy_for_many_segments_of_one_player(spark):
    draw = random.Random(6)
    a, b = ([(i, s := draw.randrange(3_000), s + draw.randrange(1, 700)) for i in range(300)] for _ in "ab")
    form = "jid long, id long, start long, end long"
    left, right = (spark.createDataFrame([(1, *x) for x in side], form).repartition(3) for side in (a, b))
    common = lambda x, y: max(x[1], y[1]) - min(x[2], y[2])
    got = {(r["a_id"], r["b_id"]) for r in matching.overlap_match(left, right, ["jid"]).collect()}
    assert got == plain_greedy(a, b, lambda x, y: x[1] <= y[1] <= x[2], common)
    got = {(r["a_id"], r["b_id"]) for r in matching.tolerance_match(left, right, ["jid"], 25).collect()}
    assert got == plain_greedy(a, b, lambda x, y: y[1] - 25 <= x[1] <= y[2] + 25 or x[1] - 25 <= y[1] <= x[2] + 25, lambda x, y: 0)
    best = {r["a_id"]: (r["b_id"], r["iou"]) for r in matching.best_iou_match(left, right, ["jid"]).collect()}
    for x in a:
        inter = [(max(0, -common(x, y)), y) for y in b]
        iou = max(((n / (max(x[2], y[2]) - min(x[1], y[1])), -y[0]) for n, y in inter if n), default=None)
        assert best[x[0]] == ((-iou[1], pytest.approx(iou[0])) if iou and iou[0] >= 0.01 else (None, None))
    n = 100_000  # a second of work, not one that grows with the square
    long = spark.range(n).select(F.lit(1).alias("jid"), "id", (F.col("id") * 3).alias("start"), (F.col("id") * 3 + 5).alias("end"))
    assert matching.overlap_match(long, long, ["jid"]).where("a_id = b_id").count() == n


def test_matches_of_players_whose_ids_repeat(spark):
    one = spark.createDataFrame([(7, 0, 10, 20), (8, 0, 10, 20), (9, 0, 500, 510)], "jid long, id long, start long, end long")
    two = spark.createDataFrame([(7, 0, 12, 20), (7, 1, 13, 20), (8, 5, 11, 20)], "jid long, id long, start long, end long")
    got = {tuple(r) for r in matching.window_matches(one, two, ["jid"], 5, None).collect()}
    assert got == {(7, 0, 2, 0, 1), (8, 0, 1, 5, None), (9, 0, 0, None, None)}
    tags = spark.createDataFrame([(1, 7, "United", 15, "x"), (2, 7, "City", 15, "x"), (3, None, "United", 15, "x"), (4, 7, None, 15, "x"), (5, 7, "United", None, "x"), (6, 7, "United", 90, "x")], "tag_id long, jid long, team string, start_frame long, _team string")
    moves = spark.createDataFrame([(31, 7, "Old United", 12, 14), (30, 7, "United FC", 20, 30), (29, 7, "City", 0, 9), (28, 8, "United", 10, 20), (27, 7, None, 10, 20)], "movement_id long, jid long, team string, start_frame long, end_frame long")
    got = {r["tag_id"]: tuple(r)[5:] for r in matching.tag_matches(tags, moves, 6).collect()}
    assert got == {1: (2, 30, 31), 2: (1, 29, None), 3: (0, None, None), 4: (0, None, None), 5: (0, None, None), 6: (0, None, None)}


def test_indicators_of_players_whose_ids_repeat(spark):
    notes = spark.createDataFrame([(0, p, "F", 2, 8, None) for p in (1, 2)], "segment_id long, player_id long, half string, start_frame long, end_frame long, play_direction string")
    track = spark.createDataFrame([(p, "F", f, float(f * p), 0.0, float(p), 1) for p in (1, 2) for f in range(12)], "player_id long, half string, frame long, x double, y double, v double, poss long")
    got = {r["player_id"]: (r["segment_id"], r["n_points"], r["distance_m"], r["mean_vel_ms"]) for r in indicators.interval_indicators(notes, track, ["player_id"], ["half"]).collect()}
    assert got == {1: (0, 7, 6.0, 1.0), 2: (0, 7, 12.0, 2.0)}


def test_untracked_players_take_no_place_in_lines(spark):
    rows = [(1, "Home", i, "FP", x, 0.0 if x is not None else None) for i, x in enumerate([30.0, None, 10.0, None, 20.0, None])] + [(1, "Home", 9, "TW", 0.0, 0.0), (1, "Away", 1, "FP", 1.0, 1.0), (1, "Away", 2, "FP", 2.0, 1.0), (1, "Away", 3, "FP", None, None)]
    players = spark.createDataFrame(rows, "frame long, team string, player_id long, position string, x double, y double")
    lines = {r["team"]: tuple(r)[2:] for r in context.defensive_lines(players, ["frame"], F.lit(1)).collect()}
    assert lines == {"Home": (10.0, 20.0, 30.0), "Away": (None, None, None)}
    assert {r["team"]: (r["block_cx"], r["n_outfield"]) for r in context.block_centroid(players, ["frame"]).collect()} == {"Home": (20.0, 3), "Away": (1.5, 2)}


def test_asof_ties_and_edges(spark):
    probes = spark.createDataFrame([("m", 1.0), ("m", 5.0), ("m", 0.5), ("m", None), ("x", 3.0)], "k string, t double")
    events = spark.createDataFrame([("m", 1.0, "a"), ("m", 5.0, "b"), ("m", 5.0, "c"), ("m", None, "never")], "k string, at double, v string")
    got = sorted(map(tuple, intervals.asof_join(probes, events, ["k"], "t", "at", ["v"]).collect()), key=repr)
    assert got == sorted([("m", 0.5, None), ("m", 1.0, "a"), ("m", 5.0, "c"), ("m", None, None), ("x", 3.0, None)], key=repr)
    before = {r["t"]: r["v"] for r in intervals.asof_join(probes, events, ["k"], "t", "at", ["v"], inclusive=False).collect() if r["k"] == "m"}
    assert before == {1.0: None, 5.0: "a", 0.5: None, None: None}


def test_range_join_equals_filter(spark):
    draw = random.Random(6)
    points = spark.createDataFrame([("k", draw.randrange(-50, 300)) for _ in range(200)], "k string, p long")
    spans = spark.createDataFrame([("k", i, s := draw.randrange(-60, 290), s + draw.randrange(-2, 120)) for i in range(60)], "k string, i long, s long, e long")
    got = intervals.range_join(points, spans, ["k"], F.col("p"), F.col("s"), F.col("e"), 16)
    want = points.join(spans, "k").where("p BETWEEN s AND e")
    assert got.groupBy("i").count().exceptAll(want.groupBy("i").count()).count() == 0 and got.count() == want.count()


def test_roles_are_the_best_assignment():
    draw = np.random.default_rng(2)
    for n in (1, 2, 4, 6):
        cost = draw.integers(0, 12, (20, n, n))  # small numbers, so that there are ties
        sums, slots = context.assignments(cost)
        for own, total, got in zip(cost, sums, slots, strict=True):
            ways = sorted((own[np.arange(n), list(p)].sum(), p[::-1]) for p in itertools.permutations(range(n)))
            assert (total, tuple(got[::-1])) == ways[0]


def test_roles_of_unknown_places(spark):
    rows = [(1, 5, 0.1, None), (1, 2, 0.04, 0.5), (1, 9, 0.3, 0.2), (2, 1, None, None)]
    got = context.assign_roles(spark.createDataFrame(rows, "g long, player_id long, norm_x double, norm_y double"), ["g"])
    assert {(r["g"], r["player_id"]): (r["formation"] is None, r["role"]) for r in got.collect()} == {(1, 5): (False, "unknown"), (1, 2): (False, "GK"), (1, 9): (False, "FB"), (2, 1): (True, "unknown")}
    assert context.assign_roles(got.select("g", "player_id", F.lit(0.1).alias("norm_x"), F.lit(0.1).alias("norm_y")).where("false"), ["g"]).count() == 0


def test_long_series_in_time(spark):
    """A half has 67,500 frames; windows that look ahead must not go through the rest of it for each row."""
    import time

    n = 67_500
    df = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("frame"), (F.pmod(F.xxhash64("id"), F.lit(97)) / 10).alias("v"))
    begin = time.perf_counter()
    found = series.valley_candidates(df, ["k"]).where("is_valley").count()
    late = intervals.next_within(df.withColumn("t", F.col("frame").cast("double")), df.where("frame % 1000 = 0").withColumn("at", F.col("frame").cast("double")), ["k"], "t", "at", 9.5, "near").where("near").count()
    assert found > n / 5 and late == 67 * 10 + 1 and time.perf_counter() - begin < 60


def test_roles_of_a_formation(spark):
    slots = context.FORMATIONS["4-3-3"]
    rows = [(1, i, x + 0.01, y) for i, (x, y, _) in enumerate(slots)]
    got = {r["player_id"]: (r["formation"], r["role"]) for r in context.assign_roles(spark.createDataFrame([*rows, (1, 99, 0.5, 0.5)], "g long, player_id long, norm_x double, norm_y double"), ["g"]).collect()}
    assert got[99][1] == "unknown" and all(got[i] == ("4-3-3", role) for i, (_, _, role) in enumerate(slots))


def test_zone_against_block(spark):
    defenders = spark.createDataFrame([(1, x, y) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10))] + [(2, 0, 0)], "frame long, x long, y long")
    points = spark.createDataFrame([(1, 1, 5, 5), (1, 2, 5, 30), (1, 3, 20, 5), (2, 4, 0, 0)], "frame long, player_id long, x long, y long")
    got = {r["player_id"]: r["zone"] for r in context.zone_against_block(points, defenders, ["frame"]).collect()}
    assert got == {1: "Inside", 2: "Wing", 3: "Behind", 4: None}


def resampled(x, y, m):
    arc = np.concatenate([[0], np.cumsum(np.hypot(np.diff(x), np.diff(y)))])
    t = np.linspace(0, arc[-1], m)
    return np.interp(t, arc, x), np.interp(t, arc, y)


def test_shapes(spark):
    paths = {"line": [(i, 0.1 * i) for i in range(30)], "steep": [(0.2 * i, i) for i in range(30)], "bow": [(10 * math.cos(i / 9), 10 * math.sin(i / 9)) for i in range(30)], "short": [(0, 0), (1, 1)], "still": [(2, 2)] * 8, "long": [(i, math.sin(i / 20) * 9) for i in range(200)]}
    df = spark.createDataFrame([(k, i, float(x), float(y)) for k, p in paths.items() for i, (x, y) in enumerate(p)], "k string, frame long, x double, y double")
    got = {r["k"]: r for r in shape.classify(df, ["k"]).collect()}
    assert {k: r["shape"] for k, r in got.items()} == {"line": "straight", "steep": "diagonal", "bow": "curvilinear", "short": "unknown", "still": "straight", "long": "curvilinear"}
    assert got["bow"]["n_segments"] > 1 and got["line"]["n_segments"] == 1 and got["short"]["angle_deg"] is None
    points = {}
    for r in shape.resample(df, ["k"]).orderBy("k", "point").collect():
        points.setdefault(r[0], []).append(tuple(r)[1:])
    for k in ("line", "bow", "long"):
        x, y = map(np.array, zip(*paths[k], strict=True))
        rx, ry = resampled(x, y, min(50, len(x)))
        own = sorted(points[k])
        assert np.allclose([p[1] for p in own], rx) and np.allclose([p[2] for p in own], ry)


def test_control_is_a_share_and_mirrors(spark):
    players = spark.createDataFrame([(1, "Home", 30.0, 30.0, 3.0, 0.0), (1, "Away", 70.0, 30.0, 0.0, 0.0), (1, "Home", 52.0, 10.0, -1.0, 2.0)], "frame long, team string, x double, y double, vx double, vy double").withColumns({"ball_x": F.lit(50.0), "ball_y": F.lit(34.0)})
    one = control.surface(players, ["frame"], F.col("team") == "Home", nx=8, ny=6)
    two = control.surface(players.union(players.withColumn("vx", F.lit(None).cast("double"))), ["frame"], F.col("team") == "Away", nx=8, ny=6).withColumnRenamed("pc", "other")
    rows = one.join(two.select("ix", "iy", "other"), ["ix", "iy"]).collect()
    assert len(rows) == 48 and all(0 < r["pc"] < 1 and math.isclose(r["pc"] + r["other"], 1) for r in rows)
    points = control.ellipses(players).crossJoin(control.grid(spark, 8, 6)).withColumn("i", control.influence(F.col("gx"), F.col("gy")))
    sums = points.groupBy("ix", "iy").agg((F.sum(F.when(F.col("team") == "Home", F.col("i")).otherwise(-F.col("i")))).alias("s"))
    assert all(math.isclose(r["pc"], 1 / (1 + math.exp(-r["s"]))) for r in one.join(sums, ["ix", "iy"]).collect())
    top = {r["player_id"]: (r["mean_influence"], r["max_influence"]) for r in control.player_influence(players.withColumn("player_id", F.col("x")), ["frame"], 8, 6).collect()}
    assert all(math.isclose(top[r["x"]][0], r["m"]) and math.isclose(top[r["x"]][1], r["t"]) for r in points.groupBy("x").agg(F.avg("i").alias("m"), F.max("i").alias("t")).collect()) and len(top) == 3
    at = control.ellipses(players).withColumns({"i": control.influence(F.col("x"), F.col("y"))}).collect()
    assert all(math.isclose(r["i"], 1) for r in at)  # relative to the player's own place


def test_frames_are_summed_up_as_their_surfaces_are(spark):
    """Thirds, zones and sides against the points of surface(); a frame without a target, one with few players, one mirrored."""
    draw = random.Random(2)
    rows = [(f, t, 10 * f + i, draw.uniform(0, 105), draw.uniform(0, 68), draw.uniform(-3, 3), None if (f, i) == (1, 0) else draw.uniform(-3, 3), f == 2) for f in (1, 2, 3) for i, t in enumerate(("Home", "Away", "Home", "Away")) if f < 3 or i < 1]
    rows.append((4, "Home", 44, None, 1.0, 1.0, 1.0, False))
    players = spark.createDataFrame(rows, "frame long, team string, player_id long, x double, y double, vx double, vy double, turned boolean").withColumns({"ball_x": F.lit(40.0), "ball_y": F.lit(30.0), "ball_speed_kmh": F.when(F.col("frame") == 2, 50.0), "possession_team": F.when(F.col("frame") == 1, "Away")})
    side, fast = F.col("team") == F.when(F.col("frame") == 1, "Away").otherwise("Home"), F.col("ball_speed_kmh") > 36
    report = jobs.control_report(players, [], side, 12.0, F.col("turned"), target=F.col("player_id") == 12, target_radius=9.0, nx=21, ny=15)
    frames = {r["frame"]: r for r in report["frames"].collect()}
    points = defaultdict(list)
    for r in control.surface(players, ["frame"], side, fast, 21, 15).collect():
        points[r["frame"]].append(r)
    assert frames.keys() == points.keys() == {1, 2, 3}
    place = next((r[3], r[4]) for r in rows if r[2] == 12)
    for f, held in points.items():
        got, own = frames[f], sum(r["pc"] for r in held) / len(held)
        third = [np.mean([r["pc"] for r in held if (r["ix"] * 3 // 21 if f != 2 else 2 - r["ix"] * 3 // 21) == k]) for k in range(3)]
        assert np.allclose([got["pc_att_team"], got["pc_def_third"], got["pc_mid_third"], got["pc_att_third"]], [own, *third])
        near = lambda c, d: [r["pc"] for r in held if math.dist((r["gx"], r["gy"]), c) <= d]
        ball = near((40.0, 30.0), 12.0)
        assert math.isclose(got["ball_zone_pc"], np.mean(ball)) and got["ball_zone_points"] == len(ball)
        home = own if f != 1 else 1 - own
        assert (got["att_team"], got["def_team"]) == (("Away", "Home") if f == 1 else ("Home", "Away")) and math.isclose(got["pc_combined_home"], home) and math.isclose(got["pc_combined_away"], 1 - home)
        assert got["controlling_team"] == ("Home" if home > 0.5 else "Away") and got["possessing_team"] == ("Away" if f == 1 else "unknown") and got["radius_frozen"] == (f == 2)
        if f == 1:
            assert math.isclose(got["player_zone_home"], 1 - np.mean(near(place, 9.0))) and got["target_id"] == 12 and (got["n_att_players"], got["n_def_players"]) == (2, 1)
        else:
            assert got["player_zone_home"] is None and got["player_zone_points"] == 0 and got["target_id"] is None
    shares = {(r["frame"], r["player_id"]): r["team_pc_mean"] for r in report["players"].collect()}
    assert math.isclose(shares[1, 11], frames[1]["pc_att_team"]) and math.isclose(shares[1, 12], frames[1]["pc_def_team"]) and (1, 10) not in shares
    mean = {(r["ix"], r["iy"]): r for r in control.mean_surface(players, ["frame"], side, fast, 21, 15).collect()}
    at = [r for held in points.values() for r in held if (r["ix"], r["iy"]) == (4, 7)]
    assert len(mean) == 315 and mean[4, 7]["n_frames"] == 3 and math.isclose(mean[4, 7]["mean_pc"], np.mean([r["pc"] for r in at])) and math.isclose(mean[4, 7]["most_pc"], max(r["pc"] for r in at))


@pytest.mark.parametrize("width", [None, 7.0])
def test_scans_of_long_series_in_chunks(spark, width):
    draw = random.Random(11)
    events = [("m", "F" if i % 3 else "O", draw.choice([None, 0.0, 7.0, *map(float, range(60))]), i, draw.choice(["Home", "Away"])) for i in range(90)] + [(None, "F", 3.0, 900, "Home")]
    probes = [("m", h, t, i) for i, (h, t) in enumerate([(h, x / 2) for h in "FO" for x in range(-4, 130)] + [("F", None)])] + [("n", "F", 5.0, 999), (None, "F", 9.0, 1000)]
    made = spark.createDataFrame([e for e in events if e[2] is not None], "match_id string, half string, elapsed double, event_id long, team string")
    asked = spark.createDataFrame(probes, "match_id string, half string, elapsed double, probe_id long").repartition(3)
    known = sorted((e for e in events if e[2] is not None and e[0]), key=lambda e: (e[1], e[2], e[3]))
    goals = intervals.cumulative_score(made, ["match_id"], width=width)
    got = {r["event_id"]: (r["home"], r["away"]) for r in goals.collect()}
    assert got == {900: (1, 0), **{e[3]: tuple(sum(x[4] == t for x in known[: k + 1]) for t in ("Home", "Away")) for k, e in enumerate(known)}}
    score = {r["probe_id"]: (r["home"], r["away"]) for r in intervals.score_at(asked, goals, width=width).collect()}
    for m, h, t, i in probes:
        held = [e for e in known if t is not None and m == "m" and e[1] == h and e[2] <= t]
        assert score[i] == (got[max(held, key=lambda e: (e[2], e[3]))[3]] if held else (1, 0) if m is None else (0, 0))
    late = intervals.next_within(asked.withColumnRenamed("elapsed", "end_s"), made, ["match_id", "half"], "end_s", "elapsed", 4.0, "soon", width)
    for r in late.collect():
        assert r["soon"] == (r["end_s"] is not None and any(e[0] == r["match_id"] and e[1] == r["half"] and 0 <= e[2] - r["end_s"] <= 4 for e in [*known, events[-1]] if e[0]))


def test_quantiles_of_hot_values_nulls_and_few_rows(spark):
    draw = random.Random(12)
    rows = [("hot", 5.0)] * 3_000 + [("hot", draw.uniform(0, 10)) for _ in range(1_001)] + [("one", 2.5), ("two", 1.0), ("two", 4.0), ("none", None), (None, 3.0), (None, 8.0), (None, None), (None, 9.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: tuple(r)[1:] for r in profiles.describe(df, ["g"], "v").select("g", "n", "least", "q1", "q2", "q3", "most").collect()}
    for g in {r[0] for r in rows}:
        own = [v for k, v in rows if k == g and v is not None]
        want = (len(own), min(own), *np.quantile(own, [0.25, 0.5, 0.75]), max(own)) if own else (0, None, None, None, None, None)
        assert got[g] == (pytest.approx(want) if own else want)
    whole = profiles.quantiles(df, [], "v", {"most": 1.0, "least": 0.0, "low": 0.1}).collect()
    known = [v for _, v in rows if v is not None]
    assert tuple(whole[0]) == pytest.approx((max(known), min(known), np.quantile(known, 0.1)))


def test_roles_and_zones_by_phase_as_one_table(spark):
    """One live attack of Home to the left with an untracked player, one too short, one dead, one of too few players."""
    at = {1: (40.0, 0.0), 2: (20.0, -20.0), 3: (20.0, 20.0), 4: (-30.0, 0.0), 5: (0.0, 0.0)}
    rows = [("m", p, t, i, "FP", None if i == 5 and f else x, y) for p in (1, 2, 3) for f in range(5) for t, d in (("Home", 0), ("Away", 10)) for i, (x, y) in ((k + d, v) for k, v in at.items())]
    rows += [("m", 4, "Home", i, "FP", 1.0, 1.0) for i in range(3)]
    track = spark.createDataFrame(rows, "match_id string, phase_id long, team string, player_id long, position string, x double, y double")
    phases = spark.createDataFrame([("m", 1, "Home", True, 2.0), ("m", 2, "Home", True, 1.9), ("m", 3, "Home", False, 9.0), ("m", 4, "Home", True, 9.0)], "match_id string, phase_id long, possession_team string, ball_live boolean, duration_s double")
    got = {r["player_id"]: r for r in jobs.role_table(track, phases, ["match_id"], F.when(F.col("team") == "Home", -1).otherwise(1)).collect()}
    assert set(got) == {1, 2, 3, 4} and {r["phase_id"] for r in got.values()} == {1} and {r["team"] for r in got.values()} == {"Home"}
    assert math.isclose(got[4]["norm_x"], (30 + 52) / 104) and math.isclose(got[2]["norm_y"], (-20 + 34) / 68) and got[1]["mean_x"] == 40.0
    assert len({r["formation"] for r in got.values()}) == 1 and all(r["role"] != "unknown" for r in got.values())
    assert got[4]["zone"] == "Behind" and got[1]["zone"] in ("Inside", "Wing")


def test_painting_takes_the_last_interval_that_covers(spark):
    draw = random.Random(4)
    spans = [(k, i, s := draw.randrange(80), s + draw.choice([0, 1, 3, 20, 90]), draw.randrange(6), draw.choice(["Home", "Away", None])) for k in "ab" for i in range(40)]
    frames = [(k, f, "raw") for k in "abc" for f in range(-2, 120)]
    intervals_ = spark.createDataFrame(spans, "k string, id long, start_frame long, end_frame long, weight long, owner string").repartition(3)
    got = {(r["k"], r["frame"]): r["painted"] for r in intervals.paint(spark.createDataFrame(frames, "k string, frame long, raw string"), intervals_, ["k"], "owner", ["weight", "id"], "raw").collect()}
    assert len(got) == len(frames)
    for k, f, raw in frames:
        over = [(w, i, v) for key, i, s, e, w, v in spans if key == k and s <= f < e]
        assert got[k, f] == ((max(over, key=lambda x: x[:2])[2] or raw) if over else raw)
    assert intervals.painted_segments(intervals_, ["k"], "owner", ["weight", "id"]).count() <= 2 * len(spans)


def test_zones_mirror(spark):
    grid = spark.createDataFrame([(x, y) for x in (-40.0, 0.0, 40.0) for y in (-30.0, -10.0, 0.0, 10.0, 30.0)] + [(None, 1.0)], "x double, y double")
    a = predicates.zone(F.col("x"), F.col("y"), F.lit(predicates.LEFT))
    b = predicates.zone(-F.col("x"), -F.col("y"), F.lit(predicates.RIGHT))
    rows = grid.select(*(c.alias(n) for c, n in zip((*a, *b), "pqrs", strict=True))).collect()
    assert all((r["p"], r["q"]) == (r["r"], r["s"]) for r in rows) and rows[-1]["p"] is None


def test_phases_tile(spark):
    draw = random.Random(1)
    df = spark.createDataFrame([("a", i, draw.choice(["Home", "Away", "contest"]), draw.random() > 0.2) for i in range(200)], "k string, frame long, possession_team string, ball_live boolean")
    rows = series.attack_type(series.possession_phases(df, ["k"]), ["k"]).orderBy("phase_id").collect()
    assert rows[0]["start_frame"] == 0 and rows[-1]["end_frame"] == 199
    assert all(p["end_frame"] + 1 == q["start_frame"] for p, q in zip(rows, rows[1:], strict=False))
    assert {r["attack_type"] for r in rows} <= {"dead_ball", "contest", "set_piece", "counter_attack", "organized_attack"}


def test_time_codes(spark):
    df = spark.createDataFrame([(90_061, "75:30", "12:05:250"), (None, "x", "12:05")], "f long, m string, s string")
    rows = df.select(S.frames_to_timecode(F.col("f")).alias("a"), S.frames_to_timecode(F.col("f"), "ms").alias("b"), S.mmss_to_seconds(F.col("m")).alias("c"), S.parse_mmssms(F.col("s")).alias("d")).collect()
    assert tuple(rows[0]) == ("01:00:02", "60:02.440", 4530.0, 725.25) and tuple(rows[1]) == ("", "", None, None)
    with pytest.raises(ValueError, match="unknown"):
        S.frames_to_timecode(F.col("f"), "xx")
