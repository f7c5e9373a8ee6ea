"""What a review of larger tables found about tasks: each test failed before its change, or says so."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import control
from trackloom.plans import jobs, registry
from trackloom.sources import views as V


@pytest.mark.parametrize("name", ["g2_shape_classes", "g3_segment_count", "f14_straightness", "w11_distance_suppression"])
def test_paths_stay_in_tasks_that_follow_the_track(spark, data, monkeypatch, name):
    """whole paths were dealt anew to the session's number of tasks, to be joined with their ends. F17, F20 passed before."""
    monkeypatch.setattr(V, "TASK_ROWS", 200)
    n = V.parts(spark, data)
    plan = registry.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "player_id" in line]
    assert n >= 30 and dealt and all(f", {n}), REPARTITION_BY_NUM" in line for line in dealt)


def test_players_are_summed_up_with_their_frames(spark, data, monkeypatch):
    """frames were made and stored first, then each player's ellipse met the grid again, and both were joined."""
    monkeypatch.setattr(V, "TASK_ROWS", 200)
    n = V.parts(spark, data)
    plan = registry.QUERIES["g6_player_rows"](spark, data)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange" in line]
    assert "Join" not in plan and "Scan ExistingRDD" not in plan and plan.count("MapInArrow") == 1
    assert n >= 30 and len(dealt) == 1 and f", {n}), REPARTITION_BY_NUM" in dealt[0]


def test_players_of_a_report_are_those_of_player_influence(spark):
    """of frozen frames too, with copies, unknown balls, velocities and keys, alone or with the other tables."""
    rows = [(f, ("Home", "Away")[i % 2], 10 * f + i // 2, 7.0 * i + f, 60.0 - 5 * i, 1.0 * (i % 3), -0.5 * f, 40.0 if f != 2 or i else None, 50.0 if f % 2 and i % 4 else 3.0) for f in (1, 2, 3) for i in range(9)]
    rows += [rows[3], (3, "Home", 77, 1.0, None, 1.0, 1.0, 40.0, 50.0), (3, "Away", 78, 1.0, 2.0, float("nan"), 1.0, 40.0, 3.0), (None, "Home", 79, 1.0, 2.0, 3.0, 1.0, 40.0, 3.0)]
    players = spark.createDataFrame(rows, "frame long, team string, player_id long, x double, y double, vx double, vy double, ball_x double, ball_speed_kmh double").withColumn("ball_y", F.lit(30.0))
    side = F.col("team") == "Home"
    report = jobs.control_report(players, [], side, nx=21, ny=15)
    alone = jobs.control_report(players, [], side, nx=21, ny=15, tables=("players",))
    assert set(report) == {"frames", "players", "snapshots", "summary"} and set(alone) == {"players"} and "rows" not in report["frames"].columns
    shown = control.player_influence(players, ["frame"], 21, 15, [F.col(c) for c in ("team", "x", "y")]).where("frame IS NOT NULL")
    want = sorted(map(tuple, shown.select("frame", "player_id", "team", "x", "y", "mean_influence", "max_influence").collect()))
    assert len(want) == 27
    for df in (report["players"], alone["players"]):
        got = sorted(map(tuple, df.select("frame", "player_id", "team", "x", "y", "mean_influence", "max_influence").collect()))
        assert [r[:5] for r in got] == [r[:5] for r in want] and np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-12)
    assert sum(r["n_frames"] for r in report["summary"].collect()) == 27
