import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.operators import frames
from trackloom.sources import tables, xml

POSITIONS = """<PutDataRequest><Positions>
<FrameSet GameSection="firstHalf" MatchId="M1" TeamId="T1" PersonId="P1"><Frame N="10" T="2024-01-01T15:00:00.000+01:00" X="1.5" Y="-2.0" S="3.1"/><Frame N="11" T="x" X="2.5" Y="-2.5" S="3.2"/></FrameSet>
<FrameSet GameSection="firstHalf" MatchId="M1" TeamId="T2" PersonId="P9"><Frame N="10" X="-4" Y="0"/><Frame N="12" X="NaN" Y="1"/></FrameSet>
<FrameSet GameSection="firstHalf" MatchId="M1" TeamId="referee" PersonId="R1"><Frame N="10" X="0" Y="0"/></FrameSet>
<FrameSet GameSection="firstHalf" MatchId="M1" TeamId="BALL" PersonId="BALL"><Frame N="10" X="0.5" Y="0.5" BallPossession="1" BallStatus="1"/></FrameSet>
</Positions></PutDataRequest>"""
EVENTS = """<PutDataRequest>
<Event EventTime="2024-01-01T15:00:01.000+01:00" MatchId="M1"><KickOff GameSection="firstHalf"><Play Player="P1" Recipient="P2"/></KickOff></Event>
<Event EventTime="2024-01-01T15:00:05.000+01:00" MatchId="M1"><Play Player="P2" Recipient="P3"/></Event>
<Event EventTime="2024-01-01T15:00:09.000+01:00" MatchId="M1"><ShotAtGoal Team="T1" Player="P3"><SuccessfulShot Type="x"/></ShotAtGoal></Event>
<Event EventTime="2024-01-01T15:01:09.000+01:00" MatchId="M1"><FreeKick><ShotAtGoal Team="T2" Player="P9"><SuccessfulShot/></ShotAtGoal></FreeKick></Event>
<Event EventTime="2024-01-01T15:02:00.000+01:00" MatchId="M1"><TacklingGame Winner="P1" WinnerRole="withBallControl" Loser="P9" LoserRole="withoutBallControl"/></Event>
<Event EventTime="2024-01-01T15:03:00.000+01:00" MatchId="M1"><ShotWide Team="T2" Player="P9"/></Event>
<Event MatchId="M1"><Foul Fouled="P1"/></Event>
</PutDataRequest>"""
MATCH = """<MatchInformation><General MatchId="M1" KickoffTime="2024-01-01T15:00:00.000+01:00" HomeTeamId="T1" GuestTeamId="T2"/><Teams>
<Team TeamId="T1" TeamName="One" Role="home"><Players><Player PersonId="P1" ShirtNumber="7" Shortname="A. B" PlayingPosition="TW" Starting="true"/><Player PersonId="P2" ShirtNumber="x" Shortname="" FirstName="C" LastName="D" Starting="false"/></Players></Team>
<Team TeamId="T2" TeamName="Two" Role="guest"><Players><Player PersonId="P9" ShirtNumber="7"/></Players></Team></Teams></MatchInformation>"""


@pytest.fixture
def match(tmp_path):
    for name, text in (("positions", POSITIONS), ("events", EVENTS), ("info", MATCH)):
        (tmp_path / f"DFL-MAT-M1_{name}.xml").write_text(text)
    return tmp_path


def test_positions(spark, match):
    roster = xml.read_roster(spark, str(match / "DFL-MAT-M1_info.xml"))
    track, state = xml.read_positions(spark, str(match / "DFL-MAT-M1_positions.xml"), roster, (52.5, 34.0))
    got = {(r["person_id"], r["frame"]): (r["team"], r["x"], r["y"]) for r in track.collect()}
    assert got == {("P1", 10): ("Home", 54.0, 32.0), ("P1", 11): ("Home", 55.0, 31.5), ("P9", 10): ("Away", 48.5, 34.0), ("P9", 12): ("Away", None, 35.0)}
    assert [tuple(r) for r in state.collect()] == [("M1", "firstHalf", 10, 1, 1, 53.0, 34.5)]


def test_roster_and_clock(spark, match):
    rows = {r["person_id"]: r for r in xml.read_roster(spark, str(match / "DFL-MAT-M1_info.xml")).collect()}
    assert (rows["P1"]["jid"], rows["P1"]["starting"], rows["P2"]["jid"], rows["P2"]["name"], rows["P9"]["name"], rows["P9"]["role"]) == (7, True, None, "C D", "P9", "Away")
    clock = xml.read_clock(spark, str(match / "DFL-MAT-M1_info.xml")).collect()[0]
    assert (clock["first_half_end"] - clock["kickoff"]).total_seconds() == 3000 and clock["kickoff"].minute == 0


def test_events(spark, match):
    events = xml.read_events(spark, str(match / "DFL-MAT-M1_events.xml"))
    assert events.count() == 7 and events.where("ts IS NULL").count() == 1
    people = {(r["person_id"], r["role"], r["tag"]) for r in xml.event_contacts(events).collect()}
    assert people == {("P1", "passer", "KickOff"), ("P2", "recipient", "KickOff"), ("P2", "passer", "Play"), ("P3", "recipient", "Play"), ("P3", "shooter", "ShotAtGoal"), ("P1", "duel_winner", "TacklingGame"), ("P9", "shooter", "ShotWide")}
    assert {r["player"] for r in xml.event_goals(events).collect()} == {"P3", "P9"} and xml.event_shots(events).count() == 3


def test_broken_files_are_listed_and_others_read(spark, match):
    """A record that doesn't parse, a file that is cut off and one that is no XML; matches beside them stay whole."""
    (match / "DFL-MAT-M2_positions.xml").write_text(POSITIONS.replace("M1", "M2").replace('<Frame N="10" X="-4" Y="0"/>', '<Frame N="10" X="-4" Y=0/>'))
    (match / "DFL-MAT-M3_positions.xml").write_text(POSITIONS.replace("M1", "M3")[:430])
    (match / "DFL-MAT-M4_positions.xml").write_text(POSITIONS.replace("M1", "M4"))
    (match / "DFL-MAT-M5_positions.xml").write_text("not a match")
    folder = str(match) + "/*positions.xml"
    bad = {r["match_id"]: r for r in xml.broken_xml(spark, folder, "positions").collect()}
    assert set(bad) == {"M2", "M3", "M5"} and bad["M2"]["n_good"] < bad["M2"]["n_tags"] == 4 and bad["M2"]["reason"].split("; ")[0] in ("records do not parse", "records are missing")
    assert "the file is cut off" in bad["M3"]["reason"] and "the file is cut off" in bad["M5"]["reason"]
    track, state = xml.read_positions(spark, folder)
    whole = {m: sorted((r["person_id"], r["frame"]) for r in track.where(F.col("match_id") == m).collect()) for m in ("M1", "M2", "M4")}
    assert whole["M1"] == whole["M4"] == [("P1", 10), ("P1", 11), ("P9", 10), ("P9", 12)] and whole["M2"] == [("P1", 10), ("P1", 11)]
    assert {r["match_id"] for r in state.collect()} >= {"M1", "M4"}
    for kind, name in (("events", "events"), ("rosters", "info"), ("matches", "info")):
        assert xml.broken_xml(spark, str(match / f"DFL-MAT-M1_{name}.xml"), kind).collect() == []
    (match / "d1.json").write_text('{"M1": {"Home": {"firstHalf": "left_to_right"}}}')
    (match / "d2.json").write_text('{"M2": {"Home"')
    (match / "d3.json").write_text("{}")
    assert {(r["path"][-7:], r["reason"], r["head"]) for r in tables.broken_json(spark, str(match) + "/d*.json", tables.DIRECTIONS).collect()} == {("d2.json", "not the JSON that is expected", '{"M2": {"Home"'), ("d3.json", "holds nothing", "{}")}
    assert [r["match_id"] for r in tables.read_directions(spark, str(match) + "/d*.json").collect()] == ["M1"]


def test_annotations(spark, tmp_path):
    (tmp_path / "DFL-MAT-M1_firstHalf_ann a.csv").write_text("segment_id,half,start_frame,end_frame,player_jid,team,mood\n0,firstHalf,10,20,7.0,Home,good\n1,firstHalf,30,30,x,Away,bad\n")
    (tmp_path / "DFL-MAT-M2_firstHalf_b_c.csv").write_text("segment_id,half,start_frame,end_frame,player_jid,team,mood\n0,firstHalf,1,2,9,Home,ok\n")
    (tmp_path / "short.csv").write_text("segment_id,half,start_frame,end_frame,player_jid,team,mood\n0,firstHalf,1,2,9,Home,ok\n")
    rows = sorted(map(tuple, tables.read_annotations(spark, str(tmp_path)).select("match_id", "half_key", "annotator", "player_jid", "mood").collect()), key=repr)
    assert rows == [("M1", "firstHalf", "ann a", 7, "good"), ("M1", "firstHalf", "ann a", None, "bad"), ("M2", "firstHalf", "b_c", 9, "ok")]
    with pytest.raises(ValueError, match="nowhere"):
        tables.read_annotations(spark, str(tmp_path), ["half", "nowhere"])
    assert {r["match_id"] for r in tables.find_files(spark, str(tmp_path), "firstHalf").collect()} == {"M1", "M2"}


def test_annotations_by_each_files_own_header(spark, tmp_path):
    """Swapped columns, quoted commas, a byte order mark, a missing and a further column, lines like a header, and long files."""
    (tmp_path / "DFL-MAT-M1_firstHalf_a.csv").write_text("segment_id,half,start_frame,end_frame,player_jid,team\n0,firstHalf,10,20,7,Home\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "DFL-MAT-M2_firstHalf_a.csv").write_text('\ufeffteam,end_frame,start_frame,player, half ,player_jid,segment_id\r\nAway,20,10,"B, A.",firstHalf,7,0\r\n\r\nHome,40,30,"C ""D""",firstHalf,8,1\r\n', encoding="utf-8")
    (tmp_path / "DFL-MAT-M3_firstHalf_a.csv").write_text("segment_id,half,start_frame,player_jid,team\n0,firstHalf,10,7,Home\n")
    (tmp_path / "DFL-MAT-M4_firstHalf_a.csv").write_text("half,segment_id,player_jid,end_frame,start_frame,team,mood\n" + "".join(f"firstHalf,{i},5,{i + 9},{i},Home,\n" for i in range(3_000)))
    (tmp_path / "DFL-MAT-M5_firstHalf_empty.csv").write_text("half,start_frame\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = tables.read_annotations(spark, str(tmp_path))
        good, broken = tables.split_broken(rows)
        got = {(r["match_id"], r["segment_id"]): (r["start_frame"], r["end_frame"], r["player"], r["team"]) for r in good.collect()}
        assert len(got) == 3_003 and got["M1", 0] == (10, 20, None, "Home") and got["M2", 0] == (10, 20, "B, A.", "Away") and got["M2", 1] == (30, 40, 'C "D"', "Home")
        assert all(got["M4", i] == (i, i + 9, None, "Home") for i in range(3_000))
        assert [(r["match_id"], r["_corrupt_record"]) for r in broken.collect()] == [("M3", "no end_frame")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_json(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"M1": {"Home": {"firstHalf": "left_to_right"}}, "M2": {"Home": {"firstHalf": "right_to_left", "secondHalf": "left_to_right"}}}')
    (tmp_path / "broken.json").write_text('{"M1": {"Home"')
    assert tables.read_directions(spark, str(tmp_path / "d.json")).count() == 3 and tables.read_directions(spark, str(tmp_path / "broken.json")).count() == 0
    (tmp_path / "o.json").write_text('{"M1": {"firstHalf": "00:01:05"}}')
    offsets = tables.read_offsets(spark, str(tmp_path / "o.json"))
    runs = spark.createDataFrame([("M1", "firstHalf"), ("M1", "secondHalf")], "match_id string, half string")
    assert sorted(r["offset_s"] for r in tables.with_offsets(runs, offsets).collect()) == [0, 65]


def test_sinks(spark, tmp_path):
    df = spark.range(6).select((F.col("id") % 2).alias("match_id"), "id")
    tables.write_table(df, str(tmp_path / "out"))
    tables.write_table(df, str(tmp_path / "csv"), form="csv")
    assert spark.read.parquet(str(tmp_path / "out")).where("match_id = 1").count() == 3
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 6
    bad = spark.createDataFrame([(1, None), (2, "broken")], "id long, _corrupt_record string")
    good, broken = tables.split_broken(bad)
    assert (good.count(), broken.count()) == (1, 1)


def test_landed_series_need_no_shuffle_and_prune_frames(spark, tmp_path):
    track = spark.range(4_000).select((F.col("id") % 3).alias("match_id"), F.lit("F").alias("half"), F.lit("Home").alias("team"), (F.col("id") % 40).alias("player_id"), F.floor(F.col("id") / 40).alias("frame"), F.col("id").cast("double").alias("x"))
    keys = ["match_id", "half", "team", "player_id"]
    landed = tables.land_series(track, "landed_track", keys, buckets=4, path=str(tmp_path / "landed"))
    try:
        steps = landed.withColumn("step", F.col("x") - F.lag("x").over(Window.partitionBy(*keys).orderBy("frame")))
        plan = steps._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" in plan
        assert sorted(map(tuple, steps.collect()), key=repr) == sorted(map(tuple, track.withColumn("step", F.col("x") - F.lag("x").over(Window.partitionBy(*keys).orderBy("frame"))).collect()), key=repr)
        some = frames.between_frames(landed, 10, 20)
        assert "GreaterThanOrEqual(frame,10)" in some._jdf.queryExecution().executedPlan().toString() and some.count() == track.where("frame BETWEEN 10 AND 20").count()
    finally:
        spark.sql("DROP TABLE landed_track")


def test_event_elements_in_a_column(spark):
    rows = [(x,) for x in EVENTS.split("\n") if x.startswith("<Event")] + [(None,), ("<Event",)]
    events = xml.parse_events(spark.createDataFrame(rows, "xml string"), "xml")
    assert {r["player"] for r in xml.event_goals(events).collect()} == {"P3", "P9"} and xml.event_shots(events).count() == 3


def test_broken_rows_are_set_apart(spark, tmp_path):
    (tmp_path / "DFL-MAT-M1_firstHalf_a.csv").write_text("segment_id,half,start_frame,end_frame,player_jid,team\n0,firstHalf,10,20,7,Home\n1,firstHalf,ten,20,7,Home\n2,,5,6,7,Home\n3,firstHalf\n")
    (tmp_path / "DFL-MAT-M2_firstHalf_b.csv").write_text("segment_id,half,start_frame,end_frame,player_jid,team\n0,firstHalf,1,2,9,Home\n")
    good, broken = tables.split_broken(tables.read_annotations(spark, str(tmp_path)))
    assert sorted((r["match_id"], r["segment_id"]) for r in good.collect()) == [("M1", 0), ("M2", 0)] and "_corrupt_record" not in good.columns
    assert {r["segment_id"]: r["_corrupt_record"] for r in broken.collect()} == {1: "start_frame: ten", 2: "no half", 3: "no start_frame; no end_frame"}


def test_trajectories_are_written_by_player(spark, tmp_path):
    track = spark.createDataFrame([("M1", "Home", p, f, float(f), 0.0) for p in (1, 2) for f in range(9)], "match_id string, team string, player_id long, frame long, x double, y double")
    moves = spark.createDataFrame([("M1", "Home", 1, 0, 2, 4), ("M1", "Home", 1, 1, 4, 5), ("M1", "Home", 2, 0, 7, 20)], "match_id string, team string, player_id long, movement_id long, start_frame long, end_frame long")
    people = spark.createDataFrame([(1, "A. B", "TW")], "xid long, name string, position string")
    tables.write_trajectories(track, moves, people, ["match_id", "team", "player_id"], str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out")).select("player_id", "movement_id", "run_frame", "frame", "name").collect()
    assert sorted(map(tuple, rows), key=repr) == sorted([(1, 0, 0, 2, "A. B"), (1, 0, 1, 3, "A. B"), (1, 0, 2, 4, "A. B"), (1, 1, 0, 4, "A. B"), (1, 1, 1, 5, "A. B"), (2, 0, 0, 7, None), (2, 0, 1, 8, None)], key=repr)
    assert (tmp_path / "out" / "match_id=M1" / "team=Home" / "player_id=2").is_dir()
