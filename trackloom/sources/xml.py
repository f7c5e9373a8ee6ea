"""Readers of position, event and match-information XML, by Spark's XML source and explicit schemas.

A file's rows are split by row tag, so a folder of many matches is one job. Land the results as Parquet before using
them more than once. Records that don't parse are left out by the readers and listed, by file and match, by broken_xml().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import display_name
from ..operators.intervals import first_of

POSITIONS = (
    "_GameSection STRING, _MatchId STRING, _TeamId STRING, _PersonId STRING, "
    "Frame ARRAY<STRUCT<_N: BIGINT, _T: STRING, _X: DOUBLE, _Y: DOUBLE, _S: DOUBLE, _BallPossession: INT, _BallStatus: INT>>"
)
_PLAY = "STRUCT<_Player: STRING, _Recipient: STRING>"
_SHOT = "STRUCT<_Team: STRING, _Player: STRING, SuccessfulShot: STRUCT<_Type: STRING>>"
PLAY_TAGS = ("KickOff", "ThrowIn", "GoalKick", "FreeKick", "CornerKick", "RefereeBall")
SHOT_TAGS = ("ShotAtGoal", "SuccessfulShot", "ShotWide", "SavedShot", "BlockedShot", "ShotWoodWork", "ChanceWithoutShot")
EVENTS = ", ".join([
    "_EventTime STRING, _MatchId STRING", f"Play {_PLAY}",
    *[f"{t} STRUCT<_GameSection: STRING, Play: ARRAY<{_PLAY}>, ShotAtGoal: {_SHOT}>" for t in PLAY_TAGS],
    "OtherBallAction STRUCT<_Player: STRING>", "BallClaiming STRUCT<_Player: STRING>",
    "TacklingGame STRUCT<_Winner: STRING, _WinnerRole: STRING, _Loser: STRING, _LoserRole: STRING>", "Foul STRUCT<_Fouled: STRING>",
    *[f"{t} {_SHOT}" for t in SHOT_TAGS], f"Penalty STRUCT<ShotAtGoal: {_SHOT}>",
])
TEAM = (
    "_TeamId STRING, _TeamName STRING, _Role STRING, Players STRUCT<Player: ARRAY<STRUCT<_PersonId: STRING, _ShirtNumber: STRING, _Shortname: STRING, "
    "_FirstName: STRING, _LastName: STRING, _PlayingPosition: STRING, _Starting: STRING>>>"
)
MATCH = (
    "General STRUCT<_MatchId: STRING, _KickoffTime: STRING, _HomeTeamId: STRING, _GuestTeamId: STRING>, "
    "OtherGameInformation STRUCT<_TotalTimeFirstHalf: BIGINT>"
)


def _records(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """The records of a tag, with _corrupt_record where one doesn't parse."""
    options = {"rowTag": tag, "ignoreNamespace": True, "mode": "PERMISSIVE", "recursiveFileLookup": True, "columnNameOfCorruptRecord": "_corrupt_record"}
    return spark.read.format("xml").options(**options).schema(f"{schema}, _corrupt_record STRING").load(path)


def _read(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return _records(spark, path, tag, schema).where(_PARSED.format(schema.split()[0])).drop("_corrupt_record")


#: A record that parses, by its first column; Spark wants a column of the record beside the mark, and any hash passes.
_PARSED = "_corrupt_record IS NULL AND hash({}) >= -2147483648"


#: What each kind of file is read by: its record's tag and schema.
KINDS = {"positions": ("FrameSet", POSITIONS), "events": ("Event", EVENTS), "rosters": ("Team", TEAM), "matches": ("MatchInformation", MATCH)}


def broken_xml(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(path, match_id, n_tags, n_good, n_broken, reason) of the files of one of KINDS that can't be read whole.

    A file is listed if a record of it doesn't parse, if it has more starts of records than records were found, or if it
    doesn't end as its root element does, which tells files that were cut off. A record that doesn't parse may take those
    behind it in its file along; other files are read whole. Files are compared by counts: one scan of
    lines, one of records, and a row a file behind each.
    """
    tag, schema = KINDS[kind]
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("line"), F.monotonically_increasing_id().alias("n")).where("line <> ''")
    root = F.regexp_extract("line", r"<([A-Za-z_][^\s/>]*)", 1)
    held = lines.groupBy("path").agg(
        F.sum(F.regexp_count("line", F.lit(rf"<{tag}[\s/>]"))).alias("n_tags"), F.sum(F.regexp_count("line", F.lit(rf"<{tag}$"))).alias("_split"),
        F.min_by(root, F.when(root != "", F.col("n"))).alias("_root"), F.max_by("line", "n").alias("_last"),
    )
    parsed = F.expr(_PARSED.format(schema.split()[0]))
    found = _records(spark, path, tag, schema).select(F.col("_metadata.file_path").alias("path"), parsed.alias("parsed"))
    found = found.groupBy("path").agg(F.count_if("parsed").alias("n_good"), F.count_if(~F.col("parsed")).alias("n_broken"))
    both = held.join(found, "path", "left").fillna(0, ["n_good", "n_broken"]).withColumn("n_tags", F.col("n_tags") + F.col("_split"))
    open_ = ~F.coalesce(F.col("_last").endswith(F.concat(F.lit("</"), F.col("_root"), F.lit(">"))) | F.col("_last").endswith("/>"), F.lit(False))
    reasons = [F.when(F.col("n_broken") > 0, "records do not parse"), F.when(F.col("n_good") + F.col("n_broken") < F.col("n_tags"), "records are missing"), F.when(open_, "the file is cut off")]
    match = F.nullif(F.regexp_extract("path", r"DFL-MAT-([A-Za-z0-9]+)", 1), F.lit(""))
    out = both.withColumn("reason", F.array_join(F.array_compact(F.array(*reasons)), "; ")).where("reason <> ''")
    return out.select("path", match.alias("match_id"), "n_tags", "n_good", "n_broken", "reason")


def read_positions(spark: SparkSession, path: str, roster: DataFrame | None = None, shift: tuple[float, float] = (0.0, 0.0)) -> tuple[DataFrame, DataFrame]:
    """(track, frame_state): a row for each player and frame, and the ball with possession and status for each frame.

    Referees are left out. team is the roster's role of the person where a roster is given, else the TeamId. shift moves
    the origin. A frame without a ball has no state, and a missing coordinate stays NULL.
    """
    rows = _read(spark, path, "FrameSet", POSITIONS).select(
        F.col("_MatchId").alias("match_id"), F.col("_GameSection").alias("half"), F.col("_TeamId").alias("team_id"), F.col("_PersonId").alias("person_id"), F.explode("Frame").alias("f")
    )
    rows = rows.where(F.lower(F.coalesce("team_id", F.lit(""))) != "referee")
    ball = (F.upper("team_id") == "BALL") | (F.upper("person_id") == "BALL")
    x, y = F.nanvl("f._X", F.lit(None)) + shift[0], F.nanvl("f._Y", F.lit(None)) + shift[1]
    at = ["match_id", "half", F.col("f._N").alias("frame")]
    state = rows.where(ball).select(*at, F.col("f._BallPossession").alias("poss"), F.col("f._BallStatus").alias("ball_status"), x.alias("ball_x"), y.alias("ball_y"))
    track = rows.where(~ball).select(*at, "team_id", "person_id", x.alias("x"), y.alias("y"), F.col("f._S").alias("speed"))
    if roster is not None:
        track = track.join(roster.select("person_id", F.col("role").alias("_role")).distinct(), "person_id", "left")
    else:
        track = track.withColumn("_role", F.lit(None).cast("string"))
    return track.withColumn("team", F.coalesce("_role", "team_id")).drop("_role"), state


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """(team_id, team_name, role, person_id, jid, name, position, starting) of both teams; a jid that is no number is NULL."""
    rows = _read(spark, path, "Team", TEAM).where("_TeamId IS NOT NULL").select("_TeamId", "_TeamName", "_Role", F.explode("Players.Player").alias("p"))
    role = F.when(F.lower("_Role") == "home", "Home").when(F.lower("_Role").isin("guest", "away"), "Away")
    return rows.select(
        F.col("_TeamId").alias("team_id"), F.col("_TeamName").alias("team_name"), role.alias("role"), F.col("p._PersonId").alias("person_id"),
        F.col("p._ShirtNumber").try_cast("int").alias("jid"), display_name(F.col("p._Shortname"), F.col("p._FirstName"), F.col("p._LastName"), F.col("p._PersonId")).alias("name"),
        F.col("p._PlayingPosition").alias("position"), (F.lower("p._Starting") == "true").alias("starting"),
    )


def read_clock(spark: SparkSession, path: str) -> DataFrame:
    """(match_id, kickoff, first_half_end): kick-off plus the first half's length, or 50 minutes where it isn't told."""
    rows = _read(spark, path, "MatchInformation", MATCH)
    kick = F.try_to_timestamp("General._KickoffTime")
    end = F.timestamp_add("MILLISECOND", F.coalesce("OtherGameInformation._TotalTimeFirstHalf", F.lit(50 * 60_000)), kick)
    return rows.select(F.col("General._MatchId").alias("match_id"), kick.alias("kickoff"), end.alias("first_half_end"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A row for each Event with its time in UTC and a struct for each tag; events without a time have a NULL ts."""
    return _timed(_read(spark, path, "Event", EVENTS))


def parse_events(df: DataFrame, column: str) -> DataFrame:
    """read_events() of Event elements in a column, one a row, as a feed or a landed table has them; other columns go."""
    return _timed(df.select(F.from_xml(column, EVENTS, {"mode": "PERMISSIVE"}).alias("e")).select("e.*"))


def _timed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts", F.try_to_timestamp("_EventTime")).withColumnRenamed("_MatchId", "match_id").drop("_EventTime")


def event_contacts(events: DataFrame) -> DataFrame:
    """(match_id, ts, person_id, role, tag): everyone an event names, once for each time and role."""
    plays = F.concat(
        F.when(F.col("Play").isNotNull(), F.array(F.struct(F.col("Play._Player").alias("p"), F.col("Play._Recipient").alias("r"), F.lit("Play").alias("t")))).otherwise(F.array()),
        *[F.coalesce(_plays(t), F.array()) for t in PLAY_TAGS],
    )

    def one(person, role: str, tag: str):
        return F.struct(person.alias("person_id"), F.lit(role).alias("role"), F.lit(tag).alias("tag"))

    held = "withBallControl"
    single = [
        one(F.col("OtherBallAction._Player"), "ball_action", "OtherBallAction"), one(F.col("BallClaiming._Player"), "ball_claim", "BallClaiming"),
        one(F.when(F.col("TacklingGame._WinnerRole") == held, F.col("TacklingGame._Winner")), "duel_winner", "TacklingGame"),
        one(F.when(F.col("TacklingGame._LoserRole") == held, F.col("TacklingGame._Loser")), "duel_loser", "TacklingGame"),
        *[one(F.col(f"{t}._Player"), "shooter", t) for t in SHOT_TAGS], one(F.col("Foul._Fouled"), "fouled", "Foul"),
    ]
    passes = F.transform(plays, lambda p: F.struct(p["p"].alias("person_id"), F.lit("passer").alias("role"), p["t"].alias("tag")))
    gets = F.transform(plays, lambda p: F.struct(p["r"].alias("person_id"), F.lit("recipient").alias("role"), p["t"].alias("tag")))
    rows = events.where("ts IS NOT NULL").select("match_id", "ts", F.explode(F.concat(passes, gets, F.array(*single))).alias("c")).select("match_id", "ts", "c.*")
    return first_of(rows.where("person_id IS NOT NULL"), ["match_id", "ts", "person_id", "role"], ["tag"])


def _plays(tag: str):
    return F.transform(F.col(f"{tag}.Play"), lambda p: F.struct(p["_Player"].alias("p"), p["_Recipient"].alias("r"), F.lit(tag).alias("t")))


def _shots(events: DataFrame) -> DataFrame:
    """Every shot of an event as s, with the tag that it stands in: its own, or that of the set piece around it."""
    own = [(t, F.col(t)) for t in SHOT_TAGS] + [(t, F.col(f"{t}.ShotAtGoal")) for t in (*PLAY_TAGS, "Penalty")]
    shots = F.array(*[F.when(s.isNotNull(), F.struct(s.alias("s"), F.lit(t).alias("tag"))) for t, s in own])
    return events.select("match_id", "ts", F.explode(F.array_compact(shots)).alias("_shot")).select("match_id", "ts", "_shot.*")


def event_goals(events: DataFrame) -> DataFrame:
    """(match_id, ts, team, player) of shots that hold a successful one, nested in set pieces or not."""
    rows = _shots(events)
    return rows.where("s.SuccessfulShot IS NOT NULL").select("match_id", "ts", F.col("s._Team").alias("team"), F.col("s._Player").alias("player"))


def event_shots(events: DataFrame) -> DataFrame:
    """(match_id, ts, team, player) of all shots, nested or not."""
    return _shots(events).select("match_id", "ts", F.col("s._Team").alias("team"), F.col("s._Player").alias("player"))
