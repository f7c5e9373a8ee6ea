"""Tracking, event, annotation and formation tables as views of the shared test tables, in Spark and as SQL.

Coordinates are integers, so that both engines segment at the same rows. A match has 22 players, so matches grow with the
tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A player in one half of one match.
K = ["match_id", "half", "team", "player_id"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of track that a task sorts, on average.
TASK_ROWS = 250_000
#: How many times as many tasks take the blocks of intervals, which overlap.
INTERVAL_PARTS = 4


def parts(spark: SparkSession, sf_dir: str) -> int:
    """The number of tasks for work on track: it grows with the table, so that a task doesn't."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // TASK_ROWS))


def track(spark: SparkSession, sf_dir: str, by: list[str] = K, times: int = 1) -> DataFrame:
    """(K, frame, x, y, poss): a row for each player and frame, dealt by K, or those of it that name a series, to times parts() tasks."""
    li = table(spark, sf_dir, "lineitem")
    named = li.withColumns({
        "match_id": F.floor(F.col("l_suppkey") / 22), "half": F.col("l_linestatus"),
        "team": F.when(F.col("l_suppkey") % 2 == 0, "Home").otherwise("Away"), "player_id": F.col("l_suppkey"),
    })
    order = Window.partitionBy(*K).orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    return named.repartition(times * parts(spark, sf_dir), *by).select(
        *K, (F.row_number().over(order) - 1).cast("long").alias("frame"),
        F.round((F.col("l_quantity") - 25.5) * 2).cast("long").alias("x"), F.round((F.col("l_discount") - 0.05) * 600).cast("long").alias("y"),
        F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(0).cast("long").alias("poss"),
    )


def last_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(half, last_frame) of track(), whose frames go from 0 in each series: by counts, without making them."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.col("l_linestatus").alias("half")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("half").agg((F.max("n") - 1).alias("last_frame"))


TRACK = """track AS (SELECT l_suppkey // 22 AS match_id, l_linestatus AS half, CASE WHEN l_suppkey % 2 = 0 THEN 'Home' ELSE 'Away' END AS team, l_suppkey AS player_id,
  row_number() OVER (PARTITION BY l_suppkey, l_linestatus ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) - 1 AS frame,
  CAST(round((l_quantity - 25.5) * 2) AS BIGINT) AS x, CAST(round((l_discount - 0.05) * 600) AS BIGINT) AS y,
  CASE l_returnflag WHEN 'R' THEN 1::BIGINT WHEN 'A' THEN 2::BIGINT ELSE 0::BIGINT END AS poss FROM lineitem)"""

#: Speed by central differences over the integer track, 0.05 m/s a unit; one-sided at a series' ends.
SPEED = """speed AS (SELECT t.*, 0.05 * sqrt(CAST(dx * dx + dy * dy AS DOUBLE)) AS v FROM (SELECT *,
  coalesce(lead(x) OVER w, 2 * x - lag(x) OVER w, x) - coalesce(lag(x) OVER w, 2 * x - lead(x) OVER w, x) AS dx,
  coalesce(lead(y) OVER w, 2 * y - lag(y) OVER w, y) - coalesce(lag(y) OVER w, 2 * y - lead(y) OVER w, y) AS dy
  FROM track WINDOW w AS (PARTITION BY match_id, half, team, player_id ORDER BY frame)) t)"""


def player(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(xid, name, position, jid, nation): the roster, a row for each player."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("xid"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 11 == 0, "TW").otherwise("FP").alias("position"), (F.col("s_suppkey") % 23).alias("jid"))


PLAYER = "player AS (SELECT s_suppkey AS xid, s_name AS name, CASE WHEN s_suppkey % 11 = 0 THEN 'TW' ELSE 'FP' END AS position, s_suppkey % 23 AS jid FROM supplier)"


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(player_id, frame, v): one series for each user."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("player_id"), (F.row_number().over(order) - 1).cast("long").alias("frame"), F.col("value").alias("v"), "event_type")


SIGNAL = "signal AS (SELECT user_id AS player_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value AS v, event_type FROM events)"


def match_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, match_id, half, elapsed, frame, team, kind, player_id): events within halves, a day counting as a second."""
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    return e.select("event_id", F.floor(F.col("user_id") / 22).alias("match_id"), F.when(F.dayofmonth("ts") <= 15, "F").otherwise("O").alias("half"),
        (F.pmod(day, F.lit(7)) * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("long").alias("elapsed"),
        F.when(F.col("user_id") % 2 == 0, "Home").otherwise("Away").alias("team"), F.col("event_type").alias("kind"), F.col("user_id").alias("player_id"))


EVENT = """event AS (SELECT event_id, user_id // 22 AS match_id, CASE WHEN day(ts) <= 15 THEN 'F' ELSE 'O' END AS half,
  (((date_diff('day', DATE '1995-01-01', CAST(ts AS DATE)) % 7 + 7) % 7) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts))::BIGINT AS elapsed,
  CASE WHEN user_id % 2 = 0 THEN 'Home' ELSE 'Away' END AS team, event_type AS kind, user_id AS player_id FROM events)"""


def annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(segment_id, half, annotator, team, jid, start_frame, end_frame): intervals drawn by three annotators."""
    o = table(spark, sf_dir, "orders")
    start = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    return o.select(F.col("o_orderkey").alias("segment_id"), F.when(F.col("o_custkey") % 4 < 2, "F").otherwise("O").alias("half"), F.concat(F.lit("ann"), (F.col("o_orderkey") % 3).cast("string")).alias("annotator"),
        F.when(F.col("o_custkey") % 2 == 0, "Home").otherwise("Away").alias("team"), F.col("o_custkey").alias("jid"), start.alias("start_frame"), (start + 1 + F.col("o_orderkey") % 30 * 7).alias("end_frame"))


ANNOT = """annot AS (SELECT o_orderkey AS segment_id, CASE WHEN o_custkey % 4 < 2 THEN 'F' ELSE 'O' END AS half, 'ann' || (o_orderkey % 3)::VARCHAR AS annotator,
  CASE WHEN o_custkey % 2 = 0 THEN 'Home' ELSE 'Away' END AS team, o_custkey AS jid, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS start_frame,
  date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) + 1 + o_orderkey % 30 * 7 AS end_frame FROM orders)"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(match_id, half, annotator, segment_id, team, jid, start_frame, end_frame): annotation() as files have it.

    A match has 22 players, so matches grow with the table; ids restart at 0 in each file, that is for each match, half and
    annotator.
    """
    a = annotation(spark, sf_dir).withColumns({"match_id": F.floor(F.col("jid") / 22), "jid": F.col("jid") % 22})
    own = Window.partitionBy("match_id", "half", "annotator").orderBy("start_frame", "segment_id")
    return a.withColumn("segment_id", (F.row_number().over(own) - 1).cast("long")).select("match_id", "half", "annotator", "segment_id", "team", "jid", "start_frame", "end_frame")


NOTES = """notes AS (SELECT jid // 22 AS match_id, half, annotator, row_number() OVER (PARTITION BY jid // 22, half, annotator ORDER BY start_frame, segment_id) - 1 AS segment_id,
  team, jid % 22 AS jid, start_frame, end_frame FROM annot)"""


def owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """annotation() with the player (by jid, over all of them) and frames within the first 300."""
    n, start = table(spark, sf_dir, "supplier").count(), F.col("start_frame") % 300
    return annotation(spark, sf_dir).select("segment_id", "half", "annotator", "team", "jid", (F.col("jid") % n).alias("player_id"), start.alias("start_frame"), (start + (F.col("end_frame") - F.col("start_frame")) % 40).alias("end_frame"))


OWNED = """owned AS (SELECT segment_id, half, annotator, team, jid, jid % (SELECT count(*) FROM supplier) AS player_id, start_frame % 300 AS start_frame, start_frame % 300 + (end_frame - start_frame) % 40 AS end_frame FROM annot)"""


def formation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, team, player_id, position, x, y, vx, vy): an order's lines as the players of one frame, dealt by frame to parts() tasks."""
    li = table(spark, sf_dir, "lineitem").repartition(parts(spark, sf_dir), "l_orderkey")
    named = li.groupBy(F.col("l_orderkey").alias("frame"), F.col("l_suppkey").alias("player_id")).agg(F.min("l_quantity").alias("q"), F.min("l_discount").alias("d"), F.min("l_tax").alias("t"))
    return named.select("frame", F.when(F.col("player_id") % 2 == 0, "Home").otherwise("Away").alias("team"), "player_id", F.when(F.col("player_id") % 11 == 0, "TW").otherwise("FP").alias("position"),
        F.round((F.col("q") - 25.5) * 2).cast("long").alias("x"), F.round((F.col("d") - 0.05) * 600).cast("long").alias("y"), (F.round(F.col("t") * 100).cast("long") - 4).alias("vx"), (F.col("player_id") % 5 - 2).alias("vy"))


FORMATION = """formation AS (SELECT frame, CASE WHEN player_id % 2 = 0 THEN 'Home' ELSE 'Away' END AS team, player_id, CASE WHEN player_id % 11 = 0 THEN 'TW' ELSE 'FP' END AS position,
  CAST(round((q - 25.5) * 2) AS BIGINT) AS x, CAST(round((d - 0.05) * 600) AS BIGINT) AS y, CAST(round(t * 100) AS BIGINT) - 4 AS vx, player_id % 5 - 2 AS vy
  FROM (SELECT l_orderkey AS frame, l_suppkey AS player_id, min(l_quantity) AS q, min(l_discount) AS d, min(l_tax) AS t FROM lineitem GROUP BY ALL))"""
