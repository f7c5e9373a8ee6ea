"""Looking up players by shirt number, person or name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def person_by_shirt(df: DataFrame, people: DataFrame) -> DataFrame:
    """person_id by (team, jid), or else by jid alone; of several people the largest id counts."""
    both = people.groupBy("team", "jid").agg(F.max("person_id").alias("_p1"))
    one = people.groupBy("jid").agg(F.max("person_id").alias("_p2"))
    return df.join(both, ["team", "jid"], "left").join(one, "jid", "left").withColumn("person_id", F.coalesce("_p1", "_p2")).drop("_p1", "_p2")


def position_of(df: DataFrame, people: DataFrame) -> DataFrame:
    """position by person_id, or else of the first person with that jid."""
    by_jid = people.groupBy("jid").agg(F.min_by("position", "person_id").alias("_p2"))
    by_id = people.groupBy("person_id").agg(F.min("position").alias("_p1"))
    return df.join(by_id, "person_id", "left").join(by_jid, "jid", "left").withColumn("position", F.coalesce("_p1", "_p2")).drop("_p1", "_p2")


def person_map(people: DataFrame, person: str, xid: str = "xid") -> DataFrame:
    return people.where(F.col(xid).isNotNull()).select(person, xid).distinct()


def player_named(people: DataFrame, name: str) -> DataFrame:
    """The player of exactly that name; an error where there is none."""
    got = people.where(F.col("name") == name)
    if got.isEmpty():
        raise LookupError(f"no player named {name}")
    return got
