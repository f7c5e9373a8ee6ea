"""Frequency tables, descriptions, histograms and column profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import checkpointed


def frequencies(df: DataFrame, by: list[str]) -> DataFrame:
    """Count and percentage of all rows by groups."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def quantiles(df: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """(by, a column for each of at): exact quantiles of known values by groups, between two values by their distance.

    Equal values are counted first; counts are dealt by ranges of group and value and summed up within, so that a group's
    values are spread over many tasks and none holds them. A quantile is then the least value with enough values up to it.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    dealt = checkpointed(counts.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id()))
    own = Window.partitionBy(*by)
    before = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_part", *by).agg(F.sum("_c").alias("_c"))
    sizes = sizes.select(F.col("_part").alias("_of"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_ahead"), F.sum("_c").over(own).alias("_n"))
    same = dealt["_part"] == sizes["_of"]
    for i, c in enumerate(by):
        same = same & dealt[c].eqNullSafe(sizes[f"_by{i}"])
    upto = F.col("_ahead") + F.sum("_c").over(Window.partitionBy("_part", *by).orderBy("_v"))
    rows = dealt.join(sizes, same).withColumn("_upto", upto)
    ends = {f"_{name}_{side}": F.min(F.when(F.col("_upto") > of(q * (F.col("_n") - 1)), F.col("_v"))) for name, q in at.items() for side, of in (("low", F.floor), ("high", F.ceil))}
    out = rows.groupBy(*by).agg(F.first("_n").alias("_n"), *[c.alias(n) for n, c in ends.items()])
    place = {name: q * (F.col("_n") - 1) for name, q in at.items()}
    return out.select(*by, *[(F.col(f"_{n}_low") + (F.col(f"_{n}_high") - F.col(f"_{n}_low")) * (x - F.floor(x))).alias(n) for n, x in place.items()])


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, sample std, least, quartiles and most of known values by groups; a group without any has NULLs."""
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"))
    return with_quantiles(out, df, by, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75})


def with_quantiles(groups: DataFrame, df: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """groups (a row for each by) with quantiles() of df."""
    found = quantiles(df, by, value, at).withColumnsRenamed({c: f"_by{i}" for i, c in enumerate(by)})
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & groups[c].eqNullSafe(found[f"_by{i}"])
    return groups.join(found, same, "left").drop(*[f"_by{i}" for i in range(len(by))])


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) of values in [low, high]; the last bin holds high."""
    at = F.least(F.floor((F.col(value) - low) * bins / (high - low)), F.lit(bins - 1)).cast("long")
    return df.where(F.col(value).between(low, high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def column_profile(df: DataFrame, column: str, shown: int = 30) -> DataFrame:
    """One row: n, n_distinct, the first distinct values, and least, most and mean as numbers where they are some.

    The shown values come from a top-k of distinct ones, so no set of all values is held anywhere.
    """
    number = F.col(column).cast("string").try_cast("double")
    sums = df.agg(F.count(column).alias("n"), F.count_distinct(column).alias("n_distinct"), F.min(number).alias("least"), F.max(number).alias("most"), F.avg(number).alias("mean"))
    few = df.select(F.col(column).cast("string").alias("_v")).where("_v IS NOT NULL").distinct().orderBy("_v").limit(shown).agg(F.sort_array(F.collect_list("_v")).alias("shown"))
    return sums.crossJoin(few).withColumn("type", F.lit(dict(df.dtypes)[column]))


def ranked(df: DataFrame, order: list[Column], into: str = "place") -> DataFrame:
    """Places from 1 over the whole table: rows are dealt by ranges of order and counted within, so no task gets them all.

    order should tell all rows apart. The dealing samples the table, so it is checkpointed.
    """
    dealt = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    dealt = dealt.join(F.broadcast(sizes.select("_part", ahead.alias("_ahead"))), "_part")
    return dealt.withColumn(into, F.col("_ahead") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))).drop("_part", "_ahead")
