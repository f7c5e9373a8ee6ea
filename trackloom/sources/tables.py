"""CSV and JSON readers with explicit schemas, file discovery, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.lineage import checkpointed

ANNOTATION = (
    "segment_id INT, half STRING, start_frame BIGINT, end_frame BIGINT, start_time_s DOUBLE, end_time_s DOUBLE, duration_s DOUBLE, "
    "player STRING, player_jid STRING, team STRING, outcome STRING, annotation_source STRING"
)
REQUIRED = ["half", "start_frame", "end_frame", "player_jid", "team"]


def validate_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_by_header(spark: SparkSession, path: str, suffix: str = ".csv") -> DataFrame:
    """(_path, and every column that any file has, as strings) of CSV files, each read by its own header.

    A file's first line names its columns, whatever their order; what a file lacks is NULL. Records are lines, in which
    quotes may hold commas. Files are read as lines in one scan: its first rows, one a file, give the headers, and lines
    meet the header of their own file. Only the names themselves and the widest header's length come to the driver.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_at"), F.regexp_replace("value", "^\ufeff", "").alias("_line"), F.monotonically_increasing_id().alias("_n"))
    lines = lines.where(F.trim("_line") != "")
    heads = lines.where("_at = 0").groupBy("_path").agg(F.min_by("_line", "_n").alias("_head"))
    widest = heads.agg(F.max(F.size(F.split("_head", ",")))).first()[0] or 1
    places = ", ".join(f"_{i} STRING" for i in range(widest))

    def fields(line: str) -> Column:
        return F.array(*[F.from_csv(line, places, {"escape": "\""})[f"_{i}"] for i in range(widest)])

    heads = checkpointed(heads.withColumn("_names", F.transform(fields("_head"), lambda name: F.trim(name))))
    names = sorted(r[0] for r in heads.select(F.explode("_names").alias("name")).where("name <> ''").distinct().collect())
    rows = lines.join(heads, "_path").where("_line <> _head").withColumn("_fields", fields("_line"))
    return rows.select("_path", *[F.try_element_at("_fields", F.nullif(F.array_position("_names", F.lit(c)).cast("int"), F.lit(0))).alias(c) for c in names])


def read_annotations(spark: SparkSession, path: str, required: list[str] = REQUIRED) -> DataFrame:
    """Annotation files of many matches at once, with match_id, half_key and annotator from their names.

    Columns are read by each file's own header, further ones are kept as strings; a player_jid that is no number becomes
    NULL. Files whose name has fewer than three parts are left out. A row that lacks a required value, or where a value
    doesn't fit its column, has in _corrupt_record what was wrong, for split_broken(); other rows have NULL there. So have
    all rows of a file that lacks a column; a column that no file has is an error.
    """
    kinds = {x.split()[0]: x.split()[1] for x in ANNOTATION.split(", ")}
    df = validate_columns(read_by_header(spark, path), required)
    own = [c for c in df.columns if c != "_path"]
    lacking = [F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in required if c not in ("player_jid", "team")]
    wrong = [F.when(F.col(c).isNotNull() & F.col(c).try_cast(kinds[c]).isNull(), F.concat(F.lit(f"{c}: "), F.col(c))) for c in own if c in kinds and kinds[c] != "STRING"]
    broken = F.nullif(F.array_join(F.array_compact(F.array(*lacking, *wrong)), "; "), F.lit("")).alias("_corrupt_record")
    name = F.url_decode(F.replace(F.element_at(F.split("_path", "/"), -1), F.lit("+"), F.lit("%2B"))).alias("_file")
    df = df.select(*[F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in own], broken, name)
    parts = F.split(F.regexp_replace("_file", r"\.csv$", ""), "_")
    df = df.where(F.size(parts) >= 3).withColumns({
        "match_id": F.regexp_replace(F.get(parts, F.lit(0)), "^DFL-MAT-", ""), "half_key": F.get(parts, F.lit(1)), "annotator": F.array_join(F.slice(parts, 3, 100), "_"),
        "player_jid": F.col("player_jid").try_cast("double").try_cast("int"),
    })
    return df.drop("_file")


def find_files(spark: SparkSession, path: str, keyword: str) -> DataFrame:
    """(path, match_id) of the files whose name holds a keyword, over all matches."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{keyword}*").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.nullif(F.regexp_extract("path", r"DFL-MAT-([A-Za-z0-9]+)", 1), F.lit("")).alias("match_id"))


def number_runs(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """segment_id from 0 within keys and excel_row (+ 2); a distributed scan has no file order, so order fixes one."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    return df.withColumn("_n", n).withColumn("segment_id", F.col("_n") - 1).withColumn("excel_row", F.col("_n") + 1).drop("_n")


def legacy_tags(df: DataFrame, mark: str, drop_marked: str, columns: list[str]) -> DataFrame:
    """Older tag tables without the rows marked as false positives and without some columns."""
    return df.where(~F.coalesce(F.col(mark).contains(drop_marked), F.lit(False))).drop(*columns)


DIRECTIONS = "MAP<STRING, STRUCT<Home: MAP<STRING, STRING>>>"
OFFSETS = "MAP<STRING, MAP<STRING, STRING>>"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value", F.from_json("value", schema).alias("got"))


def broken_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, reason, head) of files that aren't JSON of that schema, or hold nothing, with how they begin."""
    files = _json(spark, path, schema).withColumn("reason", F.when(F.col("got").isNull(), "not the JSON that is expected").when(F.size("got") == 0, "holds nothing"))
    return files.where("reason IS NOT NULL").select("path", "reason", F.left("value", F.lit(80)).alias("head"))


def read_directions(spark: SparkSession, path: str) -> DataFrame:
    """(match_id, half, home_direction) from {match: {"Home": {half: direction}}}; broken_json() lists files that give none."""
    df = _json(spark, path, DIRECTIONS)
    return df.select(F.explode("got").alias("match_id", "m")).select("match_id", F.explode("m.Home").alias("half", "home_direction"))


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(match_id, half, offset_s) from {match: {half: "hh:mm:ss"}}; broken_json() lists files that give none."""
    from ..functions.scalar import hms_to_seconds

    df = _json(spark, path, OFFSETS).select(F.explode("got").alias("match_id", "m"))
    return df.select("match_id", F.explode("m").alias("half", "at")).select("match_id", "half", hms_to_seconds(F.col("at")).alias("offset_s"))


def with_offsets(df: DataFrame, offsets: DataFrame) -> DataFrame:
    """offset_s for each row; 0 where none is stored."""
    return df.join(offsets, ["match_id", "half"], "left").withColumn("offset_s", F.coalesce("offset_s", F.lit(0)))


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = ("match_id",), form: str = "parquet") -> None:
    """One folder for each match; CSV gets a header."""
    df.write.partitionBy(*by).option("header", True).mode("overwrite").format(form).save(path)


def land_series(df: DataFrame, name: str, keys: list[str], order: str = "frame", buckets: int = 64, path: str | None = None) -> DataFrame:
    """Stores series as a table that is dealt by keys and sorted by keys and order, and returns the table.

    Windows and joins on keys need no shuffle then, and a range of order prunes row groups. buckets should make one of some
    hundred MB. path names a folder outside the warehouse.
    """
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys, order).format("parquet").mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def split_broken(df: DataFrame, corrupt: str = "_corrupt_record") -> tuple[DataFrame, DataFrame]:
    """(good rows, broken ones with all their columns) of a scan, so that one bad match doesn't stop the others."""
    return df.where(F.col(corrupt).isNull()).drop(corrupt), df.where(F.col(corrupt).isNotNull())


def write_trajectories(track: DataFrame, movements: DataFrame, people: DataFrame, keys: list[str], path: str, by: tuple[str, ...] = ("match_id", "team", "player_id")) -> None:
    """The rows of track within movements, with run_frame (from 0 in each) and the roster's columns, in folders by player.

    movements: keys, movement_id, start_frame, end_frame; people: xid and further columns.
    """
    from ..operators.intervals import range_join

    spans = movements.select(*keys, "movement_id", F.col("start_frame").alias("_from"), F.col("end_frame").alias("_to"))
    rows = range_join(track, spans, keys, F.col("frame"), F.col("_from"), F.col("_to"), 256)
    rows = rows.withColumn("run_frame", F.col("frame") - F.col("_from")).drop("_from", "_to")
    write_table(rows.join(people.withColumnRenamed("xid", "player_id"), "player_id", "left"), path, by)
