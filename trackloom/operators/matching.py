"""Matching intervals one to one, and agreement statistics over the matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import frames_to_timecode, overlap, temporal_iou
from .intervals import range_join
from .lineage import checkpointed
from .profiles import with_quantiles
from .series import spread


def _sides(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    a = left.select(*keys, *[F.col(c).alias(f"a_{c}") for c in ("id", "start", "end")])
    b = right.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("id", "start", "end")])
    return a, b


def _starts_in(points: DataFrame, spans: DataFrame, keys: list[str], names: str, reach: int = 0, width: int = 256) -> DataFrame:
    """Pairs of _sides() where one side starts in the other's interval, widened by reach: by buckets, not all of a key's pairs."""
    p, s = names
    return range_join(points, spans, keys, F.col(f"{p}_start"), F.col(f"{s}_start") - reach, F.col(f"{s}_end") + reach, width)


def _touching(a: DataFrame, b: DataFrame, keys: list[str], reach: int = 0, width: int = 256, parts: int | None = None) -> DataFrame:
    """Pairs of _sides() that overlap or lie at most reach apart, by one join.

    Both go to the buckets that they and the reach behind them cover; a pair counts in the bucket of its later start.
    """
    a, b = (df.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(f"{n}_start") / width), F.floor((F.col(f"{n}_end") + reach) / width)))) for df, n in ((a.where("a_start <= a_end"), "a"), (b.where("b_start <= b_end"), "b")))
    a, b = (spread(df, parts, *keys, "_bucket") for df in (a, b))
    near = (F.col("a_start") <= F.col("b_end") + reach) & (F.col("b_start") <= F.col("a_end") + reach)
    return a.join(b, [*keys, "_bucket"]).where(near & (F.col("_bucket") == F.floor(F.greatest("a_start", "b_start") / width))).drop("_bucket")


def intervals(df: DataFrame, keys: list[str], id_: str = "segment_id", held: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keys, F.col(id_).alias("id"), F.col("start_frame").alias("start"), F.col("end_frame").alias("end"), *held)


def _take_free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group, served, used = None, None, set()
    for batch in batches:
        kept = np.zeros(batch.num_rows, dtype=bool)
        for i, (g, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_g", "a_id", "b_id")), strict=True)):
            if g != group:
                group, served, used = g, None, set()
            if a != served and b not in used:
                kept[i], served = True, a
                used.add(b)
        yield batch.filter(pa.array(kept))


def greedy_match(candidates: DataFrame, keys: list[str], best_first: Column) -> DataFrame:
    """Candidates that are taken: each a, by start and id, takes its best free b; every b is taken once.

    best_first orders an a's candidates ascending, then b's start and id. Candidates are sorted by key and a, and read as a
    stream that remembers the ids taken in the key at hand, so a key's rows are never held together.
    """
    rows = candidates.withColumns({"_p": best_first, "_g": F.xxhash64(*keys)}).repartition(*keys)
    rows = rows.sortWithinPartitions(*keys, "a_start", "a_id", "_p", "b_start", "b_id")
    return rows.mapInArrow(_take_free, rows.schema).drop("_p", "_g")


def tolerance_match(predicted: DataFrame, truth: DataFrame, keys: list[str], tolerance: int = 25) -> DataFrame:
    """(keys, a_id, b_id) one to one, first fit: either start lies in the other's interval widened by tolerance."""
    a, b = _sides(predicted, truth, keys)
    inside = [F.col(f"{p}_start").between(F.col(f"{s}_start") - tolerance, F.col(f"{s}_end") + tolerance) for p, s in ("ab", "ba")]
    near = _touching(a, b, keys, tolerance).where(inside[0] | inside[1])
    return greedy_match(near, keys, F.lit(0)).select(*keys, "a_id", "b_id")


def overlap_match(left: DataFrame, right: DataFrame, keys: list[str], tolerance: int = 0) -> DataFrame:
    """One-to-one, largest overlap first: b starts inside a. Adds iou, d_start and d_end."""
    a, b = _sides(left, right, keys)
    common = overlap(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))
    return greedy_match(_starts_in(b, a, keys, "ba", tolerance), keys, -common).withColumns({
        "iou": temporal_iou(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end")),
        "d_start": F.abs(F.col("a_start") - F.col("b_start")), "d_end": F.abs(F.col("a_end") - F.col("b_end")),
    })


def best_iou_match(annotations: DataFrame, segments: DataFrame, keys: list[str], least: float = 0.01) -> DataFrame:
    """Each annotation's segment of largest IoU, the smallest id on ties; NULL where none reaches least."""
    top = best_iou_segments(annotations, segments, keys, least)
    return annotations.select(*keys, F.col("id").alias("a_id")).join(top, [*keys, "a_id"], "left").select(*keys, "a_id", "b_id", "iou")


def best_iou_segments(annotations: DataFrame, segments: DataFrame, keys: list[str], least: float = 0.01, held: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """(keys, a_id, b_id, iou, held) of best_iou_match() where there is one; held are further columns of segments, parts the number of tasks."""
    a, b = _sides(annotations, segments, keys)
    b = b if not held else segments.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("id", "start", "end")], *held)
    both = _touching(a, b, keys, parts=parts).where((F.col("b_start") < F.col("a_end")) & (F.col("b_end") > F.col("a_start")))
    both = both.withColumn("iou", temporal_iou(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end"))).where(F.col("iou") >= least)
    both = spread(both.select(*keys, "a_id", "b_id", "iou", *held), parts, *keys, "a_id")
    top = both.groupBy(*keys, "a_id").agg(F.max_by(F.struct("b_id", "iou", *held), F.struct("iou", -F.col("b_id"))).alias("m"))
    return top.select(*keys, "a_id", *[F.col(f"m.{c}").alias(c) for c in ("b_id", "iou", *held)])


def _listed(rows: DataFrame, own: list[str], found: DataFrame, named: int | None) -> DataFrame:
    """rows with n_matches and the ids found for them, the smallest first, in columns match_idx_1 and on: named, or as many as the most."""
    got = found.groupBy(*own).agg(F.count(F.lit(1)).alias("n_matches"), F.sort_array(F.collect_list("b_id")).alias("ids"))
    if named is None:
        got = checkpointed(got)
        named = got.agg(F.max("n_matches")).first()[0] or 0
    out = rows.join(got, own, "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))
    return out.withColumns({f"match_idx_{i + 1}": F.get("ids", F.lit(i)) for i in range(named)}).drop("ids")


def window_matches(left: DataFrame, right: DataFrame, keys: list[str], reach: int, named: int | None = 3) -> DataFrame:
    """All b that start within reach of an a: (keys, a_id, n_matches, match_idx_1 and on). named=None gives a column for each match."""
    a, b = _sides(left, right, keys)
    return _listed(a.select(*keys, "a_id"), [*keys, "a_id"], _starts_in(b, a, keys, "ba", reach), named)


def tag_matches(tags: DataFrame, movements: DataFrame, reach: int, named: int | None = None) -> DataFrame:
    """tags with the movements of the same shirt in whose interval, widened by reach, they start; ids in columns as _listed() has them.

    tags: tag_id, jid, team, start_frame; movements: movement_id, jid, team, start_frame, end_frame. A tag's team need only
    be part of the movement's, as names differ by source. A tag without shirt, team or start finds nothing.
    """
    points = tags.select("jid", F.col("tag_id").alias("_id"), F.col("team").alias("_team"), F.col("start_frame").alias("a_start")).dropna()
    spans = movements.select("jid", F.col("movement_id").alias("b_id"), F.col("team").alias("_of"), F.col("start_frame").alias("b_start"), F.col("end_frame").alias("b_end"))
    found = _starts_in(points, spans, ["jid"], "ab", reach).where(F.contains("_of", "_team")).withColumnRenamed("_id", "tag_id")
    return _listed(tags, ["tag_id"], found, named)


def annotator_pairs(annotations: DataFrame, by: list[str]) -> DataFrame:
    """(by, annotator_a, annotator_b) with a < b, and how many segments each has there."""
    n = annotations.groupBy(*by, "annotator").agg(F.count(F.lit(1)).alias("n"))
    a = n.select(*by, F.col("annotator").alias("annotator_a"), F.col("n").alias("n_a"))
    b = n.select(*by, F.col("annotator").alias("annotator_b"), F.col("n").alias("n_b"))
    return a.join(b, by).where("annotator_a < annotator_b")


def directed_matches(annotations: DataFrame, by: list[str], tolerance: int = 0) -> DataFrame:
    """overlap_match() of all ordered pairs of annotators: (by, jid, annotator_a, annotator_b, a_id, b_id, iou, d_start, d_end)."""
    names = annotations.select(*by, "annotator").distinct()
    pairs = names.join(names.withColumnRenamed("annotator", "other"), by).where("annotator <> other")
    a = annotations.join(pairs, [*by, "annotator"])
    left = a.withColumns({"annotator_a": F.col("annotator"), "annotator_b": F.col("other")})
    right = a.withColumns({"annotator_a": F.col("other"), "annotator_b": F.col("annotator")})
    keys = [*by, "jid", "annotator_a", "annotator_b"]
    return overlap_match(intervals(left, keys), intervals(right, keys), keys, tolerance)


def pair_stats(annotations: DataFrame, matches: DataFrame, by: list[str]) -> DataFrame:
    """Agreement of each unordered pair: counts, recalls, mean and population std of edge differences, mean IoUs.

    Means are over matches from a to b; mean_iou_all counts an unmatched segment of a as 0.
    """
    pairs = annotator_pairs(annotations, by)
    ab = matches.where("annotator_a < annotator_b").groupBy(*by, "annotator_a", "annotator_b").agg(
        F.count(F.lit(1)).alias("n_ab"), F.avg("d_start").alias("mean_d_start"), F.stddev_pop("d_start").alias("std_d_start"),
        F.avg("d_end").alias("mean_d_end"), F.stddev_pop("d_end").alias("std_d_end"), F.avg("iou").alias("mean_iou_matched"), F.sum("iou").alias("sum_iou"),
    )
    ba = matches.where("annotator_a > annotator_b").groupBy(*by, F.col("annotator_b").alias("annotator_a"), F.col("annotator_a").alias("annotator_b")).agg(F.count(F.lit(1)).alias("n_ba"))
    key = [*by, "annotator_a", "annotator_b"]
    out = pairs.join(ab, key, "left").join(ba, key, "left").fillna(0, ["n_ab", "n_ba"])
    return out.withColumns({
        "recall_a": F.try_divide(F.col("n_ab") * 100.0, F.col("n_a")), "recall_b": F.try_divide(F.col("n_ba") * 100.0, F.col("n_b")),
        "mean_iou_all": F.coalesce(F.col("sum_iou"), F.lit(0.0)) / F.col("n_a"),
    }).drop("sum_iou")


def evaluation(predicted: DataFrame, truth: DataFrame, matches: DataFrame, by: list[str], total: list[str]) -> DataFrame:
    """tp, fp, fn, precision and recall by groups and, with NULLs in the other columns, their totals from summed counts.

    Groups without truth are left out.
    """
    p = predicted.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pred"))
    t = truth.groupBy(*by).agg(F.count(F.lit(1)).alias("n_true"))
    m = matches.groupBy(*by).agg(F.count(F.lit(1)).alias("tp"))
    counts = t.join(p, by, "left").join(m, by, "left").fillna(0, ["n_pred", "tp"])
    counts = counts.withColumns({"fp": F.col("n_pred") - F.col("tp"), "fn": F.col("n_true") - F.col("tp")})
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    out = counts.groupingSets([[F.col(c) for c in by], [F.col(c) for c in total]], *[F.col(c) for c in by]).agg(*sums)
    return out.withColumns({"precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", F.col("tp") + F.col("fn"))})


def global_kpis(stats: DataFrame) -> DataFrame:
    """(kpi, value): means over pairs of pair_stats(), recalls of both directions together."""
    long = stats.selectExpr("stack(5, 'recall', recall_a, 'recall', recall_b, 'd_start', mean_d_start, 'd_end', mean_d_end, 'iou', mean_iou_matched) AS (kpi, v)")
    return long.groupBy("kpi").agg(F.avg("v").alias("value"))


def match_matrix(matches: DataFrame, by: str) -> DataFrame:
    """(by, annotator_a, annotator_b, n, mean_iou) of directed matches, and 'Global' over all of by, each counting once."""
    own = matches.groupBy(by, "annotator_a", "annotator_b").agg(F.count(F.lit(1)).alias("n"), F.avg("iou").alias("mean_iou"))
    whole = own.groupBy("annotator_a", "annotator_b").agg(F.sum("n").alias("n"), F.avg("mean_iou").alias("mean_iou")).withColumn(by, F.lit("Global"))
    return own.unionByName(whole)


def iou_distribution(matches: DataFrame, by: list[str]) -> DataFrame:
    """How many matches each ordered pair has, and quartiles of their IoU."""
    own = [*by, "annotator_a", "annotator_b"]
    return with_quantiles(matches.groupBy(*own).agg(F.count(F.lit(1)).alias("n")), matches, own, "iou", {"q1_iou": 0.25, "median_iou": 0.5, "q3_iou": 0.75})


def matched_counts(annotations: DataFrame, matches: DataFrame, by: list[str]) -> DataFrame:
    """n_matched and n_unmatched segments, by their own matches."""
    hit = matches.select(*by, F.col("annotator_a").alias("annotator"), F.col("a_id").alias("segment_id")).distinct().withColumn("_hit", F.lit(True))
    both = annotations.join(hit, [*by, "annotator", "segment_id"], "left")
    return both.groupBy(*by).agg(F.count("_hit").alias("n_matched"), F.count_if(F.col("_hit").isNull()).alias("n_unmatched"))


def unmatched(df: DataFrame, matches: DataFrame, keys: list[str], id_: str = "segment_id") -> DataFrame:
    return df.join(matches.select(*keys, F.col("a_id").alias(id_)).distinct(), [*keys, id_], "left_anti")


def undirected(matches: DataFrame, by: list[str]) -> DataFrame:
    """(by, annotator_u, u, annotator_v, v): pairs found in either direction, once, the annotator of smaller name as u."""
    swap = F.col("annotator_a") > F.col("annotator_b")
    u = [F.when(swap, F.col("annotator_b")).otherwise(F.col("annotator_a")).alias("annotator_u"), F.when(swap, F.col("b_id")).otherwise(F.col("a_id")).alias("u")]
    v = [F.when(swap, F.col("annotator_a")).otherwise(F.col("annotator_b")).alias("annotator_v"), F.when(swap, F.col("a_id")).otherwise(F.col("b_id")).alias("v")]
    return matches.select(*by, *u, *v).distinct()


def isolated(annotations: DataFrame, pairs: DataFrame, by: list[str], fps: int = 25) -> DataFrame:
    """Annotations without a match in any direction, with their start, end and length as frames and as time codes."""
    linked = pairs.select(*by, F.col("annotator_u").alias("annotator"), F.col("u").alias("segment_id")).unionByName(pairs.select(*by, F.col("annotator_v").alias("annotator"), F.col("v").alias("segment_id")))
    alone = annotations.join(linked.distinct(), [*by, "annotator", "segment_id"], "left_anti").withColumn("duration_frames", F.col("end_frame") - F.col("start_frame"))
    return alone.withColumns({f"{into}": frames_to_timecode(F.col(c), fps=fps) for c, into in (("start_frame", "start_timecode"), ("end_frame", "end_timecode"), ("duration_frames", "duration_tc"))})


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (u, v): root is the smallest node that can be reached.

    Large stars hang each node's larger neighbours on its smallest one, small stars its smaller ones, by turns, until only
    stars are left: a number of rounds near the logarithm of a component's size, each over edges that were stored once. No
    node's neighbours are held together. Loops and edges with a NULL end don't count.
    """
    low, high = F.least("u", "v"), F.greatest("u", "v")
    held = checkpointed(edges.where("u <> v").select(high.alias("u"), low.alias("v")).distinct())
    while True:
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = checkpointed(down.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        if new.join(held, ["u", "v"], "left_anti").isEmpty() and held.join(new, ["u", "v"], "left_anti").isEmpty():
            return held.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(held.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        held = new


def match_groups(nodes: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, annotator, segment_id, group_annotator, group_id): groups of segments that matches link, by way of others too.

    nodes: by, annotator, segment_id; pairs as undirected() has them. A segment is known by all of these, so ids may
    restart in every file. A group is named by its smallest segment, by annotator and id; a lone segment is its own group.
    """
    node = [F.struct(*[F.col(c).alias(c) for c in by], F.col(f"annotator_{x}").alias("annotator"), F.col(x).alias("segment_id")).alias(x) for x in "uv"]
    found = components(pairs.select(*node)).select("node.*", F.col("root.annotator").alias("group_annotator"), F.col("root.segment_id").alias("group_id"))
    own = [*by, "annotator", "segment_id"]
    out = nodes.select(*own).distinct().join(found, own, "left")
    return out.select(*own, F.coalesce("group_annotator", "annotator").alias("group_annotator"), F.coalesce("group_id", "segment_id").alias("group_id"))
