"""Queries of one-to-one matching and agreement."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import matching as M
from ..operators import series
from ..operators.predicates import with_provenance
from ..sources import views as V
from . import jobs
from .base import query, r6
from .interval_queries import CONTEXT_OUT, GAME, INDICATORS, _match_frames
from .row_queries import IOU
from .series_queries import MOVES, TS, VALLEYS, _movements

KEYS = ["half", "team", "jid"]
#: Greedy one-to-one assignment over candidate rows (g, a, a_start, b, b_start, p): each a, by start and id, its best free b.
GREEDY = """tried AS (SELECT g, a, a_start, list({'a': a, 'b': b} ORDER BY p, b_start, b) AS c FROM cand GROUP BY g, a, a_start),
taken AS (SELECT g, unnest(list_reduce(list_concat([[{'a': 0::BIGINT, 'b': 0::BIGINT}][1:0]], list(c ORDER BY a_start, a)), lambda s, c: CASE WHEN len(list_filter(c, lambda k: NOT list_contains(list_transform(s, lambda z: z.b), k.b))) > 0
  THEN list_concat(s, list_filter(c, lambda k: NOT list_contains(list_transform(s, lambda z: z.b), k.b))[1:1]) ELSE s END)) AS p FROM tried GROUP BY g)"""

TOL = f"""cand AS (SELECT {{'half': a.half, 'team': a.team, 'jid': a.jid}} AS g, a.segment_id AS a, a.start_frame AS a_start, b.segment_id AS b, b.start_frame AS b_start, 0 AS p
  FROM annot a JOIN annot b ON a.half = b.half AND a.team = b.team AND a.jid = b.jid AND a.annotator = 'ann0' AND b.annotator = 'ann1'
  WHERE a.start_frame BETWEEN b.start_frame - 25 AND b.end_frame + 25 OR b.start_frame BETWEEN a.start_frame - 25 AND a.end_frame + 25), {GREEDY}"""


def _tolerance(spark, d):
    a = V.annotation(spark, d)
    left, right = a.where("annotator = 'ann0'"), a.where("annotator = 'ann1'")
    return left, right, M.tolerance_match(M.intervals(left, KEYS), M.intervals(right, KEYS), KEYS)


@query("j9_tolerance_match", f"WITH {V.ANNOT}, {TOL} SELECT p.a AS a_id, p.b AS b_id FROM taken")
def j9(spark, d):
    return _tolerance(spark, d)[2].select("a_id", "b_id")


@query("a5_precision_recall", f"""WITH {V.ANNOT}, {TOL}, t AS (SELECT half, team, count(*) AS nt FROM annot WHERE annotator = 'ann1' GROUP BY ALL), q AS (SELECT half, team, count(*) AS np FROM annot WHERE annotator = 'ann0' GROUP BY ALL), m AS (SELECT g.half AS half, g.team AS team, count(*) AS tp FROM taken GROUP BY ALL),
c AS (SELECT half, team, coalesce(tp, 0) AS tp, coalesce(np, 0) - coalesce(tp, 0) AS fp, nt - coalesce(tp, 0) AS fn FROM t LEFT JOIN q USING (half, team) LEFT JOIN m USING (half, team))
SELECT half, team, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(sum(tp) / sum(tp + fp), 6) + 0.0 AS precision, round(sum(tp) / sum(tp + fn), 6) + 0.0 AS recall FROM c GROUP BY GROUPING SETS ((half, team), (half))""")
def a5(spark, d):
    left, right, m = _tolerance(spark, d)
    return M.evaluation(left, right, m, ["half", "team"], ["half"]).select("half", "team", "tp", "fp", "fn", r6("precision"), r6("recall"))


DIRECTED = f"""cand AS (SELECT {{'half': a.half, 'jid': a.jid, 'x': a.annotator, 'y': b.annotator}} AS g, a.segment_id AS a, a.start_frame AS a_start, b.segment_id AS b, b.start_frame AS b_start, greatest(a.start_frame, b.start_frame) - least(a.end_frame, b.end_frame) AS p
  FROM annot a JOIN annot b ON a.half = b.half AND a.jid = b.jid AND a.annotator <> b.annotator AND b.start_frame BETWEEN a.start_frame AND a.end_frame), {GREEDY},
dm AS (SELECT g.half AS half, g.x AS annotator_a, g.y AS annotator_b, a.jid, p.a AS a_id, p.b AS b_id, {IOU.format(s1='a.start_frame', e1='a.end_frame', s2='b.start_frame', e2='b.end_frame')} AS iou, abs(a.start_frame - b.start_frame) AS d_start, abs(a.end_frame - b.end_frame) AS d_end
  FROM taken JOIN annot a ON a.segment_id = p.a JOIN annot b ON b.segment_id = p.b)"""


def _directed(spark, d):
    a = V.annotation(spark, d)
    return a, M.directed_matches(a, ["half"])


@query("j10_overlap_match", f"WITH {V.ANNOT}, {DIRECTED} SELECT annotator_a, annotator_b, a_id, b_id, round(iou, 6) + 0.0 AS iou, d_start, d_end FROM dm")
def j10(spark, d):
    return _directed(spark, d)[1].select("annotator_a", "annotator_b", "a_id", "b_id", r6("iou"), "d_start", "d_end")


BEST = f"""bb AS (SELECT a.segment_id AS a_id, b.segment_id AS b_id, {IOU.format(s1='a.start_frame', e1='a.end_frame', s2='b.start_frame', e2='b.end_frame')} AS iou FROM annot a JOIN annot b ON a.half = b.half AND a.jid = b.jid AND a.annotator = 'ann0' AND b.annotator <> 'ann0'),
bi AS (SELECT a_id, b_id, iou FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY iou DESC, b_id) AS r FROM bb WHERE iou >= 0.01) WHERE r = 1)"""


def _best(spark, d):
    a = V.annotation(spark, d)
    keys = ["half", "jid"]
    return M.best_iou_match(M.intervals(a.where("annotator = 'ann0'"), keys), M.intervals(a.where("annotator <> 'ann0'"), keys), keys)


@query("j11_best_iou", f"WITH {V.ANNOT}, {BEST} SELECT a.segment_id AS a_id, b_id, round(iou, 6) + 0.0 AS iou FROM annot a LEFT JOIN bi ON a.segment_id = a_id WHERE a.annotator = 'ann0'")
def j11(spark, d):
    return _best(spark, d).select("a_id", "b_id", r6("iou"))


@query("o2_top_candidate", f"WITH {V.ANNOT}, {BEST} SELECT b_id, count(*) AS n FROM bi GROUP BY b_id")
def o2(spark, d):
    return _best(spark, d).where("b_id IS NOT NULL").groupBy("b_id").agg(F.count(F.lit(1)).alias("n"))


@query("j12_window_matches", f"""WITH {V.ANNOT}, m AS (SELECT a.segment_id AS a_id, count(*) AS n, list(b.segment_id ORDER BY b.segment_id) AS l FROM annot a JOIN annot b ON a.jid = b.jid AND a.annotator = 'ann0' AND b.annotator = 'ann1' AND b.start_frame BETWEEN a.start_frame - 50 AND a.end_frame + 50 GROUP BY 1)
SELECT jid, segment_id AS a_id, coalesce(n, 0) AS n_matches, l[1] AS match_idx_1, l[2] AS match_idx_2 FROM annot LEFT JOIN m ON segment_id = a_id WHERE annotator = 'ann0'""")
def j12(spark, d):
    a = V.annotation(spark, d)
    return M.window_matches(M.intervals(a.where("annotator = 'ann0'"), ["jid"]), M.intervals(a.where("annotator = 'ann1'"), ["jid"]), ["jid"], 50, 2)


@query("j13_annotator_pairs", f"WITH {V.ANNOT}, n AS (SELECT half, annotator, count(*) AS n FROM annot GROUP BY ALL) SELECT a.half, a.annotator AS annotator_a, b.annotator AS annotator_b, a.n AS n_a, b.n AS n_b FROM n a JOIN n b ON a.half = b.half AND a.annotator < b.annotator")
def j13(spark, d):
    return M.annotator_pairs(V.annotation(spark, d), ["half"])


@query("j16_isolated", f"WITH {V.ANNOT}, {DIRECTED} SELECT segment_id FROM annot WHERE segment_id NOT IN (SELECT a_id FROM dm) AND segment_id NOT IN (SELECT b_id FROM dm)")
def j16(spark, d):
    from .jobs import agreement

    return agreement(V.annotation(spark, d), ["half"])[2].select("segment_id")


@query("a22_isolated_counts", f"WITH {V.ANNOT}, {DIRECTED} SELECT half, annotator, count(*) AS n FROM annot WHERE segment_id NOT IN (SELECT a_id FROM dm) AND segment_id NOT IN (SELECT b_id FROM dm) GROUP BY ALL")
def a22(spark, d):
    from .jobs import agreement

    return agreement(V.annotation(spark, d), ["half"])[2].groupBy("half", "annotator").agg(F.count(F.lit(1)).alias("n"))


STATS = f"""n AS (SELECT half, annotator, count(*) AS n FROM annot GROUP BY ALL), pr AS (SELECT a.half, a.annotator AS annotator_a, b.annotator AS annotator_b, a.n AS n_a, b.n AS n_b FROM n a JOIN n b ON a.half = b.half AND a.annotator < b.annotator),
ab AS (SELECT half, annotator_a, annotator_b, count(*) AS n_ab, avg(d_start) AS ms, stddev_pop(d_start) AS ss, avg(d_end) AS me, stddev_pop(d_end) AS se, avg(iou) AS mi, sum(iou) AS si FROM dm WHERE annotator_a < annotator_b GROUP BY ALL), ba AS (SELECT half, annotator_b AS annotator_a, annotator_a AS annotator_b, count(*) AS n_ba FROM dm WHERE annotator_a > annotator_b GROUP BY ALL),
st AS (SELECT half, annotator_a, annotator_b, n_a, n_b, coalesce(n_ab, 0) AS n_ab, coalesce(n_ba, 0) AS n_ba, n_ab * 100.0::DOUBLE / n_a AS ra, n_ba * 100.0::DOUBLE / n_b AS rb, ms, ss, me, se, mi, coalesce(si, 0) / n_a AS mall FROM pr LEFT JOIN ab USING (half, annotator_a, annotator_b) LEFT JOIN ba USING (half, annotator_a, annotator_b))"""


@query("a6_pair_agreement", f"WITH {V.ANNOT}, {DIRECTED}, {STATS} SELECT half, annotator_a, annotator_b, n_a, n_b, n_ab, n_ba, round(ra, 6) + 0.0 AS recall_a, round(rb, 6) + 0.0 AS recall_b, round(ms, 6) + 0.0 AS mean_d_start, round(ss, 4) + 0.0 AS std_d_start, round(me, 6) + 0.0 AS mean_d_end, round(se, 4) + 0.0 AS std_d_end, round(mi, 6) + 0.0 AS mean_iou_matched, round(mall, 6) + 0.0 AS mean_iou_all FROM st")
def a6(spark, d):
    a, m = _directed(spark, d)
    s = M.pair_stats(a, m, ["half"])
    four = [(F.round(c, 4) + 0.0).alias(c) for c in ("std_d_start", "std_d_end")]
    return s.select("half", "annotator_a", "annotator_b", "n_a", "n_b", "n_ab", "n_ba", *four, *[r6(c) for c in ("recall_a", "recall_b", "mean_d_start", "mean_d_end", "mean_iou_matched", "mean_iou_all")])


@query("a7_global_kpis", f"WITH {V.ANNOT}, {DIRECTED}, {STATS} SELECT k.kpi, round(avg(k.v), 6) + 0.0 AS value FROM (SELECT unnest([{{'kpi': 'recall', 'v': ra}}, {{'kpi': 'recall', 'v': rb}}, {{'kpi': 'd_start', 'v': ms}}, {{'kpi': 'd_end', 'v': me}}, {{'kpi': 'iou', 'v': mi}}]) AS k FROM st) GROUP BY k.kpi")
def a7(spark, d):
    a, m = _directed(spark, d)
    return M.global_kpis(M.pair_stats(a, m, ["half"])).select("kpi", r6("value"))


@query("a9_match_matrix", f"""WITH {V.ANNOT}, {DIRECTED}, h AS (SELECT half, annotator_a, annotator_b, count(*) AS n, avg(iou) AS iou FROM dm GROUP BY ALL)
SELECT half, annotator_a, annotator_b, n, round(iou, 6) + 0.0 AS mean_iou FROM h UNION ALL SELECT 'Global', annotator_a, annotator_b, sum(n)::BIGINT, round(avg(iou), 6) + 0.0 FROM h GROUP BY ALL""")
def a9(spark, d):
    return M.match_matrix(_directed(spark, d)[1], "half").select("half", "annotator_a", "annotator_b", "n", r6("mean_iou"))


@query("a21_iou_distribution", f"WITH {V.ANNOT}, {DIRECTED} SELECT half, annotator_a, annotator_b, count(*) AS n, {", ".join(f"round(quantile_cont(iou, {q}), 6) + 0.0 AS {n}" for q, n in ((0.25, "q1_iou"), (0.5, "median_iou"), (0.75, "q3_iou")))} FROM dm GROUP BY ALL")
def a21(spark, d):
    return M.iou_distribution(_directed(spark, d)[1], ["half"]).select("half", "annotator_a", "annotator_b", "n", r6("q1_iou"), r6("median_iou"), r6("q3_iou"))


@query("u3_undirected_pairs", f"WITH {V.ANNOT}, {DIRECTED} SELECT DISTINCT half, CASE WHEN annotator_a > annotator_b THEN b_id ELSE a_id END AS u, CASE WHEN annotator_a > annotator_b THEN a_id ELSE b_id END AS v FROM dm")
def u3(spark, d):
    return M.undirected(_directed(spark, d)[1], ["half"]).select("half", "u", "v")


@query("u4_matched_and_isolated", f"WITH {V.ANNOT}, {DIRECTED} SELECT half, count(*) FILTER (WHERE segment_id IN (SELECT a_id FROM dm)) AS n_matched, count(*) FILTER (WHERE segment_id NOT IN (SELECT a_id FROM dm)) AS n_unmatched FROM annot GROUP BY half")
def u4(spark, d):
    return M.matched_counts(*_directed(spark, d), ["half"])


@query("g8_match_groups", f"""WITH RECURSIVE {V.ANNOT}, {DIRECTED}, e AS (SELECT a_id AS u, b_id AS v FROM dm UNION SELECT b_id, a_id FROM dm), r(x, y) AS (SELECT segment_id, segment_id FROM annot UNION SELECT r.x, e.v FROM r JOIN e ON e.u = r.y)
SELECT half, x AS node, min(y) AS group_id FROM r JOIN annot ON segment_id = x GROUP BY half, x""")
def g8(spark, d):
    a, m = _directed(spark, d)
    return _smallest(M.match_groups(a, M.undirected(m, ["half"]), ["half"])).select("half", F.col("segment_id").alias("node"), "group_id")


def _smallest(groups):
    """Groups named by their smallest segment_id, as ids are unique in annotation()."""
    own = Window.partitionBy("half", "group_annotator", "group_id")
    return groups.withColumn("least", F.min("segment_id").over(own)).drop("group_id").withColumnRenamed("least", "group_id")


@query("g10_evaluation_job", f"""WITH {V.ANNOT}, {TOL} SELECT 'surplus' AS side, segment_id, half, team, jid FROM annot WHERE annotator = 'ann0' AND segment_id NOT IN (SELECT p.a FROM taken)
UNION ALL SELECT 'missed', segment_id, half, team, jid FROM annot WHERE annotator = 'ann1' AND segment_id NOT IN (SELECT p.b FROM taken)""")
def g10(spark, d):
    a = V.annotation(spark, d)
    got = jobs.evaluate(a.where("annotator = 'ann0'"), a.where("annotator = 'ann1'"), KEYS, ["half", "team"], ["half"])
    sides = [got[side].select(F.lit(side).alias("side"), "segment_id", *KEYS) for side in ("surplus", "missed")]
    return sides[0].unionByName(sides[1])


@query("g10_agreement_job", f"""WITH RECURSIVE {V.ANNOT}, {DIRECTED}, e AS (SELECT a_id AS u, b_id AS v FROM dm UNION SELECT b_id, a_id FROM dm), r(x, y) AS (SELECT segment_id, segment_id FROM annot UNION SELECT r.x, e.v FROM r JOIN e ON e.u = r.y), g AS (SELECT x, min(y) AS group_id FROM r GROUP BY x)
SELECT half, group_id, count(*) AS n_segments, count(DISTINCT annotator) AS n_annotators FROM g JOIN annot ON segment_id = x GROUP BY half, group_id""")
def g10_agreement(spark, d):
    """Match groups of the whole report, by size and annotators."""
    a = V.annotation(spark, d)
    return _smallest(jobs.agreement_report(a, ["half"])["groups"]).groupBy("half", "group_id").agg(F.count(F.lit(1)).alias("n_segments"), F.countDistinct("annotator").alias("n_annotators"))


FILES = ["match_id", "half"]
#: DIRECTED over notes, where ids restart in each file.
FILED = f"""cand AS (SELECT {{'m': a.match_id, 'half': a.half, 'jid': a.jid, 'x': a.annotator, 'y': b.annotator}} AS g, a.segment_id AS a, a.start_frame AS a_start, b.segment_id AS b, b.start_frame AS b_start, greatest(a.start_frame, b.start_frame) - least(a.end_frame, b.end_frame) AS p
  FROM notes a JOIN notes b ON a.match_id = b.match_id AND a.half = b.half AND a.jid = b.jid AND a.annotator <> b.annotator AND b.start_frame BETWEEN a.start_frame AND a.end_frame), {GREEDY},
dm AS (SELECT g.m AS match_id, g.half AS half, g.x AS annotator_a, g.y AS annotator_b, p.a AS a_id, p.b AS b_id FROM taken),
pairs AS (SELECT DISTINCT match_id, half, least(annotator_a, annotator_b) AS annotator_u, CASE WHEN annotator_a > annotator_b THEN b_id ELSE a_id END AS u, greatest(annotator_a, annotator_b) AS annotator_v, CASE WHEN annotator_a > annotator_b THEN a_id ELSE b_id END AS v FROM dm),
ends AS (SELECT match_id, half, annotator_u AS annotator, u AS segment_id FROM pairs UNION SELECT match_id, half, annotator_v, v FROM pairs),
lone AS (SELECT * FROM notes ANTI JOIN ends USING (match_id, half, annotator, segment_id))"""
#: hh:mm:ss of frames.
HMS = "lpad(({0} // 25 // 3600)::VARCHAR, 2, '0') || ':' || lpad(({0} // 25 % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad(({0} // 25 % 60)::VARCHAR, 2, '0')"


def _filed(spark, d):
    a = V.notes(spark, d)
    return a, M.directed_matches(a, FILES)


@query("u3_file_pairs", f"WITH {V.ANNOT}, {V.NOTES}, {FILED} SELECT * FROM pairs")
def u3_file(spark, d):
    return M.undirected(_filed(spark, d)[1], FILES)


@query("u4_file_matched_and_isolated", f"WITH {V.ANNOT}, {V.NOTES}, {FILED}, hit AS (SELECT DISTINCT match_id, half, annotator_a AS annotator, a_id AS segment_id, 1 AS h FROM dm) SELECT match_id, half, count(h) AS n_matched, count(*) - count(h) AS n_unmatched FROM notes LEFT JOIN hit USING (match_id, half, annotator, segment_id) GROUP BY ALL")
def u4_file(spark, d):
    return M.matched_counts(*_filed(spark, d), FILES)


@query("j16_file_isolated", f"""WITH {V.ANNOT}, {V.NOTES}, {FILED} SELECT match_id, half, annotator, segment_id, jid, end_frame - start_frame AS duration_frames, {HMS.format('(start_frame + 30000)')} AS start_timecode, {HMS.format('(end_frame + 30000)')} AS end_timecode,
{HMS.format('(end_frame - start_frame)')} AS duration_tc FROM lone""")
def j16_file(spark, d):
    """Isolated segments with their time codes; frames are moved to be positive."""
    notes = V.notes(spark, d).withColumns({c: F.col(c) + 30_000 for c in ("start_frame", "end_frame")})
    return jobs.agreement(notes, FILES)[2].select(*FILES, "annotator", "segment_id", "jid", "duration_frames", "start_timecode", "end_timecode", "duration_tc")


GROUPS = """keyed AS (SELECT *, match_id || ' ' || half || ' ' || annotator || ' ' || lpad(segment_id::VARCHAR, 9, '0') AS node FROM notes), e AS (SELECT a.node AS u, b.node AS v FROM pairs p JOIN keyed a ON a.match_id = p.match_id AND a.half = p.half AND a.annotator = annotator_u AND a.segment_id = u
  JOIN keyed b ON b.match_id = p.match_id AND b.half = p.half AND b.annotator = annotator_v AND b.segment_id = v), both_ AS (SELECT u, v FROM e UNION SELECT v, u FROM e), r(x, y) AS (SELECT node, node FROM keyed UNION SELECT r.x, b.v FROM r JOIN both_ b ON b.u = r.y), root AS (SELECT x AS node, min(y) AS least_ FROM r GROUP BY x)"""


@query("g8_file_groups", f"WITH RECURSIVE {V.ANNOT}, {V.NOTES}, {FILED}, {GROUPS} SELECT k.match_id, k.half, k.annotator, k.segment_id, g.annotator AS group_annotator, g.segment_id AS group_id FROM keyed k JOIN root USING (node) JOIN keyed g ON g.node = least_")
def g8_file(spark, d):
    a, m = _filed(spark, d)
    return M.match_groups(a, M.undirected(m, FILES), FILES)


@query("g10_file_report", f"""WITH RECURSIVE {V.ANNOT}, {V.NOTES}, {FILED}, {GROUPS}, s AS (SELECT match_id, half, least_, count(*) AS n FROM keyed JOIN root USING (node) GROUP BY ALL)
SELECT match_id, half, count(*) AS n_groups, count(*) FILTER (WHERE n = 1) AS n_lone, max(n) AS n_most, sum(n)::BIGINT AS n_segments FROM s GROUP BY ALL""")
def g10_file(spark, d):
    """Sizes of the match groups of the whole report, where each file's ids start at 0."""
    groups = jobs.agreement_report(V.notes(spark, d), FILES)["groups"].groupBy(*FILES, "group_annotator", "group_id").agg(F.count(F.lit(1)).alias("n"))
    return groups.groupBy(*FILES).agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("n") == 1).alias("n_lone"), F.max("n").alias("n_most"), F.sum("n").alias("n_segments"))


@query("j12_tag_matches", f"""WITH {V.ANNOT}, t AS (SELECT segment_id AS tag_id, CASE WHEN segment_id % 17 > 0 THEN jid END AS jid, CASE WHEN segment_id % 13 > 0 THEN left(team, 3) END AS team, start_frame FROM annot WHERE annotator = 'ann0'), b AS (SELECT segment_id, jid, 'FC ' || team AS team, start_frame, end_frame FROM annot WHERE annotator <> 'ann0'),
m AS (SELECT tag_id, count(*) AS n, list(segment_id ORDER BY segment_id) AS l FROM t JOIN b ON b.jid = t.jid AND contains(b.team, t.team) AND t.start_frame BETWEEN b.start_frame - 50 AND b.end_frame + 50 GROUP BY 1)
SELECT tag_id, coalesce(n, 0) AS n_matches, {", ".join(f"l[{i}] AS match_idx_{i}" for i in range(1, 5))} FROM t LEFT JOIN m USING (tag_id)""")
def j12_tags(spark, d):
    a = V.annotation(spark, d)
    tags = a.where("annotator = 'ann0'").select(F.col("segment_id").alias("tag_id"), F.when(F.col("segment_id") % 17 > 0, F.col("jid")).alias("jid"), F.when(F.col("segment_id") % 13 > 0, F.left("team", F.lit(3))).alias("team"), "start_frame")
    moves = a.where("annotator <> 'ann0'").select(F.col("segment_id").alias("movement_id"), "jid", F.concat(F.lit("FC "), "team").alias("team"), "start_frame", "end_frame")
    return M.tag_matches(tags, moves, 50, named=4).select("tag_id", "n_matches", *[f"match_idx_{i}" for i in range(1, 5)])


@query("g9_provenance", f"""WITH {V.ANNOT}, {BEST} SELECT a.segment_id, CASE WHEN b_id IS NOT NULL THEN b.end_frame - b.start_frame ELSE a.end_frame - a.start_frame END / 25.0::DOUBLE AS duration_out, CASE WHEN b_id IS NOT NULL THEN 'matched' ELSE 'recomputed' END AS duration_source
FROM annot a LEFT JOIN bi ON a.segment_id = a_id LEFT JOIN annot b ON b.segment_id = b_id WHERE a.annotator = 'ann0'""")
def g9_provenance(spark, d):
    a = V.annotation(spark, d)
    length = (F.col("end_frame") - F.col("start_frame")) / 25
    best = _best(spark, d).select(F.col("a_id").alias("segment_id"), "b_id").join(a.select(F.col("segment_id").alias("b_id"), length.alias("matched_s")), "b_id", "left")
    df = a.where("annotator = 'ann0'").join(best, "segment_id", "left")
    return with_provenance(df, {"duration_out": (F.col("matched_s"), length)}).select("segment_id", "duration_out", "duration_source")


PERSONS = "people AS (SELECT s_suppkey AS person_id, CASE WHEN s_suppkey % 2 = 0 THEN 'Home' ELSE 'Away' END AS team, s_suppkey % 23 AS jid, CASE WHEN s_suppkey % 11 = 0 THEN 'TW' ELSE 'FP' END AS position FROM supplier)"
PICK = "CASE WHEN b.b_id IS NOT NULL THEN {m} ELSE {r} END"
ENRICH = f"""{V.OWNED}, {INDICATORS}, {GAME}, {PERSONS}, an AS (SELECT * REPLACE (jid % 30 AS jid), player_id // 22 AS match_id FROM owned),
em AS (SELECT a.segment_id, m.movement_id AS b_id, m.distance_m, m.duration_s, m.peak_speed_kmh, m.avg_velocity_kmh, {IOU.format(s1='a.start_frame', e1='a.end_frame', s2='m.start_frame', e2='m.end_frame')} AS iou FROM an a JOIN movement m ON a.player_id = m.player_id AND a.half = m.half WHERE m.start_frame < a.end_frame AND m.end_frame > a.start_frame),
eb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY iou DESC, b_id) AS r FROM em WHERE iou >= 0.01) WHERE r = 1),
ts AS (SELECT team, jid, max(person_id) AS p FROM people GROUP BY ALL), js AS (SELECT jid, max(person_id) AS p, arg_min(position, person_id) AS position FROM people GROUP BY jid),
sc AS (SELECT a.*, coalesce(ts.p, js.p) AS person_id, js.position AS by_jid, coalesce(g.home, 0)::BIGINT AS home, coalesce(g.away, 0)::BIGINT AS away, EXISTS (SELECT 1 FROM ev s WHERE s.kind = 'shot' AND s.match_id = a.match_id AND s.half = a.half AND s.team = a.team AND s.el BETWEEN a.end_frame / 25.0::DOUBLE AND a.end_frame / 25.0::DOUBLE + 10) AS shot_within
  FROM an a LEFT JOIN ts ON ts.team = a.team AND ts.jid = a.jid LEFT JOIN js ON js.jid = a.jid LEFT JOIN LATERAL (SELECT home, away FROM gl WHERE gl.match_id = a.match_id AND gl.half = a.half AND gl.el <= a.start_frame / 25.0::DOUBLE ORDER BY gl.el DESC, gl.event_id DESC LIMIT 1) g ON true)"""


@query("g9_enrichment", f"""{TS}, {VALLEYS}, {MOVES}, {V.ANNOT}, {V.EVENT}, {ENRICH}
SELECT a.segment_id, b.b_id AS movement_id, round(b.iou, 6) + 0.0 AS iou, CASE WHEN b.b_id IS NOT NULL THEN 'matched' WHEN i.segment_id IS NOT NULL THEN 'recomputed' ELSE 'missing' END AS duration_source,
  {", ".join(f"round({PICK.format(m=m, r=f'i.{r}')}, 4) + 0.0 AS {r}" for m, r in (("b.distance_m", "distance_m"), ("b.duration_s", "duration_s"), ("b.peak_speed_kmh / 3.6", "peak_vel_ms"), ("b.avg_velocity_kmh / 3.6", "mean_vel_ms")))},
  a.person_id, coalesce(p.position, by_jid) AS position, {CONTEXT_OUT}, i.zone_start, i.peak_frame, i.possession
FROM sc a LEFT JOIN eb b USING (segment_id) LEFT JOIN indicators i USING (segment_id) LEFT JOIN people p ON p.person_id = a.person_id""".replace("CASE WHEN team = 'Away'", "CASE WHEN a.team = 'Away'"))
def g9(spark, d):
    turn = F.when(F.col("segment_id") % 3 == 0, "left_to_right").when(F.col("segment_id") % 3 == 1, "right_to_left")
    notes = V.owned(spark, d).withColumns({"play_direction": turn, "jid": F.col("jid") % 30, "match_id": F.floor(F.col("player_id") / 22)})
    on = ["player_id", "half"]
    moves, track = _movements(spark, d), series.speed(V.track(spark, d, on, V.INTERVAL_PARTS), V.K, unit=0.1 / 25)
    position = F.when(F.col("s_suppkey") % 11 == 0, "TW").otherwise("FP")
    people = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("person_id"), F.when(F.col("s_suppkey") % 2 == 0, "Home").otherwise("Away").alias("team"), (F.col("s_suppkey") % 23).alias("jid"), position.alias("position"))
    got = jobs.enrich(notes, moves, track, people, _match_frames(spark, d), on, ["half"], parts=V.INTERVAL_PARTS * V.parts(spark, d), ends=V.last_frames(spark, d))
    rounded = [(F.round(c, 4) + 0.0).alias(c) for c in ("distance_m", "duration_s", "peak_vel_ms", "mean_vel_ms")]
    return got.select("segment_id", "movement_id", r6("iou"), "duration_source", *rounded, "person_id", "position", "scoreline", "goal_indicator", "shot_within", "zone_start", "peak_frame", "possession")
