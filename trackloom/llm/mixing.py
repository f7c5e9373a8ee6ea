"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame operations alone.

1. Sizes are summed by source, and targets follow from the weights; a target stops at most times its source's size, and
   the excess goes to the others by weight.
2. A source's documents are permuted by a keyed hash: into blocks, and within each block. Whole passes over the source
   and a prefix of one more pass meet its target; only the block at the prefix's end is cut inside, at a document.
3. The block draws of all sources are dealt to output shards by a binary tree. A node splits its quotas in two halves of
   equal count; how many blocks of each source go left follows the multivariate hypergeometric law, drawn source by
   source. Leaves hold exact quotas, so shards take disjoint runs of each source's permuted blocks. A draw of a block
   counts where a leaf holds it, and nowhere else.
4. Inside a shard rows are ordered by a hash of document and pass.

The tree holds counts only: its rows are ranges of TOGETHER sources at each of the shards, never documents. A node first
draws how many blocks of each range go left, then within each range how many of each source, which is the same law; so a
row is bounded however many sources there are. Targets are found over a row for each source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_PATTERN, cut, fresh, table

#: Sources that one row of the tree holds.
TOGETHER = 10_000


def _let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x computed once."""
    return F.transform(F.array(x), use)[0]


def _chance(*keys: Column) -> Column:
    """A number in [0, 1) that hangs on the keys alone."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) / F.lit(float(1 << 52))


def hypergeometric(good: Column, rest: Column, draws: Column, u: Column) -> Column:
    """How many of so many draws from good and rest items are good, by inversion of u from the mode outwards.

    Outcomes beyond ten standard deviations are left out; they weigh less than a double can tell.
    """
    total = good + rest
    low, high = F.greatest(F.lit(0).cast("long"), draws - rest), F.least(draws, good)
    spread = F.sqrt(draws * (good / F.greatest(total, F.lit(1))) * (rest / F.greatest(total, F.lit(1))) * ((total - draws) / F.greatest(total - 1, F.lit(1))))
    mode = F.least(high, F.greatest(low, F.floor((draws + 1) * (good + 1) / (total + 2)).cast("long")))
    reach = F.ceil(spread * 10 + 10).cast("long")
    first = F.struct(mode.alias("mode"), F.greatest(low, mode - reach).alias("low"), F.least(high, mode + reach).alias("high"), good.alias("g"), rest.alias("b"), draws.alias("n"), u.alias("u"))

    def walk(s: Column, up: bool) -> Callable:
        def ratio(k: Column) -> Column:
            if up:
                return (s["g"] - k).cast("double") * (s["n"] - k) / ((k + 1).cast("double") * (s["b"] - s["n"] + k + 1))
            return k.cast("double") * (s["b"] - s["n"] + k) / ((s["g"] - k + 1).cast("double") * (s["n"] - k + 1))

        steps = F.when(s["high"] > s["mode"], F.sequence(s["mode"], s["high"] - 1)) if up else F.when(s["mode"] > s["low"], F.sequence(s["mode"], s["low"] + 1))
        return F.coalesce(steps, F.array().cast("array<bigint>")), ratio

    def mass(s: Column, up: bool) -> Column:
        steps, ratio = walk(s, up)
        start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"))
        return F.aggregate(steps, start, lambda a, k: F.struct((a["p"] * ratio(k)).alias("p"), (a["sum"] + a["p"] * ratio(k)).alias("sum")))["sum"]

    def pick(s: Column, left: Column, up: bool) -> Column:
        """Walks from the mode until the mass left is used up."""
        steps, ratio = walk(s, up)
        start = F.struct(F.lit(1.0).alias("p"), left.alias("left"), s["mode"].alias("at"))

        def on(a: Column, k: Column) -> Column:
            p = a["p"] * ratio(k)
            return F.when(a["left"] > 0, F.struct(p.alias("p"), (a["left"] - p).alias("left"), (k + (1 if up else -1)).alias("at"))).otherwise(F.struct(a["p"].alias("p"), a["left"].alias("left"), a["at"].alias("at")))

        return F.aggregate(steps, start, on)["at"]

    def drawn(s: Column) -> Column:
        def choose(m: Column) -> Column:
            aim = s["u"] * (1 + m["up"] + m["down"])
            return F.when(aim <= 1, s["mode"]).when(aim - 1 <= m["up"], pick(s, aim - 1, True)).otherwise(pick(s, aim - 1 - m["up"], False))

        return _let(F.struct(mass(s, True).alias("up"), mass(s, False).alias("down")), choose)

    return _let(first, drawn)


def _split(seed: str, level: int) -> Callable:
    """Folds a node's sources: each draws its left part from what the draws before it left."""

    def fold(a: Column, h: Column) -> Column:
        got = hypergeometric(h["k"], a["rest"] - h["k"], a["draws"], _chance(F.lit(seed), F.lit(level), F.col("node"), h["sid"]))
        return _let(got, lambda x: F.struct((a["rest"] - h["k"]).alias("rest"), (a["draws"] - x).alias("draws"), F.concat(a["left"], F.array(x)).alias("left")))

    return fold


def _drawn(held: Column, draws: Column, seed: str, level: int) -> Column:
    """How many of each of held (sid, k) are among so many draws."""
    total = F.aggregate(held, F.lit(0).cast("long"), lambda a, h: a + h["k"])
    start = F.struct(total.alias("rest"), draws.alias("draws"), F.array().cast("array<bigint>").alias("left"))
    return F.aggregate(held, start, _split(seed, level))["left"]


def splitting_tree(quotas: DataFrame, levels: int, seed: str = "mix", together: int = TOGETHER) -> DataFrame:
    """(sid, ends): for each source of quotas (sid, blocks) its blocks' cumulated counts over 2**levels shards."""
    band = F.floor((F.col("sid") - 1) / together).alias("band")
    node = quotas.groupBy(band).agg(F.sort_array(F.collect_list(F.struct("sid", F.col("blocks").alias("k")))).alias("held")).withColumn("node", F.lit(0).cast("long"))
    for level in range(levels):
        total = F.aggregate("held", F.lit(0).cast("long"), lambda a, h: a + h["k"])
        whole = node.groupBy("node").agg(F.sort_array(F.collect_list(F.struct(F.col("band").alias("sid"), total.alias("k")))).alias("bands"))
        half = F.floor((F.aggregate("bands", F.lit(0).cast("long"), lambda a, h: a + h["k"]) + 1) / 2).cast("long")
        whole = whole.withColumn("drawn", _drawn(F.col("bands"), half, f"{seed} bands", level))
        parts = whole.select("node", F.explode(F.arrays_zip(F.col("bands.sid").alias("band"), F.col("drawn").alias("draws"))).alias("d")).select("node", "d.band", "d.draws")
        node = node.join(parts, ["node", "band"]).withColumn("left", _drawn(F.col("held"), F.col("draws"), seed, level))
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.zip_with("held", "left", lambda h, x: F.struct(h["sid"].alias("sid"), x.alias("k"))).alias("held")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("held", "left", lambda h, x: F.struct(h["sid"].alias("sid"), (h["k"] - x).alias("k"))).alias("held")),
        )
        node = cut(node.select("band", F.explode(halves).alias("half")).select("half.node", "band", "half.held"))
    leaves = node.select("node", F.explode("held").alias("h")).select("node", "h.sid", "h.k")
    before = Window.partitionBy("sid").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    ends = leaves.withColumn("end", F.sum("k").over(before))
    return ends.groupBy("sid").agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "end"))), lambda x: x["end"]).alias("ends"))


def plan_targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """sources (source, source_size, ...) with sid (1, 2, ... by code point, null last) and target.

    The sum of targets is share times the sum of sizes. A row for each source; no documents.
    """
    total = sources.withColumn("all_size", F.sum("source_size").over(Window.partitionBy()))
    ranked = total.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("limit", most * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    order = Window.orderBy("ratio", "sid")
    shut = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", (share * F.col("all_size") - shut) / open_weight)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(Window.partitionBy())["level"]
    return ranked.withColumn("target", F.coalesce(F.least(F.col("limit"), F.col("weight") * level), F.col("limit"))).drop("all_size", "limit", "ratio", "level", "weight")


def unit_key() -> Column:
    """A hash of what the mix looks at; rows that share it are alike and share their draws."""
    return F.xxhash64(F.lit("mix"), F.col("doc_id"), F.col("source"), F.col("text"))


def name_of() -> Column:
    """What deals a document row to its block: its id, or a hash of the text where it has none, so that such rows are spread."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce("text", F.lit("")))))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_docs: int = 4096, levels: int = 6, part_words: int = 20_000_000, seed: str = "mix", together: int = TOGETHER) -> DataFrame:
    """(key, doc_id, source, rows, size, source_size, target, passes, shards, parts): a row for each group of equal rows.

    docs: doc_id, source, text; other columns are left out. size is the number of words (cut at ASCII white space; a null
    text has 0) of one row, rows the number of equal rows (doc_id, source and text), which are taken together or not.
    passes is how often they are taken, shards lists the shard of each time, and parts in how many parts of about
    part_words words a shard is written. Null is a source of its own; a source
    without words has target 0 and none of its rows are taken. Each source's taken words differ from its target by half of one group at most.
    """
    base = docs.select("doc_id", "source", unit_key().alias("key"), name_of().alias("name"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_PATTERN)).cast("long").alias("size"))
    base = cut(base.groupBy("key", "doc_id", "source", "name", "size").agg(F.count("*").alias("rows")))
    sources = base.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("units"))
    plan = plan_targets(sources, weights, share, most)
    plan = plan.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    parts = F.greatest(F.ceil(F.sum("target").over(Window.partitionBy()) / (part_words << levels)), F.lit(1)).cast("long")
    plan = plan.withColumn("parts", parts)
    plan = cut(plan.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")).withColumn("n_blocks", F.ceil(F.col("units") / block_docs).cast("long")))

    place = F.md5(F.concat_ws("|", F.lit(seed), "name"))
    units = base.join(plan.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own"))).drop("own").withColumn("place", place)
    units = units.withColumn("block", F.pmod(F.conv(F.substring("place", 1, 8), 16, 10).cast("long"), F.col("n_blocks"))).withColumn("words", F.col("size") * F.col("rows"))
    blocks = units.groupBy("sid", "block").agg(F.sum("words").alias("words"), F.first("rest").alias("rest"), F.first("full").alias("full"))
    blocks = blocks.withColumn("ahead", F.coalesce(F.sum("words").over(Window.partitionBy("sid").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = blocks.withColumn("turn", F.row_number().over(Window.partitionBy("sid").orderBy("block")).cast("long") - 1)
    blocks = cut(blocks.withColumn("held", F.count("*").over(Window.partitionBy("sid"))))
    quotas = blocks.groupBy("sid").agg((F.max("full") * F.count("*") + F.count_if(F.col("ahead") < F.col("rest"))).alias("blocks"))
    dealt = blocks.join(splitting_tree(quotas, levels, seed, together), "sid").select("sid", "block", "ahead", "turn", "held", "ends")

    within = Window.partitionBy("sid", "block").orderBy("place", "key").rowsBetween(Window.unboundedPreceding, -1)
    units = units.join(dealt, ["sid", "block"]).withColumn("before", F.col("ahead") + F.coalesce(F.sum("words").over(within), F.lit(0)))
    units = units.withColumn("draws", F.col("full") + (F.col("before") + F.col("words") / 2 <= F.col("rest")).cast("long"))
    draws = F.transform(F.sequence(F.lit(0).cast("long"), F.col("draws") - 1), lambda p: p * F.col("held") + F.col("turn"))
    leaves = F.filter(F.transform(draws, lambda d: F.size(F.filter("ends", lambda e: e <= d))), lambda s: s < 1 << levels)
    units = units.withColumn("shards", F.when(F.col("draws") > 0, leaves).otherwise(F.array().cast("array<int>")))
    passes = F.size("shards").cast("long").alias("passes")
    return units.select("key", "doc_id", "source", "rows", "size", "source_size", "target", passes, "shards", "parts")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns, each row as often as the mix takes it, dealt to shards and shuffled within each.

    A shard grows with the corpus; its parts, of a bounded size, are what a task shuffles.
    """
    seed = options.get("seed", "mix")
    key, turn, shard, place, part = (fresh(docs, n) for n in ("_key", "_pass", "_shard", "_place", "_part"))
    taken = mix(docs, **options).where("passes > 0").select(F.col("key").alias(key), F.col("parts").alias(part), F.posexplode("shards").alias(turn, shard))
    rows = docs.withColumn(key, unit_key()).join(taken, key).withColumn(place, F.xxhash64(F.lit(seed), key, turn))
    rows = rows.withColumn(part, F.pmod(place, part))
    return rows.repartition(shard, part).sortWithinPartitions(shard, part, place).select(docs.columns)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = mix(table(spark, sf_dir, "documents")).withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return units.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("passes")).alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix|' || coalesce(doc_id::VARCHAR, 'null' || md5(coalesce(text, '')))) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS units FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid, sum(source_size) OVER () AS all_size FROM s),
w AS (SELECT *, [5, 2, 1][((sid - 1) % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS lim FROM r),
x AS (SELECT *, lim / weight AS ratio FROM w),
y AS (SELECT *, (1.5::DOUBLE * all_size - coalesce(sum(lim) OVER (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM x),
z AS (SELECT *, (SELECT arg_min(level, [ratio, sid]) FROM y WHERE level <= ratio) AS lv FROM y),
t AS (SELECT source, sid, source_size, ceil(units / 4096.0)::BIGINT AS n_blocks, coalesce(least(lim, weight * lv), lim) AS target FROM z),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS full_passes FROM t),
u AS (SELECT d.*, p.sid, source_size, target, full_passes, target - full_passes * source_size AS rest, ('0x' || substr(place, 1, 8))::BIGINT % n_blocks AS block FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
v AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY sid ORDER BY block, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u)
SELECT doc_id, size, source_size, target, (size * (full_passes + CASE WHEN before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM v
"""
