"""A Merkle manifest of a dataset: a tree of hashes for each language, one over their roots, and a proof for every row.

A leaf is the hash of a row's fields. Leaves of a language stand by doc_id; eight neighbours at a time are hashed to a node
of the next level until one is left. Rows get their places by range partitioning and counts, and leaf partitions are
aligned runs of 4,096 places of one tree. A partition hashes its own part of the tree once, in its task; nodes above it are
grouped level by level, each level an eighth of the one below.

Proofs are an octopus multiproof: a leaf partition names the coordinates (tree, level, index) of the nodes that proofs of
its leaves need and that it can't derive from its own leaves, each once, fetches their digests with one join, derives the
interiors that its proofs share, and expands every row's own proof in its task. Digests of nodes that many partitions need
lie ready in several copies, one for each run of partitions, so that no key of the join is hot.

Rows may repeat (the order among equal doc_ids is that of their leaves; null ids come first) and any field may be null.
An empty table has no proofs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 8
#: Levels of a leaf partition's own tree: it has at most ARITY ** LEVELS leaves.
LEVELS = 4
#: Leaf partitions that share one copy of a node from above them.
SHARED = 2_048


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above the leaves of a tree of n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def _field(value: Column) -> Column:
    held = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(held).cast("string"), F.lit(":"), held), F.lit("-"))


def leaf(fields: dict[str, Column] | None = None) -> Column:
    """The hash of a row's fields, of which some may be given in another version."""
    return F.sha2(F.concat(*(_field((fields or {}).get(c, F.col(c))) for c in FIELDS)), 256)


def placed(rows: DataFrame, tree: list[str], order: list[str]) -> DataFrame:
    """rows with pos, their place from 0 among the rows of their tree, and n, the rows of that tree.

    Only counts of (partition, tree) meet by tree; rows of one tree stay on many tasks, however many there are.
    """
    held = cut(rows.repartitionByRange(*tree, *order).withColumn("part", F.spark_partition_id()))
    number = F.row_number().over(Window.partitionBy("part", *tree).orderBy(*order))
    by_tree = Window.partitionBy(*tree)
    before = by_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy("part", *tree).agg(F.count("*").alias("here"))
    counts = counts.select("part", *(F.col(c).alias("_" + c) for c in tree), F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"), F.sum("here").over(by_tree).alias("n"))
    here = held.withColumn("number", number)
    same = here.part == counts.part
    for c in tree:
        same &= here[c].eqNullSafe(counts["_" + c])
    return here.join(counts, same).select(*rows.columns, (F.col("before") + F.col("number") - 1).alias("pos"), "n")


def levels_of(digests: list[str], upto: int) -> list[list[str]]:
    """The digests of a run of leaves, and of the upto levels above them."""
    out = [digests]
    for _ in range(upto):
        last = out[-1]
        out.append([digest(last[k : k + ARITY]) for k in range(0, len(last), ARITY)])
    return out


def _tops(levels: int, key: tuple, leaves: pa.Table) -> pa.Table:
    n = leaves.column("n")[0].as_py()
    own = levels_of(leaves.sort_by("pos").column("leaf").to_pylist(), min(levels, depth(n)))
    return pa.table({"tree": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([n], pa.int64()), "idx": pa.array([key[1].as_py()], pa.int64()), "digest": pa.array(own[-1], pa.string())})


def _tiled(leaves: DataFrame, levels: int) -> DataFrame:
    return leaves.withColumn("tile", F.expr(f"pos div {ARITY**levels}"))


def nodes_above(leaves: DataFrame, most: int, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(tree, n, level, idx, digest) of the nodes from the tops of leaf partitions up, and (tree, root) of every tree.

    leaves: tree, n, pos, leaf; most: the leaves of the largest tree, which tells how many levels there are.
    """

    def tops(key, rows):
        return _tops(levels, key, rows)

    level = _tiled(leaves, levels).groupBy("tree", "tile").applyInArrow(tops, "tree long, n long, idx long, digest string")
    found = [cut(level.withColumn("level", F.lit(levels)))]
    for k in range(levels + 1, depth(most) + 1):
        below = found[-1].where(F.col("n") > ARITY ** (k - 1))  # the others have come to their root
        run = F.transform(F.sort_array(F.collect_list(F.struct("idx", "digest"))), lambda x: x.digest)
        up = below.groupBy("tree", "n", F.expr(f"idx div {ARITY}").alias("up")).agg(F.sha2(F.concat_ws("", run), 256).alias("digest"))
        found.append(cut(up.select("tree", "n", F.col("up").alias("idx"), "digest", F.lit(k).alias("level"))))
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    roots = nodes.where((F.col("idx") == 0) & (F.col("n") <= F.pow(F.lit(float(ARITY)), F.col("level")))).select("tree", F.col("digest").alias("root"))
    return nodes, roots


def missing(tile: int, n: int, levels: int = LEVELS) -> list[tuple[int, int]]:
    """(level, index) of the nodes that proofs of a leaf partition's leaves need and that its own leaves don't give."""
    out, at = [], tile
    for level in range(levels, depth(n)):
        width = -(-n // ARITY**level)
        low = at - at % ARITY
        out += [(level, k) for k in range(low, min(low + ARITY, width)) if k != at]
        at //= ARITY
    return out


def fetched(nodes: DataFrame, tiles: DataFrame, levels: int = LEVELS, shared: int = SHARED) -> DataFrame:
    """(tree, tile, held): for each leaf partition the missing nodes, as a list of (level, idx, digest).

    tiles: tree, tile, n. A node is asked for by the partitions below its run; it is laid out once for each shared of them.
    """

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*x[:2], *y) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True) for y in missing(x[1], x[2], levels)]
            for k in range(0, len(rows), 50_000):
                yield pa.record_batch({c: pa.array(x, pa.int64()) for c, x in zip(("tree", "tile", "level", "idx"), zip(*rows[k : k + 50_000], strict=True), strict=True)})

    asked = tiles.select("tree", "tile", "n").mapInArrow(named, "tree long, tile long, level long, idx long")
    asked = asked.withColumn("copy", F.expr(f"tile div {shared}"))
    below = F.pow(F.lit(float(ARITY)), F.col("level") + 1 - levels).cast("long")  # leaf partitions under a whole run
    run = F.expr(f"idx div {ARITY}")
    last = F.least((run + 1) * below, F.ceil(F.col("n") / ARITY**levels)) - 1
    copies = nodes.where(F.col("n") > F.pow(F.lit(float(ARITY)), F.col("level"))).select(
        "tree", "level", "idx", "digest", F.explode(F.sequence(F.floor(run * below / shared), F.floor(last / shared))).alias("copy"))
    held = asked.join(copies, ["tree", "level", "idx", "copy"])
    return held.groupBy("tree", "tile").agg(F.sort_array(F.collect_list(F.struct("level", "idx", "digest"))).alias("held"))


class Proofs:
    """The proofs of one leaf partition: own leaves from the place low on, and nodes by (level, index) from elsewhere."""

    def __init__(self, low: int, n: int, own: list[str], held: list[tuple[int, int, str]], levels: int = LEVELS):
        self.low, self.inside = low, min(levels, depth(n))
        self.own = levels_of(own, self.inside)
        above: dict[int, list[tuple[int, str]]] = {}
        for level, idx, x in held:
            above.setdefault(level, []).append((idx, x))
        self.steps, at = [], low // ARITY**levels
        for level in range(levels, depth(n)):
            run = sorted(above.get(level, []))
            left = [x for idx, x in run if idx < at]
            self.steps.append((left, [x for idx, x in run if idx > at]))
            at //= ARITY
        self.tail = "".join(x for left, right in self.steps for x in left + right)

    def siblings(self, pos: int) -> list[tuple[list[str], list[str]]]:
        """The others of a leaf's run and of each run above it: those to its left, those to its right."""
        out, at = [], pos - self.low
        for level in range(self.inside):
            low = at - at % ARITY
            run = self.own[level][low : low + ARITY]
            out.append((run[: at - low], run[at - low + 1 :]))
            at //= ARITY
        return out + self.steps

    def text(self, pos: int) -> str:
        """A leaf's proof as text; what lies above the partition is put together once for all its leaves."""
        return "".join(x for left, right in self.siblings(pos)[: self.inside] for x in left + right) + self.tail


def fold(leaf: str, siblings: list[tuple[list[str], list[str]]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in siblings:
        leaf = digest([*left, leaf, *right])
    return leaf


def _of(rows: pa.Table, held: pa.Table, levels: int) -> tuple[pa.Table, Proofs]:
    rows = rows.sort_by("pos")
    found = [(x["level"], x["idx"], x["digest"]) for x in held.column("held")[0].as_py() or []]
    return rows, Proofs(rows.column("pos")[0].as_py(), rows.column("n")[0].as_py(), rows.column("leaf").to_pylist(), found, levels)


def _ways(rows: pa.Table, held: pa.Table, levels: int) -> pa.Table:
    """Of leaves that are roots of other trees: their siblings on the way up, a level a line, '.' for the leaf itself."""
    rows, proofs = _of(rows, held, levels)
    way = ["\n".join(" ".join([*left, ".", *right]) for left, right in proofs.siblings(p)) for p in rows.column("pos").to_pylist()]
    return pa.table({"tree": rows.column("pos"), "subroot": rows.column("leaf"), "way": pa.array(way, pa.string())})


def _rows(rows: pa.Table, held: pa.Table, levels: int) -> pa.Table:
    rows, proofs = _of(rows, held, levels)
    way, subroot, root = (held.column(c)[0].as_py() for c in ("way", "subroot", "root"))
    above = [tuple(part.split() for part in line.split(".")) for line in way.split("\n")] if way else []
    tail = "".join(x for left, right in above for x in left + right)
    proof, folded = [], []
    for pos, own, other in zip(*(rows.column(c).to_pylist() for c in ("pos", "leaf", "forged")), strict=True):
        proof.append(digest([proofs.text(pos), tail]))
        folded.append(fold(other or own, proofs.siblings(pos) + above))
    same = {"subroot": [subroot] * len(proof), "root": [root] * len(proof), "proof_sha256": proof, "folded_root": folded}
    return pa.table({"doc_id": rows.column("doc_id"), "leaf": rows.column("leaf"), **{c: pa.array(x, pa.string()) for c, x in same.items()}})


def per_partition(leaves: DataFrame, held: DataFrame, run, form: str, levels: int) -> DataFrame:
    """run(rows, held, levels) for each leaf partition: its rows, and the row of held with what it has fetched."""
    held = held.withColumnsRenamed({"tree": "of_tree", "tile": "of_tile"})
    grouped = _tiled(leaves, levels).groupBy("tree", "tile").cogroup(held.groupBy("of_tree", "of_tile"))
    return grouped.applyInArrow(lambda rows, held: run(rows, held, levels), form)


def _most(leaves: DataFrame) -> int:
    return leaves.agg(F.max("n")).first()[0] or 0


def prove(docs: DataFrame, forged: Column | None = None, levels: int = LEVELS, shared: int = SHARED) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of docs (the columns of FIELDS).

    subroot is the root of the row's language, root that of all. proof_sha256 is the hash of the row's proof, folded_root
    the root that the proof gives for the row's leaf, or for the leaf in forged where that isn't null. Texts are read once;
    what moves after that is a leaf a row. levels and shared change the work's division alone.
    """

    def partitions(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
        tiles = _tiled(leaves, levels).select("tree", "n", "tile").distinct()
        return tiles.select("tree", "tile").join(fetched(nodes, tiles, levels, shared), ["tree", "tile"], "left")

    none = F.lit(None).cast("string")
    leaves = cut(docs.select("doc_id", "lang", leaf().alias("leaf"), (none if forged is None else forged).alias("forged")))
    leaves = cut(placed(leaves, ["lang"], ["doc_id", "leaf"]))
    langs = placed(leaves.select("lang").distinct().withColumn("size", F.lit(1)), [], ["lang"]).select(F.col("lang").alias("_lang"), F.col("pos").alias("tree"), F.col("n").alias("trees"))
    langs = cut(langs)
    leaves = leaves.join(langs, leaves.lang.eqNullSafe(langs._lang)).select("doc_id", "tree", "n", "pos", "leaf", "forged")
    nodes, roots = nodes_above(leaves, _most(leaves), levels)
    tops = roots.join(langs, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("trees").alias("n"), F.col("tree").alias("pos"), F.col("root").alias("leaf"))
    tops = cut(tops)
    over, root = nodes_above(tops, _most(tops), levels)
    ways = per_partition(tops, partitions(tops, over), _ways, "tree long, subroot string, way string", levels)
    ways = ways.withColumn("over", F.lit(0).cast("long")).join(root.withColumnRenamed("tree", "over"), "over").drop("over")
    held = partitions(leaves, nodes).join(ways, "tree")
    form = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    return per_partition(leaves, held, _rows, form, levels).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = leaf({"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")})
    hit = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0
    return prove(table(spark, sf_dir, "documents"), F.when(hit, changed))


SQL = f"""
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, y: xor(x // 2, 3988292384 * (x % 2)))) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS forged
  FROM fields),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM leaves)),
placed AS (
  SELECT doc_id, tree, leaf, forged, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM leaves JOIN langs ON leaves.lang IS NOT DISTINCT FROM langs.lang),
nodes AS (
  SELECT tree, 0 AS level, pos AS idx, count(*) OVER (PARTITION BY tree) AS n, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY ALL),
above AS (
  SELECT 0 AS level, tree AS idx, count(*) OVER () AS n, digest FROM nodes WHERE n = 1
  UNION ALL
  SELECT level + 1, idx // {ARITY}, (n + {ARITY - 1}) // {ARITY}, sha256(string_agg(digest, '' ORDER BY idx)) FROM above WHERE n > 1 GROUP BY ALL),
deep AS (SELECT tree, max(level) AS levels FROM nodes GROUP BY tree),
runs AS (
  SELECT tree, level, idx // {ARITY} AS run, list(digest ORDER BY idx) AS held FROM nodes WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT tree, levels + level, idx // {ARITY}, list(digest ORDER BY idx) FROM above, deep WHERE n > 1 GROUP BY ALL),
folded AS (
  SELECT placed.*, levels, 0 AS level, pos AS idx, coalesce(forged, leaf) AS digest, '' AS proof FROM placed JOIN deep USING (tree)
  UNION ALL
  SELECT doc_id, f.tree, leaf, forged, pos, levels, f.level + 1, spot // {ARITY},
    sha256(array_to_string(held[:spot % {ARITY}], '') || digest || array_to_string(held[spot % {ARITY} + 2:], '')),
    proof || array_to_string(held[:spot % {ARITY}], '') || array_to_string(held[spot % {ARITY} + 2:], '')
  FROM (SELECT *, CASE WHEN level = levels THEN tree ELSE idx END AS spot FROM folded) f JOIN runs r ON r.tree = f.tree AND r.level = f.level AND r.run = spot // {ARITY}),
ends AS (SELECT tree, max(level) + 1 AS last FROM runs GROUP BY tree)
SELECT doc_id, leaf, s.digest AS subroot, a.digest AS root, sha256(proof) AS proof_sha256, f.digest AS folded_root, f.digest = a.digest AS verified
FROM folded f LEFT JOIN ends e ON e.tree = f.tree JOIN nodes s ON s.tree = f.tree AND s.n = 1 JOIN above a ON a.n = 1
WHERE f.level = coalesce(last, 0)"""
