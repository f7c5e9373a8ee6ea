"""N-gram Jaccard join: MinHash banding finds candidates, the full n-gram sets decide.

1. Each text becomes its set of word n-grams, and the set a MinHash signature cut into bands. Band and row counts follow
   from the threshold and the recall wanted at it. Texts of equal sets are copies and go on as one node with a weight;
   a node is named by a 128-bit hash of its set, so rows need no ids of their own.
2. Nodes are shuffled on band hashes. A bucket gives star edges to one of its nodes only, never its pairs; components of
   these edges hold every pair that shares a band, and say how the pairs are best verified.
3. A component of few nodes is verified whole. A larger one is verified bucket by bucket, where a pair counts in the
   first band that it shares, unless its buckets hold more pairs together than the component does (groups of near copies
   share most of their bands). Nodes of a component or bucket are dealt to blocks of about block nodes, or fewer where
   their sets are large (block_grams n-grams in all), each pair of blocks is one task's work, and shared n-grams are counted in a matrix. What leaves a task is one row per node: its
   number of links and a link to the first node of its class there. So a group of thousands of near copies keeps all its
   links, but they are counted and never emitted.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, cut, fresh, mix, row_keys, slices, table, window_hashes
from .graph import components

_BASE = 0xC2B2AE3D27D4EB4F


def plan_bands(threshold: float, recall: float, most: int = 160) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most so many hashes with that recall at the threshold."""
    best = (1, 1)
    for rows in range(1, 33):
        bands = max(1, math.ceil(math.log1p(-recall) / math.log1p(-(threshold**rows))))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def ngram_sets(words: Words, n: int) -> list[np.ndarray]:
    """Each row's distinct n-gram hashes, sorted; a row of fewer than n words has one for all of them, an empty row none."""
    x = words.hashes()
    grams = window_hashes(x, n, _BASE)
    found = []
    for lo, hi in zip(words.first[:-1], words.first[1:], strict=True):
        if hi - lo >= n:
            found.append(np.unique(grams[lo : hi - n + 1]))
        elif hi > lo:
            found.append(window_hashes(x[lo:hi], int(hi - lo), _BASE) ^ np.uint64(hi - lo))
        else:
            found.append(grams[:0])
    return found


def _signatures(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.Generator(np.random.PCG64(411)).integers(0, 2**64, (2, bands * rows), dtype=np.uint64)
        times, plus = draw[0] | np.uint64(1), draw[1]
        for batch in batches:
            text = batch.column("text")
            for a, b in slices(text):
                sets = ngram_sets(Words(text.slice(a, b - a)), n)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                out = [None] * len(sets)
                if full:
                    grams = np.concatenate([sets[i] for i in full])
                    first = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
                    least = np.stack([np.minimum.reduceat(grams * t + p, first) for t, p in zip(times, plus, strict=True)], axis=1)
                    named = np.zeros((len(full), bands), dtype=np.uint64)
                    for r in range(rows):
                        named = mix(named * np.uint64(_BASE) + least[:, r::rows][:, :bands])
                    named = mix(named + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_BASE)).view(np.int64)
                    for k, i in enumerate(full):
                        out[i] = named[k]
                rows_ = {c: batch.column(c).slice(a, b - a) for c in ("doc_id", "rk", "rk2")}
                yield pa.record_batch(rows_ | {"key": pa.array(keys, pa.binary()), "size": pa.array([len(s) for s in sets], pa.int64()), "bands": pa.array(out, pa.list_(pa.int64()))})

    return run


def _sets(n: int):
    """(key, n, jobs, bands, grams) of the rows whose n-gram set has their node's name, once for each node that meets it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            text, key = batch.column("text"), batch.column("key").to_pylist()
            for a, b in slices(text):
                held = [s.tobytes() for s in ngram_sets(Words(text.slice(a, b - a)), n)]
                fits = []
                for x, k in zip(held, key[a:b], strict=True):
                    fits.append(k != last and hashlib.blake2b(x, digest_size=16).digest() == k)
                    last = k if fits[-1] else last
                cols = {c: batch.column(c).slice(a, b - a) for c in ("key", "n", "jobs", "bands")}
                yield pa.record_batch({**cols, "grams": pa.array(held, pa.binary())}).filter(pa.array(fits, pa.bool_()))

    return run


def shared(a: list[np.ndarray], b: list[np.ndarray], width: int = 1 << 15) -> np.ndarray:
    """How many elements each set of a shares with each set of b."""
    if len(a) * len(b) <= 64:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a], dtype=np.int64).reshape(len(a), len(b))
    left, right = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(left, right)
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    sides = []
    for flat, sets in ((left, a), (right, b)):
        who, where = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.searchsorted(both, flat)
        held = (where < len(both)) & (both[np.minimum(where, max(len(both) - 1, 0))] == flat) if len(both) else np.zeros(len(flat), bool)
        sides.append((who[held], where[held]))
    for lo in range(0, len(both), width):
        planes = []
        for (who, where), sets in zip(sides, (a, b), strict=True):
            part = (where >= lo) & (where < lo + width)
            plane = np.zeros((len(sets), min(width, len(both) - lo)), dtype=np.float32)
            plane[who[part], where[part] - lo] = 1
            planes.append(plane)
        out += (planes[0] @ planes[1].T).astype(np.int64)
    return out


def _verify(threshold: float):
    p, q = Fraction(threshold).limit_denominator(10_000).as_integer_ratio()

    def one(part: pd.DataFrame) -> list[tuple[bytes, bytes, int]]:
        part = part.drop_duplicates("key").sort_values("key")
        if len(part) < 2:
            return []
        inner = part["lo"].iat[0] == part["hi"].iat[0]
        a = np.flatnonzero(part["own"].to_numpy() == part["lo"].to_numpy())
        b = a if inner else np.flatnonzero(part["own"].to_numpy() == part["hi"].to_numpy())
        if not len(a) or not len(b):
            return []
        sets = [np.frombuffer(x, dtype=np.uint64) for x in part["grams"]]
        size = np.array([len(s) for s in sets])
        inter = shared([sets[i] for i in a], [sets[i] for i in b])
        near = inter * q >= p * (size[a][:, None] + size[b][None, :] - inter)
        if inner:
            np.fill_diagonal(near, False)
        if not part["whole"].iat[0]:
            bands = np.stack(part["bands"].to_numpy())
            for band in bands.T[: int(np.flatnonzero(bands[0] == part["set"].iat[0])[0])]:
                near &= band[a][:, None] != band[b][None, :]  # pairs that an earlier band has
        weight = part["n"].to_numpy()
        links = np.zeros(len(part), dtype=np.int64)
        links[a] += near @ weight[b]
        if not inner:
            links[b] += near.T @ weight[a]
        root = np.arange(len(part))
        while True:  # the smallest index in reach; as many rounds as the longest chain
            new = root.copy()
            np.minimum.at(new, a, np.where(near, root[b][None, :], len(part)).min(axis=1))
            np.minimum.at(new, b, np.where(near, root[a][:, None], len(part)).min(axis=0))
            new = new[new]
            if (new == root).all():
                break
            root = new
        key = part["key"].to_numpy()
        return [(key[i], key[root[i]], int(links[i])) for i in np.flatnonzero(links)]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        found = [r for _, x in part.groupby(["whole", "set", "lo", "hi"], sort=False) for r in one(x)]
        return pd.DataFrame(found, columns=["key", "root", "links"]).astype({"links": "int64"})

    return run


def _jobs(nodes: DataFrame, block: int, block_grams: int) -> DataFrame:
    """(rep, key, n, grams, bands, jobs) of the nodes that share a band with another one.

    jobs are (whole, set, blocks): the component, or the buckets, that a node is verified in, and in how many blocks.
    """

    def blocks(count: str) -> Column:
        return F.ceil(F.greatest(F.col(count) / block, F.col("held") / block_grams)).cast("long").alias("blocks")

    banded = nodes.select("rep", "grams", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("rep").alias("lead"), F.max("rep").alias("last"), F.count("*").alias("size"), F.sum("grams").alias("held")).where("lead < last")
    buckets = cut(buckets.select("band", "lead", "size", "held"))
    near = components(banded.join(buckets, "band").where("rep <> lead").select("rep", "lead"), "rep", "lead")
    size = near.join(nodes, near.node == nodes.rep).groupBy("component").agg(F.count("*").alias("m"), F.sum("grams").alias("held"))
    pairs = buckets.join(near, buckets.lead == near.node).groupBy("component").agg(F.sum(F.col("size") * F.col("size")).alias("pairs"))
    whole = (F.col("m") <= block) | (F.col("pairs") >= F.col("m") * F.col("m"))
    size = cut(size.join(pairs, "component").select("component", whole.alias("whole"), blocks("m")))
    held = near.join(size, "component").join(nodes, near.node == nodes.rep)
    one = held.where("whole").select("rep", "key", "n", "grams", F.lit(None).cast("array<long>").alias("bands"), F.array(F.struct(F.col("whole"), F.col("component").alias("set"), F.col("blocks"))).alias("jobs"))
    apart = held.where("NOT whole").select("rep", "whole", F.explode("bands").alias("band")).join(buckets, "band")
    job = F.struct(F.col("whole"), F.col("band").alias("set"), blocks("size"))
    apart = apart.groupBy("rep").agg(F.collect_list(job).alias("jobs")).join(nodes, "rep")  # a job for each band at most
    return one.unionByName(apart.select(one.columns))


def link_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, block: int = 512, block_grams: int = 1 << 22) -> tuple[DataFrame, DataFrame]:
    """rows (doc_id, rk, rk2, key) and nodes (key, first, class_first, n_links) of docs (doc_id, text).

    A node stands for all rows of one n-gram set; key is NULL for rows without words. first is the node's first row by
    (doc_id, nulls last, then row_keys()), class_first that of its class, n_links the links of each of its rows.
    """
    bands, rows = plan_bands(threshold, recall)
    base = docs.select("doc_id", "text").withColumns(row_keys())
    signed = cut(base.mapInArrow(_signatures(n, bands, rows), "doc_id long, rk long, rk2 long, key binary, size long, bands array<long>"))
    first = F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "rk", "rk2")
    nodes = signed.where("key IS NOT NULL").groupBy("key").agg(F.min(first).alias("first"), F.count("*").alias("n"), F.first("size").alias("grams"), F.first("bands").alias("bands"))
    nodes = cut(nodes.select("key", "first", F.col("first.rk").alias("rep"), "n", "grams", "bands"))

    dealt = cut(_jobs(nodes.select("key", "rep", "n", "grams", "bands"), block, block_grams))
    small = F.size(F.filter("jobs", lambda j: j["blocks"] == 1))
    few, their = (x or 0 for x in dealt.agg(F.sum(small), F.sum(small * F.col("grams"))).first())
    texts = base.join(dealt, base.rk == dealt.rep).select("text", "key", "n", "jobs", "bands")
    held = texts.mapInArrow(_sets(n), "key binary, n long, jobs array<struct<whole:boolean,set:long,blocks:long>>, bands array<long>, grams binary")
    held = held.select("key", "n", "bands", "grams", F.explode("jobs").alias("job")).select("key", "n", "bands", "grams", "job.*")
    held = held.withColumn("own", F.pmod(F.xxhash64(F.lit("block"), "key"), F.col("blocks")))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    held = held.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    bins = F.pmod(F.xxhash64("whole", "set"), F.lit(max(1, few // block, their // block_grams)))  # small sets share tasks
    task = F.when(F.col("blocks") == 1, bins).otherwise(F.xxhash64("whole", "set", "lo", "hi"))
    found = cut(held.withColumn("task", task).groupBy("task").applyInPandas(_verify(threshold), "key binary, root binary, links long"))

    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    classes = components(found.where("key <> root"), "key", "root")
    lowest = cut(classes.join(nodes, classes.node == nodes.key).groupBy("component").agg(F.min("first").alias("class_first")))
    classes = cut(classes.join(lowest, "component").select(F.col("node").alias("key"), "class_first"))
    out = nodes.join(links, "key", "left").join(classes, "key", "left")
    n_links = F.coalesce("links", F.lit(0)) + F.col("n") - 1
    out = out.select("key", "first", F.coalesce("class_first", "first").alias("class_first"), n_links.alias("n_links"))
    return signed.select("doc_id", "rk", "rk2", "key"), cut(out)  # both stored, so that a node of many rows is split


def ngram_join(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, n_links) of every row of docs (doc_id, text; other columns are left out).

    Two rows link if their sets of n-grams of words (cut at ASCII white space, unchanged) have a Jaccard likeness of
    threshold or more; a text of fewer than n words has one n-gram, all of it. n_links counts the other rows that a
    row links to, copies included; class_id is the smallest doc_id of the rows in reach over links, NULL where none has
    one. A null text or one without words links to nothing and is a class of its own. Rows count one by one, whether
    they repeat, share a doc_id or have none. Pairs at the threshold are found with probability recall, more alike ones
    with more. Options are those of link_classes().
    """
    rows, nodes = link_classes(docs, **options)
    got = rows.join(nodes.select("key", F.col("class_first.doc_id").alias("class_id"), "n_links"), "key", "left")
    own = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return got.select("doc_id", own.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns, with one row of each class: that of smallest doc_id, those without one last.

    Only rows that link to another one go, whatever their ids; of rows that repeat the one that stays, one does.
    """
    rows, nodes = link_classes(docs, **options)
    one, two, verdict = fresh(docs, "_rk"), fresh(docs, "_rk2"), fresh(docs, "_verdict")
    first = (F.col("rk") == F.col("class_first.rk")) & (F.col("rk2") == F.col("class_first.rk2"))
    linked = rows.join(nodes.where("n_links > 0"), "key").groupBy("rk", "rk2").agg(F.bool_or(first).alias("stays"), F.count("*").alias("n"))
    marks = linked.select(F.col("rk").alias(one), F.col("rk2").alias(two), F.when(~F.col("stays"), "goes").when(F.col("n") > 1, "once").alias(verdict))
    keys = row_keys()
    marked = docs.withColumns({one: keys["rk"], two: keys["rk2"]}).join(marks.where(F.col(verdict).isNotNull()), [one, two], "left")
    once = marked.where(F.col(verdict) == "once").dropDuplicates([one, two])
    return marked.where(F.col(verdict).isNull()).unionByName(once).select(docs.columns)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM g),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.t = b.t AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
c(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.x, p.y FROM c JOIN p ON p.x = c.y),
k AS (SELECT x, count(*) AS n FROM p GROUP BY x)
SELECT c.x AS doc_id, min(c.y) AS class_id, coalesce(any_value(k.n), 0)::BIGINT AS n_links FROM c LEFT JOIN k USING (x) GROUP BY c.x
"""
