"""Line dedup that can be undone: sharded cuckoo filters in front of exact reference counts.

The index has two tables, both keyed by a 128-bit hash of a line's key and dealt to shards by it:

* counts (shard, key, n_docs): how many documents hold the line, exactly. A batch of documents is added or taken away by
  a table of its own counts, positive or negative, that is put beside the ones before; counts are their sums, so taking a
  batch away leaves what there was. After MOST_PARTS batches the tables are summed into one, in more shards if they grew.
* filters (shard, slots, filter): a cuckoo filter of the keys that reach min_docs. Fingerprints can be deleted from it,
  so it follows the counts both ways; only the filters of shards with a key that crossed min_docs are written again.

To clean documents, the distinct keys of their lines are looked up in the filters of their shards first; what passes is
confirmed against the exact counts, so a false positive of a filter never drops a line. Keys are counted with map-side
combining, and shards get distinct keys only, so a line that stands in every document is no hot key there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, cut, mix, row_key, slices, table

_WAYS = 4
_KICKS = 500
_BLANKS = BLANKS.encode()
#: Tables of counts that an index may have before they are summed into one.
MOST_PARTS = 8


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; a key may be in one of two buckets. Doubles when it gets too full."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        size = 1 << max(2, int(np.ceil(np.log2(max(1, len(keys)) / (_WAYS * 0.85)))) if len(keys) else 2)
        while True:
            made = cls(np.zeros((size, _WAYS), dtype=np.uint16))
            if made.insert_all(keys):
                return made
            size *= 2

    def insert_all(self, keys: np.ndarray) -> bool:
        """insert() of many keys: those that find room in one of their buckets go in together, the rest one by one."""
        keys = np.asarray(keys, dtype=np.uint64)
        for which in (1, 2):
            places = self._places(keys)
            order = np.argsort(places[which], kind="stable")
            bucket, print_ = places[which][order].astype(np.int64), places[0][order]
            heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(bucket)])
            rank = np.arange(len(bucket)) - np.repeat(heads, np.diff(np.append(heads, len(bucket))))
            held = self.slots[bucket] != 0
            fits = rank < _WAYS - held.sum(axis=1)
            way = np.argsort(held, axis=1, kind="stable")[np.arange(len(bucket)), np.minimum(rank, _WAYS - 1)]  # free ways first
            self.slots[bucket[fits], way[fits]] = print_[fits]
            keys = keys[order[~fits]]
        return all(self.insert(k) for k in keys)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = np.asarray(keys, dtype=np.uint64)
        print_ = (keys >> np.uint64(48)).astype(np.uint16)
        print_ = np.where(print_ == 0, 1, print_).astype(np.uint16)
        mask = np.uint64(len(self.slots) - 1)
        one = mix(keys) & mask
        return print_, one, one ^ (mix(print_.astype(np.uint64)) & mask)

    def insert(self, key: int) -> bool:
        print_, one, two = (x[0] for x in self._places(np.array([key], dtype=np.uint64)))
        at = one
        for b in (one, two):
            free = np.flatnonzero(self.slots[b] == 0)
            if len(free):
                self.slots[b, free[0]] = print_
                return True
        mask = np.uint64(len(self.slots) - 1)
        for k in range(_KICKS):
            way = k % _WAYS
            print_, self.slots[at, way] = self.slots[at, way], print_
            at = at ^ (mix(np.array([print_], dtype=np.uint64))[0] & mask)
            free = np.flatnonzero(self.slots[at] == 0)
            if len(free):
                self.slots[at, free[0]] = print_
                return True
        return False

    def delete(self, key: int) -> bool:
        """Only of keys that were inserted."""
        print_, one, two = (x[0] for x in self._places(np.array([key], dtype=np.uint64)))
        for b in (one, two):
            held = np.flatnonzero(self.slots[b] == print_)
            if len(held):
                self.slots[b, held[0]] = 0
                return True
        return False

    def contains(self, keys: np.ndarray) -> np.ndarray:
        print_, one, two = self._places(keys)
        return ((self.slots[one] == print_[:, None]) | (self.slots[two] == print_[:, None])).any(axis=1)


@dataclass(frozen=True)
class LineIndex:
    parts: tuple[DataFrame, ...]
    filters: DataFrame
    shards: int
    min_docs: int
    keys_per_shard: int

    @property
    def counts(self) -> DataFrame:
        """(shard, key, n_docs) with the exact sums over all parts."""
        if len(self.parts) == 1:
            return self.parts[0]
        held = self.parts[0]
        for p in self.parts[1:]:
            held = held.unionByName(p)
        return held.groupBy("shard", "key").agg(F.sum("n_docs").alias("n_docs")).where("n_docs <> 0")


def line_keys(text: str | None) -> list[bytes | None]:
    """A hash of each line's key, the line without ASCII blanks at its ends and with A-Z in lower case; None for an empty key."""
    keys = [x.strip(_BLANKS).lower() for x in (text or "").encode().split(b"\n")]
    return [hashlib.md5(k, usedforsecurity=False).digest() if k else None for k in keys]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, rk = batch.column("text"), np.asarray(batch.column("rk"))
        for a, b in slices(text):
            held = [set(line_keys(t)) - {None} for t in text.slice(a, b - a).to_pylist()]
            row = np.repeat(rk[a:b], [len(x) for x in held])
            yield pa.record_batch({"rk": pa.array(row), "key": pa.array([k for own in held for k in own], pa.binary())})


def lines_of(docs: DataFrame) -> DataFrame:
    """(rk, key) of the distinct keys of each row's lines, stored, so that texts are split and hashed once."""
    return cut(docs.select(row_key().alias("rk"), "text").mapInArrow(_pairs, "rk long, key binary"))


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def _as_numbers(keys: pa.Array) -> np.ndarray:
    return np.array([int.from_bytes(k[:8], "big") for k in keys.to_pylist()], dtype=np.uint64)


def _build(part: pa.Table) -> pa.Table:
    made = CuckooFilter.of(_as_numbers(part["key"].combine_chunks()))
    return pa.table({"shard": part["shard"][:1].cast(pa.int32()), "slots": pa.array([len(made.slots)], pa.int64()), "filter": pa.array([made.slots.tobytes()], pa.binary())})


def _update(filters: pa.Table, changes: pa.Table) -> pa.Table:
    """One shard's filter after keys crossed min_docs: upwards they are inserted, downwards deleted."""
    keys, up = _as_numbers(changes["key"].combine_chunks()), np.asarray(changes["up"].combine_chunks(), dtype=bool)
    made = CuckooFilter(np.frombuffer(filters["filter"][0].as_py(), dtype=np.uint16).reshape(-1, _WAYS).copy()) if len(filters) else CuckooFilter.of(keys[:0])
    for k in keys[~up]:
        made.delete(k)
    full = not made.insert_all(keys[up])
    return pa.table({"shard": changes["shard"][:1].cast(pa.int32()), "slots": pa.array([-1 if full else len(made.slots)], pa.int64()), "filter": pa.array([made.slots.tobytes()], pa.binary())})


_FILTER_FORM = "shard int, slots long, filter binary"


def _whole(counts: DataFrame, min_docs: int, keys_per_shard: int) -> LineIndex:
    """An index of one part; the number of shards follows the number of keys."""
    counts = cut(counts.select("key", "n_docs"))
    shards = max(1, counts.count() // keys_per_shard + 1)
    counts = counts.select(_shard(shards).alias("shard"), "key", "n_docs")
    filters = counts.where(F.col("n_docs") >= min_docs).groupBy("shard").applyInArrow(_build, _FILTER_FORM)
    return LineIndex((counts,), cut(filters), shards, min_docs, keys_per_shard)


def _counted(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("key").agg(F.count("*").alias("n_docs"))


def build_index(docs: DataFrame, min_docs: int = 10, keys_per_shard: int = 100_000, pairs: DataFrame | None = None) -> LineIndex:
    """The index of docs (doc_id, text; other columns are left out), or of the lines_of() them where these are given."""
    return _whole(_counted(lines_of(docs) if pairs is None else pairs), min_docs, keys_per_shard)


def _changed(index: LineIndex, docs: DataFrame, sign: int) -> LineIndex:
    low = index.min_docs
    batch = cut(_counted(lines_of(docs)).select(_shard(index.shards).alias("shard"), "key", (F.col("n_docs") * sign).alias("n_docs")))
    after = replace(index, parts=(*index.parts, batch))
    was = index.counts.join(batch.select("key"), "key", "left_semi").select("key", F.col("n_docs").alias("was"))
    both = batch.join(was, "key", "left").select("shard", "key", F.coalesce("was", F.lit(0)).alias("was"), (F.coalesce("was", F.lit(0)) + F.col("n_docs")).alias("now"))
    changes = cut(both.where((F.col("was") >= low) != (F.col("now") >= low)).select("shard", "key", (F.col("now") >= low).alias("up")))
    touched = changes.select("shard").distinct()
    old = index.filters.join(touched, "shard", "left_semi")
    new = cut(old.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(_update, _FILTER_FORM))
    full = new.where("slots < 0").select("shard")
    if not full.isEmpty():
        again = after.counts.where(F.col("n_docs") >= low).join(full, "shard", "left_semi").groupBy("shard").applyInArrow(_build, _FILTER_FORM)
        new = cut(new.where("slots > 0").unionByName(again))
    if len(after.parts) > MOST_PARTS:
        return _whole(after.counts, low, index.keys_per_shard)
    return replace(after, filters=index.filters.join(touched, "shard", "left_anti").unionByName(new))


def add_documents(index: LineIndex, docs: DataFrame) -> LineIndex:
    return _changed(index, docs, 1)


def remove_documents(index: LineIndex, docs: DataFrame) -> LineIndex:
    """Undoes add_documents() of the same rows."""
    return _changed(index, docs, -1)


def _probe(keys: pa.Table, filters: pa.Table) -> pa.Table:
    if not len(filters) or not len(keys):
        return pa.table({"key": keys["key"][:0]})
    made = CuckooFilter(np.frombuffer(filters["filter"][0].as_py(), dtype=np.uint16).reshape(-1, _WAYS))
    return pa.table({"key": keys["key"].filter(pa.array(made.contains(_as_numbers(keys["key"].combine_chunks()))))})


def frequent_keys(keys: DataFrame, index: LineIndex) -> DataFrame:
    """The keys of a table of distinct ones that the index has in min_docs documents or more."""
    dealt = keys.select(_shard(index.shards).alias("shard"), "key")
    passed = dealt.groupBy("shard").cogroup(index.filters.groupBy("shard")).applyInArrow(_probe, "key binary")
    exact = index.counts.where(F.col("n_docs") >= index.min_docs).select("key")
    return passed.join(exact, "key", "left_semi")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column("text")):
            part = batch.slice(a, b - a)
            texts, n_lines, n_dropped = [], [], []
            for text, bad in zip(part.column("text").to_pylist(), part.column("bad").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                if bad:
                    gone = set(bad)
                    kept = [x for x, k in zip(lines, line_keys(text), strict=True) if k not in gone]
                else:
                    kept = lines
                texts.append("\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            yield pa.record_batch({"doc_id": part.column("doc_id"), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "kept": pa.array(texts, pa.string())})


def drop_lines(docs: DataFrame, index: LineIndex, pairs: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of docs: their texts without the lines that are frequent in the index.

    Lines end at \\n; a null or empty text is one empty line, and lines of an empty key always stay. Kept lines are joined
    by \\n. Repeated rows are documents of their own. Other columns are left out. pairs are the lines_of() docs.
    """
    pairs = lines_of(docs) if pairs is None else pairs
    hot = frequent_keys(pairs.select("key").distinct(), index)
    bad = cut(pairs.join(cut(hot), "key").groupBy("rk").agg(F.collect_set("key").alias("bad")))
    rows = docs.select("doc_id", "text").withColumn("rk", row_key()).join(bad, "rk", "left")
    return rows.select("doc_id", "text", "bad").mapInArrow(_kept, "doc_id long, n_lines long, n_dropped long, kept string")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pairs = lines_of(docs)
    out = drop_lines(docs, build_index(docs, min_docs=10, pairs=pairs), pairs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
k AS (SELECT doc_id, l, list_transform(l, lambda x: translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS k FROM d),
f AS (SELECT key FROM (SELECT unnest(list_distinct(k)) AS key FROM k) WHERE key <> '' GROUP BY key HAVING count(*) >= 10),
s AS (SELECT doc_id, l, k, unnest(range(1, len(l) + 1)) AS i FROM k),
t AS (SELECT doc_id, i, l[i] AS line, k[i] IN (SELECT key FROM f) AS gone FROM s)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM t GROUP BY doc_id
"""
