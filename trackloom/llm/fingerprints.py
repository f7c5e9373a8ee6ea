"""Document fingerprints: a quartile bucket digest over hashed byte triplets.

Triplets of a text's UTF-8 bytes, taken at several spacings, are counted in hashed buckets. A bucket is encoded in two bits
by the quartile of the text's own counts that it falls into, and the text's length in one byte on a logarithmic scale.
Two digests are compared by the buckets' quartile steps, the widest step weighing double, and by the length codes; the
score is bounded to 0 to 1 and is 1 for equal digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, row_key, slices, table

BUCKETS = 512
#: Byte places of the triplets, relative to their first byte: wide ones tell texts of one language apart.
SPACINGS = ((0, 2, 5), (0, 4, 8), (0, 3, 7))
#: The share of the score that hangs on the lengths, and the steps of the length code at which it is used up.
LENGTH_SHARE, LENGTH_STEPS = 0.1, 16


def digests(column: pa.Array) -> np.ndarray:
    """A row of 1 + BUCKETS small numbers for each text: the length code, then each bucket's quartile."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) if held is not None else np.zeros(0, np.uint64)
    offsets = offsets - offsets[0]
    row = np.repeat(np.arange(len(column)), np.diff(offsets))
    counts = np.zeros(len(column) * BUCKETS, dtype=np.int64)
    for k, (_, i, j) in enumerate(SPACINGS, 1):
        n = len(data) - j
        if n <= 0:
            continue
        key = data[:n] | (data[i : i + n] << np.uint64(8)) | (data[j : j + n] << np.uint64(16)) | np.uint64(k << 24)
        bucket = (key * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
        whole = row[:n] == row[j:]
        counts += np.bincount(row[:n][whole] * BUCKETS + bucket[whole].astype(np.int64), minlength=len(counts))
    counts = counts.reshape(len(column), BUCKETS)
    ranked = np.sort(counts, axis=1)
    out = np.zeros((len(column), 1 + BUCKETS), dtype=np.uint8)
    out[:, 0] = np.minimum(255, np.round(np.log1p(np.diff(offsets)) * 10))
    for q in (1, 2, 3):
        out[:, 1:] += counts > ranked[:, [BUCKETS * q // 4 - 1]]
    return out


def pack(digest: np.ndarray) -> list[bytes]:
    """The length code, then four buckets a byte."""
    four = digest[:, 1:].reshape(len(digest), -1, 4)
    packed = np.concatenate([digest[:, :1], four[..., 0] | (four[..., 1] << 2) | (four[..., 2] << 4) | (four[..., 3] << 6)], axis=1)
    return [x.tobytes() for x in packed]


def encode(digest: np.ndarray) -> list[str]:
    """pack() in lowercase hex."""
    return [x.hex() for x in pack(digest)]


def decode(fingerprints: list[str]) -> np.ndarray:
    return unpack([bytes.fromhex(x) for x in fingerprints])


def unpack(held: list[bytes]) -> np.ndarray:
    packed = np.frombuffer(b"".join(held), dtype=np.uint8).reshape(len(held), -1)
    four = np.stack([(packed[:, 1:] >> s) & 3 for s in (0, 2, 4, 6)], axis=2)
    return np.concatenate([packed[:, :1], four.reshape(len(packed), -1)], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests down to 0, row by row."""
    step = np.abs(a[:, 1:].astype(np.int16) - b[:, 1:].astype(np.int16))
    far = np.where(step == 3, 6, step).sum(axis=1) / (6 * BUCKETS)
    length = np.minimum(1, np.abs(a[:, 0].astype(np.int16) - b[:, 0].astype(np.int16)) / LENGTH_STEPS)
    return 1 - (1 - LENGTH_SHARE) * far - LENGTH_SHARE * length


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each row of docs (doc_id, text); a null text counts as ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for a, b in slices(text):
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(a, b - a), "fingerprint": pa.array(encode(digests(text.slice(a, b - a))), pa.string())})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def following(docs: DataFrame) -> DataFrame:
    """(rk, n_chars, next_rk): each distinct document row's key, its length in code points, and the next row's key.

    Rows go by doc_id, nulls first, then by key; the first follows the last. Ids are range-partitioned, so only one row
    for each partition meets in one place.
    """
    ids = docs.select("doc_id", row_key().alias("rk"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars")).distinct()
    placed = cut(ids.repartitionByRange("doc_id", "rk").withColumn("part", F.spark_partition_id()))
    order = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "rk")
    heads = placed.withColumn("n", F.row_number().over(order)).where("n = 1").select("part", "rk")
    ring = Window.partitionBy().orderBy("part")
    first = F.first("rk").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("part", F.coalesce(F.lead("rk").over(ring), first).alias("head"))
    return placed.withColumn("ahead", F.lead("rk").over(order)).join(heads, "part").select("rk", "n_chars", F.coalesce("ahead", "head").alias("next_rk"))


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        for a, b in slices(text):
            part = text.slice(a, b - a)
            heads = [(t or "")[:k] for t, k in zip(part.to_pylist(), batch.column("quarter").slice(a, b - a).to_pylist(), strict=True)]
            yield pa.record_batch({
                "rk": batch.column("before").slice(a, b - a),
                "next_id": batch.column("doc_id").slice(a, b - a),
                "head": pa.array(heads, pa.string()),
                "next_print": pa.array(pack(digests(part)), pa.binary()),
            })


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        for a, b in slices(text):
            part = batch.slice(a, b - a)
            own, edited, next_ = digests(part.column("text")), digests(part.column("edited")), unpack(part.column("next_print").to_pylist())
            cols = {c: part.column(c) for c in ("doc_id", "n_chars", "edited_sha256")}
            cols |= {"fingerprint": pa.array(encode(own), pa.string()), "edited_fingerprint": pa.array(encode(edited), pa.string())}
            yield pa.record_batch(cols | {"near_edited": pa.array(likeness(own, edited)), "near_next": pa.array(likeness(own, next_))})


def compare_edited(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and how near both the edited and the next text are.

    docs: doc_id, text; other columns are left out. The edited text has its last quarter of code points (rounded down)
    replaced by the first as many of the next document, which follows by doc_id; equal rows stand in the order once.
    A single document follows itself; an empty table gives no rows. Texts move once, and a quarter of them again.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), row_key().alias("rk"))
    order = following(docs)
    before = order.select(F.col("next_rk").alias("rk"), F.col("rk").alias("before"), F.floor(F.col("n_chars") / 4).alias("quarter"))
    once = rows.join(before, "rk").select("before", "quarter", "doc_id", "text")
    heads = once.mapInArrow(_heads, "rk long, next_id long, head string, next_print binary").dropDuplicates(["rk"])
    both = rows.join(heads, "rk").withColumn("n_chars", F.length("text").cast("long"))
    kept = (F.col("n_chars") - F.floor(F.col("n_chars") / 4)).cast("int")
    both = both.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), kept), "head")).withColumn("edited_sha256", F.sha2("edited", 256))
    form = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return both.select("doc_id", "text", "n_chars", "edited", "edited_sha256", "next_print").mapInArrow(_compared, form)


def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))
