"""Helpers shared by the operators of this subpackage: shared scratch space, words and hashes."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything else belongs to a word.
BLANKS = " \t\n\x0b\f\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one numpy step handles; bounds the memory of a task whatever the batch holds.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode one of our own where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't use yet."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name = "_" + name
    return name


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def row_key() -> F.Column:
    """A key of a document row: rows of equal id and text share it, which every user of it allows for."""
    return F.xxhash64(F.lit("row"), F.col("doc_id"), F.col("text"))


def row_keys() -> dict[str, F.Column]:
    """rk and rk2, together a 128-bit key of a document row; rows of equal id and text share it."""
    return {name: F.xxhash64(F.lit(name), F.col("doc_id"), F.col("text")) for name in ("rk", "rk2")}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit numbers (shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[ord(c) for c in BLANKS]] = False
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**64, 256, dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 12), base, dtype=np.uint64)
        got[0] = 1
        got = _POWERS[base] = np.cumprod(got, dtype=np.uint64)
    return got[:n]


def slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of at most SLICE_BYTES of text each, or of one longer row."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    at = 0
    while at < len(lengths):
        room = np.searchsorted(np.cumsum(lengths[at : at + 20_000]), SLICE_BYTES, side="right")
        upto = min(len(lengths), at + max(1, int(room)))
        yield at, upto
        at = upto


class Words:
    """The words of some rows of a text column, as positions in its UTF-8 bytes.

    start, end: of each word in data; row: the row that holds it; first: index of each row's first word, with a last
    entry that closes the final row. token_bytes tells which bytes belong to words, begins at which a word ends another.
    """

    def __init__(self, column: pa.Array, token_bytes=lambda data: _IN_WORD[data], begins=None):
        column = pc.fill_null(column, "").cast(pa.large_string())
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        held = column.buffers()[2]
        data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, dtype=np.uint8)
        self.data = data[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        inside = token_bytes(self.data)
        before = np.zeros(len(inside) + 1, dtype=bool)
        before[1:] = inside
        after = before[1:].copy()
        before = before[:-1]
        before[offsets[:-1][offsets[:-1] < len(inside)]] = False
        after = np.append(inside[1:], False)
        closing = offsets[1:]
        after[closing[closing > 0] - 1] = False
        if begins is not None:
            anew = begins(self.data)
            before &= ~anew
            after[:-1] &= ~anew[1:]
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.row, np.arange(len(column) + 1))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        if not len(self):
            return np.zeros(0, dtype=np.uint64)
        upto = np.append(self.start[1:], len(self.data))
        place = np.arange(self.start[0], len(self.data)) - np.repeat(self.start, upto - self.start)
        weight = powers(0x9E3779B97F4A7C15 | 1, int(place.max()) + 1)
        terms = _BYTE[self.data[self.start[0] :]] * weight[place]
        terms[np.repeat(self.end, upto - self.start) <= np.arange(self.start[0], len(self.data))] = 0
        sums = np.add.reduceat(terms, self.start - self.start[0])
        return mix(sums ^ (self.end - self.start).astype(np.uint64))

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def window_hashes(x: np.ndarray, size: int, base: int) -> np.ndarray:
    """A hash of each run of size neighbouring items, all rows taken as one series."""
    n = len(x) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(x * powers(base, len(x)), dtype=np.uint64, out=sums[1:])
    back = powers(pow(base, -1, 2**64), n)
    return mix((sums[size:] - sums[:n]) * back)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
