"""Fill-in-middle documents: a text cut in three and put together in another order.

Cuts are given in code points, texts are kept in UTF-8. A rolling hash cuts a text's bytes into content-defined chunks, so
that texts that share passages share chunks; a worker keeps a summary for each chunk that it has seen, found by the chunk's
own bytes (which verifies it). A summary tells how many code points start in the chunk, whether a marker lies inside, and
the two bytes at either boundary, in which a marker that spans two chunks shows. Running sums of the counts tell the chunk
that holds a cut, and only that chunk is looked at again.

Texts, nulls counting as '', may be of any length; ids may repeat or be null (a null id counts as no digits).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, slices, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (b"<P>", b"<S>", b"<M>")
#: Of a hundred documents, how many stay plain, and how many of the others put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Bytes that the rolling hash sees, the least (but for a text's last one) and the most of a chunk, and the bits of the hash
#: that end one.
WINDOW, SHORTEST, LONGEST = 32, 256, 16_384
_ENDS = np.uint32(0x3FF << 22)
_GEAR = np.random.Generator(np.random.PCG64(70)).integers(0, 2**32, 256, dtype=np.uint32)
#: Bytes of chunks that a worker's cache holds in each of its two generations.
CACHE_BYTES = 32 << 20


def chunk_ends(data: np.ndarray) -> list[int]:
    """Where the chunks of one text's bytes end, the last at its own end; equal bytes give equal chunks but near the edges."""
    ends, last = [], 0
    for at in range(0, len(data), SLICE_BYTES):
        low = max(0, at - WINDOW + 1)
        h = _GEAR[data[low : at + SLICE_BYTES]]
        for s in (1, 2, 4, 8, 16):
            h[s:] += h[:-s] << np.uint32(s)
        for end in (np.flatnonzero((h[at - low :] & _ENDS) == 0) + at + 1).tolist():
            if end - last < SHORTEST:
                continue
            while end - last > LONGEST:
                last += LONGEST
                ends.append(last)
            if end - last >= SHORTEST:
                ends.append(last := end)
    while len(data) - last > LONGEST:
        last += LONGEST
        ends.append(last)
    if len(data) > last:
        ends.append(len(data))
    return ends


def summarize(chunk: bytes) -> tuple[int, bool, bytes, bytes]:
    """(code points that start in it, whether it holds a marker, its first two bytes, its last two)."""
    points = len(chunk) if chunk.isascii() else int(np.count_nonzero((np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80))
    return points, any(m in chunk for m in MARKERS), chunk[:2], chunk[-2:]


class Summaries:
    """Summaries by chunk, in two generations, so that a full cache keeps what is in use."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self.new, self.old, self.held = limit, {}, {}, 0

    def of(self, chunk: bytes) -> tuple[int, bool, bytes, bytes]:
        got = self.new.get(chunk)
        if got is None:
            got = self.old.get(chunk) or summarize(chunk)
            self.held += len(chunk)
            if self.held > self.limit:
                self.old, self.new, self.held = self.new, {}, len(chunk)
            self.new[chunk] = got
        return got


class Pieces:
    """One text as chunks: n code points, and whether it holds a marker."""

    def __init__(self, text: bytes, known: Summaries):
        self.text = text
        self.ends = chunk_ends(np.frombuffer(text, np.uint8))
        self.starts = [0, *self.ends[:-1]]
        found = [known.of(text[a:b]) for a, b in zip(self.starts, self.ends, strict=False)]
        self.upto = np.cumsum([0, *(x[0] for x in found)])
        self.n = int(self.upto[-1])
        self.marked = any(x[1] for x in found) or any(m in a[3] + b[2] for a, b in zip(found, found[1:], strict=False) for m in MARKERS)

    def place(self, point: int) -> int:
        """The byte at which a code point starts; n gives the end of the text."""
        if point >= self.n:
            return len(self.text)
        k = int(np.searchsorted(self.upto, point, side="right")) - 1
        chunk = np.frombuffer(self.text, np.uint8)[self.starts[k] : self.ends[k]]
        return self.starts[k] + int(np.flatnonzero((chunk & 0xC0) != 0x80)[point - self.upto[k]])


def arrange(text: bytes, draws: tuple[int, int, int, int], known: Summaries) -> tuple:
    """(n, form, code points of the prefix, of the middle, output) of one text by four draws of 32 bits each."""
    whole = Pieces(text, known)
    if not whole.n or whole.marked or draws[2] % 100 >= 100 - PLAIN:
        return whole.n, "plain", None, None, text
    low, high = sorted(x % (whole.n + 1) for x in draws[:2])
    a, b = whole.place(low), whole.place(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < SUFFIX_FIRST:
        return whole.n, "spm", low, high - low, b"".join((b"<S>", suffix, b"<P>", prefix, b"<M>", middle))
    return whole.n, "psm", low, high - low, b"".join((b"<P>", prefix, b"<S>", suffix, b"<M>", middle))


_KNOWN = Summaries()


def _arranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "").cast(pa.binary())
        for a, b in slices(texts):
            ids = batch.column("doc_id").slice(a, b - a)
            seeds = [hashlib.sha256(b"1:" + (b"" if i is None else b"%d" % i)).digest() for i in ids.to_pylist()]
            draws = np.frombuffer(b"".join(seeds), ">u4").reshape(-1, 8)[:, :4].tolist()
            rows = [arrange(t, tuple(d), _KNOWN) for t, d in zip(texts.slice(a, b - a).to_pylist(), draws, strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True)
            yield pa.record_batch({
                "doc_id": ids.cast(pa.int64()), "n": pa.array(n, pa.int64()), "form": pa.array(form, pa.string()),
                "prefix_chars": pa.array(prefix, pa.int64()), "middle_chars": pa.array(middle, pa.int64()), "output": pa.array(output, pa.binary()).cast(pa.string()),
            })


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row of docs (doc_id, text); other columns are left out.

    form is plain (the text itself: empty ones, those that hold a marker, a tenth of the others), psm or spm; the draws
    that decide it and the cuts hang on doc_id alone, so a run can be repeated, and equal rows give equal rows.
    """
    form = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select("doc_id", "text").mapInArrow(_arranged, form)


def restored(output: str = "output", form: str = "form") -> F.Column:
    """The text that an output was made of; a text with markers is plain, so the first of each marker is the one put in."""
    out = F.col(output)
    second, middle = F.when(F.col(form) == "psm", F.instr(out, SUFFIX)).otherwise(F.instr(out, PREFIX)), F.instr(out, MIDDLE)
    one, two, rest = F.substring(out, F.lit(4), second - 4), F.substring(out, second + 3, middle - second - 3), F.substring(out, middle + 3, F.length(out))
    return F.when(F.col(form) == "plain", out).when(F.col(form) == "psm", F.concat(one, rest, two)).otherwise(F.concat(two, rest, one))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
numbers AS (
  SELECT doc_id, text, n, list_transform([1, 2, 3, 4], lambda k: list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9),
    lambda j: instr('0123456789abcdef', substr(h, 8 * k - 8 + j, 1)) - 1)), lambda x, y: 16 * x + y)) AS h FROM drawn),
formed AS (
  SELECT doc_id, text, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS low, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS high,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
         WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
parts AS (
  SELECT *, substring(text, 1, low) AS prefix, substring(text, low + 1, high - low) AS middle, substring(text, high + 1, n - high) AS suffix FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts"""
