"""Benchmark decontamination by template canonicalisation.

Texts become template tokens: case and punctuation go, and numbers, units behind a number and names inside a sentence
become typed placeholders whose own text is kept as a slot. Windows of template tokens are hash-joined with the windows
of all benchmark items. The matches of one document with one item on one alignment must fill the item's slots by a rule:
equal values of the item change to one value of the document, the one that most of their places read. Windows with a
slot that changes otherwise are dropped; those of literals and unchanged slots alone match word for word and stay. So a
question with other numbers, names or units is found, and a chance match of a frame is not.

Items that have no window with enough literals (short or number-dense ones) are looked for word by word instead, in
windows of their own length or size words, none of them a placeholder. Items of a word or two, which any document may
hold by chance, are found where they are a document's whole text. Scripts written without blanks are cut into
characters. Names are known by capital letters in ASCII and Latin-1.

A bitmap of fixed size over the benchmark's window hashes lets tasks drop windows that can't match before the shuffle;
the join itself is exact and takes benchmarks of any size. Windows that many items share (an instruction above each of
them) don't meet all these items: as long as an item's most common windows cover too little of it to count, a document
that holds the item has another of its windows too. So the others are joined first, and the common ones only between
documents and items that have met.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, cut, fresh, mix, row_key, signed, slices, table, window_hashes

_BASE = 0x94D049BB133111EB
_NUMBER, _UNIT, _NAME = (mix(np.array([k], dtype=np.uint64))[0] for k in (11, 12, 13))
#: Bits of the bitmap: 2 MB however large the benchmark is.
BITMAP_BITS = 1 << 24

#: Units of measure and money that count as one when they follow a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t lb lbs oz gram grams kilogram kilograms ton tons pound pounds ounce ounces ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros usd eur gbp percent degree degrees mph kmh kph watt watts volt volts"
).split()

_BYTES = np.arange(256)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_ALNUM = _DIGIT | _UPPER | _LOWER | (_BYTES >= 128)
_STOP = np.isin(_BYTES, [ord(c) for c in ".!?:;\n\"()"])
_JOINER = np.isin(_BYTES, [ord(c) for c in ".,"])


class Templates:
    """The template tokens of some rows: key (a hash of the token, or of its placeholder's kind), literal, first, start, end.

    first has the index of each row's first token and a closing entry; start and end are byte places in data. word_key
    and word_first are the same for the words themselves, before any becomes a placeholder.
    """

    def __init__(self, column: pa.Array):
        words = Words(column, token_bytes=_template_bytes, begins=_alone)
        data = words.data
        low = np.where(_UPPER[data], data + 32, data).astype(np.uint8)
        latin = np.append(False, data[:-1] == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        low = np.where(latin, low + 32, low).astype(np.uint8)
        raw, words.data = data, low
        key = words.hashes()
        self.word_key, self.word_first, self.word_row = key, words.first, words.row
        n = len(words)
        same = np.append(False, words.row[1:] == words.row[:-1]) if n else np.zeros(0, bool)

        def some(flags: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            total = np.append(0, np.cumsum(flags))
            return total[hi] - total[lo]

        start, end = words.start, words.end
        number = some(_DIGIT[raw] | _JOINER[raw], start, end) == end - start
        unit = np.isin(key, _unit_keys()) & np.append(False, number[:-1])[:n] & same
        before = np.append(0, end[:-1])[:n]
        inside = same & (some(_STOP[raw], before, np.maximum(start, before)) == 0)
        begins = (_UPPER[raw[start]] | (raw[start] == 0xC3)) if n else np.zeros(0, bool)
        shouted = some(_UPPER[raw], start, end) + some(latin & (raw <= 0x9E), start, end)
        changed = some(raw != low, start, end)
        name = inside & begins & (changed == 1) & (end - start > 2) & (shouted >= 1) & ~number & ~unit
        head = ~(name & np.append(False, name[:-1])[:n] & same)
        at = np.flatnonzero(head)
        key = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, key)))
        self.data, self.low = raw, low
        self.key, self.literal = key[at], ~(number | unit | name)[at]
        self.start, self.end = start[at], end[np.append(at[1:], n) - 1] if n else end
        self.row = words.row[at]
        self.first = np.searchsorted(self.row, np.arange(len(column) + 1))

    def slots(self, at: int, size: int) -> list[str]:
        """The placeholders' texts in a window, each with its place among the window's tokens."""
        return [f"{k}\x1f{self.low[self.start[k + at] : self.end[k + at]].tobytes().decode(errors='replace')}" for k in range(size) if not self.literal[k + at]]


def _template_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to a token: letters, digits, all beyond ASCII, and points and commas between digits."""
    held = _ALNUM[data]
    if len(data) > 2:
        digit = _DIGIT[data]
        held[1:-1] |= _JOINER[data[1:-1]] & digit[:-2] & digit[2:]
    return held


def _alone(data: np.ndarray) -> np.ndarray:
    """Where kana, CJK, Thai and Lao characters (of three bytes) begin and end."""
    lead = (data >= 0xE3) & (data <= 0xE9)
    lead[:-1] |= (data[:-1] == 0xE0) & (data[1:] >= 0xB8) & (data[1:] <= 0xBB)
    lead[3:] |= lead[:-3].copy()
    return lead & ((data < 0x80) | (data >= 0xC0))


_UNIT_KEYS: list[np.ndarray] = []


def _unit_keys() -> np.ndarray:
    if not _UNIT_KEYS:
        _UNIT_KEYS.append(Words(pa.array([" ".join(UNITS)])).hashes())
    return _UNIT_KEYS[0]


def _windows(id_name: str, size: int, literals: int, least: int, bitmap: bytes | None, exact: list[int]):
    """(id, at, n, size, window, slots, words) of the windows of a text column.

    Without a bitmap, of items: rows without a window of enough literals have windows of words. With a bitmap, of
    documents: only windows that it holds, those of words in the sizes of exact; those of fewer than least words only
    where they are all of the text.
    """
    bits = None if bitmap is None else np.frombuffer(bitmap, dtype=np.uint8)

    def named(names: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
        """Which windows lie in one row and may be in the benchmark."""
        good = np.arange(len(names)) + length <= np.repeat(first[1:], np.diff(first))[: len(names)]
        if bits is not None:
            slot = names % np.uint64(BITMAP_BITS)
            good = good & (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return good

    def rows(ids: np.ndarray, at: np.ndarray, row: np.ndarray, first: np.ndarray, length: int, names: np.ndarray, slots: list, words: bool) -> pa.RecordBatch:
        return pa.record_batch({
            id_name: pa.array(ids[row]), "at": pa.array((at - first[row]).astype(np.int64)), "n": pa.array(np.diff(first)[row].astype(np.int64)),
            "size": pa.array(np.full(len(at), length, dtype=np.int64)), "window": signed(names[at]), "slots": pa.array(slots, pa.list_(pa.string())),
            "words": pa.array(np.full(len(at), words)),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = _plain(batch.column("text"))
            ids = np.asarray(batch.column(id_name))
            for a, b in slices(text):
                t = Templates(text.slice(a, b - a))
                names = window_hashes(t.key, size, _BASE)
                total = np.append(0, np.cumsum(t.literal))
                at = np.flatnonzero(named(names, t.first, size) & (total[size:] - total[:-size] >= literals if len(names) else True))
                yield rows(ids[a:b], at, t.row[at], t.first, size, names, [t.slots(i, size) for i in at.tolist()], False)
                lengths = np.diff(t.word_first)
                bare = np.ones(b - a, dtype=bool)
                if bits is None:
                    bare = (lengths > 0) & (np.bincount(t.row[at], minlength=b - a) == 0)
                    exact_ = sorted(set(np.minimum(lengths[bare], size).tolist()))
                else:
                    exact_ = exact
                for length in exact_:
                    names = mix(window_hashes(t.word_key, length, _BASE) + np.uint64(length))
                    ok = named(names, t.word_first, length)
                    row = t.word_row[: len(names)]
                    if bits is None:
                        ok = ok & (bare & (np.minimum(lengths, size) == length))[row]
                    if length < least:
                        ok = ok & (lengths == length)[row]
                    at = np.flatnonzero(ok)
                    yield rows(ids[a:b], at, row[at], t.word_first, length, names, [[]] * len(at), True)

    return run


def _plain(column: pa.Array) -> pa.Array:
    """Typographic spaces and punctuation beyond ASCII become blanks."""
    return pc.replace_substring_regex(pc.fill_null(column, ""), r"[\x{2000}-\x{206F}\x{00A0}\x{00AB}\x{00BB}\x{00A1}\x{00BF}\x{3000}-\x{3003}]", " ")


def _bitmap(windows: DataFrame) -> bytes:
    """Built from distinct slot numbers, of which there are BITMAP_BITS at most."""
    slots = windows.select(F.pmod(F.col("window"), F.lit(BITMAP_BITS)).cast("int").alias("slot")).distinct().toArrow()["slot"]
    flags = np.zeros(BITMAP_BITS, dtype=bool)
    flags[np.asarray(slots)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def _late(share: float):
    """(item_id, size, at) of common windows, the most common first, that together cover too little of their item to count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item in batch.to_pylist():
                need, covered = math.ceil(item["n"] * share), set()
                for w in item["held"]:
                    more = set(range(w["at"], w["at"] + item["size"])) - covered
                    if len(covered) + len(more) < need:
                        covered |= more
                        out.append((item["item_id"], item["size"], w["at"]))
            yield pa.record_batch([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)] or [pa.array([], pa.int64())] * 3, names=["item_id", "size", "at"])

    return run


def _late_windows(items: DataFrame, share: float, common: int) -> DataFrame:
    """Those of _late(), among the windows that more than common items have. Items that share an id count as one."""
    often = items.groupBy("window").agg(F.count_distinct("item_id").alias("items")).where(F.col("items") > common)
    held = items.join(often, "window").groupBy("item_id", "size").agg(F.min("n").alias("n"), F.sort_array(F.collect_set(F.struct("items", "at")), asc=False).alias("held"))
    return held.mapInArrow(_late(share), "item_id long, size long, at long")


def _reading(windows: list[dict]) -> tuple[list[int], int]:
    """Of an alignment's windows: the places in the item of those that keep the rule, and how many slot values differ.

    A value of the item is read as most of its places read it; where no reading leads, only unchanged slots keep the rule.
    """
    slots = [[(w["item_at"] + int(x.split("\x1f", 1)[0]), *(y.split("\x1f", 1)[1] for y in (x, z))) for x, z in zip(w["item_slots"], w["slots"], strict=True)] for w in windows]
    votes: dict[str, Counter] = {}
    for _, was, now in {x for own in slots for x in own}:
        votes.setdefault(was, Counter())[now] += 1
    read = {}
    for was, own in votes.items():
        most = max(own.values())
        first = [now for now, n in own.items() if n == most]
        read[was] = first[0] if len(first) == 1 else was
    kept = sorted({w["item_at"] for w, own in zip(windows, slots, strict=True) if all(now in (was, read[was]) for _, was, now in own)})
    return kept, sum(was != now for was, own in votes.items() for now in own)


def _readings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rk, item_id, n_tokens, width, places, n_changed) of alignments; those without a window that keeps the rule go."""
    for batch in batches:
        got = [_reading(w) for w in batch.column("windows").to_pylist()]
        out = pa.record_batch({
            **{c: batch.column(c) for c in ("rk", "item_id", "n_tokens", "width")},
            "places": pa.array([kept for kept, _ in got], pa.list_(pa.int64())),
            "n_changed": pa.array([n for _, n in got], pa.int64()),
        })
        yield out.filter(pa.array([bool(kept) for kept, _ in got], pa.bool_()))


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = 6, literals: int = 3, share: float = 0.5, least: int = 3, common: int = 16) -> DataFrame:
    """(rk, doc_id, item_id, n_tokens, n_covered, n_changed) of each document and benchmark item that it holds.

    docs: doc_id, text; benchmark: item_id, text; other columns are left out. A document holds an item if windows on
    alignments, without those against the alignment's rule, cover share of the item's template tokens or more; n_changed
    is the number of slot values that differ on these alignments. Windows have size tokens, of which literals are no
    placeholders. Items without such a window are found word by word, with words for tokens; those of fewer than least
    words only in documents that have no other words. Texts without words and null or empty ones match nothing. Windows
    of more than common items are joined last, which never changes the result. Repeated rows each give their rows; rk
    is the key of a document row.
    """
    form = "long, at long, n long, size long, window long, slots array<string>, words boolean"
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL").mapInArrow(_windows("item_id", size, literals, least, None, []), f"item_id {form}")
    items = cut(items)
    bitmap = _bitmap(items)
    exact = [r["size"] for r in items.where("words").select("size").distinct().collect()]  # size of them at most
    own = docs.select("doc_id", "text").withColumn("rk", row_key()).select("rk", "text")
    found = own.mapInArrow(_windows("rk", size, literals, least, bitmap, sorted(exact)), f"rk {form}")
    found = found.select("rk", "at", "window", "slots")
    late = cut(_late_windows(items, share, common))
    there = items.join(late.withColumn("late", F.lit(True)), ["item_id", "size", "at"], "left")
    there = there.select("item_id", F.col("at").alias("item_at"), F.col("n").alias("n_tokens"), F.col("size").alias("width"), "window", F.col("slots").alias("item_slots"), F.coalesce("late", F.lit(False)).alias("late"))
    same = F.size("slots") == F.size("item_slots")
    if late.isEmpty():
        met = found.join(there, "window").where(same)
    else:
        found = cut(found)
        met = cut(found.join(there.where("NOT late"), "window").where(same))
        wanted = met.select("rk", "item_id").distinct().join(there.where("late"), "item_id")
        met = met.unionByName(found.join(wanted, ["rk", "window"]).where(same))
    window = F.struct("item_at", "item_slots", "slots")
    aligned = met.groupBy("rk", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.max("n_tokens").alias("n_tokens"), F.max("width").alias("width"), F.collect_set(window).alias("windows"))
    aligned = aligned.drop("shift").mapInArrow(_readings, "rk long, item_id long, n_tokens long, width long, places array<long>, n_changed long")
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_set("places")), lambda p: F.sequence(p, p + F.col("width") - 1)))))
    held = aligned.groupBy("rk", "item_id", "width").agg(F.max("n_tokens").alias("n_tokens"), covered.cast("long").alias("n_covered"), F.sum("n_changed").alias("n_changed"))
    held = held.where(F.col("n_covered") >= F.ceil(F.col("n_tokens") * share))
    ids = docs.select(row_key().alias("rk"), "doc_id")
    return ids.join(held, "rk").select("rk", "doc_id", "item_id", "n_tokens", "n_covered", "n_changed")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs, all columns, without the rows that hold a benchmark item."""
    key = fresh(docs, "_row_key")
    bad = find_leaks(docs, benchmark, **options).select(F.col("rk").alias(key)).distinct()
    return docs.withColumn(key, row_key()).join(bad, key, "left_anti").select(docs.columns)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("rk")
