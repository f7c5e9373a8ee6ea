"""Substring dedup by recompression: long word sequences that occur more than once are taken out.

Each text is parsed bottom-up. Round 0 names maximal runs of one word, and every later round joins neighbouring symbols
x y into a new one where x falls into the left and y into the right class of the round. A name is a hash of the named
content and the class a hash of the name, so names agree over all documents without a dictionary, and equal substrings
get the same interior symbols wherever they stand. What a symbol's making depended on (its extent: the words that
fix it and the refusals of its neighbours) is carried along. Then Spark decides in two counting rounds:

1. Symbols by name, over the corpus. A name that occurs once proves that no window around its extent is repeated.
2. Windows without such a proof are verified by the symbols that spell them: those of the highest level in the middle,
   and what each lower level adds at both ends, down to words. As all of them have their extents inside the window,
   equal windows are spelled alike wherever they stand, and one 128-bit name of the spelling stands for all its words.
   Windows whose name occurs once are single, the rest are repeats.

Both rounds count with map-side combining, so a passage in a third of all documents is no hot key, and neither sends
back more than the names that occur once. Texts meet what was found about them by a key of the row, not of the text, so
copies of one text are spread; one of them speaks for all in the counts, twice. Nothing is capped, and no text is
compared with another one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, cut, mix, powers, row_keys, signed, slices, table

_FAR = np.int64(1) << 40
#: Bits of what a row is sent: a word's place, a size, and above them a check of the row's second key.
_SIZE_BITS, _PLACE_BITS, _CHECK_BITS = 12, 30, 21
_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)


def levels(names: np.ndarray, row: np.ndarray, rounds: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(name, low, high, begin) of the words, of the symbols of round 0, and of those after each further round.

    [low, high) is a symbol's extent in words, begin the first word that it stands for. Wherever the words of an extent
    occur again, the symbol does too. A document's edge has no extent: what hangs on it reaches beyond every window.
    """
    begin = np.arange(len(names), dtype=np.int64)
    low, high = begin, begin + 1
    yield names, low, high, begin

    def neighbours(low, high, row):
        """The extents of what stands before and behind each symbol; endless at a document's edge."""
        edge = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, dtype=bool)
        low_b, high_b = np.roll(low, 1), np.roll(high, 1)
        low_a, high_a = np.roll(low, -1), np.roll(high, -1)
        opening = np.roll(edge, 1)
        low_b[opening], high_b[opening] = -_FAR, _FAR
        low_a[edge], high_a[edge] = -_FAR, _FAR
        return low_b, high_b, low_a, high_a, edge

    if not len(names):
        return
    low_b, _, _, high_a, edge = neighbours(low, high, row)
    heads = np.append(True, (names[1:] != names[:-1]) | edge[:-1])
    at = np.flatnonzero(heads)
    length = np.diff(np.append(at, len(names)))
    ends = at + length - 1
    names = np.where(length > 1, mix(names[at] + mix(length.astype(np.uint64))), names[at])
    low, high, row, begin = low_b[at], high_a[ends], row[at], begin[at]
    yield names, low, high, begin

    for r in range(rounds):
        left = (mix(names ^ np.uint64(0xA0761D6478BD642F * (r + 1) & (2**64 - 1))) >> np.uint64(63)).astype(bool)
        low_b, high_b, low_a, high_a, edge = neighbours(low, high, row)
        pair = np.append(left[:-1] & ~left[1:] & ~edge[:-1], False)
        second = np.append(False, pair[:-1])
        lone_right, lone_left = ~left & ~second, left & ~pair
        low = np.where(lone_right, np.minimum(low, low_b), np.where(left, np.minimum(low, low_a), low))
        high = np.where(lone_right, np.maximum(high, high_b), np.where(left, np.maximum(high, high_a), high))
        joined = mix(names + np.uint64(0xE7037ED1A0B428DB) * mix(np.roll(names, -1) + np.uint64(r)))
        names = np.where(pair, joined, names)
        keep = ~second
        names, low, high, row, begin = names[keep], low[keep], high[keep], row[keep], begin[keep]
        yield names, low, high, begin


def parse(names: np.ndarray, row: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, low, high) of the symbols of the last level."""
    for symbols, low, high, _ in levels(names, row, rounds):
        pass
    return symbols, low, high


def _below(values: np.ndarray, n: int) -> np.ndarray:
    """How many of the values, each 0 to n, are below 0, 1, ..., n + 1."""
    return np.append(0, np.cumsum(np.bincount(values, minlength=n + 1)))


def spell(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], n: int, at: np.ndarray, window: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Two names of each window that starts at one of the places at, by the symbols that spell it, and their number.

    found: the levels() of n words. Symbols whose extent is inside a window follow each other, and those of a level
    stand for a stretch of those beneath, as extents only grow. So a level adds the symbols before and behind the stretch
    that the next one stands for, the last level that has any inside the window adds all of them.
    """
    names, size = [np.zeros(len(at), dtype=np.uint64) for _ in _BASES], np.zeros(len(at), dtype=np.int64)
    live, first, last = np.arange(len(at)), at, at
    sums, places = [], None

    def add(upto: np.ndarray, since: np.ndarray) -> None:
        """The symbols from first to upto, and from since to last, of the level whose sums are at hand."""
        size[live] += upto - first + last - since
        for k, base in enumerate(_BASES):
            back = powers(pow(base, -1, 2**64), len(sums[k]))
            ends = [mix((sums[k][b] - sums[k][a]) * back[a] + (b - a).astype(np.uint64)) for a, b in ((first, upto), (since, last))]
            names[k][live] = mix(mix(names[k][live] + ends[0]) + ends[1])

    for name, low, high, begin in found:
        end = np.append(begin[1:], n)
        held = (low >= 0) & (high <= n) & (high - low <= window)
        name, low, high, begin, end = (x[held] for x in (name, low, high, begin, end))
        from_, to = _below(low, n)[at[live]], _below(high, n)[at[live] + window + 1]
        some = from_ < to
        if places is not None:
            upto, since = last.copy(), last.copy()  # all of this level, where the next has none
            upto[some], since[some] = places[begin[from_[some]]], places[end[to[some] - 1]]
            add(upto, since)
        live, first, last, places = live[some], from_[some], to[some], _below(begin, n)
        sums = [np.append(np.uint64(0), np.cumsum(mix(name + np.uint64(k)) * powers(base, len(name)), dtype=np.uint64)) for k, base in enumerate(_BASES, 1)]
    add(last, last)
    return names, size


def _once(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct name first stands, and how often it does."""
    _, at, n = np.unique(names, return_index=True, return_counts=True)
    return at, n


def _checks(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("rk2")) & ((1 << _CHECK_BITS) - 1)


def _symbols(window: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, key, check, times = batch.column("text"), np.asarray(batch.column("rk")), _checks(batch), np.asarray(batch.column("times"))
            for a, b in slices(text):
                words = Words(text.slice(a, b - a))
                names, low, high = parse(words.hashes(), words.row, rounds)
                held = (low >= 0) & (high - low <= window) & (high <= len(words))
                held[held] = times[a:b][words.row[low[held]]] > 0
                names, low, high = names[held], low[held], high[held]
                at, n = _once(names)
                row = words.row[low[at]]
                begin = low[at] - words.first[row]
                span = (check[a:b][row] << _PLACE_BITS | begin) << _SIZE_BITS | (high - low)[at]
                yield pa.record_batch({"name": signed(names[at]), "rk": pa.array(key[a:b][row]), "span": pa.array(span), "n": pa.array(n * times[a:b][row])})

    return run


def _open(words: Words, spans: list, window: int, check: np.ndarray) -> np.ndarray:
    """Start words (in the slice) of the windows that no symbol proves single."""
    count = np.diff(words.first)
    starts = np.arange(len(words))
    valid = starts + window <= np.repeat(words.first[1:], count)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for i, own in enumerate(spans):
        if own is not None and len(own):
            own = own[own >> (_SIZE_BITS + _PLACE_BITS) == check[i]]
            begin, size = own >> _SIZE_BITS & ((1 << _PLACE_BITS) - 1), own & ((1 << _SIZE_BITS) - 1)
            lo = np.maximum(begin + size - window, 0) + words.first[i]
            np.add.at(change, lo, 1)
            np.add.at(change, np.minimum(begin + words.first[i] + 1, len(words)), -1)
    return np.flatnonzero(valid & (np.cumsum(change[:-1]) == 0))


def _lists(column: pa.Array) -> list:
    return [None if x is None else np.asarray(x, dtype=np.int64) for x in (column[i].values for i in range(len(column)))]


def _windows(window: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.greater(batch.column("times"), 0))
            text, key, spans = batch.column("text"), np.asarray(batch.column("rk")), batch.column("spans")
            check, times = _checks(batch), np.asarray(batch.column("times"))
            for a, b in slices(text):
                words = Words(text.slice(a, b - a))
                at = _open(words, _lists(spans.slice(a, b - a)), window, check[a:b])
                one, two = spell(levels(words.hashes(), words.row, rounds), len(words), at, window)[0]
                first, n = _once(one)
                at, one, two = at[first], one[first], two[first]
                row = words.row[at]
                place = check[a:b][row] << _PLACE_BITS | (at - words.first[row]).astype(np.int64)
                yield pa.record_batch({"one": signed(one), "two": signed(two), "rk": pa.array(key[a:b][row]), "place": pa.array(place), "n": pa.array(n * times[a:b][row])})

    return run


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, spans, single, check = batch.column("text"), batch.column("spans"), batch.column("single"), _checks(batch)
            for a, b in slices(text):
                words = Words(text.slice(a, b - a))
                again = np.zeros(len(words) + 1, dtype=bool)
                again[_open(words, _lists(spans.slice(a, b - a)), window, check[a:b])] = True
                for i, own in enumerate(_lists(single.slice(a, b - a))):
                    if own is not None and len(own):
                        own = own[own >> _PLACE_BITS == check[a + i]]
                        again[(own & ((1 << _PLACE_BITS) - 1)) + words.first[i]] = False
                change = np.zeros(len(words) + window + 1, dtype=np.int64)
                at = np.flatnonzero(again)
                change[at] += 1
                change[at + window] -= 1
                gone = np.cumsum(change)[: len(words)] > 0
                kept = []
                data = words.data.tobytes()
                for i in range(b - a):
                    lo, hi = words.first[i], words.first[i + 1]
                    own = lo + np.flatnonzero(~gone[lo:hi])
                    kept.append(b" ".join([data[s:e] for s, e in zip(words.start[own].tolist(), words.end[own].tolist(), strict=True)]).decode())
                removed = np.add.reduceat(np.append(gone, False), words.first[:-1]) * (np.diff(words.first) > 0)
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(a, b - a), "n_words": pa.array(np.diff(words.first).astype(np.int64)), "n_removed": pa.array(removed.astype(np.int64)), "kept": pa.array(kept, pa.string())})

    return run


def dedup_substrings(docs: DataFrame, window: int = 35, rounds: int = 6) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): texts without the words of any repeated window of so many words.

    docs: doc_id, text and any other columns (left out). A null or empty text has no words and keeps ''. Repeated rows
    are documents of their own, so their windows are repeats of each other. Windows are judged on the input. Words are
    cut at ASCII white space alone. With more rounds, longer symbols speak for more words in both counting rounds; the
    result is the same. window is at most 4,000.
    """
    if not 1 <= window <= 4000:
        raise ValueError("window must be 1 to 4000 words")
    rows = docs.select("doc_id", "text").withColumns(row_keys())
    form = ["doc_id", "text", "rk", "rk2", "times"]  # read with the same columns throughout, so that the texts' shuffle is written once
    marked = rows.join(_copies(rows), "rk", "left")
    marked = marked.select(*form[:-1], F.when(F.col("copy.rk2") == F.col("rk2"), F.col("copy.times")).otherwise(1).cast("long").alias("times"))
    symbols = marked.select(form).mapInArrow(_symbols(window, rounds), "name long, rk long, span long, n long")
    proofs = _singles(symbols, ["name"], "span").select("rk", F.col("span").alias("v")).groupBy("rk").agg(F.collect_list("v").alias("spans"))
    marked = marked.join(proofs, "rk", "left")
    windows = marked.select(*form, "spans").mapInArrow(_windows(window, rounds), "one long, two long, rk long, place long, n long")
    single = _singles(windows, ["one", "two"], "place").groupBy("rk").agg(F.collect_list("place").alias("single"))
    return marked.join(single, "rk", "left").select(*form, "spans", "single").mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, kept string")


def _copies(rows: DataFrame) -> DataFrame:
    """(rk, copy (times, rk2)) of the rows whose text others have too: times is 2 for one of them, 0 for the others.

    Only hashes are shuffled. Of rows whose rk collide one is left out, which then counts for itself.
    """
    narrow = rows.select("rk", "rk2", *[F.xxhash64(F.lit(t), "text").alias(t) for t in ("t1", "t2")])
    several = cut(narrow.groupBy("t1", "t2").agg(F.count("*").alias("n"), F.min("rk").alias("lead")).where("n > 1"))
    found = narrow.join(several, ["t1", "t2"]).select("rk", "rk2", F.when(F.col("rk") == F.col("lead"), 2).otherwise(0).alias("times"))
    return found.groupBy("rk").agg(F.max(F.struct("times", "rk2")).alias("copy"))


def _singles(df: DataFrame, key: list[str], what: str) -> DataFrame:
    counted = df.groupBy(*key).agg(F.sum("n").alias("n"), F.min("rk").alias("rk"), F.min(what).alias(what))
    return counted.where("n = 1").select("rk", what)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i+34], ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) t(i)),
r AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
s AS (SELECT DISTINCT doc_id, i FROM g SEMI JOIN r USING (h)),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM s, unnest(range(0, 35)) t(k)),
lost AS (SELECT doc_id, list(i) AS l, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN l IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(l, j)), lambda j: w[j]) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id)
"""
