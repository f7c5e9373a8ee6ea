import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import AWKWARD, docs, prose, words

from trackloom.llm import line_dedup, ngram_join, substring_dedup


def plain_substrings(rows, window):
    ws = [(i, words(t)) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in ws for k in range(len(w) - window + 1))
    out = []
    for i, w in ws:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def repeated_passages():
    """Passages at all offsets, periodic texts, overlaps and copies."""
    draw, shared = random.Random(5), [prose(n, 100 + n) for n in (34, 35, 36, 60, 120)]
    rows = [(i, prose(draw.randrange(0, 80), i) + " " + draw.choice(shared) + " " + prose(draw.randrange(0, 40), 50 + i)) for i in range(40)]
    rows += [(50, "ab cd " * 60), (51, "x ab cd " + "ab cd " * 30), (52, "a " * 34), (53, "b a " + "a " * 35), (54, shared[4]), (55, shared[4]), (55, shared[4])]
    return rows


@pytest.mark.parametrize("rounds", [0, 1, 3, 6, 9])
def test_substrings_equal_brute_force(spark, rounds):
    rows = repeated_passages() + list(AWKWARD.items())
    got = substring_dedup.dedup_substrings(docs(spark, rows), rounds=rounds).collect()
    assert sorted([tuple(r) for r in got], key=repr) == plain_substrings(rows, 35)


@pytest.mark.parametrize("window", [1, 2, 7])
def test_small_windows(spark, window):
    rows = repeated_passages()[:12] + [(90, None), (91, "")]
    got = substring_dedup.dedup_substrings(docs(spark, rows), window=window).collect()
    assert sorted([tuple(r) for r in got], key=repr) == plain_substrings(rows, window)


def test_symbols_recur_with_their_extent():
    draw = np.random.Generator(np.random.PCG64(3))
    core = draw.integers(0, 50, 60).astype(np.uint64)
    found = []
    for before in (0, 3, 11):
        series = np.concatenate([draw.integers(50, 99, before).astype(np.uint64), core, draw.integers(50, 99, 9).astype(np.uint64)])
        names, low, high = substring_dedup.parse(substring_dedup.mix(series), np.zeros(len(series), dtype=np.int64), 5)
        inside = (low >= before) & (high <= before + 60)
        found.append({(int(n), int(a) - before, int(b) - before) for n, a, b in zip(names[inside], low[inside], high[inside], strict=True)})
    common = found[1] & found[2]
    assert common == found[1] == found[2] and common  # whatever stands around, the same extents give the same symbols


def spelled(series, row, window, rounds):
    at = np.flatnonzero([i + window <= len(series) and row[i] == row[i + window - 1] for i in range(len(series))])
    found = list(substring_dedup.levels(substring_dedup.mix(series), row, rounds))
    return at, found, *substring_dedup.spell(iter(found), len(series), at, window)


@pytest.mark.parametrize("window, rounds", [(1, 6), (2, 3), (12, 0), (12, 4), (35, 1), (35, 6), (35, 12)])
def test_windows_are_equal_if_spelled_alike(window, rounds):
    """Names of spellings against the words themselves: few letters, runs, periods, repeats at all offsets, many rows."""
    draw = np.random.Generator(np.random.PCG64(window * 100 + rounds))
    core, parts = draw.integers(0, 30, 90), []
    for k in range(60):
        parts += [draw.integers(0, 3, k % 50), core[k % 40 :], np.repeat(draw.integers(0, 2, 9), draw.integers(1, 9, 9)), np.tile([1, 2, 3], k % 30), core]
    series = np.concatenate(parts).astype(np.uint64)
    row = np.repeat(np.arange(60), [sum(map(len, parts[5 * k : 5 * k + 5])) for k in range(60)])
    at, _, (one, two), _ = spelled(series, row, window, rounds)
    plain = [series[i : i + window].tobytes() for i in at]
    pairs = set(zip(one.tolist(), two.tolist(), plain, strict=True))
    assert len(pairs) == len(set(plain)) == len(set(one.tolist())) == len(set(two.tolist()))


def test_high_symbols_speak_for_most_words():
    """More rounds spell a window with fewer symbols, and what the high ones are named decides."""
    series, row = np.arange(3000, dtype=np.uint64), np.zeros(3000, dtype=np.int64)
    sizes = [spelled(series, row, 200, rounds)[3].mean() for rounds in (0, 2, 4, 8)]
    assert sizes[0] == 200 and sizes == sorted(sizes, reverse=True) and sizes[-1] < 70
    at, found, (one, _), _ = spelled(np.concatenate([series[:400], series[:50], 5000 + series[50:150], series[150:400]]), np.repeat([0, 1], 400), 200, 8)
    same = at[:201] == at[201:] - 400
    assert same.all() and (one[:201] == one[201:]).sum() == 51  # the windows behind the words that differ
    blind = [(names if k < 4 else np.zeros_like(names), *rest) for k, (names, *rest) in enumerate(found)]
    (less, _), _ = substring_dedup.spell(iter(blind), 800, at, 200)
    assert (less[:201] == less[201:]).sum() > 51


def test_empty_tables(spark):
    empty = docs(spark, {1: "x"}).where("false")
    assert substring_dedup.dedup_substrings(empty).count() == 0
    assert ngram_join.ngram_join(empty).count() == 0
    index = line_dedup.build_index(empty)
    assert line_dedup.drop_lines(empty, index).count() == 0


def plain_join(rows, n=5, threshold=0.8):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    near = [[j for j in range(len(rows)) if j != i and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in range(len(rows))]
    label = list(range(len(rows)))
    while True:
        new = [min([label[i], *[label[j] for j in near[i]]], key=lambda k: rows[k][0]) for i in range(len(rows))]
        if new == label:
            return sorted((rows[i][0], rows[label[i]][0], len(near[i])) for i in range(len(rows)))
        label = new


def near_copies(n_groups=6, size=9):
    draw, rows, k = random.Random(11), [], 0
    for g in range(n_groups):
        base = prose(120, 1000 + g).split()
        for _ in range(size):
            own = list(base)
            for _ in range(draw.randrange(0, 6)):
                own[draw.randrange(len(own))] = f"z{draw.randrange(10**6)}"
            rows.append((k, " ".join(own)))
            k += 1
    return rows


@pytest.mark.parametrize("block, grams", [(512, 1 << 22), (4, 1 << 22), (512, 300), (24, 40)])
def test_join_equals_brute_force(spark, block, grams):
    rows = near_copies() + [(200 + i, t) for i, t in AWKWARD.items()] + [(300, "a b c d"), (301, "a b c d"), (302, "a b c")]
    got = ngram_join.ngram_join(docs(spark, rows), block=block, block_grams=grams).collect()
    assert sorted(map(tuple, got)) == plain_join(rows)


def test_repeated_and_unnamed_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "q r s t u v")]
    got = Counter(map(tuple, ngram_join.ngram_join(docs(spark, rows)).collect()))
    assert got == Counter({(1, 1, 2): 2, (2, 1, 2): 1, (None, None, 0): 1})


def test_band_plan():
    bands, rows = ngram_join.plan_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 160


def test_shared_counts_in_chunks():
    draw = np.random.Generator(np.random.PCG64(1))
    sets = [np.unique(draw.integers(0, 300, 90).astype(np.uint64)) for _ in range(20)]
    got = ngram_join.shared(sets, sets[:9], width=16)
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[:9]] for a in sets]).all()


def plain_lines(rows, least):
    def key(line):
        return line.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})

    n = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or n[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


LINES = [(i, f"Header A\n unique {i}\n\theader a \nfooter {i % 3}\n\n") for i in range(12)] + [(20, None), (21, ""), (22, "HEADER a"), (22, "HEADER a"), (23, "ÄB\näb"), (24, "x\r\nx \nfooter 0")]


def test_lines_equal_brute_force(spark):
    table = docs(spark, LINES)
    got = line_dedup.drop_lines(table, line_dedup.build_index(table, min_docs=4)).select("doc_id", "n_lines", "n_dropped", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == plain_lines(LINES, 4)


def test_index_is_reversible(spark):
    first, more = docs(spark, LINES[:9]), docs(spark, LINES[9:])

    def state(index):
        return sorted(map(tuple, index.counts.select("key", "n_docs").collect()), key=repr)

    def hot(index):
        keys = index.counts.select("key").distinct()
        return {bytes(r[0]) for r in line_dedup.frequent_keys(keys, index).collect()}

    index = line_dedup.build_index(first, min_docs=4, keys_per_shard=5)
    grown = line_dedup.add_documents(index, more)
    whole = line_dedup.build_index(docs(spark, LINES), min_docs=4, keys_per_shard=5)
    assert state(grown) == state(whole) and hot(grown) == hot(whole)
    back = line_dedup.remove_documents(grown, more)
    assert state(back) == state(index) and hot(back) == hot(index) != hot(grown)


def test_batches_touch_their_own_shards(spark, monkeypatch):
    """Counts are put beside the ones before; only filters of shards with a crossing key change; many parts become one."""
    monkeypatch.setattr(line_dedup, "MOST_PARTS", 3)
    index = line_dedup.build_index(docs(spark, LINES), min_docs=4, keys_per_shard=2)
    filters = {r["shard"]: r["filter"] for r in index.filters.collect()}
    once = line_dedup.add_documents(index, docs(spark, [(90, "a new line"), (91, "footer 1")]))
    crossed = line_dedup.add_documents(once, docs(spark, [(92, "a new line"), (93, "a new line"), (94, "A New Line ")]))
    assert once.parts[0] is index.parts[0] and len(crossed.parts) == 3 and crossed.parts[1] is once.parts[1]
    assert {r["shard"]: r["filter"] for r in once.filters.collect()} == filters
    changed = {r["shard"]: r["filter"] for r in crossed.filters.collect()}
    assert sum(changed[s] != f for s, f in filters.items()) + len(set(changed) - set(filters)) == 1
    many = docs(spark, [(i, "\n".join(f"line {i} {k}" for k in range(40))) for i in range(4)])
    grown = line_dedup.add_documents(crossed, many)
    assert len(grown.parts) == 1 and grown.shards > index.shards and grown.counts.count() == crossed.counts.count() + 160
    back = line_dedup.remove_documents(grown, many)
    assert sorted(map(tuple, back.counts.select("key", "n_docs").collect())) == sorted(map(tuple, crossed.counts.select("key", "n_docs").collect()))


def test_cuckoo_filter():
    keys = np.random.Generator(np.random.PCG64(2)).integers(1, 2**64, 3000, dtype=np.uint64)
    made = line_dedup.CuckooFilter.of(keys[:2000])
    assert made.contains(keys[:2000]).all() and made.contains(keys[2000:]).mean() < 0.01
    for k in keys[:1000]:
        assert made.delete(k)
    assert made.contains(keys[1000:2000]).all() and made.contains(keys[:1000]).mean() < 0.05


def test_kept_text_hash(spark, data):
    got = substring_dedup.op1_substring_dedup(spark, data).where("n_removed = 0").limit(1).collect()[0]
    text = spark.read.parquet(f"{data}/documents.parquet").where(f"doc_id = {got['doc_id']}").collect()[0]["text"]
    assert got["kept_sha256"] == hashlib.sha256(" ".join(words(text)).encode()).hexdigest()


def test_join_of_rows_without_own_ids(spark):
    """Rows that repeat, share an id or have none, against brute force by row."""
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "x y z"), (3, "p q r s t u"), (4, "x y z"), (5, "p q r s t u"), (None, "g h i j k"), (6, "g h i j k"), (7, None), (None, None), (8, "lone words here")]
    rows += [(None if i % 3 == 0 else i // 2, t) for i, t in near_copies(3, 8)]
    ids = [(i is None, i, t or "") for i, t in rows]
    near = plain_join([(k, t) for k, (_, t) in enumerate(rows)])
    group = {}
    for k, c, _ in near:
        group.setdefault(c, []).append(k)
    low = {k: min(ids[j] for j in own)[1] for own in group.values() for k in own}
    got = Counter(map(tuple, ngram_join.ngram_join(docs(spark, rows)).collect()))
    assert got == Counter((rows[k][0], low[k], n) for k, _, n in near)
    kept = ngram_join.without_near_duplicates(docs(spark, rows).withColumnRenamed("n", "_rk"))
    want = Counter(min(((ids[j][0], ids[j][1] or 0), rows[j]) for j in own)[1][0] for own in group.values())
    assert Counter(r["doc_id"] for r in kept.collect()) == want and kept.columns[-2] == "_rk"


def test_long_chains_are_verified_by_bucket(spark):
    """Neighbours share candidates with neighbours: a component far larger than its buckets."""
    series = prose(10 * 100 + 120, 77, 10**6).split()
    rows = [(i, " ".join(series[10 * i : 10 * i + 120])) for i in range(100)]
    assert sorted(map(tuple, ngram_join.ngram_join(docs(spark, rows), block=24).collect())) == plain_join(rows)


def test_copies_are_spread(spark):
    """A text in most rows: no partition gets all of them, and what they hold is found."""
    rows = [(i, prose(60, 4)) for i in range(900)] + [(1000 + i, prose(60, 100 + i)) for i in range(300)] + [(2000, prose(20, 3) + " " + prose(60, 4) + " tail")]
    rows += [(None, prose(60, 4)), (None, "short text"), (None, "short text")]
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        out = substring_dedup.dedup_substrings(docs(spark, rows))
        sizes = [r[0] for r in out.selectExpr("spark_partition_id() AS p").groupBy("p").count().select("count").collect()]
        got = sorted([tuple(r) for r in out.collect()], key=repr)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == plain_substrings(rows, 35) and max(sizes) < 250
