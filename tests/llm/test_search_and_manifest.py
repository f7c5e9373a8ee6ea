import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import AWKWARD, docs, prose
from pyspark.sql import functions as F

from trackloom.llm import fill_in_middle, manifest, permutation_index


def plain_neighbours(rows, k=20):
    """{query: ids} by brute force; rows: pairs of id and vector."""
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], dtype=float)
    out = {}
    for at in np.flatnonzero(ids % 20 == 0):
        score = (v * v[at]).sum(axis=1)
        best = np.lexsort((ids, -score))
        out[int(ids[at])] = [(int(ids[j]), float(score[j])) for j in best[ids[best] != ids[at]][:k]]
    return out


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()])


def test_neighbours_of_the_table(spark, data):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    got, want = found(permutation_index.op11_nearest_neighbours(spark, data)), plain_neighbours(rows)
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values()) and recall(got, want) >= 0.9
    v = {i: np.array(x, dtype=float) for i, x in rows}
    assert all(abs(s - float(v[q] @ v[i])) < 1e-12 for q, x in got.items() for i, s in x)
    assert all(x == sorted(x, key=lambda y: (-y[1], y[0])) for x in got.values())


@pytest.mark.parametrize("lengths", ["even", "spread", "one giant"])
def test_neighbours_over_shards_and_lengths(spark, lengths):
    draw = np.random.default_rng(3)
    v = draw.normal(size=(3_000, 24)) * {"even": 1.0, "spread": draw.lognormal(0, 0.6, (3_000, 1)), "one giant": np.where(np.arange(3_000) == 7, 1e3, 1.0)[:, None]}[lengths]
    v[100:400] = v[100]  # a group of copies: ties go to the smaller id
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    held = permutation_index.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got, want = found(permutation_index.search(held, held.where("vec_id % 20 = 0"), shard_rows=700, block_rows=40)), plain_neighbours(rows)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    assert [i for i, _ in got[120]] == [i for i, _ in want[120]]


def test_neighbours_of_awkward_rows(spark):
    bad = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0, 3.0]]
    rows = [(20 * i, x, "v", 1) for i, x in enumerate(bad, 1)] + [(0, [1.0, 0.5], "v", 1), (0, [1.0, 0.5], "v", 1), (3, [1.0, 1.0], "v", 1), (5, [1.0, 1.0], "v", 2), (None, [1.0, 1.0], "v", 2), (9, [-1.0, 2.0], "v", 2)]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string, key int").repartition(3)
    held = permutation_index.usable(made)
    got = permutation_index.search(held, held.where("vec_id % 20 = 0"))
    assert [tuple(r) for r in got.orderBy("query_id", "rank").collect()] == [(0, 1, 3, 1.5), (0, 2, 5, 1.5), (0, 3, None, 1.5), (0, 4, 9, 0.0)]
    none = permutation_index.usable(made.where("vec_id < 0"))
    assert permutation_index.search(none, none).collect() == []


def test_footrule_distance():
    draw = np.random.default_rng(5)
    order = np.array([draw.permutation(30)[:8] for _ in range(50)], dtype=np.int16)
    files = permutation_index.InvertedFiles(order, 30)

    def far(a, b):
        place = lambda x, p: list(x).index(p) if p in x else 8
        return sum(abs(place(a, p) - place(b, p)) for p in {*a.tolist(), *b.tolist()})

    assert files.footrule(order[4]).tolist() == [far(order[4], x) for x in order]


def plain_middle(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    low, high = sorted((a % (len(text) + 1), b % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return doc_id, len(text), "plain", None, None, text
    p, m, s = text[:low], text[low:high], text[high:]
    form = "spm" if d % 100 < 20 else "psm"
    return doc_id, len(text), form, low, high - low, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_of_awkward_texts(spark):
    near = {200 + i: "x" * i + m + "tail" for i, m in enumerate(("<P>", "<S>", "<M>", "<P", "S>", "<", "M><", "<Q>"))}
    long = prose(60_000, 9)
    rows = [*AWKWARD.items(), *near.items(), *((300 + i, "日本語テキスト ünï " * i) for i in range(0, 900, 37)), (400, long), (401, long[:100_000] + "<M>" + long[100_000:]), (402, "é" * 200_000), (None, "no id"), (5, AWKWARD[5])]
    got = fill_in_middle.fill_in_middle(docs(spark, rows)).withColumn("again", fill_in_middle.restored())
    have = got.collect()
    assert sorted(map(str, (tuple(r)[:6] for r in have))) == sorted(map(str, (plain_middle(*r) for r in rows)))
    text = {plain_middle(*r): r[1] or "" for r in rows}
    assert all(r["again"] == text[tuple(r)[:6]] for r in have)
    assert fill_in_middle.fill_in_middle(docs(spark, rows).where("doc_id < 0")).collect() == []


def test_markers_across_chunks_and_full_caches():
    body = prose(40_000, 4).encode()
    ends = fill_in_middle.chunk_ends(np.frombuffer(body, np.uint8))
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(body) and len(ends) > 100 and sizes.max() <= fill_in_middle.LONGEST and sizes[:-1].min() >= fill_in_middle.SHORTEST
    known = fill_in_middle.Summaries(limit=20_000)
    for end in ends[:40]:
        for back in (1, 2):
            marked = body[: end - back] + b"<S>" + body[end - back :]
            assert fill_in_middle.Pieces(marked, known).marked
    assert not fill_in_middle.Pieces(body, known).marked and len(known.new) + len(known.old) < 200
    moved = {body[a:b] for a, b in zip([0, *ends], ends, strict=False)}
    shifted = b"other words first " + body
    again = fill_in_middle.chunk_ends(np.frombuffer(shifted, np.uint8))
    assert sum(shifted[a:b] in moved for a, b in zip([0, *again], again, strict=False)) > 0.9 * len(ends)
    mixed = ("aé日" * 30_000).encode()
    whole = fill_in_middle.Pieces(mixed, known)
    assert whole.n == 90_000 and all(whole.place(p) == len(("aé日" * 30_000)[:p].encode()) for p in (0, 1, 2, 3, 44_444, 89_999, 90_000))


def plain_manifest(rows):
    """All columns of the manifest by brute force; rows: dicts."""

    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(r):
        return h(*("-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in manifest.FIELDS))

    def tree(level):
        out = [level]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][k : k + 8]) for k in range(0, len(out[-1]), 8)])
        return out

    def siblings(levels, i):
        out = []
        for level in levels[:-1]:
            out.append((level[i - i % 8 : i], level[i + 1 : i - i % 8 + 8]))
            i //= 8
        return out

    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    held = {k: sorted(by[k], key=lambda x: x[:3]) for k in langs}
    trees = {k: tree([x[2] for x in held[k]]) for k in langs}
    top = tree([trees[k][-1][0] for k in langs])
    out = []
    for j, lang in enumerate(langs):
        for i, (_, _, own, r) in enumerate(held[lang]):
            way = siblings(trees[lang], i) + siblings(top, j)
            folded = own
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"]:
                folded = leaf({**r, "text": "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])})
            for a, b in way:
                folded = h(*a, folded, *b)
            out.append((r["doc_id"], own, trees[lang][-1][0], top[-1][0], h(*(x for a, b in way for x in a + b)), folded, folded == top[-1][0]))
    return out


def forged():
    return F.when(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0, manifest.leaf({"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}))


@pytest.mark.parametrize(("levels", "shared"), [(4, 2_048), (1, 1), (1, 3), (2, 2)])
def test_manifest_however_it_is_divided(spark, levels, shared):
    """A hot language, a lone leaf, sizes around powers of 8, many languages, nulls, repeats and a lone last node."""
    form = "doc_id long, source string, lang string, n_chars long, text string, tree long, pos string"
    sizes = {"hot": 586, None: 9, "Zz": 8, "one": 1, "é": 65, "": 64, **{f"l{k}": 2 for k in range(70)}}
    rows = [(7 * k % 601 if lang == "hot" else k, None if k % 5 == 0 else "s", lang, None if k % 7 == 0 else k, [f"Text {k} Ünï", None, "", "low"][k % 4], 1, "p") for lang, n in sizes.items() for k in range(n)]
    rows += [rows[0], rows[0], (None, None, None, None, None, 1, "p"), (None, "s", "hot", 1, "A" * 300_000, 1, "p"), (9, "same id", "hot", 2, "B", 1, "p")]
    table = spark.createDataFrame(rows, form).repartition(5)
    got = manifest.prove(table, forged(), levels=levels, shared=shared)
    want = plain_manifest([r.asDict() for r in table.collect()])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert 0 < sum(not x[-1] for x in want) < len(want)


def test_manifest_of_few_rows(spark):
    table = docs(spark, {3: "only One"})
    got = manifest.prove(table).collect()
    assert len(got) == 1 and got[0]["leaf"] == got[0]["root"] == got[0]["subroot"] and got[0]["verified"] and got[0]["proof_sha256"] == hashlib.sha256(b"").hexdigest()
    assert manifest.prove(table.where("doc_id < 0")).collect() == []


def test_missing_nodes_are_few_and_named_once():
    for tile in range(74):
        got = manifest.missing(tile, 586, levels=1)
        assert len(got) == len(set(got)) and all(len([x for x in got if x[0] == k]) <= 7 for k in range(1, 4)) and (1, tile) not in got
    assert manifest.missing(0, 4_096) == [] and manifest.missing(1, 4_097) == [(4, 0)]
