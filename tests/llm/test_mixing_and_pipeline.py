from collections import Counter, defaultdict
from math import comb

import pytest
from helpers import AWKWARD, docs, prose, words
from pyspark.sql import functions as F

import corpus_pipeline
from trackloom.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    total, target, shut = share * sum(sizes.values()), {}, set()
    while True:
        left = total - sum(most * sizes[n] for n in shut)
        free = sum(w[n] for n in names if n not in shut)
        target = {n: most * sizes[n] if n in shut else left * w[n] / free for n in names}
        over = {n for n in names if n not in shut and target[n] > most * sizes[n]}
        if not over:
            return target
        shut |= over


def test_mix_meets_targets(spark):
    parts = [docs(spark, {1000 * k + i: prose(20 + i % 7, 1000 * k + i) for i in range(n)}, source=s) for k, (s, n) in enumerate([("a", 60), ("b", 300), ("Z", 40), (None, 90), ("é", 20)])]
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p)
    table = table.unionByName(docs(spark, AWKWARD, source="words")).unionByName(docs(spark, {1: None}, source="nothing"))
    got = mixing.mix(table, block_docs=16, levels=3).collect()
    size = defaultdict(int)
    for r in table.collect():
        size[r["source"]] += len(words(r["text"]))
    want, taken = plain_targets(size), defaultdict(int)
    for r in got:
        assert r["size"] * r["rows"] >= 0 and r["passes"] in (0, 1, 2) and len(r["shards"]) == r["passes"] and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["size"] * r["rows"] * r["passes"]
    for s, t in want.items():
        if s != "words":  # its longest document is most of it
            assert abs(taken[s] - t) <= 16
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(table.repartition(7), block_docs=16, levels=3).collect()))


def test_tree_splits_exactly(spark):
    quotas = spark.createDataFrame([(1, 1000), (2, 37), (3, 0), (4, 5)], "sid long, blocks long")
    ends = {r["sid"]: r["ends"] for r in mixing.splitting_tree(quotas, 4).collect()}
    shards = [sum(e[k] - (e[k - 1] if k else 0) for e in ends.values()) for k in range(16)]
    assert {s: e[-1] for s, e in ends.items()} == {1: 1000, 2: 37, 3: 0, 4: 5} and max(shards) - min(shards) <= 1
    assert all(a <= b for e in ends.values() for a, b in zip(e, e[1:], strict=False))


@pytest.mark.parametrize("together", [1, 3, 7])
def test_tree_over_ranges_of_sources(spark, together):
    """More sources than one row of the tree holds: every draw is dealt once, and shards are even in all."""
    blocks = {k + 1: 3 + k * k % 11 for k in range(20)}
    quotas = spark.createDataFrame(list(blocks.items()), "sid long, blocks long")
    ends = {r["sid"]: r["ends"] for r in mixing.splitting_tree(quotas, 3, together=together).collect()}
    own = {s: [b - a for a, b in zip([0, *e], e, strict=False)] for s, e in ends.items()}
    assert {s: sum(x) for s, x in own.items()} == blocks and all(min(x) >= 0 for x in own.values())
    shards = [sum(x[k] for x in own.values()) for k in range(8)]
    assert max(shards) - min(shards) <= 1


def test_more_sources_than_a_row_holds_and_rows_without_ids(spark):
    rows = [(None, f"text {i} " + "w " * (i % 5), f"s{i % 40:02}") for i in range(2_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mix(table, block_docs=4, levels=2, together=6).collect()
    taken = defaultdict(int)
    for r in got:
        taken[r["source"], r["target"]] += r["size"] * r["passes"]
        assert len(r["shards"]) == r["passes"]
    assert len(got) == 2_000 and len(taken) == 40 and all(abs(n - t) <= 4 for (_, t), n in taken.items())
    assert table.select(F.md5(mixing.name_of())).distinct().count() == 2_000


def test_documents_are_taken_where_a_leaf_of_the_tree_holds_them(spark, monkeypatch):
    rows = [(i, prose(10 + i % 5, i), f"s{i % 3}") for i in range(600)] + [(900 + i, [None, "", " "][i % 3], "nothing") for i in range(9)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["passes"], r["shards"]) for r in mixing.mix(table, block_docs=4, levels=3).collect()}
    assert all(0 <= s < 8 for _, own in got.values() for s in own) and all(got[900 + i] == (0, []) for i in range(9))
    tree = mixing.splitting_tree

    def half(*options):
        """The first four shards' leaves hold nothing."""
        return tree(*options).withColumn("ends", F.transform("ends", lambda e, k: F.when(k < 4, F.element_at("ends", -1) * 0).otherwise(e - F.get("ends", F.lit(3)))))

    monkeypatch.setattr(mixing, "splitting_tree", half)
    less = {r["doc_id"]: r["passes"] for r in mixing.mix(table, block_docs=4, levels=3).collect()}
    one, two = sum(p for p, _ in got.values()), sum(less.values())
    assert 0.4 * one < two < 0.6 * one
    monkeypatch.setattr(mixing, "splitting_tree", lambda *options: tree(*options).withColumn("ends", F.transform("ends", lambda e: e * 0)))
    assert {r["passes"] for r in mixing.mix(table, block_docs=4, levels=3).collect()} == {0}


def test_hypergeometric_law(spark):
    n, (g, b, d) = 6000, (7, 9, 6)
    draws = spark.range(n).select(mixing.hypergeometric(F.lit(g).cast("long"), F.lit(b).cast("long"), F.lit(d).cast("long"), mixing._chance(F.lit("t"), "id")).alias("k"))
    seen = Counter(r["k"] for r in draws.collect())
    for k in range(d + 1):
        p = comb(g, k) * comb(b, d - k) / comb(g + b, d)
        assert abs(seen[k] / n - p) < 4 * (p * (1 - p) / n) ** 0.5 + 1e-9


def test_mixed_rows(spark):
    table = docs(spark, {i: prose(30, i) for i in range(40)}).unionByName(docs(spark, {100 + i: prose(30, 500 + i) for i in range(40)}, source="t"))
    table = table.withColumnRenamed("n", "_shard")
    rows = mixing.mixed_rows(table, levels=2)
    assert rows.columns == table.columns
    took = {r["doc_id"]: r["passes"] for r in mixing.mix(table, levels=2).collect()}
    assert Counter(r["doc_id"] for r in rows.collect()) == Counter({k: v for k, v in took.items() if v})
    twice = docs(spark, [(1, "a b c"), (1, "a b c"), (2, "d e")])
    assert {r["rows"] for r in mixing.mix(twice).where("doc_id = 1").collect()} == {2}
    assert mixing.mix(table.where("false")).count() == 0 and mixing.mixed_rows(table.where("false")).count() == 0


def test_pipeline_stages(spark, data):
    """Each stage keeps the columns, drops what it should and leaves other documents alone."""
    base = spark.read.parquet(f"{data}/documents.parquet")
    leak = spark.read.parquet(f"{data}/benchmark.parquet").where("item_id = 3").collect()[0]["text"]
    english = "the of and to in that for it was with by on not his but at are this have from or had they which you were all her would there their what".split()
    own = " ".join(english[int(w[1:]) % len(english)] for w in prose(90, 8).split())  # of a language, unlike prose() itself
    extra = spark.createDataFrame([(9001, prose(40, 3) + " " + leak, "en", "src1", 1), (9002, "12 34", "en", "src1", 1), (9003, None, None, None, None), (9004, own, "en", "src1", 1), (9005, own + " more", "en", "src1", 1), (9004, own, "en", "src1", 1)], base.schema)
    table = base.unionByName(extra)
    ids = {r["doc_id"] for r in table.collect()}
    stages = dict(corpus_pipeline.STAGES)
    told = stages["language_id"](spark, table, data)
    kept = {r["doc_id"] for r in told.collect()}
    assert told.columns == base.columns and not kept & {9002, 9003} and len(ids - kept) <= 0.02 * len(ids)
    one = stages["ngram_jaccard_join"](spark, told, data)
    counts = Counter(r["doc_id"] for r in one.collect())
    assert one.columns == base.columns and max(counts.values()) == 1 and 9004 in counts and 9005 not in counts
    clean = stages["benchmark_decontamination"](spark, one, data)
    assert clean.columns == base.columns and 9001 not in {r["doc_id"] for r in clean.collect()} and clean.count() > 0.9 * one.count()
    mixed = stages["source_mixing"](spark, clean, data)
    assert mixed.columns == base.columns and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in clean.collect()}
    last = stages["token_id_output"](spark, mixed, data)
    assert last.count() == mixed.count()


def test_run_over_a_small_table(spark, data, tmp_path):
    """run() itself: what it returns are the token files of documents that every stage kept."""
    from tokenizers import Tokenizer

    few = spark.read.parquet(f"{data}/documents.parquet").where("doc_id < 60").unionByName(spark.createDataFrame([(900, "12 34", None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long"))
    few.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    texts = {r["doc_id"]: r["text"] for r in few.collect()}
    library = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    at = 0
    for r in rows:
        assert r["start"] == at and r["n_tokens"] == len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids) + 1
        at += r["n_tokens"]
    assert rows and 900 not in {r["doc_id"] for r in rows} and [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)


def test_empty_pipeline(spark, data):
    docs_ = spark.read.parquet(f"{data}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs_ = stage(spark, docs_, data)
    assert docs_.count() == 0
