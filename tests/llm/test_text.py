import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import AWKWARD, docs, prose

from trackloom.llm import decontamination, fingerprints, html_extraction, language_id, pseudonyms, token_output

ITEM = "The train leaves Paris at 9 with 120 people, and Marie counts 35 km before the second stop. How far does it go?"


def test_leaks_and_other_parameters(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, prose(40, 77)), (3, None), (4, ""), (5, "too short"), (None, ITEM)], "item_id long, text string")
    other = ITEM.replace("Paris", "Berlin").replace("9", "14").replace("120", "7").replace("Marie", "Jonas").replace("35 km", "80 miles")
    clash = "He paid 5 and 5 and again 5 for it, then another 5 was due when they met, and 5 more."
    rows = {10: prose(200, 1) + " " + ITEM + " " + prose(100, 2), 11: prose(50, 3) + " " + other, 12: prose(300, 4), 13: ITEM.upper().replace(" ", "%% "), 14: " ".join(ITEM.split()[:5]), 15: prose(40, 77), **{100 + i: t for i, t in AWKWARD.items()}}
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.find_leaks(docs(spark, rows), bench).collect()}
    assert {(10, 1), (11, 1), (15, 2)} <= set(got) and {d for d, _ in got} <= {10, 11, 13, 15}
    assert got[10, 1]["n_changed"] == 0 and got[11, 1]["n_changed"] >= 4
    twice = spark.createDataFrame([(1, clash)], "item_id long, text string")
    mixed = "He paid 1 and 2 and again 3 for it, then another 4 was due when they met, and 6 more."
    same = mixed.translate(str.maketrans("12346", "77777"))
    found = decontamination.find_leaks(docs(spark, {1: mixed, 2: same}), twice).collect()
    assert [r["doc_id"] for r in found] == [2]  # one value of the item can't be five of the document


def test_equal_values_of_an_item_may_change_apart(spark):
    """One of two equal numbers changed in an otherwise verbatim item; windows against the majority alone are dropped."""
    head, tail = ("every day before the long winter began a farmer went down to the old market near the river and bought", "for the children of the village school so that each of them could take some home after the lesson")
    item = f"{head} 2 red and 2 blue balls {tail}"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = {1: item, 2: item.replace("2 blue", "3 blue"), 3: item.replace("2", "7"), 4: item.replace("2 red", "8 red").replace("2 blue", "9 blue")}
    got = {r["doc_id"]: (r["n_covered"], r["n_changed"]) for r in decontamination.find_leaks(docs(spark, rows), bench).collect()}
    n, red, blue = len(item.split()), item.split().index("red") - 1, item.split().index("blue") - 1
    assert got == {1: (n, 0), 2: (n - 1, 1), 3: (n, 1), 4: (n - (blue - red + 1), 2)}
    assert [r["doc_id"] for r in decontamination.decontaminate(docs(spark, {**rows, 5: "clean"}), bench).collect()] == [5]


def plain_templates(text):
    """(kind or word, its own text) of a text's template tokens, and its bare words."""
    text = re.sub(r"[\u2000-\u206F\u00A0\u00AB\u00BB\u00A1\u00BF\u3000-\u3003]", " ", text or "")
    alone = r"[\u3004-\u9fff\u0e00-\u0eff]"
    found = list(re.finditer(rf"{alone}|(?:[0-9A-Za-z]|(?!{alone})[^\x00-\x7f]|(?<=[0-9])[.,](?=[0-9]))+", text))

    def low(x):
        return re.sub(r"[A-ZÀ-ÖØ-Þ]", lambda c: c[0].lower(), x)

    out, words, end, number = [], [], 0, False
    for m in found:
        raw, word, between = m[0], low(m[0]), text[end : m.start()]
        is_number = re.fullmatch(r"[0-9.,]+", raw) is not None
        is_unit = word in decontamination.UNITS and number
        changed = [k for k, (a, b) in enumerate(zip(raw, word, strict=True)) if a != b]
        is_name = bool(words) and not re.search(r'[.!?:;\n"()]', between) and changed == [0] and len(raw.encode()) > 2 and not is_number and not is_unit
        if is_name and out and out[-1][0] == "NAME":
            out[-1] = ("NAME", low(text[out[-1][2] : m.end()]), out[-1][2])
        else:
            out.append(("NUMBER" if is_number else "UNIT" if is_unit else "NAME" if is_name else word, word, m.start()))
        words.append(word)
        end, number = m.end(), is_number
    return out, words


def plain_leaks(rows, items, size=6, literals=3):
    from collections import Counter, defaultdict

    def windows(tokens, n):
        return [(k, tuple(t[0] for t in tokens[k : k + n]), [(j, t[1]) for j, t in enumerate(tokens[k : k + n]) if t[0].isupper()]) for k in range(len(tokens) - n + 1)]

    out = []
    for item, text in items:
        tokens, words = plain_templates(text)
        own, width = [w for w in windows(tokens, size) if sum(not x.isupper() for x in w[1]) >= literals], size
        bare = not own
        if bare:
            if not words:
                continue
            width, tokens = min(size, len(words)), [(w, w) for w in words]
            own = windows(tokens, width)
        for doc, body in rows:
            theirs = plain_templates(body)[0] if not bare else [(w, w) for w in plain_templates(body)[1]]
            if bare and len(tokens) < 3 and theirs != tokens:
                continue
            by = defaultdict(list)
            for at, key, slots in windows(theirs, width):
                for item_at, own_key, own_slots in own:
                    if key == own_key:
                        by[at - item_at].append((item_at, own_slots, slots))
            covered, n_changed = set(), 0
            for held in by.values():
                votes = defaultdict(Counter)
                for _, was, now in {(p + j, x, y) for p, a, b in held for (j, x), (_, y) in zip(a, b, strict=True)}:
                    votes[was][now] += 1
                read = {w: next((n for n, c in v.items() if c == max(v.values())), w) if sum(c == max(v.values()) for c in v.values()) == 1 else w for w, v in votes.items()}
                kept = {p for p, a, b in held if all(y in (x, read[x]) for (_, x), (_, y) in zip(a, b, strict=True))}
                covered |= {k for p in kept for k in range(p, p + width)}
                n_changed += sum(n != w for w, v in votes.items() for n in v) if kept else 0
            if covered and len(covered) >= -(-len(tokens) // 2):
                out.append((doc, item, len(tokens), len(covered), n_changed))
    return sorted(out)


def test_leaks_equal_brute_force(spark):
    """Texts made of parts of items, with other names, numbers and units, against windows compared one by one."""
    import random

    items = {1: ITEM, 2: "He paid 5 and 5 and again 5 for it, then another 5 was due when they met, and 5 more.", 3: "Compute 12 + 7 * 3 - 4", 4: "What is the capital?", 5: "two words", 6: "Anna Maria Schmidt met Bob in New York City for 3 hours and 20 min, then Bob left.", 7: "日本語の文章は空白なしで書かれる", 8: "7 8 9 10 11 12 13 14", 9: "Why?", 10: "?!"}
    draw, rows = random.Random(21), {}
    swaps = [("Paris", "Oslo"), ("Marie", "Jo Ann"), ("9", "14"), ("35 km", "2 miles"), ("5", "6"), ("Bob", "Tim"), ("Anna Maria", "Eve"), ("3", "7"), ("20 min", "1 day"), ("12", "99"), ("capital", "Capital")]
    for i in range(120):
        text = items[draw.choice(list(items))]
        for a, b in draw.sample(swaps, draw.randrange(4)):
            text = text.replace(a, b, draw.choice([1, 9]))
        cut_at = draw.randrange(len(text) // 3 + 1)
        rows[i] = prose(draw.randrange(9), i) + draw.choice([" ", ". ", "\n"]) + text[cut_at if draw.random() < 0.4 else 0 :] + " " + prose(draw.randrange(9), 500 + i)
    rows |= {300 + i: t for i, t in AWKWARD.items()} | {400: "Two words!", 401: "why", 402: "Why not", 403: "?!"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = decontamination.find_leaks(docs(spark, rows), bench).drop("rk").collect()
    want = plain_leaks(list(rows.items()), list(items.items()))
    assert sorted(map(tuple, got)) == want and {k for _, k, *_ in want} == {1, 2, 3, 4, 5, 6, 7, 8, 9}
    assert {(d, k) for d, k, *_ in want if k in (5, 9)} >= {(400, 5), (401, 9)} and 402 not in {d for d, *_ in want}


@pytest.mark.parametrize("common", [0, 3, 100])
def test_windows_of_many_items_are_joined_last(spark, common):
    """An instruction above all items, of less, about half and most of their tokens: the same leaks, whatever is joined first."""
    head = "read the question below with care and give your own answer in one short line of text"
    items = {i: f"{head} " + prose(n, 900 + i) for i, n in enumerate([30, 25, 18, 17, 16, 12, 9, 5])} | {20: head, 21: prose(30, 907), 22: "why"}
    rows = {i: prose(5, i) + " " + t for i, t in items.items()} | {100 + i: t[len(t) // 3 :] for i, t in items.items()} | {200: head, 201: prose(40, 5) + " " + head + " " + head, 202: None}
    bench = spark.createDataFrame([*items.items(), (3, items[3])], "item_id long, text string")
    got = decontamination.find_leaks(docs(spark, [*rows.items(), (200, head)]), bench, common=common).drop("rk").collect()
    want = plain_leaks([*rows.items()], list(items.items()))
    assert sorted(set(map(tuple, got))) == want and {k for d, k, *_ in want if d == 200} == {3, 4, 5, 6, 7, 20}
    stored = decontamination.find_leaks(docs(spark, {}), bench.where("false"), common=common)
    assert stored.count() == 0


def test_common_windows_alone_never_make_a_leak(spark):
    head = "read the question below with care and give your own answer in one short line of text"
    bench = spark.createDataFrame([(i, f"{head} " + prose(30, 900 + i)) for i in range(40)], "item_id long, text string")
    items = bench.mapInArrow(decontamination._windows("item_id", 6, 3, 3, None, []), "item_id long, at long, n long, size long, window long, slots array<string>, words boolean")
    late = decontamination._late_windows(items, 0.5, 16).collect()
    assert len(late) == 40 * 12 and {r["at"] for r in late} == set(range(12))


def test_decontaminate_keeps_columns_and_clean_rows(spark):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    table = docs(spark, [(1, ITEM), (2, "clean"), (2, "clean"), (3, None)]).withColumnRenamed("_key", "_row_key")
    kept = decontamination.decontaminate(table, bench)
    assert kept.columns == table.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 2, 3]
    assert decontamination.decontaminate(table.where("false"), bench).count() == 0
    assert decontamination.decontaminate(table, bench.where("false")).count() == 4


def test_whole_benchmark_found_in_documents(spark, data):
    """Against plain search of normalised texts."""
    d, b = (spark.read.parquet(f"{data}/{t}.parquet").toPandas() for t in ("documents", "benchmark"))

    def plain(t):
        return " ".join(x for x in (re.sub(r"\W", "", w.lower()) for w in t.split()) if x)

    items = {i: plain(t) for i, t in zip(b.item_id, b.text, strict=True)}
    want = {(i, k) for i, t in zip(d.doc_id, d.text, strict=True) for k, x in items.items() if x in plain(t)}
    got = decontamination.op2_benchmark_decontamination(spark, data).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a < b) document.write("</p>")</script></head><body class="home">
<header><h1>Site</h1><a href=/>home</a></header><nav><ul><li><a href="/a">the menu of it</a></ul></nav><div class="cookie-notice">We use cookies and you agree to all of that.</div>
<article><h1>The &amp; title</h1><p>First   line of the&nbsp;text, and it is <b>long</b> enough to be read by all of us who are here.<p>Short.<ul><li>one item of the list</ul>
<div class="ad-box">Buy now the best of all</div><aside>See also</aside><p>Last of the article &lt;tag&gt; with <a href=x>a link</a> in it, which is only a small part of all this text.</p><form><input>Sign up for it</form>
<section id="comments"><p>I like that a lot and it was the best of all.</p></section></article><footer>&copy; all rights of the site</footer></body></html>"""


def test_pages():
    want = ["The & title", "First line of the text, and it is long enough to be read by all of us who are here.", "Short.", "one item of the list", "Last of the article <tag> with a link in it, which is only a small part of all this text."]
    assert html_extraction.main_text(PAGE).split("\n") == want
    text = "This is the text of a page that has no article at all, and it is long enough to stand on its own as it is here. " * 2
    bare = f"<div><a href=1>one</a> <a href=2>two</a></div><p>{text}</p><p>Short bit.</p><p>{text}</p><div><a href=3>more of the links</a></div>"
    assert html_extraction.main_text(bare).split("\n") == [text.strip(), "Short bit.", text.strip()]
    for odd in (None, "", "   ", "<", "<p", "<!--", "<script>x", "</div></div>", "<a><b><i>"):
        assert "<script" not in html_extraction.main_text(odd)
    assert html_extraction.main_text(None) == html_extraction.main_text("") == ""


RUNNING = "This is the text of a page that is marked by mistake, and it is long enough to stand on its own as it is here. " * 3
OPENINGS = ['<div class="has-sidebar">', '<div class="with-comments">', '<section id="no-banner">', '<div class="share-enabled">', '<div role="banner">', "<form>", '<form class="nav"><div id="pageWidget">']


@pytest.mark.parametrize("opening", OPENINGS)
def test_wrappers_marked_by_mistake_keep_their_text(opening):
    text, closing = RUNNING.strip(), "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opening)))
    side = f'<div class="sidebar"><p>{"Read more of what we have for you in all of the other parts of the site. " * 3}</p></div><footer>{text}</footer>'
    for inner in (f"<p>{text}</p><p>{text}</p>", f"<article><p>{text}</p><p>{text}</p></article>", f"<main><p>{text}</p><p>{text}</p></main>"):
        assert html_extraction.main_text(f"<body>{opening}{inner}{side}{closing}</body>").split("\n") == [text, text]


def test_marked_parts_beside_the_text_stay_out():
    text = RUNNING.strip()
    comments = f'<div id="comments"><article class="comment-body"><p>{text}</p></article><article><p>{text * 4}</p></article></div>'
    for page in (f"<div><p>{text}</p></div>{comments}", f"<article><p>{text}</p></article>{comments}", f'<div class="has-sidebar"><p>{text}</p>{comments}</div>'):
        assert html_extraction.main_text(page) == text
    assert html_extraction.main_text(comments).split("\n") == [text, text * 4]  # a page of comments alone
    assert html_extraction.main_text("".join(f'<div class="widget"><p>{text}</p></div>' for _ in range(5))).split("\n") == [text] * 5


def test_pages_of_the_table(spark, data):
    """Against the article cut out by its own tags."""
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in html_extraction.op3_html_extraction(spark, data).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.DOTALL)[1]
        parts = (" ".join(html.unescape(re.sub(r"<br>|</?b>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        assert r["text"] == "\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])


LONG_MARKUP = {"unclosed": "<a x " * 200_000, "open quote": '<a x="y ' * 125_000, "closed at the end": '<a x="y ' * 125_000 + ">", "two quotes": "<a \"' <b '\" " * 80_000 + ">", "opaque": "<svg>" * 200_000, "end tags": "<div>" * 50_000 + "</ul>" * 50_000, "marks": '<div class="ad">' * 20_000, "comments": "<!--" * 250_000}


@pytest.mark.parametrize("name", LONG_MARKUP)
def test_bad_markup_takes_linear_time(name):
    """About 1 MB each; times are compared with a fifth of it, as machines differ."""
    import time

    def took(page):
        begin = time.process_time()
        html_extraction.main_text(page)
        return time.process_time() - begin

    page = LONG_MARKUP[name]
    assert took(page) < 12 * took(page[: len(page) // 5]) + 1


def test_extract_keeps_given_columns(spark):
    rows = spark.createDataFrame([(1, f"<p>{RUNNING}</p>", "given", "own")], "page_id long, html string, text string, _text string")
    got = html_extraction.extract(rows).collect()[0]
    assert (got["text"], got["_text"], got["__text"]) == ("given", "own", RUNNING.strip())


def test_extract_keeps_columns(spark):
    rows = spark.createDataFrame([(1, None, "a", "x"), (1, None, "a", "x"), (2, PAGE, "b", "y")], "page_id long, html string, url string, furniture string")
    got = html_extraction.extract(rows)
    assert got.columns == [*rows.columns, "text"] and sorted(len(r["text"]) for r in got.collect())[:2] == [0, 0]
    assert html_extraction.extract(rows.where("false")).count() == 0


def test_fingerprints_equal_brute_force(spark):
    rows = sorted({**AWKWARD, 20: prose(300, 5), 21: prose(300, 5), 22: "x" * 5}.items())
    got = {r["doc_id"]: r for r in fingerprints.compare_edited(docs(spark, rows)).collect()}
    texts = [t or "" for _, t in rows]
    prints = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(docs(spark, rows)).collect()}
    assert len(got) == len(rows) and prints[20] == prints[21] and prints[1] == prints[2]
    for k, (i, _) in enumerate(rows):
        text, after = texts[k], texts[(k + 1) % len(rows)]
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        assert (got[i]["n_chars"], got[i]["edited_sha256"], got[i]["fingerprint"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[i])
        a, b = (fingerprints.decode([x]) for x in (prints[i], prints[rows[(k + 1) % len(rows)][0]]))
        assert got[i]["near_next"] == pytest.approx(float(fingerprints.likeness(a, b)[0])) and 0 <= got[i]["near_edited"] <= 1
    assert got[20]["near_next"] == 1.0 and got[20]["near_edited"] > 0.7


def test_digest_counts_triplets():
    import pyarrow as pa

    text = "abcabcabdé" * 7
    data, counts = text.encode(), np.zeros(fingerprints.BUCKETS, dtype=int)
    for k, (_, i, j) in enumerate(fingerprints.SPACINGS, 1):
        for p in range(len(data) - j):
            key = data[p] | data[p + i] << 8 | data[p + j] << 16 | k << 24
            counts[((key * 0xD6E8FEB86659FD93) % 2**64) >> 55] += 1
    ranked = np.sort(counts)
    want = sum((counts > ranked[fingerprints.BUCKETS * q // 4 - 1]).astype(int) for q in (1, 2, 3))
    got = fingerprints.digests(pa.array(["zz", text, None]))
    assert (got[1, 1:] == want).all() and (fingerprints.decode(fingerprints.encode(got)) == got).all()


def test_edges_of_fingerprints(spark):
    table = docs(spark, [(5, "abc"), (5, "abc"), (None, "xyz")])
    assert fingerprints.compare_edited(table).count() == 3
    assert fingerprints.compare_edited(docs(spark, {5: "abc"})).collect()[0]["near_next"] == 1.0
    assert fingerprints.compare_edited(table.where("false")).count() == 0


ODD = ["don't I'll 's it's", "a<|endoftext|> b <|startoftext|>", "é ́x İstanbul ΣΑΣ ς ǅ", "\x00a\x1cb c d", "<p>a&amp;</p> [x] `y` {z}~ a' ''", "ﬁ ½ ² 3,000.5 1st", "日本語 テスト　x", "WORD!! Word. word---", "ÑANDÚ×÷ß ªº µ"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_library(name):
    from tokenizers import Tokenizer

    own, library = token_output.Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    assert own.by_piece == (name == "word_bpe_49k.json")
    texts = [*ODD, *AWKWARD.values()]
    for text, got in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(got, dtype=own.dtype).tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_other_settings_are_not_cut_here(tmp_path):
    """The same vocabulary with one setting changed: ids stay the library's own."""
    import copy
    import json

    from tokenizers import Tokenizer

    told = json.loads(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).to_str())
    texts = ["The Word   and THE word " * 3, "ÉTÉ don't 12 word word"]
    for k, (part, name, value) in enumerate([("", "truncation", {"direction": "Right", "max_length": 4, "strategy": "LongestFirst", "stride": 0}), ("", "normalizer", {"type": "NFC"}), ("", "normalizer", None), ("model", "end_of_word_suffix", None)]):
        own = copy.deepcopy(told)
        (own[part] if part else own)[name] = value
        path = f"{tmp_path}/{k}.json"
        with open(path, "w") as f:
            json.dump(own, f)
        mine, library = token_output.Encoder(path), Tokenizer.from_file(path)
        assert not mine.plain
        for text, got in zip(texts, mine.encode(texts), strict=True):
            assert np.frombuffer(got, dtype=mine.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


def test_ids_of_random_texts_with_a_small_cache(monkeypatch):
    """Pieces that leave the cache and come back, of letters, marks and digits in any order."""
    import random

    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(token_output, "CACHE_PIECES", 60)
    own, library, draw = token_output.Encoder(path), Tokenizer.from_file(path), random.Random(9)
    parts = ["the", "The", "Éa", "ß", "straße", "ñu", "x" * 40, "don't", "'s", "...", "!?", "***", "12", "3.5", "日本", "é", "_a", "co-op", "e\u0301", "\u00a0", "\t", "<|endoftext|>"]
    for _ in range(60):
        texts = ["".join(draw.choice(parts) + draw.choice(["", "", " ", "\n", "  "]) for _ in range(draw.randrange(12))) for _ in range(20)]
        for text, got in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(got, dtype=own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(own.known) + len(own.older) < 600


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [*AWKWARD.items(), *[(50 + i, t) for i, t in enumerate(ODD)], (60, "twice"), (60, "twice"), (None, "no id")]
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    got = token_output.encode_and_read(docs(spark, rows), public_tokenizers.path("word_bpe_49k.json"), length=64, rows=3).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_output.encode_and_read(docs(spark, rows).where("false"), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_token_files_are_fixed_size_lists(spark, tmp_path):
    import pyarrow as pa

    token_output.write_ids(docs(spark, {1: "a b c d e", 2: "f g"}), public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/ids", length=4)
    n = pad = 0
    for path in (tmp_path / "ids").glob("ids-*.arrow"):
        with pa.memory_map(str(path)) as source:
            t = pa.ipc.open_file(source).read_all()
        assert t.schema.field("ids").type == pa.list_(pa.uint16(), 4) and t.schema.field("mask").type == pa.list_(pa.bool_(), 4)
        n += len(t)
        pad += sum(not m for row in t["mask"].to_pylist() for m in row)
    assert 4 * n - pad == 5 + 1 + 2 + 1


def test_language_held_out_accuracy(spark, data):
    got = language_id.op9_language_id(spark, data.replace("0.001", "0.01")).toPandas()
    known = spark.read.parquet(data.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(known, on="doc_id")
    held = both[both.held_out]
    assert [zlib.crc32(str(i).encode()) % 4 == 2 for i in both.doc_id] == both.held_out.tolist()
    assert len(held) > 200 and (held.lang == held.lang_pred).mean() > 0.97 and both.score.between(0, 1).all()


def plain_languages(rows, texts=400, chars=80, size=32_768):
    """A dictionary for each language, by the rule of learn()."""
    import xxhash

    held = {}
    for text, lang in rows:
        if text and lang is not None and any(map(str.isalpha, text)):
            held.setdefault(lang, set()).add(text)
    out = {}
    for lang, own in held.items():
        got = b""
        for h, text in sorted((xxhash.xxh64(t.encode(), seed=42).intdigest(), t) for t in own)[:texts]:
            at = (h >> 7) % max(1, len(text) - chars + 1)
            piece = text[at : at + chars]
            if not any(map(str.isalpha, piece)):
                at = next(k for k, c in enumerate(text) if c.isalpha())
                piece = text[at : at + chars]
            got += b" " + " ".join(re.findall(r"[^\W\d_]+", piece.lower())).encode()
        out[lang] = got[:size]
    return out


def plain_language(text, known):
    import zstandard

    kept = " ".join(re.findall(r"[^\W\d_]+", (text or "").lower()))
    if not kept:
        return "und"
    words = kept.split()
    turns = [f" {' '.join(words[k:] + words[:k])} ".encode() for k in range(min(8, len(words)))] if len(kept.encode()) < 512 else [f" {kept} ".encode()]
    for level, ways in ((6, [f" {kept} ".encode()]), (12, turns)):
        sizes = {}
        for lang in sorted(known):
            d = zstandard.ZstdCompressionDict(known[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            coder = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(coder.compress(w)) for w in ways) / len(ways)
        best, second = sorted(sizes.values())[:2]
        if second >= best * 1.002:
            break
    return min(sizes, key=lambda k: (sizes[k], k))


def test_languages_equal_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").collect()
    known = plain_languages([(r["text"], r["lang"]) for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2])
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.op9_language_id(spark, data).collect()}
    assert got == {r["doc_id"]: plain_language(r["text"], known) for r in rows}


def test_narrow_margins_are_rejected(spark):
    import random

    table = docs(spark, {1: "the cat and the dog are in the house of the man " * 20}).unionByName(docs(spark, {2: "der hund und die katze sind in dem haus von dem mann " * 20}, lang="de"))
    draw = random.Random(4)
    noise = " ".join("".join(draw.choice("qxzvwkj") for _ in range(5)) for _ in range(300))
    ask = docs(spark, {1: noise, 2: "the man and the dog"}).withColumnRenamed("_key", "language")
    got = {r["doc_id"]: r["_language"] for r in language_id.predict(ask, language_id.learn(table)).collect()}
    assert got[1]["rejected"] and not got[2]["rejected"] and got[2]["lang_pred"] == "en"


def test_language_edges(spark):
    table = docs(spark, {1: "the cat and the dog are in the house of the man " * 20}).unionByName(docs(spark, {2: "der hund und die katze sind in dem haus von dem mann " * 20}, lang="de"))
    known = language_id.learn(table.unionByName(docs(spark, {3: None})).unionByName(docs(spark, {4: "no label"}, lang=None)))
    assert set(known) == {"en", "de"}
    ask = docs(spark, {**AWKWARD, 30: "12 34 !!", 31: "the dog and the cat", 32: "die katze und der hund"}).withColumnRenamed("_key", "lang_pred")
    got = {r["doc_id"]: r["language"] for r in language_id.predict(ask, known).collect()}
    assert got[31]["lang_pred"] == "en" and got[32]["lang_pred"] == "de" and not got[31]["rejected"]
    assert all(got[i]["lang_pred"] == "und" and got[i]["rejected"] and got[i]["score"] == 0 for i in (1, 2, 3, 9, 30))
    assert {r["language"]["lang_pred"] for r in language_id.predict(ask, {}).collect()} == {"und"}
    assert language_id.predict(ask.where("false"), known).count() == 0 and language_id.learn(ask.where("false")) == {}


def test_any_number_of_languages(spark, monkeypatch):
    """More languages than a task holds coders of: the same answers, and none is left unlearned."""
    import random

    draw = random.Random(5)
    names = {f"l{k:03}": ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(30)] for k in range(520)}
    rows = [(lang, " ".join(draw.choice(words) for _ in range(60))) for lang, words in names.items() for _ in range(2)]
    known = language_id.learn(spark.createDataFrame(rows, "lang string, text string").repartition(4))
    assert known.keys() == names.keys()
    few = {k: known[k] for k in sorted(known)[:9]}
    ask = spark.createDataFrame([(i, " ".join(draw.choice(names[lang]) for _ in range(25))) for i, lang in enumerate(few)] + [(50, None), (51, "12 34"), (52, "zz")], "doc_id long, text string").coalesce(1)
    one = {r["doc_id"]: r["language"] for r in language_id.predict(ask, few).collect()}
    monkeypatch.setattr(language_id, "TOGETHER", 4)
    assert {r["doc_id"]: r["language"] for r in language_id.predict(ask, few).collect()} == one
    assert [one[i]["lang_pred"] for i in range(9)] == sorted(few) and one[50]["lang_pred"] == one[51]["lang_pred"] == "und"


def test_documents_without_an_id_are_learned_from(spark):
    rows = spark.createDataFrame([(None,), (4,)], "doc_id long").select("doc_id", language_id.held_out().alias("out")).collect()
    assert {r["doc_id"]: r["out"] for r in rows} == {None: False, 4: zlib.crc32(b"4") % 4 == 2}


def test_languages_made_of_copies_are_learned_from_distinct_texts(spark):
    """Few texts in many copies, one text in most rows, and texts whose letters come late."""
    from pyspark.sql import functions as F

    few = spark.range(40_000).select(F.concat(F.lit("the cat number "), F.translate((F.col("id") % 5).cast("string"), "01234", "abcde")).alias("text"), F.lit("en").alias("lang"))
    hot = spark.range(3000).select(F.lit("der hund ist in dem haus").alias("text"), F.lit("de").alias("lang"))
    rest = spark.createDataFrame([(f"{w} die katze", "de") for w in prose(300, 6).replace("w", "").translate(str.maketrans("0123456789", "abcdefghij")).split()], "text string, lang string")
    late = spark.createDataFrame([("7 " * 3000 + "le chat", "fr"), ("12 34", "xx")], "text string, lang string")
    table = few.unionByName(hot).unionByName(rest).unionByName(late)
    known = language_id.learn(table)
    assert set(known) == {"en", "de", "fr"} and known["fr"] == b" le chat"
    assert sorted(re.findall(r"number (\w)", known["en"].decode())) == list("abcde")
    assert known["de"].count(b"der hund") == 1 and known["de"].count(b"die katze") == rest.distinct().count()


def plain_noise(key, kind, i, x):
    return int(hashlib.sha256(f"{key}|{kind}|{i}|{x}".encode()).hexdigest()[:15], 16)


def plain_feistel(a, b, ra, rb, key, kind):
    for i in range(pseudonyms.ROUNDS):
        if i % 2 == 0:
            a = (a + plain_noise(key, kind, i, b)) % ra
        else:
            b = (b + plain_noise(key, kind, i, a)) % rb
    return a, b


def plain_digits(d, key, kind):
    n = len(d) // 2
    a, b = plain_feistel(int(d[:n]), int(d[n:]), 10**n, 10 ** (len(d) - n), key, f"{kind}{len(d)}")
    return f"{a:0{n}d}{b:0{len(d) - n}d}"


def luhn(d):
    t = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d)))
    return t % 10 == 0


def test_pseudonyms_equal_brute_force(spark):
    def ip(m):
        o = [int(x) for x in m.split(".")]
        a, b = plain_feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "k", "ip")
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"

    def card(d):
        body = plain_digits(d[:-1], "k", "card")
        return next(body + c for c in "0123456789" if luhn(body + c))

    def phone(m):
        new = iter("1" + plain_digits(re.sub(r"\D", "", m)[1:], "k", "phone"))
        return re.sub(r"\d", lambda _: next(new), m)

    cards = ["4429526289707589", "4642594433365630", "4877058944719913"]
    rows = {i: f"x {c}, ip 10.0.{i}.255. {c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]} call +1 (366) 555-980{i}; v4.0 9807915762804491" for i, c in enumerate(cards)}
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymise(docs(spark, rows), "k").collect()}
    for i, c in enumerate(cards):
        new = card(c)
        assert luhn(new) and got[i]["n_private"] == 4
        assert got[i]["text"] == f"x {new}, ip {ip(f'10.0.{i}.255')}. {new[:4]}-{new[4:8]}-{new[8:12]}-{new[12:]} call {phone(f'+1 (366) 555-980{i}')}; v4.0 9807915762804491"


def test_other_kinds_equal_brute_force(spark):
    import datetime as dt
    import random

    def ssn(m):
        area, group, serial = map(int, m.split("-"))
        a, b = plain_feistel((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, *pseudonyms.SSN_RANGES, "k", "ssn")
        return f"{a // 99 + 1 + (a // 99 >= 665):03d}-{a % 99 + 1:02d}-{b + 1:04d}"

    def date(m):
        parts = [int(x) for x in re.split(r"\D", m)]
        base, mark = dt.date(1700, 1, 1), re.search(r"\D", m)[0]
        iso = len(re.split(r"\D", m)[0]) == 4
        us = not iso and parts[1] > 12
        y, mo, d = parts if iso else ((parts[2], parts[0], parts[1]) if us else parts[::-1])
        at = (dt.date(y, mo, d) - base).days
        a, b = plain_feistel(at // 773, at % 773, 189, 773, "k", "date")
        new = base + dt.timedelta(a * 773 + b)
        held = re.split(r"\D", m)
        wide = 1 if len(held[1]) == 1 or len(held[2 if iso else 0]) == 1 else 2
        y, mo, d = str(new.year), f"{new.month:0{wide}d}", f"{new.day:0{wide}d}"
        return mark.join((y, mo, d) if iso else (mo, d, y) if us else (d, mo, y))

    def rest(s):
        return int("".join(str(int(c, 36)) for c in s)) % 97

    def iban(m):
        s = m.replace(" ", "")
        new = iter(plain_digits(re.sub(r"\D", "", s[4:]), "k", "iban"))
        body = re.sub(r"\d", lambda _: next(new), s[4:])
        digits = iter(f"{98 - rest(body + s[:2] + '00'):02d}" + re.sub(r"\D", "", body))
        return re.sub(r"\d", lambda _: next(digits), m)

    def email(m):
        local, domain = m.split("@")
        low = local.lower()
        h = hashlib.sha256(f"k|email|{re.sub('[a-z0-9]', '?', low)}@{domain.lower()}".encode()).hexdigest()
        chars = [c for c in low if c.isalnum()]
        v, r = [int(c) if c.isdigit() else ord(c) - 97 for c in chars], [10 if c.isdigit() else 26 for c in chars]
        half = len(v) // 2
        for i in range(pseudonyms.ROUNDS):
            other = v[half:] if i % 2 == 0 else v[:half]
            noise = hashlib.sha512(f"{h}|{i}|{','.join(map(str, other))}".encode()).hexdigest()
            for j in range(half) if i % 2 == 0 else range(half, len(v)):
                v[j] = (v[j] + int(hashlib.sha256(f"{noise}|{j}".encode()).hexdigest()[:8], 16)) % r[j]
        new = iter(v)
        return re.sub("[A-Za-z0-9]", lambda c: str(n) if (n := next(new)) is not None and c[0].isdigit() else chr(n + (65 if c[0].isupper() else 97)), local) + "@" + domain

    def made_iban(draw):
        body = "WEST" + "".join(draw.choice("0123456789") for _ in range(14))
        return f"GB{98 - rest(body + 'GB00'):02d}{body}"

    draw = random.Random(12)
    kinds = {
        ssn: [f"{draw.choice([a for a in (1, 665, 667, 899, 123)]):03d}-{draw.randrange(1, 100):02d}-{draw.randrange(1, 10_000):04d}" for _ in range(12)],
        date: ["1987-03-09", "31.12.1999", "12/31/1999", "1/2/2003", "2000-2-29", "1700-01-01", "28-02-2099", "5.6.1850"],
        iban: [made_iban(draw) for _ in range(6)] + ["GB82 WEST 1234 5698 7654 32"],
        email: ["Jo.Doe7@mail.example.com", "a@b.org", "x_1-Y%z+9@Sub.Example.NET", "ab@c.de"],
    }
    values = [(f, x) for f, own in kinds.items() for x in own]
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymise(docs(spark, {i: f"is {x} so" for i, (_, x) in enumerate(values)}), "k").collect()}
    for i, (f, x) in enumerate(values):
        assert got[i]["text"] == f"is {f(x)} so", x


def test_layouts_of_one_phone_number_stay_linked(spark):
    rows = {1: "+1 366 555 9801", 2: "+13665559801", 3: "(366) 555-9801", 4: "366-555-9801", 5: "+1 (366) 555-9801", 6: "+442079460958", 7: "+44 20 7946 0958", 8: "+358 40 123 4567", 9: "+358401234567", 10: "v1.2.3.4 and host9.1.2.3"}
    table = docs(spark, {i: f"at {x}, or" for i, x in rows.items()}).withColumnRenamed("_key", "n_private")
    got = {r["doc_id"]: r for r in pseudonyms.pseudonymise(table, "k").collect()}
    digits = {i: re.sub(r"\D", "", r["text"]) for i, r in got.items()}
    assert digits[1] == digits[2] == digits[5] == "1" + digits[3] and digits[3] == digits[4] != "3665559801"
    assert digits[6] == digits[7] and digits[6][:2] == "44" and digits[8] == digits[9] and digits[8][:3] == "358"
    assert got[10]["text"] == "at v1.2.3.4 and host9.1.2.3, or" and got[1]["n_private"] == "key" and got[1]["_n_private"] == 1


def test_pseudonym_formats(spark):
    text = "born 1987-03-09 or 31.12.1999 or 12/31/1999, ssn 123-45-6789, iban GB82 WEST 1234 5698 7654 32, mail Jo.Doe7@mail.example.com; not 2023-02-30, 000-12-3456, 12345"
    table = docs(spark, [(1, text), (2, text), (2, text), (3, None), (4, ""), (5, prose(20_000, 9)), (6, "clean 4.0 text @ 5")]).withColumnRenamed("_key", "_found")
    got = pseudonyms.pseudonymise(table, "k").collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 7 and by[1]["text"] == by[2]["text"] and by[1]["n_private"] == 6
    assert (by[3]["text"], by[3]["n_private"], by[4]["text"]) == (None, 0, "") and by[5]["text"] == prose(20_000, 9) and by[6]["n_private"] == 0
    new = by[1]["text"]
    hit = re.fullmatch(r"born (\d{4}-\d{2}-\d{2}) or (\d{2}\.\d{2}\.\d{4}) or (\d{2}/\d{2}/\d{4}), ssn (\d{3}-\d{2}-\d{4}), iban (GB\d\d WEST \d{4} \d{4} \d{4} \d\d), mail ([A-Z][a-z]\.[A-Z][a-z]{2}\d@mail\.example\.com); not 2023-02-30, 000-12-3456, 12345", new)
    assert hit and hit[2].split(".") == [hit[3].split("/")[k] for k in (1, 0, 2)]  # one day, laid out twice
    iban = hit[5].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert pseudonyms.pseudonymise(table.where("false"), "k").count() == 0 and pseudonyms.pseudonymise(table, "other").where("doc_id = 1").collect()[0]["text"] != new


def test_permutations_are_one_to_one(spark):
    from pyspark.sql import functions as F

    d = F.lpad(F.col("id").cast("string"), 3, "0")
    n = spark.range(1000).select(pseudonyms.permute_digits(d, "k", "t").alias("p")).distinct()
    assert n.count() == 1000 and n.where("p rlike '^[0-9]{3}$'").count() == 1000
    days = spark.range(0, 146_097, 97).select(F.date_format(F.date_add(F.to_date(F.lit("1700-01-01")), F.col("id").cast("int")), "yyyy-MM-dd").alias("d"))
    moved = days.select(pseudonyms.pseudonym(F.col("d"), "k").alias("p"))
    assert moved.distinct().count() == days.count() and moved.where("p < '1700-01-01' OR p > '2099-12-31' OR try_to_date(p) IS NULL").count() == 0
