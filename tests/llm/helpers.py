"""Small awkward tables and plain versions of what the operators do."""

import re

FORM = "doc_id long, text string, lang string, source string, n_chars long, rk string, n double, _key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, lang="en", source="s"):
    """texts: {id: text} or pairs; with further columns whose names operators use inside."""
    pairs = texts.items() if isinstance(texts, dict) else texts
    rows = [(i, t, lang, source, 7, "rk", 0.5, "key") for i, t in pairs]
    return spark.createDataFrame(rows, FORM).repartition(3)


def words(text):
    return WORD.findall(text or "")


def prose(n, seed=0, vocabulary=500):
    import random

    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


AWKWARD = {1: None, 2: "", 3: " \t\n ", 4: "one", 5: "a b c d e", 6: "ha " * 400, 7: prose(30_000, 1), 8: "ünï cödé ✓ 日本語   \x00 tail", 9: "\n\n\n", 10: "same text here " * 9, 11: "same text here " * 9}
