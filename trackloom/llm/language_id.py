"""Language ID by compression: the language whose text helps most to compress a document.

Per language a raw-content dictionary is cut from a bounded sample of labelled texts: a short piece of each of many texts.
A document is encoded with each of them by zstandard, whole, and the smallest output names the language. Where the margin
is narrow a second, stronger level decides, and a short text, of which whole bytes say little, is encoded in several
rotations of its words. A margin that is narrow then as well is a rejection.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, table

_OTHER = re.compile(r"[\W\d_]+")
#: Languages whose coders a task holds at a time; a batch meets further ones group by group.
TOGETHER = 64
#: Texts of fewer bytes are encoded in up to so many rotations where their margin is narrow.
SHORT_BYTES, ROTATIONS = 512, 8


def letters(text: str | None) -> str:
    """The words of a text in lower case, without digits, punctuation and markup; '' if it has no letter."""
    kept = _OTHER.sub(" ", (text or "").lower()).strip()
    return kept if any(map(str.isalpha, kept)) else ""


def learn(labelled: DataFrame, texts_per_language: int = 400, piece_chars: int = 80, dictionary_bytes: int = 32_768) -> dict[str, bytes]:
    """A dictionary for each language of (text, lang); rows with a null in either or without a letter are left out.

    The sample is bounded by texts_per_language, the distinct texts of smallest hash, and by piece_chars, the code points
    that each gives from a place that its hash names; copies of a text count once. The counts that set how much of the
    table is looked at cover all distinct texts. Every language is learned: what the driver holds grows with their number,
    dictionary_bytes each, and not with the table.
    """
    known = labelled.select("text", "lang", F.xxhash64("text").alias("place")).where(r"lang IS NOT NULL AND text RLIKE '\\p{L}'")
    counts = known.select("lang", "place").distinct().groupBy("lang").count().collect()
    if not counts:
        return {}
    # a row for each language, which the driver holds anyway
    shares = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, 4.0 * texts_per_language / r["count"])) for r in counts], "lang string, share double")
    first = Window.partitionBy("lang").orderBy(F.col("place") < 0, "place", "text")  # as unsigned numbers
    begin = F.pmod(F.shiftrightunsigned("place", 7), F.greatest(F.length("text") - piece_chars + 1, F.lit(1))) + 1
    few = known.join(F.broadcast(shares), "lang").where(F.shiftrightunsigned("place", 24) <= F.col("share") * (1 << 40)).drop("share").distinct().withColumn("rank", F.row_number().over(first))
    piece, late = F.substring("text", begin.cast("int"), F.lit(piece_chars)), F.regexp_extract("text", rf"(?s)\p{{L}}.{{0,{piece_chars - 1}}}", 0)
    piece = F.when(piece.rlike(r"\p{L}"), piece).otherwise(late)  # from the first letter where the place has none
    few = few.where(F.col("rank") <= texts_per_language).select("lang", "rank", piece.alias("piece")).collect()
    found: dict[str, bytes] = {}
    for r in sorted(few, key=lambda r: (r["lang"], r["rank"])):
        found[r["lang"]] = (found.get(r["lang"], b"") + b" " + letters(r["piece"]).encode())[:dictionary_bytes]
    missing = sorted({r["lang"] for r in counts} - set(found))
    if missing:
        raise RuntimeError(f"no dictionary for {missing}")
    return found


def _coders(dictionaries: dict[str, bytes], level: int) -> list[zstandard.ZstdCompressor]:
    made = []
    for content in dictionaries.values():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        made.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False))
    return made


def _rotations(kept: bytes) -> list[bytes]:
    words = kept.split()
    return [b" " + b" ".join(words[k:] + words[:k]) + b" " for k in range(min(ROTATIONS, len(words)))]


def predict(docs: DataFrame, dictionaries: dict[str, bytes], into: str = "language", min_margin: float = 0.002, levels: tuple[int, int] = (6, 12)) -> DataFrame:
    """docs with a struct column of that name: lang_pred, score, margin, rejected.

    lang_pred is 'und', score 0 and rejected true for a null text, one without letters, or where nothing was learned.
    score is the best language's share of 2**-bytes over all languages. margin is how much larger the runner-up's output
    is, as a share of the best one's; with one language it is 1. Where both levels leave a margin below min_margin the
    text is rejected, and ties go to the first language by name. Where docs has a column of that name already,
    underscores go before the new one's.
    """
    names = sorted(dictionaries)
    held = {n: dictionaries[n] for n in names}

    groups = [names[k : k + TOGETHER] for k in range(0, len(names), TOGETHER)]

    @F.pandas_udf("lang_pred string, score double, margin double, rejected boolean")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        made: dict[int, list[zstandard.ZstdCompressor]] = {}

        def coders(level: int, group: list[str]) -> list[zstandard.ZstdCompressor]:
            if len(groups) > 1:
                return _coders({n: held[n] for n in group}, level)
            if level not in made:
                made[level] = _coders(held, level)
            return made[level]

        def tell(some: pd.Series) -> list[tuple]:
            kept = [letters(t).encode() for t in some]
            told: list[tuple] = [("und", 0.0, 0.0, True)] * len(kept)
            left = {i: [b" " + k + b" "] for i, k in enumerate(kept) if k and names}
            for level in levels:
                sizes: dict[int, list[float]] = {i: [] for i in left}
                for group in groups if left else []:
                    own = coders(level, group)
                    for i, ways in left.items():
                        sizes[i] += [sum(len(c.compress(w)) for w in ways) / len(ways) for c in own]
                for i, found in sizes.items():
                    best, *rest = sorted(found)[:2]
                    margin = rest[0] / best - 1 if rest else 1.0
                    score = 1 / sum(2.0 ** max(best - s, -1000) for s in found)
                    told[i] = names[found.index(best)], score, margin, margin < min_margin
                left = {i: _rotations(kept[i]) if len(kept[i]) < SHORT_BYTES else ways for i, ways in left.items() if told[i][3]}
            return told

        together = 16 if len(groups) < 2 else 1_024  # texts at a time: coders are made anew where they don't all fit
        for batch in texts:
            told = [row for at in range(0, len(batch), together) for row in tell(batch[at : at + together])]
            yield pd.DataFrame(told, columns=["lang_pred", "score", "margin", "rejected"])

    return docs.withColumn(fresh(docs, into), encode("text"))


def held_out() -> F.Column:
    """Whether a document is kept from learning; one without an id isn't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = learn(docs.where(~held_out()))
    out = predict(docs.select("doc_id", "text"), known)
    return out.select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score")
