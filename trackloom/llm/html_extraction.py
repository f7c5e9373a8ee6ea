"""HTML extraction by two-pass block rules.

A page is cut into blocks at its block-level tags. The first pass judges each block by length, link density and density of
stop words, and by where it stands (a menu, footer or form is never text). Short blocks and those of middling density stay
open. The second pass lets each open block inherit from its nearest decided neighbours: between two good ones it is good,
between two bad ones bad, and between a good and a bad one it goes with the nearer.

Stop words are known for four languages. A page whose running text has few of any is in another one, and its blocks are judged
by length, links and the marks that end or part sentences, which serve any script; a character of a script that sets no
blanks counts for three.

Marks of page furniture by kind of element are certain. Those by class, id, role or form are presumed: they don't reach
into a nested article or main, and are taken back from an element that holds most of the page's text. Sections of
comments and teasers, which may be longer than the text, keep theirs as long as there is text outside of them.

Parsing is forgiving: unclosed and stray tags are passed over, and a page without any tag is one block. It goes over a
page once: a tag ends at the next > outside of quotes, or, from the first quote that stays open to the page's end on, at
the next > whatever the quotes; a < without a > behind it is text.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table

#: Frequent function words by language.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only".split(),
    "fr": "de la le et les des en un une du que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux elle ou mais nous comme".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como o pero sus le ha si sin sobre este ya entre".split(),
}
_STOPS = {k: frozenset(v) for k, v in STOP_WORDS.items()}

#: Elements whose content is no text, to their end tag.
_OPAQUE = frozenset("script style noscript template textarea select option button svg math iframe object canvas audio video head title".split())
#: Elements that hold page furniture.
_FURNITURE = frozenset("nav footer aside menu dialog".split())
_ARTICLE = frozenset("article main".split())
#: Elements that begin and end blocks.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_NOTES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus footer gdpr "
    "masthead menu modal nav navbar navigation newsletter notice notices notification paywall popup privacy promo promoted promotion related reply replies share sharing "
    "sidebar signup social sponsor sponsored subscribe subscription teaser toolbar topbar widget".split()
)
#: A class or id that begins with one of _APART, and doesn't end with one of _STATES, names a section of other texts.
_APART = frozenset("comment comments commentlist disqus reply replies related teaser promo promoted sponsored".split())
_STATES = frozenset("enabled disabled open closed on off active allowed".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_OPENING = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][A-Za-z0-9:-]*+))")
_INSIDE = re.compile(r"""((?:"[^"]*+"|'[^']*+'|[^'">]++)*+)>""")
_INSIDE_PLAIN = re.compile(r"([^>]*+)>")
#: Presumed marks that elements within each other may have; those further inside don't count.
MOST_MARKS = 64
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.IGNORECASE)
#: Marks that end or part sentences, in any script.
_SENTENCES = re.compile("[.!?…,;:。！？、，；：؟،؛۔।॥።፣։·]")
#: Scripts that set no blanks: Thai, Lao, Burmese, Khmer, kana and Han, with the wide marks between them.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3000-\u30ff\u3400-\u9fff\uff00-\uff60]")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Rules:
    """Lengths are in characters, densities shares of characters (links) or words (stop words).

    flowing is the length from which a block of sentences is good where the language isn't known.
    """

    short: int = 70
    long: int = 200
    flowing: int = 120
    most_links: float = 0.3
    low_stops: float = 0.12
    high_stops: float = 0.2


@dataclass
class Block:
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    furniture: bool = False
    marks: tuple[tuple[int, bool], ...] = ()  # presumed ones: (number, apart)
    article: bool = False
    heading: bool = False
    text: str = ""
    label: str = ""


def _held(attributes: str) -> dict[str, str]:
    """An element's attributes by name in lower case; the first of a name counts."""
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), a or b or c)
    return found


def _certain(tag: str, held: dict[str, str], in_article: bool) -> bool:
    """Whether an element holds page furniture by its kind, or is hidden."""
    if tag in _FURNITURE or (tag == "header" and not in_article):
        return True
    return "hidden" in held or held.get("aria-hidden", "").lower() == "true" or bool(_NO_DISPLAY.search(held.get("style", "")))


def _presumed(tag: str, held: dict[str, str]) -> bool | None:
    """Whether an element that is marked by role, class or id, or as a form, is a section of other texts; None without a mark."""
    if tag in _ARTICLE | {"body", "html"}:
        return True if tag == "article" and any(w in ("comment", "reply", "teaser", "ad") for w in _words(held)) else None
    role = re.match("[a-z]*", held.get("role", "").strip().lower())[0]
    if tag != "form" and role not in _ROLES and not any(w in _NOTES for w in _words(held)):
        return None
    names = [_parts(n) for c in ("class", "id") for n in held.get(c, "").split()]
    return any(n[0] in _APART and n[-1] not in _STATES for n in names)


def _parts(name: str) -> list[str]:
    return re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())


def _words(held: dict[str, str]) -> list[str]:
    return _parts(" ".join(held[c] for c in ("class", "id") if c in held))


class _Tags:
    """The tags of a page in order, each as (start, end, closing, name, attributes); comments and declarations have no name."""

    def __init__(self, page: str):
        self.page, self.last, self.inside = page, page.rfind(">"), _INSIDE
        self.missing: set[str] = set()

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        page = self.page
        while hit := _OPENING.search(page, at):
            start, at = hit.span()
            if hit[2] is None:
                closing = "-->" if hit[0] == "<!--" else ">"
                end = page.find(closing, at)
                return start, len(page) if end < 0 else end + len(closing), False, "", ""
            if start > self.last:
                continue
            got = self.inside.match(page, at)
            if got is None:
                self.inside = _INSIDE_PLAIN
                got = self.inside.match(page, at)
            return start, got.end(), hit[1] == "/", hit[2].lower(), got[1]
        return None

    def end_of(self, name: str, at: int) -> int | None:
        """Where an element's end tag ends; None, also for all later ones, where there is none."""
        if name in self.missing:
            return None
        hit = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(self.page, at, self.last + 1)
        if hit is None:
            self.missing.add(name)
        return hit and hit.end()


def blocks(page: str) -> list[Block]:
    """The non-empty blocks of a page, in order, with their text and where they stand."""
    found: list[Block] = []
    stack: list[tuple[str, bool, bool, tuple]] = []  # (tag, furniture, article, marks), each with what its ancestors say
    opened: Counter[str] = Counter()
    tags = _Tags(page)
    now, links, at, breaks, marked = Block(), 0, 0, 0, 0

    def close(heading: bool = False) -> None:
        nonlocal now
        if now.pieces:
            text = " ".join(html.unescape("".join(now.pieces)).split())
            if text:
                now.text = text
                found.append(now)
        state = stack[-1] if stack else ("", False, False, ())
        now = Block(furniture=state[1], article=state[2], marks=state[3], heading=heading)

    def add(text: str) -> None:
        if text:
            now.pieces.append(text)
            if links and not text.isspace():
                now.linked += len(" ".join(html.unescape(text).split()))

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    while True:
        hit = tags.after(at)
        if hit is None:
            add(page[at:])
            break
        start, end, closing, tag, attributes = hit
        if start > at:
            add(page[at:start])
            breaks = breaks if page[at:start].isspace() else 0
        at = end
        if not tag:
            continue
        if tag == "br":
            breaks += 1
            if breaks == 2:
                close(now.heading)
            else:
                now.pieces.append(" ")
            continue
        breaks = 0
        if tag == "a":
            links = max(0, links - 1) if closing else 1
        elif tag in _OPAQUE and not closing:
            if not attributes.endswith("/"):
                end = tags.end_of(tag, at)
                if end or tag in ("script", "style", "textarea"):
                    at = end or len(page)
            now.pieces.append(" ")
        elif tag in _BLOCK:
            links = 0
            if closing:
                while opened[tag] and stack[-1][0] != tag:
                    pop()
                if opened[tag]:
                    pop()
            elif tag not in _VOID and tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or attributes:
                if tag == "li" and stack and stack[-1][0] == "li":
                    pop()
                furniture, article, marks = stack[-1][1:] if stack else (False, False, ())
                if tag not in _VOID and not attributes.endswith("/"):
                    if tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and stack and stack[-1][0] == tag:
                        furniture, article, marks = stack[-2][1:] if len(stack) > 1 else (False, False, ())
                        pop()
                    if tag in _ARTICLE:
                        marks = tuple(m for m in marks if m[1])
                    held = _held(attributes) if attributes else {}
                    apart = _presumed(tag, held)
                    if apart is not None and len(marks) < MOST_MARKS:
                        marked += 1
                        marks = (*marks, (marked, apart))
                    stack.append((tag, furniture or _certain(tag, held, article), article or tag in _ARTICLE, marks))
                    opened[tag] += 1
            elif tag == "p" and stack and stack[-1][0] == "p":
                pop()
            close(not closing and tag[0] == "h" and tag[1:].isdigit())
    close()
    return found


def stop_density(text: str) -> float:
    """The largest share of a language's stop words among a text's words."""
    words = _WORD.findall(text.lower())
    return max(sum(w in s for w in words) for s in _STOPS.values()) / len(words) if words else 0.0


def known_language(found: list[Block], rules: Rules) -> bool:
    """Whether a page's running text has a language's stop words; so it has if there is none, as nothing speaks against it."""
    running = [b.text for b in found if not b.furniture and len(b.text) >= rules.short and b.linked <= rules.most_links * len(b.text)]
    return not running or stop_density(" ".join(running)) >= rules.low_stops


def extent(text: str) -> int:
    """The length of a text, in which characters of scripts without blanks count for three."""
    return len(text) + 2 * (0 if text.isascii() else len(_UNSPACED.findall(text)))


def flows(b: Block, rules: Rules) -> bool:
    """Whether a block runs in sentences, in whatever language: marks as often as sentences have them, or length without links."""
    size, marks = extent(b.text), len(_SENTENCES.findall(b.text))
    return marks >= max(2, size / rules.long) or (size >= 2 * rules.long and not b.linked)


def _first(b: Block, rules: Rules, known: bool = True) -> str:
    """A block's label by itself, without presumed marks; known tells whether stop words serve."""
    density = b.linked / len(b.text)
    if b.furniture or density > rules.most_links or (not b.article and re.match(r"\W*(©|\(c\)|copyright)", b.text, re.IGNORECASE)):
        return "bad"
    size = len(b.text) if known else extent(b.text)
    if size < rules.short:
        return "bad" if b.linked and not b.article else ""
    if not known:
        return "good" if flows(b, rules) and (size >= rules.flowing or b.article) else ""
    stops = stop_density(b.text)
    if stops >= rules.high_stops:
        return "good" if len(b.text) >= rules.long or b.article else ""
    return "bad" if stops < rules.low_stops and not b.article else ""


def _second(found: list[Block], first: list[str], shut: list[bool], rules: Rules, known: bool = True) -> list[str]:
    """All labels, from those of the first pass; shut has the blocks that are page furniture."""

    def runs(b: Block) -> bool:
        return stop_density(b.text) >= rules.low_stops if known else flows(b, rules)

    first = ["bad" if s else label for s, label in zip(shut, first, strict=True)]
    held = any(b.article and not s for b, s in zip(found, shut, strict=True))
    decided = [i for i, label in enumerate(first) if label]
    ahead = [0, *accumulate(len(b.text) for b in found)]
    labels = []
    for i, b in enumerate(found):
        if first[i]:
            labels.append(first[i])
            continue
        k = bisect.bisect(decided, i)
        near = [n for n in (*decided[max(0, k - 1) : k], *decided[k : k + 1]) if found[n].article == b.article]
        if b.article and not any(first[k] == "good" for k in near):
            labels.append("good")  # an article's open blocks are text unless its own neighbours say otherwise
        elif held and not b.article:
            labels.append("bad")
        elif not near:
            labels.append("good" if not decided and runs(b) else "bad")
        else:
            nearest = min(near, key=lambda k: (ahead[max(k, i)] - ahead[min(k, i) + 1], first[k] == "bad"))
            labels.append("good" if b.article else first[nearest])
    return labels


def _taken_back(found: list[Block], labels: list[str]) -> set[tuple[int, bool]]:
    """The presumed marks that don't hold, by the labels that blocks have without such marks."""
    text = [(len(b.text), b.marks) for b, label in zip(found, labels, strict=True) if label == "good"]
    own = [(n, marks) for n, marks in text if not any(apart for _, apart in marks)]
    back = {m for _, marks in text for m in marks if m[1]} if not own else set()
    share = Counter()
    for n, marks in own or text:
        share.update({m: n for m in marks if not m[1]})
    total = sum(n for n, _ in own or text)
    back |= {m for m, n in share.items() if 2 * n > total}
    if own and all(set(marks) - back for _, marks in own):
        back |= set(share)  # many small elements hold all of the text
    return back


def judge(found: list[Block], rules: Rules) -> None:
    """Labels blocks good or bad in two passes; '' between them is open."""
    known = known_language(found, rules)
    first = [_first(b, rules, known) for b in found]
    shut = [b.furniture for b in found]
    if any(b.marks for b in found):
        back = _taken_back(found, _second(found, first, shut, rules, known))
        shut = [b.furniture or any(m not in back for m in b.marks) for b in found]
    for b, label in zip(found, _second(found, first, shut, rules, known), strict=True):
        b.label = label


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    """The good blocks of a page, joined by \\n; '' for a null or empty page."""
    found = blocks(page or "")
    judge(found, rules)
    return "\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame, rules: Rules = Rules(), into: str = "text") -> DataFrame:
    """pages, all columns, with the main text of the whole html in a column of that name, '' where there is none.

    Where pages has a column of that name already, underscores go before the new one's.
    """

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p, rules) for p in batch], dtype=object)

    return pages.withColumn(fresh(pages, into), texts("html"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
