"""Operator 7: main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. What structure takes out goes first: navigation, headers, footers, sidebars, forms,
notices, adverts, reader comments (by element, role, or a class or id that is such a name as a whole, with or without a part's name as in
``comments-area``), and in a page with an ``article`` or ``main`` element what stands outside it. Pass 1 decides the other blocks by link density,
length and stop-word density (stop words among runs of letters): linked ones are bad, dense ones of some length are good, those with a low
density are bad if they hold links and doubtful if not; short blocks and middling densities stay open. Pass 2 gives an open block the label of
its nearest decided neighbours (where they differ both have to be good, or the block inside ``article`` or ``main``; else ties go by distance and an
equal distance is bad). A doubtful block (a table, a list of names) outside these elements needs a good
neighbour on both sides, or one at an end of the page if it has any stop word; where a page has no decided block short ones stay if they are dense. Stop words are
known for four languages: where no block of a page is dense, length and link density alone decide, so that tables and other languages stay.

An empty table gives no rows; a very long page takes time in proportion to its length. Row-local. Null html is the empty page with an empty text. Unclosed and cut-off markup is read as far as it goes.
Repeated rows each give a row. Only the html column is read, whatever the names of the others.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_name, small_batches, table

SHORT, LONG = 70, 140  # characters
LINKS, STOP_LOW, STOP_HIGH = 0.3, 0.1, 0.2

#: Frequent function words of some languages.
STOP_WORDS = frozenset(
    "the of and to in a is that it on for was with be by as are this from at or an not have has had but they you we he she his her its which their were been will would can there"
    " der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über"
    " le la les de des un une et à en du que est pour dans qui par sur pas au plus ne ce avec sont il se cette aux ou son mais comme été leur"
    " el los las del y que se por con para una su al lo como más pero sus o este sí porque esta entre cuando muy sin sobre también me hasta hay donde no".split()
)

_OUT = frozenset("nav header footer aside form menu dialog select button noscript iframe object head".split())
_MAIN = frozenset(("article", "main"))
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NAMES = (
    r"(?:ad|ads|adverts?|advertisements?|advertising|banner|sponsor|sponsored|promo|promotion|comments?|commentlist|disqus|respond|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|header|masthead|cookies?|consent|notice|popup|modal|newsletter|subscribe"
    r"|share|social|related|pagination|pager)"
)
#: A class or id that names such a part of a page: the name alone, or with where it stands and what kind of box it is.
_NOT_TEXT = re.compile(
    rf"(?:(?:site|page|main|top|bottom|left|right|primary|secondary|global|user|reader|google|js)[-_])?{_NAMES}(?:[-_](?:{_NAMES}|area|list|section|container|wrapper|wrap|box|block|bar|banner|inner|outer|left|right|top|bottom|slot|unit|widget|buttons?|links?|posts?|articles?|items?|form|content|main|primary|\d+))*", re.I
)
_INLINE_ROLES = frozenset("h1 h2 h3 h4 h5 h6 html body article main".split())
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?""")
_DECIDING = re.compile("class|id|role|hidden", re.I)
_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|template|textarea|svg|math)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""",
    re.S | re.I,
)


def _deciding(attributes: str) -> dict[str, str]:
    """Those attributes of a tag that may take its content out; the first of a name counts."""
    found: dict[str, str] = {}
    if _DECIDING.search(attributes):
        for name, *value in _ATTRIBUTE.findall(attributes):
            if (name := name.lower()) in ("class", "id", "role", "hidden", "aria-hidden"):
                found.setdefault(name, "".join(value))
    return found


class Block:
    __slots__ = ("text", "links", "out", "main", "label", "doubtful")

    def __init__(self, text: str, links: int, out: bool, main: bool):
        self.text, self.links, self.out, self.main = text, links, out, main
        self.label: bool | None = None
        self.doubtful = False


def blocks(page: str) -> list[Block]:
    """Blocks with text, in page order."""
    found: list[Block] = []
    open_tags: list[tuple[str, bool]] = []  # (name, whether it takes its content out)
    opened: Counter[str] = Counter()
    outs = mains = links = 0
    pieces: list[str] = []
    link_pieces: list[str] = []

    def close() -> None:
        nonlocal pieces, link_pieces
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                linked = sum(len(x) for x in " ".join(entities.unescape("".join(link_pieces)).split())) if link_pieces else 0
                found.append(Block(text, linked, outs > 0, mains > 0))
        pieces, link_pieces = [], []

    def say(text: str) -> None:
        if text:
            pieces.append(text)
            if links:
                link_pieces.append(text)

    at = 0
    for m in _MARKUP.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        name = m[3] or m[6]
        if not name:
            continue
        name, ending, attributes = name.lower(), bool(m[2] or m[5]), m[4] or m[7] or ""
        if name == "br":
            say(" ")
        if name in _BLOCK:
            close()
        if name == "a":
            links = 0 if ending else 1
        if name in _VOID:
            continue
        deciding = _deciding(attributes) if attributes and not ending else {}
        if not (name in _BLOCK or name in _OUT or deciding or ending):
            continue
        if not ending:
            if name in _MAIN and not mains:  # an element left open before the article doesn't take it out
                open_tags, outs = [], 0
                opened.clear()
            if name == "p" and open_tags and open_tags[-1][0] == "p":
                outs -= open_tags.pop()[1]
                opened["p"] -= 1
            out = name in _OUT and not (name == "header" and mains)
            for key, text in deciding.items():
                if key in ("class", "id", "role"):
                    out = out or name in _BLOCK and name not in _INLINE_ROLES and any(map(_NOT_TEXT.fullmatch, text.split()))
                elif key == "hidden" or key == "aria-hidden" and text.lower() == "true":
                    out = True
            open_tags.append((name, out))
            opened[name] += 1
            outs += out
            mains += name in _MAIN
        elif opened[name] > 0:
            last = None
            while last != name:
                last, out = open_tags.pop()
                opened[last] -= 1
                outs -= out
                mains -= last in _MAIN
    say(page[at:])
    close()
    return found


_WORD = re.compile(r"[^\W\d_]+")


def _density(text: str) -> float:
    """Share of stop words among the runs of letters."""
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def _decide(found: list[Block]) -> list[Block]:
    """The good blocks of a list, after both passes."""
    density: dict[int, float] = {}
    for i, b in enumerate(found):
        if b.out or b.links > LINKS * len(b.text):
            b.label = False
        elif len(b.text) >= SHORT:
            density[i] = _density(b.text)
    known = any(d >= STOP_HIGH for d in density.values())  # else there are no sentences of a language that is known
    for i, d in density.items():
        b = found[i]
        if not known or d >= STOP_HIGH and len(b.text) >= LONG:
            b.label = True
        elif d < STOP_LOW and b.links:
            b.label = False
        else:
            b.doubtful = d < STOP_LOW and not b.main
    decided = [(i, b.label) for i, b in enumerate(found) if b.label is not None and not b.out]
    k, labels = 0, [b.label for b in found]
    for i, b in enumerate(found):
        while k < len(decided) and decided[k][0] < i:
            k += 1
        if b.label is None:
            before, after = decided[k - 1] if k else None, decided[k] if k < len(decided) else None
            if b.doubtful:
                labels[i] = bool(before or after) and all(x[1] if x else density[i] > 0 for x in (before, after))
            elif before and after and before[1] != after[1]:
                gaps = i - before[0], after[0] - i
                labels[i] = b.main or (gaps[0] != gaps[1] and (before if gaps[0] < gaps[1] else after)[1])
            else:
                nearest = before or after
                labels[i] = nearest[1] if nearest else b.main or len(b.text) >= SHORT or _density(b.text) >= STOP_HIGH
    return [b for b, good in zip(found, labels, strict=True) if good]


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    inside = [b for b in found if b.main and not b.out]
    return " ".join(b.text for b in _decide(inside or found))


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """All columns of pages, the main text of each, and n_chars."""
    small_batches(pages.sparkSession)
    text, n_chars = fresh_name(pages, text), fresh_name(pages, "n_chars")
    schema = pages.select("*", F.lit("").alias(text), F.lit(0).cast("long").alias(n_chars)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch[batch.schema.get_field_index(html)].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names, text, n_chars])

    return pages.mapInArrow(run, schema)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
