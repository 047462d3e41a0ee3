"""Main text of web pages as the maximum-scoring run of tokens.

A page is read as a sequence of tags and text runs.  Words score by the block they
stand in, usually above zero, and tags score below zero.  One linear scan finds the
run of tokens with the largest sum, the content region, which then grows to whole
blocks.  The weights are log odds of tokens inside and outside the article of pages
that mark it with <article> or <main>; those pages are the labels, and at most
LABELLED_PAGES of them, those with the smallest keyed hash, are counted.  Tokens that
the labels do not know score by their tag, and else by DEFAULTS.

Elements that by name, role or class are other parts of a page (menus, forms, comments,
adverts) score below zero and are left out of the region, unless they hold all of it.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotaloom.llm.common import map_arrow

LABELLED_PAGES = 2000
MOST_KEYS = 5000
TAG_CEILING = -0.05
WORD_LIMIT = 4.0
SMOOTHING = 1.0
OUT = "text string, n_chars long"

# Element and class names of HTML pages.
RAW = "script|style|noscript|template|svg|math|textarea|iframe|object|select|title|canvas"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("nav footer aside form menu dialog button label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
# A class or id names such a part if all its words are of these two lists and one is of the first.
PARTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promotion promoted "
    "banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login sidebar widget widgets nav "
    "navbar navigation menu breadcrumb breadcrumbs pagination pager footer masthead comment comments disqus replies respond "
    "share sharing social related recommended recommendations toolbar skip".split()
)
AROUND = frozenset(
    "site page main top bottom left right side box bar block area section list wrapper container inner outer link links button "
    "buttons icon icons item items form post posts article articles story stories reader user global primary secondary header "
    "unit slot label wrap group panel row holder".split()
)
# The header of a site, but not that of an article.
SITE_HEADER = re.compile(r"(?:site|page)[_-]header", re.IGNORECASE)
SPLIT_NAME = re.compile(r"[_-]+|(?<=[a-z])(?=[A-Z])")
# Tags that an opening tag closes, up to the element that holds them.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")),
}
DEFAULTS = {"word": 1.0, "link": -1.0, "tag": -0.25, "never": -0.2}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:svg|math)\b(?:\"[^\"]*\"|'[^']*'|[^\"'>])*+(?<=/)>"
    rf"|<({RAW})\b(?:\"[^\"]*\"|'[^']*'|[^\"'>])*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)"
    r"|<[a-zA-Z][^>]*+>"
    r"|[^<]++|<",
    re.DOTALL | re.IGNORECASE,
)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)


@dataclass
class Token:
    """A tag (``words`` is 0) or a text run.  ``key`` is what the labels are counted by."""

    key: str
    tag: str
    words: int = 0
    text: str = ""
    block: bool = False  # a tag that ends a block of text
    within: tuple[int, ...] = ()  # the open elements that are taken for other parts of a page
    marked: bool = False  # inside <article> or <main>

    @property
    def dropped(self) -> bool:
        return bool(self.within)


@dataclass
class Weights:
    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def of(self, token: Token, holders: frozenset[int] | None = frozenset()) -> float:
        """A token's score; ``holders`` are parts that hold the article, None if all parts are taken as they come."""
        other = holders is not None and not holders.issuperset(token.within)
        if token.words:
            if other:
                return DEFAULTS["never"] * token.words
            known = self.words.get(token.key, self.words.get(token.tag))
            if known is None:
                known = DEFAULTS["link" if token.tag == "a" else "word"]
            return known * token.words
        known = self.tags.get(token.key, self.tags.get(token.tag))
        return (DEFAULTS["never"] if token.tag in NEVER else DEFAULTS["tag"]) if known is None else known


def other_part(name: str) -> bool:
    """Whether one of the words of a class or id names a part of a page that is not its article."""
    for word in name.split():
        parts = {part.lower() for part in SPLIT_NAME.split(word) if part}
        if parts & PARTS and parts <= PARTS | AROUND or SITE_HEADER.fullmatch(word):
            return True
    return False


def tokens(page: str) -> list[Token]:
    """Tags and text runs of a page in order; comments, scripts and the like are left out."""
    out: list[Token] = []
    opened: list[tuple[str, str, tuple[int, ...], int]] = []  # tag, key, other parts, marked elements

    def where() -> tuple[tuple[int, ...], bool]:
        return (opened[-1][2], opened[-1][3] > 0) if opened else ((), False)

    def close(names: tuple[str, ...], until: Callable[[str], bool]) -> None:
        """Close the outermost of ``names`` that is open above ``until``, and what it left open."""
        lowest = None
        for depth in range(len(opened) - 1, -1, -1):
            if opened[depth][0] in names:
                lowest = depth
            elif until(opened[depth][0]):
                break
        if lowest is not None:
            del opened[lowest:]

    for found in TOKEN.finditer(page):
        raw, closing, name, rest = found.groups()
        whole = found[0]
        if name is None or raw is not None:
            if raw is not None or whole[0] == "<" and len(whole) > 1:
                continue
            tag, key = opened[-1][:2] if opened else ("", "")
            within, marked = where()
            out.append(Token(key, tag, len(whole.split()), whole, False, within, marked))
            continue
        name = name.lower()
        if closing:
            for depth in range(len(opened) - 1, -1, -1):
                if opened[depth][0] == name:
                    del opened[depth:]
                    break
            out.append(Token("/" + name, "/" + name, 0, "", name in BLOCKS, *where()))
            continue
        if name in BLOCKS:  # a new block ends an open paragraph and what it left open
            close(("p",), lambda tag: tag in BLOCKS)
        if name in IMPLIED:
            ends, holders = IMPLIED[name]
            close(ends, lambda tag: tag in holders)  # noqa: B023
        within, marked = where()
        key, other = name, name in NEVER or name == "header" and not marked
        if "=" in rest:
            for attribute, *values in NAMED.findall(rest):
                value = " ".join("".join(values).split())
                if attribute.lower() == "role":
                    other |= value.lower() in ROLES
                elif value:
                    other |= name not in ("html", "body", "article", "main") and other_part(value)
                    key = f"{name}.{value.lower()}" if key == name else key
        out.append(Token(key, name, 0, "", name in BLOCKS, within, marked))
        if name not in VOID and not rest.endswith("/"):
            # A part inside a part is already left out, unless the outer one turns out to hold the article.
            depth = opened[-1][3] if opened else 0
            opened.append((name, key, (*within, len(out) - 1) if other else within, depth + (name in ("article", "main"))))
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """The first of the shortest runs with the largest positive sum, as a half-open range; empty if there is none."""
    best, low, high = 0.0, 0, 0
    total, start = 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, low, high = total, start, i + 1
    return low, high


def region(found: list[Token], weights: Weights) -> tuple[int, int, frozenset[int]]:
    """The best run of tokens and the parts that hold all of it, which therefore are no other parts.

    A form, or a part by its class, that holds the page's first <main> or <article> holds the article.  Where the run
    has only words of other parts, the parts around the best stretch of all are opened and the scan runs again.
    """
    outer = [t for t in found if t.tag in ("main", "article") and not t.words and not t.marked]
    first = min(outer, key=lambda t: t.tag != "main", default=None)
    holders: frozenset[int] = frozenset()
    if first and not other_part(first.key[len(first.tag) + 1 :]):  # a comment may be an <article> as well
        holders = frozenset(i for i in first.within if found[i].tag not in NEVER - {"form", "fieldset"})
    low, high = best_run([weights.of(t, holders) for t in found])
    if not any(t.words and holders.issuperset(t.within) for t in found[low:high]):
        low, high = best_run([weights.of(t, None) for t in found])
        parts = [frozenset(t.within) for t in found[low:high] if t.words]
        if parts:
            holders |= frozenset.intersection(*parts)
            low, high = best_run([weights.of(t, holders) for t in found])
    return low, high, holders


def main_text(page: str, weights: Weights) -> str:
    """Text of the best region's blocks, joined by empty lines."""
    found = tokens(page)
    low, high, holders = region(found, weights)
    if low == high:
        return ""
    while low > 0 and not found[low - 1].block:
        low -= 1
    while high < len(found) and not found[high].block:
        high += 1
    blocks: list[str] = []
    open_text: list[str] = []
    for token in found[low:high] + [Token("", "", block=True)]:
        if token.block:
            text = " ".join("".join(open_text).split())
            open_text = []
            if text:
                blocks.append(text)
        elif token.tag == "br" and not token.text:
            open_text.append(" ")
        elif token.text and holders.issuperset(token.within):
            open_text.append(entities.unescape(token.text))
    return "\n\n".join(blocks)


# -- weights -----------------------------------------------------------------
def count_tokens(page: str) -> Counter:
    """(kind, key, inside) counts of a labelled page."""
    n: Counter = Counter()
    for token in tokens(page):
        kind = "word" if token.words else "tag"
        if token.text and not token.words:
            continue
        inside = token.marked and not token.dropped
        for key in {token.key, token.tag}:
            n[kind, key, inside] += token.words or 1
    return n


def fit(pages: DataFrame, most: int = LABELLED_PAGES) -> Weights:
    """Token weights from at most ``most`` pages that mark their article."""
    labelled = pages.filter(F.col("page_id").isNotNull() & F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    chosen = labelled.select("page_id", F.xxhash64(F.lit("pages"), "page_id").alias("_key")).distinct()
    chosen = chosen.orderBy("_key", "page_id").limit(most).select("page_id")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                n.update(count_tokens(page))
        kinds, keys, inside = zip(*n) if n else ((), (), ())
        columns = [pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array(inside, pa.bool_())]
        yield pa.record_batch([*columns, pa.array(list(n.values()), pa.int64())], names=["kind", "key", "inside", "n"])

    rows = labelled.join(F.broadcast(chosen), "page_id", "left_semi").select("html")
    counts = map_arrow(rows, counted, "kind string, key string, inside boolean, n long").groupBy("kind", "key").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inside"),
        F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("outside"),
    )
    top = counts.orderBy(F.desc(F.col("inside") + F.col("outside")), "kind", "key").limit(MOST_KEYS).collect()
    return weigh([(r.kind, r.key, r.inside, r.outside) for r in top])


def weigh(counts: list[tuple[str, str, int, int]]) -> Weights:
    """Log odds; tags stay below zero and words within WORD_LIMIT."""
    out = Weights()
    for kind, table in (("word", out.words), ("tag", out.tags)):
        rows = [c for c in counts if c[0] == kind]
        inside, outside = sum(c[2] for c in rows), sum(c[3] for c in rows)
        for _, key, i, o in rows:
            odds = math.log((i + SMOOTHING) / (inside + SMOOTHING)) - math.log((o + SMOOTHING) / (outside + SMOOTHING))
            table[key] = max(-WORD_LIMIT, min(WORD_LIMIT, odds)) if kind == "word" else min(odds, TAG_CEILING)
    return out


# -- pages -------------------------------------------------------------------
def extract(pages: DataFrame, weights: Weights | None = None, html: str = "html") -> DataFrame:
    """``pages`` without html, with text and n_chars.

    Null html counts as empty; a page without content has an empty text.  Repeated
    rows are extracted each and an empty table stays empty.  Columns of ``pages`` named
    text or n_chars give way.
    """
    names = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    rows = pages.select(*[F.col(f"`{c}`") for c in names], F.col(html).alias("_html"))
    if weights is None:
        weights = fit(pages.select("page_id", F.col(html).alias("html")))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page or "", weights) for page in batch.column(len(names)).to_pylist()]
            columns = [batch.column(i) for i in range(len(names))]
            sizes = pa.array(list(map(len, texts)), pa.int64())
            yield pa.record_batch([*columns, pa.array(texts, pa.string()), sizes], names=[*names, "text", "n_chars"])

    kept = rows.drop("_html").withColumn("text", F.lit("")).withColumn("n_chars", F.lit(0).cast("long")).schema
    return map_arrow(rows, extracted, kept)
