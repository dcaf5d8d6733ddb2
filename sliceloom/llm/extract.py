"""Main text of web pages: templates deduced from equivalence classes of tokens, and the slots they leave."""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A template is deduced from about this many pages of a host; larger hosts are dealt into such groups.
GROUP = 48
#: Fewer distinct pages than this say too little about what repeats by design.
SUPPORT = 5
#: Share of a group's distinct pages that has a token of the template.
SHARE = 0.8
#: Counters of pages by hash of the host: the bound of what is broadcast.
SLOTS = 1 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[a-zA-Z/!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
_SKIP = frozenset("head nav header footer aside form button select option dialog menu object canvas audio video map".split())
_ROOT = frozenset(("article", "main"))
#: Words that name a part which is not main text, and what else such a name may consist of.
_PARTS = (
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion sidebar cookie cookies consent notice notices banner banners alert popup modal "
    "comment comments respond replies disqus menu nav navbar navigation breadcrumb breadcrumbs footer header masthead share sharing social related newsletter subscribe "
    "widget toolbar pagination skip-link"
).split()
_AROUND = "area bar block box button buttons container content footer form items inner item left links list main module nav outer page panel post posts right section side site slot stories top unit wrap wrapper".split()
_NAMED = re.compile(rf"(?:(?:{'|'.join(_AROUND)})[-_])*(?:{'|'.join(_PARTS)})(?:[-_](?:{'|'.join(_AROUND + _PARTS)}|\d+))*", re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())


class Token(NamedTuple):
    """A tag (text None) or a block of text, by its path of block elements."""

    path: str
    text: str | None
    article: bool = False
    skip: bool = False
    #: Characters of the text that are in links.
    linked: int = 0


def _named(attributes: str) -> bool:
    """Whether a class, id or role says that this part is not main text."""
    values = [x[0] or x[1] or x[2] for x in _NAMES.findall(attributes)]
    return any(v.lower() in _ROLES or any(_NAMED.fullmatch(name) for name in v.split()) for v in values)


def _tokens(page: str) -> list[Token]:
    #: Of each open element: tag, path of block elements, in an article, in a part that is not main text, in a link.
    stack: list[tuple[str, str, bool, bool, bool]] = [("", "", False, False, False)]
    out: list[Token] = []
    held: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(held)).split())
        if text:
            _, path, article, skip, _ = stack[-1]
            out.append(Token(path, text, article, skip, linked))
        held.clear()
        linked = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
            if stack[-1][4]:
                linked += m.start() - at
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1] and held and m[1].lower() not in _INLINE:
                flush()
            continue
        tag = tag.lower()
        block = tag not in _INLINE
        if block and held:
            flush() if tag != "br" else held.append(" ")
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        elif tag not in _VOID:
            if tag == "p" and stack[-1][0] == "p":
                stack.pop()
            _, path, article, skip, link = stack[-1]
            # an article's own header has its headline
            skip = skip or tag in _SKIP and not (tag == "header" and article)
            if m[4] and not skip and tag not in ("html", "body", *_ROOT):
                skip = _named(m[4])
            path = f"{path}/{tag}" if block else path
            if block:
                out.append(Token(path, None))
            if not m[4].endswith("/"):
                stack.append((tag, path, article or tag in _ROOT, skip, link or tag == "a"))
    held.append(page[at:])
    flush()
    return out


class EquivalenceClass(NamedTuple):
    """Tokens that occur together: their numbers in order, and their places in each page that has them, a row an occurrence."""

    tokens: list[int]
    places: dict[int, np.ndarray]


def _valid(tokens: list[int], counts: np.ndarray, places: list[dict[int, list[int]]]) -> EquivalenceClass | None:
    """The class, if its tokens stand in one order, again and again, in every page that has them."""
    order, found = None, {}
    for page in np.flatnonzero(counts):
        line = np.sort(np.array([(at, t) for t in tokens for at in places[page][t]]).view("i8,i8").reshape(-1))
        grid = line["f1"].reshape(-1, len(tokens))
        order = grid[0] if order is None else order
        if (grid != order).any():
            return None
        found[int(page)] = line["f0"].reshape(grid.shape)
    return EquivalenceClass(order.tolist(), found)


def _nested(one: EquivalenceClass, other: EquivalenceClass) -> bool:
    """Whether each occurrence of either stands in one gap of the other, or outside it, in all pages."""
    for page in one.places.keys() & other.places.keys():
        a, b = one.places[page], other.places[page]
        inside = np.searchsorted(a.reshape(-1), b)
        around = np.searchsorted(b.reshape(-1), a)
        if not ((inside[:, 0] == inside[:, -1]).all() or (around[:, 0] == around[:, -1]).all()):
            return False
    return True


def template(pages: list[list[Token]]) -> tuple[set[tuple[str, str]], list[list[tuple[int, int] | None]]]:
    """Text tokens (path, text) of the template that the distinct pages share, and the slot of each token of each page.

    Tags and texts with one occurrence vector over the pages, that most pages have, are an equivalence class.
    It is valid if its tokens keep their order in every page, and goes into the template if it nests with
    all classes that are in it; the most frequent and largest come first. Pages without a class's tokens
    do not void it. A slot is the gap behind a class's token: (class, token). Texts of a class stay where they are more than half
    of some article: then pages repeat each other, not a template.
    """
    if len(pages) < SUPPORT:
        return set(), [[None] * len(p) for p in pages]
    number: dict[tuple[str, str | None], int] = {}
    places: list[dict[int, list[int]]] = []
    for page in pages:
        own = defaultdict(list)
        for at, t in enumerate(page):
            own[number.setdefault((t.path, t.text), len(number))].append(at)
        places.append(own)
    counts = np.zeros((len(number), len(pages)), np.int32)
    for i, own in enumerate(places):
        for t, at in own.items():
            counts[t, i] = len(at)
    often = np.flatnonzero((counts > 0).sum(axis=1) >= max(SUPPORT, SHARE * len(pages)))
    groups: dict[bytes, list[int]] = defaultdict(list)
    for t in often.tolist():
        groups[counts[t].tobytes()].append(t)
    names, chosen = list(number), []
    for tokens in sorted(groups.values(), key=lambda g: (-int((counts[g[0]] > 0).sum()), -len(g))):
        one = _valid(tokens, counts[tokens[0]], places)
        if one and all(_nested(one, other) for other in chosen):
            chosen.append(one)
    fixed: set[tuple[str, str]] = set()
    whole = [sum(len(t.text) for t in page if t.text and t.article and not t.skip) for page in pages]
    for one in chosen:
        texts = {t for t in one.tokens if names[t][1] is not None}
        of_article = [sum(len(t.text) for t in page if t.text and t.article and not t.skip and number[t.path, t.text] in texts) for page in pages]
        if not any(a * 2 > b for a, b in zip(of_article, whole, strict=True)):
            fixed |= {names[t] for t in texts}
    slots = [[None] * len(p) for p in pages]
    for i, page in enumerate(pages):
        ends = sorted((int(at), k, j, len(c.tokens)) for k, c in enumerate(chosen) if i in c.places for row in c.places[i] for j, at in enumerate(row))
        opened, at = [], 0
        for place, k, j, size in ends:
            slots[i][at:place] = [opened[-1] if opened else None] * (place - at)
            at = place
            opened = opened[:-1] if j else opened
            if j < size - 1:
                opened.append((k, j))
        slots[i][at:] = [opened[-1] if opened else None] * (len(page) - at)
    return fixed, slots


def _furniture(pages: list[list[Token]], slots: list[list]) -> set:
    """Slots that are filled with links, or with few different texts, over all pages."""
    held = defaultdict(list)
    for page, own in zip(pages, slots, strict=True):
        for t, slot in zip(page, own, strict=True):
            if t.text and slot is not None:
                held[slot].append(t)
    return {s for s, ts in held.items() if len(ts) >= SUPPORT and (sum(t.linked for t in ts) * 2 > sum(len(t.text) for t in ts) or len({t.text for t in ts}) * 2 < len(ts))}


def main_texts(pages: list[str]) -> list[str]:
    """Main text of each of some pages of one host: what fills the slots of its article, or of the page if there is none."""
    parsed = {p: _tokens(p) for p in dict.fromkeys(pages)}
    fixed, slots = template(list(parsed.values()))
    furniture = _furniture(list(parsed.values()), slots)
    out = {}
    for (page, tokens), own in zip(parsed.items(), slots, strict=True):
        article = any(t.article for t in tokens)
        kept = (t for t, slot in zip(tokens, own, strict=True) if t.text and not t.skip and (t.article if article else slot not in furniture) and (t.path, t.text) not in fixed)
        out[page] = " ".join(t.text for t in kept)
    return [out[p] for p in pages]


def _extract(group: pd.DataFrame) -> pd.DataFrame:
    group = group.assign(text=main_texts(group["html"].tolist()))
    return group[["page_id", "url", "text"]]


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per page.

    Pages of a host are compared in groups of about 48, dealt by a hash of page_id and url; a host of any
    size so makes tasks of one size. What repeats by design is the template that ``template`` deduces from
    each group of at least 5 distinct pages; its texts go, what fills its slots stays. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments are
    left out by element, role and name too; where a page has an article or main element, the text is taken
    from it, elsewhere slots that are filled with links or with the same few texts go. Character references are decoded, white space within a block is one space.

    Null or empty html gives an empty text. Null, relative and odd urls count as one host without a name.
    Repeated rows are kept. An empty table gives an empty result. Other columns are ignored.
    """
    host = F.coalesce(F.lower(F.regexp_extract(pages["url"], r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    rows = pages.select(pages["page_id"], pages["url"], F.coalesce(pages["html"], F.lit("")).alias("html"), host.alias("host"))
    slot = F.pmod(F.xxhash64("host"), F.lit(SLOTS))
    many = rows.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP)
    rows = rows.withColumn("slot", slot).join(F.broadcast(many), "slot", "left")
    group = F.pmod(F.xxhash64("page_id", "url"), F.ceil(F.coalesce("n", F.lit(1)) / GROUP))
    out = rows.withColumn("group", group).groupBy("host", "group").applyInPandas(_extract, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
