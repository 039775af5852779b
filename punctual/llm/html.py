"""Main text of web pages by maximum-scoring subsequence.

A page becomes a sequence of words and tags, each of a class: words by where they stand (plain, in a link, in
page furniture), tags by what they do. Every class has a weight: words score positive, tags negative, with
magnitudes learned as log odds from labelled pages, those that mark their article with one ``<article>`` or
``<main>``. One linear scan finds the contiguous region of the highest sum; its blocks, without furniture
standing inside, are the text. What is left out anyway costs nothing: furniture between the first and the last
words of one container or marked article, and there also the tags of a marked article, those of articles
nested in it included.

Weights are sums over all labelled pages, found by Spark; with none, ``DEFAULT`` holds. Null or empty html
gives an empty text; unclosed tags, truncated pages and repeated rows are ordinary input; among equal regions
the first wins; an empty table gives an empty result; further columns stay (``text`` and ``n_chars`` are
replaced).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import log

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Elements of HTML by what they mean here.
SILENT = "script style noscript template textarea select option iframe object svg math canvas audio video map title".split()
FURNITURE = "nav header footer aside form button dialog menu head".split()
BLOCKS = (
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul"
).split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
MAIN = ("article", "main")
CONTAINERS = "html body div section center table tbody tr td th details fieldset dd blockquote".split()
#: Words in class, id or role that name furniture.
NAMED = re.compile(
    r"(?<![a-z])(ads?|advert\w*|banner|breadcrumbs?|comments?|respond|replies|cookies?|consent|disclaimer|notices?|"
    r"footer|masthead|menu|nav(?:bar|igation)?|newsletter|pagination|pager|popup|modal|promo\w*|related|recommended|share|"
    r"sharing|sidebar|social|sponsor\w*|subscribe|subscription|toolbar|widget|complementary|contentinfo|search)(?![a-z])"
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
#: A page or column "with" or "without" furniture is none itself.
_ABOUT = re.compile(r"(?:with|without|no|not|has|hide|is)[-_]")
#: Elements of running text: in an article their ids name places to link to.
_TEXTUAL = "h1 h2 h3 h4 h5 h6 p li td th pre blockquote figure figcaption section".split()
_NAME = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SILENT_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in SILENT}
# The end tag of an option may be left out.
_SILENT_END["option"] = re.compile(r"</option\b[^>]*>|(?=<(?:option|optgroup)\b|</(?:select|datalist|optgroup)\b)|(?=<[a-z/])", re.I)

#: Classes and the weights they have before anything is learned: words in text, in links and in furniture; tags of
#: blocks, of other elements, of furniture (edge) and of the article (main). Learned weights are in units of a
#: plain word's and stay between these and ``LOWEST``, so a notice inside an article does not end it.
DEFAULT = {"word": 1.0, "link": -0.2, "furniture": -0.5, "block": -0.3, "inline": -0.2, "edge": -1.0, "main": -20.0}
LOWEST = {"link": -1.0, "furniture": -1.0, "block": -1.0, "inline": -0.5, "edge": -2.0, "main": -40.0}


def _is_furniture(name: str, attrs: str, inside: bool) -> bool:
    """Whether an element is page furniture; ``inside`` an article, ids of running text do not tell."""
    if name in FURNITURE:
        return True
    if name in ("html", "body", *MAIN) or not attrs:
        return False
    for kind, *values in _NAME.findall(attrs):
        if not (inside and kind.lower() == "id" and name in _TEXTUAL):
            if any(NAMED.search(word) and not _ABOUT.match(word) for word in "".join(values).lower().split()):
                return True
    return False


def tokens(html: str) -> Iterator[tuple[str, str, bool, int, bool]]:
    """(class, text or tag name, block boundary, home, within furniture) in page order. Silent elements are left out whole.

    The home is the number of the container around the token, for furniture of that around the whole of it; a
    marked article with all it holds is one container, of a negative number.

    Furniture lasts to its end tag; if that is missing, to the end of the element around it or to where the
    article starts.
    """
    at, open_tags, furniture, links, homes = 0, [], 0, 0, 0
    while at < len(html):
        found = _TOKEN.match(html, at)
        at = found.end()
        home = open_tags[-1][2] if open_tags else 0
        if found["text"] is not None:
            # A lone "<" is text unless it opens a tag that the page's end cut off.
            yield ("furniture" if furniture else "link" if links else "word"), found["text"], False, home, furniture > 0
            continue
        if found["name"] is None:
            continue
        name = found["name"].lower()
        if name in SILENT:
            if not found["close"] and not found["attrs"].endswith("/"):
                end = _SILENT_END[name].search(html, at)
                at = end.end() if end else len(html)
            continue
        marked = False
        if found["close"]:
            if any(tag == name for tag, _, _ in open_tags):
                while open_tags:
                    tag, was, _ = open_tags.pop()
                    furniture -= was
                    marked |= was
                    links -= tag == "a"
                    if tag == name:
                        break
                home = open_tags[-1][2] if open_tags else 0
        elif name not in VOID and not found["attrs"].endswith("/"):
            if name in MAIN:
                furniture, open_tags = 0, [(tag, False, around) for tag, _, around in open_tags]
            inside = any(tag in MAIN for tag, _, _ in open_tags)
            marked = _is_furniture(name, found["attrs"], inside) and not (inside and name == "header")
            furniture += marked
            own = home
            if home >= 0 and not furniture and (name in MAIN or name in CONTAINERS):
                homes += 1
                own = -homes if name in MAIN else homes
            open_tags.append((name, marked, own))
            links += name == "a"
        kind = "main" if name in MAIN else "edge" if marked else "block" if name in BLOCKS else "inline"
        yield kind, ("/" if found["close"] else "") + name, name in BLOCKS, home, marked or furniture > 0


def _weighed(html: str, weights: dict[str, float]) -> tuple[int, int, list[tuple[str, str, bool, int, bool]]]:
    """The tokens, and the slice of them with the highest sum (Kadane's scan)."""
    sequence = list(tokens(html))
    ends: dict[int, tuple[int, int]] = {}
    for k, (kind, value, _, home, _) in enumerate(sequence):
        if kind == "word" and value.strip():
            ends[home] = (ends.get(home, (k, k))[0], k)
    best, best_from, best_to, total, start = 0.0, 0, 0, 0.0, 0
    for k, (kind, value, _, home, furnished) in enumerate(sequence):
        if total <= 0:
            total, start = 0.0, k
        first, last = ends.get(home, (k, k))
        if first < k < last and (furnished or home < 0 and kind in ("block", "inline", "main")):
            continue
        total += weights[kind] * (len(value.split()) if kind in ("word", "link", "furniture") else 1)
        if total > best:
            best, best_from, best_to = total, start, k + 1
    return best_from, best_to, sequence


def extract(html: str | None, weights: dict[str, float]) -> str:
    first, last, sequence = _weighed(html or "", weights)
    blocks, parts = [], []

    def close() -> None:
        block = " ".join(unescape("".join(parts)).split())
        if block:
            blocks.append(block)
        parts.clear()

    for kind, value, boundary, _, _ in sequence[first:last]:
        if kind in ("word", "link"):
            parts.append(value)
        elif boundary or kind in ("furniture", "edge", "main"):
            close()
    close()
    return "\n".join(blocks)


def _class_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tokens of each class inside and outside the marked article, over labelled pages."""
    inside, outside = dict.fromkeys(DEFAULT, 0), dict.fromkeys(DEFAULT, 0)
    for batch in batches:
        for html in batch["html"]:
            sequence = list(tokens(html))
            starts = [k for k, t in enumerate(sequence) if t[0] == "main" and t[1] in MAIN]
            ends = [k for k, t in enumerate(sequence) if t[0] == "main" and t[1] not in MAIN]
            if len(starts) != 1 or len(ends) != 1 or ends[0] < starts[0]:
                continue
            for k, (kind, value, *_) in enumerate(sequence):
                where = inside if starts[0] < k < ends[0] else outside
                where[kind] += len(value.split()) if kind in ("word", "link", "furniture") else 1
    yield pd.DataFrame({"kind": list(DEFAULT), "inside": list(inside.values()), "outside": list(outside.values())})


def learn_weights(pages: DataFrame, html: str = "html") -> dict[str, float]:
    """Log odds of standing inside the article; words stay positive and tags negative, whatever the pages say."""
    marked = pages.select(F.col(f"`{html}`").alias("html")).where(F.lower("html").rlike("<(article|main)[ >]"))
    sums = (
        marked.mapInPandas(_class_counts, "kind string, inside long, outside long")
        .groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside"))
    )
    found = {row["kind"]: (row["inside"], row["outside"]) for row in sums.collect()}  # one row per class
    if not any(i for i, _ in found.values()):
        return dict(DEFAULT)
    odds = {kind: log((inside + 1) / (outside + 1)) for kind, (inside, outside) in found.items()}
    plain = max(odds["word"], 0.1)
    return {"word": 1.0} | {kind: min(max(odds[kind] / plain, low), DEFAULT[kind]) for kind, low in LOWEST.items()}


def extract_pages(pages: DataFrame, html: str = "html", weights: dict[str, float] | None = None) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points)."""
    weights = weights or learn_weights(pages, html)

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        return column.map(lambda page: extract(page, weights))

    pages = pages.drop("text", "n_chars") if html not in ("text", "n_chars") else pages
    return pages.withColumn("text", text_of(F.col(f"`{html}`"))).withColumn("n_chars", F.length("text").cast("long"))
