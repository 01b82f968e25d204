"""Main text of web pages by line-block distribution.

A page becomes lines: one per block element, with the markup stripped and character references
decoded. Elements that are never article text (menus, forms, scripts, and blocks named as adverts, notices, comments
and the like) have lines of length 0. Text lengths are summed over sliding windows of lines: where a window's sum dives to 0 a stretch of text
ends, and a stretch is body if some window in it surges. Stretches that never surge go, as stray lines behind a menu do; if none surges,
all are body. Where the page marks articles, all lines outside them have length 0 too, while what is excluded inside one is no line:
a marked article is never cut, and the distribution parts full articles from mere teasers.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textwords import bounded_batches, column_of, text_slices

WINDOW = 3  # lines in a block of the distribution
SURGE = 86  # characters in a window that make a stretch a body

# Elements whose text never shows or never belongs to an article.
HIDDEN = frozenset("script style noscript template svg math canvas iframe object audio video select option button textarea title head".split())
APART = frozenset("nav footer aside form header dialog menu fieldset".split())
BLOCK = frozenset(("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br").split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that a following sibling or an enclosing end closes.
OPEN_ENDED = {"p": BLOCK - {"br"}, "li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]), "tr": frozenset(["tr"]),
              "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
ASIDE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|notice|notification|gdpr|comments?|disqus|replies|respond|"
    r"nav|navbar|navigation|menu|breadcrumbs?|footer|header|masthead|sidebar|widget\w*|related|recommend\w*|share|sharing|social|newsletter|subscribe|popup|modal|toolbar|pagination|pager)(?:$|[\s_-])", re.I)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
ARTICLE_NAMES = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main)(?:[\s_-]?(?:body|content|text|main))?(?:$|[\s_-])", re.I)

# A quote opens a value only after an equals sign; a stray one is a character of the tag like any other.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe")}


def lines_of(page: str) -> list[tuple[str, bool]]:
    """(text, whether it stands in a marked article) of each line; the text of an excluded line is empty. Linear in the page."""
    stack: list[tuple[str, bool, bool]] = []  # name, excluded, article (of an excluded element: whether it stands in one)
    places: dict[str, list[int]] = {}  # of the open elements of each name
    blocks: list[int] = []  # places of the open block elements
    lines: list[tuple[str, bool]] = []
    held: list[str] = []
    gap = False  # excluded text since the last line
    at = 0

    def flush() -> None:
        nonlocal gap
        text = " ".join(html.unescape("".join(held)).split()) if held else ""
        if text or gap:
            lines.append((text, bool(stack) and stack[-1][2]))
        held.clear()
        gap = False

    def close(first: int) -> None:
        while len(stack) > first:
            gone = stack.pop()[0]
            places[gone].pop()
            if gone in BLOCK:
                blocks.pop()

    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not (stack and stack[-1][1]):
            held.append(text)
        elif text and not text.isspace():
            gap = True
        if m is None:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            flush()
        if m[1]:
            # The end of an inline element that holds an open block is ignored; all other ends close what they enclose.
            if places.get(name) and (name in BLOCK or not blocks or blocks[-1] < places[name][-1]):
                close(places[name][-1])
            continue
        while stack and name in OPEN_ENDED.get(stack[-1][0], ()):
            close(len(stack) - 1)
        if name == "p" and blocks and stack[blocks[-1]][0] == "p":  # an open paragraph ends here, with the inline elements in it
            close(blocks[-1])
        if name in VOID or m[3].rstrip().endswith("/") and name not in BLOCK:
            continue
        above = stack[-1] if stack else ("", False, False)
        names, role, hidden = [], "", False
        for a in _ATTR.finditer(m[3]):
            value = html.unescape(a[2] or a[3] or a[4] or "")
            key = a[1].lower()
            if key in ("class", "id"):
                names.append(value)
            elif key == "role":
                role = value.lower()
            elif key == "hidden" or value.lower() == "true":
                hidden = True
        named = " ".join(names)
        # The header of an article holds its headline.
        apart = name in HIDDEN or (name in APART and not (name == "header" and above[2])) or role in ASIDE_ROLES or hidden
        apart = apart or bool(name not in ("html", "body", "article", "main") and named and ASIDE_NAMES.search(named) and not (name == "header" and above[2]))
        article = above[2] or name in ("article", "main") or role in ("main", "article") or bool(named and name in ("div", "section") and ARTICLE_NAMES.search(named))
        if name in _RAW_END:
            end = _RAW_END[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        places.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            blocks.append(len(stack))
        apart = above[1] or apart
        stack.append((name, apart, above[2] if apart else article))
    flush()
    return lines


def bodies_of(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """First line, and the line at the dive, of each stretch of lines in which a window surges."""
    n = len(lengths)
    sums = [sum(lengths[i : i + window]) for i in range(n)]
    out, i = [], 0
    while i < n:
        if lengths[i]:
            end = i
            while end < n and sums[end]:
                end += 1
            if max(sums[i:end]) >= surge:
                out.append((i, end))
            i = end
        i += 1
    return out


def body_of(lengths: list[int], window: int = WINDOW, surge: int = SURGE) -> tuple[int, int]:
    """The body with the most text, the first of several; (0, 0) if none surges."""
    return max(bodies_of(lengths, window, surge), key=lambda x: sum(lengths[x[0] : x[1]]), default=(0, 0))


def main_text(page: str, window: int = WINDOW, surge: int = SURGE) -> str:
    lines = lines_of(page or "")
    if any(t and article for t, article in lines):
        texts = [t if article else "" for t, article in lines if t or not article]
    else:
        texts = [t for t, _ in lines]
    bodies = bodies_of([len(t) for t in texts], window, surge) or [(0, len(texts))]
    return "\n".join(t for first, end in bodies for t in texts[first:end] if t)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """Per row of ``pages``: id, the ``keep`` columns, text and n_chars. One pass, no shuffle.

    A null or empty page has an empty text, as has one without article text. Markup that never closes ends with
    the page. Repeated rows and null ids are answered row by row; a kept column named like a result is
    replaced by it, other columns are not read. An empty table gives an empty result.
    """
    bounded_batches(pages.sparkSession)
    keep = tuple(c for c in keep if c.lower() not in ("text", "n_chars", id_col.lower()))
    kinds = dict(pages.dtypes)
    names = [id_col, *keep]

    def run(batches):
        for part in text_slices(batches, "_html"):
            texts = [main_text(x) for x in column_of(part, "_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([column_of(part, f"_c{i}") for i in range(len(names))] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             [f"_c{i}" for i in range(len(names))] + ["text", "n_chars"])

    given = pages.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)], F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    schema = ", ".join(f"_c{i} {kinds[c]}" for i, c in enumerate(names)) + ", text string, n_chars long"
    return given.mapInArrow(run, schema).select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)], "text", "n_chars")
