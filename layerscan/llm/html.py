"""Blocks of a page and lines that two pages share."""

from __future__ import annotations

import html as references
import re

import numpy as np

MAIN, OTHER, DROPPED = 0, 1, 2

#: Elements whose content is never text of the page.
SILENT = frozenset("script style noscript template iframe object svg canvas audio video head title".split())
#: Elements of page furniture.
FURNITURE = frozenset("nav aside form footer button select textarea dialog menu datalist".split())
#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role that mark furniture, notices, adverts and reader comments.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner sidebar "
    "menu menubar nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices alert popup "
    "modal overlay newsletter subscribe subscription share sharing social comment comments commentlist disqus reply "
    "replies respond related widget widgets masthead toolbar login signup search pagination pager footer contentinfo "
    "complementary disclaimer skip".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S
)
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in ("script", "style", "noscript", "template", "iframe", "svg", "title", "textarea")}
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+")


def _marked(attributes: str) -> bool:
    """Whether attributes mark an element as furniture or as hidden."""
    if not attributes or attributes.isspace():
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id", "role") and not MARKS.isdisjoint(_SPLIT.split(value)):
            return True
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def blocks(page: str) -> list[tuple[str, int]]:
    """Text blocks of a page in order, each MAIN, OTHER or DROPPED.

    MAIN lies in an ``article`` or ``main`` element, DROPPED in page furniture.
    White space inside a block becomes one space.
    """
    out: list[tuple[str, int]] = []
    text: list[str] = []
    skip, depth, silent, main = "", 0, "", 0
    at = 0

    def flush():
        if text:
            line = " ".join(references.unescape("".join(text)).split())
            if line:
                out.append((line, DROPPED if skip else MAIN if main else OTHER))
            text.clear()

    for token in _TOKEN.finditer(page):
        begin = token.start()
        if begin < at:
            continue
        if begin > at and not silent:
            text.append(page[at:begin])
        at = token.end()
        name = token[2]
        if name is None:
            continue
        name, closing = name.lower(), token[1] == "/"
        if silent:
            if closing and name == silent:
                silent = ""
            elif silent == "head" and name == "body":
                silent = ""
            continue
        if not closing and name in SILENT:
            flush() if name != "head" else None
            if token[3].endswith("/"):
                continue
            raw = _RAW_END.get(name)
            if raw is not None:
                end = raw.search(page, at)
                at = end.end() if end else len(page)
            else:
                silent = name
            continue
        furniture = not closing and name not in EMPTY and (
            name in FURNITURE or (name == "header" and not main) or (name not in ("html", "body") and _marked(token[3]))
        )
        if name in BLOCKS or furniture:
            flush()
        elif name == "br":
            text.append(" ")
        if skip:
            if name == skip:
                depth += -1 if closing else 1
                if depth == 0:
                    skip = ""
            elif not closing and name in ("article", "main") and skip in ("nav", "form", "header", "button", "select"):
                # Furniture that was never closed ends where the article begins.
                skip, depth = "", 0
            else:
                continue
            if skip or closing:
                continue
        if furniture:
            skip, depth = name, 1
            flush()
        elif name in ("article", "main"):
            main = max(0, main - 1) if closing else main + 1
    if at < len(page) and not silent:
        text.append(page[at:])
    flush()
    return out


def _common(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence, by bit rows.

    Bit i of a row is 0 where one more line of ``a`` up to i is matched. Rows of
    long pairs are kept for half of ``b`` at a time.
    """
    if not a or not b:
        return []
    if len(a) * len(b) > 1 << 28 and len(b) > 1:
        half = len(b) // 2
        ahead, behind = _counts(a, b[:half]), _counts(a[::-1], b[half:][::-1])[::-1]
        cut = int(np.argmax(ahead + behind))
        return _common(a[:cut], b[:half]) + [i + cut for i in _common(a[cut:], b[half:])]
    rows = list(_rows(a, b))
    i, j, out = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append(i)
        elif rows[j - 1] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _rows(a: list, b: list):
    masks: dict = {}
    for i, line in enumerate(a):
        masks[line] = masks.get(line, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for line in b:
        both = row & masks.get(line, 0)
        row = ((row + both) | (row - both)) & full
        yield row


def _counts(a: list, b: list) -> np.ndarray:
    """Length of the longest common subsequence of each prefix of ``a`` with ``b``."""
    row = (1 << len(a)) - 1
    for row in _rows(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def common_lines(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence of lines."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    middle = _common(a[head : len(a) - tail], b[head : len(b) - tail])
    return [*range(head), *(head + i for i in middle), *range(len(a) - tail, len(a))]
