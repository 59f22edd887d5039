"""Main text of web pages by differencing each page with its nearest URL.

A page's html is cut into lines (the texts of its blocks). What the markup itself names
as menu, header, footer, sidebar, notice, advert, form, script, style or comments goes at
once. Pages are put in order of (host, path); of the pages before and behind it, the one
whose path is nearest is a page's pair. The lines of both are aligned by a longest common
subsequence, and the lines they share are deleted: a template repeats, an article does not.
Neighbours with the very same lines count as one page; a pair that shares nearly all of
the page is a copy of it, not another page of the same template, and deletes nothing.

Regions that a page marks (``article``, ``main``, ``articleBody``) are differenced with all of
their lines. One with no line of the page's own, in it or in regions inside, belongs to the
template if the neighbour on the other side shares all of it too, and goes; where a single
neighbour carries it, it may be an article on two pages. The others are taken whole and are
weighed by their own text: the largest outermost one holds the article, and with an
``article`` the others beside it. Of a region with articles inside, the longer is the body: where its own text is at least
as long as the longest article inside, those are teasers or replies and go. Shared lines in
the body stay, since two pages may carry the same article or passage. Articles may be teasers
of a page whose body is in plain blocks: where the lines outside all regions that the
differencing leaves are longer, those are the main text. Pages without a region rely on the
differencing alone.

A class or id names a part around the article only as a whole: each of its words must name
such a part or its place (``comment-list``, ``siteHeader``; not ``share-price-analysis``).
Markup is read in linear time, however malformed; elements that change nothing are not
opened below a depth of 512, as in browsers.

Pages are dealt by ranges of (host, path, page_id), so a host with very many pages is
spread over tasks; at the ends of a range a page has one neighbour only. Each task holds
three pages at a time, and the ids of copies that wait.

Results for odd input: null html is empty and has an empty text; a null url has an empty
host and path; unclosed, crossed or cut-off markup is read as far as it goes; repeated
rows give equal rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, namedtuple
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The start of markup; whole tags where no quoted value holds < or >. Looks at most as far as the next <.
MARKUP = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/<>]*)((?:[^'\"<>]|\"[^\"<>]*\"|'[^'<>]*')*+>)?|[!?/])")
RAW = {
    name: re.compile(rf"</{name}(?=[\s/>])[^<>]*>?", re.I)
    for name in "script style textarea title xmp iframe noembed noframes".split()
}
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"br", "td", "th", "tr", "tbody", "option", "legend", "summary"}
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "body": {"head"},
}
SCOPES = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "select", "body"}
DROPPED = set(
    "nav header footer aside form noscript template svg math button select dialog menu object video audio canvas datalist "
    "map applet".split()
)
#: Words of class and id that name a part around the article.
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promos promotion banner sidebar "
    "sidebars menu menus nav navbar navigation breadcrumb breadcrumbs masthead topbar header footer cookie cookies consent gdpr "
    "notice notices alert notification popup modal overlay newsletter subscribe subscription signup login search form forms "
    "comment comments commentlist disqus reply replies respond discussion share sharing social teaser teasers related "
    "recommended recommendations widget toolbar pagination pager copyright skip".split()
)
#: Words that only place or shape such a part.
AROUND = set(
    "container wrapper wrap box boxes list lists bar block blocks section sections area region zone top bottom left right main "
    "site page global local primary secondary sub item items inner outer slot unit panel link links icon icons button buttons "
    "btn thread body text content title author meta row col column group post posts entry article articles story stories news "
    "blog user users reader readers guest mobile desktop sticky fixed legal privacy policy google media the to and".split()
)
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
COPY_SHARE = 0.9
LINK_SHARE = 0.8
DEEPEST = 512
SCHEMA = "page_id long, url string, text string, n_chars long"

Line = namedtuple("Line", "text region")
#: The lines of a page, and of its marked regions the levels and outer regions (-1: none; it comes first).
Blocks = namedtuple("Blocks", "lines levels parents")
Page = namedtuple("Page", "page_id url host path blocks")


def _is_part(name: str) -> bool:
    """Does a class, an id or a label name a part around the article, with all its words?"""
    words = [w.lower() for w in WORD.findall(name)]
    return name.isascii() and any(w in NAMES for w in words) and all(w in NAMES or w in AROUND or w.isdigit() or len(w) == 1 for w in words)


def _names_a_part(attributes: str) -> bool:
    """Does the element say that it is not part of the article?"""
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            if any(_is_part(w) for w in value.split()):
                return True
        elif name == "aria-label":
            if _is_part(value):
                return True
        elif name in ("itemprop", "itemtype"):
            if re.search(r"(?:^|/)(?:user)?comments?\s*$", value, re.I):
                return True
        elif name == "role":
            if value.strip().lower() in ROLES:
                return True
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _level(name: str, attributes: str) -> int:
    """How surely an element is the article: 3 article, 2 main, 1 marked as its body."""
    if name == "article":
        return 3
    if name == "main":
        return 2
    if attributes and re.search(r"role\s*=\s*[\"']?main\b", attributes, re.I):
        return 2
    if attributes and re.search(r"itemprop\s*=\s*[\"']?articleBody\b", attributes, re.I):
        return 1
    return 0


def _quoted_ends(html: str) -> tuple[list[int], list[int]]:
    """Places of quotes and >, and for each the end of a tag that is outside quotes there (-1: none)."""
    places = [m.start() for m in re.finditer("[\"'>]", html)]
    ends = [-1] * (len(places) + 1)
    following: dict[str, int] = {}
    for k in range(len(places) - 1, -1, -1):
        kind = html[places[k]]
        if kind == ">":
            ends[k] = places[k]
            continue
        if kind in following:
            ends[k] = ends[following[kind] + 1]
        following[kind] = k
    return places, ends


def markup(html: str):
    """(start, end, closing, name, attributes) of each piece of markup; comments, scripts and
    the like have no name. A tag whose quotes never close ends at the first >; one that is cut
    off at the end of the page is markup, other < are text."""
    at, last = 0, html.rfind(">")
    places = ends = None
    while m := MARKUP.search(html, at):
        at, name, attributes = m.end(), (m[2] or "").lower(), m[3]
        if name:
            if attributes is not None:
                attributes = attributes[:-1]
            elif at > last:
                if html.find("<", at) >= 0:
                    continue
                at = len(html)
            else:
                if ends is None:
                    places, ends = _quoted_ends(html)
                close = ends[bisect_left(places, at)]
                if close < 0:
                    close = html.find(">", at)
                attributes, at = html[at:close], close + 1
            if name in RAW and not m[1]:
                close = RAW[name].search(html, at)
                at, name = close.end() if close else len(html), ""
        elif m[0] == "<!--":
            close = html.find("-->", at - 2)
            at = close + 3 if close >= 0 else len(html)
        else:
            close = html.find(">", at) if at <= last else -1
            at = close + 1 if close >= 0 else len(html)
        yield m.start(), at, bool(m[1]), name, attributes or ""


def chosen_regions(levels: list[int], parents: list[int], own: list[int]) -> list[bool]:
    """Regions whose own text is the article's, by level, outer region (-1: none; it comes
    first) and characters outside inner regions."""
    body, longest, inside = [0] * len(own), [0] * len(own), [False] * len(own)
    for r in range(len(own) - 1, -1, -1):
        inside[r] = longest[r] > own[r]  # what is inside is the body
        nested, body[r] = body[r], own[r]
        if inside[r]:
            body[r] = nested + own[r] * (levels[r] == 3)
        if parents[r] >= 0:
            body[parents[r]] += body[r]
            longest[parents[r]] = max(longest[parents[r]], body[r])
    outermost = [r for r in range(len(own)) if parents[r] < 0]
    best = max(outermost, key=lambda r: (body[r], levels[r]), default=-1)
    reached = [False] * len(own)
    for r in range(len(own)):
        p = parents[r]
        reached[r] = levels[r] == levels[best] if p < 0 else reached[p] and inside[p]
    return [reached[r] and (levels[r] == 3 or not inside[r]) for r in range(len(own))]


def blocks(html: str) -> Blocks:
    """The lines of a page with the innermost region each lies in; those outside all regions
    (-1) are not mostly links."""
    stack: list[tuple[str, bool, int]] = []  # name, dropped, region
    opened: Counter = Counter()  # names on the stack
    deeper: Counter = Counter()  # names that were not put there
    levels: list[int] = []
    parents: list[int] = []
    lines: list[tuple[str, int, float]] = []
    run: list[str] = []
    state = [False, -1]  # inside a dropped element; region
    links = [0, 0]  # characters in links and in all, of the block

    def end_block() -> None:
        if run:
            text = " ".join(unescape("".join(run)).split())
            if text:
                lines.append((text, state[1], links[0] / max(1, links[1])))
            run.clear()
        links[:] = 0, 0

    def pop_to(index: int) -> None:
        outer = stack[index - 1][1:] if index else (False, -1)
        if outer[1] != state[1]:
            end_block()
        opened.subtract(x[0] for x in stack[index:])
        del stack[index:]
        state[:] = outer

    in_link = 0
    at = 0
    for start, end, closing, name, attributes in markup(html):
        if start > at and not state[0]:
            text = html[at:start]
            run.append(text)
            links[1] += len(text)
            links[0] += len(text) * (in_link > 0)
        at = end
        if not name:
            continue
        if name in BLOCKS:
            end_block()
        if closing:
            if name == "a":
                in_link = 0
            if deeper[name]:
                deeper[name] -= 1
            elif opened[name]:
                pop_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        if name == "a":
            in_link = 1
        if name in VOID:
            continue
        if name in CLOSES_P and opened["p"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop_to(i)
                    break
                if stack[i][0] in CLOSES_P:
                    break
        if name in SIBLINGS and any(opened[x] for x in SIBLINGS[name]):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in SIBLINGS[name]:
                    pop_to(i)
                    if name not in ("tr", "tbody"):
                        break
                elif stack[i][0] in SCOPES:
                    break
        if attributes.endswith("/") and name not in BLOCKS:
            continue
        dropped = state[0] or name in DROPPED or (bool(attributes) and name not in ("html", "body") and _names_a_part(attributes))
        level = 0 if dropped else _level(name, attributes)
        opens = level == 3 or (level > 0 and state[1] < 0)
        if dropped == state[0] and not opens and len(stack) >= DEEPEST:
            deeper[name] += 1
            continue
        region = state[1]
        if opens:
            end_block()
            levels.append(level)
            parents.append(region)
            region = len(levels) - 1
        stack.append((name, dropped, region))
        opened[name] += 1
        state[:] = dropped, region
    if at < len(html) and not state[0]:
        run.append(html[at:])
    end_block()
    return Blocks([Line(t, r) for t, r, share in lines if r >= 0 or share <= LINK_SHARE], levels, parents)


def shared_lines(a: list, b: list) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b`` (bit-parallel lengths,
    divided by halves, so the memory is linear)."""
    found: set[int] = set()

    def lengths(x: list, y: list) -> np.ndarray:
        """Common length of all x with each prefix of y."""
        match: dict = {}
        for j, v in enumerate(y):
            match[v] = match.get(v, 0) | 1 << j
        full = (1 << len(y)) - 1
        row = full
        for v in x:
            hit = row & match.get(v, 0)
            row = ((row + hit) | (row - hit)) & full
        bits = np.unpackbits(np.frombuffer((~row & full).to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")
        return np.concatenate([[0], np.cumsum(bits[: len(y)], dtype=np.int64)])

    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, n = todo.pop()
        while i < k and j < n and a[i] == b[j]:
            found.add(i)
            i, j = i + 1, j + 1
        while i < k and j < n and a[k - 1] == b[n - 1]:
            found.add(k - 1)
            k, n = k - 1, n - 1
        if i == k or j == n:
            continue
        if k - i == 1:
            if a[i] in b[j:n]:
                found.add(i)
            continue
        half = (i + k) // 2
        cut = j + int(np.argmax(lengths(a[i:half], b[j:n]) + lengths(a[half:k][::-1], b[j:n][::-1])[::-1]))
        todo += [(i, half, j, cut), (half, k, cut, n)]
    return found


def _nearness(a: str, b: str) -> tuple[int, int]:
    """Common leading parts of two paths, then common leading characters."""
    x, y = a.split("/"), b.split("/")
    parts = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    chars = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
    return parts, chars


def main_text(page: Page, before: Page | None, behind: Page | None) -> str:
    """The article: where the lines lie that the nearest neighbour does not share.

    Every page is differenced, with the lines of all its regions. Those of the template go
    before the regions are weighed. The lines of its own in a region make it the body, which is
    kept whole, as a passage of it may stand on two pages; where they are longer outside, they
    are the article themselves. A region the page itself marks gives way only if nothing in it
    is its own.
    """
    lines, levels, parents = page.blocks
    differenced = differences(page, before, behind)
    own = next(differenced, [True] * len(lines))
    template = template_regions(page, own, differenced)
    sizes = [0] * len(levels)
    for text, region in lines:
        if region >= 0 and not template[region]:
            sizes[region] += len(text)
    chosen = chosen_regions(levels, parents, sizes)
    inside = [r >= 0 and chosen[r] and not template[r] for _, r in lines]
    core = [text for (text, _), body in zip(lines, inside) if body]
    size = sum(map(len, core))
    left = [text for (text, r), mine in zip(lines, own) if mine and r < 0]
    marked = any(body and levels[r] < 3 for (_, r), body in zip(lines, inside))  # the page names one body; articles may be teasers
    found = marked and any(mine and body for mine, body in zip(own, inside))
    return " ".join(core if found or size and size >= sum(map(len, left)) else left)


def _own_regions(page: Page, own: list[bool]) -> list[bool]:
    """Which regions hold a line of the page's own, or a region inside does."""
    lines, levels, parents = page.blocks
    found = [False] * len(levels)
    for (_, region), mine in zip(lines, own):
        if mine and region >= 0:
            found[region] = True
    for r in range(len(levels) - 1, -1, -1):
        if found[r] and parents[r] >= 0:
            found[parents[r]] = True
    return found


def template_regions(page: Page, own: list[bool], further: Iterator[list[bool]]) -> list[bool]:
    """Which regions the nearest neighbour and a further one share whole."""
    found = _own_regions(page, own)
    if all(found) or (other := next(further, None)) is None:
        return [False] * len(found)
    return [not (a or b) for a, b in zip(found, _own_regions(page, other))]


def differences(page: Page, before: Page | None, behind: Page | None) -> Iterator[list[bool]]:
    """Which lines a neighbour does not share, for each that is no copy of the page, the nearest first."""
    near = [p for p in (before, behind) if p is not None and p.host == page.host]
    near.sort(key=lambda p: _nearness(page.path, p.path), reverse=True)
    texts = [x.text for x in page.blocks.lines]
    for other in near:
        shared = shared_lines(texts, [x.text for x in other.blocks.lines])
        if sum(len(texts[i]) for i in shared) <= COPY_SHARE * sum(map(len, texts)):
            yield [i not in shared for i in range(len(texts))]


def _extract(batches):
    before: Page | None = None  # the last page that differs from the waiting one
    waiting: Page | None = None
    same: list[tuple] = []  # pages that wait with it, of the same host and lines
    rows: list[tuple] = []

    def done(behind: Page | None) -> None:
        text = main_text(waiting, before, behind)
        rows.extend((page_id, url, text, len(text)) for page_id, url in same)

    for batch in batches:
        for page_id, url, host, path, html in zip(*(batch.column(i).to_pylist() for i in range(5))):
            page = Page(page_id, url, host, path, blocks(html or ""))
            if waiting and waiting[2:3] + waiting[4:] == page[2:3] + page[4:]:
                same.append((page_id, url))
                continue
            if waiting:
                done(page)
            before, waiting, same = waiting, page, [(page_id, url)]
        yield _table(rows)
        rows.clear()
    if waiting:
        done(None)
    yield _table(rows)


def _table(rows):
    columns = list(zip(*rows)) if rows else [()] * 4
    types = [pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in SCHEMA.split(", ")])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"),
        F.col("html").cast("string").alias("html"),
    )
    order = ["host", "path", "page_id", "url"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_extract, SCHEMA)
