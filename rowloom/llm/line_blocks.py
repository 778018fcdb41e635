"""Main text of web pages by line-block distribution.

Markup is stripped so that every block element is a line. Lines that belong to page furniture by
their element or its class, id or role (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles, reader comments) are empty, and each such element leaves a gap. Inside an
article only names that mean furniture alone decide; a block with another such name (related,
discussion, legal) is dropped if it is mostly links, or a label without prose. The
distribution is the sum of text lengths, links not counted, over windows of ``WINDOW`` lines. It
surges at a line with text whose window passes ``SURGE``, and dives where a window has sunk to
nothing; text between a surge and its dive is a candidate. Candidates are found so on every page,
and the one with most text decides. An article that the page names itself corrects the outcome:
its candidates count as one, it is taken as well where its text is near to that of a longer
candidate outside, and it is kept whole, within its own bounds; another article beside it is another text. On other pages the candidates of a
container (the innermost that holds most of each; siblings alike count as one) are joined before
their masses are compared. The heaviest container and those near to it in mass are kept, with all
lines of the container around them, so that furniture in between cuts nothing off.

Defined cases: a null or empty page, and a page of furniture only, gives the empty string; markup
that is never closed is closed by its ancestors; a page of any length is read whole, in one pass;
repeated rows give repeated results; of candidates or articles of equal mass the first decides; an empty table gives an empty result; only the id, url and
html columns are read.
"""

from __future__ import annotations

import heapq
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, SURGE, GAP = 3, 40, 3
#: Share of the largest candidate's text that another one needs to be kept as well.
NEAR = 0.35
#: A candidate belongs to the innermost container that holds this share of its text.
HOLDS = 0.8

#: Elements that are dropped with all that is in them, markup or not.
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math select canvas object audio video".split())
OPEN = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta nav ol option p pre search section summary table tbody td"
    " tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("div section article main td th center".split())
FURNITURE = frozenset("nav header footer aside form button fieldset dialog menu head label search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog form menu menubar toolbar alert".split())
#: Words of class and id names that mark furniture.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|notification\w*|alerts?|popup|modal|overlay"
    r"|nav\w*|menus?|breadcrumbs?|topbar|toolbar|masthead|header|site-?header|page-?header|footer|site-?footer|page-?footer|sidebars?|side|widgets?|aside|related|recommend\w*|trending"
    r"|popular|more-?stories|share|sharing|social|follow|subscribe|subscription|newsletter|signup|sign-?up|login|search|forms?|comments?|commentlist|disqus|discussion|replies|respond|reader-?comments?"
    r"|pagination|pager|tags?|tagcloud|copyright|legal|disclaimer|skip|skip-?link|skip-?nav|hidden|sr-?only|print-?only)(?=$|[\s_-])",
    re.I,
)
#: Inside an article: whole class and id names that are furniture whatever the text; other names are judged by it.
SURE = re.compile(
    r"(?:^|\s)(?:(?:article|post|entry|story|page|site|inline|top|bottom|left|right|mobile|google|dfp)[_-])*"
    r"(?:ads?|advert|adverts|advertisements?|advertorial|adsense|adslot|sponsored|promo|promoted|banner|cookies?|gdpr|popup|nav|navbar|navigation|breadcrumbs?|topbar|toolbar|masthead|sidebars?"
    r"|share|sharing|social|social-?media|subscribe|newsletter|signup|sign-up|login|comments?|commentlist|disqus|reader-?comments?|pagination|pager|tagcloud|skip-?link|skip-?nav|hidden|sr-?only|print-?only)"
    r"(?:[_-](?:ad|bar|block|box|btn|button|buttons|container|content|form|icons|iframe|inner|item|label|links?|list|media|notice|panel|section|slot|text|thread|unit|widget|wrap|wrapper|[0-9]+))*(?=$|\s)",
    re.I,
)
#: Whole names that are furniture where no prose is inside.
PLAIN = re.compile(
    r"(?:^|\s)(?:notices?|notification|alerts?|modal|overlay|menus?|header|footer|side|widgets?|aside|related|recommended|recommendations|trending|popular|more-?stories|follow|subscription|search|forms?"
    r"|discussion|replies|respond|tags?|copyright|legal|disclaimer|consent|sponsors?)(?:[_-](?:bar|box|buttons?|links?|list|posts|stories|us|widget))?(?=$|\s)",
    re.I,
)
SENTENCE = re.compile(r"[.!?:;\u2026\u3002\uff01\uff1f][\"'\u201d\u2019\u00bb)\]]*$")
#: What an element has or lacks says nothing of itself.
HAVING = re.compile(r"(?:has|have|is|no|not|with|without)[_-]", re.I)
MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|main|content)(?:[_-](?:body|content|text|main))?(?=$|\s)", re.I)
CLOSED_BY = {
    "p": BLOCKS - {"br", "button"},
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]), "head": frozenset(["body"]),
}


def reads_as_furniture(lines: list[tuple[str, int, int, int]], first: int, totals: list[tuple[int, int]], names: str) -> bool:
    """Whether a named block of an article, from line first on, looks like furniture: mostly links, or a label without prose."""
    for t, w, *_ in lines[len(totals) - 1 :]:
        totals.append((totals[-1][0] + len(t), totals[-1][1] + w))
    total, own = (totals[-1][k] - totals[first][k] for k in (0, 1))
    return own * 2 <= total or bool(PLAIN.search(names)) and own < SURGE and not any(SENTENCE.search(t) for t, w, *_ in lines[first:] if w)


class Line:
    __slots__ = ("parts", "linked", "inside", "home")

    def __init__(self, inside: int, home: int):
        self.parts: list[str] = []
        self.linked = 0
        self.inside = inside
        self.home = home


class Scanner:
    """Tags of a page, in one pass over it. A tag ends at the first > outside of quotes, or, where quotes never close or
    hold every > that follows, at the first one there is. What such a search has passed without finding an end isn't
    passed again: from there, no other one would find it."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.passed: set[int] = set()  # places outside of quotes from which no > follows

    def tag_end(self, at: int) -> int:
        page, last, own = self.page, self.last, []
        while (m := STOP.search(page, at, max(last.values()) + 1)) is not None:
            c = m[0]
            if c == ">":
                return m.start()
            if m.start() >= last[c]:
                break
            at = page.index(c, m.end()) + 1
            if at in self.passed:
                break
            own.append(at)
        self.passed.update(own)
        return -1

    def tags(self) -> Iterator[tuple[int, int, str, str, str]]:
        """(first, last + 1, "/" or "", name, attributes) of each tag; without a name, what is to be skipped."""
        page, at = self.page, 0
        while (i := page.find("<", at)) >= 0:
            at = i + 1
            m = OPEN.match(page, i + 1) if i < self.last[">"] else None
            if m:
                name, end = m[2].lower(), self.tag_end(m.end())
                whole = end >= 0
                if not whole:
                    end = page.index(">", m.end())
                at = end + 1
                if whole and name in RAW and not m[1]:
                    close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                    at = close.end() if close else len(page)
                    yield i, at, "", "", ""
                else:
                    yield i, at, m[1], name, page[m.end() : end]
            elif page.startswith("!--", i + 1):
                close = COMMENT_END.search(page, i + 4)
                at = close.end() if close else len(page)
                yield i, at, "", "", ""
            elif page[i + 1 : i + 2] in ("!", "?", "/") and page[i + 1 : i + 2]:
                end = page.find(">", i + 2)
                at = end + 1 if end >= 0 else len(page)
                yield i, at, "", "", ""


def furniture_name(names: str) -> bool:
    """Whether class and id names mean page furniture: one of them holds such a word, but not as what the element has or
    lacks (has-sidebar). A name of main text beside it (post, content) excuses loose words only."""
    marked = [n for n in names.split() if NAMES.search(n) and not HAVING.match(n)]
    if not marked:
        return False
    return any(SURE.search(n) for n in marked) or not any(MAIN_NAMES.search(n) and not NAMES.search(n) for n in names.split())


def lines_of(page: str) -> tuple[list[tuple[str, int, int, int]], list[int], list[tuple]]:
    """(text, weight, article, container) of each line, furniture leaving GAP empty lines; and of each
    container, 0 being the page, its parent and its kind, which siblings alike share."""
    out: list[tuple[str, int, int, int]] = []
    parents, kinds = [0], [()]
    # name, furniture, article number (0: none), link, container, and of a block in doubt: its first line, names
    stack: list[tuple[str, bool, int, bool, int, tuple[int, str] | None]] = []
    blocks: list[int] = []  # places of block elements in the stack
    open_: Counter = Counter()  # how many elements of a name are in it
    line = Line(0, 0)
    articles = 0
    totals = [(0, 0)]  # lengths and weights before each line, as far as they were asked for

    def end(inside: int, home: int) -> None:
        nonlocal line
        if line.parts:
            text = " ".join(entities.unescape("".join(line.parts)).split())
            if text:
                out.append((text, max(0, len(text) - line.linked), line.inside, line.home))
        line = Line(inside, home)

    def state() -> tuple[bool, int, bool, int]:
        return stack[-1][1:5] if stack else (False, 0, False, 0)

    def pop(n: int) -> None:
        nonlocal line
        was = state()
        block = any(s[0] in BLOCKS for s in stack[n:])
        doubts = [s[5] for s in stack[n:] if s[5]]
        open_.subtract(s[0] for s in stack[n:])
        del stack[n:]
        while blocks and blocks[-1] >= n:
            blocks.pop()
        now = state()
        if block or was[:2] != now[:2]:
            end(now[1], now[3])
        for first, names in reversed(doubts):
            if first < len(out) and reads_as_furniture(out, first, totals, names):
                out[first:] = [("", 0, now[1], 0)] * GAP
                del totals[first + 1 :]
        if was[0] and not now[0]:
            out.extend([("", 0, now[1], 0)] * GAP)

    def text(s: str) -> None:
        furniture, _, link, _ = state()
        if not furniture and s:
            line.parts.append(s)
            if link:
                line.linked += len(s.strip())

    at = 0
    for first, last, slash, name, attrs in Scanner(page).tags():
        if first > at:
            text(page[at:first])
        at = last
        if not name:
            continue
        if slash:
            if open_[name] > 0:
                n = len(stack) - 1
                while stack[n][0] != name:
                    n -= 1
                pop(n)
            elif name in BLOCKS:
                end(state()[1], state()[3])
            continue
        # Only blocks are closed by others, and only the innermost one.
        if blocks and name in CLOSED_BY.get(stack[blocks[-1]][0], ()):
            pop(blocks[-1])
        furniture, article, link, home = state()
        was, doubt = (furniture, article), None
        if attrs:
            known = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attrs)}
            names = f"{known.get('class', '')} {known.get('id', '')}".strip()
            role = known.get("role", "").lower()
            hidden = "hidden" in attrs and re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attrs) or re.search(r"display\s*:\s*none", known.get("style", ""), re.I) or known.get("aria-hidden") == "true"
        else:
            known, names, role, hidden = {}, "", "", None
        if name in ("article", "main") or role in ("main", "article") or known.get("itemprop") == "articleBody":
            if not furniture and not article:
                articles += 1
                article = articles
        elif name not in ("body", "html"):
            in_article_header = name == "header" and article
            named = names and not (name in HEADINGS and article) and furniture_name(names)
            if named and article and not SURE.search(names):
                # Ordinary sections bear such names too; blocks are judged when they end.
                doubt, named = (len(out), names) if name in BLOCKS and not furniture else None, None
            if (name in FURNITURE and not in_article_header) or role in ROLES or hidden or named:
                furniture, doubt = True, None
        if name == "a" and "href" in known:
            link = True
        opens = name not in VOID and not attrs.rstrip().endswith("/")
        if opens and name in CONTAINERS and not furniture:
            parents.append(home)
            kinds.append((home, name, names) if names or name == "section" else (len(kinds),))
            home = len(parents) - 1
        if name in BLOCKS:
            end(article, home)
        if doubt:
            doubt = len(out), doubt[1]
        if furniture and not was[0]:
            end(article, home)
            out.extend([("", 0, article, 0)] * GAP)
        elif article != was[1]:
            end(article, home)
        if opens:
            if name in BLOCKS:
                blocks.append(len(stack))
            open_[name] += 1
            stack.append((name, furniture, article, link, home, doubt))
    text(page[at:])
    pop(0)
    end(0, 0)
    return out, parents, kinds


def between(weights: list[int], surge: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """(first, last + 1) line of each stretch from a surge to its dive."""
    n, found, i = len(weights), [], 0
    sums = [sum(weights[j : j + window]) for j in range(n)]
    while i < n:
        if weights[i] and sums[i] > surge:
            j = i
            while j < n and sums[j] > 0:
                j += 1
            found.append((i, j))
            i = j
        i += 1
    return found


def innermost(held: dict[int, int], parents: list[int], share: float) -> int:
    """The innermost container with a share of what the given containers hold, each counted to all around it."""
    held, need = dict(held), share * sum(held.values())
    heap = [-c for c in held]
    heapq.heapify(heap)
    while heap:
        # Containers are numbered as they open: inner ones come first.
        c = -heapq.heappop(heap)
        if held[c] >= need or not c:
            return c
        if parents[c] not in held:
            held[parents[c]] = 0
            heapq.heappush(heap, -parents[c])
        held[parents[c]] += held[c]
    return 0


def main_text(page: str | None, tags: bool = True) -> str:
    """The main text of a page; without tags, as the windows alone find it."""
    if not page:
        return ""
    lines, parents, kinds = lines_of(page)
    if not tags:
        lines = [(t, w, 0, c) for t, w, _, c in lines]
    # Links count in an article, where they are part of the text.
    weights = [len(t) if a else w for t, w, a, _ in lines]
    stretches = between(weights, SURGE) or between(weights, 0)
    if not stretches:
        return ""
    own: dict[int, int] = {}
    for (_, _, a, _), w in zip(lines, weights, strict=True):
        if a:
            own[a] = own.get(a, 0) + w
    # What lies in one article, or outside in one container or those like it, counts together.
    mass: dict[tuple, int] = {}
    homes: list[int | None] = []
    for i, j in stretches:
        outside: dict[int, int] = {}
        for n in range(i, j):
            _, _, a, c = lines[n]
            if a:
                mass["article", a] = mass.get(("article", a), 0) + weights[n]
            elif weights[n]:
                outside[c] = outside.get(c, 0) + weights[n]
        homes.append(innermost(outside, parents, HOLDS) if outside else None)
        if outside:
            mass[kinds[homes[-1]]] = mass.get(kinds[homes[-1]], 0) + sum(outside.values())
    core = max(mass, key=lambda k: mass[k])  # the first of equals
    article = core[1] if core[:1] == ("article",) else 0
    if own and not article:
        longest = max(own, key=lambda a: (own[a], -a))
        article = longest if own[longest] >= NEAR * mass[core] else 0
    if article:
        # Corrected to the bounds of the page's own article.
        return " ".join(t for t, _, a, _ in lines if a == article and t)
    near = [(x, c) for x, c in zip(stretches, homes, strict=True) if c is not None and mass[kinds[c]] >= NEAR * mass[core]]
    main = {c: 1 for _, c in near}
    around = innermost(main, parents, 1)
    alike = {kinds[c] for c in main if c} | ({kinds[around]} if around else set())
    whole = [False] * len(parents)
    for c in range(1, len(parents)):
        whole[c] = kinds[c] in alike or whole[parents[c]]
    kept = [not a and whole[c] for _, _, a, c in lines]
    if 0 in main:
        # The page itself: its own lines, and all between the first and the last of its stretches.
        kept = [k or not a and not c for k, (_, _, a, c) in zip(kept, lines, strict=True)]
        near.append(((min(i for (i, _), c in near if not c), max(j for (_, j), c in near if not c)), 0))
    for (i, j), _ in near:
        kept[i:j] = [k or not a for k, (_, _, a, _) in zip(kept[i:j], lines[i:j], strict=True)]
    return " ".join(t for k, (t, *_) in zip(kept, lines, strict=True) if k and t)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(h) for h in b["html"]]
            yield b[["page_id", "url"]].assign(text=text, n_chars=[len(t) for t in text])

    return rows.mapInPandas(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
