"""Main text of web pages by composite text density.

Every element of the page's tree gets its characters per tag, adjusted for link
characters and link tags; the sum over an element's children tells bodies of text
from single lines. The subtree with the largest sum gives the threshold - the
least density on its path to the body - and every branch that reaches the
threshold adds its own largest-sum subtree. Menus, forms, adverts and the like are
cut out before, by element and by the words of class and id.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "page_id long, url string, text string, n_chars long"

#: Elements without content or end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Elements that are never main text.
SKIP = frozenset("head script style noscript template nav header footer aside form button select option textarea menu dialog iframe object svg math canvas audio video label fieldset input title noembed noframes".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset("address article blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: An element that opens closes an open one of these, if none of the others stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
#: Whole names of a class or id that mark what isn't the article: such words, with neutral ones or numbers at most beside them.
MARK = r"(?:ads?|advert[a-z]*|adbox|sponsor[a-z]*|promo[a-z]*|banner|sidebar|side|comments?|comment-?list|respond|replies|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend[a-z]*|breadcrumbs?|pagination|pager|menu|nav|navbar|navigation|footer|header|masthead|topbar|toolbar|widget|disclaimer|copyright|skip)"
NEUTRAL = r"(?:site|page|top|bottom|left|right|box|bar|area|block|container|wrapper|wrap|section|list|link|links|item|items|form|global|primary|secondary|[0-9]+)"
BOILERPLATE = re.compile(rf"(?:{NEUTRAL}[_-]+)*{MARK}(?:[_-]+(?:{MARK}|{NEUTRAL}))*", re.I)
#: Elements that may be wrapped around the article, and so aren't cut where they are.
AROUND = frozenset("nav header footer aside form button menu dialog label fieldset".split())
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|$))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+(?=>)|[^>]*)(?:>|$)|<[!?/][^>]*(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")


def attributes_of(source: str) -> dict[str, str]:
    """Names in lower case and their values; of a repeated name the first counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        value = m[2] or ""
        if value[:1] in "\"'":
            value = value[1:-1]
        out.setdefault(m[1].lower(), html.unescape(value))
    return out


def boilerplate(tag: str, source: str) -> int:
    """0: may be main text, 1: isn't unless the article is in it, 2: is never shown."""
    if tag in SKIP:
        return 1 if tag in AROUND else 2
    if not source or tag in ("html", "body", "article", "main"):
        return 0
    got = attributes_of(source)
    if "hidden" in got or re.search(r"(?:^|;)\s*display\s*:\s*none", got.get("style", ""), re.I):
        return 2
    if got.get("aria-hidden", "").strip().lower() == "true":
        return 1
    if any(BOILERPLATE.fullmatch(x) for k in ("class", "id") for x in got.get(k, "").split()):
        return 1
    return int(got.get("role", "").strip().lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"))


class Page:
    """The elements of one page, in order, and its pieces of text."""

    def __init__(self, source: str):
        self.tag, self.parent, self.cut = ["#root"], [-1], [False]
        #: (element, text, or None where a block begins or ends)
        self.text: list[tuple[int, str | None]] = []
        #: By element, what ``boilerplate`` says.
        self.mark = [0]
        self._parse(source)
        self._cut()

    def _parse(self, s: str) -> None:
        open_ = [0]
        at, end = 0, len(s)
        while at < end:
            lt = s.find("<", at)
            m = TOKEN.match(s, lt) if lt >= 0 else None
            while lt >= 0 and m is None:
                lt = s.find("<", lt + 1)
                m = TOKEN.match(s, lt) if lt >= 0 else None
            stop = lt if lt >= 0 else end
            if stop > at:
                self.text.append((open_[-1], s[at:stop]))
            if m is None:
                break
            at = m.end()
            if not m[2]:
                continue
            if not m[0].endswith(">"):
                break  # a tag that the page's end cuts off
            tag = m[2].lower()
            if m[1]:
                self._close(open_, tag)
                continue
            if tag in BLOCK:
                self._close_until(open_, {"p"}, {"button", "object", "table", "td", "th"})
            if tag in CLOSES:
                self._close_until(open_, *CLOSES[tag])
            k = len(self.tag)
            self.tag.append(tag)
            self.parent.append(open_[-1])
            self.cut.append(False)
            self.mark.append(boilerplate(tag, m[3]))
            if tag in BLOCK:
                self.text.append((k, None))
            elif tag == "br":
                self.text.append((open_[-1], " "))
            if tag in RAW:
                e = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(s, at)
                at = e.end() if e else end
            elif tag not in VOID:
                open_.append(k)

    def _cut(self) -> None:
        """Cut what is marked, but never what holds the article or most of the page's text.

        A nav or footer stays only for an article in it: on a short page it can be longest.
        """
        n = len(self.tag)
        never, linked, chars = [m == 2 for m in self.mark], [t == "a" for t in self.tag], [0] * n
        for k in range(1, n):
            p = self.parent[k]
            never[k], linked[k] = never[k] or never[p], linked[k] or linked[p]
        for k, t in self.text:
            if t and not never[k] and not linked[k]:
                chars[k] += len("".join(t.split()))
        for k in range(n - 1, 0, -1):
            chars[self.parent[k]] += chars[k]
        marked = [m > 0 for m in self.mark]
        for k in range(1, n):
            marked[k] = marked[k] or marked[self.parent[k]]
        keep = {k for k in range(1, n) if 2 * chars[k] > chars[0] and self.tag[k] not in ("nav", "footer")}
        # A header in an article holds its headline.
        inner, headed = [False] * n, [False] * n
        for k in range(1, n):
            p = self.parent[k]
            inner[k] = inner[p] or self.tag[p] == "article"
        for k in range(n - 1, 0, -1):
            headed[self.parent[k]] |= headed[k] or self.tag[k] in ("h1", "h2")
        keep |= {k for k in range(1, n) if self.tag[k] == "header" and inner[k] and headed[k]}
        # Articles outside of all marks are there anyway; else the longest one is kept.
        articles = [k for k in range(1, n) if self.tag[k] in ("article", "main") and chars[k]]
        if articles and all(marked[k] for k in articles):
            keep |= self._path(max(articles, key=lambda k: (chars[k], -k)))
        for k in range(1, n):
            self.cut[k] = self.cut[self.parent[k]] or self.mark[k] == 2 or self.mark[k] == 1 and k not in keep

    def _pop(self, open_: list[int], to: int) -> None:
        for k in open_[to:]:
            if self.tag[k] in BLOCK:
                self.text.append((self.parent[k], None))
        del open_[to:]

    def _close(self, open_: list[int], tag: str) -> None:
        for i in range(len(open_) - 1, 0, -1):
            name = self.tag[open_[i]]
            if name == tag:
                return self._pop(open_, i)
            if tag not in BLOCK and tag not in SKIP and name in BLOCK:
                return None  # an inline end tag doesn't end a block

    def _close_until(self, open_: list[int], names: set[str], bounds: set[str]) -> None:
        for i in range(len(open_) - 1, 0, -1):
            name = self.tag[open_[i]]
            if name in names:
                return self._pop(open_, i)
            if name in bounds:
                return None

    def densities(self) -> tuple[list[float], list[float]]:
        """Composite text density of each element, and the sum over its children."""
        n = len(self.tag)
        chars, tags, link_chars, link_tags, linked = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
        for k in range(1, n):
            linked[k] = linked[self.parent[k]] or self.tag[k] == "a"
        for k, t in self.text:
            if t and not self.cut[k]:
                c = len(t) - t.count(" ") - t.count("\n") if t.isspace() else len(t.strip())
                chars[k] += c
                link_chars[k] += c * linked[k]
        for k in range(n - 1, 0, -1):
            if self.cut[k]:
                continue
            p = self.parent[k]
            chars[p] += chars[k]
            link_chars[p] += link_chars[k]
            tags[p] += tags[k] + 1
            link_tags[p] += link_tags[k] + linked[k]
        density, total = [0.0] * n, [0.0] * n
        share = link_chars[0] / chars[0] if chars[0] else 0.0
        kids = [0] * n
        for k in range(n - 1, -1, -1):
            if chars[k] and not self.cut[k]:
                c, t, lc, lt = chars[k], tags[k] or 1, link_chars[k] or 1, link_tags[k] or 1
                base = math.log(c / ((c - link_chars[k]) or 1) * link_chars[k] + share * c + math.e)
                power = math.log(max(c / lc * (t / lt), 1.0)) / math.log(base) if base > 1.0 else math.log(max(c / lc * (t / lt), 1.0))
                density[k] = c / t * max(power, 0.01)
            if not kids[k]:
                total[k] = density[k]
            if k and not self.cut[k]:
                total[self.parent[k]] += density[k]
                kids[self.parent[k]] += 1
        return density, total

    def main_nodes(self) -> set[int]:
        """The roots of the subtrees that hold the main text."""
        density, total = self.densities()
        n = len(self.tag)
        body = next((k for k in range(n) if self.tag[k] == "body"), 0)
        if not any(density):
            return set()

        def best(of: int, last: int) -> int:
            return max((k for k in range(of, last) if not self.cut[k]), key=lambda k: (total[k], -k))

        ends = list(range(1, n + 1))
        for k in range(n - 1, 0, -1):
            ends[self.parent[k]] = max(ends[self.parent[k]], ends[k])
        if not density[body]:
            body = 0
        top = best(body, ends[body])
        threshold, k = density[top] or math.inf, top
        while k > body:
            k = self.parent[k]
            threshold = min(threshold, density[k])
        found, todo, path = set(), [body], self._path(top)
        kids: list[list[int]] = [[] for _ in range(n)]
        for k in range(1, n):
            kids[self.parent[k]].append(k)
        found.add(self._article(top))
        while todo:
            k = todo.pop()
            if self.cut[k] or k in found:
                continue
            todo += kids[k]
            if k != body and density[k] >= threshold and self.tag[k] in BLOCK and k not in path:
                found.add(best(k, ends[k]))
        return found

    def _path(self, k: int) -> set[int]:
        out = set()
        while k >= 0:
            out.add(k)
            k = self.parent[k]
        return out

    def _article(self, k: int) -> int:
        """The article or main element around an element, if there is one."""
        at, found = k, k
        while at > 0:
            if self.tag[at] in ("article", "main"):
                found = at
                if self.tag[at] == "article":
                    return at
            at = self.parent[at]
        return found

    def main_text(self) -> str:
        roots = self.main_nodes()
        inside = [False] * len(self.tag)
        for k in range(len(self.tag)):
            inside[k] = not self.cut[k] and (k in roots or k > 0 and inside[self.parent[k]])
        blocks, now = [], []
        for k, t in self.text:
            if t is None:
                blocks.append("".join(now))
                now = []
            elif inside[k]:
                now.append(t)
        blocks.append("".join(now))
        clean = (" ".join(html.unescape(b).split()) for b in blocks)
        return "\n".join(b for b in clean if b)


def extract_text(source: str | None) -> str:
    return Page(source).main_text() if source else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A null or empty page, or one without text, has the empty text; repeated rows
    give repeated rows; other columns aren't read. Any input parses: a tag that the
    page's end cuts off is dropped, a stray < is text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                b = batch.slice(part, 256)
                texts = [extract_text(h) for h in b.column(2).to_pylist()]
                rows = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(rows, names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(run, SCHEMA)
