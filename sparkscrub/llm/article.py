"""Main text of web pages by composite text density.

A page becomes a tree of blocks; inline elements count as tags of their block. Each
block's density is its characters per tag, scaled down where its text is mostly links.
The block whose children's densities add up to the most holds the article. The lowest
density on its path up to the body is the threshold for further parts of the page. What
stands with that block in one article or main element belongs to it, be it a title, a short
section or a byline; without such an element, what stands around it without noise or lists
of links does.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkscrub.llm.common import map_texts

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
# One attribute after the other, so that values are never taken for names.
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_SPACE = re.compile(r"\s+")

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike"
    " strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5"
    " h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
# An element that ends an open one of these names, up to the nearest list, table or the like.
ENDS = {
    "li": ("li",),
    "dd": ("dd", "dt"),
    "dt": ("dd", "dt"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
SCOPES = frozenset("ul ol dl table select html body article section div td th".split())

# What is no article text: by element, by role, and by words in class or id.
NOISE = frozenset(
    "head script style title noscript template nav footer aside form button select textarea iframe object svg math"
    " canvas audio video dialog menu noembed noframes xmp".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner cookie cookies"
    " consent gdpr notice notices notification popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs"
    " sidebar widget widgets footer masthead topbar toolbar comment comments disqus respond reply replies share sharing"
    " social related recommended recommendations newsletter subscribe subscription signup login search pagination pager"
    " paywall disclaimer skip".split()
)
ARTICLE_WORDS = frozenset("article entry post story content".split())
REPLY_WORDS = frozenset("comment comments disqus respond reply replies".split())
NEVER_NOISE = frozenset("html body article main".split())


def attributes_of(raw: str) -> dict[str, str]:
    """Attributes by name in lower case; the first of equal names counts."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(raw):
        if value[:1] in ("'", '"') and value[-1] == value[0]:
            value = value[1:-1]
        found.setdefault(name.lower(), value)
    return found


def noise_of(name: str, raw: str, in_article: bool) -> tuple[bool, set[str] | None]:
    """Whether an element is noise as it stands, and its class and id words if these speak for noise."""
    if name in NEVER_NOISE:
        return False, None
    if name in NOISE or (name == "header" and not in_article):
        return True, None
    if not raw.strip():
        return False, None
    attributes = attributes_of(raw)
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True, None
    if attributes.get("role", "").lower() in NOISE_ROLES:
        return True, None
    words = {w.lower() for a in ("class", "id") for w in _WORD.findall(attributes.get(a, ""))}
    doubt = words & NOISE_WORDS or ("header" in words and not in_article and not words & ARTICLE_WORDS)
    return False, words if doubt else None


class Page:
    """Blocks in page order; node 0 is the root."""

    def __init__(self, source: str):
        self.parent, self.noise = [-1], [False]
        self.tags, self.link_tags, self.chars, self.link_chars = [1], [0], [0], [0]
        self.texts: list[tuple[int, str]] = []
        # blocks whose class or id words speak for noise, article and main elements
        self.doubtful: dict[int, set[str]] = {}
        self.cores: dict[int, str] = {}
        # characters of the whole page, of links too, noise included
        self.all_chars, self.all_link_chars = 0, 0
        self._read(source)
        self._settle()

    def _read(self, source: str) -> None:
        # open elements: (name, block or None for inline)
        stack: list[tuple[str, int | None]] = [("", 0)]
        count: dict[str, int] = {}
        block, links, articles = 0, 0, 0
        held: list[str] = []

        def flush():
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                self.texts.append((block, text))

        def put(raw: str):
            held.append(raw)
            n = len(raw.strip())
            self.all_chars += n
            if links:
                self.all_link_chars += n
                self.link_chars[block] += n
            self.chars[block] += n

        def close():
            nonlocal block, links, articles
            name, own = stack.pop()
            count[name] -= 1
            if name == "a":
                links -= 1
            if name in ("article", "main"):
                articles -= 1
            if own is not None:
                flush()
                block = self.parent[own]

        at = 0
        while at < len(source):
            token = _TOKEN.search(source, at)
            if token is None:
                put(source[at:])
                break
            if token.start() > at:
                put(source[at : token.start()])
            at = token.end()
            name = (token[2] or token[5] or "").lower()
            if not name:
                continue
            if token[1] or token[4]:
                if count.get(name):
                    while stack[-1][0] != name:
                        close()
                    close()
                elif name == "br":
                    held.append(" ")
                continue
            attributes = token[3] or token[6] or ""
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\s*/?>", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            if name in CLOSES_P and count.get("p"):
                while stack[-1][0] != "p":
                    close()
                close()
            elif name in ENDS:
                for n in range(len(stack) - 1, 0, -1):
                    if stack[n][0] in SCOPES and stack[n][0] not in ENDS[name]:
                        break
                    if stack[n][0] in ENDS[name]:
                        while len(stack) > n:
                            close()
                        break
            noise, words = noise_of(name, attributes, articles > 0)
            if name in VOID:
                self.tags[block] += name != "br"
                held.append(" ")
                if name == "hr":
                    flush()
                continue
            own = None
            if name not in INLINE or noise or words:
                flush()
                own = len(self.parent)
                if words:
                    self.doubtful[own] = words
                if name in ("article", "main"):
                    self.cores[own] = name
                self.parent.append(block)
                self.noise.append(noise or self.noise[block])
                for values, value in ((self.tags, 1), (self.link_tags, 0), (self.chars, 0), (self.link_chars, 0)):
                    values.append(value)
                block = own
            else:
                self.tags[block] += 1
                self.link_tags[block] += name == "a"
            links += name == "a"
            articles += name in ("article", "main")
            stack.append((name, own))
            count[name] = count.get(name, 0) + 1
        while len(stack) > 1:
            close()
        flush()

    def _settle(self) -> None:
        """Blocks with words of noise become noise, unless they are wrappers of the main part of the page.

        A wrapper holds the longest article element, a main element, or more than half of
        the text: of that article if it stands in it, else of the page.
        """
        if not self.doubtful:
            return
        n = len(self.parent)
        size = list(self.chars)
        for i in range(n - 1, 0, -1):
            if not self.noise[i]:
                size[self.parent[i]] += size[i]
        cores = [i for i in self.cores if not self.noise[i] and size[i]]
        core = max(cores, key=lambda i: (self.cores[i] == "article", size[i], -i), default=0)
        around, inside = [False] * n, [False] * n
        for i in cores:
            around[i] = i == core or self.cores[i] == "main"
        for i in range(n - 1, 0, -1):
            around[self.parent[i]] |= around[i]
        for i in range(1, n):
            p = self.parent[i]
            inside[i] = p == core or inside[p]
            words = self.doubtful.get(i)
            wrapper = words is None or around[i]
            if not wrapper and 2 * size[i] > size[core if inside[i] else 0]:
                # Beside an article element, much text of readers is still theirs.
                wrapper = not core or bool(words & ARTICLE_WORDS) or (inside[i] and not words & REPLY_WORDS)
            self.noise[i] = self.noise[i] or self.noise[p] or not wrapper

    def densities(self) -> tuple[list[float], list[float]]:
        """Composite density of each block, and the sum over its child blocks (its own without any)."""
        n = len(self.parent)
        tags, link_tags, chars, links = (list(x) for x in (self.tags, self.link_tags, self.chars, self.link_chars))
        for i in range(n - 1, 0, -1):
            if not self.noise[i]:
                p = self.parent[i]
                tags[p] += tags[i]
                link_tags[p] += link_tags[i]
                chars[p] += chars[i]
                links[p] += links[i]
        share = self.all_link_chars / max(1, self.all_chars)
        density, total, leaf = [0.0] * n, [0.0] * n, [True] * n
        for i in range(n - 1, -1, -1):
            c, lc = chars[i], links[i]
            if c and not self.noise[i]:
                base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
                value = c / max(1, lc) * tags[i] / max(1, link_tags[i])
                density[i] = c / tags[i] * math.log(max(value, 1.0) + 1.0) / max(math.log(base), 0.1)
            if leaf[i]:
                total[i] = density[i]
            if i and not self.noise[i]:
                p = self.parent[i]
                leaf[p] = False
                total[p] += density[i]
        return density, total

    def _around(self, best: int) -> int:
        """The block around ``best`` that is the article as a whole."""
        path = [best]
        while path[-1] > 0:
            path.append(self.parent[path[-1]])
        for name in ("article", "main"):
            for i in path:
                if self.cores.get(i) == name:
                    return i
        n = len(self.parent)
        chars, links, noisy = list(self.chars), list(self.link_chars), list(self.noise)
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            noisy[p] = noisy[p] or noisy[i]
            if not self.noise[i]:
                chars[p] += chars[i]
                links[p] += links[i]
        # The other children of a block: noise in them, characters, link characters.
        troubled = [0] * n
        for i in range(1, n):
            troubled[self.parent[i]] += noisy[i]
        own = best
        for p in path[1:]:
            more, linked = chars[p] - chars[own], links[p] - links[own]
            if p == 0 or troubled[p] > noisy[own] or 3 * linked > more:
                break
            own = p
        return own

    def article(self) -> str:
        density, total = self.densities()
        n = len(self.parent)
        best = max(range(n), key=lambda i: (total[i], -i))
        if total[best] <= 0:
            return ""
        threshold, node = density[best], best
        while node > 0:
            node = self.parent[node]
            threshold = min(threshold, density[node])
        # the block of largest sum within each subtree, the outer one of equals
        inside = list(range(n))
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            if not self.noise[i] and total[inside[i]] > total[inside[p]]:
                inside[p] = inside[i]
        chosen = [False] * n
        for i in range(n):
            if not self.noise[i] and density[i] >= threshold and density[i] > 0:
                chosen[inside[i]] = True
        chosen[self._around(best)] = True
        for i in range(1, n):
            chosen[i] = not self.noise[i] and (chosen[i] or chosen[self.parent[i]])
        return " ".join(text for i, text in self.texts if chosen[i])


def article_text(source: str) -> str:
    """The main text of a page, blocks joined by one space; empty if there is none."""
    return Page(source).article() if source.strip() else ""


def extract_articles(df: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``key``, kept columns, ``text`` and ``n_chars`` for every row.

    Character references are decoded, white space inside a block is one space, blocks
    follow in page order. Tags may be left open, also at the end of the page.

    A null or empty page has an empty text. Null keys and repeated rows stay rows of
    their own; an empty table gives an empty result; other columns are not read.
    """

    def make():
        def compute(pages):
            texts = [article_text(p) for p in pages]
            return [(t, len(t)) for t in texts]

        return compute

    fields = [("text", T.StringType()), ("n_chars", T.LongType())]
    return map_texts(df, make, fields, key, html, keep)
