"""Main text of web pages: boosted trees over DOM nodes, decoded down the tree.

A page is read by a forgiving tokenizer into a tree of elements.  Each node has
features: its tag's group, what its class, id and role words hint at, the same
for its ancestors, depth, density of text and links below it, its share of the
page, and how it compares with its siblings.  Boosted trees give each node the
probabilities of three roles: AROUND (an ancestor of the article), CONTENT and
BOILER.  The roles of a page are then chosen together: the likeliest assignment
in which everything below BOILER is BOILER and nothing below CONTENT is AROUND,
so no node contradicts its ancestors.

The trees are trained here, on pages that :func:`sample_page` composes with
known roles from a seed; no page of the input is used.

Defined results: null html is an empty page; a page without content gives an
empty text; rows may repeat; null ids and urls are passed on; other columns are
ignored; an empty table gives no rows.  White space is what str.split takes.  A
line break inside a block is white space; table rows are blocks, their cells
are set apart by a space.  References are decoded within one run of text, never
across markup.  A tag whose quote is never closed ends at its first ``>``; a tag
that is never closed takes the rest of the page, as in browsers.  MathML and the
fallbacks of embedded media are text; drawings, templates and raw elements are
not.  Reading takes time linear in the page, however its tags are broken.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from korvid.llm.boost import Boosted
from korvid.llm.common import pieces

AROUND, CONTENT, BOILER = 0, 1, 2
NEVER = -1e9

# Element names of HTML by how they are read, and hint words by topic.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Not shown either, but parsed as markup: without an end tag only the tag itself goes.
UNSEEN = frozenset("template svg annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var nobr".split()) | frozenset(
    "canvas object video audio math merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms msqrt mstyle msub msubsup msup mtext munder munderover semantics".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"},
}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}, "body": set()}
GROUPS = {
    "article": "article", "main": "main", "nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "section": "section", "div": "div",
    "p": "p", "h1": "h1", "h2": "h2", "h3": "h2", "h4": "h2", "h5": "h2", "h6": "h2", "ul": "ul", "ol": "ul", "dl": "ul", "li": "li", "dt": "li", "dd": "li",
    "form": "form", "fieldset": "form", "select": "form", "datalist": "form", "option": "form", "optgroup": "form", "button": "form", "label": "form", "legend": "form", "input": "form", "table": "table", "thead": "table", "tbody": "table", "tr": "table",
    "td": "table", "th": "table", "figure": "figure", "figcaption": "figure", "blockquote": "quote", "pre": "quote", "a": "a", "html": "root", "body": "root", "head": "head", "dialog": "aside", "address": "footer",
}
GROUP_NAMES = sorted(set(GROUPS.values())) + ["span", "other"]
HINTS = {
    "text": "article articlebody body content entry main post story text prose copy page lead paragraph maincontent readable",
    "nav": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager tabs toc skip topbar dropdown",
    "ad": "ad ads adv advert advertisement adsense banner promo promoted sponsor sponsored adbox adslot teaser commercial",
    "comment": "comment comments commentlist disqus discussion replies reply respond responses reader",
    "foot": "footer foot copyright legal colophon bottom site-info imprint",
    "head": "header head masthead logo brand top hero site-title",
    "side": "sidebar side aside widget related recommended recommendations popular trending more rail right left secondary",
    "notice": "cookie cookies consent notice notices gdpr alert popup modal overlay newsletter subscribe subscription signup paywall toast warning",
    "share": "share sharing social follow like tweet facebook author byline meta tags tag date bio published",
    "form": "form search login signin register contact input field",
    "hidden": "hidden invisible sr-only visually-hidden screen-reader-text",
}
HINT_OF = {w: k for k, (_, ws) in enumerate(HINTS.items()) for w in ws.split()}
HIDDEN = list(HINTS).index("hidden")



def _token(quotes: str) -> re.Pattern:
    """Comments, tags and declarations; a tag ends at a ``>`` outside ``quotes``, at a quote without its pair, or with the page."""
    inside = "".join(f"|{q}[^{q}]*{q}" for q in quotes)
    return re.compile(rf"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>{quotes}]{inside})*+)(>|\Z{'|[' + quotes + ']' if quotes else ''})|<[!?/][^>]*>?", re.S)


#: By the quotes that still have pairs ahead.
TOKENS = {q: _token(q) for q in ("\"'", "\"", "'", "")}
ATTR = re.compile(r"([^\s=\"'/>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


def hints(attrs: str) -> tuple[int, str | None]:
    """Hint bits of an element's class, id, role and visibility; and its label in training pages."""
    bits, label = 0, None
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role", "itemprop"):
            for word in value.split():
                for w in (word.lower(), *(p.lower() for p in PART.findall(word))):
                    if w in HINT_OF:
                        bits |= 1 << HINT_OF[w]
            if name == "role":
                bits |= {"navigation": 1 << 1, "banner": 1 << 5, "contentinfo": 1 << 4, "complementary": 1 << 6, "main": 1, "article": 1, "search": 1 << 9, "dialog": 1 << 7, "alert": 1 << 7}.get(value.lower(), 0)
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) or name == "aria-hidden" and value == "true":
            bits |= 1 << HIDDEN
        elif name == "data-role-known":
            label = value
    if re.search(r"(?:^|\s)hidden(?:\s|/|$)", re.sub(r"=\s*(\"[^\"]*\"|'[^']*')", "", attrs)):
        bits |= 1 << HIDDEN
    return bits, label


class Open:
    """The open elements, outermost first, with the places of each tag."""

    def __init__(self):
        self.tags, self.nodes, self.at, self.floors = ["#root"], [0], {}, [0]

    def push(self, tag: str, node: int) -> None:
        self.at.setdefault(tag, []).append(len(self.tags))
        if tag not in INLINE:
            self.floors.append(len(self.tags))
        self.tags.append(tag)
        self.nodes.append(node)

    def cut(self, k: int) -> None:
        """Close element ``k`` and all inside it."""
        while len(self.tags) > k:
            self.nodes.pop()
            self.at[self.tags.pop()].pop()
            if self.floors[-1] == len(self.tags):
                self.floors.pop()

    def end(self, tag: str) -> None:
        """An end tag closes the innermost element of its name; an inline one only inside the innermost block."""
        where = self.at.get(tag)
        if where and (tag not in INLINE or where[-1] > self.floors[-1]):
            self.cut(where[-1])

    def imply(self, tag: str) -> None:
        """Close what the start of ``tag`` closes: an open paragraph, list item, cell or row."""
        if self.tags[self.floors[-1]] == "p":
            self.cut(self.floors[-1])
        if tag in CLOSES:
            stop = max((w[-1] for x in STOPS[tag] if (w := self.at.get(x))), default=0)
            low = [w[i] for x in CLOSES[tag] if (w := self.at.get(x)) and (i := bisect_right(w, stop)) < len(w)]
            if low:
                self.cut(min(low))


class Page:
    """Nodes in page order (parents first) and the text chunks that belong to them."""

    def __init__(self, source: str):
        self.tag, self.parent, self.bits, self.label = ["#root"], [-1], [0], [None]
        self.chunks: list[tuple[int, str, int, bool]] = []  # node, text, block, inside a link
        stack, block, link, at, quotes, ends = Open(), 0, 0, 0, "\"'", {}
        while True:
            m = TOKENS[quotes].search(source, at)
            text = source[at : m.start() if m else len(source)]
            if text:
                self.chunks.append((stack.nodes[-1], text, block, link > 0))
            if not m:
                break
            at = m.end()
            if m[2] is None:
                continue
            tag, attrs = m[2].lower(), m[3]
            if m[4] in ("\"", "'"):
                # No pair for this quote ahead: it no longer counts, and the tag is read again without it.
                quotes, at = quotes.replace(m[4], ""), m.start()
                continue
            if not m[4]:
                break
            if m[1]:
                if tag == "a":
                    link = 0
                stack.end(tag)
                if tag not in INLINE:
                    block += 1
                    link = 0
                continue
            if tag in VOID:
                if tag == "hr":
                    block += 1
                elif tag == "br":
                    self.chunks.append((stack.nodes[-1], " ", block, False))
                continue
            if tag in RAW or tag in UNSEEN and not attrs.endswith("/"):
                if ends.get(tag, 0) is not None:
                    end = ends[tag] = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                    at = end.end() if end else at
                if ends[tag] is None and tag in RAW:
                    break
                continue
            if tag in INLINE:
                link += tag == "a"
                if "=" not in attrs and "hidden" not in attrs:
                    continue
                bits, label = hints(attrs)
                if not bits and label is None:
                    continue
                stack.push(tag, self._add(tag, stack.nodes[-1], bits, label))
                continue
            stack.imply(tag)
            if tag in ("td", "th"):
                self.chunks.append((stack.nodes[-1], " ", block, False))
            else:
                block += 1
            link = 0
            bits, label = hints(attrs) if attrs else (0, None)
            stack.push(tag, self._add(tag, stack.nodes[-1], bits, label))

    def _add(self, tag: str, parent: int, bits: int, label: str | None) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.bits.append(bits)
        self.label.append(label)
        return len(self.tag) - 1

    def features(self) -> np.ndarray:
        """One row for each node."""
        n = len(self.tag)
        length, links, marks, chunks = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
        before, seen = [None] * n, 0.0
        for node, text, _, in_link in self.chunks:
            k = len(text) - text.count(" ") if text.strip() else 0
            if not k:
                continue
            if before[node] is None:
                before[node] = seen
            seen += k
            length[node] += k
            chunks[node] += 1
            if in_link:
                links[node] += k
            marks[node] += text.count(".") + text.count(",")
        own = length[:]
        depth, tags, kids, paras, items = [0] * n, [1.0] * n, [0.0] * n, [0.0] * n, [0.0] * n
        parent, above = self.parent, [0] * n
        groups = [GROUPS.get(t, "span" if t in INLINE else "other") for t in self.tag]
        code = [GROUP_NAMES.index(g) for g in groups]
        tops = [0] * n
        for i in range(1, n):
            p = parent[i]
            depth[i] = depth[p] + 1
            above[i] = above[p] | self.bits[p]
            tops[i] = tops[p] | 1 << code[p]
            kids[p] += 1
        for i in range(n - 1, 0, -1):
            p = parent[i]
            length[p] += length[i]
            links[p] += links[i]
            marks[p] += marks[i]
            tags[p] += tags[i]
            paras[p] += paras[i] + (groups[i] == "p")
            items[p] += items[i] + (groups[i] == "li")
            if before[i] is not None and (before[p] is None or before[i] < before[p]):
                before[p] = before[i]
        rank, most = [0.0] * n, [0.0] * n
        met = [0.0] * n
        for i in range(1, n):
            rank[i] = met[parent[i]]
            met[parent[i]] += 1
            most[parent[i]] = max(most[parent[i]], length[i])
        total = max(1.0, length[0])
        out = np.zeros((n, 18 + 2 * len(HINTS) + len(GROUP_NAMES) + 8))
        num = np.array([depth, tags, kids, paras, items, rank, length, own, links, marks], float)
        par = np.maximum(np.array(parent), 0)
        out[:, :10] = np.log1p(num).T
        out[:, 8] = num[8] / np.maximum(num[6], 1)
        out[:, 9] = num[9] / np.maximum(num[6], 1) * 100
        out[:, 10] = num[6] / total
        out[:, 11] = num[6] / num[1]
        out[:, 12] = np.array([total if x is None else x for x in before]) / total
        out[:, 13] = num[6] / np.maximum(num[6][par], 1)
        out[:, 14] = num[6] / np.maximum(np.array(most)[par], 1)
        out[:, 15] = num[5] / np.maximum(num[2][par], 1)
        out[:, 16] = out[par, 8]
        out[:, 17] = out[par, 10]
        bits, tops_, at = np.array(self.bits), np.array(above), 18
        for k in range(len(HINTS)):
            out[:, at + k] = bits >> k & 1
            out[:, at + len(HINTS) + k] = tops_ >> k & 1
        at += 2 * len(HINTS)
        out[np.arange(n), at + np.array(code)] = 1
        at += len(GROUP_NAMES)
        anc = np.array(tops)
        for k, g in enumerate(("article", "main", "nav", "header", "footer", "aside", "form", "section")):
            out[:, at + k] = anc >> GROUP_NAMES.index(g) & 1
        return out

    def text(self, role: np.ndarray) -> str:
        """Kept blocks in page order."""
        blocks, last, parts = [], None, []
        for node, text, block, _ in self.chunks:
            if role[node] != CONTENT:
                continue
            if block != last:
                blocks.append("".join(parts))
                parts, last = [], block
            parts.append(unescape(text))
        blocks.append("".join(parts))
        clean = (" ".join(b.split()) for b in blocks)
        return "\n\n".join(b for b in clean if b)


def decode(parent: list[int], logp: np.ndarray) -> np.ndarray:
    """The likeliest roles that do not contradict: below BOILER only BOILER, below CONTENT no AROUND."""
    n = len(parent)
    best = logp.copy()  # of the subtree, given the node's own role
    pick = np.zeros((n, 3), np.int64)  # a child's best role given its parent's role
    best[0] = (0.0, NEVER, NEVER)
    table = best.tolist()
    choice = pick.tolist()
    for i in range(n - 1, 0, -1):
        a, c, b = table[i]
        choice[i][BOILER] = BOILER
        choice[i][CONTENT] = CONTENT if c >= b else BOILER
        top = max(a, c, b)
        choice[i][AROUND] = AROUND if top == a else CONTENT if top == c else BOILER
        up = table[parent[i]]
        up[AROUND] += top
        up[CONTENT] += max(c, b)
        up[BOILER] += b
    role = np.zeros(n, np.int64)
    for i in range(1, n):
        role[i] = choice[i][role[parent[i]]]
    return role


# Training pages.


def _words(r: random.Random, n: int) -> str:
    parts = ("an", "er", "on", "st", "re", "le", "que", "ung", "ción", "the", "de", "und", "ti", "or", "ba", "mi", "ker", "lo", "sa", "ne")
    style = r.random()
    out = []
    for _ in range(n):
        w = "".join(r.choice(parts) for _ in range(r.randint(1, 4)))
        if style < 0.06:
            w = w.upper() + "!!"
        elif style < 0.12:
            w += r.choice(("***", "$$$", "###", "&amp;&amp;"))
        elif style < 0.16:
            w += " |"
        if r.random() < 0.12:
            w += r.choice((".", ",", ".", ";"))
        out.append(w)
    if style > 0.94:
        out = [out[0]] * n
    return " ".join(out).capitalize()


def sample_page(r: random.Random) -> str:
    """One page with the role of its elements in ``data-role-known``."""

    def el(tag, role, inner, cls=""):
        end = "" if tag in ("p", "li") and r.random() < 0.15 else f"</{tag}>"
        return f'<{tag}{f" class={chr(34)}{cls}{chr(34)}" if cls else ""} data-role-known="{role}">{inner}{end}'

    def links(n, role):
        return el("ul", role, "".join(el("li", role, f'<a href="/x">{_words(r, r.randint(1, 3))}</a>') for _ in range(n)))

    def boiler(kind):
        few = _words(r, r.randint(2, 25))
        pick = r.choice
        if kind == "nav":
            return el(pick(("nav", "nav", "div", "ul")), 2, links(r.randint(3, 12), 2), pick(("", "nav", "menu", "main-menu", "breadcrumbs")))
        if kind == "head":
            return el(pick(("header", "header", "div")), 2, pick((el("h1", 2, _words(r, 2)), el("div", 2, few), few)) + pick(("", boiler("nav"))), pick(("", "site-header", "masthead", "header")))
        if kind == "foot":
            return el(pick(("footer", "footer", "div")), 2, pick((few, el("p", 2, "&copy; " + few), links(3, 2))), pick(("", "footer", "site-footer", "copyright")))
        if kind == "ad":
            return el(pick(("div", "aside", "section")), 2, pick((few, el("p", 2, few), f'<a href="x">{few}</a>')), pick(("ad", "ads", "advert", "sponsored", "ad-banner", "promo", "adsense")))
        if kind == "side":
            inner = el(pick(("h2", "h3")), 2, _words(r, 2)) + pick((links(r.randint(2, 6), 2), el("p", 2, _words(r, r.randint(5, 60)))))
            return el(pick(("aside", "aside", "div")), 2, inner, pick(("", "sidebar", "related", "widget popular", "side")))
        if kind == "notice":
            return el(pick(("div", "section", "dialog")), 2, el("p", 2, few) + pick(("", "<button>ok</button>")), pick(("cookie-notice", "consent", "notice", "popup newsletter", "gdpr-banner", "alert")))
        if kind == "form":
            return el("form", 2, pick((few, el("p", 2, few), f"<label>{few}</label>")) + "<input name=q><button>go</button>", pick(("", "search", "subscribe", "login")))
        if kind == "comments":
            one = lambda: el(pick(("div", "li", "article", "p")), 2, pick((_words(r, r.randint(3, 50)), el("p", 2, _words(r, r.randint(3, 50))))), pick(("comment", "comment-body", "reply", "")))
            return el(pick(("section", "div", "ol")), 2, pick(("", el("h3", 2, _words(r, 1)))) + "".join(one() for _ in range(r.randint(1, 6))), pick(("comments", "comment-list", "discussion comments", "reader-comments")))
        return el(pick(("div", "p", "ul")), 2, few, pick(("share", "social-share", "byline", "meta", "tags", "author-bio", "post-meta")))

    def body():
        out = [el("h1", 1, _words(r, r.randint(1, 12)))] if r.random() < 0.75 else []
        if out and r.random() < 0.15:
            out = [el("header", 1, out[0] + (boiler("share") if r.random() < 0.5 else ""))]
        for _ in range(r.choice((1, 1, 2, 3, 4, 6, 9, 14, 25))):
            x, n = r.random(), r.choice((1, 2, 5, 20, 50, 90, 150))
            if x < 0.72:
                out.append(el("p", 1, r.choice(("", "", "<b>")) + _words(r, n) + r.choice(("", "", "<br>", " <a href=y>" + _words(r, 2) + "</a> " + _words(r, 3)))))
            elif x < 0.78:
                out.append(el(r.choice(("h2", "h3")), 1, _words(r, r.randint(1, 7))))
            elif x < 0.83:
                out.append(el("ul", 1, "".join(el("li", 1, _words(r, r.randint(2, 20))) for _ in range(r.randint(2, 6)))))
            elif x < 0.87:
                out.append(el("blockquote", 1, el("p", 1, _words(r, n))))
            elif x < 0.89:
                out.append(el("pre", 1, _words(r, n)))
            elif x < 0.91:
                out.append(el("table", 1, "".join(el("tr", 1, el("td", 1, _words(r, 2)) + el("td", 1, _words(r, 2))) for _ in range(3))))
            elif x < 0.93:
                out.append(el("figure", 1, el("figcaption", 1, _words(r, 6))))
            elif x < 0.96:
                out.append(_words(r, n))
            else:
                out.append(boiler(r.choice(("ad", "share", "ad", "form", "side", "notice"))))
        return "".join(out)

    form = r.random()
    if form < 0.5:
        art = el("article", 1, body(), r.choice(("", "", "post", "entry")))
    elif form < 0.62:
        art = el("main", 1, body())
    elif form < 0.9:
        art = el(r.choice(("div", "section", "div")), 1, body(), r.choice(("content", "post-content", "entry-content", "article-body", "story", "main-content", "text")))
    else:
        art = el(r.choice(("div", "section")), 1, body())
    around = [boiler(k) for k in ("nav", "head", "ad", "notice", "form") if r.random() < 0.45]
    after = [boiler(k) for k in ("side", "comments", "ad", "foot", "notice", "nav", "share", "form") if r.random() < 0.4]
    if form >= 0.9:
        around, after = around or [boiler("nav")], after or [boiler("foot")]
    r.shuffle(around)
    inside = r.random()
    if inside < 0.3:
        keep = [after.pop(0)] if after and r.random() < 0.5 else []
        art = el(r.choice(("main", "div", "div")), 0, art + "".join(keep), r.choice(("", "container", "wrapper", "page", "layout", "row")))
    if inside < 0.1:
        art = el("div", 0, art, r.choice(("", "site", "outer")))
    return f'<!DOCTYPE html><html data-role-known="0"><head data-role-known="2"><title>{_words(r, 4)}</title></head><body data-role-known="0">' + "".join(around) + art + "".join(after) + "</body></html>"


@lru_cache(1)
def model(pages: int = 500, seed: int = 11) -> Boosted:
    """Trees fitted to ``pages`` composed pages; the same seed gives the same trees."""
    r, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        page = Page(sample_page(r))
        known = [k for k, x in enumerate(page.label) if x is not None]
        xs.append(page.features()[known])
        ys += [int(page.label[k]) for k in known]
    return Boosted(3).fit(np.vstack(xs), np.array(ys))


def main_texts(sources: list[str], trees: Boosted) -> list[str]:
    """The main text of each page."""
    pages = [Page(s) for s in sources]
    feats = [p.features() for p in pages]
    if not pages:
        return []
    logp = np.maximum(trees.log_probability(np.vstack(feats)), -20)
    out, at = [], 0
    for p, f in zip(pages, feats):
        out.append(p.text(decode(p.parent, logp[at : at + len(f)])))
        at += len(f)
    return out


def extract(pages_df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", trees: Boosted | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row."""
    fitted = trees or model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "html", 1 << 20):
                texts = main_texts([x.as_py() or "" for x in batch.column("html")], fitted)
                cols = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    return pages_df.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS page_id", f"CAST(`{url_col}` AS STRING) AS url", f"CAST(`{html_col}` AS STRING) AS html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
