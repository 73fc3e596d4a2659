"""HTML main-text extraction: a linear-chain conditional random field labels a page's DOM
leaf blocks as main text or not, from their ancestors' tags and names and from text
features; Viterbi decoding picks the blocks, which are joined in page order.

A leaf block is a run of text that no block-level tag interrupts; inline tags and line
breaks do not end it. The block walk keeps a stack of open elements, closes paragraphs,
list items and table parts that are left open, ignores end tags without a start, and skips
comments, scripts, styles and other elements without text of their own.

The field is trained on ``TRAIN_PAGES`` labelled pages drawn from layouts: every page puts
an article in one of several containers among menus, headers, footers, sidebars, notices,
adverts, forms and comments with common tags and class names, each part being known to be
main text or not. Words are random on both sides, so what is learned is structure.

Defined results: a null or empty page, or one without a main block, gives the empty text;
text after unclosed or malformed tags is still read; the whole page is used whatever its
length; repeated rows get equal answers; clashing input columns are replaced.
"""

from __future__ import annotations

import html as entities
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskengine.llm.common import fresh, with_result
from riskengine.llm.crf import MAIN, OTHER, LinearChain

TRAIN_PAGES = 600
TRAIN_SEED = 11

# Kinds of elements in HTML.
SILENT = {"script", "style", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike",
          "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
# An open element of a key ends where one of its values begins.
CLOSED_BY = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
             "th": {"td", "th", "tr"}, "option": {"option"}}

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
LETTERS = re.compile(r"[a-z]+")


class Block:
    """A leaf block: text, nearest block-level tag, features of its open elements, share of link text."""

    __slots__ = ("text", "own", "within", "linked")

    def __init__(self, text, own, within, linked):
        self.text, self.own, self.within, self.linked = text, own, within, linked


class _Open:
    """An open element. A block-level one holds the features of itself and of those around it, in a set
    that it shares with the one around it where it adds none; an inline one holds its own."""

    __slots__ = ("tag", "feats", "inline", "closed")

    def __init__(self, tag, feats, inline):
        self.tag, self.feats, self.inline, self.closed = tag, feats, inline, False


class _Elements:
    """The stack of open elements. Every step costs its own elements, however many are open: the
    places of each tag are kept apart, and an inline element that ends below others is only marked."""

    def __init__(self, known):
        self.known = known
        self.stack: list[_Open] = []
        self.blocks: list[_Open] = []
        self.places: dict[str, list[int]] = {}
        self.barriers: list[int] = []        # places of block-level elements that only their end tag ends
        self.inline: dict[str, int] = {}     # features of open inline elements, counted

    def own(self) -> str:
        return self.blocks[-1].tag if self.blocks else ""

    def within(self) -> frozenset:
        feats = self.blocks[-1].feats if self.blocks else frozenset()
        return feats.union(self.inline) if self.inline else feats

    def links(self) -> bool:
        return bool(self.places.get("a"))

    def open(self, tag: str, names: list[str]):
        inline = tag in INLINE
        feats = {"name=" + n for n in names} | (set() if inline else {"in=" + tag})
        if self.known is not None:
            feats &= self.known
        if inline:
            for f in feats:
                self.inline[f] = self.inline.get(f, 0) + 1
        else:
            around = self.blocks[-1].feats if self.blocks else frozenset()
            feats = around if feats <= around else around | feats
        one = _Open(tag, feats, inline)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(one)
        if not inline:
            self.blocks.append(one)
            if tag not in CLOSED_BY:
                self.barriers.append(len(self.stack) - 1)

    def _end(self, one: _Open):
        self.places[one.tag].pop()
        one.closed = True
        if not one.inline:
            self.blocks.pop()
            if one.tag not in CLOSED_BY:
                self.barriers.pop()
            return
        for f in one.feats:
            self.inline[f] -= 1
            if not self.inline[f]:
                del self.inline[f]

    def cut(self, place: int):
        """Ends the element at this place and all above it."""
        while len(self.stack) > place:
            one = self.stack.pop()
            if not one.closed:
                self._end(one)

    def close(self, tag: str):
        places = self.places.get(tag)
        if not places:
            return
        if tag not in INLINE:
            self.cut(places[-1])
            return
        self._end(self.stack[places[-1]])
        while self.stack and self.stack[-1].closed:
            self.stack.pop()

    def make_way(self, tag: str):
        """Ends the paragraph, item or cell that a block-level tag ends by beginning."""
        ending = [self.places[t][-1] for t, ends in CLOSED_BY.items() if (ends is None or tag in ends) and self.places.get(t)]
        nearest = max(ending, default=-1)
        if nearest > (self.barriers[-1] if self.barriers else -1):
            self.cut(nearest)


def blocks_of(page: str, known: set[str] | None = None) -> list[Block]:
    """The page's leaf blocks, in time linear in the page. ``known``: the only element features kept."""
    found: list[Block] = []
    elements = _Elements(known)
    parts: list[str] = []
    link_chars = 0

    def flush():
        nonlocal link_chars
        text = " ".join("".join(parts).split())
        if text:
            found.append(Block(text, elements.own(), elements.within(), min(1.0, link_chars / len(text))))
        parts.clear()
        link_chars = 0

    def say(raw: str):
        nonlocal link_chars
        text = entities.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if elements.links():
            link_chars += len(text)

    pos = 0
    while True:
        m = MARKUP.search(page, pos)
        if m is None:
            say(page[pos:])
            break
        if m.start() > pos:
            say(page[pos:m.start()])
        pos = m.end()
        closing, name, attributes = m[1] or m[4], m[2] or m[5], m[3] or m[6] or ""
        if name is None:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:])
            continue
        tag = name.lower()
        if tag in SILENT:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}[\s>]", re.I).search(page, pos)
                pos = len(page) if end is None else end.start()
            continue
        if tag not in INLINE:
            flush()
        elif tag == "br":
            parts.append(" ")
        if closing:
            elements.close(tag)
            continue
        if tag not in INLINE:
            elements.make_way(tag)
        if tag not in VOID and not (attributes.endswith("/") and tag not in INLINE):
            names = []
            if "=" in attributes:
                for q in NAMES.findall(attributes):
                    names += LETTERS.findall("".join(q).lower())
            elements.open(tag, names)
    flush()
    return found


WORD_EDGES = (2, 4, 8, 16, 32, 64)
LINK_EDGES = (0.01, 0.3, 0.7, 0.95)


def features_of(blocks: list[Block]) -> list[list[str]]:
    """Named features of every block."""
    out = []
    last = max(1, len(blocks) - 1)
    for i, b in enumerate(blocks):
        feats = {"own=" + b.own, *b.within}
        feats.add(f"words={bisect_right(WORD_EDGES, b.text.count(' ') + 1)}")
        feats.add(f"links={bisect_right(LINK_EDGES, b.linked)}")
        feats.add("end=" + ("stop" if b.text[-1] in ".!?" else "other"))
        feats.add("sign" if "©" in b.text or "copyright" in b.text.lower() else "plain")
        feats.add(f"place={3 * i // (last + 1)}")
        out.append(sorted(feats))
    return out


class Extractor:
    """The trained field with its feature names."""

    def __init__(self, pages: list[tuple[str, set[str]]]):
        """``pages``: (html, texts of the main blocks)."""
        named, labels = [], []
        for page, main in pages:
            blocks = blocks_of(page)
            if blocks:
                named.append(features_of(blocks))
                labels.append([MAIN if b.text in main else OTHER for b in blocks])
        self.ids = {f: i for i, f in enumerate(sorted({f for s in named for fs in s for f in fs}))}
        self.names = set(self.ids)
        self.model = LinearChain(len(self.ids)).fit([[self.known(fs) for fs in s] for s in named], labels)

    def known(self, feats: list[str]) -> list[int]:
        return [self.ids[f] for f in feats if f in self.ids]

    def extract(self, page: str | None) -> str:
        blocks = blocks_of(page, self.names) if page else []
        path = self.model.decode([self.known(fs) for fs in features_of(blocks)])
        return " ".join(b.text for b, y in zip(blocks, path) if y == MAIN)


# Layouts of the training pages: (opening tag, closing tag, kind). Names in braces are
# replaced by one of their alternatives.
CONTAINERS = [
    ("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"),
    ('<div class="content">', "</div>"), ('<div id="content">', "</div>"), ('<div class="post">', "</div>"),
    ('<div class="article body">', "</div>"), ('<div class="entry content">', "</div>"), ('<section class="story">', "</section>"),
    ('<article class="post">', "</article>"), ('<div id="main">', "</div>"), ('<div class="text">', "</div>"), ("", "")]
# Usual names of the parts around an article.
PART_NAMES = {
    "menu": ("menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "links", "toc", "pagination", "pager"),
    "header": ("header", "masthead", "site header", "page header", "top", "logo", "banner"),
    "footer": ("footer", "site footer", "page footer", "bottom", "copyright", "legal", "credits"),
    "side": ("sidebar", "aside", "side", "widget", "related", "recommended", "popular", "trending", "more"),
    "notice": ("notice", "cookie", "cookies", "consent", "alert", "popup", "modal", "gdpr", "banner", "message", "overlay", "warning"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion", "adsense"),
    "form": ("form", "search", "login", "signup", "subscribe", "newsletter", "contact", "register"),
    "comments": ("comments", "comment", "comment list", "discussion", "replies", "reply", "responses", "disqus", "reviews"),
    "social": ("social", "share", "sharing", "follow", "meta", "byline", "tags", "author")}


class _Pages:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.n = 0

    def words(self, low: int, high: int, stop: bool | None = None) -> str:
        """Random words; a number makes the text unlike any other on the page."""
        r = self.r
        self.n += 1
        out = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8))) for _ in range(r.randint(low, high))]
        style = r.random()
        if style < 0.08:
            out = [w.upper() + "!!" for w in out]
        elif style < 0.16:
            out = [w + r.choice(("***", "$$$", "%%%", " |")) for w in out]
        out[r.randrange(len(out))] += str(self.n)
        ends = r.random() < 0.7 if stop is None else stop
        return " ".join(out).capitalize() + (r.choice((".", ".", "!", "?")) if ends else "")

    def inline(self, text: str) -> str:
        r = self.r
        if r.random() < 0.3:
            tag = r.choice(("b", "i", "em", "strong", "span", "a"))
            cut = text.split(" ")
            k = r.randrange(len(cut))
            cut[k] = f'<{tag} href="/x">{cut[k]}</{tag}>' if tag == "a" else f"<{tag}>{cut[k]}</{tag}>"
            return " ".join(cut)
        return text

    def article(self) -> tuple[str, list[str]]:
        r, out, texts = self.r, [], []

        def add(tag, low, high, stop=None):
            text = self.words(low, high, stop)
            texts.append(text)
            end = "" if tag in ("p", "li") and r.random() < 0.15 else f"</{tag}>"
            out.append(f"<{tag}>{self.inline(text)}{end}")

        if r.random() < 0.8:
            add("h1", 2, 10, False)
        for _ in range(r.choice((1, 2, 3, 4, 6, 9, 14))):
            kind = r.random()
            if kind < 0.75:
                add("p", *r.choice(((1, 4), (5, 20), (15, 60), (40, 120))))
            elif kind < 0.83:
                add(r.choice(("h2", "h3")), 1, 6, False)
            elif kind < 0.9:
                out.append("<ul>")
                for _ in range(r.randint(2, 5)):
                    add("li", 1, 12)
                out.append("</ul>")
            elif kind < 0.95:
                add("blockquote", 4, 30)
            elif kind < 0.98:
                out.append("<table><tr>")
                for _ in range(r.randint(2, 4)):
                    add("td", 1, 4, False)
                out.append("</tr></table>")
            else:
                add("pre", 3, 20)
        return "".join(out), texts

    def part(self, kind: str) -> str:
        """A part around the article, with the tags and names it usually has."""
        r = self.r
        name = r.choice(PART_NAMES[kind])
        tags = {"menu": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "side": ("aside", "div"),
                "notice": ("div", "section"), "ad": ("div", "aside", "p"), "form": ("form", "div"),
                "comments": ("section", "div", "ul", "ol"), "social": ("div", "p", "ul")}[kind]
        tag = r.choice(tags)
        plain = tag in ("nav", "header", "footer", "aside", "form") and r.random() < 0.6
        attribute = "" if plain else f' {r.choice(("class", "class", "id"))}="{name.replace(" ", r.choice(("-", "_", " ")))}"'
        many = r.randint(1, 5)
        if kind == "menu" or (kind in ("side", "footer", "social") and r.random() < 0.5):
            inner = "".join(f'<li><a href="/{i}">{self.words(1, 5, False)}</a></li>' for i in range(many + 1))
            inner = inner if tag in ("ul", "ol") else f"<ul>{inner}</ul>"
        elif kind == "form":
            inner = f'<label>{self.words(1, 3)}</label><input name="q"><select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select>' \
                    f'<p>{self.words(2, 14)}</p><button>{self.words(1, 2, False)}</button>'
        elif kind == "comments":
            one = r.choice(("li", "div", "p", "article"))
            inner = f"<h3>{self.words(1, 3, False)}</h3>" + "".join(
                f'<{one} class="{r.choice(("comment", "comment-body", "reply"))}">{self.words(3, 50)}</{one}>' for _ in range(many))
        elif kind == "footer":
            inner = f"&copy; {self.words(2, 14)}" if r.random() < 0.6 else f"<p>{self.words(2, 20)}</p>"
        elif kind == "header":
            inner = r.choice((f"<h1>{self.words(1, 4, False)}</h1>", f"<p>{self.words(1, 8)}</p>", self.words(1, 5, False)))
        elif r.random() < 0.5 and tag != "p":
            inner = "".join(f"<p>{self.words(2, 25)}</p>" for _ in range(r.randint(1, 3)))
        else:
            inner = self.words(2, 25)
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def page(self) -> tuple[str, set[str]]:
        r = self.r
        body, main = self.article()
        for kind in ("ad", "social", "notice", "form", "side"):  # parts inside the article
            if r.random() < 0.12:
                at = body.find("<p>", r.randrange(len(body)))
                at = len(body) if at < 0 else at
                # Never inside an open list or table, which would make it another layout.
                if body[:at].count("<ul>") == body[:at].count("</ul>") and body[:at].count("<table>") == body[:at].count("</table>"):
                    body = body[:at] + self.part(kind) + body[at:]
        start, end = r.choice(CONTAINERS)
        inside = self.part("comments") if r.random() < 0.15 else ""
        before = [self.part(k) for k in ("header", "menu", "notice", "ad", "form") if r.random() < 0.55]
        after = [self.part(k) for k in ("comments", "side", "ad", "form", "social", "menu", "footer", "notice") if r.random() < 0.4]
        r.shuffle(before)
        title = self.words(1, 10, False)
        head = f"<head><title>{title}</title><style>p{{margin:0}}</style></head>" if r.random() < 0.9 else ""
        extra = f"<noscript>{self.words(2, 10)}</noscript>" if r.random() < 0.1 else ""
        return (f"<!DOCTYPE html><html>{head}<body>{extra}{''.join(before)}{start}{body}{inside}{end}{''.join(after)}</body></html>",
                set(" ".join(t.split()) for t in main))


def labelled_pages(n: int = TRAIN_PAGES, seed: int = TRAIN_SEED) -> list[tuple[str, set[str]]]:
    """(html, main block texts) pages drawn from the layouts."""
    make = _Pages(seed)
    return [make.page() for _ in range(n)]


def extract(pages: DataFrame, html: str = "html", train_pages: int = TRAIN_PAGES) -> DataFrame:
    """``pages`` with text (the main text) and n_chars (its code points)."""
    shared = pages.sparkSession.sparkContext.broadcast(Extractor(labelled_pages(train_pages)))
    at = [c.lower() for c in pages.columns].index(html.lower())
    name = fresh(pages, "main_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [model.extract(p) for p in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    out = pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(name, T.StringType())]))
    return with_result(out, text=F.col(name), n_chars=F.length(name).cast("long")).drop(name)


def digest(extracted: DataFrame) -> DataFrame:
    """The contract's columns."""
    return extracted.select("page_id", "url", "text", "n_chars")
