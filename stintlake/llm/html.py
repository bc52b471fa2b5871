"""HTML extraction with a tree-structured graphical model.

A page becomes a tree of block elements. Every block is content or not; features of a block give
its own potential, the kinds of parent and child give the potential of the pair. Sum-product
messages up and down the tree give exact marginals, in the training (by gradient ascent on the
likelihood of labelled pages) and in the extraction alike.
"""

import math
import random
import re
from dataclasses import dataclass, field
from functools import lru_cache, partial
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from stintlake.llm.common import table

# Elements by kind, after the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(
    "script style template head title iframe svg select option textarea button datalist audio "
    "video canvas annotation annotation-xml".split()
)
BLOCKS = frozenset(
    "html body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt "
    "dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption form fieldset "
    "legend address details summary dialog hgroup menu search center noscript".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a new one of these closes, if it is open within the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
#: Words in class, id and role that tell what a block is for.
HINTS = {
    "menu": r"nav|menu|breadcrumb|pagination|pager|tabs|toc",
    "frame": r"header|footer|masthead|copyright|legal|banner",
    "side": r"side|aside|widget|related|recommend|popular|recent|tags|promo",
    "advert": r"\bads?\b|advert|sponsor|adsense|dfp",
    "notice": r"cookie|consent|notice|alert|popup|modal|newsletter|subscribe|gdpr|paywall",
    "comment": r"comment|repl(?:y|ies)|discuss|disqus|respond|review",
    "share": r"share|social|follow|author-box|login|signup|search",
    "main": r"article|content|post|entry|story|main|body-text|markdown|prose",
}
HINTS = {name: re.compile(pattern) for name, pattern in HINTS.items()}
#: Tags that get a feature of their own; others count as one.
TAGS = (
    "html body main article section header footer nav aside div p h1 h2 h3 ul ol li table tr td "
    "th blockquote pre form figure figcaption dl dt dd caption address noscript"
).split()
#: Elements that say what all inside them is for, unless a nearer one says otherwise.
LANDMARKS = {tag: "article" for tag in ("article", "main")} | {
    tag: "frame" for tag in "nav aside footer form dialog menu search header".split()
}
GROUPS = ("root", "article", "part", "frame", "list", "text", "heading")


@dataclass
class Block:
    tag: str
    parent: int
    hints: frozenset
    parts: list = field(default_factory=list)  # own text, in pieces between inner blocks
    links: int = 0  # characters of own text inside links
    around: list = field(default_factory=list)  # features that come from the rest of the page


class _Builder(HTMLParser):
    """Blocks of a page in document order. Inline elements belong to the block around them; text
    after an inner block starts a new piece of the outer one. Hidden elements end at their end
    tags; those without one end at the next block element that begins or ends."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks = [Block("html", -1, frozenset())]
        self.open = [0]  # open blocks, outermost first
        self.hidden = []  # open hidden elements, and whether they have an end tag
        self.anchors = 0
        self.texts = []  # (block, text) in document order
        self.fresh = True
        self.events = []  # (kind, tag or text, attributes)

    def handle_starttag(self, tag, attrs):
        self.events.append(("start", tag, attrs))

    def handle_startendtag(self, tag, attrs):
        if tag not in HIDDEN:
            self.events.append(("start", tag, attrs))
            if tag in BLOCKS:
                self.events.append(("end", tag, None))

    def handle_endtag(self, tag):
        self.events.append(("end", tag, None))

    def handle_data(self, data):
        self.events.append(("text", data, None))

    def close(self):
        super().close()
        begun, ended = {}, set()
        for at, (kind, tag, _) in enumerate(self.events):
            if kind != "text" and tag in HIDDEN:
                if kind == "start":
                    begun.setdefault(tag, []).append(at)
                elif begun.get(tag):
                    ended.add(begun[tag].pop())
        for at, (kind, what, attrs) in enumerate(self.events):
            if kind == "text":
                if not self.hidden:
                    self._text(what)
                continue
            if what in BLOCKS:
                while self.hidden and not self.hidden[-1][1]:
                    self.hidden.pop()
            if kind == "start":
                self._start(what, attrs, at in ended)
            else:
                self._end(what)

    def _push(self, tag, attrs):
        said = " ".join(str(v).lower() for k, v in attrs if k in ("class", "id", "role") and v)
        root = tag in ("html", "body")  # names of the whole page say nothing of its blocks
        hints = frozenset(name for name, p in HINTS.items() if said and not root and p.search(said))
        self.blocks.append(Block(tag, self.open[-1], hints))
        self.open.append(len(self.blocks) - 1)
        self.anchors = 0
        self.fresh = True

    def _close(self, tags, within):
        """Closes the innermost open block of `tags`, if no block of `within` is open inside it."""
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.blocks[self.open[depth]].tag
            if tag in tags:
                del self.open[depth:]
                self.fresh = True
                return
            if tag in within:
                return

    def _start(self, tag, attrs, ended):
        if tag in HIDDEN:
            if tag != "head":  # a head that isn't closed must not hide the page
                self.hidden.append((tag, ended))
        elif self.hidden or tag == "html":
            pass
        elif tag == "noscript" and self.blocks[self.open[-1]].tag in HEADINGS | {"p"}:
            pass
        elif tag in BLOCKS:
            if tag not in ("noscript", "caption"):
                self._close({"p"}, BLOCKS - {"p"} - HEADINGS)
            if tag in HEADINGS:
                self._close(HEADINGS, BLOCKS - HEADINGS)
            if tag in CLOSES:
                self._close(*CLOSES[tag])
            self._push(tag, attrs)
        elif tag == "a":
            self.anchors += 1
        elif tag in ("br", "hr"):
            self._text(" ")
            if tag == "hr":
                self.fresh = True

    def _end(self, tag):
        if self.hidden:
            if any(tag == name for name, _ in self.hidden):
                while self.hidden.pop()[0] != tag:
                    pass
        elif tag == "a":
            self.anchors = max(0, self.anchors - 1)
        elif tag in BLOCKS and tag not in ("html", "body"):
            for depth in range(len(self.open) - 1, 0, -1):
                if self.blocks[self.open[depth]].tag == tag:
                    del self.open[depth:]
                    self.fresh = True
                    break

    def _text(self, data):
        at = self.open[-1]
        if self.fresh or not self.texts:
            self.texts.append((at, [data]))
            self.fresh = False
        else:
            self.texts[-1][1].append(data)
        if self.anchors:
            self.blocks[at].links += len(data)


SPACE = re.compile(r"\s+")
SENTENCE = re.compile(r"[.!?](?:\s|$)")


def _finish(builder: _Builder, html: str) -> list[tuple[int, str]]:
    builder.feed(html)
    builder.close()
    pieces = []
    for at, data in builder.texts:
        text = SPACE.sub(" ", "".join(data)).strip()
        if text:
            builder.blocks[at].parts.append(text)
            pieces.append((at, text))
    _look_around(builder.blocks)
    return pieces


def _look_around(blocks: list[Block]) -> None:
    """Features from the page: the landmark a block is in, how much of the text below it is links
    or sentences, its share of the page, and whether the page has an article or any landmark."""
    n = len(blocks)
    chars, links, said = [0] * n, [0] * n, [0] * n
    inside, replies = ["page"] * n, [False] * n
    for i, block in enumerate(blocks):
        text = " ".join(block.parts)
        chars[i], links[i], said[i] = len(text), block.links, len(SENTENCE.findall(text))
        if i:
            held, own = inside[block.parent], LANDMARKS.get(block.tag)
            replies[i] = replies[block.parent] or "comment" in block.hints
            if own == "article" and replies[i]:
                own = "replies"
            inside[i] = held if own is None or (block.tag == "header" and held == "article") else own
    for i in range(n - 1, 0, -1):
        parent = blocks[i].parent
        chars[parent] += chars[i]
        links[parent] += links[i]
        said[parent] += said[i]
    marked = "article" if "article" in inside else "frames" if "frame" in inside else "bare"
    for i, block in enumerate(blocks):
        share = chars[i] / max(1, chars[0])
        block.around = [f"in:{inside[i]}", f"page:{marked}:{inside[i]}", f"{block.tag}@{inside[i]}"]
        if block.hints:
            block.around += [f"hint:{h}@{inside[i]}" for h in sorted(block.hints)]
        if chars[i] and block.tag not in ("html", "body"):
            block.around.append(f"below_links:{min(3, int(4 * links[i] / chars[i]))}")
            block.around.append(f"below_said:{min(3, said[i])}")
            block.around.append(f"share:{(share >= 0.05) + (share >= 0.2) + (share >= 0.5)}")
        if n == 1:
            block.around.append("alone")


def parse(html: str) -> tuple[list[Block], list[tuple[int, str]]]:
    """Blocks, parents before children, and (block, text) pieces in page order. White space inside
    a piece is one space; empty pieces are left out."""
    builder = _Builder()
    pieces = _finish(builder, html)
    return builder.blocks, pieces


# --- model ----------------------------------------------------------------------------------


def group(block: Block) -> str:
    tag = block.tag
    if tag in ("html", "body"):
        return "root"
    if tag in ("article", "main"):
        return "article"
    if tag == "header":
        return "part" if "in:article" in block.around else "frame"
    if tag in LANDMARKS:
        return "frame"
    if tag in ("ul", "ol", "dl", "dt", "dd", "li", "table", "caption", "tr", "td", "th"):
        return "list"
    if tag in HEADINGS:
        return "heading"
    return "part" if tag in ("div", "section", "noscript") else "text"


def features(block: Block) -> list[str]:
    """Names of the features that are on."""
    text = " ".join(block.parts)
    on = ["bias", f"tag:{block.tag if block.tag in TAGS else 'other'}"]
    on += [f"hint:{h}" for h in sorted(block.hints)] + block.around
    if text:
        on.append(f"length:{min(6, int(math.log2(len(text) + 1)) // 2)}")
        on.append(f"links:{min(3, int(4 * block.links / max(1, len(text))))}")
        if SENTENCE.search(text):
            on.append("sentence")
        if "©" in text or "copyright" in text.lower():
            on.append("rights")
    return on


class TreeModel:
    """Log potentials: weights of features for content, and for pairs of (parent kind, child kind)
    with each combination of labels."""

    def __init__(self):
        self.own: dict[str, float] = {}
        self.pair: dict[tuple, float] = {}

    def _potentials(self, blocks):
        own = [sum(self.own.get(f, 0.0) for f in features(b)) for b in blocks]
        kinds = [group(b) for b in blocks]
        return own, kinds

    def marginals(self, blocks: list[Block]):
        """P(content) of each block, P(parent, child) for each block with a parent, and the kinds.

        Upward messages are summed from the leaves (children stand after their parents in the
        list), downward ones from the root; logs keep long pages in range."""
        own, kinds = self._potentials(blocks)
        n = len(blocks)
        up = [[0.0, own[i]] for i in range(n)]  # own potential and messages of the children
        message = [(0.0, 0.0)] * n
        tables = [None] * n
        for i in range(n - 1, 0, -1):
            parent = blocks[i].parent
            key = (kinds[parent], kinds[i])
            t = [[self.pair.get((*key, a, b), 0.0) for b in (0, 1)] for a in (0, 1)]
            tables[i] = t
            m = tuple(_log_sum(t[a][0] + up[i][0], t[a][1] + up[i][1]) for a in (0, 1))
            message[i] = m
            up[parent][0] += m[0]
            up[parent][1] += m[1]
        down = [(0.0, 0.0)] * n
        belief, joint = [0.0] * n, [None] * n
        for i in range(n):
            if i:
                parent = blocks[i].parent
                above = [up[parent][a] + down[parent][a] - message[i][a] for a in (0, 1)]
                t = tables[i]
                down[i] = tuple(_log_sum(above[0] + t[0][b], above[1] + t[1][b]) for b in (0, 1))
                cells = [[above[a] + t[a][b] + up[i][b] for b in (0, 1)] for a in (0, 1)]
                top = max(max(r) for r in cells)
                weights = [[math.exp(x - top) for x in r] for r in cells]
                total = sum(map(sum, weights))
                joint[i] = [[x / total for x in r] for r in weights]
            both = [up[i][b] + down[i][b] for b in (0, 1)]
            belief[i] = 1 / (1 + math.exp(max(-500.0, min(500.0, both[0] - both[1]))))
        return belief, joint, kinds

    def train(self, pages: list, rounds: int = 60, rate: float = 0.5, penalty: float = 0.003):
        """Gradient ascent on the mean log likelihood of (blocks, labels) pages, with a penalty on
        squared weights; steps shrink per weight by the gradients it has seen."""
        seen: dict = {}
        named = [[features(b) for b in blocks] for blocks, _ in pages]
        for _ in range(rounds):
            slope: dict = {}
            for (blocks, labels), names in zip(pages, named, strict=True):
                belief, joint, kinds = self.marginals(blocks)
                for i, block in enumerate(blocks):
                    gap = labels[i] - belief[i]
                    for f in names[i]:
                        slope[f] = slope.get(f, 0.0) + gap
                    if i:
                        key = (kinds[block.parent], kinds[i])
                        for a in (0, 1):
                            for b in (0, 1):
                                real = float(labels[block.parent] == a and labels[i] == b)
                                k = (*key, a, b)
                                slope[k] = slope.get(k, 0.0) + real - joint[i][a][b]
            for k, g in slope.items():
                weights = self.own if isinstance(k, str) else self.pair
                g = g / len(pages) - penalty * weights.get(k, 0.0)
                seen[k] = seen.get(k, 1e-8) + g * g
                weights[k] = weights.get(k, 0.0) + rate * g / math.sqrt(seen[k])
        return self


def _log_sum(a: float, b: float) -> float:
    top, low = (a, b) if a > b else (b, a)
    return top + math.log1p(math.exp(low - top)) if low - top > -700 else top


# --- labelled pages -------------------------------------------------------------------------

#: Training pages made from labelled templates.
TRAINING_PAGES = 240


#: Kinds of page, each with a frame of its own around the article.
TEMPLATES = ("sections", "unwrapped", "headed", "unnamed", "tables", "plain")


def labelled_page(pick: random.Random, templates: tuple = TEMPLATES) -> str:
    """A page in which data-y="1" marks the blocks of the article and data-y="0" all others. Menus,
    headers, footers, sidebars, notices, adverts, forms and reader comments stand around it, in
    the elements and class names that sites use. Some names mislead. The templates: sections with
    names; an article straight in the body; an article with a header of its own; nested blocks
    without any names; a page laid out by tables; text without blocks."""
    template = pick.choice(templates)
    letters = "abcdefghilmnoprstuvy"

    def words(least, most):
        made = (
            "".join(pick.choices(letters, k=pick.randint(2, 9)))
            for _ in range(pick.randint(least, most))
        )
        return " ".join(made)

    def sentences(least, most):
        return " ".join(words(4, 18).capitalize() + "." for _ in range(pick.randint(least, most)))

    def menu(y=0):
        items = "".join(
            f'<li data-y="{y}"><a href="/x">{words(1, 2)}</a></li>' for _ in range(pick.randint(3, 8))
        )
        return f'<ul data-y="{y}">{items}</ul>'

    def named(choices, inner):
        tag, said = pick.choice(choices)
        return f'<{tag} {said} data-y="0">{inner}</{tag}>'

    def advert():
        return named(
            [("div", 'class="ad"'), ("div", 'class="ads banner"'), ("aside", 'class="sponsor"'),
             ("div", 'id="advert"'), ("section", 'class="promo"')],
            pick.choice([sentences(1, 2), f'<p data-y="0">{sentences(1, 2)}</p>', words(2, 8)]),
        )

    def notice():
        return named(
            [("div", 'class="cookie-notice"'), ("div", 'role="alert" class="notice"'),
             ("section", 'class="newsletter"'), ("div", 'class="consent popup"')],
            f'<p data-y="0">{sentences(1, 3)}</p>',
        )

    def side():
        inner = f'<h3 data-y="0">{words(1, 3)}</h3>' + pick.choice(
            [menu(), f'<p data-y="0">{sentences(1, 3)}</p>']
        )
        return named(
            [("aside", ""), ("div", 'class="sidebar"'), ("div", 'id="related"'),
             ("section", 'class="widget recent"')],
            inner,
        )

    def comments():
        each = "".join(
            pick.choice(
                [f'<div class="comment" data-y="0"><p data-y="0">{sentences(1, 4)}</p></div>',
                 f'<li class="comment" data-y="0">{sentences(1, 3)}</li>',
                 f'<article class="comment" data-y="0"><p data-y="0">{sentences(1, 3)}</p></article>']
            )
            for _ in range(pick.randint(1, 5))
        )
        return named(
            [("section", 'id="comments"'), ("div", 'class="comments"'), ("ol", 'class="replies"'),
             ("div", 'id="disqus_thread" class="discussion"')],
            f'<h2 data-y="0">{words(1, 3)}</h2>{each}',
        )

    def form():
        return f'<form data-y="0"><p data-y="0">{words(1, 6)}</p><input name="q">{words(0, 2)}</form>'

    def top():
        inner = pick.choice([menu(), f'<h1 data-y="0">{words(1, 3)}</h1>', words(1, 5)])
        return named([("header", ""), ("div", 'id="header"'), ("header", 'class="site-header"')], inner)

    def bottom():
        inner = pick.choice(
            [f"&copy; {words(1, 3)} &middot; {sentences(1, 2)}", menu(),
             f'<p data-y="0">Copyright {words(2, 6)}</p>', sentences(1, 2)]
        )
        return named([("footer", ""), ("div", 'id="footer"'), ("div", 'class="legal"')], inner)

    def nav():
        return named([("nav", ""), ("div", 'class="menu"'), ("div", 'id="nav"'), ("nav", 'class="tabs"')], menu())

    #: Names that say something else than what the block is for.
    decoys = ["no-sidebar", "side-note", "has-comments", "lead banner-off", "recent", "note alert", "legal-text", "menu-card"]

    def script_notice():
        return f'<noscript data-y="0">{sentences(1, 1)}</noscript>'

    def text_block():
        return pick.choices(
            [
                f'<p data-y="1">{sentences(1, 6)}</p>',
                f'<p data-y="1"><b>{words(2, 6)}</b> {sentences(1, 4)}</p>',
                f'<p data-y="1">{words(1, 8)}</p>',
                f'<h2 data-y="1">{words(1, 6)}</h2>',
                f'<ul data-y="1"><li data-y="1">{sentences(1, 1)}</li><li data-y="1">{words(2, 7)}</li></ul>',
                f'<blockquote data-y="1"><p data-y="1">{sentences(1, 3)}</p></blockquote>',
                f'<pre data-y="1">{words(3, 20)}</pre>',
                f'<table data-y="1"><tr data-y="1"><td data-y="1">{words(1, 3)}</td><td data-y="1">{words(1, 2)}</td></tr></table>',
                f'<p data-y="1">{sentences(1, 3)} <a href="/y">{words(1, 4)}</a> {words(2, 5)}.</p>',
                f'<div data-y="1">{sentences(1, 5)}</div>',
                f'<dl data-y="1"><dt data-y="1">{words(1, 3)}</dt><dd data-y="1">{sentences(1, 2)}</dd>'
                f'<dt data-y="1">{words(1, 2)}</dt><dd data-y="1">{words(2, 9)}</dd></dl>',
                f'<table data-y="1"><caption data-y="1">{words(2, 8)}</caption><tr data-y="1">'
                f'<th data-y="1">{words(1, 2)}</th><td data-y="1">{words(1, 4)}</td></tr></table>',
                f'<figure data-y="1"><figcaption data-y="1">{words(3, 12)}</figcaption></figure>',
                f'<p data-y="1" class="{pick.choice(decoys)}">{sentences(1, 4)}</p>',
                f'<noscript data-y="1"><p data-y="1">{sentences(1, 2)}</p></noscript>',
                f'<section data-y="1"><h2 data-y="1">{words(1, 5)}</h2><p data-y="1">{sentences(1, 4)}</p></section>',
            ],
            weights=[10, 3, 3, 2, 2, 1, 1, 1, 3, 2, 1, 1, 1, 2, 0.5, 1],
        )[0]

    inner = [f'<h1 data-y="1">{words(1, 9)}</h1>'] * pick.randint(0, 1)
    for _ in range(pick.randint(1, 9)):
        inner.append(text_block())
        if pick.random() < 0.06:
            inner.append(pick.choice([advert, side, form, notice])())
    inner = "".join(inner)
    if template == "plain":
        return "\n\n".join(sentences(1, 6) for _ in range(pick.randint(1, 5)))
    before = [f() for f in (top, nav, notice, advert, form, side, script_notice) if pick.random() < 0.4]
    after = [f() for f in (comments, side, advert, form, bottom, notice) if pick.random() < 0.45]
    if template == "unwrapped":
        body = "".join([*before[:2], inner, *after])
        loose = pick.random() < 0.3  # text straight in the body
        return f'<html><body data-y="1">{sentences(1, 4) if loose else ""}{body}</body></html>'
    if template == "unnamed":
        above = f'<div data-y="0"><div data-y="0">{words(1, 3)}</div>{menu()}</div>'
        below = f'<div data-y="0">{pick.choice([menu(), f"&copy; {words(1, 4)}"])}</div>'
        return (
            f'<html><body data-y="0"><div data-y="0">{above}<div data-y="1">{inner}</div>{below}'
            "</div></body></html>"
        )
    if template == "tables":
        cells = [
            f'<td data-y="0">{menu()}</td>', f'<td data-y="1">{inner}</td>',
            f'<td data-y="0"><a href="/z">{words(1, 3)}</a> <a href="/z">{words(1, 3)}</a></td>',
        ][: pick.randint(2, 3)]
        if pick.random() < 0.5:
            cells.reverse()
        return (
            f'<html><body data-y="0"><table data-y="0"><tr data-y="0">{"".join(cells)}</tr></table>'
            f'{"".join(after[-1:])}</body></html>'
        )
    if template == "headed":
        title = f'<header data-y="1"><h1 data-y="1">{words(1, 9)}</h1></header>'
        foot = f'<footer data-y="0">{words(1, 6)}</footer>' if pick.random() < 0.3 else ""
        tag, said = pick.choice([("article", ""), ("main", ""), ("article", f'class="{pick.choice(decoys)}"')])
        article = f'<{tag} {said} data-y="1">{title}{inner}{foot}</{tag}>'
    else:
        tag, said = pick.choice(
            [("article", ""), ("article", ""), ("main", ""), ("div", 'id="content"'), ("article", 'class="post"'),
             ("div", 'class="article-body"'), ("section", 'class="entry-content"'), ("div", 'class="story"'),
             ("article", f'class="{pick.choice(decoys)}"'), ("div", f'class="content {pick.choice(decoys)}"')]
        )
        article = f'<{tag} {said} data-y="1">{inner}</{tag}>'
    body = "".join([*before, article, *after])
    if pick.random() < 0.3:
        body = f'<div class="{pick.choice(["wrap", *decoys])}" data-y="{pick.randint(0, 1)}">{body}</div>'
    return f'<html><body data-y="0">{body}</body></html>'


class _Labelled(_Builder):
    def __init__(self):
        super().__init__()
        self.labels = [0]

    def _push(self, tag, attrs):
        super()._push(tag, [(k, v) for k, v in attrs if k != "data-y"])
        self.labels.append(int(dict(attrs).get("data-y") or 0))


def labelled_blocks(html: str) -> tuple[list[Block], list[int]]:
    """The blocks of a labelled page and their labels."""
    builder = _Labelled()
    _finish(builder, html)
    if len(builder.blocks) == 1:  # plain text is content
        builder.labels[0] = 1
    return builder.blocks, builder.labels


def train(pages: list[str]) -> TreeModel:
    """A model from labelled pages (data-y on their blocks). It has a few hundred weights."""
    return TreeModel().train([labelled_blocks(p) for p in pages])


@lru_cache(maxsize=2)
def default_model(seed: int = 5) -> TreeModel:
    """Trained on the driver from made pages; it travels with the tasks."""
    pick = random.Random(seed)
    return train([labelled_page(pick) for _ in range(TRAINING_PAGES)])


# --- extraction -----------------------------------------------------------------------------


def main_text(html: str, model: TreeModel) -> str:
    """The texts of blocks that are more likely content than not, in page order."""
    blocks, pieces = parse(html)
    if len(blocks) == 1:
        return "\n\n".join(text for _, text in pieces)
    belief = model.marginals(blocks)[0]
    return "\n\n".join(text for at, text in pieces if belief[at] > 0.5)


def _extracted(batches, model):
    for batch in batches:
        texts = [main_text(x.as_py() or "", model) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ],
            ["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """A row per page: page_id, url, text, n_chars.

    Null or empty html: empty text. A page without block elements is one block, its text. Repeated
    rows: alike. No rows: none. Unclosed and misnested elements are closed as browsers do."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return pages.select("page_id", "url", "html").mapInArrow(
        partial(_extracted, model=model or default_model()),
        f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long",
    )


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
