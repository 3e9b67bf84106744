"""Main text of web pages: boosted trees over features of DOM nodes, decoded over the tree.

Every element is a frame (holds the article and other things), content, or clutter. Trees score the three classes from
tag, attribute tokens, depth, text and link density of the subtree, and siblings; a dynamic program over the page then picks
the likeliest labels without contradictions: below content only content or clutter, below clutter only clutter, and
frames only below frames. Text of content nodes is the result. Training uses generated pages, whose labels are known,
and at most SAMPLE pages of the corpus, labelled by what their tags say.

Defined cases: null, empty and unmarked html has no article and gives the empty text; unclosed elements end where their
parent or (paragraphs, items) their successor does; rows that repeat are read one by one; further columns are ignored.
"""

from __future__ import annotations

import html as references
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casetrail.llm.common import batches
from casetrail.llm.trees import BoostedTrees

#: Pages of the corpus that training looks at, and generated ones.
SAMPLE, GENERATED = 300, 500
FRAME, CONTENT, CLUTTER = range(3)

# Element names of HTML, and words that class, id and role attributes use.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe template".split())
HIDDEN = RAW | {"head", "svg", "button", "select"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
TAGS = [
    {"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "dd", "dt"}, {"ul", "ol", "dl", "menu"}, {"div", "section", "center"},
    {"article"}, {"main"}, {"nav"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "input", "label", "dialog"},
    {"html", "body"}, {"table", "tbody", "tr", "td", "th"}, {"blockquote", "pre", "figure", "figcaption", "code"}, {"a"}, HIDDEN,
]
TOKENS = [
    set("article content post entry story main body text page".split()),
    set("nav navbar menu breadcrumb breadcrumbs tabs toc pagination pager".split()),
    set("ad ads adv advert advertisement sponsor sponsored promo promotion banner".split()),
    set("footer copyright legal colophon bottom imprint".split()),
    set("sidebar aside widget related recommended popular tags rail".split()),
    set("comment comments reply replies discussion respond disqus".split()),
    set("cookie cookies consent notice alert gdpr newsletter subscribe popup modal".split()),
    set("share sharing social follow buttons tools".split()),
    set("form search login signup contact".split()),
    set("header masthead logo top branding site".split()),
]
ROLES = {"navigation": 1, "contentinfo": 3, "complementary": 4, "search": 8, "banner": 9}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>", re.S
)
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
ATTRIBUTE = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


class Page:
    """Elements of a page in order: parent, tag, names; and its texts with the element they stand in."""

    def __init__(self, source: str):
        self.parent, self.tag, self.names = [-1], ["#page"], [frozenset()]
        self.texts: list[tuple[int, str]] = []  # (element, text), and (-1, "") where a block starts or ends
        stack, at, n = [0], 0, len(source)
        while at < n:
            m = TOKEN.search(source, at)
            if m is None:
                self._text(stack[-1], source[at:])
                break
            self._text(stack[-1], source[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if tag == "br":
                self._text(stack[-1], " ")
                continue
            if tag in BLOCK:
                self.texts.append((-1, ""))
            if m[1] or m[4]:
                self._close(stack, tag)
                continue
            self._imply(stack, tag)
            self.parent.append(stack[-1])
            self.tag.append(tag)
            self.names.append(self._names(m[3] or m[6] or ""))
            if tag in VOID:
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
                if end is None:
                    break
                at = source.find(">", end.start()) + 1 or n
                continue
            stack.append(len(self.parent) - 1)

    def _text(self, element: int, text: str) -> None:
        if text:
            self.texts.append((element, references.unescape(text)))

    @staticmethod
    def _names(attributes: str) -> frozenset[int]:
        if "=" not in attributes:
            return frozenset()
        words = [w for m in NAMES.finditer(attributes) for w in ATTRIBUTE.findall(m[1].lower())]
        return frozenset([k for k, known in enumerate(TOKENS) if any(w in known for w in words)] + [ROLES[w] for w in words if w in ROLES])

    def _close(self, stack: list[int], tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if self.tag[stack[k]] == tag:
                del stack[k:]
                return
            if tag not in BLOCK and self.tag[stack[k]] in BLOCK:
                return  # an inline end tag ends nothing outside its block

    def _imply(self, stack: list[int], tag: str) -> None:
        """A block ends an open paragraph; an item ends the item before it."""
        if tag not in BLOCK:
            return
        for k in range(len(stack) - 1, 0, -1):
            open_ = self.tag[stack[k]]
            if open_ == "p" or open_ == tag and tag in ("li", "dt", "dd", "tr", "td", "th"):
                del stack[k:]
                return
            if open_ in BLOCK:
                return

    def features(self) -> np.ndarray:
        n = len(self.parent)
        own, link, words, commas = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        before, total = np.zeros(n), 0
        seen = -1
        in_link = [False] * n
        for k in range(1, n):
            in_link[k] = in_link[self.parent[k]] or self.tag[k] == "a"
        for e, t in self.texts:
            if e < 0:
                continue
            size = len(t.strip())
            own[e] += size
            words[e] += t.count(" ") + bool(size)
            commas[e] += t.count(",") + t.count(".")
            link[e] += size * in_link[e]
            while seen < e:
                seen += 1
                before[seen] = total
            total += size
        before[seen + 1 :] = total
        size, inner = np.ones(n), np.zeros((n, 3))  # elements below; paragraphs, items, headings below
        kinds = np.array([(t == "p", t == "li", t in TAGS[1]) for t in self.tag], float)
        text = own.copy()
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            text[p] += text[k]
            link[p] += link[k]
            words[p] += words[k]
            commas[p] += commas[k]
            size[p] += size[k]
            inner[p] += inner[k] + kinds[k]
        depth, index, count = np.zeros(n), np.zeros(n), np.zeros(n)
        flags = np.zeros((n, len(TAGS) + 2 * len(TOKENS) + 4))
        for k in range(n):
            p, t = self.parent[k], self.tag[k]
            for j, group in enumerate(TAGS):
                flags[k, j] = t in group
            flags[k, [len(TAGS) + j for j in self.names[k]]] = 1
            if p >= 0:
                depth[k] = depth[p] + 1
                index[k] = count[p]
                count[p] += 1
                up = slice(len(TAGS) + len(TOKENS), len(TAGS) + 2 * len(TOKENS))
                flags[k, up] = np.maximum(flags[p, up], flags[p, len(TAGS) : len(TAGS) + len(TOKENS)])
                flags[k, -4] = max(flags[p, -4], self.tag[p] == "article", self.tag[p] == "main")
                flags[k, -3] = max(flags[p, -3], self.tag[p] in ("nav", "footer", "aside", "form"))
                flags[k, -2] = max(flags[p, -2], self.tag[p] == "header")
                flags[k, -1] = max(flags[p, -1], flags[p, len(TAGS) - 1])
        whole = max(total, 1)
        parent = np.maximum(self.parent, 0)
        numbers = [
            np.log1p(own), np.log1p(text), link / np.maximum(text, 1), text / size, text / whole, own / np.maximum(text, 1),
            np.log1p(words), commas / np.maximum(words, 1), np.log1p(size), depth, index, count, count[parent], before / whole,
            text / np.maximum(text[parent], 1), link[parent] / np.maximum(text[parent], 1), *np.log1p(inner).T,
        ]
        return np.concatenate([np.stack(numbers, 1), flags], 1)

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """Likeliest labels under the rules above: best sums from the leaves up, choices from the root down."""
        n, allowed = len(self.parent), {FRAME: (FRAME, CONTENT, CLUTTER), CONTENT: (CONTENT, CLUTTER), CLUTTER: (CLUTTER,)}
        best = scores.tolist()
        for k in range(n - 1, 0, -1):
            p, mine = best[self.parent[k]], best[k]
            p[FRAME] += max(mine)
            p[CONTENT] += max(mine[CONTENT], mine[CLUTTER])
            p[CLUTTER] += mine[CLUTTER]
        label = [FRAME] * n
        for k in range(1, n):
            label[k] = max(allowed[label[self.parent[k]]], key=best[k].__getitem__)
        return np.array(label)

    def text(self, label: np.ndarray) -> str:
        blocks, block = [], []
        for e, t in [*self.texts, (-1, "")]:
            if e >= 0:
                if label[e] == CONTENT:
                    block.append(t)
                continue
            if block:
                line = SPACE.sub(" ", "".join(block)).strip()
                if line:
                    blocks.append(line)
                block = []
        return "\n".join(blocks)


# ---- training -----------------------------------------------------------------------------------


def labels_by_tags(page: Page) -> np.ndarray | None:
    """What the tags of a page say; None if it names no article."""
    if "article" not in page.tag and "main" not in page.tag:
        return None
    home = "article" if "article" in page.tag else "main"
    label = []
    for k, (p, tag) in enumerate(zip(page.parent, page.tag, strict=True)):
        up = FRAME if p < 0 else label[p]
        bad = tag in HIDDEN or tag in ("nav", "aside", "footer", "form") or page.names[k] & {1, 2, 3, 4, 5, 6, 7, 8}
        if up == CLUTTER or bad and tag not in ("html", "body"):
            label.append(CLUTTER)
        elif up == CONTENT or tag == home:
            label.append(CONTENT)
        else:
            label.append(FRAME if any(q == home for q in page.tag[k:]) and tag in BLOCK | {"#page"} and _holds(page, k, home) else CLUTTER)
    return np.array(label)


def _holds(page: Page, k: int, tag: str) -> bool:
    inside = {k}
    for j in range(k + 1, len(page.parent)):
        if page.parent[j] in inside:
            inside.add(j)
            if page.tag[j] == tag:
                return True
    return False


class _Writer:
    """Pages with known labels: an attribute data-l on every element says which it is."""

    def __init__(self, r: np.random.Generator):
        self.r = r

    def words(self, low: int, high: int) -> str:
        parts = ["ra", "to", "mi", "len", "so", "ka", "ur", "be", "dis", "ow", "ent", "al"]
        n = int(self.r.integers(low, high))
        out = ["".join(parts[i] for i in self.r.integers(0, 12, self.r.integers(1, 4))) for _ in range(n)]
        return " ".join(w + (",", ".", "", "", "", "")[self.r.integers(6)] for w in out) + "."

    def pick(self, *options):
        return options[self.r.integers(len(options))]

    def el(self, tag: str, label: int, inner: str, names: str = "") -> str:
        return f'<{tag} data-l="{label}"' + (f' {self.pick("class", "class", "id")}="{names}"' if names else "") + f">{inner}</{tag}>"

    def links(self, n: int) -> str:
        items = [self.el("li", CLUTTER, self.el("a", CLUTTER, self.words(1, 4))) for _ in range(n)]
        return self.el("ul", CLUTTER, "".join(items))

    def clutter(self) -> str:
        kind = int(self.r.integers(10))
        words, links = self.words(3, 40), self.links(int(self.r.integers(2, 9)))
        p = lambda: self.el("p", CLUTTER, self.words(3, 50))
        c = CLUTTER
        return [
            lambda: self.el(self.pick("nav", "div"), c, links, self.pick("nav", "menu", "navbar", "main-menu")),
            lambda: self.el("div", c, self.pick(words, p(), p() + p()), self.pick("ad", "ads", "advert", "banner", "sponsored", "ad-slot")),
            lambda: self.el("aside", c, self.el("h3", c, self.words(1, 4)) + self.pick(links, p(), p() + p()), self.pick("", "sidebar", "related")),
            lambda: self.el("div", c, self.pick(links, p() + links), self.pick("sidebar", "widget", "related-posts")),
            lambda: self.el("section", c, "".join(self.el("div", c, p(), self.pick("comment", "reply")) for _ in range(3)), self.pick("comments", "discussion")),
            lambda: self.el("div", c, words, self.pick("cookie-notice", "consent", "newsletter", "alert", "notice")),
            lambda: self.el("form", c, self.el("label", c, self.words(1, 3)) + '<input name="q">' + self.el("p", c, words), self.pick("", "search", "login")),
            lambda: self.el("div", c, self.pick(links, self.el("a", c, self.words(1, 3))), self.pick("share", "social", "share-buttons")),
            lambda: self.el("nav", c, links),
            lambda: self.el("aside", c, words),
        ][kind]()

    def content(self) -> str:
        c = CONTENT
        out = [self.el("h1", c, self.words(2, 10))] if self.r.random() < 0.8 else []
        for _ in range(self.r.integers(1, 12)):
            x = self.r.random()
            if x < 0.7:
                t = self.words(1, 90) if self.r.random() < 0.8 else self.words(1, 6)
                out.append(self.el("p", c, self.pick(t, t, t + self.el("b", c, self.words(1, 9)), self.el("a", c, self.words(1, 5)) + t, self.el("b", c, t))))
            elif x < 0.78:
                out.append(self.el(self.pick("h2", "h3"), c, self.words(1, 8)))
            elif x < 0.86:
                out.append(self.el(self.pick("ul", "ol"), c, "".join(self.el("li", c, self.words(2, 20)) for _ in range(self.r.integers(2, 6)))))
            elif x < 0.92:
                out.append(self.el("blockquote", c, self.el("p", c, self.words(5, 40))))
            elif self.r.random() < 0.5:
                out.append(self.clutter())
        return "".join(out)

    def page(self) -> str:
        article = self.pick(
            lambda x: self.el("article", CONTENT, x), lambda x: self.el("article", CONTENT, x), lambda x: self.el("main", CONTENT, x),
            lambda x: self.el("div", CONTENT, x, self.pick("content", "article-body", "post", "entry-content", "story", "text")),
            lambda x: self.el("main", FRAME, self.clutter() + self.el("article", CONTENT, x) + self.clutter()),
        )(self.content())
        for _ in range(self.r.integers(0, 3)):
            article = self.el(self.pick("div", "section"), FRAME, self.pick("", self.clutter()) + article + self.pick("", self.clutter()), self.pick("", "wrapper", "page", "container", "main"))
        head = self.el("header", CLUTTER, self.words(1, 8) + self.links(3), self.pick("", "site-header")) if self.r.random() < 0.4 else ""
        foot = self.pick("footer", "footer", "div")
        foot = self.el(foot, CLUTTER, self.pick("&copy; ", "") + self.words(2, 30), "footer" if foot == "div" else "") if self.r.random() < 0.9 else ""
        around = [self.clutter() for _ in range(self.r.integers(0, 4))]
        k = int(self.r.integers(len(around) + 1))
        body = head + "".join(around[:k]) + article + "".join(around[k:]) + foot
        meta = f'<title data-l="2">{self.words(2, 8)}</title><style data-l="2">p{{}}</style>'
        return f'<html data-l="0"><head data-l="2">{meta}</head><body data-l="0">{body}</body></html>'


def training_set(pages: list[str], seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    w, xs, ys = _Writer(np.random.default_rng(seed)), [], []
    for _ in range(GENERATED):
        source = w.page()
        page = Page(source)
        given = [FRAME] + [int(m[1]) if m[1] else CLUTTER for m in re.finditer(r'<[a-z][a-z0-9]*(?: data-l="(\d)")?', source)]
        if len(given) == len(page.parent):
            xs.append(page.features())
            ys.append(np.array(given))
    for source in pages:
        page = Page(source)
        label = labels_by_tags(page)
        if label is not None:
            xs.append(page.features())
            ys.append(label)
    return np.concatenate(xs), np.concatenate(ys)


def train(pages: DataFrame, sample: int = SAMPLE) -> BoostedTrees:
    ids = pages.select(F.col("page_id").alias("_id")).dropna().distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = pages.join(F.broadcast(ids), F.col("page_id") == F.col("_id"), "left_semi").select("page_id", "html")
    got = rows.filter("html is not null").orderBy("page_id", F.xxhash64("html")).limit(sample).collect()
    return BoostedTrees(3).fit(*training_set([r.html for r in got]))


def main_texts(sources: list[str], trees: BoostedTrees) -> list[str]:
    out: list[str] = []
    for i in range(0, len(sources), 64):
        pages = [Page(s) for s in sources[i : i + 64]]
        scores = trees.log_probabilities(np.concatenate([p.features() for p in pages]))
        at = np.cumsum([0] + [len(p.parent) for p in pages])
        out += [p.text(p.decode(scores[a:b])) for p, a, b in zip(pages, at[:-1], at[1:], strict=True)]
    return out


def extract(pages: DataFrame, trees: BoostedTrees) -> DataFrame:
    """page_id, url, text, n_chars."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = main_texts(batch.column("html").to_pylist(), trees)
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    return batches(rows, make, "page_id long, url string, text string, n_chars long")
