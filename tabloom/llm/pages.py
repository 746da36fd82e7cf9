"""HTML extraction: a linear-chain conditional random field over DOM leaf blocks, decoded by Viterbi.

The model is fitted on the driver from a bounded sample of pages (``LABELLED`` of them). A page's label comes from its
own semantic elements (what stands in article or main, and in none of the elements for menus, notes, forms and the
like); each labelled page is also rebuilt in other layouts with the same blocks, so that class names, nesting and the
place on the page are learnt and not one template's tags. Every page is then parsed and decoded where it lies.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import only

LABELLED, LABELLED_CHARS, LAYOUTS = 200, 20_000, 4
JOINER = "\n\n"

#: Elements of the HTML standard by what they do to text.
BLOCK = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav noscript object ol optgroup option p pre search section
    select summary table tbody td template textarea tfoot th thead title tr ul video audio canvas""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title iframe noembed noframes xmp".split())
#: Elements without article text, with what cannot stand inside them: if that comes before the end tag, the end tag is missing.
ASIDE = {**dict.fromkeys("button select".split(), "p div h[1-6] article section main ul ol table blockquote header footer nav aside form"),
         **dict.fromkeys("svg object canvas video audio template".split(), "h[1-6] article section main nav header footer aside form")}
CLOSES_P = BLOCK - frozenset("body button caption head html label legend option optgroup select title td th tr tbody thead tfoot textarea".split())
SAME_LEVEL = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "option": ("option", ("select",)),
              "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}
#: Elements that label a page of the sample.
CONTENT_ELEMENTS, OTHER_ELEMENTS = frozenset(("article", "main")), frozenset("nav aside footer header form menu dialog search fieldset label".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?(?:false|until))|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_PARTS = re.compile(r"[A-Za-z][a-z]+|[A-Z]+|\d+")


class Leaf:
    """A run of text between block boundaries with the open elements above it."""

    __slots__ = ("path", "text", "linked")

    def __init__(self, path: tuple, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def _names(attributes: str) -> tuple[str, ...]:
    found = []
    for m in _NAMES.finditer(attributes):
        found += [p.lower() for p in _PARTS.findall(m[1] or m[2] or m[3] or "")]
    if _HIDDEN.search(attributes):
        found.append("hidden")
    return tuple(sorted(set(found)))


def leaves(page: str) -> list[Leaf]:
    """The page's leaf blocks in order, with character references decoded and white space made single."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[Leaf] = []
    text: list[str] = []
    linked = 0

    path: tuple = ()

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append(Leaf(path, joined, linked))
            text.clear()
        linked = 0

    def close(names, stop=()) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    def put(raw: str) -> None:
        nonlocal linked, path
        if raw:
            raw = html.unescape(raw)
            if raw.strip():
                if not any(x.strip() for x in text):  # a block stands under the elements open at its first word, inline ones left out
                    deepest = max((i for i, s in enumerate(stack) if s[0] in BLOCK), default=-1)
                    path = tuple(stack[: deepest + 1])
                if any(s[0] == "a" for s in stack):
                    linked += len(raw.strip())
            text.append(raw)

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at: m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCK:
            flush()
        if closing:
            close((name,), () if name in BLOCK else BLOCK)  # an inline element does not close blocks opened inside it
            continue
        if name in RAW and not attributes.endswith("/"):
            stop = re.compile(f"</{re.escape(name)}\\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end  # an HTML parser, too, reads these to the end of the page
            continue
        if name in ASIDE and not attributes.endswith("/"):
            stop = re.compile(f"</{re.escape(name)}\\b[^>]*>", re.I).search(page, at)
            inner = page[at: stop.start()] if stop else ""
            if stop and not re.search(rf"<(?:{'|'.join(ASIDE[name].split())})\b|</(?:article|main|section|body|html)\b", inner, re.I):
                at = stop.end()
            continue  # without an end tag only the tag itself goes
        if name in CLOSES_P and any(s[0] == "p" for s in stack):
            close(("p",), ("table", "button"))
        if name in SAME_LEVEL:
            kinds, stop = SAME_LEVEL[name]
            close(kinds.split(), stop)
        if name not in VOID and not (attributes.endswith("/") and name in ("path", "use")):
            stack.append((name, _names(attributes)))
    flush()
    return out


def path_features(path: tuple) -> list[str]:
    found = {"bias"}
    blocks = [(n, c) for n, c in path if n in BLOCK]
    if blocks:
        found.add("own " + blocks[-1][0])
        found.update(f"own .{c}" for c in blocks[-1][1])
    for name, names in path:
        found.add("in " + name)
        found.update("in ." + c for c in names)
    found.add(f"depth {min(8, len(blocks))}")
    found.add("path " + "/".join(".".join((n, *c)) for n, c in blocks[-3:]))
    return sorted(found)


def text_features(leaf: Leaf) -> list[str]:
    t = leaf.text
    n = t.count(" ") + 1
    return [f"words {min(6, n.bit_length())}", f"linked {round(4 * min(1.0, leaf.linked / len(t)))}"]


class Model:
    """Feature weights and transitions of a two-label chain (0: other, 1: main text)."""

    def __init__(self, weights: dict[str, tuple[float, float]], steps: list[list[float]]):
        self.weights, self.steps = weights, steps
        self.known: dict[tuple, float] = {}

    def _sum(self, names: list[str]) -> float:
        w = self.weights
        return sum((w[n][1] - w[n][0]) for n in names if n in w)

    def scores(self, blocks: list[Leaf]) -> list[float]:
        """How much each block speaks for main text."""
        out = []
        for i, leaf in enumerate(blocks):
            base = self.known.get(leaf.path)
            if base is None:
                if len(self.known) > 100_000:
                    self.known.clear()
                base = self.known[leaf.path] = self._sum(path_features(leaf.path))
            out.append(base + self._sum(text_features(leaf)) + self._sum(place_features(i, len(blocks))))
        return out

    def decode(self, blocks: list[Leaf]) -> list[int]:
        """Viterbi: the likeliest sequence of labels; ties go to 0."""
        (s00, s01), (s10, s11) = self.steps
        a, b, back = 0.0, 0.0, []
        for i, x in enumerate(self.scores(blocks)):
            if i == 0:
                a, b = 0.0, x
                continue
            to0, to1 = b + s10 > a + s00, b + s11 > a + s01
            back.append((to0, to1))
            a, b = (b + s10 if to0 else a + s00), (b + s11 if to1 else a + s01) + x
        if not blocks:
            return []
        labels = [int(b > a)]
        for to0, to1 in reversed(back):
            labels.append(int(to1 if labels[-1] else to0))
        return labels[::-1]


def place_features(i: int, n: int) -> list[str]:
    return [f"place {4 * i // n}"] + ["first"] * (i == 0) + ["last"] * (i == n - 1)


def fit(pages: list[tuple[list[Leaf], list[int]]], rounds: int = 120, decay: float = 1e-4, rate: float = 0.1) -> Model:
    """Maximum likelihood by gradient (Adam); forward and backward sums run over all pages at once."""
    index: dict[str, int] = {}
    rows, columns, label, where = [], [], [], []
    longest = max(len(b) for b, _ in pages)
    for p, (blocks, labels) in enumerate(pages):
        for i, (leaf, y) in enumerate(zip(blocks, labels)):
            for name in {*path_features(leaf.path), *text_features(leaf), *place_features(i, len(blocks))}:
                rows.append(len(label))
                columns.append(index.setdefault(name, len(index)))
            label.append(y)
            where.append((p, i))
    rows, columns, label, where = (np.array(x) for x in (rows, columns, label, where))
    p, t = where.T
    live = np.zeros((len(pages), longest), bool)
    live[p, t] = True
    gold = np.zeros((len(pages), longest, 2))
    gold[p, t, label] = 1
    gold_steps = np.einsum("pti,ptj->ij", gold[:, :-1], gold[:, 1:])
    w, s = np.zeros((len(index), 2)), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(s), np.zeros_like(s)]
    for k in range(1, rounds + 1):
        score = np.zeros((len(pages), longest, 2))
        score[p, t] = np.stack([np.bincount(rows, w[columns, y], len(label)) for y in (0, 1)], axis=1)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0]
        for i in range(1, longest):
            go = np.logaddexp(ahead[:, i - 1, 0, None] + s[0], ahead[:, i - 1, 1, None] + s[1]) + score[:, i]
            ahead[:, i] = np.where(live[:, i, None], go, ahead[:, i - 1])
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        for i in range(longest - 2, -1, -1):
            x = score[:, i + 1] + behind[:, i + 1]
            go = np.stack([np.logaddexp(s[y, 0] + x[:, 0], s[y, 1] + x[:, 1]) for y in (0, 1)], axis=1)
            behind[:, i] = np.where(live[:, i + 1, None], go, 0)
        share = np.where(live[..., None], np.exp(ahead + behind - total[:, None, None]), 0)
        pairs = np.exp(ahead[:, :-1, :, None] + s + (score + behind)[:, 1:, None, :] - total[:, None, None, None])
        step_gradient = gold_steps - np.where(live[:, 1:, None, None], pairs, 0).sum(axis=(0, 1))
        rest = (gold - share)[p, t]
        gradient = np.stack([np.bincount(columns, rest[rows, y], len(index)) for y in (0, 1)], axis=1)
        for value, g, j in ((w, gradient / len(label) - decay * w, 0), (s, step_gradient / len(label) - decay * s, 2)):
            moments[j] = 0.9 * moments[j] + 0.1 * g
            moments[j + 1] = 0.99 * moments[j + 1] + 0.01 * g * g
            value += rate * (moments[j] / (1 - 0.9 ** k)) / (np.sqrt(moments[j + 1] / (1 - 0.99 ** k)) + 1e-8)
    return Model({n: (float(w[i, 0]), float(w[i, 1])) for n, i in index.items()}, s.tolist())


def labelled(page: str) -> tuple[list[Leaf], list[int]]:
    """A page's blocks, labelled by its own semantic elements."""
    blocks = leaves(page)
    return blocks, [int(any(n in CONTENT_ELEMENTS for n, _ in b.path) and not any(n in OTHER_ELEMENTS for n, _ in b.path) and not _aside(b.path)) for b in blocks]


#: Usual class names, by the part of a page that they mark; used to rebuild labelled pages in other layouts.
PARTS = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs topnav tabs links pagination pager toc",
    "header": "header masthead topbar site branding logo banner tagline hero",
    "footer": "footer copyright legal colophon bottom imprint credits",
    "side": "sidebar side aside widget related recommended more trending popular rail teaser tags share social author bio",
    "advert": "ad ads advert advertisement advertising sponsored sponsor promo promotion commercial",
    "notice": "cookie cookies consent notice alert gdpr privacy banner popup modal overlay disclaimer paywall message hidden",
    "form": "form search subscribe newsletter signup login contact",
    "comments": "comments comment discussion replies reply respond responses thread disqus feedback",
}
MAIN = "content article post entry story body text main page blog single".split()
ELEMENTS = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form"}
_OTHER_NAMES = frozenset(w for p, names in PARTS.items() for w in names.split()) - frozenset("site banner more tags author hero page bottom text message side".split())


def _aside(path: tuple) -> bool:
    return any(c in _OTHER_NAMES for _, names in path for c in names)


def rebuilt(blocks: list[Leaf], labels: list[int], rng: random.Random) -> tuple[list[Leaf], list[int]]:
    """The same main text in another layout, with other parts of a page filled from the page's own words."""
    body = [(b.path[-1][0] if b.path and b.path[-1][0] in BLOCK else "p", b.text) for b, y in zip(blocks, labels) if y]
    words = " ".join(b.text for b in blocks).split() or ["x"]

    def some(low: int, high: int) -> str:
        n, at = rng.randint(low, high), rng.randrange(len(words))
        return html.escape(" ".join(words[at: at + n]) or words[0])

    def part(kind: str) -> str:
        names = rng.sample(PARTS[kind].split(), rng.randint(1, 2))
        tag = ELEMENTS[kind] if kind in ELEMENTS and rng.random() < 0.5 else rng.choice(("div", "div", "section", "aside" if kind in ("side", "advert") else "div"))
        mark = f' {rng.choice(("class", "id"))}="{rng.choice(("-", " ", "_")).join(names)}"' if tag in ("div", "section") or rng.random() < 0.6 else ""
        if kind == "menu":
            inner = "<ul>" + "".join(f'<li><a href="/x">{some(1, 3)}</a></li>' for _ in range(rng.randint(2, 7))) + "</ul>"
        elif kind == "comments":
            each = rng.choice(('<div class="comment"><p>{}</p></div>', "<li><b>{}</b><p>{}</p></li>", "<p>{}</p>"))
            inner = rng.choice(("<h3>{}</h3>", "<h2>{}</h2>", "")).format(some(1, 2)) + "".join(each.format(some(2, 40), some(2, 60)) for _ in range(rng.randint(1, 5)))
        elif kind == "form":
            inner = f"<label>{some(1, 3)}</label><input><p>{some(2, 12)}</p><button>{some(1, 2)}</button>"
        elif kind == "footer":
            inner = rng.choice(("&copy; {} &middot; {}", "<p>{}</p><p>&copy; {}</p>", '<a href="/x">{}</a> | <a href="/y">{}</a>')).format(some(1, 4), some(2, 20))
        else:
            inner = rng.choice(("{}", "<p>{}</p>", "<h3>{}</h3><p>{}</p>", '<p><a href="/x">{}</a></p>', '<ul><li><a href="/x">{}</a></li><li><a href="/y">{}</a></li></ul>')).format(some(1, 30), some(2, 30))
        return f"<{tag}{mark}>{inner}</{tag}>"

    inside, kind = [], ""
    for tag, text in body:
        roll = rng.random()
        if tag == "p" and (kind or roll < 0.15):  # lists, tables, quotes and headings belong to the text as well
            kind = kind or rng.choice(("li", "li", "td", "blockquote", "h2", "h3", "pre", "dd", "figcaption", "div"))
            outer = {"li": rng.choice(("ul", "ol")), "td": "table", "dd": "dl", "figcaption": "figure"}.get(kind, "")
            inner = f"<{kind}>{html.escape(text)}</{kind}>"
            inside.append(f"<{outer}>{inner}</{outer}>" if outer else inner)
            if rng.random() < 0.5:
                kind = ""
        else:
            inside.append(f"<{tag}>{html.escape(text)}</{tag}>")
        if rng.random() < 0.12:
            inside.append(part(rng.choice(("advert", "side", "notice", "form"))))
    if rng.random() < 0.3:
        inside.insert(0, f"<header><h1>{some(2, 9)}</h1></header>" if rng.random() < 0.3 else part("menu"))
    if rng.random() < 0.3:
        inside.append(part(rng.choice(("comments", "side", "form"))))
    tag = rng.choice(("article", "article", "main", "div", "div", "section"))
    mark = f' class="{rng.choice(("-", " ")).join(rng.sample(MAIN, rng.randint(1, 2)))}"' if tag in ("div", "section") or rng.random() < 0.4 else ""
    core = f"<{tag}{mark}>" + "".join(inside) + f"</{tag}>"
    if rng.random() < 0.4:
        outer = rng.choice(("main", "div", "section"))
        core = f'<{outer} class="{rng.choice(("wrapper", "container", "layout", "page", "row"))}">' + core + (part("side") if rng.random() < 0.5 else "") + f"</{outer}>"
    before = [part(k) for k in ("notice", "header", "menu", "advert", "side", "form") if rng.random() < 0.4]
    after = [part(k) for k in ("comments", "side", "advert", "form", "notice", "footer") if rng.random() < 0.45]
    rng.shuffle(before)
    found = leaves("<html><body>" + "".join(before) + core + "".join(after) + "</body></html>")
    main = [t for _, t in body]
    out, at = [], 0
    for leaf in found:  # the main blocks come in their order; everything else was put in
        outside = any(n in OTHER_ELEMENTS for n, _ in leaf.path) or _aside(leaf.path)
        hit = not outside and at < len(main) and leaf.text == main[at]
        out.append(int(hit))
        at += hit
    return found, out


def learn(pages: DataFrame, page: str = "html", sample: int = LABELLED, chars: int = LABELLED_CHARS, layouts: int = LAYOUTS) -> Model:
    """A model from the ``sample`` different pages of smallest hash that hold a semantic element for the main text; none: layouts of plain paragraphs."""
    text = F.col(f"`{page}`")
    some = only(pages, page).where(text.rlike("(?i)<(article|main)[\\s>]") & (F.length(text) <= chars)).select(text.alias("t"), F.xxhash64(text).alias("h"))
    # tasks hand on hashes only; then come at most ``sample`` pages of ``chars`` characters, one for each hash
    least = [r.h for r in some.select("h").distinct().orderBy("h").limit(sample).collect()]
    found = some.where(F.col("h") <= least[-1]).groupBy("h").agg(F.min("t").alias("t")).collect() if least else []
    rows = [r.t for r in sorted(found, key=lambda r: r.h)] or ["<article><h1>A b c</h1><p>" + "word and word, " * 30 + "end.</p><p>" + "some more words " * 20 + "end.</p></article>"]
    rng, data = random.Random(5), []
    for source in rows:
        blocks, labels = labelled(source)
        if any(labels):
            data.append((blocks, labels))
            data += [x for x in (rebuilt(blocks, labels, rng) for _ in range(layouts)) if x[0]]
    return fit(data)


def extract(pages: DataFrame, model: Model, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns with ``text`` (main blocks joined by an empty line; empty if none) and ``n_chars`` (its code points).

    Null and empty pages give an empty text. Rows are read one by one: repeated rows alike, other columns ignored.
    """
    weights, steps = model.weights, model.steps
    source = pages.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(keep)], F.col(f"`{page}`").alias("__page"))
    schema = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep] + ["text string", "n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = Model(weights, steps)
        for batch in batches:
            texts = []
            for p in batch["__page"]:
                blocks = leaves(p.as_py() or "")
                texts.append(JOINER.join(b.text for b, y in zip(blocks, local.decode(blocks)) if y))
            yield pa.RecordBatch.from_arrays([*[batch[f"__{i}"] for i in range(len(keep))], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             names=[*keep, "text", "n_chars"])

    return source.mapInArrow(run, schema)
