"""Main text of web pages by boosted trees over DOM nodes.

Elements and text runs of a page are nodes.  Each is described by its tag, its
attribute words and those of its ancestors, its depth, the density of text,
links and marks in its subtree, and its place among its siblings.  Gradient-
boosted trees give the chance that a node leads to main text.  A page is decoded
as a whole: the labelling with the greatest likelihood in which no node is kept
below a dropped one.

There are no labelled pages.  The trees learn from a bounded sample of pages
whose main part is named by its markup, and from variants of them in which the
naming is changed and side matter is put in, inside and outside the article.
"""

from __future__ import annotations

import dataclasses
import html
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfspark.llm.common import ship, shipped, whole_text

#: Pages that are learnt from, by the order of a hash of their ids, the longest
#: of them (characters), and variants of each.
SAMPLE, SAMPLE_CHARS, VARIANTS = 500, 30_000, 3
ROUNDS, DEPTH, RATE, BINS = 50, 4, 0.3, 32
#: Characters of markup that are decided together.
CHARS = 2_000_000

#: Attributes of a tag: a name, and a value in quotes or up to white space or
#: ">"; a quote inside a bare value or a name is part of it.  All repeats are
#: possessive, so no character is tried twice; a tag that the pattern does not
#: match is cut off by the end of the page.
ATTRIBUTE = r"""(=[^\s/>=]*+|[^\s/>=]++)(?>\s*+=\s*+(?>"([^"]*+)"|'([^']*+)'|((?!["'])[^\s>]*+))|(?!\s*+=))"""
TAG = re.compile(r"([a-zA-Z][^\s/>]*+)((?>[\s/]++|" + re.sub(r"\((?![?!])", "(?:", ATTRIBUTE) + ")*+)>")
ATTRIBUTES = re.compile(ATTRIBUTE)
NAMED = frozenset("class id role itemprop aria-label hidden".split())
WORDS = re.compile(r"[a-z]+")
MARKS = re.compile(r"[.,;:!?]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp".split())
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
LONG_NUMBER = re.compile(r"&#(?:0*+\d{8,}+|[xX]0*+[0-9a-fA-F]{7,}+);?")
BLOCK = frozenset(
    "html head body article main section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead "
    "tbody tfoot tr td th caption figure figcaption form fieldset legend blockquote pre address hr title option select "
    "button textarea details summary dialog noscript script style template center menu iframe".split())
#: An opening tag ends open elements of these kinds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",), "body": ("head",)}
#: Blocks that end an open paragraph.
PARAGRAPH_ENDS = BLOCK - frozenset("html head body script style title noscript template button option select textarea".split())

#: Kinds of tags; the place in the list is a feature.
KINDS = ("article main", "section div center", "p blockquote pre figure figcaption address", "h1 h2 h3 h4 h5 h6",
         "ul ol li dl dt dd menu", "table thead tbody tfoot tr td th caption", "nav", "header", "footer", "aside dialog",
         "form fieldset legend input select option button textarea label", "script style template noscript iframe svg canvas object",
         "head title meta link base", "a", "html body")
KIND = {tag: i for i, tags in enumerate(KINDS) for tag in tags.split()}
INLINE, TEXT = len(KINDS), len(KINDS) + 1
#: Groups of attribute words; a flag of a node and of its ancestors.
GROUPS = (
    "content article main post entry story articlebody maincontent postbody",
    "ad ads advert advertisement adverts banner promo promotion sponsor sponsored",
    "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs",
    "header masthead topbar logo", "footer copyright legal colophon bottom",
    "sidebar aside widget related recommended trending rail complementary",
    "comment comments reply replies discussion disqus respond",
    "cookie consent notice popup modal overlay alert gdpr newsletter subscribe signup subscription",
    "share social sharing login search form byline tags meta", "hidden none",
)
GROUP = {word: i for i, words in enumerate(GROUPS) for word in words.split()}
MAIN_GROUP = 0
#: Ancestor flags: kinds first, then groups.
FLAGS = len(KINDS) + len(GROUPS)
FEATURES = 2 + 2 * FLAGS + 1 + 17


@dataclasses.dataclass
class Page:
    """Nodes in page order."""

    parent: list[int]
    end: list[int]  # node after the subtree
    kind: list[int]
    flags: list[int]  # own
    above: list[int]  # of all ancestors
    depth: list[int]
    before: list[int]  # sibling before, or -1
    place: list[int]
    text: list[str]  # of text runs
    block: list[int]


def _flags(tag: str, attributes: str) -> int:
    kind = KIND.get(tag)
    flags = 1 << kind if kind is not None else 0
    for name, *values in ATTRIBUTES.findall(attributes):
        name = name.lower()
        if name == "hidden" or (name == "style" and "display:none" in "".join(values).replace(" ", "").lower()):
            flags |= 1 << len(KINDS) + GROUP["hidden"]
        elif name in NAMED:
            for word in WORDS.findall("".join(values).lower()):
                group = GROUP.get(word)
                if group is not None:
                    flags |= 1 << len(KINDS) + group
    return flags


def plain(content: str) -> str:
    """The text with its character references decoded; numbers beyond all code
    points give U+FFFD, however long they are."""
    return html.unescape(LONG_NUMBER.sub("&#1114112;", content)) if "&" in content else content


def _after(markup: str, what: str, at: int) -> int:
    """Behind the next ``what``, or the end of the page."""
    found = markup.find(what, at)
    return len(markup) if found < 0 else found + len(what)


def parse(markup: str) -> Page:
    """Nodes of a page, in one pass forward.

    Unclosed elements end with their parents; an end tag without a start is
    ignored.  A comment, declaration or tag that the page's end cuts off is
    dropped; "<" before anything but a letter, "/", "!" or "?" is text.
    """
    page = Page([-1], [0], [INLINE], [0], [0], [0], [-1], [0], [""], [0])
    parent, end, kind, flags, above, depth, before, place, text, block = (getattr(page, f.name) for f in dataclasses.fields(Page))
    stack, tags, last, children = [0], ["#root"], {}, {}
    opened: dict[str, list[int]] = {}  # places of a tag's open elements on the stack
    blocks = 0

    def add(k: int, f: int, content: str) -> int:
        top, node = stack[-1], len(parent)
        parent.append(top)
        end.append(node + 1)
        kind.append(k)
        flags.append(f)
        above.append(above[top] | flags[top])
        depth.append(len(stack))
        before.append(last.get(top, -1))
        place.append(children.get(top, 0))
        last[top], children[top] = node, place[node] + 1
        text.append(content)
        block.append(blocks)
        return node

    def close(to: int) -> None:
        while len(stack) > to:
            end[stack.pop()] = len(parent)
            open_ = opened.get(tags.pop())
            if open_:
                open_.pop()

    def said(stop: int) -> None:
        """Text from ``begun`` on."""
        if stop > begun:
            content = markup[begun:stop]
            if not content.isspace():
                add(TEXT, 0, plain(content))
            elif kind[-1] == TEXT and block[-1] == blocks:  # white space separates words of one block
                text[-1] += " "
            else:
                add(TEXT, 0, " ")

    at = begun = 0
    size = len(markup)
    while True:
        start = markup.find("<", at)
        if start < 0:
            said(size)
            break
        mark = markup[start + 1:start + 2]
        ends = mark == "/"
        if ends:
            mark = markup[start + 2:start + 3]
        if not (mark.isascii() and mark.isalpha()):
            if ends and mark == ">":
                at = start + 3
            elif ends or mark in ("!", "?"):
                if ends and not mark:
                    at = size
                elif markup.startswith("<!--", start):
                    at = _after(markup, "-->", start + 2)
                elif markup.startswith("<![CDATA[", start):
                    at = _after(markup, "]]>", start)
                else:
                    at = _after(markup, ">", start)
            else:
                at = start + 1  # "<" is text
                continue
            said(start)
            begun = at
            continue
        said(start)
        found = TAG.match(markup, start + 1 + ends)
        if not found:  # the page ends inside the tag
            break
        at = begun = found.end()
        tag = found[1].lower()
        is_block = tag in BLOCK
        if ends:
            if opened.get(tag):
                blocks += is_block
                close(opened[tag][-1])
            elif is_block:
                blocks += 1
            continue
        if tag == "br":
            add(TEXT, 0, " ")
            continue
        blocks += is_block
        for ended in ENDS.get(tag, ()):
            if ended in tags[-4:]:
                close(opened[ended][-1])
        if tag in PARAGRAPH_ENDS and opened.get("p"):
            close(opened["p"][-1])
        node = add(KIND.get(tag, INLINE), _flags(tag, found[2]), "")
        if tag in VOID or found[2].endswith("/") and not _bare(found[2]):
            continue
        opened.setdefault(tag, []).append(len(stack))
        stack.append(node)
        tags.append(tag)
        if tag in RAW:
            closing = RAW_END[tag].search(markup, at)
            stop = closing.start() if closing else size
            if stop > at:
                add(TEXT, 0, plain(markup[at:stop]) if tag in ("title", "textarea") else markup[at:stop])
            at = begun = _after(markup, ">", closing.end()) if closing else size
            close(len(tags) - 1)
            blocks += is_block
    close(0)
    end[0] = len(parent)
    return page


def _bare(attributes: str) -> bool:
    """Whether the attributes end with a value without quotes."""
    ended = False
    for found in ATTRIBUTES.finditer(attributes):
        ended = bool(found[4]) and found.end() == len(attributes)
    return ended


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """One row per node of all pages, and the first node of each page."""
    sizes = np.array([len(p.parent) for p in pages])
    first = np.append(0, np.cumsum(sizes))[:-1]
    base = np.repeat(first, sizes)

    def joined(name: str) -> np.ndarray:
        return np.concatenate([np.array(getattr(p, name), np.int64) for p in pages])

    parent = np.where(joined("parent") < 0, base, joined("parent") + base)
    end, before = joined("end") + base, joined("before")
    kind, flags, above, depth, place = (joined(n) for n in ("kind", "flags", "above", "depth", "place"))
    texts = [t for p in pages for t in p.text]
    chars = np.array([len(t) - t.count(" ") if t else 0 for t in texts], np.float64)
    marks = np.array([len(MARKS.findall(t)) if t else 0 for t in texts], np.float64)
    is_text = kind == TEXT
    link = 1 << KIND["a"]
    in_link = ((above | flags) & link) > 0
    n = len(kind)

    def below(values: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(values))
        return total[end] - total[np.arange(n)]

    sub_chars, sub_link, sub_marks = below(chars), below(chars * in_link), below(marks)
    sub_nodes, sub_runs = (end - np.arange(n)).astype(np.float64), below((is_text & (chars > 0)).astype(float))
    paragraphs = below((kind == KIND["p"]).astype(float))
    siblings = np.bincount(parent, minlength=n)[parent]
    previous = np.where(before >= 0, sub_chars[np.maximum(before + base, 0)], 0)
    following = np.zeros(n)
    has = before >= 0
    following[(before + base)[has]] = sub_chars[has]
    whole = sub_chars[base]
    own = ((flags[:, None] >> np.arange(FLAGS)) & 1).astype(np.float64)
    over = ((above[:, None] >> np.arange(FLAGS)) & 1).astype(np.float64)
    rows = np.column_stack([
        kind, depth, own, over, np.log1p(sub_chars), np.log1p(chars), sub_link / np.maximum(sub_chars, 1),
        sub_marks / np.maximum(sub_chars, 1), sub_chars / sub_nodes, np.log1p(sub_runs), sub_chars / np.maximum(sub_runs, 1),
        np.log1p(sub_nodes), np.log1p(paragraphs), np.log1p(siblings), np.log1p(place), place / np.maximum(siblings, 1),
        sub_chars / np.maximum(sub_chars[parent], 1), np.log1p(previous), np.log1p(following), sub_chars / np.maximum(whole, 1),
        kind[parent], np.log1p(sub_chars[parent]),
    ])
    return rows.astype(np.float32), first


@dataclasses.dataclass
class Trees:
    """Boosted regression trees, complete to DEPTH, as arrays."""

    bias: float
    feature: np.ndarray  # rounds x inner nodes
    limit: np.ndarray
    leaf: np.ndarray  # rounds x leaves

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.bias)
        every = np.arange(len(rows))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf):
            at = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (rows[every, feature[at]] > limit[at])
            total += leaf[at - (2 ** DEPTH - 1)]
        return total


def fit_trees(rows: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> Trees:
    """Logistic boosting with histograms of quantile bins, a level at a time."""
    n, width = rows.shape
    cuts = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(c, rows[:, j], side="left").astype(np.uint8) for j, c in enumerate(cuts)])
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    inner, leaves, bins = 2 ** DEPTH - 1, 2 ** DEPTH, BINS + 1
    feature, limit = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf)
    leaf = np.zeros((rounds, leaves))
    score = np.full(n, bias)
    for r in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = labels - p, p * (1 - p) + 1e-6
        at = np.zeros(n, np.int64)  # node within its level
        for level in range(DEPTH):
            nodes = 2 ** level
            best, first = np.full(nodes, 1e-6), nodes - 1
            chosen, where = np.zeros(nodes, np.int64), np.full(nodes, bins)
            for j in range(width):
                if not len(cuts[j]):
                    continue
                key = at * bins + binned[j]
                gs = np.bincount(key, g, nodes * bins).reshape(nodes, bins)
                hs = np.bincount(key, h, nodes * bins).reshape(nodes, bins)
                gl, hl = np.cumsum(gs, axis=1)[:, :len(cuts[j])], np.cumsum(hs, axis=1)[:, :len(cuts[j])]
                ga, ha = gs.sum(axis=1)[:, None], hs.sum(axis=1)[:, None]
                gain = gl ** 2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga ** 2 / (ha + 1)
                split = gain.argmax(axis=1)
                value = gain[np.arange(nodes), split]
                better = value > best
                best, chosen, where = np.where(better, value, best), np.where(better, j, chosen), np.where(better, split, where)
            for node in np.flatnonzero(where < bins):
                feature[r, first + node], limit[r, first + node] = chosen[node], cuts[chosen[node]][where[node]]
            at = 2 * at + (binned[chosen[at], np.arange(n)] > where[at])
        leaf[r] = RATE * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + 1)
        score += leaf[r][at]
    return Trees(bias, feature, limit, leaf)


def decode(page: Page, score: np.ndarray) -> np.ndarray:
    """Nodes kept: the likeliest labels with no kept node below a dropped one.
    ``score`` is the log-odds of keeping; dropping counts as 0.  A run of white
    space says nothing and follows its parent."""
    n = len(page.parent)
    kept_value = score.astype(float).tolist()
    parent = page.parent
    blank = [t.isspace() for t in page.text]
    for node in range(n):
        if blank[node]:
            kept_value[node] = 0.0
    for node in range(n - 1, 0, -1):  # a dropped subtree is worth 0
        if kept_value[node] > 0:
            kept_value[parent[node]] += kept_value[node]
    keep = [False] * n
    keep[0] = True
    for node in range(1, n):
        keep[node] = keep[parent[node]] and (kept_value[node] > 0 or blank[node])
    return np.array(keep)


def block_text(page: Page, keep: np.ndarray) -> str:
    """Kept text runs; runs of one block are joined, white space is one space,
    blocks are lines."""
    lines, current, parts = [], None, []
    for node in np.flatnonzero(keep):
        if page.kind[node] == TEXT:
            if page.block[node] != current:
                lines.append("".join(parts))
                current, parts = page.block[node], []
            parts.append(page.text[node])
    lines.append("".join(parts))
    lines = [" ".join(line.split()) for line in lines]
    return "\n".join(line for line in lines if line)


def extract(trees: Trees, markups: list[str]) -> list[str]:
    """Main texts of whole pages."""
    out, at = [], 0
    while at < len(markups):
        end, chars = at, 0
        while end < len(markups) and (end == at or chars + len(markups[end]) <= CHARS):
            chars += len(markups[end])
            end += 1
        pages = [parse(m) for m in markups[at:end]]
        rows, first = features(pages)
        score = trees.score(rows)
        for page, begin in zip(pages, first):
            out.append(block_text(page, decode(page, score[begin:begin + len(page.parent)])))
        at = end
    return out


SIDE_KINDS = sum(1 << KIND[t] for t in ("nav", "header", "footer", "aside", "form", "script", "head"))
SIDE_GROUPS = sum(1 << len(KINDS) + i for i in range(1, len(GROUPS)))
MAIN = 1 << KIND["article"] | 1 << len(KINDS) + MAIN_GROUP


def named_labels(page: Page) -> np.ndarray | None:
    """1 for nodes that lead to text which the markup names as main, or None
    if it names no main part."""
    kind, flags, above = (np.array(x, np.int64) for x in (page.kind, page.flags, page.above))
    around = flags | above
    main = (kind == TEXT) & ((above & MAIN) > 0) & ((around & (SIDE_KINDS | SIDE_GROUPS)) == 0)
    main &= np.array([bool(t and not t.isspace()) for t in page.text])
    if not main.any():
        return None
    total = np.append(0, np.cumsum(main))
    return ((total[np.array(page.end)] - total[:-1]) > 0).astype(float)


def variant(markup: str, draw: random.Random) -> str:
    """The page with its main part named otherwise and side matter put in; the
    words of the side matter are taken from the page itself."""
    words = WORDS.findall(re.sub(r"<[^>]*>", " ", markup).lower()) or ["text"]

    def said(low: int, high: int) -> str:
        return " ".join(draw.choice(words) for _ in range(draw.randint(low, high)))

    def listed(low: int, high: int) -> str:
        return "<ul>" + "".join(f'<li><a href="#">{said(1, 3)}</a></li>' for _ in range(draw.randint(low, high))) + "</ul>"

    def shaped(content: str) -> str:
        parts, size = content.split(), draw.randint(2, 12)
        parts = [" ".join(parts[i:i + size]) for i in range(0, len(parts), size)] or [content]
        kind = draw.choice(("ul", "ol", "table", "blockquote", "pre", "h2"))
        if kind in ("ul", "ol"):
            return f"<{kind}>" + "".join(f"<li>{x}</li>" for x in parts) + f"</{kind}>"
        if kind == "table":
            return "<table>" + "".join(f"<tr><td>{x}</td></tr>" for x in parts) + "</table>"
        return f"<{kind}>{parts[0]}</{kind}><p>{' '.join(parts[1:])}</p>"

    if draw.random() < 0.6:  # short paragraphs are main text as well
        often = draw.random()
        markup = re.sub(r">([^<]{20,})(?=<)", lambda m: ">" + (
            " ".join(m[1].split()[:draw.randint(1, 9)]) if draw.random() < often else m[1]), markup)
    if draw.random() < 0.3:  # little or nothing beside the main part
        markup = re.sub(r"<(nav|footer|head|style|script)\b[^>]*>.*?</\1>", "", markup, flags=re.S)
    if draw.random() < 0.5:  # main text stands in lists, tables and quotations too
        found = re.search(r"<article[^>]*>(.*)</article>", markup, re.S)
        if found:
            markup = markup[:found.start(1)] + re.sub(
                r"<p>([^<]+)</p>", lambda m: shaped(m[1]) if draw.random() < 0.4 else m[0], found[1]) + markup[found.end(1):]
    name = draw.choice(['article', 'main', 'div class="content"', 'div id="main-content"', 'section class="post"',
                        'div class="article-body"', 'div class="entry-content"', 'div role="main"'])
    markup = re.sub(r"<article[^>]*>", f"<{name}>", markup)
    markup = markup.replace("</article>", f"</{name.split()[0]}>")
    side = [
        lambda: f"<header><p>{said(2, 30)}</p>{listed(2, 5)}</header>",
        lambda: f'<aside class="sidebar"><h3>{said(1, 4)}</h3>{listed(2, 6)}<p>{said(5, 60)}</p></aside>',
        lambda: f'<div class="{draw.choice(["cookie-notice", "notice", "newsletter", "popup"])}"><p>{said(5, 50)}</p><button>{said(1, 2)}</button></div>',
        lambda: f'<div class="{draw.choice(["ad", "advert", "banner", "sponsored"])}">{said(3, 40)}</div>',
        lambda: f'<form><label>{said(1, 3)}</label><input type="text"><button>{said(1, 2)}</button></form>',
        lambda: f'<section class="{draw.choice(["comments", "comment-list", "replies"])}">' + "".join(
            f'<div class="comment"><b>{said(1, 2)}</b><p>{said(5, 80)}</p></div>' for _ in range(draw.randint(1, 4))) + "</section>",
        lambda: f"<nav>{listed(2, 8)}</nav>",
        lambda: f'<div class="{draw.choice(["related", "share", "social", "breadcrumb"])}">{listed(1, 4)}</div>',
        lambda: f"<footer><p>{said(4, 50)}</p></footer>",
        lambda: f'<script>var a = "{said(2, 30)}";</script><style>p {{ margin: 0 }}</style>',
    ]
    places = [m.end() for m in re.finditer(r"<body[^>]*>|</p>|</h1>|</article>|</main>|</nav>", markup)]
    for at in sorted(draw.sample(places, min(len(places), draw.randint(0, 5))), reverse=True):
        markup = markup[:at] + draw.choice(side)() + markup[at:]
    return markup


def trained(pages: DataFrame, page_id: str = "page_id", markup: str = "html", sample: int = SAMPLE) -> Trees:
    """Fit on at most ``sample`` pages and their variants.  The nodes are
    described where the pages are.  If none names its main part, every node
    that is not plainly side matter is kept."""
    short = pages.where((F.char_length(whole_text(markup)) <= SAMPLE_CHARS) & F.col(page_id).isNotNull())
    chosen = short.select(F.col(page_id).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(sample)

    def described(frames):
        for frame in frames:
            for key, source in zip(frame["id"], frame["html"]):
                draw = random.Random(int(key) if isinstance(key, (int, np.integer)) else str(key))
                for i in range(1 + VARIANTS):
                    page = parse(variant(source, draw) if i else source)
                    labels = named_labels(page)
                    if labels is not None:
                        rows, _ = features([page])
                        yield pd.DataFrame({"id": [key], "i": [i], "rows": [rows.astype("<f4").tobytes()],
                                            "labels": [labels.astype("<f4").tobytes()]})

    found = short.select(F.col(page_id).alias("id"), whole_text(markup).alias("html")).join(F.broadcast(chosen), "id")
    schema = f"id {found.schema['id'].dataType.simpleString()}, i int, rows binary, labels binary"
    made = found.mapInPandas(described, schema).toPandas().sort_values(["id", "i"])
    if made.empty:
        inner = 2 ** DEPTH - 1
        return Trees(1.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    width = features([parse("")])[0].shape[1]
    rows = np.concatenate([np.frombuffer(b, "<f4").reshape(-1, width) for b in made.pop("rows")])
    return fit_trees(rows, np.concatenate([np.frombuffer(b, "<f4") for b in made["labels"]]).astype(np.float64))


def texts(pages: DataFrame, trees: Trees, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.  Null markup
    is the empty page; a page without main text has an empty one."""
    shared = ship(pages.sparkSession, trees)

    @F.pandas_udf("string")
    def text(markups: pd.Series) -> pd.Series:
        return pd.Series(extract(shipped(shared), markups.tolist()), dtype=object)

    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), text(whole_text(markup)).alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("long"))
