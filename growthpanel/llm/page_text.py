"""Main text of web pages: boosted trees judge every DOM node, and the judgements are decoded along the tree."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthpanel.llm.boosting import Trees, boost

#: most pages of the table that are learned from, taken by a hash, beside as many made-up layouts as said
SAMPLE, LAYOUTS, SEED = 400, 800, 42
#: pages that are judged together
BATCH = 256

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose content is never text of the page
SILENT = frozenset("script style title template svg iframe select textarea canvas audio video datalist".split())
#: elements whose content is no markup, whatever it looks like; only the first two reach to the end of a page
_RAW = ("script", "style", "title", "textarea", "iframe")
#: silent elements that hold no blocks: unclosed ones end at the next block
_FLAT = frozenset("title svg iframe select textarea datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img input"
    " math semantics annotation mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle mpadded mphantom menclose".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dt dd".split()
)
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table article section div body html main aside nav header footer form blockquote td th".split())

_token = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>|[^<]+|<""", re.S
)
_attribute = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_letters = re.compile(r"[a-z]+")
_block = re.compile(r"<(p|h1|h2|ul|blockquote|table|pre|div)>")

TAGS = "body article main section div p heading list li table nav header footer aside form figure quote pre other".split()
_TAG = {t: i for i, t in enumerate(TAGS)}
_KIND = {f"h{i}": "heading" for i in range(1, 7)} | {"ul": "list", "ol": "list", "dl": "list", "menu": "list", "dt": "li", "dd": "li", "blockquote": "quote"}
_KIND |= {t: "table" for t in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption")} | {"figcaption": "figure", "fieldset": "form", "html": "body"}

#: words in class, id, role and the like, by what they tell
TOKENS = {
    "text": "article articlebody body content entry hentry main mainbody post prose story text copy blog paragraph",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc tabs pagination pager skip toolbar",
    "head": "header masthead banner branding logo top topbar",
    "foot": "footer foot copyright legal colophon bottom",
    "side": "sidebar side aside complementary rail widget widgets column secondary",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion affiliate dfp taboola outbrain",
    "notice": "cookie cookies consent gdpr notice alert notification popup modal overlay paywall subscribe newsletter signup dialog toast disclaimer",
    "comment": "comment comments commentlist respond reply replies disqus discussion feedback reader readers",
    "more": "related recommended recommendations more popular trending share sharing social follow tags tag categories author bio meta byline links",
    "form": "form search login input contact survey poll",
}
_GROUP = {w: i for i, words in enumerate(TOKENS.values()) for w in words.split()}
_NEGATIVE = range(1, len(TOKENS))
#: elements and token groups that say what a sampled page's node is, for learning only
_OUT = frozenset("nav header footer aside form".split())


@dataclass
class Page:
    """Nodes in page order, a parent before its children; blocks of text with the node that holds them."""

    parent: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    groups: list[tuple[int, ...]] = field(default_factory=list)
    marks: list[str] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def read_page(html: str, marked: bool = False) -> Page:
    """A forgiving reader: unclosed and stray tags do no harm, scripts and other silent content are skipped.

    What scripts, styles, titles and the like hold is skipped where they begin as elements, not where a comment, an
    attribute or another such element names them. With ``marked``, ids that begin with ``label-`` are labels of made-up layouts.
    A silent element ends with its own end tag or that of an element it is in. One that is never closed and cannot
    hold blocks ends at the next block, too. Tags in it are followed, so that theirs end nothing outside.
    """
    page, stack, tags, buffer, linked, link, silent, inner, flat = Page(), [], [], [], 0, 0, "", [], False
    places: dict[str, list[list[int]]] = {}

    def unclosed(tag: str, at: int) -> bool:
        """Whether no end tag follows before the element's like begins."""
        if tag not in places:
            marks = [(m.start(), bool(m.group(1))) for m in re.finditer(rf"<(/?){tag}(?![^\s/>])", html, re.I)]
            places[tag] = [[i for i, e in marks if e == end] for end in (False, True)]
        begins, ends = places[tag]
        b, e = bisect_left(begins, at), bisect_left(ends, at)
        return e == len(ends) or (tag != "svg" and b < len(begins) and begins[b] < ends[e])

    def open_(tag: str, attributes: str) -> None:
        found = []
        for name, *values in _attribute.findall(attributes):
            value = "".join(values)
            if marked and name.lower() == "id" and value.startswith("label-"):
                page.marks.append(f"{len(page.parent)}:{value[6:]}")
            else:
                found += [_GROUP[w] for w in _letters.findall(value.lower()) if w in _GROUP]
        page.parent.append(stack[-1] if stack else -1)
        page.kind.append(_TAG.get(_KIND.get(tag, tag), _TAG["other"]))
        page.groups.append(tuple(found))
        stack.append(len(page.parent) - 1)
        tags.append(tag)

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                if not stack:
                    open_("body", "")
                page.blocks.append((stack[-1], text, min(linked, len(text))))
            buffer.clear()
        linked = 0

    def close(which, scope=frozenset()) -> None:
        for i in range(len(tags) - 1, -1, -1):
            if tags[i] in which:
                flush()
                del stack[i:], tags[i:]
                return
            if tags[i] in scope:
                return

    at = 0
    while m := _token.match(html, at):
        piece, at = m.group(), m.end()
        tag = m.group(2) or m.group(5)
        if tag is None:
            if not silent and piece[:2] not in ("<!", "<?"):
                text = unescape(piece)
                buffer.append(text)
                linked += len(text) if link else 0
            continue
        tag, ends, attributes = tag.lower(), m.group(1) or m.group(4), m.group(3) or m.group(6) or ""
        if tag in _RAW and not ends and (tag in _RAW[:2] or not unclosed(tag, at)):
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            buffer += [] if silent else [" "]
            continue
        if silent:
            if ends and tag in inner:
                while inner.pop() != tag:
                    pass
                continue
            if ends and tag == silent:
                silent = ""
                continue
            if ends and tag in open_tags:
                silent = ""
            elif flat and (tag in _CLOSES_P or tag in ("body", "head", "html")):
                silent = ""
            else:
                if not ends and tag not in VOID and not attributes.endswith("/"):
                    inner.append(tag)
                continue
        if tag == "head":  # no node: it holds no text but the silent title
            close(("noscript", "object"), _SCOPE)
            continue
        if ends:
            if tag == "a":
                link = max(0, link - 1)
            elif tag not in INLINE and tag not in VOID:
                close((tag,))
                link = 0
        elif tag in SILENT:
            if not attributes.endswith("/"):
                silent, inner, open_tags = tag, [], {*tags, "head"}
                flat = tag in _FLAT and unclosed(tag, m.end())
            buffer.append(" ")
        elif tag in VOID or tag in INLINE:
            if tag == "a":
                link += 1
            elif tag in ("br", "wbr", "hr", "img", "input"):
                buffer.append("" if tag == "wbr" else " ")
                if tag == "hr":
                    flush()
        else:
            flush()
            link = 0
            if tag in _CLOSES_P:
                close(("p",), _SCOPE)
            if tag in _SAME:
                close(_SAME[tag], _SCOPE - {"td", "th"} if tag in ("td", "th", "tr") else _SCOPE)
            if tag == "body":
                close(("noscript", "object"), _SCOPE)
            if not (tag in ("html", "body") and stack):
                open_(tag, attributes)
    flush()
    return page


def features(page: Page) -> np.ndarray:
    """One row per node: tag, attribute tokens of its own and of its ancestors, subtree density, depth, siblings."""
    n, g = len(page.parent), len(TOKENS)
    parent = np.array(page.parent, np.int64)
    chars, links, dots, words, inner = (np.zeros(n) for _ in range(5))
    for node, text, linked in page.blocks:
        chars[node] += len(text)
        links[node] += linked
        dots[node] += text.count(".") + text.count(",")
        words[node] += text.count(" ") + 1
    own_chars = chars.copy()
    own = np.zeros((n, g))
    for i, groups in enumerate(page.groups):
        for k in groups:
            own[i, k] = 1
    kind = np.array(page.kind)
    above, depth, out_above = np.zeros((n, g)), np.zeros(n), np.zeros(n)
    is_out = np.isin(kind, [_TAG[t] for t in _OUT])
    text_above = np.zeros(n)
    is_text = np.isin(kind, [_TAG["article"], _TAG["main"]])
    place, count, last = np.zeros(n), np.zeros(n), {}
    nodes, paragraphs = np.ones(n), (kind == _TAG["p"]).astype(float)
    items = (kind == _TAG["li"]).astype(float)
    for i, p in enumerate(page.parent):
        if p >= 0:
            above[i] = np.maximum(above[p], own[p])
            depth[i] = depth[p] + 1
            out_above[i] = max(out_above[p], is_out[p])
            text_above[i] = max(text_above[p], is_text[p])
            place[i] = count[p]
            count[p] += 1
    order = np.cumsum(own_chars) - own_chars
    for i in range(n - 1, 0, -1):
        p = parent[i]
        if p >= 0:
            for x in (chars, links, dots, words, nodes, paragraphs, items):
                x[p] += x[i]
            inner[p] += 1
    total = max(1.0, own_chars.sum())
    has = parent >= 0
    family = np.where(has, count[np.maximum(parent, 0)], 1.0)
    parent_chars = np.where(has, chars[np.maximum(parent, 0)], chars)
    previous = np.zeros(n)
    for i, p in enumerate(page.parent):
        previous[i] = last.get(p, 0.0)
        last[p] = links[i] / max(1.0, chars[i])
    density = links / np.maximum(1.0, chars)
    # text of a node's own paragraphs, against the node with the most: the article's element, whatever its name
    prose = own_chars * np.isin(kind, [_TAG["p"], _TAG["pre"], _TAG["quote"]]) * (links <= 0.5 * chars)
    held = own_chars * np.isin(kind, [_TAG[t] for t in ("div", "section", "article", "main", "body", "table", "other")]) * (links <= 0.5 * chars)
    np.add.at(held, np.maximum(parent, 0), prose * has)
    held *= ~is_out
    held /= max(1.0, held.max())
    held_above = np.zeros(n)
    for i, p in enumerate(page.parent):
        if p >= 0:
            held_above[i] = max(held_above[p], held[p])
    held_below = held.copy()
    for i in range(n - 1, 0, -1):
        if parent[i] >= 0:
            held_below[parent[i]] = max(held_below[parent[i]], held_below[i])
    up = np.maximum(parent, 0)
    columns = [
        held, held[up] * has, held_above, held_below, chars[up] / total * has, density[up] * has, np.log1p(paragraphs[up]) * has, kind[up] * has,
        kind, np.log1p(chars), np.log1p(own_chars), density, dots / np.maximum(1.0, words), np.log1p(words),
        chars / np.maximum(1.0, nodes), np.log1p(nodes), np.log1p(paragraphs), np.log1p(items), chars / total, order / total,
        depth, place, family, place / np.maximum(1.0, family), chars / np.maximum(1.0, parent_chars), (parent_chars - chars) / np.maximum(1.0, family - 1),
        previous, density[np.maximum(parent, 0)] * has, out_above, text_above, is_out.astype(float), is_text.astype(float), inner,
        own[:, 1:].sum(1), above[:, 1:].max(1, initial=0),
    ]
    columns += [(kind == k).astype(float) for k in range(len(TAGS))]
    return np.concatenate([np.stack(columns, 1), own, above], 1)


def decode(parent: list[int], odds: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the likeliest choice in which nothing is kept below a node that is dropped."""
    n = len(parent)
    keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)  # log-probabilities
    for i in range(n - 1, -1, -1):  # children come after their parents
        if parent[i] >= 0:
            keep[parent[i]] += max(keep[i], drop[i])
            drop[parent[i]] += drop[i]
    kept = np.zeros(n, bool)
    for i, p in enumerate(parent):
        kept[i] = (p < 0 or kept[p]) and keep[i] >= drop[i]
    return kept


def silver_labels(page: Page) -> np.ndarray:
    """What a sampled page's own tags and tokens say: inside an article or main element, outside of all that is not text."""
    inside, outside = np.zeros(len(page.parent), bool), np.zeros(len(page.parent), bool)
    text, out = {_TAG["article"], _TAG["main"]}, {_TAG[t] for t in _OUT}
    for i, p in enumerate(page.parent):
        inside[i] = page.kind[i] in text or (p >= 0 and inside[p])
        outside[i] = page.kind[i] in out or any(k in _NEGATIVE for k in page.groups[i]) or (p >= 0 and outside[p])
    return inside & ~outside


def made_labels(page: Page) -> np.ndarray:
    """Labels of a made-up layout: a node has its own mark, or its parent's."""
    labels, marks = np.zeros(len(page.parent), bool), dict(m.split(":") for m in page.marks)
    for i, p in enumerate(page.parent):
        mark = marks.get(str(i))
        labels[i] = mark == "1" if mark else p >= 0 and labels[p]
    return labels


def with_ancestors(page: Page, labels: np.ndarray) -> np.ndarray:
    """The labels to learn: what holds text is to be kept, too."""
    labels = labels.copy()
    for i in range(len(labels) - 1, 0, -1):
        if labels[i] and page.parent[i] >= 0:
            labels[page.parent[i]] = True
    return labels


def made_layout(rng: np.random.Generator) -> str:
    """A page of a common layout with invented words; its parts are marked as text (1) or not (0).

    The article stands in an element that names it, in one whose words also name something else, in a nameless one, in
    a table's cell, or straight in its parent.
    """
    pick = lambda options: options[int(rng.integers(len(options)))]
    word = lambda: "".join(pick(["ba", "do", "ki", "lu", "mer", "ston", "ti", "ra", "ven", "sho"]) for _ in range(rng.integers(1, 5)))
    line = lambda a, b: " ".join(word() + (pick([",", ".", ""]) if rng.random() < 0.15 else "") for _ in range(rng.integers(a, b)))
    link = lambda a=1, b=4: f'<a href="/x">{line(a, b)}</a>'
    token = lambda group: pick(TOKENS[group].split())

    def box(group: str, content: str, tags=("div", "section", "div")) -> str:
        own = f'{pick(["class", "class", "id"])}="{token(group)}{pick(["", "-box", " wrapper", "-list", "-1"])}"' if rng.random() < 0.9 else ""
        return f'<{(t := pick(tags))} {own} id="label-0">{content}</{t}>'

    def links(low=3, high=9) -> str:
        return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.integers(low, high))) + "</ul>"

    def prose() -> str:
        return "".join(f"<p>{line(1, 90)}</p>" if rng.random() < 0.8 else f"<p>{line(10, 40)} {link()} {line(5, 30)}</p>" for _ in range(rng.integers(1, 4)))

    noise = {
        "menu": lambda: box("menu", links(), ("nav", "div", "ul", "nav")),
        "head": lambda: box("head", f"<h1>{link()}</h1><p>{line(2, 8)}</p>" if rng.random() < 0.5 else links(), ("header", "div")),
        "foot": lambda: box("foot", f"<p>&copy; {line(2, 25)}</p>" if rng.random() < 0.6 else f"&copy; {line(2, 12)}" + links(), ("footer", "div", "footer")),
        "side": lambda: box("side", f"<h3>{line(1, 3)}</h3>" + (links() if rng.random() < 0.6 else prose()), ("aside", "div", "aside")),
        "ad": lambda: box("ad", line(3, 30) if rng.random() < 0.5 else f"<p>{line(3, 25)}</p>", ("div", "aside", "div")),
        "notice": lambda: box("notice", f"<p>{line(8, 50)}</p>" if rng.random() < 0.7 else line(8, 40)),
        "comment": lambda: box("comment", f"<h3>{line(1, 3)}</h3>" * int(rng.integers(2)) + "".join(pick([f"<p>{line(4, 60)}</p>", f'<div class="comment"><b>{word()}</b><p>{line(3, 50)}</p></div>', f"<li>{line(4, 40)}</li>"]) for _ in range(rng.integers(1, 6)))),
        "more": lambda: box("more", f"<h4>{line(1, 3)}</h4>" + links()),
        "form": lambda: f'<form id="label-0" class="{token("form")}"><p>{line(2, 12)}</p><label>{word()}</label><input></form>',
    }
    some = lambda names, odds: "".join(noise[x]() for x in names if rng.random() < odds)
    shape = pick(["named"] * 6 + ["mixed", "mixed", "plain", "bare", "table", "table"])
    title = f"<h1>{line(2, 10)}</h1>"
    body = [title if rng.random() < 0.8 else f'<header id="label-1">{title}</header>'] if rng.random() < 0.8 else []
    short = shape == "named" and rng.random() < 0.25
    if short:
        body.append(pick([lambda: f"<p>{line(1, 9)}</p>", lambda: f"<p><b>{line(1, 9)}<br>", lambda: line(1, 12)])())
    for _ in range(0 if short else rng.integers(1, 12)):
        body.append(pick([
            lambda: f"<p>{line(1, 120)}</p>", lambda: f"<p>{line(20, 150)}</p>", lambda: f"<p>{line(5, 60)} {link()} {line(5, 40)}</p>", lambda: f"<p><b>{line(1, 20)}<br><p>{line(5, 60)}</p>",
            lambda: f"<h2>{line(1, 8)}</h2>", lambda: "<ul>" + "".join(f"<li>{line(2, 25)}</li>" for _ in range(rng.integers(2, 6))) + "</ul>",
            lambda: f"<blockquote><p>{line(5, 40)}</p></blockquote>", lambda: f"<table><tr><td>{line(1, 6)}</td><td>{line(1, 6)}</td></tr></table>", lambda: f"<pre>{line(3, 30)}</pre>", lambda: f"<div>{line(10, 60)}</div>",
        ])())
    for name in ("ad", "notice", "comment", "more", "form", "side"):
        if rng.random() < 0.2:
            body.insert(int(rng.integers(len(body) + 1)), noise[name]())
    own = f'class="{token("text")}{pick(["", "-body", " wide"])}"' if rng.random() < 0.7 else ""
    tag = pick(["article", "main", "div", "section", "article"])
    own = own or ('class="content"' if tag in ("div", "section") else "")
    if shape in ("mixed", "plain"):
        tag, words = pick(["div", "section", "div"]), [token("text"), token(pick(["head", "side", "side", "foot", "more", "comment"]))]
        own = pick(["", f'id="{word()}"', f'class="{word()} {word()}"'])
        if shape == "mixed":
            rng.shuffle(words)
            own = f'{pick(["class", "id"])}="{pick(["-", " ", "-with-"]).join(words)}"'
    text = f'<{tag} {own} id="label-1">{"".join(body)}</{tag}>'
    if shape == "bare":
        text = "".join(b if 'id="label-0"' in b else _block.sub(r'<\1 id="label-1">', b) for b in body)
    elif shape == "table":
        aside = lambda odds: f'<td id="label-0">{pick([links, noise["menu"], noise["side"], lambda: "<br>".join(link() for _ in range(rng.integers(2, 7)))])()}</td>' if rng.random() < odds else ""
        row = f'<tr>{aside(0.7)}<td {pick(["", "valign=top", own])} id="label-1">{"".join(body)}</td>{aside(0.3)}</tr>'
        last = f'<tr><td id="label-0">&copy; {line(2, 12)}</td></tr>' if rng.random() < 0.4 else ""
        text = f"<table>{row}{last}</table>"
    for _ in range(rng.integers(3)):
        text = f'<{(t := pick(["div", "main", "div"]))} {pick(["", "class=wrapper", "id=page", f"id={token('head')}", f"class=has-{token('side')}"])}>{some(["side", "ad", "more"], 0.15)}{text}{some(["comment", "side", "more"], 0.25)}</{t}>'
    before, after = some(["notice", "head", "menu", "ad", "form", "side"], 0.45), some(["comment", "more", "side", "form", "ad", "notice", "foot"], 0.45)
    return f"<html><head><title>{line(2, 6)}</title></head><body>{before}{text}{after}</body></html>"


def learn(pages: list[str], layouts: int = LAYOUTS, seed: int = SEED) -> Trees:
    """Boosted trees from made-up layouts and sampled pages; a node weighs the more, the more text it holds."""
    rng, x, y, w = np.random.default_rng(seed), [], [], []
    made = ((read_page(made_layout(rng), marked=True), made_labels) for _ in range(layouts))
    for page, label in [*made, *((read_page(p), silver_labels) for p in pages)]:
        if page.parent:
            rows = features(page)
            x.append(rows)
            y.append(with_ancestors(page, label(page)))
            w.append(0.3 + np.minimum(rows[:, 1], 6.0) / 6)
    return boost(np.concatenate(x), np.concatenate(y).astype(float), np.concatenate(w))


def main_texts(pages: list[str], trees: Trees) -> list[str]:
    """The kept blocks of each page, joined by an empty line; all pages are judged in one pass over the trees."""
    read = [read_page(p) for p in pages]
    rows = [features(p) for p in read if p.parent]
    odds, at, out = trees.odds(np.concatenate(rows)) if rows else np.empty(0), 0, []
    for page in read:
        n = len(page.parent)
        kept = decode(page.parent, odds[at : at + n]) if n else []
        at += n
        out.append("\n\n".join(text for node, text, _ in page.blocks if kept[node]))
    return out


def _extract(trees: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                some = batch.slice(i, BATCH)
                texts = main_texts([h or "" for h in some.column(2).to_pylist()], trees)
                columns = [some.column(0).cast(pa.int64()), some.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return run


def sample_pages(pages: DataFrame, sample: int) -> list[str]:
    """At most ``sample`` different pages, those with the least hashes: hashes are ordered first, then the pages fetched."""
    hashed = pages.where("html IS NOT NULL").select(F.xxhash64("html").alias("hash"), "html")
    least = hashed.select("hash").distinct().orderBy("hash").limit(sample).agg(F.max("hash")).first()[0]
    if least is None:
        return []
    taken = hashed.where(F.col("hash") <= least).groupBy("hash").agg(F.min("html").alias("html"))
    return [r.html for r in taken.orderBy("hash").collect()]


def extract_main_text(pages: DataFrame, sample: int = SAMPLE, layouts: int = LAYOUTS, seed: int = SEED) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html; further columns are ignored).

    ``text`` holds the article's blocks in page order, white space turned into single spaces, joined by two line feeds;
    it is empty if there is none, as for a null or empty page. ``n_chars`` counts its code points. Broken markup is
    read as it comes. Repeated rows stay repeated; an empty table gives no rows.

    The trees learn from made-up layouts and from at most ``sample`` pages, taken by a hash, whose own elements say what
    they are; the driver sees no more. A node is judged by its tag, tokens, density, depth and siblings, and kept only
    below kept nodes, in the likeliest such choice for the whole page. Pages are read one by one where they are.
    """
    trees = learn(sample_pages(pages, sample), layouts, seed)
    return pages.select("page_id", "url", "html").mapInArrow(_extract(trees), "page_id long, url string, text string, n_chars long")
