"""Main text of web pages by minimum-cut labelling.

A page is read into blocks, runs of text between block-level tags. A logistic
classifier gives each block the cost of calling it content or boilerplate; these
are the capacities to the two terminals. Neighbouring blocks, and consecutive
blocks of one container, are joined by smoothness edges, weaker the further they
are apart in the tree and absent where a menu, footer, notice or comment section
begins or ends. Maximum flow finds the labelling of least total cost.

The classifier is trained here, on pages that `training_pages` builds by rule from
a fixed seed; only its weights go to the executors. A page is worked on alone, so
nothing is shuffled.

Defined results: a null or empty page, and one without content, give an empty text;
broken markup is read as browsers do in the common cases (unclosed paragraphs, list
items and cells, stray end tags, unclosed comments, scripts and tags); a character
reference lies within one run of text, so markup never joins the halves of one; pages
of any length are read whole, in time linear in their length; a block on which both
labels cost the same is boilerplate; repeated rows are worked on each; extra columns
pass through unless they have an output's name; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Element names of HTML and words of class names.
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title template noscript iframe noembed noframes xmp".split())
SKIPPED_TAGS = frozenset("head button select option optgroup datalist label legend".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("body html table ul ol dl menu article section div nav aside form main footer header td th blockquote".split())
BAD_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register share sharing social related recommended recommendations trending popular sidebar side widget widgets menu nav navbar navigation breadcrumb breadcrumbs crumbs footer foot header masthead topbar toolbar pagination pager pages tags taglist skip search copyright legal disclaimer links linklist meta toc rail outbrain taboola paywall donate".split())
COMMENT_WORDS = frozenset("comment comments commentlist commenters reply replies disqus respond responses discussion reader readers feedback guestbook".split())
GOOD_WORDS = frozenset("article content main post entry story body text prose paragraph".split())
ROLES = {"navigation": "bad", "banner": "bad", "contentinfo": "bad", "complementary": "bad", "search": "bad", "alert": "bad", "dialog": "bad", "main": "good", "article": "good"}

# Quotes count after an equals sign only. Every quantifier is possessive, so that a match looks at a character once.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"""([^\s/>="']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

_FLAGS = ("nav", "header", "footer", "aside", "form", "article", "main", "bad", "good", "comment", "hidden")
_BIT = {f: 1 << i for i, f in enumerate(_FLAGS)}
_AWAY = sum(_BIT[f] for f in ("nav", "header", "footer", "aside", "form", "bad", "comment", "hidden"))
FEATURES = ("one", "log_chars", "link_share", "sentence", "commas", "p", "heading", "item", "cell", "symbol", *_FLAGS, "article_header", "long")


@lru_cache(4096)
def _attribute_flags(attrs: str) -> int:
    flags = 0
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name in ("class", "id"):
            words = {w.lower() for w in _PART.findall(value)}
            flags |= _BIT["bad"] * bool(words & BAD_WORDS) | _BIT["comment"] * bool(words & COMMENT_WORDS) | _BIT["good"] * bool(words & GOOD_WORDS)
        elif name == "role":
            flags |= _BIT.get(ROLES.get(value.strip().lower(), ""), 0)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            flags |= _BIT["hidden"]
    return flags


class Block:
    """A run of text: its text, tag, flags of what it lies in, container, container's parent, characters in links."""

    __slots__ = ("text", "tag", "flags", "container", "outer", "link_chars")

    def __init__(self, text: str, tag: str, flags: int, container: int, outer: int, link_chars: int):
        self.text, self.tag, self.flags, self.container, self.outer, self.link_chars = text, tag, flags, container, outer, link_chars


class _Frame(NamedTuple):
    """An open element. `block` is the place on the stack of the nearest block, itself or one around it."""

    tag: str
    is_block: bool
    flags: int
    in_link: bool
    skipped: bool
    number: int
    inside: int
    block: int


class _Reader:
    """Reads a page into blocks.

    Beside the stack of open elements stand counts of the tags that are open in all, in
    the innermost block and in the innermost scope, so that the stack is only searched
    for what is there, and whatever a search passes is closed by it.
    """

    def __init__(self) -> None:
        self.out: list[Block] = []
        self.stack = [_Frame("", True, 0, False, False, 0, 0, 0)]
        self.open_blocks: dict[str, int] = {}
        self.inline: list[dict[str, int]] = [{}]  # by block
        self.scopes: list[dict[str, int]] = [{}]
        self.count = 0
        self.parts: list[str] = []
        self.links: list[str] = []

    def flush(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.stack[-1]
            f = self.stack[top.block]
            own = f.tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6")
            linked = len(" ".join(" ".join(self.links).split())) if self.links else 0
            self.out.append(Block(text, f.tag, top.flags, f.inside if own else f.number, f.inside, min(linked, len(text))))
        self.parts.clear()
        self.links.clear()

    def add(self, text: str) -> None:
        top = self.stack[-1]
        if text and not top.skipped:
            if "&" in text:
                text = html.unescape(text)
            self.parts.append(text)
            if top.in_link:
                self.links.append(text)

    def _push(self, frame: _Frame) -> None:
        self.stack.append(frame)
        if frame.is_block:
            self.open_blocks[frame.tag] = self.open_blocks.get(frame.tag, 0) + 1
            self.inline.append({})
        else:
            self.inline[-1][frame.tag] = self.inline[-1].get(frame.tag, 0) + 1
        if frame.tag in SCOPES:
            self.scopes.append({})
        self.scopes[-1][frame.tag] = self.scopes[-1].get(frame.tag, 0) + 1

    def _close(self, *tags: str) -> str:
        """Closes the innermost element of one of the tags, which is open, and all within it."""
        while True:
            f = self.stack.pop()
            if f.tag in SCOPES:
                self.scopes.pop()
            else:
                self.scopes[-1][f.tag] -= 1
            if f.is_block:
                self.inline.pop()
                self.open_blocks[f.tag] -= 1
            else:
                self.inline[-1][f.tag] -= 1
            if f.tag in tags:
                return f.tag

    def end(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()  # a stray one parts blocks too
            if self.open_blocks.get(tag):
                self._close(tag)
        elif self.inline[-1].get(tag):  # an inline end tag doesn't close blocks
            self._close(tag)

    def start(self, tag: str, attrs: str) -> None:
        is_block = tag in BLOCK_TAGS
        if is_block:
            self.flush()
            closed = ("p", *CLOSED_BY.get(tag, ()))
            while any(self.scopes[-1].get(t) for t in closed):
                if self._close(*closed) != "p":
                    break
        if tag in VOID_TAGS:
            return
        top = self.stack[-1]
        flags = top.flags | (_BIT[tag] if tag in ("nav", "header", "footer", "aside", "form", "article", "main") else 0)
        if attrs:
            # Long ones are seldom repeated and would fill the cache.
            flags |= (_attribute_flags if len(attrs) <= 2000 else _attribute_flags.__wrapped__)(attrs)
            if not is_block and attrs.rstrip().endswith("/"):
                return
        number, inside, block = top.number, top.inside, top.block
        if is_block:
            self.count += 1
            number, inside, block = self.count, self.stack[block].number, len(self.stack)
        self._push(_Frame(tag, is_block, flags, top.in_link or tag == "a", top.skipped or tag in SKIPPED_TAGS, number, inside, block))


def blocks(page: str) -> list[Block]:
    """The blocks of a whole page, in page order."""
    reader = _Reader()
    tag_at = _TAG.match
    text_from = at = 0
    n = len(page)
    while (lt := page.find("<", at)) >= 0:
        first = page[lt + 1 : lt + 2]
        slash = first == "/"
        letter = page[lt + 2 : lt + 3] if slash else first
        if letter.isascii() and letter.isalpha():
            m = tag_at(page, lt)
            if not m and tag_at is not _PLAIN_TAG.match:
                tag_at = _PLAIN_TAG.match  # from here on, quotes hold every ">" that is left
                m = tag_at(page, lt)
            end = m.end() if m else n
        elif first in ("!", "?") or slash and letter:
            m = None
            if page.startswith("<!--", lt):
                short = next((x for x in (">", "->") if page.startswith(x, lt + 4)), None)
                gt = lt + 4 + len(short) - 1 if short else page.find("-->", lt + 4)
                end = n if gt < 0 else gt + (1 if short else 3)
            else:
                end = page.find(">", lt) + 1 or n
        else:  # no markup
            at = lt + 1
            continue
        reader.add(page[text_from:lt])
        if m:
            tag = m[2].lower()
            if m[1]:
                reader.end(tag)
            elif tag == "br":
                reader.add(" ")
            elif tag in RAW_TAGS:
                stop = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, end)
                end = (page.find(">", stop.end()) + 1 or n) if stop else n
                reader.add(" ")
            else:
                reader.start(tag, m[3])
        text_from = at = end
    reader.add(page[text_from:])
    reader.flush()
    return reader.out


def block_features(bs: list[Block]) -> np.ndarray:
    rows = []
    for b in bs:
        t, n, f = b.text, len(b.text), b.flags
        flags = [1.0 if f & _BIT[x] else 0.0 for x in _FLAGS]
        rows.append(
            [
                1.0,
                math.log1p(n) / 4,
                b.link_chars / n,
                1.0 if t[-1] in ".!?。…\"”»" else 0.0,
                min(1.0, 30 * t.count(",") / n),
                1.0 if b.tag == "p" else 0.0,
                1.0 if b.tag in _HEADINGS else 0.0,
                1.0 if b.tag in ("li", "dd", "dt") else 0.0,
                1.0 if b.tag in ("td", "th") else 0.0,
                min(1.0, 40 * sum(map(t.count, "©®™")) / n),
                *flags,
                1.0 if f & _BIT["article"] and f & _BIT["header"] else 0.0,
                1.0 if n > 80 else 0.0,
            ]
        )
    return np.array(rows, dtype=float).reshape(-1, len(FEATURES))


# -- training -------------------------------------------------------------
_SYLLABLES = "ba co di fu ga he ki lo mu na po re si tu ve wa zo ar en ol".split()


def training_pages(n: int = 400, seed: int = 11) -> Iterator[tuple[str, list[bool]]]:
    """Pages built by rule, with the label of each of their blocks in page order."""
    r = random.Random(seed)

    def words(k: int) -> str:
        return " ".join("".join(r.choices(_SYLLABLES, k=r.randint(1, 3))) for _ in range(k))

    def sentence_text(k: int) -> str:
        out = []
        while k > 0:
            m = min(k, r.randint(3, 14))
            s = words(m).capitalize()
            out.append(s.replace(" ", ", ", 1) if m > 8 and r.random() < 0.5 else s)
            k -= m
        return ". ".join(out) + "."

    def link_list(k: int) -> tuple[str, int]:
        a, z = ('<a href="/x">', "</a>") if r.random() < 0.8 else ("", "")
        return "<ul>" + "".join(f"<li>{a}{words(r.randint(1, 4))}{z}</li>" for _ in range(k)) + "</ul>", k

    for _ in range(n):
        page, labels = [], []

        def put(markup: str, label: bool, times: int = 1) -> None:
            page.append(markup)
            labels.extend([label] * times)

        def boiler(kind: str) -> None:
            long = sentence_text(r.randint(5, 45))
            if kind == "menu":
                l, k = link_list(r.randint(3, 8))
                o, c = r.choice([("<nav>", "</nav>"), ('<div class="menu">', "</div>"), ('<div id="top-nav">', "</div>"), ("<header>", "</header>"), ("<nav>", "</nav>")])
                put(o + l + c, False, k)
            elif kind == "side":
                l, k = link_list(r.randint(2, 6))
                o, c = r.choice([("<aside>", "</aside>"), ('<div class="sidebar">', "</div>"), ('<div class="related-posts">', "</div>")])
                put(f"{o}<h3>{words(2)}</h3>{l}<p>{long}</p>{c}", False, k + 2)
            elif kind == "footer":
                o, c = r.choice([("<footer>", "</footer>"), ('<div class="footer">', "</div>")])
                mark = r.choice(["&copy; ", "Copyright ", "", "<p>"])
                put(f"{o}{mark}{words(2)} &middot; {long if r.random() < 0.5 else words(3)}{c}", False)
            elif kind == "notice":
                c = r.choice(["cookie-notice", "ad", "advert", "banner", "newsletter", "promo", "consent-popup"])
                put(f'<div class="{c}">{long}</div>' if r.random() < 0.6 else f'<div class="{c}"><p>{long}</p></div>', False)
            elif kind == "form":
                put(f'<form action="/s"><p>{words(r.randint(2, 9))}</p><input><button>go</button></form>', False)
            elif kind == "head":
                put(f"<header><h1>{words(3)}</h1><p>{words(5)}</p></header>", False, 2)
            else:
                k = r.randint(1, 4)
                o, c = r.choice([('<div class="comments">', "</div>"), ('<section id="comments">', "</section>"), ('<div class="reader-comments">', "</div>")])
                put(o + "".join(f'<div class="comment"><p>{sentence_text(r.randint(3, 40))}</p></div>' for _ in range(k)) + c, False, k)

        if r.random() < 0.05:
            put(f'<div hidden>{sentence_text(12)}</div>', False)
        for kind in ("menu", "head", "notice", "side", "form"):
            if r.random() < 0.5:
                boiler(kind)
        o, c = r.choice([("<article>", "</article>")] * 2 + [("<main>", "</main>"), ('<div class="content">', "</div>"), ("<div>", "</div>"), ('<div id="post-body">', "</div>"), ("<main><article>", "</article></main>")])
        page.append(o)
        title = f"<h1>{words(r.randint(3, 10))}</h1>"
        put(f"<header>{title}</header>" if r.random() < 0.1 else title, True)
        for _ in range(r.randint(2, 12)):
            k = r.random()
            if k < 0.72:
                put(f"<p>{sentence_text(r.choice([1, 2, 4, 20, 40, 80]))}</p>", True)
            elif k < 0.8:
                put(f"<h2>{words(r.randint(2, 6))}</h2>", True)
            elif k < 0.86:
                m = r.randint(2, 4)
                put("<ul>" + "".join(f"<li>{sentence_text(r.randint(3, 15))}</li>" for _ in range(m)) + "</ul>", True, m)
            elif k < 0.9:
                put(f"<blockquote>{sentence_text(20)}</blockquote>", True)
            elif k < 0.93:
                put(f"<table><tr><td>{words(3)}</td><td>{sentence_text(5)}</td></tr></table>", True, 2)
            elif k < 0.96:
                put(f'<p>{sentence_text(12)} <a href="/y">{words(2)}</a> {sentence_text(12)}</p>', True)
            else:
                boiler(r.choice(["notice", "side"]))
        if r.random() < 0.15:
            boiler("comments")
        page.append(c)
        for kind in ("comments", "side", "menu", "form", "footer"):
            if r.random() < 0.5:
                boiler(kind)
        yield f"<html><head><title>{words(3)}</title></head><body>{''.join(page)}</body></html>", labels


@lru_cache(1)
def trained_weights() -> tuple[float, ...]:
    """Weights of the block classifier, fitted by Newton steps on `training_pages`."""
    xs, ys = [], []
    for page, labels in training_pages():
        x = block_features(blocks(page))
        if len(x) != len(labels):
            raise AssertionError("a training page has other blocks than labels")
        xs.append(x)
        ys.append(np.array(labels, dtype=float))
    x, y = np.concatenate(xs), np.concatenate(ys)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (p - y) + 0.5 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return tuple(w.tolist())


# -- minimum cut ----------------------------------------------------------
_SCALE, _MOST = 1000, 6.0
NEAR, SAME = 0.9, 0.5


def _source_side(to_content: list[int], to_boiler: list[int], edges: dict[tuple[int, int], int]) -> list[bool]:
    """Which nodes stay with the source after the maximum flow from source to sink.

    `to_content[i]` is the capacity source-i, `to_boiler[i]` that of i-sink. What
    can flow straight through a node does so first; the rest is Dinic's algorithm.
    """
    n = len(to_content)
    excess = [a - b for a, b in zip(to_content, to_boiler)]
    if not edges:
        return [e > 0 for e in excess]
    if all(e >= 0 for e in excess) or all(e <= 0 for e in excess):
        return [any(e > 0 for e in excess)] * n
    s, t = n, n + 1
    heads: list[list[int]] = [[] for _ in range(n + 2)]
    end: list[int] = []
    room: list[int] = []

    def join(a: int, b: int, ab: int, ba: int) -> None:
        heads[a].append(len(end))
        end.append(b)
        room.append(ab)
        heads[b].append(len(end))
        end.append(a)
        room.append(ba)

    for i, e in enumerate(excess):
        if e > 0:
            join(s, i, e, 0)
        elif e < 0:
            join(i, t, -e, 0)
    for (a, b), c in edges.items():
        join(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = [s]
        for a in queue:
            for e in heads[a]:
                if room[e] and level[end[e]] < 0:
                    level[end[e]] = level[a] + 1
                    queue.append(end[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                k = next(i for i, e in enumerate(path) if not room[e])
                a = end[path[k] ^ 1]
                del path[k:]
                continue
            while turn[a] < len(heads[a]):
                e = heads[a][turn[a]]
                if room[e] and level[end[e]] == level[a] + 1:
                    break
                turn[a] += 1
            else:
                if not path:
                    break
                level[a] = -1
                a = end[path.pop() ^ 1]
                turn[a] += 1
                continue
            path.append(e)
            a = end[e]


def label_blocks(bs: list[Block], weights: np.ndarray) -> list[bool]:
    """True for each block that the cut leaves on the content side."""
    if not bs:
        return []
    z = np.clip(block_features(bs) @ weights, -_MOST, _MOST)
    content = (np.log1p(np.exp(z)) * _SCALE).astype(int).tolist()  # cost of calling it boilerplate
    boiler = (np.log1p(np.exp(-z)) * _SCALE).astype(int).tolist()
    edges: dict[tuple[int, int], int] = {}
    last: dict[int, int] = {}
    for i, b in enumerate(bs):
        for j, most in ((i - 1, NEAR), (last.get(b.container, -1), SAME)):
            if j < 0 or (bs[j].flags ^ b.flags) & _AWAY:
                continue
            a = bs[j]
            near = 1.0 if a.container == b.container else 0.5 if a.container == b.outer or a.outer == b.container or a.outer == b.outer else 0.2
            edges[j, i] = edges.get((j, i), 0) + int(_SCALE * most * near)
        last[b.container] = i
    return _source_side(content, boiler, edges)


def main_text(page: str | None, weights: np.ndarray) -> str:
    """The content blocks of a page, joined by empty lines."""
    bs = blocks(page or "")
    return "\n\n".join([b.text for b, keep in zip(bs, label_blocks(bs, weights)) if keep])


def extract(df: DataFrame, *, html_column: str = "html", keep: list[str] | None = None) -> DataFrame:
    """`df` (its columns `keep`, all but the html by default) with `text` and `n_chars`."""
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("text", "n_chars") and (keep is not None or c != html_column)]
    weights = np.array(trained_weights())
    schema = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in keep], T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py(), weights) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*keep, "text", "n_chars"])

    return df.select(*[df[f"`{c}`"] for c in keep], df[f"`{html_column}`"].cast("string").alias("_html")).mapInArrow(run, schema)
