"""HTML extraction: main text by a linear-chain conditional random field over a page's leaf blocks.

A page is cut into leaf blocks, runs of text between block-level tags in page order. Each block has features of its
ancestors (tags, words of class, id and role, and what these say in turn from the outside in: junk, form, header or content;
so a block named as junk inside of an article can be told from an article inside of a page so named), of its text (length, links, stops) and of its neighbours' links; a
two-label CRF scores blocks and the steps between them, and Viterbi picks the labels. The CRF is fitted by gradient
steps on exact forward-backward marginals over labelled pages, a bounded sample (``SAMPLE``) of two kinds: pages whose
author marks the article with ``<article>`` or ``<main>``, once as they are and once with these marks hidden, so that the
other features have to tell; and pages composed of the sample's texts in other layouts (sidebars, notices, forms,
comments, tables, columns, plain text), labelled as they are made. Pages of over ``FIT_BYTES`` are not fitted on, so the sample is bounded in
bytes. Every page is extracted, whole.

Defined cases: a null or empty html has empty text; unclosed tags, comments and scripts end with the page; a quote that
is never closed is no quote; text before any tag, or without any, is a block; pages are read once from left to right, so
time grows with their length only, whatever is left open; pages of any length are taken; ties in Viterbi go to leaving
out; repeated rows give equal rows; a null page_id or url stays null; without labelled pages in the sample the composed
pages alone, on stock sentences, are fitted; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Pages that are sampled and composed, gradient steps, blocks of a labelled page that are fitted as one sequence (a longer page is several).
SAMPLE, COMPOSED, STEPS, SEQUENCE = 250, 700, 200, 200
#: Bytes of the longest page of the sample.
FIT_BYTES = 1 << 16
#: Elements whose text is never shown, elements that don't end a block, elements without an end tag.
HIDDEN = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "textarea", "select", "title"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br", "ruby", "rt", "rp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that end where another of their kind begins.
ENDED = {"li", "tr", "td", "th", "dd", "dt", "option"}
TAG, STOP = re.compile(r"(/?)([a-zA-Z][^\s/>]*)"), re.compile("[>\"']")
ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in HIDDEN}
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
WORD = re.compile(r"[a-z]+")
#: Names that say what a text is about.
TOPICS = re.compile(r"\b(?:category|tag|topic)-[^\s\"']+")


#: Words in names, and elements, of what stands in a page but is no article.
JUNK = set(
    "ad ads adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright"
    " disclaimer discussion disqus foot footer gdpr legal login menu modal nav navbar navigation newsletter notice notices outbrain pager pagination popular popup"
    " promo promotion promotions recommended recommendations related replies reply respond responses search share sharing sidebar signup social sponsor sponsored"
    " subscribe subscription taboola tags teaser toc trending widget widgets".split()
)
JUNK_TAGS = {"aside", "dialog", "footer", "menu", "nav"}
#: The same of articles.
CONTENT = set("article articlebody body content entry main post story text".split())
CONTENT_TAGS = {"article", "main"}


def kind_of(tag: str, names: list[str]) -> str | None:
    """What an element says of its content: junk, form, header or content; None: nothing. The whole page's names say nothing."""
    if tag in ("html", "body", "head"):
        return None
    if tag in JUNK_TAGS or not JUNK.isdisjoint(names):
        return "junk"
    if tag in ("form", "header"):
        return tag
    return "content" if tag in CONTENT_TAGS or not CONTENT.isdisjoint(names) else None


class Block:
    """A leaf block: its text, its innermost block-level element, features of what it is inside of, characters within links."""

    __slots__ = ("text", "parent", "inside", "linked")

    def __init__(self, text: str, parent: str, inside: frozenset[str], linked: int):
        self.text, self.parent, self.inside, self.linked = text, parent, inside, linked


def tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Where the tag ends whose attributes begin at at; last: the last place of each quote."""
    while True:
        m = STOP.search(page, at)
        if m is None:
            return len(page)
        if m[0] == ">":
            return m.end()
        at = page.find(m[0], m.end()) + 1 if m.start() < last[m[0]] else m.end()


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", tag, attributes) and ("close", tag, "") in order; comments and hidden elements left out."""
    at, size, last = 0, len(page), {q: page.rfind(q) for q in "\"'"}

    def after(found: int, width: int) -> int:
        return size if found < 0 else found + width

    while at < size:
        lt = page.find("<", at)
        lt = size if lt < 0 else lt
        if lt > at:
            yield "text", page[at:lt], ""
        tag = TAG.match(page, lt + 1)
        if tag is None:
            if page.startswith("!--", lt + 1):
                at = after(page.find("-->", lt + 4), 3)
            elif page[lt + 1 : lt + 2] in ("!", "?", "/"):
                at = after(page.find(">", lt), 1)
            else:
                at = lt + 1
                if lt < size:
                    yield "text", "<", ""
            continue
        at, name = tag_end(page, tag.end(), last), tag[2].lower()
        if name in HIDDEN and not tag[1]:
            end = ENDS[name].search(page, at)
            at = size if end is None else after(page.find(">", end.end()), 1)
        else:
            yield "close" if tag[1] else "open", name, "" if tag[1] else page[tag.end() : at - 1]


class Open:
    """The elements open at a place, and the features of being inside of them. known: the features to count (None: all)."""

    def __init__(self, known: set[str] | None):
        self.stack: list[tuple[str, list[str]]] = []
        self.kinds: list[tuple[int, str]] = []  # places in the stack where what elements say changes
        self.outer: list[int] = []  # places in the stack of block-level elements
        self.tags, self.features, self.known, self.held = Counter(), Counter(), known, frozenset()

    def push(self, tag: str, attrs: str) -> None:
        names = [w for a in NAMES.findall(attrs) for w in WORD.findall(TOPICS.sub("", a.lower()))] if attrs else []
        features = [f"name={w}" for w in names]
        if tag not in INLINE:
            kind = kind_of(tag, names)
            if kind and (not self.kinds or self.kinds[-1][1] != kind):
                self.kinds.append((len(self.stack), kind))
            self.outer.append(len(self.stack))
            features.append(f"in={tag}")
        features = [f for f in features if self.known is None or f in self.known]
        self.stack.append((tag, features))
        self.tags[tag] += 1
        self.features.update(features)
        self.held = None

    def cut(self, k: int) -> None:
        while len(self.stack) > k:
            tag, features = self.stack.pop()
            self.tags[tag] -= 1
            self.features.subtract(features)
        while self.outer and self.outer[-1] >= k:
            self.outer.pop()
        while self.kinds and self.kinds[-1][0] >= k:
            self.kinds.pop()
        self.held = None

    def close(self, tag: str) -> None:
        if self.tags[tag]:
            k = len(self.stack) - 1
            while self.stack[k][0] != tag:
                k -= 1
            self.cut(k)

    def parent(self) -> str:
        return self.stack[self.outer[-1]][0] if self.outer else "none"

    def inside(self) -> frozenset[str]:
        if self.held is None:
            self.features = +self.features
            said = [kind for _, kind in self.kinds[-3:]]
            # What the ancestors say, from the outside in, and the innermost word of it: names decide over places.
            self.held = frozenset((*self.features, f"path={'>'.join(said)}", f"nearest={said[-1] if said else 'none'}"))
        return self.held


def leaf_blocks(page: str | None, known: set[str] | None = None) -> list[Block]:
    blocks, at, parts, linked = [], Open(known), [], 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            blocks.append(Block(text, at.parent(), at.inside(), linked))
        parts.clear()
        linked = 0

    for kind, value, attrs in tokens(page or ""):
        if kind == "text":
            parts.append(value)
            linked += len(value) if at.tags["a"] else 0
            continue
        if value == "br":
            parts.append(" ")
        elif value not in INLINE:
            flush()
        if kind == "close":
            at.close(value)
            continue
        # A paragraph or list item ends where the next block begins.
        if value not in INLINE and (at.parent() == "p" or value in ENDED and at.parent() == value):
            at.cut(at.outer[-1])
        if value not in VOID and not attrs.rstrip().endswith("/"):
            at.push(value, attrs)
    flush()
    return blocks


def block_features(blocks: list[Block]) -> list[list[str]]:
    links = [min(3, round(3 * b.linked / max(1, len(b.text)))) for b in blocks]
    out, titled = [], False
    for i, b in enumerate(blocks):
        words = b.text.split()
        stops = sum(w[-1] in ".!?" for w in words)
        f = ["1", f"parent={b.parent}", f"words={min(6, len(words).bit_length())}", f"links={links[i]}", f"stops={min(3, stops)}", *b.inside]
        f += [f"before={links[i - 1] if i else 'none'}", f"after={links[i + 1] if i + 1 < len(blocks) else 'none'}", f"titled={titled}"]
        titled |= b.parent == "h1"
        if i == 0:
            f.append("first")
        if i == len(blocks) - 1:
            f.append("last")
        if len(blocks) == 1:
            f.append("only")
        if re.search(r"[©®]|\ball rights\b|\bcopyright\b", b.text, re.I):
            f += ["rights", f"rights={'last' if i == len(blocks) - 1 else 'before'}", f"rights parent={b.parent}"]
        out.append(f)
    return out


class Crf:
    """Two-label chain: emission weights for each feature, and weights of steps between labels."""

    def __init__(self, features: dict[str, int]):
        self.features = features
        self.emit, self.step, self.start = np.zeros((len(features), 2)), np.zeros((2, 2)), np.zeros(2)

    def numbers(self, feats: list[list[str]]) -> list[list[int]]:
        return [[self.features[f] for f in fs if f in self.features] for fs in feats]

    def fit(self, pages: list[list[list[str]]], labels: list[list[int]], steps: int = STEPS, rate: float = 0.1, decay: float = 1e-4) -> Crf:
        """Adam on the log likelihood; pages side by side, padded to the longest."""
        n, t = len(pages), max(map(len, pages))
        seq = [self.numbers(p) for p in pages]
        rows = np.array([i * t + j for i, p in enumerate(seq) for j, fs in enumerate(p) for _ in fs])
        cols = np.array([k for p in seq for fs in p for k in fs])
        mask = np.array([[j < len(p) for j in range(t)] for p in seq])
        y = np.array([[*lab, *[0] * (t - len(lab))] for lab in labels])
        gold = np.eye(2)[y] * mask[:, :, None]
        both = mask[:, 1:] & mask[:, :-1]
        gold_step = np.einsum("nta,ntb->ab", gold[:, :-1] * both[:, :, None], gold[:, 1:])
        params = np.concatenate([self.emit.ravel(), self.step.ravel(), self.start])
        m, v = np.zeros_like(params), np.zeros_like(params)
        for k in range(1, steps + 1):
            emit, step, start = params[:-6].reshape(-1, 2), params[-6:-2].reshape(2, 2), params[-2:]
            e = np.column_stack([np.bincount(rows, weights=emit[cols, c], minlength=n * t) for c in (0, 1)]).reshape(n, t, 2)
            a, b = np.zeros((n, t, 2)), np.zeros((n, t, 2))
            a[:, 0] = e[:, 0] + start
            for j in range(1, t):
                s = a[:, j - 1, :, None] + step
                a[:, j] = np.where(mask[:, j, None], np.logaddexp(s[:, 0], s[:, 1]) + e[:, j], a[:, j - 1])
            for j in range(t - 2, -1, -1):
                s = step + (e[:, j + 1] + b[:, j + 1])[:, None, :]
                b[:, j] = np.where(mask[:, j + 1, None], np.logaddexp(s[:, :, 0], s[:, :, 1]), 0)
            z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
            p = np.exp(a + b - z[:, None, None]) * mask[:, :, None]
            pair = np.exp(a[:, :-1, :, None] + step + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[:, :, None, None]
            diff = (p - gold).reshape(n * t, 2)
            g_emit = np.column_stack([np.bincount(cols, weights=diff[rows, c], minlength=len(emit)) for c in (0, 1)])
            g = np.concatenate([g_emit.ravel(), (pair.sum((0, 1)) - gold_step).ravel(), (p[:, 0] - gold[:, 0]).sum(0)]) / n + decay * params
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            params = params - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        self.emit, self.step, self.start = params[:-6].reshape(-1, 2), params[-6:-2].reshape(2, 2), params[-2:]
        return self

    def viterbi(self, feats: list[list[str]]) -> list[int]:
        if not feats:
            return []
        weights, (s00, s01), (s10, s11) = self.emit, *self.step.tolist()
        scores = [weights[k].sum(0).tolist() if k else [0.0, 0.0] for k in self.numbers(feats)]
        best0, best1, back = scores[0][0] + self.start[0], scores[0][1] + self.start[1], []
        for e0, e1 in scores[1:]:
            from0, from1 = best1 + s10 > best0 + s00, best1 + s11 >= best0 + s01
            back.append((from0, from1))
            best0, best1 = (best1 + s10 if from0 else best0 + s00) + e0, (best1 + s11 if from1 else best0 + s01) + e1
        path = [int(best1 > best0)]
        for from0, from1 in reversed(back):
            path.append(int(from1 if path[-1] else from0))
        return path[::-1]


#: Elements and names of what is no article, though it may stand inside of one.
OUTSIDE = {"in=nav", "in=footer", "in=aside", "in=form", "in=head"}
ASIDE = {f"name={w}" for w in ("comment", "comments", "reply", "replies", "respond", "responses", "discussion", "ad", "ads", "advert", "advertisement", "sponsored", "promo", "related", "share", "social", "newsletter", "cookie")}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MARKS = {"in=article", "in=main"}


def marked_labels(blocks: list[Block]) -> list[int] | None:
    """Labels of a page that marks its article itself; None of others. A header keeps its headings."""
    if not any(MARKS & b.inside for b in blocks):
        return None
    return [int(bool(MARKS & b.inside) and not (OUTSIDE | ASIDE) & b.inside and ("in=header" not in b.inside or b.parent in HEADINGS)) for b in blocks]


def unmarked(blocks: list[Block]) -> list[Block]:
    """The same page written with plain divisions for the marks."""
    return [Block(b.text, "div" if b.parent in ("article", "main") else b.parent, b.inside - MARKS | ({"in=div"} if MARKS & b.inside else set()), b.linked) for b in blocks]


#: Sentences for pages composed where the sample has no text.
STOCK = ["The river rose two metres in the night, and the lower road was closed until noon.", "Members voted on the plan after a long debate.", "Nobody in the village had seen snow so late in the year.", "A second survey will follow in spring."]


def compose(rng: random.Random, prose: list[str], notes: list[str]) -> tuple[str, set[str]]:
    """A labelled page in some layout, and marks of its content: texts carry a mark that is taken off later."""
    esc = entities.escape
    k = iter(range(10_000))
    kept: set[str] = set()

    def say(source: list[str], keep: bool) -> str:
        mark = f"⁣{next(k)}⁣"
        if keep:
            kept.add(mark)
        return mark + esc(rng.choice(source))

    def menu(tag: str, name: str) -> str:
        items = "".join(f'<li><a href="/{i}">{say([x[:24] for x in notes], False)}</a></li>' for i in range(rng.randint(2, 6)))
        return f"<{tag}{name}><ul>{items}</ul></{tag}>"

    def named(*names: str) -> str:
        return f' {rng.choice(["class", "id"])}="{rng.choice(names)}"'

    def junk() -> str:
        kind = rng.randrange(12)
        if kind == 9:
            items = "".join(f"<li><a href='/{i}'>{say([x[:60] for x in prose], False)}</a></li>" for i in range(rng.randint(2, 7)))
            return f"<{(t := rng.choice(['div', 'section', 'div', 'td']))}{rng.choice(['', named('most-read', 'popular', 'trending', 'right', 'side', 'box')])}><h3>{say(['Most read', 'Popular now', 'Mehr', 'Lire aussi', 'More stories', 'Lo mas leido'], False)}</h3><{(u := rng.choice(['ul', 'ol']))}>{items}</{u}></{t}>"
        if kind == 10:
            return f"<{(t := rng.choice(['p', 'div']))}>" + rng.choice([" | ", " ", " &middot; "]).join(f"<a href=/{i}>{say([x[:20] for x in notes], False)}</a>" for i in range(rng.randint(2, 7))) + f"</{t}>"
        if kind == 11:
            return f"<div{named('byline', 'meta', 'author', 'date', 'dateline', 'timestamp')}>{rng.choice(['By ', 'Von ', 'Par ', ''])}{say([x[:20] for x in notes], False)}</div>"
        if kind == 0:
            return menu("nav", rng.choice(["", named("menu", "navbar", "navigation")]))
        if kind == 1:
            return menu("div", named("menu", "sidebar", "nav", "breadcrumb", "breadcrumbs", "widget", "related", "toc", "tags", "pagination"))
        if kind == 2:
            return f"<aside{rng.choice(['', named('sidebar', 'related')])}><h3>{say(notes, False)}</h3><p>{say(prose, False)}</p></aside>"
        if kind == 3:
            return f"<div{named('cookie', 'cookie-notice', 'notice', 'banner', 'popup', 'gdpr', 'consent', 'newsletter', 'alert', 'modal')}><p>{say(notes + prose, False)}</p><button>OK</button></div>"
        if kind == 4:
            return f"<form action='/s'{rng.choice(['', named('search', 'login', 'subscribe', 'newsletter')])}><label>{say(notes, False)}</label><input name=q><button>{say(['Search', 'Send', 'Sign up'], False)}</button></form>"
        if kind == 5:
            n = rng.randint(1, 5)
            items = "".join(rng.choice(["<div class=\"comment\"><p>{}</p></div>", "<li class=comment>{}</li>", "<p>{}</p>", "<article class=\"comment\"><p>{}</p></article>"]).format(say(prose, False)) for _ in range(n))
            return f"<{(t := rng.choice(['section', 'div', 'ol', 'aside']))}{named('comments', 'comment-list', 'responses', 'discussion', 'reader-comments', 'replies')}>{rng.choice(['', '<h2>' + say(['Comments', 'Kommentare', 'Commentaires', 'Comentarios', 'Leave a reply'], False) + '</h2>'])}{items}</{t}>"
        if kind == 6:
            return f"<div{named('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner-ad', 'sponsor')}>{say(prose, False)}</div>"
        if kind == 7:
            return f"<header{rng.choice(['', named('site-header', 'masthead', 'top')])}><a href=/>{say(notes, False)}</a><p>{say(notes, False)}</p></header>"
        return f"<div{named('share', 'social', 'share-buttons', 'author-box', 'byline-links', 'subscribe')}><a href=#>{say(notes, False)}</a> <a href=#>{say(notes, False)}</a></div>"

    def paragraph() -> str:
        kind = rng.randrange(12)
        if kind == 0:
            return f"<h2>{say([x[:50] for x in prose], True)}</h2>"
        if kind == 1:
            return "<ul>" + "".join(f"<li>{say(prose, True)}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
        if kind == 2:
            return f"<blockquote><p>{say(prose, True)}</p></blockquote>"
        if kind == 3:
            return f"<p>{say([x[:30] for x in prose], True)}</p>"
        if kind == 4:
            return f"<p>{say(prose, True)} <a href='/x'>{esc(rng.choice(prose)[:20])}</a> <b>{esc(rng.choice(prose)[:40])}</b></p>"
        if kind == 5:
            return "<table><tr>" + "".join(f"<td>{say([x[:20] for x in prose], True)}</td>" for _ in range(3)) + "</tr></table>"
        if kind == 6:
            return f"<figure><img src=x><figcaption>{say([x[:60] for x in prose], True)}</figcaption></figure>"
        return f"<p>{say(prose, True)}" + rng.choice(["</p>", "</p>", ""])

    def talk() -> str:
        """Reader comments, which may well stand inside the article."""
        items = "".join(f"<div class=\"{rng.choice(['comment', 'comment-body', 'reply'])}\"><p>{say(prose, False)}</p></div>" for _ in range(rng.randint(1, 4)))
        return f"<div{named('comments', 'comment-list', 'discussion', 'responses', 'reader-comments')}><h3>{say(['Comments', 'Kommentare', 'What readers say'], False)}</h3>{items}</div>"

    if rng.random() < 0.05:  # plain text: no element at all, or a single one
        text = rng.choice(["\n", " "]).join(say(prose, True) for _ in range(rng.randint(1, 6)))
        return rng.choice(["{}", "<pre>{}</pre>", "<html><body>{}</body></html>", "<p>{}"]).format(text), kept
    title = f"<h1>{say([x[:60] for x in prose], True)}</h1>"
    if rng.random() < 0.25:
        title = f"<header{rng.choice(['', named('article-header', 'entry-header', 'post-header')])}>{title}{rng.choice(['', '<p>' + say([x[:20] for x in notes], False) + '</p>'])}</header>"
    body = title + "".join(junk() if rng.random() < 0.15 else paragraph() for _ in range(rng.randint(1, 14))) + (talk() if rng.random() < 0.2 else "")
    opened = rng.choice(["article", "article", "main", "div" + named("content", "post", "entry", "article", "story", "main-content", "article-body", "post-content", "text"), "section" + named("content", "article", "story", "post"), "div", "td", "columns"])
    if opened == "main" and rng.random() < 0.5:
        body = f"<article>{body}</article>"
    page = f"<{opened}>{body}</{opened.split()[0]}>"
    if opened == "td":  # a table for a layout
        sides = ["".join(f"<a href=/{i}>{say([x[:24] for x in notes], False)}</a>{rng.choice(['<br>', ' '])}" for i in range(rng.randint(2, 7))) if rng.random() < 0.6 else junk() for _ in range(rng.randint(1, 2))]
        cells = [f"<td{rng.choice(['', ' width=20%', ' valign=top'])}>{x}</td>" for x in sides]
        cells.insert(rng.randint(0, len(cells)), page)
        page = f"<table>{rng.choice(['', '<tr><td colspan=3>' + say(notes, False) + '</td></tr>'])}<tr>{''.join(cells)}</tr>{rng.choice(['', '<tr><td colspan=3>&copy; ' + say(notes, False) + '</td></tr>'])}</table>"
    elif opened == "columns":
        sides = [f"<div{rng.choice(['', named('col', 'left', 'right', 'side', 'column')])}>{junk()}{junk()}</div>" for _ in range(rng.randint(1, 2))]
        sides.insert(rng.randint(0, len(sides)), f"<div{rng.choice(['', named('col', 'left', 'middle', 'wide', 'column')])}>{body}</div>")
        page = f"<div{rng.choice(['', named('row', 'columns', 'wrap', 'container')])}>{''.join(sides)}</div>"
    before, after = "".join(junk() for _ in range(rng.randint(0, 4))), "".join(junk() for _ in range(rng.randint(0, 4)))
    foot = f"<footer>&copy; {say(notes, False)} &middot; {esc(rng.choice(notes))}</footer>" if (r := rng.random()) < 0.6 else "" if r < 0.7 else f"<div{named('footer', 'site-footer', 'copyright', 'legal')}>&copy; {say(notes, False)}</div>"
    return f"<html><head><title>x</title></head><body>{before}{page}{after}{foot}</body></html>", kept


def fit(pages: DataFrame) -> Crf:
    total = pages.count()
    draw = F.pmod(F.xxhash64(F.lit(31), "page_id", "url"), F.lit(1 << 30)) / float(1 << 30)
    sample = [r["html"] for r in pages.where(F.octet_length("html") <= FIT_BYTES).where(draw < SAMPLE / max(1, total)).select("page_id", "html").orderBy("page_id").limit(4 * SAMPLE).collect()]
    return fit_sample(sample)


def fit_sample(sample: list[str]) -> Crf:
    rng = random.Random(3)
    seqs, labels, prose, notes = [], [], [], []
    for page in sample:
        blocks = leaf_blocks(page)
        lab = marked_labels(blocks)
        if lab:
            seqs += [block_features(blocks), block_features(unmarked(blocks))]
            labels += [lab, lab]
        prose += [b.text for b in blocks if len(b.text) > 60]
        notes += [b.text for b in blocks if len(b.text) <= 60]
    prose, notes = prose or STOCK, notes or [x[:40] for x in STOCK]
    for _ in range(COMPOSED):
        page, kept = compose(rng, prose, notes)
        blocks = leaf_blocks(page)
        lab = [int(any(m in kept for m in re.findall("⁣[0-9]+⁣", b.text))) for b in blocks]
        for b in blocks:
            b.text = re.sub("⁣[0-9]+⁣", "", b.text) or "x"
        seqs.append(block_features(blocks))
        labels.append(lab)
    cut = [(s[k : k + SEQUENCE], y[k : k + SEQUENCE]) for s, y in zip(seqs, labels, strict=True) for k in range(0, len(s), SEQUENCE)]
    names = sorted({f for s, _ in cut for fs in s for f in fs})
    return Crf({f: i for i, f in enumerate(names)}).fit([s for s, _ in cut], [y for _, y in cut])


def main_text(crf: Crf, page: str | None) -> str:
    blocks = leaf_blocks(page, crf.features.keys())
    return " ".join(b.text for b, y in zip(blocks, crf.viterbi(block_features(blocks)), strict=True) if y)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of pages."""
    small_batches(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(fit(pages.select("page_id", "url", "html")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(held.value, page.as_py()) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")
