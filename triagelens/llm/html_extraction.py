"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is read into leaf blocks: runs of text between block-level tags, each with its open
ancestors.  Features are the tags and the words of class and id attributes of all
ancestors, the nearest telling one, and the length, links, punctuation and place of the
text.  The field has two states, content and other; it is trained by gradient ascent on
the conditional likelihood and decoded by Viterbi.

Training pages are labelled by construction: text blocks of at most ``SAMPLE`` pages of
the table (a bounded sample, the smallest hashes) are laid out anew in varied layouts whose
content and other blocks are known.  Every page of the table is then decoded where it is.

Defined cases: a missing or empty page has the text ""; pages without content blocks too;
repeated rows are decoded each; missing ids and addresses are kept; extra columns are
ignored; unclosed and stray tags are tolerated: an svg, noscript or template element is
left out only if it is closed (an svg before the next block begins), a svg or math tag that
ends in "/>" is empty, and the text of math stays; an empty table gives an empty table.
"""

from __future__ import annotations

import html as references
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages whose text blocks make up the training pages, and training pages made of them.
SAMPLE, TRAINING = 200, 600
FEATURES = 1 << 14
ROUNDS, RATE, SHRINK = 60, 0.3, 1e-4

#: HTML elements that begin a block of their own.
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt
 fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol
 option p pre section select summary table tbody td tfoot th thead tr ul""".split())
#: A quote opens a value only after "=".
ATTRIBUTES = r"""(?:[^>=]|=\s*(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*)?)*+"""


def dropped(name: str, ends: str = "") -> str:
    """Pattern of a closed element whose text is none of the page's, with elements of its
    own name inside; a tag named in ``ends`` shows that it was left unclosed."""
    within = rf"[^<]++|<(?!/?(?:{name}{ends})[\s/>])"
    begin = rf"<{name}(?=[\s/>]){ATTRIBUTES}"
    return rf"{begin}(?<!/)>(?:{within}|{begin}(?:(?<=/)>|(?<!/)>(?:{within})*+</{name}\s*>))*+</{name}\s*>"


TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)"""
    rf"""|<(script|style|iframe|textarea|title)(?=[\s/>]){ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"""
    rf"""|{dropped("noscript")}|{dropped("template")}|{dropped("svg", "|" + "|".join(sorted(BLOCKS)))}"""
    rf"""|<head\b{ATTRIBUTES}>.*?</head\s*>"""
    rf"""|<[!?][^>]*>"""
    rf"""|<(/?)([a-zA-Z][^\s/>]*)({ATTRIBUTES})>"""
    rf"""|</?[a-zA-Z][^>]*>|[^<]+|<""", re.S | re.I)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
WORD = re.compile(r"[a-z]+")

#: HTML elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag closes an open one of these before it opens.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
WITHIN = frozenset("ul ol menu dl table tbody thead tfoot tr select article section div main body".split())

#: Words in the names of elements that tell content, or something else, in most layouts.
TELLS_CONTENT = frozenset("article main content post entry story body text blog page hentry".split())
TELLS_OTHER = frozenset("""nav menu header footer sidebar aside widget ad ads advert advertisement sponsor banner promo
 cookie consent notice alert popup modal newsletter subscribe signup form search login comment comments reply
 respond discussion share social related recommended breadcrumb breadcrumbs pagination pager copyright legal toolbar
 button label dialog""".split())


@dataclass
class Block:
    text: str
    linked: int
    ancestors: tuple[tuple[str, tuple[str, ...]], ...]


@dataclass
class Reader:
    """Leaf blocks of one page."""

    open: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    in_link: int = 0
    blocks: list[Block] = field(default_factory=list)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(text, self.linked, tuple(self.open)))
        self.parts, self.linked = [], 0

    def close(self, names: set[str] | frozenset[str], stop: frozenset[str] = frozenset()) -> None:
        """Close the innermost open element of these names, unless one of ``stop`` is nearer."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in names:
                del self.open[i:]
                return
            if self.open[i][0] in stop:
                return

    def tag(self, end: bool, name: str, attributes: str) -> None:
        if name == "a":
            self.in_link = 0 if end else 1
        if name == "br":
            self.parts.append(" ")
        if name not in BLOCKS:
            return
        self.flush()
        if end:
            self.close({name})
            return
        if self.open and any(t == "p" for t, _ in self.open):
            self.close({"p"}, WITHIN)
        if name in CLOSES:
            self.close(CLOSES[name], WITHIN - {"tr"} if name == "tr" else WITHIN)
        if name not in VOID:
            words = tuple(WORD.findall(" ".join(NAMES.findall(attributes)).lower())) if "=" in attributes else ()
            self.open.append((name, words))

    def read(self, page: str) -> list[Block]:
        for m in TOKEN.finditer(page):
            name = m[3]
            if name:
                self.tag(m[2] == "/", name.lower(), m[4])
            else:
                raw = m[0]
                if raw[0] != "<" or raw == "<":
                    if "&" in raw:
                        raw = references.unescape(raw)
                    self.parts.append(raw)
                    if self.in_link:
                        self.linked += len(raw)
        self.flush()
        return self.blocks


def hashed(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


def of_ancestors(ancestors: tuple[tuple[str, tuple[str, ...]], ...], known: dict) -> list[int]:
    """Features of the open elements; remembered, as most blocks of a site share them."""
    if (found := known.get(ancestors)) is not None:
        return found
    names, nearest = set(), "none"
    for tag, words in ancestors:
        names.add("t:" + tag)
        names.update("w:" + w for w in words)
        for w in (tag, *words):
            if w in TELLS_OTHER:
                nearest = "other"
            elif w in TELLS_CONTENT and w != "body":
                nearest = "content"
    own = ancestors[-1][0] if ancestors else ""
    names |= {"o:" + own, "n:" + nearest, f"n:{nearest}:{own}"}
    made = [hashed(x) for x in names]
    if len(known) > 20_000:
        known.clear()
    known[ancestors] = made
    return made


def features(blocks: list[Block], known: dict) -> list[list[int]]:
    out = []
    for i, b in enumerate(blocks):
        n = len(b.text)
        out.append(of_ancestors(b.ancestors, known) + [hashed(x) for x in (
            "1", f"len:{min(n, 4000).bit_length()}", f"link:{4 * min(b.linked, n) // n}",
            f"end:{b.text[-1] in '.!?…'}", f"c:{'©' in b.text}",
            f"at:{min(i, 3)}", f"left:{min(len(blocks) - 1 - i, 3)}")])
    return out


@dataclass
class Field:
    """Weights: ``emit[f]`` favours content for feature f; ``step[a, b]`` for neighbours."""

    emit: np.ndarray
    step: np.ndarray
    first: np.ndarray

    def decode(self, rows: list[list[int]]) -> list[bool]:
        """Best sequence of states by Viterbi."""
        if not rows:
            return []
        emit, step = self.emit, self.step.tolist()
        other, content, back = float(self.first[0]), float(self.first[1]), []
        for i, row in enumerate(rows):
            score = float(emit[row].sum())
            if i:
                a, b = other + step[0][0], content + step[1][0]
                c, d = other + step[0][1], content + step[1][1]
                back.append((b > a, d > c))
                other, content = max(a, b), max(c, d)
            content += score
        state = content > other
        states = [state]
        for came_from in reversed(back):
            state = came_from[state]
            states.append(state)
        return states[::-1]


def train(pages: list[tuple[list[list[int]], list[bool]]]) -> Field:
    """Gradient ascent (Adagrad) on the conditional log-likelihood of labelled pages."""
    pages = [p for p in pages if p[0]]
    longest = max((len(x) for x, _ in pages), default=1)
    shape = (len(pages), longest)
    there, truth = np.zeros(shape, bool), np.zeros(shape, np.int64)
    flat: list[int] = []
    sizes: list[int] = []
    for i, (rows, labels) in enumerate(pages):
        there[i, :len(rows)] = True
        truth[i, :len(rows)] = labels
        for row in rows:
            flat += row
            sizes.append(len(row))
    index, begins = np.array(flat), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    model = Field(np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(2))
    past = [np.full(FEATURES, 1e-6), np.full((2, 2), 1e-6), np.full(2, 1e-6)]
    known_emit = np.bincount(index, weights=np.repeat(truth[there], sizes), minlength=FEATURES)
    both = there[:, 1:]
    known_step = np.zeros((2, 2))
    np.add.at(known_step, (truth[:, :-1][both], truth[:, 1:][both]), 1)
    known_first = np.bincount(truth[:, 0], minlength=2).astype(float)
    for _ in range(ROUNDS):
        score = np.zeros((*shape, 2))
        score[..., 1][there] = np.add.reduceat(model.emit[index], begins)
        forward, backward = np.zeros((*shape, 2)), np.zeros((*shape, 2))
        forward[:, 0] = model.first + score[:, 0]
        for t in range(1, longest):
            forward[:, t] = np.logaddexp(*np.moveaxis(forward[:, t - 1, :, None] + model.step, 1, 0)) + score[:, t]
        for t in range(longest - 2, -1, -1):
            ahead = np.logaddexp(*np.moveaxis(model.step + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2, 0))
            backward[:, t] = np.where(there[:, t + 1, None], ahead, 0)
        total = np.logaddexp(*np.moveaxis(forward + backward, 2, 0))
        chance = np.exp(forward + backward - total[..., None])
        pair = np.exp(forward[:, :-1, :, None] + model.step + (score + backward)[:, 1:, None, :]
                      - total[:, 1:, None, None])
        ascent = [
            known_emit - np.bincount(index, weights=np.repeat(chance[..., 1][there], sizes), minlength=FEATURES),
            known_step - pair[both].sum(axis=0), known_first - chance[:, 0].sum(axis=0)]
        for weights, gradient, squares in zip((model.emit, model.step, model.first), ascent, past, strict=True):
            gradient = gradient / len(pages) - SHRINK * weights
            squares += gradient ** 2
            weights += RATE * gradient / np.sqrt(squares)
    return model


def layouts(texts: list[str], n: int) -> Iterator[tuple[str, list[bool]]]:
    """Pages in varied layouts with the labels of their blocks, made of given texts."""
    rng = np.random.default_rng(7)
    texts = texts or ["Text."]

    def some() -> str:
        return references.escape(texts[rng.integers(len(texts))])

    def short() -> str:
        return " ".join(some().split()[:rng.integers(1, 6)]) or "x"

    def one(*choices: str) -> str:
        return choices[rng.integers(len(choices))]

    def named(names: str) -> str:
        return f' {one("class", "class", "id")}="{one(*names.split())}"' if rng.random() < 0.8 else ""

    def other(inside: str, names: str, tag: str = "div") -> tuple[str, list[bool]]:
        parts = [f"<{inside}>{some() if rng.random() < 0.5 else short()}</{inside}>" for _ in range(rng.integers(1, 5))]
        name = f' {one("class", "id")}="{one(*names.split())}"'
        return f"<{tag}{name if tag in ('div', 'section') else named(names)}>{''.join(parts)}</{tag}>", [False] * len(parts)

    def links(tag: str, names: str) -> tuple[str, list[bool]]:
        k = int(rng.integers(2, 8))
        items = "".join(f'<li><a href="/{i}">{short()}</a></li>' for i in range(k))
        return f"<{tag}{named(names)}><ul>{items}</ul></{tag}>", [False] * k

    for _ in range(n):
        page, labels = ["<html><head><title>x</title></head><body>"], []

        def add(part: tuple[str, list[bool]], page=page, labels=labels) -> None:
            page.append(part[0])
            labels.extend(part[1])

        if rng.random() < 0.5:
            add(other(one("p", "div", "h1"), "header masthead top site-header banner", one("header", "div")))
        if rng.random() < 0.8:
            add(links(one("nav", "div", "nav"), "nav menu navigation breadcrumb toolbar"))
        for names in ("ad ads advert sponsor banner promo", "cookie consent notice alert popup",
                      "newsletter subscribe signup form"):
            if rng.random() < 0.4:
                if rng.random() < 0.5:
                    page.append(f'<div class="{one(*names.split())}">{some()}</div>')
                    labels.append(False)
                else:
                    add(other(one("p", "div", "p"), names) if rng.random() < 0.9 else other("label", names, "form"))
        if rng.random() < 0.3:
            add(other("p", "sidebar side related widget", one("aside", "div")))
        tag = one("article", "main", "div", "section", "article", "body")
        name = "" if tag == "body" else named("content post entry article story main-content post-body text entry-content") if tag in (
            "article", "main") else f' {one("class", "id")}="{one("content", "post", "entry", "article", "story", "main")}"'
        if tag != "body":  # else the text stands straight in the body
            page.append(f"<{tag}{name}>")
        if rng.random() < 0.7:
            page.append(f"<h1>{short()}</h1>" if rng.random() < 0.8 else f"<header><h1>{short()}</h1></header>")
            labels.append(True)
        for _ in range(rng.integers(1, 14)):
            kind = one("p", "p", "p", "p", "p", "h2", "blockquote", "li", "pre", "open", "td")
            text = some() if rng.random() < 0.75 else short()
            page.append({"li": f"<ul><li>{text}</li></ul>", "open": f"<p><b>{text}<br>",
                         "td": f"<table><tr><td>{text}</td></tr></table>"}.get(kind, f"<{kind}>{text}</{kind}>"))
            labels.append(True)
            if rng.random() < 0.06:
                add(other("p", "ad advert promo share social related newsletter", one("div", "aside")))
        if rng.random() < 0.15:
            add(other(one("p", "div"), "comments comment discussion respond", one("section", "div")))
        if tag != "body":
            page.append(f"</{tag}>")
        if rng.random() < 0.4:
            add(other(one("p", "div", "li"), "comments comment discussion respond", one("section", "div")))
        if rng.random() < 0.4:
            add(other("p", "sidebar widget related recommended", one("aside", "div")))
        if rng.random() < 0.3:
            page.append(f'<form action="/s"><label>{short()}</label><input name="q"><button>{short()}</button></form>')
            labels += [False, False]
        if rng.random() < 0.85:
            page.append(f'<{one("footer", "footer")}{named("footer legal copyright")}>&copy; {some()}</footer>')
            labels.append(False)
        yield "".join(page) + "</body></html>", labels


def trained(pages: DataFrame, column: str = "html") -> Field:
    """The field trained on layouts made of a bounded sample of the table's own texts."""
    found = pages.select(F.col(column).alias("html"), F.xxhash64(column).alias("place")).filter("html is not null")
    # first the hashes alone, then the pages they name, copies once
    last = found.select("place").distinct().orderBy("place").limit(SAMPLE).agg(F.max("place")).first()[0]
    rows = [] if last is None else (
        found.filter(F.col("place") <= last).dropDuplicates(["place"]).orderBy("place").collect())
    texts = [b.text for r in rows for b in Reader().read(r["html"])]
    known: dict = {}
    made = []
    for page, labels in layouts(texts[:20 * SAMPLE], TRAINING):
        blocks = Reader().read(page)
        if len(blocks) == len(labels):  # a text without letters leaves no block
            made.append((features(blocks, known), labels))
    return train(made)


def main_text(page: str, model: Field, known: dict) -> str:
    blocks = Reader().read(page)
    chosen = model.decode(features(blocks, known))
    return "\n\n".join(b.text for b, c in zip(blocks, chosen, strict=True) if c)


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", column: str = "html") -> DataFrame:
    """Key, address, main text and its length of every page."""
    model = trained(pages, column)

    @F.pandas_udf("string")
    def extract(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict = {}
        for part in parts:
            yield pd.Series([main_text(p or "", model, known) for p in part], dtype=object)

    found = pages.select(F.col(key), F.col(url), extract(F.col(column)).alias("text"))
    return found.select(key, url, "text", F.length("text").cast("long").alias("n_chars"))
