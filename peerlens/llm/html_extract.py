"""Main-text extraction with a recurrent block labeller.

A page is parsed into its leaf sequence: blocks of text between block-level
tags, each with the path of open elements above it.  A bidirectional LSTM in
numpy reads one vector per block (hashed tag path, hashed words, a few
counts) over the whole page and says for every block whether it belongs to
the main text, so a block is judged by everything before and after it.

The labeller is trained here, without hand-made labels: ``teacher`` marks the
blocks of at most ``TRAIN_PAGES`` pages of the input by their element names,
and every such page is also shown with planted boilerplate (sidebars, notices,
forms, reader comments) and with anonymous containers, so that the network
has to use words and neighbours too.  The sample is the pages with the
smallest id hash among those of at most ``TRAIN_CHARS`` characters.

Text of a block: character references decoded, white space runs to one space,
trimmed; blocks in page order joined by a blank line.  Scripts, styles and
comments of the markup are no blocks.  A head ends at the first tag or text
that cannot stand in it; another unseen element that has no end tag of its own
ends at the first ``FLOW`` tag, found by a second reading of such a page.

Cases: null or empty html gives an empty text; broken markup is read to its
end; very long pages are read whole; repeated rows and null ids are extracted
one by one; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerlens.llm.text import words

TRAIN_PAGES = 256
TRAIN_CHARS = 100_000
TAG_DIM, WORD_DIM, HIDDEN = 40, 12, 16
PLANT_RATE, SHOWN = 0.3, 2      # boilerplate per block, changed copies per page
USUAL = 24                      # names of a path up to which it is not scaled down
EPOCHS, BATCH, RATE = 14, 32, 0.02

#: Element names with fixed meaning in HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark "
                   "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
UNSEEN = frozenset("head script style template noscript title svg math iframe object select "
                   "textarea".split())
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template "
                    "title".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("body article section main div nav aside footer header form table ul ol dl td th "
                   "blockquote figure".split())
#: Tags of visible content: an unseen element left open ends there.
FLOW = SCOPES | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr pre hr center address fieldset details "
                          "dialog menu".split())
#: Names of boilerplate, as elements or as parts of class and id names.
BOILER_TAGS = frozenset("nav footer aside form button menu dialog header".split())
BOILER_NAMES = frozenset("ad ads advert advertisement banner breadcrumb comment comments cookie disqus "
                         "footer header menu nav navbar newsletter notice popup promo related share "
                         "sidebar social sponsor subscribe".split())


class Block(NamedTuple):
    path: tuple[str, ...]   # open elements and their names, outermost first: "div", ".ad"
    text: str
    link_chars: int


class _Leaves(HTMLParser):
    """Collects the blocks of a page.  ``loose``: where unseen elements begin
    that are left open; ``left`` collects these places."""

    def __init__(self, loose: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.loose, self.left, self.at = loose, set(), 0
        self.begun: list[int] = []      # where the open unseen elements begin
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = self.hidden = self.links = 0

    def updatepos(self, i, j):
        self.at = j
        return j                # line numbers are not needed

    def set_cdata_mode(self, *args, **kwargs):
        if not (self.begun and self.begun[-1] in self.loose):
            super().set_cdata_mode(*args, **kwargs)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                path = tuple(n for tag, names in self.open if tag not in INLINE for n in names)
                self.blocks.append(Block(path, text, self.linked))
            self.parts, self.linked = [], 0

    def _pop(self, at: int, ended: bool = False) -> None:
        """Close the elements from ``at`` on, the first by its end tag if ``ended``."""
        for k in range(len(self.open) - 1, at - 1, -1):
            tag = self.open[k][0]
            if tag in UNSEEN:
                self.hidden -= 1
                begin = self.begun.pop()
                if tag != "head" and not (ended and k == at):
                    self.left.add(begin)
            self.links -= tag == "a"
        del self.open[at:]

    def _end_hidden(self, tag: str) -> None:
        """Close the unseen elements that cannot hold ``tag``."""
        while self.hidden:
            at = max(k for k, (name, _) in enumerate(self.open) if name in UNSEEN)
            if not (tag not in IN_HEAD if self.open[at][0] == "head"
                    else tag in FLOW and self.begun[-1] in self.loose):
                return
            self._pop(at)

    def _close_implied(self, tags: set[str]) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            tag = self.open[at][0]
            if tag in tags:
                self._pop(at)
                return
            if tag in SCOPES:
                return

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            self._end_hidden(tag)
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            elif tag not in INLINE:
                self.flush()
            return
        if tag not in INLINE:
            self.flush()
            self._close_implied({"p"} | CLOSES.get(tag, set()))
        names = [tag]
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                names += ["." + v for v in re.split(r"[\s_-]+", value.lower()) if v]
        self.open.append((tag, tuple(names)))
        if tag in UNSEEN:
            self.hidden += 1
            self.begun.append(self.at)
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.flush()
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._pop(at, ended=True)
                return

    def handle_data(self, data):
        if self.hidden == 1 and self.open[-1][0] == "head" and not data.isspace():
            self._end_hidden("")
        if not self.hidden:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def blocks(html: str | None) -> list[Block]:
    """The leaf sequence of a page (none for a null or empty page)."""
    if not html:
        return []
    def read(loose: frozenset[int]) -> _Leaves:
        leaves = _Leaves(loose)
        leaves.feed(html)
        leaves.close()
        leaves.flush()
        leaves._pop(0)
        return leaves

    leaves = read(frozenset())
    if leaves.left:
        leaves = read(frozenset(leaves.left))
    return leaves.blocks


# ------------------------------------------------------------------- vectors
def _table(rows: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((rows, dim)).astype(np.float32)


_TAGS, _WORDS = _table(4096, TAG_DIM, 11), _table(4096, WORD_DIM, 13)
N_INPUT = TAG_DIM + WORD_DIM + 4
_paths: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    if (v := _paths.get(path)) is None:
        at = [crc32(n.encode()) % 4096 for n in dict.fromkeys(path)] or [0]
        v = _TAGS[at].sum(0) / max(2, (len(at) / USUAL) ** 0.5 * 2)
        if len(_paths) < 20_000:
            _paths[path] = v
    return v


def vectors(seq: list[Block]) -> np.ndarray:
    """One input row per block: tag path, words, length, words, links, last mark."""
    if not seq:
        return np.zeros((0, N_INPUT), np.float32)
    out = np.empty((len(seq), N_INPUT), np.float32)
    w = words(pa.array([b.text for b in seq], pa.large_string()))
    counts = np.diff(w.offsets)         # a block has a word at least
    sums = np.add.reduceat(_WORDS[(w.hashes & np.uint64(4095)).astype(np.int64)], w.offsets[:-1])
    n = np.array([len(b.text) for b in seq], float)
    out[:, :TAG_DIM] = [_path_vector(b.path) for b in seq]
    out[:, TAG_DIM:TAG_DIM + WORD_DIM] = sums / (counts + 4)[:, None]
    out[:, -4] = np.log1p(n) / 4 - 1
    out[:, -3] = np.log1p(counts) / 3 - 1
    out[:, -2] = np.minimum(1.0, np.array([b.link_chars for b in seq]) / n)
    out[:, -1] = [b.text[-1] in ".!?" for b in seq]
    return out


# ------------------------------------------------------------------ labeller
class BiLstm:
    """Bidirectional LSTM with a logistic output per step, in numpy.

    ``w[d]`` maps (input, state, 1) to the gates (in, forget, out, cell) of
    direction ``d``; ``v`` maps both states and 1 to the score."""

    def __init__(self, n_input: int = N_INPUT, hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.w = [rng.standard_normal((n_input + hidden + 1, 4 * hidden)) * 0.15 for _ in range(2)]
        for w in self.w:
            w[-1, hidden:2 * hidden] += 1.0
        self.v = rng.standard_normal(2 * hidden + 1) * 0.1

    def _run(self, x: np.ndarray, mask: np.ndarray, d: int, keep: bool):
        """States (steps, pages, hidden) of a direction; padding keeps the state."""
        steps, pages, _ = x.shape
        w, h = self.w[d], self.h
        xw = x @ w[:x.shape[2]].astype(x.dtype) + w[-1].astype(x.dtype)
        u = w[x.shape[2]:-1]
        s, c = np.zeros((pages, h), x.dtype), np.zeros((pages, h), x.dtype)
        w, u = w.astype(x.dtype), u.astype(x.dtype)
        out, memo = np.zeros((steps, pages, h), x.dtype), []
        order = range(steps) if d == 0 else range(steps - 1, -1, -1)
        for t in order:
            m = mask[t][:, None]
            a = xw[t] + s @ u
            gate = 1 / (1 + np.exp(-np.clip(a[:, :3 * h], -30, 30)))
            i, f, o = gate[:, :h], gate[:, h:2 * h], gate[:, 2 * h:]
            g = np.tanh(a[:, 3 * h:])
            c2 = f * c + i * g
            tc = np.tanh(c2)
            if keep:
                memo.append((t, s, c, i, f, o, g, tc))
            s, c = np.where(m, o * tc, s), np.where(m, c2, c)
            out[t] = s
        return out, memo

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d, False)[0] for d in (0, 1)], 2)
        return both @ self.v[:-1] + self.v[-1]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray):
        """Of the mean logistic loss over the unmasked steps."""
        runs = [self._run(x, mask, d, True) for d in (0, 1)]
        both = np.concatenate([r[0] for r in runs], 2)
        p = 1 / (1 + np.exp(-np.clip(both @ self.v[:-1] + self.v[-1], -30, 30)))
        err = np.where(mask, p - y, 0) / max(1, mask.sum())
        gv = np.r_[np.einsum("tp,tph->h", err, both), err.sum()]
        h, n_in = self.h, x.shape[2]
        gw = []
        for d, (_, memo) in enumerate(runs):
            w, g_w = self.w[d], np.zeros_like(self.w[d])
            v = self.v[d * h:(d + 1) * h]
            ds, dc = np.zeros((x.shape[1], h)), np.zeros((x.shape[1], h))
            for t, s, c, i, f, o, g, tc in reversed(memo):
                m = mask[t][:, None]
                ds = ds + err[t][:, None] * v
                do, dct = ds * tc, dc + ds * o * (1 - tc ** 2)
                da = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f),
                                     do * o * (1 - o), dct * i * (1 - g ** 2)], 1) * m
                g_w[:n_in] += x[t].T @ da
                g_w[n_in:-1] += s.T @ da
                g_w[-1] += da.sum(0)
                ds = np.where(m, da @ w[n_in:-1].T, ds)
                dc = np.where(m, dct * f, dc)
            gw.append(g_w)
        return [*gw, gv]

    def fit(self, seqs: list[np.ndarray], labels: list[np.ndarray], seed: int = 5) -> None:
        """Adam over batches of pages of like length."""
        rng = np.random.default_rng(seed)
        params = [*self.w, self.v]
        m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        by_length = sorted(range(len(seqs)), key=lambda k: len(seqs[k]))
        batches = [by_length[i:i + BATCH] for i in range(0, len(by_length), BATCH)]
        step = 0
        for epoch in range(EPOCHS):
            for k in rng.permutation(len(batches)):
                x, mask = padded([seqs[i] for i in batches[k]])
                y = np.zeros(mask.shape)
                for col, i in enumerate(batches[k]):
                    y[:len(labels[i]), col] = labels[i]
                step += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for p, g, a, b in zip(params, self.gradients(x, mask, y), m1, m2):
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    p -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-8)


def padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, seqs))
    x = np.zeros((steps, len(seqs), N_INPUT), seqs[0].dtype)
    mask = np.zeros((steps, len(seqs)), bool)
    for k, s in enumerate(seqs):
        x[:len(s), k], mask[:len(s), k] = s, True
    return x, mask


# ------------------------------------------------------------------ training
def _is_boiler(name: str) -> bool:
    return name in BOILER_TAGS or name[:1] == "." and name[1:] in BOILER_NAMES


def teacher(seq: list[Block]) -> np.ndarray:
    """1 for the blocks of the main text, by element names alone: inside an
    article or main element and not inside boilerplate; on pages without such
    an element, whatever is neither boilerplate nor mostly links."""
    inside = any(n in ("article", "main") for b in seq for n in b.path)
    out = np.zeros(len(seq))
    for k, b in enumerate(seq):
        own = [n for n in b.path if n not in ("article", "main")]
        good = not any(map(_is_boiler, own))
        if inside:
            good = good and any(n in ("article", "main") for n in b.path)
        else:
            good = good and b.link_chars * 2 < len(b.text)
        out[k] = good
    return out


#: Paths of boilerplate that is planted into training pages: outside the main
#: text, and inside it.
OUTER = [("aside",), ("aside", "p"), ("div", ".sidebar", "p"), ("header",), ("header", "h1"),
         ("header", "p"), ("div", ".notice"), ("div", ".cookie", ".notice", "p"), ("form",),
         ("form", "p"), ("section", ".comments", "p"), ("div", ".comment", "p"),
         ("div", ".comments", "h3"), ("div", ".banner"), ("div", ".menu", "ul", "li"),
         ("ul", ".menu", "li"), ("div", ".footer"), ("div", ".newsletter", "p"), ("div", ".ad"),
         ("div", ".related", "ul", "li"), ("div", ".share"), ("div", ".promo", "p"),
         ("nav", "p"), ("footer", "p"), ("div", ".popup", "p"), ("div", ".advert"),
         ("div", ".subscribe", "p"), ("div", ".sponsor"), ("div", ".breadcrumb"),
         ("div", ".social"), ("menu", "li"), ("dialog", "p"), ("button",)]
INNER = [("form", "p"), ("form",), ("aside", "p"), ("aside",), ("div", ".ad"), ("div", ".share"),
         ("section", ".comments", "h3"), ("section", ".comments", "p"), ("nav", "ul", "li"),
         ("section", ".comments", "div", ".comment", "p"), ("div", ".related", "ul", "li"),
         ("div", ".newsletter", "p"), ("div", ".notice"), ("div", ".promo", "p"), ("footer", "p")]
#: Other containers and leaves of main text, with the same labels.
CONTAINERS = [("article",), ("article",), ("main",), ("main", "article"), ("div", ".content"),
              ("div", ".post"), ("section",), ("div", ".story")]
LEAVES = ["p", "h2", "h3", "li", "blockquote", "pre", "td", "div", "figcaption"]


def _planted(seq: list[Block], texts: list[str], rng) -> tuple[list[Block], np.ndarray]:
    """A training page with another container and with boilerplate put in."""
    label = teacher(seq)
    container = CONTAINERS[rng.integers(len(CONTAINERS))]
    main = np.flatnonzero(label)
    out, ys = [], []

    def plant(inner: bool) -> None:
        path = INNER[rng.integers(len(INNER))] if inner else OUTER[rng.integers(len(OUTER))]
        above = ("html", "body", *(container if inner else ()))
        for _ in range(rng.integers(1, 4)):
            words_ = texts[rng.integers(len(texts))].split(" ")
            text = " ".join(words_[:rng.integers(1, 60)])
            out.append(Block(above + path, text, len(text) if "li" in path else 0))
            ys.append(0.0)

    for k, (b, y) in enumerate(zip(seq, label)):
        if rng.random() < PLANT_RATE:
            plant(bool(len(main)) and main[0] < k <= main[-1])
        path = tuple(x for n in b.path for x in (container if n == "article" else (n,)))
        if path and path[-1] == "p" and rng.random() < 0.25:
            path = (*path[:-1], LEAVES[rng.integers(len(LEAVES))])
        if y and rng.random() < 0.15:       # short lines of main text
            b = b._replace(text=" ".join(b.text.split(" ")[:rng.integers(1, 5)]))
        out.append(b._replace(path=path))
        ys.append(y)
        if len(main) and k == main[-1] and rng.random() < 2 * PLANT_RATE:
            plant(True)
            plant(False)
    return out, np.array(ys)


def train(pages: list[str]) -> BiLstm | None:
    """A labeller trained on these pages (None if they have no block)."""
    seqs = [s for s in map(blocks, pages) if s]
    if not seqs:
        return None
    rng = np.random.default_rng(17)
    texts = [b.text for s in seqs for b in s]
    shown = [(s, teacher(s)) for s in seqs] + [
        _planted(s, texts, rng) for s in seqs for _ in range(SHOWN)]
    net = BiLstm()
    net.fit([vectors(s).astype(float) for s, _ in shown], [y for _, y in shown])
    return net


def label(net: BiLstm | None, pages: list[list[Block]]) -> list[np.ndarray]:
    """Which blocks belong to the main text.  Pages of like length run in lockstep."""
    out = [np.zeros(0, bool)] * len(pages)
    order = [k for k in sorted(range(len(pages)), key=lambda k: len(pages[k])) if pages[k]]
    at = 0
    while at < len(order):
        stop = at + 1       # padding at most doubles the steps of a batch
        longest = max(32, 2 * len(pages[order[at]]))
        while stop < len(order) and stop - at < 256 and len(pages[order[stop]]) <= longest:
            stop += 1
        group = order[at:stop]
        if net is None:
            for k in group:
                out[k] = teacher(pages[k]) > 0
        else:
            rows = vectors([b for k in group for b in pages[k]])
            cuts = np.cumsum([len(pages[k]) for k in group])[:-1]
            s = net.scores(*padded(np.split(rows, cuts)))
            for col, k in enumerate(group):
                out[k] = s[:len(pages[k]), col] > 0
        at = stop
    return out


def training_pages(df: DataFrame, id_col: str, html_col: str) -> list[str]:
    usable = df.where(F.col(id_col).isNotNull() & F.length(html_col).between(1, TRAIN_CHARS))
    ids = [r[0] for r in usable.select(id_col).orderBy(F.xxhash64(id_col), id_col)
           .limit(TRAIN_PAGES).collect()]
    rows = (usable.where(F.col(id_col).isin(ids)).select(id_col, html_col)
            .limit(2 * TRAIN_PAGES).collect() if ids else [])
    return [r[1] for r in sorted(rows, key=lambda r: (str(r[0]), r[1]))]


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html",
            url_col: str = "url") -> DataFrame:
    """id, url, text and n_chars of the main text of every page."""
    net = df.sparkSession.sparkContext.broadcast(train(training_pages(df, id_col, html_col)))
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"),
                      F.col(html_col).alias("html"))
    types = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                seqs = [blocks(h) for h in part.column("html").to_pylist()]
                texts = ["\n\n".join(b.text for b, k in zip(s, keep) if k)
                         for s, keep in zip(seqs, label(net.value, seqs))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    names=[id_col, "url", "text", "n_chars"])

    return pages.mapInArrow(run, f"`{id_col}` {types['id']}, url {types['url']}, text string, "
                                 "n_chars long")
