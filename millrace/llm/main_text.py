"""Problem 5: the main body of a page among its menus, notices, side columns and footers.

A text is a flat list of blocks, one a line. Each block has its word count, its link density, whether it ends like a
sentence or is a list entry, and the same of its neighbours: word count and link density of the lines before and after,
the length of the run of short lines it stands in, and the link density carried down from a column's title. Link density
is the share of a block's words in link labels. The flat text has no anchors, so a piece counts as a label by its form
(one of several short pieces between separators) or by the lists of `furniture.py`; the lists come in through this one
feature and the titles of columns. A decision tree, grown once on the labelled pages of `labelled.py`, tells body from the
rest. The work is one narrow pass: no shuffle, no corpus table, nothing broadcast but the tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..runtime import table
from . import labelled
from .furniture import ACTION_SET, CHOICE_SET, COPYRIGHT, LABEL_SET, NOTICE_PIECES, SIDE_SET

_SEP = re.compile(r"[.!。|]|\s[·»/>›•–—-](?=\s)|\s\s")
_BARS = re.compile(r"\s[|·»/>›]\s|\|| {2,}")
_WIDE = re.compile(r"\s{3,}")
_BAR, _CUT, _DIGIT = re.compile(r"[|·»/>›]|  "), re.compile(r"[.!。]\s*\S|\s[-–—•]\s"), re.compile(r"\d")
_NUM = re.compile(r"\d+(?:[.,-]\d+)*")
_HAN = re.compile("[㐀-鿿]")
_BULLET = re.compile(r"^\s*(?:[*•‣◦-]|\d+[.)])\s+\S")
_END = re.compile(r"[.!?;:…。！？；：]['\")»”]?\s*$")
_STOP = re.compile(r"[.。]['\")»”]?\s*$")
NAMES = ("words", "links", "ends", "bullet", "column", "run", "words_before", "links_before", "ends_before", "words_after", "links_after", "ends_after")
#: Those that come from other lines than the block itself.
NEIGHBOURS = NAMES[4:]
_LINKS = LABEL_SET | ACTION_SET | CHOICE_SET
#: Some piece of a notice, by what they begin with.
_NOTICE = re.compile("|".join(map(re.escape, NOTICE_PIECES)))
#: Words of a usual entry of a side column, and of a link label between separators.
SIDE_WORDS, LABEL_WORDS = 9, 4


#: Letters of the longest label, with room for the numbers beside it.
_LONGEST = max(map(len, _LINKS))
_NUMBERS = " 0123456789().,:;-–—•·!|»/>›。…"
_DASHES = (" - ", " – ", " — ", " • ", " · ", " » ", " / ", " > ", " › ", "  ", "\t", "|")


def _count(s: str) -> float:
    """Words between blanks, two Han characters counting as one."""
    if s.isascii():
        return len(s.split())
    han = len(_HAN.findall(s))
    return len(_HAN.sub(" ", s).split()) + han / 2 if han else len(s.split())


def _short(s: str) -> bool:
    """Whether it may be a label: all numbers in labels stand at their ends."""
    return len(s.strip(_NUMBERS)) <= _LONGEST


def _pieces(line: str) -> list[str]:
    return [p for p in (x.strip(" .!:,;。|·»/>›•-") for x in _SEP.split(line.strip().casefold())) if p]


def _label_pieces(line: str) -> list[str]:
    """Those of `_pieces` that may be labels: sentences that are too long and have no separator in them are left out."""
    parts = line.replace("!", ".").replace("。", ".").split(".")
    return [q for p in parts if _short(p) or any([d in p for d in _DASHES]) for q in _pieces(p)]


def _own(line: str) -> tuple:
    """(words, links, ends, bullet, title) and (bars, usual label) of a line of any length, by itself."""
    joined = " ".join(line.split())
    if len(line) - len(joined) > 1 and _WIDE.search(line):  # so that no pattern goes over long blanks again and again
        line = _WIDE.sub(lambda m: "  " if "  " in m.group() else m.group()[:2], line)
    low = joined.casefold()
    plain = low.rstrip(" .!:。…")
    bars = len(_BARS.findall(line.strip())) if _BAR.search(line) else 0
    named = bool(COPYRIGHT.match(line))
    if not named and _short(plain):
        numbered = _NUM.sub("#", plain) if _DIGIT.search(plain) else plain
        named = numbered in LABEL_SET or numbered.replace("(#)", "").strip() in LABEL_SET or numbered in ACTION_SET
    if not named and ":" in plain:  # an offer with its ways: share: mail, print
        head, _, tail = plain.partition(":")
        named = head in ACTION_SET and all(x.strip() in ACTION_SET for x in tail.split(","))
    hits = sum([x in low for x in NOTICE_PIECES]) if _NOTICE.search(low) else 0
    links = float(named)
    if not named and (bars or hits or _CUT.search(line)):
        pieces = _pieces(line) if bars or hits else _label_pieces(line)
        bare = [_NUM.sub("", p).replace("()", "").strip() if _DIGIT.search(p) or "()" in p else p for p in pieces]
        if bars >= 2 or not _LINKS.isdisjoint(bare):
            if not bars and not hits:  # all pieces count for the share
                pieces = _pieces(line)
                bare = [_NUM.sub("", p).replace("()", "").strip() for p in pieces]
            sizes = [_count(q) or 0.5 for q in bare]
            total = sum(n for q, n in zip(bare, sizes) if q)  # a number says nothing
            labels = sum(n for q, n in zip(bare, sizes) if q in _LINKS)
            chain = sum(n for q, n in zip(bare, sizes) if q and n <= LABEL_WORDS) if bars else 0.0
            links = max(labels, chain) / total if total else 0.0
        if bars and len(pieces) > 1 and all(_NUM.sub("#", p) in ACTION_SET for p in pieces):
            links = 1.0
        if hits + (sum(q in CHOICE_SET for q in bare) if hits else 0) >= 2:
            links = 1.0
    return (_count(joined), links, float(bool(_END.search(line))), float(bool(_BULLET.match(line))), float(plain in SIDE_SET), bars, float(named))


#: Pages of a site repeat their lines; those that fill no memory are kept.
_kept, KEPT_CHARS = lru_cache(maxsize=200_000)(_own), 110


def _site(url: str) -> set[str]:
    host = re.sub(r"^\w+://", "", url or "").split("/")[0].split(":")[0].casefold()
    return {x for x in host.split(".")[:-1] if len(x) > 3} | ({host} if host else set())


def _columns(lines: list[str], own: list[tuple]) -> list[float]:
    """Link density carried down from the title of a column to its entries, however many; else 0.

    A column ends at a blank line, at links of another kind, at another title, a list, or a body sentence. One entry that
    is long or ends like a sentence does not end it where usual entries go on below it, or, without a full stop, links
    follow; two such lines in a row are body.
    """
    out, inside = [0.0] * len(own), False
    if not any(f[4] for f in own):
        return out

    def ends(i: int) -> bool:
        words, links, sentence, bullet, title, bars, named = own[i]
        return bool(bullet or bars or named or links >= 0.99 or not lines[i].strip())

    def usual(i: int) -> bool:
        return not own[i][2] and own[i][0] <= SIDE_WORDS

    for i, f in enumerate(own):
        if f[4]:
            inside = True
        elif inside:
            inside = not ends(i)
            if inside and not usual(i):
                stop = f[2] and _STOP.search(lines[i])
                below = i + 1 < len(own) and (bool(own[i + 1][6]) and not stop or not own[i + 1][4] and not ends(i + 1) and usual(i + 1))
                inside = below and not (stop and f[0] > SIDE_WORDS)
        out[i] = float(inside)
    return out


def _runs(own: list[tuple]) -> list[int]:
    """Length of the run of short lines without an end that each line stands in; 0 for other lines."""
    out, start = [0] * len(own), 0
    for i in range(len(own) + 1):
        if i < len(own) and 0 < own[i][0] <= SIDE_WORDS and not own[i][2] and not own[i][3]:
            continue
        out[start:i] = [i - start] * (i - start)
        start = i + 1
    return out


def _rows(lines: list[str], url: str) -> list[tuple]:
    """Each line's columns but those of the lines next to it: words, links, ends, bullet, column, run."""
    site, own = _site(url), []
    for line in lines:
        f = _kept(line) if len(line) <= KEPT_CHARS else _own(line)
        if line.strip().casefold() in site:
            f = (f[0], 1.0, *f[2:6], 1.0)
        own.append(f)
    # an entry that ends like a sentence is a headline none the less
    return [(f[0], max(f[1], f[4]), 0.0 if c else f[2], f[3], c, r) for f, c, r in zip(own, _columns(lines, own), _runs(own))]


def _table(pages: list[list[tuple]]) -> np.ndarray:
    """All pages' rows with words, links and ends of the lines before and after, as NAMES; lines beyond a page are 0."""
    flat = np.array([r for p in pages for r in p], float).reshape(-1, 6)
    out = np.zeros((len(flat), len(NAMES)))
    out[:, :6] = flat
    out[1:, 6:9] = flat[:-1, :3]
    out[:-1, 9:12] = flat[1:, :3]
    ends = np.cumsum([len(p) for p in pages])
    out[ends[ends < len(flat)], 6:9] = 0
    out[ends[ends > 0] - 1, 9:12] = 0
    return out


def features(lines: list[str], url: str) -> np.ndarray:
    """One row a line, columns as NAMES."""
    return _table([_rows(lines, url)])


class Tree:
    """A CART classifier (Gini) for a small table; trained in the driver, carried as four arrays."""

    def __init__(self, depth: int = 6, least: int = 30):
        self.depth, self.least = depth, least
        self.col: list[int] = []
        self.cut: list[float] = []
        self.kids: list[list[int]] = []
        self.p: list[float] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Tree:
        self._grow(x, y, 0)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, level: int) -> int:
        me = len(self.col)
        self.col.append(-1)
        self.cut.append(0.0)
        self.kids.append([-1, -1])
        self.p.append(float(y.mean()))
        if level < self.depth and 0 < y.sum() < len(y):
            best = (np.inf, -1, 0.0)
            for c in range(x.shape[1]):
                order = np.argsort(x[:, c], kind="stable")
                v, t = x[order, c], y[order]
                ok = np.flatnonzero(v[1:] > v[:-1]) + 1
                ok = ok[(ok >= self.least) & (len(y) - ok >= self.least)]
                if not len(ok):
                    continue
                left = np.cumsum(t)[ok - 1]
                right = t.sum() - left
                a, b = left / ok, right / (len(y) - ok)
                g = ok * a * (1 - a) + (len(y) - ok) * b * (1 - b)
                k = int(np.argmin(g))
                if g[k] < best[0] - 1e-12:
                    best = (g[k], c, (v[ok[k]] + v[ok[k] - 1]) / 2)
            if best[1] >= 0:
                self.col[me], self.cut[me] = best[1], float(best[2])
                go = x[:, best[1]] > best[2]
                self.kids[me] = [self._grow(x[~go], y[~go], level + 1), self._grow(x[go], y[go], level + 1)]
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Share of furniture in each row's leaf."""
        at = np.zeros(len(x), int)
        col, cut, kids = np.array(self.col), np.array(self.cut), np.array(self.kids)
        rows = np.arange(len(x))
        while True:
            inner = col[at] >= 0
            if not inner.any():
                return np.array(self.p)[at]
            r = rows[inner]
            at[r] = kids[at[r], (x[r, col[at[r]]] > cut[at[r]]).astype(int)]


def train(pages: Iterable[tuple[str, list[str], list[int]]], without: tuple[str, ...] = ()) -> Tree:
    """A tree for (address, lines, marks); features named in `without` are not used."""
    x, y = [], []
    for url, lines, marks in pages:
        x.append(features(lines, url))
        y.append(np.array(marks, float))
    x_ = np.vstack(x)
    x_[:, [NAMES.index(n) for n in without]] = 0
    return Tree().fit(x_, np.concatenate(y))


@lru_cache(maxsize=1)
def default_tree() -> Tree:
    """The tree of all labelled pages, which have a few thousand lines (their bound)."""
    return train(labelled.pages())


def furniture(texts: list[str], urls: list[str], tree: Tree) -> list[np.ndarray]:
    """Per text, for each line, whether it is not main body. Blank lines are neither and count as body."""
    split = [t.split("\n") for t in texts]
    if not split:
        return []
    flat = tree.predict(_table([_rows(s, u) for s, u in zip(split, urls)])) > 0.5
    out, at = [], 0
    for s in split:
        out.append(flat[at : at + len(s)] & np.array([bool(x.strip()) for x in s]))
        at += len(s)
    return out


def records(extracted: DataFrame) -> DataFrame:
    """url_hash, url and text of all records; both are null where the record does not parse."""
    v = F.try_parse_json("data_json")
    get = lambda k: F.when(v.isNotNull(), F.coalesce(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")))
    return extracted.filter("url_hash is not null").select("url_hash", get("url").alias("url"), get("text").alias("text"))


def body_lines(recs: DataFrame, tree: Tree | None = None) -> DataFrame:
    """(url_hash, url, text) to (url_hash, body, off): the kept lines as text, and the numbers (from 1) of the others.

    Null texts are empty; repeated rows give repeated rows; an empty table gives none.
    """
    tree = tree or default_tree()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            marks = furniture(texts, b.column("url").to_pylist(), tree)
            body = ["\n".join(x for x, m in zip(t.split("\n"), k) if not m) for t, k in zip(texts, marks)]
            off = [(np.flatnonzero(k) + 1).astype("int32") for k in marks]
            yield pa.RecordBatch.from_arrays([b.column("url_hash"), pa.array(body, pa.string()), pa.array(off, pa.list_(pa.int32()))], names=["url_hash", "body", "off"])

    return recs.select("url_hash", "url", "text").mapInArrow(run, "url_hash string, body string, off array<int>")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every line of a readable record that is not main body."""
    lines = body_lines(records(table(spark, d, "extracted")))
    return lines.select("url_hash", F.explode("off").alias("line_no")).distinct()
