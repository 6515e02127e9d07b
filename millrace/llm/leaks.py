"""Problem 9: evaluation texts inside training text, by greedy string tiling.

Both sides become words free of case, punctuation, marks and look-alikes. Running Karp-Rabin hashes of SEED words are
winnowed: of every LEAST - SEED + 1 consecutive hashes the least is kept, so two texts with LEAST common words in a row
keep a common one. Documents and items are joined by these seeds, whatever their numbers: where the items' seeds are few
(SENT_BYTES), documents are filtered by them in the scan, so that only documents with a common seed leave it; beyond, all
kept seeds are shuffled. Each pair that met is tiled: the longest common run of unmarked words is marked, again and
again, until none of LEAST words is left, so reordered passages add up; runs are compared word by word, hashes only
propose them. Coverage is the marked share of the item, and `least_coverage` its threshold.
"""

from __future__ import annotations

import heapq
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..runtime import Scratch, ship, table
from .lookalikes import INVISIBLE, LATIN_CYRILLIC, LATIN_GREEK
from .texts import _HASHES

#: Least tile and words of a seed; bytes of item seeds that are sent to the tasks; coverage that counts as a whole leak.
LEAST, SEED, SENT_BYTES, WHOLE = 13, 8, 32 << 20, 0.5
_FOLD = {ord(p[1]): p[0] for p in (LATIN_CYRILLIC + " " + LATIN_GREEK).split()} | {ord(c): None for c in INVISIBLE}
_MARKS = re.compile("[\\u0300-\\u036f\\u0483-\\u0487\\u1ab0-\\u1aff\\u1dc0-\\u1dff\\u20d0-\\u20ff]+")
_WORD = re.compile("[\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff]|[^\\W_\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff]+")
#: Base of the rolling hash and its inverse modulo 2^64.
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, a Han character being a word of its own."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text.translate(_FOLD)).translate(_FOLD))
    return _WORD.findall(text.casefold())


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    x = 1
    for i in range(n):
        out[i] = x
        x = x * base & 0xFFFFFFFFFFFFFFFF
    return out


class _Rolling:
    """Karp-Rabin hashes of all windows of k words, by prefix sums; powers are kept."""

    def __init__(self, k: int = LEAST):
        self.k = k
        self.up = self.down = np.empty(0, np.uint64)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if len(h) < self.k:
            return np.empty(0, np.uint64)
        if len(self.up) < len(h):
            n = 2 * len(h) + 1000
            self.up, self.down = _powers(_BASE, n), _powers(_INV, n)
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * self.up[: len(h)], out=sums[1:])
        return (sums[self.k :] - sums[: -self.k]) * self.down[: len(h) - self.k + 1]


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def seeds_of(hashes: np.ndarray) -> np.ndarray:
    """The winnowed hashes, sorted, each once; none below LEAST words."""
    if len(hashes) < LEAST - SEED + 1:
        return np.empty(0, np.uint64)
    return np.unique(np.lib.stride_tricks.sliding_window_view(hashes, LEAST - SEED + 1).min(axis=1))


def common_runs(doc: list[str], item: list[str], fd: np.ndarray, fi: np.ndarray) -> list[tuple[int, int, int]]:
    """All longest common runs (place in doc, place in item, length) of LEAST words or more; fd and fi are the hashes of
    all windows of LEAST words. Each diagonal is walked once, so repeated words cost no more than others."""
    order = np.argsort(fi, kind="stable")
    known = fi[order]
    lo, hi = np.searchsorted(known, fd, "left"), np.searchsorted(known, fd, "right")
    seen = np.zeros(len(doc) + len(item) + 1, np.int64)  # of each diagonal, where in doc its last run ends
    out = []
    for i in np.flatnonzero(hi > lo).tolist():
        js = order[lo[i] : hi[i]]
        for j in np.sort(js[seen[i - js + len(item)] <= i]).tolist():
            n = 0
            while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]:
                n += 1
            if n >= LEAST:  # else the hashes agreed, the words do not
                out.append((i, j, n))
                seen[i - j + len(item)] = i + n
    return out


def tiles(runs: list[tuple[int, int, int]], n_doc: int, n_item: int, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy tiling of common runs: the longest unmarked one first, then the first in doc and item."""
    out, in_doc, in_item = [], np.zeros(n_doc, bool), np.zeros(n_item, bool)
    heap = [(-n, a, b) for a, b, n in runs]
    heapq.heapify(heap)
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        taken = in_doc[a : a + n] | in_item[b : b + n]
        if taken.any():  # what is left of it comes back at its place
            cut = np.flatnonzero(np.diff(np.concatenate(([1], taken.astype(int), [1]))))
            for s, e in zip(cut[::2].tolist(), cut[1::2].tolist()):
                if e - s >= least:
                    heapq.heappush(heap, (s - e, a + s, b + s))
            continue
        in_doc[a : a + n] = in_item[b : b + n] = True
        out.append((a, b, n))
    return out


def _seeds(key: str, sent):
    """(key, text) to (key, seeds); sent: a broadcast sorted array of the seeds that matter, or None for all."""

    def run(batches):
        import pyarrow as pa

        roll = _Rolling(SEED)
        known = None if sent is None else np.frombuffer(sent.value, np.int64).view(np.uint64)
        for b in batches:
            ids, out = [], []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = seeds_of(roll(word_hashes(words_of(text))))
                if known is not None and len(f):
                    f = f[np.isin(f, known, assume_unique=True)] if len(f) * 8 > len(known) else f[_within(f, known)]
                if len(f):
                    ids.append(k)
                    out.append(f.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=[key, "seeds"])

    return run


def _within(f: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(f), bool)
    at = np.searchsorted(known, f)
    at[at == len(known)] = 0
    return known[at] == f


def _tile(batches):
    """Pairs (doc_id, item_id, text, item) to their tiles; pairs without one have no row."""
    import pyarrow as pa

    roll, last = _Rolling(), (None, [], np.empty(0, np.uint64))
    for b in batches:
        rows = []
        for doc, it, text, item in zip(*(b.column(n).to_pylist() for n in ("doc_id", "item_id", "text", "item"))):
            if last[0] != text:
                w = words_of(text)
                last = (text, w, roll(word_hashes(w)))
            _, w, fd = last
            v = words_of(item)
            found = tiles(common_runs(w, v, fd, roll(word_hashes(v))), len(w), len(v))
            if found:
                rows.append((doc, it, max(x[2] for x in found), len(found), sum(x[2] for x in found) / len(v)))
        cols = list(zip(*rows)) if rows else [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "longest", "tiles", "coverage"])


def leaks(documents: DataFrame, items: DataFrame, scratch: Scratch, least_coverage: float = 0.0) -> DataFrame:
    """(doc_id, item_id, longest, tiles, coverage) of every document that shares LEAST consecutive words with an item, if
    its tiles cover that share of the item.

    Null texts share nothing and rows without an id are left out; repeated rows give one row or equal ones; either table
    may be empty. Only pairs with a common seed are shuffled, where the items' seeds fit SENT_BYTES.
    """
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    its = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("item")).filter("item_id is not null and item is not null").distinct()
    seeds = scratch.put(its.mapInArrow(_seeds("item_id", None), "item_id long, seeds array<long>").select("item_id", F.explode("seeds").alias("seed")).distinct(), "seeds")
    few, sent = seeds.select("seed").distinct(), None
    if few.count() * 8 <= SENT_BYTES:
        sent = spark.sparkContext.broadcast(np.sort(few.toPandas()["seed"].to_numpy(np.int64).view(np.uint64)).tobytes())
    mine = docs.mapInArrow(_seeds("doc_id", sent), "doc_id long, seeds array<long>").select("doc_id", F.explode("seeds").alias("seed"))
    pairs = scratch.put(mine.join(seeds, "seed").select("doc_id", "item_id").distinct(), "pairs")
    x = docs.join(pairs, "doc_id").join(its, "item_id").select("doc_id", "item_id", "text", "item")
    out = x.mapInArrow(_tile, "doc_id long, item_id long, longest int, tiles int, coverage double").distinct()
    return out.filter(F.col("coverage") >= least_coverage) if least_coverage > 0 else out


def _all(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), Scratch(spark, "p9"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _all(spark, d).select("doc_id", "item_id").distinct()


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """Per item: documents that leak it, those whose tiles cover WHOLE of it or more, longest passage, greatest coverage."""
    whole = F.when(F.col("coverage") >= WHOLE, F.col("doc_id"))
    return _all(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.countDistinct(whole).alias("n_whole"), F.max("longest").alias("longest"), F.round(F.max("coverage"), 4).alias("coverage"))
