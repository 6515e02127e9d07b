"""Column builders for text: tokens, cleaning, hashes, fingerprints, names, quality (JVM only)."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

MAX_TOKENS = 20_000
#: Words of shell pages.
SHELL_WORDS = ("登录", "注册", "首页", "导航", "菜单", "javascript", "请开启", "enable javascript", "cookie", "跳转中", "验证中", "404", "not found", "访问被拒绝", "access denied")
MIN_SCORE = 0.12


def tokens(c: Column) -> Column:
    """STR-01: lower-cased words, then of each Han run the overlapping pairs (a lone character as it is); [] for null."""
    low = F.lower(c)
    words = F.regexp_extract_all(low, F.lit(r"[A-Za-z0-9_]+"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit("[一-鿿]+"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: r.substr(i, F.lit(2))))))
    return F.coalesce(F.concat(words, pairs), F.array().cast("array<string>"))


def sampled(t: Column, most: int | None = MAX_TOKENS) -> Column:
    """TOP-06: at most `most` tokens, taken at equal strides; None: all."""
    if most is None:
        return t
    n = F.size(t)
    picked = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.element_at(t, (F.floor(i * (n / F.lit(float(most)))) + 1).cast("int")))
    return F.when(n <= most, t).otherwise(picked)


def clean(c: Column, limit: int | None = None) -> Column:
    """STR-04: without zero-width characters, blanks collapsed, lines trimmed, at most one empty line in a row; at most
    `limit` characters (None: all)."""
    x = F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "​‌‍﻿", ""), r"[ \t\r\f\x0B ]+", " ")
    lines = F.array_join(F.transform(F.split(x, "\n"), lambda s: F.trim(s)), "\n")
    out = F.trim(F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"^\s+|\s+$", ""))
    return out if limit is None else F.substring(out, 1, limit)


def clean_html_text(c: Column) -> Column:
    """STR-05: blanks collapsed, lines trimmed, empty lines dropped."""
    x = F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\r\f\x0B ]+", " ")
    return F.array_join(F.filter(F.transform(F.split(x, "\n"), lambda s: F.trim(s)), lambda s: s != ""), "\n")


def content_hash(c: Column, n: int = 16) -> Column:
    """STR-06: first n hex digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, n)


_RUN = re.compile(r"([a-z0-9_]+)|([一-鿿]+)")


def _token_counts(text: str, most: int | None) -> Counter:
    """Tokens of a text (STR-01) with their counts; the order of words before pairs matters only where it is sampled."""
    found = _RUN.findall(text.lower())
    words = [w for w, _ in found if w]
    for _, han in found:
        if han:
            words += [han] if len(han) == 1 else [han[i : i + 2] for i in range(len(han) - 1)]
    if most is not None and len(words) > most:
        words = [words[int(i * (len(words) / most))] for i in range(most)]
    return Counter(words)


@lru_cache(maxsize=500_000)
def _token_bits(token: str) -> bytes:
    return hashlib.sha256(token.encode("utf-8", "surrogatepass")).digest()[:8]


def _vote(text: str | None, most: int | None) -> int:
    counts = _token_counts(text, most) if text else None
    if not counts:
        return 0
    bits = np.unpackbits(np.frombuffer(b"".join(map(_token_bits, counts)), np.uint8)).reshape(-1, 64)
    weight = np.fromiter(counts.values(), np.int64, len(counts))
    ones = 2 * (weight @ bits) > weight.sum()
    return int.from_bytes(np.packbits(ones).tobytes(), "big") & (1 << 63) - 1


def simhash_of(text: Column, most: int | None = MAX_TOKENS) -> Column:
    """AGG-14 and STR-07: the low 63 bits of the majority vote of a text's token hashes; 0 without tokens.

    A value of the row alone: texts go through an Arrow batch, nothing is shuffled. most: tokens that vote, taken at equal
    strides (None: all).
    """

    @F.pandas_udf(T.LongType())
    def vote(t: pd.Series) -> pd.Series:
        return pd.Series([_vote(x, most) for x in t], dtype="int64")

    return vote(text)


def simhash(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, simhash) of every row."""
    return docs.select(key, simhash_of(F.col(text)).alias("simhash"))


def hamming(a: Column, b: Column) -> Column:
    """STR-07: differing bits of two 63-bit fingerprints."""
    return F.bit_count(a.bitwiseXOR(b))


def shell_hits(text: Column, title: Column) -> Column:
    """How many shell words a page has."""
    low = F.lower(F.concat(F.trim(text), F.lit(" "), title))
    return reduce(lambda a, b: a + b, [F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in SHELL_WORDS])


def is_shell(text: Column, title: Column) -> Column:
    """FLT-10: short and made of shell words, or empty."""
    n, hits = F.length(F.trim(text)), shell_hits(text, title)
    return (n < 400) & ((hits >= 2) | ((n < 80) & (hits >= 1)) | (n == 0))


def quality(text: Column, title: Column, url: Column) -> Column:
    """STR-17: the unrounded score in [0, 1]."""
    text, title, url = (F.coalesce(x, F.lit("")) for x in (text, title, url))
    present = reduce(lambda a, b: a + b, [F.when(F.trim(x) != "", 1).otherwise(0) for x in (title, text, url)])
    s = F.least(F.lit(1.0), F.length(text) / 400.0) * 0.45 + present / 3.0 * 0.35 - F.when(is_shell(text, title), 0.4).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), s))


def safe_filename(c: Column, most: int = 120) -> Column:
    """STR-16: a name that Windows accepts."""
    x = F.rtrim(F.regexp_replace(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"[. ]+$", ""))
    x = F.when(F.upper(F.regexp_extract(x, r"^([^.]*)", 1)).rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"), F.concat(F.lit("_"), x)).otherwise(x)
    return F.substring(F.when(x == "", "_").otherwise(x), 1, most)
