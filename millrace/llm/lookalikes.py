"""Problem 10: one form for texts that look the same.

Characters without context first: width forms of letters and digits, joined letters, radicals and compatibility
characters of the same shape become the plain ones, invisible characters go, blanks and hyphens of special kinds become
the usual one each, accents are composed. Then script-aware repair: a token's dominant script is that of its letters that
no other script has (where it has none, the text's); letters of other scripts in it are replaced by look-alikes of that
script if all of them have one and the result is a word of the corpus. Of several possible scripts the dominant one is
tried first. A token wholly in another script than its text counts as mixed with the text around it. A word that no text
has as it is, but that two tokens of different spelling lead to, counts as a word of the corpus too, so that two altered
copies still meet. Tokens whose results are no words of the corpus stay as they are.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..runtime import Scratch, table
from .alike import SENT

#: Look-alike letters, Latin beside Cyrillic and beside Greek.
LATIN_CYRILLIC = "aа cс eе oо pр xх yу iі jј sѕ AА BВ CС EЕ HН IІ JЈ KК MМ OО PР SЅ TТ XХ YУ"
LATIN_GREEK = "oο vν AΑ BΒ EΕ ZΖ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ YΥ XΧ"
#: Letters that stand for Latin ones but are rare enough to say which script a token has.
RARE_TO_LATIN = "hһ dԁ qԛ wԝ lӏ pρ xχ uυ aα kκ iι"
#: Characters that show nothing; blanks and hyphens that look like the usual ones.
INVISIBLE = "".join(map(chr, (0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x206A), 0xFEFF)))
BLANKS = "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
HYPHENS = "".join(map(chr, (0x2010, 0x2011, 0x2012, 0xFE63)))


def _plain_table() -> dict[int, str | None]:
    """Context-free replacements by rule from the Unicode character data; what NFC does is left to NFC."""
    out: dict[int, str | None] = {ord(c): None for c in INVISIBLE} | {ord(c): " " for c in BLANKS} | {ord(c): "-" for c in HYPHENS}
    for c in map(chr, range(0xA0, 0x10000)):
        tag = unicodedata.decomposition(c).partition(">")[0][1:]
        if tag not in ("wide", "narrow", "compat", "initial", "medial", "final", "isolated") or ord(c) in out:
            continue
        k = unicodedata.normalize("NFKC", c)
        kinds = {unicodedata.category(x)[0] for x in k}
        if tag == "compat":  # joined letters, numerals of letters, radicals; not letters of another shape
            name = unicodedata.name(c, "")
            fits = kinds <= {"L", "M"} and "L" in kinds and (len(k) > 1 or "ROMAN NUMERAL" in name or "RADICAL" in name)
        else:
            fits = kinds <= {"L", "M", "N"}
        if fits:
            out[ord(c)] = k
    out[0xB5] = "μ"
    return out


PLAIN = _plain_table()
#: Any character that a replacement may touch.
_RARE = re.compile("[" + "".join(map(re.escape, map(chr, PLAIN))) + "]")
_CYRILLIC, _GREEK = re.compile("[\u0400-\u052f]"), re.compile("[\u0370-\u03ff]")
_LATIN = re.compile("[A-Za-z]")
_TOKEN = re.compile("(?:[^\\W_\u4e00-\u9fff][\u0300-\u036f]*)+")
_PAIRS = {("L", k): {p[0]: p[1] for p in t.split()} for k, t in (("C", LATIN_CYRILLIC), ("G", LATIN_GREEK))}
_TO = {
    "L": {v: k for m in _PAIRS.values() for k, v in m.items()},
    "C": _PAIRS[("L", "C")] | {g: _PAIRS[("L", "C")][k] for k, g in _PAIRS[("L", "G")].items() if k in _PAIRS[("L", "C")]},
    "G": _PAIRS[("L", "G")] | {c: _PAIRS[("L", "G")][k] for k, c in _PAIRS[("L", "C")].items() if k in _PAIRS[("L", "G")]},
}
_TO["L"] |= {p[1]: p[0] for p in RARE_TO_LATIN.split()}
#: Letters that other scripts have too say nothing of a token's script.
_SHARED = {v for m in _PAIRS.values() for v in m.values()} | set(_PAIRS[("L", "C")]) | set(_PAIRS[("L", "G")])


def script(c: str) -> str:
    """L, C, G or '' for a character."""
    o = ord(c)
    if 0x400 <= o <= 0x52F:
        return "C"
    if 0x370 <= o <= 0x3FF:
        return "G" if c.isalpha() else ""
    return "L" if c.isalpha() and o < 0x250 else ""


def plain(text: str) -> str:
    """The text after all context-free replacements."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", text.translate(PLAIN) if _RARE.search(text) else text)


def _exclusive(s: str) -> dict[str, int]:
    n = {"L": 0, "C": 0, "G": 0}
    for c in unicodedata.normalize("NFD", s):
        k = script(c)
        if k and c not in _SHARED:
            n[k] += 1
    return n


def _text_script(text: str) -> str:
    n = {"L": len(_LATIN.findall(text)), "C": len(_CYRILLIC.findall(text)), "G": len(_GREEK.findall(text))}
    if not n["C"] and not n["G"]:
        return "L"
    own = _exclusive(text)
    return max("LCG", key=lambda k: own[k])  # without any letter of its own script a text counts as Latin


def convert(token: str, to: str) -> str | None:
    """The token wholly in script `to`; None if a letter has no look-alike there."""
    out = []
    for c in unicodedata.normalize("NFD", token):
        k = script(c)
        if not k or k == to:
            out.append(c)
        elif c in _TO[to]:
            out.append(_TO[to][c])
        else:
            return None
    return unicodedata.normalize("NFC", "".join(out))


def suspects(text: str) -> dict[str, list[str]]:
    """Tokens (of a plain text) to repair, with what they may become: the dominant script's form first."""
    if not (_CYRILLIC.search(text) or _GREEK.search(text)):
        return {}
    main, out = _text_script(text), {}
    for t in set(_TOKEN.findall(text)):
        kinds = {script(c) for c in unicodedata.normalize("NFD", t)} - {""}
        if not kinds:
            continue
        own = _exclusive(t)
        top = max(own.values())
        if len(kinds) == 1 and (top or kinds == {main}):
            continue
        best = max("LCG", key=lambda k: (own[k], k == main)) if top else main
        forms = [f for k in (best, *[k for k in "LCG" if k != best]) if (f := convert(t, k)) is not None]
        if forms and forms != [t]:
            out[t] = list(dict.fromkeys(forms))
    return out


def repair(text: str, words: dict[str, list[str]], known: set[str]) -> str:
    """The text with every suspect replaced by its first form that is in the corpus vocabulary, if one is."""
    chosen = {t: f for t, forms in words.items() if (f := next((x for x in forms if x in known), None)) is not None}
    if not chosen:
        return text
    return unicodedata.normalize("NFC", _TOKEN.sub(lambda m: chosen.get(m.group(), m.group()), text))


def _first_pass(batches):
    """Documents to (id, raw, form, forms, words): form is null where suspects wait for the vocabulary; words are those of
    a text whose plain form differs from it."""
    import hashlib

    import pyarrow as pa

    h = lambda s: hashlib.md5(s.encode("utf-8", "surrogatepass")).hexdigest()
    for b in batches:
        raw, form, forms, words = [], [], [], []
        for t in b.column("text").to_pylist():
            p = plain(t)
            s = suspects(p)
            raw.append(h(t))
            form.append(None if s else h(p))
            forms.append([{"w": f, "token": k} for k, v in s.items() for f in v] if s else None)
            words.append(None if p == t else list(set(_TOKEN.findall(p))))
        strings = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(raw), pa.array(form, pa.string()), pa.array(forms, pa.list_(pa.struct([("w", pa.string()), ("token", pa.string())]))), pa.array(words, strings)], names=["doc_id", "raw", "form", "forms", "words"])


def _second_pass(batches):
    """(id, text, known words among its forms) to (id, form)."""
    import hashlib

    import pyarrow as pa

    for b in batches:
        form = []
        for t, known in zip(b.column("text").to_pylist(), b.column("known").to_pylist()):
            p = plain(t)
            form.append(hashlib.md5(repair(p, suspects(p), set(known or ())).encode("utf-8", "surrogatepass")).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(form, pa.string())], names=["doc_id", "form"])


def forms(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """documents(doc_id, text) to (doc_id, raw, form): hashes of the text and of its one form.

    Null and blank texts (blank in their plain form too) have no row. The vocabulary is every word of every text, as
    written and in its plain form; only
    words that are a possible form are looked up, a semi-join that prunes each text's words before any shuffle.
    """
    blank = "^[\\\\s" + "".join(f"\\\\u{ord(c):04x}" for c in INVISIBLE + BLANKS) + "]*$"
    docs = documents.select("doc_id", "text").filter(F.col("text").isNotNull() & ~F.expr(f"text rlike '{blank}'"))
    first = scratch.put(docs.mapInArrow(_first_pass, "doc_id long, raw string, form string, forms array<struct<w: string, token: string>>, words array<string>"), "first")
    waiting = scratch.put(first.filter("form is null").select("doc_id", F.explode("forms").alias("f")).select("doc_id", "f.*"), "waiting")
    asked = waiting.groupBy(F.col("w").alias("word")).agg((F.min("token") != F.max("token")).alias("met"))
    asked = scratch.put(asked, "asked")
    side = F.broadcast(asked.select("word")) if asked.count() <= SENT else asked.select("word")
    words = docs.select(F.explode(F.array_distinct(F.split("text", "(?:[^\\p{L}\\p{M}\\p{N}]|[\\u4e00-\\u9fff])+"))).alias("w"))
    words = words.union(first.select(F.explode("words").alias("w")))
    known = words.join(side, F.col("w") == F.col("word"), "left_semi").union(asked.filter("met").select("word")).distinct()
    known = scratch.put(known, "known")
    mine = waiting.join(known, "w", "left_semi").groupBy("doc_id").agg(F.collect_set("w").alias("known"))
    again = waiting.select("doc_id").distinct().join(mine, "doc_id", "left").join(docs, "doc_id").select("doc_id", "text", "known")
    done = again.mapInArrow(_second_pass, "doc_id long, form string")
    fixed = first.filter("form is null").select("doc_id", "raw").join(done, "doc_id").select("doc_id", "raw", "form")
    return first.filter("form is not null").select("doc_id", "raw", "form").union(fixed)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents whose texts differ but look the same."""
    scratch = Scratch(spark, "p10")
    f = scratch.put(forms(table(spark, d, "documents"), scratch), "forms").distinct()
    several = f.groupBy("form").agg((F.min("raw") != F.max("raw")).alias("differ")).filter("differ").select("form")
    f = f.join(several, "form", "left_semi")
    x, y = f.alias("x"), f.alias("y")
    pairs = x.join(y, (F.col("x.form") == F.col("y.form")) & (F.col("x.raw") != F.col("y.raw")) & (F.col("x.doc_id") < F.col("y.doc_id")))
    return pairs.select(F.col("x.doc_id").alias("doc_id_a"), F.col("y.doc_id").alias("doc_id_b")).distinct()
