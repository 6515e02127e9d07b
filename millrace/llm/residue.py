"""Problem 1: records that hold only what a template, a failing server or a script-driven site left.

Cores (main bodies) are labelled where the words are plain: a core of which at least TRUST of the text lies in sentences
with unfilled placeholders, filler, error messages or script notices is a trusted residue. Chosen paths (`chosen_path`)
over their five-word runs find cores that may be near-duplicates of each other, with a recall that holds at the threshold
itself; the Jaccard similarity decides, and trusted labels spread over the connected components, so that variants whose
own words are not plain are found too. (At Jaccard 0.8, 64-bit SimHashes differ in about 9 bits, too many for tables.) Equal cores are one row throughout, so a page left a million times costs one row.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..runtime import Scratch, table
from .chosen_path import WALKED, one_each, pairs_of, reader, verified, walk
from .components import connected
from .main_text import default_tree, furniture, records
from .texts import runs_of, signature

#: Share of a core's characters that plain residue must have; words a run, least similarity.
TRUST, RUN, LEAST = 0.5, 5, 0.8
#: Of `simhash_tables`: greatest distance, bit blocks.
FAR, BLOCKS = 3, 5
PLACEHOLDER = re.compile(
    r"\{\{[^{}]{1,80}\}\}|\$\{[^{}]{1,80}\}|<%[=-]?[^%]{1,80}%>|\[\[[^\[\]]{1,80}\]\]|\[insert [^\[\]]{1,80}\]|%[A-Z][A-Z0-9_]+%|%\(\w+\)[sd]|(?<![\w%])%[sd](?!\w)"
    r"|@@\w+|__[A-Z][A-Z0-9_]+__|\{[A-Za-z_][\w.-]*\}|\[%[^%]{1,80}%\]|\{%[^%]{1,80}%\}|#\{[^{}]{1,80}\}|<\w+_\w+>|#[A-Za-z]+(?:_[A-Za-z0-9]+)+#"
)
#: Words of the usual blind text.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
#: Filler, errors and script notices as they stand in such pages, and what goes with them.
FILLER = """
sample paragraph for layout only; dummy copy, replace before launch; text goes here; your headline; your text here; insert summary;
insert text here; caption of picture; asdf asdf asdf; asdf; test test test; test; xxxxx xxxxx; xxxxx; placeholder text; coming soon;
platzhalter überschrift; hier steht später text; blindtext für das layout; platzhaltertext; texte à venir; votre titre; paragraphe d'exemple;
texte d'exemple; titre à venir; légende de l'image; aquí va el texto; su título; texto de ejemplo; párrafo de ejemplo; párrafo de muestra; texto de relleno; pie de foto;
пример абзаца; здесь будет текст; ваш заголовок; заголовок; текст появится позже; текст-заполнитель; 此处填写内容; 待补充; 示例段落文字; 标题占位; 图片说明
"""
ERRORS = """
the page you asked for cannot be found; page not found; not found; the upstream gateway did not answer in time; your session has run out;
the service is briefly unavailable; service unavailable; internal server error; you have no access to this address; forbidden;
this document was moved or removed; something went wrong; gone; bad gateway; gateway timeout; access denied; an error occurred;
wurde die seite nicht gefunden; die seite wurde nicht gefunden; ist der dienst gerade nicht erreichbar; der dienst ist gerade nicht erreichbar;
ist dieser inhalt nicht mehr verfügbar; dieser inhalt ist nicht mehr verfügbar; ist ihre sitzung abgelaufen; zugriff verweigert; interner serverfehler;
ist der zugriff nicht erlaubt; ist ein fehler aufgetreten; l'accès est refusé; le service est indisponible; cette page est introuvable; la page est introuvable;
ce contenu a été supprimé; ce contenu n'existe plus; une erreur est survenue; votre session a expiré; erreur interne du serveur;
no se encontró la página; no tiene permiso para ver esto; el servicio no está disponible; el contenido ya no está disponible; este contenido fue eliminado;
la sesión ha caducado; su sesión ha caducado; error interno del servidor; se ha producido un error; страница не найдена; сервис временно недоступен;
доступ запрещён; доступ запрещен; материал удалён; материал был удалён; произошла ошибка; внутренняя ошибка сервера; сессия истекла;
您访问的页面不存在; 服务暂时不可用; 内容已被删除; 访问被拒绝; 出错了; 页面不存在; 会话已过期; 服务器内部错误; 系统错误
"""
SCRIPTS = """
please enable javascript; enable javascript; javascript is turned off in your browser; your browser blocks scripts; you need to activate scripts;
this application does not run without scripting; checking your browser; javascript is required; turn on javascript;
bitte aktivieren sie javascript; ohne skripte läuft diese anwendung nicht; ihr browser blockiert skripte; javascript ist deaktiviert; ihr browser wird geprüft;
veuillez activer javascript; activez javascript; votre navigateur bloque les scripts; cette application exige des scripts; vérification de votre navigateur;
active javascript; su navegador bloquea los scripts; esta aplicación necesita scripts; comprobando su navegador; включите javascript;
скрипты отключены; ваш браузер блокирует скрипты; браузер блокирует скрипты; проверка браузера; приложение не работает без скриптов;
请启用javascript; 您的浏览器禁用了脚本; 脚本未运行; 正在验证浏览器环境; 请开启javascript; 需要启用脚本
"""
BESIDE = """
oops; sorry; hoppla; leider; désolé; lo sentimos; извините; ошибка; 抱歉; 错误; error; fehler; erreur; http; code; código; код; status; detail; message;
request id; kennung; référence; referencia; номер; 编号; ray; please try again later; try again later; check the address or go back; contact the webmaster;
bitte später erneut versuchen; zurück zur startseite; réessayez plus tard; revenez en arrière; inténtelo más tarde; vuelva atrás; попробуйте позже;
вернитесь назад; 请稍后再试; 返回上一页; to continue; to view this site; before the content can load; and reload the page; one moment;
um fortzufahren; und laden sie neu; pour continuer; puis rechargez la page; un instant; para continuar; y recargue la página; un momento;
чтобы продолжить; и обновите страницу; подождите; 后继续访问; 并刷新页面; 请稍候
"""


def _phrases(*texts: str) -> list[str]:
    return sorted({" ".join(x.split()).casefold() for t in texts for x in t.split(";") if x.strip()}, key=lambda x: (-len(x), x))


_PLAIN = frozenset(_phrases(FILLER, ERRORS, SCRIPTS))
_BESIDE = frozenset(_phrases(BESIDE))
_LETTER_RUN = re.compile(r"[^\W\d_]+")
_BESIDE_LETTERS = {w: sum(map(len, _LETTER_RUN.findall(w))) for w in _BESIDE}
_MARKS = ".,;:!?"


@lru_cache(maxsize=1)
def _finder():
    """All phrases at once."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for w in _PLAIN | _BESIDE:
        out.add_word(w, w)
    out.make_automaton()
    return out


def _han(c: str) -> bool:
    return "一" <= c <= "鿿"


def _inside(c: str) -> bool:
    return (c.isalnum() or c == "_") and not _han(c)


def _stands_alone(text: str, start: int, end: int) -> bool:
    """The piece is not inside a longer word; Han text has no such borders."""
    return not (start and _inside(text[start - 1]) and not _han(text[start])) and not (end < len(text) and _inside(text[end]) and not _han(text[end - 1]))


def _blind(low: str) -> int:
    """Words of blind text, those beside marks too."""
    for mark in _MARKS:
        low = low.replace(mark, " ")
    words = low.split()
    return 0 if LOREM.isdisjoint(words) else sum(map(LOREM.__contains__, words))


def _blanked(text: str, words: frozenset[str]) -> tuple[str, int]:
    """The text with the phrases blanked, the first and longest at each place, and how many there were."""
    spans = sorted((end + 1 - len(w), -len(w)) for end, w in _finder().iter(text) if w in words and _stands_alone(text, end + 1 - len(w), end + 1))
    out, at, n = [], 0, 0
    for start, size in spans:
        if start >= at:
            out += [text[at:start], " "]
            at, n = start - size, n + 1
    return "".join([*out, text[at:]]) if n else text, n


_HINT, _DIGIT = re.compile(r"[{%\[@_<#]"), re.compile(r"\d+")
_SENTENCE = re.compile(r"\n|(?<=[.!?;。！？；…])(?=\s|[一-鿿])")
_LETTERS = re.compile(r"[^\W\d_]")
_IDS = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b|\d+")
_TOKEN = re.compile(r"[一-鿿]|[^\W_一-鿿]+|\{\}")


def _share(sentence: str) -> tuple[float, float]:
    """Letters in the sentence, and how many of them plain residue covers."""
    if _HINT.search(sentence) and PLACEHOLDER.search(sentence):
        n = max(1.0, len(_LETTERS.findall(sentence)))
        return n, n
    low = _IDS.sub(" ", sentence.casefold())
    total = len(_LETTERS.findall(low))
    if not total:
        return 0.0, 0.0
    words = low.split()
    if len(words) >= 4:
        hit = sum(w.strip(".,;:!?") in LOREM for w in words)
        if hit >= 0.7 * len(words):
            return total, total
    rest, n = _blanked(low, _PLAIN)
    if not n:
        return total, 0.0
    left = len(_LETTERS.findall(_blanked(rest, _BESIDE)[0]))
    return (total, total) if left <= 0.3 * total else (total, 0.0)


def trust(core: str) -> float:
    """Share of a core that is plain residue; sentences that only go with one count where one is there."""
    low = core.casefold()
    if _DIGIT.search(low):
        low = _DIGIT.sub(" ", low)  # numbers are blanks to the patterns below; so they may stand between two words here
    # each test is met by every core of which the full count below can accept a sentence, at any length
    found = [w for end, w in _finder().iter(low) if _stands_alone(low, end + 1 - len(w), end + 1)]
    if _PLAIN.isdisjoint(found) and not (_HINT.search(core) and PLACEHOLDER.search(core)) and _blind(low) < 3:
        if sum(_BESIDE_LETTERS.get(w, 0) for w in found) < 0.7 * max(1, sum(map(len, _LETTER_RUN.findall(low))) if found else 1):
            return 0.0
    total = good = around = 0.0
    for s in _SENTENCE.split(core):
        if not s.strip():
            continue
        a, b = _share(s)
        total += a
        good += b
        if not b and a:
            left = len(_LETTERS.findall(_blanked(_IDS.sub(" ", s.casefold()), _BESIDE)[0]))
            if left <= 0.25 * a:
                around += a
    if not total:
        return 0.0
    return (good + around) / total if good or around >= 0.95 * total else 0.0


def shape(core: str) -> list[str]:
    """Words of a core for comparison: placeholders are alike, and so are numbers and words with a number in them."""
    words = _TOKEN.findall((PLACEHOLDER.sub(" {} ", core) if _HINT.search(core) else core).casefold())
    return [w if w.isalpha() or w == "{}" else "#" for w in words]


def core_runs(cores: list[str]) -> list[np.ndarray]:
    """Five-word runs; a shorter core is one run of all its words."""
    words = [shape(c) for c in cores]
    long_ = runs_of(words, RUN)
    return [r if len(w) >= RUN or not w else runs_of([w], len(w))[0] for r, w in zip(long_, words)]


def _fingerprints(tree):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            b = b.filter(b.column("text").is_valid())
            texts = b.column("text").to_pylist()
            marks = furniture(texts, b.column("url").to_pylist(), tree)
            cores = ["\n".join(x for x, m in zip(t.split("\n"), k) if not m).strip() for t, k in zip(texts, marks)]
            sets = core_runs(cores)
            cols = [b.column("url_hash"), pa.array([trust(c) >= TRUST for c in cores], pa.bool_()), *walk(sets, LEAST)]
            yield pa.RecordBatch.from_arrays(cols, names=["url_hash", "trusted", "sid", "n", "s1", "s2", "keys"])

    return run


def _sets(tree):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            b = b.filter(b.column("text").is_valid())
            texts = b.column("text").to_pylist()
            marks = furniture(texts, b.column("url").to_pylist(), tree)
            sets = core_runs(["\n".join(x for x, m in zip(t.split("\n"), k) if not m).strip() for t, k in zip(texts, marks)])
            yield pa.RecordBatch.from_arrays([pa.array([signature(s) for s in sets], pa.int64()), pa.array([s.view("int64") for s in sets], pa.list_(pa.int64()))], names=["sid", "runs"])

    return run


def simhash_tables(sim: str = "sim", bits: int = 64, blocks: int = BLOCKS, far: int = FAR):
    """Keys of the tables: within `far` bits two hashes agree on at least blocks - far whole blocks, so on one key."""
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    out = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - far)):
        key = F.lit(t).cast("long")
        for k in chosen:
            width = edges[k + 1] - edges[k]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(F.col(sim), edges[k]).bitwiseAND(F.lit((1 << width) - 1)))
        out.append(key)
    return F.array(*out)


def near_cores(cores: DataFrame, source: DataFrame, tree, scratch: Scratch, build=None) -> DataFrame:
    """Verified pairs (a, b) of core ids: cores(WALKED, holder), holder being a record that has the core."""

    build = build or (lambda r: r.select("url_hash", "url", "text"))
    read = reader(cores.select("sid", "holder"), source.withColumn("id", F.col("url_hash")), lambda r: build(r).select("url", "text"), _sets(tree), scratch)
    return verified(pairs_of(cores, read, scratch, LEAST), read, scratch, LEAST)


def residue(source: DataFrame, scratch: Scratch, build=None) -> DataFrame:
    """records(url_hash, url, text), or what `build` makes them of, to url_hash of those that are residue.

    A core without words is none. Null texts are no records; repeated rows count once; an empty table gives no rows.
    """
    tree = default_tree()
    recs = source if build is None else build(source)
    marks = recs.select("url_hash", "url", "text").mapInArrow(_fingerprints(tree), f"url_hash string, trusted boolean, {WALKED}")
    marked = scratch.put(marks.withColumn("row", F.monotonically_increasing_id()), "marked")
    plain = marked.groupBy(F.col("sid").alias("of")).agg(F.max("trusted").alias("plain"))
    cores = one_each(marked).withColumnRenamed("url_hash", "holder").drop("trusted").join(plain, F.col("sid") == F.col("of")).drop("of").withColumnRenamed("plain", "trusted")
    cores = scratch.put(cores, "cores")
    edges = scratch.put(near_cores(cores.filter("n > 0"), source, tree, scratch, build), "edges")
    comp = connected(edges, scratch)
    labelled = cores.join(comp.withColumnRenamed("id", "sid"), "sid", "left").select("sid", "trusted", F.coalesce("component", "sid").alias("component"))
    bad = labelled.filter("trusted").select("component").distinct()
    ids = labelled.join(bad, "component", "left_semi").select("sid")
    return marked.join(ids, "sid", "left_semi").select("url_hash").distinct()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return residue(table(spark, d, "extracted").select("url_hash", "data_json"), Scratch(spark, "p1"), records)
