"""Training-data operators against brute force, round trips and labelled cases, with their edge cases."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("millrace.llm.queries")

from millrace.llm import alike, batch_dedup, bpe, chosen_path, components, labelled, leaks, lookalikes, main_text, near_dups, residue, texts  # noqa: E402
from millrace.operators import runs  # noqa: E402
from millrace.runtime import Scratch  # noqa: E402

VOCAB = [f"w{i}" for i in range(400)]


def article(rnd, n=120):
    return [rnd.choice(VOCAB) for _ in range(n)]


def edited(rnd, words, k):
    out = list(words)
    for _ in range(k):
        out[rnd.randrange(len(out))] = rnd.choice(VOCAB)
    return out


def ratio(a, b):
    x, y = ({tuple(t[i : i + 3]) for i in range(len(t) - 2)} for t in (texts.tokens(a), texts.tokens(b)))
    return len(x & y) / len(x | y) if x and y else 0.0


def corpus(seed, groups=25):
    rnd = random.Random(seed)
    out = {}
    for g in range(groups):
        base = article(rnd)
        for c in range(rnd.randrange(1, 5)):
            out[f"d{g:02}{c}"] = " ".join(edited(rnd, base, rnd.randrange(0, 9)))
    out |= {"e1": "", "e2": "", "t1": "two words", "t2": "two words", "z": "中" * 300, "copy1": out["d000"], "copy2": out["d000"], "long": " ".join(article(rnd, 20_000))}
    return out


def test_tokens_runs_and_ratio():
    assert texts.tokens("Ab 中文x é_1") == ["ab", "x", "_1", "中文"]
    rnd = random.Random(1)
    for _ in range(20):
        a = article(rnd, 30)
        b = edited(rnd, a, 4)
        x, y = (texts.runs(w, 3) for w in (a, b))
        assert texts.jaccard(x, y) == pytest.approx(ratio(" ".join(a), " ".join(b)))
    assert not len(texts.runs(["a", "b"], 3)) and texts.jaccard(x[:0], y[:0]) == 0.0


def similar(spark, docs):
    df = spark.createDataFrame(list(docs.items()), "id string, text string").withColumn("tkey2", F.lit(1))
    members, links = near_dups.similar_sets(df.select("id", "text"), Scratch(spark, "t"))
    by = {}
    for i, s in members.collect():
        by.setdefault(s, []).append(i)
    pairs = {tuple(sorted(p)) for v in by.values() for p in itertools.combinations(v, 2)}
    for a, b in links.collect():
        pairs |= {tuple(sorted((x, y))) for x in by[a] for y in by[b]}
    return pairs


def wanted(docs):
    return {tuple(sorted(p)) for p in itertools.combinations(docs, 2) if ratio(docs[p[0]], docs[p[1]]) >= alike.LEAST}


def test_chosen_path_is_exact(spark):
    docs = corpus(3)
    assert similar(spark, docs) == wanted(docs)


def test_chosen_path_splits_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "SMALL", 3)
    monkeypatch.setattr(chosen_path, "DEEPEST", 3)
    docs = corpus(4, 6) | {f"n{i}": " ".join(edited(random.Random(i), article(random.Random(9)), 2)) for i in range(12)}
    assert similar(spark, docs) == wanted(docs)


def test_chosen_path_empty(spark):
    df = spark.createDataFrame([], "id string, text string")
    members, links = near_dups.similar_sets(df, Scratch(spark, "t"))
    assert members.count() == 0 and links.count() == 0


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 1)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = dict(map(tuple, components.connected(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()))
    assert got == {x: find(x) for x in up}
    assert components.connected(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_batches_against_history(spark, tmp_path, monkeypatch):
    docs = corpus(6)
    rnd = random.Random(7)
    ids = sorted(docs)
    sims = {i: rnd.getrandbits(63) for i in ids}
    for a, b in wanted(docs):
        if rnd.random() < 0.7:
            sims[b] = sims[a] ^ (1 << rnd.randrange(63)) ^ (1 << rnd.randrange(63))
    rows = [(i, None if rnd.random() < 0.2 else f"h{hash(docs[i]) % 9999}", None if rnd.random() < 0.1 else sims[i], str(docs[i]), rnd.randrange(6)) for i in ids]
    df = spark.createDataFrame(rows, "url_hash string, chash string, sim long, text string, b int").withColumn("tkey", F.md5("text"))
    folder, probed = str(tmp_path / "index"), []
    monkeypatch.setattr(runs, "FAN", 2)
    for no in range(6):  # every batch by another session
        index = batch_dedup.NeighbourIndex(Scratch(spark.newSession(), "t"), folder)
        part = df.filter(F.col("b") == no).select("url_hash", "chash", "sim", "tkey")
        if no:
            probed.append(index.probe(part))
        index.add(part.union(part.limit(2)))
    assert 1 < len(index.keys.runs) <= 6
    got = {r[0] for r in batch_dedup.repeats(probed, df.select("url_hash", "text"), Scratch(spark, "t")).collect()}
    want = set()
    for i, h, s, t, b in rows:
        for i2, h2, s2, t2, b2 in rows:
            if i2 != i and b2 < b and (h is not None and h == h2 or s is not None and s2 is not None and (s ^ s2).bit_count() <= 3 and ratio(t, t2) >= 0.65):
                want.add(i)
    assert got == want


def test_batch_costs_few_jobs(spark, tmp_path):
    """Of p3_found: a further batch is few jobs, which the driver keeps the plans of, and leaves the last plan as it is."""
    texts = [" ".join(f"w{i // 2}x{j}" for j in range(20)) for i in range(12)]
    cost = []
    for n in (2, 3):
        rows = [(f"u{i}-{b}", b, f"c{i}-{b}", 1 << i // 2, 900) for b in range(n) for i in range(12)]
        spark.createDataFrame(rows, "url_hash string, batch_no int, content_hash string, simhash long, size long").write.parquet(f"{tmp_path}/{n}/pages.parquet")
        spark.createDataFrame([(r[0], json.dumps({"text": texts[k % 12]})) for k, r in enumerate(rows)], "url_hash string, data_json string").write.parquet(f"{tmp_path}/{n}/extracted.parquet")
        began = spark._jsc.sc().dagScheduler().nextJobId()
        found = batch_dedup.p3_found(spark, f"{tmp_path}/{n}")
        cost.append((spark._jsc.sc().dagScheduler().nextJobId() - began, found._jdf.queryExecution().optimizedPlan().toString().count("Relation")))
        assert {r[0] for r in found.collect()} == {r[0] for r in rows if r[1]}
    assert cost[1][1] == cost[0][1] and cost[1][0] - cost[0][0] <= 32


#: Sites and wordings that are in no list and no labelled page.
HELD_OUT = """
https://fyrskeppet.test/a
+Hem | Sortiment | Lediga jobb | Hitta hit | Logga ut
+Start > Fartyg > Lanternor
.Fyrskeppet låg för ankar utanför grundet i fyrtio år och bytte besättning var sjätte vecka.
.Lanternan
.Lågan brann i olja till 1931. Därefter kom gasen, och med den en tystare vakt.
.- Ankare
.- Kätting
+Skriv ut | Tipsa en vän | Spara sidan
.Besättningen bakade sitt eget bröd. På söndagar fick de kaffe med grädde!
+Om webbplatsen | Integritet | Tillgänglighet

https://wiatrak.test/b
+Strona główna · Oferta · Cennik · Kariera · Dla prasy
.Wiatrak stoi na wzgórzu od dwustu lat i nadal miele żyto, kiedy wiatr wieje od morza.
.Skrzydła
.Skrzydła wymieniono w 1978 roku. Nowe są lżejsze, ale szybciej butwieją.
.Młynarz mieszka na dole, a jego syn na górze.
.Mąka
.Worek waży czterdzieści kilo; dwóch ludzi niesie go do wozu.
+Regulamin | Polityka cookies | Dostawa

https://tidewall.test/c
+Solutions / Pricing / Customers / Partners / Resources
+Overview > Walls > Repairs
.The wall keeps the spring tide out of the lower meadows, and every crack in it is reported to the parish.
.Stones from the beach
.Masons fetch the stones at low water. They carry no mortar, because salt would eat it.
.Where does the clay come from?
.Clay is dug behind the church. It is stored under wet sacks until it is needed, sometimes for a whole winter.
+Log out | Preferences | Status page | Changelog

https://fjordhus.test/d
+Forside » Udstillinger » Billetter » Find vej
.Huset ved fjorden er bygget af drivtømmer og tækket med tang, som holder i hundrede år.
.Tanget høstes i juni. Det tørres på stranden, vendes to gange og bæres hjem.
.Rum og mål
.Stuen er lav, for varmen skal blive. I køkkenet står en ovn af lersten.
+Handelsvilkår | Persondata | Job hos os
"""


def accuracy(tree, pages, without=()):
    right = []
    for u, lines, marks in pages:
        x = main_text.features(lines, u)
        x[:, [main_text.NAMES.index(n) for n in without]] = 0
        right += [(p > 0.5) == m for p, m in zip(tree.predict(x), marks)]
    return sum(right) / len(right)


def test_body_classifier_uses_neighbours():
    """The tree splits on neighbours; held-out pages with wordings of no list are told apart, and worse without them."""
    tree = main_text.default_tree()
    assert {main_text.NAMES[c] for c in tree.col if c >= 0} & set(main_text.NEIGHBOURS)
    unseen = list(labelled.pages(HELD_OUT, 0))
    assert accuracy(tree, unseen) >= 0.9
    # pages of the table left out in turn: lists known, sites and articles not
    whole = [list(labelled.pages(p)) for p in labelled._PAGES.strip().split("\n\n")]
    full, alone = [], []
    for k in range(5):
        learn = [x for i, p in enumerate(whole) if i % 5 != k for x in p]
        held = [x for i, p in enumerate(whole) if i % 5 == k for x in p]
        full.append(accuracy(main_text.train(learn), held))
        alone.append(accuracy(main_text.train(learn, main_text.NEIGHBOURS), held, main_text.NEIGHBOURS))
    print("held out", accuracy(tree, unseen), "with neighbours", full, "without", alone)
    assert sum(full) / 5 >= 0.95 and sum(alone) < sum(full)


def test_body_lines_edges(spark):
    page = "Home | News | Contact\nThe mill stands by the river.\n\nCopyright 2024 Mill Imprint"
    rows = [("a", "https://mill.test/x", page), ("n", None, None), ("e", "", ""), ("b", "https://mill.test", "w " * 200_000)]
    got = {r[0]: (r[1], r[2]) for r in main_text.body_lines(spark.createDataFrame(rows, "url_hash string, url string, text string")).collect()}
    assert got["a"] == ("The mill stands by the river.\n", [1, 4]) and got["n"] == got["e"] == ("", []) and got["b"][1] == []
    assert main_text.body_lines(spark.createDataFrame([], "url_hash string, url string, text string")).count() == 0


def test_residue(spark):
    menu, foot = "Home | News | Shop | Contact\n", "\n© 2025 Mill Imprint Privacy"
    bad = ["{{user_name}}\nprice: {{item_price}}", "Text goes here.\nasdf asdf asdf", "404 Page not found. Check the address or go back.", "Please enable JavaScript to continue.", "Lorem ipsum dolor sit amet consectetur adipiscing elit sed", "错误404：您访问的页面不存在", "Veuillez activer JavaScript pour continuer", "Hello __USER_NAME__ of __CITY_NAME__."]
    story = "The miller opened the gate at dawn and the carts rolled in one after another until noon. Nobody minded the rain."
    good = [story, story + " The sign on the door said page not found.", "A short note on mills.", "The manual says that {{ name }} is a template slot. " + story, ""]
    rows = [(f"b{i}", "https://mill.test/", menu + t + foot) for i, t in enumerate(bad)] + [(f"g{i}", "https://mill.test/", menu + t + foot) for i, t in enumerate(good)] + [("n", None, None), ("b0", "https://mill.test/", menu + bad[0] + foot)]
    got = {r[0] for r in residue.residue(spark.createDataFrame(rows, "url_hash string, url string, text string"), Scratch(spark, "t")).collect()}
    assert got == {f"b{i}" for i in range(len(bad))}
    assert residue.residue(spark.createDataFrame([], "url_hash string, url string, text string"), Scratch(spark, "t")).count() == 0


def test_residue_spreads_to_near_copies(spark):
    """A page whose own words are not plain is found by its likeness to one that is; an unlike page is not."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice("bdfglmnprst") + rnd.choice("aeiou") for _ in range(4)) for _ in range(300)]
    trusted = " ".join(words[:140]) + " {{a_b}} " + " ".join(words[140:])
    other = " ".join(words[:140]) + " {a b} " + " ".join(words[140:])  # the slot is broken: not plain by itself
    assert residue.trust(trusted) >= residue.TRUST > residue.trust(other)
    rows = [("t", "", trusted), ("o", "", other), ("x", "", " ".join(reversed(words)))]
    got = {r[0] for r in residue.residue(spark.createDataFrame(rows, "url_hash string, url string, text string"), Scratch(spark, "t")).collect()}
    assert got == {"t", "o"}


def test_bpe_round_trip(spark):
    import base64

    import tiktoken

    with open(f"{bpe.FOLDER}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(8)
    odd = ["", None, "  a \r\n\n b\t", "don't we'LL 12345", "<|endoftext|>", "漢字かな交じり文", "🙂🚚é é", "x" * 700, "a" * 5 + " " * 40]
    odd += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(160, 0x2FF), rnd.randrange(0x4E00, 0x4F00), 10, 32])) for _ in range(60)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got = dict(map(tuple, bpe.encode(df, "doc_id", "text").collect()))
    for i, t in enumerate(odd):
        assert got[i] == enc.encode_ordinary(t or "") and enc.decode(got[i]) == (t or "")
    back = bpe.decode(bpe.encode(df.withColumn("ids", F.lit("clash")), "doc_id", "text"), "doc_id", "ids")
    assert dict(map(tuple, back.collect())) == {i: t or "" for i, t in enumerate(odd)}
    strange = spark.createDataFrame([(1, None), (2, []), (3, [10**7, bpe.encoder("byte_bpe_50k", bpe.FOLDER).first[0xE4]])], "k long, ids array<int>")
    assert dict(map(tuple, bpe.decode(strange, "k", "ids").collect())) == {1: "", 2: "", 3: "\ufffd"}
    assert bpe.decode(strange.limit(0), "k", "ids").count() == 0 and bpe.encode(df.limit(0), "doc_id", "text").count() == 0


def test_bpe_of_long_words(monkeypatch):
    """One word of thousands of letters takes no time that grows with its square; both widths of a place agree."""
    import time

    rnd = random.Random(4)
    enc, t = bpe.Encoder("byte_bpe_50k", bpe.FOLDER), time.time()
    words = ["".join(chr(rnd.randrange(0x4E00, 0x4F00)) for _ in range(8000)), "a" * 3000, "ab" * 2000, "x"]
    first = [enc.encode([w])[0] for w in words]
    assert time.time() - t < 10
    monkeypatch.setattr(bpe, "ENCODE", bpe.ENCODE_LONG)
    enc.met.clear()
    assert [enc.encode([w])[0] for w in words] == first


def test_leaks(spark, monkeypatch):
    rnd = random.Random(9)
    items = {i: article(rnd, 40) for i in range(6)}
    docs = {}
    for d in range(30):
        w = article(rnd, 60)
        i, n = rnd.randrange(6), rnd.choice([12, 13, 14, 25])
        at = rnd.randrange(40 - n + 1)
        docs[d] = " ".join(w[:20] + [x.upper() + rnd.choice(["", ",", "​"]) for x in items[i][at : at + n]] + w[20:])
    docs |= {100: None, 101: "", 102: " ".join(items[0][20:] + items[0][:20])}
    want = {(d, i) for d, t in docs.items() if t for i, w in items.items() if any(leaks.words_of(t)[a : a + 13] == w[b : b + 13] for a in range(len(leaks.words_of(t)) - 12) for b in range(len(w) - 12))}
    dd = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(None, "x"), (9, None)], "item_id long, text string")
    for most in (leaks.SENT_BYTES, 0):  # seeds sent to the scan, or all shuffled
        monkeypatch.setattr(leaks, "SENT_BYTES", most)
        rows = leaks.leaks(dd.union(dd.limit(5)).withColumn("seed", F.lit(1)), it, Scratch(spark, "t")).collect()
        assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(rows) == len(want)
    both = next(r for r in rows if r["doc_id"] == 102)
    assert both["tiles"] == 2 and both["coverage"] == 1.0
    whole = leaks.leaks(dd, it, Scratch(spark, "t"), 0.9).collect()
    assert {r["doc_id"] for r in whole} == {102}
    assert leaks.leaks(dd, it.limit(0), Scratch(spark, "t")).count() == 0 and leaks.leaks(dd.limit(0), it, Scratch(spark, "t")).count() == 0


def tile(doc, item):
    roll = leaks._Rolling()
    return leaks.tiles(leaks.common_runs(doc, item, *(roll(leaks.word_hashes(x)) for x in (doc, item))), len(doc), len(item))


def test_tiles_of_repeated_words():
    """Texts of one word over and over are tiled at once; tiles never overlap and none of LEAST words is left."""
    import time

    t = time.time()
    assert sum(n for *_, n in tile(["a"] * 3000, ["a"] * 300)) == 300
    assert time.time() - t < 5
    rnd = random.Random(2)
    item = article(rnd, 60)
    doc = item[30:] + ["x"] + item[:30] + ["y"] + item[10:24]
    got = tile(doc, item)
    assert sorted(n for *_, n in got) == [30, 30] and all(doc[a : a + n] == item[b : b + n] for a, b, n in got)
    assert tile(item[:12], item) == [] and tile([], item) == [] and tile(item, item) == [(0, 0, 60)]


def test_words_of():
    assert leaks.words_of("L'Été—ＡＢ１ fiﬁ 中文x_y со­p") == ["l", "ete", "ab1", "fifi", "中", "文", "x", "y", "cop"]


def test_lookalikes(spark):
    same = [("café Kilo", "café Kilo"), ("a b", "a b"), ("word", "wo​rd"), ("Ab12", "Ａb１2"), ("first", "ﬁrst"), ("copper", "соpper"), ("a-b", "a‑b"), ("дорога", "дopoгa"), ("EB-4854", "ΕΒ-4854"), ("日本", "⽇本")]
    differ = [("cafe", "café"), ("Word", "word"), ("x2", "x²"), ("1", "①"), ("a!", "a！"), ("a\nb", "a\r\nb"), ("a b", "a  b"), ("rn", "m")]
    rows = [(i, t) for i, t in enumerate(x for p in same + differ for x in p)] + [(900, None), (901, "  "), (902, "​　"), (903, "word"), (904, "word")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    form = {r["doc_id"]: r["form"] for r in lookalikes.forms(df, Scratch(spark, "t")).collect()}
    for n, (a, b) in enumerate(same + differ):
        assert (form[2 * n] == form[2 * n + 1]) == (n < len(same)), (a, b)
    assert not {900, 901, 902} & set(form)
    # without the word in the corpus, nothing is replaced
    alone = spark.createDataFrame([(1, "sоlitary"), (2, "other words")], "doc_id long, text string")
    import hashlib

    assert {r["doc_id"]: r["form"] for r in lookalikes.forms(alone, Scratch(spark, "t")).collect()}[1] == hashlib.md5("sоlitary".encode()).hexdigest()
    assert lookalikes.forms(df.limit(0), Scratch(spark, "t")).count() == 0


def test_residue_spreads_at_the_threshold(spark):
    """Cores of Jaccard 0.8 to 0.95 with a trusted one get its label, whatever their SimHashes; less alike ones do not."""
    rnd = random.Random(11)
    rows, want = [], set()
    for g in range(60):
        base = ["".join(rnd.choice("bdfglmnprst") + rnd.choice("aeiou") for _ in range(4)) for _ in range(rnd.randrange(90, 200))]
        slots = " ".join(base) + "\n" + " ".join("{{a_b}}" for _ in range(3))
        plain = " ".join(edited(rnd, base, 1 + g % 4)) + "\n" + " ".join("{{a_b}}" for _ in range(3))
        rows += [(f"t{g}", "", slots), (f"v{g}", "", plain)]
        x, y = residue.core_runs([slots, plain])
        if texts.jaccard(x, y) >= residue.LEAST:
            want.add((f"t{g}", f"v{g}"))
    df = spark.createDataFrame(rows, "url_hash string, url string, text string")
    marked = df.mapInArrow(residue._fingerprints(main_text.default_tree()), f"url_hash string, trusted boolean, {chosen_path.WALKED}").withColumn("holder", F.col("url_hash"))
    name = {r["sid"]: r["url_hash"] for r in marked.collect()}
    edges = residue.near_cores(marked, df, main_text.default_tree(), Scratch(spark, "t")).collect()
    assert len(want) > 30 and {tuple(sorted((name[a], name[b]))) for a, b in edges} == want


def test_long_furniture_lines_are_found():
    """The same words are furniture at any length; long article lines stay, blanks without end cost nothing."""
    names = ["Home", "News", "Shop", "Contact", "Help", "Jobs", "Archive", "Imprint"]
    cyr = ["Главная", "Новости", "Каталог", "Помощь", "Контакты", "Корзина", "О нас"]
    off = [sep.join(x * 4) for x in (names, cyr) for sep in (" | ", " · ", " » ", " / ")]
    off += ["© 2025 Millrace " + "Imprint Privacy Terms of use Sitemap " * 5, "Share this page: " + ", ".join(["mail", "print", "copy link", "save"] * 6)]
    off += ["We use cookies and similar tools to remember settings, measure visits and show fitting offers to the many guests of our pages. Accept all | Reject | Manage choices"]
    on = ["The miller opened the gate at dawn and the carts rolled in one after another until noon, and nobody on the long road minded the rain.", "Dawn " * 60 + "came."]
    assert all(len(x) > 110 for x in off + on)
    for lines, want in ((off, True), (on, False)):
        for x in lines:
            page = f"A mill by the river.\n{x}\nThe carts rolled in at dawn."
            assert main_text.furniture([page], ["https://mill.test/"], main_text.default_tree())[0].tolist() == [False, want, False], x
    assert main_text.features(["a" + " \t" * 200_000 + "b"], "").shape == (1, len(main_text.NAMES))


def test_side_columns_of_any_length():
    """Ten entries, one of them long and one a question, are off; body sentences, a blank line or a list end the column."""
    entries = ["Eel market", "Old sluice", "Reed harvest", "Night ferry", "Who built the lock?", "Lantern evening", "Heron island", "What the ferry carries on the longest night of a winter that never ends", "Towpath walk", "Weir songs"]
    body = ["The miller opened the gate at dawn and the carts rolled in.", "Nobody on the long road minded the rain."]
    for tail in (["© 2025 Mill Imprint"], body, ["", "A heading", *body]):
        lines = [*body, "Most read", *entries, *tail]
        off = main_text.furniture(["\n".join(lines)], ["https://mill.test/"], main_text.default_tree())[0].tolist()
        assert off == [False] * 2 + [True] * 11 + [x.startswith("©") for x in tail], tail


def test_chosen_path_recall_holds_in_split_buckets(spark, monkeypatch):
    """Borderline pairs whose buckets are split to the deepest level are found as well as the others."""
    import math

    monkeypatch.setattr(chosen_path, "SMALL", 1)  # every bucket is split, and none is compared before the deepest level
    alive = 1.0
    for level in range(1, chosen_path.DEEPEST + 1):
        alive = 1 - math.exp(-alive)
        assert (1 - alive) ** chosen_path.runs_to(level) <= (1 - chosen_path.RECALL) / 2
    rnd = random.Random(12)
    docs = {}
    for g in range(150):  # six apart changes of 98 runs: 80 / 116 shared
        base = ["".join(rnd.choice("bdfglmnprst") + rnd.choice("aeiou") for _ in range(4)) for _ in range(100)]
        docs[f"a{g:03}"] = " ".join(base)
        docs[f"b{g:03}"] = " ".join("x" * (g + 1) + str(i) if i % 16 == 5 else w for i, w in enumerate(base))
    assert len(wanted(docs)) == 150 and 0.65 <= ratio(docs["a000"], docs["b000"]) < 0.7
    df = spark.createDataFrame(list(docs.items()), "id string, text string")
    members, links = near_dups.similar_sets(df, Scratch(spark, "t"))
    assert links.count() == 150


def test_trust_at_any_length():
    """The same residue is trusted above 160 characters and 400 letters as below."""
    for piece in ("test\n", "gone\n", "xxxxx\n", "sorry. try again later. ", "page not found ", "sed do eiusmod tempor incididunt ut ", "Oops sorry error please try again later "):
        for n in (4, 120):
            assert residue.trust(piece * n) >= residue.TRUST, (piece, n)
    story = "The miller opened the gate at dawn and the carts rolled in one after another, and the code of the latest status was gone. "
    assert residue.trust(story) == residue.trust(story * 30) == 0.0
