"""Parsers, discovery, reparse, cookies, caches and files on small cases, with nulls, empty bodies and odd markup."""

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.functions import parse as ps, redact, url as ur
from millrace.operators import capture, cookies as ck, dedup, discovery as dv, metrics as mt, reparse as rp, runs, search, tasks as tk, webcache as wc
from millrace.sources import config, files


def one(spark, col, *values, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(col).collect()]


PAGE = """<!DOCTYPE html><HTML LANG="en-GB"><head><title> A &amp; b
</title><meta content='d1' name=Description><meta name="description" content="d2"><meta property="og:title" content="Card">
<meta property="og:image" content="http://10.0.0.1/i.png"><link href="https://h.test/c" rel='canonical'>
<script type="application/ld+json">{"@type": ["Article", "Thing"], "a": [1, 2,],}</script><script type="application/ld+json">{bad</script>
<script>var a = "<p>no</p>";</script></head><body><!-- <p>no</p> --><p>one&nbsp;two</p>
<a class="k" href="/x#f">l</a><a href='../y'>m</a><a href="mailto:q@r">n</a><a href="#top">o</a><a href="/x">p</a></body></HTML>"""


def test_html(spark):
    df = spark.createDataFrame([(PAGE,), ("",), (None,), ("<p></p>",), ("just words",)], "x string")
    rows = [r["h"] for r in df.select(ps.html(F.col("x"), F.lit("https://h.test/a/b/")).alias("h")).collect()]
    h = rows[0]
    assert (h["ok"], h["title"], h["links"]) == (True, "A & b", ["https://h.test/x", "https://h.test/a/y"])
    assert h["text"].split() == ["one", "two", "l", "m", "n", "o", "p"] and h["meta"] == {"description": "d1", "og:title": "Card", "og:image": "http://10.0.0.1/i.png"}
    assert len(h["json_ld"]) == 1 and [r["ok"] for r in rows] == [True, False, False, False, True]


def test_card(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate((PAGE, "", None, "<title>only</title>"))], "i int, x string")
    c = [r["c"] for r in ps.judged_cards(df.select("i", ps.card(F.col("x")).alias("c")), "c").orderBy("i").collect()]
    assert (c[0]["title"], c[0]["lang"], c[0]["canonical"], c[0]["image"], c[0]["ld_types"], c[0]["dropped"]) == ("Card", "en-GB", "https://h.test/c", "", ["Article", "Thing"], ["http://10.0.0.1/i.png"])
    assert [x["ok"] for x in c] == [True, False, False, True]


def test_feed_and_sitemap(spark):
    rss = "<rss><channel><title>T</title><item><title>t</title><link>http://a/</link><pubDate>d</pubDate><description><![CDATA[<b>s</b>]]></description></item><item><title>u</title></item></channel></rss>"
    f = one(spark, ps.feed(F.col("x")), rss, "<!DOCTYPE x><rss><item></item></rss>", "<rss></rss>", None, "<feed><entry><link href='http://b/'/><updated>w</updated></entry></feed>")
    assert [tuple(i) for i in f[0]["items"]] == [("t", "http://a/", "d", "s"), ("u", "", "", "")] and f[0]["feed_title"] == "T"
    assert [x["error"] for x in f] == ["", "DTD", "no items", "no body", ""] and tuple(f[4]["items"][0]) == ("", "http://b/", "w", "")
    s = one(spark, ps.sitemap(F.col("x")), "<urlset><url><loc> http://a/?x&amp;y </loc><lastmod>m</lastmod></url><url></url></urlset>", "<sitemapindex><sitemap><loc>http://s/</loc></sitemap></sitemapindex>", "", None)
    assert [tuple(u) for u in s[0]["urls"]] == [("http://a/?x&y", "m", "", "")] and s[1]["sub_sitemaps"] == ["http://s/"] and [x["ok"] for x in s] == [True, True, False, False]


def test_json(spark):
    got = one(spark, ps.flatten(F.col("x")), '{"a": {"b": [1, null, true, "x"]}, "c": 1.5}', "[]", "no", None, '"s"')
    assert [tuple(x) for x in got[0]] == [("a.b[0]", "1"), ("a.b[1]", ""), ("a.b[2]", "True"), ("a.b[3]", "x"), ("c", "1.5")]
    assert got[1:4] == [[], None, None] and tuple(got[4][0]) == ("", "s")
    assert one(spark, F.size(ps.flatten(F.col("x"), 8, 3, 2)), '[1,2,3,4]', "[" * 12 + "1" + "]" * 12) == [3, 0]
    assert one(spark, ps.embedded_urls(F.col("x")), '{"http://k/": "http://v/", "l": ["https://w/", "ftp://z/", 3]}', "bad") == [["http://v/", "https://w/"], None]
    docs = one(spark, ps.json_doc(F.col("x")), '{"@context": 1, "name": "", "headline": "h"}', '{"name": "n"}', "[1]", "x", None)
    assert [(d["ok"], d["kind"], d["title"]) for d in docs] == [(True, "json_ld", "h"), (True, "json", "n"), (True, "json", ""), (False, "json", ""), (False, "json", "")]


def test_text_playlist_media(spark):
    t = one(spark, ps.plain_text(F.col("x")), " a \t b\n c ", "", " \n ", None)
    assert (t[0]["text"], t[0]["lines"]) == ("a b\n c", 2) and [x["ok"] for x in t] == [True, False, False, False]
    m3u = '#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:5\n#EXT-X-KEY:METHOD=AES-128,URI="k.bin"\n#EXTINF:4,\ns0.ts\n\n/s1.ts\n'
    p = one(spark, ps.playlist(F.col("x"), F.lit("http://h/a/l.m3u8")), m3u, m3u.replace('bin"', 'bin",IV=0xAB'), "#EXTM3U\n#EXT-X-STREAM-INF:B=1\nlow.m3u8", "", None)
    assert (p[0]["segments"], p[0]["key_method"], p[0]["key_uri"], p[0]["media_sequence"]) == (["http://h/a/s0.ts", "http://h/s1.ts"], "AES-128", "http://h/a/k.bin", 5)
    assert p[0]["ivs"] == [f"{5:032x}", f"{6:032x}"] and p[1]["ivs"] == [f"{0xAB:032x}"] * 2 and p[2]["is_master"] and not p[3]["segments"] and not p[4]["segments"]
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "x")
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 7, 9)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 4, 6) + b"\x00" * 6
    rows = [("zip", z.getvalue()), ("zip", b"no"), ("pdf", b"/Type /Pages /Type /Page /Type/Page"), ("png", png), ("gif", b"GIF89a" + struct.pack("<HH", 3, 2)), ("jpeg", jpeg), ("text", b"x"), (None, None)]
    df = spark.createDataFrame([(n, None if b is None else bytearray(b)) for n, b in rows], "n string, b binary")
    got = [r["m"] for r in df.select(ps.media_info("n", "b").alias("m")).collect()]
    assert [(m["ok"], m["entries"], m["pages"], m["width"], m["height"]) for m in got] == [(True, ["a.txt"], None, None, None), (False, None, None, None, None), (True, None, 2, None, None), (True, None, None, 7, 9), (True, None, None, 3, 2), (True, None, None, 6, 4), (False, None, None, None, None), (False, None, None, None, None)]


def test_bytes(spark):
    rows = [("text/html; charset=GBK", "中文".encode("gbk")), (None, b"\xef\xbb\xbfhi"), ("text/html", b"<meta charset='latin-1'>"), ("", b"\x00\x01ab"), (None, None)]
    df = spark.createDataFrame([(c, None if b is None else bytearray(b)) for c, b in rows], "c string, b binary")
    x = df.select(ps.encoding(F.col("c"), F.col("b")).alias("e"), "b").withColumn("t", ps.decoded(F.col("b"), F.col("e"))).withColumn("r", ps.printable_ratio(F.col("b"))).withColumn("k", ps.capped(F.col("b"), 2)["truncated"]).collect()
    assert [r["e"] for r in x] == ["gbk", "utf-8-sig", "latin-1", "utf-8", "utf-8"]
    assert x[0]["t"] == "中文" and x[1]["t"] == "hi" and x[4]["t"] is None and x[3]["r"] == 0.5 and x[3]["k"] and x[1]["k"]


def test_normalized(spark):
    none = F.lit(None).cast("string")
    args = lambda f: (F.lit("u"), F.lit(" T​ "), F.lit("a \n\n\n\n b"), f, none, none, F.array(F.lit(" t "), F.lit("")), F.array(F.lit("http://a/"), F.lit("x"), F.lit("http://a/")), F.lit("p"), F.lit(2), none)
    df = spark.createDataFrame([({"PubDate": "2024-01-02T03:04:05Z", "k": "v", "ok": "1"},), ({"published_at": "junk", "date": "2024-01-02"},), ({"Updated_At": "", "DATE": "1704164645000"},), ({},), (None,)], "f map<string,string>")
    got = [r["n"] for r in df.select(ps.normalized(*args(F.col("f"))).alias("n")).collect()]
    assert [g["published_at"] for g in got] == [1704164645.0, None, 1704164645.0, None, None]
    assert (got[0]["title"], got[0]["text"], got[0]["tags"], got[0]["links"], got[0]["format"]) == ("T", "a\n\nb", ["t"], ["http://a/"], "") and got[0]["extra"] == {"PubDate": "2024-01-02T03:04:05Z", "k": "v"}
    assert set(got[0].asDict()) == set(ps.FIELDS)


def test_discovery(spark):
    x = spark.createDataFrame([("s", "https://www.h.test/a/", ["b", "/c", "b#x", "http://o.test/", "javascript:x", ""], [("http://sub.h.test/", "t"), ("/c", "u")], [("https://h.test/d",)])], "id string, url string, l array<string>, i array<struct<link: string, title: string>>, u array<struct<loc: string>>")
    found = dv.resources(dv.from_parsed(x, "id", "url", html_link="l", feed_item="i", sitemap_url="u"), "base")
    got = {(r["kind"], r["url"], r["reason"]) for r in dv.judged(found, {"html_link": 0, "feed_item": 1, "sitemap_url": 2}, denied=F.col("url").contains("/d")).collect()}
    assert got == {("html_link", "https://h.test/a/b", ""), ("html_link", "https://h.test/a/b", "duplicate"), ("html_link", "https://h.test/c", ""), ("html_link", "http://o.test/", "off_site"), ("feed_item", "http://sub.h.test/", ""), ("feed_item", "https://h.test/c", "duplicate"), ("sitemap_url", "https://h.test/d", "policy")}
    assert dv.resources(dv.from_parsed(x.limit(0), "id", "url", html_link="l"), "base", hosts=["h.test"]).count() == 0


def test_reparse(spark):
    rows = [("1", "http://h/a", "text/html", 1.0, PAGE), ("2", "http://h/b", "text/html", 2.0, PAGE), ("3", "http://h/f", "application/rss+xml", 3.0, "<rss><item><title>One story</title><link>http://h/1</link><description>The miller opened the gate at dawn.</description></item><item><title>x</title><link>http://h/2</link></item></rss>"), ("4", "http://h/j", "application/json", 4.0, "{broken"), ("5", "http://h/t", "text/plain", 5.0, " "), ("6", "http://h/p", "image/png", 6.0, "x"), ("7", None, None, None, None)]
    df = spark.createDataFrame(rows, "sha256 string, url string, mime string, fetched_at double, body string").withColumn("p", F.lit("clash"))
    recs, parsed, stats = rp.run(df)
    said = {r["sha256"]: (r["p"]["ok"], r["p"]["parser"], r["p"]["tried"]) for r in parsed.collect()}
    assert said["1"] == (True, "html_text", ["html_text"]) and said["4"] == (True, "text", ["json", "text"]) and said["5"][0] is False and said["6"][1] == "" and said["7"][0] is False
    states = {(r["sha256"], r["place"]): r["state"] for r in recs.collect()}
    assert states[("1", 0)] == "new" and states[("2", 0)] == "unchanged" and {k for k in states if k[0] == "3"} == {("3", 0), ("3", 1)}
    assert stats.first().asDict() | {"near": 0} == {"scanned": 7, "parsed_ok": 4, "parsed_failed": 3, "records": 5, "accepted": 5, "rejected": 0, "new": 4, "unchanged": 1, "near": 0}
    assert rp.run(df.limit(0))[2].first()["scanned"] == 0
    reg = rp.Registry()
    reg.add(rp.Parser("own", 3, ("pdf",), rp._text))
    reg.add("x")
    reg.add(rp.Parser("own", 3, ("pdf",), rp._text))
    assert [p.name for p in reg.candidates("pdf")] == ["own"] and [w for _, w in reg.skipped] == ["not a Parser", "name taken"]
    assert rp.selected(df, since=2.0, url_like="/F").count() == 1 and rp.selected(df, limit=2).count() == 2


def test_cookies(spark):
    lines = ["# c", ".h.test\tTRUE\t/\tFALSE\t0\ta\t1", "#HttpOnly_h.test\tFALSE\t/p\tTRUE\t0\tb\t2", "x.h.test FALSE / FALSE 5 c 3", "bad", "", "h.test\tFALSE\t/\tFALSE\tx\td\t4"]
    jar = ck.netscape(spark.createDataFrame([(x,) for x in lines], "l string"), "l")
    assert {(r["domain"], r["name"], r["host_only"], r["secure"], r["expires"]) for r in jar.collect()} == {("h.test", "a", False, False, 0.0), ("h.test", "b", False, True, 0.0), ("x.h.test", "c", True, False, 5.0), ("h.test", "d", True, False, 0.0)}
    urls = spark.createDataFrame([(u,) for u in ("https://h.test/p/q", "http://x.h.test/p", "http://o.test/", None)], "u string")
    got = {r["url"]: r["header"] for r in ck.headers(urls, "u", jar, 10.0).collect()}
    assert got == {"https://h.test/p/q": "b=2; a=1; d=4", "http://x.h.test/p": "a=1", "http://o.test/": "", None: ""}
    assert ck.summary(jar, 10.0).first().asDict() == {"total": 4, "expired": 1, "domains": 2} and ck.usable(jar, 10.0).count() == 3
    hosts = spark.createDataFrame([("H.test",), ("o.test",)], "h string")
    assert {tuple(r) for r in ck.missing_reason(hosts, "h", jar, 10.0).collect()} == {("h.test", "usable", 3), ("o.test", "no_domain", 0)}
    assert {r["reason"] for r in ck.missing_reason(hosts, "h", jar.limit(0), 10.0).collect()} == {"empty_jar"}
    js = spark.createDataFrame([('[{"domain": ".h.test", "name": "a", "value": "1", "secure": true, "expirationDate": 7.5}]',), ('{"cookies": [{"domain": "o", "name": "b"}]}',), ('{"domain": "p", "name": "c", "expires": "x"}',), ("bad",), (None,)], "t string")
    assert {(r["domain"], r["name"], r["expires"], r["host_only"]) for r in ck.from_json(js, "t").filter("name <> ''").collect()} == {("h.test", "a", 7.5, False), ("o", "b", 0.0, True), ("p", "c", 0.0, True)}


def test_web_cache(spark):
    rows = [(f"http://h/{i}", 200, {"ETag": f"e{i}", "Set-Cookie": "s"}, 10, float(i)) for i in range(30)] + [("http://h/3", 304, {"Last-Modified": "m"}, 5, 99.0)]
    c = wc.entries(spark.createDataFrame(rows, "url string, status int, headers map<string,string>, size long, fetched_at double"))
    kept = wc.evict(c, 20)
    assert kept.count() == 18 and wc.evict(c, 100).count() == 30
    r = kept.filter("url = 'http://h/3'").select("hits", wc.conditional(F.col("headers")).alias("h"), wc.stale(F.col("fetched_at"), 100.0, 5.0).alias("s")).first()
    assert (r["hits"], r["h"], r["s"]) == (1, {"If-Modified-Since": "m"}, False)
    assert wc.cache_stats(c).first().asDict() == {"entries": 30, "bytes": 295, "hits": 1} and wc.cache_stats(c.limit(0)).first()["bytes"] == 0
    cool = spark.createDataFrame([("a", 5.0, 1, 1), ("a", 9.0, 2, 2), ("b", 3.0, 1, 1)], "domain string, until_epoch double, tier int, throttle_count int")
    assert [tuple(r) for r in wc.cooldowns(cool, 4.0).collect()] == [("a", 9.0, 2, 2)]


def test_robots_cache(spark):
    text = "User-agent: *\nDisallow: /a\nCrawl-delay: x\nCrawl-Delay: 3 # s\n"
    f = spark.createDataFrame([("ok", 200, text, 90.0), ("gone", 404, text, 90.0), ("down", 500, text, 90.0), ("old", 200, text, 1.0), ("none", 200, None, 90.0)], "host string, status int, text string, fetched_at double")
    urls = spark.createDataFrame([(h + p, h, p) for h in ("ok", "gone", "down", "old", "none", "new") for p in ("/a", "/b")], "url string, host string, path string")
    got = {r["url"]: (r["allowed"], r["known"]) for r in wc.robots_decisions(urls, f, "m", 100.0, 50.0).collect()}
    assert got == {"ok/a": (False, True), "ok/b": (True, True), "gone/a": (True, True), "gone/b": (True, True), "down/a": (False, True), "down/b": (False, True), "old/a": (True, False), "old/b": (True, False), "none/a": (True, True), "none/b": (True, True), "new/a": (True, False), "new/b": (True, False)}
    assert {tuple(r) for r in wc.crawl_delays(f, 100.0, 50.0).collect()} == {("ok", 3.0), ("none", None)}


def test_runs(spark, tmp_path):
    merge = lambda x: x.groupBy("k").agg(F.sum("v").alias("v"))
    made = lambda: runs.Runs(spark.newSession(), str(tmp_path / "r"), "k string, v long", ["k"], merge, unit=4, fan=2)
    assert made().read().count() == 0
    for i in range(7):
        r = made()
        r.append(spark.createDataFrame([(f"k{j}", 1) for j in range(i + 1)] + [(None, 1)], "k string, v long"))
        r.append(spark.createDataFrame([], "k string, v long"))
        r.compact()
    got = dict(map(tuple, made().read().collect()))
    assert got == {f"k{j}": 7 - j for j in range(7)} | {None: 7} and len(made().runs) < 7
    asked = spark.createDataFrame([("k3",), ("zz",)], "k string")
    assert dict(map(tuple, merge(made().asked(asked)).collect())) == {"k3": 4}
    stale, fresh = made(), made()
    fresh.append(spark.createDataFrame([("a", 1)], "k string, v long"))
    with pytest.raises(Exception):  # noqa: B017
        stale.append(spark.createDataFrame([("b", 1)], "k string, v long"))


def test_ledger_pieces(spark):
    letters = spark.createDataFrame([(float(i), f"task ab{i % 2}/x", "e") for i in range(12)] + [(1.0, "none", "e"), (1.0, None, "e")], "at double, label string, error string")
    tasks = spark.createDataFrame([("ab0", "done"), ("ab1", "leased"), ("ab1", "leased")], "task_id string, state string")
    assert sorted((r["task_id"], r["at"]) for r in tk.dead_letters_of(letters, tasks, 2).collect()) == [("ab0", 8.0), ("ab0", 10.0), ("ab1", 9.0), ("ab1", 11.0)]
    ev = spark.createDataFrame([("ab0",), ("ab0",), ("ab1",), (None,)], "task_id string")
    assert tk.forget(tasks.distinct(), ev, ev.limit(0), tasks).first().asDict() == {"tasks": 1, "skipped": 1, "evidence": 2, "errors": 0}
    assert tk.without(ev, tasks.limit(1)).count() == 2
    p = spark.createDataFrame([(True, None), (False, "x" * 400)], "ok boolean, error string").select(tk.evidence_of_parse(F.struct("ok", "error")).alias("e")).collect()
    assert [(r["e"]["signal"], len(r["e"]["reason"])) for r in p] == [("ok", 0), ("parser_failed", 300)]
    spans = spark.createDataFrame([("k", 1.0, 3.0), ("k", 2.0, 5.0), ("k", 3.0, 4.0), ("k", None, 1.0)], "k string, a double, b double")
    assert mt.peaks(spans, "k", "a", "b").first()["peak"] == 2
    snap = mt.snapshot(spark.createDataFrame([("n", "n", "counter", 1, 2.0), ("n", "n", "gauge", 2, 3.0), ("m", "m", "gauge", 1, 9.0), ("m", "m", "gauge", 0, 1.0)], "name string, series string, kind string, t int, value double"))
    assert {(r["name"], r["kind"], r["value"]) for r in snap.collect()} == {("n", "conflict", None), ("m", "gauge", 9.0)}


def test_payload_and_probe(spark):
    a, b, c = one(spark, capture.payload(F.col("x")), "http://a/", "http://a/", "http://b/")
    assert a == b != c and all(200 <= len(x) <= 4000 for x in (a, c))


def test_config(tmp_path, spark):
    conf = {"a": 1, "b": {"c": 'q"\\\n', "d": [1.5, True, "x"], "e f": {"g": "é"}}, "n": None, "z": {}}
    (tmp_path / "c.toml").write_text(config.to_toml(conf))
    got, err = config.load(str(tmp_path / "c.toml"), {"a": 0, "b": {"h": 2}})
    assert err == "" and got == {"a": 1, "b": {"h": 2, "c": 'q"\\\n', "d": [1.5, True, "x"], "e f": {"g": "é"}}, "z": {}}
    (tmp_path / "bad.toml").write_text("a = ")
    assert config.load(str(tmp_path / "bad.toml"), {"a": 0})[0] == {"a": 0} and config.load(str(tmp_path / "none"), {})[1]
    spark.createDataFrame([("u", 1)], "url_hash string, status int").write.parquet(str(tmp_path / "t" / "pages.parquet"))
    t = config.open_table(spark, str(tmp_path / "t" / "pages.parquet"), "pages")
    assert "batch_no" in t.columns and t.first()["batch_no"] is None and "batch_no" not in config.schema("pages", 1)
    assert dict(config.available(spark, str(tmp_path / "t")))["pages"] and "no table tasks" in config.health(spark, str(tmp_path / "t"))["problems"]


def test_more_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("链接 http://a/\r\nx".encode("gbk"))
    (tmp_path / "in" / "b.txt").write_bytes(b"\xef\xbb\xbfhttp://b/")
    assert {r["line"] for r in files.decoded_text(spark, str(tmp_path / "in")).collect()} == {"链接 http://a/", "x", "http://b/"}
    assert len(files.hashes(spark, str(tmp_path / "in"), 16).first()["sha256"]) == 16
    df = spark.createDataFrame([(1, "ok"), (2, None)], "id long, v string")
    for _ in range(2):  # the batch comes again
        files.commit_batch(df, 7, F.col("v").isNotNull(), str(tmp_path / "t"), str(tmp_path / "dead"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    letters = files.dead_letters(spark, str(tmp_path / "dead/*"))
    assert files.count_dead_letters(letters).first()["n"] == 1 and files.replay_script(letters).first()["line"].startswith("-- ")
    u = spark.createDataFrame([("http://b/2",), ("http://a/1",), ("http://b/1",), (None,)], "u string")
    assert [r["line"] for r in files.url_blocks(u, "u", ur.host(F.col("u"))).collect()] == ["# a", "http://a/1", "# b", "http://b/1", "http://b/2"]
    (tmp_path / "log").write_text('{"ts": 1.0, "level": "info", "message": "m"}\nbroken\n')
    assert files.logs(spark, str(tmp_path / "log")).count() == 1


def test_capture_store(spark, tmp_path):
    df = capture.put(spark.createDataFrame([(bytearray(b"x"), "u1"), (bytearray(b"x"), "u1"), (bytearray(b"y"), "u2")], "body binary, url string"))
    capture.write(df, str(tmp_path / "s"))
    got = capture.read(spark, str(tmp_path / "s"), df.filter("url = 'u2'").select("sha256"))
    assert [bytes(r["body"]) for r in got.collect()] == [b"y"] and capture.read(spark, str(tmp_path / "s"), df.limit(0)).count() == 0


def test_policy(spark):
    p = redact.Policy.of({"pii": True, "unknown": 1})
    assert p.on("pii") and not p.on("export") and p.toggle("export").on("export") and "pii" in p.off("export", "derived")
    log = spark.createDataFrame([("call 13812345678 with token=abc", {"Cookie": "x", "k": "a@b.org"}, None)], "message string, fields map<string,string>, error string")
    r = log.select(*redact.log_record(p)).first()
    assert (r["message"], r["fields"], r["error"]) == ("call [手机号] with token=[REDACTED]", {"Cookie": "[REDACTED]", "k": "[邮箱]"}, None)


def test_small_pieces(spark):
    plan = spark.createDataFrame([("a", 2, 8.0), ("b", 0, 5.0), ("c", None, 1.0)], "name string, size int, peak_mb double")
    assert tk.plan_memory(plan, 100).first().asDict() == {"mb": 16.0, "wrong": 2, "fits": False} and tk.plan_memory(plan.limit(1), 16).first()["fits"] and tk.plan_memory(plan.limit(0), 1).first()["mb"] == 0.0
    lim = spark.createDataFrame([(f"d{i}", i, 50.0 if i == 0 else None, float(i)) for i in range(9)], "domain string, throttles int, until double, used_at double")
    assert {r["domain"] for r in tk.resting(lim, 10.0, 8).collect()} == {f"d{i}" for i in range(9)} - {"d1"} and tk.resting(lim, 10.0).filter("resting").count() == 1
    j = spark.createDataFrame([(1.0, "l", 'e"', None)], files.DEAD).select(F.from_json(files.letter_json(*map(F.col, ("at", "label", "error", "statements"))), files.LETTER).alias("x")).first()["x"]
    assert tuple(j) == (1.0, "l", 'e"', None)
    assert spark.range(1).select(files.missing(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))).first()[0] == ["a"]
    c = spark.createDataFrame([(1, 0)], "new long, failed long")
    assert tk.bumped(c, "failed", 3).first()["failed"] == 3


def test_search_index(spark, tmp_path):
    """The stored index ranks as the one computed at once, through batches, replacements, removals and another session."""
    texts = {f"d{i}": f"copper library number {i} " + "each copper " * (i % 4) + "中文字典 " * (i % 3) for i in range(40)} | {"e": "", "n": None}
    df = lambda d: spark.createDataFrame(list(d.items()), "id string, t string")
    x = search.SearchIndex(spark, str(tmp_path / "i"))
    x.put(df({k: "old words" for k in list(texts)[:20]}), "id", "t")
    x.put(df(texts | {"gone": "copper library each"}).withColumn("key", F.lit(1)), "id", "t")
    x.remove(df({"gone": ""}), "id")
    y = search.SearchIndex(spark.newSession(), str(tmp_path / "i"))
    whole = search.index(df(texts), "id", "t")
    for q in ("copper", "copper-library each", "中文", "old", "", "number 7"):
        assert [tuple(r) for r in y.search(q).collect()] == [tuple(r) for r in search.search(whole, "id", q).collect()], q
    assert search.SearchIndex(spark, str(tmp_path / "none")).search("copper").count() == 0


def test_verdicts_by_first_of_a_hash(spark):
    rows = [(i, "same" if i % 3 else f"h{i}", 0 if i % 3 else 1 << i) for i in range(1, 30)]
    got = {r["k"]: r["state"] for r in dedup.verdicts(spark.createDataFrame(rows, "k long, h string, s long"), "k", "h", "s").collect()}
    assert got == {k: "unchanged" if h == "same" and k != 1 else "new" for k, h, _ in rows}
