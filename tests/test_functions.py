"""Golden values of the scalar functions."""

from pyspark.sql import functions as F

from millrace.functions import records as rec, redact, text as tx, url as ur
from millrace.operators import metrics as mt, robots, routing


def one(spark, col, *values, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(col).collect()]


def test_tokens(spark):
    assert one(spark, tx.tokens(F.col("x")), "Foo b_1 réleou", "中文字 x 好", "", None) == [["foo", "b_1", "r", "leou"], ["x", "中文", "文字", "好"], [], []]


def test_urls(spark):
    pairs = [
        ("HTTP://Example.COM:80//a//b?b=2&a=1&utm_x=1#f", "http://example.com/a/b?a=1&b=2"), ("https://h.test", "https://h.test/"), ("https://h.test./a/", "https://h.test/a/"),
        ("https://h.test:8443/x", "https://h.test:8443/x"), ("https://h.test/%7Ea%2fb%c3", "https://h.test/~a/b%C3"), ("ftp://h.test/", None), ("plain words", None), (None, None),
        ("http://h.test:99999/", None), ("http://h.test:0/a%zz%41", "http://h.test/a%zzA"), ("http://u:p%20q@H.test/", "http://u:p%2520q@h.test/"), ("http://[::1]/", None), ("http://h.test:x/", None),
        ("https://h.test/?b=%C3%A9&b=%20x&a=1*2~", "https://h.test/?a=1%2A2~&b=+x&b=%C3%A9"), ("https://h.test/é?q=é", "https://h.test/é?q=%C3%A9"), ("https://h.test?PHPSESSID=1&sid=2&spm_x=3", "https://h.test/?PHPSESSID=1"),
        ("https://h.test/?token=z&sig=1&x=", "https://h.test/?sig=1&token=z"), ("https://h.test/?q=a+b", "https://h.test/?q=a+b"),
    ]
    got = one(spark, ur.canonical(F.col("x")), *[a for a, _ in pairs])
    assert got == [b for _, b in pairs]
    assert one(spark, ur.canonical(F.col("x"), True), "https://www.h.test/a") == ["https://h.test/a"]


def test_unsafe(spark):
    bad = ["http://127.0.0.1/", "http://localhost:8/", "http://10.1.2.3/", "http://0x7f.1/", "http://2130706433/", "http://[::1]/", "http://a.local/", "file:///etc", "http://100.64.1.1/", "http://0177.0.0.1/", None, ""]
    assert all(one(spark, ur.unsafe(F.col("x")), *bad))
    assert one(spark, ur.unsafe(F.col("x")), "http://example.com/", "http://8.8.8.8/") == [False, False]


def test_redaction(spark):
    got = one(spark, redact.personal(redact.credentials(redact.url_secrets(F.col("x")))), "联系13812345678或 a.b@c.org", "1.2.3.4.5 1.2.3.4", "https://u:p@h/?token=S&a=1", "Authorization: Bearer abcdefghij", "password = hunter2 x")
    assert got == ["联系[手机号]或 [邮箱]", "1.2.3.4.5 [IP]", "https://[REDACTED]@h/?token=[REDACTED]&a=1", "Authorization: [REDACTED]", "password=[REDACTED] x"]
    assert one(spark, redact.proxy(F.col("x")), "http://u:p@Host:8080/x", "socks5://u@h", "http://h:1", "plain", None) == ["http://***@host:8080", "socks5://***@h", "http://h:1", "plain", None]
    assert one(spark, redact.url_secrets(F.col("x")), "http://me@h/#sid=9 and http://h/a@b", "x;key=1&sort=2") == ["http://[REDACTED]@h/#sid=[REDACTED] and http://h/a@b", "x;key=[REDACTED]&sort=2"]


def test_record_redaction(spark):
    kind = "url string, author string, note string, token struct<a: string, n: int>, extra map<string,string>, n int"
    df = spark.createDataFrame([("https://h/?sid=1", "a@b.org", "c@d.org", ("s", 4), {"k": "e@f.org", "Cookie": "x", "link": "http://h/?sig=2"}, 5)], kind)
    x = df.select(redact.record(df.schema, F.struct("*")).alias("r")).select("r.*").first()
    assert (x["url"], x["author"], x["note"], x["n"]) == ("https://h/?sid=[REDACTED]", "[邮箱]", "c@d.org", 5)
    assert tuple(x["token"]) == ("[REDACTED]", None) and x["extra"] == {"k": "[邮箱]", "Cookie": "[REDACTED]", "link": "http://h/?sig=[REDACTED]"}


def test_epoch(spark):
    got = one(spark, F.round(rec.epoch(F.col("x")), 1), "2024-01-02T03:04:05Z", "Tue, 02 Jan 2024 03:04:05 +0000", "1704164645000", "1704164645", "junk", "", None, "2024/01/02")
    assert got == [1704164645.0] * 4 + [None, None, None, 1704153600.0]


def test_formats(spark):
    rows = [("http://h/a.pdf", None, None), ("http://h/a", "text/html; charset=x", None), ("http://h/a", None, b"\x89PNG\r\n\x1a\n"), ("http://h/a", None, b"<rss version='2'>"), ("http://h/a", None, b' {"a": 1}'), ("http://h/a.html#top", None, None), ("http://h/a.txt", None, None)]
    df = spark.createDataFrame([(u, m, bytearray(b or b"")) for u, m, b in rows], "u string, m string, b binary")
    assert [r[0] for r in df.select(rec.file_format(F.col("u"), F.col("m"), F.col("b"))["name"]).collect()] == ["pdf", "html", "png", "rss", "json", "unknown", "text"]


def test_robots(spark):
    text = "User-agent: *\nDisallow: /\n\nUser-agent: mill\nDisallow: /a\nAllow: /a/b\nDisallow: /*.x$\nDisallow:"
    rules = robots.parse(spark.createDataFrame([("h", text)], "host string, t string"), "host", "t")
    urls = spark.createDataFrame([(p, "h", p) for p in ("/a", "/a/b", "/q.x", "/q.xy")] + [("o", "other", "/")], "url string, host string, path string")
    assert {(r["url"], r["allowed"]) for r in robots.decide(urls, rules, "Millrace/1").collect()} == {("/a", False), ("/a/b", True), ("/q.x", False), ("/q.xy", True), ("o", True)}


def test_quantiles_and_rules(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(1, 101)], "k int, v double")
    r = mt.quantiles(df, "k", "v").first()
    assert (r["p50"], r["p95"], r["p99"]) == (50.5, 95.05, 99.01)
    x = spark.createDataFrame([("direct", "ok"), ("direct", "empty_content"), ("browser", "ok"), ("inspect", "stream"), ("classify", "ok")], "s string, g string")
    assert [tuple(v[0]) for v in x.select(routing.route(F.col("s"), F.col("g"))).collect()] == [("direct_ok", "terminal", "done"), ("direct_empty_to_browser", "browser_candidate", "dead"), ("browser_ok", "terminal", "done"), ("none", "terminal", "dead"), ("classify_done_to_direct", "stage", "direct")]


def test_resolve(spark):
    base = "https://h.test/a/b?q=1#f"
    hrefs = ["c", "/c#x", "//o.test/z", "?p=2", "", "../d", "./e/../g?x", "http://x.test/", "mailto:a", None, "#top"]
    got = one(spark, ur.resolve(F.lit(base), F.col("x")), *hrefs)
    assert got == ["https://h.test/a/c", "https://h.test/c", "https://o.test/z", "https://h.test/a/b?p=2", "https://h.test/a/b?q=1", "https://h.test/d", "https://h.test/a/g?x", "http://x.test/", "mailto:a", None, "https://h.test/a/b?q=1"]
    assert one(spark, ur.resolve(F.lit(None).cast("string"), F.col("x")), "c#d", "../x") == ["c", "../x"]


def test_simhash(spark):
    import hashlib

    def plain(text):
        words = [w for w in __import__("re").findall(r"[a-z0-9_]+", text)]
        n = [sum(1 if int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "big") >> i & 1 else -1 for w in words) for i in range(63)]
        return sum(1 << i for i in range(63) if n[i] > 0)

    texts = ["a b c d", "one two two three", "", None, "word " * 30_000 + "tail"]
    got = one(spark, tx.simhash_of(F.col("x")), *texts)
    assert got == [plain(t) if t else 0 for t in texts[:4]] + [plain("word")]
    assert one(spark, tx.simhash_of(F.col("x"), None), "x " * 25_000 + "y " * 24_999) == [plain("x " * 25_000 + "y " * 24_999)]
