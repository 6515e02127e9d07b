"""Records: times, response signals, formats, JSON facts, parsers by regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: File suffixes and the formats they stand for; generic ones decide only at the end.
SUFFIXES = {
    "pdf": "pdf", "png": "png", "jpg": "jpeg", "jpeg": "jpeg", "gif": "gif", "zip": "zip", "gz": "gzip", "m3u8": "hls", "mpd": "dash", "mp4": "mp4", "mkv": "matroska", "mp3": "mp3",
    "m4a": "m4a", "flac": "flac", "html": "html", "htm": "html", "json": "json", "md": "text", "csv": "csv",
}
GENERIC = {"xml": "xml", "rss": "rss", "txt": "text"}
#: First bytes (hex) of binary formats.
MAGIC = {
    "89504E470D0A1A0A": "png", "FFD8FF": "jpeg", "474946383761": "gif", "474946383961": "gif", "255044462D": "pdf", "504B0304": "zip", "1F8B": "gzip", "425A68": "bzip2", "377ABCAF271C": "7z",
    "526172211A07": "rar", "494433": "mp3", "4F676753": "ogg", "664C6143": "flac", "52494646": "riff", "1A45DFA3": "matroska", "7F454C46": "elf", "4D5A": "pe", "53514C69746520666F726D6174203300": "sqlite",
}
ROOTS = {r"<\s*rss": "rss", r"<\s*feed": "atom", r"<\s*urlset": "sitemap", r"<\s*sitemapindex": "sitemap_index", r"<\s*html": "html", r"<!DOCTYPE\s+html": "html"}
TYPES = {"text/html": "html", "application/xhtml+xml": "html", "application/json": "json", "application/rss+xml": "rss", "application/atom+xml": "atom", "application/pdf": "pdf", "image/png": "png", "image/jpeg": "jpeg", "image/gif": "gif", "text/plain": "text", "text/csv": "csv", "application/xml": "xml", "text/xml": "xml", "application/zip": "zip"}


def epoch(c: Column) -> Column:
    """DT-01 for text: digits (milliseconds above 1e12), RFC-822, ISO-8601, three plain forms (UTC); else null."""
    s = F.trim(c)
    n = F.when(s.rlike(r"^\d+$"), s.try_cast("double"))
    number = F.when(n > 1e12, n / 1000).when(n > 0, n)
    mail = F.regexp_replace(s, r"^[A-Za-z]{3},\s*", "")
    tries = [F.try_to_timestamp(mail, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z")]
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), s.try_cast("timestamp"))
    slash = F.try_to_timestamp(F.substring(s, 1, 19), F.lit("yyyy/MM/dd"))
    return F.when(s.rlike(r"^\d+$"), number).otherwise(F.coalesce(iso, *tries, slash).cast("double"))


def signal(status: Column, mime: Column, size: Column) -> Column:
    """STM-03: what a response means, the first that holds."""
    m = F.lower(F.coalesce(mime, F.lit("")))
    return (
        F.when(status.isin(429, 503), "throttled").when(status.isin(404, 410), "permanent_failure").when((status >= 500) & (status < 600), "transient_failure")
        .when(m.rlike("mpegurl|dash"), "media_manifest").when(m.rlike("event-stream|websocket"), "stream").when(m.rlike("octet-stream|zip") | (size > 8 * 1024 * 1024), "large_object")
        .otherwise("ok")
    )


def facts(c: Column, most: int | None = 500) -> Column:
    """JSON-04: the facts as a variant; text that does not parse under `__raw__`, at most `most` characters (None: all)."""
    raw = F.to_variant_object(F.create_map(F.lit("__raw__"), c if most is None else F.substring(c, 1, most)))
    return F.coalesce(F.try_parse_json(c), raw)


def suffix(url: Column) -> Column:
    """Suffix of a URL's last part, before ? (not before #), lower-cased."""
    return F.lower(F.regexp_extract(F.regexp_extract(url, r"^([^?]*)", 1), r"\.([A-Za-z0-9]+)$", 1))


def _lookup(key: Column, pairs: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def file_format(url: Column, mime: Column, head: Column | None = None) -> Column:
    """PAR-00: struct(name, how): magic bytes, playlist mark, suffix, XML root, Content-Type, JSON, generic suffix, unknown.

    head: the first bytes (binary) if there are any.
    """
    ext, kind = suffix(url), F.lower(F.trim(F.regexp_extract(F.coalesce(mime, F.lit("")), "^([^;]*)", 1)))
    say = lambda name, how: F.struct(name.alias("name"), F.lit(how).alias("how"))
    out = []
    if head is not None:
        hexed = F.hex(F.substring(head, 1, 16))
        text = F.decode(F.substring(head, 1, 1024), "ISO-8859-1")  # the marks are ASCII, and the cut may split a letter
        for m, n in MAGIC.items():
            out.append((F.startswith(hexed, F.lit(m)), say(F.lit(n), "magic")))
        out.append((F.contains(F.substring(text, 1, 512), F.lit("#EXTM3U")), say(F.lit("hls"), "magic")))
    out.append((ext.isin(*SUFFIXES), say(_lookup(ext, SUFFIXES), "extension")))
    if head is not None:
        out += [(text.rlike("(?i)" + r), say(F.lit(n), "xml-root")) for r, n in ROOTS.items()]
    out.append((kind.isin(*TYPES), say(_lookup(kind, TYPES), "content-type")))
    if head is not None:
        out.append((F.ltrim(text).rlike(r"^[\[{]"), say(F.lit("json"), "json")))
    out.append((ext.isin(*GENERIC), say(_lookup(ext, GENERIC), "fallback")))
    x = F.when(*out[0])
    for cond, v in out[1:]:
        x = x.when(cond, v)
    return x.otherwise(say(F.lit("unknown"), "fallback"))
