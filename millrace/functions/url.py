"""URL functions: canonical form, fingerprints, hosts, safety."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Parameters that identify a visit, not a page.
DROP_PREFIXES = ("utm_", "spm", "share_", "hmsr", "hmpl", "hmcu", "hmkw", "hmci")
DROP_NAMES = (
    "gclid", "fbclid", "msclkid", "yclid", "dclid", "igshid", "mc_eid", "mc_cid", "from", "ref", "referer", "referrer", "src", "source", "share_token", "spm_id_from",
    "sid", "sessionid", "session_id", "phpsessid", "jsessionid", "asp.net_sessionid", "_ga", "_gl", "timestamp", "_t", "cachebust", "cb",
)
#: Characters of a path that stand for themselves, besides letters and digits.
PATH_MARKS = "-._~!$&'()*+,;=:@/"
_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#]*)@)?([^/?#@:\[\]]*)(?::(\d*))?((?:/[^?#]*)?)(?:\?([^#]*))?(?:#.*)?$"


def _quoted(c: Column, blank: str) -> Column:
    """Percent-encoding of all but letters, digits and -._~; a space becomes `blank`."""
    x = F.url_encode(c)
    for given, wanted in (("*", "%2A"), ("%7E", "~"), ("+", blank)):
        x = F.replace(x, F.lit(given), F.lit(wanted))
    return x


def normal_path(path: Column) -> Column:
    """URL-03: escapes of characters that stand for themselves are undone, other escapes upper-cased."""
    parts = F.split(path, "%", -1)

    def one(x: Column) -> Column:
        code = F.upper(F.substring(x, 1, 2))
        sign = F.char(F.conv(code, 16, 10).cast("int"))
        own = sign.rlike("^[A-Za-z0-9" + re.escape(PATH_MARKS) + "]$")
        seen = F.when(own, F.concat(sign, F.substring(x, 3, 1 << 30))).otherwise(F.concat(F.lit("%"), code, F.substring(x, 3, 1 << 30)))
        return F.when(code.rlike("^[0-9A-F]{2}$"), seen).otherwise(F.concat(F.lit("%"), x))

    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one)
    return F.when(F.contains(path, F.lit("%")), F.concat(parts[0], F.array_join(rest, ""))).otherwise(path)


def kept_query(query: Column) -> Column:
    """URL-05: the parameters that identify a page, decoded, sorted by name and value and encoded again."""
    decoded = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.transform(F.split(query, "&", -1), lambda kv: F.struct(decoded(F.regexp_extract(kv, "^([^=]*)", 1)).alias("k"), decoded(F.regexp_extract(kv, "^[^=]*=(.*)$", 1)).alias("v")))
    drop = "^(?:" + "|".join(DROP_PREFIXES) + ")"
    kept = F.filter(pairs, lambda p: (p["v"] != "") & ~p["k"].isin(*DROP_NAMES) & ~p["k"].rlike(drop))
    return F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(_quoted(p["k"], "+"), F.lit("="), _quoted(p["v"], "+"))), "&")


def canonical(c: Column, strip_www: bool = False) -> Column:
    """URL-01, URL-02: one form for addresses of the same page; null for other schemes, without a host, for an IPv6 host
    and for a port that is no number up to 65535. All of it runs in the JVM. An escape in the query that does not decode
    leaves its name or value as it is."""
    u = F.trim(c)
    scheme, user, name, port, path, query = (F.regexp_extract(u, _PARTS, n) for n in range(1, 7))
    scheme, name = F.lower(scheme), F.rtrim(F.substring_index(F.lower(name), "%", 1), F.lit("."))
    if strip_www:
        name = F.when(name.rlike(r"^www\.[^.]+\."), F.substring(name, 5, 1 << 30)).otherwise(name)
    number = F.when(port == "", F.lit(0)).otherwise(port.try_cast("int"))
    usual = F.when(scheme == "http", 80).otherwise(443)
    shown = F.when((number == 0) | (number == usual), "").otherwise(F.concat(F.lit(":"), number.cast("string")))
    login, secret = F.substring_index(user, ":", 1), F.regexp_extract(user, "^[^:]*:(.*)$", 1)
    who = F.when(F.length(F.replace(user, F.lit(":"), F.lit(""))) == 0, "").otherwise(F.concat(_quoted(login, "%20"), F.when(secret != "", F.concat(F.lit(":"), _quoted(secret, "%20"))).otherwise(""), F.lit("@")))
    road = normal_path(F.regexp_replace(F.when(path == "", "/").otherwise(path), "/{2,}", "/"))
    q = kept_query(query)
    out = F.concat(scheme, F.lit("://"), who, name, shown, road, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.when(scheme.isin("http", "https") & (name != "") & (number <= 65535), out)


@F.pandas_udf(T.StringType())
def _joined_udf(base: pd.Series, href: pd.Series) -> pd.Series:
    def one(b, h):
        try:
            return urljoin(b or "", h)
        except ValueError:
            return None

    return pd.Series([None if h is None else one(b, h) for b, h in zip(base, href)])


def resolve(base: Column, href: Column) -> Column:
    """URL-09: href as seen from base, without fragment; null stays null, without a base href is itself. Dot segments go
    through an Arrow batch, all other forms stay in the JVM."""
    h = F.regexp_replace(F.trim(href), "#.*$", "")
    b = F.regexp_replace(F.coalesce(F.trim(base), F.lit("")), "#.*$", "")
    origin, road = F.regexp_extract(b, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract(b, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.when(road == "", "/").otherwise(F.regexp_replace(road, "[^/]*$", ""))
    dots = F.regexp_like(h, F.lit(r"(^|/)\.{1,2}(/|$|\?)")) & ~h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    easy = (
        F.when((origin == "") | h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h == "", b)
        .when(F.startswith(h, F.lit("//")), F.concat(F.regexp_extract(origin, "^([^/]*)", 1), h))
        .when(F.startswith(h, F.lit("/")), F.concat(origin, h))
        .when(F.startswith(h, F.lit("?")), F.concat(origin, road, h))
        .otherwise(F.concat(origin, folder, h))
    )
    return F.when(dots & (origin != ""), _joined_udf(F.when(dots, b), F.when(dots, h))).otherwise(easy)


def fingerprint(c: Column, strip_www: bool = False) -> Column:
    """URL-04: 16 hex digits of the canonical form's SHA-256; null without one."""
    return F.substring(F.sha2(canonical(c, strip_www), 256), 1, 16)


def idempotency_key(kind: Column, target: Column) -> Column:
    """URL-06: 32 hex digits of the SHA-256 of kind|target."""
    return F.substring(F.sha2(F.concat(kind, F.lit("|"), target), 256), 1, 32)


def host(c: Column) -> Column:
    """Host of a URL, lower-cased, without port and trailing dots."""
    return F.regexp_replace(F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"\.+$", "")


def same_site(host_: Column, base: Column) -> Column:
    """FLT-04: equal to the base host or below it."""
    return (host_ == base) | F.endswith(host_, F.concat(F.lit("."), base))


def unsafe_one(url: str | None) -> bool:
    """`unsafe` of one address."""
    try:
        p = urlsplit((url or "").strip())
        name = (p.hostname or "").split("%")[0].rstrip(".").lower()
    except ValueError:
        return True
    if p.scheme.lower() not in ("http", "https") or not name:
        return True
    if name == "localhost" or name.endswith((".localhost", ".local", ".internal", ".lan", ".intranet", ".home.arpa", ".corp")):
        return True
    try:
        ip = ipaddress.ip_address(name)
    except ValueError:
        parts = name.split(".")
        if len(parts) > 4 or not all(re.fullmatch(r"0x[0-9a-f]*|\d+", x) for x in parts):
            return False
        nums = [int(x, 16) if x.startswith("0x") and len(x) > 2 else int(x, 8) if x.startswith("0") and x.strip("01234567") == "" else int(x) if x.isdigit() else 0 for x in parts]
        if any(n > 255 for n in nums[:-1]) or nums[-1] >= 256 ** (5 - len(nums)):
            return True
        ip = ipaddress.ip_address(sum(n << (24 - 8 * i) for i, n in enumerate(nums[:-1])) + nums[-1])
    if ip.version == 6 and ip.ipv4_mapped:
        ip = ip.ipv4_mapped
    shared = ip.version == 4 and (ip in ipaddress.ip_network("100.64.0.0/10") or ip in ipaddress.ip_network("192.88.99.0/24"))
    return bool(shared or ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified)


@F.pandas_udf(T.BooleanType())
def _unsafe_udf(url: pd.Series) -> pd.Series:
    return pd.Series([unsafe_one(u) for u in url])


def unsafe(c: Column) -> Column:
    """FLT-06: private or otherwise unsafe target. Named hosts are judged in the JVM, number-like ones by an Arrow UDF."""
    h = host(c)
    named = c.rlike(r"(?i)^\s*https?://[a-z0-9.-]*[g-wyz][a-z0-9.-]*(?:[:/?#]|$)")
    local = (h == "localhost") | h.rlike(r"\.(localhost|local|internal|lan|intranet|home\.arpa|corp)$")
    return F.when(named, local).otherwise(_unsafe_udf(F.when(~named | c.isNull(), c)))


def retry_after(c: Column, now: Column, most: float = 300.0) -> Column:
    """URL-10: seconds of a Retry-After header, digits or an HTTP date; null for anything else."""
    x = F.trim(c)
    date = F.try_to_timestamp(F.regexp_replace(x, r"^[A-Za-z]{3},\s*", ""), F.lit("dd MMM yyyy HH:mm:ss z"))
    left = F.when(date.isNotNull(), F.greatest(F.lit(0.0), date.cast("double") - now))  # greatest and least skip nulls
    secs = F.when(x.rlike(r"^\d{1,15}$"), x.try_cast("double")).otherwise(left)
    return F.when(secs.isNotNull(), F.least(F.lit(most), secs))


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _unsafe_each_udf(urls: pd.Series) -> pd.Series:
    return pd.Series([None if a is None else [unsafe_one(u) for u in a] for a in urls])


def unsafe_each(urls: Column) -> Column:
    """`unsafe` of every address of an array."""
    return _unsafe_each_udf(urls)
