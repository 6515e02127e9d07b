"""Column builders for keys and references."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ref(c: Column | str) -> Column:
    """A reference, trimmed and lower-cased; null, '' and '-' mean none (null)."""
    x = F.lower(F.trim(c if isinstance(c, Column) else F.col(c)))
    return F.when((x != "") & (x != "-"), x)


def host(c: Column | str) -> Column:
    """A host name, trimmed, lower-cased, without trailing dots."""
    x = c if isinstance(c, Column) else F.col(c)
    return F.regexp_replace(F.lower(F.trim(x)), r"\.+$", "")


def month(epoch: Column | str) -> Column:
    """yyyy-MM (UTC session) of epoch seconds; '' if null."""
    x = epoch if isinstance(epoch, Column) else F.col(epoch)
    return F.coalesce(F.date_format(F.timestamp_seconds(x), "yyyy-MM"), F.lit(""))
