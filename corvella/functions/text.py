"""Text measures and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: pattern of a sentence.
SENTENCES = r"[^.!?]+[.!?]+|[^.!?]+$"


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters outside the basic plane count twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def estimated_tokens(length: Column) -> Column:
    return F.ceil(length / 4).cast("long")


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"[^\s   -     　﻿]")


def not_blank(text: Column) -> Column:
    """Whether Python's strip() leaves anything."""
    return text.rlike(r"[^\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def sentences(text: Column) -> Column:
    """Runs that end in marks, and an unmarked end; marks before the first run are dropped."""
    return F.regexp_extract_all(text, F.lit(SENTENCES), F.lit(0))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def file_hash(content: Column) -> Column:
    return F.md5(content)


def iso_timestamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def whole_days(ts: Column, now: Column) -> Column:
    return F.floor((F.unix_micros(now) - F.unix_micros(ts)) / F.lit(86400e6)).cast("long")


def days_since(iso: Column, now: Column | None = None) -> Column:
    """Age of an ISO timestamp in words; empty, invalid and future ones are Unknown."""
    n = whole_days(F.try_to_timestamp(iso), F.current_timestamp() if now is None else now)
    return F.when(n.isNull() | (n < 0), "Unknown").when(n == 0, "Today").when(n == 1, "1 day ago").otherwise(F.concat(n.cast("string"), F.lit(" days ago")))


def duration(ms: Column) -> Column:
    """Under a minute 12.3s, else 2m 5s."""
    s = ms / 1000
    return F.when(s < 60, F.format_string("%.1fs", s.cast("double"))).otherwise(F.format_string("%dm %ds", F.floor(s / 60), F.floor(s % 60)))


def memory_size(n: Column) -> Column:
    """As printf rounds: a size in the middle of two hundredths goes to the even one."""
    return F.concat(F.bround((n / F.lit(1048576.0)).cast("decimal(38,20)"), 2).cast("string"), F.lit(" MB"))


def fixed(x: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f", x.cast("double"))


def url_encode(x: Column) -> Column:
    """Letters, digits and -._~ stay; Spark's own is that of forms, with + for a space."""
    out = F.url_encode(x)
    for form, own in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(form), F.lit(own))
    return out


def percentage(current: Column, total: Column) -> Column:
    """The product comes first: it is exact, and so the quotient of a whole percentage is whole."""
    return F.when(total > 0, F.floor(current * F.lit(100.0) / total)).otherwise(0).cast("int")
