"""Scalar text expressions: names, fillers, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What harvesters write where a field has no content (compared in lower case, without outer blanks).
FILLERS = ("", "-", "--", "?", "n/a", "na", "tbd", "unknown", "null", "none", "nan", "not available", "(empty)", "暂无", "无", "about:blank", "#", "http://", "https://")

TAG = r"<[^>]*>"
#: The signs with the Unicode property White_Space.
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """Python's ``strip``: every Unicode blank at either end (Spark's ``trim`` knows only U+0020)."""
    return F.btrim(c, F.lit(BLANKS))


def informative(c: Column) -> Column:
    """True if the value tells something: not null, blank, a filler, nor markup or punctuation around nothing."""
    bare = F.lower(strip(F.regexp_replace(c, TAG, "")))
    return F.coalesce(~bare.isin(*FILLERS) & bare.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def normalize_name(c: Column) -> Column:
    """Comparable form of a record's name; null gives ''.

    Steps, in this order: strip, lower, drop ``<...>``, runs of ``_``/``-`` to a blank, blanks to one blank, drop a
    trailing ``v<digits>``, strip.
    """
    x = F.lower(strip(F.coalesce(c, F.lit(""))))
    x = F.regexp_replace(x, r"<[^>]+>", "")
    x = F.regexp_replace(x, r"[_\-]+", " ")
    x = F.regexp_replace(x, r"(?U)\s+", " ")
    x = F.regexp_replace(x, r"(?U)v\d+$", "")
    return strip(x)


def record_text(*fields: Column) -> Column:
    """Non-empty fields joined by a blank, stripped, lower case."""
    return F.lower(strip(F.concat_ws(" ", *(F.when(f != "", f) for f in fields))))


def words(c: Column) -> Column:
    r"""Unicode ``\w+`` runs of the lower-cased text, repeats kept; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def blank_split(c: Column) -> Column:
    """Python's ``lower().split()``: runs between Unicode blanks, punctuation kept."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+"), lambda t: t != "")


def tag_key(c: Column) -> Column:
    """Comparable spelling of a tag: lower case, words joined by one blank, whatever blanks or signs joined them."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def tag_parts(c: Column) -> Column:
    """The tags inside one element of a tag list (several may be written together)."""
    return F.split(c, r"[,;|，；、\n]")
