"""Text expressions that behave as in Unicode-aware scripting: words, white space, escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"((?U)\w+)"


def tokens(text: Column) -> Column:
    """Lower-cased words of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 1)


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def flatten(text: Column) -> Column:
    """One space for each run of white space, none at the ends, lower case."""
    return F.lower(strip(F.regexp_replace(text, r"(?U)\s+", " ")))


def normalise(text: Column) -> Column:
    """Lower case, one space for each run of what is not a word character."""
    return F.regexp_replace(F.lower(text), r"(?U)\W+", " ")


def tokens_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded half to even."""
    return F.bround(F.length(text) / 4, 0).cast("long")


def first_email(text: Column) -> Column:
    found = F.regexp_extract(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 0)
    return F.lower(F.nullif(found, F.lit("")))


def html_to_text(html: Column) -> Column:
    """Block tags end lines, list items get a bullet, other tags go, common entities are read, blank runs collapse."""
    x = F.regexp_replace(html, r"(?i)<li[^>]*>", "\n- ")
    x = F.regexp_replace(x, r"(?i)<(?:br|/p|/div|/h[1-6]|/li|/ul|/ol|/tr)[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]+>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(sign))
    x = F.regexp_replace(x, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(x, r"\n[ \n]*\n", "\n\n"))
