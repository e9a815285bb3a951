"""Text normalisation. Null input gives the empty string, as the keys built from it expect."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Company words removed from name keys, in this order, and the marks removed after them.
COMPANY_WORDS = ["株式会社", "有限会社", "合同会社", "合資会社", "合名会社", "co., ltd.", "co.,ltd.", "co ltd", "inc.", "inc", "corp.", "corp", "corporation", "company", "llc", "ltd.", "ltd"]
NAME_MARKS = r"[　\s\-_/,.。、･・()（）【】\[\]]+"
# Marks read as a hyphen in addresses.
HYPHENS = "‐‑‒–—―ー−"
# Fixed value: forms of telephone numbers looked for in pages.
PHONE = r"(0\d{1,4}-\d{1,4}-\d{3,4}|0\d{9,10}|\+81[\d-]{9,13})"


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition; no built-in function does it."""
    return s.map(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore").fillna("")


@F.pandas_udf(StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda t: html.unescape(t) if "&" in t else t, na_action="ignore")


def trimmed(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def one_space(c: Column) -> Column:
    """Every run of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def is_blank(c: Column) -> Column:
    return F.coalesce(trimmed(c), F.lit("")) == ""


def first_filled(*cols: Column) -> Column:
    """The first value that is not blank."""
    return F.coalesce(*(F.when(~is_blank(c), c) for c in cols))


def name_key(c: Column) -> Column:
    """Key under which two spellings of a name meet; removal follows the list's order, anywhere in the text."""
    out = one_space(F.lower(nfkc(c)))
    for w in COMPANY_WORDS:
        out = F.replace(out, F.lit(w), F.lit(" "))
    return F.trim(F.regexp_replace(out, "(?U)" + NAME_MARKS, ""))


def address_key(c: Column) -> Column:
    return one_space(F.translate(nfkc(c), HYPHENS, "-" * len(HYPHENS)))


def phone_key(c: Column, country: str = "81") -> Column:
    """``+`` and digits; a national number gets ``country``, 00 counts as +."""
    t = F.regexp_replace(nfkc(c), r"[^\d+]", "")
    rest = F.regexp_replace(t, r"^.|\D", "")
    return (
        F.when(t == "", "").when(t.startswith("+"), F.concat(F.lit("+"), rest)).when(t.startswith("00"), F.regexp_replace(t, "^00", "+"))
        .when(t.startswith("0"), F.regexp_replace(t, "^0", f"+{country}")).otherwise(t)
    )


def find_phone(c: Column) -> Column:
    """First telephone number in a text, null if there is none."""
    return F.nullif(F.regexp_extract(c, PHONE, 0), F.lit(""))
