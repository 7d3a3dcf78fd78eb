"""Identifier functions: one comparable form, the forms a person might type, the shape test."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACES = "[\\s ]+"


@F.pandas_udf(StringType())
def _compatible(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKD", x), na_action="ignore")


def normalise(raw: Column, ascii_only: bool = False) -> Column:
    """The form under which identifiers are compared. Only rows that aren't ASCII pass through Python, for NFKD; ``ascii_only`` leaves that out."""
    s = F.coalesce(raw, F.lit(""))
    if not ascii_only:
        s = F.when(s.rlike("[^\\x00-\\x7F]"), _compatible(s)).otherwise(s)
    s = F.lower(F.trim(F.regexp_replace(s, SPACES, " ")))
    s = F.translate(s, "–—−[]", "---()")
    for pattern, to in (("\\s*\\(\\s*", "("), ("\\s*\\)\\s*", ")"), ("\\(([^()]*)\\)", ".$1"), ("\\s*-\\s*", "-"), ("\\.+", "."), ("^\\.+|\\.+$", ""), ("\\s+", " ")):
        s = F.regexp_replace(s, pattern, to)
    return F.regexp_replace(s, "(?<![0-9a-z])0+(\\d)", "$1")


def variants(base: Column) -> Column:
    """Forms of a normalised identifier, most specific first; a bare numeric tail needs two digits."""
    tail = F.regexp_extract(base, "^[a-z][a-z0-9\\- ]*?[\\- ](\\d[\\d.]*)$", 1)
    tail = F.when(F.length(F.replace(tail, F.lit("."), F.lit(""))) >= 2, tail)
    forms = F.array(base, F.replace(base, F.lit("-"), F.lit(" ")), F.replace(base, F.lit(" "), F.lit("-")), F.replace(base, F.lit(" "), F.lit("")), tail)
    return F.array_distinct(F.filter(forms, lambda f: f.isNotNull() & ((f != "") | (base == ""))))


def looks_like(query: Column) -> Column:
    text = F.trim(F.coalesce(query, F.lit("")))
    return (text != "") & (F.length(text) <= 48) & text.rlike("[0-9]") & (F.size(F.split(text, "\\s+")) <= 5)
