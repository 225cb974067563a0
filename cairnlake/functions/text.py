"""Text and number normalisation that comparators need."""

from __future__ import annotations

import unicodedata
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def _plain(x: str | None) -> str | None:
    try:
        d = Decimal(x.strip()) if x is not None else None
    except InvalidOperation:
        return None
    if d is None or not d.is_finite():
        return None
    return "0" if d == 0 else format(d.normalize(), "f")


@pandas_udf(StringType())
def decimal_text(s: pd.Series) -> pd.Series:
    """Plain decimal text without trailing zeros; null if it isn't a finite number."""
    return s.map(_plain)


def squeeze(c: Column) -> Column:
    """Outer white space gone, inner runs one space, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), r"\s+", " "))


def _unicode(c: Column, form) -> Column:
    """ASCII text is in every normal form already; Python gets a null in its place."""
    plain = c.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, c).otherwise(form(F.when(~plain, c)))


def text_v1(c: Column) -> Column:
    return squeeze(_unicode(c, _nfkc))


def nfc_trim(c: Column) -> Column:
    return F.regexp_replace(_unicode(c, _nfc), r"^\s+|\s+$", "")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, 1 for two empty texts, null if one is null."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)
