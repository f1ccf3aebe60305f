"""Text normalization: canonical text, comparison text, category names and character n-grams.

ASCII values are handled by built-in expressions; only values with other characters cross to Python,
because Spark has neither NFKC nor case folding. Null in, null out everywhere.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What Python's ``str.split`` treats as white space among the ASCII characters.
ASCII_BLANKS = r"[\t-\r\x1c-\x20]+"
ASCII_ONLY = r"\A[\x00-\x7F]*\z"


def canonical_value(text: str) -> str:
    """NFKC, case folding, every run of white space one blank, no blank at the ends."""
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


#: a-z and 0-9 as they are, A-Z in lower case, any other byte as a blank.
_COMPARED = bytes(b if chr(b).isalnum() and b < 128 else 32 for b in range(256)).lower()


def comparison_value(text: str) -> str:
    """The canonical text with everything but a-z and 0-9 turned into single blanks."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).casefold()
    return b" ".join(text.encode("ascii", "replace").translate(_COMPARED).split()).decode()


@F.pandas_udf(T.StringType())
def _folded(values: pd.Series) -> pd.Series:
    return values.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


@F.pandas_udf(T.StringType())
def _canonical(values: pd.Series) -> pd.Series:
    return values.map(canonical_value, na_action="ignore")


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def folded(value: Column | str) -> Column:
    """NFKC and case folding; ASCII values never leave the JVM."""
    value = _column(value)
    ascii_only = value.rlike(ASCII_ONLY)
    return F.when(ascii_only, F.lower(value)).otherwise(_folded(F.when(~ascii_only, value)))


def canonical_text(value: Column | str) -> Column:
    """Column form of :func:`canonical_value`."""
    value = _column(value)
    ascii_only = value.rlike(ASCII_ONLY)
    native = F.trim(F.regexp_replace(F.lower(value), ASCII_BLANKS, " "))
    return F.when(ascii_only, native).otherwise(_canonical(F.when(~ascii_only, value)))


def comparison_text(value: Column | str) -> Column:
    """Column form of :func:`comparison_value`."""
    return F.trim(F.regexp_replace(folded(value), "[^a-z0-9]+", " "))


def canonical_category(value: Column | str) -> Column:
    """A label name: NFKC, case folding, other characters than a-z and 0-9 as one underscore."""
    return F.btrim(F.regexp_replace(folded(value), "[^a-z0-9]+", "_"), F.lit("_"))


def character_ngrams(comparison: Column | str, size: int = 3) -> Column:
    """The set of ``size``-character pieces of a comparison text with one blank added at each end.

    A padded text of at most ``size`` characters is its own single piece; null gives null.
    """
    if size < 1:
        raise ValueError("size must be positive")
    padded = F.concat(F.lit(" "), _column(comparison), F.lit(" "))
    count = F.length(padded) - (size - 1)
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(padded, i, F.lit(size)))
    return F.when(count <= 1, F.array(padded)).when(count > 1, F.array_distinct(pieces))


def titled(name: Column | str) -> Column:
    """A label or group name for readers: blanks for underscores, words with a capital."""
    return F.initcap(F.replace(_column(name), F.lit("_"), F.lit(" ")))


def fixed_places(value: Column | str, places: int) -> Column:
    """A number with so many decimal places; null stays null."""
    return F.when(_column(value).isNotNull(), F.format_string(f"%.{places}f", _column(value).cast("double")))


def percent(value: Column | str, places: int = 2) -> Column:
    """A share as a percentage; null stays null."""
    return F.concat(fixed_places(_column(value) * 100, places), F.lit("%"))
