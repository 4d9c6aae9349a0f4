"""Keys under Unicode compatibility folding.

Spark has no such function, so what is not ASCII goes through Python in Arrow batches; ASCII texts never leave the JVM.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _compatible(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def _other(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(r"[^\x00-\x7F]")), text)


def compatible(text: Column) -> Column:
    """NFKC."""
    return F.coalesce(_compatible(_other(text)), text)


def folded(text: Column) -> Column:
    """NFKC, then full case folding."""
    return F.coalesce(_folded(_other(text)), F.lower(text))


#: White space as Unicode has it.
_SPACE = r"[\s\x1C-\x1F\x85\p{Z}]+"


def normalized_query(text: Column) -> Column:
    """NFKC, runs of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(compatible(text), _SPACE, " "))


def query_key(text: Column) -> Column:
    """The folded text without white space."""
    return F.regexp_replace(folded(text), _SPACE, "")


def letters_key(text: Column) -> Column:
    """The folded text, only ASCII letters and digits and common ideographs."""
    return F.regexp_replace(folded(text), "[^0-9a-z㐀-鿿]+", "")


def python_letters(value: str) -> str:
    """`letters_key` of a literal."""
    import re

    return re.sub("[^0-9a-z㐀-鿿]+", "", unicodedata.normalize("NFKC", value).casefold())


def python_key(value: str) -> str:
    """`query_key` of a literal."""
    return "".join(unicodedata.normalize("NFKC", value).casefold().split())
