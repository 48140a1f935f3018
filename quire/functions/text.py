"""Text scalars of the catalogue (SC01-SC12): JVM expressions where they give the same answer, Arrow UDFs where Unicode
normal forms or HTML entities are needed, which Spark SQL lacks."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode blanks, tabs and line ends included (``trim`` drops spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def words(c: Column) -> Column:
    """The blank-separated words; an empty text has none."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def vectorised(f: Callable[[str], object], kind: str = "string"):
    """An Arrow UDF of one string column from a function of one string; NULL gives NULL."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([None if x is None else f(x) for x in b], dtype="object")

    return F.pandas_udf(run, kind).asNondeterministic()  # evaluated once where it stands


def no_marks(s: str, form: str = "NFKD") -> str:
    """Decomposed and without combining marks."""
    return "".join(c for c in unicodedata.normalize(form, s) if not unicodedata.combining(c))


_TAG, _OTHER, _SPACE = re.compile(r"<[^>]+>"), re.compile(r"[^a-z0-9/\- ]"), re.compile(r"\s+")
_APOSTROPHES = dict.fromkeys(map(ord, "'’"))


def fold_text(s: str) -> str:
    """SC04: entities decoded, tags to blanks, apostrophes glued, accents off, lower case, only a-z, 0-9, slash and hyphen."""
    t = s if s.isascii() and "&" not in s else html.unescape(s)
    if "<" in t:
        t = _TAG.sub(" ", t)
    t = t.translate(_APOSTROPHES)
    t = (t if t.isascii() else no_marks(t)).lower()
    return _SPACE.sub(" ", _OTHER.sub(" ", t)).strip()


def classifier_text(c: Column | str) -> Column:
    """SC04 of a column."""
    return vectorised(fold_text)(c)
