"""Canonical author names (PR08, FL12, PL03): all in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import strip


def canonical_author(name: Column) -> Column:
    """PR08: 'Last, First' turned round at the first comma, initials apart and with dots. NULL and blank stay as they are."""
    whole = strip(name)
    last, first = strip(F.substring_index(whole, ",", 1)), strip(F.regexp_replace(whole, r"(?s)^[^,]*,?", ""))
    t = F.when(F.contains(whole, F.lit(",")) & (first != ""), F.concat(first, F.lit(" "), last)).otherwise(whole)
    # Runs of two or three capitals, then initials that touch, initials that touch a name, and bare ones.
    t = F.regexp_replace(t, r"(?<![A-Za-z])([A-Z])([A-Z])([A-Z])(?![A-Za-z])", "$1. $2. $3.")
    t = F.regexp_replace(t, r"(?<![A-Za-z])([A-Z])([A-Z])(?![A-Za-z])", "$1. $2.")
    t = F.regexp_replace(t, r"([A-Z]\.)(?=[A-Z]\.)", "$1 ")
    t = F.regexp_replace(t, r"([A-Z]\.)(?=[A-Z][a-z])", "$1 ")
    t = F.regexp_replace(t, r"(?U)(?<![\p{L}\p{N}_])([A-Z])(?=\s)", "$1.")
    return F.when(whole == "", name).otherwise(strip(t))


def changed_authors(books: DataFrame, key: str = "book_id") -> DataFrame:
    """PL03, FL12: (key, old, new) of the books one of whose authors changes; each book once."""
    one = books.select(key, F.col("authors").alias("old")).where("old is not null").distinct()
    return one.withColumn("new", F.transform("old", canonical_author)).where(~F.col("new").eqNullSafe(F.col("old")))
