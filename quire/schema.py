"""Checks and conversions at the border of a table (SC17, SC18)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.text import strip


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The table itself, or ValueError naming the columns it lacks."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def field_name(name: str) -> str:
    """SC17: a custom field's name, trimmed, lower case, with a leading '#'."""
    n = name.strip().lower()
    return n if not n or n.startswith("#") else f"#{n}"


def to_array(df: DataFrame, name: str) -> Column:
    """SC18: a column held as a list or as a comma-joined string, as a list of trimmed non-empty strings."""
    c = F.col(f"`{name}`")
    values = c if isinstance(df.schema[name].dataType, T.ArrayType) else F.split(c, ",")
    return F.filter(F.transform(values, strip), lambda x: x != "")
