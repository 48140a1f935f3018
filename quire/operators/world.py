"""Universe of a series (PR51, JN11, PL05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import collapse


def series_key(series: Column) -> Column:
    """Lower case, white space collapsed."""
    return collapse(F.lower(series))


def inverted(world: DataFrame) -> DataFrame:
    """PR51: (series_key, universe) from (universe, series[]); the greatest universe name wins a conflict."""
    flat = world.select("universe", F.explode("series").alias("s")).select(series_key(F.col("s")).alias("series_key"), "universe")
    return flat.where("series_key <> ''").groupBy("series_key").agg(F.max("universe").alias("universe"))


def worlds(books: DataFrame, world: DataFrame, key: str = "book_id") -> DataFrame:
    """PL05, JN11: (key, series, universe) of books whose series is known in the map.

    The map is joined by key; Spark broadcasts it where its size allows.
    """
    one = books.select(key, "series").where("series is not null").distinct().withColumn("series_key", series_key(F.col("series")))
    return one.join(inverted(world), "series_key").select(key, "series", "universe")
