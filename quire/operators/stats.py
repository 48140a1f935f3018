"""Statistics over many libraries (JN01-JN06, AG01-AG09, AG26, ST01, PL01, PL23).

The catalogue is long: one row per library, book and author. Every statistic is one aggregation with map-side partial
sums; the updates of a library's books are joins by key, so a library or an author that holds a third of all rows is one
of many partial aggregates and never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.titles import title_key


def book_authors(books: DataFrame) -> DataFrame:
    """JN01, JN02: (library, book_id, title, author), each once; books without an author vanish, as under inner joins."""
    return books.select("library", "book_id", "title", F.explode("authors").alias("author")).where("author is not null").distinct()


def author_library_counts(links: DataFrame) -> DataFrame:
    """AG01: books per author and library."""
    return links.groupBy("library", "author").agg(F.count_distinct("book_id").alias("n"))


def author_totals(counts: DataFrame) -> DataFrame:
    """AG02: total per author over all libraries, the current one included."""
    return counts.groupBy("author").agg(F.sum("n").alias("total"))


def title_libraries(links: DataFrame) -> DataFrame:
    """AG03: the libraries of each (normalised title, author); empty titles are a title like others."""
    t = links.select(title_key(F.col("title")).alias("norm_title"), "author", "library")
    return t.groupBy("norm_title", "author").agg(F.sort_array(F.collect_set("library")).alias("libraries"))


def library_updates(books: DataFrame, links: DataFrame, current: str, as_text: bool = False) -> DataFrame:
    """AG04 (JN05, JN06, ST01): for each book of ``current``: libraries of its authors but this one, the greatest author
    total, and the other libraries that hold the same title by one of its authors.

    Books without an author have no row. ``as_text`` gives ', '-joined strings and 'N: a, b' for duplicates. A total is
    NULL when no author is known, lists are empty, not NULL.
    """
    mine = book_authors(books.where(F.col("library") == current)).select("book_id", "title", "author")
    counts = author_library_counts(links)
    by_author = counts.groupBy("author").agg(F.sum("n").alias("total"), F.collect_set("library").alias("libraries"))
    same = title_libraries(links).withColumnRenamed("libraries", "copies")
    joined = mine.withColumn("norm_title", title_key(F.col("title"))).join(by_author, "author", "left").join(same, ["norm_title", "author"], "left")
    here = F.array(F.lit(current))

    def others(name: str) -> Column:
        return F.array_except(F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.coalesce(name, F.array().cast("array<string>")))))), here)

    out = joined.groupBy("book_id").agg(others("libraries").alias("author_libraries"), F.max("total").alias("author_total"), others("copies").alias("duplicates"))
    if not as_text:
        return out
    copies = F.when(F.size("duplicates") > 0, F.concat(F.size("duplicates").cast("string"), F.lit(": "), F.array_join("duplicates", ", "))).otherwise("")
    return out.select("book_id", F.array_join("author_libraries", ", ").alias("author_libraries"), "author_total", copies.alias("duplicates"))


def library_report(books: DataFrame) -> DataFrame:
    """AG05, AG09, PL23: books, distinct authors and titles held more than once, per library."""
    one = books.select("library", "book_id", "title", "authors").dropDuplicates(["library", "book_id"])
    n = one.groupBy("library").agg(F.count("*").alias("books"))
    authors = book_authors(one).groupBy("library").agg(F.count_distinct("author").alias("authors"))
    twice = one.where("title is not null").groupBy("library", "title").count().where("count > 1").groupBy("library").agg(F.count("*").alias("titles_twice"))
    return n.join(authors, "library", "left").join(twice, "library", "left").na.fill(0, ["authors", "titles_twice"])


def language_counts(books: DataFrame) -> DataFrame:
    """AG07, JN04: books per language; books without a language vanish."""
    return books.select("book_id", F.explode("languages").alias("language")).distinct().groupBy("language").agg(F.count("*").alias("books"))


def authors_left_count(names: DataFrame, links: DataFrame) -> DataFrame:
    """JN03, AG06: books of every listed author, 0 for those without."""
    return names.select("author").distinct().join(links.select("author", "book_id"), "author", "left").groupBy("author").agg(F.count_distinct("book_id").alias("books"))


def top_authors(counts: DataFrame, n: int = 10) -> DataFrame:
    """AG26, WN07: the authors with most books, and in how many libraries; ties by name."""
    t = counts.groupBy("author").agg(F.sum("n").alias("total"), F.count("*").alias("libraries"))
    return t.orderBy(F.desc("total"), "author").limit(n)
