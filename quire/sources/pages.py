"""Book pages with an embedded JSON state (SRC14, SRC15, JN13, PR40, PR41, EX05, EX06): pages are a table (url, html).

The state is an object of entities by key (``Book:..``, ``Series:..``); it is read as a map of JSON texts and its fields by
path, all in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Language names and their codes.
LANGUAGES = {"English": "eng", "French": "fra", "German": "deu", "Italian": "ita", "Portuguese": "por", "Spanish": "spa", "Dutch": "nld", "Japanese": "jpn"}
STATE = r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>'


def entities(pages: DataFrame) -> DataFrame:
    """SRC14: (url, book, series, work, contributors): the last titled book, the first series, the last work, all
    contributors, each as JSON text in page order. Pages without a state have no row."""
    raw = F.get_json_object(F.regexp_extract("html", STATE, 1), "$.props.pageProps.apolloState")
    m = pages.select("url", F.map_entries(F.from_json(raw, "map<string,string>")).alias("e")).where("e is not null")
    of = lambda p: F.transform(F.filter("e", lambda x: F.startswith(x["key"], F.lit(p))), lambda x: x["value"])
    books = F.filter(of("Book:"), lambda b: F.get_json_object(b, "$.title").isNotNull())
    return m.select("url", F.try_element_at(books, F.lit(-1)).alias("book"), F.try_element_at(of("Series:"), F.lit(1)).alias("series"), F.try_element_at(of("Work:"), F.lit(-1)).alias("work"), of("Contributor:").alias("contributors"))


def page_authors(book: Column, contributors: Column) -> Column:
    """JN13: names of the contributors with an author's role, in list order; without any, of the primary one."""
    edge = "struct<role:string,node:struct<__ref:string>>"
    one = F.from_json(F.get_json_object(book, "$.primaryContributorEdge"), edge)
    more = F.coalesce(F.from_json(F.get_json_object(book, "$.secondaryContributorEdges"), f"array<{edge}>"), F.from_json(F.lit("[]"), f"array<{edge}>"))
    ref = lambda e: F.substring(e["node"]["__ref"], 13, 1_000)
    ids = F.concat(F.when(one["role"].isin("Author", "Pseudonym"), F.array(ref(one))).otherwise(F.array().cast("array<string>")), F.transform(F.filter(more, lambda e: e["role"] == "Author"), ref))
    ids = F.when(F.size(ids) > 0, ids).otherwise(F.array(ref(one)))
    known = F.filter(contributors, lambda c: F.array_contains(ids, F.get_json_object(c, "$.id")) & F.get_json_object(c, "$.name").isNotNull())
    return F.when(one.isNotNull(), F.transform(known, lambda c: F.get_json_object(c, "$.name"))).otherwise(F.array().cast("array<string>"))


def page_books(pages: DataFrame, first_published: bool = True) -> DataFrame:
    """PR40, PR41, EX05: one row of metadata per page with a book."""
    e = entities(pages).where("book is not null")
    at = lambda c, p: F.get_json_object(c, "$." + p)
    position = F.expr("try_cast(get_json_object(book, '$.bookSeries[0].userPosition') as double)")
    when = F.coalesce(F.nullif(at("work", "details.publicationTime"), F.lit("")), at("book", "details.publicationTime")) if first_published else at("book", "details.publicationTime")
    names = F.create_map(*[x for k, v in LANGUAGES.items() for x in (F.lit(k), F.lit(v))])
    language = at("book", "details.language.name")
    genres = F.from_json(at("book", "bookGenres"), "array<struct<genre:struct<name:string>>>")
    return e.withColumn("_ms", when).select(
        F.regexp_extract("url", r"/show/(\d+)", 1).alias("id"), at("book", "title").alias("title"), page_authors(F.col("book"), F.col("contributors")).alias("authors"),
        F.when(position.isNotNull(), at("series", "title")).alias("series"), F.when(at("series", "title").isNotNull(), position).alias("series_index"),
        F.expr("try_cast(get_json_object(work, '$.stats.averageRating') as double)").alias("rating"), at("book", "description").alias("comments"),
        F.coalesce(F.nullif(at("book", "details.isbn13"), F.lit("")), at("book", "details.isbn")).alias("isbn"), at("book", "details.publisher").alias("publisher"),
        F.timestamp_seconds(F.expr("try_cast(_ms as bigint) div 1000")).alias("published"), F.coalesce(names[language], F.lower(language)).alias("language"),
        F.filter(F.transform(genres, lambda g: g["genre"]["name"]), lambda n: n.isNotNull()).alias("tags"), at("book", "imageUrl").alias("cover"),
    )


def richest_first(books: DataFrame, group: str) -> DataFrame:
    """WN05, EX06: editions of a group by length of description, then having a cover; ``relevance`` counts from 0."""
    w = W.partitionBy(group).orderBy(F.desc(F.length(F.coalesce("comments", F.lit("")))), F.desc(F.col("cover").isNotNull()), "id")
    return books.withColumn("relevance", F.row_number().over(w) - 1)
