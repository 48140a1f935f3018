"""Registry of this subpackage's queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import classifier_text
from quire.llm import encode, name_variants, packing, personal_data, plain_form, record_linkage, term_counts
from quire.operators.packed_values import packed_values, split_packed
from quire.session import cut, load, one_row

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _known(spark: SparkSession, d: str) -> DataFrame:
    """(word, n): the words of the known tags, as they stand in the fixed table."""
    words = F.explode(F.split("canon", r"[^\p{L}\p{M}]+")).alias("word")
    return load(spark, d, "tag_terms").select(words).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    titles = load(spark, d, "current_books").select("book_id", "title")
    rows = load(spark, d, "training_rows").select("row_id", "tags")
    known = _known(spark, d)
    vocabulary = known.unionByName(plain_form.word_vocabulary(titles, "title"))
    tags = split_packed(rows.where(F.col("tags").rlike(plain_form.SUSPECT)), "tags", ["row_id"], "pos", "tag")
    found = [("title", plain_form.odd_strings(titles, "book_id", "title", vocabulary)), ("tags", plain_form.odd_strings(tags, "row_id", "tag", known))]
    a, b = (df.select(F.lit(name).alias("field_name"), "rec_id", "plain") for name, df in found)
    return a.unionByName(b)


def _row_terms(spark: SparkSession, d: str):
    """What is counted of a training row: tags in their plain form, and the words of the normalised comment."""
    known = _known(spark, d)

    def terms(changed: DataFrame) -> DataFrame:
        def named(field: str, values):
            return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.struct(F.lit(field).alias("field"), v.alias("term")))

        # Each tag on its own, as in p4_found: a tag may hold any character, and its neighbours tell nothing of its script.
        changed = changed.withColumns({"_tags": packed_values(F.col("tags")), "_row": F.struct("row_id", "sign")})
        changed = plain_form.plain_elements(changed, "_row", "_tags", known).withColumn("_words", classifier_text("comments"))
        words = F.filter(F.split("_words", " "), lambda w: w.rlike("[a-z0-9]"))
        return changed.withColumn("_terms", F.concat(named("tags", F.filter("_tags", lambda t: t != "")), named("comments", words)))

    return terms


def _counted(spark: SparkSession, d: str, snapshots: list[DataFrame]) -> DataFrame:
    """The marks after the last of some snapshots of the training rows, each counted as a change of the one before."""
    store = term_counts.TermCounts(spark, "training_rows", "row_id", _row_terms(spark, d))
    for rows in snapshots:
        counts = store.update(rows.select("row_id", "tags", "comments"))
    found = cut(term_counts.marks(counts, snapshots[-1].select("row_id").distinct().count()))
    store.remove()
    return found


def _exports(spark: SparkSession, d: str) -> tuple[DataFrame, Column, Column]:
    """The training rows, and which of them were exported in the first and in the second half of the time; rows without a time are in both."""
    rows = load(spark, d, "training_rows")
    first, last = rows.select(F.min("exported_at"), F.max("exported_at")).first()
    middle = F.lit(None if first is None else first + (last - first) / 2)
    return rows, F.coalesce(F.col("exported_at") <= middle, F.lit(True)), F.coalesce(F.col("exported_at") > middle, F.lit(True))


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Counted as the rows arrived: the exports of the first half of the time, then all."""
    rows, early, _ = _exports(spark, d)
    return _counted(spark, d, [rows.where(early), rows])


@query("p5_deltas")
def p5_deltas(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p5_found by way of deletions and changes: the early exports without comments, the late ones only, then all."""
    rows, early, late = _exports(spark, d)
    return _counted(spark, d, [rows.where(early).withColumn("comments", F.lit(None).cast("string")), rows.where(late), rows])


@query("p6_ids")
def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    docs = one_row(load(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return encode.token_ids(docs, F.col("text")).select("doc_id", "ids")


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    authors = load(spark, d, "current_books").select(F.explode("authors").alias("name"))
    return name_variants.name_pairs(authors)


def _sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    no_name = ["", "desconocido", "unknown"]
    books = load(spark, d, "current_books")
    named = F.exists("authors", lambda a: a.isNotNull() & ~F.lower(F.trim(a)).isin(no_name))
    books = books.where(F.col("title").isNotNull() & named).select("book_id", "title", "authors", F.col("pubyear").alias("year"), F.try_element_at("languages", F.lit(1)).alias("language"), "series", "series_index")
    records = load(spark, d, "candidates").select(
        "bookid", "title", F.array("author.name").alias("authors"), F.col("pubyear").alias("year"), F.col("lang").alias("language"),
        F.lit(None).cast("string").alias("series"), F.lit(None).cast("double").alias("series_index"),
    )
    return books, records


@query("p3_confidence")
def p3_confidence(spark: SparkSession, d: str) -> DataFrame:
    pairs = record_linkage.link_records(*_sources(spark, d), "book_id", "bookid")
    return pairs.select("book_id", "bookid", F.round("confidence", 6).alias("confidence"))


@query("p3_found")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = record_linkage.link_records(*_sources(spark, d), "book_id", "bookid", least=record_linkage.LIKELY)
    return record_linkage.same_work(pairs).select("book_id", "bookid")


#: Room of a container in p7, in tokens.
CAPACITY = 2048


@query("p7_containers")
def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    docs = one_row(load(spark, d, "documents").select("doc_id", "text"), "doc_id")
    sizes = cut(encode.token_counts(docs, F.col("text")).select("doc_id", "tokens"))
    return packing.fill_containers(sizes, "doc_id", "tokens", CAPACITY)


@query("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    items = personal_data.personal_items(load(spark, d, "documents"), "doc_id", "text", ["kind", "lang"])
    return items.select("doc_id", "pii_kind", "found").distinct()


@query("p8_text")
def p8_text(spark: SparkSession, d: str) -> DataFrame:
    return personal_data.sanitise(load(spark, d, "documents"), "doc_id", "text", ["kind", "lang"], load(spark, d, "pii_kinds"))
