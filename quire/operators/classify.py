"""Text classification with a sparse linear model, consensus of groups and votes of authors
(JN14, PR26-PR31, AG15, AG16, ST06, WN10, SNK01, SNK03, PL02).

Scoring is a join of n-grams with the model's terms and sums by document; no document or group is gathered. Ties go to
the class, or to the member, that comes first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The least confidence of a certain prediction, of an author's vote, and the suffixes of stored labels.
THRESHOLD, AUTHOR_BOOKS, AUTHOR_SHARE, REVIEW, NO_DATA = 0.55, 3, 0.6, "[REVISAR]", "(sin datos)"


def ngrams(text: Column) -> Column:
    """Words of a normalised text and its pairs of neighbours."""
    w = F.filter(F.split(text, " "), lambda x: x != "")
    pairs = F.transform(F.slice(w, 2, 1_000_000_000), lambda x, i: F.concat(F.get(w, i), F.lit(" "), x))
    return F.concat(w, pairs)


def term_weights(docs: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """JN14: (key, ngram, w): sublinear frequency by idf, of length 1 per document; unknown n-grams are dropped."""
    c = docs.select(key, F.explode(ngrams(F.col(text))).alias("ngram")).groupBy(key, "ngram").agg(F.count("*").alias("c"))
    x = c.join(terms.select("ngram", "idf"), "ngram").withColumn("x", (1 + F.log("c")) * F.col("idf"))
    norm = x.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return x.join(norm, key).select(key, "ngram", (F.col("x") / F.col("norm")).alias("w"))


def predict(docs: DataFrame, key: str, text: str, terms: DataFrame, classes: DataFrame) -> DataFrame:
    """PR26, PR28, WN10: (key, label, confidence, uncertain); label NULL and confidence 0 where no term is known.

    ``terms``: ngram, idf, coef (one per class); ``classes``: k, class_name, intercept, a few rows.
    """
    w = term_weights(docs, key, text, terms)
    names = F.broadcast(classes.select("k", "class_name", "intercept"))
    coef = terms.select("ngram", F.posexplode("coef").alias("k", "b"))
    # Sums per document and class; a document has as many rows as there are classes.
    s = w.join(coef, "ngram").groupBy(key, "k").agg(F.sum(F.col("w") * F.col("b")).alias("dot")).join(names, "k")
    s = s.select(key, "k", "class_name", (F.col("dot") + F.col("intercept")).alias("score"))
    best = s.groupBy(key).agg(
        F.max(F.struct(F.col("score"), (-F.col("k")).alias("first"), F.col("class_name"))).alias("b"), F.collect_list("score").alias("all")
    )
    conf = 1 / F.aggregate("all", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("b.score")))
    out = docs.select(key).distinct().join(best.select(key, F.col("b.class_name").alias("label"), conf.alias("confidence")), key, "left")
    out = out.select(key, "label", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    return out.withColumn("uncertain", F.col("label").isNull() | (F.col("confidence") < THRESHOLD))


def moods(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """PR27: the names of the rules whose pattern is found, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), name) for name, p in rules]))


def group_key(universe: Column, series: Column) -> Column:
    """PR31: the universe, else the series, with its kind; NULL without either."""
    named = lambda kind, c: F.when(F.trim(c) != "", F.concat(F.lit(kind + ":"), F.trim(c)))
    return F.coalesce(named("universe", universe), named("series", series))


def consensus(rows: DataFrame, key: str, group: str) -> DataFrame:
    """AG15, ST06: (key, label, uncertain, moods, tier) after the vote of each group.

    ``rows``: key, group, pos, label, confidence, uncertain, moods. Certain predictions add their confidence; the class with
    the greatest sum (first seen on ties) goes to all members, with the group's moods in the order first seen. Votes are
    summed by group and class before anything meets, so a hot group is a few partial sums per task.
    """
    votes = rows.where(F.col(group).isNotNull() & ~F.col("uncertain")).groupBy(group, "label").agg(F.round(F.sum("confidence"), 9).alias("votes"), F.min("pos").alias("first"))
    won = votes.groupBy(group).agg(F.max(F.struct("votes", (-F.col("first")).alias("f"), "label")).alias("w")).select(group, F.col("w.label").alias("winner"))
    mood = rows.where(F.col(group).isNotNull()).select(group, "pos", F.posexplode("moods").alias("i", "mood"))
    seen = mood.groupBy(group, "mood").agg(F.min(F.struct("pos", "i")).alias("at")).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("at", "mood"))).alias("m"))
    shared = won.join(seen, group, "left").select(group, "winner", F.transform(F.coalesce("m", F.array().cast("array<struct<at:struct<pos:bigint,i:int>,mood:string>>")), lambda x: x["mood"]).alias("all_moods"))
    j = rows.join(shared, group, "left")
    has = F.col("winner").isNotNull()
    return j.select(
        key, F.coalesce("winner", "label").alias("label"), (F.col("uncertain") & ~has).alias("uncertain"),
        F.when(has, F.col("all_moods")).otherwise(F.col("moods")).alias("moods"), F.when(has, "group").otherwise("single").alias("tier"),
    )


def author_votes(books: DataFrame, key: str) -> DataFrame:
    """AG16: (key, label) for unresolved books from their authors' certain ones.

    ``books``: key, authors, label, uncertain. An author with AUTHOR_BOOKS certain books or more, AUTHOR_SHARE of them of one
    class, decides; of several authors the first listed.
    """
    one = books.where("not uncertain and label is not null").select(F.explode(F.array_distinct("authors")).alias("author"), "label")
    n = one.groupBy("author", "label").agg(F.count("*").alias("n"))
    top = n.groupBy("author").agg(F.sum("n").alias("total"), F.max(F.struct("n", "label")).alias("best"))
    strong = top.where((F.col("total") >= AUTHOR_BOOKS) & (F.col("best.n") / F.col("total") >= AUTHOR_SHARE)).select("author", F.col("best.label").alias("vote"))
    open_ = books.where("uncertain or label is null").select(key, F.posexplode("authors").alias("pos", "author"))
    return open_.join(strong, "author").groupBy(key).agg(F.min(F.struct("pos", "vote")).alias("m")).select(key, F.col("m.vote").alias("label"))


def merge_prefixed(old: Column, new: Column, prefixes: Sequence[str], overwrite: bool = True) -> Column:
    """PR29, SNK03: the new values after the old ones, without repeats; old ones of an own prefix go where ``overwrite``."""
    o, n = (F.coalesce(x, F.array().cast("array<string>")) for x in (old, new))
    if overwrite:
        o = F.filter(o, lambda v: ~F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(v, p)))
    return F.array_distinct(F.concat(o, n))


def stored_label(value: Column) -> tuple[Column, Column]:
    """PR30, FL01: (label, uncertain) of a stored value."""
    unsure = F.contains(value, F.lit(REVIEW)) | F.endswith(value, F.lit(NO_DATA))
    return F.trim(F.replace(F.replace(value, F.lit(REVIEW), F.lit("")), F.lit(NO_DATA), F.lit(""))), unsure


def changes(rows: DataFrame, key: str) -> DataFrame:
    """PL02: the change set (key, field, value) of predictions with ``label, uncertain, moods``."""
    label = F.when(F.col("label").isNull(), F.lit(NO_DATA)).when(F.col("uncertain"), F.concat("label", F.lit(" " + REVIEW))).otherwise(F.col("label"))
    return rows.select(key, F.inline(F.array(F.struct(F.lit("library").alias("field"), label.alias("value")), F.struct(F.lit("moods").alias("field"), F.array_join("moods", ", ").alias("value")))))


def applied(table: DataFrame, change: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """SNK01, SNK02, SNK04: a table with a change set applied by field; unknown fields are ignored, others stay."""
    wide = change.where(F.col("field").isin(*fields)).groupBy(key).pivot("field", list(fields)).agg(F.max("value"))
    j = table.alias("t").join(wide.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields]), key, "left")
    return j.select(*[F.coalesce(f"_new_{c}", F.col(f"t.{c}").cast("string")).alias(c) if c in fields else F.col(c if c == key else f"t.{c}") for c in table.columns])
