"""Ranking of a web source's candidates against a query (PR33-PR39, JN16, FL07-FL09, WN04, WN05, WN12), vote-weighted
tags (AG18, JN12, WN02, WN03) and triage of downloads (FL06, FL15, PL19-PL21).

Tokens are ours: lower case, apostrophes glued, runs of letters and digits. All of it is JVM expressions over arrays.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.fuzzy import author_similarity, languages_conflict, pairwise, title_similarity
from quire.functions.text import strip

# Number words, volume words, marks of what is no single book, thresholds and weights of the score.
_NUMBERS = "one two three four five six seven eight nine ten eleven twelve".split()
_ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth".split()
VOLUME_WORDS = "volume vol book part tome tomo libro band edition installment omnibus".split()
JUNK = ("summary", "study guide", "boxed set", "box set", "collection", "analysis of", "workbook", "sparknotes", "cliffsnotes", "resumen de", "guía de lectura")
NOT_A_BOOK, LEAST_SCORE, MOST_EDITIONS, STRONG, MOST_QUERIES = "NOT A BOOK", 4.0, 3, 0.95, 8
SEGMENTS = r"(?U)\s*:\s*|\s+[-–—]\s+"
SERIES_NOTE = r"(?iU)\s*\([^)]*(?:#\s*\d|\b(?:series|saga|trilogy|book|vol)\b)[^)]*\)"


def tokens(c: Column) -> Column:
    glued = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "['’]", "")
    return F.array_distinct(F.filter(F.split(glued, r"[^\p{L}\p{N}]+"), lambda x: x != ""))


def numbers(c: Column) -> Column:
    """PR37: the numbers in a title, as digits: figures, number words, ordinals."""
    names = F.create_map(*[x for i, w in enumerate([*_NUMBERS, *_ORDINALS]) for x in (F.lit(w), F.lit(str(i % 12 + 1)))])
    words = F.split(F.lower(F.coalesce(c, F.lit(""))), "[^0-9a-z]+")
    digits = F.transform(words, lambda w: F.coalesce(names[w], F.regexp_replace(F.nullif(F.regexp_extract(w, r"^(\d+)(?:st|nd|rd|th)?$", 1), F.lit("")), "^0+(?=.)", "")))
    return F.array_distinct(F.array_compact(digits))


def structural(t: Column) -> Column:
    """FL09: nothing but volume words and numbers."""
    return F.forall(t, lambda x: x.isin(*VOLUME_WORDS, *_NUMBERS, *_ORDINALS) | x.rlike("^[0-9]+$"))


def segments(title: Column, loose: bool) -> Column:
    """PR35: token sets of head, tail, middle segments and the whole; segments that only name a volume are left out
    unless ``loose``."""
    bare = F.regexp_replace(F.coalesce(title, F.lit("")), SERIES_NOTE, " ")
    parts = F.filter(F.split(bare, SEGMENTS), lambda x: F.length(strip(x)) >= 3)
    sets = F.transform(parts, tokens)
    kept = F.filter(sets, lambda s: (F.size(s) > 0) if loose else ~structural(s))
    return F.array_distinct(F.filter(F.concat(kept, F.array(tokens(bare))), lambda s: F.size(s) > 0))


def overlap(cores: Column, variants: Column) -> Column:
    """PR34: (exact, sim, size) of the best pair of a core and a variant; sim is shared over the larger set."""
    each = F.flatten(F.transform(cores, lambda a: F.transform(variants, lambda b: F.struct(
        ((F.size(F.array_intersect(a, b)) == F.size(a)) & (F.size(a) == F.size(b))).alias("exact"),
        (F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))).alias("sim"), F.size(b).alias("size")))))
    best = F.array_max(F.filter(each, lambda x: x["sim"] > 0))
    return F.coalesce(best, F.struct(F.lit(False).alias("exact"), F.lit(0.0).alias("sim"), F.lit(0).alias("size")))


def scored(pairs: DataFrame) -> DataFrame:
    """PR33, FL07, FL08: candidates of queries with ``sim, exact, author, score``; those refused are left out.

    ``pairs``: q_title, q_authors, title, author, ratings and any other columns.
    """
    p = pairs.where(F.coalesce("author", F.lit("")) != NOT_A_BOOK)
    junk = F.lit(False)
    for j in JUNK:
        junk = junk | (F.contains(F.lower("title"), F.lit(j)) & ~F.contains(F.lower(F.coalesce("q_title", F.lit(""))), F.lit(j)))
    p = p.where(~F.coalesce(junk, F.lit(True)))
    p = p.withColumn("_m", overlap(segments(F.col("q_title"), True), segments(F.col("title"), False)))
    asked = F.array_distinct(F.flatten(F.transform(F.coalesce("q_authors", F.array().cast("array<string>")), tokens)))
    mine = tokens(F.col("author"))
    p = p.withColumn("author_sim", F.when(F.size(mine) > 0, F.size(F.array_intersect(mine, asked)) / F.size(mine)).otherwise(0.0))
    p = p.select(*pairs.columns, F.col("_m.sim").alias("sim"), F.col("_m.exact").alias("exact"), "author_sim")
    p = p.where("exact or sim >= 0.85 or (author_sim >= 0.5 and sim >= 0.7)")
    nq, nc = numbers(F.regexp_replace(F.coalesce("q_title", F.lit("")), SERIES_NOTE, " ")), numbers(F.regexp_replace("title", SERIES_NOTE, " "))
    clash = (F.size(nq) > 0) & (F.size(nc) > 0) & ~F.arrays_overlap(nq, nc)
    rc = F.coalesce("ratings", F.lit(0))
    fame = F.when(rc <= 0, -1.0).when(F.col("sim") >= 0.7, F.least(F.lit(2.0), F.log10(rc + 1))).otherwise(0.0)
    score = 10 * F.col("sim") + F.when(F.col("exact"), 6).otherwise(0) + 4 * F.col("author_sim") - F.when(clash, 6).otherwise(0) + fame
    return p.withColumn("score", F.round(score, 9)).where(F.col("score") >= LEAST_SCORE)


def gathered(ranked: DataFrame) -> DataFrame:
    """WN12: candidates of the variants a search would have asked: up to the first at which the best of all so far is
    strong, or MOST_QUERIES. ``ranked``: query_id, variant, pos and the columns of :func:`scored`.

    The best so far is a running maximum by variant, of one row per query and variant.
    """
    good = (F.col("exact") | (F.col("sim") >= STRONG)) & (F.col("author_sim") >= 0.5)
    best = ranked.groupBy("query_id", "variant").agg(F.max(F.struct("score", (-F.col("variant")).alias("v"), (-F.col("pos")).alias("p"), good.alias("good"))).alias("b"))
    w = W.partitionBy("query_id").orderBy("variant").rowsBetween(W.unboundedPreceding, 0)
    so_far = best.withColumn("top", F.max("b").over(w))
    stop = so_far.groupBy("query_id").agg(F.coalesce(F.min(F.when(F.col("top.good"), F.col("variant"))), F.lit(MOST_QUERIES - 1)).alias("stop"))
    return ranked.join(stop, "query_id").where((F.col("variant") <= F.col("stop")) & (F.col("variant") < MOST_QUERIES)).drop("stop")


def editions(ranked: DataFrame) -> DataFrame:
    """JN16, WN04: (query_id, bookid, relevance): the best candidate and its editions, MOST_EDITIONS at most.

    An edition has the same words before a colon and the same numbers, and the same work where both name one.
    """
    one = ranked.groupBy("query_id", "bookid").agg(F.max(F.struct("score", (-F.col("variant")).alias("v"), (-F.col("pos")).alias("p"), "title", "workid")).alias("c"))
    top = one.groupBy("query_id").agg(F.max(F.struct("c.score", "c.v", "c.p", "bookid", "c.title", "c.workid")).alias("t"))
    key = lambda t: F.array_join(F.filter(F.split(F.regexp_replace(F.lower(F.substring_index(t, ":", 1)), "['’]", ""), r"[^\p{L}\p{N}]+"), lambda x: x != ""), " ")
    j = one.join(top, "query_id").where(key(F.col("c.title")) == key(F.col("t.title")))
    j = j.where(F.array_sort(numbers(F.col("c.title"))) == F.array_sort(numbers(F.col("t.title"))))
    j = j.where(F.col("c.workid").isNull() | F.col("t.workid").isNull() | (F.col("c.workid") == F.col("t.workid")))
    w = W.partitionBy("query_id").orderBy((F.col("bookid") != F.col("t.bookid")).cast("int"), F.desc("c.score"), F.desc("c.v"), F.desc("c.p"), "bookid")
    return j.withColumn("relevance", F.row_number().over(w) - 1).where(F.col("relevance") < MOST_EDITIONS).select("query_id", "bookid", "relevance")


def query_variants(title: Column, authors: Column) -> Column:
    """PR36, PR38, SC20: ordered distinct query strings: each core with the first author, alone, with the other authors,
    and the first four, three and two words of the head."""
    def clean(t: Column) -> Column:
        t = F.regexp_replace(t, r"(?<=[\p{L}\p{N}])[\(\[\{]([^)\]}0-9#]*)[\)\]\}]|[\(\[\{]([^)\]}0-9#]*)[\)\]\}](?=[\p{L}\p{N}])", "$1$2")
        t = F.regexp_replace(F.regexp_replace(t, r"[\(\[\{][^)\]}]*[\)\]\}]", " "), "['’]", "")
        return F.trim(F.regexp_replace(t, "[^0-9A-Za-z]+", " "))

    parts = F.filter(F.transform(F.split(F.coalesce(title, F.lit("")), SEGMENTS), clean), lambda x: F.length(x) >= 3)
    n = F.size(parts)
    ordered = F.when(n > 1, F.concat(F.slice(parts, 1, 1), F.slice(parts, -1, 1), F.slice(parts, 2, F.greatest(n - 2, F.lit(0))))).otherwise(parts)
    cores = F.array_distinct(F.filter(F.concat(ordered, F.array(clean(F.coalesce(title, F.lit(""))))), lambda x: x != ""))
    names = F.filter(F.transform(F.coalesce(authors, F.array().cast("array<string>")), clean), lambda x: x != "")
    with_ = lambda a: F.transform(cores, lambda c: F.trim(F.concat_ws(" ", c, a)))
    words = F.split(F.coalesce(F.get(cores, F.lit(0)), F.lit("")), " ")
    first = F.coalesce(F.get(names, F.lit(0)), F.lit(""))
    short = F.flatten(F.transform(F.filter(F.array(F.lit(4), F.lit(3), F.lit(2)), lambda k: F.size(words) > k), lambda k: F.array(F.trim(F.concat_ws(" ", F.array_join(F.slice(words, F.lit(1), k), " "), first)), F.array_join(F.slice(words, F.lit(1), k), " "))))
    others = F.flatten(F.transform(F.slice(names, F.lit(2), F.size(names)), with_))
    return F.array_distinct(F.filter(F.concat(with_(first), cores, others, short), lambda x: x != ""))


def shelf_tags(shelves: DataFrame, mapping: DataFrame | None = None, least: int = 10, share: float = 0.3) -> DataFrame:
    """AG18, JN12, WN02, WN03: (book_id, tag, votes, place) of the tags that stand out.

    Votes of a tag are summed, sums below ``least`` dropped; then those below ``share`` of the mean of the third and fourth
    largest (of those that exist, else 0). ``mapping``: shelf, tags[]; without it a shelf is its own tag, lower case.
    """
    s = shelves.select("book_id", F.lower("shelf").alias("shelf"), "votes")
    tagged = s.withColumnRenamed("shelf", "tag") if mapping is None else s.join(mapping.select("shelf", F.explode("tags").alias("tag")), "shelf")
    v = tagged.groupBy("book_id", "tag").agg(F.sum("votes").alias("votes")).where(F.col("votes") >= least)
    w = W.partitionBy("book_id").orderBy(F.desc("votes"), "tag")
    v = v.withColumn("place", F.row_number().over(w))
    base = v.groupBy("book_id").agg(F.coalesce(F.avg(F.when(F.col("place").isin(3, 4), F.col("votes"))), F.lit(0.0)).alias("base"))
    return v.join(base, "book_id").where(F.col("votes") >= share * F.col("base")).select("book_id", "tag", "votes", "place")


def triaged(pairs: DataFrame, title_least: float = 0.9, author_least: float = 0.8, need_author: bool = True) -> DataFrame:
    """FL06, PL19: the table with ``title_sim, author_sim, safe``. A NULL new title or author list means unchanged: 1.0.

    ``pairs``: old_title, old_authors, old_languages, new_title, new_authors, new_languages and others.
    """
    t = F.when(F.col("new_title").isNull(), 1.0).otherwise(pairwise(title_similarity)("old_title", "new_title"))
    a = F.when(F.col("new_authors").isNull(), 1.0).otherwise(pairwise(lambda x, y: author_similarity(None if x is None else list(x), None if y is None else list(y)))("old_authors", "new_authors"))
    p = pairs.withColumns({"title_sim": t, "author_sim": a})
    ok = (F.col("title_sim") >= title_least) & ~languages_conflict(F.col("old_languages"), F.col("new_languages"))
    return p.withColumn("safe", ok & ((F.col("author_sim") >= author_least) if need_author else F.lit(True)))


def outcome_counts(rows: DataFrame, status: str, outcomes: Sequence[str]) -> DataFrame:
    """PL21: one row with the number of rows of each outcome."""
    return rows.agg(*[F.count_if(F.col(status) == o).alias(o) for o in outcomes])


def retry_titles(rows: DataFrame, title: str, alternatives: Sequence[str]) -> DataFrame:
    """FL15, PL20: rows whose first non-blank alternative title differs without regard to case, with ``alt``."""
    alt = F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in alternatives])
    return rows.withColumn("alt", alt).where(F.lower("alt") != F.lower(F.trim(F.coalesce(title, F.lit("")))))
