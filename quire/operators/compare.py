"""Comparison of books chapter by chapter (JN08-JN10, AG11-AG14, PR21-PR25, PR49, PL15, PL17, PL18).

Chapters are rows (book, pos, text) and pairs are given; nothing here makes pairs within a group. Lengths, hashes and the
term statistics are JVM aggregates by pair; texts reach Python only for SimHash, once a chapter, and for the sequence
ratio of cells in the doubtful band. The one-to-one matching works on a pair's cells.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.fuzzy import head_and_tail, length_penalty, pairwise, ratio
from quire.functions.hashing import hamming, simhash64
from quire.functions.text import words
from quire.session import cut

# Length ratio below which books are disjoint, SimHash bands in percent, least score of a match, weights.
PREFILTER, SAME, APART, MATCH, TFIDF_WEIGHT, SEQUENCE_WEIGHT, CAP = 0.15, 96, 60, 35.0, 70, 30, 99.99


def measured(chapters: DataFrame) -> DataFrame:
    """(book, pos, text, md5, n, sim) of each chapter."""
    return chapters.select("book", "pos", "text", F.md5("text").alias("md5"), F.size(words(F.col("text"))).alias("n"), simhash64(F.col("text")).alias("sim"))


def totals(chapters: DataFrame) -> DataFrame:
    """AG11: chapters and words of each book."""
    return chapters.groupBy("book").agg(F.count("*").alias("chapters"), F.sum("n").alias("words"))


def prefiltered(pairs: DataFrame, total: DataFrame) -> DataFrame:
    """FL05: the pairs with both totals and ``disjoint``."""
    a, b = (total.select(F.col("book").alias(x), F.col("chapters").alias(f"n_{x}"), F.col("words").alias(f"w_{x}")) for x in "ab")
    p = pairs.join(a, "a").join(b, "b")
    r = F.least("w_a", "w_b") / F.greatest("w_a", "w_b")
    return p.withColumn("disjoint", F.coalesce((F.col("w_a") > 0) & (F.col("w_b") > 0) & (r < PREFILTER), F.lit(False)))


def tfidf_cosines(cells: DataFrame, chapters: DataFrame, pairs: DataFrame) -> DataFrame:
    """AG12, PR23: (pair, pos_a, pos_b, cosine) of the given cells; term frequencies by chapter, document frequencies over
    the chapters of both books of the pair. Cells without a common term have no row."""
    live = cells.select("pair").distinct()
    sides = pairs.join(live, "pair").select("pair", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("book")), F.struct(F.lit("b").alias("side"), F.col("b").alias("book")))).alias("s")).select("pair", "s.*")
    terms = chapters.select("book", "pos", "n", F.explode(words(F.col("text"))).alias("term")).groupBy("book", "pos", "n", "term").agg(F.count("*").alias("c"))
    t = sides.join(terms, "book")
    df = t.groupBy("pair", "term").agg(F.count("*").alias("df")).hint("merge")  # term tables grow with the texts: never a broadcast
    docs = sides.join(chapters.select("book", "pos"), "book").groupBy("pair").agg(F.count("*").alias("docs"))
    w = t.join(df, ["pair", "term"]).join(docs, "pair").withColumn("w", F.col("c") / F.col("n") * (F.log((F.col("docs") + 1) / (F.col("df") + 1)) + 1))
    norm = w.groupBy("pair", "side", "pos").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    a, b = (w.where(F.col("side") == x).select("pair", "term", F.col("pos").alias(f"pos_{x}"), F.col("w").alias(f"w_{x}")).hint("merge") for x in "ab")
    dots = cells.select("pair", "pos_a", "pos_b").join(a, ["pair", "pos_a"]).join(b, ["pair", "pos_b", "term"]).groupBy("pair", "pos_a", "pos_b").agg(F.sum(F.col("w_a") * F.col("w_b")).alias("dot"))
    na, nb = (norm.where(F.col("side") == x).select("pair", F.col("pos").alias(f"pos_{x}"), F.col("norm").alias(f"n_{x}")) for x in "ab")
    return dots.join(na, ["pair", "pos_a"]).join(nb, ["pair", "pos_b"]).select("pair", "pos_a", "pos_b", (F.col("dot") / (F.col("n_a") * F.col("n_b"))).alias("cosine"))


def score_matrix(pairs: DataFrame, chapters: DataFrame, method: str = "combined") -> DataFrame:
    """JN08, PR21: (pair, pos_a, pos_b, score) of every cell of the pairs. ``method`` 'tfidf' leaves the sequence out."""
    a, b = (chapters.select(F.col("book").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("pos", "md5", "n", "sim")]) for x in "ab")
    m = pairs.select("pair", "a", "b").join(a, "a").join(b, "b")
    near = (1 - hamming(F.col("sim_a"), F.col("sim_b")) / 64) * 100
    m = cut(m.withColumn("near", near).withColumn("same", F.col("md5_a") == F.col("md5_b")))
    band = m.where(f"not same and near between {APART} and {SAME}")
    cos = tfidf_cosines(band, chapters, pairs)
    texts = [chapters.select(F.col("book").alias(x), F.col("pos").alias(f"pos_{x}"), F.col("text").alias(f"t_{x}")) for x in "ab"]
    slow = band.select("pair", "a", "b", "pos_a", "pos_b").join(cos, ["pair", "pos_a", "pos_b"], "left")
    if method == "tfidf":
        slow = slow.withColumn("raw", F.coalesce("cosine", F.lit(0.0)) * 100)
    else:
        seq = pairwise(lambda x, y: ratio(head_and_tail(x), head_and_tail(y)))
        slow = slow.join(texts[0], ["a", "pos_a"]).join(texts[1], ["b", "pos_b"]).withColumn("seq", seq("t_a", "t_b"))
        slow = slow.withColumn("raw", F.coalesce("cosine", F.lit(0.0)) * TFIDF_WEIGHT + F.col("seq") * SEQUENCE_WEIGHT)
    m = m.join(slow.select("pair", "pos_a", "pos_b", "raw"), ["pair", "pos_a", "pos_b"], "left")
    penalty = length_penalty(F.col("n_a"), F.col("n_b"))
    raw: Column = F.when(F.col("near") > SAME, F.col("near")).when(F.col("near") < APART, 0.0).otherwise(F.col("raw"))
    score = F.when(F.col("same"), 100.0).otherwise(F.least(raw * penalty, F.lit(CAP)))
    return m.select("pair", "pos_a", "pos_b", F.bround(score, 2).alias("score"))


def greedy_matches(matrix: DataFrame) -> DataFrame:
    """JN10, WN06: one-to-one matches by falling score, ties in the order of the books: (pair, pos_a, pos_b, score)."""
    kinds = dict(matrix.dtypes)

    def match(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values(["score", "pos_a", "pos_b"], ascending=[False, True, True], kind="stable")
        a, b, keep = set(), set(), []
        for i, x, y in zip(cells.index, cells["pos_a"], cells["pos_b"], strict=True):
            if x not in a and y not in b:
                a.add(x)
                b.add(y)
                keep.append(i)
        return cells.loc[keep, ["pair", "pos_a", "pos_b", "score"]]

    schema = f"pair {kinds['pair']}, pos_a {kinds['pos_a']}, pos_b {kinds['pos_b']}, score double"
    return matrix.where(F.col("score") >= MATCH).groupBy("pair").applyInPandas(match, schema)


def compared(pairs: DataFrame, chapters: DataFrame, method: str = "combined") -> DataFrame:
    """AG13, PR25, PR49, PL15: (pair, similarity, matched, only_a, only_b) of every pair of books with chapters.

    Similarity is the sum over A of the matched scores and over B of the best score from any A, over both counts.
    Disjoint pairs have 0. Books without chapters are in no row.
    """
    ch = cut(measured(chapters))
    p = cut(prefiltered(pairs, totals(ch)))
    m = cut(score_matrix(p.where("not disjoint"), ch, method))
    hits = greedy_matches(m)
    of_a = hits.groupBy("pair").agg(F.sum("score").alias("sum_a"), F.count("*").alias("matched"))
    of_b = m.groupBy("pair", "pos_b").agg(F.max("score").alias("best")).groupBy("pair").agg(F.sum("best").alias("sum_b"))
    r = p.join(of_a, "pair", "left").join(of_b, "pair", "left").na.fill(0, ["sum_a", "matched", "sum_b"])
    sim = F.when(F.col("disjoint"), 0.0).otherwise(F.bround((F.col("sum_a") + F.col("sum_b")) / (F.col("n_a") + F.col("n_b")), 2))
    return r.select("pair", "a", "b", sim.alias("similarity"), "matched", (F.col("n_a") - F.col("matched")).alias("only_a"), (F.col("n_b") - F.col("matched")).alias("only_b"))


def same_chapters(chapters: DataFrame, pairs: DataFrame) -> DataFrame:
    """JN09: the pairs whose chapters are the same texts, counted, in any order."""
    h = chapters.groupBy("book").agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.md5("text"))), "|")).alias("h"))
    a, b = (h.select(F.col("book").alias(x), F.col("h").alias(f"h_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").where("h_a = h_b").select("pair", "a", "b")


def marked_copies(pairs: DataFrame, books: DataFrame) -> DataFrame:
    """AG14, ST07: books to mark among pairs of similarity 100: (book).

    Of two formats the EPUB stays; of one format the larger file, A being marked on a tie. In every group of equal title
    and authors the best copy (EPUB, then the smallest) stays in any case. ``books``: book, title, authors, format, size.
    """
    b = books.select("book", F.lower("title").alias("t"), F.lower(F.array_join("authors", ";")).alias("w"), F.upper("format").alias("f"), F.coalesce("size", F.lit(0)).alias("z"))
    x, y = (b.select(F.col("book").alias(k), F.col("f").alias(f"f_{k}"), F.col("z").alias(f"z_{k}")) for k in "ab")
    full = pairs.where("similarity >= 100").join(x, "a").join(y, "b")
    mark_a = F.when(F.col("f_a") == F.col("f_b"), F.col("z_a") <= F.col("z_b")).otherwise(F.col("f_a") != "EPUB")
    marked = full.select(F.when(mark_a, F.col("a")).otherwise(F.col("b")).alias("book")).distinct()
    group = b.join(marked.withColumn("m", F.lit(1)), "book", "left")
    w = W.partitionBy("t", "w")
    ranked = group.withColumn("left", F.count_if(F.col("m").isNull()).over(w)).withColumn("rank", F.row_number().over(w.orderBy((F.col("f") != "EPUB").cast("int"), "z", "book")))
    return ranked.where("m = 1 and not (left = 0 and rank = 1)").select("book")


def appended(known: DataFrame, new: DataFrame, deleted: DataFrame) -> DataFrame:
    """PL17, PL18: results so far with new ones, each (a, b) once, without pairs that touch a deleted book."""
    every = known.unionByName(new).dropDuplicates(["a", "b"])
    gone = deleted.select(F.col("book").alias("g"))
    return every.join(gone, every.a == gone.g, "left_anti").join(gone, every.b == gone.g, "left_anti")
