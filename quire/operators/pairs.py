"""Candidate pairs by sorted neighbourhood, and identity of files (JN07, WN01, AG24, SRC12, PL16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions.fuzzy import overlap, pairwise, ratio
from quire.functions.titles import author_sets, pair_title
from quire.session import cut


def ranked(rows: DataFrame, group: str, order: list[str], out: str = "rn") -> DataFrame:
    """``row_number`` within a group that may hold a third of all rows.

    A window would sort such a group in one task. Here all rows are range-partitioned and sorted, and a row's number is
    its place in its partition plus the rows before that partition; only one count per partition reaches the driver.
    """
    done = cut(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_m", F.monotonically_increasing_id()))
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = done.groupBy(part.alias("p")).count().orderBy("p").collect()
    before, total = [], 0
    for r in sizes:
        before.append((r.p, total))
        total += r["count"]
    offsets = rows.sparkSession.createDataFrame(before or [(0, 0)], "p long, before long")
    at = done.withColumn("p", part).join(F.broadcast(offsets), "p").withColumn("_at", F.col("before") + place)
    starts = at.groupBy(group).agg(F.min("_at").alias("_start"))
    return at.join(starts, group).withColumn(out, F.col("_at") - F.col("_start") + 1).drop("_m", "p", "before", "_at", "_start")


def neighbour_pairs(rows: DataFrame, key: str, group: str, order: list[str], carry: list[str], window: int = 40) -> DataFrame:
    """JN07, WN01: each row with the next ``window`` rows of its group: (group, a, b) and the carried columns of both.

    Rows fall into buckets of ``window`` numbers, so the join is on equal keys: a row meets its own and the next bucket.
    """
    r = ranked(rows.select(key, group, *dict.fromkeys([*order, *carry])), group, order).withColumn("bucket", F.floor(F.col("rn") / window))
    a = r.select(group, F.col("bucket").alias("b0"), F.col("rn").alias("rn_a"), F.col(key).alias("a"), *[F.col(c).alias(f"{c}_a") for c in carry])
    a = a.withColumn("bucket", F.explode(F.array("b0", F.col("b0") + 1)))
    b = r.select(group, "bucket", F.col("rn").alias("rn_b"), F.col(key).alias("b"), *[F.col(c).alias(f"{c}_b") for c in carry])
    return a.join(b, [group, "bucket"]).where(f"rn_b > rn_a and rn_b <= rn_a + {window}").drop("bucket", "b0", "rn_a", "rn_b")


def comparable(books: DataFrame) -> DataFrame:
    """(book_id, lang, norm_title, sets), each book once; only the first language counts, none is a block of its own."""
    one = books.select("book_id", "title", "authors", "languages").groupBy("book_id").agg(F.max(F.struct("title", "authors", "languages")).alias("r"))
    lang = F.coalesce(F.try_element_at("r.languages", F.lit(1)), F.lit(""))
    return one.select("book_id", lang.alias("lang"), pair_title(F.col("r.title")).alias("norm_title"), author_sets(F.col("r.authors")).alias("sets"))


def near_duplicates(books: DataFrame, title_least: float = 0.85, author_least: float = 0.5, window: int = 40) -> DataFrame:
    """JN07: (a, b, title_sim) of neighbours whose titles and authors are alike. The set test runs first, in the JVM."""
    p = neighbour_pairs(comparable(books), "book_id", "lang", ["norm_title", "book_id"], ["norm_title", "sets"], window)
    p = p.where(overlap(F.col("sets_a"), F.col("sets_b")) >= author_least)
    return p.withColumn("title_sim", pairwise(ratio)("norm_title_a", "norm_title_b")).where(F.col("title_sim") >= title_least).select("a", "b", F.bround("title_sim", 6).alias("title_sim"))


def identical_files(files: DataFrame, key: str, size: str, content: str) -> DataFrame:
    """AG24: (size, sha1, n, first) of contents held more than once; contents are hashed only where sizes repeat."""
    sizes = files.groupBy(size).count().where("count > 1").select(size)
    h = files.join(sizes, size, "left_semi").select(key, size, F.sha1(content).alias("sha1"))
    return h.groupBy(size, "sha1").agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")


def best_format(formats: DataFrame, preference: list[str]) -> DataFrame:
    """SRC12, PR46: per book the existing format that comes first in ``preference``; sizes fall back to 0."""
    rank: Column = F.array_position(F.array(*map(F.lit, preference)), F.upper("format"))
    w = W.partitionBy("book_id").orderBy("_rank", "path")
    known = formats.withColumn("_rank", rank).where((F.col("_rank") > 0) & F.col("path").isNotNull())
    return known.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("book_id", "format", "path", F.coalesce("size", F.lit(0)).alias("size"))
