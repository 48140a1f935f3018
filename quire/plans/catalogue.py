"""Queries on statistics, titles, synopses, authors and universes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.titles import author_sets, pair_title, title_key
from quire.operators import authors as A
from quire.operators import comments as C
from quire.operators import stats as S
from quire.operators import world as W
from quire.plans.queries import query
from quire.session import load

#: Blanks of Unicode as a RE2 class body, and the SQL of title_key.
BLANK = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINKS = "links AS (SELECT DISTINCT library, book_id, title, unnest(authors) AS author FROM current_books), l AS (SELECT * FROM links WHERE author IS NOT NULL)"


def sql_collapse(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '[{BLANK}]+', ' ', 'g'), '^ | $', '', 'g')"


def sql_title_key(t: str) -> str:
    x = f"regexp_replace(lower(coalesce({t}, '')), '[\\(\\[].*?[\\)\\]]', '', 'g')"
    x = f"regexp_replace({x}, '([{BLANK}]*-[{BLANK}]*)?\\b(spa|eng|esp|fans)\\b([{BLANK}]*-[{BLANK}]*fans)?$', '')"
    x = f"string_split({x}, ' - ')[-1]"
    return sql_collapse(f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_{BLANK}]', '', 'g')")


def books(spark, d):
    return load(spark, d, "current_books")


def links(spark, d):
    return S.book_authors(books(spark, d))


@query("author_library_counts", f"WITH {LINKS} SELECT library, author, count(DISTINCT book_id) AS n FROM l GROUP BY ALL")
def author_library_counts(spark, d):  # AG01, JN01, JN02
    return S.author_library_counts(links(spark, d))


@query("author_totals", f"WITH {LINKS}, c AS (SELECT library, author, count(DISTINCT book_id) AS n FROM l GROUP BY ALL) SELECT author, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY author")
def author_totals(spark, d):  # AG02
    return S.author_totals(S.author_library_counts(links(spark, d)))


@query("title_libraries", f"WITH {LINKS} SELECT {sql_title_key('title')} AS norm_title, author, list_sort(list(DISTINCT library)) AS libraries FROM l GROUP BY ALL")
def title_libraries(spark, d):  # AG03
    return S.title_libraries(links(spark, d))


_UPDATES = f"""WITH {LINKS}, k AS (SELECT *, {sql_title_key('title')} AS norm_title FROM l),
tot AS (SELECT author, sum(n) AS total, list(DISTINCT library) AS libs FROM (SELECT library, author, count(DISTINCT book_id) AS n FROM l GROUP BY ALL) GROUP BY author),
same AS (SELECT norm_title, author, list(DISTINCT library) AS copies FROM k GROUP BY ALL),
j AS (SELECT book_id, total, libs, copies FROM k JOIN tot USING (author) JOIN same USING (norm_title, author) WHERE library = 'viajes')
SELECT book_id, array_to_string(list_sort(list_filter(list_distinct(flatten(list(libs))), lambda x: x <> 'viajes')), ', ') AS author_libraries,
 CAST(max(total) AS BIGINT) AS author_total,
 CASE WHEN len(list_filter(list_distinct(flatten(list(copies))), lambda x: x <> 'viajes')) = 0 THEN '' ELSE
 len(list_filter(list_distinct(flatten(list(copies))), lambda x: x <> 'viajes')) || ': ' || array_to_string(list_sort(list_filter(list_distinct(flatten(list(copies))), lambda x: x <> 'viajes')), ', ') END AS duplicates
FROM j GROUP BY book_id"""


@query("library_updates", _UPDATES)
def library_updates(spark, d):  # AG04, JN05, JN06, ST01, PL01
    return S.library_updates(books(spark, d), links(spark, d), "viajes", as_text=True)


_REPORT = """WITH one AS (SELECT DISTINCT library, book_id, title, authors FROM current_books)
SELECT library, n AS books, coalesce(a, 0) AS authors, coalesce(t, 0) AS titles_twice FROM (SELECT library, count(*) AS n FROM one GROUP BY library)
LEFT JOIN (SELECT library, count(DISTINCT author) AS a FROM (SELECT library, unnest(authors) AS author FROM one) GROUP BY library) USING (library)
LEFT JOIN (SELECT library, count(*) AS t FROM (SELECT library, title FROM one WHERE title IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY library) USING (library)"""


@query("library_report", _REPORT)
def library_report(spark, d):  # AG05, AG08, AG09, PL23, EX08
    return S.library_report(books(spark, d))


@query("language_counts", "SELECT language, count(*) AS books FROM (SELECT DISTINCT book_id, unnest(languages) AS language FROM current_books) GROUP BY language")
def language_counts(spark, d):  # AG07, JN04
    return S.language_counts(books(spark, d))


@query("authors_left_count", f"WITH {LINKS}, names AS (SELECT DISTINCT authors AS author FROM training_rows WHERE authors IS NOT NULL) SELECT author, count(DISTINCT book_id) AS books FROM names LEFT JOIN l USING (author) GROUP BY author")
def authors_left_count(spark, d):  # JN03, AG06
    names = load(spark, d, "training_rows").select(F.col("authors").alias("author")).where("author is not null")
    return S.authors_left_count(names, links(spark, d))


@query("duplicate_titles", "SELECT count(*) AS titles FROM (SELECT title FROM (SELECT DISTINCT book_id, title FROM current_books WHERE title IS NOT NULL) GROUP BY title HAVING count(*) > 1)")
def duplicate_titles(spark, d):  # AG08
    one = books(spark, d).select("book_id", "title").where("title is not null").distinct()
    return one.groupBy("title").count().where("count > 1").agg(F.count("*").alias("titles"))


@query("top_authors", f"WITH {LINKS} SELECT author, CAST(sum(n) AS BIGINT) AS total, count(*) AS libraries FROM (SELECT library, author, count(DISTINCT book_id) AS n FROM l GROUP BY ALL) GROUP BY author ORDER BY total DESC, author LIMIT 10")
def top_authors(spark, d):  # AG26, WN07
    return S.top_authors(S.author_library_counts(links(spark, d)))


@query("title_normalised", f"SELECT DISTINCT book_id, {sql_title_key('title')} AS norm_title FROM current_books")
def title_normalised(spark, d):  # SC01
    return books(spark, d).select("book_id", title_key(F.col("title")).alias("norm_title")).distinct()


_ARTICLES = "the|a|an|el|la|los|las|un|una|unos|unas|le|les|der|die|das|il|lo|gli|de|het|o"


def sql_pair_title(t: str) -> str:
    x = f"regexp_replace(lower(coalesce({t}, '')), '[\\(\\[].*?[\\)\\]]', ' ', 'g')"
    x = sql_collapse(f"regexp_replace(string_split({x}, ':')[1], '[^\\p{{L}}\\p{{N}}_{BLANK}]', ' ', 'g')")
    return f"regexp_replace({x}, '^({_ARTICLES}) ', '')"


@query("pair_titles", f"SELECT DISTINCT book_id, {sql_pair_title('title')} AS norm_title FROM current_books")
def pair_titles(spark, d):  # SC02
    return books(spark, d).select("book_id", pair_title(F.col("title")).alias("norm_title")).distinct()


_WORDS = f"list_filter(string_split_regex(regexp_replace(lower(a), '[^\\p{{L}}\\p{{N}}_{BLANK}]', ' ', 'g'), '[{BLANK}]+'), lambda w: w <> '')"


@query("author_token_sets", f"SELECT DISTINCT a AS author, list_sort(list_distinct({_WORDS})) AS words FROM (SELECT unnest(authors) AS a FROM current_books) WHERE a IS NOT NULL AND len({_WORDS}) > 0")
def author_token_sets(spark, d):  # SC11
    names = books(spark, d).select(F.explode("authors").alias("author")).where("author is not null").distinct()
    sets = names.select("author", author_sets(F.array("author")).alias("s")).where(F.size("s") > 0)
    return sets.select("author", F.array_sort(F.col("s")[0]).alias("words"))


@query("authors_fixed")
def authors_fixed(spark, d):  # PR08, FL12, PL03 (look-behind: no SQL in RE2)
    return A.changed_authors(books(spark, d))


_WORLD = """WITH m AS (SELECT trim(regexp_replace(lower(s), '\\s+', ' ', 'g')) AS k, max(universe) AS universe FROM (SELECT universe, unnest(series) AS s FROM world_map) GROUP BY k)
SELECT DISTINCT book_id, series, universe FROM current_books JOIN m ON trim(regexp_replace(lower(series), '\\s+', ' ', 'g')) = m.k"""


@query("book_worlds", _WORLD)
def book_worlds(spark, d):  # PR51, JN11, PL05
    return W.worlds(books(spark, d), load(spark, d, "world_map"))


def comments(spark, d):
    return load(spark, d, "training_rows").select("row_id", "comments").dropDuplicates(["row_id"])


@query("comment_issues")
def comment_issues(spark, d):  # SC07, SC08, PR14, PR15, FL11, AG21 (entities and NFKC: no SQL)
    return C.comment_issues(comments(spark, d), "comments", "row_id")


@query("comment_issue_counts")
def comment_issue_counts(spark, d):  # AG22
    return C.issue_counts(C.comment_issues(comments(spark, d), "comments", "row_id"))


@query("comment_marks")
def comment_marks(spark, d):  # PL08
    return C.marks(C.comment_issues(comments(spark, d), "comments", "row_id"), "row_id")


@query("comment_fingerprints")
def comment_fingerprints(spark, d):  # PR16
    return C.fingerprint_groups(comments(spark, d), "comments", "row_id")
