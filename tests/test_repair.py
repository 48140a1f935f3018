"""Titles, authors, identifiers, tags and synopses: the known cases and the edge cases."""

import pytest
from pyspark.sql import functions as F

from quire.functions.titles import author_sets, pair_title, title_key
from quire.operators import authors, comments, identifiers, series, tags, world


def values(spark, rows, expr, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_authors(spark):
    cases = {"García, Gabriel": "Gabriel García", "JRR Tolkien": "J. R. R. Tolkien", "J.K.Rowling": "J. K. Rowling", "J K Rowling": "J. K. Rowling", "": "", "King, Stephen Jr.": "Stephen Jr. King", "Tolkien, J.R.R.": "J. R. R. Tolkien", None: None, "KING Stephen": "KING Stephen"}
    assert values(spark, list(cases), authors.canonical_author) == list(cases.values())


@pytest.mark.parametrize(
    ("title", "author", "want"),
    [
        ("Blackout - John Milton #10", None, ("John Milton", 10.0, None)), ("Mistborn [2] - The Well of Ascension", None, ("Mistborn", 2.0, None)), ("The Hobbit (2010)", None, (None, None, None)),
        ("Linsey Hall - 05 Rise of the Fae", "Linsey Hall", (None, 5.0, None)), ("Furia (Serie Crave 2) (Spanish Edition)", None, ("Crave", 2.0, None)), ("NIMWAY HALL 1794 - Charlotte", None, (None, None, None)),
        ("Coveted - Book 3 in the Gwen Sparks Series", None, ("Gwen Sparks", 3.0, None)), ("[Jack Morgan #05] - Private Berlin", None, ("Jack Morgan", 5.0, None)), ("(For His Pleasure 11) His Every Word", None, ("For His Pleasure", 11.0, None)),
        ("Star Trek: The Original Series - 020 - The Tears of the Singers", None, ("Star Trek: The Original Series", 20.0, None)), ("Karen Hawkins - MacLean 1 How to Abduct a Highland Lord", "Karen Hawkins", ("MacLean", 1.0, None)),
        ("(2012) Evie Undercover", None, (None, None, None)), (None, None, (None, None, None)), ("", None, (None, None, None)), ("Laundry Lady's Love (Ladies of Sanctuary House Book 1)", None, ("Ladies of Sanctuary House", 1.0, None)),
    ],
)
def test_series(title, author, want):
    assert series.find_series(title, None, author, author) == want


def test_clean_titles():
    c = series.clean_title
    assert c("John Milton #10", "John Milton", 10.0) == "John Milton #10"
    assert c("Solos - Adam Baker", author_sort="Baker, Adam") == "Solos"
    assert c("(2012) Evie Undercover") == "Evie Undercover"
    assert c("Mistborn [2] - The Well of Ascension", "Mistborn", 2.0) == "The Well of Ascension"
    assert c("Blackout - John Milton #10", "John Milton", 10.0) == "Blackout"
    assert c("Furia (Serie Crave 2) (Spanish Edition)", "Crave", 2.0) == "Furia"
    assert not any(map(series.valid_series, ("Linear Tactical Boxed Set", "#", "mobi v.9/", "", None, "book", "2010")))


def test_title_parts(spark):
    assert values(spark, ["Title (eng)", "(spa) Título", "Plain Title", None], series.title_language) == ["eng", "spa", None, None]
    assert values(spark, ["Dune: The Graphic Novel", "A: B - C", "Dune: Two (Book 2)", "x", None], series.title_subtitle) == ["The Graphic Novel", None, "Two", None, None]
    assert values(spark, ["El Quijote (Edición) - spa", None, " - "], title_key) == ["el quijote", "", ""]
    assert values(spark, ["The Hobbit: Illustrated (2nd)", None, "The"], pair_title) == ["hobbit", "", "the"]
    assert values(spark, [["J. R. R. Tolkien", None, "--"]], author_sets, "array<string>") == [[["j", "r", "tolkien"]]]


def test_identifiers(spark):
    f = lambda *p: dict(identifiers.fix_identifiers(list(p))[0])
    assert f(("asin", "B00ABC1234")) == {"amazon": "B00ABC1234"}
    assert f(("isbn0310861691", "ISBN0310861691")) == {"isbn": "0310861691"}
    assert f(("246ad44a-1111-2222-3333-444455556666", "x")) == {}
    assert f(("amazon", "tooShort")) == {}
    assert f(("urn:isbn:9780007351619", "x"), ("isbn-13", "ISBN-123")) == {"isbn": "9780007351619"}
    assert f() == {}
    df = spark.createDataFrame([(1, [("asin", "B00ABC1234")], "k"), (2, None, "k"), (3, [], "k")], "id int, ids array<struct<k:string,v:string>>, fixed string")
    rows = identifiers.fixed_identifiers(df, "ids", "id").collect()
    assert [(r.id, [tuple(x) for x in r.fixed]) for r in rows] == [(1, [("amazon", "B00ABC1234")])]


def test_comments(spark):
    long = " ".join(f"Sentence number {i} says something that is long enough to be counted here." for i in range(90))
    twice = "This sentence is surely longer than forty characters in all. " * 2 + "x " * 120
    short_core = " ".join(f"word{i}" for i in range(60)) + "</p><p>Praise for this</p>" + " ".join(f"more{i}" for i in range(2000))
    texts = ["", "<p>&nbsp;</p>", None, long, twice, short_core, "Visit www.example.com now"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, c string")
    got = {r.k: r.issues for r in comments.comment_issues(df, "c", "k").collect()}
    assert got[0] == got[1] == got[2] == ["vacio"]
    assert got[3] == ["largo"] and got[4] == ["repetido"] and got[5] == ["basura"] and got[6] == ["corto", "basura"]
    t = comments.with_text(spark.createDataFrame([("<p>A</p><p>B</p>",), ("Ni&ntilde;o &amp; perro",)], "c string"), "c").select("_text").collect()
    assert [r[0] for r in t] == ["A\n B", "Niño & perro"] or [r[0] for r in t] == ["A\nB", "Niño & perro"]
    assert comments.issue_counts(comments.comment_issues(df.limit(0), "c", "k")).count() == 0


def test_tags(spark):
    rules = [("Genero · Fantasia", "fantas[ií]a|fantasy"), ("Tono · Oscuro", "dark"), ("x", "(")]
    rows = [(1, "Themes.Dark Fantasy"), (1, "Tono · X"), (1, "junk"), (1, "zzz"), (1, None), (1, "_Biblioteca.Fantasía.Dark"), (2, " ")]
    df = spark.createDataFrame(rows, "id int, tag string")
    got = [(r.action, r.value) for r in tags.classified(df, "tag", rules, ["junk"]).orderBy("id", "tag").collect()]
    assert ("genre", "Genero · Fantasia") in got and ("canon", "Tono · X") in got and ("unknown", "zzz") in got and got.count(("drop", None)) == 3
    r = {x.id: x for x in tags.cleaned(df, "id", "tag", rules, ["junk"]).collect()}
    assert r[1].tags == ["Genero · Fantasia", "Tono · X", "zzz"] and r[1].unknown == 1 and r[2].tags == []
    assert values(spark, ["Genero · Fantasía", "Género · X", "Tono · Oscuro", "x"], tags.leaks_label) == [True, True, False, False]
    assert values(spark, ["Tono · Oscuro", "x"], tags.tag_value) == ["Oscuro", "x"]
    assert values(spark, [["A", "b", "a", "C"]], lambda c: tags.merged(c, blocked=("c",)), "array<string>") == [["A", "b"]]


def test_world(spark):
    w = spark.createDataFrame([("The Cosmere", ["Elantris", "Mistborn"]), ("A", ["mistborn"]), ("B", None)], "universe string, series array<string>")
    b = spark.createDataFrame([(1, "  ELANTRIS  "), (2, "MISTBORN"), (3, None), (4, "no")], "book_id long, series string")
    assert {r.book_id: r.universe for r in world.worlds(b, w).collect()} == {1: "The Cosmere", 2: "The Cosmere"}
