"""Sources on generated files, and the stream of finished pairs."""

import io
import json
import sqlite3
import zipfile

from pyspark.sql import functions as F

from quire.schema import field_name, require_columns, to_array
from quire.sources import ebooks, pages, tables
from quire.streaming.append import follow_pairs

OPF = """<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="x" xmlns:opf="http://www.idpf.org/2007/opf"><dc:title id="a">Uno &amp; Dos</dc:title><dc:title id="b">Un subt&#237;tulo</dc:title>
<meta refines="#b" property="title-type">subtitle</meta><dc:contributor opf:role="bkp">Taller 9</dc:contributor><meta name="Sigil version" content="1.2"/><dc:subject> Mar </dc:subject><dc:subject>Noche</dc:subject></metadata>
<manifest><item id="c1" href="Text/One.xhtml" media-type="application/xhtml+xml"/><item id="c2" href="two.xml" media-type="application/xhtml+xml"/><item id="n" href="nav.xhtml" media-type="application/xhtml+xml"/></manifest>
<spine><itemref idref="c2"/><itemref idref="n"/><itemref idref="c1"/></spine></package>"""


def epub(opf=OPF):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<c xmlns="u"><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></c>')
        z.writestr("OEBPS/p.opf", opf)
        z.writestr("OEBPS/text/one.xhtml", "<html><head><title>no</title><style>x</style></head><body><p>Capítulo Uno</p><script>y</script></body></html>")
        z.writestr("OEBPS/two.xml", "<html><body>Second, chapter!</body></html>")
        z.writestr("OEBPS/nav.xhtml", "<html/>")
        z.writestr("OEBPS/jacket.xhtml", "<html><body>z</body></html>")
        z.writestr("OEBPS/orphan.html", "<html><body>Last</body></html>")
        z.writestr("OEBPS/blank.html", "<html><body> </body></html>")
    return out.getvalue()


def test_epub(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(epub())
    (tmp_path / "b.epub").write_bytes(b"no zip")
    (tmp_path / "c.azw3").write_bytes(b"x")
    b = ebooks.read_books(spark, str(tmp_path)).cache()
    ch = b.where("kind = 'chapter'").orderBy("pos").collect()
    assert [(r["name"], r["value"]) for r in ch] == [("OEBPS/two.xml", "second chapter"), ("OEBPS/text/one.xhtml", "capitulo uno"), ("OEBPS/orphan.html", "last")]
    assert {(r["name"].split("/")[-1], r["value"]) for r in b.where("kind = 'ignored'").collect()} == {("nav.xhtml", "sistema"), ("jacket.xhtml", "jacket"), ("blank.html", "vacío")}
    p = {r.path[-6:]: r for r in ebooks.packages(b).collect()}
    a = p["a.epub"]
    assert (a.generator, a.producer, a.title, a.subtitle, a.subjects, a.status) == ("Sigil 1.2", "Taller 9", "Uno & Dos", "Un subtítulo", ["Mar", "Noche"], "extracted")
    assert p["b.epub"].status == p["c.azw3"].status == "failed" and ebooks.report(ebooks.packages(b)).count() == 3


def test_csv_and_libraries(spark, tmp_path):
    d = tmp_path / "csv"
    d.mkdir()
    (d / "x.csv").write_bytes("﻿title,#libreria\n\"a\nb\",L\n".encode() + b"\0" * 40)
    (d / "y.csv").write_text("title\nz\n")
    rows, files = tables.read_csv_folder(spark, str(d))
    assert [(r.source_file, r.fields) for r in rows.collect()] == [("x.csv", {"title": "a\nb", "#libreria": "L"})]
    assert {(r.source_file, r.rows, r.nul_bytes, r.used) for r in files.collect()} == {("x.csv", 1, 40, True), ("y.csv", 0, 0, False)}
    for name in ("A", "B"):
        (tmp_path / "libs" / name).mkdir(parents=True)
    with sqlite3.connect(tmp_path / "libs/A/metadata.db") as c:
        c.executescript("CREATE TABLE books(id, title); CREATE TABLE authors(id, name); CREATE TABLE books_authors_link(book, author); INSERT INTO books VALUES(1,'T'); INSERT INTO authors VALUES(7,'P'); INSERT INTO books_authors_link VALUES(1,7),(2,7)")
    (tmp_path / "libs/B/metadata.db").write_bytes(b"broken" * 300)
    good, bad = tables.read_libraries(spark, str(tmp_path / "libs"))
    assert [tuple(r) for r in good.collect()] == [("A", 1, "T", "P")] and [r.library for r in bad.collect()] == ["B"]
    (tmp_path / "r.json").write_text('{"a": 1}')
    assert tables.first_resource("r.json", ["/none", str(tmp_path)]) == {"a": 1} and tables.first_resource("q.json", ["/none"]) is None
    (tmp_path / "in.csv").write_text("Titulo,Estado\nt1,x\nt2,y\nt3,x\n")
    done = spark.createDataFrame([("t1",)], "key string")
    assert [r.Titulo for r in tables.pending_rows(spark, str(tmp_path / "in.csv"), ["x"], done, F.col("Titulo")).collect()] == ["t3"]


def test_pages(spark):
    state = {
        "Book:0": {"x": 1}, "Book:1": {"title": "T", "primaryContributorEdge": {"role": "Author", "node": {"__ref": "Contributor:c1"}}, "secondaryContributorEdges": [{"role": "Illustrator", "node": {"__ref": "Contributor:c2"}}],
        "bookSeries": [{"userPosition": "2"}], "details": {"isbn": "1", "isbn13": "13", "publicationTime": 1000, "language": {"name": "Spanish"}}, "bookGenres": [{"genre": {"name": "g"}}, {}]},
        "Series:s": {"title": "S"}, "Contributor:c2": {"id": "c2", "name": "Ill"}, "Contributor:c1": {"id": "c1", "name": "Aut"}, "Work:w": {"stats": {"averageRating": 4.5}, "details": {"publicationTime": 86400000}},
    }
    html = f'<script id="__NEXT_DATA__" type="x">{json.dumps({"props": {"pageProps": {"apolloState": state}}})}</script>'
    df = spark.createDataFrame([("http://h/book/show/42-t", html), ("u", "<html/>"), ("v", None)], "url string, html string")
    (r,) = pages.page_books(df).collect()
    assert (r.id, r.title, r.authors, r.series, r.series_index, r.rating, r.isbn, r.language, r.tags) == ("42", "T", ["Aut"], "S", 2.0, 4.5, "13", "spa", ["g"])
    assert str(r.published)[:10] == "1970-01-02"
    assert [x.relevance for x in pages.richest_first(pages.page_books(df), "isbn").collect()] == [0]


def test_schema(spark):
    assert field_name(" Foo ") == "#foo" and field_name("") == ""
    df = spark.createDataFrame([("a, ,b", ["x ", ""])], "s string, l array<string>")
    assert [tuple(map(tuple, r)) for r in df.select(to_array(df, "s"), to_array(df, "l")).collect()] == [(("a", "b"), ("x",))]
    try:
        require_columns(df, ["s", "zz"])
        raise AssertionError
    except ValueError as e:
        assert "zz" in str(e)


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for rows in ([(1, 2, 50.0)], [(1, 2, 50.0), (3, 4, 60.0)], [(9, 1, 1.0)]):
        spark.createDataFrame(rows, "a long, b long, similarity double").coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    q = follow_pairs(spark, src, schema, spark.createDataFrame([(9,)], "book long"), out, str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(f"{out}/batch=2").collect())) == [(1, 2, 50.0), (3, 4, 60.0)]
