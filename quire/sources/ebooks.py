"""E-book containers: chapters in reading order, and the package's metadata
(SRC05-SRC10, SC03, SC09, FL04, PR42-PR46, PL11-PL13, SNK05).

A container is binary: one task reads one file in ``mapInPandas`` with the standard library. The package's metadata are
then regular expressions over a text column, in the JVM. AZW3 needs the host's own decoder: such files come out with the
reason, never with an exception.
"""

from __future__ import annotations

import html
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import no_marks, strip, vectorised

# Extensions and media types of chapters, names of files that are none, and the reasons given.
HTML_NAMES, HTML_TYPES = (".html", ".xhtml", ".htm"), ("application/xhtml+xml", "text/html")
SYSTEM = ("titlepage.xhtml", "calibre_raster_cover", "metadata.opf", "nav.xhtml", "toc.ncx")
REASONS = {"system": "sistema", "jacket": "jacket", "empty": "vacío", "error": "error de lectura"}


class _Text(HTMLParser):
    """Text of a page without scripts, styles and the head's own text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.mute = 0

    def handle_starttag(self, tag, attrs):
        self.mute += tag in ("script", "style", "head")

    def handle_endtag(self, tag):
        self.mute -= tag in ("script", "style", "head") and self.mute > 0

    def handle_data(self, data):
        if not self.mute:
            self.parts.append(data)


def chapter_text(s: str) -> str:
    """SC03: lower case, without accents, everything but word characters as blanks, collapsed."""
    return re.sub(r"[\W]+", " ", no_marks(s.lower(), "NFD")).strip()


def page_text(raw: bytes) -> str:
    """SC09."""
    p = _Text()
    p.feed(raw.decode("utf-8", errors="replace"))
    p.close()
    return chapter_text(" ".join(p.parts))


def _package(z: zipfile.ZipFile) -> str | None:
    """SRC05: the package file, from the container's index or else the first by extension."""
    try:
        for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter():
            if e.tag.endswith("rootfile") and e.get("full-path") in z.namelist():
                return e.get("full-path")
    except (KeyError, ElementTree.ParseError):
        pass
    return next((n for n in z.namelist() if n.endswith(".opf")), None)


def reading_order(z: zipfile.ZipFile, opf: str | None) -> tuple[list[str], set[str]]:
    """SRC08: the files of the spine in order, and those the manifest types as pages."""
    names = z.namelist()
    lower, base = {n.lower(): n for n in names}, {posixpath.basename(n): n for n in reversed(names)}
    if not opf:
        return [], set()
    try:
        root = ElementTree.fromstring(z.read(opf))
    except ElementTree.ParseError:
        return [], set()
    place = posixpath.dirname(opf)

    def resolve(href: str, loose: bool) -> str | None:
        path = posixpath.normpath(posixpath.join(place, href.split("#")[0])).lstrip("./")
        return path if path in names else lower.get(path.lower()) or (base.get(posixpath.basename(path)) if loose else None)

    items = {e.get("id"): e for e in root.iter() if e.tag.endswith("}item") and e.get("href")}
    typed = {p for e in items.values() if (e.get("media-type") or "").lower().split(";")[0].strip() in HTML_TYPES and (p := resolve(e.get("href"), False))}
    spine = [p for e in root.iter() if e.tag.endswith("}itemref") and e.get("idref") in items and (p := resolve(items[e.get("idref")].get("href"), True))]
    return list(dict.fromkeys(spine)), typed


def is_jacket(name: str, raw: bytes) -> bool:
    """FL04."""
    head = raw[:4096].lower()
    return posixpath.basename(name).lower().startswith("jacket") or b"calibre-content" in head and re.search(rb'<meta[^>]*calibre-content[^>]*jacket|<meta[^>]*jacket[^>]*calibre-content', head) is not None


def read_book(content: bytes) -> tuple[list[tuple[str, str]], list[tuple[str, str]], str | None]:
    """SRC07: (chapters, ignored, package) of an EPUB: the spine's pages first, then the others by name."""
    z = zipfile.ZipFile(io.BytesIO(content))
    opf = _package(z)
    spine, typed = reading_order(z, opf)
    pages = [n for n in z.namelist() if n.lower().endswith(HTML_NAMES) or n in typed]
    order = [n for n in spine if n in pages] + sorted(n for n in pages if n not in spine)
    chapters, ignored = [], []
    for n in order:
        if any(s in n.lower() for s in SYSTEM):
            ignored.append((n, REASONS["system"]))
            continue
        try:
            raw = z.read(n)
        except (KeyError, zipfile.BadZipFile, OSError):
            ignored.append((n, REASONS["error"]))
            continue
        if is_jacket(n, raw):
            ignored.append((n, REASONS["jacket"]))
        elif text := page_text(raw):
            chapters.append((n, text))
        else:
            ignored.append((n, REASONS["empty"]))
    return chapters, ignored, z.read(opf).decode("utf-8", errors="ignore") if opf else None


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """SRC05, SRC06, SRC07, SRC10: (path, kind, pos, name, value) of the containers below a folder.

    ``kind`` is chapter (value is its text), ignored (value is the reason), package (value is the metadata file) or error.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, content in zip(frame["path"], frame["content"], strict=True):
                ext = p.rsplit(".", 1)[-1].lower()
                rows: list[tuple] = []
                if ext == "epub":
                    try:
                        chapters, ignored, package = read_book(bytes(content))
                        rows = [(p, "chapter", i, n, t) for i, (n, t) in enumerate(chapters)] + [(p, "ignored", None, n, r) for n, r in ignored]
                        rows += [(p, "package", None, None, package)] if package else []
                    except (zipfile.BadZipFile, OSError) as e:
                        rows = [(p, "error", None, None, str(e))]
                elif ext in ("azw3", "mobi"):
                    rows = [(p, "error", None, None, "needs the host's decoder")]
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "kind", "pos", "name", "value"]).astype({"pos": "Int32"})

    return raw.mapInPandas(run, "path string, kind string, pos int, name string, value string")


def _first(opf: Column, *patterns: str) -> Column:
    return F.coalesce(*[F.nullif(strip(F.regexp_extract(opf, "(?is)" + p, 1)), F.lit("")) for p in patterns])


def package_fields(opf: Column) -> Column:
    """PR42-PR44: struct(generator, producer, title, subtitle, subjects), entities not yet decoded.

    The producer's second pattern takes any contributor that stands before a producer's mark, as the original does.
    """
    q, value = "[\"']", "[\"']([^\"']+)[\"']"
    role = rf"<dc:contributor[^>]*opf:role={q}bkp{q}[^>]*>([^<]+)</dc:contributor>"
    before = rf"<dc:contributor[^>]*>([^<]*)</dc:contributor>(?=.*opf:role={q}bkp{q})"
    bare = rf"<(?:\w+:)?contributor[^>]*\brole={q}bkp{q}[^>]*>([^<]+)</"
    named = lambda n: (rf"<meta[^>]*name={q}{n}{q}[^>]*content={value}", rf"<meta[^>]*content={value}[^>]*name={q}{n}{q}")
    sigil = _first(opf, *named("Sigil version"))
    refined = F.regexp_extract_all(opf, F.lit(rf"(?i)<meta\b(?=[^>]*title-type)[^>]*refines={q}#([^\"']+){q}[^>]*>\s*subtitle\s*</meta>"), F.lit(1))
    ids = F.regexp_extract_all(opf, F.lit(rf"(?is)<dc:title[^>]*\bid={value}[^>]*>[^<]+</dc:title>"), F.lit(1))
    titles = F.regexp_extract_all(opf, F.lit(rf"(?is)<dc:title[^>]*\bid={value}[^>]*>([^<]+)</dc:title>"), F.lit(2))
    known = F.filter(F.transform(refined, lambda r: strip(F.get(titles, (F.array_position(ids, r) - 1).cast("int")))), lambda x: x.isNotNull() & (x != ""))
    subtitle = F.coalesce(_first(opf, rf"<meta[^>]*property={q}calibre:subtitle{q}[^>]*>([^<]+)</meta>", *named("calibre:subtitle")), F.get(known, F.lit(0)))
    subjects = F.filter(F.transform(F.regexp_extract_all(opf, F.lit(r"(?is)<dc:subject[^>]*>([^<]+)</dc:subject>"), F.lit(1)), strip), lambda s: s != "")
    return F.struct(
        F.coalesce(_first(opf, *named("generator")), F.concat(F.lit("Sigil "), sigil)).alias("generator"), _first(opf, role, before, bare).alias("producer"),
        _first(opf, r"<dc:title[^>]*>([^<]+)</dc:title>").alias("title"), subtitle.alias("subtitle"), subjects.alias("subjects"),
    )


def packages(books: DataFrame) -> DataFrame:
    """PR46, SNK05: (path, generator, producer, title, subtitle, subjects, status) of each container's package."""
    decode = vectorised(html.unescape)
    p = books.where("kind = 'package'").select("path", package_fields(F.col("value")).alias("f"))
    p = p.select("path", "f.generator", "f.producer", decode("f.title").alias("title"), decode("f.subtitle").alias("subtitle"), F.split(decode(F.array_join("f.subjects", "\n")), "\n").alias("subjects"))
    p = p.withColumn("subjects", F.filter("subjects", lambda s: s != ""))
    found = F.col("generator").isNotNull() | F.col("producer").isNotNull() | F.col("title").isNotNull() | (F.size("subjects") > 0)
    files = books.select("path").distinct()
    return files.join(p, "path", "left").withColumn("status", F.when(found, "extracted").when(F.col("subjects").isNull(), "failed").otherwise("no metadata"))


def report(found: DataFrame) -> DataFrame:
    """PL13: one line per file, failed ones first."""
    order = F.array_position(F.array(F.lit("failed"), F.lit("no metadata"), F.lit("extracted")), F.col("status"))
    line = F.concat_ws(" | ", "path", "status", "title", "producer", "generator")
    return found.select(order.alias("o"), line.alias("line")).orderBy("o", "line").select("line")
