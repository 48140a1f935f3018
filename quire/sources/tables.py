"""Tables of rows: a folder of CSV exports, library databases, cached answers (SRC01-SRC04, SRC13)."""

from __future__ import annotations

import csv
import io
import json
import os
import sqlite3
import tempfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv_folder(spark: SparkSession, path: str, need: str = "#libreria") -> tuple[DataFrame, DataFrame]:
    """SRC03: (rows, files) of the CSV files below a folder.

    rows: source_file and the header's columns as a map ``fields``; files: source_file, rows, nul_bytes, used. A byte-order
    mark is dropped, NUL characters are removed and counted, files whose header lacks ``need`` are not used. One task
    reads one file; quoted line ends are kept.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, content in zip(frame["path"], frame["content"], strict=True):
                nul = bytes(content).count(0)
                text = bytes(content).replace(b"\0", b"").decode("utf-8-sig", errors="replace")
                reader = csv.DictReader(io.StringIO(text, newline=""))
                used = need in (reader.fieldnames or [])
                rows = [[(k, v) for k, v in r.items() if k is not None and not isinstance(v, list)] for r in reader] if used else []
                yield pd.DataFrame({"source_file": [os.path.basename(p)] * (len(rows) + 1), "fields": [*rows, None], "nul_bytes": [None] * len(rows) + [nul], "used": [None] * len(rows) + [used], "n": [None] * len(rows) + [len(rows)]}).astype({"nul_bytes": "Int64", "n": "Int64"})

    both = raw.mapInPandas(run, "source_file string, fields array<struct<k:string,v:string>>, nul_bytes long, used boolean, n long")
    rows = both.where("fields is not null").select("source_file", F.map_from_entries("fields").alias("fields"))
    return rows, both.where("fields is null").select("source_file", F.col("n").alias("rows"), "nul_bytes", "used")


LIBRARY = {
    "books": "SELECT id, title FROM books", "authors": "SELECT id, name FROM authors", "links": "SELECT book, author FROM books_authors_link",
}


def read_libraries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC01, SRC02: (rows, errors) of the library databases below a folder.

    rows: library (the folder's name), book_id, title, author, one per link, as the statistics take them. A database that
    cannot be read gives an error row and no other. One task reads one database, from its bytes.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "metadata.db").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, content in zip(frame["path"], frame["content"], strict=True):
                name = os.path.basename(os.path.dirname(p))
                rows: list[tuple] = []
                try:
                    with tempfile.NamedTemporaryFile(suffix=".db") as f:
                        f.write(content)
                        f.flush()
                        with sqlite3.connect(f"file:{f.name}?mode=ro", uri=True, timeout=20) as c:
                            got = {k: c.execute(q).fetchall() for k, q in LIBRARY.items()}
                    titles, names = dict(got["books"]), dict(got["authors"])
                    rows = [(name, b, titles[b], names[a], None) for b, a in got["links"] if b in titles and a in names]
                except sqlite3.Error as e:
                    rows = [(name, None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["library", "book_id", "title", "author", "error"]).astype({"book_id": "Int64"})

    both = raw.mapInPandas(run, "library string, book_id long, title string, author string, error string")
    return both.where("error is null").drop("error"), both.where("error is not null").select("library", "error")


def first_resource(name: str, folders: Sequence[str]) -> dict | list | None:
    """SRC13: the JSON resource of that name in the first folder that holds it; None without one."""
    for d in folders:
        p = os.path.join(d, name)
        if os.path.isfile(p):
            with open(p, encoding="utf-8") as f:
                return json.load(f)
    return None


def pending_rows(spark: SparkSession, csv_path: str, states: Sequence[str], cache: DataFrame, key, limit: int | None = None) -> DataFrame:
    """SRC04, WN11: rows of a CSV in one of ``states`` without a cached answer, in file order, the first ``limit`` if given."""
    rows = spark.read.csv(csv_path, header=True, multiLine=True).withColumn("_at", F.monotonically_increasing_id())
    rows = rows.where(F.col("Estado").isin(*states)).withColumn("key", key).join(cache.select("key"), "key", "left_anti").orderBy("_at")
    return (rows.limit(limit) if limit else rows).drop("_at")
