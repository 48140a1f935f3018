"""Enrichment by an outside service, with the service injected (EX01, EX02, EX04, AG23, FL01, JN15, JN17, SC13-SC16, SC19).

Copies of a work are asked once: the group is found by key, its longest text stands for it, and answers are joined back
to all members. The service is a callable on a batch of rows; there is no network here.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.train import folded_key

# Length of a synopsis in a request, least confidence, words for no value, length of a series.
SYNOPSIS, LEAST, NOTHING, SERIES_MAX = 1200, 0.55, ("", "null", "none", "n/a", "ninguna", "ninguno", "-"), 200


def representatives(books: DataFrame, key: str) -> DataFrame:
    """AG23: (group, key, n): of each group of equal authors, title and languages the row with the longest synopsis.

    ``books``: key, title, authors (string), languages (list), comments.
    """
    langs = F.array_join(F.array_sort(F.coalesce("languages", F.array().cast("array<string>"))), ",")
    g = books.select(key, F.sha1(F.concat_ws("|", folded_key(F.col("authors")), folded_key(F.col("title")), langs)).alias("group"), F.length(F.coalesce("comments", F.lit(""))).alias("len"))
    return g.groupBy("group").agg(F.max(F.struct("len", (-F.col(key)).alias("k"))).alias("m"), F.count("*").alias("n")).select("group", (-F.col("m.k")).alias(key), "n")


def request_key(title: Column, author: Column) -> Column:
    """SC15."""
    return F.substring(F.sha1(F.concat_ws("|", F.coalesce(title, F.lit("")), F.coalesce(author, F.lit("")))), 1, 16)


def unanswered(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """JN17: requests without an answer in the cache, by ``key``."""
    return requests.join(cache.select("key"), "key", "left_anti")


def parse_array(text: str | None) -> list[dict]:
    """SC13, SC16: the objects of a JSON array, out of code fences, with trailing commas, or cut off in the middle."""
    t = re.sub(r"^\s*```(?:json)?|```\s*$", "", text or "", flags=re.M).strip()
    at = t.find("[")
    t = t[at:] if at >= 0 else t
    for attempt in (t, re.sub(r",\s*([\]}])", r"\1", t)):
        try:
            got = json.loads(attempt)
            return [x for x in (got if isinstance(got, list) else [got]) if isinstance(x, dict)]
        except ValueError:
            continue
    out, decoder, i = [], json.JSONDecoder(), 0
    while (i := t.find("{", i)) >= 0:
        try:
            obj, end = decoder.raw_decode(t, i)
            out.append(obj)
            i = end
        except ValueError:
            i += 1
    return [x for x in out if isinstance(x, dict)]


def answer(item: dict, labels: dict[str, str], themes: dict[str, str]) -> dict:
    """SC14, SC19: an answer in the closed vocabularies, confidence in whole percent."""
    conf = item.get("confianza")
    series = str(item.get("serie") or "").strip()
    return {
        "label": labels.get(str(item.get("libreria") or "").strip().lower()), "percent": None if not isinstance(conf, int | float) else round(conf * 100),
        "themes": [themes[t.strip().lower()] for t in item.get("temas") or [] if isinstance(t, str) and t.strip().lower() in themes],
        "series": "" if series.lower() in NOTHING else series[:SERIES_MAX], "reason": str(item.get("motivo") or "")[:SERIES_MAX],
    }


ANSWERS = "key string, label string, percent int, themes array<string>, series string, reason string, error string"


def ask(requests: DataFrame, service: Callable[[list[dict]], str], labels: list[str], themes: list[str], batch: int = 20) -> DataFrame:
    """EX01, EX02, JN15: one answer per request (key, title, author, synopsis).

    Answers are aligned by ``n``, else by place; a missing one is empty. A batch that fails gives its error to its own
    rows only.
    """
    known, vocabulary = {x.lower(): x for x in labels}, {x.lower(): x for x in themes}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                items = [{"n": i + 1, "title": r.title, "author": r.author, "synopsis": (r.synopsis or "")[:SYNOPSIS]} for i, r in enumerate(part.itertuples())]
                error, got = None, []
                try:
                    got = parse_array(service(items))
                except Exception as e:  # noqa: BLE001  (a failing batch must not end the job)
                    error = str(e)
                by_n = {x.get("n"): x for x in got}
                rows = []
                for i, k in enumerate(part["key"]):
                    a = answer(by_n.get(i + 1) or (got[i] if i < len(got) and "n" not in got[i] else {}), known, vocabulary)
                    rows.append((k, a["label"], a["percent"], a["themes"], a["series"], a["reason"], error))
                yield pd.DataFrame(rows, columns=["key", "label", "percent", "themes", "series", "reason", "error"]).astype({"percent": "Int32"})

    return requests.select("key", "title", "author", "synopsis").mapInPandas(run, ANSWERS)


def fanned_out(answers: DataFrame, members: DataFrame) -> DataFrame:
    """EX04: answers (key = group) to all members (group, id), uncertain ones marked."""
    a = answers.withColumn("status", F.when(F.col("error").isNotNull(), "error").when(F.col("label").isNull(), "(sin datos)").when(F.col("percent") < LEAST * 100, "(revisar)").otherwise("ok"))
    return members.join(a.withColumnRenamed("key", "group"), "group")
