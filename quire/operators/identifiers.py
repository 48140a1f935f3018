"""Identifier repair (PR09, PR10, FL10, PL04): an ordered list of pairs in, repaired pairs and the changes out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keys of one vendor that merge into 'amazon', and forms of identifiers.
STORE_KEYS, REGIONAL_KEYS = ("asin", "mobi-asin"), ("amazon_ca", "amazon_es", "amazon_uk")
UUID = re.compile(r"(?i)[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
ASIN = re.compile(r"(?i)[A-Z0-9]{10}")
ISBN_KEYS = (re.compile(r"(?i)isbn[-_ ]?1[03]()"), re.compile(r"(?i)isbn[-_ ]?([0-9]{9,13})"), re.compile(r"(?i)urn[:\-_/]?isbn[/:\-_]?([0-9]*)"))

PAIRS = "array<struct<k:string,v:string>>"
RESULT = f"fixed {PAIRS}, changes array<string>"


def isbn_value(value: str) -> str:
    """PR10: without a leading 'ISBN' and separators."""
    v = value.strip()
    return (v[4:].strip("-_ /") if v[:4].upper() == "ISBN" else v) or value.strip()


def fix_identifiers(pairs: list[tuple[str, str]]) -> tuple[list[tuple[str, str]], list[str]]:
    """PR09: the rules in their order; the first of several variants wins, and order is kept."""
    ids = dict(pairs)
    log: list[str] = []

    def move(keys: list[str], target: str, value=lambda k, v: v, keep_log=True) -> None:
        for k in keys:
            v = ids.pop(k)
            if target not in ids:
                ids[target] = value(k, v)
                log.append(f"{k}:{v} -> {target}:{ids[target]}")
            elif keep_log:
                log.append(f"removed {k}:{v}")

    move([k for k in STORE_KEYS if k in ids], "amazon")
    move([k for k in REGIONAL_KEYS if k in ids], "amazon")
    for k in [k for k, v in ids.items() if UUID.fullmatch(k) or UUID.fullmatch(v)]:
        log.append(f"removed {k}:{ids.pop(k)}")
    move([k for k, v in ids.items() if k == v], "isbn")
    if "amazon" in ids and not ASIN.fullmatch(ids["amazon"]):
        log.append(f"removed amazon:{ids.pop('amazon')}")
    inside: dict[str, str] = {}
    for k in ids:
        m = next((m for p in ISBN_KEYS if (m := p.fullmatch(k.strip()))), None)
        if m and k.strip().lower() != "isbn":
            inside[k] = m[1]
    move(list(inside), "isbn", lambda k, v: inside[k] or isbn_value(v))
    return list(ids.items()), log


def fixed_identifiers(df: DataFrame, column: str, key: str) -> DataFrame:
    """PL04: (key, fixed, changes) of the rows whose identifiers change. NULL counts as none; NULL values as ''."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [fix_identifiers([(p["k"] or "", p["v"] or "") for p in x]) if x is not None else ([], []) for x in b]
            yield pd.DataFrame({"fixed": [[{"k": k, "v": v} for k, v in f] for f, _ in got], "changes": [c for _, c in got]})

    udf = F.pandas_udf(run, RESULT).asNondeterministic()
    return df.select(key, udf(F.col(column)).alias("r")).select(key, "r.fixed", "r.changes").where(F.size("changes") > 0)
