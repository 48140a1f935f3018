"""Tag canonicalisation to a controlled vocabulary (SC06, PR11-PR13, ST03, ST04, WN09, PL09, FL02, PR32)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import no_marks, strip, vectorised

# The mark of a canonical tag, path prefixes whose genre lies in the whole path, groups that give the label away.
CANON, PATHS, LEAKS = " · ", ("biblioteca", "libreria"), ("genero", "biblioteca", "libreria")


def folded(c: Column) -> Column:
    """Lower case without accents; ASCII strings never leave the JVM."""
    return F.lower(F.when(c.rlike(r"[^\x00-\x7f]"), vectorised(lambda s: no_marks(s, "NFD"))(c)).otherwise(c))


def compiled_rules(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """PR13: ordered (canonical, pattern) without accents; rules without a name, or whose pattern is invalid, are left out."""
    out = []
    for name, pattern in rules:
        try:
            re.compile(no_marks(pattern or "", "NFD"))
        except re.error:
            continue
        if name and pattern:
            out.append((name, no_marks(pattern, "NFD")))
    return out


def classified(tags: DataFrame, tag: str, rules: Sequence[tuple[str, str]], drop: Sequence[str] = (), drop_patterns: Sequence[str] = ()) -> DataFrame:
    """PR11: the table with ``action`` (canon, mapped, genre, drop, unknown) and ``value``; the first matching rule wins.

    Rules are few and fixed: they become one expression. A NULL or blank tag is dropped.
    """
    rules = compiled_rules(rules)
    t = tags.withColumn("_t", strip(F.col(tag))).withColumn("_f", folded(F.col("_t")))
    parts = F.filter(F.split("_f", r"\."), lambda x: F.trim(x) != "")
    squeeze = lambda c: F.trim(F.regexp_replace(c, "[^0-9a-z]+", " "))
    t = t.withColumn("_leaf", squeeze(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.col("_f")))).withColumn("_full", squeeze(F.col("_f")))

    def first_rule(c: Column) -> Column:
        return F.coalesce(*[F.when(c.rlike(f"(?i){p}"), name) for name, p in rules], F.lit(None).cast("string"))

    path = F.substring_index("_full", " ", 1).isin(*PATHS)
    hit = F.coalesce(F.when(~path, first_rule(F.col("_leaf"))), F.when(path | (F.col("_full") != F.col("_leaf")), first_rule(F.col("_full"))))
    t = t.withColumn("_hit", hit)
    refused = F.coalesce(F.col("_leaf"), F.lit("")) == ""
    if drop:
        refused = refused | F.col("_leaf").isin(*drop)
    for p in drop_patterns:
        refused = refused | F.col("_full").rlike(f"(?i){no_marks(p, 'NFD')}")
    canon = F.contains("_t", F.lit(CANON))
    action = F.when(F.coalesce("_t", F.lit("")) == "", "drop").when(canon, "canon").when(refused, "drop").when(F.startswith("_hit", F.lit("Genero" + CANON)), "genre").when(F.col("_hit").isNotNull(), "mapped").otherwise("unknown")
    t = t.withColumn("action", action)
    value = F.when(F.col("action") == "drop", F.lit(None).cast("string")).otherwise(F.when(F.col("action").isin("mapped", "genre"), F.col("_hit")).otherwise(F.col("_t")))
    return t.withColumn("value", value).drop("_t", "_f", "_leaf", "_full", "_hit")


def cleaned(rows: DataFrame, key: str, tag: str, rules: Sequence[tuple[str, str]], drop: Sequence[str] = (), drop_patterns: Sequence[str] = ()) -> DataFrame:
    """PR12, PL09, WN09: (key, tags, unknown, dropped) from one row per tag: distinct values sorted without regard to accents."""
    c = classified(rows, tag, rules, drop, drop_patterns).withColumn("_order", folded(F.col("value")))
    g = c.groupBy(key).agg(
        F.array_sort(F.collect_set(F.when(F.col("value").isNotNull(), F.struct("_order", "value")))).alias("v"),
        F.count_if(F.col("action") == "unknown").alias("unknown"), F.count_if(F.col("action") == "drop").alias("dropped"),
    )
    return g.select(key, F.transform("v", lambda x: x["value"]).alias("tags"), "unknown", "dropped")


def merged(*lists: Column, blocked: Sequence[str] = ()) -> Column:
    """ST03, ST04: ordered union without regard to case; the first spelling stays, blocked tags go."""
    every = F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])
    low = F.transform(every, F.lower)
    kept = F.filter(every, lambda x, i: (F.array_position(low, F.lower(x)) == i + 1) & ~F.lower(x).isin(*[b.lower() for b in blocked] or [""]))
    return kept


def leaks_label(tag: Column) -> Column:
    """FL02: the tag's group is one that names the label."""
    group = F.trim(F.substring_index(tag, "·", 1))
    raw = tag.rlike(r"(?iu)^_?(?:g[eé]nero|biblioteca|librer[ií]a)\s*[.:]")
    plain = F.translate(F.lower(group), "áéíóúü", "aeiouu")
    return (F.contains(tag, F.lit("·")) & plain.isin(*LEAKS)) | raw


def tag_value(tag: Column) -> Column:
    """PR32: what follows the facet's dot, or the tag."""
    return F.trim(F.element_at(F.split(tag, "·", 2), -1))
