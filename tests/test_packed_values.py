"""The splitter against a character-by-character reader, and its defined results for edge cases."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.operators.packed_values import packed_values, split_packed
from quire.session import one_row

DELIMS = set(",;|\t\r\n•、，；")
PAIRS = {'"': '"', "'": "'", "«": "»", "“": "”", "‘": "’"}


def brute(text):
    """An independent reader: walks the text once, one character at a time."""
    if text is None:
        return None
    t = text
    if len(s := t.strip()) > 1 and s[0] == "[" and s[-1] == "]":
        t = s[1:-1]

    def delim(i):
        return t[i] in DELIMS or t[i] == "/" and 0 < i < len(t) - 1 and t[i - 1].isspace() and t[i + 1].isspace()

    def closes(i):
        """Whether nothing but blanks lies between i and the next delimiter or the end."""
        while i < len(t) and not delim(i):
            if not t[i].isspace():
                return False
            i += 1
        return True

    def quoted(i):
        q, j, out = t[i], i + 1, ""
        while j < len(t):
            if q in "\"'" and t[j] == "\\" and j + 1 < len(t):
                out += t[j + 1] if t[j + 1] in "\"'\\" else t[j : j + 2]
                j += 2
            elif q == '"' and t[j : j + 2] == '""':
                out += '"'
                j += 2
            elif t[j] == PAIRS[q] and (q != "'" or closes(j + 1)):
                return (out, j + 1) if closes(j + 1) else None
            else:
                out += t[j]
                j += 1
        return None

    values, i = [], 0
    while i <= len(t):
        while i < len(t) and t[i].isspace() and not delim(i):
            i += 1
        got = quoted(i) if i < len(t) and t[i] in PAIRS else None
        if got:
            value, i = got
        else:
            j = i
            while j < len(t) and not delim(j):
                j += 1
            value, i = t[i:j], j
        while i < len(t) and not delim(i):
            i += 1
        i += 1
        if value.strip():
            values.append(value.strip())
    return values


CASES = [
    ("a, 'b, c', \"d\"", ["a", "b, c", "d"]),
    ("['Temas.Duelo', \"L'amour au village\"]", ["Temas.Duelo", "L'amour au village"]),
    ('["Saga \\"Uno\\"","b"]', ['Saga "Uno"', "b"]),
    ('"Saga ""Uno""" ; c', ['Saga "Uno"', "c"]),
    ("YA/middle-grade / Tono · Irónico", ["YA/middle-grade", "Tono · Irónico"]),
    ("a;;b;a", ["a", "b", "a"]),
    ("[]", []),
    ("", []),
    (" ; ; ", []),
    (None, None),
    ("xy,0,0,\"q,r\"", ["xy", "0", "0", "q,r"]),
    ("L'amour, it's, 'tis", ["L'amour", "it's", "'tis"]),
    ("a" * 100_000 + ",b", ["a" * 100_000, "b"]),
]


def run(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", packed_values(F.col("t")).alias("v")).orderBy("i").collect()]


def test_cases(spark):
    assert run(spark, [c[0] for c in CASES]) == [c[1] for c in CASES]
    assert [brute(c[0]) for c in CASES] == [c[1] for c in CASES]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["a", "é", "·", " ", ",", ";", "|", "/", " / ", '"', "'", "«", "»", "", "", "0", "\n"]), max_size=14).map("".join), min_size=20, max_size=80))
def test_against_brute_force(spark, texts):
    assert run(spark, texts) == [brute(t) for t in texts]


def test_long_values(spark):
    """No value is too long for the JVM's stack: runs, escapes, doubled quotes, apostrophes and blanks."""
    n = 100_000
    texts = [
        '"' + "a, " * (n * 10 // 3) + '",b', '"' + '\\"' * n + '",b', '"' + '""' * n + '",b', "'" + "it's " * n + "',b", "'" + "\\'" * n + "',b",
        "«" + "a," * n + "»,b", "a" + " " * (n * 10) + "b,c", "x," * n + '"y,z"',
    ]
    got = run(spark, texts)
    assert got[0] == [("a, " * (n * 10 // 3)).strip(), "b"]
    assert got[1] == ['"' * n, "b"] and got[2] == ['"' * n, "b"]
    assert got[3] == [("it's " * n).strip(), "b"] and got[4] == ["'" * n, "b"]
    assert got[5] == ["a," * n, "b"]
    assert got[6] == [texts[6][:-2], "c"] and got[7] == ["x"] * n + ["y,z"]


def test_one_row(spark):
    """Rows of a repeated key are reduced to the greatest, with and without the small set of repeated keys."""
    df = spark.createDataFrame([(1, "a", None), (2, "b", 1), (2, "c", 0), (2, "c", 0), (None, "d", 1), (None, None, 2), (3, "e", 5)], "k int, t string, v int")
    want = [(None, "d", 1), (1, "a", None), (2, "c", 0), (3, "e", 5)]
    for most in (0, 1, 10):
        assert sorted(map(tuple, one_row(df, "k", most).collect()), key=lambda r: (r[0] is not None, r[0] or 0)) == want
    assert one_row(df.limit(0), "k").count() == 0
    assert sorted(r.k or 0 for r in one_row(df.select("k"), "k").collect()) == [0, 1, 2, 3]


def test_rows_and_clashes(spark):
    df = spark.createDataFrame([(1, "a;b", "x"), (1, "a;b", "x"), (2, None, "y")], "row_id int, tags string, value string")
    rows = split_packed(df, "tags", ["row_id"]).collect()
    assert sorted(map(tuple, rows)) == [(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 2, "b")]
    assert split_packed(df.limit(0), "tags", ["row_id"]).count() == 0
    with pytest.raises(ValueError):
        split_packed(df, "tags", ["value"])


def test_whole_table(spark):
    d = "/root/testdata/sf0.01/training_rows.parquet"
    rows = spark.read.parquet(d).select("tags").distinct().collect()
    assert run(spark, [r.tags for r in rows]) == [brute(r.tags) for r in rows]
