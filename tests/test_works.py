"""Pairs, comparison, classification, ranking, training and rescue against plain definitions."""

import math
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quire.functions import fuzzy, hashing
from quire.functions.text import fold_text
from quire.operators import classify, compare, pairs, ranking, rescue, stats, train


def test_ranked_matches_row_number(spark):
    rows = [(i, "hot" if i % 3 else f"g{i % 7}", f"t{(i * 37) % 50:02d}") for i in range(400)]
    df = spark.createDataFrame(rows, "id int, g string, t string").repartition(7)
    got = {r.id: r.rn for r in pairs.ranked(df, "g", ["t", "id"]).collect()}
    want = {}
    for g in {r[1] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])), 1):
            want[r[0]] = n
    assert got == want
    near = {(r.a, r.b) for r in pairs.neighbour_pairs(df, "id", "g", ["t", "id"], [], 5).collect()}
    assert near == {(a, b) for a in want for b in want if rows[a][1] == rows[b][1] and 0 < want[b] - want[a] <= 5}


def brute_compare(a, b):
    """The chapter comparison, written out for one pair of lists of texts."""
    n = lambda t: len(t.split())
    wa, wb = sum(map(n, a)), sum(map(n, b))
    if wa and wb and min(wa, wb) / max(wa, wb) < 0.15:
        return 0.0
    docs = [set(t.split()) for t in a + b]
    idf = {w: math.log((len(docs) + 1) / (sum(w in x for x in docs) + 1)) + 1 for x in docs for w in x}

    def vec(t):
        c = Counter(t.split())
        return {w: c[w] / n(t) * idf[w] for w in c}

    def cos(x, y):
        dot = sum(v * y.get(w, 0) for w, v in x.items())
        d = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
        return dot / d if d else 0.0

    def score(x, y):
        if x == y:
            return 100.0
        near = (1 - bin((hashing.simhash(x) ^ hashing.simhash(y)) & (1 << 64) - 1).count("1") / 64) * 100
        if near < 60:
            return 0.0
        r = min(n(x), n(y)) / max(n(x), n(y)) if n(x) and n(y) else 0
        raw = near if near > 96 else cos(vec(x), vec(y)) * 70 + SequenceMatcher(None, x, y).ratio() * 30
        return round(min(raw * math.sqrt(2 * r / (r + 1)), 99.99), 2)

    m = {(i, j): score(x, y) for i, x in enumerate(a) for j, y in enumerate(b)}
    used_a, used_b, total = set(), set(), 0.0
    for (i, j), s in sorted(m.items(), key=lambda c: (-c[1], c[0])):
        if s >= 35 and i not in used_a and j not in used_b:
            used_a.add(i)
            used_b.add(j)
            total += s
    total += sum(max(m[i, j] for i in range(len(a))) for j in range(len(b)))
    return total / (len(a) + len(b))


def test_comparison(spark):
    base = ["the quick brown fox jumps over the lazy dog again and again " * 3, "a second chapter with other words in it for good measure " * 4, "third one tells of ships and stars and long nights at sea " * 2]
    books = {1: base, 2: [base[0], base[1].replace("other", "new"), "wholly different content about gardens and rain " * 3], 3: ["tiny"], 4: [base[0]], 5: [base[0], base[0]]}
    ch = spark.createDataFrame([(b, i, t) for b, ts in books.items() for i, t in enumerate(ts)], "book long, pos int, text string")
    todo = [(1, 1, 2), (2, 1, 3), (3, 4, 5), (4, 2, 4)]
    p = spark.createDataFrame(todo, "pair long, a long, b long")
    got = {r.pair: r for r in compare.compared(p, ch).collect()}
    for pair, a, b in todo:
        assert got[pair].similarity == pytest.approx(brute_compare(books[a], books[b]), abs=0.02)
    assert got[3].similarity == 100.0 and got[3].only_b == 1 and got[2].similarity == 0.0
    assert {(r.a, r.b) for r in compare.same_chapters(ch, spark.createDataFrame([(1, 1, 1), (2, 4, 5)], "pair long, a long, b long")).collect()} == {(1, 1)}
    gone = spark.createDataFrame([(5,)], "book long")
    assert compare.appended(p, p, gone).count() == 3


def test_marked_copies(spark):
    b = spark.createDataFrame([(1, "T", ["A"], "EPUB", 5), (2, "t", ["a"], "EPUB", 9), (3, "T", ["A"], "AZW3", 1)], "book long, title string, authors array<string>, format string, size long")
    p = spark.createDataFrame([(1, 2, 100.0), (2, 3, 100.0), (1, 3, 99.0)], "a long, b long, similarity double")
    assert {r.book for r in compare.marked_copies(p, b).collect()} == {1, 3}
    one = spark.createDataFrame([(1, 2, 100.0), (2, 1, 100.0)], "a long, b long, similarity double")
    assert {r.book for r in compare.marked_copies(one, b.where("book < 3")).collect()} == {1}


def test_similarities(spark):
    df = spark.createDataFrame([([["tolkien"]], [["j", "r", "tolkien"]], 200, 1000, ["und"], ["spa"]), ([["a"]], [["b"]], 0, 10, ["eng"], ["spa"])], "a array<array<string>>, b array<array<string>>, x int, y int, l array<string>, m array<string>")
    rows = df.select(fuzzy.overlap(F.col("a"), F.col("b")), fuzzy.length_penalty(F.col("x"), F.col("y")), fuzzy.languages_conflict(F.col("l"), F.col("m"))).collect()
    assert rows[0][0] == 1.0 and rows[0][1] == pytest.approx(0.57735, abs=1e-4) and rows[0][2] is False
    assert rows[1][0] == 0.0 and rows[1][1] == 0.0 and rows[1][2] is True
    assert fuzzy.ratio("abcd", "bcde") == 0.75 and fuzzy.title_similarity(None, "x") == 0.0 and fuzzy.title_similarity("The Hobbit", "Hobbit, The") == 1.0
    assert hashing.simhash("") == 0 and hashing.simhash("a b a") == hashing.simhash("b a a")
    assert fold_text("Ships&#8212;and stars") == "ships and stars" and fold_text("world's") == "worlds" and fold_text("sci-fi/fantasy!!") == "sci-fi/fantasy"


def test_classifier(spark):
    docs = spark.createDataFrame([(1, "dragon sword dragon"), (2, "unknown words"), (3, ""), (4, None)], "id long, text string")
    terms = spark.createDataFrame([("dragon", 1.5, [2.0, -1.0]), ("sword", 1.0, [0.0, 1.0]), ("dragon sword", 2.0, [1.0, 0.0])], "ngram string, idf double, coef array<double>")
    classes = spark.createDataFrame([(0, "F", 0.1), (1, "S", 0.0)], "k int, class_name string, intercept double")
    got = {r.id: r for r in classify.predict(docs, "id", "text", terms, classes).collect()}
    x = {"dragon": (1 + math.log(2)) * 1.5, "sword": 1.0, "dragon sword": 2.0}
    n = math.sqrt(sum(v * v for v in x.values()))
    s = [0.1 + (x["dragon"] * 2 + x["dragon sword"]) / n, (-x["dragon"] + x["sword"]) / n]
    assert got[1].label == "F" and got[1].confidence == pytest.approx(math.exp(s[0]) / sum(map(math.exp, s)))
    assert all(got[i].label is None and got[i].confidence == 0.0 and got[i].uncertain for i in (2, 3, 4))


def test_consensus_and_votes(spark):
    rows = spark.createDataFrame(
        [(1, "s", 1, "A", 0.9, False, ["x"]), (2, "s", 2, "B", 0.6, False, ["y", "x"]), (3, "s", 3, "B", 0.3, True, ["z"]), (4, None, 4, "B", 0.9, False, []), (5, "t", 5, None, 0.0, True, [])],
        "id long, g string, pos long, label string, confidence double, uncertain boolean, moods array<string>",
    )
    got = {r.id: r for r in classify.consensus(rows, "id", "g").collect()}
    assert [got[i].label for i in range(1, 6)] == ["A", "A", "A", "B", None] and got[3].moods == ["x", "y", "z"] and got[5].uncertain and got[4].tier == "single"
    b = spark.createDataFrame([(i, ["P"], lab, False) for i, lab in enumerate("FFFSS")] + [(9, ["Q", "P"], None, True), (8, ["R"], "F", False), (7, ["R"], None, True)], "id long, authors array<string>, label string, uncertain boolean")
    assert {(r.id, r.label) for r in classify.author_votes(b, "id").collect()} == {(9, "F")}
    m = spark.createDataFrame([(["x", "Tema: A"], ["Tema: B"])], "o array<string>, n array<string>")
    assert m.select(classify.merge_prefixed(F.col("o"), F.col("n"), ["Tema: "])).collect()[0][0] == ["x", "Tema: B"]
    t = spark.createDataFrame([(1, "a", "q"), (2, "b", "r")], "id long, f string, g string")
    ch = spark.createDataFrame([(1, "f", "new"), (2, "nope", "z")], "id long, field string, value string")
    assert sorted(map(tuple, classify.applied(t, ch, "id", ["f"]).collect())) == [(1, "new", "q"), (2, "b", "r")]


def test_training(spark):
    words = {"sea": "ship tide sail storm harbour", "love": "kiss heart letter bride rose", "crime": "knife clue police corpse alibi"}
    rows = [(i, " ".join(w.split()[(i + k) % 5] for k in range(3)) + f" common{i % 2}", c) for c, w in words.items() for i in range(45)]
    docs = spark.createDataFrame([(n, t, c) for n, (_, t, c) in enumerate(rows)], "id long, text string, label string")
    terms, classes = train.fit(docs.where("id % 5 > 0"), "id", "text", "label", min_df=2, max_share=0.6)
    p = classify.predict(docs.where("id % 5 = 0").select("id", "text"), "id", "text", terms, classes).select("id", F.col("label").alias("predicted"))
    e = {r.label: r for r in train.evaluation(docs.join(p, "id"), "label", "predicted").collect()}
    assert e["all"].recall >= 0.85 and e["all"].f1 >= 0.8
    with pytest.raises(ValueError):
        train.fit(docs.where("label = 'sea'"), "id", "text", "label")
    ex = spark.createDataFrame([(1, "Á", "x", "short", "L"), (2, "a", "X", "longer text", "L"), (3, "b", "y", "t", "L"), (4, "B", "y", "t", "M"), (5, None, None, None, " ")], "id long, title string, authors string, comments string, lib string")
    assert [(r.id, r.label, r.copies) for r in train.clean_examples(ex, "id", "title", "authors", "comments", "lib").collect()] == [(2, "L", 2)]


def test_ranking(spark):
    v = spark.createDataFrame([("b", t, n) for t, n in zip("pqrst", (100, 50, 40, 20, 8), strict=True)] + [("c", "x", 12)], "book_id string, shelf string, votes long")
    assert sorted((r.book_id, r.tag) for r in ranking.shelf_tags(v).collect()) == [("b", t) for t in "pqrs"] + [("c", "x")]
    n = spark.createDataFrame([("The 2nd Life: Part Two",), ("21st",), (None,)], "t string").select(F.array_sort(ranking.numbers(F.col("t")))).collect()
    assert [r[0] for r in n] == [["2"], ["21"], []]
    c = spark.createDataFrame(
        [(1, 0, 0, "k1", "w1", "Rise of a Queen", "Ann Lee", 99, "Rise of a Queen", ["Ann Lee"]), (1, 0, 1, "k2", "w1", "Rise of a Queen: Deluxe", "Ann Lee", 5, "Rise of a Queen", ["Ann Lee"]), (1, 1, 0, "k3", "w2", "Another Thing", "Bob", 5, "Rise of a Queen", ["Ann Lee"]),
         (1, 1, 1, "k4", "w3", "Rise of a Queen", "NOT A BOOK", 5, "Rise of a Queen", ["Ann Lee"]), (1, 1, 2, "k5", "w4", "Rise of a Queen 2", "Ann Lee", 0, "Rise of a Queen", ["Ann Lee"])],
        "query_id long, variant int, pos int, bookid string, workid string, title string, author string, ratings long, q_title string, q_authors array<string>",
    )
    s = {r.bookid: r.score for r in ranking.scored(c).collect()}
    assert s["k1"] == pytest.approx(10 + 6 + 4 + 2) and "k3" not in s and "k4" not in s
    g = ranking.gathered(ranking.scored(c))
    assert {r.bookid for r in g.collect()} == {"k1", "k2"}
    assert [(r.bookid, r.relevance) for r in ranking.editions(g).orderBy("relevance").collect()] == [("k1", 0), ("k2", 1)]
    q = spark.createDataFrame([("Fate - Wizardoms: Rise", ["A. Lee", "Bo"]), (None, None)], "t string, a array<string>").select(ranking.query_variants(F.col("t"), F.col("a"))).collect()
    assert q[0][0][:3] == ["Fate A Lee", "Rise A Lee", "Wizardoms A Lee"] and q[1][0] == []


def test_triage(spark):
    p = spark.createDataFrame([("Dune", ["Frank Herbert"], ["eng"], None, None, None), ("Dune", ["Frank Herbert"], ["eng"], "Dune", ["Herbert, Frank"], ["spa"]), ("Dune", ["F. Herbert"], ["und"], "Emma", ["Jane Austen"], ["eng"])], "old_title string, old_authors array<string>, old_languages array<string>, new_title string, new_authors array<string>, new_languages array<string>")
    t = ranking.triaged(p).collect()
    assert [r.safe for r in t] == [True, False, False] and t[1].author_sim == 1.0


def test_rescue(spark):
    assert rescue.parse_array('[{"n":1},{"n":2') == [{"n": 1}] and rescue.parse_array('```json\n[{"n":1,},]\n```') == [{"n": 1}] and rescue.parse_array(None) == []
    req = spark.createDataFrame([(f"k{i}", f"t{i}", "a", "s") for i in range(5)], "key string, title string, author string, synopsis string").coalesce(1)

    def service(items):
        if any(i["title"] == "t4" for i in items):
            raise RuntimeError("down")
        return '[{"n": 2, "libreria": "amor", "confianza": 0.345, "temas": ["MAR", "x"], "serie": "null"}]'

    got = {r.key: r for r in rescue.ask(req, service, ["Amor"], ["Mar"], batch=2).collect()}
    assert got["k1"].label == "Amor" and got["k1"].percent == 34 and got["k1"].themes == ["Mar"] and got["k1"].series == "" and got["k0"].label is None and got["k4"].error == "down"
    m = spark.createDataFrame([("k1", 1), ("k1", 2), ("k4", 3)], "group string, id long")
    assert {(r.id, r.status) for r in rescue.fanned_out(spark.createDataFrame(list(got.values())), m).collect()} == {(1, "(revisar)"), (2, "(revisar)"), (3, "error")}


def test_statistics(spark):
    b = spark.createDataFrame([("X", 1, "T", ["P"]), ("X", 2, "U", ["P", "Q"]), ("Y", 3, "t!", ["P"]), ("Y", 4, "V", ["P"]), ("Y", 5, "W", ["P"]), ("Z", 6, None, None)], "library string, book_id long, title string, authors array<string>")
    u = {r.book_id: r for r in stats.library_updates(b, stats.book_authors(b), "X").collect()}
    assert u[1].author_libraries == ["Y"] and u[1].author_total == 5 and u[1].duplicates == ["Y"] and u[2].duplicates == []
    text = {r.book_id: r.duplicates for r in stats.library_updates(b, stats.book_authors(b), "X", True).collect()}
    assert text == {1: "1: Y", 2: ""} and stats.library_updates(b, stats.book_authors(b), "Z").count() == 0


def test_very_long_titles_are_whole(spark):
    from quire.functions.titles import pair_title

    df = spark.range(1).selectExpr("concat('The ', repeat('w ', 100001), 'end') as t")
    assert df.select(pair_title(F.col("t")).alias("p")).where("p like '% end'").count() == 1
