"""Plain forms, term counts, encoding, packing and personal data."""

import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import encode, packing, personal_data, plain_form, term_counts
from quire.llm.queries import p4_found, p5_deltas, p5_found

@pytest.mark.parametrize(
    ("odd", "plain"),
    [
        ("Todο secretо es una casа gigаnte", "Todo secreto es una casa gigante"), ("Ｂｅｙｏｎｄ ｔｈｅ Map", "Beyond the Map"), ("Antologí͏a", "Antología"), ("Half‑way", "Half-way"), ("ﬂores", "flores"),
        ("Nivel B²", "Nivel B²"), ("½ №7 Mañana™", "½ №7 Mañana™"), ("русская проза", "русская проза"), ("ру᠎сская", "русская"), ("Дом у жёлтой реки", "Дом у жёлтой реки"), ("Género ⋅ Novela", "Género · Novela"),
        ("Parte Ⅱ", "Parte II"), ("Frontera у silеncio", "Frontera y silencio"), ("日本の小説", "日本の小説"), ("éxito", "éxito"), ("", ""), (None, None), ("a\xa0b　c", "a b c"), ("Жёлтые якоeя", "Жёлтые якоeя"),
    ],
)
def test_plain(odd, plain):
    assert plain_form.plain_form(odd) == plain
    assert plain_form.plain_form(plain) == plain


def test_trie_budget():
    t = plain_form.Trie([("mar", 5), ("mas", 9), ("cosecha", 1)])
    assert t.find("mаr") == "mar" and t.find("ma​r") == "mar" and t.find("max") is None
    assert t.find("max", 1) == "mas" and t.find("coseca", 1) == "cosecha" and t.find("cosechha", 1) == "cosecha" and t.find("zzz", 1) is None


def test_trie_and_table_differ():
    """Where a character looks like several letters, or a stroke is laid over one, the vocabulary decides; the table has one reading."""
    t = plain_form.Trie([("Illa", 1), ("lago", 3), ("smørbrød", 1), ("niñez", 1)])
    for odd, table, word in (("ӏlla", "llla", "Illa"), ("Іago", "Iago", "lago"), ("smo\u0338rbro\u0338d", "smo\u0338rbro\u0338d", "smørbrød")):
        assert plain_form.plain_form(odd) == table and plain_form.plain_form(odd, t.find) == word and t.best(odd)[0] < plain_form.EDIT
        assert plain_form.outline(odd) == plain_form.outline(word)
    assert plain_form.plain_form("nin\u0303\u200bez", t.find) == "niñez" and t.find("ninez") is None and t.find("ninez", 1) == "niñez"


@settings(max_examples=200, deadline=None)
@given(st.text("aIlouhnéñøł", min_size=1, max_size=8), st.integers(0, 10**9))
def test_disguised_words_are_found(word, seed):
    """Every disguise of a vocabulary word reaches it at no cost of an edit, and lies in its block."""
    r = random.Random(seed)
    looks = {}
    for c, like in plain_form.LOOKS.items():
        looks.setdefault(like, []).append(c)
    for c, also in plain_form.ALSO.items():
        for like in also:
            looks.setdefault(like, []).append(c)
    import unicodedata as u

    odd = "".join(r.choice([c, *looks.get(c, []), chr(0xFEE0 + ord(c)) if c.isascii() else c, c + "\u200b"]) for c in u.normalize("NFD", word) for c in [c])
    got = plain_form.Trie([(u.normalize("NFC", word), 1), ("zzz", 5)]).best(odd)
    assert got and got[2] == u.normalize("NFC", word) and plain_form.outline(odd) == plain_form.outline(word)


def vocabulary(spark, *words):
    return spark.createDataFrame([(w, 1) for w in words], "word string, n long")


def plain_of(spark, strings, *words, **how):
    df = spark.createDataFrame([(s,) for s in strings], "t string")
    return {r.string: r.plain for r in plain_form.plain_strings(df, vocabulary(spark, *words), **how).collect()}


def test_vocabulary_settles_lone_words(spark):
    assert plain_of(spark, ["coсo", "cоро", None, "", "plain", "соро", "мир"], "copo") == {"coсo": "coco", "cоро": "copo", "соро": "copo", "мир": "мир"}
    assert plain_of(spark, ["соро"]) == {"соро": "соро"}


def test_blocks_of_the_vocabulary_change_nothing(spark):
    words = spark.createDataFrame([("cоро",), ("mаrx",), ("cоро",)], "word string")
    known = vocabulary(spark, "copo", "mar", "marca", "sol", "copa")
    for size in (1, 2, 100):
        assert {tuple(r) for r in plain_form.canonical(words, known, trie_words=size).collect()} == {("cоро", "copo")}
        assert {tuple(r) for r in plain_form.canonical(words, known, 1, size).collect()} == {("cоро", "copo"), ("mаrx", "mar")}
    assert plain_form.canonical(words.limit(0), known).count() == 0


def test_odd_strings(spark):
    df = spark.createDataFrame([(1, "mаr", "x"), (1, "mаr", "y"), (2, "mar", "x"), (3, None, "x"), (4, "", "x"), (5, "а" * 100_000 + " b", "x")], "id long, t string, plain string")
    assert {tuple(r) for r in plain_form.odd_strings(df, "id", "t", vocabulary(spark)).collect()} == {(1, "mar"), (5, "a" * 100_000 + " b")}
    assert plain_form.odd_strings(df.limit(0), "id", "t", vocabulary(spark)).count() == 0
    w = spark.createDataFrame([("a b a",), ("b c",), ("b",), (None,), ("cоро",)], "t string")
    assert {tuple(r) for r in plain_form.word_vocabulary(w, "t").collect()} == {("a", 1), ("b", 3), ("c", 1)}


def test_rare_words_settle_lone_words_of_large_tables(spark, tmp_path):
    """A title of look-alikes only is read by a word of one other title, however many titles there are."""
    lone = [(1, "соро"), (2, "а\u200bсе 2"), (3, "хор"), (4, "Copo"), (5, "el copo y ace"), (6, None)]
    titles = spark.createDataFrame(lone, "book_id long, title string").union(spark.range(100, 20_200).selectExpr("id", "'nada'"))
    titles.write.parquet(f"{tmp_path}/current_books.parquet")
    spark.createDataFrame([], "row_id long, tags string").write.parquet(f"{tmp_path}/training_rows.parquet")
    spark.createDataFrame([], "canon string").write.parquet(f"{tmp_path}/tag_terms.parquet")
    assert {tuple(r) for r in p4_found(spark, str(tmp_path)).collect()} == {("title", 1, "copo"), ("title", 2, "ace 2")}


# --- term counts


def terms(df):
    return df.withColumn("_terms", F.transform(F.filter(F.split(F.coalesce("t", F.lit("")), " "), lambda x: x != ""), lambda x: F.struct(F.lit("f").alias("field"), x.alias("term"))))


def brute(rows):
    occ, rec = Counter(), Counter()
    for t in dict(rows).values():
        ws = [w for w in (t or "").split(" ") if w]
        occ.update(ws)
        rec.update(set(ws))
    return {w: (occ[w], rec[w]) for w in occ}


def test_incremental_equals_recount(spark, tmp_path):
    rnd = random.Random(7)
    store = term_counts.TermCounts(spark, "t", "k", terms, str(tmp_path / "s"))
    rows = {i: " ".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(6))) for i in range(60)}
    for step in range(3):
        snapshot = spark.createDataFrame([(k, t) for k, t in rows.items()] * 2, "k long, t string")
        got = {r.term: (r.occurrences, r.records) for r in store.update(snapshot).collect()}
        assert got == brute(list(rows.items())), step
        for k in list(rows):
            if (p := rnd.random()) < 0.2:
                del rows[k]
            elif p < 0.4:
                rows[k] = " ".join(rnd.choice("abcxyz") for _ in range(3))
        rows |= {100 * (step + 1) + i: "new " * i for i in range(4)}
    assert store.update(spark.createDataFrame([], "k long, t string")).count() == 0


def test_only_changes_are_counted(spark):
    def hashed(rows):
        df = spark.createDataFrame(rows, "k long, t string, u string")
        return df.select(F.col("k").alias("key"), F.lit(0).alias("bucket"), term_counts.content_hash(df, "k").alias("hash"))

    old = hashed([(1, "a", None), (2, "b", None), (3, None, "x"), (None, "n", None), (5, None, "x")])
    new = hashed([(1, "a", None), (2, "c", None), (4, "d", None), (None, "n", None), (5, "x", None)])
    assert {tuple(r) for r in term_counts.changed_keys(old, new).collect()} == {(2, 0, True, True), (3, 0, True, False), (4, 0, False, True), (5, 0, True, True)}


def test_a_merge_touches_few_buckets(spark, tmp_path):
    """Only buckets of changed records and terms are written again; a store is opened again, and removed."""
    root = f"{tmp_path}/s"
    store = term_counts.TermCounts(spark, "t", "k", terms, root)
    rows = {i: f"w{i} all" for i in range(200)}
    store.update(spark.createDataFrame(list(rows.items()), "k long, t string"))
    rows[7] = "w7 none"
    again = term_counts.TermCounts(spark, "t", "k", terms, root, version=1)
    got = {r.term: (r.occurrences, r.records) for r in again.update(spark.createDataFrame(list(rows.items()), "k long, t string")).collect()}
    assert got == brute(list(rows.items()))
    assert sum(v == 2 for v in again.at["records"].values()) == 1 and 1 <= sum(v == 2 for v in again.at["counts"].values()) <= 2
    before = dict(again.at["records"])
    again.update(spark.createDataFrame(list(rows.items()), "k long, t string"))
    assert again.at["records"] == before and 3 not in again.at["counts"].values()  # nothing changed, nothing written
    again.remove()
    assert not (tmp_path / "s").exists()


def test_long_records(spark):
    """A record's terms are folded in the time of sorting them; no record is cut."""
    changes = spark.createDataFrame([("x " * 200_000 + " ".join(map(str, range(50_000))), 1), (None, -1), ("", 1)], "t string, sign int")
    got = {r.term: (r.occurrences, r.records) for r in term_counts.delta_counts(terms(changes), F.col("_terms")).collect()}
    assert len(got) == 50_001 and got["x"] == (200_000, 1) and got["49999"] == (1, 1)


def test_snapshots_and_deltas_agree(spark):
    """Additions alone, and changes with deletions, end in the same counts as one recount."""
    d = "/root/testdata/sf0.001"
    want = {tuple(r) for r in p5_found(spark, d).collect()}
    assert want and want == {tuple(r) for r in p5_deltas(spark, d).collect()}


def test_marks(spark):
    c = spark.createDataFrame([("f", "a", 2, 2), ("f", "b", 3, 1), ("f", "c", 9, 3)], "field string, term string, occurrences long, records long")
    assert {tuple(r) for r in term_counts.marks(c, 10).collect()} == {("f", "a", "rare"), ("f", "c", "common")}


def test_tags_are_counted_one_by_one(spark, tmp_path):
    """A quoted tag may hold a line break, and the script of a tag does not depend on the tags beside it."""
    rows = [(1, '"dos\nlineas",mar', None), (2, "хор,mar", None), (3, None, None), (4, "mаr", "")]
    spark.createDataFrame([(*r, None) for r in rows], "row_id long, tags string, comments string, exported_at timestamp").write.parquet(f"{tmp_path}/training_rows.parquet")
    spark.createDataFrame([], "canon string").write.parquet(f"{tmp_path}/tag_terms.parquet")
    got = {r.term for r in p5_found(spark, str(tmp_path)).collect()}
    assert got == {"dos\nlineas", "mar", "хор"}


# --- encoding


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encode.BYTE_BPE)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return encode.Encoder(*encode.read_vocabulary())


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(max_size=60) | st.text("abcdeinorst '\n\t1é", max_size=60))
def test_encoding_is_exact(encoder, reference, s):
    assert encoder.encode(s) == reference(s)


def test_encoding_cases(spark, encoder, reference):
    texts = ["", None, "<|endoftext|>", "a" * 5_000, "日本の小説 " * 50, "x\r\n\r\n  y", "🌧️", " " * 300, "Ñandú"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in encode.token_ids(df, F.col("text")).collect()}
    assert got == {i: reference(t or "") for i, t in enumerate(texts)}
    n = {r.doc_id: r.tokens for r in encode.token_counts(df, F.col("text")).collect()}
    assert n == {i: len(v) for i, v in got.items()}
    assert encode.token_ids(df.limit(0), F.col("text")).count() == 0


def test_encoding_of_documents(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert all(r.ids == reference(r.text or "") for r in encode.token_ids(docs, F.col("text")).collect())


# --- packing


def check(sizes, parts, capacity):
    load = Counter()
    for s, ps in zip(sizes, parts, strict=True):
        assert sum(p[2] for p in ps) == max(s, 0) and (s > capacity or len(ps) == 1)
        for b, _, n in ps:
            load[b] += n
    assert max(load.values(), default=0) <= capacity
    return len(load)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=60), st.integers(1, 20))
def test_packing_is_valid(sizes, capacity):
    check(sizes, packing.pack(sizes, capacity), capacity)


def test_packing_is_tight():
    r = random.Random(3)
    for lo, hi, most in ((0, 600, 1.01), (300, 2048, 1.06), (1, 2048, 1.03)):
        sizes = [r.randint(lo, hi) for _ in range(5_000)]
        assert check(sizes, packing.pack(sizes, 2048), 2048) <= most * sum(sizes) / 2048 + 2
    assert len({p[0][0] for p in packing.pack([6, 4, 5, 5, 7, 3], 10)}) == 3
    with pytest.raises(ValueError):
        packing.pack([1], 0)


def test_containers(spark):
    rows = [(i, (i * 37) % 900) for i in range(500)] + [(7, 7 * 37), (1000, None), (None, 5), (2000, 5000)]
    df = spark.createDataFrame([(k, s, "c") for k, s in rows], "doc_id long, tokens long, container string")
    out = packing.fill_containers(df, "doc_id", "tokens", 2048, shard_rows=100).collect()
    load, got = Counter(), Counter()
    for r in out:
        load[r.container] += r.length
        got[r.doc_id] += r.length
    assert max(load.values()) <= 2048 and got == Counter({k: s or 0 for k, s in rows}) | got and got[2000] == 5000 and got[None] == 5 and got[1000] == 0
    assert packing.fill_containers(df.limit(0), "doc_id", "tokens", 10).count() == 0


# --- personal data

TEXT = "Titular: Ana Ruiz Pardo; DNI 99251564-D; +34 555 315 498. Duplicado 190-38; ISBN 978-84-99264-58-1. Vivo en C/ de la Noria nº 151, bajo C, 82029 Demodaburgo.\nEscríbanme a ana.ruiz (at) buzon (dot) test o a X@MAIL.INVALID. —No —dijo Luis Paz—. Pedido n.º 1931-24966, 964.394 libros, 4/7/2011."


def test_structured_items():
    got = [(k, TEXT[a:b]) for a, b, k in personal_data.structured(TEXT)]
    assert got == [("id", "99251564-D"), ("phone", "+34 555 315 498"), ("address", "C/ de la Noria nº 151, bajo C, 82029 Demodaburgo"), ("email", "ana.ruiz (at) buzon (dot) test"), ("email", "X@MAIL.INVALID")]
    for t, kind in (("+44 (0)7700 900299", "phone"), ("1-822-555-0182", "phone"), ("555466386", "phone"), ("(914) 555-0101", "phone"), ("01 99 00 36 19", "phone"), ("07700 900269", "phone"), ("555 68 77 99", "phone"),
                    ("QQ 70 68 86 C", "id"), ("Z-9063340-B", "id"), ("666-14-7880", "id"), ("99.457.681-T", "id"), ("114 Bellfounder St, Prapímatur 00006", "address"), ("33 rue des Trois Clés", "address"), ("195 Bellfounder St #12, Jigrosazan 00002", "address")):
        assert personal_data.structured(f"x: {t}; y") == [(3, 3 + len(t), kind)], t
    for t in ("978-84-99264-58-1", "1931-24966", "964.394 libros", "2015-2016", "N-589-58", "0x644f3c", "la calle principal tenía 36 faroles", "EPUB (60 KB)", "pp. 56-582"):
        assert personal_data.structured(f"{t} y") == [], t


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "note", "es") for i, t in enumerate(texts)], "doc_id long, text string, kind string, lang string")


def corpus():
    """Letters that name a reader beside numbers, some only beside other things, and stories about people."""
    word = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    phone = lambda i: f"555 68 {i // 100:02d} {i % 100:02d}"
    texts = [f"Titular: Eva Sol{word(i)}; DNI 9925{i:04d}D. Llamen al {phone(i)}." for i in range(60)]
    texts += [f"prestado a Ana Mar{word(i)}. {'Tel. ' + phone(i + 60) if i % 3 else 'Nada'}." for i in range(60)]
    texts += [f"El mar y Luis Paz{word(i)} calló. {'Tel. ' + phone(i + 120) if i % 6 == 0 else 'Nada'}." for i in range(300)]
    return texts


def test_items_and_text(spark):
    more = [TEXT, None, "", "La sombra y Luis Paz calló.", "prestado a Sol, Eva. prestado a Eva. Vino Eva.", "prestado a Ana Sol Mar de la Paz Pardo Ruiz Rey. Y Ana Sol Mar de la Paz Pardo Ruiz Rey."]
    d = docs_of(spark, more + corpus())
    d = d.union(d)
    got = {(r.doc_id, r.pii_kind, r.found) for r in personal_data.personal_items(d, "doc_id", "text", ["kind", "lang"]).where("doc_id < 6").collect()}
    assert {x for x in got if x[1] == "person"} == {(0, "person", "Ana Ruiz Pardo"), (4, "person", "Sol, Eva"), (4, "person", "Eva"), (5, "person", "Ana Sol Mar de la Paz Pardo Ruiz Rey")}
    kinds = spark.createDataFrame([("person", "[P]"), ("email", "[E]"), ("phone", "[T]"), ("id", "[I]"), ("address", "[A]")], "pii_kind string, placeholder string")
    t = {r.doc_id: r.text for r in personal_data.sanitise(d, "doc_id", "text", ["kind", "lang"], kinds).where("doc_id < 6").collect()}
    assert t[0].startswith("Titular: [P]; DNI [I]; [T]. Duplicado 190-38;") and "Vivo en [A].\nEscríbanme a [E] o a [E]." in t[0] and "Luis Paz" in t[0]
    assert t[1] is None and t[2] == "" and t[3] == "La sombra y Luis Paz calló." and t[4] == "prestado a [P]. prestado a [P]. Vino [P]." and t[5] == "prestado a [P]. Y [P]."
    assert personal_data.personal_items(d.limit(0), "doc_id", "text", ["kind", "lang"]).count() == 0


def people(df, copies=1, **kw):
    df = df.crossJoin(df.sparkSession.range(copies).withColumnRenamed("id", "copy")).selectExpr("doc_id * 1000 + copy as doc_id", "text", "kind", "lang")
    rows = personal_data.personal_items(df, "doc_id", "text", ["kind", "lang"], **kw).where("pii_kind = 'person'").collect()
    return Counter(r.found for r in rows)


def test_corpus_reveals_terms(spark):
    """No list tells that Titular and prestado a stand at readers and a verb at characters; the corpus does, at any size."""
    one = people(docs_of(spark, corpus()))
    assert len(one) == 120 and {k[:3] for k in one} == {"Eva", "Ana"} and set(one.values()) == {1}
    assert people(docs_of(spark, corpus()), 10) == {k: 10 for k in one}
    alone = [t.replace("Tel. ", "n.º ").replace("555 68 ", "1.") for t in corpus() if not t.startswith("Titular")]
    assert not people(docs_of(spark, alone))  # nothing protected, nothing disclosed


def test_a_second_round_carries_evidence(spark):
    """A term beside disclosed names, but not beside numbers, discloses in the second round only."""
    word = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    texts = corpus() + [f"Titular: Ana Rey{word(i)}; vista por Eva Mur{word(i)}." for i in range(30)]
    names_of = lambda r: {x for x in people(docs_of(spark, texts), rounds=r) if " Mur" in x}
    assert not names_of(1) and len(names_of(2)) == 30


def test_terms_are_whole():
    """Words of any length beside a name are terms, not their ends."""
    w = "x" * 500
    (_, _, terms, _), = personal_data.names(f"{w} {w} Eva Sol {w} {w}", [])
    assert terms == [f"l:{w}", f"l2:{w} {w}", f"r:{w}{w}"]
    many = "Eva Sol y " * 20_000
    assert len(personal_data.names(many, [])) == 20_000


def test_names_where_most_documents_hold_an_item(spark):
    """Where two thirds of the documents hold an item anyway, a term whose documents hold one far more often discloses."""
    word = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    phone = lambda i: f" 555 68 {i // 100:02d} {i % 100:02d}"
    texts = [f"Un saludo, Ana Mar{word(i)}." + (phone(i) if i % 10 else "") for i in range(400)]
    texts += [f"nada {i}" + (phone(i + 400) if i % 10 < 5 else "") for i in range(600)]
    assert len(people(docs_of(spark, texts))) == 400


def test_names_of_the_documents(spark):
    """Held against the list of signs that an earlier version used: 1,894 names on sf0.1, of which 0.9 must be found without it."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = personal_data.personal_items(docs, "doc_id", "text", ["kind", "lang"]).where("pii_kind = 'person'").select("doc_id", "found").distinct()
    assert found.count() >= 0.9 * 1_894


def test_disclosure_matches_plain_count(spark):
    """The Spark result equals the same counts made in plain Python."""
    import math

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = []
    for r in docs.select("text", "kind", "lang").distinct().collect():
        items = personal_data.structured(r.text) if r.text else []
        found.append((f"{r.kind or ''}{'/'}{r.lang or ''}", len(items), personal_data.names(r.text, items) if r.text else []))
    all_in, with_in = Counter(g for g, *_ in found), Counter(g for g, n, _ in found if n)
    n_docs, seen, due = Counter(), Counter(), Counter()
    for g, n, spans in found:
        for t in {t for *_, ts, lone in spans if not lone for t in ts}:
            n_docs[t] += 1
            seen[t] += n - ("[" in t) > 0
            due[t] += with_in[g] / all_in[g]
    rows = personal_data.spans(docs.dropDuplicates(["doc_id"]), "doc_id", "text", ["kind", "lang"]).withColumn("own", F.lit(None).cast("array<int>"))
    got = {r.term: r for r in personal_data.disclosure(rows).collect()}
    for t, n in n_docs.items():
        p, q = due[t] / n, (seen[t] + due[t] / n) / (n + 1)
        if 0 < p < q - 1e-9 and q < 1:
            bits = seen[t] * math.log2(q / p) + (n - seen[t]) * math.log2((1 - q) / (1 - p))
            assert (got[t].docs, got[t].seen) == (n, seen[t]) and abs(got[t].bits - bits) < 1e-6 and abs(got[t].gain - (q - p) / (1 - p)) < 1e-6, t
    assert set(got) <= set(n_docs)
