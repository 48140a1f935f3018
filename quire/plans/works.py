"""Queries on titles' series, tags, pairs, comparison, classification, ranking, shelves and triage, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.fuzzy import languages_conflict, length_penalty
from quire.functions.hashing import book_fingerprints, hamming, simhash64
from quire.functions.text import classifier_text, words
from quire.operators import classify as K
from quire.operators import compare as X
from quire.operators import identifiers as I
from quire.operators import pairs as P
from quire.operators import ranking as R
from quire.operators import rescue as Q
from quire.operators import series as S
from quire.operators import tags as G
from quire.operators import train as N
from quire.operators.packed_values import split_packed
from quire.plans.catalogue import BLANK, books, sql_pair_title
from quire.plans.queries import query
from quire.session import cut, load

# --- titles


@query("title_languages", r"SELECT DISTINCT book_id, lower(coalesce(nullif(regexp_extract(title, '(?i)\(([a-z]{2,3})\)\s*$', 1), ''), nullif(regexp_extract(title, '(?i)^\s*\(([a-z]{2,3})\)\s+', 1), ''))) AS code FROM current_books")
def title_languages(spark, d):  # PR03
    return books(spark, d).select("book_id", S.title_language(F.col("title")).alias("code")).distinct()


@query("series_proposals")
def series_proposals(spark, d):  # PR01, PR02, PR07, FL03, FL13, PL06
    return S.series_proposals(books(spark, d))


@query("subtitle_proposals")
def subtitle_proposals(spark, d):  # PR04, FL14, PL07
    return S.subtitle_proposals(books(spark, d))


@query("legacy_titles")
def legacy_titles(spark, d):  # PR05, PR06, PL10
    b = books(spark, d).where("title is not null").select("book_id", "title", "series", F.try_element_at("languages", F.lit(1)).alias("lang")).distinct()
    return b.select("book_id", S.legacy_clean(F.col("title"), F.col("series"), F.col("lang")).alias("clean"))


# --- identifiers and tags


@query("identifiers_fixed")
def identifiers_fixed(spark, d):  # PR09, PR10, FL10, PL04; the candidates' ids in the shapes the rules know
    k = load(spark, d, "candidates").select("bookid", "workid", "ratingscount").distinct()
    n = F.lpad(F.regexp_replace("bookid", "[^0-9]", ""), 10, "0")
    pair = lambda a, b: F.struct(a.alias("k"), b.alias("v"))
    shapes = F.array(
        pair(F.concat(F.lit("isbn"), n), F.concat(F.lit("ISBN"), n)), pair(F.lit("asin"), F.concat(F.lit("B"), F.substring(n, 2, 9))),
        pair(F.lit("amazon_es"), F.lit("short")), pair(F.lit("isbn-13"), n), pair(n, n), pair(F.lit("source"), F.coalesce("workid", F.lit("")))
    )
    count = F.coalesce("ratingscount", F.lit(0))
    one = k.groupBy("bookid").agg(F.max(F.struct(count.alias("c"), shapes.alias("s"))).alias("r"))
    return I.fixed_identifiers(one.select("bookid", F.slice("r.s", (F.col("r.c") % 5 + 1).cast("int"), F.lit(3)).alias("ids")), "ids", "bookid")


#: A small rule set of our own in the shape of a tag map.
TAG_RULES = (
    ("Tema · Venganza", "venganza"), ("Tema · Amistad", "amistad"), ("Tema · Viajes en el tiempo", r"viajes? en el tiempo|clock-?walkers|clock walkers"), ("Genero · Fantasia", "fantasia|fantasy"),
    ("Genero · Misterio", "mystery|misterio|sealed room"), ("Genero · Romance", "romance"), ("Genero · Ciencia ficcion", "science fiction"), ("Tema · Magia", r"\bmagi[ac]\b"),
)
TAG_DROP = ("pendiente", "prestado", "ebook", "sin portada", "regalo")


def _tags(spark, d):
    rows = load(spark, d, "training_rows").select("row_id", "tags").dropDuplicates(["row_id"])
    return split_packed(rows, "tags", ["row_id"], "pos", "tag")


@query("tags_classified")
def tags_classified(spark, d):  # PR11, PR13, SC06
    return G.classified(_tags(spark, d), "tag", TAG_RULES, TAG_DROP, ("^leido ",)).groupBy("action", "value").agg(F.count("*").alias("n"))


@query("tags_cleaned")
def tags_cleaned(spark, d):  # PR12, PL09, WN09, ST04
    return G.cleaned(_tags(spark, d), "row_id", "tag", TAG_RULES, TAG_DROP, ("^leido ",))


@query("shelf_tag_union", "SELECT book_id, list_sort(list(DISTINCT lower(shelf))) AS tags FROM shelves WHERE shelf IS NOT NULL AND lower(shelf) <> 'to-read' GROUP BY book_id")
def shelf_tag_union(spark, d):  # ST03
    g = load(spark, d, "shelves").where("shelf is not null").groupBy("book_id").agg(F.sort_array(F.collect_list("shelf")).alias("s"))
    m = g.select("book_id", F.array_sort(F.transform(G.merged(F.col("s"), blocked=("to-read",)), F.lower)).alias("tags"))
    return m.where(F.size("tags") > 0)


# --- pairs and comparison

_COMPARABLE = f"SELECT book_id, coalesce(languages[1], '') AS lang, {sql_pair_title('title')} AS norm_title FROM (SELECT DISTINCT book_id, title, languages FROM current_books)"


@query("pair_candidates", f"WITH c AS ({_COMPARABLE}), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY encode(norm_title), book_id) AS rn FROM c) SELECT x.lang, x.book_id AS a, y.book_id AS b FROM r x JOIN r y ON x.lang = y.lang AND y.rn > x.rn AND y.rn <= x.rn + 40")
def pair_candidates(spark, d):  # JN07, WN01
    return P.neighbour_pairs(P.comparable(books(spark, d)), "book_id", "lang", ["norm_title", "book_id"], [])


@query("near_duplicates")
def near_duplicates(spark, d):  # JN07, PR18, ST05, SC02, SC11, PL16
    return P.near_duplicates(books(spark, d))


@query("identical_texts", "SELECT octet_length(encode(text)) AS size, sha1(text) AS sha1, count(*) AS n, min(doc_id) AS first FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL) GROUP BY ALL HAVING count(*) > 1")
def identical_texts(spark, d):  # AG24
    docs = load(spark, d, "documents").where("text is not null").select("doc_id", "text").dropDuplicates(["doc_id"])
    return P.identical_files(docs.select("doc_id", F.octet_length("text").cast("bigint").alias("size"), F.encode("text", "UTF-8").alias("c")), "doc_id", "size", "c")


_LINES = "SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS text FROM (SELECT DISTINCT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)"


def _lines(spark, d):
    docs = load(spark, d, "documents").where("text is not null").select("doc_id", "text").dropDuplicates(["doc_id"])
    return docs.select(F.col("doc_id").alias("book"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))


@query("book_fingerprints", f"WITH c AS ({_LINES}) SELECT doc_id AS book, md5(array_to_string(list_sort(list(md5(text))), '|')) AS fingerprint FROM c GROUP BY doc_id")
def fingerprints(spark, d):  # AG10, SC10, JN09
    return book_fingerprints(_lines(spark, d), "book", "text")


def _pairs(spark, d):
    """Each document with its neighbour by number: a pair table of half as many rows."""
    ids = load(spark, d, "documents").where("text is not null").select("doc_id").distinct().withColumn("pair", F.floor(F.col("doc_id") / 2))
    return ids.groupBy("pair").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")


@query("length_penalties", f"""WITH t AS (SELECT DISTINCT doc_id, len(list_filter(string_split_regex(text, '[{BLANK}]+'), lambda w: w <> '')) AS n FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id // 2 AS pair, min(doc_id) AS a, max(doc_id) AS b FROM t GROUP BY ALL HAVING min(doc_id) < max(doc_id))
SELECT p.pair, round_even(CASE WHEN x.n > 0 AND y.n > 0 THEN sqrt(2 * (least(x.n, y.n) / greatest(x.n, y.n)) / (least(x.n, y.n) / greatest(x.n, y.n) + 1)) ELSE 0 END, 6) AS penalty FROM p JOIN t x ON x.doc_id = a JOIN t y ON y.doc_id = b""")
def length_penalties(spark, d):  # PR22, AG11
    n = load(spark, d, "documents").where("text is not null").select("doc_id", F.size(words(F.col("text"))).alias("n")).distinct()
    p = _pairs(spark, d).join(n.select(F.col("doc_id").alias("a"), F.col("n").alias("x")), "a").join(n.select(F.col("doc_id").alias("b"), F.col("n").alias("y")), "b")
    return p.select("pair", F.bround(length_penalty(F.col("x"), F.col("y")), 6).alias("penalty"))


@query("simhash_distances")
def simhash_distances(spark, d):  # PR19, PR20 (blake2b: no SQL)
    s = load(spark, d, "documents").where("text is not null").select("doc_id", "text").dropDuplicates(["doc_id"]).select("doc_id", simhash64(F.col("text")).alias("s"))
    p = _pairs(spark, d).join(s.select(F.col("doc_id").alias("a"), F.col("s").alias("x")), "a").join(s.select(F.col("doc_id").alias("b"), F.col("s").alias("y")), "b")
    return p.select("pair", hamming(F.col("x"), F.col("y")).alias("distance"))


@query("book_comparisons")
def book_comparisons(spark, d):  # JN08, JN10, AG11-AG13, PR21-PR25, PR49, FL05, PL15
    return X.compared(_pairs(spark, d), _lines(spark, d))


_TERMS = f"""WITH dd AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id // 2 AS pair, doc_id FROM dd),
both_ AS (SELECT pair FROM p GROUP BY pair HAVING count(*) = 2), w AS (SELECT pair, doc_id, unnest(list_filter(string_split_regex(text, '[{BLANK}]+'), lambda x: x <> '')) AS term FROM dd JOIN p USING (doc_id) JOIN both_ USING (pair)),
c0 AS (SELECT pair, doc_id, term, count(*) AS c FROM w GROUP BY ALL), c AS (SELECT *, sum(c) OVER (PARTITION BY pair, doc_id) AS n FROM c0), f AS (SELECT pair, term, count(*) AS df FROM c GROUP BY ALL),
v AS (SELECT c.pair, doc_id, c.term, c / n * (ln(3.0 / (df + 1)) + 1) AS w FROM c JOIN f ON c.pair = f.pair AND c.term = f.term), m AS (SELECT pair, doc_id, sqrt(sum(w * w)) AS norm FROM v GROUP BY ALL)
SELECT a.pair, round_even(sum(a.w * b.w) / max(x.norm) / max(y.norm), 6) AS cosine FROM v a JOIN v b ON a.pair = b.pair AND a.term = b.term AND a.doc_id < b.doc_id
JOIN m x ON x.pair = a.pair AND x.doc_id = a.doc_id JOIN m y ON y.pair = b.pair AND y.doc_id = b.doc_id GROUP BY a.pair"""


@query("tfidf_cosines", _TERMS)
def tfidf_cosines(spark, d):  # AG12, PR23
    docs = load(spark, d, "documents").where("text is not null").select("doc_id", "text").dropDuplicates(["doc_id"])
    ch = docs.select(F.col("doc_id").alias("book"), F.lit(0).alias("pos"), "text", F.size(words(F.col("text"))).alias("n"))
    p = _pairs(spark, d)
    cells = p.select("pair", F.lit(0).alias("pos_a"), F.lit(0).alias("pos_b"))
    return X.tfidf_cosines(cells, ch, p).select("pair", F.bround("cosine", 6).alias("cosine"))


@query("marked_copies")
def marked_copies(spark, d):  # AG14, ST07, SRC12
    one = books(spark, d).where("title is not null").select(F.col("book_id").alias("book"), "title", "authors", F.when(F.col("pubyear") % 2 == 0, "EPUB").otherwise("AZW3").alias("format"), F.length("title").cast("long").alias("size")).dropDuplicates(["book"])
    pairs = near_duplicates(spark, d).where("title_sim >= 1").select("a", "b", F.lit(100.0).alias("similarity"))
    return X.marked_copies(pairs, one)


# --- classification: a model whose terms are computed, so that SQL can state it

_K = 9
_NGRAM_SQL = "list_concat(w, list_transform(list_zip(w[:-2], w[2:]), lambda p: p[1] || ' ' || p[2]))"
_DOCS = "SELECT row_id, list_filter(string_split(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM (SELECT DISTINCT row_id, title FROM training_rows WHERE title IS NOT NULL)"


def _model(spark, d):
    """(docs, terms, classes): titles as texts, every n-gram of them with a coefficient made of its MD5."""
    rows = load(spark, d, "training_rows").where("title is not null").select("row_id", F.trim(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " ")).alias("text")).distinct()
    df = rows.select(F.explode(F.array_distinct(K.ngrams(F.col("text")))).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("df")).where("df >= 2")
    coef = F.transform(F.sequence(F.lit(0), F.lit(_K - 1)), lambda k: (F.conv(F.substring(F.md5("ngram"), k + 1, F.lit(2)), 16, 10).cast("double") - 127.5) / 64)
    return rows, df.select("ngram", (1 + 1 / F.col("df")).alias("idf"), coef.alias("coef")), load(spark, d, "model_classes")


_PREDICT = f"""WITH dd AS ({_DOCS}), g AS (SELECT row_id, unnest({_NGRAM_SQL}) AS ngram FROM dd), c AS (SELECT row_id, ngram, count(*) AS c FROM g GROUP BY ALL),
f AS (SELECT ngram, 1 + 1 / count(DISTINCT row_id) AS idf FROM g GROUP BY ngram HAVING count(DISTINCT row_id) >= 2), x AS (SELECT row_id, ngram, (1 + ln(c)) * idf AS x FROM c JOIN f USING (ngram)),
w AS (SELECT row_id, ngram, x / sqrt(sum(x * x) OVER (PARTITION BY row_id)) AS w FROM x),
s AS (SELECT row_id, k, class_name, max(intercept) + sum(w * ((('0x' || substr(md5(ngram), CAST(k AS INT) + 1, 2))::INT) - 127.5) / 64) AS score FROM w CROSS JOIN model_classes GROUP BY ALL),
b AS (SELECT row_id, arg_max(class_name, (score, -k)) AS label, max(score) AS top FROM s GROUP BY row_id), z AS (SELECT row_id, sum(exp(score - top)) AS z FROM s JOIN b USING (row_id) GROUP BY row_id)
SELECT dd.row_id, label, round_even(coalesce(1 / z, 0), 6) AS confidence, label IS NULL OR round_even(1 / z, 6) < 0.55 AS uncertain FROM dd LEFT JOIN b USING (row_id) LEFT JOIN z USING (row_id)"""


def _predictions(spark, d):
    docs, terms, classes = _model(spark, d)
    p = K.predict(docs, "row_id", "text", terms, classes)
    return p.withColumn("confidence", F.bround("confidence", 6)).withColumn("uncertain", F.col("label").isNull() | (F.col("confidence") < K.THRESHOLD))


@query("classifier_predictions", _PREDICT)
def classifier_predictions(spark, d):  # PR26, PR28, JN14, WN10
    return _predictions(spark, d)


MOODS = (("Tono: Mar", r"\b(?:mar|marea|faro|puerto|shore|tide|harbour)\b"), ("Tono: Noche", r"\b(?:noche|sombra|night|shadow)\b"), ("Tono: Fuego", r"\b(?:fuego|hoguera|ceniza|bonfire|ash)\b"))
_MOOD_SQL = ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{n}' END" for n, p in MOODS)


@query("mood_tags", f"SELECT row_id, list_filter([{_MOOD_SQL}], lambda x: x IS NOT NULL) AS moods FROM (SELECT DISTINCT row_id, regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g') AS t FROM training_rows WHERE title IS NOT NULL)")
def mood_tags(spark, d):  # PR27, PR13, PL24
    rows = load(spark, d, "training_rows").where("title is not null").select("row_id", F.regexp_replace(F.lower("title"), "[^a-z0-9]+", " ").alias("t")).distinct()
    return rows.select("row_id", K.moods(F.col("t"), MOODS).alias("moods"))


def _grouped(spark, d):
    one = load(spark, d, "training_rows").select("row_id", "source_file", "title").dropDuplicates(["row_id"])
    p = _predictions(spark, d).join(one.select("row_id", F.col("source_file").alias("series")), "row_id").join(mood_tags(spark, d), "row_id")
    return p.withColumn("pos", F.col("row_id"))


@query("group_consensus", f"WITH pr AS ({_PREDICT}), r AS (SELECT DISTINCT row_id, source_file AS g FROM training_rows), v AS (SELECT g, label, round(sum(confidence), 9) AS votes, min(row_id) AS first FROM pr JOIN r USING (row_id) WHERE NOT uncertain AND g IS NOT NULL GROUP BY ALL), w AS (SELECT g, arg_max(label, (votes, -first)) AS winner FROM v GROUP BY g) SELECT row_id, coalesce(winner, label) AS label, CASE WHEN winner IS NULL THEN 'single' ELSE 'group' END AS tier FROM pr JOIN r USING (row_id) LEFT JOIN w USING (g)")
def group_consensus(spark, d):  # AG15, ST06, PR31, WN08
    return K.consensus(_grouped(spark, d), "row_id", "series").select("row_id", "label", "tier")


@query("author_votes", f"WITH pr AS ({_PREDICT}), a AS (SELECT DISTINCT row_id, authors AS author FROM training_rows WHERE authors IS NOT NULL), n AS (SELECT author, label, count(*) AS n FROM pr JOIN a USING (row_id) WHERE NOT uncertain GROUP BY ALL), t AS (SELECT author, sum(n) AS total, arg_max(label, (n, label)) AS vote, max(n) AS top FROM n GROUP BY author) SELECT row_id, vote AS label FROM pr JOIN a USING (row_id) JOIN t USING (author) WHERE uncertain AND total >= 3 AND top / total >= 0.6")
def author_votes(spark, d):  # AG16
    a = load(spark, d, "training_rows").where("authors is not null").select("row_id", F.array("authors").alias("authors")).dropDuplicates(["row_id"])
    return K.author_votes(_predictions(spark, d).join(a, "row_id"), "row_id")


@query("merged_values", "SELECT DISTINCT row_id, list_concat(CASE WHEN libreria IS NULL OR starts_with(libreria, 'A') THEN [] ELSE [libreria] END, CASE WHEN libreria = 'Tema: B' THEN [] ELSE ['Tema: B'] END) AS merged FROM training_rows")
def merged_values(spark, d):  # PR29, SNK03
    r = load(spark, d, "training_rows").select("row_id", "libreria").distinct()
    return r.select("row_id", K.merge_prefixed(F.when(F.col("libreria").isNotNull(), F.array("libreria")), F.array(F.lit("Tema: B")), ["A"]).alias("merged"))


@query("stored_labels", "SELECT row_id, trim(replace(replace(libreria, '[REVISAR]', ''), '(sin datos)', '')) AS label, contains(libreria, '[REVISAR]') OR ends_with(libreria, '(sin datos)') AS uncertain FROM (SELECT DISTINCT row_id, libreria FROM training_rows)")
def stored_labels(spark, d):  # PR30, FL01
    label, unsure = K.stored_label(F.col("libreria"))
    return load(spark, d, "training_rows").select("row_id", "libreria").distinct().select("row_id", label.alias("label"), unsure.alias("uncertain"))


@query("classification_changes")
def classification_changes(spark, d):  # PL02, SNK01
    return K.changes(K.consensus(_grouped(spark, d), "row_id", "series"), "row_id")


@query("clean_examples")
def clean_examples(spark, d):  # AG19, SC12
    rows = load(spark, d, "training_rows").dropDuplicates(["row_id"])
    return N.clean_examples(rows, "row_id", "title", "authors", "comments", "libreria")


@query("label_counts", "SELECT label, count(*) AS n, count(*) < 20 AS few FROM (SELECT DISTINCT row_id, trim(libreria) AS label FROM training_rows) WHERE label <> '' GROUP BY label")
def label_counts(spark, d):  # AG20
    rows = load(spark, d, "training_rows").select("row_id", F.trim("libreria").alias("label")).distinct().where("label <> ''")
    return N.label_counts(rows)


@query("training_vocabulary", f"WITH dd AS ({_DOCS}), g AS (SELECT DISTINCT row_id, unnest({_NGRAM_SQL}) AS ngram FROM dd), n AS (SELECT count(*) AS docs FROM dd), f AS (SELECT ngram, count(*) AS df FROM g GROUP BY ngram) SELECT ngram, df, round_even(ln((docs + 1) / (df + 1)) + 1, 6) AS idf FROM f, n WHERE df >= 10 AND df <= 0.4 * docs")
def training_vocabulary(spark, d):  # PL22
    return N.vocabulary(_model(spark, d)[0], "text").select("ngram", "df", F.bround("idf", 6).alias("idf"))


@query("trained_evaluation")
def trained_evaluation(spark, d):  # PL22, AG25, SNK07, SC04: a fifth of the examples is held out by hash
    rows = load(spark, d, "training_rows").dropDuplicates(["row_id"])
    ex = N.clean_examples(rows, "row_id", "title", "authors", "comments", "libreria").select("row_id", "label")
    text = rows.select("row_id", classifier_text(F.concat_ws(" ", "title", "comments", "tags")).alias("text"))
    docs = cut(ex.join(text, "row_id").withColumn("held", F.pmod(F.xxhash64("row_id"), F.lit(5)) == 0))
    terms, classes = N.fit(docs.where("not held"), "row_id", "text", "label")
    p = K.predict(docs.where("held").select("row_id", "text"), "row_id", "text", terms, classes).select("row_id", F.col("label").alias("predicted"))
    e = N.evaluation(docs.where("held").select("row_id", "label").join(p, "row_id"), "label", "predicted")
    return e.select("label", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("trained_terms")
def trained_terms(spark, d):  # SNK07: the exported model over all examples
    rows = load(spark, d, "training_rows").dropDuplicates(["row_id"])
    ex = N.clean_examples(rows, "row_id", "title", "authors", "comments", "libreria").select("row_id", "label")
    docs = cut(ex.join(rows.select("row_id", classifier_text(F.concat_ws(" ", "title", "comments")).alias("text")), "row_id"))
    return N.fit(docs, "row_id", "text", "label")[0]


# --- ranking, shelves, triage


def _asked(spark, d):
    """The web source's records with the query they answer: what the first record of each query says."""
    c = load(spark, d, "candidates").select("query_id", "variant", "pos", "bookid", "workid", F.coalesce("booktitlebare", "title").alias("title"), F.col("author.name").alias("author"), F.col("ratingscount").alias("ratings"))
    first = c.groupBy("query_id").agg(F.min(F.struct("variant", "pos", "bookid", "title", "author")).alias("f"))
    q = first.select("query_id", F.col("f.title").alias("q_title"), F.when(F.col("f.author").isNotNull(), F.array("f.author")).alias("q_authors"))
    return c.join(q, "query_id")


@query("candidate_scores")
def candidate_scores(spark, d):  # PR33, PR34, PR35, PR37, FL07, FL08, FL09
    return R.scored(_asked(spark, d)).select("query_id", "variant", "pos", "bookid", F.bround("score", 6).alias("score"))


@query("gathered_candidates")
def gathered_candidates(spark, d):  # WN12, WN04
    return R.gathered(R.scored(_asked(spark, d))).select("query_id", "variant", "pos", "bookid")


@query("edition_groups")
def edition_groups(spark, d):  # JN16, PR39
    return R.editions(R.gathered(R.scored(_asked(spark, d))))


@query("query_variants")
def query_variants(spark, d):  # PR36, PR38, PR47
    b = books(spark, d).where("title is not null").select("book_id", "title", "authors").distinct()
    return b.select("book_id", F.posexplode(R.query_variants(F.col("title"), F.col("authors"))).alias("variant", "q"))


_SHELVES = """WITH v AS (SELECT book_id, lower(shelf) AS tag, CAST(sum(votes) AS BIGINT) AS votes FROM shelves GROUP BY ALL HAVING sum(votes) >= 10),
r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY votes DESC, encode(tag)) AS place FROM v), b AS (SELECT book_id, coalesce(avg(CASE WHEN place IN (3, 4) THEN votes END), 0) AS base FROM r GROUP BY book_id)
SELECT book_id, tag, votes, place FROM r JOIN b USING (book_id) WHERE votes >= 0.3 * base"""


@query("shelf_tags", _SHELVES)
def shelf_tags(spark, d):  # AG18, JN12, WN02, WN03
    return R.shelf_tags(load(spark, d, "shelves").where("shelf is not null"))


@query("language_conflicts", """WITH b AS (SELECT book_id, list_filter(languages, lambda x: x IS NOT NULL AND x <> 'und') AS l FROM (SELECT DISTINCT book_id, languages FROM current_books)), k AS (SELECT DISTINCT query_id, bookid, lang FROM candidates)
SELECT query_id, bookid, coalesce(len(l), 0) > 0 AND lang IS NOT NULL AND lang <> 'und' AND NOT list_contains(l, lang) AS conflict FROM k JOIN b ON query_id = book_id""")
def language_conflicts(spark, d):  # ST02
    b = books(spark, d).select("book_id", "languages").distinct()
    k = load(spark, d, "candidates").select("query_id", "bookid", "lang").distinct()
    return k.join(b, k.query_id == b.book_id).select("query_id", "bookid", languages_conflict(F.col("languages"), F.array("lang")).alias("conflict"))


@query("download_triage")
def download_triage(spark, d):  # FL06, PR17, JN18, PL19, EX07
    b = books(spark, d).select("book_id", "title", "authors", "languages").groupBy("book_id").agg(F.max(F.struct("title", "authors", "languages")).alias("r"))
    k = load(spark, d, "candidates").select("query_id", "bookid", "title", F.when(F.col("author.name").isNotNull(), F.array("author.name")).alias("authors"), F.when(F.col("lang").isNotNull(), F.array("lang")).alias("languages")).distinct()
    p = k.join(b, k.query_id == b.book_id).select(
        "query_id", "bookid", F.col("r.title").alias("old_title"), F.col("r.authors").alias("old_authors"), F.col("r.languages").alias("old_languages"),
        F.col("title").alias("new_title"), F.col("authors").alias("new_authors"), F.col("languages").alias("new_languages"),
    )
    t = R.triaged(p)
    return t.select("query_id", "bookid", F.bround("title_sim", 6).alias("title_sim"), F.bround("author_sim", 6).alias("author_sim"), "safe")


@query("representative_copies")
def representative_copies(spark, d):  # AG23
    rows = load(spark, d, "training_rows").dropDuplicates(["row_id"]).withColumn("languages", F.array().cast("array<string>"))
    return Q.representatives(rows, "row_id")


@query("request_keys", "SELECT DISTINCT row_id, substr(sha1(coalesce(title, '') || '|' || coalesce(authors, '')), 1, 16) AS key FROM training_rows")
def request_keys(spark, d):  # SC15
    return load(spark, d, "training_rows").select("row_id", Q.request_key(F.col("title"), F.col("authors")).alias("key")).distinct()


@query("unanswered_requests", "SELECT DISTINCT row_id FROM training_rows WHERE coalesce(title, '') || '|' || coalesce(authors, '') NOT IN (SELECT coalesce(title, '') || '|' || coalesce(authors, '') FROM training_rows WHERE libreria IS NOT NULL)")
def unanswered_requests(spark, d):  # JN17
    r = load(spark, d, "training_rows").withColumn("key", Q.request_key(F.col("title"), F.col("authors")))
    return Q.unanswered(r, r.where("libreria is not null")).select("row_id").distinct()
