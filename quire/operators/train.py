"""Training of the linear text model (AG19, AG20, AG25, SNK07, PL22)."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import collapse, no_marks, vectorised
from quire.operators.classify import ngrams
from quire.session import cut

#: Bounds of a fit, documented parameters: features the driver can hold as coefficients.
MOST_TERMS = 200_000


def folded_key(c: Column) -> Column:
    """SC12, PR32: accent-free, lower case, white space collapsed."""
    return collapse(F.lower(vectorised(no_marks)(F.coalesce(c, F.lit("")))))


def clean_examples(rows: DataFrame, key: str, title: str, authors: str, text: str, label: str) -> DataFrame:
    """AG19: one example per (title, authors): groups with several labels are dropped, of one label the longest text stays.

    Rows without a label are no examples. Texts stay out of the grouping: it finds the row to keep by length and key.
    """
    lab = F.trim(F.col(label))
    r = rows.where(F.coalesce(lab, F.lit("")) != "").select(key, folded_key(F.col(title)).alias("t"), folded_key(F.col(authors)).alias("w"), lab.alias("label"), F.length(F.coalesce(text, F.lit(""))).alias("n"))
    g = r.groupBy("t", "w").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.struct("n", (-F.col(key)).alias("k"), "label")).alias("b"), F.count("*").alias("copies"))
    return g.where("lo = hi").select((-F.col("b.k")).alias(key), F.col("lo").alias("label"), "copies")


def label_counts(examples: DataFrame, few: int = 20) -> DataFrame:
    """AG20: examples per class, with a flag for few."""
    return examples.groupBy("label").agg(F.count("*").alias("n")).withColumn("few", F.col("n") < few)


def vocabulary(docs: DataFrame, text: str, min_df: int = 10, max_share: float = 0.4) -> DataFrame:
    """PL22: (ngram, df, idf) of n-grams in ``min_df`` documents or more and at most ``max_share`` of them."""
    n = docs.agg(F.count("*").alias("docs"))
    df = docs.select(F.explode(F.array_distinct(ngrams(F.col(text)))).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("df"))
    kept = df.where(F.col("df") >= min_df).crossJoin(F.broadcast(n)).where(F.col("df") <= max_share * F.col("docs"))
    return kept.select("ngram", "df", (F.log((F.col("docs") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def fit(docs: DataFrame, key: str, text: str, label: str, min_df: int = 10, max_share: float = 0.4, reg: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """PL22, SNK07: (terms, classes) of a multinomial model, coefficients rounded to 6 places.

    The vocabulary is checked against MOST_TERMS; fewer than 10 examples or 2 classes raise ValueError.
    """
    from quire.operators.classify import term_weights

    spark = docs.sparkSession
    names = [r[label] for r in docs.select(label).distinct().orderBy(label).limit(1001).collect()]
    if len(names) < 2 or len(names) > 1000 or docs.limit(10).count() < 10:
        raise ValueError("ten examples and two to 1000 classes are needed")
    terms = cut(vocabulary(docs, text, min_df, max_share))
    listed = [r.ngram for r in terms.select("ngram").orderBy("ngram").limit(MOST_TERMS + 1).collect()]
    if len(listed) > MOST_TERMS:
        raise ValueError("the vocabulary is larger than MOST_TERMS: raise min_df")
    place = spark.createDataFrame([(g, i) for i, g in enumerate(listed)], "ngram string, i int")
    w = term_weights(docs, key, text, terms).join(place, "ngram")
    size = max(1, len(listed))

    @F.udf(VectorUDT())
    def vector(pairs):
        return SparseVector(size, sorted((p["i"], p["w"]) for p in pairs or []))

    k = F.array_position(F.array(*map(F.lit, names)), F.col(label)) - 1
    data = docs.select(key, k.cast("double").alias("label")).join(w.groupBy(key).agg(F.collect_list(F.struct("i", "w")).alias("p")), key, "left").select("label", vector("p").alias("features"))
    model = LogisticRegression(regParam=reg, maxIter=60, standardization=False, family="multinomial").fit(cut(data))
    b = model.coefficientMatrix.toArray()
    rows = [(g, [round(float(v), 6) for v in b[:, i]]) for i, g in enumerate(listed)]
    coef = spark.createDataFrame(rows, "ngram string, coef array<double>")
    classes = spark.createDataFrame([(i, n, round(float(model.interceptVector[i]), 6)) for i, n in enumerate(names)], "k int, class_name string, intercept double")
    return terms.join(coef, "ngram").select("ngram", F.round("idf", 6).alias("idf"), "coef"), classes


def evaluation(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """AG25: precision, recall and F1 by class, and of all: accuracy as ``recall`` and macro F1."""
    c = rows.groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    hit = F.sum(F.when(F.col("y").eqNullSafe(F.col("p")), F.col("n")).otherwise(0))
    by_y = c.groupBy("y").agg(hit.alias("hit"), F.sum("n").alias("support"))
    by_p = c.where("p is not null").groupBy(F.col("p").alias("y")).agg(F.sum("n").alias("given"))
    r = by_y.join(by_p, "y", "left").select("y", "hit", "support", F.coalesce("given", F.lit(0)).alias("given"))
    f1 = F.when(F.col("hit") > 0, 2 * F.col("hit") / (F.col("support") + F.col("given"))).otherwise(0.0)
    r = r.select(F.col("y").alias("label"), F.when(F.col("given") > 0, F.col("hit") / F.col("given")).otherwise(0.0).alias("precision"), (F.col("hit") / F.col("support")).alias("recall"), f1.alias("f1"), "support")
    whole = r.agg(F.lit("all").alias("label"), F.lit(None).cast("double").alias("precision"), (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support"))
    return r.unionByName(whole)
