"""Frequency of every distinct value or term, kept up to date from changes.

Method: incremental signed deltas. A new snapshot is compared with the records counted before, by key and content hash
alone; only records added, changed or deleted are read and taken apart, an old content with sign -1 and a new one with
+1. Their terms are summed into changes of occurrences and of records per term, and merged into persistent counts that
are partitioned by a hash of the term. Unchanged records are never taken apart again, and a merge reads and writes only
the partitions that the changes touch.

Layout of a store in the shared folder: ``<root>/v<k>/counts/bucket=<b>`` (field, term, occurrences, records),
``<root>/v<k>/records/bucket=<b>`` (key, hash, the record as counted), ``<root>/v<k>/manifest`` (what, bucket, version).
A merge writes the touched buckets of a new version beside the old ones, and the manifest last, which tells of each
bucket the version that holds it; so a lost executor or a failed job leaves the last version whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import cut, one_row, shared_dir

#: Partitions of a store, each of any number of files; the unit in which a merge reads and writes.
BUCKETS = 16


def content_hash(df: DataFrame, key: str) -> Column:
    """96 bits over all columns but the key; a NULL differs from any value and from its neighbour's."""
    fields = [F.col(f"`{c}`") for c in df.columns if c != key]
    flagged = [*fields, *[f.isNull() for f in fields]]
    return F.struct(F.xxhash64(*flagged).alias("a"), F.hash(*flagged).alias("b"))


def changed_keys(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, bucket, gone, come) of (key, bucket, hash) before and after; unchanged records are left out. A NULL key is a key like any other."""
    a, b = old.select("key", "bucket", F.col("hash").alias("was")), new.select(F.col("key").alias("key_b"), F.col("bucket").alias("bucket_b"), F.col("hash").alias("is"))
    both = a.join(b, (F.col("bucket") == F.col("bucket_b")) & F.col("key").eqNullSafe(F.col("key_b")), "full").where(~F.col("was").eqNullSafe(F.col("is")))
    gone, come = F.col("was").isNotNull(), F.col("is").isNotNull()
    return both.select(F.when(come, F.col("key_b")).otherwise(F.col("key")).alias("key"), F.coalesce("bucket", "bucket_b").alias("bucket"), gone.alias("gone"), come.alias("come"))


def delta_counts(changes: DataFrame, terms: Column) -> DataFrame:
    """(field, term, occurrences, records): signed sums over the changed records.

    ``terms`` is an array of (field, term) of a record, repeats included. Each record's terms are sorted and folded into
    one row a term before anything is shuffled, which takes no longer than sorting them, and Spark sums partially
    before the shuffle, so a term that stands in every record costs one row per task.
    """

    def folded(one: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(one) - 1), lambda i: (i == 0) | (one[i] != one[F.greatest(i - 1, F.lit(0))]))
        ends = F.transform(F.array(starts), lambda at: F.transform(at, lambda i, k: F.struct(one[i].alias("t"), (F.coalesce(F.get(at, k + 1), F.size(one)) - i).alias("n"))))[0]
        return F.when(F.size(one) > 0, ends)

    each = changes.select("sign", F.explode(F.transform(F.array(F.sort_array(terms)), folded)[0]).alias("x"))
    return each.groupBy(F.col("x.t.field").alias("field"), F.col("x.t.term").alias("term")).agg(F.sum(F.col("sign") * F.col("x.n")).alias("occurrences"), F.sum(F.col("sign").cast("long")).alias("records"))


class TermCounts:
    """A persistent store of counts for one collection."""

    def __init__(self, spark: SparkSession, name: str, key: str, terms: Callable[[DataFrame], DataFrame], root: str | None = None, version: int = 0, buckets: int = BUCKETS):
        """``terms`` adds the column ``_terms`` (array of (field, term)) to changed records (the snapshot's columns and ``sign``).

        ``root`` defaults to a new folder below the session's shared folder; with ``version`` a store written before is
        opened again. ``buckets`` is fixed for a store: the driver holds one number per bucket.
        """
        self.spark, self.key, self.terms, self.buckets = spark, key, terms, buckets
        self.root = root or f"{shared_dir(spark).rstrip('/')}/terms-{name}-{uuid.uuid4().hex}"
        self.version = version
        self.at: dict[str, dict[int, int]] = {"counts": {}, "records": {}}
        if version:
            for r in spark.read.parquet(f"{self.root}/v{version}/manifest").collect():  # at most two rows a bucket
                self.at[r.what][r.bucket] = r.version

    def _read(self, what: str, schema: str, only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.root}/v{v}/{what}/bucket={b}" for b, v in sorted(self.at[what].items()) if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, what: str, df: DataFrame, touched: set[int]) -> None:
        """The new content of the touched buckets; a bucket left empty is written no more."""
        path = f"{self.root}/v{self.version}/{what}"
        df.repartition("bucket", "term" if what == "counts" else "key").write.partitionBy("bucket").parquet(path)
        self.at[what] = {b: v for b, v in self.at[what].items() if b not in touched}
        if touched:
            p, fs = self._files(path)
            names = [s.getPath().getName() for s in fs.listStatus(p)]
            self.at[what] |= {int(n.split("=")[1]): self.version for n in names if n.startswith("bucket=")}

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def counts(self) -> DataFrame:
        """(field, term, occurrences, records) as last merged."""
        return self._read("counts", "field string, term string, occurrences long, records long")

    def update(self, snapshot: DataFrame) -> DataFrame:
        """Bring the counts to the state of ``snapshot`` and return them.

        Repeated rows of one key count as one; of unequal ones the greatest is taken. Every update has the same columns.
        """
        key = F.col(f"`{self.key}`")
        new = one_row(snapshot, self.key)
        new = new.select(key.alias("key"), F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int").alias("bucket"), content_hash(new, self.key).alias("hash"), F.struct(*[F.col(f"`{c}`") for c in new.columns]).alias("r"))
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in new.select("key", "hash", "r").schema)
        if not self.at["records"]:
            changes, touched = new.select("r.*", F.lit(1).alias("sign")), set(range(self.buckets))
        else:
            bucket = F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int").alias("bucket")
            hashes = self._read("records", schema).select("key", bucket, "hash")
            diff = cut(changed_keys(hashes, new.select("key", "bucket", "hash")))
            touched = {r.bucket for r in diff.select("bucket").distinct().collect()}  # at most one row a bucket
            before = self._read("records", schema, touched)
            sides = [(before, "gone", -1), (new, "come", 1)]
            minus, plus = (df.join(diff.where(flag).select(F.col("key").alias("k")), F.col("key").eqNullSafe(F.col("k")), "left_semi").select("r.*", F.lit(sign).alias("sign")) for df, flag, sign in sides)
            changes = minus.unionByName(plus)
        spread = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")
        delta = cut(delta_counts(self.terms(changes), F.col("_terms")).where("occurrences <> 0 or records <> 0").withColumn("bucket", spread))
        terms_at = {r.bucket for r in delta.select("bucket").distinct().collect()}
        old = self._read("counts", "field string, term string, occurrences long, records long", terms_at).withColumn("bucket", spread)
        merged = old.unionByName(delta).groupBy("bucket", "field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).where("occurrences <> 0")
        self.version += 1
        self._write("counts", merged, terms_at)
        self._write("records", new.where(F.col("bucket").isin(*touched)) if len(touched) < self.buckets else new, touched)
        rows = [(what, b, v) for what, at in self.at.items() for b, v in at.items()]
        self.spark.createDataFrame(rows, "what string, bucket int, version int").coalesce(1).write.parquet(f"{self.root}/v{self.version}/manifest")
        return self.counts()

    def remove(self) -> None:
        """Delete the store from the shared folder."""
        p, fs = self._files(self.root)
        fs.delete(p, True)


def marks(counts: DataFrame, records: int, rare_below: int = 3, common_share: float = 0.2) -> DataFrame:
    """(field, term, mark): ``rare`` below ``rare_below`` occurrences, else ``common`` in more than that share of records.

    Other terms are not listed; an empty table gives no row.
    """
    mark = F.when(F.col("occurrences") < rare_below, "rare").when(F.col("records") > common_share * records, "common")
    return counts.select(F.col("field").alias("field_name"), "term", mark.alias("mark")).where("mark is not null")
