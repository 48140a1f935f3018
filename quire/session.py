"""Session helpers: settings, table loading and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "quire", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects; a cluster's own settings win where they exist."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",  # checkpoints go when nothing refers to them any more
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where that is unset and the master is local (tests) a temporary folder is made.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = os.environ.get("QUIRE_LOCAL_CHECKPOINTS")
        if not d:
            d = os.environ["QUIRE_LOCAL_CHECKPOINTS"] = tempfile.mkdtemp(prefix="quire-ckpt-")
            atexit.register(shutil.rmtree, d, ignore_errors=True)
    return d


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; survives the loss of executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


class Scratch:
    """Tables of one run of an operator in the shared folder, for runs of many steps.

    The files of a checkpoint or of a shuffle stay until the driver happens to collect its garbage, so a long run would hold
    those of all its steps at once. Inside the block a shuffle's files go with the step that made them, a table when
    it is dropped, and the rest at the end; what the block returns must not read from its tables.
    """

    CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, 0
        self.root = f"{shared_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Scratch:
        self.was = self.spark.conf.get(self.CLEAN, None)
        self.spark.conf.set(self.CLEAN, "true")
        return self

    def __exit__(self, *_) -> None:
        if self.was is None:
            self.spark.conf.unset(self.CLEAN)
        else:
            self.spark.conf.set(self.CLEAN, self.was)
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def keep(self, df: DataFrame) -> DataFrame:
        """The rows as a table of their own; its lineage ends there, and it survives the loss of executors."""
        path = f"{self.root}/{self.made}"
        self.made += 1
        df.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = table, path
        return table

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(self.paths.pop(id(t))[1])


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once in an application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        home = Path(__file__).resolve().parent
        tmp = tempfile.mkdtemp(prefix="quire-")  # the driver serves the archive from here as long as it lives
        atexit.register(shutil.rmtree, tmp, ignore_errors=True)
        shutil.copytree(home, f"{tmp}/in/{home.name}", ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(f"{tmp}/{home.name}", "zip", f"{tmp}/in"))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Most keys that stand in several rows which :func:`one_row` sends to the executors; beyond, all rows are shuffled.
MOST_REPEATED = 200_000


def one_row(df: DataFrame, key: str, most: int = MOST_REPEATED) -> DataFrame:
    """One row of every key; of unequal rows of a key the greatest. NULL is a key like any other.

    Only keys are shuffled to learn which stand in several rows. Rows of other keys pass where they are; if the repeated
    keys are few (counted first, at most ``most``), only their rows are shuffled, otherwise all.
    """
    rest = [c for c in df.columns if c != key]

    def greatest(rows: DataFrame) -> DataFrame:
        if not rest:
            return rows.distinct()
        return rows.groupBy(F.col(f"`{key}`")).agg(F.max(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_r")).select(F.col(f"`{key}`"), "_r.*").select(df.columns)

    repeated = df.groupBy(F.col(f"`{key}`").alias("_k")).agg(F.count("*").alias("n")).where("n > 1").select("_k")
    found = repeated.limit(most + 1).collect()
    if not found:
        return df
    if len(found) > most or len(rest) == 0:
        return greatest(df)
    spark = df.sparkSession
    several = F.broadcast(spark.createDataFrame(found, repeated.schema))
    same = F.col(f"`{key}`").eqNullSafe(F.col("_k"))
    return df.join(several, same, "left_anti").unionByName(greatest(df.join(several, same, "left_semi")))
