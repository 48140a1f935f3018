"""Pairs that share a blocking key, however common the key is."""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import cut

#: Pairs of a block, about.
BLOCK_PAIRS = 2_000


def met_by_key(ka: DataFrame, kb: DataFrame, most: int = BLOCK_PAIRS, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """Rows of both sides that share a key, once a key, with the further columns of both sides (``x_a``, ``x_b``).

    Keys with more than ``most`` pairs are split into a grid of blocks of about that many pairs each: a row stands in one
    block row or column of its key and meets every row of the other side in exactly one block. ``most`` bounds the work
    of a block and has no influence on the pairs.
    """
    n = ka.groupBy("key").agg(F.count("*").alias("na")).join(kb.groupBy("key").agg(F.count("*").alias("nb")), "key")
    side = max(1, isqrt(most))
    hot = F.col("na") * F.col("nb") > most
    n = keep(n.select("key", *[F.when(hot, F.ceil(F.col(f"n{x}") / side)).otherwise(F.lit(1)).alias(f"of_{x}") for x in "ab"]))

    def blocks(k: DataFrame, own: str, other: str) -> DataFrame:
        k = k.join(n, "key").withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"of_{own}")))
        more = [F.col(c).alias(f"{c}_{own}") for c in k.columns if c not in ("key", own, f"of_{own}", f"of_{other}")]
        return k.select(*more, "key", own, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"of_{other}") - 1)).alias(other))

    return blocks(ka, "a", "b").join(blocks(kb, "b", "a"), ["key", "a", "b"])


def pairs_by_key(ka: DataFrame, kb: DataFrame, most: int = BLOCK_PAIRS, able: Column | None = None, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(a, b): the pairs of ids of (id, key) that share a key, all of them, once each.

    ``able``: a condition on the further columns of both sides (``x_a``, ``x_b``) that holds for every pair that is wanted; it is
    tested where a pair is formed, so that no other pair is shuffled or written.
    """
    met = met_by_key(ka, kb, most, keep)
    met = met if able is None else met.where(able)
    return met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


#: Keys of both sides that are shuffled at once, about.
ROUND_KEYS = 8_000_000


def pairs_in_rounds(a: DataFrame, b: DataFrame, most: int, able: Column, keep: Callable[[DataFrame], DataFrame], at_once: int = ROUND_KEYS) -> DataFrame:
    """(a, b): pairs of (id, keys) that share one of their keys, all of them, once each.

    The keys take turns by their remainder, so that no step shuffles many more than ``at_once`` of them; that has no
    influence on the pairs.
    """
    total = sum(df.agg(F.sum(F.size("keys"))).first()[0] or 0 for df in (a, b))
    rounds = max(1, -(-total // at_once))
    out = None
    for r in range(rounds):
        turn = [df.withColumn("keys", F.filter("keys", lambda k: F.pmod(k, F.lit(rounds)) == r)) if rounds > 1 else df for df in (a, b)]  # noqa: B023
        sides = [df.select(*[c for c in df.columns if c != "keys"], F.explode("keys").alias("key")) for df in turn]
        found = keep(pairs_by_key(*sides, most, able, keep))
        out = found if out is None else out.unionByName(found)
    return out.distinct() if rounds > 1 else out
