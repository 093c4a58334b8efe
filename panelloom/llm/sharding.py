"""Sharding by weighted rendezvous hashing.

Every shard draws a number from the hash of (key, shard); a record goes to the shard with
the best draw, scaled by the shard's weight. The choice needs no table and no shuffle, and
a shard that is added takes records only into itself: about its share of all records moves.

`numbered` gives each record of a shard a gapless slot without bringing a shard together:
equal narrow rows are first counted, ranges of the key's hash are totalled, and only the
rows of one (shard, range) are ordered in one task. Ranges follow the row count, the
resulting order does not depend on them.

Defined cases: a null key is a key like any other; equal keys share a shard; ties of draws
go to the smaller shard; a shard with weight 0 or less takes nothing; an empty table gives
an empty result; other columns stay.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HASH_BITS = 52


def hash_of(*parts: Column) -> Column:
    """A 52-bit number from the parts' texts, exact in a double."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (its place in `weights`) that wins the key.

    The draw is the hash h itself where all weights are equal, else -w / ln((h + 0.5) / 2^52):
    both rank shards alike when weights are equal.
    """
    live = [(s, w) for s, w in enumerate(weights) if w > 0]
    if not live:
        raise ValueError("no shard with a positive weight")
    even = len({w for _, w in live}) == 1

    def draw(shard: int, weight: float) -> Column:
        h = hash_of(key, F.lit(shard))
        return h if even else -F.lit(weight) / F.log((h + 0.5) / 2**HASH_BITS)

    draws = [F.struct(draw(s, w).alias("draw"), F.lit(-s).alias("place")) for s, w in live]
    best = F.greatest(*draws) if len(draws) > 1 else draws[0]
    return (-best["place"]).cast("int")


def shard(
    docs: DataFrame, weights: Sequence[float], key: str = "doc_id", name: str = "shard"
) -> DataFrame:
    """docs with the shard of each row; a map without a shuffle."""
    return docs.withColumn(name, rendezvous(F.col(key), weights))


def numbered(rows: DataFrame, shard: str, key: str, rows_in_range: int = 20_000) -> DataFrame:
    """rows (narrow) with `slot`, from 0 within each shard, by the key's hash, then all columns.

    Equal rows are interchangeable: they travel as one row and a count.
    """
    from panelloom.sources.storage import store

    columns = rows.columns
    counted = rows.groupBy(*columns).agg(F.count("*").alias("__n"))
    stored = store(counted.withColumn("__h", hash_of(F.col(key))), "shard_rows")
    total = stored.agg(F.sum("__n")).first()[0] or 0
    bits = min(HASH_BITS, max(0, ceil(log2(max(total / rows_in_range, 1)))))
    placed = stored.withColumn("__range", F.shiftright("__h", HASH_BITS - bits) if bits else F.lit(0).cast("long"))
    sizes = placed.groupBy(shard, "__range").agg(F.sum("__n").alias("__size"))
    before = W.partitionBy(shard).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        F.col(shard).alias("__shard"),
        F.col("__range").alias("__of"),
        F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"),
    )
    inside = W.partitionBy(shard, "__range").orderBy("__h", *columns).rowsBetween(W.unboundedPreceding, -1)
    first = F.coalesce(F.sum("__n").over(inside), F.lit(0))
    joined = placed.withColumn("__first", first).join(
        starts, F.col(shard).eqNullSafe(F.col("__shard")) & (F.col("__range") == F.col("__of"))
    )
    start = F.col("__start") + F.col("__first")
    slots = F.explode(F.sequence(start, start + F.col("__n") - 1))
    return joined.select(*columns, slots.alias("slot"))
