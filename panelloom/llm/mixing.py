"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources share a multiple of all words by weight; a source never gives more than
`most_epochs` times its words, and what it cannot give is shared anew by weight. A target
is a number of complete epochs, in which every document is taken once, and a rest. For
the rest, documents are taken in the order of exponential keys -ln(u) / weight, u drawn by
a hash of the document's id and weight from its quality, until their sizes reach it.

Only narrow rows (id, source, size, key) are shuffled, and no source is brought together:
ranges of keys are totalled for each source, and only the one range that the rest ends in
is ordered. That yields a threshold per source, and taking is a comparison of a row's own
key with its source's threshold: texts never move.

Defined cases: null text has size 0; null source is a source, ordered last; a null id is an
id; rows that repeat id and size share a key, and where the rest ends among such copies
their share of it is dealt by a hash of their place in the input; a source without words
has target 0; empty table, empty result; other columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelloom.llm.frames import renamed, side_of_join
from panelloom.llm.sharding import HASH_BITS, hash_of
from panelloom.sources.storage import store

WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def prose_weight(text: Column, size: Column) -> Column:
    """Quality weight from the mean length of words: prose 2, odd lengths 1, hardly text 0.5."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return F.when((size >= 20) & mean.between(3, 10), 2.0).when(size >= 3, 1.0).otherwise(0.5)


def sampling_key(doc_id: Column, weight: Column, seed: int = 0) -> Column:
    """The exponential key: smaller is taken earlier."""
    u = (hash_of(doc_id, F.lit(f"mix{seed}")) + 0.5) / 2**HASH_BITS
    return -F.log(u) / weight


def with_keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """docs with __id, __source, __size and __key."""
    sized = docs.withColumn("__size", word_count(F.col(text)))
    return sized.select(
        *docs.columns,
        F.col(doc_id).alias("__id"),
        F.col(source).alias("__source"),
        "__size",
        sampling_key(F.col(doc_id), prose_weight(F.coalesce(F.col(text), F.lit("")), F.col("__size")), seed).alias("__key"),
    )


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most_epochs: float) -> DataFrame:
    """sizes: source, total. Adds target; the windows run over one row per source."""
    in_order = W.orderBy(F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.select(
        "source",
        "total",
        F.element_at(cycle, ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int")).alias("weight"),
        (F.col("total") * F.lit(float(most_epochs))).alias("most"),
        (F.sum("total").over(everything) * F.lit(float(share))).alias("goal"),
    )
    by_need = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    filled = ranked.withColumn(
        "before", F.coalesce(F.sum("most").over(by_need.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    ).withColumn("open", F.sum("weight").over(by_need.rowsBetween(0, W.unboundedFollowing)))
    level = F.when(
        F.col("most") * F.col("open") > F.col("weight") * (F.col("goal") - F.col("before")),
        (F.col("goal") - F.col("before")) / F.col("open"),
    )
    water = F.first(level, ignorenulls=True).over(by_need.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    target = F.when(water.isNull(), F.col("most")).otherwise(F.least("most", F.col("weight") * water))
    return filled.select("source", "total", target.alias("target"))


def plan(
    rows: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most_epochs: float = 2.0,
    rows_in_range: int = 20_000,
) -> DataFrame:
    """One row per source: total, target, epochs, and the key up to which the rest is taken.

    rows: stored, with __id, __source, __size, __key. `upto` is the last row taken in part
    or whole, `some` of whose `copies` rows are taken.
    """
    sizes = rows.groupBy(F.col("__source").alias("source")).agg(F.sum("__size").alias("total"), F.count("*").alias("n"))
    ranges = max(1, ceil((sizes.agg(F.sum("n")).first()[0] or 0) / rows_in_range))
    aims = targets(sizes, weights, share, most_epochs)
    epochs = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0).cast("long")
    aims = aims.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("total"))
    aims = side_of_join(store(aims, "mix_targets"))

    ranged = rows.where("__size > 0").withColumn("range", F.floor((1 - F.exp(-F.col("__key"))) * ranges))
    totals = ranged.groupBy("__source", "range").agg(F.sum("__size").alias("words"))
    running = W.partitionBy("__source").orderBy("range").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = (
        totals.withColumn("upto_words", F.sum("words").over(running))
        .join(aims.select("source", "rest"), F.col("__source").eqNullSafe(F.col("source")))
        .where((F.col("upto_words") - F.col("words") < F.col("rest")) & (F.col("rest") <= F.col("upto_words")))
        .select("source", F.col("range").alias("last"), (F.col("upto_words") - F.col("words")).alias("start"), "rest")
    )
    ends = side_of_join(store(ends, "mix_ends"))
    tail = (
        ranged.join(ends, F.col("__source").eqNullSafe(F.col("source")) & (F.col("range") == F.col("last")))
        .groupBy("source", "start", "rest", "__key", "__id", "__size")
        .agg(F.count("*").alias("copies"))
    )
    inside = W.partitionBy("source").orderBy("__key", "__id", "__size")
    before = F.col("start") + F.coalesce(
        F.sum(F.col("__size") * F.col("copies")).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    fits = F.floor((F.col("rest") - F.col("before")) / F.col("__size") + 0.5)
    border = (
        tail.withColumn("before", before)
        .withColumn("some", F.least(fits, F.col("copies")))
        .where("some > 0")
        .withColumn("nth", F.row_number().over(W.partitionBy("source").orderBy(F.desc("before"))))
        .where("nth = 1")
        .select(F.col("source").alias("of"), F.struct("__key", "__id", "__size").alias("upto"), "some", "copies")
    )
    planned = (
        aims.join(ends.select(F.col("source").alias("in"), "last"), F.col("source").eqNullSafe(F.col("in")), "left")
        .join(border, F.col("source").eqNullSafe(F.col("of")), "left")
        .select("source", "total", "target", "epochs", "last", F.lit(ranges).alias("ranges"), "upto", "some", "copies")
    )
    return store(planned, "mix_plan")


def times(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """rows (with __id, __source, __size, __key) with __target, __total and __times each is taken."""
    plan_columns = [F.col(c).alias(f"__{c}" if c in ("total", "target") else f"__p_{c}") for c in planned.columns]
    joined = rows.join(
        side_of_join(planned.select(*plan_columns)), F.col("__source").eqNullSafe(F.col("__p_source"))
    )
    own = F.struct("__key", "__id", "__size")
    in_range = F.floor((1 - F.exp(-F.col("__key"))) * F.col("__p_ranges"))
    share = F.expr("pmod(xxhash64(monotonically_increasing_id()), __p_copies) < __p_some")
    extra = (
        F.when(F.col("__p_last").isNull() | (F.col("__size") == 0), False)
        .when(in_range != F.col("__p_last"), in_range < F.col("__p_last"))
        .when(F.col("__p_upto").isNull() | (own > F.col("__p_upto")), False)
        .when(own < F.col("__p_upto"), True)
        .when(F.col("__p_some") == F.col("__p_copies"), True)
        .otherwise(share)
    )
    taken = F.col("__p_epochs") + F.when(extra, 1).otherwise(0)
    return joined.withColumn("__times", taken.cast("long")).drop(*[c for c in joined.columns if c.startswith("__p_")])


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most_epochs: float = 2.0,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: int = 0,
) -> DataFrame:
    """The mixed documents: each row as often as it is taken, with the columns of docs."""
    docs, names = renamed(docs)
    keyed = with_keys(docs, names[doc_id], names[text], names[source], seed)
    planned = plan(store(keyed.select("__id", "__source", "__size", "__key"), "mix_rows"), weights, share, most_epochs)
    repeated = times(keyed, planned).where("__times > 0").withColumn("__nth", F.explode(F.expr("sequence(1L, __times)")))
    return repeated.select(*[F.col(c).alias(name) for name, c in names.items()])
