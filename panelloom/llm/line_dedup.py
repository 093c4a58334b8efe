"""Boilerplate lines: lines that many distinct sites share are removed from every document.

Each line's key is a 128-bit hash of its trimmed, lower-cased text. Per key, a HyperLogLog
sketch of the sites and the number of rows are aggregated in one pass; the sketches are a
few fixed words, so that Spark merges them in a hash aggregate, first on the map side.
Two bounds settle most keys: a key in fewer than `min_sites` rows cannot have that many
sites, and the registers that the estimate says are filled are a lower bound of the count.
Keys between the bounds are near the threshold and get an exact distinct count.

The result therefore equals exact counting. A key's rows are combined before the shuffle,
so a line with a third of all rows costs one row a task. Removal joins (document, key)
pairs with the boilerplate keys, which are stored first so that their size is known.

Defined cases: null text stays null and has no lines; blank lines are never boilerplate;
rows without a site add no spread, but lose their boilerplate lines; repeated rows and ids
are treated alike; an empty table gives an empty result; other columns stay, but for ones
named as a result (n_lines, n_removed), which it replaces.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.frames import renamed, side_of_join
from panelloom.sources.storage import store

#: Spark's sketch for a relative error of 0.1 has 128 registers; up to an estimate of 80 it
#: is linear counting, from which the number of filled registers follows.
ERROR, REGISTERS, LINEAR = 0.1, 128, 80


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def line_key(line: Column) -> Column:
    """Two 64-bit hashes; null for a blank line."""
    plain = F.lower(F.trim(line))
    return F.when(
        plain != "", F.struct(F.xxhash64(plain).alias("a"), F.xxhash64(F.lit(1), plain).alias("b"))
    )


def keyed_lines(docs: DataFrame, text: str, *keep: Column) -> DataFrame:
    keys = F.transform(lines_of(F.col(text)), line_key)
    exploded = docs.select(*keep, F.explode(keys).alias("k")).where("k is not null")
    return exploded.select(*[c for c in exploded.columns if c != "k"], F.col("k.a").alias("a"), F.col("k.b").alias("b"))


def least_sites(estimate: Column) -> Column:
    """Registers that must be filled for the estimate: a lower bound of the distinct count."""
    rounded_up = F.least(estimate, F.lit(LINEAR)) - 0.5
    return F.ceil(REGISTERS * (1 - F.exp(-rounded_up / REGISTERS)) - 1e-6)


def boilerplate(docs: DataFrame, min_sites: int = 5, text: str = "text", site: str = "source") -> DataFrame:
    """Keys (a, b) of lines on at least `min_sites` distinct sites."""
    lines = keyed_lines(docs, text, F.col(site).cast("string").alias("site")).where("site is not null")
    spread = store(
        lines.groupBy("a", "b")
        .agg(F.count("*").alias("n"), F.approx_count_distinct("site", ERROR).alias("estimate"))
        .where(F.col("n") >= min_sites)
        .withColumn("sure", (least_sites(F.col("estimate")) >= min_sites)),
        "line_spread",
    )
    if min_sites > REGISTERS * (1 - exp(-(LINEAR - 0.5) / REGISTERS)):
        spread = spread.withColumn("sure", F.lit(False))
    near = side_of_join(spread.where("not sure").select("a", "b"))
    exact = (
        lines.join(near, ["a", "b"], "left_semi")
        .groupBy("a", "b", "site")
        .count()
        .groupBy("a", "b")
        .agg(F.count("*").alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    return spread.where("sure").select("a", "b").union(exact.select("a", "b"))


def remove_boilerplate(
    docs: DataFrame,
    min_sites: int = 5,
    doc_id: str = "doc_id",
    text: str = "text",
    site: str = "source",
) -> DataFrame:
    """docs with shared lines taken out of the text, and n_lines, n_removed (which replace columns so named)."""
    docs, names = renamed(docs)
    doc_id, text, site = names[doc_id], names[text], names[site]
    common = side_of_join(store(boilerplate(docs, min_sites, text, site), "boilerplate"))
    named = docs.withColumn("__text", F.xxhash64(F.col(text)))
    hits = (
        keyed_lines(named, text, F.col(doc_id).alias("__id"), F.col("__text"))
        .join(common, ["a", "b"])
        .groupBy("__id", "__text")
        .agg(F.collect_set(F.struct("a", "b")).alias("__gone"))
    )
    hits = side_of_join(store(hits, "boilerplate_of_documents"), 20_000).withColumnRenamed("__text", "__of")
    joined = named.join(hits, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__of")), "left")
    lines = lines_of(F.col(text))
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("__gone"), line_key(x)), F.lit(False)))
    touched = F.col("__gone").isNotNull()
    cleaned = joined.withColumn("__kept", F.when(touched, kept))
    return cleaned.select(
        *[
            (F.when(touched, F.array_join("__kept", "\n")).otherwise(F.col(c)) if c == text else F.col(c)).alias(name)
            for name, c in names.items()
            if name not in ("n_lines", "n_removed")
        ],
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(lines) - F.size("__kept"), F.lit(0)).cast("long").alias("n_removed"),
    )
