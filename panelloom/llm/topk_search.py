"""Exact top-k by inner product of integer vectors, term at a time.

Vectors are cut into blocks of candidates. In a block each dimension is a posting list of
(candidate, weight); a query's terms scatter their weighted postings into a dense array of
scores, from which a partition selects the k best. Spark deals query blocks against
candidate blocks (every candidate meets every query exactly once: the search is
exhaustive) and merges k rows a query and block.

Blocks are dealt by a hash of the rows' place in the input, so that equal vectors or ids
spread. A cell of the grid holds `candidates_in_block` + `queries_in_block` rows at most
about; memory does not grow with the table.

Defined cases: vectors that are null, or hold a null, NaN or infinite component, and rows
without id take no part; vectors of other lengths share their common dimensions; a query
never meets rows with its own id; queries that repeat id and vector are one query; equal
scores go to the smaller id; fewer than k candidates: all of them; empty table: empty
result; other columns are ignored. Sums are exact while they fit 64 bits.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelloom.sources.storage import store

QUERIES_AT_ONCE = 16


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component, null where the vector takes no part."""
    finite = F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")),
    )
    return F.when(finite, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    candidates_in_block: int = 16_384,
    queries_in_block: int = 2_048,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best."""
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        quantised(F.col(vector)).alias("terms"),
        is_query.alias("asks"),
        F.xxhash64(F.monotonically_increasing_id()).alias("deal"),
    ).where("vec_id is not null and terms is not null")
    rows = store(rows, "search_rows")
    queries = rows.where("asks").select("vec_id", "terms").distinct()
    found = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("asking")).first()
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(ceil(found["n"] / candidates_in_block), min(spread, found["n"]), 1)
    query_blocks = max(ceil(found["asking"] / queries_in_block), 1)

    def dealt(frame: DataFrame, own: Column, others: int, mine: str, theirs: str) -> DataFrame:
        all_others = F.sequence(F.lit(0), F.lit(others - 1))
        return frame.withColumn(mine, own).withColumn(theirs, F.explode(all_others))

    right = dealt(
        rows.select("vec_id", "terms", "deal"), F.expr(f"pmod(deal, {blocks})").cast("int"), query_blocks, "block", "part"
    ).drop("deal")
    left = dealt(
        queries, F.expr(f"pmod(xxhash64(vec_id, terms), {query_blocks})").cast("int"), blocks, "part", "block"
    )

    def cell(asked: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        return best_of_block(asked, offered, k)

    partial = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(
        cell, "query_id long, query long, vec_id long, score long"
    )
    order = W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def best_of_block(asked: pd.DataFrame, offered: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of one block for each query of one block."""
    columns = ["query_id", "query", "vec_id", "score"]
    if not len(asked) or not len(offered):
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in columns})
    offered = offered.sort_values("vec_id", kind="stable")
    ids, n = offered["vec_id"].to_numpy(np.int64), len(offered)
    width = max(max(map(len, offered["terms"])), max(map(len, asked["terms"])))
    postings = [(np.flatnonzero(w), w[np.flatnonzero(w)]) for w in matrix(offered["terms"], width).T]
    wanted, query_ids = matrix(asked["terms"], width), asked["vec_id"].to_numpy(np.int64)
    names = pd.util.hash_array(np.array([t.tobytes() for t in wanted], dtype=object)).view(np.int64)
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(wanted), QUERIES_AT_ONCE):
        terms = wanted[at : at + QUERIES_AT_ONCE]
        scores = np.zeros((len(terms), n), dtype=np.int64)
        for term, (places, weights) in enumerate(postings):
            asking = np.flatnonzero(terms[:, term])
            if not len(asking) or not len(places):
                continue
            if len(places) == n and len(asking) == len(terms):
                scores += terms[:, term, None] * weights
            else:
                scores[np.ix_(asking, places)] += terms[asking, term, None] * weights
        for row, (query, name) in enumerate(zip(query_ids[at:], names[at:])):
            if row == len(terms):
                break
            own = slice(np.searchsorted(ids, query, "left"), np.searchsorted(ids, query, "right"))
            best = top(scores[row], own, k)
            out.append((np.full(len(best), query), np.full(len(best), name), ids[best], scores[row][best]))
    return pd.DataFrame({c: np.concatenate(part) for c, part in zip(columns, zip(*out))})


def matrix(terms: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(terms), width), dtype=np.int64)
    for row, values in enumerate(terms):
        out[row, : len(values)] = values
    return out


def top(scores: np.ndarray, own: slice, k: int) -> np.ndarray:
    """Places of the k largest scores outside `own`, ties to the first places."""
    others = np.ones(len(scores), dtype=bool)
    others[own] = False
    n = int(others.sum())
    if n <= k:
        return np.flatnonzero(others)
    least = np.partition(scores[others], n - k)[n - k]
    above = np.flatnonzero(others & (scores > least))
    level = np.flatnonzero(others & (scores == least))[: k - len(above)]
    return np.concatenate([above, level])
