"""Spelling variants: words one edit apart, found by reduced-alphabet neighbourhoods.

1. Letter runs are cut from whole texts and counted in Spark. Counts are combined map-side,
   so a word with a third of all occurrences sends one row per task.
2. The letters of each frequent word are hashed to a few symbols. Words one edit apart have
   reduced words at most one edit apart, so nothing is lost by the reduction.
3. For each distinct reduced word the full neighbourhood of one edit (itself, deletions,
   replacements, insertions; each once) is generated over the few symbols, as 64-bit
   polynomial keys from prefix sums, and joined with the reduced vocabulary.
4. Words of the two reduced words of a hit are verified on their original letters. Keys that
   collide only add candidates: pairs are verified and made distinct.
5. A word's form is its near word with the largest count, if that is several times its own.
   Counts grow along forms, so chains end; roots come from pointer doubling.

A reduced word meets at most (2 * length + 1) * symbols others, so no key gathers more than
the words that share a reduced word. More symbols: longer neighbourhoods, fewer candidates.

Defined cases: null text has no words; a null doc_id is hashed as an empty string; repeated
rows count again; runs shorter than `min_length` are never words; of near words with equal
counts the smallest in code-point order is the form; an empty table gives an empty result;
other columns are ignored; texts are read whole, words may have any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.sources.storage import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_LETTER = "[^a-z\\u00C0-\\u00FF]+"
SYMBOLS = 8
#: Fixed value: the odd base of the keys.
BASE = 0x9E3779B97F4A7C15
#: Most neighbours made at once.
ROWS_AT_ONCE = 1 << 18


def letter_runs(text: Column) -> Column:
    """The maximal runs of letters, with only A-Z lower-cased; may hold an empty string."""
    return F.split(F.translate(text, UPPER, LOWER), NO_LETTER)


def misspelt(doc_id: Column, run: Column, one_in: int) -> Column:
    """The run, for one in `one_in` (document, run) pairs without one of its letters."""
    owner = F.coalesce(doc_id.cast("string"), F.lit(""))
    h = F.crc32(F.concat(owner, F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % one_in == 0, shorter).otherwise(run)


def word_counts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = 6, min_count: int = 5,
    one_in: int | None = None,
) -> DataFrame:
    """word, n of the words with at least `min_length` letters and `min_count` occurrences.

    one_in: see `misspelt`; None counts the runs as they are.
    """
    runs = docs.select(F.col(doc_id).alias("doc"), F.explode(letter_runs(F.col(text))).alias("run"))
    runs = runs.where(F.char_length("run") >= max(min_length, 1))
    word = F.col("run") if one_in is None else misspelt(F.col("doc"), F.col("run"), one_in)
    words = runs.select(word.alias("word")).where(F.char_length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


class Reduction(dict):
    """For str.translate: code point -> symbol, by a hash."""

    def __init__(self, symbols: int):
        super().__init__()
        self.symbols = symbols

    def __missing__(self, point: int) -> int:
        self[point] = symbol = (point * 0x9E3779B1 >> 7) % self.symbols + 1
        return symbol


def powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def keys_of(digits: np.ndarray) -> np.ndarray:
    """digits: one reduced word of a common length in each row. Polynomial keys, modulo 2^64."""
    key = np.ones(len(digits), dtype=np.uint64)
    for i in range(digits.shape[1]):
        key = key * np.uint64(BASE) + digits[:, i]
    return key


def neighbours(digits: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of digits, and the keys of their words at most one edit away, each once."""
    count, length = digits.shape
    up = powers(length + 2)
    before = np.ones((count, length + 1), dtype=np.uint64)
    after = np.zeros((count, length + 1), dtype=np.uint64)
    for i in range(length):
        before[:, i + 1] = before[:, i] * np.uint64(BASE) + digits[:, i]
        j = length - 1 - i
        after[:, j] = digits[:, j] * up[i] + after[:, j + 1]
    rows, keys = [np.arange(count)], [before[:, length]]

    def add(which: np.ndarray, made: np.ndarray) -> None:
        rows.append(np.flatnonzero(which))
        keys.append(made[which])

    for i in range(length + 1):
        rest = length - i
        if i < length:
            last_of_run = digits[:, i] != (digits[:, i - 1] if i else 0)
            add(last_of_run, before[:, i] * up[rest - 1] + after[:, i + 1])
        for symbol in range(1, symbols + 1):
            s = np.uint64(symbol)
            if i < length:
                add(digits[:, i] != s, (before[:, i] * np.uint64(BASE) + s) * up[rest - 1] + after[:, i + 1])
            fresh = digits[:, i - 1] != s if i else np.ones(count, dtype=bool)
            add(fresh, (before[:, i] * np.uint64(BASE) + s) * up[rest] + after[:, i])
    return np.concatenate(rows), np.concatenate(keys)


def by_length(reduced: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the words of each length, and their digits."""
    lengths = np.array([len(r) for r in reduced], dtype=np.int64)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        joined = "".join([reduced[i] for i in at]).encode("latin-1")
        yield at, np.frombuffer(joined, dtype=np.uint8).reshape(len(at), length).astype(np.uint64)


def with_keys(words: DataFrame, symbols: int) -> DataFrame:
    """words (word, n) with their reduced form and its key."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reduction = Reduction(symbols)
        for batch in batches:
            reduced = [w.translate(reduction) for w in batch.column("word").to_pylist()]
            keys = np.zeros(len(reduced), dtype=np.uint64)
            for at, digits in by_length(reduced):
                keys[at] = keys_of(digits)
            columns = [batch.column("word"), batch.column("n"), pa.array(reduced), pa.array(keys.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "reduced", "key"])

    return words.select("word", "n").mapInArrow(keyed, "word string, n long, reduced string, key long")


def neighbourhoods(reduced: DataFrame, symbols: int) -> DataFrame:
    """key, neighbour of every reduced word and every word at most one edit away from it."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, digits in by_length(batch.column("reduced").to_pylist()):
                step = max(1, ROWS_AT_ONCE // ((2 * digits.shape[1] + 1) * symbols))
                for at in range(0, len(digits), step):
                    part = digits[at : at + step]
                    rows, found = neighbours(part, symbols)
                    own = keys_of(part)[rows]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own.view(np.int64)), pa.array(found.view(np.int64))], names=["key", "neighbour"]
                    )

    return reduced.select("reduced").mapInArrow(made, "key long, neighbour long")


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """a, b, a_n, b_n of all words (columns word, n) exactly one edit apart, each pair once, a < b.

    words is read twice and more: a stored table.
    """
    keyed = store(with_keys(words, symbols), "reduced_words")
    reduced = keyed.select("reduced", "key").distinct()
    there = keyed.select(F.col("key").alias("neighbour")).distinct()
    hits = neighbourhoods(reduced, symbols).where("key <= neighbour").join(there, "neighbour", "left_semi")
    a = keyed.select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = keyed.select(F.col("key").alias("neighbour"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    found = store(hits, "reduced_hits").join(a, "key").join(b, "neighbour")
    apart = F.levenshtein("a", "b", 1) == 1
    pairs = found.where(((F.col("key") < F.col("neighbour")) | (F.col("a") < F.col("b"))) & apart)
    first = F.col("a") < F.col("b")
    return pairs.select(
        F.least("a", "b").alias("a"),
        F.greatest("a", "b").alias("b"),
        F.when(first, F.col("a_n")).otherwise(F.col("b_n")).alias("a_n"),
        F.when(first, F.col("b_n")).otherwise(F.col("a_n")).alias("b_n"),
    ).distinct()


def roots_of(forms: DataFrame) -> DataFrame:
    """word, root (following form to the last) of every row that has a form.

    Pointer doubling: after k rounds a word points 2^k forms ahead.
    """
    ahead = store(forms.select("word", F.col("form").alias("root")).where("root IS NOT NULL"), "forms")
    while True:
        then = ahead.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = store(ahead.join(then, "root", "left").select("word", "root", "further"), "forms_ahead")
        if moved.where("further IS NOT NULL").isEmpty():
            return moved.select("word", "root")
        ahead = moved.select("word", F.coalesce("further", "root").alias("root"))


def group_variants(words: DataFrame, times: int = 5, symbols: int = SYMBOLS) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of a stored table (word, n)."""
    pairs = store(near_pairs(words, symbols), "near_pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(
        pairs.select("b", "a", "a_n")
    )
    most = both.groupBy("word").agg(F.count("*").alias("n_near"), F.max("near_n").alias("most_n"))
    best = (
        both.withColumnRenamed("near_n", "most_n")
        .join(most.select("word", "most_n"), ["word", "most_n"], "left_semi")
        .groupBy("word")
        .agg(F.min("near").alias("near"))
    )
    has_form = F.col("most_n") >= times * F.col("n")
    formed = store(
        words.join(most, "word", "left").join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has_form, F.col("near")).alias("form"),
            F.when(has_form, F.col("most_n")).alias("form_n"),
        ),
        "formed_words",
    )
    return formed.join(roots_of(formed), "word", "left").withColumn("root", F.coalesce("root", "word"))
