"""Token counts of whole texts with a public byte-level BPE vocabulary.

A text is cut into special strings and pre-tokens; its count is the sum of the pre-tokens'
lengths in tokens. Lengths come from two tiers on the map side: a broadcast table of the
pre-tokens that are frequent in the first `table_rows` documents of at most ROW_BYTES (a
bounded read that changes only speed), and a cache in each worker, bounded by `cached` entries, that encodes
a miss with the tokenizer itself. No pre-token is ever shuffled.

Texts with characters beyond the Latin blocks go to the tokenizer whole, so that counts do
not depend on which Unicode version a regular expression knows.

Defined cases: null text is empty: 0 bytes, 0 tokens; empty table, empty result; repeated
rows and ids are counted alike; other columns stay; the special strings of the vocabulary
count as one token inside a text, as the library does by default.
"""

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.vocabularies import path_of

#: Fixed value: how byte-level BPE cuts text, with white space as Unicode's property.
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
ROW_BYTES = 16_384
BEYOND_LATIN = re.compile("[^\\x00-\\u024f]")


@lru_cache(maxsize=2)
def tokenizer(file: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path_of(file))
    made.no_truncation()
    made.no_padding()
    return made


class Lengths(dict):
    """Pre-token -> tokens. Starts from the broadcast table; misses are encoded and kept."""

    def __init__(self, file: str, frequent: dict[str, int], cached: int):
        import regex

        super().__init__(frequent)
        self.frequent, self.most = frequent, len(frequent) + cached
        self.tokenizer = tokenizer(file)
        self.pieces = regex.compile(PRE_TOKEN).findall
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        longest_first = sorted(special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest_first))) if special else None

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.most:
            self.clear()
            self.update(self.frequent)
        self[piece] = n = self.whole(piece)
        return n

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def of(self, text: str) -> int:
        if BEYOND_LATIN.search(text):
            return self.whole(text)
        if self.special is None or not self.special.search(text):
            return sum(map(self.__getitem__, self.pieces(text)))
        between = self.special.split(text)
        return len(between) - 1 + sum(sum(map(self.__getitem__, self.pieces(t))) for t in between)


def frequent_lengths(
    docs: DataFrame, file: str, text: str = "text", table_rows: int = 500, table_size: int = 20_000
) -> dict[str, int]:
    """The first tier: at most `table_size` pre-tokens of `table_rows` rows of at most ROW_BYTES.

    Spark reads only as many partitions as it takes to find the rows.
    """
    short = docs.select(F.col(text).alias("text")).where(F.octet_length("text") <= ROW_BYTES)
    lengths, seen = Lengths(file, {}, table_size), Counter()
    for row in short.take(table_rows):
        seen.update(lengths.pieces(row["text"]))
    best = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:table_size]
    return {piece: lengths[piece] for piece, _ in best}


def count_tokens(
    docs: DataFrame,
    file: str,
    text: str = "text",
    limit: int = 512,
    table_rows: int = 500,
    table_size: int = 20_000,
    cached: int = 300_000,
) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens and over_limit."""
    frequent = docs.sparkSession.sparkContext.broadcast(
        frequent_lengths(docs, file, text, table_rows, table_size)
    )

    @F.pandas_udf("long")
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lengths = Lengths(file, frequent.value, cached)
        for texts in batches:
            yield pd.Series([lengths.of(t) for t in texts], dtype="int64")

    whole = F.coalesce(F.col(text), F.lit(""))
    return (
        docs.withColumn("n_bytes", F.octet_length(whole).cast("long"))
        .withColumn("n_tokens", counts(whole))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
