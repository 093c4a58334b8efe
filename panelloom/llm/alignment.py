"""Alignment of the tokens that two tokenizers give for the same texts, with corpus-wide counts.

Both tokenizers cut a text wherever one plain space stands between two characters that are
no white space: the byte-level one by its pattern, the piece model because no piece holds a
word's mark behind another character (checked when it is loaded). So a text is aligned chunk
by chunk, and a worker keeps the alignments of distinct chunks.

In a chunk, the cumulative byte ends of each tokenizer are a dictionary from end to index.
The common keys of both, sorted, slice the two id lists into groups. Within each slice the
links (tokens whose byte ranges overlap) are expanded.

Corpus-wide counts (how many documents hold a pair of ids linked) need every document's
pairs twice. One pass over the texts stores, block by block, each document's distinct pairs
as places in the block's dictionary of pairs, and the dictionary with its counts. Only
dictionaries are summed and joined with the corpus-wide counts; they then meet their block's
documents again, by the block's number. Blocks hold about BLOCK entries, so groups are
bounded, and a pair that all documents hold sends one row per block. What is broadcast is
the highest count of each id of the first tokenizer: as many rows as its vocabulary.

Defined cases: texts that are null, empty, or that a tokenizer does not give back byte for
byte have no tokens: zeros and an empty digest; they hold no pair; repeated ids and rows are
documents of their own; special strings are plain text; empty table, empty result; of other
columns only the id is returned; texts are read whole.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelloom.llm.frames import text_slices
from panelloom.llm.vocabularies import byte_level_tokenizer, pieces_model
from panelloom.sources.storage import store

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK_START = re.compile(r"(?<=\S) (?=\S)")
MARK = "▁"
BLOCK = 1 << 19
SLICE = 1 << 20
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def visible_bytes() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies.

    Printable bytes of Latin-1 stand for themselves, the others for characters from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def byte_level_bytes(file: str) -> list[bytes]:
    """The bytes of each id; those of entries that are no byte-level text are empty."""
    table, tokenizer = visible_bytes(), byte_level_tokenizer(file)
    entries = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    return [bytes(table[c] for c in entry) if all(c in table for c in entry) else b"" for entry in entries]


@lru_cache(maxsize=2)
def piece_bytes(file: str) -> list[bytes]:
    model = pieces_model(file)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if inside := [p for p in pieces if MARK in p.lstrip(MARK)]:
        raise ValueError(f"pieces that cross the start of a word: {inside[:3]}")
    return [
        bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)
    ]


def links_of(ends_a: list[int], ends_b: list[int], i: int, j: int, end: int) -> tuple[list[int], list[int]]:
    """Places of the tokens whose byte ranges overlap, from tokens i and j up to the common byte end."""
    link_a, link_b, at = [], [], -1
    while at != end:
        link_a.append(i)
        link_b.append(j)
        a, b = ends_a[i], ends_b[j]
        at = min(a, b)
        if a == at:
            i += 1
        if b == at:
            j += 1
    return link_a, link_b


@dataclass(frozen=True)
class Groups:
    """The groups of two tokenisations of the same bytes: where they end, and their linked tokens' places."""

    ends: np.ndarray
    to_a: np.ndarray
    to_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    links: np.ndarray  # of each group


def align(ends_a: list[int], ends_b: list[int]) -> Groups:
    """Cumulative byte ends -> groups between common ends, and links within each.

    A slice with one token on either side links all its tokens; only slices with several on
    both sides need their byte ranges.
    """
    index_a, index_b = (dict(zip(ends, range(1, len(ends) + 1))) for ends in (ends_a, ends_b))
    common = sorted(index_a.keys() & index_b.keys())
    to_a, to_b = (np.array([index[e] for e in common], dtype=np.int64) for index in (index_a, index_b))
    n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
    crossing = (n_a > 1) & (n_b > 1)
    found_a, found_b, counts = [], [], []
    for i, j, k in zip((to_a - n_a)[crossing].tolist(), (to_b - n_b)[crossing].tolist(), np.flatnonzero(crossing).tolist()):
        link_a, link_b = links_of(ends_a, ends_b, i, j, common[k])
        found_a += link_a
        found_b += link_b
        counts.append(len(link_a))
    links = n_a * n_b
    links[crossing] = counts
    first = np.cumsum(links) - links
    within = np.arange(int(links.sum())) - np.repeat(first, links)
    wide = np.repeat(np.maximum(n_b, 1), links)
    link_a = np.repeat(to_a - n_a, links) + within // wide
    link_b = np.repeat(to_b - n_b, links) + within % wide
    crossed = np.repeat(crossing, links)
    link_a[crossed], link_b[crossed] = found_a, found_b
    return Groups(np.array(common, dtype=np.int64), to_a, to_b, link_a, link_b, links)


def written(a: list[int], b: list[int], groups: Groups, last: np.ndarray) -> list[str]:
    """The groups as text, cut after those that are the last of a chunk."""
    after_a, after_b = [","] * len(a), [","] * len(b)
    for i, j, stop in zip(groups.to_a.tolist(), groups.to_b.tolist(), last.tolist()):
        after_a[i - 1], after_b[j - 1] = "|", "\n" if stop else ";"
    tokens = [f"{x}{s}" for x, s in zip(chain(a, b), chain(after_a, after_b))]
    place = np.arange(len(groups.to_a)) * 2
    of_a = np.repeat(place, np.diff(groups.to_a, prepend=0))
    of_b = np.repeat(place + 1, np.diff(groups.to_b, prepend=0))
    order = np.argsort(np.concatenate([of_a, of_b]), kind="stable").tolist()
    return "".join([tokens[i] for i in order]).split("\n")[:-1]


@dataclass(slots=True)
class Chunk:
    """The alignment of a chunk; pairs: its links, packed. `same`: both tokenizers give its bytes back."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    pairs: bytes
    same: bool


class Chunks:
    """Alignments of chunks, which are written without the space before them.

    The latest `most` and those used since are kept, as two generations.
    """

    def __init__(self, file_a: str, file_b: str, most: int):
        self.most = most
        self.a, self.b = byte_level_tokenizer(file_a), pieces_model(file_b)
        self.bytes_a, self.bytes_b = byte_level_bytes(file_a), piece_bytes(file_b)
        self.width = len(self.bytes_b)
        self.sizes = [np.array([len(x) for x in data], dtype=np.int64) for data in (self.bytes_a, self.bytes_b)]
        self.young: dict[str, Chunk] = {}
        self.old: dict[str, Chunk] = {}

    def of(self, chunks: list[str]) -> list[Chunk]:
        """chunks: distinct."""
        missing = []
        for c in chunks:
            if c not in self.young:
                if c in self.old:
                    self.young[c] = self.old[c]
                else:
                    missing.append(c)
        if missing:
            gc.disable()  # many small lists, none of them cyclic
            try:
                self.young.update(zip(missing, self.learn(missing)))
            finally:
                gc.enable()
        found = [self.young[c] for c in chunks]
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        return found

    def learn(self, chunks: list[str]) -> list[Chunk]:
        """Each chunk ends at a common byte, so all are aligned at once, end to end."""
        a_ids = [e.ids for e in self.a.encode_batch_fast([f" {c}" for c in chunks], add_special_tokens=False)]
        b_ids = self.b.encode(chunks, num_threads=1)
        same = self.given_back(chunks, a_ids, b_ids)
        if not all(same):
            a_ids, b_ids = ([x if ok else [] for x, ok in zip(own, same)] for own in (a_ids, b_ids))
        a, b = list(chain.from_iterable(a_ids)), list(chain.from_iterable(b_ids))
        array_a, array_b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        groups = align(*(np.cumsum(n[ids]).tolist() for n, ids in zip(self.sizes, (array_a, array_b))))
        sizes = np.array([len(c.encode()) + 1 if ok else 0 for c, ok in zip(chunks, same)], dtype=np.int64)
        to = np.searchsorted(groups.ends, np.cumsum(sizes), "right")
        n_groups = np.diff(to, prepend=0)
        last = np.zeros(len(groups.ends), dtype=bool)
        last[to[n_groups > 0] - 1] = True
        texts = iter(written(a, b, groups, last))
        packed = (array_a[groups.link_a] * self.width + array_b[groups.link_b]).tobytes()
        stops = (8 * np.concatenate([[0], np.cumsum(groups.links)])[to]).tolist()
        return [
            Chunk(len(x), len(y), n, next(texts) if n else "", packed[from_:stop], ok)
            for x, y, n, from_, stop, ok in zip(a_ids, b_ids, n_groups.tolist(), [0, *stops], stops, same)
        ]

    def given_back(self, chunks: list[str], a_ids: list[list[int]], b_ids: list[list[int]]) -> list[bool]:
        """Whether the bytes of both token lists are the chunk's, with the space before it."""
        whole = "".join([f" {c}" for c in chunks]).encode()
        sizes = np.array([len(c.encode()) + 1 for c in chunks], dtype=np.int64)
        same = np.ones(len(chunks), dtype=bool)
        for own, data, lengths in zip((a_ids, b_ids), (self.bytes_a, self.bytes_b), self.sizes):
            flat = list(chain.from_iterable(own))
            if b"".join(map(data.__getitem__, flat)) == whole:
                ends = np.concatenate([[0], np.cumsum(lengths[np.array(flat, dtype=np.int64)])])
                if np.array_equal(ends[np.cumsum([len(x) for x in own])], np.cumsum(sizes)):
                    continue
            same &= [b"".join(map(data.__getitem__, x)) == f" {c}".encode() for c, x in zip(chunks, own)]
        return same.tolist()


@lru_cache(maxsize=1)
def chunks_of(file_a: str, file_b: str, most: int) -> Chunks:
    """A worker's alignments, also for its later tasks."""
    return Chunks(file_a, file_b, most)


class Block:
    """Documents and their distinct pairs, until there are enough for a block."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.sizes: list[np.ndarray] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def entries(self) -> int:
        return sum(map(len, self.pairs))

    def add(self, ids: list, texts: list[str], known: Chunks) -> None:
        parts = [CHUNK_START.split(t) if t else [] for t in texts]
        lengths = np.array([len(own) for own in parts], dtype=np.int64)
        flat = list(chain.from_iterable(parts))
        place = {c: i for i, c in enumerate(dict.fromkeys(flat))}
        chunks = known.of(list(place))
        at = np.fromiter(map(place.__getitem__, flat), dtype=np.int64, count=len(flat))
        row = np.repeat(np.arange(len(texts)), lengths)
        pairs = np.frombuffer(b"".join([c.pairs for c in chunks]), dtype=np.int64)
        n_links = np.array([len(c.pairs) // 8 for c in chunks], dtype=np.int64)
        bad = np.array([not c.same for c in chunks], dtype=bool)
        fine = np.bincount(row, bad[at] if len(at) else None, len(texts)) == 0
        numbers = [np.array([getattr(c, name) for c in chunks], dtype=np.int64) for name in COUNTS[:3]]
        totals = np.array([
            np.bincount(row, n[at] if len(at) else None, len(texts)) for n in (*numbers, n_links)
        ]).astype(np.int64) * fine
        groups, ends, places = [c.groups for c in chunks], np.cumsum(lengths).tolist(), at.tolist()
        for i, doc in enumerate(ids):
            own = places[ends[i] - lengths[i] : ends[i]]
            digest = hashlib.sha256(";".join([groups[c] for c in own]).encode()).hexdigest() if own and fine[i] else ""
            self.rows.append((doc, *totals[:, i].tolist(), digest))
        if not len(at):
            self.sizes.append(np.zeros(len(texts), dtype=np.int64))
            return
        count = np.where(fine[row], n_links[at], 0)
        first = (np.cumsum(n_links) - n_links)[at]
        where = np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        codes = pairs[where]
        most = int(pairs.max(initial=0)) + 1
        keys, times = np.unique(np.repeat(row, count) * most + codes, return_counts=True)
        self.sizes.append(np.bincount(keys // most, minlength=len(texts)))
        self.pairs.append(keys % most)
        self.times.append(times)

    def made(self, number: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """A row for each document, then one for the block's dictionary."""
        pairs, times = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (self.pairs, self.times))
        pairs, place, docs = np.unique(pairs, return_inverse=True, return_counts=True)
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(self.sizes))]).astype(np.int32))
        columns = list(zip(*self.rows))
        count, none = len(self.rows), lambda kind, n: pa.nulls(n, kind)
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        names = ["block", "doc_id", *COUNTS, "groups_sha256", "place", "times", "pairs", "docs"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(count, number)), pa.array(columns[0], id_type),
             *[pa.array(c, pa.int64()) for c in columns[1:5]], pa.array(columns[5], pa.string()),
             pa.ListArray.from_arrays(offsets, pa.array(place.astype(np.int32))),
             pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))), none(longs, count), none(longs, count)],
            names=names,
        )
        if len(pairs):
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), none(id_type, 1), *[none(pa.int64(), 1)] * 4, none(pa.string(), 1),
                 none(ints, 1), none(ints, 1), pa.array([pairs], longs), pa.array([docs], longs)],
                names=names,
            )


def aligned_blocks(
    docs: DataFrame, file_a: str, file_b: str, doc_id: str, text: str, block: int, cached: int
) -> DataFrame:
    """Rows of documents (pairs is null) and of blocks' dictionaries."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, open_ = chunks_of(file_a, file_b, cached), Block()
        number = TaskContext.get().partitionId() << 32
        for batch in text_slices(batches, SLICE):
            open_.add(batch.column(0).to_pylist(), batch.column(1).to_pylist(), known)
            if open_.entries() >= block:
                yield from open_.made(number, batch.schema.field(0).type)
                open_, number = Block(), number + 1
        if open_.rows:
            yield from open_.made(number, batch.schema.field(0).type)

    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(
        made,
        f"block long, doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, "
        "place array<int>, times array<int>, pairs array<long>, docs array<long>",
    )


def rated_pairs(dictionaries: DataFrame, width: int) -> DataFrame:
    """pair, count (documents that hold it linked), best (none of its first id has more)."""
    counts = store(dictionaries.groupBy("pair").agg(F.sum("docs").alias("count")), "pair_counts")
    first = F.expr(f"pair div {width}")
    highest = counts.groupBy(first.alias("first")).agg(F.max("count").alias("highest"))
    return counts.withColumn("first", first).join(F.broadcast(highest), "first").select(
        "pair", "count", (F.col("count") == F.col("highest")).alias("best")
    )


def counted(documents: pa.Table, entries: pa.Table) -> pa.Table:
    """The documents of a block with n_best and count_sum, from the rated entries of its dictionary."""
    place = entries.column("place").to_numpy()
    size = int(place.max()) + 1 if len(place) else 0
    count, best = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    count[place] = entries.column("count").to_numpy()
    best[place] = entries.column("best").to_numpy()
    lists = documents.column("place").combine_chunks()
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    at = lists.flatten().to_numpy()
    times = documents.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)

    def sums(of: np.ndarray) -> pa.Array:
        running = np.concatenate([[0], np.cumsum(of[at] * times)])
        return pa.array(np.diff(running[np.concatenate([[0], ends])]).astype(np.int64))

    kept = documents.select(["doc_id", *COUNTS, "groups_sha256"])
    return kept.append_column("n_best", sums(best)).append_column("count_sum", sums(count))


def align_tokens(
    docs: DataFrame, file_a: str = BYTE_LEVEL, file_b: str = PIECES, doc_id: str = "doc_id", text: str = "text",
    block: int = BLOCK, cached: int = 120_000,
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of every row."""
    stored = store(aligned_blocks(docs, file_a, file_b, doc_id, text, block, cached), "aligned_blocks")
    dictionaries = stored.where("pairs IS NOT NULL").select(
        "block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "entry")
    ).select("block", "place", F.col("entry.pairs").alias("pair"), F.col("entry.docs").alias("docs"))
    rated = store(rated_pairs(dictionaries, len(piece_bytes(file_b))), "rated_pairs")
    entries = dictionaries.join(rated, "pair").select(F.col("block").alias("of_block"), "place", "count", "best")
    rows = stored.where("pairs IS NULL").select("block", "doc_id", *COUNTS, "groups_sha256", "place", "times")
    kind = rows.schema["doc_id"].dataType.simpleString()
    layout = f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, n_best long, count_sum long"
    return rows.groupBy("block").cogroup(entries.groupBy("of_block")).applyInArrow(counted, layout)
