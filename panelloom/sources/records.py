"""CSV records of files whose cells may hold line breaks, cut by as many tasks as there are blocks.

A block's first line may lie inside a quoted cell that an earlier block opened. So one pass
tells for both cases, block by block, whether its end lies inside quotes; a window over these
few block rows then gives every block its true beginning. A second pass joins the lines of
each record within its block. Only records that cross a block's end are stitched, from one
piece per block.

Texts are read byte by byte as Latin-1, whatever they are written in: separators, quotes and
line ends are the same bytes in every accepted encoding. A quote opens a cell only at the
cell's begin; an inch mark elsewhere is a character like others. Line breaks in cells become
a line feed. Blank lines between records are dropped.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from panelloom.sources.storage import store

QUOTE = '"'
_QUOTED = '[^"]*+(?:""[^"]*+)*+'
_CELLS = f'(?:(?:"{_QUOTED}"[^,]*+|[^",][^,]*+)?+,)*+"{_QUOTED}'
OPENS = re.compile(rf"{_CELLS}\Z", re.DOTALL)
STAYS = re.compile(rf'{_QUOTED}(?:\Z|"[^,]*+,{_CELLS}\Z)', re.DOTALL)

WHOLE, BEGIN, MIDDLE, END = range(4)
RECORD = "key long, block long, row long, part int, text string"


def inside_after(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open at the line's end."""
    if QUOTE not in line:
        return inside
    return bool((STAYS if inside else OPENS).match(line))


def latin_lines(spark: SparkSession, path) -> DataFrame:
    """key (hash of the file's path), block (where it begins in the file), line."""
    lines = spark.read.text(path)
    return lines.select(
        F.xxhash64("_metadata.file_path").alias("key"),
        F.col("_metadata.file_block_start").alias("block"),
        F.expr("decode(cast(value AS binary), 'ISO-8859-1')").alias("line"),
    )


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Array]]:
    """(key, block, lines) of consecutive lines of one block; a block may come in several runs."""
    for batch in batches:
        key, block = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        new = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0)) + 1
        for a, b in zip([0, *new], [*new, batch.num_rows]):
            if a < b:
                yield int(key[a]), int(block[a]), batch.column(2)[a:b]


def first_records(spark: SparkSession, path) -> DataFrame:
    """key, block, row, text of the first record of every file, where no cell holds a line break.

    Only the files' first blocks are looked at, and their lines no further than to the first
    that is not blank.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = set()
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            new = np.flatnonzero(np.diff(key) != 0) + 1
            for a, b in zip([0, *new], [*new, len(key)]):
                if a < b and int(key[a]) not in done:
                    lines = (line.as_py() for line in batch.column(2)[a:b])
                    if first := next((x for x in lines if x.strip()), None):
                        done.add(int(key[a]))
                        yield records_of(int(key[a]), 0, 0, pa.array([first]))

    lines = latin_lines(spark, path).where("block = 0").mapInArrow(found, RECORD)
    return lines.select("key", "block", "row", "text")


def records_of(key: int, block: int, row: int, texts: pa.Array) -> pa.RecordBatch:
    """Whole records of a block, numbered from `row`."""
    n = len(texts)
    columns = np.full(n, key), np.full(n, block), np.arange(row, row + n), np.full(n, WHOLE, dtype=np.int32)
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), texts], names=["key", "block", "row", "part", "text"])


def block_ends(lines: DataFrame) -> DataFrame:
    """key, block, from_outside, from_inside: whether the block ends inside quotes, for either begin."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, states = None, (False, True)
        for key, block, own in runs(batches):
            if at != (key, block):
                if at:
                    yield row(at, states)
                at, states = (key, block), (False, True)
            for line in pc.drop_null(own).to_pylist():
                states = tuple(inside_after(line, s) for s in states)
        if at:
            yield row(at, states)

    def row(at: tuple[int, int], states: tuple[bool, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([x]) for x in (*at, *states)], names=["key", "block", "from_outside", "from_inside"]
        )

    # lines without a quote change no state; only their place is of interest
    quoted = F.when(F.contains("line", F.lit(QUOTE)), F.col("line"))
    layout = "key long, block long, from_outside boolean, from_inside boolean"
    return lines.select("key", "block", quoted.alias("line")).mapInArrow(found, layout)


def blocks_inside(ends: DataFrame) -> DataFrame:
    """key, block of the blocks that begin inside quotes.

    A block that ends alike for both begins fixes the state; later ones that turn it are
    counted. One row per block of a file, in order.
    """
    before = W.partitionBy("key").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("key").orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    turns = F.col("from_outside") & ~F.col("from_inside")
    counted = ends.withColumn("turned", F.count_if(turns).over(upto))
    fixed = F.when(F.col("from_outside") == F.col("from_inside"), F.struct("from_outside", "turned"))
    last = counted.withColumn("last", F.last(fixed, ignorenulls=True).over(before)).withColumn(
        "so_far", F.coalesce(F.lag("turned").over(W.partitionBy("key").orderBy("block")), F.lit(0))
    )
    since = F.col("so_far") - F.coalesce(F.col("last.turned"), F.lit(0))
    start = F.coalesce(F.col("last.from_outside"), F.lit(False))
    return last.where(start != (since % 2 == 1)).select("key", "block")


def cut(lines: DataFrame, inside: list[tuple[int, int]]) -> DataFrame:
    """key, block, row, part, text: whole records, and pieces of those that cross a block's end."""
    spark = lines.sparkSession
    open_blocks = spark.sparkContext.broadcast(frozenset(inside))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, piece, state, row, headless = None, [], False, 0, False
        out: list[tuple] = []

        def end_of_block() -> None:
            if piece:
                out.append((*at, row, MIDDLE if headless else BEGIN, "\n".join(piece)))

        for key, block, own in runs(batches):
            if at != (key, block):
                end_of_block()
                at, piece, row = (key, block), [], 0
                state = headless = at in open_blocks.value
            lines = own.to_pylist()
            if not state and not piece and not pc.any(pc.match_substring(own, QUOTE)).as_py():
                # without a quote every line is a record
                filled = [bool(line.strip()) for line in lines]
                texts = own if all(filled) else own.filter(pa.array(filled))
                if len(texts):
                    yield records_of(key, block, row, texts)
                row += len(texts)
                continue
            for line in lines:
                if not state and not piece and not line.strip():
                    continue
                piece.append(line)
                state = inside_after(line, state)
                if not state:
                    out.append((key, block, row, END if headless else WHOLE, "\n".join(piece)))
                    piece, row, headless = [], row + 1, False
            if len(out) >= 4096:
                yield batch_of(out)
                out = []
        end_of_block()
        if out:
            yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        names = ["key", "block", "row", "part", "text"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return lines.mapInArrow(made, RECORD)


def stitched(pieces: DataFrame) -> DataFrame:
    """Records from their pieces; a record that never ends is taken to the file's end."""
    order = W.partitionBy("key").orderBy("block", "row")
    numbered = pieces.withColumn("number", F.count_if(F.col("part") == BEGIN).over(order))
    own = F.sort_array(F.collect_list(F.struct("block", "row", "text")))
    whole = numbered.groupBy("key", "number").agg(own.alias("own"))
    text = F.array_join(F.transform("own", lambda p: p["text"]), "\n")
    return whole.select("key", F.expr("own[0].block").alias("block"), F.expr("own[0].row").alias("row"), text.alias("text"))


def records(spark: SparkSession, path, quoted_breaks: bool) -> DataFrame:
    """key, block, row, text (as Latin-1) of every record; block 0, row 0 is a file's header.

    quoted_breaks: whether any cell may hold a line break. What the driver sends to all
    tasks is one pair of numbers for each block that begins inside a cell.
    """
    lines = latin_lines(spark, path)
    if not quoted_breaks:
        return cut(lines, []).select("key", "block", "row", "text")
    inside = blocks_inside(store(block_ends(lines), "block_ends")).collect()
    found = store(cut(lines, [(r["key"], r["block"]) for r in inside]), "records")
    whole = found.where(F.col("part") == WHOLE).select("key", "block", "row", "text")
    return whole.unionByName(stitched(found.where(F.col("part") != WHOLE)))


def header_names(header: str) -> list[str]:
    """Cells of a header record; a nameless one is called by its place, a repeated one gets it as a suffix.

    Empty if no cell has a name.
    """
    cells = next(csv.reader([header.replace("\n", " ")]), [])
    if not any(c.strip() for c in cells):
        return []
    lower = [c.lower() for c in cells]
    return [
        f"_c{i}" if not cell.strip() else f"{cell}{i}" if lower.count(cell.lower()) > 1 else cell
        for i, cell in enumerate(cells)
    ]


def cells_of(text: Column, count: int) -> Column:
    """The record as a struct of strings c0, c1, ...: missing cells are null, surplus ones dropped."""
    schema = ", ".join(f"c{i} string" for i in range(count))
    return F.from_csv(text, schema, {"escape": QUOTE, "multiLine": "true", "mode": "PERMISSIVE"})
