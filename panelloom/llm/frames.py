"""Small helpers on stored frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def side_of_join(stored: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table of narrow rows: broadcast if its rows were counted to be few, else as it is."""
    return F.broadcast(stored) if stored.count() <= most else stored


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under names of our own, which no internal column has, and the new name of each column."""
    names = {c: f"col{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def text_slices(batches: Iterator[pa.RecordBatch], size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Smaller batches of about `size` bytes of text, or one row; the text is the last column, without nulls."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(-1)).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, size + (ends[at - 1] if at else 0), "right"))
            to = max(to, at + 1)
            yield batch.slice(at, to - at)
            at = to
