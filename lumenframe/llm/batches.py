"""Row-batch plumbing shared by the Arrow operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows handed to Python at once inside an operator; a batch of very long texts stays small this way.
SLICE_ROWS = 256
#: Bytes of a slice, about, whatever its rows.
SLICE_BYTES = 16 << 20


#: Groups that hold more than this part of all rows are joined by broadcast: there are HOT at most.
HOT = 512


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, rows: int = SLICE_ROWS) -> DataFrame:
    """mapInArrow over small slices of each Arrow batch."""
    return df.mapInArrow(lambda it: fn(slices(it, rows)), schema)


def texts_of(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, hint: str | None = None) -> DataFrame:
    """rows with the columns of their group (keys, c rows, more); groups of over total / HOT rows, HOT at most, by broadcast.

    hint: how the other groups are joined; with shuffle_hash a task hashes its share of them and sorts no rows.
    """

    def hinted(groups: DataFrame) -> DataFrame:
        return groups.hint(hint) if hint else groups

    large = groups.where(F.col("c") * HOT > total)
    if large.isEmpty():
        return rows.join(hinted(groups.drop("c")), keys)
    rest = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(hinted(groups.where(F.col("c") * HOT <= total).drop("c")), keys)
    return rows.join(F.broadcast(large.drop("c")), keys).unionByName(rest)
