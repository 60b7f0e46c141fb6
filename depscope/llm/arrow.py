"""Row-wise Python operators over Arrow batches, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from depscope.functions.columns import unused


def pieces(batches: Iterator[pa.RecordBatch], piece_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut to about ``piece_bytes`` each, one row at least."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            rows = max(1, int((batch.num_rows - start) * min(1.0, piece_bytes / max(1, batch.nbytes))))
            piece = batch.slice(start, min(rows, batch.num_rows - start))
            start += piece.num_rows
            yield piece


def add_columns(
    df: DataFrame,
    source: str,
    fields: list[tuple[str, T.DataType | str]],
    compute: Callable[[list], list[list]],
    drop: bool = False,
    piece_bytes: int = 8 << 20,
) -> DataFrame:
    """``df`` with columns that ``compute`` makes from the values of column ``source``.

    ``compute`` gets a list of values and returns a list for each field. A batch is cut
    so that about ``piece_bytes`` of values are in work at once. ``drop`` leaves out
    ``source``. Columns of ``df`` named as a field give way to it.
    """
    names = {n for n, _ in fields}
    kept = [c for c in df.columns if c not in names and not (drop and c == source)]
    chosen = df.select(*[f"`{c}`" for c in kept], F.col(f"`{source}`").alias(unused(df.columns, "__source")))
    schema = T.StructType([df.schema[c] for c in kept])
    for name, kind in fields:
        schema = schema.add(name, T.DataType.fromDDL(kind) if isinstance(kind, str) else kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        for piece in pieces(batches, piece_bytes):
            values = piece.column(piece.num_columns - 1).to_pylist()
            made = compute(values)
            arrays = [piece.column(i).cast(target.field(i).type) for i in range(len(kept))]
            arrays += [pa.array(v, type=target.field(len(kept) + i).type) for i, v in enumerate(made)]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return chosen.mapInArrow(run, schema)
