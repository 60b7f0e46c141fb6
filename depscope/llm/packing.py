"""Packing documents into sequences by the sum-of-squares rule.

A document's ids, with an end id behind, are cut into pieces of ``capacity`` only if they
are longer; the first piece takes what is left over. Full pieces are sequences of their own.
A shorter piece goes where the sum of the squared counts of open sequences per residual gap
becomes smallest: into an open sequence, or into a new one. Ties go to the smallest gap.
At the end the pieces of the sequences that are still open are placed anew, longest first
and each in the tightest gap, if that takes fewer sequences.

Pieces are written to the shared folder first, so a lost task packs the same pieces in the
same order again. Each task packs a bounded share of them.

Defined results: a null text is empty and is a piece with the end id alone; repeated rows are
packed each; an empty table gives an empty result. With ``ordered`` documents are packed in the
order in which their table was written, and sequences are numbered along it. A very long text is cut into its pieces in one
task. Input columns called piece, start, length, ids_crc32, ids, sequence_id or offset give way; any other column may have any name.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from depscope.functions.columns import unused
from depscope.llm.arrow import add_columns
from depscope.llm.order import with_order
from depscope.llm.tokens import encoder
from depscope.scratch import materialise

END_ID = 2

PIECE = T.StructType(
    [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)

#: Columns of a result, which input columns of their names give way to.
RESULT = [*PIECE.names, "sequence_id", "offset"]


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, bytes]]:
    """(piece, start, ids) of a document's packed ids."""
    count = len(ids) // 4
    first = count - capacity * max(0, -(-count // capacity) - 1)
    start, end, k = 0, first, 0
    while start < count:
        yield k, start, ids[4 * start : 4 * end]
        start, end, k = end, end + capacity, k + 1


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, text: str = "text", with_ids: bool = False) -> DataFrame:
    """``docs`` without its text, a row for each piece: piece, start, length, ids_crc32 and,
    if asked for, ids (little-endian unsigned 32-bit)."""
    end = END_ID.to_bytes(4, "little")

    def compute(values: list[str | None]) -> list[list]:
        out = []
        for ids in encoder(tokenizer_path).ids([v or "" for v in values]):
            made = [(k, s, len(b) // 4, zlib.crc32(b), b if with_ids else None) for k, s, b in cut(ids + end, capacity)]
            out.append([dict(zip(PIECE.names, m, strict=True)) for m in made])
        return [out]

    cut_up, x = unused(docs.columns, "__pieces"), unused(docs.columns, "__x")
    made = add_columns(docs, text, [(cut_up, T.ArrayType(PIECE))], compute, drop=True)
    names = PIECE.names if with_ids else PIECE.names[:-1]
    kept = [f"`{c}`" for c in made.columns if c not in (cut_up, *PIECE.names)]
    return made.select(*kept, F.explode(cut_up).alias(x)).select(*kept, *[F.col(f"{x}.{n}").alias(n) for n in names])


class SumOfSquares:
    """Open sequences by residual gap, and where the next piece goes."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[int]] = {}
        self.sequences = 0

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of ``size``, 1 to the capacity."""
        n, cap = self.counts, self.capacity
        # taking a gap g leaves the gap g - size: the change of the sum is 2 (n[g-size] - n[g]) + 2
        change = n[: cap + 1 - size] - n[size:] + 1
        change[0] = -n[size]  # a filled sequence counts nowhere: the change is 1 - 2 n[g]
        cost = 2 * change
        cost[0] += 1
        gaps = n[size:] > 0
        cost[~gaps] = np.iinfo(np.int64).max
        cost[-1] = 2 * n[cap - size] + 1 if size < cap else 0
        gap = size + int(cost.argmin())
        if gap == cap:
            sequence, self.sequences = self.sequences, self.sequences + 1
        else:
            sequence = self.open[gap].pop()
            n[gap] -= 1
        if gap > size:
            self.open.setdefault(gap - size, []).append(sequence)
            n[gap - size] += 1
        return sequence, cap - gap


def assign(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece."""
    rule = SumOfSquares(capacity)
    places = np.array([rule.place(s) for s in sizes.tolist()], np.int64).reshape(-1, 2)
    still_open = np.array(sorted(s for own in rule.open.values() for s in own), np.int64)
    moved = np.nonzero(np.isin(places[:, 0], still_open))[0]
    moved = moved[np.argsort(-sizes[moved], kind="stable")]
    fresh, count = tightest(sizes[moved].tolist(), capacity)
    if count < len(still_open):
        places[moved] = fresh
        places[moved, 0] = still_open[fresh[:, 0]]
    return places[:, 0], places[:, 1]


def tightest(sizes: list[int], capacity: int) -> tuple[np.ndarray, int]:
    """(sequence, offset) of each size in order, each in the smallest gap that holds it."""
    gaps: list[tuple[int, int]] = []
    places, count = np.zeros((len(sizes), 2), np.int64), 0
    for k, size in enumerate(sizes):
        at = bisect.bisect_left(gaps, (size, -1))
        if at == len(gaps):
            gap, sequence, count = capacity, count, count + 1
        else:
            gap, sequence = gaps.pop(at)
        places[k] = sequence, capacity - gap
        if gap > size:
            bisect.insort(gaps, (gap - size, sequence))
    return places, count


def in_shares(table: DataFrame, tasks: int, file: str, row: str) -> DataFrame:
    """``table`` in ``tasks`` partitions that follow the order of ``file``, ``row`` and piece."""
    name, start, at = (unused(table.columns, c) for c in ("__name", "__start", "__at"))
    rows, before, starts = table.groupBy(file).agg(F.max(row)).orderBy(file).collect(), 0, []  # a row for each file
    for one, last in rows:
        starts.append((one, before))
        before += last + 1
    known = table.sparkSession.createDataFrame(starts, f"{name} string, {start} long")
    placed = table.join(F.broadcast(known), F.col(file) == F.col(name)).withColumn(at, F.col(start) + F.col(row))
    share = F.floor(F.col(at) * tasks / max(1, before)).cast("int")
    return placed.repartitionById(tasks, share).sortWithinPartitions(at, "piece").drop(at, start, name)


def pack(table: DataFrame, capacity: int = 1024, per_task: int = 1 << 16, order: tuple[str, str] | None = None) -> DataFrame:
    """``table``, a written table of pieces with length, with sequence_id and offset.

    With ``order``, two of its columns that go, pieces are packed and sequences numbered in their order.
    """
    schema = T.StructType(
        [f for f in table.schema if f.name not in ("sequence_id", "offset", *(order or ()))]
        + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )
    names, part = schema.names[:-2], unused(table.columns, "__part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, share in enumerate(grouped(batches, per_task)):
            first = (share.column(len(names))[0].as_py() << 40) + (k << 20)
            sequences, offsets = assign(share.column("length").to_numpy(), capacity)
            made = [*share.columns[: len(names)], pa.array(first + sequences), pa.array(offsets)]
            yield from pa.Table.from_arrays(made, schema=schema_of).combine_chunks().to_batches()

    schema_of = to_arrow_schema(schema)
    tasks = max(1, round(table.count() / per_task))
    dealt = in_shares(table, tasks, *order) if order else table.coalesce(tasks)
    return dealt.select(*[f"`{c}`" for c in names], F.spark_partition_id().alias(part)).mapInArrow(run, schema)


def grouped(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Tables of about ``most`` rows, in order."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= 2 * most:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def packed_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 1024,
    text: str = "text",
    with_ids: bool = False,
    ordered: bool = False,
) -> DataFrame:
    """The pieces of ``docs`` with their sequences and offsets."""
    order = None
    if ordered:
        docs, *order = with_order(docs.drop(*(c for c in RESULT if c in docs.columns and c != text)))
    return pack(materialise(pieces(docs, tokenizer_path, capacity, text, with_ids), "packing-pieces"), capacity, order=order)
