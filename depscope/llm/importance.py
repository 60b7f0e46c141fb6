"""Target-distribution importance resampling over hashed word n-grams.

A feature is a run of 1 to ``longest`` consecutive words, joined by a space; its bucket is the CRC-32 of
its UTF-8 bytes modulo ``buckets``. No feature's string is ever made: each word's CRC is computed once, all words of a
piece at a time, and CRCs of runs are composed from those of their words. CRC-32 is linear over GF(2): the CRC of a
followed by b is that of a, moved on by the length of b, XOR that of b. To move on by n bytes is a 32 x 32 bit
matrix, the product of the matrices for the powers of two in n.

All documents and all target texts are counted by bucket in their tasks. A bucket's gain is 1000 times the logarithm of its
smoothed share in the target over that in the documents, rounded down; a document's weight is the mean gain of its features, rounded
down; to this comes Gumbel noise from a hash of the document's id, and the highest scores are drawn, which is sampling
without replacement in proportion to the exponent of the weight. What reaches the driver and goes back to
tasks is one number for each bucket, as many as ``buckets`` says.

Only A-Z are lower-cased; a word is a run of digits, a-z and characters beyond ASCII. A null text is empty; a text
without words has weight 0 and no features. A null doc_id is hashed as the empty text. Equal rows have equal scores, and
each of them is a draw of its own; ties go to the smaller doc_id, null last. An empty table gives an empty result, an empty target
leaves all buckets with the smoothing alone. Very long texts are computed in their task, and a very long
word costs as many steps as it has bytes. Input columns called like a result column give way.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depscope.functions.columns import unused
from depscope.llm.arrow import add_columns, pieces
from depscope.operators.ranking import with_rank
from depscope.scratch import materialise

#: The polynomial of CRC-32 with its bits reversed, and the CRC of one space.
POLYNOMIAL = 0xEDB88320
SPACE = np.uint32(zlib.crc32(b" "))
#: Words of more bytes are handed to zlib one by one.
WIDE = 48
#: Lengths have so many bits at most.
LENGTH_BITS = 40


@lru_cache(maxsize=1)
def byte_table() -> np.ndarray:
    """The register after one byte, by the register's low byte XOR that byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


def product(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A matrix, given by its products with the 4 x 256 bytes of a column, times each of ``values``."""
    return table[0][values & 255] ^ table[1][(values >> 8) & 255] ^ table[2][(values >> 16) & 255] ^ table[3][values >> 24]


@lru_cache(maxsize=1)
def shift_tables() -> list[np.ndarray]:
    """For each k the matrix that moves a CRC on by 2^k bytes; each is the square of the one before."""
    places = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    tables = [byte_table()[places & 255] ^ (places >> 8)]
    while len(tables) < LENGTH_BITS:
        tables.append(product(tables[-1], tables[-1]))
    return tables


def moved(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC moved on by a length in bytes."""
    out, most = crcs.copy(), int(lengths.max(initial=0))
    for k, table in enumerate(shift_tables()):
        if most >> k == 0:
            break
        at = np.flatnonzero((lengths >> k) & 1)
        out[at] = product(table, out[at])
    return out


def joined(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRCs of runs of words, a space and another word each, from the CRCs of both; ``lengths`` are the other words'."""
    return moved(product(shift_tables()[0], first) ^ SPACE, lengths) ^ second


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """The byte itself if it belongs to a word, of A-Z the lower case; 0 for all others."""
    keep = np.zeros(256, np.uint8)
    for low, high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        keep[low : high + 1] = np.arange(low, high + 1)
    keep[0x41:0x5B] = np.arange(0x61, 0x7B)
    return keep


def word_crcs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC-32 of each word in ``data``, byte place by byte place for all words that are so long."""
    order = np.argsort(-lengths, kind="stable")
    begin, size, table = starts[order], lengths[order], byte_table()
    register = np.full(len(order), 0xFFFFFFFF, np.uint32)
    wide = int(np.searchsorted(-size, -WIDE, side="left"))
    for k in range(int(size[wide]) if wide < len(size) else 0):
        end = int(np.searchsorted(-size, -k, side="left"))
        part = slice(wide, end)
        register[part] = table[(register[part] ^ data[begin[part] + k]) & 255] ^ (register[part] >> 8)
    out = np.empty(len(order), np.uint32)
    out[order] = ~register
    for k in order[:wide]:
        out[k] = zlib.crc32(data[starts[k] : starts[k] + lengths[k]])
    return out


def features(texts: list[str | None], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Words of each text, the text of each word, and by length of run from 1 the bucket of the run that begins at each word, or -1."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = letters()[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    inside = np.concatenate(([False], data != 0))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    text_ends = np.cumsum([len(r) + 1 for r in raw])
    text_of = np.searchsorted(text_ends, starts, side="right")
    crcs, made = word_crcs(data, starts, lengths), []
    run = crcs
    for n in range(1, longest + 1):
        if n > 1:
            run = joined(run[:-1], crcs[n - 1 :], lengths[n - 1 :]) if len(crcs) >= n else run[:0]
        out = np.full(len(crcs), -1, np.int64)
        whole = text_of[: len(run)] == text_of[n - 1 : n - 1 + len(run)]
        out[: len(run)][whole] = (run % np.uint32(buckets))[whole]
        made.append(out)
    return np.bincount(text_of, minlength=len(texts)), text_of, made


def bucket_counts(texts: DataFrame, text: str, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts lie in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for piece in pieces(batches):
            for made in features(piece.column(0).to_pylist(), longest, buckets)[2]:
                total += np.bincount(made[made >= 0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    found = texts.select(F.col(f"`{text}`").alias("x")).where("x IS NOT NULL").mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in found.groupBy("bucket").agg(F.sum("n")).collect():  # a row for each bucket
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of each bucket's share in the target over that in the source, rounded down."""
    more = float(len(source))
    over, under = (target + 1.0) * (source.sum() + more), (source + 1.0) * (target.sum() + more)
    return np.floor(1000 * np.log(over / under)).astype(np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise from the first 32 bits of a hash of the id, times 1000 and rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    target_text: str = "text",
    share: tuple[int, int] = (25, 100),
    longest: int = 2,
    buckets: int = 10_000,
    least_words: int = 20,
    seed: int = 7,
) -> DataFrame:
    """``docs`` without its text, with n_features, weight, score and rank.

    Of the documents with ``least_words`` words or more, ``share`` is drawn, rounded down; rank counts them from 1
    by falling score, and is null for all others.
    """
    docs = docs.drop(*(c for c in ("n_features", "weight", "score", "rank") if c not in (text, doc_id)))
    known = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets))

    def compute(values: list[str | None]) -> list[list]:
        words, text_of, made = features(values, longest, buckets)
        n, total = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
        for at in made:
            whole = at >= 0
            np.add.at(n, text_of[whole], 1)
            np.add.at(total, text_of[whole], known[at[whole]])
        return [words.tolist(), n.tolist(), np.where(n > 0, total // np.maximum(n, 1), 0).tolist()]

    words = unused(docs.columns, "__words")
    fields = [(words, "long"), ("n_features", "long"), ("weight", "long")]
    weighed = add_columns(docs, text, fields, compute, drop=True)
    id_column = F.col(f"`{doc_id}`")
    scored = materialise(weighed.withColumn("score", F.col("weight") + noise(id_column, seed)), "importance")
    enough = scored.where(F.col(f"`{words}`") >= least_words)
    ranked, count = with_rank(enough, [-F.col("score"), id_column.isNull(), id_column, F.monotonically_increasing_id()])
    drawn = share[0] * count // share[1]
    ranked = ranked.withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    rest = scored.where(F.col(f"`{words}`") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop(words)
