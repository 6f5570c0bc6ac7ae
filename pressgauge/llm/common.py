"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.session import checkpoint_folder, cut_lineage, read_table

# The six characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

# Texts are worked through in pieces of about this many bytes, so a task's memory does not follow
# the number of rows in an Arrow batch. A single longer text is still taken whole.
PIECE_BYTES = 4_000_000

__all__ = [
    "BLANKS",
    "WORD",
    "cut_lineage",
    "doc_text",
    "hash_sample",
    "map_arrow",
    "pieces",
    "share_for",
    "stored",
    "strings",
    "table",
    "unit_hash",
    "utf8_buffer",
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """`df` as a compressed table in the cluster's shared checkpoint folder: for rows too wide for a checkpoint,
    which is not compressed. It survives lost executors, as a checkpoint does."""
    path = f"{checkpoint_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def doc_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), and `more`; other columns stay behind, whatever they are called."""
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def share_for(most: int, of: Column) -> Column:
    """The share of hashes to keep of `of` values so that `most` of them are nearly surely among them."""
    return F.lit(float(most + 6 * math.sqrt(most) + 20)) / F.greatest(of, F.lit(1))


def unit_hash(column: str) -> Column:
    """A number from 0 up to 1 that depends on the value alone."""
    return F.shiftrightunsigned(F.xxhash64(column), 11) / F.lit(float(2**53))


def hash_sample(rows: DataFrame, column: str, most: int) -> DataFrame:
    """At most `most` different rows, those of the smallest hash of `column`.

    A count tells how small hashes must be, so little more than `most` rows meet in the task that ranks them.
    """
    few = rows.where(unit_hash(column) < share_for(most, F.lit(rows.count()))).distinct()
    return few.orderBy(unit_hash(column), column).limit(most)


def strings(column: pa.Array) -> list[str]:
    """Python strings of a text column; bytes that are not UTF-8 become U+FFFD."""
    try:
        return ["" if x is None else x for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [(x or b"").decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def utf8_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column without nulls, end to end, and the n + 1 offsets of its rows."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose texts hold about `most` bytes; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    ends = utf8_buffer(batch.column(batch.schema.get_field_index(column)))[1][1:]
    start, before = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(start, stop - start)
        start, before = stop, int(ends[stop - 1])


def map_arrow(
    df: DataFrame,
    schema: str,
    work: Callable[[pa.RecordBatch], dict],
    text: str = "text",
    setup: Callable | None = None,
    most: int = PIECE_BYTES,
) -> DataFrame:
    """`work` over slices of the rows in Arrow form; it answers with columns by name.

    `setup`, if given, runs once in each task and its result is work's second argument.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (setup(),) if setup else ()
        for batch in batches:
            for piece in pieces(batch, text, most):
                found = work(piece, *state)
                if found is not None:
                    yield pa.RecordBatch.from_pydict(found)

    return df.mapInArrow(run, schema)
