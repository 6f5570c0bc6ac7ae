"""Records of CSV files whose quoted fields hold newlines, read by many tasks from one file.

A line may end a record or lie inside quotes; which of them, only the lines before it tell. So files are read in the
byte ranges that Spark cuts them into, three times, and only what crosses a border is shuffled:

1. each range tells, for both states its first line can be in, the state its last line leaves and the records that
   start in it;
2. the answers of a file's ranges, one row a range, are chained in order: now every range knows the state it starts in
   and the number of its first record;
3. each range gives the records that lie in it whole, and (in another pass) the pieces of those that cross its borders,
   which are put together by record number.

Records end with \\n or \\r\\n outside quotes. A field is quoted if it starts with a quote, a doubled quote inside stands
for one, and what follows a closing quote belongs to the field up to the next comma. Lines without anything between
records are not records. Bytes that are not UTF-8 become U+FFFD. A quote that is never closed takes the rest of its file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.session import cut_lineage


def still_open(line: bytes, inside: bool) -> bool:
    """Whether a line that starts inside quotes (or at a record's start) leaves a quoted field open."""
    at = 0
    while True:
        if not inside and line[at : at + 1] == b'"':
            inside, at = True, at + 1
        if inside:
            at = line.find(b'"', at)
            while at >= 0 and line[at + 1 : at + 2] == b'"':
                at = line.find(b'"', at + 2)
            if at < 0:
                return True
            inside, at = False, at + 1
        at = line.find(b",", at)
        if at < 0:
            return False
        at += 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """path, start (of the byte range) and line, in order inside each range."""
    read = spark.read.option("lineSep", "\n").text(path)
    return read.select(_bare(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")


def _bare(path: Column) -> Column:
    return F.regexp_replace(path, _SCHEME, "/")


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:/*"


def _blank(line: bytes) -> bool:
    return line in (b"", b"\r")


_TRANSFER = "path string, start bigint, closed_opens boolean, closed_records bigint, open_opens boolean, open_records bigint"


def _transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range and both first states: the state after it, and the records that start in it."""
    where, state, count = None, [False, True], [0, 0]

    def told() -> pa.RecordBatch:
        values = (*where, state[0], count[0], state[1], count[1])
        types = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64())
        names = [part.split()[0] for part in _TRANSFER.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

    for batch in batches:
        rows = zip(batch["path"].to_pylist(), batch["start"].to_pylist(), batch["value"].cast(pa.binary()).to_pylist(), strict=True)
        for path, start, line in rows:
            if (path, start) != where:
                if where is not None:
                    yield told()
                where, state, count = (path, start), [False, True], [0, 0]
            blank = _blank(line)
            for k in (0, 1):
                if not state[k] and not blank:
                    count[k] += 1
            if b'"' in line:
                state = [still_open(line, s) for s in state]
    if where is not None:
        yield told()


_STARTS = "path string, start bigint, inside boolean, first bigint, opened boolean, records bigint"


def _chain(ranges: pd.DataFrame) -> pd.DataFrame:
    """The state and record number with which each range of one file starts, and the file's records."""
    inside, first, out = False, 0, []
    for r in ranges.sort_values("start").itertuples():
        after, records = (r.open_opens, r.open_records) if inside else (r.closed_opens, r.closed_records)
        out.append((r.path, r.start, inside, first, after))
        inside, first = bool(after), first + int(records)
    return pd.DataFrame(out, columns=["path", "start", "inside", "first", "opened"]).assign(records=first)


_RECORDS = "file bigint, number bigint, start bigint, text string"


def _cut(whole: bool):
    """The records that lie in their range (`whole`), or the pieces of those that cross borders."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        where, inside, number, held, ours = None, False, 0, [], True

        def close(ends: bool) -> None:
            """The held lines are a record, or (not `ends`) the beginning or middle of one that goes on."""
            if held and (ours and ends) == whole:
                out.append((where[0], number, where[1], b"\n".join(held)))
            held.clear()

        for batch in batches:
            columns = [batch[name].to_pylist() for name in ("file", "start", "inside", "first")]
            for file, start, open_, first, line in zip(*columns, batch["value"].cast(pa.binary()).to_pylist(), strict=True):
                if (file, start) != where:
                    close(not inside)
                    if first is None:
                        raise RuntimeError("the byte ranges of the files changed between passes: set spark.sql.files.minPartitionNum")
                    # a record that an earlier range began has the number before this range's first
                    where, inside, number, ours = (file, start), open_, first - 1, not open_
                if not inside:
                    if _blank(line):
                        continue
                    number, ours = number + 1, True
                held.append(line)
                if b'"' in line:
                    inside = still_open(line, inside)
                if not inside:
                    close(True)
            if out:
                yield _as_batch(out)
                out.clear()
        close(not inside)
        if out:
            yield _as_batch(out)

    return cut


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    files, numbers, starts, texts = zip(*rows, strict=True)
    decoded = [t.decode("utf-8", "replace") for t in texts]
    arrays = [pa.array(files, pa.int64()), pa.array(numbers, pa.int64()), pa.array(starts, pa.int64()), pa.array(decoded, pa.string())]
    return pa.RecordBatch.from_arrays(arrays, ["file", "number", "start", "text"])


def read_records(spark: SparkSession, path: str, one_table: bool = False) -> DataFrame:
    """file (its rank by name), number (of the record in its file, from 0) and text of every record.

    one_table: the files are the parts of one table, each below its own header. They count as one file: the first part's
    header is record 0, the others' are left out, and records are numbered through in the order of the files' names.

    What is broadcast is one short row for each byte range, less than the list of files and ranges that the driver
    keeps for any scan.
    """
    lines = _lines(spark, path)
    files = sorted(re.sub(_SCHEME, "/", name) for name in lines.inputFiles())
    ranks = spark.createDataFrame(list(zip(files, range(len(files)), strict=True)), "path string, file bigint")
    starts = lines.mapInArrow(_transfers, _TRANSFER).groupBy("path").applyInPandas(_chain, _STARTS)
    starts = cut_lineage(starts.join(F.broadcast(ranks), "path"))
    placed = lines.join(F.broadcast(starts), ["path", "start"], "left").select("file", "start", "inside", "first", "value")
    whole = placed.mapInArrow(_cut(True), _RECORDS).select("file", "number", "text")
    # most ranges of a file with few long fields have pieces, but each has two at most
    pieces = placed.mapInArrow(_cut(False), _RECORDS).groupBy("file", "number")
    joined = pieces.agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("pieces")).select(
        "file", "number", F.concat_ws("\n", F.col("pieces.text")).alias("text")
    )
    read = whole.unionByName(joined)
    if one_table:
        before, at = [], 0
        for file, count in sorted(tuple(r) for r in starts.select("file", "records").distinct().collect()):
            before.append((file, at))
            at += max(count - 1, 0)
        places = F.broadcast(spark.createDataFrame(before, "file bigint, before bigint"))
        read = read.filter("number > 0 or file = 0").join(places, "file")
        read = read.select(F.lit(0).cast("bigint").alias("file"), (F.col("number") + F.col("before")).alias("number"), "text")
    # in a file with \r\n at the ends of records, the lines inside a field end the same way
    plain = F.regexp_replace(F.expr("substring(text, 1, length(text) - 1)"), "\r\n", "\n")
    return read.withColumn("text", F.when(F.col("text").endswith("\r"), plain).otherwise(F.col("text")))


def position() -> Column:
    """A number that grows with the file's name, then with the place in the file."""
    return F.shiftleft(F.col("file"), 33) + F.col("number")


def fields(text: Column, names: list[str], broken: str | None = None) -> Column:
    """The fields of a record as strings by name; `broken` holds the record if it has more or fewer."""
    quoted = ["`" + name.replace("`", "``") + "` string" for name in [*names, *([broken] if broken else [])]]
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    if broken:
        options["columnNameOfCorruptRecord"] = broken
    return F.from_csv(text, ", ".join(quoted), options)
