"""A stored index of the corpus: the best match of every headline key and every opening key.

    data/<name>         one version's rows (kind, key, match) in `buckets` buckets by kind and key, sorted inside
    manifests/<number>  one JSON object a version: its data, buckets, and the number of corpus rows behind it

Requests join it bucket by bucket: they are dealt by key, the index is read where it lies, with neither a shuffle nor
a new search for the best match. A top-up joins only its own new rows in, by the same buckets. A version counts once
its manifest has its number, which is claimed by a rename that never replaces a file; of two top-ups at once the
slower starts again from the faster one's version, so none is lost. A batch that is in is not added again.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.operators.verdict import KINDS, corpus_index, match_rank
from pressgauge.sources import registry


class StoredIndex(NamedTuple):
    rows: DataFrame  # kind, key, match
    held: int  # corpus rows behind it
    number: int


def _manifest(spark: SparkSession, folder: str, number: int) -> dict:
    path = f"{folder}/manifests/{number:0{registry.DIGITS}d}"
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _table(spark: SparkSession, folder: str, manifest: dict) -> DataFrame:
    """The rows as a bucketed table; a session that does not know it yet is told where it lies."""
    name = f"corpus_index_{manifest['data']}"
    if not spark.catalog.tableExists(name):
        place = f"{folder}/data/{manifest['data']}".replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({manifest['columns']}) USING parquet "
            f"CLUSTERED BY (kind, key) SORTED BY (kind, key) INTO {manifest['buckets']} BUCKETS LOCATION '{place}'"
        )
    return spark.table(name)


def read_index(spark: SparkSession, folder: str, number: int | None = None) -> StoredIndex | None:
    """The current version, or that of a number; None if there is none."""
    known = registry.numbers(spark, folder)
    if not known or (number is not None and number not in known):
        return None
    manifest = _manifest(spark, folder, number or known[-1])
    return StoredIndex(_table(spark, folder, manifest), manifest["held"], number or known[-1])


def merged(held: DataFrame, fresh: DataFrame) -> DataFrame:
    """The best matches of both. Each task has the held rows of one bucket, and writes that bucket again."""
    both = held.join(fresh.withColumnRenamed("match", "__new"), ["kind", "key"], "full_outer")
    new, old = F.col("__new"), F.col("match")
    better = new.isNotNull() & (old.isNull() | (match_rank(new) < match_rank(old)))
    return both.select("kind", "key", F.when(better, new).otherwise(old).alias("match"))


def add_to_index(new_rows: DataFrame, folder: str, batch: str, buckets: int = 200) -> StoredIndex:
    """Add corpus rows (with their ids) under the name `batch`, as the next version. `buckets` counts for the first only.

    Of equal keys the better evidence stays, then the older id. Rows without keys add to the number held alone.
    """
    spark = new_rows.sparkSession
    fresh = corpus_index(new_rows, KINDS)
    added = new_rows.count()
    while True:
        known = registry.numbers(spark, folder)
        before = _manifest(spark, folder, known[-1]) if known else {"buckets": buckets, "held": 0}
        if known and not spark.read.schema("batch string").json(f"{folder}/manifests").where(F.col("batch") == batch).isEmpty():
            return read_index(spark, folder)
        rows, number = fresh, (known or [0])[-1] + 1
        rows = merged(_table(spark, folder, before), fresh) if known else fresh.repartition(buckets, "kind", "key")
        data = uuid.uuid4().hex
        place, name, count = f"{folder}/data/{data}", f"corpus_index_{data}", before["buckets"]
        writer = rows.write.bucketBy(count, "kind", "key").sortBy("kind", "key").option("path", place)
        writer.saveAsTable(name)
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.table(name).schema)
        manifest = {
            "data": data,
            "buckets": count,
            "columns": columns,
            "held": before["held"] + added,
            "batch": batch,
        }
        if registry.claim(spark, folder, manifest, number):
            return StoredIndex(spark.table(name), manifest["held"], number)
        spark.sql(f"DROP TABLE {name}")
        registry.remove(spark, place)
