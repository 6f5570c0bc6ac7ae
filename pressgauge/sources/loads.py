"""A corpus that several writers top up at once.

    data/part=<name>    rows of one load, numbered from 0 in load order (place); they have no ids yet
    manifests/<number>  one JSON object a load: its batch, part, first id and number of rows

A load reads the corpus as of some manifest, works out its rows against it and takes the next number by a rename that
never replaces a file. If another writer took that number first, the rows may hold headlines that are held by now, so
the load starts again from the corpus as it then is. The id range lies in the manifest: ids never meet, and a part that
got no manifest is never read. A batch that has a manifest is not loaded again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.operators.corpus import CORPUS_SCHEMA
from pressgauge.operators.ordered import number_rows
from pressgauge.sources import registry

ENTRY = "batch string, part string, first_id long, rows long"
COLUMNS = [c.split()[0] for c in CORPUS_SCHEMA.split(", ")]
ROWS = ", ".join(c for c in CORPUS_SCHEMA.split(", ") if not c.startswith("id ")) + ", place long, part string"


def entries(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """number, batch, part, first_id and rows of every load, up to manifest `version` if one is given."""
    known = registry.numbers(spark, folder)
    if not known:
        return spark.createDataFrame([], f"number long, {ENTRY}")
    read = spark.read.schema(ENTRY).json(f"{folder}/manifests")
    found = read.select(F.col("_metadata.file_name").cast("long").alias("number"), "*")
    return found.where(F.col("number") <= (known[-1] if version is None else version))


def read_loaded(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The corpus as of manifest `version`, of now if none is given."""
    if not registry.numbers(spark, folder):
        return spark.createDataFrame([], CORPUS_SCHEMA)
    rows = spark.read.schema(ROWS).parquet(f"{folder}/data")
    loads = entries(spark, folder, version).select("part", "first_id")
    return rows.join(loads, "part").withColumn("id", F.col("first_id") + F.col("place")).select(*COLUMNS)


def load(spark: SparkSession, folder: str, batch: str, new_rows: Callable[[DataFrame], DataFrame]) -> dict:
    """Add what `new_rows` makes of the corpus held, as top_up gives it, and return the load's entry.

    `new_rows` is called again whenever another writer was faster. Of two loads of one batch the later does nothing.
    """
    while True:
        version = (registry.numbers(spark, folder) or [0])[-1]
        done = entries(spark, folder, version)
        mine = done.where(F.col("batch") == batch).first()
        if mine is not None:
            return mine.asDict()
        order = F.shiftleft(F.col("file_no").cast("long"), 56) + F.col("pos")
        ordered = new_rows(read_loaded(spark, folder, version)).withColumn("__order", order)
        part = f"p-{uuid.uuid4().hex}"
        path = f"{folder}/data/part={part}"
        numbered = number_rows(ordered, "__order", "place")
        numbered.select(*[c for c in COLUMNS if c != "id"], F.col("place").cast("long")).write.parquet(path)
        last = done.agg(F.max(F.col("first_id") + F.col("rows"))).first()[0]
        entry = {"batch": batch, "part": part, "first_id": last or 1, "rows": spark.read.parquet(path).count()}
        if registry.claim(spark, folder, entry, version + 1):
            return {"number": version + 1, **entry}
        registry.remove(spark, path)
