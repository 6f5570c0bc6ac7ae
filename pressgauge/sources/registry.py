"""Versions of a model: its tables and its record written together, made current by one rename.

A version's files lie in a folder of their own that nothing points to until its manifest has its final name. Manifests
are numbered; the largest is current. Renaming never replaces a file, so of two writers that take the same number one
fails and takes the next. A reader sees a whole version or the one before it; a write that breaks leaves nothing that
is ever read. The file system must rename atomically, as HDFS and local disks do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 10


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, folder: str, within: str = "manifests") -> list[int]:
    """The numbers of all versions, in order: the files or folders `within` that are called by a number."""
    path, files = _path(spark, f"{folder}/{within}" if within else folder), _files(spark, folder)
    if not files.exists(path):
        return []
    names = [status.getPath().getName() for status in files.listStatus(path)]
    return sorted(int(name) for name in names if name.isdigit())


def _rename(spark: SparkSession, source: str, target: str) -> bool:
    """Whether `source` got the name `target`; False if somebody has it."""
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_files(spark, source).getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    qualified = [_files(spark, p).makeQualified(_path(spark, p)) for p in (source, target)]
    try:
        context.rename(*qualified, none)
    except Exception as error:
        if "FileAlreadyExists" not in str(error):
            raise
        return False
    return True


def remove(spark: SparkSession, path: str) -> None:
    _files(spark, path).delete(_path(spark, path), True)


def claim(spark: SparkSession, folder: str, manifest: dict, number: int) -> bool:
    """Whether `manifest` became the one of that number; False if another writer has it."""
    files, draft = _files(spark, folder), f"{folder}/drafts/{uuid.uuid4().hex}"
    out = files.create(_path(spark, draft), False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    files.mkdirs(_path(spark, f"{folder}/manifests"))
    if _rename(spark, draft, f"{folder}/manifests/{number:0{DIGITS}d}"):
        return True
    remove(spark, draft)
    return False


def publish(spark: SparkSession, folder: str, tables: dict[str, DataFrame], record: dict) -> int:
    """Write tables and record as the next version and return its number."""
    name = uuid.uuid4().hex
    for table, rows in tables.items():
        rows.write.parquet(f"{folder}/versions/{name}/{table}")
    while True:
        number = (numbers(spark, folder) or [0])[-1] + 1
        if claim(spark, folder, {"version": name, "tables": sorted(tables), "record": record}, number):
            return number


def read_version(spark: SparkSession, folder: str, number: int | None = None) -> tuple[dict[str, DataFrame], dict] | None:
    """Tables and record of a version, the current one if no number is given; None if there is none."""
    known = numbers(spark, folder)
    if not known or (number is not None and number not in known):
        return None
    text = spark.read.text(f"{folder}/manifests/{number or known[-1]:0{DIGITS}d}", wholetext=True).first()[0]
    manifest = json.loads(text)
    tables = {t: spark.read.parquet(f"{folder}/versions/{manifest['version']}/{t}") for t in manifest["tables"]}
    return tables, manifest["record"]


def history(spark: SparkSession, folder: str, figure: str, decide) -> DataFrame:
    """version, its figure, and what to make of it next to the version before: decide(old, new) as a column."""
    known = numbers(spark, folder)
    rows = [(n, float(read_version(spark, folder, n)[1][figure])) for n in known]
    told = [(n, x, rows[k - 1][1] if k else None) for k, (n, x) in enumerate(rows)]
    frame = spark.createDataFrame(told, "version long, figure double, before double")
    decision: Column = decide(F.col("before"), F.col("figure"))
    return frame.withColumn("decision", F.when(F.col("before").isNotNull(), decision))
