"""Analyse requests as they arrive.

Gate, lookup and cascade are stateless per request, so each micro-batch runs the
batch operators against the stored corpus and is appended to the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pressgauge.functions.intake import gate
from pressgauge.functions.matching import split_paste
from pressgauge.operators.report import history_rows
from pressgauge.operators.verdict import analyze
from pressgauge.sources.index import read_index
from pressgauge.sources.store import append_history, read_corpus

REQUESTS = "id long, text string, submitted_at timestamp"


def read_requests(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(REQUESTS).json(folder)


def analyze_stream(
    requests: DataFrame, corpus_path: str, history_path: str, checkpoint: str, index_folder: str | None = None, **cascade
) -> StreamingQuery:
    """Start appending verdicts to the history, under the batch's name, so that a batch
    replayed after a failure replaces its rows instead of repeating them. With the folder of a
    stored index each batch joins its current version, and the corpus is not read at all."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        accepted, _ = gate(batch, "text")
        pasted = accepted.withColumn("p", split_paste(F.col("text"))).select("id", "p.*", "submitted_at")
        stored = read_index(batch.sparkSession, index_folder) if index_folder else None
        corpus = read_corpus(batch.sparkSession, corpus_path) if stored is None else None
        rows = history_rows(analyze(pasted, corpus, index=stored and stored[:2], **cascade), F.col("submitted_at"))
        append_history(rows, history_path, f"stream-{batch_id}")

    return (
        requests.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
