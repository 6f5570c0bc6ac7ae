"""The day's allowance of web searches over micro-batches and restarts.

Each micro-batch numbers its own rows with the batch operator, which deals a busy day to many tasks, and goes on from
what earlier batches took of each day. Those counters are a table of one row a day under the batch's number. A batch
that is replayed after a failure reads the counters of the batch before it, so it hands out the same turns again and
replaces what it wrote. Only the counters of the last two batches are kept, and only days that are not over for long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pressgauge.operators.calibration import SEARCHES_PER_DAY
from pressgauge.operators.web import web_check_queue
from pressgauge.sources import registry

COUNTERS = "day date, taken long"
KEEP_DAYS = 7


def _taken(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    """The counters after the last batch before `batch`; at most KEEP_DAYS days and the row of no day."""
    earlier = [n for n in registry.numbers(spark, folder, "") if n < batch]
    if not earlier:
        return spark.createDataFrame([], COUNTERS)
    return spark.read.schema(COUNTERS).parquet(f"{folder}/{earlier[-1]:0{registry.DIGITS}d}")


def next_turns(
    analyzed: DataFrame,
    low: float | None,
    high: float | None,
    folder: str,
    batch: int,
    per_day: int = SEARCHES_PER_DAY,
    requested: str = "requested",
    keep_days: int = KEEP_DAYS,
) -> DataFrame:
    """web_check_queue of one micro-batch, its turns following those of all batches before it.

    Rows of days that ended `keep_days` or more before the newest day of earlier batches have no turn and are not
    within the allowance, as their counters are gone; they are not left out.
    """
    spark = analyzed.sparkSession
    before = _taken(spark, folder, batch)
    queue = web_check_queue(analyzed, low, high, per_day, requested).withColumn("__day", F.to_date("analyzed_at"))
    newest = before.agg(F.max("day")).first()[0]
    known = F.lit(True) if newest is None else F.coalesce(F.col("day") > F.date_sub(F.lit(newest), keep_days), F.lit(True))

    counts = queue.groupBy(F.col("__day").alias("day")).agg(F.count(F.lit(1)).alias("taken")).where(known)
    after = before.unionByName(counts).groupBy("day").agg(F.sum("taken").alias("taken"))
    last = F.date_sub(F.lit(after.agg(F.max("day")).first()[0]), keep_days)
    after = after.where(F.coalesce(F.col("day") > last, F.lit(True)))
    after.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{batch:0{registry.DIGITS}d}")
    for old in registry.numbers(spark, folder, "")[:-2]:
        registry.remove(spark, f"{folder}/{old:0{registry.DIGITS}d}")

    taken = spark.createDataFrame(before.collect(), COUNTERS)
    numbered = queue.withColumnRenamed("__day", "__d").join(
        F.broadcast(taken.select(F.col("day").alias("__day"), "taken")), F.col("__d").eqNullSafe(F.col("__day")), "left"
    )
    turn = F.when(known, (F.col("turn") + F.coalesce("taken", F.lit(0))).cast("int"))
    numbered = numbered.withColumnRenamed("__d", "day").withColumn("turn", turn)
    allowed = F.coalesce(F.col("turn") <= per_day, F.lit(False))
    return numbered.withColumn("within_allowance", allowed).drop("day", "__day", "taken")


def queue_stream(
    analyzed: DataFrame, queue_path: str, counters: str, checkpoint: str, low: float | None, high: float | None, **settings
) -> StreamingQuery:
    """Start writing the queue of arriving verdicts, one folder a micro-batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        turns = next_turns(batch, low, high, counters, batch_id, **settings)
        turns.write.mode("overwrite").parquet(f"{queue_path}/batch={batch_id}")

    return (
        analyzed.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
