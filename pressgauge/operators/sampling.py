"""Deterministic splits and samples: membership depends on md5(seed-id) only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressgauge.operators.ordered import number_rows
from pressgauge.session import cut_lineage

SPLIT_SEED = 42  # fixed value
TICKET_DIGITS = 32
DIGITS = 2  # of a ticket that are told apart at a time: 256 bins for each group
RANKED_ROWS = 1_000  # tickets of a group that are ranked in one task
BROADCAST_GROUPS = 10_000  # one short row a group is sent to every task, up to so many groups


def ticket(row_id: Column, seed: int = SPLIT_SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), row_id.cast("string")))


def first_per_group(df: DataFrame, group: str, row_id: str, quota: Column, seed: int, out: str) -> DataFrame:
    """Flag the `quota` rows of each group with the smallest tickets.

    `quota` is an expression over the group's row count, `group_size`. The ticket at which the quota ends is found
    digit by digit: tickets that begin as it does are counted by their next DIGITS digits, and of these bins, a fixed
    number for each group, only the one in which the quota ends goes on. Once a group has few tickets left they are
    ranked; the flag itself is a comparison with the ticket found. Rows stay in the tasks they are in unless there are
    many groups: dealt out by a few groups, they would all meet in as many tasks.
    """
    slim = df.select(group, ticket(F.col(row_id), seed).alias("t")).filter(F.col(group).isNotNull())
    sizes = slim.groupBy(group).agg(F.count(F.lit(1)).alias("group_size"))
    edge = sizes.select(
        group, F.lit("").alias("prefix"), F.least(quota, F.col("group_size")).cast("bigint").alias("take"), F.col("group_size").alias("n")
    )
    edge = cut_lineage(edge.filter("take > 0"))
    few = edge.count() <= BROADCAST_GROUPS
    each = F.broadcast if few else (lambda rows: rows)
    per_group = Window.partitionBy(group)
    while True:
        wide = (F.col("n") > RANKED_ROWS) & (F.length("prefix") < TICKET_DIGITS)
        if edge.filter(wide).isEmpty():
            break
        open_ = slim.join(each(edge.filter(wide)), group).filter(F.col("t").startswith(F.col("prefix")))
        bins = open_.groupBy(group, F.expr(f"substring(t, 1, length(prefix) + {DIGITS})").alias("prefix")).agg(
            F.count(F.lit(1)).alias("n"), F.first("take").alias("take")
        )
        bins = bins.withColumn("take", F.col("take") - F.sum("n").over(per_group.orderBy("prefix")) + F.col("n"))
        ended = bins.filter((F.col("take") > 0) & (F.col("take") <= F.col("n"))).select(group, "prefix", "take", "n")
        edge = cut_lineage(edge.filter(~wide).unionByName(ended))
    last = (
        slim.join(each(edge), group)
        .filter(F.col("t").startswith(F.col("prefix")))
        .withColumn("rank", F.row_number().over(per_group.orderBy("t")))
        .filter(F.col("rank") == F.col("take"))
        .select(group, F.col("t").alias("__last"))
    )
    flag = F.coalesce(ticket(F.col(row_id), seed) <= F.col("__last"), F.lit(False))
    return df.join(each(last), group, "left").withColumn(out, flag).drop("__last")


def stratified_split(
    df: DataFrame, label: str, row_id: str, fraction: float, seed: int = SPLIT_SEED, out: str = "held"
) -> DataFrame:
    """Flag `fraction` of every label's rows (rounded down)."""
    quota = F.floor(F.col("group_size") * F.lit(fraction))
    return first_per_group(df, label, row_id, quota, seed, out)


def balanced_sample(df: DataFrame, label: str, row_id: str, rows: int, seed: int = SPLIT_SEED) -> DataFrame:
    """At most rows/2 rows of each label."""
    flagged = first_per_group(df, label, row_id, F.lit(rows // 2), seed, "__in")
    return flagged.filter("__in").drop("__in")


def spread_sample(df: DataFrame, order: str, pages: int, page_rows: int, **slicing) -> DataFrame:
    """`pages` runs of `page_rows` rows, evenly spaced along `order` (unique)."""
    placed = number_rows(df.select(order), order, "__at", **slicing)
    rows = df.count()
    step = max(1, rows // pages)
    # Pages may overlap when they are longer than the step: a row is wanted when
    # any page starting at or before it still covers it.
    page = F.least(F.floor(F.col("__at") / step), F.lit(pages - 1))
    wanted = placed.filter(F.col("__at") - page * step < page_rows).select(order)
    return df.join(wanted, order, "left_semi")
