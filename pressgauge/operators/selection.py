"""Leak-free, site-balanced training sets.

The selection rule is sequential: walk the rows, rarest site first, and keep one
unless its headline was already kept or its site is full. A row refused because
its site is full leaves its headline free for a later row. That rule is a greedy
matching of headlines (each kept once) to sites (each keeps `cap`), taking
(site, headline) pairs in walking order. Because both sides rank pairs by that one
order, the greedy answer is also the only stable matching, and stable matchings
can be found from all sites at once: every headline offers itself to the first
site that may still take it, every site holds on to the first `cap` offers it
sees, and a pair behind a full site's last held offer can never win. `_settle`
keeps what is certain and removes such pairs round by round. Sites that contend
for the same headlines wait for one another, so each round also walks the first
FRONT pairs that are still undecided, whatever waits for what among them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressgauge.functions.chars import strip
from pressgauge.functions.matching import has_key, keep_keyed, normalize_headline
from pressgauge.session import cut_lineage

# General-news outlets, outlets never wanted, types wanted.
GENERAL_NEWS = [
    "CNN", "The Hill", "Politico", "Axios", "The New York Times", "Vox", "CNBC", "Economist",
    "Buzzfeed News", "Business Insider", "Vice News", "Vice", "Fox News", "New Republic", "New Yorker",
]
NEVER_WANTED = ["Reuters", "Washington Post"]
WANTED_TYPES = ["fake", "conspiracy", "junksci", "rumor", "unreliable"]

FRONT = 200_000  # slim pairs that one task walks in a round

# Why a row was not kept.
UNUSED_LABEL = "label we are not using"
NOT_GENERAL = "not a general-news outlet"
TOO_SHORT = "too short to learn from"
NO_HEADLINE = "no usable headline"
IN_TEST_SET = "IN THE TEST SET - excluded"
DUPLICATE = "duplicate of one we kept"


@dataclass(frozen=True)
class Spec:
    """Which columns to read and what to keep."""

    site: str
    title: str
    body: str
    position: str  # unique, the order of the input
    cap: int
    min_chars: int = 400
    kind: str | None = None  # column tested against `kinds`
    kinds: list[str] = field(default_factory=list)
    deny: list[str] = field(default_factory=list)
    allow: list[str] | None = None
    strip_site: bool = False
    blank_site: str = "(unknown)"
    full: str = "website already at its cap"


def fakes_spec(cap: int = 60, **changes) -> Spec:
    base = dict(site="domain", title="title", body="content", position="pos", kind="type", kinds=WANTED_TYPES)
    return Spec(**{**base, "cap": cap, **changes})


def reals_spec(cap: int = 800, **changes) -> Spec:
    base = dict(
        site="publication", title="title", body="article", position="pos", deny=NEVER_WANTED, allow=GENERAL_NEWS,
        strip_site=True, blank_site="", full="outlet already at its cap",
    )
    return Spec(**{**base, "cap": cap, **changes})


def taught_keys(*piles: DataFrame, title: str = "title") -> DataFrame:
    """Distinct non-blank headline keys over all piles; piles without the title
    column have nothing to exclude."""
    keys = None
    for pile in piles:
        if title not in pile.columns:
            continue
        own = pile.select(normalize_headline(F.col(title)).alias("key"))
        keys = own if keys is None else keys.unionByName(own)
    if keys is None:
        raise ValueError(f"no pile has a {title!r} column")
    return keep_keyed(keys, "key").distinct()


def drop_leaks(exam: DataFrame, *piles: DataFrame, title: str = "title") -> DataFrame:
    """Exam rows whose headline no pile has taught; blank headlines stay."""
    keyed = exam.withColumn("__key", normalize_headline(F.col(title)))
    taught = taught_keys(*piles, title=title).withColumnRenamed("key", "__key")
    return keyed.join(taught, "__key", "left_anti").drop("__key")


def _screened(rows: DataFrame, spec: Spec, blocked: DataFrame | None) -> DataFrame:
    """Add __site, __key, __seen (rows of the site in the whole input) and the
    reason a row falls to one of the row-by-row tests, null if it passes."""
    raw = F.col(spec.site)
    site = strip(F.coalesce(raw, F.lit(""))) if spec.strip_site else raw
    sizes = rows.groupBy(raw.alias("__raw")).agg(F.count(F.lit(1)).alias("__seen"))
    rows = rows.join(sizes, raw.eqNullSafe(F.col("__raw"))).drop("__raw")
    rows = rows.withColumns(
        {
            "__site": F.when(F.coalesce(site, F.lit("")) == "", spec.blank_site).otherwise(site),
            "__key": normalize_headline(F.col(spec.title)),
        }
    )
    if blocked is None:
        rows = rows.withColumn("__blocked", F.lit(False))
    else:
        marked = blocked.select(F.col("key").alias("__key"), F.lit(True).alias("__blocked"))
        rows = rows.join(marked, "__key", "left")

    reason = F.lit(None).cast("string")
    tests: list[tuple[Column, Column]] = []
    if spec.kind:
        tests.append((~F.coalesce(F.col(spec.kind).isin(spec.kinds), F.lit(False)), F.lit(UNUSED_LABEL)))
    if spec.deny:
        denied = F.concat(F.lit("excluded outlet ("), F.col("__site"), F.lit(")"))
        tests.append((F.col("__site").isin(spec.deny), denied))
    if spec.allow is not None:
        tests.append((~F.col("__site").isin(spec.allow), F.lit(NOT_GENERAL)))
    tests.append((F.length(strip(F.coalesce(F.col(spec.body), F.lit("")))) < spec.min_chars, F.lit(TOO_SHORT)))
    tests.append((~has_key(F.col("__key")), F.lit(NO_HEADLINE)))
    tests.append((F.coalesce("__blocked", F.lit(False)), F.lit(IN_TEST_SET)))
    for failed, why in reversed(tests):
        reason = F.when(failed, why).otherwise(reason)
    return rows.withColumn("__fell", reason).drop("__blocked")


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rule itself, pair by pair: those of one partition that are kept. It holds FRONT pairs at most."""
    parts = list(batches)
    if not parts:
        return
    front = pd.concat(parts).sort_values(["seen", "pos"])
    held, room, kept = set(), {}, []
    for k, (site, key, has) in enumerate(zip(front["site"], front["key"], front["room"], strict=True)):
        left = room.get(site, has)
        if left and key not in held:
            held.add(key)
            room[site] = left - 1
            kept.append(k)
    yield front.iloc[kept]


def _settle(pairs: DataFrame, cap: int) -> DataFrame:
    """The kept (site, key, seen, pos) among `pairs`, one row per site and key.

    Everything before the first undecided pairs is decided and taken off, so walking them gives what the walk over all
    pairs would: a round settles FRONT pairs at least, and a chain of contending sites among them at once. Beyond them a
    pair is certain to be kept if it is its headline's first and among the first of its site that still fit. Each round
    keeps all such pairs, drops their headlines' other pairs, sites that are full, and pairs behind the last offer that a
    full site holds; only undecided pairs go on.
    """
    columns = pairs.schema.names
    left = cut_lineage(pairs.withColumn("room", F.lit(cap)))
    rounds: list[DataFrame] = []
    place = F.struct("seen", "pos")
    # Ranking stops at `cap` on the map side, so a huge site sends few rows.
    rank = F.row_number().over(Window.partitionBy("site").orderBy("seen", "pos"))

    def without(rows: DataFrame, won: DataFrame) -> DataFrame:
        """`rows` that may still be kept once `won` are."""
        taken = won.groupBy("site").agg(F.count(F.lit(1)).cast("int").alias("taken"))
        rest = rows.join(won.select("key"), "key", "left_anti").join(taken, "site", "left")
        return rest.withColumn("room", F.col("room") - F.coalesce("taken", F.lit(0))).drop("taken").filter("room > 0")

    while True:
        front = left.orderBy("seen", "pos").limit(FRONT)
        walked = front.coalesce(1).mapInPandas(_walk, left.schema)
        won = cut_lineage(walked.select(*columns))
        last = front.agg(F.max(place).alias("last")).select("last.*").first()
        rounds.append(won)
        if last["seen"] is None:
            return reduce(DataFrame.unionAll, rounds)
        seen, pos = last["seen"], last["pos"]
        beyond = left.filter((F.col("seen") > seen) | ((F.col("seen") == seen) & (F.col("pos") > pos)))
        left = cut_lineage(without(beyond, won))
        if left.isEmpty():
            return reduce(DataFrame.unionAll, rounds)
        firsts = left.groupBy("key").agg(F.min(F.struct("seen", "pos", "site")).alias("f"))
        fitting = left.withColumn("rank", rank).filter(F.col("rank") <= cap).filter(F.col("rank") <= F.col("room"))
        own = F.struct("seen", "pos", "site")
        won = cut_lineage(fitting.join(firsts, "key").filter(own == F.col("f")).select(*columns))
        rounds.append(won)
        left = cut_lineage(without(left, won))
        # Offers: what is still undecided of the headlines' first pairs.
        offers = left.groupBy("key").agg(F.min(F.struct("seen", "pos", "site", "room")).alias("o")).select("o.*")
        last = offers.withColumn("rank", rank).filter(F.col("rank") <= cap).filter(F.col("rank") == F.col("room"))
        last = last.select("site", place.alias("last"))
        behind = left.join(last, "site", "left").filter(F.col("last").isNull() | (place <= F.col("last")))
        left = cut_lineage(behind.drop("last").select(*columns, "room"))


def select_diverse(rows: DataFrame, spec: Spec, blocked: DataFrame | None = None) -> DataFrame:
    """Every input row with `kept` and, when not kept, `reason`, plus the `site` it
    counted for. `blocked` holds headline keys that must not be handed back."""
    screened = _screened(rows, spec, blocked)
    place = F.struct(F.col("__seen").alias("seen"), F.col(spec.position).alias("pos"))
    # A generator, so that the tests are not worked out again in a pushed-down filter.
    passing = F.when(
        F.col("__fell").isNull(), F.array(F.struct(F.col("__site").alias("site"), F.col("__key").alias("key"), place.alias("place")))
    )
    pairs = (
        screened.select(F.explode(passing).alias("p"))
        .groupBy("p.site", "p.key")
        .agg(F.min("p.place").alias("first"))
        .select("site", "key", "first.*")
    )
    winners = _settle(pairs, spec.cap).select(
        F.col("key").alias("__key"), F.struct("seen", "pos").alias("__winner")
    )
    place = F.struct(F.col("__seen").alias("seen"), F.col(spec.position).alias("pos"))
    passed, winner = F.col("__fell").isNull(), F.col("__winner")
    kept = passed & winner.isNotNull() & (winner == place)
    reason = (
        F.when(~passed, F.col("__fell"))
        .when(kept, F.lit(None).cast("string"))
        .when(winner < place, DUPLICATE)
        .otherwise(spec.full)
    )
    return screened.join(winners, "__key", "left").select(
        *rows.columns,
        F.col("__site").alias("counted_site"),
        F.col("__seen").alias("site_rows"),
        F.coalesce(kept, F.lit(False)).alias("kept"),
        reason.alias("reason"),
    )


def rejection_tally(decided: DataFrame) -> DataFrame:
    """Reasons with their row counts, commonest first."""
    tally = decided.filter(~F.col("kept")).groupBy("reason").agg(F.count(F.lit(1)).alias("articles"))
    return tally.orderBy(F.desc("articles"), "reason")


def selection_profile(decided: DataFrame) -> DataFrame:
    """One row: articles kept, distinct sites, the busiest site and its count."""
    per_site = decided.filter("kept").groupBy("counted_site").agg(F.count(F.lit(1)).alias("n"))
    busiest = F.max(F.struct(F.col("n"), F.col("counted_site")))
    return per_site.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("articles"),
        F.count(F.lit(1)).alias("sites"),
        busiest.getField("counted_site").alias("busiest_site"),
        busiest.getField("n").alias("busiest_articles"),
    )


def kept_per(decided: DataFrame, column: str = "counted_site") -> DataFrame:
    """Kept articles per site, or per any other column such as the type."""
    return decided.filter("kept").groupBy(column).agg(F.count(F.lit(1)).alias("articles")).orderBy(F.desc("articles"))


def trim_to_target(decided: DataFrame, position: str, target: int) -> DataFrame:
    """The first `target` kept rows in walking order. Only places are sorted; the
    rows follow by comparing theirs with the last one wanted."""
    kept = decided.filter("kept").withColumn("__place", F.struct("site_rows", position))
    last = kept.select("__place").orderBy("__place").limit(target).agg(F.max("__place").alias("last")).scalar()
    return kept.filter(F.col("__place") <= last).drop("__place")
