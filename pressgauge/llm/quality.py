"""Quality rules: text statistics, and a decision list learned from labelled ones.

Sequential covering in the manner of RIPPER: a rule is a conjunction of thresholds on statistics.
It grows on two thirds of the labelled rows, one threshold of the largest FOIL gain at a time, until
it covers no good text, is then cut back on the remaining third while that keeps its precision, and
is kept only if it stays precise there. Rows that a kept rule covers go, and the next rule is sought.
The list leaves as an ordered Spark conditional expression: the first rule that holds gives its
number, no rule means that the text is kept.

A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage
return. Null text is the empty text: every statistic is 0, and it fails the base rule. Documents
without a label are only judged. Labels that are null, or of no document, teach nothing; a document
labelled twice counts once, as bad if any label says so. No usable labels: no learned rule.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.llm.common import BLANKS, doc_text, hash_sample, map_arrow, strings

SYMBOLS = "#*$%&|<>"
COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_upper",
    "n_marks",
    "n_digits",
)
# What a rule may look at: shares that mean the same in short and long texts (a share of distinct words,
# say, falls as a text grows, and would turn on long good ones).
FEATURES = {
    "repeat_share": ("n_repeat_words", "n_words"),
    "symbol_share": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "upper_share": ("n_upper", "word_chars"),
    "mark_share": ("n_marks", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "word_length": ("word_chars", "n_words"),
}


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 20_000  # labelled rows that the list is learned from, those of the smallest hash
    max_rules: int = 12
    max_conditions: int = 4
    cuts: int = 64  # thresholds tried for each statistic
    precision: float = 0.98  # on the pruning third
    least: int = 5  # bad texts that a rule must cover


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = share(self.feature)
        return value >= F.lit(self.threshold) if self.at_least else value < F.lit(self.threshold)

    def holds(self, values: np.ndarray) -> np.ndarray:
        column = values[:, list(FEATURES).index(self.feature)]
        return column >= self.threshold if self.at_least else column < self.threshold


Rule = tuple[Condition, ...]


def share(feature: str) -> Column:
    over, under = FEATURES[feature]
    return F.col(over).cast("double") / F.greatest(F.col(under), F.lit(1))


_TO_ASCII = bytes.maketrans(bytes(range(128, 256)), b"\x80" * 128)


def _measure(text: str) -> tuple[int, ...]:
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split knows just the six blanks
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    repeated = 0
    if len(words) > 3:
        ids: dict[bytes, int] = {}
        code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        pairs = np.unique(code[:-1] * len(ids) + code[1:], return_inverse=True)[1]
        _, which, times = np.unique(pairs[:-1] * len(ids) + code[2:], return_inverse=True, return_counts=True)
        again = times[which] > 1
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k : k + len(again)] |= again
        repeated = int(covered.sum())
    raw = b"".join(words).translate(_TO_ASCII)
    bytes_of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = int(bytes_of[65:91].sum() + bytes_of[97:123].sum())
    digits = int(bytes_of[48:58].sum())
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        int(bytes_of[65:91].sum()),
        int(bytes_of[33:127].sum()) - letters - digits,
        digits,
    )


def measure(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, `more` and the counts of each whole text, one row for each row. No shuffle.

    `more` may name the text, which then comes along, empty where it was null.
    """
    rows = doc_text(docs, *[c for c in more if c != "text"])
    keys = ["doc_id", *more]
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def work(batch: pa.RecordBatch) -> dict:
        found = np.array([_measure(t) for t in strings(batch["text"])], np.int64).reshape(-1, len(COUNTS))
        return {k: batch[k] for k in keys} | {c: pa.array(found[:, i]) for i, c in enumerate(COUNTS)}

    return map_arrow(rows, schema + "".join(f", {c} bigint" for c in COUNTS), work)


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of them in repeated three-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _grow(values: np.ndarray, bad: np.ndarray, settings: Settings) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(values), bool)
    while len(rule) < settings.max_conditions and (~bad[inside]).any():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best, gain = None, 0.0
        for k, feature in enumerate(FEATURES):
            column = np.unique(values[inside, k])
            if len(column) < 2:
                continue
            middles = (column[1:] + column[:-1]) / 2
            if len(middles) > settings.cuts:
                middles = np.unique(np.quantile(values[inside, k], np.linspace(0, 1, settings.cuts + 2)[1:-1]))
                # the extremes matter most: how far the good texts reach on either side
                edge = [np.searchsorted(column, f(values[inside & ~bad, k])) for f in (np.min, np.max)]
                middles = np.unique([*middles, *((column[max(0, e - 1)] + column[e]) / 2 for e in edge)])
                middles = np.unique([*middles, (column[min(len(column) - 1, edge[1] + 1)] + column[edge[1]]) / 2])
            order = np.argsort(values[inside, k], kind="stable")
            ranked, bads = values[inside, k][order], np.concatenate([[0], np.cumsum(bad[inside][order])])
            at = np.searchsorted(ranked, middles, "left")
            for at_least in (False, True):
                p = p0 - bads[at] if at_least else bads[at]
                n = (len(ranked) - at if at_least else at) - p
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1)
                j = int(np.argmax(gains))
                if gains[j] > gain + 1e-9:
                    best, gain = Condition(feature, at_least, float(middles[j])), gains[j]
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(values)
    return tuple(rule)


def _covered(rule: Rule, values: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([c.holds(values) for c in rule]) if rule else np.zeros(len(values), bool)


def _prune(rule: Rule, values: np.ndarray, bad: np.ndarray) -> tuple[Rule, float]:
    """The beginning of the rule that is most precise on the pruning rows; the shorter of equals."""
    best, worth = (), -1.0
    for n in range(1, len(rule) + 1):
        hit = _covered(rule[:n], values)
        value = (bad & hit).sum() / hit.sum() if hit.any() else -1.0
        if value > worth:
            best, worth = rule[:n], value
    return best, worth


def learn(values: np.ndarray, bad: np.ndarray, prune: np.ndarray, settings: Settings = Settings()) -> list[Rule]:
    """The decision list. values: a row for each text and a column for each of FEATURES."""
    rules: list[Rule] = []
    while len(rules) < settings.max_rules and bad[~prune].any():
        rule, worth = _prune(_grow(values[~prune], bad[~prune], settings), values[prune], bad[prune])
        hit = _covered(rule, values)
        grown = hit & ~prune
        if worth < settings.precision or (bad & hit).sum() < settings.least:
            break
        if (bad & grown).sum() < settings.precision * grown.sum():
            break
        rules.append(rule)
        values, bad, prune = values[~hit], bad[~hit], prune[~hit]
    return rules


def learn_list(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> list[Rule]:
    """Learns from at most `sample_rows` labelled documents; only their statistics reach the driver."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("__quality"))
    wanted = hash_sample(known, "doc_id", settings.sample_rows)
    # `wanted` is bounded by sample_rows, so Spark may broadcast it and the texts stay where they are
    taught = measure(docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id"), "__quality")
    rows = (
        taught.where(F.col("n_words") > 0)
        .select(
            (F.col("__quality") == 0).alias("bad"),
            (F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0).alias("prune"),
            *[share(f).alias(f) for f in FEATURES],
        )
        .orderBy(F.xxhash64("doc_id"), "doc_id", *FEATURES)
        .limit(settings.sample_rows)
        .toPandas()
    )
    if rows.empty:
        return []
    return learn(rows[list(FEATURES)].to_numpy(float), rows["bad"].to_numpy(bool), rows["prune"].to_numpy(bool), settings)


def rule_number(rules: list[Rule]) -> Column:
    """1 for the first rule, and so on; null if none holds."""
    found = F.lit(None).cast("int")
    for n, rule in reversed(list(enumerate(rules, 1))):
        holds = F.lit(True)
        for condition in rule:
            holds = holds & condition.column()
        found = F.when(holds, F.lit(n)).otherwise(found)
    return found


def judge(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), *more: str) -> DataFrame:
    """doc_id, `more`, the counts, base_failed, rule (number of the learned rule that held) and kept."""
    rules = learn_list(docs, labels, settings)
    return (
        measure(docs, *more)
        .withColumn("base_failed", base_failed())
        .withColumn("rule", rule_number(rules))
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )
