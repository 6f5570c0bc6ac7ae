"""Gradient-boosted trees: `fit` for arrays, `fit_table` for a table of any size, whose rows stay in their tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bins of a feature that is a whole number from 0 up: each number below 64 has its own, then four for each doubling.
EDGES = np.concatenate([np.arange(64), np.ceil(64 * 2 ** (np.arange(1, 81) / 4))])
BINS = len(EDGES)
UNIT = 1 << 24  # gradients are whole numbers of 1 / UNIT, so their sums don't depend on the order of rows


@dataclass(frozen=True)
class Tree:
    """A complete binary tree: inner nodes test `feature < cut`, leaves hold log-odds."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def value(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), np.int64)
        for _ in range(int(np.log2(len(self.leaf)))):
            right = rows[np.arange(len(rows)), self.feature[node]] >= self.cut[node]
            node = 2 * node + 1 + right
        return self.leaf[node - len(self.feature)]


@dataclass(frozen=True)
class Boosted:
    base: float
    trees: tuple[Tree, ...]

    def probability(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        for tree in self.trees:
            total += tree.value(rows)
        return 1 / (1 + np.exp(-total))


def _best_cut(rows: np.ndarray, gradient: np.ndarray, weight: np.ndarray, ridge: float) -> tuple[int, float]:
    """The split of the largest gain in the second-order loss; feature 0 at infinity if none gains."""
    best, found = 1e-9, (0, np.inf)
    whole = gradient.sum() ** 2 / (weight.sum() + ridge)
    for k in range(rows.shape[1]):
        order = np.argsort(rows[:, k], kind="stable")
        values = rows[order, k]
        edges = np.flatnonzero(values[1:] > values[:-1])
        if not len(edges):
            continue
        g, w = np.cumsum(gradient[order])[edges], np.cumsum(weight[order])[edges]
        g_rest, w_rest = gradient.sum() - g, weight.sum() - w
        gains = g**2 / (w + ridge) + g_rest**2 / (w_rest + ridge) - whole
        j = int(np.argmax(gains))
        if gains[j] > best:
            best, found = gains[j], (k, float(values[edges[j]] + values[edges[j] + 1]) / 2)
    return found


def fit(rows: np.ndarray, label: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> Boosted:
    """Logistic loss; every leaf is a Newton step of the given rate."""
    share = (label.sum() + 1) / (len(label) + 2)
    base = float(np.log(share / (1 - share)))
    score, grown = np.full(len(rows), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, weight = label - p, p * (1 - p)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(len(rows), np.int64)
        for n in range(2**depth - 1):
            here = node == n
            if here.any():
                feature[n], cut[n] = _best_cut(rows[here], gradient[here], weight[here], ridge)
                node[here] = 2 * n + 1 + (rows[here, feature[n]] >= cut[n])
        at = node - (2**depth - 1)
        leaf = rate * np.bincount(at, gradient, 2**depth) / (np.bincount(at, weight, 2**depth) + ridge)
        tree = Tree(feature, cut, leaf)
        grown.append(tree)
        score += tree.value(rows)
    return Boosted(base, tuple(grown))


def bins(values: np.ndarray) -> np.ndarray:
    """The bin of each value, as a byte."""
    return (np.searchsorted(EDGES, values, "right") - 1).astype(np.uint8)


def _binned(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def values(column: pa.Array, width: int) -> np.ndarray:
    """Rows of `width` bins as numbers: the lowest of each bin, which every cut tells apart as it does the bin's others."""
    return EDGES[_binned(column, width)]


def _cuts_of(sums: pd.DataFrame, ridge: float) -> tuple[tuple[int, float], list[tuple[float, float]]]:
    """The split of the largest gain for a node whose gradients are summed by feature and bin, as `_best_cut` finds it,
    and gradient and weight on either side."""
    first = sums[sums["feature"] == 0]
    whole_g, whole_w = first["g"].sum() / UNIT, first["w"].sum() / UNIT
    best, found, sides = 1e-9, (0, np.inf), [(whole_g, whole_w), (0.0, 0.0)]
    for k, rows in sums.groupby("feature"):
        at = rows["bin"].to_numpy()
        g, w = rows["g"].to_numpy().cumsum()[:-1] / UNIT, rows["w"].to_numpy().cumsum()[:-1] / UNIT
        if not len(g):
            continue
        g_rest, w_rest = whole_g - g, whole_w - w
        gains = g**2 / (w + ridge) + g_rest**2 / (w_rest + ridge) - whole_g**2 / (whole_w + ridge)
        j = int(np.argmax(gains))
        if gains[j] > best:
            # halfway between the largest value below and the smallest above, as far as bins tell
            best, found = gains[j], (int(k), float(EDGES[at[j] + 1] - 1 + EDGES[at[j + 1]]) / 2)
            sides = [(g[j], w[j]), (g_rest[j], w_rest[j])]
    return found, sides


def fit_table(
    rows: DataFrame, groups: list[int], width: int, trees: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0
) -> dict[int, Boosted]:
    """`fit` for each of several groups of rows at once: `kind` (the group), `x` (`width` bins), `right`, `n` (how often).

    Each level of a tree is one pass: a task adds up its rows' gradients by group, node, feature and bin, and Spark adds
    up the tasks' sums. Only these sums reach the driver, at most groups x nodes x features x bins; every row is in them.
    """
    counted = {(r["kind"], r["right"]): r["n"] for r in rows.groupBy("kind", "right").agg(F.sum("n").alias("n")).collect()}
    base = {}
    for kind in groups:
        right, wrong = (counted.get((kind, value), 0) for value in (True, False))
        share = (right + 1) / (right + wrong + 2)
        base[kind] = float(np.log(share / (1 - share)))
    grown: dict[int, list[Tree]] = {kind: [] for kind in groups}
    # every level is a pass with as many tasks as partitions: few rows need few
    rows = rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)

    def sums(level: int, growing: dict[int, tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        models = {kind: Boosted(base[kind], tuple(grown[kind])) for kind in groups}
        slots = 2**level * width * BINS

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {}
            for batch in batches:
                of = batch["kind"].to_numpy()
                x, label = _binned(batch["x"], width), batch["right"].to_numpy(zero_copy_only=False)
                times = batch["n"].to_numpy()
                for kind in set(of.tolist()) & set(groups):
                    own = of == kind
                    mine, n = x[own], times[own]
                    value = EDGES[mine]
                    p = models[kind].probability(value)
                    feature, cut = growing[kind]
                    node = np.zeros(len(mine), np.int64)
                    for _ in range(level):
                        node = 2 * node + 1 + (value[np.arange(len(mine)), feature[node]] >= cut[node])
                    first = (node - (2**level - 1))[:, None] * width + np.arange(width)
                    slot = (first * BINS + mine).ravel()
                    g, w = (np.rint(v * UNIT).astype(np.int64) * n for v in (label[own] - p, p * (1 - p)))
                    both = total.setdefault(kind, np.zeros((2, slots), np.int64))
                    np.add.at(both[0], slot, np.repeat(g, width))
                    np.add.at(both[1], slot, np.repeat(w, width))
            for kind, both in total.items():
                used = np.flatnonzero(both[1])
                out = {"kind": np.full(len(used), kind, np.int32), "slot": used, "g": both[0][used], "w": both[1][used]}
                yield pa.RecordBatch.from_pydict(out)

        told = rows.mapInArrow(work, "kind int, slot bigint, g bigint, w bigint")
        told = told.groupBy("kind", "slot").agg(F.sum("g").alias("g"), F.sum("w").alias("w")).toPandas().sort_values(["kind", "slot"])
        told["bin"], above = told["slot"] % BINS, told["slot"] // BINS
        told["feature"], told["node"] = above % width, above // width
        return told

    for _ in range(trees):
        growing = {kind: (np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)) for kind in groups}
        leaf = {kind: np.zeros(2**depth) for kind in groups}
        for level in range(depth):
            for (kind, node), found in sums(level, growing).groupby(["kind", "node"]):
                at = 2**level - 1 + node
                (growing[kind][0][at], growing[kind][1][at]), sides = _cuts_of(found, ridge)
                if level == depth - 1:
                    leaf[kind][2 * node : 2 * node + 2] = [rate * g / (w + ridge) for g, w in sides]
        for kind in groups:
            grown[kind].append(Tree(*growing[kind], leaf[kind]))
    return {kind: Boosted(base[kind], tuple(grown[kind])) for kind in groups}


def threshold(probability: np.ndarray, label: np.ndarray, precision: float, times: np.ndarray | None = None) -> float:
    """The lowest cut above which the labelled rows are that precise, halfway to the next row below; above 1 if none.

    With `times`, a row stands for so many, and `label` tells how many of them are right."""
    order = np.argsort(-probability, kind="stable")
    right = np.cumsum(label[order]) / (np.arange(1, len(order) + 1) if times is None else np.cumsum(times[order]))
    last = np.append(probability[order][1:] < probability[order][:-1], True)  # equal scores go together
    good = np.flatnonzero(last & (right >= precision))
    if not len(good):
        return 2.0
    ranked = np.append(probability[order], 0.0)
    return float(ranked[good[-1]] + ranked[good[-1] + 1]) / 2
