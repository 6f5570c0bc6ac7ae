"""Hard negatives by a multiway hyperplane tree with distance ranges (GNAT).

A node of the tree has a few split points; a row belongs to the nearest of them. For each split point the node keeps
the range of its distances to the rows of every child. A search knows its distances to the split points, so each range
bounds its distance to a child's rows from below and above, and with the range of their norms their inner product: a
child is left out when no window of the search meets those bounds (in distances, when the child's range doesn't meet
the window's annulus). Leaves are compared row by row, in exact integers.

The tree grows level by level in Spark. Rows of a node that is too large meet its split points, which come from a
bounded sample of the node, in groups of bounded size; a node that its split points can't divide is cut by hash.
Searches come down the same way: first each to the one leaf it is nearest to, whose answer raises the lower end of its
windows, then to every leaf that the windows still meet. Searches and leaves meet in groups of bounded size as well,
and what the leaves answer is merged by a ranking that starts inside the tasks.

Equal vectors with the same label are one point that keeps as many of its smallest ids as a search can use, and anchors
that are equal ask once, so a vector that a third of the rows share costs no more than another.

Rows with a null id, label or vector, or a null or non-finite component take no part. Rows that agree in id, label and
vector count once. An anchor's own id is never among its answers. Vectors of different lengths are different spaces and
never meet; empty vectors have inner product 0. An anchor without a usable positive, or a positive without a negative in
its window (none can be if its score is negative), gives no rows. Components and scores end at 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressgauge.llm.common import stored

LEAST, MOST = -(2**63), 2**63 - 1


@dataclass(frozen=True)
class Settings:
    positives: int = 5
    negatives: int = 3
    low: int = 50  # percent of the positive's score that a negative must reach
    high: int = 95  # and must not exceed
    scale: float = 256.0  # components are multiplied by it and rounded down
    degree: int = 16  # split points of a node
    sample: int = 256  # rows of a node from which they are chosen
    leaf: int = 4_096  # points of a leaf, about
    block: int = 4_096  # searches that meet a node or a leaf at a time, about
    levels: int = 12


def finite(vector: Column) -> Column:
    """Whether every component is a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(~bad, F.lit(False))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, np.int64) for v in vectors], np.int64).reshape(len(vectors), -1)


def _norms(rows: np.ndarray) -> np.ndarray:
    return (rows.astype(np.float64) ** 2).sum(1)


def _distances(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    squares = _norms(rows)[:, None] + _norms(points)[None, :] - 2 * (rows.astype(np.float64) @ points.T.astype(np.float64))
    return np.sqrt(np.maximum(squares, 0))


def _scores(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact inner products: in double precision where every sum fits 53 bits, else in whole numbers of any size."""
    largest = [int(np.abs(x.astype(np.float64)).max(initial=0)) for x in (rows, points)]
    if largest[0] * largest[1] * max(rows.shape[1], 1) < 2**53:
        return (rows.astype(np.float64) @ points.T.astype(np.float64)).astype(np.int64)
    exact = rows.astype(object) @ points.T.astype(object)
    return np.clip(exact, LEAST, MOST).astype(np.int64)


def _meet(many: DataFrame, few: DataFrame, keys: list[str], by: list[str], most: int, work: Callable, schema: str) -> DataFrame:
    """`work` on groups of at most about `most` rows of `many` and all rows of `few` that agree in `keys`."""
    sizes = stored(many.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).alias("__blocks")))
    dealt = many.join(sizes, keys).withColumn("__block", F.pmod(F.xxhash64(*by), F.col("__blocks"))).drop("__blocks")
    copies = few.join(sizes, keys).withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__blocks") - 1)))
    group = [*keys, "__block"]
    return dealt.groupBy(*group).cogroup(copies.drop("__blocks").groupBy(*group)).applyInPandas(work, schema)


@dataclass(frozen=True)
class Tree:
    """nodes: space, node, splits, children and their ranges. leaves: space, node, part, label, vector, ids."""

    nodes: tuple[DataFrame, ...]  # of each level
    leaves: DataFrame


SPLITS = "space int, node bigint, splits array<array<bigint>>"
DEALT = (
    "space int, node bigint, child bigint, n bigint, label bigint, vector array<bigint>, ids array<bigint>, "
    "nearest array<double>, farthest array<double>, shortest double, longest double"
)


def _choose(rows: pd.DataFrame, degree: int) -> pd.DataFrame:
    """Split points far from one another: each is the row farthest from those chosen before."""
    rows = rows.sort_values("place")
    vectors = _matrix(rows["vector"])
    chosen, gap = [0], _distances(vectors, vectors[:1])[:, 0]
    while len(chosen) < degree and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _distances(vectors, vectors[chosen[-1:]])[:, 0])
    return pd.DataFrame({"space": rows["space"].iloc[:1], "node": rows["node"].iloc[:1], "splits": [vectors[chosen].tolist()]})


def _deal(rows: pd.DataFrame, nodes: pd.DataFrame, degree: int) -> pd.DataFrame:
    """The rows with the child of the nearest split point; and for each child its number of rows and ranges."""
    columns = [part.split()[0] for part in DEALT.split(", ")]
    if not len(rows) or not len(nodes):
        return pd.DataFrame(columns=columns)
    vectors = _matrix(rows["vector"])
    away, norms = _distances(vectors, _matrix(pd.Series(nodes["splits"].iloc[0]))), _norms(vectors)
    nearest = away.argmin(1)
    node = int(nodes["node"].iloc[0])
    dealt = rows[["space", "node", "label", "vector", "ids"]].assign(child=node * degree + nearest + 1)
    ranges = [
        {
            "space": rows["space"].iloc[0],
            "node": node,
            "child": node * degree + k + 1,
            "n": int((nearest == k).sum()),
            "nearest": away[nearest == k].min(0).tolist(),
            "farthest": away[nearest == k].max(0).tolist(),
            "shortest": norms[nearest == k].min(),
            "longest": norms[nearest == k].max(),
        }
        for k in np.unique(nearest).tolist()
    ]
    both = pd.concat([dealt.assign(label=dealt["label"].astype("Int64")), pd.DataFrame(ranges)], ignore_index=True)
    both["n"] = both["n"].astype("Int64")
    both = both.reindex(columns=columns)
    for name in ("vector", "ids", "nearest", "farthest"):
        both[name] = both[name].astype(object).where(both[name].notna(), None)
    return both


def _ranges(dealt: DataFrame) -> DataFrame:
    """One row for each child, from those of its groups."""
    parts = dealt.where("ids is null")
    ends = parts.select("space", "node", "child", F.posexplode(F.arrays_zip("nearest", "farthest")).alias("split", "ends"))
    ends = ends.groupBy("space", "node", "child", "split").agg(F.min("ends.nearest").alias("a"), F.max("ends.farthest").alias("b"))
    ends = ends.groupBy("space", "node", "child").agg(F.sort_array(F.collect_list(F.struct("split", "a", "b"))).alias("ends"))
    sums = parts.groupBy("space", "node", "child").agg(
        F.sum("n").alias("n"), F.min("shortest").alias("shortest"), F.max("longest").alias("longest")
    )
    return sums.join(ends, ["space", "node", "child"]).select(
        "space", "node", "child", "n", "shortest", "longest", F.col("ends.a").alias("nearest"), F.col("ends.b").alias("farthest")
    )


def grow(points: DataFrame, settings: Settings = Settings()) -> Tree:
    """The tree over points (label, vector, ids); ids is not empty."""
    degree = settings.degree
    open_ = points.select(F.size("vector").alias("space"), F.lit(0).cast("bigint").alias("node"), "label", "vector", "ids")
    sizes = stored(open_.groupBy("space", "node").agg(F.count(F.lit(1)).alias("n")))
    # a node whose rows stay together is not divided again
    large = sizes.where(F.col("n") > settings.leaf)
    leaves = [open_.join(sizes.where(F.col("n") <= settings.leaf), ["space", "node"]).withColumn("part", F.lit(0).cast("bigint")).drop("n")]
    nodes: list[DataFrame] = []
    part = F.pmod(F.xxhash64("label", "vector"), F.ceil(F.col("n") / settings.leaf))
    for level in range(settings.levels + 1):
        if large.isEmpty():
            break
        inside = open_.join(large.select("space", "node"), ["space", "node"])
        order = Window.partitionBy("space", "node").orderBy(F.xxhash64("vector"), "vector")
        few = inside.select("space", "node", "vector", F.row_number().over(order).alias("place")).where(F.col("place") <= settings.sample)
        splits = few.groupBy("space", "node").applyInPandas(lambda rows: _choose(rows, degree), SPLITS)
        splits = stored(splits)
        dealt = stored(
            _meet(inside, splits, ["space", "node"], ["label", "vector"], settings.leaf, lambda a, b: _deal(a, b, degree), DEALT)
        )
        ranges = stored(_ranges(dealt))
        children = ranges.groupBy("space", "node").agg(F.sort_array(F.collect_list(F.struct(
            "child", "shortest", "longest", "nearest", "farthest"))).alias("children"))
        nodes.append(stored(splits.join(children, ["space", "node"])))
        open_ = dealt.where("ids is not null").select("space", F.col("child").alias("node"), "label", "vector", "ids")
        whole = ranges.groupBy("space", "node").agg(F.sum("n").alias("whole"))
        counted = ranges.join(whole, ["space", "node"]).select("space", F.col("child").alias("node"), "n", "whole")
        more = (F.col("n") > settings.leaf) & (F.col("n") < F.col("whole")) & F.lit(level < settings.levels)
        large = stored(counted.where(more).select("space", "node", "n"))
        done = stored(counted.where(~more).select("space", "node", "n"))
        leaves.append(open_.join(done, ["space", "node"]).withColumn("part", part).drop("n"))
    columns = ["space", "node", "part", "label", "vector", "ids"]
    found = leaves[0].select(*columns)
    for more_leaves in leaves[1:]:
        found = found.unionByName(more_leaves.select(*columns))
    return Tree(tuple(nodes), stored(found))


ASKS = "q bigint, space int, node bigint, label bigint, vector array<bigint>, windows array<struct<key:bigint,low:bigint,high:bigint>>"
HITS = "q bigint, key bigint, id bigint, score bigint, own boolean"


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _windows(asks: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows: the row of their search, key, and the lowest and highest score."""
    row = np.repeat(np.arange(len(asks)), [len(w) for w in asks["windows"]])
    flat = [(w["key"], w["low"], w["high"]) for one in asks["windows"] for w in one]
    key, low, high = np.array(flat, np.int64).reshape(-1, 3).T
    return row, key, low, high


def _descend(asks: pd.DataFrame, nodes: pd.DataFrame, degree: int, greedy: bool) -> pd.DataFrame:
    """The searches at the children they must see: the nearest one, or all that a window of theirs meets."""
    columns = _names(ASKS)[:5] + ["windows"]
    if not len(asks) or not len(nodes):
        return pd.DataFrame(columns=columns)
    node, children = int(nodes["node"].iloc[0]), list(nodes["children"].iloc[0])
    vectors = _matrix(asks["vector"])
    away, norms = _distances(vectors, _matrix(pd.Series(list(nodes["splits"].iloc[0])))), _norms(vectors)
    names = np.array([c["child"] for c in children], np.int64)
    if greedy:
        rows, at = np.arange(len(asks)), away[:, names - node * degree - 1].argmin(1)
    else:
        nearest, farthest = (np.array([list(c[k]) for c in children], np.float64) for k in ("nearest", "farthest"))
        shortest, longest = (np.array([c[k] for c in children], np.float64) for k in ("shortest", "longest"))
        # of a row of the child: how near to the search, and how far, it can be
        below = np.maximum(away[:, None, :] - farthest, nearest - away[:, None, :]).max(2)
        above = (away[:, None, :] + farthest).min(2)
        slack = 1 + 1e-7 * (norms[:, None] + longest)  # far above any rounding
        most = (norms[:, None] + longest - np.maximum(below, 0) ** 2) / 2 + slack
        least = (norms[:, None] + shortest - above**2) / 2 - slack
        row, _, low, high = _windows(asks)
        meets = np.zeros(most.shape, bool)
        np.logical_or.at(meets, row, (most[row] >= low[:, None]) & (least[row] <= high[:, None]))
        rows, at = np.nonzero(meets)
    return asks.iloc[rows][columns].assign(node=names[at])


def _answer(asks: pd.DataFrame, leaf: pd.DataFrame, top: int, alike: bool, step: int = 64) -> pd.DataFrame:
    """The `top` rows of a leaf in each window, of the search's label or (not `alike`) of any other."""
    out = []
    if len(asks) and len(leaf):
        points, labels = _matrix(leaf["vector"]), leaf["label"].to_numpy(np.int64)
        norms = np.array([sum(int(x) * int(x) for x in v) for v in points], object)
        many = np.array([len(x) for x in leaf["ids"]])
        ids, first = np.concatenate([np.asarray(x, np.int64) for x in leaf["ids"]]), np.cumsum(many) - many
        k = min(top, len(points))
        for at in range(0, len(asks), step):
            some = asks.iloc[at : at + step]
            vectors = _matrix(some["vector"])
            row, key, low, high = _windows(some)
            equal = some["label"].to_numpy(np.int64)[:, None] == labels
            scores = _scores(vectors, points)[row]
            fits = (equal if alike else ~equal)[row] & (scores >= low[:, None]) & (scores <= high[:, None])
            masked = np.where(fits, scores, LEAST)
            least = np.partition(masked, len(points) - k, axis=1)[:, len(points) - k]
            w, p = np.nonzero(fits & (masked >= least[:, None]))
            each = np.repeat(np.arange(len(p)), many[p])
            inside = np.arange(len(each)) - np.repeat(np.cumsum(many[p]) - many[p], many[p])
            w, p, found = w[each], p[each], ids[first[p[each]] + inside]
            score = scores[w, p]
            order = np.lexsort((found, ~score, w))
            w, p, found, score = w[order], p[order], found[order], score[order]
            place = np.arange(len(w)) - np.searchsorted(w, w)
            kept = place < top
            w, p = w[kept], p[kept]
            own = (vectors[row[w]] == points[p]).all(1) if alike else np.zeros(len(w), bool)
            out.append(pd.DataFrame({
                "q": some["q"].to_numpy(np.int64)[row[w]], "key": key[w], "id": found[kept], "score": score[kept], "own": own
            }))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=_names(HITS))


def _visit(tree: Tree, asks: DataFrame, top: int, alike: bool, greedy: bool, settings: Settings) -> DataFrame:
    """The best `top` rows of each search and window in the leaves it comes to."""
    degree, at = settings.degree, asks
    keys = ["space", "node"]
    reached = None
    for nodes in tree.nodes:
        inner = nodes.select(*keys)
        here = at.join(inner, keys, "left_anti")  # these are at leaves
        reached = here if reached is None else reached.unionByName(here)
        going = at.join(inner, keys, "left_semi")
        at = stored(_meet(going, nodes, keys, ["q"], settings.block, lambda a, b: _descend(a, b, degree, greedy), ASKS))
    reached = at if reached is None else reached.unionByName(at)
    parts = stored(tree.leaves.select(*keys, "part").distinct())
    hits = _meet(
        reached.join(parts, keys), tree.leaves, [*keys, "part"], ["q"], settings.block,
        lambda a, b: _answer(a, b, top, alike), HITS,
    )
    order = Window.partitionBy("q", "key").orderBy(F.desc("score"), "id")
    return stored(hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))


def nearest(tree: Tree, asked: DataFrame, windows: DataFrame, top: int, alike: bool, settings: Settings = Settings()) -> DataFrame:
    """q, key, rank, id, score, own: the `top` highest scores in each window, ties to the smaller id.

    asked: q (unique), label, vector. windows: q, key (unique for each q), low, high (both inclusive).
    """

    def packed(windows: DataFrame) -> DataFrame:
        listed = windows.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("key", "low", "high"))).alias("windows"))
        return asked.join(listed, "q").select(
            "q", F.size("vector").alias("space"), F.lit(0).cast("bigint").alias("node"), "label", "vector", "windows"
        )

    first = _visit(tree, packed(windows), top, alike, True, settings)
    # what one leaf answers is at least reached by the rest: nothing below it can be among the `top`
    sure = first.groupBy("q", "key").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("reached")).where(F.col("n") == top)
    raised = windows.join(sure, ["q", "key"], "left").select(
        "q", "key", F.greatest("low", F.coalesce("reached", "low")).alias("low"), "high"
    )
    return _visit(tree, packed(stored(raised)), top, alike, False, settings)


def mine(embeddings: DataFrame, is_anchor: Column, label: Column, settings: Settings = Settings()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Positives are the anchor's highest scores among rows of its label, negatives the highest scores between `low`
    and `high` percent of the positive's among rows of other labels; ties go to the smaller id.
    """
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * settings.scale))
    rows = embeddings.where(finite(F.col("embedding"))).select(
        F.col("vec_id").cast("bigint").alias("id"), label.cast("bigint").alias("label"), scaled.alias("vector"), is_anchor.alias("asks")
    ).where("id is not null and label is not null")
    keep = max(settings.positives + 1, settings.negatives)
    order = Window.partitionBy("label", "vector").orderBy("id")
    few = rows.select("id", "label", "vector").distinct().withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= keep)
    points = stored(few.groupBy("label", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    anchors = rows.where("asks").select(F.col("id").alias("anchor_id"), "label", "vector").distinct()
    asked = stored(anchors.select("label", "vector").distinct().withColumn("q", F.monotonically_increasing_id()))
    tree = grow(points, settings)

    every = asked.select("q", F.lit(0).cast("bigint").alias("key"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))
    positives = nearest(tree, asked, every, settings.positives + 1, True, settings)
    score = F.col("key")
    whole, rest = F.floor(score / F.lit(100).cast("decimal(20,0)")).cast("bigint"), score % 100
    windows = positives.where("score >= 0").select("q", F.col("score").alias("key")).distinct().select(
        "q",
        "key",
        (settings.low * whole + F.ceil(settings.low * rest / F.lit(100))).alias("low"),
        (settings.high * whole + F.floor(settings.high * rest / F.lit(100))).alias("high"),
    )
    negatives = nearest(tree, asked, stored(windows), settings.negatives, False, settings)

    listed = positives.groupBy("q").agg(F.collect_list(F.struct("rank", "id", "score", "own")).alias("positives"))
    numbered = anchors.join(asked, ["label", "vector"]).select("anchor_id", "q").join(listed, "q")
    others = F.filter(F.sort_array("positives"), lambda p: ~(p.own & (p.id == F.col("anchor_id"))))
    pairs = numbered.select("anchor_id", "q", F.explode(F.slice(others, 1, settings.positives)).alias("p"))
    pairs = pairs.select("anchor_id", "q", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    found = negatives.groupBy("q", F.col("key").alias("positive_score")).agg(
        F.collect_list(F.struct("rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))).alias("found")
    )
    return pairs.join(found, ["q", "positive_score"]).select("anchor_id", "positive_id", "positive_score", F.inline("found")).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
