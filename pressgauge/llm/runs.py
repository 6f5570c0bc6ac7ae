"""Periodic runs of words, by maximal pairs of the LCP-interval tree.

A run is a stretch of words of smallest period q, at least `repeats` periods and `least` words long, that neither
neighbour extends. Seen from its start it is a pair of equal stretches q words apart: equal for `length - q` words,
the word before them and the word after them different. Such maximal pairs are read off the suffix array of a text.

The suffixes of many texts are sorted at once by prefix doubling (ranks by 1, 2, 4, ... words, kept for the lengths
of common prefixes). A common prefix shorter than `_shortest` cannot belong to a run, so the tree of LCP intervals is
walked above that length only. Going bottom-up, each interval merges the place lists of its children, the shorter
ones into the longest, every place in the class of the word on its left. A pair of places from different children
that are next to one another in the merged list, in different classes and at most (common length) / (repeats - 1)
apart, is a run as it stands: places in between would show a smaller period, and none of the ends can move.

Rows stay rows: no shuffle, one answer a row, so repeated rows are answered alike. Null text has no words. Texts are
worked through in slices of bounded bytes, a longer text alone. Columns but doc_id and text stay behind.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pressgauge.llm.common import doc_text, map_arrow

# Words of a text (doc_id, their number) that other words of it replace, as places; None leaves them as they are.
Rewrite = Callable[[object, int], "np.ndarray | None"]


@dataclass(frozen=True)
class Settings:
    repeats: int = 4  # periods in a run, at least (2 or more)
    least: int = 6  # words in a run, at least


def _shortest(settings: Settings) -> int:
    """The shortest common prefix that a run's two stretches can have."""
    return min(max(settings.least - q, (settings.repeats - 1) * q) for q in range(1, settings.least + 1))


def _repeated(words: np.ndarray, text: np.ndarray, size: int) -> np.ndarray:
    """Whether each place begins `size` words all of which occur again in their text."""
    _, back, times = np.unique(text * (words.max(initial=0) + 1) + words, return_inverse=True, return_counts=True)
    again = np.concatenate([[0], np.cumsum(times[back] > 1)])
    stop = np.arange(len(words)) + size
    inside = stop <= len(words)
    stop = np.minimum(stop, len(words))
    found = inside & (again[stop] - again[:-1] == size)
    found[found] = text[stop[found] - 1] == text[found]
    return found


def _ranks(words: np.ndarray, text: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words inside their text; the last ones are all different.

    `ends`: for each place the end of its text. Places of different texts never have equal ranks.
    """
    n = len(words)
    _, back, times = np.unique(text * (words.max(initial=0) + 1) + words, return_inverse=True, return_counts=True)
    rank = (np.cumsum(times) - times)[back]
    levels, open_, step = [rank], np.flatnonzero(times[back] > 1), 1
    while len(open_):
        beyond = open_ + step
        second = np.where(beyond < ends[open_], rank[np.minimum(beyond, n - 1)], -1)
        order = np.argsort(rank[open_] * (n + 1) + second + 1, kind="stable")
        places, second = open_[order], second[order]
        before = rank[places]
        group = np.append(True, before[1:] != before[:-1])
        part = group | np.append(True, second[1:] != second[:-1])
        at = np.arange(len(places))
        heads = np.maximum.accumulate(np.where(part, at, 0))
        rank = rank.copy()
        rank[places] = before + heads - np.maximum.accumulate(np.where(group, at, 0))
        levels.append(rank)
        alone = part & np.append(part[1:], True)
        open_, step = places[~alone], 2 * step
    return levels


def _common(levels: list[np.ndarray], ends: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many words the suffixes at `one` and `two` have in common."""
    length = np.zeros(len(one), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = one + length, two + length
        inside = (a < ends[one]) & (b < ends[two])
        same = np.zeros(len(one), bool)
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        length += same << k
    return length


def _merge(children: list[list[int]], common: int, left: np.ndarray, reach: int, out: list) -> list[int]:
    """The places of an interval; pairs of neighbours from different children, a period apart, go to `out`."""
    children.sort(key=len)
    merged = children.pop()
    child = {place: k for k, places in enumerate(children) for place in places}
    if 8 * len(child) > len(merged):
        merged = sorted([*merged, *child])
    else:
        for place in child:
            insort(merged, place)
    most = common // reach
    for place, k in child.items():
        at = bisect_left(merged, place)
        if at + 1 < len(merged):
            other = merged[at + 1]
            if other - place <= most and child.get(other) != k and left[place] != left[other]:
                out.append((place, other - place, common))
        if at:
            other = merged[at - 1]
            if place - other <= most and other not in child and left[place] != left[other]:
                out.append((other, place - other, common))
    return merged


def _pairs(places: list[int], common: list[int], left: np.ndarray, reach: int) -> list[tuple[int, int, int]]:
    """(place, distance, common length) of the maximal pairs among suffixes in order; common[k]: of k and k + 1."""
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, list[list[int]]]] = []
    for place, length in zip(places, [*common, 0], strict=True):
        node = [place]
        while stack and stack[-1][0] > length:
            depth, children = stack.pop()
            node = _merge([*children, node], depth, left, reach, out)
        if stack and stack[-1][0] == length:
            stack[-1][1].append(node)
        elif length:
            stack.append((length, [node]))
    return out


def find(words: np.ndarray, sizes: np.ndarray, settings: Settings = Settings()) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text, by start and period. words: numbers, text after text."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    text = np.repeat(np.arange(len(sizes)), sizes)
    shortest, reach = _shortest(settings), settings.repeats - 1
    hopeful = np.zeros(len(sizes), bool)
    if len(words):
        hopeful[text[_repeated(words, text, shortest)]] = True
    chosen = hopeful[text] if len(words) else np.zeros(0, bool)
    words, text = words[chosen], text[chosen]
    n = len(words)
    if n < 2:
        return found
    counts = np.where(hopeful, sizes, 0)
    last = np.cumsum(counts)
    ends = last[text]
    levels = _ranks(words, text, ends)
    order = np.empty(n, np.int64)
    order[levels[-1]] = np.arange(n)
    same = text[order[1:]] == text[order[:-1]]
    common = np.zeros(n - 1, np.int64)
    common[same] = _common(levels, ends, order[:-1][same], order[1:][same])
    # subtrees above the shortest common prefix; one whose places are all too far apart holds no run
    joined = common >= shortest
    tree = np.cumsum(np.append(True, ~joined)) - 1
    trees = int(tree[-1]) + 1
    deepest = np.zeros(trees, np.int64)
    np.maximum.at(deepest, tree[:-1][joined], common[joined])
    by_place = np.lexsort((order, tree))
    places, owner = order[by_place], tree[by_place]
    within = owner[1:] == owner[:-1]
    nearest = np.full(trees, n, np.int64)
    np.minimum.at(nearest, owner[1:][within], np.diff(places)[within])
    # the class of a place is the word on its left; a text's first place is alone in its class
    left = np.append(-1, words[:-1])
    firsts = last[counts > 0] - counts[counts > 0]
    left[firsts] = -1 - np.arange(len(firsts))
    starts = np.searchsorted(tree, np.arange(trees + 1))
    for t in np.flatnonzero(nearest * reach <= deepest):
        a, b = starts[t], starts[t + 1]
        for place, period, length in _pairs(order[a:b].tolist(), common[a : b - 1].tolist(), left, reach):
            if length + period >= settings.least:
                k = text[place]
                found[k].append((int(place - last[k] + counts[k]), int(length + period), int(period)))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with most periods; ties: smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when each run is cut down to its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


SCHEMA = (
    "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, n_runs bigint, start bigint, "
    "length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed string"
)


def scan(docs: DataFrame, rewrite: Rewrite | None = None, settings: Settings = Settings(), digest: bool = False) -> DataFrame:
    """doc_id with all runs of its text, the strongest one, a digest of them, and the text without repeated periods.

    The strongest run's columns are null where there is none. `collapsed` joins the kept words by one space; with
    `digest` it is the SHA-256 of that. `rewrite` may put other words of the text in the place of its words first.
    """
    rows = doc_text(docs)
    hold = settings

    def work(batch: pa.RecordBatch) -> dict:
        numbers: dict[bytes, int] = {}
        texts, ids = [], []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
            words = text.split()  # at the six blanks
            places = rewrite(doc_id, len(words)) if rewrite else None
            if places is not None:
                words = [words[k] for k in places]
            texts.append(words)
            ids.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
        sizes = np.array([len(words) for words in texts], np.int64)
        found = find(np.concatenate(ids) if ids else np.zeros(0, np.int64), sizes, hold)
        best = [strongest(runs) for runs in found]
        lines = ["".join(f"{s},{n},{q}\n" for s, n, q in runs) for runs in found]
        collapsed = []
        for words, runs in zip(texts, found, strict=True):
            if runs:
                words = [w for w, stays in zip(words, kept_words(len(words), runs), strict=True) if stays]
            collapsed.append(b" ".join(words))
        column = lambda k: pa.array([b and b[k] for b in best], pa.int64())
        one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        return {
            "doc_id": batch["doc_id"],
            "n_words": pa.array(sizes),
            "runs": pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in found], pa.list_(one)),
            "n_runs": pa.array([len(runs) for runs in found], pa.int64()),
            "start": column(0),
            "length": column(1),
            "period": column(2),
            "exponent_milli": pa.array([b and 1000 * b[1] // b[2] for b in best], pa.int64()),
            "runs_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in lines], pa.string()),
            "collapsed": pa.array([hashlib.sha256(x).hexdigest() for x in collapsed], pa.string())
            if digest
            else pa.array(collapsed, pa.binary()).cast(pa.string(), safe=False),
        }

    return map_arrow(rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {SCHEMA}", work)
