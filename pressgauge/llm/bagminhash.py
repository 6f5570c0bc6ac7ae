"""Near-duplicate detection by BagMinHash signatures of shingle multisets.

A text is the multiset of its five-word shingles. Each (shingle, weight interval) owns a Poisson
process: arrivals at rate 1 for each register and unit of weight, each at a random place of its
interval and in a random register, all of it a function of the shingle's hash. The intervals are
dyadic, [0, 1), [1, 2), [2, 4), ..., and an arrival counts for a text if its place lies below the
shingle's count there, which is what splitting the interval again and again at the count decides.
A register keeps its earliest arrival, so two texts agree in a register with the probability of
their weighted Jaccard similarity (counts are their own discretisation, so nothing is rounded). As
registers only accept arrivals before their present ones, a process is followed just up to the
latest of its text's registers; long texts stop after an arrival or two.

Signatures are cut into bands; texts that share a band are candidates, verified by the exact overlap
of their multisets. Equal texts are one node from the start. A bucket's texts are compared with one of
them, the bucket's pivot, so that a bucket of n texts costs n comparisons, not n^2; pairs that are in one
component already need none. The texts of buckets that still hold several components are then brought together by
what any pair at the similarity must share, one of the rarest shingles of both its texts: first, in rounds, each text
with one hub, the text of the most common shingles, which joins the copies of one original; then every pair of
different components that is left, unless the places of the shared shingle or the bitmaps of all shingles exclude it.
So no pair that shares a band is left out. Components are those of all verified pairs.

A text of one to four words has one shingle, all its words. Texts without words are linked to their
exact copies only. Null text is the empty text. Repeated rows get the same class. A class is named
by its smallest doc_id (null if it has no other).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.llm import hashing
from pressgauge.llm.common import cut_lineage, doc_text, map_arrow, pieces, stored, utf8_buffer

PIECE = 1_000_000  # bytes of text that are hashed at once
CELL_BITS, BLOCK_BITS = 22, 12  # of the table that tells common shingles; it only decides what a run costs
BITS = 1_024  # of a text's parity bitmap; likewise
BITMAP = [f"b{k}" for k in range(BITS // 64)]
ROWS_PER_TASK = 50_000  # of links; likewise
HUB_ROUNDS = 2  # before the remaining pairs are joined; likewise


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    bands: int = 25  # a pair at 0.8 shares no band with probability 0.00005
    rows: int = 5


def signatures(text: np.ndarray, shingle: np.ndarray, times: np.ndarray, n_texts: int, registers: int) -> np.ndarray:
    """For each text and register the identity of the earliest arrival; 0 for texts without shingles."""
    # one process for each weight interval that the shingle reaches: 0 is [0, 1), k is [2^(k-1), 2^k)
    levels = np.where(times > 1, np.ceil(np.log2(np.maximum(times, 1))).astype(np.int64) + 1, 1)
    owner = np.repeat(np.arange(len(text)), levels)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.where(level > 0, low, 1).astype(float)
    of, cap = text[owner], times[owner]
    seed = hashing.mix(shingle[owner] + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    clock = np.zeros(len(owner))
    earliest = np.full(n_texts * registers, np.inf)
    keys, clocks, names = [], [], []
    start, length = 0, 1
    while len(owner):
        steps = np.arange(start, start + length, dtype=np.uint64)
        name = hashing.mix(seed[:, None] + steps[None, :] * np.uint64(0xD6E8FEB86659FD93))
        gap = ((name >> np.uint64(11)).astype(float) + 1) * 2.0**-53
        when = clock[:, None] + np.cumsum(-np.log(gap), axis=1) / (registers * width[:, None])
        more = hashing.mix(name)
        register = ((more >> np.uint64(32)) % np.uint64(registers)).astype(np.int64)
        place = low[:, None] + ((more & np.uint64(0xFFFFFFFF)).astype(float) * 2.0**-32 * width[:, None]).astype(np.int64)
        key = of[:, None] * registers + register
        counts = (place < cap[:, None]) & (when < earliest[key])
        key, at, name = key[counts], when[counts], name[counts]
        np.minimum.at(earliest, key, at)
        keys.append(key), clocks.append(at), names.append(name)
        clock = when[:, -1]
        latest = earliest.reshape(n_texts, registers).max(axis=1)
        open_ = clock < latest[of]
        of, cap, low, width, seed, clock = of[open_], cap[open_], low[open_], width[open_], seed[open_], clock[open_]
        owner = owner[open_]
        # few processes stay open, those of short texts: they go on in longer strides
        start, length = start + length, max(1, min(2 * length, 500_000 // max(1, len(owner))))
    out = np.zeros(n_texts * registers, np.uint64)
    if keys:
        key, at, name = np.concatenate(keys), np.concatenate(clocks), np.concatenate(names)
        order = np.lexsort((at, key))
        first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])) if len(order) else order
        out[key[order][first]] = name[order][first]
    return out.reshape(n_texts, registers)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each band, which also tells the bands apart."""
    keys = np.tile(np.arange(bands, dtype=np.uint64), (len(signature), 1))
    for k in range(rows):
        keys = hashing.mix(keys ^ signature[:, k::rows][:, :bands])
    return keys.view(np.int64)


def sketch(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, content (a digest of the text) and keys (of the bands; empty without shingles). No shuffle."""
    rows = doc_text(docs).withColumn("content", F.md5(F.col("text").cast("binary")))

    def work(batch: pa.RecordBatch) -> dict:
        data, offsets = utf8_buffer(batch["text"])
        text, shingle, times = hashing.shingles(data, offsets, settings.words)
        found = signatures(text, shingle, times, batch.num_rows, settings.bands * settings.rows)
        keys = band_keys(found, settings.bands, settings.rows)
        some = np.zeros(batch.num_rows, bool)
        some[text] = True
        ends = np.append(0, np.cumsum(some * settings.bands)).astype(np.int32)
        return {
            "doc_id": batch["doc_id"],
            "content": batch["content"],
            "keys": pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].ravel())),
        }

    def small(batch: pa.RecordBatch) -> dict:
        found = [work(p) for p in pieces(batch, "text", PIECE)]
        return {c: pa.concat_arrays([f[c] for f in found]) for c in found[0]}

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, f"doc_id {kind}, content string, keys array<bigint>", small)


def overlap(first: pa.Array, second: pa.Array, words: int) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets, row by row; 0 where neither has shingles."""
    n, parts = len(first), []
    totals = np.zeros(n)
    for column in (first, second):
        text, shingle, times = hashing.shingles(*utf8_buffer(column), words)
        totals += np.bincount(text, times, n)
        parts.append((text, shingle, times))
    text, shingle, times = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((shingle, text))
    text, shingle, times = text[order], shingle[order], times[order]
    both = np.flatnonzero((text[1:] == text[:-1]) & (shingle[1:] == shingle[:-1]))
    shared = np.bincount(text[both], np.minimum(times[both], times[both + 1]), n)
    return np.where(totals > 0, shared / np.maximum(totals - shared, 1), 0.0)


def verify(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """a, b and the exact similarity of their texts. texts: content, text."""
    left = texts.select(F.col("content").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("content").alias("b"), F.col("text").alias("text_b"))
    rows = pairs.select("a", "b").join(left, "a").join(right, "b")

    def work(batch: pa.RecordBatch) -> dict:
        found = [overlap(p["text_a"], p["text_b"], words) for p in pieces(batch, "text_a", PIECE)]
        return {"a": batch["a"], "b": batch["b"], "similarity": pa.array(np.concatenate(found))}

    return map_arrow(rows, "a string, b string, similarity double", work, "text_b")


def _few_tasks(links: DataFrame, rows: int) -> DataFrame:
    """`links` in as many tasks as so many rows need: each task of a shuffle writes files of its own, however few its rows."""
    return links.coalesce(max(1, math.ceil(rows / ROWS_PER_TASK)))


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node of the links (a, b).

    Every node points to the smallest node it knows of; large-star and small-star steps alternate until
    every node points to one other, which points to none: a number of rounds that grows with the logarithm
    of a component's size.
    """

    def both_ways(frame: DataFrame, one: tuple, other: tuple) -> DataFrame:
        ends = [F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in (one, other)]
        return frame.select(F.inline(F.array(*ends)))

    def unfinished(edges: DataFrame) -> bool:
        out, held = F.col("node") == F.col("u"), F.col("node") == F.col("v")
        ends = edges.select("u", "v", F.explode(F.array("u", "v")).alias("node"))
        ends = ends.groupBy("node").agg(F.count(F.when(out, 1)).alias("out"), F.max(held).alias("held"))
        return not ends.where("out > 1 or (out > 0 and held)").isEmpty()

    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = cut_lineage(edges)
    rows = edges.count()
    edges = _few_tasks(edges, rows)
    while unfinished(edges):
        both = both_ways(edges, ("u", "v"), ("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: greater neighbours go to the least
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = _few_tasks(large, rows)
        # small star: lesser neighbours, and the node itself, go to the least
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = both_ways(large.join(least, "u"), ("v", "m"), ("u", "m")).where("u <> v")
        edges = _few_tasks(cut_lineage(small.distinct()), rows)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def prefixes(members: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """What decides which members can reach the similarity, one row for each: size (its shingles), short (length of the
    prefix by which the shorter of a pair is found), common (how frequent its shingles are, on average), a parity bitmap
    of its shingles (BITMAP columns) and tokens, its prefix.

    In one order of all shingles (each counted as often as it occurs), a pair of overlap o shares one of the first
    size - o + 1 of both its texts. Shingles that many members have come last in that order, so what is common to
    many brings few together.
    """
    session, t = members.sparkSession, settings.similarity
    rows = members.join(texts.withColumnRenamed("content", "member"), "member").select("member", "text")

    def count(batch: pa.RecordBatch) -> dict:
        _, shingle, _ = hashing.shingles(*utf8_buffer(batch["text"]), settings.words)
        cell, n = np.unique(shingle >> np.uint64(64 - CELL_BITS), return_counts=True)
        block, first = np.unique(cell >> np.uint64(BLOCK_BITS), return_index=True)
        edges = np.append(first, len(cell))
        within, n = (cell & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.uint16), n.astype(np.uint32)
        parts = list(zip(edges[:-1], edges[1:], strict=True))
        return {
            "block": pa.array(block.astype(np.int32)),
            "cells": pa.array([within[i:j].tobytes() for i, j in parts], pa.binary()),
            "counts": pa.array([n[i:j].tobytes() for i, j in parts], pa.binary()),
        }

    def add_up(parts: pd.DataFrame) -> pd.DataFrame:
        sums = np.zeros(1 << BLOCK_BITS)
        for cells, counts in zip(parts["cells"], parts["counts"], strict=True):
            sums[np.frombuffer(cells, np.uint16)] += np.frombuffer(counts, np.uint32)
        return pd.DataFrame({"block": parts["block"].iloc[:1], "levels": [np.log2(sums + 1).astype(np.uint8).tobytes()]})

    counted = map_arrow(rows.select("text"), "block int, cells binary, counts binary", count)
    levels = np.zeros((1 << CELL_BITS - BLOCK_BITS, 1 << BLOCK_BITS), np.uint8)
    for row in counted.groupBy("block").applyInPandas(add_up, "block int, levels binary").toLocalIterator():
        levels[row["block"]] = np.frombuffer(row["levels"], np.uint8)
    shared = session.sparkContext.broadcast(levels.ravel())

    def prefix(batch: pa.RecordBatch) -> dict:
        text, shingle, times = hashing.shingles(*utf8_buffer(batch["text"]), settings.words)
        level = shared.value[(shingle >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
        order = np.lexsort((shingle, level, text))
        text, shingle, times, level = text[order], shingle[order], times[order], level[order]
        n = batch.num_rows
        size = np.bincount(text, times, n).astype(np.int64)
        # the shorter of a pair overlaps by 2 t / (1 + t) of its size at least, the longer by t
        short = size - np.ceil(size * (2 * t / (1 + t)) - 1e-6).astype(np.int64) + 1
        long = size - np.ceil(size * t - 1e-6).astype(np.int64) + 1
        which = np.repeat(np.arange(len(text)), times)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        token = hashing.mix(shingle[which] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        place = np.arange(len(which)) - (np.cumsum(size) - size)[text[which]]
        # a bit tells whether an odd number of a text's shingles fall on it
        at, number = np.unique(text[which] * BITS + (token % np.uint64(BITS)).astype(np.int64), return_counts=True)
        at = at[number % 2 == 1]
        words = np.zeros(n * (BITS // 64), np.uint64)
        np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        words = words.view(np.int64).reshape(n, -1)
        kept = place < long[text[which]]
        ends = np.append(0, np.cumsum(np.bincount(text[which][kept], minlength=n))).astype(np.int32)
        return {
            "member": batch["member"],
            "size": pa.array(size),
            "short": pa.array(short),
            "common": pa.array(np.bincount(text, times * level.astype(float), n) / np.maximum(size, 1)),
            **{name: pa.array(words[:, k]) for k, name in enumerate(BITMAP)},
            "tokens": pa.ListArray.from_arrays(pa.array(ends), pa.array(token[kept].view(np.int64))),
        }

    def small(batch: pa.RecordBatch) -> dict:
        found = [prefix(p) for p in pieces(batch, "text", PIECE)]
        return {c: pa.concat_arrays([f[c] for f in found]) for c in found[0]}

    bitmap = ", ".join(f"{name} bigint" for name in BITMAP)
    return stored(map_arrow(rows, f"member string, size bigint, short bigint, common double, {bitmap}, tokens array<bigint>", small))


def _traits(prefixed: DataFrame, side: str) -> DataFrame:
    """Member, size and bitmap under the names of one side of a pair."""
    named = [F.col(c).alias(f"{side}_{c}") for c in ("size", *BITMAP)]
    return prefixed.select(F.col("member").alias(side), *named)


def _reachable(settings: Settings) -> Column:
    """Whether the bitmaps of x and y leave the similarity open. Bits that differ are shingles that one of them lacks, so
    there are at least as many of those; never false for a pair that reaches it."""
    apart = sum((F.bit_count(F.col(f"x_{b}").bitwiseXOR(F.col(f"y_{b}"))) for b in BITMAP), F.lit(0))
    both = F.col("x_size") + F.col("y_size")
    return both - apart >= both * (2 * settings.similarity / (1 + settings.similarity)) - 1e-6


def _several(labeled: DataFrame, *more: Column) -> DataFrame:
    """Tokens by which members of different components (c) can be found."""
    ends = [F.min("c").alias("__low"), F.max("c").alias("__high"), F.max("short").alias("__short")]
    found = labeled.groupBy("token").agg(*ends, *more).where("__short and __low <> __high")
    return found.drop("__low", "__high", "__short")


def hub_pairs(labeled: DataFrame, prefixed: DataFrame, settings: Settings) -> DataFrame:
    """a, b: each member with one hub. A token's hub is the member whose shingles are the most common: the text that
    others were made from, if there is one. Of the hubs of other components it takes the one met most often.

    labeled: member, token, short, common, c. A token of n members gives n rows.
    """
    hub = F.max_by(F.struct(F.col("member").alias("y"), F.col("c").alias("__y")), F.struct("common", "member"))
    met = labeled.join(_several(labeled, hub.alias("hub")), "token").where("c <> hub.__y")
    votes = met.groupBy(F.col("member").alias("x"), "hub.y").count()
    votes = votes.join(_traits(prefixed, "x"), "x").join(_traits(prefixed, "y"), "y").where(_reachable(settings))
    one = votes.groupBy("x").agg(F.max_by("y", F.struct("count", "y")).alias("y"))
    return one.select(*_pair("x", "y"))


def candidates(labeled: DataFrame, prefixed: DataFrame, settings: Settings) -> DataFrame:
    """a, b: every pair of members of different components that can reach the similarity, and few others.

    Of what a pair shares, the token that comes first in the order has all the rest behind it in both texts: where
    less is left behind a token than the similarity takes, or the bitmaps exclude it, the pair never becomes a row.
    labeled: member, token, place, short, c.
    """
    t = settings.similarity
    labeled = labeled.join(_several(labeled), "token")
    left = labeled.where("short").select("token", F.col("member").alias("x"), F.col("c").alias("__x"), F.col("place").alias("p"))
    right = labeled.select("token", F.col("member").alias("y"), F.col("c").alias("__y"), F.col("place").alias("q"))
    left, right = left.join(_traits(prefixed, "x"), "x"), right.join(_traits(prefixed, "y"), "y")
    m, n = F.col("x_size"), F.col("y_size")
    met = left.join(right, "token").where(
        (F.col("__x") != F.col("__y"))
        & (m >= n * F.lit(t) - 1e-6)
        & ((m < n) | ((m == n) & (F.col("x") < F.col("y"))))
        & (F.least(m - F.col("p"), n - F.col("q")) >= (m + n) * (t / (1 + t)) - 1e-6)
        & _reachable(settings)
    )
    return met.select(*_pair("x", "y")).distinct()


def link(sketches: DataFrame, docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """node (content) and component, for contents that are linked to others."""
    distinct = sketches.groupBy("content").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"))
    members = distinct.select("content", "doc_id", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.min("content").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    members = cut_lineage(members.join(buckets, "key").withColumnRenamed("content", "member"))

    # the texts of candidates: of each, the rows of its smallest doc_id
    wanted = members.groupBy(F.col("member").alias("content")).agg(F.first("doc_id").alias("__doc"))
    texts = doc_text(docs).withColumn("content", F.md5(F.col("text").cast("binary")))
    texts = stored(
        texts.join(wanted, "content").where(F.col("doc_id").eqNullSafe(F.col("__doc"))).select("content", "text")
    )

    pairs = members.where("member <> pivot").select("pivot", "member").distinct()
    # each member with one pivot first; most other pairs are then within a component
    first = pairs.groupBy("member").agg(F.min("pivot").alias("pivot"))
    checked = cut_lineage(verify(first.select(*_pair("pivot", "member")), texts, settings.words).distinct())
    checked = _few_tasks(checked, checked.count())

    def state() -> DataFrame:
        return cut_lineage(components(checked.where(F.col("similarity") >= settings.similarity)))

    def compare(pairs: DataFrame) -> int:
        """Verifies the pairs that were not yet, and adds them to what is checked."""
        nonlocal checked, found
        new = cut_lineage(pairs.distinct().join(checked.select("a", "b"), ["a", "b"], "left_anti"))
        n_new = new.count()
        if n_new:
            known = _few_tasks(cut_lineage(verify(new, texts, settings.words).distinct()), n_new)
            checked = checked.unionAll(known)
            if not known.where(F.col("similarity") >= settings.similarity).isEmpty():
                found = state()
        return n_new

    def component_of(frame: DataFrame, node: str, name: str) -> DataFrame:
        labels = found.select(F.col("node").alias(node), F.col("component").alias(name))
        return frame.join(labels, node, "left").withColumn(name, F.coalesce(name, node))

    found = state()
    rest = component_of(component_of(pairs, "pivot", "p"), "member", "c").where("p <> c")
    compare(rest.select(*_pair("pivot", "member")))

    # what buckets of several components still leave open
    labeled = component_of(members.where("n > 2").select("key", "member"), "member", "c")
    mixed = labeled.groupBy("key").agg(F.min("c").alias("__low"), F.max("c").alias("__high")).where("__low <> __high")
    rest = cut_lineage(labeled.join(mixed.select("key"), "key").select("member").distinct())
    prefixed = prefixes(rest, texts, settings)
    tokens = prefixed.select("member", "common", F.col("short").alias("__short"), F.posexplode("tokens").alias("place", "token"))
    tokens = tokens.withColumn("short", F.col("place") < F.col("__short")).drop("__short")
    # tokens of one component alone lead nowhere
    labeled = component_of(tokens, "member", "c")
    tokens = cut_lineage(tokens.join(_several(labeled), "token"))
    for _ in range(HUB_ROUNDS):
        if not compare(hub_pairs(component_of(tokens, "member", "c"), prefixed, settings)):
            break
    open_ = cut_lineage(candidates(component_of(tokens, "member", "c"), prefixed, settings))
    # each member with one partner first, as above
    either = open_.select(F.col("a").alias("member"), "a", "b").unionAll(open_.select(F.col("b").alias("member"), "a", "b"))
    one = either.groupBy("member").agg(F.min(F.struct("a", "b")).alias("pair"))
    compare(one.select("pair.a", "pair.b"))
    compare(component_of(component_of(open_, "a", "p"), "b", "c").where("p <> c").select("a", "b"))
    return found


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, content (digest of the text), component (the class's smallest content), class_id and class_size (its
    rows), one row for each row."""
    sketches = cut_lineage(sketch(docs, settings))
    labels = link(sketches, docs, settings).select(F.col("node").alias("content"), "component")
    classes = sketches.select("doc_id", "content").join(labels, "content", "left")
    classes = classes.withColumn("component", F.coalesce("component", "content"))
    named = classes.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return classes.join(named, "component").select("doc_id", "content", "component", "class_id", "class_size")
