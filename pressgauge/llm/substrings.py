"""Exact removal of repeated byte strings of a minimum length, within and across documents.

Every string of `length` bytes that starts twice or more in the corpus marks all bytes it covers.

1. Each such string holds an anchor: of its `gram`-byte grams the one of smallest hash, which depends
   on the string alone. Neighbouring starts share an anchor, so a text falls into runs of starts, about
   one run for 76 bytes. Anchors are counted over the corpus; a fixed-size bitmap of those found twice
   or more goes to all tasks, and other runs are left out. The bitmap may let more pass, never less:
   results don't depend on its size. A second bitmap tells which of them come in several forms, their runs
   being different strings; a run of one form is repeated as a whole if its digest is counted twice.
2. A run of several forms goes, as the bytes that its starts cover, to the shard of its anchor, equal ones
   counted and sent once. All occurrences of a repeated string meet in one shard. A frequent anchor is
   split: starts at near places before the anchor share more than the anchor, and are keyed by that.
   Anchors frequent enough for this are few (each is a certain share of all), so their list is bounded.
   Before that, a string whose anchor is repeated but whose surroundings are not is left out: each start shares
   with its equals the bytes before the anchor or those behind it (see `cores`), which are counted like anchors.
3. In a shard, the Burrows-Wheeler transform of the strings is extended backwards breadth-first: the
   interval of every string of 1, 2, 3, ... bytes gives the places in suffix order where the common
   prefix is 0, 1, 2, ... bytes long. An interval that finds no new place is not followed. The search stops
   at `length` bytes; places not found by then have common prefixes at least that long, so the suffixes
   between two found places share their first `length` bytes. A string that is
   alone with its anchor and counted twice needs no search.
4. Marked ranges return to the texts by content, are merged and cut out.

Null text is the empty text; texts shorter than `length` bytes keep all of theirs, and bytes need not be
UTF-8. Repeated rows are documents like others, so their long texts go entirely.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.llm import hashing
from pressgauge.llm.common import map_arrow, pieces, stored, utf8_buffer

PIECE = 1_000_000  # bytes of text that are hashed at once
BATCH = 16_000_000  # bytes of text whose equal strings are merged before they are sent
TOGETHER = 300_000  # bytes of strings that are searched together: what a processor's cache holds works best
BITMAP = 32_768  # bits of one row of Spark's bitmap functions, a fixed value


@dataclass(frozen=True)
class Settings:
    length: int = 200
    gram: int = 50
    screen_bits: int = 1 << 27  # of the bitmap of repeated anchors: 16 MB
    selfish_bits: int = 1 << 24  # of that of anchors that a run holds twice: 2 MB
    frequent: int = 1_000  # occurrences from which an anchor is split, if they are also ...
    frequent_share: float = 1e-4  # ... this share of all anchors; so at most 10,000 anchors are listed
    shard_bytes: int = 4_000_000  # of candidate strings, on average, before equal ones are merged


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first start, last start, anchor's hash, hash of its bytes) of each run of starts, and the hash of every gram.

    A run is a row of starts of strings with the same anchor, all in one text.
    """
    n, wide = len(data), length - gram + 1
    if n < length:
        none = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), np.zeros(0, np.int64), none, none, none
    sums = hashing.running(data)
    down = hashing.powers(n, hashing.inverse())
    grams = hashing.mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    # the smallest of `wide` neighbours: the smaller of a block's tail and the next block's head
    filled = np.append(grams, np.full(-len(grams) % wide, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, wide)
    tail = np.minimum.accumulate(filled[:, ::-1], axis=1)[:, ::-1].ravel()
    head = np.minimum.accumulate(filled, axis=1).ravel()
    starts = n - length + 1
    least = np.minimum(tail[:starts], head[wide - 1 : wide - 1 + starts])
    # starts whose string stays in its text
    change = np.zeros(n + 1, np.int32)
    lengths = np.diff(offsets)
    np.add.at(change, offsets[:-1], 1)
    np.add.at(change, np.maximum(offsets[:-1], offsets[1:] - length + 1), -1)
    start = np.flatnonzero(np.cumsum(change)[:starts] > 0)
    if not len(start):
        return start, start, np.zeros(0, np.uint64), np.zeros(0, np.uint64), grams
    text = np.repeat(np.arange(len(lengths)), np.maximum(lengths - length + 1, 0))
    value = least[start]
    new = np.ones(len(start), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    begins = np.flatnonzero(new)
    first, last = start[begins], start[np.append(begins[1:], len(start)) - 1]
    form = hashing.mix((sums[last + length] - sums[first]) * down[first]) ^ (last - first).astype(np.uint64)
    return first, last, value[begins], form, grams


def split(first: int, last: int, value: int, grams: np.ndarray, depth: int, settings: Settings) -> list[tuple[int, int, int, int, int]]:
    """Parts of a frequent anchor's run: (first start, last start, part's number, from, to).

    The place of the anchor in a string falls into one of 2^depth ranges. Strings of one range share
    the bytes `from` to `to`, which then name the part.
    """
    wide, parts = settings.length - settings.gram + 1, 1 << depth
    places = first + np.flatnonzero(grams[first : last + wide] == np.uint64(value))
    start = np.arange(first, last + 1)
    place = places[np.searchsorted(places, start)]
    part = (place - start) * parts // wide
    begins = np.flatnonzero(np.append(True, (np.diff(part) != 0) | (np.diff(place) != 0)))
    found = []
    for b, e in zip(begins, np.append(begins[1:], len(start)) - 1, strict=True):
        p, k = int(place[b]), int(part[b])
        low, high = -(-k * wide // parts), -(-(k + 1) * wide // parts) - 1
        found.append((int(start[b]), int(start[e]), k, p - low, p - high + settings.length))
    return found


def cores(first: np.ndarray, last: np.ndarray, value: np.ndarray, grams: np.ndarray, settings: Settings) -> tuple[np.ndarray, ...]:
    """(hash, whether there is one) of the bytes before and behind the anchor of each run that holds it once.

    A start that is `half` or more before the anchor covers the `half` bytes before it, any other as much behind it:
    the two parts of `split` at depth 1. Hashes are made of the grams that cover these bytes.
    """
    wide = settings.length - settings.gram + 1
    half = -(-wide // 2)
    place = np.where(grams[first + wide - 1] == value, first + wide - 1, np.where(grams[last] == value, last, -1))
    rest = np.flatnonzero(place < 0)
    if len(rest):
        # the anchor lies in every string of the run
        span = first[rest] + wide - last[rest]
        at = np.cumsum(span) - span
        spots = np.arange(span.sum()) + np.repeat(last[rest] - at, span)
        place[rest] = np.maximum.reduceat(np.where(grams[spots] == np.repeat(value[rest], span), spots, -1), at)

    def told(low: int, high: int, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums = np.full(len(place), high, np.uint64)
        for offset in [*range(low, high - settings.gram, settings.gram), high - settings.gram]:
            sums = hashing.mix(sums ^ grams[np.where(there, place + offset, place)])
        return sums.view(np.int64), there

    return *told(-half, settings.gram, first <= place - half), *told(0, settings.length - half + 1, last > place - half)


def anchors(docs: DataFrame, settings: Settings) -> DataFrame:
    """value, form, times and again: the anchors of each slice's runs with the hash of the run's bytes, how often
    they occur, and whether such a run holds its anchor twice and so may repeat itself."""
    wide = settings.length - settings.gram + 1

    def measured(piece: pa.RecordBatch) -> np.ndarray:
        first, last, value, form, grams = runs(*utf8_buffer(piece["text"]), settings.length, settings.gram)
        again = np.zeros(len(first), np.uint64)
        if len(first):
            span = last - first + wide
            at = np.cumsum(span) - span
            place = np.arange(span.sum(), dtype=np.int32) + np.repeat((first - at).astype(np.int32), span)
            again = (np.add.reduceat((grams[place] == np.repeat(value, span)).astype(np.int32), at) > 1).astype(np.uint64)
        return np.stack([value, form, again])

    def work(batch: pa.RecordBatch) -> dict:
        found = np.concatenate([measured(p) for p in pieces(batch, "text", PIECE)], axis=1)
        order = np.lexsort((found[1], found[0]))
        value, form, again = found[:, order]
        new = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (form[1:] != form[:-1]))[: len(value)])
        return {
            "value": pa.array(value[new].view(np.int64)),
            "form": pa.array(form[new].view(np.int64)),
            "times": pa.array(np.diff(np.append(new, len(value)))),
            "again": pa.array(again[new] > 0),
        }

    return map_arrow(docs.select("text"), "value bigint, form bigint, times bigint, again boolean", work)


def screen(values: DataFrame, settings: Settings) -> np.ndarray:
    """A bitmap of fixed size with the bit of every value."""
    bit = F.shiftrightunsigned("value", 64 - int(math.log2(settings.screen_bits)))
    rows = values.groupBy(F.floor(bit / BITMAP).alias("row")).agg(
        F.bitmap_construct_agg(F.pmod(bit, F.lit(BITMAP))).alias("bits")
    )
    bitmap = np.zeros((settings.screen_bits // BITMAP, BITMAP // 8), np.uint8)
    for row in rows.toLocalIterator():
        bitmap[row["row"]] = np.frombuffer(row["bits"], np.uint8)
    return bitmap.ravel()


def frequent(counts: DataFrame, settings: Settings) -> dict[int, int]:
    """The depth to which anchors are split that are a large share of all. At most 1 / frequent_share of them."""
    total = counts.agg(F.sum("times")).first()[0] or 0
    least = max(settings.frequent, total * settings.frequent_share)
    deepest = (settings.length - settings.gram).bit_length()
    return {
        row["value"]: min(deepest, 1 + int(math.log(row["times"] / least, 16)))
        for row in counts.where(F.col("times") >= least).toLocalIterator()
    }


def in_screen(bitmap: Broadcast, settings: Settings) -> Callable[[Column], Column]:
    """Whether the bit of a value is set; false for null."""
    shift = np.uint64(64 - int(math.log2(settings.screen_bits)))

    @F.arrow_udf("boolean")
    def seen(values: pa.Array) -> pa.Array:
        known = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
        bit = (known.view(np.uint64) >> shift).astype(np.int64)
        return pc.and_(pa.array((bitmap.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0), values.is_valid())

    return seen


STRINGS = (
    "key bigint, digest binary, bytes binary, size int, times bigint, before bigint, behind bigint, "
    "places array<struct<content:binary,start:int>>"
)


def strings_of(
    docs: DataFrame, repeated: np.ndarray, formed: np.ndarray, selfish: np.ndarray, often: dict[int, int], settings: Settings
) -> DataFrame:
    """The strings that may be repeated, each once for a batch of rows: its key, digest, size, number, where it
    starts in which contents, and, if its anchor may come in several forms, its bytes and the hashes of what is
    before and behind the anchor. Neither is told of anchors that a run somewhere may hold twice (`selfish`)."""
    context = docs.sparkSession.sparkContext
    shared, several, twice, split_at = (context.broadcast(x) for x in (repeated, formed, selfish, often))
    shift, few = (np.uint64(64 - int(math.log2(bits))) for bits in (settings.screen_bits, settings.selfish_bits))

    def collect(piece: pa.RecordBatch, found: dict) -> None:
        data, offsets = utf8_buffer(piece["text"])
        contents = piece["content"].to_pylist()
        first, last, value, _, grams = runs(data, offsets, settings.length, settings.gram)
        bit = (value >> shift).astype(np.int64)
        at, in_byte = bit >> 3, (bit & 7).astype(np.uint8)
        seen = (shared.value[at] >> in_byte) & 1 > 0
        forms = ((several.value[at] >> in_byte) & 1 > 0)[seen]
        own = (value >> few).astype(np.int64)
        once = forms & ((twice.value[own >> 3] >> (own & 7).astype(np.uint8)) & 1 == 0)[seen]
        first, last, value = first[seen], last[seen], value[seen]
        sides = np.full((2, len(first)), None, object)
        hashes = cores(first[once], last[once], value[once], grams, settings)
        for side, told, there in zip(sides, hashes[::2], hashes[1::2], strict=True):
            side[once] = np.where(there, told.astype(object), None)
        text = np.searchsorted(offsets, first, "right") - 1
        begins, whole, signed = offsets.tolist(), data.tobytes(), value.view(np.int64)
        for a, b, t, v, u, many, before, behind in zip(
            *(x.tolist() for x in (first, last, text, signed, value, forms, *sides)), strict=True
        ):
            depth = split_at.value.get(v) if many else None
            parts = [(a, b, 0, 0, 0)] if depth is None else split(a, b, u, grams, depth, settings)
            for begin, end, part, low, high in parts:
                key = v
                if depth is not None:
                    core = hashlib.md5(whole[low:high] + bytes([part]) + v.to_bytes(8, "big", signed=True)).digest()
                    key = before = int.from_bytes(core[:8], "big", signed=True)
                    behind = None
                string = whole[begin : end + settings.length]
                name = (key, hashlib.md5(string).digest())
                place = (contents[t], begin - begins[t])
                entry = found.get(name)
                if entry is None:
                    found[name] = [string if many else None, len(string), 1, [place], before, behind]
                    continue
                entry[2] += 1
                if isinstance(entry[3], list):  # most strings have one place, and a set takes thrice the memory
                    entry[3] = set(entry[3])
                entry[3].add(place)

    def work(batch: pa.RecordBatch) -> dict:
        found: dict[tuple[int, bytes], list] = {}
        for piece in pieces(batch, "text", PIECE):
            collect(piece, found)
        held = list(found.values())
        return {
            "key": pa.array([k for k, _ in found], pa.int64()),
            "digest": pa.array([d for _, d in found], pa.binary()),
            "bytes": pa.array([e[0] for e in held], pa.binary()),
            "size": pa.array([e[1] for e in held], pa.int32()),
            "times": pa.array([e[2] for e in held], pa.int64()),
            "before": pa.array([e[4] for e in held], pa.int64()),
            "behind": pa.array([e[5] for e in held], pa.int64()),
            "places": pa.array(
                [[{"content": c, "start": s} for c, s in sorted(e[3])] for e in held],
                pa.list_(pa.struct([("content", pa.binary()), ("start", pa.int32())])),
            ),
        }

    # batches of more rows merge more equal strings before anything is sent; their size is bounded here
    return map_arrow(docs, STRINGS, work, most=BATCH)


def likely(strings: DataFrame, settings: Settings) -> DataFrame:
    """The strings with bytes of which a part may be repeated: what is before or behind their anchor is found twice."""
    searched = strings.where("bytes is not null")
    sides = searched.select(F.explode(F.array("before", "behind")).alias("value"), "times").where("value is not null")
    counted = sides.groupBy("value").agg(F.sum("times").alias("times")).where("times > 1")
    seen = in_screen(strings.sparkSession.sparkContext.broadcast(screen(counted, settings)), settings)
    return searched.where(F.coalesce("before", "behind").isNull() | seen(F.col("before")) | seen(F.col("behind")))


def suffix_order(symbols: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Suffixes in order, each read up to its string's end; equal ones in order of place.

    symbols: 0 ends a string, others are byte + 1. left: how many symbols of a suffix come before that 0.
    """
    n, width = len(symbols), 7
    padded = np.append(symbols, np.zeros(width, np.int64))
    key = np.zeros(n, np.int64)
    for k in range(width):
        key = key << 9 | np.where(left >= k, padded[k : k + n], 0)
    # the place breaks no tie yet, so the fastest sort will do
    order = np.argsort(key)
    key = key[order]
    firsts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    # a suffix's rank is the first place of the group of those that are equal to it so far
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(firsts, np.diff(np.append(firsts, n)))
    open_ = order
    while True:
        mine = rank[open_]
        same = np.append(False, mine[1:] == mine[:-1])
        same[:-1] |= same[1:]
        # a group has ended as a whole, or not at all
        open_ = open_[same & (left[open_] >= width)]
        if not len(open_):
            return np.argsort(rank * n + np.arange(n))
        both = rank[open_] * n + rank[open_ + width]
        again = np.argsort(both)
        open_, both = open_[again], both[again]
        mine = rank[open_]
        starts = np.append(True, mine[1:] != mine[:-1])
        places = np.arange(len(open_))
        inside = places - places[starts][np.cumsum(starts) - 1]
        changes = np.append(True, both[1:] != both[:-1])
        rank[open_] = mine + inside[changes][np.cumsum(changes) - 1]
        width *= 2


def common_prefix_groups(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in suffix order, whether its common prefix with the place before is under `length`.

    Backward extension by breadth: the intervals of all strings of one length are extended by every symbol
    that precedes them. An end symbol opens the search but does not extend: strings do not run on.
    """
    n = len(symbols)
    before = symbols[order - 1].astype(np.uint16)
    counts = np.bincount(symbols, minlength=257)
    first_of = np.append(0, np.cumsum(counts))
    # the place of the suffix one symbol longer: the n-th c of the transform is the n-th suffix with c
    longer = np.empty(n, np.int32)
    longer[np.argsort(before, kind="stable")] = np.arange(n, dtype=np.int32)
    longer[before == 0] = -1
    block = np.zeros(n + 1, bool)
    block[first_of] = True
    found = np.zeros(n + 1, bool)
    used = np.flatnonzero(counts)
    low, high = first_of[used].astype(np.int32), first_of[used + 1].astype(np.int32)
    found[low], found[high] = True, True
    owner = np.full(n + 2, -1, np.int64)  # the last place stands before the first
    stamp = 0
    for _ in range(length - 1):
        if not len(low):
            break
        size = high - low
        if int(size.sum()) == len(low):
            # intervals of one place each: their one extension is one place
            low = longer[low]
            low = low[low >= 0]
            low = low[~(found[low] & found[low + 1])]
            high = low + 1
        else:
            name = np.repeat(np.arange(stamp, stamp + len(low)), size)
            stamp += len(low)
            ends = np.cumsum(size)
            place = longer[np.arange(len(name)) + np.repeat(low - (ends - size), size)]
            extends = place >= 0
            name, place = name[extends], place[extends]
            # places that came from one interval by one symbol lie side by side
            owner[place] = name
            opens = (owner[place - 1] != name) | block[place]
            closes = (owner[place + 1] != name) | block[place + 1]
            low, high = np.sort(place[opens]), np.sort(place[closes]) + 1
            new = ~(found[low] & found[high])
            low, high = low[new], high[new]
        found[low], found[high] = True, True
    return found[:n]


def repeated_starts(strings: list[bytes], times: np.ndarray, length: int) -> list[np.ndarray]:
    """For each string, the starts of its substrings of `length` bytes that occur twice or more."""
    sizes = np.array([len(x) for x in strings]) + 1
    symbols = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes) - 1
    symbols[ends] = 0
    left = np.repeat(ends, sizes) - np.arange(len(symbols))
    order = suffix_order(symbols, left)
    group = np.cumsum(common_prefix_groups(symbols, order, length))
    valid = left[order] >= length
    starts, group = order[valid], group[valid]
    of = np.searchsorted(ends, starts)
    many = np.bincount(group, times[of])[group] > 1
    starts, of = starts[many], of[many]
    by_place = np.argsort(starts, kind="stable")
    starts, of = starts[by_place], of[by_place]
    edges = np.searchsorted(of, np.arange(len(strings) + 1))
    return [starts[a:b] - (e - s + 1) for a, b, e, s in zip(edges[:-1], edges[1:], ends, sizes, strict=True)]


def _covered(starts: np.ndarray, length: int) -> list[dict]:
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > 1)  # touching ranges are merged later
    first, last = starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)]
    return [{"first": int(a), "end": int(b) + length} for a, b in zip(first, last, strict=True)]


def judge_shard(strings: pd.DataFrame, length: int) -> pd.DataFrame:
    """key, digest and the ranges of each string that repeated strings cover."""
    strings = strings.sort_values("key", kind="stable")
    key = strings["key"].to_numpy()
    alone = ~strings["key"].duplicated(keep=False).to_numpy() & (strings["times"] > 1).to_numpy()
    names, texts, times = (strings[c].to_numpy() for c in ("digest", "bytes", "times"))
    keys, digests, ranges = list(key[alone]), list(names[alone]), [[{"first": 0, "end": len(x)}] for x in texts[alone]]
    rest = np.flatnonzero(~alone)
    at = 0
    while at < len(rest):
        end, size = at, 0
        while end < len(rest) and (size < TOGETHER or key[rest[end]] == key[rest[end - 1]]):
            size += len(texts[rest[end]])
            end += 1
        part = rest[at:end]
        for k, name, starts in zip(key[part], names[part], repeated_starts(list(texts[part]), times[part].astype(float), length), strict=True):
            if len(starts):
                keys.append(k)
                digests.append(name)
                ranges.append(_covered(starts, length))
        at = end
    return pd.DataFrame({"key": np.array(keys, np.int64), "digest": digests, "ranges": ranges})


def content_of(text: str) -> Column:
    """A text's MD5 as 16 bytes."""
    return F.unhex(F.md5(text))


def removed_ranges(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """content (MD5 of a text) and ranges (first, end: bytes that repeated strings cover, may overlap)."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    texts = texts.withColumn("content", content_of("text"))
    counts = anchors(texts, settings).groupBy("value").agg(
        F.sum("times").alias("times"),
        F.max("again").alias("again"),
        ((F.min("form") != F.max("form")) | F.max("again")).alias("several"),
    )
    counts = stored(counts.where("times > 1 or again"))
    repeated, formed = screen(counts, settings), screen(counts.where("several"), settings)
    # few anchors are such; one taken for such is only not judged by its surroundings
    selfish = screen(counts.where("again"), replace(settings, screen_bits=settings.selfish_bits))
    strings = stored(strings_of(texts, repeated, formed, selfish, frequent(counts, settings), settings))

    # one form only: it is repeated as a whole, or not at all
    whole = strings.where("bytes is null").groupBy("key", "digest").agg(F.sum("times").alias("times"), F.first("size").alias("size"))
    whole = whole.where("times > 1").select(
        "key", "digest", F.array(F.struct(F.lit(0).alias("first"), F.col("size").alias("end"))).alias("ranges")
    )
    searched = likely(strings, settings)
    size = searched.agg(F.sum("size")).first()[0] or 0
    shards = max(1, math.ceil(size / settings.shard_bytes))
    # batches have merged their equal strings; what is left meets its shard in one shuffle, and is merged there
    dealt = searched.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).repartition(shards, "shard")
    distinct = dealt.groupBy("shard", "key", "digest").agg(F.first("bytes").alias("bytes"), F.sum("times").alias("times"))
    length = settings.length
    judged = distinct.groupBy("shard").applyInPandas(
        lambda found: judge_shard(found, length),
        "key bigint, digest binary, ranges array<struct<first:int,end:int>>",
    )
    judged = stored(judged.unionAll(whole))
    placed = strings.where("bytes is null").unionAll(searched).select("key", "digest", "places").join(judged, ["key", "digest"])
    placed = placed.select(F.explode("places").alias("place"), "ranges")
    return (
        placed.select("place.content", "place.start", F.explode("ranges").alias("r"))
        .select("content", (F.col("start") + F.col("r.first")).alias("first"), (F.col("start") + F.col("r.end")).alias("end"))
        .distinct()
        .groupBy("content")
        .agg(F.collect_list(F.struct("first", "end")).alias("ranges"))
    )


def cut(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) of each row."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("content", content_of("text"))
    found = stored(removed_ranges(docs, settings))
    shared = docs.sparkSession.sparkContext.broadcast(screen(found.select(F.xxhash64("content").alias("value")), settings))
    touched = in_screen(shared, settings)

    # a text that nothing is removed from stays where it is; the bitmap may send more to the join, never less
    rows = rows.withColumn("__touched", touched(F.xxhash64("content")))
    joined = rows.where("__touched").join(found, "content", "left").select("doc_id", "text", "ranges")
    whole = rows.where("not __touched").select("doc_id", "text", F.lit(None).cast(found.schema["ranges"].dataType).alias("ranges"))
    rows = joined.unionAll(whole)

    def work(batch: pa.RecordBatch) -> dict:
        kept, removed, spans = [], [], []
        for text, ranges in zip(batch["text"].to_pylist(), batch["ranges"].to_pylist(), strict=True):
            out, at, gone, n = [], 0, 0, 0
            end = -1
            for r in sorted((r["first"], r["end"]) for r in ranges or ()):
                if r[0] > end:
                    out.append(text[at : r[0]])
                    n += 1
                    gone += r[1] - r[0]
                    end = r[1]
                elif r[1] > end:
                    gone += r[1] - end
                    end = r[1]
                at = end
            kept.append(b"".join(out) + text[at:])
            removed.append(gone)
            spans.append(n)
        return {
            "doc_id": batch["doc_id"],
            "n_bytes": pa.array([len(t) for t in batch["text"].to_pylist()], pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(spans, pa.int64()),
            "kept": pa.array(kept, pa.binary()),
        }

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary", work)
