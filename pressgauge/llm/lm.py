"""Stupid-backoff language-model scores from n-gram counts of the whole corpus.

The model is of order two. Words are runs of characters other than the six blanks; every word of the corpus is a word
of the model, and a text begins with a symbol of its own. With counts over all documents, less the
very occurrence that is scored (leaving one out, or no n-gram would ever be unseen):

    S(w | v) = (c(v w) - 1) / (c(v) - 1)                   if c(v w) > 1
             = backoff * max(c(w) - 1, 1) / (N - 1)        otherwise

and a document's score is the sum of ln S over its words. c of the beginning is the number of texts with
words, N the number of words.

Counting: each task counts the n-grams of its slices first, so a frequent one is sent once for a slice,
not once for an occurrence. The count table is cut into shards by hash; so are the documents' n-grams,
exploded by document and counted, and each shard joins its part of both. A shard whose n-grams are
many (a frequent pair) is cut again by slice of documents, with its counts copied; shards hold shard_words
words on average, so those cut are at most one in share_entries / shard_words and their list is short. A shard
answers with packed sums for a slice's documents, which are added up slice by slice.

Common words (the `vocabulary` most frequent) have short symbols, and their counts are broadcast, at most a million
of them. This saves bytes and changes no answer. The other words are known by their 64-bit hashes, of which two would
meet by chance in a corpus of billions of different words. A pair that ends with such a word goes to a shard by that
word, one that begins with it to a shard by that word, one of two such words to both: there all pairs of the word
meet, so that its count is their sum. No such word is frequent, hence no shard is hot by it. Where both words are
uncommon the shard of the second answers with all but c(v), that of the first with c(v).

Null text is the empty text: 0 words, score 0, mean null. Repeated rows count and are scored like others.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.llm import hashing
from pressgauge.llm.common import cut_lineage, doc_text, map_arrow, pieces, utf8_buffer

PIECE = 4_000_000  # bytes of text whose n-grams are counted together
OTHER, BEGIN = 0, 1  # symbols; the common words follow
SYMBOL_BITS = 20
END = np.uint64(2)  # stands for the word after a text's last
COMMON, ENDS, BEGINS = 0, 1, 2  # kinds of shards: pairs of common words, pairs by their second word, by their first
WIDTH = (5, 8, 8)  # bytes of a key of each kind


@dataclass(frozen=True)
class Settings:
    vocabulary: int = 1_000_000  # common words, at most; symbols have 20 bits. Answers don't depend on it
    backoff: float = 0.4
    shard_words: int = 4_000_000  # of the corpus, for each shard of the count table
    share_entries: int = 8_000_000  # (document, n-gram) entries from which a shard is cut again
    rare_shards: int = 4  # shards of common pairs for each shard of either other kind


@dataclass(frozen=True)
class Vocabulary:
    hashes: np.ndarray  # of its words, ascending
    symbols: np.ndarray  # of these words, from 2 on, the most frequent first
    counts: np.ndarray  # by symbol
    words: int  # of the corpus


@dataclass(frozen=True)
class Shards:
    """Numbers of shards, and how they are laid out: common pairs, then by second word, then by first."""

    common: int
    rare: int

    @property
    def all(self) -> int:
        return self.common + 2 * self.rare

    def kind(self, shard: int) -> int:
        return COMMON if shard < self.common else 1 + (shard - self.common) // self.rare

    def of(self, kind: int, words: np.ndarray) -> np.ndarray:
        first, number = ((0, self.common), (self.common, self.rare), (self.common + self.rare, self.rare))[kind]
        return first + (hashing.mix(words) % np.uint64(number)).astype(np.int64)


@dataclass(frozen=True)
class Words:
    """The words of a slice and what stands before them."""

    symbol: np.ndarray
    hashed: np.ndarray
    before: np.ndarray
    hashed_before: np.ndarray
    text: np.ndarray  # which text each is of
    last: np.ndarray  # whether it is its text's last


def _words(batch: pa.RecordBatch, common: tuple[np.ndarray, np.ndarray]) -> Words:
    """`common`: hashes and symbols of the common words."""
    hashes, symbols = common
    found, first = hashing.words(*utf8_buffer(batch["text"]))
    place = np.searchsorted(hashes, found)
    place[place == len(hashes)] = 0
    known = hashes[place] == found if len(hashes) else np.zeros(len(found), bool)
    symbol = np.where(known, symbols[place].astype(np.int64), OTHER) if len(hashes) else np.full(len(found), OTHER)
    opens, last = np.zeros(len(found), bool), np.zeros(len(found), bool)
    opens[first[:-1][np.diff(first) > 0]] = True
    last[first[1:][np.diff(first) > 0] - 1] = True
    before = np.where(opens, BEGIN, np.roll(symbol, 1))
    hashed_before = np.where(opens, np.uint64(BEGIN), np.roll(found, 1))
    return Words(symbol, found, before, hashed_before, np.repeat(np.arange(batch.num_rows), np.diff(first)), last)


def _hash_pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return hashing.mix(hashing.mix(first) + second)


def _pairs(words: Words, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of a kind: which words end them, their keys, the word they go by, and the symbol of the other."""
    if kind == COMMON:
        some = np.flatnonzero((words.symbol != OTHER) & (words.before != OTHER))
        keys = (words.before[some] << SYMBOL_BITS | words.symbol[some]).astype(np.uint64)
        return some, keys, keys, words.before[some]
    some = np.flatnonzero((words.symbol if kind == ENDS else words.before) == OTHER)
    keys = _hash_pairs(words.hashed_before[some], words.hashed[some])
    if kind == ENDS:
        return some, keys, words.hashed[some], words.before[some]
    return some, keys, words.hashed_before[some], words.symbol[some]


def pack(numbers: np.ndarray, width: int) -> bytes:
    """The low bytes of whole numbers, all first bytes, then all second ones, and so on, compressed."""
    planes = np.ascontiguousarray(numbers, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return len(numbers).to_bytes(4, "little") + pa.compress(np.ascontiguousarray(planes), codec="zstd", asbytes=True)


def unpack(packed: bytes, width: int) -> np.ndarray:
    n = int.from_bytes(packed[:4], "little")
    wide = np.zeros((n, 8), np.uint8)
    if n:
        planes = pa.decompress(packed[4:], n * width, codec="zstd")
        wide[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return wide.view("<u8").ravel()


def _numbers(packed: pd.Series, width: int) -> np.ndarray:
    return np.concatenate([unpack(x, width) for x in packed])


def vocabulary(docs: DataFrame, settings: Settings) -> Vocabulary:
    def work(batch: pa.RecordBatch) -> dict:
        found = [hashing.words(*utf8_buffer(p["text"])) for p in pieces(batch, "text", PIECE)]
        words, times = np.unique(np.concatenate([w for w, _ in found]), return_counts=True)
        texts = sum(int((np.diff(first) > 0).sum()) for _, first in found)
        # the number of texts with words travels along, under a mark
        return {
            "word": pa.array(np.append(words.view(np.int64), 0)),
            "times": pa.array(np.append(times, texts)),
            "mark": pa.array(np.append(np.zeros(len(words), bool), True)),
        }

    rows = map_arrow(docs.select("text"), "word bigint, times bigint, mark boolean", work)
    counts = cut_lineage(rows.groupBy("mark", "word").agg(F.sum("times").alias("times")))
    words = counts.where("not mark")
    total = words.agg(F.sum("times")).first()[0] or 0
    texts = counts.where("mark").agg(F.sum("times")).first()[0] or 0
    # how many words have each count, from the top: enough to see below which count the vocabulary ends
    counted = words.groupBy("times").agg(F.count("*").alias("n")).orderBy(F.desc("times")).limit(settings.vocabulary + 1)
    least, room = 0, settings.vocabulary
    for row in counted.collect():
        room -= row["n"]
        if room < 0:
            least = row["times"]
            break
    most = words.where(F.col("times") > least).select("word", "times").toArrow()
    hashes = most["word"].to_numpy().view(np.uint64)
    times = most["times"].to_numpy()
    ranked = np.lexsort((hashes, -times))
    symbols = np.empty(len(hashes), np.uint32)
    symbols[ranked] = np.arange(2, len(hashes) + 2)
    order = np.argsort(hashes)
    counts = np.concatenate([[total - times.sum(), texts], times[ranked]]).astype(np.int64)
    return Vocabulary(hashes[order], symbols[order], counts, int(total))


PARTS = "shard int, keys binary, times binary, words binary, others binary"
TABLE = "shard int, keys binary, times binary, shares binary, n bigint"
LISTED = "slice bigint, doc_ids array<bigint>, sizes array<int>"
ENTRIES = f"shard int, part int, {LISTED}, rows binary, keys binary, times binary"


def _cut(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _count_slice(words: list[Words], kind: int) -> tuple[np.ndarray, ...]:
    """Distinct pairs of a kind: keys, times, the word they go by, and the other's symbol."""
    found = [_pairs(w, kind)[1:] for w in words]
    if kind == BEGINS:
        # a text's last word begins no pair, but counts
        for w in words:
            ends = w.hashed[w.last & (w.symbol == OTHER)]
            found.append((_hash_pairs(ends, np.full(len(ends), END)), ends, np.full(len(ends), OTHER)))
    keys, word, other = (np.concatenate(x) for x in zip(*found, strict=True))
    keys, at, times = np.unique(keys, return_index=True, return_counts=True)
    return keys, times, word[at], other[at]


def pair_counts(docs: DataFrame, common, counts, total: int, shards: Shards, settings: Settings) -> DataFrame:
    """shard, keys (ascending), times and their sum n, of every shard of the count table, one row each.

    shares: for pairs with an uncommon word, what the shard adds to ln S. `total` is the number of words.
    """
    backoff, n_words = settings.backoff, max(total - 1, 1)

    def work(batch: pa.RecordBatch) -> dict:
        words = [_words(p, common.value) for p in pieces(batch, "text", PIECE)]
        out = []
        for kind in (COMMON, ENDS, BEGINS):
            keys, times, word, other = _count_slice(words, kind)
            order, edges = _cut(shards.of(kind, word), shards.all)
            keys, times, word, other = keys[order], times[order], word[order], other[order]
            for s in np.flatnonzero(np.diff(edges)).tolist():
                part = slice(edges[s], edges[s + 1])
                more = (None, None) if kind == COMMON else (pack(word[part], 8), pack(other[part], 4))
                out.append((s, pack(keys[part], WIDTH[kind]), pack(times[part], 8), *more))
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int32(), *[pa.binary()] * 4)
        return {c: pa.array(x, t) for c, x, t in zip(("shard", "keys", "times", "words", "others"), columns, kinds, strict=True)}

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        kind, shares = shards.kind(shard), None
        keys, times = _numbers(rows["keys"], WIDTH[kind]), _numbers(rows["times"], 8)
        keys, at, which = np.unique(keys, return_index=True, return_inverse=True)
        sums = np.bincount(which, times).astype(np.int64)
        if kind != COMMON:
            word, other = _numbers(rows["words"], 8)[at], _numbers(rows["others"], 4)[at]
            which = np.unique(word, return_inverse=True)[1]
            own = np.maximum(np.bincount(which, sums)[which] - 1, 1)
            others = np.where(other == OTHER, 1, np.maximum(counts.value[other] - 1, 1))
            seen = sums > 1
            if kind == ENDS:
                share = np.where(seen, np.maximum(sums - 1, 1) / others, backoff * own / n_words)
            else:
                unseen = np.where(other == OTHER, 1.0, backoff * others / n_words)
                share = np.where(seen, np.where(other == OTHER, 1, np.maximum(sums - 1, 1)) / own, unseen)
            # a word backs off once, where both are uncommon in the shard of the second
            sums = np.where((kind == BEGINS) & (other == OTHER), np.maximum(sums, 2), sums)
            shares = pack(np.log(share).view(np.uint64), 8)
        packed = (pack(keys, WIDTH[kind]), pack(sums, 8), shares)
        return pd.DataFrame([(shard, *packed, int(times.sum()))], columns=["shard", "keys", "times", "shares", "n"])

    parts = map_arrow(docs.select("text"), PARTS, work)
    return parts.repartition(shards.all, "shard").groupBy("shard").applyInPandas(merge, TABLE)


def entries(docs: DataFrame, common, shards: Shards, parts: dict[int, int]) -> DataFrame:
    """Documents' n-grams with their numbers, a row for each slice and shard, and one in shard 0 that lists the documents.

    parts: into how many parts the shards are cut that are cut at all.
    """

    def work(batch: pa.RecordBatch, state: dict) -> dict:
        state["slice"] += 1
        words = _words(batch, common.value)
        sizes = np.bincount(words.text, minlength=batch.num_rows).astype(int).tolist()
        out = [(0, batch["doc_id"].to_pylist(), sizes, *[pack(np.zeros(0, np.uint64), 8)] * 3)]
        for kind in (COMMON, ENDS, BEGINS):
            some, keys, word, _ = _pairs(words, kind)
            text, shard = words.text[some], shards.of(kind, word)
            # (document, pair) with its number; pairs of one shard side by side
            order = np.lexsort((keys, text, shard))
            keys, text, shard = keys[order], text[order], shard[order]
            new = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (text[1:] != text[:-1]))[: len(keys)])
            times = np.diff(np.append(new, len(keys)))
            keys, text, shard = keys[new], text[new], shard[new]
            edges = np.searchsorted(shard, np.arange(shards.all + 1))
            for s in np.flatnonzero(np.diff(edges)).tolist():
                part = slice(edges[s], edges[s + 1])
                out.append((s, None, None, pack(text[part], 4), pack(keys[part], WIDTH[kind]), pack(times[part], 4)))
        shard, ids, sizes, *packed = zip(*out, strict=True)
        return {
            "shard": pa.array(shard, pa.int32()),
            "part": pa.array([state["slice"] % parts.get(s, 1) for s in shard], pa.int32()),
            "slice": pa.array(np.full(len(shard), state["slice"])),
            "doc_ids": pa.array(ids, pa.list_(pa.int64())),
            "sizes": pa.array(sizes, pa.list_(pa.int32())),
            **{k: pa.array(x, pa.binary()) for k, x in zip(("rows", "keys", "times"), packed, strict=True)},
        }

    def setup() -> dict:
        return {"slice": TaskContext.get().partitionId() << 32}

    return map_arrow(docs.select("doc_id", "text"), ENTRIES, work, setup=setup)


PARTIAL = f"{LISTED}, rows binary, backoff binary, score binary"
SUMS = "doc_id bigint, n_words bigint, n_backoff bigint, log_score double"


def add_up(parts: pd.DataFrame) -> pd.DataFrame:
    """The documents of one slice with the sums of what all shards found for them."""
    listed = parts[parts["doc_ids"].notna()].iloc[0]
    n = len(listed["doc_ids"])
    rows, backoff = _numbers(parts["rows"], 4).astype(np.int64), _numbers(parts["backoff"], 4)
    score = _numbers(parts["score"], 8).view(np.float64)
    return pd.DataFrame(
        {
            "doc_id": pd.array([None if x is None or x != x else int(x) for x in listed["doc_ids"]], dtype="Int64"),
            "n_words": np.asarray(listed["sizes"], np.int64),
            "n_backoff": np.bincount(rows, backoff, n).astype(np.int64),
            "log_score": np.bincount(rows, score, n),
        }
    )


def scores(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, n_backoff, log_score and mean_score of each row."""
    docs = doc_text(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    model = vocabulary(docs, settings)
    context = docs.sparkSession.sparkContext
    common, counts = context.broadcast((model.hashes, model.symbols)), context.broadcast(model.counts)
    n = max(1, math.ceil(model.words / settings.shard_words))
    shards = Shards(n, math.ceil(n / settings.rare_shards))
    table = cut_lineage(pair_counts(docs, common, counts, model.words, shards, settings))
    n_parts = F.ceil(F.col("n") / settings.share_entries).cast("int")
    cut = table.select("shard", n_parts.alias("parts")).where("parts > 1")
    parts = {row["shard"]: row["parts"] for row in cut.toLocalIterator()}
    table = table.withColumn("part", F.explode(F.sequence(F.lit(0), n_parts - 1)))
    n_words, backoff = max(model.words - 1, 1), settings.backoff

    def join(listed: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        out = []
        kind = shards.kind(int((listed if len(listed) else table)["shard"].iloc[0]))
        keys, totals, shares = np.zeros(0, np.uint64), np.zeros(0, np.int64), None
        if len(table):
            keys, totals = unpack(table["keys"].iloc[0], WIDTH[kind]), unpack(table["times"].iloc[0], 8).astype(np.int64)
            shares = unpack(table["shares"].iloc[0], 8).view(np.float64) if kind != COMMON else None
        single = counts.value
        for number, ids, sizes, rows, mine, times in zip(
            *(listed[c] for c in ("slice", "doc_ids", "sizes", "rows", "keys", "times")), strict=True
        ):
            rows, times = (unpack(x, 4).astype(np.int64) for x in (rows, times))
            mine = unpack(mine, WIDTH[kind])
            at = np.searchsorted(keys, mine)
            total = totals[at] if len(mine) else times
            seen = total > 1
            if kind != COMMON:
                share = shares[at]
            else:
                before, word = mine >> np.uint64(SYMBOL_BITS), mine & np.uint64((1 << SYMBOL_BITS) - 1)
                share = np.log(
                    np.where(
                        seen,
                        np.maximum(total - 1, 1) / np.maximum(single[before] - 1, 1),
                        backoff * np.maximum(single[word] - 1, 1) / n_words,
                    )
                )
            # packed: a row for a slice, not one for each of its documents
            some, which = np.unique(rows, return_inverse=True)
            backed = np.bincount(which, times * ~seen, len(some))
            score = np.bincount(which, times * share, len(some))
            packed = pack(some, 4), pack(backed.astype(np.int64), 4), pack(score.view(np.uint64), 8)
            out.append((number, ids, sizes, *packed))
        return pd.DataFrame(out, columns=["slice", "doc_ids", "sizes", "rows", "backoff", "score"])

    listed = entries(docs, common, shards, parts)
    keys = ["shard", "part"]
    joined = listed.groupBy(*keys).cogroup(table.groupBy(*keys)).applyInPandas(join, PARTIAL)
    return joined.groupBy("slice").applyInPandas(add_up, SUMS).select(
        "doc_id",
        "n_words",
        "n_backoff",
        F.round("log_score", 6).alias("log_score"),
        F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6)).alias("mean_score"),
    )


def oracle(settings: Settings = Settings()) -> str:
    """The same as DuckDB SQL."""
    return f"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws
    FROM documents
),
occurrences AS (
    SELECT r, i, ws[i] AS word FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM texts)
),
pairs AS (SELECT r, word, coalesce(lag(word) OVER (PARTITION BY r ORDER BY i), ' begin') AS before FROM occurrences),
c2 AS (SELECT before, word, count(*) AS n FROM pairs GROUP BY before, word),
c1 AS (
    SELECT word, count(*) AS n FROM occurrences GROUP BY word
    UNION ALL SELECT ' begin', count(*) FROM texts WHERE len(ws) > 0
),
size AS (SELECT greatest(count(*) - 1, 1) AS n FROM occurrences),
scored AS (
    SELECT pairs.r, CAST(c2.n = 1 AS BIGINT) AS backed,
           ln(CASE WHEN c2.n > 1 THEN (c2.n - 1) / CAST(greatest(b.n - 1, 1) AS DOUBLE)
                   ELSE {settings.backoff} * greatest(w.n - 1, 1) / CAST(size.n AS DOUBLE) END) AS s
    FROM pairs
    JOIN c2 ON c2.before = pairs.before AND c2.word = pairs.word
    JOIN c1 b ON b.word = pairs.before
    JOIN c1 w ON w.word = pairs.word
    CROSS JOIN size
),
sums AS (SELECT r, count(*) AS n, sum(backed) AS backed, sum(s) AS s FROM scored GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_words, CAST(coalesce(backed, 0) AS BIGINT) AS n_backoff,
       round(coalesce(s, 0), 6) AS log_score, round(s / n, 6) AS mean_score
FROM texts LEFT JOIN sums ON sums.r = texts.r
"""
