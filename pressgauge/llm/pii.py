"""Personal data: candidates of high recall, boosted trees, calibrated thresholds.

Base spans (email, ip, card, phone) follow fixed rules: the leftmost non-overlapping matches of a pattern,
dropped where they fail a check. They are always found. Beside them, generators propose many spans that may
overlap one another: digit groups inside a longer run, numbers with other separators, spelled-out addresses.
For every kind, boosted trees look at a candidate's format and context and give a probability. They are
trained on the candidates of all documents: those that are base spans are right, others are wrong (those
that a rule would accept on their own, without what touches them, teach nothing), and the right ones are shown again without the features that the base rule insists on, so that the rest of the
evidence gets weight. Candidates travel as bins of their features with a count, never as text, and the trees grow by
sums over them (`boosting.fit_table`). A kind's threshold is the lowest at which candidates held out from training are
precise. Accepted candidates that touch no base span are added, the most probable first, without overlaps.

Null text is the empty text and has no spans. Places are code points, ends exclusive. Repeated rows are
answered alike. Texts are scanned whole, in time linear in their length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.llm import boosting
from pressgauge.llm.common import cut_lineage, doc_text, map_arrow, strings

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


@dataclass(frozen=True)
class Settings:
    precision: float = 0.95  # of what a threshold lets through, with candidates that no base rule knows taken for wrong
    least: int = 20  # right and wrong candidates of a kind below which it gets no trees


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never begins inside a run of digits unless a match has ended there
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            end = match.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[Span]:
    """Spans in order of start, then of kind."""
    found: list[Span] = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        # numbers of more than three digits may still be small: 0001
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


_GENERATORS = (
    (0, re.compile(r"(?<![\w.+-])[\w.+-]{1,64} ?(?:@|\(at\)|\[at\]| at ) ?[\w-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[\w-]{1,63}){1,4}", re.I)),
    (1, re.compile(r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])")),
    (2, re.compile(r"(?<![0-9])[0-9]{12,19}(?![0-9])")),
    (2, re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./-]?[0-9]{4}){2}[ ./-]?[0-9]{2,7}(?![0-9])")),
    (3, re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])")),
    (3, re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    (3, re.compile(r"(?<![0-9])00[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])")),
)
_SOME = re.compile(r"[0-9]{3}|@|\((?:at|dot)\)|\[(?:at|dot)\]| at ", re.I)


def candidates(text: str) -> list[Span]:
    """Proposed spans, which may overlap; base spans are among them."""
    if not _SOME.search(text):
        return base_spans(text)
    found = set(base_spans(text))
    digits = any(c in text for c in "0123456789")
    for kind, pattern in _GENERATORS:
        if kind == 0 or digits:
            found.update((m.start(), kind, m.end()) for m in pattern.finditer(text))
    return sorted(found)


FEATURES = (
    "length", "digits", "letters", "separators", "groups", "longest_group", "shortest_group", "luhn", "plus", "parentheses",
    "at_sign", "dots", "octets", "letter_before", "letter_after", "joined_before", "joined_after", "digit_near_before",
    "digit_near_after", "upper", "last_part", "line_start",
)
# what the base rule of a kind insists on, hidden when right candidates are shown again
_HIDDEN = {0: ("at_sign",), 1: (), 2: ("separators",), 3: ("plus",)}


def features(text: str, span: Span) -> list[float]:
    start, _, end = span
    part = text[start:end]
    groups = [g for g in _NOT_DIGIT.split(part) if g]
    sizes = [len(g) for g in groups] or [0]
    digits = "".join(groups)
    before, after = text[max(0, start - 3) : start], text[end : end + 3]
    return [
        len(part),
        len(digits),
        sum(map(str.isalpha, part)),
        len(part) - len(digits),
        len(groups),
        max(sizes),
        min(sizes),
        bool(digits) and luhn(digits),
        part[:1] == "+",
        "(" in part,
        "@" in part,
        part.count("."),
        len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups),
        before[-1:].isalpha(),
        after[:1].isalpha(),
        before[-1:] in tuple("/-_.=#:\"'+"),
        after[:1] in tuple("/-_=\"'+"),
        any(map(str.isdigit, before)),
        any(map(str.isdigit, after)),
        sum(map(str.isupper, part)),
        len(part.rsplit(".", 1)[-1]),
        start == 0 or text[start - 1] == "\n",
    ]


def _alone(part: str, kind: int) -> bool:
    """Whether a base rule would accept the part if nothing stood around it."""
    return (0, kind, len(part)) in base_spans(part)


Model = dict[int, tuple[boosting.Boosted, float]]


PROBABILITIES = 1 << 16  # steps in which probabilities are counted for a threshold


def train(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Trees and a threshold for each kind with enough candidates, from all documents."""

    def work(batch: pa.RecordBatch) -> dict:
        kinds, parts, rows, right = [], [], [], []
        for text in strings(batch["text"]):
            known = set(base_spans(text))
            for span in candidates(text):
                part = text[span[0] : span[2]]
                if span not in known and _alone(part, span[1]):
                    continue
                kinds.append(span[1])
                parts.append(zlib.crc32(part.encode()) % 3 == 0)
                rows.append(features(text, span))
                right.append(span in known)
        binned = boosting.bins(np.array(rows, float).reshape(-1, len(FEATURES)))
        counted = Counter(zip(kinds, (x.tobytes() for x in binned), right, parts, strict=True))
        columns = list(zip(*counted, strict=True)) or [[]] * 4
        types = (pa.int32(), pa.binary(), pa.bool_(), pa.bool_())
        out = {name: pa.array(c, t) for name, c, t in zip(("kind", "x", "right", "held"), columns, types, strict=True)}
        return out | {"n": pa.array(list(counted.values()), pa.int64())}

    found = map_arrow(doc_text(docs), "kind int, x binary, right boolean, held boolean, n bigint", work)
    # like candidates are one row; they are kept, or every pass would read the documents again
    found = cut_lineage(found.groupBy("kind", "x", "right", "held").agg(F.sum("n").alias("n")))
    sizes = {(r["kind"], r["right"]): r["n"] for r in found.groupBy("kind", "right").agg(F.sum("n").alias("n")).collect()}
    taught = [k for k in range(len(KINDS)) if min(sizes.get((k, True), 0), sizes.get((k, False), 0)) >= settings.least]
    if not taught:
        return {}
    shown = found.where(F.col("kind").isin(taught) & ~F.col("held")).select("kind", "x", "right", "n")
    again = shown.where("right").where(F.col("kind").isin([k for k in taught if _HIDDEN[k]]))
    without = F.col("x")
    for kind in taught:
        for name in _HIDDEN[kind]:
            at = FEATURES.index(name)
            zeroed = F.concat(F.substring("x", 1, at), F.lit(b"\0"), F.substring("x", at + 2, len(FEATURES)))
            without = F.when(F.col("kind") == kind, zeroed).otherwise(without)
    shown = cut_lineage(shown.unionByName(again.withColumn("x", without)))
    fitted = boosting.fit_table(shown, taught, len(FEATURES))

    def judge(batches):
        for batch in batches:
            of, p = batch["kind"].to_numpy(), np.zeros(batch.num_rows)
            values = boosting.values(batch["x"], len(FEATURES))
            for kind in taught:
                p[of == kind] = fitted[kind].probability(values[of == kind])
            step = pa.array(np.floor(p * PROBABILITIES).astype(np.int64))
            yield pa.RecordBatch.from_pydict({"kind": batch["kind"], "step": step, "right": batch["right"], "n": batch["n"]})

    held = found.where(F.col("kind").isin(taught) & F.col("held")).select("kind", "x", "right", "n")
    judged = held.mapInArrow(judge, "kind int, step bigint, right boolean, n bigint").groupBy("kind", "step")
    # at most PROBABILITIES rows a kind
    steps = judged.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("right"), F.col("n")).otherwise(0)).alias("right")).toPandas()
    model: Model = {}
    for kind in taught:
        own = steps[steps["kind"] == kind]
        step, right, n = (own[c].to_numpy() for c in ("step", "right", "n"))
        cut = boosting.threshold(step / PROBABILITIES, right, settings.precision, n)
        # up to the next whole step, or the cut would run through the candidates of one
        model[kind] = fitted[kind], max(0.5, float(np.ceil(cut * PROBABILITIES)) / PROBABILITIES)
    return model


def find_spans(texts: list[str], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """Base spans, and all spans, of each text in order."""
    base, asked = [], {kind: ([], []) for kind in model}
    for n, text in enumerate(texts):
        known = base_spans(text)
        base.append(known)
        if not model or not _SOME.search(text):
            continue
        for span in candidates(text):
            if span[1] in model and not any(a < span[2] and span[0] < b for a, _, b in known):
                asked[span[1]][0].append((n, span))
                asked[span[1]][1].append(features(text, span))
    accepted: dict[int, list[tuple[float, Span]]] = {}
    for kind, (where, rows) in asked.items():
        if rows:
            fitted, least = model[kind]
            for (n, span), p in zip(where, fitted.probability(np.array(rows, float)), strict=True):
                if p >= least:
                    accepted.setdefault(n, []).append((-p, span))
    out = []
    for n, known in enumerate(base):
        more: list[Span] = []
        for _, span in sorted(accepted.get(n, [])):
            if not any(a < span[2] and span[0] < b for a, _, b in more):
                more.append(span)
        out.append((known, sorted(known + more)))
    return out


def write(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with a mark in place of each span; spans that overlap get the first one's mark."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, settings: Settings = Settings(), *more: str) -> DataFrame:
    """doc_id, `more`, base (spans as text), spans (all, as text), n_email, n_ip, n_card, n_phone (base spans)
    and redacted. One row for each row; nothing but sums over candidates is gathered."""
    model = train(docs, settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = doc_text(docs, *more)
    keys = ["doc_id", *more]
    counts = [f"n_{k}" for k in KINDS]
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    schema += ", base string, spans string, redacted string" + "".join(f", {c} bigint" for c in counts)

    def work(batch: pa.RecordBatch) -> dict:
        texts = strings(batch["text"])
        found = find_spans(texts, shared.value)
        return {k: batch[k] for k in keys} | {
            "base": pa.array([write(b) for b, _ in found], pa.string()),
            "spans": pa.array([write(s) for _, s in found], pa.string()),
            "redacted": pa.array([redact(t, s) for t, (_, s) in zip(texts, found, strict=True)], pa.string()),
            **{c: pa.array([sum(s[1] == k for s in b) for b, _ in found], pa.int64()) for k, c in enumerate(counts)},
        }

    return map_arrow(rows, schema, work)
