"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score by where they stand (kind of block, whether in a link,
whether inside an element that is by its name or class a menu, notice, advert, form, comment and the like,
whether apart from an <article> or <main> that the page has),
tags cost. The weights are log odds of being inside or outside the content, learned from pages that say
themselves where that is (a single <article> or <main>), a bounded sample of them; a prior stands for what
the sample has not shown. One linear scan finds the contiguous region of the largest sum; its text, without
what stands in such elements, is the page's.

Character references are decoded, runs of white space inside a block become one space, blocks are trimmed
and joined in order by one line feed, empty ones left out. Names are an element's id, then its classes. The first whose words
all mark noise ("comments", "post-comments", "sidebarContent": words of content beside them don't count), or all speak
for content, decides. Failing that, outside the content one word of noise in a name is enough if no name speaks for
content. Ids of blocks that are text themselves never count. Everything else of the region is kept, whole. A
line break element is white space. A null, empty or textless page, or one in which nothing scores above
zero, has the text "". Unclosed elements, stray end tags and pages that break off are read as far as they
go. Repeated rows are answered alike.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressgauge.llm.common import hash_sample, map_arrow, strings


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 2_000  # labelled pages, those of the smallest hash
    prior: float = 20.0  # words that the prior is worth


# Fixed values of HTML: elements whose text is not page text, those without an end, and those that break lines.
RAW = frozenset("script style noscript template iframe textarea title svg object audio video canvas select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 "
    "h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul caption".split()
)
# elements that are never content, whatever they hold
NOISE_TAGS = frozenset("nav footer aside form menu dialog button search head".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog toolbar".split())
# words of a class or id that mark an element as not content, and words that speak for content
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "menubar breadcrumb breadcrumbs sidebar rail footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations "
    "trending comment comments commentlist disqus reply replies respond login search pagination pager widget widgets".split()
)
# words that say nothing beside those
PLAIN_WORDS = frozenset("section box block list area bar button buttons icon icons link links item items form inner outer panel".split())
# blocks that are text themselves: their ids are made from it, or numbered
TEXT_BLOCKS = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
# words of names that tell what an element has, not what it is
STATE_WORDS = frozenset("has no with without is".split())
CONTENT_WORDS = frozenset("article content main post entry story body text page wrapper container".split())

_QUOTED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s\"'=<>/]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^a-z]+")
_CASE = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _noise(tag: str, attributes: str, in_content: bool) -> bool:
    if tag in NOISE_TAGS or (tag == "header" and not in_content):
        return True
    if not attributes or tag in ("body", "html", "article", "main"):
        return False
    ids: list[str] = []
    classes: list[str] = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        if name.lower() == "hidden" or (name.lower() == "role" and value.strip().lower() in NOISE_ROLES):
            return True
        # an id is one name, a class has several
        if name.lower() == "class":
            classes += value.split()
        elif name.lower() == "id" and tag not in TEXT_BLOCKS:
            ids.append(value)
    names = [{w for w in _SPLIT.split(_CASE.sub("-", x).lower()) if w} for x in ids + classes]
    for words in names:
        rest = words - PLAIN_WORDS - CONTENT_WORDS
        if rest:
            if rest <= NOISE_WORDS:
                return True
        elif words & CONTENT_WORDS:
            return False
    if in_content or (tag in TEXT_BLOCKS and tag != "li"):
        return False
    names = [words for words in names if not words & STATE_WORDS]
    return not any(words & CONTENT_WORDS for words in names) and any(words & NOISE_WORDS for words in names)


Token = tuple[str, str | None, int]  # feature, text (None: a tag), block


def tokens(page: str) -> tuple[list[Token], list[tuple[int, int]]]:
    """The page in order, and the ranges of tokens inside <article> or <main> elements.

    Only elements that break lines are followed on the stack; an end tag closes the nearest of its name.
    """
    found: list[Token] = []
    stack: list[tuple[str, bool, int]] = []  # tag, whether noise, token where it began
    content: list[tuple[int, int]] = []
    block, links, noisy, inside, at, n = 0, 0, 0, 0, 0, len(page)
    kind, pattern = "other", _QUOTED

    def close(k: int) -> None:
        nonlocal noisy, inside
        while len(stack) > k:
            tag, bad, begun = stack.pop()
            noisy -= bad
            if tag in ("article", "main"):
                inside -= 1
                if not inside:
                    content.append((begun, len(found)))

    while at < n:
        less = page.find("<", at)
        if less < 0:
            less = n
        if less > at:
            feature = "noise" if noisy else ("link" if links else kind)
            found.append((feature, html.unescape(page[at:less]), block))
            at = less
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        match = pattern.match(page, at)
        if match is None and pattern is _QUOTED and page[at + 1 : at + 2].isalpha():
            # a quote that never ends: from here on a tag ends at the next >
            pattern = _PLAIN
            match = pattern.match(page, at)
        if match is None:
            if page[at + 1 : at + 2] == "/" or page[at + 1 : at + 2].isalpha():
                end = page.find(">", at)
                at = n if end < 0 else end + 1  # a tag that the page breaks off in, or not a tag's name
                continue
            found.append(("noise" if noisy else ("link" if links else kind), "<", block))
            at += 1
            continue
        ends, tag, attributes = bool(match[1]), match[2].lower(), match[3]
        at = match.end()
        if tag in RAW and not ends:
            if not attributes.endswith("/"):
                end = _end_of(page, tag, at)
                at = n if end is None else end
            found.append(("tag:other", None, block))
            continue
        if tag == "br":
            found.append((found[-1][0] if found and found[-1][1] is not None else kind, " ", block))
            continue
        found.append((f"tag:{tag if tag in BLOCKS or tag == 'a' else 'other'}", None, block))
        if tag == "a":
            links = 0 if ends else 1
        if tag not in BLOCKS:
            continue
        block += 1
        links = 0
        if tag in VOID:
            continue
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
        else:
            if tag in ("p", "li", "td", "th", "tr", "dd", "dt", "option") and stack and stack[-1][0] == tag:
                close(len(stack) - 1)
            bad = _noise(tag, attributes, inside > 0)
            stack.append((tag, bad, len(found)))
            noisy += bad
            inside += tag in ("article", "main")
        kind = next((t for t, _, _ in reversed(stack) if t in BLOCKS), "other")
    close(0)
    if content:
        # where a page says what its content is, other words stand apart from it
        edges = iter([*content, (n + 1, n + 1)])
        low, high = next(edges)
        for k, (feature, text, number) in enumerate(found):
            while k >= high:
                low, high = next(edges)
            if k < low and text is not None and feature != "noise":
                found[k] = ("apart", text, number)
    return found, content


def _end_of(page: str, tag: str, at: int) -> int | None:
    """Where the element's end tag ends."""
    match = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
    return match.end() if match else None


# Words that the prior sees inside and outside the content, of 100; what is not listed is likelier inside.
PRIOR = {"noise": (0.02, 99.98), "apart": (2, 98), "link": (25, 75), "tag:a": (20, 80), "tag:li": (30, 70), "tag:p": (45, 55)}
WORD, TAG = (90, 10), (40, 60)


class Weights(dict):
    """Log odds by feature; a feature that the sample lacks has its prior's."""

    def __init__(self, counts: dict[str, tuple[float, float]], prior: float):
        super().__init__()
        for feature in {*counts, *PRIOR}:
            self[feature] = self._weigh(feature, counts.get(feature, (0, 0)), prior)

    @staticmethod
    def _weigh(feature: str, counts: tuple[float, float], prior: float) -> float:
        is_tag = feature.startswith("tag:")
        a, b = PRIOR.get(feature, TAG if is_tag else WORD)
        odds = math.log((counts[0] + prior * a / 100) / (counts[1] + prior * b / 100))
        if feature == "noise":
            return -1.0  # by definition not content, but an advert does not part an article
        return min(max(odds, -0.5), -0.05) if is_tag else max(odds, -3.0)

    def __missing__(self, feature: str) -> float:
        return self._weigh(feature, (0, 0), 1.0)


def region(page_tokens: list[Token], weights: dict[str, float]) -> tuple[int, int]:
    """First and end token of the contiguous part of the largest sum; the first of equals, (0, 0) if none is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for k, (feature, text, _) in enumerate(page_tokens):
        if text is None:
            total += weights[feature]
        else:
            words = len(text.split())
            if not words:
                continue
            # an advert's length must not part an article: such text costs once
            total += weights[feature] * (words if feature != "noise" else 1)
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, found = total, (start, k + 1)
    return found


def text_of(page_tokens: list[Token]) -> str:
    blocks: list[tuple[int, list[str]]] = []
    for feature, text, block in page_tokens:
        if text is None or feature == "noise":
            continue
        if not blocks or blocks[-1][0] != block:
            blocks.append((block, []))
        blocks[-1][1].append(text)
    lines = (" ".join("".join(parts).split()) for _, parts in blocks)
    return "\n".join(line for line in lines if line)


def count_features(page: str) -> dict[str, tuple[int, int]] | None:
    """Words and tags by feature, inside and outside the content; None if the page does not say where that is."""
    found, content = tokens(page)
    if len(content) != 1:
        return None
    counts: dict[str, list[int]] = {}
    for k, (feature, text, _) in enumerate(found):
        number = 1 if text is None else len(text.split())
        counts.setdefault(feature, [0, 0])[not content[0][0] <= k < content[0][1]] += number
    return {f: (a, b) for f, (a, b) in counts.items()}


def learn_weights(pages: DataFrame, settings: Settings = Settings()) -> Weights:
    """From at most sample_rows pages; features are few, whatever the pages."""
    ids = hash_sample(pages.select("page_id").where("page_id is not null"), "page_id", settings.sample_rows)
    sample = pages.select("page_id", F.col("html").alias("text")).where("text is not null").join(F.broadcast(ids), "page_id", "left_semi")

    def work(batch: pa.RecordBatch) -> dict:
        sums: dict[str, list[int]] = {}
        for page in strings(batch["text"]):
            for feature, (a, b) in (count_features(page) or {}).items():
                entry = sums.setdefault(feature, [0, 0])
                entry[0] += a
                entry[1] += b
        return {
            "feature": pa.array(sums, pa.string()),
            "within": pa.array([a for a, _ in sums.values()], pa.int64()),
            "without": pa.array([b for _, b in sums.values()], pa.int64()),
        }

    rows = map_arrow(sample.select("text"), "feature string, within bigint, without bigint", work)
    sums = rows.groupBy("feature").agg(F.sum("within").alias("a"), F.sum("without").alias("b")).collect()
    return Weights({r.feature: (r.a, r.b) for r in sums}, settings.prior)


def extract_text(page: str, weights: dict[str, float]) -> str:
    found, _ = tokens(page)
    start, end = region(found, weights)
    return text_of(found[start:end])


def extract(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """page_id, url, text and n_chars of each row; nothing is shuffled but the sample's counts."""
    weights = learn_weights(pages, settings)
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("text"))

    def work(batch: pa.RecordBatch) -> dict:
        texts = [extract_text(page, weights) for page in strings(batch["text"])]
        return {
            "page_id": batch["page_id"],
            "url": batch["url"],
            "text": pa.array(texts, pa.string()),
            "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        }

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("page_id", "url")]
    return map_arrow(rows, ", ".join(kinds) + ", text string, n_chars bigint", work)
