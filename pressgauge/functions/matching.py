"""Exact-match keys for headlines and article openings.

Folding accents, lookalikes and compatibility forms is a per-character mapping,
so it is generated once from the Unicode database and handed to Spark as
`translate` arguments. No row ever visits Python.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressgauge.functions.chars import code_point_class, strip

BODY_KEY_WORDS = 20
EXTRACT_CHARS = 600
DISPLAY_CHARS = 500

# Typographic characters and the keyboard characters they stand for.
LOOKALIKES = {
    "‘": "'", "’": "'", "‚": "'", "‛": "'", "′": "'", "ʼ": "'",
    "“": '"', "”": '"', "„": '"', "″": '"',
    "–": "-", "—": "-", "―": "-", "−": "-",
    "…": "...",
}


class FoldTable(NamedTuple):
    spaced: str  # class of (common) characters followed by a space once folded
    source: str  # translate(): these characters ...
    target: str  # ... become these; the surplus of `source` is deleted
    wide: dict  # characters that fold to several


def _folded(char: str, headline_rule: bool) -> str:
    """What one character contributes to a key; ' ' for anything not a-z0-9."""
    if headline_rule:
        decomposed = unicodedata.normalize("NFKD", LOOKALIKES.get(char, char))
        decomposed = "".join(c for c in decomposed if not unicodedata.combining(c))
    else:
        decomposed = unicodedata.normalize("NFKD", char)
    return re.sub("[^a-z0-9]+", " ", decomposed.lower().replace("'", ""))


@lru_cache(maxsize=2)
def fold_table(headline_rule: bool) -> FoldTable:
    spaced, singles, deleted, wide = [], {}, ["'"], {}
    # Nothing above U+1FFFF folds to a letter, a digit or nothing at all.
    for point in range(0x80, 0x20000):
        if 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        plain = _folded(char, headline_rule)
        if plain == "":
            deleted.append(char)
        elif plain == " ":
            continue  # the key's own regular expression makes it a space
        elif len(plain) == 1:
            singles[char] = plain
        elif len(plain) == 2 and plain[1] == " " and not headline_rule:
            spaced.append(char)
            singles[char] = plain[0]
        else:
            wide[char] = plain
    for point in range(ord("A"), ord("Z") + 1):
        singles[chr(point)] = chr(point).lower()
    return FoldTable(
        code_point_class(spaced) if spaced else "",
        "".join(singles) + "".join(deleted),
        "".join(singles.values()),
        wide,
    )


def _key_text(text: Column, headline_rule: bool) -> Column:
    table = fold_table(headline_rule)
    text = F.coalesce(text, F.lit(""))

    # Characters that fold to several go first, piece by piece. They are rare, and
    # a translate() that drops them tells cheaply whether there are any.
    present = F.length(F.translate(text, "".join(table.wide), "")) < F.length(text)
    members = code_point_class(table.wide)
    # One string, made a map when the query is planned: hundreds of literals would
    # cost more to plan than to run.
    entries = "\x01".join(f"{char}\x02{plain}" for char, plain in table.wide.items())
    widths = F.str_to_map(F.lit(entries), F.lit("\x01"), F.lit("\x02"))
    pieces = F.regexp_extract_all(text, F.lit(f"[{members}]|[^{members}]+"), F.lit(0))
    widened = F.array_join(
        F.transform(pieces, lambda p: F.coalesce(F.try_element_at(widths, p), p)), ""
    )
    folded = F.when(present, widened).otherwise(text)
    if table.spaced:
        folded = F.regexp_replace(folded, f"([{table.spaced}])", "$1 ")
    folded = F.translate(folded, table.source, table.target)
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def normalize_headline(text: Column) -> Column:
    """Lower-case ASCII words joined by single spaces; '' for null or blank."""
    return _key_text(text, headline_rule=True)


def simple_key(text: Column) -> Column:
    """The plainer key: no lookalike folding, accents split words."""
    return _key_text(text, headline_rule=False)


def opening_of(normalized: Column, words: int = BODY_KEY_WORDS) -> Column:
    """First `words` (two or more) words of normalised text; '' when there are fewer."""
    enough = F.substring_index(normalized, " ", words - 1) != normalized
    return F.when(enough, F.substring_index(normalized, " ", words)).otherwise("")


def body_key(text: Column, words: int = BODY_KEY_WORDS) -> Column:
    return opening_of(normalize_headline(text), words)


def has_key(key: Column) -> Column:
    """Blank keys never match and never count as repeats."""
    return F.coalesce(key, F.lit("")) != ""


def keep_keyed(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not blank.

    A generator rather than a filter: the optimizer would push a filter below the
    projections that compute the key, and work the key out a second time there.
    """
    return df.withColumn(key, F.explode(F.filter(F.array(key), has_key)))


def build_extract(text: Column, chars: int = EXTRACT_CHARS) -> Column:
    text = strip(F.coalesce(text, F.lit("")))
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))).otherwise(text)


def split_paste(text: Column) -> Column:
    """One pasted string -> struct(headline, body), cut at the first newline."""
    text = strip(F.coalesce(text, F.lit("")))
    at = F.instr(text, "\n")
    head = F.when(at > 0, F.substring_index(text, "\n", 1)).otherwise(text)
    rest = F.when(at > 0, F.substr(text, at + 1)).otherwise("")
    return F.struct(strip(head).alias("headline"), strip(rest).alias("body"))


def full_text(headline: Column, body: Column) -> Column:
    return strip(F.concat(F.coalesce(headline, F.lit("")), F.lit(" "), F.coalesce(body, F.lit(""))))


def display_headline(headline: Column, body: Column) -> Column:
    """struct(headline, body) as shown in the history: a long single-line paste
    keeps its text as the body, and the headline is cut to fit."""
    long = F.length(headline) > DISPLAY_CHARS
    shown = F.when(long, F.concat(F.substring(headline, 1, DISPLAY_CHARS - 3), F.lit("..."))).otherwise(headline)
    kept = F.when((body == "") & long, headline).otherwise(body)
    return F.struct(shown.alias("headline"), kept.alias("body"))
