"""Publisher fingerprints: what gives a newsroom or a blog away."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressgauge.functions.chars import NOT_SPACE, SPACE, WORD, let

# Fixed values: (rule, pattern, ignore case), in the order they are applied.
RULES = [
    (
        "agency dateline",
        r"\b[A-Z][A-Za-z.'\-]*(?:[ /][A-Z][A-Za-z.'\-]*){0,4}\s*"
        r"\(\s*(?:Reuters|AP|AFP|UPI|Reuters Breakingviews)\s*\)\s*[-–—:]*\s*",
        False,
    ),
    ("agency name", r"\b(?:reuters|associated\s+press|agence\s+france[-\s]?presse)\b", True),
    (
        "wire sign-off",
        r"\b(?:additional\s+)?(?:reporting|writing|editing)\s+by\s+[^.;\n]{0,90}[.;]?",
        True,
    ),
    (
        "image credit",
        r"\b(?:featured\s+image|photo|image|screen\s?grab|screenshot)s?\s*(?:credit\s*)?"
        r"(?:via|by|from|courtesy\s+of|:)\s*[^.\n]{0,80}",
        True,
    ),
    (
        "photo agency",
        r"\b(?:getty\s+images|getty|shutterstock|istock|ap\s+photo|afp\s*/?\s*getty|pool\s+photo)\b",
        True,
    ),
    ("web address", r"https?://\S+|\bwww\.\S+", True),
    ("social embed", r"\bpic\.twitter\.com/\S+|\bt\.co/\S+", True),
    (
        "site furniture",
        r"\b(?:follow\s+us\s+on|like\s+us\s+on|sign\s+up\s+for\s+our|subscribe\s+to\s+our|read\s+more)\b"
        r"[^.\n]{0,60}",
        True,
    ),
    (
        "media tag",
        r"[\[\(]\s*(?:video|watch|photos?|images?|breaking)\s*[\]\)]|\b(?:watch|video|photos)\s*:\s*",
        True,
    ),
]


def rule_names() -> list[str]:
    return [name for name, _, _ in RULES]


# What a match of a rule can begin with, as regular-expression class contents: asked first, it settles nearly every
# position of a text.
FIRST = {
    "agency dateline": "A-Z",
    "agency name": "ra",
    "wire sign-off": "arwe",
    "image credit": "fpis",
    "photo agency": "gsiap",
    "web address": "hw",
    "social embed": "pt",
    "site furniture": "flsr",
    "media tag": r"\[(wvp",
}


def _java(rule: str, pattern: str, ignore_case: bool) -> str:
    """Give \\b, \\s and \\S their Unicode meaning. A \\b stands before a letter, or behind one and its group."""
    pattern = re.sub(r"(?<=\))\\b", lambda _: f"(?!{WORD})", pattern)
    spelled = {r"\b": f"(?<!{WORD})", r"\s": SPACE, r"\S": NOT_SPACE}
    pattern = re.sub(r"\\[bsS]", lambda short: spelled[short.group()], pattern)
    return ("(?iu)" if ignore_case else "") + f"(?=[{FIRST[rule]}])(?:{pattern})"


JAVA_PATTERNS = [_java(*rule) for rule in RULES]
# White space other than one blank, which stays as it is. Plain characters fail the first test of either part.
UNTIDY = f" (?![!-~]){SPACE}+|(?=[^ -~]){SPACE}+"

# A text without any of a rule's words cannot match it, and finding a word is far
# cheaper than trying a pattern at every position.
NEEDED_WORDS = {
    "agency dateline": ["("],
    "agency name": ["reuters", "associated", "agence"],
    "wire sign-off": ["reporting", "writing", "editing"],
    "image credit": ["image", "photo", "screen"],
    "photo agency": ["getty", "shutterstock", "istock", "photo"],
    "web address": ["http", "www."],
    "social embed": ["twitter.com", "t.co/"],
    "site furniture": ["follow", "like", "sign", "subscribe", "read"],
    "media tag": ["video", "watch", "photo", "image", "breaking"],
}


def _plain(text: Column) -> Column:
    """Lower case, plus the letters that only case-insensitive matching equates.

    These come first: the lower case of İ is two characters, which no word would meet.
    """
    strange = F.contains(text, F.lit("ſ")) | F.contains(text, F.lit("ı")) | F.contains(text, F.lit("İ"))
    return F.when(strange, F.lower(F.translate(text, "ſıİ", "sii"))).otherwise(F.lower(text))


def _may_match(plain: Column, rule: str) -> Column:
    found = F.lit(False)
    for word in NEEDED_WORDS[rule]:
        found = found | F.contains(plain, F.lit(word))
    return found


def clean_article_text(text: Column) -> Column:
    """Blank out every fingerprint in rule order, then tidy white space.

    Blanking never joins two pieces of text, so a word missing from the original
    is still missing when a later rule's turn comes.
    """

    def blanked(plain: Column) -> Column:
        cleaned = original
        for rule, pattern in zip(rule_names(), JAVA_PATTERNS):
            cleaned = let(cleaned, blanking(pattern, _may_match(plain, rule)))
        return cleaned

    def blanking(pattern: str, wanted: Column):
        return lambda t: F.when(wanted, F.regexp_replace(t, pattern, " ")).otherwise(t)

    original = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(let(_plain(original), blanked), UNTIDY, " "))


def fingerprint_hits(text: Column) -> list[Column]:
    """One match count per rule, each on the raw text, named after the rule."""
    text = F.coalesce(text, F.lit(""))
    plain = _plain(text)
    return [
        F.when(_may_match(plain, name), F.regexp_count(text, F.lit(pattern))).otherwise(0).alias(name)
        for name, pattern in zip(rule_names(), JAVA_PATTERNS)
    ]


def count_fingerprints(text: Column) -> Column:
    """map(rule -> matches), rules that never fired left out."""
    counts = F.map_from_arrays(
        F.array(*[F.lit(name) for name in rule_names()]), F.array(*fingerprint_hits(text))
    )
    return F.map_filter(counts, lambda _, n: n > 0)
