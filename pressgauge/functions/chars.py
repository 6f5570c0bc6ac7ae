"""Character classes shared by the text functions.

Java's regular expressions are ASCII-minded by default, so the Unicode meaning
of "word character", "white space" and "word boundary" is spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Members of the Unicode white-space set, as regular-expression class contents.
SPACE_MEMBERS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{SPACE_MEMBERS}]"
NOT_SPACE = f"[^{SPACE_MEMBERS}]"

WORD = r"[\p{L}\p{N}_]"
BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

# The same white-space set as plain characters, for trim().
SPACE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only U+0020."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def let(value: Column, use) -> Column:
    """Evaluate `value` once and hand it to `use`, which may mention it repeatedly."""
    return F.transform(F.array(value), use)[0]


def count_chars(text: Column, members: str) -> Column:
    """How many characters of `text` are in a class; far cheaper than one match each."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[{members}]+", ""))


def code_point_class(chars) -> str:
    """Contents of a Java character class for a set of non-ASCII characters.

    Runs are written as ranges, and ASCII is ruled out first so that plain text
    does not walk the whole list.
    """
    points = sorted(ord(c) for c in chars)
    out, start, last = [], None, None
    for point in points + [None]:
        if start is not None and point == last + 1:
            last = point
            continue
        if start is not None:
            out.append(f"\\x{{{start:x}}}" if start == last else f"\\x{{{start:x}}}-\\x{{{last:x}}}")
        start = last = point
    return rf"[^\x00-\x7F]&&[{''.join(out)}]"
