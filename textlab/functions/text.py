"""Column expressions for text: strip, tokenise, reply splitting.

All are built-in Spark SQL functions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's ``str.strip()`` removes (``isspace``),
# in code-point order: U+0009-U+000D, U+001C-U+001F, U+0020, U+0085, U+00A0,
# U+1680, U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Token = a run of letters/digits, or one character that is neither a
# letter/digit nor ASCII whitespace. Valid in Java regex and in RE2 alike.
WORD_PATTERN = r"[\p{L}\p{N}]+|[^ \t\n\x0B\f\r\p{L}\p{N}]"
# Java-only variant: every Han character is its own token (no dictionary).
CJK_WORD_PATTERN = r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+|[^ \t\n\x0B\f\r\p{L}\p{N}]"
# Letters only (used by the derived parse table).
LETTERS_PATTERN = r"\p{L}+"


def strip_text(c: Column | str) -> Column:
    """Python ``str(x).strip()`` with None -> '' (Unicode whitespace both ends)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.trim(F.coalesce(col.cast("string"), F.lit("")), F.lit(PY_WHITESPACE))


def strip_keep_null(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.trim(col, F.lit(PY_WHITESPACE))


def token_array(c: Column | str, cjk: bool = False) -> Column:
    """Ordered token list of a stripped text (punctuation kept, no lower-casing)."""
    pattern = CJK_WORD_PATTERN if cjk else WORD_PATTERN
    return F.regexp_extract_all(strip_text(c), F.lit(pattern), 0)


def strip_reasoning(c: Column | str, flag: str = "</think>") -> Column:
    """Second piece after splitting on ``flag`` if there is one, else the whole text."""
    col = F.col(c) if isinstance(c, str) else c
    parts = F.split(col, "\\Q" + flag + "\\E", -1)   # literal, not a regex
    return F.when(F.size(parts) > 1, F.element_at(parts, 2)).otherwise(col)
