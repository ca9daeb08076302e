"""String → string / string → array column functions (all JVM built-ins).

Every function takes and returns a ``Column`` so it works the same on batch and
streaming DataFrames and stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tandem.functions.common import as_col

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour
# ---------------------------------------------------------------------------
HANGUL_SYLLABLES = "가-힣"          # class kept by the cleaners
LAUGH_MARKER = "laughing"           # literal removed from both sides
REJECT_PATTERN = "[a-zA-Z0-9]"      # a side matching this blanks the pair
MIN_STANDARD_LEN = 6                # shorter standard sides are dropped
NORMALIZE_KEEP = "가-힣 "           # class kept by the loader's normaliser
CLEAN_TEXT_CHARS = "-=+,#/?:^$.@*~&%ㆍ!()[]<>"   # characters deleted by clean_text
MAX_LEN_SYL = 110                   # default maximum length, syllable level
MAX_LEN_WORD = 30                   # default maximum length, word level

# Unicode-aware word / whitespace classes that agree with Python's ``re``:
# Java's \w is ASCII, so the letter/number categories are spelled out, and
# Python also counts U+001C..U+001F as whitespace.
WORD_CLASS = r"\p{L}\p{N}_"
SPACE_CLASS = r"\s\x{1c}-\x{1f}"
SPACE_RUN = r"(?U)[\s\x{1c}-\x{1f}]+"
EDGE_SPACE = r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$"


def strip_special(c, keep: str = HANGUL_SYLLABLES) -> Column:
    """Delete every character that is not a word char, whitespace or in ``keep``."""
    return F.regexp_replace(as_col(c), f"(?U)[^{WORD_CLASS}{SPACE_CLASS}{keep}]", "")


def squeeze_spaces(c) -> Column:
    """One left-to-right pass replacing two spaces by one (3 → 2, 4 → 2)."""
    return F.replace(as_col(c), F.lit("  "), F.lit(" "))


def strip_marker(c, marker: str = LAUGH_MARKER) -> Column:
    """Delete every occurrence of a literal marker."""
    return F.replace(as_col(c), F.lit(marker), F.lit(""))


def normalize_hangul(c, keep: str = NORMALIZE_KEEP) -> Column:
    """Strip edge whitespace first, then delete everything outside ``keep``."""
    stripped = F.regexp_replace(as_col(c), EDGE_SPACE, "")
    return F.regexp_replace(stripped, f"[^{keep}]", "")


def clean_text(c, chars: str = CLEAN_TEXT_CHARS) -> Column:
    """Delete the listed punctuation characters only."""
    return F.translate(as_col(c), chars, "")


def contains_digit(c) -> Column:
    """True if any character is a decimal digit (Unicode Nd)."""
    return as_col(c).rlike(r"\p{Nd}")


def syllables(c) -> Column:
    """One token per code point, spaces included; '' → []."""
    return F.filter(F.split(as_col(c), ""), lambda x: x != "")


def words(c) -> Column:
    """Unicode-whitespace split with no empty tokens (Python ``str.split()``)."""
    return F.filter(F.split(as_col(c), SPACE_RUN), lambda x: x != "")


def tokens(c, level: str = "word") -> Column:
    if level == "syl":
        return syllables(c)
    if level == "word":
        return words(c)
    raise ValueError(f"unknown level {level!r} (jaso is not implemented)")


def lower_tokens(a) -> Column:
    return F.transform(as_col(a), lambda x: F.lower(x))


def join_tokens(a, level: str = "word") -> Column:
    """Inverse of :func:`tokens`: '' join for syllables, ' ' join for words."""
    return F.array_join(as_col(a), "" if level == "syl" else " ")


def token_length(c, level: str = "word") -> Column:
    """Length used by the max-length filter: code points or words."""
    return F.length(as_col(c)) if level == "syl" else F.size(words(c))


def truncate_at_special(a, level: str = "word") -> Column:
    """Drop the first token, join, cut at the first '<' and strip edges.

    Without any '<' the joined text is returned unstripped.
    """
    joined = join_tokens(F.slice(as_col(a), 2, F.greatest(F.size(as_col(a)) - 1, F.lit(0))), level)
    at = F.instr(joined, "<")
    cut = F.regexp_replace(F.substring(joined, F.lit(1), at - 1), EDGE_SPACE, "")
    return F.when(at > 0, cut).otherwise(joined)
