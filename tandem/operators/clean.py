"""Projections, filters and the cleaning chain over pair tables.

All of these are narrow: one ``select`` / ``filter`` each, fused by whole-stage
codegen, and they work unchanged on streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.functions import text as T


def project_pairs(df: DataFrame, std: str = "gw", dia: str = "jj", keep=("sid",)) -> DataFrame:
    """Pick two columns and name them ``standard`` / ``dialect``."""
    keep = [k for k in keep if k in df.columns]
    return df.select(*keep, F.col(std).alias("standard"), F.col(dia).alias("dialect"))


def drop_non_text(df: DataFrame, subset=("standard", "dialect")) -> DataFrame:
    """Drop a row if any of ``subset`` is missing."""
    return df.dropna(subset=list(subset))


def blank_if_match(df: DataFrame, pattern: str = T.REJECT_PATTERN,
                   a: str = "standard", b: str = "dialect") -> DataFrame:
    """If either side matches ``pattern``, both sides become ''."""
    hit = F.col(a).rlike(pattern) | F.col(b).rlike(pattern)
    return df.withColumns({
        a: F.when(hit, F.lit("")).otherwise(F.col(a)),
        b: F.when(hit, F.lit("")).otherwise(F.col(b)),
    })


def drop_short(df: DataFrame, min_len: int = T.MIN_STANDARD_LEN, c: str = "standard") -> DataFrame:
    """Drop rows whose ``c`` has fewer than ``min_len`` code points."""
    return df.filter(F.length(F.col(c)) >= min_len)


def clean_pairs(df: DataFrame, keep: str = T.HANGUL_SYLLABLES, marker: str = T.LAUGH_MARKER,
                reject: str = T.REJECT_PATTERN, min_len: int = T.MIN_STANDARD_LEN,
                a: str = "standard", b: str = "dialect") -> DataFrame:
    """strip_special → squeeze_spaces → strip_marker → blank_if_match → drop_short.

    A missing side is cleaned as the text ``'nan'`` (as ``str(NaN)``), which
    the Latin reject pattern then blanks.
    """
    def chain(c):
        c = F.coalesce(F.col(c), F.lit("nan"))
        return T.strip_marker(T.squeeze_spaces(T.strip_special(c, keep)), marker)

    out = df.withColumns({a: chain(a), b: chain(b)})
    return drop_short(blank_if_match(out, reject, a, b), min_len, a)


def normalize_pairs(df: DataFrame, keep: str = T.NORMALIZE_KEEP, cols=("standard", "dialect")) -> DataFrame:
    return df.withColumns({c: T.normalize_hangul(c, keep) for c in cols})


def clean_text_pairs(df: DataFrame, cols=("standard", "dialect")) -> DataFrame:
    return df.withColumns({c: T.clean_text(c) for c in cols})


def filter_max_len(df: DataFrame, max_len: int | None = None, level: str = "word",
                   a: str = "src", b: str = "trg") -> DataFrame:
    """Keep a pair if both sides are strictly shorter than ``max_len``."""
    if max_len is None:
        max_len = T.MAX_LEN_SYL if level == "syl" else T.MAX_LEN_WORD
    return df.filter((T.token_length(a, level) < max_len) & (T.token_length(b, level) < max_len))


def orient(df: DataFrame, dia2std: bool = True, std: str = "standard", dia: str = "dialect") -> DataFrame:
    """Name the sides ``src`` / ``trg``: dialect → standard, or the reverse."""
    s, t = (dia, std) if dia2std else (std, dia)
    rest = [c for c in df.columns if c not in (std, dia)]
    return df.select(*rest, F.col(s).alias("src"), F.col(t).alias("trg"))
