"""Array<int> column functions over encoded sentences (all built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tandem.functions.common import EOS_ID, PAD_ID, UNK_ID, as_col


def oov_to_unk(a, n: int, unk: int = UNK_ID, inclusive: bool = False) -> Column:
    """Ids above ``n`` (or ``>= n`` with ``inclusive``) become ``unk``."""
    return F.transform(
        as_col(a), lambda x: F.when((x >= n) if inclusive else (x > n), F.lit(unk)).otherwise(x)
    )


def one_hot(a, n=None) -> Column:
    """Dense indicator vectors: each id becomes an array of ``n`` 0/1 ints
    (default ``n``: the largest id of the array plus one)."""
    if n is None:
        n = F.array_max(as_col(a)) + 1
    n = F.lit(n) if isinstance(n, int) else as_col(n)
    return F.transform(
        as_col(a),
        lambda x: F.transform(F.sequence(F.lit(0), n - 1), lambda j: (j == x).cast("int")),
    )


def trim_at(a, stop: int = 2) -> Column:
    """Prefix up to and including the first ``stop``; whole array if none."""
    a = as_col(a)
    p = F.array_position(a, stop)
    return F.when(p > 0, F.slice(a, F.lit(1), p.cast("int"))).otherwise(a)


def seq_length(a, stop: int = 2) -> Column:
    """Index of the first ``stop`` plus one, else the size."""
    a = as_col(a)
    p = F.array_position(a, stop)
    return F.when(p > 0, p.cast("int")).otherwise(F.size(a))


def truncate_at_eos(a, eos: int = EOS_ID) -> Column:
    """Ids strictly before the first ``eos``; unchanged if there is none."""
    a = as_col(a)
    p = F.array_position(a, eos)
    return F.when(p > 0, F.slice(a, F.lit(1), (p - 1).cast("int"))).otherwise(a)


def pad_to(a, length, pad: int = PAD_ID) -> Column:
    """Right-pad to ``length`` (no-op when already that long)."""
    a = as_col(a)
    length = F.lit(length) if isinstance(length, int) else as_col(length)
    return F.concat(a, F.array_repeat(F.lit(pad), F.greatest(length - F.size(a), F.lit(0)).cast("int")))


def pad_mask(a, pad: int = PAD_ID) -> Column:
    return F.transform(as_col(a), lambda x: x == pad)


def position_ids(a, pad: int = PAD_ID) -> Column:
    """1-based position, 0 at padding."""
    return F.transform(as_col(a), lambda x, i: F.when(x == pad, F.lit(0)).otherwise(i + 1))


def ids_text(a, sep: str = ",") -> Column:
    """Render an id array as text (for reports and comparisons)."""
    return F.array_join(F.transform(as_col(a), lambda x: x.cast("string")), sep)
