from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed special tokens and ids of the sentence vocabulary.
UNK, PAD, SOS, EOS = "<unk>", "<pad>", "<sos>", "<eos>"
UNK_ID, PAD_ID, SOS_ID, EOS_ID = 0, 1, 2, 3
SPECIALS = [(UNK, UNK_ID), (PAD, PAD_ID), (SOS, SOS_ID), (EOS, EOS_ID)]
NULL_TOKEN = "<null>"     # empty source word of the lexical model
UNKNOWN_TEXT = "<???>"    # extended id with no input token behind it


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
