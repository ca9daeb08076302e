"""Toxicity by subword-bag embeddings: each document is the average of the
embeddings of its character n-grams, read by a linear softmax, and both are
trained together in numpy.

* Features: byte n-grams (3 to 6) of the distinct lower-cased words of a text,
  with their edges marked, hashed into ``2**BITS`` rows. Words that were never
  seen share the rows of their n-grams. A word counts once, so that a text that
  repeats itself isn't judged by one word, and ``PRIOR`` neutral n-grams are
  averaged in, so that a text of a few words isn't judged by chance.
* Fit: on a bounded sample of labelled documents (``max_toxic`` and
  ``max_clean``, the smallest ``xxhash64(doc_id)`` first); whole texts are used.
* Score: the model is linear in the average, so an n-gram's share of the score
  is one number. A task sums these numbers over whole texts and nothing else
  travels: one narrow pass over the documents, without a shuffle.

Defined results: null and empty texts score as the average of nothing (the
bias alone). Labels that are null are not used. Rows keep every column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.llm.common import append_columns
from tandem.llm.words import mix, word_hashes, word_spans

BITS = 18
ORDERS = (3, 4, 5, 6)
DIM = 8
PRIOR = 600
#: An n-gram gets an embedding where this many documents of the sample have it, and this share of them.
MIN_DOCS, MIN_SHARE = 3, 0.005
TOXIC_SHARE = 0.6
MAX_TOXIC, MAX_CLEAN = 2000, 3200
_FOLD = np.arange(256, dtype=np.uint8)  # letters A-Z to lower case; white space, control and ASCII marks to a blank
_FOLD[65:91] += 32
_FOLD[[c for c in range(128) if not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123)]] = 32
_CHUNK = 1 << 20


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of each text, folded, blanks around each, in one buffer; where each text begins."""
    data = _FOLD[np.frombuffer(b" ".join(texts), np.uint8)]
    begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    start, end, first = word_spans(data, np.minimum(begins, len(data)))
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    key = mix(word_hashes(data, start, end) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    keep = np.sort(np.unique(key, return_index=True)[1])
    start, size, doc = start[keep], (end - start)[keep] + 1, doc[keep]
    sizes = np.bincount(doc, size, len(texts)).astype(np.int64) + 1  # a blank before, and one behind each word
    at = np.concatenate(([0], np.cumsum(sizes)))
    buf = np.full(at[-1] + max(ORDERS) + 1, 32, np.uint8)
    before = np.cumsum(size) - size  # bytes of earlier words
    src = np.arange(int(size.sum())) - np.repeat(before, size) + np.repeat(start, size)
    dst = np.arange(len(src)) + np.repeat(doc + 1, size)  # each text's leading blank
    last = np.concatenate((data, np.full(1, 32, np.uint8)))
    buf[dst] = last[src]
    buf[dst[before + size - 1]] = 32
    return buf, at


def _grams(buf: np.ndarray, n_positions: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: the bucket of the n-gram that starts at each position, and whether it lies in one word."""
    total = len(buf)
    blank = buf == 32
    nxt = np.where(blank, np.arange(total), total)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    room = np.empty(n_positions, np.int64)  # to the first blank behind the first byte
    room[:] = nxt[1 : n_positions + 1] - np.arange(n_positions)
    h = np.zeros(n_positions, np.uint32)
    for j in range(max(ORDERS)):
        h = h * np.uint32(16777619) + buf[j : j + n_positions].astype(np.uint32) + np.uint32(1)
        if j + 1 in ORDERS:
            g = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)
            yield (g >> np.uint32(32 - BITS)).astype(np.int64), room >= j


def _encoded(texts) -> list[bytes]:
    return [b"" if t is None else t.encode() if isinstance(t, str) else bytes(t) for t in texts]


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct feature rows of one text and how often each occurs."""
    buf, at = _joined([text])
    ids = [g[ok] for g, ok in _grams(buf, int(at[-1]))]
    return np.unique(np.concatenate(ids), return_counts=True)


class ToxicityModel:
    """``weights``: each feature row's share of the logit; ``bias``: the logit of an empty text."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, texts) -> np.ndarray:
        texts = _encoded(texts)
        out = np.empty(len(texts))
        lo = 0
        while lo < len(texts):  # about a MB of text at once, to stay in cache
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= _CHUNK):
                size += len(texts[hi])
                hi += 1
            out[lo:hi] = self._scores(texts[lo:hi])
            lo = hi
        return out

    def _scores(self, texts: list[bytes]) -> np.ndarray:
        buf, at = _joined(texts)
        total, count = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for g, ok in _grams(buf, int(at[-1])):
            total += np.add.reduceat(np.where(ok, self.weights[g], 0.0), at[:-1])
            count += np.add.reduceat(ok.astype(np.int64), at[:-1])
        return 1 / (1 + np.exp(-(self.bias + total / (count + PRIOR))))


def train(texts, labels, dim: int = DIM, epochs: int = 12, batch: int = 64, rate: float = 0.05, seed: int = 7) -> ToxicityModel:
    """Embeddings and softmax together, by Adam on mini-batches of documents.

    The two softmax rows only matter by their difference, so one row is kept.
    Few toxic rows weigh more, up to ``TOXIC_SHARE`` of the weight of the others.
    Without both classes the model answers with the share of label 1.
    """
    y = np.asarray(labels, np.float64)
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-3), 1 - 1e-3)
        return ToxicityModel(np.zeros(1 << BITS), float(np.log(share / (1 - share))))
    bags, held = [], np.zeros(1 << BITS, np.int64)
    for t in texts:  # one text at once: a few MB of counts stay of each thousand documents
        ids, n = bag(_encoded([t])[0])
        held[ids] += 1
        bags.append((ids.astype(np.int32), (n / (n.sum() + PRIOR)).astype(np.float32)))
    rng = np.random.default_rng(seed)
    often = held >= max(MIN_DOCS, MIN_SHARE * len(bags))  # rarer rows stay neutral
    used, place = np.flatnonzero(often), (np.cumsum(often) - 1).astype(np.int32)
    for r, (ids, share) in enumerate(bags):
        bags[r] = (place[ids[often[ids]]], share[often[ids]])
    emb = rng.normal(0, 0.1, (len(used), dim)).astype(np.float32)
    out = rng.normal(0, 0.1, dim).astype(np.float32)
    bias = np.zeros(1, np.float32)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (emb, out, bias)]
    steps = 0
    weight = np.where(y == 1, max(1.0, TOXIC_SHARE * (y == 0).sum() / (y == 1).sum()), 1.0)
    weight /= weight.mean()
    for epoch in range(epochs):
        step_rate = rate * (1 - epoch / epochs)
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            ids = np.concatenate([bags[r][0] for r in rows])
            share = np.concatenate([bags[r][1] for r in rows])
            sizes = np.array([len(bags[r][0]) for r in rows])
            doc = np.repeat(np.arange(len(rows)), sizes)
            mean = np.stack([np.bincount(doc, share * emb[ids, d], len(rows)) for d in range(dim)], 1).astype(np.float32)
            p = 1 / (1 + np.exp(-(mean @ out + bias[0])))
            err = (weight[rows] * (p - y[rows]) / len(rows)).astype(np.float32)
            hit, back = np.unique(ids, return_inverse=True)
            flow = np.bincount(back, share * err[doc], len(hit)).astype(np.float32)  # d loss / d logit share
            steps += 1
            grads = (flow[:, None] * out[None, :], mean.T @ err, np.array([err.sum()], np.float32))
            for p_, g, (m, v), at in zip((emb, out, bias), grads, state, (hit, slice(None), slice(None)), strict=True):
                m[at] = 0.9 * m[at] + 0.1 * g
                v[at] = 0.99 * v[at] + 0.01 * g * g
                p_[at] -= step_rate * (m[at] / (1 - 0.9**steps)) / (np.sqrt(v[at] / (1 - 0.99**steps)) + 1e-8)
    weights = np.zeros(1 << BITS)
    weights[used] = emb @ out
    return ToxicityModel(weights, float(bias[0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, usable=None, key: str = "doc_id",
                    text: str = "text", label: str = "toxic") -> tuple[list, list]:
    """Texts and labels of at most ``max_toxic`` and ``max_clean`` labelled documents; ``usable`` is a condition on the id."""
    known = labels.select(F.col(key).alias("_id"), F.col(label).cast("int").alias("_y")).where(
        F.col("_id").isNotNull() & F.col("_y").isin(0, 1)).groupBy("_id").agg(F.max("_y").alias("_y"))
    if usable is not None:
        known = known.where(usable(F.col("_id")))
    hashed = known.join(docs.select(F.col(key).alias("_id")).distinct(), "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id")
    picked = hashed.where("_y = 1").limit(max_toxic).union(hashed.where("_y = 0").limit(max_clean))
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(
        F.broadcast(picked), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text")).orderBy("_id").toLocalIterator()
    pairs = [(r["_text"], r["_y"]) for r in rows]
    return [t for t, _ in pairs], [y for _, y in pairs]


def with_scores(docs: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with ``score`` (0 to 1), from whole texts. The model (2**BITS numbers) has a fixed size and goes to all tasks."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))
    at = docs.drop(score).columns.index(text)

    def make():
        m = ToxicityModel(*sent.value)
        return lambda b: [pa.array(m.scores(b.column(at).cast(pa.binary()).to_pylist()), pa.float64())]

    return append_columns(docs, [T.StructField(score, T.DoubleType())], make)


def fit(docs: DataFrame, labels: DataFrame, usable=None, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> ToxicityModel:
    return train(*labelled_sample(docs, labels, max_toxic, max_clean, usable))


def held_out(doc_id):
    """Documents that are never trained on: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
