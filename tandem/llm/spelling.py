"""Spelling variant grouping by finite-state composition.

Words at one edit are the pairs that the machine *acceptor ∘ one-edit transducer ∘ acceptor* accepts:
both tapes read the same symbols from the initial state on, one edit takes
place where the two words part, and what follows is the same on both tapes. An
edit stands at the end of the longest common prefix, so each pair has one path.

1. *Partitions by initial state.* The composed machine is cut at prefixes. A
   prefix with more than ``LIMIT`` words below it is *heavy* (found level by level;
   a chain without a branch is one step). Edits at a heavy prefix are an initial state of
   their own: its words are dealt over bins by a hash of what follows the edit, once as
   the side that has a symbol at the edit and once as the side that lacks it, so
   the two words of a pair meet in one bin. The subtree of a prefix that isn't heavy is
   one partition, in which edits at any depth are allowed. Bins hold about ``LIMIT`` rows.
2. *Acceptor.* A bin sorts its words into a trie and minimises it: nodes with the same right
   language become one state (found by hashes from the leaves up, then proved arc by arc).
3. *Composition.* From each initial state the pairs of states behind an edit are
   followed over the symbols that both accept; pairs that reach no common end are trimmed.
4. *Enumeration.* Words are read off along the trie, only where the trimmed machine goes.
   A bin reports for each word how many words are near and the best of them; these are added up.

All of 2 to 4 works on whole arrays in numpy.

Defined results: a null text has no words, a null key is the empty string in the
hash; runs and words have any length; rows that repeat count again; an empty table
gives no words; ties between near words go to the smaller word in code-point order; further columns
are ignored. Without words of one edit ``n_near`` is 0, ``form`` null and ``root`` the word.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import broadcast_if, prepare
from tandem.session import cut_lineage

MIN_LENGTH, MIN_COUNT, ERROR_SHARE, FACTOR = 5, 3, 97, 2
LIMIT, HEAVY = 20_000, 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OUTSIDE = "[^a-zÀ-ÿ]+"   # between runs, once A-Z are lower-cased
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x7FB5D329728EA185)
    h = (h ^ (h >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): all indexes of the ranges ``starts[i] : starts[i] + sizes[i]``."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    return row, np.arange(len(row)) - np.repeat(ends - sizes, sizes) + np.repeat(starts, sizes)


class Trie:
    """Words (sorted, distinct) below numbered roots; node i < ``roots`` is a root, arcs are sorted by (node, symbol)."""

    def __init__(self, roots: int, root: list[int], words: list[str]):
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        size = np.array([len(w) for w in words], np.int64)
        start = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))[:-1]
        rooted = np.array(root, np.int64)
        # common prefix with the word before
        same = np.zeros(len(words), np.int64)
        live = np.flatnonzero(np.concatenate((np.zeros(1, bool), rooted[1:] == rooted[:-1]))) if len(words) else np.zeros(0, np.int64)
        depth = 0
        while len(live):
            live = live[(size[live] > depth) & (size[live - 1] > depth)]
            live = live[codes[start[live] + depth] == codes[start[live - 1] + depth]]
            depth += 1
            same[live] = depth
        fresh = size - same
        first = roots + np.concatenate((np.zeros(1, np.int64), np.cumsum(fresh)))
        hang, last, path = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), []
        for i, (r, s, n, b) in enumerate(zip(root, same.tolist(), fresh.tolist(), first.tolist(), strict=False)):
            path[0:] = [*path[: s + 1], *range(b, b + n)] if s else [r, *range(b, b + n)]
            hang[i], last[i] = path[s], path[-1]
        self.n, self.roots, self.end = int(first[-1]), roots, last
        row, at = _ragged(start + same, fresh)
        parent = np.concatenate((np.zeros(roots, np.int64), roots - 1 + np.arange(len(row))))
        begins = np.flatnonzero(fresh > 0)
        parent[first[begins]] = hang[begins]
        symbol = np.concatenate((np.zeros(roots, np.int64), codes[at]))
        self.depth = np.zeros(self.n, np.int64)
        self.depth[roots:] = at - start[row] + 1
        self.root_of = np.concatenate((np.arange(roots), rooted[row]))
        nodes = np.arange(roots, self.n)
        order = nodes[np.lexsort((symbol[roots:], parent[roots:]))]
        self.arc_from, self.arc_symbol, self.arc_to = parent[order], symbol[order], order
        self.arcs = np.searchsorted(self.arc_from, np.arange(self.n + 1))
        self.parent, self.symbol = parent, symbol


class Machine:
    """States and arcs; ``final`` has one bit for each tape's role."""

    def __init__(self, final: np.ndarray, arcs: np.ndarray, symbol: np.ndarray, to: np.ndarray):
        self.final, self.arcs, self.symbol, self.to = final, arcs, symbol, to
        self.alphabet, code = np.unique(symbol, return_inverse=True)
        self.width = max(1, len(self.alphabet))
        self.code = code
        self.key = np.repeat(np.arange(len(final)), np.diff(arcs)) * self.width + code  # ascending

    def both(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, symbol, next x, next y) of every symbol that both states accept."""
        swap = np.diff(self.arcs)[x] > np.diff(self.arcs)[y]
        a, b = np.where(swap, y, x), np.where(swap, x, y)
        row, arc = _ragged(self.arcs[a], self.arcs[a + 1] - self.arcs[a])
        want = b[row] * self.width + self.code[arc]
        place = np.searchsorted(self.key, want)
        hit = np.zeros(len(want), bool)
        inside = place < len(self.key)
        hit[inside] = self.key[place[inside]] == want[inside]
        row, arc, other = row[hit], arc[hit], place[hit]
        na, nb, s = self.to[arc], self.to[other], swap[row]
        return row, self.symbol[arc], np.where(s, nb, na), np.where(s, na, nb)


def minimised(trie: Trie, final: np.ndarray) -> tuple[np.ndarray, Machine]:
    """(state of each node, the minimal acceptor); nodes are one state when their right languages are the same."""
    h = np.zeros(trie.n, _U)
    by_depth = np.argsort(trie.depth, kind="stable")
    cuts = np.searchsorted(trie.depth[by_depth], np.arange(int(trie.depth.max(initial=0)) + 2))
    salt = _mix((final + 1).astype(_U) * _U(0x9E3779B97F4A7C15))
    for d in range(len(cuts) - 2, -1, -1):
        level = by_depth[cuts[d] : cuts[d + 1]]
        h[level] = _mix(h[level] + salt[level])
        if d:
            np.add.at(h, trie.parent[level], _mix(h[level] ^ _mix(trie.symbol[level].astype(_U) + _U(0x632BE59BD9B4E019))))
    _, sample, state = np.unique(h, return_index=True, return_inverse=True)
    count = np.diff(trie.arcs)
    # proof: every node has the finality, the symbols and the next states of the node that stands for it
    stands = sample[state]
    proven = bool((count == count[stands]).all() and (final == final[stands]).all())
    if proven:
        row, mine = _ragged(trie.arcs[:-1], count)
        theirs = trie.arcs[stands[row]] + mine - trie.arcs[row]
        proven = bool((trie.arc_symbol[mine] == trie.arc_symbol[theirs]).all() and (state[trie.arc_to[mine]] == state[trie.arc_to[theirs]]).all())
    if not proven:  # a clash of hashes: the trie itself accepts the same words
        state, sample = np.arange(trie.n), np.arange(trie.n)
    row, arc = _ragged(trie.arcs[sample], count[sample])
    arcs = np.concatenate((np.zeros(1, np.int64), np.cumsum(count[sample])))
    return state, Machine(final[sample], arcs, trie.arc_symbol[arc], state[trie.arc_to[arc]])


LONG, SHORT = 1, 2  # roles: a word with a symbol at the edit, a word that lacks it


def _after_edit(arcs: np.ndarray, to: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, 0) of two arcs that leave a state of ``at`` (replaced symbol), (x, y, 1) of an arc and the state itself (symbol deleted), with the deleting arc."""
    row, arc = _ragged(arcs[at], arcs[at + 1] - arcs[at])
    rest = arcs[at + 1][row] - arc - 1
    left, right = _ragged(arc + 1, rest)
    kind = np.concatenate((np.zeros(len(left), np.int64), np.ones(len(arc), np.int64)))
    return (np.concatenate((to[arc][left], to[arc])), np.concatenate((to[right], at[row])), kind,
            np.concatenate((np.full(len(left), -1), arc)))


def near_words(roots: int, root: list[int], words: list[str], role: np.ndarray, deep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the word pairs at one edit whose edit stands at a root or, where ``deep[root]``, anywhere below; each pair once.

    ``words`` are distinct and sorted below each root, roots in ascending order.
    """
    none = np.zeros(0, np.int64)
    if len(words) < 2:
        return none, none
    trie = Trie(roots, root, words)
    final, word_at = np.zeros(trie.n, np.int64), np.full(trie.n, -1, np.int64)
    final[trie.end], word_at[trie.end] = role, np.arange(len(words))
    state, m = minimised(trie, final)
    initial = np.flatnonzero((trie.depth == 0) | deep[trie.root_of])
    states = np.int64(len(m.final))

    def accepts(x, y, kind, final):
        return np.where(kind == 0, (final[x] & LONG > 0) & (final[y] & LONG > 0), (final[x] & LONG > 0) & (final[y] & SHORT > 0))

    def pair(x, y, kind):
        return (kind * states + x) * states + y

    # the composed machine behind the edit: a level holds distinct pairs of states, with the pairs that lead to them
    x, y, kind, arc = _after_edit(m.arcs, m.to, np.unique(state[initial]))
    deleted = np.where(arc >= 0, m.symbol[np.maximum(arc, 0)], -1) if len(m.symbol) else arc
    first = np.unique(pair(x, y, kind)[kind == 0])
    x1, y1, k1, s1 = x[kind == 1], y[kind == 1], kind[kind == 1], deleted[kind == 1]
    row, symbol, nx, ny = m.both(x1, y1)
    step = symbol != s1[row]       # a pair parts where the edit stands: the shorter word doesn't go on with the deleted symbol
    second = np.unique(pair(nx[step], ny[step], k1[row[step]]))
    levels, level = [], np.union1d(first, second)
    while len(level):
        k, lx, ly = level // (states * states), level // states % states, level % states
        row, _, nx, ny = m.both(lx, ly)
        keys, child = np.unique(pair(nx, ny, k[row]), return_inverse=True)
        levels.append((level, accepts(lx, ly, k, m.final), row, child))
        level = keys
    useful, live = none, np.zeros(0, bool)
    for level, ends, row, child in reversed(levels):
        if len(row):
            ends = ends.copy()
            ends[row[live[child]]] = True
        live = ends
        useful = np.union1d(useful, level[live])

    def goes_on(x, y, kind):
        key = pair(state[x], state[y], kind)
        place = np.minimum(np.searchsorted(useful, key), max(0, len(useful) - 1))
        return useful[place] == key if len(useful) else np.zeros(len(key), bool)

    # the words of those paths, along the trie
    nodes = Machine(final, trie.arcs, trie.arc_symbol, trie.arc_to)
    a, b, kind, arc = _after_edit(trie.arcs, trie.arc_to, initial)
    out_a, out_b = [], []
    gone = kind == 1
    da, db, ds = a[gone], b[gone], trie.arc_symbol[arc[gone]]
    ends = accepts(da, db, np.ones(len(da), np.int64), final)
    out_a.append(word_at[da[ends]])
    out_b.append(word_at[db[ends]])
    row, symbol, na, nb = nodes.both(da, db)
    step = symbol != ds[row]
    a, b = np.concatenate((a[~gone], na[step])), np.concatenate((b[~gone], nb[step]))
    kind = np.concatenate((kind[~gone], np.ones(int(step.sum()), np.int64)))
    while len(a):
        go = goes_on(a, b, kind)
        a, b, kind = a[go], b[go], kind[go]
        ends = accepts(a, b, kind, final)
        out_a.append(word_at[a[ends]])
        out_b.append(word_at[b[ends]])
        row, _, a, b = nodes.both(a, b)
        kind = kind[row]
    return np.concatenate(out_a), np.concatenate(out_b)


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)``: lower-cased runs of letters, one in ``ERROR_SHARE`` of them (by the crc32 of key and run) without one symbol."""
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"),
                       F.explode(F.split(F.translate(text, UPPER, LOWER), OUTSIDE)).alias("run")).where(F.length("run") >= min_length)
    h, size = F.col("h"), F.length("run")
    at = (h % size).cast("int")
    word = F.when(h % ERROR_SHARE == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))).otherwise(F.col("run"))
    found = runs.withColumn("h", F.crc32(F.concat("key", F.lit(":"), "run"))).select(word.alias("word")).where(F.length("word") >= min_length)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def partitions(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``(bin, prefix, rest, role, deep, word, n)``: the words of each initial state, at heavy prefixes once in either role."""
    shared = F.udf(lambda low, high: os.path.commonprefix((low, high)), "string")  # of heavy prefixes alone: at most words / limit of them a level

    def grown(groups: DataFrame) -> DataFrame:
        return groups.where(F.col("count") > limit).select("child", shared("low", "high").alias("next"))

    def sizes(rows: DataFrame) -> DataFrame:
        return rows.groupBy("child").agg(F.count("*").alias("count"), F.min("word").alias("low"), F.max("word").alias("high"))

    rows, light, heavy, total = words.select("word", "n", F.substring("word", 1, 0).alias("child")), [], [], 0
    while True:
        big = cut_lineage(grown(sizes(rows)), "heavy")
        dealt = cut_lineage(rows.join(broadcast_if(big, HEAVY), "child", "left"), "prefixes")
        light.append(dealt.where("next is null").select("word", "n", F.col("child").alias("prefix")))
        under = dealt.where("next is not null").select("word", "n", F.col("next").alias("prefix"))
        if big.isEmpty():
            break
        heavy.append(under)
        total += 2 * under.count()
        rows = under.where(F.length("word") > F.length("prefix")).select(
            "word", "n", F.substring("word", F.lit(1), F.length("prefix") + 1).alias("child"))
    rest = F.substring("word", F.length("prefix") + 1, F.length("word"))
    total += words.count()
    bins = max(1, -(-total // limit))

    def cut(df: DataFrame, follows, role: int, deep: bool) -> DataFrame:
        return df.select(F.pmod(F.xxhash64("prefix", follows), F.lit(bins)).alias("bin"), "prefix", rest.alias("rest"),
                         F.lit(role).alias("role"), F.lit(deep).alias("deep"), "n")

    out = None
    for df in light:
        part = cut(df, F.lit(""), LONG | SHORT, True)
        out = part if out is None else out.union(part)
    for df in heavy:
        out = out.union(cut(df.where(F.length("word") > F.length("prefix")), F.substring(rest, F.lit(2), F.length("word")), LONG, False))
        out = out.union(cut(df, rest, SHORT, False))
    return out


def near_counts(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``(word, n_near, best)`` of the words with near words; ``best`` is ``(-n, word)`` of the most frequent one."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        by = pdf.groupby(["deep", "prefix", "rest"], sort=True, as_index=False).agg(role=("role", "sum"), n=("n", "first"))
        heads, root = np.unique(by["deep"].astype(str) + ":" + by["prefix"], return_inverse=True)
        by = by.assign(root=root).sort_values(["root", "rest"], ignore_index=True)
        rests, prefix, n = by["rest"].tolist(), by["prefix"].tolist(), by["n"].to_numpy(np.int64)
        deep = np.zeros(len(heads), bool)
        deep[by["root"].to_numpy()] = by["deep"].to_numpy(bool)
        i, j = near_words(len(heads), by["root"].tolist(), rests, by["role"].to_numpy(np.int64), deep)
        a, b = np.concatenate((i, j)), np.concatenate((j, i))
        order = np.lexsort((b, -n[b], a))
        a, b = a[order], b[order]
        word, at, near = np.unique(a, return_index=True, return_counts=True)
        text = [p + r for p, r in zip(prefix, rests, strict=True)]
        text = np.array([*text, None], object)  # an object column whatever it holds
        return pd.DataFrame({"word": text[word], "n_near": near, "minus": -n[b[at]], "best": text[b[at]]}).astype({"word": object, "best": object})

    found = partitions(words, limit).groupBy("bin").applyInPandas(run, "word string, n_near long, minus long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct(F.col("minus").alias("minus"), F.col("best").alias("word"))).alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: pointers are doubled until all stand still."""
    at = cut_lineage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        jump = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = cut_lineage(at.join(broadcast_if(jump, HEAVY), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = new.select("word", "root")
        if new.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", factor: int = FACTOR, limit: int = LIMIT) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``: each word with its most frequent near word, if at least ``factor`` times as frequent, and the end of that chain."""
    prepare(docs.sparkSession)
    words = cut_lineage(word_counts(docs, key, text), "words")
    near = near_counts(words, limit)
    form_n = -F.col("best.minus")
    known = cut_lineage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form_n >= factor * F.col("n"), F.col("best.word")).alias("form"),
        F.when(form_n >= factor * F.col("n"), form_n).alias("form_n")), "near")
    roots = _roots(known.where("form is not null"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
