"""Lexical translation tables: learning (see :mod:`tandem.operators.em`), loss,
alignment, translation, pivoting and lexicon composition.

Sentences are whole: a pair of words of one sentence is a cell wherever the two
stand in it. Learning, alignment and the loss of learned sentences work on the
model's blocks; ``sentence_nll`` joins any pairs with any table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.functions.common import NULL_TOKEN, UNK, as_col
from tandem.functions.text import EDGE_SPACE, words
from tandem.operators.em import P_FLOOR, Model, build
from tandem.operators.epochs import PPL_LIMIT, STREAK_LIMIT, best_so_far, stop_epoch, truncate_at_stop
from tandem.operators.lookup import HEAD_ROWS, looked_up
from tandem.operators.order import dense_index
from tandem.session import bounded_broadcast, cut_lineage, session_conf

T_BROADCAST_ROWS = 2_000_000     # translation-table rows that may be broadcast
PRODUCT_ROWS_PER_TASK = 2_000_000  # joined rows per task in lexicon composition


def _counted(a):
    """distinct tokens of ``a`` with their multiplicity, as an array of structs."""
    return F.transform(F.array_distinct(a), lambda x: F.struct(
        x.alias("tok"), F.size(F.filter(a, lambda y: y == x)).alias("c")))


def cooccurrence(pairs: DataFrame, src="src_tokens", trg="trg_tokens", key: Sequence[str] = ("region",),
                 sid: str = "sid", null: bool = True) -> DataFrame:
    """Cells ``(key.., sid, l, e, ce, f, cf)`` of every sentence pair.

    ``l`` is the number of source tokens (plus one for the empty word).
    """
    key = list(key)
    s = as_col(src)
    if null:
        s = F.concat(F.array(F.lit(NULL_TOKEN)), s)
    rows = pairs.select(*key, sid, s.alias("_s"), as_col(trg).alias("_t")).repartition(*key, sid)
    cells = rows.select(
        *key, sid, F.size("_s").alias("l"),
        F.explode(_counted(F.col("_s"))).alias("_e"), F.col("_t"),
    ).select(*key, sid, "l", F.col("_e.tok").alias("e"), F.col("_e.c").alias("ce"),
             F.explode(_counted(F.col("_t"))).alias("_f"))
    return cells.select(*key, sid, "l", "e", "ce", F.col("_f.tok").alias("f"), F.col("_f.c").alias("cf"))


def learn_lexicon(pairs: DataFrame, iters: int = 5, null: bool = True, min_p: float = 0.0, src="src_tokens", trg="trg_tokens",
                  key: Sequence[str] = ("region",), start: DataFrame | None = None) -> DataFrame:
    """``t(f | e)`` as rows ``(key.., e, f, p)``; each ``e`` sums to 1.

    ``min_p`` (default 0: exact) drops entries below it after every round; ``start`` is a table to go on from.
    """
    return learn(pairs, iters, null, min_p, src, trg, key, start, spans=False).table()


def learn(pairs: DataFrame, iters: int = 5, null: bool = True, min_p: float = 0.0, src="src_tokens", trg="trg_tokens",
          key: Sequence[str] = ("region",), start: DataFrame | None = None, spans: bool = True) -> Model:
    """The model of :func:`learn_lexicon` itself, for its table, counts, losses and (``spans``) alignments."""
    model = build(pairs, null, min_p, src, trg, key, start=start, spans=spans)
    for _ in range(iters):
        model.step()
    return model


@dataclass
class History:
    """``model`` after the last round, the ``epoch_log`` rows, and for each key the table of its best epoch."""

    model: Model
    log: DataFrame
    table: DataFrame
    sizes: DataFrame                 # key.., n, p2: rows of the table and Σp²


def learn_with_history(train: DataFrame, valid: DataFrame, max_epochs: int = 50, null: bool = True, src="src_tokens", trg="trg_tokens",
                       key: Sequence[str] = ("region",), start: DataFrame | None = None, ppl_limit: int = PPL_LIMIT, streak_limit: int = STREAK_LIMIT) -> History:
    """Learns until the stop rule fires for every key, or ``max_epochs`` is reached.

    After each epoch the losses of its table over ``train`` and ``valid`` are written to the history
    (``epoch_log(run, epoch, train_loss, valid_loss, start_ts, end_ts)``, a run a key, epochs from 0); the
    rules of :mod:`tandem.operators.epochs` are asked of it: later epochs of a run that has
    stopped are left out, and a run's table is that of its last ``is_best`` epoch. A run without
    held-out sentences has no valid loss: it never stops by it, and its last epoch is the best.
    """
    key = list(key)
    spark = train.sparkSession
    model = build(train, null, 0.0, src, trg, key, held=valid, start=start, spans=False)
    rows: list[tuple] = []
    snapshots: list[Model] = []
    schema = "run string, epoch long, train_loss double, valid_loss double, start_ts timestamp, end_ts timestamp"
    name = lambda r: "|".join("" if r[k] is None else str(r[k]) for k in key)
    while True:
        begin = datetime.now()
        model.step()
        snapshots.append(replace(model))
        rows += [(name(r), len(snapshots) - 1, r["train_loss"], r["valid_loss"], begin, datetime.now()) for r in model.losses()]
        log = spark.createDataFrame(rows, schema)  # a row a key and epoch
        stops = {r["run"]: r["stop_epoch"] for r in stop_epoch(log, ppl_limit=ppl_limit, streak_limit=streak_limit).collect()}
        if len(snapshots) >= max_epochs or all(v is not None for v in stops.values()):
            break
    kept = truncate_at_stop(log, ppl_limit=ppl_limit, streak_limit=streak_limit)
    chosen = best_so_far(kept).where(F.col("is_best") | F.col("valid_loss").isNull()).groupBy("run").agg(F.max("epoch").alias("epoch"))
    best: dict[int, list[str]] = {}
    for r in chosen.collect():
        best.setdefault(r["epoch"], []).append(r["run"])
    run = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key])
    table = sizes = None
    for epoch, runs in sorted(best.items()):
        part, size = (x.where(run.isin(runs)) for x in (snapshots[epoch].table(), snapshots[epoch].sizes_of_table()))
        table = part if table is None else table.unionByName(part)
        sizes = size if sizes is None else sizes.unionByName(size)
    return History(model, cut_lineage(kept, "epoch-log"), table if table is not None else model.table(), sizes if sizes is not None else model.sizes_of_table())


def sentence_nll(pairs: DataFrame, t: DataFrame, src="src_tokens", trg="trg_tokens",
                 key: Sequence[str] = ("region",), sid: str = "sid", null: bool = True,
                 broadcast_rows: int = T_BROADCAST_ROWS) -> DataFrame:
    """Mean ``-ln p(f)`` over the target tokens of each sentence, with
    ``p(f) = Σ_e t(f|e) / l`` (floored at ``P_FLOOR``) → ``(key.., sid, nll)``."""
    key = list(key)
    cells = cooccurrence(pairs, src, trg, key, sid, null)
    tb, _ = bounded_broadcast(t.select(*key, "e", "f", F.col("p").alias("tp")), broadcast_rows)
    j = cells.join(tb, key + ["e", "f"], "left").withColumn("tp", F.coalesce("tp", F.lit(0.0)))
    per_f = j.groupBy(*key, sid, "f").agg(
        (F.sum(F.col("ce") * F.col("tp")) / F.first("l")).alias("pf"), F.first("cf").alias("cf"))
    loss = -F.log(F.greatest(F.col("pf"), F.lit(P_FLOOR))) * F.col("cf")
    return per_f.groupBy(*key, sid).agg((F.sum(loss) / F.sum("cf")).alias("nll"))


def nll(pairs: DataFrame, t: DataFrame, key: Sequence[str] = ("region",), by: str = "sentence",
        batch: str = "batch", sid: str = "sid", **kw) -> DataFrame:
    """Loss with its perplexity.

    ``by="sentence"``: mean over sentences of the sentence loss (batches of one
    pair). ``by="batch"``: per batch (column ``batch`` of ``pairs``), the mean
    over all its target tokens, then the mean over batches.
    """
    key = list(key)
    s = sentence_nll(pairs, t, key=key, sid=sid, **kw)
    if by == "sentence":
        out = s.groupBy(*key).agg(F.avg("nll").alias("loss"))
    elif by == "batch":
        n = pairs.select(*key, sid, batch, F.size(kw.get("trg", "trg_tokens")).alias("_n"))
        b = s.join(n, key + [sid]).groupBy(*key, batch).agg(
            (F.sum(F.col("nll") * F.col("_n")) / F.sum("_n")).alias("_l"))
        out = b.groupBy(*key).agg(F.avg("_l").alias("loss"))
    else:
        raise ValueError(by)
    return out.withColumn("ppl", F.exp("loss"))


def align(pairs: DataFrame | None, model: Model, src="src_tokens", trg="trg_tokens", sid: str = "sid") -> DataFrame:
    """Soft alignment ``p(s_pos | t_pos) = t(f|e_s) / Σ_s' t(f|e_s')`` over whole sentences that the model knows.

    Each target position sums to 1 over the real source positions. Cells of probability 0 are not stored.
    ``pairs`` None: the cells ``(m, t_pos, s_pos, p)`` of the model's own distinct sentences, see :meth:`Model.alignments`.
    """
    rows = model.alignments(pairs, src, trg, sid)
    return rows.select(*([*model.key, sid] if pairs is not None else ["m"]), "t_pos", F.posexplode("p").alias("s_pos", "p")).where("p > 0").withColumn("s_pos", F.col("s_pos").cast("long"))


def alignment_mass(pairs: DataFrame | None, model: Model, src="src_tokens", trg="trg_tokens", sid: str = "sid") -> DataFrame:
    """``(sid, s_pos, mass)``: the sum of :func:`align` over the target positions, without its cells; positions without any are left out."""
    if pairs is None:
        return model.masses(None).select("m", F.posexplode("mass").alias("s_pos", "mass")).where("mass > 0").withColumn("s_pos", F.col("s_pos").cast("long"))
    rows = model.masses(pairs, src, trg, sid).select(sid, F.posexplode("mass").alias("s_pos", "mass")).where("mass > 0")
    return rows.groupBy(sid, F.col("s_pos").cast("long").alias("s_pos")).agg(F.sum("mass").alias("mass"))


def best_translations(t: DataFrame | Model, key: Sequence[str] = ("region",), digits: int = 6) -> DataFrame:
    """Arg-max target per source token (probability rounded to ``digits``,
    ties by token); one partial + final aggregate, so hot tokens are safe.
    A model finds them in its blocks, without its table."""
    key = list(key)
    if isinstance(t, Model):
        return t.best(digits).select(*key, "e", "best")
    best = t.groupBy(*key, "e").agg(
        F.min(F.struct((-F.round("p", digits)).alias("np"), F.col("f").alias("f"))).alias("_b"))
    return best.select(*key, "e", F.col("_b.f").alias("best"))


def translate(df: DataFrame, tokens, lexicon: DataFrame | Model, key: Sequence[str] = ("region",), sid: str = "sid",
              copy: bool = True, max_len: int | None = None, level: str = "word", out: str = "inference",
              broadcast_rows: int = T_BROADCAST_ROWS) -> DataFrame:
    """Replace every source token by its best target; an unknown token is
    copied (``copy``) or becomes ``<unk>``; re-joined in order.

    ``max_len`` (default: none) keeps at most that many output tokens, as a
    fixed-length decoder would.
    """
    key = list(key)
    best = cut_lineage(best_translations(lexicon, key))
    # one name for key and token; what has a missing key is in no table
    of = lambda e: F.concat(*[F.concat(F.hex(F.col(k).cast("string")), F.lit("\n")) for k in key], e)
    rows = df.select(F.struct(*key, sid).alias("_row"), F.coalesce(F.transform(as_col(tokens), lambda e: F.coalesce(of(e), F.concat(F.lit("-\n" * len(key)), e))),
                                                                 F.array().cast("array<string>")).alias("_w"))
    freq = rows.select(F.explode("_w").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("freq"))
    table = best.where(F.col("best").isNotNull()).select(of(F.col("e")).alias("name"), "best").join(freq, "name").select("name", "best", "freq")
    own = lambda t, p, row, c: pc.replace_substring_regex(t, f"^([-0-9A-F]*\n){{{len(key)}}}", "") if copy else pa.repeat(UNK, len(t))
    toks = looked_up(rows, "_w", table, "name", "best", own, "_row", "_toks", min(broadcast_rows, HEAD_ROWS))
    words = F.col("_toks") if max_len is None else F.slice("_toks", 1, max_len)
    return toks.select("_row.*", F.array_join(words, "" if level == "syl" else " ").alias(out))


def cut_at_special(c) -> object:
    """Cut text at the first '<' and strip it (unchanged when there is none)."""
    c = as_col(c)
    at = F.instr(c, "<")
    return F.when(at > 0, F.regexp_replace(F.substring(c, F.lit(1), at - 1), EDGE_SPACE, "")).otherwise(c)


def pivot_translate(df: DataFrame, tokens, lex1: DataFrame | Model, lex2: DataFrame | Model, key: Sequence[str] = ("region",),
                    sid: str = "sid", copy: bool = True) -> DataFrame:
    """dialect 1 → standard (cut at the first special) → dialect 2.

    Returns ``(key.., sid, middle, inference)``.
    """
    key = list(key)
    mid = translate(df, tokens, lex1, key, sid, copy=copy, out="middle")
    mid = cut_lineage(mid.withColumn("middle", cut_at_special("middle")), "middle", "zstd")     # read twice
    fin = translate(mid.withColumn("_w", words("middle")), "_w", lex2, key, sid, copy=copy)
    return mid.join(fin, key + [sid])


def _grid(products: int, rows: int, columns: int, at_least: int) -> tuple[int, int]:
    """(rows, columns) of a grid of about ``products / PRODUCT_ROWS_PER_TASK`` cells that sends the fewest entries: each of the first table goes to all columns, each of the second to all rows."""
    cells = max(at_least, -(-products // PRODUCT_ROWS_PER_TASK))
    wide = min(cells, max(1, round((cells * columns / max(1, rows)) ** 0.5)))
    return -(-cells // wide), wide


def _composed(lex1: DataFrame, lex2: DataFrame, key: list[str], min_p: float) -> DataFrame:
    """``(_g, key.., e, f, p)``: the product, each cell ``(e, f)`` in one cell ``_g`` of the grid, dealt by ``_g``."""
    spark = lex1.sparkSession
    a = lex1.select(*key, F.col("e").alias("d1"), F.col("f").alias("s"), F.col("p").alias("p1")).where(F.col("p1") >= min_p)
    b = lex2.select(*key, F.col("e").alias("s"), F.col("f").alias("d2"), F.col("p").alias("p2")).where(F.col("p2") >= min_p)
    a, b = cut_lineage(a, "compose-first", "zstd"), cut_lineage(b, "compose-second", "zstd")
    na = a.groupBy(*key, "s").agg(F.count(F.lit(1)).alias("na"))
    nb = b.groupBy(*key, "s").agg(F.count(F.lit(1)).alias("nb"))
    total = na.join(nb, key + ["s"]).agg(F.sum(F.col("na") * F.col("nb"))).first()[0] or 0
    high, wide = _grid(total, a.count(), b.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    row = F.pmod(F.xxhash64(*key, "d1"), F.lit(high))
    column = F.pmod(F.xxhash64(*key, "d2"), F.lit(wide))
    a = a.withColumn("_g", F.explode(F.transform(F.sequence(F.lit(0), F.lit(wide - 1)), lambda j: row * wide + j)))
    b = b.withColumn("_g", F.explode(F.transform(F.sequence(F.lit(0), F.lit(high - 1)), lambda i: i * wide + column)))
    n = high * wide
    j = a.repartition(n, "_g").join(b.repartition(n, "_g").hint("shuffle_hash"), ["_g", *key, "s"])
    return j.groupBy("_g", *key, F.col("d1").alias("e"), F.col("d2").alias("f")).agg(F.sum(F.col("p1") * F.col("p2")).alias("p"))


def compose_lexicons(lex1: DataFrame, lex2: DataFrame, key: Sequence[str] = ("region",), min_p: float = 0.0) -> DataFrame:
    """``p(d2 | d1) = Σ_s p(s | d1) · p(d2 | s)`` (triangulation through the
    pivot language): a sparse matrix product, written.

    The cells ``(d1, d2)`` are dealt over a grid, ``d1`` by rows and ``d2`` by columns, sized
    from the exact number of products (the joint counts of each pivot word). An
    entry of ``lex1`` goes to all cells of its row, one of ``lex2`` to all cells of its column; that is
    the only exchange. Products are joined and summed inside a cell, so neither a hot pivot
    word nor a hot ``d1`` or ``d2`` meets in one task, and no product is shuffled. ``min_p``
    (default 0: exact) prunes both inputs first.
    """
    key = list(key)
    with session_conf(lex1.sparkSession, **{"spark.sql.requireAllClusterKeysForCoPartition": "false"}):
        return cut_lineage(_composed(lex1, lex2, key, min_p).drop("_g"), "composed")


def composed_summary(lex1: DataFrame, lex2: DataFrame, key: Sequence[str] = ("region",), digits: int = 6,
                     min_p: float = 0.0) -> DataFrame:
    """Every ``d1``'s composed distribution in one row: its number of
    targets, Σp and Σp², and the arg-max target with its probability (rounded
    to ``digits``; ties by token). The product itself is not written."""
    key = list(key)
    best = F.min(F.struct((-F.round("p", digits)).alias("n"), F.col("f").alias("f"))).alias("b")
    with session_conf(lex1.sparkSession, **{"spark.sql.requireAllClusterKeysForCoPartition": "false"}):
        # one row a grid cell and word first, where the products are; these few are added up
        cells = _composed(lex1, lex2, key, min_p).groupBy("_g", *key, "e").agg(
            best, F.count(F.lit(1)).alias("targets"), F.sum("p").alias("sum_p"), F.sum(F.col("p") * F.col("p")).alias("sum_p2"))
        out = cut_lineage(cells.groupBy(*key, "e").agg(F.min("b").alias("b"), *[F.sum(c).alias(c) for c in ("targets", "sum_p", "sum_p2")]), "composed")
    return out.select(*key, "e", F.col("b.f").alias("f"), (-F.col("b.n")).alias("p"), "targets", "sum_p", "sum_p2")


def zip_pairs(a: DataFrame, b: DataFrame, order_a: str = "sid", order_b: str = "sid") -> DataFrame:
    """Positional pairing of two tables (stops at the shorter): equi-join on
    their dense indexes. Columns of ``b`` that clash get a ``b_`` prefix."""
    ia = dense_index(a, [order_a], name="idx")
    ib = dense_index(b, [order_b], name="idx")
    ib = ib.select("idx", *[F.col(c).alias(c if c not in a.columns else f"b_{c}") for c in b.columns])
    return ia.join(ib, "idx")


def pivot_pairs(p1: DataFrame, p2: DataFrame, on: str = "standard", order: str = "sid",
                d1: str = "dialect", d2: str = "dialect") -> DataFrame:
    """Every row of ``p1`` with a dialect-2 form of its standard sentence.

    ``p2`` gives one row per standard sentence, the one of lowest ``order``, so
    the result has exactly the rows of ``p1`` and no group of duplicates turns
    into all of its pairs. ``sid2`` and ``d2`` are NULL where ``p2`` lacks the
    sentence (a NULL sentence matches none). Swap the sides for the reverse.
    """
    a = p1.select(F.col(on).alias("standard"), F.col(order).alias("sid1"), F.col(d1).alias("d1"))
    first = p2.groupBy(F.col(on).alias("standard")).agg(
        F.min(F.struct(F.col(order).alias("sid2"), F.col(d2).alias("d2"))).alias("_first"))
    return a.join(first, "standard", "left").select("standard", "sid1", "d1", "_first.sid2", "_first.d2")


def copy_generate_mix(gen: DataFrame, copies: DataFrame, key: str = "sid", eps: float = P_FLOOR) -> DataFrame:
    """One softmax over generate scores and (position-summed) copy scores;
    p(token) = generate part + copy part; returns the top token per key with
    ``ln(p + eps)`` (ties by token). The softmax maximum and normaliser are
    partial + final aggregates joined back, so a large key is never one task."""
    c = copies.groupBy(key, "token").agg(F.sum("score").alias("score"))
    allsc = gen.select(key, "token", "score").unionByName(c)
    mx = allsc.groupBy(key).agg(F.max("score").alias("_m"))
    e = allsc.join(mx, key).withColumn("_x", F.exp(F.col("score") - F.col("_m")))
    z = e.groupBy(key).agg(F.sum("_x").alias("_z"))
    per = e.join(z, key).groupBy(key, "token").agg(
        F.log(F.sum(F.col("_x") / F.col("_z")) + F.lit(eps)).alias("logp"))
    best = per.groupBy(key).agg(F.min(F.struct((-F.round("logp", 6)).alias("n"), F.col("token").alias("t"),
                                              F.col("logp").alias("lp"))).alias("_b"))
    return best.select(key, F.col("_b.t").alias("token"), F.col("_b.lp").alias("logp"))


def selective_read(copies: DataFrame, vectors: DataFrame, chosen: DataFrame, key: str = "sid",
                   floor: float = 1e-12) -> DataFrame:
    """Weighted sum of position vectors: weight = copy score of the chosen
    token at that position, L1-normalised (floor ``floor``), zero elsewhere.
    ``vectors(key, pos, dim, x)`` are cells → ``(key, dim, value)``; ``vectors(key, dim, xs)`` hold
    the cells of all positions in one array, and only the positions with a weight are read."""
    sel = copies.join(chosen.select(key, "token"), [key, "token"])
    norm = sel.groupBy(key).agg(F.greatest(F.sum(F.abs("score")), F.lit(floor)).alias("_z"))
    wts = sel.join(norm, key).select(key, "pos", (F.col("score") / F.col("_z")).alias("w")) \
        .groupBy(key, "pos").agg(F.sum("w").alias("w"))
    if "xs" in vectors.columns:
        at = wts.groupBy(key).agg(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "w")).alias("_w"))
        j = vectors.select(key, "dim", "xs").join(at, key, "left")
        read = F.aggregate("_w", F.lit(0.0), lambda a, x: a + F.coalesce(x["w"] * F.get("xs", x["pos"]), F.lit(0.0)))
        return j.select(key, "dim", F.coalesce(read, F.lit(0.0)).alias("v")).groupBy(key, "dim").agg(F.sum("v").alias("value"))
    j = vectors.select(key, "pos", "dim", "x").join(wts, [key, "pos"], "left")
    return j.groupBy(key, "dim").agg(F.sum(F.coalesce("w", F.lit(0.0)) * F.col("x")).alias("value"))
