import math

import pytest
from pyspark.sql import functions as F

from tandem.functions.text import words
from tandem.operators import em
from tandem.operators.lexicon import (align, alignment_mass, best_translations, compose_lexicons, learn, learn_lexicon, learn_with_history, nll,
                                      pivot_pairs, selective_read, sentence_nll, translate, zip_pairs)


def _pairs(spark, rows):
    return spark.createDataFrame([("r", i, s, t) for i, (s, t) in enumerate(rows)],
                                 "region string, sid long, s string, t string").select(
        "region", "sid", words("s").alias("src_tokens"), words("t").alias("trg_tokens"))


def test_learn_lexicon_one_round_golden(spark):
    p = _pairs(spark, [("a b", "x y"), ("a", "x")])
    t = {(r.e, r.f): r.p for r in learn_lexicon(p, iters=1, null=False).collect()}
    assert t == pytest.approx({("a", "x"): .75, ("a", "y"): .25, ("b", "x"): .5, ("b", "y"): .5})
    one = _pairs(spark, [("a", "x")])
    n = nll(one, learn_lexicon(p, iters=1, null=False), null=False).first()
    assert n.loss == pytest.approx(0.287682, abs=1e-6) and n.ppl == pytest.approx(4 / 3, abs=1e-6)


def test_em_invariants(spark):
    rows = [("a b c", "x y z"), ("a b", "x y"), ("b c", "y z"), ("a", "x"), ("c a", "z x")]
    p = _pairs(spark, rows)
    prev = None
    for it in (1, 2, 3):
        t = learn_lexicon(p, iters=it)
        sums = t.groupBy("e").agg(F.sum("p").alias("s")).collect()
        assert all(abs(r.s - 1) < 1e-9 for r in sums)
        loss = sentence_nll(p, t).agg(F.sum("nll")).first()[0]
        if prev is not None:
            assert loss <= prev + 1e-12
        prev = loss
    a = align(p, learn(p, iters=3))
    per = a.groupBy("sid", "t_pos").agg(F.sum("p").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in per)


def test_translate_copy_and_unk(spark):
    p = _pairs(spark, [("a b", "x y"), ("a", "x"), ("b", "y")])
    t = learn_lexicon(p, iters=3, null=False)
    df = spark.createDataFrame([("r", 0, "a q b"), ("r", 1, "")], "region string, sid long, s string") \
        .select("region", "sid", words("s").alias("w"))
    out = {r.sid: r.inference for r in translate(df, "w", t).collect()}
    assert out == {0: "x q y", 1: ""}
    out2 = {r.sid: r.inference for r in translate(df, "w", t, copy=False, max_len=2).collect()}
    assert out2[0] == "x <unk>"


def test_compose_is_a_distribution(spark):
    p1 = _pairs(spark, [("a b", "x y"), ("a", "x")])
    p2 = _pairs(spark, [("x y", "m n"), ("y", "n")])
    c = compose_lexicons(learn_lexicon(p1, 2, null=False), learn_lexicon(p2, 2, null=False))
    assert all(abs(r.s - 1) < 1e-9 for r in c.groupBy("e").agg(F.sum("p").alias("s")).collect())


def test_compose_on_a_grid_of_any_shape(spark, monkeypatch):
    """The sum over pivot words, with hot words on every side; each product is made in one cell of the grid."""
    from tandem.operators import lexicon

    rows = [("x", f"a{i}", f"s{j}", 1.0 / (i + j + 1)) for i in range(12) for j in range(9) if (i * j) % 3 or not i or not j]
    cols = [("x", f"s{j}", f"b{k}", 1.0 / (j + 2 * k + 1)) for j in range(9) for k in range(15) if (j + k) % 2 or not k] + [("y", "s1", "b1", 1.0)]
    want = {}
    for _, e, s, p in rows:
        for r, t, f, q in cols:
            if r == "x" and s == t:
                want[e, f] = want.get((e, f), 0.0) + p * q
    make = lambda x: spark.createDataFrame(x, "region string, e string, f string, p double")
    for per_task in (2_000_000, 40, 7):
        monkeypatch.setattr(lexicon, "PRODUCT_ROWS_PER_TASK", per_task)
        got = {(r.e, r.f): r.p for r in compose_lexicons(make(rows), make(cols)).collect()}
        assert got == pytest.approx(want)
        total = {r.e: (r.targets, r.sum_p) for r in lexicon.composed_summary(make(rows), make(cols)).collect()}
        assert total == {e: (sum(k[0] == e for k in want), pytest.approx(sum(v for k, v in want.items() if k[0] == e))) for e in {k[0] for k in want}}
    assert compose_lexicons(make(rows), make(cols).limit(0)).count() == 0


def test_pivot_and_zip(spark):
    a = spark.createDataFrame([("s", 1, "d1"), ("s", 5, "d2"), ("u", 2, "d3")], "standard string, sid long, dialect string")
    b = spark.createDataFrame([("s", 3, "e1"), ("s", 4, "e2"), ("s", 9, "e3")], "standard string, sid long, dialect string")
    out = sorted((r.sid1, r.sid2, r.d2) for r in pivot_pairs(a, b).collect())
    assert out == [(1, 3, "e1"), (2, None, None), (5, 3, "e1")]
    z = sorted((r.idx, r.sid, r.b_sid) for r in zip_pairs(a.select("sid"), b.select("sid")).collect())
    assert z == [(0, 1, 3), (1, 2, 4), (2, 5, 9)]


def test_nll_by_batch(spark):
    p = _pairs(spark, [("a b", "x y"), ("a", "x")])
    t = learn_lexicon(p, iters=1, null=False)
    pb = p.withColumn("batch", F.lit(0))
    by_s = nll(p, t, null=False).first().loss
    by_b = nll(pb, t, by="batch", null=False).first().loss
    per = {r.sid: r.nll for r in sentence_nll(p, t, null=False).collect()}
    assert by_s == pytest.approx((per[0] + per[1]) / 2)
    assert by_b == pytest.approx((per[0] * 2 + per[1] * 1) / 3)


def _brute(rows, held, rounds, start=None, null=True):
    """(table, history of (train loss, valid loss)) of (region, source words, target words) rows in plain Python."""
    def side(r, s):
        return ([(r, "<null>")] if null else []) + [(r, w) for w in s]

    t, log = start, []
    for _ in range(rounds):
        c = {}
        for r, s, f_side in rows:
            e_side = side(r, s)
            for f in f_side:
                got = [1.0 / len(e_side) if t is None else t.get((e, f), 0.0) for e in e_side]
                if t is start and t is not None and sum(got) <= 0:
                    got = [1.0 / len(e_side)] * len(e_side)
                for e, v in zip(e_side, got):
                    c[e, f] = c.get((e, f), 0.0) + (v / sum(got) if sum(got) > 0 else 0.0)
        z = {}
        for (e, _), v in c.items():
            z[e] = z.get(e, 0.0) + v
        t = {(e, f): v / z[e] if z[e] > 0 else 0.0 for (e, f), v in c.items()}
        loss = lambda part: {k: sum(x) / len(x) for k, x in _by_region(part, t, side).items()}  # noqa: E731, B023
        log.append((loss(rows), loss(held)))
    return t, log


def _by_region(part, t, side):
    out = {}
    for r, s, f_side in part:
        e_side = side(r, s)
        if f_side and e_side:
            out.setdefault(r, []).append(sum(-math.log(max(sum(t.get((e, f), 0.0) for e in e_side) / len(e_side), 1e-10)) for f in f_side) / len(f_side))
    return out


def _corpus(seed=3, n=120):
    import random

    rng = random.Random(seed)
    words_of = {"x": "abcdefghij", "y": "klmno"}
    rows = []
    for _ in range(n):
        r = rng.choice("xy")
        s = [rng.choice(words_of[r]) for _ in range(rng.choice((0, 1, 3, 6, 40)))]
        rows.append((r, s, [w.upper() for w in s if rng.random() < .9] + ["the"] * rng.choice((0, 1, 2))))
    return rows + rows[:30] + [("x", [], []), ("y", ["k"], [])]


def _frame(spark, rows):
    return spark.createDataFrame([(r, i, s, t) for i, (r, s, t) in enumerate(rows)],
                                 "region string, sid long, src_tokens array<string>, trg_tokens array<string>")


def _close(got, want):
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


SIZES = {"usual": {}, "many blocks, all words split, totals joined": {"BLOCK_CELLS": 60, "HOT_CELLS": 90, "TASK_CELLS": 500, "LOOKUP_ROWS": 0}}


@pytest.mark.parametrize("size", SIZES)
def test_learning_equals_plain_python(spark, monkeypatch, size):
    """Whole sentences, held-out ones, repeats, empty sides and hot words; with any blocks."""
    for k, v in SIZES[size].items():
        monkeypatch.setattr(em, k, v)
    rows, held = _corpus(), _corpus(4, 30)
    model = em.build(_frame(spark, rows), held=_frame(spark, held))
    assert model.hot == bool(SIZES[size])
    log = []
    for _ in range(3):
        model.step()
        log.append({r["region"]: (r["train_loss"], r["valid_loss"]) for r in model.losses()})
    want, history = _brute(rows, held, 3)
    got = {((r.region, r.e), r.f): r.p for r in model.table().collect()}
    _close({k: v for k, v in got.items() if v > 0}, {k: v for k, v in want.items() if v > 0})
    for have, (train, valid) in zip(log, history, strict=True):
        _close({k: v[0] for k, v in have.items()}, train)
        _close({k: v[1] for k, v in have.items()}, valid)
    counts = model.counts()
    again = {((r.region, r.e), r.f): r.p for r in em.table_of(counts).collect()}
    _close(again, got)
    twice = em.table_of(em.merge_counts(counts, counts))
    _close({((r.region, r.e), r.f): r.p for r in twice.collect()}, got)


def test_learning_goes_on_from_a_table(spark):
    """Words the table doesn't know start from the constant table where nothing explains them."""
    rows, more = _corpus(), [*_corpus(5, 40), ("x", ["new", "a"], ["NEW", "A"]), ("z", ["q"], ["Q"])]
    first, _ = _brute(rows, [], 2)
    want, _ = _brute(more, [], 2, first)
    got = learn_lexicon(_frame(spark, more), iters=2, start=learn_lexicon(_frame(spark, rows), iters=2))
    got = {((r.region, r.e), r.f): r.p for r in got.collect()}
    _close({k: v for k, v in got.items() if v > 0}, {k: v for k, v in want.items() if v > 0})


def test_alignment_spans_the_sentence(spark):
    rows = _corpus()
    t, _ = _brute(rows, [], 3)
    got = {(r.sid, r.t_pos, r.s_pos): r.p for r in align(_frame(spark, rows), learn(_frame(spark, rows), iters=3)).collect()}
    want = {}
    for i, (r, s, f_side) in enumerate(rows):
        for tp, f in enumerate(f_side):
            z = sum(t.get(((r, e), f), 0.0) for e in s)
            want |= {(i, tp, sp): t[(r, e), f] / z for sp, e in enumerate(s) if z > 0 and t.get(((r, e), f), 0.0) > 0}
    _close(got, want)
    assert max(k[2] for k in got) == 39


def test_history_stops_and_keeps_the_best_table(spark):
    """The losses are real, the stop rule ends the loop, and each region has the table of its own best epoch."""
    rows, held = _corpus(), _corpus(9, 40)
    _, log = _brute(rows, held, 6)
    h = learn_with_history(_frame(spark, rows), _frame(spark, held), max_epochs=6)
    got = {(r.run, r.epoch): (r.train_loss, r.valid_loss) for r in h.log.collect()}
    assert all(got[r, i] == (pytest.approx(log[i][0][r]), pytest.approx(log[i][1][r])) for r, i in got) and len(got) == 12
    table = {((r.region, r.e), r.f): r.p for r in h.table.collect()}
    for region in "xy":
        losses = [v[region] for _, v in log]
        best = max(i for i in range(6) if i == 0 or losses[i] < min(losses[:i]))
        want, _ = _brute(rows, held, best + 1)
        _close({k: v for k, v in table.items() if k[0][0] == region and v > 0}, {k: v for k, v in want.items() if k[0][0] == region and v > 0})
    strict = learn_with_history(_frame(spark, rows), _frame(spark, held), max_epochs=6, ppl_limit=0)
    assert {(r.run, r.epoch) for r in strict.log.collect()} == {("x", 0), ("y", 0)}


def test_no_exchange_of_cells_in_a_round(spark, monkeypatch):
    monkeypatch.setattr(em, "LOOKUP_ROWS", 0)
    model = learn(_frame(spark, _corpus()), iters=1)
    src, _ = model._joined(model.state)
    lines = src._jdf.queryExecution().executedPlan().toString().splitlines()
    exchanges = [line for line in lines if "Exchange" in line and "cell_pair" in line]
    assert not exchanges and any("Bucketed: true" in line and "cell_pair" in line for line in lines)


def test_aligned_positions_are_added_up_without_a_sort(spark):
    from tandem.plans.catalog import _aligned

    rows = [("a", (1, 0), 0, 3, 0.4), ("a", (1, 0), 0, 1, 0.4000001), ("a", (1, 0), 0, 7, 0.2), ("a", (1, 0), 1, 0, 1.0), (None, (1, None), 0, 2, 1e-9), (None, (1, None), 0, 5, 0.123456)]
    got = _aligned(spark.createDataFrame(rows, "region string, sid struct<sid:long,sent:long>, t_pos long, s_pos long, p double"))
    assert sorted((r["region"] or "", r["t_pos"], r["sources"], round(r["sum_p"], 6), r["s_pos"], r["p"]) for r in got.collect()) == [
        ("", 0, 2, 0.123456, 5, 0.123456), ("a", 0, 3, 1.0, 1, 0.4), ("a", 1, 1, 1.0, 0, 1.0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("size", SIZES)
def test_model_gives_best_masses_and_sizes_without_its_table(spark, monkeypatch, size):
    """The same as from the named table and the long alignment, ties and words split over blocks included."""
    rows = [*_corpus(), *[("x", [f"s{i}"], ["t2", "t1"]) for i in range(3)], (None, ["n"], ["m"])]
    pairs = _frame(spark, rows)
    for k, v in SIZES[size].items():
        monkeypatch.setattr(em, k, v)
    model = learn(pairs, iters=2)
    table = model.table()
    want = {(r.region, r.e): r.best for r in best_translations(table).collect()}
    assert {(r.region, r.e): r.best for r in best_translations(model).collect()} == want and want["x", "s0"] == "t1"
    top = {(r.region, r.e): r.p for r in table.groupBy("region", "e").agg(F.round(F.max("p"), 6).alias("p")).collect()}
    assert {(r.region, r.e): r.p for r in model.best().collect()} == pytest.approx(top)
    sizes = {r.region: (r.n, r.s) for r in table.groupBy("region").agg(F.count("*").alias("n"), F.sum(F.col("p") * F.col("p")).alias("s")).collect()}
    got = {r.region: (r.n, r.p2) for r in model.sizes_of_table().collect()}
    assert got.keys() == sizes.keys() and all(got[k] == pytest.approx(sizes[k]) for k in got)
    cells = align(pairs, model)
    mass = {(r.sid, r.s_pos): r.m for r in cells.groupBy("sid", "s_pos").agg(F.sum("p").alias("m")).collect()}
    assert {(r.sid, r.s_pos): r.mass for r in alignment_mass(pairs, model).collect()} == pytest.approx(mass)


def test_selective_read_of_whole_rows_equals_that_of_cells(spark):
    copies = spark.createDataFrame([(1, 0, "a", 2.0), (1, 2, "a", -1.0), (1, 1, "b", 3.0), (2, 0, "c", 1.0)], "sid long, pos long, token string, score double")
    chosen = spark.createDataFrame([(1, "a"), (2, "z")], "sid long, token string")
    rows = spark.createDataFrame([(1, 0, [0.5, 0.25, 0.25]), (1, 1, [0.0, 0.0, 1.0]), (1, 1, [1.0, 0.0, 0.0]), (2, 0, [1.0])], "sid long, dim long, xs array<double>")
    cells = rows.select("sid", "dim", F.posexplode("xs").alias("pos", "x")).withColumn("pos", F.col("pos").cast("long"))
    got, want = ({(r.sid, r.dim): r.value for r in selective_read(copies, v, chosen).collect()} for v in (rows, cells))
    assert got == pytest.approx(want) and got[2, 0] == 0


def test_packed_arrays_come_back(spark):
    import numpy as np
    import pyarrow as pa

    arrays = [np.array([], "<i8"), np.array([-5, 1 << 60, 7], "<i8"), np.arange(1000, dtype="<i4"), np.array([0.1, -1e300], "<f8")]
    got = em._unpack(pa.scalar(em._pack(*arrays)), ("<i8", "<i8", "<i4", "<f8"))
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, got, strict=True))
    assert (em._whole(em._steps(arrays[1])) == arrays[1]).all()


def _disk(path):
    import os

    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_rounds_leave_totals_and_no_counts(spark):
    """What a round leaves on disk grows with the words, not with the pairs; the pairs' text and what was exchanged are gone."""
    import os
    import random

    from tandem.session import checkpoint_root

    root = checkpoint_root(spark)
    before = set(os.listdir(root))
    rng = random.Random(1)
    rows = [("x", [f"a{rng.randrange(300)}" for _ in range(60)], [f"b{rng.randrange(300)}" for _ in range(60)]) for _ in range(200)]
    model = learn(_frame(spark, rows), iters=3, spans=False)
    made = {n: _disk(f"{root}/{n}") for n in set(os.listdir(root)) - before}
    pairs = model.table().count()
    assert pairs > 80_000
    states = [v for k, v in made.items() if "em-state" in k]
    assert len(states) == 3 and max(states) < 2 * pairs
    assert sum(v for k, v in made.items() if "em-blocks" in k) < 5 * 60 * 60 * 200     # bytes a cell
    assert not any(k.startswith("tandem-em-pairs") or k.startswith("tandem-em-tokens") for k in made)
    with pytest.raises(ValueError):
        model.alignments(None)


@pytest.mark.parametrize("size", SIZES)
def test_distinct_sentences_are_aligned_once(spark, monkeypatch, size):
    """The model's own sentences give the alignment of all pairs that are them, and no cell is exchanged for it."""
    for k, v in SIZES[size].items():
        monkeypatch.setattr(em, k, v)
    pairs = _frame(spark, _corpus())
    model = learn(pairs, iters=2)
    links = align(None, model)
    known = model.known(pairs)
    got = {(r.sid, r.t_pos, r.s_pos): r.p for r in links.join(known, "m").collect()}
    _close(got, {(r.sid, r.t_pos, r.s_pos): r.p for r in align(pairs, model).collect()})
    assert links.select("m").distinct().count() < known.count()
    if not size.startswith("many"):
        assert "Exchange" not in links._jdf.queryExecution().executedPlan().toString()
    mass = {(r.sid, r.s_pos): r.mass for r in alignment_mass(None, model).join(known, "m").collect()}
    assert mass == pytest.approx({(r.sid, r.s_pos): r.mass for r in alignment_mass(pairs, model).collect()})


def test_translated_rows_are_looked_up_whole(spark):
    """Missing and empty keys, repeated rows, words that look like names; occurrences are not dealt out with their sentences."""
    t = spark.createDataFrame([("", "a", "A0", 1.0), ("r", "a", "A1", 0.5), ("r", "a", "A2", 0.5), ("r", "-", "dash", 1.0), (None, "a", "never", 1.0)],
                              "region string, e string, f string, p double")
    df = spark.createDataFrame([("r", 1, ["a", "b", "a"]), ("", 1, ["a"]), (None, 2, ["a", "-"]), ("r", 3, None), ("r", 4, [None, "72", "-"]), ("r", 5, ["a"]), ("r", 5, ["x", "y"])],
                               "region string, sid long, w array<string>")
    out = translate(df, "w", t)
    assert {(r.region, r.sid): r.inference for r in out.collect()} == {
        ("r", 1): "A1 b A1", ("", 1): "A0", (None, 2): "a -", ("r", 3): "", ("r", 4): "72 dash", ("r", 5): "A1 x y"}
    assert {r.inference for r in translate(df.where("sid = 1"), "w", t, copy=False, max_len=2).collect()} == {"A1 <unk>", "A0"}
    plan = translate(df.where("sid < 5"), "w", t)._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange" in line and "_k" in line for line in plan.splitlines())


def test_many_parts_are_dealt_in_groups(spark, monkeypatch):
    rows = _corpus()
    want = {((r.region, r.e), r.f): r.p for r in learn_lexicon(_frame(spark, rows), iters=2).collect()}
    for k, v in (SIZES["many blocks, all words split, totals joined"] | {"GROUP_CELLS": 1000, "GROUPS": 3}).items():
        monkeypatch.setattr(em, k, v)
    model = learn(_frame(spark, rows), iters=2)
    assert model.buckets > 3
    _close({((r.region, r.e), r.f): r.p for r in model.table().collect()}, want)
    model.forget()
    assert not any(_disk(f.removeprefix("file:").rpartition("/")[0]) for f in model.blocks.inputFiles())


def test_sentences_that_come_twice_are_aligned_together(spark, tmp_dir):
    """A line that comes twice has one row a target position, with the cells of both."""
    from tandem.plans.catalog import q_align

    made = {}
    for name, n in (("once", 1), ("twice", 2)):
        spark.createDataFrame([(1, "en", "quick the fox. the dog")] * n, "doc_id long, lang string, text string").write.parquet(f"{tmp_dir}/{name}/documents.parquet")
        made[name] = {(r.sid, r.sent, r.t_pos): (r.sources, r.sum_p, r.s_pos, r.p) for r in q_align(spark, f"{tmp_dir}/{name}").collect()}
    assert len(made["once"]) == 5
    assert made["twice"] == {k: (2 * v[0], pytest.approx(2 * v[1], abs=2e-6), *v[2:]) for k, v in made["once"].items()}
