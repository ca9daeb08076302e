import pytest
from pyspark.sql import functions as F

from tandem.operators import lookup, vocab
from tandem.operators.evaluate import ngram_matches, sentence_bleu
from tandem.operators.vocab import decode, decode_extended, encode, encode_extended, vocab_first_seen

ROWS = [(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["zz", "c", None, "a"]), (5, ["a"]), (5, ["c", "b"]), (None, ["c"]), (6, ["<unk>", "a"])]
VOCAB = [("<unk>", 0, 0), ("a", 4, 9), ("b", 5, 3), ("c", 6, 1), ("<unk>", 7, 2)]
IDS = {1: [5, 4, 5], 2: [], 3: [], 4: [0, 6, 0, 4], 5: [4, 6, 5], None: [6], 6: [0, 7, 4]}   # rows of a key are merged by position, a doubled token gives both ids


def _frames(spark):
    df = spark.createDataFrame(ROWS, "sid long, w array<string>")
    return df, spark.createDataFrame(VOCAB, "token string, id int, freq long")


@pytest.mark.parametrize("bound", [0, 1, 2, 100])
def test_lookup_is_the_same_for_any_number_of_frequent_entries(spark, bound):
    df, v = _frames(spark)
    got = {r["sid"]: r["ids"] for r in encode(df, "w", v, sos=False, eos=False, vocab_bound=bound).collect()}
    assert got == IDS
    ids = spark.createDataFrame([(1, [4, 99, 6]), (2, None), (3, [0])], "sid long, ids array<int>")
    v1 = v.where("id != 7")
    assert {r["sid"]: r["tokens"] for r in decode(ids, "ids", v1, vocab_bound=bound).collect()} == {1: ["a", "<unk>", "c"], 2: [], 3: ["<unk>"]}
    p = spark.createDataFrame([(1, ["x", "a", "x", "y"], ["a", "y", "q", "x"])], "sid long, i array<string>, o array<string>")
    assert encode_extended(p, "i", v1, 10, vocab_bound=bound).first()["ids"] == [10, 4, 12, 13]
    assert encode_extended(p, "o", v1, 10, input_tokens="i", missing_id=3, vocab_bound=bound).first()["ids"] == [4, 13, 3, 10]
    e = p.select("sid", "i", F.array(*map(F.lit, (4, 13, 5, 88, 8))).alias("ids"))
    assert decode_extended(e, "ids", v1, 10, input_tokens="i", vocab_bound=bound).first()["text"] == "a y b <???> <unk>"
    assert decode_extended(e, "ids", v1, 10, vocab_bound=bound).first()["text"] == "a <???> b <???> <unk>"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_known_tokens_are_not_taken_apart(spark):
    df, v = _frames(spark)
    assert "Generate" not in _plan(encode(df, "w", v.where("token != '<unk>'"), vocab_bound=100))


def test_first_places_need_no_sort_of_occurrences(spark):
    df = spark.createDataFrame([(3, ["b", "a"]), (1, ["a", "c", "a"]), (None, ["z"]), (-5, ["y", "c"]), (1, ["d"])], "sid long, w array<string>")
    got = [(r["token"], r["id"], r["freq"]) for r in vocab_first_seen(df, "w").where("id >= 4").orderBy("id").collect()]
    assert got[:3] == [("z", 4, 1), ("y", 5, 1), ("c", 6, 2)] and {got[3][0], got[4][0]} == {"a", "d"} and got[5] == ("b", 9, 1)
    named = df.select(F.col("sid").cast("string").alias("sid"), "w")
    assert [r["token"] for r in vocab_first_seen(named, "w").where("id >= 4").orderBy("id").collect()][0] == "z"
    assert "Generate" not in _plan(vocab._seen(df, "w", "sid"))


def test_first_places_of_rows_that_share_a_key(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (1, ["d", "e"]), (1, ["f", "c"]), (0, ["g", None])], "sid long, w array<string>")
    got = {r["token"]: ((r["_f"]["k"], r["_f"]["p"]), r["freq"]) for r in vocab._seen(df.coalesce(1), "w", "sid").collect()}
    assert got == {"a": ((1, 0), 1), "b": ((1, 1), 1), "c": ((1, 1), 2), "d": ((1, 0), 1), "e": ((1, 1), 1), "f": ((1, 0), 1), "g": ((0, 0), 1), None: ((0, 1), 1)}


def test_frequent_entries_are_chosen_by_count(spark):
    known = spark.createDataFrame([("a", 9), ("b", 3), ("c", 3), ("d", 1)], "token string, freq long")
    assert [lookup.head_bound(known, n) for n in (0, 1, 2, 3, 4)] == [None, 9, 9, 3, 1]


def test_ngrams_of_rows_with_a_key_of_their_own_are_not_exchanged(spark):
    rows = [(1, ["a", "b", "a", "b"], ["a", "b", "c"]), (2, [], ["a"]), (3, None, ["x"]), (4, ["q"], []), (5, ["a", "b"], ["a", "b"]), (5, ["b"], ["c"]), (None, ["a"], ["a"])]
    df = spark.createDataFrame(rows, "sid long, hyp_tokens array<string>, ref_tokens array<string>")
    got = sorted(((r["sid"] or 0, r["n"], r["matches"], r["total"]) for r in ngram_matches(df, max_n=2).collect()))
    assert got == sorted([(1, 1, 2, 4), (1, 2, 1, 3), (2, 1, 0, 0), (2, 2, 0, 0), (3, 1, 0, 0), (3, 2, 0, 0), (4, 1, 0, 1), (4, 2, 0, 0),
                          *[(5, 1, 2, 3), (5, 2, 1, 1)] * 2, (0, 1, 0, 0), (0, 2, 0, 0)])
    alone = df.where("sid < 5")
    assert "Exchange" not in _plan(ngram_matches(alone))
    assert [r["bleu1"] for r in sentence_bleu(alone).orderBy("sid").collect()] == [0.5, 0.0, 0.0, 0.0]


def test_rows_with_a_key_of_their_own_are_neither_sorted_nor_gathered(spark):
    df, v = _frames(spark)
    alone = df.where("sid not in (3, 5)")
    for bound in (1, 100):      # with rarer entries beside the workers', and without
        got = encode(alone, "w", v, sos=False, eos=False, vocab_bound=bound)
        assert {r["sid"]: r["ids"] for r in got.collect()} == {k: IDS[k] for k in (1, 2, 4, 6)}
        # the rows reach their output by the side of a hashed join that is streamed: no aggregate and no sort holds them
        plan = _plan(got)
        assert "collect_list(_v" not in plan and "SortMergeJoin [sid" not in plan
    assert "ShuffledHashJoin [sid" in _plan(encode(alone, "w", v, vocab_bound=1))
    assert "Exchange" not in _plan(encode(alone, "w", v.where("token != '<unk>'"), vocab_bound=100))


def test_places_of_many_small_batches(spark):
    import pyarrow as pa

    rows = [(5, ["x", "y", "x"]), (2, ["y", None, "q"]), (None, ["x"]), (9, []), (3, None)]
    whole = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([w for _, w in rows], pa.list_(pa.string()))], names=["k", "_t"])
    parts = [whole.slice(i, 1) for i in range(len(rows))]
    assert [b.num_rows for b in lookup.joined_batches(iter(parts), 100, 4)] == [2, 3]
    got = {r["token"]: (r["k"], r["p"], r["n"]) for b in vocab._firsts(iter(parts)) for r in b.to_pylist()}
    assert got == {"x": (None, 0, 3), "y": (2, 0, 2), None: (2, 1, 1), "q": (2, 2, 1)}


def test_rows_are_not_exchanged_for_their_rarer_elements(spark):
    df, v = _frames(spark)
    alone = df.where("sid not in (3, 5)")
    plan = _plan(encode(alone, "w", v, vocab_bound=1))
    assert "hashpartitioning(sid#" not in plan and "hashpartitioning(sid_block" in plan     # values go to the blocks of rows


def test_blocks_of_few_elements_give_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr(lookup, "BLOCK_ELEMENTS", 2)
    df, v = _frames(spark)
    got = {r["sid"]: r["ids"] for r in encode(df.coalesce(1), "w", v, sos=False, eos=False, vocab_bound=1).collect()}
    assert got == IDS


def test_least_places_of_many_batches_are_put_together(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(vocab, "SEEN_ROWS", 1)
    monkeypatch.setattr(vocab, "SEEN_TOKENS", 1)
    rows = [(5, ["x", "y", "x"]), (2, ["y", None, "q"]), (None, ["x"]), (2, ["q", "z"]), (7, ["x"])]
    whole = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([w for _, w in rows], pa.list_(pa.string()))], names=["k", "_t"])
    for held, n in ((100, 5), (2, None)):
        monkeypatch.setattr(vocab, "HELD_TOKENS", held)
        out = [r for b in vocab._gathered(whole.slice(i, 1) for i in range(len(rows))) for r in b.to_pylist()]
        assert sum(r["n"] for r in out) == 10 and (n is None or len(out) == n)
    assert {r["token"]: (r["k"], r["p"]) for r in out if r["token"] != "x"} == {"y": (2, 0), None: (2, 1), "q": (2, 0), "z": (2, 1)}
    df = spark.createDataFrame(rows, "sid long, w array<string>")
    seen = vocab._seen(df, "w", "sid")
    assert "SortAggregate" not in _plan(seen)
    assert {r["token"]: ((r["_f"]["k"], r["_f"]["p"]), r["freq"]) for r in seen.collect()} == {
        "x": ((None, 0), 4), "y": ((2, 0), 2), None: ((2, 1), 1), "q": ((2, 0), 2), "z": ((2, 1), 1)}
