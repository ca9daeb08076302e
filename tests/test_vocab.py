from pyspark.sql import functions as F

from tandem.functions import arrays as A
from tandem.functions.text import words
from tandem.operators import vocab as W
from tandem.operators.vocab import (decode, decode_extended, encode, encode_extended, shared_vocab, top_tokens,
                                    vocab_by_freq, vocab_first_seen)


def _corpus(spark):
    return spark.createDataFrame([(0, "나 너 나"), (1, "그 너")], "sid long, t string").select("sid", words("t").alias("w"))


def test_vocab_first_seen_golden(spark):
    v = {r.token: (r.id, r.freq) for r in vocab_first_seen(_corpus(spark), "w").collect()}
    assert v == {"<unk>": (0, 0), "<pad>": (1, 0), "<sos>": (2, 0), "<eos>": (3, 0),
                 "나": (4, 2), "너": (5, 2), "그": (6, 1)}


def test_encode_decode_golden(spark):
    v = vocab_first_seen(_corpus(spark), "w")
    df = spark.createDataFrame([(9, "너 모"), (10, "")], "sid long, t string").select("sid", words("t").alias("w"))
    e = {r.sid: r.ids for r in encode(df, "w", v).collect()}
    assert e == {9: [2, 5, 0, 3], 10: [2, 3]}
    d = {r.sid: r.tokens for r in decode(encode(df, "w", v), "ids", v).collect()}
    assert d[9] == ["<sos>", "너", "<unk>", "<eos>"]


def test_decode_encode_roundtrip_known_tokens(spark):
    c = _corpus(spark)
    v = vocab_first_seen(c, "w")
    back = {r.sid: r.tokens for r in decode(encode(c, "w", v, sos=False, eos=False), "ids", v).collect()}
    assert back == {r.sid: r.w for r in c.collect()}


def test_vocab_by_freq_and_top(spark):
    df = spark.createDataFrame([(0, "b a b c"), (1, "a b")], "sid long, t string").select("sid", words("t").alias("w"))
    v = {r.token: r.id for r in vocab_by_freq(df, "w", max_size=2).collect()}
    assert v == {"<unk>": 0, "<pad>": 1, "<sos>": 2, "<eos>": 3, "b": 4, "a": 5}
    t = [(r.token, r.freq) for r in top_tokens(vocab_by_freq(df, "w"), 2).collect()]
    assert t == [("b", 3), ("a", 2)]


def test_shared_vocab_orders_sides(spark):
    df = spark.createDataFrame([(0, "x y", "y z")], "sid long, s string, t string") \
        .select("sid", words("s").alias("s"), words("t").alias("t"))
    a = {r.token: r.id for r in shared_vocab(df, "s", "t").collect() if r.id >= 4}
    b = {r.token: r.id for r in shared_vocab(df, "t", "s").collect() if r.id >= 4}
    assert a == {"x": 4, "y": 5, "z": 6} and b == {"y": 4, "z": 5, "x": 6}


def test_encode_extended_golden(spark):
    v = spark.createDataFrame([("<unk>", 0, 0), ("<pad>", 1, 0), ("<sos>", 2, 0), ("<eos>", 3, 0), ("a", 4, 1), ("b", 5, 1)],
                              "token string, id int, freq long")
    df = spark.createDataFrame([(0, ["a", "z", "b", "z"], ["z", "q"])], "sid long, inp array<string>, outp array<string>")
    i = encode_extended(df, "inp", v, 6).first().ids
    o = encode_extended(df, "outp", v, 6, input_tokens="inp").first().ids
    assert i == [4, 7, 5, 9] and o == [7, 3]
    padded = encode_extended(df, "outp", v, 6, input_tokens="inp", fixed_len=4).first().ids
    assert padded == [7, 3, 0, 0]
    j = df.join(encode_extended(df, "outp", v, 6, input_tokens="inp", out="o"), "sid")
    txt = decode_extended(j, "o", v, 6, input_tokens="inp").first().text
    assert txt == "z <eos>"
    j2 = df.withColumn("o", F.array(F.lit(4), F.lit(12), F.lit(0)))
    assert decode_extended(j2, "o", v, 6, input_tokens="inp").first().text == "a <???>"


def test_array_functions_golden(spark):
    df = spark.createDataFrame([([5, 7, 2, 9], [5, 7], [2, 193, 9, 1, 1])], "a array<int>, b array<int>, c array<int>")
    r = df.select(A.trim_at("a").alias("t1"), A.seq_length("a").alias("l1"), A.trim_at("b").alias("t2"),
                  A.seq_length("b").alias("l2"), A.position_ids("c").alias("p"), A.pad_mask("c").alias("m"),
                  A.truncate_at_eos("a", 9).alias("e"), A.oov_to_unk("a", 7, 0).alias("u"),
                  A.one_hot(F.array(F.lit(1), F.lit(0)), 3).alias("h")).first()
    assert r.t1 == [5, 7, 2] and r.l1 == 3 and r.t2 == [5, 7] and r.l2 == 2
    assert r.p == [1, 2, 3, 0, 0] and r.m == [False, False, False, True, True]
    assert r.e == [5, 7, 2] and r.u == [5, 7, 2, 0] and r.h == [[0, 1, 0], [1, 0, 0]]


def test_one_hot_default_width(spark):
    df = spark.createDataFrame([([2, 0],)], "a array<int>")
    assert df.select(A.one_hot("a").alias("h")).first().h == [[0, 0, 1], [1, 0, 0]]


def test_sketches_are_united_without_their_tokens(spark):
    df = spark.range(40_000).selectExpr("id as sid", "id % 4 as part", "array(cast(id % 30000 as string), 'a') as w")
    fine = W.vocab_sketches(df, "w", ("part",))
    sizes = {r.part: r.vocab_size for r in W.vocab_preview(fine).collect()}
    assert sorted(sizes) == [0, 1, 2, 3]
    exact = {r.part: r.n + 4 for r in df.selectExpr("part", "explode(w) t").groupBy("part").agg(F.countDistinct("t").alias("n")).collect()}
    assert all(abs(sizes[p] - exact[p]) <= 0.03 * exact[p] for p in exact)
    (total,) = W.vocab_preview(W.unite_sketches(fine)).collect()
    assert abs(total.vocab_size - 30_005) <= 0.03 * 30_005
    small = W.vocab_preview(W.vocab_sketches(df.where("sid < 20"), "w"))
    assert small.first().vocab_size == 25
    assert W.vocab_preview(W.unite_sketches(W.vocab_sketches(df.where("sid < 0"), "w", ("part",)), ("part",))).count() == 0
