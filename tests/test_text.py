from pyspark.sql import functions as F

from tandem.functions import text as X
from tandem.operators.clean import clean_pairs, filter_max_len, orient


def test_clean_pairs_golden(spark):
    rows = [
        (1, "나는  학교에   간다!", "나넌 핵교에 간다."),
        (2, "laughing 그래서 갔지", "그래가 갔지"),
        (3, "나는 3시에 갔다", "나넌 세시에 갔다"),
        (4, "나는 집에 간다", "난 name 간다"),
        (5, "안녕하세", "안녕"),
    ]
    df = spark.createDataFrame(rows, "sid long, standard string, dialect string")
    out = {r.sid: (r.standard, r.dialect) for r in clean_pairs(df).collect()}
    assert out == {1: ("나는 학교에  간다", "나넌 핵교에 간다"), 2: (" 그래서 갔지", "그래가 갔지")}


def test_clean_pairs_missing_side_becomes_nan_and_is_blanked(spark):
    df = spark.createDataFrame([(1, None, "그래가 갔지요")], "sid long, standard string, dialect string")
    assert clean_pairs(df).count() == 0


def test_normalize_and_clean_text(spark):
    df = spark.createDataFrame([(" !나는\t집에 간다. ok ", "[나는] (3.5%) \"집\"에; 간다!?")], "a string, b string")
    r = df.select(X.normalize_hangul("a").alias("n"), X.clean_text("b").alias("c")).first()
    assert r.n == "나는집에 간다 "
    assert r.c == '나는 35 "집"에; 간다'


def test_tokens_and_join(spark):
    df = spark.createDataFrame([("나는  학교\t간다",), ("",)], "t string")
    r = df.select(X.words("t").alias("w"), X.syllables("t").alias("s")).collect()
    assert r[0].w == ["나는", "학교", "간다"]
    assert r[0].s[:3] == ["나", "는", " "]
    assert r[1].w == [] and r[1].s == []
    j = df.select(X.join_tokens(X.syllables("t"), "syl").alias("j")).collect()
    assert [x.j for x in j] == ["나는  학교\t간다", ""]


def test_truncate_at_special(spark):
    df = spark.createDataFrame([(["<sos>", "나", "는", "<unk>", "다", "<eos>"],), (["<sos>", "a", "b"],)], "a array<string>")
    out = [r.t for r in df.select(X.truncate_at_special("a", "syl").alias("t")).collect()]
    assert out == ["나는", "ab"]


def test_contains_digit_and_filters(spark):
    df = spark.createDataFrame([(1, "a 1", "b"), (2, "ab", "c d")], "sid long, standard string, dialect string")
    assert [r.d for r in df.select(X.contains_digit("standard").alias("d")).collect()] == [True, False]
    o = orient(df)
    assert o.columns == ["sid", "src", "trg"] and o.first().src == "b"
    # strictly shorter on both sides: sid 1 has a 2-word target, sid 2 a 2-word source
    assert filter_max_len(o, 2, "word").count() == 0
    assert filter_max_len(o, 3, "word").count() == 2
    assert filter_max_len(o, 3, "syl").count() == 0
    assert filter_max_len(o, 4, "syl").count() == 2
