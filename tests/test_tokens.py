from tandem.functions.text import words
from tandem.operators.tokens import cohesion_scores, prefix_counts, tokenize_lr


def test_cohesion_golden(spark):
    df = spark.createDataFrame([(0, "학교에 학교는 학생이")], "sid long, t string").select("sid", words("t").alias("w"))
    c = {r.word: round(r.cohesion, 6) for r in cohesion_scores(df, "w", min_frequency=1).collect()}
    assert c["학교"] == 0.666667 and c["학교에"] == 0.57735
    p = {r.prefix: r.cnt for r in prefix_counts(df, "w").collect()}
    assert p["학"] == 3 and p["학교"] == 2


def test_tokenize_lr(spark):
    scores = spark.createDataFrame([("학교", 0.9), ("학교에서", 0.5)], "word string, cohesion double")
    df = spark.createDataFrame([(0, "학교에서 공부 했다요"), (1, "")], "sid long, t string").select("sid", words("t").alias("w"))
    out = {r.sid: r.lr_tokens for r in tokenize_lr(df, "w", scores).collect()}
    assert out[0] == ["학교", "에서", "공부", "했다요"]
    assert out[1] == []
