import json
import os

from tandem.streaming.cleaning import start_cleaning


def test_clean_pairs_on_a_stream(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    rows = [{"sid": 1, "region": "gw", "standard": "나는  학교에   간다!", "dialect": "나넌 핵교에 간다."},
            {"sid": 2, "region": "gw", "standard": "안녕하세", "dialect": "안녕"}]
    with open(os.path.join(src, "part-0.json"), "w", encoding="utf-8") as fh:
        fh.write("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
    q = start_cleaning(spark, src, "cleaned_stream", os.path.join(tmp_dir, "ckpt"), sink_format="memory")
    q.awaitTermination(120)
    out = spark.sql("SELECT sid, standard FROM cleaned_stream").collect()
    assert [(r.sid, r.standard) for r in out] == [(1, "나는 학교에  간다")]


def test_column_functions_on_a_stream(spark, tmp_dir):
    from pyspark.sql import functions as F

    from tandem.functions import arrays as A
    from tandem.functions import text as X

    src = os.path.join(tmp_dir, "in2")
    os.makedirs(src)
    with open(os.path.join(src, "part-0.json"), "w", encoding="utf-8") as fh:
        fh.write(json.dumps({"sid": 1, "standard": " 나는 3시에  간다 ", "ids": [2, 9, 3, 1, 1]}, ensure_ascii=False))
    s = spark.readStream.schema("sid long, standard string, ids array<int>").json(src)
    out = s.select(
        "sid",
        F.array_join(X.words("standard"), "|").alias("w"),
        F.size(X.syllables("standard")).alias("n_syl"),
        X.contains_digit("standard").alias("digit"),
        X.normalize_hangul("standard").alias("norm"),
        A.truncate_at_eos("ids").alias("body"),
        A.position_ids("ids").alias("pos"),
        A.pad_mask("ids").alias("mask"),
    )
    q = (out.writeStream.format("memory").queryName("cols_stream")
         .option("checkpointLocation", os.path.join(tmp_dir, "ckpt2")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    r = spark.sql("SELECT * FROM cols_stream").first()
    assert r.w == "나는|3시에|간다" and r.n_syl == 12 and r.digit is True and r.norm == "나는 시에  간다"
    assert r.body == [2, 9] and r.pos == [1, 2, 3, 0, 0] and r.mask == [False, False, False, True, True]
