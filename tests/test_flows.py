import codecs
import json
import os

from pyspark.sql import functions as F

from tandem.plans.flows import batch_table, bridge_dialects, lr_lexicon, predict_table, prepare_corpus, train_and_score


def _write_region(root, region, sentences, per_file=4):
    os.makedirs(os.path.join(root, region))
    for k in range(0, len(sentences), per_file):
        obj = {"utterance": [{"standard_form": s, "dialect_form": d} for s, d in sentences[k:k + per_file]]}
        with open(os.path.join(root, region, f"f{k:03d}.json"), "wb") as fh:
            fh.write(codecs.BOM_UTF8 + json.dumps(obj, ensure_ascii=False).encode("utf-8"))


SENTS = [(f"나는 학교에 {w} 간다", f"나넌 핵교에 {w} 간다") for w in ["빨리", "천천히", "오늘", "내일", "아침에", "저녁에",
                                                                 "혼자", "같이", "걸어서", "뛰어서"]] * 2


def test_prepare_and_score(spark, tmp_dir):
    root = os.path.join(tmp_dir, "raw")
    _write_region(root, "강원도", SENTS)
    split = prepare_corpus(spark, root, out=os.path.join(tmp_dir, "out"))
    c = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert c == {"train": 18, "valid": 1, "test": 1}
    rep = train_and_score(split, iters=3)
    assert rep.loss.count() == 1 and 0 < rep.bleu.first().bleu1 <= 1
    assert rep.lexicon.groupBy("e").agg(F.sum("p").alias("s")).filter("abs(s - 1) > 1e-9").count() == 0


def test_bridge_and_batches(spark):
    p1 = spark.createDataFrame([(i, "x", s, d) for i, (s, d) in enumerate(SENTS)], "sid long, region string, standard string, dialect string")
    p2 = p1.select("sid", "region", "standard", F.regexp_replace("dialect", "핵교", "학조").alias("dialect"))
    out = bridge_dialects(p1, p2, iters=3)
    assert out.count() == len(SENTS)
    assert bridge_dialects(p1, p2, iters=2, composed=True).count() == len(SENTS)
    b = batch_table(p1, batch_size=4, min_frequency=1)
    rows = b.collect()
    assert len(rows) == len(SENTS)
    assert all(len(r.ids) == len(r.mask) == len(r.positions) for r in rows)


def test_predict_table(spark, tmp_dir):
    p = spark.createDataFrame([(i, "x", s, d) for i, (s, d) in enumerate(SENTS)], "sid long, region string, standard string, dialect string")
    m = lr_lexicon(p, iters=6, min_frequency=2)
    assert m.source_scores.count() and m.target_scores.count()
    extra = [(100, "x", "핵교에 빨리, 간다!"), (101, "x", ""), (102, "x", None), (103, "x", "zz 간다")]
    rows = p.select("sid", "region", "dialect").unionByName(spark.createDataFrame(extra, "sid long, region string, dialect string"))
    got = {r.sid: r for r in predict_table(rows, m.source_scores, m.table, out=os.path.join(tmp_dir, "predicted")).collect()}
    assert set(got) == set(range(len(SENTS))) | {100, 101, 102, 103}
    assert got[101].inference == "" and got[102].inference == "" and got[103].inference.startswith("<unk> ")
    plain = {r.sid: r.inference for r in predict_table(rows, m.source_scores, m.table, copy=True).collect()}
    assert all(plain[i] == got[i].inference for i in got if i != 103) and plain[103].startswith("zz ")
    best = {r.e: r.f for r in m.table.orderBy("p").collect()}
    assert best["나넌"] in ("나는", "간다") and len(got[0].inference.split()) >= 4


def test_files_beyond_the_cap_are_left_out(spark, tmp_dir):
    root = os.path.join(tmp_dir, "raw")
    _write_region(root, "강원도", SENTS)
    _write_region(root, "제주도", SENTS[:4])
    split = prepare_corpus(spark, root, files_per_region=2)
    assert {r.region: r["count"] for r in split.groupBy("region").count().collect()} == {"강원도": 8, "제주도": 4}
