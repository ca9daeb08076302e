"""The pipeline stage by stage against plain Python, and toxicity on rows that it never learned from."""

import os
import random
import sys
import zlib

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from tandem.llm import queries, toxicity  # noqa: E402

LINE = "This very line is found in a great many of the documents"
STEMS = ["grobnak", "flurptang", "zwikkel"]


def _corpus(n=900):
    rng = random.Random(11)
    words = ["".join(rng.choice("aeioulnrstmd") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    bad = lambda: "".join(rng.choice(STEMS)) + rng.choice(["", "s", "er", "ing"])
    passage, copy = text(70), text(90)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        body = text(60) + (" " + " ".join(f"{bad()} {text(3)}" for _ in range(5)) if toxic else "")
        if not toxic and i % 9 == 1:
            body += "\n  " + LINE.upper() + " \n" + text(20)
        if not toxic and i % 10 == 3:
            body = passage + " " + body
        if not toxic and i % 12 == 5:
            body = copy + ("" if i % 24 == 5 else " end")
        docs.append((i + 1, body, "en", f"s{i % 3}", len(body)))
        if i % 7:
            labels.append((i + 1, 1, int(toxic)))
    labels += [(1, None, None), (5, 1, 1)]
    docs += [(9001, None, "en", "s", 0), (9002, "", None, None, 0), (9003, text(20000), "en", "s", None), (9004, copy, "en", "s", 1)]
    return docs, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out, (docs, labels) = str(tmp_path_factory.mktemp("sf")), _corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def _rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, folder), name)
        out[name] = (_rows(before), docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == list(out)
    # toxicity: what scores under the threshold stays, all clean documents do
    before, after = out["toxicity"]
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"), usable=lambda i: ~toxicity.held_out(i))
    scores = dict(zip([d for d, _ in before], model.scores([(t or "").encode() for _, t in before]), strict=True))
    kept = {d for d, _ in _rows(after)}
    assert kept == {d for d, s in scores.items() if s < corpus_pipeline.TOXIC}
    toxic = {d for d, t in before if any(s in (t or "") for s in STEMS)}
    assert len(kept & toxic) <= 0.1 * len(toxic) and len(kept - toxic) >= 0.97 * (len(before) - len(toxic))
    # line dedup
    before, after = out["line_dedup"]
    want = brute.line_dedup(before)
    got = {d: brute.sha(t or "") for d, t in _rows(after)}
    assert got == {d: sha for d, (_, dropped, sha) in want.items() if not dropped or sha != brute.sha("")}
    assert any(dropped for _, dropped, _ in want.values())
    # near duplicates: the one that names its class
    before, after = out["simhash_near_dedup"]
    classes = brute.simhash_classes(before)
    assert sorted(_rows(after), key=repr) == sorted([(d, t) for d, t in before if classes[d][1] == d], key=repr)
    assert len(_rows(after)) < len(before)
    # recurring passages
    before, after = out["substring_dedup"]
    want = {d: (n, gone, sha) for d, n, gone, sha in brute.substring_dedup(before)}
    got = {d: brute.sha(" ".join(brute.WORD.findall(t or ""))) for d, t in _rows(after)}
    assert got == {d: sha for d, (n, gone, sha) in want.items() if not gone or gone < n} and any(gone for _, gone, _ in want.values())
    # packing
    before, after = out["packing"]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.WORD_BPE)
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 1] for d, x in before}
    pieces = [(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], r["sequence_id"], r["offset"]) for r in after.collect()]
    assert brute.packing_faults(ids, pieces) == []


def test_empty_pipeline(spark, tmp_dir):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_dir}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_dir}/labels.parquet")
    assert corpus_pipeline.run(spark, tmp_dir).count() == 0


def test_toxicity_on_held_out_rows(spark, folder):
    """The query's columns, recall and false alarms on rows it never learned from, and labels of those rows without any effect."""
    docs, labels = _corpus()
    out = {r["doc_id"]: r for r in queries.op6_toxicity(spark, folder).collect()}
    assert len(out) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in out.items())
    toxic = {d for d, t, *_ in docs if any(s in (t or "") for s in STEMS)}
    unseen = {d for d, r in out.items() if r["held_out"]}
    assert sum(out[d]["predicted"] for d in unseen & toxic) >= 0.9 * len(unseen & toxic)
    assert sum(out[d]["predicted"] for d in unseen - toxic) <= 0.05 * len(unseen - toxic)
    frame = lambda flip: spark.createDataFrame([(d, (1 - y) if flip and d in unseen and y is not None else y) for d, _, y in labels], "doc_id long, toxic int")
    text = spark.read.parquet(f"{folder}/documents.parquet")
    models = [toxicity.fit(text, frame(flip), usable=lambda i: ~toxicity.held_out(i)) for flip in (False, True)]
    assert (models[0].weights == models[1].weights).all() and models[0].bias == models[1].bias
