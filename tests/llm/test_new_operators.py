"""WARC archives, spelling variants and vector codes against plain Python, through the registered queries."""

import os
import random
import sys

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from tandem.llm import queries, spelling, vector_codes, warc  # noqa: E402
from tandem.session import scratch_path  # noqa: E402


def _save(df, folder, name):
    df.write.parquet(f"{folder}/{name}.parquet")
    return folder


def _key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


PAGES = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, None), (4, "http://ü/4 x", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n"),
         (None, "n", "<p>one</p>"), (None, "n", "alone"), (7, "big", "<div>" * 400_000), (8, "r", "twice"), (8, "r", "twice"), (-9, "neg", "<p>one</p>"),
         *[(100 + i, f"http://h/{i}", f"<html><head><title>Page {i}</title></head><body>{'text ' * (i % 40)}{i % 60}</body></html>") for i in range(400)],
         *[(1000 + i, "hot", "<b>the same</b>") for i in range(200)]]


def test_warc(spark, tmp_dir):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(5)
    got = [tuple(r) for r in queries.op11_warc(spark, _save(df, tmp_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=_key) == sorted(brute.warc([(p, h) for p, _, h in PAGES]), key=_key)


def test_warc_files(spark, monkeypatch):
    """Files begin with the dictionary's frame, any record reads alone, small payloads stay whole, files turn over."""
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    path = scratch_path(spark, "warc-test")
    warc.write_archives(df, path, min_bytes=15, file_bytes=4000)
    index = spark.read.parquet(f"{path}/index").collect()
    assert len(index) == len(PAGES) and len({r["file"] for r in index}) > 2
    whole = {r["page_id"]: r for r in warc.read_archives(spark, path).collect() if r["page_id"] is not None}
    assert whole[1]["record_type"] == "response" and bytes(whole[1]["payload"]) == b"<p>one</p>"  # under 15 bytes
    assert whole[1000]["record_type"] == "revisit" and whole[1000]["refers_to"] == 1199 and whole[1000]["payload"] is None
    assert bytes(whole[7]["payload"]) == b"<div>" * 400_000 and bytes(whole[5]["payload"]).decode() == "é\r\n\r\nWARC/1.1\r\n"
    store, folder = warc.open_store(path)
    one = next(r for r in index if r["key"] == 150)
    assert warc.read_record(path, one["file"], one["offset"], one["length"])[0] == 150
    with store.open_input_file(f"{folder}/{one['file']}") as f:
        lead = f.read(8)
        assert lead[:4] == b"\x5d\x2a\x4d\x18"
        body = zstandard.ZstdDecompressor().decompress(f.read(int.from_bytes(lead[4:], "little")))
    assert body[:4] == b"\x37\xa4\x30\xec"  # a Zstandard dictionary


def test_warc_empty(spark, tmp_dir):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert queries.op11_warc(spark, _save(df, tmp_dir, "pages")).count() == 0


def _variants(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def _texts():
    rng = random.Random(7)
    base = ["receive", "separate", "necessary", "aaaaa", "aaaaaa", "abababab", "über", "naïveté", "stressed", "andante", "andalus", "andorra"]
    words = []
    for w in base:
        for _ in range(25):
            v = list(w)
            i = rng.randrange(len(v))
            v[i : i + rng.choice((0, 1, 1))] = rng.choice((["b"], ["e"], [], ["é"]))
            words += ["".join(v)] * rng.choice((1, 3, 4, 9))
            words += ["".join(v) + "s"] * 3  # a variant of a variant
        words += [w] * 40
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::40]) + (". THE-End" if i % 2 else "×÷")) for i in range(40)]
    rows += [(41, None), (42, ""), (None, "receive receive receive Receive"), (43, "long" * 3000 + " " + "long" * 3000 + "x"), (43, "long" * 3000 + " separate"),
             (44, "long" * 3000 + " " + ("long" * 3000 + "x ") * 2)]
    return rows


@pytest.mark.parametrize("limit", [20_000, 15, 4])
def test_spelling(spark, limit):
    rows = _texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1)).repartition(3)
    want = brute.spelling(rows)
    assert sum(v[0] is not None for v in want.values()) > 20 and any(v[1] not in (k, v[0]) for k, v in want.items())
    assert _variants(spelling.variants(df, limit=limit)) == want


def test_spelling_query(spark, tmp_dir):
    df = spark.createDataFrame(_texts(), "doc_id long, text string")
    out = queries.op12_spelling(spark, _save(df, tmp_dir, "documents"))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and _variants(out) == brute.spelling(_texts())
    none = spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")
    assert spelling.variants(none).count() == 0 and spelling.variants(none.limit(0)).count() == 0


def test_minimal_acceptor():
    """Equal right languages are one state: as many states as Nerode classes."""
    words = sorted(a + b for a in ("re", "de", "un") for b in ("do", "dos", "cast", "casts", ""))
    trie = spelling.Trie(1, [0] * len(words), words)
    final = np.zeros(trie.n, np.int64)
    final[trie.end] = 3
    state, m = spelling.minimised(trie, final)
    tails = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    assert len(m.final) == len(tails) < trie.n


def _vectors(n=900, dim=16):
    rng = np.random.default_rng(8)
    rows = [(3 * i - 50, None if i % 11 == 0 else i % 4, np.float32(rng.normal(size=dim) * 0.3).tolist()) for i in range(n)]
    hot = rows[5][2]
    rows += [(10_000 + i, 1, hot) for i in range(n // 2)]  # a third of all rows
    rows += [(5, 0, hot), (5, 0, hot), (None, 2, rows[9][2]), (9001, 0, None), (9002, 0, []), (9003, 0, [float("nan")] * dim),
             (9004, 0, [None] + [0.1] * (dim - 1)), (9005, 0, [float("-inf")] * dim), (9006, None, [0.0] * dim)]
    return rows


def _books(coded):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in coded), key=_key)


def test_vector_codes(spark, tmp_dir):
    rows = _vectors()
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("code", F.lit("x")).repartition(4)
    got = queries.op13_vector_codes(spark, _save(df, tmp_dir, "embeddings")).collect()
    want, books = brute.vector_codes(rows)
    assert _books(got) == sorted(want, key=_key)
    assert {r["codebooks_sha256"] for r in got} == {vector_codes.books_sha256([np.array(b) for b in books])}


def test_vector_codes_few_rows(spark, tmp_dir):
    rows = _vectors(20)[:12]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = queries.op13_vector_codes(spark, _save(df, tmp_dir, "embeddings"))
    assert _books(got.collect()) == sorted(brute.vector_codes(rows)[0], key=_key)
    coded, books = vector_codes.learn(df.limit(0))
    assert vector_codes.with_label_error(coded).count() == 0 and books[0].size == 0
    with pytest.raises(ValueError):
        vector_codes.learn(spark.createDataFrame([(1, 1, [1e12] * 4)], df.schema))


def test_hilbert_curve_steps_to_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        keys = vector_codes.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(1 << bits * dims))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_shortlist_keeps_every_winner():
    rng = np.random.default_rng(9)
    for _ in range(50):
        x, book = rng.integers(-40, 40, (30, 5)), rng.integers(-60, 60, (20, 5))
        x = x // 8 + rng.integers(-50, 50, 5)
        best, d = vector_codes.nearest(x, book, True)
        assert set(best.tolist()) <= set(vector_codes.shortlist(x.min(0), x.max(0), book).tolist())
        again = vector_codes.nearest(x, book, False)
        assert (again[0] == best).all() and (again[1] == d).all()


def test_packing_hands_out_pieces_in_small_batches():
    from tandem.llm.packing import _Packer, pack_ids

    packer = _Packer(8, 0)
    for i in range(50):
        packer.add(i, pack_ids(range(3 + i % 3)))
    packer.fill(True)
    whole, got = list(packer.out), []
    while packer.out:
        got.append(packer.take(7))
    assert max(map(len, got)) == 7 and [p for x in got for p in x] == whole


def test_a_worker_keeps_few_chunks():
    """The ids that a worker keeps for packing stay bounded when texts go on bringing new words."""
    from tandem.llm.encoders import WordEncoder

    encode = WordEncoder(lambda w: b"whole", lambda w: b"1234")
    for lo in range(0, 250_000, 1000):
        assert encode(b" ".join(b"w%d" % i for i in range(lo, lo + 1000))) == b"whole" * 1000
    assert len(encode.chunks) + len(encode.chunks.old) <= 100_000
