"""The ten operators against plain Python on small tables with hard rows, and against libraries."""

import hashlib
import os
import struct
import sys
import tempfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from tandem.llm import cuckoo, golay_simhash, line_dedup, packing, permutation_index, phrase_dedup, token_orc, token_scan  # noqa: E402
from tandem.llm import toxicity, vector_dedup  # noqa: E402
from tandem.llm.bpe_codec import decode, encode  # noqa: E402
from tandem.llm.common import smallest_reachable  # noqa: E402
from tandem.llm.queries import BYTE_BPE, RANKS, WORD_BPE  # noqa: E402

LINE = "A line that is long enough to be counted, %d of them"
PASSAGE = " ".join(f"w{i}" for i in range(60))
DOCS = [
    (1, None), (2, ""), (3, "   \n \t"), (4, "short text"), (5, "short text"),
    *[(10 + i, f"head {i}\n  {LINE % 1}\t\n{(LINE % 1).upper()}\ntail") for i in range(6)],
    (20, "a b " + PASSAGE + " c d"), (21, "x " + PASSAGE), (22, " ".join(["again"] * 200)), (23, "é ß   漢字 😀 İ <|endoftext|>   two  blanks "),
    (24, " ".join(f"u{i}" for i in range(9000))),
]


@pytest.fixture
def docs(spark):
    rows = [(d, t, "clash", 1) for d, t in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n_words int").repartition(3, "doc_id")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def _tokens(path, end, spelled=False):
    """By the library; a special token's string has its id unless ``spelled``."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = spelled
    return {d: t.encode(x or "", add_special_tokens=False).ids + [end] for d, x in DOCS}


def test_packing(docs, none):
    rows = packing.pack_documents(docs, WORD_BPE).collect()
    pieces = [(r["doc_id"], r["start"], r["length"], zlib.crc32(r["ids"]), r["doc_tokens"], r["sequence_id"], r["offset"]) for r in rows]
    assert brute.packing_faults(_tokens(WORD_BPE, 1), pieces) == []
    assert packing.pack_documents(none, WORD_BPE).count() == 0
    whole = packing.sequences(packing.pack_documents(docs, WORD_BPE)).collect()
    assert sum(len(r["ids"]) // 4 for r in whole) == sum(len(v) for v in _tokens(WORD_BPE, 1).values())


def test_best_filling_is_best():
    rng = np.random.default_rng(3)
    for _ in range(50):
        counts = {int(n): int(rng.integers(1, 4)) for n in rng.integers(1, 40, 6)}
        room = int(rng.integers(1, 90))
        used = packing.best_filling(sorted(counts, reverse=True), counts, room)
        sums = {0}
        for n, c in counts.items():
            sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= room}
        assert sum(n * k for n, k in used.items()) == max(sums) and all(k <= counts[n] for n, k in used.items())


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 62, 20000).astype(np.uint64)
    f = cuckoo.CuckooFilter(len(h))
    f.insert(h)
    f.remove(h[:5000])
    f = cuckoo.CuckooFilter.load(f.dump())
    assert f.contains(h[5000:]).all() and f.contains(h[:5000]).mean() < 0.01


def test_line_dedup_and_its_reversal(spark, docs, none):
    def got(df):
        return {r["doc_id"]: (r["n_lines"], r["n_dropped"], brute.sha(r["text"])) for r in df.collect()}

    assert got(line_dedup.dedup_lines(docs)) == brute.line_dedup(DOCS)
    assert line_dedup.dedup_lines(none).count() == 0
    first, second = docs.where("doc_id < 13"), docs.where("doc_id >= 13")
    index = line_dedup.LineIndex(spark).insert(first).insert(second)
    assert got(index.clean(docs)) == brute.line_dedup(DOCS)
    index.delete(docs.where("doc_id in (14, 15)").select("doc_id"))
    left = [(d, t) for d, t in DOCS if d not in (14, 15)]
    assert got(index.clean(docs.where("doc_id not in (14, 15)"))) == brute.line_dedup(left)
    index.delete(docs.where("doc_id between 10 and 13").select("doc_id"))
    assert index.hot().count() == 0 and index.filters().count() >= 1  # no document holds the line, and its filter forgot it
    assert not any(cuckoo.CuckooFilter.load(r["blob"]).table.any() for r in index.filters().collect())


def test_line_index_opened_again(spark, docs, monkeypatch):
    """Another session goes on with the index: versions, deleted documents and shards lie under its path."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 1)
    path = tempfile.mkdtemp() + "/lines"
    rows = [(d, t) for d, t in DOCS]
    line_dedup.LineIndex(spark, path, shards=1).insert(docs.where("doc_id < 13")).delete(docs.where("doc_id = 11").select("doc_id"))
    again = line_dedup.LineIndex(spark, path, min_docs=99)
    assert (again.version, again.min_docs, len(again.tombs)) == (2, line_dedup.MIN_DOCS, 1)
    spark.range(1).write.parquet(f"{path}/refs/v3")  # an insertion that was cut short
    again.insert(docs.where("doc_id >= 13")).insert(docs.where("doc_id = 11"))
    last = line_dedup.LineIndex(spark, path)
    assert last.version == 4
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], brute.sha(r["text"])) for r in last.clean(docs).collect()}
    assert got == brute.line_dedup(rows)


def test_substring_dedup(docs, none):
    out = {r["doc_id"]: r for r in phrase_dedup.remove_repeats(docs).collect()}
    for d, n, gone, sha in brute.substring_dedup(DOCS):
        assert (out[d]["n_words"], out[d]["n_removed"], brute.sha(" ".join(brute.WORD.findall(out[d]["text"])))) == (n, gone, sha)
    assert phrase_dedup.remove_repeats(none).count() == 0


def test_simhash(spark, docs, none, monkeypatch):
    out = {r["doc_id"]: (f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in golay_simhash.near_duplicates(docs).collect()}
    assert out == brute.simhash_classes(DOCS)
    assert golay_simhash.near_duplicates(none).count() == 0


def test_simhash_of_repeated_ids(spark):
    """Every row is linked by its own text: two texts of one id, repeated rows and null ids."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (5, b), (9, a), (3, b), (None, c), (None, a), (8, None), (7, "")]
    out = golay_simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r["doc_id"] or 0, f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"] or 0) for r in out)
    fp = {x: f"{brute.simhash(x):016x}" for x in (a, b, c, "")}
    assert got == sorted([(5, fp[a], 5), (9, fp[a], 5), (0, fp[a], 5), (5, fp[b], 3), (5, fp[b], 3), (3, fp[b], 3), (0, fp[c], 0), (8, fp[""], 7), (7, fp[""], 7)])


def test_simhash_hot_keys(spark, monkeypatch):
    """Blocks of hot keys give the same components as a comparison of all pairs."""
    monkeypatch.setattr(golay_simhash, "SMALL", 4)
    monkeypatch.setattr(golay_simhash, "BLOCK", 16)
    rng = np.random.default_rng(5)
    fps = set()
    for _ in range(4):
        c = int(rng.integers(0, 1 << 62))
        fps |= {c ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in (0, 1, 2, 3, 4) for _ in range(12)}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    links = golay_simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    got = {r["node"]: r["root"] for r in smallest_reachable(links).collect()}
    pairs = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 3]
    want = brute.components(signed, pairs)
    assert {f: got.get(f, f) for f in signed} == want


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    rows = [(i, i % 2, (base[i // 4] + 0.05 * rng.normal(size=16)).tolist()) for i in range(160)]
    rows += [(200, 0, rows[0][2]), (201, None, rows[0][2]), (202, 0, None), (203, 0, [0.0] * 16), (204, 0, [float("nan")] * 16), (205, 0, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_duplicates(df).collect()}
    assert got == brute.vector_links(rows)
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


def test_vectors_in_overlapping_shards(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "CLUSTER", 60)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(100, 16))
    rows = [(i, 0, (base[i // 4] + 0.04 * rng.normal(size=16)).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_duplicates(df).collect()}
    want = brute.vector_links(rows)
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values())


def _hot_and_sparse(n, dim=32, seed=6):
    """A third of ``n`` rows nearly one vector, the others in pairs."""
    rng = np.random.default_rng(seed)
    hot, base = rng.normal(size=dim), rng.normal(size=(n // 3, dim))
    near = lambda v: (v + 0.03 * rng.normal(size=dim)).tolist()
    return [(i, 0, near(hot) if i % 3 == 0 else near(base[i // 3])) for i in range(n)]


def test_vector_audit_sees_lost_sparse_links(spark):
    """All links of the pairs are lost, those of the hot group are there: the audit must not pass."""
    rows = _hot_and_sparse(9000)
    df = spark.createDataFrame(rows, "node long, label string, v array<double>").withColumn("weight", F.lit(1).cast("long"))
    counts = spark.createDataFrame([(i, 2999) for i in range(0, 9000, 3)], "node long, n long")
    assert vector_dedup.audit(df, counts, 0.93) < vector_dedup.RECALL
    whole = counts.union(spark.createDataFrame([(i, 1) for i in range(9000) if i % 3], "node long, n long"))
    assert vector_dedup.audit(df, whole, 0.93) == 1.0


def test_vectors_when_every_search_falls_short(spark, monkeypatch):
    """A search that finds nothing at all ends in whole links, across blocks, labels and dimensions."""
    rows = _hot_and_sparse(900) + [(1000 + i, 1, v) for i, _, v in _hot_and_sparse(30, seed=9)] + [(2000 + i, 1, [1.0, i / 9]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    monkeypatch.setattr(vector_dedup, "BLOCK", 200)
    monkeypatch.setattr(vector_dedup, "_links", lambda visits, *_: visits.select(F.col("node").alias("a"), F.col("node").alias("b")))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_duplicates(df).collect()}
    assert got == brute.vector_links(rows)


def test_permutation_index(spark):
    rng = np.random.default_rng(7)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1500, 24)))]
    df = spark.createDataFrame([*rows, (5000, None), (5001, [0.0] * 24), (5002, [float("inf")] * 24)], "vec_id long, embedding array<double>")
    found = permutation_index.search(df, df.where("vec_id % 20 = 0"), 20)
    want = brute.nearest(rows, [i for i, _ in rows if i % 20 == 0], 20)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & {i for i, _ in w}) / 20 for q, w in want.items()]) >= 0.9
    assert permutation_index.search(df.limit(0), df, 5).count() == 0


def test_permutation_index_with_a_hot_vector(spark):
    """Several full blocks, a third of all rows copies of one vector: copies are answered by smallest id."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(24000, 16))
    x[::3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8)
    asked = [0, 3, 30, 12000, 23997] + list(range(1, 24000, 600))
    queries = df.where(F.col("vec_id").isin(asked))
    found = permutation_index.search(df, queries, 20)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q in asked[:5]:
        s = x @ x[0]
        want = [j for j in np.lexsort((np.arange(len(x)), -np.round(s, 9))) if j != q][:20]
        assert got[q] == want
    assert permutation_index.audit_recall(df, found, queries, 20) >= 0.9


def test_vector_graph_alone_finds_all_beside_a_dense_group(spark, monkeypatch):
    """A third of the rows nearly one vector: the search finds every link at the first overlap, exact block pairs are never needed."""
    def unused(*args):
        raise AssertionError("the graph fell short")

    monkeypatch.setattr(vector_dedup, "_all_links", unused)
    rows = _hot_and_sparse(3000)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_duplicates(df, overlaps=(2,)).collect()}
    assert got == brute.vector_links(rows)


def test_permutation_index_ids_with_several_vectors(spark):
    """An id whose many vectors are all near takes one place, and the smaller ids of copies come first."""
    rows = [(7, [1.0, 0.001 * i]) for i in range(60)] + [(100 + i, [0.5, 0.0]) for i in range(30)] + [(1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = permutation_index.search(df, df.where("vec_id = 1"), 5).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [7, 100, 101, 102, 103]


def test_byte_bpe(docs):
    import public_tokenizers as P
    import tiktoken

    from tandem.llm.encoders import read_ranks

    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(read_ranks(RANKS))}, special_tokens={})
    for r in decode(encode(docs, RANKS), RANKS).collect():
        assert r["ids"] == lib.encode_ordinary(r["text"] or "") and r["decoded"] == (r["text"] or "").encode()


def test_toxicity_learns_stems():
    rng = np.random.default_rng(0)
    plain = lambda: " ".join("".join(rng.choice(list("aeioulnrst"), 5)) for _ in range(60))
    texts = [plain() + (f" grobxx{'aeiou'[i // 2 % 5]} " if i % 2 else " ") + plain() for i in range(300)]
    m = toxicity.train(texts, [i % 2 for i in range(300)], epochs=40, batch=8)
    new = [plain() + " grobxxzz " + plain() for _ in range(20)], [plain() + " " + plain() for _ in range(20)]
    assert m.scores(new[0]).mean() > m.scores(new[1]).mean() + 0.2
    assert len(m.scores([None, "", "a"])) == 3 and toxicity.train([], []).scores([""])[0] < 0.01


def test_token_scan_stitches_blocks(spark, docs):
    path = tempfile.mkdtemp()
    placed = token_scan.write_flat(docs, path, BYTE_BPE, 50256)
    want = {d: len(v) - 1 for d, v in _tokens(BYTE_BPE, 50256, spelled=True).items()}
    for block in (7, 1000, 1 << 20):
        got = placed.join(token_scan.scan(spark, path, 50256, block_ids=block), ["file", "ordinal"])
        assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == want
    with open(f"{path}/part-tail.bin", "wb") as f:
        f.write(struct.pack("<4H", 5, 50256, 6, 7))
    tail = token_scan.scan(spark, path, 50256, block_ids=3).where("file = 'part-tail.bin'").orderBy("ordinal").collect()
    assert [(r["start"], r["n_tokens"], r["terminated"]) for r in tail] == [(0, 1, True), (2, 2, False)]


def test_token_orc(spark, docs):
    path = tempfile.mkdtemp() + "/orc"
    token_orc.write_tokens(docs, path, BYTE_BPE, 2)
    at, want = 0, {}
    for d, ids in sorted(_tokens(BYTE_BPE, 2).items()):
        want[d] = (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    rows = token_orc.with_crc32(token_orc.read_tokens(spark, path))
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows.collect()} == want
    assert [r["doc_id"] for r in token_orc.read_tokens(spark, path, [21, 999]).collect()] == [21]


def test_digest_is_of_kept_text():
    assert brute.sha("a") == hashlib.sha256(b"a").hexdigest()
