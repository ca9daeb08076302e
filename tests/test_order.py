from pyspark.sql import functions as F

from tandem.operators.order import cap_per_group, dense_index, head_rows, split_half, split_ordered, union_regions


def _ids(spark, n, step=7):
    return spark.range(n).select((F.col("id") * step).alias("sid"))


def test_split_ordered_21(spark):
    s = split_ordered(_ids(spark, 21))
    c = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert c == {"train": 18, "valid": 1, "test": 2}
    first_test = s.filter("split = 'test'").agg(F.min("sid")).first()[0]
    assert first_test == 19 * 7


def test_split_half_5(spark):
    s = split_half(_ids(spark, 5))
    assert sorted((r.sid, r.split) for r in s.collect()) == [
        (0, "valid"), (7, "valid"), (14, "test"), (21, "test"), (28, "test")]


def test_dense_index_is_stable_under_repartitioning(spark):
    base = _ids(spark, 5000, 3)
    a = {r.sid: r.idx for r in dense_index(base, ["sid"]).collect()}
    b = {r.sid: r.idx for r in dense_index(base.repartition(7), ["sid"]).collect()}
    assert a == b and sorted(a.values()) == list(range(5000))
    assert all(a[s] == s // 3 for s in a)


def test_dense_index_partitioned_and_total(spark):
    df = spark.createDataFrame([("x", 5), ("x", 1), ("y", 3), ("x", 9)], "g string, sid long")
    out = sorted((r.g, r.sid, r.k, r.n) for r in dense_index(df, ["sid"], partition_by=["g"], name="k", total="n").collect())
    assert out == [("x", 1, 0, 3), ("x", 5, 1, 3), ("x", 9, 2, 3), ("y", 3, 0, 1)]


def test_union_and_head_and_cap(spark):
    a = spark.createDataFrame([(5, "a"), (2, "a")], "sid long, region string")
    b = spark.createDataFrame([(1, "b")], "sid long, region string")
    u = sorted((r.sid, r.region) for r in union_regions(a, b).collect())
    assert u == [(0, "a"), (1, "a"), (2, "b")]
    assert [r.sid for r in head_rows(_ids(spark, 50), 3).collect()] == [0, 7, 14]
    d = spark.createDataFrame([(g, i) for g in "pq" for i in range(10)], "g string, i long")
    kept = cap_per_group(d, ["g"], ["i"], n=3)
    assert sorted((r.g, r.i) for r in kept.collect()) == [("p", 0), ("p", 1), ("p", 2), ("q", 0), ("q", 1), ("q", 2)]


def test_null_keys_and_partitions_keep_their_rows(spark):
    from tandem.operators.order import dense_index, split_ordered

    df = spark.createDataFrame([(1, "a"), (2, None), (None, "a")], "sid long, g string")
    assert dense_index(df, ["sid"]).count() == 3
    assert sorted(r["idx"] for r in dense_index(df, ["sid"]).collect()) == [0, 1, 2]
    assert split_ordered(df.where("sid is not null"), partition_by=["g"]).count() == 2


def test_dense_index_over_any_key_and_over_gaps(spark):
    """Keys of any type, far apart, most of them under one prefix: ranges follow the rows, not the key's values."""
    df = spark.range(3000).select((F.col("id") * F.when(F.col("id") % 7 == 0, 1 << 50).otherwise(1)).alias("sid"),
                                  F.concat(F.lit("a" * 60), F.lpad(F.col("id").cast("string"), 6, "0")).alias("path"))
    rows = dense_index(df.repartition(5), ["path"], start=1, name="k").orderBy("k").collect()
    assert [r.k for r in rows] == list(range(1, 3001)) and [r.path for r in rows] == sorted(r.path for r in rows)
    rows = dense_index(df.repartition(5), ["sid", "path"], name="k", total="n").orderBy("k").collect()
    assert [r.k for r in rows] == list(range(3000)) and [r.sid for r in rows] == sorted(r.sid for r in rows)
    assert {r.n for r in rows} == {3000}


def test_strides_hold_long_documents_and_conversations(spark, tmp_dir):
    from tandem.sources.testdata import LINE_STRIDE, conv_pairs, line_pairs

    spark.createDataFrame([(1, "en", "\n".join(f"l{i}" for i in range(100_001))), (2, "en", "next")],
                          "doc_id long, lang string, text string").write.parquet(f"{tmp_dir}/documents.parquet")
    p = line_pairs(spark, tmp_dir)
    assert p.count() == p.select("sid").distinct().count() == 100_002
    assert p.where(f"sid = {LINE_STRIDE + 100_000}").first().standard == "l100000"
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(1001)] + [(2, 0, "user", "a"), (2, 1, "assistant", "b")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_dir}/conversations.parquet")
    c = conv_pairs(spark, tmp_dir)
    assert c.count() == c.select("sid").distinct().count() == 501
