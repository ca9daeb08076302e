from tandem.session import bounded_broadcast, checkpoint_root, cut_lineage, spread


def test_checkpoint_root_is_read_from_the_session(spark):
    assert checkpoint_root(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir").rstrip("/")


def test_bounded_broadcast_checks_the_size(spark):
    small, ok = bounded_broadcast(spark.range(10), 10)
    assert ok and small.count() == 10
    big, ok = bounded_broadcast(spark.range(11), 10)
    assert not ok
    plan = big.join(spark.range(5), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "merge" in plan.lower()


def test_cut_lineage_writes_to_the_shared_folder(spark):
    df = cut_lineage(spark.range(100).selectExpr("id", "id * 2 AS x"), "unit")
    assert df.count() == 100
    root = checkpoint_root(spark)
    files = [f.replace("file://", "").replace("file:", "") for f in df.inputFiles()]
    assert files and all(f.startswith(root) for f in files), (root, files[:2])


def test_spread_only_widens_narrow_inputs(spark):
    narrow = spark.range(0, 1000, numPartitions=1)
    assert spread(narrow, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 1000, numPartitions=16)
    assert spread(wide, "id").rdd.getNumPartitions() == 16


def test_buckets_are_written_without_an_exchange(spark):
    from pyspark.sql import functions as F

    from tandem.session import bucketed_table

    df = spark.range(0, 40, 1, 4).select("id", F.spark_partition_id().alias("part"))
    t = bucketed_table(df, 4, "id", "buckets").select("id", F.input_file_name().alias("file"))
    moved = t.join(spark.createDataFrame([(i, i // 10) for i in range(40)], "id long, part int"), "id").groupBy("file").agg(F.countDistinct("part").alias("parts")).collect()
    assert len(moved) > 4 and all(r["parts"] == 1 for r in moved)     # each file holds rows of one task
    same = bucketed_table(df, 4, "id", "buckets")
    plan = t.join(same.hint("shuffle_hash"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan
