from kindred.operators.blocking import exact_key_pairs
from kindred.streaming.incremental import link_arrivals, settled


def test_batches_give_the_pairs_of_one_join(spark, tmp_path):
    s1 = spark.createDataFrame([(i, "US", f"k{i % 7}") for i in range(20)], "id long, country string, key string")
    pool = spark.createDataFrame([(i, "US", f"k{i % 9}") for i in range(100, 140)], s1.schema)
    pool.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(s1.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    link_arrivals(stream, s1, ["key"], str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True).awaitTermination()
    got = settled(spark, str(tmp_path / "out"), ["key"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exact_key_pairs(s1, pool, ["key"]).collect()))


def test_the_cap_holds_over_batches(spark, tmp_path):
    """Keys of 4 and 5 records, two in a batch: at a cap of 4 the larger ones give nothing in the end."""
    s1 = spark.createDataFrame([(i, "US", f"k{i}") for i in range(9)], "id long, country string, key string")
    pool = spark.createDataFrame([(i, "US", f"k{i % 9}") for i in range(100, 140)], s1.schema)
    pool.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(s1.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    link_arrivals(stream, s1, ["key"], str(tmp_path / "out"), str(tmp_path / "cp"), cap=4, available_now=True).awaitTermination()
    want = sorted(map(tuple, exact_key_pairs(s1, pool, ["key"], 4).collect()))
    assert 0 < len(want) < 40 and sorted(map(tuple, settled(spark, str(tmp_path / "out"), ["key"], 4).collect())) == want
