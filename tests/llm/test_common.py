from lakespark.llm.common import release, scratch, stored


def test_scratch_is_shared_and_released(spark):
    assert scratch(spark, "a").startswith(spark.conf.get("spark.checkpoint.dir")) and scratch(spark, "a") != scratch(spark, "a")
    rows = stored(spark.range(5), "five")
    assert rows.count() == 5 and "ExistingRDD" not in rows._jdf.queryExecution().toString()
    path = rows.inputFiles()[0]
    release(spark)
    import os

    assert not os.path.exists(path.removeprefix("file://"))
