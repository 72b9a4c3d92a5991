from pyspark.sql import functions as F

from urbandemand.streaming.capacity import running_capacity


def test_running_capacity(spark, tmp_path):
    rows = spark.range(40).select(F.lit("c").alias("city"), (F.col("id") % 3).alias("place_id"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("residents"), F.when(F.col("id") % 2 == 1, F.col("id")).alias("jobs"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = running_capacity(stream).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("running").collect())) == sorted(map(tuple, running_capacity(rows).collect()))
