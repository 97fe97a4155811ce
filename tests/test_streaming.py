from pyspark.sql import functions as F

from rowloom.operators import columns as C
from rowloom.operators import reshape as R
from rowloom.streaming.verbs import streamed, windowed_count


def run(spark, df, mode, name):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_row_local_verbs_on_a_stream(spark, tmp_path):
    spark.range(100).select(F.col("id").cast("string").alias("a"), F.concat(F.lit("x"), F.col("id")).alias("b")).repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("a string, b string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = streamed(
        stream, lambda t: C.search(t, "^[0-9]$", "a"), lambda t: C.gsub(t, "x", "y", "b"), lambda t: C.rename(t, [("b", "c")]),
        lambda t: C.newfield(t, "k", "1"), lambda t: C.cut(t, ["a", "c", "k"]), lambda t: R.melt(t, ["a"]),
    )
    got = {tuple(r) for r in run(spark, out, "append", "verbs").collect()}
    assert got == {(str(i), *pair) for i in range(10) for pair in (("c", f"y{i}"), ("k", "1"))}


def test_windowed_counts(spark, tmp_path):
    rows = spark.range(60).select(F.timestamp_seconds(F.lit(1_600_000_020) + F.col("id")).alias("at"), (F.col("id") % 2).alias("k"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("at timestamp, k long").parquet(f"{tmp_path}/in")
    got = run(spark, windowed_count(stream, "at", "20 seconds", "1 minute", "k"), "complete", "windows").collect()
    assert sorted((r["k"], r["count"]) for r in got) == [(0, 10)] * 3 + [(1, 10)] * 3
