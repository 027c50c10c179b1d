"""Streams of ticks: bars by event time, late ticks within a watermark counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def tick_stream(spark: SparkSession, path: str) -> DataFrame:
    """Ticks from the events table as it grows, or from any folder of Parquet files with its schema."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        events = reader.parquet(path)
    else:  # a stream reads folders, so of this one the file of that name
        folder, name = path.rsplit("/", 1)
        events = reader.option("pathGlobFilter", name).parquet(folder)
    return events.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), "event_id")


def stream_bars(ticks: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(symbol, bar, open, high, low, close, n), each bar once: when the watermark has passed its end, and its state goes.

    Ticks up to ``late`` behind the latest one are counted, later ones are not.
    """
    key = F.struct("ts", "event_id")
    out = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", length)).agg(F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.count("price").alias("n"))
    return out.select("symbol", F.col("window.start").alias("bar"), "open", "high", "low", "close", "n")


def appended(out: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now, and return all that it has written so far.

    Each batch has a folder of its own, so a batch that is run again after a failure replaces itself.
    """
    write = lambda df, batch: df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")
    query = out.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return out.sparkSession.read.schema(out.schema.add("batch", "long")).parquet(folder).drop("batch")


#: Names the tick that ends a stream: it only moves the watermark past all others.
END = "end of stream"


def replayed(events: DataFrame, folder: str, parts: int = 3, length: str = "1 hour") -> DataFrame:
    """The bars of an events table that arrives as a stream: in ``parts`` stretches of time, with a restart after each."""
    spark = events.sparkSession
    events = events.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    low, high = events.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    if low is None:
        low = high = 0
    last = spark.range(1).select(F.col("id").alias("event_id"), F.lit(END).alias("event_type"), F.timestamp_seconds(F.lit(high + 10 * 86_400)).alias("ts"), F.lit(None).cast("double").alias("value"))
    last = last.select(*(F.col(c).cast(events.schema[c].dataType).alias(c) for c in events.columns))
    out = None
    for part in range(parts + 1):
        a, b = (low + (high + 1 - low) * k // parts for k in (part, part + 1))
        new = events.where((F.unix_seconds("ts") >= a) & (F.unix_seconds("ts") < b)) if part < parts else last
        new.write.mode("append").parquet(f"{folder}/ticks")
        out = appended(stream_bars(tick_stream(spark, f"{folder}/ticks"), length), f"{folder}/bars", f"{folder}/checkpoint")
    return out
