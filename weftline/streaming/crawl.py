"""The crawl log as a stream: windows of finished fetches, the seen set, and keyed frontier state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def crawl_stream(spark: SparkSession, folder: str, glob: str = "events.parquet", files: int = 1) -> DataFrame:
    """(seq, host, url, done_at, ok, ttr_ms) from files that arrive in folder, at most `files` a trigger."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files).parquet(folder)
    host = F.concat(F.lit("h"), F.col("user_id").cast("string"), F.lit(".example.com"))
    return raw.select(F.col("event_id").alias("seq"), host.alias("host"), F.concat(F.lit("https://"), host, F.lit("/"), "event_type", F.lit("/"), (F.col("event_id") % 7).cast("string")).alias("url"), F.col("ts").cast("timestamp").alias("done_at"), (F.col("event_type") != "error").alias("ok"), F.floor(F.col("value") * 10).cast("long").alias("ttr_ms"))


def windows(log: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, n, good) of tumbling windows."""
    marked = log.withWatermark("done_at", late) if log.isStreaming else log
    return marked.groupBy(F.window("done_at", width)).agg(F.count("*").alias("n"), F.count_if("ok").alias("good")).select(F.col("window.start").alias("start"), "n", "good")


def first_seen(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first row of each URL within the watermark."""
    return log.withWatermark("done_at", late).dropDuplicatesWithinWatermark(["host", "url"])


def host_state(log: DataFrame) -> DataFrame:
    """(host, n, good, ttr_ms): the running state of each host, as often as it changes."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, good, ttr = state.get if state.exists else (0, 0, None)
        rows = pd.concat(list(batches)).sort_values(["done_at", "seq"])
        n, good = n + len(rows), good + int(rows["ok"].sum())
        fine = rows.loc[rows["ok"], "ttr_ms"]
        ttr = int(fine.iloc[-1]) if len(fine) else ttr
        state.update((n, good, ttr))
        yield pd.DataFrame({"host": [key[0]], "n": [n], "good": [good], "ttr_ms": pd.array([ttr], "Int64")})

    shape = "host string, n long, good long, ttr_ms long"
    return log.groupBy("host").applyInPandasWithState(step, shape, "n long, good long, ttr_ms long", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there, into a memory table."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def flush_batches(stream: DataFrame, folder: str, checkpoint: str, every: str = "15 seconds"):
    """Writes each micro-batch under its own number, so that a repeated batch replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=every)
