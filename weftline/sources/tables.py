"""Input tables, and the crawl log that is derived from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBERS = ("10.0.0.1:9000", "10.0.0.2:9000", "10.0.0.3:9000")
JOINED = (*MEMBERS, "10.0.0.4:9000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crawl_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, host, url, done_at, ok, ttr_ms): events as outcomes of fetches."""
    host = F.concat(F.lit("h"), F.col("user_id").cast("string"), F.lit(".example.com"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        host.alias("host"),
        F.concat(F.lit("https://"), host, F.lit("/"), "event_type", F.lit("/"), (F.col("event_id") % 7).cast("string")).alias("url"),
        F.col("ts").cast("timestamp").alias("done_at"),
        (F.col("event_type") != "error").alias("ok"),
        F.floor(F.col("value") * 10).cast("long").alias("ttr_ms"),
    )


def members(spark: SparkSession, addrs=MEMBERS) -> DataFrame:
    return spark.createDataFrame([(a,) for a in addrs], "addr string")


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, url) of a seed list, up to its first line that isn't a URL."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "url"))
    parsed = lines.withColumn("bad", F.col("url").rlike(r"[\x00-\x20\x7f]|%(?![0-9A-Fa-f]{2})|^:|^[A-Za-z][A-Za-z0-9+.-]*://\[[^\]]*$|^[^/?#]*//[^/?#]*:[^0-9/?#@][^@/?#]*([/?#]|$)"))
    first_bad = parsed.agg(F.min(F.when(F.col("bad"), F.col("line_no"))).alias("stop"))
    return parsed.crossJoin(F.broadcast(first_bad)).filter("url <> '' and (stop is null or line_no < stop)").select(F.col("line_no").cast("long").alias("line_no"), "url")
