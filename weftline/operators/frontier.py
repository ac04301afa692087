"""Host queues, the seen set and sessions of a crawl frontier over DataFrames.

Tables: queue (host, seq, url, weight), seen (host, url), host_state (host, status, ttr_ms, next_at_ms, budget, locked,
inactive_rank). Everything is keyed by host, so a round's windows, joins and groupings can share one partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def by_host():
    return W.partitionBy("host").orderBy("seq")


def fifo(queue: DataFrame) -> DataFrame:
    return queue.withColumn("rn", F.row_number().over(by_host()).cast("long"))


def peek(queue: DataFrame) -> DataFrame:
    return queue.groupBy("host").agg(F.min_by("url", "seq").alias("url"), F.min("seq").alias("seq"))


def pop(queue: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The first n of each host, and the rest."""
    ranked = fifo(queue)
    return ranked.filter(F.col("rn") <= n).drop("rn"), ranked.filter(F.col("rn") > n).drop("rn")


def push(queue: DataFrame, new: DataFrame) -> DataFrame:
    """queue with new (host, url, weight, ord) at each host's tail, by ord."""
    tail = queue.groupBy("host").agg(F.max("seq").alias("tail"))
    rows = new.join(tail, "host", "left").withColumn("seq", F.coalesce("tail", F.lit(-1).cast("long")) + F.row_number().over(W.partitionBy("host").orderBy("ord", "url")))
    return queue.unionByName(rows.select(*queue.columns))


def length(queue: DataFrame) -> DataFrame:
    return queue.groupBy("host").agg(F.count("*").alias("n"))


def bounds(queue: DataFrame) -> DataFrame:
    return queue.groupBy("host").agg(F.min("seq").alias("head"), (F.max("seq") + 1).alias("tail"))


def session_prefix(queue: DataFrame, budget: Column) -> DataFrame:
    """What one session takes: rows while the weights before them are below the budget, and the first in any case."""
    spent = F.coalesce(F.sum("weight").over(by_host().rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return queue.withColumn("__spent", spent).withColumn("__rn", F.row_number().over(by_host())).filter((F.col("__spent") < budget) | (F.col("__rn") == 1)).drop("__spent", "__rn")


def sessions(queue: DataFrame, budget: int) -> DataFrame:
    """queue with `session`: consecutive sessions of one budget; the row that spends it ends its session. One pass over sorted partitions, which holds a batch at a time."""

    def fold(batches):
        last, left, number = None, budget, 0
        for pdf in batches:
            out = []
            for host, weight in zip(pdf["host"], pdf["weight"], strict=True):
                if host != last:
                    last, left, number = host, budget, 0
                elif left <= 0:
                    left, number = budget, number + 1
                out.append(number)
                left -= weight
            yield pdf.assign(session=out)[["host", "seq", "session"]]

    return queue.select("host", "seq", "weight").repartition("host").sortWithinPartitions("host", "seq").mapInPandas(fold, "host string, seq long, session long")


def unseen(urls: DataFrame, seen: DataFrame) -> DataFrame:
    return urls.join(seen.select("host", "url"), ["host", "url"], "left_anti")


def mark_seen(seen: DataFrame, outcomes: DataFrame) -> DataFrame:
    return seen.select("host", "url").unionByName(outcomes.select("host", "url")).distinct()


def first_of_each(urls: DataFrame) -> DataFrame:
    return urls.groupBy("host", "url").agg(F.min("seq").alias("seq"))


def last_ttr(outcomes: DataFrame) -> DataFrame:
    """The response time of each host's last success."""
    return outcomes.filter("ok").groupBy("host").agg(F.max_by("ttr_ms", F.struct("done_at", "seq")).alias("ttr_ms"))


def ttr_before(outcomes: DataFrame) -> DataFrame:
    """outcomes with `known_ttr`: the response time known when the row was added."""
    return outcomes.withColumn("known_ttr", F.last(F.when(F.col("ok"), F.col("ttr_ms")), True).over(by_host().rowsBetween(W.unboundedPreceding, -1)))


def admit(hosts: DataFrame, most: int) -> DataFrame:
    """hosts (host, first_seq) with `active`: the first `most` to come. Only the few that are admitted are ranked."""
    chosen = hosts.orderBy("first_seq", "host").limit(most).select("host", F.lit(True).alias("__in"))
    return hosts.join(chosen, "host", "left").withColumn("active", F.coalesce("__in", F.lit(False))).drop("__in")


def next_hosts(host_state: DataFrame, k: int) -> DataFrame:
    return host_state.orderBy("next_at_ms", "host").limit(k)


def available(host_state: DataFrame, queue: DataFrame, slots: int) -> DataFrame:
    """The hosts to wake: inactive, unlocked and not empty, longest inactive first."""
    waiting = host_state.filter("status = 'inactive' and not locked").join(queue.select("host").distinct(), "host", "left_semi")
    return waiting.orderBy("inactive_rank", "host").limit(slots)


def rotate(host_state: DataFrame, queue: DataFrame, slots: int) -> DataFrame:
    """(host, inactive_rank) after waking: who was passed over on the way goes behind the rest."""
    woken = available(host_state, queue, slots)
    last = woken.agg(F.max("inactive_rank").alias("last"))
    rest = host_state.filter("status = 'inactive'").join(woken.select("host"), "host", "left_anti").crossJoin(F.broadcast(last))
    passed = F.coalesce(F.col("inactive_rank") < F.col("last"), F.lit(False)).cast("long")
    span = host_state.agg((F.max("inactive_rank") + 1).alias("span"))
    return rest.crossJoin(F.broadcast(span)).select("host", (F.col("inactive_rank") + passed * F.col("span")).alias("inactive_rank"))


def empty_hosts(host_state: DataFrame, queue: DataFrame) -> DataFrame:
    return host_state.join(queue.select("host").distinct(), "host", "left_anti")
