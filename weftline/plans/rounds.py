"""One round of the crawl as a plan over the frontier's tables, and a snapshot to go on from."""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scheduling, urls
from ..operators import frontier
from ..sources.shared import cut

QUEUE = "host string, seq long, url string, weight long"
SEEN = "host string, url string"
HOSTS = "host string, status string, ttr_ms long, next_at_ms long, budget long, locked boolean, inactive_rank long"


@dataclass(frozen=True)
class Conf:
    max_active: int = 512
    politeness: int = 5
    session_budget: int = 5


@dataclass(frozen=True)
class State:
    queue: DataFrame
    seen: DataFrame
    hosts: DataFrame

    def save(self, folder: str, version: int) -> State:
        """Writes the snapshot, which also cuts the lineage, and reads it back."""
        spark = self.queue.sparkSession
        for name in ("queue", "seen", "hosts"):
            getattr(self, name).write.mode("overwrite").parquet(posixpath.join(folder, f"v{version}", name))
        return State.load(spark, folder, version)

    @staticmethod
    def load(spark: SparkSession, folder: str, version: int) -> State:
        return State(*(spark.read.schema(s).parquet(posixpath.join(folder, f"v{version}", n)) for n, s in (("queue", QUEUE), ("seen", SEEN), ("hosts", HOSTS))))


def start(spark: SparkSession) -> State:
    return State(spark.createDataFrame([], QUEUE), spark.createDataFrame([], SEEN), spark.createDataFrame([], HOSTS))


def _facts(hosts: DataFrame) -> tuple[int, int]:
    """Hosts that are ready, and the rank behind the last inactive one."""
    r = hosts.agg(F.count_if(F.col("status") == "ready").alias("n"), F.max("inactive_rank").alias("top")).first()
    return r["n"], 0 if r["top"] is None else r["top"] + 1


def put(state: State, found: DataFrame, conf: Conf, now_ms: int = 0, facts: tuple[int, int] | None = None) -> State:
    """state with found (url, ord) behind the hosts' queues: what is processed already is dropped, weights are fixed now, and new hosts join while there is room."""
    own = frontier.unseen(found.withColumn("host", urls.host(F.col("url"))), state.seen)
    weighted = own.join(state.hosts.select("host", "ttr_ms"), "host", "left").withColumn("weight", scheduling.url_weight(F.col("ttr_ms"), conf.session_budget))
    fresh = own.groupBy("host").agg(F.min("ord").alias("first_seq")).join(state.hosts.select("host"), "host", "left_anti")
    active, behind = facts or _facts(state.hosts)
    ranked = frontier.admit(fresh, max(0, conf.max_active - active))
    rank = F.when(~F.col("active"), F.col("first_seq") + behind)
    new = ranked.select("host", F.when(F.col("active"), "ready").otherwise("inactive").alias("status"), F.lit(None).cast("long").alias("ttr_ms"), F.lit(now_ms).cast("long").alias("next_at_ms"), F.lit(conf.session_budget).cast("long").alias("budget"), F.lit(False).alias("locked"), rank.cast("long").alias("inactive_rank"))
    return State(frontier.push(state.queue, weighted), state.seen, state.hosts.unionByName(new))


def wake(state: State, conf: Conf) -> State:
    """state with inactive hosts in the free places, with budgets by response time; hosts passed over on the way go behind the rest."""
    free = max(0, conf.max_active - _facts(state.hosts)[0])
    if not free:
        return state
    chosen = frontier.available(state.hosts, state.queue, free).select("host", F.lit(True).alias("__up"))
    turned = frontier.rotate(state.hosts, state.queue, free).select("host", F.col("inactive_rank").alias("__rank"))
    up = F.coalesce("__up", F.lit(False))
    hosts = state.hosts.join(chosen, "host", "left").join(turned, "host", "left")
    hosts = hosts.withColumns({"budget": F.when(up, scheduling.session_budget(F.col("ttr_ms"), conf.session_budget)).otherwise(F.col("budget")), "status": F.when(up, "ready").otherwise(F.col("status")), "inactive_rank": F.when(~up, F.coalesce("__rank", "inactive_rank"))})
    return State(state.queue, state.seen, hosts.drop("__up", "__rank"))


def schedule(state: State) -> tuple[DataFrame, DataFrame]:
    """(charged, emitted): what the sessions take, and of that what is neither processed already nor taken twice."""
    ready = state.hosts.filter("status = 'ready' and not locked").select("host", "budget")
    charged = frontier.session_prefix(state.queue.join(ready, "host"), F.col("budget"))
    again = F.row_number().over(W.partitionBy("host", "url").orderBy("seq"))
    return charged, frontier.unseen(charged.withColumn("__n", again).filter("__n = 1").drop("__n"), state.seen)


def timed(outcomes: DataFrame, hosts: DataFrame, conf: Conf) -> DataFrame:
    """outcomes (host, seq, url, ok, ttr_ms) with `at_ms`, `done_ms` and `next_ms`; hosts are serial, so a host's times are running sums.

    A worker that has a URL waits for the host's next time, but for LONGEST_WAIT_MS at most.
    """
    own = outcomes.join(hosts.select("host", F.col("ttr_ms").alias("__rt"), "next_at_ms"), "host")
    known = F.coalesce(F.last(F.when(F.col("ok"), F.col("ttr_ms")), True).over(frontier.by_host().rowsBetween(W.unboundedPreceding, 0)), "__rt")
    took = F.coalesce("ttr_ms", F.lit(0).cast("long"))
    own = own.withColumn("__wait", scheduling.next_access_ms(F.lit(0).cast("long"), known, conf.politeness))
    step = took + F.least(F.col("__wait"), F.lit(scheduling.LONGEST_WAIT_MS).cast("long"))
    before = F.coalesce(F.sum(step).over(frontier.by_host().rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = own.withColumn("at_ms", F.col("next_at_ms") + before)
    return own.withColumn("done_ms", F.col("at_ms") + took).withColumn("next_ms", F.col("done_ms") + F.col("__wait")).drop("__rt", "__wait", "next_at_ms")


def crawl_round(state: State, fetch: Callable[[DataFrame], DataFrame], conf: Conf) -> tuple[State, DataFrame]:
    """The state after one round and its outcomes: the columns of fetch with at_ms, done_ms and next_ms.

    fetch turns the emitted rows (host, seq, url) into rows with ok, ttr_ms and links, and whatever else it reports. Links see the response times and the seen set
    of the round's begin; what a round processed is dropped when it is dequeued again, at its budget's cost. Hosts and outcomes are cut, so nothing is fetched twice.
    """
    state = wake(state, conf)
    state = State(state.queue, state.seen, cut(state.hosts))
    facts = _facts(state.hosts)
    charged, emitted = schedule(state)
    outcomes = cut(timed(fetch(emitted.select("host", "seq", "url")), state.hosts, conf))
    rest = state.queue.join(charged.select("host", "seq"), ["host", "seq"], "left_anti")
    place = F.struct("done_ms", "host", "seq", "pos")
    links = outcomes.filter("ok").select("done_ms", "host", "seq", F.posexplode("links").alias("pos", "url")).select("url", place.alias("ord"))
    spent = charged.groupBy("host").agg(F.sum("weight").alias("spent"))
    ttr = outcomes.filter("ok").groupBy("host").agg(F.max_by("ttr_ms", "seq").alias("last"))
    later = outcomes.groupBy("host").agg(F.max("next_ms").alias("later"))
    left = rest.select("host").distinct().withColumn("more", F.lit(True))
    hosts = state.hosts.join(spent, "host", "left").join(ttr, "host", "left").join(later, "host", "left").join(left, "host", "left")
    budget = F.greatest(F.lit(0).cast("long"), F.col("budget") - F.coalesce("spent", F.lit(0)))
    over = (F.col("status") == "ready") & ~F.col("locked") & ((budget <= 0) | F.col("more").isNull())
    rank = F.when(over, F.coalesce("later", "next_at_ms") + facts[1]).otherwise(F.col("inactive_rank"))
    hosts = hosts.select("host", F.when(over, "inactive").otherwise(F.col("status")).alias("status"), F.coalesce("last", "ttr_ms").alias("ttr_ms"), F.coalesce("later", "next_at_ms").alias("next_at_ms"), budget.alias("budget"), "locked", rank.cast("long").alias("inactive_rank"))
    before = State(rest, state.seen, state.hosts)
    numbered = links.withColumn("__o", F.row_number().over(W.partitionBy(urls.host(F.col("url"))).orderBy("ord")).cast("long")).select("url", F.col("__o").alias("ord"))
    grown = put(before, numbered, conf, facts=facts)
    new_hosts = grown.hosts.join(state.hosts.select("host"), "host", "left_anti")
    return State(grown.queue, frontier.mark_seen(state.seen, outcomes), hosts.unionByName(new_hosts)), outcomes


def crawl(state: State, fetch: Callable[[DataFrame], DataFrame], conf: Conf, folder: str, most: int, first: int = 0) -> tuple[State, int]:
    """Rounds until nothing is queued, `most` at most: the last state, and the number of the next round.

    Each round leaves its outcomes in folder/outcomes/round=N and its snapshot in folder/vN, from which a later call goes on with first=N + 1.
    """
    for number in range(first, first + most):
        if state.queue.isEmpty():
            return state, number
        state, outcomes = crawl_round(state, fetch, conf)
        outcomes.write.mode("overwrite").parquet(posixpath.join(folder, "outcomes", f"round={number}"))
        state = state.save(folder, number)
    return state, first + most


def hand_over(state: State, moved: DataFrame) -> tuple[State, State]:
    """(kept, given): the hosts of moved (host, ...) leave with queue and seen set, unlocked for their new owner; the others stay."""
    gone = moved.select("host").distinct()
    part = lambda df, how: df.join(gone, "host", how)
    given = State(*(part(df, "left_semi").select(df.columns) for df in (state.queue, state.seen, state.hosts)))
    kept = State(*(part(df, "left_anti").select(df.columns) for df in (state.queue, state.seen, state.hosts)))
    return kept, State(given.queue, given.seen, given.hosts.withColumn("locked", F.lit(False)))


def lock(state: State, moved: DataFrame, locked: bool = True) -> State:
    """state with the hosts of moved locked, so that no session takes from them while they change hands; or unlocked again."""
    mark = moved.select("host").distinct().withColumn("__m", F.lit(True))
    hosts = state.hosts.join(mark, "host", "left").withColumn("locked", F.when(F.col("__m"), F.lit(locked)).otherwise(F.col("locked"))).drop("__m")
    return State(state.queue, state.seen, hosts)


def take_over(state: State, given: State) -> State:
    """state with what another member gave: its queues behind the own ones, the union of the seen sets, and its hosts where there are none yet."""
    queued = given.queue.select("host", "url", "weight", F.col("seq").alias("ord"))
    own = frontier.unseen(queued, state.seen)
    return State(frontier.push(state.queue, own), frontier.mark_seen(state.seen, given.seen), state.hosts.unionByName(given.hosts.join(state.hosts.select("host"), "host", "left_anti")))
