"""The frontier as a stream: keyed state of each host, with sessions, the seen set, budgets and an event when a queue ends.

Needs the RocksDB state store:
spark.sql.streaming.stateStore.providerClass=org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: kind is `found` (a link or seed), `done` (an outcome), `lock`, `unlock` (the host changes hands) or `wake` (a place for the host is free).
EVENTS = "host string, n long, kind string, url string, ok boolean, ttr_ms long, at_ms long"
#: kind is `fetch` (url is due at at_ms), `idle` (the session is over and URLs wait) or `empty` (the queue has ended).
ACTIONS = "host string, n long, kind string, url string, at_ms long, weight long"


def _rate(ttr: int) -> np.float32:
    return np.float32(np.float32(max(ttr, 0)) / np.float32(5000))


def weight_of(ttr: int | None, default: int) -> int:
    return 1 if ttr is None else max(1, int(_rate(ttr) * np.float32(default)))


def budget_of(ttr: int | None, default: int) -> int:
    return default if ttr is None else max(0, int((np.float32(1) - _rate(ttr)) * np.float32(default)))


class Host(StatefulProcessor):
    """One host: a FIFO of URLs, what was processed, and the running session. One URL is in flight at a time."""

    def __init__(self, session_budget: int, politeness: int, idle_ms: int):
        self.default, self.politeness, self.idle_ms = session_budget, politeness, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.facts = handle.getValueState("facts", "head long, tail long, ttr long, next long, budget long, active boolean, locked boolean, flying boolean, begun boolean, n long, count long")
        self.queue = handle.getMapState("queue", "seq long", "url string, weight long")
        self.seen = handle.getMapState("seen", "url string", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        head, tail, ttr, due, budget, active, locked, flying, begun, n, count = self.facts.get() if self.facts.exists() else (0, 0, None, 0, self.default, True, False, False, False, 0, 0)
        out: list[tuple] = []
        events = pd.concat(list(rows)).sort_values("n", kind="stable")
        for e in events.itertuples(index=False):
            n = max(n, int(e.n))
            now = 0 if pd.isna(e.at_ms) else int(e.at_ms)
            if e.kind == "found" and not self.seen.containsKey((e.url,)):
                self.queue.updateValue((tail,), (e.url, weight_of(ttr, self.default)))
                tail += 1
            elif e.kind == "done":
                flying = False
                took = 0 if pd.isna(e.ttr_ms) else int(e.ttr_ms)
                if e.ok:
                    ttr = took
                due = now + (1000 if ttr is None else ttr * self.politeness)
                self.seen.updateValue((e.url,), (now,))
            elif e.kind in ("lock", "unlock"):
                locked = e.kind == "lock"
            elif e.kind == "wake" and not active:
                active, begun, budget = True, False, budget_of(ttr, self.default)
            while active and not locked and not flying:
                if head == tail:
                    if begun:
                        out.append((key[0], n, "empty", None, due, None))
                        active = begun = False
                    break
                if begun and budget <= 0:
                    out.append((key[0], n, "idle", None, due, None))
                    active = begun = False
                    break
                url, weight = self.queue.getValue((head,))
                self.queue.removeKey((head,))
                head, budget, begun = head + 1, budget - weight, True
                if not self.seen.containsKey((url,)):  # a repeat costs its weight all the same
                    flying = True
                    out.append((key[0], n, "fetch", url, max(due, now), weight))
            if e.kind == "found" and not active and head < tail and not begun and not flying and tail - head == 1:
                out.append((key[0], n, "idle", None, due, None))  # it was empty and waits for a place now
        self.facts.update((head, tail, ttr, due, budget, active, locked, flying, begun, n, count + len(events)))
        if self.idle_ms:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ACTIONS.split(", ")]).astype({"weight": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A URL in flight for idle_ms without an outcome counts as failed, so that its host goes on."""
        if self.facts.exists():
            facts = list(self.facts.get())
            if facts[7]:
                facts[7] = False
                self.facts.update(tuple(facts))
                yield pd.DataFrame([(key[0], facts[9], "lost", None, facts[3], None)], columns=[c.split()[0] for c in ACTIONS.split(", ")]).astype({"weight": "Int64"})

    def close(self) -> None:
        pass


def actions(events: DataFrame, session_budget: int = 5, politeness: int = 5, idle_ms: int = 0) -> DataFrame:
    """ACTIONS from a stream of EVENTS; n orders a host's events within a batch. idle_ms above 0 sets a processing-time timer on each host."""
    return events.groupBy("host").transformWithStateInPandas(Host(session_budget, politeness, idle_ms), ACTIONS, "append", "processingTime" if idle_ms else "none")


def moved_events(moved: DataFrame, kind: str = "lock") -> DataFrame:
    """`lock` or `unlock` events for hosts that change hands, as a periodic check of ownership finds them (ring.moved)."""
    return moved.select("host", F.lit(0).cast("long").alias("n"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("boolean").alias("ok"), F.lit(None).cast("long").alias("ttr_ms"), F.lit(None).cast("long").alias("at_ms"))
