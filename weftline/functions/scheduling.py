"""Budgets, weights and times of the polite schedule. The rate is a float32 throughout, as the crawl protocol defines it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_DELAY_MS = 1000
LONGEST_WAIT_MS = 10_000
SLOWEST_MS = 5000


def _f(x) -> Column:
    return F.lit(x).cast("float")


def norm_rt(ttr_ms: Column) -> Column:
    """The response time as a share of SLOWEST_MS; null if it isn't known."""
    return (F.greatest(ttr_ms, F.lit(0).cast("long")).cast("float") / _f(SLOWEST_MS)).cast("float")


def session_budget(ttr_ms: Column, default: int) -> Column:
    own = F.greatest(F.lit(0).cast("long"), ((_f(1) - norm_rt(ttr_ms)) * _f(default)).cast("long"))
    return F.coalesce(own, F.lit(default).cast("long"))


def url_weight(ttr_ms: Column, default: int) -> Column:
    one = F.lit(1).cast("long")
    return F.coalesce(F.greatest(one, (norm_rt(ttr_ms) * _f(default)).cast("long")), one)


def next_access_ms(done_ms: Column, ttr_ms: Column, politeness: int) -> Column:
    return done_ms + F.coalesce(ttr_ms * politeness, F.lit(DEFAULT_DELAY_MS).cast("long"))


def effective_wait_ms(at_ms: Column, now_ms: Column) -> Column:
    return F.least(F.lit(LONGEST_WAIT_MS).cast("long"), F.greatest(F.lit(0).cast("long"), at_ms - now_ms))
