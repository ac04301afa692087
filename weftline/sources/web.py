"""Pages and robots files over HTTP, fetched by the executors; the same seam takes any other transport."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import robots, urls

AGENT = "Mozilla/5.0"
FETCHED = "url string, body binary, ttr_ms long, error string"
FORBIDDEN = "crawling is forbidden by robots.txt"

Get = Callable[[str, float, str], bytes]


def http_get(url: str, timeout_s: float, agent: str) -> bytes:
    """The body of whatever the server answers, an error page included."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=timeout_s) as answer:
            return answer.read()
    except urllib.error.HTTPError as e:
        return e.read()


def fetch(rows: DataFrame, timeout_ms: int = 3000, agent: str = AGENT, get: Get = http_get) -> DataFrame:
    """(url, body, ttr_ms, error) of each row's url. A failure has a text in `error` and neither body nor time."""

    def run(batches):
        for pdf in batches:
            out = []
            for u in pdf["url"]:
                began = time.monotonic()
                try:
                    body = get(u, timeout_ms / 1000, agent)
                    out.append((u, body, int((time.monotonic() - began) * 1000), None))
                except Exception as e:  # whatever a transport raises is this URL's outcome
                    out.append((u, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["url", "body", "ttr_ms", "error"]).astype({"ttr_ms": "Int64"})

    return rows.select("url").mapInPandas(run, FETCHED)


def text(body):
    """Bytes as text; what isn't UTF-8 is replaced."""
    return F.decode(F.coalesce(body, F.lit(b"")), "UTF-8") if hasattr(F, "decode") else body.cast("string")


def visit(emitted: DataFrame, robots_agent: str = "gobot", keep: Callable[[DataFrame], DataFrame] = lambda df: df, **how) -> DataFrame:
    """(host, seq, url, ok, ttr_ms, links, body, error) of emitted (host, seq, url).

    The robots file of each origin is fetched once; a URL whose robots file can't be fetched fails with that error, one that it forbids
    with FORBIDDEN, and neither is fetched. keep stores what was fetched, so that no later action fetches it again.
    """
    asked = emitted.withColumn("robots", urls.robots_url(F.col("url")))
    files = keep(fetch(asked.select(F.col("robots").alias("url")).distinct(), **how))
    bodies = files.filter("error is null").select(F.col("url").alias("origin_host"), text(F.col("body")).alias("body"))
    # rules are by robots URL here, as a host can have several ports
    checked = robots.check(asked.select("seq", "url", F.col("robots").alias("host"), F.col("host").alias("name")), robots.rules(bodies), robots_agent)
    checked = checked.join(files.select(F.col("url").alias("host"), F.col("error").alias("robots_error")), "host", "left")
    barred = F.coalesce(F.col("robots_error"), F.when(~F.col("allowed"), FORBIDDEN))
    known = checked.select(F.col("name").alias("host"), "seq", "url", barred.alias("barred"))
    got = keep(fetch(known.filter("barred is null").select("url").distinct(), **how))
    out = known.join(got, "url", "left").withColumn("page", F.when(F.col("body").isNotNull(), urls.parse_pages("url", text(F.col("body")))))
    error = F.coalesce("barred", "error")
    return out.select("host", "seq", "url", error.isNull().alias("ok"), "ttr_ms", F.col("page.links").alias("links"), "body", error.alias("error"))
