"""The crawl's counters: processed and good URLs, observed where rows pass and summed over a stream's batches."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

NAME = "crawl_counters"


def _counts():
    return F.count(F.lit(1)).alias("processed"), F.count_if(F.coalesce("ok", F.lit(False))).alias("good")


def observed(outcomes: DataFrame) -> tuple[DataFrame, Observation]:
    """outcomes, and the counters of the first action on them; no pass of its own."""
    seen = Observation(NAME)
    return outcomes.observe(seen, *_counts()), seen


def observe_stream(outcomes: DataFrame) -> DataFrame:
    return outcomes.observe(NAME, *_counts())


class Counters(StreamingQueryListener):
    """Sums what observe_stream reports, batch by batch, and shows it as a metrics page."""

    def __init__(self):
        self.total: Counter = Counter()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(NAME)
        if row is not None:
            self.total.update({k: row[k] or 0 for k in ("processed", "good")})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def exposition(self) -> str:
        """The counters as the text that a metrics scraper reads."""
        names = {"processed": "crawler_processed_total", "good": "crawler_processed_total_good"}
        return "".join(f"# TYPE {n} counter\n{n} {self.total[k]}\n" for k, n in names.items())
