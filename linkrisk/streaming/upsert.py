"""First-seen upsert of sites as keyed state of a stream (an extension).

The fold of sightings into a site, kept per URL by the stream itself: every
micro-batch gives the rows that it changed.  What the fold keeps of each field
is the place of the sighting that it is from, so that neither the order in which
sightings come nor the way they are cut into batches matters.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state with a time to live needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Sightings: where in the fold each stands is (seen_at, ord), unique for a URL.
SIGHTING = "url string, base_score int, category string, title string, matched_keywords string, seen_at timestamp, ord long"
SITE = "url string, base_score int, category string, title string, matched_keywords string, first_seen_at timestamp, last_seen_at timestamp, seen_count long"
#: Of a URL: its values, and the places (microseconds, ord) of the sightings that gave category, title and keywords.
STATE = "base_score int, category string, category_at long, category_ord long, title string, title_at long, title_ord long, matched_keywords string, keywords_at long, keywords_ord long, first_at long, last_at long, seen_count long"

EMPTY = (-1, "", 0, 0, "", 0, 0, "", 0, 0, None, None, 0)


def folded(state: tuple, rows: pd.DataFrame) -> tuple:
    """The state after more sightings, in whatever order."""
    score, category, c_at, c_ord, title, t_at, t_ord, words, w_at, w_ord, first, last, n = state
    micros = rows["seen_at"].astype("datetime64[us]").astype("int64")
    for s, c, t, w, at, ord_ in zip(rows["base_score"].tolist(), rows["category"].tolist(), rows["title"].tolist(), rows["matched_keywords"].tolist(), micros.tolist(), rows["ord"].tolist()):
        here = (at, ord_)
        if n == 0 or (s, *here) > (score, c_at, c_ord):  # the largest score, of equals the latest
            score, category, c_at, c_ord = s, c, at, ord_
        if t and (not title or here < (t_at, t_ord)):  # the first title that is not empty
            title, t_at, t_ord = t, at, ord_
        if w and (not words or here > (w_at, w_ord)):  # the last keywords that are not empty
            words, w_at, w_ord = w, at, ord_
        first, last, n = at if first is None else min(first, at), at if last is None else max(last, at), n + 1
    return score, category, c_at, c_ord, title, t_at, t_ord, words, w_at, w_ord, first, last, n


class SiteFold(StatefulProcessor):
    """One URL's row; its state goes ``ttl_days`` after it was last seen (0: never)."""

    def __init__(self, ttl_days: int = 0):
        self.ttl_days = ttl_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.site = handle.getValueState("site", STATE, self.ttl_days * 86_400_000 or None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.site.get()) if self.site.exists() else EMPTY
        for some in rows:
            state = folded(state, some)
        self.site.update(state)
        score, category, _, _, title, _, _, words, _, _, first, last, n = state
        at = lambda x: pd.to_datetime([x], unit="us")
        yield pd.DataFrame({"url": [key[0]], "base_score": [score], "category": [category], "title": [title], "matched_keywords": [words], "first_seen_at": at(first), "last_seen_at": at(last), "seen_count": [n]})

    def close(self) -> None:
        pass


def site_stream(sightings: DataFrame, ttl_days: int = 0) -> DataFrame:
    """The row of each URL that a micro-batch of sightings saw, as it is after it.

    sightings: a stream with the columns of SIGHTING; null texts count as empty,
    rows without a URL, a score or a time are left out.  The same rows as
    :func:`linkrisk.operators.sites.merge_sites` gives for all sightings so far.
    Start it with output mode ``update`` and a checkpoint; the session's state
    store is to be PROVIDER.  With a time to live the query looks at the clock
    in every batch, so it takes a trigger by time and never ends by itself.
    """
    names = [c.split()[0] for c in SIGHTING.split(", ")]
    rows = sightings.select(*names).dropna(subset=["url", "base_score", "seen_at", "ord"]).fillna("", subset=["category", "title", "matched_keywords"])
    return rows.groupBy("url").transformWithStateInPandas(statefulProcessor=SiteFold(ttl_days), outputStructType=SITE, outputMode="Update", timeMode="ProcessingTime" if ttl_days else "None")
