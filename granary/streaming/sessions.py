"""The search log as a stream: sittings by session windows, outcomes by keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_stream(events: DataFrame, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """(actor, session_start, session_end, n_events), appended once a sitting is over and the watermark past it.

    ``events`` has actor and the event time ``time``. Events delivered again under one number within the watermark count once; later than that they
    are dropped, which bounds the state.
    """
    once = events.withWatermark("time", lateness).dropDuplicatesWithinWatermark(["event_no"]).where("actor <> ''")
    cut = once.groupBy("actor", F.session_window("time", gap).alias("w")).agg(F.max("time").alias("session_end"), F.count("*").alias("n_events"))
    return cut.select("actor", F.col("w.start").alias("session_start"), "session_end", "n_events")


_OUT = "actor string, event_no long, time timestamp, outcome string"
_STATE = "event_no long, time timestamp, query string, results long, page long"


def outcome_stream(events: DataFrame, follow_seconds: int = 120, overlap: float = 0.2, lateness: str = "10 minutes") -> DataFrame:
    """(actor, event_no, time, outcome): each search's outcome when the next one of the actor comes, or settled when the follow window has passed.

    State is one pending search per actor. Within a trigger an actor's events are taken in order of time.
    """

    def outcome(prev: tuple, after: tuple | None) -> str:
        _, time, query, results, page = prev
        if results == 0:
            return "zero"
        if after is not None and (after[1] - time).total_seconds() <= follow_seconds:
            a, b = set(query.split()), set(after[2].split())
            if query == after[2]:
                return "repeat"
            return "reformulated" if a and b and len(a & b) / len(a | b) >= overlap else "switched"
        return "page_2" if page > 1 else "settled"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        pending = tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            out.append((key[0], pending[0], pending[1], outcome(pending, None)))
            state.remove()
        else:
            rows = pd.concat(list(batches)).sort_values(["time", "event_no"])
            for r in rows.itertuples():
                now = (int(r.event_no), r.time, r.query, int(r.results), int(r.page))
                if pending is not None:
                    out.append((key[0], pending[0], pending[1], outcome(pending, now)))
                pending = now
            state.update(pending)
            # The last search is decided when the watermark has passed its follow window.
            due = int(pending[1].timestamp() * 1000) + (follow_seconds + 1) * 1000
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["actor", "event_no", "time", "outcome"])

    rows = events.withWatermark("time", lateness).where("actor <> ''").select("actor", "event_no", "time", "query", "results", "page")
    return rows.groupBy("actor").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
