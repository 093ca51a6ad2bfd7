"""Structured Streaming forms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vellum.operators.redact import redact_texts
from vellum.operators.registry import identities, seen

_ROW = "key string, email string, name string, first_seen_at timestamp, last_seen_at timestamp"
_STATE = "email string, email_at timestamp, name string, name_at timestamp, first timestamp, last timestamp"


def _keep(forget_ms: int):
    """An identity's row from its events and what is held of it, which is forgotten ``forget_ms`` after its last sight."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get) if state.exists else [None] * 6
        for frame in frames:
            last = frame.sort_values(["ts", "email"]).iloc[-1]
            named = frame[frame["name"].notna()].sort_values(["ts", "name"])
            if held[1] is None or (last["ts"], last["email"]) >= (held[1], held[0]):
                held[0], held[1] = last["email"], last["ts"]
            if len(named) and (held[3] is None or (named.iloc[-1]["ts"], named.iloc[-1]["name"]) >= (held[3], held[2])):
                held[2], held[3] = named.iloc[-1]["name"], named.iloc[-1]["ts"]
            held[4] = min([x for x in (held[4], frame["ts"].min()) if x is not None])
            held[5] = max([x for x in (held[5], frame["ts"].max()) if x is not None])
        state.update(tuple(held))
        # Past the watermark already: it goes with the next batch.
        due = max(int(pd.Timestamp(held[5]).tz_localize("UTC").timestamp() * 1000) + forget_ms, state.getCurrentWatermarkMs() + 1)
        state.setTimeoutTimestamp(due)
        yield pd.DataFrame([[key[0], held[0], held[2], held[4], held[5]]], columns=["key", "email", "name", "first_seen_at", "last_seen_at"])

    return run


def observed_users_stream(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, forget_after_days: float | None = None, late: str = "1 hour") -> StreamingQuery:
    """Identities of a stream, kept up to date: each batch hands ``sink`` the rows that changed.

    The state is a row an identity; late events only move the first or last sight.  With
    ``forget_after_days`` an identity leaves the state when the watermark, ``late`` behind
    the newest event, has passed its last sight by as many days, so the state holds those
    of a period and not of all time.  One that comes back after that begins anew: a sink
    that keeps the earlier rows joins them with ``registry.merge_users``.
    """
    rows = identities(events)
    if forget_after_days is None:
        changed = seen(rows)
    else:
        rows = rows.where("ts is not null").withWatermark("ts", late)
        changed = rows.groupBy("key").applyInPandasWithState(_keep(int(forget_after_days * 86_400_000)), _ROW, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return changed.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()


def redact_stream(docs: DataFrame, path: str, checkpoint: str, text_col: str = "text") -> StreamingQuery:
    """Whole documents redacted as they arrive, appended as Parquet; stateless."""
    redacted = redact_texts(docs, text_col)
    return redacted.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
