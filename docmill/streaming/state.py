"""Keyed state over streams: candidate lists, prepared sendings with their time to live, assembled messages.

The rules are those of docmill.operators.registry and messages; each has a batch twin there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docmill.operators.registry import SOURCES, VALID_SECONDS

CANDIDATES = "client string, source string, seq long, count int, results array<string>"


def _timeout(idle_ms: int | None) -> str:
    """Timeouts by the clock keep a query with the trigger availableNow from ending, so they are asked for."""
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def candidate_stream(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(client, source, seq, count, results) after each micro-batch, for the clients that it touched; results can be looked up by index.

    events: client, source, seq, ok, results (array<string>), cleared. State: one list a source and client, keyed by client.
    A failed search clears its list, a failed folder listing leaves it, a cleared client loses all. A client without lists
    has no state, and one that is idle for idle_ms, if given, loses it.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else {}
        for r in sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: r.seq):
            if r.cleared:
                held = {}
            elif r.source in SOURCES and r.ok:
                held[r.source] = [int(r.seq), [str(x) for x in r.results] if r.results is not None else []]
            elif r.source == SOURCES[0]:
                held.pop(r.source, None)
        if held:
            state.update((json.dumps(held),))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(key[0], s, q, len(x), x) for s, (q, x) in sorted(held.items())], columns=["client", "source", "seq", "count", "results"])

    return events.groupBy("client").applyInPandasWithState(update, CANDIDATES, "held string", "update", _timeout(idle_ms))


CONSUMED = "token string, client string, outcome string"


def pending_stream(events: DataFrame, seconds: int = VALID_SECONDS) -> DataFrame:
    """(token, client, outcome): sent, expired or unknown for each consumption.

    events: token, client, kind (prepare or consume), at (timestamp with a watermark). A token is sent once, by its client,
    at most `seconds` after it was prepared, both included; another client leaves it as it is. State: client and time of a
    token, dropped when it is sent or its time has passed the watermark.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        client, created = state.get if state.exists else (None, None)
        out = []
        for r in sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: (r.at, r.kind != "prepare")):
            now = r.at.timestamp()
            if r.kind == "prepare":
                client, created = r.client, now
            elif client is None or client != r.client:
                out.append((key[0], r.client, "unknown"))
            elif now - created > seconds:
                out.append((key[0], r.client, "expired"))
                client = None
            else:
                out.append((key[0], r.client, "sent"))
                client = None
        if client is None:
            if state.exists:
                state.remove()
        else:
            state.update((client, created))
            state.setTimeoutTimestamp(max(int((created + seconds) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["token", "client", "outcome"])

    return events.groupBy("token").applyInPandasWithState(update, CONSUMED, "client string, created double", "append", GroupStateTimeout.EventTimeTimeout)


MESSAGES = "run_id string, message_id string, text string, reasoning string, calls int"


def message_stream(chunks: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(run_id, message_id, text, reasoning, calls): each message of a run once it is closed.

    chunks: run_id, seq, message_id, kind (text, reasoning, call, flush), text, last. A message is closed by its last chunk,
    by a chunk of another message, or by a flush; a flush closes only a message that has text or reasoning. A run without an
    open message has no state; one that is idle for idle_ms, if given, closes its open message as a flush does.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            current, text, reasoning, calls = state.get
            state.remove()
            if text or reasoning:
                yield pd.DataFrame([(key[0], current, text, reasoning, calls)], columns=["run_id", "message_id", "text", "reasoning", "calls"])
            return
        current, text, reasoning, calls = state.get if state.exists else ("", "", "", 0)
        out = []
        for r in sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: r.seq):
            if current and (r.kind == "flush" or r.message_id != current):
                if r.kind != "flush" or text or reasoning:
                    out.append((key[0], current, text, reasoning, calls))
                current, text, reasoning, calls = "", "", "", 0
            if r.kind == "flush":
                continue
            current = r.message_id
            text += (r.text or "") if r.kind == "text" else ""
            reasoning += (r.text or "") if r.kind == "reasoning" else ""
            calls += r.kind == "call"
            if r.last:
                out.append((key[0], current, text, reasoning, calls))
                current, text, reasoning, calls = "", "", "", 0
        if current:
            state.update((current, text, reasoning, int(calls)))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["run_id", "message_id", "text", "reasoning", "calls"])

    return chunks.groupBy("run_id").applyInPandasWithState(update, MESSAGES, "current string, text string, reasoning string, calls int", "append", _timeout(idle_ms))


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first event of each thread, type and call id, within the time that events may be late."""
    rows = events.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    return rows.dropDuplicatesWithinWatermark(["thread_id", "type", "call_id"])


def latency_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, type, n, mean_value): events and mean value in each window of event time."""
    rows = events.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", size), "type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("window.start").alias("start"), "type", "n", "mean_value")
