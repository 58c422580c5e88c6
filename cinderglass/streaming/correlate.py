"""Streaming twin of the correlation window, with state per session.

State keeps the hits of the last 300 seconds of event time.  Calls later than the
watermark are dropped by Spark; within a micro-batch calls are taken in order of time
and ``event_id``, so a call that arrives in a later batch than a younger one sees the
hits known so far.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cinderglass.operators.correlate import ESCALATE_AT, SPACING_S, WINDOW_S

_OUT = "session string, event_id long, s long, tool_name string, is_hit boolean, payload string, prior_hits long, prior_tools string, escalated boolean, notify boolean"
_STATE = "s array<long>, tool array<string>, sent long"
_NEVER = -(10**15)


def _listed(x) -> list:
    return list(x) if x is not None else []


def _advance(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One micro-batch of a session: known hits and new calls are merged in time order once."""
    if state.hasTimedOut:
        state.remove()
        return
    times, tools, sent = state.get if state.exists else ([], [], _NEVER)
    known = sorted(zip(_listed(times), _listed(tools), strict=True))
    rows = pd.concat(list(pdfs)).sort_values(["s", "event_id"])
    hits: list[tuple[int, str]] = []  # hits up to the call at hand, in time order
    low = taken = 0  # the first of them that is still in the window; known hits merged so far
    live: Counter = Counter()
    made: dict[str, list] = {name: [] for name in ("prior_hits", "prior_tools", "escalated", "notify")}
    for s, tool, is_hit in zip(rows["s"], rows["tool_name"], rows["is_hit"], strict=True):
        while taken < len(known) and known[taken][0] <= s:
            hits.append(known[taken])
            live[known[taken][1]] += 1
            taken += 1
        while low < len(hits) and hits[low][0] < s - WINDOW_S:
            live[hits[low][1]] -= 1
            low += 1
        prior = len(hits) - low
        made["prior_hits"].append(prior)
        made["prior_tools"].append(",".join(sorted(t for t, n in live.items() if n)))
        made["escalated"].append(bool(is_hit) and prior >= ESCALATE_AT)
        made["notify"].append(bool(is_hit) and s - sent >= SPACING_S)
        if is_hit:
            sent = s if made["notify"][-1] else sent
            hits.append((int(s), tool))
            live[tool] += 1
    kept = sorted(hits[low:] + known[taken:])
    newest = max([t for t, _ in kept], default=int(rows["s"].max()))
    kept = [(t, x) for t, x in kept if t >= newest - 2 * WINDOW_S]
    state.update(([t for t, _ in kept], [x for _, x in kept], int(sent)))
    state.setTimeoutTimestamp(max(int(rows["s"].max() + WINDOW_S + 1) * 1000, state.getCurrentWatermarkMs() + 1))
    yield rows.assign(session=key[0], **made)[[c.strip().split(" ")[0] for c in _OUT.split(",")]]


def correlate_stream(calls: DataFrame, lateness: str = "5 minutes", payload: str | None = None) -> DataFrame:
    """Prior hits, escalation and notifications of a stream ``calls(session, event_id, ts, tool_name, is_hit)``.

    ``payload`` names a string column that goes along unchanged.
    """
    timed = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    carried = (F.col(payload) if payload else F.lit(None).cast("string")).alias("payload")
    keyed = timed.select("session", "event_id", F.unix_timestamp("ts").alias("s"), "tool_name", "is_hit", carried, "ts")
    return keyed.groupBy("session").applyInPandasWithState(_advance, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
