"""The scan as a stream: JSON events in, decisions, audit rows and notifications out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cinderglass.plans.pipeline import Options, audit, conclude, is_hit, scan
from cinderglass.sources.events import routed, scan_events, write_audit, write_decisions
from cinderglass.streaming.correlate import correlate_stream

_KEPT = "content string, url string, ts timestamp, high array<string>, medium array<string>, low array<string>, cleared array<string>, severity string"


def decide_stream(calls: DataFrame, options: Options | None = None, lateness: str = "5 minutes") -> DataFrame:
    """``decide(scan(calls))`` of a stream ``calls(session, event_id, ts, tool_name, url, content)``, with ``notify``."""
    o = options or Options()
    scanned = scan(calls.withColumn("ts", F.col("ts").cast("timestamp")), o)
    names = [f.strip().split(" ")[0] for f in _KEPT.split(", ")]
    packed = scanned.withColumns({"is_hit": is_hit(o), "packed": F.to_json(F.struct(*names))})
    flagged = correlate_stream(packed, lateness, "packed").withColumn("x", F.from_json("payload", _KEPT))
    return conclude(flagged.select("session", "event_id", "tool_name", "is_hit", "prior_hits", "prior_tools", "escalated", "notify", "x.*"), o)


def run_stream(raw: DataFrame, path: str, checkpoint: str, options: Options | None = None, lateness: str = "5 minutes", **trigger) -> StreamingQuery:
    """Scan a stream of JSON events ``raw(value, session, event_id, ts)`` and append what follows under ``path``.

    ``decisions`` has one JSON object a line, ``audit`` Parquet by kind, ``notify`` the
    calls to announce.  A micro-batch that is repeated after a failure appends again:
    audit rows carry ``event_id`` to tell repeats.
    """
    decided = decide_stream(routed(scan_events(raw)), options, lateness)

    def sink(batch: DataFrame, _: int) -> None:
        batch.persist()
        write_decisions(batch.where("decision is not null"), f"{path}/decisions")
        write_audit(audit(batch), f"{path}/audit")
        batch.where("notify").select("session", "event_id", "ts", "outcome").write.mode("append").parquet(f"{path}/notify")
        batch.unpersist()

    return decided.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
