"""Correlation of hits in a sliding window, and spacing of notifications, over batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderglass.functions.names import unused

WINDOW_S, ESCALATE_AT, SPACING_S = 300, 2, 5


def _earlier_seconds(seconds: DataFrame) -> DataFrame:
    """``k, s, n, tools``: hits of a key in the 300 seconds before second ``s``, and their tools.

    ``seconds(k, s, n, tools)`` has one row a key and second.  Time is cut into spans of
    300 seconds; a span is joined by a copy of the one before, so no task needs more of a
    key than two spans, even if all calls have one key.
    """
    span = F.floor(F.col("s") / WINDOW_S)
    own = seconds.withColumns({"span": span, "copy": F.lit(False)})
    late = seconds.where("n > 0").withColumns({"span": span + 1, "copy": F.lit(True)})
    before = Window.partitionBy("k", "span").orderBy("s").rangeBetween(-WINDOW_S, -1)
    tools = F.array_distinct(F.flatten(F.collect_list("tools").over(before)))
    out = own.unionByName(late).withColumns({"n": F.coalesce(F.sum("n").over(before), F.lit(0)), "tools": tools})
    return out.where("not copy").select("k", "s", "n", "tools")


def correlate(calls: DataFrame, key: str = "session") -> DataFrame:
    """Add ``prior_hits``, ``prior_tools`` and ``escalated`` to ``calls(key, event_id, ts, tool_name, is_hit)``.

    Prior hits are those of the same key in the last 300 whole seconds, before this
    call; calls of one second are ordered by ``event_id``.  A hit with two prior hits
    escalates.  A null key is a key of its own; a null time has no earlier seconds.
    Input columns of the three names are replaced.
    """
    rest = calls.drop("prior_hits", "prior_tools", "escalated")
    s, n, tools = (unused(rest, x) for x in ("second", "n_before", "tools_before"))
    timed = rest.withColumn(s, F.unix_timestamp(F.col("ts").cast("timestamp")))
    hit_tool = F.when(F.col("is_hit"), F.col("tool_name"))
    seconds = timed.groupBy(F.col(f"`{key}`").alias("k"), F.col(s).alias("s")).agg(F.count_if("is_hit").alias("n"), F.collect_set(hit_tool).alias("tools"))
    before = _earlier_seconds(seconds).select(F.col("k").alias(f"{s}_k"), F.col("s").alias(f"{s}_s"), F.col("n").alias(n), F.col("tools").alias(tools))
    met = timed.join(before, timed[key].eqNullSafe(before[f"{s}_k"]) & timed[s].eqNullSafe(before[f"{s}_s"]), "left")
    same = Window.partitionBy(key, s).orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.count_if("is_hit").over(same), F.lit(0))
    empty = F.array().cast("array<string>")
    named = F.array_join(F.array_sort(F.array_distinct(F.concat(F.coalesce(tools, empty), F.coalesce(F.collect_set(hit_tool).over(same), empty)))), ",")
    out = met.withColumns({"prior_hits": prior, "prior_tools": named})
    return out.withColumn("escalated", F.col("is_hit") & (F.col("prior_hits") >= ESCALATE_AT)).select(*rest.columns, "prior_hits", "prior_tools", "escalated")


def debounce(calls: DataFrame, key: str = "session") -> DataFrame:
    """Times at which a notification is sent per key: each at least 5 s after the last one sent.

    Bursts are first reduced to one time a second and cut where five seconds pass without
    a call: the call after such a gap is sent whatever was before it, so each stretch is
    folded by itself.
    """
    seconds = calls.select(F.col(key).alias("k"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s")).where("s is not null").distinct()
    order = Window.partitionBy("k").orderBy("s")
    gap = F.coalesce(F.col("s") - F.lag("s").over(order) >= SPACING_S, F.lit(True))
    stretch = seconds.withColumn("gap", gap.cast("long")).withColumn("stretch", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    none = F.array().cast("array<bigint>")
    keep = lambda acc, s: F.when((F.size(acc) == 0) | (s - F.element_at(acc, -1) >= SPACING_S), F.concat(acc, F.array(s))).otherwise(acc)
    return stretch.groupBy("k", "stretch").agg(F.aggregate(F.array_sort(F.collect_list("s")), none, keep).alias("sent")).select(F.col("k").alias(key), F.explode("sent").alias("sent_s"))
