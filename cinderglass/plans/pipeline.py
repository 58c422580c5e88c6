"""The scan: findings, clearing, correlation, decision and audit rows of calls."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderglass.functions import detect
from cinderglass.functions.catalog import Catalog
from cinderglass.functions.names import unused
from cinderglass.functions.spread import spread
from cinderglass.operators import context, redact
from cinderglass.operators.correlate import correlate, debounce


@dataclass(frozen=True)
class Options:
    """``compat`` keeps the literal behaviour where documentation and code of the format differ."""

    stop_on_high: bool = True
    verify_context: bool = True
    strict_clearing: bool = False
    compat: bool = False
    session: str = "session"
    catalog: Catalog = field(default_factory=Catalog.default)


def scan(calls: DataFrame, options: Options | None = None) -> DataFrame:
    """Findings of ``calls(content, ...)``: ``high, medium, low`` (all, in order), ``cleared``, ``severity``.

    One narrow stage, after ``spread``.  Null content has no findings.  Input columns of
    these names are replaced.
    """
    o = options or Options()
    text = spread(calls.drop("high", "medium", "low", "cleared", "severity")).withColumn("content", F.coalesce("content", F.lit("")))
    m = unused(text, "matches")
    matched = text.withColumn(m, detect.pattern_matches(F.col("content"), o.catalog, o.compat))
    found = matched.withColumns(detect.findings(F.col(m), F.col("content"), o.catalog)).drop(m)
    none = F.array().cast("array<string>")
    clear = F.when((F.size("high") == 0) & (F.size("medium") > 0), context.cleared(F.col("content"), F.col("medium"), o.catalog.clearable, o.strict_clearing)).otherwise(none) if o.verify_context else none
    out = found.withColumn("cleared", clear).withColumn("medium", F.array_except("medium", "cleared"))
    return out.withColumn("severity", detect.severity(F.col("high"), F.col("medium"), F.col("low")))


def decide(scanned: DataFrame, options: Options | None = None) -> DataFrame:
    """Correlate and decide ``scanned`` calls (``event_id, ts, tool_name, url`` and the session).

    Adds ``prior_hits, prior_tools, outcome`` (the severity, or ESCALATED) and
    ``decision`` (message, continue, stop reason, tool result; absent parts null).  With
    ``compat`` a call with cleared patterns counts as a hit too.
    """
    o = options or Options()
    return conclude(correlate(scanned.withColumn("is_hit", is_hit(o)), o.session), o)


def is_hit(options: Options) -> Column:
    """Whether a scanned call counts for the calls after it."""
    hit = F.col("severity").isin("HIGH", "MEDIUM")
    return hit | (F.size("cleared") > 0) if options.compat else hit


def conclude(flagged: DataFrame, options: Options | None = None) -> DataFrame:
    """The part of ``decide`` after correlation, for batches and streams alike."""
    o = options or Options()
    outcome = F.when((F.col("severity") == "MEDIUM") & F.col("escalated"), "ESCALATED").otherwise(F.col("severity"))
    x = flagged.withColumn("outcome", outcome)
    strong, medium, low = redact.shown_list(F.col("high")), redact.shown_list(F.col("medium")), redact.shown_list(F.col("low"))
    count = F.when(F.col("outcome") == "HIGH", F.least(F.size("high"), F.lit(redact.SHOWN))).otherwise(F.lit(0) if o.compat else F.least(F.size("medium"), F.lit(redact.SHOWN)))
    withheld = redact.full(F.col("content"), count, F.col("tool_name"), F.col("url"))
    surgical = redact.by_line(F.col("content"), F.col("medium"))
    message = (
        F.when(F.col("outcome") == "HIGH", F.concat(F.lit("HIGH: likely prompt injection, patterns: ["), strong, F.lit("]")))
        .when(F.col("outcome") == "ESCALATED", F.concat(F.lit("ESCALATED: "), (F.col("prior_hits") + 1).cast("string"), F.lit(" flagged calls in five minutes, earlier tools: ["), F.col("prior_tools"), F.lit("], patterns: ["), medium, F.lit("]")))
        .when(F.col("outcome") == "MEDIUM", F.concat(F.lit("MEDIUM: suspicious patterns: ["), medium, F.lit("]"), F.when(F.size("low") > 0, F.concat(F.lit(", also: ["), low, F.lit("]"))).otherwise("")))
        .when(F.col("outcome") == "LOW", F.concat(F.lit("LOW: hiding techniques: ["), low, F.lit("]")))
    )
    stops = F.col("outcome").isin("ESCALATED", "MEDIUM") | ((F.col("outcome") == "HIGH") & F.lit(o.stop_on_high))
    decision = F.struct(
        message.alias("systemMessage"),
        F.when(stops, False).alias("continue"),
        F.when(stops, F.concat_ws("\n", F.concat(F.lit("Tool: "), F.col("tool_name")), F.when(F.length("url") > 0, F.concat(F.lit("URL: "), F.col("url"))), message)).alias("stopReason"),
        F.when(F.col("outcome").isin("HIGH", "ESCALATED"), withheld).when(F.col("outcome") == "MEDIUM", surgical["text"]).alias("toolResult"),
    )
    return x.withColumn("decision", F.when(F.col("outcome") != "NONE", decision))


def audit(decided: DataFrame) -> DataFrame:
    """Audit rows: one per outcome, SANITIZE for redacted texts, CLEARED per cleared pattern."""
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("logged_at")
    base = ["event_id", "ts", "tool_name", "url"]
    outcome = F.struct(F.col("outcome").alias("kind"), F.array_join(F.when(F.col("outcome") == "HIGH", F.col("high")).when(F.col("outcome") == "LOW", F.col("low")).otherwise(F.col("medium")), ", ").alias("detail"))
    sanitize = F.struct(F.lit("SANITIZE").alias("kind"), F.concat(F.lit("hash="), redact.digest(F.col("content")), F.lit(" lines="), redact.line_count(F.col("content")).cast("string")).alias("detail"))
    rows = F.concat(
        F.when(F.col("outcome") != "NONE", F.array(outcome)).otherwise(F.array().cast("array<struct<kind: string, detail: string>>")),
        F.when(F.col("outcome").isin("HIGH", "MEDIUM", "ESCALATED"), F.array(sanitize)).otherwise(F.array().cast("array<struct<kind: string, detail: string>>")),
        F.transform("cleared", lambda p: F.struct(F.lit("CLEARED").alias("kind"), p.alias("detail"))),
    )
    return decided.select(*base, at, F.explode(rows).alias("r")).select(*base, "logged_at", "r.kind", "r.detail")


def rollup(scanned: DataFrame, catalog: Catalog) -> DataFrame:
    """Calls per severity and category of finding, with totals (an extension)."""
    # the catalog is bounded, see MOST_PATTERNS
    spark = scanned.sparkSession
    names = catalog.frame(spark).dropDuplicates(["severity", "pattern"]).select("pattern", F.col("severity").alias("level"), "category")
    found = scanned.select(F.explode(F.array_distinct(F.concat("high", "medium", "low"))).alias("pattern"))
    return found.join(F.broadcast(names), "pattern", "left").rollup("level", "category").agg(F.count(F.lit(1)).alias("n"))


def notifications(decided: DataFrame, options: Options | None = None) -> DataFrame:
    """When to notify: per session the times at which calls with an outcome are announced, at least 5 s apart."""
    o = options or Options()
    return debounce(decided.where("outcome <> 'NONE'"), o.session)
