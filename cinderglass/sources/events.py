"""Sources and sinks: JSON events in, decisions and audit rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of tools whose calls are screened and scanned, fixed values; a parameter of ``routed``.
TOOLS = [
    "WebSearch", "WebFetch", "mcp__playwright.*", "mcp__puppeteer.*", "mcp__browser.*", "mcp__fetch.*", "mcp__markdownify.*", "mcp__exa-web-search__.*", "mcp__firecrawl__.*",
    "mcp__MCP_DOCKER__.*-to-markdown", "mcp__MCP_DOCKER__fetch_content", "mcp__MCP_DOCKER__search", "mcp__MCP_DOCKER__get_article", "mcp__MCP_DOCKER__get_summary",
    "mcp__MCP_DOCKER__get_transcript", "mcp__MCP_DOCKER__get_timed_transcript", "mcp__MCP_DOCKER__get_video_info", "mcp__MCP_DOCKER__get_links", "mcp__MCP_DOCKER__get_related_topics",
    "mcp__MCP_DOCKER__get_sections", "mcp__MCP_DOCKER__get_coordinates", "mcp__MCP_DOCKER__summarize_article.*", "mcp__MCP_DOCKER__extract_key_facts", "mcp__MCP_DOCKER__wikipedia_.*",
    "mcp__MCP_DOCKER__browser_.*", "mcp__plugin_context7_context7__query-docs",
]


def _some(*columns: Column) -> Column:
    """First that is neither null nor the JSON literal false."""
    return F.coalesce(*(F.when(c != "false", c) for c in columns))


def scan_events(raw: DataFrame, column: str = "value") -> DataFrame:
    """Parse scan events; rows without content are dropped.

    Content that is an object stays compact JSON text.  Trailing newlines are cut.
    """
    at = lambda p: F.get_json_object(column, p)
    content = F.regexp_replace(F.coalesce(_some(at("$.tool_response"), at("$.tool_output")), F.lit("")), r"\n+\z", "")
    rest = [c for c in raw.columns if c != column]
    out = raw.select(*rest, F.coalesce(_some(at("$.tool_name")), F.lit("unknown")).alias("tool_name"), F.coalesce(_some(at("$.tool_input.url"), at("$.tool_input.URL")), F.lit("")).alias("url"), content.alias("content"))
    return out.where(F.length("content") > 0)


def screen_events(raw: DataFrame, column: str = "value") -> DataFrame:
    at = lambda p: F.get_json_object(column, p)
    rest = [c for c in raw.columns if c != column]
    return raw.select(*rest, F.coalesce(_some(at("$.tool_input.url"), at("$.tool_input.URL"), at("$.tool_input.query")), F.lit("")).alias("url"))


def routed(events: DataFrame, tools: list[str] = TOOLS) -> DataFrame:
    """Events of the tools whose whole name one of the expressions matches."""
    return events.where(F.col("tool_name").rlike(f"^(?:{'|'.join(tools)})$"))


def read_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Lines of JSON as ``value``, in a batch or as a stream."""
    return (spark.readStream if stream else spark.read).text(path)


def read_blocklist(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("domain")).where("domain <> ''")


def write_decisions(decided: DataFrame, path: str) -> None:
    decided.select(F.to_json(F.col("decision")).alias("value")).write.mode("append").text(path)


def write_answers(screened: DataFrame, path: str) -> None:
    """Screening decisions, one JSON object a line."""
    screened.select(F.to_json("answer").alias("value")).write.mode("append").text(path)


def write_audit(audit: DataFrame, path: str) -> None:
    audit.write.mode("append").partitionBy("kind").parquet(path)
