"""Redacted copies of texts, snippets and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OUTPUT_CAP = 50_000
SHOWN = 5


def digest(content: Column) -> Column:
    """SHA-256 of the text and a final newline."""
    return F.sha2(F.concat(content, F.lit("\n")), 256)


def line_count(content: Column) -> Column:
    return F.size(F.split(content, "\n"))


def full(content: Column, count: Column, tool: Column, url: Column) -> Column:
    """Notice that stands for a withheld text."""
    where = F.coalesce(F.when(F.length(url) > 0, url), F.lit("n/a"))
    facts = F.concat(F.lit("Tool: "), tool, F.lit(" | URL: "), where, F.lit(" | Lines: "), line_count(content).cast("string"), F.lit(" | Hash: "), F.substring(digest(content), 1, 12))
    return F.concat_ws("\n", F.concat(F.lit("[CONTENT WITHHELD: "), count.cast("string"), F.lit(" critical patterns]")), facts, F.lit("Status: nothing of the content was passed on."))


def label(line: Column, patterns: Column) -> Column:
    """The first pattern that a line holds, or null."""
    return F.get(F.filter(patterns, lambda p: F.contains(F.lower(line), F.lower(p))), F.lit(0))


def by_line(content: Column, patterns: Column, cap: int = OUTPUT_CAP) -> Column:
    """Struct ``text, kept, redacted, total``: lines with a pattern replaced, output capped.

    The cap is part of the output format: once more than ``cap`` characters are out, a
    marker ends the text; the counts are of the lines before it.
    """
    state = F.struct(F.lit("").alias("text"), F.lit(0).alias("kept"), F.lit(0).alias("redacted"), F.lit(False).alias("full"))

    def step(acc: Column, line: Column) -> Column:
        found = label(line, patterns)
        shown = F.when(found.isNotNull(), F.concat(F.lit("[REDACTED: matched '"), found, F.lit("']"))).otherwise(line)
        over = F.length(acc["text"]) > cap
        text = F.when(acc["full"], acc["text"]).when(over, F.concat(acc["text"], F.lit("[TRUNCATED: output size limit reached]\n"))).otherwise(F.concat(acc["text"], shown, F.lit("\n")))
        stop = acc["full"] | over
        return F.struct(text.alias("text"), (acc["kept"] + F.when(~stop & found.isNull(), 1).otherwise(0)).alias("kept"), (acc["redacted"] + F.when(~stop & found.isNotNull(), 1).otherwise(0)).alias("redacted"), stop.alias("full"))

    done = F.aggregate(F.split(content, "\n"), state, step)
    total = line_count(content)
    trailer = F.concat(F.lit("[Sanitized: "), done["kept"].cast("string"), F.lit(" kept, "), done["redacted"].cast("string"), F.lit(" redacted / "), total.cast("string"), F.lit(" total | hash: "), F.substring(digest(content), 1, 12), F.lit("]"))
    return F.struct(F.concat(done["text"], F.lit("\n"), trailer).alias("text"), done["kept"].alias("kept"), done["redacted"].alias("redacted"), total.alias("total"))


def shown_list(found: Column) -> Column:
    return F.array_join(F.transform(F.slice(found, 1, SHOWN), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", ")


def snippets(scanned: DataFrame, key: str, patterns: str = "medium", per_pattern: int = 3, total: int = 10) -> DataFrame:
    """Lines of ``content`` that hold one of the shown patterns: at most three a pattern, ten a text."""
    p = scanned.select(key, "content", F.posexplode(F.slice(patterns, 1, SHOWN)).alias("pattern_no", "pattern"))
    lines = p.select(key, "pattern_no", "pattern", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    held = lines.where(F.contains(F.lower("line"), F.lower("pattern")) & (F.trim("line") != ""))
    each = held.withColumn("k", F.row_number().over(Window.partitionBy(key, "pattern_no").orderBy("line_no"))).where(F.col("k") <= per_pattern)
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("pattern_no", "line_no"))).where(F.col("rank") <= total)
    return ranked.select(key, "rank", "pattern", (F.col("line_no") + 1).alias("line_no"), F.substring(F.regexp_replace("line", r"^\s+", ""), 1, 200).alias("snippet"))
