"""Structural contexts in which a delimiter is quoted, not meant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinderglass.functions.detect import strings

#: Words that keep a match whatever surrounds it, fixed values.
GUARDS = ["ignore", "override", "bypass", "disregard", "forget", "instructions", "previous", "system prompt", "jailbreak", "discard", "supersede", "overwrite"]
BEFORE = 20


def _quoted(pattern: Column) -> Column:
    return F.concat(F.lit(r"\Q"), pattern, F.lit(r"\E"))


def verdict(lines: Column, number: Column, pattern: Column) -> Column:
    """Struct ``verdict`` (fp or genuine) and ``reason`` for a match on a 1-based line.

    Anything that cannot be judged (no such line, null or empty pattern) is genuine.
    """
    line = F.get(lines, number - 1)
    low = F.lower(line)
    start = F.greatest(F.lit(1), number - BEFORE)
    before = F.when(number > 1, F.slice(lines, start, number - start)).otherwise(F.array().cast("array<string>"))
    p = _quoted(F.lower(pattern))
    count = lambda regex: F.size(F.filter(before, lambda x: x.rlike(regex)))
    on = lambda *parts: F.rlike(low, F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in parts)))
    guard = F.get(F.filter(strings(*GUARDS), lambda k: F.contains(low, k)), F.lit(0))
    where = F.coalesce(
        F.when(count(r"^\s*(?:```|~~~)") % 2 == 1, "code_fence"),
        F.when(on(r"^\s*[a-z_][a-z0-9_]*:\s*[\"'].*", p), "yaml_string"),
        F.when((count(r"^\s*[a-z_][a-z0-9_]*:\s*[|>]") > 0) & line.rlike(r"^\s+"), "yaml_block_scalar"),
        F.when(on('"[^"]*', p, '[^"]*"') & (on(r'"[^"]*"\s*:\s*"[^"]*', p) | on(r'\[\s*"[^"]*', p)), "json_string"),
        F.when(count("(?i)<(?:code|pre)[^>]*>") > count("(?i)</(?:code|pre)>"), "html_code_block"),
        F.when(on("<(?:code|pre)[^>]*>.*", p, ".*</(?:code|pre)>"), "html_code_inline"),
        F.when(on("`[^`]*", p, "[^`]*`"), "markdown_inline_code"),
    )
    judged = (F.length(pattern) > 0) & line.isNotNull() & guard.isNull() & where.isNotNull()
    fp = F.coalesce(judged, F.lit(False))
    reason = F.when(fp, F.concat(F.lit("inside "), where)).when(guard.isNotNull(), F.concat(F.lit("beside: "), guard)).otherwise("no benign context")
    return F.struct(F.when(fp, "fp").otherwise("genuine").alias("verdict"), reason.alias("reason"), F.when(fp, where).alias("context"))


def first_line(lines: Column, pattern: Column) -> Column:
    """1-based number of the first line that holds a pattern, in lower case; null if none."""
    at = F.array_position(F.transform(lines, lambda x: F.contains(F.lower(x), F.lower(pattern))), True)
    return F.when(at > 0, at.cast("int"))


def cleared(content: Column, medium: Column, clearable: list[str], strict: bool = False) -> Column:
    """Findings that a benign context clears, of the ``clearable`` ones only.

    The first line that holds the pattern decides; with ``strict`` every such line must
    be benign.  A pattern that no raw line holds stays.
    """
    lines = F.split(content, "\n")
    numbers = F.sequence(F.lit(1), F.size(lines))

    def benign(p: Column) -> Column:
        if strict:
            own = F.filter(numbers, lambda n: F.contains(F.lower(F.get(lines, n - 1)), F.lower(p)))
            return (F.size(own) > 0) & F.forall(own, lambda n: verdict(lines, n, p)["verdict"] == "fp")
        return F.coalesce(verdict(lines, first_line(lines, p), p)["verdict"] == "fp", F.lit(False))

    return F.filter(F.array_intersect(medium, strings(*clearable)), benign)
