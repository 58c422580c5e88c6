"""Detectors: pattern matches over the views, code points, base64 and leetspeak."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinderglass.functions import views
from cinderglass.functions.catalog import HIGH, LOW, MEDIUM, Catalog
from cinderglass.functions.matching import matches

#: Code-point detectors, fixed values: severity, finding, class of code points.
CODE_POINTS = [
    (HIGH, "unicode tag characters (invisible ASCII encoding)", r"[\x{E0000}-\x{E007F}]"),
    (MEDIUM, "mixed Cyrillic/Latin script (possible homoglyph attack)", r"[A-Za-z][\x{0400}-\x{04FF}]|[\x{0400}-\x{04FF}][A-Za-z]"),
    (LOW, "zero-width/invisible characters", r"[\x{200B}-\x{200D}\x{FEFF}\x{00AD}]"),
    (LOW, "bidirectional override/isolate characters", r"[\x{202A}-\x{202E}\x{2066}-\x{2069}]"),
    (LOW, "invisible function/annotation characters", r"[\x{2060}-\x{2064}\x{FFF9}-\x{FFFC}]"),
    (LOW, "invisible filler characters (mongolian/braille/hangul)", r"[\x{180E}\x{2800}\x{3164}\x{FFA0}]"),
    (LOW, "unicode line/paragraph separators", r"[\x{2028}\x{2029}]"),
    (LOW, "variation selectors (pattern-breaking invisible chars)", r"[\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]"),
]
#: Names of the other detectors' findings, fixed values.
BASE64_FINDING = "suspicious base64-encoded content"
PREFIX_FINDING = "known base64-encoded attack prefix: "
LEET_FINDING = "leetspeak obfuscation detected: "
#: Words looked for in decoded base64, known base64 beginnings, leetspeak phrases; fixed values.
BASE64_WORDS = "ignore|instruction|system|prompt|override|bypass|jailbreak"
BASE64_PREFIXES = ["aWdub3Jl", "SWdub3Jl", "cHJpbnQo", "ZWNobyAi", "c3lzdGVt", "b3ZlcnJpZGU"]
LEET_PHRASES = ["ignore previous instructions", "ignore all instructions", "disregard instructions", "system prompt", "override instructions", "bypass safety", "jailbreak"]


def strings(*items: str) -> Column:
    return F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")


def code_points(content: Column, severity: str) -> Column:
    """Findings of a severity; all of them need a character outside ASCII."""
    found = F.array_compact(F.array(*(F.when(content.rlike(regex), F.lit(name)) for s, name, regex in CODE_POINTS if s == severity)))
    return F.when(F.octet_length(content) > F.length(content), found).otherwise(strings())


def base64_payload(content: Column) -> Column:
    """Whether one of the first five long base64 runs decodes to a suspicious word."""
    runs = F.slice(F.regexp_extract_all(content, F.lit("([A-Za-z0-9+/]{50,}={0,2})"), F.lit(1)), 1, 5)
    whole = lambda x: F.substr(x, F.lit(1), (F.floor(F.length(x) / 4) * 4).cast("int"))
    decoded = lambda x: F.lower(F.decode(F.try_to_binary(whole(x), F.lit("base64")), "ISO-8859-1"))
    return F.coalesce(F.exists(runs, lambda x: F.coalesce(decoded(x).rlike(BASE64_WORDS), F.lit(False))), F.lit(False))


def base64_prefix(content: Column) -> Column:
    """The first known beginning that occurs, or null."""
    return F.coalesce(*(F.when(F.contains(content, F.lit(p)), F.lit(p)) for p in BASE64_PREFIXES))


def leet_phrase(content: Column) -> Column:
    """The first phrase that shows only after undoing leetspeak, or null."""
    low = views.lower(content)
    both = F.array(F.struct(low.alias("low"), views.leet(low).alias("leet")))
    first = lambda v: F.get(F.filter(strings(*LEET_PHRASES), lambda p: F.contains(v["leet"], p) & ~F.contains(v["low"], p)), F.lit(0))
    return F.get(F.transform(both, first), F.lit(0))  # the array of one makes each text once, not once a phrase


def _cased(found: Column, casing: dict[str, str]) -> Column:
    if not casing:
        return found
    names = F.create_map(*(F.lit(x) for pair in casing.items() for x in pair))
    return F.transform(found, lambda p: F.coalesce(F.try_element_at(names, p), p))


def pattern_matches(content: Column, catalog: Catalog, compat: bool = False) -> Column:
    """Struct ``high, medium, low``: distinct literals in order of views and places.

    A view that undoes nothing equals an earlier one and is matched once.
    """
    return matches(F.array_distinct(views.all_views(content, compat)), catalog)


def findings(found: Column, content: Column, catalog: Catalog) -> dict[str, Column]:
    """Per severity, all findings: patterns, then detectors."""
    part = lambda name, severity: _cased(found[name], catalog.casing(severity))
    high_more = F.array_compact(F.array(F.when(base64_payload(content), F.lit(BASE64_FINDING)), F.concat(F.lit(PREFIX_FINDING), base64_prefix(content))))
    medium_more = F.array_compact(F.array(F.concat(F.lit(LEET_FINDING), leet_phrase(content))))
    return {
        "high": F.array_distinct(F.concat(part("high", HIGH), code_points(content, HIGH), high_more)),
        "medium": F.array_distinct(F.concat(part("medium", MEDIUM), code_points(content, MEDIUM), medium_more)),
        "low": F.array_distinct(F.concat(part("low", LOW), code_points(content, LOW))),
    }


def severity(high: Column, medium: Column, low: Column) -> Column:
    return F.when(F.size(high) > 0, HIGH).when(F.size(medium) > 0, MEDIUM).when(F.size(low) > 0, LOW).otherwise("NONE")
