"""Views of a text that undo one kind of disguise each; all start from lower case."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Look-alike letters and what they stand for, fixed values.
LOOKALIKES = "аеорсухіјѕԁɡɑεονικτη"
LOOKALIKE_OF = "aeopcyxijsdgaeoviktn"
WIDE = "".join(chr(0xFF41 + k) for k in range(26))
PLAIN = "abcdefghijklmnopqrstuvwxyz"
STRIPPED = "._*|,;:!?+=#~\\/-"
SPACES = "\u00a0\u2002\u2003\u200a\u3000"
LEET_FROM, LEET_TO = "134057@$", "ieaostas"


def lower(c: Column) -> Column:
    return F.lower(c)


def collapsed(low: Column) -> Column:
    one = F.regexp_replace(F.concat(low, F.lit("\n")), r"\s+", " ")
    joined = F.regexp_replace(one, "(?<![a-z])([a-z]) ([a-z]) ", "$1$2")
    return F.regexp_replace(joined, "(?<![a-z])([a-z]) ([a-z])(?![a-z])", "$1$2")


def entity_decoded(low: Column) -> Column:
    out = F.regexp_replace(low, "&#x([0-9a-f]{2});", r"\\x$1")
    out = F.regexp_replace(out, "&#([0-9]{2,3});", "ENTITY_$1")
    pairs = [("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"')] + [(f"ENTITY_{ord(x)}", x) for x in PLAIN]
    decoded = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, out)
    return F.when(F.contains(low, F.lit("&")), decoded).otherwise(low)


def stripped(low: Column) -> Column:
    return F.regexp_replace(F.translate(low, STRIPPED, ""), r"[ \t\r\f\x0B]+", " ")


def confusable(low: Column) -> Column:
    plain = F.regexp_replace(F.translate(low, LOOKALIKES + WIDE, LOOKALIKE_OF + PLAIN), r"[\x{0300}-\x{036F}\x{FE00}-\x{FE0F}]", "")
    return F.when(F.octet_length(low) > F.length(low), plain).otherwise(low)


def unicode_spaces(low: Column) -> Column:
    return F.regexp_replace(F.translate(low, SPACES, " " * len(SPACES)), " +", " ")


def tag_stripped(low: Column) -> Column:
    return F.regexp_replace(low, r"<[^>\n]*>", "")


def percent_decoded(low: Column, again: bool = True) -> Column:
    """One pass of percent decoding; ``again`` lower-cases what it revealed."""
    safe = F.regexp_replace(F.replace(low, F.lit("+"), F.lit("%2B")), "%(?![0-9a-fA-F]{2})", "%25")
    out = F.try_url_decode(safe)
    return F.lower(out) if again else out


def leet(low: Column) -> Column:
    return F.translate(low, LEET_FROM, LEET_TO)


#: Views that patterns are matched on, in the order in which matches are reported.
NAMES = ["lower", "collapsed", "entity_decoded", "stripped", "confusable", "unicode_spaces", "tag_stripped", "percent_decoded"]


def all_views(content: Column, compat: bool = False) -> Column:
    """The eight matching views as an array of texts, in the order of ``NAMES``."""
    low = lower(content)
    return F.array(low, collapsed(low), entity_decoded(low), stripped(low), confusable(low), unicode_spaces(low), tag_stripped(low), percent_decoded(low, not compat))
