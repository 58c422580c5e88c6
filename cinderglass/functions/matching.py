"""Leftmost-longest matches of many literals: one Aho-Corasick automaton over all views.

A regex of 600 alternatives costs about ten times as much a view, so this is the one
place where the scan leaves the JVM: an Arrow function from views to matches.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from cinderglass.functions.catalog import HIGH, LOW, MEDIUM, Catalog

LEVELS = {HIGH: 0, MEDIUM: 1, LOW: 2}
_KIND = pa.struct([(name, pa.list_(pa.string())) for name in ("high", "medium", "low")])


@functools.lru_cache(maxsize=8)
def automaton(patterns: tuple[tuple[int, str], ...]) -> ahocorasick.Automaton:
    """Over (level, lower-case literal); a literal knows its length and its levels."""
    tree = ahocorasick.Automaton()
    levels: dict[str, list[int]] = {}
    for level, word in patterns:
        if level not in levels.setdefault(word, []):
            levels[word].append(level)
    for word, own in levels.items():
        tree.add_word(word, (len(word), word, tuple(own)))
    if levels:
        tree.make_automaton()
    return tree


def leftmost_longest(found: list[tuple[int, int, str]]) -> Iterator[str]:
    """Of (start, -length, word) those that a scan from the left takes, each the longest at its start."""
    end = 0
    for start, size, word in sorted(found):
        if start >= end:
            end = start - size
            yield word


def matches_of(views: list[str], tree: ahocorasick.Automaton) -> list[list[str]]:
    """Per level the distinct matches over the views in order; the last level over the first view only."""
    out: list[dict[str, None]] = [{} for _ in LEVELS]
    if not len(tree):
        return [[] for _ in out]
    for k, view in enumerate(views):
        found: list[list[tuple[int, int, str]]] = [[] for _ in out]
        for last, (size, word, levels) in tree.iter(view):
            for level in levels:
                found[level].append((last + 1 - size, -size, word))
        for level, own in enumerate(found):
            if own and (level < 2 or not k):
                out[level].update(dict.fromkeys(leftmost_longest(own)))
    return [list(o) for o in out]


def matches(views: Column, catalog: Catalog) -> Column:
    """Struct ``high, medium, low`` of the lower-case literals in an array of views.

    Matches do not overlap within a view and a level; ``low`` looks at the first view
    only.  Null views have none.
    """
    patterns = tuple(dict.fromkeys((LEVELS[s], p.lower()) for s, _, p in catalog.rows if p))

    @F.arrow_udf("struct<high: array<string>, medium: array<string>, low: array<string>>")
    def run(texts: pa.Array) -> pa.Array:
        tree = automaton(patterns)
        rows = [matches_of([v.as_py() for v in own.values if v.is_valid], tree) if own.is_valid else [[], [], []] for own in texts]
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.list_(pa.string())) for k in range(3)], fields=list(_KIND))

    return run(views)
