"""Pattern catalog: severity, category and literal, in an order that has meaning.

The default catalog is the packaged file ``data/patterns.tsv``.  A site's own list is a
file of the same form (``severity<TAB>category<TAB>pattern`` a line), a table
(``severity, category, ord, pattern``) or an addition to another catalog.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

HIGH, MEDIUM, LOW = "HIGH", "MEDIUM", "LOW"

#: Category whose patterns a benign context may clear.
CLEARABLE_CATEGORY = "generic_delimiters"
DEFAULT = Path(__file__).parent.parent / "data" / "patterns.tsv"
#: Bound on the entries of a catalog: it goes to every task.
MOST_PATTERNS = 100_000

Row = tuple[str, str, str]


def _parse(lines: list[str]) -> tuple[Row, ...]:
    """Rows of a catalog file; blank lines and ``#`` lines are skipped."""
    return tuple(tuple(x.split("\t", 2)) for x in lines if x.strip() and not x.startswith("#"))


def _bounded(rows: list) -> list:
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"a catalog has at most {MOST_PATTERNS} patterns")
    return rows


@functools.cache
def builtin() -> tuple[Row, ...]:
    return _parse(DEFAULT.read_text(encoding="utf-8").split("\n"))


@dataclass(frozen=True)
class Catalog:
    """Patterns in order, with what matching needs."""

    rows: tuple[tuple[str, str, str], ...]

    @staticmethod
    def default() -> Catalog:
        return Catalog(builtin())

    @staticmethod
    def from_text(spark: SparkSession, path: str) -> Catalog:
        """Read a catalog file through Spark."""
        return Catalog(_parse([r.value for r in _bounded(spark.read.text(path).limit(2 * MOST_PATTERNS).collect())]))

    @staticmethod
    def from_frame(df: DataFrame) -> Catalog:
        return Catalog(tuple((r.severity, r.category, r.pattern) for r in _bounded(df.orderBy("ord").limit(MOST_PATTERNS + 1).collect())))

    def plus(self, extra: list[tuple[str, str, str]]) -> Catalog:
        return Catalog((*self.rows, *extra))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(s, c, k, p, p.lower()) for k, (s, c, p) in enumerate(self.rows)]
        return spark.createDataFrame(rows, "severity string, category string, ord int, pattern string, pattern_lc string")

    def patterns(self, severity: str) -> list[str]:
        return [p for s, _, p in self.rows if s == severity]

    @property
    def clearable(self) -> list[str]:
        return [p for _, c, p in self.rows if c == CLEARABLE_CATEGORY]

    def casing(self, severity: str) -> dict[str, str]:
        """Lower-case pattern to the first catalog entry with that spelling, where they differ."""
        first: dict[str, str] = {}
        for p in self.patterns(severity):
            first.setdefault(p.lower(), p)
        return {k: v for k, v in first.items() if k != v}
