"""Connected components of a link table by min-label propagation and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderglass.llm.shared import count_of, stash, unstash


def components(edges: DataFrame) -> DataFrame:
    """Label each node of ``edges(a, b)`` with the smallest node it reaches.

    Returns ``node, component``; nodes without a link to another node are absent.
    Each round lowers labels over all links, then jumps to the label's own label,
    so a star takes two rounds and a path a number logarithmic in its length.
    An empty table gives an empty table.  Nulls, loops and repeated links are ignored.
    """
    links = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = stash(links.union(links.select("b", "a")).distinct(), "links")
    held = stash(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        labels = held.select("node", "component")
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "seen").alias("component"))
        top = lower.select(F.col("node").alias("component"), F.col("component").alias("up"))
        jumped = stash(lower.join(top, "component", "left").select("node", "was", F.least("component", F.coalesce("up", "component")).alias("component")), "labels")
        unstash(held)
        held = jumped
        if not count_of(jumped.where("was <> component")):
            unstash(both)
            return jumped.select("node", "component")


def merged(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """``components`` of the links that gave ``labels`` and of ``edges(a, b)``, from these two alone.

    Only links between labels are followed: after the first round of a search few are new.
    ``labels`` may be None for no links so far.
    """
    if labels is None:
        return components(edges)
    at = {end: labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in")) for end in "ab"}
    ends = edges.join(at["a"], "a", "left").join(at["b"], "b", "left").select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))
    moved = components(ends)
    lowered = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    kept = labels.join(lowered, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    fresh = moved.join(labels.select("node"), "node", "left_anti").select("node", "component")
    return stash(kept.union(fresh), "labels")
