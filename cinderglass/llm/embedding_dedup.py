"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside cells.

Vectors that are equal are one class from the start.  Spherical k-means splits the
classes of a label into cells of about ``CELL`` classes, and cells that hold more than
``LARGE`` again, until these too are small or cannot be told apart any further, so the
number of cells grows with the data.  A class is also shown to the cells whose border it is near, so links
across borders are found: vectors within cosine 0.93 are at most 0.374 apart, and one of
them is within half of what lies between them across the border.  ``margin`` takes that
half where it is certain, or, in many dimensions, three deviations of it for a
displacement without a preferred direction.

In a cell only pairs that pass the threshold leave a matrix product, and of those only
link counts and a spanning tree leave the task.  A pair that shares several cells counts
in the first of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderglass.llm.graph import components
from cinderglass.llm.shared import count_of, parts, stash, table, unstash

COSINE = 0.93
#: Classes that a cell should hold, and from which one is split again; parts of one split
#: at most; classes that a split is fitted on.
CELL, LARGE, FAN, FIT = 32, 1024, 256, 4096
#: Classes of a cell that are compared in one task; rows of one product.
BLOCK, ROWS = 2048, 256
#: Centroids of a level are broadcast up to this many bytes, else joined.
BROADCAST_BYTES = 16 << 20
ROUNDS = 8
#: Centroids closer than this are one: vectors that cannot be told apart stay together.
MERGE = 0.8
#: Splits of splits at most: cell numbers have 8 bits a level.
LEVELS = 7


def margin_of(least: float, dim: int) -> float:
    """How near to a border a vector must be to be shown to the cell behind it."""
    apart = np.sqrt(max(0.0, 2 - 2 * least))
    return float(min(apart / 2, 3 * apart / (2 * np.sqrt(max(dim, 1)))) + 1e-9)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.maximum(np.abs(rows).max(axis=1, keepdims=True, initial=0), np.finfo(float).tiny)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def spherical_kmeans(rows: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """At most ``k`` unit centroids of unit rows by cosine, none of them nearly the same."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    home = np.zeros(len(rows), int)
    for _ in range(ROUNDS):
        home = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, rows)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), centres)
    kept: list[int] = []
    for c in np.argsort(-np.bincount(home, minlength=len(centres)), kind="stable"):
        if not kept or (centres[kept] @ centres[c]).max() < MERGE:
            kept.append(int(c))
    return centres[kept]


def shown_to(rows: np.ndarray, centres: np.ndarray, margin: float) -> np.ndarray:
    """Which rows are shown to which centroids: the nearest, and those whose border is within the margin."""
    sims = rows @ centres.T
    home = sims.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
    shown = sims[np.arange(len(rows)), home][:, None] - sims <= margin * apart[home]
    shown[np.arange(len(rows)), home] = True
    return shown


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _runs(keys: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal keys."""
    n = len(keys[0])
    new = np.ones(n, bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.append(np.flatnonzero(new), n)
    yield from zip(at[:-1], at[1:], strict=True)


def _fit(least: float):
    """Centroids of a cell from a sample of its classes; no row where splitting does not help."""

    def run(t: pa.Table) -> pa.Table:
        dim, size = t.column("dim")[0].as_py(), t.column("size")[0].as_py()
        rows = _unit(_matrix(t.column("vec").combine_chunks(), dim))
        rows = rows[np.argsort(t.column("cid").to_numpy())][: 2 * FIT]
        centres = spherical_kmeans(rows, max(2, min(FAN, -(-size // CELL), len(rows) // 2)))
        shown = shown_to(rows, centres, margin_of(least, dim)).sum(axis=0) / len(rows)
        worth = len(centres) > 1 and (shown**2).sum() <= 1
        key = [t.column(c).slice(0, 1 if worth else 0) for c in ("label", "dim", "cell")]
        return pa.table([*key, pa.array([centres.ravel()] if worth else [], pa.list_(pa.float64()))], names=["label", "dim", "cell", "centres"])

    return run


def _assign(least: float):
    """Replace a class's cell by those parts of it that the class is shown to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            label, dim, cell = (batch.column(c).to_numpy() for c in ("label", "dim", "cell"))
            order = np.lexsort((cell, dim, label))
            batch = batch.take(pa.array(order))
            for low, high in _runs([label[order], dim[order], cell[order]]):
                own = batch.slice(low, high - low)
                d, c = own.column("dim")[0].as_py(), own.column("cell")[0].as_py()
                centres = np.array(own.column("centres")[0].as_py()).reshape(-1, d)
                shown = shown_to(_unit(_matrix(own.column("vec"), d)), centres, margin_of(least, d))
                at, part = np.nonzero(shown)
                ends = np.append(0, np.cumsum(shown.sum(axis=1))).astype(np.int32)
                cells = pa.ListArray.from_arrays(pa.array(ends), pa.array(c * FAN + part.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([own.column("cid"), cells], names=["cid", "parts"])

    return run


def _roots(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of i and j in ``parent``, whose roots are the smallest of their trees."""
    while True:
        a, b = parent[i], parent[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def _linked(rows, cid, n, block, two, cell, probes, least):
    """Per class of a cell its weighted links, and the smallest class of its tree."""
    size = len(cid)
    weights, parent = np.zeros(size), np.arange(size)
    many = (probes >= 0).sum(axis=1) > 1
    for low in range(0, size, ROWS):
        i, j = np.nonzero(rows[low : low + ROWS] @ rows.T >= least)
        i += low
        some = cid[i] < cid[j]
        if two:
            some &= block[i] != block[j]
        i, j = i[some], j[some]
        again = np.flatnonzero(many[i] & many[j])
        if len(again):
            drop = np.zeros(len(i), bool)
            for k in range(0, len(again), 20_000):
                part = again[k : k + 20_000]
                mine, other = probes[i[part]], probes[j[part]]
                earlier = (mine >= 0) & (mine < cell)
                drop[part] = ((mine[:, :, None] == other[:, None, :]) & earlier[:, :, None]).any(axis=(1, 2))
            i, j = i[~drop], j[~drop]
        weights += np.bincount(i, n[j], size) + np.bincount(j, n[i], size)
        _roots(parent, i, j)
    return weights, parent


def _compare(least: float):
    """Over rows sorted by cell and pair of blocks: links per class and one edge per linked class."""
    names = ["cid", "rep", "links", "lead"]

    def cell_of(t: pa.Table) -> pa.RecordBatch | None:
        if t.num_rows < 2:
            return None
        t = t.combine_chunks()
        dim, cell = t.column("dim")[0].as_py(), t.column("cell")[0].as_py()
        two = t.column("low")[0].as_py() != t.column("high")[0].as_py()
        cid, rep, n, block = (t.column(c).to_numpy() for c in ("cid", "rep", "n", "block"))
        lists = t.column("probes").to_pylist()
        probes = np.full((len(lists), max(map(len, lists))), -1, np.int64)
        for k, p in enumerate(lists):
            probes[k, : len(p)] = p
        weights, parent = _linked(_unit(_matrix(t.column("vec").combine_chunks(), dim)), cid, n, block, two, cell, probes, least)
        some = np.flatnonzero((weights > 0) | (parent != np.arange(len(cid))))
        return pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(rep[some]), pa.array(weights[some].astype(np.int64)), pa.array(rep[parent[some]])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in ("label", "dim", "cell", "low", "high")]
            for low, high in _runs(keys):
                own = tuple(int(k[low]) for k in keys)
                if own != key and held:
                    if (made := cell_of(pa.Table.from_batches(held))) is not None:
                        yield made
                    held = []
                key = own
                held.append(batch.slice(low, high - low))
        if held and (made := cell_of(pa.Table.from_batches(held))) is not None:
            yield made

    return run


def _cells(classes: DataFrame, least: float) -> DataFrame:
    """``classes`` with ``probes``: the sorted cells that each is shown to."""
    placed = stash(classes.withColumn("probes", F.array(F.lit(1).cast("long"))), "cells")
    settled = None
    for level in range(LEVELS):
        each = placed.withColumn("cell", F.explode("probes"))
        sizes = each.groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > (LARGE if level else CELL))
        sizes = stash(sizes if settled is None else sizes.join(settled, ["label", "dim", "cell"], "left_anti"), "sizes")
        thin = F.pmod(F.xxhash64("cid"), F.ceil(F.col("size") / FIT)) == 0
        sample = each.join(sizes, ["label", "dim", "cell"]).where(thin).select("label", "dim", "cell", "size", "cid", "vec")
        centres = stash(sample.groupBy("label", "dim", "cell").applyInArrow(_fit(least), "label long, dim int, cell long, centres array<double>"), "centres")
        volume = centres.agg(F.sum(8 * F.size("centres"))).first()[0]
        if not volume:
            break
        split = each.join(F.broadcast(centres) if volume <= BROADCAST_BYTES else centres, ["label", "dim", "cell"])
        parted = split.select("label", "dim", "cell", "cid", "vec", "centres").mapInArrow(_assign(least), "cid long, parts array<long>")
        kept = each.join(centres.drop("centres"), ["label", "dim", "cell"], "left_anti").select("cid", F.array("cell").alias("parts"))
        probes = parted.union(kept).groupBy("cid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("parts")))).alias("probes"))
        done = sizes.join(centres.drop("centres"), ["label", "dim", "cell"], "left_anti").drop("size")
        settled = stash(done if settled is None else settled.union(done), "settled")
        before, placed = placed, stash(placed.drop("probes").join(probes, "cid"), "cells")
        unstash(before)
    return placed


def embedding_near_dedup(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """Per row of ``vectors(vec_id, embedding, label)``: ``vec_id, n_links, component_id, kept``.

    Only vectors of one non-null label and one length are compared.  Null or empty
    vectors, those without a direction and those with null or non-finite components
    link with nothing.  Repeated rows count once; rows of one vec_id with different
    vectors are one node of the components, with links counted for each.  A row
    without vec_id has no links and a null component and is not kept.  Other columns are
    ignored.  An empty table gives an empty table.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("vec"), vectors["label"].cast("long").alias("label"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = stash(rows.withColumn("usable", usable), "vectors")
    good = rows.where("usable").select("label", "vec", "vec_id").distinct()
    classes = good.groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = stash(classes.select("label", F.size("vec").alias("dim"), "vec", "rep", "n", F.monotonically_increasing_id().alias("cid")), "classes")
    placed = _cells(classes, least)
    each = placed.withColumn("cell", F.explode("probes"))
    blocks = each.groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("label", "dim", "cell", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    dealt = each.join(blocks, ["label", "dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    key = ["label", "dim", "cell", "low", "high"]
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")
    dealt = dealt.repartition(parts(spark, count_of(classes), 50_000), *key).sortWithinPartitions(*key)
    found = stash(dealt.mapInArrow(_compare(least), "cid long, rep long, links long, lead long"), "found")
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    known = classes.join(counts, "cid", "left").select("label", "vec", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    member = stash(rows.where("usable").join(known, ["label", "vec"]).select("vec_id", "n_links", "rep"), "members")
    several = member.groupBy("vec_id").agg(F.min("rep").alias("low"), F.collect_set("rep").alias("reps")).where("size(reps) > 1")
    edges = found.select(F.col("rep").alias("a"), F.col("lead").alias("b")).union(several.select("low", F.explode("reps")))
    linked = components(edges)
    named = member.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("vec_id", "n_links", F.coalesce("component", "rep").alias("component_id"))
    # a vec_id whose row is usable elsewhere belongs to that component too
    alone = rows.where("not usable").select("vec_id").join(named.groupBy("vec_id").agg(F.min("component_id").alias("component_id")), "vec_id", "left")
    out = named.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(False)).alias("kept"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: links of cosine 0.93 and more inside labels."""
    return embedding_near_dedup(table(spark, sf_dir, "embeddings"))


ORACLE = """
with recursive v as (select vec_id, embedding::double[] as e, label from embeddings where label is not null and embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
link as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.93),
reach(node, hop) as (select vec_id, vec_id from embeddings union select r.node, l.b from reach r join link l on r.hop = l.a)
select node as vec_id, (select count(*) from link where a = node)::bigint as n_links, min(hop) as component_id, node = min(hop) as kept from reach group by node
"""
