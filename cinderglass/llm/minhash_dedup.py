"""MinHash near-dedup: one-permutation hashing, bands, star-shaped candidates, exact check.

One hash per shingle fills all bins of a signature (one permutation); an empty bin
takes the value of the first filled bin in an order of its own, the same for all
texts (optimal densification).  Bands of bins give buckets.  A bucket of m texts
gives m - 1 candidates, from its hub to the others, so pairs stay in proportion to
texts.  Candidates are confirmed on the full shingle sets.

Texts with the same set are one class from the start.  A link can hide behind a hub
that is similar to neither end, so rounds follow, each with other hubs: buckets whose
texts are still in different components get a new star over those, as long as that
pays.  What is then still mixed gets an exact finish: a text's shingles are
put in one order, rare ones first, and two texts with a link share one among the first
few of each (prefix filter), so all pairs of different components that do are checked,
except those that their sizes or the places of the shared shingle rule out.  With 48
bands of 5 bins a pair at similarity 0.8 shares no bucket with a chance of 5e-9; none
that shares one is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderglass.functions.spread import spread
from cinderglass.llm import words as W
from cinderglass.llm.graph import merged
from cinderglass.llm.shared import count_of, stash, table, unstash

BANDS, ROWS = 48, 5
#: Stars go on while one in so many of their candidates is a link; the finish takes the rest.
YIELD = 20
#: Ids of candidates are broadcast to thin out the texts up to this many (8 bytes each).
BROADCAST_IDS = 4_000_000
#: Texts from which the finish learns which shingles are rare, and slots of its counts.
RARE_SAMPLE, RARE_SLOTS = 50_000, 1 << 20
#: Texts of one shingle that a task of the finish pairs with others at a time.
BLOCK = 2_000

_DONORS = np.argsort(np.random.Generator(np.random.PCG64(11)).random((BANDS * ROWS, BANDS * ROWS)), axis=1)


def shingle_sets(piece: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    """Per text, the sorted distinct hashes of its k-word shingles.

    A text of fewer words has its whole sequence as one; one without words has none.
    """
    split = W.split(piece.column("text"), W.SPACE)
    h = split.hashes(W.LOWER)
    g = W.grams(h, k)
    for low, high in zip(split.first[:-1], split.first[1:], strict=True):
        if high - low >= k:
            yield np.unique(g[low : high - k + 1])
        elif high > low:
            yield W.grams(h[low:high], high - low) ^ np.uint64(high - low)
        else:
            yield g[:0]


def signature(values: np.ndarray, bins: int = BANDS * ROWS) -> np.ndarray:
    """One-permutation MinHash of a sorted, non-empty set, densified."""
    where = ((values >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.append(True, where[1:] != where[:-1])
    out = np.zeros(bins, np.uint64)
    filled = np.zeros(bins, bool)
    out[where[first]] = values[first]
    filled[where] = True
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = _DONORS[empty]
        out[empty] = out[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return out


def _sign(k: int):
    names = ["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.chunks(batch, "text"):
                counts, sums, signed = [], [], []
                for s in shingle_sets(piece, k):
                    counts.append(len(s))
                    sums.append((W.mix(s).sum(), W.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum()))
                    signed.append(signature(s) if len(s) else np.zeros(BANDS * ROWS, np.uint64))
                band = np.array(signed, np.uint64).reshape(-1, BANDS, ROWS)
                keys = np.zeros(band.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for j in range(ROWS):
                    keys = W.mix(keys * np.uint64(0x9E3779B97F4A7C15) + band[:, :, j])
                sums_ = np.array(sums, np.uint64).reshape(-1, 2).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text_hash"), pa.array(counts, pa.int64()), pa.array(sums_[:, 0].copy()), pa.array(sums_[:, 1].copy()), lists], names=names)

    return run


def _confirm(k: int, percent: int):
    """Keep pairs (a, b) whose texts' sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen_id, seen = None, None
        for batch in batches:
            kept: list[tuple[int, int]] = []
            hubs, row = batch.column("text_a"), -1
            for piece in W.chunks(batch.select(["a", "b", "text"]), "text"):
                ids = zip(piece.column("a").to_pylist(), piece.column("b").to_pylist(), strict=True)
                for (a, b), other in zip(ids, shingle_sets(piece, k), strict=True):
                    row += 1
                    if a != seen_id:
                        seen = next(shingle_sets(pa.RecordBatch.from_arrays([hubs.slice(row, 1)], names=["text"]), k))
                        seen_id = a
                    common = len(seen) + len(other) - len(np.unique(np.concatenate([seen, other])))
                    if 100 * common >= percent * (len(seen) + len(other) - common):
                        kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], pa.int64()), pa.array([x for _, x in kept], pa.int64())], names=["a", "b"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of ``texts(cls, text)`` that pass the check on full sets."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    ids = F.broadcast(ids) if count_of(ids) <= BROADCAST_IDS else ids
    own = texts.join(ids, "cls", "left_semi")
    right = pairs.join(own.select(F.col("cls").alias("b"), "text"), "b")
    both = right.join(own.select(F.col("cls").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text", "text_a").mapInArrow(W.trimmed(_confirm(k, percent)), "a long, b long")


def _frequencies(k: int):
    """Counts of shingles by slot, over a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RARE_SLOTS, np.int64)
        for batch in batches:
            for piece in W.chunks(batch, "text"):
                for s in shingle_sets(piece, k):
                    np.add.at(total, (s % np.uint64(RARE_SLOTS)).astype(np.int64), 1)
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total[slots])], names=["slot", "n"])

    return run


def _prefixes(k: int, percent: int, frequency: np.ndarray):
    """Per text, the shingles of which one must be shared for a link: token and place.

    Any order that is the same for all texts is right; rare first gives few pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.chunks(batch, "text"):
                for i, s in enumerate(shingle_sets(piece, k)):
                    n = len(s)
                    long = n - (percent * n + 99) // 100 + 1
                    token = s[np.lexsort((s, frequency[(s % np.uint64(RARE_SLOTS)).astype(np.int64)]))[:long]]
                    same = lambda name: pa.array([piece.column(name)[i].as_py()] * len(token), pa.int64())  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), same("cls"), same("component"), pa.array(np.full(len(token), n)), pa.array(np.arange(len(token)))], names=["token", "cls", "component", "n", "at"])

    return run


def _finish(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Every pair ``a < b`` of ``texts(cls, component, text)`` that may be a link between components."""
    total = count_of(texts)
    sample = texts.where(F.pmod(F.xxhash64("cls"), F.lit(max(1, total // RARE_SAMPLE))) == 0).select("text")
    counted = sample.mapInArrow(W.trimmed(_frequencies(k)), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(RARE_SLOTS, np.int32)
    frequency[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    rows = stash(texts.mapInArrow(W.trimmed(_prefixes(k, percent, frequency)), "token long, cls long, component long, n long, at long"), "prefixes")
    hot = rows.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token", F.ceil(F.col("m") / BLOCK).cast("int").alias("salts"))
    rows = stash(rows.join(hot, "token"), "prefixes")
    left = rows.withColumn("salt", F.pmod(F.xxhash64("cls"), "salts").cast("int")).alias("l")
    right = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("r")
    pairs = left.join(right, ["token", "salt"]).where("l.cls < r.cls and l.component <> r.component")
    pairs = pairs.where(f"100 * least(l.n, r.n) >= {percent} * greatest(l.n, r.n)")
    # Of the shingles a pair shares the first one passes: no more than what follows it can be shared.
    pairs = pairs.where(f"{100 + percent} * least(l.n - l.at, r.n - r.at) >= {percent} * (l.n + r.n)")
    return pairs.select(F.col("l.cls").alias("a"), F.col("r.cls").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id, n_shingles, component_id, kept``.

    Shingles are k words, A-Z lower-cased; links hold from ``percent`` % similarity;
    ``component_id`` is the smallest doc_id reachable.  Null, empty and blank texts
    have no shingles and no links.  Rows of one doc_id with different texts are one
    node, linked by what any of them links to; each gives a row.  A row without a doc_id
    gets a null component and is not kept.  Other columns are ignored; an empty table
    gives an empty table.
    """
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).withColumn("text_hash", F.xxhash64("text"))
    signed = stash(spread(texts).mapInArrow(W.trimmed(_sign(k)), "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>"), "signatures")
    sets = signed.where("n_shingles > 0 and doc_id is not null")
    same = ["n_shingles", "set_a", "set_b"]
    classes = sets.groupBy(*same).agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("bands").alias("bands"))
    classes = stash(classes.select(F.monotonically_increasing_id().alias("cls"), *same, "rep", "bands"), "classes")
    placed = classes.select("cls", F.posexplode("bands").alias("band", "bucket"))
    buckets = placed.groupBy("band", "bucket").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high").select("band", "bucket")
    shared = stash(placed.join(buckets, ["band", "bucket"]), "buckets")
    wanted = classes.select("cls", "rep.*").join(shared.select("cls").distinct(), "cls", "left_semi")
    one_each = stash(texts.where("doc_id is not null").join(_broadcastable(wanted), ["doc_id", "text_hash"]).groupBy("cls").agg(F.max("text").alias("text")), "texts")
    tried = docs.sparkSession.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    grouped = shared.withColumn("component", F.col("cls"))
    labels = None
    turn = 0
    while True:
        order = F.struct(F.lit(0), "cls") if not turn else F.struct(F.xxhash64("cls", "band", F.lit(turn)), "cls")
        hubs = grouped.groupBy("band", "bucket").agg(F.min(F.struct(order.alias("o"), F.col("cls").alias("hub"), F.col("component").alias("own"))).alias("h")).select("band", "bucket", "h.hub", "h.own")
        star = grouped.join(hubs, ["band", "bucket"]).where("component <> own").select(F.least("hub", "cls").alias("a"), F.greatest("hub", "cls").alias("b")).distinct()
        new = stash(star.join(tried, ["a", "b"], "left_anti"), "candidates")
        tested = count_of(new)
        tried = tried.union(new)
        found = stash(confirmed(new, one_each, k, percent), "links")
        labels = merged(labels, found)
        turn += 1
        before = grouped
        named = shared.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "band", "bucket", F.coalesce("component", "cls").alias("component"))
        named = stash(named, "grouped")
        mixed = named.groupBy("band", "bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("band", "bucket")
        grouped = stash(named.join(mixed, ["band", "bucket"]), "grouped")
        unstash(before, named)
        if YIELD * count_of(found) < tested or not tested:
            break
    left = stash(grouped.select("cls", "component").distinct(), "mixed")
    if count_of(left):
        pairs = _finish(stash(one_each.join(_broadcastable(left), "cls"), "mixed"), k, percent)
        found = stash(confirmed(stash(pairs.join(tried, ["a", "b"], "left_anti"), "candidates"), one_each, k, percent), "links")
        labels = merged(labels, found)
    member = stash(signed.drop("bands", "text_hash").join(classes.select("cls", *same, F.col("rep.doc_id").alias("rep")), same, "left").select("doc_id", "n_shingles", "cls", "rep"), "members")
    several = member.where("doc_id is not null and cls is not null").groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("high")).where("a <> high")
    crossing = several.join(member.select("doc_id", F.col("cls").alias("b")), "doc_id").where("a <> b").select("a", "b")
    labels = merged(labels, crossing)
    linked = labels.join(classes.select(F.col("cls").alias("node"), F.col("rep.doc_id").alias("rep")), "node")
    first = linked.join(linked.groupBy("component").agg(F.min("rep").alias("label")), "component").select(F.col("node").alias("cls"), "label")
    named = member.where("doc_id is not null and cls is not null").join(first, "cls", "left").select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
    # a text without shingles whose id has other texts belongs with them
    alone = member.where("doc_id is null or cls is null").select("doc_id", F.col("n_shingles"))
    alone = alone.join(named.groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return named.unionByName(alone).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(False)).alias("kept"))


def _broadcastable(ids: DataFrame) -> DataFrame:
    ids = stash(ids, "ids")
    return F.broadcast(ids) if count_of(ids) <= BROADCAST_IDS else ids


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: shingles of four words, similarity of 80 % or more."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, percent=80)


#: The same relation from all pairs that share a shingle.
ORACLE = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
  from documents
), s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' '))) end as sh
  from w
), e as (select doc_id, len(sh) as n, unnest(sh) as g from s),
common as (
  select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as c
  from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by all
), link as (select a, b from common where 100 * c >= 80 * (na + nb - c)),
both_ways as (select a, b from link union select b, a from link),
reach(node, hop) as (
  select doc_id, doc_id from s union select r.node, l.b from reach r join both_ways l on r.hop = l.a
)
select s.doc_id, len(sh)::bigint as n_shingles, c.component_id, s.doc_id = c.component_id as kept
from s join (select node, min(hop) as component_id from reach group by node) c on c.node = s.doc_id
"""
