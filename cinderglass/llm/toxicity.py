"""Toxicity: boosted trees over dense text features, calibrated by isotonic regression.

A lexicon of words and word beginnings is learned from labelled training rows by log
odds; features are its densities, how often second-person words stand near its words,
rates of capitals, punctuation and disguised words, and length.  Features of training
rows take their lexicon from the other folds, so the trees do not trust words that
only their own row vouches for.  The labelled sample is bounded (``TRAIN_ROWS``, chosen
by a hash of the id); every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderglass.functions.spread import spread
from cinderglass.llm import words as W
from cinderglass.llm.boosting import Boosted, Isotonic, _sigmoid
from cinderglass.llm.shared import map_rows, stash, table

#: Bound on labelled rows that the model is fitted on, and on entries of the lexicon.
TRAIN_ROWS = 20_000
LEXICON = 20_000
FOLDS = 4
#: Text whose lexicon candidates are counted at once.
COUNT_BYTES = 1 << 20
THRESHOLD = 0.7
#: Word beginnings (in bytes) that are lexicon candidates beside whole words.
STEMS = (4, 5, 6, 7, 8)
NEAR = 5

#: Second-person words of the corpus languages.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta vous votre tú ti tus usted ustedes vosotros".split()
_KINDS = np.arange(256)
_UPPER, _DIGIT = (_KINDS >= 65) & (_KINDS <= 90), (_KINDS >= 48) & (_KINDS <= 57)
_MARK = W.NOT_ALNUM & ~W.SPACE & ~_UPPER
_MARKS = [ord("!") == _KINDS, ord("?") == _KINDS]

_LEET = W.LOWER.copy()
for _from, _to in zip("013457@$", "oieastas", strict=True):
    _LEET[ord(_from)] = ord(_to)
_DISGUISE = W.NOT_ALNUM[_LEET]
_SECOND = np.sort(W.split(pa.array([" ".join(SECOND_PERSON)]), W.SPACE).hashes())


def _grams(split: W.Words, table: np.ndarray) -> list[np.ndarray]:
    """Per kind of lexicon entry, each word's hash; stems only of longer words."""
    out = [split.hashes(table)]
    size = split.end - split.start
    for n in STEMS:
        h = split.hashes(table, longest=n)
        out.append(np.where(size > n, W.mix(h + np.uint64(n)), np.uint64(0)))
    return out


def _running(kind: np.ndarray, buf: np.ndarray) -> np.ndarray:
    """How many of the bytes before each place, and before the end, are of a kind."""
    out = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(kind[buf], dtype=np.int32, out=out[1:])
    return out


@dataclass
class Lexicon:
    keys: np.ndarray  # sorted hashes
    weights: np.ndarray

    def __post_init__(self):
        self.hint = np.zeros(1 << 20, bool)
        self.hint[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def weight(self, grams: list[np.ndarray]) -> np.ndarray:
        """Per word, the largest weight of its entries, 0 without any."""
        best = np.zeros(len(grams[0]))
        if not len(self.keys):
            return best
        for g in grams:
            some = np.flatnonzero(self.hint[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, g[some]), len(self.keys) - 1)
            best[some] = np.maximum(best[some], np.where(self.keys[at] == g[some], self.weights[at], 0))
        return best


def features(piece: pa.RecordBatch, lexicons: list[Lexicon], which: np.ndarray | None = None) -> np.ndarray:
    """Dense features, a row a text; ``which`` picks the lexicon of each text."""
    split = W.split(piece.column("text"), W.NOT_ALNUM_ANY_CASE)
    n, owner = piece.num_rows, split.owner()
    grams = _grams(split, W.LOWER)
    disguised = W.split(piece.column("text"), _DISGUISE)
    grams2, owner2 = [disguised.hashes(_LEET)], disguised.owner()
    if which is None:
        weight, weight2 = lexicons[0].weight(grams), lexicons[0].weight(grams2)
    else:
        weight, weight2 = (np.choose(which[o], [x.weight(g) for x in lexicons]) for o, g in ((owner, grams), (owner2, grams2)))
    words = np.maximum(np.diff(split.first), 1)
    size = np.maximum(np.diff(split.text_at), 1)
    per = lambda mask, o, values=None: np.bincount(o[mask], None if values is None else values[mask], n)
    hit, strong, hit2 = weight > 0.5, weight > 2.5, weight2 > 2.5
    you = _SECOND[np.minimum(np.searchsorted(_SECOND, grams[0]), len(_SECOND) - 1)] == grams[0]
    beside = np.cumsum(np.append(0, you))
    at = np.arange(len(you))
    near = beside[np.minimum(at + NEAR + 1, split.first[owner + 1])] - beside[np.maximum(at - NEAR, split.first[owner])] > 0
    most = np.zeros(n)
    np.maximum.at(most, owner[hit], weight[hit])
    long = split.end - split.start
    raised = _running(_UPPER, split.buf)
    uppers = np.diff(raised[split.text_at])
    shouted = (raised[split.end] - raised[split.start] == long) & (long > 2)
    del raised
    digits = _running(_DIGIT, split.buf)
    k = digits[split.end] - digits[split.start]
    del digits
    mixed = (k > 0) & (k < long)
    single = long == 1
    of = lambda kind: np.diff(_running(kind, split.buf)[split.text_at])
    shown2 = per(hit2, owner2) - per(strong, owner)
    return np.column_stack([
        per(strong, owner) / words, np.log1p(per(strong, owner)), per(hit, owner) / words, per(hit, owner, weight) / words, most,
        per(strong & near, owner) / words, per(you, owner) / words, uppers / size, per(shouted, owner) / words,
        of(_MARK) / size, *(of(kind) / size for kind in _MARKS), per(mixed, owner) / words,
        np.maximum(shown2, 0) / words, np.minimum(shown2, 3).clip(0), per(single, owner) / words, np.log1p(np.diff(split.first)),
    ])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per lexicon candidate, fold and label, how many texts of a batch have it."""
    for batch in batches:
        for piece in W.chunks(batch, "text", COUNT_BYTES):
            split = W.split(piece.column("text"), W.NOT_ALNUM_ANY_CASE)
            grams = np.concatenate(g := _grams(split, W.LOWER))
            owner = np.tile(split.owner(), len(g))
            owner, grams = owner[grams != 0], grams[grams != 0]
            _, once = np.unique(W.mix(grams ^ W.mix(owner.astype(np.uint64) + np.uint64(1))), return_index=True)
            owner, grams = owner[once], grams[once]
            side = piece.column("fold").to_numpy()[owner] * 2 + piece.column("toxic").to_numpy()[owner]
            keys, inverse = np.unique(grams, return_inverse=True)
            counts = np.zeros((len(keys), 2 * FOLDS), np.int64)
            np.add.at(counts, (inverse, side), 1)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *(pa.array(counts[:, j].copy()) for j in range(2 * FOLDS))], names=["gram", *(f"c{j}" for j in range(2 * FOLDS))])


def _lexicon(keys: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> Lexicon:
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    own = (toxic >= 2) & (odds > 0.5)
    return Lexicon(keys[own], odds[own])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Boosted
    scale: Isotonic

    def probability(self, piece: pa.RecordBatch) -> np.ndarray:
        raw = self.trees.score(features(piece, [self.lexicon]))
        # the isotonic steps are flat; a fiftieth of the trees' own probability keeps their order
        return np.clip(0.98 * self.scale.value(raw) + 0.02 * _sigmoid(raw), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows outside the held-out third (crc32 of the id mod 3 is 1).

    At most ``TRAIN_ROWS`` ids, those with the smallest hash; of several texts of an id
    one is taken.  Without labelled rows, or with one class only, every text gets that class's share.
    """
    own = labels.where("doc_id is not null and toxic is not null").groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    own = own.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").join(F.broadcast(own), "doc_id")
    fold = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(FOLDS)).cast("int")
    rows = stash(rows.groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).withColumn("fold", fold), "labelled")
    names = [f"c{j}" for j in range(2 * FOLDS)]
    counts = rows.mapInArrow(W.trimmed(_count), "gram long, " + ", ".join(f"{c} long" for c in names)).groupBy("gram").agg(*(F.sum(c).alias(c) for c in names))
    toxic = sum((F.col(c) for c in names[1::2]), F.lit(0))
    clean = sum((F.col(c) for c in names[0::2]), F.lit(0))
    sizes = {(r.fold, r.toxic): r.n for r in rows.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic = sum(n for (_, t), n in sizes.items() if t)
    n_clean = sum(n for (_, t), n in sizes.items() if not t)
    lift = F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((clean + 0.5) / (n_clean + 1))
    found = counts.where((toxic >= 2) & (lift > 0.5)).orderBy((lift * F.sqrt(toxic)).desc(), "gram").limit(LEXICON).collect()
    grid = np.array([[r[c] for c in names] for r in found], np.int64).reshape(-1, 2 * FOLDS)
    keys = np.array([r.gram for r in found], np.int64).view(np.uint64)
    order = np.argsort(keys)
    keys, grid = keys[order], grid[order]
    whole = _lexicon(keys, grid[:, 1::2].sum(1), grid[:, 0::2].sum(1), n_toxic, n_clean)
    others = []
    for f in range(FOLDS):
        rest = [g for g in range(FOLDS) if g != f]
        others.append(_lexicon(keys, grid[:, [2 * g + 1 for g in rest]].sum(1), grid[:, [2 * g for g in rest]].sum(1), sum(sizes.get((g, 1), 0) for g in rest), sum(sizes.get((g, 0), 0) for g in rest)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.chunks(batch, "text"):
                x = features(piece, others, piece.column("fold").to_numpy())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("fold"), piece.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "fold", "toxic", "x"])

    made = sorted(rows.mapInArrow(W.trimmed(run), "doc_id long, fold int, toxic int, x array<double>").collect(), key=lambda r: (r.doc_id, r.x))
    width = features(pa.RecordBatch.from_arrays([pa.array([""])], names=["text"]), [whole]).shape[1]
    x = np.array([r.x for r in made]).reshape(-1, width)
    y = np.array([r.toxic for r in made], float)
    folds = np.array([r.fold for r in made], int)
    out_of_fold = np.zeros(len(y))
    for f in range(FOLDS):
        if (folds == f).any():
            out_of_fold[folds == f] = Boosted().fit(x[folds != f], y[folds != f]).score(x[folds == f])
    trees = Boosted().fit(x, y)
    return Model(whole, trees, Isotonic().fit(out_of_fold, y))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(model.probability(piece))], names=[*piece.schema.names, "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score``, ``predicted`` (score >= threshold) and ``held_out`` to ``docs``.

    Only the text is scored; null and empty texts get a score too.  Input columns of
    these names are replaced.  A null doc_id is not held out and carries no label; of
    several labels of one id, a toxic one counts.
    """
    model = fit(docs, labels)
    rest = docs.drop("score", "predicted", "held_out")
    scored = map_rows(spread(rest), _score(model), "score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.withColumns({"held_out": held, "predicted": (F.col("score") >= threshold).cast("int")})


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: a score for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")).select("doc_id", "held_out", "score", "predicted")
