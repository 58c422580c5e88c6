"""Substring dedup by prefix-partitioned sparse suffix trees.

Not every suffix is planted but a content-chosen few, the *anchors*: in every window of
20 words the ``PREFIX`` words with the smallest hash are its anchor, so equal windows
have equal anchors at equal offsets.  (All suffixes would need about nine times the
shuffle of the anchors, more than the disk allowed here.)

1. Anchors are dealt by the hash of their prefix.  One whose prefix occurs nowhere else
   hangs alone from the root and is left out.
2. What is left is planted: a leaf is the text from an anchor on, with the words before
   it that its windows reach.  Leaves are dealt by prefix into groups that fit in memory;
   a prefix with too many leaves is lengthened to all words of the window.
3. In each group the leaves are sorted by their text and the longest common prefixes of
   neighbours taken, byte by byte: runs of neighbours that agree in d words are the
   tree's internal nodes of depth d.  A node deep enough is split by the words before the
   anchor; each part holds the places of one repeat, which neighbouring windows extend to
   its greatest length.  All places of a repeat but the first in corpus order go.

Tasks settle the repeats among their own texts first and plant only the first place of
each, so a passage in a third of all texts reaches its group once a task.  Hashes only
bring candidates together: what goes has been compared with what stays, byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderglass.functions.spread import spread
from cinderglass.llm import words as W
from cinderglass.llm.shared import parts, stash, table, widened

WINDOW = 20
PREFIX = 5
#: Words that a task takes at once, words whose leaves a group should hold, leaves of one tree pass.
TASK_WORDS = 200_000
GROUP_WORDS = 6_000_000
TREE_LEAVES = 100_000
#: A prefix is lengthened from this many places on, and from this share of all anchors,
#: so that there are at most ``1 / HOT_LEAST`` lengthened prefixes.
HOT_PLACES, HOT_LEAST = 50_000, 1e-5

_KEY = np.dtype([("id", "<i8"), ("text", "<i8")])
_SPAN = np.dtype([("start", "<u4"), ("end", "<u4")])
_SOUGHT = "key long, n long, kid long, kh long, at binary"
_LEAF = "key long, right binary, left binary, kid long, kh long, start long, before int, n int"
_SOUGHT_NAMES = ["key", "n", "kid", "kh", "at"]
_LEAF_NAMES = ["key", "right", "left", "kid", "kh", "start", "before", "n"]
_SPAN_NAMES = ["kid", "kh", "spans"]


class _Texts:
    """Some texts, their words and the anchors of their windows."""

    def __init__(self, pieces: list[pa.RecordBatch], window: int, prefix: int):
        self.keys = np.concatenate([self._key(p) for p in pieces])
        split = [W.split(_ended(p.column("text")), W.SPACE) for p in pieces]
        self.counts = np.concatenate([np.diff(s.first) for s in split])
        h = np.concatenate([s.hashes() for s in split])
        self.first = np.cumsum(self.counts) - self.counts
        self.split = split
        owner = np.repeat(np.arange(len(self.keys)), self.counts)
        offset = np.arange(len(h)) - self.first[owner]
        whole = W.grams(h, window)
        #: Per window its first word, text, hash, and its anchor's first word and hash.
        self.start = np.flatnonzero(offset[: len(whole)] + window <= self.counts[owner[: len(whole)]])
        self.row = owner[self.start]
        self.whole = whole[self.start]
        short = W.grams(h, prefix)
        self.at = _anchors(short, self.start, window, prefix)
        self.anchor = short[self.at]

    @staticmethod
    def _key(piece: pa.RecordBatch) -> np.ndarray:
        keys = np.empty(piece.num_rows, _KEY)
        keys["id"], keys["text"] = piece.column("kid").to_numpy(), piece.column("kh").to_numpy()
        return keys

    def plain(self) -> tuple[bytes, np.ndarray]:
        """All words, each with one space after it, and where each begins; one more at the end."""
        raw = b"".join(plain_words(s) for s in self.split)
        sizes = np.concatenate([s.end - s.start for s in self.split]) + 1
        return raw, np.append(0, np.cumsum(sizes))


def _ended(text: pa.Array) -> pa.Array:
    """Texts with a space at the end, so that white space follows every word."""
    space, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    return pc.binary_join_element_wise(pc.fill_null(text.cast(pa.large_string()), ""), space, nothing)


def plain_words(split: W.Words) -> bytes:
    """The words of texts that end in white space, each with one space after it."""
    keep = ~W.SPACE[split.buf]
    keep[split.end] = True
    return np.where(W.SPACE[split.buf], 0x20, split.buf).astype(np.uint8)[keep].tobytes()


def _anchors(grams: np.ndarray, starts: np.ndarray, window: int, prefix: int) -> np.ndarray:
    """Per window start, where its anchor begins: the leftmost smallest gram inside."""
    if not len(starts):
        return starts.copy()
    best = grams[starts]
    at = starts.copy()
    for j in range(1, window - prefix + 1):
        g = grams[starts + j]
        less = g < best
        best[less] = g[less]
        at[less] = starts[less] + j
    return at


def _taken(batches: Iterator[pa.RecordBatch], window: int, prefix: int) -> Iterator[tuple[_Texts, list[pa.RecordBatch]]]:
    """Texts with about ``TASK_WORDS`` words at a time, and the rows they come from."""
    held, size = [], 0
    for batch in batches:
        for piece in W.chunks(batch, "text"):
            held.append(piece)
            size += pc.sum(pc.binary_length(piece.column("text"))).as_py() or 0
            if size >= 6 * TASK_WORDS:
                yield _Texts(held, window, prefix), held
                held, size = [], 0
    if held:
        yield _Texts(held, window, prefix), held


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Binary values of runs of 32-bit numbers."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(values.astype("<u4"))])


def _seek(window: int, prefix: int):
    """A task's anchors: those with a prefix that is its own go by prefix, others by text with a witness of the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, _ in _taken(batches, window, prefix):
            if not len(texts.at):
                continue
            new = np.append(True, texts.at[1:] != texts.at[:-1])
            anchor, at, row = texts.anchor[new], texts.at[new], texts.row[new]
            at = at - texts.first[row]
            prefixes, inverse, often = np.unique(anchor, return_inverse=True, return_counts=True)
            one = often[inverse] == 1
            keys = texts.keys[row[one]]
            yield pa.RecordBatch.from_arrays([pa.array(anchor[one].view(np.int64)), pa.array(np.ones(len(keys), np.int64)), pa.array(keys["id"]), pa.array(keys["text"]), _packed(at[one], np.arange(len(keys) + 1))], names=_SOUGHT_NAMES)
            seen = often > 1
            none = pa.nulls(int(seen.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(prefixes[seen].view(np.int64)), pa.array(often[seen].astype(np.int64)), none, none, pa.nulls(len(none), pa.binary())], names=_SOUGHT_NAMES)
            row, at = row[~one], at[~one]
            cut = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, int)
            keys = texts.keys[row[cut]]
            by = W.mix(keys["id"].view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(by), pa.array(np.zeros(len(keys), np.int64)), pa.array(keys["id"]), pa.array(keys["text"]), _packed(at, np.append(cut, len(row)))], names=_SOUGHT_NAMES)

    return run


def _repeated(least: int):
    """Over rows sorted by key: anchors whose prefix has other rows, and keys with ``least`` places and more."""
    names = [*_SOUGHT_NAMES[2:], "hot"]

    def marks(keys: list[int]) -> pa.RecordBatch:
        none = pa.nulls(len(keys), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.nulls(len(keys), pa.binary()), pa.array(keys, pa.int64())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before, total = None, None, 0  # the last row, whether the one before has its key, places of that key
        for batch in batches:
            passed = batch.filter(pc.equal(batch.column("n"), 0)).select(_SOUGHT_NAMES[2:])
            if passed.num_rows:
                yield pa.RecordBatch.from_arrays([*passed.columns, pa.nulls(passed.num_rows, pa.int64())], names=names)
            rows = batch.filter(pc.greater(batch.column("n"), 0))
            if not rows.num_rows:
                continue
            joined = pa.Table.from_batches([rows] if last is None else [last, rows]).combine_chunks().to_batches()[0]
            key, n = joined.column("key").to_numpy(), joined.column("n").to_numpy()
            same = key[1:] == key[:-1]
            beside = np.append(bool(before), same) | np.append(same, False)
            cut = np.flatnonzero(np.append(True, ~same))
            sums = np.add.reduceat(n, cut)
            sums[0] += total
            if (hot := key[cut[:-1]][sums[:-1] >= least].tolist()):
                yield marks(hot)
            take = beside & joined.column("kid").is_valid().to_numpy(False)
            take[-1] = False
            out = joined.select(_SOUGHT_NAMES[2:]).filter(pa.array(take))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.nulls(out.num_rows, pa.int64())], names=names)
            last, before, total = joined.slice(len(key) - 1), bool(same[-1]) if len(same) else before, int(sums[-1] - n[-1])
        if last is not None:
            if total + last.column("n")[0].as_py() >= least:
                yield marks([last.column("key")[0].as_py()])
            if before and last.column("kid")[0].is_valid:
                yield pa.RecordBatch.from_arrays([*last.select(_SOUGHT_NAMES[2:]).columns, pa.nulls(1, pa.int64())], names=names)

    return run


def _order(keys: np.ndarray) -> np.ndarray:
    """Each row's rank in corpus order: by id, then by the hash of its text."""
    rank = np.empty(len(keys), np.uint64)
    by = np.lexsort((keys["text"], keys["id"]))
    new = np.ones(len(keys), bool)
    new[1:] = keys[by][1:] != keys[by][:-1]
    rank[by] = np.cumsum(new) - 1
    return rank


def _leads(group: list[np.ndarray], place: np.ndarray) -> np.ndarray:
    """Per window, the first in corpus order of its group."""
    lead = np.arange(len(place))
    if not len(place):
        return lead
    by = np.lexsort((place, *group))
    new = np.ones(len(by), bool)
    new[1:] = np.any([g[by][1:] != g[by][:-1] for g in group], axis=0)
    lead[by] = by[np.flatnonzero(new)[np.cumsum(new) - 1]]
    return lead


def _spans(rows: np.ndarray, starts: np.ndarray, window: int) -> Iterator[tuple[int, bytes]]:
    """Per row, the merged word spans of windows, given sorted by row and start."""
    if not len(rows):
        return
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (starts[1:] > starts[:-1] + window)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(rows)) - 1
    out = np.empty(len(first), _SPAN)
    out["start"], out["end"] = starts[first], starts[last] + window
    owner = rows[first]
    cut = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    for low, high in zip(cut, np.append(cut[1:], len(owner)), strict=True):
        yield int(owner[low]), out[low:high].tobytes()


def _span_batch(keys: np.ndarray, rows: np.ndarray, starts: np.ndarray, window: int) -> pa.RecordBatch:
    found = list(_spans(rows, starts, window))
    at = np.array([r for r, _ in found], np.int64)
    return pa.RecordBatch.from_arrays([pa.array(keys["id"][at]), pa.array(keys["text"][at]), pa.array([b for _, b in found], pa.binary())], names=_SPAN_NAMES)


def _own_repeats(texts: _Texts, some: np.ndarray, raw: bytes, begin: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of windows ``some`` of a task's texts: which repeat an earlier one, and which are the same place once more."""
    start, row = texts.start[some], texts.row[some]
    place = (_order(texts.keys)[row] << np.uint64(32)) | (start - texts.first[row]).astype(np.uint64)
    lead = _leads([texts.whole[some], texts.anchor[some], (texts.at - texts.start)[some]], place)
    again = place > place[lead]
    double = (place == place[lead]) & (lead != np.arange(len(lead)))
    pairs = np.flatnonzero(again)
    a, b = start[pairs], start[lead[pairs]]
    new = np.append(True, (a[1:] != a[:-1] + 1) | (b[1:] != b[:-1] + 1) | (row[pairs][1:] != row[pairs][:-1])) if len(a) else np.zeros(0, bool)
    low = np.flatnonzero(new)
    high = np.append(low, len(a))[1:]
    for i, j in zip(low.tolist(), high.tolist(), strict=True):
        x, y, n = a[i], b[i], j - i - 1 + window
        if raw[begin[x] : begin[x + n]] != raw[begin[y] : begin[y + n]]:
            for t in range(i, j):
                again[pairs[t]] = raw[begin[a[t]] : begin[a[t] + window]] == raw[begin[b[t]] : begin[b[t] + window]]
    return again, double


def _plant(window: int, prefix: int, lengthened: np.ndarray):
    """Settle the repeats among a task's texts; leaves for the first places of what may occur elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (pa.RecordBatch.from_arrays([b.column("kid"), b.column("kh"), b.column("row").field("text"), b.column("at")], names=["kid", "kh", "text", "at"]) for b in batches)
        for texts, pieces in _taken(flat, window, prefix):
            marked = np.zeros(int(texts.counts.sum()) + 1, bool)
            k = 0
            for piece in pieces:
                for found in piece.column("at").to_pylist():
                    marked[np.frombuffer(b"".join(found), "<u4").astype(np.int64) + texts.first[k]] = True
                    k += 1
            some = np.flatnonzero(marked[texts.at])
            if not len(some):
                continue
            raw, begin = texts.plain()
            again, double = _own_repeats(texts, some, raw, begin, window)
            gone = some[again]
            if len(gone):
                spans = _span_batch(texts.keys, texts.row[gone], texts.start[gone] - texts.first[texts.row[gone]], window)
                n = spans.num_rows
                by = W.mix(np.asarray(spans.column("kid")).view(np.uint64)).view(np.int64)
                zeros = pa.array(np.zeros(n, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(by), spans.column("spans"), pa.nulls(n, pa.binary()), spans.column("kid"), spans.column("kh"), pa.array(np.zeros(n, np.int64)), zeros, zeros], names=_LEAF_NAMES)
            some = some[~again & ~double]
            start, at, row, anchor = texts.start[some], texts.at[some], texts.row[some], texts.anchor[some]
            longer = np.zeros(len(some), bool)
            if len(lengthened):
                longer = lengthened[np.minimum(np.searchsorted(lengthened, anchor), len(lengthened) - 1)] == anchor
            new = np.ones(len(some), bool)
            new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1) | longer[1:]
            head = np.flatnonzero(new)
            n = np.diff(np.append(head, len(some)))
            key = np.where(longer[head], W.mix(texts.whole[some][head] ^ anchor[head]), W.mix(anchor[head])).view(np.int64)
            low, mid, high = begin[start[head]], begin[at[head]], begin[start[head] + n - 1 + window]
            keys = texts.keys[row[head]]
            for k in range(0, len(head), 20_000):
                part = slice(k, k + 20_000)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key[part]),
                        pa.array([raw[a:b] for a, b in zip(mid[part].tolist(), high[part].tolist(), strict=True)], pa.binary()),
                        pa.array([raw[a:b] for a, b in zip(low[part].tolist(), mid[part].tolist(), strict=True)], pa.binary()),
                        pa.array(keys["id"][part]),
                        pa.array(keys["text"][part]),
                        pa.array((start[head] - texts.first[row[head]])[part]),
                        pa.array((at[head] - start[head])[part].astype(np.int32)),
                        pa.array(n[part].astype(np.int32)),
                    ],
                    names=_LEAF_NAMES,
                )

    return run


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, and where each value begins; one more at the end."""
    at = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0])) if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8), at - at[0]


def common_words(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words that neighbours among texts of words with a space after each have in common at their start."""
    size = np.minimum(np.diff(at)[:-1], np.diff(at)[1:])
    out = np.zeros(len(size), np.int64)
    total = np.cumsum(size)
    low = 0
    while low < len(size):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + (1 << 21), "right")))
        n = size[low:high]
        lead = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(lead, n)
        mine = np.repeat(at[low:high], n) + within
        a = buf[mine]
        same = a == buf[mine - np.repeat(at[low:high], n) + np.repeat(at[low + 1 : high + 1], n)]
        wrong = np.append(np.flatnonzero(~same), len(same))
        agree = np.minimum(wrong[np.searchsorted(wrong, lead)] - lead, n)
        spaces = np.append(0, np.cumsum(a == 0x20))
        out[low:high] = spaces[lead + agree] - spaces[lead]
        low = high
    return out


def _tree(leaves: pa.RecordBatch, window: int, prefix: int) -> pa.RecordBatch | None:
    """Repeats among leaves, given sorted by key and text: the deep nodes of their tree."""
    key, start, before, n = (leaves.column(c).to_numpy() for c in ("key", "start", "before", "n"))
    size, deepest = len(key), window - prefix
    agree = np.append(-1, common_words(*_bytes_of(leaves.column("right"))))
    agree[1:][key[1:] != key[:-1]] = -1
    left, left_at = _bytes_of(leaves.column("left"))
    ends = np.flatnonzero(left == 0x20)
    word_at = np.append(0, ends + 1)[: len(ends)]
    h = W.Words(left, left_at, word_at, ends, left_at).hashes() if len(ends) else np.zeros(0, np.uint64)
    after = np.cumsum(before.astype(np.int64))  # the place after a leaf's last word before its anchor
    node = np.empty((deepest + 1, size), np.int64)
    back = np.zeros((deepest + 1, size), np.uint64)
    for b in range(deepest + 1):
        node[b] = np.cumsum(agree < window - b)
        if b:
            has = before >= b
            back[b] = back[b - 1] * np.uint64(0x9E3779B97F4A7C15)
            back[b][has] += W.mix(h[after[has] - b])
    leaf = np.repeat(np.arange(size), n)
    step = np.arange(len(leaf)) - np.repeat(np.cumsum(n) - n, n)
    b = before[leaf] - step
    rank = np.empty(size, _KEY)
    rank["id"], rank["text"] = leaves.column("kid").to_numpy(), leaves.column("kh").to_numpy()
    place = (_order(rank)[leaf] << np.uint64(32)) | (start[leaf] + step).astype(np.uint64)
    lead = _leads([back[b, leaf], node[b, leaf] * (deepest + 1) + b], place)
    again = np.flatnonzero(place > place[lead])
    if not len(again):
        return None
    # the words before the anchor met by hash: compare them, for each pair of leaves as many as any of its windows has
    mine, other, words = leaf[again], leaf[lead[again]], b[again]
    by = np.lexsort((-words, other, mine))
    first = by[np.append(True, (mine[by][1:] != mine[by][:-1]) | (other[by][1:] != other[by][:-1]))]
    raw, cut = left.tobytes(), np.append(word_at, len(left))
    low = lambda leaves_, count: cut[after[leaves_] - count].tolist()
    high = lambda leaves_: left_at[leaves_ + 1].tolist()
    equal = [raw[p:q] == raw[r:s] for p, q, r, s in zip(low(mine[first], words[first]), high(mine[first]), low(other[first], words[first]), high(other[first]), strict=True)]
    if not all(equal):
        wrong = {(int(mine[first[k]]), int(other[first[k]])) for k, e in enumerate(equal) if not e}
        fine = [(x, y) not in wrong or raw[cut[after[x] - c] : left_at[x + 1]] == raw[cut[after[y] - c] : left_at[y + 1]] for x, y, c in zip(mine.tolist(), other.tolist(), words.tolist(), strict=True)]
        again = again[np.array(fine, bool)]
    again = again[np.argsort(place[again], kind="stable")]
    row = leaf[again]
    order = _order(rank)[row].astype(np.int64)
    keys = np.empty(int(order.max()) + 1 if len(order) else 0, _KEY)
    keys[order] = rank[row]
    return _span_batch(keys, order, start[row] + step[again], window) if len(again) else None


def _harvest(window: int, prefix: int):
    """Over leaves sorted by key and text: grow the trees of some keys at a time; pass spans through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def grown(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            if rows.num_rows > 1 and (made := _tree(rows.combine_chunks().to_batches()[0], window, prefix)) is not None:
                yield made

        for batch in batches:
            passed = batch.filter(pc.is_null(batch.column("left")))
            if passed.num_rows:
                yield pa.RecordBatch.from_arrays([passed.column("kid"), passed.column("kh"), passed.column("right")], names=_SPAN_NAMES)
            batch = batch.filter(pc.is_valid(batch.column("left")))
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= TREE_LEAVES:
                rows = pa.Table.from_batches(held)
                key = rows.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                yield from grown(rows.slice(0, cut))
                held = rows.slice(cut).combine_chunks().to_batches()
                size = rows.num_rows - cut
        if held:
            yield from grown(pa.Table.from_batches(held))

    return run


def repeated_spans(keyed: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """Spans of words covered by windows that also start earlier.

    ``keyed`` has ``kid`` (order), ``kh`` (tie order) and ``row`` with a field ``text``.
    Returns ``kid, kh, spans``: per text, arrays of packed pairs of unsigned 32-bit word
    indices.
    """
    spark = keyed.sparkSession
    volume = keyed.agg(F.sum(F.length("row.text"))).first()[0] or 0
    groups = parts(spark, volume // 6, GROUP_WORDS)
    least = max(HOT_PLACES, int(volume / 6 / (window - prefix + 2) * 2 * HOT_LEAST))
    sought = keyed.select("kid", "kh", F.col("row.text").alias("text")).mapInArrow(W.trimmed(_seek(window, prefix)), _SOUGHT)
    met = sought.repartition(groups, "key").sortWithinPartitions("key").mapInArrow(W.trimmed(_repeated(least)), "kid long, kh long, at binary, hot long")
    met = stash(met, "anchors")
    lengthened = np.sort(np.array([r.hot for r in met.where("hot is not null").select("hot").collect()], np.int64).view(np.uint64))
    places = met.where("hot is null").groupBy("kid", "kh").agg(F.collect_set("at").alias("at"))
    leaves = keyed.join(places, ["kid", "kh"]).mapInArrow(W.trimmed(_plant(window, prefix, lengthened)), _LEAF)
    grown = leaves.repartition(groups, "key").sortWithinPartitions("key", "right").mapInArrow(W.trimmed(_harvest(window, prefix)), "kid long, kh long, spans binary")
    return grown.groupBy("kid", "kh").agg(F.collect_set("spans").alias("spans"))


def _kept(piece: pa.RecordBatch, digest_only: bool) -> tuple[list[int], list[int], list[str]]:
    """Per text its words, its removed words, and the kept ones joined by one space (or their digest)."""
    split = W.split(_ended(piece.column("text")), W.SPACE)
    counts = np.diff(split.first)
    gone = np.zeros(len(split.start) + 1, np.int32)
    for k, spans in enumerate(piece.column("spans").to_pylist()):
        if spans:
            pairs = np.frombuffer(b"".join(spans), _SPAN)
            np.add.at(gone, pairs["start"].astype(np.int64) + split.first[k], 1)
            np.add.at(gone, pairs["end"].astype(np.int64) + split.first[k], -1)
    stays = np.cumsum(gone)[:-1] <= 0
    sizes = split.end - split.start + 1
    raw = np.frombuffer(plain_words(split), np.uint8)[np.repeat(stays, sizes)].tobytes()
    ends = np.append(0, np.cumsum(np.where(stays, sizes, 0)))[split.first]
    kept = [raw[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    removed = np.append(0, np.cumsum(~stays))
    return counts.tolist(), np.diff(removed[split.first]).tolist(), [hashlib.sha256(k).hexdigest() if digest_only else k.decode() for k in kept]


def substring_dedup(docs: DataFrame, window: int = WINDOW, digest_only: bool = False) -> DataFrame:
    """Remove words covered by windows of ``window`` words that also start earlier.

    Needs ``doc_id`` and ``text``.  Returns all columns of ``docs`` and ``n_words``,
    ``n_removed`` and ``kept_text`` (kept words joined by one space), or the
    ``kept_sha256`` of that text instead with ``digest_only``; columns of these
    names in the input are replaced.  Null and blank texts have no words and stay.
    A null doc_id comes last in corpus order; texts of the same doc_id are ordered
    by a hash of the text, and rows equal in both count as one text.  An empty table
    gives an empty table.
    """
    own = ["n_words", "n_removed", "kept_sha256" if digest_only else "kept_text"]
    rest = spread(docs.drop("n_words", "n_removed", own[2]))
    keyed = rest.select(F.struct(*(rest[f"`{c}`"] for c in rest.columns)).alias("row"), F.coalesce(rest["doc_id"].cast("long"), F.lit((1 << 63) - 1)).alias("kid"), F.xxhash64(F.coalesce(rest["text"], F.lit(""))).alias("kh"))
    joined = keyed.join(repeated_spans(keyed, window), ["kid", "kh"], "left").select("row", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("row")
            at = row.type.get_field_index("text")
            flat = [row.field(k) for k in range(row.type.num_fields)]
            both = pa.RecordBatch.from_arrays([flat[at], batch.column("spans"), pa.array(np.arange(batch.num_rows))], names=["text", "spans", "at"])
            for piece in W.chunks(both, "text"):
                made = _kept(piece, digest_only)
                low = piece.column("at")[0].as_py()
                columns = [c.slice(low, piece.num_rows) for c in flat]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(m, t) for m, t in zip(made, (pa.int64(), pa.int64(), pa.string()), strict=True))], names=[*(f.name for f in row.type), *own])

    return joined.mapInArrow(W.trimmed(run), widened(rest, f"n_words long, n_removed long, {own[2]} string"))


#: The same relation from all windows.
ORACLE = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i + 19], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as i from w where len(ws) >= 20)),
again as (select doc_id, i from (select *, row_number() over (partition by g order by doc_id, i) as k from win) where k > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as j from again),
word as (select doc_id, unnest(ws) as x, generate_subscripts(ws, 1) as j from w),
kept as (select doc_id, string_agg(x, ' ' order by j) as t, count(*) as n from word anti join gone using (doc_id, j) group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept using (doc_id)
"""


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: per document, words, removed words and the digest of the rest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs, digest_only=True).select("doc_id", "n_words", "n_removed", "kept_sha256")
