"""Benchmark decontamination with one Aho-Corasick automaton over normalised words.

The benchmark is data of a bounded size: more than ``MOST_WORDS`` words are refused.

Each distinct benchmark word is one symbol, every other word a common filler, so a
text becomes a string with one symbol a word and the automaton scans it once; a
match's place in that string is a word number, which maps back to the original text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderglass.functions.spread import spread
from cinderglass.llm import words as W
from cinderglass.llm.shared import map_rows, table

WINDOW = 10
#: Bound on the benchmark's words: the automaton takes about 0.6 kB of a worker's memory for each.
MOST_WORDS = 500_000
#: Bytes of a text that are scanned at a time.
SCAN_BYTES = 1 << 20
#: Text that is held as Python strings at a time.
PIECE_BYTES = 1 << 22

_MAP = bytes(32 if W.NOT_ALNUM[W.LOWER[b]] else int(W.LOWER[b]) for b in range(256))
_FILLER = "\0"


class _Symbols(dict):
    def __missing__(self, word: bytes) -> str:
        return _FILLER


def normal_words(text: str | None) -> list[bytes]:
    """Words of a text after lower-casing A-Z."""
    return (text or "").encode().translate(_MAP).split()


def _symbol(n: int) -> str:
    return chr(n + 1 if n < 0xD7FF else n + 1 + 0x800)


class Matcher:
    """The automaton over the windows of some items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.symbols = _Symbols()
        self.tree = ahocorasick.Automaton()
        windows: dict[str, set[str]] = {}
        for item, text in items:
            found = normal_words(text)
            coded = "".join(self.symbols.setdefault(w, _symbol(len(self.symbols))) for w in found)
            for at in range(max(1, len(coded) - window + 1)) if coded else ():
                owners = windows.setdefault(coded[at : at + window], set())
                if item is not None:
                    owners.add(item)
        for key, owners in windows.items():
            self.tree.add_word(key, (len(key), tuple(owners)))
        if windows:
            self.tree.make_automaton()
        self.empty = not windows
        self.longest = max(map(len, windows), default=0)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, merged spans of words hit, and the items that occur."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        total, carried = 0, ""
        for found in _word_blocks(text):
            if not self.empty:
                coded = carried + "".join(map(self.symbols.__getitem__, found))
                base = total - len(carried)
                for last, (size, owners) in self.tree.iter(coded):
                    if last < len(carried):
                        continue
                    low, high = base + last + 1 - size, base + last + 1
                    while spans and spans[-1][1] >= low:
                        low = min(low, spans.pop()[0])
                    spans.append((low, high))
                    items.update(owners)
                carried = coded[max(0, len(coded) - self.longest + 1) :] if self.longest > 1 else ""
            total += len(found)
        return total, spans, items


def _word_blocks(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, some ``SCAN_BYTES`` of it at a time; no word is cut."""
    raw = (text or "").encode().translate(_MAP)
    at = 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= SCAN_BYTES else raw.find(b" ", at + SCAN_BYTES)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


_SPANS = "spans array<struct<start: long, end: long>>"


def _chars(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets in the original text of spans of words."""
    raw = text.encode()
    split = W.split(pa.array([text]), W.NOT_ALNUM_ANY_CASE)
    lead = np.append(0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))
    return [(int(lead[split.start[a]]), int(lead[split.end[b - 1]])) for a, b in spans]


def _scan(items: list[tuple[str | None, str | None]], window: int):
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    named = lambda rows: pa.array([[{"start": a, "end": b} for a, b in x] for x in rows], pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, window)
        for batch in batches:
            for piece in W.chunks(batch, "text", PIECE_BYTES):
                texts = piece.column("text").to_pylist()
                rows = [matcher.scan(t) for t in texts]
                made = [
                    pa.array([r[0] for r in rows], pa.int64()),
                    named([r[1] for r in rows]),
                    pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string())),
                    named([_chars(t, r[1]) if r[1] else [] for t, r in zip(texts, rows, strict=True)]),
                ]
                yield pa.RecordBatch.from_arrays([*piece.columns, *made], names=[*piece.schema.names, "n_words", "spans", "items", "offsets"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Mark words of ``docs.text`` inside any window of a benchmark text.

    Windows are ``window`` consecutive words of an item, or all words of a shorter
    one.  Adds ``n_words``, ``spans`` (merged spans of words hit), ``items`` (ids with
    occurring windows, sorted as strings) and ``offsets`` (the spans as character
    offsets in the original text); input columns of these names are replaced.  Null
    texts have no words; items without words are ignored, an item without id marks
    words only.  A benchmark of more than ``MOST_WORDS`` words raises an error.
    """
    own = ["n_words", "spans", "items", "offsets"]
    texts = benchmark.select(benchmark["item_id"].cast("string").alias("item_id"), benchmark["text"].alias("text"))
    size = texts.agg(F.sum(F.size(F.split("text", r"[^0-9A-Za-z\x{80}-\x{10FFFF}]+")))).first()[0] or 0
    if size > MOST_WORDS:
        raise ValueError(f"a benchmark of {size} words is beyond the automaton's bound of {MOST_WORDS}")
    items = [tuple(r) for r in texts.collect()]
    rest = docs.drop(*own)
    return map_rows(spread(rest), _scan(items, window), f"n_words long, {_SPANS}, items array<string>, offsets array<struct<start: long, end: long>>")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: words hit and items found per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


ORACLE = r"""
with low as (select doc_id as id, false as item, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
  union all select item_id, true, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark),
w as (select id, item, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from low),
pat as (select distinct id::varchar as item_id, least(10, len(ws)) as n, unnest(list_transform(range(1, greatest(1, len(ws) - 9) + 1), lambda i: array_to_string(ws[i:i + 9], ' '))) as p
  from w where item and len(ws) > 0),
sizes as (select distinct n from pat),
win as (select id, n, unnest(range(1, len(ws) - n + 2)) as i, ws from w, sizes where not item and len(ws) >= n),
hit as (select h.id, h.i, h.n, pat.item_id from (select id, n, i, array_to_string(ws[i:i + n - 1], ' ') as p from win) h join pat on pat.p = h.p and pat.n = h.n),
covered as (select id, count(distinct j) as c from (select id, unnest(range(i, i + n)) as j from (select distinct id, i, n from hit)) group by id),
named as (select id, count(*) as k, string_agg(item_id, ',' order by item_id) as s from (select distinct id, item_id from hit) group by id)
select w.id as doc_id, len(ws)::bigint as n_words, coalesce(c, 0)::bigint as n_hit, coalesce(k, 0)::bigint as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(c, 0) > 0 as contaminated
from w left join covered using (id) left join named using (id) where not item
"""
