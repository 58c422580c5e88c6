"""Exact byte-level BPE of whole texts by tree concatenation.

A long text is halved until its leaves are short.  The leaves of a batch are encoded
side by side; neighbours are then joined pairwise up the tree.  A join encodes a window
around the seam anew and widens it until both sides agree with it.

There are two kinds of seams.  Between leaves of a text the window holds some of the
tokenizer's pieces (a word with its space, a run of digits, ...) of either side.  It
starts where a piece of the left side starts, so what it finds is right but for its last
piece; where that one is the right side's own, the tokenizer stands at the same place in
both, and the rest of the right side holds.  A piece that itself goes on for long has
leaves of its own, and there the window holds tokens: when its first and last tokens are
those of the two sides, all adjacent tokens lie inside one encoding, which for
rank-ordered merges makes the joined sequence the encoding of the whole.

Pieces are looked up in a bounded memo; new ones go to the ``tokenizers`` library's model.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cinderglass.functions.spread import spread
from cinderglass.llm import words as W
from cinderglass.llm.shared import map_rows, table

#: Texts and pieces of more characters are cut into leaves of at most this size.
LEAF_CHARS = 1024
#: Characters of a text, and ids of one, that are held as Python objects at a time.
BLOCK_CHARS = 1 << 20
#: Pieces that are remembered, some 0.2 kB each.
MEMO = 300_000

_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
#: Leaves of these characters are split here, others by the library.
_PLAIN = re.compile("[^\t\n\r -~ -ɏ]")
_PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_symbols() -> dict[str, int]:
    """The printable stand-ins of the 256 byte values in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Memo(dict):
    """Ids of pieces; a new piece is learned where it is met."""

    def __init__(self, learn, known: dict[str, bytes]):
        super().__init__(known)
        self.learn = learn

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.learn(piece)
        return ids


class Codec:
    """Encoder and decoder over one tokenizer file."""

    def __init__(self, path: str, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.most = memo

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        symbols = _byte_symbols()
        special = {i: t.content for i, t in self.tok.get_added_tokens_decoder().items()}
        self.special = {t: np.array([i], "<u4").tobytes() for i, t in special.items()}
        self.marks = {t[0] for t in self.special}
        self.joins = 0
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if special else None
        n = self.tok.get_vocab_size()
        self.bytes_of = [special[i].encode() if i in special else bytes(symbols[c] for c in self.tok.id_to_token(i)) for i in range(n)]
        self.decimal = [b",%d" % i for i in range(n)]
        self.model = self.tok.model
        self.shown = {b: c for c, b in symbols.items()}
        self.space = self.shown[0x20]
        self.four = [struct.pack("<I", i) for i in range(n)]
        self.older: dict[str, bytes] = {}
        self.memo = _Memo(self._ids, self.special)

    def _raw(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]

    def pieces(self, text: str) -> list[str]:
        if not _PLAIN.search(text):
            return _PIECES.findall(text)
        return [text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)]

    def split(self, text: str) -> list[str]:
        """Pieces of a text, from those of its halves."""
        if len(text) <= LEAF_CHARS:
            return self.pieces(text)
        level = [self.pieces(text[k : k + LEAF_CHARS]) for k in range(0, len(text), LEAF_CHARS)]
        while len(level) > 1:
            level = [self._meet(level[k], level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return level[0]

    def _meet(self, left: list[str], right: list[str]) -> list[str]:
        """Pieces of two neighbours put together."""
        self.joins += 1
        width = 2
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            found = self.pieces("".join(left[a:] + right[:b]))
            if b == len(right):
                break
            if len(found) > 1 and found[-1] == right[b - 1]:
                break
            width *= 2
        del left[a:]
        left += found
        left += right[b:]
        return left

    def _ids(self, piece: str) -> bytes:
        """The ids of a piece, from the library's merges of its byte symbols."""
        if known := self.older.get(piece):
            return known
        if len(piece) > LEAF_CHARS:
            ids = self.long_piece(piece)
        elif piece.isascii() and piece.isprintable():
            ids = [t.id for t in self.model.tokenize(piece.replace(" ", self.space))]
        else:
            ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.shown))]
        return b"".join(map(self.four.__getitem__, ids))

    def long_piece(self, piece: str) -> list[int]:
        """Encode a piece by leaves and joins."""
        level = self._raw([piece[k : k + LEAF_CHARS] for k in range(0, len(piece), LEAF_CHARS)])
        while len(level) > 1:
            level = [self._join(level[k], level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        return level[0]

    def _join(self, left: list[int], right: list[int]) -> list[int]:
        width = 4
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            while a > 0 and self.bytes_of[left[a]][0] & 0xC0 == 0x80:
                a -= 1
            while b < len(right) and self.bytes_of[right[b]][0] & 0xC0 == 0x80:
                b += 1
            window = b"".join(self.bytes_of[i] for i in left[a:] + right[:b]).decode()
            ids = self._raw([window])[0]
            if (a == 0 or ids[0] == left[a]) and (b == len(right) or ids[-1] == right[b - 1]):
                return left[:a] + ids + right[b:]
            width *= 2

    def parts(self, text: str) -> Iterator[list[str]]:
        """Pieces and special tokens of a text, some ``BLOCK_CHARS`` of it at a time."""
        for part in self.cut.split(text) if any(m in text for m in self.marks) else [text]:
            if part in self.special:
                yield [part]
                continue
            held: list[str] = []
            for k in range(0, len(part), BLOCK_CHARS):
                fresh = self.split(part[k : k + BLOCK_CHARS])
                held = self._meet(held, fresh) if held else fresh
                if k + BLOCK_CHARS < len(part):
                    yield held[:-2]
                    held = held[-2:]
            yield held

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Per text, its ids as little-endian unsigned 32-bit integers."""
        for text in texts:
            text = text or ""
            if len(text) > BLOCK_CHARS or any(m in text for m in self.marks):
                yield b"".join(map(self._known, self.parts(text)))
            else:
                yield self._known(self.split(text))

    def _known(self, pieces: list[str]) -> bytes:
        """Ids of pieces.  When half of the memo is full the other half makes room; what is met again moves over."""
        if len(self.memo) > self.most // 2:
            self.older, self.memo = self.memo, _Memo(self._ids, self.special)
        return b"".join(map(self.memo.__getitem__, pieces))

    def decoded(self, ids: np.ndarray) -> Iterator[str]:
        """The text of ids, in blocks."""
        rest = codecs.getincrementaldecoder("utf-8")("replace")
        for k in range(0, len(ids), BLOCK_CHARS):
            yield rest.decode(b"".join(map(self.bytes_of.__getitem__, ids[k : k + BLOCK_CHARS].tolist())))
        yield rest.decode(b"", True)

    def decode(self, ids: np.ndarray) -> str:
        return "".join(self.decoded(ids))

    def digests(self, ids: np.ndarray) -> tuple[str, str]:
        """SHA-256 of the decimal ids joined by commas, and of the decoded text."""
        first, second = hashlib.sha256(), hashlib.sha256()
        for k in range(0, len(ids), BLOCK_CHARS):
            shown = b"".join(map(self.decimal.__getitem__, ids[k : k + BLOCK_CHARS].tolist()))
            first.update(shown if k else shown[1:])
        for text in self.decoded(ids):
            second.update(text.encode())
        return first.hexdigest(), second.hexdigest()


@functools.cache
def worker_codec(path: str, memo: int = MEMO) -> Codec:
    """One codec for all tasks of a worker: the file is parsed once, the memo stays warm."""
    return Codec(path, memo)


def _encode(path: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(path)
        for batch in batches:
            for piece in W.chunks(batch, "text"):
                counts, first, second = [], [], []
                for raw in codec.encode(piece.column("text").to_pylist()):
                    ids = np.frombuffer(raw, "<u4")
                    counts.append(len(ids))
                    a, b = codec.digests(ids) if digests else (ids.astype(np.int32), codec.decode(ids))
                    first.append(a)
                    second.append(b)
                made = [pa.array(counts, pa.int64()), pa.array(first, pa.string() if digests else pa.list_(pa.int32())), pa.array(second, pa.string())]
                yield pa.RecordBatch.from_arrays([*piece.columns, *made], names=[*piece.schema.names, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))])

    return run


def bpe_round_trip(docs: DataFrame, path: str | None = None, digests: bool = False) -> DataFrame:
    """Encode ``docs.text`` whole and decode it again.

    Adds ``n_tokens``, ``ids`` and ``decoded``, or with ``digests`` the SHA-256 of both
    (``ids_sha256`` of the decimal ids joined by commas, ``decoded_sha256``); input
    columns of these names are replaced.  Null and empty texts have no tokens.  Special
    tokens' strings in a text become their ids, as the library does by default.
    """
    names = ["n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"])]
    rest = docs.drop(*names)
    kinds = ["long", "string" if digests else "array<int>", "string"]
    made = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
    return map_rows(spread(rest), _encode(path or default_path(), digests), made)


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: token counts and digests of ids and decoded text."""
    return bpe_round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), digests=True).drop("text")
