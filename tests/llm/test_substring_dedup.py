import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from cinderglass.llm import substring_dedup as module
from cinderglass.llm.substring_dedup import op10_substring_dedup, substring_dedup


def brute(rows, window):
    """rows: (doc_id, text) with distinct ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        tokens = (text or "").encode().split()
        gone = [False] * len(tokens)
        for i in range(len(tokens) - window + 1):
            key = tuple(tokens[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = b" ".join(t for t, g in zip(tokens, gone) if not g)
        out[doc_id] = (len(tokens), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [[f"w{rng.randrange(40)}é" for _ in range(rng.randrange(15, 60))] for _ in range(12)]
    rows = [(i, None), (i + 1, ""), (i + 2, " \n\t")] if (i := 500) else []
    for d in range(300):
        tokens = []
        for _ in range(rng.randrange(1, 5)):
            tokens += rng.choice(pool) if rng.random() < 0.5 else [f"x{rng.randrange(9)}" for _ in range(rng.randrange(30))]
        rows.append((d, rng.choice([" ", "\n", " \t "]).join(tokens)))
    rows.append((600, "a " * 300))
    rows.append((601, " ".join("ab") + " c" * 50))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), digest_only=True).collect()}
    assert got == brute(rows, 20)


def test_lengthened_prefixes_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(module, "HOT_PLACES", 2)
    monkeypatch.setattr(module, "HOT_LEAST", 0)
    rng = random.Random(3)
    rows = [(d, " ".join(f"x{rng.randrange(9)}" for _ in range(9)) + " p" * 25 + f" q{d} " + " ".join(f"r{i}" for i in range(30))) for d in range(200)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), digest_only=True).collect()}
    assert got == brute(rows, 20)


def test_whole_small_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in op10_substring_dedup(spark, d).collect()}
    assert got == brute(rows, 20)


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(40))
    df = spark.createDataFrame([(1, long, 7, "x"), (1, long, 8, "y"), (None, long, 9, "z"), (2, "short", 1, None)], "doc_id long, text string, n_words int, kid string")
    rows = {(r.doc_id, r.kid): (r.n_words, r.n_removed) for r in substring_dedup(df).collect()}
    assert rows == {(1, "x"): (40, 0), (1, "y"): (40, 0), (None, "z"): (40, 40), (2, None): (1, 0)}
    assert substring_dedup(df.limit(0)).count() == 0


def local(rows, window, tasks, hot):
    """All steps without Spark; ``hot`` places lengthen a prefix.  Words removed per doc_id."""
    prefix = module.PREFIX
    docs = pa.RecordBatch.from_pydict({"kid": [i for i, _ in rows], "kh": [0] * len(rows), "text": [t for _, t in rows]}, schema=pa.schema([("kid", pa.int64()), ("kh", pa.int64()), ("text", pa.string())]))
    deal = [docs.take(pa.array(range(k, len(rows), tasks), pa.int64())) for k in range(tasks)]
    ordered = lambda found, by: pa.Table.from_batches(found).sort_by([(b, "ascending") for b in by]).combine_chunks().to_batches(max_chunksize=7)
    sought = [b for d in deal for b in module._seek(window, prefix)(iter([d]))]
    met = pa.Table.from_batches(list(module._repeated(hot)(iter(ordered(sought, ["key"]))))).to_pylist()
    at, spans = {}, {}
    for r in met:
        if r["hot"] is None:
            at.setdefault(r["kid"], set()).add(r["at"])
    lengthened = np.sort(np.array([r["hot"] for r in met if r["hot"] is not None], np.int64).view(np.uint64))
    leaves = []
    for d in deal:
        own = d.filter(pa.array([k in at for k in d.column("kid").to_pylist()], pa.bool_()))
        row = pa.StructArray.from_arrays([own.column("text")], names=["text"])
        sent = pa.RecordBatch.from_arrays([own.column("kid"), own.column("kh"), row, pa.array([list(at[k]) for k in own.column("kid").to_pylist()], pa.list_(pa.binary()))], names=["kid", "kh", "row", "at"])
        leaves += list(module._plant(window, prefix, lengthened)(iter([sent])))
    if leaves:
        for b in module._harvest(window, prefix)(iter(ordered(leaves, ["key", "right"]))):
            for r in b.to_pylist():
                spans.setdefault(r["kid"], []).append(r["spans"])
    piece = pa.RecordBatch.from_arrays([docs.column("text"), pa.array([spans.get(i) for i, _ in rows], pa.list_(pa.binary()))], names=["text", "spans"])
    return len(lengthened), {i: (n, gone, digest) for (i, _), n, gone, digest in zip(rows, *module._kept(piece, True), strict=True)}


@pytest.mark.parametrize("mask", [0xFFFFFFFFFFFFFFFF, 0xF])
def test_steps_at_any_size_and_with_clashing_hashes(monkeypatch, mask):
    grams = module.W.grams
    monkeypatch.setattr(module.W, "grams", lambda h, k: grams(h, k) & np.uint64(mask))
    rng = random.Random(mask % 99)
    longer = 0
    for turn in range(40):
        monkeypatch.setattr(module, "TREE_LEAVES", rng.choice([1, 5, 1000]))
        monkeypatch.setattr(module, "TASK_WORDS", rng.choice([1, 50, 10**6]))
        words = [f"w{i}" * rng.choice([1, 9]) for i in range(rng.choice([1, 2, 3, 30]))] + ["a", "\x01", "é"]
        pool = [[rng.choice(words) for _ in range(rng.randrange(3, 40))] for _ in range(5)]
        rows = []
        for d in range(rng.randrange(1, 25)):
            tokens = [w for _ in range(rng.randrange(4)) for w in (rng.choice(pool) if rng.random() < 0.7 else [rng.choice(words) for _ in range(rng.randrange(20))])]
            rows.append((d, rng.choice(["", " ", "\t"]) + rng.choice([" ", "\n\x0b "]).join(tokens)))
        window = rng.choice([6, 9, 20])
        n, got = local(rows, window, rng.choice([1, 2, 4]), rng.choice([2, 10**9]))
        longer += n
        assert got == brute(rows, window)
    assert longer


def test_common_words():
    texts = [b"", b"a b ", b"a b c ", b"a bc ", b"a bc ", b"x "]
    at = np.append(0, np.cumsum([len(t) for t in texts]))
    assert module.common_words(np.frombuffer(b"".join(texts), np.uint8), at).tolist() == [0, 2, 1, 2, 0]
