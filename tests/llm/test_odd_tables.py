"""Every operator on text and every stage: clashing and odd columns, nulls, repeated rows, empty tables, a very long text."""

import hashlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cinderglass.llm import stages
from cinderglass.llm.bpe import bpe_round_trip, default_path
from cinderglass.llm.decontaminate import decontaminate
from cinderglass.llm.license_scan import license_scan
from cinderglass.llm.minhash_dedup import near_duplicates
from cinderglass.llm.substring_dedup import substring_dedup
from cinderglass.llm.token_store import read_tokens, write_tokens
from cinderglass.llm.toxicity import toxicity

D = "/root/testdata/sf0.001"
NAMES = ["_text", "_html", "_host", "_path", "_key", "_before", "row", "spans", "kid", "kh", "others", "score", "predicted", "held_out", "n_words", "n_removed", "kept_text", "items", "offsets", "ids", "n_tokens", "decoded", "component", "cls", "text_hash", "licenses", "sentence_ids", "n_chars", "a.b"]


@pytest.fixture(scope="module")
def docs(spark):
    body = " ".join(f"word{i}" for i in range(60))
    rows = [(1, body), (1, body), (2, body), (None, body), (3, None), (4, ""), (5, " \n\t "), (6, "short text"), (6, "another text"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, name in enumerate(NAMES):
        df = df.withColumn(name, F.struct(F.lit(k).alias("odd name"), F.lit("x").alias("a`b" if k % 2 else "a.b")) if name != "n_chars" else F.coalesce(F.length("text"), F.lit(0)))
    return df


def labels(spark):
    return spark.read.parquet(f"{D}/labels.parquet").select("doc_id", "toxic")


OPERATORS = {
    "toxicity": lambda spark, df: toxicity(df, labels(spark)),
    "bpe": lambda spark, df: bpe_round_trip(df),
    "decontaminate": lambda spark, df: decontaminate(df, spark.read.parquet(f"{D}/benchmark.parquet")),
    "substring": lambda spark, df: substring_dedup(df),
    "license": lambda spark, df: license_scan(df),
}
ADDED = {"toxicity": {"score", "predicted", "held_out"}, "bpe": {"n_tokens", "ids", "decoded"}, "decontaminate": {"n_words", "spans", "items", "offsets"}, "substring": {"n_words", "n_removed", "kept_text"}, "license": {"licenses", "sentence_ids"}}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_operators_keep_all_other_columns(spark, docs, name):
    out = OPERATORS[name](spark, docs)
    rest = [c for c in docs.columns if c not in ADDED[name]]
    key = lambda r: str([r[c] for c in rest])
    assert set(out.columns) == set(docs.columns) | ADDED[name]
    assert sorted(map(key, out.collect())) == sorted(map(key, docs.collect()))
    assert OPERATORS[name](spark, docs.limit(0)).count() == 0


def test_near_duplicates_and_store(spark, docs):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 56, 1, True)] * 2 + [(2, 56, 1, False), (None, 56, None, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (6, 1, 6, True), (None, 0, None, False)], key=str)
    assert near_duplicates(docs.limit(0)).count() == 0
    assert read_tokens(write_tokens(docs)).count() == docs.count()


STAGES = [stages.drop_toxic, stages.drop_near_copies, stages.cut_repeats, stages.drop_contaminated]


@pytest.mark.parametrize("stage", STAGES, ids=[s.__name__ for s in STAGES])
def test_stages_return_their_columns(spark, docs, stage):
    out = stage(spark, docs, D)
    assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    rows = out.collect()
    assert all(str([r[c] for c in others]) == str([docs.first()[c] for c in others]) for r in rows)
    texts = sorted(((r.doc_id, r.text, r.n_chars) for r in rows), key=str)
    before = sorted(((r.doc_id, r.text, r.n_chars) for r in docs.collect()), key=str)
    if stage is stages.drop_near_copies:
        assert texts == [t for t in before if t[0] != 2]
    elif stage is stages.cut_repeats:
        assert texts == sorted([(i, "", 0) if i in (2, None) and n > 100 else (i, t, n) for i, t, n in before], key=str)
    else:
        assert texts == before
    assert stage(spark, docs.limit(0), D).count() == 0


def test_stage_of_plain_columns(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [tuple(r) for s in STAGES for r in s(spark, df, D).collect()] == [(1, "a b c")] * 4


def test_very_long_text(spark):
    part = " ".join(f"w{i % 997}x{i % 89}" for i in range(100_000))
    text = part + " " + "z" * 3_000_000 + "\n" + part + "\nReleased under the MIT License."
    words = text.split()
    df = spark.createDataFrame([(1, text), (2, "other words here")], "doc_id long, text string")
    ids = Tokenizer.from_file(default_path()).encode(text, add_special_tokens=False).ids
    one = bpe_round_trip(df, digests=True).where("doc_id = 1").first()
    assert (one.n_tokens, one.decoded_sha256) == (len(ids), hashlib.sha256(text.encode()).hexdigest())
    assert one.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    cut = substring_dedup(df).where("doc_id = 1").first()
    seen, gone = set(), [False] * len(words)
    for i in range(len(words) - 19):
        key = tuple(words[i : i + 20])
        if key in seen:
            gone[i : i + 20] = [True] * 20
        seen.add(key)
    assert (cut.n_words, cut.n_removed) == (len(words), sum(gone)) and cut.kept_text == " ".join(w for w, g in zip(words, gone) if not g)
    bench = spark.createDataFrame([(7, " ".join(words[-30:-5]))], "item_id long, text string")
    hit = decontaminate(df, bench).where("doc_id = 1").first()
    assert hit.n_words == len(words) and hit["items"] == ["7"] and [text[a:b].split()[0] for a, b in hit.offsets] == [words[s] for s, _ in hit.spans]
    low = text.lower().split()
    assert near_duplicates(df).where("doc_id = 1").first().n_shingles == len({tuple(low[i : i + 5]) for i in range(len(low) - 4)})
    assert license_scan(df).where("doc_id = 1").first().licenses == ["MIT"]
    assert 0 <= toxicity(df, labels(spark)).where("doc_id = 1").first().score <= 1
