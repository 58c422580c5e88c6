"""Each stage on the table its predecessor kept, against brute force."""

import hashlib

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cinderglass.llm import stages
from cinderglass.llm.bpe import default_path
from cinderglass.llm.decontaminate import normal_words
from cinderglass.llm.shared import stash, table
from cinderglass.llm.toxicity import fit
from tests.llm import test_minhash_dedup, test_substring_dedup

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, D, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stash(stage(spark, docs, D), name)
        out.append((docs, made))
        docs = made
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_counts(steps):
    for before, after in steps[:-1]:
        assert after.columns == before.columns and 0 < after.count() <= before.count()


def test_toxic(spark, steps):
    large = "/root/testdata/sf0.01"
    before = table(spark, large, "documents")
    after = rows(stages.drop_toxic(spark, before, large))
    labels = table(spark, large, "labels").select("doc_id", "toxic")
    model = fit(before, labels)
    score = lambda text: model.probability(pa.RecordBatch.from_arrays([pa.array([text])], names=["text"]))[0]
    assert set(after) == {i for i, r in rows(before).items() if score(r.text) < 0.7}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    gone = set(rows(before)) - set(after)
    toxic, clean = ({i for i, t in truth.items() if t == y} for y in (1, 0))
    assert len(gone & toxic) >= 0.6 * len(toxic) and len(gone & clean) <= 0.02 * len(clean)
    assert steps[0][1].count()


def test_near_copies(steps):
    before, after = steps[1]
    want = test_minhash_dedup.brute([(r.doc_id, r.text) for r in before.collect()], 5)
    assert set(rows(after)) == {i for i, (_, _, kept) in want.items() if kept}


def test_repeats(steps):
    before, after = (rows(x) for x in steps[2])
    want = test_substring_dedup.brute([(i, r.text) for i, r in before.items()], 20)
    for i, (_, removed, digest) in want.items():
        assert after[i].text == before[i].text if not removed else hashlib.sha256(after[i].text.encode()).hexdigest() == digest


def test_contaminated(spark, steps):
    before, after = (rows(x) for x in steps[3])
    windows = set()
    for r in table(spark, D, "benchmark").collect():
        w = normal_words(r.text)
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    hit = lambda w: any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
    assert set(after) == {i for i, r in before.items() if not hit(normal_words(r.text))}


def test_tokens(steps):
    before, after = (rows(x) for x in steps[4])
    tok = Tokenizer.from_file(default_path())
    assert set(before) == set(after)
    for i, r in after.items():
        assert r.ids == tok.encode(before[i].text, add_special_tokens=False).ids
        assert r.decoded_sha256 == hashlib.sha256(before[i].text.encode()).hexdigest()
