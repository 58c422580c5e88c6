import random
import re
import zlib

import numpy as np
import pyarrow as pa

from cinderglass.llm import words as W
from cinderglass.llm.boosting import Boosted, Isotonic
from cinderglass.llm.toxicity import SECOND_PERSON, Lexicon, features, fit, op3_toxicity, toxicity

D = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = op3_toxicity(spark, d).collect()
    assert len(rows) == 10000 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [(labels[r.doc_id], r.predicted, r.score) for r in rows if r.held_out and r.doc_id in labels]
    hit = sum(1 for y, p, _ in held if y and p)
    wrong = sum(1 for y, p, _ in held if p and not y)
    toxic = sum(y for y, _, _ in held)
    print("held out", len(held), "toxic", toxic, "found", hit, "wrong", wrong, "missed", sorted(round(s, 2) for y, p, s in held if y and not p))
    assert hit >= 0.85 * toxic and wrong <= 0.1 * max(1, hit)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 0.5), (None, "", 0.1), (2, "you idiot", 0.2), (2, "fine", 0.2)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [0 <= r.score <= 1 for r in toxicity(df, none).collect()] == [True] * 4
    labels = spark.createDataFrame([(2, 1), (2, 0), (None, 1), (1, None)], "doc_id long, toxic int")
    assert toxicity(df, labels).count() == 4 and toxicity(df.limit(0), labels).count() == 0


def test_isotonic_and_trees():
    iso = Isotonic().fit(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(iso.value(np.linspace(0, 5, 50))) >= 0).all()
    x = np.random.default_rng(0).random((500, 3))
    y = (x[:, 1] > 0.5).astype(float)
    assert ((Boosted().fit(x, y).score(x) > 0) == (y > 0)).mean() > 0.98


def brute_features(text, lexicon):
    """``features`` of one text word by word; ``lexicon`` has whole words only."""
    raw = text.encode()
    words = re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", raw)
    low = [w.lower() for w in words]
    weight = [lexicon.get(w, 0.0) for w in low]
    plain = raw.lower().translate(bytes.maketrans(b"013457@$", b"oieastas"))
    hidden = sum(lexicon.get(w, 0.0) > 2.5 for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", plain))
    you = [w.decode() in SECOND_PERSON for w in low]
    strong = [w > 2.5 for w in weight]
    n, size, more = max(1, len(words)), max(1, len(raw)), hidden - sum(strong)
    share = lambda marks: sum(map(marks.__contains__, raw)) / size
    ascii_marks = [c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c == 32 or 9 <= c <= 13)]
    digits = [sum(48 <= c <= 57 for c in w) for w in words]
    return [
        sum(strong) / n, np.log1p(sum(strong)), sum(w > 0.5 for w in weight) / n, sum(w for w in weight if w > 0.5) / n, max([w for w in weight if w > 0.5], default=0),
        sum(s and any(you[max(0, i - 5) : i + 6]) for i, s in enumerate(strong)) / n, sum(you) / n, share(range(65, 91)), sum(len(w) > 2 and w.isalpha() and w.isupper() and w.isascii() for w in words) / n,
        share(ascii_marks), share(b"!"), share(b"?"), sum(0 < d < len(w) for d, w in zip(digits, words)) / n,
        max(more, 0) / n, min(max(more, 0), 3), sum(len(w) == 1 for w in words) / n, np.log1p(len(words)),
    ]


def test_features_equal_brute_force():
    rng = random.Random(3)
    lexicon = {b"idiot": 4.0, b"dumb": 3.0, b"bad": 1.0, b"meh": 0.4, "sötte".encode(): 3.5}
    pool = ["idiot", "IDIOT", "1d10t", "dumb!", "bad", "meh", "you", "Your", "tú", "sötte", "a", "B2b", "??", "WORD", "x", "\n", "é", "7", "d@mb", "_", "you're"]
    texts = [""] + [rng.choice([" ", ", ", ""]).join(rng.choice(pool) for _ in range(rng.randrange(30))) for _ in range(300)]
    keys = W.split(pa.array([b" ".join(lexicon).decode()]), W.SPACE).hashes()
    order = np.argsort(keys)
    known = Lexicon(keys[order], np.array(list(lexicon.values()))[order])
    got = features(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]), [known])
    assert np.allclose(got, [brute_features(t, lexicon) for t in texts])


def test_scores_do_not_depend_on_how_rows_are_dealt(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{D}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs, labels)
    want = {r.doc_id: float(model.probability(pa.RecordBatch.from_arrays([pa.array([r.text])], names=["text"]))[0]) for r in docs.collect()}
    for r in toxicity(docs.repartition(5), labels).collect():
        assert abs(r.score - want[r.doc_id]) < 1e-9 and r.predicted == (r.score >= 0.7)
