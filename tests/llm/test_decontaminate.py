import duckdb
import pytest

from cinderglass.llm import decontaminate as module
from cinderglass.llm.decontaminate import ORACLE, decontaminate, op8_decontaminate


def test_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = sorted(con.execute(ORACLE).fetchall())
    got = sorted(tuple(r) for r in op8_decontaminate(spark, d).collect())
    assert got == want and any(r[5] for r in got)


def test_spans_blocks_and_odd_rows(spark, monkeypatch):
    items = [(1, " ".join(f"Q{i}" for i in range(12))), (2, "tiny item"), (3, None), (None, "no id"), (10, "tiny item"), (4, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    body = "é x! " + " ".join(f"q{i}," for i in range(12)) + " TINY-item no id"
    docs = spark.createDataFrame([(1, body, "a"), (1, body, "b"), (2, None, "c"), (3, "tiny", "d"), (4, "", "e")], "doc_id long, text string, items string")
    small = decontaminate(docs, bench).orderBy("doc_id").collect()
    assert small[0].n_words == 18 and [tuple(s) for s in small[0].spans] == [(2, 18)] and small[0]["items"] == ["1", "10", "2"]
    a, b = small[0].offsets[0]
    assert body[a:b] == body[5:]
    assert [len(r.spans) for r in small] == [1, 1, 0, 0, 0]
    monkeypatch.setattr(module, "MOST_WORDS", 5)
    with pytest.raises(ValueError):
        decontaminate(docs, bench)
    monkeypatch.undo()
    assert decontaminate(docs.limit(0), bench).count() == 0
    assert decontaminate(docs, bench.limit(0)).where("size(spans) > 0").count() == 0


def test_blocks_of_a_text_change_nothing(monkeypatch):
    from random import Random

    rng = Random(2)
    words = [f"w{i}" for i in range(6)]
    matcher = module.Matcher([(str(k), " ".join(rng.choice(words) for _ in range(rng.randrange(1, 14)))) for k in range(30)], 10)
    for _ in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(200)))
        whole = matcher.scan(text)
        monkeypatch.setattr(module, "SCAN_BYTES", rng.randrange(1, 60))
        assert matcher.scan(text) == whole
        monkeypatch.undo()
