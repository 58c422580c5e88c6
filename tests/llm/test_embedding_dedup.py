import random

import duckdb
import numpy as np

from cinderglass.llm import embedding_dedup as module
from cinderglass.llm.embedding_dedup import ORACLE, embedding_near_dedup, op6_embedding_near_dedup


def brute(rows):
    good = [(i, np.array(v, float), lab) for i, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, _, _ in rows}
    for n, (a, va, la) in enumerate(good):
        for b, vb, lb in good[n + 1 :]:
            if la == lb and len(va) == len(vb) and va @ vb / np.sqrt((va @ va) * (vb @ vb)) >= 0.93:
                links[a].add(b)
                links[b].add(a)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


def test_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{d}/embeddings.parquet'")
    assert sorted(tuple(r) for r in op6_embedding_near_dedup(spark, d).collect()) == sorted(con.execute(ORACLE).fetchall())


def test_cells_blocks_and_recall(spark, monkeypatch):
    monkeypatch.setattr(module, "CELL", 40)
    monkeypatch.setattr(module, "BLOCK", 32)
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(150):
        base = rng.normal(size=64)
        for _ in range(rng.choice([1, 1, 2, 4])):
            rows.append((len(rows), (base + rng.normal(size=64) * rng.choice([0, 0.1, 0.25, 0.38])).astype(np.float32).tolist(), int(rng.integers(2))))
    hot = rng.normal(size=64).astype(np.float32).tolist()
    rows += [(len(rows) + k, hot, 0) for k in range(90)]
    rows += [(900, None, 0), (901, [0.0] * 64, 0), (902, hot, None), (903, [float("nan")] * 64, 0), (904, [None, *hot[1:]], 0), (905, hot[:3], 0)]
    random.Random(1).shuffle(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    want = brute(rows)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values())
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)


def test_recall_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(module, "LARGE", 100)
    rng = np.random.default_rng(7)
    centre = rng.normal(size=48)
    rows = []
    for _ in range(1300):
        base = centre + rng.normal(size=48) * 1.5
        for _ in range(rng.choice([1, 1, 3])):
            rows.append((len(rows), (base + rng.normal(size=48) * rng.choice([0, 0.2, 0.45])).tolist(), 7, "x"))
    got = {r.vec_id: r.n_links for r in embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, cell string")).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    want = (x @ x.T >= 0.93).sum(axis=1) - 1
    assert want.sum() > 500 and sum(got.values()) >= 0.99 * want.sum() and all(got[i] <= n for i, n in enumerate(want))


def test_odd_rows(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (None, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, embedding_near_dedup(df).collect()), key=str) == [(2, 1, 2, True), (3, 1, 2, False), (3, 1, 2, False), (None, 0, None, False)]
    assert embedding_near_dedup(df.limit(0)).count() == 0
