import random

import duckdb
import pytest

from cinderglass.llm.minhash_dedup import ORACLE, near_duplicates, op2_minhash_near_dedup


def brute(rows, k):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    rows, n = [(9000, None), (9001, ""), (9002, "one Two"), (9003, "ONE two"), (9004, "one two three four"), (9005, "One two three four")], 0
    passage = [f"p{i}" for i in range(60)]
    for _ in range(60):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(5, 120))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.choice([1, 1, 2, 5, 9])):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(t) // 25)):
                t[rng.randrange(len(t))] = f"e{rng.randrange(9999)}"
            rows.append((n := n + 1, " ".join(t)))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()}
    assert got == brute(rows, 4)


def test_whole_table_equals_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    want = sorted(con.execute(ORACLE).fetchall())
    assert sorted(tuple(r) for r in op2_minhash_near_dedup(spark, d).collect()) == want


def test_odd_rows(spark):
    t = "a b c d e f g h"
    df = spark.createDataFrame([(3, t, 1), (3, t + " i", 2), (None, t, 3), (5, t, 4), (6, None, 5)], "doc_id long, text string, component_id int")
    got = sorted(map(str, near_duplicates(df, k=4).collect()))
    assert len(got) == 5
    assert {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(df, k=4).collect()} == {(3, 3, True), (None, None, False), (5, 3, False), (6, 6, True)}
    assert near_duplicates(df.limit(0)).count() == 0


def test_links_behind_a_shared_core(spark):
    core, rows = [f"c{i}" for i in range(85)], []
    for i in range(400):
        own = [f"x{i}_{j}" for j in range(15)]
        rows.append((i, " ".join(core + own)))
    own[5] = own[10] = "y"
    rows.append((3000, " ".join(core + own)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).where("component_id <> doc_id").collect()
    assert [(r.doc_id, r.component_id) for r in got] == [(3000, 399)]
