"""Forest search against brute force: exact when all are candidates, recall otherwise, and edge cases."""

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm.prefix_forest import Forest, ForestParams, search

SF = "/root/testdata/sf0.01"


def brute(ids, x, queries, k=20):
    out = {}
    for q in queries:
        rows = {}
        for i, s in zip(ids.tolist(), (x @ x[np.flatnonzero(ids == q)[0]]).tolist()):
            if i != q:
                rows[i] = max(s, rows.get(i, -np.inf))
        out[q] = sorted(rows.items(), key=lambda r: (-r[1], r[0]))[:k]
    return out


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_on_given_vectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    got, want = collected(search(df, F.col("vec_id") % 20 == 0)), brute(ids, x, [i for i in ids.tolist() if i % 20 == 0])
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9
    for q in got:
        assert all(abs(s - float(x[ids == i][0] @ x[ids == q][0])) < 1e-12 for i, s in got[q])


def test_clustered_vectors_need_few_candidates():
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(200, 1, 32)) + 0.1 * rng.normal(size=(200, 30, 32))).reshape(-1, 32)
    ids = np.arange(len(x))
    forest = Forest(ids, x, float(np.linalg.norm(x, axis=1).max()), ForestParams(share=0.02, least=1))
    found = list(forest.candidates(x[:300]))
    assert np.mean([len(f) for f in found]) < 0.2 * len(x)
    assert np.mean([np.isin(np.argsort(-(x @ x[i]))[:20], forest.ids[forest.begin[:-1]][f]).mean() for i, f in enumerate(found)]) > 0.9


def test_exact_with_ties_copies_and_norms(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=6) * rng.uniform(0.1, 4)).tolist()) for i in range(90)]
    rows += [(100 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(130)] + [(40, rows[40][1])] * 3
    bad = [(300, None), (320, [0.0] * 6), (340, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (360, [float("nan")] * 6), (380, [float("inf")] + [0.0] * 5), (400, [1.0, 2.0]), (None, [1.0] * 6), (420, [])]
    df = spark.createDataFrame([(*r, 3) for r in rows + bad], "vec_id long, embedding array<double>, rank int").repartition(3)
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    got = collected(search(df, F.col("vec_id") % 20 == 0, ForestParams(share=100.0, shard_rows=50)))
    want = brute(ids, x, sorted({i for i in ids.tolist() if i % 20 == 0}))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_equal_vectors_rank_by_id_across_shards(spark):
    rng = np.random.default_rng(5)
    kinds = rng.normal(size=(12, 64))
    x = kinds[rng.integers(0, 12, 700)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = collected(search(df, F.col("vec_id") % 20 == 0, ForestParams(share=100.0, shard_rows=60, k=100)))
    assert len(got) == 35
    for found in got.values():
        assert found == sorted(found, key=lambda r: (-r[1], r[0]))
        by_vector = {}
        for i, score in found:
            by_vector.setdefault(x[i].tobytes(), set()).add(score)
        assert all(len(scores) == 1 for scores in by_vector.values())


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert {tuple(r) for r in search(df, F.col("vec_id") % 20 == 0).collect()} == {(0, 1, 20, 0.0), (20, 1, 0, 0.0)}
    assert search(df.limit(1), F.col("vec_id") % 20 == 0).count() == 0
    assert search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
