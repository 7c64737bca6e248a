import numpy as np

from assayer.llm import embeddings as em
from assayer.llm import queries

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, n_links string"


def brute(vectors, least=0.95):
    """Links and components of {id: vector}, by all pairs."""
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    like = x @ x.T >= least
    comp = np.arange(len(ids))
    for _ in ids:
        comp = np.array([comp[row].min() for row in like])
    return {i: (int(like[k].sum()) - 1, ids[comp[k]]) for k, i in enumerate(ids)}


def clustered(n=900, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(60, dim))
    return {i: (middle[i % 60] + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.25, 1.0])).astype(np.float32) for i in range(n)}


def test_links_match_brute_force(spark):
    vectors = clustered()
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in vectors.items()], SCHEMA)
    want = brute(vectors)
    result = em.near_duplicates(df, shard_rows=150, clusters=12)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in result.collect()}
    total = sum(n for n, _ in want.values())
    assert total > 1000 and all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.97 * total
    assert np.mean([got[i][1] == want[i][1] for i in want]) > 0.97
    assert em.audit(df, result) >= 0.9


def test_query_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    result = queries.op5_pruned_graph(spark, SF)
    assert result.count() == df.count()
    assert em.audit(df, result) >= 0.9


def test_dense_and_sparse_tables_match_brute_force(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=24)
    dense = {i: (middle + rng.normal(size=24) * 0.17).astype(np.float32) for i in range(700)}  # most pairs link
    sparse = clustered(1200, 12, 9)
    for vectors, settings in ((dense, {}), (dense, {"shard_rows": 60, "clusters": 3}), (sparse, {"shard_rows": 40, "clusters": 4, "sample": 500})):
        df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in vectors.items()], SCHEMA)
        want = brute(vectors)
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in em.near_duplicates(df, **settings).collect()}
        total = sum(n for n, _ in want.values())
        assert total > 500 and all(got[i][0] <= want[i][0] for i in want)
        assert sum(n for n, _ in got.values()) >= 0.99 * total
        assert np.mean([got[i][1] == want[i][1] for i in want]) >= 0.99


def test_odd_rows(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(5, one), (3, one), (3, one), (4, [2.0, 0.0, 0.0]), (7, None), (8, []), (9, [0.0, 0.0, 0.0]), (10, [1.0, None, 0.0]), (11, [float("nan"), 1.0, 0.0]), (12, [float("inf"), 1.0, 0.0]), (13, [1.0, 0.0]), (None, [0.0, 1.0, 0.0]), (14, [0.0, 1e-30, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    got = sorted(((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in em.near_duplicates(df).collect()))
    assert got == [(False, 3, 3, 3, True)] * 2 + [(False, 4, 3, 3, False), (False, 5, 3, 3, False)] + [(False, i, 0, i, True) for i in (7, 8, 9, 10, 11, 12, 13)] + [(False, 14, 1, 14, True), (True, 0, 1, 14, False)]
    assert em.near_duplicates(df.limit(0)).count() == 0


def test_search_over_the_graph_is_a_graph_search():
    x = np.array(list(clustered(400).values()), float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    kept = em.pruned(x)
    assert max(map(len, kept)) <= em.DEGREE
    adjacent = np.full((len(x), em.DEGREE), -1)
    for i, k in enumerate(kept):
        adjacent[i, : len(k)] = k
    q, v = em.range_search(x, adjacent, em.medoids(x), x, 0.95)
    assert len(q) >= 0.9 * (x @ x.T >= 0.95).sum()
    cut = np.full_like(adjacent, -1)  # without edges only the medoids can be found
    assert set(em.range_search(x, cut, em.medoids(x), x, 0.95)[1].tolist()) <= set(em.medoids(x).tolist())
