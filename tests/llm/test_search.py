import numpy as np
import pytest

from tests.oracle import same
from tidegrid.llm import hamming_search as hs


def test_sql(spark):
    same(spark, hs.op7_hamming_search, hs.OP7_SQL)


@pytest.mark.parametrize("n,nq,share,need", [(300, 40, 0.5, 7), (2000, 30, 0.1, 11), (5, 3, 0.5, 7), (1, 1, 0.5, 1), (800, 30, 0.02, 3)])
def test_kernel(n, nq, share, need):
    rng = np.random.default_rng(n)
    codes = np.unique(np.packbits(rng.random((n, 64)) < share, axis=1).view(np.uint64).ravel())
    weights = rng.integers(1, 4, len(codes))
    queries = codes[rng.integers(0, len(codes), nq)] ^ np.uint64(9)
    q, c, d = hs.search_block(queries, codes, weights, np.full(nq, need), chunk=700)
    every = np.bitwise_count(queries[:, None] ^ codes).astype(int)
    for i in range(nq):
        by = np.sort(np.repeat(every[i], weights))
        limit = by[need - 1] if len(by) >= need else 64
        assert sorted(c[q == i]) == np.nonzero(every[i] <= limit)[0].tolist()
        assert (every[i][c[q == i]] == d[q == i]).all()


def brute(rows, queries, k):
    rows = {(i, c) for i, c in rows if i is not None and c is not None}
    out = []
    for i, c in {(i, c) for i, c in queries if i is not None and c is not None}:
        found = sorted(((c ^ d) & (1 << 64) - 1).bit_count() * 10**6 + j for j, d in rows if j != i)[:k]
        out += [(i, c, r + 1, v % 10**6, v // 10**6) for r, v in enumerate(found)]
    return sorted(out)


def test_copies_ties_nulls(spark):
    rng = np.random.default_rng(4)
    few = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 6)]
    rows = [(i, few[0] if i % 3 else few[i % 6] ^ 1 << i % 7) for i in range(400)] + [(None, 5), (900, None), (7, few[0]), (7, few[0])]
    d = spark.createDataFrame(rows, "id long, code long")
    for k, block in ((1, 50), (10, 1000), (500, 64)):
        got = hs.top_k(d.filter("id % 20 = 0"), d, k, row_block=block, query_block=5, least_blocks=1)
        assert sorted(map(tuple, got.collect())) == brute(rows, [r for r in rows if r[0] is not None and r[0] % 20 == 0], k)
    assert hs.top_k(d.limit(0), d).count() == 0 and hs.top_k(d, d.limit(0)).count() == 0


def test_sign_code(spark):
    d = spark.createDataFrame([([1.0] * 64,), ([-1.0, 2.0, 0.0],), ([],), (None,), ([float("nan")] + [0.0] * 62 + [3.0],)], "v array<float>")
    assert [r[0] for r in d.select(hs.sign_code("v")).collect()] == [-1, 2, 0, None, -(1 << 63) + 1]


def test_long_vectors_are_an_error(spark):
    d = spark.createDataFrame([([1.0] * 65,)], "v array<float>")
    with pytest.raises(Exception, match="more than 64 components"):
        d.select(hs.sign_code("v")).collect()


def test_other_columns(spark):
    d = spark.createDataFrame([(i, i % 7, "x", 1, 2, 3) for i in range(50)], "id long, code long, rank string, rb int, qb int, distance int")
    assert hs.top_k(d, d, 3).columns == ["query_id", "query_code", "rank", "neighbor_id", "distance"] and hs.top_k(d, d, 3).count() == 150
