"""Exact top-k search over binary codes by incremental multi-index hashing (operator 7).

A code has 64 bits in 8 byte segments. Rows and queries are dealt into blocks by hash; each pair of a row block and a
query block is one bounded group. There an index of every segment lists the codes by byte; a query probes the segments
one after the other with all bytes at radius 0, then 1, and so on. After radius r in segments 0..s every code within
distance 8 r + s has been seen, so a query is finished as soon as its k-th verified distance is at most that. The blocks'
lists of k are merged by a ranking with a map-side limit.

Equal codes are one index entry with their k + 1 least ids (no query can need more), so a vector that a third of the rows
share costs one verification and no answer is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

SEGMENTS = 8
FOUND = "query_id long, query_code long, neighbor_id long, distance int"


def sign_code(vector: str) -> Column:
    """64 bits: bit i is set if component i is above zero; null for a null vector, 0 for an empty one. A vector of more than
    64 components is an error: its code would say nothing of the rest."""
    bits = f"aggregate(transform({vector}, (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)"
    return F.expr(f"if(size({vector}) > 64, raise_error('a vector of more than 64 components has no code'), {bits})")


def search_block(queries: np.ndarray, codes: np.ndarray, weights: np.ndarray, need: np.ndarray, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, code index, distance) of all codes that can be among a query's nearest need[q] rows, where code j
    stands for weights[j] rows. queries and codes are uint64; codes are distinct."""
    n = len(queries)
    q_bytes, c_bytes = (x.view(np.uint8).reshape(-1, SEGMENTS) for x in (np.ascontiguousarray(queries), np.ascontiguousarray(codes)))
    order = [np.argsort(c_bytes[:, s], kind="stable").astype(np.int32) for s in range(SEGMENTS)]
    starts = [np.searchsorted(c_bytes[order[s], s], np.arange(257)) for s in range(SEGMENTS)]
    ones = np.bitwise_count(np.arange(256, dtype=np.uint8))
    seen = np.zeros((n, 65), np.int64)
    active, kept = np.arange(n), [np.empty((3, 0), np.int64)]
    tag, everything = np.arange(SEGMENTS, dtype=np.uint8), weights.sum()
    for radius in range(SEGMENTS + 1):
        masks = np.nonzero(ones == radius)[0]
        for s in range(SEGMENTS):
            if not len(active):
                break
            keys = q_bytes[active, s].astype(np.int64)[:, None] ^ masks
            sizes = starts[s][keys + 1] - starts[s][keys]
            upto = np.cumsum(sizes.sum(axis=1))
            cut = 0
            while cut < len(active):  # so many queries at once that their candidates stay bounded
                base = upto[cut - 1] if cut else 0
                end = max(cut + 1, int(np.searchsorted(upto, base + chunk, side="right")))
                size = sizes[cut:end].ravel()
                total = int(size.sum())
                if total:
                    first = np.repeat(starts[s][keys[cut:end]].ravel() - (np.cumsum(size) - size), size)
                    c = order[s][first + np.arange(total)]
                    q = np.repeat(active[cut:end], sizes[cut:end].sum(axis=1))
                    bits = np.bitwise_count((queries[q] ^ codes[c]).view(np.uint8)).reshape(-1, SEGMENTS)
                    new = (bits * np.uint8(SEGMENTS) + tag).min(axis=1) == radius * SEGMENTS + s  # not met in an earlier probe
                    q, c, d = q[new], c[new].astype(np.int64), bits[new].sum(axis=1, dtype=np.int64)
                    np.add.at(seen, (q, d), weights[c])
                    kept.append(np.stack([q, c, d]))
                cut = end
            counts = np.cumsum(seen, axis=1)
            enough = counts >= need[:, None]
            limit = np.where(enough[:, -1], enough.argmax(axis=1), 64)
            found = np.concatenate(kept, axis=1)
            kept = [found[:, found[2] <= limit[found[0]]]]
            active = active[(limit[active] > radius * SEGMENTS + s) & (counts[active, -1] < everything)]
    found = np.concatenate(kept, axis=1)
    return found[0], found[1], found[2]


def _answer(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "query_code": pa.array([], pa.int64()), "neighbor_id": pa.array([], pa.int64()), "distance": pa.array([], pa.int32())})
        rows = np.unique(np.stack([right["code"].to_numpy(), right["id"].to_numpy()], axis=1), axis=0)  # by code, then id
        asked = np.unique(np.stack([left["id"].to_numpy(), left["code"].to_numpy()], axis=1), axis=0)
        first = np.r_[True, rows[1:, 0] != rows[:-1, 0]]
        place = np.arange(len(rows)) - np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
        rows = rows[place <= k]
        first = np.r_[True, rows[1:, 0] != rows[:-1, 0]]
        begins = np.nonzero(first)[0]
        weights = np.diff(np.r_[begins, len(rows)])
        q, c, d = search_block(np.ascontiguousarray(asked[:, 1]).view(np.uint64), np.ascontiguousarray(rows[begins, 0]).view(np.uint64), weights, np.full(len(asked), k + 1))
        at = np.repeat(begins[c] - (np.cumsum(weights[c]) - weights[c]), weights[c]) + np.arange(weights[c].sum())
        q, d = np.repeat(q, weights[c]), np.repeat(d, weights[c])
        ids = rows[at, 1]
        other = ids != asked[q, 0]
        q, d, ids = q[other], d[other], ids[other]
        by = np.lexsort((ids, d, q))
        q, d, ids = q[by], d[by], ids[by]
        lead = np.r_[True, q[1:] != q[:-1]] if len(q) else np.empty(0, bool)
        rank = np.arange(len(q)) - np.maximum.accumulate(np.where(lead, np.arange(len(q)), 0)) if len(q) else q
        top = rank < k
        q, d, ids = q[top], d[top], ids[top]
        return pa.table({"query_id": asked[q, 0], "query_code": asked[q, 1], "neighbor_id": ids, "distance": d.astype(np.int32)})

    return run


def top_k(queries: DataFrame, rows: DataFrame, k: int = 10, row_block: int = 65_536, query_block: int = 8_192, least_blocks: int = 6) -> DataFrame:
    """queries(id, code) against rows(id, code): query_id, query_code, rank (from 1), neighbor_id, distance.

    Exact: the k least (distance, id) among rows with another id; fewer where there are fewer. Rows with a null id or
    code are left out on either side; equal (id, code) rows count once; ties go to the smaller id. No rows: no output.
    Columns other than id and code are not read, whatever their names."""
    known = F.col("id").isNotNull() & F.col("code").isNotNull()
    rows, queries = rows.select("id", "code").filter(known), queries.select("id", "code").filter(known)
    d = max(least_blocks, -(-rows.count() // row_block))
    q = max(1, -(-queries.count() // query_block))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = queries.withColumn("qb", deal(q)).withColumn("rb", each(d))
    right = rows.withColumn("rb", deal(d)).withColumn("qb", each(q))
    # few bytes but much work a group: a number of its own keeps adaptive execution from merging the partitions
    left, right = (x.repartition(2 * d * q, "qb", "rb") for x in (left, right))
    found = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(_answer(k), FOUND)
    best = W.partitionBy("query_id", "query_code").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "query_code", "rank", "neighbor_id", "distance")


def op7_hamming_search(spark, sf_dir):
    """Every vector with an id divisible by 20 against all vectors: its 10 nearest sign codes."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code("embedding").alias("code"))
    return top_k(rows.filter("id % 20 = 0"), rows).drop("query_code")


OP7_SQL = """
WITH codes AS (
  SELECT vec_id, list_sum([CASE WHEN embedding[i] > 0 THEN 1::HUGEINT << (i - 1)::INTEGER ELSE 0::HUGEINT END FOR i IN range(1, 65)])::HUGEINT AS code FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id, bit_count(xor(q.code, r.code))::INTEGER AS distance FROM codes q JOIN codes r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id
)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, neighbor_id, distance FROM pairs WINDOW w AS (PARTITION BY query_id ORDER BY distance, neighbor_id) QUALIFY row_number() OVER w <= 10
"""
