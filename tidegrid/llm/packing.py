"""Best-fit packing by patterns and non-negative least squares (operator 5).

The plan is made on the histogram of piece lengths, which has `capacity` entries at most, whatever the corpus size:

1. Lengths are rounded up to `grid` steps, and all patterns of one to three steps that fill a sequence are listed.
2. Non-negative least squares fits repeat counts of the patterns to the (rounded) histogram, long lengths weighing more,
   since short ones find room later; counts are rounded down and kept within what there is.
3. A pattern's slots take actual lengths: the longest of each step, and last whatever fits the room best. That splits a
   pattern into runs of equal contents.
4. What is left goes, longest first, into the tightest room that holds it, in those runs or in new sequences. This too
   works on counts: a run that is filled in part is split in two.

A piece's place follows from its rank among the pieces of its length. Ranks come from counts by (length, slice of the id
hash) and a window inside one slice, so a length that a third of all pieces share is no one task's group. The plan,
bounded by the histogram, is broadcast.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import durable, table
from .tokens import encoder, load

CAPACITY, END_ID, GRID = 2048, 0, 16
PIECE = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by active sets on the normal equations."""
    gram, rhs = a.T @ a, a.T @ b
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(rhs).max(initial=0.0)))
    for _ in range(rounds):
        slope = rhs - gram @ x
        slope[free] = -np.inf
        j = int(slope.argmax()) if n else 0
        if not n or slope[j] <= tolerance:
            break
        free[j] = True
        while free.any():
            at = np.nonzero(free)[0]
            z = np.linalg.lstsq(gram[np.ix_(at, at)], rhs[at], rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            step = float((x[at][low] / np.maximum(x[at][low] - z[low], 1e-300)).min())
            x[at] += step * (z - x[at])
            drop = at[low & (x[at] <= 1e-12 * max(1.0, x.max()))]
            if not len(drop):
                drop = at[low][:1]
            x[drop] = 0
            free[drop] = False
    return x


def patterns(steps: int, used: np.ndarray) -> list[tuple[int, ...]]:
    """Multisets of at most three of the used step lengths, longest first, that add up to `steps`."""
    have = set(np.nonzero(used)[0].tolist()) - {0}
    out = [(steps,)] if steps in have else []
    for i in sorted(have, reverse=True):
        for j in sorted((j for j in have if j <= i), reverse=True):
            k = steps - i - j
            if k == 0:
                out.append((i, j))
            elif 0 < k <= j and k in have:
                out.append((i, j, k))
    return out


def _fit(counts: np.ndarray, capacity: int, grid: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern of step lengths, repeats) within the counts."""
    steps = capacity // grid
    left = np.zeros(steps + 1, np.int64)
    np.add.at(left, -(-np.arange(capacity + 1) // grid), counts)
    listed = patterns(steps, left > 0)
    if not listed:
        return []
    a = np.zeros((steps + 1, len(listed)))
    for j, p in enumerate(listed):
        for s in p:
            a[s, j] += 1
    weight = (np.arange(steps + 1) / steps)[:, None]
    x = nnls(a * weight, left * weight[:, 0])
    out = []
    for j in np.argsort(-x, kind="stable"):
        need = np.bincount(listed[j], minlength=steps + 1)
        r = min(int(x[j] + 1e-6), *(int(left[s] // need[s]) for s in set(listed[j])))
        if r > 0:
            left -= r * need
            out.append((listed[j], r))
    return out


def plan(counts: np.ndarray, capacity: int = CAPACITY, grid: int = GRID) -> list[tuple[tuple[int, ...], int]]:
    """counts[length] -> (lengths in a sequence, number of such sequences); every piece is in exactly one."""
    left = np.array(counts, np.int64).copy()
    groups: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        groups.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    fitted = [(p, r) for p, r in _fit(left, capacity, grid) if p] if capacity % grid == 0 else []
    for pattern, repeats in fitted:
        while repeats:
            content: list[int] = []
            for s in pattern[:-1]:  # the longest of its step that is still there
                content += [n for n in range(min(capacity, s * grid), (s - 1) * grid, -1) if left[n] > content.count(n)][:1]
            if len(content) < len(pattern) - 1:
                break
            space = capacity - sum(content)
            last = next((n for n in range(space, max(0, space - 2 * grid), -1) if left[n] > content.count(n)), None)
            if last is None:
                break
            content.append(last)
            run = min(repeats, *(int(left[n]) // content.count(n) for n in content))
            groups.append((tuple(content), run))
            for n in content:
                left[n] -= run
            repeats -= run
    return _best_fit(groups, left, capacity)


def _best_fit(groups: list[tuple[tuple[int, ...], int]], left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    room: dict[int, list] = defaultdict(list)
    spaces: list[int] = []  # those with a group, ascending

    def put(content: tuple[int, ...], repeats: int) -> None:
        space = capacity - sum(content)
        if not room[space]:
            insort(spaces, space)
        room[space].append((content, repeats))

    for content, repeats in groups:
        put(content, repeats)
    for n in range(len(left) - 1, 0, -1):
        while left[n]:
            at = bisect_left(spaces, n)
            if at == len(spaces):  # no room: new sequences
                per = capacity // n
                whole, rest = divmod(int(left[n]), per)
                left[n] = 0
                if whole:
                    put((n,) * per, whole)
                if rest:
                    put((n,) * rest, 1)
                continue
            space = spaces[at]
            content, repeats = room[space].pop()
            if not room[space]:
                del spaces[at]
            fill = min(repeats, int(left[n]))
            left[n] -= fill
            put((*content, n), fill)
            if repeats > fill:
                put(content, repeats - fill)
    return [g for space in sorted(room) for g in room[space]]


def places(groups: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length, first rank), and for each the sequence of that rank and the offset in it."""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for content, repeats in groups:
        at = 0
        for n in content:
            rows.append((n << 44 | rank[n], sequence, at))
            rank[n] += repeats
            at += n
        sequence += repeats
    rows.sort()
    k = np.array(rows, np.int64).reshape(-1, 3)
    return k[:, 0], k[:, 1], k[:, 2]


def _pieces_of(ids: np.ndarray, capacity: int) -> list[dict]:
    data = ids.astype("<u4")
    return [{"start": k, "length": len(part := data[k : k + capacity]), "ids_crc32": zlib.crc32(part.tobytes())} for k in range(0, len(data), capacity)]


def tokenized(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, **memory: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every text's ids and the end id, cut where they exceed capacity. memory:
    slice_bytes and remembered of tokens.Encoder, which change what a worker holds but no id."""
    spec = docs.sparkSession.sparkContext.broadcast(load(tokenizer))

    @arrow_udf(PIECE)
    def pieces(texts: pa.Array) -> pa.Array:
        ids, ends = encoder(spec.value, **memory).ids(texts)
        return pa.array([_pieces_of(np.r_[ids[i:j], END_ID], capacity) for i, j in zip(ends, ends[1:], strict=False)], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])))

    cut = docs.select("doc_id", F.posexplode(pieces.asNondeterministic()("text")).alias("piece", "x"))
    return cut.select("doc_id", "piece", "x.start", "x.length", "x.ids_crc32")


def pack(pieces: DataFrame, capacity: int = CAPACITY, grid: int = GRID, rank_rows: int = 500_000) -> DataFrame:
    """pieces(doc_id, piece, start, length, ...) -> + sequence_id, offset: gapless sequences of at most capacity.

    pieces must be cheap to read again (a table). Equal rows are different pieces; a null doc_id is one like any other.
    No pieces: no sequences."""
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # capacity rows at most
        counts[n] = c
    keys, sequences, offsets = places(plan(counts, capacity, grid))
    sent = pieces.sparkSession.sparkContext.broadcast((keys, sequences, offsets))
    slices = max(16, int(counts.max() // rank_rows) + 1)
    p = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices)))
    before = W.partitionBy("length").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    base = p.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = W.partitionBy("length", "slice").orderBy("doc_id", "piece", "start")
    ranked = p.withColumn("own", F.row_number().over(inside)).join(base, ["length", "slice"]).withColumn("rank", F.col("base") + F.col("own") - 1)

    @arrow_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        keys, sequences, offsets = sent.value
        x = (lengths.to_numpy().astype(np.int64) << 44) | ranks.to_numpy().astype(np.int64)
        at = np.searchsorted(keys, x, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(sequences[at] + (x - keys[at])), pa.array(offsets[at])], ["sequence_id", "offset"])

    return ranked.select(*pieces.columns, place.asNondeterministic()("length", "rank").alias("at")).select(*pieces.columns, "at.sequence_id", "at.offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, **memory: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece. Null and empty texts are the end
    id alone. Other columns are ignored; an empty table packs into nothing. memory as in tokenized()."""
    return pack(durable(tokenized(docs.select("doc_id", "text"), tokenizer, capacity, **memory), "packing-pieces"), capacity)


def op5_packing(spark, sf_dir):
    """Contract query: every document in sequences of at most 2048 ids."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
