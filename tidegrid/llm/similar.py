"""Texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Candidates by MinHash: 24 bands of 5 minima, so a pair at 0.8 shares a band with probability 1 - (1 - 0.8^5)^24 = 0.9999
and a closer one more surely. Every candidate is then judged by its exact similarity (shingles as 64-bit hashes).

Bands whose members are one group already are left out. Lists up to `list_bound` are paired, after the longer ones, which leave
few pairs of different groups. A longer list is a family of
near copies or of texts that share a frame, and its pairs would grow with the square of its members. What is wanted of it
are groups, so links inside a group needn't be found. Shingles that only one text of all long lists has can't be shared: they
bound a text's overlap with any other, pairs whose bound is too low are left out, and texts without a possible partner in
a list leave it. The rest is worked in rounds. First the members meet the list's `leaders`: those that are in the most long
lists, which stand in the middle of the family. Then members outside the list's largest group lead: all of them where there
are `list_bound` or fewer, else four times as many as in the round before. A member that has led met all others and is settled.
A list is done when its largest group holds all members that aren't settled: of any two members one was judged against the
other, or both are in one group. So no candidate is lost, whatever the bounds. Work is linear in a family that has a middle;
it can grow with the square only among members that stand apart from each other though nearly all their shingles are shared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import components, durable, give_back

SHINGLE_WORDS, BANDS, ROWS = 5, 24, 5
_random = np.random.default_rng(5)
_FACTORS, _SHIFTS = (_random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles_of(text: bytes) -> np.ndarray:
    """Distinct hashes of the shingles of one UTF-8 text: A-Z lower-cased, words between ASCII spaces; with fewer than 5
    words the whole sequence is the one shingle."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    n, k = len(words), min(len(words), SHINGLE_WORDS)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh64_intdigest, words), np.uint64, n)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out = _mixed(out * _STEP + h[j : n - k + 1 + j])
    return np.unique(out)


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """One hash a band (its number included); none without a word."""
    if not len(shingles):
        return shingles
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for k in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[k : k + 2048, None] * _FACTORS + _SHIFTS).min(axis=0))
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = _mixed(out * _STEP + column)
    return out


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


@arrow_udf(T.StructType([T.StructField("n", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType()))]))
def sketch(texts: pa.Array) -> pa.Array:
    sizes, bands = [], []
    for t in texts.cast(pa.binary()):
        s = shingles_of(t.as_py() or b"")
        sizes.append(len(s))
        bands.append(bands_of(s))
    give_back()
    return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), _lists(bands)], ["n", "bands"])


@arrow_udf(T.ArrayType(T.LongType()))
def shingles(texts: pa.Array) -> pa.Array:
    out = _lists([shingles_of(t.as_py() or b"") for t in texts.cast(pa.binary())])
    give_back()
    return out


sketch, shingles = sketch.asNondeterministic(), shingles.asNondeterministic()  # once a row


def _sets(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """h, s: the shingles of the texts(h, text) whose h is asked for."""
    asked = durable(asked.distinct(), "similar-asked")  # its size is known before texts move: they stay while it can be broadcast
    known = texts.join(asked, "h", "left_semi").groupBy("h").agg(F.first("text").alias("text"))
    return durable(known.select("h", shingles("text").alias("s")), "similar-sets")


def _judged(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v), the groups of those of pairs(hu, ru, hv, rv) that are similar. sets: h, s."""
    pairs = durable(pairs.distinct(), "similar-pairs")
    a, b = sets.select(F.col("h").alias("hu"), F.col("s").alias("a")), sets.select(F.col("h").alias("hv"), F.col("s").alias("b"))
    both = pairs.join(a, "hu").join(b, "hv").select("ru", "rv", F.size(F.array_intersect("a", "b")).alias("i"), (F.size("a") + F.size("b")).alias("all"))
    return durable(both.filter(5 * F.col("i") >= 4 * (F.col("all") - F.col("i"))).select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct(), "similar-found")


def _common(long: DataFrame, sets: DataFrame) -> DataFrame:
    """h, often (long lists that it is in), alone (its shingles that no other text of a long list has)."""
    often = durable(long.groupBy("h").agg(F.count(F.lit(1)).alias("often")), "similar-often")
    owned = sets.join(often, "h", "left_semi").select("h", F.explode("s").alias("shingle"))
    alone = owned.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts"), F.min("h").alias("h")).filter("texts = 1").groupBy("h").agg(F.count(F.lit(1)).alias("alone"))
    return durable(often.join(alone, "h", "left").select("h", "often", F.coalesce("alone", F.lit(0)).alias("alone")), "similar-alone")


def similar_groups(texts: DataFrame, sketched: DataFrame, list_bound: int = 32, leaders: int = 4) -> DataFrame:
    """Edges (u, v) between groups that hold similar texts. texts: h, text; sketched: h, root (its group), n, bands."""
    one = sketched.filter(F.size("bands") > 0).groupBy("h").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    postings = durable(one, "similar-sketches").select("h", "root", "n", F.explode("bands").alias("term"))
    sizes = postings.groupBy("term").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
    sizes = durable(sizes.filter("low != high").drop("low", "high"), "similar-sizes")
    listed = durable(postings.join(sizes, "term"), "similar-lists")
    fits = (F.col("ru") != F.col("rv")) & (5 * F.least("nu", "nv") >= 4 * F.greatest("nu", "nv"))
    enough = 9 * F.least("commonu", "commonv") >= 4 * (F.col("nu") + F.col("nv"))  # J >= 4/5 asks for 4/9 of both sizes in common
    names = lambda d, x, *more: d.select("term", F.col("h").alias(f"h{x}"), F.col("root").alias(f"r{x}"), *[F.col(c).alias(c + x) for c in ("n", *more)])
    short, long = (listed.filter(c).drop("size") for c in (F.col("size") <= list_bound, F.col("size") > list_bound))
    pair = ["hu", "ru", "hv", "rv"]
    near = lambda d, *more: names(d, "u", *more).join(names(d, "v", *more), "term").filter(fits & (F.col("hu") < F.col("hv")))
    sets = _sets(texts, listed.select("h"))
    if long.isEmpty():
        return _judged(sets, near(short).select(*pair))
    known = _common(long, sets)
    least = durable(long.groupBy("term").agg(F.min("n").alias("least")), "similar-least")
    long = long.join(known, "h").join(least, "term").withColumn("common", F.col("n") - F.col("alone"))
    long = durable(long.filter(9 * F.col("common") >= 4 * (F.col("n") + F.col("least"))).drop("alone", "least"), "similar-long")
    meet = lambda d: names(long, "u", "common").join(names(d, "v", "common"), "term").filter(fits & enough).select(*pair)
    ranked = lambda d, n: d.withColumn("place", F.row_number().over(W.partitionBy("term").orderBy(F.desc("often"), "h"))).filter(F.col("place") <= n).drop("place")
    renamed = lambda d, now: d.join(now, "root", "left").withColumn("root", F.coalesce("new", "root")).drop("new")
    leading = durable(ranked(long, leaders), "similar-leaders")
    settled, edges = leading.select("term", "h"), None
    while True:  # every round settles its leaders, so the rounds end
        found = _judged(sets, meet(leading))
        edges = found if edges is None else edges.union(found)
        now = components(found).select(F.col("node").alias("root"), F.col("root").alias("new"))
        now = durable(now, "similar-now")
        long, short = durable(renamed(long, now), "similar-long"), renamed(short, now)  # a join a round
        groups = long.groupBy("term", "root").agg(F.count(F.lit(1)).alias("members"))
        main = durable(groups.groupBy("term").agg(F.max(F.struct("members", "root")).alias("main")).select("term", "main.root"), "similar-main")
        outside = durable(long.join(main, ["term", "root"], "left_anti").join(settled, ["term", "h"], "left_anti"), "similar-outside")
        left = durable(outside.groupBy("term").agg(F.count(F.lit(1)).alias("left")), "similar-left")
        if left.isEmpty():
            break
        leaders *= 4
        few, many = (outside.join(left.filter(c).select("term"), "term", "left_semi") for c in (F.col("left") <= list_bound, F.col("left") > list_bound))
        leading = durable(few.union(ranked(many, leaders)), "similar-leaders")
        settled = durable(settled.union(leading.select("term", "h")), "similar-settled")
        long = durable(long.join(left.select("term"), "term", "left_semi"), "similar-long")
    short = short.join(known, "h", "left").withColumn("common", F.col("n") - F.col("alone"))
    # what is common is known among texts of long lists only
    pairs = near(durable(short, "similar-short"), "common").filter(F.col("commonu").isNull() | F.col("commonv").isNull() | enough)
    return edges.union(_judged(sets, pairs.select(*pair)))
