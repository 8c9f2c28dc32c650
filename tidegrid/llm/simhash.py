"""SimHash near-duplicates (operator 1).

Fingerprints: 64 bits over 3-word shingles, each hashed by XXH64; computed per Arrow batch.

Links (two fingerprints that differ in at most 2 of 64 bits) by a byte-position inverted index with count filtering.
Bits differ in at most 2 of the 8 bytes, so a linked pair shares at least 6 positional bytes: the guaranteed minimum.
Lists of a single positional byte would hold 1/256 of all fingerprints each, so the index has two levels. A term is the
content of two of four byte pairs (positions included): any 6 shared positions hold at least two whole byte pairs, so no
link is missed, and a term's members are few. Inside a term the other four bytes are posted, one row a position and byte.
Members that meet in a posting are counted: 4 positions of the term, and one for each posting they share. Pairs whose
tally is under the minimum go, and the rest is verified by Hamming distance.

A term may have many members where many different near copies share it. All pairs of `list_bound` members are the most
that are ever formed; beyond that members are not paired: two members at distance 1 or 2 have a common neighbour at distance 0
or 1 that differs only in the 32 bits outside the term, so every member is hung on its 33 such neighbours and members of
one neighbour are tied to its smallest. That is exact up to connectivity and linear in the term's members, so no link is
lost at any size, and the groups are the same for every `list_bound`.

Exact copies are one node from the start. Components are contracted in rounds (common.components).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import components, durable, give_back, table
from .similar import similar_groups, sketch

SHINGLE_WORDS, SEED, MAX_DISTANCE = 3, 42, 2
MIN_SHARED_BYTES = 8 - MAX_DISTANCE
LANES = 4
#: The byte pairs (lanes) whose content is a term.
TERMS = list(combinations(range(LANES), 2))


def fingerprint_of(text: bytes) -> int:
    """The SimHash of one UTF-8 text as an unsigned 64-bit number: A-Z lower-cased, words between ASCII spaces; with
    fewer than 3 words the whole sequence is the one shingle; without a word 0."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    flat = b" ".join(words)
    if n <= SHINGLE_WORDS:
        return xxh64_intdigest(flat, SEED)
    lens = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lens + 1) - 1
    spans = zip((ends - lens).tolist(), ends[SHINGLE_WORDS - 1 :].tolist(), strict=False)
    h = np.array([xxh64_intdigest(flat[a:b], SEED) for a, b in spans], np.uint64)
    set_bits = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        rows = h[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > len(h)).tobytes(), "big")


@arrow_udf(T.LongType())
def fingerprint(texts: pa.Array) -> pa.Array:
    values = np.array([fingerprint_of(t.as_py() or b"") for t in texts.cast(pa.binary())], np.uint64)
    give_back()
    return pa.array(values.view(np.int64))


fingerprint = fingerprint.asNondeterministic()  # once a row


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _of_term(values: list[Column]) -> Column:
    """The value that belongs to a row's term kind c."""
    out = F.lit(None)
    for c, v in enumerate(values):
        out = F.when(F.col("c") == c, v).otherwise(out)
    return out


def tallied(members: DataFrame) -> DataFrame:
    """c, content, u, v, shared: pairs of a term's members(c, content, fp) that share MIN_SHARED_BYTES positional bytes or
    more, counted over the postings of the bytes outside the term."""
    byte = lambda p: (F.lit(p << 8) + F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(0xFF))).cast("int")
    rest = _of_term([F.array(*[byte(2 * k + i) for k in range(LANES) if k not in lanes for i in (0, 1)]) for lanes in TERMS])
    postings = members.select("c", "content", "fp", F.explode(rest).alias("posting"))
    a, b = (postings.select("c", "content", "posting", F.col("fp").alias(x)) for x in "uv")
    met = a.join(b, ["c", "content", "posting"]).filter("u < v").groupBy("c", "content", "u", "v").agg((F.count(F.lit(1)) + 4).alias("shared"))
    return met.filter(F.col("shared") >= MIN_SHARED_BYTES)


def links(nodes: DataFrame, list_bound: int = 32) -> DataFrame:
    """Edges (u, v) over the distinct fingerprints nodes(fp): their components are those of all pairs at Hamming
    distance 2 or less. Pairs from short lists are the links themselves; long lists give the ties described above."""
    lane = lambda k: F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))
    terms = [F.struct(F.lit(c).alias("c"), (F.shiftleft(lane(i), 16) + lane(j)).alias("content")) for c, (i, j) in enumerate(TERMS)]
    postings = nodes.select("fp", F.explode(F.array(*terms)).alias("t")).select(F.col("t.c").alias("c"), F.col("t.content").alias("content"), "fp")
    # counts are written before they are joined back, so that the join is between exchanges and can be split
    sizes = durable(postings.groupBy("c", "content").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-sizes")
    listed = durable(postings.join(sizes, ["c", "content"]), "simhash-lists")
    short, long = listed.filter(F.col("n") <= list_bound), listed.filter(F.col("n") > list_bound)
    pairs = tallied(short).select("u", "v").distinct().filter(distance("u", "v") <= MAX_DISTANCE)
    flips = [[16 * k + i for k in range(LANES) if k not in lanes for i in range(16)] for lanes in TERMS]
    masks = [F.array(F.lit(0).cast("long"), *[F.lit((1 << x) - (1 << 64) * (x == 63)).cast("long") for x in bits]) for bits in flips]
    hung = long.select("c", "content", "fp", F.explode(_of_term(masks)).alias("mask")).select("c", "content", "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("at"))
    least = hung.groupBy("c", "content", "at").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    ties = hung.join(least, ["c", "content", "at"]).select(F.col("fp").alias("u"), "v").filter("u != v")
    return pairs.select("u", "v").union(ties)


def grouped(marked: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """marked(doc_id, fp, ...) -> + root (a fingerprint that names the group) and component_id (smallest doc_id of the
    group, null only where all its ids are null). With texts(h, text), and h, n and bands in marked, groups that hold
    similar texts are one."""
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = durable(nodes, "simhash-nodes")
    found = components(links(nodes.select("fp"))).select(F.col("node").alias("fp"), "root")
    rooted = durable(nodes.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    if texts is not None:
        more = components(similar_groups(texts, marked.join(rooted.select("fp", "root"), "fp"))).select(F.col("node").alias("root"), F.col("root").alias("new"))
        rooted = durable(rooted.join(more, "root", "left").select("fp", "least", F.coalesce("new", "root").alias("root")), "simhash-roots")
    ids = durable(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-ids")
    return marked.join(rooted.select("fp", "root").join(ids, "root"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, one row per input row; other columns are ignored.

    A null text counts as one without words (fingerprint zero, linked like any other); a null doc_id belongs to its
    group but never names it; repeated rows fall into one group. Empty input: empty output."""
    marked = durable(docs.select("doc_id", fingerprint("text").alias("fp")), "simhash-fp")
    return grouped(marked).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, similar: bool = False) -> DataFrame:
    """docs with one row of each near-duplicate group: that of the smallest doc_id (nulls last; of several rows with
    that id, one by text hash). Columns as they were; only ids and hashes are grouped, texts move once.

    `similar` links texts by 5-word Jaccard similarity of 0.8 or more too, however far their fingerprints are."""
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    marks = docs.select("doc_id", fingerprint("text").alias("fp"), text_hash.alias("h"), *[sketch("text").alias("k")] * similar)
    marked = durable(marks.select("doc_id", "fp", "h", *["k.n", "k.bands"] * similar), "simhash-fp")
    texts = docs.select(text_hash.alias("h"), F.coalesce("text", F.lit("")).alias("text")) if similar else None
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")).alias("best")
    chosen = grouped(marked, texts).groupBy("root").agg(best).select(F.col("best.doc_id").alias("k"), F.col("best.h").alias("kh"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id"), text_hash.alias("h"))
    kept = rows.join(chosen.distinct(), F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("h") == F.col("kh")), "left_semi")
    again = durable(marked.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("k"), F.col("h").alias("kh")), "simhash-again")
    repeated = F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("h") == F.col("kh"))
    once = kept.join(again, repeated, "left_anti").select("row.*")
    several = kept.join(again, repeated, "left_semi").groupBy("doc_id", "h").agg(F.first("row").alias("row")).select("row.*")
    return once.unionByName(several)


def op1_simhash(spark, sf_dir):
    """Contract query: fingerprint and group of every document."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
