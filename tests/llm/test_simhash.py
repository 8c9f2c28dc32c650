import random

import pytest
from xxhash import xxh64_intdigest

from tests.oracle import DATA
from tidegrid.llm import simhash
from tidegrid.llm.common import components, table


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))


def plain_groups(rows):
    """(doc_id, fingerprint) -> (hex, smallest id reachable over distances of 2 or less)."""
    prints = sorted({f for _, f in rows})
    parent = {f: f for f in prints}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return sorted(((d, f"{f:016x}", least.get(root(f))) for d, f in rows), key=str)


def ours(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table(spark):
    docs = table(spark, DATA, "documents")
    want = plain_groups([(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()])
    assert ours(simhash.op1_simhash(spark, DATA)) == want


EDGE = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (5, "one two"), (None, "one two"), (None, "alone here"), (6, "É é straße ABC"), (7, "a" * 5000), (8, "x y z " * 20_000), (9, "x y z " * 20_000)]


def test_edges(documents):
    want = plain_groups([(d, plain_fingerprint(t)) for d, t in EDGE])
    assert ours(simhash.near_duplicates(documents(EDGE))) == want
    assert simhash.near_duplicates(documents(EDGE[:0])).count() == 0


def test_keep_one(documents):
    kept = simhash.keep_one(documents(EDGE))
    assert kept.columns == documents(EDGE[:1]).columns
    assert sorted(kept.select("doc_id", "text").collect(), key=str) == sorted([(1, None), (4, "One two"), (None, "alone here"), EDGE[8], EDGE[9], EDGE[10]], key=str)
    twice = documents([(3, "a b c d"), (3, "a b c d"), (4, "a b c d")])
    assert [r["doc_id"] for r in simhash.keep_one(twice).collect()] == [3]


@pytest.mark.parametrize("bound", [2, 8, 1000])
def test_links_short_and_long_lists(spark, bound):
    """Dense clouds of fingerprints: groups are the same whichever lists count as long."""
    rng = random.Random(bound)
    prints = {rng.getrandbits(64) for _ in range(20)}
    for _ in range(150):
        x = rng.choice(sorted(prints))
        for _ in range(rng.choice([1, 1, 2, 3, 4])):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    found = {r["node"]: r["root"] for r in components(simhash.links(nodes, bound)).collect()}
    want = plain_groups([(i, f) for i, f in enumerate(sorted(prints))])
    place = {f"{f:016x}": signed(f) for f in prints}
    groups = {}
    for _, h, c in want:
        groups.setdefault(c, set()).add(place[h])
    got = {}
    for f in place.values():
        got.setdefault(found.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_tally(spark):
    """Of members of one term, sharing bytes 0 to 3: pairs that share 5 positional bytes are rejected by the tally alone,
    pairs that share 6 come through it whatever their distance, and verification takes the far ones out."""
    base = 0x1122334455667788
    members = {"base": base, "five": base ^ 0x0101010000000000, "six_far": base ^ 0x7F07000000000000, "six_near": base ^ 0x0100010000000000, "four": base ^ 0x0102040800000000}
    d = spark.createDataFrame([(0, 7, v) for v in members.values()], "c int, content long, fp long")
    got = {(r["u"], r["v"]): r["shared"] for r in simhash.tallied(d).collect()}
    shares = lambda a, b: sum((a ^ b) >> 8 * k & 255 == 0 for k in range(8))
    want = {(a, b): shares(a, b) for a in members.values() for b in members.values() if a < b and shares(a, b) >= 6}
    assert got == want
    pair = lambda x: tuple(sorted((base, members[x])))
    assert pair("six_far") in got and pair("six_near") in got and pair("five") not in got
    linked = {tuple(sorted(r)) for r in simhash.links(d.select("fp")).collect()}
    assert pair("six_near") in linked and pair("six_far") not in linked


def test_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(edges.filter("u < 0")).count() == 0
