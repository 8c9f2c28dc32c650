import random

import pytest

import corpus_pipeline as cp
from tests.oracle import DATA
from tidegrid.llm import simhash, similar
from tidegrid.llm.common import components


def plain_jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def near_copy(rng, words, changes):
    out = list(words)
    for k in rng.sample(range(0, len(words), 5), changes):
        out[k] = f"new{rng.random()}"
    return " ".join(out)


def test_stage_drops_similar(spark, documents):
    """Two words of 127 replaced: more than 2 bits, similarity above 0.8. Nine replaced: below."""
    rng = random.Random(3)
    rows = []
    for i in range(20):
        words = [f"w{rng.randrange(5000)}" for _ in range(127)]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, near_copy(rng, words, 2)), (3 * i + 2, near_copy(rng, words, 9))]
    assert all(plain_jaccard(rows[k][1], rows[k + 1][1]) >= 0.8 > plain_jaccard(rows[k][1], rows[k + 2][1]) for k in range(0, 60, 3))
    kept = sorted(r["doc_id"] for r in cp.near_duplicates(spark, documents(rows), DATA).collect())
    assert kept == [i for i in range(60) if i % 3 != 1]
    assert simhash.keep_one(documents(rows)).count() > len(kept)


@pytest.mark.parametrize("bound", [2, 32])
def test_short_and_long_lists(spark, documents, bound):
    """Clouds around a few texts: the groups are those of all pairs, whichever lists count as long."""
    rng = random.Random(bound)
    rows = []
    for c in range(3):
        words = [f"c{c}x{k}" for k in range(200)]
        rows += [(100 * c + i, near_copy(rng, words, rng.randrange(1, 9))) for i in range(25)]
    marks = documents(rows).select("doc_id", "text", simhash.F.col("doc_id").alias("h"), simhash.F.col("doc_id").alias("root"), similar.sketch("text").alias("k"))
    found = components(similar.similar_groups(marks.select("h", "text"), marks.select("h", "root", "k.n", "k.bands"), bound)).collect()
    root = {r["node"]: r["root"] for r in found}
    want = {i: i for i, _ in rows}
    for i, a in rows:
        for j, b in rows:
            if j < i and plain_jaccard(a, b) >= 0.8 and want[i] != want[j]:
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = {k: new if x == old else x for k, x in want.items()}
    assert {i: root.get(i, i) for i, _ in rows} == want


def test_work_is_linear_in_a_family(spark, documents, monkeypatch):
    """Twice the near copies of one text: about twice the pairs judged, and nearly all groups of all pairs found."""
    judged = []
    keep = similar._judged
    monkeypatch.setattr(similar, "_judged", lambda t, p: judged.append(p.distinct().count()) or keep(t, p))
    counts = {}
    for n in (300, 600):
        rng = random.Random(7)
        words = [f"w{k}" for k in range(150)]
        rows = [(i, near_copy(rng, words, rng.randrange(0, 7))) for i in range(n)]
        marks = documents(rows).select("doc_id", "text", simhash.F.col("doc_id").alias("h"), simhash.F.col("doc_id").alias("root"), similar.sketch("text").alias("k"))
        judged.clear()
        found = components(similar.similar_groups(marks.select("h", "text"), marks.select("h", "root", "k.n", "k.bands"))).collect()
        counts[n] = sum(judged)
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for _, t in rows for w in [t.split()]]
        group = list(range(n))
        for i in range(n):
            for j in range(i):
                if group[i] != group[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    old, new = max(group[i], group[j]), min(group[i], group[j])
                    group = [new if g == old else g for g in group]
        merges = n - len(set(group))
        assert merges > n / 3 and len({r["node"] for r in found}) - len({r["root"] for r in found}) >= 0.97 * merges
    assert counts[600] < 3 * counts[300]
