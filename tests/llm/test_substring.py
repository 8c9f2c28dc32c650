import hashlib
import random

import pytest

from tests.oracle import DATA
from tidegrid.llm import substring_dedup as sd
from tidegrid.llm.common import table


def plain(rows):
    """rows of (doc_id, text) -> sorted (doc_id, words, removed, sha256)."""
    docs = [((1 << 63) - 1 if i is None else i, i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for order, _, w in docs:
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(order, first.get(key, order))
    out = []
    for order, i, w in docs:
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < order:
                gone |= set(range(k, k + 50))
        keep = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(keep)).hexdigest()))
    return sorted(out, key=str)


def ours(docs):
    d = sd.with_spans(docs).select("row.doc_id", sd._digest("row.text", "spans").alias("x")).select("doc_id", "x.*")
    return sorted((tuple(r) for r in d.collect()), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_automaton(seed):
    rng = random.Random(seed)
    for _ in range(100):
        passages = [[rng.choice("abc") for _ in range(rng.randint(0, 14))] for _ in range(3)]
        a = sd.SuffixAutomaton()
        for p in passages:
            a.add(p)
        w = [rng.choice("abc") for _ in range(16)]
        want = {x for i in range(len(w) - 3) if any(w[i : i + 4] == p[j : j + 4] for p in passages for j in range(len(p) - 3)) for x in range(i, i + 4)}
        assert {x for s, e in a.spans(w, 4) for x in range(s, e)} == want


def test_whole_table(spark):
    want = plain([(r["doc_id"], r["text"]) for r in table(spark, DATA, "documents").collect()])
    assert sorted((tuple(r) for r in sd.op2_substring_dedup(spark, DATA).collect()), key=str) == want
    assert sum(r[2] for r in want) > 0


def corpus(seed, n=40):
    """Texts with shared passages, periodic stretches, near copies and shifted repeats."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3)
    passages = [" ".join(word() for _ in range(rng.choice([49, 50, 51, 80, 200]))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 5)):
            kind = rng.random()
            parts.append(rng.choice(passages) if kind < 0.4 else " ".join(["a b c"] * rng.randint(5, 60)) if kind < 0.55 else " ".join(word() for _ in range(rng.randint(3, 90))))
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    ids = rng.sample(range(1000), n)
    return list(zip(ids, texts, strict=True)) + [(i + 1000, texts[i]) for i in range(5)]


@pytest.mark.parametrize("seed,shard", [(1, 512), (2, 1), (3, 3)])
def test_random_corpora(documents, monkeypatch, seed, shard):
    """With 1 every shard of two contents is dealt again, down to whole windows; with 512 none is."""
    monkeypatch.setattr(sd, "SHARD", shard)
    rows = corpus(seed)
    assert ours(documents(rows)) == plain(rows)


def test_crowded_passage(documents):
    """A passage of 70 words in 2,000 different surroundings, and 1,500 near copies of one text: shards of more than SHARD
    contents at the first level."""
    rng = random.Random(9)
    passage, base = [f"p{k}" for k in range(70)], [f"b{k}" for k in range(120)]
    rows = [(i, " ".join([f"x{rng.random()}" for _ in range(8)] + passage + [f"y{rng.random()}" for _ in range(8)])) for i in range(2000)]
    for i in range(2000, 3500):
        copy = list(base)
        copy[rng.randrange(120)] = f"z{rng.random()}"
        rows.append((i, " ".join(copy)))
    assert ours(documents(rows)) == plain(rows)


def test_edges(documents):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long), (3, long), (3, long), (4, None), (5, ""), (6, "\t \n"), (7, long + " tail"), (8, "pre " + long), (9, " ".join(long.split()[:49])), (10, "x" * 100_000), (11, long + " other"), (11, "Other " + long)]
    assert ours(documents(rows)) == plain(rows)
    assert ours(documents(rows[:0])) == []


def test_texts(documents):
    long = " ".join(f"w{i}" for i in range(60))
    d = sd.drop_repeated_passages(documents([(1, long), (2, f"keep \n {long}\ttoo"), (3, "as  it is"), (4, None)]))
    assert d.columns == documents([(1, "")]).columns
    assert [(r["doc_id"], r["text"], r["n_chars"]) for r in d.orderBy("doc_id").collect()][1:] == [(2, "keep too", 8), (3, "as  it is", 9), (4, None, None)]


def test_known_reference(documents, spark):
    passage = " ".join(f"b{i}" for i in range(55))
    d = sd.cut_known(documents([(1, f"a {passage} z"), (2, "b0 b1"), (3, None)]), spark.createDataFrame([(passage,), (None,)], "text string"))
    assert [r["text"] for r in d.orderBy("doc_id").collect()] == ["a z", "b0 b1", None]
    with pytest.raises(ValueError):
        sd.cut_known(documents([(1, "a")]), spark.createDataFrame([(passage,)], "text string"), most_words=10)
