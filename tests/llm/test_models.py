import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import DATA
from tidegrid.llm import language as lg
from tidegrid.llm import quality_model as qm
from tidegrid.llm.common import table


@pytest.mark.parametrize("block", [1, 2, 3, 5, 50])
def test_forward_backward(block):
    rng = np.random.default_rng(block)
    emit, move, first = rng.normal(size=(14, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    starts = np.zeros(14, bool)
    starts[[0, 1, 6, 10]] = True
    want = np.zeros((14, 3))
    bounds = [*np.nonzero(starts)[0], 14]
    for i, j in zip(bounds, bounds[1:], strict=False):
        for path in itertools.product(range(3), repeat=j - i):
            p = np.exp(first[path[0]] + sum(emit[i + t, y] for t, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:], strict=False)))
            for t, y in enumerate(path):
                want[i + t, y] += p
    want /= want.sum(axis=1, keepdims=True)
    assert np.allclose(lg.forward_backward(emit, starts, move, first, block)[2], want)


@pytest.fixture(scope="module")
def crf(spark):
    return lg.train(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang"))


def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    truth = table(spark, d, "documents").select("doc_id", "lang")
    rows = lg.op3_language(spark, d).join(truth, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and len(held) > 100
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_switched_words(crf):
    words, marginals = lg.label_words(crf, ["the thing of and was that le la des mentre eauoi est qui", None, "12"])
    got = [crf.langs[m.argmax()] for m in marginals[0]]
    assert got[:5] == ["en"] * 5 and got[-5:] == ["fr"] * 5
    assert words[1:] == [[], []] and marginals[0].sum(axis=1) == pytest.approx(np.ones(len(got)))


def test_language_edges(spark, documents, crf):
    rows = [(1, None), (2, ""), (3, "12 34 !?"), (4, "²"), (5, "the"), (None, "der die und keit"), (6, "the of and " * 30_000), (7, "é" * 50_000), (5, "the")]
    got = lg.predict(documents(rows), crf)
    assert got.columns == [*documents(rows).columns, "lang_pred", "score"]
    by = {r["doc_id"]: r for r in got.collect()}
    assert [by[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und"] * 4 and by[1]["score"] == 0
    assert by[5]["lang_pred"] == by[6]["lang_pred"] == "en" and by[None]["lang_pred"] == "de"
    assert lg.predict(documents(rows[:0]), crf).count() == 0
    named = documents(rows).withColumns({"guess": F.lit(1), "score": F.lit("x")})
    assert lg.predict(named, crf).columns == [*documents(rows).columns, "guess", "lang_pred", "score"]
    nothing = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")
    assert lg.train(nothing) is None
    assert {r["lang_pred"] for r in lg.predict(documents(rows), None).collect()} == {"und"}


def test_one_language(spark, documents):
    model = lg.fit([[("a", 0), ("b", 0)]], ["xx"], rounds=3)
    assert [tuple(r) for r in lg.predict(documents([(1, "a b")]), model).select("lang_pred", "score").collect()] == [("xx", 1.0)]


def auc(y, s):
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    for v in np.unique(s):
        at = np.nonzero(s[order] == v)[0]
        ranks[order[at]] = at.mean() + 1
    p = y.sum()
    return (ranks[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    rows = qm.op4_quality_model(spark, d).join(table(spark, d, "labels"), "doc_id").filter("held_out").collect()
    y, s = np.array([r["quality"] for r in rows]), np.array([r["score"] for r in rows])
    assert auc(y, s) >= 0.97 and np.mean(y == [r["predicted"] for r in rows]) >= 0.93


def test_prior_and_risk():
    rng = np.random.default_rng(0)
    good = lambda n: rng.normal(0, 1, (n, 4)) + [1.5, 0, 0, 0]
    bad = lambda n: rng.normal(0, 1, (n, 4)) - [1.5, 0, 0, 0]
    for prior in (0.3, 0.7):
        n = 3000
        m = qm.fit(good(2000), np.concatenate([good(int(n * prior)), bad(n - int(n * prior))]))
        assert m.prior == pytest.approx(prior, abs=0.12)
        assert (m.score(good(500)) > 0.5).mean() > 0.85 and (m.score(bad(500)) < 0.5).mean() > 0.85
    assert qm.fit(good(0), bad(5)) is None


def test_quality_edges(spark, documents):
    docs = table(spark, DATA, "documents").select("doc_id", "text")
    model = qm.train(docs, table(spark, DATA, "labels"))
    rows = [(1, None), (2, ""), (3, "a"), (None, "word " * 50_000), (4, "z" * 100_000), (4, "z" * 100_000)]
    d = documents(rows).withColumn("score", qm.scored(model)("text"))
    got = [r["score"] for r in d.collect()]
    assert all(0 <= s <= 1 for s in got) and got[0] == got[1] and got[4] == got[5]
    assert qm.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")) is None
    assert {r["score"] for r in documents(rows).withColumn("score", qm.scored(None)("text")).collect()} == {0.5}
    assert qm.keep_good(documents(rows), model).columns == documents(rows).columns
    assert qm.keep_good(documents(rows[:0]), model).count() == 0
    held = qm.op4_quality_model(spark, DATA).select("doc_id", "held_out", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("want"))
    assert held.filter("held_out != want").count() == 0


def test_language_brute_force(spark):
    """The query against word-by-word sums of the learned weights and a forward-backward of one text at a time."""
    docs = table(spark, DATA, "documents").select("doc_id", "text", "lang")
    m = lg.train(docs)
    got = {r["doc_id"]: r for r in lg.op3_language(spark, DATA).collect()}
    move, first = np.exp(m.transitions), np.exp(m.first)
    for r in docs.collect():
        words = [w for w in re.findall(r"[^\W\d_]+", (r["text"] or "").lower()) if any(map(str.isalpha, w))]
        if not words:
            assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["score"]) == ("und", 0.0)
            continue
        emit = []
        for w in words:
            padded = f"^{w}$"
            names = ["p" + w[:k] for k in (1, 2, 3)] + ["s" + w[-k:] for k in (1, 2, 3)] + [padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1)] + [padded]
            total = sum(m.weights[zlib.crc32(x.encode()) % lg.BUCKETS].astype(float) for x in names) + (m.weights[lg.BUCKETS + m.lexicon[w]] if w in m.lexicon else 0)
            emit.append(np.exp(total - total.max()))
        alpha, beta = [first * emit[0]], [np.ones(len(m.langs))]
        for e in emit[1:]:
            a = alpha[-1] @ move * e
            alpha.append(a / a.sum())
        for e in emit[:0:-1]:
            b = move @ (e * beta[-1])
            beta.append(b / b.sum())
        share = np.mean([a * b / (a * b).sum() for a, b in zip(alpha, beta[::-1], strict=True)], axis=0)
        assert got[r["doc_id"]]["score"] == pytest.approx(share.max(), abs=1e-4)
        assert share[m.langs.index(got[r["doc_id"]]["lang_pred"])] == pytest.approx(share.max(), abs=1e-4)


def test_quality_brute_force(spark):
    """The query against statistics taken word by word and the learned steps added one by one."""
    docs = table(spark, DATA, "documents").select("doc_id", "text")
    m = qm.train(docs, table(spark, DATA, "labels"))
    got = {r["doc_id"]: r for r in qm.op4_quality_model(spark, DATA).collect()}
    for r in docs.collect():
        text = r["text"] or ""
        words = [w for w in re.split("[ \t\n\v\f\r]+", text) if w]
        n, x = len(words), [0.0] * len(qm.NAMES)
        if n:
            windows = [tuple(words[i : i + 3]) for i in range(n - 2)]
            twice = {w for w, c in Counter(windows).items() if c > 1}
            lines = [line for line in text.split("\n") if re.search("[^ \t\v\f\r]", line)]
            chars = "".join(words)
            x = [
                math.log(n + 1), len(chars) / n, sum(c in "#*$%&|<>" for c in text) / n, len({i + k for i, w in enumerate(windows) if w in twice for k in range(3)}) / n,
                (len(lines) - len(set(lines))) / len(lines), sum("A" <= c <= "Z" for c in chars) / len(chars), sum(c in "!?" for c in chars) / n,
                sum("0" <= c <= "9" for c in chars) / len(chars), len(set(words)) / n, math.log(n / len(lines) + 1), sum(w[-1] in ".!?" for w in words) / n,
            ]
        z = m.bias + sum(w for w, on in zip(m.weights, (v > e for v, edges in zip(x, m.edges, strict=True) for e in edges), strict=True) if on)
        score = 1 / (1 + math.exp(-max(-40, min(40, z))))
        assert got[r["doc_id"]]["score"] == pytest.approx(score, abs=1e-9) and got[r["doc_id"]]["predicted"] == int(got[r["doc_id"]]["score"] >= 0.3)


def test_samples_are_bounded(spark):
    """A third of all rows under one id does not make a sample longer than twice its bound."""
    rows = [(7 if i % 3 else i, f"word {i} the of and", "en") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    keep = lg.training_sequences
    lg.training_sequences = lambda r, seed=7: seen.append(len(r)) or keep(r, seed)
    try:
        lg.train(docs, max_docs=20)
    finally:
        lg.training_sequences = keep
    assert seen[0] <= 41
