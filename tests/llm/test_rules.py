import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import DATA
from tidegrid.llm import quality_rules as qr
from tidegrid.llm.common import table


def plain(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, covered = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered |= {p + k for p in places for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \t\n", "a", "a a a a", "a b c a b c", "x y z w x y", "l\nl\n\n\nl ", "ä € 😀 #|", "a b  c", "\x1f \x85 q", "one two three " * 400, "w" * 300_000, "\r\n a\x0b\x0cb"]


def test_counts_of_edges(spark, documents):
    d = documents(list(enumerate(TEXTS))).withColumn("c", qr.text_counts("text"))
    got = {r["doc_id"]: tuple(r["c"])[:5] for r in d.collect()}
    assert got == {i: plain(t) for i, t in enumerate(TEXTS)}


def test_whole_table(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, DATA, "documents").collect()}
    rows = qr.op9_quality_rules(spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = plain(docs[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] is False if r["base_failed"] else r["kept"] == (r["rule"] is None)


def test_learned_list():
    rng = np.random.default_rng(1)
    x = rng.random((900, 3))
    bad = (x[:, 0] > 0.8) | ((x[:, 1] < 0.2) & (x[:, 2] > 0.5))
    rules = qr.learn(x, bad, ["a", "b", "c"])
    assert 2 <= len(rules) <= 6
    got = np.zeros(len(x), bool)
    for r in rules:
        got |= qr._covered(r, x, ["a", "b", "c"])
    assert (got == bad).mean() > 0.97
    assert qr.learn(x, np.zeros(900, bool), ["a", "b", "c"]) == []
    assert qr.learn(x, rng.random(900) < 0.5, ["a", "b", "c"]) == []  # noise: no precise rule
    assert qr.learn(x[:0], bad[:0], ["a", "b", "c"]) == []


def test_ordered_condition(spark):
    rules = [(qr.Condition("a", True, 1.0),), (qr.Condition("a", False, 1.0), qr.Condition("b", True, 0.0))]
    d = spark.createDataFrame([(2.0, 5.0), (0.0, 5.0), (0.0, -1.0)], "a double, b double")
    assert [r[0] for r in d.select(qr.rejects(rules, {"a": F.col("a"), "b": F.col("b")})).collect()] == [1, 2, None]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = table(spark, d, "labels").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    got = qr.op9_quality_rules(spark, d).filter("NOT base_failed").join(truth, "doc_id").select("kept", "quality").collect()
    assert len(got) > 30 and np.mean([r["kept"] == (r["quality"] == 1) for r in got]) >= 0.97


def test_keep_good(spark, documents):
    good = " ".join(f"word{i}" for i in range(60))
    d = documents([(1, good), (1, good), (2, "short"), (3, None), (None, good)])
    kept = qr.keep_good(d, [])
    assert kept.columns == d.columns and kept.count() == 3
    assert qr.keep_good(d.limit(0), []).count() == 0
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert qr.learn_rules(d, empty) == []
    odd = spark.createDataFrame([(None, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    assert qr.learn_rules(d, odd) == []


@pytest.mark.parametrize("n", [3, 10, 60])
def test_repeats_random(n):
    rng = np.random.default_rng(n)
    for _ in range(60):
        words = [rng.choice(list("abc")) for _ in range(n)]
        assert qr.repeated_words([w.encode() for w in words]) == plain(" ".join(words))[4]


def test_verdict_brute_force(spark):
    """kept against the learned list walked through rule by rule, on counts taken in plain Python."""
    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents").select("doc_id", "text")
    rules = qr.learn_rules(docs, table(spark, d, "labels"))
    assert rules
    got = {r["doc_id"]: r for r in qr.op9_quality_rules(spark, d).collect()}
    for r in docs.collect():
        text = r["text"] or ""
        n, chars, symbols, dup, repeats = plain(text)
        letters = re.sub("[ \t\n\v\f\r]", "", text)
        lines = sum(bool(re.search("[^ \t\v\f\r]", line)) for line in text.split("\n"))
        share = lambda a, b: a / b if b else 0.0
        x = {
            "words": n, "mean_word": share(chars, n), "symbols_per_word": share(symbols, n), "repeat_share": share(repeats, n), "dup_line_share": share(dup, lines),
            "upper_share": share(sum("A" <= c <= "Z" for c in letters), chars), "marks_per_word": share(sum(c in "!?" for c in letters), n), "digit_share": share(sum("0" <= c <= "9" for c in letters), chars),
        }
        fired = next((k for k, rule in enumerate(rules, 1) if all((x[c.feature] > c.threshold) == c.above for c in rule)), None)
        failed = n < 50 or 100 * repeats > 50 * n
        assert (got[r["doc_id"]]["base_failed"], got[r["doc_id"]]["rule"], got[r["doc_id"]]["kept"]) == (failed, fired, not failed and fired is None)
