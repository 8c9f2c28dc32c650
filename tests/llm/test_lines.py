import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.oracle import DATA, same
from tidegrid.llm import line_dedup as ld


def test_sql(spark):
    same(spark, ld.op8_line_dedup, ld.OP8_SQL)


def plain(rows, run):
    """Kept text and lines removed of each (doc_id, text)."""
    docs = []
    for i, t in rows:
        lines = [] if t is None else t.split("\n")
        docs.append(((1 << 63) - 1 if i is None else i, lines, [k for k, x in enumerate(lines) if x.encode().split()]))
    first = {}
    for order, lines, solid in docs:
        for k in range(len(solid) - run + 1):
            key = tuple(lines[j] for j in solid[k : k + run])
            at = (order, solid[k])
            first[key] = min(at, first.get(key, at))
    out = []
    for (i, t), (order, lines, solid) in zip(rows, docs, strict=True):
        gone = set()
        for k in range(len(solid) - run + 1):
            if first[tuple(lines[j] for j in solid[k : k + run])] < (order, solid[k]):
                end = solid[k + run] if k + run < len(solid) else len(lines)
                gone |= set(range(solid[k], end))
        out.append((i, len(lines), len(gone), None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return sorted(out, key=str)


def ours(docs, run):
    return sorted((tuple(r) for r in ld.mark(docs, run).select("row.doc_id", "n_lines", "n_removed", "kept").collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("run", [1, 2, 3, 5])
def test_random_texts(documents, seed, run):
    rng = random.Random(seed)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", "  ", "d e"]) for _ in range(rng.randint(0, 25)))) for i in rng.sample(range(100), 25)]
    assert ours(documents(rows), run) == plain(rows, run)


def test_edges(documents):
    rows = [(None, "a\nb\nc"), (1, "a\nb\nc"), (1, "a\nb\nc"), (2, None), (3, ""), (4, "\n\n"), (5, "x\na\n\nb\nc\n\ny"), (6, "a\r\nb\nc"), (7, "l\n" * 3000), (8, "q" * 200_000 + "\na\nb\nc"), (9, "é \nb\nc"), (10, "a\nb\nc\nd")]
    assert ours(documents(rows), 3) == plain(rows, 3)
    assert ours(documents(rows[:0]), 3) == []


def test_columns(documents):
    d = ld.drop_repeated_lines(documents([(1, "a\nb\nc"), (2, "a\nb\nc\nd"), (3, None)]))
    assert d.columns == documents([(1, "")]).columns
    assert [(r["text"], r["n_chars"], r["row"]) for r in d.orderBy("doc_id").collect()] == [("a\nb\nc", 5, "a"), ("d", 1, "a"), (None, None, "a")]


def test_plan_is_native(spark):
    plan = ld.op8_line_dedup(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert spark.range(1).select(F.sha2(F.lit("a"), 256)).first()[0] == hashlib.sha256(b"a").hexdigest()


def test_selected_places(documents):
    """Winnowing selects the least hash of every three lines: about half of the lines, none without a window, and for equal
    runs the same lines, wherever they stand."""
    rng = random.Random(2)
    run = [f"common {k}" for k in range(12)]
    rows = [(i, "\n".join([f"own {rng.random()}" for _ in range(40)] + run + [f"own {rng.random()}" for _ in range(40)])) for i in range(50)]
    rows += [(60, "two\nlines"), (61, None)]
    found = ld.fingerprints(documents(rows)).collect()
    assert 0.4 * 50 * 92 < len(found) < 0.6 * 50 * 92 and not any(r["ord"] in (60, 61) for r in found)
    inside = {}
    for r in found:
        if 42 <= r["place"] < 50:  # windows that lie in the run altogether
            inside.setdefault(r["ord"], set()).add((r["fp"], r["place"]))
    assert len(inside) == 50 and len(set(map(frozenset, inside.values()))) == 1
    for r in found:
        assert r["left"] + r["right"] >= 2 and len(r["near"]) >= r["left"] + r["right"] + 1 and r["near"][r["left"]]["h"] == r["fp"]
