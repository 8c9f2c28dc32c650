import random

import corpus_pipeline as cp
from tests.oracle import DATA
from tidegrid.llm import line_dedup as ld


def plain(rows, run, min_words):
    """Text that stays of each (doc_id, text), runs of fewer lines deleted from min_words words on."""
    first, out = {}, []
    docs = [(i, t.split("\n")) for i, t in sorted(rows)]
    for pass_ in (0, 1):
        for i, lines in docs:
            solid, gone = [k for k, x in enumerate(lines) if x.split()], set()
            for size in range(1, run + 1):
                for k in range(len(solid) - size + 1):
                    key = tuple(lines[j] for j in solid[k : k + size])
                    if size == run or len(" ".join(key).split()) >= min_words:
                        if not pass_:
                            first.setdefault(key, (i, solid[k]))
                        elif first[key] < (i, solid[k]):
                            gone |= set(range(solid[k], solid[k + size] if k + size < len(solid) else len(lines)))
            if pass_:
                out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


def test_random_short_runs(documents):
    rng = random.Random(1)
    pool = ["a", "b", "c", "", "d e", "f g h", "i j k l", "m n o p q"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 20)))) for i in range(30)]
    got = sorted((r["doc_id"], r["kept"]) for r in ld.mark(documents(rows), 3, 5).select("row.doc_id", "kept").collect())
    assert got == plain(rows, 3, 5)


def test_stage_cuts_long_lines(spark, documents):
    """One line of 60 words, and two of 30, that stand in an earlier document go; a line of 30 stays."""
    words = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    rows = [(1, f"{words('a', 60)}\nx\n{words('b', 30)}\n{words('c', 30)}"), (2, f"y\n{words('a', 60)}\nz"), (3, f"u\n{words('b', 30)}\n{words('c', 30)}\nv"), (4, f"p\n{words('b', 30)}\nq")]
    got = {r["doc_id"]: r["text"] for r in cp.lines(spark, documents(rows), DATA).collect()}
    assert got == {1: rows[0][1], 2: "y\nz", 3: "u\nv", 4: rows[3][1]}
