"""The pipeline against a plain version of every stage on its predecessor's rows."""

import itertools
import os

import public_tokenizers
import pytest

import __spark_entry__ as e
import corpus_pipeline as cp
from tests.llm import test_rules, test_short_runs, test_simhash, test_tokens
from tests.oracle import DATA
from tidegrid.llm import line_dedup, mixing, quality_rules, registry
from tidegrid.llm.common import drop_durable, durable, table


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns = docs.columns
    good = durable(cp.quality(spark, docs, DATA), "t")
    rules = quality_rules.learn_rules(docs, table(spark, DATA, "labels"))
    verdict = {r["id"]: r["kept"] for r in quality_rules.judge(docs, rules).select("row.doc_id", "kept").toDF("id", "kept").collect()}
    base = {i: test_rules.plain(t) for i, t in pairs(docs)}
    assert {i for i, _ in pairs(good)} == {i for i, k in verdict.items() if k}
    assert all(base[i][0] >= 50 and 2 * base[i][4] <= base[i][0] for i, _ in pairs(good))

    lines = durable(cp.lines(spark, good, DATA), "t")
    assert sorted(pairs(lines)) == sorted(test_short_runs.plain(pairs(good), line_dedup.MIN_RUN, 50))

    kept = durable(cp.near_duplicates(spark, lines, DATA), "t")
    group = {i: c for i, _, c in test_simhash.plain_groups([(i, test_simhash.plain_fingerprint(t)) for i, t in pairs(lines)])}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in pairs(lines) if (w := t.lower().split())}
    for i, j in itertools.combinations(sorted(sets), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and group[i] != group[j]:
            old, new = max(group[i], group[j]), min(group[i], group[j])
            group = {k: new if c == old else c for k, c in group.items()}
    assert sorted(i for i, _ in pairs(kept)) == sorted(set(group.values()))

    mixed = durable(cp.mix(spark, kept, DATA), "t")
    size = lambda t: len(t.split())
    border = max(size(t) for _, t in pairs(kept)) * kept.select("source").distinct().count() / 2
    assert abs(sum(size(t) for _, t in pairs(mixed)) - 1.5 * sum(size(t) for _, t in pairs(kept))) <= border + 20
    whole = dict(pairs(kept))
    assert all(whole[i] == t for i, t in pairs(mixed))

    packed = cp.pack(spark, mixed, DATA)
    test_tokens.check_packing(packed.collect(), pairs(mixed), test_tokens.reference(public_tokenizers.path("word_bpe_49k.json")))
    assert all(d.columns == columns for d in (good, lines, kept, mixed))
    assert cp.run(spark, DATA).count() == packed.count()


def test_edges(spark, documents):
    text = " ".join(f"w{i}" for i in range(60))
    docs = documents([(1, text), (1, text), (None, text), (2, None), (3, "")])
    for _, stage in cp.STAGES[:-1]:
        docs = durable(stage(spark, docs, DATA), "t")
    assert docs.count() == 2 and cp.pack(spark, docs, DATA).count() == 2
    empty = documents([])
    for _, stage in cp.STAGES[:-1]:
        empty = durable(stage(spark, empty, DATA), "t")
        assert empty.count() == 0
    assert cp.pack(spark, empty, DATA).count() == 0


def test_durable_tables_go(spark, documents):
    d = durable(documents([(1, "a")]), "t")
    folder = d.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert os.path.isdir(folder)
    drop_durable(spark)
    assert not os.path.exists(folder)


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.QUERIES) | {"pipeline"} <= set(e.queries()) and set(registry.SQL) <= set(registry.QUERIES)
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]
    assert mixing.WEIGHTS == (5, 2, 1)


@pytest.mark.parametrize("gone", ["tidegrid.llm", "corpus_pipeline"])
def test_entry_without(gone, tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(e.__file__).parent
    shutil.copytree(root / "tidegrid", tmp_path / "tidegrid", ignore=shutil.ignore_patterns("llm", "__pycache__") if gone == "tidegrid.llm" else None)
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, check=True)
    assert said.stdout.split()[2] == "False" and int(said.stdout.split()[0]) > 30
