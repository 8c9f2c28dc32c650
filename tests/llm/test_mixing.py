import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import DATA, same
from tidegrid.llm import mixing
from tidegrid.llm.common import table


def test_sql(spark):
    same(spark, mixing.op10_mixing, mixing.OP10_SQL)


def water(sizes, weights, share=1.5, cap=2.0):
    """Targets by resharing the excess, round after round."""
    want, target, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        rest = want - sum(target[i] for i in range(len(sizes)) if i not in open_)
        given = {i: rest * weights[i] / sum(weights[j] for j in open_) for i in open_}
        full = {i for i in open_ if given[i] > cap * sizes[i]}
        if not full:
            for i in open_:
                target[i] = given[i]
            break
        for i in full:
            target[i] = cap * sizes[i]
        open_ -= full
    return target


@pytest.mark.parametrize("seed", range(5))
def test_targets(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = [int(x) for x in rng.integers(0, 1000, rng.integers(1, 9)) ** 2]
    names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    d = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long").repartition(3)
    got = {r["source"]: r["target"] for r in mixing.targets(d).collect()}
    assert [got[n] for n in names] == pytest.approx(water(sizes, weights))


def test_takes_whole_target(spark):
    rows = mixing.op10_mixing(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "source"), "doc_id")
    per = rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max(F.col("taken") - 2 * F.col("size")).alias("over")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 1 and r["over"] <= 0 for r in per)
    assert rows.count() == 1000


EDGE = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "q " * 50, None), (None, "d e", "y"), (5, "\t f\n\ng  h\n", "y"), (6, "i", "z"), (6, "j k", "z")]


def edge(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "r", 9) for i, t, s in rows], "doc_id long, text string, source string, n_chars long, row string, line int")


def test_edges(spark):
    d = edge(spark, EDGE)
    sized = d.select("doc_id", "source", mixing.words_in(F.col("text")).alias("size"), mixing.order_key(F.col("text")).alias("key"), F.col("doc_id").alias("row"))
    rows = mixing.plan_mix(sized).collect()
    assert sorted((r["row"] or 0, r["size"]) for r in rows) == sorted((i or 0, len((t or "").split())) for i, t, _ in EDGE)
    assert all(0 <= r["taken"] <= 2 * r["size"] and sum(r["copies"]) == r["taken"] for r in rows)
    assert mixing.plan_mix(sized.limit(0)).count() == 0
    assert mixing.plan_mix(sized.filter("size = 0")).select("taken").distinct().collect()[0][0] == 0


def test_mixed_texts(spark):
    d = edge(spark, EDGE)
    m = mixing.mix(d)
    assert m.columns == d.columns
    words = sum(len(r["text"].split()) for r in m.collect())
    assert words == round(1.5 * sum(len((t or "").split()) for _, t, _ in EDGE))
    whole = {t for _, t, _ in EDGE}
    for r in m.collect():
        assert r["text"] in whole or any((t or "").startswith(r["text"]) for t in whole) and r["n_chars"] == len(r["text"]) and r["text"] == r["text"].rstrip()
    assert mixing.mix(d.limit(0)).count() == 0


def test_whole_texts(spark):
    """With whole, every copy is the whole text, and a source misses its target by half of its border document at most."""
    d = edge(spark, EDGE)
    assert {r["text"] for r in mixing.mix(d, whole=True).collect()} <= {t for _, t, _ in EDGE}
    sized = table(spark, DATA, "documents").select("doc_id", "source", mixing.words_in(F.col("text")).alias("size"), mixing.order_key(F.col("text")).alias("key"), F.struct("source").alias("row"))
    for r in mixing.plan_mix(sized, whole=True).groupBy("row.source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most"), F.max(F.col("taken") % F.greatest("size", F.lit(1))).alias("part")).collect():
        assert r["part"] == 0 and abs(r["taken"] - r["target"]) <= r["most"] / 2 + 1


def test_curriculum(spark):
    """Positions follow each source's schedule: the first (fading in) comes later than the last (fading out)."""
    d = spark.createDataFrame([(i, f"s{i % 3}", 10, i) for i in range(3000)], "doc_id long, source string, size long, row long").withColumn("key", mixing.order_key(F.lit("")))
    p = mixing.plan_mix(d, weights=(1, 1, 1)).select("row", F.explode(F.arrays_zip("copies", "due")).alias("c")).filter("c.copies > 0")
    mean = {r["s"]: r["m"] for r in p.groupBy((F.col("row") % 3).alias("s")).agg(F.avg("c.due").alias("m")).collect()}
    assert mean[0] > mean[1] > mean[2] and mean[1] == pytest.approx(0.5, abs=0.01)
    assert p.filter("c.due <= 0 OR c.due > 1.0000001").count() == 0


def test_same_again(spark):
    a, b = (sorted(map(tuple, mixing.op10_mixing(spark, DATA).collect())) for _ in range(2))
    assert a == b


def test_null_ids_spread(spark):
    """Rows without an id fall into many slices, and more rows into more slices."""
    d = spark.createDataFrame([(None, f"text {i}") for i in range(2000)], "doc_id long, text string")
    assert d.select(F.substring(mixing.order_key(F.col("text")), 1, 3)).distinct().count() > 1500
    assert [mixing.slice_digits_for(n) for n in (0, 10**6, 10**9, 10**10)] == [3, 3, 4, 5]


def test_texts_read_once(spark):
    plan = mixing.op10_mixing(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "regexp_count" not in plan
