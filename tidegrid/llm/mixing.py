"""Mixing sources to target weights as a time-varying curriculum (operator 10).

Targets. Source i has weight w_i and size S_i (words). The mix holds `share` times all words; target T_i is
min(cap * S_i, lambda * w_i) with the one lambda that makes the targets add up: what a full source leaves over is
shared among the others by weight until none is above its cap. lambda comes from one pass over the sources ordered by
cap * S_i / w_i, not from iteration.

Curriculum. Source i's weight at time t in [0, 1] of the stream is linear, w_i * (a_i + 2 (1 - a_i) t): a_i < 1 fades in,
a_i > 1 fades out. Its integral, the cumulative demand for words, is D_i(t) = T_i * (a_i t + (1 - a_i) t^2). The n-th
word that a source gives is due at D_i^-1(n), a quadratic solved in closed form. A document's copies take consecutive words
of the source's (pseudo-random but fixed) order; copy c sits at pass c of that order. So position is a function of the
row and of a prefix sum, and the mix is a range sort by position.

Prefix sums. A source may hold any part of all rows: sizes are first summed by (source, slice of the order), the slices
are prefix-summed, and a window inside one slice adds the rest. The order is by a hash of id and text, and there are
as many slices as the rows ask for, so neither a source nor rows with a null or repeated id are one task. The sums by slice
are a small table that is written once, so that no text is counted again for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, durable, shuffle_width, table

#: Weights dealt to the sources by name order, repeating.
WEIGHTS = (5, 2, 1)
#: a_i of each source's weight schedule, dealt in the same way; 0 to 2, so that no weight is ever negative.
STARTS = (0.5, 1.0, 1.5)


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, starts: tuple[float, ...] = STARTS) -> DataFrame:
    """sources(source, source_size) -> + weight, begin (a_i), target. One row a source; a null source sorts last.

    Sources with no words get target 0. The two windows run over the table of sources, which doesn't grow with rows."""
    deal = W.orderBy(F.col("source").asc_nulls_last())
    dealt = lambda values: F.element_at(F.array(*[F.lit(float(x)) for x in values]), (F.row_number().over(deal) - 1) % len(values) + 1)
    s = sources.withColumn("weight", dealt(weights)).withColumn("begin", dealt(starts)).withColumn("full", F.col("source_size") * F.lit(float(cap)))
    by_ratio = W.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(1))
    s = (
        s.withColumn("want", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("filled", F.coalesce(F.sum("full").over(upto), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(after))
        .withColumn("level", (F.col("want") - F.col("filled")) / F.col("rest"))
        .withColumn("full_by", F.row_number().over(by_ratio))
    )
    # the first source (in this order) whose cap is not reached fixes lambda for itself and all later ones
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("full"), F.struct("full_by", "level"))).over(everything)
    s = s.withColumn("lam", level)
    target = F.when(F.col("lam").isNull() | (F.col("full_by") < F.col("lam.full_by")), F.col("full")).otherwise(F.col("lam.level") * F.col("weight"))
    return s.select("source", "source_size", "weight", "begin", F.least(target, F.col("full")).alias("target"))


def order_key(text: Column) -> Column:
    """Where a row stands in its source: a hash of its id and text."""
    return F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def slice_digits_for(rows: int, slice_rows: int = 100_000) -> int:
    """Hexadecimal digits of the order that a slice stands for, so that it holds about slice_rows rows at most."""
    digits = 3
    while rows / 16**digits > slice_rows:
        digits += 1
    return digits


def plan_mix(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0, starts: tuple[float, ...] = STARTS, slice_digits: int = 3, whole: bool = False) -> DataFrame:
    """sized(doc_id, source, size, key, row): one row out per row in, with row, size, source_size, target, taken, copies
    (words of each copy) and due (training position in [0, 1] of each copy). sized is read twice: once for the sums.

    taken is whole passes over the source plus, in the last pass, the documents that come first in order of key until the
    target is met to the word; the one document at that border gives its first words only or, with whole, all of them or
    none, whichever comes nearer to the target (half goes up). Size 0 is taken 0 times;
    source null is a source of its own, last in order; doc_id null counts as an empty id. Equal rows follow each
    other in the order, each with its own share. Empty input: empty output."""
    source_key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source_key")
    d = sized.select("row", "size", "source", "doc_id", source_key, "key", F.substring("key", 1, slice_digits).alias("slice"))
    slices = d.groupBy("source_key", "slice").agg(F.first("source").alias("source"), F.sum("size").alias("slice_size"))
    by_slice = W.partitionBy("source_key").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = durable(slices.withColumn("before", F.coalesce(F.sum("slice_size").over(by_slice), F.lit(0).cast("long"))), "mix-slices")
    sources = slices.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("slice_size").alias("source_size"))
    goal = targets(sources.select("source", "source_size"), weights, share, cap, starts).withColumn("source_key", source_key).drop("source", "weight")
    offsets = slices.join(goal, "source_key").select("source_key", "slice", "before", "source_size", "target", "begin")
    inside = W.partitionBy("source_key", "slice").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = d.withColumn("upto", F.sum("size").over(inside)).drop("source", "doc_id", "key").join(offsets, ["source_key", "slice"])
    d = d.withColumn("first", F.col("before") + F.col("upto") - F.col("size")).withColumn("goal", F.round("target").cast("long"))
    passes = range(int(-(-cap // 1)))
    zero, one, a = F.lit(0).cast("long"), F.lit(1.0), F.col("begin")
    copies = [F.greatest(zero, F.least(F.col("size"), F.col("goal") - F.lit(p) * F.col("source_size") - F.col("first"))) for p in passes]
    if whole:
        copies = [F.when(2 * c >= F.col("size"), F.col("size")).otherwise(zero) for c in copies]
    word = [(F.col("first") + F.lit(p) * F.col("source_size") + 1) / F.greatest(F.col("goal"), F.lit(1)) for p in passes]
    due = [F.when(a == 1.0, x).otherwise((F.sqrt(F.greatest(F.lit(0.0), a * a + F.lit(4.0) * (one - a) * x)) - a) / F.nullif(F.lit(2.0) * (one - a), F.lit(0.0))) for x in word]
    return d.select("row", "size", "source_size", "target", F.array(*copies).alias("copies"), F.array(*due).alias("due")).withColumn("taken", F.aggregate("copies", zero, lambda s, x: s + x))


#: A text's first `copies` words with what separates them; nothing after the last.
CUT = r"rtrim(' \t\n\u000B\f\r', array_join(slice(regexp_extract_all(line.text, '^[\\x20\\x09-\\x0D]+|[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*', 0), 1, int(copies) + int(line.text RLIKE '^[\\x20\\x09-\\x0D]')), ''))"


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus: the columns of docs, one row per copy taken, range-sorted by training position. The copy at
    the border of a target ends after its last taken word (never with whole=True), and n_chars, if there is one, is renewed for it. Rows taken
    0 times (among them all without a word) are left out. Other columns are carried as they are, whatever their names."""
    sized = docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), order_key(F.col("text")).alias("key"), F.struct("*").alias("row"))
    p = plan_mix(sized, slice_digits=slice_digits_for(docs.count()), **settings)
    e = p.select(F.col("row").alias("line"), "size", F.explode(F.arrays_zip("copies", "due")).alias("one")).select("line", "size", "one.copies", "one.due").filter("copies > 0")
    part = F.col("copies") < F.col("size")
    e = e.withColumn("taken_text", F.when(part, F.expr(CUT)).otherwise(F.col("line.text")))
    new = {"text": F.col("taken_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(part, F.length("taken_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("line.n_chars"))
    out = e.repartitionByRange(shuffle_width(docs.sparkSession), "due").sortWithinPartitions("due")
    return out.select(*[new.get(c, F.col("line").getField(c)).alias(c) for c in docs.columns])


def op10_mixing(spark, sf_dir):
    """Contract query: one row per document with what the mix takes of it; position is its first copy's place."""
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", words_in(F.col("text")).alias("size"), order_key(F.col("text")).alias("key"), F.col("doc_id").alias("row"))
    sized = durable(sized, "mix-sizes")  # the one time that texts are read
    due = F.when(F.col("taken") > 0, F.round(F.element_at("due", 1), 9))
    return plan_mix(sized, slice_digits=slice_digits_for(sized.count())).select(F.col("row").alias("doc_id"), "size", "source_size", "target", "taken", due.alias("position"))


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ' ' || md5(coalesce(text, ''))) AS key, coalesce('=' || source, '') AS source_key FROM documents
), sources AS (
  SELECT source_key, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source_key
), dealt AS (
  SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
         [0.5, 1.0, 1.5][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS a,
         source_size::DOUBLE * 2.0 AS full_size FROM sources
), levels AS (
  SELECT *, row_number() OVER o AS n,
         ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(full_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM dealt WINDOW o AS (ORDER BY full_size / weight, source NULLS LAST)
), lam AS (
  SELECT n, level FROM levels WHERE level * weight <= full_size ORDER BY n LIMIT 1
), goals AS (
  SELECT source_key, source_size, a, least(full_size, CASE WHEN n < coalesce((SELECT n FROM lam), 1000000000) THEN full_size ELSE (SELECT level FROM lam) * weight END) AS target FROM levels
), placed AS (
  SELECT doc_id, size, source_size, target, a, round(target)::BIGINT AS goal,
         (sum(size) OVER (PARTITION BY source_key ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - size AS first
  FROM sized JOIN goals USING (source_key)
), mixed AS (
  SELECT *, greatest(0, least(size, goal - first)) + greatest(0, least(size, goal - source_size - first)) AS taken, (first + 1)::DOUBLE / greatest(goal, 1) AS x FROM placed
)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
       CASE WHEN taken > 0 THEN round(CASE WHEN a = 1.0 THEN x ELSE (sqrt(greatest(0.0, a * a + 4.0 * (1.0 - a) * x)) - a) / nullif(2.0 * (1.0 - a), 0.0) END, 9) END AS position
FROM mixed
"""
