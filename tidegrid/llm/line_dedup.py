"""Line dedup by winnowing over line hashes (operator 8). DataFrame expressions only.

A line counts if it has a word. A run is `min_run` or more consecutive such lines; a run that stands earlier too, in a
document with a smaller doc_id or further up in the same one, is deleted. Blank lines neither count nor break a run; they
go with the line before them.

Winnowing: of every window of `min_run` line hashes the least (the first of equal ones) is selected as a fingerprint, so
two equal runs are guaranteed to select the same fingerprints at the same places, and about 2 lines in `min_run` + 1 are
selected. A selected place is one row: its fingerprint, how many lines it reaches to the left (they have greater hashes)
and to the right (no smaller ones), and the hashes of those lines. Fingerprints of one place only end there; the others
are joined back to their places. From there matches extend both ways, as far as the fingerprint reaches: the neighbouring
hashes of each `min_run` lines around the place are compared, all in one grouping, so that neither pairs of places nor a
common line's places meet in one task. What is later than the first of its kind is deleted, and overlapping matches of
neighbouring fingerprints join into maximal runs. First places are map-side combined minima, so a line, passage or copied
document may hold any part of all rows.

With `min_words`, a run of fewer lines is deleted too where it has that many words: places are then also selected by
windows of one and more such lines, below `min_run`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, durable, table

MIN_RUN = 3
HAS_WORD = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _reach(hashes: Column, k: Column, step: int, most: int) -> Column:
    """How many lines a fingerprint at k reaches in a direction: those before it have greater hashes, those after it no
    smaller ones; `most` at most."""
    h, out = F.get(hashes, k), F.lit(most)
    for d in range(most, 0, -1):
        other = F.get(hashes, k + step * d)  # null outside the text
        out = F.when(other > h if step < 0 else other >= h, out).otherwise(d - 1)
    return out


def _windows(min_run: int, min_words: int | None) -> list[tuple[int, int]]:
    """(lines, how many of them stand before the fingerprint) of all windows that may select a line."""
    sizes = [min_run] if min_words is None else range(1, min_run + 1)
    return [(size, before) for size in sizes for before in range(size)]


def _holds(one: Column, size: int, before: int, min_run: int, min_words: int | None) -> Column:
    """Whether the place selects for a window. one: left, right, near (lines from the left reach to one past the right)."""
    fits = (one["left"] >= before) & (one["right"] >= size - 1 - before)
    if size == min_run:
        return fits
    lines = F.slice(one["near"], one["left"] - before + 1, F.lit(size))
    return fits & (F.when(fits, F.aggregate(lines, F.lit(0), lambda n, x: n + x["words"])).otherwise(0) >= min_words)


def _selected(lines: Column, min_run: int, min_words: int | None) -> Column:
    """Per selected place: fp, place, left, right, near."""
    words = lambda x: [] if min_words is None else [F.regexp_count(x, F.lit(WORD)).alias("words")]
    line = lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("h"), *words(x))
    solid = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(HAS_WORD), line(x, i))), lambda s: s.isNotNull())

    def places(s: Column, hashes: Column) -> Column:
        def reached(k: Column) -> Column:
            return F.struct(k.alias("k"), _reach(hashes, k, -1, min_run - 1).alias("left"), _reach(hashes, k, 1, min_run - 1).alias("right"))

        def place(r: Column) -> Column:
            near = F.slice(s, r["k"] - r["left"] + 1, r["left"] + r["right"] + 2)
            return F.struct(F.get(hashes, r["k"]).alias("fp"), F.get(s, r["k"])["i"].alias("place"), r["left"].alias("left"), r["right"].alias("right"), near.alias("near"))

        every = F.transform(F.sequence(F.lit(0), F.size(s) - 1), reached)
        if min_words is None:  # the others are selected by no window
            every = F.filter(every, lambda r: r["left"] + r["right"] >= min_run - 1)
        out = F.transform(every, place)
        if min_words is not None:
            out = F.filter(out, lambda o: reduce(lambda a, b: a | b, (_holds(o, size, before, min_run, min_words) for size, before in _windows(min_run, min_words))))
        return F.when(F.size(s) > 0, out)

    # bound once each, then used by name
    return F.transform(F.array(solid), lambda s: F.transform(F.array(F.transform(s, lambda x: x["h"])), lambda hashes: places(s, hashes))[0])[0]


def fingerprints(docs: DataFrame, min_run: int = MIN_RUN, min_words: int | None = None) -> DataFrame:
    """One row a selected place: ord, h (which row of docs), n (its lines), fp, place, left, right, near."""
    d = docs.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("ord"), F.xxhash64("text").alias("h"), _lines(F.col("text")).alias("lines"))
    return d.select("ord", "h", F.size("lines").alias("n"), F.explode(_selected(F.col("lines"), min_run, min_words)).alias("one")).select("ord", "h", "n", "one.*")


def _extended(found: DataFrame, min_run: int, min_words: int | None) -> DataFrame:
    """ord, h, a, b (hashes of the lines), lo, hi: every window that a place selects for, from its first line to the next
    line that counts."""

    def window(size: int, before: int) -> Column:
        one = {c: F.col(c) for c in ("left", "right", "near")}
        at = F.col("left") - before
        hashes = F.transform(F.slice("near", at + 1, F.lit(size)), lambda x: x["h"])
        made = F.struct(F.xxhash64(hashes).alias("a"), F.hash(hashes).alias("b"), F.get("near", at)["i"].alias("lo"), F.coalesce(F.get("near", at + size)["i"], F.col("n")).alias("hi"))
        return F.when(_holds(one, size, before, min_run, min_words), made)

    windows = F.filter(F.array(*[window(size, before) for size, before in _windows(min_run, min_words)]), lambda w: w.isNotNull())
    return found.select("ord", "h", F.explode(windows).alias("w")).select("ord", "h", "w.*")


def later_runs(docs: DataFrame, min_run: int = MIN_RUN, min_words: int | None = None) -> DataFrame:
    """ord, h, runs: sorted array of (lo, hi), the lines [lo, hi) to delete; only rows with any."""
    found = durable(fingerprints(docs, min_run, min_words), "winnow-positions")
    places = found.groupBy("fp").agg(F.count(F.lit(1)).alias("places")).filter("places > 1")
    # Counts are written before they are joined back to their rows: only a join between exchanges can have its large
    # partitions split, and a third of all rows may share a line.
    places = durable(places, "winnow-places")
    hit = durable(_extended(found.join(places, "fp"), min_run, min_words), "winnow-matches")
    first = hit.groupBy("a", "b").agg(F.min(F.struct("ord", "lo")).alias("first"), F.max(F.struct("ord", "lo")).alias("last")).filter("first != last").drop("last")
    first = durable(first, "winnow-first")
    later = hit.join(first, ["a", "b"]).filter(F.struct("ord", "lo") > F.col("first")).select("ord", "h", "lo", "hi").distinct()
    by_row = W.partitionBy("ord", "h").orderBy("lo", "hi")
    so_far = by_row.rowsBetween(W.unboundedPreceding, -1)  # windows of several sizes: an earlier one may reach further
    opens = F.when(F.max("hi").over(so_far) >= F.col("lo"), 0).otherwise(1)
    merged = later.withColumn("opens", opens).withColumn("run", F.sum("opens").over(by_row)).groupBy("ord", "h", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return merged.groupBy("ord", "h").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("runs"))


def _kept(lines: Column, runs: Column) -> Column:
    """The lines outside the runs: slices between them."""
    start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.try_element_at(runs, k)["hi"])
    end = lambda k: F.coalesce(F.try_element_at(runs, k + 1)["lo"], F.size(lines))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), lambda k: F.slice(lines, start(k) + 1, end(k) - start(k))))


def mark(docs: DataFrame, min_run: int = MIN_RUN, min_words: int | None = None) -> DataFrame:
    """row (the input's columns, a struct), n_lines, n_removed, kept (the text that stays). One row per input row.

    Null text: no lines, kept null. A null doc_id counts as later than any other. Rows that repeat a doc_id never make
    each other later at equal places, so equal rows get equal results. Empty input: empty output."""
    d = docs.select(F.struct("*").alias("row"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("ord"), F.xxhash64("text").alias("h"))
    d = d.join(later_runs(docs, min_run, min_words), ["ord", "h"], "left")
    lines, runs = _lines(F.col("row.text")), F.col("runs")
    kept = F.when(runs.isNull(), F.col("row.text")).otherwise(F.array_join(_kept(lines, runs), "\n"))
    removed = F.coalesce(F.aggregate("runs", F.lit(0), lambda s, r: s + r["hi"] - r["lo"]), F.lit(0))
    return d.select("row", F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), kept.alias("kept"))


def drop_repeated_lines(docs: DataFrame, min_run: int = MIN_RUN, min_words: int | None = None) -> DataFrame:
    """docs with the later runs cut out of text (and n_chars, if there, renewed); other columns as they were."""
    m = mark(docs, min_run, min_words)
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return m.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op8_line_dedup(spark, sf_dir):
    """Whole documents: lines, lines deleted, and the SHA-256 of the text that stays."""
    m = mark(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return m.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, l[i] AS line, regexp_matches(l[i], '[^\x20\x09-\x0D]') AS solid
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS u(i)
), solids AS (
  SELECT doc_id, i, row_number() OVER d AS n, line || chr(10) || lead(line, 1) OVER d || chr(10) || lead(line, 2) OVER d AS content
  FROM lines WHERE solid WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), ranked AS (
  SELECT doc_id, i, n, content IS NOT NULL AND row_number() OVER (PARTITION BY content ORDER BY doc_id, n) > 1 AS later FROM solids
), covered AS (
  SELECT doc_id, i, bool_or(later) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS gone FROM ranked
), judged AS (
  SELECT l.doc_id, l.i, l.line, coalesce(last_value(c.gone IGNORE NULLS) OVER (PARTITION BY l.doc_id ORDER BY l.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS gone
  FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.i = c.i
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone) AS text FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
