"""Quality rules as a learned decision list (operator 9).

Text statistics come from one Arrow pass over the texts. A bounded sample of labelled rows teaches an ordered list of
rejection rules by sequential covering: a rule grows one threshold at a time by FOIL gain on two thirds of the sample,
loses conditions from its end while that helps on the last third, is kept if it is precise there, and what it covers is
taken out before the next one. The list is applied as one ordered Spark CASE expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import give_back, table, training_fold

#: Fixed by the data contract.
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
MIN_WORDS = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits")


def repeated_words(words: Sequence[bytes]) -> int:
    """Words that lie in a 3-word window found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) > n - 2:  # two equal windows share at least two repeated words
        return 0
    _, pairs = np.unique(ids[:-2] * len(seen) + ids[1:-1], return_inverse=True)
    _, at, times = np.unique(pairs.astype(np.int64) * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    twice = times[at] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def count_text(text: bytes) -> tuple[int, ...]:
    """COUNTS of one UTF-8 text; all zero for an empty one."""
    if not text:
        return (0,) * len(COUNTS)
    h = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    lines, earlier, dup = 0, set(), 0
    for line in text.split(b"\n"):
        if line.strip(SPACE):
            lines += 1
            dup += line in earlier
            earlier.add(line)
    chars = int(h.sum() - h[0x80:0xC0].sum() - h[list(SPACE)].sum())
    return (len(words), chars, int(h[list(SYMBOLS)].sum()), dup, repeated_words(words), lines, int(h[65:91].sum()), int(h[list(b"!?")].sum()), int(h[48:58].sum()))


@arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def text_counts(texts: pa.Array) -> pa.Array:
    rows = [count_text(t.as_py() or b"") for t in texts.cast(pa.binary())]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(COUNTS)
    give_back()
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(COUNTS))


text_counts = text_counts.asNondeterministic()  # once a row, never repeated by a pushed-down filter


def features(counts: str) -> dict[str, Column]:
    """What the rules may test, over a column of counts; a share of nothing is 0."""
    c = lambda name: F.col(f"{counts}.{name}").cast("double")
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    return {
        "words": c("n_words"),
        "mean_word": share(c("word_chars"), c("n_words")),
        "symbols_per_word": share(c("n_symbols"), c("n_words")),
        "repeat_share": share(c("n_repeat_words"), c("n_words")),
        "dup_line_share": share(c("n_dup_lines"), c("n_lines")),
        "upper_share": share(c("n_upper"), c("word_chars")),
        "marks_per_word": share(c("n_marks"), c("n_words")),
        "digit_share": share(c("n_digits"), c("word_chars")),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray, names: Sequence[str]) -> np.ndarray:
        v = x[:, names.index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self, of: dict[str, Column]) -> Column:
        c = of[self.feature]
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _covered(rule: Sequence[Condition], x: np.ndarray, names: Sequence[str]) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(x, names) for c in rule), np.ones(len(x), bool))


def _grow(x: np.ndarray, bad: np.ndarray, names: Sequence[str], cuts: int, most: int) -> list[Condition]:
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < most:
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p or not n:
            break
        best, gain = None, 1e-9
        for j, name in enumerate(names):
            for t in np.unique(np.quantile(x[inside, j], np.linspace(0.01, 0.99, cuts), method="lower")):
                if t >= x[inside, j].max():
                    continue
                over = inside & (x[:, j] > t)
                for above, kept in ((True, over), (False, inside & ~over)):
                    q, m = int((kept & bad).sum()), int((kept & ~bad).sum())
                    if q and (g := q * (np.log2(q / (q + m)) - np.log2(p / (p + n)))) > gain:
                        best, gain = Condition(name, above, float((t + x[over, j].min()) / 2)), g  # between the two values
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x, names)
    return rule


def learn(x: np.ndarray, bad: np.ndarray, names: Sequence[str], max_rules: int = 12, max_conditions: int = 4, cuts: int = 40, min_precision: float = 0.9, min_covered: int = 3) -> list[Rule]:
    """The ordered rules; none if nothing bad can be told apart. Rows decide by their order which third they are in."""
    names = list(names)
    prune = np.arange(len(x)) % 3 == 2
    left, rules = np.ones(len(x), bool), []
    while len(rules) < max_rules and (left & ~prune & bad).sum() >= min_covered:
        grow, test = left & ~prune, left & prune
        rule = _grow(x[grow], bad[grow], names, cuts, max_conditions)

        def worth(r: Sequence[Condition], test=test) -> tuple[float, int]:
            got = _covered(r, x[test], names)
            p, n = int((got & bad[test]).sum()), int((got & ~bad[test]).sum())
            return ((p - n) / (p + n) if p + n else -1.0, p)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        got = left & _covered(rule, x, names)
        p, n = int((got & bad).sum()), int((got & ~bad).sum())
        if not rule or p < min_covered or p < min_precision * (p + n) or worth(rule)[0] < 2 * min_precision - 1:
            break
        rules.append(tuple(rule))
        left &= ~got
    return rules


def rejects(rules: Sequence[Rule], of: dict[str, Column]) -> Column:
    """The decision list as one ordered conditional: the number of the first rule that fires, null if none does."""
    out = F.lit(None).cast("int")
    for k in range(len(rules), 0, -1):
        out = F.when(reduce(lambda a, b: a & b, (c.column(of) for c in rules[k - 1])), F.lit(k)).otherwise(out)
    return out


def base_failed(counts: str) -> Column:
    """Fixed by the data contract: too short, or over half of the words in repeated windows."""
    return (F.col(f"{counts}.n_words") < MIN_WORDS) | (F.col(f"{counts}.n_repeat_words") * 100 > F.col(f"{counts}.n_words") * 50)


def learn_rules(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, **settings) -> list[Rule]:
    """Rules from about max_rows labelled documents (null labels or ids aside), chosen by hash among the training fold, and
    twice as many at most, whatever ids repeat. Only their statistics reach the driver. Rows that fail the base rules teach nothing."""
    known = labels.filter(F.col("quality").isNotNull() & training_fold(F.col("doc_id"))).select(F.col("doc_id").alias("labelled"), (F.col("quality") == 0).alias("bad"))
    n = known.count()
    part = F.pmod(F.xxhash64("labelled"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_rows / max(n, 1)))
    texts = docs.select("doc_id", "text").join(known.filter(part), F.col("doc_id") == F.col("labelled"))
    of = features("counts")
    counted = texts.select("doc_id", "bad", text_counts("text").alias("counts")).filter(~base_failed("counts"))
    counted = counted.select("doc_id", "bad", *[c.alias(k) for k, c in of.items()]).orderBy(F.xxhash64("doc_id"), "doc_id", *of, "bad").limit(2 * max_rows)
    got = counted.toPandas().sort_values(["doc_id", *of], kind="stable")
    got = got.iloc[np.argsort(got["doc_id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable")] if len(got) else got
    return learn(got[list(of)].to_numpy(float), got["bad"].to_numpy(bool), list(of), **settings)


def judge(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """row (the input's columns, a struct), counts, base_failed, rule (null: none fired), kept. One row per input row.

    A null or empty text has no words and fails the base rules. Nothing is joined, so repeated rows, null ids and
    extra columns pass through as they are; an empty table gives an empty one."""
    d = docs.select(F.struct("*").alias("row"), text_counts("text").alias("counts"))
    d = d.withColumn("base_failed", base_failed("counts")).withColumn("rule", rejects(rules, features("counts")))
    return d.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """docs without the rejected rows, columns as they were."""
    return judge(docs, rules).filter("kept").select("row.*")


def op9_quality_rules(spark, sf_dir):
    """Contract query: counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn_rules(docs, table(spark, sf_dir, "labels"))
    d = docs.select("doc_id", text_counts("text").alias("counts"))
    out = d.select("doc_id", *[F.col(f"counts.{c}").alias(c) for c in COUNTS[:5]], base_failed("counts").alias("base_failed"), rejects(rules, features("counts")).alias("rule"))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
