"""Substring dedup with suffix automata (operator 2).

A word goes if it lies in `width` consecutive words that also stand in a document with a smaller doc_id.

Reference shards. The reference of a corpus that is deduplicated against itself is the corpus: its automata grow with the
rows, so they have no size bound to broadcast under, and every document streamed past every shard would be quadratic work.
Instead both sides are dealt by content. Every window of `width` words names as its anchor the least hash of its sequences
of GRAMS[0] words; equal windows name equal anchors, and a shard is all text around one anchor, in pieces of about 90
words. Anchors of one document only are dropped first, so what moves is text that may repeat.

Pieces are addressed by their content: a piece that an earlier document holds word for word is settled by the least
doc_id of its content, whatever the number of its copies, and only distinct contents enter a shard. They are streamed in
doc_id order through the shard's suffix automaton: matching statistics give the maximal spans of `width` words or more
that earlier contents hold, then the content itself is added. What was found for a content is joined back to its pieces,
one row a piece.

No shard is large. One with more than SHARD distinct contents (a passage in many surroundings, a family of near copies) is
dealt again in the same way, its contents taking the place of the documents and anchors being the least hashes of longer
sequences (GRAMS[1], ...). Surroundings that only one document has then fall into shards of their own and leave; what is
common becomes equal pieces. At the last length a sequence is a whole window, so a shard is one content. Nothing is left
out on the way, and a level costs a few rows for each content of the crowded shards only.

For a fixed bounded reference (a benchmark, say) cut_known() broadcasts one automaton and streams all documents past it.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import durable, give_back, table

WIDTH, GRAMS, SHARD = 50, (8, 32, 47, 50), 512
LAST = (1 << 63) - 1


class SuffixAutomaton:
    """All word sequences of the added passages. States are numbers; state 0 is the empty sequence."""

    def __init__(self) -> None:
        self.to: list[dict] = [{}]
        self.up = [-1]
        self.size = [0]
        self.end = 0

    def _append(self, word) -> None:
        to, up, size = self.to, self.up, self.size
        state, new = self.end, len(to)
        to.append({})
        size.append(size[state] + 1)
        up.append(0)
        while state >= 0 and word not in to[state]:
            to[state][word] = new
            state = up[state]
        if state >= 0:
            old = to[state][word]
            if size[old] == size[state] + 1:
                up[new] = old
            else:  # old stands for longer sequences too: split off the short ones
                twin = len(to)
                to.append(dict(to[old]))
                size.append(size[state] + 1)
                up.append(up[old])
                while state >= 0 and to[state].get(word) == old:
                    to[state][word] = twin
                    state = up[state]
                up[old] = up[new] = twin
        self.end = new

    def add(self, words: list) -> None:
        for w in words:
            self._append(w)
        self._append(len(self.to))  # a number is no word: sequences don't run on into the next passage

    def spans(self, words: list, width: int) -> list[tuple[int, int]]:
        """Maximal [start, end) of words, `width` or more long, that some passage holds."""
        to, up, size = self.to, self.up, self.size
        state = length = 0
        out: list[tuple[int, int]] = []
        for i, w in enumerate(words, 1):
            while state and w not in to[state]:
                state = up[state]
                length = size[state]
            if (next_state := to[state].get(w)) is None:
                length = 0
            else:
                state, length = next_state, length + 1
                if length >= width:
                    start = i - length
                    if out and start <= out[-1][0]:
                        out[-1] = (out[-1][0], i)
                    else:
                        out.append((start, i))
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def _rolling(h: np.ndarray, width: int, base: int) -> np.ndarray:
    """A hash of every `width` consecutive items, from prefix sums modulo 2^64 (base is odd, so it has an inverse)."""
    n = len(h)
    power = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)])
    back = np.cumprod(np.r_[np.uint64(1), np.full(n - width, pow(base, -1, 1 << 64), np.uint64)])
    total = np.r_[np.uint64(0), np.cumsum(h * power)]
    return _mixed((total[width:] - total[: n - width + 1]) * back)


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def anchors(h: np.ndarray, width: int, gram: int = GRAMS[0]) -> np.ndarray:
    """For every window of `width` words, the least hash of its sequences of `gram` words."""
    gram = min(gram, width)
    low = _rolling(h, gram, 0x9E3779B97F4A7C15)
    left, done = width - gram + 1, 1
    while done < left:
        step = min(done, left - done)
        low = np.minimum(low[:-step], low[step:])
        done += step
    return low


@arrow_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("fps", T.ArrayType(T.LongType()))]))
def _anchors_of(texts: pa.Array) -> pa.Array:
    counts, lists = [], []
    for t in texts.cast(pa.binary()):
        words = (t.as_py() or b"").split()
        counts.append(len(words))
        lists.append(np.unique(anchors(word_hashes(words), WIDTH)).view(np.int64) if len(words) >= WIDTH else ())
    give_back()
    return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["n", "fps"])


_anchors_of = _anchors_of.asNondeterministic()

PIECES = "ord long, u long, v long, start int, words int, fp long, c1 long, c2 long, content binary"
FOUND = "c1 long, c2 long, spans array<struct<s:int,e:int>>"


def _pieces(gram: int, most_windows: int = 512):
    """(ord, u, v, text, fps) to pieces: runs of windows with one anchor, `most_windows` at once. fps: the anchors that
    are wanted, null for all. c1 and c2 are a 128-bit hash of the content."""
    from xxhash import xxh3_128_digest

    names = ["ord", "u", "v", "start", "words", "fp", "c1", "c2", "content"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for order, u, v, text, fps in zip(*(batch[c] for c in ("ord", "u", "v", "text", "fps")), strict=True):
                order, u, v = order.as_py(), u.as_py(), v.as_py()
                words = text.as_buffer().to_pybytes().split()
                low = anchors(word_hashes(words), WIDTH, gram)
                shared = np.isin(low, fps.values.to_numpy().view(np.uint64)) if fps.is_valid else np.ones(len(low), bool)
                begins = np.nonzero(np.r_[True, low[1:] != low[:-1]])[0]
                ends = np.r_[begins[1:], len(low)]
                for i, j in zip(begins[shared[begins]].tolist(), ends[shared[begins]].tolist(), strict=True):
                    for k in range(i, j, most_windows):
                        own = words[k : min(j, k + most_windows) + WIDTH - 1]
                        content = b" ".join(own)
                        c1, c2 = struct.unpack("<qq", xxh3_128_digest(content))
                        rows.append((order, u, v, k, len(own), int(low[i].view(np.int64)), c1, c2, content))
                        held += len(content) + 200
                if held > 8_000_000:
                    yield out()
                    rows, held = [], 0
                    give_back()
        if rows:
            yield out()

    return cut


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct contents, sorted by (fp, ord), to the spans that contents of earlier documents hold."""
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
    fp = order = automaton = None
    known: list[list[bytes]] = []  # of earlier documents, not taught to the automaton yet
    waiting: list[list[bytes]] = []  # of the current document
    for batch in batches:
        a, b, spans = [], [], []
        for f, o, c1, c2, content in zip(*(batch[c].to_pylist() for c in ("fp", "ord", "c1", "c2", "content")), strict=True):
            if f != fp:
                fp, order, automaton, known, waiting = f, o, None, [], []
            elif o != order:
                order, known, waiting = o, known + waiting, []
            words = content.split()
            found = None
            if known or automaton:
                automaton = automaton or SuffixAutomaton()
                for w in known:
                    automaton.add(w)
                known = []
                if found := automaton.spans(words, WIDTH):
                    a.append(c1)
                    b.append(c2)
                    spans.append([{"s": s, "e": e} for s, e in found])
            if found != [(0, len(words))]:  # else the automaton knows all of it
                waiting.append(words)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(spans, kind)], ["c1", "c2", "spans"])


def _held_earlier(units: DataFrame, level: int = 0) -> DataFrame:
    """u, v, s, e: words [s, e) of a unit that stand in a unit of smaller ord. units: ord, u, v (its name), text, fps."""
    slim = ["ord", "u", "v", "start", "words", "c1", "c2"]
    pieces = durable(units.select("ord", "u", "v", F.col("text").cast("binary").alias("text"), "fps").mapInArrow(_pieces(GRAMS[level]), PIECES), f"pieces-{level}")
    # What is joined back to the rows that it was counted from is written first: only then is the join one between
    # exchanges, whose large partitions (a third of all rows may share a key) adaptive execution can split.
    contents = pieces.groupBy("c1", "c2").agg(F.min(F.struct("ord", "u", "v", "start")).alias("first"), F.max("ord").alias("last"), F.first("fp").alias("fp"))
    contents = durable(contents.select("c1", "c2", "first.*", "last", "fp"), f"contents-{level}")
    sizes = durable(contents.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), f"shards-{level}")
    named = contents.join(sizes, "fp").select("ord", "u", "v", "start", "n")
    texts = pieces.select("fp", "c1", "c2", "content", "ord", "u", "v", "start").join(named, ["ord", "u", "v", "start"])
    crowded = level + 1 < len(GRAMS) and not sizes.filter(F.col("n") > SHARD).isEmpty()
    if crowded:
        texts = durable(texts, f"texts-{level}")
    small = texts.filter(F.col("n") <= SHARD) if crowded else texts
    found = small.select("fp", "ord", "c1", "c2", "content").repartition("fp").sortWithinPartitions("fp", "ord").mapInArrow(_matched, FOUND)
    if crowded:
        again = texts.filter(F.col("n") > SHARD).select("ord", F.col("c1").alias("u"), F.col("c2").alias("v"), F.col("content").alias("text"), F.lit(None).cast("array<long>").alias("fps"))
        deeper = _held_earlier(again, level + 1).groupBy("u", "v").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
        found = found.union(deeper.select(F.col("u").alias("c1"), F.col("v").alias("c2"), "spans"))
    judged = contents.select("c1", "c2", F.col("ord").alias("lo"), "last").join(found, ["c1", "c2"], "left").filter("lo < last OR spans IS NOT NULL").drop("last")
    judged = durable(judged, f"judged-{level}")
    whole = F.array(F.struct(F.lit(0).alias("s"), F.col("words").alias("e")))
    back = pieces.select(*slim).join(judged, ["c1", "c2"]).select("u", "v", "start", F.when(F.col("ord") > F.col("lo"), whole).otherwise(F.col("spans")).alias("spans"))
    return back.select("u", "v", "start", F.explode("spans").alias("x")).select("u", "v", (F.col("start") + F.col("x.s")).alias("s"), (F.col("start") + F.col("x.e")).alias("e"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """ord, h, spans (array of s, e: words [s, e) that stand in an earlier document), rows without any left out."""
    order = F.coalesce("doc_id", F.lit(LAST)).alias("ord")
    h, h2 = F.xxhash64("text").alias("h"), F.hash("text", F.length("text")).alias("h2")
    found = durable(docs.filter(F.col("text").isNotNull()).select(order, h, h2, _anchors_of("text").alias("x")).select("ord", "h", "h2", "x.n", "x.fps").filter(F.col("n") >= WIDTH), "anchors")
    first = durable(found.groupBy("h", "h2").agg(F.min("ord").alias("first")), "first-copies")
    classed = found.join(first, ["h", "h2"])
    copies = classed.filter("ord > first").select("ord", "h", F.lit(0).alias("s"), F.col("n").cast("int").alias("e"))
    own = classed.filter("ord = first").select("ord", "h", F.explode("fps").alias("fp"))
    shared = durable(own.groupBy("fp").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).filter("lo < hi").select("fp"), "shared-anchors")
    wanted = own.join(shared, "fp").distinct().groupBy("ord", "h").agg(F.collect_list("fp").alias("fps"))
    units = docs.select(order, h, "text").join(wanted, ["ord", "h"]).select("ord", F.col("ord").alias("u"), F.col("h").alias("v"), "text", "fps")
    held = _held_earlier(units).select(F.col("u").alias("ord"), F.col("v").alias("h"), "s", "e")
    return held.union(copies).groupBy("ord", "h").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def kept_words(text: bytes, spans: list[tuple[int, int]]) -> tuple[list[bytes], int]:
    """The words outside the spans, and how many there were."""
    words = text.split()
    if not spans:
        return words, len(words)
    keep, at = [], 0
    for s, e in sorted(spans):
        keep += words[at:s] if s > at else []
        at = max(at, e)
    return keep + words[at:], len(words)


def _texts_and_spans(texts: pa.Array, spans: pa.Array):
    values = pa.StructArray.flatten(spans.values) if len(spans.values) else []
    s, e = (v.to_pylist() for v in values) if len(values) else ([], [])
    offsets = spans.offsets.to_pylist()
    for k, t in enumerate(texts.cast(pa.binary())):
        i, j = offsets[k], offsets[k + 1]
        yield t.as_py() or b"", list(zip(s[i:j], e[i:j], strict=True)) if spans[k].is_valid else []


@arrow_udf(T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]))
def _digest(texts: pa.Array, spans: pa.Array) -> pa.Array:
    rows = []
    for text, own in _texts_and_spans(texts, spans):
        keep, n = kept_words(text, own)
        rows.append((n, n - len(keep), hashlib.sha256(b" ".join(keep)).hexdigest()))
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.StructArray.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["n_words", "n_removed", "kept_sha256"])


@arrow_udf(T.StringType())
def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array([t if not own else b" ".join(kept_words(t, own)[0]) for t, own in _texts_and_spans(texts, spans)], pa.binary()).cast(pa.string())


def with_spans(docs: DataFrame) -> DataFrame:
    """row (the input's columns, a struct) and spans (null: none), one row per input row.

    Null text: no words. A null doc_id counts as larger than any other. Rows that repeat a doc_id never remove each
    other's words. Texts under 50 words keep everything. Empty input: empty output."""
    d = docs.select(F.struct("*").alias("row"), F.coalesce("doc_id", F.lit(LAST)).alias("ord"), F.xxhash64("text").alias("h"))
    return d.join(repeated_spans(docs), ["ord", "h"], "left").select("row", "spans")


def drop_repeated_passages(docs: DataFrame) -> DataFrame:
    """docs with the repeated words cut out of text (what stays is then joined by single spaces, and n_chars renewed);
    untouched texts and other columns as they were."""
    d = with_spans(docs).withColumn("new", F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(_cut("row.text", "spans")))
    new = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length("new").cast(docs.schema["n_chars"].dataType))
    return d.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def cut_known(docs: DataFrame, passages: DataFrame, width: int = WIDTH, most_words: int = 200_000) -> DataFrame:
    """docs without the words that lie in `width` consecutive words of the reference passages(text), by one broadcast
    automaton. The reference is refused above most_words words (about 60 MB of automaton)."""
    words = passages.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), r"\s+")))).first()[0] or 0
    if words > most_words:
        raise ValueError(f"the reference has {words} words, more than may be broadcast ({most_words})")
    automaton = SuffixAutomaton()
    for (text,) in passages.select("text").filter("text IS NOT NULL").collect():
        automaton.add(text.encode().split())
    sent = docs.sparkSession.sparkContext.broadcast((automaton.to, automaton.up, automaton.size))

    @arrow_udf(T.StringType())
    def cut(texts: pa.Array) -> pa.Array:
        a = SuffixAutomaton()
        a.to, a.up, a.size = sent.value
        out = []
        for t in texts.cast(pa.binary()):
            raw = t.as_py()
            spans = a.spans(raw.split(), width) if raw else []
            out.append(b" ".join(kept_words(raw, spans)[0]) if spans else raw)
        return pa.array(out, pa.binary()).cast(pa.string())

    return docs.withColumns({"text": cut("text")})


def op2_substring_dedup(spark, sf_dir):
    """Contract query: what stays of every document."""
    d = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select(F.col("row.doc_id").alias("doc_id"), _digest("row.text", "spans").alias("x")).select("doc_id", "x.*")
