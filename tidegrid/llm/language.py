"""Language identification with a linear-chain conditional random field (operator 3).

Every word of a text gets a distribution over languages by forward-backward, so code-switched text is labelled word by
word; a document's language is the one with the largest share of its words. Word scores come from hashed affixes,
character n-grams and lexicon hits; the transition weights are learned with them.

Training uses a bounded sample of labelled documents (a stretch of each, of bounded length), the same number of each
language, partly cut up and joined across languages so that switches are seen. Fitting is full-batch on the driver;
prediction is one Arrow pass over all texts with the weights broadcast (bounded by buckets x languages).

Forward and backward run over all documents of a batch as one chain in which a document's first word forgets what came
before; the chain is cut into blocks whose transfer matrices are multiplied side by side, so the Python loop is as long
as a block, not as a text.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import table, training_fold, worker_memory

LETTERS = r"[^\W\d_]+"
BUCKETS = 1 << 17
UNKNOWN = "und"
BLOCK = 96
#: Words whose scores a worker remembers (about 100 MB), and bytes of scores at most; a full memory is emptied.
REMEMBERED, REMEMBERED_BYTES = 500_000, 64_000_000


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters."""
    return [w for w in re.findall(LETTERS, text.lower()) if w.isalpha() or any(map(str.isalpha, w))] if text else []


def feature_ids(word: str, lexicon: dict[str, int]) -> list[int]:
    """Buckets of a word's affixes (1 to 3), n-grams (2 and 3, with its ends) and the whole word; last its lexicon."""
    w = f"^{word}$"
    names = [f"p{word[:k]}" for k in (1, 2, 3)] + [f"s{word[-k:]}" for k in (1, 2, 3)]
    names += [w[i : i + 2] for i in range(len(w) - 1)] + [w[i : i + 3] for i in range(len(w) - 2)]
    names.append(w)
    out = [zlib.crc32(x.encode()) % BUCKETS for x in names]
    if word in lexicon:
        out.append(BUCKETS + lexicon[word])
    return out


@dataclass
class Crf:
    langs: list[str]
    weights: np.ndarray  # (BUCKETS + languages, languages)
    transitions: np.ndarray  # log weights, from row to column
    first: np.ndarray  # log weights of a text's first word
    lexicon: dict[str, int]
    memory: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None
    used: int = 0

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(words, languages) for distinct words, from memory where known."""
        new = [w for w in words if w not in self.memory]
        if self.scores is None or self.used + len(new) > len(self.scores):
            self.memory.clear()
            self.used, new = 0, words
            most = min(REMEMBERED, REMEMBERED_BYTES // (4 * len(self.langs)))
            self.scores = np.zeros((max(most, len(words)), len(self.langs)), np.float32)
        if new:
            lists = [feature_ids(w, self.lexicon) for w in new]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.fromiter((x for xs in lists for x in xs), np.int64, int(sizes.sum()))
            self.scores[self.used : self.used + len(new)] = np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes)
            self.memory.update(zip(new, range(self.used, self.used + len(new)), strict=True))
            self.used += len(new)
        return self.scores[[self.memory[w] for w in words]]


def forward_backward(emit: np.ndarray, starts: np.ndarray, transitions: np.ndarray, first: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised alpha, beta (before the word's own emission is added again) and word marginals of a chain.

    emit (n, L) log scores; starts (n) true where a text begins. Blocks of the chain go side by side."""
    n, k = emit.shape
    blocks = -(-n // block)
    e = np.exp(emit - emit.max(axis=1, keepdims=True))
    e = np.vstack([e, np.ones((blocks * block - n, k))]).reshape(blocks, block, k)
    s = np.r_[starts, np.ones(blocks * block - n, bool)].reshape(blocks, block)
    move, begin = np.exp(transitions - transitions.max()), np.exp(first - first.max())

    def forward(p: np.ndarray, t: int) -> np.ndarray:  # (blocks, ..., k): one step on
        new = p @ move
        at = s[:, t]
        if at.any():
            new[at] = p[at].sum(axis=-1, keepdims=True) * begin
        new *= e[:, t].reshape(blocks, *[1] * (p.ndim - 2), k)
        return new / new.sum(axis=tuple(range(1, p.ndim)), keepdims=True)

    through = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for t in range(block):
        through = forward(through, t)
    into, out = np.empty((blocks, k)), np.empty((blocks, k))
    a = np.ones(k) / k
    for b in range(blocks):
        into[b] = a
        a = a @ through[b]
        a /= a.sum()
    z = np.ones(k)
    for b in range(blocks - 1, -1, -1):
        out[b] = z
        z = through[b] @ z
        z /= z.sum()
    alpha, beta = np.empty((block, blocks, k)), np.empty((block, blocks, k))
    p = into
    for t in range(block):
        p = forward(p, t)
        alpha[t] = p
    q = out
    for t in range(block - 1, -1, -1):
        beta[t] = q
        w = e[:, t] * q
        q = w @ move.T
        at = s[:, t]
        if at.any():
            q[at] = (w[at] @ begin)[:, None]
        q = q / q.sum(axis=1, keepdims=True)
    alpha, beta = (x.transpose(1, 0, 2).reshape(-1, k)[:n] for x in (alpha, beta))
    both = alpha * beta
    return alpha, beta, both / both.sum(axis=1, keepdims=True)


def fit(sequences: list[list[tuple[str, int]]], langs: list[str], rounds: int = 60, rate: float = 0.25, decay: float = 1e-5, lexicon_words: int = 5000) -> Crf:
    """A CRF from sequences of (word, language number), by full-batch adaptive gradient ascent of the likelihood."""
    k = len(langs)
    words = [w for seq in sequences for w, _ in seq]
    gold = np.array([y for seq in sequences for _, y in seq], np.int64)
    starts = np.zeros(len(words), bool)
    starts[np.cumsum([0, *map(len, sequences)])[:-1]] = True
    vocabulary: dict[str, int] = {}
    at = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int64)
    seen = np.zeros((len(vocabulary), k))
    np.add.at(seen, (at, gold), 1)
    total = seen.sum(axis=1)
    typical = np.nonzero((total >= 3) & (seen.max(axis=1) >= 0.8 * total))[0]
    names = list(vocabulary)
    typical = typical[np.lexsort((typical, -total[typical]))][:lexicon_words]
    lexicon = {names[i]: int(seen[i].argmax()) for i in typical}
    lists = [feature_ids(w, lexicon) for w in names]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.concatenate([np.array(x, np.int64) for x in lists])
    begins, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(lists)), sizes)
    buckets = BUCKETS + k
    used, where = np.unique(flat, return_inverse=True)
    w, wg = np.zeros((len(used), k)), np.full((len(used), k), 1e-6)
    move, mg = np.zeros((k, k)), np.full((k, k), 1e-6)
    first, fg = np.zeros(k), np.full(k, 1e-6)
    onehot = np.eye(k)[gold]
    prior, inner = np.nonzero(~starts)[0] - 1, np.nonzero(~starts)[0]
    gold_moves = np.zeros((k, k))
    np.add.at(gold_moves, (gold[prior], gold[inner]), 1)
    n = len(words)
    for _ in range(rounds):
        emit = np.add.reduceat(w[where], begins)[at]
        alpha, beta, marginal = forward_backward(emit, starts, move, first)
        pair = alpha[prior][:, :, None] * np.exp(move - move.max()) * (np.exp(emit[inner] - emit[inner].max(axis=1, keepdims=True)) * beta[inner])[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        miss = onehot - marginal
        by_word = np.stack([np.bincount(at, miss[:, j], len(names)) for j in range(k)], axis=1)
        by_feature = np.stack([np.bincount(where, by_word[owner, j], len(used)) for j in range(k)], axis=1)
        for value, slope, past in ((w, by_feature / n - decay * w, wg), (move, (gold_moves - pair.sum(axis=0)) / n - decay * move, mg), (first, miss[starts].sum(axis=0) / n - decay * first, fg)):
            past += slope**2
            value += rate * slope / np.sqrt(past)
    weights = np.zeros((buckets, k), np.float32)
    weights[used] = w
    return Crf(list(langs), weights, move, first, lexicon)


def training_sequences(rows: list[tuple[int, list[str]]], seed: int = 7) -> list[list[tuple[str, int]]]:
    """Whole stretches, and as many again made of pieces of 4 to 40 words from several of them."""
    rng = np.random.default_rng(seed)
    whole = [[(w, y) for w in words] for y, words in rows if words]
    mixed = []
    for _ in range(len(whole) // 2):
        seq: list[tuple[str, int]] = []
        for i in rng.integers(0, len(whole), rng.integers(2, 5)):
            a, size = int(rng.integers(0, len(whole[i]))), int(rng.integers(4, 41))
            seq += whole[i][a : a + size]
        mixed.append(seq)
    return whole + mixed


def train(docs: DataFrame, max_docs: int = 1200, stretch: int = 100, max_langs: int = 200) -> Crf | None:
    """A CRF from docs(doc_id, text, lang): about max_docs / languages documents of each language in the training fold,
    chosen by hash, `stretch` words of each; twice max_docs rows and one a language at most, whatever ids repeat. None if
    there is nothing to learn from; more than max_langs languages are an error, none is left out (the weights, 0.5 MB a
    language, are broadcast)."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & training_fold(F.col("doc_id"))).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs + 1).collect()}
    if len(counts) > max_langs:
        raise ValueError(f"more than max_langs = {max_langs} languages in the training fold")
    if not counts:
        return None
    langs, each = sorted(counts), max(1, max_docs // len(counts))
    part = F.lit(0)
    for lang in langs:
        part = F.when(F.col("lang") == lang, int(1_000_000 * min(1.0, each / counts[lang])) + 1).otherwise(part)
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part)
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    spread = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.size("w") - stretch, F.lit(1))).cast("int") + 1
    rows = chosen.select("doc_id", "lang", w.alias("w")).select("doc_id", "lang", F.slice("w", spread, F.lit(stretch)).alias("w"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "w").limit(2 * max_docs + len(langs)).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], r["w"]))
    return fit(training_sequences([(langs.index(r["lang"]), r["w"]) for r in rows]), langs)


def label_words(model: Crf, texts: list[str | None]) -> tuple[list[list[str]], list[np.ndarray]]:
    """The words of each text and their marginals over model.langs."""
    lists = [words_of(t) for t in texts]
    flat = [w for ws in lists for w in ws]
    if not flat:
        return lists, [np.zeros((0, len(model.langs)))] * len(lists)
    coded = pa.array(flat, pa.string()).dictionary_encode()
    emit = model.word_scores(coded.dictionary.to_pylist())[coded.indices.to_numpy()].astype(np.float64)
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    ends = np.cumsum(sizes)
    starts = np.zeros(len(flat), bool)
    starts[(ends - sizes)[sizes > 0]] = True
    marginal = forward_backward(emit, starts, model.transitions, model.first)[2]
    return lists, np.split(marginal, ends[:-1])


def predict(docs: DataFrame, model: Crf | None) -> DataFrame:
    """docs + lang_pred, score (in place of columns of these names). `und` with score 0 for a null text, one without a letter, or without a model; of equal
    shares the first language by name wins. Long texts are read whole."""
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.weights, model.transitions, model.first, model.lexicon) if model else None)

    @arrow_udf(kind)
    def guess(texts: pa.Array) -> pa.Array:
        if sent.value is None:
            return pa.StructArray.from_arrays([pa.array([UNKNOWN] * len(texts)), pa.array([0.0] * len(texts))], ["lang_pred", "score"])
        kept = worker_memory().setdefault("language_models", {})  # with its memory of words it outlives a task
        if sent._path not in kept:
            kept.clear()
            kept[sent._path] = Crf(*sent.value)
        m = kept[sent._path]
        langs, scores = [], []
        for k in range(0, len(texts), 512):
            for marginal in label_words(m, texts[k : k + 512].to_pylist())[1]:
                if len(marginal):
                    share = marginal.mean(axis=0)
                    best = int(share.argmax())
                    langs.append(m.langs[best])
                    scores.append(min(1.0, float(share[best])))
                else:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    d = docs.select(F.struct("*").alias("row"), guess.asNondeterministic()("text").alias("guess"))
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("lang_pred", "score")]
    return d.select(*own, "guess.lang_pred", "guess.score")


def op3_language(spark, sf_dir):
    """Contract query: the language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs)
    held_out = F.coalesce(~training_fold(F.col("doc_id")), F.lit(False)).alias("held_out")
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out, "lang_pred", "score")
