import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.oracle import DATA
from tidegrid.llm import packing, tokens, wavelet
from tidegrid.llm.common import table

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def reference(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_same_ids(path, monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_BYTES", 3000)
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    rng = random.Random(1)
    alphabet = [" ", " ", "  ", "\n", "a", "é", "\t", "x!", "<|endoftext|>", "12", "́", "'s", "'S", " ", "Σ", "。", "b c", "日本", "😀", "ﬁ", "İ", "\x00", "\x85", "word"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + ["", " ", " a", "a ", "x" * 500 + " y", None, "long " * 5000]
    e, encode = tokens.Encoder(tokens.load(path)), reference(path)
    assert e.rule != "whole"
    column = pa.array(["cut off", *texts])[1:]  # with an offset
    for _ in range(2):
        ids, ends = e.ids(column)
        assert all(ids[i:j].tolist() == encode(t) for t, i, j in zip(texts, ends, ends[1:], strict=False)) and len(ends) == len(texts) + 1
    ids, ends = e.ids(column[:0])
    assert len(ids) == 0 and ends.tolist() == [0]
    e.rule = "whole"
    ids, ends = e.ids(pa.array(["a b", None, "c"]))
    assert ids.tolist() == encode("a b") + encode("c") and ends.tolist()[1] == ends.tolist()[2]


def test_nnls():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a, b = rng.random((8, 6)), rng.normal(size=8)
        x = packing.nnls(a, b)
        slope = a.T @ (a @ x - b)
        assert (x >= 0).all() and (slope > -1e-6).all() and np.abs(slope * x).max() < 1e-6


@pytest.mark.parametrize("name", ["mixed", "large", "small", "one", "few", "none", "full"])
def test_plan(name):
    rng = np.random.default_rng(3)
    lengths = {"mixed": np.minimum(2048, rng.lognormal(6.5, 0.8, 30_000).astype(int) + 1), "large": rng.integers(900, 2049, 5000), "small": rng.integers(1, 300, 5000), "one": [5], "few": [1024, 1024, 2048, 2047, 1, 700, 700, 648], "none": [], "full": [2048] * 9}[name]
    counts = np.bincount(np.array(lengths, int), minlength=2049)
    groups = packing.plan(counts)
    total = np.zeros(2049, int)
    for content, repeats in groups:
        assert sum(content) <= 2048 and repeats > 0
        for n in content:
            total[n] += repeats
    assert (total == counts).all()
    # no worse than the bound from all ids, and from pieces that cannot share, by more than one in a hundred
    bound = max(-(-int((counts * np.arange(2049)).sum()) // 2048), int(counts[1025:].sum()))
    assert sum(r for _, r in groups) <= bound * 1.01 + 1


def check_packing(rows, texts, encode, capacity=2048):
    pieces = {}
    for d, t in texts:
        ids = np.array([*encode(t), 0], "<u4")
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            pieces.setdefault((d, k // capacity, k, len(part), zlib.crc32(part.tobytes())), []).append(1)
    got, sequences = {}, {}
    for r in rows:
        got.setdefault((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]), []).append(1)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == pieces
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_whole_table(spark):
    texts = [(r["doc_id"], r["text"]) for r in table(spark, DATA, "documents").collect()]
    n = check_packing(packing.op5_packing(spark, DATA).collect(), texts, reference(WORDS))
    total = sum(len(reference(WORDS)(t)) + 1 for _, t in texts)
    assert n <= 1.03 * -(-total // 2048) + 1


def test_packing_edges(documents):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "word " * 9000), (4, "same"), (4, "same"), (5, "q" * 20_000)]
    check_packing(packing.pack_documents(documents(rows), WORDS).collect(), rows, reference(WORDS))
    assert packing.pack_documents(documents(rows[:0]), WORDS).count() == 0


def test_ranks_in_many_slices(spark):
    d = spark.createDataFrame([(i, 0, 0, 700 + i % 3, i) for i in range(900)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(d, rank_rows=5).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 900 and len({r["sequence_id"] for r in rows}) == 450


@pytest.mark.parametrize("n,v", [(0, 5), (1, 1), (5000, 300), (20_000, 60_000), (3000, 2), (1000, 1 << 17), (512, 9), (4096, 40)])
def test_wavelet(n, v):
    rng = np.random.default_rng(n + v)
    ids = np.minimum(v - 1, rng.geometric(0.02, n) if v > 300 else rng.integers(0, v, n)).astype(np.uint32)
    shard = wavelet.read_shard(wavelet.build(ids, [3, None], np.array([0, n // 3, n]), 4, 9))
    assert (shard.decode() == ids).all() and shard.doc_ids.tolist() == [3, 0] and shard.no_id.tolist() == [False, True]
    assert (shard.part, shard.seq) == (4, 9) and (shard.document(1, 100) == ids[n // 3 :]).all()
    for i in rng.integers(0, max(n, 1), 20):
        if n:
            assert shard.access(int(i)) == ids[i]
    for t in [*map(int, rng.integers(0, v, 8)), *map(int, ids[:4]), v + 70_000]:
        a, b = sorted(map(int, rng.integers(0, n + 1, 2)))
        assert shard.count(t) == (ids == t).sum() and shard.count(t, a, b) == (ids[a:b] == t).sum()
        if n < 6000:
            assert shard.occurrences(t) == np.nonzero(ids == t)[0].tolist()
    assert (shard.document(0) == ids[: n // 3]).all()
    with pytest.raises(IndexError):
        shard.access(n)
    with pytest.raises(IndexError):
        shard.select(v + 70_000, 0)
    with pytest.raises(ValueError):
        wavelet.read_shard(b"?" * 200)


def records(docs, shard_tokens=1 << 21):
    path = wavelet.write_shards(docs, BYTES, shard_tokens=shard_tokens)
    return [tuple(r) for r in wavelet.read_documents(docs.sparkSession, path).orderBy("start").collect()]


def test_shards(spark, documents):
    encode, at, want = reference(BYTES), 0, []
    for r in table(spark, DATA, "documents").orderBy("doc_id").collect():
        ids = np.array([*encode(r["text"]), 0], "<u4")
        want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert records(table(spark, DATA, "documents"), 9000) == want
    assert sorted(map(tuple, wavelet.op6_wavelet(spark, DATA).collect())) == want
    rows = [(2, "b c"), (1, None), (None, "first"), (-(1 << 63), "least"), (3, ""), (3, "x " * 40_000)]
    got = records(documents(rows), 10)
    assert [r[0] for r in got] == [None, -(1 << 63), 1, 2, 3, 3] and sum(r[2] for r in got) == sum(len(encode(t)) + 1 for _, t in rows)
    assert records(documents(rows[:0])) == []


def test_shard_files(spark, documents, tmp_path):
    """One file a shard, as the format says, whoever reads it; damage is found."""
    texts = [(i, f"text {i} " * (i % 7 + 1)) for i in range(200)]
    path = str(tmp_path / "shards")
    wavelet.write_shards(documents(texts).repartition(3), BYTES, path, 300)
    files = sorted((tmp_path / "shards").glob("part-*"))
    shards = [wavelet.read_shard(f.read_bytes()) for f in files]
    assert len(files) > 3 and all(f.read_bytes()[:4] == b"TGWM" and f.read_bytes()[-1:] == b"\n" for f in files)
    assert len({(s.part, s.seq) for s in shards}) == len(files)
    ids = {int(d): s.document(k).tolist() for s in shards for k, d in enumerate(s.doc_ids)}
    assert ids == {i: [*reference(BYTES)(t), 0] for i, t in texts}
    raw = bytearray(files[0].read_bytes())
    raw[-1 - sum(r.nbytes for r in shards[0].ranks)] = 1  # the first rank of the first plane
    bad = pa.RecordBatch.from_arrays([pa.array([bytes(raw)], pa.binary())], ["content"])
    with pytest.raises((ValueError, IndexError)):
        list(wavelet._read([bad]))
