"""Token ids as wavelet matrices, one per shard (operator 6).

A shard holds consecutive documents (ascending doc_id) of about `shard_tokens` ids, as one file:

    header   magic TGWM, version, number of ids n, documents, bits, superblock size, alphabet, and the shard's place:
             partition and number in it  (little-endian, HEADER)
    docs     doc_id of each document (int64; 0 for none), one bit a document that is set for none, zero-padded to 8 bytes,
             first id of each document and n (uint64)
    alphabet the distinct ids of the shard, ascending (uint32); planes hold places in it, in as few bits as they need
    zeros    for each bit plane, how many of its bits are 0 (uint64)
    planes   for each bit from the highest: the n bits of all ids in that plane's order, packed, zero-padded to 8 bytes
    ranks    for each plane: how many 1s stand before every superblock (uint32)
    end      a line feed

Plane k+1 has the ids of plane k with bit 0 first, then those with bit 1, both in order. So one plane's rank steps down
to the next: access, rank (count), select (position of an occurrence) and counting all read `bits` planes and nothing
else, and whole ranges decode by undoing the planes.

Files are written by Spark's own file writer, one row a file: its commit protocol lets a lost or repeated task leave no
half file, in any file system that Spark writes to. The writer of text is the one that writes a row's bytes and nothing
else but the line feed. Files are read as binary files; read_shard() takes the bytes from anywhere.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, new_path, table
from .tokens import SLICE_BYTES, encoder, load

MAGIC, VERSION, SUPERBLOCK = b"TGWM", 3, 512
HEADER = "<4sIQIIIIII"
END_ID = 0
ONES = np.bitwise_count(np.arange(256, dtype=np.uint8))


def build(ids: np.ndarray, doc_ids: Sequence[int | None], starts: np.ndarray, part: int = 0, seq: int = 0) -> bytes:
    """The byte form of a shard; starts has one entry more than doc_ids."""
    n = len(ids)
    there = np.zeros(int(ids.max()) + 1 if n else 1, bool)
    there[ids] = True
    alphabet = np.nonzero(there)[0]
    bits = max(1, (len(alphabet) - 1).bit_length()) if n else 1
    current = (np.cumsum(there) - 1).astype(np.uint16 if bits <= 16 else np.uint32)[ids]
    zeros, planes, ranks = [], [], []
    for k in range(bits - 1, -1, -1):
        one = (current & current.dtype.type(1 << k)) != 0
        packed = np.packbits(one, bitorder="little")
        packed = np.pad(packed, (0, -len(packed) % 8))
        blocks = np.pad(packed, (0, -len(packed) % (SUPERBLOCK // 8))).view(np.uint64)
        per = np.bitwise_count(blocks).reshape(-1, SUPERBLOCK // 64).sum(axis=1, dtype=np.uint32)
        ranks.append(np.r_[np.uint32(0), np.cumsum(per, dtype=np.uint32)].astype("<u4").tobytes())
        planes.append(packed.tobytes())
        low, high = np.compress(~one, current), np.compress(one, current)
        zeros.append(len(low))
        if k:
            current = np.concatenate([low, high])
    head = struct.pack(HEADER, MAGIC, VERSION, n, len(doc_ids), bits, SUPERBLOCK, len(alphabet), part, seq)
    none = np.packbits(np.array([d is None for d in doc_ids], bool), bitorder="little")
    numbers = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return b"".join([head, numbers.tobytes(), np.pad(none, (0, -len(none) % 8)).tobytes(), starts.astype("<u8").tobytes(), alphabet.astype("<u4").tobytes(), np.array(zeros, "<u8").tobytes(), *planes, *ranks, b"\n"])


class Shard:
    """Access to one shard without decoding it."""

    def __init__(self, data: bytes) -> None:
        magic, version, self.n, docs, self.bits, self.block, letters, self.part, self.seq = struct.unpack_from(HEADER, data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token shard of this version")
        at = struct.calcsize(HEADER)

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids = take("<i8", docs)
        self.no_id = np.unpackbits(take("u1", -(-docs // 64) * 8), count=docs, bitorder="little").astype(bool)
        self.starts = take("<u8", docs + 1).astype(np.int64)
        self.alphabet = take("<u4", letters)
        self.zeros = take("<u8", self.bits).astype(np.int64).tolist()
        size = -(-self.n // 64) * 8
        self.planes = [take("u1", size) for _ in range(self.bits)]
        self.ranks = [take("<u4", -(-size * 8 // self.block) + 1) for _ in range(self.bits)]

    def _ones(self, plane: int, i: int) -> int:
        """1s among the first i bits of a plane."""
        b = i // self.block
        bits = self.planes[plane]
        out = int(self.ranks[plane][b]) + int(ONES[bits[b * self.block // 8 : i // 8]].sum())
        return out + (int(ONES[bits[i // 8] & ((1 << i % 8) - 1)]) if i % 8 else 0)

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.bits):
            one = int(self.planes[p][i // 8]) >> i % 8 & 1
            before = self._ones(p, i)
            i = self.zeros[p] + before if one else i - before
            value = value << 1 | one
        return int(self.alphabet[value])

    def _letter(self, token: int) -> int | None:
        """The token's place in the alphabet."""
        at = int(np.searchsorted(self.alphabet, token)) if token >= 0 else 0
        return at if at < len(self.alphabet) and self.alphabet[at] == token and self.n else None

    def _range(self, token: int, i: int, j: int) -> tuple[int, int]:
        """Where the occurrences of an alphabet place among positions [i, j) end up below the last plane."""
        for p in range(self.bits):
            a, b = self._ones(p, i), self._ones(p, j)
            i, j = (self.zeros[p] + a, self.zeros[p] + b) if token >> self.bits - 1 - p & 1 else (i - a, j - b)
        return i, j

    def count(self, token: int, i: int = 0, j: int | None = None) -> int:
        """Occurrences of a token among positions [i, j)."""
        letter = self._letter(token)
        if letter is None:
            return 0
        a, b = self._range(letter, i, self.n if j is None else j)
        return b - a

    def _select(self, plane: int, one: bool, k: int) -> int:
        """Position of the k-th (from 0) bit of this value in a plane."""
        ranks = self.ranks[plane].astype(np.int64)
        before = ranks if one else np.arange(len(ranks)) * self.block - ranks
        b = int(np.searchsorted(before, k, side="right")) - 1
        part = np.unpackbits(self.planes[plane][b * self.block // 8 : (b + 1) * self.block // 8], bitorder="little")
        return b * self.block + int(np.nonzero(part == one)[0][k - int(before[b])])

    def select(self, token: int, k: int) -> int:
        """Position of the token's k-th occurrence (from 0)."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        letter = self._letter(token)
        i = self._range(letter, 0, 0)[0] + k
        for p in range(self.bits - 1, -1, -1):
            one = bool(letter >> self.bits - 1 - p & 1)
            i = self._select(p, one, i - self.zeros[p] if one else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids, by undoing the planes from the last."""
        value = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for p in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[p], count=self.n, bitorder="little").view(bool)
            back = np.empty_like(value)
            back[np.flatnonzero(~one)] = value[: self.zeros[p]]
            back[np.flatnonzero(one)] = value[self.zeros[p] :] | value.dtype.type(1 << self.bits - 1 - p)
            value = back
        return self.alphabet[value]

    def _ones_before(self, plane: int, i: np.ndarray) -> np.ndarray:
        """1s among the first i bits of a plane, for many i at once."""
        bits, width = self.planes[plane], self.block // 8
        block, byte = i // self.block, i // 8
        inside = bits[np.minimum(block[:, None] * width + np.arange(width), len(bits) - 1)]
        upto = np.where(np.arange(width) < (byte % width)[:, None], ONES[inside], 0).sum(axis=1, dtype=np.int64)
        last = bits[np.minimum(byte, len(bits) - 1)] & ((1 << i % 8) - 1).astype(np.uint8)
        return self.ranks[plane][block].astype(np.int64) + upto + ONES[last]

    def document(self, d: int, most: int = 4096) -> np.ndarray:
        """The ids of one document, by access through the ranks; `most` positions at once."""
        parts = [np.zeros(0, self.alphabet.dtype)]
        for first in range(int(self.starts[d]), int(self.starts[d + 1]), most):
            i = np.arange(first, min(first + most, int(self.starts[d + 1])))
            value = np.zeros(len(i), np.int64)
            for p in range(self.bits):
                one = (self.planes[p][i // 8] >> (i % 8).astype(np.uint8) & 1).astype(bool)
                before = self._ones_before(p, i)
                i = np.where(one, self.zeros[p] + before, i - before)
                value = value << 1 | one
            parts.append(self.alphabet[value])
        return np.concatenate(parts)


read_shard = Shard
SHARDS = "data binary"
RECORDS = "doc_id long, part int, seq int, local long, n_tokens long, ids_crc32 long"


def _gathered(batches: Iterator[pa.RecordBatch], least: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about `least` bytes: the more texts are encoded at once, the fewer chunks are met twice."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= least:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _writer(spec, shard_tokens: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        docs: list[int | None] = []
        sizes: list[int] = []

        def shard() -> pa.RecordBatch:
            nonlocal seq, ids, docs, sizes
            data = build(np.concatenate(ids), docs, np.cumsum([0, *sizes]), part, seq)
            row = pa.RecordBatch.from_arrays([pa.array([data[:-1]], pa.binary())], ["data"])  # the writer adds the end
            seq, ids, docs, sizes = seq + 1, [], [], []
            return row

        held = 0
        for some in _gathered(batches):
            flat, ends = encoder(spec.value).ids(some["text"])
            for d, i, j in zip(some["doc_id"].to_pylist(), ends.tolist(), ends[1:].tolist(), strict=False):
                ids += [flat[i:j], np.array([END_ID], flat.dtype)]
                docs.append(d)
                sizes.append(j - i + 1)
                held += j - i + 1
                if held >= shard_tokens:
                    yield shard()
                    held = 0
        if docs:
            yield shard()

    return write


def write_shards(docs: DataFrame, tokenizer: str, path: str | None = None, shard_tokens: int = 1 << 21) -> str:
    """Writes docs in ascending doc_id order as shard files into a new folder, by default in the shared one; its path. Every
    document ends with the end id; null texts are empty; null ids come first; rows that repeat an id follow each other.
    An empty table gives no shards."""
    spec = docs.sparkSession.sparkContext.broadcast(load(tokenizer))
    path = path or new_path(docs.sparkSession, "token-shards")
    placed = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    shards = placed.mapInArrow(_writer(spec, shard_tokens), SHARDS)
    # bytes as they are: neither the cast nor the writer of text looks at them
    shards.select(F.col("data").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch["content"]:
            raw = data.as_buffer()
            if raw.size < struct.calcsize(HEADER):  # Spark writes an empty file where there is no row at all
                continue
            s = Shard(raw)
            ids = s.decode()
            starts = s.starts
            n = len(starts) - 1
            if n and not np.array_equal(s.document(n - 1), ids[starts[n - 1] : starts[n]]):  # planes and ranks must agree
                raise ValueError(f"shard {s.part}, {s.seq} is damaged")
            crcs = [zlib.crc32(ids[i:j]) for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            numbers = pa.array(s.doc_ids, mask=s.no_id)
            yield pa.RecordBatch.from_arrays([numbers, pa.array(np.full(n, s.part, np.int32)), pa.array(np.full(n, s.seq, np.int32)), pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())], ["doc_id", "part", "seq", "local", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, read from the shard files. Each
    shard is decoded, and its last document also read through the ranks, which must give the same."""
    files = spark.read.format("binaryFile").load(path).select("content")
    read = durable(files.mapInArrow(_read, RECORDS), "token-records")
    within = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    across = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a partition of the writer
    sizes = read.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n_tokens"))
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("first"))
    base = sizes.withColumn("own", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(parts, "part").select("part", "seq", (F.col("first") + F.col("own")).alias("base"))
    return read.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op6_wavelet(spark, sf_dir):
    """Contract query: the documents as read back from the shards."""
    import public_tokenizers

    return read_documents(spark, write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
