"""Encoding texts by a public tokenizer file, one chunk per space.

Encoding is by the tokenizers library. Where the tokenizer's own rules cut at a space anyway, a text is cut there first
and each distinct chunk is encoded once per worker, which gives the same ids:

* byte-level pre-tokenizer without normalizer or prefix space: its pattern starts a new piece at a space that stands
  between two characters other than white space, and gives the space to the following piece;
* a pre-tokenizer that drops white space: no piece holds any.

Any other tokenizer, and any text to which that doesn't apply, is encoded as a whole.
"""

from __future__ import annotations

import json
import os
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import give_back, worker_memory

#: A worker remembers the chunks of a young generation until there are so many, and then of an old one (at most about 170 MB).
REMEMBERED = 400_000
LONG_CHUNK = 80
#: Texts that are cut up at once; what that takes is about ten times as much.
SLICE_BYTES = 16_000_000
SPACES = [chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace()]


def load(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _rule(spec: dict) -> str:
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if any(any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens", [])):
        return "whole"
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
        return "lead"
    parts = pre.get("pretokenizers", []) if pre.get("type") == "Sequence" else []
    kinds = {n["type"] for n in (norm or {}).get("normalizers", [])}
    if parts and parts[0]["type"] == "Split" and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and kinds <= {"NFC", "Replace", "Lowercase"}:
        return "drop"
    return "whole"


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist


class Encoder:
    """ids(texts) -> one array of token ids a text (no special tokens are added or recognised)."""

    def __init__(self, spec: str, slice_bytes: int = SLICE_BYTES, remembered: int = REMEMBERED) -> None:
        self.slice_bytes, self.remembered = slice_bytes, remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.rule = _rule(json.loads(spec))
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        if self.rule == "lead":  # byte-level tokens have a character for each byte
            names = self.tokenizer.get_vocab()
            self.token_bytes = np.zeros(max(names.values()) + 1, np.int64)
            self.token_bytes[list(names.values())] = list(map(len, names))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """The ids of each of these chunks (none holds a space). They are joined again to encode many in one call, as
        they would stand in a text, and the ids are told apart by the bytes or the places they stand for."""
        out: list[bytes] = []
        lead, width = self.rule == "lead", self.kind.itemsize
        blocks = [chunks[i : i + 256] for i in range(0, len(chunks), 256)]
        texts = [" " * lead + " ".join(block) for block in blocks]
        for block, text, e in zip(blocks, texts, (self.tokenizer.encode_batch_fast if lead else self.tokenizer.encode_batch)(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int64)
            if lead:  # a chunk begins at each space
                ends = np.searchsorted(np.cumsum(self.token_bytes[ids]), np.nonzero(np.frombuffer(text.encode(), np.uint8) == 32)[0], side="right")
            else:
                places = np.fromiter((x for x, _ in e.offsets), np.int64, len(ids))
                ends = np.searchsorted(places, np.cumsum(np.fromiter(map(len, block), np.int64, len(block)) + 1))
                ends = np.r_[0, ends[:-1]]
            flat, ends = ids.astype(self.kind).tobytes(), [*(ends * width).tolist(), len(ids) * width]
            out += [flat[i:j] for i, j in zip(ends, ends[1:], strict=False)]
        return out

    def _alone(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _known(self, chunks: list[str]) -> list[bytes]:
        """The ids of each of these distinct chunks, from memory or learned now."""
        young, old = self.young, self.old
        new = [c for c in chunks if c not in young]
        if old:
            found = [c for c in new if c in old]
            young.update(zip(found, map(old.__getitem__, found), strict=True))
            new = [c for c in new if c not in old]
        for i in range(0, len(new), 16_384):
            part = new[i : i + 16_384]
            young.update(zip(part, self._learn(part), strict=True))
        out = list(map(young.__getitem__, chunks))
        for c in new:
            if len(c) > LONG_CHUNK:
                del young[c]
        if len(young) > self.remembered:
            self.old, self.young = young, {}
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and where each text's begin (with the end of the last); null is empty."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        total = int(ends[-1]) if len(ends) else 0
        slices = max(1, round(total / self.slice_bytes))
        cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(1, slices) * (total / slices), side="right"), len(texts)])
        parts = []
        for i, j in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            parts.append(self._slice_ids(texts[i:j]))
            give_back()
        parts = parts or [self._slice_ids(texts)]
        base = np.cumsum([0, *(len(ids) for ids, _ in parts)])
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([*(b + e[:-1] for b, (_, e) in zip(base, parts, strict=False)), base[-1:]])

    def _slice_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        whole = lambda t: np.frombuffer(self._whole(t), self.kind)
        if self.rule == "whole" or not len(texts):
            each = [whole(t or "") for t in texts.to_pylist()]
            return np.concatenate([np.empty(0, self.kind), *each]), np.cumsum([0, *map(len, each)])
        split = pc.split_pattern(pc.fill_null(texts, ""), " ")
        begins = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        at, words = coded.indices.to_numpy().astype(np.int32), coded.dictionary
        odd = np.zeros(len(texts), bool)
        if self.rule == "lead":
            spaces = pa.array(SPACES, words.type)
            flags = (pc.equal(pc.utf8_length(words), 0), pc.is_in(pc.utf8_slice_codeunits(words, 0, 1), spaces), pc.is_in(pc.utf8_slice_codeunits(words, -1), spaces))
            flags = [f.to_numpy(zero_copy_only=False) for f in flags]
            plain = ~(flags[0] | flags[1] | flags[2])
            empty, before, after = (f[at] for f in flags)
            before[begins[:-1]] = False
            after[begins[1:] - 1] = False
            odd = np.logical_or.reduceat(empty | before | after, begins[:-1])
            firsts, inverse = np.unique(at[begins[:-1]], return_inverse=True)
            first_words = words.take(pa.array(firsts)).to_pylist()
            rest = np.nonzero(~plain)[0]  # last in their texts, first, or in odd ones
            if len(rest):
                table = self._known(_strings(words.filter(pa.array(plain))))
                for k, ids in zip(rest.tolist(), self._alone([" " + c for c in words.take(pa.array(rest)).to_pylist()]), strict=True):
                    table.insert(k, ids)
            else:
                table = self._known(_strings(words))
            table += self._alone(first_words)
            at[begins[:-1]] = len(words) + inverse
        else:
            table = self._known(_strings(words))
        width = self.kind.itemsize
        size = np.fromiter(map(len, table), np.int32, len(table)) // width
        flat, start = np.frombuffer(b"".join(table), self.kind), np.cumsum(size, dtype=np.int64) - size
        each = size[at]
        upto = np.r_[0, np.cumsum(each, dtype=np.int64)]
        place = np.repeat(start[at] - upto[:-1], each)
        place += np.arange(len(place))
        ids, ends = flat[place], upto[begins]
        if odd.any():
            some = [whole(t or "") if o else ids[i:j] for t, o, i, j in zip(texts.to_pylist(), odd, ends, ends[1:], strict=False)]
            return np.concatenate(some), np.cumsum([0, *map(len, some)])
        return ids, ends


def encoder(spec: str, slice_bytes: int = SLICE_BYTES, remembered: int = REMEMBERED) -> Encoder:
    """The worker's encoder for this tokenizer; with its memory of chunks it outlives a task."""
    kept = worker_memory().setdefault("encoders", {})
    key = hash((spec, slice_bytes, remembered))
    if key not in kept:
        kept.clear()
        kept[key] = Encoder(spec, slice_bytes, remembered)
    return kept[key]
