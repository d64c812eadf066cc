"""Byte-level BPE over whole columns with padded numpy matrices instead of per-word loops."""

from __future__ import annotations

import base64
import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cartolith.session import ship_package

#: Folder of the public vocabulary files; a parameter of every operator here.
VOCABULARIES = "/opt/tokenizers"

# Fixed value: the public pattern that cuts text into words before merging.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words up to this many bytes are merged in matrices, longer ones one by one.
MATRIX_BYTES = 256
#: Cells of one matrix at most, which bounds a task's memory.
MATRIX_CELLS = 4_000_000
#: Distinct words a task remembers between batches before it starts anew.
REMEMBERED = 200_000
#: Characters of text handled at once; bounds memory, has no influence on ids.
CHUNK_CHARS = 8_000_000

NEVER = np.int32(2**31 - 1)
PAD = np.int32(-1)


class PairTable:
    """(left id, right id) -> rank and merged id, by hashing with linear probing in numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NEVER, np.int32)
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slots, waiting = self._slots(keys), np.arange(len(keys))
        while len(waiting):
            at = slots[waiting]
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[waiting[free]]
            won = self.keys[at] == keys[waiting]
            self.ranks[at[won]] = rank[waiting[won]]
            waiting = waiting[~won]
            slots[waiting] = (slots[waiting] + 1) & (size - 1)
        self.merged = np.full(int(rank.max(initial=-1)) + 1, PAD, np.int32)
        self.merged[rank] = merged

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NEVER where they do not merge or either is padding."""
        keys = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        flat = np.ascontiguousarray(keys).ravel()
        out = np.full(len(flat), NEVER, np.int32)
        open_ = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        slots = self._slots(flat[open_])
        while len(open_):
            there = self.keys[slots]
            hit = there == flat[open_]
            out[open_[hit]] = self.ranks[slots[hit]]
            go_on = ~hit & (there != -1)
            open_, slots = open_[go_on], (slots[go_on] + 1) & ((1 << self.bits) - 1)
        return out.reshape(keys.shape)


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that merge files use for bytes: printable Latin-1 as itself, the rest from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {chr(b): b for b in printable}, 256
    for b in range(256):
        if b not in printable:
            letters[chr(extra)] = b
            extra += 1
    return letters


class Vocabulary:
    """Single-byte ids and the pair table of a public vocabulary file."""

    def __init__(self, path: str) -> None:
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as file:
                model = json.load(file)["model"]
            ids, letters = model["vocab"], _byte_letters()
            self.byte_ids = np.zeros(256, np.int32)
            for letter, b in letters.items():
                self.byte_ids[b] = ids[letter]
            pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
            left = np.array([ids[a] for a, _ in pairs], np.int32)
            right = np.array([ids[b] for _, b in pairs], np.int32)
            merged = np.array([ids[a + b] for a, b in pairs], np.int32)
            rank = np.arange(len(pairs), dtype=np.int32)
        else:
            with open(path, "rb") as file:
                tokens = {base64.b64decode(a): int(r) for a, r in map(bytes.split, file)}
            self.byte_ids = np.array([tokens[bytes([b])] for b in range(256)], np.int32)
            found = [
                (tokens[t[:k]], tokens[t[k:]], r)
                for t, r in tokens.items()
                for k in range(1, len(t))
                if t[:k] in tokens and t[k:] in tokens
            ]
            left, right, rank = (np.array(x, np.int32) for x in zip(*found, strict=True))
            merged = rank
        self.pairs = PairTable(left, right, rank, merged)


@lru_cache(maxsize=4)
def vocabulary(tokenizer: str, folder: str = VOCABULARIES) -> Vocabulary:
    """The vocabulary named ``tokenizer``, from its merge file if there is one, else its rank file."""
    for suffix in (".json", ".tiktoken"):
        if os.path.exists(path := os.path.join(folder, tokenizer + suffix)):
            return Vocabulary(path)
    raise FileNotFoundError(f"no vocabulary {tokenizer} in {folder}")


def merge_matrix(ids: np.ndarray, vocab: Vocabulary) -> list[np.ndarray]:
    """Merge every row of a padded id matrix to the end; padding is -1 on the right.

    Each round every row that still can merges its leftmost pair of minimum
    rank; the row closes up behind it, and only the two pairs beside the merge
    are looked up again.  Finished rows leave the matrix, and the matrix
    narrows with its longest row.
    """
    out: list[np.ndarray] = [ids[:0, 0]] * len(ids)
    row = np.arange(len(ids))
    if ids.shape[1] > 1:
        ranks = vocab.pairs.rank_of(ids[:, :-1], ids[:, 1:])
    else:
        ranks = np.full((len(ids), 1), NEVER, np.int32)
    length = (ids >= 0).sum(1)
    while len(row):
        at = ranks.argmin(1)
        lines = np.arange(len(row))
        best = ranks[lines, at]
        done = best == NEVER
        if done.any():
            for k in np.flatnonzero(done):
                out[row[k]] = ids[k, : length[k]].copy()
            keep = ~done
            if not keep.any():
                break
            width = int(length[keep].max())
            ids, row, length, at, best = ids[keep][:, :width], row[keep], length[keep], at[keep], best[keep]
            ranks = ranks[keep][:, : max(1, width - 1)]
            lines = np.arange(len(row))
        ids[lines, at] = vocab.pairs.merged[best]
        width = ids.shape[1]
        column = np.arange(width - 1)
        closed = np.full_like(ids, PAD)
        closed[:, :-1] = np.take_along_axis(ids, column + (column > at[:, None]), 1)
        ids = closed
        length = length - 1
        if width > 2:
            column = np.arange(width - 2)
            shifted = np.full_like(ranks, NEVER)
            shifted[:, :-1] = np.take_along_axis(ranks, column + (column >= at[:, None]), 1)
            ranks = shifted
            here = np.minimum(at, width - 2)
            ranks[lines, here] = np.where(
                at <= width - 2, vocab.pairs.rank_of(ids[lines, here], ids[lines, here + 1]), NEVER
            )
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = vocab.pairs.rank_of(
                ids[before, at[before] - 1], ids[before, at[before]]
            )
        else:
            ranks = np.full_like(ranks, NEVER)
    return out


def merge_long(ids: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Merge one very long row as ``merge_matrix`` does: each time the leftmost pair of minimum rank.

    Pairs wait in a heap by rank and place and the ids are a linked list, so
    that a merge costs the logarithm of the length, not the length; pairs that
    a merge has changed are passed over when they come up.
    """
    n = len(ids)
    ids = ids.copy()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    ranks = vocab.pairs.rank_of(ids[:-1], ids[1:]).tolist() + [int(NEVER)]
    heap = [(r, k) for k, r in enumerate(ranks) if r != NEVER]
    heapq.heapify(heap)
    while heap:
        rank, k = heapq.heappop(heap)
        if ranks[k] != rank:
            continue
        gone = after[k]
        ids[k], ids[gone] = vocab.pairs.merged[rank], PAD
        ranks[gone] = int(NEVER)
        after[k] = after[gone]
        if after[k] < n:
            before[after[k]] = k
        here = [j for j in (before[k], k) if j >= 0]
        left = np.array([ids[j] for j in here], ids.dtype)
        right = np.array([ids[after[j]] if after[j] < n else PAD for j in here], ids.dtype)
        for j, r in zip(here, vocab.pairs.rank_of(left, right).tolist(), strict=True):
            ranks[j] = r
            if r != NEVER:
                heapq.heappush(heap, (r, j))
    return ids[ids != PAD]


def encode_words(words: list[bytes], vocab: Vocabulary) -> list[np.ndarray]:
    """Ids of each word; words are merged together in buckets of like length."""
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
    sizes = np.fromiter((len(w) for w in words), np.int64, len(words))
    for k in np.flatnonzero(sizes == 1):
        out[k] = vocab.byte_ids[words[k][0] : words[k][0] + 1]
    for k in np.flatnonzero(sizes > MATRIX_BYTES):
        out[k] = merge_long(vocab.byte_ids[np.frombuffer(words[k], np.uint8)], vocab)
    low = 1
    for high in (2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 64, 128, MATRIX_BYTES):
        inside = np.flatnonzero((sizes > low) & (sizes <= high))
        low = high
        step = max(1, MATRIX_CELLS // high)
        for part in (inside[i : i + step] for i in range(0, len(inside), step)):
            n = sizes[part]
            text = np.frombuffer(b"".join([words[k] for k in part]), np.uint8)
            cells = np.full((len(part), high), PAD, np.int32)
            cells[np.arange(high) < n[:, None]] = vocab.byte_ids[text]
            for k, ids in zip(part, merge_matrix(cells, vocab), strict=True):
                out[k] = ids
    return out


class Encoder:
    """Encodes columns of texts; remembers the words it has merged before, up to a bound."""

    def __init__(self, tokenizer: str, folder: str = VOCABULARIES) -> None:
        self.vocab = vocabulary(tokenizer, folder)
        self.split = regex.compile(WORD_PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.start = np.zeros(1, np.int64)

    def _learn(self, new: list[str]) -> None:
        merged = encode_words([w.encode("utf-8", "surrogatepass") for w in new], self.vocab)
        sizes = np.fromiter((len(m) for m in merged), np.int64, len(merged))
        self.flat = np.concatenate([self.flat, *merged])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets); null and empty texts have none."""
        if len(self.index) > REMEMBERED:
            self.forget()
        index, new, at, counts = self.index, [], [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if not text:
                continue
            words = self.split(text)
            counts[k] = len(words)
            for word in words:
                i = index.get(word)
                if i is None:
                    i = index[word] = len(index)
                    new.append(word)
                at.append(i)
        if new:
            self._learn(new)
        word = np.array(at, np.int64)
        size = self.start[word + 1] - self.start[word]
        ends = np.cumsum(size)
        source = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start[word] - (ends - size), size)
        total = np.r_[0, ends]
        return self.flat[source], total[np.r_[0, np.cumsum(counts)]]


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, chars = 0, 0
    for k, text in enumerate(texts):
        chars += len(text or "")
        if chars > CHUNK_CHARS:
            yield start, k + 1
            start, chars = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_documents(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str = "byte_bpe_50k",
    folder: str = VOCABULARIES,
    counts_only: bool = False,
) -> DataFrame:
    """``doc_id, ids`` (or ``doc_id, n_tokens``): the ids of every text without special tokens.

    One pass without any shuffle.  In each batch the texts are cut into words,
    the distinct new words are merged together in numpy matrices by length, and
    the ids are put together by position.  Texts of any length are encoded
    whole; strings that look like special tokens are ordinary text.

    Defined cases: null and empty texts have an empty list (0 tokens); every
    input row gives one row, repeated rows and null ids included; only the two
    named columns are read.
    """
    ship_package(documents.sparkSession)
    source = documents.select(documents[doc_id].alias("doc_id"), documents[text].cast("string").alias("text"))
    kind = dict(source.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, folder)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in _chunks(texts):
                ids, offsets = encoder.encode(texts[start:end])
                if counts_only:
                    values = pa.array(np.diff(offsets), pa.int64())
                else:
                    values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                name = "n_tokens" if counts_only else "ids"
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), values], ["doc_id", name]
                )

    result = "n_tokens bigint" if counts_only else "ids array<int>"
    return source.mapInArrow(run, f"doc_id {kind}, {result}")
