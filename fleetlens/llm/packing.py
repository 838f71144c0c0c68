"""Packing examples into training sequences by vector bin packing.

Every example asks for a vector: tokens, segments (one), loss-bearing tokens. A sequence has a limit
for each. One sequence is filled at a time from a window of waiting examples: of those that fit in
every dimension, the one whose vector has the largest dot product with what is left of the limits
is placed (both as shares of the limits). When none fits and cutting is allowed, the example with
the largest dot product is cut so that it fills the sequence. A sequence that ends short all the same,
by its segments or loss tokens or as the last of a task, is cut into lengths that are powers of two,
which need no padding.

Tasks pack the rows they read, without a shuffle; memory is bounded by the window. A sequence is
numbered by its task's partition and its place there, so a task that runs again on another executor
gives the same rows.

Defined cases: a null text is an empty one, whose tokens are the end mark alone; repeated rows are
packed each; texts of any length are tokenised whole; of examples with equal products the first in
the window is placed; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.words import ByteWords, text_runs

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 256
    loss_tokens: int = 4096


class WordCache:
    """Token ids of texts, for vocabularies that lower-case and never join what a blank or a line end parts.

    All words of a run of texts are hashed at once and looked up as a core and an ending, which the
    tokenizer never joins, in a hash table of fixed size; only cores that are new go through the
    tokenizer. The table is emptied when it is three quarters full.
    """

    # What may stand behind a word of letters without becoming part of its tokens.
    ENDINGS = b".,;:!?|%$&#*"

    def __init__(self, path: str, slots_log2: int = 21):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.slots = 1 << slots_log2
        self.words = ByteWords(fold=True)
        self.words.blank[:] = False
        self.words.blank[[10, 32]] = True
        self.ending = np.zeros(256, bool)
        self.ending[list(self.ENDINGS)] = True
        b = np.arange(256)
        self.ascii_letter = ((b | 32) >= 97) & ((b | 32) <= 122) & (b < 128)
        # Second bytes of the Latin-1 letters whose first byte is C3; two of them are signs.
        self.second = (b >= 0x80) & (b <= 0xBF) & (b != 0x97) & (b != 0xB7)
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(self.slots, np.uint64)
        self.value = np.zeros(self.slots, np.int32)
        self.flat = np.zeros(1 << 20, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.start = np.zeros(self.slots, np.int32)
        self.length = np.zeros(self.slots, np.int32)
        # Number 0 is the empty ending.
        self.known, self.used = 1, 0

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each hash, -1 if unknown, and the slot where its search ended."""
        out = np.full(len(h), -1, np.int64)
        slot = (h >> np.uint64(24)).astype(np.int64) & (self.slots - 1)
        open_ = np.arange(len(h))
        at = slot.copy()
        while len(open_):
            key = self.key[at]
            hit = key == h[open_]
            out[open_[hit]] = self.value[at[hit]]
            slot[open_] = at
            on = ~hit & (key != 0)
            open_, at = open_[on], (at[on] + 1) & (self.slots - 1)
        return out, slot

    def learn(self, h: np.ndarray, texts: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        total = int(n.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        number = np.arange(self.known, self.known + len(n))
        self.flat[self.used : self.used + total] = np.fromiter((i for ids in found for i in ids), self.flat.dtype, total)
        self.start[number] = self.used + np.cumsum(n) - n
        self.length[number] = n
        self.used += total
        self.known += len(n)
        # Where several want one free slot, one gets it and the others look on.
        while len(h):
            _, slot = self.find(h)
            _, one = np.unique(slot, return_index=True)
            self.key[slot[one]], self.value[slot[one]] = h[one], number[one]
            rest = np.ones(len(h), bool)
            rest[one] = False
            h, number = h[rest], number[rest]

    def numbers(self, h: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        number, _ = self.find(h)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            new, first = np.unique(h[missing], return_index=True)
            at = missing[first]
            self.learn(new, [raw[i:j].decode() for i, j in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            number[missing], _ = self.find(h[missing])
        return number

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The token ids of each text; what looks like a special token is left to the tokenizer."""
        if any("<|" in t for t in texts):
            plain = iter(self.ids([t for t in texts if "<|" not in t]) if any("<|" not in t for t in texts) else [])
            encode = self.tokenizer.encode
            return [np.array(encode(t, add_special_tokens=False).ids, np.uint32) if "<|" in t else next(plain) for t in texts]
        raw = [t.encode() for t in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        first = np.cumsum(size + 1) - (size + 1)
        parts, begins = [], []
        for at, part in buffers(b" ".join(raw)):
            tokens, start, count = self.part(part)
            parts.append(tokens)
            begins.append((start + at, count))
        start, count = (np.concatenate(x) for x in zip(*begins, strict=True))
        bounds = np.append(0, np.cumsum(count))[np.append(np.searchsorted(start, first), len(start))]
        tokens = np.concatenate(parts).astype(np.uint32)
        return [tokens[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def part(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of a buffer; first byte and number of tokens of each word."""
        if len(raw) > self.words.MOST:
            found = self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids
            return np.array(found, np.uint32), np.zeros(1, np.int64), np.array([len(found)])
        b = np.frombuffer(raw, np.uint8)
        start, end, sums = self.words.bounds(b)
        # Where a word's ending begins: behind its last byte that is no ending.
        body = np.maximum.accumulate(np.where(self.ending[b], -1, np.arange(len(b))))
        middle = np.maximum(body[end - 1] + 1, start) if len(end) else end
        other = ~self.ascii_letter[b]
        lead = b == 0xC3
        other &= ~lead
        other[1:] &= ~(lead[:-1] & self.second[b[1:]])
        strange = np.append(0, np.cumsum(other))
        split = (middle > start) & (strange[middle] == strange[start])
        middle = np.where(split, middle, end)

        h = self.words.hashed(sums, start, middle)
        tail = np.flatnonzero(middle < end)
        if self.known + len(h) + len(tail) > self.slots * 3 // 4 and self.known > 1:
            self.clear()
        number = np.zeros((len(h), 2), np.int64)
        number[:, 0] = self.numbers(h, raw, start, middle)
        number[tail, 1] = self.numbers(self.words.hashed(sums, middle[tail], end[tail]), raw, middle[tail], end[tail])
        n = self.length[number].astype(np.int64)
        count = n.sum(axis=1)
        flat = number.ravel()[n.ravel() > 0]
        n = n.ravel()[n.ravel() > 0]
        ends = np.cumsum(n)
        place = np.repeat(self.start[flat] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.flat[place], start, count


def worker_cache(path: str) -> WordCache:
    """The word table of this Python worker; workers run many tasks, functions come anew with each."""
    kept = sys.modules.setdefault("_fleetlens_worker", ModuleType("_fleetlens_worker"))
    caches = kept.__dict__.setdefault("word_caches", {})
    if path not in caches:
        caches[path] = WordCache(path)
    return caches[path]


def buffers(raw: bytes, most: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """The bytes in parts, cut at blanks or line ends; a longer word stays whole."""
    at = 0
    while len(raw) - at > most:
        cut = max(raw.rfind(b" ", at, at + most), raw.rfind(b"\n", at, at + most))
        if cut <= at:
            after = [i for i in (raw.find(b" ", at + most), raw.find(b"\n", at + most)) if i >= 0]
            if not after:
                break
            cut = min(after)
        yield at, raw[at:cut]
        at = cut + 1
    yield at, raw[at:]


class Packer:
    """Fills sequences from examples (key, payload, tokens, loss tokens) that arrive one by one."""

    def __init__(self, limits: Limits, window: int, cut: bool):
        self.limits, self.window, self.cut = limits, window, cut
        self.cap = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        self.need = np.zeros((window + 1, 3))
        self.items: list[tuple[object, int, int]] = []  # example, where it starts, loss tokens per token (0 or 1)
        self.sequences: list[list[tuple[object, int, int]]] = []

    def put(self, example, tokens: int, loss: bool) -> None:
        start = 0
        whole = self.limits.tokens if not loss else min(self.limits.tokens, self.limits.loss_tokens)
        while tokens - start > whole:
            if not self.cut:
                raise ValueError("an example is longer than a sequence and may not be cut")
            self.close([(example, start, whole)], whole)
            start += whole
        self.wait(example, start, tokens - start, loss)
        while len(self.items) >= self.window:
            self.fill()

    def wait(self, example, start: int, tokens: int, loss: bool) -> None:
        self.need[len(self.items)] = tokens, 1, tokens if loss else 0
        self.items.append((example, start, int(loss)))

    def take(self, i: int) -> None:
        """Removes waiting example i; the last one gets its place."""
        last = len(self.items) - 1
        self.items[i], self.need[i] = self.items[last], self.need[last]
        self.items.pop()

    def close(self, pieces: list[tuple[object, int, int]], tokens: int) -> None:
        if self.cut and tokens < self.limits.tokens:
            self.sequences.extend(powers_of_two(pieces))
        else:
            self.sequences.append(pieces)

    def fill(self) -> None:
        left, out = self.cap.copy(), []
        while self.items and left[0] > 0 and left[1] > 0:
            need = self.need[: len(self.items)]
            score = need @ (left / self.cap / self.cap)
            fits = (need <= left).all(axis=1)
            if fits.any():
                i = int(np.where(fits, score, -1).argmax())
                example, start, _ = self.items[i]
                out.append((example, start, int(need[i, 0])))
                left -= need[i]
                self.take(i)
                continue
            i = int(score.argmax())
            example, start, loss = self.items[i]
            room = int(min(left[0], left[2]) if loss else left[0])
            if not self.cut or room <= 0:
                break
            out.append((example, start, room))
            left -= (room, 1, room if loss else 0)
            self.items[i] = (example, start + room, loss)
            self.need[i] -= (room, 0, room if loss else 0)
        self.close(out, self.limits.tokens - int(left[0]))

    def finish(self) -> None:
        while self.items:
            self.fill()

    def done(self) -> list[list[tuple[object, int, int]]]:
        out, self.sequences = self.sequences, []
        return out


def powers_of_two(pieces: list[tuple[object, int, int]]) -> list[list[tuple[object, int, int]]]:
    """The pieces of one short sequence, cut into sequences whose lengths are powers of two."""
    out, rest = [], list(pieces)
    total = sum(n for _, _, n in pieces)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        one = []
        while room:
            example, start, n = rest.pop(0)
            used = min(n, room)
            one.append((example, start, used))
            room -= used
            if used < n:
                rest.insert(0, (example, start + used, n - used))
        out.append(one)
    return out


def pack(
    df: DataFrame,
    tokenizer: str,
    end_id: int | None = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    loss_col: str | None = None,
    limits: Limits = Limits(),
    window: int = 512,
    cut: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    ``loss_col`` says whether an example's tokens bear loss (none given: all do). Without ``cut``
    examples stay whole; one that is longer than a sequence is an error.
    """
    loss = F.coalesce(F.col(loss_col).cast("boolean"), F.lit(True)) if loss_col else F.lit(True)
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), loss.alias("loss")
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(tokenizer)
        packer = Packer(limits, window, cut)
        number = TaskContext.get().partitionId() << 40

        def rows_of(sequences):
            nonlocal number
            out = []
            for sequence in sequences:
                offset = 0
                for (doc_id, ids, loss), start, n in sequence:
                    crc = zlib.crc32(ids[start : start + n].tobytes())
                    out.append((doc_id, start, n, crc, len(ids), number, offset, n if loss else 0))
                    offset += n
                number += 1
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=NAMES)

        for batch in batches:
            for at, some in text_runs(batch.column(1)):
                doc_ids, losses = (batch.column(i).slice(at, len(some)).to_pylist() for i in (0, 2))
                for doc_id, loss, ids in zip(doc_ids, losses, cache.ids(some), strict=True):
                    if end_id is not None:
                        ids = np.append(ids, np.uint32(end_id))
                    if len(ids):
                        packer.put((doc_id, ids.astype("<u4"), loss), len(ids), loss)
                if len(packer.sequences) >= 1024:
                    yield rows_of(packer.done())
        packer.finish()
        yield rows_of(packer.done())

    return rows.mapInArrow(packed, PIECES)


NAMES = [c.split()[0] for c in PIECES.split(", ")]
