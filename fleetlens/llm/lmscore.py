"""Language-model scores from a log-frequency Bloom filter.

The filter holds n-gram counts, quantised to levels: an n-gram of level j is put in as the j items
(n-gram, 1) to (n-gram, j), and a query counts up until an item is missing. Levels grow with the
logarithm of the count, so that a rare n-gram costs a few bits; a false positive can only add to a
level, and the more it adds the less likely it is. N-grams are dealt to parts by their hash. A part
is counted and filled by one task and has as many bits as its items need, so parts stay small and
their number, and the filter, grow with the corpus.

Filters that have at most ``broadcast_bytes``, even if no n-gram occurred twice, go to all workers.
Larger ones stay where they are filled: the n-grams of all texts are sent there once, those of the
training texts to be counted, and the levels of all of them go back to the texts. Both ways give the
same scores.

What is sent goes by runs of texts and by blocks of parts: one row holds the different n-grams of an
order that a run has in a block. Runs are as long as memory allows, so that rows stay long where there
are many blocks, and all rows of a block, or of a run, are unpacked and looked up at once.

A token's probability is smoothed from counts alone, order by order: p(w | h) = (c(h w) + m p(w | h'))
/ (c(h) + m) with h' one word shorter, down to the unigram (c(w) + 1) / (N + V + 1). As no n-gram
occurs more often than a part of it, levels beyond those of the parts are false positives and cut.

Counts of words that make up at least 1/``frequent_words`` of all tokens (there cannot be more such
words) go to all workers as they are. The base score is exact: the other words of a text meet their
counts in a join, or get them back with their levels.

Defined cases: null and empty texts hold the end token only; a null identifier is never held out;
repeated rows count, and are scored, each for itself; texts of any length are read whole; without
training texts every token is unknown; an empty table gives an empty result; other columns are not
looked at, whatever their names; there are no ties to break.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import shared
from fleetlens.llm.words import ByteWords, mixed, text_runs

BEGIN, END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
KEY_BITS, KEY_BYTES = 40, 5


@dataclass(frozen=True)
class Model:
    """mass: m of each order from 2 on; base: of the logarithm of counts; least: counts below are not stored, by order."""

    order: int = 3
    mass: tuple[float, ...] = (2000.0, 100.0)
    least: tuple[int, ...] = (1, 1, 2)
    base: float = 1.5
    hashes: int = 6
    folds: int = 7
    frequent_words: int = 1 << 20
    part_ngrams: int = 1 << 20
    broadcast_bytes: int = 128 << 20
    run_chars: int = 1 << 24


class Tokens:
    """Token ids of the texts of a run, each text with its end, and the keys of the n-grams that end at each token."""

    def __init__(self, words: ByteWords, texts: list[str]):
        h, bounds = words.of_texts(texts)
        self.id = np.insert(h, bounds[1:], END)
        self.size = np.diff(bounds) + 1
        self.first = np.cumsum(self.size) - self.size
        self.place = np.arange(len(self.id), dtype=np.int32) - np.repeat(self.first.astype(np.int32), self.size)

    def before(self, back: int) -> np.ndarray:
        """The token ``back`` places before each, or the begin of the text."""
        out = np.full(len(self.id), BEGIN)
        out[back:] = np.where(self.place[back:] >= back, self.id[:-back] if back else self.id, BEGIN)
        return out

    def keys(self, order: int) -> np.ndarray:
        key = np.full(len(self.id), np.uint64(order))
        for back in range(order - 1, -1, -1):
            key = mixed(key * GOLDEN + (self.before(back) if back else self.id))
        return key

    def has(self, order: int) -> np.ndarray:
        """Tokens with a context of their own at the order: more than one begin says no more than one."""
        return self.place >= order - 2


# --- counts --------------------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """word (its hash), n of the training tokens."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids, some = ByteWords(fold=True), [], []

        def counted() -> None:
            some.append(np.unique(np.concatenate(ids), return_counts=True))
            ids.clear()

        def rows() -> pa.RecordBatch:
            word, n = summed(*(np.concatenate(x) for x in zip(*some, strict=True)))
            some.clear()
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

        for batch in batches:
            for _, texts in text_runs(batch.column("text")):
                ids.append(Tokens(words, texts).id)
                if sum(map(len, ids)) > 2_000_000:
                    counted()
                if sum(len(word) for word, _ in some) > 1_000_000:
                    yield rows()
        if ids:
            counted()
        if some:
            yield rows()

    return docs.mapInArrow(read, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def packed(keys: np.ndarray) -> bytes:
    """The low bytes of keys; the high ones are the number of their part."""
    return keys.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, KEY_BYTES)
    return out.reshape(-1).view(np.uint64)


def dealt(keys: np.ndarray, part_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Part and place within it of each key."""
    parts = keys >> np.uint64(64 - part_bits) if part_bits else np.zeros(len(keys), np.uint64)
    return parts.astype(np.int64), (keys << np.uint64(part_bits)) >> np.uint64(64 - KEY_BITS)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[start], np.add.reduceat(n, start) if len(start) else n


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted, each once; ``np.unique`` alone puts them into a hash table, which takes ten times as long."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]


COUNTS = "part long, order int, keys binary, counts binary"


def ngram_counts(docs: DataFrame, model: Model, part_bits: int) -> DataFrame:
    """Counts of a buffer of training n-grams after another, by part: those seen once, then the others with their counts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, some, held = ByteWords(fold=True), {}, 0

        def rows() -> Iterator[pa.RecordBatch]:
            columns: list[list] = [[], [], [], []]
            for order, arrays in some.items():
                keys, n = np.unique(np.concatenate(arrays), return_counts=True)
                if not len(keys):
                    continue
                part, key = dealt(keys, part_bits)
                edges = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(part)], strict=True):
                    k, times = key[a:b], n[a:b]
                    ordered = np.concatenate([k[times == 1], k[times > 1]])
                    for column, value in zip(columns, (int(part[a]), order, packed(ordered), times[times > 1].astype("<u4").tobytes()), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["part", "order", "keys", "counts"])

        for batch in batches:
            for _, texts in text_runs(batch.column("text")):
                tokens = Tokens(words, texts)
                for order in range(1, model.order + 1):
                    keys = tokens.keys(order)
                    some.setdefault(order, []).append(keys[tokens.has(order)] if order > 2 else keys)
                    held += len(keys)
                if held > 2 * model.part_ngrams:
                    yield from rows()
                    some, held = {}, 0
        if some:
            yield from rows()

    return docs.mapInArrow(read, COUNTS)


# --- the filter ----------------------------------------------------------------------------


def hashed(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each item (key, level), from which all its hashes are made."""
    one = mixed(keys + np.uint64(level * int(GOLDEN) % 2**64))
    return one, mixed(one) | np.uint64(1)


def places(one: np.ndarray, two: np.ndarray, which: int, size) -> np.ndarray:
    """Where hash number ``which`` puts items of a part with ``size`` bits."""
    return ((one + np.uint64(which) * two) >> np.uint64(32)) * size >> np.uint64(32)


def levels_of(n: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(n) / np.log(base) + 1e-9).astype(np.int64)


def counts_of(levels: np.ndarray, base: float) -> np.ndarray:
    """The middle of the counts that have each level."""
    lo = np.ceil(base ** (levels - 1.0) - 1e-6)
    return np.where(levels > 0, np.maximum((lo + np.ceil(base ** levels.astype(float) - 1e-6) - 1) / 2, lo), 0.0)


def filled(keys: np.ndarray, levels: np.ndarray, hashes: int) -> tuple[np.ndarray, int]:
    """Bits of a part: hashes / ln 2 for each item, so that half of them are set."""
    size = max(64, int(levels.sum() * hashes / np.log(2)) + 7 & ~7)
    table = np.zeros(size, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        numbers = hashed(keys[levels >= level], level)
        for which in range(hashes):
            table[places(*numbers, which, np.uint64(size))] = True
    return np.packbits(table, bitorder="little"), size


FILTER = "part long, bits binary, size long"


def filled_part(keys: list[np.ndarray], n: list[np.ndarray], model: Model) -> tuple[np.ndarray, int]:
    """Bits of a part, and their number, from its n-grams of each order and how often they occur."""
    stay = [x >= least for x, least in zip(n, model.least, strict=True)]
    keys = [k[s] for k, s in zip(keys, stay, strict=True)]
    levels = [levels_of(x[s], model.base) for x, s in zip(n, stay, strict=True)]
    return filled(np.concatenate(keys), np.concatenate(levels), model.hashes)


def filter_parts(counts: DataFrame, model: Model) -> DataFrame:
    def fill(table: pa.Table) -> pa.Table:
        keys, n = [], []
        for order in range(1, model.order + 1):
            rows = table.filter(pa.compute.equal(table["order"], order))
            ks, ns = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for raw, more in zip(rows["keys"], rows["counts"], strict=True):
                k, many = unpacked(raw.as_py()), np.frombuffer(more.as_py(), "<u4").astype(np.int64)
                ks.append(k)
                ns.append(np.concatenate([np.ones(len(k) - len(many), np.int64), many]))
            k, times = summed(np.concatenate(ks), np.concatenate(ns))
            keys.append(k)
            n.append(times)
        bits, size = filled_part(keys, n, model)
        return pa.table({"part": table["part"][:1], "bits": [bits.tobytes()], "size": [size]})

    return shared.written(counts.groupBy("part").applyInArrow(fill, FILTER), "lm-filter")


@dataclass(frozen=True)
class Parts:
    """Some or all parts of the filter, one behind the other."""

    bits: np.ndarray
    start: np.ndarray
    size: np.ndarray
    hashes: int

    @staticmethod
    def of(rows: pa.Table, number: np.ndarray, parts: int, hashes: int) -> Parts:
        """Of rows with bits and size, and the number of each; the bits are not copied."""
        start, size = np.zeros(parts, np.uint64), np.zeros(parts, np.uint64)
        if not len(rows):
            return Parts(np.zeros(0, np.uint8), start, size, hashes)
        bits = rows["bits"].combine_chunks()
        _, offsets, data = bits.buffers()
        start[number] = np.frombuffer(offsets, np.int32)[bits.offset : bits.offset + len(bits)].astype(np.uint64) * np.uint64(8)
        size[number] = rows["size"].to_numpy()
        return Parts(np.frombuffer(data, np.uint8), start, size, hashes)

    def levels(self, part: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Levels of n-grams by repeated probes: each round, those that are still there go on."""
        out = np.zeros(len(keys), np.uint8)
        alive = np.flatnonzero(self.size[part] > 0)
        one_part = len(self.size) == 1
        start, size = (self.start, self.size) if one_part else (self.start[part], self.size[part])
        level = 0
        while len(alive) and level < 255:
            level += 1
            one, two = hashed(keys[alive], level)
            for i in range(self.hashes):
                mine = slice(1) if one_part else alive
                at = start[mine] + places(one, two, i, size[mine])
                there = (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                # Most n-grams of a text are not there, and few of those get past the first hashes.
                alive, one, two = alive[there], one[there], two[there]
            out[alive] = level
        return out

    def levels_of_repeated(self, keys: np.ndarray, part_bits: int) -> np.ndarray:
        """Levels of keys that may repeat: each is looked up once."""
        distinct, back = np.unique(keys, return_inverse=True)
        return self.levels(*dealt(distinct, part_bits))[back]


# --- scores --------------------------------------------------------------------------------


class Hashes:
    """Sorted different hashes of so many bits, found by a table of their first bits: a bucket holds one or two."""

    def __init__(self, keys: np.ndarray, bits: int = 64):
        self.keys = keys
        self.shift = np.uint64(max(0, bits - max(1, len(keys).bit_length())))
        size = np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << (bits - int(self.shift)))
        self.begin = np.cumsum(size) - size

    def places(self, asked: np.ndarray) -> np.ndarray:
        """Place of each asked hash, or of the next one that is there, or the last; some hashes at a time, as they fit into caches."""
        out = np.zeros(len(asked), np.int32)
        for a in range(0, len(asked), 1 << 18):
            out[a : a + (1 << 18)] = self.some_places(asked[a : a + (1 << 18)])
        return out

    def some_places(self, asked: np.ndarray) -> np.ndarray:
        at = np.minimum(self.begin[(asked >> self.shift).astype(np.int64)], len(self.keys) - 1)
        on = np.flatnonzero(self.keys[at] < asked)
        while len(on):
            at[on] += 1
            on = on[at[on] < len(self.keys)]
            on = on[self.keys[at[on]] < asked[on]]
        return np.minimum(at, len(self.keys) - 1)


@dataclass(frozen=True)
class Known:
    """What every worker knows: training tokens, distinct ones, texts, and the counts of frequent words."""

    tokens: int
    distinct: int
    texts: int
    word: Hashes
    n: np.ndarray

    def counts(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which ids are frequent words, and their counts (else 0)."""
        if not len(self.n):
            return np.zeros(len(ids), bool), np.zeros(len(ids), np.int64)
        at = self.word.places(ids)
        has = self.word.keys[at] == ids
        return has, np.where(has, self.n[at], 0)


# Levels of the n-grams of an order that end at the tokens of a mask.
Lookup = Callable[[Tokens, int, np.ndarray], np.ndarray]


def scored(
    doc_ids: list, held: list, tokens: Tokens, frequent: np.ndarray, exact: np.ndarray, known: Known, model: Model, lookup: Lookup, first_row: int
) -> pa.RecordBatch:
    """The rows of a run of texts, with their words that are not frequent; exact has the counts of the others, and of these if they are known.

    Only n-grams are looked up that can be there: those of which both parts are frequent enough.
    """
    counts = counts_of(np.arange(256), model.base)
    count = [exact.astype(float)]
    level = np.where(frequent, 255, 0)
    level[~frequent] = lookup(tokens, 1, ~frequent)
    count[0][~frequent] = counts[level[~frequent]]
    for order in range(2, model.order + 1):
        least = int(levels_of(np.array([model.least[order - 1]]), model.base)[0])
        # (The begin of a text is a context that is always known.)
        before = np.where(tokens.place > 0, np.roll(level, 1), 255 if order == 2 else 0)
        ask = tokens.has(order) & (level >= least) & (before >= least)
        level = np.zeros(len(tokens.id), np.int64)
        level[ask] = lookup(tokens, order, ask)
        count.append(counts[level])
    all_ = known.tokens + known.distinct + 1
    p = (count[0] + 1) / all_
    here = count[0]
    # c(h) of each token: the count of the n-gram before it; before the first token stands the begin of every text.
    for order in range(2, model.order + 1):
        context = np.where(tokens.place > 0, np.roll(count[order - 2], 1), float(known.texts) if order == 2 else 0.0)
        here = np.minimum(np.minimum(count[order - 1], here), context)
        mass = model.mass[order - 2]
        p = np.where(tokens.has(order), (here + mass * p) / (context + mass), p)
    add = lambda x: np.add.reduceat(x, tokens.first)
    rare = ~frequent
    edges = np.append(0, np.cumsum(add(rare.astype(np.int64)))).astype(np.int32)
    base = np.log10(exact + 1.0)
    columns = [
        pa.array(np.arange(first_row, first_row + len(doc_ids))),
        pa.array(doc_ids, pa.int64()),
        pa.array(held, pa.bool_()),
        pa.array(tokens.size.astype(np.int64)),
        pa.array(add((exact > 0).astype(np.int64))),
        pa.array(add(base)),
        pa.array(add(np.log10(np.minimum(p, 1.0)))),
        pa.ListArray.from_arrays(pa.array(edges), pa.array(tokens.id[rare].view(np.int64))),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RARE.split(", ")])


ROWS = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
RARE = ROWS + ", rare array<long>"


def scored_by_broadcast(docs: DataFrame, words: DataFrame, known: Known, model: Model, part_bits: int) -> DataFrame:
    train = docs.filter(~F.col("held_out")).select("text")
    parts = filter_parts(ngram_counts(train, model, part_bits), model)
    found = parts.toArrow()
    sent = docs.sparkSession.sparkContext.broadcast((known, Parts.of(found, found["part"].to_numpy(), 1 << part_bits, model.hashes)))
    del found

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = sent.value
        words, row = ByteWords(fold=True), TaskContext.get().partitionId() << 36
        lookup = lambda tokens, order, mask: table.levels_of_repeated(tokens.keys(order)[mask], part_bits)
        for batch in batches:
            for at, texts in text_runs(batch.column("text")):
                rows = batch.slice(at, len(texts))
                tokens = Tokens(words, texts)
                yield scored(rows["doc_id"].to_pylist(), rows["held_out"].to_pylist(), tokens, *known.counts(tokens.id), known, model, lookup, row)
                row += len(texts)

    rows = shared.written(docs.mapInArrow(read, RARE), "lm-rows")
    rare = rows.select("row", F.explode("rare").alias("word")).join(words, "word")
    rare = rare.groupBy("row").agg(F.count(F.lit(1)).alias("more_known"), F.sum(F.log10(F.col("n") + 1)).alias("more_base"))
    return rows.drop("rare").join(rare, "row", "left").withColumns(
        {"n_known": F.col("n_known") + F.coalesce("more_known", F.lit(0)), "base": F.col("base") + F.coalesce("more_base", F.lit(0.0))}
    )


# --- scores where the filter is ---------------------------------------------------------------

BLOCK_BITS, LOW_BITS = 2, 32
RUNS = "run long, held_out boolean, rows binary"
ASKED = "block long, order int, run long, held_out boolean, n long, low binary, high binary, counts binary"
ANSWERED = "run long, order int, block long, n long, levels binary, counts binary"


def zipped(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    how = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3), use_threads=False)
    with pa.ipc.new_stream(sink, rows.schema, options=how) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def unzipped(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw, options=pa.ipc.IpcReadOptions(use_threads=False)).read_all()


def runs_of(docs: DataFrame, model: Model) -> DataFrame:
    """Runs of texts that are, or are not, held out, each a table in itself."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId() << 36
        some: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}

        def row(held: bool) -> pa.RecordBatch:
            nonlocal run
            columns = [pa.array([run]), pa.array([held]), pa.array([zipped(pa.Table.from_batches(some[held]))], pa.binary())]
            run += sum(map(len, some[held]))
            some[held], size[held] = [], 0
            return pa.RecordBatch.from_arrays(columns, names=["run", "held_out", "rows"])

        for batch in batches:
            for held in (False, True):
                rows = batch.filter(pa.compute.equal(batch["held_out"], held)).select(["doc_id", "text"])
                for at, texts in text_runs(rows["text"]):
                    some[held].append(rows.slice(at, len(texts)))
                    size[held] += sum(map(len, texts))
                    if size[held] >= model.run_chars:
                        yield row(held)
        yield from (row(held) for held in (False, True) if some[held])

    return shared.written(docs.mapInArrow(gather, RUNS), "lm-runs", "none")


def cut(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Bytes as values of these sizes."""
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def whole(column: pa.ChunkedArray) -> np.ndarray:
    """The bytes of all values, one after the other."""
    if not len(column):
        return np.zeros(0, np.uint8)
    column = column.cast(pa.binary()).combine_chunks()
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if edges[-1] > edges[0] else np.zeros(0, np.uint8)


def word_keys(ids: np.ndarray) -> np.ndarray:
    """Keys of the n-grams of one word: no two words share one."""
    return mixed(GOLDEN + ids)


def short(keys: np.ndarray, part_bits: int) -> np.ndarray:
    """Part and place within it, as one number."""
    return keys >> np.uint64(64 - KEY_BITS - part_bits)


def unary(values: np.ndarray, n: np.ndarray) -> pa.Array:
    """Small numbers, n to a row, as so many zero bits and a one each."""
    ends = np.cumsum(values + 1)
    first = np.cumsum(n) - n
    begin = ends[first] - values[first] - 1
    size = (np.append(begin[1:], ends[-1:]) - begin + 7) // 8
    bits = np.zeros(int(size.sum()) * 8, bool)
    bits[ends - 1 + np.repeat((np.cumsum(size) - size) * 8 - begin, n)] = True
    return cut(np.packbits(bits, bitorder="little"), size)


def numbers(column: pa.ChunkedArray, n: np.ndarray) -> np.ndarray:
    """The numbers of unary rows, one row after the other."""
    ones = np.flatnonzero(np.unpackbits(whole(column), bitorder="little"))
    before = np.append(-1, ones[:-1])
    size = pa.compute.binary_length(column).to_numpy()
    before[np.cumsum(n) - n] = (np.cumsum(size) - size) * 8 - 1
    return ones - before - 1


def asked_rows(run: int, held: bool, order: int, keys: np.ndarray, n: np.ndarray, part_bits: int) -> pa.RecordBatch:
    """The sorted keys of a run, a row for each block: words as they are, others by low bits and the steps of the rest."""
    width = 64 if order == 1 else KEY_BITS + part_bits
    block = keys >> np.uint64(width - (part_bits - BLOCK_BITS))
    first = np.flatnonzero(np.append(True, block[1:] != block[:-1])[: len(keys)])
    size = np.diff(np.append(first, len(keys)))
    none = cut(np.zeros(0, np.uint8), size * 0)
    if order == 1 or not len(keys):
        low, high = cut(keys.astype("<u8"), size * 8), none
    else:
        rest = ((keys >> np.uint64(LOW_BITS)) & np.uint64((1 << (BLOCK_BITS + KEY_BITS - LOW_BITS)) - 1)).astype(np.int64)
        steps = np.diff(rest, prepend=0)
        steps[first] = rest[first]
        low, high = cut(keys.astype("<u4"), size * 4), unary(steps, size)
    counts = none if held or not len(keys) else unary(n - 1, size)
    same = lambda x, kind: pa.array(np.full(len(first), x), kind)
    columns = [pa.array(block[first].astype(np.int64)), same(order, pa.int32()), same(run, pa.int64()), same(held, pa.bool_()), pa.array(size), low, high, counts]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ASKED.split(", ")])


def asked_keys(rows: pa.Table, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of rows, without their block unless they are words, and how often they occur in training texts."""
    size = rows["n"].to_numpy()
    if order == 1:
        keys = whole(rows["low"]).view("<u8")
    else:
        rest = np.cumsum(numbers(rows["high"], size))
        first = np.cumsum(size) - size
        rest -= np.repeat(np.append(0, rest)[first], size)
        keys = (rest.astype(np.uint64) << np.uint64(LOW_BITS)) | whole(rows["low"]).view("<u4")
    n = np.zeros(len(keys), np.int64)
    train = ~rows["held_out"].to_numpy()
    n[np.repeat(train, size)] = numbers(rows["counts"].filter(pa.array(train)), size[train]) + 1
    return keys, n


def run_tokens(rows: pa.Table, words: ByteWords) -> list[tuple[int, Tokens]]:
    """Tokens of a run, some texts at a time, with the place of the first."""
    return [(at, Tokens(words, texts)) for at, texts in text_runs(rows["text"])]


def order_keys(tokens: list[tuple[int, Tokens]], order: int, part_bits: int) -> np.ndarray:
    return short(np.concatenate([t.keys(order)[t.has(order)] for _, t in tokens]), part_bits)


def scored_by_parts(docs: DataFrame, words: DataFrame, known: Known, model: Model, part_bits: int) -> DataFrame:
    """As by broadcast; the n-grams of the runs are counted, put into the filter and looked up where they meet."""
    runs = runs_of(docs, model)
    frequent = word_keys(known.word.keys)
    by_key = np.argsort(frequent)
    sent = docs.sparkSession.sparkContext.broadcast((known, frequent[by_key], known.n[by_key]))
    parts, inner = 1 << BLOCK_BITS, np.uint64((1 << KEY_BITS) - 1)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, *_ = sent.value
        words = ByteWords(fold=True)
        for batch in batches:
            for run, held, raw in zip(batch["run"].to_pylist(), batch["held_out"].to_pylist(), batch["rows"], strict=True):
                tokens = run_tokens(unzipped(raw.as_py()), words)
                ids, n = np.unique(np.concatenate([t.id for _, t in tokens]), return_counts=True)
                rare = ~known.counts(ids)[0]
                keys = word_keys(ids[rare])
                by_key = np.argsort(keys)
                yield asked_rows(run, held, 1, keys[by_key], n[rare][by_key], part_bits)
                for order in range(2, model.order + 1):
                    keys, n = np.unique(order_keys(tokens, order, part_bits), return_counts=True)
                    yield asked_rows(run, held, order, keys, n, part_bits)

    def answer(asked: pa.Table) -> pa.Table:
        _, frequent, times = sent.value
        block = asked["block"][0].as_py()
        rows = [asked.filter(pa.compute.equal(asked["order"], order)) for order in range(1, model.order + 1)]
        look, back, held, n, exact = [], [], [], [], None
        for order, some in enumerate(rows, 1):
            every, counts = asked_keys(some, order)
            keys = distinct(every)
            at = Hashes(keys, 64 if order == 1 else KEY_BITS + BLOCK_BITS).places(every)
            counts = np.bincount(at, counts, len(keys)).astype(np.int64)
            back.append(at)
            if order == 1:
                exact = counts
                edges = np.searchsorted(frequent >> np.uint64(64 - (part_bits - BLOCK_BITS)), [block, block + 1])
                inside = np.uint64((1 << (BLOCK_BITS + KEY_BITS)) - 1)
                look.append(short(keys, part_bits) & inside)
                all_ = np.concatenate([look[0], short(frequent[slice(*edges)], part_bits) & inside])
                keys, counts = summed(all_, np.concatenate([counts, times[slice(*edges)]]))
            else:
                look.append(keys)
            held.append(keys)
            n.append(counts)
        levels = [np.zeros(len(keys), np.uint8) for keys in look]
        edges = np.arange(parts + 1, dtype=np.uint64) << np.uint64(KEY_BITS)
        held_at, look_at = ([np.searchsorted(keys, edges) for keys in some] for some in (held, look))
        for part in range(parts):
            of = lambda some, at: [x[a[part] : a[part + 1]] for x, a in zip(some, at, strict=True)]  # noqa: B023, E731
            bits, size = filled_part([keys & inner for keys in of(held, held_at)], of(n, held_at), model)
            table = Parts(bits, np.zeros(1, np.uint64), np.array([size], np.uint64), model.hashes)
            for keys, out in zip(of(look, look_at), of(levels, look_at), strict=True):
                out[:] = table.levels(np.zeros(len(keys), np.int64), keys & inner)
        none = np.zeros(0, np.uint8)
        out = []
        for order, some in enumerate(rows, 1):
            size = some["n"].to_numpy()
            counts = cut(exact[back[0]].astype("<i8"), size * 8) if order == 1 else cut(none, size * 0)
            columns = [some["run"], some["order"], some["block"], some["n"], unary(levels[order - 1][back[order - 1]].astype(np.int64), size), counts]
            out.append(pa.table(columns, names=[c.split()[0] for c in ANSWERED.split(", ")]))
        return pa.concat_tables(out)

    def read(run: pa.Table, answers: pa.Table) -> pa.Table:
        known, *_ = sent.value
        rows = unzipped(run["rows"][0].as_py())
        tokens = run_tokens(rows, ByteWords(fold=True))
        answers = answers.sort_by([("order", "ascending"), ("block", "ascending")])
        by_order = [answers.filter(pa.compute.equal(answers["order"], order)) for order in range(1, model.order + 1)]
        found = [numbers(some["levels"], some["n"].to_numpy()).astype(np.uint8) for some in by_order]

        ids = distinct(np.concatenate([t.id for _, t in tokens]))
        frequent, exact = known.counts(ids)
        rare = np.flatnonzero(~frequent)
        rare = rare[np.argsort(word_keys(ids[rare]))]
        exact[rare] = whole(by_order[0]["counts"]).view("<i8")
        level = np.zeros(len(ids), np.uint8)
        level[rare] = found[0]
        table, levels = Hashes(ids), []
        for order in range(2, model.order + 1):
            keys = order_keys(tokens, order, part_bits)
            levels.append(np.zeros(sum(len(t.id) for _, t in tokens), np.uint8))
            if len(keys):
                levels[-1][np.concatenate([t.has(order) for _, t in tokens])] = found[order - 1][Hashes(distinct(keys), KEY_BITS + part_bits).places(keys)]
        out, end = [], 0
        for first, t in tokens:
            here = slice(end, end := end + len(t.id))
            at = table.places(t.id)
            lookup = lambda _, order, mask: (level[at] if order == 1 else levels[order - 2][here])[mask]  # noqa: B023, E731
            doc_ids = rows["doc_id"].slice(first, len(t.size)).to_pylist()
            held = [run["held_out"][0].as_py()] * len(doc_ids)
            out.append(scored(doc_ids, held, t, frequent[at], exact[at], known, model, lookup, run["run"][0].as_py() + first))
        return pa.Table.from_batches(out).select([c.split()[0] for c in ROWS.split(", ")])

    levels = runs.mapInArrow(ask, ASKED).groupBy("block").applyInArrow(answer, ANSWERED)
    return shared.written(runs.groupBy("run").cogroup(levels.groupBy("run")).applyInArrow(read, ROWS), "lm-rows")


def scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model = Model()) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    doc_id = F.col(id_col).cast("long")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(doc_id.alias("doc_id"), text.alias("text")).withColumn("held_out", shared.held_out("doc_id", model.folds))
    train = docs.filter(~F.col("held_out")).select("text")
    words = shared.written(word_counts(train), "lm-words")
    ends = F.sum(F.when(F.col("word") == int(END.view(np.int64)), F.col("n")))
    totals = words.agg(*(F.coalesce(x, F.lit(0)).alias(name) for x, name in ((F.sum("n"), "n"), (F.count(F.lit(1)), "v"), (ends, "texts")))).first()
    frequent = words.filter(F.col("n") * model.frequent_words >= totals.n).toArrow()
    ids = frequent["word"].to_numpy().view(np.uint64)
    by_id = np.argsort(ids)
    known = Known(totals.n, totals.v, totals.texts, Hashes(ids[by_id]), frequent["n"].to_numpy()[by_id])

    part_bits = max(4, (totals.n * model.order // model.part_ngrams).bit_length())
    # Bytes of the filter if all n-grams were different; repeated ones take less.
    size = totals.n * model.order * model.hashes / np.log(2) / 8
    out = (scored_by_broadcast if size <= model.broadcast_bytes else scored_by_parts)(docs, words, known, model, part_bits)
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(totals.n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * float(np.log10(totals.n + totals.v + 1))).alias("base_score"),
        "score",
    )
