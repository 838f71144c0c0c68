"""Jaccard join of documents on word shingles, with adaptive multi-match prefixes (after AdaptJoin).

A set's shingles are ordered from rare to frequent, by counts over all documents that a fixed-size
sketch holds. Of two sets that are similar enough, the l-prefixes (the first n - ceil(t n) + l
shingles) share at least l. Each document takes the l whose estimated cost is least: the postings
its prefix meets, and the candidates those leave when l of them must agree. A pair is a candidate
when it shares as many prefix shingles as the smaller of its two l, and as many more as the pair's
sizes ask for: what lies beyond both prefixes can hold only a part of the overlap.

Documents with equal sets are one node from the start. Shingles that few nodes have give all their
pairs, counted by pair. Where many nodes share a shingle, pairs would grow with the square: there
each node first meets the best connected node it shares a shingle with, round by round, and only
pairs of nodes that are not in one component by then are drawn. They are drawn where the first
shingle that two linked sets share can lie: it leaves enough of both sets behind it for the overlap
that their sizes ask for. Shingle, own size class and the classes within reach are the join key, so
that sets which stand too far down never meet. No pair that could join two components is left out,
so components are exact. Bitmaps of whole sets, two bits a shingle or more, rule pairs out: each bit
that differs stands for a shingle that one set lacks, so that pairs with more of them than a link
allows are none, and no link is lost. Rows of long lists carry their bitmap folded to 512 bits, so
that the sets of a large group that cannot link, where all share a base, make no pair when they
meet; candidates compare the bitmaps whole. What is left, little but links, is verified on the
documents' whole shingle sets; only those texts are fetched.

Shingles, and nodes, are 64-bit hashes. Only the sketch (one byte a cell) goes to all tasks.

Defined cases: null texts and texts without words have an empty set and are linked with nothing,
their component is themselves; repeated rows are equal sets; a null identifier counts as larger than
any other in a component; texts of any length give their whole sets; there are no ties, as a link is
there or not; an empty table gives an empty result; other columns are not looked at, and stay as they
are where whole rows come back, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm import shared
from fleetlens.llm.components import components
from fleetlens.llm.words import ByteWords, RunHashes, mixed, powers, text_runs


@dataclass(frozen=True)
class Join:
    """percent: least similarity; short_list: up to so many nodes of a shingle all pairs are drawn.

    Nodes of longer lists meet hubs, in each round as many as ``hubs`` says, until what is left has
    at most ``pairs_per_document`` pairs for each document, hubs find nothing more, or the rounds
    are over; then all pairs left that can be links are drawn.
    """

    percent: int = 75
    words: int = 5
    cells_log2: int = 21
    slices: int = 16
    short_list: int = 8
    lengths: tuple[int, ...] = (1, 2, 4, 8, 16, 32)
    verify_cost: float = 16.0
    hot_documents: int = 4096
    pairs_per_document: int = 2
    hubs: tuple[int, ...] = (1, 2, 2)
    class_ratio: float = 1.1
    earlier: int = 32
    broadcast_nodes: int = 200_000


# So many characters of text are worked on at a time, so that the arrays of a task stay small.
RUN = 1 << 18


class Sets:
    """Shingle sets of the texts of a run: text number and shingle, distinct and in order."""

    def __init__(self, words: int):
        self.size, self.words = words, ByteWords(fold=True, most=2 * RUN)
        self.tables = powers(RunHashes.BASE, RUN)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shingles, distinct and ascending text by text; text number of each; size of each text's set."""
        h, bounds = self.words.of_texts(texts)
        count = np.diff(bounds)
        length = np.minimum(count, self.size)
        n = np.where(count > 0, count - length + 1, 0)
        text = np.repeat(np.arange(len(texts)), n)
        start = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + bounds[text]
        shingle = RunHashes(h, self.tables).of(start, length[text])
        order = np.lexsort((shingle, text))
        shingle, text = shingle[order], text[order]
        new = np.ones(len(text), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (text[1:] != text[:-1])
        shingle, text = shingle[new], text[new]
        return shingle, text, np.bincount(text, minlength=len(texts))


def nodes(shingle: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One number for each set, equal for equal sets."""
    sums = np.append(np.uint64(0), np.cumsum(mixed(shingle ^ np.uint64(0x94D049BB133111EB))))
    ends = np.cumsum(size)
    return mixed(sums[ends] - sums[ends - size] + size.astype(np.uint64)).view(np.int64)


def cell(shingle: np.ndarray, join: Join) -> np.ndarray:
    return (mixed(shingle ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(64 - join.cells_log2)).astype(np.int64)


@dataclass(frozen=True)
class Frequencies:
    """A level per cell: 0 where the count is what chance puts into a cell, then two levels per doubling."""

    level: np.ndarray
    least: float

    @staticmethod
    def of(counts: np.ndarray) -> Frequencies:
        usual = float(np.median(counts))
        least = 4 * np.sqrt(usual + 1)
        level = np.zeros(len(counts), np.uint8)
        # Few cells are above; the driver holds no array of floats for the others.
        high = np.flatnonzero(counts >= usual + least)
        level[high] = 1 + np.floor(2 * np.log2((counts[high] - usual) / least))
        return Frequencies(level, least)

    def documents(self, level: np.ndarray) -> np.ndarray:
        """About how many documents have a shingle of the level."""
        return np.where(level == 0, 1.0, self.least * 2.0 ** ((level.astype(float) - 1) / 2))


def read_sets(docs: DataFrame, join: Join) -> tuple[DataFrame, Frequencies]:
    """ref, doc_id, n_shingles, node and bits of each document; and how frequent shingles are."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, counts = Sets(join.words), np.zeros(1 << join.cells_log2, np.int64)
        for batch in batches:
            for at, texts in text_runs(batch.column("text"), RUN):
                shingle, text, size = sets.of(texts)
                np.add.at(counts, cell(shingle, join), 1)
                rows = batch.slice(at, len(texts))
                none = pa.nulls(len(texts), pa.int32()), pa.nulls(len(texts), pa.binary())
                told = pa.array(size, pa.int64()), pa.array(nodes(shingle, size)), bitmaps(shingle, text, size)
                columns = [rows.column("ref"), rows.column("doc_id"), *told, *none]
                yield pa.RecordBatch.from_arrays(columns, names=NAMES)
        for i, part in enumerate(np.split(counts, join.slices)):
            yield sketch_row(i, part)

    out = shared.written(docs.mapInArrow(read, SETS), "shingle-sets")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            for i, part in zip(batch.column("slice").to_pylist(), batch.column("counts"), strict=True):
                sums[i] = sums.get(i, 0) + unpacked_counts(part.as_py(), cells)
        for i, part in sums.items():
            yield sketch_row(i, part)

    # Added up in two levels, so that no task reads a row of every other: first the slices of neighbouring tasks.
    cells = (1 << join.cells_log2) // join.slices
    parts = out.filter("slice is not null").select(*NAMES, F.floor(F.spark_partition_id() / 16).alias("tasks"))
    parts = parts.repartition(shared.pieces_of_a_group(docs.sparkSession), "slice", "tasks").select(*NAMES).mapInArrow(add, SETS)
    rows = parts.repartition(join.slices, "slice").mapInArrow(add, SETS).select("slice", "counts").collect()
    counts = np.zeros((join.slices, cells), np.uint32)
    for r in rows:
        counts[r.slice] = np.minimum(unpacked_counts(r.counts, cells), 2**32 - 1)
    return out.filter("slice is null").select("ref", "doc_id", "n_shingles", "node", "bits"), Frequencies.of(counts.ravel())


SETS = "ref long, doc_id long, n_shingles long, node long, bits binary, slice int, counts binary"
NAMES = [c.split()[0] for c in SETS.split(", ")]


def sketch_row(i: int, part: np.ndarray) -> pa.RecordBatch:
    one = [*[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.binary()), pa.array([i], pa.int32()), pa.array([packed_counts(part)], pa.binary())]
    return pa.RecordBatch.from_arrays(one, names=NAMES)


def packed_counts(counts: np.ndarray) -> bytes:
    """One byte a cell; then the cells that have more, each with its count."""
    more = np.flatnonzero(counts > 255)
    small = counts.astype(np.uint8)
    small[more] = 0
    return small.tobytes() + np.stack([more, counts[more]], 1).astype("<i8").tobytes()


def unpacked_counts(packed: bytes, cells: int) -> np.ndarray:
    counts = np.frombuffer(packed, np.uint8, cells).astype(np.int64)
    at, more = np.frombuffer(packed, "<i8", offset=cells).reshape(-1, 2).T
    counts[at] = more
    return counts


FOLD_LOG2 = 9
FOLDED = [f"m{i}" for i in range((1 << FOLD_LOG2) // 64)]


def bitmaps(shingle: np.ndarray, text: np.ndarray, size: np.ndarray) -> pa.BinaryArray:
    """Of each set a bitmap of 512 to 2^20 bits, a power of two that is not below twice the set's size where it can be.

    A bit tells whether an odd number of the set's shingles falls on it. Halves of a bitmap, one
    upon the other, are the bitmap of half the length.
    """
    width = np.int64(1) << np.clip(np.ceil(np.log2(np.maximum(2 * size, 1))), FOLD_LOG2, 20).astype(np.int64)
    ends = np.cumsum(width)
    place = (mixed(shingle ^ np.uint64(0xD6E8FEB86659FD93)) & (width - 1).astype(np.uint64)[text]).astype(np.int64)
    odd = np.bincount((ends - width)[text] + place, minlength=int(width.sum())) & 1
    data = np.packbits(odd.astype(bool), bitorder="little")
    offsets = np.append(0, ends // 8).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def differing_bits(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """In how many bits the bitmaps of each pair differ, at the length of the shorter one: no more than the sets' shingles do."""
    long_a, long_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    out = np.zeros(len(a), np.int64)
    for la, lb in set(zip(long_a.tolist(), long_b.tolist(), strict=True)):
        at = np.flatnonzero((long_a == la) & (long_b == lb))
        width = min(la, lb)
        one, two = (
            np.bitwise_xor.reduce(np.frombuffer(b"".join([side[i] for i in at]), np.uint8).reshape(len(at), -1, width), axis=1) for side in (a, b)
        )
        out[at] = np.bitwise_count(one ^ two).sum(axis=1)
    return out


def folded(bits: DataFrame) -> DataFrame:
    """node, and its bitmap at the least length, as numbers of 64 bits."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                held = [np.bitwise_xor.reduce(np.frombuffer(x.as_py(), "<i8").reshape(-1, len(FOLDED))) for x in batch.column("bits")]
                yield pa.RecordBatch.from_arrays([batch.column("node"), *map(pa.array, np.stack(held, axis=1))], names=["node", *FOLDED])

    return bits.select("node", "bits").mapInArrow(read, ", ".join(f"{c} long" for c in ["node", *FOLDED]))


def chosen_lengths(size: np.ndarray, least: np.ndarray, cost: np.ndarray, join: Join) -> np.ndarray:
    """For each set the l with the least estimated cost; cost: what each shingle's posting list holds."""
    sums = np.append(0.0, np.cumsum(cost))
    start = np.cumsum(size) - size
    best = np.ones(len(size), np.int64)
    lowest = np.full(len(size), np.inf)
    for length in join.lengths:
        end = start + np.minimum(size - least + length, size)
        total = (sums[end] - sums[start]) * (1 + join.verify_cost / length)
        # Two similar sets share at least `least` shingles, so no more can be asked for.
        better = (total < lowest) & ((length <= least) | (length == 1))
        best[better], lowest[better] = length, total[better]
    return best


def prefixes(docs: DataFrame, frequent: Frequencies, join: Join) -> DataFrame:
    """token, node, info, hot: the prefix shingles of every document; info packs set size, layer and l.

    The layer of a shingle is the least l whose prefix it is in. Hot: thousands of documents may
    have it, so that its rows are better not sorted in one task.
    """
    sent = docs.sparkSession.sparkContext.broadcast((frequent.level.tobytes(), frequent.least))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(join.words)
        frequent = Frequencies(np.frombuffer(sent.value[0], np.uint8), sent.value[1])
        for batch in batches:
            for _, texts in text_runs(batch.column("text"), RUN):
                shingle, text, size = sets.of(texts)
                node = nodes(shingle, size)
                found = frequent.level[cell(shingle, join)]
                order = np.argsort(text << 8 | found, kind="stable")
                shingle, has = shingle[order], frequent.documents(found[order])
                least = -(-size * join.percent // 100)
                length = chosen_lengths(size, least, has, join)
                rank = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
                base = (size - least)[text]
                keep = rank < base + length[text]
                layer = np.maximum(rank - base + 1, 1)
                info = packed_info(size[text], reach(size[text], rank, join.percent), layer, length[text])
                columns = (shingle[keep].view(np.int64), node[text[keep]], info[keep], has[keep] >= join.hot_documents)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "node", "info", "hot"])

    return docs.select("text").mapInArrow(read, "token long, node long, info long, hot boolean")


# An info number: set size, reach (in 2^-15 of the size, rounded up), layer and l.
SIZE_BIT, REACH_BIT, REACH_UNIT = 32, 16, 1 << 15


def reach(size: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    """Largest set that a set can be linked with if the shingle of this rank is the first they share.

    Of the overlap that sizes n and m ask for, n - rank shingles must suffice.
    """
    return np.maximum((100 + percent) * (size - rank) // percent - size, 0)


def packed_info(size: np.ndarray, reach_: np.ndarray, layer: np.ndarray, length: np.ndarray) -> np.ndarray:
    share = np.minimum(-(-reach_ * REACH_UNIT // size), 2 * REACH_UNIT - 1)
    return size << SIZE_BIT | share << REACH_BIT | layer << 8 | length


def similar_sizes(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def short_pairs(token: np.ndarray, node: np.ndarray, info: np.ndarray, start: np.ndarray, join: Join):
    """All pairs of the lists that begin at ``start``; rows are sorted by token and node, lists are short."""
    a, b = [], []
    size = np.diff(np.append(start, len(token)))
    for i in range(join.short_list - 1):
        for j in range(i + 1, join.short_list):
            has = start[size > j]
            a.append(has + i)
            b.append(has + j)
    a, b = np.concatenate(a), np.concatenate(b)
    la, lb = info[a], info[b]
    need = np.minimum(la & 255, lb & 255)
    counts = (np.maximum(la >> 8 & 255, lb >> 8 & 255) <= need) & similar_sizes(la >> SIZE_BIT, lb >> SIZE_BIT, join.percent)
    a, b, need, la, lb = a[counts], b[counts], need[counts], la[counts] >> SIZE_BIT, lb[counts] >> SIZE_BIT
    # Beyond both prefixes there is room for so much of the overlap only; the rest must be met in them.
    overlap = -(-join.percent * (la + lb) // (100 + join.percent))
    need = need + overlap - np.maximum(-(-la * join.percent // 100), -(-lb * join.percent // 100))
    return node[a], node[b], need


LISTS = "a long, b long, need long, token long, info long"


def posting_lists(rows: DataFrame, join: Join) -> DataFrame:
    """Pairs of the short lists (a, b, need), and the rows (a, token, info) of the long ones."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
        held = none
        running = None  # a token whose list is known to be long and goes on

        def emit(token, node, info, hot, last: bool):
            """Rows of whole lists, but for the last one unless it ends here."""
            nonlocal running, held
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            token, node, info, hot = token[new], node[new], info[new], hot[new]
            start = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
            size = np.diff(np.append(start, len(token)))
            # A hot list is here in part only, so that its size says nothing.
            long_ = (size > join.short_list) | hot[start]
            if len(start) and running is not None and token[0] == running:
                long_[0] = True
            whole = np.ones(len(start), bool)
            if not last and len(start):
                if long_[-1]:
                    running = token[-1]
                    held = none
                else:
                    whole[-1] = False
                    held = [x[start[-1] :].copy() for x in (token, node, info, hot)]
            in_long = np.repeat(long_ & whole, size)
            pick = whole & ~long_ & (size > 1)
            rows = np.repeat(pick, size)
            t, n, i = token[rows], node[rows], info[rows]
            starts = np.flatnonzero(np.append(True, t[1:] != t[:-1])) if len(t) else np.zeros(0, np.int64)
            a, b, need = short_pairs(t, n, i, starts, join)
            k = int(in_long.sum())
            columns = [
                pa.array(np.concatenate([a, node[in_long]])),
                pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(k, pa.int64())]),
                pa.concat_arrays([pa.array(need, pa.int64()), pa.nulls(k, pa.int64())]),
                pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(token[in_long])]),
                pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(info[in_long])]),
            ]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in LISTS.split(", ")])

        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "node", "info", "hot")]
            some = [np.concatenate(x) for x in zip(held, new, strict=True)]
            held = none
            yield emit(*some, last=False)
        if len(held[0]):
            yield emit(*held, last=True)

    # A list that may be long is dealt by node as well; its pieces are long lists, whatever their size.
    pieces = shared.pieces_of_a_group(rows.sparkSession)
    piece = F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(pieces))).otherwise(0)
    dealt = rows.withColumn("piece", piece).repartition("token", "piece").sortWithinPartitions("token", "node")
    return dealt.select("token", "node", "info", "hot").mapInArrow(read, LISTS)


def ends(pairs: DataFrame) -> DataFrame:
    """The nodes of pairs, one row for each end."""
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))


def likely(pairs: DataFrame, bits: DataFrame, join: Join) -> DataFrame:
    """The pairs a, b whose bitmaps do not rule a link out; bits: node, n_shingles, bits."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            overlap = -(-join.percent * n // (100 + join.percent))
            fits = differing_bits(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist()) <= n - 2 * overlap
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(fits)) for c in ("a", "b")], names=["a", "b"])

    a, b = (bits.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    joined = pairs.select("a", "b").join(b, "b").join(a, "a")
    return joined.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(read, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, join: Join) -> DataFrame:
    """The pairs a, b whose whole sets are similar enough; texts: node, text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(join.words)
        for batch in batches:
            for at, left in text_runs(batch.column("text_a"), RUN):
                rows = batch.slice(at, len(left))
                right = rows.column("text_b").to_pylist()
                distinct = list(dict.fromkeys(left))
                shingle, _, size = sets.of(distinct)
                ends = np.cumsum(size)
                hubs = {t: shingle[ends[i] - size[i] : ends[i]] for i, t in enumerate(distinct)}
                shingle, _, size = sets.of(right)
                ends = np.cumsum(size)
                links = np.zeros(len(left), bool)
                for i, t in enumerate(left):
                    a, b = hubs[t], shingle[ends[i] - size[i] : ends[i]]
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    links[i] = 100 * both >= join.percent * (len(a) + len(b) - both)
                yield pa.RecordBatch.from_arrays([rows.column(c).filter(pa.array(links)) for c in ("a", "b")], names=["a", "b"])

    a, b = (texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return pairs.select("a", "b").join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(read, "a long, b long")


def links(docs: DataFrame, sets: DataFrame, frequent: Frequencies, join: Join) -> DataFrame:
    """node, label: components of the nodes that have a link."""
    rows = prefixes(docs, frequent, join)
    lists = shared.written(posting_lists(rows, join), "posting-lists")
    short = lists.filter("b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"), F.min("need").alias("need"))
    short = shared.written(short, "short-counts")
    candidates = short.filter("met >= need").select("a", "b")

    listed = lists.filter("b is null").select("token", F.col("a").alias("node"), "info")
    held = listed.groupBy("token").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    # How well a node is connected: the mean length of its lists, over all its prefix shingles.
    long_ = shared.written(listed.join(held, "token"), "long-lists")
    n, length = F.shiftright("info", SIZE_BIT), F.col("info").bitwiseAND(255)
    prefix = n - F.ceil(n * join.percent / 100) + length
    weight = long_.groupBy("node").agg((F.sum("size") / F.max(prefix)).alias("weight"))
    lists = long_.groupBy("node").agg(F.count(F.lit(1)).alias("lists"))
    # Rows so far down in a set that no set is within reach of them.
    reached = long_.filter(largest_partner(F.col("info")) * 100 >= join.percent * F.shiftright("info", SIZE_BIT))
    waiting = shared.written(reached.join(weight, "node").select("token", "node", "info", "weight"), "waiting-lists")

    # Pairs of the short lists that met there less often than they need, if the long lists both are in can make up for it.
    rest = short.filter("met < need")
    for end in "ab":
        rest = rest.join(lists.select(F.col("node").alias(end), F.col("lists").alias(f"lists_{end}")), end)
    rest = shared.written(rest.filter("met + least(lists_a, lists_b) >= need").select("a", "b"), "short-rest")

    wanted = ends(candidates.unionByName(rest)).unionByName(waiting.select("node")).distinct()
    bits = sets.join(wanted, "node").groupBy("node").agg(F.min_by(F.struct("n_shingles", "bits", "ref"), "ref").alias("one"))
    bits = shared.written(bits.select("node", "one.*"), "node-bits")
    affordable = join.pairs_per_document * sets.count()
    labels = tried = None
    turn = 0
    while True:
        # Only lists with several components wait, each node with its label.
        waiting_now = waiting.withColumn("label", F.col("node")) if labels is None else with_labels(waiting, labels)
        sizes = waiting_now.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
        pairs = sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
        last = turn >= len(join.hubs) or pairs <= affordable
        if last:
            asked = all_pairs(waiting_now, bits, join).unionByName(apart(rest, labels)).distinct()
        else:
            asked = hub_pairs(waiting_now, join, turn)
        if tried is None:
            asked = asked.unionByName(candidates).distinct()
        else:
            asked = asked.join(tried, ["a", "b"], "left_anti")
        asked = shared.written(asked, "candidates")
        tried = asked if tried is None else tried.unionByName(asked)
        new = shared.written(likely(asked, bits, join), "likely-links")
        none = new.isEmpty()
        if not none:
            new = shared.written(verified(new, texts_of(docs, bits, new, join), join), "links")
            none = new.isEmpty()
        if none and not last and turn:
            # Hubs bring no more together: what is left is drawn in full.
            turn = len(join.hubs)
            continue
        if labels is None or not none:
            labels = joined_by(labels, new)
        if last:
            break
        turn += 1
    return labels


def hub_pairs(waiting: DataFrame, join: Join, turn: int) -> DataFrame:
    """Each node with up to ``hubs`` nodes of other components that it may be linked with.

    A list offers its best connected nodes in the first round, others that a hash draws later on;
    of all that a node's lists offer, those count most that most of its lists do.
    """
    hubs = join.hubs[turn]
    best = Window.partitionBy("token").orderBy(*([F.desc("weight"), F.desc("node")] if turn == 0 else [F.xxhash64("token", "node", F.lit(turn)), "node"]))
    ranked = waiting.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= hubs)
    tops = shared.written(ranked.select("token", F.struct("node", "info", "label", "weight").alias("hub")), "hubs")
    met = waiting.drop("weight").join(tops, "token").filter("label <> hub.label")
    met = fitting(met.filter(in_reach(F.col("info"), F.col("hub.info"))), F.col("info"), F.col("hub.info"), join)
    met = met.groupBy("node", F.col("hub.node").alias("hub")).agg(F.count(F.lit(1)).alias("met"), F.max("hub.weight").alias("weight"))
    first = Window.partitionBy("node").orderBy(F.desc("met"), F.desc("weight"), F.desc("hub"))
    met = met.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= hubs)
    return met.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def all_pairs(waiting: DataFrame, bits: DataFrame, join: Join) -> DataFrame:
    """Pairs of nodes of different components whose first shared shingle may lie in a long list.

    Nodes meet by the shingle, their own size class and the class of the sizes that they can still
    be linked with from there on, so that those do not meet at all that stand too far down in one
    of the two sets. A row carries the first shingles of its set, as far as they stand before its
    own; two sets that share one of those have met there and need not meet again. It carries the
    folded bitmap, too: pairs of a shingle that it rules out are not made.
    """
    share = F.shiftright("info", REACH_BIT).bitwiseAND(2 * REACH_UNIT - 1)
    rows = waiting.select("token", "node", "info", "label", F.row_number().over(Window.partitionBy("node").orderBy(share.desc(), "token")).alias("place"))
    firsts = rows.filter(F.col("place") <= join.earlier).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("firsts"))
    firsts = firsts.select("node", F.transform("firsts", lambda x: x["token"]).alias("firsts"))
    before = F.slice("firsts", F.lit(1), F.least(F.col("place") - 1, F.lit(join.earlier))).alias("before")
    rows = rows.join(firsts, "node").join(folded(bits), "node").select("token", "node", "info", "label", before, *FOLDED)
    n = F.shiftright("info", SIZE_BIT)
    classes = {"own": size_class(n, join), "lo": size_class(F.ceil(n * join.percent / 100), join), "hi": size_class(largest_partner(F.col("info")), join)}
    rows = rows.withColumns(classes).filter("lo <= hi").withColumn("other", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")
    one = rows.filter("own <= other").select("token", F.col("own").alias("c1"), F.col("other").alias("c2"), "node", "info", "label", "before", *FOLDED)
    two = rows.filter("own >= other").select(
        "token", F.col("other").alias("c1"), F.col("own").alias("c2"), F.col("node").alias("n2"), F.col("info").alias("i2"), F.col("label").alias("l2"),
        F.col("before").alias("b2"), *[F.col(c).alias(f"{c}_2") for c in FOLDED],
    )
    met = one.join(two, ["token", "c1", "c2"]).filter("label <> l2 AND (c1 < c2 OR node < n2)").filter(in_reach(F.col("info"), F.col("i2")))
    met = fitting(met, F.col("info"), F.col("i2"), join, counted=False)
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_2"))) for c in FOLDED), F.lit(0))
    both = F.shiftright("info", SIZE_BIT) + F.shiftright("i2", SIZE_BIT)
    met = met.filter(differ <= both - 2 * F.ceil(both * join.percent / (100 + join.percent))).filter(~F.arrays_overlap("before", "b2"))
    return met.select(F.least("node", "n2").alias("a"), F.greatest("node", "n2").alias("b")).distinct()


def apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The pairs whose nodes are not in one component yet."""
    if labels is None:
        return pairs
    for end in "ab":
        pairs = pairs.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}")), end, "left")
    return pairs.filter("coalesce(label_a, a) <> coalesce(label_b, b)").select("a", "b")


def joined_by(labels: DataFrame | None, new: DataFrame) -> DataFrame:
    """The components (node, label) with those joined that new links hold together; only these links are gone through."""
    if labels is None:
        return components(new)
    links_ = new
    for end in "ab":
        known = labels.select(F.col("node").alias(end), F.col("label").alias("of"))
        links_ = links_.join(known, end, "left").withColumn(end, F.coalesce("of", end)).drop("of")
    tops = components(links_)
    ups = tops.select(F.col("node").alias("label"), F.col("label").alias("up"))
    known = labels.join(ups, "label", "left").select("node", F.coalesce("up", "label").alias("label"))
    return shared.written(known.unionByName(tops.join(labels.select("node"), "node", "left_anti").select("node", "label")), "joined-labels")


def size_class(size: Column, join: Join) -> Column:
    """Number of the size class; sizes of a class differ by less than ``class_ratio``."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / float(np.log(join.class_ratio))).cast("int")


def fitting(rows: DataFrame, one: Column, two: Column, join: Join, counted: bool = True) -> DataFrame:
    """Rows whose two sets have sizes that allow a link and, if ``counted``, for both of which the shingle counts."""
    n1, n2 = F.shiftright(one, SIZE_BIT), F.shiftright(two, SIZE_BIT)
    need = F.least(one.bitwiseAND(255), two.bitwiseAND(255))
    layer = F.greatest(F.shiftright(one, 8).bitwiseAND(255), F.shiftright(two, 8).bitwiseAND(255))
    fit = 100 * F.least(n1, n2) >= join.percent * F.greatest(n1, n2)
    return rows.filter(fit & (layer <= need) if counted else fit)


def largest_partner(info: Column) -> Column:
    """The largest set that can be linked with the row's set if this shingle is the first they share."""
    share = F.shiftright(info, REACH_BIT).bitwiseAND(2 * REACH_UNIT - 1)
    return F.floor(share * F.shiftright(info, SIZE_BIT) / F.lit(REACH_UNIT))


def in_reach(one: Column, two: Column) -> Column:
    """Whether the sets can be linked if this shingle is the first they share."""
    n1, n2 = F.shiftright(one, SIZE_BIT), F.shiftright(two, SIZE_BIT)
    r1, r2 = (F.shiftright(x, REACH_BIT).bitwiseAND(2 * REACH_UNIT - 1) for x in (one, two))
    return (n2 * REACH_UNIT <= r1 * n1) & (n1 * REACH_UNIT <= r2 * n2)


def with_labels(waiting: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of lists that hold two components or more, with each node's label."""
    rows = waiting.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = shared.written(rows, "labelled-lists")
    mixed_ = rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("token")
    return shared.written(rows.join(shared.written(mixed_, "mixed-lists"), "token"), "mixed-lists")


def texts_of(docs: DataFrame, bits: DataFrame, pairs: DataFrame, join: Join) -> DataFrame:
    """node and text of the nodes of the pairs; bits has each node's document (ref)."""
    one = shared.written(ends(pairs).distinct().join(bits.select("node", "ref"), "node"), "pair-nodes")
    # Few nodes are sent to the texts, so that only theirs are shuffled.
    found = docs.select("ref", "text").join(F.broadcast(one) if one.count() <= join.broadcast_nodes else one, "ref")
    return shared.written(found.groupBy("node").agg(F.first("text").alias("text")), "node-texts")


def grouped(df: DataFrame, id_col: str, text_col: str, join: Join) -> DataFrame:
    """ref, doc_id, n_shingles of each row, and the group of those that have company (else null)."""
    docs = keyed(df, id_col, text_col)
    sets, frequent = read_sets(docs, join)
    labels = links(docs, sets, frequent, join)
    rows = sets.filter("n_shingles > 0").groupBy("node").agg(F.count(F.lit(1)).alias("rows"))
    several = rows.join(labels, "node", "left").filter("rows > 1 or label is not null")
    several = shared.written(several.select("node", F.coalesce("label", "node").alias("group")), "grouped-nodes")
    return shared.written(sets.join(several, "node", "left").select("ref", "doc_id", "n_shingles", "group"), "grouped-rows")


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    return docs.select(F.xxhash64("doc_id", "text").alias("ref"), "doc_id", "text")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", join: Join = Join()) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id."""
    rows = grouped(df, id_col, text_col, join)
    least = rows.filter("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(shared.written(least, "component-ids"), "group", "left")
    own = F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", join: Join = Join()) -> DataFrame:
    """The input rows, all columns, with one row left of each group: that with the smallest identifier."""
    rows = grouped(df, id_col, text_col, join)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "ref")
    firsts = rows.filter("group is not null").groupBy("group").agg(F.min(order).alias("first")).select("first.ref")
    gone = rows.filter("group is not null").select("ref").join(shared.written(firsts, "group-firsts"), "ref", "left_anti")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ref_, n_ = shared.free_name(df, "_ref"), shared.free_name(df, "_n")
    marked = df.withColumn(ref_, F.xxhash64(F.col(id_col).cast("long"), text))
    left = marked.join(shared.written(gone.distinct(), "group-others").withColumnRenamed("ref", ref_), ref_, "left_anti")
    # Rows that agree in identifier and text are one document; those without words are no group.
    first = Window.partitionBy(ref_).orderBy(*[F.col(f"`{c}`") for c in df.columns if c != text_col])
    left = left.withColumn(n_, F.row_number().over(first))
    return left.filter((F.col(n_) == 1) | ~text.rlike(shared.WORD)).select(*[F.col(f"`{c}`") for c in df.columns])
