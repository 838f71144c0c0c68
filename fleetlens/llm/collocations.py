"""Phrase collocations, counted in HAT-tries.

Words are 64-bit ids; a phrase is the bytes of its words' ids, so that phrases sort by their words.
Each task counts into a trie over these ids, a few texts' equal phrases at a time (``batch``
occurrences): hash containers hang under a shallow trie, a container that grows past ``burst`` entries bursts by the next part of the path (first a byte of a word's id,
which many words share, then the whole id), and when the trie holds ``most`` entries whole subtrees
leave it, the largest first, each as a sorted run. Runs are merged per prefix partition: phrases whose
first words' ids begin alike. A word that holds more than one of the partitions' shares has several
of its own, by what follows, so that no prefix, however frequent, is one task's.

Counting goes up level by level. A phrase occurs at most as often as any part of it, so words that
are too rare are left out of pairs, and pairs that are too rare out of longer phrases. Tasks know
frequent words and pairs from bit filters of at most ``filter_bits_log2`` bits; what a full filter
lets through is counted for nothing, never missed. All other sums are Spark joins and groupings,
with decimals where 64 bits may not do.

Defined cases: null and empty texts have no words; a null language is ``und``, as is that name
itself; repeated rows count again; words and pieces of any length are read whole; equal scores go by
frequency, then by the phrase's bytes; a language without candidates, and an empty table, give no
rows; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm import shared
from fleetlens.llm.words import ByteWords, mixed, text_runs

BREAKS = b".,;:!?\n\x0b\x0c\r"
WORD_BYTES = re.compile(rb"[^\x20\x09.,;:!?\x0a-\x0d]+")
ID = 8


@dataclass(frozen=True)
class Mining:
    """percent: a phrase goes if a longer one around it has at least this share of its occurrences."""

    least: int = 30
    longest: int = 4
    percent: int = 80
    scale: int = 2_000_000
    best: int = 2000
    burst: int = 8192
    most: int = 600_000
    batch: int = 1 << 18
    pieces: int | None = None
    filter_bits_log2: int = 29


class PieceWords(ByteWords):
    """Word ids of texts, and the piece that each word lies in."""

    def __init__(self):
        super().__init__(fold=True)
        self.blank[list(BREAKS)] = True
        self.breaks = bytes(b in BREAKS for b in range(256))

    def of_pieces(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes, each word's id, first byte and piece; a text's end is a break."""
        raw = b"\n".join(t.encode() for t in texts)
        ids, start = self.of(raw)
        piece = np.cumsum(np.frombuffer(raw.translate(self.breaks), np.uint8), dtype=np.int32)[start] if len(start) else start
        return raw, ids, start, piece


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    """Texts of a batch, a bounded number of characters at a time, by language."""
    langs = batch.column("lang").to_pylist()
    for at, texts in text_runs(batch.column("text")):
        found: dict[str, list[str]] = {}
        for lang, text in zip(langs[at : at + len(texts)], texts, strict=True):
            found.setdefault(lang, []).append(text)
        yield from found.items()


def language_key(lang: str) -> np.uint64:
    import xxhash

    return np.uint64(xxhash.xxh3_64_intdigest(lang))


def phrase_keys(lang: np.ndarray | np.uint64, words: list[np.ndarray]) -> np.ndarray:
    """One 64-bit key for each language and row of words."""
    key = np.broadcast_to(lang, words[0].shape)
    for w in words:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + w)
    return key


# --- bit filters ---------------------------------------------------------------------------


def bit_places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    return [mixed(keys ^ np.uint64(salt)) % np.uint64(bits) for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179)]


@dataclass(frozen=True)
class BitFilter:
    """Which phrases may be frequent."""

    table: np.ndarray
    bits: int

    def has(self, keys: np.ndarray) -> np.ndarray:
        one, two = ((self.table[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 for p in bit_places(keys, self.bits))
        return (one & two).astype(bool)


def bit_filter(phrases: DataFrame, join: Mining) -> tuple[bytes, int]:
    """A filter of the phrases (columns lang, phrase, all of one length), built slice by slice by Spark."""
    slice_bits = 1 << 20
    bits = 1 << min(max(20, (16 * phrases.count()).bit_length()), join.filter_bits_log2)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.uint64] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            lang = np.array([known.setdefault(x, language_key(x)) for x in batch.column("lang").to_pylist()], np.uint64)
            words = np.frombuffer(b"".join(batch.column("phrase").to_pylist()), ">u8").astype(np.uint64).reshape(batch.num_rows, -1)
            at = np.concatenate(bit_places(phrase_keys(lang, list(words.T)), bits)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // slice_bits), pa.array(at % slice_bits)], names=["slice", "place"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            number, at = (batch.column(c).to_numpy() for c in ("slice", "place"))
            for s in np.unique(number).tolist():
                table = tables.setdefault(s, np.zeros(slice_bits // 8, np.uint8))
                here = at[number == s]
                np.bitwise_or.at(table, here >> 3, (1 << (here & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(tables), pa.int64()), pa.array([t.tobytes() for t in tables.values()], pa.binary())], names=["slice", "bits"]
        )

    dealt = phrases.select("lang", "phrase").mapInArrow(places, "slice long, place long").repartition("slice")
    table = np.zeros((bits // slice_bits, slice_bits // 8), np.uint8)
    for r in dealt.mapInArrow(fill, "slice long, bits binary").collect():
        table[r.slice] = np.frombuffer(r.bits, np.uint8)
    return table.tobytes(), bits


# --- counting ------------------------------------------------------------------------------


class HatTrie:
    """Counts of phrases (bytes); at most about ``most`` of them, then whole subtrees leave as sorted runs."""

    # Parts of a phrase that inner nodes branch by, from the root down: a byte of a word's id, then all of it.
    PATH = [slice(0, 1), slice(0, ID), slice(ID, ID + 1), slice(ID, 2 * ID)]

    def __init__(self, burst: int, most: int):
        self.burst, self.most, self.size = burst, most, 0
        self.roots: dict[str, Counter | dict] = {}

    def add(self, lang: str, phrases: list[bytes], more: Iterable[tuple[bytes, int]] = ()) -> Iterator[tuple[str, list[tuple[bytes, int]]]]:
        """Counts the phrases, and how often ``more`` has some of them again; yields the runs that had to leave."""
        phrases.sort()
        root = self.roots[lang] = self.into(self.roots.get(lang, Counter()), phrases, 0)
        for phrase, n in more:
            node = root
            for part in self.PATH:
                if isinstance(node, Counter):
                    break
                node = node[phrase[part]]
            node[phrase] += n
        if self.size > self.most:
            yield from self.spill(self.most // 2)

    def into(self, node: Counter | dict, phrases: list[bytes], level: int) -> Counter | dict:
        if isinstance(node, Counter):
            before = len(node)
            node.update(phrases)
            self.size += len(node) - before
            if len(node) <= self.burst or level == len(self.PATH):
                return node
            return self.burst_open(node, level)
        part = self.PATH[level]
        for step, some in groupby(phrases, lambda p: p[part]):
            node[step] = self.into(node.get(step, Counter()), list(some), level + 1)
        return node

    def burst_open(self, container: Counter, level: int) -> dict:
        part, node = self.PATH[level], {}
        for phrase, n in container.items():
            node.setdefault(phrase[part], Counter())[phrase] = n
        for step, child in node.items():
            if len(child) > self.burst and level + 1 < len(self.PATH):
                node[step] = self.burst_open(child, level + 1)
        return node

    def spill(self, left: int) -> Iterator[tuple[str, list[tuple[bytes, int]]]]:
        """Subtrees of the roots, the largest first, until at most ``left`` entries remain."""
        subtrees = []
        for lang, root in self.roots.items():
            if isinstance(root, Counter):
                subtrees.append((len(root), lang, None))
            else:
                subtrees += [(sum(map(len, containers(child))), lang, step) for step, child in root.items()]
        for size, lang, step in sorted(subtrees, key=lambda s: -s[0]):
            if self.size <= left:
                break
            gone = self.roots.pop(lang) if step is None else self.roots[lang].pop(step)
            self.size -= size
            # Containers come in the order of their phrases, so that only each of them is sorted.
            yield lang, [(p, c[p]) for c in containers(gone) for p in sorted(c)]


def containers(node: Counter | dict) -> Iterator[Counter]:
    if isinstance(node, Counter):
        yield node
    else:
        for step in sorted(node):
            yield from containers(node[step])


def counted(words: np.ndarray) -> tuple[list[bytes], list[int]]:
    """Phrases (rows of word ids) in about their order, and how often each stands there; one may come again."""
    # By most of the first word and a little of a hash of all, which one plain sort does.
    key = words[:, 0] >> np.uint64(24) << np.uint64(24) | phrase_keys(np.uint64(2), list(words.T)) >> np.uint64(40)
    words = words[np.argsort(key)]
    starts = np.flatnonzero(np.append(True, (words[1:] != words[:-1]).any(axis=1)))
    raw, size = words[starts].astype(">u8").tobytes(), words.shape[1] * ID
    return [raw[i : i + size] for i in range(0, len(raw), size)], np.diff(np.append(starts, len(words))).tolist()


RUNS = "lang string, part long, words int, firsts binary, sizes binary, rests binary, counts binary"


@dataclass(frozen=True)
class Parts:
    """Prefix partitions: words whose ids begin alike; each hot word has ``pieces`` partitions of its own."""

    bits: int
    hot: np.ndarray
    pieces: np.ndarray

    def of(self, words: np.ndarray) -> np.ndarray:
        """Partition of each phrase (rows of word ids)."""
        first = words[:, 0]
        part = (first >> np.uint64(64 - self.bits)).astype(np.int64)
        if len(self.hot):
            where = np.minimum(np.searchsorted(self.hot, first), len(self.hot) - 1)
            at = np.flatnonzero(self.hot[where] == first)
            piece = phrase_keys(np.uint64(1), list(words[at, 1:].T)) % self.pieces[where[at]]
            # Numbers above those of all plain partitions.
            part[at] = (mixed(first[at] + piece) >> np.uint64(2) | np.uint64(1 << 61)).astype(np.int64)
        return part


def run_rows(lang: str, run: list[tuple[bytes, int]], parts: Parts) -> pa.RecordBatch:
    """A sorted run, dealt to its prefix partitions. A first word stands once, with how many phrases go on from it;
    of the counts, only those above one are kept, and their phrases come last."""
    columns: list[list] = [[] for _ in range(7)]
    lengths = np.fromiter((len(p) for p, _ in run), np.int64, len(run)) // ID
    n = np.fromiter((n for _, n in run), np.int64, len(run))
    for size in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == size)
        words = np.frombuffer(b"".join(run[i][0] for i in at.tolist()), ">u8").astype(np.uint64).reshape(-1, size)
        part, times = parts.of(words), n[at]
        order = np.lexsort((words[:, 0], times > 1, part))
        words, part, times = words[order], part[order], times[order]
        edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist()
        for lo, hi in zip(edges, [*edges[1:], len(part)], strict=True):
            w, t = words[lo:hi], times[lo:hi]
            starts = np.flatnonzero(np.append(True, w[1:, 0] != w[:-1, 0]))
            sizes = np.diff(np.append(starts, len(w))).astype("<u4")
            row = (lang, int(part[lo]), size, w[starts, 0].tobytes(), sizes.tobytes(), w[:, 1:].tobytes(), t[t > 1].astype("<u4").tobytes())
            for column, value in zip(columns, row, strict=True):
                column.append(value)
    kinds = [pa.string(), pa.int64(), pa.int32()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in RUNS.split(", ")])


def merged_runs(rows: list[tuple], least: int) -> Iterator[tuple[bytes, int]]:
    """The frequent phrases of the runs of one partition."""
    for size in sorted({r[0] for r in rows}):
        words, counts = [], []
        for _, firsts, sizes, rests, more in (r for r in rows if r[0] == size):
            first = np.repeat(np.frombuffer(firsts, np.uint64), np.frombuffer(sizes, "<u4"))
            words.append(np.column_stack([first, np.frombuffer(rests, np.uint64).reshape(-1, size - 1)]))
            many = np.frombuffer(more, "<u4").astype(np.int64)
            counts.append(np.concatenate([np.ones(len(first) - len(many), np.int64), many]))
        words, counts = np.concatenate(words), np.concatenate(counts)
        key = phrase_keys(np.uint64(0), list(words.T))
        order = np.argsort(key, kind="stable")
        key, counts = key[order], counts[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.add.reduceat(counts, starts)
        often = n >= least
        raw = words[order[starts[often]]].astype(">u8").tobytes()
        for i, times in enumerate(n[often].tolist()):
            yield raw[i * size * ID : (i + 1) * size * ID], times


def phrase_counts(docs: DataFrame, orders: tuple[int, ...], frequent: tuple[bytes, int], parts: Parts, join: Mining) -> DataFrame:
    """lang, phrase, n of the frequent phrases of the orders.

    ``frequent`` is the filter of words if pairs are counted, else that of pairs.
    """
    sent = docs.sparkSession.sparkContext.broadcast(frequent)
    pairs_known = min(orders) > 2

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, trie = PieceWords(), HatTrie(join.burst, join.most)
        known = BitFilter(np.frombuffer(sent.value[0], np.uint8), sent.value[1])
        held: dict[tuple[str, int], list[np.ndarray]] = {}
        n_held = 0

        def count() -> Iterator[pa.RecordBatch]:
            for (lang, _), found in held.items():
                phrases, n = counted(np.concatenate(found))
                for at in range(0, len(phrases), 1 << 16):
                    some = slice(at, at + (1 << 16))
                    more = ((p, times - 1) for p, times in zip(phrases[some], n[some], strict=True) if times > 1)
                    for left, run in trie.add(lang, phrases[some], more):
                        yield run_rows(left, run, parts)
            held.clear()

        for batch in batches:
            for lang, texts in by_language(batch):
                _, ids, _, piece = words.of_pieces(texts)
                if len(ids) < 2:
                    continue
                joined = piece[1:] == piece[:-1]
                key = language_key(lang)
                if pairs_known:
                    joined &= known.has(phrase_keys(key, [ids[:-1], ids[1:]]))
                else:
                    has = known.has(phrase_keys(key, [ids]))
                    joined &= has[1:] & has[:-1]
                for order in orders:
                    n = len(ids) - order + 1
                    if n < 1:
                        continue
                    starts = np.flatnonzero(np.logical_and.reduce([joined[i : i + n] for i in range(order - 1)]))
                    if not len(starts):
                        continue
                    held.setdefault((lang, order), []).append(np.column_stack([ids[starts + i] for i in range(order)]))
                    n_held += len(starts)
                if n_held >= join.batch:
                    yield from count()
                    n_held = 0
        yield from count()
        for left, run in trie.spill(0):
            yield run_rows(left, run, parts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def merged() -> pa.RecordBatch:
            found = list(merged_runs(rows, join.least))
            columns = [pa.array([key[0] if key else None] * len(found), pa.string())]
            columns += [pa.array([p for p, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "n"])

        for batch in batches:
            for lang, part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, part) != key:
                    yield merged()
                    key, rows = (lang, part), []
                rows.append(tuple(row))
        yield merged()

    runs = docs.mapInArrow(read, RUNS).repartition("lang", "part").sortWithinPartitions("lang", "part")
    return shared.written(runs.mapInArrow(merge, "lang string, phrase binary, n long"), "phrases")


def word_counts(docs: DataFrame, most: int = 200_000) -> DataFrame:
    """lang, word, phrase (its id's bytes), n of every word."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = PieceWords()
        counts: dict[tuple[str, int], list] = {}

        def rows() -> pa.RecordBatch:
            ids = np.array([i for _, i in counts], np.uint64).astype(">u8").tobytes()
            columns = [
                pa.array([lang for lang, _ in counts], pa.string()),
                pa.array([w.lower().decode() for w, _ in counts.values()], pa.string()),
                pa.array([ids[i : i + ID] for i in range(0, len(ids), ID)], pa.binary()),
                pa.array([n for _, n in counts.values()], pa.int64()),
            ]
            counts.clear()
            return pa.RecordBatch.from_arrays(columns, names=["lang", "word", "phrase", "n"])

        for batch in batches:
            for lang, texts in by_language(batch):
                raw, ids, start, _ = words.of_pieces(texts)
                order = np.argsort(ids)
                first = np.flatnonzero(np.append(True, np.diff(ids[order]) != 0)) if len(ids) else order
                n = np.diff(np.append(first, len(ids)))
                for i, at, times in zip(ids[order[first]].tolist(), start[order[first]].tolist(), n.tolist(), strict=True):
                    if known := counts.get((lang, i)):
                        known[1] += times
                    else:
                        counts[lang, i] = [WORD_BYTES.match(raw, at)[0], times]
                if len(counts) > most:
                    yield rows()
        yield rows()

    found = docs.mapInArrow(read, "lang string, word string, phrase binary, n long")
    return found.groupBy("lang", "word", "phrase").agg(F.sum("n").alias("n"))


# --- scores --------------------------------------------------------------------------------


def exact(column: str) -> Column:
    return F.col(column).cast("decimal(25,0)")


def scored(candidates: DataFrame, counts: DataFrame, join: Mining) -> DataFrame:
    """lang, phrase, a, l, r, score: each candidate with its lowest-scoring cut."""
    order = F.length("phrase") / ID
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), (order - 1).cast("int"))))
    cuts = cuts.select(
        "lang", "phrase", F.col("n").alias("a"), "k",
        F.expr(f"substring(phrase, 1, k * {ID})").alias("left"), F.expr(f"substring(phrase, k * {ID} + 1)").alias("right"),
    )
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    # Both parts occur at least as often as the whole, so that a score is at most half the scale.
    cuts = cuts.withColumn("score", F.expr(f"CAST({join.scale} * CAST(a AS DECIMAL(25,0)) AS DECIMAL(38,0)) div (CAST(l AS DECIMAL(25,0)) + r)"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def standing(candidates: DataFrame, join: Mining) -> DataFrame:
    """The candidates that no longer candidate around them nearly always contains."""
    inner = F.expr(
        f"""flatten(transform(sequence(2, cast(length(phrase) / {ID} as int) - 1), m ->
            transform(sequence(0, cast(length(phrase) / {ID} as int) - m), i -> substring(phrase, i * {ID} + 1, m * {ID}))))"""
    )
    longer = candidates.filter(F.length("phrase") > 2 * ID).select("lang", F.explode(inner).alias("phrase"), F.col("n").alias("around"))
    most = longer.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    kept = 100 * exact("around") < join.percent * exact("n")
    return candidates.join(most, ["lang", "phrase"], "left").filter(F.col("around").isNull() | kept).drop("around")


def best_of(rows: DataFrame, words: DataFrame, join: Mining) -> DataFrame:
    """The first ``best`` rows of each language, with their text and rank.

    How many rows have each score and frequency tells where a language's list ends; only rows up to
    there, ties included, are given their text and sorted.
    """
    order = [F.desc("score"), F.desc("a")]
    per = shared.written(rows.groupBy("lang", "score", "a").agg(F.count(F.lit(1)).alias("rows")), "phrase-scores")
    before = Window.partitionBy("lang").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = per.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).filter(F.col("before") < join.best)
    rows = shared.written(rows.join(inside.select("lang", "score", "a"), ["lang", "score", "a"]), "phrase-best")
    order_of = F.sequence(F.lit(0), (F.length("phrase") / ID - 1).cast("int"))
    single = rows.select("lang", "phrase", F.explode(order_of).alias("i"))
    single = single.withColumn("word_id", F.expr(f"substring(phrase, i * {ID} + 1, {ID})"))
    single = single.join(words.select("lang", F.col("phrase").alias("word_id"), "word"), ["lang", "word_id"])
    text = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]))
    named = rows.join(single.groupBy("lang", "phrase").agg(text.alias("text")), ["lang", "phrase"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "text"))
    return named.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= join.best)


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", join: Mining = Mining()) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    docs = df.select(lang.alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = shared.written(word_counts(docs), "phrase-words")
    frequent = shared.written(words.filter(F.col("n") >= join.least), "frequent-words")
    totals = shared.written(words.groupBy("lang").agg(F.sum("n").alias("n")), "language-words")
    # Words that hold more than one of ``pieces`` parts of all words (there cannot be more than that many) get
    # as many partitions as their share asks for.
    all_words = totals.agg(F.sum("n")).first()[0] or 0
    pieces = join.pieces or shared.pieces_of_a_group(df.sparkSession)
    hot = frequent.groupBy("phrase").agg(F.sum("n").alias("n")).filter(F.col("n") * pieces >= all_words).collect()
    hot = sorted((int.from_bytes(r.phrase, "big"), -(-r.n * pieces // all_words)) for r in hot)
    parts = Parts((pieces - 1).bit_length(), np.array([w for w, _ in hot], np.uint64), np.array([n for _, n in hot], np.uint64))
    pairs = phrase_counts(docs, (2,), bit_filter(frequent, join), parts, join)
    candidates = pairs
    if join.longest > 2:
        candidates = pairs.unionByName(phrase_counts(docs, tuple(range(3, join.longest + 1)), bit_filter(pairs, join), parts, join))
    counts = frequent.select("lang", "phrase", "n").unionByName(candidates)
    rows = shared.written(scored(standing(candidates, join), counts, join), "phrase-cuts")
    out = best_of(rows, frequent, join).join(totals, "lang")
    return out.select("lang", "rank", F.col("text").alias("phrase"), "a", "l", "r", "n", "score")
