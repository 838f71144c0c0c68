"""Repeated passages, by suffixes filed under prefixes and told apart level by level (no tree is built).

A word is removed if it lies in a window of ``window`` words that also starts elsewhere in the
corpus. Windows are the suffixes of the texts, cut at the depth that counts. Four steps find them:

1. Each window names the 8-word prefix under which its suffix is filed: of the 8-word runs inside it
   the one with the least hash, so that equal windows choose equally. Neighbouring windows share
   their choice; what they cover together is a span. One small row leaves per span.
2. Prefixes that occur once are dropped. Spans that agree in full are counted before the shuffle:
   with two or more, all their windows are repeats.
3. Prefixes with several different spans are subtrees. One copy of each span comes back with its
   words; suffixes are grouped level by level (12, 24, all words), lone ones drop out, and what is
   left at full depth are the deep internal nodes. Prefixes with more spans than fit a group are
   lengthened to the whole window, which Spark counts without a tree.
4. The covered words go back to the documents by a key of identifier and text.

A document is read twice and shuffled once. Hashes have 64 bits; two are compared for each window.

Defined cases: null and empty texts have no words and the digest of the empty string; repeated rows
repeat one another; a null identifier is an identifier like others; texts of any length are read
whole, a bounded number of words at a time; an empty table gives an empty result; other columns are
not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import shared
from fleetlens.llm.words import ByteWords, RunHashes, mixed, powers, text_runs

PREFIX = 8
CHUNK = 1 << 20
LEVELS = (12, 24)
GROUP_SPANS = 1000


def spans(h: np.ndarray, bounds: np.ndarray, window: int, tables) -> tuple[np.ndarray, ...]:
    """prefix, span, text number, place of each span of the texts whose words are given.

    A place packs the first window's word number, how many windows follow, and the prefix's offset.
    """
    found = []
    for at in range(0, max(len(h) - window + 1, 0), CHUNK):
        part = h[at : at + CHUNK + window - 1]
        runs = RunHashes(part, tables)
        prefix = runs.of(np.arange(len(part) - PREFIX + 1), PREFIX)
        # The least of the hashes, ties to the first: hash above, place below.
        least = (prefix & ~np.uint64((1 << 24) - 1)) | np.arange(len(prefix), dtype=np.uint64)
        width, step = window - PREFIX + 1, 1
        while step * 2 <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < width:
            least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
        anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        text = np.searchsorted(bounds, np.arange(at, at + len(part)), side="right") - 1
        whole = np.flatnonzero(text[: len(anchor)] == text[window - 1 :])
        if not len(whole):
            continue
        chosen = anchor[whole]
        # A new span where the choice, or the text, changes.
        new = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (np.diff(whole) != 1)))
        first = whole[new]
        more = np.append(new[1:], len(whole)) - new - 1
        offset = chosen[new] - first
        shape = (more << 8 | offset).astype(np.uint64)
        whole_span = mixed(runs.of(first, more + window) + shape * np.uint64(0x9E3779B97F4A7C15))
        place = (first + at - bounds[text[first]]) << 16 | more << 8 | offset
        found.append((prefix[chosen[new]], whole_span, text[first], place))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def span_rows(docs: DataFrame, window: int, counted: bool) -> DataFrame:
    """A row per span, or per distinct span of a run of texts with its count and one place."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tables = ByteWords(), powers(RunHashes.BASE, CHUNK + window)
        for batch in batches:
            refs = batch.column("ref").to_numpy(zero_copy_only=False)
            for at, texts in text_runs(batch.column("text")):
                prefix, span, text, place = spans(*words.of_texts(texts), window, tables)
                n = np.ones(len(span), np.int64)
                if counted:
                    _, one, n = np.unique(span, return_index=True, return_counts=True)
                    prefix, span, text, place = prefix[one], span[one], text[one], place[one]
                columns = (prefix.view(np.int64), span.view(np.int64), refs[at + text], place, n)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["prefix", "span", "ref", "place", "n"])

    return docs.select("ref", "text").mapInArrow(read, "prefix long, span long, ref long, place long, n long")


def span_words(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The words of the wanted spans: prefix, ref, place, n, words."""
    asked = wanted.groupBy("ref").agg(F.collect_set(F.struct("prefix", "place", "n")).alias("asked"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ref, text, some in zip(*(batch.column(c) for c in ("ref", "text", "asked")), strict=True):
                ref, words = ref.as_py(), text.as_py().encode().split()
                for x in some.as_py():
                    at, more = x["place"] >> 16, x["place"] >> 8 & 255
                    out.append((x["prefix"], ref, x["place"], x["n"], b" ".join(words[at : at + more + window])))
                if len(out) >= 5000:
                    yield rows(out)
                    out = []
            yield rows(out)

    def rows(out):
        columns = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.int64()] * 4 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["prefix", "ref", "place", "n", "words"])

    joined = docs.join(asked, "ref").select("ref", "doc_id", "text", "asked")
    return joined.mapInArrow(read, "prefix long, ref long, place long, n long, words binary")


def suffixes(words: ByteWords, texts: list[bytes], places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, RunHashes]:
    """Every window of the spans: its span, its number in the span, its first word; and run hashes."""
    h, start = words.of(b" ".join(texts))
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.searchsorted(start, np.cumsum(size + 1) - (size + 1))
    count = (places >> 8 & 255) + 1
    span = np.repeat(np.arange(len(texts)), count)
    number = np.arange(len(span)) - np.repeat(np.cumsum(count) - count, count)
    return span, number, first[span] + number, RunHashes(h)


def shared_suffixes(prefix: np.ndarray, places: np.ndarray, texts: list[bytes], window: int, words: ByteWords):
    """Windows of the spans that another span of the same prefix has too: span and number.

    Level by level, the suffixes below a node are told apart by their next words; leaves drop out.
    """
    span, number, at, runs = suffixes(words, texts, places)
    # The prefix stands at the same offset in equal windows.
    offset = (places[span] & 255) - number
    node = mixed(prefix[span] + offset.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for depth in (0, *LEVELS, window):
        if depth:
            node = mixed(node ^ runs.of(at, depth))
        _, back, count = np.unique(node, return_inverse=True, return_counts=True)
        inner = count[back] > 1
        span, number, at, node = span[inner], number[inner], at[inner], node[inner]
    return span, number


def covered_ranges(span: np.ndarray, number: np.ndarray, refs: np.ndarray, places: np.ndarray, window: int):
    """ref, first and end word of each run of windows; windows come in order within a span."""
    if not len(span):
        return refs[:0], places[:0], places[:0]
    order = np.lexsort((number, span))
    span, number = span[order], number[order]
    new = np.flatnonzero(np.append(True, (np.diff(span) != 0) | (np.diff(number) != 1)))
    last = np.append(new[1:], len(span)) - 1
    at = places[span[new]] >> 16
    return refs[span[new]], at + number[new], at + number[last] + window


RANGES = "ref long, first long, end long"


def tree_ranges(found: DataFrame, window: int, rows_at_once: int = 2000) -> DataFrame:
    """Ranges that the subtrees give for spans that occur once; a group lies in one task, in order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ByteWords()
        held: pa.Table | None = None

        def ranges(rows: pa.Table):
            prefix, refs, places, n = (rows.column(c).to_numpy() for c in ("prefix", "ref", "place", "n"))
            span, number = shared_suffixes(prefix.astype(np.uint64), places, rows.column("words").to_pylist(), window, words)
            once = n[span] == 1
            columns = covered_ranges(span[once], number[once], refs, places, window)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["ref", "first", "end"])

        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            while held.num_rows >= rows_at_once:
                prefix = held.column("prefix").to_numpy()
                ends = np.flatnonzero(prefix[1:] != prefix[:-1]) + 1
                ends = ends[: max(1, int(np.searchsorted(ends, rows_at_once, side="right")))]
                if not len(ends):
                    break
                yield ranges(held.slice(0, int(ends[-1])))
                held = held.slice(int(ends[-1]))
        if held is not None and held.num_rows:
            yield ranges(held)

    return found.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(read, RANGES)


def crowded_ranges(found: DataFrame, window: int) -> DataFrame:
    """Ranges of spans whose prefix is lengthened to the whole window, which is then only counted."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ByteWords()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                prefix, refs, places, n = (some.column(c).to_numpy() for c in ("prefix", "ref", "place", "n"))
                span, number, first, runs = suffixes(words, some.column("words").to_pylist(), places)
                columns = (prefix[span], runs.of(first, window).view(np.int64), refs[span], (places[span] >> 16) + number, n[span])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["prefix", "whole", "ref", "first", "n"])

    windows = found.mapInArrow(read, "prefix long, whole long, ref long, first long, n long")
    windows = shared.written(windows, "long-prefixes")
    repeats = windows.groupBy("prefix", "whole").agg(F.count(F.lit(1)).alias("windows")).filter("windows > 1").drop("windows")
    repeats = shared.written(repeats, "repeated-windows")
    once = windows.filter("n = 1").join(repeats, ["prefix", "whole"])
    return once.select("ref", "first", (F.col("first") + window).alias("end"))


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, group_spans: int = GROUP_SPANS) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, text (the kept words)."""
    if not max(LEVELS) < window <= 255:
        raise ValueError("a window has 25 to 255 words")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("ref", F.xxhash64("doc_id", "text"))

    # The counted rows of a prefix meet in one partition, so spans and prefixes are told apart with one shuffle.
    counted = span_rows(docs, window, counted=True).repartition("prefix")
    distinct = counted.groupBy("prefix", "span").agg(F.sum("n").alias("n"), F.min(F.struct("ref", "place")).alias("one"))
    by_prefix = distinct.groupBy("prefix").agg(F.count(F.lit(1)).alias("spans"), F.sum("n").alias("all"))
    # (A prefix with one span that occurs once is unique; so are most.)
    known = distinct.join(by_prefix.filter("all > 1"), "prefix")
    known = shared.written(known.select("prefix", "span", "n", "spans", "one.ref", "one.place"), "repeated-prefixes")

    whole = span_rows(docs, window, counted=False).drop("n").join(known.filter("n > 1").select("prefix", "span"), ["prefix", "span"])
    start = F.shiftright("place", 16)
    more = F.shiftright("place", 8).bitwiseAND(255)
    ranges = whole.select("ref", start.alias("first"), (start + more + window).alias("end"))
    several = known.filter("spans > 1")
    ranges = ranges.unionByName(tree_ranges(span_words(docs, several.filter(F.col("spans") <= group_spans), window), window))
    crowded = several.filter(F.col("spans") > group_spans)
    if not crowded.isEmpty():
        ranges = ranges.unionByName(crowded_ranges(span_words(docs, crowded, window), window))
    return applied(docs, ranges)


def applied(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Takes the ranges out of the documents."""
    by_doc = ranges.groupBy("ref").agg(F.collect_set(F.struct("first", "end")).alias("ranges"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in text_runs(batch.column("text")):
                rows = batch.slice(at, len(texts))
                out = []
                for text, some in zip(texts, rows.column("ranges"), strict=True):
                    words, some = text.encode().split(), some.as_py()
                    kept = words
                    if some:
                        gone = np.zeros(len(words) + 1, np.int64)
                        np.add.at(gone, [x["first"] for x in some], 1)
                        np.add.at(gone, [x["end"] for x in some], -1)
                        kept = [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0)]
                    joined = b" ".join(kept)
                    out.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()))
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "text"],
                )

    joined = docs.join(by_doc, "ref", "left").select("ref", "doc_id", "text", "ranges")
    return joined.mapInArrow(read, "doc_id long, n_words long, n_removed long, kept_sha256 string, text string")
