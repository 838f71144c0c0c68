"""Spelling variants: words one edit apart, by dynamic programming over sorted lists.

Words are counted by Spark. Two words that differ by one edit agree in their first or in their last
half; so each word is filed under its halves, once for each length that the shorter word of a pair
may have, and pairs meet within such a group only. A group that is still large is divided in the
same way, by halves of what its words do not share, until it is small or one character is left
free, where no more words fit than the alphabet allows. Nobody sees the whole vocabulary.

Within a group the free parts are sorted. For each query they are scanned in order with the rows of
the banded edit matrix on a stack: a word goes on from the rows of the prefix it shares with the
word before (their LCP), and where a row has no cell of one edit or less, all words that share that
prefix are skipped. Groups are read as sorted streams, one group in memory at a time.

Defined cases: null and empty texts have no words; a null identifier deletes nothing; repeated rows
count again; ties between forms go to the smaller word; words of any length are compared whole; an
empty table gives an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import string
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import shared

LETTERS = "a-zÀ-ÿ"
GROUP_WORDS = 64


def misspelt(doc_id, run, every: int):
    """The run, less one character where the checksum of identifier and run says so."""
    h = F.crc32(F.concat_ws(":", doc_id.cast("string"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    less = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + F.lit(2)))
    return F.when(doc_id.isNotNull() & (h % every == 0), less).otherwise(run)


def word_counts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_count: int = 3, every: int = 97
) -> DataFrame:
    """word, n of all words long and frequent enough."""
    low = F.translate(F.col(text_col).cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    runs = df.select(F.col(id_col).alias("doc_id"), F.explode(F.regexp_extract_all(low, F.lit(f"([{LETTERS}]+)"))).alias("run"))
    words = runs.filter(F.length("run") >= least_length).select(misspelt(F.col("doc_id"), F.col("run"), every).alias("word"))
    words = words.filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def next_rows(above: tuple[int, int, int], depth: int, char: str, query: str) -> tuple[int, int, int]:
    """The band of the edit matrix (query positions depth-1, depth, depth+1) one character deeper; 2 stands for more."""
    size = len(query)
    out, left = [], 2
    for k in (-1, 0, 1):
        j = depth + k
        if j < 0 or j > size:
            cost = 2
        else:
            # Cells of the row above, whose band begins one position further left.
            replaced = above[k + 1] + (query[j - 1] != char) if j else 2
            inserted = above[k + 2] + 1 if k < 1 else 2
            cost = min(replaced, inserted, left + 1, 2)
        out.append(cost)
        left = cost
    return tuple(out)


def near(query: str, words: list[str], lcp: list[int]) -> Iterator[int]:
    """Numbers of the sorted words that are one edit from the query; lcp[i]: what word i shares with the one before."""
    # Row 0: the empty prefix against positions -1, 0, 1 of the query.
    rows = [(2, 0, 1 if query else 2)]
    i, share, n = 0, 0, len(words)
    while i < n:
        word = words[i]
        del rows[share + 1 :]
        depth = len(rows) - 1
        while depth < len(word) and min(rows[-1]) < 2:
            rows.append(next_rows(rows[-1], depth + 1, word[depth], query))
            depth += 1
        if min(rows[-1]) > 1:
            # No word with this prefix can be near; the list goes on behind them.
            i = bisect_left(words, word[:depth] + chr(0x10FFFF), i + 1)
            share = common(word, words[i]) if i < n else 0
            continue
        k = len(query) - len(word)
        if -1 <= k <= 1 and rows[-1][k + 1] == 1:
            yield i
        i += 1
        share = lcp[i] if i < n else 0


def common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def group_pairs(words: list[str], counts: list[int], size: int, head: int, tail: int) -> Iterator[tuple[str, str, int]]:
    """word, near word and its count for the pairs of a group whose shorter word has ``size`` characters."""
    free = sorted((w[head : len(w) - tail], i) for i, w in enumerate(words))
    parts = [f for f, _ in free]
    lcp = [0] + [common(a, b) for a, b in zip(parts, parts[1:], strict=False)]
    for query, i in free:
        if len(words[i]) != size:
            continue
        for at in near(query, parts, lcp):
            j = free[at][1]
            yield words[i], words[j], counts[j]
            if len(words[j]) > size:
                yield words[j], words[i], counts[i]


KEY = ["size", "head", "tail", "first", "last"]
PAIRS = "word string, near string, near_n long"


def filed(words: DataFrame, least_length: int, group_words: int) -> DataFrame:
    """Each word under all its groups: columns word, n and KEY (head and tail characters are shared by the group)."""
    length = F.length("word")
    sizes = F.filter(F.array(length - 1, length), lambda m: m >= least_length)
    by_size = words.select("word", "n", F.explode(sizes).alias("size"))
    half = F.floor(F.col("size") / 2).cast("int")
    sides = F.array(
        F.struct(half.alias("head"), F.lit(0).alias("tail")), F.struct(F.lit(0).alias("head"), (F.col("size") - half).alias("tail"))
    )
    rows = shared.written(keyed(by_size.withColumn("side", F.explode(sides))), "spelling-groups")
    out = None
    while True:
        # Lists of one word have no pairs.
        sizes = shared.written(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("words")).filter("words > 1"), "spelling-sizes")
        large = (F.col("words") > group_words) & (F.col("size") - F.col("head") - F.col("tail") > 1)
        here = rows.join(sizes.filter(~large).select(*KEY), KEY, "left_semi")
        out = here if out is None else out.unionByName(here)
        crowded = sizes.filter(large)
        if crowded.isEmpty():
            return out
        left = F.col("size") - F.col("head") - F.col("tail")
        near_half = F.floor(left / 2).cast("int")
        sides = F.array(
            F.struct((F.col("head") + near_half).alias("head"), F.col("tail")),
            F.struct(F.col("head"), (F.col("tail") + left - near_half).alias("tail")),
        )
        again = rows.join(crowded.select(*KEY), KEY, "left_semi").withColumn("side", F.explode(sides))
        rows = shared.written(keyed(again), "spelling-groups")


def keyed(rows: DataFrame) -> DataFrame:
    head, tail = F.col("side.head"), F.col("side.tail")
    first = F.substr("word", F.lit(1), head)
    last = F.substr(F.col("word"), F.length("word") - tail + F.lit(1), tail)
    return rows.select("word", "n", "size", head.alias("head"), tail.alias("tail"), first.alias("first"), last.alias("last"))


def near_words(words: DataFrame, least_length: int = 5, group_words: int = GROUP_WORDS) -> DataFrame:
    """word, near, near_n: all ordered pairs of words that are one edit apart."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, found = None, [], []

        def pairs():
            if len(group) > 1:
                found.extend(group_pairs([w for w, _ in group], [n for _, n in group], *key[:3]))

        def rows():
            out = pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in found], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))],
                names=["word", "near", "near_n"],
            )
            found.clear()
            return out

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*KEY, "word", "n")]
            for *this, word, n in zip(*columns, strict=True):
                if this != key:
                    pairs()
                    key, group = this, []
                    if len(found) > 50_000:
                        yield rows()
                group.append((word, n))
        pairs()
        yield rows()

    groups = filed(words, least_length, group_words)
    return groups.repartition(*KEY).sortWithinPartitions(*KEY, "word").mapInArrow(scan, PAIRS).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of the forms that follow one another; paths double in length with each round."""
    steps = shared.written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        above = steps.select(F.col("word").alias("root"), F.col("root").alias("above"))
        steps = steps.join(above, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
        steps = shared.written(steps, "spelling-roots")
        if steps.filter("moved").isEmpty():
            return steps.drop("moved")
        steps = steps.drop("moved")


def variants(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_length: int = 5,
    least_count: int = 3,
    ratio: int = 2,
    every: int = 97,
    group_words: int = GROUP_WORDS,
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    A word's form is the most frequent word one edit away (ties: the smaller), if it is at least
    ``ratio`` times as frequent; its root the last word that forms lead to.
    """
    words = shared.written(word_counts(df, id_col, text_col, least_length, least_count, every), "spelling-words")
    pairs = near_words(words, least_length, group_words)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    best = best.select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))
    rows = shared.written(words.join(best, "word", "left"), "spelling-forms")
    has = F.col("form_n") >= ratio * F.col("n")
    ends = roots(rows.filter(has).select("word", "form"))
    return rows.join(ends, "word", "left").select(
        "word",
        F.when(has, F.col("form")).alias("form"),
        F.coalesce("root", "word").alias("root"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, F.col("form_n")).alias("form_n"),
    )
