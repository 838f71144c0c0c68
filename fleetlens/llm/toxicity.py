"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its words, its pairs of neighbours, its pairs with one word between and the
beginnings of its words (which tie inflected forms together), each counted once and hashed. Learning keeps a rate per coordinate; L1 leaves few weights, and only those
are sent to the tasks. Words are lower-cased and stripped of ASCII signs and digits, so decoration
around a word does not hide it.

The model is fitted on at most ``train_rows`` labelled rows, the first in the order of a hash of
doc_id; every row is scored over its whole text.

Defined cases: null and empty texts score the model's base rate; a repeated doc_id is scored on each
of its rows; a doc_id that is labelled twice counts as toxic if one label says so; without labelled
rows every score is 0.5; other columns are not looked at.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import shared
from fleetlens.llm.words import WordHashes, mixed, slices

BITS = 21
SIGNS = bytes(b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122))


STEMS = (4, 6)


class Features:
    """Hashed features of a text: words, pairs of neighbours, pairs around one word, beginnings of words."""

    def __init__(self, bits: int = BITS):
        self.words, self.bits = WordHashes(fold=True, drop=SIGNS), bits

    def of(self, text: str | None) -> np.ndarray:
        parts, stems = [], set()
        for part in slices(text or ""):
            words = self.words.split(part)
            parts.append(self.words.of_words(words))
            stems.update(w[:n] for w in set(words) for n in STEMS)
        words = np.concatenate(parts)
        found = [words, self.words.of_words(list(stems)) ^ np.uint64(0x3C6EF372FE94F82B)]
        for gap, salt in ((1, 0x51ED270B), (2, 0x2545F491)):
            if len(words) > gap:
                found.append(mixed(words[:-gap] * np.uint64(0x9E3779B97F4A7C15) + words[gap:] + np.uint64(salt)))
        return (mixed(np.concatenate(found)) >> np.uint64(64 - self.bits)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Sparse weights and the base."""

    index: np.ndarray
    weight: np.ndarray
    base: float
    bits: int = BITS


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.5
    epochs: int = 4
    seed: int = 7

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        over = np.abs(z) - self.l1
        return np.where(over > 0, -np.sign(z) * over / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def fit(self, rows: Sequence[tuple[np.ndarray, int]], bits: int = BITS) -> Model:
        """rows: distinct features and label of each example."""
        if not rows:
            return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, bits)
        rate = min(max(np.mean([y for _, y in rows]), 1e-4), 1 - 1e-4)
        base = base0 = float(np.log(rate / (1 - rate)))
        z, n, base_n = np.zeros(1 << bits), np.zeros(1 << bits), 1.0
        order = np.random.default_rng(self.seed)
        for _ in range(self.epochs):
            for i in order.permutation(len(rows)):
                at, y = rows[i]
                zi, ni = z[at], n[at]
                w = self.weights(zi, ni)
                g = 1 / (1 + np.exp(-np.clip(w.sum() + base, -35, 35))) - y
                root = np.sqrt(ni + g * g)
                z[at] = zi + g - (root - np.sqrt(ni)) / self.alpha * w
                n[at] = ni + g * g
                base_n += g * g
                base -= self.alpha / np.sqrt(base_n) * (g + 0.01 * (base - base0))
        # All other weights are 0; whole tables of intermediate results would be several times z and n.
        at = np.flatnonzero((z > self.l1) | (z < -self.l1))
        w = self.weights(z[at], n[at])
        at, w = at[w != 0], w[w != 0]
        return Model(at, w.astype(np.float32), float(base), bits)


class Examples(Sequence):
    """Examples in the order of their identifiers, features of all in one buffer: thousands of pieces
    of memory among other objects would stay with the driver when the model is made."""

    def __init__(self, rows: Iterable[tuple[int, int, bytes]]):
        self.data, ids, labels, sizes = bytearray(), array("q"), array("i"), array("q")
        for id_, y, at in rows:
            self.data += at
            ids.append(id_)
            labels.append(y)
            sizes.append(len(at))
        self.ends = np.cumsum(np.array(sizes, np.int64))
        self.starts = self.ends - np.array(sizes, np.int64)
        self.labels = np.array(labels, np.int64)
        self.order = np.lexsort((self.labels, np.array(ids, np.int64)))

    def __len__(self) -> int:
        return len(self.order)

    def __getitem__(self, i: int) -> tuple[np.ndarray, int]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        k = self.order[i]
        return np.frombuffer(self.data, "<i4", (self.ends[k] - self.starts[k]) // 4, self.starts[k]), int(self.labels[k])


def fit(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train_rows: int, ftrl: Ftrl) -> Model:
    """The model of the labelled rows outside the held-out fold; at most ``train_rows`` of them reach the driver."""
    usable = labels.filter(~shared.held_out(id_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    usable = usable.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    usable = usable.orderBy(F.xxhash64("_id"), "_id", F.desc("_y")).limit(train_rows).groupBy("_id").agg(F.max("_y").alias("_y"))
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [np.unique(features.of(t.as_py())).astype("<i4").tobytes() for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").cast(pa.int64()), batch.column("_y").cast(pa.int32()), pa.array(found, pa.binary())],
                names=["id", "y", "at"],
            )

    found = texts.join(usable, "_id").mapInArrow(extracted, "id long, y int, at binary")
    # One row for each identifier, fetched a partition at a time.
    found = found.groupBy("id", "y").agg(F.max("at").alias("at"))
    return ftrl.fit(Examples((r.id, r.y, r.at) for r in found.toLocalIterator()))


def scored(df: DataFrame, model: Model, id_col: str, text_col: str, threshold: float, keep: list[str] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted of each row, and the columns ``keep``."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast((model.index, model.weight, model.base, model.bits))
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"), shared.held_out(id_col).alias("held_out"), F.col(text_col).alias("_text"),
        *[F.col(c).alias(f"kept_{c}") for c in keep],
    )
    fields = {f.name: f for f in rows.schema.fields}
    schema = "doc_id long, held_out boolean, score double, predicted int"
    kept = [f"kept_{c}" for c in keep]
    schema += "".join(f", `{c}` {fields[c].dataType.simpleString()}" for c in kept)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weight, base, bits = sent.value
        table = np.zeros(1 << bits, np.float32)
        table[index] = weight
        features = Features(bits)
        for batch in batches:
            sums = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column("_text")):
                at = features.of(text.as_py())
                at = np.unique(at[table[at] != 0])
                sums[i] = base + float(table[at].astype(np.float64).sum())
            p = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))]
                + [batch.column(c) for c in kept],
                names=["doc_id", "held_out", "score", "predicted", *kept],
            )

    return rows.mapInArrow(score, schema)


def toxicity(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    threshold: float = 0.3,
    train_rows: int = 10_000,
    ftrl: Ftrl = Ftrl(),
) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    model = fit(df, labels, id_col, text_col, label_col, train_rows, ftrl)
    return scored(df, model, id_col, text_col, threshold)


def without_toxic(df: DataFrame, labels: DataFrame, threshold: float = 0.3, train_rows: int = 10_000, ftrl: Ftrl = Ftrl()) -> DataFrame:
    """The rows that the model does not call toxic, all columns as they were."""
    model = fit(df, labels, "doc_id", "text", "toxic", train_rows, ftrl)
    rows = scored(df, model, "doc_id", "text", threshold, df.columns).filter("predicted = 0")
    return rows.select(*[F.col(f"kept_{c}").alias(c) for c in df.columns])
