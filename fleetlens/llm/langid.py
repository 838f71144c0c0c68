"""Language identification by a byte convolutional network.

Bytes are embedded; filters of several widths slide over them; each filter's largest response in a
window is kept, and a softmax over those gives the window's languages. The network is trained in
numpy and is a few kilobytes. A text is cut into fixed-length windows that cover all of it, windows
are run in batches, and a text's score is the mean over its windows, weighted by their bytes.

The network is fitted on at most ``train_rows`` labelled rows outside the held-out fold, dealt
evenly to the languages, each with one passage of bounded length from a place that a hash chooses;
every row is predicted over its whole text.

Defined cases: null texts and texts without a letter are ``und`` with score 0; rows without a
language are predicted but not learned from; without labelled rows everything is ``und`` with
score 0; of languages with equal scores the first by name is predicted; repeated rows are predicted
each; texts of any length are read whole; an empty table gives an empty result; other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm import shared

WINDOW = 256
BATCH = 64
UNKNOWN = "und"


@dataclass(frozen=True)
class Shape:
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    embedding: int = 8


class ByteNet:
    """Embedding, filters of several widths as one matrix, max pooling, softmax."""

    def __init__(self, languages: list[str], shape: Shape = Shape(), seed: int = 5):
        r = np.random.default_rng(seed)
        self.languages, self.shape, self.seed = languages, shape, seed
        self.most, n = max(shape.widths), shape.filters * len(shape.widths)
        e, c = shape.embedding, len(languages)
        # A narrow filter is a wide one whose last rows are held at zero.
        self.mask = np.zeros((self.most * e, n), np.float32)
        for k, w in enumerate(shape.widths):
            self.mask[: w * e, k * shape.filters : (k + 1) * shape.filters] = 1
        self.p = {
            "embed": r.normal(0, 0.5, (256, e)),
            "conv": r.normal(0, 1 / np.sqrt(self.most * e), self.mask.shape) * self.mask,
            "bias": np.zeros(n),
            "out": r.normal(0, 1 / np.sqrt(n), (n, c)),
            "base": np.zeros(c),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """For each place of each window the embeddings of the bytes under the widest filter."""
        n, length = windows.shape
        padded = np.zeros((n, length + self.most - 1), np.uint8)
        padded[:, :length] = windows
        x = self.p["embed"].take(padded, axis=0)
        s = x.strides
        view = np.lib.stride_tricks.as_strided(x, (n, length, self.most * x.shape[2]), (s[0], s[1], s[2]))
        return view.reshape(n * length, -1)

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        n, length = windows.shape
        y = (self.columns(windows) @ self.p["conv"]).reshape(n, length, -1)
        while length > 1:
            half = length // 2
            y = np.maximum(y[:, :half], y[:, length - half : length])
            length = half
        return y[:, 0]

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Softmax of each window, in batches."""
        out = [np.zeros((0, len(self.languages)), np.float32)]
        for i in range(0, len(windows), BATCH):
            h = np.maximum(self.pooled(windows[i : i + BATCH]) + self.p["bias"], 0)
            out.append(softmax(h @ self.p["out"] + self.p["base"]))
        return np.concatenate(out)

    def fit(self, passages: list[bytes], labels: np.ndarray, steps: int = 1200, rate: float = 4e-3) -> ByteNet:
        r = np.random.default_rng(self.seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        e = self.shape.embedding
        for step in range(1, steps + 1):
            pick = r.integers(len(passages), size=BATCH)
            x = np.stack([crop(passages[i], r) for i in pick])
            cols = self.columns(x)
            y = (cols @ self.p["conv"]).reshape(BATCH, WINDOW, -1)
            at = y.argmax(axis=1)
            z = np.take_along_axis(y, at[:, None], axis=1)[:, 0] + self.p["bias"]
            h = np.maximum(z, 0)
            keep = (r.random(h.shape) > 0.2).astype(np.float32) / 0.8
            g = softmax((h * keep) @ self.p["out"] + self.p["base"])
            g[np.arange(BATCH), labels[pick]] -= 1
            g /= BATCH
            dz = (g @ self.p["out"].T) * keep * (z > 0)
            place = at + np.arange(BATCH)[:, None] * WINDOW
            best = cols[place]  # batch, filter, width * embedding
            d_conv = np.einsum("bf,bfk->kf", dz, best) * self.mask
            d_cols = dz[:, :, None] * self.p["conv"].T[None]
            padded = np.zeros((BATCH, WINDOW + self.most - 1), np.uint8)
            padded[:, :WINDOW] = x
            d_embed = np.zeros_like(self.p["embed"])
            for k in range(self.most):
                under = np.take_along_axis(padded, at + k, 1)
                np.add.at(d_embed, under.ravel(), d_cols[:, :, k * e : (k + 1) * e].reshape(-1, e))
            grads = {"embed": d_embed, "conv": d_conv, "bias": dz.sum(0), "out": (h * keep).T @ g, "base": g.sum(0)}
            now = rate * (1 - step / (steps + 1))
            for k, d in grads.items():
                m[k] += 0.1 * (d - m[k])
                v2[k] += 0.001 * (d * d - v2[k])
                self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
        return self


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def crop(passage: bytes, r: np.random.Generator) -> np.ndarray:
    """A window from a passage: often a full one, else a few words, as short texts have."""
    out = np.zeros(WINDOW, np.uint8)
    start = int(r.integers(len(passage)))
    start = passage.rfind(b" ", 0, start) + 1
    length = WINDOW if r.random() < 0.4 else int(np.exp(r.uniform(np.log(4), np.log(WINDOW))))
    end = start + length
    if length < WINDOW:
        cut = passage.find(b" ", end)
        end = min(cut, start + WINDOW) if cut >= 0 else end
    part = np.frombuffer(passage[start:end][:WINDOW], np.uint8)
    out[: len(part)] = part
    return out


def fit(df: DataFrame, id_col: str, text_col: str, lang_col: str, train_rows: int, passage_chars: int, shape: Shape) -> ByteNet | None:
    text = F.col(text_col)
    rows = df.filter(~shared.held_out(id_col) & F.col(lang_col).isNotNull() & text.rlike(r"\p{L}"))
    rows = rows.select(F.col(id_col).alias("id"), text.alias("text"), F.col(lang_col).alias("lang"))
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    # Each language gives about the same number; the order of a hash makes the choice reproducible.
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.lit(train_rows / len(languages) / counts[lang])).otherwise(share)
    draw = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    space = F.greatest(F.length("text") - passage_chars, F.lit(0)) + 1
    at = (F.pmod(F.xxhash64("id", F.lit("passage")), space) + 1).cast("int")
    sample = rows.filter(draw < share).select("id", "lang", F.substring("text", at, F.lit(passage_chars)).alias("passage"))
    sample = sample.orderBy(F.xxhash64("id", F.lit("order")), "id", "passage").limit(train_rows).collect()
    sample = [r for r in sample if r.passage]
    if not sample:
        return None
    number = {lang: i for i, lang in enumerate(languages)}
    return ByteNet(languages, shape).fit([r.passage.encode() for r in sample], np.array([number[r.lang] for r in sample]))


def identify(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    train_rows: int = 6000,
    passage_chars: int = 1024,
    shape: Shape = Shape(),
) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score."""
    net = fit(df, id_col, text_col, lang_col, train_rows, passage_chars, shape)
    has_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"), shared.held_out(id_col).alias("held_out"), F.when(has_letter, F.col(text_col)).alias("text")
    )
    if net is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for lang, score in predicted(net, batch.column("text")):
                langs.append(lang)
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def predicted(net: ByteNet, texts, group_windows: int = 4096) -> Iterator[tuple[str, float]]:
    """Language and score of each text; several texts share a batch of windows."""
    held: list[np.ndarray] = []
    sizes: list[int] = []

    def flush():
        sizes_now = np.array(sizes)
        counts = -(-sizes_now // WINDOW)
        some = counts > 0
        if some.any():
            windows = np.concatenate([w for w in held if len(w)]).reshape(-1, WINDOW)
            p = net.probabilities(windows)
            starts = np.cumsum(counts[some]) - counts[some]
            weight = np.full(len(windows), WINDOW, np.float64)
            weight[starts + counts[some] - 1] = sizes_now[some] - (counts[some] - 1) * WINDOW
            mean = np.add.reduceat(p * weight[:, None], starts, axis=0) / sizes_now[some][:, None]
            best = iter(zip(mean.argmax(1), mean.max(1), strict=True))
        for s in some:
            if s:
                i, score = next(best)
                yield net.languages[i], min(1.0, float(score))
            else:
                yield UNKNOWN, 0.0
        held.clear()
        sizes.clear()

    waiting = 0
    for text in texts:
        raw = np.frombuffer((text.as_py() or "").encode(), np.uint8)
        held.append(np.pad(raw, (0, -len(raw) % WINDOW)))
        sizes.append(len(raw))
        waiting += len(held[-1]) // WINDOW
        if waiting >= group_windows:
            yield from flush()
            waiting = 0
    yield from flush()
