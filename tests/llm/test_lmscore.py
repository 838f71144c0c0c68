"""Language-model scores against a model with its counts in dictionaries."""

import math
import random
import re
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest

from fleetlens.llm import lmscore
from fleetlens.llm.lmscore import Model

# So many hashes that false positives do not happen.
SURE = Model(hashes=40, mass=(3.0, 2.0))


def fold(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x20\x09-\x0d]+", low) + [None]


def quantised(n, base):
    return float(lmscore.counts_of(lmscore.levels_of(np.array([n]), base), base)[0])


def brute(rows, model):
    exact, stored = Counter(), Counter()
    grams = lambda t: [tuple((["^"] * model.order + t)[i + model.order - k + 1 : i + model.order + 1]) for k in range(1, model.order + 1) for i in range(len(t)) if k < 3 or i >= k - 2]
    for doc_id, text in rows:
        if not fold(doc_id):
            exact.update(tokens(text))
            stored.update(grams(tokens(text)))
    total, distinct, texts = sum(exact.values()), len(exact), exact[None]
    c = lambda g: exact[g[0]] if len(g) == 1 else quantised(stored[g], model.base) if stored[g] >= model.least[len(g) - 1] else 0.0
    out = []
    for doc_id, text in rows:
        t = tokens(text)
        padded, score = ["^"] * model.order + t, 0.0
        for i, w in enumerate(t):
            p = (exact[w] + 1) / (total + distinct + 1)
            here = exact[w]
            for k in range(2, model.order + 1):
                if i < k - 2:
                    break
                g = tuple(padded[i + model.order - k + 1 : i + model.order + 1])
                context = float(texts) if k == 2 and i == 0 else c(g[:-1])
                here = min(c(g), here, context)
                p = (here + model.mass[k - 2] * p) / (context + model.mass[k - 2])
            score += math.log10(p)
        base = sum(math.log10((exact[w] + 1) / (total + distinct + 1)) for w in t)
        out.append((doc_id, fold(doc_id), len(t), sum(exact[w] > 0 for w in t), total, base, score))
    return out


def result(df, model):
    rows = lmscore.scores(df, model=model).collect()
    return [tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")) for r in rows]


def same(got, want):
    order = lambda r: (str(r[0]), r[2], r[-2])
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def corpus(seed, docs=90, vocabulary=40):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["The", "the", "\u00c9t\u00e9", "a,b"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(i, " ".join(draw.choices(words, weights, k=draw.randint(0, 60)))) for i in range(docs)]
    return rows + [(1000 + i, rows[i][1] + " odd%d" % i) for i in range(30)] + [(None, "the w1\tw2\nw3"), (3, rows[3][1])]


def test_scores_equal_brute_force(frame):
    rows = corpus(1)
    same(result(frame(rows), SURE), brute(rows, SURE))


def test_rare_words_and_parts_give_the_same(frame):
    rows = corpus(2)
    model = replace(SURE, frequent_words=20, part_ngrams=64, broadcast_bytes=0)
    same(result(frame(rows), model), brute_with_filtered_words(rows, model))


def brute_with_filtered_words(rows, model):
    """Rare words' own counts are quantised in the score."""
    exact = Counter(w for doc_id, text in rows if not fold(doc_id) for w in tokens(text))
    total = sum(exact.values())
    want = brute(rows, model)
    if all(n * model.frequent_words >= total for n in exact.values()):
        return want
    broadcast = replace(model, broadcast_bytes=1 << 30)
    return [(*w[:-1], s) for w, s in zip(want, scores_by_broadcast(rows, broadcast), strict=True)]


def scores_by_broadcast(rows, model):
    from pyspark.sql import SparkSession

    df = SparkSession.getActiveSession().createDataFrame([(i, *r) for i, r in enumerate(rows)], "at long, doc_id long, text string")
    by = {(r.doc_id, round(r.base_score, 9)): r.score for r in lmscore.scores(df, model=model).collect()}
    return [by[w[0], round(w[5], 9)] for w in brute(rows, model)]


def test_filter_counts_up_and_errs_on_one_side():
    draw = np.random.default_rng(5)
    keys, others = np.unique(draw.integers(0, 1 << 40, 30_000, dtype=np.uint64)), draw.integers(0, 1 << 40, 30_000, dtype=np.uint64)
    n = np.maximum(draw.zipf(1.8, len(keys)), 1)
    levels = lmscore.levels_of(n, 1.5)
    bits, size = lmscore.filled(keys, levels, 6)
    table = lmscore.Parts.of(pa.table({"bits": [b"", bits.tobytes()], "size": [64, size]}), np.array([1, 0]), 2, 6)
    found = table.levels(np.zeros(len(keys), np.int64), keys)
    assert (found >= levels).all() and (found > levels).mean() < 0.03
    assert (table.levels(np.zeros(len(others), np.int64), others) > 0).mean() < 0.03
    assert np.all(np.abs(np.log(lmscore.counts_of(levels, 1.5) / n)) < np.log(1.5))


def test_probabilities_add_up(frame):
    """Over all words that may follow, known and one unknown, probabilities sum to one but for quantising."""
    texts = [f"a {w}" for w in "bbbbccd"]
    rows = [(i, t) for i, t in enumerate(texts) if not fold(i)]
    vocabulary = sorted({w for _, t in rows for w in t.split()})
    model = replace(SURE, order=2, mass=(3.0,), least=(1, 1))
    asked = [(10_000 + i, f"a {w}") for i, w in enumerate([*vocabulary, "unseen"])]
    held = [(d, t) for d, t in ((d + 100_000 * k, t) for d, t in asked for k in range(30)) if fold(d)]
    by = {}
    ends = {}
    for r in lmscore.scores(frame(rows + held), model=model).collect():
        by[r.doc_id] = r.score
    for d, t in held:
        ends[t] = 10 ** by[d]
    assert len(ends) == len(asked)
    # p(a | begin) p(w | a) p(end | w): the last factor is worked out by hand.
    c = Counter(w for _, t in rows for w in t.split())
    total, distinct = sum(c.values()) + len(rows), len(c) + 1
    p_end = (len(rows) + 1) / (total + distinct + 1)
    p_a = (c["a"] + 1) / (total + distinct + 1)
    first = (quantised(len(rows), 1.5) + 3 * p_a) / (len(rows) + 3)
    after = {w: (min(quantised(n, 1.5), n) + 3 * p_end) / (n + 3) if w != "a" else 3 * p_end / (n + 3) for w, n in c.items()}
    after["unseen"] = p_end
    mass = sum(p / first / after[t.split()[1]] for t, p in ends.items())
    unseen_end = 3 * p_end / (c["a"] + 3)
    assert mass + unseen_end == pytest.approx(1, abs=0.15)


def test_edges(frame):
    assert result(frame([]), Model()) == []
    held = [(d, "x y") for d in range(60) if fold(d)]
    assert {r[3:] for r in result(frame(held), Model())} == {(0, 0, 0.0, 0.0)}
    rows = [(1, None), (1, None), (2, ""), (5, " \n"), (6, "word " * 300_000 + "x" * 100_000), (7, "word")]
    got = result(frame(rows), SURE)
    same(got, brute(rows, SURE))
    assert [r[2] for r in got if r[0] in (1, 2, 5)] == [1, 1, 1, 1]


def test_copies_of_training_texts_score_higher(frame):
    rows = corpus(7, docs=400, vocabulary=3000)
    copies = [(5000 + i, t) for i, (d, t) in enumerate(rows) if fold(5000 + i) and not fold(d) and len(t) > 100]
    assert len(copies) > 5
    for r in result(frame(rows + copies), Model(mass=(5.0, 5.0))):
        if r[0] is not None and r[0] >= 5000:
            assert r[1] and r[5] < r[6] < 0


def test_lookups_do_not_grow_with_the_number_of_runs(frame, monkeypatch, tmp_path):
    """A part answers all runs at once: a row for each run and part took a lookup of its own."""
    log = str(tmp_path / "lookups")

    class Spy(lmscore.Parts):
        @staticmethod
        def of(*args):
            found = lmscore.Parts.of(*args)
            return Spy(found.bits, found.start, found.size, found.hashes)

        def levels(self, part, keys):
            if len(keys):
                with open(log, "a") as out:
                    out.write("x")
            return super().levels(part, keys)

    rows, calls, got = corpus(3), [], []
    for partitions in (2, 20):
        with monkeypatch.context() as patch:
            patch.setattr(lmscore, "Parts", Spy)
            got.append(result(frame(rows).repartition(partitions), replace(SURE, frequent_words=20, part_ngrams=1000, broadcast_bytes=0)))
        with open(log) as found:
            calls.append(len(found.read()) - sum(calls))
    same(got[0], got[1])
    assert calls[0] == calls[1] > 0


def test_many_runs_and_blocks_give_the_same(frame):
    """Runs with and without held-out texts, n-grams that a run has often, words that many runs have."""
    rows = corpus(4, docs=150) + [(5000, "again " * 2000), (5001, None), (None, "")]
    model = replace(SURE, frequent_words=5, part_ngrams=64, run_chars=300)
    got = result(frame(rows), replace(model, broadcast_bytes=0))
    same(got, result(frame(rows), replace(model, broadcast_bytes=1 << 30)))
    assert {r[0] for r in got if not r[1]} and {r[0] for r in got if r[1]}


@pytest.mark.parametrize("order", [1, 2])
def test_keys_come_back_from_rows(order):
    draw = np.random.default_rng(order)
    width = 64 if order == 1 else lmscore.KEY_BITS + 7
    keys = np.unique(draw.integers(0, 1 << 64, 900, dtype=np.uint64) >> np.uint64(64 - width))
    n = np.minimum(draw.zipf(1.5, len(keys)), 2000)
    sent = pa.Table.from_batches([lmscore.asked_rows(run, run == 1, order, keys, n, 7) for run in (0, 1)] + [lmscore.asked_rows(2, False, order, keys[:0], n[:0], 7)])
    found = []
    for block in range(1 << 7 - lmscore.BLOCK_BITS):
        k, times = lmscore.asked_keys(sent.filter(pa.compute.equal(sent["block"], block)), order)
        k = k if order == 1 else k | np.uint64(block) << np.uint64(width - 7 + lmscore.BLOCK_BITS)
        found += zip(k.tolist(), times.tolist(), strict=True)
    assert sorted(found) == sorted([*zip(keys.tolist(), n.tolist(), strict=True), *((k, 0) for k in keys.tolist())])


def test_hashes_are_found():
    draw = np.random.default_rng(8)
    for keys in (np.unique(draw.integers(0, 1 << 49, 5000, dtype=np.uint64)), np.array([5], np.uint64), np.arange(40, dtype=np.uint64)):
        table = lmscore.Hashes(keys, 49)
        asked = np.concatenate([keys, keys + np.uint64(1), draw.integers(0, 1 << 49, 300, dtype=np.uint64), np.zeros(1, np.uint64)])
        assert (table.places(asked) == np.minimum(np.searchsorted(keys, asked), len(keys) - 1)).all()
