import random
import tracemalloc
import zlib

import numpy as np

from fleetlens.llm import toxicity


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def data(n=1500):
    r = random.Random(8)
    vocabulary = [f"{a}{b}" for a in "bcdfghklmn" for b in ("ado", "eni", "ilo", "oru", "umat", "isk")]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(vocabulary) for _ in range(r.randint(5, 120))]
        toxic = r.random() < 0.2
        if toxic:
            for _ in range(r.randint(1, 3)):
                w.insert(r.randrange(len(w)), r.choice(["Nasty", "VILE!!!", "scorned", "scornful###"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1 if toxic else 0))
    return rows, labels


SCHEMA = "doc_id long, toxic int"


def test_held_out_quality_and_no_leak(frame, spark):
    rows, labels = data()
    # The held-out fold carries inverted labels: nothing may be learned from them.
    given = [(i, 1 - y if held_out(i) else y) for i, y in labels]
    got = toxicity.toxicity(frame(rows), spark.createDataFrame(given, SCHEMA)).collect()
    truth = dict(labels)
    fold = [(r.score, truth[r.doc_id]) for r in got if r.held_out]
    assert len(fold) > 200
    high = np.array([s for s, y in fold if y])
    low = np.array([s for s, y in fold if not y])
    assert (high[:, None] > low[None]).mean() > 0.97
    assert (high >= 0.3).mean() > 0.85 and (low < 0.3).mean() > 0.97
    assert all(r.predicted == int(r.score >= 0.3) and r.held_out == held_out(r.doc_id) for r in got)


def test_defined_cases(frame, spark):
    rows, labels = data(600)
    far = "bado " * 60_000 + "vile"
    rows = rows + [(9000, None), (9001, ""), (9002, far), (9003, "bado"), (9003, "nasty"), (None, "vile")]
    labels = labels + [(9002, None), (None, 1), (5, 1), (5, 0)]
    got = toxicity.toxicity(frame(rows), spark.createDataFrame(labels, SCHEMA)).collect()
    score = {r.doc_id: r.score for r in got}
    assert len(got) == len(rows) and score[9000] == score[9001]
    # The word stands at the end of a very long text and counts all the same.
    assert score[9002] > score[9000]
    assert sorted(r.predicted for r in got if r.doc_id == 9003) == [0, 1]


def test_without_labels(frame, spark):
    none = spark.createDataFrame([], SCHEMA)
    got = toxicity.toxicity(frame([(1, "x")]), none).collect()
    assert [(r.score, r.predicted) for r in got] == [(0.5, 1)]
    assert toxicity.toxicity(frame([]), none).count() == 0


def test_filter_keeps_clean_rows_whole(frame, spark):
    rows, labels = data(800)
    df = frame(rows)
    got = toxicity.without_toxic(df, spark.createDataFrame(labels, SCHEMA))
    assert got.columns == df.columns
    left = {r.doc_id: r.text for r in got.collect()}
    clean = [i for i, y in labels if not y]
    assert all(left[i] == dict(rows)[i] for i in left)
    assert sum(i in left for i in clean) >= 0.98 * len(clean) and len(left) < len(rows)


def test_weights_are_sparse():
    rows, labels = data(600)
    f = toxicity.Features()
    model = toxicity.Ftrl().fit([(np.unique(f.of(t)), y) for (_, t), (_, y) in zip(rows, labels, strict=True)])
    assert 0 < len(model.index) < 2000


def test_examples_are_those_of_a_sorted_list():
    f = toxicity.Features()
    rows = [(i * 37 % 101 - 50, i % 3 == 0, np.unique(f.of(f"w{i % 7} and w{i % 11} or w{i}"))) for i in range(101)]
    examples = toxicity.Examples((i, int(y), bytearray(at.astype("<i4").tobytes())) for i, y, at in rows)
    plain = [(at, int(y)) for _, y, at in sorted(rows, key=lambda r: r[0])]
    assert [(list(at), y) for at, y in examples] == [(list(at), y) for at, y in plain]
    one, two = toxicity.Ftrl(l1=0.001).fit(examples), toxicity.Ftrl(l1=0.001).fit(plain)
    assert len(one.index) and one.base == two.base
    assert list(one.index) == list(two.index) and list(one.weight) == list(two.weight)
    empty = toxicity.Ftrl().fit(toxicity.Examples(iter([])))
    assert len(empty.index) == 0 and empty.base == 0.0


def test_fitting_holds_two_tables_of_weights_on_the_driver():
    """Intermediate results of the whole table would be several more."""
    f = toxicity.Features()
    rows = [(np.unique(f.of(t)), y) for t, y in (("good words", 0), ("bad words", 1))]
    tracemalloc.start()
    try:
        toxicity.Ftrl(epochs=1).fit(rows, bits=21)
        assert tracemalloc.get_traced_memory()[1] < 3 * 8 << 21
    finally:
        tracemalloc.stop()
