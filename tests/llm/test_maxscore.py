import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import maxscore

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=700, dims=12):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(dims)]) for i in range(n)]
    hot = [0.1] * dims
    rows += [(i, hot) for i in range(1000, 1300)]
    rows += [(5000, None), (5001, [None] + [0.1] * 11), (5002, [float("nan")] * dims), (5003, [float("inf")] * dims), (None, hot)]
    return rows + [(5005, []), (5006, [0.9, -0.9]), (5100, [0.5] * 20), (5007, [-0.3] * dims), (5007, [-0.3] * dims), (200, rows[3][1])]


def brute(rows, every, k=10):
    ok = [(i, np.floor(1024 * np.float32(v).astype(np.float64)).astype(int)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    asked = {}
    for i, v in ok:
        if i % every == 0 and (i not in asked or tuple(v) < tuple(asked[i])):
            asked[i] = v
    out = []
    for q, v in asked.items():
        scored = sorted((-int(np.dot(v[: len(w)], w[: len(v)])), i) for i, w in ok if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_rows,query_rows", [(2048, 512), (50, 3)])
def test_exact(frame, shard_rows, query_rows):
    rows = vectors()
    df = frame(rows, SCHEMA)
    got = maxscore.top_k(df, F.col("vec_id") % 20 == 0, shard_rows=shard_rows, query_rows=query_rows)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 20)


def test_large_components_stay_exact(frame):
    r = random.Random(5)
    rows = [(i, [float(r.randint(-(2**20), 2**20)) for _ in range(6)]) for i in range(60)]
    assert sorted(map(tuple, maxscore.top_k(frame(rows, SCHEMA), F.col("vec_id") % 10 == 0).collect())) == brute(rows, 10)


def test_few_and_none(frame):
    assert maxscore.top_k(frame([], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0
    assert maxscore.top_k(frame([(1, [0.5])], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0
    rows = [(0, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [-0.5, 0.1])]
    assert sorted(map(tuple, maxscore.top_k(frame(rows, SCHEMA), F.col("vec_id") == 0).collect())) == brute(rows, 100)


def test_shard_with_uneven_terms():
    """Few terms carry most of the scores, so that most vectors are dropped before their last terms."""
    r = np.random.default_rng(3)
    v = r.integers(-20, 20, (3000, 40))
    v[:, :3] *= 60
    ids, scores = maxscore.Shard(np.arange(3000), v).best(-1, v[0], 10)
    full = v @ v[0]
    want = np.lexsort((np.arange(3000), -full))[:10]
    assert ids.tolist() == want.tolist() and scores.tolist() == full[want].tolist()


def test_scores_beyond_64_bits_are_an_error(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0, [1e16, 1.0]), (1, [1e16, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="pass 64 bits"):
        maxscore.top_k(rows, F.col("vec_id") == 0).collect()
