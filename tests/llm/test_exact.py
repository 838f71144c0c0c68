import hashlib
from collections import defaultdict

import pytest

from fleetlens.llm import exact

ROWS = [
    (1, "same"), (2, "same"), (9, "same"), (3, "Same"), (4, None), (5, ""), (6, "z" * 100_000), (7, "z" * 100_000),
    (8, "z" * 99_999 + "y"), (10, "twice"), (10, "twice"), (None, "lost"), (None, "lost"), (11, "lost"), (None, "alone"), (12, "same "),
]


def brute(rows, largest):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        digest = hashlib.sha256(text.encode()).hexdigest()
        once = True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and once, digest))
            once = once and i != keep
    return sorted(out, key=repr)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_copies(frame, keep):
    rows = ROWS + [(100 + i, "hot") for i in range(500)]
    got = exact.copies(frame(rows), keep=keep)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, keep == "largest")


def test_normalised(frame):
    from pyspark.sql import functions as F

    got = exact.copies(frame([(1, "A  b"), (2, "a b")]), normalise=lambda t: F.lower(F.regexp_replace(t, " +", " ")))
    assert {(r.doc_id, r.keep_id) for r in got.collect()} == {(1, 1), (2, 1)}


def test_without_copies_keeps_rows_whole(frame):
    df = frame(ROWS)
    got = exact.without_copies(df, keep="largest")
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text or "") for r in got.collect() if r.doc_id is not None) == sorted(
        [(9, "same"), (3, "Same"), (5, ""), (7, "z" * 100_000), (8, "z" * 99_999 + "y"), (10, "twice"), (11, "lost"), (12, "same ")]
    )


def test_empty(frame):
    assert exact.copies(frame([])).count() == 0
    assert exact.without_copies(frame([])).count() == 0


def test_bad_choice(frame):
    with pytest.raises(ValueError):
        exact.copies(frame([]), keep="any")
