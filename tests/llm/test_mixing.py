import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def documents():
    rows = []
    for i in range(400):
        source = "src0" if i % 3 == 0 else f"src{i % 7}"
        rows.append((i, " ".join(["w"] * (1 + i * 7 % 300)), None, source))
    rows += [(1000, None, None, "src1"), (1001, "", None, None), (1002, "one two", None, None), (1003, "\t \n", None, "none")]
    return rows + [(5, "again and again", None, "src5")] * 2


def targets(rows):
    """Water filling by repetition, as the definition reads."""
    size = Counter()
    for _, text, _, source in rows:
        size[source] += len(WORD.findall(text or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(size.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * size[s]}
        if not full:
            return size, out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = 2.0 * size[s]
            left -= out[s]
        open_ -= full
    return size, out


def test_mix(frame):
    rows = documents()
    source_of = {r[0]: r[3] for r in rows}
    got = mixing.mix(frame(rows), block_words=4).collect()
    size, want = targets(rows)
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    taken = Counter()
    for r in got:
        s = source_of[r.doc_id]
        assert 0 <= r.taken <= 2 * r.size and r.source_size == size[s]
        assert math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-9)
        taken[s] += r.taken
    for s, target in want.items():
        assert abs(taken[s] - target) <= max(0.03 * target, 10), (s, taken[s], target)


def test_small_sources_come_near_their_targets(frame):
    """Two hundred sources of five short documents each."""
    rows = [(i, " ".join(["w"] * (1 + i * 13 % 60)), None, f"s{i % 200:03d}") for i in range(1000)]
    size, want = targets(rows)
    taken = Counter()
    for r in mixing.mix(frame(rows)).collect():
        assert 0 <= r.taken <= 2 * r.size
        taken[rows[r.doc_id][3]] += r.taken
    for s, target in want.items():
        assert abs(taken[s] - target) <= max(0.05 * target, 1), (s, taken[s], target)


def plan_of(spark, sizes):
    """Slots of sources with the given sizes and targets, in words of one."""
    rows = [(f"s{i}", i, size, float(target)) for i, (size, target) in enumerate(sizes)]
    sources = spark.createDataFrame(rows, "source string, s long, source_size long, target double")
    return mixing.in_blocks(sources, 1, 512, 2)


def test_slots_fill_shards_and_follow_the_block_permutations(spark):
    sizes = [(3000, 4500), (700, 1400), (10, 7), (1, 1)]
    rows = mixing.slots(plan_of(spark, sizes), 100).collect()
    total = sum(t for _, t in sizes)
    assert sorted((r.shard, r.place) for r in rows) == [(i // 100, i % 100) for i in range(total)]
    for s, (size, target) in enumerate(sizes):
        times = Counter(r.block for r in rows if r.s == s)
        assert sum(times.values()) == target and set(times) <= set(range(size))
        # Every block once before any comes again.
        assert set(times.values()) <= {target // size, -(-target // size)}


def test_shard_counts_are_multinomial_given_the_totals(spark):
    """Mean and variance of a source's slots in a shard are those of draws without return."""
    rows = mixing.slots(plan_of(spark, [(20_000, 30_000), (20_000, 10_000)]), 100).collect()
    counts = Counter(r.shard for r in rows if r.s == 0)
    n = [counts[i] for i in range(400)]
    mean = sum(n) / 400
    variance = sum((x - mean) ** 2 for x in n) / 399
    expected = 100 * 0.75 * 0.25 * (40_000 - 100) / (40_000 - 1)
    assert mean == 75 and 0.75 * expected < variance < 1.3 * expected


def test_unfolding_numbers_every_slot_once(spark, monkeypatch):
    monkeypatch.setattr(mixing, "UNFOLD_LOG2", 3)
    df = spark.createDataFrame([(i, n) for i, n in enumerate((1, 7, 8, 9, 64, 65, 700))], "s long, n long")
    got = Counter((r.s, r.j) for r in mixing.unfolded(df, "n", "j", ["s"]).collect())
    assert got == Counter((i, j) for i, n in enumerate((1, 7, 8, 9, 64, 65, 700)) for j in range(n))


def test_permutations_are_made_once_a_pass(spark):
    """What all numbers of a permutation share is computed before rows are unfolded, not for each slot."""
    plan = mixing.slots(plan_of(spark, [(3000, 4500), (700, 1400)]), 100).select("s", "block")._jdf.queryExecution().optimizedPlan().toString()
    each_slot, before = plan.split("RepartitionByExpression", 1)
    assert "xxhash64" in each_slot and str(mixing.PRIMES[0]) not in each_slot and str(mixing.PRIMES[0]) in before


def test_slots_of_several_passes_follow_one_permutation_each(spark):
    """The blocks of a pass are those of its permutation, also if it is cut short."""
    found = mixing.slots(plan_of(spark, [(70, 175)]).withColumn("slots", F.lit(175).cast("long")), 16).groupBy("block").count().collect()
    x, n = F.col("id"), F.lit(70).cast("long")
    want = Counter()
    for again, size in enumerate((70, 70, 35)):
        seed = [F.lit(0).cast("long"), F.lit(again).cast("long")]
        want.update(r.y for r in spark.range(size).select(mixing.permuted(x, n, seed).alias("y")).collect())
    assert {r.block: r["count"] for r in found} == dict(want)


def test_reruns_agree(frame):
    a, b = (sorted(map(tuple, mixing.mix(frame(documents()).repartition(n)).collect())) for n in (2, 5))
    assert a == b


def test_empty(frame):
    assert mixing.mix(frame([])).count() == 0
    assert [tuple(r) for r in mixing.mix(frame([(1, None)])).collect()] == [(1, 0, 0, 0.0, 0)]
    assert mixing.mixed_documents(frame([(1, None)])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 53, 1000, 1000003])
def test_permutation(spark, n):
    x = F.col("id")
    some = spark.range(n).select(mixing.permuted(x, F.lit(n).cast("long"), [F.lit(4), F.lit(1)]).alias("y"))
    got = some.agg(F.countDistinct("y"), F.min("y"), F.max("y")).first()
    assert tuple(got) == (n, 0, n - 1)


def test_documents_come_as_often_as_taken(frame):
    df = frame(documents())
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    _, want = targets(documents())
    words = Counter()
    for r in got.collect():
        words[r.source] += len(WORD.findall(r.text))
    for s, target in want.items():
        assert abs(words[s] - target) <= max(0.1 * target, 300), (s, words[s], target)
