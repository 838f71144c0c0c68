import random
import tracemalloc
from collections import Counter, defaultdict

import pytest

from fleetlens.llm import jaccard
from fleetlens.llm.components import components
from fleetlens.llm.jaccard import Join


def shingles(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(docs):
    sets, lists, parent = [shingles(t) for _, t in docs], defaultdict(list), list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in lists[x]).items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                parent[root(k)] = root(j)
        for x in s:
            lists[x].append(k)
    least = {}
    for k, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[root(k)] = min(least.get(root(k), doc_id), doc_id)
    return sorted(((d, len(sets[k]), least.get(root(k))) for k, (d, _) in enumerate(docs)), key=repr)


def documents(copies=60):
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]

    def prose(n):
        return [r.choice(vocabulary) for _ in range(n)]

    docs = [(i, " ".join(prose(r.randint(1, 120)))) for i in range(150)]
    base = prose(100)
    for i in range(copies):
        w = list(base)
        for _ in range(r.randint(0, 8)):
            w[r.randrange(len(w))] = f"x{i}"
        docs.append((1000 + i, " ".join(w).upper() if i % 7 == 0 else "\t".join(w)))
    # A chain whose ends are not alike, and borderline sizes.
    chain = prose(80)
    for i in range(12):
        docs.append((2000 + i, " ".join(chain[i * 3 :] + prose(i * 3))))
        chain = docs[-1][1].split()
    for n in range(1, 12):
        docs += [(3000 + n, " ".join(base[:n])), (3100 + n, " ".join(base[: n + 1]))]
    line = " ".join(prose(30))
    docs += [(4000 + i, line + " " + " ".join(prose(r.randint(0, 15)))) for i in range(60)]
    docs += [(5000, None), (5001, ""), (5002, " \n"), (None, docs[3][1]), (3, docs[3][1]), (5003, "É é"), (5004, "é é")]
    return docs + [(5005, " ".join(prose(20_000)))]


@pytest.mark.parametrize(
    "join",
    [Join(), Join(short_list=2, pairs_per_document=0, hubs=(1, 2, 3)), Join(short_list=3, hot_documents=3, hubs=(1,)), Join(cells_log2=8, pairs_per_document=0, hubs=(), earlier=1)],
)
def test_against_brute_force(frame, join):
    docs = documents()
    got = jaccard.near_duplicates(frame(docs), join=join)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs)


def test_one_of_each(frame):
    docs = documents()
    df = frame(docs)
    got = jaccard.one_of_each(df)
    assert got.columns == df.columns
    want = [d for d, n, c in brute(docs) if d == c and d is not None and n] + [5000, 5001, 5002]
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want))


def family(draw, docs, changes, first):
    """Near copies of one text with so many words changed that few of them link with another."""
    base = [f"f{first}w{i}" for i in range(80)]
    out = []
    for i in range(docs):
        words = list(base)
        for at in draw.sample(range(80), draw.choice(changes)):
            words[at] = f"c{first + i}x{at}"
        out.append((first + i, " ".join(words[: 80 - draw.randint(0, 3)])))
    return out


@pytest.mark.parametrize("join", [Join(hubs=(1,)), Join(short_list=4, class_ratio=1.02, earlier=2)])
def test_thousands_of_near_copies_that_do_not_link(frame, join):
    draw = random.Random(9)
    docs = family(draw, 2000, (3, 4, 5, 6), 10_000) + family(draw, 400, (0, 1, 2, 3, 4), 50_000)
    got = sorted(map(tuple, jaccard.near_duplicates(frame(docs), join=join).collect()))
    want = brute(docs)
    assert got == want
    assert len({c for _, _, c in want}) > 1000


def test_texts_are_compared_of_little_but_links(frame, monkeypatch):
    """Candidates that cannot link are told by their bitmaps; their texts are not fetched."""
    compared = []
    real = jaccard.verified

    def counted(pairs, *args):
        compared.append(pairs.count())
        return real(pairs, *args)

    monkeypatch.setattr(jaccard, "verified", counted)
    docs = [(d, t + " " + " ".join(f"t{d}x{i}" for i in range(40))) for d, t in family(random.Random(9), 400, (5, 6, 7), 10_000)]
    docs += [(0, docs[0][1] + " end"), (1, docs[1][1] + " end")]
    got = sorted(map(tuple, jaccard.near_duplicates(frame(docs), join=Join(hubs=(1,))).collect()))
    assert got == brute(docs)
    assert 2 <= sum(compared) <= 20


def test_bitmaps_differ_in_no_more_than_the_sets_do():
    draw = random.Random(3)
    texts = [" ".join(f"w{draw.randrange(3000)}" for _ in range(n)) for n in (1, 7, 60, 70, 500, 530, 4000)]
    texts += [t + " and more words" for t in texts] + [""]
    shingle, text, size = jaccard.Sets(5).of(texts)
    held = jaccard.bitmaps(shingle, text, size).to_pylist()
    sets = [set(shingle[text == i].tolist()) for i in range(len(texts))]
    pairs = [(i, j) for i in range(len(texts)) for j in range(len(texts))]
    bits = jaccard.differing_bits([held[i] for i, _ in pairs], [held[j] for _, j in pairs])
    assert all(n <= len(sets[i] ^ sets[j]) for n, (i, j) in zip(bits.tolist(), pairs, strict=True))
    assert bits[pairs.index((4, 5))] > 200


def test_counts_above_a_byte_are_packed():
    counts = jaccard.np.array([0, 255, 256, 70_000, 3, 2**33])
    assert (jaccard.unpacked_counts(jaccard.packed_counts(counts), 6) == counts).all()


def test_long_lists_draw_few_pairs_of_those_that_cannot_link(frame, monkeypatch):
    """The last pairs of a family that does not link grow with its size, not with its square."""
    drawn = {}
    real = jaccard.all_pairs

    def counted(*args):
        pairs = real(*args)
        drawn["pairs"] = pairs.count()
        return pairs

    monkeypatch.setattr(jaccard, "all_pairs", counted)
    for n in (400, 1600):
        docs = family(random.Random(9), n, (5, 6, 7), 10_000)
        jaccard.near_duplicates(frame(docs), join=Join(hubs=(1,))).count()
        assert drawn["pairs"] <= 5 * n


def test_sets_of_a_large_group_that_meet_but_cannot_link_make_no_pairs(frame, monkeypatch):
    """Two changes of a text stand within reach of each other's first shared shingle, all of them."""
    drawn = []
    real = jaccard.all_pairs

    def counted(*args):
        pairs = real(*args)
        drawn.append(pairs.count())
        return pairs

    monkeypatch.setattr(jaccard, "all_pairs", counted)
    docs = family(random.Random(9), 600, (2,), 10_000)
    got = sorted(map(tuple, jaccard.near_duplicates(frame(docs), join=Join(hubs=(1,))).collect()))
    assert got == brute(docs)
    assert sum(drawn) <= 10 * len(docs)


def test_runs_of_any_length_give_the_same_sets(monkeypatch):
    draw = random.Random(4)
    texts = [" ".join(f"w{draw.randrange(900)}" for _ in range(n)) for n in (0, 1, 4, 5, 900, 9000)] + ["x" * 3000 + " y z " * 300]
    whole = jaccard.Sets(5).of(texts)
    monkeypatch.setattr(jaccard, "RUN", 512)
    for one, two in zip(whole, jaccard.Sets(5).of(texts), strict=True):
        assert (one == two).all()


def test_sets_are_made_in_little_memory():
    texts = [" ".join(f"w{i * j % 977}" for i in range(400)) for j in range(1, 120)]
    tracemalloc.start()
    sets = jaccard.Sets(5)
    assert len(sets.of(texts)[2]) == len(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20


@pytest.fixture
def dealt_out(spark):
    """Shuffles keep their partitions, so that rows dealt apart stay apart."""
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_near_copies_of_many_copies(frame, dealt_out):
    base = [f"b{i}" for i in range(100)]
    docs = [(i, " ".join(base)) for i in range(10, 5010)]
    # Few distinct sets have a hot shingle: near copies of the group, one of them with the least number.
    docs += [(n, " ".join(base[:i] + [f"y{n}"] + base[i + 1 :])) for n, i in ((1, 50), (6000, 20), (6001, 80), (6002, 0))]
    docs += [(7000, " ".join(f"z{i}" for i in range(60)))]
    got = jaccard.near_duplicates(frame(docs))
    assert sorted(map(tuple, got.collect())) == sorted((d, 56, d) if d == 7000 else (d, 96, 1) for d, _ in docs)


def test_empty(frame):
    assert jaccard.near_duplicates(frame([])).count() == 0
    assert jaccard.one_of_each(frame([])).count() == 0
    assert [tuple(r) for r in jaccard.near_duplicates(frame([(1, None)])).collect()] == [(1, 0, 1)]


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    got = {n: c for n, c in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = defaultdict(set)
    for n in got:
        groups[root(n)].add(got[n])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(got.values()))
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}
