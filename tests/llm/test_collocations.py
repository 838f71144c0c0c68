"""Collocations against counting every phrase in a dictionary."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from fleetlens.llm import collocations
from fleetlens.llm.collocations import HatTrie, Mining


def brute(rows, join):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, join.longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= join.least}
        gone = set()
        for q, b in candidates.items():
            for k in range(2, len(q)):
                for i in range(len(q) - k + 1):
                    if 100 * b >= join.percent * candidates[q[i : i + k]]:
                        gone.add(q[i : i + k])
        found = []
        for p, a in candidates.items():
            if p not in gone:
                cuts = [(join.scale * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
                score, _, left, right = min(cuts)
                found.append((lang, " ".join(p), a, left, right, totals[lang], score))
        found.sort(key=lambda r: (-r[-1], -r[2], r[1].encode()))
        out += [(r[0], i + 1, *r[1:]) for i, r in enumerate(found[: join.best])]
    return sorted(out)


def result(df, join):
    rows = collocations.collocations(df, join=join).collect()
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in rows)


def corpus(seed, docs=260):
    draw = random.Random(seed)
    words = ["The", "the", "of", "é", "Été", "a-b", "x" * 300] + [f"w{i}" for i in range(25)]
    out = []
    for i in range(docs):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", " ", "\t", "  ", ", ", "\n", ".", " "]) for _ in range(80))
        if i % 3 == 0:
            text += " New York City Hall Park " + text[:100] + "; upon my word"
        out.append((draw.choice(["en", "en", "fr", "fr", None, "und"]), text))
    return out


def documents(frame, rows):
    return frame([(i, text, lang, None, None) for i, (lang, text) in enumerate(rows)])


def test_collocations_equal_brute_force(frame):
    rows, join = corpus(1), Mining(least=6, best=60)
    want = brute(rows, join)
    assert len({r[0] for r in want}) == 3 and any(r[2].count(" ") == 3 for r in want)
    assert result(documents(frame, rows), join) == want


def test_spilled_runs_and_full_filters_change_nothing(frame):
    rows = corpus(2)
    join = Mining(least=4, best=10_000, burst=4, most=50, pieces=40, filter_bits_log2=20)
    assert result(documents(frame, rows), join) == brute(rows, join)


def test_trie_counts_and_bounds_memory():
    draw = random.Random(3)
    trie, want, runs = HatTrie(16, 300), Counter(), []
    for _ in range(40):
        ids = np.array([draw.choice([1, 2, 2**40, 2**63 - 1, draw.randrange(2**63)]) for _ in range(200)], ">u8").tobytes()
        phrases = [ids[i : i + 8 * k] for k in (2, 3) for i in range(0, len(ids) - 8 * k, 8)]
        want.update(phrases)
        for i in range(0, len(phrases), 50):
            runs += trie.add("en", phrases[i : i + 50])
            assert trie.size <= 300
    runs += trie.spill(0)
    got = Counter()
    for _, run in runs:
        assert run == sorted(run)
        got.update(dict(run))
    assert got == want and trie.size == 0


def test_edges(frame):
    join = Mining(least=2)
    assert result(documents(frame, []), join) == []
    assert result(documents(frame, [("en", None), (None, ""), ("fr", "seul"), ("fr", "?!")]), join) == []
    # Repeated rows, ties in score and frequency, and a text without a single blank.
    rows = [("en", "b a. d c. a b, " * 3)] * 2 + [(None, "long" * 50_000 + "," + "p q " * 3000)]
    assert result(documents(frame, rows), join) == brute(rows, join)


def test_scores_are_exact_beyond_64_bits(spark):
    big = 6_000_000_000_000_000
    word = [bytes([0] * 7 + [i]) for i in range(3)]
    counts = spark.createDataFrame([("en", bytearray(word[0]), big + 1), ("en", bytearray(word[1]), big + 2)], "lang string, phrase binary, n long")
    candidates = spark.createDataFrame([("en", bytearray(word[0] + word[1]), big)], "lang string, phrase binary, n long")
    row = collocations.scored(candidates, counts, Mining()).collect()[0]
    assert row.score == 2_000_000 * big // (2 * big + 3)


def test_equal_phrases_enter_the_trie_once():
    draw = np.random.default_rng(5)
    words = draw.choice(np.array([1, 2, 2**40, 2**40 + 1, 2**63 + 5], np.uint64), (4000, 3))
    phrases, n = collocations.counted(words)
    want = Counter(w.astype(">u8").tobytes() for w in words)
    assert len(phrases) < 4000 // 10 and sum(n) == 4000 and set(phrases) == set(want)
    trie = HatTrie(4, 10_000)
    assert list(trie.add("en", list(phrases), ((p, times - 1) for p, times in zip(phrases, n, strict=True) if times > 1))) == []
    assert Counter(dict(item for _, run in trie.spill(0) for item in run)) == want and trie.size == 0


def test_batches_of_any_size_change_nothing(frame):
    rows = corpus(6)
    for batch in (1, 500):
        join = Mining(least=4, best=10_000, burst=4, most=50, batch=batch)
        assert result(documents(frame, rows), join) == brute(rows, join)
