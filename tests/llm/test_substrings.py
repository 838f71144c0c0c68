import hashlib
import random
from collections import defaultdict

import pytest

from fleetlens.llm import substrings


def brute(docs, window=35):
    at, words = defaultdict(list), []
    for k, (_, text) in enumerate(docs):
        words.append((text or "").encode().split())
        for i in range(len(words[k]) - window + 1):
            at[tuple(words[k][i : i + window])].append((k, i))
    gone = [set() for _ in docs]
    for places in at.values():
        if len(places) > 1:
            for k, i in places:
                gone[k].update(range(i, i + window))
    out = []
    for (doc_id, _), w, g in zip(docs, words, gone, strict=True):
        kept = b" ".join(x for i, x in enumerate(w) if i not in g)
        out.append((doc_id, len(w), len(g), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def documents():
    r = random.Random(1)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "日本", "x y"]

    def prose(n):
        return " ".join(r.choice(vocabulary) for _ in range(n))

    base = [prose(r.randint(0, 200)) for _ in range(30)]
    passage = prose(60)
    docs = list(enumerate(base)) + [(100 + i, b) for i, b in enumerate(base[:8])]
    docs += [(200 + i, f"{b} {passage} {i} {base[-i]}") for i, b in enumerate(base)]
    # Near copies: one word of twenty changed.
    for i, b in enumerate(base):
        w = b.split()
        for j in range(5, len(w), 40):
            w[j] = f"new{i}"
        docs.append((300 + i, "\n".join(w)))
    docs += [(400, "a " * 100), (401, "a b " * 60), (402, None), (403, ""), (None, base[3]), (404, base[4]), (404, base[4])]
    return docs + [(405, "\t" + passage + "\v\f end"), (406, " ".join(passage.split()[:34])), (407, prose(4000) * 2)]


@pytest.mark.parametrize("group_spans", [1000, 3])
def test_against_brute_force(frame, group_spans):
    docs = documents()
    got = substrings.without_repeats(frame(docs), group_spans=group_spans)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "text"]
    rows = got.collect()
    assert sorted((tuple(r)[:4] for r in rows), key=repr) == brute(docs)
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in rows)


def test_other_window(frame):
    docs = documents()[:80]
    got = substrings.without_repeats(frame(docs), window=50)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=repr) == brute(docs, 50)
    with pytest.raises(ValueError):
        substrings.without_repeats(frame(docs), window=10)


def test_one_passage_in_most_documents(frame):
    passage = " ".join(f"p{i}" for i in range(50))
    docs = [(i, f"before{i} {passage} after{i}") for i in range(400)] + [(900 + i, f"alone{i} " * 3) for i in range(30)]
    got = substrings.without_repeats(frame(docs), group_spans=20)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=repr) == brute(docs)


def test_empty(frame):
    assert substrings.without_repeats(frame([])).count() == 0
