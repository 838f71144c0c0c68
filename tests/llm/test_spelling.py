"""Spelling variants against comparing every word with every other."""

import random
import re
import zlib
from collections import Counter

from fleetlens.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least_length=5, least_count=3, every=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}
    forms, near = {}, {}
    for w, n in words.items():
        found = [v for v in words if one_edit(w, v)]
        near[w] = len(found)
        best = min(found, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n, near[w], words.get(forms[w])))
    return sorted(out, key=str)


def result(df, **options):
    rows = spelling.variants(df, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted((tuple(r) for r in rows), key=str)


def corpus(seed, docs=60, letters="abé"):
    draw = random.Random(seed)
    words = ["".join(draw.choice(letters) for _ in range(draw.randint(3, 9))) for _ in range(150)]
    words += [w.upper() for w in words[:20]] + ["Straße", "STRASSE", "a" * 300, "a" * 301, "a" * 302]
    return [(i, " ".join(draw.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=60))) for i in range(docs)]


def test_scan_equals_brute_force():
    draw = random.Random(4)
    for t in range(400):
        words = sorted({"".join(draw.choice("abc"[: 2 + t % 2]) for _ in range(draw.randint(0, 5))) for _ in range(20)})
        lcp = [0] + [spelling.common(a, b) for a, b in zip(words, words[1:], strict=False)]
        for q in words:
            assert [words[i] for i in spelling.near(q, words, lcp)] == [w for w in words if one_edit(q, w)]


def test_variants_equal_brute_force(frame):
    rows = corpus(1)
    assert result(frame(rows)) == brute(rows)


def test_groups_are_divided_to_the_last_character(frame):
    rows = corpus(2, letters="ab")
    want = brute(rows, every=5)
    assert max(r[4] for r in want) > 5
    assert result(frame(rows), group_words=1, every=5) == want


def test_edges(frame):
    nothing = [(1, None), (2, ""), (3, "1 22 ?")]
    assert result(frame(nothing)) == [] and result(frame([])) == []
    rows = [(None, "words words words wordz wordz wordz swords swords swords"), (7, "Word\u00d7s " * 40), (7, "Word\u00d7s " * 40), (8, "x" * 70_000 + " " + "words" * 3)]
    assert result(frame(rows)) == brute(rows)


def test_ties_go_to_the_smaller_word(frame):
    rows = [(1, " ".join(["carte"] * 3 + ["carts"] * 6 + ["cartb"] * 6 + ["cart\u00e9"] * 6))]
    assert result(frame(rows), every=10**9)[0][:3] == ("cartb", None, "cartb")
    assert ("carte", "cartb", "cartb", 3, 3, 6) in result(frame(rows), every=10**9)
