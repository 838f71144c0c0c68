import random
import zlib

import numpy as np

from fleetlens.llm import langid

SYLLABLES = {"en": ["th", "er", "on", "an", "re", "ing"], "de": ["sch", "ein", "ung", "ö", "keit"], "es": ["ción", "ñ", "os", "ar", "ez"]}


def text(r, lang, words):
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 4))) for _ in range(words))


def rows(n=900):
    r = random.Random(4)
    return [(i, text(r, lang := r.choice(list(SYLLABLES)), r.choice([1, 3, 20, 300])), lang) for i in range(n)]


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_accuracy_and_no_leak(frame):
    data = rows()
    # Labels of the held-out fold are false: who learned from them would be wrong.
    given = [(i, t, "xx" if held_out(i) else lang) for i, t, lang in data]
    got = langid.identify(frame(given)).collect()
    assert {r.doc_id: r.held_out for r in got} == {i: held_out(i) for i, _, _ in data}
    truth = {i: lang for i, _, lang in data}
    fold = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in fold]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_defined_cases(frame):
    r = random.Random(9)
    odd = [(2000, None, "en"), (2001, "", "en"), (2002, "12 %% 3", "de"), (2003, text(r, "de", 60_000), None), (None, text(r, "es", 50), None)]
    odd += [(2004, text(r, "en", 40), None)] * 2
    got = {r.doc_id: (r.lang_pred, r.held_out) for r in langid.identify(frame(rows(300) + odd)).collect()}
    assert [got[i][0] for i in (2000, 2001, 2002, 2003, None, 2004)] == ["und", "und", "und", "de", "es", "en"]
    assert got[None][1] is False


def test_nothing_to_learn_from(frame):
    assert langid.identify(frame([])).count() == 0
    got = langid.identify(frame([(1, "some words", None)])).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]


def test_whole_text_counts():
    net = langid.ByteNet(["a", "b"])

    class Text(str):
        def as_py(self):
            return str(self)

    short = list(langid.predicted(net, [Text("x" * 256)]))
    both = list(langid.predicted(net, [Text("x" * 256 + "qzj " * 5000)]))
    assert short != both
    many = list(langid.predicted(net, [Text("x" * n) for n in (0, 1, 256, 257, 100_000)], group_windows=2))
    assert many[0] == ("und", 0.0) and [m[1] > 0 for m in many] == [False, True, True, True, True]


def test_pooling_is_over_all_places():
    net = langid.ByteNet(["a", "b", "c"])
    x = np.random.default_rng(1).integers(0, 256, (5, 256)).astype(np.uint8)
    direct = (net.columns(x) @ net.p["conv"]).reshape(5, 256, -1).max(axis=1)
    assert np.array_equal(net.pooled(x), direct)
