import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from fleetlens.llm import packing
from fleetlens.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_tokenizers(tokenizer):
    r = random.Random(3)
    parts = """a B é É ß × ÷ ø ı İ Σ ς µ ª .. ... . %%% &&& 's ' - _ 1 23 日 本 <| <|endoftext|> |> the Cat !?""".split()
    parts += [" ", "  ", "\n", "\t", "\r", "\x1c", " ", " ", "é", "\x00"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(1500)] + ["", "é." * 9, "word " * 300_000]
    cache = packing.WordCache(PATH, slots_log2=12)
    for i in range(0, len(texts), 100):
        for text, got in zip(texts[i : i + 100], cache.ids(texts[i : i + 100]), strict=True):
            assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:80]


def check(rows, got, tokenizer, limits):
    want = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for _, t in rows]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert sum(r.length for r in got) == sum(map(len, want))
    for (doc_id, _), ids in zip(rows, want, strict=True):
        if sum(d == doc_id for d, _ in rows) > 1 or doc_id is None:
            continue
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for rows_ in sequences.values():
        at = 0
        for r in sorted(rows_, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limits.tokens and len(rows_) <= limits.segments and sum(r.loss_tokens for r in rows_) <= limits.loss_tokens
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    return padding


def test_pack(frame, tokenizer):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["alpha", "beta.", "Gamma", "x9"]) for _ in range(int(r.paretovariate(0.8) * 20)))[:60_000]) for i in range(300)]
    rows += [(500, None), (501, ""), (502, "word " * 9000), (7, "again"), (None, "lost")]
    got = packing.pack(frame(rows), PATH).collect()
    assert check(rows, got, tokenizer, packing.Limits()) == 0


def test_short_documents_need_no_padding(frame, tokenizer):
    rows = [(i, "alpha beta") for i in range(2500)] + [(9000 + i, None) for i in range(600)]
    got = packing.pack(frame(rows).coalesce(1), PATH).collect()
    assert check(rows, got, tokenizer, packing.Limits()) == 0
    # Nor where loss tokens end a sequence, or a part of a long example.
    limits = packing.Limits(tokens=256, segments=5, loss_tokens=100)
    rows = [(i, "word " * (i % 40)) for i in range(300)] + [(9000, "word " * 999)]
    assert check(rows, packing.pack(frame(rows), PATH, limits=limits).collect(), tokenizer, limits) == 0


def test_all_limits_hold(frame, tokenizer, spark):
    from pyspark.sql import functions as F

    rows = [(i, "word " * (i % 40)) for i in range(400)]
    limits = packing.Limits(tokens=256, segments=5, loss_tokens=100)
    df = frame(rows).withColumn("answer", F.col("doc_id") % 3 == 0)
    got = packing.pack(df, PATH, loss_col="answer", limits=limits).collect()
    check(rows, got, tokenizer, limits)
    assert {r.loss_tokens > 0 for r in got if r.doc_id % 3} == {False}


def test_whole_examples(frame):
    rows = [(i, "word " * (i % 40)) for i in range(100)]
    got = packing.pack(frame(rows), PATH, limits=packing.Limits(tokens=64), cut=False).collect()
    assert len(got) == 100 and all(r.length == r.doc_tokens for r in got)


def test_empty(frame):
    assert packing.pack(frame([]), PATH).count() == 0
