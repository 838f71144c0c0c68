"""Registration, SQL twins and the pipeline, at small scale."""

from collections import Counter

import check
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from fleetlens.llm import packing, queries
from fleetlens.llm.queries import vocabulary

FOLDER = "/root/testdata/sf0.001"


def test_all_operators_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.QUERIES) < set(entry.queries()) and "pipeline" in entry.queries()
    assert set(queries.SQL) < set(entry.oracle_sql()) and "pipeline" not in entry.oracle_sql()


@pytest.mark.parametrize("name", list(queries.SQL))
def test_matches_sql(spark, name):
    assert check.spark_rows(queries.QUERIES[name](spark, FOLDER)) == check.oracle(check.connect(FOLDER), queries.SQL[name])


COLUMNS = {
    "op1_language_id": "doc_id held_out lang_pred score",
    "op2_maxscore": "query_id rank vec_id score",
    "op3_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op4_host_text": "page_id url text n_chars",
    "op5_toxicity": "doc_id held_out score predicted",
    "op6_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op7_jaccard_join": "doc_id n_shingles component_id",
    "op8_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op9_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op10_mixing": "doc_id size source_size target taken",
    "op11_spelling": "word form root n n_near form_n",
    "op12_collocations": "lang rank phrase a l r n score",
    "op13_lm_score": "doc_id held_out n_tokens n_known train_tokens base_score score",
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).columns == COLUMNS[name].split()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        docs = corpus_pipeline.written(docs, "test-stage")
        assert docs.columns == columns
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] >= seen[3] > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    times = Counter(r.doc_id for r in docs.select("doc_id").collect())
    cache = packing.WordCache(vocabulary("word_bpe_49k.json"))
    for doc_id, text in texts.items():
        tokens = len(cache.ids([text])[0]) + 1
        assert sum(p.length for p in pieces if p.doc_id == doc_id) == tokens * times[doc_id]
    whole = corpus_pipeline.run(spark, FOLDER)
    assert whole.columns == COLUMNS["op8_packing"].split()
    assert sorted((r.doc_id, r.doc_tokens) for r in whole.collect()) == sorted((r.doc_id, r.doc_tokens) for r in pieces)


def clashing(spark):
    """Documents with columns of the names that stages use, a null in each column, and repeated rows."""
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(i, f"{text} end{i % 5} {'x ' * i}", "en", f"s{i % 3}", i) for i in range(30)]
    rows += [(None, text, None, None, None), (100, None, "en", "s0", 0), (101, "", "en", "s1", 0), (102, text, None, None, 1)]
    rows += rows[3:5] + [(200, "long " * 60_000, "en", "s2", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    own = ["_id", "_sha", "_n", "_ref", "_key", "_place", "_copy", "_copies", "_text", "kept_text", "ref", "size", "block", "_ID_"]
    return df.withColumns({c: F.lit(f"own {c}") for c in own})


def test_stages_leave_other_columns_alone(spark):
    docs = clashing(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), "test-clash")
        assert docs.columns == columns, name
        rows = docs.collect()
        assert rows and all(r[c] == f"own {c}" for r in rows for c in columns[5:]), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).columns == COLUMNS["op8_packing"].split()


def test_an_empty_table_goes_through_the_stages(spark):
    docs = clashing(spark).limit(0)
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), "test-none")
        assert docs.columns == columns and docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == 0
