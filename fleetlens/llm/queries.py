"""One query per operator, with its SQL where SQL can express the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import collocations, exact, hosttext, jaccard, langid, lmscore, maxscore, mixing, packing, shared, spelling, substrings, toxicity, warc
from fleetlens.llm.shared import table

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
SQL: dict[str, str] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(build: Build) -> Build:
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


@query("op1_language_id")
def op1(spark, folder):
    return langid.identify(table(spark, folder, "documents"))


@query(
    "op2_maxscore",
    """WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id) q JOIN v c ON q.vec_id <> c.vec_id)
    SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM s
    WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10""",
)
def op2(spark, folder):
    return maxscore.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op3_substring_dedup")
def op3(spark, folder):
    return substrings.without_repeats(table(spark, folder, "documents")).drop("text")


@query("op4_host_text")
def op4(spark, folder):
    return hosttext.extract(table(spark, folder, "pages"))


@query("op5_toxicity")
def op5(spark, folder):
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query(
    "op6_exact_dedup",
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
    FROM d JOIN g USING (t)""",
)
def op6(spark, folder):
    return exact.copies(table(spark, folder, "documents"), keep="largest")


@query("op10_mixing")
def op10(spark, folder):
    return mixing.mix(table(spark, folder, "documents"))


@query("op7_jaccard_join")
def op7(spark, folder):
    return jaccard.near_duplicates(table(spark, folder, "documents"))


@query("op8_packing")
def op8(spark, folder):
    return packing.pack(table(spark, folder, "documents"), tokenizer=vocabulary("word_bpe_49k.json")).drop("loss_tokens")


@query(
    "op9_warc",
    """WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
    r AS (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS payload_digest,
      CASE WHEN strlen(t) >= 1000 THEN max(page_id) OVER (PARTITION BY t) ELSE page_id END AS response FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> response THEN response END AS refers_to FROM r""",
)
def op9(spark, folder):
    archives = warc.write(table(spark, folder, "pages"), shared.new_folder(spark, "warc"))
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op11_spelling")
def op11(spark, folder):
    return spelling.variants(table(spark, folder, "documents"))


@query(
    "op12_collocations",
    r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
      FROM documents),
    p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?
-]')) AS piece FROM d),
    w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM p),
    s AS (SELECT lang, ws, unnest([1, 2, 3, 4]) AS k FROM w),
    o AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM s WHERE len(ws) >= k),
    f AS (SELECT lang, k, ws[i : i + k - 1] AS ph, count(*) AS n FROM o GROUP BY ALL),
    c AS (SELECT * FROM f WHERE k > 1 AND n >= 30),
    u AS (SELECT lang, k, ph, n AS a, unnest(range(1, k)) AS j FROM c),
    x AS (SELECT u.lang, u.ph, u.a, u.j, l.n AS l, r.n AS r, 2000000::HUGEINT * a // (l.n + r.n) AS score FROM u
      JOIN f l ON l.lang = u.lang AND l.ph = u.ph[1 : j] JOIN f r ON r.lang = u.lang AND r.ph = u.ph[j + 1 : u.k]),
    y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, j) = 1),
    m AS (SELECT lang, k, ph, n, unnest(range(2, k)) AS size FROM c WHERE k > 2),
    v AS (SELECT lang, ph, n, size, unnest(range(1, k - size + 2)) AS i FROM m),
    z AS (SELECT lang, ph[i : i + size - 1] AS ph, max(n) AS around FROM v GROUP BY ALL),
    t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
    b AS (SELECT y.*, t.n, array_to_string(y.ph, ' ') AS phrase FROM y JOIN t ON t.lang = y.lang
      LEFT JOIN z ON z.lang = y.lang AND z.ph = y.ph WHERE around IS NULL OR 100::HUGEINT * around < 80 * a)
    SELECT lang, row_number() OVER q AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM b
    WINDOW q AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER q <= 2000""",
)
def op12(spark, folder):
    return collocations.collocations(table(spark, folder, "documents"))


@query("op13_lm_score")
def op13(spark, folder):
    return lmscore.scores(table(spark, folder, "documents"))
