"""Exact top-k search by inner product, after MaxScore.

Every dimension is a term with a dense posting list. In a shard of vectors a term's contribution to
a query lies between two bounds that the shard's least and largest component give; what it can add
above the lower one is its score bound. Terms are split: the largest prefix of small bounds that
together cannot lift a vector over the current k-th score is non-essential. The postings of the
essential terms are summed; the others are probed, largest bound first, only for vectors that can
still compete. The k best of each shard are merged.

Vectors and queries are laid out in blocks of bounded size; each query block meets each shard, which
is what a stated query set against all rows asks for. Sums are integers and exact: products go
through floats only where the shard's values prove that nothing is rounded.

Defined cases: vectors that are null or hold null or non-finite components, and rows without an
identifier, take no part; vectors of different lengths agree as if the shorter went on with zeros;
every row of a repeated identifier is a candidate, except for queries of the same identifier; a
query identifier that repeats is asked once, with its smallest vector; equal scores go to the
smaller identifier; components so large that a score could pass 64 bits are an error; vectors of any
length are searched whole; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm import shared

SHARD_ROWS = 2048
QUERY_ROWS = 512
SEED_ROWS = 256
BLOCK = "ids binary, vectors binary, dims int"


def usable(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id and integer vector of the rows that take part."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return df.filter(v.isNotNull() & F.col(id_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))


def matrix(some: pd.DataFrame) -> tuple[bytes, bytes, int]:
    dims = max(map(len, some.v))
    out = np.zeros((len(some), dims), "<i8")
    for row, v in zip(out, some.v, strict=True):
        row[: len(v)] = v
    return some.vec_id.to_numpy("<i8").tobytes(), out.tobytes(), dims


def blocks(rows: DataFrame, most: int) -> DataFrame:
    """Rows of a partition laid out as matrices with at most ``most`` vectors."""

    def laid(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), most):
                yield pd.DataFrame([matrix(part.iloc[i : i + most])], columns=["ids", "vectors", "dims"])

    return rows.mapInPandas(laid, BLOCK)


def query_block(some: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([(some.q.iloc[0], *matrix(some))], columns=["q", "q_ids", "q_vectors", "q_dims"])


class Shard:
    """Postings of a block of vectors, term by term, and their bounds."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = ids.argsort(kind="stable")
        self.ids, postings = ids[order], vectors[order].T
        self.low, self.high = postings.min(axis=1), postings.max(axis=1)
        self.peak = float(np.abs(postings.astype(np.float64)).max(initial=0))
        self.postings = np.ascontiguousarray(postings)
        self.as_floats: np.ndarray | None = None

    def exact(self, q: np.ndarray) -> np.ndarray:
        """Postings in the type in which sums of products with q are exact."""
        most = np.maximum(np.abs(self.low.astype(np.float64)), np.abs(self.high.astype(np.float64)))[: len(q)]
        if float(np.abs(q.astype(np.float64)) @ most) >= 2**63:
            raise OverflowError("components are so large that scores could pass 64 bits")
        if self.peak * float(np.abs(q).max(initial=0)) * max(len(q), 1) < 2**52:
            if self.as_floats is None:
                self.as_floats = self.postings.astype(np.float64)
            return self.as_floats
        return self.postings

    def best(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers and scores of the k best vectors, ties to the smaller identifier."""
        d = min(len(q), len(self.postings))
        q, postings = q[:d], self.exact(q[:d])[:d]
        q = q.astype(postings.dtype)
        a, b = q * self.low[:d], q * self.high[:d]
        bound = np.abs(b - a)
        terms = bound.argsort(kind="stable")[::-1]
        # What the terms from a place on can add at most, beside the terms summed before it.
        rest = np.append(np.maximum(a, b)[terms][::-1].cumsum()[::-1], 0)
        other = self.ids != query_id

        seed = np.flatnonzero(other)[:SEED_ROWS]
        first = q @ postings[:, seed]
        floor = np.partition(first, len(first) - k)[len(first) - k] if len(first) >= k else None

        # Essential: terms before the place from which the rest alone stays below the k-th score.
        least = np.minimum(a, b)[terms].cumsum()
        spread = bound[terms][::-1].cumsum()[::-1]
        base = least[-1] if d else 0
        essential = d if floor is None else int((base + spread >= floor).sum())
        at = np.flatnonzero(other)
        chosen = terms[:essential]
        score = (q[chosen] @ postings[chosen])[at]
        done = essential
        while floor is not None and done < d:
            competes = score + rest[done] >= floor
            at, score = at[competes], score[competes]
            some = terms[done : done + 8]
            score = score + q[some] @ postings[np.ix_(some, at)]
            done += len(some)
        if len(at) > k:
            kth = np.partition(score, len(score) - k)[len(score) - k]
            at, score = at[score >= kth], score[score >= kth]
        order = np.lexsort((at, -score))[:k]
        return self.ids[at[order]], score[order].astype(np.int64)


def top_k(
    df: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    scale: int = 1024,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest inner product for each query row."""
    rows = usable(df, id_col, vector_col, scale)
    shards = shared.written(blocks(rows, shard_rows), "maxscore-shards")
    asked = usable(df.filter(is_query), id_col, vector_col, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = shared.written(asked, "maxscore-asked")
    n_blocks = -(-asked.count() // query_rows)
    if not n_blocks:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # Identifiers are distinct here, so a hash deals them evenly to the blocks.
    dealt = asked.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)))
    queries = dealt.groupBy("q").applyInPandas(query_block, "q long, q_ids binary, q_vectors binary, q_dims int")
    pairs = shards.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))).join(queries, "q")

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                shard = Shard(np.frombuffer(row.ids, "<i8"), np.frombuffer(row.vectors, "<i8").reshape(-1, row.dims))
                asked = np.frombuffer(row.q_vectors, "<i8").reshape(-1, row.q_dims)
                out = []
                for query_id, q in zip(np.frombuffer(row.q_ids, "<i8"), asked, strict=True):
                    ids, scores = shard.best(query_id, q, k)
                    out.append((np.full(len(ids), query_id), ids, scores))
                cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

    found = pairs.mapInPandas(search, "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
