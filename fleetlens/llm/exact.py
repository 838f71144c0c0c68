"""Exact deduplication by content sort.

Rows are range-partitioned by their bytes with sampled splitters and sorted, so that equal texts
become neighbours; neighbours are compared in full. A group of copies may hold most of the table:
the sort key ends in a piece number drawn from the identifier, so that a large group runs over many
partitions. Each piece is counted where it lies, and the pieces of a text, one slim row each, are
added up by the digest of the text.

Defined cases: a null text counts as empty; equal identifiers with equal texts are copies of one
another and one of those rows stays; a null identifier is smaller than any other when the largest
stays and larger when the smallest stays; texts of any length are compared whole; an empty table
gives an empty result; other columns are not looked at, and stay as they are where whole rows come
back, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm import shared

HEAD_CHARS = 32


def copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise=None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep`` says which identifier of equal texts stays; ``normalise`` maps the text column
    before it is compared (none: texts are compared as they are).
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    best: Column
    if keep == "largest":
        best, order = F.max("doc_id"), F.col("doc_id").desc_nulls_last()
    else:
        best, order = F.min("doc_id"), F.col("doc_id").asc_nulls_last()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = normalise(text) if normalise else text
    pieces = shared.pieces_of_a_group(df.sparkSession)
    rows = df.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("doc_id"), F.lit(pieces)))

    # The splitters are sampled from the first bytes and a digest, so that what the driver gathers
    # stays small whatever the length of the texts; equal texts are neighbours all the same.
    place = ["head", "digest", "text", "piece"]
    rows = rows.withColumns({"head": F.substring("text", 1, HEAD_CHARS), "digest": F.xxhash64("text")})
    run = Window.partitionBy(*place)
    sorted_rows = rows.repartitionByRange("head", "digest", "piece").withColumns(
        {
            "place": F.row_number().over(run.orderBy(order)),
            "piece_size": F.count(F.lit(1)).over(run),
            "piece_best": best.over(run),
        }
    )
    slim = shared.written(
        sorted_rows.select(
            "doc_id", "piece", "place", "piece_size", "piece_best", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
        ),
        "content-sort",
    )
    # One row for each piece; a text has at most as many as there are pieces, and its sum goes back to each.
    text = Window.partitionBy("text_sha256")
    best_of_pieces = (F.max if keep == "largest" else F.min)("piece_best").over(text)
    totals = (
        slim.filter("place = 1")
        .select("text_sha256", "piece", F.sum("piece_size").over(text).alias("group_size"), best_of_pieces.alias("keep_id"))
        .filter("group_size > 1")
    )
    joined = slim.join(totals, ["text_sha256", "piece"], "left")
    single = F.col("group_size").isNull()
    keep_id = F.when(single, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        ((F.col("place") == 1) & F.col("doc_id").eqNullSafe(keep_id)).alias("kept"),
        "text_sha256",
    )


def without_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The input rows, all columns, with one row left of each text.

    Rows that agree in identifier and text are one row here, whatever else they hold.
    """
    id_, sha_, n_ = (shared.free_name(df, c) for c in ("_id", "_sha", "_n"))
    stay = copies(df, id_col, text_col, keep).filter("kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha_))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.withColumns({sha_: F.sha2(text.cast("binary"), 256), id_: F.col(id_col)})
    rows = rows.join(stay, (rows[sha_] == stay[sha_]) & rows[id_].eqNullSafe(stay[id_]), "left_semi")
    names = [F.col(f"`{c}`") for c in df.columns]
    first = Window.partitionBy(sha_, id_).orderBy(*[F.col(f"`{c}`") for c in df.columns if c != text_col])
    return rows.withColumn(n_, F.row_number().over(first)).filter(F.col(n_) == 1).select(*names)
