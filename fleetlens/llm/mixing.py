"""Mixing sources to target weights.

The words of a source are packed, document after document, into blocks of a fixed length; blocks of
small sources are shorter, so that each has some hundreds. The mix is a row of output shards with a
fixed number of slots. How many slots of a shard each source gets is multinomial, given that all
shards together meet the targets: the slots of the whole mix, as many for each source as its target
asks for, go through one pseudorandom permutation, which deals them to the shards like a shuffled
deck. The slots of a source go through a pseudorandom permutation of its block numbers, a new one for
each pass over the source, and blocks are joined by number. Everything runs as DataFrame
expressions. No step holds a whole source or all slots: prefix sums go over chunks, and slots are
unfolded in three steps and dealt out in between.

Defined cases: a null text has no words; a null source is a source of its own, the last one; a
source without words has the target 0; texts of any length are counted whole; repeated rows are
mixed as rows of their own, those that agree in identifier and size in either order; an empty table
gives an empty result; other columns are not looked at, and stay as they are where whole rows come
back, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm import shared

BLOCK_WORDS = 32
# A source has at least so many blocks, if it has as many words.
SOURCE_BLOCKS = 512
SHARD_SLOTS = 4096
UNFOLD_LOG2 = 14
# Multipliers of the block permutations: primes, of which two that do not divide the number of
# blocks are used. Small enough that a product with 2^43 blocks is exact.
PRIMES = (1000003, 1000033, 1000037, 1000039, 1000081, 1000099, 1000117, 1000121)


def uniform(*parts: Column | str) -> Column:
    """A reproducible number in [0, 1) for each combination of the parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)).cast("double") / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """Per source: s (its number by code point, null last), source_size, target.

    Targets are weight times a common level, or ``limit`` times the source's size where that is
    less; the level is such that targets add up to ``share`` of all words. Sources are ordered by
    the level at which they stop, which makes the sums running ones. One row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.col("source").asc_nulls_last()
    per = shared.in_order(per.withColumn("one", F.lit(1).cast("long")), order, name="mix-sources")
    per = shared.running_total(per, [], "chunk", [order], "one", "s").drop("chunk", "one")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    per = per.withColumns({"weight": pick, "most": F.col("source_size") * float(limit)})
    order = [F.col("stops_at"), F.col("s")]
    per = shared.in_order(per.withColumn("stops_at", F.col("most") / F.col("weight")), *order, name="mix-levels")
    totals = per.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    for value, out in (("most", "most_before"), ("weight", "weight_before")):
        per = shared.running_total(per, [], "chunk", order, value, out)
    # The first source that its level does not reach sets the level of all later ones.
    level = (float(totals["size"] or 0) * float(share) - F.col("most_before")) / (float(totals["weight"] or 0) - F.col("weight_before"))
    per = shared.written(per.withColumn("own_level", level), "mix-levels")
    level = per.agg(F.max(F.when(F.col("own_level") < F.col("stops_at"), F.col("own_level")))).first()[0]
    target = F.col("most")
    if level is not None:
        target = F.when(F.col("stops_at") <= level, F.col("most")).otherwise(F.col("weight") * level)
    return per.select("source", "s", "source_size", target.alias("target"))


def permutation(n: Column, seed: list[Column]) -> dict[str, Column]:
    """The numbers that make up a pseudorandom permutation of 0..n-1, chosen by the seed: the same for all that it permutes."""

    def multiplier(which: int) -> Column:
        first = F.pmod(F.xxhash64(*seed, F.lit(which)), F.lit(len(PRIMES))).cast("int")
        tried = F.array(*[F.lit(p) for p in PRIMES])
        turns = [F.element_at(tried, F.pmod(first + i, F.lit(len(PRIMES))).cast("int") + 1).cast("long") for i in range(3)]
        # Two of the primes could only both divide n above 10^12 blocks, three above 10^18.
        return F.when(n % turns[0] != 0, turns[0]).when(n % turns[1] != 0, turns[1]).otherwise(turns[2])

    def shift(which: int) -> Column:
        return F.pmod(F.xxhash64(*seed, F.lit(which + 10)), n)

    width = F.greatest(F.floor(F.sqrt(n.cast("double"))).cast("long"), F.lit(1))
    whole = n - n % width
    height = F.greatest(F.floor(whole / width).cast("long"), F.lit(1))
    return {"by_1": multiplier(1), "on_1": shift(1), "by_2": multiplier(2), "on_2": shift(2), "width": width, "whole": whole, "height": height}


def permuted(x: Column, n: Column, seed: list[Column], made_of: dict[str, Column] | None = None) -> Column:
    """A pseudorandom permutation of 0..n-1, chosen by the seed.

    An affine map, then numbers as a grid whose columns and rows are turned by hashes, then an affine map.
    Where there are many x, ``made_of`` holds columns in which ``permutation`` was computed before.
    """
    p = made_of or permutation(n, seed)
    v = (x * p["by_1"] + p["on_1"]) % n
    row, col = F.floor(v / p["width"]).cast("long"), v % p["width"]
    row = (row + F.pmod(F.xxhash64(*seed, F.lit(30), col), p["height"])) % p["height"]
    turned = row * p["width"] + (col + F.pmod(F.xxhash64(*seed, F.lit(20), row), p["width"])) % p["width"]
    return (F.when(v < p["whole"], turned).otherwise(v) * p["by_2"] + p["on_2"]) % n


def in_blocks(sources: DataFrame, block_words: int, source_blocks: int, limit: int) -> DataFrame:
    """The sources with words and a target: with block_words, blocks and slots, the blocks that the mix takes."""
    length = F.floor(F.col("source_size") / source_blocks).cast("long")
    used = sources.filter("source_size > 0 and target > 0")
    used = used.withColumn("block_words", F.greatest(F.lit(1).cast("long"), F.least(F.lit(block_words).cast("long"), length)))
    used = used.withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("long"))
    want = F.round(F.col("target") / F.col("block_words")).cast("long")
    return used.withColumn("slots", F.greatest(F.lit(1).cast("long"), F.least(want, F.col("blocks") * limit)))


def unfolded(rows: DataFrame, count: str, out: str, keep: list[str]) -> DataFrame:
    """Each row as often as ``count`` says, numbered from 0 in ``out``; no row gives more than 2^UNFOLD_LOG2 at once."""
    # A stated number, since few rows that unfold to many would be put into one task.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(*keep, count, F.lit(0).cast("long").alias(out))
    for step in (2 * UNFOLD_LOG2, UNFOLD_LOG2, 0):
        last = F.least(F.shiftright(F.col(count) - 1, step) - F.shiftleft(F.col(out), UNFOLD_LOG2), F.lit((1 << UNFOLD_LOG2) - 1).cast("long"))
        # What is over in the first step goes on in it, since numbers there have no limit.
        last = F.shiftright(F.col(count) - 1, step) if step == 2 * UNFOLD_LOG2 else last
        low = F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("low")
        rows = rows.select(*keep, count, out, low).withColumn(out, F.shiftleft(F.col(out), UNFOLD_LOG2) + F.col("low")).drop("low")
        if step:
            rows = rows.repartition(tasks, *keep[:2], out)
    return rows


def slots(sources: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """One row per slot of the mix: shard, place in it, source number s, and the block that fills it; sources as of ``in_blocks``."""
    placed = shared.in_order(sources, F.col("s"), name="mix-slots")
    placed = shared.running_total(placed, [], "chunk", [F.col("s")], "slots", "slots_before")
    total = sources.agg(F.sum("slots")).first()[0] or 0
    # A row for each pass over a source, with its permutation; a pass takes each block once, the last one maybe not all.
    passes = F.floor((F.col("slots") - 1) / F.col("blocks")).cast("long")
    rows = placed.withColumn("again", F.explode(F.sequence(F.lit(0).cast("long"), passes)))
    before = F.col("again") * F.col("blocks")
    seed = [F.col("s"), F.col("again")]
    made_of = permutation(F.col("blocks"), seed)
    rows = rows.select(
        *seed, "blocks", (F.col("slots_before") + before).alias("slots_before"), F.least("blocks", F.col("slots") - before).alias("taken"),
        *[c.alias(name) for name, c in made_of.items()],
    )
    rows = unfolded(rows, "taken", "j", ["s", "again", "blocks", "slots_before", *made_of])
    block = permuted(F.col("j"), F.col("blocks"), seed, {name: F.col(name) for name in made_of})
    at = permuted(F.col("slots_before") + F.col("j"), F.lit(total).cast("long"), [F.lit("shard")])
    shard, place = F.floor(at / F.lit(shard_slots)).cast("long"), at % F.lit(shard_slots).cast("long")
    return rows.select(shard.alias("shard"), place.alias("place"), "s", block.alias("block"))


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    limit: int = 2,
    block_words: int = BLOCK_WORDS,
    source_blocks: int = SOURCE_BLOCKS,
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken.

    A block is taken at most ``limit`` times.
    """
    pieces = shared.pieces_of_a_group(df.sparkSession)
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(shared.WORD)), F.lit(0)).cast("long")
    sizes = shared.written(
        df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words.alias("size")), "mix-sizes"
    )
    sources = shared.written(source_targets(sizes, weights, share, limit), "mix-targets")
    used = shared.written(in_blocks(sources, block_words, source_blocks, limit), "mix-blocks")

    docs = sizes.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    docs = docs.select("doc_id", "s", "size", "source_size", "target")
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit("chunk")), F.lit(pieces)))
    laid = shared.running_total(docs.filter("size > 0"), ["s"], "chunk", [F.col("doc_id"), F.col("size")], "size", "start")
    laid = laid.join(used.select("s", "block_words"), "s", "left").withColumn("block_words", F.coalesce("block_words", F.lit(block_words).cast("long")))
    end, length = F.col("start") + F.col("size"), F.col("block_words")
    first, last = F.floor(F.col("start") / length), F.floor((end - 1) / length)
    parts = laid.withColumn("block", F.explode(F.sequence(first, last)))
    inside = F.least(end, (F.col("block") + 1) * length) - F.greatest(F.col("start"), F.col("block") * length)
    parts = parts.withColumn("inside", inside).drop("chunk", "block_words")

    drawn = slots(used).groupBy("s", "block").agg(F.count(F.lit(1)).alias("times"))

    # Spark takes exploded rows for as few as the sources they come from; it must not broadcast them.
    taken = parts.join(drawn.hint("merge"), ["s", "block"], "left")
    taken = taken.groupBy("doc_id", "s", "start", "size", "source_size", "target").agg(
        F.sum(F.col("inside") * F.coalesce("times", F.lit(0))).alias("taken")
    )
    out = ["doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken")]
    return taken.select(*out).unionByName(docs.filter("size = 0").withColumn("taken", F.lit(0)).select(*out))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of the mix, all columns: each document as often as the mix takes its words, in whole copies.

    A document whose words are taken 1.4 times comes once or twice. Which of the two is drawn
    systematically over a source's documents in the order of their size, so that the words of a
    source stay near its target. Documents without words are not part of a mix.
    """
    pieces = shared.pieces_of_a_group(df.sparkSession)
    key_, place_, copies_, copy_ = (shared.free_name(df, c) for c in ("_key", "_place", "_copies", "_copy"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(source_col).cast("string"), text)
    order = [F.col(f"`{c}`") for c in df.columns if c != text_col]
    rows = df.withColumn(key_, key)
    rows = rows.withColumn(place_, F.row_number().over(Window.partitionBy(key_).orderBy(*order)))

    plain = rows.select(F.col(key_).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    taken = mix(plain, **options).filter("taken > 0")
    by_size = F.floor(F.log2(F.col("size").cast("double")) * 4).cast("long") * pieces + F.pmod(F.xxhash64("doc_id", F.lit("size")), F.lit(pieces))
    # Shares in millionths, so that sums do not depend on their order.
    taken = taken.select(
        "doc_id", F.xxhash64("source_size", "target").alias("s"), by_size.alias("chunk"),
        F.round(F.col("taken") / F.col("size") * 1_000_000).cast("long").alias("share"), "size",
    )
    total = shared.running_total(shared.written(taken, "mix-taken"), ["s"], "chunk", [F.col("size"), F.col("doc_id")], "share", "before")
    start = F.pmod(F.xxhash64("s", F.lit("start")), F.lit(1_000_000))
    copies = F.floor((F.col("before") + F.col("share") + start) / 1_000_000) - F.floor((F.col("before") + start) / 1_000_000)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("before")))
    copies = total.select(F.col("doc_id").alias(key_), place.alias(place_), copies.cast("int").alias(copies_)).filter(F.col(copies_) > 0)
    mixed_rows = rows.join(copies, [key_, place_])
    names = [F.col(f"`{c}`") for c in df.columns]
    return mixed_rows.select(*names, F.explode(F.sequence(F.lit(1), F.col(copies_))).alias(copy_)).drop(copy_)
