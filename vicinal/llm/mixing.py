"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Every source gets a share of all words by its weight; a share stops at ``most`` times the source's
own words and what is above goes to the others by weight, until none is above (the water level of
``targets``). Within a source every document is expected target / words times. The documents' running
sum of expected copies plus one random offset for the source is emitted once for each integer
boundary that a document's step crosses.

The running sum needs each document's rank in its source, and a source may hold a third of all
rows. So documents are ranked in cells (source, band of sizes, bucket of ids): a cell's rows are
numbered in their own task, and only the cells' counts are summed along a source. The number of
buckets follows the square root of the row count, so both the cells of a source and the rows of a cell
grow slowly. Order by bands also keeps the words taken near the target, since like sizes are sampled
together.

Defined results: null or empty text has size 0. A null source is a source of its own, last in
order. Null ids are dealt to buckets by a hash of their text. Repeated rows are documents of their own. A source without words has target 0 and takes nothing.
Empty tables give empty results. Other columns are kept by
``mix``; names that begin with ``__mix`` are reserved.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def weights_by_order(sources: DataFrame, weights: Sequence[int]) -> DataFrame:
    """A weight for each row of ``sources``: the given ones in turn, by code point, null last."""
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))


def targets(sources: DataFrame, most: int) -> DataFrame:
    """``sources`` (source, source_size, weight) with target: the level L for which the sum of
    min(weight * L, most * source_size) is the sum of all sizes. One row per source."""
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = sources.withColumns({
        "_turn": F.row_number().over(order),
        "_left": F.sum("source_size").over(all_rows) - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0)),
        "_weights": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    stops = most * F.col("source_size").cast("double") * F.col("_weights") <= F.col("weight").cast("double") * F.col("_left")
    s = s.withColumn("_stops", stops)
    first = F.min(F.when(~F.col("_stops"), F.struct("_turn", "_left", "_weights"))).over(all_rows)
    s = s.withColumn("_first", first)
    share = (F.col("weight") * F.col("_first._left")).cast("double") / F.col("_first._weights")
    capped = F.col("_first").isNull() | (F.col("_turn") < F.col("_first._turn"))
    target = F.when(capped, (most * F.col("source_size")).cast("double")).otherwise(share)
    return s.select("source", "source_size", "weight", target.alias("target"))


def size_band(size: Column) -> Column:
    """Sixteen bands for each doubling, in whole numbers and in the order of sizes."""
    bits = F.length(F.bin(size)).cast("int")
    return bits * 32 + F.expr("shiftright(size, greatest(length(bin(size)) - 5, 0))").cast("int")


def offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) for each source, the same on each run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


def copies(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: int = 17) -> DataFrame:
    """``sized`` (any columns with doc_id, source, size; read twice, so best a written table) with
    source_size, target and copies."""
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rows = per_source.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, math.ceil(math.sqrt(rows / 50)))
    shares = targets(weights_by_order(per_source.select("source", "source_size"), weights), most)
    # the odd multiplier deals out ids that share a factor
    key = F.coalesce("doc_id", "__mix_key") if "__mix_key" in sized.columns else F.coalesce("doc_id", F.lit(0))
    bucket = F.pmod(F.pmod(key, F.lit(1000003)) * 7919, F.lit(buckets)).cast("int")
    placed = sized.withColumns({"_band": size_band(F.col("size")), "_bucket": bucket})
    cells = placed.groupBy("source", "_band", "_bucket").agg(F.count("*").alias("_n"))
    along = Window.partitionBy("source").orderBy("_band", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(along), F.lit(0)))
    c, s = cells.alias("c"), shares.alias("s")
    cells = c.join(s, F.expr("c.source <=> s.source")).select(
        F.col("c.source").alias("_source"), F.col("c._band").alias("_b"), F.col("c._bucket").alias("_k"), "_before", "source_size", "target", offset(F.col("c.source"), seed).alias("_offset")
    )
    within = Window.partitionBy("source", "_band", "_bucket").orderBy("size", F.col("doc_id").asc_nulls_first())
    ranked = placed.withColumn("_rank", F.row_number().over(within))
    out = ranked.join(cells, F.expr("source <=> _source and _band = _b and _bucket = _k"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = lambda rank: F.floor(rank * rate + F.col("_offset"))
    at = F.col("_before") + F.col("_rank")
    crossed = F.least(upto(at) - upto(at - 1), F.lit(most).cast("long"))
    return out.withColumn("copies", F.when(F.col("size") > 0, crossed).otherwise(F.lit(0).cast("long"))).drop(
        "_band", "_bucket", "_rank", "_source", "_b", "_k", "_before", "_offset"
    )


def _sized(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("__mix_key"))


def plan_mix(documents: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row of ``documents``. The text is read once;
    what follows reads the written ids and sizes."""
    sized = materialise(_sized(documents))
    out = copies(sized, weights, most, seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(documents: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, seed: int = 17) -> DataFrame:
    """The rows of ``documents``, each as often as the mix takes it. Rows alike in id, source and size
    get their copies together: the total of such a group is dealt out over its rows."""
    keyed = documents.withColumn("__mix_size", n_words(F.col("text")))
    sized = materialise(_sized(documents))
    dealt = copies(sized, weights, most, seed).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("__mix_copies"), F.count("*").alias("__mix_rows"))
    alone = dealt.where("__mix_rows = 1 and __mix_copies > 0")
    d = keyed.alias("d")
    on = lambda x: F.expr(f"d.doc_id <=> {x}.doc_id and d.source <=> {x}.source and d.__mix_size = {x}.size")
    kept = d.join(alone.alias("a"), on("a")).select("d.*", "a.__mix_copies")
    shared = dealt.where("__mix_rows > 1 and __mix_copies > 0")
    turn = F.row_number().over(Window.partitionBy("doc_id", "source", "__mix_size").orderBy("text"))
    extra = d.join(shared.alias("a"), on("a")).select("d.*", "a.__mix_copies", "a.__mix_rows").withColumn("__mix_turn", turn)
    share = F.floor(F.col("__mix_copies") / F.col("__mix_rows")) + (F.col("__mix_turn") <= F.col("__mix_copies") % F.col("__mix_rows")).cast("long")
    extra = extra.withColumn("__mix_copies", share).where("__mix_copies > 0").drop("__mix_rows", "__mix_turn")
    out = kept.unionByName(extra)
    return out.withColumn("__mix_one", F.explode(F.array_repeat(F.lit(1), F.col("__mix_copies").cast("int")))).select(*documents.columns)
