"""Line dedup by distinct-site spread. DataFrame functions only.

A HyperLogLog sketch of the sites is kept for each line hash; sketches merge by aggregation, so a
line that stands in a third of all documents leaves each task as one sketch. Lines whose estimate is
far from ``min_sites`` are decided by it. Near it, sites are counted exactly. A line on
``min_sites`` sites or more is boilerplate: it goes from every document but the first one that has it, so
that nothing goes from the corpus altogether and the first of many copies stays whole.

Defined results: a line is its text without spaces, tabs and carriage returns around it; blank lines
always stay. A null site is none. Null text stays null. Documents left without lines stay, with empty text.
The first document is the one with the smallest id; rows with a null id keep their lines only if all such rows have null ids.
Rows that repeat an id and text are treated alike. Other columns are kept; names beginning with ``__ld`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers (log2) of a sketch; its standard error is about 1.6 %.
LG_K = 12
#: Estimates within this factor of the threshold are counted exactly: some fifteen standard errors.
NEAR = 1.25


def clean_line(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def lines_of(documents: DataFrame, *keep: str) -> DataFrame:
    """A row for each line that isn't blank: the columns ``keep``, its place and its hash."""
    return (
        documents.select(*keep, F.posexplode(F.split("text", "\n", -1)).alias("_at", "_line"))
        .withColumn("_line", clean_line(F.col("_line")))
        .where("_line <> ''")
        .select(*keep, "_at", F.xxhash64("_line").alias("_hash"))
    )


def boilerplate(documents: DataFrame, min_sites: int = 10, site: str = "source") -> DataFrame:
    """``_hash, _first`` of the lines on at least ``min_sites`` sites; _first is the smallest doc_id."""
    spread = lines_of(documents, "doc_id", site).groupBy("_hash").agg(F.hll_sketch_agg(F.col(site), LG_K).alias("_sketch"), F.min("doc_id").alias("_first"))
    about = spread.select("_hash", "_first", F.coalesce(F.hll_sketch_estimate("_sketch"), F.lit(0)).alias("_sites")).where(F.col("_sites") * NEAR >= min_sites)
    far = about.where(F.col("_sites") > NEAR * min_sites).select("_hash", "_first")
    near = about.where(F.col("_sites") <= NEAR * min_sites).select("_hash", "_first")
    # distinct (line, site) pairs are made before the shuffle
    pairs = lines_of(documents, site).join(near, "_hash", "left_semi").where(F.col(site).isNotNull()).groupBy("_hash", site).agg(F.lit(1).alias("_one"))
    counted = pairs.groupBy("_hash").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_sites)
    return far.unionByName(near.join(counted, "_hash").select("_hash", "_first"))


def dedup_lines(documents: DataFrame, min_sites: int = 10, site: str = "source", names: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``documents`` with boilerplate lines taken from text, and the numbers of its lines before and of those removed. Columns that have
    one of ``names`` are replaced; other names keep them.

    A document's places to remove (a few numbers) meet its text by id and hash of the text; nothing
    else of the lines is shuffled.
    """
    from .common import materialise

    keyed = documents.withColumn("__ld_text", F.xxhash64("text"))
    known = materialise(boilerplate(documents, min_sites, site))
    found = lines_of(keyed, "doc_id", "__ld_text").join(known, "_hash").where(~F.col("doc_id").eqNullSafe(F.col("_first")))
    places = found.groupBy("doc_id", "__ld_text").agg(F.collect_set("_at").alias("__ld_places")).select(F.col("doc_id").alias("__ld_id"), F.col("__ld_text").alias("__ld_of"), "__ld_places")
    joined = keyed.join(places, F.expr("doc_id <=> __ld_id and __ld_text = __ld_of"), "left")
    lines = F.split("text", "\n", -1)
    rest = F.filter(lines, lambda _, i: ~F.array_contains(F.col("__ld_places"), i))
    text = F.when(F.col("__ld_places").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    return joined.withColumns({"text": text, names[0]: F.coalesce(F.size(lines), F.lit(0)), names[1]: F.greatest(F.coalesce(F.size("__ld_places"), F.lit(0)), F.lit(0))}).drop("__ld_text", "__ld_id", "__ld_of", "__ld_places")
