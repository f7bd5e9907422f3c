"""Exact Jaccard join of documents on word n-grams, by vertical partitioning.

All distinct n-grams have one global order: those that are frequent last, by frequency, the others
first, by hash. Two sets that are similar enough share a gram in the first few of each (the prefix
bound), which gives candidate pairs. The order is cut into fragments, and each set with it into segments. Candidates meet
fragment by fragment: only the segments of one fragment come together, their common grams are counted there, and
the partial counts are summed for each pair. A link is decided by that exact sum alone.

Documents with equal sets are one node. A group of near copies is not expanded into all pairs: first
every node of a block (nodes that share a prefix gram) is compared with one of them: that which shares most of its prefix with others, as
the original of edited copies does, so that blocks of the same nodes choose the same. Then only pairs whose nodes are not yet connected are compared: in wide
blocks with another of the block's nodes, and at last, where nodes are still not connected, all pairs. So no
link between different components is lost, and pairs inside one need not be known. Where many nodes of a wide block are
left, it is cut into tiles by size and hash, and all pairs of two tiles are counted in one task, fragment after fragment.

Defined results: words are runs of characters other than space and \\t \\n \\v \\f \\r; A-Z are
lower-cased. A text of fewer than ``k`` words is one gram, the whole sequence. Null, empty and blank texts have
empty sets and link with nothing, not with each other either. Rows that repeat are equal sets. A null id
takes part; a component's id is the least that isn't null. An empty table gives an empty result. Extra
columns are ignored. Grams and sets are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import give_back, materialise, release, ship
from .components import components
from .kernels import U, mix, shingle_sets, texts_of

#: Grams counted together in a task before counts of one are dropped. Only the order hangs on it.
COUNT_AT_ONCE = 2_000_000
#: A gram is frequent from the least count on, but not below MIN_FREQUENT, at which no more than MAX_FREQUENT grams are: these
#: are sent to every task, 12 bytes each.
MIN_FREQUENT, MAX_FREQUENT = 4, 2_000_000
#: Of the global order: FRAGMENTS - 1 of ranges of hashes, the last of the frequent grams.
FRAGMENTS = 5
#: Times that wide blocks are compared with one of their nodes each.
TURNS = 3
#: Nodes of the widest block of which all pairs are compared at first.
NARROW = 5
#: Nodes of the widest block that is at last compared pair by pair, grams of a tile of a wider one, and those that are counted at once.
WIDE, TILE_GRAMS, COLUMNS = 64, 500_000, 4096
#: Pairs that meet one copy of the segment that they share.
STAR = 512
#: A node of more than one in HOT of all rows has its rows joined apart.
HOT = 10_000
#: Rows of two or three numbers (pairs, ids, keys of texts) that may be sent to every task; more of them are joined by a shuffle.
MAX_SENT = 2_000_000
#: Sets that a task remembers, so that it gives the grams of equal ones once.
KEPT_NODES = 1_000_000


def _emit(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == U else x.astype(np.int64), pa.int64())


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(x) for x in arrays])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _long(np.concatenate(arrays) if arrays else np.zeros(0, U)))


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    return shingle_sets(*texts_of(batch.column("text")), k)


def node_of(grams: np.ndarray) -> int:
    """The id of a set: a hash of all its grams (sum and xor of mixed values, mixed with the count)."""
    m = mix(grams)
    x = mix(np.array([m.sum(), np.bitwise_xor.reduce(m) + U(len(m))], U))
    return int(mix(x[:1] * U(3) + x[1:])[0].view(np.int64))


def frequent_grams(documents: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the frequent grams, sorted, and their places in the order (1, 2, ...).

    A task counts the grams of some thousand documents at a time and drops those that occur once
    there. What is left is summed over the corpus. A frequency can so be too low, which moves a gram in
    the order but changes no result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.empty(COUNT_AT_ONCE, U), 0

        def emit() -> pa.RecordBatch:
            """The grams held that occur more than once: runs of equal ones, sorted in place."""
            grams = held[:n]
            grams.sort()
            same = np.zeros(n + 1, bool)
            same[1:n] = grams[1:] == grams[:-1]
            first, last = np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(same[:-1] & ~same[1:])
            return _emit({"h": _long(grams[first]), "c": _long(last - first + 1)})

        for batch in batches:
            for s in _sets(batch, k):
                while len(s):
                    part = s[: COUNT_AT_ONCE - n]
                    held[n : n + len(part)] = part
                    n, s = n + len(part), s[len(part) :]
                    if n == COUNT_AT_ONCE:
                        yield emit()
                        n = 0
        yield emit()
        del held
        give_back()

    # a task that sees more text sees more repeats; up to eight small partitions are read by one, if all cores stay busy
    parts = documents.rdd.getNumPartitions()
    texts = documents.select("text").coalesce(max(1, min(parts, max(2 * documents.sparkSession.sparkContext.defaultParallelism, -(-parts // 8)))))
    counts = texts.mapInArrow(count, "h long, c long")
    counts = materialise(counts.groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= MIN_FREQUENT))
    # a row for each doubling of the count
    doubling = F.floor(F.log2(F.col("c") / MIN_FREQUENT)).cast("int")
    sizes = {r["d"]: r["n"] for r in counts.groupBy(doubling.alias("d")).agg(F.count("*").alias("n")).collect()}
    least, total = max(sizes, default=0) + 1, 0
    while least > 0 and total + sizes.get(least - 1, 0) <= MAX_FREQUENT:
        least -= 1
        total += sizes.get(least, 0)
    found = counts.where(doubling >= least).toPandas()
    grams, c = found["h"].to_numpy(np.int64).view(U), found["c"].to_numpy(np.int64)
    by = np.argsort(grams)
    grams, c = grams[by], c[by]
    place = np.empty(len(c), np.int32)
    place[np.lexsort((grams, c))] = np.arange(1, len(c) + 1)
    return grams, place


def places(grams: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 for grams that aren't frequent, else their place among those."""
    known, place = frequent
    if not len(known):
        return np.zeros(len(grams), np.int32)
    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
    return np.where(known[at] == grams, place[at], 0)


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _prefixes(documents: DataFrame, k: int, num: int, den: int, frequent) -> DataFrame:
    """doc_id, key (a hash of the text), n and node of each document, and the first grams of its set in the global order,
    which are null where the task has given those of an equal set before."""
    sent = documents.sparkSession.sparkContext.broadcast(frequent)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in batches:
            n, node, heads, there = [], [], [], []
            for grams in _sets(batch, k):
                n.append(len(grams))
                node.append(node_of(grams) if len(grams) else None)
                if not len(grams) or node[-1] in given:
                    there.append(False)
                    continue
                if len(given) >= KEPT_NODES:
                    given.clear()
                given.add(node[-1])
                there.append(True)
                p = prefix_length(len(grams), num, den)
                place = places(grams, sent.value)
                head = grams[place == 0][:p]
                if len(head) < p:
                    late = place > 0
                    head = np.concatenate([head, grams[late][np.argsort(place[late])][: p - len(head)]])
                heads.append(head)
            at = np.where(there, np.cumsum(there) - 1, -1)
            prefix = _lists(heads).take(pa.array(at, pa.int32(), mask=at < 0))
            yield _emit({"doc_id": batch.column("doc_id"), "key": batch.column("key"), "n": pa.array(n, pa.int64()), "node": pa.array(node, pa.int64()), "prefix": prefix})
        given.clear()
        give_back()

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(cut, f"doc_id {kind}, key long, n long, node long, prefix array<long>")


def _few(df: DataFrame, n: int) -> DataFrame:
    """``df`` of ``n`` rows, to be sent to every task if these are few enough."""
    return F.broadcast(df) if n <= MAX_SENT else df


def _segments(documents: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, frequent) -> DataFrame:
    """node, f, grams: the sets of ``nodes``, each cut into the fragments of the global order. One text of each is read again."""
    spark = documents.sparkSession
    one = materialise(docs.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "key")).alias("one")).select(F.col("one.doc_id").alias("_id"), F.col("one.key").alias("_key")))
    sent = spark.sparkContext.broadcast(frequent)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, parts = [], []
            for grams in _sets(batch, k):
                part = np.where(places(grams, sent.value) > 0, FRAGMENTS - 1, (grams >> U(32)).astype(np.int64) * (FRAGMENTS - 1) >> 32)
                node.append(node_of(grams))
                parts += [grams[part == f] for f in range(FRAGMENTS)]
            f = np.tile(np.arange(FRAGMENTS), len(node))
            yield _emit({"node": _long(np.repeat(np.array(node, np.int64), FRAGMENTS)), "f": pa.array(f, pa.int32()), "grams": _lists(parts)})
        give_back()

    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("key"))
    texts = texts.join(_few(one, one.count()), F.expr("key = _key and doc_id <=> _id"), "left_semi").select("text")
    found = materialise(texts.mapInArrow(cut, "node long, f int, grams array<long>"))
    repeated = found.where("f = 0").groupBy("node").count().where("count > 1")
    return found if repeated.isEmpty() else materialise(found.dropDuplicates(["node", "f"]))  # rows alike in id and text


def _needed(num: int, den: int, a: str = "n_a", b: str = "n_b") -> str:
    """``num + den`` times the common grams that sets of these sizes need."""
    return f"{num} * ({a} + {b})"


def _links(pairs: DataFrame, segments: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b; n_a, n_b are their sizes) whose common grams reach the threshold. A pair's segments meet in
    each fragment by themselves, where those of b come to a copy of a's for ``STAR`` pairs at most; only the counts go on."""
    stars = materialise(pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("copies")))
    placed = pairs.join(stars, "a").withColumn("copy", F.pmod(F.xxhash64("b"), F.col("copies"))).drop("copies")
    n = pairs.count()
    members = segments.select(F.col("node").alias("b"), "f", F.col("grams").alias("of_b")).join(_few(placed, n), "b")
    centres = segments.select(F.col("node").alias("a"), "f", F.col("grams").alias("of_a")).join(_few(stars, n), "a")
    centres = centres.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    counted = members.join(centres.hint("merge"), ["a", "copy", "f"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("of_a", "of_b")).alias("common"))
    summed = counted.groupBy("a", "b", "n_a", "n_b").agg(F.sum("common").alias("common"))
    return summed.where(F.expr(f"{num + den} * common >= {_needed(num, den)}")).select("a", "b")


def _tiles_of(wide: DataFrame, num: int, den: int) -> DataFrame:
    """node, n, label, home, tile: each node's widest block, and its part of that block, of about TILE_GRAMS grams in nodes of like size. A block's
    commonest label has tiles of its own, which need not meet each other."""
    home = wide.groupBy("node", "n", "label").agg(F.max(F.struct("size", "h", "main", "of_main", "of_rest")).alias("m")).select("node", "n", "label", "m.*")
    is_main = F.col("label") == F.col("main")
    parts = F.greatest(F.ceil(F.when(is_main, F.col("of_main")).otherwise(F.col("of_rest")) / TILE_GRAMS), F.lit(1))
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num))) if num < den else F.col("n")
    return home.select("node", "n", "label", F.col("h").alias("home"), F.xxhash64("h", is_main, band, F.pmod(F.xxhash64("node"), parts)).alias("tile"))


def _meeting(rows: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs of tiles (s, t) with nodes of unlike labels and like sizes that share a block; ``rows``: h, label, tile, n."""
    there = rows.groupBy("h", "tile").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min("n").alias("least"), F.max("n").alias("most"))
    on = f"s.h = t.h and s.tile <= t.tile and least(s.x, t.x) <> greatest(s.y, t.y) and {den} * s.most >= {num} * t.least and {den} * t.most >= {num} * s.least"
    return there.alias("s").join(there.alias("t"), F.expr(on)).select(F.col("s.tile").alias("s"), F.col("t.tile").alias("t")).distinct()


def _tile_links(tiles: DataFrame, tile_of: DataFrame, segments: DataFrame, num: int, den: int) -> DataFrame:
    """The links (a, b) between nodes of unlike labels in two tiles. Fragment after fragment the common grams of all nodes of one
    tile and all of the other are counted by matrix products, and the counts are summed. Only links leave the task."""
    parts = segments.join(tile_of.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("f", "grams"))).alias("parts"))
    held = materialise(tile_of.select("tile", "node", "label", "n").join(parts, "node").withColumn("parts", F.transform("parts", lambda x: x["grams"])))
    names = ["s", "t", "node", "label", "n", "parts"]
    side = lambda key: tiles.join(held, F.col(key) == F.col("tile")).select(*[F.col(c).alias(f"{key}_{c}") for c in names])

    def count(x: pa.Table, y: pa.Table) -> pa.Table:
        x, y = x.rename_columns(names), y.rename_columns(names)
        if not x.num_rows or not y.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        common = np.zeros((x.num_rows, y.num_rows), np.float32)
        for f in range(FRAGMENTS):
            grams = [[r.values[f].values.to_numpy() for r in z.column("parts")] for z in (x, y)]
            flat = [np.concatenate(g) for g in grams]
            shared, hits = np.intersect1d(*flat), []
            for own, values in zip(grams, flat, strict=True):
                at = np.minimum(np.searchsorted(shared, values), max(len(shared) - 1, 0))
                there = shared[at] == values if len(shared) else np.zeros(len(values), bool)
                hits.append((np.repeat(np.arange(len(own)), [len(g) for g in own])[there], at[there]))
            for i in range(0, len(shared), COLUMNS):
                ones = []
                for n, (owner, at) in zip(common.shape, hits, strict=True):
                    m = np.zeros((n, min(COLUMNS, len(shared) - i)), np.float32)
                    here = (at >= i) & (at < i + COLUMNS)
                    m[owner[here], at[here] - i] = 1
                    ones.append(m)
                common += ones[0] @ ones[1].T
        node, label, n = ([z.column(c).to_numpy() for z in (x, y)] for c in ("node", "label", "n"))
        i, j = np.nonzero(((num + den) * common.astype(np.float64) >= num * (n[0][:, None] + n[1][None])) & (label[0][:, None] != label[1][None]))
        return pa.table({"a": _long(node[0][i]), "b": _long(node[1][j])})

    return side("s").groupBy("s_s", "s_t").cogroup(side("t").groupBy("t_s", "t_t")).applyInArrow(count, "a long, b long")


def ngram_components(documents: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``documents`` (doc_id, text): documents are
    linked when den * common grams >= num * grams of either."""
    return _components_of_rows(documents, k, num, den).drop("node")


def _nodes(whole: DataFrame) -> DataFrame:
    """node, n, prefix: each set once. Only the rows of sets that several tasks have met are shuffled."""
    given = whole.where("prefix is not null").select("node", "n", "prefix")
    often = materialise(given.groupBy("node").count().where("count > 1").select("node"))
    known = _few(often, often.count())
    again = given.join(known, "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    return given.join(known, "node", "left_anti").unionByName(again)


def _blocks(nodes: DataFrame) -> DataFrame:
    """h, node, n, at, size: the prefix grams that more than one node has, their places in the prefix, and the number of nodes."""
    grams = nodes.select("node", "n", F.posexplode("prefix").alias("at", "h"))
    shared = materialise(grams.groupBy("h").agg(F.count("*").alias("size")).where("size > 1"))
    # as many as documents, so these are never sent to every task
    return materialise(grams.join(shared.hint("merge"), "h"))


def _components_of_rows(documents: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The same with the node of each row's set, which is null where it has no words."""
    spark = documents.sparkSession
    ship(spark)
    frequent = frequent_grams(documents, k)
    whole = materialise(_prefixes(documents, k, num, den, frequent))
    docs = materialise(whole.select("doc_id", "key", "n", "node"))
    members = _blocks(_nodes(whole))
    release(spark, whole)

    def may(a: str, b: str) -> Column:
        """At the first gram that two sets share, what is left of either must allow the overlap that they need."""
        needed = _needed(num, den, f"{a}.n", f"{b}.n")
        return F.expr(f"{den} * least({a}.n, {b}.n) >= {num} * greatest({a}.n, {b}.n) and {num + den} * least({a}.n - {a}.at, {b}.n - {b}.at) >= {needed}")

    def ends(x: str, y: str, *more: Column) -> list[Column]:
        return [F.col(f"{x}.node").alias("a"), F.col(f"{y}.node").alias("b"), F.col(f"{x}.n").alias("n_a"), F.col(f"{y}.n").alias("n_b"), *more]

    def stars(rows: DataFrame, turn: int) -> DataFrame:
        """Each row (h, node, label, n, at, w) with one node of its block: that with most grams in wide blocks, later one chosen by the turn and the nodes' hashes."""
        rank = F.struct((-F.col("w") if turn == 0 else F.lit(0)).alias("x"), F.xxhash64("node", F.lit(turn)).alias("z"), "node", "label", "n", "at")
        first = rows.groupBy("h").agg(F.min(rank).alias("y")).select("h", "y.node", "y.label", "y.n", "y.at")
        met = rows.alias("x").join(first.alias("y"), F.expr("x.h = y.h and x.label <> y.label") & may("x", "y"))
        return met.select(ends("y", "x"))

    def enough(pairs: DataFrame, unknown: str) -> DataFrame:
        """The pairs (with common, of their prefix grams) that can be links if they have ``unknown`` more of these in common: beyond
        the prefix that ends first in the global order, they have no more than what its set has left there."""
        beyond = ", ".join(f"{n} - ({n} - ceil({num} * {n} / {den}) + 1)" for n in ("n_a", "n_b"))
        return pairs.where(f"{num + den} * (common + {unknown} + greatest({beyond})) >= {_needed(num, den)}").select("a", "b", "n_a", "n_b")

    def all_pairs(rows: DataFrame, unlike: str) -> DataFrame:
        """The pairs of like size of each block, the number of blocks that they share, and whether one of these shows that they may be links."""
        on = f"x.h = y.h and x.node < y.node and {den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n) and {unlike}"
        met = rows.alias("x").join(rows.alias("y"), F.expr(on))
        return met.groupBy(*ends("x", "y")).agg(F.count("*").alias("common"), F.max(may("x", "y")).alias("may"))

    def unconnected(rows: DataFrame, links: DataFrame) -> DataFrame:
        """The rows of blocks in which not all nodes are connected yet, with their labels."""
        labelled = materialise(rows.drop("label", "size").join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node")))
        mixed = labelled.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("size")).where("x <> y").select("h", "size")
        return materialise(labelled.join(mixed, "h"))

    held = None  # segments of the nodes that have been asked for

    def segments_of(nodes: DataFrame) -> DataFrame:
        nonlocal held
        new = materialise(nodes if held is None else nodes.join(held.where("f = 0").select("node"), "node", "left_anti"))
        if held is None or not new.isEmpty():
            more = _segments(documents, docs, new, k, frequent)
            held = more if held is None else held.unionByName(more)
        return held

    def compare(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        return materialise(_links(pairs, segments_of(nodes), num, den))

    # all pairs of narrow blocks; what grams a pair has in common in wide ones is not known here
    wide = members.where(F.col("size") > NARROW)
    in_wide = materialise(wide.groupBy("node").agg(F.count("*").alias("w")))
    of = lambda x: in_wide.select(F.col("node").alias(x), F.col("w").alias(f"w_{x}"))
    met = all_pairs(members.where(F.col("size") <= NARROW), "true").join(of("a"), "a", "left").join(of("b"), "b", "left")
    pairs = enough(met, "least(coalesce(w_a, 0), coalesce(w_b, 0))")
    # and one node of each wide block with the others
    rest = materialise(wide.join(in_wide, "node").withColumn("label", F.col("node")))
    links = compare(materialise(pairs.unionByName(stars(rest, 0)).groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.first(F.struct("a", "b", "n_a", "n_b")).alias("p")).select("p.*")))
    rest = unconnected(rest, links)
    for turn in range(1, TURNS):
        still = rest.where(F.col("size") > WIDE)
        if still.isEmpty():
            break
        found = compare(materialise(stars(still, turn).distinct()))
        if found.isEmpty():
            break
        links = links.unionByName(found)
        rest = unconnected(rest, links)
    # what is left: small blocks pair by pair, the others tile by tile
    by_label = rest.groupBy("h", "label").agg(F.count("*").alias("of_label"), F.sum("n").alias("grams"))
    sizes = by_label.groupBy("h").agg(F.sum("of_label").alias("size"), F.max_by("label", "grams").alias("main"), F.max("grams").alias("of_main"), F.sum("grams").alias("grams"))
    sizes = materialise(sizes.withColumn("of_rest", F.col("grams") - F.col("of_main")).drop("grams"))
    rest = rest.drop("size")
    tile_of = materialise(_tiles_of(rest.join(sizes.where(F.col("size") > WIDE), "h"), num, den))
    small = rest.join(sizes.where(F.col("size") <= WIDE).select("h"), "h", "left_semi").join(tile_of.select("node", "home"), "node", "left")
    # the first common gram of a pair that shares a narrow block may not be among these, but such pairs are decided; those of two nodes in tiles meet there
    pairs = enough(all_pairs(small, "(x.home is null or y.home is null) and x.label <> y.label").where("may"), "0")
    more = compare(materialise(pairs))
    tiles = materialise(_meeting(rest.select("h", "node").join(tile_of, "node"), num, den))
    if not tiles.isEmpty():
        more = more.unionByName(materialise(_tile_links(tiles, tile_of, segments_of(tile_of.select("node").distinct()), num, den)))
    labels = components(links.unionByName(more))
    least = materialise(docs.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    of_label = labels.join(least, "node").groupBy("label").agg(F.min("least").alias("component"))
    of_node = materialise(least.join(labels.join(of_label, "label").select("node", "component"), "node", "left").select("node", "rows", F.coalesce("component", "least").alias("component")))
    release(spark, least, held, members)
    # nodes of many rows are few, so these rows need no shuffle
    many = F.broadcast(of_node.where(F.col("rows") > max(1000, docs.count() // HOT)))
    rows = docs.join(many.select("node"), "node", "left_anti").join(of_node, "node", "left").unionByName(docs.join(many, "node"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), "node")


def _with_node(documents: DataFrame, k: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = [node_of(grams) if len(grams) else None for grams in _sets(batch, k)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], names=[*batch.schema.names, "_node"])

    return documents.mapInArrow(cut, StructType([*documents.schema.fields, StructField("_node", LongType())]))


def keep_one(documents: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``documents`` without near copies: of each component the row with the least id stays. Rows that
    repeat an id and text are one document, and rows that repeat an id with other texts stay or go each by its own
    text; rows with a null id, and texts without words, stay."""
    found = materialise(_components_of_rows(documents, k, num, den))
    gone = materialise(found.where("doc_id is not null and component_id is not null and doc_id <> component_id").select("doc_id", F.col("node").alias("_node")).distinct())
    often = materialise(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    release(documents.sparkSession, found)
    known, repeated = (_few(x.select("doc_id"), x.count()) for x in (gone, often))
    if often.isEmpty():
        return documents.join(known, "doc_id", "left_anti").select(*documents.columns)
    once = documents.join(repeated, "doc_id", "left_anti").join(known, "doc_id", "left_anti").select(*documents.columns)
    again = documents.join(repeated, "doc_id", "left_semi").select(*documents.columns).dropDuplicates(["doc_id", "text"])
    return once.unionByName(_with_node(again, k).join(gone, ["doc_id", "_node"], "left_anti").select(*documents.columns))
