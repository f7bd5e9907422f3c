"""Document fingerprints by content-defined chunking.

A gear hash rolls over the UTF-8 bytes of a text. A chunk ends where the hash is small: very small up to the
normal length, less so beyond it (normalised chunking), with a least and a most length. Chunk
ends hang on the bytes near them only, so an edit changes the chunks around it and no others.
The fingerprint is the set of the chunks' digests, each with the chunk's length, and the likeness of
one text to another is the share of its chunks' bytes that the other has too (containment).

Defined results: null text is empty; an empty text has an empty fingerprint, which is wholly contained in
an empty one and in no other. Documents are in descending order of doc_id, nulls last and rows that repeat an id
by a hash of their text; the next of the last is the first, also of an only one. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .kernels import U, _power_tables, mix

#: Least, normal and most bytes of a chunk; a length must fit into the low byte of a fingerprint's entries.
LEAST, NORMAL, MOST = 8, 32, 128
#: One of so many places ends a chunk before and from the normal length on.
STRICT, LOOSE = 64, 8
#: Rows of each range of ids, at most about.
RANGE = 20_000
_GEAR = np.random.default_rng(77).integers(0, 2**32, 256, dtype=np.uint32)
_PLAIN = np.random.default_rng(78).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


def chunk_ends(data: np.ndarray) -> list[int]:
    n = len(data)
    h = _GEAR[data]
    for s in (1, 2, 4, 8, 16):  # after these, each value holds the last 32 bytes
        if n > s:
            shifted = h[:-s] << np.uint32(s)
            h[s:] += shifted
    at = np.flatnonzero(h < np.uint32(2**32 // LOOSE))
    strict = h[at] < np.uint32(2**32 // STRICT)
    ends, p = [], 0
    for q, s in zip((at + 1).tolist(), strict.tolist(), strict=True):
        d = q - p
        while d > MOST:
            p += MOST
            ends.append(p)
            d = q - p
        if d >= NORMAL or (s and d >= LEAST):
            p = q
            ends.append(p)
    while n - p > MOST:
        p += MOST
        ends.append(p)
    if p < n:
        ends.append(n)
    return ends


def fingerprint(text: str) -> np.ndarray:
    """The sorted set of chunks: 56 bits of digest and 8 of length each."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, U)
    ends = np.array(chunk_ends(data))
    starts = np.concatenate([[0], ends[:-1]])
    up, down = _power_tables(len(data))
    sums = np.empty(len(data) + 1, U)
    sums[0] = 0
    np.cumsum(_PLAIN[data] * up[: len(data)], out=sums[1:])
    digest = mix((sums[ends] - sums[starts]) * down[starts])
    return np.unique((digest & ~U(0xFF)) | (ends - starts).astype(U))


def written(chunks: np.ndarray) -> str:
    return base64.b64encode(chunks.astype("<u8").tobytes()).decode()


def read(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of a's bytes in chunks that b has too."""
    if not len(a):
        return float(not len(b))
    weight = lambda x: int((x & U(0xFF)).sum())
    return weight(np.intersect1d(a, b, assume_unique=True)) / weight(a)


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


@dataclass(frozen=True)
class Ranges:
    """Ranges of (id, hash of the text), ascending. ``cuts``: the largest id of each range but the last; an id that many rows repeat
    is several cuts, and its rows are dealt to that many ranges by their hashes. Rows with a null id come first, in ``nulls`` ranges."""

    cuts: np.ndarray
    nulls: int

    @property
    def n(self) -> int:
        return self.nulls + len(self.cuts) + 1

    def of(self, ids: pa.Array, hashes: pa.Array) -> np.ndarray:
        null, x = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        # the hash's place among all, from 0 to below 1
        place = np.clip(hashes.to_numpy(zero_copy_only=False) / 2.0**64 + 0.5, 0.0, 1.0 - 2.0**-53)
        first, times = np.searchsorted(self.cuts, x), np.searchsorted(self.cuts, x, "right") - np.searchsorted(self.cuts, x)
        at = self.nulls + first + (place * np.maximum(times, 1)).astype(np.int64)
        return np.where(null, (place * max(self.nulls, 1)).astype(np.int64), at).astype(np.int32)


def ranges_of(ids: DataFrame, partitions: int) -> Ranges:
    """Ranges of about ``RANGE`` rows of ``ids`` (doc_id), and as many as ``partitions`` at least. Of them only cuts come to the driver."""
    about = ids.agg(F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    n, known = about["n"], about["known"]
    wanted = max(1, -(-n // RANGE), partitions)
    ranges = max(1, -(-wanted * known // n)) if n else 1
    cuts = ids.where("doc_id is not null").approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    return Ranges(np.array(sorted(int(c) for c in cuts), np.int64), -(-wanted * (n - known) // n) if n else 0)


def with_next(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, text, _guest) in ranges of ids, a partition each, sorted; _guest marks the row that
    follows a range's last one and belongs to another range. The text is shuffled once.

    Only the ranges' cuts and largest rows come to the driver, and go from there to every task: some 30 bytes for each range of
    ``RANGE`` rows or more.
    """
    spark = documents.sparkSession
    keyed = documents.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"))
    sent = spark.sparkContext.broadcast(ranges_of(documents.select("doc_id"), documents.rdd.getNumPartitions()))

    @F.arrow_udf("int")
    def range_of(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        return pa.array(sent.value.of(ids, hashes))

    largest = keyed.select("id", "h", range_of("id", "h").alias("r")).groupBy("r").agg(F.max(F.struct("id", "h")).alias("m")).select("r", "m.id", "m.h")
    found = {r["r"]: (r["id"], r["h"]) for r in largest.toArrow().to_pylist()}
    there, n = sorted(found), sent.value.n
    # the first row of a range is what follows the last one of the range above; the very first follows the very last
    host = np.full(n, -1, np.int32)
    host[there] = there[1:] + there[:1]
    top_id, top_hash = (np.array([found[r][i] or 0 if r in found else 0 for r in range(n)], np.int64) for i in (0, 1))
    told = spark.sparkContext.broadcast((host, top_id, top_hash))

    @F.arrow_udf("array<struct<at:int,guest:int>>")
    def places(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        host, top_id, top_hash = told.value
        r = sent.value.of(ids, hashes)
        visits = (ids.fill_null(0).to_numpy(zero_copy_only=False) == top_id[r]) & (hashes.to_numpy(zero_copy_only=False) == top_hash[r])
        visits &= ids.is_null().to_numpy(zero_copy_only=False) == (r < sent.value.nulls)
        at = np.repeat(r, 1 + visits)
        ends = np.concatenate([[0], np.cumsum(1 + visits)])
        guest = np.zeros(len(at), np.int32)
        second = ends[1:][visits] - 1
        guest[second], at[second] = 1, host[r[visits]]
        items = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(guest, pa.int32())], names=["at", "guest"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)

    hashed = documents.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    rows = hashed.withColumn("_p", F.explode(places(F.col("doc_id").cast("long"), F.col("_hash"))))
    dealt = rows.select("doc_id", "text", "_hash", F.col("_p.at").alias("_at"), F.col("_p.guest").alias("_guest")).repartitionById(n, F.col("_at"))
    return dealt.sortWithinPartitions(F.col("_guest"), F.col("doc_id").desc_nulls_last(), F.col("_hash").desc()).select("doc_id", "text", "_guest")


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    ship(documents.sparkSession)
    rows = with_next(documents)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            done: list[tuple] = []
            for doc, text, guest in zip(*(batch.column(i) for i in range(3)), strict=True):
                if held is None and guest.as_py():
                    continue
                own = text.as_py() or ""
                chunks = fingerprint(own)
                if held is not None:
                    d, t, f = held
                    e = edited_text(t, own)
                    g = fingerprint(e)
                    done.append((d, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), written(f), written(g), likeness(f, g), likeness(f, chunks)))
                held = None if guest.as_py() else (doc.as_py(), own, chunks)
            columns = list(zip(*done, strict=True)) if done else [()] * 7
            kinds = [batch.column(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(judge, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
