"""Packing documents into sequences of tokens by the sum-of-squares rule.

A document's tokens and one end id are cut into pieces of at most ``capacity``. A piece goes where
the sum, over residual gaps, of the squared number of open sequences with that gap becomes smallest:
gaps that small pieces can still fill stay spread out, so few sequences end half full.

The rule keeps one table of counts, so a packer must see its pieces one by one. Pieces are dealt out by a hash
to packers of about ``GROUP`` pieces, each of which sees a fair sample of all lengths, takes them from long to short and
leaves a handful of sequences open. Only ids and lengths are shuffled unless ``with_ids``.

Defined results: null text is empty and has the end id alone. Pieces of ``capacity`` are sequences of their own. Repeated rows are packed
each. Null ids are kept. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialise, ship

CAPACITY = 2048
#: Pieces for each packer, and when token ids are carried along.
GROUP, GROUP_WITH_IDS = 50_000, 8_000
#: Words whose ids a task keeps at hand, and as many of those met before.
KEPT_WORDS = 150_000


#: Punctuation that the tokenizer splits from a letter or digit before it, and that never joins with those.
TAIL = ".,;:!?$%&#*|"
#: Of texts in which a token may reach over white space or in which Python and the tokenizer disagree on what white space is.
ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f", "\x85")


def byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the
    others for the letters from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


class WordIds(dict):
    """The token ids of words as little-endian bytes; a word not met yet is encoded.

    For a tokenizer that lower-cases, drops white space and encodes runs of letters and of other signs each by
    itself. Words of Latin letters go straight to its vocabulary, others through all of it; signs that follow another sign
    stay with it, since the tokenizer reads them as one run.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters, self.model = byte_letters(), self.tokenizer.model
        self.before: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.before = dict(self)
            self.clear()
        raw = self[word] = self.before.get(word) or self.ids(word)
        return raw

    def ids(self, word: str) -> bytes:
        core = word.rstrip(TAIL)
        if len(core) < len(word) and core and core[-1].isalnum() and core[-1] < "\u0250":
            return self[core] + self[word[len(core) :]]
        if word.isalpha() and max(word) < "\u0130" and unicodedata.is_normalized("NFC", word):
            spelt = word.lower().encode().decode("latin-1").translate(self.letters)
            return np.array([t.id for t in self.model.tokenize(spelt)], "<u4").tobytes()
        return self.whole(word)

    def encode(self, text: str) -> bytes:
        if any(x in text for x in ODD):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.split()))


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) for each piece of each document."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer)
        for batch in batches:
            doc, out = batch.column("doc_id"), {"row": [], "piece": [], "start": [], "length": [], "crc": [], "ids": []}
            for row, text in enumerate(batch.column("text").to_pylist()):
                raw = words.encode(text or "") + b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    for k, v in zip(out, (row, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None), strict=True):
                        out[k].append(v)
            columns = {"doc_id": doc.take(pa.array(out["row"], pa.int64())), "piece": pa.array(out["piece"], pa.int32()), "start": pa.array(out["start"], pa.int64()), "length": pa.array(out["length"], pa.int64()), "ids_crc32": pa.array(out["crc"], pa.int64())}
            if with_ids:
                columns["ids"] = pa.array([array("I", x).tolist() for x in out["ids"]], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        del words
        give_back()

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return documents.select("doc_id", "text").mapInArrow(cut, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each length, placed in the order given.

    With N[g] sequences of gap g, a piece of length s in a gap g > s changes the sum of squares by
    2 (N[g - s] - N[g] + 1), in a gap g = s by 1 - 2 N[s]. The least change is taken, and the smallest
    gap among equal ones. A sequence is opened only when the piece fits in none that is open: with all lengths known that takes
    fewer than opening one whenever its change, 2 N[capacity - s] + 1, is the least.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_in: list[list[int]] = [[] for _ in range(capacity + 1)]
    used: list[int] = []
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    far = np.int64(1) << 60
    for i, s in enumerate(lengths.tolist()):
        n = count[s:capacity]
        change = 2 * (count[: capacity - s] - n + 1)
        if len(n):
            change[0] = 1 - 2 * n[0]
            change[n == 0] = far
            g = int(change.argmin())
        if len(n) and n[g]:
            gap = g + s
            b = open_in[gap].pop()
            count[gap] -= 1
        else:
            gap, b = capacity, len(used)
            used.append(0)
        sequence[i], offset[i] = b, used[b]
        used[b] += s
        if gap > s:
            open_in[gap - s].append(b)
            count[gap - s] += 1
    return sequence, offset


def pack(cut: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``cut`` (rows with doc_id, piece, length) with sequence_id and offset. ``cut`` should be a written table: it is read twice."""
    n = cut.count()
    packers = max(1, -(-n // group))
    # by its place in the table too, so that rows which repeat are dealt out
    dealt = cut.withColumn("_packer", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(packers)).cast("int"))
    whole = dealt.where(F.col("length") == capacity)
    rest = dealt.where(F.col("length") < capacity)

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        sequence, offset = sum_of_squares(rows["length"].to_numpy(), capacity)
        return rows.assign(sequence_id=(rows["_packer"].to_numpy(np.int64) << 32) + sequence, offset=offset).drop(columns="_packer")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    packed = rest.groupBy("_packer").applyInPandas(place, f"{fields}, sequence_id long, offset long")
    # negative numbers for those that need no packing
    alone = whole.drop("_packer").withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return packed.unionByName(alone)


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset: one row for each piece.

    ``tokenizer`` is the path of a tokenizer file that all executors can read.
    """
    ship(documents.sparkSession)
    cut = materialise(pieces(documents, tokenizer, capacity, with_ids))
    return pack(cut, capacity, GROUP_WITH_IDS if with_ids else GROUP)
