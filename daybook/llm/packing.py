"""Packing by column generation for the cutting-stock problem.

A document's tokens are cut into pieces of a few lengths: whole sequences, one multiple of ``GRID`` and one rest below
it. The histogram of these lengths is all that the plan depends on. Its linear program, fewest sequences that cover the
demand of each length, is solved by column generation: a knapsack dynamic program prices patterns against the duals
until none improves, then patterns are rounded down and the few pieces left are packed best fit. Pieces are ranked
within their length, and a rank alone says which copy of which pattern a piece goes to, and where.

Documents are tokenised once, in the task that reads them; ranks come from counts for each bucket of documents and
length, so no task ranks a whole length. The driver sees the histogram only, which has no more classes than a sequence
has tokens.

Defined cases: null and empty texts are the end token alone; rows that repeat are packed each for itself; a null doc_id
is kept; an empty table gives no rows; extra columns are ignored; the last sequence of a pattern may have room left,
which is padding.
"""

from __future__ import annotations

import re
import struct
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daybook.llm.common import stage, table

CAPACITY = 4096
GRID = 64
END = 2
BUCKETS = 256
#: The gap to the linear program's bound at which pricing stops.
GAP = 1e-4
#: Bytes of words and their ids that a worker holds, and the longest word, in code points, that is held.
BYTES_HELD, LONGEST = 100 << 20, 32
#: Characters that NFC leaves as they are and that are lower-cased one by one, whatever stands beside them.
PLAIN = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x180), *range(0x400, 0x460), *range(0x2010, 0x2028), *range(0x2030, 0x205F)) if c != 0x130]


def _kind(category: str) -> str:
    return re.escape("".join(c for c in PLAIN if c == c.lower() and unicodedata.category(c)[0] == category))


SPACE = r"\x20\x09-\x0D"
SPACES, NOT_PLAIN = re.compile(f"[{SPACE}]+"), re.compile(f"[^{SPACE}{re.escape(''.join(PLAIN))}]")
#: The tokenizer's own pattern, for lower-cased plain characters.
WORD = re.compile(rf"[{_kind('L')}]+|[{_kind('N')}]|'(?:[stmd]|re|ve|ll)|[^{SPACE}{_kind('L')}{_kind('N')}]+")
#: The characters that stand for bytes in the tokenizer's vocabulary.
BYTES = {b: 256 + n for n, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}


class Words(dict):
    """Token ids of texts, word by word, each distinct word looked up once while it is held. Plain texts are normalised
    and split here, by the rules of ``word_bpe_49k.json``, and only their words go through the tokenizer's model; a word
    with any other character, or with what may be a special token, goes through the whole tokenizer. That splits at white
    space too, so a word's ids don't depend on its neighbours."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._bytes = 0

    def __missing__(self, word: str) -> bytes:
        if NOT_PLAIN.search(word) or "<|" in word:
            found = self._tokenizer.encode(word, add_special_tokens=False).ids
        else:
            found = [t.id for t in self._model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(BYTES))]
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(word) <= LONGEST:
            self._bytes += sys.getsizeof(word) + sys.getsizeof(ids) + 64  # about what its place in the table takes
            if self._bytes > BYTES_HELD:
                self.clear()
                self._bytes = 0
            self[word] = ids
        return ids

    @staticmethod
    def split(text: str) -> list[str]:
        """The words of a text: parts of one kind of characters where it is plain, else all between white space."""
        if NOT_PLAIN.search(text) or "<|" in text:
            whole = (w for w in SPACES.split(text) if w)
            return [p for w in whole for p in ([w] if NOT_PLAIN.search(w) or "<|" in w else WORD.findall(w.lower()))]
        return WORD.findall(text.lower())

    def encode(self, text: str) -> bytes:
        """The little-endian 32-bit ids of a text."""
        return b"".join(map(self.__getitem__, self.split(text)))


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    return Words(path)


def pieces(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's tokens, cut into the lengths that are planned."""

    def cuts(n: int) -> Iterator[tuple[int, int]]:
        at = 0
        while n - at >= CAPACITY:
            yield at, CAPACITY
            at += CAPACITY
        for length in ((n - at) // GRID * GRID, (n - at) % GRID):
            if length:
                yield at, length
                at += length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = _words(tokenizer), np.array([END], "<u4").tobytes()
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                rows, out = [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    ids = words.encode(text or "") + end
                    n = len(ids) // 4
                    for at, length in cuts(n):
                        rows.append(i)
                        out.append((at, length, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + length)]), n))
                told = np.array(out, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(rows, pa.int64())), *[pa.array(told[:, c]) for c in range(4)]], names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"{x} long" for x in names[1:]))


def best_pattern(lengths: np.ndarray, worth: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The most valuable multiset of lengths that fits, by dynamic programming over the room used."""
    value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = int(np.searchsorted(lengths, room, "right"))
        if fits:
            got = value[room - lengths[:fits]] + worth[:fits]
            k = int(got.argmax())
            if got[k] > value[room - 1]:
                value[room], last[room] = got[k], k
                continue
        value[room] = value[room - 1]
    counts, room = np.zeros(len(lengths), np.int64), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            counts[last[room]] += 1
            room -= int(lengths[last[room]])
    return counts


def plan(lengths: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY, gap: float = GAP, rounds: int = 600) -> list[tuple[np.ndarray, int]]:
    """(pattern, copies): patterns that hold exactly the demand. lengths ascend; a pattern counts each of them."""
    m = len(lengths)
    if not m:
        return []
    columns = [np.eye(m, dtype=np.int64)[i] * (capacity // lengths[i]) for i in range(m)]
    basis = list(range(m))
    inverse = np.diag(1.0 / (capacity // lengths))
    x = inverse @ demand
    for _ in range(rounds):
        duals = inverse.sum(0)
        new = best_pattern(lengths, duals, capacity)
        price = float(duals @ new)
        if price <= 1 + 1e-9 or float(duals @ demand) / price >= (1 - gap) * x.sum():
            break
        way = inverse @ new
        up = way > 1e-9
        ratio = np.where(up, x / np.where(up, way, 1), np.inf)
        out = int(ratio.argmin())
        columns.append(new)
        basis[out] = len(columns) - 1
        pivot = inverse[out] / way[out]
        inverse = inverse - np.outer(way, pivot)
        inverse[out] = pivot
        x = np.maximum(0, inverse @ demand)
    left, found = demand.astype(np.int64).copy(), []
    for k in np.argsort(-x, kind="stable"):
        pattern = columns[basis[k]]
        used = pattern > 0
        copies = min(int(x[k] + 1e-7), int((left[used] // pattern[used]).min()))
        if copies:
            found.append((pattern, copies))
            left -= copies * pattern
    while left.any():  # less than one sequence for each pattern is left: the best bounded fill, again and again
        pattern, room = np.zeros(m, np.int64), capacity
        for i in range(m - 1, -1, -1):
            n = min(int(left[i]), room // int(lengths[i]))
            pattern[i] += n
            room -= n * int(lengths[i])
        used = pattern > 0
        copies = int((left[used] // pattern[used]).min())
        found.append((pattern, copies))
        left -= copies * pattern
    return found


def slots(lengths: np.ndarray, planned: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank + 1, pieces in a copy, first sequence, offset): where the ranks of a length go."""
    rank, sequence, rows = dict.fromkeys(lengths.tolist(), 0), 0, []
    for pattern, copies in planned:
        offset = 0
        for i in np.flatnonzero(pattern)[::-1]:
            length, n = int(lengths[i]), int(pattern[i])
            rows.append((length, rank[length], rank[length] + n * copies, n, sequence, offset))
            rank[length] += n * copies
            offset += n * length
        sequence += copies
    return rows


def pack(cut: DataFrame) -> DataFrame:
    """cut (staged pieces) with sequence_id and offset."""
    spark = cut.sparkSession
    keyed = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(BUCKETS)).cast("int"))
    counts = stage(keyed.groupBy("length", "_bucket").count().coalesce(1), "packing-counts")  # at most BUCKETS for each planned length
    demand: dict[int, int] = {}
    for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():
        demand[r["length"]] = r["n"]
    lengths = np.array(sorted(demand), np.int64)
    rows = slots(lengths, plan(lengths, np.array([demand[x] for x in lengths.tolist()], np.int64)))
    places = spark.createDataFrame(rows, "length long, _from long, _to long, _each long, _sequence long, _offset long")
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = keyed.withColumn("_rank", F.row_number().over(inside) - 1).join(F.broadcast(starts), ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_start"))
    # The ranges of a length are searched as an array that is sorted by rank: one row for each length.
    by_length = places.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("_from", "_to", "_each", "_sequence", "_offset"))).alias("_ranges"))
    at = F.element_at(F.filter("_ranges", lambda r: (r["_from"] <= F.col("_rank")) & (F.col("_rank") < r["_to"])), 1)
    put = ranked.join(F.broadcast(by_length), "length").withColumn("_at", at)
    k = F.col("_rank") - F.col("_at._from")
    return put.select(
        *cut.columns,
        (F.col("_at._sequence") + F.floor(k / F.col("_at._each"))).cast("long").alias("sequence_id"),
        (F.col("_at._offset") + (k % F.col("_at._each")) * F.col("length")).cast("long").alias("offset"),
    )


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def packed(docs: DataFrame, tokenizer: str) -> DataFrame:
    return pack(stage(pieces(docs, tokenizer), "packing-pieces"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), tokenizer_path())


def pack_all(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: where each piece of each document is packed."""
    return packed(docs, tokenizer_path())
