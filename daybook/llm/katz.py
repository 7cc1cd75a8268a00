"""Language-model scoring by Katz backoff, of any order (``ORDER`` words a gram).

A gram seen n times in the training documents has the probability d(n) n / n(context), where d is Good-Turing's discount
for its order; what the discounts free is given to the words not seen after the context, in proportion to their
probability one order lower, and the backoff weight of each context makes its probabilities add up to one exactly. A
context not seen in training says nothing: then the lower order holds. So each token's probability is found from the
words up, order by order. Unigrams are discounted alike, and what they free is the probability of an unknown word. A
text begins after end tokens.

The counts are tables partitioned by the hash of the context. Documents are worked on in blocks of rows; for each order a
block asks each partition once for all its distinct grams, by a packed message, and gets their counts back in the order
asked, in files by block in the shared folder. The same message brings its training counts. So the model is never in one
place: one exchange for each order, as large as the blocks' distinct grams. Words are named by numbers that the first
exchange deals out, frequent ones small. A context that occurs once in all documents has its one successor in the block
that knows it, so nothing is asked about it at a higher order. A context with more than ``CONTEXT`` tokens is split over
several partitions, and a block asks all of them for their share of its sums.

Texts come from a table's files (a staged one, where docs is not a plain scan). Spark cuts these by the cores that it has
at the moment; so the model keeps the number that it was trained with, and every pass over its blocks asks for cuts by that
number, whatever executors have come or gone: a block is the same rows each time it is read. Defined cases: null and empty texts are the end token alone; a null doc_id is training; rows that
repeat count as often as they occur; without training documents every score is 0; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.common import shared_dir, shuffles_freed, stage, table
from daybook.llm.tokens import U, mix, text_chunks, word_hashes

ORDER = 3
END = U(1)
#: The numbers of the end token and of no word; other words have larger ones.
END_ID, NO_WORD = 1, 0
#: Bytes of text in a block, text for each partition of unigrams and of longer grams, tokens of a context in one partition.
BLOCK, UNIGRAMS, GRAMS, CONTEXT = 4 << 20, 32 << 20, 16 << 20, 2_000_000
#: Counts up to this are discounted.
DISCOUNTED = 5


@lru_cache(maxsize=1)
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """A worker's own, made once: messages are many and small."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pressed(b: bytes) -> bytes:
    return _zstd()[0].compress(b)


def opened(b: bytes) -> bytes:
    return _zstd()[1].decompress(b)


def packed(x: np.ndarray) -> bytes:
    """64-bit values byte plane by byte plane, as many as the largest has, compressed: sorted or small ones take a
    fraction of their size."""
    x = x.astype("<u8")
    planes = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([planes]) + pressed(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes())


def unpacked(b: bytes) -> np.ndarray:
    raw = np.frombuffer(opened(b[1:]), np.uint8).reshape(b[0], -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, : b[0]] = raw.T
    return out.reshape(-1).view("<u8")


def steps(x: np.ndarray) -> bytes:
    """Ascending values, by their differences."""
    x = x.astype("<u8")
    return packed(np.diff(x, prepend=x[:1] * U(0)))


def summed(b: bytes) -> np.ndarray:
    return np.cumsum(unpacked(b), dtype="<u8")


def bits(x: np.ndarray) -> bytes:
    return pressed(np.packbits(x).tobytes())


def unbits(b: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(opened(b), np.uint8), count=n).astype(bool)


def is_training(doc_ids: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2 for i in doc_ids.to_pylist()], bool)


def discounts(seen: np.ndarray) -> np.ndarray:
    """d(0..DISCOUNTED + 1) from the numbers of n-grams seen once, twice, ... (k + 1 of them), Katz's formula; where the
    numbers allow no discount in (0, 1] for some count, one amount is taken off all counts instead."""
    k, d = DISCOUNTED, np.ones(DISCOUNTED + 2)
    d[0] = 0
    n = np.asarray(seen, float)
    if n[0] <= 0:
        return d
    r = np.arange(1, k + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        a = (k + 1) * n[k] / n[0]
        katz = ((r + 1) * n[1:] / n[:k] / r - a) / (1 - a)
    if np.isfinite(katz).all() and (katz > 0).all() and (katz <= 1).all() and katz[0] < 1:
        d[1 : k + 1] = katz
    else:
        d[1 : k + 1] = (r - min(0.9, n[0] / (n[0] + 2 * n[1]) if n[1] else 0.5)) / r
    return d


@dataclass(frozen=True)
class Unigrams:
    """tokens, distinct: of the training documents; once: how many tokens are seen 1, 2, ... times; large: whether some
    word's number needs more than 32 bits."""

    tokens: int
    distinct: int
    once: tuple[int, ...]
    large: bool = False

    def probability(self, c: np.ndarray) -> np.ndarray:
        """Of a word seen c times; of the unknown word where c is 0."""
        if not self.tokens:
            return np.ones(len(c))
        d = discounts(np.array(self.once))
        freed = float(sum((1 - d[r]) * r * self.once[r - 1] for r in range(1, DISCOUNTED + 1))) / self.tokens
        scale = 1.0
        if freed <= 1e-12:  # nothing is rare: one more token, unknown
            freed, scale = 1 / (self.tokens + 1), self.tokens / (self.tokens + 1)
        return np.where(c > 0, scale * d[np.minimum(c, DISCOUNTED + 1)] * c / self.tokens, freed)


@dataclass
class Block:
    """Rows of documents as tokens: the distinct ones (sorted), and for each token its index in them."""

    key: str
    ids: pa.Array
    training: np.ndarray
    words: np.ndarray
    token: np.ndarray
    first: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(np.append(self.first, len(self.token)))

    @property
    def counted(self) -> np.ndarray:
        """For each token, whether its document is training."""
        return np.repeat(self.training, self.lengths)


def _block(key: str, ids: list[pa.Array], texts: list[pa.Array]) -> Block:
    id_, text = pa.concat_arrays(ids), pa.concat_arrays(texts)
    hashes, lengths = [], []
    for _, _, raw, offsets in text_chunks(text):
        h, cuts = word_hashes(raw, offsets)
        hashes.append(h)
        lengths.append(np.diff(cuts))
    h, n = np.concatenate(hashes), np.concatenate(lengths)
    tokens = np.full(len(h) + len(n), END)
    tokens[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
    words, at = np.unique(tokens, return_inverse=True)
    return Block(key, id_, is_training(id_), words, at.astype(np.int64), np.concatenate(([0], np.cumsum(n + 1)[:-1])).astype(np.int64))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    key, ids, texts, held = "", [], [], 0
    for batch in batches:
        text = pc.fill_null(batch.column("text"), "")
        sums = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        pos = 0
        while pos < batch.num_rows:
            if not ids:
                key = hashlib.md5(f"{batch.column('file')[pos]}:{batch.column('row')[pos]}".encode()).hexdigest()[:16]
            done = int(sums[pos - 1]) if pos else 0
            stop = min(batch.num_rows, int(np.searchsorted(sums, done + BLOCK - held)) + 1)
            ids.append(batch.column("doc_id").slice(pos, stop - pos))
            texts.append(text.slice(pos, stop - pos))
            held += int(sums[stop - 1]) - done
            pos = stop
            if held >= BLOCK:
                yield _block(key, ids, texts)
                ids, texts, held = [], [], 0
    if ids:
        yield _block(key, ids, texts)


class Replies:
    """Answers by block, written by Spark and read by the task that has the block."""

    def __init__(self, folder: str):
        self.folder = folder

    def of(self, block: Block) -> dict[int, dict]:
        store, root = pyarrow.fs.FileSystem.from_uri(self.folder)
        rows = pq.read_table(f"{root}/block={block.key}", filesystem=store, partitioning=None).to_pylist()
        return {r["part"]: r for r in rows}


def _answered(answers: DataFrame, label: str) -> tuple[Replies, list[int]]:
    """Writes answers by block; the sums of what the partitions counted."""
    spark = answers.sparkSession
    folder = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    with shuffles_freed(spark):
        answers.repartition("block").write.partitionBy("block").parquet(folder)
    told = spark.read.schema(answers.schema).parquet(folder).where("block = 'sums'").select(F.posexplode("sums").alias("i", "n"))
    return Replies(folder), [int(r["n"]) for r in told.groupBy("i").agg(F.sum("n").alias("n")).orderBy("i").collect()]


#: Spark's settings by which files are cut into partitions.
CUTS = ("spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionNum")


def cuts_of(spark: SparkSession) -> dict[str, str | None]:
    """The settings as they hold now, the number of cores among them."""
    held = {k: spark.conf.get(k, None) for k in CUTS}
    cores = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None) or spark.sparkContext.defaultParallelism
    return held | {CUTS[0]: held[CUTS[0]] or str(cores)}


@contextmanager
def same_cuts(spark: SparkSession, cuts: dict[str, str | None]) -> Iterator[None]:
    """What is executed inside cuts files so."""
    before = {k: spark.conf.get(k, None) for k in CUTS}
    put = lambda held: [spark.conf.unset(k) if v is None else spark.conf.set(k, v) for k, v in held.items()]
    put(cuts)
    try:
        yield
    finally:
        put(before)


def _scan(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def count_unigrams(docs: DataFrame, parts: int) -> tuple[Replies, Unigrams]:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            n = np.bincount(b.token[b.counted], minlength=len(b.words))
            part = (b.words % U(parts)).astype(np.int64)
            rows = [{"part": p, "block": b.key, "words": packed(b.words[part == p]), "n": packed(n[part == p])} for p in np.unique(part).tolist()]
            yield pa.RecordBatch.from_pylist(rows, schema=asked)

    def answer(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        words = [unpacked(r["words"]) for r in rows]
        known, at = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(at, np.concatenate([unpacked(r["n"]) for r in rows])).astype(np.int64)
        rank = np.empty(len(known), np.int64)
        rank[np.lexsort((known, -total))] = np.arange(len(known))
        name = np.where(known == END, END_ID, END_ID + 1 + rank * parts + rows[0]["part"])
        cuts = np.cumsum([0, *map(len, words)])
        out = [{"block": r["block"], "part": r["part"], "n": packed(total[at[a:z]]), "name": packed(name[at[a:z]])} for r, a, z in zip(rows, cuts[:-1], cuts[1:], strict=True)]
        sums = [int(total.sum()), int((total > 0).sum()), *[int((total == k).sum()) for k in range(1, DISCOUNTED + 2)], int(name.max() >= 1 << 32)]
        return pa.Table.from_pylist([*out, {"block": "sums", "part": rows[0]["part"], "sums": sums}], schema=answers)

    asked = pa.schema([("part", pa.int32()), ("block", pa.string()), ("words", pa.binary()), ("n", pa.binary())])
    answers = pa.schema([("block", pa.string()), ("part", pa.int32()), ("n", pa.binary()), ("name", pa.binary()), ("sums", pa.list_(pa.int64()))])
    sent = _scan(docs).mapInArrow(ask, "part int, block string, words binary, n binary")
    got = sent.groupBy("part").applyInArrow(answer, "block string, part int, n binary, name binary, sums array<long>")
    replies, sums = _answered(got, "katz-1")
    return replies, Unigrams(sums[0], sums[1], tuple(sums[2:-1]), sums[-1] > 0)


@dataclass
class Order:
    """What tasks are told of an order above the first: where its answers lie, and its discounts."""

    replies: Replies
    parts: int
    discounts: np.ndarray


@dataclass
class Model:
    words: Replies
    word_parts: int
    unigrams: Unigrams
    orders: list[Order]
    cuts: dict[str, str | None]

    def words_of(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """(training count, number) of each of the block's words."""
        part = (b.words % U(self.word_parts)).astype(np.int64)
        n, name = np.zeros(len(b.words), np.int64), np.zeros(len(b.words), np.int64)
        for p, r in self.words.of(b).items():
            n[part == p], name[part == p] = unpacked(r["n"]), unpacked(r["name"])
        return n, name


@dataclass
class Grams:
    """What a block asks of one order. Of each token ``at``: its gram, -1 where that occurs once; ``of``: its context, -1
    where that occurs once. Of each question context, word (-1 for what a context is asked besides) and part; the first
    ``len(token)`` are the distinct grams, and ``token`` is one token of each. Of each context its key, whether a document
    that isn't training has it, its training tokens whose gram occurs once, the tokens that its own lower context was
    seen with, and the partition that is told of these."""

    at: np.ndarray
    of: np.ndarray
    context: np.ndarray
    word: np.ndarray
    part: np.ndarray
    token: np.ndarray
    key: np.ndarray
    held_out: np.ndarray
    spare: np.ndarray
    below: np.ndarray
    home: np.ndarray

    def messages(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(partition, its questions, where the runs of one context begin in them)."""
        by_context = np.argsort(self.context, kind="stable")  # nearly in order, so this is quick
        part = self.part[by_context]
        order = by_context[np.argsort(part.astype(np.uint16) if part.max(initial=0) < 1 << 16 else part, kind="stable")]
        cuts = np.flatnonzero(np.diff(self.part[order], prepend=-1))
        for a, z in zip(cuts, [*cuts[1:], len(order)], strict=True):
            o = order[a:z]
            yield int(self.part[o[0]]), o, np.flatnonzero(np.diff(self.context[o], prepend=-1))


class Scorer:
    """A block's log10 probabilities, order by order. Of each token of the order reached: its gram (``at``), whether that
    occurs once in all documents (``lone``, then ``at`` means nothing), and the tokens that its context was seen with
    (``under``); ``n``: the grams' training counts. Words are in the order of their numbers."""

    def __init__(self, b: Block, model: Model):
        self.block, self.unigrams, self.order = b, model.unigrams, 1
        n, name = model.words_of(b)
        by_name = np.argsort(name)
        place = np.empty(len(name), np.int64)
        place[by_name] = np.arange(len(name))
        self.n, self.name, self.token = n[by_name], name[by_name], place[b.token]
        self.counted = b.counted
        self.texts = int(self.n[0])  # the end token's: the training texts, and so the tokens that begin one
        self.at, self.lone, self.under = self.token, np.zeros(len(b.token), bool), np.full(len(b.token), model.unigrams.tokens)
        self.key, self.start = self.name.astype(U), U(END_ID)
        self.log = np.log10(model.unigrams.probability(self.n))[self.token]

    def _longer(self, key: np.ndarray, name: np.ndarray) -> np.ndarray:
        """The key of a gram of the order that is next, as a context: two numbers side by side, or else a hash."""
        if self.order == 2 and not self.unigrams.large:
            return (key << U(32)) | name.astype(U)
        return mix(mix(key + U(self.order)) ^ mix(name.astype(U)))

    def grams(self, parts: int) -> Grams:
        size = len(self.n) + 1  # the last context is that of a text's first token
        of = np.concatenate(([0], np.where(self.lone[:-1], -1, self.at[:-1])))
        of[self.block.first] = size - 1
        live = of >= 0
        asked = np.flatnonzero(live & ~self.lone)
        code, token, inverse = np.unique(of[asked] * len(self.name) + self.token[asked], return_index=True, return_inverse=True)
        token = asked[token]
        at = np.full(len(of), -1, np.int64)
        at[asked] = inverse
        context, word = code // len(self.name), code % len(self.name)
        key = np.append(self.key, self.start)
        spare = np.bincount(of[live & self.lone & self.counted], minlength=size)
        held_out, known, below = np.zeros(size, bool), np.zeros(size, bool), np.zeros(size, np.int64)
        held_out[of[live & ~self.counted]] = True
        known[of[live]] = True
        below[of[live]] = self.under[live]
        split = 1 + np.append(self.n, self.texts) // CONTEXT
        # Each partition of a split context is asked for its share; a context without grams here is asked for its sums.
        besides = np.flatnonzero(known & ((split > 1) | (np.bincount(context, minlength=size) == 0)))
        salt = np.concatenate((self.name[word] % split[context], *[np.arange(split[v]) for v in besides[split[besides] > 1]], np.zeros(int((split[besides] == 1).sum()), np.int64)))
        context = np.concatenate((context, np.repeat(besides[split[besides] > 1], split[besides[split[besides] > 1]]), besides[split[besides] == 1]))
        dealt = lambda of, salt: (mix(key[of] + mix(salt.astype(U))) % U(parts)).astype(np.int64)
        word = np.concatenate((word, np.full(len(context) - len(word), -1)))
        return Grams(at, of, context, word, dealt(context, salt), token, key, held_out, spare, below, dealt(np.arange(size), np.zeros(size)))

    def rise(self, own: Grams, order: Order) -> None:
        """To the next order, by its answers."""
        d, size, k = order.discounts, len(own.key), len(own.token)
        n, lone = np.zeros(len(own.part), np.int64), np.zeros(len(own.part), bool)
        seen, total, mass = np.zeros((DISCOUNTED, size)), np.zeros(size, np.int64), np.zeros(size)
        replies = order.replies.of(self.block)
        for part, o, starts in own.messages():
            r, v = replies[part], own.context[o[starts]]
            n[o], lone[o] = unpacked(r["n"]), unbits(r["lone"], len(o))
            total[v] += unpacked(r["total"]).astype(np.int64)
            for j in range(DISCOUNTED):
                seen[j, v] += unpacked(r["seen"][j])
            mass[v[own.held_out[v]]] += np.frombuffer(opened(r["mass"]))
        n, lone, context, word = n[:k], lone[:k], own.context[:k], own.word[:k]
        freed = ((1 - d[1 : DISCOUNTED + 1]) * np.arange(1, DISCOUNTED + 1)) @ seen
        below = np.where(freed > 1e-9, total, total + 1)  # a context that frees nothing: as if it had one more, unknown, successor
        freed = np.where(freed > 1e-9, freed, 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.log10(np.where(total > 0, freed / below / (1 - mass), 1.0))
            seen_log = np.log10(d[np.minimum(n, DISCOUNTED + 1)] * n / below[context])
        log = np.where(n > 0, seen_log, weight[context] + self.log[own.token])
        live, inside = own.of >= 0, own.at >= 0
        at, of = np.where(inside, own.at, 0), np.where(live, own.of, 0)
        # A gram that occurs once is seen once by a training document, and not in training by another. So is a context.
        first = math.log10(d[1])
        once = np.where(live, first - np.log10(np.maximum(below[of], 1)), first if 1 - d[1] > 1e-9 else first - math.log10(2))
        spare = np.where(self.counted, once, self.log + np.where(live, weight[of], 0.0))
        self.log = np.where(inside, log[at] if k else 0.0, spare)
        self.order += 1
        self.key, self.start = self._longer(own.key[context], self.name[word]), self._longer(np.array([self.start], U), np.array([END_ID]))[0]
        self.n, self.at, self.lone, self.under = n, own.at, np.where(inside, lone[at] if k else True, True), np.where(live, below[of], 0)


def climbed(b: Block, model: Model) -> Scorer:
    """The block's scorer at the highest order that the model has."""
    scorer = Scorer(b, model)
    for order in model.orders:
        scorer.rise(scorer.grams(order.parts), order)
    return scorer


def count_grams(docs: DataFrame, model: Model, parts: int) -> Order:
    """The order above those that the model has."""
    level = len(model.orders) + 2
    lower = model.orders[-1].discounts if model.orders else None

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            scorer = climbed(b, model)
            own = scorer.grams(parts)
            inside = own.at >= 0
            n = np.bincount(own.at[inside & scorer.counted], minlength=len(own.part))
            spare = np.bincount(own.at[inside & ~scorer.counted], minlength=len(own.part))
            name = np.append(scorer.name, NO_WORD)[own.word]
            low = np.zeros(len(own.part), np.int64)
            low[: len(own.token)] = scorer.n[scorer.at[own.token]]
            rows = []
            for part, o, starts in own.messages():
                v = own.context[o[starts]]
                rows.append({
                    "part": part, "block": b.key, "contexts": steps(own.key[v]), "runs": packed(np.diff(np.append(starts, len(o)))), "asks": bits(own.held_out[v]), "below": packed(own.below[v]),
                    "once": packed(np.where(own.home[v] == part, own.spare[v], 0)), "words": packed(name[o]), "low": packed(low[o]), "n": packed(n[o]), "spare": packed(spare[o]), "alone": 0,
                })
            rows[0]["alone"] = int(((own.of < 0) & scorer.counted).sum())
            yield pa.RecordBatch.from_pylist(rows, schema=asked)

    def answer(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        contexts, runs = [summed(r["contexts"]) for r in rows], [unpacked(r["runs"]).astype(np.int64) for r in rows]
        joined = lambda name: np.concatenate([unpacked(r[name]) for r in rows]).astype(np.int64)
        words = joined("words")
        which, where = np.unique(np.concatenate(contexts), return_inverse=True)
        context = np.repeat(where, np.concatenate(runs))
        order = np.lexsort((words, context))
        new = np.flatnonzero((np.diff(context[order], prepend=-1) != 0) | (np.diff(words[order], prepend=-1) != 0))
        add = lambda x: np.add.reduceat(x[order], new) if len(new) else np.zeros(0, np.int64)
        total = add(joined("n"))
        once = total + add(joined("spare")) == 1
        spread = np.diff(np.append(new, len(order)))
        told, lone = np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        told[order], lone[order] = np.repeat(total, spread), np.repeat(once, spread)
        owner, low = context[order[new]], joined("low")[order[new]]
        below = np.zeros(len(which), np.int64)
        below[where] = joined("below")
        lowest = lambda low, below: model.unigrams.probability(low) if lower is None else lower[np.minimum(low, DISCOUNTED + 1)] * low / np.maximum(below, 1)
        alone = np.bincount(where, joined("once"), minlength=len(which)).astype(np.int64)
        sums = [np.bincount(owner, total == j, minlength=len(which)).astype(np.int64) for j in range(1, DISCOUNTED + 1)]
        sums[0] += alone
        every = np.bincount(owner, total, minlength=len(which)).astype(np.int64) + alone
        mass = np.bincount(owner, np.where(total > 0, lowest(low, below[owner]), 0), minlength=len(which)) + alone * lowest(np.ones(len(which), np.int64), below)
        out, at, pos = [], 0, 0
        for r, run in zip(rows, runs, strict=True):
            w, size = where[pos : pos + len(run)], int(run.sum())
            asks = w[unbits(r["asks"], len(run))]
            out.append({
                "block": r["block"], "part": r["part"], "n": packed(told[at : at + size]), "lone": bits(lone[at : at + size]), "total": packed(every[w]), "seen": [packed(x[w]) for x in sums],
                "mass": pressed(mass[asks].tobytes()),
            })
            at, pos = at + size, pos + len(run)
        numbers = [int((total == j).sum()) for j in range(1, DISCOUNTED + 2)]
        numbers[0] += int(alone.sum()) + sum(r["alone"] for r in rows)  # each is a gram of its own, seen once
        return pa.Table.from_pylist([*out, {"block": "sums", "part": rows[0]["part"], "sums": numbers}], schema=answers)

    fields = ("contexts", "runs", "asks", "below", "once", "words", "low", "n", "spare")
    asked = pa.schema([("part", pa.int32()), ("block", pa.string()), *[(x, pa.binary()) for x in fields], ("alone", pa.int64())])
    answers = pa.schema([("block", pa.string()), ("part", pa.int32()), ("n", pa.binary()), ("lone", pa.binary()), ("total", pa.binary()), ("seen", pa.list_(pa.binary())), ("mass", pa.binary()), ("sums", pa.list_(pa.int64()))])
    sent = _scan(docs).mapInArrow(ask, f"part int, block string, {', '.join(f'{x} binary' for x in fields)}, alone long")
    got = sent.groupBy("part").applyInArrow(answer, "block string, part int, n binary, lone binary, total binary, seen array<binary>, mass binary, sums array<long>")
    replies, sums = _answered(got, f"katz-{level}")
    return Order(replies, parts, discounts(np.array(sums)))


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """The model of docs, which has doc_id and text and is read from files: answers for its own blocks."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    word_parts, parts = 4 + size // UNIGRAMS, 4 + size // GRAMS
    cuts = cuts_of(docs.sparkSession)
    with same_cuts(docs.sparkSession, cuts):
        words, unigrams = count_unigrams(docs, word_parts)
        model = Model(words, word_parts, unigrams, [], cuts)
        for _ in range(2, order + 1):
            model.orders.append(count_grams(docs, model, parts))
    return model


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row of docs, which has
    doc_id and text and is read from files. Training leaves out the documents with crc32(doc_id) mod 7 = 2."""
    return docs.sparkSession.createDataFrame([], SCORES) if docs.isEmpty() else scored(docs, train(docs, order))


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The scores (staged) of the documents that the model was trained with."""
    told = model.unigrams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            n, _ = model.words_of(b)
            base = np.log10(n + 1.0)[b.token] - math.log10(told.tokens + told.distinct + 1)
            logs = climbed(b, model).log if told.tokens else np.zeros(len(b.token))
            sums = lambda x: np.add.reduceat(x, b.first)
            cols = [b.ids, pa.array(~b.training), pa.array(b.lengths), pa.array(sums((n[b.token] > 0).astype(np.int64))), pa.array(np.full(len(b.first), told.tokens)), pa.array(sums(base)), pa.array(sums(logs))]
            yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCORES.split(", ")])

    with same_cuts(docs.sparkSession, model.cuts):
        return stage(_scan(docs).mapInArrow(run, SCORES), "katz-scores")


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
