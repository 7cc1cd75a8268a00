"""N-gram Jaccard join by parity sketches.

A document is its set of 5-word shingles, each a 64-bit hash. A size band fixes a number of blocks; every shingle falls
into one block, and a block's sketch is the XOR of its shingles: 64 parity bits each. Where two sets differ in d
shingles, at most d blocks can differ, and a similarity of 3/4 bounds d by a seventh of the two sizes together. So of
more than d blocks some agree (pigeonhole), and it is enough to join the first d + ``SHARED`` blocks of each set in one
order for all: a pair that is near then meets in ``SHARED`` of them. The order puts blocks that many sets have last, so
a passage that many documents share is not joined on while a document has enough else. Bands double in size; a set that
may have a partner in the band below joins there too. A set with too few filled blocks also joins with each shingle as
a block of its own.

Every set also has a long parity sketch of four to eight bits for each shingle, whose Hamming distance never exceeds the
true difference; a pair is verified on whole sets only where the sketches allow it. Blocks with up to ``FULL`` sets give
all their pairs. Of a fuller block each set is first held against one of its sets only. A pair that meets in full blocks
alone meets there ``SHARED`` times, so sets with fewer full blocks are done with, and the others leave out the last
``SHARED - 1`` of theirs; those that the links so far leave in different components are compared by their long sketches,
in squares of a bounded size, until no block has a pair that is neither joined nor excluded. Every link is verified on the whole sets. Equal sets are one node throughout.

``near_components`` verifies what connects its components: a pair whose ends are already joined by others isn't looked
at. ``near_links`` verifies every pair, and gives all links between different sets and the documents of each set.

A block that no task is told of as frequent holds at most one in ``LISTED`` of all occurrences counted, as so many are
no rarer; so what one key of the join brings together unsalted is a bounded share of the rows.

Components come from alternating large-star and small-star steps, each a written table.

Defined cases: null texts and texts without words have no shingles and no links; texts with fewer than five words are
one shingle; rows that repeat get the same component; a null doc_id takes part through equal texts only; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from daybook.llm.common import fresh, small, stage, table
from daybook.llm.tokens import U, mix, shingle_sets

#: Shared blocks that a near pair is sure to have among those joined, where its sets have so many to spare.
SHARED = 4
#: Sets in a block that gives all its pairs.
FULL = 24
#: Sets of a task that are counted together, the most blocks of theirs, and occurrences there that make one frequent.
COUNTED, COUNTED_KEYS, FREQUENT = 4096, 1 << 21, 3
#: Frequent blocks that are told to all tasks (2 MB); which ones does not change the result.
LISTED = 1 << 18
#: Groups that a frequent block is split into, and sets compared at a time.
SALTS, SQUARE = 64, 2000
#: Rows of blocks, and bytes of sets, that a task hands on at a time.
ROWS, SENT = 1 << 17, 1 << 22
#: Bytes of a shingle's hash that are sent to verify a pair.
PLANES = 5


def _signature(s: np.ndarray) -> tuple[int, int]:
    x = np.bitwise_xor.reduce(mix(s ^ U(0x5851F42D4C957F2D)))
    y = np.add.reduce(mix(s + U(0x14057B7EF767814F)))
    return int(mix(np.array([x ^ (U(len(s)) << U(40))]))[0].view(np.int64)), int(y.view(np.int64))


def sketch(s: np.ndarray) -> bytes:
    """Parity bits of the set: four to eight for each shingle. Halves of a longer sketch XOR to the shorter one."""
    bits = 4 << max(6, len(s).bit_length())
    return np.packbits((np.bincount((s >> U(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _folded(b: bytes, size: int) -> np.ndarray:
    """A sketch as 64-bit words, folded down to size bytes."""
    return np.bitwise_xor.reduce(np.frombuffer(b, U).reshape(-1, size // 8), axis=0)


def sent(s: np.ndarray) -> bytes:
    """The sorted set's leading ``PLANES`` bytes, byte plane by byte plane: the first planes compress well."""
    return np.ascontiguousarray(s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :PLANES].T).tobytes()


def received(b: pa.Scalar) -> np.ndarray:
    raw = np.frombuffer(b.as_buffer(), np.uint8).reshape(PLANES, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, 8 - PLANES :] = raw.T
    return out.reshape(-1).view(">u8").astype(U)


def _band_keys(s: np.ndarray, band: int) -> np.ndarray:
    """The sketch of each filled block, as a key that is told apart by band and block."""
    block = s & U((1 << band) - 1)
    order = np.argsort(block, kind="stable")
    block = block[order]
    first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    return mix(np.bitwise_xor.reduceat(s[order], first) ^ mix(block[first] * U(64) + U(band + 1)))


def _schemes(s: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """(keys, most blocks that can differ, keys to spare) for each band that the set joins in."""
    n = len(s)
    own = n.bit_length() - 1
    bounds = [(own, (n + 4 * n // 3) // 7)]
    below = (1 << own) - 1
    if own and 4 * below >= 3 * n:
        bounds.append((own - 1, (n + below) // 7))
    for band, most in bounds:
        keys = _band_keys(s, band)
        yield keys, most, len(keys) - most
        if len(keys) <= most:
            yield mix(s ^ mix(np.array([band + 1000], U))), most, n - most


def _chosen(keys: np.ndarray, most: int, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first keys in the common order, and which of them are listed as frequent."""
    at = np.searchsorted(listed, keys) if len(listed) else np.zeros(len(keys), np.int64)
    frequent = (at < len(listed)) & (listed[np.minimum(at, len(listed) - 1)] == keys) if len(listed) else np.zeros(len(keys), bool)
    order = np.lexsort((keys, frequent))[: most + SHARED]
    return keys[order], frequent[order]


def set_facts(docs: DataFrame) -> DataFrame:
    """doc_id, n, two signatures and the sketch of the set; and, told by a non-null key, how often a frequent block was seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set = set()
        size = 0

        def counted() -> pa.RecordBatch:
            nonlocal size
            keys, n = np.unique(np.concatenate(held) if held else np.zeros(0, U), return_counts=True)
            keys, n = keys[n >= FREQUENT], n[n >= FREQUENT]
            held.clear()
            seen.clear()
            size = 0
            none = pa.nulls(len(keys), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(keys), pa.binary()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=names)

        for batch in batches:
            out, sketches = [], []
            for _, s in shingle_sets(batch.column("text")):
                sign = _signature(s) if len(s) else (0, 0)
                out.append((len(s), *sign))
                sketches.append(sketch(s) if len(s) else None)
                if len(s) and sign not in seen:
                    seen.add(sign)
                    for k, _, _ in _schemes(s):
                        held.append(k)
                        size += len(k)
                    if len(seen) >= COUNTED or size >= COUNTED_KEYS:
                        yield counted()
            facts = np.array(out, np.int64).reshape(-1, 3)
            none = pa.nulls(len(facts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(facts[:, c]) for c in range(3)], pa.array(sketches, pa.binary()), none, none], names=names)
        yield counted()

    names = ["doc_id", "n", "s1", "s2", "sketch", "key", "seen"]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(f"{x} {'binary' if x == 'sketch' else 'long'}" for x in names))


def block_rows(docs: DataFrame, listed: np.ndarray) -> DataFrame:
    """(key, salt, need, s1): the blocks that each set is joined on. need: shared blocks that a near pair must have."""
    frequent_keys = docs.sparkSession.sparkContext.broadcast(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, seen = frequent_keys.value, set()
        keys, salts, needs, signs, size = [], [], [], [], 0

        def gathered() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *[pa.array(np.concatenate(x)) for x in (salts, needs, signs)]], names=["key", "salt", "need", "s1"])

        for batch in batches:
            for _, s in shingle_sets(batch.column("text")):
                sign = _signature(s) if len(s) else (0, 0)
                if not len(s) or sign in seen:
                    continue
                seen.add(sign)
                if len(seen) > 1 << 17:
                    seen.clear()
                for all_keys, most, spare in _schemes(s):
                    k, frequent = _chosen(all_keys, most, top)
                    keys.append(k)
                    salts.append(np.where(frequent, 1 + (sign[1] & (SALTS - 1)), 0).astype(np.int8))
                    needs.append(np.full(len(k), min(SHARED, max(1, spare)), np.int8))
                    signs.append(np.full(len(k), sign[0], np.int64))
                    size += len(k)
                if size >= ROWS:
                    yield gathered()
                    keys, salts, needs, signs, size = [], [], [], [], 0
        if size:
            yield gathered()

    return docs.select("text").mapInArrow(run, "key long, salt byte, need byte, s1 long")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, set) of the documents in ids (column id); rows that repeat an id give a row each, which does no harm: links
    are sets of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, size, first = [], 0, 0
            for _, s in shingle_sets(batch.column("text")):
                sets.append(sent(s))
                size += len(sets[-1])
                if size >= SENT:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(sets)), pa.array(sets, pa.binary())], names=["id", "set"])
                    sets, size, first = [], 0, first + len(sets)
            if sets:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first), pa.array(sets, pa.binary())], names=["id", "set"])

    wanted = docs.select(F.col("doc_id").cast("long"), "text").join(small(ids), F.col("doc_id") == F.col("id"), "left_semi")
    return wanted.mapInArrow(run, "id long, set binary")


def allowed(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, nx, ny, kx, ky) those whose sketches may belong to near sets: (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nx, ny = (batch.column(c).to_numpy() for c in ("nx", "ny"))
            near = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("kx").to_pylist(), batch.column("ky").to_pylist(), strict=True)):
                size = min(len(x), len(y))
                near[i] = 7 * int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum()) <= nx[i] + ny[i]
            keep = pa.array(near)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return pairs.select("a", "b", "nx", "ny", "kx", "ky").mapInArrow(run, "a long, b long")


def sets_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets (id, set) of the documents in pairs (a, b), staged."""
    ids = stage(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "jaccard-ids")
    return stage(_sets(docs, ids), "jaccard-sets")


def verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of documents whose sets are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = received(x), received(y)
                if 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
                    both = np.concatenate((x, y))
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    near[i] = 100 * shared >= 75 * (len(x) + len(y) - shared)
            keep = pa.array(near)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    x, y = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (a, b) reaches."""
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    mark = None
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        flat = large.join(least, "u")
        nxt = flat.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(flat.select("u", F.col("m").alias("v"))).distinct()
        seen = Observation()
        now = stage(nxt.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v")), "stars")
        if mark == seen.get:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = seen.get


def _square(block: pd.DataFrame, every: bool) -> pd.DataFrame:
    """Pairs of different components in one square of a block that their sketches allow; without ``every`` only those
    that join what no earlier pair of the square joined."""
    left, right = (block[block.side == s].reset_index(drop=True) for s in (0, 1))
    right = left if right.empty else right
    size = int(block.sketch.map(len).min())
    bits_l, bits_r = (np.array([_folded(b, size) for b in x.sketch], U).reshape(len(x), -1) for x in (left, right))
    comp_r, n_r, id_r = right.component.to_numpy(), right.n.to_numpy(), right.id.to_numpy()
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.get(c, c) != c:
            c = root[c]
        return c

    found: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
    for i, (own, comp, n) in enumerate(zip(left.id.to_numpy(), left.component.to_numpy(), left.n.to_numpy(), strict=True)):
        near = np.flatnonzero((comp_r != comp) & (4 * np.minimum(n, n_r) >= 3 * np.maximum(n, n_r)))
        near = near[near > i] if right is left else near
        near = near[np.bitwise_count(bits_r[near] ^ bits_l[i]).sum(1, dtype=np.int64) * 7 <= n + n_r[near]]
        if not every:
            new = []
            for j in near.tolist():
                a, b = find(int(comp)), find(int(comp_r[j]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    new.append(j)
            near = np.array(new, np.int64)
        if len(near):
            found.append(np.column_stack((np.minimum(own, id_r[near]), np.maximum(own, id_r[near]))))
    return pd.DataFrame(np.concatenate(found), columns=["a", "b"])


def _left_over(members: DataFrame, known: DataFrame, links: DataFrame | None, every: bool) -> DataFrame | None:
    """Pairs still to be verified in full blocks (members: key, id): of different components, and allowed by their
    sketches. Without links each set is a component of its own."""
    placed = members.withColumn("component", F.col("id"))
    if links is not None:
        comp = components(links)
        placed = members.join(comp, members["id"] == comp["node"], "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("size")).where("x <> y").select("key", "size")
    open_ = stage(placed.join(mixed, "key"), "jaccard-open")
    if open_.isEmpty():
        return None
    # Blocks with the same sets are compared once.
    same = open_.groupBy("key", "size").agg(F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h")).groupBy("size", "h").agg(F.min("key").alias("key"))
    open_ = open_.join(same.select("key"), "key", "left_semi")
    k = F.ceil(F.col("size") / SQUARE).cast("int")
    strip = F.pmod(F.xxhash64("id"), k).cast("int")
    cut = open_.withColumn("strip", strip).withColumn("other", F.explode(F.sequence(F.lit(0), k - 1)))
    cut = cut.select("key", "id", "component", F.least("strip", "other").alias("p"), F.greatest("strip", "other").alias("q"), (F.col("strip") > F.col("other")).cast("int").alias("side"))
    told = known.select(F.col("rep").alias("id"), "n", "sketch")
    squares = cut.join(told, "id").groupBy("key", "p", "q").applyInPandas(lambda block: _square(block, every), "a long, b long")
    return squares.distinct()


@dataclass
class Candidates:
    """facts: a row for each document; known: a row for each set (n, s1, s2, sketch, rep: its smallest document); pairs:
    (a, b) of reps that their sketches allow; full: (key, id) of the blocks that are too full to give all their pairs."""

    facts: DataFrame
    known: DataFrame
    pairs: DataFrame
    full: DataFrame


def candidates(docs: DataFrame, stars: bool = True) -> Candidates:
    """What the blocks of docs (doc_id, text) propose. stars: of a full block, each set with one of its sets."""
    told = stage(set_facts(docs), "jaccard-facts")
    facts = told.where("n IS NOT NULL").select("doc_id", "n", "s1", "s2")
    most = told.where("key IS NOT NULL").groupBy("key").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "key").limit(LISTED)
    listed = np.sort(np.array([r["key"] for r in most.select("key").collect()], np.int64).view(U))
    known = stage(told.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")), "jaccard-sets-met")
    at = Window.partitionBy("key", "salt").orderBy("s1")
    rows = block_rows(docs, listed).withColumn("before", F.lag("s1").over(at)).withColumn("after", F.lead("s1").over(at))
    rows = rows.where("(before IS NOT NULL OR after IS NOT NULL OR salt > 0) AND NOT before <=> s1")
    group = Window.partitionBy("key", "salt")
    rows = rows.withColumn("size", F.count(F.lit(1)).over(group)).withColumn("head", F.first("s1").over(at))
    earlier = F.collect_list(F.struct("s1", "need")).over(at.rowsBetween(-FULL, -1))
    rows = rows.withColumn("earlier", F.when((F.col("size") <= FULL) & (F.col("salt") == 0), earlier))
    met = stage(rows.where("size > 1 OR salt > 0").select("key", "salt", "need", "s1", "size", "head", "earlier"), "jaccard-met")
    full = met.where(f"salt > 0 OR size > {FULL}")
    crowded = stage(full.groupBy("s1").agg(F.count(F.lit(1)).alias("full"), F.min("need").alias("need")), "jaccard-crowded")
    cold = met.where(F.size("earlier") > 0).select("s1", "need", F.explode("earlier").alias("e"))
    cold = cold.select(F.least("s1", "e.s1").alias("a"), F.greatest("s1", "e.s1").alias("b"), F.greatest("need", "e.need").alias("need"))
    cold = cold.groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"), F.max("need").alias("need"))
    # What a pair may share besides are blocks that are full for both.
    own = lambda c: small(crowded).select(F.col("s1").alias(c), F.col("full").alias(f"full_{c}"))
    cold = cold.join(own("a"), "a", "left").join(own("b"), "b", "left")
    signs = cold.where("met >= need - least(coalesce(full_a, 0), coalesce(full_b, 0))").select("a", "b")
    if stars:
        heads = full.groupBy("key", "salt").agg(F.first("head").alias("head")).groupBy("key").agg(F.min("head").alias("top"), F.collect_set("head").alias("heads"))  # at most one for each salt
        signs = signs.union(full.select(F.col("s1").alias("a"), F.col("head").alias("b"))).union(heads.select(F.explode("heads").alias("a"), F.col("top").alias("b")))
        signs = signs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    side = lambda c, r, i: known.select(F.col("s1").alias(c), F.col("rep").alias(r), F.col("n").alias(f"n{i}"), F.col("sketch").alias(f"k{i}"))
    pairs = signs.distinct().join(side("a", "ra", "x"), "a").join(side("b", "rb", "y"), "b").where("4 * least(nx, ny) >= 3 * greatest(nx, ny) AND ra <> rb")
    pairs = allowed(pairs.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "nx", "ny", "kx", "ky"))
    last = F.row_number().over(Window.partitionBy("s1").orderBy(F.desc("key")))
    members = full.select("key", "s1").distinct().join(small(crowded.where("full >= need").select("s1", F.col("need").alias("least"))), "s1").withColumn("last", last)
    members = members.where("last >= least").join(known.select("s1", "rep"), "s1").select("key", F.col("rep").alias("id")).distinct()
    return Candidates(facts, known, stage(pairs, "jaccard-pairs"), members)


def near_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, membership): every link (a, b) between different sets, each named by the smallest document that has it, and
    (doc_id, n_shingles, set_id) of every document, set_id null for an empty set. Links of a group of near copies grow with
    its square; copies of a set don't add any."""
    found = candidates(docs, stars=False)
    pairs, more = found.pairs, _left_over(found.full, found.known, None, True)
    if more is not None:
        pairs = stage(pairs.union(more).distinct(), "jaccard-pairs")
    links = stage(verified(sets_of(docs, pairs), pairs), "jaccard-links")
    named = found.facts.join(found.known.select("n", "s1", "s2", "rep"), ["n", "s1", "s2"], "left")
    return links, named.select("doc_id", F.col("n").alias("n_shingles"), F.col("rep").alias("set_id"))


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of docs (doc_id, text)."""
    found = candidates(docs)
    pairs, known = found.pairs, found.known
    # First one pair for each set, then of the others only those that the links so far leave apart.
    sets = sets_of(docs, pairs)
    one = stage(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "jaccard-first")
    links = stage(verified(sets, one), "jaccard-links")
    comp = components(links)
    side = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    apart = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    apart = stage(apart.join(one, ["a", "b"], "left_anti"), "jaccard-apart")
    if not apart.isEmpty():
        links = stage(links.union(verified(sets, apart)), "jaccard-links")
    for every in (False, True):
        more = _left_over(found.full, known, links, every)
        if more is None:
            break
        more = stage(more, "jaccard-pairs")
        if not more.isEmpty():
            links = stage(links.union(verified(sets_of(docs, more), more)), "jaccard-links")
    comp = components(links)
    classes = stage(known.join(comp, known["rep"] == comp["node"], "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component_id")), "jaccard-classes")
    out = found.facts.join(classes, ["n", "s1", "s2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the smallest id."""
    found, key = near_components(docs.select("doc_id", "text")), fresh("_gone", docs.columns)
    gone = stage(found.where("component_id <> doc_id").select(F.col("doc_id").alias(key)).distinct(), "jaccard-gone")
    return docs.join(small(gone), docs["doc_id"] == F.col(key), "left_anti")


def op3_sql() -> str:
    return r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, CAST(len(w) AS BIGINT) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
g AS (SELECT min(doc_id) AS id, list_sort(s) AS s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
u AS MATERIALIZED (SELECT id, n, unnest(s) AS x FROM g),
p AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.x = b.x AND a.id < b.id AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
      GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS MATERIALIZED (SELECT a, b FROM p UNION SELECT b, a FROM p UNION SELECT id, id FROM g),
r(id, c) AS (SELECT a, b FROM e UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.id),
c AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.c, s.doc_id) AS component_id
FROM s LEFT JOIN g ON g.s = list_sort(s.s) LEFT JOIN c ON c.id = g.id
"""
