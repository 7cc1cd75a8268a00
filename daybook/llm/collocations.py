"""Phrase collocations by a sample, its negative border, and full passes that count both (Toivonen's method).

Phrases are runs of one to ``MAX_WORDS`` words inside a piece of a text, counted for each language. A sample of the
documents (``SAMPLE``, told by a hash of the row) proposes the phrases that are frequent in it at a lowered threshold. A full
pass counts every proposed phrase and every phrase of their negative border: those whose parts without the last and without
the first word are both proposed. A frequent phrase of the border that was not proposed is a failure of the sample: the
frequent phrases are then proposed too, and a further full pass counts what came into the border by that, until no new
phrase is frequent. The result doesn't depend on the sample.

Passes count hashes of 61 bits, each with a second one of 31 and the number of words, so what is counted together is one
phrase. Which phrases are proposed is told to the tasks by a sieve of at most ``MOST_BITS`` bits, so it is bounded at any
size of the corpus. What the sieve lets through by mistake is counted like the rest: a count is a count, so mistakes cost
rows, and no phrase is lost; with far more phrases than bits the pass counts all phrases, which grows in proportion to the
text. Tasks sum what they count before it is shuffled, so a phrase that stands everywhere is a few rows. At the end the
frequent phrases get their words from growing shares of the documents, until none is without: a task tells a phrase once.

Cut scores are integers of decimals with 38 digits. A candidate goes if a longer candidate holds it as often: then one that
is longer by a single word does, so only those are compared.

Defined cases: a null text is empty; a null language is ``und``, like the language of that name; rows that repeat count
each; other columns are ignored; a text of any length is counted whole (a task holds one text, and sums of it); with no
documents, or no frequent phrase of two words, there are no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daybook.llm.common import small, stage, table
from daybook.llm.tokens import LOWER_BYTES, STEPS, U, VALUE, mix, power_tables, text_chunks

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
#: The share of documents that are sampled, and the count that makes a phrase frequent in the sample.
SAMPLE, LOWERED = 0.1, 5
#: The shares of the documents that phrases without a name are looked for in, one after the other.
NAMING = (1 / 64, 1 / 8, 1)
MOST_BITS, LEAST_BITS = 1 << 28, 1 << 16
#: Hashes, and phrases, that a task holds before it hands them on.
HELD_HASHES, HELD_PHRASES = 1 << 22, 200_000
UND = "und"

_BREAK, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK[[0x20, 0x09]] = True


class Words:
    """The words of a chunk of texts: hashes, where they begin and end, and which text and piece they stand in."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, seeds: np.ndarray):
        self.raw = LOWER_BYTES[raw]
        ends = _BREAK[raw]
        solid = ~(ends | _BLANK[raw])
        starts, stops = solid.copy(), solid.copy()
        starts[1:] &= ~solid[:-1]
        stops[:-1] &= ~solid[1:]
        begins, last = offsets[:-1][offsets[:-1] < len(raw)], offsets[1:][offsets[1:] > 0] - 1
        starts[begins], stops[last] = solid[begins], solid[last]
        self.at, self.to = np.flatnonzero(starts), np.flatnonzero(stops) + 1
        self.text = np.searchsorted(offsets, self.at, "right") - 1
        self.piece = np.searchsorted(np.flatnonzero(ends), self.at) + self.text
        up, down = power_tables(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, U)
        np.cumsum(VALUE[self.raw] * up[: len(raw)], out=sums[1:])
        self.hash = mix((sums[self.to] - sums[self.at]) * down[self.at] + (self.to - self.at).astype(U))
        self.seed = seeds[self.text]

    def phrase(self, i: int, k: int) -> str:
        return b" ".join(self.raw[self.at[i] : self.to[i + k - 1]].tobytes().split()).decode("utf-8")

    def checks(self, at: np.ndarray, k: int) -> np.ndarray:
        """Second hashes of the phrases of k words at these places, which tell phrases with one hash apart."""
        out = self.seed[at].copy()
        for j in range(k):
            out += self.hash[at + j] * STEPS[j % 5]
        return out


class Sieve:
    """A set of hashes as bits, two for each; it may have more than was put in, never less."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def has(self, h: np.ndarray) -> np.ndarray:
        mask = U(len(self.bits) * 64 - 1)
        p, q = (h >> U(3)) & mask, (h >> U(35)) & mask
        found = (self.bits[p >> U(6)] >> (p & U(63))) & U(1) != 0
        some = np.flatnonzero(found)
        found[some] = (self.bits[q[some] >> U(6)] >> (q[some] & U(63))) & U(1) != 0
        return found


def bits_for(n: int) -> int:
    """Bits of a sieve of n hashes: 64 for each, within the bounds."""
    return max(LEAST_BITS, min(MOST_BITS, 1 << (64 * max(n, 1) - 1).bit_length()))


def sieve(hashes: DataFrame, bits: int) -> Sieve:
    """hashes: h. Its bits are gathered by words of 64, so the driver gets bits / 64 numbers at most."""
    place = lambda by: F.expr(f"shiftrightunsigned(h, {by})").bitwiseAND(F.lit(bits - 1))
    words = hashes.select(F.explode(F.array(place(3), place(35))).alias("p")).select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, CAST(p & 63 AS INT))").alias("bit"))
    told = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits // 64, U)
    out[told["word"].to_numpy()] = told["bit"].to_numpy().view(U)
    return Sieve(out)


def _tagged(h: np.ndarray, k: int) -> np.ndarray:
    """The hash with the phrase's number of words in its lowest three bits."""
    return (h & ~U(7)) | U(k)


def phrases(w: Words, held: Sieve | None, old: Sieve | None = None, known: int = MAX_WORDS - 1, most: int = MAX_WORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(k, places, hashes, which are new): the phrases of each length whose parts without the last and the first word are
    held. New are those of which old doesn't hold both. held: None holds all. Of phrases of more than ``known`` words it is
    not asked; those count as held if their parts are."""
    n = len(w.hash)
    h = mix(w.hash ^ w.seed)
    at = np.arange(n)
    tagged, new = _tagged(h, 1), np.ones(n, bool)
    yield 1, at, tagged, new
    hit = held.has(tagged) if held else new
    was = old.has(tagged) if old else np.zeros(n, bool)
    for k in range(2, most + 1):
        m = max(n - k + 1, 0)
        at = np.flatnonzero(hit[:m] & hit[1 : m + 1] & (w.piece[:m] == w.piece[k - 1 :]))
        h[at] = mix(h[at] * STEPS[0] + w.hash[at + k - 1])
        tagged = _tagged(h[at], k)
        before = was[at] & was[at + 1]
        yield k, at, tagged, ~before
        hit, was = np.zeros(n, bool), np.zeros(n, bool)
        hit[at] = held.has(tagged) if held and k <= known else True
        was[at[before]] = old.has(tagged[before]) if old else False


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str], np.ndarray]]:
    """Words, and the language of each text with its seed."""
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        seed = {x: U(int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")) for x in set(langs)}
        for first, last, raw, offsets in text_chunks(batch.column("text")):
            seeds = np.array([seed[x] for x in langs[first:last]], U)
            yield Words(raw, offsets, seeds), langs[first:last], seeds


def _second(check: np.ndarray) -> np.ndarray:
    return (mix(check) >> U(33)).astype(np.int32)


def counted(docs: DataFrame, held: Sieve | None, old: Sieve | None = None, levels: tuple[int, int] = (0, MAX_WORDS), known: int = MAX_WORDS - 1) -> DataFrame:
    """h, c, n: how often each phrase of these numbers of words occurs of which ``phrases`` says that it is to be counted
    now. With no words: how many words its language has."""
    told = docs.sparkSession.sparkContext.broadcast((held.bits if held else None, old.bits if old else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, before = (Sieve(b) if b is not None else None for b in told.value)
        gathered, size, totals = [], 0, defaultdict(int)

        def summed() -> pa.RecordBatch:
            h, c = (np.concatenate(x) for x in zip(*gathered, strict=True))
            order = np.argsort(h)
            h, c = h[order], c[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]))
            return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(c[first]), pa.array(np.diff(np.append(first, len(h))))], ["h", "c", "n"])

        for w, _, seeds in _chunks(batches):
            if levels[0] == 0:
                for seed, n in zip(seeds.tolist(), np.bincount(w.text, minlength=len(seeds)).tolist(), strict=True):
                    totals[seed] += n
            for k, at, tagged, new in phrases(w, mine, before, known, levels[1]):
                if k >= levels[0]:
                    gathered.append((tagged[new], _second(w.checks(at[new], k))))
                    size += len(gathered[-1][0])
            if size >= HELD_HASHES:
                yield summed()
                gathered, size = [], 0
        if size:
            yield summed()
        if totals:
            seeds = np.array(list(totals), U)
            yield pa.RecordBatch.from_arrays([pa.array(_tagged(seeds, 0).view(np.int64)), pa.array(_second(seeds)), pa.array(list(totals.values()))], ["h", "c", "n"])

    return docs.mapInArrow(run, "h long, c int, n long").groupBy("h", "c").agg(F.sum("n").alias("n"))


def names(docs: DataFrame, wanted: Sieve) -> DataFrame:
    """h, c, lang, phrase: the words of the phrases that the sieve has; the empty phrase for a language."""
    told = docs.sparkSession.sparkContext.broadcast(wanted.bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, seen = Sieve(told.value), set()
        for w, langs, seeds in _chunks(batches):
            rows = []
            for tag, c, has, lang in zip(_tagged(seeds, 0).tolist(), _second(seeds).tolist(), mine.has(_tagged(seeds, 0)).tolist(), langs, strict=True):
                if has and (tag, c) not in seen:
                    seen.add((tag, c))
                    rows.append((tag, c, lang, ""))
            for k, at, tagged, _ in phrases(w, None):
                mask = mine.has(tagged)
                at, tagged = at[mask], tagged[mask]
                c = _second(w.checks(at, k))
                order = np.lexsort((c, tagged))
                at, tagged, c = at[order], tagged[order], c[order]
                first = np.flatnonzero(np.concatenate([[True], (tagged[1:] != tagged[:-1]) | (c[1:] != c[:-1])])[: len(at)])
                for tag, c, i in zip(tagged[first].tolist(), c[first].tolist(), at[first].tolist(), strict=True):
                    if (tag, c) not in seen:
                        seen.add((tag, c))
                        rows.append((tag, c, langs[w.text[i]], w.phrase(i, k)))
            if rows:
                tags, seconds, own, said = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(tags, U).view(np.int64)), pa.array(seconds, pa.int32()), pa.array(own), pa.array(said)], ["h", "c", "lang", "phrase"])
            if len(seen) >= HELD_PHRASES:
                seen = set()

    return docs.mapInArrow(run, "h long, c int, lang string, phrase string").dropDuplicates(["h", "c"])


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, sample: float = SAMPLE, lowered: int = LOWERED) -> DataFrame:
    """lang, phrase, n (staged): all phrases of at most ``MAX_WORDS`` words that occur ``min_count`` times or more in a
    language, and for each language with as many words the empty phrase with their number. docs: text, lang."""
    docs = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("lang"), F.lit(UND)).alias("lang"))
    share = lambda of, seed: docs.where(F.pmod(F.xxhash64(F.lit(seed), "text", "lang"), F.lit(1_000_000)) < int(of * 1_000_000))
    often = lambda df, least, label: stage(df.where(F.col("n") >= least), label)
    some = share(sample, 1)
    short = often(counted(some, None, levels=(1, 2)), lowered, "phrases-sampled")
    long = often(counted(some, sieve(short, bits_for(short.count())), levels=(3, MAX_WORDS), known=2), lowered, "phrases-sampled")
    proposed = short.unionByName(long)
    bits = bits_for(2 * proposed.count())
    held = sieve(proposed, bits)
    found = often(counted(docs, held), min_count, "phrases-frequent")
    while True:
        # Phrases of the most words are in no border.
        wider = Sieve(held.bits | sieve(found.where(F.col("h").bitwiseAND(7) < MAX_WORDS), bits).bits)
        if np.array_equal(wider.bits, held.bits):
            break
        found = found.unionByName(often(counted(docs, wider, held, levels=(2, MAX_WORDS)), min_count, "phrases-frequent"))
        held = wider
    missing, named = found, []
    for of in NAMING:
        wanted = missing.count()
        if not wanted:
            break
        told = names(share(of, 2), sieve(missing, bits_for(wanted))).join(missing, ["h", "c"])
        named.append(stage(told.select("h", "c", "lang", "phrase", "n"), "phrases-named"))
        missing = stage(missing.join(named[-1].select("h", "c"), ["h", "c"], "left_anti"), "phrases-missing")
    return reduce(DataFrame.unionByName, named).select("lang", "phrase", "n") if named else docs.sparkSession.createDataFrame([], "lang string, phrase string, n long")


def _joined(w: Column) -> Column:
    return F.array_join(w, " ")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, sample: float = SAMPLE, lowered: int = LOWERED) -> DataFrame:
    """lang, phrase, a, l, r, n, cut, score: each candidate of two words or more with its lowest-scoring cut, but for those
    that a longer candidate holds as often. docs: text, lang."""
    held = frequent_phrases(docs, min_count, sample, lowered)
    totals = held.where("phrase = ''").select("lang", F.col("n").alias("n"))
    counts = held.where("phrase <> ''")
    w = F.split("phrase", " ")
    long = counts.select("lang", "phrase", F.col("n").alias("a"), w.alias("w")).where(F.size("w") > 1)
    parts = long.where(F.size("w") > 2).select("lang", "a", F.explode(F.array(_joined(F.expr("slice(w, 1, size(w) - 1)")), _joined(F.expr("slice(w, 2, size(w) - 1)")))).alias("phrase")).distinct()
    kept = long.join(parts, ["lang", "phrase", "a"], "left_anti")
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _joined(F.expr("slice(w, 1, cut)")).alias("left"), _joined(F.expr("slice(w, cut + 1, size(w))")).alias("right"))
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(small(totals), "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("_over", (F.lit(1000).cast("decimal(4,0)") * wide("a") * F.col("n").cast("decimal(15,0)")).cast("decimal(38,0)")).withColumn("_under", (wide("l") * wide("r")).cast("decimal(38,0)"))
    scored = cuts.withColumn("score", F.expr("_over DIV _under"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("b"))
    return best.select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", F.col("b.cut").cast("long").alias("cut"), "b.score")


def first_of_each(scored: DataFrame, top: int = TOP) -> DataFrame:
    """The first so many of each language, with their rank. Shares of a language are cut to as many first, so that no task
    orders a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(256))
    some = scored.withColumn("_share", share).withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_share").orderBy(*order))).where(F.col("_n") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.drop("_share", "_n")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations(table(spark, sf_dir, "documents").select("text", "lang"))
    return first_of_each(found).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_sql() -> str:
    return rf"""
WITH d AS (SELECT coalesce(lang, '{UND}') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, {MAX_WORDS + 1})) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
t AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inside AS (SELECT lang, a, array_to_string(w[1:k - 1], ' ') AS phrase FROM c WHERE k > 2 UNION SELECT lang, a, array_to_string(w[2:k], ' ') FROM c WHERE k > 2),
cuts AS (SELECT c.lang, c.phrase, c.a, c.w, c.k, unnest(range(1, c.k)) AS cut FROM c ANTI JOIN inside USING (lang, phrase, a)),
s AS (SELECT cuts.lang, cuts.phrase, cuts.a, cut, x.a AS l, y.a AS r, CAST(t.n AS BIGINT) AS n, CAST((1000::HUGEINT * cuts.a * t.n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
      FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(cuts.w[1:cut], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(cuts.w[cut + 1:cuts.k], ' ') JOIN t ON t.lang = cuts.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= {TOP}
"""
