"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each document, each on evidence of its own: signs, repeated words,
capitals, word lengths, runs, sentence ends, commas, letters. Each has a range where it votes good and one where it
votes bad, so that they overlap freely. Expectation-maximisation estimates how accurate each is and how common good
documents are, from how often the votes fall together and without any given label: it needs only the counts of the vote
patterns, of which there are at most 3 ** labellers, so all documents take part. Each pattern's posterior is the weak
label of its documents. A linear scorer over hashed words and the labellers' statistics is fitted to the posteriors of a
sample (those with the smallest hashes of id and text, in that order: ``SAMPLE`` distinct documents at most, and no more of
them than have ``SAMPLE_BYTES`` bytes of features, which is what the driver holds) and scores every document whole. So neither partitions nor their order change a score.

Defined cases: null and empty texts get no vote, the prior as posterior, and a score; texts of fewer than ``SHORT``
words get no vote; rows that repeat are scored alike and are one document of the sample; where no document gets a vote
the prior is one half and the scorer is flat; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.common import stage, table
from daybook.llm.tokens import U, text_chunks, word_hashes

SAMPLE, SAMPLE_BYTES = 16_384, 128 << 20
BITS = 14
#: Documents with at least this score are kept: doubtful ones stay.
KEEP = 0.3
ROUNDS = 200
SHORT = 20


def _bytes_of(marks: str | range) -> np.ndarray:
    found = np.zeros(256, bool)
    found[[ord(c) for c in marks] if isinstance(marks, str) else list(marks)] = True
    return found


SYMBOL, STOP, COMMA, SPACE = _bytes_of("#*$%&|<>{}[]\\^~@="), _bytes_of(".!?"), _bytes_of(",;:"), _bytes_of(" \t\n\v\f\r")
UPPER = _bytes_of(range(65, 91))
LETTER = UPPER | _bytes_of(range(97, 123)) | _bytes_of(range(128, 256))

#: Labeller: where its statistic is good (from, to), and from where on it is bad (at most, at least).
LABELLERS: dict[str, tuple[tuple[float, float], tuple[float, float]]] = {
    "symbols": ((0.0, 0.002), (-1.0, 0.03)),
    "repetition": ((0.0, 0.09), (-1.0, 0.25)),
    "variety": ((0.0, 0.45), (-1.0, 0.8)),
    "shouting": ((0.0, 0.05), (-1.0, 0.35)),
    "word_length": ((0.0, 1.0), (-1.0, 2.4)),
    "runs": ((0.0, 0.02), (-1.0, 0.15)),
    "sentences": ((0.03, 0.25), (0.005, 0.6)),
    "commas": ((0.01, 0.12), (0.001, 0.25)),
    "letters": ((0.86, 1.0), (0.75, 2.0)),
}
VOTERS = tuple(LABELLERS)
N_DENSE = len(LABELLERS)


def features(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, the labellers' statistics, hashed buckets, their weights) of each text of a chunk; the weights have length one."""
    h, cuts = word_hashes(raw, offsets)
    ends = np.append(SPACE[raw[1:]], True) if len(raw) else np.zeros(0, bool)
    ends[offsets[1:][offsets[1:] > 0] - 1] = True
    marks = [SYMBOL[raw], UPPER[raw], LETTER[raw], SPACE[raw], STOP[raw] & ends, COMMA[raw] & ends]
    sums = np.concatenate((np.zeros((6, 1), np.int64), np.cumsum(marks, axis=1, dtype=np.int64)), axis=1)
    for i in range(len(offsets) - 1):
        a, b = int(offsets[i]), int(offsets[i + 1])
        w = h[cuts[i] : cuts[i + 1]]
        n = len(w)
        if not n:
            yield 0, np.zeros(N_DENSE), np.zeros(0, np.int64), np.zeros(0)
            continue
        symbols, upper, letters, spaces, stops, commas = (sums[:, b] - sums[:, a]).tolist()
        words, counts = np.unique(w, return_counts=True)
        solid = b - a - spaces
        dense = np.array([
            symbols / solid, counts.max() / n, 1 - len(words) / n, upper / max(1, letters), abs(solid / n - 5.0),
            float((w[1:] == w[:-1]).mean()) if n > 1 else 0.0, stops / n, commas / n, letters / solid,
        ])
        weight = np.log1p(counts) / np.sqrt((np.log1p(counts) ** 2).sum())
        yield n, dense, (words >> U(64 - BITS)).astype(np.int64), weight


def votes(n_words: int, dense: np.ndarray) -> np.ndarray:
    """+1 good, -1 bad, 0 none, of each labeller."""
    if n_words < SHORT:
        return np.zeros(N_DENSE, np.int64)
    (low, high), (least, most) = (np.array([x[k] for x in LABELLERS.values()]).T for k in (0, 1))
    return np.where((dense <= least) | (dense >= most), -1, np.where((dense >= low) & (dense <= high), 1, 0))


def pattern_of(v: np.ndarray) -> int:
    return int(((v + 1) * 3 ** np.arange(len(v))).sum())


def votes_of(pattern: int) -> np.ndarray:
    return pattern // 3 ** np.arange(len(VOTERS)) % 3 - 1


def vote_patterns(docs: DataFrame) -> DataFrame:
    """rank, pattern. rank: a hash of id and text, which orders the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [pattern_of(votes(n, dense)) for _, _, raw, offsets in text_chunks(batch.column("text")) for n, dense, _, _ in features(raw, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column("rank"), pa.array(out, pa.int32())], names=["rank", "pattern"])

    return docs.select(_rank().alias("rank"), "text").mapInArrow(run, "rank long, pattern int")


def _rank():
    return F.xxhash64(F.lit(10), F.col("doc_id").cast("long"), F.col("text"))


class LabelModel:
    """Votes are independent given whether a document is good; each labeller has its own rates for either."""

    def __init__(self, counts: dict[int, int], rounds: int = ROUNDS):
        patterns = np.array(sorted(counts), np.int64)
        n = np.array([counts[p] for p in patterns.tolist()], float)
        v = np.array([votes_of(p) for p in patterns.tolist()]).reshape(-1, len(VOTERS))
        self.prior = 0.5
        # Rates of the votes -1, 0, 1 given bad and given good: better than chance to begin with, which says which class is which.
        self.rates = np.tile(np.array([[0.4, 0.3, 0.3], [0.1, 0.2, 0.7]]), (len(VOTERS), 1, 1))
        for _ in range(rounds if len(patterns) else 0):
            q = self._posterior(v)
            good, bad = n * q, n * (1 - q)
            before = self.rates.copy()
            self.prior = float(np.clip(good.sum() / n.sum(), 0.05, 0.95))
            for k in range(len(VOTERS)):
                for x in (-1, 0, 1):
                    at = v[:, k] == x
                    self.rates[k, 0, x + 1] = (bad[at].sum() + 1) / (bad.sum() + 3)
                    self.rates[k, 1, x + 1] = (good[at].sum() + 1) / (good.sum() + 3)
            if np.abs(self.rates - before).max() < 1e-9:
                break

    def _posterior(self, v: np.ndarray) -> np.ndarray:
        k = np.arange(len(VOTERS))
        log = lambda c: np.log(self.rates[k, c, v + 1]).sum(1)
        return 1 / (1 + np.exp(np.clip(log(0) - log(1) + np.log((1 - self.prior) / self.prior), -500, 500)))

    def posterior(self, pattern: int) -> float:
        return float(self._posterior(votes_of(pattern)[None])[0])

    @property
    def accuracy(self) -> dict[str, float]:
        """Of each labeller, where it votes: the chance that its vote is right."""
        right = self.prior * self.rates[:, 1, 2] + (1 - self.prior) * self.rates[:, 0, 0]
        voted = self.prior * (1 - self.rates[:, 1, 1]) + (1 - self.prior) * (1 - self.rates[:, 0, 1])
        return {x: float(r / t) for x, r, t in zip(VOTERS, right, voted, strict=True)}


def fit_scorer(dense: np.ndarray, buckets: list[np.ndarray], hashed: list[np.ndarray], target: np.ndarray, passes: int = 8, rows: int = 32, seed: int = 1) -> np.ndarray:
    """Weights of a logistic scorer: bias, statistics (capped at 1), hashed words; by averaged gradient steps."""
    weights, total = np.zeros(1 + N_DENSE + (1 << BITS)), np.zeros(1 + N_DENSE + (1 << BITS))
    capped = np.column_stack((np.ones(len(dense)), np.minimum(dense, 1.0)))
    rng = np.random.default_rng(seed)
    for p in range(passes):
        rate = 1.0 / (1 + p)
        order = rng.permutation(len(target))
        for at in range(0, len(order), rows):
            own = order[at : at + rows]
            b, w = np.concatenate([buckets[i] for i in own]).astype(np.int64) + 1 + N_DENSE, np.concatenate([hashed[i] for i in own]).astype(float)
            of = np.repeat(np.arange(len(own)), [len(buckets[i]) for i in own])
            z = capped[own] @ weights[: 1 + N_DENSE] + np.bincount(of, weights[b] * w, minlength=len(own))
            g = rate * (target[own] - 1 / (1 + np.exp(-np.clip(z, -50, 50))))
            weights[: 1 + N_DENSE] += g @ capped[own] / 4
            weights += np.bincount(b, g[of] * w, minlength=len(weights))
        total += weights
    return total / passes


def classify(docs: DataFrame, sample: int = SAMPLE, keep: float = KEEP, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, posterior, score, kept. docs: doc_id, text."""
    spark = docs.sparkSession
    seen = stage(vote_patterns(docs), "quality-votes")
    counts = {r["pattern"]: r["count"] for r in seen.groupBy("pattern").count().collect()}  # at most 3 ** labellers
    model = LabelModel(counts)
    posterior = {p: model.posterior(p) for p in counts}

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [f for _, _, raw, offsets in text_chunks(batch.column("text")) for f in features(raw, offsets)]
            packed = [[x[k].astype(kind).tobytes() for x in rows] for k, kind in ((1, "<f4"), (2, "<u2"), (3, "<f4"))]
            label = [posterior[pattern_of(votes(x[0], x[1]))] for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column("rank"), *[pa.array(x, pa.binary()) for x in packed], pa.array(label, pa.float64())], names=["rank", "d", "b", "w", "y"])

    last = seen.select("rank").distinct().orderBy("rank").limit(sample).agg(F.max("rank")).first()[0]
    some = docs.select(_rank().alias("rank"), "text").where(F.col("rank") <= F.lit(last)) if last is not None else docs.select(_rank().alias("rank"), "text").limit(0)
    made = stage(some.mapInArrow(featured, "rank long, d binary, b binary, w binary, y double").dropDuplicates(["rank"]), "quality-features")
    # Of at most ``sample`` rows the ranks and sizes; the first is taken whatever its size.
    sizes = made.select("rank", (F.octet_length("d") + F.octet_length("b") + F.octet_length("w")).alias("n")).toArrow().sort_by("rank")
    held = max(1, int(np.searchsorted(np.cumsum(sizes.column("n").to_numpy().astype(np.int64)), sample_bytes, "right")))
    told = made.where(F.col("rank") <= F.lit(sizes.column("rank")[min(held, len(sizes)) - 1].as_py())).toArrow().sort_by("rank") if len(sizes) else made.toArrow()
    arrays = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in told.column(name)]
    weights = fit_scorer(np.array(arrays("d", "<f4"), float).reshape(-1, N_DENSE), arrays("b", "<u2"), arrays("w", "<f4"), told.column("y").to_numpy())
    del told
    held = spark.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = held.value
        for batch in batches:
            q, s = [], []
            for _, _, raw, offsets in text_chunks(batch.column("text")):
                for n, d, b, w in features(raw, offsets):
                    q.append(posterior[pattern_of(votes(n, d))])
                    z = x[0] + x[1 : 1 + N_DENSE] @ np.minimum(d, 1.0) + x[b + 1 + N_DENSE] @ w
                    s.append(float(1 / (1 + np.exp(-np.clip(z, -50, 50)))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(q, pa.float64()), pa.array(s, pa.float64()), pa.array([v >= keep for v in s], pa.bool_())], names=["doc_id", "posterior", "score", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, posterior double, score double, kept boolean")


def op10_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"))
