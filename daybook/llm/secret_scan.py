"""Secret scans: fixed patterns, and novelty under dictionary-primed zstandard.

The identifier dictionary is the ordinary identifiers that most distinct texts have, counted over all documents, as raw
content for zstandard. A text that repeats counts once. Ordinary words have no digits, stand outside sensitive contexts
in at least ``MIN_TEXTS`` texts, and there more often than as part of a candidate or of an assigned value; so a secret
that repeats doesn't make its own pieces cheap. A candidate is a token that stands in a sensitive context: a sensitive word close before it on its line.
The candidate's marginal bytes are what it adds to its surroundings when both are compressed together with the
dictionary at hand. Words that the dictionary has and repeated text add few bytes for each character; a random string adds
about what its alphabet's entropy says. Candidates above ``NOVELTY`` bytes a character are reported as ``novel``, unless
they are word-like: made of parts (between signs, digits and changes of case) that read as words. Words which no dictionary
has cost as much as random letters under compression, so bytes alone can't tell these.

Of the corpus's words the first ``LONGEST`` letters go into the dictionary; a candidate's surroundings are ``AROUND``
characters on each side. A random string of letters alone passes for word-like about once in ten; with digits, about once in a hundred.

Texts are scanned whole, each in one task; a place is counted in code points, its end exclusive.

Defined cases: null and empty texts have no spans; matches that are too short are dropped, and what they covered is not
searched again; a secret that repeats is reported at each place; of a candidate that base spans cover in part each other
part is measured by itself, and one inside a base span is not reported again;
rows that repeat are scanned alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybook.llm.common import fresh, small, stage, table

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of 32 or more; a shorter run ends where no other can begin, so it need not be matched to be dropped.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

#: Fixed words of a sensitive context.
SENSITIVE = re.compile(r"(?ai:passphrase|password|passwd|pwd|secret|token|api_?key|access_?key|private_?key|auth|credential|bearer|client_?id|signature|session_?id|cookie|salt)")
#: One of these is part of every sensitive word; they are cheap to look for.
ROOTS = ("passphrase", "password", "passwd", "pwd", "secret", "token", "key", "auth", "credential", "bearer", "client", "signature", "session", "cookie", "salt")
SHORTEST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=.~-]{{{SHORTEST},}}")
VALUE = re.compile(rf"[A-Za-z0-9+/_.~-]{{{SHORTEST},}}=*")
#: Whole words; a run with digits is none, as random strings have them.
IDENTIFIER, LONGEST = re.compile(r"(?<![A-Za-z_0-9])[A-Za-z_]{4,}+(?![A-Za-z_0-9])"), 24
REACH, AROUND, LEVEL = 48, 256, 9
NOVELTY = 0.55
#: Parts of a token; what makes them words: letters a part on average, consonants in a row, letters a part may have without
#: a vowel, and words for each number but the first.
PART, VOWELS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+"), re.compile("[aeiouy]")
LETTERS_A_PART, CONSONANTS, WITHOUT_VOWEL, WORDS_A_NUMBER = 3, re.compile("[^aeiouy]{5}"), 4, 4
WORDS_LISTED, WORDS_HELD = 4096, 100_000
#: Distinct texts that an identifier of the dictionary stands in, outside sensitive contexts; texts that a task knows again.
MIN_TEXTS, TEXTS_KNOWN = 2, 1 << 17


def text_identifiers(text: str) -> tuple[set[str], set[str]]:
    """The text's identifiers: those that stand in no sensitive context, and those that do."""
    words = sensitive_words(text)
    held = [m.span(2) for w in words if (m := ASSIGN.match(text, w.start())) and len(m[2]) >= 8] + list(candidates(text, words))
    outside, inside, upto = [], [], 0
    for a, b in sorted(held):
        outside.append(text[upto : max(a, upto)])
        inside.append(text[max(a, upto) : b])
        upto = max(upto, b)
    outside.append(text[upto:])
    found = [{w[:LONGEST] for w in IDENTIFIER.findall("\n".join(parts))} for parts in (outside, inside)]
    return found[0] - found[1], found[1]


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(text): of equal texts one, that with the smallest id. What is shuffled are hashes; texts only where more groups of
    copies than can be broadcast are known. Rows that repeat an id and a text stay."""
    h = docs.select(F.col("doc_id").alias("_id"), "text", F.xxhash64("text").alias("_h"), F.xxhash64(F.lit(1), "text").alias("_g")).where("text <> ''")
    copied = h.groupBy("_h", "_g").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return h.join(small(stage(copied, "secret-copies")), ["_h", "_g"], "left").where("_first IS NULL OR _first = _id").select("text")


def identifier_counts(docs: DataFrame) -> DataFrame:
    """(word, docs, inside): in how many distinct texts each identifier stands outside sensitive contexts only, and in how
    many within one. Tasks leave out texts that they know, and add up what they see before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())
        seen: set = set()

        def counted() -> pa.RecordBatch:
            words = list(held[0] | held[1])
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[pa.array([c[w] for w in words], pa.int64()) for c in held]], names=["word", "docs", "inside"])
            for c in held:
                c.clear()
            return out

        for batch in batches:
            for value in batch.column("text"):
                t = value.as_py()
                own = hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=16).digest()
                if own not in seen:
                    seen.add(own)
                    if len(seen) > TEXTS_KNOWN:
                        seen.clear()
                    for words, c in zip(text_identifiers(t), held, strict=True):
                        c.update(words)
            if sum(map(len, held)) > WORDS_HELD:
                yield counted()
        yield counted()

    return distinct_texts(docs).mapInArrow(run, "word string, docs long, inside long").groupBy("word").agg(F.sum("docs").alias("docs"), F.sum("inside").alias("inside"))


def dictionary(docs: DataFrame) -> bytes:
    """The most common ordinary identifiers, the most common last, where zstandard reaches them most cheaply."""
    ordinary = identifier_counts(docs).where((F.col("docs") >= MIN_TEXTS) & (F.col("docs") > F.col("inside")))
    top = ordinary.orderBy(F.desc("docs"), "word").limit(WORDS_LISTED).collect()
    return "\n".join(r["word"] for r in reversed(top)).encode()


class Novelty:
    """Marginal compressed bytes under one dictionary."""

    def __init__(self, primed: bytes):
        found = zstandard.ZstdCompressionDict(primed, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(primed) >= 8 else None
        if found:
            found.precompute_compress(level=LEVEL)
        self._press = zstandard.ZstdCompressor(level=LEVEL, dict_data=found, write_content_size=False, write_checksum=False, write_dict_id=False)

    def added(self, before: str, candidate: str, after: str) -> int:
        around = f"{before} {after}".encode("utf-8", "replace")
        size = lambda b: len(self._press.compress(b))
        return size(around + b" " + candidate.encode()) - size(around)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def sensitive_words(text: str) -> list[re.Match]:
    low = text.lower()
    return list(SENSITIVE.finditer(text)) if any(w in low for w in ROOTS) else []


def candidates(text: str, words: list[re.Match]) -> Iterator[tuple[int, int]]:
    """The tokens that begin at most ``REACH`` after a sensitive word on its line, whole, each once and in order."""
    upto = 0
    for word in words:
        stop, at = word.end() + REACH, max(word.end(), upto)
        line = text.find("\n", word.end(), stop)
        stop = stop if line < 0 else line
        # A token that begins before stop has its first SHORTEST characters before that; then it is followed to its end.
        while at < stop and (m := CANDIDATE.search(text, at, stop + SHORTEST - 1)):
            a, b = CANDIDATE.match(text, m.start()).span()
            at = upto = b
            yield a, b


def pieces(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """A token with letters and digits as it is; of one without, names and values are told apart by = signs."""
    if re.compile("[0-9]").search(text, a, b) and re.compile("[A-Za-z]").search(text, a, b):
        yield a, b
    else:
        yield from (m.span() for m in VALUE.finditer(text, a, b))


def uncovered(a: int, b: int, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """The parts of a to b that none of the spans covers; taken is sorted."""
    for x, y, _ in taken:
        if x >= b:
            break
        if x > a:
            yield a, x
        a = max(a, y)
    if a < b:
        yield a, b


def wordlike(token: str) -> bool:
    parts = PART.findall(token)
    words = [p.lower() for p in parts if p[0] > "9"]
    numbers = len(parts) - len(words)
    if not words or sum(map(len, words)) < LETTERS_A_PART * len(words) or numbers > 1 + len(words) // WORDS_A_NUMBER:
        return False
    return not any(CONSONANTS.search(w) or len(w) > WITHOUT_VOWEL and not VOWELS.search(w) for w in words)


def novel_spans(text: str, taken: list[tuple[int, int, str]], novelty: Novelty) -> list[tuple[int, int, str]]:
    found, taken = [], sorted(taken)
    for a, b in (part for token in candidates(text, sensitive_words(text)) for piece in pieces(text, *token) for part in uncovered(*piece, taken)):
        if not wordlike(text[a:b]) and novelty.added(text[max(0, a - AROUND) : a], text[a:b], text[b : b + AROUND]) >= NOVELTY * (b - a):
            found.append((a, b, "novel"))
    return found


def scan(docs: DataFrame, primed: bytes, text: str = "text") -> DataFrame:
    """docs with the array column ``secrets`` of structs start, stop, kind."""
    told = docs.sparkSession.sparkContext.broadcast(primed)
    into = fresh("secrets", docs.columns)
    schema = T.StructType([*docs.schema.fields]).add(into, T.ArrayType(T.StructType().add("start", T.IntegerType()).add("stop", T.IntegerType()).add("kind", T.StringType())))
    span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(told.value)
        for batch in batches:
            out = []
            for value in batch.column(text):
                t = value.as_py() or ""
                base = base_spans(t)
                out.append([{"start": a, "stop": b, "kind": k} for a, b, k in sorted(base + novel_spans(t, base, novelty), key=lambda s: (s[0], KINDS.index(s[2])))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, span)], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, schema)


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with what its spans cover replaced by one mark for each run of overlapping spans."""
    out, upto = [], 0
    for a, b, k in sorted(spans):
        if a >= upto:
            out += [text[upto:a], f"<{k}>"]
        upto = max(upto, b)
    return "".join([*out, text[upto:]])


def redact(docs: DataFrame, primed: bytes, text: str = "text") -> DataFrame:
    """docs with secrets replaced; a null text stays null."""
    told = docs.sparkSession.sparkContext.broadcast(primed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(told.value)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            out = []
            for value in batch.column(at):
                t = value.as_py()
                if t:
                    base = base_spans(t)
                    t = redacted(t, base + novel_spans(t, base, novelty))
                out.append(t)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, dictionary(docs)).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["kind"] != "novel")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("secrets")).alias("spans"), count("novel").alias("n_novel")
    )


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, their secrets replaced and n_chars, where they have it, counted anew."""
    out = redact(docs, dictionary(docs.select("doc_id", "text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out
