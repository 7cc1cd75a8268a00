"""Operator 12 against a plain trie."""

import collections
import hashlib
import random
import uuid
import zlib

import pytest

from daybook.llm import prefix_trie
from daybook.llm.common import shared_dir

SCHEMA = "conv_id long, turn long, role string, text string, depth string, conv int, pos long"


def plain(rows):
    turns = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    whole = {c: [t[2:] for t in sorted(own, key=lambda t: t[:2])] for c, own in turns.items()}
    rebuilt = {}
    for c, own in whole.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        rebuilt[c] = whole.get(first, [])[:h] + own[h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, own in sorted(rebuilt.items()):
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
        ends[tuple(own)].append(c)
    kids, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, own in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(own) - 1) * len(k[-1][1].encode()) if k else 0
    sha = lambda k: hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()
    return sorted((members[k][0], len(k), members[k[:-1]][0] if k else -(10**9), len(members[k]), kids[k], leaves[k], saved[k], sha(k)) for k in members)


def nodes(df):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(-(10**9) if r[c] is None else r[c] for c in columns) for r in df.collect())


def conversation(rng, c, few, length):
    return [(c, t, rng.choice(["user", "assistant", None]), rng.choice(few)) for t in range(length)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    few = ["a", "b", "é😀", None, "", "long " * 50]
    out = []
    for c in [*range(0, 150), *range(-12, 0), 1003, 1007]:
        if c % 7 != 5:
            out += conversation(rng, c, few[:2] if c % 3 else few, rng.randrange(1, 14))
    for c in range(200, 260):
        out += [(c, t, "user", f"same {t}") for t in range(11)]  # copies
    for c in range(300, 330):
        out += [(c, t, "user", "one" if t < c - 300 else f"own {c} {t}") for t in range(30)]  # each leaves the others one turn later
    out += [(400, None, "user", "null turn"), (400, 3, "user", "three"), (401, -5, None, None), (None, 1, "user", "nobody")]
    rng.shuffle(out)
    return out


def test_nodes_are_those_of_a_plain_trie(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert nodes(prefix_trie.trie(df)) == plain(rows)


def test_stretches_of_long_conversations(spark, rows, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 3)
    more = rows + [(c, t, "user", f"{t % 50}") for c in (500, 501, 502) for t in range(400 - c % 5)]
    df = spark.createDataFrame(more, "conv_id long, turn long, role string, text string")
    assert nodes(prefix_trie.trie(df)) == plain(more)


def test_turns_with_one_number_and_repeated_rows(spark):
    """Their order is that of their hashes: the same however the rows are dealt; each row is a turn."""
    rows = [(c, 1, "user", x) for c in (0, 1, 2) for x in ("p", "q", "q", "r")]
    got = [nodes(prefix_trie.trie(spark.createDataFrame(x, "conv_id long, turn long, role string, text string").repartition(n))) for n, x in ((1, rows), (3, rows[::-1]))]
    assert got[0] == got[1] and max(n[1] for n in got[0]) == 4


def test_query_with_clashing_columns_and_empty_tables(spark, rows):
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA).write.parquet(f"{path}/conversations.parquet")
    assert nodes(prefix_trie.op12_prefix_trie(spark, path)) == plain(rows)
    none = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{none}/conversations.parquet")
    assert prefix_trie.op12_prefix_trie(spark, none).collect() == []
