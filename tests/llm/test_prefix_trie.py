"""The trie of conversations against one built from the definition."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from timberline.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = int(c - (abs(c) % 20) * (1 if c >= 0 else -1))
        seq = tuple(own.get(base, [])[:h] + t[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[c] for c in children[path]) or 1
        words = len(re.findall("[^\x20\x09-\x0d]+", path[-1][1])) if path else 0
        saved[path] = (len(members[path]) - 1) * words + sum(saved[c] for c in children[path])
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    )


def conversations(seed, n, turns, kinds):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        c = c * 3 - n
        for k in range(rng.randint(1, turns)):
            turn = None if rng.random() < 0.05 else k
            rows.append((c, turn, rng.choice(["user", "user", None, "a"]), rng.choice([None, "", "w x", f"t{rng.randrange(kinds)} b\tc", "same turn of all"])))
    rng.shuffle(rows)
    return rows


def check(got, want):
    key = lambda r: (*r[:2], *(str(x) for x in r[2:]))
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("limit", [50_000, 40, 3, 1])
def test_equals_the_definition(spark, limit):
    rows = conversations(1, 150, 6, 3) + [(None, 0, "user", "x"), (900, 5, "user", "w x"), (900, 5, "user", "w x")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("STEPS", F.lit(1)).withColumn("key", F.lit("x")).repartition(3)
    check(prefix_trie.prefix_trie(df, limit=limit).collect(), plain(rows))


@pytest.mark.parametrize("limit", [50_000, 30])
def test_many_copies_and_a_long_shared_prefix(spark, limit):
    rows = []
    for c in range(0, 600):
        rows += [(c, k, "user", f"turn {k}") for k in range(30 if c % 2 else 12)]
        if c % 5 == 0:
            rows.append((c, 99, "user", f"own {c}"))
    df = spark.createDataFrame(rows, SCHEMA)
    check(prefix_trie.prefix_trie(df, limit=limit).collect(), plain(rows))


def test_one_long_conversation(spark):
    rows = [(7, k, "user", f"t{k}") for k in range(30_000)]
    check(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), limit=100).collect(), plain_chain(rows))


def plain_chain(rows):
    nobody = hashlib.sha256().hexdigest()
    h = zlib.crc32(b"7") % 4
    n = len(rows) - h
    return [(7, d, 7 if d else None, 1, int(d < n), 1, 0, hashlib.sha256(b"7").hexdigest() if d == n else nobody) for d in range(n + 1)]


def test_turnless_and_empty(spark):
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20)
    rows = [(c, 0, "user", "gone"), (c + 100_000 - c % 20 + 1, 0, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    check(prefix_trie.prefix_trie(df).collect(), plain(rows))
    check(prefix_trie.prefix_trie(df.filter(f"conv_id = {c}")).collect(), plain(rows[:1]))
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0


def test_very_long_turns(spark):
    rows = [(c, 0, "user", "word " * 400_000 + ("x" if c > 1000 else "")) for c in (1000, 1001, 1003)]
    check(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect(), plain(rows))
