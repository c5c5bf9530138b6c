"""A trie over the turns of conversations: what they share, and what reading it once would save.

Conversations of equal turns are one sequence with a number of copies. Sequences are
dealt by a hash of their first turn's digest, and each task builds pointer tries, a
dictionary of children for each node, and sums them up from the leaves. First turns
with too many turns below them are taken apart by the turn after the longest prefix that
all their conversations share, and so on, until every subtrie fits a task. The nodes above those
subtries, the root among them, are put together from the subtries' sums.

Turns meet by the SHA-256 of role and text, so no text is moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import BROADCAST_ROWS, dealt_join, ship, written

WORD = r"[^\x20\x09-\x0D]+"
#: Turns of a subtrie that one task builds, unless it is a single sequence; turns of a task on average.
LIMIT = 50_000
TARGET = 50_000
#: Every conversation starts with turns of the last one whose id such a number divides.
EVERY = 20
#: Ids of equal conversations are joined by blocks of 2**12 ids.
BLOCK_BITS = 12

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
COLUMNS = [c.split()[0] for c in NODE.split(", ")]


def digest(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def own_turns(conversations: DataFrame) -> DataFrame:
    """(base, conv_id, turns): each conversation's turns in order, as structs of turn, digest and number of words."""
    role, text = (F.coalesce(conversations[c], F.lit("")) for c in ("role", "text"))
    conv = conversations["conv_id"].cast("long")
    turns = conversations.select(
        (conv - conv % EVERY).alias("base"), conv.alias("conv_id"), conversations["turn"].alias("turn"), digest(role, text).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    ).filter("conv_id is not null")
    return turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "words"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, steps, words) of each conversation: the first turns of its base, then its own from there on."""
    own = own_turns(conversations)
    shared = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    head = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, 3))).over(Window.partitionBy("base"))
    both = own.withColumn("head", F.coalesce(head, F.slice("turns", 1, 0))).withColumn("h", shared)
    turns = F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns")))
    return both.select("conv_id", turns.alias("turns")).select("conv_id", F.col("turns.digest").alias("steps"), F.col("turns.words").alias("words"))


def _key(steps: Column) -> Column:
    """A digest of a prefix."""
    return F.sha2(F.array_join(F.transform(steps, F.hex), ""), 256)


def sequences(convs: DataFrame) -> DataFrame:
    """(conv_id, n, ends, steps, words): each distinct sequence with its smallest conversation, how many there are, and the digest of their ids in order.

    Ids are joined by blocks of neighbours; a task then hashes a sequence's blocks as
    they stream by, so that copies of any number take no memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, low, n, held, ends = None, 0, 0, None, hashlib.sha256()

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([low]), pa.array([n]), pa.array([ends.hexdigest()]), *held], ["conv_id", "n", "ends", "steps", "words"])

        for b in batches:
            done: list[pa.RecordBatch] = []
            for i, (key, first, count, ids) in enumerate(zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)):
                if key == now:
                    ends.update(b"," + ids.encode())
                    n += count
                    continue
                if now is not None:
                    done.append(row())
                now, low, n, held, ends = key, first, count, [b.column(k).slice(i, 1) for k in (4, 5)], hashlib.sha256(ids.encode())
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        if now is not None:
            yield row()

    ship(convs.sparkSession)
    keyed = convs.withColumn("key", _key(F.col("steps"))).withColumn("block", F.shiftright("conv_id", BLOCK_BITS))
    blocks = keyed.groupBy("key", "block").agg(
        F.min("conv_id").alias("first"), F.count(F.lit(1)).alias("count"), F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"),
        F.first("steps").alias("steps"), F.first("words").alias("words"),
    )
    in_order = blocks.repartition("key").sortWithinPartitions("key", "block").select("key", "first", "count", "ids", "steps", "words")
    return written(in_order.mapInArrow(run, "conv_id long, n long, ends string, steps array<binary>, words array<long>"), "trie-sequences")


def _shared(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    upto = F.sequence(F.lit(1), F.least(F.size(a), F.size(b)))
    return F.aggregate(upto, F.lit(0), lambda n, i: F.when((n == i - 1) & (F.get(a, i - 1) == F.get(b, i - 1)), i).otherwise(n))


def _dealt(found: DataFrame, limit: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Sequences with the depth ``r`` and the prefix key of the subtrie they belong to, and those that end above all subtries."""
    below, above = [], [found.filter(F.size("steps") == 0)]
    rest = found.filter(F.size("steps") > 0).withColumn("r", F.lit(1))
    while True:
        rest = rest.withColumn("sub", _key(F.slice("steps", F.lit(1), F.col("r"))))
        groups = rest.groupBy("sub").agg(F.sum(F.size("steps")).alias("turns"), F.count(F.lit(1)).alias("rows"), F.min("steps").alias("a"), F.max("steps").alias("b"))
        large = written(groups.filter((F.col("turns") > limit) & (F.col("rows") > 1)).select("sub", (_shared(F.col("a"), F.col("b")) + 1).alias("deeper")), "trie-large")
        n = large.count()
        if not n:
            return [*below, rest], above
        if n <= BROADCAST_ROWS:
            split, keep = rest.join(F.broadcast(large), "sub"), rest.join(F.broadcast(large), "sub", "left_anti")
        else:
            split, keep = dealt_join(rest, "sub", large, F.col("conv_id")), rest.join(large, "sub", "left_anti")
        below.append(keep)
        split = written(split, "trie-split")
        above.append(split.filter(F.size("steps") < F.col("deeper")).select(found.columns))
        rest = split.filter(F.size("steps") >= F.col("deeper")).select(*found.columns, F.col("deeper").alias("r"))


def tries(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of all subtries of a task; a subtrie's top, at depth ``r``, has its path instead of a parent."""
    depth: list[int] = []
    parent: list[int] = []
    low: list[int] = []
    convs: list[int] = []
    words: list[int] = []
    ends: list[str] = []
    children: list[dict[bytes, int]] = []
    tops: dict[bytes, int] = {}
    paths: dict[int, tuple[list[bytes], list[int]]] = {}
    nobody = hashlib.sha256().hexdigest()

    def node(above: int, at: int, conv: int, n_words: int) -> int:
        depth.append(at), parent.append(above), low.append(conv), convs.append(0), words.append(n_words), ends.append(nobody), children.append({})
        return len(depth) - 1

    for conv, n, end, steps, counts, r in zip(rows["conv_id"].tolist(), rows["n"].tolist(), rows["ends"], rows["steps"], rows["words"], rows["r"].tolist(), strict=True):
        key = b"".join(steps[:r])
        at = tops.get(key)
        if at is None:
            at = tops[key] = node(-1, r, conv, int(counts[r - 1]))
            paths[at] = list(steps[:r]), [int(w) for w in counts[:r]]
        convs[at] += n
        low[at] = min(low[at], conv)
        for k in range(r, len(steps)):
            step = steps[k]
            child = children[at].get(step)
            if child is None:
                child = children[at][step] = node(at, k + 1, conv, int(counts[k]))
            at = child
            convs[at] += n
            low[at] = min(low[at], conv)
        ends[at] = end
    # Postorder without recursion: an order in which parents come first, read from its end.
    order, stack = [], list(tops.values())
    while stack:
        at = stack.pop()
        order.append(at)
        stack.extend(children[at].values())
    leaves, saved = [0] * len(depth), [0] * len(depth)
    for at in reversed(order):
        leaves[at] = leaves[at] or 1
        saved[at] += (convs[at] - 1) * words[at]
        if parent[at] >= 0:
            leaves[parent[at]] += leaves[at]
            saved[parent[at]] += saved[at]
    return pd.DataFrame(
        {
            "conv_id": low, "depth": depth, "parent_conv_id": pd.array([low[p] if p >= 0 else None for p in parent], "Int64"), "n_convs": convs, "n_children": [len(c) for c in children],
            "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends,
            "steps": [paths[k][0] if k in paths else None for k in range(len(depth))], "words": [paths[k][1] if k in paths else None for k in range(len(depth))],
        }
    )


def _ancestors(rows: DataFrame, upto: Column) -> DataFrame:
    """Each row for every prefix of ``steps`` from the root to ``upto`` steps: depth ``k`` and ``key``."""
    return rows.withColumn("k", F.explode(F.sequence(F.lit(0), upto))).withColumn("key", _key(F.slice("steps", F.lit(1), F.col("k"))))


def _upper(tops: DataFrame, above: list[DataFrame]) -> DataFrame:
    """The nodes above all subtries, with their key and path."""
    zero = F.lit(0).cast("long")
    below = tops.select("conv_id", F.col("n_convs").alias("n"), F.lit(None).cast("string").alias("ends"), "steps", "words", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    rows = below.withColumn("upto", F.size("steps") - 1)
    for ended in above:
        rows = rows.unionByName(ended.withColumn("leaves", zero).withColumn("saved", zero).withColumn("upto", F.size("steps")))
    size = F.size("steps")
    here = _ancestors(rows, F.col("upto")).groupBy("key").agg(
        F.first("k").alias("k"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
        F.max(F.when(size == F.col("k"), F.col("ends"))).alias("ends"), F.sum((size == F.col("k") + 1).cast("long") * (F.col("upto") < size).cast("long")).alias("kids"),
        F.first(F.slice("steps", F.lit(1), F.col("k"))).alias("steps"), F.first(F.slice("words", F.lit(1), F.col("k"))).alias("words"),
    )
    here = written(here.withColumn("own", F.when(F.col("k") > 0, (F.col("n") - 1) * F.get("words", F.col("k") - 1)).otherwise(0)), "trie-upper")
    lifted = _ancestors(here.select("own", "steps", F.size("steps").alias("size")), F.size("steps"))
    more = lifted.groupBy("key").agg(F.sum("own").alias("owns"), F.sum((F.col("size") == F.col("k") + 1).cast("long")).alias("more"))
    kids = F.col("kids") + F.col("more")
    return here.join(more, "key").select(
        "key", "k", "conv_id", "n", kids.alias("kids"), F.when(kids == 0, 1).otherwise(F.col("leaves")).alias("leaves"), (F.col("saved") + F.col("owns")).alias("saved"), "ends", "steps"
    )


def prefix_trie(conversations: DataFrame, *, limit: int = LIMIT) -> DataFrame:
    """One row for each distinct prefix of rebuilt conversations: who shares it, what follows, what is saved below it.

    Turns are in order of ``turn``, null first, ties by digest; null role and text count
    as empty. Rows without a conv_id belong to no conversation and are left out. A
    repeated row is a turn of its own. Columns other than conv_id, turn, role and text
    are not read. An empty table gives no rows, not even the root.

    ``saved_tokens`` counts runs of characters other than white space. ``limit`` is how
    many turns a task takes at most as one subtrie. One conversation is a row of 32 bytes
    a turn.
    """
    found = sequences(rebuilt(conversations))
    below, above = _dealt(found, limit)
    rows = below[0]
    for more in below[1:]:
        rows = rows.unionByName(more)
    total = found.agg(F.coalesce(F.sum(F.size("steps")), F.lit(0))).first()[0]
    tasks = max(conversations.sparkSession.sparkContext.defaultParallelism, total // TARGET + 1)
    dealt = rows.select("conv_id", "n", "ends", "steps", "words", "r", F.pmod(F.xxhash64("sub"), F.lit(tasks)).alias("bucket"))
    nodes = written(dealt.groupBy("bucket").applyInPandas(tries, NODE + ", steps array<binary>, words array<long>"), "trie-nodes")
    tops = nodes.filter("steps is not null")
    upper = written(_upper(tops, above), "trie-above")
    parents = upper.select(F.col("key").alias("up"), F.col("conv_id").alias("up_conv"))
    keyed = tops.withColumn("up", _key(F.slice("steps", F.lit(1), F.size("steps") - 1)))
    small = upper.count() <= BROADCAST_ROWS
    joined = keyed.join(F.broadcast(parents), "up") if small else dealt_join(keyed, "up", parents, F.col("conv_id"))
    top = joined.withColumn("parent_conv_id", F.col("up_conv")).select(COLUMNS)
    up = F.when(F.col("k") > 0, _key(F.slice("steps", F.lit(1), F.col("k") - 1)))
    high = upper.withColumn("up", up).join(parents, "up", "left").select(
        "conv_id", F.col("k").cast("long").alias("depth"), F.col("up_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
    return nodes.filter("steps is null").select(COLUMNS).union(top).union(high)


def oracle_sql() -> str:
    return r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, sha256(length(role)::VARCHAR || ':' || role || text)) AS turns FROM t GROUP BY conv_id),
c AS (SELECT conv_id, turns, conv_id - conv_id % 20 AS base, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: ascii(CAST(conv_id AS VARCHAR)[i])::BIGINT)), lambda x, b: xor(x >> 8, crcs[(xor(x, b) & 255) + 1])), 4294967295) % 4 AS h FROM own, crc),
s AS (SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns FROM c LEFT JOIN own b ON b.conv_id = c.base),
m AS (SELECT conv_id, k AS depth, turns[1:k] AS path, k = len(turns) AS ends FROM s, unnest(range(len(turns) + 1)) AS u(k)),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
    CASE WHEN depth > 0 THEN (count(*) - 1) * len(regexp_extract_all(path[depth].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved FROM m GROUP BY depth, path),
k AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, path)),
a AS (SELECT up AS depth, path[1:up] AS path, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM f, unnest(range(depth + 1)) AS u(up) GROUP BY ALL)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, a.n_leaves, a.saved_tokens, f.ends_sha256
FROM f JOIN a USING (depth, path) LEFT JOIN n p ON p.depth = f.depth - 1 AND p.path = f.path[1:f.depth - 1]
"""
