"""Template mining with a bounded fixed-depth tree.

Token count is the tree's first level, the first tokens are the next ones. Mining
depends on order, but only among lines that can meet. At a node, each new token without
a digit gets a child of its own as long as there is room and no line has gone to the
parameter's child; such a token's lines are alone below that child for good. So tokens
are ranked by first appearance, lines are dealt by the path of such tokens, and what is
left at a node shares a task, which is told how many children the node has beside. That
is repeated by level where a node holds many lines. Each task trains on its lines in
order as they stream by; it holds a cluster table, not lines, and a cluster that is
forgotten is given out at once.

All this holds while no cluster is forgotten for the table's size. That goes by the last
use over all token counts, which ``_bounded`` finds by turns: lines are mined under a
schedule of what is forgotten when, and the schedule is told from what was mined, until
it stays. A schedule that stays is what one table would have forgotten, since what
happens at a line hangs on earlier lines alone. Of the lines, only new clusters, and
uses over ``max_clusters`` lines after the last one, can matter to it. Up to ``ALONE``
lines one task follows the table instead (``_together``). What a text is like is looked
for before that, by all tasks; a text that is like no other, as most are, goes through
the table as a key and the tokens that route it. Where only equal lines are alike and no
node can fill up, a table holds the texts used last, and lines are dealt by time
(``_separate``).

Where many lines are of few texts, hardly any line changes anything. Then ranges of time
with a change are mined whole, and of the others the first line of each text; the rest
follow by joins and counts (``_repeated``).

``distinct`` mode trains on the distinct masked lines in order of first appearance,
which is far fewer rows where lines repeat, and joins the rest back.
"""

from __future__ import annotations

import gc
import hashlib
import re
import unicodedata
from collections import OrderedDict
from collections.abc import Iterator, MutableMapping
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import spaced, template_id
from ..runtime import ship, written

_DIGIT = re.compile(r"[0-9]")
#: Lines of a node from which on they are dealt by its tokens; rows of a routing table that is broadcast.
SHARE = 20_000
BROADCAST_ROWS = 200_000
#: Rounds of mining under a schedule before one task takes all lines, as it does at once up to so many lines that make too many clusters.
ROUNDS = 12
ALONE = 100_000_000
#: Up to so many lines that are left are dealt by their token counts alone.
LEFT = 1_000_000
#: Members of a leaf that are compared one by one; texts whose cluster is remembered; unknown lines of a batch after which all are taken one by one.
FEW = 4
REMEMBERED = 100_000
UNKNOWN = 16
#: Least lines of a block of time, where texts are clusters of their own.
BLOCK = 250_000
#: More lines than that of at most so many texts are mined by ranges of time; lines of a range; how often ranges with a change are looked for.
MANY = 200_000
TEXTS = 10_000
RANGE = 200_000
PASSES = 4


@dataclass(frozen=True)
class Config:
    """``max_clusters`` holds over all token counts; 0 is no bound. Lines are taken whole, unless ``max_tokens`` cuts them."""

    similarity: float = 0.90
    depth: int = 8
    max_children: int = 100
    max_clusters: int = 65_536
    param: str = "<*>"
    max_tokens: int = 0
    referral_floor: float = 0.65
    max_leaf: int = 128

    def __post_init__(self):
        if self.depth < 3:
            raise ValueError("depth below 3")
        if self.max_children == 0:
            raise ValueError("no children")


@lru_cache(100_000)
def numeric(token: str) -> bool:
    """Whether a token has a character of a number category."""
    if token.isascii():
        return bool(_DIGIT.search(token))
    return any(unicodedata.category(c)[0] == "N" for c in token)


@dataclass(slots=True)
class Node:
    children: dict[str, Node] = field(default_factory=dict)
    #: In order of entry, by which equal candidates are told apart.
    members: list[int] = field(default_factory=list)
    #: The members from the least to the most recently used.
    used: OrderedDict[int, None] = field(default_factory=OrderedDict)
    #: Members by (part of the tokens, its words), made once a leaf has more than ``FEW``.
    index: dict[tuple, set[int]] | None = None


@dataclass(slots=True)
class Cluster:
    seq: int
    tokens: list[str]
    first: int
    size: int = 1
    path: tuple[str, ...] = ()
    leaf: Node | None = None
    #: The line that made or last changed the template.
    changed: int = 0
    id: str = ""
    params: int = 0
    #: Whether it was forgotten for a full leaf, not for the table.
    full: bool = False
    #: Of a text that is like no other: its key and its number of tokens, of which ``tokens`` has those that route.
    key: bytes | None = None
    n: int = 0

    def rename(self, param: str) -> None:
        self.params = self.tokens.count(param)
        self.id = "t_" + hashlib.sha256(" ".join(self.tokens).encode()).hexdigest()


class Miner:
    """One table of clusters. Every line, the empty one too, is assigned."""

    def __init__(self, config: Config = Config()):
        self.config = config
        share = Fraction(str(config.similarity))
        self.need, self.of = share.numerator, share.denominator
        self.root = Node()
        #: From the least to the most recently used.
        self.table: OrderedDict[int, Cluster] = OrderedDict()
        self.next = 1
        #: Clusters forgotten since they were last asked for.
        self.forgotten: list[Cluster] = []
        #: Clusters that are a text word by word, below nodes of its own words: it finds them as long as they stay so.
        self.exact: dict[str, Cluster] = {}
        #: Clusters of texts that changed nothing since anything last changed.
        self.same: dict[str, Cluster] = {}
        #: Clusters of texts that are like no other, by key.
        self.lone: dict[bytes, list[Cluster]] = {}

    def reserve(self, n: int, path: list[str], children: int) -> None:
        """Keep the place of so many children of a node, whose lines are mined elsewhere."""
        node = self.root.children.setdefault(str(n), Node())
        for word in path:
            node = node.children.setdefault(word, Node())
        for k in range(children):
            node.children[f"\n{k}"] = Node()

    def _levels(self, n: int) -> int:
        """How many tokens route a line of n tokens."""
        return max(0, min(self.config.depth - 3, n - 1))

    def _leaf(self, n: int, words: list[str]) -> Node | None:
        """Where a line of n tokens looks for its cluster."""
        node = self.root.children.get(str(n))
        for word in words[: self._levels(n)]:
            if node is None:
                return None
            node = node.children.get(word) or node.children.get(self.config.param)
        return node

    def find(self, words: list[str]) -> Cluster | None:
        n = len(words)
        node = self._leaf(n, words)
        if node is None:
            return None
        best, most, wild = None, -1, -1
        table = self.table
        # A line may hold the parameter itself, which is equal to nothing.
        literal = words.count(self.config.param)
        for seq in self._candidates(node, words):
            cluster = table[seq]
            same = sum(map(eq, cluster.tokens, words))
            if literal:
                same -= sum(a == b == self.config.param for a, b in zip(cluster.tokens, words, strict=True))
            if same > most or (same == most and cluster.params > wild):
                best, most, wild = cluster, same, cluster.params
        return best if best and most * self.of >= self.need * n else None

    def _parts(self, words: list[str]) -> list[tuple]:
        """The tokens after those that route, in one part more than may differ, so that of two alike lists one part is equal; without parts that hold the parameter."""
        n = len(words)
        first, parts = self._levels(n), n + (-self.need * n // self.of) + 1
        rest = n - first
        if parts > rest:
            return []
        cut = [first + rest * k // parts for k in range(parts + 1)]
        return [(k, part) for k in range(parts) if self.config.param not in (part := tuple(words[cut[k] : cut[k + 1]]))]

    def _candidates(self, node: Node, words: list[str]) -> list[int]:
        """The members that may be alike enough, in order of entry."""
        if len(node.members) <= FEW or self._levels(len(words)) + 1 + (len(words) + (-self.need * len(words) // self.of)) > len(words):
            return node.members
        if node.index is None:
            node.index = {}
            for seq in node.members:
                for part in self._parts(self.table[seq].tokens):
                    node.index.setdefault(part, set()).add(seq)
        return sorted(set().union(*(node.index.get(part, ()) for part in self._parts(words))))

    def _unlist(self, cluster: Cluster, parts: list[tuple]) -> None:
        index = cluster.leaf.index
        if index is not None:
            for part in parts:
                index[part].discard(cluster.seq)
                if not index[part]:
                    del index[part]

    def _changed(self, cluster: Cluster) -> None:
        """Before a cluster is changed or forgotten."""
        self.same.clear()
        text = " ".join(cluster.tokens)
        if self.exact.get(text) is cluster:
            del self.exact[text]

    @staticmethod
    def _child(children: MutableMapping[str, Node], key: str) -> Node:
        node = children.get(key)
        if node is None:
            node = children[key] = Node()
        return node

    def _place(self, cluster: Cluster, n: int) -> Node:
        """The leaf for a new cluster of n tokens."""
        path = [str(n)]
        node = self._child(self.root.children, path[0])
        param, most = self.config.param, self.config.max_children
        for word in cluster.tokens[: self._levels(n)]:
            kids = node.children
            child = kids.get(word)
            if child is None:
                if len(kids) + (param not in kids) >= most or numeric(word):
                    word = param
                child = self._child(kids, word)
            path.append(word)
            node = child
        node.used[cluster.seq] = None
        cluster.path, cluster.leaf = tuple(path), node
        self.same.clear()
        return node

    def _insert(self, cluster: Cluster) -> None:
        words = cluster.tokens
        node = self._place(cluster, len(words))
        node.members.append(cluster.seq)
        if node.index is not None:
            for part in self._parts(words):
                node.index.setdefault(part, set()).add(cluster.seq)
        if not cluster.params and self.config.param not in cluster.path:
            self.exact[" ".join(words)] = cluster
        self._bound(node)

    def _bound(self, node: Node) -> None:
        """After a cluster came to a leaf."""
        if self.config.max_leaf and len(node.used) > self.config.max_leaf:
            self.forget(next(iter(node.used)), full=True)

    def forget(self, seq: int, full: bool = False) -> None:
        cluster = self.table.pop(seq)
        if cluster.key is None:
            self._changed(cluster)
            self._unlist(cluster, self._parts(cluster.tokens))
            cluster.leaf.members.remove(seq)
        else:
            self.same.clear()
            self._unkey(cluster)
        cluster.full = full
        self.forgotten.append(cluster)
        del cluster.leaf.used[seq]
        if cluster.leaf.used or cluster.leaf.children:
            return
        nodes = [self.root]
        for key in cluster.path:
            nodes.append(nodes[-1].children[key])
        for key, parent, node in zip(reversed(cluster.path), reversed(nodes[:-1]), reversed(nodes[1:]), strict=True):
            if node.used or node.children:
                break
            del parent.children[key]

    def _unkey(self, cluster: Cluster) -> None:
        own = self.lone[cluster.key]
        own.remove(cluster)
        if not own:
            del self.lone[cluster.key]

    def take_lone(self, key: bytes, n: int, words: list[str], line: int = 0) -> Cluster:
        """``train`` for a text of n tokens that only equal texts are like: by its key and the tokens that route it."""
        own = self.lone.get(key)
        if own:
            leaf = self._leaf(n, words)
            for cluster in own:
                if cluster.leaf is leaf:
                    cluster.size += 1
                    self._use(cluster)
                    return cluster
        cluster = Cluster(self.next, words, line, changed=line, key=key, n=n)
        self.next += 1
        self.table[cluster.seq] = cluster
        if own:
            own.append(cluster)
        else:
            self.lone[key] = [cluster]
        self._bound(self._place(cluster, n))
        if self.config.max_clusters and len(self.table) > self.config.max_clusters:
            self.forget(next(iter(self.table)))
        return cluster

    def known(self, text: str) -> Cluster | None:
        """The cluster that a text goes to without a change, if that is known."""
        return self.exact.get(text) or self.same.get(text)

    def take(self, text: str, line: int = 0) -> Cluster:
        """``train`` for the words of a text."""
        cluster = self.known(text)
        if cluster:
            cluster.size += 1
            self._use(cluster)
            return cluster
        cluster = self.train(text.split(" ") if text else [], line)
        if cluster.size > 1 and cluster.changed != line and text not in self.exact:
            if len(self.same) >= REMEMBERED:
                self.same.clear()
            self.same[text] = cluster
        return cluster

    def _use(self, cluster: Cluster) -> None:
        self.table.move_to_end(cluster.seq)
        cluster.leaf.used.move_to_end(cluster.seq)

    def take_known(self, texts: list[str], codes: np.ndarray) -> tuple[list[Cluster], np.ndarray, np.ndarray]:
        """Lines (as places in ``texts``) up to the first that is not known: their clusters, each line's place in these, and sizes."""
        found = [self.known(t) for t in texts]
        unknown = np.array([c is None for c in found], dtype=bool)[codes]
        if unknown.any():
            codes = codes[: int(unknown.argmax())]
        clusters = list({c.seq: c for c in found if c}.values())
        place = {c.seq: k for k, c in enumerate(clusters)}
        at = np.array([place[c.seq] if c else -1 for c in found], dtype=np.int64)[codes]
        counts = np.bincount(at, minlength=len(clusters))
        order = np.argsort(at, kind="stable")
        before = np.empty(len(at), dtype=np.int64)
        before[order] = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        sizes = np.array([c.size for c in clusters], dtype=np.int64)[at] + before + 1 if clusters else before
        last = np.full(len(clusters), -1, dtype=np.int64)
        last[at] = np.arange(len(at))
        for k in np.argsort(last, kind="stable"):
            if last[k] >= 0:
                clusters[k].size += int(counts[k])
                self._use(clusters[k])
        return clusters, at, sizes

    def train(self, words: list[str], line: int = 0) -> Cluster:
        words = words[: self.config.max_tokens or None]
        cluster = self.find(words)
        if cluster:
            param = self.config.param
            moved = [a if a == b else param for a, b in zip(cluster.tokens, words, strict=True)]
            if moved != cluster.tokens:
                self._changed(cluster)
                self._unlist(cluster, list(set(self._parts(cluster.tokens)) - set(self._parts(moved))))
                cluster.tokens = moved
                cluster.changed = line
                cluster.rename(self.config.param)
            cluster.size += 1
            self._use(cluster)
            return cluster
        cluster = Cluster(self.next, list(words), line, changed=line)
        cluster.rename(self.config.param)
        self.next += 1
        self.table[cluster.seq] = cluster
        self._insert(cluster)
        if self.config.max_clusters and len(self.table) > self.config.max_clusters:
            self.forget(next(iter(self.table)))
        return cluster


_FIELDS = "event_id long, n_tokens int, route string, local long, template_id_at_train string, size long, template string, first_event long, until long, full boolean"


_FOLLOWED = "row long, event_id long, n_tokens int, local long, key binary, template_id_at_train string, size long, template string, first_row long, first_event long, until long, full boolean"


def _trainer(config: Config):
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def known(miner: Miner, at: tuple, events: pa.Array, texts: list[str], codes: np.ndarray) -> pa.RecordBatch | None:
        """Lines up to the first that may change something, at once."""
        clusters, k, sizes = miner.take_known(texts, codes)
        if not len(k):
            return None
        k = pa.array(k)
        of = lambda values, kind: pa.array(values, kind).take(k)
        none = lambda kind: pa.nulls(len(k), kind)
        columns = [
            events.slice(0, len(k)), of([len(c.tokens) for c in clusters], pa.int32()), of([at[1]] * len(clusters), pa.string()), of([c.seq for c in clusters], pa.int64()),
            of([c.id for c in clusters], pa.string()), pa.array(sizes), none(pa.string()), of([c.first for c in clusters], pa.int64()), none(pa.int64()), none(pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    def runs(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """A batch cut where (n, route) changes."""
        n, route = b.column(2).to_numpy(), b.column(3).dictionary_encode().indices.to_numpy()
        ends = [*(np.flatnonzero((n[1:] != n[:-1]) | (route[1:] != route[:-1])) + 1).tolist(), len(n)]
        for begin, end in zip([0, *ends], ends, strict=False):
            if end > begin:
                yield b.slice(begin, end - begin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A miner has no cycles, and walks over its many nodes would take as long as mining.
        gc.disable()
        try:
            yield from mined(batches)
        finally:
            gc.enable()

    def mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        miner, at, rows, live = None, None, [], {}

        def ended(clusters, event: int | None = None) -> list[tuple]:
            return [(None, len(c.tokens), at[1], c.seq, None, c.size, " ".join(c.tokens), c.first, event, c.full) for c in clusters]

        def one(event: int, text: str, victim: int | None = None) -> None:
            if victim is None:
                c = miner.take(text, event)
                live[c.first] = c.seq
                # The template where the line made or changed it.
                rows.append((event, len(c.tokens), at[1], c.seq, c.id, c.size, " ".join(c.tokens) if c.changed == event else None, c.first, None, None))
            elif victim in live:
                miner.forget(live[victim])
            if miner.forgotten:
                rows.extend(ended(miner.forgotten, event))
                for c in miner.forgotten:
                    del live[c.first]
                miner.forgotten.clear()

        for b in (r for whole in batches for r in runs(whole)):
            event, text, n, route, victim = b.columns
            key = n[0].as_py(), route[0].as_py()
            if at != key:
                if miner:
                    rows += ended(miner.table.values())
                miner, at, live = Miner(config), key, {}
                path, rest, children = at[1].partition("\n")
                if rest:
                    miner.reserve(at[0] if text[0].as_py() else 0, path.split(" ")[:-1], int(children))
            begin = 0
            coded = text.dictionary_encode()
            if victim.null_count == len(b) and 2 * len(coded.dictionary) <= len(b):
                texts, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
                for _ in range(UNKNOWN):
                    found = known(miner, at, event.slice(begin), texts, codes[begin:])
                    if found:
                        if rows:
                            yield batch(rows)
                            rows.clear()
                        yield found
                        begin += len(found)
                    if begin == len(b):
                        break
                    one(event[begin].as_py(), texts[codes[begin]])
                    begin += 1
                    if begin == len(b):
                        break
            if begin < len(b):
                for row in zip(event.slice(begin).to_pylist(), text.slice(begin).to_pylist(), victim.slice(begin).to_pylist(), strict=True):
                    one(*row)
            if len(rows) >= 5_000:
                yield batch(rows)
                rows.clear()
        if miner:
            rows += ended(miner.table.values())
        if rows:
            yield batch(rows)

    return run


def _follower(config: Config):
    """Mines all lines in order, from (row, event_id, text, key, n, by) rows; a line with a key has no text, and the tokens that route it.

    What has a key comes out without a template and an id, which are those of the text of its line.
    """
    names, types = [f.split()[0] for f in _FOLLOWED.split(", ")], [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        miner, rows, line = Miner(config), [], 0
        # The row and the event of the first line of each cluster in the table.
        first: dict[int, tuple[int, int]] = {}

        def ended(c: Cluster, event: int | None) -> tuple:
            row, made = first.pop(c.seq)
            lone = c.key is not None
            return (None, None, c.n if lone else len(c.tokens), c.seq, c.key, None, c.size, None if lone else " ".join(c.tokens), row, made, event, c.full)

        for b in batches:
            # What is null has no number.
            for row, event, text, key, n, by in zip(*(c.fill_null(0).to_numpy(zero_copy_only=False).tolist() if pa.types.is_integer(c.type) else c.to_numpy(zero_copy_only=False) for c in b.columns), strict=True):
                line += 1
                if key is None:
                    c = miner.take(text, line)
                    made = first.setdefault(c.seq, (row, event))
                    rows.append((row, event, len(c.tokens), c.seq, None, c.id, c.size, " ".join(c.tokens) if c.changed == line else None, made[0], made[1], None, None))
                else:
                    c = miner.take_lone(key, n, by.split(" ") if by else [], line)
                    made = first.setdefault(c.seq, (row, event))
                    rows.append((row, event, n, c.seq, key, None, c.size, None, made[0], made[1], None, None))
                if miner.forgotten:
                    rows.extend(ended(c, event) for c in miner.forgotten)
                    miner.forgotten.clear()
            if len(rows) >= 5_000:
                yield batch(rows)
                rows.clear()
        rows.extend(ended(c, None) for c in miner.table.values())
        if rows:
            yield batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # As in ``_trainer``.
        gc.disable()
        try:
            yield from mined(batches)
        finally:
            gc.enable()

    return run


def _levels(lines: DataFrame, config: Config, share: int) -> list[tuple[DataFrame, DataFrame]]:
    """For each level, its nodes of over ``share`` lines (n, path, own), and the tokens there whose lines are alone (n, path, token).

    ``path`` has the tokens down to the node, each with a space; ``own`` counts its tokens.
    """
    place = F.min(F.struct("at", "event_id")).alias("first")
    open_ = written(lines.groupBy("n", "by").agg(place, F.count(F.lit(1)).alias("lines")).withColumn("path", F.lit("")), "drain-routes")
    found = []
    for level in range(max(0, config.depth - 3)):
        deeper = open_.filter(F.size("by") > level).withColumn("token", F.get("by", F.lit(level)))
        nodes = deeper.groupBy("n", "path").agg(F.sum("lines").alias("lines")).filter(F.col("lines") > share).select("n", "path")
        tokens_ = deeper.groupBy("n", "path", "token").agg(F.min("first").alias("first")).join(nodes, ["n", "path"], "left_semi")
        # Tokens that go to the parameter's child whatever came before.
        wild = (F.col("token") == config.param) | F.col("token").rlike(r"\p{N}")
        shared = tokens_.filter(wild).groupBy("n", "path").agg(F.min("first").alias("shared"))
        rank = F.row_number().over(Window.partitionBy("n", "path").orderBy("first"))
        # One child is kept for the parameter.
        early = tokens_.filter(~wild).withColumn("rank", rank).filter(F.col("rank") < config.max_children)
        own = written(early.join(shared, ["n", "path"], "left").filter("shared is null or first < shared").select("n", "path", "token"), "drain-own")
        nodes = written(nodes.join(own.groupBy("n", "path").agg(F.count(F.lit(1)).alias("own")), ["n", "path"], "left").fillna({"own": 0}), "drain-nodes")
        if nodes.isEmpty():
            break
        found.append((nodes, own))
        open_ = deeper.join(own, ["n", "path", "token"]).withColumn("path", F.concat("path", "token", F.lit(" "))).select(open_.columns)
    return found


def _routed(lines: DataFrame, config: Config, share: int) -> DataFrame:
    """Adds ``n`` (token count) and ``route``: the path of the tokens that a line is alone by; after a line end, how many such the node has that the line shares with others."""
    words = F.split("text", " ")
    rows = lines.withColumns({"n": F.size(words), "by": F.slice(words, F.lit(1), F.least(F.lit(max(0, config.depth - 3)), F.size(words) - 1))})
    out = rows.withColumn("path", F.lit(""))
    for level, (nodes, own) in enumerate(_levels(rows, config, share)):
        hint = F.broadcast if own.count() + nodes.count() <= BROADCAST_ROWS else (lambda x: x)
        out = out.withColumn("token", F.get("by", F.lit(level))).join(hint(nodes), ["n", "path"], "left").join(hint(own.withColumn("alone", F.lit(True))), ["n", "path", "token"], "left")
        shared = F.concat("path", F.lit("\n"), F.col("own").cast("string"))
        out = out.withColumn("path", F.when(F.col("alone"), F.concat("path", "token", F.lit(" "))).when(F.col("own").isNotNull() & F.col("token").isNotNull(), shared).otherwise(F.col("path"))).drop("token", "own", "alone")
    return out.withColumnRenamed("path", "route").drop("by")


def _mined(routed: DataFrame, config: Config, schedule: DataFrame | None = None) -> DataFrame:
    """Lines by (n, route) in order; ``schedule`` (n, event_id, victim) names clusters by first event, forgotten once that line has been taken.

    Lines of which some have a key for their text, as ``_keyed`` gives them, are one table's.
    """
    if "key" in routed.columns:
        dealt = routed.repartition(1).sortWithinPartitions("at", "event_id")
        return written(dealt.select("row", "event_id", "text", "key", "n", "by").mapInArrow(_follower(config), _FOLLOWED), "drain")
    rows = routed.select("event_id", "at", "text", "n", "route", F.lit(None).cast("long").alias("victim"))
    if schedule is not None:
        rows = rows.unionByName(schedule.withColumns({"at": F.col("event_id"), "text": F.lit(""), "route": F.lit("")}))
    dealt = rows.repartition("n", "route").sortWithinPartitions("n", "route", "at", "event_id", F.col("victim").asc_nulls_first())
    return written(dealt.select("event_id", "text", "n", "route", "victim").mapInArrow(_trainer(config), _FIELDS), "drain")


def _ranked(lines: DataFrame) -> DataFrame:
    """Adds ``place``, the rank of a line by (at, event_id): counted within ranges, which are then added up."""
    ranges = written(lines.repartitionByRange("at", "event_id").withColumn("range", F.spark_partition_id()), "drain-ranges")
    within = F.row_number().over(Window.partitionBy("range").orderBy("at", "event_id"))
    # As many rows as there are ranges.
    sizes = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("lines"))
    before = sizes.select("range", (F.sum("lines").over(Window.orderBy("range")) - F.col("lines")).alias("before"))
    return written(ranges.withColumn("within", within).join(F.broadcast(before), "range").withColumn("place", F.col("before") + F.col("within")).drop("range", "before", "within"), "drain-places")


def _alike_parts(words, config: Config):
    """A text's tokens cut in one part more than may differ, each as a number: texts that are alike have one of them in common. None where a text is to be compared with all."""
    share = Fraction(str(config.similarity))
    n = F.size(words)
    count = (n * (share.denominator - share.numerator) / share.denominator).cast("decimal(20,9)")
    count = F.floor(count).cast("int") + 1
    cut = lambda k: F.floor(n.cast("long") * k / count).cast("int")
    part = lambda k: F.xxhash64(n, k, F.slice(words, cut(k) + 1, cut(k + 1) - cut(k)))
    return F.when((count <= n) & ~F.array_contains(words, config.param), F.transform(F.sequence(F.lit(0), count - 1), part))


def _keyed(lines: DataFrame, config: Config) -> DataFrame:
    """(row, event_id, at, text, key, n, by) of lines: texts that no other can be alike to are a key, a count and the tokens that route them, all others a text.

    A cluster's template has no tokens but those of the line that made it, so that a line
    that joins it is as much like that line's text. Two numbers tell texts apart here,
    and of equal parts which are not of different texts only some are compared for nothing.
    """
    words, empty = F.col("words"), F.col("text") == ""
    n = F.when(empty, F.lit(0)).otherwise(F.size(words))
    by = F.when(empty, F.lit("")).otherwise(F.array_join(F.slice(words, F.lit(1), F.least(F.lit(max(0, config.depth - 3)), F.size(words) - 1)), " "))
    cut = lines.withColumn("words", F.split("text", " ")).select("row", "event_id", "at", F.unhex(F.sha2("text", 256)).alias("key"), n.alias("n"), by.alias("by"), _alike_parts(words, config).alias("parts"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    cut = written(cut, "drain-cut")
    each = cut.select("row", "a", "b", F.explode("parts").alias("part"))
    two = each.groupBy("part").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in "ab" for f in (F.min, F.max))).filter("min_a <> max_a OR min_b <> max_b")
    shared = written(two.select("part"), "drain-shared")
    rich = each.join(shared, "part", "left_semi").select("row").distinct().unionByName(cut.filter("parts is null").select("row"))
    rich = written(rich, "drain-rich")
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    whole = lines.join(rich, "row", "left_semi").select("row", "event_id", "at", "text", nothing("binary", "key"), nothing("int", "n"), nothing("string", "by"))
    return whole.unionByName(cut.join(rich, "row", "left_anti").select("row", "event_id", "at", nothing("string", "text"), "key", "n", "by"))


def _together(lines: DataFrame, config: Config, templates: bool) -> tuple[DataFrame, DataFrame]:
    """One table's lines in order, in one task, which takes most of them as a key; ``templates``: also those of lines that made a cluster."""
    out = _mined(_keyed(lines, config), config)
    texts = lines.select(F.col("row").alias("first_row"), F.col("text").alias("own"))
    filled = F.coalesce("template", "own")
    found = out.filter("row is null").join(texts, "first_row").withColumn("template", filled)
    taken = out.filter("row is not null").withColumn("template_id_at_train", F.coalesce("template_id_at_train", F.concat(F.lit("t_"), F.lower(F.hex("key")))))
    if templates:
        own = F.when(F.col("key").isNotNull() & (F.col("row") == F.col("first_row")), F.col("own"))
        taken = taken.join(texts, "first_row").withColumn("template", F.coalesce("template", own))
    made = F.when(F.col("template").isNotNull(), F.col("first_event"))
    columns = lambda df, first: df.select("event_id", "n_tokens", F.lit("").alias("route"), "local", "template_id_at_train", "size", "template", first.alias("first_event"), "until", "full")
    return columns(taken, made), written(columns(found, F.col("first_event")), "drain-clusters")


#: What happens to the table at a line, in this order; a cluster of a line then begins to be idle.
_USED, _MADE, _LEFT, _IDLE = range(4)


def _table(most: int):
    """Follows the table's size through (place, kind, n, first, since, till) rows in order and gives out idle clusters as they are forgotten.

    Holds idle clusters that are still in the table, so at most ``most`` and one.
    """
    names, types = ["n", "first", "since", "till", "event_id"], [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idle: OrderedDict[int, tuple] = OrderedDict()
        size, now, out = 0, None, []

        def shrink() -> None:
            nonlocal size
            while size > most and idle:
                out.append((*idle.popitem(last=False)[1], now))
                size -= 1

        for b in batches:
            for place, kind, n, first, since, till in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if place != now or kind == _IDLE:
                    shrink()
                now = place
                if kind == _IDLE:
                    idle[first] = (n, first, since, till)
                elif kind == _MADE:
                    size += 1
                elif kind == _USED:
                    # Where it was forgotten, the line makes it anew.
                    size += idle.pop(first, None) is None
                elif idle.pop(first, None):
                    size -= 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out.clear()
        shrink()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


def _schedule(out: DataFrame, most: int) -> DataFrame:
    """What one table of ``most`` clusters would forget, told from lines that were mined: (n, event_id, victim)."""
    count = F.greatest("n_tokens", F.lit(1)).alias("n")
    # A cluster that is forgotten for the table was not used by over ``most`` lines, so that only its last use in each block of lines matters.
    uses = out.filter("event_id is not null").groupBy(count, F.col("first_event").alias("first"), F.floor(F.col("event_id") / most).alias("block"))
    uses = uses.agg(F.min("event_id").alias("from"), F.max("event_id").alias("since"))
    till = F.lead("from").over(Window.partitionBy("n", "first").orderBy("block"))
    left = out.filter("event_id is null and full").select(count, F.col("first_event").alias("first"), F.col("until").alias("left"))
    idle = uses.withColumn("till", till).filter(F.col("till").isNull() | (F.col("till") - F.col("since") > most)).join(left, ["n", "first"], "left")
    # Where a leaf forgets a cluster, its last idle time ends.
    idle = written(idle.withColumn("left", F.when(F.col("till").isNull(), F.col("left"))).select("n", "first", "since", "till", "left"), "drain-idle")
    none = F.lit(None).cast("long")
    events = (
        idle.select(F.col("since").alias("place"), F.lit(_IDLE).alias("kind"), "n", "first", "since", "till")
        .unionByName(idle.filter("till is not null").select(F.col("till").alias("place"), F.lit(_USED).alias("kind"), "n", "first", "since", "till"))
        .unionByName(idle.filter("left is not null").select(F.col("left").alias("place"), F.lit(_LEFT).alias("kind"), "n", "first", "since", "till"))
        .unionByName(out.filter("event_id is null").select(F.col("first_event").alias("place"), F.lit(_MADE).alias("kind"), count, F.col("first_event").alias("first"), none.alias("since"), none.alias("till")))
    )
    gone = events.repartition(1).sortWithinPartitions("place", "kind").mapInArrow(_table(most), "n int, first long, since long, till long, event_id long")
    # A cluster that was made anew goes by the line that did.
    anew = F.lag("till").over(Window.partitionBy("n", "first").orderBy("since"))
    return written(gone.select("n", "event_id", F.coalesce(anew, F.col("first")).alias("victim")), "drain-schedule")


def _bounded(lines: DataFrame, config: Config, share: int, rounds: int) -> DataFrame:
    """One table's forgetting over all token counts: counts whose schedule changed are mined again, each in one task, until none does.

    After ``rounds`` rounds one task takes all lines in order, with equal results.
    """
    ranked = _ranked(lines)
    placed = ranked.select(F.col("place").alias("event_id"), F.col("place").alias("at"), "text")
    routed = written(_routed(placed, config, share), "drain-routed")
    # A task forgets for its own table, too: what one task's lines push out, all lines push out no later.
    out, last = _mined(routed, config), None
    for k in range(rounds):
        new = _schedule(out, config.max_clusters)
        moved = new if last is None else new.exceptAll(last).unionByName(last.exceptAll(new))
        counts = written(moved.select("n").distinct(), "drain-moved")
        if counts.isEmpty():
            break
        again = _mined(routed.join(counts, "n", "left_semi").withColumn("route", F.lit("")), config, new.join(counts, "n", "left_semi"))
        stays = out.withColumn("n", F.greatest("n_tokens", F.lit(1))).join(counts, "n", "left_anti").drop("n")
        out, last = written(stays.unionByName(again), "drain-round"), new
    else:
        out = _mined(routed.withColumns({"n": F.lit(0), "route": F.lit("")}), config)
    named = lambda c: ranked.select(F.col("place").alias(c), F.col("event_id").alias(f"{c}_"))
    # Lines need the first event only where they made or changed a template.
    out = out.withColumn("first_event", F.when(F.col("template").isNotNull(), F.col("first_event")))
    for c in ("event_id", "first_event", "until"):
        out = out.join(named(c), c, "left").drop(c).withColumnRenamed(f"{c}_", c)
    return written(out, "drain-bounded")


def _apart(lines: DataFrame, config: Config) -> bool:
    """Whether each text is bound to be a cluster of its own: only equal lines are alike, and no node or leaf can fill up."""
    if Fraction(str(config.similarity)) != 1 or config.max_leaf:
        return False
    param = F.lit(config.param)
    texts = written(lines.select("text").distinct().withColumn("by", F.split("text", " ")), "drain-texts")
    if not texts.filter(F.array_contains("by", param)).isEmpty():
        return False
    # Tokens of a number category go to the parameter's child and take no room.
    at = F.least(F.lit(max(0, config.depth - 3)), F.size("by") - 1)
    kids = texts.withColumn("n", F.size("by")).select("n", "by", F.explode(F.sequence(F.lit(0), at - 1)).alias("level"), at.alias("at")).filter("level >= 0 and level < at")
    key = F.when(F.get("by", F.col("level")).rlike(r"\p{N}"), param).otherwise(F.get("by", F.col("level")))
    path = F.transform(F.slice("by", F.lit(1), F.col("level")), lambda w: F.when(w.rlike(r"\p{N}"), param).otherwise(w))
    kids = kids.select("n", path.alias("path"), key.alias("key")).distinct().filter(F.col("key") != param)
    return kids.groupBy("n", "path").count().filter(F.col("count") >= config.max_children).isEmpty()


_USES = "place long, event_id long, text string, kind int"


def _recent(most: int):
    """Follows which ``most`` texts were used last through (block, at, place, event_id, text) rows in order and gives out lines, as ``_USED`` or ``_MADE`` with their texts, and a text that a line pushes out as ``_LEFT``.

    Rows without a place are texts used before the block.
    """
    names, types = ["place", "event_id", "text", "kind"], [pa.int64(), pa.int64(), pa.string(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: OrderedDict[str, None] = OrderedDict()
        now = None
        for b in batches:
            out = []
            for block, _, place, event, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if block != now:
                    now = block
                    table.clear()
                known = text in table
                table[text] = None
                if known:
                    table.move_to_end(text)
                if place is not None:
                    out.append((place, event, text, _USED if known else _MADE))
                    if len(table) > most:
                        out.append((place, event, table.popitem(last=False)[0], _LEFT))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


def _before_blocks(most: int):
    """The ``most`` texts used last before each block, from (block, text, used) rows in order of use."""
    names, types = ["block", "text", "used"], [pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: OrderedDict[str, int] = OrderedDict()
        now = None
        for b in batches:
            for block, text, used in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is not None and block != now:
                    while len(table) > most:
                        table.popitem(last=False)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([block] * len(table), list(table), list(table.values())), types, strict=True)], names)
                now = block
                table[text] = used
                table.move_to_end(text)

    return run


def _separate(lines: DataFrame, config: Config, least: int) -> DataFrame:
    """What a table that fills up gives where each text is a cluster of its own.

    It then holds the ``max_clusters`` texts that were used last, whatever came before.
    So lines are dealt by blocks of time, each of which begins with the texts used last
    before it; these follow from as many texts of each block, which are few.
    """
    most = config.max_clusters
    ranked = _ranked(lines).withColumn("block", F.floor((F.col("place") - 1) / max(least, 4 * most)))
    by_use = Window.partitionBy("block").orderBy(F.desc("used"))
    last = ranked.groupBy("block", "text").agg(F.max("place").alias("used")).withColumn("r", F.row_number().over(by_use)).filter(F.col("r") <= most)
    seeds = last.select("block", "text", "used").repartition(1).sortWithinPartitions("used").mapInArrow(_before_blocks(most), "block long, text string, used long")
    none = F.lit(None).cast("long")
    rows = ranked.select("block", F.col("place").alias("at"), "place", "event_id", "text").unionByName(seeds.select("block", F.col("used").alias("at"), none.alias("place"), none.alias("event_id"), "text"))
    dealt = rows.repartition("block").sortWithinPartitions("block", "at")
    uses = dealt.mapInArrow(_recent(most), _USES)
    so_far = Window.partitionBy("text").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = F.col("kind") == _MADE
    lived = written(uses.withColumn("local", F.max(F.when(made, F.col("place"))).over(so_far)), "drain-uses")
    n = F.when(F.col("text") == "", F.lit(0)).otherwise(F.size(F.split("text", " "))).cast("int").alias("n_tokens")
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    size = F.row_number().over(Window.partitionBy("text", "local").orderBy("place")).cast("long").alias("size")
    taken = lived.filter(F.col("kind") != _LEFT).select(
        "event_id", n, F.lit("").alias("route"), "local", template_id(F.col("text")).alias("template_id_at_train"), size, F.when(made, F.col("text")).alias("template"),
        F.when(made, F.col("event_id")).alias("first_event"), nothing("long", "until"), nothing("boolean", "full"),
    )
    left = F.col("kind") == _LEFT
    ended = lived.groupBy("text", "local").agg(F.count_if(~left).alias("size"), F.max(F.when(made, F.col("event_id"))).alias("first_event"), F.max(F.when(left, F.col("event_id"))).alias("until"))
    clusters = ended.select(nothing("long", "event_id"), n, F.lit("").alias("route"), "local", nothing("string", "template_id_at_train"), "size", F.col("text").alias("template"), "first_event", "until", F.lit(False).alias("full"))
    return taken.unionByName(clusters)


_CLUSTER = ["n_tokens", "route", "local"]


def _range_of(place):
    """Rows that are numbered by partition have the partition in the upper bits."""
    return F.shiftright(place, 33)


def _repeated(lines: DataFrame, config: Config, share: int, ranges: int) -> tuple[DataFrame, DataFrame] | None:
    """What lines of few texts give, as ``_trained`` does; nothing where a cluster is forgotten or too many ranges have a change.

    As long as no cluster is made, changed or forgotten, a text that changed nothing
    goes where it went before. So it is enough to mine ranges of time with a change
    whole, and of each other the first line of each text, if that shows no change in
    another range; else that range is taken whole, too, and so on.
    """
    texts = written(lines.select("text").distinct().withColumn("code", F.monotonically_increasing_id()), "drain-texts")
    coded = lines.join(F.broadcast(texts), "text").select("event_id", "at", "code")
    in_order = coded.repartitionByRange(ranges, "at", "event_id").sortWithinPartitions("at", "event_id")
    placed = written(in_order.select("event_id", "code", F.monotonically_increasing_id().alias("place")).withColumn("range", _range_of("place")), "drain-places")
    firsts = written(placed.groupBy("range", "code").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("lines")), "drain-firsts")
    # New texts come in the first range for certain.
    whole = {0}
    for _ in range(PASSES):
        taken_whole = F.col("range").isin(sorted(whole))
        kept = placed.filter(taken_whole).select("place", "code").unionByName(firsts.filter(~taken_whole).select("place", "code"))
        kept = written(kept.join(F.broadcast(texts), "code").select(F.col("place").alias("event_id"), F.col("place").alias("at"), "text"), "drain-kept")
        # As few lines as are left are dealt by their token counts alone.
        by_count = kept.withColumns({"n": F.size(F.split("text", " ")), "route": F.lit("")})
        out = _mined(by_count if kept.count() <= LEFT else _routed(kept, config, share), config)
        if not out.filter("event_id is null and until is not null").isEmpty():
            return None
        changed = {r[0] for r in out.filter("event_id is not null and template is not null").select(_range_of("event_id")).distinct().collect()}
        if changed <= whole:
            break
        whole |= changed
        if 2 * len(whole) > ranges:
            return None
    else:
        return None
    mined = out.filter("event_id is not null").withColumnRenamed("event_id", "place").withColumn("range", _range_of("place"))
    names = placed.filter(taken_whole).select(F.col("place").alias("first_event"), F.col("event_id").alias("first_event_"))
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    # Files of numbered lines are small beside what they hold, so that Spark would rather broadcast lines than what they are joined to.
    moved = lambda df: df.hint("merge")
    # Each text's cluster in a range without a change, and each cluster's lines in a range and before it.
    where = firsts.filter(~taken_whole).join(moved(mined.select("place", *_CLUSTER, "template_id_at_train")), "place").drop("place")
    where = written(where, "drain-where")
    parts = mined.filter(taken_whole).select("range", *_CLUSTER, F.lit(1).cast("long").alias("lines")).unionByName(where.select("range", *_CLUSTER, "lines"))
    earlier = Window.partitionBy(*_CLUSTER).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.groupBy("range", *_CLUSTER).agg(F.sum("lines").alias("lines"))
    parts = written(parts.withColumn("before", F.coalesce(F.sum("lines").over(earlier), F.lit(0))), "drain-parts")
    before = parts.drop("lines")
    own = mined.filter(taken_whole).select("place", "range", *_CLUSTER, "template_id_at_train", "template", "first_event").join(moved(names), "first_event", "left")
    own = own.join(before, ["range", *_CLUSTER]).withColumn("first_event", F.when(F.col("template").isNotNull(), F.col("first_event_"))).drop("first_event_", "range")
    own = placed.filter(taken_whole).select("event_id", "place", "range").join(moved(written(own, "drain-own-lines")), "place")
    hint = F.broadcast if where.count() <= BROADCAST_ROWS else moved
    same = placed.filter(~taken_whole).join(hint(where.join(before, ["range", *_CLUSTER]).drop("lines")), ["range", "code"]).select(
        "event_id", "place", "range", *_CLUSTER, "template_id_at_train", "before", nothing("string", "template"), nothing("long", "first_event")
    )
    size = F.col("before") + F.row_number().over(Window.partitionBy("range", *_CLUSTER).orderBy("place"))
    assigned = own.unionByName(same).withColumn("size", size)
    assigned = assigned.select("event_id", *_CLUSTER, "template_id_at_train", "size", "template", "first_event", nothing("long", "until"), nothing("boolean", "full"))
    sizes = parts.groupBy(*_CLUSTER).agg(F.sum("lines").alias("size"))
    clusters = out.filter("event_id is null").select(*_CLUSTER, "template", "first_event").join(sizes, _CLUSTER).join(moved(names), "first_event")
    clusters = clusters.select(
        nothing("long", "event_id"), *_CLUSTER, nothing("string", "template_id_at_train"), "size", "template", F.col("first_event_").alias("first_event"), nothing("long", "until"), nothing("boolean", "full")
    )
    return assigned, written(clusters, "drain-clusters")


def _trained(lines: DataFrame, config: Config, share: int, rounds: int, alone: int, templates: bool = False) -> tuple[DataFrame, DataFrame]:
    """Assignments, and each cluster once, of (event_id, at, text, row) rows, of which ``row`` is a number of its own; what is mined is written, so that it is done once. ``templates``: lines that made a cluster have its template for certain."""
    ship(lines.sparkSession)
    count, texts = lines.agg(F.count(F.lit(1)), F.approx_count_distinct("text")).first()
    fits = not config.max_clusters or texts <= config.max_clusters
    if fits and texts <= TEXTS and count > min(alone, MANY):
        found = _repeated(lines, config, share, max(lines.sparkSession.sparkContext.defaultParallelism, -(-count // RANGE)))
        if found:
            return found
    few, out = count <= alone, None
    if config.max_clusters and texts > config.max_clusters:
        if count > min(alone, BLOCK) and _apart(lines, config):
            out = written(_separate(lines, config, BLOCK), "drain-separate")
        elif few:
            # So many texts are likely to make too many clusters; if they don't, results are the same.
            return _together(lines, config, templates)
    if out is None:
        out = _mined(_routed(lines, config, share), config)
        if config.max_clusters and out.filter("event_id is null").count() > config.max_clusters:
            if few:
                return _together(lines, config, templates)
            out = _bounded(lines, config, share, rounds)
    return out.filter("event_id is not null"), out.filter("event_id is null")


def _texts(df: DataFrame, config: Config, template_col: str) -> DataFrame:
    text = spaced(F.coalesce(F.col(template_col), F.lit("")), config.max_tokens).alias("text")
    return written(df.select("event_id", F.col("received_at").alias("at"), text, F.monotonically_increasing_id().alias("row")), "drain-lines")


def _numbered(found: DataFrame) -> DataFrame:
    """Adds ``seq`` from 1 in order of first event; many clusters are counted within ranges, which are then added up."""
    if found.count() <= BROADCAST_ROWS:
        return found.withColumn("seq", F.row_number().over(Window.orderBy("first_event", "n_tokens")).cast("long"))
    placed = found.repartitionByRange("first_event", "n_tokens").sortWithinPartitions("first_event", "n_tokens")
    placed = written(placed.withColumn("place", F.monotonically_increasing_id()), "drain-numbered").withColumn("range", _range_of("place"))
    # As many rows as there are ranges.
    sizes = placed.groupBy("range").agg(F.count(F.lit(1)).alias("clusters"))
    before = sizes.select("range", (F.sum("clusters").over(Window.orderBy("range")) - F.col("clusters")).alias("before"))
    seq = F.col("before") + F.col("place") - F.shiftleft(F.col("range"), 33) + 1
    return placed.join(F.broadcast(before), "range").withColumn("seq", seq).drop("range", "place", "before")


def versions(df: DataFrame, config: Config = Config(), *, template_col: str = "template", share: int = SHARE, rounds: int = ROUNDS, alone: int = ALONE) -> DataFrame:
    """Every template that a cluster had: (first_event, template, template_id, since, until), the latter as (at, event_id).

    ``first_event`` names the cluster, ``since`` is the line that made the template, and
    ``until`` the one that changed it or for which the cluster was forgotten; null where
    it stayed. Rows and order are as ``assign`` has them; event ids must differ.
    """
    rows = _texts(df, config, template_col)
    taken, found = _trained(rows, config, share, rounds, alone, templates=True)
    places = rows.select("event_id", F.struct("at", "event_id").alias("since"))
    made = taken.filter("template is not null").select("event_id", "first_event", "template").join(places, "event_id")
    gone = found.filter("until is not null").select("first_event", F.col("until").alias("event_id"))
    gone = gone.join(places.withColumnRenamed("since", "gone"), "event_id").select("first_event", "gone")
    until = F.coalesce(F.lead("since").over(Window.partitionBy("first_event").orderBy("since")), F.col("gone"))
    return made.join(gone, "first_event", "left").select("first_event", "template", template_id(F.col("template")).alias("template_id"), "since", until.alias("until"))


def assign(df: DataFrame, config: Config = Config(), *, mode: str = "exact", template_col: str = "template", share: int = SHARE, rounds: int = ROUNDS, alone: int = ALONE) -> tuple[DataFrame, DataFrame]:
    """(assignments, clusters) of rows with event_id, received_at and a masked line.

    Assignments have event_id, seq, template_id_at_train, size (then), and
    template_id_final. Clusters have seq (in order of first event), template,
    template_id, n_tokens, size and first_event; only their list is numbered in one
    task. A null line counts as empty; an empty table gives no rows. Nodes of over
    ``share`` lines are dealt by their tokens. ``rounds`` bounds how often lines are
    mined under a schedule of what a full table forgets, which is not needed for up to
    ``alone`` lines; results hang on neither.
    """
    rows = _texts(df, config, template_col)
    if mode == "distinct":
        first = rows.groupBy("text").agg(F.min(F.struct("at", "event_id")).alias("f"), F.count(F.lit(1)).alias("n"))
        first = written(first.withColumn("row", F.monotonically_increasing_id()), "drain-distinct")
        lines, found = _trained(first.select("f.event_id", "f.at", "text", "row"), config, share, rounds, alone)
    elif mode == "exact":
        lines, found = _trained(rows, config, share, rounds, alone)
    else:
        raise ValueError(mode)
    place = _CLUSTER
    found = found.select(*place, "template", "size", "first_event")
    lines = lines.drop("template", "first_event", "until", "full")
    if mode == "distinct":
        trained = lines.join(first.select(F.col("f.event_id").alias("event_id"), "text", "n"), "event_id")
        sizes = trained.groupBy(*place).agg(F.sum("n").alias("size"))
        found = found.drop("size").join(sizes, place)
        lines = rows.select("event_id", "text").join(trained.drop("event_id"), "text").drop("text", "n")
    clusters = _numbered(found).select(
        "seq", "template", template_id(F.col("template")).alias("template_id"),
        "n_tokens", "size", "first_event", "route", "local",
    )
    names = clusters.select(*place, "seq", F.col("template_id").alias("template_id_final"))
    # A cluster may have most lines, which one task would take by a join that moves them.
    hint = F.broadcast if found.count() <= BROADCAST_ROWS else (lambda x: x)
    assignments = lines.join(hint(names), place).select("event_id", "seq", "template_id_at_train", "size", "template_id_final")
    return assignments, clusters.drop("route", "local")


def similarity(cluster_tokens, line_tokens, param: str = "<*>"):
    """Equal tokens over all, parameters not equal to anything; two empty lines are alike."""
    same = F.aggregate(
        F.zip_with(cluster_tokens, line_tokens, lambda a, b: ((a == b) & (a != param)).cast("int")), F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0))
    )
    return F.when(F.size(cluster_tokens) == 0, F.lit(1.0)).otherwise(same / F.size(cluster_tokens))


def generalise(cluster_tokens, line_tokens, param: str = "<*>"):
    """Differing places become the parameter."""
    return F.zip_with(cluster_tokens, line_tokens, lambda a, b: F.when(a == b, a).otherwise(F.lit(param)))
