"""Sparse logistic regression by follow-the-regularised-leader updates, in parallel.

Labelled rows are dealt to a fixed number of shards. In each round every shard learns
from its rows as they stream by, and the shards' weights are averaged; the next round
starts from there. A task holds one model, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .runtime import written

#: From a text to the features of it: hashes and values; each hash once.
Features = Callable[[list[str | None]], list[tuple[np.ndarray, np.ndarray]]]


@dataclass(frozen=True)
class Settings:
    """``most_rows``: about how many labelled rows are learnt from, drawn by a hash of the id.

    With ``screen``, only features whose share of label 1 is that many standard errors
    above the share among all rows are learnt from, as marks of label 1; their values in a row are then scaled
    to the length ``scale``. A given ``bias`` is not learnt.
    """

    bits: int = 20
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.2
    l2: float = 0.01
    shards: int = 4
    rounds: int = 2
    most_rows: int = 12_000
    screen: float = 0.0
    scale: float = 4.0
    bias: float | None = None


class Slots:
    """Where features' numbers are kept: 2**bits slots by the upper bits of the hash.

    A slot stands for the hash that the majority of those seen have.
    """

    def __init__(self, bits: int):
        self.bits, self.size = bits, 1 << bits
        self.key = np.zeros(self.size, np.uint64)
        self.votes = np.zeros(self.size, np.int16)

    def of(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def vote(self, keys: np.ndarray) -> np.ndarray:
        slot = self.of(keys)
        votes = self.votes[slot] + np.where(self.key[slot] == keys, 1, -1)
        self.key[slot] = np.where(votes < 0, keys, self.key[slot])
        self.votes[slot] = np.minimum(np.abs(votes), 30_000)
        return slot


class Known:
    """A place for each of a sorted set of hashes, which alone come."""

    def __init__(self, keys: np.ndarray):
        self.key, self.size = keys, len(keys)

    def of(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.key, keys)

    vote = of


class Learner:
    def __init__(self, s: Settings, start: Model | None = None, slots: Slots | Known | None = None):
        self.s, self.slots = s, slots or Slots(s.bits)
        self.z, self.n = np.zeros(self.slots.size), np.zeros(self.slots.size)
        self.bias = s.bias or 0.0
        self.bias_n = 0.0
        if start is not None:
            slot = self.slots.vote(start.keys)
            self.n[slot] = start.squares
            # z that gives back the weights.
            self.z[slot] = -start.weights * ((s.beta + np.sqrt(start.squares)) / s.alpha + s.l2) - np.sign(start.weights) * s.l1
            self.bias, self.bias_n = start.bias, start.bias_n

    @property
    def key(self) -> np.ndarray:
        return self.slots.key

    def weights(self, slot: np.ndarray | slice) -> np.ndarray:
        z, s = self.z[slot], self.s
        return np.where(np.abs(z) <= s.l1, 0.0, (np.sign(z) * s.l1 - z) / ((s.beta + np.sqrt(self.n[slot])) / s.alpha + s.l2))

    def learn(self, keys: np.ndarray, values: np.ndarray, label: int) -> None:
        s = self.s
        slot = self.slots.vote(keys)
        w = self.weights(slot)
        p = 1 / (1 + np.exp(-np.clip(w @ values + self.bias, -35, 35)))
        g = (p - label) * values
        n = self.n[slot]
        self.z[slot] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / s.alpha * w
        self.n[slot] += g * g
        if s.bias is None:
            self.bias_n += (p - label) ** 2
            self.bias -= s.alpha * (p - label) / (s.beta + np.sqrt(self.bias_n))


@dataclass
class Model:
    """Weights by the 64-bit hash of a feature, sorted by hash."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    squares: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    bias_n: float = 0.0

    def slots(self, bits: int) -> np.ndarray:
        return (self.keys >> np.uint64(64 - bits)).astype(np.int64)

    def filter_table(self) -> np.ndarray:
        """Whether any key has these upper 20 bits: most features need no search."""
        table = np.zeros(1 << 20, bool)
        table[self.slots(20)] = True
        return table

    def find(self, keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places among ``keys``, places among the model's) of the keys that have weights."""
        at = np.flatnonzero(table[(keys >> np.uint64(44)).astype(np.int64)])
        if not len(at):
            return at, at
        place = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
        same = self.keys[place] == keys[at]
        return at[same], place[same]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def sampled(labels: DataFrame, most: int) -> DataFrame:
    """About ``most`` of the rows of (id, label), by a hash of the id; all if there are no more."""
    n = labels.count()
    if n <= most:
        return labels
    return labels.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * most / n))


def train(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label: Column, features: Features, s: Settings) -> Model:
    """A model of ``label`` (0 or 1) from the rows of ``labels``, matched by id.

    Rows with a null id, label or no text row are left out. Without any labelled row
    the model is empty and scores one half.
    """
    known = labels.select(labels[id_col].alias("id"), label.cast("int").alias("label")).dropna().groupBy("id").agg(F.min("label").alias("label"))
    known = sampled(known, s.most_rows)
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text")).join(F.broadcast(known), "id").select("label", "text", F.pmod(F.xxhash64("id"), F.lit(s.shards)).alias("shard"))
    rows = rows.repartition(s.shards, "shard").sortWithinPartitions("shard", F.xxhash64("text"))
    examples, kept = _read(features), None
    if s.screen:
        kept = _screened(rows.mapInArrow(_count(features, s), "key long, n long, ones long"), s)
        rows = written(rows.mapInArrow(_only(features, kept, s), "label int, shard long, keys array<long>, values array<double>"), "ftrl-features")
        rows = rows.repartition(s.shards, "shard").sortWithinPartitions("shard", F.xxhash64("keys"))
        examples = _ready
    model = None
    for _ in range(s.rounds):
        found = rows.mapInArrow(_shard(examples, s, model, kept), "shard long, rows long, key long, weight double, square double").toPandas()
        model = _average(found, s)
    return model


def _read(features: Features) -> Callable:
    """(label, shard, keys, values) of rows of (label, text, shard)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                c = b.slice(at, 256)
                for label, (keys, values), shard in zip(c.column(0).to_pylist(), features(c.column(1).to_pylist()), c.column(2).to_pylist(), strict=True):
                    yield label, shard, keys, values

    return run


def _ready(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for b in batches:
        for label, shard, keys, values in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            yield label, shard, np.array(keys, np.int64).view(np.uint64), np.array(values)


def _count(features: Features, s: Settings) -> Callable:
    """In how many rows, and rows of label 1, each feature is; key 0 counts the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots(s.bits)
        n, ones = np.zeros(slots.size, np.int32), np.zeros(slots.size, np.int32)
        total = np.zeros(2, np.int64)
        for label, _, keys, _ in _read(features)(batches):
            slot = slots.vote(keys)
            n[slot] += 1
            ones[slot] += label
            total += 1, label
        yield pa.RecordBatch.from_pydict({"key": pa.array(np.zeros(1, np.int64)), "n": pa.array(total[:1]), "ones": pa.array(total[1:])})
        seen = np.flatnonzero(n)
        for k in range(0, len(seen), 1 << 16):
            at = seen[k : k + (1 << 16)]
            columns = {"key": slots.key[at].view(np.int64), "n": n[at].astype(np.int64), "ones": ones[at].astype(np.int64)}
            yield pa.RecordBatch.from_pydict({c: pa.array(v) for c, v in columns.items()})
        del slots, n, ones, seen
        tv.trim()

    return run


def _screened(counts: DataFrame, s: Settings) -> np.ndarray:
    """The features in three rows or more that are marks of label 1."""
    sums = written(counts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")), "ftrl-counts")
    whole = sums.filter("key = 0").first()
    share = whole["ones"] / whole["n"] if whole and whole["n"] else 0.0
    above = (F.col("ones") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share)) + 1e-9)
    kept = sums.filter((F.col("key") != 0) & (F.col("n") >= 3) & (above >= s.screen)).select("key").toPandas()["key"]
    return np.sort(kept.to_numpy(np.int64).view(np.uint64))


def _only(features: Features, kept: np.ndarray, s: Settings) -> Callable:
    model = Model(kept)
    table = model.filter_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for label, shard, keys, values in _read(features)(batches):
            own, _ = model.find(keys, table)
            length = np.sqrt((values[own] ** 2).sum())
            rows.append((label, shard, keys[own].view(np.int64), values[own] * (s.scale / max(length, 1e-9))))
            if len(rows) == 1024:
                yield _rows(rows)
                rows = []
        if rows:
            yield _rows(rows)
        tv.trim()

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    label, shard, keys, values = zip(*rows, strict=True)
    arrays = [pa.array(label, pa.int32()), pa.array(shard, pa.int64()), pa.array(list(keys), pa.list_(pa.int64())), pa.array(list(values), pa.list_(pa.float64()))]
    return pa.RecordBatch.from_arrays(arrays, ["label", "shard", "keys", "values"])


def _shard(examples: Callable, s: Settings, start: Model | None, kept: np.ndarray | None) -> Callable:
    """A model for each shard; the rows come by shard, so that one is held at a time."""

    def weights(shard: int, learner: Learner, rows: int) -> pa.RecordBatch:
        w = learner.weights(slice(None))
        at = np.flatnonzero(w)
        # The bias goes first, under key 0.
        key = np.r_[np.zeros(1, np.uint64), learner.key[at]].view(np.int64)
        columns = {"shard": np.full(len(key), shard), "rows": np.full(len(key), rows), "key": key, "weight": np.r_[learner.bias, w[at]], "square": np.r_[learner.bias_n, learner.n[at]]}
        return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, own, n = None, None, 0
        for label, shard, keys, values in examples(batches):
            if shard != own:
                if learner:
                    yield weights(own, learner, n)
                learner, own, n = Learner(s, start, None if kept is None else Known(kept)), shard, 0
            learner.learn(keys, values, label)
            n += 1
        if learner:
            yield weights(own, learner, n)

    return run


def _average(found, s: Settings) -> Model:
    """The mean of the shards' weights, each by its number of rows."""
    total = found.groupby("shard")["rows"].first().sum()
    if not total:
        return Model()
    share = found["rows"] / total
    means = found.assign(weight=found["weight"] * share, square=found["square"] * share).groupby("key")[["weight", "square"]].sum()
    bias, bias_n = means.loc[0]
    means = means.drop(0)
    keys = means.index.to_numpy().view(np.uint64)
    order = np.argsort(keys)
    model = Model(keys[order], means["weight"].to_numpy()[order], means["square"].to_numpy()[order], float(bias), float(bias_n))
    # Keys that share a slot cannot both go on; the heavier one does.
    _, first = np.unique(model.slots(s.bits)[by := np.argsort(-np.abs(model.weights), kind="stable")], return_index=True)
    keep = np.sort(by[first])
    return Model(model.keys[keep], model.weights[keep], model.squares[keep], model.bias, model.bias_n)
