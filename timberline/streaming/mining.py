"""Template mining by keyed state whose entries are tree nodes, clusters and held rows.

A line reads the nodes on its path and the clusters of its leaf, and changes few of them.
So what a batch writes grows with its lines, not with the tree or the table. The order of
use is a list that is linked through the clusters' entries.
"""

from __future__ import annotations

import pickle
from collections import OrderedDict
from collections.abc import Iterator, MutableMapping

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.drain import UNKNOWN, Cluster, Config, Miner, Node

ASSIGNED = "event_id long, n_tokens int, local long, template_id_at_train string, size long"
_COLUMNS = [f.split()[0] for f in ASSIGNED.split(", ")]
#: Rows of an entry of held rows, those that are sorted before they are cut into entries, and those that are mined at once.
CHUNK = 10_000
SORTED = 500_000
BLOCK = 100_000
#: Entries after which what was read is written and let go.
FLUSH = 20_000


class Entries:
    """Entries of a map state, read once and written where they changed; ``None`` is no entry."""

    def __init__(self, state):
        self.state = state
        self.before: dict = {}
        self.writes = 0

    def read(self, key) -> tuple | None:
        if key not in self.before:
            self.before[key] = tuple(self.state.getValue((key,))) if self.state.containsKey((key,)) else None
        return self.before[key]

    def write(self, key, now: tuple | None) -> None:
        if now == self.read(key):
            return
        self.writes += 1
        if now is None:
            self.state.removeKey((key,))
        else:
            self.state.updateValue((key,), now)


class Children(MutableMapping):
    """A node's children, of which only those asked for are read."""

    def __init__(self, tree: Tree, path: str, names: list[str]):
        self.tree, self.path = tree, path
        self.names = dict.fromkeys(names)

    def at(self, word: str) -> str:
        return f"{self.path} {word}" if self.path else word

    def __getitem__(self, word: str) -> Node:
        if word not in self.names:
            raise KeyError(word)
        return self.tree.node(self.at(word))

    def __setitem__(self, word: str, node: Node) -> None:
        self.names[word] = None
        node.children = Children(self.tree, self.at(word), [])
        self.tree.nodes[self.at(word)] = node

    def __delitem__(self, word: str) -> None:
        del self.names[word]
        self.tree.nodes[self.at(word)] = None

    def __contains__(self, word: object) -> bool:
        return word in self.names

    def __iter__(self) -> Iterator[str]:
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)


def _numbers(text: str) -> list[int]:
    return [int(x) for x in text.split(",")] if text else []


class Tree:
    """The nodes that were read, by path."""

    def __init__(self, entries: Entries):
        self.entries = entries
        self.nodes: dict[str, Node | None] = {}

    def node(self, path: str) -> Node:
        found = self.nodes.get(path)
        if found is None:
            names, members, used = self.entries.read(path) or ("", "", "")
            found = Node(Children(self, path, names.split(" ") if names else []), _numbers(members), OrderedDict.fromkeys(_numbers(used)))
            self.nodes[path] = found
        return found

    def flush(self) -> None:
        for path, node in self.nodes.items():
            now = node and (" ".join(node.children), ",".join(map(str, node.members)), ",".join(map(str, node.used)))
            self.entries.write(path, now if node and any(now) else None)
        self.nodes.clear()
        self.entries.before.clear()


class Table:
    """The clusters from the least to the most recently used, of which those asked for are read."""

    def __init__(self, entries: Entries, tree: Tree, param: str, live: int, oldest: int, newest: int):
        self.entries, self.tree, self.param = entries, tree, param
        self.live, self.oldest, self.newest = live, oldest, newest
        self.clusters: dict[int, Cluster | None] = {}
        #: The seqs of the clusters used before and after one; zero is none.
        self.links: dict[int, list[int]] = {}

    def __getitem__(self, seq: int) -> Cluster:
        found = self.clusters.get(seq)
        if found is None:
            text, first, size, changed, path, older, newer = self.entries.read(seq)
            found = Cluster(seq, text.split(" ") if text else [], first, size, tuple(path.split(" ")), self.tree.node(path), changed)
            found.rename(self.param)
            self.clusters[seq], self.links[seq] = found, [older, newer]
        return found

    def __len__(self) -> int:
        return self.live

    def __iter__(self) -> Iterator[int]:
        seq = self.oldest
        while seq:
            yield seq
            seq = self._link(seq)[1]

    def _link(self, seq: int) -> list[int]:
        self[seq]
        return self.links[seq]

    def _append(self, seq: int) -> None:
        self.links[seq] = [self.newest, 0]
        if self.newest:
            self._link(self.newest)[1] = seq
        self.newest = seq
        self.oldest = self.oldest or seq

    def _unlink(self, seq: int) -> None:
        older, newer = self._link(seq)
        if older:
            self._link(older)[1] = newer
        else:
            self.oldest = newer
        if newer:
            self._link(newer)[0] = older
        else:
            self.newest = older

    def __setitem__(self, seq: int, cluster: Cluster) -> None:
        self.clusters[seq] = cluster
        self._append(seq)
        self.live += 1

    def move_to_end(self, seq: int) -> None:
        if seq != self.newest:
            self._unlink(seq)
            self._append(seq)

    def pop(self, seq: int) -> Cluster:
        cluster = self[seq]
        self._unlink(seq)
        self.clusters[seq] = None
        self.live -= 1
        return cluster

    def flush(self) -> None:
        for seq, c in self.clusters.items():
            self.entries.write(seq, c and (" ".join(c.tokens), c.first, c.size, c.changed, " ".join(c.path), *self.links[seq]))
        self.clusters.clear()
        self.links.clear()
        self.entries.before.clear()


class StoredMiner(Miner):
    """A miner over two map states and what is known of them as a whole: the next seq, clusters, and the first and last in use."""

    def __init__(self, config: Config, nodes, clusters, known: tuple | None = None):
        super().__init__(config)
        following, live, oldest, newest = known or (1, 0, 0, 0)
        self.tree = Tree(Entries(nodes))
        self.table = Table(Entries(clusters), self.tree, config.param, live, oldest, newest)
        self.next = following
        self.root = self.tree.node("")

    def flush(self) -> tuple[int, int, int, int]:
        """Write what changed and let go of what was read."""
        self.table.flush()
        self.tree.flush()
        self.root = self.tree.node("")
        self.forgotten.clear()
        self.exact.clear()
        self.same.clear()
        return self.next, self.table.live, self.table.oldest, self.table.newest


    def full(self) -> bool:
        return len(self.table.clusters) + len(self.tree.nodes) > FLUSH


class LineMiner(StatefulProcessor):
    """One token count's lines, held back until the watermark and mined in order of (received_at, event_id)."""

    def __init__(self, config: Config):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "at_us long, part long", "rows binary")
        self.parts = handle.getValueState("parts", "part long")
        self.nodes = handle.getMapState("nodes", "path string", "children string, members string, used string")
        self.clusters = handle.getMapState("clusters", "seq long", "template string, first long, size long, changed long, path string, older long, newer long")
        self.known = handle.getValueState("known", "following long, live long, oldest long, newest long")

    def close(self) -> None:
        pass

    def hold(self, rows: list[tuple]) -> None:
        """Rows in order, see ``keep``."""
        at, event, text = zip(*rows, strict=True)
        self.keep(np.array(at, dtype=np.int64), np.array(event, dtype=np.int64), np.array(text, dtype=object))

    def keep(self, at: np.ndarray, event: np.ndarray, text: np.ndarray) -> None:
        """Rows in order as entries of at most ``CHUNK`` each, named by their first time."""
        part = self.parts.get()[0] if self.parts.exists() else 0
        for k in range(0, len(at), CHUNK):
            part += 1
            end = k + CHUNK
            codes, texts = pd.factorize(text[k:end])
            self.held.updateValue((int(at[k]), part), (pickle.dumps((at[k:end], event[k:end], codes.astype(np.int32), list(texts))),))
        self.parts.update((part,))

    def sorted_in(self, parts: list[pd.DataFrame]) -> int:
        """Keep rows of any order; gives back the first time."""
        at, event = (np.concatenate([p[c].to_numpy(dtype=np.int64) for p in parts]) for c in ("at_us", "event_id"))
        text = np.concatenate([p["text"].fillna("").to_numpy(dtype=object) for p in parts])
        order = np.lexsort((event, at))
        self.keep(at[order], event[order], text[order])
        return int(at[order[0]])

    def wake(self, mark: int, at_us: int) -> None:
        """A timer fires once the watermark is past it."""
        self.handle.registerTimer(max(at_us // 1000 - 1, mark + 1))

    def due(self, mark: int) -> Iterator[tuple]:
        """Held rows up to the watermark, in order."""
        for at, event, text in self.due_blocks(mark):
            yield from zip(at.tolist(), event.tolist(), text, strict=True)

    def due_blocks(self, mark: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same as arrays; an entry is read once rows of its time are taken, and rows are given out once no later entry has any before them."""
        keys = sorted(tuple(k) for k in self.held.keys() if k[0] // 1000 <= mark)
        rows = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=object))
        k = 0
        while k < len(keys) or len(rows[0]):
            new, n = [rows], 0
            while k < len(keys) and n < BLOCK:
                at, event, codes, texts = pickle.loads(self.held.getValue(keys[k])[0])
                self.held.removeKey(keys[k])
                text = np.array(texts, dtype=object)[codes]
                ready = int(np.searchsorted(at, (mark + 1) * 1000))
                if ready < len(at):
                    self.keep(at[ready:], event[ready:], text[ready:])
                new.append((at[:ready], event[:ready], text[:ready]))
                n += ready
                k += 1
            rows = tuple(np.concatenate(c) for c in zip(*new, strict=True))
            order = np.lexsort((rows[1], rows[0]))
            rows = tuple(c[order] for c in rows)
            cut = int(np.searchsorted(rows[0], keys[k][0])) if k < len(keys) else len(rows[0])
            if cut:
                yield tuple(c[:cut] for c in rows)
                rows = tuple(c[cut:] for c in rows)

    def mined(self, miner: StoredMiner, event: np.ndarray, text: np.ndarray) -> Iterator[pd.DataFrame]:
        """Assignments of lines in order; known texts are taken at once."""
        codes, texts = pd.factorize(text)
        begin, unknown = 0, UNKNOWN if 2 * len(texts) <= len(text) else 0
        while begin < len(text):
            if unknown:
                clusters, k, sizes = miner.take_known(texts, codes[begin:])
                if len(k):
                    of = lambda values: np.array(values)[k]  # noqa: B023, E731
                    columns = [event[begin : begin + len(k)], of([len(c.tokens) for c in clusters]), of([c.seq for c in clusters]), np.array([c.id for c in clusters], dtype=object)[k], sizes]
                    yield pd.DataFrame(dict(zip(_COLUMNS, columns, strict=True)))
                    begin += len(k)
            out = []
            for j in range(begin, min(begin + (1 if unknown else CHUNK), len(text))):
                c = miner.take(text[j], int(event[j]))
                out.append((int(event[j]), len(c.tokens), c.seq, c.id, c.size))
                if miner.full():
                    self.known.update(miner.flush())
            if out:
                yield pd.DataFrame(out, columns=_COLUMNS)
            begin, unknown = begin + len(out), max(unknown - 1, 0)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, parts, n = None, [], 0
        for part in rows:
            parts.append(part)
            n += len(part)
            if n >= SORTED:
                at = self.sorted_in(parts)
                first, parts, n = at if first is None else min(first, at), [], 0
        if n:
            at = self.sorted_in(parts)
            first = at if first is None else min(first, at)
        if first is not None:
            self.wake(timerValues.getCurrentWatermarkInMs(), first)
        yield pd.DataFrame(columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        miner = None
        for _, event, text in self.due_blocks(mark):
            miner = miner or StoredMiner(self.config, self.nodes, self.clusters, tuple(self.known.get()) if self.known.exists() else None)
            yield from self.mined(miner, event, text)
        if miner:
            self.known.update(miner.flush())
        later = min((k[0] for k in self.held.keys()), default=None)
        if later is not None:
            self.wake(mark, later)
        yield pd.DataFrame(columns=_COLUMNS)
