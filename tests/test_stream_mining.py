"""Mining by keyed entries: equal to one miner whatever is written and let go, and little is written."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.operators.drain import Config, Miner
from timberline.runtime import new_folder
from timberline.streaming.jobs import mine
from timberline.streaming.mining import LineMiner, StoredMiner


class Entries(dict):
    """A map state that counts what is written."""

    writes = 0

    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self.writes += 1
        self[key] = value

    def removeKey(self, key):
        self.writes += 1
        del self[key]


def nodes_of(node):
    return 1 + sum(map(nodes_of, node.children.values()))


@pytest.mark.parametrize(
    "config",
    [Config(), Config(max_clusters=9), Config(max_leaf=3, max_children=4), Config(max_clusters=1), Config(similarity=0.5, max_clusters=15, max_leaf=4, max_children=3)],
)
def test_stored_miner_equals_a_plain_one(config):
    rng = random.Random(1)
    plain, nodes, clusters, known = Miner(config), Entries(), Entries(), None
    stored = StoredMiner(config, nodes, clusters)
    for k in range(3000):
        words = [rng.choice("abcdef") + rng.choice(["", "", "1"]) if i < 3 else rng.choice("xyzuvw") for i in range(rng.choice([0, 1, 3, 8]))]
        a, b = plain.train(words, k), stored.train(words, k)
        assert (a.seq, a.tokens, a.size, a.first, a.changed) == (b.seq, b.tokens, b.size, b.first, b.changed)
        if k % 37 == 0:
            known = stored.flush()
            stored = StoredMiner(config, nodes, clusters, known)
    stored.flush()
    assert len(clusters) == len(plain.table) and len(nodes) == nodes_of(plain.root)


def test_writes_grow_with_lines_not_with_the_table():
    nodes, clusters = Entries(), Entries()
    m = StoredMiner(Config(max_children=5000), nodes, clusters)
    word = lambda k: "".join(chr(97 + int(d)) for d in str(k))
    for k in range(4000):
        m.train([word(k), "b", "c"], k)
    known = m.flush()
    assert len(clusters) == 4000
    nodes.writes = clusters.writes = 0
    m = StoredMiner(Config(max_children=5000), nodes, clusters, known)
    for k in range(10):
        m.train([word(k), "b", "c"], k)
    # A cluster that was used, and those before and after it; a node's order of use stays as it was.
    assert m.flush()[1] == 4000 and clusters.writes <= 30 and nodes.writes == 0
    for k in range(3):
        m.train([word(5000 + k), "b", "c"], k)
    clusters.writes = 0
    m.flush()
    assert clusters.writes <= 9 and nodes.writes <= 13


def test_held_rows_come_in_order_and_stay_in_chunks():
    p = LineMiner(Config())
    p.held, value = Entries(), {}
    p.held.keys = lambda: list(dict.keys(p.held))

    class Value:
        exists = staticmethod(lambda: bool(value))
        get = staticmethod(lambda: value["v"])
        update = staticmethod(lambda v: value.update(v=v))

    p.parts = Value
    rng = random.Random(4)
    rows = [(rng.randrange(10**7), k, f"t{k}") for k in range(5000)]
    for at in range(0, 5000, 700):
        p.hold(sorted(rows[at : at + 700]))
    got = list(p.due(4000))
    assert got == sorted(r for r in rows if r[0] // 1000 <= 4000) and got
    assert list(p.due(4000)) == [] and list(p.due(10**4)) == sorted(r for r in rows if r[0] // 1000 > 4000)
    assert not p.held


def test_many_batches_and_a_restart(spark, tmp_path):
    """Lines out of order within what is waited for, in files of a batch each, with a stop after every one."""
    rng = random.Random(8)
    began = datetime(2024, 5, 1, tzinfo=timezone.utc)
    config = Config(max_children=4, max_clusters=6)
    lines = [(k, began + timedelta(seconds=k * 7), " ".join([rng.choice(["a", "b", "c", "d", "e", "7"]), "went", rng.choice("xy"), "to", "the", "far", "end", "of", "town", "then", *["on"] * rng.choice([0, 1])])) for k in range(240)]
    folder, rows_at, state = tmp_path / "lines", new_folder(spark, "mined"), new_folder(spark, "state")
    schema = "event_id long, received_at timestamp, template string"
    parts = [lines[:80], lines[80:160], lines[160:], [(10_000, began + timedelta(days=9), "zz")]]
    for part in parts:
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        stream = mine(spark.readStream.schema(schema).parquet(str(folder)), config, "1 minute")
        stream.writeStream.format("parquet").option("path", rows_at).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = {r.event_id: (r.n_tokens, r.local, r.template_id_at_train, r["size"]) for r in spark.read.parquet(rows_at).filter(F.col("event_id") < 10_000).collect()}
    want = {}
    for n in (10, 11):
        miner = Miner(config)
        for event, _, text in lines:
            if len(text.split(" ")) == n:
                c = miner.train(text.split(" "), event)
                want[event] = (n, c.seq, c.id, c.size)
    assert got == want and len(want) == 240


def test_lines_of_known_texts_cost_no_state():
    """What is read and written goes by texts, not by lines; lines and sizes are as one by one."""
    rng = random.Random(3)
    texts = [f"{a} went {b} to the far end of town then" for a in ("x", "y", "7") for b in "pqrs"]
    for config in (Config(), Config(max_clusters=5), Config(similarity=0.7, max_leaf=2)):
        lines = [rng.choice(texts) for _ in range(30_000)]
        nodes, clusters = Entries(), Entries()
        p, plain = LineMiner(config), Miner(config)
        want = [(k, len(c.tokens), c.seq, c.id, c.size) for k, t in enumerate(lines) for c in [plain.train(t.split(" "), k)]]
        miner = StoredMiner(config, nodes, clusters)
        got = [tuple(r) for f in p.mined(miner, np.arange(30_000), np.array(lines, dtype=object)) for r in f.itertuples(index=False)]
        miner.flush()
        assert got == want and nodes.writes + clusters.writes < 200
