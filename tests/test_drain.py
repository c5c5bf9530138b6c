import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import golden
from timberline.functions.mask import mask
from timberline.functions.text import spaced, tokens
from timberline.operators import drain, metrics, neighbours, synth
from timberline.operators.drain import Config, Miner, assign, generalise, numeric, similarity


def frame(spark, lines):
    return spark.createDataFrame([(k, k, t) for k, t in enumerate(lines)], "event_id long, received_at long, template string")


def test_miner_rules():
    m = Miner()
    a = m.train("a b c d e f g h i j".split())
    assert m.train("a b c d e f g h i x".split()) is a and a.tokens[-1] == "<*>"
    assert m.train("a b c d e f g h y z".split()) is not a
    assert m.train([]) is m.train([]) and m.train(["one"]) is not m.train(["two"])
    assert numeric("٣") and numeric("½") and not numeric("十") and not numeric("abc")
    # A repeated line can take a new path once an exact child is there.
    m = Miner(Config(max_children=3))
    for line in ("1a b c d e f", "foo b c d e f", "foo q c d e f", "foo b c d e f"):
        m.train(line.split())
    with pytest.raises(ValueError):
        Config(depth=2)
    with pytest.raises(ValueError):
        Config(max_children=0)


def test_caps_hold():
    rng = random.Random(4)
    m = Miner(Config(max_clusters=20, max_leaf=5))
    for k in range(3000):
        c = m.train([rng.choice("ab") if i < 5 else f"w{rng.randint(0, 9)}" for i in range(8)], k)
        assert c.seq in m.table and len(m.table) <= 20
    leaves, stack = [], [m.root]
    while stack:
        node = stack.pop()
        stack += node.children.values()
        leaves += node.members
        assert len(node.members) <= 5
    assert sorted(leaves) == sorted(m.table)


@pytest.mark.skipif(not golden.masked(), reason="no golden files here")
@pytest.mark.parametrize("name", ["Apache_2k", "Linux_2k", "OpenSSH_2k"])
def test_golden_clusters(spark, name):
    lines = [m for _, m in golden.masked(name)]
    want = golden.clusters(name)
    for mode in ("exact", "distinct"):
        _, clusters = assign(frame(spark, lines), mode=mode)
        got = Counter((r["size"], r.template) for r in clusters.collect())
        assert want and got == want, mode


def plain_mined(lines, config):
    """One table for all lines, in order."""
    m = Miner(config)
    found = {}
    for k, line in enumerate(lines):
        found[k] = m.train(line.split(" ") if line else [], k)
    return found


HEADS = {
    "words": ["alpha", "beta", "gamma"],
    "many": [f"w{c}{c}" for c in "abcdefghijkl"],
    "mixed": ["alpha", "beta", "7", "<*>", "n5", "gamma", "delta"],
    "late": ["alpha", "beta", "gamma", "delta", "eps", "zeta", "8"],
}


@pytest.mark.parametrize("share", [0, 60])
@pytest.mark.parametrize(
    "firsts, config",
    [("words", Config()), ("many", Config(max_children=6)), ("many", Config(max_children=4, depth=5)), ("mixed", Config(max_children=50)), ("late", Config(max_children=5)), ("late", Config(max_children=1)),
     ("words", Config(max_clusters=9)), ("words", Config(depth=3)), ("many", Config(max_leaf=3, max_children=5)), ("late", Config(similarity=0.5, max_children=3))],
)
def test_dealt_mining_equals_one_table(spark, firsts, config, share):
    """Dealt by paths of tokens or not, and with clusters forgotten, every line is assigned as by one miner."""
    rng = random.Random(5)
    heads = HEADS[firsts]
    lines = []
    for k in range(600):
        # New first tokens keep coming, and a token with a digit now and then.
        head = rng.choice(heads[: 1 + k * len(heads) // 500] or heads)
        second = rng.choice(["red", "blue", "x9"] if k > 300 else ["red", "blue", "green", "grey"][: 1 + k // 60])
        rest = [rng.choice("xyz") if i in (3, 9) else "abcdefghijkl"[i] for i in range(rng.choice([0, 2, 10, 11]))]
        lines.append(" ".join([head, second, *rest] if rest else [head]))
    want = {k: (len(c.tokens), id(c), c) for k, c in plain_mined(lines, config).items()}
    out, clusters = assign(frame(spark, lines), config, share=share, alone=0 if share else drain.ALONE)
    rows = {r.event_id: r for r in out.join(clusters.select("seq", "template", F.col("size").alias("whole")), "seq").collect()}
    assert len(rows) == len(lines)
    assert {k: (r.template, r.whole) for k, r in rows.items()} == {k: (" ".join(c.tokens), c.size) for k, (_, _, c) in want.items()}
    assert len({r.seq for r in rows.values()}) == len({w[1] for w in want.values()}) == clusters.count()


@pytest.mark.parametrize("rounds", [drain.ROUNDS, 1])
@pytest.mark.parametrize(
    "config", [Config(max_clusters=12), Config(max_clusters=40, max_leaf=4), Config(max_clusters=25, max_children=4), Config(max_clusters=1), Config(max_clusters=30, similarity=0.6)]
)
def test_one_table_over_all_token_counts(spark, config, rounds, monkeypatch):
    """What was used least lately is forgotten, of whatever token count, also where the order of lines has repeated ids."""
    rng = random.Random(13)
    turns = []
    schedule = drain._schedule
    monkeypatch.setattr(drain, "_schedule", lambda *a: turns.append(1) or schedule(*a))
    lines = []
    for k in range(1500):
        n = rng.choice([0, 1, 5, 6, 6, 9])
        # Some lines come all the time, others at times, and what is common moves on.
        kind = min(int(rng.expovariate(0.15)) + k // 300 * 3, 60)
        lines.append(" ".join([f"{'abcdefgh'[kind % 8]}", f"s{'pqrstuvw'[kind // 8 % 8]}", "in", f"{rng.choice('xy')}", "for", str(kind), "of", "all", "z"][:n]))
    want = plain_mined(lines, config)
    out, clusters = assign(frame(spark, lines), config, share=40, rounds=rounds, alone=0)
    rows = {r.event_id: r for r in out.join(clusters.select("seq", "template", "first_event", F.col("size").alias("whole")), "seq").collect()}
    assert {k: (r.template, r.first_event, r.whole) for k, r in rows.items()} == {k: (" ".join(c.tokens), c.first, c.size) for k, c in want.items()}
    assert turns and (rounds == 1 or len(turns) < rounds), turns


def changing_lines(rng, count, new=()):
    """A few texts over and over; at some places a line that makes a cluster, or changes one that others then miss."""
    heads, kinds = ["alpha", "beta", "x9"], ["on", "off", "idle"]
    lines = [f"{rng.choice(heads)} was found to be {rng.choice(kinds)} by the {rng.choice('pq')} watch at noon" for _ in range(count)]
    for k, line in new:
        lines[k] = line
    return lines


LATE = [(400, "gamma was found to be on by the p watch at noon"), (650, "alpha was found to be on by the r watch at noon"), (700, "one more"), (900, "")]


@pytest.mark.parametrize("config, whole", [(Config(), True), (Config(similarity=0.8, max_children=3), True), (Config(max_leaf=1), False), (Config(max_clusters=3), False)])
def test_few_texts_are_mined_by_ranges(spark, config, whole, monkeypatch):
    """Only ranges with a change are mined whole, and every line is as one miner has it; equal times and late changes too."""
    monkeypatch.setattr(drain, "RANGE", 25)
    rng = random.Random(3)
    lines = changing_lines(rng, 1000, LATE)
    found, mined, repeated = [], [], drain._repeated
    monkeypatch.setattr(drain, "_repeated", lambda *a: found.append(repeated(*a)) or found[-1])
    mine = drain._mined
    monkeypatch.setattr(drain, "_mined", lambda rows, *a: mined.append(rows.count()) or mine(rows, *a))
    df = spark.createDataFrame([(k, k // 40, t) for k, t in enumerate(lines)], "event_id long, received_at long, template string").repartition(3)
    m, want = Miner(config), {}
    for k, line in enumerate(lines):
        c = m.train(line.split(" ") if line else [], k)
        want[k] = [c, c.size, c.id]
    out, clusters = assign(df, config, alone=0)
    rows = out.join(clusters.select("seq", "template", "first_event", F.col("size").alias("whole")), "seq").collect()
    assert len(rows) == len(lines)
    got = {r.event_id: (r.template, r.first_event, r.whole, r["size"], r.template_id_at_train, r.template_id_final) for r in rows}
    assert got == {k: (" ".join(c.tokens), c.first, c.size, size, id_, c.id) for k, (c, size, id_) in want.items()}
    assert clusters.count() == len({id(c) for c, _, _ in want.values()})
    assert bool(found and found[-1]) == whole
    assert not whole or max(mined) < 0.7 * len(lines)
    # Templates over time, too.
    if whole:
        had = {(r.first_event, r.template, r.since.event_id) for r in drain.versions(df, config, alone=0).collect()}
        m, made = Miner(config), set()
        for k, line in enumerate(lines):
            c = m.train(line.split(" ") if line else [], k)
            if c.changed == k:
                made.add((c.first, " ".join(c.tokens), k))
        assert had == made


def test_no_task_takes_a_common_cluster(spark):
    """Lines are joined to their clusters without a move by cluster, and without a sort of one route's lines."""
    lines = ["alpha was found"] * 500
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, -1)
    try:
        plan = assign(frame(spark, lines), alone=0)[0].select("event_id", "template_id_final")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    assert "hashpartitioning(n_tokens" not in plan and "Window" not in plan


def test_spaced(spark):
    odd = ["", " ", "a b", " a", "a ", "a  b", "a\tb", "a\u00a0b", "\u3000", "é b", "a\nb\x0bc\fd\re", "a\x1cb", "x " * 300, "y" * 300, "b " * 128 + "c", "a " * 3 + "b", "\u2028a"]
    df = spark.createDataFrame([(t,) for t in odd], "t string")
    for most in (1, 2, 3, 128):
        for r in df.select("t", spaced(F.col("t"), most).alias("a"), F.array_join(tokens(F.col("t"), most), " ").alias("b")).collect():
            assert r.a == r.b, (r.t, most)


def test_tasks_of_one_token_count(spark):
    """Thousands of first tokens: those with a child of their own, and one task for the rest."""
    rng = random.Random(6)
    name = lambda k: "".join(chr(97 + int(d)) for d in str(k))
    lines = [f"q{name(rng.randrange(3000))} b c d" for _ in range(6000)]
    rows = drain._routed(frame(spark, lines).select("event_id", F.col("received_at").alias("at"), F.col("template").alias("text")), Config(), 0).groupBy("n", "route").count().collect()
    firsts = list(dict.fromkeys(x.split(" ")[0] for x in lines))
    assert {r.route.split(" ")[0] for r in rows} == {*firsts[:99], "\n99"}
    got = assign(frame(spark, lines), share=0)[1].count()
    assert got == len({id(c) for c in plain_mined(lines, Config()).values()})


def test_a_leaf_keeps_its_order_of_use():
    """What a full leaf forgets is found without a walk over the table."""
    m = Miner(Config(max_leaf=3, max_clusters=0))
    for k in range(3000):
        m.train(["other", f"{k}", *(f"{k}{i}" for i in range(6))], k)
    for word in "abc":
        m.train(["one", "two", "x", "x", "x", "x", word * 2, word * 3], 0)
    m.train(["one", "two", "x", "x", "x", "x", "aa", "aaa"], 0)
    m.train(["one", "two", "x", "x", "x", "x", "dd", "ddd"], 0)
    assert [c.tokens[6] for c in m.forgotten if c.tokens[0] == "one"] == ["bb"]


def test_assign_edges(spark):
    lines, clusters = assign(frame(spark, ["a b", None, "", "a b", " a  b "]))
    rows = {r.event_id: r for r in lines.collect()}
    assert rows[0].seq == rows[3].seq == rows[4].seq and rows[1].seq == rows[2].seq
    assert [r.n_tokens for r in clusters.orderBy("seq").collect()] == [2, 0]
    assert assign(frame(spark, []))[1].count() == 0
    row = spark.createDataFrame([(["a", "<*>", "c"], ["a", "<*>", "d"])], "x array<string>, y array<string>")
    got = row.select(similarity(F.col("x"), F.col("y")).alias("s"), generalise(F.col("x"), F.col("y")).alias("g")).first()
    assert got.s == pytest.approx(1 / 3) and got.g == ["a", "<*>", "<*>"]


@pytest.mark.parametrize("config, share", [(Config(), 0), (Config(similarity=0.6, max_leaf=3), 30), (Config(similarity=0.7, max_clusters=8), 10**9)])
def test_referrals_equal_a_replay(spark, config, share):
    """A new cluster is compared with the templates of its moment, not with later ones or those forgotten."""
    rng = random.Random(9)
    lines = []
    for _ in range(300):
        n = rng.choice([6, 7, 7, 8])
        lines.append(" ".join(rng.choice(["red", "blue"]) if i == 0 else rng.choice(["x", "y", f"w{rng.randint(0, 3)}"]) if i > 3 else "abcdefghijkl"[i] for i in range(n)))
    miner, want = Miner(config), set()
    for k, line in enumerate(lines):
        words = line.split(" ")
        c = miner.train(words, k)
        if c.size == 1:
            for other in (x for x in miner.table.values() if x is not c):
                if abs(len(other.tokens) - len(words)) <= 2:
                    inter = sum((Counter(words) & Counter(other.tokens)).values())
                    score = inter / (len(words) + len(other.tokens) - inter)
                    if score >= 0.65:
                        want.add((k, line, other.first, " ".join(other.tokens), round(score, 9)))
    got = [(r.event_id, r.template, r.other_event, r.other_template, round(r.score, 9)) for r in neighbours.referrals(drain.versions(frame(spark, lines), config, share=share, alone=0)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) >= 5


def test_neighbours_equal_brute_force(spark):
    rng = random.Random(7)
    bags = [[rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))] for _ in range(120)] + [[], ["z"], ["z"]]
    df = spark.createDataFrame(list(enumerate(bags)), "seq long, tokens array<string>")
    want = {}
    for i, x in enumerate(bags):
        for j in range(i + 1, len(bags)):
            y = bags[j]
            inter = sum((Counter(x) & Counter(y)).values())
            union = len(x) + len(y) - inter
            if abs(len(x) - len(y)) <= 2 and union and inter / union >= 0.65:
                want[i, j] = inter / union
    got = {(r.seq_a, r.seq_b): r.score for r in neighbours.neighbours(df).collect()}
    assert got == pytest.approx(want)
    some = df.filter("seq < 10")
    both = {(r.seq_a, r.seq_b) for r in neighbours.neighbours(df, only=some).collect()}
    assert both == {(a, b) for p in want for a, b in (p, p[::-1]) if a < 10}


def test_aliases(spark):
    rows = [("a", "b", True, 1), ("b", "c", True, 2), ("a", "d", True, 3), ("a", "d", False, 4), ("c", "e", True, 5), ("b", "e", True, 6)]
    m = spark.createDataFrame([(lo, hi, f"t{lo}", yes, at) for lo, hi, yes, at in rows], "id_lo string, id_hi string, template_lo string, merged boolean, judged_at long")
    found = {r.id: (r.survivor, r.template) for r in neighbours.resolve(neighbours.alias_edges(m)).collect()}
    assert found == {"b": ("a", "ta"), "c": ("a", "ta"), "e": ("a", "ta")}
    lines = spark.createDataFrame([("c", "x"), ("q", "y")], "template_id string, template string")
    moved = neighbours.with_survivors(lines, neighbours.resolve(neighbours.alias_edges(m)))
    assert {tuple(r) for r in moved.collect()} == {("a", "ta"), ("q", "y")}


def test_scores(spark):
    df = spark.createDataFrame([("A", "1"), ("A", "1"), ("B", "2"), ("B", "3"), ("C", "4"), ("D", "4")], "truth string, predicted string")
    row = metrics.grouping_accuracy(df).first()
    assert row.ga == pytest.approx(2 / 6) and row.fga == pytest.approx(2 * (1 / 4) * (1 / 4) / (1 / 4 + 1 / 4))
    assert metrics.merge_count(df).first().merges == 1
    assert [r.truth for r in metrics.splits(df).collect()] == ["B"]
    assert [(p.truth, p.n) for p in metrics.impurity(df).first().parts] == [("C", 1), ("D", 1)]
    assert metrics.agreement(df, "truth", "predicted").first().agreement == pytest.approx(2 / 6)


def test_synthesis(spark):
    lines = spark.createDataFrame([(k, k, f"job alpha state one two three four five six {v} end") for k, v in enumerate(["xa", "xb", "xa", "xc"])], "event_id long, received_at long, raw string")
    rows = synth.candidates(lines).collect()
    assert [(r.before, r.after, r.examples, r.occurrences) for r in rows] == [(["six"], ["end"], ["xa", "xb", "xc"], 4)]
    asked = []

    def propose(text):
        asked.append(text)
        return '[{"name": "JOB", "pattern": "x(a)", "why": ""}, {"name": "ST", "pattern": "zz+"}]' if len(asked) == 1 else '{"name": "JOB", "pattern": "\\\\bx[abc]\\\\b"}'

    bundle, new = synth.synthesise(lines, propose)
    assert [s.name for s in new] == ["JOB", "ST"] and bundle.slots[-1].name == "NUM" and len(asked) == 2
    assert lines.select(mask(F.col("raw"), bundle).alias("m")).first().m.endswith("six <VAR:JOB> end")


def test_synthesis_masks_once_and_mines_many_texts_once(spark, monkeypatch):
    """The plan of the answer masks nothing anew, and lines that are bound to fill the table are mined by one pass."""
    word = lambda k: "".join(chr(97 + int(d)) for d in str(k))
    lines = spark.createDataFrame([(k, k, f"job {word(k % 40)} state one two three four five six seven {word(k)} end") for k in range(400)], "event_id long, received_at long, raw string")
    passes, mined = [], drain._mined
    monkeypatch.setattr(drain, "_mined", lambda *a: passes.append(1) or mined(*a))
    found = synth.candidates(lines, config=Config(max_clusters=20))
    assert len(passes) == 1 and "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()
    wide = synth.candidates(lines, config=Config(max_clusters=100))
    assert len(passes) == 2 and {(tuple(r.before), r.occurrences, tuple(r.examples)) for r in wide.collect()} == {(("seven",), 10, tuple(word(k + 40 * i) for i in range(5))) for k in range(40)}


def test_pairs_of_copies_are_made_from_lists(spark, monkeypatch):
    """Lists of many copies, cut into parts, give each pair once; no join or exchange moves the pairs."""
    monkeypatch.setattr(neighbours, "COPIES", 3)
    texts = {k: ("a b c d e f", "a b c d e g", "x y z")[k % 3].split(" ") for k in range(60)}
    rows = spark.createDataFrame(list(texts.items()), "seq long, tokens array<string>")
    score = {frozenset((0,)): 1.0, frozenset((1,)): 1.0, frozenset((2,)): 1.0, frozenset((0, 1)): 5 / 7}
    want = sorted((a, b, s) for a in texts for b in texts if a < b and (s := score.get(frozenset((a % 3, b % 3)))))
    found = neighbours.neighbours(rows)
    assert sorted(tuple(r) for r in found.collect()) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert next(k for k, x in enumerate(plan) if "Join" in x) > max(k for k, x in enumerate(plan[: len(plan)]) if "explode(ys" in x)
    some = neighbours.neighbours(rows, only=rows.select("seq").filter("seq < 4"))
    both = {(a, b) for a, b, _ in want} | {(b, a) for a, b, _ in want}
    assert sorted((r.seq_a, r.seq_b) for r in some.collect()) == sorted(p for p in both if p[0] < 4)


def test_a_full_table_of_texts_is_followed_by_blocks(spark, monkeypatch):
    """Where each text is a cluster, blocks of time give what one miner gives; other lines go by turns."""
    rng = random.Random(23)
    texts = ["", "a", "a b", "7 b", *(f"{a} x{k} goes {b}" for a in ("p", "q2", "r") for k in range(6) for b in ("in", "out"))]
    lines = [rng.choice(texts[: 6 if k % 3 else 40]) for k in range(1500)]
    config = Config(similarity=1.0, max_clusters=9, max_leaf=0, max_children=50)
    monkeypatch.setattr(drain, "BLOCK", 60)
    monkeypatch.setattr(drain, "_bounded", None)
    df = spark.createDataFrame([(k * 7 % 1501, k, t) for k, t in enumerate(lines)], "event_id long, received_at long, template string").repartition(3)
    miner, want, ended = Miner(config), [], []
    for k, t in enumerate(lines):
        c = miner.train(t.split(" ") if t else [], k * 7 % 1501)
        want.append((k * 7 % 1501, c.id, c.size))
        ended += [(c.first, " ".join(c.tokens), c.size) for c in miner.forgotten]
        miner.forgotten.clear()
    ended += [(c.first, " ".join(c.tokens), c.size) for c in miner.table.values()]
    got, clusters = drain.assign(df, config, alone=0)
    assert sorted((r.event_id, r.template_id_at_train, r["size"]) for r in got.collect()) == sorted(want)
    assert sorted((r.first_event, r.template, r["size"]) for r in clusters.collect()) == sorted(ended)
    gone = {r.first_event: r.until.at if r.until else None for r in drain.versions(df, config, alone=0).collect()}
    assert len(gone) == len(ended) and sum(x is None for x in gone.values()) == 9
    for other in (Config(similarity=1.0, max_clusters=9, max_leaf=0, max_children=2), Config(similarity=0.9, max_clusters=9, max_leaf=0)):
        assert not drain._apart(df.select(F.col("template").alias("text")), other)
    assert not drain._apart(df.select(F.lit("a <*>").alias("text")), config)


def test_a_crowded_leaf_compares_few(monkeypatch):
    """Of the members of a leaf only those that share a part with the line are compared, with equal results."""
    rng = random.Random(21)
    lines = [" ".join(["a", "b", "c", "d", "e", *(rng.choice("uvwxyz") + rng.choice("klmno") for _ in range(25))]) for _ in range(120)]
    lines += [" ".join(w if i != 9 else f"{k}" for i, w in enumerate(rng.choice(lines).split(" "))) for k in range(300)]
    asked = []
    parts = Miner._candidates
    monkeypatch.setattr(Miner, "_candidates", lambda m, node, words: asked.append(len(found := parts(m, node, words))) or found)
    few = [(c.seq, c.size) for c in plain_mined(lines, Config()).values()]
    compared = sum(asked)
    monkeypatch.setattr(Miner, "_candidates", lambda m, node, words: node.members)
    assert few == [(c.seq, c.size) for c in plain_mined(lines, Config()).values()]
    assert compared < 5_000


def test_known_texts_are_taken_at_once():
    """Texts that are known need no search, and lines of a batch are taken as one by one."""
    rng = random.Random(22)
    texts = [f"{a} went {b} for {c} and then back home today {d}" for a in "xyz" for b in "pq" for c in ("7", "m") for d in "st"]
    lines = [rng.choice(texts) for _ in range(3000)]
    for config in (Config(), Config(max_clusters=7), Config(max_leaf=2, similarity=0.6), Config(max_children=2)):
        one, many = Miner(config), Miner(config)
        want, got = [], []
        for k, t in enumerate(lines[:1500]):
            one.train(t.split(" "), k)
            many.take(t, k)
        for k, t in enumerate(lines[1500:], 1500):
            c = one.train(t.split(" "), k)
            want.append((c.seq, c.size, c.id))
        k, codes = 1500, [texts.index(t) for t in lines[1500:]]
        while k < 3000:
            clusters, at, sizes = many.take_known(texts, np.array(codes[k - 1500 :]))
            got += [(clusters[i].seq, s, clusters[i].id) for i, s in zip(at.tolist(), sizes.tolist(), strict=True)]
            k += len(at)
            if k < 3000:
                c = many.take(lines[k], k)
                got.append((c.seq, c.size, c.id))
                k += 1
        assert got == want and list(one.table) == list(many.table)


@pytest.mark.parametrize("config", [Config(max_clusters=30), Config(max_clusters=60, max_leaf=3, max_children=4), Config(max_clusters=25, similarity=0.6), Config(max_clusters=20, similarity=0.0), Config(max_clusters=40, depth=3)])
def test_texts_like_no_other_pass_a_full_table_as_keys(spark, config, monkeypatch):
    """One table's lines have their text only where another text may be alike; each line and cluster is as one miner has it."""
    rng = random.Random(31)
    word = lambda: rng.choice("bcdfg") + rng.choice("aeiou") + rng.choice("lmnpr") + rng.choice("aeiou")
    lines = []
    for _ in range(900):
        kind, n = rng.random(), rng.choice([0, 1, 2, 7, 12, 12, 23])
        if kind < 0.25 and lines:
            lines.append(rng.choice(lines[-80:]))
        elif kind < 0.4:
            lines.append(" ".join(["one", "of", rng.choice("xy"), "many", "jobs", "has", "been", "done", "by", rng.choice("pqrs"), "for", rng.choice(["all", "<*>"])]))
        else:
            lines.append(" ".join(rng.choice([word(), "7", "alpha"]) if k < 2 else word() for k in range(n)))
    given, mine = [], drain._mined
    monkeypatch.setattr(drain, "_mined", lambda rows, *a: given.extend(rows.collect()) or mine(rows, *a))
    df = spark.createDataFrame([(k, k // 3, t) for k, t in enumerate(lines)], "event_id long, received_at long, template string").repartition(3)
    m, want, ended, made = Miner(config), {}, [], set()
    for k, t in enumerate(lines):
        c = m.train(t.split(" ") if t else [], k)
        want[k] = c, c.size, c.id
        if c.changed == k:
            made.add((c.first, " ".join(c.tokens), k))
        ended += [(c.first, " ".join(c.tokens), c.size, len(c.tokens), k) for c in m.forgotten]
        m.forgotten.clear()
    ended += [(c.first, " ".join(c.tokens), c.size, len(c.tokens), None) for c in m.table.values()]
    out, clusters = assign(df, config)
    found = clusters.collect()
    assert sorted((r.first_event, r.template, r["size"], r.n_tokens) for r in found) == sorted(e[:4] for e in ended)
    assert [r.first_event for r in sorted(found, key=lambda r: r.seq)] == sorted(e[0] for e in ended)
    by_seq = {r.seq: r.first_event for r in found}
    assert {r.event_id: (by_seq[r.seq], r["size"], r.template_id_at_train, r.template_id_final) for r in out.collect()} == {k: (c.first, size, id_, c.id) for k, (c, size, id_) in want.items()}
    texts = [r.text for r in given if r.text is not None]
    assert len(given) == len(lines) and (len(texts) < len(lines) / 2 or config.similarity < 0.9)
    gone = {r.first_event: r.until.event_id if r.until else None for r in drain.versions(df, config).orderBy("since").collect()}
    assert {(r.first_event, r.template, r.since.event_id) for r in drain.versions(df, config).collect()} == made
    assert gone == {e[0]: e[4] for e in ended}


def test_many_clusters_are_numbered_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(drain, "BROADCAST_ROWS", 10)
    found = spark.createDataFrame([(k * 37 % 101, k % 5) for k in range(101)], "first_event long, n_tokens int").repartition(3)
    assert sorted((r.seq, r.first_event) for r in drain._numbered(found).collect()) == [(k + 1, k) for k in range(101)]


def test_lines_are_mined_whole(spark):
    """What comes after many tokens tells clusters apart and is a place of its own, also in a full table and in proposals."""
    head = " ".join(["job", "alpha"] + ["w" + "abcdefghij"[k % 10] for k in range(140)])
    tails = [" ".join(f"{c}{c}{'abcdefghij'[k % 10]}" for k in range(60)) for c in "xyz"]
    lines = [f"{head} {tails[k % 3]} {'pqr'[k % 2]}" for k in range(30)]
    want = Counter((f"{head} {t} <*>", 10) for t in tails)
    for config in (Config(), Config(max_clusters=3), Config(max_clusters=2)):
        m = plain_mined(lines, config)
        found = assign(frame(spark, lines), config)[1].collect()
        assert Counter(r["size"] for r in found) == Counter(c.size for c in {id(c): c for c in m.values()}.values()) and {r.n_tokens for r in found} == {203}
        assert config.max_clusters == 2 or Counter((r.template, r["size"]) for r in found) == want
    assert {r.n_tokens for r in assign(frame(spark, lines), Config(max_tokens=128))[1].collect()} == {128}
    rows = synth.candidates(frame(spark, lines), masked=True).collect()
    assert {(r.position, r.occurrences, tuple(r.examples)) for r in rows} == {(202, 10, ("p", "q")), (202, 10, ("q", "p"))}
    assert frame(spark, ["a b  c"]).select(F.size(tokens(F.col("template"), 0)).alias("n"), spaced(F.col("template"), 0).alias("s")).first() == (3, "a b c")


def test_proposals_move_the_texts_of_open_places_alone(spark, monkeypatch):
    """In a full table most lines are mined as keys; lines of clusters with an open place are written before their texts are joined."""
    word = lambda k: "".join(chr(97 + int(d)) for d in str(k))
    lines = [f"{word(k)} stands alone among all of the others" if k % 4 else f"job state one two three four five six seven {word(k % 24)} end" for k in range(400)]
    given, stored, mine, write = [], {}, drain._mined, synth.written
    monkeypatch.setattr(drain, "_mined", lambda rows, *a: given.extend(rows.collect()) or mine(rows, *a))
    monkeypatch.setattr(synth, "written", lambda df, name: stored.setdefault(name, write(df, name)))
    found = synth.candidates(frame(spark, lines).withColumnRenamed("template", "raw"), config=Config(max_clusters=50)).collect()
    assert [(r.occurrences, r.position, r.examples) for r in found] == [(100, 9, [word(k) for k in (0, 4, 8, 12, 16)])]
    assert len(given) == 400 and sum(r.text is not None for r in given) == 100
    assert stored["synth-open"].count() == 100


@pytest.mark.parametrize("few", [True, False])
def test_lists_of_copies_are_not_moved_with_pairs(spark, monkeypatch, few):
    """What is dealt out has the names of lists; where lists are too many to be sent to all, the pairs are the same."""
    monkeypatch.setattr(neighbours, "COPIES", 3)
    if not few:
        monkeypatch.setattr(neighbours, "BROADCAST_MEMBERS", 0)
    texts = {k: ("a b c d e f", "a b c d e g", "x y z", "")[k % 4].split() for k in range(60)}
    rows = spark.createDataFrame(list(texts.items()), "seq long, tokens array<string>")
    score = {frozenset((0,)): 1.0, frozenset((1,)): 1.0, frozenset((2,)): 1.0, frozenset((0, 1)): 5 / 7}
    want = sorted((a, b, s) for a in texts for b in texts if a < b and (s := score.get(frozenset((a % 4, b % 4)))))
    found = neighbours.neighbours(rows)
    assert sorted(tuple(r) for r in found.collect()) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join, dealt = (next(k for k, x in enumerate(plan) if what in x) for what in ("Join", "Repartition"))
    assert (join < dealt) == few
    some = {(r.seq_a, r.seq_b) for r in neighbours.neighbours(rows, only=rows.filter("seq < 4")).collect()}
    assert some == {(a, b) for p in want for a, b in (p[:2], p[1::-1]) if a < 4}
    assert neighbours.neighbours(rows.filter("seq < 0")).count() == 0
