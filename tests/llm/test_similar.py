"""Near duplicates by similarity: the groups of brute force over whole sets of shingles."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.llm import simhash

from .test_python import roots


def plain(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def texts_with_near_copies(seed, hub=0):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijkl") + str(rng.randint(0, 999))
    passage = [word() for _ in range(40)]
    texts = [None, "", " ", "a", "A", "a b c d", "ü É w", "a b c d e", "A b\tc d e"]
    for k in range(40):
        base = [word() for _ in range(rng.choice([30, 100, 200]))] + rng.choice([[], passage])
        texts.append(" ".join(base))
        for _ in range(hub if k == 0 else rng.choice([0, 1, 3])):
            copy = list(base)
            for _ in range(rng.randint(1, 3)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    rng.shuffle(texts)
    return texts


def test_names_and_sizes_of_sets():
    texts = texts_with_near_copies(3)
    fps, name, size = simhash.wide_fingerprints(texts)
    sets = [plain(t) for t in texts]
    assert [int(n) for n in size] == [len(s) for s in sets]
    for i, j in combinations(range(len(texts)), 2):
        assert (name[i] == name[j]) == (sets[i] == sets[j])
        if sets[i] == sets[j]:
            assert (fps[i] == fps[j]).all()


@pytest.mark.parametrize("seed, hub, exact", [(1, 0, False), (2, 120, False), (1, 0, True), (2, 120, True)])
def test_groups_are_those_of_brute_force(spark, seed, hub, exact):
    """Seeds on which no pair of the few percent at 0.8 is missed; with a hub, an anchor gives a spanning set first."""
    texts = texts_with_near_copies(seed, hub)
    sets = [plain(t) for t in texts]
    near = [(i, j) for i, j in combinations(range(len(texts)), 2) if similarity(sets[i], sets[j]) >= 0.8]
    want = roots(len(texts), near)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("v", F.lit(1)).withColumn("KEY", F.lit(2))
    got = {r.id: r.component_id for r in simhash.near_duplicates(df, similar=0.8, shingle=5, exact=exact).collect()}
    wrong = [k for k in got if got[k] not in {j for j in range(len(want)) if want[j] == want[k]}]
    assert not wrong and np.mean([got[k] == want[k] for k in range(len(texts))]) == 1.0
    stay = simhash.near_deduplicated(df, similar=0.8, shingle=5, exact=exact)
    assert stay.columns == df.columns and sorted(r.doc_id for r in stay.collect()) == sorted(set(want))


def test_null_ids_repeated_rows_and_empty_tables(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (7, "a b c d e f"), (8, "x"), (8, "x"), (None, "only null"), (9, None), (10, "w " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({}, {"similar": 0.8, "shingle": 5}):
        got = simhash.near_duplicates(df, **options).collect()
        assert sorted(((r.id, r.component_id) for r in got), key=repr) == sorted([(None, 7), (None, 7), (7, 7), (8, 8), (8, 8), (None, None), (9, 9), (10, 10)], key=repr)
        assert simhash.near_duplicates(df.limit(0), **options).count() == 0
        assert sorted(r.doc_id for r in simhash.near_deduplicated(df.filter("doc_id IS NOT NULL"), **options).collect()) == [7, 8, 9, 10]


def pairs_of_size(rng, n, count):
    """Pairs of texts of n or fewer shingles with a similarity as close to 0.8 as there is, or equal texts in other case."""
    word = lambda: rng.choice("abcdefghijkl") + str(rng.randint(0, 99_999))
    out = []
    for _ in range(count):
        base = [word() for _ in range(n + 4)]
        other = list(base)
        while True:
            more = list(other)
            if rng.random() < 0.5 and len(more) > 5:
                more.pop(rng.choice([0, -1]))
            else:
                more[rng.choice([0, -1])] = word()
            a, b = (plain(" ".join(x)) for x in (base, more))
            if similarity(a, b) < 0.8 or len(out) > 10 * count:
                break
            if more == other:
                break
            other = more
        out.append((" ".join(base), " ".join(other)))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 50, 90, 200, 500])
def test_pairs_of_each_size_are_found(n):
    """Texts at the threshold meet at an anchor and pass both cuts at least as often as stated, and nine times of ten."""
    rng = random.Random(n)
    pairs = pairs_of_size(rng, n, 600 if n < 100 else 150)
    a, b = ([p[k] for p in pairs] for k in (0, 1))
    (x, xn, xs), (y, yn, ys) = simhash.wide_fingerprints(a), simhash.wide_fingerprints(b)
    cuts = simhash.wide_bits()
    at = [{(int(k), int(r)) for keys, rows, home in simhash.anchors(w, cuts, 1) for k, r in zip(keys[home] if own else keys, rows[home] if own else rows)} for w, own in ((x, True), (y, False))]
    met = np.isin(np.arange(len(pairs)), [r for _, r in at[0] & at[1]])
    size = np.minimum(np.maximum(xs, ys), simhash.SMALL)
    near = np.bitwise_count(x[:, : simhash.MET] ^ y[:, : simhash.MET]).sum(1) <= simhash.most_bits(0.8, 64 * simhash.MET)[size]
    close = np.bitwise_count(x ^ y).sum(1) <= simhash.most_bits(0.8, 64 * simhash.WIDE)[size]
    found = np.mean((xn == yn) | (met & near & close))
    assert found >= 0.95 and found >= simhash.recall(0.8, n) - 0.03, found


def test_odds_of_small_sets():
    """By drawing hashes."""
    rng = np.random.default_rng(4)
    for a, b, c in ((4, 5, 4), (5, 5, 5), (6, 6, 6), (8, 9, 8), (20, 24, 20)):
        bits = rng.integers(0, 2, (40_000, a + b - c))
        one, two = bits[:, :a].sum(1) * 2 > a, bits[:, a - c :].sum(1) * 2 > b
        assert abs(np.mean(one != two) - simhash._odds(a, b, c)) < 0.01
    assert abs(simhash.odds_by_size(0.8)[-1] - simhash.differing(0.8)) < 0.01 and simhash.recall(0.85) > 0.99


def test_hot_anchors_and_tiles_change_nothing(spark, monkeypatch):
    """Anchors of over 20 members and candidate groups are cut into many tiles."""
    monkeypatch.setattr(simhash, "HOT", 20)
    monkeypatch.setattr(simhash, "TILE", 4096)
    texts = texts_with_near_copies(2, 120)
    sets = [plain(t) for t in texts]
    want = roots(len(texts), [(i, j) for i, j in combinations(range(len(texts)), 2) if similarity(sets[i], sets[j]) >= 0.8])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.component_id for r in simhash.near_duplicates(df, similar=0.8, shingle=5).collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_hot_anchors_of_fingerprints_change_nothing(spark, monkeypatch):
    texts = texts_with_near_copies(4, 150)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r.id: r.component_id for r in simhash.near_duplicates(df).collect()}
    monkeypatch.setattr(simhash, "HOT", 10)
    assert {r.id: r.component_id for r in simhash.near_duplicates(df).collect()} == want


@pytest.mark.parametrize("cross, elements", [(False, 1 << 18), (False, 50), (True, 300)])
def test_alike_spans_what_brute_force_connects(monkeypatch, cross, elements):
    monkeypatch.setattr(simhash, "ELEMENTS", elements)
    monkeypatch.setattr(simhash, "PAIRS", 1000)
    texts = [t for t in texts_with_near_copies(6, 30) if plain(t)]
    sets = list(simhash.shingle_sets(texts, 5))
    sizes, values = np.concatenate([s[1] for s in sets]), np.concatenate([s[2] for s in sets])
    tile = np.arange(len(texts)) % 2
    words = simhash.wide_fingerprints(texts)[0]
    a, b = simhash.alike(words, tile, sizes, values, 0.8, cross)
    own = [plain(t) for t in texts]
    pairs = [(i, j) for i, j in combinations(range(len(texts)), 2) if not cross or tile[i] != tile[j]]
    near = {(i, j) for i, j in pairs if similarity(own[i], own[j]) >= 0.8}
    found = [(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert set(found) <= near and roots(len(texts), found) == roots(len(texts), near) and len(found) < len(texts)


def test_thinned_links_connect_the_same():
    rng = np.random.default_rng(3)
    parts = [tuple(rng.integers(0, 300, (2, 50), np.int64).view(np.uint64)) for _ in range(20)]
    for most in (1 << 18, 60):
        got = [(int(a), int(b)) for p, q in simhash.thinned(iter(parts), most) for a, b in zip(p, q, strict=True)]
        assert roots(300, got) == roots(300, [(int(a), int(b)) for p, q in parts for a, b in zip(p, q, strict=True)])
        assert most == 60 or len(got) < 300
