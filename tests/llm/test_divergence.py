"""The source audit against sums over every term, and its SQL."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, least, top):
    lower = {c: c + 32 for c in range(65, 91)}
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [t.translate(lower) for t in TERM.findall(text or "")]
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()

    def ranked(lang, source, part, values):
        for rank, (value, item) in enumerate(sorted(values, key=lambda x: (-x[0], x[1].encode())), 1):
            if part == "pair" or rank <= top:
                out.add((lang, source, part, item, value, rank))

    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted(s for x, s in groups if x == lang)

        def p(count, total):
            return 1 + 10**9 * (count + 5) // (total + 5 * len(kept))

        totals = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        for s in sources:
            here = {t: p(counts[lang, s][t], totals[s]) for t in kept}
            ranked(lang, s, "pair", [(sum(abs(here[t] - p(counts[lang, o][t], totals[o])) for t in kept), o) for o in sources if o != s])
            ranked(lang, s, "term", [(here[t] - p(whole[t], sum(whole.values())), t) for t in kept if counts[lang, s][t] and here[t] > p(whole[t], sum(whole.values()))])
    return out


def documents(seed, n, sources, words):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abCDéß日") for _ in range(rng.randint(1, 4))) for _ in range(words)]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "en", "de", None]), f"s{min(rng.randrange(sources), rng.randrange(sources))}"
        weights = [1 + (hash((source, w)) % 7 == 0) * 5 for w in range(words)]
        rows.append((lang, source, rng.choice([" ", ", ", "7"]).join(rng.choices(vocabulary, weights, k=rng.randint(0, 60)))))
    return [*rows, ("en", None, None), ("fr", "a", "x"), ("fr", "b", ""), ("en", "s0", "É" * 9), *[("xx", "one", "alone @[`{ a")] * 40]


@pytest.mark.parametrize("tile, share, step, sources, top", [(64, 200_000, 8, 6, 50), (3, 50, 1, 11, 5), (2, 1000, 40, 5, 1)])
def test_equals_sums_over_every_term(spark, monkeypatch, tile, share, step, sources, top):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "SHARE", share)
    monkeypatch.setattr(divergence, "STEPS", step)
    rows = documents(sources, 300, sources, 90)
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("TERM", F.lit(1)).withColumn("n", F.lit("x")).repartition(3)
    got = [tuple(r) for r in divergence.divergence(df, least=5, top=top).collect()]
    want = plain(rows, 5, top)
    assert len(got) == len(want) and set(got) == want


def test_groups_too_many_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_ROWS", 0)
    rows = documents(3, 150, 5, 60)
    got = {tuple(r) for r in divergence.divergence(spark.createDataFrame(rows, "lang string, source string, text string"), least=5).collect()}
    assert got == plain(rows, 5, 50)


def test_long_texts_are_counted_in_parts(monkeypatch):
    monkeypatch.setattr(divergence, "PART_BYTES", 100)
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["aa", "Bb", "cé", "d" * 150]) for _ in range(rng.randint(0, 200))) for _ in range(40)] + ["e" * 5000, "", "a " * 3000]
    groups = np.array([k % 3 for k in range(len(texts))])
    n, docs = Counter(), Counter()
    for group, names, counts, of_docs in divergence._counted([t.encode() for t in texts], groups):
        for k, name in enumerate(names):
            n[int(group[k]), name.decode()] += int(counts[k])
            docs[int(group[k]), name.decode()] += int(of_docs[k])
    want_n, want_docs = Counter(), Counter()
    for k, t in enumerate(texts):
        found = TERM.findall(t.lower())
        want_n.update((k % 3, x) for x in found)
        want_docs.update((k % 3, x) for x in set(found))
    assert n == want_n and docs == want_docs


def test_a_text_of_millions_of_characters(spark):
    rows = [("en", "a", "long Words of a text " * 200_000), ("en", "b", "of a"), ("en", "b", "f" * 3_000_000)]
    got = {tuple(r) for r in divergence.divergence(spark.createDataFrame(rows, "lang string, source string, text string"), least=1).collect()}
    assert got == plain(rows, 1, 50)


def test_ties_are_ranked_by_bytes_and_empty_tables_give_nothing(spark):
    rows = [("en", "a", " ".join(chr(k) for k in [*range(0x61, 0x7B), *range(0x3B1, 0x3CA), 0x1F600, 0xFFFD, *range(0x4E00, 0x4E20)]))] * 2 + [("en", "b", "a")]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    got = {tuple(r) for r in divergence.divergence(df, least=1).collect()}
    assert got == plain(rows, 1, 50)
    assert divergence.divergence(df.limit(0)).count() == 0


def test_probabilities_are_exact_beyond_longs(spark):
    big = 9 * 10**17
    (row,) = spark.range(1).select(divergence.probability(F.lit(big), F.lit(3 * big + 1), F.lit(10**9)).alias("p"), divergence.probability(F.lit(0), F.lit(0), F.lit(0)).alias("none")).collect()
    assert row.p == 1 + 10**9 * (big + 5) // (3 * big + 1 + 5 * 10**9) and row.none is None
