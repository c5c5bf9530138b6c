"""Nulls, ties, repeated rows, very long texts and other files, against plain versions."""

import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.llm import ftrl, media, quality, simple8b, toxicity
from timberline.llm.queries import vocabulary

from .test_python import ODD, frame, random_texts, words


def test_ids_of_another_tokenizer_file(spark):
    """A file with other rules is coded by the library as a whole."""
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    texts = ODD + random_texts(5) + ["  Two  spaces\n\tand Tabs", "<|endoftext|> x"]
    library = Tokenizer.from_file(path)
    rows = {r.doc_id: r for r in simple8b.document_ids(simple8b.write_ids(frame(spark, texts), simple8b.new_folder(spark, "t"), path, end_id=None)).collect()}
    for k, t in enumerate(texts):
        assert [int(i) for i in rows[k].ids] == library.encode(t or "", add_special_tokens=False).ids
    assert not simple8b.word_coder(path, None).by_piece and simple8b.word_coder(vocabulary("word_bpe_49k.json"), 2).by_piece


def test_ids_of_rows_without_or_with_equal_ids(spark):
    path = vocabulary("word_bpe_49k.json")
    df = spark.createDataFrame([(None, "b"), (None, None), (5, "b"), (5, "a"), (5, "a"), (-(1 << 63), "a b c")], "doc_id long, text string").withColumn("start", F.lit("x")).withColumn("IDS", F.lit(1))
    got = simple8b.encode_report(df, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -(1 << 63), 5, 5, 5]
    assert [r.n_tokens for r in got] == [1, 2, 4, 2, 2, 2] and [r.start for r in got] == [0, 1, 3, 7, 9, 11]
    assert got[3].ids_crc32 == got[4].ids_crc32 != got[5].ids_crc32


def test_every_file_is_a_task(spark):
    df = frame(spark, random_texts(5)).repartition(3)
    files = simple8b.write_ids(df, simple8b.new_folder(spark, "t"), vocabulary("word_bpe_49k.json"), file_values=2000)
    assert simple8b.ids_report(files).rdd.getNumPartitions() == files.count() > 3


def plain_ftrl(rows, s):
    """One weight at a time, from the published updates, over (features, label) rows."""
    z, n, bias, bias_n = {}, {}, s.bias or 0.0, 0.0

    def weight(k):
        if abs(z.get(k, 0.0)) <= s.l1:
            return 0.0
        return (math.copysign(s.l1, z[k]) - z[k]) / ((s.beta + math.sqrt(n[k])) / s.alpha + s.l2)

    for x, label in rows:
        w = {k: weight(k) for k in x}
        p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items()) - bias))
        for k, v in x.items():
            g = (p - label) * v
            sigma = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / s.alpha
            z[k] = z.get(k, 0.0) + g - sigma * w[k]
            n[k] = n.get(k, 0.0) + g * g
        bias_n += (p - label) ** 2
        bias -= s.alpha * (p - label) / (s.beta + math.sqrt(bias_n))
    return {k: weight(k) for k in z}, bias


def test_weights_and_scores_equal_plain_ftrl():
    """The same rows in the same order give the same weights, and dot products the same scores."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice("good fine bad poor text of a kind".split()) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    labels = [int("good" in t and rng.random() < 0.9) for t in texts]
    s = quality.SETTINGS
    found = quality.features(texts)
    learner = ftrl.Learner(s)
    for (keys, values), label in zip(found, labels, strict=True):
        learner.learn(keys, values, label)
    want, bias = plain_ftrl([(dict(zip(k.tolist(), v.tolist(), strict=True)), y) for (k, v), y in zip(found, labels, strict=True)], s)
    keys = np.array(sorted(want), np.uint64)
    got = learner.weights(learner.slots.of(keys))
    assert np.allclose(got, [want[int(k)] for k in keys], atol=1e-9) and abs(learner.bias - bias) < 1e-9
    held = [int(k) for k in keys if want[int(k)]]
    model = ftrl.Model(np.array(held, np.uint64), np.array([want[k] for k in held]), np.zeros(len(held)), bias, 0.0)
    # Scores of texts never seen, from n-grams counted one by one.
    new = ["good text", "bad poor", "", None, "good good of a kind fine " * 400]
    plain = []
    for keys, values in quality.features(new):
        plain.append(1 / (1 + math.exp(-sum(want.get(int(k), 0.0) * v for k, v in zip(keys, values, strict=True)) - bias)))
    assert np.allclose(quality.scores(model, model.filter_table(), new), plain, atol=1e-9)


def test_quality_of_odd_rows(spark):
    """Repeated rows, very long texts, ids without labels and columns of any name."""
    rng = random.Random(4)
    long = words(rng, 150_000)
    rows = [(k, words(rng, 20) + ("!!!" * 9 if k % 2 else "")) for k in range(60)] + [(100, long), (100, long), (101, None), (None, "x"), (102, long + "!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("old")).withColumn("LABEL", F.lit(1)).withColumn("shard", F.lit(2))
    labels = spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(60)] + [(0, 1), (None, 1), (7, None)], "doc_id long, quality int").withColumn("text", F.lit("no"))
    got = quality.quality_report(docs, labels).collect()
    assert len(got) == len(rows)
    same = [r.score for r in got if r.doc_id == 100]
    assert len(same) == 2 and same[0] == same[1] and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]


def test_ties_at_the_threshold(spark):
    model = ftrl.Model(bias=math.log(0.7 / 0.3))
    row = quality.score(frame(spark, ["a"]), model, threshold=float(ftrl.sigmoid(np.array([model.bias]))[0])).first()
    assert row.predicted == 1


def test_restoration_equals_enumeration():
    """Every path through the lattice of short tokens is tried; no state is cut."""
    rng = random.Random(5)
    corpus = [words(rng, 60) + " stupid loser idiot moron clown trash " for _ in range(100)]
    lm = toxicity.costs(toxicity.gram_counts(corpus).astype(float))
    base = toxicity.SYMBOLS**3

    def cost(emitted):
        state, total = 0, 0.0
        for c in emitted + " ":
            gram = state * toxicity.SYMBOLS + (ord(c) - 96 if "a" <= c <= "z" else 0)
            total, state = total + float(lm[gram]), gram % base
        return total

    def ways(token, i):
        c = token[i]
        run = 1
        while i - run >= 0 and token[i - run] == c:
            run += 1
        long_run = run >= 3 or (run == 2 and i + 1 < len(token) and token[i + 1] == c)
        absorb = [("", toxicity.ABSORB if long_run else toxicity.ABSORB_DOUBLE)] if run > 1 else []
        if "a" <= c <= "z":
            return [(c, toxicity.KEEP_REPEAT if long_run else 0.0), *absorb]
        if c in toxicity.LEET:
            return [*((x, toxicity.SWAP) for x in toxicity.LEET[c]), (c, toxicity.KEEP_SIGN), *absorb]
        if c in toxicity.SEPARATORS:
            return [("", toxicity.SKIP), (c, toxicity.KEEP_SEPARATOR)]
        return [(c, 0.0)]

    tokens = ["1d10t", "l0$3r", "1!|1!|", "!!!d", "16|7!", "m.0.r", "iii1", "a-b-1", "917!6"] + ["".join(rng.choice("aidot01!6|.") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    for token in tokens:
        paths = [(sum(x[1] for x in p) + cost("".join(x[0] for x in p)), "".join(x[0] for x in p)) for p in itertools.product(*(ways(token, i) for i in range(len(token))))]
        least = min(paths)[0]
        got = toxicity.restore(token, lm)
        assert got in {t for c, t in paths if c < least + 1e-4}, token


def test_restoration_of_a_long_token():
    """Time and memory grow with the token: half a million spaced letters and signs."""
    rng = random.Random(6)
    lm = toxicity.costs(toxicity.gram_counts([words(rng, 2000)]).astype(float))
    token = " ".join(rng.choice("abcdei1!06") for _ in range(250_000))
    out = toxicity.restore(token, lm)
    assert len(out) <= len(token)


def test_toxicity_of_odd_rows(spark):
    rng = random.Random(7)
    rows = [(k, words(rng, 20) + (" stupid" if k % 3 == 0 else "")) for k in range(90)] + [(200, "stupid"), (200, "stupid"), (201, None), (None, "stupid"), (202, words(rng, 150_000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("x")).withColumn("Label", F.lit(1))
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(90)] + [(None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity_report(docs, labels).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id in (200, None)}) == 1


def test_media_of_repeated_rows_and_columns(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (2, "x" * 3_000_000)], "doc_id long, text string").withColumn("MEDIA", F.lit(1)).withColumn("tracks", F.lit(2))
    rows = media.media_report(media.stored(df)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_bytes) for r in rows if r.doc_id) == [(False, 1, 1), (False, 1, 1), (False, 2, 3_000_000)] and len(rows) == 4
    assert len({r.media_sha256 for r in rows}) == 3 and zlib.crc32(b"b" + bytes(63)) in {r.tail_crc32 for r in rows}
