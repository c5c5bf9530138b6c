"""The operators with Python parts, against plain versions, round trips and held-out labels."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.llm import ftrl, media, quality, sentencepiece_trie, simhash, simple8b, toxicity
from timberline.llm import textvec as tv
from timberline.llm.components import connected_components
from timberline.llm.queries import vocabulary

xxhash = pytest.importorskip("xxhash")
DOC = "doc_id long, text string"
ODD = ["", None, " ", "a", "A b\tc", "  x  y z w v ", "ü" * 300 + " b c d e f " * 40, "é 🎉 日本\x00\x0b\x0c q", "w " * 30_000, "<|endoftext|> don't x́ İ ΣΑΣ ﬁ ①"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), DOC)


def random_texts(seed, n=150, alphabet="abcdehinorst  .,-_ABC\n01éüñ"):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 250))) for _ in range(n)]


# Kernels


def test_distinct_and_hash_collisions(monkeypatch):
    buf = np.frombuffer(b"aa b aa cc b ddddddddddd ddddddddddd ", np.uint8)
    starts, ends = tv.spans(buf != 32)
    for weak in (False, True):
        if weak:
            monkeypatch.setattr(tv, "mix", lambda h: h * np.uint64(0))
        first, place = tv.distinct(buf, starts, ends)
        words = [bytes(buf[s:e]) for s, e in zip(starts, ends)]
        assert [words[first[p]] for p in place] == words and len(first) == 4


def test_xxh64_equals_the_library():
    rng = random.Random(1)
    raw = bytes(rng.randrange(256) for _ in range(5000))
    starts = np.array([rng.randrange(4000) for _ in range(400)])
    ends = starts + np.array([rng.randrange(0, 900) if k % 2 else k // 4 for k in range(400)])
    got = simhash.xxh64(np.frombuffer(raw, np.uint8), starts, ends)
    assert [int(x) for x in got] == [xxhash.xxh64_intdigest(raw[a:b], 42) for a, b in zip(starts, ends)]


# SimHash


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def roots(n, links):
    p = list(range(n))

    def find(i):
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprints():
    texts = ODD + random_texts(2)
    assert [int(f) for f in simhash.fingerprints(texts)] == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("blocks, pairs", [(2, 1 << 21), (3, 1 << 21), (3, 100), (5, 1 << 21)])
def test_links_join_what_brute_force_joins(monkeypatch, blocks, pairs):
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    rng, fps = random.Random(3), set()
    for _ in range(150):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 4, 40])):
            x = base
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    keys, rows, home = (np.concatenate(x) for x in zip(*simhash.anchors(fps[:, None], simhash.block_bits(blocks), 4 // blocks)))
    order = np.argsort(keys.view(np.int64), kind="stable")
    a, b = simhash.links(keys[order], fps[rows][order], home[order])
    at = {int(x): k for k, x in enumerate(fps)}
    found = [(at[int(x)], at[int(y)]) for x, y in zip(a, b)]
    assert all(near[x, y] for x, y in found)
    assert roots(len(fps), found) == roots(len(fps), np.argwhere(near).tolist())


def test_near_duplicates(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefghijkl") + str(rng.randint(0, 99)) for _ in range(400)) for _ in range(12)]
    texts = list(ODD)
    for t in base:
        texts += [t] * rng.choice([1, 3])
        texts += [t + " tail" + str(k) for k in range(rng.choice([0, 5]))]
    rng.shuffle(texts)
    fps = np.array([plain_fingerprint(t) for t in texts], np.uint64)
    want = roots(len(texts), np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4).tolist())
    df = frame(spark, texts).withColumn("fp", F.lit(1)).withColumn("ID", F.lit(2))
    got = {r.doc_id: r for r in simhash.near_dedup_report(df).collect()}
    assert [got[k].component_id for k in range(len(texts))] == want
    assert [got[k].fingerprint for k in range(len(texts))] == [f"{int(f):016x}" for f in fps]
    stay = simhash.near_deduplicated(df)
    assert stay.columns == df.columns and sorted(r.doc_id for r in stay.collect()) == sorted(set(want))
    twice = simhash.near_deduplicated(df.union(df))
    assert sorted(r.doc_id for r in twice.collect()) == sorted(set(want))
    assert simhash.near_dedup_report(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(8)
    links = [(k, k + 1) for k in range(60)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(150)] + [(5, 5), (None, 3)]
    got = {r.v: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(301, [(a, b) for a, b in links if a is not None])
    assert got == {v: want[v] for a, b in links if a is not None and a != b for v in (a, b)}


# Token ids


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 239, 240, 241, 5000, 300_000):
        for high in (1, 2, 50_000, 1 << 31, 1 << 63):
            v = rng.integers(0, high, n, dtype=np.uint64)
            if n > 100 and high == 2:
                v[10 : n // 2] = 0
            if n and high == 1 << 31:
                v[n // 2] = (1 << 64) - 1
            words, blocks = simple8b.pack(v)
            assert (simple8b.unpack(words) == v).all() and len(blocks) == -(-n // simple8b.BLOCK)
            f = simple8b.IdFile.from_bytes(simple8b.IdFile.of(np.arange(3), np.array([0, n // 2, n - n // 2]), v).to_bytes())
            assert (f.document(1) == v[: n // 2]).all() and (f.document(2) == v[n // 2 :]).all() and not len(f.document(0))
    words, _ = simple8b.pack(np.full(4096, 30_000, np.uint64))
    assert len(words) == 1024
    with pytest.raises(ValueError):
        simple8b.IdFile.from_bytes(b"x" * 100)


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    texts = ODD + random_texts(5) + ["héllo, wörld!! 12ab3 ÿ'd ×÷ µ ª a's 's!", "``~~ <> '' a.b.c We'll"]
    library = Tokenizer.from_file(path)
    want, start = {}, 0
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want[k] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    df = frame(spark, texts).repartition(5)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in simple8b.encode_report(df, path).collect()}
    assert got == want
    files = simple8b.write_ids(df, simple8b.new_folder(spark, "t"), path, file_values=2000)
    assert files.count() > 3 and files.agg(F.sum("n_values")).first()[0] == start
    rows = {r.doc_id: r for r in simple8b.document_ids(files).collect()}
    assert all(rows[k].start == w[0] and len(rows[k].ids) == w[1] for k, w in want.items())
    assert simple8b.encode_report(df.limit(0), path).count() == 0


# SentencePiece


def test_sentencepiece_equals_the_library(spark):
    path = vocabulary("piece_bpe_32k.model")
    texts = ODD + random_texts(6) + ["  Hello   world  x\n\ny \t", "   " * 40, "don't; {x}==[y]\\n #include <stdio.h>\n    for (int i=0;;)"]
    library = sentencepiece_trie.Vocabulary(path).library
    out = sentencepiece_trie.encoded(frame(spark, texts).withColumn("IDS", F.lit(1)), path)
    assert out.columns == ["doc_id", "text", "ids"]
    rows = {r.doc_id: r.ids for r in out.collect()}
    assert all(rows[k] == library.encode(t or "") for k, t in enumerate(texts))
    back = {r.doc_id: r.back for r in sentencepiece_trie.decoded(out, path, out="back").collect()}
    assert all(back[k] == (t or "") for k, t in enumerate(texts))
    for r in sentencepiece_trie.report(frame(spark, texts), path).collect():
        t = texts[r.doc_id] or ""
        assert r.same and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() and r.n_tokens == len(rows[r.doc_id])
    assert sentencepiece_trie.encoded(frame(spark, texts).limit(0), path).count() == 0


def test_unigram_pass_equals_the_whole_lattice():
    """The best score over all segmentations, by enumeration."""

    class Tiny:
        kind, floor = sentencepiece_trie.UNIGRAM, -30.0
        unknown, bytes = 0, {}
        scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.9, "▁a": -4.0, "ba": -4.2, "aba": -6.0, "bab": -9.0}
        pieces = {p: k + 1 for k, p in enumerate(scores)}
        suffixes = {p[k:] for p in scores for k in range(len(p))}
        spell = sentencepiece_trie.Vocabulary.spell

    v = Tiny()
    names = {k: p for p, k in v.pieces.items()}

    def best(word):
        if not word:
            return 0.0
        options = [v.scores[word[:n]] + best(word[n:]) for n in range(1, len(word) + 1) if word[:n] in v.scores]
        return max([*options, v.floor + best(word[1:])])

    rng = random.Random(9)
    words = sorted({"▁" + "".join(rng.choice("abz") for _ in range(rng.randint(0, 7))) for _ in range(200)})
    for word, ids in zip(words, sentencepiece_trie.Segmenter(v).words(words)):
        if "z" not in word:
            assert "".join(names[i] for i in ids) == word
            assert sum(v.scores[names[i]] for i in ids) == pytest.approx(best(word))
        else:
            assert 0 in ids and not any(a == b == 0 for a, b in zip(ids, ids[1:]))


# Media


def test_media_round_trip(spark):
    texts = ODD + ["x" * n for n in (63, 64, 65, 1024, 16_384, 16_385, 100_000)]
    rows = {r.doc_id: r for r in media.media_report(media.stored(frame(spark, texts).withColumn("Media", F.lit(1)))).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-64:]) and r.media_sha256 == hashlib.sha256(media.mux(padded)).hexdigest()
        assert r.feature.startswith(f"raw;{len(padded)}/8000;")
    assert (rows[0].media_sha256, rows[0].feature) == (rows[1].media_sha256, rows[1].feature)
    assert media.media_report(media.stored(frame(spark, texts).limit(0))).count() == 0


def test_media_walker(spark):
    data = media.mux(bytes(range(256)) * 200)
    (t,) = media.tracks(data)
    assert t.duration == 51_200 and len(t.sizes) == 50 and t.keyframes[0].tolist() == [int(t.offsets[k]) for k in (0, 16, 32, 48)]
    assert t.keyframes[1].tolist() == [1024] * 4 and t.times[-1] == 49 * 1024
    # The same tables in other forms: a 64-bit box, one box to the end, compact sizes, no sync table.
    ftyp, rest = data[:28], data[28:]
    size = int.from_bytes(rest[:4], "big")
    moov, mdat = rest[8:size], rest[size + 8 :]
    wide = ftyp + b"\0\0\0\1moov" + (len(moov) + 16).to_bytes(8, "big") + moov + b"\0\0\0\0mdat" + mdat
    assert len(media.tracks(wide)[0].sizes) == 50
    assert media._sizes(b"\0\0\0\0\0\0\0\x04\0\0\0\x03\x12\x30", 0, 14, True).tolist() == [1, 2, 3]
    for bad in (b"", b"junk", data[:-1], data[:100], ftyp + b"\0\0\0\4moov"):
        if bad:
            with pytest.raises(media.BadMedia):
                media.tracks(bad)
    rows = [(1, bytearray(data)), (2, bytearray(b"junk")), (3, None)]
    got = media.media_columns(spark.createDataFrame(rows, "k int, media binary")).orderBy("k").collect()
    assert got[0].tracks[0].codec == "raw " and len(got[0].tracks[0].keyframes) == 4 and got[1].tracks is None and got[2].tracks is None


# Scores


def words(rng, n):
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_quality_learns(spark):
    rng = random.Random(11)
    rows = []
    for k in range(600):
        bad = k % 5 == 0
        text = words(rng, rng.randint(5, 80))
        rows.append((k, text.replace(" ", "!!! ") if bad and k % 2 else " ".join([text.split()[0]] * 30) if bad else text, int(not bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    docs = df.select("doc_id", "text").union(frame(spark, [None, ""]).withColumn("doc_id", F.col("doc_id") - 10))
    labels = df.select("doc_id", F.col("label").alias("quality"))
    got = {r.doc_id: r for r in quality.quality_report(docs, labels).collect()}
    out = [k for k in range(600) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert len(got) == 602 and all(got[k].held_out == (k in set(out)) for k in range(600))
    assert np.mean([got[k].predicted == rows[k][2] for k in out]) > 0.97
    assert got[-10].score == got[-9].score and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    none = quality.quality_report(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and quality.quality_report(docs.limit(0), labels).count() == 0


def test_lines_of_restoration():
    rng = random.Random(12)
    corpus = [words(rng, 60) + " stupid loser idiot moron clown trash " for _ in range(200)]
    lm = toxicity.costs(toxicity.gram_counts(corpus).astype(float))
    p = np.exp(-lm.reshape(-1, toxicity.SYMBOLS)).sum(1)
    assert np.allclose(p, 1, atol=1e-3)
    restorer = toxicity.Restorer(lm)
    disguises = {"1d10t": b"idiot", "m0r0n": b"moron", "cl0wn": b"clown", "l0s3r": b"loser", "tr@sh": b"trash", "stuuupid": b"stupid", "i d i o t": b"idiot", "i.d.i.o.t": b"idiot", "$tup1d": b"stupid"}
    for text, want in disguises.items():
        (_, _, out) = next(restorer([f"bada {text} mola"]))
        assert out == [b"bada " + want + b" mola"], text
    plain = ["bada mola, 4370598173842409!", "12.5 (a) b", "Of%%% athe*** ndreea$$$", "", None]
    for text, (_, _, out) in ((t, next(restorer([t]))) for t in plain):
        assert out == [(text or "").lower().encode()]


def test_toxicity_learns(spark):
    rng = random.Random(13)
    bad = ["stupid", "loser", "idiot", "moron", "clown", "trash"]
    rows = []
    for k in range(900):
        text = words(rng, rng.randint(3, 60)).split()
        if k % 6 == 0:
            for _ in range(rng.randint(1, 3)):
                text.insert(rng.randint(0, len(text)), rng.choice(bad))
        rows.append((k, " ".join(text), int(k % 6 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", F.col("label").alias("toxic"))
    got = {r.doc_id: r for r in toxicity.toxicity_report(docs, labels).collect()}
    out = [k for k in range(900) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(got[k].held_out == (k in set(out)) for k in range(900))
    assert np.mean([got[k].predicted == rows[k][2] for k in out]) > 0.98
    judge = toxicity.Toxicity(docs, labels)
    hidden = ["bada mola 1d10t st00pid rato", "m0r0n i d i o t", None, "", "bada mola rato"]
    assert [r.predicted for r in judge.score(frame(spark, hidden)).orderBy("doc_id").collect()] == [1, 1, 0, 0, 0]
    kept = judge.accepted(frame(spark, hidden).withColumn("Score", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "Score"] and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert toxicity.toxicity_report(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in toxicity.toxicity_report(docs, labels.limit(0)).collect()} == {0}


def test_ftrl_finds_a_plane():
    rng = np.random.default_rng(3)
    s = ftrl.Settings(bits=12, alpha=0.3, l1=0.0)
    learner, keys = ftrl.Learner(s), (np.arange(1, 9, dtype=np.uint64) << np.uint64(54)) + np.uint64(5)
    w = rng.normal(size=8)
    for _ in range(4000):
        x = rng.normal(size=8)
        learner.learn(keys, x, int(x @ w > 0))
    got = learner.weights((keys >> np.uint64(52)).astype(int))
    assert np.corrcoef(got, w)[0, 1] > 0.99
