"""Byte-level BPE against the tiktoken library on whole texts."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.llm import byte_bpe
from timberline.llm.queries import vocabulary

from .test_python import ODD, frame, random_texts

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(vocabulary("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def hard_texts():
    """Texts on which scans meet late or nowhere: long runs of one kind, spaces, apostrophes."""
    rng = random.Random(1)
    parts = ["a", " ", "'s", "'re", "'", "\n\n", "1", "é", "!?", "日", "\t ", " 'll", " ", " "]
    texts = ["".join(rng.choice(parts) * rng.choice([1, 1, 2, 9, 70]) for _ in range(rng.randint(50, 700))) for _ in range(25)]
    return [*texts, "x" * 5000, " " * 3000 + "y", "'s" * 2000, "'" * 2000, "ab " * 900 + "z" * 900 + " cd" * 500, " \n" * 1200, "7" * 999 + "a" * 999 + "!" * 999]


@pytest.mark.parametrize("step, overlap", [(16_384, 1_024), (100, 40), (61, 20)])
def test_ids_and_bytes_equal_the_library(spark, monkeypatch, library, step, overlap):
    monkeypatch.setattr(byte_bpe, "STEP", step)
    monkeypatch.setattr(byte_bpe, "OVERLAP", overlap)
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    texts = [*ODD, *random_texts(3, 40), *hard_texts()]
    df = frame(spark, texts).withColumn("K", F.lit("x")).withColumn("Rest", F.col("doc_id") * 2).withColumn("IDS", F.lit(None).cast("int"))
    coded = byte_bpe.encoded(df, path, PATTERN)
    assert coded.columns == ["doc_id", "K", "Rest", "ids"]
    rows = {r.doc_id: r for r in byte_bpe.decoded(coded, path, PATTERN).collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        assert rows[k].ids == library.encode_ordinary(t or ""), k
        assert bytes(rows[k].bytes) == (t or "").encode() and rows[k].Rest == 2 * k
    got = {r.doc_id: r for r in byte_bpe.report(df, path, PATTERN).collect()}
    for k, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == want


def test_scans_meet_where_neighbours_agree_only_after_merging(spark, monkeypatch, library):
    """A chunk within a long run is merged, and so is what follows a run that ends between chunks."""
    monkeypatch.setattr(byte_bpe, "STEP", 50)
    monkeypatch.setattr(byte_bpe, "OVERLAP", 20)
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    texts = ["a" * n + " b" * m for n in (0, 69, 70, 71, 120, 400) for m in (0, 1, 30, 200)] + [("q" * 77 + " ") * 30]
    rows = {r.doc_id: r.ids for r in byte_bpe.encoded(frame(spark, texts), path, PATTERN).collect()}
    assert all(rows[k] == library.encode_ordinary(t) for k, t in enumerate(texts))


def test_repeated_rows_null_ids_and_empty_tables(spark, library):
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    long = "word " * 9000
    df = spark.createDataFrame([(1, long), (1, long), (None, long), (None, None), (2, "a"), (2, "a")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in byte_bpe.report(df, path, PATTERN).collect())
    n = len(library.encode_ordinary(long))
    assert got == [(0, 0), (0, n), (1, n), (1, n), (2, 1), (2, 1)]
    assert byte_bpe.report(df.limit(0), path, PATTERN).count() == 0 and byte_bpe.encoded(df.limit(0), path, PATTERN).count() == 0


def test_patterns_with_groups_and_gaps(spark):
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    coder = byte_bpe.Coder(path, r"(\w)(\w*)|[.]")
    tokens, starts = coder.cut("ab  c.!d")
    assert tokens == ["ab", "c", ".", "d"] and starts.tolist() == [0, 4, 5, 7]


def test_a_text_of_millions_of_characters(spark, library):
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    rng = random.Random(2)
    text = "".join(rng.choice(["the ", "éa ", "\n", "1234 ", "don't "]) for _ in range(700_000))
    (row,) = byte_bpe.report(spark.createDataFrame([(1, text)], "doc_id long, text string"), path, PATTERN).collect()
    assert row.ids_sha256 == hashlib.sha256(np.array(library.encode_ordinary(text), "<u4").tobytes()).hexdigest()
