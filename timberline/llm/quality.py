"""Quality scores: logistic regression over hashed word n-grams.

A text is cut into runs of word characters and runs of other marks, lower-cased.
N-grams whose first and last words are equal also count as a pattern of their own,
whatever the word. Each n-gram's feature is its share of the text's n-grams times a constant, so that a score
is one sparse dot product and texts of any length are on one scale.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .ftrl import Model, Settings, sigmoid, train
from .runtime import ship

SETTINGS = Settings(bits=20, alpha=1.0, l1=0.02, l2=0.001)
SCALE = 40.0
GRAMS = 2
#: Distances at which a word that comes again is a pattern.
REPEATS = (1, 2)
THRESHOLD = 0.7

#: 0 white space, 1 word characters, then each other mark as a class of its own.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[tv.WORD] = 1
_KIND[tv.SPACE] = 0
_KIND[(_KIND == 1) & ~tv.WORD] = 2


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of all texts, their texts, and the number in each text."""
    buf, bounds = tv.joined(texts)
    starts, ends = tv.class_spans(_KIND[buf])
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    h = tv.Hasher(buf)(starts, ends)
    doc = np.searchsorted(bounds, starts, "right") - 1
    hashes, docs = [h], [doc]
    for n in range(2, GRAMS + 1):
        same = doc[n - 1 :] == doc[: 1 - n]
        h = tv.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[0][n - 1 :])
        hashes.append(h[same])
        docs.append(doc[: 1 - n][same])
    for n in REPEATS:
        again = np.flatnonzero((hashes[0][n:] == hashes[0][:-n]) & (doc[n:] == doc[:-n]))
        hashes.append(np.full(len(again), tv.mix(np.full(1, n, np.uint64))[0]))
        docs.append(doc[again])
    doc = np.concatenate(docs)
    return np.concatenate(hashes), doc, np.bincount(doc, minlength=len(texts))


def _lower(texts: list[str | None]) -> list[bytes]:
    return [(t or "").lower().encode() for t in texts]


def features(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    raw, out = _lower(texts), []
    for x, y in tv.chunks(raw):
        h, doc, n = grams(raw[x:y])
        h = h[np.argsort(doc, kind="stable")]
        for a, k in zip((np.cumsum(n) - n).tolist(), n.tolist(), strict=True):
            keys, counts = np.unique(h[a : a + k], return_counts=True)
            # Two hashes of one slot would overwrite each other; one of them stands for both.
            _, first, place = np.unique(keys >> np.uint64(64 - SETTINGS.bits), return_index=True, return_inverse=True)
            out.append((keys[first], np.bincount(place, counts, minlength=len(first)) * (SCALE / max(k, 1))))
    return out


def scores(model: Model, table: np.ndarray, texts: list[str | None]) -> np.ndarray:
    raw = _lower(texts)
    out = np.full(len(raw), model.bias)
    for a, b in tv.chunks(raw):
        h, doc, n = grams(raw[a:b])
        at, place = model.find(h, table)
        out[a:b] += np.bincount(doc[at], model.weights[place], minlength=b - a) * (SCALE / np.maximum(n, 1))
    return sigmoid(out)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted) of each row; null texts count as empty and get the score of no words."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.filter_table()
        for b in tv.slices(batches):
            s = scores(shared.value, table, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    rows = df.select(df[id_col], df[text_col])
    return rows.mapInArrow(run, f"{id_col} {rows.schema[0].dataType.simpleString()}, score double, predicted int")


def held_out(id_col: str, parts: int, part: int):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def quality_model(docs: DataFrame, labels: DataFrame, settings: Settings = SETTINGS) -> Model:
    ship(docs.sparkSession)
    return train(docs, labels, "doc_id", "text", F.col("quality"), features, settings)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted; labels of held-out rows are never read.

    One row for each input row: null and empty texts get the score of no words, repeated
    rows equal scores, a null id is not held out. Labels that are null, or of ids that
    are null or in no row, teach nothing; without any, every score is 0.5. An empty
    table gives no rows; other columns, of any names, are not read.
    """
    model = quality_model(docs, labels.filter(~held_out("doc_id", 4, 2)))
    return score(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")
