"""Byte-level BPE by ranks: long texts are pre-tokenised as overlapping chunks in parallel.

A pre-token depends on the place where it starts and on what follows it alone. So two
scans of a text that start a pre-token at one place agree from there on. Texts longer
than a chunk are cut into chunks that overlap; each chunk is scanned from its own
start, wherever that falls, and the first pre-token start that two neighbours share in
their overlap is where the scan of the second takes over. Chunks without such a place,
as in one long run of letters, are merged and looked at again. The pieces between those
places are encoded by as many tasks as there are chunks, each distinct pre-token once a
worker, and a document's ids are its pieces' ids in order.

Decoding looks up and concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .runtime import BROADCAST_ROWS, ship, written

#: Characters of a chunk without its overlap, and of the overlap.
STEP = 16_384
OVERLAP = 1_024
#: Characters after its end that a match of the pattern may look at; where they are cut off, its end proves nothing.
LOOKS = 16
#: Characters that become Python objects and Arrow columns at once.
AT_ONCE = 1 << 20


class Coder:
    """Ids of texts by a file of ranks, and bytes of ids."""

    def __init__(self, path: str, pattern: str, limit: int = 300_000):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.model = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        surfaces = [b""] * (max(ranks.values()) + 1)
        for raw, k in ranks.items():
            surfaces[k] = raw
        self.surface = np.frombuffer(b"".join(surfaces), np.uint8)
        self.surface_at = np.cumsum([0, *map(len, surfaces)])
        self.limit = limit
        self.cache = tv.Ragged(np.uint32, limit)

    def cut(self, text: str, at: int = 0) -> tuple[list[str], np.ndarray]:
        """The pre-tokens from ``at`` on, and where they start."""
        tokens = self.pattern.findall(text, at) if not self.pattern.groups else []
        starts = at + np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
        if len(text) > at and not (len(starts) and starts[-1] == len(text)):
            # The pattern leaves characters out, or has groups.
            found = [m for m in self.pattern.finditer(text, at) if m.end() > m.start()]
            return [m.group() for m in found], np.fromiter((m.start() for m in found), np.int64, len(found))
        return tokens, np.r_[at, starts[:-1]] if len(starts) else starts

    def ids(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens one after another, and how many each has."""
        if self.cache.n > self.limit:
            self.cache.clear()
        index = self.cache.index
        new = [t for t in dict.fromkeys(tokens) if t not in index]
        if new:
            self.cache.add_all(new, [self.model._encode_single_piece(t) for t in new])
        return self.cache.gather(np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens)))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        tokens: list[str] = []
        ends = [0]
        for t in texts:
            tokens += self.cut(t)[0]
            ends.append(len(tokens))
        ids, counts = self.ids(tokens)
        return ids, np.diff(np.r_[0, np.cumsum(counts)][ends])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each row's ids."""
        ids = ids.astype(np.int64)
        sizes = self.surface_at[ids + 1] - self.surface_at[ids]
        data = self.surface[tv.ranges(self.surface_at[ids], sizes)].tobytes()
        ends = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(counts)]].tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def clear(self) -> None:
        self.cache.clear()
        tv.trim()


_coders: dict[tuple[str, str], Coder] = {}


def coder(path: str, pattern: str) -> Coder:
    """One for each Python worker."""
    key = path, pattern
    if key not in _coders:
        _coders[key] = Coder(path, pattern)
    return _coders[key]


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids.astype(np.int32)))


def _runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``AT_ONCE`` characters, or one text."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > AT_ONCE:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


# Chunks of long texts


def _chunks(long: DataFrame) -> DataFrame:
    """(key, k, m, last, text, rest) of a table of (text, rest): the chunk at ``k`` steps holds ``m`` steps and the overlap after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for b in tv.slices(batches):
            for row in range(b.num_rows):
                text = b.column(0)[row].as_py()
                n = max(1, -(-(len(text) - OVERLAP) // STEP))
                some = max(1, AT_ONCE // STEP)
                for a in range(0, n, some):
                    ks = list(range(a, min(n, a + some)))
                    rest = b.column(1).take(pa.array([row if k == 0 else None for k in ks], pa.int64()))
                    cut = [text[k * STEP : (k + 1) * STEP + OVERLAP] for k in ks]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(ks)), pa.array(ks), pa.array([1] * len(ks)), pa.array([k == n - 1 for k in ks]), pa.array(cut, pa.string()), rest], names)
                key += 1

    fields = "key long, k long, m long, last boolean, text string"
    schema = T.StructType([*T._parse_datatype_string(fields).fields, T.StructField("rest", long.schema["rest"].dataType)])
    names = schema.names
    return written(long.mapInArrow(run, schema), "bpe-chunks")


def _meetings(chunks: DataFrame, path: str, pattern: str) -> DataFrame:
    """(key, k, p): where a pre-token starts by the scans of both chunks, counted from the step ``k`` that the second starts at; null if nowhere in the overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in tv.slices(batches):
            keys, at, starts = [], [], []
            for key, k, m, last, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                s = c.cut(text)[1]
                if k:
                    keys.append(key), at.append(k), starts.append(s[s <= OVERLAP])
                if not last:
                    keys.append(key), at.append(k + m), starts.append(s[(s >= m * STEP) & (s <= len(text) - LOOKS)] - m * STEP)
            if keys:
                flat = np.concatenate(starts)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(at), _lists(flat, np.array([len(s) for s in starts]))], ["key", "k", "starts"])

    scans = chunks.select("key", "k", "m", "last", "text").mapInArrow(run, "key long, k long, starts array<int>")
    both = scans.groupBy("key", "k").agg(F.collect_list("starts").alias("s"))
    return both.select("key", "k", F.array_min(F.array_intersect(F.col("s")[0], F.col("s")[1])).cast("long").alias("p"))


def _merged(chunks: DataFrame, meetings: DataFrame) -> DataFrame:
    """Chunks with those of no meeting place appended to the one before."""
    from pyspark.sql import Window

    bare = chunks.select("key", "k").join(meetings, ["key", "k"], "left")
    heads = F.when((F.col("k") == 0) | F.col("p").isNotNull(), F.col("k"))
    runs = bare.select("key", "k", F.max(heads).over(Window.partitionBy("key").orderBy("k")).alias("run"))
    parts = chunks.join(runs, ["key", "k"]).groupBy("key", "run").agg(
        F.sort_array(F.collect_list(F.struct("k", "m", "last", "text"))).alias("parts"), F.max_by("rest", F.when(F.col("rest").isNotNull(), 1)).alias("rest")
    )
    text = F.array_join(F.transform("parts", lambda x, i: F.when(i == 0, x["text"]).otherwise(F.substring(x["text"], OVERLAP + 1, 1 << 30))), "")
    return parts.select(
        "key", F.col("run").alias("k"), F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["m"]).alias("m"),
        F.exists("parts", lambda x: x["last"]).alias("last"), text.alias("text"), "rest",
    )


def _stitched(chunks: DataFrame, path: str, pattern: str) -> DataFrame:
    """Chunks with ``start`` and ``stop``, the places where the text's own scan enters and leaves them (``stop`` null: its end)."""
    done = None
    while True:
        meetings = written(_meetings(chunks, path, pattern), "bpe-meetings")
        stuck = written(meetings.filter("p is null").select("key").distinct(), "bpe-stuck")
        some = not stuck.isEmpty()
        small = meetings.count() <= BROADCAST_ROWS
        hint = F.broadcast if small else (lambda x: x)
        whole = chunks.join(stuck, "key", "left_anti") if some else chunks
        enter = meetings.select("key", "k", F.col("p").alias("start"))
        leave = meetings.select("key", F.col("k").alias("next"), F.col("p").alias("p"))
        found = (
            whole.withColumn("next", F.col("k") + F.col("m"))
            .join(hint(enter), ["key", "k"], "left")
            .join(hint(leave), ["key", "next"], "left")
            .select("key", "k", "rest", "text", F.coalesce("start", F.lit(0)).alias("start"), (F.col("p") + F.col("m") * STEP).alias("stop"))
        )
        done = found if done is None else done.unionByName(found)
        if not some:
            return done
        again = chunks.join(stuck, "key", "left_semi")
        chunks = written(_merged(again, meetings), "bpe-chunks")


def _pieces(df: DataFrame, text_col: str, path: str, pattern: str) -> DataFrame:
    """(key, k, rest, ids) of the pieces of all texts longer than a chunk; ``rest`` holds the other columns and is null from the second piece on."""
    rest = F.struct(*[df[c] for c in df.columns if c != text_col], F.lit(0).alias("_"))
    long = df.filter(F.length(df[text_col]) > STEP + OVERLAP).select(df[text_col].alias("text"), rest.alias("rest"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in tv.slices(batches):
            tokens: list[str] = []
            ends = [0]
            for text, start, stop in zip(*(b.column(x).to_pylist() for x in (3, 4, 5)), strict=True):
                found, starts = c.cut(text, start)
                tokens += found if stop is None else found[: int(np.searchsorted(starts, stop))]
                ends.append(len(tokens))
            ids, counts = c.ids(tokens)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], _lists(ids, np.diff(np.r_[0, np.cumsum(counts)][ends]))], ["key", "k", "rest", "ids"])
        c.clear()

    stitched = _stitched(_chunks(long), path, pattern)
    schema = T.StructType([*(stitched.schema[c] for c in ("key", "k", "rest")), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return stitched.select("key", "k", "rest", "text", "start", "stop").mapInArrow(run, schema)


def encoded(df: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """The other columns of each row, and in place of its text ``out``, the ids of the whole text.

    Each match of ``pattern`` is encoded by itself, without special tokens. The pattern
    must not look behind a match's start, nor further than ``LOOKS`` characters behind
    its end. Null and empty texts have no ids; repeated rows are rows of their own; a
    column named like ``out`` is replaced, others may have any names; an empty table
    gives no rows. Ids and sources may be null or tie: nothing is grouped by them.
    """
    ship(df.sparkSession)
    df = df.select(*[c for c in df.columns if c.lower() != out.lower()])
    others = [c for c in df.columns if c != text_col]
    at = len(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in tv.slices(batches):
            texts = [t or "" for t in b.column(at).to_pylist()]
            for x, y in _runs(texts):
                yield pa.RecordBatch.from_arrays([*[v.slice(x, y - x) for v in b.columns[:at]], _lists(*c.encode(texts[x:y]))], [*others, out])
        c.clear()

    ids = T.StructField(out, T.ArrayType(T.IntegerType()))
    short = df.filter(F.coalesce(F.length(df[text_col]), F.lit(0)) <= STEP + OVERLAP).select(*[df[c] for c in others], df[text_col])
    coded = short.mapInArrow(run, T.StructType([*(df.schema[c] for c in others), ids]))
    pieces = _pieces(df, text_col, path, pattern).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("p"), F.max_by("rest", F.when(F.col("rest").isNotNull(), 1)).alias("rest"))
    whole = pieces.select(*[F.col("rest").getField(c).alias(c) for c in others], F.flatten(F.transform("p", lambda x: x["ids"])).alias(out))
    return coded.union(whole)


def decoded(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "bytes") -> DataFrame:
    """Adds ``out``, the raw bytes of each row's ids one after another; null ids count as none. A column of that name is replaced."""
    ship(df.sparkSession)
    df = df.select(*[c for c in df.columns if c.lower() != out.lower()])
    at = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tv.slices(batches):
            rows = [np.asarray(x if x is not None else [], np.int64) for x in b.column(at).to_pylist()]
            data = coder(path, pattern).decode(np.concatenate(rows) if rows else np.zeros(0, np.int64), np.array([len(r) for r in rows], np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(data, pa.binary())], [*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())]))


def _hashed(c: Coder, ids: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """The ids of each row as 32-bit little-endian integers, and the bytes they stand for."""
    data = ids.astype("<u4").tobytes()
    ends = (4 * np.r_[0, np.cumsum(counts)]).tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)], c.decode(ids, counts)


def report(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, and SHA-256 of the ids (32-bit little-endian) and of the bytes they decode to, for each row.

    Rows are as ``encoded`` has them. The digests of a long text are carried on from
    piece to piece, in order, so that no task holds a long text's ids.
    """
    ship(df.sparkSession)
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = rows.schema["id"]
    out = T.StructType([T.StructField(id_col, kind.dataType), *T._parse_datatype_string("n_tokens long, ids_sha256 string, decoded_sha256 string").fields])

    def row(ids: pa.Array, n: list[int], a: list[str], b: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], out.names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in tv.slices(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            for x, y in _runs(texts):
                ids, counts = c.encode(texts[x:y])
                raw, back = _hashed(c, ids, counts)
                yield row(b.column(0).slice(x, y - x), counts.tolist(), [hashlib.sha256(t).hexdigest() for t in raw], [hashlib.sha256(t).hexdigest() for t in back])
        c.clear()

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        now, rest, n, of_ids, of_bytes = None, None, 0, hashlib.sha256(), hashlib.sha256()
        for b in tv.slices(batches):
            values, counts = b.column(3).flatten().to_numpy(zero_copy_only=False), b.column(3).value_lengths().to_numpy(zero_copy_only=False)
            for i, (key, raw, back, size) in enumerate(zip(b.column(0).to_pylist(), *_hashed(c, values, counts), counts.tolist(), strict=True)):
                if key != now:
                    if now is not None:
                        yield row(rest, [n], [of_ids.hexdigest()], [of_bytes.hexdigest()])
                    now, rest, n, of_ids, of_bytes = key, b.column(2).field(0).slice(i, 1), 0, hashlib.sha256(), hashlib.sha256()
                of_ids.update(raw)
                of_bytes.update(back)
                n += size
        if now is not None:
            yield row(rest, [n], [of_ids.hexdigest()], [of_bytes.hexdigest()])
        c.clear()

    short = rows.filter(F.coalesce(F.length("text"), F.lit(0)) <= STEP + OVERLAP)
    pieces = _pieces(rows, "text", path, pattern)
    long = pieces.repartition("key").sortWithinPartitions("key", "k").mapInArrow(streamed, out)
    return short.mapInArrow(each, out).union(long)
