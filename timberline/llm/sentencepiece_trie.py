"""SentencePiece encoding by a forward pass over shared prefixes, and decoding.

Texts are cut into marked words, each with the space marks before it. The distinct
words of a chunk are sorted, which is the depth-first order of their trie; the pass
keeps one state for each character of the current word and, going to the next word,
keeps the states of the common prefix.

For a unigram model a state is the best score of the prefix and its last piece: the
Viterbi algorithm. A BPE model's scores are merge ranks, whose best sum is not what
its merges give. There the state is the last piece of the prefix's one segmentation in
which merging any two neighbours alone gives those two back, which is the result of
the merges; it too depends on the states before and the last piece alone.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame

from . import textvec as tv
from .runtime import ship

MARK = "▁"
UNIGRAM, BPE = 1, 2
#: Bytes of texts whose distinct words are sorted together: the more, the longer the prefixes that they share.
CHUNK_BYTES = 1 << 20
#: How far below the worst piece a character outside the vocabulary scores.
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}[kind] if kind != 2 else varint()
            yield tag >> 3, data[at : at + n]
            at += n


class Vocabulary:
    """What the model file says: pieces, scores, kind of model, spaces."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.library = sp
        spec = {n: dict(_fields(v)) for n, v in _fields(sp.serialized_model_proto()) if n in (2, 3)}
        self.kind = spec.get(2, {}).get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models")
        normaliser = spec.get(3, {})
        self.prefix = bool(normaliser.get(3, 1))
        self.plain = not normaliser.get(2) and not normaliser.get(4, 1) and bool(normaliser.get(5, 1))
        size = sp.get_piece_size()
        self.pieces: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        self.unknown = sp.unk_id()
        surfaces: list[bytes] = []
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                surfaces.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_unknown(i):
                surfaces.append(" ⁇ ".encode())
            elif sp.is_control(i):
                surfaces.append(b"")
            else:
                surfaces.append(piece.replace(MARK, " ").encode())
                if not sp.is_unused(i):
                    self.pieces[piece] = i
                    self.scores[piece] = sp.get_score(i)
        self.surface = np.frombuffer(b"".join(surfaces), np.uint8)
        self.surface_at = np.cumsum([0, *map(len, surfaces)])
        self.suffixes = {p[k:] for p in self.pieces for k in range(len(p))}
        # Words can be taken apart before a mark if no piece goes on over one.
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.pieces)
        self.floor = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY

    def spell(self, char: str) -> list[int]:
        """The ids of a character outside the vocabulary."""
        raw = char.encode()
        return [self.bytes[b] for b in raw] if len(self.bytes) == 256 else [self.unknown]


class Segmenter:
    """Segments sorted words, keeping the states of the common prefix."""

    def __init__(self, vocabulary: Vocabulary, limit: int = 300_000):
        self.v, self.limit = vocabulary, limit
        #: Left id * 2**24 + right id; left 0 is the start of a word.
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """What the merges of a BPE model make of a text."""
        parts, scores = list(text), self.v.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stays(self, left: str, right: str, key: int) -> bool:
        """Whether merging the two pieces' characters gives the two pieces."""
        if len(self.pairs) >= self.limit:
            self.pairs.clear()
        found = self.pairs[key] = self.merged(left + right) == ([left, right] if left else [right])
        return found

    def words(self, words: list[str]) -> Iterator[list[int]]:
        """The ids of each word; the words come sorted."""
        v, suffixes, pieces, bpe, pairs = self.v, self.v.suffixes, self.v.pieces, self.v.kind == BPE, self.pairs
        # For each prefix: the last piece's length and id (-1: a character outside the vocabulary), the score.
        size: list[int] = [0]
        last: list[int] = [0]
        score: list[float] = [0.0]
        before = ""
        for word in words:
            same = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                same += 1
            del size[same + 1 :], last[same + 1 :], score[same + 1 :]
            for i in range(same + 1, len(word) + 1):
                n, piece, best = 1, -1, score[i - 1] + v.floor
                for j in range(i - 1, -1, -1):
                    part = word[j:i]
                    if part not in suffixes:
                        break
                    k = pieces.get(part)
                    if k is None:
                        continue
                    if bpe:
                        if last[j] < 0:
                            # Nothing merges over an unknown character: the piece must stand alone.
                            key, left = k, ""
                        else:
                            key, left = last[j] << 24 | k, word[j - size[j] : j]
                        good = pairs.get(key)
                        if good is None:
                            good = self.stays(left, part, key)
                        if good:
                            n, piece = i - j, k
                            break
                    elif (total := score[j] + v.scores[part]) > best or (total == best and piece < 0):
                        n, piece, best = i - j, k, total
                size.append(n)
                last.append(piece)
                score.append(best)
            before = word
            ids: list[int] = []
            i = len(word)
            while i:
                if last[i] >= 0:
                    ids.append(last[i])
                else:
                    spelt = v.spell(word[i - 1])
                    # Unknown characters in a row are one unknown piece.
                    if not (spelt == [v.unknown] and ids[-1:] == spelt):
                        ids += reversed(spelt)
                i -= size[i]
            ids.reverse()
            yield ids


class Coder:
    """Encodes and decodes whole texts; each distinct marked word is segmented once."""

    def __init__(self, path: str, limit: int = 200_000):
        self.v = Vocabulary(path)
        self.segmenter = Segmenter(self.v)
        self.limit = limit
        self.cache = tv.Ragged(np.uint32, limit)

    def _marked(self, text: str) -> bytes:
        """The text with spaces for marks, one of them before it."""
        if not self.v.plain:
            return self.v.library.normalize(text).replace(MARK, " ").encode()
        if not text:
            return b""
        return (" " * self.v.prefix + text).replace(MARK, " ").encode()

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row + 1, ids, ids of each row) in chunks."""
        raw = [self._marked(t or "") for t in texts]
        for a, b in tv.chunks(raw, CHUNK_BYTES):
            data = b"".join(raw[a:b])
            bounds = np.cumsum([0, *map(len, raw[a:b])])
            if not data:
                yield a, b, np.zeros(0, np.uint32), np.zeros(b - a, np.int64)
                continue
            buf = np.frombuffer(data, np.uint8)
            space = buf == 0x20
            new = space & ~np.r_[False, space[:-1]] if self.v.by_word else np.zeros(len(buf), bool)
            new[bounds[:-1][bounds[:-1] < len(buf)]] = True
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(buf))
            first, place = tv.distinct(buf, starts, ends)
            keys = [data[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            if self.cache.n > self.limit:
                self.cache.clear()
            index = self.cache.index
            # UTF-8 sorts by code point, as the characters of a trie do.
            missing = sorted(k for k in keys if k not in index)
            for k, ids in zip(missing, self.segmenter.words([k.decode().replace(" ", MARK) for k in missing]), strict=True):
                self.cache.add(k, ids)
            places = np.fromiter(map(index.__getitem__, keys), np.int64, len(keys))
            ids, counts = self.cache.gather(places[place])
            sums = np.r_[0, np.cumsum(counts)][np.searchsorted(starts, bounds)]
            yield a, b, ids, np.diff(sums)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The UTF-8 bytes of each row's ids; the space before the text goes."""
        sizes = self.v.surface_at[ids + 1] - self.v.surface_at[ids] if len(ids) else np.zeros(0, np.int64)
        data = self.v.surface[tv.ranges(self.v.surface_at[ids], sizes)].tobytes() if len(ids) else b""
        ends = np.r_[0, np.cumsum(sizes)][np.cumsum(counts)]
        out, at = [], 0
        for end in ends.tolist():
            text = data[at:end]
            out.append(text[1:] if self.v.prefix and text[:1] == b" " else text)
            at = end
        return out


    def clear(self) -> None:
        """Forget what was segmented; the vocabulary stays."""
        self.cache.clear()
        self.segmenter.pairs.clear()
        tv.trim()


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """One for each Python worker."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def encoded(df: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``, the piece ids of each row's whole text; null and empty texts have no ids. A column of that name is replaced."""
    kept = [c for c in df.columns if c.lower() != out.lower()]
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tv.slices(batches):
            columns = [b.column(df_columns.index(c)) for c in kept]
            for x, y, ids, counts in coder(path).encode(b.column(at).to_pylist()):
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*[c.slice(x, y - x) for c in columns], lists], [*kept, out])
        coder(path).clear()

    ship(df.sparkSession)
    df_columns = df.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in kept)
    return df.mapInArrow(run, f"{fields}, `{out}` array<int>")


def decoded(df: DataFrame, path: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """Adds ``out``, the text of each row's ids; null ids count as none. A column of that name is replaced."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in parts:
            rows = [np.asarray(x if x is not None else [], np.int64) for x in column]
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            yield pd.Series([t.decode("utf-8", "replace") for t in coder(path).decode(flat, np.array([len(r) for r in rows], np.int64))])

    ship(df.sparkSession)
    return df.withColumn(out, text(df[ids_col]))


def report(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, number and CRC-32 (of 32-bit integers) of the ids, digest of the decoded text, and whether it is the text again.

    A text that holds the mark itself is decoded with spaces in its place. One row for
    each input row: null and empty texts have no ids, repeated rows equal ones, ids may
    be null, an empty table gives no rows, and other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tv.slices(batches):
            texts = b.column(1).to_pylist()
            for x, y, ids, counts in coder(path).encode(texts):
                data, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(counts)
                crcs = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                back = coder(path).decode(ids, counts)
                same = [t == (u or "").encode() for t, u in zip(back, texts[x:y], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(x, y - x), pa.array(counts), pa.array(crcs, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in back], pa.string()), pa.array(same, pa.bool_())],
                    [id_col, "n_tokens", "ids_crc32", "decoded_sha256", "same"],
                )
        coder(path).clear()

    ship(df.sparkSession)
    rows = df.select(df[id_col], df[text_col])
    return rows.mapInArrow(run, f"{id_col} {rows.schema[0].dataType.simpleString()}, n_tokens long, ids_crc32 long, decoded_sha256 string, same boolean")
