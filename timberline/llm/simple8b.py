"""Token ids in Simple-8b files: 64-bit words that each pack as many ids as fit.

The top 4 bits of a word select how many values of how many bits follow, lowest first.
Ids are cut into blocks of fixed length that start at a word; a file keeps the word at
which each block starts, so that blocks are packed and read independently, all at once.
Values of 2**60 and more are escaped: the escape selector, then the value as a word.

A file: magic; counts of words, values, documents, values of a block and documents
without an id, which come first (5 x 8 bytes); the words; the first word of each block; for each document its id and its first value; the CRC-32 of
all before. Integers are little-endian and 8 bytes long.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .runtime import new_folder, ship, written

#: (values, bits) by selector; selector 1 is the escape.
PACKINGS = (
    (240, 0), (1, 64), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
    (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
ESCAPE = 1
COUNTS = np.array([n for n, _ in PACKINGS], np.int64)
BLOCK = 4096
MAGIC = b"TLSIMP8C"
FILE_VALUES = 4 << 20
#: Blocks packed at once.
AT_ONCE = 64


_SHORT = np.zeros(1 << 16, np.uint8)
for _k in range(16):
    _SHORT[1 << _k :] += 1


def _bit_lengths(x: np.ndarray) -> np.ndarray:
    if x.max() < 1 << 16:
        return _SHORT[x]
    out = np.zeros(len(x), np.uint8)
    for k in (32, 16, 8, 4, 2, 1):
        high = x >> np.uint64(k)
        big = high > 0
        out += big.astype(np.uint8) * np.uint8(k)
        x = np.where(big, high, x)
    return out + (x > 0)


def _selectors(values: np.ndarray, block: int) -> np.ndarray:
    """For each place, the selector of the word that would start there, with the most values."""
    n = len(values)
    width = _bit_lengths(values)
    room = np.minimum(block - np.arange(n) % block, n - np.arange(n))
    best = np.where(width > 60, ESCAPE, 15).astype(np.uint8)
    most = {1: width}
    for selector in range(14, -1, -1):
        if selector == ESCAPE:
            continue
        count, bits = PACKINGS[selector]
        steps = [count] if count < 240 else [120, 240]
        for size in steps:
            if n < size:
                break
            half = max(k for k in most if k <= size)
            m, shift = most[half], size - half
            top = np.full(n, 255, np.uint8)
            np.maximum(m[: n - shift], m[shift:], out=top[: n - shift])
            most[size] = top
        else:
            best[(most[count] <= bits) & (room >= count)] = selector
    return best


def pack(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The words, and the first word of each block; some blocks at a time."""
    words, firsts, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    for at in range(0, len(values), AT_ONCE * block):
        w, first = _pack(np.ascontiguousarray(values[at : at + AT_ONCE * block], np.uint64), block)
        words.append(w)
        firsts.append(first + n)
        n += len(w)
    return np.concatenate(words), np.concatenate(firsts)


def _pack(values: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(values)
    selector = _selectors(values, block)
    step = COUNTS[selector]
    at = np.arange(0, n, block)
    ends = np.minimum(at + block, n)
    blocks = np.arange(len(at))
    found = []
    while len(at):
        found.append((blocks, at))
        at = at + step[at]
        live = at < ends
        at, ends, blocks = at[live], ends[live], blocks[live]
    owner = np.concatenate([b for b, _ in found])
    start = np.concatenate([a for _, a in found])
    order = np.argsort(start, kind="stable")
    owner, start = owner[order], start[order]
    chosen = selector[start]
    size = np.where(chosen == ESCAPE, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for k, (count, bits) in enumerate(PACKINGS):
        i = np.flatnonzero(chosen == k)
        if not len(i):
            continue
        words[place[i]] = np.uint64(k << 60)
        if k == ESCAPE:
            words[place[i] + 1] = values[start[i]]
        elif bits:
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            words[place[i]] |= np.bitwise_or.reduce(values[start[i][:, None] + np.arange(count)] << shifts, axis=1)
    first = np.searchsorted(owner, np.arange(-(-n // block)))
    return words, place[first]


def unpack(words: np.ndarray) -> np.ndarray:
    """The values of whole blocks."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    literal = np.zeros(len(words), bool)
    for i in np.flatnonzero(chosen == ESCAPE).tolist():
        if not literal[i]:
            literal[i + 1] = True
    head = np.flatnonzero(~literal)
    chosen = chosen[head]
    counts = COUNTS[chosen]
    place = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for k, (count, bits) in enumerate(PACKINGS):
        i = np.flatnonzero(chosen == k)
        if k == ESCAPE:
            out[place[i]] = words[head[i] + 1]
        elif len(i) and bits:
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            out[place[i][:, None] + np.arange(count)] = (words[head[i]][:, None] >> shifts) & np.uint64((1 << bits) - 1)
    return out


@dataclass
class IdFile:
    """What one file holds: ids of documents one after another."""

    doc_ids: np.ndarray
    starts: np.ndarray
    words: np.ndarray
    block_words: np.ndarray
    n_values: int
    #: So many documents, the first ones, have no id.
    n_null: int = 0

    @classmethod
    def of(cls, doc_ids: np.ndarray, counts: np.ndarray, values: np.ndarray, n_null: int = 0) -> IdFile:
        words, block_words = pack(values)
        return cls(np.asarray(doc_ids, np.int64), np.cumsum(counts) - counts, words, block_words, len(values), n_null)

    def to_bytes(self) -> bytes:
        head = np.array([len(self.words), self.n_values, len(self.doc_ids), BLOCK, self.n_null], "<u8")
        parts = [MAGIC, head.tobytes(), self.words.astype("<u8").tobytes(), self.block_words.astype("<u8").tobytes(), self.doc_ids.astype("<i8").tobytes(), self.starts.astype("<u8").tobytes()]
        data = b"".join(parts)
        return data + zlib.crc32(data).to_bytes(8, "little")

    @classmethod
    def from_bytes(cls, data: bytes) -> IdFile:
        if data[:8] != MAGIC or zlib.crc32(data[:-8]) != int.from_bytes(data[-8:], "little"):
            raise ValueError("not an id file, or a damaged one")
        n_words, n_values, n_docs, block, n_null = (int(x) for x in np.frombuffer(data, "<u8", 5, 8))
        n_blocks = -(-n_values // block)
        at = 48
        parts = []
        for n, kind in ((n_words, "<u8"), (n_blocks, "<u8"), (n_docs, "<i8"), (n_docs, "<u8")):
            parts.append(np.frombuffer(data, kind, n, at))
            at += 8 * n
        words, block_words, doc_ids, starts = parts
        return cls(doc_ids, starts.astype(np.int64), words, block_words.astype(np.int64), n_values, n_null)

    @property
    def ids(self) -> pa.Array:
        """The documents' ids; null for those without one."""
        return pa.array(self.doc_ids, mask=np.arange(len(self.doc_ids)) < self.n_null)

    def values(self) -> np.ndarray:
        return unpack(self.words)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, from the blocks that hold them alone."""
        a = int(self.starts[k])
        b = int(self.starts[k + 1]) if k + 1 < len(self.starts) else self.n_values
        if a == b:
            return np.zeros(0, np.uint64)
        lo, hi = a // BLOCK, (b - 1) // BLOCK + 1
        end = self.block_words[hi] if hi < len(self.block_words) else len(self.words)
        return unpack(self.words[self.block_words[lo] : end])[a - lo * BLOCK : b - lo * BLOCK]


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    local = re.match(r"(?:file:)?(/.*)", uri)
    return fs.FileSystem.from_uri("file://" + re.sub("^/+", "/", local[1])) if local else fs.FileSystem.from_uri(uri)


def write_atomically(uri: str, data: bytes) -> None:
    """Under a name of its own, then moved: of several attempts one whole file stays."""
    system, path = _filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, path)


def read_file(uri: str) -> IdFile:
    system, path = _filesystem(uri)
    with system.open_input_file(path) as f:
        return IdFile.from_bytes(f.read())


#: The rules of a tokenizer file under which pieces may be coded one by one.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class WordCoder:
    """Ids of whole texts by the tokenizers library, with each distinct piece coded once where its rules allow that.

    Under ``RULES`` nothing looks across a space, tab or line end, so texts are cut
    there. Pieces of Latin letters, with ASCII marks after them or not, are already
    what the normaliser and splitter would make of them once lower-cased and cut between
    letters and marks; the library's model codes those. It codes any other piece with
    all its rules. With a
    file of other rules, the library codes whole texts.
    """

    #: ASCII marks that may follow letters; an apostrophe may belong to a word's end, and an added token starts with a less-than sign.
    MARKS = re.compile(r"[!-&(-/:-;=-@\[-`{-~]")

    def __init__(self, path: str, end_id: int | None, limit: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        rules = json.loads(self.tokenizer.to_str())
        added = [t["content"] for t in rules["added_tokens"]]
        self.by_piece = all(rules[k] == v for k, v in RULES.items()) and all(t.startswith("<") and not re.search(r"\s", t) for t in added)
        # The byte-level alphabet: how the model spells bytes.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.shown = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        #: Classes of bytes: 1 letters, 2 marks, 0 others.
        self.kind = np.zeros(256, np.uint8)
        self.kind[[*range(65, 91), *range(97, 123)]] = 1
        self.kind[[c for c in range(128) if self.MARKS.fullmatch(chr(c))]] = 2
        self.end_id, self.limit = end_id, limit
        self.cache = tv.Ragged(np.uint32, limit)

    def units(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """The buffer with plain pieces lower-cased, starts and ends of units, and which units are plain.

        A piece of letters, then marks, is plain; it is cut between them.
        """
        kind = self.kind[buf]
        # Latin letters of two bytes; small ones are 32 above the others, and two signs stand among them.
        latin = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7))
        kind[latin] = kind[latin + 1] = 1
        sums = lambda x: np.r_[0, np.cumsum(x, dtype=np.int32)]
        others, letters = sums(kind == 0), sums(kind == 1)
        turns = sums((kind[:-1] == 2) & (kind[1:] == 1))
        plain = (others[ends] == others[starts]) & (turns[ends - 1] == turns[starts])
        inside = np.zeros(len(buf) + 1, np.int8)
        inside[starts[plain]] = 1
        inside[ends[plain]] -= 1
        small = tv.LOWER[buf]
        small[latin + 1] |= np.where(buf[latin + 1] < 0x9F, 0x20, 0).astype(np.uint8)
        low = np.where(np.cumsum(inside[:-1], dtype=np.int8) > 0, small, buf)
        middle = starts + letters[ends] - letters[starts]
        middle = middle[plain & (middle > starts) & (middle < ends)]
        first = np.concatenate([starts, middle])
        order = np.argsort(first, kind="stable")
        return low, first[order], np.sort(np.concatenate([ends, middle])), np.concatenate([plain, np.ones(len(middle), bool)])[order]

    def ids(self, text: bytes, plain: bool) -> list[int]:
        """Of a plain unit, by the model alone; else by all rules."""
        if plain:
            shown = text.decode() if text.isascii() else "".join(map(self.shown.__getitem__, text))
            return [t.id for t in self.model.tokenize(shown)]
        return self.tokenizer.encode(text.decode(), add_special_tokens=False).ids

    def code(self, texts: list[str | None], limit: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row + 1, ids, ids of each row) in chunks."""
        raw = [(t or "").encode() for t in texts]
        for a, b in tv.chunks(raw, limit):
            if not self.by_piece:
                end_ids = [] if self.end_id is None else [self.end_id]
                coded = [array("I", self.tokenizer.encode(t or "", add_special_tokens=False).ids + end_ids) for t in texts[a:b]]
                yield a, b, np.frombuffer(b"".join(c.tobytes() for c in coded), np.uint32), np.array([len(c) for c in coded], np.int64)
                continue
            buf, bounds = tv.joined(raw[a:b])
            starts, ends = tv.spans((buf != 0x20) & (buf != 0x09) & (buf != 0x0A) & (buf != 0x0D))
            if self.cache.n > self.limit:
                self.cache.clear()
            end = self.cache.index.get(b"")
            if end is None:
                end = self.cache.add(b"", [] if self.end_id is None else [self.end_id])
            if len(starts):
                buf, starts, ends, plain = self.units(buf, starts, ends)
                first, place = tv.distinct(buf, starts, ends)
                data, index = buf.tobytes(), self.cache.index
                keys = [data[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
                places = np.fromiter((index.get(k, -1) for k in keys), np.int64, len(keys))
                new = np.flatnonzero(places < 0)
                places[new] = self.cache.add_all([keys[k] for k in new.tolist()], [self.ids(keys[k], p) for k, p in zip(new.tolist(), plain[first[new]].tolist(), strict=True)])
                place = places[place]
            else:
                place = np.zeros(0, np.int64)
            # After the last unit of each text comes its end.
            cut = np.searchsorted(starts, bounds[1:])
            place = np.insert(place, cut, end)
            ids, counts = self.cache.gather(place)
            sums = np.cumsum(counts)[cut + np.arange(len(cut))]
            yield a, b, ids, np.diff(sums, prepend=0)


_coders: dict[tuple, WordCoder] = {}


def word_coder(path: str, end_id: int | None) -> WordCoder:
    """One for each Python worker."""
    key = path, end_id
    if key not in _coders:
        _coders[key] = WordCoder(path, end_id)
    return _coders[key]


def write_ids(df: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int | None = 2, file_values: int = FILE_VALUES) -> DataFrame:
    """Write the ids of all texts to ``folder`` in ascending order of id; returns the files' list.

    The list has path, part, seq, n_docs, n_values and ``start``, the ids in files
    before. Null texts count as empty; an empty text has the end id alone. Null ids
    come first and stay null; rows with equal ids are documents of their own, in order
    of text. An empty table gives no files. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        coder = word_coder(path, end_id)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, n, seq
            docs, none, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            name = f"{folder}/part-{part:06d}-{seq:06d}.s8b"
            write_atomically(name, IdFile.of(docs, counts, ids, int(none.sum())).to_bytes())
            row = {"path": [name], "part": [part], "seq": [seq], "n_docs": [len(docs)], "n_values": [len(ids)]}
            held, n, seq = [], 0, seq + 1
            return pa.RecordBatch.from_pydict(row)

        for b in tv.slices(batches, 4 << 20):
            keys, none = np.asarray(b.column(0).fill_null(0)), np.asarray(b.column(0).is_null())
            for x, y, ids, counts in coder.code(b.column(1).to_pylist(), min(2 << 20, file_values)):
                held.append((keys[x:y], none[x:y], counts, ids))
                n += len(ids)
                if n >= file_values:
                    yield flush()
        if held:
            yield flush()

    ship(df.sparkSession)
    rows = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"))
    files = rows.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(run, "path string, part long, seq long, n_docs long, n_values long")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return written(written(files, "id-files").withColumn("start", F.coalesce(F.sum("n_values").over(before), F.lit(0))), "id-starts")


def read_ids(files: DataFrame, each: Callable[[IdFile, int], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``each`` makes of every file of a list and the number of ids before it; a task for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield each(read_file(path), start)

    return files.select("path", "start").repartition(max(1, files.count())).mapInArrow(run, schema)


def document_ids(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, ids) of each document."""

    def each(f: IdFile, start: int) -> pa.RecordBatch:
        ends = np.append(f.starts, f.n_values)
        ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(f.values().astype(np.int64)))
        return pa.RecordBatch.from_arrays([f.ids, pa.array(f.starts + start), ids], [id_col, "start", "ids"])

    return read_ids(files, each, f"{id_col} long, start long, ids array<long>")


def ids_report(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens and the CRC-32 of the ids as 32-bit integers, for each document."""

    def each(f: IdFile, start: int) -> pa.RecordBatch:
        data = memoryview(f.values().astype("<u4").tobytes())
        ends = np.append(f.starts[1:], f.n_values)
        crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(f.starts.tolist(), ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [f.ids, pa.array(f.starts + start), pa.array(ends - f.starts), pa.array(crcs, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"]
        )

    return read_ids(files, each, f"{id_col} long, start long, n_tokens long, ids_crc32 long")


def encode_report(df: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read back from files in a new shared folder.

    Null texts count as empty, null ids come first, repeated rows are documents of their
    own, and an empty table gives no rows, as ``write_ids`` has it.
    """
    spark: SparkSession = df.sparkSession
    return ids_report(write_ids(df, new_folder(spark, "ids"), path))
