"""ISO media containers as columns: boxes, sample tables, codec, duration, keyframe ranges.

``tracks`` walks the nested boxes of a file and decodes the sample tables of each track;
no payload is decoded. ``mux`` writes a file with one track of 8-bit samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ship, written

CONTAINERS = frozenset({b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"udta", b"mvex", b"moof", b"traf"})
RATE = 8000
UNIT = 1024
UNITS_IN_CHUNK = 16
BLOCK = 64


class BadMedia(ValueError):
    """The bytes are not a whole ISO media file."""


def boxes(data: bytes, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of types, first byte, end) of the content of each box, outer boxes first."""
    end = len(data) if end is None else end
    at = start
    while at < end:
        if end - at < 8:
            raise BadMedia(f"{end - at} bytes after the last box")
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if end - at < 16:
                raise BadMedia("cut in a large box's head")
            (size,) = struct.unpack_from(">Q", data, at + 8)
            head = 16
        elif size == 0:
            size = end - at
        if kind == b"uuid":
            head += 16
        if size < head or at + size > end:
            raise BadMedia(f"box {kind!r} of {size} bytes in {end - at}")
        yield (*path, kind), at + head, at + size
        if kind in CONTAINERS:
            yield from boxes(data, at + head, at + size, (*path, kind))
        at += size


@dataclass
class Track:
    track_id: int = 0
    kind: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    offsets: np.ndarray = None
    sizes: np.ndarray = None
    times: np.ndarray = None
    sync: np.ndarray = None

    @property
    def keyframes(self) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and lengths of the byte ranges that the sync samples fill; touching ones are one range."""
        return touching(self.offsets[self.sync], self.sizes[self.sync])


def touching(offsets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(offsets):
        return offsets, sizes
    new = np.r_[True, offsets[1:] != offsets[:-1] + sizes[:-1]]
    at = np.flatnonzero(new)
    return offsets[at], np.add.reduceat(sizes, at)


def _table(data: bytes, at: int, end: int, kind: str, columns: int = 1, skip: int = 8) -> np.ndarray:
    """The entries of a full box with a count before them."""
    if end - at < skip:
        raise BadMedia("cut in a table's head")
    (n,) = struct.unpack_from(">I", data, at + skip - 4)
    width = np.dtype(kind).itemsize
    if n * columns * width > end - at - skip:
        raise BadMedia("cut in a table")
    return np.frombuffer(data, kind, n * columns, at + skip).astype(np.int64).reshape(n, columns)


def _sizes(data: bytes, at: int, end: int, compact: bool) -> np.ndarray:
    if end - at < 12:
        raise BadMedia("cut in the sizes' head")
    fixed, n = struct.unpack_from(">II", data, at + 4)
    if not compact:
        return np.full(n, fixed, np.int64) if fixed else _table(data, at, end, ">u4", 1, 12)[:, 0]
    bits = fixed & 0xFF
    if bits not in (4, 8, 16):
        raise BadMedia(f"sizes of {bits} bits")
    if (n * bits + 7) // 8 > end - at - 12:
        raise BadMedia("cut in a table")
    if bits == 4:
        raw = np.frombuffer(data, np.uint8, (n + 1) // 2, at + 12)
        return np.stack([raw >> 4, raw & 15], 1).ravel()[:n].astype(np.int64)
    return np.frombuffer(data, f">u{bits // 8}", n, at + 12).astype(np.int64)


def _offsets(sizes: np.ndarray, chunks: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The byte at which each sample starts; ``runs`` is (first chunk, samples in each, description)."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    if not len(runs) or runs[0, 0] != 1:
        raise BadMedia("chunks without a number of samples")
    n = len(chunks)
    in_chunk = np.repeat(runs[:, 1], np.diff(np.append(np.minimum(runs[:, 0] - 1, n), n)))
    if in_chunk.sum() < len(sizes):
        raise BadMedia("fewer places than samples")
    chunk = np.repeat(np.arange(n), in_chunk)[: len(sizes)]
    before = np.cumsum(sizes) - sizes
    first = np.searchsorted(chunk, np.arange(n))
    return chunks[chunk] + before - before[np.minimum(first[chunk], len(sizes) - 1)]


def tracks(data: bytes) -> list[Track]:
    """The tracks of a file, with their decoded sample tables. Raises BadMedia for bytes that are none."""
    found: list[Track] = []
    tables: list[dict[bytes, np.ndarray]] = []
    for path, at, end in boxes(data):
        kind = path[-1]
        try:
            if kind == b"trak" and path[0] == b"moov":
                found.append(Track())
                tables.append({})
            elif len(path) < 3 or path[:2] != (b"moov", b"trak"):
                continue
            elif kind == b"tkhd":
                found[-1].track_id = struct.unpack_from(">I", data, at + (20 if data[at] else 12))[0]
            elif kind == b"mdhd":
                found[-1].timescale, found[-1].duration = struct.unpack_from(">IQ" if data[at] else ">II", data, at + (20 if data[at] else 12))
            elif kind == b"hdlr" and path[-2] == b"mdia":
                found[-1].kind = data[at + 8 : at + 12].decode("latin-1")
            elif kind == b"stsd":
                found[-1].codec = data[at + 12 : at + 16].decode("latin-1")
            elif kind in (b"stts", b"stsc"):
                tables[-1][kind] = _table(data, at, end, ">u4", 2 if kind == b"stts" else 3)
            elif kind in (b"stsz", b"stz2"):
                tables[-1][b"sizes"] = _sizes(data, at, end, kind == b"stz2")
            elif kind in (b"stco", b"co64"):
                tables[-1][b"chunks"] = _table(data, at, end, ">u4" if kind == b"stco" else ">u8")[:, 0]
            elif kind == b"stss":
                tables[-1][kind] = _table(data, at, end, ">u4")[:, 0]
        except (struct.error, IndexError) as x:
            raise BadMedia(f"cut in {kind!r}") from x
    for track, t in zip(found, tables, strict=True):
        none = np.zeros((0, 3), np.int64)
        track.sizes = t.get(b"sizes", none[:, 0])
        track.offsets = _offsets(track.sizes, t.get(b"chunks", none[:, 0]), t.get(b"stsc", none))
        steps = t.get(b"stts", none[:, :2])
        deltas = np.repeat(steps[:, 1], steps[:, 0])[: len(track.sizes)]
        track.times = np.cumsum(deltas) - deltas
        # Without a table of sync samples, all samples are.
        track.sync = t[b"stss"] - 1 if b"stss" in t else np.arange(len(track.sizes))
        if len(track.sync) and not (0 <= track.sync.min() and track.sync.max() < len(track.sizes)):
            raise BadMedia("a sync sample that is not there")
        if len(track.sizes) and (track.offsets + track.sizes).max() > len(data):
            raise BadMedia("samples beyond the end")
    return found


def payload(data: bytes, track: Track) -> bytes:
    """The samples' bytes in order of time."""
    return b"".join(data[a : a + n] for a, n in zip(*(x.tolist() for x in touching(track.offsets, track.sizes)), strict=True))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")


def mux(samples: bytes) -> bytes:
    """A file with one mono track of unsigned 8-bit samples at 8 kHz.

    An access unit has 1,024 samples (the last the rest) and a chunk 16 units; the
    first unit of each chunk is a sync sample. Equal samples give equal bytes.
    """
    n = len(samples)
    units, rest = divmod(n, UNIT)
    sizes = np.full(units + (rest > 0), UNIT, ">u4")
    if rest:
        sizes[-1] = rest
    n_units = len(sizes)
    n_chunks = -(-n_units // UNITS_IN_CHUNK)
    steps = [(units, UNIT)] * (units > 0) + [(1, rest)] * (rest > 0)
    full_chunks, odd = divmod(n_units, UNITS_IN_CHUNK)
    runs = [(1, UNITS_IN_CHUNK, 1)] * (full_chunks > 0) + [(full_chunks + 1, odd, 1)] * (odd > 0)
    wide = n + (1 << 20) >= 1 << 32

    def moov(first: int) -> bytes:
        places = first + np.arange(n_chunks, dtype=np.int64) * UNITS_IN_CHUNK * UNIT
        entry = struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, RATE << 16)
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), _box(b"raw ", entry)),
            _full(b"stts", struct.pack(">I", len(steps)), *[struct.pack(">II", *x) for x in steps]),
            _full(b"stss", struct.pack(">I", n_chunks), (np.arange(n_chunks) * UNITS_IN_CHUNK + 1).astype(">u4").tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *x) for x in runs]),
            _full(b"stsz", struct.pack(">II", 0, n_units), sizes.tobytes()),
            _full(b"co64" if wide else b"stco", struct.pack(">I", n_chunks), places.astype(">u8" if wide else ">u4").tobytes()),
        )
        times = struct.pack(">QQIQ", 0, 0, RATE, n)
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        mdia = _box(b"mdia", _full(b"mdhd", times, struct.pack(">HH", 0x55C4, 0), version=1), _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, n), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, bytes(8), version=1, flags=7)
        mvhd = _full(b"mvhd", times, struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    mdat = _box(b"mdat", samples)
    head = len(mdat) - n
    return _FTYP + moov(len(_FTYP) + len(moov(0)) + head) + mdat


def padded(text: str | None) -> tuple[int, bytes]:
    """The UTF-8 bytes' number, and the bytes with zeros up to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


TRACK_TYPE = pa.struct(
    [
        ("track_id", pa.int64()), ("kind", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()),
        ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))),
    ]
)
TRACKS = "array<struct<track_id:bigint,kind:string,codec:string,timescale:bigint,duration:bigint,n_samples:bigint,keyframes:array<struct<offset:bigint,length:bigint>>>>"


def _row(t: Track) -> dict:
    keys = [{"offset": a, "length": n} for a, n in zip(*(x.tolist() for x in t.keyframes), strict=True)]
    return {"track_id": t.track_id, "kind": t.kind, "codec": t.codec, "timescale": t.timescale, "duration": t.duration, "n_samples": len(t.sizes), "keyframes": keys}


def media_columns(df: DataFrame, media_col: str = "media", out: str = "tracks") -> DataFrame:
    """Adds ``out``, an array of the tracks' facts, to each row; null for null media and for bytes that are no ISO media file."""

    @F.pandas_udf(TRACKS)
    def facts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for media in parts:
            rows = []
            for data in media:
                try:
                    rows.append(None if data is None else [_row(t) for t in tracks(bytes(data))])
                except BadMedia:
                    rows.append(None)
            yield pd.Series(rows)

    ship(df.sparkSession)
    return df.withColumn(out, facts(df[media_col]))


def stored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media) of each text, written to the shared folder.

    Null texts count as empty, repeated rows are rows of their own, ids may be null, an
    empty table gives an empty one, and other columns, of any names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                c = b.slice(at, 512)
                made = [padded(t) for t in c.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([mux(p) for _, p in made], pa.binary())], [id_col, "n_bytes", "media"])

    ship(df.sparkSession)
    rows = df.select(df[id_col], df[text_col])
    return written(rows.mapInArrow(run, f"{id_col} {rows.schema[0].dataType.simpleString()}, n_bytes long, media binary"), "media")


def media_report(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What is read back from stored files: payload and container digests, and a feature of the sample tables.

    One row for each stored row, repeated or without an id; equal texts have equal
    values. An empty table gives no rows.
    """
    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def facts(n: int, data: bytes) -> tuple:
        (t,) = tracks(data)
        raw = payload(data, t)
        at, length = t.keyframes
        ranges = ",".join(f"{a}+{m}" for a, m in zip(at.tolist(), length.tolist(), strict=True))
        feature = f"{t.codec.strip()};{t.duration}/{t.timescale};{len(t.sizes)} samples;{ranges}"
        return n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [facts(n.as_py(), data.as_buffer().to_pybytes()) for n, data in zip(b.column(1), b.column(2), strict=True)]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]], [id_col, *[f.split()[0] for f in fields.split(", ")]])

    return media.select(id_col, "n_bytes", "media").mapInArrow(run, f"{id_col} {media.schema[id_col].dataType.simpleString()}, {fields}")
