"""SimHash near-duplicates found at the anchors of a covering code.

The 64 bits are cut into blocks. Two fingerprints within ``distance`` bits differ in
at most t = distance // blocks bits of some block. In each block the anchors are the
code words of a perfect Hamming code on the first 2**m - 1 bits, with every pattern of
the remaining bits; their covering radius is 1. A fingerprint is sent to every anchor
within 1 + t bits, and is at home at the nearest one. If x and y differ in t bits or
fewer of a block, then y is also sent to the home of x, so that comparing those at home
with all that were sent, anchor by anchor, finds every link.

An anchor with very many members is cut into tiles, and each pair of tiles is a task.

For near duplicates by similarity (``similar``), fingerprints have ``WIDE`` words and so
many more blocks: a pair of that similarity differs in few bits of some block with a
probability that ``recall`` states. Two words are compared at the anchors. What they
connect is a candidate group, whose sets of shingles then decide, each pair of tiles of
a group in one task: pairs in order of their distance over all words, but for those
that are connected already. Tasks give links that span what they find, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import acos, ceil, comb, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .components import connected_components
from .runtime import BROADCAST_ROWS, dealt_join, matched, ship, summed, written

SEED = 42
SHINGLE = 4
DISTANCE = 4
BLOCKS = 3
#: For similarity: words of a shingle, the least similarity, words of a fingerprint, and bits of a block, in which 1 may differ.
WIDE_SHINGLE, SIMILAR, WIDE, WIDE_BITS = 5, 0.8, 5, 18
#: Pairs compared at once, and elements of sets looked up at once.
PAIRS, ELEMENTS = 1 << 21, 1 << 18
#: Members of an anchor that one task compares; elements of sets in a tile of a candidate group, and how many the least set counts as.
HOT, TILE, LEAST_SET = 1 << 16, 1 << 19, 256
#: Words compared at the anchors, and elements of a set in a row.
MET, PIECE = 2, 1024
#: Sets of so many elements differ in their bits as larger ones do.
SMALL = 256

_P1, _P2, _P3, _P4, _P5 = map(
    np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each slice of the buffer."""
    lane = tv.lanes(buf)
    sizes = ends - starts
    order = np.argsort(sizes, kind="stable")
    at, left = starts[order].copy(), sizes[order].copy()
    h = np.full(len(at), seed, np.uint64) + _P5
    first = np.searchsorted(left, 32)
    if first < len(at):
        s = np.uint64(seed)
        n = len(at) - first
        with np.errstate(over="ignore"):
            v = [np.full(n, x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
        stripes = left[first:] // 32
        for k in range(int(stripes[-1])):
            lo = int(np.searchsorted(stripes, k + 1))
            p = at[first + lo :]
            for j in range(4):
                v[j][lo:] = _round(v[j][lo:], lane[p + 8 * j])
            at[first + lo :] += 32
            left[first + lo :] -= 32
        x = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for k in range(4):
            x = (x ^ _round(np.zeros(n, np.uint64), v[k])) * _P1 + _P4
        h[first:] = x
    h += sizes[order].astype(np.uint64)
    for _ in range(3):
        i = np.flatnonzero(left >= 8)
        if not len(i):
            break
        h[i] = _rotl(h[i] ^ _round(np.zeros(len(i), np.uint64), lane[at[i]]), 27) * _P1 + _P4
        at[i] += 8
        left[i] -= 8
    i = np.flatnonzero(left >= 4)
    h[i] = _rotl(h[i] ^ ((lane[at[i]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    at[i] += 4
    left[i] -= 4
    for _ in range(3):
        i = np.flatnonzero(left >= 1)
        if not len(i):
            break
        h[i] = _rotl(h[i] ^ ((lane[at[i]] & np.uint64(0xFF)) * _P5), 11) * _P1
        at[i] += 1
        left[i] -= 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    h ^= h >> np.uint64(32)
    out = np.empty_like(h)
    out[order] = h
    return out


def _majority(h: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of hashes, the word of the bits set in over half of them."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    # Bytes hold sums of up to 255 bits; those are added after.
    pieces = -(-counts // 255)
    at = np.repeat(first, pieces) + 255 * tv.ranges(np.zeros(len(pieces), np.int64), pieces)
    part = np.add.reduceat(bits, at, axis=0).view(np.uint8)
    total = np.add.reduceat(part, np.cumsum(pieces) - pieces, axis=0, dtype=np.int64)
    return np.packbits(total * 2 > counts[:, None], axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)


def _shingled(raw: list[bytes], shingle: int) -> tuple[np.ndarray, ...] | None:
    """Texts with words, how many shingles each has, and the shingles as slices of a buffer, words one space apart."""
    buf, bounds = tv.joined(raw)
    buf = tv.LOWER[buf]
    inside = ~tv.SPACE[buf]
    starts, ends = tv.spans(inside)
    if not len(starts):
        return None
    doc = np.searchsorted(bounds, starts, "right") - 1
    inside[ends] = True
    buf[ends] = 0x20
    buf = buf[inside]
    sizes = ends - starts
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = starts + sizes
    docs, first, n = np.unique(doc, return_index=True, return_counts=True)
    made = np.maximum(n - shingle + 1, 1)
    i = tv.ranges(first, made)
    last = np.minimum(i + shingle - 1, np.repeat(first + n - 1, made))
    return docs, made, buf, starts[i], ends[last]


def fingerprints(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each text over its word shingles; 0 for a text without words."""
    raw = [(t or "").encode() for t in texts]
    out = np.zeros(len(raw), np.uint64)
    for a, b in tv.chunks(raw):
        found = _shingled(raw[a:b], shingle)
        if found:
            docs, made, buf, starts, ends = found
            out[a + docs] = _majority(xxh64(buf, starts, ends), np.cumsum(made) - made, made)
    return out


def shingle_sets(texts: list[str | None], shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows with words, how many distinct shingles each has, and their 64-bit hashes, rising in each row."""
    raw = [(t or "").encode() for t in texts]
    for a, b in tv.chunks(raw):
        found = _shingled(raw[a:b], shingle)
        if found:
            docs, made, buf, starts, ends = found
            h = tv.Hasher(buf)(starts, ends)
            row = np.repeat(np.arange(len(docs)), made)
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]
            yield a + docs, np.bincount(row[new], minlength=len(docs)), h[new]


def wide_fingerprints(texts: list[str | None], shingle: int = WIDE_SHINGLE, words: int = WIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """SimHash words over each text's set of shingles, a 64-bit hash of that set and its size; zeros without words."""
    fps, name, size = np.zeros((len(texts), words), np.uint64), np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.int64)
    for docs, made, h in shingle_sets(texts, shingle):
        first = np.cumsum(made) - made
        for k in range(words):
            fps[docs, k] = _majority(tv.mix(h + _P3 * np.uint64(k + 1)), first, made)
        name[docs] = np.add.reduceat(tv.mix(h ^ _P4), first)
        size[docs] = made
    return fps, name, size


@lru_cache(maxsize=8)
def code(bits: int, radius: int) -> tuple[int, list[np.ndarray]]:
    """Length of the Hamming part, and for each syndrome the error masks that lead to the anchors within ``radius``."""
    m = max(k for k in range(2, 7) if (1 << k) - 1 <= bits)
    n = (1 << m) - 1
    masks: list[list[int]] = [[] for _ in range(1 << m)]
    for w in range(radius + 1):
        for places in combinations(range(bits), w):
            syndrome = mask = 0
            for p in places:
                mask |= 1 << p
                if p < n:
                    syndrome ^= p + 1
            masks[syndrome].append(mask)
    return n, [np.array(x, np.uint64) for x in masks]


def _syndromes(x: np.ndarray, n: int) -> np.ndarray:
    s = np.zeros(len(x), np.int64)
    for p in range(n):
        s ^= np.where((x >> np.uint64(p)) & np.uint64(1), p + 1, 0)
    return s


def block_bits(blocks: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each block."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def wide_bits(words: int = WIDE, bits: int = WIDE_BITS) -> list[tuple[int, int]]:
    """(first bit, bits) of as many equal blocks as fit in a wide fingerprint."""
    return [(k * bits, bits) for k in range(64 * words // bits)]


def anchors(fps: np.ndarray, cuts: list[tuple[int, int]], t: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, row of ``fps``, at home), a batch for each block and syndrome; ``fps`` has a column for each word."""
    for k, (first, bits) in enumerate(cuts):
        w, off = divmod(first, 64)
        part = fps[:, w] >> np.uint64(off)
        if off + bits > 64:
            part |= fps[:, w + 1] << np.uint64(64 - off)
        part &= np.uint64((1 << bits) - 1)
        n, masks = code(bits, 1 + t)
        syndromes = _syndromes(part, n)
        for s, errors in enumerate(masks):
            own = np.flatnonzero(syndromes == s)
            if len(own):
                key = (part[own][:, None] ^ errors[None, :]) | np.uint64(k << 58)
                home = np.broadcast_to(errors == (np.uint64(1 << (s - 1)) if s else np.uint64(0)), key.shape)
                yield key.ravel(), np.repeat(own, len(errors)), home.ravel()


def differing(similar: float) -> float:
    """The share of bits in which SimHash differs for large sets of a similarity."""
    return acos(2 * similar / (1 + similar)) / pi


def _odds(a: int, b: int, common: int) -> float:
    """How often a bit differs between sets of ``a`` and ``b`` elements with so many in common, each bit of an element's hash being fair."""
    share, own, other = (np.array([comb(n, k) for k in range(n + 1)], float) / 2.0**n for n in (common, a - common, b - common))
    x = np.arange(common + 1)[:, None]
    one = ((2 * (x + np.arange(a - common + 1)) > a) * own).sum(1)
    two = ((2 * (x + np.arange(b - common + 1)) > b) * other).sum(1)
    return float((share * (one * (1 - two) + two * (1 - one))).sum())


@lru_cache(maxsize=8)
def odds_by_size(similar: float) -> np.ndarray:
    """The largest share of bits in which sets of a similarity differ on average, by the size of the larger set; the last is for all above.

    Bits of small sets differ more often than those of large ones, as few elements outvote the others.
    """
    out = np.zeros(SMALL + 1)
    for n in range(1, SMALL + 1):
        for a in range(ceil(similar * n - 1e-9), n + 1):
            least = ceil(similar * (a + n) / (1 + similar) - 1e-9)
            out[n] = max([out[n], *(_odds(a, n, c) for c in range(least, min(a, least + 1) + 1))])
    out[SMALL] = max(out[SMALL - 8 :].max(), differing(similar))
    return out


def most_bits(similar: float, bits: int, deviations: float = 3.0) -> np.ndarray:
    """Nearly all pairs of that similarity or more differ in so many of ``bits`` or fewer, by the size of the larger set."""
    p = odds_by_size(similar)
    return np.ceil(bits * p + deviations * np.sqrt(bits * p * (1 - p))).astype(np.int64)


def recall(similar: float, size: int = SMALL, words: int = WIDE, bits: int = WIDE_BITS) -> float:
    """The least share of pairs with a similarity that are found, by the size of the larger set.

    They meet where 1 bit or none of some block differs (some others meet as well),
    and pass both cuts, over the words compared at anchors and over all words.
    """
    p = float(odds_by_size(similar)[min(size, SMALL)])
    meet = 1 - (1 - (1 - p) ** bits - bits * p * (1 - p) ** (bits - 1)) ** (64 * words // bits)

    def within(n: int) -> float:
        most = int(most_bits(similar, n)[min(size, SMALL)])
        return sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(min(most, n) + 1))

    return meet - (1 - within(64 * MET)) - (1 - within(64 * words))


class Forest:
    """What edges connect, and which of them span it."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Places of the edges that connect what was apart."""
        left, chosen = np.arange(len(x)), [np.zeros(0, np.int64)]
        while True:
            a, b = self.root[x[left]], self.root[y[left]]
            apart = a != b
            left, a, b = left[apart], a[apart], b[apart]
            if not len(left):
                return np.concatenate(chosen)
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((lo, hi))
            first = order[np.r_[True, hi[order][1:] != hi[order][:-1]]]
            chosen.append(left[first])
            self.root[hi[first]] = lo[first]
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def name_of(fps: np.ndarray) -> np.ndarray:
    """One word of each row of words; of one word, the word itself."""
    name = fps[:, 0]
    for k in range(1, fps.shape[1]):
        name = tv.mix(name ^ tv.mix(fps[:, k] + np.uint64(k)))
    return name


def links(
    keys: np.ndarray, fps: np.ndarray, home: np.ndarray, distance: int | np.ndarray = DISTANCE, sizes: np.ndarray | None = None, least: float = 0.0
) -> tuple[np.ndarray, np.ndarray]:
    """Names of linked members that span what is linked at any anchor; rows come sorted by key, ``fps`` has a column for each word.

    Members hang on the least name that they are linked to, so that anchors give much the same links.
    Of sets with ``sizes``, those are compared of which one has ``least`` of the other's size, and ``distance`` goes by the larger one.
    """
    fps = fps.reshape(len(keys), -1)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    count = np.diff(np.r_[starts, len(keys)])
    group = np.repeat(np.arange(len(starts)), count)
    left = np.flatnonzero(home)
    cost = np.cumsum(count[group[left]])
    names, own = np.unique(name_of(fps), return_inverse=True)
    forest, xs, ys = Forest(len(names)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(left):
        n = max(1, int(np.searchsorted(cost, cost[0] - count[group[left[0]]] + PAIRS, "right")))
        x = np.repeat(left[:n], count[group[left[:n]]])
        y = tv.ranges(starts[group[left[:n]]], count[group[left[:n]]])
        if sizes is not None:
            fits = np.minimum(sizes[x], sizes[y]) >= least * np.maximum(sizes[x], sizes[y]) - 1e-9
            x, y = x[fits], y[fits]
        bits = sum(np.bitwise_count(w[x] ^ w[y]).astype(np.int16) for w in fps.T)
        most = distance if sizes is None else distance[np.minimum(np.maximum(sizes[x], sizes[y]), len(distance) - 1)]
        near = (bits <= most) & (bits > 0)
        x, y = own[x[near]], own[y[near]]
        span = forest.add(x, y)
        xs.append(x[span])
        ys.append(y[span])
        left, cost = left[n:], cost[n:]
    return names[np.concatenate(xs)], names[np.concatenate(ys)]


def thinned(found: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span all links of a task; no more than about ``most`` are held."""
    a = b = np.zeros(0, np.uint64)

    def span() -> tuple[np.ndarray, np.ndarray]:
        names, place = np.unique(np.r_[a, b], return_inverse=True)
        kept = Forest(len(names)).add(place[: len(a)], place[len(a) :])
        return a[kept], b[kept]

    for p, q in found:
        a, b = np.r_[a, p], np.r_[b, q]
        if len(a) > most:
            a, b = span()
            if len(a) > most // 2:
                yield a, b
                a = b = np.zeros(0, np.uint64)
    yield span()


def _u64(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.asarray(column).astype(np.int64, copy=False).view(np.uint64)


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v.view(np.int64) if v.dtype == np.uint64 else v) for k, v in columns.items()})


def fingerprint_table(df: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) of each row, fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tv.slices(batches):
            fp = fingerprints(b.column(1).to_pylist(), shingle)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])
        tv.trim()

    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def wide_table(df: DataFrame, id_col: str, text_col: str, shingle: int = WIDE_SHINGLE, words: int = WIDE) -> DataFrame:
    """(id, v, n, c, w0, w1 …): the hash of each row's set of shingles, its size, the name of the words compared at anchors, and all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tv.slices(batches):
            fps, name, size = wide_fingerprints(b.column(1).to_pylist(), shingle, words)
            columns = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (name, size, name_of(fps[:, :MET]), *fps.T)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["id", "v", "n", "c", *[f"w{k}" for k in range(words)]])
        tv.trim()

    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, v long, n long, c long, " + ", ".join(f"w{k} long" for k in range(words)))


def _placed(dealt: DataFrame, words: list[str]) -> DataFrame:
    """(place, mark, words): members by the anchor at which they are compared, or by a pair of tiles of an anchor with very many.

    Of such an anchor, those at home go by their tile to each other tile, and all
    members to each tile of homes, so that every home still meets every member.
    """
    hot = written(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("key", F.ceil(F.col("n") / HOT).alias("tiles")), "simhash-hot")
    n = hot.count()
    if not n:
        return dealt.select(F.col("key").alias("place"), "mark", *words)
    joined = dealt.join(F.broadcast(hot), "key", "left") if n <= BROADCAST_ROWS else dealt_join(dealt, "key", hot, F.col(words[0]), "left")
    own, every = F.pmod(F.xxhash64(*words), F.col("tiles")), F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)
    at_home = F.col("mark") % 2 == 1
    pair = lambda i, j, mark: F.struct(F.xxhash64("key", i, j).alias("place"), mark.alias("mark"))
    away = F.transform(every, lambda i: pair(i, own, F.col("mark") - F.col("mark") % 2))
    both = F.when(at_home, F.concat(F.transform(every, lambda j: pair(own, j, F.col("mark"))), away)).otherwise(away)
    one = F.array(F.struct(F.col("key").alias("place"), F.col("mark")))
    return joined.select(F.explode(F.when(F.col("tiles").isNull(), one).otherwise(both)).alias("p"), *words).select("p.*", *words)


def anchor_links(vertices: DataFrame, words: int, cuts: list[tuple[int, int]], t: int, distance: int | np.ndarray, met: int = 1, least: float = 0.0) -> DataFrame:
    """Links (a, b) that connect all rows (n, w0, w1 …) which meet and differ in ``distance`` bits or fewer of the first ``met`` words."""
    fields = [f"w{k}" for k in range(words)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, fps = np.asarray(b.column(0)), np.stack([_u64(c) for c in b.columns[1:]], axis=1)
            for key, row, home in anchors(fps, cuts, t):
                yield _batch(key=key, mark=2 * size[row] + home, **{f: fps[row, k] for k, f in enumerate(fields[:met])})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for place, mark, *fps in _anchor_runs(batches):
                sizes = mark >> 1 if least else None
                yield links(place, np.stack([x.view(np.uint64) for x in fps], axis=1), (mark & 1).astype(bool), distance, sizes, least)

        for p, q in thinned(found()):
            yield _batch(a=np.minimum(p, q), b=np.maximum(p, q))
        tv.trim()

    kept = ", ".join(f"{f} long" for f in fields[:met])
    dealt = vertices.select("n", *fields).mapInArrow(deal, f"key long, mark long, {kept}")
    return _placed(dealt, fields[:met]).repartition("place").sortWithinPartitions("place").mapInArrow(compare, "a long, b long")


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (fp) within ``distance`` bits of each other."""
    return anchor_links(fps.select(F.lit(0).cast("long").alias("n"), F.col("fp").alias("w0")), 1, block_bits(blocks), distance // blocks, distance)


def _anchor_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of sorted batches (keys first), cut so that no key is cut."""
    kept: list[tuple[np.ndarray, ...]] = []
    for b in batches:
        if not b.num_rows:
            continue
        new = tuple(np.asarray(c) for c in b.columns)
        # The last key's rows may go on in the next batch.
        cut = int(np.searchsorted(new[0], new[0][-1]))
        if cut or (kept and kept[-1][0][-1] != new[0][0]):
            yield tuple(np.concatenate(x) for x in zip(*kept, tuple(x[:cut] for x in new), strict=True))
            kept = []
        kept.append(tuple(x[cut:] for x in new))
    if kept:
        yield tuple(np.concatenate(x) for x in zip(*kept, strict=True))


def alike(words: np.ndarray, tile: np.ndarray, sizes: np.ndarray, values: np.ndarray, similar: float, cross: bool, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Rows that span what pairs of ``similar`` sets connect; with ``cross``, of pairs over two tiles.

    ``values`` are the rows' sets one after another, each rising. Pairs whose distance
    over all words (but for ``exact``), or whose sizes, leave no doubt are not looked at;
    the others come nearest first, and only if they are still apart.
    """
    m, most = len(sizes), most_bits(similar, 64 * words.shape[1])
    far, xs, ys = [], [], []
    step = max(1, PAIRS // m)
    for k in range(0, m, step):
        own = np.arange(k, min(k + step, m))
        d = sum(np.bitwise_count(w[own][:, None] ^ w[None, :]).astype(np.uint16) for w in words.T)
        ok = (tile[own][:, None] < tile[None, :]) if cross else (own[:, None] < np.arange(m)[None, :])
        larger = np.maximum(sizes[own][:, None], sizes[None, :])
        ok &= np.minimum(sizes[own][:, None], sizes[None, :]) >= similar * larger - 1e-9
        if not exact:
            ok &= d <= most[np.minimum(larger, len(most) - 1)]
        p, q = np.nonzero(ok)
        far.append(d[p, q])
        xs.append(own[p].astype(np.int32))
        ys.append(q.astype(np.int32))
    order = np.argsort(np.concatenate(far), kind="stable")
    x, y = np.concatenate(xs)[order], np.concatenate(ys)[order]
    # Elements that only one set has are in no intersection.
    _, place, count = np.unique(values, return_inverse=True, return_counts=True)
    kept = count[place] > 1
    doc, n = np.repeat(np.arange(m), sizes)[kept], len(count)
    place, common = place[kept], np.bincount(doc, minlength=m)
    first, table = np.cumsum(common) - common, doc * n + place
    forest, a, b = Forest(m), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at, wide = 0, 1 << 16
    while at < len(x):
        i, j = x[at : at + wide], y[at : at + wide]
        at += wide
        while len(i):
            apart = forest.root[i] != forest.root[j]
            i, j = i[apart], j[apart]
            less = np.where(common[i] <= common[j], i, j)
            now = max(1, int(np.searchsorted(np.cumsum(common[less]), ELEMENTS, "right")))
            p, q, less = i[:now], j[:now], less[:now]
            if not len(p):
                break
            own, times = tv.ranges(first[less], common[less]), common[less]
            asked = np.repeat((p + q - less).astype(np.int64), times) * n + place[own]
            found = np.minimum(np.searchsorted(table, asked), max(len(table) - 1, 0))
            hit = table[found] == asked if len(table) else np.zeros(0, bool)
            same = np.bincount(np.repeat(np.arange(len(p)), times)[hit], minlength=len(p))
            good = same / np.maximum(sizes[p] + sizes[q] - same, 1) >= similar
            p, q = p[good], q[good]
            span = forest.add(p, q)
            a.append(p[span])
            b.append(q[span])
            i, j = i[now:], j[now:]
    return np.concatenate(a), np.concatenate(b)


def _set_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(v, tile, cross, part, sizes, values) of each place, whose rows come one after another."""
    kept: list[tuple[np.ndarray, ...]] = []
    last = None

    def whole() -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) for x in zip(*kept, strict=True))

    for b in batches:
        if not b.num_rows:
            continue
        place, *plain = (np.asarray(c) for c in b.columns[:5])
        sizes, values = np.asarray(b.column(5).value_lengths()), np.asarray(b.column(5).flatten())
        ends = np.cumsum(sizes)
        cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        for lo, hi in zip(cuts, np.r_[cuts[1:], len(place)], strict=True):
            if kept and place[lo] != last:
                yield whole()
                kept = []
            last = place[lo]
            kept.append((*(x[lo:hi] for x in plain), sizes[lo:hi], values[ends[lo] - sizes[lo] : ends[hi - 1]]))
    if kept:
        yield whole()


def prefix_links(df: DataFrame, vertices: DataFrame, text_col: str, similar: float, shingle: int) -> DataFrame:
    """Links (a, b) between names ``c`` of sets that share one of their rarest shingles.

    Of n shingles in one order for all sets, rarest first, so many as n - ceil(similar *
    n) + 1 cannot all miss those of a set that similar. Every shingle is shuffled, which
    is what makes this dearer than anchors.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tv.slices(batches):
            for _, made, h in shingle_sets(b.column(0).to_pylist(), shingle):
                name = np.add.reduceat(tv.mix(h ^ _P4), np.cumsum(made) - made)
                yield _batch(v=np.repeat(name, made), n=np.repeat(made, made).astype(np.int64), h=h)
        tv.trim()

    rows = df.select(F.col(text_col).alias("text")).mapInArrow(sets, "v long, n long, h long").distinct()
    rows = written(rows, "simhash-shingles")
    seen = written(rows.groupBy("h").agg(F.count(F.lit(1)).alias("seen")).filter("seen > 1"), "simhash-seen")
    # A shingle of one set alone comes before all others and links nothing.
    alone = rows.groupBy("v").agg(F.first("n").alias("n")).join(dealt_join(rows, "h", seen, F.col("v")).groupBy("v").agg(F.count(F.lit(1)).alias("shared")), "v")
    place = F.row_number().over(Window.partitionBy("v").orderBy("seen", "h"))
    ranked = dealt_join(rows.select("v", "h"), "h", seen, F.col("v")).withColumn("place", place)
    kept = ranked.join(alone, "v").filter(F.col("place") + F.col("n") - F.col("shared") <= F.col("n") - F.ceil(F.lit(similar) * F.col("n") - 1e-9) + 1)
    named = kept.join(vertices.select("v", "c"), "v").select("h", "c")
    return summed(named, "h", F.col("c"), "c").select(F.col("least_of_key").alias("a"), F.col("c").alias("b")).filter("a <> b")


def similar_links(df: DataFrame, vertices: DataFrame, id_col: str, text_col: str, similar: float, shingle: int, words: int = WIDE, exact: bool = False) -> DataFrame:
    """Links (a, b) between sets of shingles that connect all pairs which meet and have the similarity; all of that similarity if ``exact``."""
    fields = [f"w{k}" for k in range(words)]
    if exact:
        near = prefix_links(df, vertices, text_col, similar, shingle)
    else:
        near = anchor_links(vertices, words, wide_bits(words), 1, most_bits(similar, 64 * MET), MET, similar)
    near = written(near, "simhash-near")
    # Sets whose words at the anchors are equal are one vertex there.
    groups = written(connected_components(near).toDF("c", "root"), "simhash-groups")
    shared = vertices.groupBy("c").agg(F.count(F.lit(1)).alias("k")).join(groups, "c", "left").filter("root is not null or k > 1")
    shared = written(shared.select("c", F.coalesce("root", "c").alias("root")), "simhash-shared")
    members = written(dealt_join(vertices, "c", shared, F.col("v")).select("root", "v", F.col("first_id").alias("id"), "n", *fields), "simhash-members")
    tiles = F.ceil(F.sum(F.greatest("n", F.lit(LEAST_SET))) / TILE).alias("tiles")
    members = dealt_join(members, "root", members.groupBy("root").agg(tiles), F.col("v"))
    members = written(members.withColumn("tile", F.pmod(F.xxhash64("v"), F.col("tiles"))), "simhash-tiles")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("root", pa.int64()), ("tiles", pa.int64()), ("tile", pa.int64()), ("v", pa.int64()), ("part", pa.int64()), ("s", pa.list_(pa.int64()))])
        for b in tv.slices(batches):
            plain = [np.asarray(b.column(c)) for c in ("root", "tiles", "tile", "v")]
            fps = np.stack([np.asarray(b.column(f)) for f in fields], axis=1)
            for docs, made, h in shingle_sets(b.column(0).to_pylist(), shingle):
                first = np.cumsum(made) - made
                own = np.add.reduceat(tv.mix(h ^ _P4), first).view(np.int64) == plain[3][docs]
                # Another text of the same id is not the member's.
                docs, made, first = docs[own], made[own], first[own]
                if not len(docs):
                    continue
                pieces = -(-made // PIECE)
                part = tv.ranges(np.zeros(len(docs), np.int64), pieces)
                size = np.minimum(np.repeat(made, pieces) - part * PIECE, PIECE)
                row = np.r_[docs, np.repeat(docs, pieces)]
                values = np.r_[fps[docs].ravel(), h[tv.ranges(first, made)].view(np.int64)]
                ends = np.cumsum(np.r_[0, np.full(len(docs), words), size])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([*(pa.array(x[row]) for x in plain), pa.array(np.r_[np.full(len(docs), -1), part]), lists], schema=kind)
        tv.trim()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v, tile, cross, part, size, values in _set_runs(batches):
            # Rows come by v and part; part -1 has the words. A set that came twice counts once.
            once = np.r_[True, (v[1:] != v[:-1]) | (part[1:] != part[:-1])]
            fp = part == -1
            of = np.repeat(once & fp, size), np.repeat(once & ~fp, size)
            names = v[once & fp]
            made = np.bincount(np.searchsorted(names, v[once & ~fp]), weights=size[once & ~fp], minlength=len(names)).astype(np.int64)
            a, b = alike(values[of[0]].view(np.uint64).reshape(-1, words), tile[once & fp], made, values[of[1]].view(np.uint64), similar, bool(cross[0]), exact)
            yield _batch(a=np.minimum(names[a], names[b]), b=np.maximum(names[a], names[b]))
        tv.trim()

    texts = matched(df.select(F.col(text_col).alias("text"), F.col(id_col).alias("id")), "id", members, "inner", take=["root", "tiles", "tile", "v", *fields])
    found = texts.select("text", "root", "tiles", "tile", "v", *fields).mapInArrow(sets, "root long, tiles long, tile long, v long, part long, s array<long>")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other")
    placed = found.select("root", "tile", "v", "part", "s", other).select(
        F.xxhash64("root", F.least("tile", "other"), F.greatest("tile", "other")).alias("place"), "v", "tile", (F.col("tile") != F.col("other")).cast("long").alias("cross"), "part", "s"
    )
    return placed.repartition("place").sortWithinPartitions("place", "v", "part").mapInArrow(decide, "a long, b long")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
    distance: int = DISTANCE, blocks: int = BLOCKS, shingle: int = SHINGLE, similar: float | None = None, exact: bool = False,
) -> DataFrame:
    """One row for each input row: id, fp (long), component_id (the least id reachable).

    Rows are linked whose fingerprints differ in ``distance`` bits or fewer or, with
    ``similar``, whose sets of shingles have that Jaccard similarity (``fp`` then names
    the set), but for the few percent that ``recall`` states; with ``exact``, all. Equal fingerprints or sets are one vertex, so copies never meet each other.
    Null texts and texts without words have fingerprint 0 and are linked. A component
    with only null ids has a null ``component_id``. Rows that repeat, with or without
    other text, are rows of their own. An empty table gives no rows.
    """
    ship(df.sparkSession)
    if similar is None:
        rows = written(fingerprint_table(df, id_col, text_col, shingle).withColumnRenamed("fp", "v"), "simhash")
        vertices = written(rows.groupBy("v").agg(F.min("id").alias("first_id")), "simhash-distinct")
        found = fingerprint_links(vertices.select(F.col("v").alias("fp")), distance, blocks)
    else:
        rows = written(wide_table(df, id_col, text_col, shingle), "simhash-wide")
        others = [c for c in rows.columns if c not in ("id", "v")]
        vertices = written(rows.groupBy("v").agg(F.min("id").alias("first_id"), *[F.first(c).alias(c) for c in others]), "simhash-distinct")
        found = similar_links(df, vertices, id_col, text_col, similar, shingle, exact=exact)
    found = written(found, "simhash-links")
    roots = written(connected_components(found), "simhash-roots")
    linked = roots.join(vertices.select("v", "first_id"), "v")
    least = written(summed(linked, "root", F.col("v"), "first_id").select("v", F.col("least_of_key").alias("least")), "simhash-least")
    whole = vertices.join(least, "v", "left").select("v", F.coalesce("least", "first_id").alias("component_id"))
    whole = written(whole, "simhash-components")
    return dealt_join(rows.select("id", "v"), "v", whole, F.col("id")).select("id", F.col("v").alias("fp"), "component_id")


def near_dedup_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """One row for each input row: id, fingerprint (16 digits) and component_id, as ``near_duplicates`` has them."""
    found = near_duplicates(df, id_col, text_col, **options)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """The input rows with the least id of each component, with all their columns.

    Of rows that share that id, the first by a hash of all their columns stays. Rows
    with a null id stay only where their component has no id, one of them. Columns may
    have any names. An empty table gives no rows.
    """
    found = near_duplicates(df, id_col, text_col, **options).groupBy("id").agg(
        F.max(F.col("id").eqNullSafe(F.col("component_id"))).alias("kept"), F.count(F.lit(1)).alias("n")
    )
    found = written(found.filter("not kept or n > 1"), "simhash-kept")
    stay = matched(df, id_col, written(found.filter("not kept").select("id"), "simhash-dropped"), "left_anti")
    again = written(found.filter("kept and n > 1").select("id"), "simhash-again")
    if again.isEmpty():
        return stay
    rows = matched(stay, id_col, again, "left_semi")
    row = F.struct(*[rows[c] for c in rows.columns])
    one = rows.select(row.alias("row"), F.xxhash64(F.to_json(row)).alias("order"), rows[id_col].alias("_id")).groupBy("_id").agg(F.min_by("row", "order").alias("row"))
    return matched(stay, id_col, again, "left_anti").union(one.select("row.*"))
