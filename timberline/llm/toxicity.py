"""Toxicity scores of deobfuscated text: a noisy channel, then logistic regression.

Tokens that look disguised (digits or signs among letters, letters spaced out or
repeated) become a lattice of the letters that each character may stand for, with the
cost of each disguise. The cheapest path under a character 4-gram model of all
documents is the restored text. Its words and word beginnings are the features of the
score; other text is taken as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .ftrl import Model, Settings, sigmoid, train
from .quality import held_out
from .runtime import ship

SETTINGS = Settings(bits=22, alpha=1.0, l1=0.0, l2=0.001, shards=4, rounds=6, most_rows=16_000, screen=4.0, bias=-3.0)
THRESHOLD = 0.7
#: Bytes of a word's beginning that are features of their own.
PREFIXES = (4, 5, 6)
ORDER = 4
SYMBOLS = 27

#: What each sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "tl", "8": "b", "9": "gq",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l",
}
SEPARATORS = " \t._-*/,~'"
#: Costs in nats.
SWAP, KEEP_SIGN, SKIP, KEEP_SEPARATOR = 1.0, 7.0, 0.5, 3.0
ABSORB, KEEP_REPEAT, ABSORB_DOUBLE = 0.1, 4.0, 6.0

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LEET if ord(c) < 128]] = True
#: Signs of more than one byte.
_LONG_SIGNS = [c.encode() for c in LEET if ord(c) >= 128]
_SEP = np.zeros(256, bool)
_SEP[[ord(c) for c in SEPARATORS if not c.isspace()]] = True
_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[97:123] = np.arange(1, 27)


def gram_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of the 4-grams over letters and one symbol for all else."""
    out = np.zeros(SYMBOLS**ORDER, np.int64)
    raw = [(t or "").lower().encode() for t in texts]
    for a, b in tv.chunks(raw):
        x = _SYMBOL[np.frombuffer(b"   " + b"   ".join(raw[a:b]) + b" ", np.uint8)]
        g = x[: -ORDER + 1]
        for k in range(1, ORDER):
            g = g * SYMBOLS + x[k : len(x) - ORDER + 1 + k]
        out += np.bincount(g, minlength=len(out))
    return out


def language_model(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """-log P(symbol | three before) from all texts: at most 27**4 counts ever leave a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**ORDER, np.int64)
        for b in tv.slices(batches):
            total += gram_counts(b.column(0).to_pylist())
        at = np.flatnonzero(total)
        tv.trim()
        yield pa.RecordBatch.from_pydict({"gram": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})

    ship(df.sparkSession)
    found = df.select(text_col).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SYMBOLS**ORDER)
    counts[found["gram"].to_numpy()] = found["n"].to_numpy()
    return costs(counts)


def costs(counts: np.ndarray, strength: float = 5.0) -> np.ndarray:
    """Each order is smoothed by the one below."""
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(1, ORDER + 1):
        c = counts.reshape(-1, SYMBOLS**order).sum(0).reshape(-1, SYMBOLS)
        lower = np.tile(p.reshape(-1, SYMBOLS), (len(c) // max(1, p.size // SYMBOLS), 1)) if order > 1 else p[None, :]
        p = (c + strength * lower) / (c.sum(1, keepdims=True) + strength)
    return (-np.log(p)).astype(np.float32).ravel()


def restore(token: str, lm: np.ndarray) -> str:
    """The cheapest reading of one token, of equally cheap ones the first by code point: Viterbi over all states (last three symbols).

    A path is a chain of what it emits, shared with the paths that it came from, so
    that memory grows with the token and not with its square.
    """
    base = SYMBOLS ** (ORDER - 1)
    states: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    n = len(token)
    run = 1
    for i, c in enumerate(token):
        run = run + 1 if i and token[i - 1] == c else 1
        letter = "a" <= c <= "z"
        long_run = run >= 3 or (run == 2 and i + 1 < n and token[i + 1] == c)
        # (letters to emit or None for nothing, cost); "" emits the character as it is.
        ways: list[tuple[str | None, float]] = []
        if letter:
            ways.append((c, KEEP_REPEAT if long_run else 0.0))
            if run > 1:
                ways.append((None, ABSORB if long_run else ABSORB_DOUBLE))
        elif c in LEET:
            ways += [(x, SWAP) for x in LEET[c]]
            ways.append(("", KEEP_SIGN))
            if run > 1:
                ways.append((None, ABSORB if long_run else ABSORB_DOUBLE))
        elif c in SEPARATORS:
            ways += [(None, SKIP), ("", KEEP_SEPARATOR)]
        else:
            ways.append(("", 0.0))
        new: dict[int, tuple[float, tuple | None]] = {}
        for state, (cost, path) in states.items():
            for way, extra in ways:
                if way is None:
                    to, total, out = state, cost + extra, path
                else:
                    symbol = ord(way) - 96 if way else 0
                    gram = state * SYMBOLS + symbol
                    to, total, out = gram % base, cost + extra + float(lm[gram]), (path, way or c)
                if to not in new or total < new[to][0]:
                    new[to] = total, out
        states = new
    last = [(cost + float(lm[state * SYMBOLS]), path) for state, (cost, path) in states.items()]
    least = min(cost for cost, _ in last)
    return min(_emitted(path) for cost, path in last if cost == least)


def _emitted(path: tuple | None) -> str:
    out = []
    while path:
        path, c = path
        out.append(c)
    return "".join(reversed(out))


def _symbols(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all letters and signs, and which bytes belong to signs."""
    first, sign = _LETTER[buf] | _SIGN[buf], _SIGN[buf]
    width = first.astype(np.int64)
    for raw in _LONG_SIGNS:
        found = buf[: max(0, len(buf) - len(raw) + 1)] == raw[0]
        for k in range(1, len(raw)):
            found = found & (buf[k : k + len(found)] == raw[k])
        at = np.flatnonzero(found)
        width[at] = len(raw)
        sign[at[:, None] + np.arange(len(raw))] = True
    starts = np.flatnonzero(width)
    return starts, starts + width[starts], sign


def disguised(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the lower-cased buffer to restore: whole tokens, words with a letter twice in a row, and runs of single letters and signs."""
    n = len(buf)
    pad = np.zeros(n + 8, np.uint8)
    pad[1 : n + 1] = buf
    at = lambda k: pad[1 + k : 1 + k + n]
    letter = _LETTER[buf]
    symbols, symbol_ends, signs = _symbols(buf)
    sign = _SIGN[buf]
    next_letter, last_letter = _LETTER[at(1)], _LETTER[pad[:n]]
    next_word = tv.WORD[at(1)] | _SIGN[at(1)]
    # The last byte of a sign before a letter, of any sign's bytes.
    hit = signs & next_letter
    # A sign that ends a word, if it isn't the first of three or plain punctuation.
    hit |= sign & last_letter & (buf != ord("!")) & (~next_word | ((at(1) == buf) & ~(tv.WORD[at(2)] | _SIGN[at(2)])))
    wordy = tv.WORD[pad] | _SIGN[pad]
    for raw in _LONG_SIGNS:
        own = symbols[(symbol_ends - symbols == len(raw)) & (buf[symbols] == raw[0])]
        again = np.isin(own + len(raw), own)
        hit[own] |= last_letter[own] & ~wordy[1 + own + np.where(again, 2, 1) * len(raw)]
    twice = letter & (at(1) == buf)
    hit |= twice & (at(2) == buf)
    sep = _SEP[buf]
    single = sep & last_letter & next_letter
    hit |= single & _SEP[at(2)] & _LETTER[at(3)] & _SEP[at(4)] & _LETTER[at(5)]
    starts, ends = tv.spans(~tv.SPACE[buf])
    if not len(starts):
        return starts, ends
    # Three or more single letters or signs, a letter among them, with nothing but separators and space between.
    alone = ~wordy[symbols] & ~wordy[1 + symbol_ends]
    a, b = symbols[alone], symbol_ends[alone]
    if len(a) > 2:
        other = np.concatenate([[0], np.cumsum(~(sep | tv.SPACE[buf]))])
        cut = np.flatnonzero(np.r_[True, other[a[1:]] > other[b[:-1]]])
        size = np.diff(np.r_[cut, len(a)])
        run = np.flatnonzero((size >= 3) & (np.add.reduceat(letter[a].astype(np.int64), cut) > 0))
        a, b = a[cut[run]], b[cut[run] + size[run] - 1]
    else:
        a = b = np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(hit)])
    marked = total[ends] > total[starts]
    words, word_ends = tv.spans(tv.WORD[buf] & ~signs)
    pairs = np.concatenate([[0], np.cumsum(twice)])
    # A word before three equal signs is left as it is, unless something else marks it.
    tail = pad[1 + word_ends]
    doubled = (pairs[word_ends] > pairs[words]) & ~(_SIGN[tail] & (tail == pad[2 + word_ends]) & (tail == pad[3 + word_ends]))
    starts = np.concatenate([starts[marked], words[doubled], a])
    ends = np.concatenate([ends[marked], word_ends[doubled], b])
    if not len(starts):
        return starts, ends
    # What overlaps is restored as one.
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.r_[True, starts[1:] >= reach[:-1]])
    return starts[new], reach[np.r_[new[1:] - 1, len(reach) - 1]]


class Restorer:
    """Restores texts; each distinct token is decoded once."""

    def __init__(self, lm: np.ndarray, limit: int = 200_000):
        self.lm, self.limit, self.seen = lm, limit, {}

    def token(self, token: bytes) -> bytes:
        out = self.seen.get(token)
        if out is None:
            if len(self.seen) >= self.limit:
                self.seen.clear()
            out = self.seen[token] = restore(token.decode("utf-8", "replace"), self.lm).encode()
        return out

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[int, int, list[bytes]]]:
        """(first, last + 1, restored lower-cased texts) in chunks."""
        raw = [(t or "").lower().encode() for t in texts]
        for a, b in tv.chunks(raw):
            out = raw[a:b]
            buf, bounds = tv.joined(out)
            starts, ends = disguised(buf)
            doc = np.searchsorted(bounds, starts, "right") - 1
            for d in np.unique(doc).tolist():
                text, at, parts = out[d], 0, []
                for s, e in zip((starts[doc == d] - bounds[d]).tolist(), (ends[doc == d] - bounds[d]).tolist(), strict=True):
                    parts += [text[at:s], self.token(text[s:e])]
                    at = e
                out[d] = b"".join([*parts, text[at:]])
            yield a, b, out


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and word beginnings of all texts, and their texts."""
    buf, bounds = tv.joined(texts)
    starts, ends = tv.spans(tv.WORD[buf])
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc = np.searchsorted(bounds, starts, "right") - 1
    h = tv.Hasher(buf)
    keys, docs = [h(starts, ends)], [doc]
    for k in PREFIXES:
        i = np.flatnonzero(ends - starts > k)
        keys.append(tv.mix(h(starts[i], starts[i] + k) + np.uint64(k)))
        docs.append(doc[i])
    return np.concatenate(keys), np.concatenate(docs)


def features_of(lm: np.ndarray):
    restorer: list[Restorer] = []

    def features(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        if not restorer:
            restorer.append(Restorer(lm))
        out = []
        for _, _, clean in restorer[0](texts):
            keys, doc = word_keys(clean)
            order = np.argsort(doc, kind="stable")
            keys = keys[order]
            cuts = np.searchsorted(doc[order], np.arange(len(clean) + 1))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                _, first = np.unique(keys[a:b] >> np.uint64(64 - SETTINGS.bits), return_index=True)
                out.append((keys[a:b][first], np.ones(len(first))))
        return out

    return features


def scores(model: Model, table: np.ndarray, restorer: Restorer, texts: list[str | None]) -> np.ndarray:
    out = np.full(len(texts), model.bias)
    for a, b, clean in restorer(texts):
        keys, doc = word_keys(clean)
        at, place = model.find(keys, table)
        # A feature counts once in a text.
        pairs = np.unique(doc[at] * len(model.keys) + place) if len(at) else at
        if len(pairs):
            text = pairs // len(model.keys)
            total = np.bincount(text, model.weights[pairs % len(model.keys)], minlength=b - a)
            out[a:b] += total * SETTINGS.scale / np.sqrt(np.maximum(np.bincount(text, minlength=b - a), 1))
    return sigmoid(out)


class Toxicity:
    """A language model of all ``docs`` and a score learnt from ``labels`` (doc_id, toxic)."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = SETTINGS):
        self.id_col, self.text_col = id_col, text_col
        self.lm = language_model(docs, text_col)
        self.model = train(docs, labels, id_col, text_col, F.col("toxic"), features_of(self.lm), settings)

    def score(self, df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
        """(id, score, predicted) of each row; null texts count as empty and get the score of no words."""
        shared = df.sparkSession.sparkContext.broadcast((self.lm, self.model))
        id_col = self.id_col

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lm, model = shared.value
            table, restorer = model.filter_table(), Restorer(lm)
            for b in tv.slices(batches):
                s = scores(model, table, restorer, b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

        rows = df.select(df[id_col], df[self.text_col])
        return rows.mapInArrow(run, f"{id_col} {rows.schema[0].dataType.simpleString()}, score double, predicted int")

    def accepted(self, df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
        """The input rows whose text is not judged toxic, with all their columns."""
        shared = df.sparkSession.sparkContext.broadcast((self.lm, self.model))
        k = df.columns.index(self.text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lm, model = shared.value
            table, restorer = model.filter_table(), Restorer(lm)
            for b in tv.slices(batches):
                yield b.filter(pa.array(scores(model, table, restorer, b.column(k).to_pylist()) < threshold))
            restorer.seen.clear()
            tv.trim()

        return df.mapInArrow(run, df.schema)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted; labels of held-out rows are never read.

    One row for each row of ``docs``, repeated ones too. Null and empty texts get the
    score of no words; a score equal to the threshold is predicted. Rows without an id
    are not held out and have no label. An empty table gives no rows.
    """
    judge = Toxicity(docs, labels.filter(~held_out("doc_id", 3, 1)))
    return judge.score(docs).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")
