"""How the sources of a language differ in the words they use.

Words are counted within tasks for each (lang, source), so that only counts are moved.
A group's postings, the kept terms that occur in it, are summed up in buckets of like
counts. Within a bucket, the group's highest probability less the language's lowest
bounds how far any of its terms stands out. Buckets are looked at in order of their
bounds: first as many as hold enough terms, then those whose bound is not strictly below
the last place found so far. No term of a bucket left out can come in or tie.

Sources are compared by postings: tiles of sources meet for a share of the terms and add
up differences over the terms that occur in a tile; what occurs in neither differs by a
constant.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .runtime import BROADCAST_ROWS, dealt_join, ship, written

SCALE = 1_000_000_000
PRIOR = 5
#: A term is kept if it is in so many documents of its language.
LEAST = 30
TOP = 50
#: Sources of a tile, postings of a (language, tiles) share on average, terms that are compared at once.
TILE = 64
SHARE = 200_000
TERMS_AT_ONCE = 2_048
#: Buckets of counts for each doubling.
STEPS = 8
PART_BYTES = 1 << 20

#: Bytes of terms: Latin letters and all bytes of non-ASCII characters.
TERM = np.zeros(256, bool)
TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
BETWEEN = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")

GROUP = ["lang", "source"]


def _parts(raw: bytes) -> Iterator[bytes]:
    """A long text cut between terms."""
    at = 0
    while at < len(raw):
        found = BETWEEN.search(raw, at + PART_BYTES)
        end = found.start() if found else len(raw)
        yield raw[at:end]
        at = end


def _terms(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct terms, and for each occurrence its text and its place among them."""
    buf, bounds = tv.joined(texts)
    starts, ends = tv.spans(TERM[buf])
    low = tv.LOWER[buf]
    if not len(starts):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, place = tv.distinct(low, starts, ends)
    data = low.tobytes()
    names = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    return names, np.searchsorted(bounds, starts, "right") - 1, place


def _tally(groups: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(groups * np.int64(n) + place, return_counts=True)


def _counted(texts: list[bytes], groups: np.ndarray) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]]:
    """(group, term, occurrences, documents) of bounded runs of texts."""
    for a, b in tv.chunks(texts, PART_BYTES):
        if b - a == 1 and len(texts[a]) > 2 * PART_BYTES:
            seen: set[bytes] = set()
            for part in _parts(texts[a]):
                names, _, place = _terms([part])
                new = np.array([t not in seen for t in names], np.int64)
                seen.update(names)
                yield np.full(len(names), groups[a]), names, np.bincount(place, minlength=len(names)), new
            continue
        names, doc, place = _terms(texts[a:b])
        if not names:
            continue
        n = len(names)
        keys, counts = _tally(groups[a:b][doc], place, n)
        of_docs = np.unique(doc * np.int64(n) + place)
        same, docs = _tally(groups[a:b][of_docs // n], of_docs % n, n)
        assert (same == keys).all()
        yield keys // n, [names[k] for k in (keys % n).tolist()], counts, docs


def term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in the group, and its documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tv.slices(batches):
            pairs = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            index = {p: k for k, p in enumerate(dict.fromkeys(pairs))}
            known = list(index)
            texts = [t.encode() for t in b.column(2).to_pylist()]
            for group, names, n, m in _counted(texts, np.array([index[p] for p in pairs], np.int64)):
                group = group.tolist()
                langs, sources = pa.array([known[g][0] for g in group], pa.string()), pa.array([known[g][1] for g in group], pa.string())
                yield pa.RecordBatch.from_arrays([langs, sources, pa.array(names, pa.binary()).cast(pa.string()), pa.array(n.astype(np.int64)), pa.array(m.astype(np.int64))], [*GROUP, "term", "n", "docs"])
        tv.trim()

    ship(docs.sparkSession)
    empty = F.lit("")
    rows = docs.select(*[F.coalesce(docs[c], empty).alias(c) for c in GROUP], F.coalesce(docs[text_col], empty).alias("text"))
    found = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(count: Column | str, total: Column | str, kept: Column | str) -> Column:
    """1 + floor(10**9 * (count + 5) / (total + 5 * kept)), exact for any long; null without kept terms."""
    n, total, kept = ((F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)") for c in (count, total, kept))
    prior = F.lit(PRIOR).cast("decimal(1,0)")
    below = F.nullif(total + prior * kept, F.lit(0).cast("decimal(1,0)"))
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + prior), below)


class Audit:
    """Counts of the kept terms of a table of documents, from which both parts are answered."""

    def __init__(self, docs: DataFrame, text_col: str = "text", least: int = LEAST):
        counts = term_counts(docs, text_col)
        same = Window.partitionBy("lang", "term")
        marked = counts.select(
            *GROUP, "term", "n", F.sum("n").over(same).alias("lang_n"), F.sum("docs").over(same).alias("lang_docs"), (F.min("source").over(same) == F.col("source")).alias("head")
        ).filter(F.col("lang_docs") >= least)
        self.postings = written(marked.drop("lang_docs"), "divergence-postings")
        self.n = self.postings.count()
        empty = F.lit("")
        occurring = docs.select(*[F.coalesce(docs[c], empty).alias(c) for c in GROUP]).distinct()
        sums = self.postings.groupBy(*GROUP).agg(F.sum("n").alias("total"), F.sum(F.col("head").cast("long")).alias("heads"))
        of_lang = sums.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("heads").alias("kept"))
        zero = F.lit(0).cast("long")
        groups = occurring.join(sums.drop("heads"), GROUP, "left").join(of_lang, "lang", "left")
        groups = groups.select(*GROUP, *[F.coalesce(c, zero).alias(c) for c in ("total", "lang_total", "kept")])
        place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        self.groups = written(groups.withColumn("none", probability(zero, "total", "kept")).withColumn("place", place), "divergence-groups")
        self.small = self.groups.count() <= BROADCAST_ROWS

    def scored(self, rows: DataFrame) -> DataFrame:
        """Postings with ``p``, the group's probability, ``q``, the language's, and the group's place."""
        keyed, g = rows.withColumn("g", F.struct(*GROUP)), self.groups.withColumn("g", F.struct(*GROUP)).drop(*GROUP)
        both = keyed.join(F.broadcast(g), "g") if self.small else dealt_join(keyed, "g", g, F.col("term"))
        return both.withColumn("p", probability("n", "total", "kept")).withColumn("q", probability("lang_n", "lang_total", "kept")).drop("g")

    def terms(self, top: int = TOP) -> DataFrame:
        """(lang, source, item, value, rank) of the terms that stand out most in each group."""
        rows = self.scored(self.postings).select(*GROUP, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"), "p", "q", F.floor(F.log2("n") * STEPS).cast("int").alias("bucket"))
        buckets = rows.groupBy(*GROUP, "bucket").agg((F.max("p") - F.min("q")).alias("bound"), F.count(F.lit(1)).alias("terms"))
        best_first = Window.partitionBy(*GROUP).orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
        buckets = buckets.filter("bound > 0").withColumn("before", F.coalesce(F.sum("terms").over(best_first), F.lit(0)))
        buckets = written(buckets.withColumn("now", F.col("before") < top), "divergence-buckets")
        ranked = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))

        def best(found: DataFrame) -> DataFrame:
            return found.withColumn("rank", ranked).filter(F.col("rank") <= top)

        def within(chosen: DataFrame) -> DataFrame:
            return rows.join(chosen.select(*GROUP, "bucket"), [*GROUP, "bucket"], "left_semi").filter("value > 0").select(*GROUP, "item", "value")

        first = written(best(within(buckets.filter("now"))), "divergence-first")
        last_place = first.filter(F.col("rank") == top).select(*GROUP, F.col("value").alias("kth"))
        unseen = buckets.filter("not now").join(last_place, GROUP, "left").filter("kth is null or bound >= kth")
        return best(first.drop("rank").unionByName(within(unseen)))

    def pairs(self) -> DataFrame:
        """(lang, source, item, value, rank): how far each other source of the language is, over all kept terms."""
        tile = F.floor(F.col("place") / TILE).cast("int")
        shares = 1 + self.n // SHARE
        g = self.groups
        last = g.groupBy("lang").agg(F.max(tile).alias("last"))
        # A posting goes wherever its tile meets another.
        others = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")

        def dealt(rows: DataFrame) -> DataFrame:
            met = rows.join(F.broadcast(last) if self.small else last, "lang").withColumn("tile", tile).select("*", others)
            return met.select("lang", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "share", "term", "place", "p")

        postings = self.scored(self.postings).select("lang", "term", "place", "p", F.pmod(F.xxhash64("term"), F.lit(shares)).alias("share"))
        marks = g.filter("kept > 0").select("lang", F.lit(None).cast("string").alias("term"), "place", F.col("none").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))).alias("share"))
        schema, width = "lang string, a int, b int, sum long, terms long", TILE

        def differences(rows: pd.DataFrame) -> pd.DataFrame:
            return _differences(rows, width)

        met = dealt(postings).unionByName(dealt(marks)).groupBy("lang", "a", "b", "share").applyInPandas(differences, schema)
        sums = met.groupBy("lang", "a", "b").agg(F.sum("sum").alias("sum"), F.sum("terms").alias("terms"))
        one = g.select("lang", F.col("source").alias("x"), F.col("place").alias("a"), F.col("none").alias("x_none"), "kept")
        two = g.select("lang", F.col("source").alias("y"), F.col("place").alias("b"), F.col("none").alias("y_none"))
        halves = one.join(two, (one.lang == two.lang) & (one.a < two.b)).drop(two.lang).join(sums, ["lang", "a", "b"], "left")
        zero = F.lit(0).cast("long")
        value = F.coalesce("sum", zero) + (F.col("kept") - F.coalesce("terms", zero)) * F.coalesce(F.abs(F.col("x_none") - F.col("y_none")), zero)
        halves = halves.select("lang", "x", "y", value.alias("value"))
        both = halves.select("lang", F.col("x").alias("source"), F.col("y").alias("item"), "value").union(halves.select("lang", "y", "x", "value"))
        return both.withColumn("rank", F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")))


def _differences(rows: pd.DataFrame, tile: int) -> pd.DataFrame:
    """For each two sources of two tiles: the sum of differences over the share's terms that occur in a tile, and how many these are."""
    lang, a, b = rows["lang"].iloc[0], int(rows["a"].iloc[0]), int(rows["b"].iloc[0])
    mark = rows["term"].isna().to_numpy()
    place, p = rows["place"].to_numpy(np.int64), rows["p"].to_numpy(np.int64)
    term, names = pd.factorize(rows["term"][~mark])
    in_tile = [np.unique(place[mark & (place // tile == t)]) for t in (a, b)]
    none = dict(zip(place[mark].tolist(), p[mark].tolist(), strict=True))
    sums = np.zeros((len(in_tile[0]), len(in_tile[1])), np.int64)
    order = np.argsort(term, kind="stable")
    term, place, p = term[order], place[~mark][order], p[~mark][order]
    for at in range(0, len(names), TERMS_AT_ONCE):
        lo, hi = np.searchsorted(term, [at, at + TERMS_AT_ONCE])
        n = min(TERMS_AT_ONCE, len(names) - at)
        sides = []
        for t, sources in zip((a, b), in_tile, strict=True):
            side = np.tile(np.array([none[s] for s in sources.tolist()], np.int64), (n, 1))
            here = lo + np.flatnonzero(place[lo:hi] // tile == t)
            side[term[here] - at, np.searchsorted(sources, place[here])] = p[here]
            sides.append(side)
        for k in range(len(in_tile[0])):
            sums[k] += np.abs(sides[1] - sides[0][:, k : k + 1]).sum(0)
    x, y = np.meshgrid(in_tile[0], in_tile[1], indexing="ij")
    use = x < y
    return pd.DataFrame({"lang": lang, "a": x[use].astype(np.int32), "b": y[use].astype(np.int32), "sum": sums[use], "terms": np.int64(len(names))})


def divergence(docs: DataFrame, text_col: str = "text", *, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: how far apart the sources of a language are, and by which terms.

    Terms are runs of Latin letters and non-ASCII characters, A-Z lower-cased. A
    language keeps those in ``least`` of its documents or more. A term's probability is
    1 + floor(10**9 * (n + 5) / (N + 5 * V)) for its ``n`` of ``N`` occurrences of the
    ``V`` kept terms, in a (lang, source) or in a lang.

    Part ``pair`` has each other source of the language, with the differences of all
    kept terms summed up (0 if none is kept); part ``term`` the ``top`` terms that are in
    the group and more probable there than in the language. Ranks are 1 and up by value,
    highest first, ties by item in UTF-8 order.

    Null lang, source and text count as empty; repeated rows are documents of their own;
    groups without terms have pairs; an empty table gives no rows; other columns, of any
    names, are not read. A text of any length is counted part by part.
    """
    audit = Audit(docs, text_col, least)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return (
        audit.pairs().withColumn("part", F.lit("pair")).select(*columns).union(audit.terms(top).withColumn("part", F.lit("term")).select(*columns))
    )


def oracle_sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    p = "1 + (1000000000::HUGEINT * ({} + 5)) // ({} + 5 * v)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS lang_n FROM c GROUP BY ALL HAVING sum(docs) >= {LEAST}),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY lang),
s AS (SELECT c.lang, c.source, sum(c.n) AS total FROM c JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT o.lang, o.source, coalesce(s.total, 0) AS total, v.v, v.lang_total FROM (SELECT DISTINCT lang, source FROM d) o LEFT JOIN s USING (lang, source) LEFT JOIN v USING (lang)),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {p.format("coalesce(c.n, 0)", "g.total")} AS p, {p.format("k.lang_n", "g.lang_total")} AS q
    FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM x WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
FROM (SELECT * FROM pair UNION ALL SELECT * FROM term) QUALIFY part = 'pair' OR rank <= {TOP}
"""
