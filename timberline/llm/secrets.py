"""Secret scans in DataFrame functions only: patterns, and entropy in sliding windows.

Positions come from splitting a text at a pattern: the pieces and matches in turn add
up to code-point offsets. Candidate strings are scanned once with a window whose
character counts change by one character in and one out; the sum of c*log2(c) is kept
in integers, so that no rounding depends on the order of the additions. Time grows with
the length of a text and of its candidates.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 1 << 20


@dataclass(frozen=True)
class Pattern:
    """``group`` of a match has at least ``least`` characters, or the match is dropped."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


#: Maximal runs of one class with a least length are found as such, which gives what finding all runs and dropping short ones does.
PATTERNS = (
    Pattern("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Pattern("access", r"AKIA[A-Z0-9]{16,}"),
    Pattern("hex", r"[0-9a-f]{24,}"),
)


@dataclass(frozen=True)
class CharClass:
    """Runs of ``alphabet`` of at least ``window`` characters are candidates.

    A window with ``bits`` or more of entropy for each character is suspicious.
    """

    kind: str
    alphabet: str
    bits: float
    window: int = 20

    @property
    def regex(self) -> str:
        return f"[{self.alphabet.replace('-', '')}{'-' * ('-' in self.alphabet)}]{{{self.window},}}"

    @property
    def logs(self) -> list[int]:
        """c*log2(c) for the counts 0 … window."""
        return [round(c * math.log2(c) * SCALE) if c else 0 for c in range(self.window + 1)]

    @property
    def most(self) -> int:
        """A window is suspicious when its sum of c*log2(c) is no larger."""
        return math.floor((math.log2(self.window) - self.bits) * self.window * SCALE)


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    CharClass("hex_entropy", "0123456789abcdefABCDEF", 3.0),
    CharClass("base64_entropy", _UPPER + _LOWER + _DIGITS + "+/=_-", 3.7),
)

#: Candidates with any of these are no secrets: no digit, no letter, UUIDs, alphabets in order, placeholders.
ALLOWED = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"0123456789|abcdefghij|ABCDEFGHIJ",
    r"EXAMPLE|example",
)
#: Nor are words and numbers in a row: they start with one, and no letter stands beside a digit. No pattern repeats a group, which would need stack for each repeat.
IN_A_ROW, MIXED = r"^[A-Za-z0-9][A-Za-z0-9_/=+-]*$", r"[A-Za-z][0-9]|[0-9][A-Za-z]"
#: Sums of piece lengths are kept for blocks of so many matches.
BLOCK = 256


def allowed(value: Column) -> Column:
    return value.rlike("|".join(ALLOWED)) | (value.rlike(IN_A_ROW) & ~value.rlike(MIXED))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), f), 0)


def _spans(text: Column, kind: str, rank: int, regex: str, group: int = 0, least: int = 0) -> Column:
    """Array of (start, rank, end, kind, value) of the matches, in code points."""
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(regex), F.lit(group)) if group else F.lit(None)
    steps = F.zip_with(F.split(text, regex, -1), found, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("size")))
    add = lambda acc, x: acc + x["gap"] + x["size"]

    def placed(z: Column) -> Column:
        n = F.size(z["found"])
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda k: F.aggregate(F.slice(z["steps"], k * BLOCK + 1, F.lit(BLOCK)), F.lit(0), add))
        sums = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))

        def row(starts: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                k = F.floor(i / BLOCK).cast("int")
                start = F.aggregate(F.slice(z["steps"], k * BLOCK + 1, i % BLOCK), F.get(starts, k), add) + F.get(z["steps"], i)["gap"]
                value = F.get(z["groups"], i) if group else m
                return _let(start, lambda at: F.struct(at.alias("start"), F.lit(rank).alias("rank"), (at + F.length(m)).alias("end"), F.lit(kind).alias("kind"), value.alias("value")))

            return F.transform(z["found"], one)

        return _let(sums, row)

    z = F.struct(found.alias("found"), groups.alias("groups"), steps.alias("steps"))
    spans = F.when(text.rlike(regex), _let(z, placed)).otherwise(none)
    return F.filter(spans, lambda s: F.length(s["value"]) >= least) if least else spans


#: Counts of the characters of a window, 5 bits each, so many to a word.
BITS, PER_WORD = 5, 12


def _suspicious(value: Column, c: CharClass) -> Column:
    """(first, last) of the suspicious windows in a candidate, as 1-based character places; 0 if there is none.

    Counts are packed into a few words, so that a step changes as few numbers however
    long the candidate or its alphabet is. A window has fewer than 2**BITS characters.
    """
    logs = F.array(*map(F.lit, c.logs))
    n_words = -(-len(c.alphabet) // PER_WORD)
    word = lambda k: F.floor(k / PER_WORD).cast("int")
    shift = lambda k: (k % PER_WORD * BITS).cast("int")

    def scan(codes: Column) -> Column:
        def step(z: Column, i: Column) -> Column:
            return _let(F.struct(F.get(codes, i).alias("new"), F.get(codes, F.when(i >= c.window, i - c.window)).alias("old")), lambda x: moved(z, i, x["new"], x["old"]))

        def moved(z: Column, i: Column, new: Column, old: Column) -> Column:
            words = F.array(*[z[f"w{k}"] for k in range(n_words)])
            count = lambda k: F.call_function("shiftright", F.get(words, word(k)), shift(k)).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")).cast("int")
            gain = _let(count(new), lambda n: F.get(logs, n + 1) - F.get(logs, n))
            loss = F.when(old.isNull(), 0).otherwise(_let(count(old), lambda n: F.get(logs, n) - F.get(logs, n - 1)))
            one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), shift(k))
            here = lambda k, j: F.when(word(k) == j, one(k)).otherwise(F.lit(0).cast("long"))
            total = F.when(new == old, z["sum"]).otherwise(z["sum"] + gain - loss)

            def out(total: Column) -> Column:
                hit = (i + 1 >= c.window) & (total <= c.most)
                return F.struct(
                    *[(z[f"w{k}"] + here(new, k) - F.coalesce(here(old, k), F.lit(0).cast("long"))).alias(f"w{k}") for k in range(n_words)],
                    total.alias("sum"),
                    F.when(hit & (z["last"] == 0), i + 2 - c.window).otherwise(z["first"]).alias("first"),
                    F.when(hit, i + 1).otherwise(z["last"]).alias("last"),
                )

            return _let(total, out)

        zero = F.struct(*[F.lit(0).cast("long").alias(f"w{k}") for k in range(n_words)], *[F.lit(0).alias(x) for x in ("sum", "first", "last")])
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, step, lambda z: F.struct(z["first"].alias("first"), z["last"].alias("last")))

    return _let(F.transform(F.split(value, ""), lambda ch: F.instr(F.lit(c.alphabet), ch) - 1), scan)


def entropy_spans(text: Column, c: CharClass, rank: int) -> Column:
    """Spans from the first to the last suspicious window of each candidate that is not on the allow list."""
    candidates = F.filter(_spans(text, c.kind, rank, c.regex), lambda s: ~allowed(s["value"]))

    def shrink(s: Column) -> Column:
        return F.get(
            F.transform(
                F.array(_suspicious(s["value"], c)),
                lambda w: F.struct(
                    (s["start"] + w["first"] - 1).alias("start"), s["rank"].alias("rank"), (s["start"] + w["last"]).alias("end"), s["kind"].alias("kind"),
                    F.when(w["last"] > 0, F.substring(s["value"], w["first"], w["last"] - w["first"] + 1)).alias("value"),
                ),
            ), 0,
        )

    return F.filter(F.transform(candidates, shrink), lambda s: s["value"].isNotNull())


def _apart(added: Column, others: Column) -> Column:
    """The spans that overlap none of the others."""
    return F.filter(added, lambda s: ~F.exists(others, lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(df: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """Adds ``out``: struct of ``base`` and ``spans``, arrays of (start, rank, end, kind, value) in order.

    Null texts count as empty and have empty arrays. Spans of the entropy method that
    overlap a span of a pattern, or of a class before, are not added again.
    """
    text = F.coalesce(df[text_col], F.lit(""))
    base = F.array_sort(F.concat(*[_spans(text, p.kind, k, p.regex, p.group, p.least) for k, p in enumerate(PATTERNS)]))
    # Columns of the input may have any names, so they go in a struct of their own.
    row = F.struct(*[df[c] for c in df.columns]).alias("row")
    found = df.select(row, base.alias("base"), *[entropy_spans(text, c, len(PATTERNS) + k).alias(f"e{k}") for k, c in enumerate(CLASSES)])
    spans = F.col("base")
    for k in range(len(CLASSES)):
        found = found.withColumn("spans", F.concat(spans, _apart(F.col(f"e{k}"), spans)))
        spans = F.col("spans")
    return found.select("row.*", F.struct("base", F.array_sort("spans").alias("spans")).alias(out))


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts by kind, digest of the base spans, and all spans as text.

    One row for each input row: a null text counts as empty and has no spans, repeated
    rows have equal ones, ids may be null, an empty table gives no rows, and other
    columns, of any names, are not read. Texts of any length are scanned whole.
    """
    found = scan(df.select(id_col, text_col), text_col, "s").select(id_col, "s.base", "s.spans")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        id_col, *[count(p.kind).alias(f"n_{p.kind}") for p in PATTERNS], F.sha2(_line(F.col("base")), 256).alias("base_sha256"), _line(F.col("spans")).alias("spans")
    )


def oracle_sql() -> str:
    """DuckDB SQL for ``report`` over documents, written from the definitions: each window is counted anew."""
    q = lambda x: "'" + x.replace("'", "''") + "'"

    def found(regex: str, rank: int, kind: str, group: int, least: int) -> str:
        groups = f"regexp_extract_all(t, {q(regex)}, {group})"
        return f"""SELECT doc_id, {rank} AS r, '{kind}' AS kind, list_sum([len(x) FOR x IN gaps[:i]]) + coalesce(list_sum([len(x) FOR x IN m[:i - 1]]), 0) AS a, len(m[i]) AS n, g[i] AS v
FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, {q(regex)}) AS m, {groups} AS g, string_split_regex(t, {q(regex)}) AS gaps FROM d WHERE regexp_matches(t, {q(regex)})))
WHERE len(g[i]) >= {least}"""

    base = " UNION ALL ".join(found(p.regex, k, p.kind, p.group, p.least) for k, p in enumerate(PATTERNS))
    no_secret = " AND ".join(f"NOT regexp_matches(v, {q(x)})" for x in ALLOWED) + f" AND NOT (regexp_matches(v, {q(IN_A_ROW)}) AND NOT regexp_matches(v, {q(MIXED)}))"
    parts, before = [], "SELECT doc_id, a, b FROM base"
    for k, c in enumerate(CLASSES):
        logs = "[" + ", ".join(map(str, c.logs)) + "]"
        parts.append(f"""c{k} AS (SELECT *, row_number() OVER () AS cid FROM ({found(c.regex, len(PATTERNS) + k, c.kind, 0, 0)}) WHERE {no_secret}),
w{k} AS (SELECT cid, unnest(range(1, len(v) - {c.window} + 2)) AS i, v FROM c{k}),
h{k} AS (SELECT cid, i, sum({logs}[n + 1]) AS s FROM (SELECT cid, i, ch, count(*) AS n FROM (SELECT cid, i, unnest(string_split(v[i:i + {c.window - 1}], '')) AS ch FROM w{k}) GROUP BY ALL) GROUP BY ALL),
e{k} AS (SELECT c.doc_id, c.r, c.kind, c.a + min(i) - 1 AS a, c.a + max(i) - 1 + {c.window} AS b FROM h{k} JOIN c{k} c USING (cid) WHERE s <= {c.most} GROUP BY c.cid, c.doc_id, c.r, c.kind, c.a),
n{k} AS (SELECT * FROM e{k} e WHERE NOT EXISTS (SELECT 1 FROM ({before}) o WHERE o.doc_id = e.doc_id AND o.a < e.b AND e.a < o.b))""")
        before += f" UNION ALL SELECT doc_id, a, b FROM n{k}"
    line = "string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, r)"
    every = "SELECT doc_id, r, kind, a, b FROM base" + "".join(f" UNION ALL SELECT doc_id, r, kind, a, b FROM n{k}" for k in range(len(CLASSES)))
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{p.kind}') AS n_{p.kind}" for p in PATTERNS)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS (SELECT doc_id, r, kind, CAST(a AS BIGINT) AS a, CAST(a + n AS BIGINT) AS b FROM ({base})),
{', '.join(parts)},
allspans AS ({every}),
x AS (SELECT doc_id, {line} AS line, {counts} FROM base GROUP BY doc_id), y AS (SELECT doc_id, {line} AS line FROM allspans GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{p.kind}, 0) AS n_{p.kind}' for p in PATTERNS)}, sha256(coalesce(x.line, '')) AS base_sha256, coalesce(y.line, '') AS spans
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)"""
