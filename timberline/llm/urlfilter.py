"""URL filters: a broadcast trie over reversed host labels and path segments.

The longest rule that fits decides, whether it allows or blocks: more host labels
first, then more of the path. Of an allow and a block entry for the same host and path,
block decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import dealt_join, ship

#: Fixed values of the query's contract: verdict, host, path.
CONTRACT_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: A trie of more nodes (about 400 bytes each) is not broadcast; its rules are joined instead, with the same results.
BROADCAST_NODES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Node:
    hosts: dict[str, Node]
    paths: dict[str, Node]
    #: Rules that end inside a segment: (rest of the path, rule, verdict), longest first.
    ends: list[tuple[str, str, str]]

    @classmethod
    def new(cls) -> Node:
        return cls({}, {}, [])


class Trie:
    """Rules by reversed host labels, then by whole path segments."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root = Node.new()
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.hosts.setdefault(label, Node.new())
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.paths.setdefault(segment, Node.new())
            node.ends.append((rest, host + path, verdict))
            node.ends.sort(key=lambda e: -len(e[0]))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        found, node = None, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.hosts.get(label)
            if node is None:
                break
            best, at = None, node
            for segment in segments:
                for rest, rule, verdict in at.ends:
                    if segment.startswith(rest):
                        best = rule, verdict
                        break
                at = at.paths.get(segment)
                if at is None:
                    break
            found = best or found
        return found


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``? #`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(df: DataFrame, rules: Iterable[tuple[str, str, str]], url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict (the rule's, else ``default``) to each row.

    ``rules`` are (allow or block, host, path); a rule fits its host and all
    subdomains where the url's path starts with the rule's. Null urls and urls without
    ``://`` have empty host and path and fit no rule. Rows that repeat stay as they are,
    and an empty table gives no rows. Columns of those names in the input are replaced,
    in whatever case Spark takes for equal.
    """
    verdicts: dict[tuple[str, str], str] = {}
    for verdict, host, path in rules:
        place = host.translate(str.maketrans(UPPER, LOWER)), path
        verdicts[place] = max(verdict, verdicts.get(place, verdict))
    rules = [(v, *place) for place, v in verdicts.items()]
    rows = df.withColumn("host", host_of(df[url_col])).withColumn("path", path_of(df[url_col]))
    if sum(h.count(".") + p.count("/") + 2 for _, h, p in rules) > BROADCAST_NODES:
        return _joined(rows, rules, default)
    ship(df.sparkSession)
    trie = df.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("struct<rule:string,verdict:string>")
    def found(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in parts:
            hits = [trie.value.find(h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(hits, columns=["rule", "verdict"])

    return rows.withColumn("rule", found("host", "path")).withColumns({"verdict": F.col("rule.verdict"), "rule": F.col("rule.rule")})


def _joined(rows: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    """The same for rule lists that are too large to broadcast.

    Each distinct url asks for the rules that are exactly a suffix of its host and the
    beginning of its path, of the lengths that rules have; so it meets one row for each
    of its rules, not all rules of its host. What many urls ask for is dealt over salts.
    """
    table = rows.sparkSession.createDataFrame([(f"{len(h)}:{h}{p}", v) for v, h, p in rules], "asked string, found string")
    lengths = F.array(*map(F.lit, sorted({len(p) for _, _, p in rules})))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.struct(s.alias("suffix"), p.alias("start")))))
    url = F.struct("host", "path").alias("url")
    asked = rows.select("host", "path").distinct().select(url, F.explode(pairs).alias("p")).withColumn("asked", F.concat(F.length("p.suffix").cast("string"), F.lit(":"), "p.suffix", "p.start"))
    best = F.max(F.struct(F.length("p.suffix"), F.length("p.start"), F.concat("p.suffix", "p.start").alias("rule"), F.col("found").alias("verdict"))).alias("hit")
    hits = dealt_join(asked, "asked", table, F.col("url")).groupBy("url").agg(best).select("url", "hit.rule", "hit.verdict")
    kept = rows.drop("rule", "verdict")
    packed = kept.select(F.struct(*[kept[c] for c in kept.columns]).alias("row"), url)
    return dealt_join(packed, "url", hits, F.to_json("row"), "left").select("row.*", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def oracle_sql() -> str:
    fits = lambda host, path: f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
    ordered = sorted(CONTRACT_RULES, key=lambda r: (-r[1].count("."), -len(r[2])))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in ordered)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered)
    return f"""WITH u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS pos FROM pages),
r AS (SELECT page_id, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM r),
p AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, len(raw) + 1), '^[^?#]*') AS path FROM h)
SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM p"""
