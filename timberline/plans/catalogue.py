"""The queries over the driver's tables, each with the same question as DuckDB SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mask import mask, matches, pieces, slot_uses, spans
from ..functions.text import content, excerpt, humanize, tokens
from ..operators import alarms as A
from ..operators import board, metrics, neighbours, synth
from ..operators import verdicts as V
from ..operators import windows as W
from ..operators.drain import Config, assign, similarity, versions
from ..runtime import spread, written
from ..sources import files, journal, otlp, syslog
from . import lines as L
from .lines import ALL_SQL, EVENTS_SQL, HISTORY_SQL, ORDER_VERDICTS_SQL, STATS_SQL, VERDICTS_SQL, quoted, sql_mask, table, with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: L.plain(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Masking


@query(f"SELECT doc_id, CAST(line_no AS INT) AS line_no, {sql_mask('raw')} AS template FROM (SELECT doc_id, unnest(range(0, len(p))) AS line_no, unnest(p) AS raw FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)) WHERE raw <> ''")
def mask_lines_documents(spark, sf):
    return L.document_lines(spark, sf).select("doc_id", "line_no", mask(F.col("raw"), unicode=False).alias("template"))


ORDERS_SQL = "ol AS (SELECT o_orderkey AS event_id, o_orderdate AS received_at, o_orderstatus, o_orderpriority, 'order ' || o_orderkey || ' for customer ' || o_custkey || ' placed at ' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' status ' || o_orderstatus || ' priority ' || o_orderpriority AS raw FROM orders)"


@query(with_(ORDERS_SQL) + f"SELECT event_id, {sql_mask('raw')} AS template FROM ol")
def mask_lines_orders(spark, sf):
    return L.order_lines(spark, sf).select("event_id", mask(F.col("raw")).alias("template"))


@query(f"SELECT page_id, {sql_mask('url')} AS template FROM pages")
def mask_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", mask(F.col("url"), unicode=False).alias("template"))


@query(with_(EVENTS_SQL) + f"SELECT count(*) AS lines, count(*) FILTER (WHERE {sql_mask('template')} <> template) AS moved FROM lines")
def mask_idempotent(spark, sf):
    m = L.event_lines(spark, sf).select("template", mask(F.col("template")).alias("again"))
    return m.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("again") != F.col("template")).alias("moved"))


@query(with_(EVENTS_SQL) + f"SELECT event_id, array_to_string(list_transform(regexp_extract_all(raw, {quoted(L.DEFAULT.alternation)}), lambda m: CASE {' '.join(f'WHEN regexp_full_match(m, {quoted(s.pattern)}) THEN ' + quoted(s.name + '=') + ' || m' for s in L.DEFAULT.slots)} END), ';') AS found FROM lines")
def slot_matches(spark, sf):
    found = F.transform(matches(F.col("raw")), lambda m: F.concat_ws("=", m["name"], m["value"]))
    return L.event_lines(spark, sf).select("event_id", F.array_join(found, ";").alias("found"))


@query(
    with_(EVENTS_SQL, f"m AS (SELECT event_id, regexp_extract_all(raw, {quoted(L.DEFAULT.alternation)}) AS m, string_split_regex(raw, {quoted(L.DEFAULT.alternation)}) AS p FROM lines)",
          "s AS (SELECT event_id, unnest(m) AS x, unnest(list_transform(range(1, len(m) + 1), lambda i: CAST(list_sum(list_transform(p[1:i], lambda t: strlen(t))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda t: strlen(t))), 0) AS BIGINT))) AS a FROM m)")
    + f"SELECT event_id, string_agg(CASE {' '.join(f'WHEN regexp_full_match(x, {quoted(s.pattern)}) THEN ' + quoted(s.name) for s in L.DEFAULT.slots)} END || ':' || a || ':' || (a + strlen(x)), ';' ORDER BY a) AS found FROM s GROUP BY event_id"
)
def slot_spans(spark, sf):
    found = F.transform(spans(F.col("raw")), lambda m: F.concat_ws(":", m["name"], m["start"].cast("string"), m["end"].cast("string")))
    return L.event_lines(spark, sf).select("event_id", F.array_join(found, ";").alias("found"))


@query(with_(EVENTS_SQL) + "SELECT slot, count(*) AS seen FROM (SELECT unnest(regexp_extract_all(template, '<VAR:([A-Z][A-Z0-9_]*)>', 1)) AS slot FROM lines) GROUP BY slot")
def slot_counts(spark, sf):
    uses = L.event_lines(spark, sf).groupBy("template").count().select("count", F.explode(slot_uses(F.col("template"))).alias("u"))
    return uses.groupBy(F.col("u.name").alias("slot")).agg(F.sum(F.col("u.uses") * F.col("count")).alias("seen"))


@query(with_(EVENTS_SQL) + "SELECT template, string_agg(slot || ':' || n, ',' ORDER BY at0) AS slots FROM (SELECT template, slot, count(*) AS n, min(i) AS at0 FROM (SELECT template, unnest(regexp_extract_all(template, '<VAR:([A-Z][A-Z0-9_]*)>', 1)) AS slot, unnest(range(0, len(regexp_extract_all(template, '<VAR:([A-Z][A-Z0-9_]*)>', 1)))) AS i FROM (SELECT DISTINCT template FROM lines)) GROUP BY template, slot) GROUP BY template")
def template_slots(spark, sf):
    t = L.event_lines(spark, sf).select("template").distinct()
    return t.select("template", F.array_join(F.transform(slot_uses(F.col("template")), lambda u: F.concat_ws(":", u["name"], u["uses"])), ",").alias("slots"))


@query(with_(EVENTS_SQL) + "SELECT template, array_to_string(list_transform(regexp_extract_all(template, '<VAR:[A-Z][A-Z0-9_]*>|[^<]+'), lambda p: CASE WHEN p LIKE '<VAR:%' THEN '{' || p[6:-2] || '}' ELSE p END), '|') AS parts FROM (SELECT DISTINCT template FROM lines)")
def template_pieces(spark, sf):
    t = L.event_lines(spark, sf).select("template").distinct()
    return t.select("template", F.array_join(F.transform(pieces(F.col("template")), lambda p: F.coalesce(p["text"], F.concat(F.lit("{"), p["slot"], F.lit("}")))), "|").alias("parts"))


@query(with_(EVENTS_SQL) + "SELECT template_id, template, count(*) AS lines, arg_min(raw, event_id) AS example FROM lines GROUP BY template_id, template")
def top_templates(spark, sf):
    return L.event_lines(spark, sf).groupBy("template_id", "template").agg(F.count(F.lit(1)).alias("lines"), F.min_by("raw", "event_id").alias("example"))


@query("SELECT doc_id, CAST(least(len(w), 128) AS BIGINT) AS n, array_to_string(w[:128], ' ') AS head FROM (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\s\\x0b]+'), lambda x: x <> '') AS w FROM documents)")
def tokenize_truncate(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("head"))


@query("SELECT doc_id, trim(CASE WHEN strpos(t, ': ') > 0 THEN substr(t, strpos(t, ': ') + 2) ELSE t END) AS body, replace(upper(s[1]) || s[2:], '_', ' ') AS label FROM (SELECT doc_id, coalesce(text, '') AS t, lang || '_' || source AS s FROM documents)")
def content_and_label(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", content(F.coalesce("text", F.lit(""))).alias("body"), humanize(F.concat_ws("_", "lang", "source")).alias("label"))


# Only the first 160 characters can start before byte 160.
EXCERPT_SQL = ("SELECT doc_id, CASE WHEN strlen(t) <= 160 THEN t ELSE array_to_string(list_transform(list_filter(list_zip(string_split(h, ''), list_transform(range(1, len(h) + 1), lambda i: strlen(substr(h, 1, i - 1)))), lambda z: z[2] < 160), lambda z: z[1]), '') END AS excerpt FROM (SELECT doc_id, t, substr(t, 1, 160) AS h FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))")


@query(EXCERPT_SQL)
def template_excerpt(spark, sf):
    """Whole documents stand for templates."""
    return document_excerpts(spark, sf)


@query(EXCERPT_SQL)
def document_excerpts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", excerpt(F.coalesce("text", F.lit(""))).alias("excerpt"))


# Clustering


@query()
def drain_clusters(spark, sf):
    d = L.document_lines(spark, sf).select((F.col("doc_id") * 1_000_000 + F.col("line_no")).alias("event_id"), mask(F.col("raw")).alias("template")).withColumn("received_at", F.col("event_id"))
    return assign(d)[1]


@query(with_(EVENTS_SQL) + "SELECT l.event_id, l.template_id AS template_id_final FROM lines l")
def drain_assignments(spark, sf):
    # Masked event lines differ in whole words alone, so each template is its own cluster.
    return assign(L.event_lines(spark, sf))[0].select("event_id", "template_id_final")


# Three families of order lines, on which SQL can tell what mining gives: lines alike but for their priority are one
# cluster and such of another status another; first tokens with digits are one cluster; of first tokens in letters, 99 in
# order of appearance have room at their node and the others are one cluster.
@query(
    """WITH o AS (SELECT o_orderkey AS k, epoch_us(o_orderdate) AS us, 'is' || lower(o_orderstatus) AS s, replace(substr(o_orderpriority, 3), ' ', '-') AS p, o_custkey % 150 AS c, o_custkey % 40 AS d FROM orders),
a AS (SELECT 'batch of work for clients in zone ' || s || ' and desk ' || s || ' ended ' || CASE WHEN count(DISTINCT p) > 1 THEN '<*>' ELSE min(p) END AS template, count(*) AS size, 13 AS n_tokens, arg_min(k * 3, (us, k)) AS first_event FROM o GROUP BY s),
b AS (SELECT CASE WHEN count(DISTINCT d) > 1 THEN '<*>' ELSE min('u' || d) END || ' units were moved to the north hall at noon today' AS template, count(*) AS size, 11 AS n_tokens, arg_min(k * 3 + 1, (us, k)) AS first_event FROM o HAVING count(*) > 0),
f AS (SELECT c, 'q' || chr(CAST(97 + c // 26 AS INT)) || chr(CAST(97 + c % 26 AS INT)) AS w, row_number() OVER (ORDER BY min((us, k))) AS place FROM o GROUP BY c),
g AS (SELECT CASE WHEN place <= 99 THEN place ELSE 100 END AS g, w, k, us FROM o JOIN f USING (c)),
x AS (SELECT CASE WHEN count(DISTINCT w) > 1 THEN '<*>' ELSE min(w) END || ' sent its goods to bay seven at dusk safely' AS template, count(*) AS size, 10 AS n_tokens, arg_min(k * 3 + 2, (us, k)) AS first_event FROM g GROUP BY g)
SELECT template, size, CAST(n_tokens AS INT) AS n_tokens, first_event FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM x)"""
)
def drain_families(spark, sf):
    o = spread(table(spark, sf, "orders"))
    status, letter = F.concat(F.lit("is"), F.lower("o_orderstatus")), lambda n: F.char((F.lit(97) + n).cast("int"))
    custkey = F.col("o_custkey") % 150
    lines = (
        F.concat(F.lit("batch of work for clients in zone "), status, F.lit(" and desk "), status, F.lit(" ended "), F.expr("replace(substring(o_orderpriority, 3), ' ', '-')")),
        F.concat(F.lit("u"), (F.col("o_custkey") % 40).cast("string"), F.lit(" units were moved to the north hall at noon today")),
        F.concat(F.lit("q"), letter(F.floor(custkey / 26)), letter(custkey % 26), F.lit(" sent its goods to bay seven at dusk safely")),
    )
    family = F.posexplode(F.array(*lines)).alias("family", "template")
    rows = o.select("o_orderkey", F.col("o_orderdate").alias("received_at"), family).withColumn("event_id", F.col("o_orderkey") * 3 + F.col("family"))
    return assign(rows)[1].select("template", "size", "n_tokens", "first_event")


# One token count with 150 first tokens: the 99 that come first have a child each, below which each second token is a
# cluster; the others share the parameter's child, where a second token's lines are one cluster that generalises.
DEALT_SQL = """o AS (SELECT o_orderkey AS event_id, o_orderdate AS placed, 'q' || chr(CAST(97 + o_custkey % 150 // 26 AS INT)) || chr(CAST(97 + o_custkey % 150 % 26 AS INT)) AS w, replace(substr(o_orderpriority, 3), ' ', '-') AS v FROM orders),
f AS (SELECT w, row_number() OVER (ORDER BY min((placed, event_id))) AS place FROM o GROUP BY w),
x AS (SELECT o.*, CASE WHEN place <= 99 THEN w ELSE '' END AS g FROM o JOIN f USING (w)),
y AS (SELECT *, row_number() OVER t AS size, first_value(w) OVER t AS fw FROM x WINDOW t AS (PARTITION BY g, v ORDER BY placed, event_id)),
z AS (SELECT *, bool_or(w <> fw) OVER (PARTITION BY g, v ORDER BY placed, event_id ROWS UNBOUNDED PRECEDING) AS moved, bool_or(w <> fw) OVER (PARTITION BY g, v) AS moves FROM y)"""
DEALT_TAIL = " goods went from the yard to bay seven at dusk"


def _dealt(orders):
    letter = lambda n: F.char((F.lit(97) + n).cast("int"))
    c = F.col("o_custkey") % 150
    line = F.concat(F.lit("q"), letter(F.floor(c / 26)), letter(c % 26), F.lit(" "), F.expr("replace(substring(o_orderpriority, 3), ' ', '-')"), F.lit(DEALT_TAIL))
    return orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("received_at"), line.alias("template"))


def _dealt_lines(spark, sf):
    return _dealt(spread(table(spark, sf, "orders")))


@query(with_(DEALT_SQL) + f"SELECT event_id, size, 't_' || sha256(CASE WHEN moved THEN '<*>' ELSE w END || ' ' || v || '{DEALT_TAIL}') AS template_id_at_train, 't_' || sha256(CASE WHEN moves THEN '<*>' ELSE w END || ' ' || v || '{DEALT_TAIL}') AS template_id_final FROM z")
def drain_dealt(spark, sf):
    return assign(_dealt_lines(spark, sf), share=1_000)[0].select("event_id", "size", "template_id_at_train", "template_id_final")


# Texts of two token counts that are a cluster each, in a table of 200: a text that comes again is forgotten by then if
# 200 others have come since.
@query(
    """WITH o AS (SELECT o_orderkey AS event_id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS t, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 600 ELSE o_custkey % 20 END AS c, substr(o_orderpriority, 3) AS v FROM orders),
x AS (SELECT event_id, t, 'q' || chr(CAST(97 + c // 26 AS INT)) || chr(CAST(97 + c % 26 AS INT)) || ' ' || v || ' goods went to bay seven' AS text FROM o),
p AS (SELECT *, lag(t) OVER (PARTITION BY text ORDER BY t) AS before, lead(t) OVER (PARTITION BY text ORDER BY t) AS after FROM x),
e AS (SELECT a.t, count(*) AS others FROM p a JOIN p b ON b.t > a.before AND b.t < a.t WHERE a.t - a.before > 200 AND (b.after IS NULL OR b.after > a.t) GROUP BY a.t),
q AS (SELECT event_id, t, text, sum(CASE WHEN before IS NULL OR others >= 200 THEN 1 ELSE 0 END) OVER (PARTITION BY text ORDER BY t) AS life FROM p LEFT JOIN e USING (t))
SELECT event_id, row_number() OVER (PARTITION BY text, life ORDER BY t) AS size, 't_' || sha256(text) AS template_id_at_train FROM q"""
)
def drain_bounded(spark, sf):
    letter = lambda n: F.char((F.lit(97) + n).cast("int"))
    c = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") % 600).otherwise(F.col("o_custkey") % 20)
    line = F.concat(F.lit("q"), letter(F.floor(c / 26)), letter(c % 26), F.lit(" "), F.expr("substring(o_orderpriority, 3)"), F.lit(" goods went to bay seven"))
    rows = spread(table(spark, sf, "orders")).select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("received_at"), line.alias("template"))
    return assign(rows, Config(similarity=1.0, max_clusters=200, max_leaf=0, max_children=2_000), alone=0)[0].select("event_id", "size", "template_id_at_train")


# Every new cluster is like all that are there; how like goes by whether the other has generalised by then.
@query(
    with_(DEALT_SQL, "c AS (SELECT g, v, any_value(fw) AS w, arg_min(event_id, (placed, event_id)) AS event_id, min((placed, event_id)) AS born, min((placed, event_id)) FILTER (moved) AS moved_at FROM z GROUP BY g, v)",
          "p AS (SELECT a.event_id, a.w || ' ' || a.v AS own, b.event_id AS other_event, CASE WHEN b.moved_at < a.born THEN '<*>' ELSE b.w END AS bw, b.v AS bv, a.w, a.v FROM c a JOIN c b ON b.born < a.born)",
          "s AS (SELECT *, 10 + CAST(bw = w AS INT) + CAST(bv = v AS INT) AS shared FROM p)")
    + f"SELECT event_id, 't_' || sha256(own || '{DEALT_TAIL}') AS template_id, other_event, 't_' || sha256(bw || ' ' || bv || '{DEALT_TAIL}') AS other_id, shared / CAST(24 - shared AS DOUBLE) AS score FROM s"
)
def referrals_at_creation(spark, sf):
    return neighbours.referrals(versions(_dealt_lines(spark, sf), share=1_000)).select("event_id", "template_id", "other_event", "other_id", "score")


@query(with_(EVENTS_SQL, "t AS (SELECT DISTINCT template, string_split(template, ' ') AS w FROM lines)") + "SELECT a.template AS a, b.template AS b, list_sum([CASE WHEN a.w[i] = b.w[i] THEN 1 ELSE 0 END FOR i IN range(1, len(a.w) + 1)]) / CAST(len(a.w) AS DOUBLE) AS similarity FROM t a JOIN t b ON a.template < b.template AND len(a.w) = len(b.w)")
def pairwise_similarity(spark, sf):
    t = L.event_lines(spark, sf).select("template").distinct().withColumn("w", F.split("template", " "))
    a, b = t.alias("a"), t.alias("b")
    pairs = a.join(b, (F.size("a.w") == F.size("b.w")) & (F.col("a.template") < F.col("b.template")))
    return pairs.select(F.col("a.template").alias("a"), F.col("b.template").alias("b"), similarity(F.col("a.w"), F.col("b.w")).alias("similarity"))


@query("WITH c AS (SELECT p_partkey AS seq, string_split(p_name || ' ' || p_brand || ' ' || p_type || ' part', ' ') AS w FROM part), x AS (SELECT seq, len(w) AS n, tok, count(*) AS c FROM (SELECT seq, w, unnest(w) AS tok FROM c) GROUP BY ALL), p AS (SELECT a.seq AS seq_a, b.seq AS seq_b, a.n AS n1, b.n AS n2, sum(least(a.c, b.c)) AS s FROM x a JOIN x b ON a.tok = b.tok AND abs(a.n - b.n) <= 2 AND a.seq < b.seq GROUP BY ALL) SELECT seq_a, seq_b, s / CAST(n1 + n2 - s AS DOUBLE) AS score FROM p WHERE s / CAST(n1 + n2 - s AS DOUBLE) >= 0.65")
def neighbours_jaccard(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("seq"), F.split(F.concat_ws(" ", "p_name", "p_brand", "p_type", F.lit("part")), " ").alias("tokens"))
    return neighbours.neighbours(p)


# Merges: suppliers stand for templates; each has a decision with the one three before it.
def _merges(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    name = lambda c: F.concat(F.lit("t_"), F.lpad(c.cast("string"), 8, "0"))
    pair = s.filter("k > 3").select(name(F.col("k")).alias("id_hi"), name(F.col("k") - 3).alias("id_lo"), (F.col("k") % 10 / 10).alias("noul"), "k")
    return pair.select(
        "id_lo", "id_hi", F.concat(F.lit("lo "), "id_lo").alias("template_lo"), F.concat(F.lit("hi "), "id_hi").alias("template_hi"), F.lit("q1").alias("questions_hash"),
        F.lit("b1").alias("bundle_hash"), F.lit("table").alias("model"), "noul", neighbours.decide(F.col("noul")).alias("merged"), F.timestamp_seconds(F.col("k")).alias("judged_at"),
    )


MERGES_SQL = "mg AS (SELECT 't_' || lpad(CAST(s_suppkey - 3 AS VARCHAR), 8, '0') AS id_lo, 't_' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS id_hi, (s_suppkey % 10) / CAST(10 AS DOUBLE) AS noul, (s_suppkey % 10) / CAST(10 AS DOUBLE) >= 0.5 AS merged FROM supplier WHERE s_suppkey > 3)"


@query(with_(MERGES_SQL) + "SELECT DISTINCT least(id_hi, id_lo) AS id_lo, greatest(id_hi, id_lo) AS id_hi FROM mg")
def merge_canonical_pairs(spark, sf):
    m = _merges(spark, sf)
    both = m.select(F.col("id_hi").alias("id_a"), F.col("id_lo").alias("id_b")).unionByName(m.select(F.col("id_lo").alias("id_a"), F.col("id_hi").alias("id_b")))
    return neighbours.canonical_pairs(both)


@query(with_(MERGES_SQL, "al AS (SELECT id_hi AS id, id_lo AS cur, 1 AS hop FROM mg WHERE merged UNION ALL SELECT al.id, mg.id_lo, hop + 1 FROM al JOIN mg ON mg.id_hi = al.cur AND mg.merged WHERE hop < 16)") + "SELECT id, arg_max(cur, hop) AS survivor, 'lo ' || arg_max(cur, hop) AS template FROM al GROUP BY id")
def alias_resolve(spark, sf):
    return neighbours.resolve(neighbours.alias_edges(_merges(spark, sf), "q1", "b1"))


@query(with_(MERGES_SQL) + "SELECT id_lo, id_hi, merged FROM mg WHERE NOT ends_with(id_hi, '7')")
def unmerge(spark, sf):
    m = _merges(spark, sf)
    gone = m.filter(F.endswith("id_hi", F.lit("7"))).select(F.col("id_hi").alias("id_a"), F.col("id_lo").alias("id_b"))
    return neighbours.unmerge(m, gone).select("id_lo", "id_hi", "merged")


@query(with_(MERGES_SQL) + "SELECT 't_' || lpad(CAST(s_suppkey - 1 AS VARCHAR), 8, '0') AS id_lo, 't_' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS id_hi FROM supplier WHERE s_suppkey > 1")
def undecided_pairs(spark, sf):
    name = lambda c: F.concat(F.lit("t_"), F.lpad(c.cast("string"), 8, "0"))
    s = table(spark, sf, "supplier").filter("s_suppkey > 1")
    asked = s.select(name(F.col("s_suppkey")).alias("id_hi"), name(F.col("s_suppkey") - 1).alias("id_lo"))
    known = _merges(spark, sf)
    return neighbours.undecided(asked.unionByName(known.select("id_hi", "id_lo")), known).select("id_lo", "id_hi")


@query(with_(EVENTS_SQL, VERDICTS_SQL) + "SELECT DISTINCT template_id, template FROM lines WHERE template_id NOT IN (SELECT template_id FROM v)")
def unjudged_templates(spark, sf):
    return V.unjudged(L.event_lines(spark, sf).select("template_id", "template"), L.verdicts(spark))


# Verdicts


@query(with_(ORDER_VERDICTS_SQL) + "SELECT template_id, questions_hash, arg_max(severity, judged_at) AS severity, max(judged_at) AS judged_at FROM ov GROUP BY template_id, questions_hash")
def verdict_latest(spark, sf):
    return V.latest(L.order_verdicts(spark, sf)).select("template_id", "questions_hash", "severity", "judged_at")


@query(with_(EVENTS_SQL, VERDICTS_SQL, HISTORY_SQL) + "SELECT l.event_id, (SELECT arg_max(severity, judged_at) FROM vh WHERE vh.template_id = l.template_id AND vh.judged_at <= l.received_at) AS severity FROM lines l")
def verdict_asof(spark, sf):
    return V.as_of(L.event_lines(spark, sf), L.verdict_rows(spark)).select("event_id", "severity")


@query(with_(ORDER_VERDICTS_SQL) + "SELECT template_id, judged_at, severity, row_number() OVER (PARTITION BY template_id ORDER BY judged_at) AS place FROM ov")
def verdict_history(spark, sf):
    return V.history(L.order_verdicts(spark, sf)).select("template_id", "judged_at", "severity", "place")


@query(with_(ORDER_VERDICTS_SQL) + "SELECT template_id, severity, judged_at FROM ov WHERE questions_hash = 'q1' AND bundle_hash = 'b1' AND model = '1-URGENT'")
def verdict_by_key(spark, sf):
    return V.by_key(L.order_verdicts(spark, sf), questions_hash="q1", bundle_hash="b1", model="1-URGENT").select("template_id", "severity", "judged_at")


@query(with_(EVENTS_SQL, VERDICTS_SQL) + f"SELECT l.event_id, coalesce({L.SEVERITY_SQL} >= 2 AND actionable >= 0.5, false) AS open FROM lines l LEFT JOIN v USING (template_id)")
def gate(spark, sf):
    j = L.event_lines(spark, sf).join(F.broadcast(L.verdicts(spark)), "template_id", "left")
    return j.select("event_id", V.gate(F.col("severity"), F.col("actionable")).alias("open"))


@query("SELECT o_orderkey, CASE WHEN round(s) >= 3 THEN 'critical' WHEN round(s) = 2 THEN 'major' WHEN round(s) = 1 THEN 'minor' ELSE 'info' END AS severity FROM (SELECT o_orderkey, (o_orderkey % 41) / CAST(10 AS DOUBLE) - 0.3 AS s FROM orders)")
def severity_from_score(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", V.severity_of((F.col("o_orderkey") % 41) / F.lit(10.0) - 0.3).alias("severity"))


@query("SELECT o_orderkey, CASE WHEN w IS NULL THEN 'Dashboard' WHEN w >= 0.9 THEN 'Page' WHEN w >= 0.6 THEN 'Dashboard' ELSE 'Record' END AS lane FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey % 101) / CAST(100 AS DOUBLE) END AS w FROM orders)")
def lane_routing(spark, sf):
    w = F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 101) / F.lit(100.0))
    return table(spark, sf, "orders").select("o_orderkey", V.lane(w).alias("lane"))


@query(with_(EVENTS_SQL, VERDICTS_SQL) + "SELECT l.event_id, coalesce(contextual >= 0.5, false) AS contextual FROM lines l LEFT JOIN v USING (template_id)")
def contextual_flag(spark, sf):
    j = L.event_lines(spark, sf).join(F.broadcast(L.verdicts(spark)), "template_id", "left")
    return j.select("event_id", V.contextual(F.col("contextual")).alias("contextual"))


# Windows


def _stat(name: str):
    def run(spark, sf):
        return W.window_stats(L.stored_lines(spark, sf)).select("event_id", name)

    run.__name__ = {"short_total": "window_short", "long_total": "window_long", "distinct_hosts": "window_hosts", "span_secs": "window_span"}[name]
    return query(with_(EVENTS_SQL, STATS_SQL) + f"SELECT event_id, {name} FROM st")(run)


for _name in ("short_total", "long_total", "distinct_hosts", "span_secs"):
    _stat(_name)


@query(with_(EVENTS_SQL, STATS_SQL) + f"SELECT event_id, {L.TRIGGER_SQL} AS triggered FROM st")
def window_trigger(spark, sf):
    return W.window_stats(L.stored_lines(spark, sf)).select("event_id", W.triggered().alias("triggered"))


@query("WITH l AS (SELECT event_id, user_id, CAST(floor((epoch_us(ts) - min(epoch_us(ts)) OVER ()) / CAST(1000000 AS DOUBLE)) AS BIGINT) AS sec FROM events), m AS (SELECT *, sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS gap FROM l) SELECT event_id, CAST(sum(CASE WHEN gap > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS BIGINT) AS session FROM m")
def window_idle_reset(spark, sf):
    lines = W.seconds(table(spark, sf, "events").withColumn("template_id", F.col("user_id").cast("string")), "ts")
    return W.idle_reset(lines).select("event_id", "session")


# Lines of users without a window, in order: whether a sweep has forgotten one since its last line, and when the last sweep was.
@query(
    """WITH RECURSIVE l AS (SELECT event_id, user_id, CAST(floor((epoch_us(ts) - min(epoch_us(ts)) OVER ()) / CAST(1000000 AS DOUBLE)) AS BIGINT) AS sec FROM events),
m AS (SELECT *, lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS before FROM l),
c AS (SELECT event_id, sec, before, row_number() OVER (ORDER BY sec, event_id) AS i FROM m WHERE before IS NULL OR sec - before > 3600),
r AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS swept, false AS fresh, CAST(NULL AS BIGINT) AS event_id UNION ALL
    SELECT c.i, CASE WHEN (c.before IS NULL OR r.swept - c.before > 3600) AND c.sec - r.swept >= 60 THEN c.sec ELSE r.swept END, coalesce(r.swept - c.before > 3600, false), c.event_id FROM r JOIN c ON c.i = r.i + 1)
SELECT m.event_id, CAST(sum(CASE WHEN r.fresh THEN 1 ELSE 0 END) OVER (PARTITION BY m.user_id ORDER BY m.sec, m.event_id) AS BIGINT) AS session FROM m LEFT JOIN r ON r.event_id = m.event_id"""
)
def window_evict(spark, sf):
    lines = W.seconds(table(spark, sf, "events").withColumn("template_id", F.col("user_id").cast("string")), "ts")
    return W.evicted(lines).select("event_id", "session")


@query("WITH l AS (SELECT user_id, max(CAST(floor((epoch_us(ts) - m) / CAST(1000000 AS DOUBLE)) AS BIGINT)) AS last_seen FROM (SELECT *, min(epoch_us(ts)) OVER () AS m FROM events) GROUP BY user_id) SELECT CAST(user_id AS VARCHAR) AS template_id, last_seen FROM (SELECT *, row_number() OVER (ORDER BY last_seen DESC, CAST(user_id AS VARCHAR) DESC) AS r FROM l) WHERE r > 20")
def stalest_templates(spark, sf):
    lines = W.seconds(table(spark, sf, "events").withColumn("template_id", F.col("user_id").cast("string")), "ts")
    return W.stalest_first(lines, 20).select("template_id", "last_seen")


# Alarms


def _gated(spark, sf, lines=None):
    """Written, as alarms read them twice."""
    return written(A.gated(L.judged_lines(spark, sf, lines)), "gated")


def _alarms(spark, sf, lines=None):
    lines = L.stored_lines(spark, sf) if lines is None else lines
    now = lines.agg(F.max("sec").alias("_now"))
    return A.alarms(_gated(spark, sf, lines)).crossJoin(F.broadcast(now)).withColumn("open", F.col("clears_sec") >= F.col("_now")).drop("_now")


@query(ALL_SQL + "SELECT template_id, host, CAST(alarm_no AS BIGINT) AS alarm_no, episode, count(*) AS lines FROM rw GROUP BY ALL")
def alarm_episodes(spark, sf):
    return A.episodes(_gated(spark, sf)).groupBy("template_id", "host", "alarm_no", "episode").agg(F.count(F.lit(1)).alias("lines"))


@query(ALL_SQL + "SELECT * FROM alarms")
def alarms(spark, sf):
    return _alarms(spark, sf)


@query(ALL_SQL + "SELECT alarm_id, template, host, severity, lane, count, opened_sec, last_sec FROM alarms WHERE open")
def open_alarms(spark, sf):
    return A.open_alarms(_alarms(spark, sf)).select("alarm_id", "template", "host", "severity", "lane", "count", "opened_sec", "last_sec")


@query(
    ALL_SQL.rstrip()
    + ",\nid AS (SELECT rw.*, al.first_event FROM rw JOIN al USING (template_id, host, alarm_no)),\nch AS (SELECT *, row_number() OVER (PARTITION BY first_event, template_id, host ORDER BY sec, event_id) AS n, max(rank_) OVER (PARTITION BY first_event, template_id, host ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) AS worst, row_number() OVER (PARTITION BY template_id, host, episode ORDER BY sec, event_id) AS k FROM id)\nSELECT sha256(template_id || '|' || host || '|' || first_event) AS alarm_id, sec AS at_sec, event_id, CASE WHEN k = 1 THEN 'Raised' ELSE 'Updated' END AS op, n AS count, ['cleared', 'info', 'minor', 'major', 'critical'][worst + 1] AS severity FROM ch UNION ALL SELECT sha256(template_id || '|' || host || '|' || arg_max(first_event, (sec, event_id))), max(sec) + 900, NULL, 'Cleared', max(n), ['cleared', 'info', 'minor', 'major', 'critical'][max(worst) + 1] FROM ch GROUP BY template_id, host, episode"
)
def alarm_changelog(spark, sf):
    return A.changelog(_gated(spark, sf))


@query(with_(EVENTS_SQL, VERDICTS_SQL) + f"SELECT l.template_id, l.host, 'critical' AS severity, 'Dashboard' AS lane, '' AS exemplar, CAST(1 AS BIGINT) AS count, TIMESTAMP '{L.JUDGED_AT}' AS opened_at FROM lines l JOIN v USING (template_id) WHERE l.received_at < TIMESTAMP '{L.JUDGED_AT}' AND round(v.severity) >= 3 GROUP BY l.template_id, l.host")
def alarms_first_judgment(spark, sf):
    return A.first_judgments(L.event_lines(spark, sf).select("template_id", "host", "received_at"), L.verdict_rows(spark))


# Verdicts land together, after some lines of each template: rows without an event raise for the hosts that were waiting.
LANDED_SQL = f"(SELECT CAST(floor((epoch_us(TIMESTAMP '{L.JUDGED_AT}') - min(epoch_us(ts))) / CAST({L.SQUEEZE}000000 AS DOUBLE)) AS BIGINT) FROM events)"
ARRIVING_SQL = (
    L.ALARMS_SQL.replace("g AS (", "g0 AS (", 1)
    .replace(
        ",\ni0 AS",
        f""",
g AS (SELECT * FROM g0 WHERE sec >= {LANDED_SQL} UNION ALL BY NAME SELECT DISTINCT template_id, host, template, '' AS raw, {LANDED_SQL} AS sec, severity, actionable, contextual, rank_, true AS trig
    FROM (SELECT st.*, v.severity, v.actionable, v.contextual, {L.SEVERITY_SQL} AS rank_ FROM st JOIN v USING (template_id)) WHERE rank_ >= 4 AND actionable >= 0.5 AND sec < {LANDED_SQL}),
i0 AS""",
        1,
    )
    .replace("ORDER BY sec, event_id", "ORDER BY sec, event_id NULLS FIRST")
    .replace("(sec, event_id)", "(sec, coalesce(event_id, -1))")
    .replace("arg_min(event_id,", "arg_min_null(event_id,")
    .replace("sha256(template_id || '|' || host || '|' || first_event)", "sha256(concat_ws('|', template_id, host, first_event))")
)


@query(with_(EVENTS_SQL, STATS_SQL, VERDICTS_SQL, ARRIVING_SQL) + "SELECT alarm_id, template, host, exemplar, severity, count, episodes, opened_sec, last_sec, open FROM alarms")
def alarms_as_verdicts_arrive(spark, sf):
    lines = L.stored_lines(spark, sf)
    landed = F.unix_micros(F.lit(L.JUDGED_AT).cast("timestamp"))
    began = table(spark, sf, "events").agg(F.min(F.unix_micros("ts")).alias("_began"))
    verdicts = L.verdicts(spark).crossJoin(F.broadcast(began)).withColumn("landed_sec", F.floor((landed - F.col("_began")) / (1_000_000 * L.SQUEEZE)).cast("long")).drop("_began")
    found = A.alarms(written(A.as_verdicts_arrive(W.window_stats(lines), verdicts), "arriving"))
    now = lines.agg(F.max("sec").alias("_now"))
    rows = found.crossJoin(F.broadcast(now)).withColumn("open", F.col("clears_sec") >= F.col("_now"))
    return rows.select("alarm_id", "template", "host", "exemplar", "severity", "count", "episodes", "opened_sec", "last_sec", "open")


def _answers(events):
    """Two checks of three are answered, after five seconds."""
    return events.filter(F.col("event_id") % 3 != 0).select(
        "event_id", F.lit(5).cast("long").alias("delay_sec"), (F.col("event_id") % 10 / 10).alias("matters_now"), (F.col("event_id") % 7 / 6).alias("wake_someone")
    )


@query()
def alarms_contextual(spark, sf):
    return A.contextual_changelog(_gated(spark, sf), _answers(table(spark, sf, "events")))


@query(ALL_SQL + ", b AS (SELECT event_id, host, sec FROM lines), r AS (SELECT b.event_id, a.opened_sec, a.alarm_id, row_number() OVER (PARTITION BY b.event_id ORDER BY a.opened_sec, a.alarm_id) AS k FROM b JOIN alarms a ON a.host = b.host AND a.opened_sec < b.sec AND b.sec <= a.clears_sec)\nSELECT b.event_id, coalesce(string_agg(r.alarm_id, ',' ORDER BY r.opened_sec, r.alarm_id), '') AS seen FROM b LEFT JOIN r ON r.event_id = b.event_id AND r.k <= 8 GROUP BY b.event_id")
def context_snapshot(spark, sf):
    lines = L.stored_lines(spark, sf)
    s = A.context_snapshot(lines.select("event_id", "host", "sec"), written(_alarms(spark, sf, lines), "alarms"))
    return s.select("event_id", F.coalesce(F.array_join(F.transform("open_alarms", lambda a: a["alarm_id"]), ","), F.lit("")).alias("seen"))


@query(ALL_SQL.rstrip() + ",\n" + HISTORY_SQL + "\nSELECT a.alarm_id, arg_max(vh.severity, vh.judged_at) AS score, max(vh.judged_at) AS judged_at FROM alarms a LEFT JOIN vh USING (template_id) WHERE a.open GROUP BY a.alarm_id")
def alarm_detail(spark, sf):
    records = L.verdict_rows(spark).select("template_id", F.concat("template_id", F.lit("-"), F.col("judged_at").cast("string")).alias("id"), F.lit("{}").alias("answers_json"), F.col("judged_at").alias("recorded_at"))
    d = board.detail(_alarms(spark, sf).filter("open"), L.verdict_rows(spark), records)
    return d.select("alarm_id", F.col("verdict.severity").alias("score"), F.col("record.recorded_at").alias("judged_at"))


# The board


@query(ALL_SQL + "SELECT count(*) AS open, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE lane = 'Page') AS paging, count(DISTINCT host) AS hosts FROM alarms")
def board_totals(spark, sf):
    return board.totals(_alarms(spark, sf))


@query(ALL_SQL + "SELECT s.severity, count(a.alarm_id) AS n FROM (VALUES ('info'), ('minor'), ('major'), ('critical')) s(severity) LEFT JOIN alarms a ON a.severity = s.severity GROUP BY s.severity")
def board_by_severity(spark, sf):
    return board.by_severity(_alarms(spark, sf))


@query(ALL_SQL + "SELECT host, count(*) AS n FROM alarms GROUP BY host")
def board_by_host(spark, sf):
    return board.by_host(_alarms(spark, sf))


@query(ALL_SQL + "SELECT alarm_id, count, host FROM alarms WHERE severity = 'critical' AND contains(lower(template || ' ' || host), 'error event')")
def board_filter_sort(spark, sf):
    return board.filtered(_alarms(spark, sf), severity="critical", text="ERROR event").select("alarm_id", "count", "host")


@query("WITH p AS (SELECT user_id, event_type, count(*) / CAST(sum(count(*)) OVER (PARTITION BY user_id) AS DOUBLE) AS p FROM events GROUP BY user_id, event_type), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, event_type) AS k FROM p) SELECT user_id, string_agg(event_type, ',' ORDER BY k) AS top, max(p) AS best FROM r WHERE k <= 4 GROUP BY user_id")
def answer_distribution(spark, sf):
    n = table(spark, sf, "events").groupBy("user_id", "event_type").count()
    share = n.groupBy("user_id").agg(F.sum("count").alias("all"), F.collect_list(F.struct("event_type", "count")).alias("x"))
    d = share.select("user_id", V.distribution(F.map_from_entries(F.transform("x", lambda e: F.struct(e["event_type"].alias("key"), (e["count"] / F.col("all")).alias("value"))))).alias("d"))
    return d.select("user_id", F.array_join(F.transform("d", lambda e: e["key"]), ",").alias("top"), F.get("d", F.lit(0))["value"].alias("best"))


# Scores


def _truth(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("line_id"), F.concat_ws("-", "o_orderstatus", "o_orderpriority").alias("truth"), F.when(F.col("o_orderstatus") == "P", F.lit("P")).otherwise(F.concat_ws("-", "o_orderstatus", "o_orderpriority", (F.col("o_custkey") % 2 * (F.col("o_orderpriority") == "1-URGENT").cast("int")).cast("string"))).alias("predicted"))


TRUTH_SQL = "t AS (SELECT o_orderkey AS line_id, o_orderstatus || '-' || o_orderpriority AS truth, CASE WHEN o_orderstatus = 'P' THEN 'P' ELSE o_orderstatus || '-' || o_orderpriority || '-' || (o_custkey % 2 * CAST(o_orderpriority = '1-URGENT' AS INT)) END AS predicted FROM orders)"


@query(with_(TRUTH_SQL, "a AS (SELECT truth, count(DISTINCT predicted) AS np, min(predicted) AS p, count(*) AS n FROM t GROUP BY truth), b AS (SELECT predicted, count(DISTINCT truth) AS nt FROM t GROUP BY predicted), x AS (SELECT a.n, a.np = 1 AND b.nt = 1 AS ok FROM a JOIN b ON a.p = b.predicted), y AS (SELECT sum(CASE WHEN ok THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE) AS ga, count(*) FILTER (WHERE ok) AS groups, count(*) AS truth_groups, (SELECT count(*) FROM b) AS predicted_groups FROM x)") + "SELECT ga, CASE WHEN groups > 0 THEN 2 * (groups / CAST(predicted_groups AS DOUBLE)) * (groups / CAST(truth_groups AS DOUBLE)) / (groups / CAST(predicted_groups AS DOUBLE) + groups / CAST(truth_groups AS DOUBLE)) ELSE 0 END AS fga, groups, truth_groups, predicted_groups FROM y")
def grouping_accuracy(spark, sf):
    return metrics.grouping_accuracy(_truth(spark, sf))


@query(with_(TRUTH_SQL) + "SELECT predicted, count(DISTINCT truth) AS groups, count(*) AS lines FROM t GROUP BY predicted HAVING count(DISTINCT truth) > 1")
def impurity_report(spark, sf):
    return metrics.impurity(_truth(spark, sf)).select("predicted", "groups", "lines")


@query(with_(TRUTH_SQL) + "SELECT count(*) AS merges FROM (SELECT predicted FROM t GROUP BY predicted HAVING count(DISTINCT truth) > 1)")
def merge_count(spark, sf):
    return metrics.merge_count(_truth(spark, sf))


@query(with_(TRUTH_SQL) + "SELECT truth, count(DISTINCT predicted) AS clusters, count(*) AS lines FROM t GROUP BY truth HAVING count(DISTINCT predicted) > 1 ORDER BY clusters DESC, lines DESC, truth LIMIT 10")
def split_report(spark, sf):
    return metrics.splits(_truth(spark, sf))


@query(with_(TRUTH_SQL, "a AS (SELECT truth, count(*) AS n FROM t GROUP BY truth), b AS (SELECT predicted, count(*) AS n FROM t GROUP BY predicted), p AS (SELECT truth, predicted, count(*) AS n FROM t GROUP BY ALL)") + "SELECT sum(CASE WHEN p.n = a.n AND p.n = b.n THEN p.n ELSE 0 END) / CAST(sum(p.n) AS DOUBLE) AS agreement FROM p JOIN a USING (truth) JOIN b USING (predicted)")
def clustering_agreement(spark, sf):
    return metrics.agreement(_truth(spark, sf), "truth", "predicted")


@query(with_(EVENTS_SQL) + "SELECT template, count(*) AS size, arg_min(raw, event_id) AS example FROM lines GROUP BY template")
def cluster_list(spark, sf):
    return metrics.cluster_list(L.event_lines(spark, sf))


TEMPLATES = (("any", "order <*>"), ("urgent", "order <*> priority 1-URGENT"), ("done", "order <*> status F priority <*>"), ("done-low", "order <*> status F priority 5-LOW"), ("urgent-2", "<*> priority 1-URGENT"))
TEMPLATES_SQL = "tp AS (SELECT *, (len(template) - len(replace(template, '<*>', ''))) // 3 AS wild FROM (VALUES " + ", ".join(f"('{e}', '{t}')" for e, t in TEMPLATES) + ") x(event, template))"


@query(with_(ORDERS_SQL, TEMPLATES_SQL, "h AS (SELECT ol.event_id, tp.event, rank() OVER (PARTITION BY ol.event_id ORDER BY wild, -(len(template) - 3 * wild)) AS r FROM ol JOIN tp ON regexp_full_match(ol.raw, replace(template, '<*>', '.*?')))") + "SELECT event_id, CASE WHEN count(*) = 1 THEN min(event) ELSE 'ambiguous' END AS event FROM h WHERE r = 1 GROUP BY event_id")
def truth_match(spark, sf):
    rows = L.order_lines(spark, sf).select("event_id", F.col("raw").alias("content"))
    return files.truth_match(rows, spark.createDataFrame(list(TEMPLATES), "event string, template string")).select("event_id", "event")


@query()
def synth_candidates(spark, sf):
    d = L.document_lines(spark, sf).select((F.col("doc_id") * 1_000_000 + F.col("line_no")).alias("event_id"), "raw").withColumn("received_at", F.col("event_id"))
    return synth.candidates(d)


# Sources


def _frames(spark, sf):
    """RFC 5424 and 3164 frames in turn."""
    c = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("received_at"), F.col("o_orderpriority"))
    k = F.col("o_orderkey").cast("string")
    new = F.concat(F.lit("<34>1 "), F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z web"), (F.col("o_orderkey") % 3).cast("string"), F.lit(" shop 123 req"), k, F.lit(" - order "), k)
    old = F.concat(F.lit("<13>"), F.date_format("received_at", "MMM dd HH:mm:ss"), F.lit(" pve shop["), k, F.lit("]: order "), k)
    bad = F.concat(F.lit("<999>order "), k)
    frame = F.when(F.col("o_orderkey") % 3 == 0, new).when(F.col("o_orderkey") % 3 == 1, old).otherwise(bad)
    return c.select("o_orderkey", "received_at", frame.cast("binary").alias("raw"), F.lit("10.0.0.9").alias("peer"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'web' || (o_orderkey % 3) WHEN 1 THEN 'pve' ELSE '10.0.0.9' END AS host, CASE WHEN o_orderkey % 3 = 2 THEN 'failed' END AS parse, CASE o_orderkey % 3 WHEN 0 THEN 'auth' WHEN 1 THEN 'user' END AS facility, CASE o_orderkey % 3 WHEN 0 THEN 'crit' WHEN 1 THEN 'notice' END AS severity, CASE o_orderkey % 3 WHEN 0 THEN 'shop 123 req' || o_orderkey || ' - order ' || o_orderkey WHEN 1 THEN 'shop[' || o_orderkey || ']: order ' || o_orderkey ELSE '<999>order ' || o_orderkey END AS body, CASE WHEN o_orderkey % 3 < 2 THEN date_trunc('second', o_orderdate) END AS timestamp FROM orders")
def normalize_syslog(spark, sf):
    from ..functions.text import body

    e = syslog.normalise(_frames(spark, sf))
    get = lambda k: F.try_element_at("attrs", F.lit(k)).alias(k)
    return e.select("o_orderkey", "host", get("parse"), get("facility"), get("severity"), body(F.col("raw"), F.col("body_offset")).alias("body"), "timestamp")


@query("SELECT o_orderkey, date_trunc('second', o_orderdate) AS at FROM orders")
def year_resolution(spark, sf):
    o = table(spark, sf, "orders")
    at = syslog.nearest_year(F.month("o_orderdate"), F.day("o_orderdate"), F.date_format("o_orderdate", "HH:mm:ss"), F.col("o_orderdate") + F.expr("INTERVAL 40 DAYS"))
    return o.select("o_orderkey", at.alias("at"))


@query("SELECT event_id, event_type AS raw, CASE WHEN user_id % 2 = 0 THEN 'h' || user_id ELSE 'localhost' END AS host, ts AS timestamp, CASE WHEN user_id % 2 = 0 THEN 3 ELSE 2 END AS fields FROM events WHERE user_id % 5 <> 0")
def normalize_journal(spark, sf):
    return _journal(spark, sf).select("event_id", F.col("raw").cast("string").alias("raw"), "host", "timestamp", F.size("attrs").alias("fields"))


def _journal(spark, sf):
    e = table(spark, sf, "events")
    record = F.to_json(
        F.map_filter(
            F.create_map(
                F.lit("MESSAGE"), "event_type", F.lit("_SOURCE_REALTIME_TIMESTAMP"), F.unix_micros(F.col("ts").cast("timestamp")).cast("string"),
                F.lit("_HOSTNAME"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("h"), F.col("user_id").cast("string"))),
                F.lit("_SYSTEMD_UNIT"), F.when(F.col("user_id") % 5 == 0, "own.service").otherwise("app.service"),
            ),
            lambda _, v: v.isNotNull(),
        )
    )
    return journal.normalise(journal.parse(e.select("event_id", record.alias("line"))), own_unit="own.service")


@query("SELECT event_id, event_type AS raw, 'h' || (user_id % 4) AS host, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END AS timestamp, CAST(user_id AS VARCHAR) AS user_attr, '[a, ' || user_id || ']' AS list_attr, 'app' AS scope, 'api' AS service FROM events")
def normalize_otlp(spark, sf):
    e = table(spark, sf, "events")
    u = F.col("user_id").cast("string")
    nanos = F.when(F.col("event_id") % 3 == 0, F.lit("0")).otherwise(F.concat(F.unix_micros(F.col("ts").cast("timestamp")).cast("string"), F.lit("000")))
    export = F.concat(
        F.lit('{"resourceLogs":[{"resource":{"attributes":[{"key":"host.name","value":{"stringValue":"h'), (F.col("user_id") % 4).cast("string"), F.lit('"}},{"key":"service","value":{"stringValue":"api"}}]},"scopeLogs":[{"scope":{"name":"app"},"logRecords":[{"timeUnixNano":"'), nanos,
        F.lit('","severityNumber":9,"body":{"stringValue":"'), "event_type", F.lit('"},"attributes":[{"key":"user","value":{"intValue":"'), u, F.lit('"}},{"key":"list","value":{"arrayValue":{"values":[{"stringValue":"a"},{"intValue":"'), u, F.lit('"}]}}}]}]}]}]}'),
    )
    rows = otlp.normalise(e.select("event_id", export.alias("export"), F.lit("10.0.0.9").alias("peer")))
    get = lambda k, name: F.try_element_at("attrs", F.lit(k)).alias(name)
    return rows.select("event_id", F.col("raw").cast("string").alias("raw"), "host", "timestamp", get("attr.user", "user_attr"), get("attr.list", "list_attr"), get("scope", "scope"), get("resource.service", "service"))


@query("SELECT event_id, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY event_id) > 3 AS shed FROM events")
def shed_rate_limit(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.date_trunc("hour", "ts").alias("received_at"))
    return syslog.shed(e, 3).select("event_id", "shed")


@query(
    """SELECT source, count(*) AS n, count(DISTINCT host) AS hosts, CAST(sum(strlen(body)) AS BIGINT) AS bytes FROM (
    SELECT 'journal' AS source, event_type AS body, CASE WHEN user_id % 2 = 0 THEN 'h' || user_id ELSE 'localhost' END AS host FROM events WHERE user_id % 5 <> 0
    UNION ALL SELECT 'syslog', CASE o_orderkey % 3 WHEN 0 THEN 'shop 123 req' || o_orderkey || ' - order ' || o_orderkey WHEN 1 THEN 'shop[' || o_orderkey || ']: order ' || o_orderkey ELSE '<999>order ' || o_orderkey END, CASE o_orderkey % 3 WHEN 0 THEN 'web0' WHEN 1 THEN 'pve' ELSE '10.0.0.9' END FROM orders
    UNION ALL SELECT 'otlp', coalesce(text, ''), 'c' || (conv_id % 7) FROM conversations) GROUP BY source"""
)
def union_sources(spark, sf):
    """Journal records, frames and exports through their own readers, as one table of events."""
    from ..functions.text import body

    c = table(spark, sf, "conversations")
    value = lambda x: F.struct(x.alias("stringValue"))
    host = F.struct(F.lit("host.name").alias("key"), value(F.concat(F.lit("c"), (F.col("conv_id") % 7).cast("string"))).alias("value"))
    record = F.struct(value(F.coalesce("text", F.lit(""))).alias("body"))
    logs = F.struct(F.struct(F.array(host).alias("attributes")).alias("resource"), F.array(F.struct(F.array(record).alias("logRecords"))).alias("scopeLogs"))
    exports = c.select(F.to_json(F.struct(F.array(logs).alias("resourceLogs"))).alias("export"), F.lit("10.0.0.9").alias("peer"))
    sources = (
        _journal(spark, sf).withColumn("source", F.lit("journal")), syslog.normalise(_frames(spark, sf)), otlp.normalise(exports).withColumn("source", F.lit("otlp")),
    )
    rows = [e.select("source", "host", body(F.col("raw"), F.col("body_offset") if "body_offset" in e.columns else F.lit(0)).alias("body")) for e in sources]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return every.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("host").alias("hosts"), F.sum(F.octet_length("body").cast("long")).alias("bytes"))


@query("SELECT o_orderpriority AS model, count(*) AS records, CAST(sum(o_orderkey % 500) AS BIGINT) AS input_tokens, CAST(sum(o_orderkey % 80) AS BIGINT) AS output_tokens, CAST(sum((o_orderkey % 1000)) AS DOUBLE) AS cost FROM orders GROUP BY o_orderpriority")
def record_cost_totals(spark, sf):
    o = table(spark, sf, "orders")
    r = o.select(F.col("o_orderpriority").alias("model"), (F.col("o_orderkey") % 500).alias("input_tokens"), (F.col("o_orderkey") % 80).alias("output_tokens"), (F.col("o_orderkey") % 1000).cast("double").alias("cost"))
    return V.record_totals(r, "model")


# Streams: what the streaming twins end with.


@query(with_(EVENTS_SQL) + "SELECT template_id, count(*) AS lines FROM lines GROUP BY template_id")
def stream_windows(spark, sf):
    from ..streaming.jobs import counted_to_end

    return counted_to_end(spark, sf)


# Event lines of different types differ in one word of six, which is too much for one cluster.
@query(with_(EVENTS_SQL) + "SELECT event_id, template_id AS template_id_at_train, row_number() OVER (PARTITION BY template_id ORDER BY received_at, event_id) AS size FROM lines")
def stream_drain(spark, sf):
    from ..streaming.jobs import mined_to_end

    return mined_to_end(spark, sf)


# A miner that knows no parameter's child, no bound on children, or another order gives other rows.
@query(with_(DEALT_SQL) + f"SELECT event_id, size, 't_' || sha256(CASE WHEN moved THEN '<*>' ELSE w END || ' ' || v || '{DEALT_TAIL}') AS template_id_at_train FROM z")
def stream_drain_dealt(spark, sf):
    from ..streaming.jobs import dealt_to_end

    return dealt_to_end(spark, sf, _dealt)


CHANGELOG_SQL = ORACLE_SQL["alarm_changelog"]


# What clears after the last millisecond of the watermark is still open in the stream.
@query(f"SELECT alarm_id, at_sec, event_id, op, count FROM ({CHANGELOG_SQL}) WHERE op <> 'Cleared' OR at_sec < (SELECT floor((floor(max(epoch_us(ts)) / CAST(1000 AS DOUBLE)) * 1000 - min(epoch_us(ts))) / CAST({L.SQUEEZE}000000 AS DOUBLE)) FROM events)")
def stream_alarms(spark, sf):
    from ..streaming.jobs import alarms_to_end

    return alarms_to_end(spark, sf).select("alarm_id", "at_sec", "event_id", "op", "count")


@query()
def stream_contextual(spark, sf):
    """With contextual checks, answered as ``alarms_contextual`` answers them."""
    from ..streaming.jobs import alarms_to_end

    return alarms_to_end(spark, sf, A.AlarmConfig(), _answers(table(spark, sf, "events")))
