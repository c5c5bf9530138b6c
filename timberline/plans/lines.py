"""Log lines and judgments made from the driver's tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mask import DEFAULT, Bundle, mask
from ..functions.text import template_id
from ..operators.windows import seconds, window_stats
from ..runtime import spread, written

#: Judgments by event type: severity, actionable, contextual. ``view`` is unjudged.
VERDICTS = {"error": (3.0, 0.95, 0.1), "purchase": (2.0, 0.80, 0.7), "signup": (1.0, 0.90, 0.2), "click": (0.2, 0.60, 0.1)}
SQUEEZE = 40
JUDGED_AT = "2024-01-05 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; times without a zone are taken in the session's."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: df[c].cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def plain(df: DataFrame) -> DataFrame:
    """Times without a zone again, as in the tables."""
    return df.withColumns({c: df[c].cast("timestamp_ntz") for c, kind in df.dtypes if kind == "timestamp"})


def event_lines(spark: SparkSession, sf_dir: str, squeeze: int = SQUEEZE) -> DataFrame:
    """event_id, received_at, host, raw, event_type, template, template_id, sec."""
    e = spread(table(spark, sf_dir, "events"))
    raw = F.concat(
        F.lit("app["), F.col("user_id").cast("string"), F.lit("]: "), "event_type", F.lit(" event "), F.col("event_id").cast("string"), F.lit(" took "),
        F.floor(F.col("value") * 100).cast("long").cast("string"), F.lit("ms"),
    )
    lines = e.select("event_id", F.col("ts").alias("received_at"), F.concat(F.lit("host"), (F.col("user_id") % 4).cast("string")).alias("host"), raw.alias("raw"), "event_type")
    lines = lines.withColumn("template", mask(F.col("raw"))).withColumn("template_id", template_id(F.col("template")))
    return seconds(lines, squeeze=squeeze)


def verdicts(spark: SparkSession) -> DataFrame:
    rows = [(f"app<VAR:PID>: {kind} event <VAR:NUM> took <VAR:DUR>", *answers) for kind, answers in VERDICTS.items()]
    made = spark.createDataFrame(rows, "template string, severity double, actionable double, contextual double")
    return made.select(template_id(F.col("template")).alias("template_id"), "severity", "actionable", "contextual")


def verdict_rows(spark: SparkSession) -> DataFrame:
    """A history: each judgment, and a revised one five days later that halves the severity."""
    v = verdicts(spark).withColumns({"questions_hash": F.lit("q1"), "bundle_hash": F.lit("b1"), "model": F.lit("table"), "judged_at": F.lit(JUDGED_AT).cast("timestamp")})
    later = v.withColumns({"severity": F.col("severity") / 2, "judged_at": F.col("judged_at") + F.expr("INTERVAL 5 DAYS")})
    return v.unionByName(later)


def order_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as judgments: a customer is a template, judged anew with each order, by one of two sets of questions."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("t_"), F.col("o_custkey").cast("string")).alias("template_id"), F.concat(F.lit("q"), (key % 2).cast("string")).alias("questions_hash"), F.lit("b1").alias("bundle_hash"),
        F.col("o_orderpriority").alias("model"), (key % 31 / 10).alias("severity"), F.timestamp_micros(F.unix_micros("o_orderdate") + key).alias("judged_at"),
    )


ORDER_VERDICTS_SQL = "ov AS (SELECT 't_' || o_custkey AS template_id, 'q' || (o_orderkey % 2) AS questions_hash, 'b1' AS bundle_hash, o_orderpriority AS model, (o_orderkey % 31) / CAST(10 AS DOUBLE) AS severity, make_timestamp(epoch_us(o_orderdate) + o_orderkey) AS judged_at FROM orders)"


def stored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lines, masked once and written, for what reads them more than once."""
    return written(event_lines(spark, sf_dir), "lines")


def judged_lines(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Event lines with window statistics and their judgment (null where unjudged)."""
    return window_stats(stored_lines(spark, sf_dir) if lines is None else lines).join(F.broadcast(verdicts(spark)), "template_id", "left")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spread(table(spark, sf_dir, "orders"))
    raw = F.concat(
        F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" for customer "), F.col("o_custkey").cast("string"), F.lit(" placed at "),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(" status "), "o_orderstatus", F.lit(" priority "), "o_orderpriority",
    )
    return o.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("received_at"), raw.alias("raw"), "o_orderstatus", "o_orderpriority")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each non-empty line of each document."""
    d = spread(table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "raw")).filter("raw <> ''")


# The same as DuckDB SQL.


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_mask(x: str, bundle: Bundle = DEFAULT) -> str:
    """Pieces between the matches, and the matches named by the first slot that fits whole."""
    alt = quoted(bundle.alternation)
    cases = " ".join(f"WHEN regexp_full_match(m, {quoted(s.pattern)}) THEN '<VAR:{s.name}>'" for s in bundle.slots)
    name = f"list_transform(regexp_extract_all({x}, {alt}), lambda m: CASE WHEN regexp_full_match(m, '<VAR:[A-Z][A-Z0-9_]*>') THEN m {cases} ELSE m END)"
    pieces = f"string_split_regex({x}, {alt})"
    return f"array_to_string(list_transform(list_zip({pieces}, {name}), lambda z: z[1] || coalesce(z[2], '')), '')"


EVENTS_SQL = f"""e0 AS (SELECT event_id, ts AS received_at, 'host' || (user_id % 4) AS host, event_type,
    'app[' || user_id || ']: ' || event_type || ' event ' || event_id || ' took ' || CAST(floor(value * 100) AS BIGINT) || 'ms' AS raw FROM events),
e1 AS (SELECT *, {sql_mask('raw')} AS template FROM e0),
lines AS (SELECT *, 't_' || sha256(template) AS template_id,
    CAST(floor((epoch_us(received_at) - min(epoch_us(received_at)) OVER ()) / CAST({SQUEEZE}000000 AS DOUBLE)) AS BIGINT) AS sec FROM e1)"""

VERDICTS_SQL = "v AS (SELECT 't_' || sha256('app<VAR:PID>: ' || k || ' event <VAR:NUM> took <VAR:DUR>') AS template_id, CAST(severity AS DOUBLE) AS severity, CAST(actionable AS DOUBLE) AS actionable, CAST(contextual AS DOUBLE) AS contextual FROM (VALUES " + ", ".join(
    f"('{k}', {a}, {b}, {c})" for k, (a, b, c) in VERDICTS.items()
) + ") t(k, severity, actionable, contextual))"

HISTORY_SQL = f"""vh AS (SELECT *, 'q1' AS questions_hash, 'b1' AS bundle_hash, 'table' AS model, TIMESTAMP '{JUDGED_AT}' AS judged_at FROM v
    UNION ALL SELECT template_id, severity / 2, actionable, contextual, 'q1', 'b1', 'table', TIMESTAMP '{JUDGED_AT}' + INTERVAL 5 DAY FROM v)"""

STATS_SQL = """st AS (SELECT *,
    coalesce(count(*) OVER (PARTITION BY template_id ORDER BY sec // 10 RANGE BETWEEN 29 PRECEDING AND 1 PRECEDING), 0) + row_number() OVER (PARTITION BY template_id, sec // 10 ORDER BY sec, event_id) AS short_total,
    coalesce(count(*) OVER (PARTITION BY template_id ORDER BY sec // 60 RANGE BETWEEN 59 PRECEDING AND 1 PRECEDING), 0) + row_number() OVER (PARTITION BY template_id, sec // 60 ORDER BY sec, event_id) AS long_total,
    CAST(len(list_distinct(list_concat(coalesce(list(host) OVER (PARTITION BY template_id ORDER BY sec RANGE BETWEEN 299 PRECEDING AND 1 PRECEDING), []),
        list(host) OVER (PARTITION BY template_id, sec ORDER BY event_id ROWS UNBOUNDED PRECEDING)))) AS BIGINT) AS distinct_hosts,
    min(sec) OVER (PARTITION BY template_id) AS first_seen_secs, least(sec - min(sec) OVER (PARTITION BY template_id), 3600) AS span_secs FROM lines)"""

SEVERITY_SQL = "CASE WHEN round(severity) >= 3 THEN 4 WHEN round(severity) = 2 THEN 3 WHEN round(severity) = 1 THEN 2 WHEN severity IS NOT NULL THEN 1 END"
NAME_SQL = "['cleared', 'info', 'minor', 'major', 'critical'][rank_ + 1]"
TRIGGER_SQL = "(short_total >= 5 OR (span_secs >= 300 AND short_total / CAST(300 AS DOUBLE) >= CAST(3 AS DOUBLE) * long_total / span_secs))"

ALARMS_SQL = f"""g AS (SELECT *, rank_ >= 4 OR {TRIGGER_SQL} AS trig FROM (SELECT st.*, v.severity, v.actionable, v.contextual, {SEVERITY_SQL} AS rank_ FROM st JOIN v USING (template_id)) WHERE rank_ >= 2 AND actionable >= 0.5),
i0 AS (SELECT *, sec - lag(sec) OVER k AS gap FROM g WINDOW k AS (PARTITION BY template_id, host ORDER BY sec, event_id)),
i1 AS (SELECT *, sum(CASE WHEN gap <= 900 THEN 0 ELSE 1 END) OVER (PARTITION BY template_id, host ORDER BY sec, event_id) AS island FROM i0),
i2 AS (SELECT *, bool_or(trig) OVER (PARTITION BY template_id, host, island ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) AS live FROM i1),
i3 AS (SELECT *, min(sec) OVER (PARTITION BY template_id, host, island) AS episode FROM i2 WHERE live),
ep AS (SELECT template_id, host, island, min(sec) AS s, max(sec) AS l FROM i3 GROUP BY ALL),
ea AS (SELECT *, sum(CASE WHEN s - (lag(l) OVER w0 + 900) <= 1800 THEN 0 ELSE 1 END) OVER w0 AS alarm_no FROM
    (SELECT *, lag(l) OVER (PARTITION BY template_id, host ORDER BY s) AS prev FROM ep) WINDOW w0 AS (PARTITION BY template_id, host ORDER BY s)),
rw AS (SELECT i3.*, ea.alarm_no FROM i3 JOIN ea USING (template_id, host, island)),
al AS (SELECT template_id, host, alarm_no, arg_min(event_id, (sec, event_id)) AS first_event, arg_min(template, (sec, event_id)) AS template, arg_min(raw, (sec, event_id)) AS exemplar,
    max(rank_) AS rank_, count(*) AS count, count(DISTINCT episode) AS episodes, min(sec) AS opened_sec, max(sec) AS last_sec FROM rw GROUP BY ALL),
alarms AS (SELECT sha256(template_id || '|' || host || '|' || first_event) AS alarm_id, template_id, host, template, exemplar, {NAME_SQL} AS severity, 'Dashboard' AS lane, count, episodes, opened_sec, last_sec,
    last_sec + 900 AS clears_sec, last_sec + 900 >= (SELECT max(sec) FROM lines) AS open FROM al)""".replace(
    "sum(CASE WHEN s - (lag(l) OVER w0 + 900) <= 1800 THEN 0 ELSE 1 END) OVER w0", "sum(CASE WHEN s - (prev + 900) <= 1800 THEN 0 ELSE 1 END) OVER w0"
)


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


ALL_SQL = with_(EVENTS_SQL, STATS_SQL, VERDICTS_SQL, ALARMS_SQL)
