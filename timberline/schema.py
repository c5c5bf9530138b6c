"""Row types of the engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, L, D, TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


EVENT = _struct(
    event_id=L, raw=T.BinaryType(), received_at=TS, timestamp=TS, host=S, source=S, attrs=T.MapType(S, S), body_offset=T.IntegerType()
)
CLASSIFIED = _struct(event_id=L, received_at=TS, host=S, raw=S, template=S, template_id=S)
CLUSTER = _struct(seq=L, template=S, tokens=T.ArrayType(S), template_id=S, size=L)
ANSWER = _struct(kind=S, choice=S, score=D, noul=D, confidence=D, probabilities=T.MapType(S, D), legend=T.MapType(S, S))
VERDICT = _struct(template_id=S, questions_hash=S, bundle_hash=S, model=S, judged_at=TS, severity=D, actionable=D, contextual=D)
MERGE = _struct(
    id_lo=S, id_hi=S, template_lo=S, template_hi=S, questions_hash=S, bundle_hash=S, model=S, noul=D, merged=T.BooleanType(), judged_at=TS
)
CHECK_ANSWER = _struct(template_id=S, host=S, trip_event_id=L, answered_at=TS, matters_now=D, wake_someone=D, correlates_with=S)
RECORD = _struct(
    id=S, template_id=S, questions_hash=S, model=S, template=S, state_json=S, questions_json=S, answers_json=S,
    input_tokens=L, output_tokens=L, cost=D, recorded_at=TS,
)
ALARM = _struct(
    alarm_id=S, template_id=S, template=S, exemplar=S, severity=S, host=S, lane=S, count=L, opened_at=TS, last_at=TS, cleared_at=TS
)
CHANGE = _struct(seq=L, op=S, alarm_id=S, at_time=TS, count=L, severity=S)

#: In order: a larger place is worse.
SEVERITIES = ("cleared", "info", "minor", "major", "critical")
LANES = ("Page", "Dashboard", "Record")
SOURCES = ("syslog", "journal", "otlp")


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), rank.cast("int") + 1)


def severity_rank(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), name).cast("int") - 1
