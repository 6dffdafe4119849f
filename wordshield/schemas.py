"""Schemas of the scanner's tables."""

from __future__ import annotations

from pyspark.sql import types as T

METHODS = ("exact", "homoglyph", "separator_bypass", "leetspeak", "repetition", "fuzzy")
TIERS = ("low", "medium", "high", "critical")

_S, _I, _L, _D, _B, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


MESSAGE = _struct(message_id=_S, text=_S)
LEXICON = _struct(word=_S, normalized=_S, base_score=_D, tags=T.ArrayType(_S), enabled=_B, id=_L, ord=_L, created_at=_TS, updated_at=_TS)
DETECTION = _struct(
    word=_S, matched_form=_S, start=_I, end=_I, base_score=_D, final_score=_D, method=_S, sub_methods=T.ArrayType(_S),
    homoglyphs_detected=T.ArrayType(T.ArrayType(_S)), distance=_I, tags=T.ArrayType(_S), tier=_S,
)
SUMMARY = _struct(total_detections=_I, distinct_words=_I, highest_score=_D, average_score=_D, tier=_S, action=_S)
#: context is JSON. appended names an append; written (when, in nanoseconds) and nth order the log's rows; arrived is that order's place of an id's first report, where it is no longer in the log.
REPORT = _struct(message_id=_S, timestamp=_TS, text=_S, normalized_text=_S, detections=T.ArrayType(DETECTION), summary=SUMMARY, context=_S, processing_time_ms=_D, appended=_S, written=_L, nth=_L, arrived=_struct(written=_L, nth=_L))
