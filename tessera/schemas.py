"""Schemas of the logical tables."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _l, _i, _d, _b, _date, _ts = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.DateType(), T.TimestampType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


SEGMENT = _table(label=_s, char_start=_i, char_end=_i, kind=_s, level=_i)
DOCUMENTS = _table(stable_id=_s, ecli=_s, source=_s, doc_type=_s, court=_s, title=_s, decision_date=_date, language=_s, payload_hash=_s, text=_s, segments=T.ArrayType(SEGMENT), meta_json=_s, upstream_status=_s, search_excluded=_b)
RELATIONS = _table(relation_id=_l, src_id=_s, dst_id=_s, candidate_id=_s, raw=_s, type=_s, status=_s, via=_s, src_anchor=_s, dst_anchor=_s, char_start=_i, char_end=_i)
CITATIONS = _table(citation_id=_l, src_id=_s, raw=_s, candidate_id=_s, kind=_s, method=_s, confidence=_d, char_start=_i, char_end=_i, pinpoint=_s)
CHUNKS = _table(doc_id=_s, chunk_id=_i, text=_s, embed_input=_s, structural_unit=_s, char_start=_i, char_end=_i)
EMBEDDINGS = _table(doc_id=_s, chunk_id=_i, family=_s, vector=T.ArrayType(T.FloatType(), False))
ALIASES = _table(alias=_s, canonical_id=_s, origin=_s)
TAGS = _table(doc_id=_s, tag=_s, added_by=_s, rule_id=_l)
AUTHORITY = _table(doc_id=_s, pagerank=_d, pagerank_decayed=_d, percentile=_d, in_degree=_l, out_degree=_l)
RUNS = _table(run_id=_l, source_key=_s, kind=_s, status=_s, started_at=_ts, finished_at=_ts, stored=_l)
WATERMARKS = _table(key=_s, watermark=_s)
ALL = {k.lower(): v for k, v in list(globals().items()) if k.isupper() and isinstance(v, T.StructType)}
