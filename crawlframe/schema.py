"""Schemas of the crawl's tables."""

from __future__ import annotations

from pyspark.sql import types as T

HEADERS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))
STRINGS = T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, I, L, B, TS = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType()

REQUESTS = _struct(
    id=S, url=S, loaded_url=S, unique_key=S, method=S, headers=HEADERS, body=S, user_data=S, label=S, retry_count=I, session_rotation_count=I, max_retries=I,
    no_retry=B, error_messages=STRINGS, handled_at=TS, state=S, crawl_depth=I, skip_navigation=B, order_no=L,
)
RESPONSES = _struct(url=S, final_url=S, status=I, headers=HEADERS, body=T.BinaryType(), redirect_chain=STRINGS)
LINKS = _struct(src_url=S, position=I, raw=S, base=S)
OUTCOMES = _struct(request_id=S, loaded_url=S, outcome=S, response_status=I, retry_count=I, duration_ns=L, error=S, finished_at=TS)
ATTEMPTS = _struct(request_id=S, attempt=I, status=I, error_class=S, error_text=S, retry_after_ms=L, session_id=S, proxy=S, response_bytes=L)
SITEMAP_ENTRIES = _struct(loc=S, lastmod=S, priority=T.FloatType(), changefreq=S)
SESSIONS = _struct(id=S, cookies=S, error_score_scaled=I, usage_count=I, retired=B, expires_at=TS)
COOKIES = _struct(name=S, value=S, domain=S, host_only=B, path=S, expires=TS, secure=B, http_only=B, same_site=S)
DATASET_ITEMS = _struct(dataset=S, seq=L, item=S)
KV = _struct(store=S, key=S, value=T.BinaryType(), content_type=S, size=L)
