"""Queries F1–F13 and O1–O4: filters, search, sort and limit."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from loglake.operators import filters as L
from loglake.operators import search as S
from loglake.operators import search_index as I
from loglake.operators.aggregates import top_k_by_count
from loglake.plans.fixtures import AS_OF, LOGS, T_FROM, T_TO, logs, table
from loglake.plans.registry import once, query

_SOME = ["id", "tenant_id", "timestamp", "level"]
_SOME_SQL = "SELECT id, tenant_id, timestamp, level FROM logs WHERE "


@query("f1_tenant_scope", LOGS + _SOME_SQL + "tenant_id = 'tenant-2'")
def _(spark, sf):
    return L.tenant_scope(logs(spark, sf), "tenant-2").select(*_SOME)


_ODD_TENANT = """CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN concat('t''', CAST(user_id AS {s})) WHEN 3 THEN concat('t--', CAST(user_id AS {s}))
  WHEN 4 THEN 'a;b' WHEN 5 THEN concat('tenant-', CAST(user_id AS {s})) END"""


@query(
    "f2_check_tenant_id",
    f"""WITH t AS (SELECT event_id, {_ODD_TENANT.format(s='VARCHAR')} AS tenant FROM events)
    SELECT event_id, CASE WHEN trim(coalesce(tenant, '')) = '' THEN 'empty'
      WHEN contains(tenant, '''') OR contains(tenant, '"') OR contains(tenant, ';') OR contains(tenant, chr(92)) OR contains(tenant, '--') THEN 'unsafe' END AS problem
    FROM t""",
)
def _(spark, sf):
    quoted = _ODD_TENANT.format(s="STRING").replace("'t'''", "\"t'\"")
    rows = table(spark, sf, "events").select("event_id", F.expr(quoted).alias("tenant"))
    return rows.select("event_id", L.check_tenant_id(F.col("tenant")).alias("problem"))


@query("f3_time_range", LOGS + _SOME_SQL + "timestamp >= TIMESTAMP '2024-01-05 06:00:00' AND timestamp < TIMESTAMP '2024-01-25 18:00:00'")
def _(spark, sf):
    return L.time_range(logs(spark, sf), "2024-01-05 06:00:00", "2024-01-25 18:00:00").select(*_SOME)


@query("f3_time_range_closed", LOGS + _SOME_SQL + "timestamp >= TIMESTAMP '2024-01-05 06:00:00' AND timestamp <= TIMESTAMP '2024-01-25 18:00:00'")
def _(spark, sf):
    return L.time_range(logs(spark, sf), "2024-01-05 06:00:00", "2024-01-25 18:00:00", closed=True).select(*_SOME)


@query("f4_last", LOGS + _SOME_SQL + f"timestamp >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY")
def _(spark, sf):
    return L.last(logs(spark, sf), "7 DAYS", AS_OF).select(*_SOME)


@query("f5_day_filter", LOGS + _SOME_SQL + "year = '2024' AND month = '01' AND day = '23' AND hour = '07'")
def _(spark, sf):
    return L.day_filter(logs(spark, sf), "2024", "01", "23", "07").select(*_SOME)


@query("f5_day_between", LOGS + _SOME_SQL + "year = '2024' AND month = '01' AND day BETWEEN '03' AND '27'")
def _(spark, sf):
    return L.day_between(logs(spark, sf), "2024", "01", "03", "27").select(*_SOME)


@query("f5_partition_range", LOGS + _SOME_SQL + "timestamp >= TIMESTAMP '2024-01-09 05:00:00' AND timestamp < TIMESTAMP '2024-01-23 08:00:00'")
def _(spark, sf):
    rows = L.partition_range(logs(spark, sf), dt.datetime(2024, 1, 9, 5, 30), dt.datetime(2024, 1, 23, 7, 30))
    return rows.select(*_SOME)


@query("f6_type_and_level", LOGS + _SOME_SQL + "log_type = 'Error' AND level IN ('Error', 'Fatal') AND category = 'exception'")
def _(spark, sf):
    rows = L.name_in(logs(spark, sf), "log_type", "ERROR")
    return L.name_in(L.name_in(rows, "level", "error", "Fatal"), "category", "exception").select(*_SOME)


@query("f7_min_severity", LOGS + _SOME_SQL + "level IN ('Warning', 'Error', 'Fatal')")
def _(spark, sf):
    return L.min_severity(logs(spark, sf), "warning").select(*_SOME)


@query("f8_not_null", LOGS + _SOME_SQL + "status_code IS NOT NULL AND duration_ms IS NOT NULL")
def _(spark, sf):
    return L.not_null(logs(spark, sf), "status_code", "duration_ms").select(*_SOME)


@query("f9_contains", LOGS + _SOME_SQL + "message LIKE '%error k=1%'")
def _(spark, sf):
    return L.contains(logs(spark, sf), "error k=1").select(*_SOME)


def _w(col: str, pattern: str) -> str:
    return f"regexp_matches(lower({col}), '(^|[^\\p{{L}}\\p{{N}}_]){pattern}($|[^\\p{{L}}\\p{{N}}_])')"


_SEP = "[^\\p{L}\\p{N}_]+"
_REST = "[\\p{L}\\p{N}_]*"


def _any(pattern: str) -> str:
    return "(" + " OR ".join(f"coalesce({_w(c, pattern)}, false)" for c in ("message", "category", "tag_k", "region", "tag_http_status")) + ")"


_REGION = LOGS.replace("event_id, user_id,", "event_id, concat('region-', CAST(user_id % 5 AS STRING)) AS region, user_id,")


def _log_index(spark, sf):
    """Two batches, as a stream would bring them."""

    def write(path):
        rows = logs(spark, sf)
        for part in (0, 1):
            batch = rows.filter(F.pmod(F.col("id").cast("long"), F.lit(2)) == part)
            I.index_batch(batch, path, part, ["id"], I.log_fields(batch), ("message", "level", "timestamp"))

    return I.Index(spark, once(spark, sf, "log-index", write), "id string", "message string, level string, timestamp timestamp_ntz")


def _document_index(spark, sf):
    def write(path):
        I.index_batch(table(spark, sf, "documents"), path, 0, ["doc_id"], I.text_field("text"))

    return I.Index(spark, once(spark, sf, "document-index", write), "doc_id long")


_LOG_SEARCH = (
    _REGION + "SELECT id, message, level FROM logs WHERE "
    + f"(({_any('error')} AND NOT {_w('level', 'fatal')}) OR {_any('region' + _SEP + '3')} AND coalesce({_w('tag_k', '7' + _REST)}, false))"
    + " ORDER BY timestamp DESC, id LIMIT 10000"
)
_LOG_QUERY = '(error AND NOT level:Fatal) OR "region 3" AND k:7*'


@query("f10_search_logs", _LOG_SEARCH)
def _(spark, sf):
    """Postings tell the entries, whose stored columns are shown; the logs are not read."""
    hits = I.hits(_log_index(spark, sf), _LOG_QUERY)
    return hits.orderBy(F.col("timestamp").desc(), "id").limit(10_000).select("id", "message", "level")


@query("f10_scan_logs", _LOG_SEARCH)
def _(spark, sf):
    return S.search(logs(spark, sf), _LOG_QUERY, 10_000).select("id", "message", "level")


_DOCUMENT_SEARCH = (
    "SELECT doc_id, source FROM documents WHERE "
    + f"({_w('text', 'the')} AND NOT {_w('text', 'ention' + _REST)}) OR ({_w('text', 'que' + _SEP + 'le')} AND ({_w('text', 'paire')} OR {_w('text', 'mentre')})) OR {_w('text', 'licen.e')}".replace(
        "licen.e", "licen[\\p{L}\\p{N}_]e"
    )
)
_DOCUMENT_QUERY = '(the AND NOT ention*) OR ("que le" AND (paire OR mentre)) licen?e'


@query("f10_search_documents", _DOCUMENT_SEARCH)
def _(spark, sf):
    found = I.matching(_document_index(spark, sf), _DOCUMENT_QUERY, ("text",))
    return table(spark, sf, "documents").select("doc_id", "source").join(found, "doc_id", "left_semi")


@query("f10_scan_documents", _DOCUMENT_SEARCH)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.filter(S.search_predicate(_DOCUMENT_QUERY, ("text",), tags=None)).select("doc_id", "source")


@query("f10_search_excluding", _REGION + f"SELECT id, message, level FROM logs WHERE ({_any('error')} OR {_any('k')}) AND NOT {_w('level', 'fatal')}")
def _(spark, sf):
    return logs(spark, sf).filter(S.search_predicate("error k NOT level:Fatal")).select("id", "message", "level")


_TOKENS = """WITH toks AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS w FROM documents),
    tf AS (SELECT doc_id, w, count(*) AS f FROM toks WHERE w IN ({terms}) GROUP BY 1, 2),
    df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
    st AS (SELECT count(*) AS n, avg(length(text)) AS avg_len FROM documents)
    SELECT doc_id, round(sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length(text) / avg_len))), {digits}) AS score
    FROM tf JOIN df USING (w) JOIN documents USING (doc_id), st GROUP BY doc_id"""


_RANKED = _TOKENS.replace("{terms}", "'the', 'license', 'que'").replace("{digits}", "9") + " ORDER BY score DESC, doc_id LIMIT 50"


@query("f11_search_ranked", _RANKED)
def _(spark, sf):
    return I.ranked(_document_index(spark, sf), ["the", "license", "que"], 50, "text")


@query("f11_scan_ranked", _RANKED)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return S.search_ranked(docs, ["the", "license", "que"], 50, text="text", tie_break="doc_id").select("doc_id", "score")


@query("f11_relevance_all", _TOKENS.replace("{terms}", "'the'").replace("{digits}", "7"))
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return S.relevance(docs, ["the"], "text").select("doc_id", F.round("score", 7).alias("score"))


@query("f12_trace_lookup", LOGS + "SELECT id, trace_id, message FROM logs WHERE trace_id = 'trace-123'")
def _(spark, sf):
    return L.trace_lookup(logs(spark, sf), "trace-123").select("id", "trace_id", "message")


@query("f13_has_tag", LOGS + "SELECT id, tenant_id, timestamp, level FROM logs WHERE tag_http_status IS NOT NULL")
def _(spark, sf):
    return L.has_tag(logs(spark, sf), "http_status").select(*_SOME)


@query("f13_tag_eq", LOGS + _SOME_SQL + "tag_k = '42'")
def _(spark, sf):
    return L.tag_eq(logs(spark, sf), "k", "42").select(*_SOME)


@query("o1_order_by_time", LOGS + "SELECT id, timestamp, service FROM logs ORDER BY timestamp, id LIMIT 1000")
def _(spark, sf):
    return logs(spark, sf).orderBy("timestamp", "id").limit(1000).select("id", "timestamp", "service")


@query("o2_top_k", LOGS + "SELECT endpoint, count(*) AS count FROM logs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def _(spark, sf):
    return top_k_by_count(logs(spark, sf), "endpoint", 5)


@query("o3_ordinal_sort", "SELECT url FROM (SELECT DISTINCT url FROM pages) ORDER BY url COLLATE C LIMIT 20000")
def _(spark, sf):
    return table(spark, sf, "pages").select("url").distinct().orderBy("url").limit(L.result_limit(20_000))


@query("o4_result_cap", LOGS + "SELECT id, message FROM logs ORDER BY timestamp DESC, id LIMIT 50")
def _(spark, sf):
    return S.search(logs(spark, sf), None, None, T_FROM, T_TO).select("id", "message")
