"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from oracle import detection_sql as O
from oracle.detection_sql import DISPLAY_TOKEN, MOCK_SUFFIX, TEXTS, TOKEN, Ctes, sql

AT, NOW, TTL = 1_704_067_200, 1_704_067_200 + 900, 600
STORED_AT = f"({AT} + 60 * (len(text) % 20))"


def _spans(name: str) -> str:
    return f'SELECT request_id, type, value, s AS start, e AS "end" FROM {name}'


DET = TEXTS + O.detections()
TOK = TEXTS + O.tokens()
MSK = TEXTS + O.masked()
REP = TEXTS + O.report()

SHIFTED = TEXTS + [
    ("shifted", "SELECT request_id, '\U0001F600 ' || text AS text FROM texts")
] + O.detections("shifted")

RAW: Ctes = list(TEXTS)
for _kind in O.MARKS:
    RAW += O.matches(_kind)
RAW += [
    (
        "raw",
        " UNION ALL ".join(
            f"SELECT request_id, '{k}' AS type, raw AS value, s AS start "
            f"FROM m_texts_{k.lower()}" for k in O.MARKS
        ),
    )
]

MAPPINGS = TOK + [
    (
        "maps",
        "SELECT request_id, token, type, first_value AS original_value, s AS start, "
        'e AS "end" FROM tok_texts WHERE s = first_s',
    )
]

STORED = MAPPINGS + [
    (
        "sets",
        f"SELECT m.*, {STORED_AT} AS stored_at, {STORED_AT} + {TTL} AS expires_at "
        "FROM maps m JOIN texts USING (request_id)",
    )
]

# Stored again: texts of even length, five minutes later, for three minutes, e-mails only.
NEWEST = STORED + [
    (
        "again",
        "SELECT m.* EXCLUDE (stored_at, expires_at), stored_at + 300 AS stored_at, "
        "stored_at + 480 AS expires_at FROM sets m JOIN texts USING (request_id) "
        "WHERE len(text) % 2 = 0 AND type = 'EMAIL'",
    ),
    (
        "newest",
        "SELECT * FROM again UNION ALL SELECT * FROM sets "
        "WHERE request_id NOT IN (SELECT request_id FROM again)",
    ),
    ("live", f"SELECT * FROM newest WHERE expires_at > {NOW}"),
]

REQUESTS = TEXTS + [
    (
        "requests",
        r"""SELECT request_id, text, CASE len(text) % 11 WHEN 0 THEN ' OpenAI '
             WHEN 1 THEN 'ANTHROPIC' ELSE 'mock' END AS provider FROM texts
        UNION ALL SELECT 'provider-' || request_id, text,
          CASE len(text) % 11 WHEN 2 THEN 'unknown-provider' ELSE ' ' || chr(9) || ' ' END
          FROM texts WHERE len(text) % 11 IN (2, 3)
        UNION ALL SELECT 'text-' || request_id,
          CASE WHEN len(text) % 13 = 0 THEN ' ' || chr(10) || chr(9) || ' ' END,
          CASE len(text) % 11 WHEN 0 THEN ' OpenAI ' WHEN 1 THEN 'ANTHROPIC' ELSE 'mock' END
          FROM texts WHERE len(text) % 13 IN (0, 1)""",
    ),
    (
        "checked",
        r"""SELECT *,
        text IS NOT NULL AND regexp_matches(text, '[^\x00-\x20]') AS has_text,
        regexp_matches(provider, '[^\x00-\x20]') AS has_provider,
        text IS NULL OR list_sum(list_transform(string_split(text, ''),
          lambda c: CASE WHEN unicode(c) > 65535 THEN 2 ELSE 1 END)) <= 10000 AS within_size,
        CASE lower(trim(provider, ' ' || chr(9))) WHEN 'openai' THEN 'openai'
          WHEN 'anthropic' THEN 'anthropic' WHEN 'mock' THEN 'mock' END AS resolved
        FROM requests""",
    ),
    (
        "kinds",
        """SELECT *, CASE WHEN NOT has_text OR NOT has_provider THEN 'bad_input'
        WHEN NOT within_size THEN 'too_large'
        WHEN resolved IS NULL THEN 'unsupported_provider' END AS kind FROM checked""",
    ),
    ("within", "SELECT request_id, text, resolved AS provider FROM kinds WHERE kind IS NULL"),
    (
        "accepted",
        "SELECT request_id, text, resolved AS provider FROM kinds "
        "WHERE has_text AND has_provider AND resolved IS NOT NULL",
    ),
    (
        "rejected",
        f"""SELECT request_id,
        CASE kind WHEN 'too_large' THEN 413 ELSE 400 END AS status,
        CASE kind WHEN 'too_large' THEN 'Payload Too Large' ELSE 'Bad Request' END AS error,
        CASE kind WHEN 'too_large'
          THEN 'Request text exceeds the maximum allowed length of 10000 characters.'
          WHEN 'bad_input' THEN 'Invalid request.'
          ELSE 'Unsupported provider: ' || provider END AS message,
        {AT} AS at FROM kinds WHERE kind IS NOT NULL""",
    ),
]

ANALYZED = REQUESTS + O.report("accepted") + [
    (
        "places",
        "SELECT request_id, string_agg(type || ':' || s || ':' || e, ' ' ORDER BY s) AS detections "
        "FROM det_accepted GROUP BY request_id",
    ),
    (
        "results",
        f"""SELECT r.request_id, r.text AS original_text, r.masked_text AS processed_text,
        a.provider, 'ANALYZED' AS status, coalesce(p.detections, '') AS detections,
        r.restored || '{MOCK_SUFFIX}' AS response
        FROM rep_accepted r JOIN accepted a USING (request_id)
        LEFT JOIN places p USING (request_id)""",
    ),
]

# Replies and what the batch restore makes of them: live sets put values back.
RESTORED = MSK + [
    (
        "counts",
        "SELECT request_id, cast(count(DISTINCT token) as int) AS n "
        "FROM tok_texts GROUP BY request_id",
    ),
    (
        "restored",
        f"""SELECT request_id, 'mock' AS provider, {STORED_AT} AS stored_at,
        {STORED_AT} + {TTL} > {NOW} AND n IS NOT NULL AS live, coalesce(n, 0) AS n,
        masked_text || '{MOCK_SUFFIX}' AS reply, restored || '{MOCK_SUFFIX}' AS value
        FROM msk_texts LEFT JOIN counts USING (request_id)""",
    ),
]
RESTORED_ROWS = """SELECT request_id, provider,
  CASE WHEN live{extra} THEN value ELSE reply END AS response,
  cast(CASE WHEN live{extra} THEN n ELSE 0 END as int) AS token_count,
  cast(NULL as varchar) AS failure_kind FROM restored"""
STORED_BEFORE = f" AND stored_at <= {NOW}"

OUTBOUND = MSK + [
    (
        "sent",
        "SELECT request_id, masked_text, CASE WHEN len(text) % 2 = 0 THEN 'openai' "
        "ELSE 'anthropic' END AS provider FROM msk_texts",
    )
]

LEAKS = MAPPINGS + O.masked() + [
    ("out_masked", "SELECT request_id, masked_text AS text FROM msk_texts"),
] + O.detections("out_masked") + [
    (
        "violations",
        """SELECT 'masked' AS stage, 'original_value' AS reason, m.type
        FROM maps m JOIN msk_texts t USING (request_id) WHERE contains(masked_text, original_value)
        UNION ALL SELECT 'masked', 'detected', type FROM det_out_masked
        UNION ALL SELECT 'raw', 'original_value', type FROM maps
        UNION ALL SELECT 'raw', 'detected', type FROM det_texts""",
    )
]

BUCKET = """WITH RECURSIVE ev AS MATERIALIZED (
  SELECT event_type, event_id, epoch_us(ts) AS us,
    row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
walk AS (
  SELECT event_type, event_id, n, us, cast(0.0 as double) AS tokens, true AS allowed,
    cast(NULL as bigint) AS retry_after FROM ev WHERE n = 1
  UNION ALL
  SELECT event_type, event_id, n, us,
    CASE WHEN x >= 1.0 THEN x - 1.0 ELSE x END, x >= 1.0,
    CASE WHEN x < 1.0 THEN greatest(1, cast(ceil((1.0 - x) / (1 / 60.0::double)) as bigint)) END
  FROM (SELECT e.*, CASE WHEN e.us > w.us THEN least(1.0::double, w.tokens
      + ((e.us - w.us) * 1000 / 1e9::double) * (1 / 60.0::double)) ELSE w.tokens END AS x
    FROM walk w JOIN ev e ON e.event_type = w.event_type AND e.n = w.n + 1))
"""
DECISIONS = BUCKET + "SELECT event_type, event_id, allowed, retry_after FROM walk"
#: The same where events come in five batches by time and every fiftieth one batch late: batches follow
#: one another and a late event finds the clock where the one before it has left it.
IN_TURN = (
    BUCKET.replace(
        "row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events)",
        "row_number() OVER (PARTITION BY event_type ORDER BY batch, ts, event_id) AS n FROM (SELECT *, (epoch_us(ts) "
        "- min(epoch_us(ts)) OVER ()) * 5 // (max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER () + 1) "
        "+ CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS batch FROM events))",
    )
    .replace("SELECT event_type, event_id, n, us,\n    CASE", "SELECT event_type, event_id, n, clock,\n    CASE")
    .replace("FROM (SELECT e.*,", "FROM (SELECT e.*, greatest(e.us, w.us) AS clock,")
    + "SELECT event_type, event_id, allowed, retry_after FROM walk"
)

TOKEN_LIST = f"regexp_extract_all(masked_text, '{TOKEN}')"
SEGMENTS = MSK + [
    (
        "cut",
        f"SELECT request_id, string_split(regexp_replace(masked_text, '({DISPLAY_TOKEN})', "
        "chr(2) || '\\1' || chr(2), 'g'), chr(2)) AS parts FROM msk_texts",
    )
]

ERROR_ROWS = {
    "bad_input": (400, "Bad Request", "Invalid request."),
    "too_large": (413, "Payload Too Large",
                  "Request text exceeds the maximum allowed length of 10000 characters."),
    "unsupported_provider": (400, "Bad Request", "Unsupported provider."),
    "throttled": (429, "Too Many Requests", "Too many requests."),
    "provider_failure": (502, "Bad Gateway", "LLM provider request failed."),
    "provider_timeout": (504, "Gateway Timeout", "LLM provider request timed out."),
    "key_config": (500, "Internal Server Error", "Encryption is not configured correctly."),
    "protection": (500, "Internal Server Error", "Failed to process request securely."),
    "other": (500, "Internal Server Error", "Unexpected error."),
    "never-heard-of": (500, "Internal Server Error", "Unexpected error."),
}
ERROR_VALUES = ", ".join(
    f"({i}, '{k}', {s}, '{e}', '{m}')" for i, (k, (s, e, m)) in enumerate(ERROR_ROWS.items())
)

DOC_SPANS = [
    ("docs", "SELECT cast(doc_id as varchar) AS request_id, text FROM documents")
] + O.detections("docs")
COUNTS = (
    "cast(count(*) as bigint) AS detection_count, count(DISTINCT type || chr(1) || "
    "CASE WHEN type = 'EMAIL' THEN lower(value) ELSE value END) AS value_count"
)

GIVEN = TEXTS + [("given", "SELECT * FROM texts")] + O.masked("given", ("SSN", "PHONE"))

ORACLE: dict[str, str] = {
    f"detect_{name}": sql(TEXTS + O.spans(kind), _spans(f"s_texts_{kind.lower()}"))
    for name, kind in {
        "email": "EMAIL", "url": "URL", "ipv4": "IP_ADDRESS", "credit_card": "CREDIT_CARD",
        "ssn": "SSN", "phone": "PHONE",
    }.items()
}
ORACLE |= {
    "match_offsets": sql(RAW, "SELECT * FROM raw"),
    "checked_candidates": sql(
        RAW,
        f"""SELECT r.request_id, r.type, r.start, r.value,
        {O.IS_IPV4.replace('value', 'r.value')} AS ipv4,
        {O.IS_CARD.replace('value', "regexp_replace(r.value, '[^0-9]+$', '')")} AS card,
        {O.IS_PHONE.replace('value', 'r.value')} AS phone
        FROM raw r WHERE type IN ('IP_ADDRESS', 'CREDIT_CARD', 'PHONE')""",
    ),
    "union_candidates": sql(TEXTS + O.candidates(), _spans("cand_texts")),
    "detections": sql(DET, _spans("det_texts")),
    "utf16_offsets": sql(
        SHIFTED, 'SELECT request_id, type, value, s + 1 AS start, e + 1 AS "end" FROM det_shifted'
    ),
    "assigned_tokens": sql(
        TOK, 'SELECT request_id, type, value, s AS start, e AS "end", token FROM tok_texts'
    ),
    "token_mappings": sql(MAPPINGS, "SELECT * FROM maps"),
    "masked_texts": sql(MSK, "SELECT request_id, masked_text FROM msk_texts"),
    "mask_given_spans": sql(GIVEN, "SELECT request_id, masked_text FROM msk_given"),
    "masked_broken_spans": sql(MSK, "SELECT request_id, masked_text FROM msk_texts"),
    "added_detector": sql(
        TEXTS,
        r"SELECT request_id, unnest(regexp_extract_all(text, '\b[0-9a-f]{40}\b')) AS value FROM texts",
    ),
    "passthrough": sql(
        TEXTS,
        "SELECT request_id, text AS masked_text, 0 AS detection_count, 0 AS token_count, "
        "'[]' AS detection_types FROM texts",
    ),
    "masked_segments": sql(
        SEGMENTS,
        "SELECT request_id, cast(i - 1 as int) AS pos, i % 2 = 0 AS is_token, parts[i] AS piece "
        "FROM (SELECT request_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM cut)",
    ),
    "token_collisions": sql(
        MSK,
        f"SELECT request_id, cast(len(list_distinct(regexp_extract_all(text, '{TOKEN}'))) as int) "
        f"AS in_text, cast(len(list_distinct({TOKEN_LIST})) as int) AS in_masked FROM msk_texts",
    ),
    "accepted_requests": sql(
        REQUESTS, "SELECT request_id, provider, cast(len(text) as int) AS text_length FROM within"
    ),
    "rejected_requests": sql(REQUESTS, "SELECT * FROM rejected"),
    "reject_summary": sql(
        REQUESTS, "SELECT status, count(*) AS rejects FROM rejected GROUP BY status"
    ),
    "request_checks": sql(
        REQUESTS,
        "SELECT request_id, has_text, has_provider, within_size, resolved FROM checked",
    ),
    "classified_errors": (
        f"WITH rows(i, kind, status, error, message) AS (VALUES {ERROR_VALUES}) "
        "SELECT event_id, kind, status, error, message FROM events JOIN rows "
        f"ON event_id % {len(ERROR_ROWS)} = i"
    ),
    "sanitized_messages": """WITH m AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type
      || ' failed: ' || coalesce(props, '') || repeat('😀x', cast(event_id % 211 as int)) END AS m FROM events),
      c AS (SELECT event_id, m, list_sum(list_transform(string_split(m, ''),
        lambda x: CASE WHEN unicode(x) > 65535 THEN 2 ELSE 1 END)) AS units FROM m),
      k AS (SELECT event_id, m, list_max(list_filter(range(1, 301), lambda i:
        list_sum(list_transform(string_split(substr(m, 1, i), ''),
          lambda x: CASE WHEN unicode(x) > 65535 THEN 2 ELSE 1 END)) <= 300)) AS fits FROM c WHERE units > 300)
      SELECT event_id, CASE WHEN m = '' THEN 'Request failed.' ELSE m END AS message
      FROM c WHERE m = '' OR units <= 300
      UNION ALL SELECT event_id, substr(m, 1, fits) FROM k""",
    "reply_outcomes": """SELECT event_type, CASE event_id % 10 WHEN 0 THEN 'success'
      WHEN 1 THEN 'success' WHEN 2 THEN 'bad-request' WHEN 3 THEN 'unauthorized'
      WHEN 5 THEN 'too-large' WHEN 6 THEN 'rate-limited' WHEN 8 THEN 'provider-error'
      WHEN 9 THEN 'provider-error' ELSE 'unknown' END AS outcome, count(*) AS requests
      FROM events GROUP BY ALL""",
    "json_requests": sql(
        REQUESTS,
        """SELECT request_id, 'read' AS outcome, cast(len(text) as int) AS n FROM requests
        WHERE len(coalesce(text, '')) % 17 <> 0
        UNION ALL SELECT NULL, 'Invalid request.', cast(count(*) as int) FROM requests
        WHERE len(coalesce(text, '')) % 17 = 0 HAVING count(*) > 0
        UNION ALL SELECT NULL, 'drawn ids', cast(2 * count(*) as int) FROM requests
        WHERE len(text) % 19 = 0""",
    ),
    "protected_mappings": sql(
        STORED,
        'SELECT request_id, token, type, start, "end", stored_at, expires_at, '
        "cast(strlen(original_value) + 28 as int) AS sealed_bytes FROM sets",
    ),
    "sealed_round_trip": sql(
        STORED,
        "SELECT request_id, token, original_value AS opened, cast(NULL as varchar) AS wrong_key "
        "FROM sets",
    ),
    "base64_pairs": sql(
        STORED,
        "SELECT request_id, token, 16 AS iv_length, "
        "cast(4 * ceil((strlen(original_value) + 16) / 3.0) as int) AS ciphertext_length, "
        "true AS same FROM sets",
    ),
    "nonce_uniqueness": sql(
        STORED, "SELECT count(*) AS sealed_values, count(*) AS nonces FROM sets"
    ),
    "newest_sets": sql(
        NEWEST,
        "SELECT request_id, cast(count(*) as int) AS tokens, stored_at, expires_at "
        "FROM newest GROUP BY ALL",
    ),
    "live_mappings": sql(
        NEWEST,
        "SELECT request_id, cast(count(*) as int) AS tokens, expires_at FROM live GROUP BY ALL",
    ),
    "live_request_count": sql(
        NEWEST, "SELECT count(DISTINCT request_id) AS live_requests FROM live"
    ),
    "purged_mappings": sql(
        STORED, f"SELECT DISTINCT request_id, expires_at FROM sets WHERE expires_at > {NOW}"
    ),
    "kept_mappings": sql(
        STORED,
        f"SELECT request_id, count(*) AS values, expires_at FROM sets WHERE expires_at > {NOW} GROUP BY request_id, expires_at",
    ),
    "looked_up_mappings": sql(
        NEWEST,
        'SELECT m.request_id, m.token, l.type, l.start, l."end", l.original_value AS value '
        "FROM maps m LEFT JOIN live l USING (request_id, token)",
    ),
    "unresolved_tokens": sql(
        NEWEST,
        "SELECT request_id, token FROM maps m WHERE NOT EXISTS (SELECT 1 FROM live l "
        "WHERE l.request_id = m.request_id AND l.token = m.token)",
    ),
    "reply_tokens": sql(MAPPINGS, "SELECT request_id, token FROM maps"),
    "mock_replies": sql(RESTORED, "SELECT request_id, provider, reply AS response_text FROM restored"),
    "rehydrated_replies": sql(RESTORED, RESTORED_ROWS.format(extra="")),
    "rehydrated_locally": sql(RESTORED, "SELECT request_id, value AS response FROM restored"),
    "failed_replies": sql(
        RESTORED,
        "SELECT request_id, 500 AS status, 'Internal Server Error' AS error, "
        f"'Failed to process request securely.' AS message, {AT} AS at FROM restored WHERE live",
    ),
    "leak_check": sql(
        LEAKS, "SELECT stage, reason, type, count(*) AS violations FROM violations GROUP BY ALL"
    ),
    "provider_requests": sql(
        OUTBOUND,
        """SELECT provider, CASE provider WHEN 'openai'
        THEN '{"model":"gpt-4o-mini","input":' || to_json(masked_text) || '}'
        ELSE '{"model":"claude-sonnet-4-20250514","max_tokens":4096,"messages":[{"role":"user","content":'
          || to_json(masked_text) || '}]}' END AS body FROM sent""",
    ),
    "parsed_replies": sql(
        OUTBOUND,
        """SELECT request_id, CASE
        WHEN len(masked_text) % 10 = 0 THEN masked_text || ' End.'
        WHEN len(masked_text) % 10 IN (1, 7, 8, 9) THEN masked_text
        WHEN len(masked_text) % 10 < 6 THEN '502 LLM provider request failed.'
        WHEN provider = 'openai' THEN masked_text ELSE ' End.' END AS outcome FROM sent""",
    ),
    "per_text_report": sql(
        REP, "SELECT request_id, detection_count, token_count, detection_types FROM rep_texts"
    ),
    "rehydrate_report": sql(
        RESTORED,
        "SELECT cast(CASE WHEN live THEN n ELSE 0 END as int) AS token_count, "
        "count(*) AS replies FROM restored GROUP BY 1",
    ),
    "detections_by_type": sql(DET, f"SELECT type, {COUNTS} FROM det_texts GROUP BY type"),
    "sketched_counts": sql(DET, f"SELECT type, {COUNTS}, true AS near FROM det_texts GROUP BY type"),
    "sketched_live_requests": sql(
        STORED, f"SELECT count(DISTINCT request_id) AS live_requests, true AS near FROM sets WHERE expires_at > {NOW}"
    ),
    "detections_by_source": sql(
        DOC_SPANS,
        f"SELECT source, lang, type, {COUNTS} FROM det_docs JOIN documents "
        "ON request_id = cast(doc_id as varchar) GROUP BY source, lang, type",
    ),
    "client_keys": "SELECT c_custkey, sha256(c_name) AS client FROM customer",
    "throttled_events": DECISIONS,
    "unthrottled_events": "SELECT event_type, event_id, true AS allowed, cast(NULL as bigint) AS retry_after FROM events",
    "key_problems": """SELECT c_custkey, CASE c_custkey % 7 WHEN 3 THEN 'not 32 bytes' WHEN 4 THEN 'not Base64'
      WHEN 5 THEN 'missing' WHEN 6 THEN 'missing' END AS problem FROM customer""",
    "throttle_summary": BUCKET + """SELECT event_type,
      count(*) FILTER (WHERE allowed) AS admitted, count(*) FILTER (WHERE NOT allowed) AS rejected,
      max(retry_after) AS max_retry_after FROM walk GROUP BY event_type""",
    "throttled_stream": IN_TURN,
    "throttled_batches": IN_TURN,
    "analyzed_requests": sql(ANALYZED, "SELECT * FROM results"),
    "analyzed_stored": sql(
        ANALYZED,
        """SELECT * FROM results WHERE len(processed_text) % 9 <> 0
        UNION ALL SELECT request_id, NULL, NULL, NULL, '502 LLM provider request failed.', NULL, NULL
        FROM results WHERE len(processed_text) % 9 = 0
        UNION ALL SELECT request_id, NULL, NULL, NULL, CASE WHEN has_text AND has_provider
          THEN '400 Unsupported provider: ' || provider ELSE '400 Invalid request.' END, NULL, NULL
        FROM kinds WHERE NOT has_text OR NOT has_provider OR resolved IS NULL""",
    ),
    "results_without_raw": sql(ANALYZED, "SELECT * EXCLUDE (original_text) FROM results"),
    "masked_stream": sql(
        REP,
        "SELECT request_id, masked_text, detection_count, token_count, detection_types "
        "FROM rep_texts",
    ),
    "masked_and_protected_stream": sql(
        REP,
        "SELECT request_id, token_count, nullif(token_count, 0) AS stored FROM rep_texts",
    ),
    "rehydrated_stream": sql(RESTORED, RESTORED_ROWS.format(extra=STORED_BEFORE)),
    "rehydrated_stream_batches": sql(RESTORED, RESTORED_ROWS.format(extra=STORED_BEFORE)),
    "rehydrated_stream_join": sql(RESTORED, RESTORED_ROWS.format(extra=STORED_BEFORE)),
}
